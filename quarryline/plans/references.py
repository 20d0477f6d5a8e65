"""Queries on references that lead nowhere."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarryline.operators import references as R
from quarryline.sources import table


def _orphans(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    return R.orphans(*(table(spark, d, t) for t in ("artifacts", "relationships", "projections", "concepts")))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    """The references that name nothing: level 0 of the cascade."""
    return _orphans(spark, d)[0].where("level = 0").select("record_table", "record_key", "ref").distinct()


def p4_report(spark: SparkSession, d: str) -> DataFrame:
    """Direct and inherited orphans per table and month."""
    return R.report(_orphans(spark, d)[0])


def p4_holders(spark: SparkSession, d: str) -> DataFrame:
    """Per record: how far it is from a broken reference, and whether its orphanhood is direct or inherited."""
    return _orphans(spark, d)[1].select("holder", "level", F.when(F.col("level") == 0, "direct").otherwise("inherited").alias("kind"))


QUERIES = {"p4_found": p4_found, "p4_report": p4_report, "p4_holders": p4_holders}

_BROKEN = r"""
WITH state AS (SELECT id, path, aliases, deleted_at, row_number() OVER (PARTITION BY id ORDER BY updated_at DESC) AS rn FROM artifacts WHERE id IS NOT NULL),
live AS (SELECT id, path, aliases FROM state WHERE rn = 1 AND deleted_at IS NULL),
names AS (SELECT DISTINCT lower(regexp_replace(n, '^\s+|\s+$', '', 'g')) AS name FROM (
  SELECT id AS n FROM live UNION ALL SELECT path FROM live UNION ALL SELECT unnest(aliases) FROM live) WHERE n IS NOT NULL),
lines AS (SELECT concept_key, bundle, path, updated_at, unnest(string_split(replace(replace(body, chr(13) || chr(10), chr(10)), chr(13), chr(10)), chr(10))) AS line,
  generate_subscripts(string_split(replace(replace(body, chr(13) || chr(10), chr(10)), chr(13), chr(10)), chr(10)), 1) AS pos
  FROM (SELECT DISTINCT concept_key, bundle, path, updated_at, body FROM concepts) WHERE body IS NOT NULL),
marked AS (SELECT *, sum(CASE WHEN regexp_matches(line, '^ {0,3}(```|~~~)') THEN 1 ELSE 0 END) OVER (PARTITION BY concept_key, updated_at ORDER BY pos) AS fences FROM lines),
links AS (SELECT concept_key, bundle, path, updated_at, unnest(regexp_extract_all(line, '\]\(\s*<?([^)\s>]*)', 1)) AS ref FROM marked WHERE fences % 2 = 0),
plain AS (SELECT *, split_part(ref, '#', 1) AS p, string_split(regexp_replace(path, '/?[^/]*$', ''), '/') AS folder FROM links
  WHERE NOT regexp_matches(ref, '^[A-Za-z][A-Za-z0-9+.\-]*:') AND split_part(ref, '#', 1) LIKE '%.md'),
steps AS (SELECT *, list_filter(string_split(p, '/'), lambda s: s NOT IN ('', '.', '..')) AS tail, len(list_filter(string_split(p, '/'), lambda s: s = '..')) AS ups,
  list_filter(folder, lambda s: s <> '') AS base FROM plain),
targets AS (SELECT concept_key, bundle, path, updated_at, ref, CASE WHEN p LIKE '/%' THEN array_to_string(tail, '/')
  ELSE array_to_string(list_concat(base[1:greatest(len(base) - ups, 0)], tail), '/') END AS target FROM steps),
broken AS (
  SELECT 'relationships' AS record_table, rel_key AS record_key, target AS ref, declared_at AS period, source_path AS holder FROM relationships
  WHERE NOT coalesce(is_external, false) AND regexp_replace(target, '^\s+|\s+$', '', 'g') <> '' AND lower(regexp_replace(target, '^\s+|\s+$', '', 'g')) NOT IN (SELECT name FROM names)
  UNION SELECT 'relationships', rel_key, resolved_path, declared_at, source_path FROM relationships
  WHERE NOT coalesce(is_external, false) AND resolved_path IS NOT NULL AND resolved_path NOT IN (SELECT path FROM live WHERE path IS NOT NULL)
  UNION SELECT 'projections', projection_key, r, projected_at, artifact_path FROM (SELECT projection_key, unnest(unresolved_refs) AS r, projected_at, artifact_path FROM projections)
  WHERE regexp_replace(r, '^\s+|\s+$', '', 'g') <> '' AND lower(regexp_replace(r, '^\s+|\s+$', '', 'g')) NOT IN (SELECT name FROM names)
  UNION SELECT 'concepts', concept_key, ref, updated_at, bundle || ':' || path FROM targets t
  WHERE NOT EXISTS (SELECT 1 FROM concepts c WHERE c.bundle = t.bundle AND c.path = t.target))
"""


#: The cascade in SQL: the least level by a recursive walk from the broken holders back over the edges.
_CASCADE = "WITH RECURSIVE " + _BROKEN.strip().removeprefix("WITH ") + r""",
named AS (SELECT DISTINCT lower(regexp_replace(n, '^\s+|\s+$', '', 'g')) AS name, path FROM (
  SELECT id AS n, path FROM live UNION ALL SELECT path, path FROM live UNION ALL SELECT unnest(aliases), path FROM live) WHERE n IS NOT NULL),
onward AS (
  SELECT DISTINCT 'relationships' AS record_table, rel_key AS record_key, target AS ref, declared_at AS period, source_path AS holder, n.path AS parent FROM relationships r
  JOIN named n ON n.name = lower(regexp_replace(r.target, '^\s+|\s+$', '', 'g')) WHERE NOT coalesce(is_external, false) AND n.name <> '' AND source_path <> n.path
  UNION SELECT 'concepts', concept_key, ref, updated_at, bundle || ':' || path, bundle || ':' || target FROM targets t
  WHERE EXISTS (SELECT 1 FROM concepts c WHERE c.bundle = t.bundle AND c.path = t.target) AND path <> target),
edge AS (SELECT DISTINCT holder AS child, parent FROM onward),
walk(holder, level) AS (SELECT DISTINCT holder, 0 FROM broken WHERE holder IS NOT NULL UNION SELECT e.child, w.level + 1 FROM walk w JOIN edge e ON e.parent = w.holder WHERE w.level < 60),
holders AS (SELECT holder, min(level) AS level FROM walk GROUP BY 1),
refs AS (SELECT record_table, record_key, ref, period, 'direct' AS kind FROM broken
  UNION ALL SELECT DISTINCT record_table, record_key, ref, period, 'inherited' FROM onward JOIN holders ON onward.parent = holders.holder)
"""

SQL = {
    "p4_found": _BROKEN + "SELECT DISTINCT record_table, record_key, ref FROM broken",
    "p4_report": _CASCADE
    + """SELECT record_table, period, kind, CAST(sum(n) AS BIGINT) AS refs, count(*) AS records FROM (
  SELECT record_table, strftime(period, '%Y-%m') AS period, kind, record_key, count(DISTINCT ref) AS n FROM refs GROUP BY 1, 2, 3, 4) GROUP BY 1, 2, 3""",
    "p4_holders": _CASCADE + "SELECT holder, CAST(level AS INTEGER) AS level, CASE WHEN level = 0 THEN 'direct' ELSE 'inherited' END AS kind FROM holders",
}
