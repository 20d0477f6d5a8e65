"""Queries that compose verdicts out of findings, with their SQL."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarryline.functions import source as X
from quarryline.operators import assess as A
from quarryline.operators import canon as K
from quarryline.operators import changes as C
from quarryline.operators import code as P
from quarryline.operators import graph as G
from quarryline.plans import changes as PC
from quarryline.plans.knowledge import _CANON, _FIND, _LINKS, _OLD, _kinds, _links, _live, _rel, _roots, _superseded
from quarryline.session import cut
from quarryline.sources import table


def _log(s: SparkSession, d: str) -> DataFrame:
    return C.log(table(s, d, "changes"))


def _files(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "source_files").where("supported").select("repo", "file", "source").groupBy("repo", "file").agg(F.min("source").alias("source"))


def _symbols(s: SparkSession, d: str) -> DataFrame:
    return cut(X.symbols(_files(s, d), "repo", "file", "source"))


def _governed(s: SparkSession, d: str) -> DataFrame:
    """Changed files that stand as a path in a document of their repository."""
    docs = table(s, d, "documents").select(F.struct("repo", "doc_id").alias("k"), "text")
    files = _log(s, d).select("repo", F.col("path").alias("file")).distinct()
    return P.mentions(docs, "k", "text", files).where("key.repo = repo").select("repo", F.col("key.doc_id").alias("document"), "file").distinct()


def _x3(s, d):
    rows = _log(s, d)
    out = None
    for mode, more in (("commit", {}), ("since", {"since": 1_700_000_000}), ("range", {"since": 1_600_000_000, "until": 1_700_000_000}), ("files", {"files": table(s, d, "source_files").select("repo", F.col("file").alias("path"))})):
        one = A.change_set(rows, mode, **more).select(F.lit(mode).alias("mode"), "*")
        out = one if out is None else out.union(one)
    return out


def _x12(s, d):
    rows = _log(s, d)
    target = C.newest(rows, 1).select("repo", "sha").distinct()
    scores = C.risk_percentile(C.risk_baseline(rows)).join(target, ["repo", "sha"], "left_semi")
    tests = C.missing_tests(rows.join(target, ["repo", "sha"], "left_semi"))
    governing = _governed(s, d).join(A.change_set(rows, "commit").select("repo", F.col("path").alias("file")), ["repo", "file"], "left_semi")
    return A.risk_report(scores, tests, C.missing_cochanges(rows), governing=governing)


def _c5(s, d):
    changed = A.change_set(_log(s, d), "commit").select("repo", F.col("path").alias("file"))
    return A.gate_findings(_governed(s, d).join(changed, ["repo", "file"], "left_semi"), s.createDataFrame([], "key string, id string"))


def _impacts(s, d):
    symbols = _symbols(s, d)
    found = P.function_findings(symbols).select("repo", "file", "marker", "severity", "line")
    return A.impacts(found.unionByName(P.god_files(symbols).select("repo", "file", F.lit("god_file").alias("marker"), "severity", F.lit(1).alias("line"))))


def _e1(s, d):
    rank = C.churn_rank(_log(s, d)).select("repo", "path", "commits", "commits_90", "is_hotspot")
    out = A.context_of(_files(s, d), _symbols(s, d), rank, governed=_governed(s, d).select("repo", F.col("file").alias("path")))
    return out.select("repo", "file", "top_level", "nloc", "commits", "commits_90", "is_hotspot", "governed")


def _g14(s, d):
    """The edges between artifacts within two steps of the superseded ones."""
    edges = _kinds(s, d).select("src", "dst", "kind").distinct()
    return G.neighbourhood_edges(edges, _superseded(s, d), 2)


def _t13(s, d):
    """Per bundle: concepts, types, tags, hosts, those without any link, and the most linked ones."""
    c = table(s, d, "concepts").select("concept_key", "bundle", "path", "concept_type", "tags", "resource").distinct()
    links = _links(s, d)
    linked = G.nodes_of(links).select("id")
    ids = c.select("bundle", F.concat_ws(":", "bundle", "path").alias("id")).distinct()
    host = F.lower(F.regexp_extract("resource", r"^[A-Za-z]+://([^/?#]*)", 1))
    one = c.select("bundle", "concept_key", "concept_type", F.nullif(host, F.lit("")).alias("host")).groupBy("bundle").agg(F.count_distinct("concept_key").alias("concepts"), F.count_distinct("concept_type").alias("types"), F.count_distinct("host").alias("hosts"))
    lone = ids.join(linked, "id", "left_anti").groupBy("bundle").agg(F.count("*").alias("orphans"))
    return one.join(lone, "bundle", "left").select("bundle", "concepts", "types", "hosts", F.coalesce("orphans", F.lit(0)).alias("orphans"))


QUERIES = {
    "x3_change_modes": _x3,
    "x12_assess": _x12,
    "c5_gate": _c5,
    "e1_contexts": _e1,
    "e10_governance_markers": lambda s, d: A.governance_markers(C.churn_rank(_log(s, d)), _governed(s, d).select("repo", F.col("file").alias("path"))),
    "e11_contradictions": lambda s, d: A.contradictions(_kinds(s, d), _live(s, d)),
    "e5_co_change_scatter": lambda s, d: A.co_change_scatter(C.co_change(_log(s, d))),
    "e5_hidden_coupling": lambda s, d: A.hidden_coupling(C.co_change(_log(s, d)), P.file_edges(_symbols(s, d))),
    "e12_impacts": _impacts,
    "e12_dimension_scores": lambda s, d: A.dimension_scores(_impacts(s, d), _files(s, d)),
    "e14_ordered_findings": lambda s, d: A.ordered(_impacts(s, d)),
    "v8_ticket_lint": lambda s, d: A.ticket_lint(_rel(s, d).where("relationship = 'related_tickets'").select("rel_key", "target").distinct(), "target"),
    "gt3_merge": lambda s, d: A.merge_gates(K.gate(K.findings(_live(s, d), _rel(s, d))), K.gate(K.apply_policy(K.findings(_live(s, d), _rel(s, d)), disabled=["relationship-target-not-found"]))),
    "g14_neighborhood_edges": _g14,
    "t13_bundle_totals": _t13,
    "t13_most_linked": lambda s, d: G.degrees(_links(s, d)).withColumn("links", F.col("inbound") + F.col("outbound")).orderBy(F.desc("links"), "id").limit(10),
    "g13_bounded_neighborhood": lambda s, d: G.bounded_neighbourhood(_kinds(s, d).select("src", "dst"), _superseded(s, d), 3),
}

_HOTROWS = PC._WIN + PC._HOT + PC._RANK
_GOV = r""", dt AS (SELECT DISTINCT repo, doc_id, unnest(regexp_extract_all(text, '([A-Za-z0-9_.\-]+(?:/[A-Za-z0-9_.\-]+)+)', 1)) AS file FROM documents WHERE text IS NOT NULL),
gov AS (SELECT DISTINCT dt.repo, dt.doc_id AS document, dt.file FROM dt SEMI JOIN (SELECT DISTINCT repo, path FROM log) l ON l.repo = dt.repo AND l.path = dt.file)"""
_NEWEST = ", cmx AS (SELECT repo, sha, max(ts) AS ts FROM log GROUP BY 1, 2), nwx AS (SELECT repo, sha FROM (SELECT *, row_number() OVER (PARTITION BY repo ORDER BY ts DESC, sha) AS rn FROM cmx) WHERE rn = 1)"
_SET = "SELECT '{0}' AS mode, repo, path, CAST(sum(added) AS BIGINT) AS added, CAST(sum(deleted) AS BIGINT) AS deleted, true AS counted FROM log {1} GROUP BY repo, path"

SQL = {
    "x3_change_modes": PC.LOG + _NEWEST + " " + " UNION ALL ".join((_SET.format("commit", "SEMI JOIN nwx USING (repo, sha)"), _SET.format("since", "WHERE ts > 1700000000"), _SET.format("range", "WHERE ts > 1600000000 AND ts <= 1700000000"), "SELECT DISTINCT 'files', repo, file, NULL::BIGINT, NULL::BIGINT, false FROM source_files")),
    "x12_assess": PC.LOG + _NEWEST + _GOV + f""", sc AS (SELECT p.* FROM ({PC.SQL["x7_percentile"]}) p SEMI JOIN nwx USING (repo, sha)), te AS (SELECT t.* FROM ({PC.SQL["x8_missing_tests"]}) t SEMI JOIN nwx USING (repo, sha)), pa AS ({PC.SQL["x10_missing_cochanges"]})
  SELECT repo, '' AS path, 'change-risk' AS code, 'info' AS severity, 'risk ' || printf('%.1f', score) || CASE WHEN percentile IS NULL THEN ', no baseline' ELSE ', percentile ' || printf('%.0f', round(percentile)) || ' (' || priority || ')' END AS message FROM sc
  UNION SELECT repo, path, 'missing-test', 'warning', 'changed without a test' FROM te UNION SELECT repo, path, 'missing-co-change', 'warning', 'usually changes with ' || partner || ' (' || n || ' times)' FROM pa
  UNION SELECT gov.repo, gov.file, 'governed-change', 'warning', 'governed by ' || document FROM gov SEMI JOIN (SELECT DISTINCT repo, path FROM log SEMI JOIN nwx USING (repo, sha)) t ON t.repo = gov.repo AND t.path = gov.file""",
    "c5_gate": PC.LOG + _NEWEST + _GOV + " SELECT DISTINCT gov.file AS path, 'governed-file-changed' AS code, 'warning' AS severity, 'governed by ' || document AS message FROM gov SEMI JOIN (SELECT DISTINCT repo, path FROM log SEMI JOIN nwx USING (repo, sha)) t ON t.repo = gov.repo AND t.path = gov.file",
    "e10_governance_markers": PC.LOG + _HOTROWS + _GOV + ", g AS (SELECT DISTINCT repo, file AS path FROM gov) SELECT repo, path, 'ungoverned_hotspot' AS marker FROM flag ANTI JOIN g USING (repo, path) WHERE is_hotspot UNION ALL SELECT repo, path, 'stale_governance' FROM flag SEMI JOIN g USING (repo, path) WHERE commits_90 >= 5",
    "e11_contradictions": _CANON + " SELECT DISTINCT e.src AS source, e.dst AS target FROM e JOIN live ON live.path = e.dst WHERE kind = 'supersedes' AND trim(live.status) <> '' AND lower(trim(live.status)) <> 'superseded'",
    "e5_co_change_scatter": PC.LOG + PC._CO + " SELECT repo, path, 'co_change_scatter' AS marker FROM co WHERE n >= 3 GROUP BY 1, 2 HAVING count(*) >= 5",
    "v8_ticket_lint": r"SELECT DISTINCT rel_key, target FROM relationships WHERE relationship = 'related_tickets' AND trim(target) <> '' AND NOT regexp_matches(trim(target), '^(?:[A-Z][A-Z0-9]+-\d+|#\d+|[\w.\-]+/[\w.\-]+#\d+|https?://\S+)$')",
    "gt3_merge": _CANON + _FIND + ", w AS (SELECT severity FROM issues UNION ALL SELECT severity FROM issues WHERE code <> 'relationship-target-not-found') SELECT count(*) FILTER (WHERE severity = 'error') AS blocking, count(*) FILTER (WHERE severity <> 'error') AS advisory, count(*) FILTER (WHERE severity = 'error') = 0 AS passed FROM w",
    "g14_neighborhood_edges": _CANON + f", ed AS (SELECT DISTINCT src, dst FROM e), bi AS (SELECT src, dst FROM ed UNION SELECT dst, src FROM ed), a0 AS ({_OLD}), a1 AS (SELECT id FROM a0 UNION SELECT dst FROM a0 JOIN bi ON a0.id = bi.src) SELECT DISTINCT src, dst, kind FROM e WHERE src IN (SELECT id FROM a1) OR dst IN (SELECT id FROM a1)",
    "t13_bundle_totals": _LINKS + r", c AS (SELECT DISTINCT concept_key, bundle, path, concept_type, resource FROM concepts) SELECT bundle, count(DISTINCT concept_key) AS concepts, count(DISTINCT concept_type) AS types, count(DISTINCT nullif(lower(regexp_extract(resource, '^[A-Za-z]+://([^/?#]*)', 1)), '')) AS hosts, count(DISTINCT bundle || ':' || path) FILTER (WHERE bundle || ':' || path NOT IN (SELECT id FROM node)) AS orphans FROM c GROUP BY 1",
    "t13_most_linked": _LINKS + " SELECT *, inbound + outbound AS links FROM (SELECT id, (SELECT count(*) FROM link WHERE src = id) AS outbound, (SELECT count(*) FROM link WHERE dst = id) AS inbound FROM node) ORDER BY links DESC, id LIMIT 10",
}
