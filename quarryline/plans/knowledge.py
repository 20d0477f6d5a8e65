"""Queries on artifacts, references, link graphs and search, with their SQL."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarryline.operators import canon as K
from quarryline.operators import context as C
from quarryline.operators import graph as G
from quarryline.operators import references as R
from quarryline.operators import search as S
from quarryline.plans.documents import _U, _structural
from quarryline.plans.references import _BROKEN
from quarryline.sources import table, until_middle


def _live(s: SparkSession, d: str) -> DataFrame:
    return K.state(table(s, d, "artifacts"))


def _rel(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "relationships")


def _q(f, *more):
    return lambda s, d: f(_live(s, d), _rel(s, d), *more)


def _links(s: SparkSession, d: str) -> DataFrame:
    """The link graph of the concepts: edges between existing ones."""
    c = table(s, d, "concepts")
    there = c.select("bundle", F.col("path").alias("target")).distinct()
    links = R.body_links(c).join(there, ["bundle", "target"], "left_semi")
    return G.plain(links.select(F.concat_ws(":", "bundle", "path").alias("src"), F.concat_ws(":", "bundle", "target").alias("dst")))


def _kinds(s: SparkSession, d: str) -> DataFrame:
    return K.edges(_live(s, d), _rel(s, d))


def _roots(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "concepts").where("path LIKE 'guides/%'").select(F.concat_ws(":", "bundle", "path").alias("id")).distinct()


def _supersedes(s: SparkSession, d: str) -> DataFrame:
    """Old to new: the artifact that supersedes another follows it."""
    return _kinds(s, d).where("kind = 'supersedes'").select(F.col("dst").alias("src"), F.col("src").alias("dst"))


def _superseded(s: SparkSession, d: str) -> DataFrame:
    return _live(s, d).where("lower(status) = 'superseded'").select(F.col("path").alias("id")).distinct()


def _docs(s: SparkSession, d: str) -> DataFrame:
    c = table(s, d, "concepts").select("concept_key", "id", "path", "title", "tags", F.col("concept_type").alias("type"), "description", "body")
    return c.dropDuplicates(["concept_key"])


def _queries(s: SparkSession, d: str) -> DataFrame:
    """The queries of the items whose key is divisible by 100, against all documents."""
    return table(s, d, "packed_items").where("item_key % 100 = 0").select(F.col("query_text").alias("query")).where("query IS NOT NULL").distinct()


def _hits(s: SparkSession, d: str) -> DataFrame:
    docs = _docs(s, d)
    return S.search(S.postings(docs, "concept_key"), _queries(s, d), docs.count(), 10)


def _t4(s, d):
    words = _queries(s, d).select("query", F.try_element_at(F.regexp_extract_all("query", F.lit("([a-z0-9]+)"), 1), F.lit(2)).alias("word"))
    hits = _hits(s, d).where("rank <= 3").join(words, "query").join(_docs(s, d).select(F.col("concept_key").alias("doc"), "body"), "doc")
    return hits.select("query", "doc", S.snippet(F.col("body"), F.col("word")).alias("snippet"))


def _items(s: SparkSession, d: str) -> DataFrame:
    """Packed items as hits of a coarser query: its last word."""
    i = table(s, d, "packed_items").dropDuplicates(["item_key"])
    return i.select(F.regexp_extract("query_text", r"(\w+)$", 1).alias("query"), F.col("item_key").alias("key"), "tier", "score", F.ceil(F.octet_length("body") / 4).alias("tokens"), "body").where("query <> ''")


def _t12(s, d):
    """The legacy context: hits with neighbours of the first three, packed as JSON."""
    docs = _docs(s, d)
    hits = S.search(S.postings(docs, "concept_key"), _queries(s, d), docs.count(), C.HITS)
    c = table(s, d, "concepts")
    ids = c.select("concept_key", F.concat_ws(":", "bundle", "path").alias("id")).distinct()
    edges = _links(s, d).join(ids.select(F.col("id").alias("src"), F.col("concept_key").alias("a")), "src").join(ids.select(F.col("id").alias("dst"), F.col("concept_key").alias("b")), "dst").select(F.col("a").alias("src"), F.col("b").alias("dst"))
    return C.assemble_snippets(C.with_neighbours(hits, edges), docs.withColumnRenamed("concept_key", "doc")).drop("content")


def _t5(s, d):
    """Concepts asked for by path, looked up as id, lower id without ending, or path."""
    asked = table(s, d, "concepts").select(F.col("path").alias("asked"), "bundle").distinct()
    c = _docs(s, d).join(table(s, d, "concepts").select("concept_key", "bundle").distinct(), "concept_key")
    by_id = c.select("bundle", F.lower("id").alias("k"), "concept_key")
    return asked.withColumn("k", F.regexp_replace(F.lower("asked"), r"\.md$", "")).join(by_id, ["bundle", "k"], "left").select("bundle", "asked", "concept_key")


def _j3(s, d):
    """Issues of all relationships that those declared until the middle of the time did not have, with the artifacts of now."""
    rel = _rel(s, d)
    found = lambda r: K.findings(_live(s, d), r).select("code", "source_path")
    return K.introduced(found(until_middle(rel, "declared_at")), found(rel))


QUERIES = {
    "a4_corpus_state": lambda s, d: _live(s, d).select("id", "repo", "path", "artifact_type", "status", "retired"),
    "r2_resolution_index": lambda s, d: K.resolution_index(_live(s, d)),
    "r3_duplicate_names": lambda s, d: K.duplicate_names(_live(s, d)),
    "r4_r7_findings": _q(K.findings),
    "r8_relationships_view": _q(K.outcomes),
    "r9_inbound_counts": _q(K.inbound),
    "r9_outgoing": _q(K.outgoing),
    "r10_summarize": _q(K.summary),
    "gt1_policy": lambda s, d: K.apply_policy(K.findings(_live(s, d), _rel(s, d)), ["relationship-self-reference"], ["relationship-target-superseded"], ["relationship-target-not-found"]),
    "gt2_gate": lambda s, d: K.gate(K.findings(_live(s, d), _rel(s, d))),
    "j2_infer_edges": lambda s, d: K.infer_references(table(s, d, "relationships").select("rel_key", "target").distinct(), "rel_key", "target", _live(s, d)),
    "j3_issues_introduced": _j3,
    "t7_successor": lambda s, d: G.follow(_supersedes(s, d), _superseded(s, d)),
    "t13_bundle_stats": lambda s, d: table(s, d, "concepts").select("concept_key", "bundle", "concept_type", F.explode_outer("tags").alias("tag")).distinct().groupBy("bundle", "concept_type").agg(F.count_distinct("concept_key").alias("concepts"), F.count_distinct("tag").alias("tags")),
    "t15_store_summary": lambda s, d: _live(s, d).select(F.lit("canon").alias("tier"), F.col("artifact_type").alias("type"), "status").union(_docs(s, d).select(F.lit("reference"), "type", F.lit(None).cast("string"))).groupBy("tier", "type", "status").agg(F.count("*").alias("n")),
    "g1_internal_links": lambda s, d: R.body_links(table(s, d, "concepts")).select("concept_key", "ref", "target").distinct(),
    "g2_link_graph": _links,
    "g2_degrees": lambda s, d: G.degrees(_links(s, d)),
    "w3_backlinks": lambda s, d: _links(s, d).groupBy(F.col("dst").alias("id")).agg(F.array_join(F.array_sort(F.collect_set("src")), " ").alias("backlinks")),
    "g5_pagerank": lambda s, d: G.pagerank(_links(s, d)).select("id", F.round("rank", 9).alias("rank")),
    "g6_communities": lambda s, d: G.communities(_links(s, d)),
    "g7_cycles": lambda s, d: G.strong_components(_links(s, d)),
    "g8_reachability": lambda s, d: G.reachable(_links(s, d), _roots(s, d)),
    "g12_canon_cycles": lambda s, d: G.strong_components(_kinds(s, d).where("kind = 'supersedes'")),
    "g13_neighborhood": lambda s, d: G.neighbourhood(_kinds(s, d).select("src", "dst"), _superseded(s, d), 2),
    "t14_neighbors": lambda s, d: G.neighbourhood(_links(s, d), _roots(s, d), 2),
    "w10_export_graph": lambda s, d: _links(s, d).select(F.to_json(F.struct("src", "dst")).alias("json")),
    "w11_sarif": lambda s, d: K.findings(_live(s, d), _rel(s, d)).select(F.to_json(F.struct(F.col("code").alias("ruleId"), F.when(F.col("severity") == "error", "error").otherwise("warning").alias("level"), F.col("source_path").alias("uri"))).alias("result")).distinct(),
    "t1_index_concepts": lambda s, d: S.postings(_docs(s, d), "concept_key"),
    "t2_search": _hits,
    "t3_post_filter": lambda s, d: S.post_filter(_hits(s, d), _docs(s, d).withColumnRenamed("concept_key", "doc"), kind="Guide"),
    "t6_discover": lambda s, d: _hits(s, d).join(_docs(s, d).select(F.col("concept_key").alias("doc"), "path", "title"), "doc").select("query", "doc", "path", "title"),
    "t4_snippet": _t4,
    "t5_get_concept": _t5,
    "t9_authority_rank": lambda s, d: S.authority_first(_items(s, d).drop("body")),
    "t10_fit": lambda s, d: _items(s, d).select("key", C.fit(F.col("body"), F.col("tier") == "canon", F.lit(300)).alias("f")).select("key", "f.how", "f.tokens"),
    "t11_assemble": lambda s, d: C.assemble(S.authority_first(_items(s, d))).drop("body"),
    "t12_assemble_legacy": _t12,
}

_KEY = r"lower(regexp_replace({0}, '^\s+|\s+$', '', 'g'))"
_CANON = rf"""WITH st AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY updated_at DESC) AS rn FROM artifacts WHERE id IS NOT NULL),
live AS (SELECT id, repo, path, artifact_type, status, retired, aliases, title FROM st WHERE rn = 1 AND deleted_at IS NULL),
nm AS (SELECT DISTINCT {_KEY.format("n")} AS name, path FROM (SELECT id AS n, path FROM live UNION ALL SELECT path, path FROM live UNION ALL SELECT unnest(aliases), path FROM live) WHERE n IS NOT NULL),
idx AS (SELECT name, count(*) AS paths, min(path) AS path FROM nm WHERE name <> '' GROUP BY 1),
refs AS (SELECT DISTINCT rel_key, source_path, relationship, target FROM relationships WHERE NOT coalesce(is_external, false) AND {_KEY.format("target")} <> ''),
o AS (SELECT rel_key, source_path, relationship, target, CASE WHEN paths IS NULL THEN 'not-found' WHEN paths > 1 THEN 'ambiguous' WHEN path = source_path THEN 'self-reference' ELSE 'resolved' END AS outcome, path FROM refs LEFT JOIN idx ON {_KEY.format("target")} = idx.name),
v AS (SELECT rel_key, source_path, relationship, target, outcome, CASE WHEN outcome IN ('resolved', 'self-reference') THEN path END AS resolved FROM o),
e AS (SELECT DISTINCT source_path AS src, resolved AS dst, relationship AS kind FROM v WHERE outcome = 'resolved')"""
_FIND = """, spec(relationship, wanted, retired_ok) AS (VALUES """ + ", ".join(f"('{a}', '{b}', {str(c).lower()})" for a, b, c in K.EDGE_SPECS) + """),
x AS (SELECT v.*, spec.wanted, coalesce(spec.retired_ok, true) AS retired_ok, t.artifact_type AS type, coalesce(t.retired, false) AS target_retired, coalesce(s.retired, false) AS source_retired
  FROM v LEFT JOIN spec USING (relationship) LEFT JOIN live t ON t.path = v.resolved LEFT JOIN live s ON s.path = v.source_path),
issues AS (SELECT CASE WHEN outcome = 'self-reference' THEN 'warning' ELSE 'error' END AS severity, 'relationship-' || CASE WHEN outcome = 'self-reference' THEN outcome ELSE 'target-' || outcome END AS code, rel_key, source_path, relationship, target FROM x WHERE outcome <> 'resolved'
  UNION ALL SELECT 'warning', 'relationship-edge-unsupported', rel_key, source_path, relationship, target FROM x WHERE wanted IS NULL
  UNION ALL SELECT 'error', 'relationship-target-type-mismatch', rel_key, source_path, relationship, target FROM x WHERE outcome = 'resolved' AND type <> wanted
  UNION ALL SELECT 'warning', 'relationship-target-superseded', rel_key, source_path, relationship, target FROM x WHERE outcome = 'resolved' AND target_retired AND NOT source_retired AND NOT retired_ok)"""
_LINKS = _BROKEN.rstrip() + """,
link AS (SELECT DISTINCT bundle || ':' || path AS src, bundle || ':' || target AS dst FROM targets t WHERE EXISTS (SELECT 1 FROM concepts c WHERE c.bundle = t.bundle AND c.path = t.target) AND path <> target),
node AS (SELECT src AS id FROM link UNION SELECT dst FROM link)"""
_BOTH = ", bi AS (SELECT src, dst FROM {0} UNION SELECT dst, src FROM {0})"


def _recursive(sql: str) -> str:
    return "WITH RECURSIVE " + sql.strip().removeprefix("WITH ")


def _pagerank(links: str, rounds: int = 100, tolerance: str = "1e-6") -> str:
    return _recursive(links) + f""", deg AS (SELECT src, count(*) AS out FROM link GROUP BY 1), n AS (SELECT count(*) AS n FROM node),
r(id, rank, old, round) AS (SELECT id, 1.0::DOUBLE / n, NULL::DOUBLE, 0 FROM node, n
  UNION ALL SELECT w.id, 0.15 / n + 0.85 * (SELECT coalesce(sum(rank), 0) FROM r WHERE id NOT IN (SELECT src FROM deg)) / n + 0.85 * coalesce(f.flow, 0), w.rank, w.round + 1
  FROM r w LEFT JOIN (SELECT dst, sum(rank / out) AS flow FROM link JOIN r ON link.src = r.id JOIN deg ON link.src = deg.src GROUP BY 1) f ON w.id = f.dst, n
  WHERE w.round < {rounds} AND (SELECT coalesce(sum(abs(rank - old)), 1) FROM r) >= {tolerance})
SELECT id, round(rank, 9) AS rank FROM r WHERE round = (SELECT max(round) FROM r)"""


def _communities(links: str, rounds: int = 20) -> str:
    return _recursive(links) + _BOTH.format("link") + f""", l(id, label, moved, round) AS (SELECT id, id, true, 0 FROM node
  UNION ALL SELECT v.id, v.label, v.label <> o.label, v.round FROM (
    SELECT id, label, round, row_number() OVER (PARTITION BY id ORDER BY count(*) DESC, label) AS rn FROM (
      SELECT dst AS id, label, round + 1 AS round FROM bi JOIN l ON bi.src = l.id UNION ALL SELECT id, label, round + 1 FROM l) GROUP BY id, label, round) v
  JOIN l o ON o.id = v.id WHERE v.rn = 1 AND v.round <= {rounds} AND (SELECT bool_or(moved) FROM l))
SELECT id, label FROM l WHERE round = (SELECT max(round) FROM l)"""


def _near(edges: str, roots: str, depth: int) -> str:
    sql = _BOTH.format(edges) + f", k0 AS (SELECT DISTINCT id AS root, id, 0 AS hops FROM ({roots}))"
    for i in range(depth):
        sql += f", k{i + 1} AS (SELECT * FROM k{i} UNION ALL SELECT DISTINCT root, dst, {i + 1} FROM k{i} JOIN bi ON k{i}.id = bi.src WHERE hops = {i} AND NOT EXISTS (SELECT 1 FROM k{i} x WHERE x.root = k{i}.root AND x.id = bi.dst))"
    return sql + f" SELECT root, id, CAST(hops AS INTEGER) AS hops FROM k{depth}"


def _scc(edges: str) -> str:
    return f", w(a, b) AS (SELECT src, dst FROM {edges} UNION SELECT w.a, l.dst FROM w JOIN {edges} l ON w.b = l.src), m AS (SELECT x.a, x.b FROM w x JOIN w y ON x.a = y.b AND x.b = y.a) SELECT a AS id, min(b) AS component FROM m GROUP BY 1 HAVING count(DISTINCT b) > 1"


_ROOTS = "SELECT DISTINCT bundle || ':' || path AS id FROM concepts WHERE path LIKE 'guides/%'"
_OLD = "SELECT DISTINCT path AS id FROM live WHERE lower(status) = 'superseded'"
_POST = """WITH c AS (SELECT DISTINCT concept_key, id, path, title, tags, concept_type, description, body FROM concepts),
f AS (SELECT concept_key AS doc, 'title' AS field, title AS t FROM c UNION ALL SELECT concept_key, 'tags', array_to_string(tags, ' ') FROM c UNION ALL SELECT concept_key, 'type', concept_type FROM c UNION ALL SELECT concept_key, 'description', description FROM c UNION ALL SELECT concept_key, 'body', body FROM c),
p AS (SELECT doc, field, term, count(*) AS tf FROM (SELECT doc, field, unnest(regexp_extract_all(lower(t), '([a-z0-9]+)', 1)) AS term FROM f) GROUP BY 1, 2, 3)"""
_SEARCH = _POST + """, q AS (SELECT DISTINCT query_text AS query FROM packed_items WHERE query_text IS NOT NULL AND item_key % 100 = 0), qw AS (SELECT DISTINCT query, unnest(regexp_extract_all(lower(query), '([a-z0-9]+)', 1)) AS word FROM q),
voc AS (SELECT term, count(DISTINCT doc) AS df FROM p GROUP BY 1), nr AS (SELECT DISTINCT query, term, df FROM qw JOIN voc ON abs(length(word) - length(term)) <= 1 AND levenshtein(word, term) <= 1),
sc AS (SELECT query, doc, round(sum(CASE field WHEN 'title' THEN 4 WHEN 'tags' THEN 3 WHEN 'type' THEN 2 WHEN 'description' THEN 2 ELSE 1 END * tf * ln(1 + (SELECT count(*) FROM c) / CAST(df AS DOUBLE))), 4) AS score FROM nr JOIN p USING (term) GROUP BY 1, 2),
hit AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, doc) AS rank FROM sc) WHERE rank <= 10)"""
_HOW = "CASE WHEN body IS NULL OR {0} <= 0 THEN 'deferred' WHEN full_t <= {0} THEN 'full' WHEN tier = 'canon' AND reqs > 0 AND req_t <= {0} THEN 'requirements' WHEN tier = 'canon' AND reqs > 0 THEN 'deferred' WHEN small_t <= {0} THEN 'compressed' WHEN trim(left(small, 4 * CAST({0} AS INTEGER))) <> '' THEN 'truncated' ELSE 'deferred' END"
_ITEMS = r"""WITH i AS (SELECT DISTINCT item_key, query_text, tier, score, body FROM packed_items), h AS (SELECT regexp_extract(query_text, '(\w+)$', 1) AS query, item_key AS key, tier, score, CAST(ceil(octet_length(encode(body)) / 4) AS BIGINT) AS tokens, body FROM i),
rk AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY CASE WHEN tier = 'canon' THEN 0 ELSE 1 END, score DESC, key) AS rank FROM h WHERE query <> ''),
fs AS (SELECT *, """ + _structural(_U.format("body")) + r""" AS small, list_transform(list_filter(string_split(body, chr(10)), lambda l: regexp_matches(l, '\[REQ-\d+\]')), lambda l: trim(l)) AS rl FROM rk),
fb AS (SELECT query, rank, key, tier, body, small, tokens AS full_t, len(rl) AS reqs, ceil(octet_length(encode(array_to_string(rl, chr(10)))) / 4) AS req_t, ceil(octet_length(encode(small)) / 4) AS small_t FROM fs)"""

SQL = {
    "a4_corpus_state": _CANON + " SELECT id, repo, path, artifact_type, status, retired FROM live",
    "r2_resolution_index": _CANON + " SELECT name, paths FROM idx",
    "r3_duplicate_names": _CANON + " SELECT name, paths FROM idx WHERE paths > 1",
    "r4_r7_findings": _CANON + _FIND + " SELECT * FROM issues",
    "r8_relationships_view": _CANON + " SELECT * FROM v",
    "r9_inbound_counts": _CANON + " SELECT dst AS path, kind, count(*) AS n FROM e GROUP BY 1, 2",
    "r9_outgoing": _CANON + " SELECT src AS path, kind, dst AS target, row_number() OVER (PARTITION BY src ORDER BY kind, dst) AS rank FROM e QUALIFY rank <= 1000",
    "r10_summarize": _CANON + ", s AS (SELECT count(*) AS total, count(*) FILTER (WHERE outcome = 'resolved') AS valid FROM v) SELECT total, valid, total - valid AS broken, (SELECT count(DISTINCT path) FROM live WHERE path NOT IN (SELECT src FROM e UNION SELECT dst FROM e)) AS orphaned, CASE WHEN total = 0 THEN 1 ELSE round(valid / total, 4) END AS coverage FROM s",
    "gt1_policy": _CANON + _FIND + " SELECT CASE code WHEN 'relationship-target-superseded' THEN 'error' WHEN 'relationship-target-not-found' THEN 'warning' ELSE severity END AS severity, code, rel_key, source_path, relationship, target FROM issues WHERE code <> 'relationship-self-reference'",
    "gt2_gate": _CANON + _FIND + " SELECT count(*) FILTER (WHERE severity = 'error') AS blocking, count(*) FILTER (WHERE severity <> 'error') AS advisory, count(*) FILTER (WHERE severity = 'error') = 0 AS passed FROM issues",
    "j2_infer_edges": _CANON + r", t AS (SELECT DISTINCT rel_key AS key, lower(unnest(regexp_extract_all(upper(target), '([A-Z0-9]{2,5}-[0-9A-HJKMNP-TV-Z]{12})', 1))) AS name FROM relationships) SELECT DISTINCT key, path FROM t JOIN idx USING (name) WHERE paths = 1",
    "j3_issues_introduced": _CANON + _FIND + " SELECT code, source_path FROM issues EXCEPT ALL SELECT code, source_path FROM issues SEMI JOIN (SELECT rel_key, source_path, relationship, target FROM relationships WHERE declared_at IS NULL OR epoch_us(declared_at) <= (SELECT min(epoch_us(declared_at)) + (max(epoch_us(declared_at)) - min(epoch_us(declared_at))) // 2 FROM relationships)) USING (rel_key, source_path, relationship, target)",
    "t7_successor": _recursive(_CANON) + f""", nx AS (SELECT dst AS src, min(src) AS nxt FROM e WHERE kind = 'supersedes' GROUP BY 1),
  w(id, last, hops, moved) AS (SELECT id, id, 0, true FROM ({_OLD}) UNION ALL SELECT w.id, nx.nxt, w.hops + 1, nx.nxt <> w.id FROM w JOIN nx ON w.last = nx.src WHERE w.moved AND w.hops < 100)
  SELECT id, last, CAST(hops AS INTEGER) AS hops FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY hops DESC) AS rn FROM w) WHERE rn = 1""",
    "t13_bundle_stats": "SELECT bundle, concept_type, count(DISTINCT concept_key) AS concepts, count(DISTINCT tag) AS tags FROM (SELECT concept_key, bundle, concept_type, unnest(CASE WHEN len(tags) > 0 THEN tags ELSE [NULL] END) AS tag FROM concepts) GROUP BY 1, 2",
    "t15_store_summary": _CANON + ", a AS (SELECT 'canon' AS tier, artifact_type AS type, status FROM live UNION ALL SELECT 'reference', concept_type, NULL FROM (SELECT DISTINCT concept_key, concept_type FROM concepts)) SELECT tier, type, status, count(*) AS n FROM a GROUP BY 1, 2, 3",
    "g1_internal_links": _LINKS + " SELECT DISTINCT concept_key, ref, target FROM targets",
    "g2_link_graph": _LINKS + " SELECT src, dst FROM link",
    "g2_degrees": _LINKS + " SELECT id, (SELECT count(*) FROM link WHERE src = id) AS outbound, (SELECT count(*) FROM link WHERE dst = id) AS inbound FROM node",
    "w3_backlinks": _LINKS + " SELECT dst AS id, string_agg(src, ' ' ORDER BY src) AS backlinks FROM link GROUP BY 1",
    "g5_pagerank": _pagerank(_LINKS),
    "g6_communities": _communities(_LINKS),
    "g7_cycles": _recursive(_LINKS) + _scc("link"),
    "g8_reachability": _recursive(_LINKS) + f", w(id, hops) AS (SELECT id, 0 FROM ({_ROOTS}) UNION SELECT dst, hops + 1 FROM w JOIN link ON w.id = link.src WHERE hops < 60) SELECT id, CAST(min(hops) AS INTEGER) AS hops FROM w GROUP BY 1",
    "g12_canon_cycles": _recursive(_CANON) + ", sup AS (SELECT src, dst FROM e WHERE kind = 'supersedes')" + _scc("sup"),
    "g13_neighborhood": _CANON + ", ed AS (SELECT DISTINCT src, dst FROM e)" + _near("ed", _OLD, 2),
    "t14_neighbors": _LINKS + _near("link", _ROOTS, 2),
    "w10_export_graph": _LINKS + " SELECT CAST(to_json({'src': src, 'dst': dst}) AS VARCHAR) AS json FROM link",
    "w11_sarif": _CANON + _FIND + " SELECT DISTINCT CAST(to_json({'ruleId': code, 'level': CASE WHEN severity = 'error' THEN 'error' ELSE 'warning' END, 'uri': source_path}) AS VARCHAR) AS result FROM issues",
    "t3_post_filter": _SEARCH + " SELECT query, doc, score, rank FROM hit JOIN c ON c.concept_key = doc WHERE concept_type = 'Guide'",
    "t6_discover": _SEARCH + " SELECT query, doc, path, title FROM hit JOIN c ON c.concept_key = doc",
    "t1_index_concepts": _POST + " SELECT * FROM p",
    "t2_search": _SEARCH + " SELECT query, doc, score, rank FROM hit",
    "t4_snippet": _SEARCH + r", x AS (SELECT hit.query, doc, body, regexp_extract_all(hit.query, '([a-z0-9]+)', 1)[2] AS word FROM hit JOIN c ON c.concept_key = doc WHERE rank <= 3) SELECT query, doc, trim(regexp_replace(substring(body, greatest(1, instr(lower(body), word) - 80), 240), '\s+', ' ', 'g')) AS snippet FROM x",
    "t5_get_concept": r"WITH a AS (SELECT DISTINCT bundle, path AS asked FROM concepts), c AS (SELECT DISTINCT bundle, lower(id) AS k, concept_key FROM concepts) SELECT a.bundle, asked, concept_key FROM a LEFT JOIN c ON a.bundle = c.bundle AND c.k = regexp_replace(lower(asked), '\.md$', '')",
    "t9_authority_rank": _ITEMS + " SELECT query, key, tier, score, tokens, rank FROM rk",
    "t10_fit": _ITEMS + ", h2 AS (SELECT *, 300 AS lft FROM fb) SELECT key, how, CAST(CASE how WHEN 'full' THEN full_t WHEN 'requirements' THEN req_t WHEN 'compressed' THEN small_t WHEN 'truncated' THEN lft ELSE 0 END AS BIGINT) AS tokens FROM (SELECT *, " + _HOW.format("lft") + " AS how FROM h2)",
    "t11_assemble": _recursive(_ITEMS) + f""", w(query, rank, key, how, tokens, lft) AS (
  SELECT query, 0::BIGINT, NULL::BIGINT, '', 0::BIGINT, 4000::BIGINT FROM (SELECT DISTINCT query FROM fb)
  UNION ALL SELECT query, rank, key, how, t, lft - t FROM (SELECT *, CAST(CASE how WHEN 'full' THEN full_t WHEN 'requirements' THEN req_t WHEN 'compressed' THEN small_t WHEN 'truncated' THEN lft ELSE 0 END AS BIGINT) AS t
    FROM (SELECT r.*, w.lft, {_HOW.format("w.lft")} AS how FROM w JOIN fb r ON r.query = w.query AND r.rank = w.rank + 1 WHERE r.rank <= 20)))
  SELECT query, key, rank, how, tokens FROM w WHERE rank > 0""",
}
