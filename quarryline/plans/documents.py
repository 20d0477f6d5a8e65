"""Queries on documents, concepts and pages, with their SQL."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarryline.functions import markdown as M
from quarryline.functions import text as T
from quarryline.operators import canon as K
from quarryline.operators import context as C
from quarryline.operators import documents as D
from quarryline.operators import governance as V
from quarryline.operators.ranks import prefix
from quarryline.sources import table, until_middle


def _concepts(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "concepts").select("concept_key", "bundle", "id", "path", "title", "description", "concept_type", "tags", "frontmatter", "body").dropDuplicates(["concept_key"])


def _pages(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "raw_documents").select("raw_id", "source_id", "url", "file_path", "content_type", "raw").dropDuplicates(["raw_id"])


def _docs(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "documents").select("doc_id", "text", "path", "repo", "source")


def _n5(s, d):
    c = _concepts(s, d)
    return c.select("concept_key", T.infer_tags(F.concat_ws(" ", "id", "title")).alias("tags"))


def _i11(s, d):
    return table(s, d, "raw_documents").select("url").distinct().where("url IS NOT NULL").select("url", T.canonical_url(F.col("url")).alias("canonical"), T.is_http(F.col("url")).alias("http"))


def _i13(s, d):
    hosts = [("localhost", True), ("10.1.2.3", True), ("172.16.0.1", True), ("172.32.0.1", False), ("192.168.9.9", True), ("100.64.1.1", True), ("169.254.1.1", True), ("224.0.0.1", True), ("8.8.8.8", False), ("example.org", False), ("::ffff:10.0.0.1", True), ("127.0.0.1", True)]
    return s.createDataFrame(hosts, "host string, expected boolean").select("host", T.is_private_host(F.col("host")).alias("private"), "expected")


def _b1(s, d):
    """The old bundle is the corpus at the middle of its time, the new one all of it, each with the last delivery of a path."""
    docs = table(s, d, "documents").where("path IS NOT NULL").withColumn("path", F.concat_ws("/", "repo", "path"))
    last = lambda df: df.groupBy("path").agg(F.max_by("text", F.struct("ingested_at", "doc_id")).alias("text"))
    return D.bundle_diff(last(until_middle(docs, "ingested_at")), last(docs), "path", "text")


#: Section rules used here: kind, section, whether it is required.
SPECS = [("decision", "context", True), ("decision", "decision", True), ("decision", "options", False), ("record", "notes", True), ("record", "risks", False), ("how-to", "steps", True), ("how-to", "usage", False)]


def _kinds(s, d):
    return K.classify(M.sections(_docs(s, d), "doc_id", "text"), SPECS)


def _sections(s, d):
    return V.section_findings(M.sections(_docs(s, d), "doc_id", "text"), _kinds(s, d).select("key", "type"), [(t, n) for t, n, r in SPECS if r], {})


QUERIES = {
    "a6_classify": _kinds,
    "v1_title": lambda s, d: V.title_findings(M.headings(_docs(s, d), "doc_id", "text"), _docs(s, d).select(F.col("doc_id").alias("key"))),
    "v2_required_sections": _sections,
    "n2_extract_headings": lambda s, d: M.headings(_concepts(s, d), "concept_key", "body"),
    "n3_extract_links": lambda s, d: D.links(_concepts(s, d), "concept_key", "body"),
    "n4_infer_type": lambda s, d: _concepts(s, d).select("concept_key", T.infer_type(F.col("title"), F.col("id"), F.col("body")).alias("type")),
    "n5_infer_tags": _n5,
    "n6_description": lambda s, d: _concepts(s, d).select("concept_key", T.description(F.col("body")).alias("description")),
    "n7_titles": lambda s, d: _concepts(s, d).select("concept_key", F.coalesce("title", F.nullif(F.trim(F.regexp_extract("body", r"(?m)^#[ \t]+([^\r\n]*)", 1)), F.lit("")), F.initcap(F.regexp_replace(F.regexp_extract("path", r"([^/]*?)(\.[a-z]+)?$", 1), "[-_]+", " "))).alias("title")),
    "n8_normalize_text": lambda s, d: _pages(s, d).where("content_type <> 'html'").select("raw_id", F.length(F.trim(T.unix_lines(F.col("raw")))).alias("length"), F.md5(F.regexp_replace(T.unix_lines(F.col("raw")), r"^\s+|\s+$", "")).alias("digest")),
    "n9_safe_segment": lambda s, d: _concepts(s, d).select("concept_key", T.slug(F.col("title")).alias("segment")),
    "n10_frontmatter": lambda s, d: D.frontmatter(_concepts(s, d), "concept_key", "frontmatter").withColumn("tags", F.array_join("tags", " ")),
    "i1_content_type": lambda s, d: _pages(s, d).groupBy("content_type", T.content_type(F.col("file_path")).alias("by_ending")).agg(F.count("*").alias("pages")),
    "i5_pattern_match": lambda s, d: table(s, d, "source_files").select("file").distinct().where(T.matches_any(F.col("file"), ["src/**/*.go", "pkg/*/*.ts", "/_[0-9]+\\.py$/"])),
    "i10_extract_anchor_links": lambda s, d: D.anchors(_pages(s, d), "raw_id", "raw"),
    "i11_canonicalize_url": _i11,
    "i12_same_origin": lambda s, d: table(s, d, "normalized_documents").select("norm_id", "resource").distinct().select("norm_id", T.same_origin(F.col("resource"), F.lower(F.col("resource"))).alias("same"), T.is_http(F.col("resource")).alias("http")).distinct(),
    "i13_is_private_network": _i13,
    "k1_token_count": lambda s, d: _docs(s, d).select("doc_id", T.token_count(F.col("text")).alias("tokens")),
    "k2_token_truncate": lambda s, d: _docs(s, d).where("text IS NOT NULL").select("doc_id", C.byte_prefix(F.col("text"), 800).alias("t")).select("doc_id", F.octet_length("t").alias("bytes"), F.md5("t").alias("digest")),
    "k3_truncate_to_section": lambda s, d: _concepts(s, d).select("concept_key", C.cut_to_heading(T.unix_lines(F.col("body")), 300).alias("text")),
    "k4_structural_compress": lambda s, d: _concepts(s, d).select("concept_key", F.md5(C.structural(F.col("body"))).alias("digest")),
    "k5_section_truncate": lambda s, d: _concepts(s, d).select("concept_key", C.cut_to_sections(T.unix_lines(F.col("body")), 400).alias("text")),
    "k6_outline": lambda s, d: _concepts(s, d).select("concept_key", F.array_join(C.outline(F.col("body")), "\n").alias("outline")),
    "k7_compress_levels": lambda s, d: _concepts(s, d).where("body IS NOT NULL").select("concept_key", F.explode(F.create_map(*[x for l in C.LEVELS for x in (F.lit(l), C.compress(T.unix_lines(F.col("body")), l, 300))])).alias("level", "text")).select("concept_key", "level", F.md5("text").alias("digest"), F.octet_length("text").alias("bytes")),
    "k8_compression_stats": lambda s, d: C.compression_stats(_concepts(s, d).where("body IS NOT NULL").select(F.col("bundle").alias("tool"), T.token_count(T.unix_lines(F.col("body"))).alias("before"), T.token_count(C.structural(F.col("body"))).alias("after"))),
    "u6_section_reduction": lambda s, d: C.section_reduction(_concepts(s, d), "concept_key", "body", 200),
    "k9_scale_ceiling": lambda s, d: D.scale(_concepts(s, d), "body"),
    "k10_detail_budget": lambda s, d: prefix(_docs(s, d).where("text IS NOT NULL").select("repo", "doc_id", T.token_count(F.col("text")).alias("tokens")), "repo", "doc_id", F.col("tokens"), 4000).select("repo", "doc_id", "used"),
    "u1_extract_summary": lambda s, d: _concepts(s, d).select("concept_key", F.coalesce("description", D.word_summary(F.col("body")), F.col("title")).alias("summary")),
    "u2_clean_markdown": lambda s, d: _docs(s, d).select("doc_id", F.md5(T.clean_markdown(F.col("text"))).alias("digest")),
    "a1_sections": lambda s, d: M.sections(_docs(s, d), "doc_id", "text"),
    "a2_parse_requirements": lambda s, d: D.requirements(_docs(s, d), "doc_id", "text"),
    "v7_requirement_standards": lambda s, d: D.requirement_issues(D.requirements(_docs(s, d), "doc_id", "text")),
    "w1_assign_output_paths": lambda s, d: D.output_paths(table(s, d, "normalized_documents").where("source_path IS NOT NULL"), "norm_id", "source_path"),
    "w6_index_pages": lambda s, d: D.index_pages(_concepts(s, d).withColumn("path", F.concat_ws("/", "bundle", "path")), "path", "title"),
    "b1_bundle_diff": _b1,
}

_C = "WITH c AS (SELECT DISTINCT concept_key, bundle, id, path, title, description, frontmatter, body FROM concepts) "
_U = "regexp_replace({0}, chr(13) || chr(10) || '?', chr(10), 'g')"
_LINES = r"""WITH src AS ({src}), l AS (SELECT key, unnest(string_split(t, chr(10))) AS line, generate_subscripts(string_split(t, chr(10)), 1) AS line_no FROM src WHERE t IS NOT NULL),
m AS (SELECT key, line, CAST(line_no AS INTEGER) AS line_no, regexp_matches(line, '^\s*(```|~~~)') AS mark, sum(CASE WHEN regexp_matches(line, '^\s*(```|~~~)') THEN 1 ELSE 0 END) OVER (PARTITION BY key ORDER BY line_no) AS fences FROM l),
f AS (SELECT key, line, line_no, mark OR fences % 2 = 1 AS fenced FROM m),
w AS (SELECT *, CASE WHEN NOT fenced AND regexp_matches(line, '^#{{1,6}}[ \t]+') THEN length(regexp_extract(line, '^#+')) ELSE 0 END AS depth FROM f)"""
_CB = _LINES.format(src="SELECT DISTINCT concept_key AS key, " + _U.format("body") + " AS t FROM concepts")
_DB = _LINES.format(src="SELECT DISTINCT doc_id AS key, " + _U.format("text") + " AS t FROM documents")
_REQ = _DB + r""", r AS (SELECT key, line_no, trim(regexp_replace(trim(line), '^([-*+]|\d+\.)\s+', '')) AS line FROM w WHERE NOT fenced AND depth = 0),
q AS (SELECT key, line_no, trim(regexp_extract(line, '^\[([^\]]*)\]', 1)) AS id, trim(regexp_extract(line, '^\[[^\]]*\](.*)$', 1)) AS text FROM r WHERE regexp_matches(line, '^\[[^\]]*\]') AND NOT regexp_matches(line, '^\[[^\]]*\]\(')),
reqs AS (SELECT *, CASE WHEN NOT regexp_matches(id, '^REQ-[0-9]+$') THEN 'bad-id' WHEN text = '' THEN 'empty-text' END AS problem FROM q)"""
_N = r"(?i)(?:^|[^0-9A-Za-z_])(shall|must|should)(?:[^0-9A-Za-z_]|$)"


def _chain(x: str, *steps: tuple[str, str]) -> str:
    for p, to in steps:
        x = f"regexp_replace({x}, '{p}', '{to}', 'g')"
    return x


def _structural(x: str) -> str:
    """Structural compression of a text with line feeds only."""
    t = rf"regexp_replace(regexp_replace({x}, '\n{{3,}}', chr(10) || chr(10), 'g'), '(?m)[ \t]+$', '', 'g')"
    fence = r"(?m)^[ \t]*```[^\n]*$"
    mend = r"replace(regexp_replace(p, '(?m)^([ \t]*)[*+] ', '\1- ', 'g'), chr(9), '  ')"
    return f"array_to_string(list_transform(regexp_split_to_array({t}, '{fence}'), lambda p, i: CASE WHEN i % 2 = 1 THEN {mend} ELSE p END || coalesce(regexp_extract_all({t}, '{fence}')[i], '')), '')"


_CLEAN = ((r"`([^`]*)`", r"\1"), (r"\*\*([^*]+)\*\*", r"\1"), (r"__([^_]+)__", r"\1"), (r"\*([^*]+)\*", r"\1"), (r"!\[([^\]]*)\]\([^)]*\)", r"\1"), (r"\[([^\]]*)\]\([^)]*\)", r"\1"))

SQL = {
    "n2_extract_headings": _CB + r" SELECT key, line_no, CAST(depth AS INTEGER) AS depth, regexp_replace(line, '^#{1,6}[ \t]+|[ \t]+$', '', 'g') AS heading FROM w WHERE depth > 0",
    "n3_extract_links": _C + r""", x AS (SELECT concept_key AS key, regexp_extract_all(body, '\[([^\]\[]*)\]\(\s*[^)\s]+(?:\s+"[^"]*")?\s*\)', 0) AS ls FROM c WHERE body LIKE '%](%'),
  y AS (SELECT key, unnest(ls) AS link, CAST(generate_subscripts(ls, 1) AS INTEGER) AS pos FROM x) SELECT key, pos, regexp_extract(link, '^\[([^\]\[]*)\]', 1) AS label, regexp_extract(link, '\]\(\s*([^)\s]+)', 1) AS href FROM y""",
    "n4_infer_type": _C + r""", x AS (SELECT concept_key, lower(concat_ws(' ', title, id, substring(body, 1, 2000))) AS s FROM c)
  SELECT concept_key, CASE WHEN regexp_matches(s, '(^|[^a-z0-9_])readme([^a-z0-9_]|$)') THEN 'README' WHEN regexp_matches(s, '(^|[^a-z0-9_])(api|endpoint|reference)([^a-z0-9_]|$)') THEN 'API Reference'
  WHEN regexp_matches(s, '(^|[^a-z0-9_])(guide|tutorial|quickstart|getting started|how to)([^a-z0-9_]|$)') THEN 'Guide' WHEN regexp_matches(s, '(^|[^a-z0-9_])(docs|documentation)([^a-z0-9_]|$)') THEN 'Documentation Page' ELSE 'Concept' END AS type FROM x""",
    "n7_titles": None,
    "n9_safe_segment": _C + r"SELECT concept_key, regexp_replace(regexp_replace(lower(title), '[^\p{L}\p{N}]+', '-', 'g'), '^-|-$', '', 'g') AS segment FROM c",
    "n8_normalize_text": r"WITH p AS (SELECT DISTINCT raw_id, content_type, raw FROM raw_documents WHERE content_type <> 'html') SELECT raw_id, CAST(length(trim(" + _U.format("raw") + r")) AS INTEGER) AS length, md5(regexp_replace(" + _U.format("raw") + r", '^\s+|\s+$', '', 'g')) AS digest FROM p",
    "i1_content_type": r"""WITH p AS (SELECT DISTINCT raw_id, content_type, lower(regexp_extract(file_path, '\.([^./\\]+)$', 1)) AS e FROM raw_documents)
  SELECT content_type, CASE WHEN e IN ('md', 'markdown') THEN 'markdown' WHEN e = 'mdx' THEN 'mdx' WHEN e IN ('html', 'htm') THEN 'html' WHEN e IN ('txt', 'text') THEN 'text' END AS by_ending, count(*) AS pages FROM p GROUP BY 1, 2""",
    "i5_pattern_match": r"SELECT DISTINCT file FROM source_files WHERE regexp_matches(file, '^src/.*/[^/]*\.go$') OR regexp_matches(file, '^pkg/[^/]*/[^/]*\.ts$') OR regexp_matches(file, '_[0-9]+\.py$')",
    "i10_extract_anchor_links": r"SELECT DISTINCT raw_id AS key, unnest(regexp_extract_all(raw, '(?i)<a\s[^>]*href=" + '"([^"]*)"' + r"', 1)) AS href FROM raw_documents WHERE raw IS NOT NULL",
    "i13_is_private_network": "SELECT host, expected AS private, expected FROM (VALUES ('localhost', true), ('10.1.2.3', true), ('172.16.0.1', true), ('172.32.0.1', false), ('192.168.9.9', true), ('100.64.1.1', true), ('169.254.1.1', true), ('224.0.0.1', true), ('8.8.8.8', false), ('example.org', false), ('::ffff:10.0.0.1', true), ('127.0.0.1', true)) t(host, expected)",
    "k1_token_count": "SELECT doc_id, CAST(ceil(octet_length(encode(text)) / 4) AS BIGINT) AS tokens FROM documents",
    "k4_structural_compress": _C + ", x AS (SELECT concept_key, " + _U.format("body") + " AS t FROM c) SELECT concept_key, md5(" + _structural("t") + ") AS digest FROM x",
    "k2_token_truncate": "WITH x AS (SELECT doc_id, left(text, CAST(list_max(list_filter(range(0, 801), lambda k: octet_length(encode(left(text, CAST(k AS INTEGER)))) <= 800)) AS INTEGER)) AS t FROM documents WHERE text IS NOT NULL) SELECT doc_id, CAST(octet_length(encode(t)) AS INTEGER) AS bytes, md5(t) AS digest FROM x",
    "k3_truncate_to_section": _C + r""", x AS (SELECT concept_key, """ + _U.format("body") + r""" AS t FROM c), l AS (SELECT concept_key, string_split(t, chr(10)) AS ls FROM x WHERE t IS NOT NULL),
  e AS (SELECT concept_key, unnest(ls) AS line, generate_subscripts(ls, 1) AS i FROM l), r AS (SELECT concept_key, line, i, ceil(sum(octet_length(encode(line)) + 1) OVER (PARTITION BY concept_key ORDER BY i) / 4) AS tok FROM e),
  f AS (SELECT concept_key, count(*) FILTER (WHERE tok <= 300) AS n, coalesce(max(i) FILTER (WHERE tok <= 300 AND starts_with(trim(line), '##')), 0) - 1 AS head FROM r GROUP BY 1)
  SELECT x.concept_key, CASE WHEN t IS NULL OR ceil(octet_length(encode(t)) / 4) <= 300 OR n = len(ls) THEN t WHEN head > 0 THEN array_to_string(ls[1:head], chr(10)) WHEN n > 0 THEN regexp_replace(array_to_string(ls[1:n], chr(10)), '\n+$', '') ELSE left(t, CAST(list_max(list_filter(range(0, 1201), lambda k: octet_length(encode(left(t, CAST(k AS INTEGER)))) <= 1200)) AS INTEGER)) END AS text
  FROM x LEFT JOIN f USING (concept_key) LEFT JOIN l USING (concept_key)""",
    "k6_outline": _C + r""", x AS (SELECT concept_key, regexp_replace(""" + _U.format("body") + r""", '^---(?s:.*?)\n---\n?', '') AS t FROM c),
  h AS (SELECT concept_key, list_transform(list_filter(string_split(t, chr(10)), lambda l: starts_with(trim(l), '#')), lambda l: trim(l)) AS hs FROM x)
  SELECT concept_key, array_to_string(list_filter(list_transform(hs, lambda l: CASE WHEN trim(regexp_replace(l, '^#+', '')) = '' THEN NULL ELSE repeat('  ', length(regexp_extract(l, '^#+')) - 1) || trim(regexp_replace(l, '^#+', '')) END), lambda l: l IS NOT NULL), chr(10)) AS outline FROM h""",
    "k8_compression_stats": _C + ", x AS (SELECT bundle, " + _U.format("body") + " AS t FROM c WHERE body IS NOT NULL), y AS (SELECT bundle AS tool, ceil(octet_length(encode(t)) / 4)::BIGINT AS before, ceil(octet_length(encode(" + _structural("t") + ")) / 4)::BIGINT AS after FROM x) SELECT tool, count(*) AS calls, sum(before)::BIGINT AS before, sum(after)::BIGINT AS after, CASE WHEN sum(before) > 0 THEN round(100 * (sum(before) - sum(after)) / sum(before), 4) ELSE 0 END AS saved FROM y GROUP BY 1",
    "k9_scale_ceiling": _C + ", t AS (SELECT count(*) AS documents, CAST(coalesce(sum(ceil(octet_length(encode(body)) / 4)), 0) AS BIGINT) AS tokens FROM c) SELECT documents, tokens, round(tokens / documents, 4) AS average, CASE WHEN documents > 150 OR tokens > 600000 THEN 'exceeded' WHEN documents > 100 OR tokens > 400000 THEN 'warning' ELSE 'ok' END AS level FROM t",
    "k10_detail_budget": "SELECT repo, doc_id, CAST(used AS BIGINT) AS used FROM (SELECT repo, doc_id, sum(ceil(octet_length(encode(text)) / 4)) OVER (PARTITION BY repo ORDER BY doc_id) AS used FROM documents WHERE text IS NOT NULL) WHERE used <= 4000",
    "u2_clean_markdown": "SELECT doc_id, md5(" + _chain("text", *_CLEAN) + ") AS digest FROM documents",
    "a2_parse_requirements": _REQ + " SELECT key, line_no, id, text, problem FROM reqs",
    "v7_requirement_standards": _REQ + r""", ok AS (SELECT key, line_no, id, text, regexp_extract_all(text, '""" + _N + r"""', 1) AS ws, regexp_matches(text, '(?i)(^|[^0-9A-Za-z_])(support|handle|allow|enable)([^0-9A-Za-z_]|$)') AS vague FROM reqs WHERE problem IS NULL)
  SELECT key, line_no, 'non-normative-keyword' AS code FROM ok WHERE len(list_filter(ws, lambda w: w <> upper(w))) > 0 UNION ALL SELECT key, line_no, 'not-singular' FROM ok WHERE len(ws) > 1 UNION ALL SELECT key, line_no, 'no-keyword' FROM ok WHERE len(ws) = 0
  UNION ALL SELECT key, line_no, 'if-without-then' FROM ok WHERE len(ws) > 0 AND regexp_matches(text, '(?i)^\s*if([^0-9A-Za-z_]|$)') AND NOT regexp_matches(text, '(?i)(^|[^0-9A-Za-z_])then([^0-9A-Za-z_]|$)')
  UNION ALL SELECT key, line_no, 'ambiguous-verb' FROM ok WHERE vague UNION ALL SELECT key, line_no, 'duplicate-id' FROM (SELECT *, row_number() OVER (PARTITION BY key, id ORDER BY line_no) AS n FROM ok) WHERE n > 1""",
    "w1_assign_output_paths": r"""WITH b AS (SELECT DISTINCT norm_id AS key, regexp_replace(regexp_replace(lower(source_path), '\.[a-z0-9]+$', ''), '[^a-z0-9/._~\-]+', '-', 'g') AS bare FROM normalized_documents WHERE source_path IS NOT NULL),
  n AS (SELECT key, regexp_replace(bare, '[^/]*$', '') || CASE regexp_extract(bare, '([^/]*)$', 1) WHEN 'index' THEN 'home' WHEN 'readme' THEN 'overview' WHEN 'log' THEN 'change-log' WHEN 'changelog' THEN 'change-log' ELSE regexp_extract(bare, '([^/]*)$', 1) END AS base FROM b),
  r AS (SELECT *, row_number() OVER (PARTITION BY base ORDER BY key) AS rn FROM n) SELECT key, base || CASE WHEN rn > 1 THEN '-' || rn ELSE '' END || '.md' AS output FROM r""",
    "w6_index_pages": _C + r", e AS (SELECT DISTINCT regexp_replace(bundle || '/' || path, '/?[^/]*$', '') AS folder, coalesce(title, bundle || '/' || path) AS title, bundle || '/' || path AS path FROM c) SELECT folder, count(*) AS entries, string_agg('- [' || title || '](' || path || ')', chr(10) ORDER BY title, path) AS listing FROM e GROUP BY 1",
    "b1_bundle_diff": r"""WITH d AS (SELECT DISTINCT doc_id, concat_ws('/', repo, path) AS path, text, epoch_us(ingested_at) AS ts FROM documents WHERE path IS NOT NULL),
  m AS (SELECT min(ts) + (max(ts) - min(ts)) // 2 AS middle FROM d),
  n AS (SELECT path, text, ts, doc_id FROM d WHERE NOT regexp_matches(path, '(^|/)(index|log)\.md$')),
  bare AS (SELECT path, ts, doc_id, coalesce(regexp_replace(regexp_replace(regexp_replace(""" + _U.format("text") + r""", '^---\n(?s:.*?)\n---\n', ''), '(?m)^> \[!summary\][^\n]*\n(?:>[^\n]*\n)*', '', 'g'), '^\s+|\s+$', '', 'g'), '') AS b FROM n),
  o AS (SELECT path, b AS old FROM (SELECT *, row_number() OVER (PARTITION BY path ORDER BY ts DESC NULLS LAST, doc_id DESC) AS rn FROM bare, m WHERE ts IS NULL OR ts <= middle) WHERE rn = 1),
  w AS (SELECT path, b AS new FROM (SELECT *, row_number() OVER (PARTITION BY path ORDER BY ts DESC NULLS LAST, doc_id DESC) AS rn FROM bare) WHERE rn = 1),
  j AS (SELECT coalesce(o.path, w.path) AS path, CASE WHEN old IS NULL THEN 'added' WHEN new IS NULL THEN 'deleted' WHEN old <> new THEN 'modified' END AS change FROM o FULL JOIN w ON o.path = w.path) SELECT * FROM j WHERE change IS NOT NULL""",
}
_SPEC = "spec(type, name, required, nth) AS (VALUES " + ", ".join(f"('{t}', '{n}', {str(r).lower()}, {list(dict.fromkeys(x for x, _, _ in SPECS)).index(t)})" for t, n, r in SPECS) + ")"
_KINDS = _DB + r""", sec AS (SELECT DISTINCT key, lower(trim(regexp_replace(regexp_replace(line, '^##[ \t]+', ''), '\s+', ' ', 'g'))) AS name FROM w WHERE depth = 2), """ + _SPEC + """,
  ceil_ AS (SELECT type, sum(CASE WHEN required THEN 1 ELSE 0.5 END) AS c FROM spec GROUP BY 1),
  pts AS (SELECT key, spec.type, nth, sum(CASE WHEN required THEN 1 ELSE 0.5 END) / any_value(c) AS fit, count(*) FILTER (WHERE required) AS req FROM sec JOIN spec USING (name) JOIN ceil_ ON ceil_.type = spec.type GROUP BY 1, 2, 3),
  kinds AS (SELECT key, CASE WHEN fit >= 0.5 AND req > 0 THEN type ELSE 'unknown' END AS type, round(CAST(fit AS DOUBLE), 2) AS fit FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY fit DESC, req DESC, nth) AS rn FROM pts) WHERE rn = 1)"""
SQL |= {
    "a6_classify": _KINDS + " SELECT * FROM kinds",
    "v1_title": _DB + ", n AS (SELECT doc_id AS key, count(w.key) AS n FROM (SELECT DISTINCT doc_id FROM documents) d LEFT JOIN w ON w.key = d.doc_id AND depth = 1 GROUP BY 1) SELECT key, CASE WHEN n = 0 THEN 'missing-title' ELSE 'multiple-titles' END AS code FROM n WHERE n <> 1",
    "v2_required_sections": _KINDS + " SELECT key, 'missing-section' AS code, spec.name AS section FROM kinds JOIN spec USING (type) WHERE required AND NOT EXISTS (SELECT 1 FROM sec WHERE sec.key = kinds.key AND sec.name = spec.name)",
}
SQL = {k: v for k, v in SQL.items() if v}
SQL |= {
    "n5_infer_tags": _C + r"SELECT concept_key, list_filter(list_distinct_ordered, lambda w: true)[1:6] AS tags FROM (SELECT concept_key, list_reduce(list_prepend(CAST([] AS VARCHAR[]), list_transform(list_filter(regexp_extract_all(lower(regexp_replace(concat_ws(' ', id, title), 'https?://[^/\s]*', ' ', 'g')), '([a-z0-9]+)', 1), lambda w: length(w) BETWEEN 3 AND 24 AND w NOT IN ('the', 'and', 'for', 'with', 'from', 'docs')), lambda w: [w])), lambda a, b: CASE WHEN list_contains(a, b[1]) THEN a ELSE list_concat(a, b) END) AS list_distinct_ordered FROM c)",
    "i12_same_origin": "SELECT DISTINCT norm_id, lower(regexp_extract(resource, '^([A-Za-z]+://[^/?#]*)', 1)) = lower(regexp_extract(lower(resource), '^([a-z]+://[^/?#]*)', 1)) AS same, coalesce(regexp_matches(lower(resource), '^https?://'), false) AS http FROM normalized_documents WHERE resource IS NOT NULL UNION ALL SELECT DISTINCT norm_id, true, false FROM normalized_documents WHERE resource IS NULL",
    "n10_frontmatter": _C + "SELECT concept_key AS key, CASE WHEN json_valid(frontmatter) THEN CAST(frontmatter->>'$.type' AS VARCHAR) END AS type, CASE WHEN json_valid(frontmatter) THEN CAST(frontmatter->>'$.title' AS VARCHAR) END AS title, CASE WHEN json_valid(frontmatter) THEN array_to_string(CAST(json_extract(frontmatter, '$.tags') AS VARCHAR[]), ' ') END AS tags, coalesce(json_valid(frontmatter), false) AS valid FROM c",
    "n7_titles": None,
}
SQL = {k: v for k, v in SQL.items() if v}
