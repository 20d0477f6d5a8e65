"""Queries on source files, with their SQL where SQL can say it."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarryline.functions import source as X
from quarryline.operators import changes as C
from quarryline.operators import code as K
from quarryline.operators import graph as G
from quarryline.session import cut
from quarryline.sources import table


def _files(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "source_files").where("supported").groupBy("repo", "file").agg(F.min("source").alias("source"))


def _symbols(s: SparkSession, d: str) -> DataFrame:
    return X.symbols(_files(s, d), "repo", "file", "source")


def _once(s: SparkSession, d: str) -> DataFrame:
    """The symbols, extracted once for queries that use them several times."""
    return cut(_symbols(s, d))


def _q(f):
    return lambda s, d: f(_symbols(s, d))


def _q_once(f):
    return lambda s, d: f(_once(s, d))


def _changed(s, d):
    """The files of the newest commit of every repository."""
    return C.newest(C.log(table(s, d, "changes")), 1).select("repo", F.col("path").alias("file")).distinct()


def _places(symbols):
    """Every call as a place whose definition is asked for."""
    return K.references(symbols).select("repo", "file", "line", "name").distinct()


def _at(s, d):
    symbols = _once(s, d)
    return K.definition_at(symbols, X.imports(_files(s, d), "repo", "file", "source"), _places(symbols))


def _cites(s, d):
    symbols = _once(s, d)
    ids = K.definitions(symbols).select(F.xxhash64("id").alias("key"), F.concat(F.lit("see "), "id").alias("text"))
    return K.artifacts_for_symbol(ids, "key", "text", symbols)


def _hits(s, d):
    symbols = _once(s, d)
    return K.text_hits(symbols, _files(s, d), K.definitions(symbols).select("repo", "name").distinct())


def _graph(s, d):
    return K.code_graph(_once(s, d)).select(F.concat_ws("|", "repo", "src").alias("src"), F.concat_ws("|", "repo", "dst").alias("dst"))


def _cited(s, d):
    """Every other definition cited in a made-up note, half of them a line off."""
    ids = K.definitions(_symbols(s, d)).select(F.xxhash64("id").alias("key"), F.concat(F.lit("see "), F.when(F.xxhash64("id") % 2 == 0, F.col("id")).otherwise(F.regexp_replace("id", r"@\d+$", "@99999"))).alias("text"))
    return K.cited_symbols(ids, "key", "text", _symbols(s, d))


def _scores(s, d):
    return K.file_scores(K.function_findings(_symbols(s, d)), _files(s, d))


QUERIES = {
    "code_extract_symbols": lambda s, d: _symbols(s, d).select("repo", "file", "language", "kind", "name", "type", "parent", "line", "end_line"),
    "code_outline": _q(K.outline),
    "code_find_symbols": lambda s, d: K.find(_symbols(s, d), "writer").select("repo", "file", "id", "type"),
    "code_source": lambda s, d: K.source_of(_symbols(s, d), _files(s, d)).select("repo", "id", F.md5("text").alias("digest")),
    "code_callers": _q(K.callers),
    "code_definition_at": _at,
    "code_imports": lambda s, d: X.imports(_files(s, d), "repo", "file", "source"),
    "code_resolved_imports": lambda s, d: K.resolved_imports(X.imports(_files(s, d), "repo", "file", "source"), _once(s, d)),
    "code_text_hits": _hits,
    "code_artifacts_for_symbol": _cites,
    "code_find_classes": lambda s, d: K.find(_symbols(s, d), "e", kind="struct").select("repo", "file", "id", "type"),
    "e3_god_classes": _q(K.god_classes),
    "code_map": _q_once(K.uses),
    "code_func_metrics": lambda s, d: K.definitions(_symbols(s, d)).where("nloc IS NOT NULL").select("repo", "id", "nloc", "ccn", "nesting", "bool_ops", "params", "primitives"),
    "code_symbol_ids": lambda s, d: K.definitions(_symbols(s, d)).select("id", K.parse_symbol_id(F.col("id")).alias("p")).select("id", "p.*"),
    "code_cited_symbols": _cited,
    "g3_code_graph": _q_once(K.code_graph),
    "g3_file_edges": _q_once(K.file_edges),
    "g4_entry_points": _q(K.entry_points),
    "g5_code_rank": lambda s, d: G.pagerank(_graph(s, d)).select("id", F.round("rank", 9).alias("rank")),
    "g9_dead_code": lambda s, d: K.dead_code(_once(s, d), _files(s, d)),
    "g10_name_files": lambda s, d: K.name_files(_files(s, d)),
    "x9_will_break": lambda s, d: K.will_break(_once(s, d), _changed(s, d)),
    "c2_governed_files": lambda s, d: K.mentions(table(s, d, "normalized_documents").select("norm_id", F.concat_ws(" ", "markdown", "source_path").alias("text")).distinct(), "norm_id", "text", table(s, d, "normalized_documents").select(F.col("source_id").alias("repo"), F.col("source_path").alias("file"))),
    "e2_function_findings": _q(K.function_findings),
    "e3_god_files": _q(K.god_files),
    "e6_clones": lambda s, d: K.clones(_files(s, d)),
    "e12_file_scores": _scores,
    "e13_kpis": lambda s, d: K.kpis(_scores(s, d), _symbols(s, d)),
}
_F = "WITH f AS (SELECT repo, file, min(source) AS source FROM source_files WHERE supported GROUP BY 1, 2)"
SQL = {
    "g10_name_files": _F + " SELECT repo, name, count(DISTINCT file) AS files FROM (SELECT repo, file, unnest(regexp_extract_all(source, '([A-Za-z0-9_]+)', 1)) AS name FROM f WHERE source IS NOT NULL) GROUP BY 1, 2",
    "e6_clones": _F + r""", t AS (SELECT repo, file, list_transform(regexp_extract_all(source, '([A-Za-z_][A-Za-z0-9_]*|[0-9]+|[^\sA-Za-z0-9_])', 1), lambda x: CASE WHEN regexp_matches(x, '^[A-Za-z_]') THEN 'id' WHEN regexp_matches(x, '^[0-9]') THEN '0' ELSE x END) AS t FROM f WHERE source IS NOT NULL),
  w AS (SELECT DISTINCT repo, file, unnest(list_transform(range(1, len(t) - 28), lambda i: md5(array_to_string(t[i:i + 29], ' ')))) AS digest FROM t WHERE len(t) >= 30),
  s AS (SELECT repo, digest FROM w GROUP BY 1, 2 HAVING count(DISTINCT file) > 1) SELECT repo, file, count(*) AS windows FROM w SEMI JOIN s USING (repo, digest) GROUP BY 1, 2""",
    "c2_governed_files": r"WITH t AS (SELECT DISTINCT norm_id AS key, concat_ws(' ', markdown, source_path) AS text FROM normalized_documents), m AS (SELECT DISTINCT key, unnest(regexp_extract_all(text, '([A-Za-z0-9_.\-]+(?:/[A-Za-z0-9_.\-]+)+)', 1)) AS file FROM t) SELECT DISTINCT key, source_id AS repo, file FROM m JOIN (SELECT DISTINCT source_id, source_path FROM normalized_documents) f ON m.file = f.source_path",
}
