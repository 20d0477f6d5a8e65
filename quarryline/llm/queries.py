"""The named queries of the subpackage and their SQL."""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarryline.llm import cooccur, leakage, mixture, page_content, parsing, repeated_lines, residue, split
from quarryline.sources import table

QUERIES, SQL = {}, {}


def query(f):
    QUERIES[f.__name__] = f
    return f


# 1 — items that appear together


def _path() -> Column:
    return F.regexp_replace(F.translate("path", "\\", "/"), r"^\./", "")


def _together(spark: SparkSession, d: str) -> DataFrame:
    return cooccur.cooccurrence(table(spark, d, "changes"), "repo", "sha", _path(), most=50, least=5)


@query
def p1_found(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of paths changed together at least 5 times and 4 times as often as by chance."""
    pairs = _together(spark, d).where("n_ab * n >= 4 * n_a * n_b")
    return pairs.select(F.col("group").alias("repo"), F.col("item_a").alias("path_a"), F.col("item_b").alias("path_b"))


@query
def p1_partners(spark: SparkSession, d: str) -> DataFrame:
    """The partners of each path whose log-likelihood ratio is significant (10.83: one in a thousand), among pairs seen at least 5 times, as its SQL has it."""
    pairs = _together(spark, d).where("llr >= 10.83 AND lift > 1")
    rest = [F.col("n_ab"), F.round("lift", 4).alias("lift"), F.round("llr", 4).alias("llr")]
    one = pairs.select(F.col("group").alias("repo"), F.col("item_a").alias("path"), F.col("item_b").alias("partner"), *rest)
    return one.union(pairs.select("group", "item_b", "item_a", *rest))


_PAIRS = r"""
WITH c AS (SELECT DISTINCT repo, sha, regexp_replace(replace(path, '\', '/'), '^\./', '') AS p FROM changes WHERE path IS NOT NULL),
few AS (SELECT repo, sha FROM c GROUP BY 1, 2 HAVING count(*) <= 50),
k AS (SELECT c.* FROM c JOIN few USING (repo, sha)),
n AS (SELECT repo, count(*) AS n FROM few GROUP BY 1),
one AS (SELECT repo, p, count(*) AS n_p FROM k GROUP BY 1, 2),
two AS (SELECT a.repo, a.p AS pa, b.p AS pb, count(*) AS n_ab FROM k a JOIN k b ON a.repo = b.repo AND a.sha = b.sha AND a.p < b.p GROUP BY 1, 2, 3 HAVING count(*) >= 5),
x AS (SELECT two.*, a.n_p AS n_a, b.n_p AS n_b, n.n FROM two JOIN one a ON two.repo = a.repo AND two.pa = a.p JOIN one b ON two.repo = b.repo AND two.pb = b.p JOIN n ON two.repo = n.repo)
"""
SQL["p1_found"] = _PAIRS + "SELECT repo, pa AS path_a, pb AS path_b FROM x WHERE n_ab * n >= 4 * n_a * n_b"
_G = "CASE WHEN {0} > 0 THEN {0} * ln({0} * n / (CAST({1} AS DOUBLE) * ({2}))) ELSE 0 END"
_LLR = "2 * (" + " + ".join(_G.format(*c) for c in (("n_ab", "n_a", "n_b"), ("(n_a - n_ab)", "n_a", "n - n_b"), ("(n_b - n_ab)", "(n - n_a)", "n_b"), ("(n - n_a - n_b + n_ab)", "(n - n_a)", "n - n_b"))) + ")"
SQL["p1_partners"] = (
    _PAIRS
    + f""", y AS (SELECT repo, pa, pb, n_ab, n_ab * n / CAST(n_a * n_b AS DOUBLE) AS lift, {_LLR} AS llr FROM x), z AS (SELECT * FROM y WHERE llr >= 10.83 AND lift > 1)
SELECT repo, pa AS path, pb AS partner, n_ab, round(lift, 4) AS lift, round(llr, 4) AS llr FROM z UNION ALL SELECT repo, pb, pa, n_ab, round(lift, 4), round(llr, 4) FROM z"""
)


# 2 — splitting oversized items


def _bodies(spark: SparkSession, d: str, short: bool) -> DataFrame:
    a = split.split_items(table(spark, d, "concepts"), "concept_key", "body", short=short).withColumn("record_table", F.lit("concepts"))
    b = split.split_items(table(spark, d, "packed_items"), "item_key", "body", short=short).withColumn("record_table", F.lit("packed_items"))
    return a.union(b).withColumnRenamed("key", "record_key")


@query
def p2_found(spark: SparkSession, d: str) -> DataFrame:
    """The records that come out in more than one piece."""
    return _bodies(spark, d, short=False).where("piece = 2").select("record_table", "record_key").distinct()


@query
def p2_pieces(spark: SparkSession, d: str) -> DataFrame:
    """Every piece of every body, short bodies included."""
    return _bodies(spark, d, short=True).select("record_table", "record_key", "piece", "pieces", "text").distinct()


SQL["p2_found"] = """SELECT DISTINCT 'concepts' AS record_table, concept_key AS record_key FROM concepts WHERE length(body) > 2400
UNION SELECT 'packed_items', item_key FROM packed_items WHERE length(body) > 2400"""


# 5 — lines repeated across one source


def _repeated(spark: SparkSession, d: str) -> DataFrame:
    return repeated_lines.repeated(table(spark, d, "normalized_documents"), "source_id", "norm_id", "markdown")


@query
def p5_found(spark: SparkSession, d: str) -> DataFrame:
    """Lines in at least 4 and at least 5 % of the documents of their source."""
    return _repeated(spark, d).select(F.col("source").alias("source_id"), "line")


@query
def p5_clean(spark: SparkSession, d: str) -> DataFrame:
    """Every document without those lines."""
    docs = table(spark, d, "normalized_documents")
    out = repeated_lines.without_lines(docs, _repeated(spark, d), "source_id", "markdown", "clean")
    return out.select("norm_id", "source_id", "clean").distinct()


_LINES = r"""
WITH raw AS (SELECT DISTINCT source_id, norm_id, unnest(string_split(markdown, chr(10))) AS raw_line FROM normalized_documents WHERE source_id IS NOT NULL AND norm_id IS NOT NULL AND markdown IS NOT NULL),
l AS (SELECT DISTINCT source_id, norm_id, trim(regexp_replace(regexp_replace(lower(raw_line), '[ \t\r]+', ' ', 'g'), '[0-9]+', '#', 'g')) AS line FROM raw),
n AS (SELECT source_id, count(DISTINCT norm_id) AS n FROM normalized_documents GROUP BY 1),
f AS (SELECT source_id, line FROM l JOIN n USING (source_id) WHERE length(line) >= 20 GROUP BY source_id, line, n HAVING count(*) >= greatest(4, 0.05 * n))
"""
SQL["p5_found"] = _LINES + "SELECT source_id, line FROM f"
SQL["p5_clean"] = (
    _LINES
    + r""", d AS (SELECT DISTINCT norm_id, source_id, markdown FROM normalized_documents),
x AS (SELECT norm_id, source_id, string_split(markdown, chr(10)) AS ls FROM d WHERE markdown IS NOT NULL),
y AS (SELECT norm_id, source_id, unnest(ls) AS l, generate_subscripts(ls, 1) AS pos FROM x),
z AS (SELECT y.*, f.line IS NULL AS kept FROM y LEFT JOIN f ON y.source_id = f.source_id AND f.line = trim(regexp_replace(regexp_replace(lower(l), '[ \t\r]+', ' ', 'g'), '[0-9]+', '#', 'g')))
SELECT norm_id, source_id, coalesce(string_agg(l, chr(10) ORDER BY pos) FILTER (WHERE kept), '') AS clean FROM z GROUP BY 1, 2
UNION ALL SELECT norm_id, source_id, NULL FROM d WHERE markdown IS NULL"""
)


# 9 — template residue and error pages


def _residue(spark: SparkSession, d: str) -> DataFrame:
    return residue.residue(table(spark, d, "documents"), "doc_id", "text", "path", "repo")


@query
def p9_found(spark: SparkSession, d: str) -> DataFrame:
    """Documents with residue."""
    return _residue(spark, d).select(F.col("doc").alias("doc_id")).distinct()


@query
def p9_kept(spark: SparkSession, d: str) -> DataFrame:
    """The other documents, without their text."""
    docs = table(spark, d, "documents")
    return docs.join(_residue(spark, d).select(F.col("doc").alias("doc_id")).distinct(), "doc_id", "left_anti").select("doc_id", "source", "lang", "path")


# 7 — evaluation texts in the corpus


def _leaked(spark: SparkSession, d: str) -> DataFrame:
    return leakage.leaked(table(spark, d, "documents"), table(spark, d, "benchmark"), "doc_id", "text", "item_id", "text")


@query
def p7_found(spark: SparkSession, d: str) -> DataFrame:
    """The documents with the items they hold."""
    return _leaked(spark, d).select(F.col("doc").alias("doc_id"), F.col("item").alias("item_id")).distinct()


@query
def p7_items(spark: SparkSession, d: str) -> DataFrame:
    """Per test item: the documents that hold it, none included."""
    docs = _leaked(spark, d).distinct().groupBy("item").agg(F.count("*").alias("n"))
    items = table(spark, d, "benchmark").select("item_id", "suite").distinct()
    return items.join(docs, items.item_id == docs.item, "left").select("item_id", "suite", F.coalesce("n", F.lit(0)).alias("documents"))


# 8 — mixing sources to target shares


def _mixture(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    return mixture.mixture(table(spark, d, "documents"), table(spark, d, "mix_targets"), "doc_id", "source", "text")


@query
def p8_mix(spark: SparkSession, d: str) -> DataFrame:
    """The chosen documents with their repeats."""
    return _mixture(spark, d)[0].withColumnRenamed("doc", "doc_id")


@query
def p8_shares(spark: SparkSession, d: str) -> DataFrame:
    """The shares reached, per listed source."""
    return _mixture(spark, d)[1]


# 3 — source files that do not parse


def _parsed(spark: SparkSession, d: str, why: bool = False) -> DataFrame:
    return parsing.parsed(table(spark, d, "source_files"), "file_id", "repo", "file", "source", "supported", why)


@query
def p3_found(spark: SparkSession, d: str) -> DataFrame:
    """Files that are not valid in the language of their ending."""
    return _parsed(spark, d).where(~F.col("valid")).select(F.col("key").alias("file_id")).distinct()


@query
def p3_defects(spark: SparkSession, d: str) -> DataFrame:
    """Where and why they are not."""
    return _parsed(spark, d, why=True).where(~F.col("valid")).drop("valid", "repo").withColumnRenamed("key", "file_id").distinct()


@query
def p3_rates(spark: SparkSession, d: str) -> DataFrame:
    """The share of invalid files per repository and language."""
    return parsing.rates(_parsed(spark, d))


# 6 — the article of a page


def _articles(spark: SparkSession, d: str) -> DataFrame:
    pages = table(spark, d, "raw_documents").where(F.lower("content_type") == "html")
    return page_content.article(pages, "raw_id", "raw")


@query
def p6_found(spark: SparkSession, d: str) -> DataFrame:
    """The blocks of the article of every page."""
    return _articles(spark, d).select(F.col("key").alias("raw_id"), "block").distinct()


@query
def p6_text(spark: SparkSession, d: str) -> DataFrame:
    """The article of every page that has one, as one text."""
    blocks = _articles(spark, d).distinct().groupBy("key").agg(F.array_sort(F.collect_list(F.struct("position", "block"))).alias("b"))
    return blocks.select(F.col("key").alias("raw_id"), F.array_join("b.block", "\n").alias("text"))
