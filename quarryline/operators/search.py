"""Full-text search over a few fields: postings, fuzzy terms, boosted scores, snippets, authority first.

The score of a document is the sum over query terms and fields of boost x tf x ln(1 + N / df); df counts documents with the
term in any field. Terms match within one edit. Fuzzy matching joins on shortened forms, never on all pairs of words.
"""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Field weights. (fixed values)
BOOSTS = {"title": 4.0, "tags": 3.0, "type": 2.0, "description": 2.0, "body": 1.0}


def terms(c: Column) -> Column:
    """The words of a text in lower case: runs of ASCII letters and digits."""
    return F.regexp_extract_all(F.lower(c), F.lit("([a-z0-9]+)"), 1)


def postings(docs: DataFrame, key: str) -> DataFrame:
    """(doc, field, term, tf) over the fields of ``BOOSTS``; tags may be an array."""
    kinds = dict(docs.dtypes)
    fields = F.array(*[F.struct(F.lit(f).alias("field"), terms(F.concat_ws(" ", F.col(f)) if kinds[f].startswith("array") else F.col(f)).alias("terms")) for f in BOOSTS])
    rows = docs.select(F.col(key).alias("doc"), F.explode(fields).alias("f")).select("doc", "f.field", F.explode("f.terms").alias("term"))
    return rows.groupBy("doc", "field", "term").agg(F.count("*").alias("tf"))


def _shortened(c: Column) -> Column:
    """A word and the forms with one letter left out: two words within one edit share one of them."""
    drop = F.transform(F.sequence(F.lit(1), F.length(c)), lambda i: F.concat(F.substring(c, F.lit(1), i - 1), F.substring(c, i + 1, F.length(c))))
    return F.array_distinct(F.concat(F.array(c), drop))


def near_terms(words: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """(word, term): terms of the vocabulary within one edit of a word."""
    a = words.select("word", F.explode(_shortened(F.col("word"))).alias("form"))
    b = vocabulary.select("term", F.explode(_shortened(F.col("term"))).alias("form"))
    return a.join(b, "form").select("word", "term").distinct().where(F.levenshtein("word", "term", 1) >= 0)


def search(index: DataFrame, queries: DataFrame, documents: int, k: int = 100) -> DataFrame:
    """(query, doc, score, rank): the best ``k`` documents of every query (query string), ties by document."""
    words = queries.select("query", F.explode(F.array_distinct(terms(F.col("query")))).alias("word"))
    vocabulary = index.groupBy("term").agg(F.count_distinct("doc").alias("df"))
    near = words.join(near_terms(words.select("word").distinct(), vocabulary), "word").select("query", "term").distinct().join(vocabulary, "term")
    boost = F.lit(0.0)
    for f, b in BOOSTS.items():
        boost = F.when(F.col("field") == f, F.lit(b)).otherwise(boost)
    scores = near.join(index, "term").groupBy("query", "doc").agg(F.round(F.sum(boost * F.col("tf") * F.log(1 + F.lit(float(documents)) / F.col("df"))), 4).alias("score"))
    rank = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "doc")).cast("bigint")
    return scores.withColumn("rank", rank).where(F.col("rank") <= k)


def post_filter(hits: DataFrame, docs: DataFrame, kind: str | None = None, tags: list[str] = (), k: int = 50) -> DataFrame:
    """Hits of a kind or with one of the tags, at most ``k`` a query; filtered after the search has cut its list."""
    about = docs.select("doc", "type", "tags")
    rows = hits.join(about, "doc")
    if kind:
        rows = rows.where(F.col("type") == kind)
    if tags:
        rows = rows.where(F.arrays_overlap("tags", F.array(*map(F.lit, tags))))
    nth = F.row_number().over(Window.partitionBy("query").orderBy("rank"))
    return rows.withColumn("nth", nth).where(F.col("nth") <= k).select("query", "doc", "score", "rank")


def snippet(text: Column, word: Column, before: int = 80, width: int = 240) -> Column:
    """``width`` characters of the text from ``before`` characters ahead of the word, white space collapsed."""
    at = F.greatest(F.lit(1), F.instr(F.lower(text), word) - before)
    return F.trim(F.regexp_replace(F.substring(text, at, F.lit(width)), r"\s+", " "))


def authority_first(hits: DataFrame) -> DataFrame:
    """Adds ``rank`` per query: the authority tier before the others, then the score, then the key."""
    order = Window.partitionBy("query").orderBy(F.when(F.col("tier") == "canon", 0).otherwise(1), F.desc("score"), "key")
    return hits.withColumn("rank", F.row_number().over(order).cast("bigint"))
