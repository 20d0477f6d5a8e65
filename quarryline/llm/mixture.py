"""Mixing sources to target shares of the tokens.

Tokens are counted once with a public tokenizer whose vocabulary is read from a given path. Documents of a source get
hash-random keys; the key range is cut into buckets, so that a prefix sum over a source is the sum of the earlier buckets
(a small table) plus a running sum within one bucket, and no source is ever in one task. The prefix sum is cut at the
budget of the source; a budget above its tokens takes whole epochs first, up to ``max_repeats``.

The total is given, or the largest for which every source that has documents can deliver its share within its repeats.
The cut takes the document at the boundary if that comes closer to the budget, so a source misses it by at most half a
document.

Defined results. Null texts and documents of no listed source are not used. Source names are compared in lower case,
trimmed, with blanks and hyphens as underscores. A listed source without documents delivers nothing and is reported so.
Repeated rows count once; targets repeated for one source count once (the largest share). A null share is 0, null repeats
are 1. Further columns are not read.
"""

import base64
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarryline.session import cut

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: How the tokenizer of that vocabulary cuts a text before merging. (fixed value)
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Documents of a bucket, about.
BUCKET_DOCS = 50_000
#: Listed sources at most; they and their totals are held by the driver.
MAX_TARGETS = 100_000

_ENCODINGS: dict[tuple[str, str], object] = {}


def encoding(vocabulary: str = VOCABULARY, pattern: str = PATTERN):
    """The tokenizer, built once per process."""
    if (vocabulary, pattern) not in _ENCODINGS:
        import tiktoken

        with open(vocabulary, "rb") as f:
            ranks = {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in f if line.strip())}
        _ENCODINGS[vocabulary, pattern] = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    return _ENCODINGS[vocabulary, pattern]


def with_tokens(df: DataFrame, text: str, vocabulary: str = VOCABULARY, pattern: str = PATTERN) -> DataFrame:
    """The other columns of ``df``, and ``tokens`` of its ``text``; rows with a null text are left out."""
    rest = [c for c in df.columns if c != text]
    rows = df.where(F.col(text).isNotNull()).select(text, *rest)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoding(vocabulary, pattern).encode_ordinary
        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns[1:], pa.array([len(encode(t)) for t in b.column(0).to_pylist()], pa.int64())], [*rest, "tokens"])

    return rows.mapInArrow(count, rows.drop(text).withColumn("tokens", F.lit(0).cast("bigint")).schema)


def source_key(c: Column) -> Column:
    return F.regexp_replace(F.lower(F.regexp_replace(c, r"^\s+|\s+$", "")), r"[\s\-]+", "_")


def mixture(docs: DataFrame, targets: DataFrame, doc: str, source: str, text: str, total: int | None = None, seed: int = 42, vocabulary: str = VOCABULARY) -> tuple[DataFrame, DataFrame]:
    """(chosen, shares): the documents with their repeats, and what each listed source reaches."""
    wanted = targets.select(source_key(F.col("source")).alias("source"), F.coalesce("target_share", F.lit(0.0)).alias("share"), F.coalesce("max_repeats", F.lit(1)).alias("repeats"))
    wanted = wanted.where("source IS NOT NULL").groupBy("source").agg(F.max_by(F.struct("share", "repeats"), "share").alias("t")).select("source", "t.*")
    if wanted.limit(MAX_TARGETS + 1).count() > MAX_TARGETS:
        raise ValueError(f"more than {MAX_TARGETS} sources are listed")
    wanted = F.broadcast(wanted)

    rows = docs.select(F.col(doc).alias("doc"), source_key(F.col(source)).alias("source"), F.col(text).alias("text")).join(wanted.select("source"), "source", "left_semi")
    sized = cut(with_tokens(rows, "text", vocabulary).select("doc", "source", "tokens").distinct())
    have = sized.groupBy("source").agg(F.sum("tokens").alias("have"), F.count("*").alias("n"))
    plan = [r.asDict() for r in wanted.join(have, "source", "left").collect()]
    able = [r["have"] * r["repeats"] / r["share"] for r in plan if r["have"] and r["share"] > 0 and r["repeats"] > 0]
    size = float(total) if total is not None else min(able, default=0.0)
    budgets = []
    for r in plan:
        have_, budget = r["have"] or 0, min(r["share"] * size, float((r["have"] or 0) * max(0, r["repeats"])))
        full = int(budget // have_) if have_ else 0
        budgets.append((r["source"], full, budget - full * have_, max(0, r["repeats"]), max(1, -(-(r["n"] or 0) // BUCKET_DOCS))))
    spark = docs.sparkSession
    cuts = F.broadcast(spark.createDataFrame(budgets, "source string, full int, rest double, repeats int, buckets int"))

    keyed = sized.join(cuts, "source").withColumn("key", F.xxhash64(F.lit(seed), "doc"))
    keyed = keyed.withColumn("bucket", F.floor((F.col("key").cast("double") / 2.0**64 + 0.5) * F.col("buckets")).cast("int"))
    sums = keyed.groupBy("source", "bucket").agg(F.sum("tokens").alias("s"))
    before = sums.select("source", "bucket", (F.sum("s").over(Window.partitionBy("source").orderBy("bucket")) - F.col("s")).alias("before"))
    order = Window.partitionBy("source", "bucket").orderBy("key", "doc").rowsBetween(Window.unboundedPreceding, 0)
    upto = keyed.withColumn("upto", F.sum("tokens").over(order)).join(before, ["source", "bucket"])
    once_more = F.col("before") + F.col("upto") - F.col("tokens") / 2.0 <= F.col("rest")
    chosen = upto.select("doc", "source", "tokens", F.least(F.col("full") + once_more.cast("int"), "repeats").alias("repeats")).where("repeats > 0")

    reached = chosen.groupBy("source").agg(F.sum(F.col("tokens") * F.col("repeats")).alias("tokens"), F.count("*").alias("documents"), F.max("repeats").alias("most_repeats"))
    all_ = F.sum("tokens").over(Window.partitionBy(F.lit(1)))
    shares = wanted.join(reached, "source", "left").select(
        "source", F.col("share").alias("target_share"), F.coalesce("tokens", F.lit(0)).alias("tokens"), (F.coalesce("tokens", F.lit(0)) / all_).alias("share"),
        F.coalesce("documents", F.lit(0)).alias("documents"), F.coalesce("most_repeats", F.lit(0)).alias("most_repeats"), F.greatest(F.lit(0.0), F.col("share") * size - F.coalesce("tokens", F.lit(0))).alias("short_of"),
    )
    return chosen, shares
