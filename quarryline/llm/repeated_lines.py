"""Lines repeated across the documents of one source: found by mergeable heavy-hitter summaries, verified, removed.

Pass 1: per source a Misra-Gries summary of line hashes (a document counts a line once), built in every task, merged over
two levels. A summary carries its error: no count is short by more than that. It keeps enough counters for the wanted
share at the lines a document has on average, so the error stays well below the threshold; a source whose error does
not (many copies of few documents, say) is marked, and all its lines are counted. Pass 2: exact counts of the
candidates. Pass 3: removal.

Only summaries, candidate hashes and matching lines are shuffled, never documents. Candidates and confirmed lines are
broadcast only if they are counted to be few; otherwise they are joined.

Defined results. Null texts have no lines but their document counts. A null source is no source; a null document key is
left out. Repeated rows count once. Empty tables give empty results. Further columns are not read by ``repeated``;
``without_lines`` keeps them all.
"""

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarryline.session import cut

#: Rows of candidates or confirmed lines that are broadcast at most.
BROADCAST_ROWS = 500_000
#: Bytes of confirmed lines that are broadcast at most.
BROADCAST_BYTES = 64_000_000
#: A summary has so many times the counters that its error would need to reach the threshold.
SLACK = 8
#: Summaries of one source are first merged in so many groups.
GROUPS = 16

#: Counters of all sources at which a task passes its summaries on.
FLUSH = 1_000_000

_SUMMARY = "source string, part int, hashes array<bigint>, counts array<bigint>, docs bigint, lines bigint, error bigint"
_ARROW = pa.schema([("source", pa.string()), ("part", pa.int32()), ("hashes", pa.list_(pa.int64())), ("counts", pa.list_(pa.int64())), ("docs", pa.int64()), ("lines", pa.int64()), ("error", pa.int64())])


class Summary:
    """A Misra-Gries summary whose number of counters follows the lines per document."""

    __slots__ = ("counts", "docs", "lines", "error", "share", "slack")

    def __init__(self, share: float, slack: float = SLACK):
        self.counts, self.docs, self.lines, self.error, self.share, self.slack = Counter(), 0, 0, 0, share, slack

    def add(self, hashes: list[int]) -> None:
        self.docs += 1
        self.lines += len(hashes)
        self.counts.update(hashes)

    def merge(self, hashes: list[int], counts: list[int], docs: int, lines: int, error: int) -> None:
        self.docs += docs
        self.lines += lines
        self.error += error
        held = self.counts
        for h, n in zip(hashes, counts):
            held[h] += n

    def room(self) -> int:
        return max(64 if self.slack else 1, int(self.slack * self.lines / (max(1, self.docs) * self.share)) + 1)

    def shrink(self, spare: int = 1) -> None:
        """Back to the counters there is room for, once there are ``spare`` times as many."""
        room = self.room()
        if len(self.counts) > spare * room:
            less = sorted(self.counts.values(), reverse=True)[room]
            self.error += less
            self.counts = Counter({h: n - less for h, n in self.counts.items() if n > less})


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = zip(*rows) if rows else [[] for _ in _ARROW]
    return pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(columns, _ARROW)], schema=_ARROW)


def _summarise(share: float, slack: float, flush: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by: dict[str, Summary] = {}
        part = 0

        def out() -> Iterator[pa.RecordBatch]:
            for s in by.values():
                s.shrink()
            rows = [(k, part % GROUPS, list(s.counts), list(s.counts.values()), s.docs, s.lines, s.error) for k, s in by.items()]
            by.clear()
            for i in range(0, len(rows), 1000):
                yield _batch(rows[i : i + 1000])

        for batch in batches:
            for source, hashes, p in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                s = by.get(source)
                if s is None:
                    s = by[source] = Summary(share, slack)
                s.add(hashes)
                part = p
            for s in by.values():
                s.shrink(2)
            if sum(len(s.counts) for s in by.values()) > flush:
                yield from out()
        yield from out()

    return run


def _merge(share: float, slack: float, level: int):
    """Merges the summaries of one source, and of one part of them at the first level; they arrive in a row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, s = None, None

        def row() -> tuple:
            s.shrink()
            return (at[0], at[1], list(s.counts), list(s.counts.values()), s.docs, s.lines, s.error)

        for batch in batches:
            done = []
            for source, part, *rest in zip(*(c.to_pylist() for c in batch.columns)):
                here = (source, part if level == 1 else 0)
                if here != at:
                    if at is not None:
                        done.append(row())
                    at, s = here, Summary(share, slack)
                s.merge(*rest)
                s.shrink(2)
            yield _batch(done)
        if at is not None:
            yield _batch([row()])

    return run


def normal(text: Column) -> Column:
    """Lower case, each run of blanks, tabs and carriage returns as one blank, each run of digits as one ``#``."""
    return F.regexp_replace(F.regexp_replace(F.lower(text), r"[ \t\r]+", " "), "[0-9]+", "#")


def _lines(text: Column, least: int) -> Column:
    """The distinct normal lines of a text of ``least`` characters or more."""
    lines = F.transform(F.split(normal(text), "\n", -1), lambda x: F.trim(x))
    return F.array_distinct(F.filter(lines, lambda x: F.char_length(x) >= least))


def few(df: DataFrame) -> bool:
    """Whether a written table has at most BROADCAST_ROWS rows."""
    return df.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS


def _maybe_broadcast(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if few(df) else df


def repeated(df: DataFrame, source: str, doc: str, text: str, least_docs: int = 4, share: float = 0.05, least: int = 20, slack: float = SLACK, flush: int = FLUSH) -> DataFrame:
    """(source, line, docs, of): lines in at least ``least_docs`` and ``share`` of the ``of`` documents of their source."""
    rows = df.select(F.col(source).alias("source"), F.col(doc).alias("doc"), F.col(text).alias("text")).where("source IS NOT NULL AND doc IS NOT NULL")
    sizes = rows.select("source", "doc").distinct().groupBy("source").agg(F.count("*").alias("of"))
    lines = rows.where("text IS NOT NULL").select("source", "doc", _lines(F.col("text"), least).alias("lines"))
    hashed = lines.select("source", F.transform("lines", lambda x: F.xxhash64(x)).alias("hashes"), F.spark_partition_id().alias("part"))
    partial = hashed.mapInArrow(_summarise(share, slack, flush), _SUMMARY)
    partial = partial.repartition("source", "part").sortWithinPartitions("source", "part").mapInArrow(_merge(share, slack, 1), _SUMMARY)
    merged = partial.repartition("source").sortWithinPartitions("source").mapInArrow(_merge(share, slack, 2), _SUMMARY)

    wanted = F.greatest(F.lit(least_docs), F.col("of") * share)
    known = cut(merged.drop("part", "docs", "lines").join(sizes, "source"))
    entry = F.explode(F.arrays_zip("hashes", "counts")).alias("x")
    candidates = cut(known.select("source", "of", "error", entry).where(F.col("x.counts") + F.col("error") >= wanted).select("source", F.col("x.hashes").alias("hash")))
    vague = known.where(F.col("error") >= wanted).select("source")

    each = lines.select("source", "doc", F.explode("lines").alias("line")).withColumn("hash", F.xxhash64("line"))
    found = each.join(_maybe_broadcast(candidates), ["source", "hash"], "left_semi").drop("hash")
    if not vague.isEmpty():
        found = found.union(each.join(vague, "source", "left_semi").drop("hash"))
    counts = found.distinct().groupBy("source", "line").agg(F.count("*").alias("docs"))
    return counts.join(known.select("source", "of"), "source").where(F.col("docs") >= wanted)


def without_lines(df: DataFrame, lines: DataFrame, source: str, text: str, out: str) -> DataFrame:
    """``df`` with ``out``: the text without the lines that ``lines`` (source, line) has for its source; other lines stay as they are.

    Lines are compared as texts. A source has at most the lines of a document over the wanted share of confirmed lines. While all
    of them are counted to be at most BROADCAST_BYTES they are broadcast. Otherwise the lines of the documents are joined by
    (source, line), which no source skews, and the places found are joined back by the digest of the document.
    """
    known = cut(lines.select("source", "line").distinct())
    rows = df.select(F.struct("*").alias("row"), F.col(source).alias("source"), F.col(text).alias("text"))
    split = F.split("text", "\n", -1)
    if (known.agg(F.sum(F.octet_length("line") + 16)).first()[0] or 0) <= BROADCAST_BYTES:
        sets = known.groupBy("source").agg(F.collect_list("line").alias("gone"))
        joined = rows.join(F.broadcast(sets), "source", "left")
        kept = F.filter(split, lambda x: ~F.array_contains("gone", F.trim(normal(x))))
        cleaned = joined.select("row", F.when(F.col("gone").isNull(), F.col("text")).otherwise(F.array_join(kept, "\n")).alias("cleaned"))
    else:
        keyed = rows.withColumn("digest", F.md5("text"))
        each = keyed.where("text IS NOT NULL").select("source", "digest", F.posexplode(split).alias("pos", "raw")).select("source", "digest", "pos", F.trim(normal(F.col("raw"))).alias("line"))
        found = each.join(known, ["source", "line"], "left_semi").groupBy("source", "digest").agg(F.collect_set("pos").alias("gone"))
        joined = keyed.join(found, ["source", "digest"], "left")
        kept = F.filter(split, lambda x, i: ~F.array_contains("gone", i))
        cleaned = joined.select("row", F.when(F.col("gone").isNull(), F.col("text")).otherwise(F.array_join(kept, "\n")).alias("cleaned"))
    return cleaned.select(*[F.col("row")[c].alias(c) for c in df.columns if c != out], F.col("cleaned").alias(out))
