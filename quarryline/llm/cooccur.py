"""Items that appear together in one basket, by stripes.

Per item an associative array of its co-occurring neighbours is aggregated; arrays of one item are merged by key. Counts
are exact. The log-likelihood ratio then says how far a pair is from chance.

Shape of the plan: (1) distinct (group, basket, item) as three 64-bit hashes, 24 bytes a row; (2) at most ``most`` + 1
items of a basket, limited before the shuffle, so a basket of any width costs a bounded amount; (3) stripes built and
combined within each task, flushed by size; (4) one shuffle of partial stripes by (group, item, part of the neighbour
space), merged as a stream over sorted rows, so a hot item is spread and holds one part of its neighbours in memory;
(5) names are joined to the pairs that are left.

Hashes are compared within a group only: n items of one group collide with probability n^2 / 2^65.

Defined results. Rows with a null group, basket or item are left out. Repeated rows count once. Baskets of more than
``most`` items are left out everywhere. Empty tables give empty results. Further columns are not read.
"""

from collections import Counter, defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarryline.session import cut

#: Entries of a task's stripes at which it passes them on.
FLUSH = 1_000_000
#: Parts into which the neighbours of an item are split.
PARTS = 4

_STRIPE = "g bigint, a bigint, part int, bs array<bigint>, ns array<bigint>"
_ARROW = pa.schema([("g", pa.int64()), ("a", pa.int64()), ("part", pa.int32()), ("bs", pa.list_(pa.int64())), ("ns", pa.list_(pa.int64()))])
_MERGED = pa.schema([("g", pa.int64()), ("a", pa.int64()), ("b", pa.int64()), ("n", pa.int64())])


def _stripes(flush: int):
    """Builds partial stripes of the baskets; a stripe also holds its own item. Part -1 counts the baskets of a group."""

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stripes: dict[tuple[int, int], Counter] = defaultdict(Counter)
        baskets: Counter = Counter()
        entries = 0

        def out() -> Iterator[pa.RecordBatch]:
            rows = []
            for (g, a), stripe in stripes.items():
                parts = defaultdict(list)
                for b in stripe:
                    parts[b % PARTS].append(b)
                rows += [(g, a, p, bs, [stripe[b] for b in bs]) for p, bs in parts.items()]
            rows += [(g, 0, -1, [0], [n]) for g, n in baskets.items()]
            stripes.clear()
            baskets.clear()
            for i in range(0, len(rows), 20_000):
                yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows[i : i + 20_000]), _ARROW)], schema=_ARROW)

        for batch in batches:
            for g, items in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                baskets[g] += 1
                entries += len(items) * (len(items) + 1) // 2
                for i, a in enumerate(items):
                    stripes[g, a].update(items[i:])
            if entries > flush:
                entries = 0
                yield from out()
        yield from out()

    return build


def _merge(least: int):
    """Merges the stripes of one (g, a, part), which arrive in a row; keeps counts of ``least`` or more."""

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, total, done = None, Counter(), ([], [], [], [])

        def close() -> None:
            if at is None:
                return
            g, a, part = at
            for b, n in total.items():
                if n >= least or part < 0:
                    for column, v in zip(done, (g, None if part < 0 else a, b, n)):
                        column.append(v)

        for batch in batches:
            for g, a, part, bs, ns in zip(*(c.to_pylist() for c in batch.columns)):
                if (g, a, part) != at:
                    close()
                    at, total = (g, a, part), Counter(dict(zip(bs, ns)))
                else:
                    for b, n in zip(bs, ns):
                        total[b] += n
            if len(done[0]) > 50_000:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in done], schema=_MERGED)
                done = ([], [], [], [])
        close()
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in done], schema=_MERGED)

    return merge


def llr(k11: Column, a: Column, b: Column, n: Column) -> Column:
    """Dunning's log-likelihood ratio of a pair seen ``k11`` times, its items ``a`` and ``b`` times, in ``n`` baskets."""

    def cell(k: Column, row: Column, column: Column) -> Column:
        return F.when(k > 0, k * F.log(k * n / (row * column))).otherwise(0.0)

    return 2 * (cell(k11, a, b) + cell(a - k11, a, n - b) + cell(b - k11, n - a, b) + cell(n - a - b + k11, n - a, n - b))


def cooccurrence(df: DataFrame, group: str, basket: str, item: Column, most: int = 50, least: int = 5, flush: int = FLUSH) -> DataFrame:
    """(group, item_a, item_b, n_ab, n_a, n_b, n, lift, llr) of every pair of items seen together ``least`` times or more.

    item_a < item_b by bytes; n is the number of baskets of the group with at most ``most`` distinct items.
    """
    rows = df.select(F.col(group).alias("group"), F.col(basket).alias("basket"), item.alias("item")).dropna()
    g, i = F.xxhash64("group").alias("g"), F.xxhash64("item").alias("i")
    distinct = rows.select(g, F.xxhash64("basket").alias("k"), i).distinct()
    few = distinct.withColumn("nth", F.row_number().over(Window.partitionBy("g", "k").orderBy("i"))).where(F.col("nth") <= most + 1)
    baskets = few.groupBy("g", "k").agg(F.array_sort(F.collect_list("i")).alias("items")).where(F.size("items") <= most)
    partial = baskets.select("g", "items").mapInArrow(_stripes(flush), _STRIPE)
    merged = cut(partial.repartition("g", "a", "part").sortWithinPartitions("g", "a", "part").mapInArrow(_merge(least), "g bigint, a bigint, b bigint, n bigint"))

    names = rows.select("group", "item").distinct().select(g, i, "group", "item")
    alone = merged.where("a = b").join(names.withColumnRenamed("i", "a"), ["g", "a"]).select("g", "a", F.col("n").alias("n_a"), "group", "item")
    whole = merged.where("a IS NULL").select("g", F.col("n").alias("n"))
    pairs = merged.where("a <> b").select("g", "a", "b", F.col("n").alias("n_ab"))
    other = alone.select("g", F.col("a").alias("b"), F.col("n_a").alias("n_b"), F.col("item").alias("item_b"))
    all_ = pairs.join(alone, ["g", "a"]).join(other, ["g", "b"]).join(whole, "g")
    swap = F.col("item") > F.col("item_b")
    pick = lambda x, y: F.when(swap, F.col(y)).otherwise(F.col(x))
    all_ = all_.select("group", pick("item", "item_b").alias("item_a"), pick("item_b", "item").alias("item_b"), "n_ab", pick("n_a", "n_b").alias("n_a"), pick("n_b", "n_a").alias("n_b"), "n")
    n_ab, n_a, n_b, n = (F.col(c) for c in ("n_ab", "n_a", "n_b", "n"))
    return all_.withColumn("lift", n_ab * n / (n_a * n_b)).withColumn("llr", llr(n_ab, n_a, n_b, n))
