"""Graphs as edge tables (src, dst): neighbourhoods, reachability, rank, communities, strong components.

Iterations run as joins on the edges; every round is written to the checkpoint folder, so plans stay short and a lost
executor costs one round. Only single numbers and empty-or-not go to the driver. Self edges and repeated edges do not count.
"""

from itertools import count, takewhile

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarryline.session import cut


def plain(edges: DataFrame) -> DataFrame:
    """Distinct edges without self edges and nulls."""
    return edges.select("src", "dst").where("src IS NOT NULL AND dst IS NOT NULL AND src <> dst").distinct()


def nodes_of(edges: DataFrame) -> DataFrame:
    """(id) of both ends."""
    return edges.select(F.explode(F.array("src", "dst")).alias("id")).distinct()


def degrees(edges: DataFrame) -> DataFrame:
    """(id, outbound, inbound)."""
    ends = edges.select(F.explode(F.array(F.struct(F.col("src").alias("id"), F.lit(1).alias("o"), F.lit(0).alias("i")), F.struct(F.col("dst").alias("id"), F.lit(0).alias("o"), F.lit(1).alias("i")))).alias("e"))
    return ends.groupBy("e.id").agg(F.sum("e.o").alias("outbound"), F.sum("e.i").alias("inbound"))


def reachable(edges: DataFrame, roots: DataFrame, most: int | None = None) -> DataFrame:
    """(id, hops): everything reached from the roots along the edges, with the least number of hops; at most ``most`` hops if given."""
    edges = cut(edges)
    known = level = cut(roots.select("id").distinct().withColumn("hops", F.lit(0)))
    for n in takewhile(lambda n: most is None or n <= most, count(1)):
        found = edges.join(level.select(F.col("id").alias("src")), "src", "left_semi").select(F.col("dst").alias("id")).distinct()
        level = cut(found.join(known, "id", "left_anti").withColumn("hops", F.lit(n)))
        if level.isEmpty():
            break
        known = known.union(level)
        if n % 50 == 0:
            known = cut(known)
    return known


def neighbourhood(edges: DataFrame, roots: DataFrame, depth: int = 2) -> DataFrame:
    """(root, id, hops): what lies within ``depth`` edges of each root, either way; the root itself has 0 hops."""
    both = cut(edges.union(edges.select("dst", "src")).distinct())
    known = level = roots.select(F.col("id").alias("root"), "id").distinct().withColumn("hops", F.lit(0))
    for n in range(1, depth + 1):
        level = level.join(both, level.id == both.src).select("root", F.col("dst").alias("id")).distinct().join(known, ["root", "id"], "left_anti").withColumn("hops", F.lit(n))
        known = cut(known.union(level))
        level = known.where(F.col("hops") == n)
    return known


def pagerank(edges: DataFrame, damping: float = 0.85, rounds: int = 100, tolerance: float = 1e-6) -> DataFrame:
    """(id, rank): power iteration, the mass of dead ends spread evenly; until the change is below ``tolerance`` in sum."""
    nodes = nodes_of(edges)
    out = edges.groupBy("src").agg(F.count("*").alias("out"))
    links = cut(edges.join(out, "src"))
    n = nodes.count()
    if not n:
        return nodes.withColumn("rank", F.lit(0.0))
    ranks = cut(nodes.withColumn("rank", F.lit(1.0 / n)).join(out.select(F.col("src").alias("id"), F.lit(True).alias("alive")), "id", "left"))
    for _ in range(rounds):
        dead = ranks.where("alive IS NULL").agg(F.coalesce(F.sum("rank"), F.lit(0.0))).first()[0]
        flow = links.join(ranks, links.src == ranks.id).groupBy("dst").agg(F.sum(F.col("rank") / F.col("out")).alias("flow"))
        base = (1 - damping) / n + damping * dead / n
        new = ranks.join(flow, ranks.id == flow.dst, "left").select("id", F.col("rank").alias("old"), (F.lit(base) + damping * F.coalesce("flow", F.lit(0.0))).alias("rank"), "alive")
        new = cut(new)
        change = new.agg(F.sum(F.abs(F.col("rank") - F.col("old")))).first()[0]
        ranks = new.select("id", "rank", "alive")
        if change < tolerance:
            break
    return ranks.select("id", "rank")


def communities(edges: DataFrame, rounds: int = 20) -> DataFrame:
    """(id, label): synchronous label propagation with a vote for oneself, the smallest label on ties; stops when nothing changes."""
    both = cut(edges.union(edges.select("dst", "src")).distinct())
    labels = cut(nodes_of(edges).withColumn("label", F.col("id")))
    for _ in range(rounds):
        votes = both.join(labels.withColumnRenamed("id", "src"), "src").select(F.col("dst").alias("id"), "label").union(labels.select("id", "label"))
        counts = votes.groupBy("id", "label").agg(F.count("*").alias("n"))
        best = counts.groupBy("id").agg(F.min(F.struct((-F.col("n")).alias("n"), "label")).alias("b")).select("id", F.col("b.label").alias("new"))
        step = cut(labels.join(best, "id").select("id", F.col("new").alias("label"), (F.col("new") != F.col("label")).alias("moved")))
        labels = step.select("id", "label")
        if step.where("moved").isEmpty():
            break
    return labels


def _least_reaching(edges: DataFrame, colours: DataFrame) -> DataFrame:
    """Spreads the smallest colour along the edges until nothing changes."""
    while True:
        offered = edges.join(colours.withColumnRenamed("id", "src"), "src").groupBy(F.col("dst").alias("id")).agg(F.min("colour").alias("offer"))
        step = cut(colours.join(offered, "id", "left").select("id", F.least("colour", F.coalesce("offer", "colour")).alias("colour"), (F.col("offer") < F.col("colour")).alias("moved")))
        colours = step.select("id", "colour")
        if step.where("moved").isEmpty():
            return colours


def strong_components(edges: DataFrame) -> DataFrame:
    """(id, component): nodes on cycles, by the smallest node of their component. Nodes no cycle can pass are trimmed first, then
    colours are spread forward and the roots' components collected backward."""
    edges = cut(plain(edges))
    found = None
    while True:
        while True:
            size = edges.count()
            edges = cut(edges.join(edges.select(F.col("dst").alias("src")).distinct(), "src", "left_semi").join(edges.select(F.col("src").alias("dst")).distinct(), "dst", "left_semi").select("src", "dst"))
            if edges.count() == size:
                break
        if not size:
            break
        nodes = nodes_of(edges)
        colours = _least_reaching(edges, cut(nodes.withColumn("colour", F.col("id"))))
        a, b = colours.select(F.col("id").alias("src"), F.col("colour").alias("cs")), colours.select(F.col("id").alias("dst"), F.col("colour").alias("cd"))
        inside = cut(edges.join(a, "src").join(b, "dst").where("cs = cd").select("src", "dst", F.col("cs").alias("colour")))
        back = level = cut(colours.where("id = colour"))
        while True:
            step = inside.join(level.select(F.col("id").alias("dst"), "colour"), ["dst", "colour"]).select(F.col("src").alias("id"), "colour").distinct()
            level = cut(step.join(back, ["id", "colour"], "left_anti"))
            if level.isEmpty():
                break
            back = back.union(level)
        back = cut(back)
        found = back if found is None else found.union(back)
        gone = back.select("id")
        edges = cut(edges.join(gone, edges.src == gone.id, "left_anti").join(gone, edges.dst == gone.id, "left_anti"))
    if found is None:
        return nodes_of(edges).withColumn("component", F.col("id")).limit(0)
    sizes = found.groupBy("colour").agg(F.count("*").alias("n")).where("n > 1")
    return found.join(sizes, "colour", "left_semi").select("id", F.col("colour").alias("component"))


def follow(edges: DataFrame, starts: DataFrame) -> DataFrame:
    """(id, last, hops): from each start along its single outgoing edge (the smallest if several) to the end; a cycle ends where it began.

    A start that runs into a cycle it is not on ends at a node of that cycle: where it stood after a power of two steps, when met again.
    """
    one = cut(edges.groupBy("src").agg(F.min("dst").alias("dst")))
    at = cut(starts.select("id", F.col("id").alias("last"), F.lit(0).alias("hops"), F.lit(True).alias("moved"), F.col("id").alias("mark")))
    for n in count(1):
        on = F.col("dst").isNotNull() & (F.col("dst") != F.col("id")) & (F.col("dst") != F.col("mark"))
        last = F.coalesce("dst", "last")
        step = at.where("moved").join(one, F.col("last") == F.col("src"), "left").select("id", last.alias("last"), (F.col("hops") + F.col("dst").isNotNull().cast("int")).alias("hops"), on.alias("moved"), (F.col("mark") if n & (n - 1) else last).alias("mark"))
        at = cut(step.union(at.where("NOT moved")))
        if at.where("moved").isEmpty():
            break
    return at.select("id", "last", "hops")


def neighbourhood_edges(edges: DataFrame, roots: DataFrame, depth: int = 2) -> DataFrame:
    """The distinct edges (src, dst, ...) that a walk of ``depth`` steps from all roots together, either way, goes along."""
    both = cut(edges.select("src", "dst").union(edges.select("dst", "src")).distinct())
    known = roots.select("id").distinct()
    for _ in range(depth - 1):
        known = cut(known.union(both.join(known.select(F.col("id").alias("src")), "src", "left_semi").select(F.col("dst").alias("id"))).distinct())
    a, b = known.select(F.col("id").alias("src")), known.select(F.col("id").alias("dst"))
    return edges.join(a, "src", "left_semi").union(edges.join(b, "dst", "left_semi").select(*edges.columns)).distinct()


#: Bounds of a neighbourhood: nodes of a level, and of all levels, of one root. (fixed values)
FRONTIER, WORK = 1000, 10_000


def bounded_neighbourhood(edges: DataFrame, roots: DataFrame, depth: int = 5, frontier: int = FRONTIER, work: int = WORK) -> DataFrame:
    """(root, id, hops, truncated): as ``neighbourhood``, but at most ``frontier`` nodes a level and ``work`` in all for each root, the
    smallest first; ``truncated`` says whether a root had more. Hubs thus cost a bounded amount, and what was cut is reported."""
    both = cut(edges.select("src", "dst").union(edges.select("dst", "src")).where("src <> dst").distinct())
    known = cut(roots.select(F.col("id").alias("root"), "id").distinct().withColumns({"hops": F.lit(0), "more": F.lit(False)}))
    for n in range(1, depth + 1):
        level = known.where((F.col("hops") == n - 1) & ~F.col("more"))
        found = level.join(both, level.id == both.src).select("root", F.col("dst").alias("id")).distinct().join(known.select("root", "id"), ["root", "id"], "left_anti")
        used = known.groupBy("root").agg(F.count("*").alias("used"))
        ranked = found.withColumn("at", F.row_number().over(Window.partitionBy("root").orderBy("id"))).where(F.col("at") <= frontier + 1).join(used, "root")
        room = F.least(F.lit(frontier), F.lit(work) - F.col("used"))
        known = cut(known.union(ranked.where(F.col("at") <= room + 1).select("root", "id", F.lit(n).alias("hops"), (F.col("at") > room).alias("more"))))
    cut_ = known.groupBy("root").agg(F.bool_or("more").alias("truncated"))
    return known.where("NOT more").drop("more").join(cut_, "root")
