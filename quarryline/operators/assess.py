"""Verdicts composed of findings: the change gate, the risk report, governance markers, and the score of a file with its parts.

Tables of constants (weights, categories, caps) are arguments, neutral by default, and of the size of a specification.
"""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarryline.operators import changes as C
from quarryline.operators.code import CAP, DEDUCTIONS


def gate_findings(governed: DataFrame, drifted: DataFrame) -> DataFrame:
    """(path, code, severity, message) of a change: documents that govern a changed file (document, file), and cited symbols that are
    gone (key, id). Warnings, distinct; the order is that of the columns."""
    a = governed.select(F.col("file").alias("path"), F.lit("governed-file-changed").alias("code"), F.lit("warning").alias("severity"), F.concat(F.lit("governed by "), F.col("document").cast("string")).alias("message"))
    path = F.regexp_extract("id", r"^[^:]*:(.*)#", 1)
    b = drifted.select(path.alias("path"), F.lit("cited-symbol-missing"), F.lit("warning"), F.concat("id", F.lit(" is cited by "), F.col("key").cast("string")))
    return a.union(b).distinct()


def change_set(rows: DataFrame, mode: str, sha: str | None = None, since: int | None = None, until: int | None = None, files: DataFrame | None = None) -> DataFrame:
    """(repo, path, added, deleted, counted): what a change touches. Modes: 'commit' (one sha, the newest of each repository without),
    'range' (after ``since`` up to ``until``), 'since', 'files' (given (repo, path), without counts)."""
    if mode == "files":
        none = F.lit(None).cast("bigint")
        return files.select("repo", "path").distinct().select("repo", "path", none.alias("added"), none.alias("deleted"), F.lit(False).alias("counted"))
    if mode == "commit":
        some = rows.where(F.col("sha") == sha) if sha else C.newest(rows, 1)
    elif mode in ("range", "since"):
        some = rows.where(F.col("ts") > (since or 0))
        some = some.where(F.col("ts") <= until) if mode == "range" else some
    else:
        raise ValueError(f"no such mode: {mode}")
    return some.groupBy("repo", "path").agg(F.sum("added").alias("added"), F.sum("deleted").alias("deleted")).withColumn("counted", F.lit(True))


def risk_report(scored: DataFrame, tests: DataFrame, partners: DataFrame, broken: DataFrame | None = None, governing: DataFrame | None = None) -> DataFrame:
    """(repo, path, code, severity, message): the directives of a change, and a headline for each repository.

    scored (repo, sha, score, percentile, priority), tests (repo, path), partners (repo, path, partner, n), broken (repo, name, file),
    governing (repo, document, file).
    """
    head = F.concat(F.lit("risk "), F.format_string("%.1f", "score"), F.when(F.col("percentile").isNotNull(), F.concat(F.lit(", percentile "), F.format_string("%.0f", "percentile"), F.lit(" ("), F.col("priority"), F.lit(")"))).otherwise(F.lit(", no baseline")))
    out = scored.select("repo", F.lit("").alias("path"), F.lit("change-risk").alias("code"), F.lit("info").alias("severity"), head.alias("message"))
    out = out.union(tests.select("repo", "path", F.lit("missing-test"), F.lit("warning"), F.lit("changed without a test")))
    out = out.union(partners.select("repo", "path", F.lit("missing-co-change"), F.lit("warning"), F.concat(F.lit("usually changes with "), "partner", F.lit(" ("), F.col("n").cast("string"), F.lit(" times)"))))
    if broken is not None:
        out = out.union(broken.select("repo", F.col("file").alias("path"), F.lit("will-break"), F.lit("warning"), F.concat(F.lit("refers to "), "name")))
    if governing is not None:
        out = out.union(governing.select("repo", F.col("file").alias("path"), F.lit("governed-change"), F.lit("warning"), F.concat(F.lit("governed by "), F.col("document").cast("string"))))
    return out.distinct()


def governance_markers(files: DataFrame, governed: DataFrame) -> DataFrame:
    """(repo, path, marker): hotspots that nothing governs, and governed files with 5 changes or more in 90 days. files is
    (repo, path, is_hotspot, commits_90), governed (repo, path)."""
    f = files.join(governed.select("repo", "path", F.lit(True).alias("governed")).distinct(), ["repo", "path"], "left")
    marks = F.array_compact(F.array(F.when(F.col("is_hotspot") & F.col("governed").isNull(), "ungoverned_hotspot"), F.when(F.col("governed") & (F.col("commits_90") >= 5), "stale_governance")))
    return f.select("repo", "path", F.explode(marks).alias("marker"))


def contradictions(edges: DataFrame, states: DataFrame) -> DataFrame:
    """(source, target): artifacts that supersede one which has a status other than superseded. edges (src, dst, kind), states (path, status)."""
    target = states.select(F.col("path").alias("dst"), "status")
    bad = F.col("status").isNotNull() & (F.trim("status") != "") & (F.lower(F.trim("status")) != "superseded")
    return edges.where("kind = 'supersedes'").join(target, "dst").where(bad).select(F.col("src").alias("source"), F.col("dst").alias("target")).distinct()


#: Neutral table of the score: marker, dimension, weight, category. Markers that are not listed count for ``defect`` with weight 1.
NEUTRAL = [
    ("large_method", "maintainability", 1.0, "size"), ("large_method", "defect", 1.0, "size"), ("complex_method", "defect", 1.0, "complexity"), ("nested_complexity", "defect", 1.0, "complexity"),
    ("brain_method", "maintainability", 1.0, "complexity"), ("brain_method", "defect", 1.0, "complexity"), ("god_file", "maintainability", 1.0, "size"), ("dry_violation", "maintainability", 1.0, "duplication"),
]


def impacts(findings: DataFrame, table: list[tuple[str, str, float, str]] = NEUTRAL, caps: dict[tuple[str, str], float] | None = None, deductions: dict = DEDUCTIONS, cap: float = CAP) -> DataFrame:
    """The findings by dimension with ``impact``: what each takes off. Findings of one category of a dimension share its cap in
    proportion. findings is (repo, file, marker, severity, ...), with ``deduction`` in place of the severity's where it is there."""
    spark = findings.sparkSession
    known = F.broadcast(spark.createDataFrame(table or [("", "", 0.0, "")], "marker string, dimension string, weight double, category string"))
    limits = F.broadcast(spark.createDataFrame([(d, c, v) for (d, c), v in (caps or {("", ""): cap}).items()], "dimension string, category string, cap double"))
    base = F.coalesce(*[F.when(F.col("severity") == s, F.lit(v)) for s, v in deductions.items()], F.lit(0.0))
    if "deduction" in findings.columns:
        base = F.coalesce(F.col("deduction").cast("double"), base)
    rows = findings.withColumn("base", base).join(known, "marker", "left")
    rows = rows.withColumns({"dimension": F.coalesce("dimension", F.lit("defect")), "category": F.coalesce("category", F.lit("size")), "cost": F.col("base") * F.coalesce("weight", F.lit(1.0))})
    sums = rows.groupBy("repo", "file", "dimension", "category").agg(F.sum("cost").alias("sum")).join(limits, ["dimension", "category"], "left")
    share = F.when(F.col("sum") > F.coalesce("cap", F.lit(cap)), F.coalesce("cap", F.lit(cap)) / F.col("sum")).otherwise(1.0)
    return rows.join(sums.select("repo", "file", "dimension", "category", share.alias("share")), ["repo", "file", "dimension", "category"]).withColumn("impact", F.round(F.col("cost") * F.col("share"), 6)).drop("base", "weight", "cost", "share")


def dimension_scores(impacts_: DataFrame, files: DataFrame) -> DataFrame:
    """(repo, file, dimension, score): 10 minus the impacts, within 1 and 10, for every file and dimension."""
    dims = F.explode(F.array(*map(F.lit, ("defect", "maintainability", "performance")))).alias("dimension")
    sums = impacts_.groupBy("repo", "file", "dimension").agg(F.sum("impact").alias("cost"))
    each = files.select("repo", "file").distinct().select("repo", "file", dims).join(sums, ["repo", "file", "dimension"], "left")
    return each.select("repo", "file", "dimension", F.round(F.greatest(F.lit(1.0), F.least(F.lit(10.0), 10 - F.coalesce("cost", F.lit(0.0)))), 2).alias("score"))


#: What to do about a marker. (fixed values)
SUGGESTIONS = {
    "large_method": "split the function", "complex_method": "reduce the branches", "nested_complexity": "return early", "brain_method": "split the function by task", "god_file": "split the file",
    "dry_violation": "share the repeated part", "churn_risk": "stabilise the interface", "ownership_risk": "name an owner", "knowledge_loss": "share the knowledge", "untested_hotspot": "add tests",
    "ungoverned_hotspot": "record the decision", "stale_governance": "review the decision",
}


def ordered(impacts_: DataFrame, k: int = 20) -> DataFrame:
    """(repo, file, marker, line, impact, rank, suggestion): the ``k`` largest impacts on ``defect`` of every file; ties by marker and line."""
    line = F.col("line") if "line" in impacts_.columns else F.lit(None).cast("int")
    rows = impacts_.where("dimension = 'defect'").select("repo", "file", "marker", line.alias("line"), "impact")
    rank = F.row_number().over(Window.partitionBy("repo", "file").orderBy(F.desc("impact"), "marker", "line")).cast("bigint")
    labels = F.create_map(*[F.lit(x) for pair in SUGGESTIONS.items() for x in pair])
    return rows.withColumn("rank", rank).where(F.col("rank") <= k).withColumn("suggestion", F.get(F.map_values(F.map_filter(labels, lambda a, b: a == F.col("marker"))), F.lit(0)))


def context_of(files: DataFrame, symbols: DataFrame, history: DataFrame, coverage: DataFrame | None = None, governed: DataFrame | None = None) -> DataFrame:
    """One row a file with all that markers need: definitions at the top, code lines (1 at least), change history, coverage, governed."""
    defs = symbols.where("kind = 'def'").groupBy("repo", "file").agg(F.count_if(F.col("parent").isNull()).alias("top_level"), F.sum(F.coalesce("nloc", F.lit(0))).alias("nloc"))
    out = files.select("repo", "file").distinct().join(defs, ["repo", "file"], "left").join(history.withColumnRenamed("path", "file"), ["repo", "file"], "left")
    out = out.join(coverage.select("repo", F.col("path").alias("file"), "rate"), ["repo", "file"], "left") if coverage is not None else out.withColumn("rate", F.lit(None).cast("double"))
    out = out.join(governed.select("repo", F.col("path").alias("file"), F.lit(True).alias("governed")).distinct(), ["repo", "file"], "left") if governed is not None else out.withColumn("governed", F.lit(False))
    return out.withColumns({"top_level": F.coalesce("top_level", F.lit(0)), "nloc": F.greatest(F.lit(1), F.coalesce("nloc", F.lit(1))), "governed": F.coalesce("governed", F.lit(False)), "is_hotspot": F.coalesce("is_hotspot", F.lit(False))})


def co_change_scatter(pairs: DataFrame, least: int = 3, partners: int = 5) -> DataFrame:
    """(repo, path, marker): files with ``partners`` or more partners seen ``least`` times. pairs is (repo, path, partner, n)."""
    n = pairs.where(F.col("n") >= least).groupBy("repo", "path").agg(F.count("*").alias("k"))
    return n.where(F.col("k") >= partners).select("repo", "path", F.lit("co_change_scatter").alias("marker"))


def hidden_coupling(pairs: DataFrame, edges: DataFrame, least: int = 5) -> DataFrame:
    """(repo, path, marker): files that change ``least`` times with one they have no edge with, either way. edges is (repo, src_file, dst_file)."""
    linked = edges.select("repo", F.col("src_file").alias("path"), F.col("dst_file").alias("partner")).union(edges.select("repo", "dst_file", "src_file")).distinct()
    return pairs.where(F.col("n") >= least).join(linked, ["repo", "path", "partner"], "left_anti").select("repo", "path", F.lit("hidden_coupling").alias("marker")).distinct()


# what is declared in texts


def status_of(sections: DataFrame) -> DataFrame:
    """(key, status): the first word of the first line with text under ``status``, in lower case, without punctuation around it."""
    word = F.lower(F.regexp_replace(F.regexp_extract("body", r"^\s*(\S+)", 1), r"^[\p{Punct}]+|[\p{Punct}]+$", ""))
    return sections.where("name = 'status'").groupBy("key").agg(F.max_by("body", "pos").alias("body")).select("key", F.nullif(word, F.lit("")).alias("status"))


def declared_references(sections: DataFrame, kinds: list[str]) -> DataFrame:
    """(key, kind, target): one for every line with text under a section that names a kind of reference, list marks dropped."""
    rows = sections.withColumn("kind", F.regexp_replace("name", r"[\s\-]+", "_")).where(F.col("kind").isin(*kinds))
    line = F.trim(F.regexp_replace(F.trim("line"), r"^(?:[-*+]|\d+[.)])\s+", ""))
    return rows.select("key", "kind", F.explode(F.split("body", "\n")).alias("line")).select("key", "kind", line.alias("target")).where("target <> ''")


#: Forms of ticket names. (fixed values)
TICKETS = (r"[A-Z][A-Z0-9]+-\d+", r"#\d+", r"[\w.\-]+/[\w.\-]+#\d+", r"https?://\S+")


def ticket_lint(refs: DataFrame, column: str, forms: tuple[str, ...] = TICKETS) -> DataFrame:
    """The rows whose ticket has none of the forms."""
    return refs.where(F.col(column).isNotNull() & (F.trim(column) != "") & ~F.trim(column).rlike("^(?:" + "|".join(forms) + ")$"))


def dispatch(kinds: DataFrame, rules: dict[str, DataFrame], default: str) -> DataFrame:
    """The findings (key, ...) of the rules that belong to each document's type; those of ``default`` for types without rules of their
    own. kinds is (key, type)."""
    kind = F.when(F.col("type").isin(*rules), F.col("type")).otherwise(default)
    of = kinds.select("key", kind.alias("type"))
    out = None
    for name, findings in rules.items():
        one = findings.join(of.where(F.col("type") == name).select("key"), "key", "left_semi")
        out = one if out is None else out.unionByName(one, allowMissingColumns=True)
    return out


def merge_gates(*gates: DataFrame) -> DataFrame:
    """One row: the counts of several gates added up, passed if all are."""
    out = gates[0]
    for g in gates[1:]:
        out = out.unionByName(g)
    return out.agg(F.coalesce(F.sum("blocking"), F.lit(0)).alias("blocking"), F.coalesce(F.sum("advisory"), F.lit(0)).alias("advisory")).withColumn("passed", F.col("blocking") == 0)

