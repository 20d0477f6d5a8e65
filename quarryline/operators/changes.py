"""Change-log analytics: one row per file of a commit in, one row per file, module, author or commit out.

All functions take the result of ``log`` (repo, sha, author, ts, subject, path, added, deleted) and are keyed by repository.
Time is anchored to the newest commit of a repository, never to the clock. Groups are aggregated before any window, so a
window sees one row per file and author at most, never the raw log.
"""

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarryline.operators.ranks import ranked

DAY = 86_400
HALF_LIFE_DAYS = 180
#: Words of a subject that mark a defect being mended. (fixed values)
DEFECT_WORDS = ("fix", "fixes", "fixed", "bug", "bugfix", "hotfix", "revert", "reverts", "patch")
#: Files of a commit above which it says nothing about co-change.
WIDE = 50
FILE = ["repo", "path"]


def plain_path(c: Column) -> Column:
    """Backslashes as slashes, without a leading ``./``."""
    return F.regexp_replace(F.translate(c, "\\", "/"), r"^\./", "")


def author_key(c: Column) -> Column:
    """One spelling per author: lower case, without a mail domain, blanks as dots."""
    return F.regexp_replace(F.split_part(F.lower(F.trim(c)), F.lit("@"), F.lit(1)), r"\s+", ".")


def log(changes: DataFrame) -> DataFrame:
    """The change log without repeats: the row of a file in a commit that was recorded last; counts of binary files are 0."""
    rows = changes.select("repo", "sha", author_key(F.col("author")).alias("author"), "ts", "subject", plain_path(F.col("path")).alias("path"), "added", "deleted", "recorded_at")
    rows = rows.where("repo IS NOT NULL AND sha IS NOT NULL AND path IS NOT NULL")
    last = F.max_by(F.struct("author", "ts", "subject", "added", "deleted"), F.struct("recorded_at", "added", "deleted")).alias("r")
    rows = rows.groupBy("repo", "sha", "path").agg(last)
    return rows.select("repo", "sha", "r.author", "r.ts", "r.subject", "path", F.coalesce("r.added", F.lit(0)).cast("bigint").alias("added"), F.coalesce("r.deleted", F.lit(0)).cast("bigint").alias("deleted"))


def parse_log(text: DataFrame, column: str) -> DataFrame:
    """(sha, author, ts, subject, path, added, deleted) from log text: records after \\x1e, fields after \\x1f, numstat lines below."""
    records = text.select(F.explode(F.split(column, "\x1e")).alias("record")).where(F.trim("record") != "")
    head = F.split(F.split_part("record", F.lit("\n"), F.lit(1)), "\x1f")
    rows = records.select(head[0].alias("sha"), head[1].alias("author"), head[2].cast("bigint").alias("ts"), head[3].alias("subject"), F.explode(F.slice(F.split("record", "\n"), 2, 1_000_000)).alias("line"))
    return parse_numstat(rows.where(F.trim("line") != ""), "line")


def parse_numstat(lines: DataFrame, column: str, suffixes: tuple[str, ...] = ()) -> DataFrame:
    """Adds (path, added, deleted) from ``added<TAB>deleted<TAB>path``; '-' counts as 0; only paths with one of ``suffixes``, if given."""
    part = F.split(column, "\t", 3)
    number = lambda c: F.coalesce(F.try_to_number(c, F.lit("999999999")).cast("bigint"), F.lit(0))
    rows = lines.withColumns({"path": part[2], "added": number(part[0]), "deleted": number(part[1])}).drop(column)
    return rows.where(F.regexp_like("path", F.lit("(" + "|".join(s.replace(".", r"\.") for s in suffixes) + ")$"))) if suffixes else rows


def newest(rows: DataFrame, n: int = 1000) -> DataFrame:
    """The rows of the newest ``n`` commits of every repository; ties by sha."""
    commits = rows.groupBy("repo", "sha").agg(F.max("ts").alias("at"))
    kept = commits.withColumn("rn", F.row_number().over(Window.partitionBy("repo").orderBy(F.desc("at"), "sha"))).where(F.col("rn") <= n)
    return rows.join(kept.select("repo", "sha"), ["repo", "sha"], "left_semi")


def window_info(rows: DataFrame, n: int = 1000) -> DataFrame:
    """(repo, as_of, commits, capped) of the walk over the newest ``n`` commits."""
    commits = rows.groupBy("repo", "sha").agg(F.max("ts").alias("at")).groupBy("repo").agg(F.max("at").alias("as_of"), F.count("*").alias("all"))
    return commits.select("repo", "as_of", F.least("all", F.lit(n)).cast("bigint").alias("commits"), (F.col("all") > n).alias("capped"))


def anchored(rows: DataFrame) -> DataFrame:
    """Adds ``as_of``, the newest time of the repository."""
    return rows.join(rows.groupBy("repo").agg(F.max("ts").alias("as_of")), "repo")


def _within(days: int) -> Column:
    return F.col("ts") >= F.col("as_of") - days * DAY


def windows(rows: DataFrame) -> DataFrame:
    """Commits of a file: all, of the last 30 and 90 days; first and last; age in whole days."""
    out = anchored(rows).groupBy(*FILE).agg(
        F.count("*").alias("commits"), F.count_if(_within(30)).alias("commits_30"), F.count_if(_within(90)).alias("commits_90"),
        F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"), F.max("as_of").alias("as_of"),
    )
    return out.withColumn("age_days", F.floor((F.col("as_of") - F.col("first_ts")) / DAY)).drop("as_of")


def line_churn(rows: DataFrame) -> DataFrame:
    """Lines added and deleted per file."""
    return rows.groupBy(*FILE).agg(F.sum("added").alias("added"), F.sum("deleted").alias("deleted"))


def temporal_hotspot(rows: DataFrame) -> DataFrame:
    """Per file the sum of churn, capped at 3 hundreds a change, halved every 180 days."""
    age = F.greatest(F.lit(0.0), (F.col("as_of") - F.col("ts")) / DAY)
    term = F.exp(-math.log(2) * age / HALF_LIFE_DAYS) * F.least((F.col("added") + F.col("deleted")) / 100.0, F.lit(3.0))
    return anchored(rows).groupBy(*FILE).agg(F.round(F.sum(term), 6).alias("hotspot"))


def _per_author(rows: DataFrame) -> DataFrame:
    return rows.where("author IS NOT NULL").groupBy(*FILE, "author").agg(F.count("*").alias("n"))


def _top(counts: DataFrame, *by: str) -> DataFrame:
    total = F.sum("n").over(Window.partitionBy(*by))
    return counts.withColumns({"rn": F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("n"), "author")), "total": total, "authors": F.count("*").over(Window.partitionBy(*by))}).where("rn = 1")


def ownership(rows: DataFrame) -> DataFrame:
    """Per file: the author of most commits (ties by name), their share, the number of authors, and the owner of the last 90 days."""
    all_ = _top(_per_author(rows), *FILE).select(*FILE, F.col("author").alias("owner"), F.round(F.col("n") / F.col("total"), 6).alias("share"), "authors")
    recent = _top(_per_author(anchored(rows).where(_within(90))), *FILE).select(*FILE, F.col("author").alias("recent_owner"))
    return all_.join(recent, FILE, "left")


def bus_factor(rows: DataFrame, share: float = 0.8) -> DataFrame:
    """Per file: how many of its most active authors made ``share`` of its commits."""
    order = Window.partitionBy(*FILE).orderBy(F.desc("n"), "author")
    run = _per_author(rows).withColumns({"rank": F.row_number().over(order), "sum": F.sum("n").over(order.rowsBetween(Window.unboundedPreceding, 0)), "total": F.sum("n").over(Window.partitionBy(*FILE))})
    return run.where(F.col("sum") >= share * F.col("total")).groupBy(*FILE).agg(F.min("rank").cast("bigint").alias("bus_factor"))


def change_entropy(rows: DataFrame) -> DataFrame:
    """Per file the entropy in bits of how its churn spreads over commits; log2(S) - sum(c log2 c) / S needs no window."""
    c = (F.col("added") + F.col("deleted")).cast("double")
    out = rows.where("added + deleted > 0").groupBy(*FILE).agg(F.sum(c).alias("s"), F.sum(c * F.log2(c)).alias("t"), F.count("*").alias("n"))
    return out.select(*FILE, F.when(F.col("n") < 2, 0.0).otherwise(F.round(F.log2("s") - F.col("t") / F.col("s"), 6)).alias("entropy"))


def prior_defects(rows: DataFrame) -> DataFrame:
    """Per file the commits whose subject has a defect word as a whole word."""
    words = F.split(F.lower("subject"), "[^a-z]+")
    return rows.where(F.arrays_overlap(words, F.array(*map(F.lit, DEFECT_WORDS)))).groupBy(*FILE).agg(F.count("*").alias("defects"))


def co_change(rows: DataFrame, wide: int = WIDE) -> DataFrame:
    """(repo, path, partner, n): unordered pairs of files of commits with at most ``wide`` files, both ways round."""
    few = rows.groupBy("repo", "sha").agg(F.count("*").alias("files")).where(F.col("files").between(2, wide)).select("repo", "sha")
    k = rows.join(few, ["repo", "sha"], "left_semi").select("repo", "sha", "path")
    pairs = k.alias("a").join(k.alias("b"), (F.col("a.repo") == F.col("b.repo")) & (F.col("a.sha") == F.col("b.sha")) & (F.col("a.path") < F.col("b.path")))
    counts = pairs.groupBy(F.col("a.repo").alias("repo"), F.col("a.path").alias("path"), F.col("b.path").alias("partner")).agg(F.count("*").alias("n"))
    return counts.union(counts.select("repo", F.col("partner"), F.col("path"), "n"))


def partners(rows: DataFrame, k: int = 5) -> DataFrame:
    """The ``k`` most frequent partners of every file; ties by path."""
    rank = F.row_number().over(Window.partitionBy(*FILE).orderBy(F.desc("n"), "partner")).cast("bigint")
    return co_change(rows).withColumn("rank", rank).where(F.col("rank") <= k)


def churn_rank(rows: DataFrame) -> DataFrame:
    """Per file: churn percentile in its repository (rank by hotspot, recent commits, path) and whether it is a hotspot."""
    f = temporal_hotspot(rows).join(windows(rows).select(*FILE, "commits", "commits_90"), FILE)
    f = ranked(f, ["repo"], [F.col("hotspot"), F.col("commits_90"), F.desc("path")], "at")
    sizes = f.groupBy("repo").agg(F.count("*").alias("files"))
    f = f.join(sizes, "repo").withColumn("percentile", F.round((F.col("at") - 1) / F.col("files"), 6)).drop("at", "files")
    return f.withColumn("is_hotspot", (F.col("percentile") >= 0.75) & (F.col("commits") >= 5) & (F.col("commits_90") >= 2))


def hotspots(rows: DataFrame) -> DataFrame:
    """The hotspots of every repository, ranked by score, then path."""
    hot = churn_rank(rows).where("is_hotspot").select("repo", "path", "hotspot", "percentile", "commits", "commits_90")
    return ranked(hot, ["repo"], [F.desc("hotspot"), F.col("path")])


def module_of(path: Column) -> Column:
    """The first segment of a path; empty for a file at the root."""
    return F.when(path.contains("/"), F.split_part(path, F.lit("/"), F.lit(1))).otherwise("")


def modules(rows: DataFrame) -> DataFrame:
    """Per top folder: files, hotspots, their density, mean commits, lower median bus factor, owner by commits."""
    f = churn_rank(rows).join(bus_factor(rows), FILE, "left").withColumn("module", module_of(F.col("path")))
    out = f.groupBy("repo", "module").agg(
        F.count("*").alias("files"), F.count_if("is_hotspot").alias("hotspots"), F.round(F.avg("commits"), 6).alias("mean_commits"),
        F.percentile_approx(F.coalesce("bus_factor", F.lit(0)), 0.5, 1_000_000).alias("bus_factor"),
    )
    counts = rows.where("author IS NOT NULL").groupBy("repo", module_of(F.col("path")).alias("module"), "author").agg(F.count("*").alias("n"))
    owner = _top(counts, "repo", "module").select("repo", "module", F.col("author").alias("owner"))
    return out.withColumn("density", F.round(F.col("hotspots") / F.col("files"), 6)).join(owner, ["repo", "module"], "left")


def ownership_at(rows: DataFrame, asked: DataFrame) -> DataFrame:
    """(repo, path, owner, level) for asked paths: of the file, else of its module, else empty."""
    a = asked.select("repo", "path", module_of(F.col("path")).alias("module"))
    f = ownership(rows).select(*FILE, F.col("owner").alias("of_file"))
    counts = rows.where("author IS NOT NULL").groupBy("repo", module_of(F.col("path")).alias("module"), "author").agg(F.count("*").alias("n"))
    m = _top(counts, "repo", "module").select("repo", "module", F.col("author").alias("of_module"))
    out = a.join(f, FILE, "left").join(m, ["repo", "module"], "left")
    level = F.when(F.col("of_file").isNotNull(), "file").when(F.col("of_module").isNotNull(), "module").otherwise("none")
    return out.select("repo", "path", F.coalesce("of_file", "of_module").alias("owner"), level.alias("level"))


def author_experience(rows: DataFrame) -> DataFrame:
    """Per commit the earlier commits of its author in the repository (null for an unknown author)."""
    commits = rows.groupBy("repo", "sha").agg(F.max("author").alias("author"), F.max("ts").alias("ts"))
    earlier = F.count("*").over(Window.partitionBy("repo", "author").orderBy("ts").rangeBetween(Window.unboundedPreceding, -1))
    return commits.select("repo", "sha", F.when(F.col("author").isNotNull(), earlier).alias("experience"))


def last_modified(rows: DataFrame) -> DataFrame:
    """Per file the time of its newest commit."""
    return rows.groupBy(*FILE).agg(F.max("ts").alias("last_ts"), F.max(F.timestamp_seconds("ts").cast("timestamp_ntz")).alias("last_modified"))


# change risk


def features(rows: DataFrame) -> DataFrame:
    """Per commit: lines added and deleted, files, folders, top folders, entropy over files with churn."""
    c = (F.col("added") + F.col("deleted")).cast("double")
    folder = F.when(F.col("path").contains("/"), F.regexp_replace("path", "/[^/]*$", "")).otherwise("")
    top = F.split_part("path", F.lit("/"), F.lit(1))
    some = c > 0
    out = rows.groupBy("repo", "sha").agg(
        F.sum("added").alias("la"), F.sum("deleted").alias("ld"), F.count("*").alias("nf"), F.size(F.collect_set(folder)).cast("bigint").alias("nd"), F.size(F.collect_set(top)).cast("bigint").alias("ns"),
        F.sum(F.when(some, c)).alias("s"), F.sum(F.when(some, c * F.log2(c))).alias("t"), F.count_if(some).alias("k"),
    )
    return out.withColumn("entropy", F.when(F.col("k") < 2, 0.0).otherwise(F.round(F.log2("s") - F.col("t") / F.col("s"), 6))).drop("s", "t", "k")


#: A neutral model: feature, weight, mean, deviation. Callers inject their own constants in the same shape.
NEUTRAL_MODEL = {"intercept": 0.0, "features": {"la": (0.5, 3.0, 1.5), "ld": (0.3, 2.0, 1.5), "nf": (0.4, 1.2, 0.7), "nd": (0.3, 1.0, 0.6), "ns": (0.2, 0.8, 0.4), "entropy": (0.3, 1.0, 0.8), "experience": (-0.4, 3.0, 1.5)}}


def contributions(feats: DataFrame, model: dict = NEUTRAL_MODEL) -> DataFrame:
    """Adds per feature the signed contribution c_<name>; a null feature contributes 0."""
    out = {}
    for name, (weight, mean, deviation) in model["features"].items():
        x = F.col(name).cast("double")
        x = x if name == "entropy" else F.log1p(x)
        out[f"c_{name}"] = F.coalesce(F.lit(weight) * (x - mean) / deviation, F.lit(0.0))
    return feats.withColumns(out)


def risk_score(feats: DataFrame, model: dict = NEUTRAL_MODEL) -> DataFrame:
    """Adds ``score``: ten times the logistic of the summed contributions, to one decimal."""
    c = contributions(feats, model)
    logit = F.lit(model["intercept"])
    for name in model["features"]:
        logit = logit + F.col(f"c_{name}")
    return c.withColumn("score", F.round(10 / (1 + F.exp(-logit)), 1))


def risk_drivers(feats: DataFrame, model: dict = NEUTRAL_MODEL, k: int = 3) -> DataFrame:
    """(repo, sha, driver, contribution, rank): the ``k`` largest contributions of a commit by size."""
    c = contributions(feats, model)
    entries = F.array(*[F.struct(F.lit(n).alias("driver"), F.col(f"c_{n}").alias("contribution")) for n in model["features"]])
    rows = c.select("repo", "sha", F.explode(entries).alias("e")).select("repo", "sha", "e.driver", F.round("e.contribution", 9).alias("contribution"))
    rank = F.row_number().over(Window.partitionBy("repo", "sha").orderBy(F.desc(F.abs("contribution")), "driver")).cast("bigint")
    return rows.withColumn("rank", rank).where(F.col("rank") <= k)


def risk_baseline(rows: DataFrame, model: dict = NEUTRAL_MODEL, n: int = 200) -> DataFrame:
    """Scores of the newest ``n`` commits of every repository, experience unknown."""
    return risk_score(features(newest(rows, n)).withColumn("experience", F.lit(None).cast("bigint")), model).select("repo", "sha", "score")


def risk_percentile(scores: DataFrame, least: int = 20) -> DataFrame:
    """Adds the mid-rank percentile of a score in its repository and its third; null below ``least`` scores.

    Scores have one decimal, so a repository has at most 101 of them; the windows see their counts only.
    """
    counts = scores.groupBy("repo", "score").agg(F.count("*").alias("equal"))
    order = Window.partitionBy("repo").orderBy("score").rowsBetween(Window.unboundedPreceding, 0)
    counts = counts.withColumns({"below": F.sum("equal").over(order) - F.col("equal"), "n": F.sum("equal").over(Window.partitionBy("repo"))})
    p = F.when(F.col("n") >= least, F.round(100.0 * (F.col("below") + 0.5 * F.col("equal")) / F.col("n"), 6))
    third = F.when(p >= 100 * 2 / 3, "elevated").when(p >= 100 / 3, "typical").when(p.isNotNull(), "below typical")
    return scores.join(counts.select("repo", "score", p.alias("percentile"), third.alias("priority")), ["repo", "score"]).select(*scores.columns, "percentile", "priority")


def missing_tests(rows: DataFrame) -> DataFrame:
    """(repo, sha, path): source files of a commit for which the commit has no file by the test conventions of their language."""
    stem, ext = F.regexp_extract("path", r"([^/]*)\.([^./]+)$", 1), F.regexp_extract("path", r"\.([^./]+)$", 1)
    test = F.col("path").rlike(r"_test\.go$|(^|/)test_[^/]*\.py$|_test\.py$|Tests?\.java$|\.(test|spec)\.(ts|tsx|js|jsx)$|(^|/)(tests?|__tests__)/")
    k = rows.select("repo", "sha", "path", stem.alias("stem"), ext.alias("ext"), test.alias("test"))
    names = (
        F.when(F.col("ext") == "go", F.array(F.concat("stem", F.lit("_test.go"))))
        .when(F.col("ext") == "py", F.array(F.concat(F.lit("test_"), "stem", F.lit(".py")), F.concat("stem", F.lit("_test.py"))))
        .when(F.col("ext") == "java", F.array(F.concat("stem", F.lit("Test.java")), F.concat("stem", F.lit("Tests.java"))))
        .when(F.col("ext").isin("ts", "tsx", "js", "jsx"), F.array(F.concat("stem", F.lit(".test."), "ext"), F.concat("stem", F.lit(".spec."), "ext")))
    )
    want = k.where(~F.col("test") & names.isNotNull()).select("repo", "sha", "path", F.explode(names).alias("name"))
    have = k.select("repo", "sha", F.regexp_extract("path", r"([^/]*)$", 1).alias("name"))
    covered = want.join(have, ["repo", "sha", "name"], "left_semi").select("repo", "sha", "path")
    return want.select("repo", "sha", "path").distinct().join(covered, ["repo", "sha", "path"], "left_anti")


def missing_cochanges(rows: DataFrame, least: int = 2, k: int = 5) -> DataFrame:
    """(repo, sha, path, partner, n): partners seen ``least`` times that the newest commit of a repository does not touch; ``k`` a file."""
    target = newest(rows, 1).select("repo", "sha", "path")
    near = target.join(co_change(rows).where(F.col("n") >= least), FILE)
    absent = near.join(target.select("repo", F.col("path").alias("partner")), ["repo", "partner"], "left_anti")
    rank = F.row_number().over(Window.partitionBy("repo", "path").orderBy(F.desc("n"), "partner"))
    return absent.withColumn("rn", rank).where(F.col("rn") <= k).select("repo", "sha", "path", "partner", "n")


def changed_files(paths: DataFrame, column: str, root: str = "") -> DataFrame:
    """(path): given paths made relative to ``root``, those outside dropped, distinct."""
    p = plain_path(F.col(column))
    return paths.where(p.startswith(root)).select(F.substring(p, F.lit(len(root) + 1), F.length(p)).alias("path")).where("path <> ''").distinct()
