"""The authority tier: names, typed references, their integrity, findings and the policy over them."""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarryline.operators.references import key, latest, names_of

#: Relationship kind, type it must lead to, whether its target may be retired. Callers may pass their own.
EDGE_SPECS = [(f"related_{t}s", t, False) for t in ("requirement", "decision", "roadmap", "prompt", "design")] + [("supersedes", "decision", True)]


def state(artifacts: DataFrame) -> DataFrame:
    """The live artifacts, one row each."""
    rows = latest(artifacts, "id", "updated_at", "repo", "path", "artifact_type", "status", "retired", "confidence", "aliases", "title", "deleted_at")
    return rows.where("deleted_at IS NULL").drop("deleted_at")


def resolution_index(live: DataFrame) -> DataFrame:
    """(name, paths): how many live artifacts answer to a name."""
    return names_of(live).groupBy("name").agg(F.count_distinct("path").alias("paths"))


def duplicate_names(live: DataFrame) -> DataFrame:
    """Names to which several artifacts answer."""
    return resolution_index(live).where("paths > 1")


def outcomes(live: DataFrame, relationships: DataFrame) -> DataFrame:
    """Every declared internal reference with its outcome: resolved, not-found, ambiguous or self-reference, and what it leads to."""
    refs = relationships.where(~F.coalesce("is_external", F.lit(False))).select("rel_key", "source_path", "relationship", "target").distinct()
    refs = refs.withColumn("name", key(F.col("target"))).where("name <> ''")
    index = names_of(live).distinct().groupBy("name").agg(F.count("*").alias("paths"), F.min("path").alias("path"))
    out = refs.join(index, "name", "left")
    outcome = F.when(F.col("paths").isNull(), "not-found").when(F.col("paths") > 1, "ambiguous").when(F.col("path") == F.col("source_path"), "self-reference").otherwise("resolved")
    return out.select("rel_key", "source_path", "relationship", "target", outcome.alias("outcome"), F.when(outcome.isin("resolved", "self-reference"), F.col("path")).alias("resolved"))


def _specs(spark, specs) -> DataFrame:
    return F.broadcast(spark.createDataFrame(specs, "relationship string, wanted string, retired_ok boolean"))


def findings(live: DataFrame, relationships: DataFrame, specs: list = EDGE_SPECS) -> DataFrame:
    """(severity, code, source_path, relationship, target): broken, ambiguous, self, mistyped, retired-target and unknown-kind references."""
    o = outcomes(live, relationships)
    about = live.select(F.col("path").alias("resolved"), F.col("artifact_type").alias("type"), F.coalesce("retired", F.lit(False)).alias("target_retired"))
    source = live.select(F.col("path").alias("source_path"), F.coalesce("retired", F.lit(False)).alias("source_retired"))
    rows = o.join(_specs(live.sparkSession, specs), "relationship", "left").join(about, "resolved", "left").join(source, "source_path", "left")
    ok = F.col("outcome") == "resolved"
    codes = F.array_compact(F.array(
        F.when(~ok, F.struct(F.when(F.col("outcome") == "self-reference", "warning").otherwise("error").alias("severity"), F.concat(F.lit("relationship-"), F.when(F.col("outcome") == "self-reference", F.lit("self-reference")).otherwise(F.concat(F.lit("target-"), "outcome"))).alias("code"))),
        F.when(F.col("wanted").isNull(), F.struct(F.lit("warning").alias("severity"), F.lit("relationship-edge-unsupported").alias("code"))),
        F.when(ok & (F.col("type") != F.col("wanted")), F.struct(F.lit("error").alias("severity"), F.lit("relationship-target-type-mismatch").alias("code"))),
        F.when(ok & F.col("target_retired") & ~F.coalesce("source_retired", F.lit(False)) & ~F.coalesce("retired_ok", F.lit(True)), F.struct(F.lit("warning").alias("severity"), F.lit("relationship-target-superseded").alias("code"))),
    ))
    return rows.select("rel_key", "source_path", "relationship", "target", F.explode(codes).alias("c")).select("c.severity", "c.code", "rel_key", "source_path", "relationship", "target")


def edges(live: DataFrame, relationships: DataFrame) -> DataFrame:
    """(src, dst, kind): resolved references between artifacts, by path."""
    return outcomes(live, relationships).where("outcome = 'resolved'").select(F.col("source_path").alias("src"), F.col("resolved").alias("dst"), F.col("relationship").alias("kind")).distinct()


def inbound(live: DataFrame, relationships: DataFrame) -> DataFrame:
    """(path, kind, n): references that lead to an artifact."""
    return edges(live, relationships).groupBy(F.col("dst").alias("path"), "kind").agg(F.count("*").alias("n"))


def outgoing(live: DataFrame, relationships: DataFrame, most: int = 1000) -> DataFrame:
    """(path, kind, target, rank): the references of an artifact in order, at most ``most`` of them."""
    e = edges(live, relationships)
    return e.select(F.col("src").alias("path"), "kind", F.col("dst").alias("target")).withColumn("rank", F.row_number().over(Window.partitionBy("path").orderBy("kind", "target")).cast("bigint")).where(F.col("rank") <= most)


def summary(live: DataFrame, relationships: DataFrame) -> DataFrame:
    """One row: references, valid and broken ones, artifacts without any reference, share of valid references (1 without references)."""
    o = outcomes(live, relationships).agg(F.count("*").alias("total"), F.count_if(F.col("outcome") == "resolved").alias("valid"))
    e = edges(live, relationships)
    touched = e.select(F.explode(F.array("src", "dst")).alias("path")).distinct()
    orphaned = live.select("path").distinct().join(touched, "path", "left_anti").agg(F.count("*").alias("orphaned"))
    joined = o.withColumn("k", F.lit(1)).join(orphaned.withColumn("k", F.lit(1)), "k").drop("k")
    return joined.select("total", "valid", (F.col("total") - F.col("valid")).alias("broken"), "orphaned", F.when(F.col("total") == 0, 1.0).otherwise(F.round(F.col("valid") / F.col("total"), 4)).alias("coverage"))


def apply_policy(issues: DataFrame, disabled: list[str] = (), blocking: list[str] = (), advisory: list[str] = ()) -> DataFrame:
    """Findings under a policy by code: disabled ones dropped, then blocking ones are errors, then advisory ones warnings."""
    rows = issues.where(~F.col("code").isin(*disabled)) if disabled else issues
    return rows.withColumn("severity", F.when(F.col("code").isin(*blocking), "error").when(F.col("code").isin(*advisory), "warning").otherwise(F.col("severity")))


def gate(issues: DataFrame) -> DataFrame:
    """One row: blocking and advisory findings, and whether none blocks."""
    return issues.agg(F.count_if(F.col("severity") == "error").alias("blocking"), F.count_if(F.col("severity") != "error").alias("advisory")).withColumn("passed", F.col("blocking") == 0)


def introduced(before: DataFrame, after: DataFrame) -> DataFrame:
    """Findings of ``after`` that ``before`` does not have as often."""
    return after.exceptAll(before)


def infer_references(texts: DataFrame, key_column: str, text: str, live: DataFrame) -> DataFrame:
    """(key, path): artifacts whose id stands in a text as a whole word; names of several artifacts are left out."""
    words = F.explode(F.array_distinct(F.regexp_extract_all(F.upper(text), F.lit(r"([A-Z0-9]{2,5}-[0-9A-HJKMNP-TV-Z]{12})"), 1)))
    names = names_of(live).distinct().groupBy("name").agg(F.count("*").alias("n"), F.min("path").alias("path")).where("n = 1")
    found = texts.where(F.col(text).isNotNull()).select(F.col(key_column).alias("key"), words.alias("name")).withColumn("name", F.lower("name"))
    return found.join(names, "name").select("key", "path").distinct()


def classify(sections: DataFrame, specs: list[tuple[str, str, bool]], least: float = 0.5) -> DataFrame:
    """(key, type, fit): the type whose required (1 point) and recommended (half a point) sections a document has best; ties by more
    required ones, then by order of the specs; unknown below ``least`` or without any required section."""
    spark = sections.sparkSession
    order = {t: i for i, t in enumerate(dict.fromkeys(t for t, _, _ in specs))}
    spec = F.broadcast(spark.createDataFrame([(t, s, r, order[t]) for t, s, r in specs], "type string, name string, required boolean, nth int"))
    ceiling = F.broadcast(spark.createDataFrame([(t, sum(1.0 if r else 0.5 for x, _, r in specs if x == t)) for t in order], "type string, ceiling double"))
    points = F.sum(F.when(F.col("required"), 1.0).otherwise(0.5))
    hits = sections.select("key", "name").distinct().join(spec, "name").groupBy("key", "type", "nth").agg(points.alias("points"), F.count_if("required").alias("req")).join(ceiling, "type")
    fit = F.col("points") / F.col("ceiling")
    best = hits.groupBy("key").agg(F.max_by(F.struct("type", fit.alias("fit"), "req"), F.struct(fit, "req", -F.col("nth"))).alias("b"))
    known = (F.col("b.fit") >= least) & (F.col("b.req") > 0)
    return best.select("key", F.when(known, F.col("b.type")).otherwise("unknown").alias("type"), F.round("b.fit", 2).alias("fit"))
