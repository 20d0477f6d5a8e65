"""Which authority documents govern changed files, markers that need history or coverage, section rules, identities."""

import re
import secrets

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarryline.operators import graph as G

#: Letters of identities: digits and upper case without I, L, O, U. (fixed value)
ALPHABET = "0123456789ABCDEFGHJKMNPQRSTVWXYZ"


def mint(prefix: str, entropy: int | None = None) -> str:
    """A new identity: prefix, hyphen, twelve letters from 60 bits."""
    n = secrets.randbits(60) if entropy is None else entropy
    return prefix + "-" + "".join(ALPHABET[n >> 5 * k & 31] for k in range(11, -1, -1))


def identity_of(frontmatter_id: str | None, path: str) -> str:
    """The id of a document: its own, else the prefix of its file name such as ``adr-002``, else the stem."""
    stem = re.sub(r"\.[^.]*$", "", path.rsplit("/", 1)[-1])
    m = re.match(r"^([A-Za-z]+-\d+)", stem)
    return frontmatter_id or (m[1] if m else stem)


def governing(mentions: DataFrame, documents: DataFrame, successors: DataFrame) -> DataFrame:
    """(document, file): accepted or status-less documents that mention a file, superseded ones replaced by what follows them.

    mentions (key, file), documents (key, status), successors (key, last).
    """
    ok = F.col("status").isNull() | (F.lower("status") == "accepted")
    m = mentions.join(documents, "key", "left")
    now = m.where(ok).select("key", "file")
    moved = m.where(F.lower("status") == "superseded").join(successors, "key").select(F.col("last").alias("key"), "file")
    return now.union(moved.join(documents.where(ok).select("key"), "key", "left_semi")).distinct()


def drift(cited: DataFrame, changed: DataFrame) -> DataFrame:
    """(key, id): cited symbols of changed files (file) that no longer resolve; cited is (key, id, resolves)."""
    c = cited.where("NOT resolves").withColumn("file", F.regexp_extract("id", r"^[^:]*:(.*)#", 1))
    return c.join(changed.select("file").distinct(), "file", "left_semi").select("key", "id")


def history_findings(history: DataFrame) -> DataFrame:
    """(repo, path, marker) from one row a file: commits, commits_90, age_days, owner share, authors, entropy, bus_factor, defects."""
    marks = F.array_compact(F.array(
        F.when(F.col("commits") >= 20, "churn_risk"), F.when(F.col("entropy") >= 2.5, "change_entropy"), F.when((F.col("authors") >= 2) & (F.col("share") < 0.5), "ownership_risk"),
        F.when((F.col("age_days") >= 365) & (F.col("commits_90") >= 3), "code_age_volatility"), F.when(F.col("authors") >= 5, "developer_congestion"), F.when((F.col("bus_factor") == 1) & (F.col("commits") >= 5), "knowledge_loss"), F.when(F.col("defects") >= 2, "prior_defect"),
    ))
    return history.select("repo", "path", F.explode(marks).alias("marker"))


def coverage_findings(files: DataFrame) -> DataFrame:
    """(repo, path, marker, deduction) from rate, is_hotspot: gaps below half, a gradient by what is uncovered, untested hotspots."""
    marks = F.array_compact(F.array(
        F.when(F.col("rate") < 0.5, F.struct(F.lit("coverage_gap").alias("marker"), F.lit(None).cast("double").alias("deduction"))),
        F.when(F.col("rate") < 1, F.struct(F.lit("coverage_gradient").alias("marker"), F.round(1 - F.col("rate"), 4).alias("deduction"))),
        F.when((F.coalesce("rate", F.lit(0.0)) < 0.5) & F.col("is_hotspot"), F.struct(F.lit("untested_hotspot").alias("marker"), F.lit(None).cast("double").alias("deduction"))),
    ))
    return files.select("repo", "path", F.explode(marks).alias("m")).select("repo", "path", "m.*")


def lcom4(fields: DataFrame) -> DataFrame:
    """(class, components): groups of methods of a class that share no field with each other; fields is (class, method, field)."""
    ends = fields.select("class", F.concat_ws("|", F.lit("m"), "class", "method").alias("src"), F.when(F.col("field").isNotNull(), F.concat_ws("|", F.lit("f"), "class", "field")).alias("dst"))
    labels = components(G.plain(ends))
    methods = ends.select("class", F.col("src").alias("id")).distinct().join(labels, "id", "left")
    return methods.groupBy("class").agg(F.count_distinct(F.coalesce("component", "id")).alias("components"))


def components(edges: DataFrame) -> DataFrame:
    """(id, component): weakly connected components by their smallest node."""
    both = edges.union(edges.select("dst", "src")).distinct()
    labels = G._least_reaching(both, G.nodes_of(edges).withColumn("colour", F.col("id")))
    return labels.select("id", F.col("colour").alias("component"))


def section_findings(sections: DataFrame, kinds: DataFrame, required: list[tuple[str, str]], allowed: dict[tuple[str, str], list[str]]) -> DataFrame:
    """(key, code, section): required sections that a document of a kind lacks, and sections whose first line is not allowed.

    sections (key, name, body), kinds (key, type); the rules are the caller's.
    """
    spark = sections.sparkSession
    need = kinds.join(F.broadcast(spark.createDataFrame(required or [("", "")], "type string, name string")), "type").select("key", "name")
    missing = need.join(sections.select("key", "name"), ["key", "name"], "left_anti").select("key", F.lit("missing-section").alias("code"), F.col("name").alias("section"))
    rules = [(t, n, v.lower()) for (t, n), vs in allowed.items() for v in vs] or [("", "", "")]
    rule = F.broadcast(spark.createDataFrame(rules, "type string, name string, value string"))
    first = sections.withColumn("value", F.lower(F.trim(F.split_part("body", F.lit("\n"), F.lit(1))))).join(kinds, "key").select("key", "type", "name", "value")
    ruled = first.join(rule.select("type", "name").distinct(), ["type", "name"], "left_semi")
    bad = ruled.join(rule, ["type", "name", "value"], "left_anti").select("key", F.lit("value-not-allowed").alias("code"), F.col("name").alias("section"))
    return missing.union(bad)


def title_findings(headings: DataFrame, documents: DataFrame) -> DataFrame:
    """(key, code): documents without a title, or with several; headings (key, depth), documents (key)."""
    n = documents.select("key").distinct().join(headings.where("depth = 1").groupBy("key").agg(F.count("*").alias("n")), "key", "left")
    code = F.when(F.col("n").isNull(), "missing-title").when(F.col("n") > 1, "multiple-titles")
    return n.select("key", code.alias("code")).where("code IS NOT NULL")


def ground(hits: DataFrame, successors: DataFrame) -> DataFrame:
    """(query, key, rank): hits whose superseded documents are replaced by their last successor, the best rank kept."""
    now = hits.join(successors, "key", "left").withColumn("key", F.coalesce("last", "key"))
    kept = now.groupBy("query", "key").agg(F.min("rank").alias("rank"))
    return kept.withColumn("rank", F.row_number().over(Window.partitionBy("query").orderBy("rank", "key")).cast("bigint"))
