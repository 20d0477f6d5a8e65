"""Folders of documents and commit logs in any storage that Spark reads: listing, import, bundles."""

import re
from collections.abc import Iterator

import pyarrow as pa
import yaml
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarryline.functions import text as T
from quarryline.operators import changes

#: Folders that hold no documents. (fixed values)
SKIPPED = (".git", "node_modules", "dist")
#: Limits of strict frontmatter: bytes and depth. (fixed values)
MAX_BYTES, MAX_DEPTH = 64 * 1024, 32


def listed(spark: SparkSession, folder: str, include: list[str] = (), exclude: list[str] = ()) -> DataFrame:
    """(path, size, modified): the regular files below a folder, their paths relative to it; contents are not read."""
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder).select("path", F.col("length").alias("size"), F.col("modificationTime").alias("modified"))
    return _chosen(rows.withColumn("path", _relative(folder)), include, exclude)


def _relative(folder: str) -> Column:
    return F.regexp_replace(F.regexp_replace("path", "^[a-z]+:/*", "/"), "^" + re.escape("/" + re.sub("^[a-z]+:", "", folder).strip("/")) + "/", "")


def _chosen(rows: DataFrame, include: list[str], exclude: list[str]) -> DataFrame:
    rows = rows.where(~F.col("path").rlike(r"(^|/)(" + "|".join(map(re.escape, SKIPPED)) + ")/"))
    rows = rows.where(T.matches_any(F.col("path"), list(include))) if include else rows
    return rows.where(~T.matches_any(F.col("path"), list(exclude))) if exclude else rows


def imported(spark: SparkSession, folder: str, include: list[str] = (), exclude: list[str] = ()) -> DataFrame:
    """(path, content_type, text) of the documents below a folder; an error if none is left."""
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder).select("path", "content").withColumn("path", _relative(folder))
    rows = _chosen(rows, include, exclude).withColumn("content_type", T.content_type(F.col("path"))).where("content_type IS NOT NULL")
    out = rows.select("path", "content_type", T.unix_lines(F.make_valid_utf8(F.col("content").cast("string"))).alias("text"))
    if out.isEmpty():
        raise ValueError(f"no documents in {folder}")
    return out


def frontmatter(df: DataFrame, key: str, text: str, known: list[str], versions: list[int] = (1,)) -> DataFrame:
    """(key, fields, body, issues): a text's YAML frontmatter as texts by name, the rest of it, and what is wrong with the frontmatter:
    too large, malformed, aliases or too deep, unknown fields, duplicate keys, an unsupported schema_version. Without one no fields."""
    rows = df.select(F.col(key).alias("key"), F.col(text).alias("text")).where("text IS NOT NULL")
    names, versions = frozenset(known), frozenset(versions)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            done = [_strict(t, names, versions) for t in b.column(1).to_pylist()]
            fields = pa.array([list(f.items()) for f, _, _ in done], pa.map_(pa.string(), pa.string()))
            yield pa.RecordBatch.from_arrays([b.column(0), fields, pa.array([r for _, r, _ in done], pa.string()), pa.array([i for _, _, i in done], pa.list_(pa.string()))], ["key", "fields", "body", "issues"])

    return rows.mapInArrow(run, f"key {dict(rows.dtypes)['key']}, fields map<string,string>, body string, issues array<string>")


def _strict(text: str, known: frozenset, versions: frozenset) -> tuple[dict, str, list[str]]:
    text = text.replace("\r\n", "\n")
    m = re.match(r"---\n(.*?)(?:^|\n)---[ \t]*(?:\n|\Z)", text, re.S)
    if not m:
        return {}, text, []
    body, raw = text[m.end() :], m[1]
    if len(raw.encode()) > MAX_BYTES:
        return {}, body, ["frontmatter_too_large"]
    issues: list[str] = []
    try:
        depth = 0
        for event in yaml.parse(raw):
            if isinstance(event, yaml.AliasEvent) or getattr(event, "anchor", None):
                return {}, body, ["frontmatter_bomb"]
            depth += isinstance(event, (yaml.MappingStartEvent, yaml.SequenceStartEvent)) - isinstance(event, (yaml.MappingEndEvent, yaml.SequenceEndEvent))
            if depth > MAX_DEPTH:
                return {}, body, ["frontmatter_bomb"]
        node = yaml.compose(raw, yaml.SafeLoader)
        value = yaml.safe_load(raw)
    except (yaml.YAMLError, ValueError):
        return {}, body, ["malformed_frontmatter"]
    if value is None:
        return {}, body, []
    if not isinstance(value, dict):
        return {}, body, ["malformed_frontmatter"]
    keys = [k.value for k, _ in node.value]
    if len(keys) != len(set(keys)):
        issues.append("frontmatter_duplicate_key")
    if known and not set(map(str, value)) <= known:
        issues.append("frontmatter_unknown_field")
    if "schema_version" in value and value["schema_version"] not in versions:
        issues.append("unsupported_schema_version")
    return {str(k): v if isinstance(v, str) else yaml.safe_dump(v, default_flow_style=True).replace("\n...", "").strip() for k, v in value.items() if v is not None}, body, issues


def bundle(spark: SparkSession, folder: str) -> DataFrame:
    """(path, fields, body) of a bundle's Markdown files, index and log pages aside; files whose frontmatter is no YAML are left out."""
    rows = imported(spark, folder, exclude=["**index.md", "**log.md"]).where("content_type = 'markdown'")
    return frontmatter(rows, "path", "text", []).where(~F.array_contains("issues", "malformed_frontmatter")).select(F.col("key").alias("path"), "fields", "body")


def commit_log(spark: SparkSession, path: str) -> DataFrame:
    """The change log of log text in files: records after \\x1e, fields after \\x1f, numstat lines below. Large files are split by record."""
    return changes.parse_log(spark.read.option("lineSep", "\x1e").text(path), "value")
