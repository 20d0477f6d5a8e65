"""Queries on ingestion and summaries."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarryline.functions import summary as U
from quarryline.functions import text as T
from quarryline.operators import ingest as I
from quarryline.sources import table


def _html(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "raw_documents").where("content_type = 'html'").select("raw_id", "url", "raw").dropDuplicates(["raw_id"])


def _crawl(s, d):
    """From the first address of every origin along all links, to the end."""
    pages = _html(s, d)
    starts = pages.groupBy(F.regexp_extract("url", r"^(https?://[^/]*)", 1).alias("o")).agg(F.min("url").alias("url"))
    return I.crawl(pages, starts, depth=None, most=None)


def _rewritten(s, d):
    c = table(s, d, "normalized_documents").select("norm_id", "resource", "markdown", "output_path").dropDuplicates(["norm_id"])
    return I.rewrite_links(c, "norm_id", "resource", "markdown", c.select(F.col("resource").alias("url"), F.col("output_path").alias("output"))).select(F.col("key").alias("norm_id"), F.md5("text").alias("digest"))


QUERIES = {
    "i6_crawl": _crawl,
    "n1_html_to_markdown": lambda s, d: I.html_to_markdown(_html(s, d), "raw_id", "raw"),
    "w2_rewrite_links": _rewritten,
    "w4_frontmatter_out": lambda s, d: table(s, d, "concepts").select("concept_key", I.frontmatter_out(F.col("title"), F.col("concept_type"), F.col("tags")).alias("frontmatter")).distinct(),
    "w5_summary_callout": lambda s, d: table(s, d, "concepts").select("concept_key", F.md5(I.with_callout(T.unix_lines(F.col("body")), F.col("description"))).alias("digest")).distinct(),
    "w9_changelog": lambda s, d: I.changelog_entries(table(s, d, "changes").where("subject IS NOT NULL").select("repo", "ts", "subject").distinct().select(F.concat("repo", F.lit("\n"), F.date_format(F.timestamp_seconds("ts"), "yyyy-MM-dd'T'HH:mm:ss'Z'"), F.lit(" - "), "subject").alias("t")), "t").select("source", F.unix_timestamp("at").alias("ts"), "message"),
    "w10_export_documents": lambda s, d: I.export_jsonl(table(s, d, "concepts").select("concept_key", "bundle", "path", "title").distinct()),
    "u3_extractive_summary": lambda s, d: U.extractive(table(s, d, "concepts").select("concept_key", "body").dropDuplicates(["concept_key"]), "concept_key", "body", "textrank"),
}

SQL = {"w9_changelog": "SELECT DISTINCT repo AS source, ts, subject AS message FROM changes WHERE subject IS NOT NULL"}
