"""Ingestion, summaries, governance, the log data source and the streaming form."""

import datetime as dt
import json

import pytest

from quarryline.functions import summary as U
from quarryline.operators import governance as V
from quarryline.operators import ingest as I
from quarryline.sources import files as S
from quarryline.streaming.hotspots import churn


def test_titles_of_pages():
    assert I.to_markdown("<h1>Hello</h1><p>World</p>")[0] == "Hello"
    title, text = I.to_markdown("<body><nav>no</nav><main><h1>Main Content</h1><p>a <b>b</b> <a href='/x'>c</a></p><ul><li>d<li>e</ul></main><footer>no</footer></body>")
    assert title == "Main Content" and "no" not in text and "**b**" in text and "[c](/x)" in text and "- d" in text
    assert I.to_markdown("<script>alert(1)</script><h1>Title</h1>") == ("Title", "# Title")
    assert I.to_markdown("<html><head><title>Page Title</title></head><body><p>x</p></body></html>")[0] == "Page Title"
    assert I.to_markdown("") == ("", "") and isinstance(I.to_markdown("<p><b>open" * 200)[1], str)


def test_crawl(spark):
    pages = [("https://h.example/a", '<a href="/b">x</a> <a href="c?utm_source=1">y</a> <a href="https://other.example/z">z</a> <a href="#f">f</a>'), ("https://h.example/b", '<a href="/d">x</a>'), ("https://h.example/c", None), ("https://h.example/d", '<a href="/e">x</a>'), (None, None)]
    df = spark.createDataFrame(pages, "url string, raw string")
    start = spark.createDataFrame([("https://H.example/a",)], "url string")
    assert {(r.url[-1], r.depth) for r in I.crawl(df, start, depth=2).collect()} == {("a", 0), ("b", 1), ("c", 1), ("d", 2)}
    assert I.crawl(df, start, depth=2, most=2).count() == 2
    assert {r.url[-1] for r in I.crawl(df, start, depth=2, exclude=["/b"]).collect()} == {"a", "c"}
    assert I.crawl(df, start, disallowed=["/c"], depth=1).count() == 2
    assert I.crawl(df, spark.createDataFrame([("http://127.0.0.1/x",)], "url string")).count() == 0


def test_crawl_of_many_origins(spark):
    """A cap holds for each origin, and without one every start and a chain of links is followed to its end."""
    hosts = [f"https://h{i:02}.example" for i in range(12)]
    df = spark.createDataFrame([(f"{h}/{k}", f'<a href="/{k + 1}">x</a><a href="/x{k}">x</a>' if k < 6 else "") for h in hosts for k in range(7)], "url string, raw string")
    starts = spark.createDataFrame([(f"{h}/0",) for h in hosts], "url string")
    few = [r.url.rpartition("/")[0] for r in I.crawl(df, starts, depth=2, most=4).collect()]
    assert sorted(few) == sorted(hosts * 4)
    got = I.crawl(df, starts, depth=None, most=None).collect()
    assert {(r.url.rpartition("/")[2], r.depth) for r in got} == {(str(k), k) for k in range(7)} | {(f"x{k}", k + 1) for k in range(6)} and len(got) == 12 * 13


def test_robots():
    assert I.robots_disallowed("User-agent: *\nDisallow: /x\n", ["/x/y", "/z"]) == ["/x/y"] and I.robots_disallowed(None, ["/x"]) == []


def test_links_callouts_changelog(spark):
    docs = spark.createDataFrame([(1, "https://h.example/a/b", "[x](c) [y](/d#t) [z](e)"), (2, None, None)], "k int, u string, t string")
    paths = spark.createDataFrame([("https://h.example/a/c", "out/c.md"), ("https://h.example/d", "out/d.md")], "url string, output string")
    got = {r.key: r.text for r in I.rewrite_links(docs, "k", "u", "t", paths).collect()}
    assert got == {1: "[x](/out/c.md) [y](/out/d.md) [z](e)", 2: None}
    from pyspark.sql import functions as F

    t = spark.createDataFrame([("# T\n\nBody", "One."), ("# T\n\n> [!summary]\n> Old.\n\nBody", "Two."), ("Body", None)], "t string, s string")
    assert [r.x for r in t.select(I.with_callout(F.col("t"), F.col("s")).alias("x")).collect()] == ["# T\n\n> [!summary]\n> One.\n\nBody", "# T\n\n> [!summary]\n> Two.\n\nBody", "Body"]
    log = spark.createDataFrame([("https://h.example\nkey: v\n2024-01-02T03:04:05Z - made\n2024-01-03T00:00:00Z - more",)], "t string")
    assert [(r.source, r.message) for r in I.changelog_entries(log, "t").orderBy("pos").collect()] == [("https://h.example", "made"), ("https://h.example", "more")]


def test_sarif_and_folders(tmp_path):
    doc = json.loads(I.sarif([{"code": "b", "severity": "error", "path": "x.md"}, {"code": "a", "severity": "warning", "path": "y.md", "line": 3}], "tool"))
    assert [r["id"] for r in doc["runs"][0]["tool"]["driver"]["rules"]] == ["a", "b"] and doc["runs"][0]["results"][1]["locations"][0]["physicalLocation"]["region"]["startLine"] == 3
    assert I.safe_out_dir(str(tmp_path / "out")).name == "out"
    for bad in ("/", "~", "."):
        with pytest.raises(ValueError):
            I.safe_out_dir(bad)


@pytest.mark.parametrize("method", U.METHODS)
def test_summaries(method):
    text = "# Head\n\nThe cursor keeps the token budget small. The cursor keeps the budget for the queue. A short aside about nothing much.\n\n```\ncode here is not prose at all.\n```\n"
    out = U.summarise(text, method)
    assert out in U.sentences(text) and U.summarise(text, method) == out
    assert U.summarise("", method) == "" and U.summarise("One two three four.", method) == "One two three four."


def test_identities():
    assert V.mint("ADR", 0) == "ADR-000000000000" and V.mint("K", 31) == "K-00000000000Z" and len(V.mint("K")) == 14
    assert V.identity_of(None, "a/adr-002-x.md") == "adr-002" and V.identity_of("I", "x.md") == "I" and V.identity_of(None, "a/note.md") == "note"


def test_governing_and_drift(spark):
    m = spark.createDataFrame([("a", "x.go"), ("old", "y.go"), ("prop", "z.go"), ("none", "w.go")], "key string, file string")
    d = spark.createDataFrame([("a", "Accepted"), ("old", "Superseded"), ("new", "Accepted"), ("prop", "Proposed"), ("none", None)], "key string, status string")
    s = spark.createDataFrame([("old", "new")], "key string, last string")
    assert {tuple(r) for r in V.governing(m, d, s).collect()} == {("a", "x.go"), ("new", "y.go"), ("none", "w.go")}
    c = spark.createDataFrame([("a", "go:x.go#F@1", False), ("a", "go:y.go#F@1", False), ("a", "go:x.go#G@1", True)], "key string, id string, resolves boolean")
    assert {r.id for r in V.drift(c, spark.createDataFrame([("x.go",)], "file string")).collect()} == {"go:x.go#F@1"}


def test_cohesion_and_sections(spark):
    f = spark.createDataFrame([("C", "a", "x"), ("C", "b", "x"), ("C", "c", "y"), ("C", "d", None), ("D", "a", "x")], "class string, method string, field string")
    assert {r["class"]: r.components for r in V.lcom4(f).collect()} == {"C": 3, "D": 1}
    s = spark.createDataFrame([("k", "context", "x"), ("k", "status", "Nope\nmore")], "key string, name string, body string")
    kinds = spark.createDataFrame([("k", "decision")], "key string, type string")
    got = V.section_findings(s, kinds, [("decision", "context"), ("decision", "consequences")], {("decision", "status"): ["Accepted"]})
    assert {(r.code, r.section) for r in got.collect()} == {("missing-section", "consequences"), ("value-not-allowed", "status")}


def test_commit_log_source(spark, tmp_path):
    (tmp_path / "one.log").write_text("\x1es1\x1fann\x1f10\x1ffix it\n3\t1\ta.go\n-\t-\tlogo.png\n\n\x1es2\x1fbob\x1f11\x1fx\n1\t0\tb.go\n")
    (tmp_path / "two.log").write_text("")
    rows = S.commit_log(spark, str(tmp_path)).collect()
    assert sorted((r.sha, r.path, r.added, r.deleted) for r in rows) == [("s1", "a.go", 3, 1), ("s1", "logo.png", 0, 0), ("s2", "b.go", 1, 0)]


def test_streaming_equals_batch(spark, tmp_path):
    base = dt.datetime(2024, 1, 1)
    rows = [("r", "a.go", 1, 2, base), ("r", "./a.go", None, 3, base + dt.timedelta(days=1)), ("r", "b.go", 5, None, base + dt.timedelta(days=20)), ("r", "late.go", 1, 1, base + dt.timedelta(days=400))]
    df = spark.createDataFrame(rows, "repo string, path string, added int, deleted int, recorded_at timestamp_ntz")
    df.write.parquet(str(tmp_path / "in"))
    stream = churn(spark.readStream.schema(df.schema).parquet(str(tmp_path / "in")))
    q = stream.writeStream.outputMode("append").format("memory").queryName("churned").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = {(r.path, r.rows, r.churn) for r in spark.sql("SELECT * FROM churned").collect()}
    assert got == {("a.go", 2, 6), ("b.go", 1, 5)}
