"""Text, URL, Markdown, bundle, search and code cases."""

import pytest
from pyspark.sql import functions as F

from quarryline.functions import markdown as M
from quarryline.functions import source as X
from quarryline.functions import text as T
from quarryline.operators import canon as K
from quarryline.operators import code as C
from quarryline.operators import documents as D
from quarryline.operators import context as N
from quarryline.operators import search as S


def _one(spark, f, *values):
    row = spark.createDataFrame([values], ", ".join(f"c{i} string" for i in range(len(values))))
    return row.select(f(*[F.col(f"c{i}") for i in range(len(values))]).alias("v")).first().v


@pytest.mark.parametrize("url,want", [
    ("https://Example.com/a#frag", "https://example.com/a"), ("https://e.com/a?utm_source=x&b=2&a=1", "https://e.com/a?a=1&b=2"), ("https://e.com/a?fbclid=1", "https://e.com/a"),
    ("https://e.com//a///b", "https://e.com/a/b"), ("https://e.com/a/", "https://e.com/a/"), (None, None),
])
def test_canonical_url(spark, url, want):
    assert _one(spark, T.canonical_url, url) == want


@pytest.mark.parametrize("title,text,want", [("README", "x", "README"), ("API Reference", "endpoint", "API Reference"), ("Getting Started", "quickstart", "Guide"), ("Docs", "documentation page", "Documentation Page"), ("Something", "random content", "Concept")])
def test_infer_type(spark, title, text, want):
    assert _one(spark, T.infer_type, title, "id", text) == want


def test_globs():
    import re

    assert re.search(T.glob_pattern("src/**/*.go"), "src/a/b/c.go") and not re.search(T.glob_pattern("src/*.go"), "src/a/b.go") and T.glob_pattern("/x+/") == "x+"


def test_headings_and_sections(spark):
    text = "# T\n\n## Real\n\n```\n## Not\n```\n### Detail\nx\n## Next\ny"
    df = spark.createDataFrame([(1, text), (2, None), (3, "")], "k int, t string")
    assert [r.heading for r in M.headings(df, "k", "t").orderBy("line_no").collect()] == ["T", "Real", "Detail", "Next"]
    s = {r.name: r.body for r in M.sections(df, "k", "t").collect()}
    assert set(s) == {"real", "next"} and "## Not" in s["real"] and "### Detail" in s["real"]


def test_requirements(spark):
    text = "# T\n\n## R\n\n- [REQ-001] The system MUST work.\n[REQ-002] It must and SHOULD support both.\n[X] bad\n[REQ-003]\n[REQ-001] If it fails it MUST stop.\n[link](a.md)"
    reqs = D.requirements(spark.createDataFrame([(1, text)], "k int, t string"), "k", "t")
    assert [(r.line_no, r.id, r.problem) for r in reqs.orderBy("line_no").collect()] == [(5, "REQ-001", None), (6, "REQ-002", None), (7, "X", "bad-id"), (8, "REQ-003", "empty-text"), (9, "REQ-001", None)]
    assert {(r.line_no, r.code) for r in D.requirement_issues(reqs).collect()} == {(6, "non-normative-keyword"), (6, "not-singular"), (6, "ambiguous-verb"), (9, "if-without-then"), (9, "duplicate-id")}


def test_bundle_diff(spark):
    a = spark.createDataFrame([("a.md", "x"), ("b.md", "same"), ("index.md", "i"), ("c.md", None)], "p string, b string")
    b = spark.createDataFrame([("b.md", "---\nt: 1\n---\nsame\r\n"), ("d.md", "y"), ("c.md", "z")], "p string, b string")
    assert {(r.path, r.change) for r in D.bundle_diff(a, b, "p", "b").collect()} == {("a.md", "deleted"), ("d.md", "added"), ("c.md", "modified")}


def test_search_finds_near_words(spark):
    docs = spark.createDataFrame([(1, "Getting started", ["tutorial"], "Guide", "how to begin", "first steps"), (2, "API", None, "Reference", None, "the tutorials are elsewhere")], "k int, title string, tags array<string>, type string, description string, body string")
    hits = S.search(S.postings(docs, "k"), spark.createDataFrame([("tutorial",)], "query string"), 2).orderBy("rank").collect()
    assert [h.doc for h in hits] == [1, 2]


def test_pack_skips_what_does_not_fit(spark):
    rows = spark.createDataFrame([("q", 1, 1, "canon", "[REQ-1] " + "a" * 3992), ("q", 2, 2, "canon", "[REQ-2] " + "b" * 15992), ("q", 3, 3, "canon", "[REQ-3] " + "c" * 11992), ("q", 4, 4, "canon", None)], "query string, key int, rank int, tier string, body string")
    assert {r.key: r.how != "deferred" for r in N.assemble(rows).collect()} == {1: True, 2: False, 3: True, 4: False}


def test_classify(spark):
    specs = [("decision", "context", True), ("decision", "decision", True), ("decision", "consequences", True), ("design", "context", True), ("design", "design", True), ("design", "user need", True)]
    df = spark.createDataFrame([("a", "context"), ("a", "decision"), ("a", "consequences"), ("b", "context")], "key string, name string")
    assert {r.key: (r.type, r.fit) for r in K.classify(df, specs).collect()} == {"a": ("decision", 1.0), "b": ("unknown", 0.33)}


def test_policy_and_multiset_difference(spark):
    i = spark.createDataFrame([("error", "a"), ("warning", "b"), ("warning", "b"), ("error", "c")], "severity string, code string")
    got = K.apply_policy(i, ["a"], ["b"], ["c"])
    assert sorted((r.severity, r.code) for r in got.collect()) == [("error", "b"), ("error", "b"), ("warning", "c")]
    assert tuple(K.gate(got).first()) == (2, 1, False)
    assert K.introduced(i.limit(0), i).count() == 4 and K.introduced(i.where("code <> 'b'"), i).count() == 2


SOURCES = {
    "a.go": 'package a\n\n// func Hidden() {}\nfunc Put(k string, n int) int {\n\tif n > 1 && k != "func X() {" {\n\t\treturn Get(k)\n\t}\n\treturn 0\n}\n',
    "b.go": "package a\n\nfunc Get(k string) int {\n\treturn 1\n}\n\nfunc helper() {\n}\n",
    "c.py": "class A:\n    def one(self, x: int):\n        try:\n            return Put(x)\n        except:\n            pass\n\ndef two():\n    return 1\n",
}


def test_symbols_and_graph(spark):
    files = spark.createDataFrame([("r", f, s) for f, s in SOURCES.items()] + [("r", "d.go", None), ("r", "e.txt", "func Z() {}"), ("r", "f.go", "")], "repo string, file string, source string")
    s = X.symbols(files, "repo", "file", "source").cache()
    d = {r.name: r for r in C.definitions(s).collect()}
    assert set(d) == {"Put", "Get", "helper", "A", "one", "two"}
    assert (d["Put"].line, d["Put"].end_line, d["Put"].ccn, d["Put"].params) == (4, 9, 3, 2) and d["one"].parent == "A" and d["one"].bad_catch == 1
    assert {(r.src.split("#")[1], r.dst.split("#")[1]) for r in C.code_graph(s).collect()} == {("Put@4", "Get@3"), ("one@2", "Put@4")}
    dead = {r.name: r.confidence for r in C.dead_code(s, files).collect()}
    assert dead == {"helper": "high"}
    assert C.parse_symbol_id(F.lit("x")) is not None


def test_clones(spark):
    block = "\n".join(f"total += value_{i} * {i};" for i in range(12))
    rows = [("r", "a.js", block + "\nconst x = 1;"), ("r", "b.js", "let y;\n" + block.replace("value", "other")), ("r", "c.js", "one();"), ("q", "d.js", block), ("r", "e.js", None)]
    files = spark.createDataFrame(rows, "repo string, file string, source string")
    assert {(r.repo, r.file) for r in C.clones(files).collect()} == {("r", "a.js"), ("r", "b.js")}


def test_coverage_reports(spark):
    lcov = spark.createDataFrame([("SF:a.go\nDA:1,3\nDA:2,0\nDA:3,1\nend_of_record\nSF:b.go\nDA:1,0\nend_of_record",)], "t string")
    assert {r.path: (r.covered, r.total) for r in C.lcov(lcov, "t").collect()} == {"a.go": (2, 3), "b.go": (0, 1)}
    xml = spark.createDataFrame([('<coverage><class name="X" filename="x.go" line-rate="0.8"></class></coverage>',)], "t string")
    assert C.cobertura(xml, "t").first().rate == 0.8
