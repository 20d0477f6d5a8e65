"""Imports, definitions at a place, textual hits, ranks and bounded walks, on literal cases."""

from pyspark.sql import functions as F

from quarryline.functions import source as X
from quarryline.operators import assess as A
from quarryline.operators import code as K
from quarryline.operators import graph as G
from quarryline.operators.ranks import prefix, ranked

FILES = [
    ("r", "app/main.py", "from .util import load as read\nimport app.more\n\ndef run():\n    read()\n    other()\n"),
    ("r", "app/util.py", "def load():\n    pass\n"),
    ("r", "lib/util.py", "def load():\n    pass\n\ndef other():\n    pass\n# load here\n"),
    ("r", "web/a.ts", "import { go as start } from './b';\nconst c = require('../web/c');\nfunction f() { start(); }\n"),
    ("r", "web/b.js", "function go() { return 1; }\n"),
]


def _tables(spark):
    files = spark.createDataFrame(FILES, "repo string, file string, source string")
    return files, X.symbols(files, "repo", "file", "source"), X.imports(files, "repo", "file", "source")


def test_imports_lead_to_definitions(spark):
    _, symbols, imports = _tables(spark)
    assert {(r.file, r.name, r.source, r.module) for r in imports.collect()} == {("app/main.py", "read", "load", ".util"), ("app/main.py", "app", "more", "app.more"), ("web/a.ts", "start", "go", "./b"), ("web/a.ts", "c", "default", "../web/c")}
    assert {(r.file, r.name, r.id) for r in K.resolved_imports(imports, symbols).collect()} == {("app/main.py", "read", "python:app/util.py#load@1"), ("web/a.ts", "start", "javascript:web/b.js#go@1")}


def test_definition_at_a_place(spark):
    _, symbols, imports = _tables(spark)
    places = spark.createDataFrame([("r", "app/main.py", 5, "read"), ("r", "app/main.py", 6, "other"), ("r", "lib/util.py", 2, "load"), ("r", "app/main.py", 6, "nothing")], "repo string, file string, line int, name string")
    assert {(r.line, r.name, r.how, r.id) for r in K.definition_at(symbols, imports, places).collect()} == {(5, "read", "import", "python:app/util.py#load@1"), (6, "other", "name", "python:lib/util.py#other@4"), (2, "load", "local", "python:lib/util.py#load@1")}


def test_textual_hits(spark):
    files, symbols, _ = _tables(spark)
    names = spark.createDataFrame([("r", "load"), ("r", "other")], "repo string, name string")
    assert {(r.name, r.file, r.line, r.how) for r in K.text_hits(symbols, files, names).collect()} == {("other", "app/main.py", 6, "call"), ("load", "app/main.py", 1, "text"), ("load", "lib/util.py", 6, "text")}


def test_ranks_of_a_hot_group(spark):
    rows = [("hot", i * 7919 % 5000) for i in range(5000)] + [("cold", 1), (None, 2), (None, 1)]
    df = spark.createDataFrame(rows, "g string, v int").repartition(4)
    got = {(r.g, r.v): r["rank"] for r in ranked(df, ["g"], [F.desc("v")]).collect()}
    assert all(got["hot", v] == 5000 - v for v in range(5000)) and got["cold", 1] == 1 and (got[None, 2], got[None, 1]) == (1, 2)


def test_prefix_within_a_budget(spark):
    df = spark.createDataFrame([("a", 1, 3), ("a", 2, 0), ("a", 3, 2), ("a", 4, 9), ("a", 5, 0), ("b", 1, 0), ("c", 1, 99)], "g string, k int, n int")
    assert {(r.g, r.k, r.used) for r in prefix(df, "g", "k", F.col("n"), 5).collect()} == {("a", 1, 3), ("a", 2, 3), ("a", 3, 5), ("b", 1, 0)}


def test_bounded_walk_says_what_it_left_out(spark):
    edges = spark.createDataFrame([("hub", f"n{i:03}") for i in range(50)] + [("a", "b"), ("b", "c")], "src string, dst string")
    roots = spark.createDataFrame([("hub",), ("a",)], "id string")
    got = G.bounded_neighbourhood(edges, roots, 2, frontier=10).collect()
    assert len([r for r in got if r.root == "hub"]) == 11 and all(r.truncated for r in got if r.root == "hub")
    assert {(r.id, r.hops, r.truncated) for r in got if r.root == "a"} == {("a", 0, False), ("b", 1, False), ("c", 2, False)}
    kinds = edges.withColumn("kind", F.lit("x"))
    assert {(r.src, r.dst) for r in G.neighbourhood_edges(kinds, roots.where("id = 'a'"), 2).collect()} == {("a", "b"), ("b", "c")}


def test_impacts_share_a_cap(spark):
    found = spark.createDataFrame([("r", "f", "big", "high", 1), ("r", "f", "big", "high", 2), ("r", "f", "other", "low", 3)], "repo string, file string, marker string, severity string, line int")
    got = A.impacts(found, [("big", "defect", 2.0, "size")], {("defect", "size"): 3.0})
    assert {(r.line, round(r.impact, 3)) for r in got.collect()} == {(1, 1.385), (2, 1.385), (3, 0.231)}
    scores = A.dimension_scores(got, found.select("repo", "file"))
    assert {(r.dimension, r.score) for r in scores.collect()} == {("defect", 7.0), ("maintainability", 10.0), ("performance", 10.0)}
    assert [(r.marker, r.line, r["rank"]) for r in A.ordered(got).orderBy("rank").collect()] == [("big", 1, 1), ("big", 2, 2), ("other", 3, 3)]


def test_declarations_in_sections(spark):
    sections = spark.createDataFrame([(1, 1, "status", "\n**Accepted**, for now"), (1, 2, "related decisions", "- DEC-1\n\n2. DEC-2"), (2, 1, "context", "x")], "key int, pos int, name string, body string")
    assert [(r.key, r.status) for r in A.status_of(sections).collect()] == [(1, "accepted")]
    assert {(r.kind, r.target) for r in A.declared_references(sections, ["related_decisions"]).collect()} == {("related_decisions", "DEC-1"), ("related_decisions", "DEC-2")}
    kinds = spark.createDataFrame([(1, "decision"), (2, "odd")], "key int, type string")
    a, b = (spark.createDataFrame([(k, c) for k in (1, 2)], "key int, code string") for c in ("a", "b"))
    assert {(r.key, r.code) for r in A.dispatch(kinds, {"decision": a, "requirement": b}, "requirement").collect()} == {(1, "a"), (2, "b")}


def test_gate_tickets_and_contradictions(spark):
    governed = spark.createDataFrame([("DEC-1", "a.go"), ("DEC-1", "a.go"), ("DEC-2", "b.go")], "document string, file string")
    gone = spark.createDataFrame([("DEC-3", "go:a.go#Put@3")], "key string, id string")
    assert {(r.path, r.code, r.message) for r in A.gate_findings(governed, gone).collect()} == {("a.go", "governed-file-changed", "governed by DEC-1"), ("b.go", "governed-file-changed", "governed by DEC-2"), ("a.go", "cited-symbol-missing", "go:a.go#Put@3 is cited by DEC-3")}
    refs = spark.createDataFrame([(1, "ABC-12"), (2, "https://x.org/1"), (3, "someday"), (4, " "), (5, None), (6, "#7"), (7, "org/repo#7"), (8, "abc-12")], "k int, target string")
    assert {r.k for r in A.ticket_lint(refs, "target").collect()} == {3, 8}
    edges = spark.createDataFrame([("new", "old", "supersedes"), ("new", "other", "supersedes"), ("x", "old", "related"), ("new", "none", "supersedes")], "src string, dst string, kind string")
    states = spark.createDataFrame([("old", "Superseded"), ("other", "Accepted"), ("none", None)], "path string, status string")
    assert [(r.source, r.target) for r in A.contradictions(edges, states).collect()] == [("new", "other")]
    counts = spark.createDataFrame([(1, 2, False), (0, 3, True)], "blocking bigint, advisory bigint, passed boolean")
    assert A.merge_gates(counts.limit(1), counts.where("passed")).first()[:] == (1, 5, False)


def test_change_modes_and_report(spark):
    rows = spark.createDataFrame([("r", "s1", 10, "a.go", 1, 2), ("r", "s1", 10, "b.go", 3, 0), ("r", "s2", 20, "a.go", 5, 5)], "repo string, sha string, ts bigint, path string, added bigint, deleted bigint")
    as_set = lambda df: {(r.path, r.added, r.deleted) for r in df.collect()}
    assert as_set(A.change_set(rows, "commit")) == {("a.go", 5, 5)} and as_set(A.change_set(rows, "commit", sha="s1")) == {("a.go", 1, 2), ("b.go", 3, 0)}
    assert as_set(A.change_set(rows, "since", since=5)) == {("a.go", 6, 7), ("b.go", 3, 0)} and as_set(A.change_set(rows, "range", since=5, until=15)) == {("a.go", 1, 2), ("b.go", 3, 0)}
    scored = spark.createDataFrame([("r", "s2", 4.25, None, None)], "repo string, sha string, score double, percentile double, priority string")
    tests = spark.createDataFrame([("r", "a.go")], "repo string, path string")
    partners = spark.createDataFrame([("r", "a.go", "b.go", 3)], "repo string, path string, partner string, n bigint")
    assert {(r.path, r.code, r.message) for r in A.risk_report(scored, tests, partners).collect()} >= {("a.go", "missing-test", "changed without a test"), ("a.go", "missing-co-change", "usually changes with b.go (3 times)")}
