"""Fitting into budgets: literal cases, and packing against a plain loop."""

import json
import random

from pyspark.sql import functions as F

from quarryline.operators import context as C


def _one(spark, expression, text):
    return spark.createDataFrame([(text,)], "t string").select(expression(F.col("t")).alias("r")).first().r


def test_structure(spark):
    text = "# A\n\n\n\n* one  \n+ two\n\ttab\n```\n* kept\n\ttab\n```\n* three\n"
    assert _one(spark, C.structural, text) == "# A\n\n- one\n- two\n  tab\n```\n* kept\n\ttab\n```\n- three\n"
    assert _one(spark, C.structural, None) is None and _one(spark, C.structural, "") == ""


def test_cuts(spark):
    text = "# A\naaaa\n## B\nbbbb\n## C\n" + "c" * 400
    assert _one(spark, lambda c: C.cut_to_heading(c, 8), text) == "# A\naaaa\n## B\nbbbb"
    assert _one(spark, lambda c: C.cut_to_heading(c, 2), "x" * 50) == "x" * 8
    assert _one(spark, lambda c: C.cut_to_sections(c, 8), text) == "# A\naaaa\n## B\nbbbb\n"
    assert _one(spark, lambda c: C.cut_to_sections(c, 8, note=True), text) == "# A\naaaa\n## B\nbbbb\n" + C.NOTE.rstrip("\n") + "\n"
    assert _one(spark, lambda c: C.cut_to_sections(c, 8), "---\na: 1\n---\n# A\nx\n# B\n" + "y" * 90) == "---\na: 1\n---# A\nx\n"
    assert _one(spark, lambda c: C.cut_to_sections(c, 0), text) == text
    assert _one(spark, lambda c: C.byte_prefix(c, 4), "aé€b") == "aé"
    assert _one(spark, C.outline, "---\na: 1\n---\n# A\n### B\ntext\n##") == ["A", "    B"]
    assert spark.createDataFrame([(1, "# A\n\nFirst here.\n\nSecond.\n## B\nOther.\n")], "k int, t string").transform(lambda d: C.section_reduction(d, "k", "t", 100)).first().text == "# A\nFirst here.\n\n## B\nOther."


def test_requirements_are_never_cut(spark):
    body = "prose " * 40 + "\n[REQ-1] The gate MUST close.\n" + "more " * 40
    rows = [("q", 1, 1, "canon", body), ("q", 2, 2, "reference", body), ("q", 3, 3, "canon", None), ("q", 4, 4, "canon", "[REQ-2] " + "x" * 400)]
    df = spark.createDataFrame(rows, "query string, key int, rank int, tier string, body string")
    got = {r.key: r for r in C.assemble(df, budget=40).collect()}
    assert (got[1].how, got[1].body) == ("requirements", "[REQ-1] The gate MUST close.")
    assert got[2].how == "truncated" and got[2].tokens == 40 - got[1].tokens
    assert got[3].how == got[4].how == "deferred"


def test_snippets_against_a_loop(spark):
    r = random.Random(2)
    docs = [(i, f"t{i}", "Guide", "d", ["a", "b"], " ".join("word" for _ in range(r.randint(1, 200)))) for i in range(30)]
    ranked = [("q", i, 30.0 - i, i + 1) for i in range(30)]
    about = spark.createDataFrame(docs, "doc int, title string, type string, description string, tags array<string>, body string")
    got = {x.doc: (x.packed, x.tokens) for x in C.assemble_snippets(spark.createDataFrame(ranked, "query string, doc int, score double, rank bigint"), about, 900).collect()}
    used = 0
    tokens = lambda x: -(-len(json.dumps(x, separators=(",", ":"))) // 4)
    for (i, title, kind, text, tags, body), (_, _, score, _) in zip(docs, ranked):
        base = {"doc": i, "score": score, "title": title, "type": kind, "description": text, "tags": tags}
        room, cost = 900 - used - tokens(base) - C.RESERVE, tokens(base | {"content": body})
        packed = room > 0 and used + cost <= 900
        assert got[i] == (packed, cost if packed else 0)
        used += cost if packed else 0


def test_neighbours_of_the_first_hits(spark):
    hits = spark.createDataFrame([("q", 1, 8.0, 1), ("q", 2, 6.0, 2), ("q", 3, 4.0, 3), ("q", 4, 2.0, 4)], "query string, doc int, score double, rank bigint")
    edges = spark.createDataFrame([(1, 9), (8, 2), (4, 7), (9, 2), (5, 9)], "src int, dst int")
    got = [(r.doc, r.score) for r in C.with_neighbours(hits, edges).orderBy("rank").collect()]
    assert got == [(1, 8.0), (2, 6.0), (3, 4.0), (9, 4.0), (8, 3.0), (4, 2.0)]
    assert {r.doc for r in C.with_neighbours(hits, edges, depth=2).collect()} == {1, 2, 3, 4, 5, 8, 9}


def test_tokens_of_a_tokenizer(spark):
    df = spark.createDataFrame([("a b", 1), (None, 2)], "t string, k int")
    assert {(r.k, r.n) for r in C.tokens_with(df, "t", "n", lambda: str.split).collect()} == {(1, 2), (2, None)}
