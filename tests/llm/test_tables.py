"""The training operators on tables: brute force, nulls, repeats, ties, hot groups, empty tables, clashing extra columns."""

import random
from collections import Counter, defaultdict

import pytest
from conftest import DATA
from pyspark.sql import functions as F

from quarryline.llm import cooccur, leakage, mixture, page_content, parsing, queries, repeated_lines, residue, split


@pytest.mark.skipif(not DATA.exists(), reason="no test tables here")
@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_query_equals_sql(name, against_sql):
    against_sql(queries.QUERIES[name], queries.SQL[name])


@pytest.mark.skipif(not DATA.exists(), reason="no test tables here")
@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - set(queries.SQL)))
def test_query_without_sql_runs(name, spark):
    assert queries.QUERIES[name](spark, str(DATA)).count() >= 0


# 1


def _pairs(rows, most, least):
    baskets = defaultdict(set)
    for g, k, i in rows:
        if None not in (g, k, i):
            baskets[g, k].add(i)
    n, one, two = Counter(), Counter(), Counter()
    for (g, _), items in baskets.items():
        if len(items) <= most:
            n[g] += 1
            for a in items:
                one[g, a] += 1
                for b in items:
                    if a < b:
                        two[g, a, b] += 1
    return {(g, a, b): (c, one[g, a], one[g, b], n[g]) for (g, a, b), c in two.items() if c >= least}


def test_cooccurrence_against_brute_force(spark):
    r = random.Random(2)
    rows = [(r.choice(["hot", "hot", "hot", "b", None]), f"k{r.randrange(60)}", r.choice(["hub", f"i{r.randrange(15)}", "é", None])) for _ in range(1500)]
    rows += [("hot", "wide", f"w{i}") for i in range(400)] + [("b", None, "x")]
    df = spark.createDataFrame([(*x, "clash", 1) for x in rows], "repo string, sha string, item string, `group` string, n int").repartition(3)
    out = cooccur.cooccurrence(df, "repo", "sha", F.col("item"), most=12, least=3, flush=50)
    got = {(x["group"], x.item_a, x.item_b): (x.n_ab, x.n_a, x.n_b, x.n) for x in out.collect()}
    assert got == _pairs(rows, 12, 3) and got
    assert cooccur.cooccurrence(df.limit(0), "repo", "sha", F.col("item")).count() == 0


# 2


def test_pieces_of_a_table(spark):
    rows = [(1, "short", "x"), (1, "short", "x"), (2, None, "x"), (3, "", "x"), (None, "y" * 50, "x"), (4, "a b " * 30, "x")]
    df = spark.createDataFrame(rows, "key int, body string, text string")
    out = split.split_items(df, "key", "body", 40, 5).distinct().collect()
    by = defaultdict(dict)
    for r in out:
        by[r.key][r.piece] = r.text
    assert by[1] == {1: "short"} and by[3] == {1: ""} and 2 not in by and set(by[None]) == {1, 2}
    assert "".join(t if n == 1 else t[5:] for n, t in sorted(by[4].items())) == "a b " * 30
    assert split.split_items(df.limit(0), "key", "body").count() == 0
    with pytest.raises(ValueError):
        split.split_items(df, "key", "body", 10, 10)


# 3


def test_parsed_files(spark):
    rows = [(1, "r", "a.go", "package a\n", True, "x"), (1, "r", "a.go", "package a\n", True, "x"), (2, "r", "b.go", "package", True, "x"), (3, None, "c.py", "x = (", True, "x"), (4, "r", "d.txt", "x", True, "x"), (5, "r", "e.py", None, True, "x"), (6, "r", "f.py", " \n", True, "x"), (7, "r", "g.py", "x = (", False, "x"), (8, "r", None, "x", True, "x"), (9, "r", "h.rs", "fn f() {}", None, "x")]
    df = spark.createDataFrame(rows, "file_id int, repo string, file string, source string, supported boolean, valid string")
    p = parsing.parsed(df, "file_id", "repo", "file", "source", "supported")
    assert {(r.key, r.valid) for r in p.collect()} == {(1, True), (2, False), (3, False)}
    assert {(r.repo, r.language): (r.files, r.invalid, r.share) for r in parsing.rates(p).collect()} == {("r", "go"): (2, 1, 0.5), (None, "python"): (1, 1, 1.0)}
    assert parsing.rates(parsing.parsed(df.limit(0), "file_id", "repo", "file", "source")).count() == 0


# 5


def _repeated(docs, least_docs, share, least):
    import re

    by, n = defaultdict(set), defaultdict(set)
    for s, d, t in docs:
        if s is None or d is None:
            continue
        n[s].add(d)
        for line in (t or "").split("\n") if t is not None else ():
            x = re.sub("[0-9]+", "#", re.sub(r"[ \t\r]+", " ", line.lower())).strip(" ")
            if len(x) >= least:
                by[s, x].add(d)
    return {(s, x, len(d)) for (s, x), d in by.items() if len(d) >= max(least_docs, share * len(n[s]))}


@pytest.mark.parametrize("copies", [1, 40])
def test_repeated_lines_against_brute_force(spark, copies):
    """Many copies of few documents and summaries with hardly any counters are too vague; then every line is counted."""
    few = {"slack": 0.0, "flush": 100} if copies > 1 else {}
    r = random.Random(4)
    docs = []
    for i in range(400):
        s = r.choice(["hot"] * 6 + ["b", "c", None])
        lines = [f"unique line number {r.random()} of the text" for _ in range(6)] + r.sample(["Share  this page\twith 3 friends", "share this page with 77 friends\r", "Copyright of the makers, all of it", "short", "Seen by hardly anybody at all here"], r.randint(0, 3))
        docs.append((s, i if r.random() < 0.99 else None, None if r.random() < 0.03 else "\n".join(lines)))
    df = spark.createDataFrame([(*d, "x", "y") for d in docs for _ in range(copies if d[1] is not None and d[1] % 50 == 0 else 1)], "src string, id int, md string, line string, hash string").repartition(4)
    got = {(x.source, x.line, x.docs) for x in repeated_lines.repeated(df, "src", "id", "md", **few).collect()}
    assert got == _repeated(docs, 4, 0.05, 20) and got
    assert repeated_lines.repeated(df.limit(0), "src", "id", "md").count() == 0


def test_lines_are_removed(spark):
    df = spark.createDataFrame([("a", "Keep\nSHARE this 5\tnow \r\nkeep\n", "x"), ("b", "share this # now", "x"), (None, "share this # now", "x"), ("a", None, "x"), ("a", "", "x")], "source string, md string, gone string")
    lines = spark.createDataFrame([("a", "share this # now")], "source string, line string")
    out = repeated_lines.without_lines(df, lines, "source", "md", "clean")
    assert [r.clean for r in out.collect()].count(None) == 1 and {r.clean for r in out.collect()} == {"Keep\nkeep\n", "share this # now", None, ""}
    assert out.columns == ["source", "md", "gone", "clean"]
    assert repeated_lines.without_lines(df, lines.limit(0), "source", "md", "clean").where("md <> clean").count() == 0


# 6


def test_articles_of_a_table(spark):
    page = "<body><nav><a href='/'>Home</a></nav><article><h1>Some title</h1><p>A sentence with several words in it.</p></article></body>"
    df = spark.createDataFrame([(1, page, "x"), (1, page, "x"), (2, None, "x"), (3, "", "x"), (None, page, "x"), (4, "<p>" + "long words here " * 100_000, "x")], "key int, raw string, block string")
    rows = page_content.article(df, "key", "raw").collect()
    assert {(r.key, r.position, r.block) for r in rows if r.key != 4} == {(k, i, b) for k in (1, None) for i, b in ((1, "Some title"), (2, "A sentence with several words in it."))}
    assert page_content.article(df.limit(0), "key", "raw").count() == 0


# 7


def test_leaks_of_a_table(spark, monkeypatch):
    monkeypatch.setattr(leakage, "BLOCK", 2)
    text = " ".join(f"w{i}" for i in range(40))
    items = spark.createDataFrame([(i, t, "x") for i, t in ((1, text), (1, text), (2, " ".join(f"q{i}" for i in range(40))), (3, None), (4, ""), (5, "short item of words that has nine in all"), (6, text + " more"))], "item int, passage string, doc string")
    docs = spark.createDataFrame([(1, "before " + text + " after", "x"), (1, "before " + text + " after", "x"), (2, None, "x"), (3, "", "x"), (None, text, "x"), (4, "a " * 500_000 + text, "x"), (5, " ".join(f"w{i}" for i in range(14)), "x")], "doc int, text string, item string")
    got = {(r.doc, r.item) for r in leakage.leaked(docs, items, "doc", "text", "item", "passage").collect()}
    assert got == {(d, i) for d in (1, None, 4) for i in (1, 6)}
    assert leakage.leaked(docs.limit(0), items, "doc", "text", "item", "passage").count() == 0
    assert leakage.leaked(docs, items.limit(0), "doc", "text", "item", "passage").count() == 0


# 8


def test_mixture_meets_its_shares(spark):
    r = random.Random(6)
    rows = [(i, r.choice(["Big"] * 8 + [" small-one "]), "word " * r.randint(1, 30)) for i in range(600)] + [(900, None, "x"), (901, "other", "x"), (902, "big", None), (903, "BIG", "")]
    docs = spark.createDataFrame([(*x, 5) for x in rows + rows[:30]], "doc_id int, source string, text string, tokens int")
    targets = spark.createDataFrame([("big", 0.7, 1), ("small_one", 0.25, 3), ("none", 0.05, 2), (None, 0.5, 1)], "source string, target_share double, max_repeats int")
    chosen, shares = mixture.mixture(docs, targets, "doc_id", "source", "text")
    chosen, shares = chosen.collect(), {x.source: x for x in shares.collect()}
    size = {}
    for i, _, t in rows:
        if t is not None:
            size[i] = len(mixture.encoding().encode_ordinary(t))
    assert len({c.doc for c in chosen}) == len(chosen) and all(c.tokens == size[c.doc] and 1 <= c.repeats <= (1 if c.source == "big" else 3) for c in chosen)
    for s in ("big", "small_one"):
        assert shares[s].tokens == sum(c.tokens * c.repeats for c in chosen if c.source == s)
    longest = max(size.values())
    total = shares["small_one"].tokens / 0.25
    assert abs(shares["big"].tokens - 0.7 * total) <= longest * 3 and shares["none"].tokens == 0 and shares["none"].short_of > 0
    again = {(c.doc, c.repeats) for c in mixture.mixture(docs.repartition(5), targets, "doc_id", "source", "text")[0].collect()}
    assert again == {(c.doc, c.repeats) for c in chosen}
    assert mixture.mixture(docs.limit(0), targets, "doc_id", "source", "text")[0].count() == 0
    assert mixture.mixture(docs, targets.limit(0), "doc_id", "source", "text")[1].count() == 0


def test_mixture_with_a_given_total(spark):
    docs = spark.createDataFrame([(i, "a", "one two three") for i in range(100)], "doc_id int, source string, text string")
    targets = spark.createDataFrame([("a", 1.0, 2)], "source string, target_share double, max_repeats int")
    chosen = mixture.mixture(docs, targets, "doc_id", "source", "text", total=450)[0].collect()
    assert sum(c.tokens * c.repeats for c in chosen) == 450 and Counter(c.repeats for c in chosen) == {2: 50, 1: 50}


# 9


def test_residue_of_a_table(spark):
    rows = [(1, "Dear {{ name }},", "p", "r"), (1, "Dear {{ name }},", "p", "r"), (2, None, None, None), (3, "", "p", "r"), (None, "# [Title]\n\nTBD\n", None, None), (4, "A real text about the cursor.", "docs/cursor.md", "r")]
    rows += [(10 + i, f"Something odd here today\n\nWrite to the help desk about Acme{i}.", f"docs/slug-{i}.md", "h") for i in range(3)]
    df = spark.createDataFrame([(*x, "x") for x in rows], "doc int, text string, path string, host string, kind string")
    got = {(r.doc, r.kind) for r in residue.residue(df, "doc", "text", "path", "host").collect()}
    assert {(1, "placeholder"), (None, "form")} <= got and not {d for d, _ in got} & {2, 3, 4}
    assert residue.residue(df.limit(0), "doc", "text", "path", "host").count() == 0


def test_copies_without_notice_words_at_any_length(spark):
    menu = "Start | Broker | Queue | Ledger"
    long = "\n\n".join(f"Sentence {k} of an explanation that wanders along quietly, one of those nobody ever reads." for k in range(20))
    rows = [(i, f"{menu}\n\n# Gone fishing\n\nTicket {i}77 for docs/{n}.md\n\n{long}", f"docs/{n}.md", "h") for i, n in enumerate(("broker", "queue", "ledger"))]
    rows += [(10 + i, "Gone fishing, back soon.", f"docs/{n}/index.html", "h") for i, n in enumerate(("broker", "queue", "ledger"))]
    rows += [(20 + i, "The same vendored text about brushes.", f"{n}/paint.md", "h") for i, n in enumerate(("a", "b", "c"))]
    rows += [(30 + i, "Shared words on ledgers, broker and queue.", f"docs/{n}.md", "h") for i, n in enumerate(("broker", "queue", "ledgers"))]
    rows += [(40 + i, "Gone sailing, back soon.", f"docs/{n}.md", f"host {i}") for i, n in enumerate(("broker", "queue", "ledger"))]
    df = spark.createDataFrame(rows, "doc int, text string, path string, host string")
    got = {(r.doc, r.kind) for r in residue.residue(df, "doc", "text", "path", "host").collect()}
    assert got == {(d, "copied notice") for d in (0, 1, 2, 10, 11, 12)}


def test_lines_removed_by_join_as_by_broadcast(spark, monkeypatch):
    rows = [(i, "s" if i % 3 else None, f"Share this page with a friend {i}\nText {i}\r\nshare this  page with a friend 7") for i in range(9)] + [(9, "s", None), (10, "t", "Share this page with a friend 1"), (10, "t", "Share this page with a friend 1"), (11, "s", "")]
    df = spark.createDataFrame(rows, "n int, source string, text string")
    lines = spark.createDataFrame([("s", "share this page with a friend #")], "source string, line string")
    got = []
    for most in (64_000_000, -1):
        monkeypatch.setattr(repeated_lines, "BROADCAST_BYTES", most)
        got.append(sorted(map(repr, repeated_lines.without_lines(df, lines, "source", "text", "clean").collect())))
    assert got[0] == got[1] and any("clean='Text 4\\r'" in x for x in got[0])
