"""Broken references: nulls, blanks, repeats, empty tables, clashing extra columns, cascades."""

from datetime import datetime

from quarryline.operators import references as R

T1, T2 = datetime(2024, 1, 1), datetime(2024, 2, 1)
ART = "id string, repo string, path string, aliases array<string>, updated_at timestamp_ntz, deleted_at timestamp_ntz, name string, ref string"
REL = "rel_key bigint, source_path string, relationship string, target string, resolved_path string, is_external boolean, declared_at timestamp_ntz, name string, path string"
PRO = "projection_key bigint, artifact_path string, unresolved_refs array<string>, projected_at timestamp_ntz, name string"
CON = "concept_key bigint, bundle string, path string, body string, updated_at timestamp_ntz, target string"


def _tables(spark, art=(), rel=(), pro=(), con=()):
    return tuple(spark.createDataFrame(list(r), s) for r, s in ((art, ART), (rel, REL), (pro, PRO), (con, CON)))


def _art(i, path, aliases=None, at=T1, gone=None):
    return (i, "r", path, aliases, at, gone, "x", "x")


def _rel(k, source, target, resolved=None, external=False):
    return (k, source, "related", target, resolved, external, T1, "x", "x")


def _found_set(spark, *tables):
    return [(r.record_table, r.record_key, r.ref) for r in R.orphans(*_tables(spark, *tables))[0].where("level = 0").collect()]


def test_empty_tables(spark):
    assert _found_set(spark) == []


def test_names_and_states(spark):
    art = [_art("A-1", "a.md", ["alias one", None]), _art("B-1", "b.md", None, T1), _art("B-1", "b.md", None, T2, T2), _art("B-1", "b.md", None, T2, T2), _art(None, "n.md"), _art("C-1", None)]
    rel = [_rel(1, "a.md", " a-1 "), _rel(2, "a.md", "ALIAS ONE"), _rel(3, "a.md", "B-1"), _rel(3, "a.md", "B-1"), _rel(4, "a.md", None), _rel(5, "a.md", "  "), _rel(6, "a.md", "nothing", external=True), _rel(7, "a.md", "A-1", "b.md"), _rel(8, None, "gone", None, None), _rel(None, "a.md", "gone")]
    pro = [(1, "a.md", ["A-1", "zz", "zz", None], T1, "x"), (2, "a.md", None, T1, "x"), (3, "a.md", [], T1, "x")]
    got = set(_found_set(spark, art, rel, pro))
    assert got == {("relationships", 3, "B-1"), ("relationships", 7, "b.md"), ("relationships", 8, "gone"), ("relationships", None, "gone"), ("projections", 1, "zz")}


def test_links(spark):
    body = "[a](/x/b.md) [b](../y/c.md#top) [c](./b.md) [d](d.md) [e](https://h/e.md) [f](mailto:a@b.md) [g](#g) [h](../../../up.md)\n```md\n[i](/in/fence.md)\n```\n~~~\n[j](k.md)\n~~~\n[k](k.txt) [l](/x/b.md)\n```\n[m](open.md)"
    con = [(1, "k", "x/a.md", body, T1, "t"), (2, "k", "x/b.md", None, T1, "t"), (3, "k", "y/c.md", "", T1, "t"), (4, "k", None, "[q](x/b.md) [r](no.md)", T1, "t"), (5, None, "z.md", "[s](z.md)", T1, "t")]
    assert set(_found_set(spark, (), (), (), con)) == {("concepts", 1, "d.md"), ("concepts", 1, "../../../up.md"), ("concepts", 4, "no.md"), ("concepts", 5, "z.md")}


def test_very_long_body(spark):
    body = "word " * 400_000 + "[a](gone.md)\n```\n" + "x\n" * 300_000
    assert _found_set(spark, (), (), (), [(1, "k", "a.md", body, T1, "t")]) == [("concepts", 1, "gone.md")]


def test_cascade_levels_and_cycles(spark):
    art = [_art(x, f"{x}.md") for x in "abcde"]
    rel = [_rel(1, "a.md", "missing"), _rel(2, "b.md", "a"), _rel(3, "c.md", "b"), _rel(4, "b.md", "c"), _rel(5, "d.md", "e")]
    refs, holders = R.orphans(*_tables(spark, art, rel))
    assert {(r.holder, r.level) for r in holders.collect()} == {("a.md", 0), ("b.md", 1), ("c.md", 2)}
    assert {(r.record_key, r.level) for r in refs.collect()} == {(1, 0), (2, 1), (3, 2), (4, 3)}
    report = {(r.kind, r.refs, r.records) for r in R.report(refs).collect()}
    assert report == {("direct", 1, 1), ("inherited", 3, 3)}


def test_hot_target(spark):
    rel = [_rel(k, "a.md", "HUB" if k % 3 else f"t{k}") for k in range(3000)]
    assert len(_found_set(spark, [_art("t0", "a.md")], rel)) == 2999
