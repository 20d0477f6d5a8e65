"""Folders, frontmatter, commit logs."""

import pytest

from quarryline.sources import files as S


def test_import_of_a_folder(spark, tmp_path):
    for name, text in (("a.md", "# A\r\nx"), ("sub/b.txt", "b"), ("sub/index.md", "# I"), (".git/c.md", "c"), ("d.bin", "d"), ("node_modules/e.md", "e")):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(text.encode())
    assert {r.path for r in S.listed(spark, str(tmp_path)).collect()} == {"a.md", "sub/b.txt", "sub/index.md", "d.bin"}
    assert {(r.path, r.content_type, r.text) for r in S.imported(spark, str(tmp_path), exclude=["**index.md"]).collect()} == {("a.md", "markdown", "# A\nx"), ("sub/b.txt", "text", "b")}
    with pytest.raises(ValueError):
        S.imported(spark, str(tmp_path), include=["none/*"])
    (tmp_path / "f.md").write_text("---\ntitle: F\ntags: [a, b]\n---\n# F\n")
    (tmp_path / "g.md").write_text("---\n: [\n---\n# G\n")
    assert {(r.path, r.fields.get("title"), r.body) for r in S.bundle(spark, str(tmp_path)).collect()} == {("a.md", None, "# A\nx"), ("f.md", "F", "# F\n")}


@pytest.mark.parametrize("text,issues", [
    ("---\nid: A\nschema_version: 1\n---\nx", []), ("no frontmatter", []), ("---\nid: A\nid: B\n---\n", ["frontmatter_duplicate_key"]), ("---\nother: 1\n---\n", ["frontmatter_unknown_field"]),
    ("---\nid: &a x\ntype: *a\n---\n", ["frontmatter_bomb"]), ("---\nid: " + "[" * 40 + "]" * 40 + "\n---\n", ["frontmatter_bomb"]), ("---\nid: [\n---\n", ["malformed_frontmatter"]),
    ("---\n- a\n---\n", ["malformed_frontmatter"]), ("---\nid: " + "x" * 70_000 + "\n---\n", ["frontmatter_too_large"]), ("---\nschema_version: 9\n---\n", ["unsupported_schema_version"]), ("---\n---\nx", []),
])
def test_strict_frontmatter(text, issues):
    assert S._strict(text, frozenset(["id", "type", "schema_version"]), frozenset([1]))[2] == issues


def test_frontmatter_of_a_table(spark):
    df = spark.createDataFrame([(1, "---\nid: A\ntags: [x]\n---\nbody"), (2, None), (3, "")], "k int, t string")
    assert {(r.key, r.fields.get("tags"), r.body) for r in S.frontmatter(df, "k", "t", []).collect()} == {(1, "[x]", "body"), (3, None, "")}


def test_commit_log_in_files(spark, tmp_path):
    (tmp_path / "one.log").write_text("\x1es1\x1fAnn\x1f100\x1fFix it\n3\t1\ta/b.go\n-\t-\tx.png\n\x1es2\x1fBob\x1f200\x1fMore\n\n5\t0\tc.go\n")
    assert {(r.sha, r.ts, r.path, r.added, r.deleted) for r in S.commit_log(spark, str(tmp_path)).collect()} == {("s1", 100, "a/b.go", 3, 1), ("s1", 100, "x.png", 0, 0), ("s2", 200, "c.go", 5, 0)}
