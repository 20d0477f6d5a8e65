"""Queries over time and over rounds do the whole job."""

from datetime import datetime

from quarryline.plans import catalogue


def test_bundle_diff_by_time(spark, tmp_path):
    at = lambda day: datetime(2024, 1, day)
    rows = [(i, f"text {i}", "r", f"docs/{i}.md", at(1)) for i in range(9)]
    rows += [(100, "other", "r", "docs/0.md", at(29)), (101, "text 1", "r", "docs/1.md", at(29)), (102, "new", "r", "docs/new.md", at(31)), (103, "x", "r", "index.md", at(31)), (104, "old", "r", "docs/none.md", None), (105, "x", "q", "docs/2.md", at(30))]
    spark.createDataFrame(rows, "doc_id bigint, text string, repo string, path string, ingested_at timestamp").write.parquet(f"{tmp_path}/documents.parquet")
    got = {(r.path, r.change) for r in catalogue.QUERIES["b1_bundle_diff"](spark, str(tmp_path)).collect()}
    assert got == {("r/docs/0.md", "modified"), ("r/docs/new.md", "added"), ("q/docs/2.md", "added")}


def _ring(n, chord):
    return [(f"n{i:03}", f"n{(i + 1) % n:03}") for i in range(n)] + [(f"n{i:03}", f"n{i * i % chord:03}") for i in range(n) if i % 3]


def test_whole_rank_and_communities_run_to_the_end(spark, monkeypatch):
    """Ranks are steady within the tolerance, and labels have had 20 rounds, on graphs where 10 and 4 rounds are too few."""
    from quarryline.plans import code, knowledge

    edges = sorted({(a, b) for a, b in _ring(40, 17) if a != b})
    df = spark.createDataFrame(edges, "src string, dst string")
    monkeypatch.setattr(knowledge, "_links", lambda s, d: df)
    monkeypatch.setattr(code, "_graph", lambda s, d: df)
    nodes = sorted({x for e in edges for x in e})
    out = {x: [b for a, b in edges if a == x] for x in nodes}
    rank = dict.fromkeys(nodes, 1 / len(nodes))
    for _ in range(300):
        dead = sum(rank[x] for x in nodes if not out[x])
        new = dict.fromkeys(nodes, (0.15 + 0.85 * dead) / len(nodes))
        for a, b in edges:
            new[b] += 0.85 * rank[a] / len(out[a])
        rank = new
    for name in ("g5_pagerank", "g5_code_rank"):
        got = {r.id: r.rank for r in catalogue.QUERIES[name](spark, "").collect()}
        assert sum(abs(got[x] - rank[x]) for x in nodes) < 1e-5
    chain = [(f"n{i:03}", f"n{i + 1:03}") for i in range(30)]
    df = spark.createDataFrame(chain, "src string, dst string")
    near = {x: [b for a, b in chain if a == x] + [a for a, b in chain if b == x] for x in {x for e in chain for x in e}}

    def labels(rounds):
        at = {x: x for x in near}
        for _ in range(rounds):
            votes = {x: [at[x], *(at[y] for y in near[x])] for x in near}
            at = {x: min(v, key=lambda c: (-v.count(c), c)) for x, v in votes.items()}
        return at

    assert labels(4) != labels(20)
    assert {r.id: r.label for r in catalogue.QUERIES["g6_communities"](spark, "").collect()} == labels(20)
