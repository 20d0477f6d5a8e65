"""Literal cases of the change log."""

import math

from quarryline.operators import changes as C

DAY, T = 86_400, 1_700_000_000
S = "repo string, sha string, author string, ts bigint, subject string, path string, added bigint, deleted bigint"


def _log(spark, rows):
    return spark.createDataFrame([("r", f"s{i}", a, t, sub, p, x, y) for i, (a, t, sub, p, x, y) in enumerate(rows)], S)


def test_windows_and_churn(spark):
    log = _log(spark, [("ann", T, "", "a.go", 10, 0), ("ann", T - 40 * DAY, "", "a.go", 5, 1), ("ann", T - 100 * DAY, "", "a.go", 2, 0)])
    w = C.windows(log).first()
    assert (w.commits, w.commits_30, w.commits_90, w.age_days) == (3, 1, 2, 100)
    c = C.line_churn(log).first()
    assert (c.added, c.deleted) == (17, 1)


def test_owner_and_bus_factor(spark):
    log = _log(spark, [("ann", T - i, "", "a", 1, 0) for i in range(4)] + [("bob", T - 9, "", "a", 1, 0)] + [(x, T, "", "b", 1, 0) for x in "xyz"] + [(None, T, "", "c", 1, 0)])
    own = {r.path: r for r in C.ownership(log).collect()}
    assert (own["a"].owner, own["a"].share, own["a"].authors) == ("ann", 0.8, 2) and own["b"].owner == "x" and "c" not in own
    assert {r.path: r.bus_factor for r in C.bus_factor(log).collect()} == {"a": 1, "b": 3}


def test_entropy(spark):
    log = _log(spark, [("a", T, "", "even", 4, 0), ("a", T, "", "even", 0, 4), ("a", T, "", "one", 7, 0), ("a", T, "", "none", 0, 0)])
    assert {r.path: r.entropy for r in C.change_entropy(log).collect()} == {"even": 1.0, "one": 0.0}


def test_defect_words_are_whole(spark):
    log = _log(spark, [("a", T, "Fix it", "a", 1, 0), ("a", T, "prefix only", "a", 1, 0), ("a", T, None, "a", 1, 0), ("a", T, "a bug: closed", "a", 1, 0)])
    assert C.prior_defects(log).first().defects == 2


def test_recent_file_is_hotter(spark):
    log = _log(spark, [("a", T, "", "x", 0, 0), ("a", T - 5 * DAY, "", "new", 100, 0), ("a", T - 300 * DAY, "", "old", 100, 0)])
    hot = {r.path: r.hotspot for r in C.temporal_hotspot(log).collect()}
    assert hot["new"] > hot["old"] and math.isclose(hot["old"], math.exp(-math.log(2) * 300 / 180), abs_tol=1e-6)


def test_log_keeps_the_last_record(spark):
    import datetime as dt

    s = "repo string, sha string, author string, ts bigint, subject string, path string, added int, deleted int, recorded_at timestamp_ntz"
    a, b = dt.datetime(2024, 1, 1), dt.datetime(2024, 1, 2)
    rows = [("r", "s", "Ann Lee", T, "x", "./p\\q.go", 1, None, a), ("r", "s", "ann.lee@m.example", T, "x", "p/q.go", 5, None, b), ("r", "s", "x", T, "x", None, 5, 1, b)]
    r = C.log(spark.createDataFrame(rows, s)).collect()
    assert len(r) == 1 and (r[0].path, r[0].author, r[0].added, r[0].deleted) == ("p/q.go", "ann.lee", 5, 0)


def test_percentile_needs_enough_scores(spark):
    few = spark.createDataFrame([("r", str(i), float(i)) for i in range(19)], "repo string, sha string, score double")
    assert C.risk_percentile(few).where("percentile IS NOT NULL").count() == 0
    many = spark.createDataFrame([("r", str(i), i / 10) for i in range(1, 101)], "repo string, sha string, score double")
    p = {round(r.score, 1): r.priority for r in C.risk_percentile(many).collect()}
    assert (p[9.5], p[5.0], p[1.0]) == ("elevated", "typical", "below typical")


def test_numstat(spark):
    rows = spark.createDataFrame([("10\t2\tpkg/a/x.go",), ("-\t-\tlogo.png",)], "line string")
    assert sorted((r.path, r.added, r.deleted) for r in C.parse_numstat(rows, "line").collect()) == [("logo.png", 0, 0), ("pkg/a/x.go", 10, 2)]
    assert C.parse_numstat(rows, "line", (".go",)).count() == 1


def test_features(spark):
    log = spark.createDataFrame([("r", "s", "a", T, "", "pkg/a/x.go", 10, 2), ("r", "s", "a", T, "", "pkg/b/y.go", 5, 0), ("r", "s", "a", T, "", "assets/logo.png", 0, 0)], S)
    f = C.features(log).first()
    assert (f.la, f.ld, f.nf, f.nd, f.ns) == (15, 2, 3, 3, 2)


def test_empty_log(spark):
    log = spark.createDataFrame([], S)
    for f in (C.windows, C.ownership, C.bus_factor, C.change_entropy, C.co_change, C.hotspots, C.modules, C.features, C.missing_cochanges):
        assert f(log).count() == 0
