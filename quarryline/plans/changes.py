"""Queries on the change log, with their SQL."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarryline.operators import changes as C
from quarryline.operators import governance as V
from quarryline.sources import table


def _log(spark: SparkSession, d: str) -> DataFrame:
    return C.log(table(spark, d, "changes"))


def _q(f, *more):
    return lambda spark, d: f(_log(spark, d), *more)


def _h1(spark: SparkSession, d: str) -> DataFrame:
    """Log text made from the table, parsed again."""
    rows = _log(spark, d).where("subject IS NOT NULL AND author IS NOT NULL")
    head = F.concat_ws("\x1f", "sha", "author", F.col("ts").cast("string"), "subject")
    text = rows.select(F.concat(F.lit("\x1e"), head, F.lit("\n"), F.concat_ws("\t", F.col("added").cast("string"), F.col("deleted").cast("string"), "path")).alias("text"))
    return C.parse_log(text, "text")


def _h14(spark: SparkSession, d: str) -> DataFrame:
    files = table(spark, d, "source_files").select("repo", F.col("file").alias("path")).distinct()
    return C.ownership_at(_log(spark, d), files)


def _scored(spark: SparkSession, d: str) -> DataFrame:
    rows = _log(spark, d)
    return C.risk_score(C.features(rows).join(C.author_experience(rows), ["repo", "sha"]))


def _history(spark: SparkSession, d: str) -> DataFrame:
    rows = _log(spark, d)
    out = C.windows(rows)
    for more in (C.ownership(rows), C.change_entropy(rows), C.bus_factor(rows), C.prior_defects(rows)):
        out = out.join(more, C.FILE, "left")
    return V.history_findings(out)


QUERIES = {
    "e5_history_findings": _history,
    "h1_parse_log": _h1,
    "h2_windowed_walk": _q(C.window_info),
    "h3_commit_windows": _q(C.windows),
    "h4_line_churn": _q(C.line_churn),
    "h5_temporal_hotspot": _q(C.temporal_hotspot),
    "h6_ownership": _q(C.ownership),
    "h7_bus_factor": _q(C.bus_factor),
    "h8_change_entropy": _q(C.change_entropy),
    "h9_prior_defects": _q(C.prior_defects),
    "h10_co_change": _q(C.co_change),
    "h10_partners": _q(C.partners),
    "h11_churn_percentile": _q(C.churn_rank),
    "h12_hotspots": _q(C.hotspots),
    "h13_modules": _q(C.modules),
    "h14_ownership_at": _h14,
    "h15_author_commits": _q(C.author_experience),
    "h16_last_modified": _q(C.last_modified),
    "x2_change_features": _q(C.features),
    "x4_score": lambda s, d: _scored(s, d).select("repo", "sha", "score"),
    "x5_drivers": lambda s, d: C.risk_drivers(C.features(_log(s, d)).join(C.author_experience(_log(s, d)), ["repo", "sha"])),
    "x6_baseline_scores": _q(C.risk_baseline),
    "x7_percentile": lambda s, d: C.risk_percentile(C.risk_baseline(_log(s, d))),
    "x8_missing_tests": _q(C.missing_tests),
    "x10_missing_cochanges": _q(C.missing_cochanges),
}

LOG = r"""
WITH raw AS (SELECT repo, sha, regexp_replace(split_part(lower(trim(author)), '@', 1), '\s+', '.', 'g') AS author, ts, subject,
  regexp_replace(replace(path, '\', '/'), '^\./', '') AS path, added, deleted, recorded_at FROM changes WHERE repo IS NOT NULL AND sha IS NOT NULL AND path IS NOT NULL),
log AS (SELECT repo, sha, author, ts, subject, path, CAST(coalesce(added, 0) AS BIGINT) AS added, CAST(coalesce(deleted, 0) AS BIGINT) AS deleted FROM (
  SELECT *, row_number() OVER (PARTITION BY repo, sha, path ORDER BY recorded_at DESC, added DESC NULLS LAST, deleted DESC NULLS LAST) AS rn FROM raw) WHERE rn = 1),
o AS (SELECT repo, max(ts) AS as_of FROM log GROUP BY 1),
l AS (SELECT log.*, o.as_of FROM log JOIN o USING (repo))"""
_WIN = """, win AS (SELECT repo, path, count(*) AS commits, count(*) FILTER (WHERE ts >= as_of - 30 * 86400) AS commits_30, count(*) FILTER (WHERE ts >= as_of - 90 * 86400) AS commits_90,
  min(ts) AS first_ts, max(ts) AS last_ts, CAST(floor((max(as_of) - min(ts)) / 86400) AS BIGINT) AS age_days FROM l GROUP BY 1, 2)"""
_HOT = """, hot AS (SELECT repo, path, round(sum(exp(-ln(2) * greatest(0.0, (as_of - ts) / 86400.0) / 180) * least((added + deleted) / 100.0, 3.0)), 6) AS hotspot FROM l GROUP BY 1, 2)"""
_OWN = """, a AS (SELECT repo, path, author, count(*) AS n FROM l WHERE author IS NOT NULL GROUP BY 1, 2, 3),
own AS (SELECT * FROM (SELECT repo, path, author AS owner, round(n / sum(n) OVER w, 6) AS share, count(*) OVER w AS authors, row_number() OVER (PARTITION BY repo, path ORDER BY n DESC, author) AS rn FROM a WINDOW w AS (PARTITION BY repo, path)) WHERE rn = 1),
ra AS (SELECT repo, path, author, count(*) AS n FROM l WHERE author IS NOT NULL AND ts >= as_of - 90 * 86400 GROUP BY 1, 2, 3),
rown AS (SELECT * FROM (SELECT repo, path, author AS recent_owner, row_number() OVER (PARTITION BY repo, path ORDER BY n DESC, author) AS rn FROM ra) WHERE rn = 1),
bus AS (SELECT repo, path, min(rank) AS bus_factor FROM (SELECT repo, path, row_number() OVER w AS rank, sum(n) OVER (PARTITION BY repo, path ORDER BY n DESC, author ROWS UNBOUNDED PRECEDING) AS s, sum(n) OVER (PARTITION BY repo, path) AS t FROM a WINDOW w AS (PARTITION BY repo, path ORDER BY n DESC, author)) WHERE s >= 0.8 * t GROUP BY 1, 2)"""
_RANK = """, ranked AS (SELECT repo, path, hotspot, commits, commits_90, round((row_number() OVER (PARTITION BY repo ORDER BY hotspot, commits_90, path DESC) - 1) / count(*) OVER (PARTITION BY repo), 6) AS percentile FROM hot JOIN win USING (repo, path)),
flag AS (SELECT *, percentile >= 0.75 AND commits >= 5 AND commits_90 >= 2 AS is_hotspot FROM ranked)"""
_MOD = "CASE WHEN path LIKE '%/%' THEN split_part(path, '/', 1) ELSE '' END"
_CO = """, few AS (SELECT repo, sha FROM log GROUP BY 1, 2 HAVING count(*) BETWEEN 2 AND 50), k AS (SELECT repo, sha, path FROM log SEMI JOIN few USING (repo, sha)),
two AS (SELECT a.repo, a.path, b.path AS partner, count(*) AS n FROM k a JOIN k b ON a.repo = b.repo AND a.sha = b.sha AND a.path < b.path GROUP BY 1, 2, 3),
co AS (SELECT * FROM two UNION ALL SELECT repo, partner, path, n FROM two)"""
_FEAT = r""", churn AS (SELECT *, added + deleted AS c FROM log),
feat AS (SELECT repo, sha, CAST(sum(added) AS BIGINT) AS la, CAST(sum(deleted) AS BIGINT) AS ld, count(*) AS nf, count(DISTINCT CASE WHEN path LIKE '%/%' THEN regexp_replace(path, '/[^/]*$', '') ELSE '' END) AS nd, count(DISTINCT split_part(path, '/', 1)) AS ns,
  CASE WHEN count(*) FILTER (WHERE c > 0) < 2 THEN 0 ELSE round(log2(sum(c) FILTER (WHERE c > 0)) - sum(c * log2(c)) FILTER (WHERE c > 0) / sum(c) FILTER (WHERE c > 0), 6) END AS entropy FROM churn GROUP BY 1, 2),
cm AS (SELECT repo, sha, max(author) AS author, max(ts) AS ts FROM log GROUP BY 1, 2),
exper AS (SELECT repo, sha, CASE WHEN author IS NOT NULL THEN count(*) OVER (PARTITION BY repo, author ORDER BY ts RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) END AS experience FROM cm)"""


def _c(name: str) -> str:
    w, m, s = C.NEUTRAL_MODEL["features"][name]
    x = name if name == "entropy" else f"ln(1 + CAST({name} AS DOUBLE))"
    return f"coalesce({w} * ({x} - {m}) / {s}, 0)"


_LOGIT = " + ".join(_c(n) for n in C.NEUTRAL_MODEL["features"])
_BASE = f""", nw AS (SELECT * FROM (SELECT repo, sha, row_number() OVER (PARTITION BY repo ORDER BY ts DESC, sha) AS rn FROM cm) WHERE rn <= 200),
base AS (SELECT repo, sha, round(10 / (1 + exp(-({" + ".join(_c(n) for n in C.NEUTRAL_MODEL["features"] if n != "experience")}))), 1) AS score FROM feat SEMI JOIN nw USING (repo, sha))"""

_MARKS = (("churn_risk", "commits >= 20"), ("change_entropy", "entropy >= 2.5"), ("ownership_risk", "authors >= 2 AND share < 0.5"), ("code_age_volatility", "age_days >= 365 AND commits_90 >= 3"), ("developer_congestion", "authors >= 5"), ("knowledge_loss", "bus_factor = 1 AND commits >= 5"), ("prior_defect", "defects >= 2"))

SQL = {
    "h1_parse_log": LOG + " SELECT sha, author, ts, subject, path, added, deleted FROM log WHERE subject IS NOT NULL AND author IS NOT NULL",
    "h2_windowed_walk": LOG + " SELECT repo, max(ts) AS as_of, least(count(DISTINCT sha), 1000) AS commits, count(DISTINCT sha) > 1000 AS capped FROM log GROUP BY 1",
    "h3_commit_windows": LOG + _WIN + " SELECT * FROM win",
    "h4_line_churn": LOG + " SELECT repo, path, CAST(sum(added) AS BIGINT) AS added, CAST(sum(deleted) AS BIGINT) AS deleted FROM log GROUP BY 1, 2",
    "h5_temporal_hotspot": LOG + _HOT + " SELECT * FROM hot",
    "h6_ownership": LOG + _OWN + " SELECT repo, path, owner, share, authors, recent_owner FROM own LEFT JOIN rown USING (repo, path)",
    "h7_bus_factor": LOG + _OWN + " SELECT * FROM bus",
    "h8_change_entropy": LOG + """, c AS (SELECT repo, path, added + deleted AS c FROM log WHERE added + deleted > 0)
  SELECT repo, path, CASE WHEN count(*) < 2 THEN 0 ELSE round(log2(sum(c)) - sum(c * log2(c)) / sum(c), 6) END AS entropy FROM c GROUP BY 1, 2""",
    "h9_prior_defects": LOG + f" SELECT repo, path, count(*) AS defects FROM log WHERE regexp_matches(lower(subject), '(^|[^a-z])({'|'.join(C.DEFECT_WORDS)})([^a-z]|$)') GROUP BY 1, 2",
    "h10_co_change": LOG + _CO + " SELECT * FROM co",
    "h10_partners": LOG + _CO + " SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY repo, path ORDER BY n DESC, partner) AS rank FROM co) WHERE rank <= 5",
    "h11_churn_percentile": LOG + _WIN + _HOT + _RANK + " SELECT * FROM flag",
    "h12_hotspots": LOG + _WIN + _HOT + _RANK + " SELECT repo, path, hotspot, percentile, commits, commits_90, row_number() OVER (PARTITION BY repo ORDER BY hotspot DESC, path) AS rank FROM flag WHERE is_hotspot",
    "h13_modules": LOG + _WIN + _HOT + _RANK + _OWN + f""", ma AS (SELECT repo, {_MOD} AS module, author, count(*) AS n FROM log WHERE author IS NOT NULL GROUP BY 1, 2, 3),
  mo AS (SELECT * FROM (SELECT repo, module, author AS owner, row_number() OVER (PARTITION BY repo, module ORDER BY n DESC, author) AS rn FROM ma) WHERE rn = 1),
  m AS (SELECT repo, {_MOD} AS module, count(*) AS files, count(*) FILTER (WHERE is_hotspot) AS hotspots, round(avg(commits), 6) AS mean_commits, quantile_disc(coalesce(bus_factor, 0), 0.5) AS bus_factor FROM flag LEFT JOIN bus USING (repo, path) GROUP BY 1, 2)
  SELECT repo, module, files, hotspots, mean_commits, bus_factor, round(hotspots / files, 6) AS density, owner FROM m LEFT JOIN mo USING (repo, module)""",
    "h14_ownership_at": LOG + _OWN + f""", ma AS (SELECT repo, {_MOD} AS module, author, count(*) AS n FROM log WHERE author IS NOT NULL GROUP BY 1, 2, 3),
  mo AS (SELECT * FROM (SELECT repo, module, author AS of_module, row_number() OVER (PARTITION BY repo, module ORDER BY n DESC, author) AS rn FROM ma) WHERE rn = 1),
  s AS (SELECT DISTINCT repo, file AS path FROM source_files), q AS (SELECT repo, path, {_MOD} AS module FROM s)
  SELECT q.repo, q.path, coalesce(owner, of_module) AS owner, CASE WHEN owner IS NOT NULL THEN 'file' WHEN of_module IS NOT NULL THEN 'module' ELSE 'none' END AS level FROM q LEFT JOIN own ON q.repo = own.repo AND q.path = own.path LEFT JOIN mo ON q.repo = mo.repo AND q.module = mo.module""",
    "h15_author_commits": LOG + _FEAT + " SELECT * FROM exper",
    "h16_last_modified": LOG + " SELECT repo, path, max(ts) AS last_ts, make_timestamp(max(ts) * 1000000) AS last_modified FROM log GROUP BY 1, 2",
    "x2_change_features": LOG + _FEAT + " SELECT * FROM feat",
    "x4_score": LOG + _FEAT + f" SELECT repo, sha, round(10 / (1 + exp(-({_LOGIT}))), 1) AS score FROM feat JOIN exper USING (repo, sha)",
    "x5_drivers": LOG + _FEAT + ", d AS (" + " UNION ALL ".join(f"SELECT repo, sha, '{n}' AS driver, round({_c(n)}, 9) AS contribution FROM feat JOIN exper USING (repo, sha)" for n in C.NEUTRAL_MODEL["features"])
    + ") SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY repo, sha ORDER BY abs(contribution) DESC, driver) AS rank FROM d) WHERE rank <= 3",
    "x6_baseline_scores": LOG + _FEAT + _BASE + " SELECT * FROM base",
    "x7_percentile": LOG + _FEAT + _BASE + """, r AS (SELECT *, CASE WHEN count(*) OVER (PARTITION BY repo) >= 20 THEN round(100.0 * (rank() OVER (PARTITION BY repo ORDER BY score) - 1 + 0.5 * count(*) OVER (PARTITION BY repo, score)) / count(*) OVER (PARTITION BY repo), 6) END AS percentile FROM base)
  SELECT *, CASE WHEN percentile >= 200.0 / 3 THEN 'elevated' WHEN percentile >= 100.0 / 3 THEN 'typical' WHEN percentile IS NOT NULL THEN 'below typical' END AS priority FROM r""",
    "x8_missing_tests": LOG + r""", f AS (SELECT repo, sha, path, regexp_extract(path, '([^/]*)\.([^./]+)$', 1) AS stem, regexp_extract(path, '\.([^./]+)$', 1) AS ext, regexp_extract(path, '([^/]*)$', 1) AS name,
  regexp_matches(path, '_test\.go$|(^|/)test_[^/]*\.py$|_test\.py$|Tests?\.java$|\.(test|spec)\.(ts|tsx|js|jsx)$|(^|/)(tests?|__tests__)/') AS test FROM log),
  w AS (SELECT repo, sha, path, unnest(CASE WHEN ext = 'go' THEN [stem || '_test.go'] WHEN ext = 'py' THEN ['test_' || stem || '.py', stem || '_test.py'] WHEN ext = 'java' THEN [stem || 'Test.java', stem || 'Tests.java']
    WHEN ext IN ('ts', 'tsx', 'js', 'jsx') THEN [stem || '.test.' || ext, stem || '.spec.' || ext] END) AS name FROM f WHERE NOT test)
  SELECT repo, sha, path FROM w GROUP BY 1, 2, 3 HAVING NOT bool_or(EXISTS (SELECT 1 FROM f WHERE f.repo = w.repo AND f.sha = w.sha AND f.name = w.name))""",
    "x10_missing_cochanges": LOG + _FEAT + _CO + """, nw AS (SELECT repo, sha FROM (SELECT repo, sha, row_number() OVER (PARTITION BY repo ORDER BY ts DESC, sha) AS rn FROM cm) WHERE rn = 1),
  t AS (SELECT repo, sha, path FROM log SEMI JOIN nw USING (repo, sha)),
  ab AS (SELECT t.repo, t.sha, t.path, co.partner, co.n FROM t JOIN co ON co.repo = t.repo AND co.path = t.path WHERE co.n >= 2 AND NOT EXISTS (SELECT 1 FROM t u WHERE u.repo = co.repo AND u.path = co.partner))
  SELECT repo, sha, path, partner, n FROM (SELECT *, row_number() OVER (PARTITION BY repo, path ORDER BY n DESC, partner) AS rn FROM ab) WHERE rn <= 5""",
}
_ENT = SQL["h8_change_entropy"].split(", c AS (", 1)[1]
SQL["e5_history_findings"] = (
    LOG + _WIN + _OWN + ", c AS (" + _ENT.split("\n", 1)[0] + ", ent AS (" + _ENT.split("\n", 1)[1].strip() + "), def AS (" + SQL["h9_prior_defects"].removeprefix(LOG).strip() + """),
  hist AS (SELECT win.repo, win.path, commits, commits_90, age_days, share, authors, entropy, bus_factor, defects FROM win LEFT JOIN own USING (repo, path) LEFT JOIN ent USING (repo, path) LEFT JOIN bus USING (repo, path) LEFT JOIN def USING (repo, path)) """
    + " UNION ALL ".join(f"SELECT repo, path, '{m}' AS marker FROM hist WHERE {w}" for m, w in _MARKS)
)
