"""Source files that do not parse, by packrat parsers for the language of the file ending.

A file is valid if the grammar of its ending consumes all of it. Otherwise the furthest place at which no alternative
could go on is reported with the likely cause: a merge conflict near that place, an end of file before the text is
complete, a text that another of the grammars accepts as a whole, or an unexpected token.

Parsing is per file: no shuffle. Rates are one aggregation with partial sums.

Defined results. Files whose ending stands for no language, that are not supported, or whose source is null or blank are
not checked. A file nested deeper than the parser's stack is reported by the place it failed at, with the cause
'nesting'. Repeated rows count once in the rates. A null repository is a group of its own. Further columns are not read.
"""

import gc
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarryline.llm import grammars

#: The language that a file ending stands for. (fixed values)
ENDINGS = {"go": "go", "java": "java", "js": "javascript", "py": "python", "rs": "rust", "ts": "typescript", "tsx": "tsx"}

_MARKER = re.compile(r"^(?:<{7}|={7}|>{7}|\|{7})(?:[ \r].*)?$|^@@ .* @@", re.M)
_NEAR = 400
_SCHEMA = "key {}, repo string, language string, valid boolean, line int, col int, found string, cause string, accepted_as string"


def valid(language: str, text: str) -> bool:
    """Whether the grammar of a language consumes all of a text."""
    try:
        return grammars.check(language, text, trace=False) is None
    except RecursionError:
        return False


def defect(language: str, text: str) -> tuple[int, int, str, str, str | None] | None:
    """(line, column, token found, cause, language that accepts it) of an invalid text; None if it is valid."""
    try:
        at = grammars.check(language, text)
    except RecursionError:
        return 1, 1, "", "nesting", None
    if at is None:
        return None
    place, found = at
    before = text[:place]
    line, column = before.count("\n") + 1, place - before.rfind("\n")
    other = None
    if any(abs(m.start() - place) <= _NEAR for m in _MARKER.finditer(text)):
        cause = "conflict"
    elif found in ("end of file", "open comment", "open string", "open template", "open brace", "open tag") or text.startswith("/*", place):
        cause = "truncated"
    else:
        cause = "token"
        for name in grammars.LANGUAGES:
            try:
                if name != language and grammars.check(name, text) is None:
                    cause, other = "language", name
                    break
            except RecursionError:
                pass
    return line, column, found[:80], cause, other


def _uncollected(n: int = 200):
    """Calls a function on pairs without the garbage collector, which is run after every ``n``: a parse makes many small objects."""

    def run(f, pairs):
        gc.disable()
        try:
            for k, pair in enumerate(pairs, 1):
                yield f(*pair)
                if not k % n:
                    gc.collect()
        finally:
            gc.enable()

    return run


def _check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        languages = [ENDINGS[e] for e in b.column(2).to_pylist()]
        ok = list(_uncollected()(valid, zip(languages, b.column(3).to_pylist())))
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(languages, pa.string()), pa.array(ok, pa.bool_())], ["key", "repo", "language", "valid"])


def _run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, 2000):
            b = batch.slice(at, 2000)
            rows = list(_uncollected()(defect, zip(map(ENDINGS.get, b.column(2).to_pylist()), b.column(3).to_pylist())))
            column = lambda i, kind: pa.array([r and r[i] for r in rows], kind)
            languages = pa.array([ENDINGS[e] for e in b.column(2).to_pylist()], pa.string())
            valid = pa.array([r is None for r in rows], pa.bool_())
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), languages, valid, column(0, pa.int32()), column(1, pa.int32()), column(2, pa.string()), column(3, pa.string()), column(4, pa.string())],
                ["key", "repo", "language", "valid", "line", "col", "found", "cause", "accepted_as"],
            )


def parsed(df: DataFrame, key: str, repo: str, file: str, source: str, supported: str | None = None, why: bool = True) -> DataFrame:
    """(key, repo, language, valid, line, col, found, cause, accepted_as) of every file that can be checked; without ``why`` the first four."""
    rows = df.where(F.col(supported)) if supported else df
    rows = rows.select(F.col(key).alias("key"), F.col(repo).cast("string").alias("repo"), F.lower(F.regexp_extract(F.col(file), r"\.([^./\\]+)$", 1)).alias("ending"), F.col(source).alias("source"))
    rows = rows.where(F.col("ending").isin(*ENDINGS) & F.col("source").rlike(r"\S"))
    schema = _SCHEMA.format(dict(rows.dtypes)["key"])
    return rows.mapInArrow(_run, schema) if why else rows.mapInArrow(_check, schema[: schema.index(", line")])


def rates(files: DataFrame) -> DataFrame:
    """(repo, language, files, invalid, share) of the result of ``parsed``."""
    once = files.select("repo", "language", "key", "valid").distinct()
    counts = once.groupBy("repo", "language").agg(F.count("*").alias("files"), F.count_if(~F.col("valid")).alias("invalid"))
    return counts.withColumn("share", F.round(F.col("invalid") / F.col("files"), 6))
