"""The lines of Markdown texts, with what fences and sections make of them. Each text is taken whole, in one pass, without shuffle."""

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_HEADING = re.compile(r"^(#{1,6})[ \t]+(.*?)[ \t]*$")
_FENCE = re.compile(r"^\s*(```|~~~)")


def _walk(text: str) -> Iterator[tuple[int, str, bool, int, int]]:
    """(line number, line, fenced, heading depth or 0, number of headings so far)."""
    fence, sections = "", 0
    for n, line in enumerate(text.replace("\r\n", "\n").replace("\r", "\n").split("\n"), 1):
        m = _FENCE.match(line)
        if m:
            fenced = True
            fence = "" if fence == m[1] else fence or m[1]
        else:
            fenced = bool(fence)
        h = None if fenced else _HEADING.match(line)
        sections += h is not None
        yield n, line, fenced, len(h[1]) if h else 0, sections


def lines(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, line_no, line, fenced, depth, section): every line of every text that is not null."""
    rows = df.select(F.col(key).alias("key"), F.col(text).alias("text")).where("text IS NOT NULL")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 500):
                b = batch.slice(start, 500)
                at, columns = [], ([], [], [], [], [])
                for i, t in enumerate(b.column(1).to_pylist()):
                    for row in _walk(t):
                        at.append(i)
                        for c, v in zip(columns, row):
                            c.append(v)
                kinds = (pa.int32(), pa.string(), pa.bool_(), pa.int32(), pa.int32())
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(at, pa.int64())), *(pa.array(c, k) for c, k in zip(columns, kinds))], ["key", "line_no", "line", "fenced", "depth", "section"])

    return rows.mapInArrow(run, f"key {dict(rows.dtypes)['key']}, line_no int, line string, fenced boolean, depth int, section int")


def headings(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, line_no, depth, heading) of headings outside fences."""
    return lines(df, key, text).where("depth > 0").select("key", "line_no", "depth", F.regexp_replace("line", r"^#{1,6}[ \t]+|[ \t]+$", "").alias("heading"))


def sections(df: DataFrame, key: str, text: str, depth: int = 2) -> DataFrame:
    """(key, pos, name, body) of the sections under headings of ``depth``; sub-headings and fences stay in the body."""
    rows = df.select(F.col(key).alias("key"), F.col(text).alias("text")).where("text IS NOT NULL")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 500):
                b = batch.slice(start, 500)
                at, pos, names, bodies = [], [], [], []
                for i, t in enumerate(b.column(1).to_pylist()):
                    found: list[tuple[str, list[str]]] = []
                    for _, line, _, d, _ in _walk(t):
                        if 0 < d <= depth:
                            found.append((" ".join(_HEADING.match(line)[2].lower().split()) if d == depth else "", []))
                        elif found:
                            found[-1][1].append(line)
                    n = 0
                    for name, body in found:
                        if name:
                            n += 1
                            at.append(i)
                            pos.append(n)
                            names.append(name)
                            bodies.append("\n".join(body).strip())
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(at, pa.int64())), pa.array(pos, pa.int32()), pa.array(names, pa.string()), pa.array(bodies, pa.string())], ["key", "pos", "name", "body"])

    return rows.mapInArrow(run, f"key {dict(rows.dtypes)['key']}, pos int, name string, body string")
