"""Splitting oversized items at natural boundaries, with an overlap between consecutive pieces.

A text is split by a hierarchy of separators: sections (headings outside code fences), paragraphs, lines, sentences,
words, characters. A part that fits is never split further; parts are then packed greedily. Every piece after the first
opens with the last ``overlap`` characters of the piece before it, so the text is the first piece followed by every
further piece without its first ``overlap`` characters, exactly. A piece that would hold less than a third of what fits
takes of the next part what fits, cut by the same hierarchy.

Lengths are in code points. A text that is within the limit is one piece. Null texts give no piece; an empty text gives
one empty piece. Repeated rows give repeated pieces, which the queries make distinct. Further columns are not read.
"""

import re
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_FENCE = re.compile(r"[ ]{0,3}(```+|~~~+)")
_LEVELS = (
    re.compile(r"\r?\n(?:[ \t]*\r?\n)+"),  # after blank lines
    re.compile(r"\r?\n|\r"),  # after a line
    re.compile(r"[.!?…]+[\"'”’)\]]*\s+|[。！？]+[\"'”’)\]）」』]*\s*"),  # after a sentence; in Chinese and Japanese no blank follows
    re.compile(r"\s+"),  # after a word
)


def _sections(text: str) -> list[int]:
    """Where headings begin, outside code fences."""
    cuts, fence, at = [], "", 0
    for line in text.splitlines(keepends=True):
        m = _FENCE.match(line)
        if m and not fence:
            fence = m[1]
        elif m and m[1].startswith(fence) and not line.strip().strip(fence[0]):
            fence = ""
        elif not fence and at and re.match(r" {0,3}#{1,6}(?:\s|$)", line):
            cuts.append(at)
        at += len(line)
    return cuts


def parts(text: str, limit: int, level: int = -1) -> Iterator[str]:
    """Consecutive parts of ``text``, each within ``limit`` and cut by the coarsest separators that make it so."""
    if len(text) <= limit:
        if text:
            yield text
        return
    while level <= 3:
        cuts = _sections(text) if level < 0 else [m.end() for m in _LEVELS[level].finditer(text)]
        level += 1
        if cuts and (cuts[0] < len(text)):
            at = 0
            for to in [*cuts, len(text)]:
                if to > at:
                    yield from parts(text[at:to], limit, level)
                    at = to
            return
    for at in range(0, len(text), limit):
        yield text[at : at + limit]


def pieces(text: str, limit: int = 2400, overlap: int = 200) -> list[str]:
    """The pieces of a text, in order."""
    if len(text) <= limit:
        return [text]
    out: list[str] = []
    held, room = [], limit
    size = 0

    def close() -> None:
        nonlocal held, size, room
        out.append((out[-1][-overlap:] if out and overlap else "") + "".join(held))
        held, size, room = [], 0, limit - overlap

    todo = list(parts(text, limit - overlap))[::-1]
    while todo:
        part = todo.pop()
        if held and size + len(part) > room:
            if 3 * size < room:  # a sliver: the next part is cut to what is left
                todo += list(parts(part, room - size))[::-1]
                continue
            close()
        held.append(part)
        size += len(part)
    if held:
        close()
    return out


def split_items(df: DataFrame, key: str, body: str, limit: int = 2400, overlap: int = 200, short: bool = True) -> DataFrame:
    """(key, piece, pieces, text): the ordered pieces, from 1. ``short`` false leaves out the texts within the limit.

    One scan, no shuffle; texts within the limit pass through as they stand.
    """
    if not 0 <= overlap < limit:
        raise ValueError("the overlap must be less than the limit")
    rows = df.select(F.col(key).alias("key"), F.col(body).alias("text")).where("text IS NOT NULL")
    kind = dict(rows.dtypes)["key"]
    rows = rows if short else rows.where(F.char_length("text") > limit)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for from_ in range(0, batch.num_rows, 500):
                some = batch.slice(from_, 500)
                whole = pc.less_equal(pc.utf8_length(some.column(1)), limit)
                if short and pc.any(whole).as_py():
                    same = some.filter(whole)
                    one = pa.array([1] * same.num_rows, pa.int32())
                    yield pa.RecordBatch.from_arrays([same.column(0), one, one, same.column(1)], ["key", "piece", "pieces", "text"])
                some = some.filter(pc.invert(whole))
                keys, n, of, text = [], [], [], []
                for i, t in enumerate(some.column(1).to_pylist()):
                    cut = pieces(t, limit, overlap)
                    keys += [i] * len(cut)
                    n += range(1, len(cut) + 1)
                    of += [len(cut)] * len(cut)
                    text += cut
                yield pa.RecordBatch.from_arrays([some.column(0).take(pa.array(keys, pa.int64())), pa.array(n, pa.int32()), pa.array(of, pa.int32()), pa.array(text, pa.string())], ["key", "piece", "pieces", "text"])

    return rows.mapInArrow(run, f"key {kind}, piece int, pieces int, text string")
