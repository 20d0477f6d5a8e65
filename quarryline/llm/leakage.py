"""Evaluation texts inside a corpus: Wu-Manber search for word windows of the items, then an exact check.

A document holds an item if it has ``run`` consecutive words of it unchanged, or a stretch of at least ``stretch`` of its
words of which at most one in ten is changed, dropped or added. In a stretch with e edits one of the e + 1 runs between
them has at least (stretch - e) / (e + 1) words, so every case has ``seed`` words in a row unchanged (7 for 30 words and
3 edits). The patterns are therefore all windows of ``seed`` words of all items. The search looks at blocks of two words:
a shift table says how far the window can move when its last block ends no pattern; blocks that do end one select a
bucket of patterns, which are compared directly. Hits are then decided exactly: by the longest unchanged run, or by an
edit-distance recurrence over every start in the item at once.

Words are runs of letters and digits. Case, punctuation, mark-up (tags, emphasis, quote and comment signs, link targets),
entities, backslash escapes, line breaks and invisible characters do not count.

The corpus is read once and not shuffled. The texts of the items go to the workers in blocks of at most ``BLOCK`` items, one
pass a block; each worker process builds the packed index of a block once and keeps it for its tasks.

Defined results. Null or empty texts hold nothing; items with fewer words than ``run`` can be held only as a whole, from
``seed`` words on. Repeated rows give repeated results, which the query makes distinct. Further columns are not read.
"""

import html
import re
import uuid
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Items whose patterns are held by a worker at once: about 1.5 kilobytes each at 46 words.
BLOCK = 200_000

_INVISIBLE = re.compile("[\u00ad\u034f\u061c\u115f\u1160\u17b4\u17b5\u180b-\u180e\u200b-\u200f\u202a-\u202e\u2060-\u2064\u2066-\u206f\ufe00-\ufe0f\ufeff]")
_MARKS = re.compile("[\u0080-\u00a9\u00ab\u00ac\u00ae-\u00b4\u00b6-\u00b9\u00bb-\u00bf\u00d7\u00f7\u2000-\u206f\u2190-\u2bff\u3000-\u3003\u3008-\u3011\uff01-\uff0f\uff1a-\uff20]")
_INLINE = re.compile(r"</?(?:a|b|i|u|s|em|strong|code|span|mark|small|sub|sup|font|tt|kbd|q)(?:\s[^<>]*)?/?>", re.I)
_TAG = re.compile(r"</?[A-Za-z][^<>]*>|<!--.*?-->", re.S)
_TARGET = re.compile(r"\]\([^()\s]*(?:\s+\"[^\"]*\")?\)")
_ESCAPE = re.compile(r"\\u([0-9a-fA-F]{4})|\\x([0-9a-fA-F]{2})|\\([nrtvfb])(?=\W|[A-Z0-9a-z])")
_BROKEN = re.compile(r"(?<=[^\W\d_])-[ \t]*\r?\n[ \t>#*/|;%\-]*(?=[^\W\d_])")
_TABLE = bytes(c if c >= 128 or chr(c).isdigit() or "a" <= chr(c) <= "z" else c + 32 if "A" <= chr(c) <= "Z" else 32 for c in range(256))


def _unescape(m: re.Match) -> str:
    code = m[1] or m[2]
    return chr(int(code, 16)) if code and not 0xD800 <= int(code, 16) < 0xE000 else " "


def words(text: str) -> list[bytes]:
    """The words of a text, in lower case, as UTF-8."""
    if "\\" in text:
        text = _ESCAPE.sub(_unescape, text)
    if "&" in text:
        text = html.unescape(text)
    if "<" in text:
        text = _TAG.sub(" ", _INLINE.sub("", text))
    if "](" in text:
        text = _TARGET.sub("]", text)
    if not text.isascii():
        text = _MARKS.sub(" ", _INVISIBLE.sub("", text)).lower()
    if "-\n" in text or "-\r" in text:
        text = _BROKEN.sub("", text)
    return text.encode("utf-8", "replace").translate(_TABLE).split()


_ROLL = 0x9E3779B97F4A7C15
_MASK = (1 << 64) - 1


class Patterns:
    """Shift table and buckets of all windows of ``seed`` words of the items, in packed arrays.

    A word is its hash within the process. The shift table is addressed by the hash of a block of two words, as in the
    original method, so two blocks may share an entry, which then has the smaller shift. The patterns are sorted by the hash
    of their words; equal hashes form a bucket, whose members are compared directly.
    """

    def __init__(self, items: list[tuple[object, str]], run: int = 15, stretch: int = 30, seed: int = 7):
        self.run, self.stretch, self.seed = run, stretch, seed
        self.keys, self.texts, lengths, hashes = [], [], [], []
        for k, t in items:
            if t and len(w := words(t)) >= seed:
                self.keys.append(k)
                self.texts.append(b" ".join(w))
                lengths.append(len(w))
                hashes.append(np.fromiter(map(hash, w), np.int64, len(w)))
        self.powers = np.array([pow(_ROLL, k, 1 << 64) for k in range(seed)], np.uint64)
        every = np.concatenate(hashes).view(np.uint64) if hashes else np.zeros(0, np.uint64)
        ends = np.cumsum(lengths, dtype=np.int64)
        owner = np.repeat(np.arange(len(lengths), dtype=np.int32), lengths)
        place = np.arange(len(every), dtype=np.int64) - np.repeat(ends - lengths, lengths) if hashes else np.zeros(0, np.int64)
        starts = np.flatnonzero(place <= np.repeat(np.array(lengths, np.int64), lengths) - seed) if hashes else np.zeros(0, np.int64)
        window = self._windows(every)[starts] if len(starts) else np.zeros(0, np.uint64)
        order = np.argsort(window, kind="stable")
        self.window, self.owner, self.place = window[order], owner[starts][order], place[starts][order].astype(np.int32)
        self.bits = min(26, max(16, (4 * len(starts)).bit_length()))  # at most a quarter of the entries of a block place are taken
        self.table = np.full(1 << self.bits, seed - 1, np.uint8)
        blocks = self._blocks(every) if len(every) > 1 else np.zeros(0, np.int64)
        for end in range(1, seed):
            self.table[blocks[starts + end - 1]] = seed - 1 - end  # shifts fall, so the smallest stays
        self._split: tuple[int, list[bytes]] = -1, []

    def _windows(self, hashes: np.ndarray) -> np.ndarray:
        """The hash of every window of ``seed`` words."""
        n = len(hashes) - self.seed + 1
        out = np.zeros(n, np.uint64)
        for k in range(self.seed):
            out += hashes[k : k + n] * self.powers[k]
        return out ^ (out >> np.uint64(29))

    def _blocks(self, hashes: np.ndarray) -> np.ndarray:
        """The address in the shift table of every block of two words."""
        return (((hashes[:-1] * np.uint64(_ROLL)) ^ hashes[1:]) * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(64 - self.bits)).astype(np.int64)

    def item(self, n: int) -> list[bytes]:
        """The words of the item with that number."""
        if self._split[0] != n:
            self._split = n, self.texts[n].split(b" ")
        return self._split[1]

    def hits(self, text: list[bytes]) -> list[tuple[int, int, int]]:
        """(item, place in the item, place in the text) of every pattern that occurs."""
        seed, n = self.seed, len(text)
        if n < seed or not len(self.window):
            return []
        hashes = np.fromiter(map(hash, text), np.int64, n).view(np.uint64)
        shift = self.table[self._blocks(hashes)].tobytes()  # of the block that ends at the next word
        ends, i = [], seed - 2
        while i < n - 1:
            by = shift[i]
            if by:
                i += by
            else:
                ends.append(i + 2 - seed)
                i += 1
        if not ends:
            return []
        places = np.array(ends, np.int64)
        window = self._windows(hashes)[places]
        first, last = np.searchsorted(self.window, window, "left"), np.searchsorted(self.window, window, "right")
        found = []
        for at in np.flatnonzero(last > first).tolist():
            p = ends[at]
            for k in range(first[at], last[at]):
                item, place = int(self.owner[k]), int(self.place[k])
                if self.item(item)[place : place + seed] == text[p : p + seed]:
                    found.append((item, place, p))
        return found

    def held(self, text: list[bytes]) -> list[object]:
        """The keys of the items that the text holds."""
        by: dict[int, list[tuple[int, int]]] = defaultdict(list)
        for n, at, place in self.hits(text):
            by[n].append((at, place))
        return [self.keys[n] for n, seeds in by.items() if self._holds(text, self.item(n), seeds)]

    def _holds(self, text: list[bytes], item: list[bytes], seeds: list[tuple[int, int]]) -> bool:
        known, longest = set(seeds), 0
        for at, place in seeds:
            if (at - 1, place - 1) not in known:
                n = 1
                while (at + n, place + n) in known:
                    n += 1
                longest = max(longest, n + self.seed - 1)
        if longest >= min(self.run, len(item)):
            return True
        if len(item) < self.stretch:
            return False
        # A stretch of twice the least length with at most one edit in ten has a half for which that holds too, so stretches
        # shorter than that decide; those around a seed lie in a part of the item and of the text of bounded size.
        most, tile = 2 * self.stretch, self.stretch
        edge = most + most // 10 + 1
        for a, p in sorted({(at // tile, place // tile) for at, place in seeds}):
            part = item[max(0, a * tile - most) : (a + 1) * tile + self.seed + most]
            if self._near(text[max(0, p * tile - edge) : (p + 1) * tile + self.seed + edge], part):
                return True
        return False

    def _near(self, text: list[bytes], item: list[bytes]) -> bool:
        """Whether a stretch of the item is in the text but for one word in ten; row i holds the edits of item[i:j]."""
        ids: dict[bytes, int] = {}
        t = np.array([ids.setdefault(w, len(ids)) for w in text], np.int32)
        places = np.arange(len(t) + 1, dtype=np.int32)
        edits = np.zeros((len(item), len(t) + 1), np.int32)
        for j, w in enumerate(item):
            live = edits[: j + 1]
            other = (t != ids.get(w, -1)).astype(np.int32)
            step = live + 1
            np.minimum(step[:, 1:], live[:, :-1] + other, out=step[:, 1:])
            step = np.minimum.accumulate(step - places, axis=1) + places
            edits[: j + 1] = step
            starts = j + 2 - self.stretch
            if starts > 0:
                lengths = j + 1 - np.arange(starts)
                if (step[:starts].min(axis=1) <= lengths // 10).any():
                    return True
        return False


def leaked(docs: DataFrame, items: DataFrame, doc: str, text: str, item: str, passage: str, run: int = 15, stretch: int = 30) -> DataFrame:
    """(doc, item) for every document that holds an item."""
    e = stretch // 10
    seed = min(run, -(-(stretch - e) // (e + 1)))
    rows = docs.select(F.col(doc).alias("doc"), F.col(text).alias("text")).where("text IS NOT NULL")
    known = items.select(F.col(item).alias("item"), F.col(passage).alias("text")).where("text IS NOT NULL").distinct()
    blocks = max(1, -(-known.count() // BLOCK))
    kinds = dict(rows.dtypes)["doc"], dict(known.dtypes)["item"]
    out = None
    for b in range(blocks):
        part = [tuple(r) for r in known.where(F.pmod(F.xxhash64("item"), F.lit(blocks)) == b).collect()]  # at most about BLOCK short texts
        one = rows.mapInArrow(_search(part, run, stretch, seed, rows.sparkSession, known), f"doc {kinds[0]}, item {kinds[1]}")
        out = one if out is None else out.union(one)
    return out


_HELD: dict[str, Patterns] = {}


def _search(items: list[tuple], run: int, stretch: int, seed: int, spark, known: DataFrame):
    from pyspark.sql.pandas.types import to_arrow_type

    kind, name = to_arrow_type(known.schema["item"].dataType), uuid.uuid4().hex
    shared = spark.sparkContext.broadcast(items)

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if name not in _HELD:
            _HELD.clear()
            _HELD[name] = Patterns(shared.value, run, stretch, seed)
        p = _HELD[name]
        for batch in batches:
            at, items = [], []
            for i, t in enumerate(batch.column(1).to_pylist()):
                for k in p.held(words(t)):
                    at.append(i)
                    items.append(k)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int64())), pa.array(items, kind)], ["doc", "item"])

    return search
