"""Extractive summaries from the published methods: luhn, sumbasic, kl, textrank, lexrank, lsa, reduction, edmundson, random."""

import hashlib
import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

METHODS = ("lsa", "lexrank", "textrank", "luhn", "edmundson", "sumbasic", "kl", "reduction", "random")
#: Words without topic, and cue words for and against a sentence. (fixed values)
STOP = frozenset("a an and are as at be but by for from has have if in into is it its no not of on or such that the their then there these they this to was will with".split())
BONUS, STIGMA = frozenset("important significant key must note summary conclusion".split()), frozenset("hardly impossible perhaps maybe".split())
_SENTENCE = re.compile(r"(?<=[.!?])\s+|\n{2,}")


def sentences(text: str) -> list[str]:
    """The sentences of the prose of a Markdown text."""
    text = re.sub(r"(?s)^---\n.*?\n---\n|```.*?(?:```|\Z)", " ", text)
    text = "\n".join(x for x in text.split("\n") if not re.match(r"\s*(?:#|\||>|[-*+] |\d+\. )", x))
    return [" ".join(s.split()) for s in _SENTENCE.split(text) if len(s.split()) > 2]


def _words(s: str) -> list[str]:
    return [w for w in re.findall(r"[^\W\d_]+", s.lower()) if w not in STOP]


def scores(all_: list[str], method: str, bonus=BONUS, stigma=STIGMA) -> list[float]:
    """A score a sentence; the highest makes the summary, the first of equals."""
    bags = [_words(s) for s in all_]
    counts = Counter(w for b in bags for w in b)
    total = sum(counts.values()) or 1
    if method == "random":
        return [int(hashlib.md5(s.encode()).hexdigest()[:8], 16) / 2**32 for s in all_]
    if method == "sumbasic":
        return [sum(counts[w] / total for w in b) / max(1, len(b)) for b in bags]
    if method == "luhn":
        common = {w for w, n in counts.items() if n >= 2}
        out = []
        for b in bags:
            at = [i for i, w in enumerate(b) if w in common]
            out.append(len(at) ** 2 / (at[-1] - at[0] + 1) if at else 0.0)
        return out
    if method == "edmundson":
        title = set(bags[0]) if bags else set()
        return [sum((w in bonus) - (w in stigma) for w in b) + len(title & set(b)) / max(1, len(b)) + (i in (0, len(bags) - 1)) * 0.5 for i, b in enumerate(bags)]
    if method == "kl":
        out = []
        for b in bags:
            c, n = Counter(b), len(b)
            out.append(-sum(p / total * math.log((p / total) / ((c[w] + 0.01) / (n + 0.01 * len(counts)))) for w, p in counts.items()) if n else -1e9)
        return out
    vocabulary = {w: i for i, w in enumerate(sorted(counts))}
    x = np.zeros((len(bags), max(1, len(vocabulary))))
    for i, b in enumerate(bags):
        for w in b:
            x[i, vocabulary[w]] += 1
    if method == "lsa":
        u, s, _ = np.linalg.svd(x, full_matrices=False)
        k = min(3, len(s))
        return np.sqrt(((u[:, :k] * s[:k]) ** 2).sum(axis=1)).round(9).tolist()
    idf = np.log(1 + len(bags) / np.maximum(1, (x > 0).sum(axis=0)))
    v = x * idf if method == "lexrank" else (x > 0).astype(float)
    if method in ("textrank", "reduction"):
        size = np.log(np.maximum(2, x.sum(axis=1)))
        sim = (v @ v.T) / (size[:, None] + size[None, :])
    else:
        norm = np.linalg.norm(v, axis=1, keepdims=True)
        sim = (v @ v.T) / np.maximum(1e-12, norm @ norm.T)
        sim = np.where(sim >= 0.1, sim, 0)
    np.fill_diagonal(sim, 0)
    if method == "reduction":
        return sim.sum(axis=1).round(9).tolist()
    rank, out = np.full(len(bags), 1 / max(1, len(bags))), np.maximum(1e-12, sim.sum(axis=1, keepdims=True))
    for _ in range(50):
        rank = 0.15 / max(1, len(bags)) + 0.85 * (sim / out).T @ rank
    return rank.round(9).tolist()


def summarise(text: str, method: str = "lsa", n: int = 1) -> str:
    """The ``n`` best sentences in their order in the text."""
    all_ = sentences(text)
    if len(all_) <= n:
        return " ".join(all_)
    s = scores(all_, method)
    best = sorted(sorted(range(len(all_)), key=lambda i: (-s[i], i))[:n])
    return " ".join(all_[i] for i in best)


def extractive(df: DataFrame, key: str, text: str, method: str = "lsa", n: int = 1) -> DataFrame:
    """(key, summary) of every text."""
    if method not in METHODS:
        raise ValueError(f"no such method: {method}")
    rows = df.select(F.col(key).alias("key"), F.col(text).alias("text")).where("text IS NOT NULL")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([summarise(t, method, n) for t in b.column(1).to_pylist()], pa.string())], ["key", "summary"])

    return rows.mapInArrow(run, f"key {dict(rows.dtypes)['key']}, summary string")
