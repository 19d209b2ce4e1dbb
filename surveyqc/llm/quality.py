"""Quality classifier: a generalised additive model with pairwise interactions.

Shallow trees, boosted in cycles over the features, leave one lookup table for each feature and each chosen pair of features;
a score is the sum of the entries that a document's bins name. Features are of the whole text alone.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from surveyqc.llm.common import slices, text_table, words_of

#: Labelled rows that the model is fitted on at most: those with the smallest hash of doc_id, whatever the corpus's size.
SAMPLE = 20_000
BINS, PAIR_BINS, PAIRS, CYCLES, RATE, LEAVES = 32, 8, 6, 120, 0.1, 4
FEATURES = ("log_words", "mean_word", "long_words", "distinct_words", "repeated_trigrams", "repeated_lines", "log_lines", "words_per_line", "capitals", "digits", "symbols", "exclamations", "stops", "non_ascii", "short_words")

_CLASSES = {"capitals": b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", "digits": b"0123456789", "symbols": b"#*$%&|<>=_{}[]\\^~@", "exclamations": b"!?", "stops": b".,;:", "non_ascii": bytes(range(0xC0, 0x100))}


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def _share(count: np.ndarray, of: np.ndarray) -> np.ndarray:
    return count / np.maximum(of, 1)


def _repeated(edges: np.ndarray, codes: np.ndarray) -> np.ndarray:
    """Of each stretch of codes between edges, how many equal an earlier one of it."""
    n = np.diff(edges)
    doc = np.repeat(np.arange(len(n)), n)
    order = np.lexsort((codes, doc))
    same = np.zeros(len(codes), np.int64)
    if len(codes) > 1:
        same[1:] = (codes[order][1:] == codes[order][:-1]) & (doc[order][1:] == doc[order][:-1])
    return np.bincount(doc[order], same, len(n))


def features(texts: pa.Array) -> np.ndarray:
    """Rows of FEATURES; an empty or null text has zeros."""
    texts = pc.fill_null(texts, "")
    lists = pc.split_pattern(texts, "\n")
    lines, line_edges = lists.flatten(), np.asarray(lists.offsets, np.int64)
    line_edges = line_edges - line_edges[0]
    words, edges = words_of(texts)
    n, size = np.diff(edges), np.asarray(pc.binary_length(words), np.int64)
    doc = np.repeat(np.arange(len(n)), n)
    codes = np.asarray(words.dictionary_encode().indices, np.int64)
    per_doc = lambda x: np.bincount(doc, x, len(n))
    count3 = np.maximum(n - 2, 0)
    at = np.repeat(edges[:-1] - (np.cumsum(count3) - count3), count3) + np.arange(count3.sum())
    with np.errstate(over="ignore"):
        trigrams = (codes[at] * 1_000_003 + codes[at + 1]) * 1_000_003 + codes[at + 2] if len(at) else codes[:0]
    data = np.frombuffer(b"".join(texts.cast(pa.binary()).to_pylist()), np.uint8)
    n_bytes = np.asarray(pc.binary_length(texts), np.int64)
    full = np.flatnonzero(n_bytes)
    starts = (np.cumsum(n_bytes) - n_bytes)[full]
    marks = {}
    for name, members in _CLASSES.items():
        table = np.zeros(256, np.uint8)
        table[list(members)] = 1
        marks[name] = np.zeros(len(n))
        if len(full):
            marks[name][full] = np.add.reduceat(table[data], starts, dtype=np.int64)
    n_lines = np.diff(line_edges)
    found = {
        "log_words": np.log1p(n), "mean_word": _share(per_doc(size), n), "long_words": _share(per_doc(size > 12), n), "short_words": _share(per_doc(size < 4), n),
        "distinct_words": 1 - _share(_repeated(edges, codes), n), "repeated_trigrams": _share(_repeated(np.append(0, np.cumsum(count3)), trigrams), count3),
        "repeated_lines": _share(_repeated(line_edges, np.asarray(lines.dictionary_encode().indices, np.int64)), n_lines), "log_lines": np.log1p(n_lines), "words_per_line": np.log1p(n / np.maximum(n_lines, 1)),
        "capitals": _share(marks["capitals"], n_bytes), "digits": _share(marks["digits"], n_bytes), "symbols": _share(marks["symbols"], n), "exclamations": _share(marks["exclamations"], n), "stops": _share(marks["stops"], n), "non_ascii": _share(marks["non_ascii"], n_bytes),
    }
    return np.stack([found[f] for f in FEATURES], axis=1)


@dataclass
class Model:
    """edges[f]: bin borders of a feature; tables[f]: what a bin adds; pairs: (f, g, borders, borders, table)."""

    prior: float
    edges: list[np.ndarray]
    tables: list[np.ndarray]
    pairs: list[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]

    def score(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.prior)
        for f, (edge, added) in enumerate(zip(self.edges, self.tables, strict=True)):
            total += added[np.searchsorted(edge, x[:, f], side="right")]
        for f, g, a, b, added in self.pairs:
            total += added[np.searchsorted(a, x[:, f], side="right"), np.searchsorted(b, x[:, g], side="right")]
        return 1 / (1 + np.exp(-np.clip(total, -30, 30)))


def _borders(x: np.ndarray, bins: int) -> np.ndarray:
    return np.unique(np.quantile(x, np.arange(1, bins) / bins)) if len(x) else np.empty(0)


def _tree(g: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Newton step of a tree over ordered bins with at most LEAVES leaves, grown by the best split."""
    leaves = [(0, len(g))]
    value = lambda a, b: g[a:b].sum() / (h[a:b].sum() + 1.0)

    def best(a: int, b: int) -> tuple[float, int]:
        if b - a < 2:
            return 0.0, a
        gl, hl = np.cumsum(g[a:b])[:-1], np.cumsum(h[a:b])[:-1]
        gt, ht = g[a:b].sum(), h[a:b].sum()
        gain = gl**2 / (hl + 1) + (gt - gl) ** 2 / (ht - hl + 1) - gt**2 / (ht + 1)
        k = int(np.argmax(gain))
        return float(gain[k]), a + k + 1

    while len(leaves) < LEAVES:
        gain, cut, (a, b) = max((*best(*leaf), leaf) for leaf in leaves)
        if gain <= 1e-6:
            break
        leaves.remove((a, b))
        leaves += [(a, cut), (cut, b)]
    out = np.empty(len(g))
    for a, b in leaves:
        out[a:b] = value(a, b)
    return out


def _quadrants(g: np.ndarray, h: np.ndarray) -> tuple[float, np.ndarray]:
    """The best tree of one split on each axis: its gain and its step."""
    gc, hc = np.zeros((g.shape[0] + 1, g.shape[1] + 1)), np.zeros((g.shape[0] + 1, g.shape[1] + 1))
    gc[1:, 1:], hc[1:, 1:] = g.cumsum(0).cumsum(1), h.cumsum(0).cumsum(1)
    corners = lambda c: (c, c[-1:, :] * 0 + c[:, -1:] - c, c[-1:, :] - c, c[-1, -1] - c[:, -1:] - c[-1:, :] + c)
    gain = sum(a**2 / (b + 1) for a, b in zip(corners(gc), corners(hc), strict=True))
    i, j = np.unravel_index(np.argmax(gain), gain.shape)
    out = np.empty(g.shape)
    for rows in (slice(None, i), slice(i, None)):
        for cols in (slice(None, j), slice(j, None)):
            out[rows, cols] = g[rows, cols].sum() / (h[rows, cols].sum() + 1.0)
    return float(gain[i, j]), out


def fit(x: np.ndarray, y: np.ndarray) -> Model:
    """Cycles over all features, then over the pairs whose first tree gains most from what is left."""
    rate = (y.sum() + 1) / (len(y) + 2) if len(y) else 0.5
    prior = float(np.log(rate / (1 - rate)))
    edges = [_borders(x[:, f], BINS) for f in range(x.shape[1])]
    bins = [np.searchsorted(e, x[:, f], side="right") for f, e in enumerate(edges)]
    tables = [np.zeros(len(e) + 1) for e in edges]
    total = np.full(len(y), prior)

    def slopes() -> tuple[np.ndarray, np.ndarray]:
        p = 1 / (1 + np.exp(-total))
        return y - p, p * (1 - p)

    for _ in range(CYCLES if len(y) else 0):
        for f, b in enumerate(bins):
            g, h = slopes()
            step = RATE * _tree(np.bincount(b, g, len(tables[f])), np.bincount(b, h, len(tables[f])))
            tables[f] += step
            total += step[b]
    coarse = [_borders(x[:, f], PAIR_BINS) for f in range(x.shape[1])]
    cells = [np.searchsorted(e, x[:, f], side="right") for f, e in enumerate(coarse)]

    def histogram(f: int, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        shape = len(coarse[f]) + 1, len(coarse[k]) + 1
        at, (g, h) = cells[f] * shape[1] + cells[k], slopes()
        return at, np.bincount(at, g, shape[0] * shape[1]).reshape(shape), np.bincount(at, h, shape[0] * shape[1]).reshape(shape)

    every = [(f, k) for f in range(x.shape[1]) for k in range(f)] if len(y) else []
    chosen = sorted(every, key=lambda p: (-_quadrants(*histogram(*p)[1:])[0], p))[:PAIRS]
    added = {p: np.zeros((len(coarse[p[0]]) + 1, len(coarse[p[1]]) + 1)) for p in chosen}
    for _ in range(CYCLES // 2):
        for p in chosen:
            at, g, h = histogram(*p)
            step = RATE * _quadrants(g, h)[1]
            added[p] += step
            total += step.ravel()[at]
    return Model(prior, edges, tables, [(f, k, coarse[f], coarse[k], added[f, k]) for f, k in chosen])


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """Fits on the labels of at most `sample` documents outside the held-out fold. Several labels of one must all be 1."""
    own = labels.where("doc_id IS NOT NULL AND quality IS NOT NULL").where(~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.min("quality").alias("y"))
    picked = own.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    rows = text_table(docs).join(F.broadcast(picked), "doc_id").select("doc_id", "y", "text")  # at most `sample` ids are sent

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "text"):
                x = features(batch.column("text"))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("y").cast(pa.int64()), pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), x.shape[1]).cast(pa.list_(pa.float64()))], ["doc_id", "y", "x"])

    found = sorted(rows.mapInArrow(run, "doc_id long, y long, x array<double>").dropDuplicates(["doc_id"]).collect())
    x = np.array([r["x"] for r in found], float).reshape(len(found), len(FEATURES))
    return fit(x, np.array([r["y"] for r in found], float))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, score (0..1, higher: good is likelier) of each whole text; null and empty texts are scored too."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "text"):
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(model.score(features(batch.column("text"))))], ["doc_id", "score"])

    return text_table(docs).mapInArrow(run, "doc_id long, score double")
