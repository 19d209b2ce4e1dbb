"""Benchmark decontamination: SimHash of item-sized windows, multi-index Hamming blocks, exact weighted-shingle similarity.

A window can only be similar to an item if it holds at least 4 (its length + the item's) / 9 shingles of items of that length, so
a text that has fewer in all has no such window and is left out; no similar window is lost by this. Of every other text all windows
of that length are fingerprinted, at every alignment, by prefix sums of hash bits. A window is looked up in four 16-bit blocks: if
it is within the radius of an item's fingerprint, some block is within a quarter of the radius of the item's, and the tables of
blocks hold every value that near. Only windows that are near an item are compared with it by their shingles with multiplicities.

The benchmark's hashes are a table in the shared folder, cut into blocks of bounded size. Tasks read a block at a time, so a
document is read and hashed once, however many items there are, and nothing of the benchmark goes through the driver.
"""

from __future__ import annotations

import uuid
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from itertools import combinations, pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from surveyqc.llm.common import shared_dir, slices, text_or_empty, text_table, words_of

SHINGLE = 5
#: As a fraction, so that the least number of shared shingles is exact.
SIMILARITY = 4 / 5
#: Bits. At similarity 0.8 a window and an item differ in 9.7 of 64 bits on average (deviation 2.9), in over 19 once in 3000 cases.
RADIUS = 19
BLOCKS = 4
#: Tables of block values; items of one length share a table, and with more lengths than tables several lengths do.
TABLES = 256
#: Bytes of benchmark text and number of items in a block of the index, about; a task holds KEPT blocks at most.
INDEX_BYTES, ITEMS, KEPT = 8 << 20, 16_384, 4
SLICE = 4 << 20
#: Windows that are fingerprinted at once, if a text has no more.
AT_ONCE = 1 << 14
FOUND = "doc_id long, item_id long, start_word long, similarity double, distance int"


def shingle_hashes(texts: pa.Array, widths: tuple[int, ...]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each width: hashes of the shingles of so many words of all texts (A-Z lower-cased), and where each text's begin (one entry more)."""
    from xxhash import xxh64_intdigest

    words, edges = words_of(pc.ascii_lower(texts))
    coded = words.dictionary_encode()
    own = np.fromiter(map(xxh64_intdigest, coded.dictionary.to_pylist()), np.uint64, len(coded.dictionary))
    h = own[np.asarray(coded.indices)] if len(words) else own
    for width in widths:
        n = max(len(h) - width + 1, 0)
        mixed = np.zeros(n, np.uint64)
        for k in range(width):
            mixed = (mixed ^ h[k : k + n]) * np.uint64(0x9E3779B97F4A7C15)
            mixed ^= mixed >> np.uint64(29)
        count = np.maximum(np.diff(edges) - width + 1, 0)
        inside = np.zeros(n + 1, np.int8)  # shingles that run over a text's end go
        full = np.flatnonzero(count)
        np.add.at(inside, edges[:-1][full], 1)
        np.add.at(inside, edges[:-1][full] + count[full], -1)
        yield mixed[np.cumsum(inside[:-1], dtype=np.int8) > 0], np.append(0, np.cumsum(count))


def _bits(hashes: np.ndarray) -> np.ndarray:
    return np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")


def _packed(over: np.ndarray) -> np.ndarray:
    return np.packbits(over, axis=1, bitorder="little").view(np.uint64)[:, 0]


NEAR = np.array([sum(1 << b for b in c) for k in range(RADIUS // BLOCKS + 1) for c in combinations(range(16), k)], np.int64)


def least_shared(window: np.ndarray, item: np.ndarray) -> np.ndarray:
    """Shingles with multiplicity that a window and an item of these lengths share at least at SIMILARITY."""
    return -(-4 * (window + item) // 9)


def _ranges(begin: np.ndarray, count: np.ndarray) -> np.ndarray:
    """begin[0], begin[0] + 1 … (count[0] numbers), begin[1] …"""
    return np.repeat(begin - (np.cumsum(count) - count), count) + np.arange(count.sum())


class Index:
    """Items of one block whose shingles have the same width: their shingles, fingerprints by length, tables of block values."""

    def __init__(self, ids: list[int | None], hashes: list[np.ndarray]) -> None:
        self.ids, self.hashes = ids, hashes
        length = np.array([len(h) for h in hashes])
        self.sizes, size = np.unique(length, return_inverse=True)
        flat = np.concatenate(hashes)
        self.known, at = np.unique(flat, return_inverse=True)
        self.mask = np.uint64((1 << max(16, (8 * len(self.known)).bit_length())) - 1)
        self.seen = np.zeros(int(self.mask) + 1, bool)
        self.seen[self.known & self.mask] = True
        pairs = np.unique(at * len(self.sizes) + np.repeat(size, length))  # a shingle and a length that has it
        self.size_of, self.begin = pairs % len(self.sizes), np.searchsorted(pairs // len(self.sizes), np.arange(len(self.known) + 1))
        self.items = [np.flatnonzero(size == s) for s in range(len(self.sizes))]
        half = (length // 2)[:, None]
        self.fp = _packed(np.stack([_bits(h).sum(axis=0, dtype=np.int64) for h in hashes]) > half)
        self.tables = np.zeros((min(TABLES, len(self.sizes)), BLOCKS, 1 << 13), np.uint8)  # a bit a value
        table = size % len(self.tables)
        for t in np.unique(table):
            for b in range(BLOCKS):
                near = np.zeros(1 << 16, bool)
                for value in np.unique(self.fp[table == t] >> np.uint64(16 * b) & np.uint64(0xFFFF)).tolist():
                    near[NEAR ^ value] = True
                self.tables[t, b] = np.packbits(near, bitorder="little")

    def near(self, fp: np.ndarray, size: np.ndarray) -> Iterator[tuple[np.ndarray, int, np.ndarray]]:
        """(rows of fp, item, distances) of fingerprints of windows for items of these lengths, within the radius."""
        blocks, table = fp.view(np.uint16).reshape(-1, BLOCKS), size % len(self.tables)
        some = np.zeros(len(fp), np.uint8)
        for b in range(BLOCKS):
            some |= self.tables[table, b, blocks[:, b] >> 3] >> (blocks[:, b] & 7).astype(np.uint8)
        rows = np.flatnonzero(some & 1)
        for s in np.unique(size[rows]):
            own = rows[size[rows] == s]
            for k in self.items[s].tolist():
                distance = np.bitwise_count(fp[own] ^ self.fp[k])
                hit = distance <= RADIUS
                if hit.any():
                    yield own[hit], k, distance[hit]

    def candidates(self, h: np.ndarray, edges: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(size, text, length) of the texts that hold enough shingles of items of a size for a window of this length to be similar to one.

        A window is as long as the items, or a whole text that is a little shorter.
        """
        at = np.flatnonzero(self.seen[h & self.mask])
        j = np.minimum(np.searchsorted(self.known, h[at]), len(self.known) - 1)
        at, j = (x[self.known[j] == h[at]] for x in (at, j))
        count = self.begin[j + 1] - self.begin[j]
        text = np.searchsorted(edges, np.repeat(at, count), side="right") - 1
        key, held = np.unique(self.size_of[_ranges(self.begin[j], count)] * len(edges) + text, return_counts=True)
        size, text = key // len(edges), key % len(edges)
        length = np.minimum(np.diff(edges)[text], self.sizes[size])
        need = least_shared(length, self.sizes[size])
        full = (held >= need) & (need <= length)
        return size[full], text[full], length[full]

    def search(self, h: np.ndarray, edges: np.ndarray) -> Iterator[tuple[int, int, int, float, int]]:
        """(text, item, first shingle, similarity, distance) of windows that are similar to an item, the best of a stretch."""
        size, text, length = self.candidates(h, edges)
        n = edges[text + 1] - edges[text] - length + 1
        part = np.cumsum(n) // AT_ONCE
        for a, b in pairwise([0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), len(n)]):
            if a < b:
                yield from self._compare(h, edges, size[a:b], text[a:b], length[a:b], n[a:b])

    def _compare(self, h, edges, size, text, length, n) -> Iterator[tuple[int, int, int, float, int]]:
        """Fingerprints all n windows of each text, and compares those that are near an item."""
        wide = n + length - 1
        bits = _bits(h[_ranges(edges[text], wide)])
        sums = np.zeros((len(bits) + 1, 64), np.int32)
        np.cumsum(bits, axis=0, out=sums[1:])
        own = np.repeat(np.arange(len(n)), n)
        at = _ranges(np.cumsum(wide) - wide, n)
        long = length[own]
        fp = _packed(sums[at + long] - sums[at] > (long // 2)[:, None])
        begin = _ranges(edges[text], n)
        for rows, k, distance in self.near(fp, size[own]):
            cut = np.flatnonzero((np.diff(own[rows]) != 0) | (np.diff(begin[rows]) > long[rows[1:]])) + 1
            for near, far in zip(np.split(rows, cut), np.split(distance, cut), strict=True):
                m = int(long[near[0]])
                similarity = _similarities(h[begin[near[0]] : begin[near[-1]] + m], m, self.hashes[k])[begin[near] - begin[near[0]]]
                best = int(np.argmax(similarity))
                if similarity[best] >= SIMILARITY:
                    t = int(text[own[near[0]]])
                    yield t, k, int(begin[near[best]] - edges[t]), float(similarity[best]), int(far[best])


def _similarities(h: np.ndarray, n: int, item: np.ndarray) -> np.ndarray:
    """Weighted Jaccard similarity of an item and each window of n of the hashes h: counts follow the window."""
    known = Counter(item.tolist())
    values, own, both, found = h.tolist(), Counter(), 0, np.empty(len(h) - n + 1)
    for i, x in enumerate(values):
        if x in known:
            own[x] += 1
            both += own[x] <= known[x]
        if i >= n and (y := values[i - n]) in known:
            both -= own[y] <= known[y]
            own[y] -= 1
        if i >= n - 1:
            found[i - n + 1] = both / (n + len(item) - both)
    return found


def write_index(benchmark: DataFrame, most: int = ITEMS) -> tuple[str, int]:
    """Writes the items' hashes, by block, to the shared folder; its path and the number of blocks. An item with fewer words than a shingle has one of its own width."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "text"):
                sets = list(shingle_hashes(batch.column("text"), tuple(range(1, SHINGLE + 1))))
                n_words = np.diff(sets[0][1])
                width = np.clip(n_words, 1, SHINGLE)
                own = lambda i, hashes, edges: hashes[edges[i] : edges[i + 1]].view(np.int64)
                rows = [own(i, *sets[w - 1]) for i, w in enumerate(width.tolist())]
                yield pa.RecordBatch.from_arrays([batch.column("item_id"), pa.array(width, pa.int32()), pa.array(rows, pa.list_(pa.int64())), batch.column("block")], ["item_id", "width", "hashes", "block"])

    items = benchmark.select("item_id", text_or_empty().alias("text"))
    size, n = items.agg(F.sum(F.octet_length("text")), F.count("*")).first()
    blocks = max(1, -(-(size or 0) // INDEX_BYTES), -(-n // most))
    path = f"{shared_dir(benchmark.sparkSession)}/benchmark-{uuid.uuid4().hex}"
    dealt = items.withColumn("block", F.pmod(F.xxhash64("item_id"), F.lit(blocks)).cast("int"))
    hashed = dealt.mapInArrow(run, "item_id long, width int, hashes array<long>, block int").where(F.size("hashes") > 0)
    hashed.write.partitionBy("block").parquet(path)
    return path, blocks


@lru_cache(maxsize=KEPT)
def _block(path: str, block: int) -> dict[int, Index]:
    """By the width of their shingles, the items of a block (a worker serves many tasks, so it keeps some)."""
    from pyarrow import fs
    from pyarrow import parquet as pq

    store, folder = fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)
    at = f"{folder}/block={block}"
    if store.get_file_info(at).type == fs.FileType.NotFound:
        return {}
    rows = pq.read_table(at, filesystem=store, columns=["item_id", "width", "hashes"]).to_pylist()
    found = {}
    for width in {r["width"] for r in rows}:
        own = [r for r in rows if r["width"] == width]
        found[width] = Index([r["item_id"] for r in own], [np.array(r["hashes"], np.int64).view(np.uint64) for r in own])
    return found


def search(texts: pa.Array, path: str, blocks: int) -> list[tuple[int, int | None, int, float, int]]:
    """(row, item_id, start_word, similarity, distance) of the best window of each text and item that are similar."""
    hashed: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    found: dict[tuple[int, int | None], tuple[int, float, int]] = {}
    for block in range(blocks):
        index = _block(path, block)
        if wanted := tuple(w for w in index if w not in hashed):
            hashed |= zip(wanted, shingle_hashes(texts, wanted), strict=True)
        for width, items in index.items():
            for row, k, start, similarity, distance in items.search(*hashed[width]):
                old = found.get((row, items.ids[k]), (0, 0.0, 0))
                if (-similarity, start) < (-old[1], old[0]):
                    found[row, items.ids[k]] = start, similarity, distance
    return [(row, item, *rest) for (row, item), rest in found.items()]


def contaminated(docs: DataFrame, benchmark: DataFrame, items: int = ITEMS) -> DataFrame:
    """doc_id, item_id, start_word, similarity, distance: the best window of each document and item that are similar.

    Whole texts are searched for every item; one of fewer than five words is a shingle of its own width, one without words
    matches nothing. Of equal windows the first is reported. Rows of one item_id are one item with several texts. Null texts match
    nothing; repeated rows are each reported; an empty benchmark or table gives none. No row is moved.
    """
    path, blocks = write_index(benchmark, items)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "text", SLICE):
                if rows := search(batch.column("text"), path, blocks):
                    row, *rest = zip(*rows, strict=True)
                    arrays = [pa.array(x, t) for x, t in zip(rest, (pa.int64(), pa.int64(), pa.float64(), pa.int32()), strict=True)]
                    yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(pa.array(row)), *arrays], ["doc_id", "item_id", "start_word", "similarity", "distance"])

    return text_table(docs).mapInArrow(run, FOUND)


def decontaminate(docs: DataFrame, benchmark: DataFrame, items: int = ITEMS) -> DataFrame:
    """docs, with all their columns, without the rows whose text holds a passage of the benchmark. No row is moved."""
    path, blocks = write_index(benchmark, items)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "text", SLICE):
                clean = np.ones(batch.num_rows, bool)
                clean[[row for row, *_ in search(batch.column("text"), path, blocks)]] = False
                yield batch.filter(pa.array(clean))

    return docs.mapInArrow(run, docs.schema)
