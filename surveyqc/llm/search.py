"""Ranked lexical search: the best documents for each query item, by the Best Position Algorithm.

Documents are read once into narrow rows: their number of terms, and the item terms that they hold with their counts. Rows of
these are searched in parts: each term's documents of a part are an impact list, highest first. Items read their lists from the
top, look every newly seen document up in all their lists, and mark the positions at which those stand there. A list's best
position ends its unbroken stretch of seen ones; what lies below cannot score more than the sum of the impacts at the best
positions. When that is strictly below the kth score, the rest of the part is never read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from surveyqc.llm.common import slices, text_or_empty, written

TOP = 50
#: Rows of a part (positions in it fit in 16 bits), and terms of the items that are searched together in it.
PART, GROUP_TERMS = 16_384, 4_096
#: Positions that are read from each list at first; twice as many each time after.
STEP = 32
#: Bytes of item text that are searched in one pass over the documents; more items take more passes.
BLOCK_BYTES = 4 << 20

_TERM = np.zeros(256, bool)
_TERM[[*range(ord("0"), ord("9") + 1), *range(ord("A"), ord("Z") + 1), *range(ord("a"), ord("z") + 1), *range(0x80, 0x100)]] = True
#: Each byte of a term, A-Z lower-cased, and a space for all others.
_BYTES = np.where(_TERM, np.arange(256), 0x20).astype(np.uint8)
_BYTES[ord("A") : ord("Z") + 1] += 32
_TABLE = _BYTES.tobytes()


def terms_of(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """All terms of the texts one after another, as binary, and where each text's terms begin (one entry more at the end)."""
    texts = texts.cast(pa.large_binary())
    edges = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
    data = texts.buffers()[2] if len(texts) else None
    raw = np.frombuffer(bytes(memoryview(data)[edges[0] : edges[-1]]).translate(_TABLE) if data is not None else b"", np.uint8)
    edges = edges - edges[0]
    inside = raw != 0x20
    new = inside.copy()
    new[1:] &= ~inside[:-1]
    begins = edges[:-1][edges[:-1] < edges[1:]]
    new[begins] = inside[begins]
    start = np.flatnonzero(new)
    kept = np.cumsum(inside, dtype=np.int64)
    offsets = np.append(kept[start] - 1, kept[-1:]) if len(start) else np.zeros(1, np.int64)
    flat = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(start), [None, pa.py_buffer(offsets), pa.py_buffer(raw[inside])])
    return flat, np.searchsorted(start, edges)


def postings(docs: DataFrame, vocabulary: list[bytes]) -> DataFrame:
    """doc_id, n (terms with repeats), terms (numbers in the vocabulary), tf (their counts): a row for each document with a term."""
    known = pa.array(vocabulary, pa.large_binary())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "text"):
                flat, edges = terms_of(batch.column("text"))
                coded = flat.dictionary_encode()
                found = np.asarray(pc.fill_null(pc.index_in(coded.dictionary, known), -1)).astype(np.int64)
                term = found[np.asarray(coded.indices)] if len(flat) else np.empty(0, np.int64)
                row = np.repeat(np.arange(len(batch)), np.diff(edges))
                held = term >= 0
                keys, tf = np.unique(row[held] << 32 | term[held], return_counts=True)
                begin = pa.array(np.searchsorted(keys >> 32, np.arange(len(batch) + 1)), pa.int32())
                lists = [pa.ListArray.from_arrays(begin, pa.array(x, pa.int32())) for x in (keys & 0xFFFFFFFF, tf)]
                made = pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(np.diff(edges)), *lists], ["doc_id", "n", "terms", "tf"])
                yield made.filter(pc.greater(made.column("n"), 0))

    return docs.select("doc_id", text_or_empty().alias("text")).mapInArrow(run, "doc_id long, n long, terms array<int>, tf array<int>")


class ImpactLists:
    """The impact lists of a part's documents: for each term its documents, highest impact first, and each document's position."""

    def __init__(self, n_rows: int, n_terms: int, rows: np.ndarray, terms: np.ndarray, impacts: np.ndarray) -> None:
        order = np.lexsort((rows, -impacts, terms))
        self.rows, self.impacts = rows[order], impacts[order]
        self.begin = np.searchsorted(terms[order], np.arange(n_terms + 1))
        self.position = np.zeros((n_terms, n_rows), np.uint16)  # from 1; 0: not in the list
        self.position[terms[order], self.rows] = np.arange(len(order)) - self.begin[terms[order]] + 1

    def search(self, terms: np.ndarray, k: int, floor: int) -> tuple[np.ndarray, np.ndarray, int]:
        """Rows and scores of this part's documents that may be among the k best of an item, ties with the kth included; and how many entries were read.

        floor: a score that k documents of other parts have, 0 if there is none.
        """
        begin, size = self.begin[terms], np.diff(self.begin)[terms]
        terms, begin, size = terms[size > 0], begin[size > 0], size[size > 0]
        known, rows, scores = np.zeros(self.position.shape[1], bool), [np.empty(0, np.int64)], [np.empty(0, np.int64)]
        seen = [np.zeros(n + 2, bool) for n in size]  # by position, from 1; one more that never is
        best, read, low, step = np.zeros(len(terms), np.int64), 0, 0, STEP
        while len(terms) and low < size.max():
            ends = np.minimum(low + step, size)
            new = np.unique(np.concatenate([self.rows[b + low : b + e] for b, e in zip(begin, ends, strict=True) if e > low]))
            read += int(np.maximum(ends - low, 0).sum())
            new = new[~known[new]]
            known[new] = True
            at = self.position[terms[:, None], new].astype(np.int64)  # direct accesses
            rows.append(new)
            scores.append(np.where(at > 0, self.impacts[np.maximum(begin[:, None] + at - 1, 0)], 0).sum(axis=0))
            for i, marks in enumerate(seen):
                marks[at[i]] = True
                marks[0] = False
                best[i] += int(np.argmin(marks[best[i] + 1 :]))
            bound = int(np.where(best < size, self.impacts[begin + np.maximum(best, 1) - 1], 0).sum())
            found = np.concatenate(scores)
            kth = max(floor, int(np.partition(found, len(found) - k)[len(found) - k]) if len(found) >= k else 0)
            if bound < kth:
                break
            low, step = low + step, 2 * step
        found, rows = np.concatenate(scores), np.concatenate(rows)
        kth = max(floor, 1, int(np.partition(found, len(found) - k)[len(found) - k]) if len(found) >= k else 0)
        return rows[found >= kth], found[found >= kth], read


def _best(ids: list, scores: np.ndarray, k: int) -> np.ndarray:
    """Places of the k best by score, ties by id, null ids last."""
    order = sorted(range(len(ids)), key=lambda i: (-int(scores[i]), ids[i] is None, ids[i] or 0))
    return np.array(order[:k], np.int64)


def _groups(items: list[np.ndarray]) -> Iterator[tuple[list[int], np.ndarray]]:
    """Numbers of items with up to GROUP_TERMS distinct terms together, and these terms; an item with more stands alone."""
    group, terms = [], np.empty(0, np.int64)
    for i, own in enumerate(items):
        both = np.union1d(terms, own)
        if group and len(both) > GROUP_TERMS:
            yield group, terms
            group, both = [], own
        group, terms = [*group, i], both
    if group:
        yield group, terms


def _searcher(items: list[np.ndarray], weights: np.ndarray, n_docs: int, n_all: int, k: int):
    """For mapInArrow: each task's k best documents of every item, from its postings, part by part."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        top: list[tuple[list, np.ndarray]] = [([], np.empty(0, np.int64)) for _ in items]
        groups = []
        for members, terms in _groups(items):
            local = np.full(len(weights), -1)
            local[terms] = np.arange(len(terms))
            groups.append((members, len(terms), local))
        for batch in batches:
            for low in range(0, batch.num_rows, PART):
                part = batch.slice(low, PART)
                ids = part.column("doc_id").to_pylist()
                n = np.asarray(part.column("n"))
                rows = np.repeat(np.arange(len(ids)), np.asarray(pc.list_value_length(part.column("terms"))))
                terms = np.asarray(part.column("terms").flatten()).astype(np.int64)
                tf = np.asarray(part.column("tf").flatten()).astype(np.int64)
                m = 50 + 50 * n * n_docs // n_all
                impacts = weights[terms] * (1_000_000_000 * tf // (1000 * tf + 20 * m[rows]))
                for members, n_terms, local in groups:
                    held = local[terms] >= 0
                    lists = ImpactLists(len(ids), n_terms, rows[held], local[terms[held]], impacts[held])
                    for i in members:
                        best, scores = top[i]
                        found, more, _ = lists.search(local[items[i]], k, int(scores[-1]) if len(best) == k else 0)
                        if len(found):
                            best, scores = best + [ids[r] for r in found.tolist()], np.append(scores, more)
                            keep = _best(best, scores, k)
                            top[i] = [best[x] for x in keep.tolist()], scores[keep]
        for i, (best, scores) in enumerate(top):
            if best:
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(best), i, np.int32)), pa.array(best, pa.int64()), pa.array(scores)], ["item", "doc_id", "score"])

    return run


def _blocks(items: DataFrame) -> list[DataFrame]:
    """items in parts of about BLOCK_BYTES of text."""
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = -(-total // BLOCK_BYTES)
    return [items.where(F.pmod(F.xxhash64("item_id"), F.lit(n)) == b) for b in range(n)]


def search(docs: DataFrame, items: DataFrame, k: int = TOP) -> DataFrame:
    """item_id, rank, doc_id, score: each item's k best documents with a score above 0; equal scores by ascending doc_id.

    docs(doc_id, text) and items(item_id, text) of any size: items are searched in blocks. Null and empty texts have no terms; an
    item is known by its id, so repeated ones are one item with the terms of all. Repeated documents are ranked each by itself; a
    null doc_id comes last among ties. Other columns are ignored; an empty table on either side gives no rows.
    """
    spark = docs.sparkSession
    found = None
    items = items.select("item_id", text_or_empty().alias("text"))
    for block in _blocks(items):
        texts = block.collect()  # bounded by BLOCK_BYTES
        flat, edges = terms_of(pa.array([r["text"] for r in texts], pa.string()))
        vocabulary = pc.unique(flat)
        if not len(vocabulary):
            continue
        number = np.asarray(pc.index_in(flat, vocabulary)).astype(np.int64)
        by_item: dict[object, list[np.ndarray]] = {}
        for i, r in enumerate(texts):
            by_item.setdefault(r["item_id"], []).append(number[edges[i] : edges[i + 1]])
        ids, terms = list(by_item), [np.unique(np.concatenate(x)) for x in by_item.values()]
        rows = written(postings(docs, vocabulary.to_pylist()), "postings")
        n_docs, n_all = rows.agg(F.count("*"), F.sum("n")).first()
        if not n_docs:
            continue
        df = rows.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("df"))
        weighed = df.select("term", F.floor(1000 * F.log((2.0 * n_docs + 2) / (2.0 * F.col("df") + 1))).alias("w")).collect()
        weights = np.zeros(len(vocabulary), np.int64)  # a row for each term of the block at most
        for r in weighed:
            weights[r["term"]] = r["w"]
        best = rows.mapInArrow(_searcher(terms, weights, n_docs, n_all, k), "item int, doc_id long, score long")
        named = spark.createDataFrame(list(enumerate(ids)), f"item int, item_id {dict(items.dtypes)['item_id']}")
        best = best.join(F.broadcast(named), "item").drop("item")
        found = best if found is None else found.unionByName(best)
    if found is None:
        kind = dict(items.dtypes)["item_id"]
        return spark.createDataFrame([], f"item_id {kind}, rank int, doc_id long, score long")
    order = [F.desc("score"), F.asc_nulls_last("doc_id")]
    salted = found.withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(16)))
    some = salted.withColumn("rank", F.row_number().over(Window.partitionBy("item_id", "salt").orderBy(*order))).where(F.col("rank") <= k)
    ranked = some.withColumn("rank", F.row_number().over(Window.partitionBy("item_id").orderBy(*order)))
    return ranked.where(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score")
