"""Best-fit packing of tokenised documents into sequences of bounded length.

Best-fit decreasing over the whole corpus, exactly, without moving a document to the driver: best fit looks only at
lengths, and lengths are 1..capacity. So the plan is made from the histogram of lengths (at most `capacity` rows, whatever
the corpus holds): runs of pieces of one length go to runs of open bins with one remaining capacity. A segment tree over
the remaining capacities finds the tightest open bins in logarithmic time. The plan then joins the pieces by (length, rank).
"""

from __future__ import annotations

from collections import defaultdict, deque
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from surveyqc.llm.common import slices, text_table, words_of, written

CAPACITY = 4096
END_ID = 1
#: Rows of one length that are ranked together, on average, if all rows had one length.
RANK_ROWS = 1_000
#: Bytes of text that are tokenised at once.
SLICE = 8 << 20
PIECES = "doc_id long, piece int, start long, length long, ids binary"


class SegmentTree:
    """Over capacities 0..n: which have open bins; `at_least` finds the smallest such capacity >= c in O(log n)."""

    def __init__(self, n: int) -> None:
        self.size = 1 << (n + 1).bit_length()
        self.any = bytearray(2 * self.size)

    def set(self, i: int, value: bool) -> None:
        i += self.size
        self.any[i] = value
        while i > 1:
            i >>= 1
            self.any[i] = self.any[2 * i] | self.any[2 * i + 1]

    def at_least(self, c: int) -> int | None:
        i = c + self.size
        if self.any[i]:
            return c
        while i > 1:
            if not i & 1 and self.any[i + 1]:
                i += 1
                while i < self.size:
                    i = 2 * i if self.any[2 * i] else 2 * i + 1
                return i - self.size
            i >>= 1
        return None


def best_fit_plan(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int, int]]:
    """Best-fit decreasing over counts by length.

    Returns runs (length, first_rank, end_rank, per_bin, first_sequence, offset): the pieces of that length with ranks
    [first_rank, end_rank) go, per_bin to a sequence, to sequences from first_sequence on, the first of each at offset.
    """
    tree, open_bins = SegmentTree(capacity), defaultdict(deque)
    plan, opened = [], 0

    def put(room: int, first: int, n: int) -> None:
        if n and room:
            open_bins[room].append((first, n))
            tree.set(room, True)

    for length in sorted(histogram, reverse=True):
        rank, left = 0, histogram[length]
        while left:
            room = tree.at_least(length)
            if room is None:
                room, first, n = capacity, opened, -(-left // (capacity // length))
                opened += n
            else:
                first, n = open_bins[room].popleft()
                if not open_bins[room]:
                    tree.set(room, False)
            per_bin = room // length
            whole = min(n, left // per_bin)
            if whole:
                plan.append((length, rank, rank + whole * per_bin, per_bin, first, capacity - room))
                rank, left = rank + whole * per_bin, left - whole * per_bin
                put(room - per_bin * length, first, whole)
                first, n = first + whole, n - whole
            if n and left:  # fewer pieces than one more bin of this run takes
                plan.append((length, rank, rank + left, left, first, capacity - room))
                put(room - left * length, first, 1)
                first, n, left = first + 1, n - 1, 0
            put(room, first, n)
    return plan


class WordEncoder:
    """Ids of words (texts without white space).

    White space separates tokens in this vocabulary, so a text's ids are its words' ids. Words of letters alone are one
    stretch that ends in an end-of-word token, so many go to the tokenizer in one call and are cut apart at those tokens.
    Marks after a letter or digit are a stretch of their own; most distinct words differ from others by them alone.
    """

    MARKS = ".,;:!?#*$%&()"
    AT_ONCE = 100

    def __init__(self, tokenizer_path: str) -> None:
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(tokenizer_path)
        vocabulary = self.tok.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, dtype=bool)
        self.ends[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True

    def _encoded(self, texts: list[str]) -> Iterator[list[int]]:
        for i in range(0, len(texts), self.AT_ONCE):  # encodings hold much besides the ids
            for coded in self.tok.encode_batch_fast(texts[i : i + self.AT_ONCE], add_special_tokens=False):
                yield coded.ids

    def _each(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        found = [np.array(ids, "<u4") for ids in self._encoded(words)]
        return np.concatenate([np.empty(0, "<u4"), *found]), np.fromiter(map(len, found), np.int64, len(found))

    def _joined(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        found = []
        groups = [words[i : i + 200] for i in range(0, len(words), 200)]
        for group, coded in zip(groups, self._encoded([" ".join(g) for g in groups]), strict=True):
            ids = np.array(coded, "<u4")
            ends = np.flatnonzero(self.ends[ids]) + 1
            # A letter whose lower case is more than letters ends more than one stretch.
            found.append((ids, np.diff(ends, prepend=0)) if len(ends) == len(group) else self._each(group))
        return tuple(map(np.concatenate, zip(*found, strict=True))) if found else self._each([])

    def _all(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids, and where in them each word begins and how many it has."""
        plain = pc.match_substring_regex(words, r"^\pL+$")
        halves = [self._joined(words.filter(plain).to_pylist()), self._each(words.filter(pc.invert(plain)).to_pylist())]
        ids, size = map(np.concatenate, zip(*halves, strict=True))
        place = np.argsort(~np.asarray(plain), kind="stable")  # of each word in the two lists
        begin, count = np.empty_like(size), np.empty_like(size)
        begin[place], count[place] = np.cumsum(size) - size, size
        return ids, begin, count

    def __call__(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids, and of each word twice (its stem, its marks) where they begin and how many they are."""
        stems = pc.utf8_rtrim(words, self.MARKS)
        stems = pc.if_else(pc.match_substring_regex(stems, r"[\pL\pN]$"), stems, words)
        longer = pc.greater(pc.binary_length(words), pc.binary_length(stems))
        marks = pc.if_else(longer, pc.replace_substring_regex(words, r"(?s)^.*[\pL\pN]([^\pL\pN]+)$", r"\1"), "")
        begin, count, ids, at = np.empty((len(words), 2), np.int64), np.empty((len(words), 2), np.int64), [], 0
        for k, half in enumerate((stems.dictionary_encode(), marks.dictionary_encode())):
            own, b, n = self._all(half.dictionary)
            codes = np.asarray(half.indices)
            begin[:, k], count[:, k], at = b[codes] + at, n[codes], at + len(own)
            ids.append(own)
        return np.concatenate(ids), begin, count


@lru_cache(maxsize=1)
def word_encoder(tokenizer_path: str) -> WordEncoder:
    """One for each Python worker, which serves many tasks."""
    return WordEncoder(tokenizer_path)


def tokenize(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids (little-endian unsigned 32-bit, as binary).

    Every text is tokenised whole, then end_id follows; longer ones are cut every `capacity` tokens. A null or empty text
    gives one piece with end_id alone. Repeated rows give repeated pieces; other columns are ignored; an empty table gives none.
    """

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        words, edges = words_of(batch.column("text"))
        coded = words.dictionary_encode()
        codes = np.asarray(coded.indices)
        flat, begin, count = word_encoder(tokenizer_path)(coded.dictionary)
        end = len(flat)  # an end after each document's words
        begin = np.insert(begin[codes], edges[1:], end, axis=0).ravel()
        count = np.insert(count[codes], edges[1:], [1, 0], axis=0).ravel()
        flat = np.append(flat, np.uint32(end_id))
        ends = np.cumsum(count)
        at = np.repeat((begin - (ends - count)).astype(np.int32), count)
        at += np.arange(ends[-1], dtype=np.int32)
        ids = flat[at]
        ends = ends[1::2]
        doc_end = ends[edges[1:] + np.arange(len(edges) - 1)]
        doc_len = np.diff(doc_end, prepend=0)
        pieces = -(-doc_len // capacity)
        row = np.repeat(np.arange(len(doc_len)), pieces)
        piece = np.arange(len(row)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        start = piece * capacity
        length = np.minimum(capacity, doc_len[row] - start)
        data = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(row), [None, pa.py_buffer(np.append(0, np.cumsum(length)) * 4), pa.py_buffer(ids.astype("<u4"))])
        return pa.RecordBatch.from_arrays([batch.column("doc_id").take(pa.array(row)), pa.array(piece, pa.int32()), pa.array(start), pa.array(length), pc.cast(data, pa.binary())], ["doc_id", "piece", "start", "length", "ids"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "text", SLICE):
                yield work(batch)

    return text_table(docs).mapInArrow(run, PIECES)


def assign_sequences(pieces: DataFrame, order: list[str], capacity: int = CAPACITY) -> DataFrame:
    """Adds sequence_id and offset to rows with a column `length` (1..capacity); `order` makes ranks deterministic.

    pieces is read three times: give a written table of narrow rows. Ranks within a length come from (length, bucket) groups
    with counted offsets, so that a length that many rows share is ranked by many tasks. Empty input gives an empty result.
    """
    spark = pieces.sparkSession
    histogram = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}  # at most `capacity` rows
    buckets = max(64, min(4096, -(-sum(histogram.values()) // RANK_ROWS)))
    plan = best_fit_plan(histogram, capacity)
    runs = spark.createDataFrame(plan, "length long, first_rank long, end_rank long, per_bin long, first_sequence long, base long")
    keyed = pieces.withColumn("bucket_", F.pmod(F.xxhash64(*order), F.lit(buckets)))
    before = keyed.groupBy("length", "bucket_").agg(F.count("*").alias("n_"))
    before = before.withColumn("before_", F.sum("n_").over(Window.partitionBy("length").orderBy("bucket_")) - F.col("n_")).drop("n_")
    ranked = keyed.withColumn("row_", F.row_number().over(Window.partitionBy("length", "bucket_").orderBy(*order)) - 1)
    ranked = ranked.join(before, ["length", "bucket_"]).withColumn("rank_", F.col("before_") + F.col("row_"))
    # The plan has at most some ten runs for each of the `capacity` lengths, however large the corpus.
    placed = ranked.join(F.broadcast(runs.withColumnRenamed("length", "length_")), (F.col("length") == F.col("length_")) & (F.col("rank_") >= F.col("first_rank")) & (F.col("rank_") < F.col("end_rank")))
    nth = F.col("rank_") - F.col("first_rank")
    return placed.select(
        *pieces.columns,
        (F.col("first_sequence") + F.expr("(rank_ - first_rank) div per_bin")).alias("sequence_id"),
        (F.col("base") + nth % F.col("per_bin") * F.col("length")).alias("offset"),
    )


def pack(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY) -> DataFrame:
    """Where each piece of each document goes: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    pieces = tokenize(docs, tokenizer_path, capacity).withColumn("ids_crc32", F.crc32("ids")).drop("ids")
    return assign_sequences(written(pieces, "pieces"), ["doc_id", "piece", "ids_crc32"], capacity)


def sequences(pieces: DataFrame, placed: DataFrame) -> DataFrame:
    """The packed sequences themselves: sequence_id, n_tokens, ids (binary). doc_id must be unique in the corpus."""
    rows = placed.select("doc_id", "piece", "sequence_id", "offset").join(pieces.select("doc_id", "piece", "length", "ids"), ["doc_id", "piece"])
    tokens = F.expr("aggregate(sort_array(collect_list(struct(offset, ids))), X'', (a, x) -> a || x.ids)")  # at most `capacity` tokens
    return rows.groupBy("sequence_id").agg(F.sum("length").alias("n_tokens"), tokens.alias("ids"))
