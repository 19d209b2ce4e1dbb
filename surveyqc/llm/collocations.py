"""Phrase collocations: phrases of two to four words that occur together more than their parts do.

Counts are exact and made level by level: words, then pairs of frequent words, then phrases all of whose pairs are frequent.
A task counts in a HAT-trie: a shallow trie over word ids, whose containers hold the phrases of a range of prefixes and burst into
two when they grow, down to containers of one prefix. Beyond a size the trie spills its largest subtrees as sorted runs; runs are
dealt by prefix and merged there. What is frequent on one level reaches the tasks of the next as a bitmap of bounded size, which
lets through too much, never too little.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from surveyqc.llm.common import slices, small_or_shuffled, text_or_empty, written

MIN_COUNT = 30
LONGEST = 4
TOP = 2000
#: A phrase goes if a longer one that holds it has this share (in hundredths) of its occurrences.
SUBSUMED = 80
#: Fixed by the contract: scores are floors of parts of this.
SCALE = 2_000_000
#: Entries of a container that bursts, and of all of a task's that spill (16 bytes each).
BURST, LIMIT = 1 << 16, 2_000_000
#: Words that are counted at once; words and pairs that a task numbers before it spills and begins again.
AT_ONCE, NUMBERED = 1 << 19, 1 << 20
#: Bits of a bitmap of frequent phrases at most (32 MB).
MAX_BITS = 28
RUNS = "part int, lang string, phrase string, n long"

_WORD, _BLANK, _BREAK = 0, 1, 2
_KIND = np.zeros(256, np.uint8)
_KIND[[0x20, 0x09]] = _BLANK
_KIND[[*b".,;:!?", *range(0x0A, 0x0E)]] = _BREAK
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32


@dataclass
class Words:
    """The words of some texts: distinct ones, the code of each word, and whether it follows on the word before in its piece."""

    distinct: pa.Array
    codes: np.ndarray
    follows: np.ndarray


def split_words(texts: pa.Array) -> Words:
    """Words of texts: A-Z lower-cased, pieces cut at marks and line ends, words cut at spaces and tabs."""
    texts = texts.cast(pa.large_binary())
    edges = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = texts.buffers()[2]
    raw = _LOWER[np.frombuffer(data, np.uint8)[edges[0] : edges[-1]] if data is not None else np.empty(0, np.uint8)]
    kind, edges = _KIND[raw], edges - edges[0]
    word = kind == _WORD
    new = word.copy()
    new[1:] &= ~word[:-1]
    starts_text = edges[:-1][edges[:-1] < edges[1:]]
    new[starts_text] = word[starts_text]
    start = np.flatnonzero(new)
    cut = (kind == _BREAK).astype(np.int32)
    cut[starts_text] += 1
    before = np.cumsum(cut, dtype=np.int32)[start]
    follows = np.zeros(len(start), bool)
    follows[1:] = before[1:] == before[:-1]
    kept = np.cumsum(word, dtype=np.int64)
    offsets = np.append(kept[start] - 1, kept[-1:]) if len(start) else np.zeros(1, np.int64)
    flat = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(start), [None, pa.py_buffer(offsets), pa.py_buffer(raw[word])])
    coded = flat.dictionary_encode()
    return Words(coded.dictionary, np.asarray(coded.indices).astype(np.int64), follows)


def word_hashes(words: pa.Array) -> np.ndarray:
    from xxhash import xxh64_intdigest

    return np.fromiter(map(xxh64_intdigest, words.to_pylist()), np.uint64, len(words))


def phrase_hashes(lang: str, *words: np.ndarray) -> np.ndarray:
    """One hash for each phrase, from its words' hashes."""
    from xxhash import xxh64_intdigest

    h = np.full(len(words[0]), xxh64_intdigest(lang), np.uint64)
    for w in words:
        h = (h ^ w) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
    return h


class Bitmap:
    """A set of hashes without false negatives."""

    def __init__(self, bits: int, slots: np.ndarray, values: np.ndarray) -> None:
        self.bits, self.map = bits, np.zeros(1 << (bits - 6), np.uint64)
        self.map[slots] = values

    def __contains__(self, h: int) -> bool:
        return bool(self.has(np.array([h], np.uint64))[0])

    def has(self, h: np.ndarray) -> np.ndarray:
        at = h >> np.uint64(64 - self.bits)
        return (self.map[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63)) & np.uint64(1)).astype(bool)


class Container:
    """An array hash: blocks of (key, count) that are combined when they have grown to twice what they came to last."""

    def __init__(self, keys: np.ndarray, counts: np.ndarray) -> None:
        self.blocks, self.size, self.combined = [(keys, counts)], len(keys), len(keys)

    def add(self, keys: np.ndarray, counts: np.ndarray) -> None:
        self.blocks.append((keys, counts))
        self.size += len(keys)
        if self.size > 2 * self.combined:
            self.combine()

    def combine(self) -> tuple[np.ndarray, np.ndarray]:
        """Keys, ascending, and their counts."""
        keys, counts = map(np.concatenate, zip(*self.blocks, strict=True))
        if len(self.blocks) > 1:
            order = np.argsort(keys, kind="stable")
            keys, counts = keys[order], counts[order]
            first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else np.empty(0, np.int64)
            keys, counts = keys[first], np.add.reduceat(counts, first) if len(keys) else counts
        self.blocks, self.size, self.combined = [(keys, counts)], len(keys), len(keys)
        return keys, counts


class HatTrie:
    """Counts of phrases, packed as a prefix (the high 32 bits) and what follows it: a root over containers of ranges of prefixes.

    A container with over `burst` entries bursts into two of half its entries each, down to one of a single prefix, which may grow.
    `spill` gives back the sorted runs of whole subtrees and forgets them.
    """

    def __init__(self, burst: int = BURST) -> None:
        self.burst, self.bounds, self.nodes = burst, np.zeros(1, np.int64), [Container(*[np.empty(0, np.int64)] * 2)]

    @property
    def size(self) -> int:
        return sum(x.size for x in self.nodes)

    def add(self, keys: np.ndarray, counts: np.ndarray) -> None:
        """Adds counts of distinct keys, ascending."""
        edges = [*np.searchsorted(keys, self.bounds).tolist(), len(keys)]
        for i in range(len(self.nodes) - 1, -1, -1):
            a, b = edges[i], edges[i + 1]
            if a < b:
                self.nodes[i].add(keys[a:b], counts[a:b])
                if self.nodes[i].size > self.burst:
                    self._burst(i)

    def _burst(self, i: int) -> None:
        keys, counts = self.nodes[i].combine()
        if len(keys) <= max(self.burst, 1) or keys[0] >> 32 == keys[-1] >> 32:
            return
        middle = keys[len(keys) // 2] >> 32 << 32  # a prefix is never cut
        if middle <= keys[0]:
            middle = (keys[len(keys) // 2] >> 32) + 1 << 32
        cut = int(np.searchsorted(keys, middle))
        self.nodes[i : i + 1] = [Container(keys[:cut], counts[:cut]), Container(keys[cut:], counts[cut:])]
        self.bounds = np.insert(self.bounds, i + 1, middle)
        self._burst(i + 1)
        self._burst(i)

    def spill(self, down_to: int = 0) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Sorted runs of containers, the largest first, until at most down_to entries are left."""
        size = self.size
        for i in sorted(range(len(self.nodes)), key=lambda i: -self.nodes[i].size):
            if size <= down_to:
                break
            size -= self.nodes[i].size
            yield self.nodes[i].combine()
            self.nodes[i] = Container(*[np.empty(0, np.int64)] * 2)


def _by_lang(batch: pa.RecordBatch) -> Iterator[tuple[str, pa.Array]]:
    lang = batch.column("lang").dictionary_encode()
    for k, name in enumerate(lang.dictionary.to_pylist()):
        yield name, batch.column("text").filter(pc.equal(lang.indices, k))


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), text_or_empty().alias("text"))


def _table(lang: str, phrases: pa.Array | None, n: np.ndarray, part: np.ndarray | None = None) -> pa.RecordBatch:
    part = np.zeros(len(n), np.int32) if part is None else part
    phrases = pa.nulls(len(n), pa.string()) if phrases is None else phrases.cast(pa.string())
    return pa.RecordBatch.from_arrays([pa.array(part, pa.int32()), pa.array([lang], pa.string()).take(pa.array(np.zeros(len(n), np.int32))), phrases, pa.array(n, pa.int64())], ["part", "lang", "phrase", "n"])


def word_runs(docs: DataFrame, limit: int = LIMIT) -> DataFrame:
    """part, lang, phrase, n: counts of words by task; a null phrase counts all words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        totals: Counter = Counter()
        size = 0

        def combined() -> list[pa.RecordBatch]:
            both = pa.Table.from_batches(held).group_by(["part", "lang", "phrase"]).aggregate([("n", "sum")])
            return both.rename_columns(["part", "lang", "phrase", "n"]).select(["part", "lang", "phrase", "n"]).combine_chunks().to_batches()

        for whole in batches:
            for batch in slices(whole, "text"):
                for lang, texts in _by_lang(batch):
                    words = split_words(texts)
                    totals[lang] += len(words.codes)
                    held.append(_table(lang, words.distinct, np.bincount(words.codes, minlength=len(words.distinct))))
                    size += len(words.distinct)
                if size > limit:
                    held = combined()
                    size = sum(x.num_rows for x in held)
                    if size > limit // 2:
                        yield from held
                        held, size = [], 0
        if held:
            yield from combined()
        yield from (_table(lang, None, np.array([n])) for lang, n in totals.items())

    return _texts(docs).mapInArrow(run, RUNS)


class Numbers:
    """Numbers of things that a task has met, in order."""

    def __init__(self) -> None:
        self.of: dict = {}

    def __call__(self, found: list) -> np.ndarray:
        of = self.of
        return np.fromiter((of.setdefault(x, len(of)) for x in found), np.int64, len(found))


def phrase_runs(docs: DataFrame, depth: int, frequent, hot, burst: int = BURST, limit: int = LIMIT) -> DataFrame:
    """part, lang, phrase, n: sorted runs of phrase counts by task.

    depth is the number of words of a prefix. With 1, phrases are pairs of words of which both are in the broadcast Bitmap
    `frequent`; with 2, they are three or four words of which all pairs are in it. hot: broadcast hashes of the prefixes that are dealt
    one word deeper. part is a hash of the prefix by which runs are merged.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tries: dict[str, HatTrie] = {}
        words_met, pairs_met = Numbers(), Numbers()  # pairs are packed numbers of two words

        def out(down_to: int) -> Iterator[pa.RecordBatch]:
            """Spills the tries, the largest first, until all together hold down_to entries."""
            names = pa.array(list(words_met.of), pa.large_binary())
            hashes = word_hashes(names)
            pairs = np.fromiter(pairs_met.of, np.int64, len(pairs_met.of))
            for lang, trie in sorted(tries.items(), key=lambda x: -x[1].size):
                excess = sum(t.size for t in tries.values()) - down_to
                if excess <= 0:
                    return
                for keys, n in trie.spill(max(0, trie.size - excess)):
                    high, low = keys >> 32, keys & 0xFFFFFFFF
                    if depth == 1:
                        found = [([high, low], np.arange(len(keys)))]
                    else:
                        first, second = pairs[high], pairs[low >> 1]
                        a, b, c, d = first >> 32, first & 0xFFFFFFFF, second >> 32, second & 0xFFFFFFFF
                        three, four = np.flatnonzero(low & 1 == 0), np.flatnonzero(low & 1)
                        found = [([a[three], b[three], d[three]], three), ([a[four], b[four], c[four], d[four]], four)]
                    for ids, at in found:
                        if len(at):
                            h = [hashes[i] for i in ids]
                            prefix = phrase_hashes(lang, *h[:depth])
                            prefix = np.where(np.isin(prefix, hot.value), phrase_hashes(lang, *h[: depth + 1]), prefix)
                            phrases = pc.binary_join_element_wise(*[names.take(pa.array(i)) for i in ids], pa.scalar(b" ", pa.large_binary()))
                            yield _table(lang, phrases, n[at], (prefix >> np.uint64(33)).astype(np.int32))

        def count(lang: str, words: Words, h: np.ndarray, low: int) -> None:
            """Counts the phrases that begin at the AT_ONCE words from low on."""
            code, follows = words.codes[low : low + AT_ONCE + LONGEST - 1], words.follows[low : low + AT_ONCE + LONGEST - 1]
            at = np.flatnonzero(follows[1:])
            if depth == 1:
                good = frequent.value.has(phrase_hashes(lang, h))
                at = at[good[code[at]] & good[code[at + 1]] & (at < AT_ONCE)]
            keys, pair, n = np.unique(code[at] << 32 | code[at + 1], return_inverse=True, return_counts=True)
            first, second = keys >> 32, keys & 0xFFFFFFFF
            if depth == 2:
                good = frequent.value.has(phrase_hashes(lang, h[first], h[second]))
                at, pair, first, second = at[good[pair]], (np.cumsum(good) - 1)[pair[good[pair]]], first[good], second[good]
            used = np.unique(np.concatenate([first, second]))
            ids = np.zeros(len(h), np.int64)
            ids[used] = words_met(words.distinct.take(pa.array(used)).to_pylist())
            packed = ids[first] << 32 | ids[second]
            trie = tries.setdefault(lang, HatTrie(burst))
            if depth == 1:
                order = np.argsort(packed)
                trie.add(packed[order], n[order])
                return
            pair_number = pairs_met(packed.tolist())
            pair_at = np.full(len(code) + 2, -1)
            pair_at[at] = pair_number[pair]
            at = at[(pair_at[at + 1] >= 0) & (at < AT_ONCE)]
            four = at[pair_at[at + 2] >= 0]
            trie.add(*np.unique(np.concatenate([pair_at[at] << 32 | pair_at[at + 1] << 1, pair_at[four] << 32 | pair_at[four + 2] << 1 | 1]), return_counts=True))

        for whole in batches:
            for batch in slices(whole, "text"):
                for lang, texts in _by_lang(batch):
                    words = split_words(texts)
                    h = word_hashes(words.distinct)
                    for low in range(0, len(words.codes), AT_ONCE):
                        count(lang, words, h, low)
                        if len(words_met.of) + len(pairs_met.of) > NUMBERED:
                            yield from out(0)
                            tries.clear()
                            words_met, pairs_met = Numbers(), Numbers()
                        elif sum(t.size for t in tries.values()) > limit:
                            yield from out(limit // 2)
        yield from out(0)

    return _texts(docs).mapInArrow(run, RUNS)


def merged(runs: DataFrame, min_count: int, name: str) -> DataFrame:
    """lang, phrase, f >= min_count: runs dealt by their prefix and merged there, as a written table."""
    n = int(runs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    summed = runs.repartition(n, "part").groupBy("part", "lang", "phrase").agg(F.sum("n").alias("f"))
    return written(summed.where(F.col("f") >= min_count).select("lang", "phrase", "f"), name)


def bitmap(spark: SparkSession, frequent: DataFrame):
    """A broadcast Bitmap of the phrases of frequent(lang, phrase): at most 2 ** MAX_BITS bits, combined by Spark."""
    bits = min(MAX_BITS, max(16, (16 * frequent.count()).bit_length()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lang, phrases in _by_lang(batch):
                found = pc.split_pattern(phrases, " ")
                words, size = found.flatten(), np.asarray(pc.list_value_length(found))
                h, begin = word_hashes(words), np.cumsum(size) - size
                for k in np.unique(size):
                    own = begin[size == k]
                    at = phrase_hashes(lang, *(h[own + i] for i in range(k))) >> np.uint64(64 - bits)
                    yield pa.RecordBatch.from_arrays([pa.array((at >> np.uint64(6)).astype(np.int64)), pa.array((np.uint64(1) << (at & np.uint64(63))).view(np.int64))], ["slot", "value"])

    marks = frequent.select("lang", F.col("phrase").alias("text")).mapInArrow(run, "slot long, value long")
    found = marks.groupBy("slot").agg(F.bit_or("value").alias("value")).toArrow()
    return spark.sparkContext.broadcast(Bitmap(bits, np.asarray(found["slot"]), np.asarray(found["value"]).view(np.uint64)))


def hot_prefixes(spark: SparkSession, frequent: DataFrame):
    """The broadcast hashes of the phrases with more occurrences than a quarter of an even partition: at most four for each partition."""
    total = frequent.agg(F.sum("f")).first()[0] or 0
    share = 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = frequent.where(F.col("f") * share > total).collect()
    hashes = [phrase_hashes(r["lang"], *word_hashes(pa.array(r["phrase"].split(" "))).reshape(-1, 1))[0] for r in rows]
    return spark.sparkContext.broadcast(np.array(hashes, np.uint64))


def frequencies(docs: DataFrame, min_count: int = MIN_COUNT, burst: int = BURST, limit: int = LIMIT) -> tuple[DataFrame, DataFrame]:
    """(lang, phrase, f) of all phrases of one to four words with f >= min_count, and (lang, n) of all languages with a word.

    Counts are of contiguous words within pieces, overlaps included. Null and empty texts have no words; a null lang is `und`;
    repeated rows count each time; other columns are ignored; an empty table gives empty ones.
    """
    spark = docs.sparkSession
    counts = written(word_runs(docs, limit).groupBy("lang", "phrase").agg(F.sum("n").alias("f")).where(F.col("phrase").isNull() | (F.col("f") >= min_count)), "words")
    words = counts.where("phrase IS NOT NULL")
    pairs = merged(phrase_runs(docs, 1, bitmap(spark, words), hot_prefixes(spark, words), burst, limit), min_count, "pairs")
    longer = merged(phrase_runs(docs, 2, bitmap(spark, pairs), hot_prefixes(spark, pairs), burst, limit), min_count, "phrases")
    return words.unionByName(pairs).unionByName(longer), counts.where("phrase IS NULL AND f > 0").select("lang", F.col("f").alias("n"))


def _joined(words: Column, first: Column, n: Column) -> Column:
    return F.array_join(F.slice(words, first, n), " ")


def collocations(docs: DataFrame, min_count: int = MIN_COUNT, top: int = TOP) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: each language's best `top` phrases, by score, occurrences, then phrase.

    The score is the lowest over a phrase's cuts of SCALE * a / (l + r), floored; of equal cuts the first counts. Phrases that
    a longer candidate holds at SUBSUMED percent of their occurrences are left out.
    """
    f, totals = frequencies(docs, min_count)
    words = f.select("lang", "phrase", "f", F.split("phrase", " ").alias("words"))
    candidates = words.where(F.size("words") > 1)
    held = F.explode(F.flatten(F.transform(F.sequence(F.lit(2), F.size("words") - 1), lambda n: F.transform(F.sequence(F.lit(1), F.size("words") - n + 1), lambda i: _joined(F.col("words"), i, n)))))
    within = candidates.where(F.size("words") > 2).select("lang", held.alias("phrase"), F.col("f").alias("longer")).groupBy("lang", "phrase").agg(F.max("longer").alias("longer"))
    kept = candidates.join(within, ["lang", "phrase"], "left").where(F.expr(f"longer IS NULL OR cast(longer AS decimal(38,0)) * 100 < cast(f AS decimal(38,0)) * {SUBSUMED}"))
    cuts = kept.select("lang", "phrase", F.col("f").alias("a"), "words", F.explode(F.sequence(F.lit(1), F.size("words") - 1)).alias("k"))
    cuts = cuts.select("lang", "phrase", "a", "k", _joined(F.col("words"), F.lit(1), F.col("k")).alias("left"), _joined(F.col("words"), F.col("k") + 1, F.size("words")).alias("right"))
    part = lambda name, value: f.select("lang", F.col("phrase").alias(name), F.col("f").alias(value))
    scored = cuts.join(part("left", "l"), ["lang", "left"]).join(part("right", "r"), ["lang", "right"])
    scored = scored.withColumn("score", F.expr(f"cast(a AS decimal(19,0)) * {SCALE} div (cast(l AS decimal(19,0)) + r)"))
    lowest = scored.groupBy("lang", "phrase", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"))
    found = lowest.select("lang", "phrase", "a", "cut.l", "cut.r", "cut.score", F.pmod(F.xxhash64("phrase"), F.lit(64)).alias("salt"))
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    some = found.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "salt").orderBy(*order))).where(F.col("rank") <= top)
    best = some.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= top)
    return best.join(small_or_shuffled(totals), "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
