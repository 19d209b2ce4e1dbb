"""SimHash near-duplicates: fingerprints of word shingles, bit-sliced comparison within blocks, components over links.

Fingerprints within `radius` bits agree in at least blocks - radius of `blocks` equal blocks, so every pair meets in a bucket
of some choice of agreeing blocks. In a bucket fingerprints are stored as bit planes: one XOR compares a bit of 64 rows, and
carry-save counters add the differing bits of all of them; words in which every counter has passed the radius are abandoned.
A bucket gives a spanning forest of its links, never all its pairs, and large buckets are dealt as pairs of chunks.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations, pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from surveyqc.llm.common import slices, small_or_shuffled, text_or_empty, text_table, words_of, written

BITS = 64
#: Rows of a bucket that one task compares with each other; larger buckets are cut into chunks of half as many.
CHUNK = 4096
#: Planes after which abandoned words are dropped.
STEP = 8
#: Words of 64 rows that are counted at once.
CELLS = 16_384
#: Bytes of text that are sketched at once.
SLICE = 2 << 20


def _mixed(h: np.ndarray, k: int) -> np.ndarray:
    """The k-th of several hash functions made from one (k = 0: itself)."""
    if k:
        h = (h ^ np.uint64(k * 0x9E3779B97F4A7C15 % (1 << 64))) * np.uint64(0xBF58476D1CE4E5B9)
        h = (h ^ (h >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
        h ^= h >> np.uint64(32)
    return h


#: The lowest bit of each byte of a word.
LOWEST = np.uint64(0x0101010101010101)


def _bit_counts(hashes: np.ndarray, count: np.ndarray) -> np.ndarray:
    """How many of each text's hashes (count[i] > 0 of them) have each of the 64 bits set: eight bits are summed in the bytes of a word, 255 hashes at most."""
    parts = -(-count // 255)
    first = np.cumsum(parts) - parts
    begin = np.repeat(np.cumsum(count) - count - 255 * first, parts) + 255 * np.arange(parts.sum())
    ones = np.empty((len(count), 8, 8), np.int64)
    for k in range(8):
        sums = np.add.reduceat(hashes >> np.uint64(k) & LOWEST, begin)
        ones[:, :, k] = np.add.reduceat(sums.view(np.uint8).reshape(-1, 8), first, axis=0, dtype=np.int64)
    return ones.reshape(-1, 64)


def _majorities(hashes: np.ndarray, count: np.ndarray, words64: int) -> np.ndarray:
    """Fingerprints (words64 x texts): the bits that over half of a text's hashes, or of mixes of them, have set."""
    fp = np.zeros((words64, len(count)), np.uint64)
    full = np.flatnonzero(count)
    for k in range(words64 if len(full) else 0):
        over = 2 * _bit_counts(_mixed(hashes, k), count[full]) > count[full, None]
        fp[k, full] = np.packbits(over, axis=1, bitorder="little").view(np.uint64)[:, 0]
    return fp


def _stretches(edges: np.ndarray, shingle: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of texts whose words begin at edges: the number of shingles of each, and the first and last word of every shingle."""
    n = np.diff(edges)
    count = np.where(n == 0, 0, np.maximum(n - shingle + 1, 1))
    row = np.repeat(np.arange(len(n)), count)
    first = edges[row] + np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
    return count, first, np.minimum(first + shingle, edges[row + 1]) - 1


def fingerprints(docs: DataFrame, shingle: int = 3) -> DataFrame:
    """doc_id, f0 (signed 64-bit fingerprint) of each whole text, A-Z lower-cased.

    Over shingles with repeats, XXH64 with seed 42. A bit is 1 if it is set in over half of the hashes. Fewer words than a
    shingle: the whole sequence is the only one. A null or empty text has fingerprint 0. Repeated rows are kept; other columns
    are ignored.
    """

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        from xxhash import xxh64_intdigest

        words, edges = words_of(pc.ascii_lower(batch.column("text")))
        size = np.asarray(pc.binary_length(words), dtype=np.int64)
        joined = b" ".join(words.cast(pa.binary()).to_pylist())  # a shingle is a stretch of it
        begin = np.cumsum(size + 1) - size - 1
        count, first, last = _stretches(edges, shingle)
        hashes = np.fromiter((xxh64_intdigest(joined[a:b], 42) for a, b in zip(begin[first].tolist(), (begin[last] + size[last]).tolist(), strict=True)), np.uint64, len(first))
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), *map(pa.array, _majorities(hashes, count, 1).view(np.int64))], ["doc_id", "f0"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "text", SLICE):
                yield work(batch)

    return text_table(docs).mapInArrow(run, "doc_id long, f0 long")


def _shingle_sets(texts: pa.Array, shingles: tuple[int, ...]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each shingle length: how many distinct shingles each text has, and their hashes, ascending within a text.

    A shingle's hash is mixed from its words' hashes (A-Z lower-cased), each distinct word being hashed once.
    """
    from xxhash import xxh64_intdigest

    words, edges = words_of(pc.ascii_lower(texts))
    coded = words.dictionary_encode()
    own = np.fromiter(map(xxh64_intdigest, coded.dictionary.to_pylist()), np.uint64, len(coded.dictionary))
    h = np.append(own[np.asarray(coded.indices)] if len(words) else own, np.uint64(0))
    for shingle in shingles:
        count, first, last = _stretches(edges, shingle)
        mixed = np.zeros(len(first), np.uint64)
        for k in range(shingle):  # behind the end of a short text there is a word of hash 0
            mixed = (mixed ^ h[np.where(first + k <= last, first + k, len(h) - 1)]) * np.uint64(0x9E3779B97F4A7C15)
            mixed ^= mixed >> np.uint64(29)
        row = np.repeat(np.arange(len(count)), count)
        order = np.lexsort((mixed, row))
        row, mixed = row[order], mixed[order]
        new = np.append(True, (row[1:] != row[:-1]) | (mixed[1:] != mixed[:-1]))[: len(row)]
        yield np.bincount(row[new], minlength=len(count)), mixed[new]


def _set_hashes(count: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """A signed hash of each text's set of shingles; 0 for an empty one."""
    found, full = np.zeros(len(count), np.uint64), np.flatnonzero(count)
    if len(full):
        found[full] = np.add.reduceat(_mixed(hashes, 99), (np.cumsum(count) - count)[full])
    return found.view(np.int64)


def sketches(docs: DataFrame, parts: tuple[tuple[int, int], ...]) -> DataFrame:
    """doc_id, row (xxhash64 of the text), node (hash of the last part's set of shingles), f0, f1 …: for each (shingle, words64) of parts a fingerprint of that
    many 64-bit words, one after another, over distinct shingles.
    """
    names = [f"f{k}" for k in range(sum(n for _, n in parts))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "text", SLICE):
                sets = list(_shingle_sets(batch.column("text"), tuple(shingle for shingle, _ in parts)))
                found = np.concatenate([_majorities(h, count, n) for (count, h), (_, n) in zip(sets, parts, strict=True)])
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("row"), pa.array(_set_hashes(*sets[-1])), *map(pa.array, found.view(np.int64))], ["doc_id", "row", "node", *names])

    return text_table(docs).withColumn("row", F.xxhash64("text")).mapInArrow(run, ", ".join(["doc_id long, row long, node long", *[f"{x} long" for x in names]]))


def shingle_sets(docs: DataFrame, shingle: int) -> DataFrame:
    """node, shingles (distinct hashes) of each text, node as in `sketches`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "text", SLICE):
                ((count, h),) = _shingle_sets(batch.column("text"), (shingle,))
                lists = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(count)).astype(np.int32)), pa.array(h.view(np.int64)))
                yield pa.RecordBatch.from_arrays([pa.array(_set_hashes(count, h)), lists], ["node", "shingles"])

    return text_table(docs).mapInArrow(run, "node long, shingles array<long>")


def hex_digits(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def _planes(fp: np.ndarray) -> np.ndarray:
    """planes[b]: bit b of all rows of fp (rows x words), 64 rows to a word, and one word more for shifts."""
    padded = np.zeros((-(-len(fp) // 64) * 64 + 64, fp.shape[1]), np.uint64)
    padded[: len(fp)] = fp
    bits = np.unpackbits(padded.view(np.uint8), axis=1, bitorder="little").T
    return np.ascontiguousarray(np.packbits(bits, axis=1, bitorder="little")).view(np.uint64)


def within(planes: np.ndarray, low: int, high: int, n: int, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, shift) of the rows of n with at most `radius` bits between row and row + shift, for the shifts low..high - 1.

    Carry-save counters over bit planes: a cell is a word of 64 rows at one shift, all cells are counted at once.
    """
    words = -(-(n - low) // 64)
    shift, at = np.repeat(np.arange(low, high), words), np.tile(np.arange(words), high - low)
    inside = at * 64 + shift < n
    shift, at = shift[inside], at[inside]
    other, by = at + shift // 64, (shift % 64).astype(np.uint64)
    width = (radius + 1).bit_length()
    counters = [np.zeros(len(at), np.uint64) for _ in range(width)]
    over = np.zeros(len(at), np.uint64)
    for b in range(len(planes)):
        p = planes[b]
        carry = p[at] ^ ((p[other] >> by) | (p[other + 1] << (np.uint64(63) - by) << np.uint64(1)))
        for k in range(width):
            counters[k], carry = counters[k] ^ carry, counters[k] & carry
        over |= carry  # the counter ran over
        if (b + 1) % STEP == 0:
            equal = np.full(len(at), ~np.uint64(0))
            for k in reversed(range(width)):  # counters > radius, bit by bit
                if radius >> k & 1:
                    equal &= counters[k]
                else:
                    over |= equal & counters[k]
                    equal &= ~counters[k]
            some = np.flatnonzero(~over)
            if len(some) < len(at):
                at, other, by, shift, over, counters = at[some], other[some], by[some], shift[some], over[some], [c[some] for c in counters]
            if not len(at):
                break
    bits = np.unpackbits((~over).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    cell, bit = np.nonzero(bits)
    rows, shifts = at[cell] * 64 + bit, shift[cell]
    real = rows + shifts < n
    return rows[real], shifts[real]


def forest(n: int, a: np.ndarray, b: np.ndarray, label: np.ndarray | None = None) -> np.ndarray:
    """Of n rows with links a-b, the smallest row that each reaches."""
    label = np.arange(n) if label is None else label
    while True:
        low = np.minimum(label[a], label[b])
        moved = label.copy()
        np.minimum.at(moved, label[a], low)
        np.minimum.at(moved, label[b], low)
        while not np.array_equal(moved, jumped := moved[moved]):
            moved = jumped
        if np.array_equal(moved, label):
            return label
        label = moved


def nearest_forest(n: int, a: np.ndarray, b: np.ndarray, far: np.ndarray) -> np.ndarray:
    """Of n rows with pairs a-b at distances `far`, which pairs make a minimum spanning forest (Boruvka)."""
    order = np.argsort(far, kind="stable")
    a, b, label, chosen = a[order], b[order], np.arange(n), [np.empty(0, np.int64)]
    at = np.arange(len(order))
    while True:
        at = at[label[a[at]] != label[b[at]]]
        if not len(at):
            return order[np.concatenate(chosen)]
        best = np.full(n, len(order))
        np.minimum.at(best, label[a[at]], at)
        np.minimum.at(best, label[b[at]], at)
        take = np.unique(best[best < len(order)])
        chosen.append(take)
        label = forest(n, a[take], b[take], label)


def _pairs(group: np.ndarray, fp: np.ndarray, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Rows sorted by group: (rows, a, b) for parts of the pairs a-b of rows of a group within the radius; `rows` are those compared."""
    edges = np.flatnonzero(np.diff(group, prepend=group[:1] - 1))
    size = np.diff(np.append(edges, len(group)))
    kind = np.frexp(size)[1]  # buckets of like size are compared together
    for k in np.unique(kind):
        rows = np.flatnonzero(np.repeat(kind == k, size))
        most = int(size[kind == k].max())
        if most < 2:
            continue
        part, planes = group[rows], _planes(fp[rows])
        block = max(1, min(64, CELLS * 64 // len(rows)))
        for low in range(1, most, block):
            hit, shift = within(planes, low, min(low + block, most), len(rows), radius)
            same = part[hit] == part[hit + shift]
            yield rows, hit[same], (hit + shift)[same]


def bucket_links(group: np.ndarray, fp: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows sorted by group: pairs (row, smallest row of its component) among rows of a group within the radius."""
    edges = np.flatnonzero(np.diff(group, prepend=group[:1] - 1))
    size = np.diff(np.append(edges, len(group)))
    found: list[tuple[np.ndarray, np.ndarray]] = []
    kind = np.frexp(size)[1]  # buckets of like size are compared together
    for k in np.unique(kind):
        pick = np.repeat(kind == k, size)
        rows = np.flatnonzero(pick)
        if size[kind == k].max() < 2:
            continue
        part, planes, label = group[rows], _planes(fp[rows]), None
        a, b, held, most = [], [], 0, int(size[kind == k].max())
        block = max(1, min(64, CELLS * 64 // len(rows)))
        for low in range(1, most, block):
            hit, shift = within(planes, low, min(low + block, most), len(rows), radius)
            same = part[hit] == part[hit + shift]
            a.append(hit[same])
            b.append((hit + shift)[same])
            held += len(a[-1])
            if held > 1 << 20:
                label, a, b, held = forest(len(rows), np.concatenate(a), np.concatenate(b), label), [], [], 0
        if a or label is not None:
            label = forest(len(rows), np.concatenate([*a, [0]]).astype(np.int64), np.concatenate([*b, [0]]).astype(np.int64), label)
            tied = np.flatnonzero(label != np.arange(len(rows)))
            found.append((rows[tied], rows[label[tied]]))
    if not found:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    return tuple(map(np.concatenate, zip(*found, strict=True)))


def bucket_forest(group: np.ndarray, fp: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """As bucket_links, but the links are pairs within the radius themselves, the nearest that connect what is connected."""
    a, b, far, held = *(np.empty(0, np.int64) for _ in range(3)), 0
    for rows, x, y in _pairs(group, fp, radius):
        for low in range(0, len(x), 1 << 17):
            p, q = rows[x[low : low + (1 << 17)]], rows[y[low : low + (1 << 17)]]
            d = np.bitwise_count(fp[p] ^ fp[q]).sum(axis=1, dtype=np.int64)
            a, b, far, held = np.append(a, p), np.append(b, q), np.append(far, d), held + len(p)
            if held > 1 << 18:
                keep = nearest_forest(len(group), a, b, far)
                a, b, far, held = a[keep], b[keep], far[keep], 0
    keep = nearest_forest(len(group), a, b, far)
    return a[keep], b[keep]


def joining_links(part: np.ndarray, fp: np.ndarray, sets: list[np.ndarray], radius: int, similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """Of rows with a part, a fingerprint and a set of hashes: links at the similarity that join all parts which such pairs join.

    Pairs of different parts within the radius are compared by their sets until their parts are joined; so there are fewer links
    than parts.
    """
    size = np.fromiter(map(len, sets), np.int64, len(sets))
    begin = np.cumsum(size) - size
    flat = np.unique(np.concatenate([np.empty(0, np.int64), *sets]), return_inverse=True)[1]
    mark = np.zeros(len(flat) + 1, bool)
    label, src, dst = np.unique(part, return_inverse=True)[1], [], []
    for rows, x, y in _pairs(np.zeros(len(fp), np.int64), fp, radius):
        x, y = rows[x], rows[y]
        apart = np.flatnonzero(label[x] != label[y])
        apart = apart[np.argsort(x[apart], kind="stable")]
        x, y = x[apart], y[apart]
        edges = np.flatnonzero(np.diff(x, prepend=-1))
        for p, others in zip(x[edges].tolist(), np.split(y, edges[1:]), strict=True) if len(x) else ():
            others = others[(label[others] != label[p]) & (size[others] > 0)]
            if not len(others) or not size[p]:
                continue
            own = flat[begin[p] : begin[p] + size[p]]
            mark[own] = True
            count = size[others]
            first = np.cumsum(count) - count
            held = flat[np.repeat(begin[others] - first, count) + np.arange(count.sum())]
            shared = np.add.reduceat(mark[held], first, dtype=np.int64)
            mark[own] = False
            for q in others[shared >= similarity * (size[p] + count - shared)].tolist():
                if label[q] != label[p]:
                    src.append(p)
                    dst.append(q)
                    label[label == label[q]] = label[p]
    return np.array(src, np.int64), np.array(dst, np.int64)


def agreeing_blocks(radius: int = 2, blocks: int = 4) -> list[list[int]]:
    """Masks of 64 bits, one of which any two fingerprints within the radius agree on: all choices of blocks - radius blocks."""
    width = BITS // blocks
    return [[sum(((1 << (BITS - width * k if k == blocks - 1 else width)) - 1) << (width * k) for k in c)] for c in combinations(range(blocks), blocks - radius)]


def refined_blocks(radius: int = 2, blocks: int = 4) -> list[list[list[int]]]:
    """For each mask of `agreeing_blocks`, stronger ones: its bits and all choices but `radius` of as many parts of the rest."""
    found = []
    for (mask,) in agreeing_blocks(radius, blocks):
        rest = [b for b in range(BITS) if not mask >> b & 1]
        parts = [rest[k * len(rest) // blocks : (k + 1) * len(rest) // blocks] for k in range(blocks)]
        found.append([[mask | sum(1 << b for p in c for b in p)] for c in combinations(parts, blocks - radius)])
    return found


def sampled_bits(words64: int, bands: int, width: int, seed: int = 1) -> list[list[int]]:
    """Masks of `width` bits drawn from those of a long fingerprint, for radii that no choice of whole blocks reaches."""
    rng, found = np.random.default_rng(seed), []
    for _ in range(bands):
        picked = rng.choice(BITS * words64, width, replace=False).tolist()
        found.append([sum(1 << (b % BITS) for b in picked if b // BITS == k) for k in range(words64)])
    return found


def links(reps: DataFrame, masks: list[list[int]], radius: int, compared: int = 0, found=bucket_links, refined: list[list[list[int]]] | None = None) -> DataFrame:
    """src, dst: links that connect the nodes of reps(node, f0, f1 …) that share a mask's bits and differ in `radius` bits at most.

    `found` gives a bucket's links. Masks are of the first words; the words from `compared` on are compared.

    The rows of a bucket over CHUNK are dealt by the `refined` masks of its own, if given; what is still larger is cut into chunks
    by fingerprint, every two of which meet in a task. Only large buckets are joined with rows, by their hash: should two buckets
    have one hash, their rows are compared with each other too.
    """
    names = [c for c in reps.columns if c != "node"]
    signed = lambda m: F.lit(m - (1 << 64) if m >> 63 else m)
    value = lambda mask: F.xxhash64(*[F.col(c).bitwiseAND(signed(m)) for c, m in zip(names, mask, strict=False)])
    told = names if refined else names[compared:]

    def sized(rows: DataFrame) -> DataFrame:
        large = rows.groupBy("bucket").agg(F.count("*").alias("n")).where(F.col("n") > CHUNK)
        return rows.join(small_or_shuffled(written(large, "large-buckets")), "bucket", "left")

    keyed = reps.select("node", *told, F.posexplode(F.array(*map(value, masks))).alias("choice", "value"))
    rows = sized(keyed.select("node", *told, "choice", F.xxhash64("choice", "value").alias("bucket")))
    if refined:
        deeper = F.get(F.array(*[F.array(*map(value, own)) for own in refined]), F.col("choice"))
        large = rows.where("n IS NOT NULL").select("node", *told, "choice", F.posexplode(deeper).alias("part", "value"))
        large = sized(large.select("node", *told, "choice", F.xxhash64("choice", "part", "value").alias("bucket")))
        rows = rows.where("n IS NULL").unionByName(large)
    names = names[compared:]
    rows = rows.withColumn("chunks", F.when(F.col("n").isNull(), 1).otherwise(F.ceil(2 * F.col("n") / CHUNK)).cast("int"))
    rows = rows.withColumn("chunk", F.pmod(F.xxhash64(*names, F.lit(1)), F.col("chunks")).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    group = F.xxhash64("bucket", F.least("chunk", "other"), F.greatest("chunk", "other"))
    dealt = rows.select(group.alias("g"), "node", *names).repartition("g").sortWithinPartitions("g", "node")
    return dealt.mapInArrow(_linker(radius, found), "src long, dst long")


def _linker(radius: int, found):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []

        def emit(rows: np.ndarray) -> pa.RecordBatch:
            group = np.cumsum(np.diff(rows[:, 0], prepend=rows[:1, 0]) != 0)
            src, dst = found(group, np.ascontiguousarray(rows[:, 2:]).view(np.uint64), radius)
            return pa.RecordBatch.from_arrays([pa.array(rows[src, 1]), pa.array(rows[dst, 1])], ["src", "dst"])

        for batch in batches:
            if not batch.num_rows:
                continue
            rows = np.stack([np.asarray(c) for c in batch.columns], axis=1)
            held.append(rows)
            last = np.flatnonzero(rows[:, 0] != rows[-1, 0])
            if len(last):  # all but the last bucket are whole
                data = np.concatenate(held)
                cut = len(data) - (len(rows) - last[-1] - 1)
                yield emit(data[:cut])
                held = [data[cut:]]
        if held:
            yield emit(np.concatenate(held))

    return run


def components(edges: DataFrame) -> DataFrame:
    """node, component: the smallest node that each node of edges(src, dst) reaches.

    Alternating stars over written tables: every node points to its smallest neighbour until nothing changes, in a number of
    rounds that is logarithmic in the longest path. A node with many links is counted, not gathered: what is joined to its links
    is one row of a written table, so that the join can be a broadcast, or one whose large partitions Spark splits.
    """
    edges = written(edges.where("src <> dst").select(F.greatest("src", "dst").alias("a"), F.least("src", "dst").alias("b")).distinct(), "links")
    while True:
        both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = written(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m")), "least")
        large = both.where("b > a").join(small_or_shuffled(least), "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = written(large.where("a <> b").distinct(), "large-star")
        least = written(large.groupBy("a").agg(F.min("b").alias("m")), "least")
        joined = large.join(small_or_shuffled(least), "a")
        small = joined.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b")))
        small = written(small.where("a <> b").distinct(), "small-star")
        same = [x.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first() for x in (edges, small)]
        if same[0] == same[1]:
            return small.select(F.col("a").alias("node"), F.col("b").alias("component"))
        edges = small


def near_duplicates(prints: DataFrame, masks: list[list[int]], radius: int, compared: int = 0, refined: list[list[list[int]]] | None = None) -> DataFrame:
    """doc_id, f0 …, component_id (the smallest doc_id that links reach, itself included) for each row of prints(doc_id, f0 …).

    prints is read twice: give a written table. Equal fingerprints are one node, known by its smallest doc_id; only nodes are
    compared. A null doc_id has the component of its equals, or null if they have none. Empty texts link like any other.
    """
    names = [c for c in prints.columns if c != "doc_id"]
    reps = written(prints.groupBy(*names).agg(F.min("doc_id").alias("node")).where("node IS NOT NULL"), "nodes")
    found = components(links(reps, masks, radius, compared, refined=refined))
    named = written(reps.join(found, "node", "left").select(*names, F.coalesce("component", "node").alias("component_id")), "named")
    return prints.join(small_or_shuffled(named), names, "left").select("doc_id", *names, "component_id")


#: Near copies at similarity 0.8 or more of five-word shingles: at 0.8 the cosine of two sets of shingles is 0.89 at least, so that
#: each bit differs with a probability of 0.15 at most, 29 of 192 on average (deviation 5). The radius leaves four deviations, as
#: links are verified. Bands are of a second fingerprint, of word pairs, which such copies share as many or more of: 64 bands of
#: 16 sampled bits are met by such a pair with a probability of 1 - (1 - 0.85 ** 16) ** 64 = 0.992.
SHINGLE, SIMILARITY = 5, 0.8
PARTS = ((2, 4), (SHINGLE, 3))
NEAR = {"masks": sampled_bits(4, bands=64, width=16), "radius": 49, "compared": 4}
#: Between groups that are close but apart, all pairs are tried, so that they are compared by more bits: 1024, of which such a pair
#: differs in 155 on average (deviation 11.5) and one at similarity 0.65 in 217; the radius leaves three deviations.
LONG_PARTS, LONG_RADIUS = ((SHINGLE, 16),), 190


def similar(pairs: DataFrame, docs: DataFrame, prints: DataFrame) -> DataFrame:
    """pairs(src, dst) of nodes with `near`: whether the Jaccard similarity of their sets of shingles is SIMILARITY at least."""
    nodes = pairs.select(F.col("src").alias("node")).unionByName(pairs.select(F.col("dst").alias("node"))).distinct()
    some = written(prints.join(small_or_shuffled(written(nodes, "paired")), "node", "left_semi").groupBy("node").agg(F.min("doc_id").alias("doc_id")), "read")
    texts = docs.join(small_or_shuffled(written(some.select("doc_id").distinct(), "read-ids")), "doc_id", "left_semi")
    sets = written(shingle_sets(texts, SHINGLE).dropDuplicates(["node"]), "shingles")
    side = lambda end: sets.select(F.col("node").alias(end), F.col("shingles").alias(f"{end}_set"))
    both = pairs.join(side("src"), "src").join(side("dst"), "dst")
    shared = F.size(F.array_intersect("src_set", "dst_set"))
    return both.select("src", "dst", (shared >= SIMILARITY * (F.size("src_set") + F.size("dst_set") - shared)).alias("near"))


def _joiner(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (g, node, c, fingerprint, shingles) sorted by g: the links of each group that join its parts."""
    held: list[pa.RecordBatch] = []

    def emit(rows: pa.Table) -> Iterator[pa.RecordBatch]:
        g = np.asarray(rows["g"])
        edges = [*np.flatnonzero(np.diff(g, prepend=g[:1] - 1)).tolist(), len(g)]
        node = np.asarray(rows["node"])
        for a, b in pairwise(edges):
            own = rows.slice(a, b - a).combine_chunks()
            fp = np.stack([np.asarray(own[c]) for c in rows.column_names if c[0] == "f"], axis=1).view(np.uint64)
            lists = own["shingles"].combine_chunks()
            offsets, flat = np.asarray(lists.offsets), np.asarray(lists.values)
            src, dst = joining_links(np.asarray(own["c"]), np.ascontiguousarray(fp), [flat[x:y] for x, y in pairwise(offsets.tolist())], LONG_RADIUS, SIMILARITY)
            yield pa.RecordBatch.from_arrays([pa.array(node[a + src]), pa.array(node[a + dst])], ["src", "dst"])

    for batch in batches:
        if not batch.num_rows:
            continue
        g = np.asarray(batch.column("g"))
        last = np.flatnonzero(g != g[-1])
        if held and (len(last) or held[0].column("g")[0].as_py() != g[-1]):
            cut = int(last[-1]) + 1 if len(last) else 0
            yield from emit(pa.Table.from_batches([*held, batch.slice(0, cut)]))
            held, batch = [], batch.slice(cut)
        elif len(last):
            cut = int(last[-1]) + 1
            yield from emit(pa.Table.from_batches([batch.slice(0, cut)]))
            batch = batch.slice(cut)
        held.append(batch)
    if held:
        yield from emit(pa.Table.from_batches(held))


#: Rows, and hashes of shingles, of a chunk of what may be joined.
JOIN_ROWS, JOIN_HASHES = 1024, 500_000


def joining(apart: DataFrame, docs: DataFrame, prints: DataFrame) -> DataFrame:
    """src, dst: verified links that join the parts c of apart(node, component, c), as far as any pairs within LONG_RADIUS do.

    The nodes of a component meet in one task, with their shingles; those of a large one are dealt in chunks, every two of which
    meet. A task verifies what it finds itself and gives back fewer links than parts.
    """
    some = prints.join(small_or_shuffled(apart), "node", "left_semi").groupBy("node").agg(F.min("doc_id").alias("doc_id")).select("doc_id").distinct()
    texts = written(docs.join(small_or_shuffled(written(some, "apart-ids")), "doc_id", "left_semi").select("doc_id", "text"), "apart-texts")
    long = sketches(texts, LONG_PARTS).drop("doc_id", "row").dropDuplicates(["node"])
    rows = written(long.join(shingle_sets(texts, SHINGLE).dropDuplicates(["node"]), "node").join(apart, "node"), "apart-rows")
    size = rows.groupBy("component").agg(F.greatest(F.ceil(F.count("*") / JOIN_ROWS), F.ceil(F.sum(F.size("shingles")) / JOIN_HASHES)).cast("int").alias("n"))
    rows = rows.join(small_or_shuffled(written(size, "apart-sizes")), "component").withColumn("n", F.when(F.col("n") > 1, 2 * F.col("n")).otherwise(1))
    rows = rows.withColumn("chunk", F.pmod(F.xxhash64("node", F.lit(1)), F.col("n")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
    g = F.xxhash64("component", F.least("chunk", "other"), F.greatest("chunk", "other"))
    names = [c for c in long.columns if c[0] == "f"]
    return rows.select(g.alias("g"), "node", "c", *names, "shingles").repartition("g").sortWithinPartitions("g", "node").mapInArrow(_joiner, "src long, dst long")


def similar_links(docs: DataFrame, prints: DataFrame, masks: list[list[int]], radius: int, compared: int) -> DataFrame:
    """src, dst: links at SIMILARITY or more that connect all nodes of prints which pairs meeting in a bucket connect.

    First the nearest pairs that connect a bucket are verified. Where that leaves apart what the pairs connect, all pairs between
    the parts that are close by more bits are verified where they meet, so that nothing hangs on which pairs came first.
    """
    names = [c for c in prints.columns if c[0] == "f"]
    reps = written(prints.where("doc_id IS NOT NULL").groupBy("node").agg(*[F.min(c).alias(c) for c in names]), "nodes")
    ordered = lambda found: found.select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).distinct()
    tried = written(ordered(links(reps, masks, radius, compared, bucket_forest)), "pairs")
    tried = written(similar(tried, docs, prints), "verified")
    near = tried.where("near").select("src", "dst")
    if tried.where("NOT near").isEmpty():
        return near
    part = components(near).select("node", F.col("component").alias("c"))
    whole = components(tried.select("src", "dst")).join(part, "node", "left").withColumn("c", F.coalesce("c", "node"))
    split = whole.groupBy("component").agg(F.min("c").alias("low"), F.max("c").alias("high")).where("low < high").select("component")
    apart = written(whole.join(split, "component", "left_semi").select("node", "component", "c"), "apart")
    return near.unionByName(written(joining(apart, docs, prints), "joining"))


def deduplicate(docs: DataFrame) -> DataFrame:
    """docs without near copies: of each component the row with the smallest doc_id stays (of equal rows, one).

    A row is known by doc_id and text hash, so that different texts with one doc_id are judged apart. Rows with a null doc_id
    stay. Ids are moved rather than texts, as long as their number allows it.
    """
    prints = written(sketches(docs, PARTS), "sketches")
    tied = components(similar_links(docs, prints, **NEAR))
    named = prints.where("doc_id IS NOT NULL").select("doc_id", "row", "node").join(tied, "node", "left")
    named = written(named.select(F.struct("doc_id", "row").alias("id_"), F.coalesce("component", "node").alias("component")), "components")
    least = written(named.groupBy("component").agg(F.min("id_").alias("least"), F.count("*").alias("n_")).where("n_ > 1").drop("n_"), "kept-copies")
    gone = written(named.join(small_or_shuffled(least), "component").where("id_ <> least").select("id_.doc_id", F.col("id_.row").alias("row_")).distinct(), "near-copies")
    rows = docs.withColumn("row_", F.xxhash64(text_or_empty()))
    kept = rows.join(small_or_shuffled(gone), ["doc_id", "row_"], "left_anti")
    repeated = written(named.groupBy("id_").agg(F.count("*").alias("n")).where("n > 1").select("id_.doc_id", F.col("id_.row").alias("row_")), "repeated")
    if not repeated.isEmpty():
        some = small_or_shuffled(repeated)
        kept = kept.join(some, ["doc_id", "row_"], "left_anti").unionByName(kept.join(some, ["doc_id", "row_"], "left_semi").dropDuplicates(["doc_id", "row_"]))
    return kept.select(*docs.columns)
