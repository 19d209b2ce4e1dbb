"""Byte-level BPE: encoding and decoding as reductions of a monoid tree.

Stretches of a text are encoded apart and joined. A join re-encodes a window about the seam, which grows until what lies outside
provably cannot change; so any tree of joins gives the ids of the whole. There are two such trees:

* within a match of the pre-splitting pattern halves are byte ranges, down to single bytes. A sequence of tokens is the encoding of
  its bytes exactly if every two neighbours are the encoding of theirs, as the first merge across a border would happen in the pair
  alone too. So a window ends where it agrees with its neighbours.
* within a text, leaves of LEAF characters are split and encoded, then joined. A match depends on the text from its start on and on
  at most two characters behind its end; so matches that end two characters before a seam stay, and from the first border that the
  window shares with the right half on everything stays.

Ids are decoded by concatenating their bytes up the tree, which is one concatenation.
"""

from __future__ import annotations

import base64
import heapq
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain, pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from surveyqc.llm.common import slices, text_table

#: Characters of a leaf of a text's tree.
LEAF = 8_192
#: Bytes of text that are encoded at once.
SLICE = 2 << 20
#: Entries of what a worker remembers of each kind, each of SHORT bytes at most.
REMEMBERED, SHORT = 150_000, 64

# Kinds of characters that the pattern tells apart.
SPACE, LETTER, NUMBER, OTHER = range(4)
#: Fixed by the pattern: what may follow an apostrophe as a match of its own.
CONTRACTIONS = ("s", "t", "re", "ve", "m", "ll", "d")


@lru_cache(maxsize=1)
def kinds() -> np.ndarray:
    """The kind of every code point."""
    import regex

    every = "".join(map(chr, [x for x in range(0x110000) if not 0xD800 <= x < 0xE000]))
    found = np.full(0x110000, OTHER, np.uint8)
    for kind, pattern in ((SPACE, r"\p{White_Space}+"), (LETTER, r"\p{L}+"), (NUMBER, r"\p{N}+")):
        for m in regex.finditer(pattern, every):
            a, b = (x + 0x800 * (x > 0xD7FF) for x in (m.start(), m.end() - 1))
            found[a : b + 1] = kind
    found[0xD800:0xE000] = OTHER
    return found


def split(chars: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Where the pattern's matches begin in texts, given as code points one after another and where each text ends."""
    n = len(chars)
    if not n:
        return np.empty(0, np.int64)
    kind = kinds()[chars]
    edge = np.zeros(n + 1, bool)  # a text begins or all end
    edge[0] = True
    edge[ends] = True
    run = edge[:-1].copy()
    run[1:] |= kind[1:] != kind[:-1]
    start = run.copy()
    # The last of some white space stands alone before other characters, or with them if it is a blank.
    last = np.flatnonzero((kind[:-1] == SPACE) & (kind[1:] != SPACE) & ~edge[1:-1])
    start[last] = True
    blank = last[chars[last] == 0x20]
    start[blank + 1] = False
    # An apostrophe that is alone begins a contraction: what follows it begins later.
    alone = np.flatnonzero((chars[:-1] == 0x27) & start[:-1] & run[1:] & (kind[1:] == LETTER) & ~edge[1:-1])
    padded = np.append(chars, [0, 0])
    padded_edge = np.append(edge, [True, True])
    for text in CONTRACTIONS:
        hit = (padded[alone + 1] == ord(text[0])) & ((padded[alone + 2] == ord(text[-1])) & ~padded_edge[alone + 2] if len(text) == 2 else True)
        at = alone[hit]
        start[at + 1] = False
        start[(after := at + 1 + len(text))[after < n]] = True
        alone = alone[~hit]
    return np.flatnonzero(start)


class ByteBPE:
    """Encoder of one rank file."""

    def __init__(self, ranks_path: str) -> None:
        with open(ranks_path, "rb") as lines:  # the vocabulary is part of the Python installation, as the libraries are
            self.ranks = {base64.b64decode(a): int(b) for a, b in (x.split() for x in lines if x.strip())}
        self.n_ids = max(self.ranks.values()) + 1
        names = [b""] * self.n_ids
        for token, i in self.ranks.items():
            names[i] = token
        self.names = names
        self.tokens = pa.array(names, pa.large_binary())
        self.bytes = np.array([self.ranks[bytes([b])] for b in range(256)], np.int64)
        # What is asked for most is remembered: short matches and halves, pairs of tokens, windows.
        self.encode = lru_cache(REMEMBERED)(self._encode)
        self.joined = lru_cache(REMEMBERED)(self._joined_tokens)
        self.merged = lambda data, short=lru_cache(REMEMBERED // 2)(self._merged_short): short(data) if len(data) <= SHORT else self._merged(data)

    def _merged_short(self, data: bytes) -> tuple[int, ...]:
        """As _merged, for few bytes: all pairs are looked at each time."""
        ranks, none = self.ranks, self.n_ids
        if (own := ranks.get(data)) is not None:
            return (own,)
        cut = list(range(len(data) + 1))  # where parts begin
        pair = [ranks.get(data[i : i + 2], none) for i in range(len(data) - 1)]
        while pair and (low := min(pair)) < none:
            i = pair.index(low)
            del cut[i + 1], pair[i]
            if i < len(pair):
                pair[i] = ranks.get(data[cut[i] : cut[i + 2]], none)
            if i:
                pair[i - 1] = ranks.get(data[cut[i - 1] : cut[i + 1]], none)
        return tuple([ranks[data[a:b]] for a, b in pairwise(cut)])

    def _merged(self, data: bytes) -> tuple[int, ...]:
        """Ids of bytes by merging the pair of lowest rank, the leftmost of equals, until none is left."""
        n, ranks = len(data), self.ranks
        end = list(range(1, n + 1))  # of the part that begins here
        after, before, dead = list(range(1, n + 1)), list(range(-1, n - 1)), bytearray(n)
        heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(data[i : i + 2])) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, stop = heapq.heappop(heap)
            j = after[i]
            if dead[i] or j >= n or end[j] != stop:
                continue  # one of the two has changed since
            end[i], dead[j], k = stop, 1, after[j]
            after[i] = k
            if k < n:
                before[k] = i
                if (r := ranks.get(data[i : end[k]])) is not None:
                    heapq.heappush(heap, (r, i, end[k]))
            if (p := before[i]) >= 0 and (r := ranks.get(data[p:stop])) is not None:
                heapq.heappush(heap, (r, p, stop))
        found, i = [], 0
        while i < n:
            found.append(ranks[data[i : end[i]]])
            i = after[i]
        return tuple(found)

    def _joined_tokens(self, a: int, b: int) -> tuple[int, ...]:
        """The encoding of two tokens' bytes."""
        return self.merged(self.names[a] + self.names[b])

    def _join(self, left: tuple[int, ...], right: tuple[int, ...]) -> tuple[int, ...]:
        """The encoding of two halves' bytes from theirs: a window about the seam is encoded again, and grows until both its ends are settled."""
        a, b = left[-1], right[0]
        own = self.joined(a, b)
        if own == (a, b):
            return left + right
        i = j = 1  # tokens of the window
        while True:
            settled_left = i == len(left) or self.joined(c := left[-i - 1], own[0]) == (c, own[0])
            settled_right = j == len(right) or self.joined(own[-1], c := right[j]) == (own[-1], c)
            if settled_left and settled_right:
                return left[: len(left) - i] + own + right[j:]
            i = i if settled_left else min(len(left), 2 * i)
            j = j if settled_right else min(len(right), 2 * j)
            own = self.merged(b"".join([self.names[t] for t in left[len(left) - i :] + right[:j]]))

    def _encode(self, data: bytes) -> tuple[int, ...]:
        if (own := self.ranks.get(data)) is not None:  # a token, as every byte is
            return (own,)
        n = len(data)
        half = 1 << ((n - 1).bit_length() - 1)
        left, right = data[:half], data[half:]
        return self._join(self.encode(left) if half <= SHORT else self._encode(left), self.encode(right) if n - half <= SHORT else self._encode(right))

    def encode_match(self, data: bytes) -> tuple[int, ...]:
        """Ids of a match (not empty): its halves are encoded and joined."""
        return self.encode(data) if len(data) <= SHORT else self._encode(data)

    def encode_texts(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after another, and where each text's begin (one entry more at the end)."""
        whole = b"".join(texts.cast(pa.binary()).to_pylist())
        chars = np.frombuffer(whole.decode().encode("utf-32-le"), np.uint32)
        edges = np.append(0, np.cumsum(np.asarray(pc.utf8_length(texts), dtype=np.int64)))
        start = matches(chars, edges)
        byte = np.append(0, np.cumsum(1 + (chars >= 0x80).astype(np.int8) + (chars >= 0x800) + (chars >= 0x10000), dtype=np.int64))[np.append(start, len(chars))]
        found = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(start), [None, pa.py_buffer(byte), pa.py_buffer(whole)])
        coded = found.dictionary_encode()
        own = [self.encode_match(x) for x in coded.dictionary.to_pylist()]
        size = np.fromiter(map(len, own), np.int64, len(own))
        flat = np.fromiter(chain.from_iterable(own), np.int32, int(size.sum()))
        codes = np.asarray(coded.indices)
        count = size[codes]
        ends = np.append(0, np.cumsum(count))
        at = np.repeat((np.cumsum(size) - size)[codes] - ends[:-1], count)
        at += np.arange(len(at))
        return flat[at], ends[np.searchsorted(start, edges)]

    def decode_ids(self, ids: pa.Array) -> tuple[pa.Buffer | None, np.ndarray]:
        """The bytes of ids one after another, and where each id's begin (one entry more at the end)."""
        parts = self.tokens.take(ids)
        return parts.buffers()[2], np.frombuffer(parts.buffers()[1], np.int64)[: len(parts) + 1]


@lru_cache(maxsize=1)
def encoder(ranks_path: str) -> ByteBPE:
    """One for each Python worker, which serves many tasks."""
    return ByteBPE(ranks_path)


def _joined(chars: np.ndarray, left: np.ndarray, seam: int, right: np.ndarray, end: int) -> np.ndarray:
    """Where matches begin in a stretch up to `end`, of which both sides of the seam have been split apart."""
    i = int(np.searchsorted(left[1:], seam - 2, side="right"))  # what ends behind that may depend on what follows the seam
    taken = 4
    while True:
        stop = int(right[taken]) if taken < len(right) else end
        own = left[i] + split(chars[left[i] : stop], np.array([stop - left[i]]))
        shared = own[(own >= seam) & (own <= stop - 2)] if stop < end else own[own >= seam]
        shared = shared[np.isin(shared, right)]
        if len(shared) or stop == end:
            cut = int(shared[0]) if len(shared) else end
            return np.concatenate([left[:i], own[own < cut], right[right >= cut]])
        taken *= 4


def matches(chars: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """Where the pattern's matches begin in texts (edges: where each text begins, and the end): leaves are split, then joined in pairs."""
    size = np.diff(edges)
    long = np.flatnonzero(size > LEAF)
    cuts = [np.arange(edges[i] + LEAF, edges[i + 1], LEAF) for i in long]
    start = split(chars, np.unique(np.concatenate([edges, *cuts])))
    if not len(long):
        return start
    found, done = [], 0
    for i, cut in zip(long.tolist(), cuts, strict=True):
        bounds = [int(edges[i]), *cut.tolist(), int(edges[i + 1])]
        at = np.searchsorted(start, bounds)
        found.append(start[done : at[0]])
        done = at[-1]
        nodes = [start[a:b] for a, b in pairwise(at.tolist())]
        while len(nodes) > 1:
            above = [_joined(chars, nodes[k], bounds[k + 1], nodes[k + 1], bounds[k + 2]) for k in range(0, len(nodes) - 1, 2)]
            nodes = above + nodes[len(above) * 2 :]
            bounds = bounds[::2] if bounds[-1] == bounds[::2][-1] else [*bounds[::2], bounds[-1]]
        found += nodes
    return np.concatenate([*found, start[done:]])


def encode(docs: DataFrame, ranks_path: str) -> DataFrame:
    """doc_id, n_tokens, ids: every text encoded whole, each match of the pattern by itself, without special tokens.

    A null or empty text has no ids. Repeated rows and null doc_ids are kept as they are; other columns are ignored; an empty table
    gives an empty one. A text of any length is one row, as it came.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "text", SLICE):
                ids, edges = encoder(ranks_path).encode_texts(batch.column("text"))
                lists = pa.ListArray.from_arrays(pa.array(edges, pa.int32()), pa.array(ids, pa.int32()))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(np.diff(edges), pa.int64()), lists], ["doc_id", "n_tokens", "ids"])

    return text_table(docs).mapInArrow(run, "doc_id long, n_tokens long, ids array<int>")


def decode(encoded: DataFrame, ranks_path: str) -> DataFrame:
    """encoded(doc_id, n_tokens, ids) and `decoded`: the bytes of each row's ids. A null list has none; an id outside the ranks is an error."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chain.from_iterable((b.slice(i, 500) for i in range(0, b.num_rows, 500)) for b in batches):
            lists = batch.column("ids")
            data, byte = encoder(ranks_path).decode_ids(lists.flatten())
            edges = np.append(0, np.cumsum(np.asarray(pc.fill_null(pc.list_value_length(lists), 0), dtype=np.int64)))
            decoded = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(lists), [None, pa.py_buffer(byte[edges].copy()), pa.py_buffer(b"") if data is None else data])
            yield pa.RecordBatch.from_arrays([*batch.columns, decoded.cast(pa.binary())], [*batch.schema.names, "decoded"])

    return encoded.select("doc_id", "n_tokens", "ids").mapInArrow(run, "doc_id long, n_tokens long, ids array<int>, decoded binary")
