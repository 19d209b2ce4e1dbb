"""Collocations, byte-level BPE and ranked search: brute force, round trips, spills, bursts, stops, edge cases."""

import hashlib
import math
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from surveyqc.llm import byte_bpe, collocations, search
from surveyqc.llm.queries import QUERIES, ranks_path

DOCS = "doc_id long, text string, lang string, source string, n_chars long, phrase string, n long, rank int, item_id long, ids string"


def lower(t):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")


def zipf(seed, n, vocabulary=60):
    r = random.Random(seed)
    return " ".join(f"w{int(vocabulary * r.random() ** 3)}" + r.choice(["", "", "", ".", ",", " \t", "\n"]) for _ in range(n))


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(1, zipf(1, 3000), "en"), (2, zipf(2, 2000), "de"), (3, zipf(3, 500), None), (4, zipf(4, 500), "und"), (5, None, "en"), (6, "", "en"), (7, " \t\n", "fr"), (None, zipf(5, 400), "en")]
    rows += [(8, "New York City hall. " * 40, "en"), (8, "New York City hall. " * 40, "en"), (9, "é́ Ünïx " * 50, "en"), (10, "tie a tie b " * 40, "xx"), (11, zipf(9, 60000), "en")]
    return spark.createDataFrame([(i, t, g, "s", 1, "p", 7, 1, 3, "x") for i, t, g in rows], DOCS).repartition(5)


def phrases(rows):
    f, n = Counter(), Counter()
    for lang, text in rows:
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lower(text)):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang or "und"] += len(w)
            f.update((lang or "und", tuple(w[i : i + k])) for k in range(1, 5) for i in range(len(w) - k + 1))
    return f, n


def best_phrases(rows, least=30, top=2000):
    f, n = phrases(rows)
    found = {k: v for k, v in f.items() if v >= least and len(k[1]) > 1}
    gone = {(g, w[i : i + k]) for (g, w), v in found.items() for k in range(2, len(w)) for i in range(len(w) - k + 1) if 100 * v >= 80 * found[g, w[i : i + k]]}
    out = []
    for (g, w), a in found.items():
        if (g, w) not in gone:
            score, _, left, right = min((2_000_000 * a // (f[g, w[:k]] + f[g, w[k:]]), k, f[g, w[:k]], f[g, w[k:]]) for k in range(1, len(w)))
            out.append((g, -score, -a, " ".join(w).encode(), left, right))
    rank = Counter()
    for g, score, a, p, left, right in sorted(out):
        rank[g] += 1
        if rank[g] <= top:
            yield g, rank[g], p.decode(), -a, left, right, n[g], -score


def test_collocations_are_brute_force(docs):
    rows = [(r["lang"], r["text"]) for r in docs.collect()]
    want = sorted(best_phrases(rows))
    assert sorted(map(tuple, collocations.collocations(docs).collect())) == want
    assert any(w[0] == "und" for w in want) and any(len(w[2].split()) == 4 for w in want)
    assert sorted(map(tuple, collocations.collocations(docs, top=3).collect())) == sorted(best_phrases(rows, top=3))
    assert sorted(map(tuple, collocations.collocations(docs, min_count=200).collect())) == sorted(best_phrases(rows, 200))


def test_frequencies_with_small_tries_and_short_stretches(docs, monkeypatch):
    rows = [(r["lang"], r["text"]) for r in docs.collect()]
    f, n = phrases(rows)
    found, totals = collocations.frequencies(docs, 30, burst=3, limit=50)
    assert {(r["lang"], tuple(r["phrase"].split(" "))): r["f"] for r in found.collect()} == {k: v for k, v in f.items() if v >= 30}
    assert {r["lang"]: r["n"] for r in totals.collect()} == {k: v for k, v in n.items() if v}


@pytest.mark.parametrize("burst", [1, 4, 100])
def test_trie_counts_bursts_and_spills(burst):
    r = np.random.default_rng(burst)
    trie, want, got = collocations.HatTrie(burst), Counter(), Counter()
    for step in range(20):
        keys, n = np.unique((40 * r.random(200) ** 3).astype(np.int64) << 32 | r.integers(0, 30, 200), return_counts=True)
        want.update(dict(zip(keys.tolist(), n.tolist(), strict=True)))
        trie.add(keys, n)
        prefixes = [{k >> 32 for x, _ in node.blocks for k in x.tolist()} for node in trie.nodes]
        assert sum(map(len, prefixes)) == len(set().union(*prefixes))  # no prefix in two containers
        assert all(node.size <= burst or len(p) == 1 for node, p in zip(trie.nodes, prefixes, strict=True))
        if step % 5 == 4:
            for keys, n in trie.spill(trie.size // 2):
                assert (np.diff(keys) > 0).all()
                got.update(dict(zip(keys.tolist(), n.tolist(), strict=True)))
    for keys, n in trie.spill():
        got.update(dict(zip(keys.tolist(), n.tolist(), strict=True)))
    assert got == want and trie.size == 0 and (len(trie.nodes) > 5 or burst == 100)


def test_words_are_split_in_chunks(spark, docs, monkeypatch):
    text = zipf(7, 3000)
    words = collocations.split_words(pa.array(["", text, "a b", None, ". c"]))
    pieces = [re.findall(r"[^\x20\x09]+", p) for t in ("", text, "a b", "", ". c") for p in re.split(r"[.,;:!?\x0A-\x0D]", lower(t))]
    assert [words.distinct[c].as_py().decode() for c in words.codes.tolist()] == [w for p in pieces for w in p]
    assert words.follows.tolist() == [i > 0 for p in pieces for i in range(len(p))]


def test_collocations_of_nothing(docs):
    assert collocations.collocations(docs.where("false")).collect() == []
    assert collocations.collocations(docs.where("doc_id IN (5, 6, 7)")).collect() == []


# Byte-level BPE


@pytest.fixture(scope="module")
def tokens():
    import public_tokenizers
    import tiktoken

    bpe = byte_bpe.encoder(ranks_path())
    return bpe, tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.ranks, special_tokens={})


PARTS = ["a", "b", " ", "  ", "\n", "'", "s", "'re", "'LL", "don't", "1", "é", "٣", "日", "!", "?", "\t", " ", "😀", "the", "r", "l", "\x85", "\x1c", "e", "ve", "   ", "aaaaaa", "\n\n", "abab", "...", "́"]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.lists(st.sampled_from(PARTS), max_size=40).map("".join), max_size=5), st.sampled_from([2, 3, 5, 8, 8192]))
def test_ids_are_the_library_s(tokens, texts, leaf):
    bpe, library = tokens
    before, byte_bpe.LEAF = byte_bpe.LEAF, leaf
    try:
        ids, edges = bpe.encode_texts(pa.array(texts, pa.string()))
    finally:
        byte_bpe.LEAF = before
    assert [ids[a:b].tolist() for a, b in zip(edges[:-1], edges[1:], strict=True)] == [library.encode_ordinary(t) for t in texts]
    data, byte = bpe.decode_ids(pa.array(ids, pa.int32()))
    assert (bytes(data)[: byte[-1]] if len(ids) else b"") == "".join(texts).encode()


@settings(max_examples=100, deadline=None)
@given(st.text(max_size=60))
def test_any_text(tokens, text):
    bpe, library = tokens
    assert bpe.encode_texts(pa.array([text], pa.string()))[0].tolist() == library.encode_ordinary(text)


def test_every_character_is_of_the_library_s_kind(tokens):
    """A letter, a number or white space after one of its kind is in one match with it; so each code point is told by its neighbours."""
    bpe, library = tokens
    r = random.Random(1)
    points = [x for x in range(0x110000) if not 0xD800 <= x < 0xE000 and byte_bpe.kinds()[x] != byte_bpe.OTHER]
    for x in r.sample(points, 3000):
        text = f"a{chr(x)}b 1{chr(x)}2 {chr(x)}!"
        assert bpe.encode_texts(pa.array([text]))[0].tolist() == library.encode_ordinary(text), hex(x)


@pytest.mark.parametrize("text", ["a" * 3000, "ab" * 3000, " " * 5000 + "x", "日本語" * 900, "x" + "\n" * 3001, "abcdefgh"[::-1] * 1000])
def test_long_matches(tokens, text):
    bpe, library = tokens
    want = library.encode_ordinary(text)
    assert bpe.encode_texts(pa.array([text]))[0].tolist() == want
    assert list(bpe._merged(text.strip().encode())) == list(bpe.encode_match(text.strip().encode()))


def test_encode_and_decode_rows(spark, docs, tokens):
    back = byte_bpe.decode(byte_bpe.encode(docs, ranks_path()), ranks_path())
    got = sorted((r["doc_id"] or 0, r["n_tokens"], tuple(r["ids"]), bytes(r["decoded"])) for r in back.collect())
    want = sorted((r["doc_id"] or 0, len(ids), tuple(ids), (r["text"] or "").encode()) for r in docs.collect() for ids in [tokens[1].encode_ordinary(r["text"] or "")])
    assert got == want
    assert byte_bpe.decode(byte_bpe.encode(docs.where("false"), ranks_path()), ranks_path()).collect() == []


def test_op12_digests(spark, tokens):
    sf = "/root/testdata/sf0.001"
    texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = QUERIES["op12_byte_bpe"](spark, sf).collect()
    assert len(got) == len(texts)
    for r in got:
        ids = tokens[1].encode_ordinary(texts[r["doc_id"]])
        assert tuple(r)[1:] == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(texts[r["doc_id"]].encode()).hexdigest())


# Ranked search


def ranked(docs, items, k):
    terms = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", lower(t))
    held = [(i, Counter(terms(t))) for i, t in docs]
    n_docs, n_all = sum(bool(c) for _, c in held), sum(c.total() for _, c in held)
    df = Counter(t for _, c in held for t in c)
    wanted = {}
    for i, t in items:
        wanted.setdefault(i, set()).update(terms(t))
    for item, own in wanted.items():
        found = []
        for i, c in held:
            if c:
                m = 50 + 50 * c.total() * n_docs // n_all
                score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (1_000_000_000 * c[t] // (1000 * c[t] + 20 * m)) for t in own if c[t])
                found.append((-score, i is None, i))
        for rank, (score, _, i) in enumerate(sorted(x for x in found if x[0] < 0)[:k], 1):
            yield item, rank, i, -score


@pytest.mark.parametrize("part,group", [(16_384, 4096), (7, 20), (64, 5)])
def test_search_is_brute_force(spark, monkeypatch, part, group):
    import functools

    texts = [(i, zipf(i, 5 + i % 90, 200)) for i in range(400)] + [(i, zipf(7, 40, 200)) for i in range(400, 440)] + [(None, zipf(7, 40, 200)), (500, None), (501, ""), (502, "!?"), (400, zipf(7, 40, 200)), (503, zipf(503, 20000, 300)), (504, "Ünï W1-w2")]
    items = [(1, zipf(7, 40, 200)), (2, "w0 W0 w1"), (3, None), (4, ""), (5, "unknown"), (6, zipf(99, 60, 300)), (6, "w5 more"), (7, "ünï"), (None, "w3 w4")]
    d = spark.createDataFrame([(i, t, 1, 2, "x") for i, t in texts], "doc_id long, text string, score long, item_id long, terms string").repartition(3)
    q = spark.createDataFrame([(i, t, 5) for i, t in items], "item_id long, text string, doc_id long")
    lists, groups = search.ImpactLists, search._groups
    run = functools.partial(search._searcher)
    monkeypatch.setattr(search, "_searcher", lambda *a: _with_sizes(run(*a), part, group))
    got = sorted(map(tuple, search.search(d, q, 10).collect()), key=str)
    assert lists is search.ImpactLists and groups is search._groups
    assert got == sorted(ranked(texts, items, 10), key=str)


def _with_sizes(run, part, group):
    def work(batches):
        search.PART, search.GROUP_TERMS = part, group
        try:
            yield from run(batches)
        finally:
            search.PART, search.GROUP_TERMS = 16_384, 4096

    return work


def test_search_in_blocks_of_items(spark, monkeypatch):
    monkeypatch.setattr(search, "BLOCK_BYTES", 60)
    texts, items = [(i, zipf(i, 30)) for i in range(50)], [(i, zipf(100 + i, 8)) for i in range(9)]
    got = search.search(spark.createDataFrame(texts, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"), 5)
    assert sorted(map(tuple, got.collect())) == sorted(ranked(texts, items, 5))


@pytest.mark.parametrize("side", ["docs", "items", "both", "words"])
def test_search_of_nothing(spark, side):
    d = spark.createDataFrame([(1, "!" if side == "words" else "a")], "doc_id long, text string").where(f"{side not in ('docs', 'both')}")
    q = spark.createDataFrame([(1, "a")], "item_id long, text string").where(f"{side not in ('items', 'both')}")
    assert search.search(d, q).collect() == []


def test_best_positions_stop_early_and_keep_ties():
    """Documents of every list's top come first, so the rest is never read; ties with the kth are all returned."""
    n, r = 5000, np.random.default_rng(1)
    rows, terms = np.tile(np.arange(n), 3), np.repeat(np.arange(3), n)
    impacts = r.integers(1, 100, 3 * n)
    best = np.isin(rows, [10, 20, 30, 40])
    impacts[best] = 1000
    lists = search.ImpactLists(n, 3, rows, terms, impacts)
    found, scores, read = lists.search(np.arange(3), 2, 0)
    assert sorted(found.tolist()) == [10, 20, 30, 40] and set(scores.tolist()) == {3000} and read < 600
    total = np.zeros(n, np.int64)
    np.add.at(total, rows, impacts)
    for k in (1, 5, 50, n, 2 * n):
        found, scores, _ = lists.search(np.arange(3), k, 0)
        kth = np.sort(total)[-min(k, n)]
        assert sorted(zip(found.tolist(), scores.tolist(), strict=True)) == sorted((i, t) for i, t in enumerate(total.tolist()) if t >= kth)
    assert lists.search(np.arange(3), 5, 3001)[2] < 600 and not len(lists.search(np.arange(3), 5, 3001)[0])
