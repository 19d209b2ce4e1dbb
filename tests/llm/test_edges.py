"""Empty tables, very long rows, ties, repeats and clashing columns, where the operators' own tests don't have them."""

import hashlib

import corpus_pipeline
import pytest

from surveyqc.llm import chat, packing, quality, warc
from surveyqc.llm.queries import tokenizer_path

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
MORE = ", component long, node long, length long, spans string, kept boolean, row_ string, id_ long"


def words(seed, n):
    import random

    r = random.Random(seed)
    return " ".join("".join(r.choice("abcdefghij") for _ in range(r.randint(2, 9))) for _ in range(n))


def test_packing_of_nothing(spark):
    docs = spark.createDataFrame([], DOCS)
    assert packing.pack(docs, tokenizer_path()).collect() == []
    assert packing.tokenize(docs, tokenizer_path()).collect() == []


@pytest.fixture(scope="module")
def model(spark):
    rows = [(i, words(i, 80) if i % 2 else "!!! ### " * 40) for i in range(60)]
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)], "doc_id long, quality int")
    return quality.train(spark.createDataFrame(rows, "doc_id long, text string"), labels)


def test_scores_of_edges(spark, model):
    text = words(7, 200)
    rows = [(1, text, 9.0), (1, text, 8.0), (2, text, 7.0), (3, None, 1.0), (4, "", 1.0), (5, words(8, 300_000), 1.0), (None, text, 1.0), (6, " \n", 2.0)]
    got = quality.score(spark.createDataFrame(rows, "doc_id long, text string, score double"), model).collect()
    by = {}
    for r in got:
        by.setdefault(r["doc_id"], []).append(r["score"])
    assert {k: len(v) for k, v in by.items()} == {1: 2, 2: 1, 3: 1, 4: 1, 5: 1, 6: 1, None: 1}
    assert len({*by[1], *by[2], *by[None]}) == 1 and by[3] == by[4]
    assert all(0 <= s <= 1 for own in by.values() for s in own)
    assert quality.score(spark.createDataFrame([], DOCS), model).collect() == []


def test_classifier_without_documents_or_labels(spark):
    docs = spark.createDataFrame([(1, "a b c"), (2, None)], "doc_id long, text string")
    for labels in (spark.createDataFrame([], "doc_id long, quality int"), spark.createDataFrame([(9, 1)], "doc_id long, quality int")):
        got = quality.score(docs, quality.train(docs, labels)).collect()
        assert len(got) == 2 and all(0 <= r["score"] <= 1 for r in got)


def test_a_very_long_conversation(spark):
    rows = [(1, i, "user" if i % 2 == 0 else "assistant", f"turn {i} <|im_end|> " + "x" * 50) for i in range(4000)] + [(2, 0, "user", "y" * 2_000_000), (2, 1, "assistant", "</s>" * 100_000)]
    back = {r["conv_id"]: r for r in chat.read_back(chat.format_chats(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))).collect()}
    assert [(t["role"], t["text"]) for t in back[1]["turns"]] == [(r, t) for c, _, r, t in rows if c == 1]
    assert [t["text"] for t in back[2]["turns"]] == ["y" * 2_000_000, "</s>" * 100_000]


def test_a_very_long_page(spark):
    page = "<p>" + words(3, 400_000) + "</p>"
    pages = spark.createDataFrame([(1, "http://a/1", page), (2, "http://a/2", page), (3, "http://a/3", "<p>x</p>")], "page_id long, url string, html string")
    got = {r["page_id"]: r for r in warc.read_records(warc.write_archives(warc.classify(pages))).collect()}
    assert (got[1]["record_type"], got[1]["refers_to"], got[2]["record_type"]) == ("revisit", 2, "response")
    assert got[1]["payload_digest"] == hashlib.sha1(page.encode()).hexdigest() and bytes(got[2]["payload"]) == page.encode()


@pytest.mark.parametrize("kind", ["empty", "odd"])
def test_pipeline_on_odd_tables(spark, tmp_path, kind):
    """Nulls in any column, repeated rows, a long text and columns with clashing names; the columns of documents are what goes on."""
    text = words(1, 120)
    rows = [(1, text, "en", "a", 9), (1, text, "en", "a", 9), (2, text, None, None, None), (3, None, "en", "a", 0), (4, "", "en", "a", 0), (None, words(2, 90), "en", "a", 1), (5, words(3, 30_000), "de", "b", 1), (6, words(4, 100) + " password = hunter22XYZ", "en", "c", 2)]
    docs = spark.createDataFrame([(*r, 7, 7, 7, "s", False, "r", 3) for r in rows], DOCS + MORE)
    tables = {
        "documents": docs if kind == "odd" else docs.where("false"), "labels": spark.createDataFrame([(1, 1, 0), (None, 1, 0)], "doc_id long, quality int, toxic int"),
        "benchmark": spark.createDataFrame([(1, words(9, 60)), (2, None), (3, "")], "item_id long, text string") if kind == "odd" else spark.createDataFrame([], "item_id long, text string"),
    }
    for name, df in tables.items():
        df.write.parquet(f"{tmp_path}/{name}.parquet")
    got = corpus_pipeline.run(spark, f"file://{tmp_path}").collect()
    if kind == "empty":
        assert got == []
        return
    ids = {r["doc_id"] for r in got}
    assert {5, 6} < ids and len(ids & {1, 2}) == 1 and not ids & {3, 4}
    assert len([r for r in got if r["doc_id"] == 1]) == 1 and max(r["piece"] for r in got if r["doc_id"] == 5) > 0
