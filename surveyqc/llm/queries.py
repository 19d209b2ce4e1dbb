"""The registered queries of the operators: production parameters, whole tables, the columns of their contracts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from surveyqc.llm import byte_bpe, chat, collocations, decontamination, html, licenses, packing, quality, rules, search, secrets, simhash, warc
from surveyqc.llm.common import table, written


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def ranks_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def op1_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stretches of documents that hold a known license notice."""
    return licenses.winners(licenses.scan(table(spark, sf_dir, "documents")))


def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where each token piece of each document lies in which sequence."""
    placed = packing.pack(table(spark, sf_dir, "documents"), tokenizer_path())
    return placed.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def op3_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark passages in documents."""
    return decontamination.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op4_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page."""
    return html.extract(table(spark, sf_dir, "pages"))


def op5_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score of every document; labels of the held-out fold are never read."""
    docs = table(spark, sf_dir, "documents")
    scored = quality.score(docs, quality.train(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", quality.held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op6_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of what is read back from the formatted conversations, and of their text under the loss mask."""
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    control = "'</s>[INST] ok [/INST]'"
    extra = spark.sql(f"SELECT -1L AS conv_id, t.* FROM VALUES (0L, 'user', {control}), (1L, 'assistant', {control}) AS t(turn, role, text)")
    back = chat.read_back(chat.format_chats(rows.unionByName(extra)))
    turns = F.array_join(F.transform("turns", lambda x: F.concat(x["role"], F.lit("\n"), x["text"], F.lit("\n"))), "")
    loss = F.array_join("loss_texts", "")
    return back.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(turns, 256).alias("turns_sha256"),
        F.char_length(loss).cast("long").alias("loss_chars"),
        F.sha2(loss, 256).alias("loss_sha256"),
        F.char_length("formatted").cast("long").alias("formatted_chars"),
        "valid",
    )


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of every document and whether the base rule and the proven cutoffs keep it."""
    return rules.apply_rules(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")).drop("broken")


def op8_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every document."""
    prints = written(simhash.fingerprints(table(spark, sf_dir, "documents")), "fingerprints")
    found = simhash.near_duplicates(prints, simhash.agreeing_blocks(radius=2, blocks=4), radius=2, refined=simhash.refined_blocks(radius=2, blocks=4))
    return found.select("doc_id", simhash.hex_digits(F.col("f0")).alias("fingerprint"), "component_id")


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The records of all pages, read back from the archives."""
    index = warc.write_archives(warc.classify(table(spark, sf_dir, "pages")))
    return warc.read_records(index, payloads=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op10_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base and added spans of every document; n_live: those whose value few owners hold and few texts."""
    found = secrets.scan(table(spark, sf_dir, "documents"), max_owners=secrets.SEVERAL_OWNERS, by_text=True, max_repositories=secrets.MANY_TEXTS)
    said = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["stop"])), ",")
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select(
        "doc_id", *[count(k) for k in ("assign", "access", "hex")],
        F.sha2(said(F.filter("spans", lambda s: s["rank"] < 3)), 256).alias("base_sha256"), said(F.col("spans")).alias("spans"),
        F.size(F.filter("spans", lambda s: s["live"])).cast("long").alias("n_live"),
    )


def op11_phrase_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best collocations of every language."""
    return collocations.collocations(table(spark, sf_dir, "documents"))


def op12_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of the ids of every document, and of the bytes that they decode to."""
    back = byte_bpe.decode(byte_bpe.encode(table(spark, sf_dir, "documents"), ranks_path()), ranks_path())
    return back.select("doc_id", "n_tokens", F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op13_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 50 best documents for every benchmark item."""
    return search.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


_ALL = (
    op1_license_scans, op2_best_fit_packing, op3_benchmark_decontamination, op4_html_extraction, op5_quality_classifier, op6_chat_formatting, op7_quality_rules,
    op8_simhash_near_dedup, op9_warc, op10_secret_scans, op11_phrase_collocations, op12_byte_bpe, op13_ranked_search,
)
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in _ALL}
