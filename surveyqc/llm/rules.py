"""Quality rules with risk-controlled cutoffs, in DataFrame operations.

Counts of each whole text come first. The base rule rejects short and repetitive texts. For the further rules, labelled
holdouts decide. Settings of all rules together are ordered from lenient to strict. In each stratum the exact binomial test
asks, setting by setting in that fixed order, whether the rate of good documents that it rejects is proven to stay under
LIMIT, and the last one before the first that is not proven is taken. Tests in a fixed order need no correction among
themselves; strata share the error probability (Bonferroni). So with probability 1 - DELTA no stratum loses more than LIMIT of
its good documents to these rules.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from surveyqc.llm.common import SPACE, small_or_shuffled, written

#: Share of a stratum's good documents that all rules together may reject, and the probability that this fails.
LIMIT = 0.02
DELTA = 0.05
SYMBOLS = "#*$%&|<>"
BLANKS = " \t\n\x0b\x0c\r"
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50

#: Rule: (measure, cutoffs from lenient to strict, one for each setting); a document above the cutoff is rejected.
RULES: dict[str, tuple[str, tuple[float, ...]]] = {
    "symbols": ("n_symbols / n_words", (3.2, 1.6, 0.8, 0.4, 0.2, 0.1)),
    "duplicate_lines": ("n_dup_lines / n_lines", (0.8, 0.7, 0.5, 0.4, 0.3, 0.2)),
    "repeats": ("n_repeat_words / n_words", (0.45, 0.4, 0.35, 0.3, 0.25, 0.2)),
    "capitals": ("n_capitals / word_chars", (0.8, 0.6, 0.4, 0.3, 0.2, 0.1)),
    "exclamations": ("n_exclamations / n_words", (3.2, 1.6, 0.8, 0.4, 0.2, 0.1)),
    "long_words": ("word_chars / n_words", (30.0, 25.0, 20.0, 15.0, 12.0, 10.0)),
}
SETTINGS = 6
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def counts(docs: DataFrame, carry: bool = False) -> DataFrame:
    """doc_id, lang and counts of each whole text (carry: and the whole row as row_); a null or empty text has none of anything.

    Repeated three-word windows are found within the row: window hashes with their positions in the low bits are sorted, equal
    neighbours are compared word by word, and the positions that repeated windows cover are counted. No row is moved.
    """
    text = F.coalesce("text", F.lit(""))
    row = [F.struct("*").alias("row_")] if carry else []
    kept = ["row_"] if carry else []
    rows = docs.select(*row, "doc_id", "lang", text.alias("text"))
    trimmed = F.btrim("text", F.lit(BLANKS))
    rows = rows.select(
        *kept,
        "doc_id",
        "lang",
        F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, SPACE)).alias("words"),
        F.filter(F.split("text", "\n"), lambda x: F.btrim(x, F.lit(BLANKS)) != "").alias("lines"),
        (F.char_length("text") - F.char_length(F.regexp_replace("text", r"[^\x20\x09-\x0D]++", ""))).cast("long").alias("word_chars"),
        F.regexp_replace("text", f"[^A-Z!{SYMBOLS}]++", "").alias("marks"),
    )
    count = lambda wanted: F.char_length(F.regexp_replace("marks", f"[^{wanted}]++", "")).cast("long")
    rows = rows.withColumns({"n_symbols": count(SYMBOLS), "n_capitals": count("A-Z"), "n_exclamations": count("!")})
    n = F.size("words")
    rows = rows.withColumn("bits", F.ceil(F.log2(F.greatest(n, F.lit(2)))).cast("int"))
    packed = F.expr("IF(size(words) < 3, array(), transform(sequence(0, size(words) - 3), i -> shiftleft(xxhash64(words[i], words[i + 1], words[i + 2]), bits) | i))")
    rows = rows.withColumn("packed", F.sort_array(packed.cast("array<bigint>")))
    same = "shiftright(x, bits) = shiftright({y}, bits) AND words[int(x & mask)] = words[int({y} & mask)] AND words[int(x & mask) + 1] = words[int({y} & mask) + 1] AND words[int(x & mask) + 2] = words[int({y} & mask) + 2]"
    repeated = F.expr(f"filter(packed, (x, k) -> (k > 0 AND {same.format(y='packed[k - 1]')}) OR (k < size(packed) - 1 AND {same.format(y='packed[k + 1]')}))")
    rows = rows.withColumn("mask", F.expr("shiftleft(1L, bits) - 1")).withColumn("repeated", repeated)
    covered = F.expr("aggregate(sort_array(transform(repeated, x -> x & mask)), struct(0L AS n, 0L AS until), (s, p) -> struct(s.n + least(3L, p + 3L - s.until) AS n, p + 3L AS until), s -> s.n)")
    return rows.select(
        *kept, "doc_id", "lang", n.cast("long").alias("n_words"), "word_chars", "n_symbols",
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"), covered.alias("n_repeat_words"),
        F.size("lines").cast("long").alias("n_lines"), "n_capitals", "n_exclamations",
    )


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))


def binomial_cdf(n: Column, k: Column, p: float) -> Column:
    """P(X <= k) for X ~ Bin(n, p), summed exactly in logarithms."""
    first = F.struct((n * math.log(1 - p)).alias("term"), (n * math.log(1 - p)).alias("total"))

    def add(s: Column, j: Column) -> Column:
        term = s["term"] + F.log((n - j + 1) / j) + math.log(p / (1 - p))
        high, low = F.greatest(s["total"], term), F.least(s["total"], term)
        return F.struct(term.alias("term"), (high + F.log1p(F.exp(low - high))).alias("total"))

    steps = F.when(k > 0, F.sequence(F.lit(1).cast("long"), k)).otherwise(F.array().cast("array<long>"))
    return F.least(F.lit(1.0), F.exp(F.aggregate(steps, first, add, lambda s: s["total"])))


def broken(rule: str, setting: int) -> Column:
    """Whether a document is above a setting's cutoff; at the cutoff, and without words, it isn't."""
    measure, grid = RULES[rule]
    return F.coalesce(F.expr(f"n_words > 0 AND {measure} > {grid[setting]}D"), F.lit(False))


def cutoffs(counted: DataFrame, labels: DataFrame, stratum: str = "lang", limit: float = LIMIT, delta: float = DELTA) -> DataFrame:
    """stratum_, setting and one column for each rule: the cutoffs of the strictest setting that is proven safe, or null.

    A labelled document is good if all its labels say 1. Documents that the base rule rejects don't count. One pass counts the
    rejections of every setting, by stratum; a stratum with few labels proves nothing and loses nothing.
    """
    good = labels.groupBy("doc_id").agg(F.min("quality").alias("q")).where("q = 1").select("doc_id")
    held = counted.where(~base_failed()).join(good, "doc_id", "left_semi")
    lost = [reduce(lambda a, b: a | b, [broken(rule, i) for rule in RULES]) for i in range(SETTINGS)]
    counted_ = held.groupBy(stratum).agg(F.count("*").alias("n"), *[F.count_if(x).alias(f"k{i}") for i, x in enumerate(lost)])
    strata = counted_.crossJoin(counted_.agg(F.count("*").alias("strata")))  # one row
    safe = lambda i: (F.col(f"k{i}") < limit * F.col("n")) & (binomial_cdf(F.col("n"), F.col(f"k{i}"), limit) <= delta / F.col("strata"))
    setting = F.coalesce(*[F.when(~safe(i), F.lit(i - 1)) for i in range(SETTINGS)], F.lit(SETTINGS - 1))
    found = {rule: F.get(F.array(*map(F.lit, grid)), F.col("setting")) for rule, (_, grid) in RULES.items()}
    return strata.select(F.col(stratum).alias("stratum_"), setting.alias("setting")).select("stratum_", "setting", *[c.alias(f"cut_{r}") for r, c in found.items()])


def judged(counted: DataFrame, cuts: DataFrame) -> DataFrame:
    """counted with base_failed, broken (the rules whose cutoff the document is above; at it it stays) and kept; cuts has a row for each stratum."""
    joined = counted.join(small_or_shuffled(cuts), F.col("lang").eqNullSafe(F.col("stratum_")), "left")
    named = F.array_compact(F.array(*[F.when(F.coalesce(F.expr(f"n_words > 0 AND {m} > cut_{r}"), F.lit(False)), F.lit(r)) for r, (m, _) in RULES.items()]))
    joined = joined.withColumn("base_failed", base_failed()).withColumn("broken", named)
    return joined.withColumn("kept", F.when(F.col("base_failed"), False).otherwise(F.size("broken") == 0))


def apply_rules(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, the counts, base_failed, kept and the rules broken, one row per row of docs.

    Nulls: a null text has no words and fails the base rule, a null lang is a stratum of its own, a null doc_id has no label.
    Without labels nothing but the base rule rejects. Repeated rows are judged alike; an empty table gives none.
    """
    counted = written(counts(docs), "counts")
    return judged(counted, written(cutoffs(counted, labels), "cutoffs")).select("doc_id", *COUNTS, "base_failed", "kept", "broken")


def keep(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of docs, with all their columns, that the rules keep. Rows are written once beside their counts, so no text is counted twice or shuffled."""
    counted = written(counts(docs, carry=True), "counted")
    return judged(counted, written(cutoffs(counted, labels), "cutoffs")).where("kept").select("row_.*")
