"""Secret scans in DataFrame operations: patterns find candidates, corpus-wide ownership tells examples from live secrets.

Base kinds are exact patterns. The method then looks at who has a candidate: its hash is aggregated over distinct repositories
and owners. A value that many owners hold, or that lies in many places, was copied around (documentation, examples, checksums of
public files); one that few hold, with the look of a generated value, is live-looking. All found spans are reported with that verdict.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from surveyqc.llm.common import small_or_shuffled, written

# The base patterns. A shorter match is dropped, as it stands where a longer one could not begin.
ASSIGN = r"""((?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?)([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
#: A generated value that no base kind names; it must also have a digit, a capital and a small letter.
TOKEN = r"[A-Za-z0-9_-]{20,}"
MIN_VALUE = 6
#: A value held by more owners than this has been copied around.
MAX_OWNERS = 1
#: For redaction: owners that a copied value has more than, where copies of one text have one vote together.
SEVERAL_OWNERS = 3
#: Distinct texts that a copied value lies in more than, whoever owns them.
MANY_TEXTS = 100
#: Distinct characters that a live-looking value has at least.
MIN_DISTINCT = 6
KINDS = ("assign", "access", "hex", "token")
SPANS = "array<struct<start:long,rank:int,stop:long,kind:string,value:string>>"

JUDGED = "array<struct<start:long,rank:int,stop:long,kind:string,value:string,live:boolean>>"


def _spans(kind: str, pattern: str, value_group: int = 0, min_value: int = 0) -> Column:
    """Leftmost matches of a pattern without overlaps, with places in code points: what lies between them is split off.

    The gaps and the matches alternate, so running sums of their lengths give the places.
    """
    rank = KINDS.index(kind)
    matches, gaps = F.regexp_extract_all("text", F.lit(pattern), F.lit(0)), F.split("text", pattern, -1)
    values = F.regexp_extract_all("text", F.lit(pattern), F.lit(value_group)) if value_group else matches
    rows = F.arrays_zip(gaps.alias("gap"), matches.alias("match"), values.alias("value"))
    start = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast(SPANS).alias("done"))

    def step(s: Column, r: Column) -> Column:
        begin = s["at"] + F.char_length(r["gap"])
        end = begin + F.char_length(r["match"])
        span = F.struct(begin.alias("start"), F.lit(rank).alias("rank"), end.alias("stop"), F.lit(kind).alias("kind"), r["value"].alias("value"))
        keep = r["match"].isNotNull() & (F.char_length(r["value"]) >= min_value)
        return F.struct(F.coalesce(end, begin).cast("long").alias("at"), F.when(keep, F.concat(s["done"], F.array(span))).otherwise(s["done"]).alias("done"))

    return F.when(F.regexp_like("text", F.lit(pattern)), F.aggregate(rows, start, step, lambda s: s["done"])).otherwise(F.array().cast(SPANS))


def candidates(docs: DataFrame) -> DataFrame:
    """Each row of docs with `spans`: the base kinds' and the generic tokens', ordered by start and kind. A null text has none."""
    rows = docs.withColumn("text", F.coalesce("text", F.lit("")))
    base = F.concat(_spans("assign", ASSIGN, 2, MIN_VALUE), _spans("access", ACCESS), _spans("hex", HEX))
    rows = rows.withColumn("base_", base).withColumn("token_", _spans("token", TOKEN))
    mixed = lambda v: F.regexp_like(v, F.lit("[0-9]")) & F.regexp_like(v, F.lit("[A-Z]")) & F.regexp_like(v, F.lit("[a-z]"))
    fresh = F.filter("token_", lambda t: mixed(t["value"]) & ~F.exists("base_", lambda b: (b["start"] < t["stop"]) & (t["start"] < b["stop"])))
    return rows.withColumn("spans", F.array_sort(F.concat("base_", fresh))).drop("base_", "token_")


def ownership(found: DataFrame, owner: str = "source", repository: str = "source", max_owners: int = MAX_OWNERS, text: str | None = None, max_repositories: int | None = None) -> DataFrame:
    """value_hash, owners, repositories, rows, live for candidates found(…, spans); partial counts are made before each shuffle.

    A null owner is an owner. live: held by at most max_owners owners, in at most max_repositories repositories (if given), and of
    enough distinct characters. With `text` (a column that names the text) rows of one text are one vote, of the smallest of their
    owners, and each text is a repository.
    """
    spans = found.select(F.col(owner).alias("owner"), F.col(repository).alias("repository"), *([F.col(text).alias("text_")] if text else []), F.explode("spans").alias("s"))
    if text:
        spans = spans.groupBy("text_", F.col("s.value").alias("value")).agg(F.min("owner").alias("owner")).withColumn("repository", F.col("text_")).withColumn("s", F.struct("value"))
    values = spans.select("owner", "repository", F.sha2("s.value", 256).alias("value_hash"), F.size(F.array_distinct(F.split("s.value", ""))).alias("distinct_"))
    pairs = values.groupBy("value_hash", "owner", "repository").agg(F.count("*").alias("n"), F.max("distinct_").alias("distinct_"))
    owners = pairs.groupBy("value_hash", "owner").agg(F.count("*").alias("repositories"), F.sum("n").alias("n"), F.max("distinct_").alias("distinct_"))
    counted = owners.groupBy("value_hash").agg(F.count("*").alias("owners"), F.sum("repositories").alias("repositories"), F.sum("n").alias("rows"), F.max("distinct_").alias("distinct_"))
    few = F.lit(True) if max_repositories is None else F.col("repositories") <= max_repositories
    return counted.withColumn("live", (F.col("owners") <= max_owners) & few & (F.col("distinct_") >= MIN_DISTINCT)).drop("distinct_")


def scan(docs: DataFrame, owner: str = "source", repository: str = "source", max_owners: int = MAX_OWNERS, by_text: bool = False, max_repositories: int | None = None) -> DataFrame:
    """doc_id, text_hash and `spans` of each row of docs: all base spans and generic tokens, each with the verdict on its value.

    Each span has start, rank, stop (code points, exclusive), kind, value and live. Rows are known by doc_id and text hash, so
    repeated rows and null ids are judged alike; by_text: copies of a text are one vote (`ownership`); an empty table gives none. Texts are read once, then spans alone are moved.
    """
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), F.col(owner).alias("owner_"), F.col(repository).alias("repository_"))
    found = written(candidates(rows).withColumn("text_hash", F.xxhash64("text")).drop("text"), "candidates")
    owned = ownership(found.select("owner_", "repository_", "text_hash", "spans"), "owner_", "repository_", max_owners, "text_hash" if by_text else None, max_repositories)
    copied = written(owned.where("NOT live").select("value_hash", F.lit(False).alias("live")), "copied")
    key = [F.coalesce("doc_id", F.lit(-(1 << 63))).alias("id_"), F.col("text_hash").alias("hash_")]
    some = found.where(F.size("spans") > 0).groupBy(*key).agg(F.first("spans").alias("found_"))
    each = some.select("id_", "hash_", F.explode("found_").alias("s")).withColumn("value_hash", F.sha2("s.value", 256))
    # The spans of a widely copied value are many: what they are joined with is a row a value.
    judged = each.join(small_or_shuffled(copied), "value_hash", "left").withColumn("live", F.coalesce("live", F.lit(True)))
    span = F.struct("s.start", "s.rank", "s.stop", "s.kind", "s.value", "live")
    by_row = judged.groupBy("id_", "hash_").agg(F.sort_array(F.collect_list(span)).alias("spans"))
    rest = found.select("doc_id", "text_hash", *key)
    return rest.join(by_row, ["id_", "hash_"], "left").select("doc_id", "text_hash", F.coalesce("spans", F.array().cast(JUDGED)).alias("spans"))


def redact(docs: DataFrame, owner: str = "source", repository: str = "source", max_owners: int = MAX_OWNERS, by_text: bool = False) -> DataFrame:
    """docs with the values of live spans replaced by their kind in angle brackets; copied examples stay. n_chars follows the text."""
    live = scan(docs, owner, repository, max_owners, by_text).where(F.exists("spans", lambda s: s["live"])).dropDuplicates(["doc_id", "text_hash"])
    found = written(live.select(F.col("doc_id").alias("id_"), F.col("text_hash").alias("hash_"), F.filter("spans", lambda s: s["live"]).alias("spans_")), "live")
    joined = docs.join(small_or_shuffled(found), docs["doc_id"].eqNullSafe(F.col("id_")) & (F.xxhash64(F.coalesce(docs["text"], F.lit(""))) == F.col("hash_")), "left")

    def step(s: Column, x: Column) -> Column:
        begin = F.greatest(x["stop"] - F.char_length(x["value"]), s["at"])
        piece = F.concat(s["out"], F.substr("text", (s["at"] + 1).cast("int"), (begin - s["at"]).cast("int")), F.lit("<"), x["kind"], F.lit(">"))
        inside = x["stop"] <= s["at"]
        return F.struct(F.greatest(x["stop"], s["at"]).alias("at"), F.when(inside, s["out"]).otherwise(piece).alias("out"))

    start = F.struct(F.lit(0).cast("long").alias("at"), F.lit("").alias("out"))
    clean = F.aggregate("spans_", start, step, lambda s: F.concat(s["out"], F.substr("text", (s["at"] + 1).cast("int"))))
    text = F.when(F.col("spans_").isNull(), F.col("text")).otherwise(clean)
    changed = {"text": text} | ({"n_chars": F.when(F.col("spans_").isNull(), F.col("n_chars")).otherwise(F.char_length(clean).cast("long"))} if "n_chars" in docs.columns else {})
    return joined.withColumns(changed).select(*docs.columns)
