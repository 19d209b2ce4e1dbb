"""Server exports and form definitions: typed columns, repeats, attachments, labels, incremental refresh."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from surveyqc.functions.transforms import clean_label

# Columns that every export has, and question types with files.
STANDARD_DATES = ("CompletionDate", "SubmissionDate", "starttime", "endtime")
STANDARD_NUMBERS = ("duration", "formdef_version")
MEDIA = ("image", "audio", "video", "file", "text audit", "audio audit", "sensor_stream")


def incremental_append(stored: DataFrame, fresh: DataFrame, date: str, default: str = "1970-01-01", key: str | None = None, tolerance: str = "0 seconds") -> DataFrame:
    """stored and those of fresh that are newer than its latest date; columns that one side lacks are null.

    With a key, rows of fresh at that date, or up to the tolerance before it, are taken too unless stored has their key there: rows
    that share the latest time, or came late, are neither lost nor stored twice. Only that stretch of stored is read for keys.
    """
    mark = stored.agg(F.coalesce(F.max(date), F.lit(default).cast("timestamp")).alias("mark_"))
    dated = fresh.crossJoin(F.broadcast(mark))  # one row
    if key is None:
        newer = dated.where(F.col(date) > F.col("mark_"))
    else:
        since = F.col("mark_") - F.expr(f"INTERVAL {tolerance}")
        known = stored.crossJoin(F.broadcast(mark)).where(F.col(date) >= since).select(F.col(key).alias("known_")).distinct()
        newer = dated.where(F.col(date) >= since).join(known, F.col(key).eqNullSafe(F.col("known_")), "left_anti")
    return stored.unionByName(newer.drop("mark_"), allowMissingColumns=True)


def upsert_by_key(old: DataFrame, new: DataFrame, key: str, keep_new: bool = True) -> DataFrame:
    """One row a key: the new one (or the old one) where both have it. Each side has a key once."""
    kept, added = (new, old) if keep_new else (old, new)
    return kept.unionByName(added.join(kept.select(key).distinct(), key, "left_anti"), allowMissingColumns=True)


def coalesce_key(df: DataFrame, key: str = "KEY", instance: str = "instanceID") -> DataFrame:
    return df.withColumn(key, F.when(F.coalesce(F.col(key), F.lit("")) == "", F.col(instance)).otherwise(F.col(key))).drop(instance)


def _questions(questions: DataFrame) -> list:
    return questions.where("coalesce(lower(disabled), '') NOT IN ('yes', 'true')").select("type", "name").collect()  # a form's questions


def apply_form_types(df: DataFrame, questions: DataFrame, time_format: str = "yyyy-MM-dd HH:mm:ss") -> DataFrame:
    """Columns in the types of their questions; notes go; repeats of a question (name_1, name_1_2 ...) follow it."""
    rows = _questions(questions)
    repeats = set(repeat_fields(questions))
    typed, dropped = {}, []
    for r in rows:
        names = repeat_columns(r["name"], df.columns) if r["name"] in repeats else [r["name"]] if r["name"] in df.columns else []
        for n in names:
            if r["type"] in ("date", "datetime", "time", "start", "end", "today"):
                typed[n] = F.coalesce(F.try_to_timestamp(F.col(n).cast("string"), F.lit(time_format)), F.col(n).cast("string").try_cast("timestamp"))
            elif r["type"] in ("integer", "decimal"):
                typed[n] = F.col(n).try_cast("double")
            elif r["type"] == "note":
                dropped.append(n)
    typed |= {n: F.col(n).cast("string").try_cast("timestamp") for n in STANDARD_DATES if n in df.columns} | {n: F.col(n).try_cast("double") for n in STANDARD_NUMBERS if n in df.columns}
    return df.withColumns(typed).drop(*dropped) if typed else df.drop(*dropped)


def repeat_fields(questions: DataFrame) -> list[str]:
    """Questions inside a begin/end repeat block. questions has seq, its order in the form."""
    depth, found = 0, []
    for r in questions.orderBy("seq").select("type", "name").collect():  # a form's questions
        depth += {"begin repeat": 1, "end repeat": -1}.get(r["type"], 0)
        if depth > 0 and r["type"] not in ("begin repeat", "end repeat", "begin group", "end group"):
            found.append(r["name"])
    return found


def repeat_columns(field: str, columns: Sequence[str]) -> list[str]:
    return [c for c in columns if re.fullmatch(rf"{re.escape(field)}_\d+(_\d+){{0,2}}", c)]


def unpivot_repeats(df: DataFrame, ids: Sequence[str], field: str) -> DataFrame:
    """ids, index_1 to index_3, value of the field's repeats that have a value."""
    names = repeat_columns(field, df.columns)
    cells = df.select(*ids, *[F.col(n).cast("string").alias(n) for n in names]).unpivot(list(ids), names, "column_name", "value").where("value IS NOT NULL")
    parts = F.split(F.substring(F.col("column_name"), len(field) + 2, 100), "_")
    return cells.select(*ids, *[F.get(parts, i).try_cast("int").alias(f"index_{i + 1}") for i in range(3)], "value")


def attachment_manifest(df: DataFrame, questions: DataFrame, key: str = "KEY") -> DataFrame:
    """key, column_name, source, file_name of every attachment that a submission has."""
    names = [n for r in _questions(questions) if r["type"] in MEDIA for n in [r["name"], *repeat_columns(r["name"], df.columns)] if n in df.columns]
    cells = df.select(key, *[F.col(n).cast("string").alias(n) for n in names]).unpivot([key], names, "column_name", "source").where("trim(source) <> ''")
    extension = F.regexp_extract("source", r"(\.[A-Za-z0-9]+)$", 1)
    return cells.select(key, "column_name", "source", F.concat("column_name", F.lit("_"), F.regexp_replace(F.col(key).cast("string"), "uuid:", ""), extension).alias("file_name"))


def value_labels(df: DataFrame, key: str, questions: DataFrame, choices: DataFrame) -> DataFrame:
    """key, column_name, question_label, value, value_label of each coded cell; both small tables go to all tasks."""
    asked = questions.where("type LIKE 'select_one %'").select(F.col("name").alias("column_name"), F.regexp_replace("type", "^select_one ", "").alias("list_name"), clean_label("label").alias("question_label"))
    labels = choices.select("list_name", F.col("name").alias("value"), clean_label("label").alias("value_label"))
    names = [r["column_name"] for r in asked.select("column_name").collect() if r["column_name"] in df.columns]  # a form's questions
    cells = df.select(key, *[F.col(n).cast("string").alias(n) for n in names]).unpivot([key], names, "column_name", "value")
    return cells.join(F.broadcast(asked), "column_name").join(F.broadcast(labels), ["list_name", "value"], "left").select(key, "column_name", "question_label", "value", "value_label")


