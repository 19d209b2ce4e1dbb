"""The registered queries of the survey checks, each beside its DuckDB SQL (None where SQL can't say it)."""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from surveyqc.functions import columns as C
from surveyqc.functions import periods as P
from surveyqc.functions import transforms as X
from surveyqc.functions.geo import geodesic
from surveyqc.functions.shared import new_folder, written
from surveyqc.operators import backchecks as B
from surveyqc.operators import corrections as K
from surveyqc.operators import descriptive as D
from surveyqc.operators import duplicates as U
from surveyqc.operators import enumerator as E
from surveyqc.operators import filters as R
from surveyqc.operators import gps as G
from surveyqc.operators import missing as M
from surveyqc.operators import outliers as O
from surveyqc.operators import progress as V
from surveyqc.operators import summary as S
from surveyqc.plans import prep, report
from surveyqc.plans.fixtures import AS_OF, WITH, Tables
from surveyqc.sources import files, forms
from surveyqc.streaming import keyed_table, streams

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

CODES = {"dont_know": ["-999"], "refused": ["-888"]}
CELLS = ("age", "income", "children", "region")
BOUNDS = {"age": O.Bounds(hard_min=0, soft_min=5, soft_max=70, hard_max=85), "income": O.Bounds(soft_min=2000, hard_max=1_000_000)}
COMPARED = (B.Compared("income", 1, ("number", -2, 2)), B.Compared("children", 2, ("percentage", -10, 10)), B.Compared("region", 3))
TEXT = B.TextOptions(case="lower", trim=True, no_symbols=True)


def add(name: str, run: Callable[[Tables], DataFrame], sql: str | None = None, doubles: str = "") -> None:
    """doubles: columns that both engines round to 6 places, as sums of doubles differ in their last digits."""

    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        df = run(Tables(spark, sf_dir))
        return df.withColumns({c: F.round(F.col(c), 6) + 0.0 for c in doubles.split()}) if doubles else df

    QUERIES[name] = query
    if sql is not None:
        replaced = f"SELECT * REPLACE ({', '.join(f'round({c}, 6) + 0.0 AS {c}' for c in doubles.split())}) FROM ({{}})" if doubles else "SELECT * FROM ({})"
        coded = ", ".join(f"CASE WHEN {c} IS NULL THEN 1 WHEN TRY_CAST({c} AS VARCHAR) IN ('-888', '-888.0') THEN 3 WHEN TRY_CAST({c} AS VARCHAR) IN ('-999', '-999.0') THEN 2 ELSE 0 END AS {c}" for c in CELLS)
        SQL[name] = f"WITH {WITH}, coded AS (SELECT survey_key, survey_date, enumerator, team, {coded} FROM survey) " + replaced.format(sql)


def coded(t: Tables) -> DataFrame:
    return M.missing_encode(t.survey.select("survey_key", "survey_date", "enumerator", "team", *CELLS), CODES, CELLS)


# Sources and sinks


def _csv(t: Tables) -> DataFrame:
    folder = new_folder(t.spark)
    df = t.survey.select("survey_key", "survey_date", "age", "income", "region")
    df.write.option("header", True).csv(folder)
    return files.scan_csv(t.spark, folder).withColumns({"survey_key": F.col("survey_key").cast("long"), "age": F.col("age").cast("long")})


def _json(t: Tables) -> DataFrame:
    folder = new_folder(t.spark)
    t.survey.select("survey_key", "age", "region").write.json(folder)
    return t.spark.read.json(folder, schema="survey_key long, age long, region string")


def _stata(t: Tables) -> DataFrame:
    """Written by tasks (one file each) with pandas, read by scan_stata_many."""
    folder = new_folder(t.spark).removeprefix("file://")

    def save(batches):
        import os

        from pyspark import TaskContext

        os.makedirs(folder, exist_ok=True)
        for i, b in enumerate(batches):
            b.to_stata(f"{folder}/{TaskContext.get().partitionId()}-{i}.dta", write_index=False)
            yield b[["survey_key"]].head(0)

    t.survey.select("survey_key", F.col("duration").cast("double").alias("duration")).mapInPandas(save, "survey_key long").write.format("noop").mode("overwrite").save()
    return files.scan_stata_many(t.spark, folder, "survey_key long, duration double")


CORE = "survey_key, age, region"
add("scan_csv", _csv, "SELECT survey_key, survey_date, age, income, region FROM survey", "income")
add("scan_json", _json, f"SELECT {CORE} FROM survey")
add("scan_parquet", lambda t: files.scan_parquet(t.spark, f"{t.sf_dir}/orders.parquet").select("o_orderkey", "o_custkey", "o_orderstatus"), "SELECT o_orderkey, o_custkey, o_orderstatus FROM orders")
add("scan_stata_many", _stata, "SELECT survey_key, duration::DOUBLE AS duration FROM survey")
add("incremental_append", lambda t: forms.incremental_append(t.survey.where("survey_date < '2000-01-01'").select("survey_key", "survey_date", "age"), t.survey.where("survey_key % 2 = 0").select("survey_key", "survey_date", "region"), "survey_date"),
    "SELECT survey_key, survey_date, age, NULL::VARCHAR AS region FROM survey WHERE survey_date < '2000-01-01' UNION ALL SELECT survey_key, survey_date, NULL, region FROM survey WHERE survey_key % 2 = 0 AND survey_date > (SELECT max(survey_date) FROM survey WHERE survey_date < '2000-01-01')")
add("incremental_append_ties", lambda t: forms.incremental_append(t.survey.where("survey_date < '2000-01-01' AND survey_key % 3 <> 0").select("survey_key", "survey_date", "age"), t.survey.select("survey_key", "survey_date", "region"), "survey_date", key="survey_key", tolerance="10 days"),
    """SELECT survey_key, survey_date, CASE WHEN survey_date < '2000-01-01' AND survey_key % 3 <> 0 THEN age END AS age, CASE WHEN NOT (survey_date < '2000-01-01' AND survey_key % 3 <> 0) THEN region END AS region
    FROM survey WHERE survey_date < '2000-01-01' AND survey_key % 3 <> 0 OR survey_date >= (SELECT max(survey_date) FROM survey WHERE survey_date < '2000-01-01' AND survey_key % 3 <> 0) - INTERVAL 10 DAY""")
add("upsert_by_key", lambda t: forms.upsert_by_key(t.survey.where("survey_key % 3 <> 0").select("survey_key", "duration"), t.survey.where("survey_key % 2 = 0").select("survey_key", (F.col("duration") + 1).alias("duration")), "survey_key"),
    "SELECT survey_key, CASE WHEN survey_key % 2 = 0 THEN duration + 1 ELSE duration END AS duration FROM survey WHERE survey_key % 3 <> 0 OR survey_key % 2 = 0")
add("coalesce_key", lambda t: forms.coalesce_key(t.survey.select(F.when(F.col("survey_key") % 5 == 0, "").otherwise(F.concat(F.lit("k"), "survey_key")).alias("KEY"), F.concat(F.lit("i"), "survey_key").alias("instanceID"))),
    "SELECT CASE WHEN survey_key % 5 = 0 THEN 'i' || survey_key ELSE 'k' || survey_key END AS \"KEY\" FROM survey")


def _form(t: Tables) -> tuple[DataFrame, DataFrame]:
    questions = t.spark.createDataFrame([(0, "datetime", "visited", None, "When"), (1, "integer", "age", None, "<b>Age</b>"), (2, "note", "hint", None, ""), (3, "begin repeat", "kids", None, ""), (4, "integer", "kid_age", None, "Age of  child"), (5, "end repeat", "kids", None, ""), (6, "image", "photo", None, "Photo"), (7, "select_one regions", "region", None, "Which <i>region</i>?"), (8, "integer", "old", "yes", "")], "seq int, type string, name string, disabled string, label string")
    df = t.survey.select(
        F.concat(F.lit("uuid:"), "survey_key").alias("KEY"), F.date_format("survey_date", "yyyy-MM-dd HH:mm:ss").alias("visited"), F.when(F.col("survey_key") % 9 == 0, "none").otherwise(F.col("age").cast("string")).alias("age"),
        F.lit("x").alias("hint"), F.col("children").cast("string").alias("kid_age_1"), F.when(F.col("survey_key") % 2 == 0, F.col("duration").cast("string")).alias("kid_age_2"),
        F.when(F.col("survey_key") % 4 == 0, F.concat(F.lit("media/"), "survey_key", F.lit(".jpg"))).alias("photo"), F.substring("region", 1, 1).alias("region"), F.lit("7").alias("old"),
    )
    return df, questions


add("apply_form_types", lambda t: forms.apply_form_types(*_form(t)).drop("photo", "region"),
    "SELECT 'uuid:' || survey_key AS \"KEY\", survey_date::TIMESTAMP AS visited, CASE WHEN survey_key % 9 <> 0 THEN age::DOUBLE END AS age, children::DOUBLE AS kid_age_1, CASE WHEN survey_key % 2 = 0 THEN duration::DOUBLE END AS kid_age_2, '7' AS old FROM survey")
add("unpivot_repeats", lambda t: forms.unpivot_repeats(_form(t)[0], ["KEY"], "kid_age"),
    "SELECT 'uuid:' || survey_key AS \"KEY\", 1 AS index_1, NULL::INT AS index_2, NULL::INT AS index_3, children::VARCHAR AS value FROM survey WHERE children IS NOT NULL UNION ALL SELECT 'uuid:' || survey_key, 2, NULL, NULL, duration::VARCHAR FROM survey WHERE survey_key % 2 = 0")
add("attachment_manifest", lambda t: forms.attachment_manifest(*_form(t)),
    "SELECT 'uuid:' || survey_key AS \"KEY\", 'photo' AS column_name, 'media/' || survey_key || '.jpg' AS source, 'photo_' || survey_key || '.jpg' AS file_name FROM survey WHERE survey_key % 4 = 0")
add("value_labels", lambda t: forms.value_labels(_form(t)[0], "KEY", _form(t)[1], t.spark.createDataFrame([("regions", str(i), f"<p>Region  {i}</p>") for i in range(1, 5)], "list_name string, name string, label string")),
    "SELECT 'uuid:' || survey_key AS \"KEY\", 'region' AS column_name, 'Which region ?' AS question_label, region[1] AS value, CASE WHEN region[1] <> '5' THEN 'Region ' || region[1] END AS value_label FROM survey")


def _stages(t: Tables) -> DataFrame:
    root = new_folder(t.spark)
    files.save_stage(t.survey, root, "p", "raw", "my survey!")
    files.save_stage(t.survey.where("survey_key % 2 = 0"), root, "p", "prep", "my survey!")
    files.save_stage(t.survey.where("false"), root, "p", "corrected", "my survey!")
    return files.resolve_stage(t.spark, root, "p", "my survey!").select("survey_key", "age", "region")


def _bundle(t: Tables) -> DataFrame:
    folder = new_folder(t.spark)
    log = _log(t)
    files.export_bundle({"raw": t.survey, "corrections": log, "codebook": D.codebook(t.survey, CELLS), "actions": K.correction_summary(log)}, folder)
    return t.spark.read.parquet(f"{folder}/actions")


def _log(t: Tables) -> DataFrame:
    """A log of corrections that grows with the survey; some entries name what doesn't exist."""
    s = t.survey.where("survey_key % 7 = 0").select(F.col("survey_key").cast("string").alias("key"), (F.col("survey_key") % 21).alias("m"), "survey_key")
    kind = F.when(F.col("m") == 0, "remove row").when(F.col("m") == 7, "remove value").otherwise("modify value")
    first = s.select(F.col("survey_key").alias("seq"), F.when(F.col("survey_key") % 77 == 0, F.concat(F.lit("x"), "key")).otherwise(F.col("key")).alias("key"), kind.alias("action"), F.when(kind != "remove row", "age").alias("column"), F.when(kind == "modify value", "33").alias("new_value"), F.lit("r").alias("reason"))
    again = s.where("m = 7 AND survey_key % 2 = 0").select((F.col("survey_key") + 10_000_000).alias("seq"), "key", F.lit("modify value").alias("action"), F.lit("region").alias("column"), F.lit("moved").alias("new_value"), F.lit("r").alias("reason"))
    return first.unionByName(again)


LOG = """SELECT survey_key AS seq, CASE WHEN survey_key % 77 = 0 THEN 'x' || survey_key ELSE survey_key::VARCHAR END AS key, CASE survey_key % 21 WHEN 0 THEN 'remove row' WHEN 7 THEN 'remove value' ELSE 'modify value' END AS action,
  CASE WHEN survey_key % 21 <> 0 THEN 'age' END AS col, CASE WHEN survey_key % 21 = 14 THEN '33' END AS new_value FROM survey WHERE survey_key % 7 = 0
  UNION ALL SELECT survey_key + 10000000, survey_key::VARCHAR, 'modify value', 'region', 'moved' FROM survey WHERE survey_key % 21 = 7 AND survey_key % 2 = 0"""
add("save_stage", _stages, f"SELECT {CORE} FROM survey WHERE survey_key % 2 = 0")
add("delete_rows", lambda t: files.delete_rows(t.survey.select("survey_key", "region"), "region", "2-HIGH"), "SELECT survey_key, region FROM survey WHERE region IS DISTINCT FROM '2-HIGH'")
add("export_bundle", _bundle, f"SELECT action, count(*) AS entries, count(DISTINCT key) AS keys FROM ({LOG}) GROUP BY action")
add("dataset_preview_metrics", lambda t: files.dataset_preview_metrics(t.survey.select("survey_key", *CELLS)), "SELECT count(*) AS rows, 5 AS columns, round((count(*) - count(age) + count(*) - count(income) + count(*) - count(children)) * 100.0::DOUBLE / (count(*) * 5), 2) AS missing_pct FROM survey", "missing_pct")

# Row and column removal

IDS = "survey_key"
add("remove_rows_by_index", lambda t: R.remove_rows_by_index(t.survey.select("survey_key"), [0, "5:9", 20], ["survey_key"]), "SELECT survey_key FROM (SELECT survey_key, row_number() OVER (ORDER BY survey_key) - 1 AS i FROM survey) WHERE NOT (i = 0 OR i BETWEEN 5 AND 9 OR i = 20)")
_filters = {
    "remove_if_missing": (lambda d: R.remove_if_missing(d, ["age", "income"]), "age IS NOT NULL AND income IS NOT NULL"),
    "remove_if_not_missing": (lambda d: R.remove_if_not_missing(d, ["age", "income"]), "age IS NULL OR income IS NULL"),
    "remove_equal": (lambda d: R.keep_equal(d, ["age"], [10, 20]), "age IN (10, 20)"),
    "remove_not_equal": (lambda d: R.keep_not_equal(d, ["age"], [10, 20]), "age NOT IN (10, 20)"),
    "remove_gt": (lambda d: R.remove_compared(d, ["age", "children"], "gt", 3), "age <= 3 OR children <= 3"),
    "remove_ge": (lambda d: R.remove_compared(d, ["age"], "ge", 30), "age < 30"),
    "remove_lt": (lambda d: R.remove_compared(d, ["age"], "lt", 30), "age >= 30"),
    "remove_le": (lambda d: R.remove_compared(d, ["age"], "le", 30), "age > 30"),
    "remove_between": (lambda d: R.remove_between(d, ["age"], 10, 40), "NOT (age BETWEEN 10 AND 40)"),
    "remove_not_between": (lambda d: R.remove_not_between(d, ["age"], 10, 40), "age BETWEEN 10 AND 40"),
    "remove_like": (lambda d: R.remove_like(d, ["region", "note"], "HIGH|URG"), "NOT regexp_matches(region, 'HIGH|URG') AND NOT regexp_matches(note, 'HIGH|URG')"),
    "remove_not_like": (lambda d: R.remove_not_like(d, ["region", "note"], "^2"), "regexp_matches(region, '^2') OR regexp_matches(note, '^2')"),
    "numeric_condition": (lambda d: d.where(R.numeric_condition(F.col("age"), "in range", (20, 30)) | R.numeric_condition(F.col("age"), "=", None)), "age BETWEEN 20 AND 30 OR age IS NULL"),
    "string_condition": (lambda d: d.where(R.string_condition(F.col("region"), "starts with", "1") | R.string_condition(F.col("region"), "includes", ["5-LOW"])), "region LIKE '1%' OR region = '5-LOW'"),
    "condition_or_missing": (lambda d: R.filter_on_condition(d, "age", ">", "50", or_missing=True), "age > 50 OR age IS NULL"),
    "filter_on_condition": (lambda d: R.filter_on_condition(d, "survey_date", ">=", "2000-01-01"), "survey_date >= '2000-01-01'"),
    "category_filter": (lambda d: R.category_filter(d, "team", [1, 3]), "team IN (1, 3)"),
    "lookup_by_key": (lambda d: R.lookup_by_key(d, "survey_key", 77), "survey_key = 77"),
}
for _name, (_run, _where) in _filters.items():
    add(_name, lambda t, f=_run: f(t.survey).select("survey_key", "age", "region", "note"), f"SELECT survey_key, age, region, note FROM survey WHERE {_where}")
add("nonmissing_coordinates", lambda t: R.nonmissing_coordinates(t.gps, "latitude", "longitude").select("survey_key"), "SELECT survey_key FROM gps WHERE latitude IS NOT NULL")
add("remove_columns", lambda t: R.remove_columns(t.survey.select("survey_key", "age", "region", "note"), ["note", "region"]), "SELECT survey_key, age FROM survey")
add("add_constant", lambda t: R.add_constant(R.add_constant(R.add_constant(t.survey.select("survey_key"), "a", "7"), "b", "7.5"), "c", "x7"), "SELECT survey_key, 7 AS a, 7.5::DOUBLE AS b, 'x7' AS c FROM survey")
add("add_uuid", lambda t: R.add_uuid(t.survey.select("survey_key"), "uuid", "proj", ["survey_key"]), "SELECT survey_key, sha256('proj_' || (row_number() OVER (ORDER BY survey_key) - 1)) AS uuid FROM survey")
add("add_random", lambda t: R.add_random(t.survey.select("survey_key"), "u", 7, "survey_key").agg(F.count("*").alias("n"), F.min("u").between(0, 0.01).alias("low"), F.max("u").between(0.99, 1).alias("high"), F.avg("u").between(0.48, 0.52).alias("mid")), "SELECT count(*) AS n, true AS low, true AS high, true AS mid FROM survey")
add("add_index", lambda t: R.add_index(t.survey.select("survey_key", "survey_date"), "i", ["survey_date", "survey_key"]), "SELECT survey_key, survey_date, row_number() OVER (ORDER BY survey_date, survey_key) - 1 AS i FROM survey")
#: Notes with each of the missing tokens, within white space.
NOTED = "CASE survey_key % 97 " + " ".join(f"WHEN {i} THEN concat(chr(9), ' {x.strip()} ', chr(10))" for i, x in enumerate(C.MISSING_TOKENS)) + " ELSE note END"
_bare = "trim(note, ' ' || chr(9) || chr(10))"
add("standardize_missing", lambda t: C.standardize_missing(t.survey.select("survey_key", F.expr(NOTED).alias("note"), "age")),
    f"SELECT survey_key, CASE WHEN {_bare} NOT IN ({', '.join(repr(x) for x in C.MISSING_TOKENS if x.strip() == x)}) THEN {_bare} END AS note, age FROM (SELECT "
    f"* REPLACE ({NOTED} AS note) FROM survey)")
add("safe_to_numeric", lambda t: C.safe_to_numeric(t.survey.select("survey_key", "note"), "note"), "SELECT survey_key, TRY_CAST(note AS DOUBLE) AS note FROM survey")
add("append_context_columns", lambda t: R.append_context_columns(U.column_duplicates(t.survey, "age", ["survey_key"]), t.survey, "survey_key", ["region", "team"]),
    "SELECT survey_key, age, CASE WHEN age IS NULL THEN 0 ELSE n END AS duplicate_count, region, team FROM (SELECT *, count(*) OVER (PARTITION BY age) AS n FROM survey) WHERE n > 1")
add("validate_key", lambda t: R.validate_key(t.survey, "age"), "SELECT count(*) AS rows, count(*) - count(age) AS nulls, count(age) - count(DISTINCT age) AS repeats, false AS valid FROM survey")

# Joins and sets


add("backcheck_merge", lambda t: B.backcheck_merge(t.survey.withColumn("survey_id", F.col("survey_key")), t.visits, "survey_id").select("survey_id", "income", "income__BCCL", "backchecker", "survey_key__BCCL"),
    "SELECT v.survey_id, s.income, v.income AS income__BCCL, v.backchecker, v.survey_key AS survey_key__BCCL FROM survey s JOIN visits v ON s.survey_key = v.survey_id", "income income__BCCL")
#: Back-check comparison without text normalisation, which keeps numbers as they are in both engines.
PLAIN = B.TextOptions(case="lower", trim=True)


def compared(t: Tables) -> DataFrame:
    own = t.survey.withColumn("survey_id", F.col("survey_key"))
    return B.backcheck_compare(own, t.visits, "survey_id", "survey_key", COMPARED, PLAIN)


def attached(t: Tables) -> DataFrame:
    own = t.survey.withColumn("survey_id", F.col("survey_key"))
    rows = B.staff_attach(compared(t), own, "survey_key", "enumerator")
    return B.visit_dates_attach(rows, own, t.visits, "survey_key", "survey_date", "backcheck_date", "survey_key__BCCL")


PAIRS = """(SELECT v.survey_id, s.survey_key, s.enumerator, s.survey_date, v.backcheck_date, c.* FROM survey s JOIN visits v ON s.survey_key = v.survey_id, LATERAL (
  SELECT 'income' AS column_name, 1 AS category, s.income AS s, v.income AS b, CASE WHEN s.income IS NULL OR v.income IS NULL THEN 'missing' WHEN s.income = v.income THEN 'match' ELSE 'mismatch' END AS status, s.income IS NOT NULL AS has_s, v.income IS NOT NULL AS has_b, s.income - v.income BETWEEN -2 AND 2 AS within_range
  UNION ALL SELECT 'children', 2, s.children, v.children, CASE WHEN s.children IS NULL OR v.children IS NULL THEN 'missing' WHEN s.children = v.children THEN 'match' ELSE 'mismatch' END, s.children IS NOT NULL, v.children IS NOT NULL, CASE WHEN s.children <> 0 THEN (s.children - v.children) * 100.0::DOUBLE / abs(s.children) BETWEEN -10 AND 10 END
  UNION ALL SELECT 'region', 3, NULL, NULL, CASE WHEN trim(lower(s.region)) = trim(lower(v.region)) THEN 'match' ELSE 'mismatch' END, true, true, NULL) c)"""
RATES = (
    "count(*) FILTER ({w} has_s) AS survey_values{k}, count(*) FILTER ({w} has_b) AS backcheck_values{k}, count(*) FILTER ({w} status <> 'missing') AS compared{k}, "
    "count(*) FILTER ({w} status = 'mismatch') AS mismatches{k}, round(count(*) FILTER ({w} status = 'mismatch') * 100.0::DOUBLE / nullif(count(*) FILTER ({w} "
    "status <> 'missing'), 0), 2) AS error_rate{k}"
)
add("backcheck_compare", lambda t: compared(t).select("survey_id", "column_name", "category", "status", "difference", "within_range"),
    f"SELECT survey_id, column_name, category, status, s - b AS difference, within_range FROM {PAIRS}", "difference")
add("staff_attach", lambda t: B.staff_attach(compared(t), t.survey, "survey_key", "enumerator").select("survey_id", "column_name", "enumerator"), f"SELECT survey_id, column_name, enumerator FROM {PAIRS}")
add("visit_dates_attach", lambda t: attached(t).select("survey_id", "column_name", "survey_date", "backcheck_date"), f"SELECT survey_id, column_name, survey_date, backcheck_date::DATE AS backcheck_date FROM {PAIRS}")
add("comparison_context", lambda t: B.comparison_context(B.comparison_details(compared(t)), t.survey, t.visits, "survey_key", ["team"], ["backchecker"], "survey_key__BCCL").select("survey_id", "column_name", F.col("team (Survey)").alias("team_survey"), F.col("backchecker (Backcheck)").alias("backchecker_backcheck")),
    f"SELECT p.survey_id, column_name, s.team AS team_survey, v.backchecker AS backchecker_backcheck FROM {PAIRS} p JOIN survey s ON s.survey_key = p.survey_id JOIN visits v ON v.survey_id = p.survey_id WHERE status = 'mismatch'")
_moved = lambda t: t.gps.withColumns({"latitude": F.col("latitude") + 1e-3 * (F.col("survey_key") % 3), "longitude": F.col("longitude")}).where("survey_key % 2 = 0")
HAVERSINE = "2 * 6371008.8 * asin(sqrt(least(1.0, pow(sin(radians({b} - {a}) / 2), 2) + cos(radians({a})) * cos(radians({b})) * pow(sin(radians({d} - {c}) / 2), 2))))"
PAIRED = f"(SELECT survey_key, a.latitude AS lat1, a.longitude AS lon1, b.latitude AS lat2, b.longitude AS lon2 FROM gps a JOIN (SELECT survey_key, latitude + 1e-3 * (survey_key % 3) AS latitude, longitude FROM gps WHERE survey_key % 2 = 0) b USING (survey_key) WHERE a.latitude IS NOT NULL)"
DIST = HAVERSINE.format(a="lat1", b="lat2", c="lon1", d="lon2")
#: Vincenty's iteration as a recursion, a row a pair and round.
ELLIPSOID = f"""WITH RECURSIVE k AS (SELECT survey_key, sin(atan((1 - f) * tan(radians(lat1)))) AS s1, cos(atan((1 - f) * tan(radians(lat1)))) AS c1, sin(atan((1 - f) * tan(radians(lat2)))) AS s2, cos(atan((1 - f) * tan(radians(lat2)))) AS c2, radians(lon2 - lon1) AS span, f
    FROM {PAIRED}, (SELECT 1 / 298.257223563::DOUBLE AS f)),
  i AS (SELECT survey_key, 0 AS n, span AS x, 1e0 AS moved FROM k
    UNION ALL SELECT survey_key, n, new, abs(new - x) FROM (SELECT *, span + (1 - c) * f * a * (atan2(s, co) + c * s * (m + c * co * (2 * m * m - 1))) AS new
      FROM (SELECT *, f / 16 * r * (4 + f * (4 - 3 * r)) AS c FROM (SELECT *, CASE WHEN r = 0 THEN 0 ELSE co - 2 * s1 * s2 / r END AS m FROM (SELECT *, 1 - a * a AS r
      FROM (SELECT *, CASE WHEN s = 0 THEN 0 ELSE c1 * c2 * sin(x) / s END AS a FROM (SELECT k.*, n + 1 AS n, x, sqrt(pow(c2 * sin(x), 2) + pow(c1 * s2 - s1 * c2 * cos(x), 2)) AS s, s1 * s2 + c1 * c2 * cos(x) AS co
      FROM i JOIN k USING (survey_key) WHERE moved >= 1e-12 AND n < 30))))))),
  l AS (SELECT survey_key, x FROM i WHERE moved < 1e-12),
  p AS (SELECT *, sqrt(pow(c2 * sin(x), 2) + pow(c1 * s2 - s1 * c2 * cos(x), 2)) AS s, s1 * s2 + c1 * c2 * cos(x) AS co FROM k JOIN l USING (survey_key)),
  q AS (SELECT *, 1 - pow(CASE WHEN s = 0 THEN 0 ELSE c1 * c2 * sin(x) / s END, 2) AS r, 6378137.0::DOUBLE * (1 - f) AS b FROM p),
  z AS (SELECT *, CASE WHEN r = 0 THEN 0 ELSE co - 2 * s1 * s2 / r END AS m, r * (pow(6378137.0, 2) - b * b) / (b * b) AS u FROM q),
  y AS (SELECT *, 1 + u / 16384 * (4096 + u * (-768 + u * (320 - 175 * u))) AS ba, u / 1024 * (256 + u * (-128 + u * (74 - 47 * u))) AS bb FROM z)
  SELECT survey_key, b * ba * (atan2(s, co) - bb * s * (m + bb / 4 * (co * (2 * m * m - 1) - bb / 6 * m * (4 * s * s - 3) * (4 * m * m - 3)))) AS metres FROM y"""
add("gps_distance_ellipsoid", lambda t: G.gps_pair_merge(t.gps, _moved(t), "survey_key").select("survey_key", geodesic(F.col("lat1"), F.col("lon1"), F.col("lat2"), F.col("lon2")).alias("metres")), ELLIPSOID, "metres")
add("gps_pair_merge", lambda t: G.gps_pair_merge(t.gps, _moved(t), "survey_key"), f"SELECT * FROM {PAIRED}", "lat1 lon1 lat2 lon2")
_flags = lambda t: O.outlier_flags(t.survey, ["survey_key"], ["age", "income", "duration"])
LONG = "(SELECT survey_key, enumerator, 'age' AS column_name, age::DOUBLE AS value FROM survey UNION ALL SELECT survey_key, enumerator, 'income', income FROM survey UNION ALL SELECT survey_key, enumerator, 'duration', duration FROM survey)"
IQR = (
    f"(SELECT column_name, count(value) AS n, min(value) AS min, max(value) AS max, avg(value) AS mean, quantile_cont(value, 0.5) AS median, stddev_samp(value) "
    f"AS sd, quantile_cont(value, 0.75) - quantile_cont(value, 0.25) AS iqr, quantile_cont(value, 0.25) - 1.5 * (quantile_cont(value, 0.75) - quantile_cont(value, "
    f"0.25)) AS lower, quantile_cont(value, 0.75) + 1.5 * (quantile_cont(value, 0.75) - quantile_cont(value, 0.25)) AS upper FROM {LONG} GROUP BY column_name)"
)
REASON = "CASE WHEN value < lower THEN 'below lower bound ' || printf('%.2f', lower) WHEN value > upper THEN 'above upper bound ' || printf('%.2f', upper) ELSE 'no outlier' END"
FLAGS = f"(SELECT survey_key, enumerator, column_name, value, n, min, max, mean, median, sd, iqr, lower, upper, {REASON} AS reason FROM {LONG} JOIN {IQR} USING (column_name) WHERE value IS NOT NULL)"
STATS = "min max mean median sd iqr lower upper"
add("outlier_admin_join", lambda t: O.outlier_admin_join(_flags(t), t.survey, "survey_key", ["enumerator"]).select("survey_key", "enumerator", "column_name", "reason"),
    f"SELECT s.survey_key, s.enumerator, column_name, reason FROM survey s LEFT JOIN {FLAGS} f USING (survey_key)")
add("group_stat_merge", lambda t: t.survey.groupBy("team").agg(F.count("*").alias("n"), F.max("survey_date").alias("last_date"), F.avg("duration").alias("mean_duration")), "SELECT team, count(*) AS n, max(survey_date) AS last_date, avg(duration) AS mean_duration FROM survey GROUP BY team", "mean_duration")
DAILY = "(SELECT enumerator, survey_date AS date, count(*) AS submissions FROM survey GROUP BY ALL)"
add("date_enumerator_spine", lambda t: V.date_enumerator_spine(t.survey, "enumerator", "survey_date"),
    f"SELECT enumerator, date, coalesce(submissions, 0) AS submissions, (sum(coalesce(submissions, 0)) OVER (PARTITION BY enumerator ORDER BY date))::BIGINT "
        f"AS cumulative FROM (SELECT DISTINCT enumerator FROM {DAILY}) CROSS JOIN (SELECT DISTINCT date FROM {DAILY}) LEFT JOIN {DAILY} USING (enumerator, date)")
add("anti_duplicates", lambda t: U.anti_duplicates(t.survey.select("survey_id", "survey_key"), "survey_id"), "SELECT survey_id, survey_key FROM (SELECT *, count(*) OVER (PARTITION BY survey_id) AS n FROM survey) WHERE n = 1")
CENTRE = "(SELECT g.*, c.* FROM (SELECT * FROM gps WHERE latitude IS NOT NULL) g JOIN (SELECT cluster AS k, avg(latitude) AS centre_lat, avg(longitude) AS centre_lon, count(*) AS cluster_n FROM gps WHERE latitude IS NOT NULL GROUP BY ALL) c ON g.cluster = c.k)"
FAR = f"(SELECT *, {HAVERSINE.format(a='latitude', b='centre_lat', c='longitude', d='centre_lon')} AS distance FROM {CENTRE})"
add("centroid_attach", lambda t: G.centroid_attach(t.gps, "cluster").select("survey_key", "centre_lat", "centre_lon", "cluster_n"), f"SELECT survey_key, centre_lat, centre_lon, cluster_n FROM {CENTRE}", "centre_lat centre_lon")
SPOTS = "(SELECT DISTINCT latitude AS lat, longitude AS lon FROM gps WHERE latitude IS NOT NULL)"
add("neighbour_join", lambda t: G.neighbour_join(G.places(t.gps), 150.0).agg(F.count("*").alias("pairs"), F.sum("distance").alias("total"), F.max("distance").alias("longest")),
    f"SELECT count(*) AS pairs, sum(d) AS total, max(d) AS longest FROM (SELECT {HAVERSINE.format(a='a.lat', b='b.lat', c='a.lon', d='b.lon')} AS d FROM {SPOTS} a, {SPOTS} b WHERE abs(a.lat - b.lat) < 0.0015 AND abs(a.lon - b.lon) < 0.0015) WHERE d <= 150", "total longest")
add("set1", lambda t: files.union_all([t.survey.select("survey_key", "age"), t.visits.select("survey_key", "backchecker")]), "SELECT survey_key, age, NULL::BIGINT AS backchecker FROM survey UNION ALL SELECT survey_key, NULL, backchecker FROM visits")
add("set2", lambda t: t.survey.select("survey_key", F.col("age").cast("double").alias("x")).unionByName(t.visits.select("survey_key", F.col("income").alias("x"))), "SELECT survey_key, age::DOUBLE AS x FROM survey UNION ALL SELECT survey_key, income FROM visits", "x")
add("distinct_values", lambda t: t.survey.select("region", "team").distinct(), "SELECT DISTINCT region, team FROM survey")
add("set4", lambda t: C.long_form(t.survey, ["survey_key"], ["age", "income"]), "SELECT survey_key, 'age' AS column_name, age::DOUBLE AS value FROM survey UNION ALL SELECT survey_key, 'income', income FROM survey", "value")
add("set5", lambda t: t.survey.groupBy("team").pivot("consent", ["no", "yes"]).agg(F.count(F.lit(1))).fillna(0), "SELECT team, count(*) FILTER (consent = 'no') AS no, count(*) FILTER (consent = 'yes') AS yes FROM survey GROUP BY team")

# Summary, progress

DAY = f"DATE '{AS_OF}'"
_span = lambda a, b: f"count(*) FILTER (survey_date > {a} AND survey_date <= {b})"
_now = {"today": (f"{DAY} - 1", f"{DAY} - 2"), "week": (f"{DAY} - 7", f"{DAY} - 14"), "month": ("DATE '2001-07-01'", "DATE '2001-06-01'")}
add("submission_metrics", lambda t: S.submission_metrics(t.survey, "survey_date", AS_OF),
    "SELECT first_date, last_date, total, today, week, month, " + ", ".join(f"coalesce(({k} - b_{k}) * 100.0::DOUBLE / nullif(b_{k}, 0), 0) AS {k}_change" for k in _now) +
        f" FROM (SELECT min(survey_date) AS first_date, max(survey_date) AS last_date, count(*) AS total, {', '.join(f'{_span(a, DAY)} AS {k}, {_span(b, a)} AS b_{k}' for k, (a, b) in _now.items())} "
        f"FROM survey)", "today_change week_change month_change")
add("submissions_by_date", lambda t: S.submissions_by_date(t.survey, "survey_date"), "SELECT survey_date AS date, count(*) AS submissions FROM survey GROUP BY ALL")
add("progress_metrics", lambda t: S.progress_metrics(t.survey, "survey_date", 20000),
    "SELECT count(*) AS submissions, count(*) * 100.0::DOUBLE / 20000 AS target_pct, count(*) / count(DISTINCT survey_date) AS per_day, count(*) / count(DISTINCT "
    "date_trunc('week', survey_date)) AS per_week, count(*) / count(DISTINCT date_trunc('month', survey_date)) AS per_month FROM survey", "target_pct per_day per_week per_month")
#: One column a month, over all months of the survey.
BETWEEN = ("1995-01-01", "2001-08-31")
_MONTH_NAMES = "January February March April May June July August September October November December".split()


def months(by: str, date: str, what: str, of: str) -> str:
    """what: SQL with {} for the condition of a month."""
    each = [(y, m) for y in range(1995, 2002) for m in range(1, 13) if (y, m) <= (2001, 8)]
    columns = [what.format(f"{date} >= DATE '{y}-{m:02}-01' AND {date} < DATE '{y}-{m:02}-01' + INTERVAL 1 MONTH") + f' AS "{_MONTH_NAMES[m - 1]} {y}"' for y, m in each]
    return f"SELECT {by}, {', '.join(columns)} FROM {of} GROUP BY {by}"


add("progress_by_column", lambda t: S.progress_by_column(t.survey, "survey_date", "region", between=BETWEEN), months("region", "survey_date", "count(*) FILTER ({})", "survey"))
add("data_quality_metrics", lambda t: S.data_quality_metrics(t.survey.select("survey_id", "age", "income"), "survey_id", _flags(t), t.visits.select(F.col("survey_id"))),
    f"SELECT (count(*) - count(DISTINCT survey_id)) * 100.0::DOUBLE / count(*) AS duplicate_pct, (count(*) * 2 - count(age) - count(income)) * 100.0::DOUBLE "
        f"/ (count(*) * 3) AS missing_pct, (SELECT count(*) FILTER (reason <> 'no outlier') * 100.0::DOUBLE / count(*) FROM {FLAGS}) AS outlier_pct, (SELECT count(*) "
        f"FILTER (survey_id IN (SELECT survey_id FROM visits)) * 100.0::DOUBLE / count(*) FROM (SELECT DISTINCT survey_id FROM survey)) AS backcheck_pct FROM survey", "duplicate_pct missing_pct outlier_pct backcheck_pct")
add("progress_summary", lambda t: V.progress_summary(t.survey, 20000), "SELECT count(*) AS submissions, 20000 AS target, count(*) * 100.0::DOUBLE / 20000 AS progress_pct FROM survey", "progress_pct")
add("progress_overtime", lambda t: V.progress_overtime(t.survey, "survey_date", "Week"), "SELECT date_trunc('week', survey_date)::DATE AS period, count(*) AS submissions FROM survey GROUP BY ALL")
add("average_interviews", lambda t: V.average_interviews(V.progress_overtime(t.survey, "survey_date", "Month")),
    "SELECT period, submissions, average, submissions >= average AS reached FROM (SELECT *, avg(submissions) OVER () AS average FROM (SELECT date_trunc('month', "
    "survey_date)::DATE AS period, count(*) AS submissions FROM survey GROUP BY ALL))", "average")
add("consent_completion", lambda t: V.consent_completion(t.survey, "consent", ["yes"], "outcome", ["complete"]), "SELECT count(*) FILTER (consent = 'yes') * 100.0::DOUBLE / count(*) AS consent_pct, count(*) FILTER (outcome = 'complete') * 100.0::DOUBLE / count(*) AS completed_pct FROM survey", "consent_pct completed_pct")
add("attempted_interviews", lambda t: V.attempted_interviews(t.survey, "survey_id", "survey_date", 200).select("survey_id", "attempts", "last_date", "attempt_1", "attempt_2"),
    "SELECT survey_id, count(*) AS attempts, max(survey_date) AS last_date, list_sort(list(survey_date))[1] AS attempt_1, list_sort(list(survey_date))[2] AS attempt_2 FROM survey GROUP BY survey_id")
add("attempt_distribution", lambda t: V.attempt_distribution(t.survey, "survey_id"), "SELECT attempts, ids, ids * 100.0::DOUBLE / sum(ids) OVER () AS pct FROM (SELECT attempts, count(*) AS ids FROM (SELECT count(*) AS attempts FROM survey GROUP BY survey_id) GROUP BY ALL)", "pct")
add("consent_by_unique_id", lambda t: V.consent_by_unique_id(t.survey, "survey_id", "consent"), "SELECT consent, count(DISTINCT survey_id) AS ids FROM survey GROUP BY consent")
add("attempts_per_id", lambda t: V.attempts_per_id(t.survey, "survey_id", "survey_key"), "SELECT attempts, count(*) AS ids FROM (SELECT count(DISTINCT survey_key) AS attempts FROM survey GROUP BY survey_id) GROUP BY ALL")
add("fill_within_id", lambda t: V.fill_within_id(t.survey, "survey_id", "survey_date", ["age", "income"], "survey_key"),
    "SELECT survey_id, coalesce(age, next_age) AS age, coalesce(income, next_income) AS income FROM (SELECT survey_id, age, income, first_value(age IGNORE "
    "NULLS) OVER w AS next_age, first_value(income IGNORE NULLS) OVER w AS next_income, row_number() OVER (PARTITION BY survey_id ORDER BY survey_date, survey_key) "
    "AS nth FROM survey WINDOW w AS (PARTITION BY survey_id ORDER BY survey_date, survey_key ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) WHERE nth = "
    "1", "income")
add("cumulative_submissions", lambda t: V.cumulative_submissions(t.survey, "enumerator", "survey_date"), f"SELECT *, (sum(submissions) OVER (PARTITION BY enumerator ORDER BY date))::BIGINT AS cumulative FROM {DAILY}")

# Missing

add("missing_encode", lambda t: coded(t), "SELECT * FROM coded")
_avg = lambda c: f"avg(({c} > 0)::INT)"
add("missing_summary", lambda t: M.missing_summary(coded(t), CELLS),
    f"SELECT list_sum(s) * 100 / 4 AS mean_missing_pct, len(list_filter(s, lambda x: x = 1)) * 100.0::DOUBLE / 4 AS all_missing_pct, len(list_filter(s, lambda "
    f"x: x > 0)) * 100.0::DOUBLE / 4 AS any_missing_pct, len(list_filter(s, lambda x: x = 0)) * 100.0::DOUBLE / 4 AS none_missing_pct FROM (SELECT [{', '.join(map(_avg, CELLS))}] "
    f"AS s FROM coded)", "mean_missing_pct all_missing_pct any_missing_pct none_missing_pct")
_part = lambda k, test: f"count(*) FILTER (v {test}) AS n_{k}, count(*) FILTER (v {test}) * 100.0::DOUBLE / count(*) AS pct_{k}"
BYCOL = f"(SELECT column_name, {_part('null', '= 1')}, {_part('dont_know', '= 2')}, {_part('refused', '= 3')}, {_part('missing', '> 0')} FROM (UNPIVOT coded ON {', '.join(CELLS)} INTO NAME column_name VALUE v) GROUP BY column_name)"
PCTS = "pct_null pct_dont_know pct_refused pct_missing"
by_column = lambda t: M.missing_by_column(coded(t), CELLS, list(CODES))
add("missing_by_column", by_column, f"SELECT * FROM {BYCOL}", PCTS)
add("missing_by_column_filtered", lambda t: M.missing_by_column_filtered(by_column(t), 5), f"SELECT *, min(pct_missing) OVER () AS least_pct, max(pct_missing) OVER () AS highest_pct FROM {BYCOL} WHERE pct_missing >= 5", PCTS + " least_pct highest_pct")
_any = " + ".join(f"({c} > 0)::INT" for c in CELLS)
add("missing_over_time", lambda t: M.missing_over_time(coded(t), CELLS, "survey_date"), f"SELECT survey_date AS date, sum({_any}) * 100.0::DOUBLE / (count(*) * 4) AS missing_pct FROM coded GROUP BY ALL", "missing_pct")
add("missing_compare", lambda t: M.missing_compare(coded(t), ["age", "income"], "team"),
    "SELECT team, count(*) AS n, count(*) * 100.0::DOUBLE / sum(count(*)) OVER () AS pct_rows, avg((age > 0)::INT) * 100 AS pct_age, avg((income > 0)::INT) "
    "* 100 AS pct_income FROM coded GROUP BY team", "pct_rows pct_age pct_income")
add("nullity_correlation", lambda t: M.nullity_correlation(coded(t), ["age", "income", "children"]), " UNION ALL ".join(f"SELECT '{b}' AS column_1, '{a}' AS column_2, corr(({a} > 0)::INT, ({b} > 0)::INT) AS correlation FROM coded" for a, b in (("age", "income"), ("age", "children"), ("income", "children"))), "correlation")
add("partially_missing_columns", lambda t: M.partially_missing_columns(coded(t), CELLS), f"SELECT column_name FROM {BYCOL} WHERE pct_missing > 0 AND pct_missing < 100")
add("nullity_matrix", lambda t: M.nullity_matrix(coded(t), CELLS, ["survey_key"]), f"SELECT survey_key, {', '.join(f'({c} > 0)::INT AS {c}' for c in CELLS)} FROM coded")

# Duplicates

add("id_duplicates", lambda t: U.id_duplicates(t.survey.select("survey_key", "age"), "age"),
    "SELECT survey_key, age, CASE WHEN age IS NULL THEN 0 ELSE n END AS duplicate_count, CASE WHEN age IS NULL THEN 0 ELSE n END * 100.0::DOUBLE / total AS "
    "duplicate_pct FROM (SELECT *, count(*) OVER (PARTITION BY age) AS n, count(*) OVER () AS total FROM survey) WHERE n > 1", "duplicate_pct")
DUP = "SELECT survey_key, {c}, CASE WHEN {c} IS NULL THEN 0 ELSE n END AS duplicate_count FROM (SELECT *, count(*) OVER (PARTITION BY {c}) AS n FROM survey {w}) WHERE n > 1"
add("column_duplicates", lambda t: U.column_duplicates(t.survey, "income", ["survey_key"]), DUP.format(c="income", w=""), "income")
add("nonblank_duplicates", lambda t: U.nonblank_duplicates(t.survey, "note", ["survey_key"]), DUP.format(c="note", w="WHERE note <> ''"))
add("duplicate_statistics", lambda t: U.duplicate_statistics(t.survey, ["age", "income", "survey_key"]), "SELECT count(*) AS columns_checked, sum(n)::BIGINT AS duplicate_rows, count(*) FILTER (n > 0) AS columns_with, count(*) FILTER (n = 0) AS columns_without FROM (" + " UNION ALL ".join(f"SELECT coalesce(sum(n), 0) AS n FROM (SELECT count(*) AS n FROM survey GROUP BY {c} HAVING count(*) > 1)" for c in ("age", "income", "survey_key")) + ")")
add("id_duplicate_metrics", lambda t: U.id_duplicate_metrics(t.survey, "age", t.survey.where("survey_key % 3 = 0")),
    "SELECT (SELECT sum(n) FROM (SELECT count(*) AS n FROM survey WHERE age IS NOT NULL GROUP BY age HAVING n > 1))::BIGINT AS duplicate_rows, (SELECT count(*) "
    "FROM survey WHERE age IS NULL) AS missing_id, (SELECT count(*) FROM (SELECT age FROM survey WHERE age IS NOT NULL GROUP BY age HAVING count(*) > 1 EXCEPT "
    "SELECT age FROM survey WHERE survey_key % 3 = 0 GROUP BY age HAVING count(*) > 1)) AS resolved")
add("dedupe_keep", lambda t: U.dedupe_keep(t.survey.select("survey_id", "survey_key", "survey_date"), "survey_id", "last", ["survey_date", "survey_key"]), "SELECT survey_id, survey_key, survey_date FROM (SELECT *, row_number() OVER (PARTITION BY survey_id ORDER BY survey_date DESC, survey_key DESC) AS k FROM survey) WHERE k = 1")
add("count_over", lambda t: U.count_over(t.survey.select("survey_key", "age"), "age"), "SELECT survey_key, age, CASE WHEN age IS NULL THEN 0 ELSE count(*) OVER (PARTITION BY age) END AS count FROM survey")
add("is_duplicated", lambda t: U.is_duplicated(t.survey.select("survey_key", "survey_id"), "survey_id"), "SELECT survey_key, survey_id, count(*) OVER (PARTITION BY survey_id) > 1 AS is_duplicated FROM survey")

# Outliers

add("outlier_stats", lambda t: O.outlier_stats(t.survey, ["age", "income", "duration"]), f"SELECT * FROM {IQR}", STATS)
add("outlier_flags", _flags, f"SELECT * EXCLUDE (enumerator) FROM {FLAGS}", "value " + STATS)
POOL = f"(SELECT survey_key, column_name, value, 'all' AS group_name FROM {LONG} WHERE column_name <> 'income')"
add("outlier_flags_grouped", lambda t: O.outlier_flags_grouped(t.survey, ["survey_key"], {"all": ["age", "duration"]}, "sd").select("survey_key", "column_name", "group_name", "value", "lower", "upper", "reason"),
    f"SELECT survey_key, column_name, group_name, value, lower, upper, {REASON} AS reason FROM {POOL} JOIN (SELECT group_name, avg(value) - 3 * stddev_samp(value) "
        f"AS lower, avg(value) + 3 * stddev_samp(value) AS upper FROM {POOL} GROUP BY group_name) USING (group_name) WHERE value IS NOT NULL", "value lower upper")
BROKEN = (
    "(SELECT survey_key, 'age' AS column_name, age::DOUBLE AS value, list_filter([CASE WHEN age < 0 THEN 'hard_min' END, CASE WHEN age < 5 THEN 'soft_min' "
    "END, CASE WHEN age > 70 THEN 'soft_max' END, CASE WHEN age > 85 THEN 'hard_max' END], lambda x: x IS NOT NULL) AS b FROM survey UNION ALL SELECT survey_key, "
    "'income', income, list_filter([CASE WHEN income < 2000 THEN 'soft_min' END, CASE WHEN income > 1000000 THEN 'hard_max' END], lambda x: x IS NOT NULL) "
    "FROM survey)"
)
violations = lambda t: O.constraint_violations(t.survey, ["survey_key"], BOUNDS)
add("constraint_violations", lambda t: violations(t).withColumn("breached", F.array_join("breached", ",")), f"SELECT survey_key, column_name, value, b[1] AS reason, list_aggregate(b, 'string_agg', ',') AS breached FROM {BROKEN} WHERE len(b) > 0", "value")
add("constraint_metrics", lambda t: O.constraint_metrics(violations(t), 2), "SELECT 2 AS columns_checked, count(*) AS total, " + ", ".join(f"count(*) FILTER (b[1] = '{k}') AS {k}" for k in ("hard_min", "soft_min", "soft_max", "hard_max")) + f" FROM {BROKEN} WHERE len(b) > 0")
add("violation_type", lambda t: violations(t).select("survey_key", "column_name", O.violation_type("reason").alias("kind")),
    f"SELECT survey_key, column_name, CASE b[1] WHEN 'hard_min' THEN 'Hard Min' WHEN 'soft_min' THEN 'Soft Min' WHEN 'soft_max' THEN 'Soft Max' ELSE 'Hard Max' "
    f"END AS kind FROM {BROKEN} WHERE len(b) > 0")
add("outlier_metrics", lambda t: O.outlier_metrics(O.outlier_flags(t.survey, ["survey_key", "enumerator"], ["age", "income", "duration"]), "enumerator"),
    f"SELECT count(DISTINCT column_name) AS columns_checked, count(DISTINCT column_name) FILTER (reason <> 'no outlier') AS columns_with, count(*) FILTER (reason "
    f"<> 'no outlier') AS total, count(DISTINCT enumerator) FILTER (reason <> 'no outlier') AS enumerators_with FROM {FLAGS}")
add("column_outlier_summary", lambda t: O.column_outlier_summary(_flags(t), "survey_key"), f"SELECT column_name, count(*) AS n_values, count(*) FILTER (reason <> 'no outlier') AS n_outliers, {', '.join(f'max({c}) AS {c}' for c in STATS.split())} FROM {FLAGS} GROUP BY column_name", STATS)
add("inspect_column", lambda t: O.inspect_column(t.survey, "income"),
    "SELECT count(income) AS n, count(*) - count(income) AS nulls, avg(income) AS mean, stddev_samp(income) AS sd, min(income) AS min, quantile_cont(income, "
    "0.25) AS q1, quantile_cont(income, 0.5) AS median, quantile_cont(income, 0.75) AS q3, max(income) AS max FROM survey", "mean sd min q1 median q3 max")


def _grouped(t: Tables) -> DataFrame:
    df = t.survey.select("survey_key", F.col("age").alias("item_1"), F.col("duration").alias("item_2"), "income")
    return O.outlier_flags_grouped(df, ["survey_key"], O.variable_groups(df.columns)).select("survey_key", "column_name", "group_name", "reason")


GROUPED = "(SELECT survey_key, replace(replace(column_name, 'age', 'item_1'), 'duration', 'item_2') AS column_name, 'item' AS group_name, value FROM {}) ".format(POOL)
add("variable_groups", _grouped,
    f"SELECT survey_key, column_name, group_name, {REASON} AS reason FROM {GROUPED}, (SELECT quantile_cont(value, 0.25) - 1.5 * (quantile_cont(value, 0.75) "
    f"- quantile_cont(value, 0.25)) AS lower, quantile_cont(value, 0.75) + 1.5 * (quantile_cont(value, 0.75) - quantile_cont(value, 0.25)) AS upper FROM {POOL}) "
    f"WHERE value IS NOT NULL")

# Enumerators

flagged = lambda t: E.consent_outcome_flags(t.survey, "consent", ["yes"], "outcome", ["complete"])
add("consent_outcome_flags", lambda t: flagged(t).select("survey_key", "consent_flag", "outcome_flag"), "SELECT survey_key, (consent = 'yes')::INT AS consent_flag, (outcome = 'complete')::INT AS outcome_flag FROM survey")
add("enumerator_overview", lambda t: E.enumerator_overview(t.survey, "survey_date", "enumerator", AS_OF, "team"),
    f"SELECT *, active * 100.0::DOUBLE / enumerators AS active_pct FROM (SELECT count(*) AS submissions, count(DISTINCT enumerator) AS enumerators, count(DISTINCT "
    f"team) AS teams, count(DISTINCT enumerator) FILTER (survey_date > {DAY} - 7 AND survey_date <= {DAY}) AS active FROM survey), (SELECT min(submissions) "
    f"AS min_per_day, max(submissions) AS max_per_day, floor(avg(submissions))::BIGINT AS mean_per_day FROM {DAILY})", "active_pct")
_share = lambda test: f"avg(({' + '.join(f'({c} {test})::INT' for c in CELLS)}) * 100.0::DOUBLE / 4)"
add("enumerator_missing", lambda t: E.enumerator_missing(t.survey, CODES, ["enumerator"], CELLS), f"SELECT enumerator, {_share('= 1')} AS pct_null, {_share('= 2')} AS pct_dont_know, {_share('= 3')} AS pct_refused, {_share('> 0')} AS pct_missing FROM coded GROUP BY enumerator", PCTS)
add("enumerator_summary", lambda t: E.enumerator_summary(flagged(t), "survey_date", ["enumerator"], AS_OF, "formversion", "duration", CODES, CELLS),
    f"SELECT s.enumerator, min(s.survey_date) AS first_date, max(s.survey_date) AS last_date, count(*) AS submissions, count(DISTINCT s.survey_date) AS active_days, "
        f"count(*) FILTER (s.survey_date = {DAY}) AS today, count(*) FILTER (s.survey_date BETWEEN date_trunc('week', {DAY}) AND {DAY}) AS this_week, count(*) FILTER "
        f"(s.survey_date BETWEEN date_trunc('month', {DAY}) AND {DAY}) AS this_month, {_share('> 0').replace('(age', '(c.age').replace('(income', '(c.income').replace('(children', '(c.children').replace('(region', '(c.region')} "
        f"AS pct_missing, min(duration) AS min_duration, avg(duration) AS mean_duration, quantile_cont(duration, 0.5) AS median_duration, max(duration) AS max_duration, "
        f"count(DISTINCT formversion) AS form_versions, max(formversion) AS latest_form, count(*) FILTER (formversion < newest) AS outdated_forms, avg((consent "
        f"= 'yes')::INT) AS mean_consent, avg((outcome = 'complete')::INT) AS mean_completion FROM (SELECT *, max(formversion) OVER (PARTITION BY survey_date) AS "
        f"newest FROM survey) s JOIN coded c USING (survey_key) GROUP BY s.enumerator", "pct_missing mean_duration median_duration mean_consent mean_completion")
add("enumerator_productivity", lambda t: E.staff_productivity(t.survey, "survey_date", ["enumerator"], "Month", between=BETWEEN), months("enumerator", "survey_date", "count(*) FILTER ({})", "survey"))
_stats = {"count": "count({c})", "min": "min({c})", "mean": "avg({c})", "median": "quantile_cont({c}, 0.5)", "max": "max({c})", "std": "stddev_samp({c})", "p25": "quantile_cont({c}, 0.25)", "p75": "quantile_cont({c}, 0.75)"}
add("enumerator_statistics", lambda t: E.enumerator_statistics(t.survey, ["enumerator"], ["income"]), "SELECT enumerator, " + ", ".join(f"{e.format(c='income')} AS income_{k}" for k, e in _stats.items()) + " FROM survey GROUP BY enumerator", " ".join(f"income_{k}" for k in _stats if k != "count"))
def _rounded_months(df: DataFrame) -> DataFrame:
    return df.select("enumerator", *[(F.round(F.col(c), 6) + 0.0).alias(c) for c in df.columns if c != "enumerator"])


add("enumerator_statistics_overtime", lambda t: _rounded_months(E.enumerator_statistics_overtime(t.survey, "survey_date", ["enumerator"], "income", "mean", between=BETWEEN)),
    months("enumerator", "survey_date", "round(avg(income) FILTER ({}), 6) + 0.0", "survey"))
add("enumerator_duration_zscore", lambda t: E.enumerator_duration_zscore(t.survey, "enumerator", "duration"), "SELECT enumerator, m AS mean_duration, (m - avg(m) OVER ()) / stddev_samp(m) OVER () AS zscore FROM (SELECT enumerator, avg(duration) AS m FROM survey GROUP BY enumerator)", "mean_duration zscore")
add("enumerator_consent_rate", lambda t: E.enumerator_consent_rate(t.survey, "enumerator", "consent", ["yes"]),
    "SELECT enumerator, count(*) AS persons, count(*) FILTER (consent = 'yes') AS consenting, count(*) FILTER (consent = 'yes') * 100.0::DOUBLE / count(*) "
    "AS consent_pct FROM survey GROUP BY enumerator", "consent_pct")
add("interviews_per_enumerator_day", lambda t: E.interviews_per_enumerator_day(t.survey, "enumerator", "survey_date"),
    f"SELECT enumerator, sum(submissions)::BIGINT AS interviews, count(*) AS days, avg(submissions) AS per_day, (SELECT avg(submissions) FROM {DAILY}) AS overall_per_day "
    f"FROM {DAILY} GROUP BY enumerator", "per_day overall_per_day")
add("daily_max_over", lambda t: E.daily_max_over(t.survey.select("survey_key", "survey_date", "formversion"), "survey_date", "formversion"), "SELECT survey_key, survey_date, formversion, max(formversion) OVER (PARTITION BY survey_date) AS daily_max FROM survey")
add("running_total", lambda t: E.running_total(t.survey.select("survey_key", "survey_id", "duration"), "survey_id", "survey_key", "duration"), "SELECT survey_key, survey_id, duration, (sum(duration) OVER (PARTITION BY survey_id ORDER BY survey_key))::BIGINT AS running_total FROM survey")
add("fill_over", lambda t: V.fill_over(t.survey.select("survey_id", "survey_key", "age"), "survey_id", ["survey_key"], ["age"]),
    "SELECT survey_id, survey_key, coalesce(last_value(age IGNORE NULLS) OVER (PARTITION BY survey_id ORDER BY survey_key ROWS BETWEEN UNBOUNDED PRECEDING "
    "AND CURRENT ROW), first_value(age IGNORE NULLS) OVER (PARTITION BY survey_id ORDER BY survey_key ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS "
    "age FROM survey")
add("row_index", lambda t: C.dense_index(t.survey.select("survey_key"), ["survey_key"]), "SELECT survey_key, row_number() OVER (ORDER BY survey_key) - 1 AS index FROM survey")
add("first_or_last_per_key", lambda t: U.dedupe_keep(t.survey.select("team", "survey_key"), "team", "first", ["survey_key"]), "SELECT team, min(survey_key) AS survey_key FROM survey GROUP BY team")

# Descriptive

_mid = lambda c, q: f"(list_sort(list({c}) FILTER ({c} IS NOT NULL))[floor((count({c}) - 1) * {q})::BIGINT + 1] + list_sort(list({c}) FILTER ({c} IS NOT NULL))[ceil((count({c}) - 1) * {q})::BIGINT + 1]) / 2"
_prof = lambda n, c: f"SELECT '{n}' AS column_name, count({c}) AS n, count(*) - count({c}) AS missing, round((count(*) - count({c})) * 100.0::DOUBLE / count(*), 1) AS missing_pct, round(avg({c}), 4) AS mean, round({_mid(c, 0.5)}, 4) AS median, round(stddev_samp({c}), 4) AS std, round(min({c}), 4) AS min, round(max({c}), 4) AS max, round({_mid(c, 0.25)}, 4) AS q1, round({_mid(c, 0.75)}, 4) AS q3, round(avg(pow(({c} - m) / d, 3)), 4) AS skewness, round(avg(pow(({c} - m) / d, 4)) - 3, 4) AS kurtosis FROM survey, (SELECT avg({c}) AS m, stddev_pop({c}) AS d FROM survey)"
add("summary_stats", lambda t: D.summary_stats(t.survey, ["age", "duration"]), f"{_prof('age', 'age::DOUBLE')} UNION ALL {_prof('duration', 'duration::DOUBLE')}")
add("histogram", lambda t: D.histogram(t.survey, "duration", 20),
    "SELECT b::INT AS bin, a + b * w AS low, a + (b + 1) * w AS high, coalesce(n, 0) AS n FROM (SELECT min(duration)::DOUBLE AS a, (max(duration) - min(duration)) "
    "/ 20.0::DOUBLE AS w FROM survey), (SELECT unnest(generate_series(0, 19)) AS b) LEFT JOIN (SELECT least(floor((duration - a) / w), 19) AS b, count(*) AS "
    "n FROM survey, (SELECT min(duration)::DOUBLE AS a, (max(duration) - min(duration)) / 20.0::DOUBLE AS w FROM survey) GROUP BY ALL) USING (b)", "low high")
add("value_counts", lambda t: D.value_counts(t.survey, "age", 10), "SELECT age AS value, count(*) AS n, round(count(*) * 100.0::DOUBLE / sum(count(*)) OVER (), 1) AS pct FROM survey GROUP BY age ORDER BY n DESC, age NULLS LAST LIMIT 10", "pct")
add("top_n_values", lambda t: D.value_counts(t.survey, "survey_id", 5).select("value", "n"), "SELECT survey_id AS value, count(*) AS n FROM survey GROUP BY survey_id ORDER BY n DESC, value LIMIT 5")
add("sort_mixed", lambda t: t.survey.groupBy("team", "region").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "team", "region"), "SELECT team, region, count(*) AS n FROM survey GROUP BY ALL ORDER BY n DESC, team, region")
add("sample_values", lambda t: D.sample_values(t.survey, "region"), "SELECT DISTINCT region AS value FROM survey ORDER BY 1 LIMIT 5")
_types = {"age": "bigint", "children": "bigint", "region": "string", "survey_key": "bigint"}
add("codebook", lambda t: D.codebook(t.survey, list(_types)), " UNION ALL ".join(
    f"SELECT '{c}' AS column_name, '{k}' AS type, count({c}) AS n, count(*) - count({c}) AS missing, count(DISTINCT {c}) + max(({c} IS NULL)::INT) AS n_distinct, "
    f"array_to_string(list_sort(list(DISTINCT {c}::VARCHAR) FILTER ({c} IS NOT NULL))[:5], ', ') AS samples FROM survey" for c, k in _types.items()))
add("documents_value_counts", lambda t: D.value_counts(t.read("documents").join(t.read("labels"), "doc_id", "left"), "quality", 5), "SELECT quality AS value, count(*) AS n, round(count(*) * 100.0::DOUBLE / sum(count(*)) OVER (), 1) AS pct FROM documents LEFT JOIN labels USING (doc_id) GROUP BY quality", "pct")

# GPS

_text_gps = lambda t: t.gps.select("survey_key", F.when(F.col("survey_key") % 3 == 0, F.concat_ws(",", F.col("survey_key") % 90, "cluster")).when(F.col("survey_key") % 3 == 1, F.concat_ws(" ", F.col("survey_key") % 90, "cluster", F.lit("0"), F.lit("4"))).otherwise("bad").alias("gps"))
add("parse_gps", lambda t: G.parse_gps(_text_gps(t), "gps").drop("gps"), "SELECT survey_key, CASE WHEN survey_key % 3 < 2 THEN (survey_key % 90)::DOUBLE END AS latitude, CASE WHEN survey_key % 3 < 2 THEN cluster::DOUBLE END AS longitude FROM gps")
add("gps_distance", lambda t: G.gps_compare(t.gps, _moved(t), "survey_key").select("survey_key", "distance"), f"SELECT survey_key, {DIST} AS distance FROM {PAIRED}", "distance")
add("gps_compare", lambda t: G.gps_compare_metrics(G.gps_compare(t.gps, _moved(t), "survey_key")), f"SELECT count(*) AS total, count(*) FILTER (d > 100) AS flagged, avg(d) AS mean_distance, max(d) AS max_distance FROM (SELECT {DIST} AS d FROM {PAIRED})", "mean_distance max_distance")
FENCED = f"(SELECT f.*, cluster_n >= 4 AND q3 > q1 AND (distance > q3 + 1.5 * (q3 - q1) OR distance < q1 - 1.5 * (q3 - q1)) AS is_outlier FROM {FAR} f JOIN (SELECT cluster AS k2, quantile_cont(distance, 0.25) AS q1, quantile_cont(distance, 0.75) AS q3 FROM {FAR} GROUP BY cluster) ON cluster = k2)"
_cluster = lambda t: G.gps_cluster_outliers(t.gps.withColumnRenamed("cluster", "area"), "area")
add("gps_cluster_outliers", lambda t: _cluster(t).select("survey_key", "cluster", "distance", "is_outlier"), f"SELECT survey_key, cluster::VARCHAR AS cluster, distance, is_outlier FROM {FENCED}", "distance")
add("gps_outlier_metrics", lambda t: G.gps_outlier_metrics(_cluster(t)), f"SELECT count(*) AS points, count(*) FILTER (is_outlier) AS outliers, count(*) FILTER (is_outlier) * 100.0::DOUBLE / count(*) AS outlier_pct FROM {FENCED}", "outlier_pct")
add("gps_accuracy_stats", lambda t: G.gps_accuracy_stats(t.gps, "gps_accuracy", "cluster"),
    "SELECT cluster, count(gps_accuracy) AS n, min(gps_accuracy) AS min, avg(gps_accuracy) AS mean, max(gps_accuracy) AS max, stddev_samp(gps_accuracy) AS "
    "std, quantile_cont(gps_accuracy, 0.5) AS median, quantile_cont(gps_accuracy, 0.25) AS p25, quantile_cont(gps_accuracy, 0.75) AS p75, quantile_cont(gps_accuracy, "
    "0.95) AS p95 FROM gps GROUP BY cluster", "min mean max std median p25 p75 p95")
add("gps_validity", lambda t: G.gps_validity(t.gps, "gps_accuracy"),
    "SELECT count(*) AS points, count(*) FILTER (latitude IS NULL OR longitude IS NULL) AS missing, count(*) FILTER (abs(latitude) > 90 OR abs(longitude) > "
    "180) AS out_of_range, count(*) FILTER (gps_accuracy > 10) AS low_accuracy, (SELECT coalesce(sum(n), 0) FROM (SELECT count(*) AS n FROM gps WHERE latitude "
    "IS NOT NULL GROUP BY latitude, longitude HAVING n > 1))::BIGINT AS duplicate_places FROM gps")
add("gps_distance_outliers_global", lambda t: G.gps_distance_outliers_global(t.gps, "cluster").select("survey_key", "distance_km", "is_outlier"),
    f"SELECT survey_key, distance / 1000 AS distance_km, distance > q3 + 1.5 * (q3 - q1) OR distance < q1 - 1.5 * (q3 - q1) AS is_outlier FROM {FAR}, (SELECT "
    f"quantile_cont(distance, 0.25) AS q1, quantile_cont(distance, 0.75) AS q3 FROM {FAR})", "distance_km")
NEAREST = (
    f"(SELECT a.cluster, a.latitude, a.longitude, min({HAVERSINE.format(a='a.latitude', b='b.latitude', c='a.longitude', d='b.longitude')}) AS d FROM (SELECT "
    f"DISTINCT cluster, latitude, longitude FROM gps) a JOIN (SELECT DISTINCT cluster, latitude, longitude FROM gps) b ON a.cluster = b.cluster AND (a.latitude "
    f"<> b.latitude OR a.longitude <> b.longitude) GROUP BY ALL)"
)
add("gps_too_clustered", lambda t: G.gps_too_clustered(t.gps, "survey_key", "cluster", 500.0),
    f"SELECT survey_key, g.cluster, CASE WHEN d <= 500 THEN d END AS nearest, coalesce(d < 500, false) AS too_clustered FROM gps g LEFT JOIN {NEAREST} n ON "
    f"g.cluster = n.cluster AND g.latitude = n.latitude AND g.longitude = n.longitude WHERE g.latitude IS NOT NULL", "nearest")
#: All pairs of places; a place of n rows counts n times, itself less one; then the factor step by step.
LOF = f"""WITH p AS (SELECT latitude AS lat, longitude AS lon, count(*) AS n FROM gps WHERE latitude IS NOT NULL GROUP BY ALL),
  d AS (SELECT a.lat, a.lon, b.lat AS lat_b, b.lon AS lon_b, b.n - ((a.lat = b.lat AND a.lon = b.lon)::INT) AS m, {HAVERSINE.format(a='a.lat', b='b.lat', c='a.lon', d='b.lon')} AS d FROM p a, p b),
  r AS (SELECT *, sum(m) OVER (PARTITION BY lat, lon ORDER BY round(d, 6), lat_b, lon_b ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto FROM d WHERE m > 0),
  k AS (SELECT lat, lon, lat_b, lon_b, d, least(m, 10 - (upto - m)) AS take FROM r WHERE upto - m < 10),
  h AS (SELECT lat, lon, max(d) AS far FROM k GROUP BY ALL),
  l AS (SELECT k.lat, k.lon, 1 / (sum(greatest(k.d, h.far) * take) / sum(take) + 1e-10) AS lrd FROM k JOIN h ON h.lat = k.lat_b AND h.lon = k.lon_b GROUP BY ALL),
  f AS (SELECT k.lat, k.lon, sum(l.lrd * take) / sum(take) AS mean FROM k JOIN l ON l.lat = k.lat_b AND l.lon = k.lon_b GROUP BY ALL),
  o AS (SELECT survey_key, mean / lrd AS lof FROM gps JOIN f ON f.lat = latitude AND f.lon = longitude JOIN l ON l.lat = latitude AND l.lon = longitude)
  SELECT survey_key, lof, round(lof, 9) > {{cut}} AS is_outlier FROM o"""
add("gps_lof_outliers", lambda t: G.gps_lof_outliers(t.gps, "survey_key", 10), LOF.format(cut="(SELECT round(quantile_cont(lof, 0.9), 9) FROM o)"), "lof")
add("gps_lof_outliers_auto", lambda t: G.gps_lof_outliers(t.gps, "survey_key", 10, "auto"), LOF.format(cut="1.5"), "lof")
add("gps_kmeans_areas", lambda t: G.gps_kmeans_areas(t.gps, 4).select("survey_key", "area"))

# Back-checks

add("normalise_text", lambda t: t.visits.select("survey_key", B.normalise_text(F.col("region"), TEXT).alias("region")), "SELECT survey_key, regexp_replace(trim(lower(region)), '[^\\w\\s]', '', 'g') AS region FROM visits")
add("match_status", lambda t: compared(t).groupBy("column_name", "status").agg(F.count("*").alias("n")), f"SELECT column_name, status, count(*) AS n FROM {PAIRS} GROUP BY ALL")
add("numeric_difference", lambda t: compared(t).where("difference IS NOT NULL").select("survey_id", "column_name", "difference", "within_range"), f"SELECT survey_id, column_name, s - b AS difference, within_range FROM {PAIRS} WHERE s - b IS NOT NULL", "difference")
def _area(density: str, to: str) -> str:
    """SQL: the integral of a density of x from 0 to a value, by Simpson's rule."""
    x = f"({to}) * i / 1000.0"
    return f"list_sum(list_transform(generate_series(0, 1000), lambda i: (CASE WHEN i IN (0, 1000) THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END) * {density.replace('x', x)})) * ({to}) / 3000.0"


_normal_p = lambda z: f"1 - 2 * {_area('exp(-pow(x, 2) / 2) / sqrt(2 * pi())'.replace('exp', 'EXP'), f'least(abs({z}), 9)')}"
_student_p = lambda t, df: f"1 - 2 * EXP(lgamma(({df} + 1) / 2.0) - lgamma({df} / 2.0)) / sqrt({df} * pi()) * {_area(f'pow(1 + pow(x, 2) / ({df}), -({df} + 1) / 2.0)', f'least(abs({t}), 50)')}"
add("paired_ttest", lambda t: B.paired_ttest(compared(t)),
    f"SELECT *, {_student_p('t', '(n - 1)')} AS p FROM (SELECT column_name, count(*) AS n, avg(s - b) AS mean_difference, avg(s - b) / (stddev_samp(s - b) / "
    f"sqrt(count(*))) AS t FROM {PAIRS} WHERE s - b IS NOT NULL GROUP BY column_name)", "mean_difference t p")


def _binary(t: Tables) -> DataFrame:
    one = compared(t).where("column_name = 'children'")
    return one.withColumns({c: (F.col(c).cast("int") > 3).cast("int").cast("string") for c in ("survey_value", "backcheck_value")})


add("proportion_test", lambda t: B.proportion_test(_binary(t)),
    f"SELECT *, {_normal_p('z')} AS p FROM (SELECT column_name, n, (p1 - p2) / sqrt((p1 * (1 - p1) + p2 * (1 - p2)) / n) AS z FROM (SELECT column_name, count(*) "
    f"AS n, avg((s > 3)::INT) AS p1, avg((b > 3)::INT) AS p2 FROM {PAIRS} WHERE column_name = 'children' AND s IS NOT NULL AND b IS NOT NULL GROUP BY column_name))", "z p")
def _spread(t: Tables) -> DataFrame:
    return compared(t).where("column_name = 'children'").withColumn("survey_value", (F.col("survey_value").cast("long") - 1 + F.col("survey_id") % 3).cast("string"))


#: Ranks of the differences of groups g, and their sums.
RANKED = """(SELECT *, sum(n) OVER (PARTITION BY g ORDER BY size) - n + (n + 1) / 2 AS rank FROM (
  SELECT {g} AS g, abs(s - b - 1 + survey_id % 3) AS size, count(*) AS n, count(*) FILTER (s - b - 1 + survey_id % 3 > 0) AS up
  FROM {pairs} WHERE column_name = 'children' AND s - b - 1 + survey_id % 3 <> 0 GROUP BY ALL))"""
SIGNED = """SELECT g AS column_name, n, w, (w - n * (n + 1) / 4) / sqrt(n * (n + 1) * (2 * n + 1) / 24 - ties / 48) AS z
  FROM (SELECT g, sum(n)::DOUBLE::BIGINT AS n, least(sum(rank * up), sum(rank * (n - up))) AS w, sum(pow(n, 3) - n) AS ties FROM {} GROUP BY g)"""
_all_ranks = RANKED.format(g="column_name", pairs=PAIRS)
add("signed_rank_test", lambda t: B.signed_rank_test(_spread(t)).select("column_name", "n", "w", "z", "p"), f"SELECT *, {_normal_p('z')} AS p FROM ({SIGNED.format(_all_ranks)})", "w z p")
_few_ranks = RANKED.format(g="(survey_id // 10 % 173)::VARCHAR", pairs=PAIRS)
#: Few differences, with ties: every choice of signs is tried.
add("signed_rank_test_exact", lambda t: B.signed_rank_test(_spread(t).withColumn("column_name", F.expr("cast(survey_id div 10 % 173 AS string)"))).where("n <= 13").select("column_name", "n", "w", "p"),
    f"""SELECT g AS column_name, n, w, least(1.0, 2 * count(*) FILTER (total <= w) / count(*)) AS p FROM (
      SELECT g, n, w, signs, coalesce(sum(rank) FILTER ((signs >> (i - 1)::INT) & 1 = 1), 0) AS total
      FROM (SELECT column_name AS g, n, w, unnest(generate_series(0, (1 << n::INT) - 1)) AS signs FROM ({SIGNED.format(_few_ranks)}) WHERE n <= 13)
      JOIN (SELECT g, rank, row_number() OVER (PARTITION BY g) AS i FROM (SELECT g, rank, unnest(generate_series(1, n)) FROM {_few_ranks})) USING (g) GROUP BY ALL) GROUP BY ALL""", "w p")


add("reliability", lambda t: B.reliability(compared(t)).withColumn("srv", F.col("srv") / 1e6), f"SELECT column_name, var_samp(s - b) / 2e6 AS srv, 1 - var_samp(s - b) / 2 / var_samp(s) AS reliability FROM {PAIRS} WHERE s - b IS NOT NULL GROUP BY column_name", "srv reliability")
add("backcheck_summary", lambda t: B.backcheck_summary(t.survey, t.visits, "survey_id", "enumerator", "backchecker"),
    "SELECT *, backchecks * 100.0::DOUBLE / surveys AS coverage_pct FROM (SELECT count(*) AS surveys, count(DISTINCT enumerator) AS enumerators FROM survey), "
    "(SELECT count(*) AS backchecks, count(DISTINCT backchecker) AS backcheckers FROM visits)", "coverage_pct")
add("backchecker_productivity", lambda t: E.staff_productivity(t.visits, "backcheck_date", ["backchecker"], "Month", between=BETWEEN), months("backchecker", "backcheck_date", "count(*) FILTER ({})", "visits"))
_rate = lambda k, w: RATES.format(w=w, k=k)
add("staff_backcheck_stats", lambda t: B.staff_backcheck_stats(attached(t), "enumerator", "survey_id"),
    f"SELECT enumerator, backchecks, mean_days, * EXCLUDE (enumerator, backchecks, mean_days) FROM (SELECT enumerator, count(*) AS backchecks, round(avg(backcheck_date::DATE "
        f"- survey_date), 1) AS mean_days FROM (SELECT DISTINCT enumerator, survey_id, survey_date, backcheck_date FROM {PAIRS}) GROUP BY enumerator) JOIN (SELECT "
        f"enumerator, {_rate('', '')}, {_rate('_1', 'category = 1 AND')}, {_rate('_2', 'category = 2 AND')}, {_rate('_3', 'category = 3 AND')} FROM {PAIRS} GROUP "
        f"BY enumerator) USING (enumerator)", "mean_days error_rate error_rate_1 error_rate_2 error_rate_3")
add("column_backcheck_stats", lambda t: B.column_backcheck_stats(compared(t)), f"SELECT column_name, category, {_rate('', '')} FROM {PAIRS} GROUP BY column_name, category", "error_rate")
add("comparison_details", lambda t: B.comparison_details(compared(t), ["income", "region"]).select("survey_id", "column_name", "status"), f"SELECT survey_id, column_name, status FROM {PAIRS} WHERE column_name <> 'children' AND status = 'mismatch'")
add("compare_by_prefix", lambda t: B.compare_by_prefix(B.backcheck_merge(t.survey.withColumn("survey_id", F.col("survey_key")), t.visits, "survey_id").select("enumerator", F.col("region").alias("svy_region"), F.col("region__BCCL").alias("back_region"), F.col("children").alias("svy_children"), F.col("children__BCCL").alias("back_children")), "enumerator"),
    "SELECT variable, enumerator, count(*) FILTER (b IS NOT NULL AND a IS DISTINCT FROM b) * 100.0::DOUBLE / count(b) AS mismatch_pct, count(b) * 100.0::DOUBLE "
        "/ count(*) AS checked_pct FROM (SELECT enumerator, 'region' AS variable, trim(s.region) AS a, trim(v.region) AS b FROM survey s JOIN visits v ON s.survey_key "
        "= v.survey_id UNION ALL SELECT enumerator, 'children', s.children::VARCHAR, v.children::VARCHAR FROM survey s JOIN visits v ON s.survey_key = v.survey_id) "
        "GROUP BY ALL", "mismatch_pct checked_pct")

# Functions of prep steps


def _parts(t: Tables) -> DataFrame:
    return t.survey.select("survey_key", *[f(F.col("survey_date")).alias(k.replace(" ", "_")) for k, f in X.DATE_PARTS.items() if k not in ("hour", "minute", "second")])


add("fun1", _parts,
    "SELECT survey_key, day(survey_date) AS day_of_month, isodow(survey_date) AS day_of_week, dayofyear(survey_date) AS day_of_year, survey_date AS date, weekofyear(survey_date) "
    "AS week, month(survey_date) AS month, year(survey_date) AS year, quarter(survey_date) AS quarter FROM survey")
add("fun1_time", lambda t: t.read("events").select("event_id", *[X.DATE_PARTS[k]("ts").alias(k) for k in ("hour", "minute", "second")]), "SELECT event_id, hour(ts) AS hour, minute(ts) AS minute, second(ts) AS second FROM events")
add("fun2", lambda t: t.survey.select("survey_key", *[f(F.col("income")).cast("double").alias(k) for k, f in X.ROUNDING.items()]), "SELECT survey_key, floor(income) AS floor, ceil(income) AS ceil, round(income) AS round, abs(income) AS absolute FROM survey")
add("fun3", lambda t: t.survey.select("survey_key", *[X.arithmetic("income", k, 3.0).alias(k) for k in ("add", "subtract", "multiply", "divide")]), "SELECT survey_key, income + 3 AS add, income - 3 AS subtract, income * 3 AS multiply, income / 3 AS divide FROM survey", "add subtract multiply divide")
add("fun4", lambda t: t.survey.select("survey_key", F.trim("note").alias("trim"), F.lower("note").alias("lower"), F.upper("note").alias("upper")), "SELECT survey_key, trim(note) AS trim, lower(note) AS lower, upper(note) AS upper FROM survey")
add("fun5", lambda t: prep.transform_column(t.survey.select("survey_key", "note"), "note", "to number"), "SELECT survey_key, TRY_CAST(note AS DOUBLE) AS note FROM survey")
add("fun6", lambda t: prep.transform_column(t.survey.select("survey_key", F.date_format("survey_date", "MMM dd, yyyy").alias("d")), "d", "to date"), "SELECT survey_key, survey_date::TIMESTAMP AS d FROM survey")
add("fun7", lambda t: X.dummies(t.survey.select("survey_key", "consent"), "consent"), "SELECT survey_key, (consent = 'no')::TINYINT AS consent_no, (consent = 'yes')::TINYINT AS consent_yes FROM survey")
add("fun8", lambda t: t.survey.select("survey_key", X.replace_first("region", "[A-Z]", "_").alias("r")), "SELECT survey_key, regexp_replace(region, '[A-Z]', '_') AS r FROM survey")
add("fun9", lambda t: t.survey.select("survey_key", X.substring("region", 2, 5).alias("r")), "SELECT survey_key, region[3:5] AS r FROM survey")
add("fun10", lambda t: t.survey.select("survey_key", X.extract("region", "-(H|L)").alias("r")), "SELECT survey_key, nullif(regexp_extract(region, '-(H|L)', 1), '') AS r FROM survey")
ROW = ("age", "children", "duration")
_list = "list_filter([age, children, duration]::DOUBLE[], lambda x: x IS NOT NULL)"
add("fun11", lambda t: t.survey.select("survey_key", *[X.across(m, ROW).alias(m) for m in ("sum", "mean", "min", "max")]), f"SELECT survey_key, coalesce(list_sum({_list}), 0) AS sum, list_avg({_list}) AS mean, list_min({_list}) AS min, list_max({_list}) AS max FROM survey", "sum mean min max")
add("fun12", lambda t: t.survey.select("survey_key", *[X.across(m, ROW).alias(m) for m in ("median", "std", "var")]), f"SELECT survey_key, list_median({_list}) AS median, list_stddev_samp({_list}) AS std, list_var_samp({_list}) AS var FROM survey", "median std var")
add("fun13", lambda t: t.survey.select("survey_key", *[X.across(m, ROW).alias(m) for m in ("first", "last", "count", "nunique")]),
    "SELECT survey_key, age::DOUBLE AS first, duration::DOUBLE AS last, 3 AS count, len(list_distinct([age, children, duration])) + ((age IS NULL) OR (children "
    "IS NULL))::INT AS nunique FROM survey")
add("fun14", lambda t: t.survey.select("survey_key", X.across("product", ROW).alias("product")), "SELECT survey_key, age::DOUBLE * children * duration AS product FROM survey")
add("fun15", lambda t: t.survey.select("survey_key", X.across("quotient", ["duration", "children"]).alias("quotient"), X.across("diff", ["duration", "children"]).alias("diff")), "SELECT survey_key, duration / nullif(children, 0) AS quotient, (duration - children)::DOUBLE AS diff FROM survey", "quotient")
add("fun16", lambda t: t.survey.select("survey_key", X.strip("region", "12345-").alias("strip"), X.across("mode", ["children", "team", "enumerator"]).alias("mode")),
    "SELECT survey_key, trim(region, '12345-') AS strip, CASE WHEN children = team OR children = enumerator THEN children WHEN team = enumerator THEN team "
    "ELSE least(children, team, enumerator) END::DOUBLE AS mode FROM survey")
add("time_period", lambda t: t.survey.select("survey_key", *[P.period_label("survey_date", p, "Sunday").alias(p.lower()) for p in ("Day", "Week", "Month")]),
    "SELECT survey_key, strftime(survey_date, '%b %d, %Y') AS day, strftime(survey_date - dayofweek(survey_date)::INT, '%b %d, %Y') || ' to ' || strftime(survey_date - dayofweek(survey_date)::INT + 6, '%b %d, %Y') AS week, strftime(survey_date, '%B %Y') AS month FROM survey")
add("fun18", lambda t: t.survey.withColumn("first_", F.lit("1995-01-01").cast("date")).select("survey_key", X.days_between("survey_date", "first_").alias("days")), "SELECT survey_key, survey_date - DATE '1995-01-01' AS days FROM survey")
add("fun19", lambda t: t.survey.select("survey_key", X.clean_label(F.concat(F.lit("<b>"), "note", F.lit("</b>  x "))).alias("label")), "SELECT survey_key, trim(regexp_replace(' ' || note || '   x ', '\\s+', ' ', 'g')) AS label FROM survey")

# Pipelines

STEPS = [
    prep.Step("remove if missing", {"names": ["age"]}), prep.Step("remove compared", {"names": ["age"], "how": "lt", "value": 0}), prep.Step("transform column", {"column": "income", "function": "divide", "value": [1000]}),
    prep.Step("add computed", {"name": "household", "method": "sum", "columns": ["children", "team"]}), prep.Step("transform column", {"column": "region", "function": "lower"}), prep.Step("remove columns", {"names": ["note", "outcome"]}),
]
PREPPED = "(SELECT survey_key, age, income / 1000 AS income, coalesce(children, 0) + team + 0.0::DOUBLE AS household, lower(region) AS region FROM survey WHERE age >= 0)"
add("apply_prep", lambda t: prep.apply_prep(t.survey, STEPS).select("survey_key", "age", "income", "household", "region"), f"SELECT * FROM {PREPPED}", "income household")


def _step_counts(t: Tables) -> DataFrame:
    after, counts = prep.apply_prep_observed(t.survey, STEPS)
    written(after, "prepared")
    return counts()


_left = ("count(*)", "count(age)", *["count(*) FILTER (age >= 0)"] * 5)
add("prep_counts", _step_counts, "SELECT unnest([" + ", ".join(f"{{'step': {i}, 'action': '{s.action}', 'affected': {_left[i]} - {_left[i + 1]}, 'remaining': {_left[i + 1]}}}" for i, s in enumerate(STEPS)) + "], recursive := true) FROM survey")
FIXED = f"""(SELECT s.survey_key, CASE WHEN l.action = 'remove value' THEN NULL WHEN l.action = 'modify value' THEN 33 ELSE s.age END AS age, CASE WHEN s.survey_key % 21 = 7 AND s.survey_key % 2 = 0 THEN 'moved' ELSE s.region END AS region
  FROM survey s LEFT JOIN (SELECT * FROM ({LOG}) WHERE col = 'age') l ON l.key = s.survey_key::VARCHAR WHERE s.survey_key::VARCHAR NOT IN (SELECT key FROM ({LOG}) WHERE action = 'remove row'))"""
add("apply_corrections", lambda t: K.apply_corrections(t.survey.select("survey_key", "age", "region"), _log(t), "survey_key"), f"SELECT * FROM {FIXED}")
add("validate_corrections", lambda t: K.validate_corrections(t.survey, _log(t), "survey_key"), f"SELECT seq, 'unknown key' AS problem FROM ({LOG}) WHERE key LIKE 'x%'")
add("correction_summary", lambda t: K.correction_summary(_log(t)), f"SELECT action, count(*) AS entries, count(DISTINCT key) AS keys FROM ({LOG}) GROUP BY action")
add("refresh", lambda t: report.refresh(t.survey.where("survey_date < '2000-01-01'"), t.survey, "survey_date", STEPS[:2], _log(t), "survey_key").select("survey_key", "age", "region"),
    FIXED.replace("FROM survey s", "FROM (SELECT * FROM survey WHERE age >= 0) s").join(["SELECT * FROM ", ""]))
add("quality_report", lambda t: report.quality_report(t.survey, t.visits, CODES, CELLS, BOUNDS, AS_OF), report.SQL.format(flags=FLAGS, broken=BROKEN, cells=" + ".join(f"({c} > 0)::INT" for c in CELLS), day=DAY), "value")

# Streams, run to the end of what there is


def _replay(t: Tables, run: Callable[[DataFrame], Any], *tables: DataFrame) -> Any:
    """Each table as a micro-batch of a stream, in this order: `run` goes to the end of what there is after each, and gives the last result."""
    folder, given = new_folder(t.spark), None
    for rows in tables:
        rows.select("event_id", "ts", "user_id", "value").write.mode("append").parquet(folder)
        given = run(t.spark.readStream.schema("event_id long, ts timestamp, user_id long, value double").parquet(folder))
    return given


def _events(t: Tables) -> DataFrame:
    return t.read("events").select("event_id", F.col("ts").cast("timestamp_ntz").cast("timestamp").alias("ts"), "user_id", "value")


def _earlier(rows: DataFrame) -> DataFrame:
    """The same events an hour before, with another value."""
    return rows.withColumns({"ts": F.col("ts") - F.expr("INTERVAL 1 HOUR"), "value": F.col("value") + 1})


def _stream(t: Tables, repeats: bool = False) -> DataFrame:
    """The events as a stream; with repeats each row comes twice, and an hour earlier with another value."""
    folder = new_folder(t.spark)
    rows = _events(t)
    if repeats:
        rows = rows.unionByName(rows).unionByName(_earlier(rows))
    rows.repartitionByRange(4, "ts").write.parquet(folder)
    return t.spark.readStream.schema("event_id long, ts timestamp, user_id long, value double").parquet(folder)


def _late(t: Tables, run: Callable[[DataFrame], Any]) -> Any:
    """The events in two halves, then every tenth once more."""
    rows = _events(t)
    return _replay(t, run, rows.where("ts < '2024-01-16'"), rows.where("ts >= '2024-01-16'"), rows.where("event_id % 10 = 0"))


def _run(df: DataFrame, out: str) -> DataFrame:
    df.writeStream.format("parquet").option("path", out).option("checkpointLocation", out + "-state").trigger(availableNow=True).start().awaitTermination()
    return df.sparkSession.read.schema(df.schema).parquet(out)


def _finished(t: Tables, df: DataFrame) -> DataFrame:
    return _run(df, new_folder(t.spark))


def _windows(t: Tables, counted: Callable[[DataFrame], DataFrame], *by: str) -> DataFrame:
    """What all micro-batches gave, by window."""
    out = new_folder(t.spark)
    return _late(t, lambda events: _run(counted(events), out)).groupBy(*by).agg(F.sum("submissions").alias("submissions"), F.sum("late").alias("late"))


#: Rows of the second half are in time for windows of the first; the third file's rows are late where a window ends before the watermark.
WINDOWS = """SELECT from_date AS {date}{by}, (count(*) FILTER (part = 1 OR NOT closed) * is_out::INT)::BIGINT AS submissions, count(*) FILTER (part = 2 AND closed) AS late
  FROM (SELECT *, stop < mark AS closed, stop + INTERVAL 1 MILLISECOND < mark AS is_out FROM (
      SELECT user_id, part, (ts::DATE - k)::DATE AS from_date, (ts::DATE - k)::TIMESTAMP + INTERVAL {days} DAY AS stop
      FROM (SELECT user_id, ts, 1 AS part FROM events UNION ALL SELECT user_id, ts, 2 FROM events WHERE event_id % 10 = 0), (SELECT unnest(generate_series(0, {days} - 1))::INT AS k)),
    (SELECT date_trunc('millisecond', max(ts)) - INTERVAL 2 DAY AS mark FROM events))
  GROUP BY from_date{by}, is_out HAVING is_out OR count(*) FILTER (part = 2 AND closed) > 0"""
add("stream_submissions_by_day", lambda t: _windows(t, lambda events: streams.stream_submissions_by_day(events, "ts"), "date"), WINDOWS.format(date="date", by="", days=1))
add("stream_constraint_flags", lambda t: _finished(t, streams.stream_constraint_flags(_stream(t), ["event_id"], {"value": O.Bounds(soft_max=20, hard_max=50)}).select("event_id", "value", "reason")),
    "SELECT event_id, value, 'soft_max' AS reason FROM events WHERE value > 20")
add("stream_dedupe_key", lambda t: _finished(t, streams.stream_dedupe_key(_stream(t, repeats=True), "event_id", "ts").select("event_id", "user_id")), "SELECT event_id, user_id FROM events")
add("stream_enumerator_activity", lambda t: _windows(t, lambda events: streams.stream_enumerator_activity(events, "ts", "user_id"), "from_date", "user_id"),
    WINDOWS.format(date="from_date", by=", user_id", days=7))


def _upserted(t: Tables) -> DataFrame:
    """Three batches: two thirds of the events, then all an hour earlier (older rows of the first, new keys), then the last third with repeats and equal times."""
    out, rows = new_folder(t.spark), _events(t)
    rest = rows.where("event_id % 3 = 0")

    def run(events: DataFrame) -> None:
        streams.stream_upsert(events.select("event_id", "ts", "value"), out, "event_id", out + "-state", time="ts").awaitTermination()

    _replay(t, run, rows.where("event_id % 3 <> 0"), _earlier(rows), rest.unionByName(rest).unionByName(rest.withColumn("value", F.col("value") - 1)))
    return keyed_table.read(t.spark, out, "event_id long, ts timestamp, value double").drop("ts")


add("stream_upsert", _upserted, "SELECT event_id, value FROM events")
