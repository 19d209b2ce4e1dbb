"""Small literal frames with expected values by hand."""

import math
import random

import pytest
from pyspark.sql import functions as F

from surveyqc.functions import columns as C
from surveyqc.functions import stats
from surveyqc.functions import transforms as X
from surveyqc.functions.geo import geodesic, haversine
from surveyqc.operators import backchecks as B
from surveyqc.operators import corrections as K
from surveyqc.operators import duplicates as U
from surveyqc.operators import filters as R
from surveyqc.operators import gps as G
from surveyqc.operators import missing as M
from surveyqc.operators import outliers as O
from surveyqc.operators import progress as V
from surveyqc.plans import prep
from surveyqc.sources import files, forms


def values(df, column):
    return sorted((r[column] for r in df.collect()), key=lambda x: (x is None, x))


def test_equality_filters_keep_and_remove(spark):
    df = spark.createDataFrame([(i,) for i in (1, 2, 3, 2, 5)], "a int")
    assert values(R.keep_equal(df, ["a"], [2]), "a") == [2, 2]
    assert values(R.keep_not_equal(df, ["a"], [2]), "a") == [1, 3, 5]
    assert values(R.remove_compared(df, ["a"], "gt", 2), "a") == [1, 2, 2]
    assert values(R.remove_between(df, ["a"], 2, 3), "a") == [1, 5]


def test_index_is_dense_over_many_partitions(spark):
    df = spark.range(1000).repartition(7).withColumn("k", F.lit(1000) - F.col("id"))
    got = C.dense_index(df, ["k"]).orderBy("k").collect()
    assert [r["index"] for r in got] == list(range(1000))
    assert values(R.remove_rows_by_index(spark.range(10), ["0:7", 9], ["id"]), "id") == [8]


def test_missing_codes_follow_the_column_type(spark):
    df = spark.createDataFrame([("-999", -999, 1.5), (None, 5, -888.0), ("x", None, None)], "t string, i int, d double")
    got = [tuple(r) for r in M.missing_encode(df, {"a": ["-999", "zz"], "b": ["-888", "-999"]}).collect()]
    assert got == [(3, 3, 0), (1, 0, 3), (0, 1, 1)]


def test_standardize_missing(spark):
    df = spark.createDataFrame([(" NA ", 1), ("-", None), (" ok ", 3)], "t string, i int")
    assert [tuple(r) for r in C.standardize_missing(df).collect()] == [(None, 1), (None, None), ("ok", 3)]


def test_duplicates_of_null_ids_count_zero(spark):
    df = spark.createDataFrame([("a", 1), ("a", 2), (None, 3), (None, 4), ("b", 5)], "id string, k int")
    assert sorted((r["k"], r["duplicate_count"]) for r in U.id_duplicates(df, "id").collect()) == [(1, 2), (2, 2), (3, 0), (4, 0)]
    assert values(U.anti_duplicates(df, "id"), "k") == [5]


def test_outliers_need_values_and_pool_groups(spark):
    df = spark.createDataFrame([(i, float(i % 5), 1000.0 if i == 3 else 1.0 * (i % 4)) for i in range(40)], "k int, x_1 double, x_2 double")
    flags = O.outlier_flags(df, ["k"], ["x_1", "x_2"])
    assert [r["k"] for r in flags.where("reason <> 'no outlier'").collect()] == [3]
    assert O.outlier_flags(df.limit(10), ["k"], ["x_2"]).where("reason <> 'no outlier'").count() == 0
    assert O.variable_groups(df.columns) == {"x": ["x_1", "x_2"]}
    with pytest.raises(ValueError):
        O.Bounds(hard_min=5, soft_min=1)


def test_bounds_are_written_by_their_exact_value(spark):
    """The upper bound 753026.315 is a double below the half, so that printf and SQL write 753026.31."""
    values_of = [125837.89] * 6 + [200000.0] * 9 + [376713.26] * 5 + [1e6]
    df = spark.createDataFrame([(i, v, v) for i, v in enumerate(values_of)], "k int, x_1 double, x_2 double")
    told = [r["reason"] for r in O.outlier_flags(df, ["k"], ["x_1"]).where("reason <> 'no outlier'").collect()]
    assert told == ["above upper bound 753026.31"]
    pooled = O.outlier_flags_grouped(df, ["k"], {"x": ["x_1", "x_2"]}, "sd", multiplier=1.0).where("k = 20")
    assert {r["reason"] == f"above upper bound {r['upper']:.2f}" for r in pooled.collect()} == {True}


def test_admin_join_keeps_all_rows_of_a_repeated_key(spark):
    df = spark.createDataFrame([(1, "a", 1.0), (1, "b", 2.0), (2, "c", None), (None, "d", 4.0), (None, "e", 5.0)], "k int, who string, x double")
    got = O.outlier_admin_join(O.outlier_flags(df, ["k"], ["x"]), df, "k", ["who"]).select("k", "who", "value").collect()
    assert sorted(map(tuple, got), key=str) == [(1, "a", 1.0), (1, "a", 2.0), (1, "b", 1.0), (1, "b", 2.0), (2, "c", None), (None, "d", None), (None, "e", None)]


def test_soft_max_is_named_before_hard_max(spark):
    df = spark.createDataFrame([(1, 99.0), (2, 5.0)], "k int, v double")
    got = O.constraint_violations(df, ["k"], {"v": O.Bounds(soft_max=10, hard_max=50)}).collect()
    assert [(r["k"], r["reason"], r["breached"]) for r in got] == [(1, "soft_max", ["soft_max", "hard_max"])]


def test_attempts_over_the_limit_are_an_error(spark):
    df = spark.createDataFrame([("a", "2024-01-01"), ("a", "2024-01-03"), ("b", "2024-01-02")], "id string, d string")
    got = {r["id"]: (r["attempts"], str(r["attempt_1"]), r["attempt_2"] and str(r["attempt_2"])) for r in V.attempted_interviews(df, "id", "d").collect()}
    assert got == {"a": (2, "2024-01-01", "2024-01-03"), "b": (1, "2024-01-02", None)}
    with pytest.raises(ValueError):
        V.attempted_interviews(df, "id", "d", 1)


def test_prep_replay_is_stepwise(spark):
    df = spark.createDataFrame([(1, 10.0, "A-1"), (2, None, "B-2"), (3, 30.0, None)], "k int, v double, t string")
    steps = [prep.Step("remove if missing", {"names": ["v"]}), prep.Step("transform column", {"column": "v", "function": "divide", "value": [4]}), prep.Step("transform column", {"column": "t", "function": "extract", "value": ["-(\\d)"]})]
    one = df
    for s in prep.from_json(prep.to_json(steps)):
        one, counts = prep.apply_step(one, s)
    assert [tuple(r) for r in prep.apply_prep(df, steps).orderBy("k").collect()] == [tuple(r) for r in one.orderBy("k").collect()] == [(1, 2.5, "1"), (3, 7.5, None)]
    assert prep.remove_prep_step(steps, 0) == steps[1:]
    prep.register("twice", lambda d, column: d.withColumn(column, F.col(column) * 2))
    assert prep.apply_prep(df, [prep.Step("twice", {"column": "v"})]).first()["v"] == 20.0


@pytest.mark.parametrize("seed", range(3))
def test_corrections_are_a_sequential_replay(spark, seed):
    r = random.Random(seed)
    data = {str(k): {"k": str(k), "n": k, "t": f"t{k}"} for k in range(20)}
    log = [(i, str(r.randrange(22)), r.choice(["modify value", "modify value", "remove value", "remove row"] if i % 4 else ["modify value"]), r.choice(["n", "t"]), r.choice(["5", "x7", "12"]), None) for i in range(60)]
    df = spark.createDataFrame([tuple(v.values()) for v in data.values()], "k string, n int, t string")
    for _, key, action, column, new, _ in log:
        if key in data:
            if action == "remove row":
                del data[key]
            else:
                value = None if action == "remove value" else new
                data[key][column] = (int(value) if value and value.isdigit() else None) if column == "n" else value
    got = K.apply_corrections(df, spark.createDataFrame(log, K.LOG), "k").collect()
    assert sorted(map(tuple, got)) == sorted(tuple(v.values()) for v in data.values())
    assert K.remove_correction(spark.createDataFrame(log, K.LOG), 3).count() == 59


def test_dates_take_the_first_form_that_all_values_have(spark):
    df = spark.createDataFrame([("Jan 01, 2024",), ("Feb 29, 2024",), (None,)], "d string")
    assert [str(r["d"])[:10] for r in X.parse_dates(df, "d").collect()] == ["2024-01-01", "2024-02-29", "None"]
    assert str(X.parse_dates(spark.createDataFrame([("18aug2025",)], "d string"), "d").first()[0])[:10] == "2025-08-18"
    with pytest.raises(ValueError):
        X.parse_dates(spark.createDataFrame([("2024-01-01",), ("x",)], "d string"), "d")


def test_distances(spark):
    row = spark.range(1).select(*[F.lit(x).alias(n) for n, x in (("a", 50.06632), ("b", -5.71475), ("c", 58.64402), ("d", -3.07009))])
    got = row.select(haversine(F.col("a"), F.col("b"), F.col("c"), F.col("d")), geodesic(F.col("a"), F.col("b"), F.col("c"), F.col("d"))).first()
    assert got[1] == pytest.approx(969_954.17, abs=30)
    assert got[0] == pytest.approx(got[1], rel=0.005)


def test_distributions():
    assert stats.student_two_sided(2.228, 10) == pytest.approx(0.05, abs=2e-4)
    assert stats.student_two_sided(0.0, 5) == pytest.approx(1.0)
    assert stats.normal_two_sided(1.959964) == pytest.approx(0.05, abs=1e-6)


def plain_lof(points, k):
    def far(p, q):
        a = math.sin(math.radians(q[0] - p[0]) / 2) ** 2 + math.cos(math.radians(p[0])) * math.cos(math.radians(q[0])) * math.sin(math.radians(q[1] - p[1]) / 2) ** 2
        return 2 * 6371008.8 * math.asin(math.sqrt(a))

    near = [sorted((far(p, q), j) for j, q in enumerate(points) if j != i)[:k] for i, p in enumerate(points)]
    kd = [n[-1][0] for n in near]
    lrd = [1 / (sum(max(kd[j], d) for d, j in n) / k + 1e-10) for n in near]
    return [sum(lrd[j] for _, j in n) / k / own for n, own in zip(near, lrd, strict=True)]


def test_lof_is_brute_force(spark):
    r = random.Random(5)
    points = [(6.6 + r.gauss(0, 0.01), -0.18 + r.gauss(0, 0.01)) for _ in range(60)] + [(7.5, 0.5)]
    df = spark.createDataFrame([(i, *p) for i, p in enumerate(points)], "k int, latitude double, longitude double")
    got = {x["k"]: x["lof"] for x in G.gps_lof_outliers(df, "k", 5, 0.05).collect()}
    assert [got[i] for i in range(61)] == pytest.approx(plain_lof(points, 5), rel=1e-6)


def test_gps_texts(spark):
    df = spark.createDataFrame([("5.1,6.2",), ("5.1 6.2 0 3",), ("5.1\t6.2",), ("bad",), (None,)], "g string")
    assert [(r["latitude"], r["longitude"]) for r in G.parse_gps(df, "g").collect()] == [(5.1, 6.2)] * 3 + [(None, None)] * 2


def test_match_status_order(spark):
    df = spark.createDataFrame([("x", "x"), ("x", "y"), (None, "y"), ("na", "y"), ("a", "b")], "s string, b string")
    o = B.TextOptions(exclude=("na",), no_difference=("a", "b"))
    assert [r[0] for r in df.select(B.match_status(F.col("s"), F.col("b"), o)).collect()] == ["match", "mismatch", "missing", "excluded", "no_difference"]


def test_signed_rank(spark):
    d = [1, -2, 2, 3, 3, 4, -1, 5]
    df = spark.createDataFrame([("c", str(10 + x), "10") for x in d], "column_name string, survey_value string, backcheck_value string")
    got = B.signed_rank_test(df).first()
    ranks = {1: 1.5, 2: 3.5, 3: 5.5, 4: 7, 5: 8}
    assert got["w"] == min(sum(ranks[x] for x in d if x > 0), sum(ranks[-x] for x in d if x < 0))
    assert 0 < got["p"] < 1


def test_sources(spark, tmp_path):
    folder = f"file://{tmp_path}/s"
    df = spark.createDataFrame([(1, "a"), (2, None)], "k int, t string")
    files.save_stage(df, folder, "p", "raw", "x y")
    assert files.stage_exists(spark, folder, "p", "raw", "x y") and not files.stage_exists(spark, folder, "p", "prep", "x y")
    assert files.resolve_stage(spark, folder, "p", "x y").count() == 2
    files.drop_stage(spark, folder, "p", "raw", "x y")
    with pytest.raises(ValueError):
        files.resolve_stage(spark, folder, "p", "x y")
    (tmp_path / "a.json").write_text('[{"k": 1, "t": "x"}, {"k": 2}]')
    assert files.scan_json(spark, f"file://{tmp_path}/a.json").count() == 2
    (tmp_path / "a.csv").write_text("k,t\n1,a\nbad,b\n")
    got = files.scan_csv(spark, f"file://{tmp_path}/a.csv", "k int, t string").collect()
    assert [(r["k"], r["_corrupt_record"]) for r in got] == [(1, None), (None, "bad,b")]
    old, new = spark.createDataFrame([(1, "o"), (2, "o")], "k int, v string"), spark.createDataFrame([(2, "n"), (3, "n")], "k int, v string")
    assert sorted(map(tuple, forms.upsert_by_key(old, new, "k").collect())) == [(1, "o"), (2, "n"), (3, "n")]
    assert sorted(map(tuple, forms.upsert_by_key(old, new, "k", keep_new=False).collect())) == [(1, "o"), (2, "o"), (3, "n")]


def test_entry_survives_without_the_training_data_operators(spark):
    import __spark_entry__ as E

    assert set(E.oracle_sql()) <= set(E.queries())
    assert E.entry(spark).count() > 0


def test_standardize_missing_knows_every_token(spark):
    tokens = ["", "   ", "\t", "\n", "NULL", "null", "Null", "None", "none", "NONE", "N/A", "n/a", "NA", "na", "#N/A", "N/a", "-", "--", ".", "?", "???", "Missing", "missing", "MISSING", "Unknown", "unknown", "UNKNOWN", "NaN", "NAN", "nan", "NaT"]
    df = spark.createDataFrame([(f"\t{t}\n", float("nan")) for t in tokens] + [(" ..\t", 1.5), ("Na", 2.0)], "t string, d double")
    assert [tuple(r) for r in C.standardize_missing(df).collect()] == [(None, None)] * len(tokens) + [("..", 1.5), ("Na", 2.0)]


def test_each_date_form(spark):
    forms = {
        "8aug2025 19:49:00": "2025-08-08 19:49:00", "18-AUG-2025 19:49:00": "2025-08-18 19:49:00", "2025-08-18 19:49:00": "2025-08-18 19:49:00", "8/18/2025 19:49:00": "2025-08-18 19:49:00",
        "18/8/2025 19:49:00": "2025-08-18 19:49:00", "2025-08-18": "2025-08-18 00:00:00", "1/2/2024": "2024-01-02 00:00:00", "18-8-2025": "2025-08-18 00:00:00",
    }
    for text, want in forms.items():
        got = X.parse_dates(spark.createDataFrame([(text,), (None,)], "d string"), "d").collect()
        assert [str(r["d"]) for r in got] == [want, "None"], text


def test_neighbours_across_the_antimeridian_and_a_point_alone(spark):
    df = spark.createDataFrame([(1, "a", 10.0, 179.9999), (2, "a", 10.0, -179.9999), (3, "a", 10.0, 0.0), (4, "a", 89.9999, 0.0), (5, "a", 89.9999, 180.0)], "k int, area string, latitude double, longitude double")
    near = {r["k"] for r in G.gps_too_clustered(df, "k", "area", 50.0).collect() if r["too_clustered"]}
    assert near == {1, 2, 4, 5}
    alone = G.gps_lof_outliers(df.where("k = 3"), "k").collect()
    assert [(r["k"], r["lof"], r["is_outlier"]) for r in alone] == [(3, 1.0, False)]
    assert G.gps_lof_outliers(df.where("false"), "k").count() == 0


def test_random_numbers_are_repeatable_and_even(spark):
    df = spark.range(6000).withColumnRenamed("id", "k")
    one, two, other = (dict(map(tuple, R.add_random(df.repartition(n), "x", seed, "k").select("k", "x").collect())) for n, seed in ((3, 1), (7, 1), (3, 2)))
    assert one == two and one != other and len(set(one.values())) == 6000
    assert abs(sum(one.values()) / 6000 - 0.5) < 0.02 and all(0 <= x < 1 for x in one.values())
