"""Quantiles of groups against numpy, and no plan that gathers a group's values."""

import duckdb
import numpy as np
import pytest

from surveyqc.functions.quantiles import quantiles
from surveyqc.operators import enumerator as E
from surveyqc.operators import outliers as O

AT = {"least": 0.0, "q1": 0.25, "median": 0.5, "p95": 0.95, "most": 1.0}


@pytest.fixture(scope="module")
def groups():
    made = np.random.default_rng(5)
    return {
        "hot": made.normal(size=1500).tolist(), "ties": made.integers(0, 4, size=200).astype(float).tolist(), "one": [3.5], "two": [1.0, 2.0],
        "even": [4.0, 1.0, 3.0, 2.0], None: [7.0, 7.0, -1.0], "none": [],
    }


@pytest.fixture(scope="module")
def rows(spark, groups):
    data = [(g, v) for g, vs in groups.items() for v in [*vs, None]]
    return spark.createDataFrame(data, "g string, v double").repartition(7)


@pytest.mark.parametrize("rule", ["linear", "midpoint", "lower", "higher"])
def test_quantiles_are_numpys(rows, groups, rule):
    got = {r["g"]: r for r in quantiles(rows, ["g"], "v", AT, rule).collect()}
    assert set(got) == {g for g, vs in groups.items() if vs}
    for g, r in got.items():
        assert [r[k] for k in AT] == pytest.approx([np.quantile(groups[g], q, method=rule) for q in AT.values()], rel=1e-12)


def test_linear_is_sqls_to_the_last_bit(spark):
    made = np.random.default_rng(7)
    data = [(n, float(v)) for n in range(2, 80) for v in made.uniform(1e3, 5e5, n).round(2)]
    duck = duckdb.connect()
    duck.execute("CREATE TABLE t (g INT, v DOUBLE)")
    duck.executemany("INSERT INTO t VALUES (?, ?)", data)
    want = duck.execute(f"SELECT g, {', '.join(f'quantile_cont(v, {q})' for q in AT.values())} FROM t GROUP BY g").fetchall()
    got = quantiles(spark.createDataFrame(data, "g int, v double"), ["g"], "v", AT).collect()
    assert sorted(map(tuple, got)) == sorted(want)
    ends = spark.createDataFrame([("a", 1.0), ("a", float("inf")), ("b", 1.7e308), ("b", 1.6e308), ("c", None)], "g string, v double")
    assert sorted(map(tuple, quantiles(ends, ["g"], "v", {"q": 0.5}).collect())) == [("a", float("inf")), ("b", pytest.approx(1.65e308))]


def test_bounds_between_two_values_read_as_in_sql(spark):
    """Rounded twice, the upper bound would be 794410.6749999999, and be written .67."""
    values = [111596.1] * 6 + [111596.15] + [200000.0] * 8 + [384721.81] + [384721.98] * 5 + [1e6]
    flags = O.outlier_flags(spark.createDataFrame([(v,) for v in values], "x double"), [], ["x"])
    assert [r["reason"] for r in flags.where("reason <> 'no outlier'").collect()] == ["above upper bound 794410.68"]


def test_nearest_of_two_as_close_is_the_higher(spark):
    df = spark.createDataFrame([(float(i),) for i in range(4)], "v double")
    assert tuple(quantiles(df, [], "v", {"a": 0.5, "b": 0.3, "c": 0.4}, "nearest").first()) == (2.0, 1.0, 1.0)
    with pytest.raises(ValueError, match="rule"):
        quantiles(df, [], "v", {"a": 0.5}, "other")


def test_quantiles_of_nothing_and_of_all(spark, rows, groups):
    flat = [v for vs in groups.values() for v in vs]
    assert tuple(quantiles(rows, [], "v", AT).first()) == pytest.approx(tuple(np.quantile(flat, list(AT.values()))))
    assert quantiles(rows.where("false"), ["g"], "v", AT).collect() == []
    assert [tuple(r) for r in quantiles(rows.where("false"), [], "v", {"a": 0.5}).collect()] == [(None,)]
    empty = O.outlier_stats(spark.createDataFrame([(1.0, None), (2.0, None)], "a double, b double"), ["a", "b"])
    assert {r["column_name"]: (r["n"], r["median"], r["upper"]) for r in empty.collect()} == {"a": (2, 1.5, 2.5), "b": (0, None, None)}


def test_rule_reaches_the_bounds(spark):
    df = spark.createDataFrame([(float(i),) for i in range(4)], "x double")
    stats = {rule: O.outlier_stats(df, ["x"], rule=rule).first() for rule in ("linear", "midpoint", "nearest")}
    assert {k: r["iqr"] for k, r in stats.items()} == {"linear": 1.5, "midpoint": 2.0, "nearest": 1.0}


def test_quantiles_by_enumerator_and_period(spark):
    data = [("a", "2024-01-01", 1.0), ("a", "2024-01-02", 4.0), ("a", "2024-02-01", 9.0), (None, "2024-01-05", 2.0), ("b", "2024-02-02", None)]
    df = spark.createDataFrame(data, "who string, day string, x double")
    stats = {r["who"]: (r["x_count"], r["x_median"], r["x_p75"]) for r in E.enumerator_statistics(df, ["who"], ["x"], ["count", "median", "p75"]).collect()}
    assert stats == {"a": (3, 4.0, 6.5), None: (1, 2.0, 2.0), "b": (0, None, None)}
    months = E.enumerator_statistics_overtime(df, "day", ["who"], "x", "median")
    assert {r[0]: tuple(r)[1:] for r in months.collect()} == {"a": (2.5, 9.0), None: (2.0, None), "b": (None, None)}


def test_no_percentile_in_the_plan(rows):
    plan = O.outlier_stats(rows, ["v"])._jdf.queryExecution().toString()
    assert "percentile(" not in plan
