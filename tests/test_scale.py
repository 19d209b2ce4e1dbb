"""What must hold for groups of any size: keyed tables over batches, late rows, scans, hot values, neighbours in dense places, patterns, exact p, one-pass reports."""

import collections
import datetime
import itertools
import math
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from surveyqc.functions import geo, scans, skew, stats
from surveyqc.operators import duplicates as U
from surveyqc.operators import gps as G
from surveyqc.operators import missing as M
from surveyqc.operators import outliers as O
from surveyqc.plans import prep, queries, report
from surveyqc.plans.fixtures import Tables
from surveyqc.plans.queries import BOUNDS, CELLS, CODES
from surveyqc.sources import forms
from surveyqc.streaming import keyed_table, streams

ROW = "k long, t timestamp, v string"


def at(seconds):
    return f"2024-01-01 00:{seconds // 60:02}:{seconds % 60:02}"


def table(spark, rows):
    return spark.createDataFrame([(k, at(t) if t is not None else None, v) for k, t, v in rows], "k long, t string, v string").withColumn("t", F.to_timestamp("t"))


BATCHES = [
    [(1, 10, "a"), (2, 10, "a"), (3, 10, "a"), (3, 11, "b"), (None, 5, "n")],
    [(1, 9, "older"), (2, 10, "b"), (4, 1, "new"), (3, None, "z"), (None, 6, "m")],
    [],
    [(2, 10, "a"), (4, 2, "newer"), (1, 10, "a")],
]


def newest(batches):
    found = {}
    for k, t, v in itertools.chain(*batches):
        found[k] = max(found.get(k, (-1, "")), (-0.5 if t is None else t, v))
    return {k: v for k, (_, v) in found.items()}


def stored(spark, folder):
    return {r["k"]: r["v"] for r in keyed_table.read(spark, folder, ROW).collect()}


@pytest.mark.parametrize("buckets", [1, 8])
def test_keyed_table_is_the_same_over_any_batches(spark, tmp_path, buckets):
    folder = f"file://{tmp_path}/t"
    for i, rows in enumerate(BATCHES):
        keyed_table.merge(table(spark, rows), folder, i, "k", "t", buckets)
        assert stored(spark, folder) == newest(BATCHES[: i + 1])
    keyed_table.merge(table(spark, BATCHES[3]), folder, 3, "k", "t", buckets)  # replayed
    assert stored(spark, folder) == newest(BATCHES)
    one = f"file://{tmp_path}/one"
    keyed_table.merge(table(spark, list(itertools.chain(*reversed(BATCHES)))), one, 0, "k", "t", buckets)
    assert stored(spark, one) == newest(BATCHES)


def test_keyed_table_writes_only_touched_buckets(spark, tmp_path):
    folder = f"file://{tmp_path}/t"
    keyed_table.merge(table(spark, [(k, 1, "a") for k in range(200)]), folder, 0, "k", "t", 16)
    keyed_table.merge(table(spark, [(7, 2, "b")]), folder, 1, "k", "t", 16)
    assert len(list((tmp_path / "t/data/v=0").glob("bucket=*"))) == 16
    assert len(list((tmp_path / "t/data/v=1").glob("bucket=*"))) == 1
    assert stored(spark, folder) == {k: "b" if k == 7 else "a" for k in range(200)}


def test_keyed_table_of_nothing(spark, tmp_path):
    keyed_table.merge(table(spark, []), f"file://{tmp_path}/t", 0, "k", "t")
    assert stored(spark, f"file://{tmp_path}/t") == {}


def test_upsert_restarts_and_takes_later_batches(spark, tmp_path):
    source, folder = tmp_path / "in", f"file://{tmp_path}/t"
    for i, rows in enumerate(BATCHES):
        table(spark, rows).coalesce(1).write.mode("append").parquet(str(source))
        events = spark.readStream.schema(ROW).option("maxFilesPerTrigger", 1).parquet(str(source))
        streams.stream_upsert(events, folder, "k", f"{tmp_path}/state", "t", 4).awaitTermination()
        assert stored(spark, folder) == newest(BATCHES[: i + 1])


def test_replay_writes_by_all_tasks_and_is_a_batch_a_table(spark, tmp_path):
    tables = [spark.range(n).select(F.col("id").alias("event_id"), F.lit(None).cast("timestamp").alias("ts"), F.col("id").alias("user_id"), F.lit(0.5).alias("value")).repartition(3) for n in (30, 60, 90)]
    seen = []

    def run(events):
        def each(batch, number):
            seen.append((number, batch.count(), batch.select(F.input_file_name().alias("file")).distinct().count()))

        events.writeStream.foreachBatch(each).option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start().awaitTermination()
        return len(seen)

    assert queries._replay(Tables(spark, ""), run, *tables) == 3
    assert seen == [(0, 30, 3), (1, 60, 3), (2, 90, 3)]


def test_late_rows_are_counted_beside_closed_windows(spark, tmp_path):
    """Each batch is a file; the watermark of a batch is the latest day before it less two days."""
    source, day = tmp_path / "in", lambda d, h=12: f"2024-01-{d:02} {h:02}:00:00"
    files = [[day(1), day(1), day(2)], [day(5), day(1), None], [day(1), day(2), day(4), day(9)], [day(4), day(9)]]
    got = {}
    for rows in files:
        spark.createDataFrame([(x,) for x in rows], "t string").select(F.to_timestamp("t").alias("t")).coalesce(1).write.mode("append").parquet(str(source))
        events = spark.readStream.schema("t timestamp").option("maxFilesPerTrigger", 1).parquet(str(source))
        df = streams.stream_submissions_by_day(events, "t")
        df.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start().awaitTermination()
        out = spark.read.schema(df.schema).parquet(f"{tmp_path}/out").groupBy("date").agg(F.sum("submissions").alias("n"), F.sum("late").alias("late"), F.count_if(F.col("submissions") > 0).alias("times"))
        got = {r["date"].day: (r["n"], r["late"]) for r in out.collect()}
        assert out.where("times > 1").isEmpty()  # a window is closed once
    # By day: 1 has two rows and one of the second file in time, then one late; 2 one and one late; 4 and 5 close after day 9.
    assert got == {1: (3, 1), 2: (1, 1), 4: (1, 1), 5: (1, 0)}


def test_windows_state_is_a_row_a_bucket(spark, tmp_path):
    """Four keys, one null, in 20 days' sliding windows: one call for many windows, and keys come back as they were."""
    rows = [(k, f"2024-01-{d:02} 06:00:00") for d in range(1, 21) for k in (2**60 + 1, 2**60 + 2, 3, None)]
    events = spark.createDataFrame(rows, "who long, t string").select("who", F.to_timestamp("t").alias("t"))
    events.write.parquet(str(tmp_path / "in"))
    df = streams.stream_enumerator_activity(spark.readStream.schema("who long, t timestamp").parquet(str(tmp_path / "in")), "t", "who")
    query = df.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    assert max(p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress if p["stateOperators"]) <= 5
    got = {(r["from_date"].isoformat(), r["who"]): (r["submissions"], r["late"]) for r in spark.read.schema(df.schema).parquet(f"{tmp_path}/out").collect()}
    starts = [datetime.date(2023, 12, 26) + datetime.timedelta(days=i) for i in range(17)]  # windows that end by the 18th
    assert got == {(s.isoformat(), k): (min(7, i + 1), 0) for i, s in enumerate(starts) for k in (2**60 + 1, 2**60 + 2, 3, None)}


def test_counter_loses_no_row_when_it_gives_counts_early():
    rows = [{"k": str(i % 300) if i > 3000 else "ab"[i % 2], "at_": i} for i in range(6000)]
    batches = [pa.RecordBatch.from_pylist(rows[i : i + 70]) for i in range(0, 6000, 70)]
    out = [r for b in streams.counter(["k"], 100)(iter(batches)) for r in b.to_pylist()]
    got = collections.Counter()
    for r in out:
        got[r["k"]] += r["n_"]
    assert +got == collections.Counter(r["k"] for r in rows)
    assert max(r["at_"] for r in out if not r["n_"]) == 5999 and {r["at_"] for r in out if r["n_"]} == {None}


# Scans


def scanned(rows, name):
    """rows (g, o, v): filled both ways, or summed, in order within g."""
    out = []
    for _, own in itertools.groupby(sorted(rows, key=lambda r: (r[0] is not None, r[0], r[1])), key=lambda r: r[0]):
        own = list(own)
        for i, (g, o, _) in enumerate(own):
            before, after = [v for _, _, v in own[: i + 1] if v is not None], [v for _, _, v in own[i:] if v is not None]
            out.append((g, o, (before[-1] if before else after[0] if after else None) if name == "fill" else sum(before) if before else None))
    return out


@pytest.mark.parametrize("parts", [1, 3, 16])
@pytest.mark.parametrize("empty", [0.3, 0.97])
def test_scans_are_windows_over_a_hot_group(spark, parts, empty):
    r = random.Random(parts)
    rows = [(r.choice([1, 1, 1, 2, 3, None]), i, None if r.random() < empty else r.randint(0, 99)) for i in range(600)]
    df = spark.createDataFrame(rows, "g int, o int, v int").repartition(5)
    key = lambda x: str(x)
    filled = scans.fill_both_ways(df, ["g"], ["o"], ["v"], parts)
    assert filled.columns == ["g", "o", "v"]
    assert sorted(map(tuple, filled.collect()), key=key) == sorted(scanned(rows, "fill"), key=key)
    summed = scans.running_sum(df, ["g"], ["o"], "v", "s", parts).select("g", "o", "s")
    assert sorted(map(tuple, summed.collect()), key=key) == sorted(scanned(rows, "sum"), key=key)
    assert scans.running_sum(df.where("false"), ["g"], ["o"], "v", "s", parts).collect() == []


def test_a_hot_group_spreads_over_parts(spark):
    df = spark.range(4000).select(F.lit(1).alias("g"), F.col("id").alias("o"), F.col("id").alias("v"))
    made = scans.segmented_scan(df, ["g"], ["o"], {"s": lambda a: F.sum("v")}, {"b": lambda b, a: F.sum("s").over(b)}, {"part": lambda u, o: F.col("part_")}, 8)
    sizes = [r["count"] for r in made.groupBy("part").count().collect()]
    assert len(sizes) == 8 and max(sizes) < 2 * 4000 / 8


# Hot values


def test_hot_values_are_not_shuffled(spark):
    values = ["hot"] * 5000 + [None] * 900 + [f"v{i // 2}" for i in range(2000)] + ["once"]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string").repartition(4)
    want = {v: values.count(v) for v in set(values)}
    got = U.count_over(df, "v").collect()
    assert len(got) == len(values) and all(r["count"] == (want[r["v"]] if r["v"] is not None else 0) for r in got)
    assert all(r["is_duplicated"] == (want[r["v"]] > 1) for r in U.is_duplicated(df, "v").collect())
    assert {r["i"] for r in U.column_duplicates(df, "v", ["i"]).collect()} == {i for i, v in enumerate(values) if want[v] > 1}
    counts = df.groupBy("v").agg(F.count("*").alias("n"))
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        joined = skew.join_counted(df, "v", counts, "n")
        cold = [len(p) for p in joined.where("v IS NULL OR v <> 'hot'").rdd.glom().collect()]
        assert sum(cold) == len(values) - 5000
        plan = joined._jdf.queryExecution().executedPlan().toString()
        assert "BroadcastHashJoin" in plan
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    assert skew.join_counted(df.where("false"), "v", counts.where("false"), "n").collect() == []


# Places


def far(p, q):
    a = math.sin(math.radians(q[0] - p[0]) / 2) ** 2 + math.cos(math.radians(p[0])) * math.cos(math.radians(q[0])) * math.sin(math.radians(q[1] - p[1]) / 2) ** 2
    return 2 * geo.RADIUS_M * math.asin(min(1.0, math.sqrt(a)))


@pytest.mark.parametrize("k", [1, 5, 30])
def test_neighbours_in_dense_and_lone_places(spark, k, monkeypatch):
    """Half of the points in one square kilometre, some over the date line and at a pole, lone ones, equal ones."""
    monkeypatch.setattr(G, "CELL", 16)
    r = random.Random(k)
    town = [(6.6 + r.random() * 0.009, -0.18 + r.random() * 0.009) for _ in range(120)]
    rest = [(r.uniform(-80, 80), r.uniform(-180, 180)) for _ in range(60)] + [(r.gauss(0, 0.01), 180 - abs(r.gauss(0, 0.01))) for _ in range(15)] + [(r.gauss(0, 0.01), -180 + abs(r.gauss(0, 0.01))) for _ in range(15)]
    points = [*town, *rest, (89.9, 10.0), (89.9, -170.0), (89.95, 100.0), town[0], town[0], rest[0]]
    df = spark.createDataFrame([(i, *p) for i, p in enumerate(points)], "k int, latitude double, longitude double")
    spots = G.written(G.places(df))
    got = {}
    for x in G.nearest_neighbours(spots, k).collect():
        got.setdefault(x["point"], []).extend([x["distance"]] * x["take"])
    where = {(x["lat"], x["lon"]): x["point"] for x in spots.collect()}
    for i, p in enumerate(points):
        want = sorted(far(p, q) for j, q in enumerate(points) if j != i)[:k]
        assert sorted(got[where[p]]) == pytest.approx(want, abs=1e-3), p


def test_levels_split_by_counts(spark):
    """A dense place has small cells, so that no place looks at most of a town."""
    r = random.Random(1)
    points = [(6.6 + r.random() * 0.009, -0.18 + r.random() * 0.009) for _ in range(2000)] + [(r.uniform(0, 10), r.uniform(-5, 5)) for _ in range(2000)]
    spots = G.written(G.places(spark.createDataFrame(points, "latitude double, longitude double")))
    leveled = G.written(G._leveled(spots, 3))
    assert leveled.count() == spots.count()
    town = leveled.where("lat BETWEEN 6.6 AND 6.609 AND lon BETWEEN -0.18 AND -0.171")
    assert town.agg(F.avg("level")).first()[0] > leveled.agg(F.avg("level")).first()[0] + 2
    met = G._around(leveled, spots).groupBy("point").agg(F.count("*").alias("n")).agg(F.avg("n")).first()[0]
    assert met < 200


def test_lof_auto_cuts_at_one_and_a_half(spark):
    r = random.Random(5)
    points = [(6.6 + r.gauss(0, 0.001), -0.18 + r.gauss(0, 0.001)) for _ in range(60)] + [(6.7, -0.1)]
    df = spark.createDataFrame([(i, *p) for i, p in enumerate(points)], "k int, latitude double, longitude double")
    rows = G.gps_lof_outliers(df, "k", 5, "auto").collect()
    assert all(x["is_outlier"] == (x["lof"] > 1.5) for x in rows) and any(x["is_outlier"] and x["k"] == 60 for x in rows)


def test_kmeans_is_lloyd_s_from_the_same_centres(spark):
    """Rows of an area are nearer to its centre than to any other, and each centre is the mean of its rows."""
    r = random.Random(2)
    points = [(a + r.gauss(0, 0.01), b + r.gauss(0, 0.01)) for a, b in ((1, 1), (2, 2), (3, 1)) for _ in range(40)]
    df = spark.createDataFrame([(i, *p) for i, p in enumerate(points)] + [(999, None, 1.0)], "k int, latitude double, longitude double")
    rows = G.gps_kmeans_areas(df, 3, 1).collect()
    area = {x["k"]: x["area"] for x in rows}
    assert area.pop(999) is None and len(rows) == 121
    centre = {a: np.mean([points[k] for k in area if area[k] == a], axis=0) for a in set(area.values())}
    assert len(centre) == 3
    for k, a in area.items():
        assert min(centre, key=lambda c: np.sum((centre[c] - points[k]) ** 2)) == a
    assert len({area[k] for k in range(40)}) == len({area[k] for k in range(40, 80)}) == 1


@pytest.mark.parametrize(
    "a,b,metres",
    [
        ((-37.95103342, 144.42486789), (-37.65282114, 143.92649553), 54972.271),  # the example of the formula's surveyors
        ((0, 0), (0, 1), 111319.491), ((0, 0), (1, 0), 110574.389), ((0, 179.5), (0, -179.5), 111319.491), ((5, 5), (5, 5), 0.0), ((90, 0), (-90, 0), 20003931.459), ((90, 10), (90, 70), 0.0),
    ],
)
def test_ellipsoid(spark, a, b, metres):
    row = spark.createDataFrame([(*map(float, a), *map(float, b))], "a double, b double, c double, d double")
    assert row.select(geo.geodesic(*map(F.col, "abcd"))).first()[0] == pytest.approx(metres, abs=2e-3)


def test_ellipsoid_of_opposite_points_and_nulls(spark):
    rows = spark.createDataFrame([(0.0, 0.0, 0.5, 179.7), (0.0, 0.0, 0.0, 180.0), (None, 0.0, 1.0, 1.0)], "a double, b double, c double, d double")
    got = [r[0] for r in rows.select(geo.geodesic(*map(F.col, "abcd"))).collect()]
    assert got[2] is None and all(19_900_000 < x <= geo.HALF_MERIDIAN for x in got[:2])


# Missing cells, tests, reports, appends


def test_nullity_correlation_of_wide_tables(spark):
    r = np.random.default_rng(1)
    cells = (r.random((300, 130)) < r.random(130)).astype(int) * r.integers(1, 4, (300, 130))
    cells[:, 5], cells[:, 6] = 0, 1
    names = [f"c{i}" for i in range(130)]
    df = spark.createDataFrame([tuple(map(int, x)) for x in np.repeat(cells, 2, axis=0)], ", ".join(f"{n} int" for n in names)).repartition(3)
    got = {(x["column_2"], x["column_1"]): x["correlation"] for x in M.nullity_correlation(df, names).collect()}
    assert len(got) == 130 * 129 // 2
    missing = cells > 0
    with np.errstate(all="ignore"):
        want = np.corrcoef(missing.T)
    for (a, b), c in got.items():
        i, j = int(a[1:]), int(b[1:])
        assert i < j and (c is None if {i, j} & {5, 6} else c == pytest.approx(want[i, j], abs=1e-9)), (a, b)
    assert all(x["correlation"] is None for x in M.nullity_correlation(df.where("false"), names[:3]).collect())


@pytest.mark.parametrize("seed", range(6))
def test_signed_rank_p_is_enumeration(seed):
    r = random.Random(seed)
    n = r.randint(1, 12)
    sizes = sorted(r.randint(1, 6) if seed % 2 else r.random() for _ in range(n))
    ranks = [sum(x < s for x in sizes) + (sum(x == s for x in sizes) + 1) / 2 for s in sizes]
    signs = [r.random() < 0.6 for _ in range(n)]
    w = min(sum(x for x, s in zip(ranks, signs, strict=True) if s == up) for up in (True, False))
    sums = [sum(x for x, s in zip(ranks, c, strict=True) if s) for c in itertools.product((0, 1), repeat=n)]
    want = min(1.0, 2 * sum(s <= w for s in sums) / 2**n)
    assert stats.signed_rank_two_sided([round(2 * x) for x in ranks], w) == pytest.approx(want)


def test_appends_take_ties_at_the_mark_once(spark):
    stored_, fresh = table(spark, [(1, 10, "s"), (2, 20, "s"), (3, 20, "s")]), table(spark, [(2, 20, "f"), (4, 20, "f"), (5, 21, "f"), (6, 15, "f"), (7, 1, "f"), (None, 20, "f")])
    keys = lambda **x: sorted(str(r["k"]) for r in forms.incremental_append(stored_, fresh, "t", **x).collect())
    assert keys() == ["1", "2", "3", "5"]
    assert keys(key="k") == ["1", "2", "3", "4", "5", "None"]
    assert keys(key="k", tolerance="5 seconds") == ["1", "2", "3", "4", "5", "6", "None"]
    again = forms.incremental_append(stored_, fresh, "t", key="k", tolerance="5 seconds")
    assert forms.incremental_append(again, fresh, "t", key="k", tolerance="5 seconds").count() == again.count()
    assert sorted(r["k"] or 0 for r in forms.incremental_append(stored_.where("false"), fresh, "t", key="k").collect()) == [0, 2, 4, 5, 6, 7]


def test_outlier_metrics_of_counted_values(spark):
    r = random.Random(3)
    df = spark.createDataFrame([(i % 7 if i % 11 else None, float(r.randint(0, 30)) * (40 if r.random() < 0.02 else 1), r.choice([1, 1, 1, 9, None])) for i in range(900)], "e int, a double, b int")
    for columns in (["a", "b"], ["b"]):
        want = O.outlier_metrics(O.outlier_flags(df, ["e"], columns), "e").first().asDict()
        assert O.outlier_metrics_of(df, columns, "e").first().asDict() == want
    assert O.outlier_metrics_of(df.limit(5), ["a"], "e").first()["total"] == 0
    assert O.outlier_metrics_of(df.where("false"), ["a"], "e").first()["columns_checked"] == 0


def test_report_reads_the_survey_twice(spark):
    from surveyqc.plans.fixtures import Tables

    t, seen = Tables(spark, "/root/testdata/sf0.001"), spark.sparkContext.accumulator(0)

    def each(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    watched = t.survey.mapInArrow(each, t.survey.schema)
    got = report.quality_report(watched, t.visits, CODES, CELLS, BOUNDS, "2001-08-01").collect()
    assert len(got) == 22 and seen.value == 2 * t.survey.count()


def test_steps_are_counted_in_the_pass_that_uses_them(spark):
    df = spark.createDataFrame([(i, i if i % 3 else None) for i in range(30)], "i int, a int")
    steps = [prep.Step("remove if missing", {"names": ["a"]}), prep.Step("remove compared", {"names": ["a"], "how": "lt", "value": 10}), prep.Step("remove columns", {"names": ["i"]})]
    after, counts = prep.apply_prep_observed(df, steps)
    assert after.count() == 14
    assert [tuple(r) for r in counts().orderBy("step").collect()] == [(0, "remove if missing", 10, 20), (1, "remove compared", 6, 14), (2, "remove columns", 0, 14)]
