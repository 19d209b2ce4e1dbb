"""GPS checks: parsing, distances, outliers, accuracy."""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from surveyqc.functions.columns import percent
from surveyqc.functions.geo import RADIUS_M, haversine
from surveyqc.functions.quantiles import quantiles, with_quantiles
from surveyqc.functions.shared import written


def parse_gps(df: DataFrame, gps: str | None = None, latitude: str | None = None, longitude: str | None = None) -> DataFrame:
    """latitude and longitude as doubles from one text ("lat lon ..." or "lat,lon ...") or two columns; null where they can't be read."""
    if gps is not None:
        parts = F.split(F.trim(F.col(gps)), r"[,\s]+")
        pair = F.get(parts, 0).try_cast("double"), F.get(parts, 1).try_cast("double")
    else:
        pair = F.col(latitude).try_cast("double"), F.col(longitude).try_cast("double")
    whole = pair[0].isNotNull() & pair[1].isNotNull()
    return df.withColumns({"latitude": F.when(whole, pair[0]), "longitude": F.when(whole, pair[1])})


def gps_pair_merge(first: DataFrame, second: DataFrame, key: str) -> DataFrame:
    """Inner join on key of two tables with latitude and longitude, both complete: lat1, lon1, lat2, lon2."""
    side = lambda df, k: df.where("latitude IS NOT NULL AND longitude IS NOT NULL").select(key, F.col("latitude").alias(f"lat{k}"), F.col("longitude").alias(f"lon{k}"))
    return side(first, 1).join(side(second, 2), key)


def gps_compare(first: DataFrame, second: DataFrame, key: str, threshold: float = 100.0, distance=haversine) -> DataFrame:
    """Pairs with their distance in metres and whether it exceeds the threshold, farthest first."""
    pairs = gps_pair_merge(first, second, key)
    return pairs.withColumn("distance", distance(F.col("lat1"), F.col("lon1"), F.col("lat2"), F.col("lon2"))).withColumn("exceeds", F.col("distance") > threshold).orderBy(F.desc("distance"), key)


def gps_compare_metrics(pairs: DataFrame) -> DataFrame:
    return pairs.agg(F.count("*").alias("total"), F.count_if("exceeds").alias("flagged"), F.avg("distance").alias("mean_distance"), F.max("distance").alias("max_distance"))


def centroid_attach(df: DataFrame, cluster: str | None, latitude: str = "latitude", longitude: str = "longitude") -> DataFrame:
    """cluster_ (null: Unknown; no column: one cluster) and its centroid. Centroids are aggregated before they are joined."""
    named = df.where(F.col(latitude).isNotNull() & F.col(longitude).isNotNull()).withColumn("cluster_", F.coalesce(F.col(cluster).cast("string"), F.lit("Unknown")) if cluster else F.lit("All"))
    centres = named.groupBy("cluster_").agg(F.avg(latitude).alias("centre_lat"), F.avg(longitude).alias("centre_lon"), F.count("*").alias("cluster_n"))
    return named.join(centres, "cluster_")


def gps_cluster_outliers(df: DataFrame, cluster: str | None = None, multiplier: float = 1.5, distance=haversine) -> DataFrame:
    """Distance to the cluster's centroid and whether it is above q3 + 1.5 IQR or below q1 - 1.5 IQR of the cluster; never with under 4 points or no spread."""
    far = centroid_attach(df, cluster).withColumn("distance", distance(F.col("latitude"), F.col("longitude"), F.col("centre_lat"), F.col("centre_lon")))
    fence = quantiles(far, ["cluster_"], "distance", {"q1_": 0.25, "q3_": 0.75})
    iqr = F.col("q3_") - F.col("q1_")
    out = (F.col("cluster_n") >= 4) & (iqr > 0) & ((F.col("distance") > F.col("q3_") + multiplier * iqr) | (F.col("distance") < F.col("q1_") - multiplier * iqr))
    return far.join(fence, "cluster_").withColumn("is_outlier", out).drop("q1_", "q3_").withColumnRenamed("cluster_", "cluster")


def gps_outlier_metrics(flagged: DataFrame) -> DataFrame:
    return flagged.agg(F.count("*").alias("points"), F.count_if("is_outlier").alias("outliers"), percent(F.count_if("is_outlier"), F.count("*")).alias("outlier_pct"))


def gps_accuracy_stats(df: DataFrame, accuracy: str, cluster: str) -> DataFrame:
    a = F.col("value_")
    cells = df.select(cluster, F.col(accuracy).cast("double").alias("value_"))
    plain = cells.groupBy(cluster).agg(F.count(a).alias("n"), F.min(a).alias("min"), F.avg(a).alias("mean"), F.max(a).alias("max"), F.stddev_samp(a).alias("std"))
    return with_quantiles(plain, cells, [cluster], "value_", {"median": 0.5, "p25": 0.25, "p75": 0.75, "p95": 0.95})


def gps_validity(df: DataFrame, accuracy: str, worst: float = 10.0) -> DataFrame:
    """Rows with missing, impossible and inaccurate coordinates, and rows at a place that another row has."""
    lat, lon = F.col("latitude"), F.col("longitude")
    missing = lat.isNull() | lon.isNull()
    counts = df.agg(F.count("*").alias("points"), F.count_if(missing).alias("missing"), F.count_if((F.abs(lat) > 90) | (F.abs(lon) > 180)).alias("out_of_range"), F.count_if(F.col(accuracy) > worst).alias("low_accuracy"))
    places = df.where(~missing).groupBy("latitude", "longitude").agg(F.count("*").alias("n")).agg(F.coalesce(F.sum(F.when(F.col("n") > 1, F.col("n"))), F.lit(0)).alias("duplicate_places"))
    return counts.crossJoin(places)  # one row each


def gps_distance_outliers_global(df: DataFrame, area: str, method: str = "iqr", distance=haversine) -> DataFrame:
    """Kilometres to the area's centre; the fence is over all rows: IQR 1.5 or mean and 2 sd."""
    far = centroid_attach(df, area).withColumn("distance_km", distance(F.col("latitude"), F.col("longitude"), F.col("centre_lat"), F.col("centre_lon")) / 1000)
    if method == "iqr":
        spread = 1.5 * (F.col("q3_") - F.col("q1_"))
        fence = quantiles(far, [], "distance_km", {"q1_": 0.25, "q3_": 0.75}).select((F.col("q1_") - spread).alias("low_"), (F.col("q3_") + spread).alias("high_"))
    else:
        mean, sd = F.avg("distance_km"), F.stddev_samp("distance_km")
        fence = far.agg((mean - 2 * sd).alias("low_"), (mean + 2 * sd).alias("high_"))
    return far.crossJoin(fence).withColumn("is_outlier", (F.col("distance_km") < F.col("low_")) | (F.col("distance_km") > F.col("high_"))).drop("low_", "high_").withColumnRenamed("cluster_", "area")  # one row


def _cells(df: DataFrame, metres: float) -> DataFrame:
    """Grid cells of about `metres` (rows of latitude; columns by the row's circle), for points lat, lon."""
    step = math.degrees(metres / RADIUS_M)
    row = F.floor(F.col("lat") / step)
    return df.withColumn("cell_y", row.cast("long")).withColumn("cell_x", _column(row, step))


def _across(row: Column, step: float) -> Column:
    """How much shorter a row's circle is than the equator."""
    return F.greatest(F.cos(F.radians(F.least(F.abs(row), F.abs(row + 1)) * step)), F.lit(0.0))


def _columns(row: Column, step: float) -> Column:
    return F.greatest(F.lit(1), F.ceil(360.0 * _across(row, step) / step)).cast("long")


def _column(row: Column, step: float) -> Column:
    """Cell of lon in a row, counted from -180 degrees; 180 is the same place."""
    return F.pmod(F.floor(F.pmod(F.col("lon") + 180.0, F.lit(360.0)) * _across(row, step) / step).cast("long"), _columns(row, step))


def neighbour_join(points: DataFrame, metres: float, by: Sequence[str] = (), among: DataFrame | None = None) -> DataFrame:
    """by, point, other, n_other, distance of places at most `metres` apart: an equi-join on grid cells and the cells around.

    points has by, point, lat, lon, n (rows at the place): equal places are one, however many rows share it. among: where the
    other places are from, if not from points themselves.
    """
    step = math.degrees(metres / RADIUS_M)
    left = points.withColumn("row_", F.explode(F.sequence(F.floor((F.col("lat")) / step) - 1, F.floor(F.col("lat") / step) + 1)))
    column, n = _column(F.col("row_"), step), _columns(F.col("row_"), step)
    # A row nearer to a pole is up to a cell narrower over 180 degrees; one column to each side covers `metres` in any row. Columns
    # go round, and the last one of a row may be narrower.
    around = F.array_distinct(F.transform(F.sequence(column - 3, column + 3), lambda c: F.pmod(c, n)))
    left = left.withColumn("col_", F.explode(around)).select(*by, "point", F.col("lat").alias("lat_a"), F.col("lon").alias("lon_a"), F.col("row_").alias("cell_y"), F.col("col_").alias("cell_x"))
    right = _cells(points if among is None else among, metres).select(*by, F.col("point").alias("other"), F.col("lat").alias("lat_b"), F.col("lon").alias("lon_b"), F.col("n").alias("n_other"), "cell_y", "cell_x")
    near = left.join(right, [*by, "cell_y", "cell_x"]).withColumn("distance", haversine(F.col("lat_a"), F.col("lon_a"), F.col("lat_b"), F.col("lon_b")))
    return near.where(F.col("distance") <= metres).select(*by, "point", "other", "n_other", "distance")


def places(df: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Distinct coordinates: by, lat, lon, point (hash), n."""
    rows = df.where("latitude IS NOT NULL AND longitude IS NOT NULL")
    return rows.groupBy(*by, F.col("latitude").alias("lat"), F.col("longitude").alias("lon")).agg(F.count("*").alias("n")).withColumn("point", F.xxhash64(*by, "lat", "lon"))


def gps_too_clustered(df: DataFrame, key: str, area: str, threshold: float = 50.0) -> DataFrame:
    """Rows whose nearest other place in their area is nearer than the threshold (metres), with that distance."""
    spots = places(df, [area])
    nearest = neighbour_join(spots, threshold, [area]).where("point <> other").groupBy("point").agg(F.min("distance").alias("nearest"))
    rows = df.where("latitude IS NOT NULL AND longitude IS NOT NULL").withColumn("point", F.xxhash64(area, "latitude", "longitude"))
    return rows.select(key, area, "point").join(nearest, "point", "left").select(key, area, "nearest", F.coalesce(F.col("nearest") < threshold, F.lit(False)).alias("too_clustered"))


def gps_kmeans_areas(df: DataFrame, k: int, seed: int = 0) -> DataFrame:
    """df with `area` from k-means on the coordinates; rows without both have none."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.feature import VectorAssembler

    whole = df.where("latitude IS NOT NULL AND longitude IS NOT NULL")
    vectors = VectorAssembler(inputCols=["latitude", "longitude"], outputCol="at_").transform(whole)
    model = KMeans(k=k, seed=seed, featuresCol="at_", predictionCol="area").fit(vectors)
    return model.transform(vectors).drop("at_").unionByName(df.where("latitude IS NULL OR longitude IS NULL"), allowMissingColumns=True)


#: Metres that level 0 of the cells covers, over half the equator; each level halves them, down to about a metre.
TOP_WIDTH, LEVELS = 20_040_000.0, 24
#: Levels that are counted in one pass; rows of a cell that meet in one task.
AT_ONCE, CELL = 8, 1024


def _step(level: Column) -> Column:
    """Degrees that a cell of the level is high."""
    return F.lit(math.degrees(TOP_WIDTH / RADIUS_M)) / F.pow(F.lit(2.0), level)


def _leveled(spots: DataFrame, least: int) -> DataFrame:
    """spots with `level`: the finest on which a place's own cell holds `least` rows, as in a quadtree that splits by counts.

    Only places whose cell holds enough rows on one level are counted on the next ones.
    """
    found = []
    alive = spots.withColumn("level", F.lit(0))
    for base in range(0, LEVELS, AT_ONCE):
        each = alive.withColumn("finer_", F.explode(F.sequence(F.lit(base + 1), F.lit(base + AT_ONCE))))
        row = F.floor(F.col("lat") / _step(F.col("finer_"))).cast("long")
        each = each.withColumn("cell_y", row).withColumn("cell_x", _column(F.col("cell_y"), _step(F.col("finer_"))))
        full = each.groupBy("finer_", "cell_y", "cell_x").agg(F.sum("n").alias("rows_")).where(F.col("rows_") >= least).drop("rows_")
        best = each.join(full, ["finer_", "cell_y", "cell_x"]).groupBy("point").agg(F.max("finer_").alias("best_"))
        told = written(alive.join(best, "point", "left").withColumn("level", F.coalesce("best_", "level")).drop("best_"))
        done = F.col("level") < base + AT_ONCE
        found.append(told.where(done))
        alive = told.where(~done)
        if alive.isEmpty():
            break
    return reduce(DataFrame.unionByName, [*found, alive])


def _around(left: DataFrame, spots: DataFrame) -> DataFrame:
    """point, other, lat_b, lon_b, n_other, distance: for each place of left the rows of its cell and those around, on its level, as far as a cell is wide.

    A cell of more than CELL places, as where a lone place looks into a town, is dealt in parts, each of which meets all that look into it.
    """
    step = _step(F.col("level"))
    looking = left.withColumn("row_", F.explode(F.sequence(F.floor(F.col("lat") / step).cast("long") - 1, F.floor(F.col("lat") / step).cast("long") + 1)))
    # How far a cell's height reaches along the circles about here, in columns of the row; all of them near a pole.
    reach = F.sin(F.radians(F.least(step, F.lit(90.0)))) / F.cos(F.radians("lat"))
    polar = (F.abs("lat") + step >= 90) | (reach >= 1)
    wide = F.when(polar, 180.0).otherwise(F.degrees(F.asin(F.least(reach, F.lit(1.0)))))
    scale, n = _across(F.col("row_"), step) / step, _columns(F.col("row_"), step)
    place, side = F.pmod(F.col("lon") + 180.0, F.lit(360.0)) * scale, wide * scale * (1 + 1e-9) + 1e-9
    # Columns go round; the last one of a row may be narrower, so one more is looked at where it is passed.
    first, last = F.floor(place - side), F.floor(place + side)
    first, last = F.when(first < 0, first - 1).otherwise(first), F.when(last >= n - 1, last + 1).otherwise(last)
    around = F.array_distinct(F.transform(F.sequence(first.cast("long"), F.least(last, first + n).cast("long")), lambda c: F.pmod(c, n)))
    looking = looking.withColumn("cell_x", F.explode(around)).select("point", "level", F.col("lat").alias("lat_a"), F.col("lon").alias("lon_a"), F.col("row_").alias("cell_y"), "cell_x")
    cell = ["level", "cell_y", "cell_x"]
    levels = [r["level"] for r in left.select("level").distinct().collect()]  # LEVELS at most
    seen = spots.withColumn("level", F.explode(F.array(*map(F.lit, levels)))).withColumn("cell_y", F.floor(F.col("lat") / step).cast("long"))
    seen = seen.withColumn("cell_x", _column(F.col("cell_y"), step)).select(*cell, F.col("point").alias("other"), F.col("lat").alias("lat_b"), F.col("lon").alias("lon_b"), F.col("n").alias("n_other"))
    parts = written(seen.groupBy(*cell).agg(F.ceil(F.count("*") / CELL).cast("int").alias("parts_")).where("parts_ > 1"))
    dealt = lambda df: df.join(parts, cell, "left").withColumn("parts_", F.coalesce("parts_", F.lit(1)))
    looking = dealt(looking).withColumn("part_", F.explode(F.sequence(F.lit(0), F.col("parts_") - 1))).drop("parts_")
    seen = dealt(seen).withColumn("part_", F.pmod(F.xxhash64("other"), F.col("parts_")).cast("int")).drop("parts_")
    near = looking.join(seen, [*cell, "part_"]).withColumn("distance", haversine(F.col("lat_a"), F.col("lon_a"), F.col("lat_b"), F.col("lon_b")))
    return near.where(F.col("distance") <= TOP_WIDTH / F.pow(F.lit(2.0), F.col("level"))).select("point", "other", "lat_b", "lon_b", "n_other", "distance")


def nearest_neighbours(spots: DataFrame, k: int) -> DataFrame:
    """point, other, distance, take: the k nearest rows of each place (a place with n rows counts n times, itself less one).

    Each place looks about in cells of its own level, which hold a few rows each wherever it lies; those that lack neighbours within a
    cell's width look again one level up. Of places that are equally near (to a micrometre) those with the smaller coordinates come
    first. Neighbours are exact; only k places of each part of a cell leave a task.
    """
    total = spots.agg(F.sum("n")).first()[0] or 0
    k = min(k, max(total - 1, 0))
    found, left = [], _leveled(spots, max(2, k // 3))
    while True:
        near = _around(left, spots).withColumn("n_other", F.when(F.col("point") == F.col("other"), F.col("n_other") - 1).otherwise(F.col("n_other"))).where("n_other > 0")
        order = [F.round("distance", 6), F.col("lat_b"), F.col("lon_b")]
        near = near.withColumn("nth_", F.row_number().over(Window.partitionBy("point").orderBy(*order))).where(F.col("nth_") <= k)
        w = Window.partitionBy("point").orderBy("nth_").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        near = written(near.withColumn("rank_", F.sum("n_other").over(w)))
        done = near.groupBy("point").agg(F.max("rank_").alias("have_")).where(F.col("have_") >= k).select("point")
        taken = near.where(F.col("rank_") - F.col("n_other") < k).withColumn("take", F.least(F.col("n_other"), k - (F.col("rank_") - F.col("n_other"))))
        found.append(taken.join(done, "point", "left_semi").select("point", "other", "distance", "take"))
        left = written(left.where("level > 0").join(done, "point", "left_anti").withColumn("level", F.col("level") - 1))
        if left.isEmpty():
            return reduce(DataFrame.unionByName, found)


def gps_lof_outliers(df: DataFrame, key: str, k: int = 20, contamination: float | str = 0.1) -> DataFrame:
    """key, lof, is_outlier: Local Outlier Factor by k nearest neighbours in metres; the `contamination` share with the highest, or with "auto" those over 1.5.

    Per distinct place: k-distance, reachability, its mean's inverse (a small constant keeps it finite where all neighbours
    share the place), then the neighbours' mean density over the own. A row alone has no neighbours: its lof is 1, no outlier.
    Factors that are equal to nine places are equal.
    """
    spots = written(places(df))
    if (spots.agg(F.sum("n")).first()[0] or 0) < 2:
        return df.where("latitude IS NOT NULL AND longitude IS NOT NULL").select(key, F.lit(1.0).alias("lof"), F.lit(False).alias("is_outlier"))
    near = nearest_neighbours(spots, k)
    kdist = near.groupBy("point").agg(F.max("distance").alias("kdist"))
    reach = near.join(kdist.select(F.col("point").alias("other"), F.col("kdist").alias("kdist_other")), "other").withColumn("reach", F.greatest("distance", "kdist_other"))
    lrd = reach.groupBy("point").agg((1 / (F.sum(F.col("reach") * F.col("take")) / F.sum("take") + 1e-10)).alias("lrd"))
    factor = near.join(lrd.select(F.col("point").alias("other"), F.col("lrd").alias("lrd_other")), "other").groupBy("point").agg((F.sum(F.col("lrd_other") * F.col("take")) / F.sum("take")).alias("mean_"))
    lof = factor.join(lrd, "point").select("point", (F.col("mean_") / F.col("lrd")).alias("lof"))
    rows = df.where("latitude IS NOT NULL AND longitude IS NOT NULL").select(key, F.xxhash64("latitude", "longitude").alias("point")).join(lof, "point").select(key, "lof")
    if contamination == "auto":
        return rows.withColumn("is_outlier", F.round("lof", 9) > 1.5)
    return rows.crossJoin(quantiles(rows, [], "lof", {"cut_": 1 - contamination})).select(key, "lof", (F.round("lof", 9) > F.round("cut_", 9)).alias("is_outlier"))  # one row
