"""Checks on streams of submissions; each is the twin of a batch operator."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Mapping, Sequence
from typing import Any

import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from surveyqc.operators.outliers import Bounds, constraint_violations
from surveyqc.streaming import keyed_table


def counter(keys: Sequence[str], most: int = 1 << 18) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """For mapInArrow: counts of a task's rows (keys, at_) by the keys, and rows of no count with the latest time: keys, n_, at_. A task holds about `most` rows."""
    names = [*keys, "n_", "at_"]

    def merged(held: list[pa.Table]) -> pa.Table:
        return pa.concat_tables(held).group_by(list(keys)).aggregate([("n_", "sum"), ("at_", "max")]).select([*keys, "n__sum", "at__max"]).rename_columns(names)

    def given(counts: pa.Table) -> Iterator[pa.RecordBatch]:
        clock = dict.fromkeys(keys) | {"n_": 0, "at_": pc.max(counts["at_"]).as_py()}
        counts = counts.set_column(len(keys) + 1, "at_", pa.nulls(len(counts), pa.int64()))
        yield from pa.concat_tables([counts, pa.Table.from_pylist([clock], counts.schema)]).to_batches()

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []
        for batch in batches:
            held.append(pa.table([*[batch[c] for c in keys], pa.repeat(pa.scalar(1, pa.int64()), len(batch)), batch["at_"]], names))
            if sum(map(len, held)) > most:
                held = [merged(held)]
                if len(held[0]) > most // 2:
                    yield from given(held.pop())
        if sum(map(len, held)):
            yield from given(merged(held))

    return counted


def _lengths(spark: SparkSession, *periods: str) -> list[int]:
    """Microseconds of periods as Spark's windows read them."""
    windows = [F.window(F.timestamp_micros(F.lit(0)), p) for p in periods]
    return [spark.range(1).select(w.alias("w")).select(F.unix_micros("w.end") - F.unix_micros("w.start")).first()[0] for w in windows]


#: So that a value of `by` reads back as it was.
JSON = {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX", "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"}


def windowed_counts(events: DataFrame, time: str, by: Sequence[str], period: str, slide: str | None, delay: str, buckets: int = 1024) -> DataFrame:
    """date (a window's first), by, submissions, late: rows of each window, once when the watermark has passed its end, and rows that came after, as they come.

    A row is late in a window whose end is before the watermark, the greatest time of earlier batches less the delay. Each task counts
    its rows first, by `by` and the panes that windows are made of; a count has no clock, so that Spark never drops it, and a row of no
    count beside them carries the task's latest time as the watermark's clock. So no row is lost: counts and late rows of closed windows
    add up to all of theirs. The state is a row a bucket of `by` (without it, of windows) with the counts of open windows, as a call for
    each value takes milliseconds; a bucket fits in memory. Rows without a time are in no window. Output mode append; sums over a
    window's rows are final but for what is still late. A checkpoint belongs to one number of buckets.
    """
    length, step = _lengths(events.sparkSession, period, slide or period)
    pane, kind = math.gcd(length, step), events.select(*by).schema
    key = F.to_json(F.struct(*by), JSON) if by else F.lit("{}")
    timed = events.select(key.alias("key_"), F.unix_micros(F.col(time).cast("timestamp")).alias("at_")).where("at_ IS NOT NULL")
    panes = timed.select("key_", (F.col("at_") - F.pmod("at_", F.lit(pane))).alias("pane_"), "at_")
    counted = panes.mapInArrow(counter(["key_", "pane_"]), "key_ string, pane_ long, n_ long, at_ long")
    # The ends of a pane's windows: starts are multiples of the step, over the pane less the length and up to it. There may be none.
    first = F.col("pane_") - length + step - F.pmod(F.col("pane_") - length, F.lit(step)) + length
    last = F.col("pane_") - F.pmod("pane_", F.lit(step)) + length
    rows = counted.select("key_", F.timestamp_micros("at_").alias("clock_"), "n_", F.coalesce(first, F.lit(0)).alias("first_"), F.coalesce(last, F.lit(0)).alias("last_")).withWatermark("clock_", delay)
    if not by:
        ends = F.explode(F.when(F.col("first_") <= F.col("last_"), F.sequence("first_", "last_", F.lit(step))))
        rows = rows.withColumn("end_", ends).withColumns({"first_": F.col("end_"), "last_": F.col("end_")}).drop("end_")
    dealt = rows.withColumn("bucket_", F.pmod(F.xxhash64("key_" if by else "first_"), F.lit(buckets)))

    def count(_: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        mark, still, late = state.getCurrentWatermarkMs(), {}, {}
        if state.exists:
            keys, ends, counts = state.get
            still = dict(zip(zip(keys, ends, strict=True), counts, strict=True))
        if not state.hasTimedOut:
            for f in frames:
                for own, n, low, high in zip(*[f[c].tolist() for c in ("key_", "n_", "first_", "last_")], strict=True):
                    for end in range(low, high + 1, step) if n else ():
                        to = late if end // 1000 < mark else still
                        to[own, end] = to.get((own, end), 0) + n
        done = {k: n for k, n in still.items() if k[1] // 1000 + 1 < mark}
        still = {k: n for k, n in still.items() if k not in done}
        if still:
            keys, ends = zip(*still, strict=True)
            state.update((list(keys), list(ends), list(still.values())))
            state.setTimeoutTimestamp(max(min(ends) // 1000 + 1, 1))
        elif state.exists:
            state.remove()
        if out := [(*k, n, 0) for k, n in done.items()] + [(*k, 0, n) for k, n in late.items()]:
            yield pd.DataFrame(out, columns=["key_", "end_", "submissions", "late"])

    closed = dealt.groupBy("bucket_").applyInPandasWithState(
        count, "key_ string, end_ long, submissions long, late long", "keys array<string>, ends array<long>, counts array<long>", "append", GroupStateTimeout.EventTimeTimeout
    )
    values = F.from_json("key_", kind, JSON)
    return closed.select(F.to_date(F.timestamp_micros(F.col("end_") - length)).alias("date"), *[values[c].alias(c) for c in by], "submissions", "late")


def stream_submissions_by_day(events: DataFrame, time: str, period: str = "1 day", delay: str = "2 days") -> DataFrame:
    """date, submissions, late: rows by day, and those that came too late for it (see windowed_counts)."""
    return windowed_counts(events, time, [], period, None, delay)


def stream_constraint_flags(events: DataFrame, ids: Sequence[str], bounds: Mapping[str, Bounds]) -> DataFrame:
    return constraint_violations(events, ids, bounds)


def stream_dedupe_key(events: DataFrame, key: str, time: str, delay: str = "2 days") -> DataFrame:
    """The first row of a key; repeats within the delay are dropped, and state is forgotten after it."""
    return events.withWatermark(time, delay).dropDuplicatesWithinWatermark([key])


def stream_enumerator_activity(events: DataFrame, time: str, enumerator: str, delay: str = "2 days") -> DataFrame:
    """from_date, enumerator, submissions, late: rows of each enumerator in 7 days, ending each day, and late ones (see windowed_counts)."""
    return windowed_counts(events, time, [enumerator], "7 days", "1 day", delay).withColumnRenamed("date", "from_date")


def stream_upsert(events: DataFrame, folder: str, key: str, checkpoint: str, time: str | None = None, buckets: int = 64) -> Any:
    """Merges each micro-batch into the keyed table under the folder (keyed_table.read reads it); a repeated batch writes the same again.

    Of all rows of a key, of whatever batch, the latest by `time` stays, ties by all columns; without `time`, the largest row. The
    folder belongs to the checkpoint: both are kept or dropped together.
    """

    def each(batch: DataFrame, number: int) -> None:
        keyed_table.merge(batch, folder, number, key, time, buckets)

    return events.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
