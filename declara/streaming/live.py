"""Structured Streaming forms of rule evaluation, duplicate suppression and the daily trend."""

from __future__ import annotations

import datetime as dt
from contextlib import contextmanager

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor
from pyspark.sql.types import ArrayType, MapType, StructField, StructType

from declara.functions.base import rounded
from declara.operators.analytics import mean_of
from declara.operators.rules import check_products

LATENESS = "2 days"
#: Keys that the scans of one day are dealt to, so that a busy day is not one task.
SHARES = 8
DAY_MS = 86_400_000
CHANGES = ("kind string, day_ms bigint, share int, revision int, total_scans bigint, compliant_scans bigint, scored bigint, points bigint, "
           "id bigint, created_ms bigint")
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def evaluate_stream(products: DataFrame, rules: list[dict] | None = None, as_of: dt.date | None = None) -> DataFrame:
    """Rule results and score of arriving product rows: a map over rows, no state."""
    return check_products(products, rules, as_of)


def _earliest_of_batch(key: str, order: list[str]):
    """The earliest row of each key of a partition, and a row without key that carries the latest time seen."""
    def run(batches):
        held = [b for b in batches if len(b)]
        if not held:
            return
        rows = pa.Table.from_batches(held).sort_by([(n, "ascending") for n in order])
        at = pa.table({"key": rows.column(key), "at": pa.array(np.arange(len(rows)))}).filter(pc.field("key").is_valid())
        first = at.group_by("key").aggregate([("at", "min")]).column("at_min")
        mark = pa.table([pa.array(
            [pc.max(rows.column(f.name)).as_py() if f.name == "created_at" else None], f.type) for f in rows.schema], schema=rows.schema)
        yield from pa.concat_tables([rows.take(first), mark]).combine_chunks().to_batches()

    return run


def first_deliveries(scans: DataFrame, key: str = "id", lateness: str = LATENESS) -> DataFrame:
    """Scans without re-deliveries that arrive within the lateness of the first one.

    Of copies that arrive together the earliest counts, in whatever order their files are read: the rows of a micro-batch
    are dealt by key, and a task passes on the earliest of each (it holds its share of the micro-batch for that).  The
    others still move the watermark, through a row without key.  Rows without key are no scans.  The state holds the keys of
    the lateness only.
    """
    schema = StructType([StructField(f.name, f.dataType) for f in scans.schema])
    plain = [f.name for f in schema if f.name != "created_at" and not isinstance(f.dataType, (ArrayType, MapType, StructType))]
    earliest = scans.repartition(key).mapInArrow(_earliest_of_batch(key, ["created_at", *plain]), schema)
    return earliest.withWatermark("created_at", lateness).dropDuplicatesWithinWatermark([key]).filter(F.col(key).isNotNull())


def live_trend(scans: DataFrame, lateness: str = LATENESS) -> DataFrame:
    """Daily trend of arriving scans; a day is emitted once it can no longer change.

    Later rows are dropped here and picked up by a batch run of the trend.
    """
    good = F.count_if(F.col("overall_status") == "COMPLIANT")
    total = F.count(F.lit(1))
    marked = scans if scans.isStreaming is False else scans.withWatermark("created_at", lateness)
    return marked.groupBy(F.window("created_at", "1 day")).agg(
        total.alias("total_scans"), good.alias("compliant_scans"), (total - good).alias("non_compliant_scans"),
        rounded(good * 100 / total.cast("double"), 2).alias("compliance_rate"),
        mean_of("compliance_score", 2, 2).alias("average_score"),
    ).select(F.date_format("window.start", "yyyy-MM-dd").alias("date"), "total_scans", "compliant_scans",
             "non_compliant_scans", "compliance_rate", "average_score")


class DayChanges(StatefulProcessor):
    """Counts of one share of a day, from its first scan to its last correction.

    A timer at the end of the day closes it: its counts leave as revision 0.  Scans that arrive after that are late; each
    is put out as such, and what they add leaves as the next revision.  The counts are kept, so a day can be
    corrected for as long as the stream runs; a closed day holds five numbers.
    """

    def init(self, handle) -> None:
        self.handle = handle
        self.counts = handle.getValueState("counts", "total bigint, good bigint, scored bigint, points bigint, revision int")

    def _change(self, key, revision: int, counts) -> pd.DataFrame:
        return pd.DataFrame({"kind": ["day"], "day_ms": [key[0]], "share": [key[1]], "revision": [revision], "total_scans": [counts[0]],
                             "compliant_scans": [counts[1]], "scored": [counts[2]], "points": [counts[3]], "id": pd.array([None], "Int64"),
                             "created_ms": pd.array([None], "Int64")})

    def handleInputRows(self, key, rows, timerValues):
        held = self.counts.get() if self.counts.exists() else None
        total, good, scored, points, revision = held or (0, 0, 0, 0, -1)
        closed = revision >= 0 or timerValues.getCurrentWatermarkInMs() >= key[0] + DAY_MS
        more = [0, 0, 0, 0]
        for part in rows:
            part = part[part["id"].notna()]  # rows without id only move the watermark
            if not len(part):
                continue
            more[0] += len(part)
            more[1] += int((part["good"] > 0).sum())
            more[2] += int(part["points"].notna().sum())
            more[3] += int(part["points"].fillna(0).sum())
            if closed:
                nothing = pd.array([None] * len(part), "Int64")
                yield pd.DataFrame({"kind": "late", "day_ms": key[0], "share": key[1], "revision": revision + 1, "total_scans": nothing,
                                    "compliant_scans": nothing, "scored": nothing, "points": nothing,
                                    "id": part["id"].astype("Int64").array, "created_ms": part["created_ms"].astype("Int64").array})
        if not more[0]:
            return
        if closed:
            revision += 1
            yield self._change(key, revision, more)
        elif held is None:
            self.handle.registerTimer(key[0] + DAY_MS)
        self.counts.update((total + more[0], good + more[1], scored + more[2], points + more[3], revision))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        total, good, scored, points, _ = self.counts.get()
        self.counts.update((total, good, scored, points, 0))
        yield self._change(key, 0, (total, good, scored, points))

    def close(self) -> None:
        pass


def trend_changes(scans: DataFrame, lateness: str = LATENESS, shares: int = SHARES) -> DataFrame:
    """Changes of the daily trend of a stream of scans (id, created_at, overall_status, compliance_score).

    Rows of kind ``day`` add to a day: revision 0 once the watermark has passed its end, later ones for late scans.
    Rows of kind ``late`` name the late scans.  A row without id is no scan; its time moves the watermark, so a feed that
    ends can close its last days.  Late scans are not dropped: the watermark sets the timers, but does not filter the rows.
    Run it under ``rocks_state``.
    """
    ms = F.unix_millis("created_at")
    marked = scans.withWatermark("created_at", lateness)
    slim = marked.filter(F.col("created_at").isNotNull()).select(
        (ms - F.pmod(ms, F.lit(DAY_MS))).alias("day_ms"), F.coalesce(F.pmod(F.xxhash64("id"), F.lit(shares)), F.lit(0)).cast("int").alias("share"),
        "id", ms.alias("created_ms"), F.when(F.col("overall_status") == "COMPLIANT", 1).otherwise(0).alias("good"),
        F.round(F.col("compliance_score") * 100).cast("double").alias("points"))
    return slim.groupBy("day_ms", "share").transformWithStateInPandas(DayChanges(), CHANGES, "append", "eventtime")


def corrected_trend(changes: DataFrame) -> DataFrame:
    """The daily trend that the changes put out so far add up to, in the columns of the batch trend."""
    total, good, scored = F.sum("total_scans"), F.sum("compliant_scans"), F.sum("scored")
    mean = F.coalesce(rounded((F.sum("points") / F.lit(100)).cast("double") / scored, 2), F.lit(0.0))
    return changes.filter("kind = 'day'").groupBy(F.date_format(F.timestamp_millis("day_ms"), "yyyy-MM-dd").alias("date")).agg(
        total.alias("total_scans"), good.alias("compliant_scans"), (total - good).alias("non_compliant_scans"),
        rounded(good * 100 / total.cast("double"), 2).alias("compliance_rate"), mean.alias("average_score"),
        F.max("revision").alias("revisions"))


def late_scans(changes: DataFrame) -> DataFrame:
    """Scans that arrived after their day was closed."""
    return changes.filter("kind = 'late'").select("id", F.timestamp_millis("created_ms").alias("created_at"), "revision")


@contextmanager
def rocks_state(spark: SparkSession):
    """Streams with timers keep their state in the RocksDB store, which comes with Spark."""
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name, None)
    spark.conf.set(name, ROCKS)
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def run_available(stream: DataFrame, path: str, checkpoint: str, mode: str = "append") -> None:
    """Process everything that is there and stop; the sink is exactly-once through its checkpoint."""
    query = (stream.writeStream.format("parquet").outputMode(mode).option("path", path)
             .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
    query.awaitTermination()


def read_products(spark: SparkSession, folder: str, schema: str, max_files: int = 100) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files).parquet(folder)
