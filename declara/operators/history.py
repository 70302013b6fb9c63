"""Store, look up, page through and delete scan records."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from declara.functions.base import filled, rounded
from declara.operators.analytics import in_range

PAGE_COLUMNS = ["id", "product_name", "overall_status", "compliance_score", "created_at", "image_path",
                "officer_id", "compliance_result", "authenticity_result", "extracted_data", "visual_statistics"]


def shape_scan_records(payloads: DataFrame) -> DataFrame:
    """Fill status, score and name of incoming scans from their JSON documents.

    A status keeps the part after its last dot, the score gets two decimals.  ``id`` comes from
    the caller; ``scan_date`` is the partition column of the stored table.
    """
    def column(name: str) -> Column:
        return F.col(name).cast("string") if name in payloads.columns else F.lit(None).cast("string")

    status = F.coalesce(column("overall_status"), F.get_json_object("compliance_result", "$.overall_status"), F.lit("UNKNOWN"))
    points = F.coalesce(column("compliance_score"), F.get_json_object("compliance_result", "$.compliance_score"), F.lit("0"))
    name = F.coalesce(column("product_name"), F.get_json_object("extracted_data", "$.product_name.value"))
    return payloads.withColumns({
        "overall_status": F.element_at(F.split(status, r"\."), -1),
        "compliance_score": rounded(points.cast("double"), 2),
        "product_name": name,
        "scan_date": F.to_date("created_at"),
    })


def scan_by_id(scans: DataFrame, scan_id: int) -> DataFrame:
    return scans.filter(F.col("id") == scan_id).limit(1)


def filter_scans(scans: DataFrame, status: str | None = None, officer_id: int | None = None,
                 product_name: str | None = None, date_from: dt.datetime | None = None,
                 date_to: dt.datetime | None = None) -> DataFrame:
    """Optional filters; officer 0 means any, ``%`` and ``_`` in the name act as wildcards."""
    out = scans
    if status:
        out = out.filter(F.col("overall_status") == status.upper())
    if officer_id:
        out = out.filter(F.col("officer_id") == officer_id)
    if product_name:
        out = out.filter(F.col("product_name").ilike(f"%{product_name}%"))
    return in_range(out, date_from, date_to)


def scan_page(scans: DataFrame, limit: int = 50, offset: int = 0, **filters) -> DataFrame:
    """One page, newest first, equal times by id."""
    return filter_scans(scans, **filters).orderBy(F.desc("created_at"), F.asc("id")).offset(offset).limit(limit)


def deep_page(scans: DataFrame, limit: int = 50, offset: int = 0, at_once: int = 100_000, **filters) -> DataFrame:
    """The same page however far back it lies, without sorting what stands before it.

    Scans are counted per day, then, inside the days that hold the page, per hour, minute and second, until at most
    ``at_once`` rows of these ranges are left; only they are read and sorted.  The ranges that hold a page are ``limit`` at most.
    Scans without a time come last.
    """
    chosen, skip = filter_scans(scans, **filters), offset
    timed = chosen.filter(F.col("created_at").isNotNull())
    for unit in ("day", "hour", "minute", "second"):
        start = F.date_trunc(unit, F.col("created_at").cast("timestamp"))
        counted = timed.groupBy(start.alias("s")).agg(F.count(F.lit(1)).alias("n"))
        after = F.sum("n").over(Window.orderBy(F.desc("s")))
        held = (counted.withColumn("after", after).filter((F.col("after") > skip) & (F.col("after") - F.col("n") < skip + limit))
                .orderBy(F.desc("s")).collect())
        if not held:  # the page lies among the scans without a time, if anywhere
            before = counted.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
            return chosen.filter(F.col("created_at").isNull()).orderBy("id").offset(max(0, skip - before)).limit(limit)
        first, last = held[-1]["s"], held[0]["s"]
        total, skip = held[-1]["after"] - (held[0]["after"] - held[0]["n"]), skip - (held[0]["after"] - held[0]["n"])
        timed = timed.filter((start >= F.lit(first)) & (start <= F.lit(last)))
        if total <= at_once:
            break
    here = total - skip
    if here >= limit:
        return timed.orderBy(F.desc("created_at"), F.asc("id")).offset(skip).limit(limit)
    untimed = chosen.filter(F.col("created_at").isNull())
    return timed.unionByName(untimed).orderBy(F.desc_nulls_last("created_at"), F.asc("id")).offset(skip).limit(limit)


def scan_total(scans: DataFrame, **filters) -> DataFrame:
    """Number of scans behind a filtered page, as one row."""
    return filter_scans(scans, **filters).agg(F.count(F.lit(1)).alias("total"))


def iso_time(col: Column) -> Column:
    """ISO text with microseconds only where there are any."""
    base = F.date_format(col, "yyyy-MM-dd'T'HH:mm:ss")
    micros = F.date_format(col, "SSSSSS")
    return F.when(micros == "000000", base).otherwise(F.concat(base, F.lit("."), micros))


def page_projection(page: DataFrame) -> DataFrame:
    """The columns of a history page with ISO times; documents the table lacks are NULL."""
    cols = []
    for name in PAGE_COLUMNS:
        if name not in page.columns:
            cols.append(F.lit(None).cast("string").alias(name))
        elif name == "created_at":
            cols.append(iso_time(F.col(name)).alias(name))
        else:
            cols.append(F.col(name))
    return page.select(*cols)


def delete_scans(scans: DataFrame, ids: DataFrame) -> DataFrame:
    """Scans that remain once the listed ids are gone (write them to a new location)."""
    return scans.join(ids.select("id").distinct(), "id", "left_anti")


def deletion_report(scans: DataFrame, ids: DataFrame) -> DataFrame:
    """For every requested id whether a scan with it existed."""
    known = scans.join(ids.select("id").distinct(), "id", "left_semi").select("id").distinct().withColumn("deleted", F.lit(True))
    return ids.select("id").distinct().join(known, "id", "left").select("id", F.coalesce("deleted", F.lit(False)).alias("deleted"))


def compliance_aggregates(scans: DataFrame) -> DataFrame:
    """Totals, rate, mean score and status distribution as one row, in one pass over the scans."""
    per_status = scans.groupBy("overall_status").agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.col("compliance_score").cast("decimal(20,2)")).alias("s"))

    def count_of(*names: str) -> Column:
        return F.coalesce(F.sum(F.when(F.col("overall_status").isin(*names), F.col("n"))), F.lit(0))

    total = F.coalesce(F.sum("n"), F.lit(0))
    return per_status.agg(
        total.alias("total_scans"), count_of("COMPLIANT").alias("compliant_count"),
        count_of("NON_COMPLIANT", "POTENTIALLY_NON_COMPLIANT").alias("non_compliant_count"),
        F.when(total > 0, rounded(count_of("COMPLIANT") * 100 / total.cast("double"), 2)).otherwise(0.0).alias("compliance_rate"),
        F.when(total > 0, rounded(F.sum("s").cast("double") / total.cast("double"), 2)).otherwise(0.0).alias("average_score"),
        F.map_from_entries(F.array_sort(F.collect_list(F.struct(
            F.coalesce(filled(F.col("overall_status")), F.lit("None")), "n")))).alias("status_distribution"))


def with_officers(scans: DataFrame, officers: DataFrame) -> DataFrame:
    """Scans with the columns of the officer who made them; the officer table holds no secrets."""
    safe = officers.drop("hashed_password")
    renamed = safe.select(*[F.col(n).alias("officer_id" if n == "id" else f"officer_{n}") for n in safe.columns])
    return scans.join(renamed, "officer_id", "left")
