"""Dashboard aggregates over scans and their rule rows.

Scores and heights are summed as decimals: the result does not depend on how rows are spread.
Rule rows hold scan_id, pos, rule_id, declaration, status and, where measured, text heights.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from declara import catalog as c
from declara.functions.base import filled, rounded, strip

BAD = ["FAIL", "WARNING"]


def rate(part: Column, whole: Column, digits: int = 2) -> Column:
    """Percentage with 0.0 for an empty whole."""
    return F.when(whole > 0, rounded(part * 100 / whole.cast("double"), digits)).otherwise(F.lit(0.0))


def mean_of(col: str, scale: int, digits: int) -> Column:
    """Mean over the rows that have a value, from an exact sum; 0.0 for none."""
    total = F.sum(F.col(col).cast(f"decimal(24,{scale})")).cast("double")
    return F.coalesce(rounded(total / F.count(col), digits), F.lit(0.0))


def parse_bound(value: str | dt.date | dt.datetime | None) -> dt.datetime | None:
    """Lenient bound of a time range: ISO text, 'Z' suffix or date; anything else is no bound.

    A bound without zone is UTC, whatever the zone of the machine or the session.
    """
    if value is None:
        return None
    if isinstance(value, str):
        try:
            value = dt.datetime.fromisoformat(value.replace("Z", "+00:00"))
        except ValueError:
            return None
    if not isinstance(value, dt.datetime):
        value = dt.datetime.combine(value, dt.time())
    return (value if value.tzinfo else value.replace(tzinfo=dt.timezone.utc)).astimezone(dt.timezone.utc)


def in_range(scans: DataFrame, start=None, end=None) -> DataFrame:
    """Scans inside inclusive bounds; an end given as a day means its midnight."""
    lo, hi = parse_bound(start), parse_bound(end)
    out = scans
    if lo is not None:
        out = out.filter(F.col("created_at") >= F.lit(lo))
    if hi is not None:
        out = out.filter(F.col("created_at") <= F.lit(hi))
    return out


def summary(scans: DataFrame) -> DataFrame:
    """Totals, compliance rate and mean score; partly reviewed scans are in neither count."""
    compliant = F.count_if(F.col("overall_status") == "COMPLIANT")
    total = F.count(F.lit(1))
    return scans.agg(
        total.alias("total_scans"), compliant.alias("compliant_scans"),
        F.count_if(F.col("overall_status").isin("NON_COMPLIANT", "POTENTIALLY_NON_COMPLIANT")).alias("non_compliant_scans"),
        rate(compliant, total).alias("compliance_rate"),
        mean_of("compliance_score", 2, 2).alias("average_compliance_score"))


def short_name(declaration: Column) -> Column:
    """Declaration text up to its first bracket."""
    return strip(F.get(F.split(declaration, r"\("), F.lit(0)))


def seed_fields(spark) -> DataFrame:
    """The ten standard fields, in catalogue order, as rows."""
    rows = F.array(*[F.struct(
        F.lit(i).alias("field_order"), F.lit(field).alias("field_name"), F.lit(rule).alias("seed_rule"),
        F.lit(field.replace("_", " ").title()).alias("seed_name"))
        for i, (rule, field) in enumerate(c.EVIDENCE_FIELD.items())])
    return spark.range(1).select(F.inline(rows))


def violation_rates(scans: DataFrame, rows: DataFrame) -> DataFrame:
    """Evaluations, violations and rate per declared field; standard fields stay with zeros.

    The name shown is that of the last evaluation (scan time, id, position).  ``rows`` may carry
    ``created_at`` itself; otherwise it is joined from the scans by ``scan_id``.
    """
    timed = rows if "created_at" in rows.columns else rows.join(
        scans.select(F.col("id").alias("scan_id"), "created_at"), "scan_id")
    mapping = F.create_map(*[F.lit(x) for pair in c.EVIDENCE_FIELD.items() for x in pair])
    field = F.coalesce(mapping[F.col("rule_id")], F.lower("rule_id"))
    stats = timed.select(
        field.alias("field_name"), "rule_id", "status", "created_at", "scan_id", "pos",
        F.coalesce("declaration", field).alias("declaration"),
    ).groupBy("field_name").agg(
        F.count(F.lit(1)).alias("total_evaluations"),
        F.count_if(F.col("status").isin(BAD)).alias("violation_count"),
        F.max_by(F.struct("rule_id", "declaration"),
                 F.struct("created_at", "scan_id", "pos", "declaration")).alias("last"))
    out = seed_fields(rows.sparkSession).join(stats, "field_name", "full")
    total = F.coalesce("total_evaluations", F.lit(0))
    bad = F.coalesce("violation_count", F.lit(0))
    return out.select(
        "field_name", F.coalesce("last.rule_id", "seed_rule").alias("rule_id"),
        F.coalesce(short_name(F.col("last.declaration")), F.col("seed_name")).alias("declaration_name"),
        total.alias("total_evaluations"), bad.alias("violation_count"), rate(bad, total).alias("violation_rate"),
        F.coalesce("field_order", F.lit(len(c.EVIDENCE_FIELD))).alias("field_order"),
    ).orderBy(F.desc("violation_count"), F.desc("violation_rate"), "field_order", "field_name")


def field_share(rates: DataFrame) -> DataFrame:
    """Share of each field in all violations, whole percent; 1 stands in for no violations."""
    total = F.coalesce(rates.agg(F.sum("violation_count")).scalar(), F.lit(0))
    whole = F.when(total > 0, total).otherwise(1)
    return rates.withColumn("percentage", rounded(F.col("violation_count") * 100 / whole.cast("double"), 0).cast("int"))


def daily_trend(scans: DataFrame) -> DataFrame:
    """Scans per day; everything that is not compliant counts as non-compliant here."""
    day = F.coalesce(F.date_format("created_at", "yyyy-MM-dd"), F.lit("Unknown"))
    good = F.count_if(F.col("overall_status") == "COMPLIANT")
    total = F.count(F.lit(1))
    return scans.groupBy(day.alias("date")).agg(
        total.alias("total_scans"), good.alias("compliant_scans"), (total - good).alias("non_compliant_scans"),
        rate(good, total).alias("compliance_rate"), mean_of("compliance_score", 2, 2).alias("average_score"),
    ).orderBy("date")


def top_brands(scans: DataFrame, rows: DataFrame, n: int = 10) -> DataFrame:
    """Brands with most non-compliant scans, then lowest mean score, with their commonest violation.

    Of equally common violations the one seen first counts.  Rule rows are cut to violations
    before they meet the scans, and counted per brand and name before they are compared.
    """
    brand = F.coalesce(filled(F.col("product_name")), F.lit("Unlabeled Commodity"))
    bad_scan = F.count_if(F.coalesce(F.col("overall_status") != "COMPLIANT", F.lit(True)))
    total = F.count(F.lit(1))
    named = scans.withColumn("brand_name", brand)
    stats = named.groupBy("brand_name").agg(
        total.alias("total_scans"), bad_scan.alias("non_compliant_scans"),
        rate(bad_scan, total).alias("non_compliance_rate"), mean_of("compliance_score", 2, 2).alias("average_compliance_score"))
    hits = rows.filter(F.col("status").isin(BAD)).select(
        "scan_id", "pos", short_name(F.coalesce("declaration", F.lit("Unknown Declaration"))).alias("name"))
    seen = hits.join(named.select(F.col("id").alias("scan_id"), "brand_name", "created_at"), "scan_id")
    counted = seen.groupBy("brand_name", "name").agg(
        F.count(F.lit(1)).alias("n"), F.min(F.struct("created_at", "scan_id", "pos")).alias("first"))
    common = counted.groupBy("brand_name").agg(
        F.min_by("name", F.struct(-F.col("n"), F.col("first"), F.col("name"))).alias("most_common_violation"))
    top = stats.orderBy(F.desc("non_compliant_scans"), "average_compliance_score", "brand_name").limit(n)
    return top.join(common, "brand_name", "left").withColumn(
        "most_common_violation", F.coalesce("most_common_violation", F.lit("None"))
    ).orderBy(F.desc("non_compliant_scans"), "average_compliance_score", "brand_name")


def authenticity_rate(scans: DataFrame) -> DataFrame:
    """Verdict counts and mean similarity over the scans that hold a verdict or a similarity."""
    def n(verdict: str) -> Column:
        return F.count_if(F.col("verdict") == verdict)

    checked = scans.filter(F.col("verdict").isNotNull() | F.col("similarity_score").isNotNull())
    total = F.count(F.lit(1))
    return checked.agg(
        total.alias("total_scans_evaluated"), n("GENUINE_LIKELY").alias("genuine_count"),
        n("SUSPICIOUS").alias("suspicious_count"), n("NO_REFERENCE_AVAILABLE").alias("no_reference_count"),
        rate(n("SUSPICIOUS"), total).alias("suspicious_flag_rate"),
        mean_of("similarity_score", 8, 4).alias("average_similarity_score"))


def text_heights(rows: DataFrame) -> DataFrame:
    """Histogram of measured text heights; a zero or missing pixel height falls back to the second one."""
    height = F.coalesce(F.nullif(F.col("pixel_text_height"), F.lit(0.0)), F.col("text_height_pixels"))
    h = F.col("h")
    total = F.count("h")
    low = F.count_if(h < c.MIN_HEIGHT_PX)
    return rows.select(height.alias("h")).filter(h.isNotNull()).agg(
        F.count_if(h < c.WARN_HEIGHT_PX).alias("under_8px"),
        F.count_if((h >= c.WARN_HEIGHT_PX) & (h < c.MIN_HEIGHT_PX)).alias("between_8_12px"),
        F.count_if((h >= c.MIN_HEIGHT_PX) & (h < c.STANDARD_HEIGHT_PX)).alias("between_12_24px"),
        F.count_if(h >= c.STANDARD_HEIGHT_PX).alias("over_24px"),
        total.alias("total_regions_evaluated"), mean_of("h", 6, 1).alias("average_text_height_px"),
        rate(low, total).alias("percentage_below_minimum"))


def results_with_status(rows: DataFrame, status: str = "ALL") -> DataFrame:
    return rows if status == "ALL" else rows.filter(F.col("status") == status)


def result_counts(rows: DataFrame, *keys: str) -> DataFrame:
    """Passed, failed and warned results per key."""
    return rows.groupBy(*keys).agg(*[
        F.count_if(F.col("status") == s).alias(n) for s, n in (
            ("PASS", "pass_count"), ("FAIL", "fail_count"), ("WARNING", "warn_count"))])
