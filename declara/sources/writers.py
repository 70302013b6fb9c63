"""Sinks: scan table, CSV audit record, JSON document index, brand references."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from declara import schemas
from declara.operators import exports
from declara.operators.brands import register_brands
from declara.operators.history import shape_scan_records
from declara.session import stored


def append_scans(payloads: DataFrame, path: str) -> None:
    """Append incoming scans to the scan table, one folder per day.

    Rows of a day are brought together first, so a day gets few files; a day larger than the
    advisory partition size is split by adaptive execution.
    """
    shaped = shape_scan_records(payloads)
    shaped.hint("rebalance", "scan_date").write.mode("append").partitionBy("scan_date").parquet(path)


def write_csv_audit(scans: DataFrame, path: str, compression: str = "gzip") -> dict[str, str]:
    """The three sections of the audit record of normalised scans, one CSV folder each.

    The scans are stored once and every section is written from that table, so they are not put together
    three times.  The files are compressed (``none`` writes them plain); Spark reads both alike.
    """
    used = ["scan_id", "product_name", "overall_status", "compliance_score", "created_at_str", "officer", "compliance", "extracted"]
    scans = stored(scans.select(*used), "audit-scans")
    sections = {"overview": exports.overview_rows(scans), "declarations": exports.flattened_fields(scans),
                "assessment": exports.rule_rows(exports.result_rows(scans))}
    for name, df in sections.items():
        df.write.mode("overwrite").option("header", True).option("compression", compression).csv(f"{path}/{name}")
    return {name: f"{path}/{name}" for name in sections}


def write_document_index(index: DataFrame, path: str) -> None:
    """Document index as JSON lines, one record per document."""
    index.write.mode("overwrite").json(path)


def save_brands(spark: SparkSession, new: DataFrame, source: str | None, target: str) -> None:
    """Register brand references: the table at ``source`` plus ``new``, written to ``target``."""
    existing = None if source is None else spark.read.schema(schemas.BRANDS).parquet(source)
    register_brands(existing, new).write.mode("overwrite").parquet(target)


def write_rules(rules: DataFrame, path: str) -> None:
    """Rule catalogue as one JSON array, in the order of ``rule_no``; a catalogue is one file."""
    entry = F.struct("rule_no", F.struct(*[n for n in rules.columns if n != "rule_no"]).alias("r"))
    array = F.to_json(F.transform(F.array_sort(F.collect_list(entry)), lambda e: e["r"]))
    rules.agg(array.alias("value")).write.mode("overwrite").text(path)


def write_regions(regions: DataFrame, path: str) -> None:
    """Region rows (image_id, engine, pos, text, confidence, bounding_box) as Parquet."""
    names = [f.split()[0] for f in schemas.REGIONS.split(", ")]
    regions.select(*names).write.mode("overwrite").parquet(path)


def _replace_days(spark: SparkSession, path: str, days: list, rows: DataFrame) -> None:
    """Put ``rows`` in place of the partitions of ``days``; other days keep their files.

    The rows are written beside the table first, so the table is never read while it changes; Spark then moves whole
    day folders into place when the write commits.  Days of which nothing is left lose their folder.
    """
    kept = stored(rows, "days")
    left = {r[0] for r in kept.select("scan_date").distinct().collect()}
    if left:
        (kept.hint("rebalance", "scan_date").write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
         .partitionBy("scan_date").parquet(path))
    for day in days:
        if day not in left:
            folder = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/scan_date={day.isoformat()}")
            folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def _days_of(rows: DataFrame) -> list:
    """Touched days, at most one per calendar day; a scan table has no scan without a day."""
    return [r[0] for r in rows.select("scan_date").distinct().collect()]


def delete_stored(spark: SparkSession, path: str, ids: DataFrame) -> None:
    """Remove the listed ids (column ``id``) from the stored scan table; only the days that hold them are rewritten."""
    scans = spark.read.schema(schemas.SCANS).parquet(path)
    gone = stored(ids.select("id").distinct(), "gone")
    days = _days_of(scans.select("id", "scan_date").join(gone, "id", "left_semi"))
    if days:
        _replace_days(spark, path, days, scans.filter(F.col("scan_date").isin(days)).join(gone, "id", "left_anti"))


def upsert_stored(spark: SparkSession, path: str, payloads: DataFrame) -> None:
    """Store scans in place of those of the same id; only the days that hold an old or a new version are rewritten.

    Of several payloads of one id the latest counts, and of these the one whose columns come last.
    """
    scans = spark.read.schema(schemas.SCANS).parquet(path)
    names = scans.columns
    shaped = shape_scan_records(payloads)
    shaped = shaped.select(*[F.col(n).cast(scans.schema[n].dataType).alias(n) if n in shaped.columns
                             else F.lit(None).cast(scans.schema[n].dataType).alias(n) for n in names])
    rest = [n for n in names if n != "id"]
    new = stored(shaped.groupBy("id").agg(F.max_by(F.struct(*rest), F.struct("created_at", F.to_json(F.struct(*rest)))).alias("r"))
                 .select("id", "r.*").select(*names), "new")
    days = sorted({*_days_of(scans.select("id", "scan_date").join(new.select("id"), "id", "left_semi")), *_days_of(new)})
    if days:
        old = scans.filter(F.col("scan_date").isin(days)).join(new.select("id"), "id", "left_anti")
        _replace_days(spark, path, days, old.unionByName(new))


def rewrite_without(scans: DataFrame, ids: DataFrame, target: str) -> None:
    """Scan table without the listed ids, written to a new location."""
    from declara.operators.history import delete_scans
    kept = delete_scans(scans, ids)
    if "scan_date" not in kept.columns:
        kept = kept.withColumn("scan_date", F.to_date("created_at"))
    kept.hint("rebalance", "scan_date").write.mode("overwrite").partitionBy("scan_date").parquet(target)
