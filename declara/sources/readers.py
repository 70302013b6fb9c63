"""Readers: rule catalogue, document index and texts, label tables, stored scans, engine rows."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from declara import catalog as c
from declara import schemas
from declara.functions.base import rounded, strip
from declara.functions.geometry import polygon
from declara.operators.analytics import in_range


def read_rules(spark: SparkSession, path: str) -> DataFrame:
    """Rule catalogue from a JSON array; a missing file is an error.  ``rule_no`` is its order: one file is one split."""
    rows = spark.read.schema(schemas.RULES).json(path, multiLine=True, mode="FAILFAST")
    return rows.withColumn("rule_no", F.monotonically_increasing_id()).withColumns({
        "mandatory": F.coalesce("mandatory", F.lit(True)), "conditional": F.coalesce("conditional", F.lit(False)),
        "severity": F.coalesce("severity", F.lit("HIGH"))})


def rules_for_plan(rules: DataFrame, most: int = 500) -> list[dict]:
    """The catalogue as plan-time rules: one expression each, so there must be few, which is checked.

    A catalogue of any size is evaluated as a table, by ``operators.rules.evaluate_table``.
    """
    rows = rules.orderBy("rule_no").limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} rules: evaluate them as a table")
    return [{k: v for k, v in r.asDict().items() if k != "rule_no"} for r in rows]


def builtin_rules(spark: SparkSession) -> DataFrame:
    """The built-in catalogue as rows."""
    entries = F.array(*[F.struct(
        F.lit(i).cast("bigint").alias("rule_no"),
        *[F.lit(r[n]).cast("boolean" if n in ("mandatory", "conditional") else "string").alias(n) for n in c.RULE_COLUMNS])
        for i, r in enumerate(c.RULES)])
    return spark.range(1).select(F.inline(entries))


def read_document_index(spark: SparkSession, path: str) -> DataFrame:
    """Document index that is one JSON object holding an array, as one row per document.

    One object is one task; a large index is kept as records (``read_document_records``).
    """
    whole = spark.read.schema(schemas.DOCUMENT_INDEX).json(path, multiLine=True)
    return whole.select(F.posexplode("documents").alias("doc_id", "d")).select("doc_id", "d.*")


def read_document_records(spark: SparkSession, path: str) -> DataFrame:
    """Document index of one record per line, as the sink writes it: an index of any size, read in splits."""
    return spark.read.schema(schemas.DOCUMENT_RECORDS).json(path, mode="FAILFAST")


def read_extracted_texts(spark: SparkSession, path: str) -> DataFrame:
    """Every extracted text file, whole, by file stem."""
    name = F.url_decode(F.replace(F.col("_metadata.file_name"), F.lit("+"), F.lit("%2B")))
    return spark.read.text(path, wholetext=True).select(
        F.regexp_replace(name, r"\.txt$", "").alias("stem"), F.col("value").alias("snippet"))


def read_labels(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(schemas.RESULTS).parquet(path)


def read_regions(spark: SparkSession, path: str) -> DataFrame:
    """Region rows; a flat box of four numbers arrives as a polygon of two corners."""
    return spark.read.schema(schemas.REGIONS).parquet(path)


def flat_box(box: Column) -> Column:
    """Polygon of two corner points from ``[x1, y1, x2, y2]``."""
    return F.array(F.slice(box, 1, 2), F.slice(box, 3, 2))


def read_scans(spark: SparkSession, path: str, start: str | dt.date | None = None, end: str | dt.date | None = None) -> DataFrame:
    """Stored scans in a time range; the range prunes day partitions and is pushed to the files."""
    from declara.operators.analytics import parse_bound
    scans = in_range(spark.read.schema(schemas.SCANS).parquet(path), start, end)
    lo, hi = parse_bound(start), parse_bound(end)
    if lo is not None:
        scans = scans.filter(F.col("scan_date") >= F.lit(lo.date()))
    if hi is not None:
        scans = scans.filter(F.col("scan_date") <= F.lit(hi.date()))
    return scans


def parse_scans(scans: DataFrame, schema: str = schemas.COMPLIANCE) -> DataFrame:
    """Scans with the documents the queries need as structs, parsed with a narrow schema."""
    out = scans.withColumn("compliance", F.from_json("compliance_result", schema))
    if "authenticity_result" in scans.columns:
        auth = F.from_json("authenticity_result", schemas.VERDICT)
        out = out.withColumns({"verdict": auth["verdict"], "similarity_score": auth["similarity_score"]})
    if "extracted_data" in scans.columns:
        out = out.withColumn("extracted", F.col("extracted_data"))
    return out


def stored_rule_rows(parsed: DataFrame) -> DataFrame:
    """Rule rows of parsed scans, with the scan's name and time so that nothing needs a join."""
    return parsed.select(
        F.col("id").alias("scan_id"), "product_name", "created_at", F.posexplode("compliance.results").alias("pos", "r")
    ).select("scan_id", "product_name", "created_at", "pos", "r.rule_id", "r.declaration", "r.status",
             F.col("r.evidence.pixel_text_height").alias("pixel_text_height"),
             F.col("r.evidence.text_height_pixels").alias("text_height_pixels"))


def engine_regions(words: DataFrame) -> DataFrame:
    """Region rows from raw engine word rows (text, conf, left, top, width, height).

    Blank text and negative or unreadable confidences drop out; confidence becomes a share.
    """
    conf = F.col("conf").cast("string").try_cast("double")
    text = strip(F.col("text").cast("string"))
    x, y = F.col("left").cast("double"), F.col("top").cast("double")
    w, h = F.col("width").cast("double"), F.col("height").cast("double")
    return words.withColumns({"text": text, "_conf": conf}).filter((F.col("text") != "") & (F.col("_conf") >= 0)).withColumns({
        "confidence": rounded(F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col("_conf") / 100.0)), 4),
        "bounding_box": polygon(x, y, x + w, y + h)}).drop("_conf", "conf", "left", "top", "width", "height")
