"""Merge what several panel images of one product show."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from declara import catalog as c
from declara.functions.base import strip


def _rank(weight: Column, value: Column) -> Column:
    return F.struct(-weight, -F.length(strip(value)), F.col("panel"))


def merge_panels(panel_fields: DataFrame, key: str, payload: list[str] | None = None) -> DataFrame:
    """Best reading of each field over all panels, with the panel it came from.

    Rows: key, panel, field_name, value, confidence, is_detected.  Confidence decides, then the
    longer text, then the lower panel number.  One partial aggregate, no window.
    """
    keep = payload or ["value", "confidence"]
    usable = panel_fields.filter(
        F.col("is_detected") & (F.col("value") != "") & F.col("field_name").isin(c.EXTRACTED_FIELDS))
    weight = F.when(F.col("field_name").isin(c.COMPLETENESS_FIELDS), F.col("confidence") * 10.0).otherwise(F.col("confidence"))
    best = F.min_by(F.struct(*keep, F.col("panel").alias("_panel")), _rank(weight, F.col("value")))
    return usable.groupBy(key, "field_name").agg(best.alias("_b")).select(
        key, "field_name", *[F.col(f"_b.{k}").alias(k) for k in keep], F.col("_b._panel").alias("panel"))


def field_sources(merged: DataFrame, key: str) -> DataFrame:
    """Map field -> panel per product; at most one entry per declared field."""
    return merged.groupBy(key).agg(
        F.map_from_entries(F.collect_list(F.struct("field_name", "panel"))).alias("field_sources"))


def _flags() -> list[Column]:
    special = F.coalesce((F.col("category") != "general") & (F.col("category") != ""), F.lit(False))
    return [
        F.coalesce(F.min_by(F.when(special, F.col("category")), F.when(special, F.col("panel"))), F.lit("general")).alias("category"),
        F.coalesce(F.bool_or("is_imported"), F.lit(False)).alias("is_imported")]


def merge_flags(panels: DataFrame, key: str) -> DataFrame:
    """Category of the first panel that knows one, and whether any panel looks imported."""
    return panels.groupBy(key).agg(*_flags())


def merge_extracted(read: DataFrame, key: str) -> DataFrame:
    """What ``merge_panels``, ``field_sources`` and ``merge_flags`` give, from extracted panels in one aggregate.

    Rows: key, panel, fields, category, is_imported; the long extraction before it is run once.  One row per
    product: ``fields`` (NULL where no panel shows one), ``field_sources``, category, is_imported.
    """
    def best(name: str) -> Column:
        f = F.col("fields")[name]
        usable = f["is_detected"] & (f["value"] != "")
        weight = f["confidence"] * 10.0 if name in c.COMPLETENESS_FIELDS else f["confidence"]
        return F.min_by(F.when(usable, F.struct(f.alias("f"), F.col("panel").alias("p"))), F.when(usable, _rank(weight, f["value"])))

    merged = read.groupBy(key).agg(*[best(n).alias(f"_b_{n}") for n in c.EXTRACTED_FIELDS], *_flags())
    sources = F.array_compact(F.array(*[
        F.when(F.col(f"_b_{n}").isNotNull(), F.struct(F.lit(n).alias("k"), F.col(f"_b_{n}.p").alias("v"))) for n in c.EXTRACTED_FIELDS]))
    return merged.select(
        key, F.struct(*[F.col(f"_b_{n}.f").alias(n) for n in c.EXTRACTED_FIELDS]).alias("fields"),
        F.map_from_entries(sources).alias("field_sources"), "category", "is_imported")


def panel_summary(panels: DataFrame, key: str) -> DataFrame:
    """Combined text, mean confidence and region total over the panels of a product.

    Rows: key, panel (from 0), raw_text, average_confidence, regions_detected.
    """
    titled = F.concat(F.lit("--- Panel Image "), (F.col("panel") + 1).cast("string"), F.lit(" ---\n"), F.col("raw_text"))
    text = F.when(F.col("raw_text") != "", F.struct(F.col("panel").alias("p"), titled.alias("t")))
    return panels.groupBy(key).agg(
        F.count(F.lit(1)).alias("images_processed"),
        (F.sum(F.col("average_confidence").cast("decimal(20,8)")).cast("double") / F.count(F.lit(1))).alias("average_confidence"),
        F.sum("regions_detected").alias("regions_count"),
        F.array_join(F.transform(F.sort_array(F.collect_list(text)), lambda x: x["t"]), "\n---\n").alias("ocr_text"))


def panel_note(images: Column, sources: Column) -> Column:
    """Sentence naming the image on which each key declaration was found."""
    found = F.concat_ws(", ", *[
        F.concat(F.lit(f"{label} found on image "), (sources[name] + 1).cast("string"))
        for name, label in c.PANEL_NOTE_LABELS.items()])
    return F.concat(
        F.lit("Analysis based on "), images.cast("string"), F.lit(" images of the same product."),
        F.when(found != "", F.concat(F.lit(" ("), found, F.lit(")"))).otherwise(""))


def add_panel_note(df: DataFrame) -> DataFrame:
    """Append the panel note (columns images_processed, field_sources) to the summary."""
    note = F.concat(F.lit("[MULTI-PANEL AUDIT] "), panel_note(F.col("images_processed"), F.col("field_sources")))
    old = F.col("summary")
    return df.withColumn("summary", F.when(F.coalesce(old, F.lit("")) == "", note).otherwise(
        F.concat(old, F.lit("\n\n"), note)))
