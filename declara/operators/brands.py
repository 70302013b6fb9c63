"""Register brand references and compare samples with them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from declara import catalog as c
from declara.functions.similarity import cosine, palette_similarity
from declara.functions.base import filled, rounded, strip


def brand_key(name: Column) -> Column:
    """Trimmed lower-case name with '_' for blanks."""
    return F.replace(F.lower(strip(name)), F.lit(" "), F.lit("_"))


def register_brands(existing: DataFrame | None, new: DataFrame) -> DataFrame:
    """Brand references after registration: the latest entry per cleaned brand key.

    Rows: brand_id, optional brand_name, embedding, palette, ..., registered_at.  An entry without
    time is older than any other; at equal times a new entry replaces a stored one, and what is
    still equal is settled by the remaining columns.
    """
    shaped = new if "brand_name" in new.columns else new.withColumn("brand_name", F.col("brand_id").cast("string"))
    shaped = shaped.withColumns({
        "brand_name": F.coalesce(filled(F.col("brand_name")), F.col("brand_id").cast("string")),
        "brand_id": brand_key(F.col("brand_id").cast("string"))})
    marked = shaped.withColumn("_new", F.lit(1))
    rows = marked if existing is None else existing.withColumn("_new", F.lit(0)).unionByName(marked, allowMissingColumns=True)
    rest = [n for n in rows.columns if n not in ("brand_id", "_new")]
    order = F.struct("registered_at", "_new", F.to_json(F.struct(*rest)))
    return rows.groupBy("brand_id").agg(F.max_by(F.struct(*rest), order).alias("_r")).select("brand_id", "_r.*")


def lookup_brands(wanted: DataFrame, references: DataFrame, brand: str = "brand_id") -> DataFrame:
    """Rows with the reference of their brand, NULL columns where there is none."""
    refs = references.select(F.col("brand_id").alias("_key"), *[
        F.col(n).alias(f"ref_{n}") for n in references.columns if n != "brand_id"])
    return wanted.withColumn("_key", brand_key(F.col(brand).cast("string"))).join(refs, "_key", "left")


def compare_brands(samples: DataFrame, references: DataFrame, threshold: float = c.GENUINE_THRESHOLD,
                   brand: str = "brand_id") -> DataFrame:
    """Similarity, verdict and notes of every sample against the reference of its brand."""
    joined = lookup_brands(samples, references.withColumn("_there", F.lit(True)), brand)
    ref = F.col("ref_embedding")
    joined = joined.withColumn("similarity_score", F.when(ref.isNull(), 0.0).otherwise(
        rounded(F.greatest(F.lit(0.0), F.least(F.lit(1.0), cosine(F.col("embedding"), ref))), 4)))
    score = F.col("similarity_score")
    known = F.col("_key").isNotNull() & ref.isNotNull()
    verdict = F.when(~known, "NO_REFERENCE_AVAILABLE").when(score >= threshold, "GENUINE_LIKELY").otherwise("SUSPICIOUS")
    shown = F.format_string("%.2f%%", score * 100.0)
    notes = (
        F.when(F.col("_known") & ref.isNull(), "Reference data contains corrupted embedding.")
        .when(~known, F.concat(F.lit("No verified reference brand embedding found for '"),
                                F.col(brand).cast("string"), F.lit("' in catalog.")))
        .when(score >= threshold, F.concat(
            F.lit("Visual appearance aligns with reference brand catalog (similarity: "), shown, F.lit(").")))
        .otherwise(F.concat(
            F.lit("Visual appearance diverges from reference brand catalog (similarity "), shown,
            F.lit(f" < threshold {threshold:.2%}). Possible counterfeit or unauthorized packaging variation.")))
    )
    joined = joined.withColumn("_known", F.coalesce(F.col("ref__there"), F.lit(False)))
    out = joined.withColumns({"verdict": verdict, "threshold_used": F.lit(float(threshold)), "notes": notes})
    if "palette" in samples.columns and "palette" in references.columns:
        out = out.withColumn("color_similarity", F.when(
            known & (F.size("ref_palette") > 0), palette_similarity(F.col("palette"), F.col("ref_palette"))))
    drop = ["_key", "_known", "ref__there"] + [f"ref_{n}" for n in references.columns if n not in ("brand_id", "brand_name")]
    return out.drop(*drop)
