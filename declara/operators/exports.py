"""Audit export data sets: overview, extracted fields, rule rows, violation log, notices.

Input are stored scans with ``compliance`` (parsed compliance document, results included) and
``extracted`` (JSON text).  Everything derives row by row from a scan; the rule catalogue is
plan-time data.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from declara import catalog as c
from declara.functions.base import filled, fixed_text, rounded

NOT_DETECTED = "Not Detected"
BAD = ["FAIL", "WARNING"]


def normalize_scans(scans: DataFrame) -> DataFrame:
    """Scans with fallbacks from the compliance document for name, status, score, id and time.

    A scan without a time shows the time of the export.
    """
    doc = F.col("compliance")
    return scans.withColumns({
        "scan_id": F.coalesce(F.nullif(F.col("id").cast("string"), F.lit("0")), F.lit("N/A")),
        "product_name": F.coalesce(filled(F.col("product_name")), filled(doc["product_name"]), F.lit("Pre-Packaged Commodity")),
        "overall_status": F.coalesce(filled(F.col("overall_status")), doc["overall_status"], F.lit("UNKNOWN")),
        "compliance_score": F.coalesce("compliance_score", doc["compliance_score"], F.lit(0.0)),
        "created_at_str": F.concat(F.date_format(F.coalesce(F.col("created_at").cast("timestamp"), F.current_timestamp()),
                                                 "yyyy-MM-dd HH:mm:ss"), F.lit(" UTC")),
        "officer": F.coalesce(F.nullif(F.col("officer_id").cast("string"), F.lit("0")), F.lit("N/A")),
    })


_META_TYPE = "map<string,struct<legal_ref:string,source_pdf:string,declaration:string,severity:string>>"


def rule_meta(rule_id: Column, rules: list[dict] | None = None) -> Column:
    """struct(legal_ref, source_pdf, declaration, severity) of a rule id, defaults for unknown ids."""
    entries = [x for r in (c.RULES if rules is None else rules) for x in (
        F.lit(r["rule_id"]), F.struct(
            F.lit(r.get("official_legal_reference") or r["legal_reference"]).alias("legal_ref"),
            F.lit(r.get("source_pdf") or c.KNOWN_RULE_SOURCE_DEFAULT).alias("source_pdf"),
            F.lit(r["declaration_name"]).alias("declaration"), F.lit(r["severity"]).alias("severity")))]
    unknown = F.struct(F.lit(c.UNKNOWN_RULE_LEGAL_REF).alias("legal_ref"), F.lit(c.UNKNOWN_RULE_SOURCE).alias("source_pdf"),
                       rule_id.alias("declaration"), F.lit(c.UNKNOWN_RULE_SEVERITY).alias("severity"))
    return F.coalesce(F.create_map(*entries).cast(_META_TYPE)[rule_id], unknown)


_RESULT_COLUMNS = ["rule_id", "declaration", "status", "detected_value", "reason", "legal_reference",
                   "official_legal_reference", "source_pdf", "severity"]


def result_rows(scans: DataFrame, chosen: Column | None = None) -> DataFrame:
    """One row per result with its position (from 1) and the scan's name and time."""
    array = F.col("compliance.results") if chosen is None else chosen
    return scans.select("scan_id", "created_at_str", "product_name", F.posexplode(array).alias("pos", "r")).select(
        "scan_id", "created_at_str", "product_name", (F.col("pos") + 1).alias("pos"), "r.*")


def _with_meta(rows: DataFrame) -> DataFrame:
    """Rows with rule metadata; result columns a table lacks count as missing."""
    absent = {n: F.lit(None).cast("string") for n in _RESULT_COLUMNS if n not in rows.columns}
    out = rows.withColumns(absent) if absent else rows
    return out.withColumn("m", rule_meta(F.coalesce("rule_id", F.lit(""))))


def _legal() -> Column:
    return F.coalesce(filled(F.col("official_legal_reference")), filled(F.col("legal_reference")), F.col("m.legal_ref"))


def _source() -> Column:
    return F.coalesce(filled(F.col("source_pdf")), F.col("m.source_pdf"))


def _or_empty(name: str) -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def _detected() -> Column:
    return F.coalesce(filled(F.col("detected_value")), F.lit(NOT_DETECTED))


def overview_rows(scans: DataFrame) -> DataFrame:
    """Key/value rows heading the audit record of each scan."""
    doc = F.col("compliance")
    entries = [
        ("Scan ID", F.col("scan_id")), ("Product Name", F.col("product_name")),
        ("Overall Compliance Status", F.col("overall_status")),
        ("Compliance Score (%)", F.concat(fixed_text("compliance_score", 1), F.lit("%"))),
        ("Inspection Timestamp", F.col("created_at_str")), ("Inspecting Officer ID", F.col("officer")),
        ("Total Rules Checked", F.coalesce(doc["total_checks"], F.size(doc["results"])).cast("string")),
        ("Rules Passed", F.coalesce(doc["passed"], F.lit(0)).cast("string")),
        ("Rules Failed", F.coalesce(doc["failed"], F.lit(0)).cast("string")),
        ("Warnings Issued", F.coalesce(doc["warnings"], F.lit(0)).cast("string")),
    ]
    rows = F.array(*[F.struct(F.lit(i).alias("pos"), F.lit(k).alias("attribute"), v.alias("value"))
                     for i, (k, v) in enumerate(entries, 1)])
    return scans.select(F.col("scan_id").alias("scan_id"), F.inline(rows))


_FIELD = "struct<field_key:string,label:string,value:string,confidence:double>"


def flattened_fields(scans: DataFrame) -> DataFrame:
    """Labelled field rows of each scan, then detected rule values whose name is not yet present.

    Repeated rule names count once, at their first appearance.
    """
    doc = F.col("_doc")
    entries = []
    for key, label in c.EXPORT_LABELS.items():
        raw = doc[key]
        obj = F.from_json(raw, "value string, raw_value string, confidence double")
        value = F.when(raw.startswith("{"), F.coalesce(filled(obj["value"]), filled(obj["raw_value"]))).otherwise(filled(raw))
        conf = F.when(raw.startswith("{"), F.coalesce(obj["confidence"], F.lit(0.0))).otherwise(F.lit(1.0))
        shown = F.when(conf <= 1.0, rounded(conf * 100, 1)).otherwise(conf)
        entries.append(F.when(value.isNotNull(), F.struct(
            F.lit(key).alias("field_key"), F.lit(label).alias("label"), value.alias("value"), shown.alias("confidence")).cast(_FIELD)))
    schema = "map<string,string>"
    out = scans.withColumn("_doc", F.coalesce(F.from_json("extracted", schema), F.create_map().cast(schema)))
    out = out.withColumn("_known", F.array_compact(F.array(*entries)))

    named = F.transform("compliance.results", lambda r: F.struct(
        F.coalesce(r["rule_id"], F.lit("")).alias("field_key"),
        F.coalesce(filled(r["declaration"]), r["rule_id"], F.lit("")).alias("label"),
        r["detected_value"].alias("value"), F.lit(95.0).alias("confidence")).cast(_FIELD))
    usable = F.filter(named, lambda f: (filled(f["value"]).isNotNull())
                      & ~F.array_contains(F.transform("_known", lambda k: k["field_key"]), f["label"]))
    out = out.withColumn("_extra", F.coalesce(usable, F.array().cast(f"array<{_FIELD}>")))
    labels = F.transform("_extra", lambda f: f["label"])
    out = out.withColumn("_labels", labels)
    once = F.filter("_extra", lambda f, i: F.array_position("_labels", f["label"]) == i + 1)
    return out.select("scan_id", F.posexplode(F.concat("_known", once)).alias("pos", "f")).select(
        "scan_id", (F.col("pos") + 1).alias("pos"), "f.*")


def rule_rows(rows: DataFrame) -> DataFrame:
    """Rule-by-rule table with the citation and source of every rule, from result rows."""
    return _with_meta(rows).select(
        "scan_id", "pos", _or_empty("rule_id").alias("rule_id"), F.coalesce("declaration", "m.declaration").alias("declaration"),
        _or_empty("status").alias("status"), _detected().alias("detected_value"), _or_empty("reason").alias("reason"),
        _legal().alias("legal_citation"), _source().alias("source_document"),
        F.coalesce(filled(F.col("severity")), F.col("m.severity")).alias("severity"))


def all_scans(scans: DataFrame) -> DataFrame:
    """One row per scan with its failed rules; warnings are not counted here."""
    failed = F.transform(F.filter("compliance.results", lambda r: r["status"] == "FAIL"), lambda r: F.coalesce(r["rule_id"], F.lit("")))
    verdict = F.col("verdict") if "verdict" in scans.columns else F.lit(None).cast("string")
    return scans.withColumn("_failed", F.coalesce(failed, F.array().cast("array<string>"))).select(
        "scan_id", F.col("created_at_str").alias("inspection_date"), "product_name", "overall_status",
        F.concat(fixed_text("compliance_score", 1), F.lit("%")).alias("score"), F.size("_failed").alias("violations_count"),
        F.when(F.size("_failed") > 0, F.array_join("_failed", ", ")).otherwise("None").alias("failed_rule_ids"),
        F.coalesce(verdict, F.lit("N/A")).alias("authenticity_verdict"), F.col("officer").alias("officer_id"))


def violations_log(rows: DataFrame) -> DataFrame:
    """Every failed or warned result, from result rows with the scan's name and time."""
    return _with_meta(rows.filter(F.col("status").isin(BAD))).select(
        "scan_id", F.col("created_at_str").alias("inspection_date"), "product_name", _or_empty("rule_id").alias("rule_id"),
        _or_empty("declaration").alias("declaration"), "status", _detected().alias("observed_value"),
        _or_empty("reason").alias("reason"), _legal().alias("legal_reference"), _source().alias("source_document"))


def show_cause_rows(scans: DataFrame) -> DataFrame:
    """Numbered contraventions of each scan; its first three results if there is none."""
    results = F.col("compliance.results")
    bad = F.filter(results, lambda r: r["status"].isin(BAD))
    chosen = F.when(F.size(bad) > 0, bad).otherwise(F.slice(results, 1, 3))
    default = "Mandatory statutory declaration missing or non-conforming on PDP"
    return _with_meta(result_rows(scans, chosen)).select(
        "scan_id", F.col("pos").alias("serial_no"), _or_empty("rule_id").alias("rule_id"),
        F.coalesce("declaration", "m.declaration").alias("declaration"),
        F.coalesce(filled(F.col("reason")), F.lit(default)).alias("finding"), _legal().alias("legal_reference"),
        _source().alias("source_document"))


def kpis(scans: DataFrame) -> DataFrame:
    """Stored counters of each scan, counted from its results where they are missing."""
    doc = F.col("compliance")

    def count(status: str) -> Column:
        return F.size(F.filter(doc["results"], lambda r: r["status"] == status))

    return scans.select(
        "scan_id", F.coalesce(doc["total_checks"], F.size(doc["results"])).alias("total_rules_evaluated"),
        F.coalesce(doc["passed"], count("PASS")).alias("declarations_passed"),
        F.coalesce(doc["failed"], count("FAIL")).alias("violations_detected"),
        F.coalesce(doc["warnings"], count("WARNING")).alias("warnings"),
        F.concat(fixed_text("compliance_score", 1), F.lit("%")).alias("compliance_percentage"))


def visual_metrics(scans: DataFrame) -> DataFrame:
    """Measured visual figures of each scan against their thresholds; NULL where nothing was measured."""
    stats = F.from_json("visual_statistics", (
        "pdp_area_ratio double, mean_font_size_px double, contrast_ratio double, readability_score double, "
        "bounding_box_count int, languages string"))
    # Metric names and thresholds
    entries = [
        ("Principal Display Panel (PDP) Ratio", F.format_string("%.1f%%", stats["pdp_area_ratio"] * 100), stats["pdp_area_ratio"],
         "≥ 30% of packaging face area"),
        ("Mean Text Font Size", F.format_string("%.1f px", stats["mean_font_size_px"]), stats["mean_font_size_px"],
         "≥ 12.0 px for standard pack"),
        ("Color Contrast Ratio", F.format_string("%.2f:1", stats["contrast_ratio"]), stats["contrast_ratio"], "≥ 4.5:1 (WCAG AA standard)"),
        ("Readability & Clarity Index", F.format_string("%.1f / 100", stats["readability_score"]), stats["readability_score"],
         "≥ 70 / 100 threshold"),
        ("Total Bounding Boxes Detected", stats["bounding_box_count"].cast("string"), stats["bounding_box_count"], "All mandatory panels"),
        ("Detected Multi-lingual Content", stats["languages"], stats["languages"], "Rule 6(1) Language Mandates"),
    ]
    rows = F.array(*[F.struct(F.lit(i).alias("pos"), F.lit(name).alias("metric"), F.when(present.isNotNull(), shown).alias("value"),
                              F.lit(bound).alias("benchmark")) for i, (name, shown, present, bound) in enumerate(entries, 1)])
    return scans.select("scan_id", F.inline(rows))
