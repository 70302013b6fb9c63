"""The registered queries: operators applied to the star-schema test tables."""

from __future__ import annotations

import datetime as dt
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from declara.functions.base import rounded
from declara import catalog as c
from declara import schemas
from declara.functions import geometry as g
from declara.functions import text as tx
from declara.functions.similarity import palette_similarity
from declara.operators import analytics as an
from declara.operators import answers as ans
from declara.operators import brands as br
from declara.operators import documents as doc
from declara.operators import exports as ex
from declara.operators import extract as x
from declara.operators import frames as fr
from declara.operators import fusion as fu
from declara.operators import history as hi
from declara.operators import insight as ins
from declara.operators import panels as pn
from declara.operators import reading_order as ro
from declara.operators import rules as ru
from declara.operators import search as se
from declara.plans import pipelines
from declara.plans.bridges import dealt, spread, table, view
from declara.session import shared_dir, stored
from declara.sources import readers as rd
from declara.sources import writers as wr
from declara.streaming import live

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

# the day that counts as today, fixed so that results do not age
AS_OF = dt.date(2025, 6, 1)
# total order of the regions of one engine; line numbers repeat in the test data
REGION_ORDER = ["pos", "partkey", "suppkey", "text", "confidence", "x1", "y1"]
SCAN_YEAR = (dt.datetime(1997, 1, 1), dt.datetime(1997, 12, 31))


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


# ---------------------------------------------------------------------------------------------
# rules
# ---------------------------------------------------------------------------------------------


def _checked(spark: SparkSession, d: str) -> DataFrame:
    return ru.check_products(view(spark, d, "product_input", "part"), as_of=AS_OF)


@query
def q_rule_results(spark, d):
    """Every product against every rule."""
    return ru.rule_rows(ru.evaluate(view(spark, d, "product_input", "part"), as_of=AS_OF), "product_id").select(
        "product_id", "rule_id", "declaration", "status", "detected_value", "reason", "legal_reference", "severity")


@query
def q_compliance_score(spark, d):
    """Score, status, counters and guidance per product (flagship)."""
    return _checked(spark, d).select(
        "product_id", "overall_status", "compliance_score", "total_checks", "passed", "failed", "warnings",
        "human_verification_required", "not_applicable", F.size("violations").alias("violations"),
        "guidance_note", "summary")


@query
def q_score_from_rows(spark, d):
    """The same roll-up from long rule rows, by aggregation."""
    rows = ru.rule_rows(ru.evaluate(view(spark, d, "product_input", "part"), as_of=AS_OF), "product_id")
    return ru.score_rows(rows.select("product_id", "status", "severity"), "product_id")


@query
def q_ecommerce_rescore(spark, d):
    """Online listings (every third product) rescored, the rest as physical packs."""
    products = view(spark, d, "product_input", "part").withColumn(
        "input_type", F.when(F.col("product_id") % 3 == 0, "ecommerce_listing").otherwise("physical_package"))
    return ru.check_products(products, as_of=AS_OF).select(
        "product_id", "input_type", "overall_status", "compliance_score", "passed", "failed", "warnings",
        "not_applicable", F.size("violations").alias("violations"))


@query
def q_guidance_from_results(spark, d):
    """Guidance note derived from stored rule rows."""
    rows = view(spark, d, "rule_results").select("scan_id", "rule_id", "status")
    scans = view(spark, d, "scan_records").select(F.col("id").alias("scan_id"))
    return ru.stored_guidance(scans, rows, "scan_id")


def _local_rules(spark: SparkSession, d: str) -> DataFrame:
    """A catalogue with rules of every nation: copies of built-in ones, one of a custom type and one of an unknown type."""
    base = rd.builtin_rules(spark)
    n = len(c.RULES)
    number, name = F.col("n_nationkey"), F.col("n_name")
    wanted = table(spark, d, "nation").withColumn("rule_no", (number % (n + 2)).cast("bigint"))
    kind = (F.when(F.col("rule_no") == n, "NAME_LENGTH").when(F.col("rule_no") == n + 1, "UNHEARD_OF").otherwise(F.col("validation_type")))
    importer = F.when(F.col("rule_id").contains("IMPORTER"), "IMPORTER_").otherwise("")
    local = wanted.join(base, "rule_no", "left").withColumns({
        "validation_type": kind, "rule_id": F.concat(F.lit("LOCAL_"), F.coalesce(importer, F.lit("")), number.cast("string")),
        "declaration_name": F.concat(F.lit("Declaration of "), name), "legal_reference": F.concat(F.lit("Local rule "), name),
        "severity": F.element_at(F.array(F.lit("HIGH"), F.lit("MEDIUM"), F.lit("LOW")), (number % 3 + 1).cast("int")),
        "rule_no": (number + n).cast("bigint")})
    return base.unionByName(local.select(base.columns))


def _name_length(rule):
    """Custom validator: the declared name is as long as the severity asks for."""
    text, least = F.coalesce("product_name", F.lit("")), F.when(rule["severity"] == "HIGH", 30).otherwise(20)
    ok = F.length(text) >= least
    return ru.v.result(rule, F.when(ok, ru.v.PASS).otherwise(ru.v.WARNING), F.col("product_name"),
                       F.concat(F.lit("Name of "), F.length(text).cast("string"), F.lit(" characters.")))


def _custom_rows(spark: SparkSession, d: str) -> DataFrame:
    return ru.evaluate_table(view(spark, d, "product_input", "part"), _local_rules(spark, d), "product_id", as_of=AS_OF,
                             extra_validators={"NAME_LENGTH": _name_length})


@query
def q_custom_rules(spark, d):
    """Every product against a catalogue table with local rules, a custom validator and an unknown type."""
    return _custom_rows(spark, d).select("product_id", "rule_no", "rule_id", "declaration", "status", "detected_value", "reason",
                                         "legal_reference", "severity")


@query
def q_custom_scores(spark, d):
    """The roll-up of these rows."""
    return ru.score_rows(_custom_rows(spark, d).select("product_id", "status", "severity"), "product_id")


# ---------------------------------------------------------------------------------------------
# text repair and extraction
# ---------------------------------------------------------------------------------------------


def _extracted(spark: SparkSession, d: str) -> DataFrame:
    return x.extract(view(spark, d, "label_text", "part"), "product_id")


def _value(name: str):
    return F.col(f"fields.{name}.value").alias(name)


@query
def q_text_repair(spark, d):
    """All repairs over whole document texts."""
    docs = spread(table(spark, d, "documents"))
    fixed = docs.select("doc_id", tx.clean_text(F.col("text")).alias("cleaned"))
    return fixed.select("doc_id", F.length("cleaned").alias("cleaned_chars"), F.md5("cleaned").alias("cleaned_md5"))


@query
def q_label_repair(spark, d):
    """Every line of noisily read labels: word repairs, digit repairs and all of them."""
    line = F.col("line")
    rows = view(spark, d, "noisy_labels", "part").select("product_id", F.posexplode(F.split("raw_text", "\n")).alias("pos", "line"))
    return rows.select("product_id", "pos", tx.repair_confusions(line).alias("words"), tx.repair_digits(line).alias("digits"),
                       tx.clean_line(line).alias("cleaned"))


@query
def q_result_repair(spark, d):
    """Recognised results whose lines are regions, every fifth line blank: repaired regions, text and steps."""
    labels = view(spark, d, "noisy_labels", "part")
    regions = F.transform(F.split("raw_text", "\n"), lambda ln, i: F.struct(
        F.when((i + F.col("product_id")) % 5 == 0, "  ").otherwise(ln).alias("text"), F.lit(0.9).alias("confidence"),
        g.polygon(F.lit(0.0), F.lit(0.0), F.lit(9.0), F.lit(9.0)).alias("bounding_box")))
    steps = F.when(F.col("product_id") % 2 == 0, F.array(F.lit("gray"), F.lit(c.REPAIR_MARKER))).otherwise(F.array(F.lit("gray")))
    done = labels.withColumn("r", tx.clean_result(F.col("raw_text"), regions, steps))
    return done.select("product_id", F.col("r.raw_text").alias("cleaned"), F.size("r.regions").alias("regions"),
                       F.array_join("r.preprocessing_applied", ",").alias("steps"))


@query
def q_unit_standard(spark, d):
    """Unit spelling of every label."""
    return view(spark, d, "label_text", "part").select(
        "product_id", tx.standardize_units(F.col("raw_text")).alias("standard_text"))


@query
def q_extract_fields(spark, d):
    """Prices, quantities, dates, names, origin and category read off the labels."""
    return _extracted(spark, d).select("product_id", *[_value(n) for n in (
        "mrp", "net_quantity", "unit_sale_price", "date_declaration", "best_before", "country_of_origin", "product_name")],
        F.col("fields.mrp.raw_value").alias("mrp_raw"), F.col("fields.net_quantity.confidence").alias("quantity_confidence"),
        F.col("fields.country_of_origin.confidence").alias("origin_confidence"), "is_imported", "category")


@query
def q_entity_blocks(spark, d):
    """Maker, packer and importer blocks."""
    return _extracted(spark, d).select("product_id", *[_value(f"{k}_{p}") for k in (
        "manufacturer", "packer", "importer") for p in ("name", "address")],
        F.col("fields.manufacturer_name.raw_value").alias("manufacturer_raw"))


@query
def q_consumer_care(spark, d):
    """Contact block, email and phone."""
    return _extracted(spark, d).select("product_id", *[_value(n) for n in (
        "consumer_care", "consumer_care_email", "consumer_care_phone")],
        F.col("fields.consumer_care.source_text").alias("care_source"))


@query
def q_extract_to_score(spark, d):
    """Label text to rules and score, end to end."""
    checked = ru.check_products(x.to_products(_extracted(spark, d)), as_of=AS_OF)
    return checked.select("product_id", "overall_status", "compliance_score", "passed", "failed", "warnings",
                          "human_verification_required", "not_applicable", "guidance_note")


@query
def q_field_rows(spark, d):
    """Long list of the detected fields."""
    return x.field_rows(_extracted(spark, d), "product_id").filter("is_detected").select(
        "product_id", "field_name", "value", "raw_value", "confidence")


@query
def q_override_merge(spark, d):
    """External readings replacing missing or weakly read fields before correction."""
    part = table(spark, d, "part")
    answers = part.filter(F.col("p_partkey") % 3 == 0).select(
        F.col("p_partkey").alias("product_id"), F.lit("mrp").alias("field"),
        F.concat(F.lit("₹"), F.col("p_size").cast("string")).alias("value")
    ).unionByName(part.filter(F.col("p_partkey") % 5 == 0).select(
        F.col("p_partkey").alias("product_id"), F.lit("importer_name").alias("field"),
        F.concat(F.lit(" "), F.col("p_brand"), F.lit(" ")).alias("value")))
    read = x.extract(view(spark, d, "label_text", "part"), "product_id", answers)
    return read.select("product_id", _value("mrp"), F.col("fields.mrp.confidence").alias("mrp_confidence"),
                       _value("importer_name"), F.col("fields.importer_name.is_detected").alias("importer_detected"),
                       _value("net_quantity"))


def _labels_with_regions(spark: SparkSession, d: str) -> DataFrame:
    """Labels whose lines double as regions, stacked from top to bottom."""
    labels = view(spark, d, "label_text", "part")
    lines = tx.label_lines(F.col("raw_text"))
    conf = (F.lit(100) - (F.col("product_id") % 7) * 8) / F.lit(100.0)

    def region(ln, i):
        top = (i * 18).cast("double")
        return F.struct(ln.alias("text"), conf.alias("confidence"), g.polygon(
            F.lit(10.0), top, F.lit(10.0) + F.length(ln) * 6.0, top + 6.0 + (F.col("product_id") % 11)).alias("bounding_box"))

    return labels.withColumns({"regions": F.transform(lines, region), "image_width": F.lit(640),
                               "image_height": F.lit(180), "scale_factor": F.lit(1.0)})


@query
def q_region_evidence(spark, d):
    """Visual evidence of the declarations: matching regions, box, placement, readability."""
    rows = x.field_rows(x.extract(_labels_with_regions(spark, d), "product_id"), "product_id")
    e = F.col("evidence")
    return rows.filter("is_detected").select(
        "product_id", "field_name", rounded("confidence", 4).alias("confidence"), F.size("bounding_boxes").alias("regions"),
        *[g.at(e["bounding_box"], i).alias(n) for i, n in enumerate(("x0", "y0", "x1", "y1"))],
        e["text_height_pixels"].alias("text_height"), e["readability_status"].alias("readability"),
        e["position"]["quadrant"].alias("quadrant"), e["has_evidence"].alias("has_evidence"))


@query
def q_rule_evidence(spark, d):
    """Rule results with the evidence of their declaration, and the boxes to draw."""
    done = pipelines.inspect_labels(_labels_with_regions(spark, d), "product_id", AS_OF)
    b = F.col("bounding_box")
    return ins.annotations(done, "product_id").select(
        "product_id", "label", "status", *[g.at(b, i).alias(n) for i, n in enumerate(("x0", "y0", "x1", "y1"))])


@query
def q_extraction_insight(spark, d):
    """Found and missing declarations per label."""
    done = ins.extraction_insight(_extracted(spark, d))
    return done.select(
        "product_id", F.array_join(F.transform("found_features", lambda f: f["field_key"]), ",").alias("found"),
        F.array_join(F.transform("missing_fields", lambda f: f["field_key"]), ",").alias("missing"),
        F.array_join(F.transform("found_features", lambda f: f["value"]), "|").alias("found_values"), "coverage_note")


# ---------------------------------------------------------------------------------------------
# geometry
# ---------------------------------------------------------------------------------------------


def _regions(spark: SparkSession, d: str) -> DataFrame:
    return view(spark, d, "ocr_regions", "lineitem")


_REGION_KEYS = ["image_id", "engine", "pos", "partkey", "suppkey"]


@query
def q_box_metrics(spark, d):
    """Extent, area, centre, normalised and rescaled corners, polygon angle."""
    rows = _regions(spark, d).withColumns({
        "poly": g.polygon(F.col("x0"), F.col("y0"), F.col("x1"), F.col("y1")),
        "tilted": g.polygon(F.col("x0"), F.col("y0"), F.col("x0") + F.col("suppkey") % 7 - 3, F.col("y0") + F.col("partkey") % 5 - 2)})
    # the tilted polygon only carries a direction: its first edge
    edge = F.array(F.array("x0", "y0"), F.array(F.col("x0") + F.col("suppkey") % 7 - 3, F.col("y0") + F.col("partkey") % 5 - 2),
                   F.array("x1", "y1"), F.array("x0", "y1"))
    rows = rows.withColumn("box", g.xyxy(F.col("poly"))).withColumn("angle", g.polygon_angle(edge))
    box, w, h = F.col("box"), F.col("image_width"), F.col("image_height")
    norm, scaled = g.normalized(box, w, h), g.scaled_back(box, F.lit(1.5))
    return rows.select(
        *_REGION_KEYS, g.is_valid(box, w, h).alias("valid"), g.box_width(box).alias("width"), g.box_height(box).alias("height"),
        g.box_area(box).alias("area"), g.center_x(box).alias("center_x"), g.center_y(box).alias("center_y"),
        *[g.at(norm, i).alias(f"n{i}") for i in range(4)], *[g.at(scaled, i).alias(f"s{i}") for i in range(4)],
        "angle", g.is_vertical(F.col("angle")).alias("vertical"))


@query
def q_readability(spark, d):
    """Readability of every region, with a sharpness derived from the part."""
    box = F.array("x0", "y0", "x1", "y1")
    read = g.readability(F.col("confidence"), box, (F.col("partkey") % 90).cast("double"))
    return _regions(spark, d).withColumn("r", read).select(
        *_REGION_KEYS, "r.status", "r.text_height", "r.text_width", F.col("r.confidence").alias("confidence"),
        "r.sharpness", "r.reason")


@query
def q_positions(spark, d):
    """Placement of every region."""
    box = F.array("x0", "y0", "x1", "y1")
    return _regions(spark, d).withColumn("p", g.position(box, F.col("image_width"), F.col("image_height"))).select(
        *_REGION_KEYS, "p.horizontal", "p.vertical", "p.quadrant", F.col("p.center_x").alias("center_x"),
        F.col("p.center_y").alias("center_y"), g.block_id(box, F.lit(0.0), F.col("image_width"), F.col("image_height")).alias("block"))


@query
def q_iou_pairs(spark, d):
    """Strongly overlapping boxes of the same image."""
    pairs = fu.overlapping_pairs(_regions(spark, d), "image_id", ["engine", *REGION_ORDER])
    return pairs.select(
        "image_id", *[F.least(f"a_{n}", f"b_{n}").alias(f"low_{n}") for n in fu.CORNERS],
        *[F.greatest(f"a_{n}", f"b_{n}").alias(f"high_{n}") for n in fu.CORNERS], rounded("iou", 6).alias("iou"),
        (F.col("n_later") * F.col("n_earlier")).alias("copies"))


# ---------------------------------------------------------------------------------------------
# fusion
# ---------------------------------------------------------------------------------------------


@query
def q_region_merge(spark, d):
    """Clusters of overlapping regions over all engines of an image."""
    out = fu.cluster_regions(_regions(spark, d), "image_id", ["engine", *REGION_ORDER])
    return out.select("image_id", "text", "confidence", "x0", "y0", "x1", "y1", "source_count", "members")


@query
def q_ensemble(spark, d):
    """Winning engine, merged text and agreement per image."""
    return fu.ensemble(_regions(spark, d), "image_id", REGION_ORDER).select(
        "image_id", "winning_engine", "winning_score", "active_engines", "merged_text", "average_confidence",
        "engine_agreement_score", "clusters_count", "agreed_clusters_count")


@query
def q_ensemble_images(spark, d):
    """The same for all images, also those on which no engine found anything."""
    images = table(spark, d, "orders").select(F.col("o_orderkey").alias("image_id"))
    return fu.ensemble(_regions(spark, d), "image_id", REGION_ORDER, images=images).select(
        "image_id", "winning_engine", "winning_score", "active_engines", "merged_text", "average_confidence",
        "engine_agreement_score", "clusters_count", "agreed_clusters_count")


@query
def q_reading_order(spark, d):
    """Reading order of every region, with engine order as tie-breaker."""
    return ro.reading_order(_regions(spark, d), "image_id", ["engine", *REGION_ORDER]).select(
        *_REGION_KEYS, "cluster_id", "line_no", "reading_position")


@query
def q_reading_order_rotated(spark, d):
    """Reading order where some suppliers print sideways and image sizes are unknown."""
    turned = F.when(F.col("suppkey") % 3 == 0, 90.0).otherwise(0.0)
    rows = _regions(spark, d).drop("image_width", "image_height")
    return ro.reading_order(rows, "image_id", ["engine", *REGION_ORDER], turned).select(
        *_REGION_KEYS, "cluster_id", "line_no", "reading_position")


def _document_engines(spark: SparkSession, d: str) -> DataFrame:
    """Documents as texts of three engines: three consecutive documents show one image."""
    return spread(table(spark, d, "documents")).select(
        F.floor(F.col("doc_id") / 3).alias("image_id"), (F.col("doc_id") % 3).alias("engine_no"), F.col("text").alias("raw_text"),
        ((F.col("n_chars") % 101) / F.lit(100.0)).alias("average_confidence"))


@query
def q_quality_rank(spark, d):
    """Quality score of whole document texts and their rank per image."""
    ranked = fu.rank_variants(fu.with_quality(_document_engines(spark, d)), "image_id", "engine_no")
    return ranked.select("image_id", "engine_no", "score", "confidence_score", "keyword_score", "pattern_score",
                         "density_score", "variant_rank")


@query
def q_best_variant(spark, d):
    """Best variant per image and the spread of confidences."""
    return fu.select_variant(fu.with_quality(_document_engines(spark, d)), "image_id", "engine_no", "engine_no")


def _engine_words(spark: SparkSession, d: str) -> DataFrame:
    """Raw engine rows: some blank, some with negative or unreadable confidence."""
    rows = _regions(spark, d)
    conf = (F.when(F.col("partkey") % 13 == 0, "-1").when(F.col("partkey") % 17 == 0, "n/a")
            .otherwise((F.col("partkey") % 120).cast("string")))
    return rows.select(
        *_REGION_KEYS, F.when(F.col("suppkey") % 19 == 0, "  ").otherwise(F.concat(F.lit(" "), "text", F.lit(" "))).alias("text"),
        conf.alias("conf"), F.col("x0").alias("left"), F.col("y0").alias("top"),
        (F.col("x1") - F.col("x0")).alias("width"), (F.col("y1") - F.col("y0")).alias("height"))


@query
def q_engine_rows(spark, d):
    """Cleaned engine rows with polygons."""
    rows = rd.engine_regions(_engine_words(spark, d)).withColumn("b", g.xyxy(F.col("bounding_box")))
    return rows.select(*_REGION_KEYS, "text", "confidence", *[g.at(F.col("b"), i).alias(n) for i, n in enumerate(fu.CORNERS)])


@query
def q_engine_results(spark, d):
    """Assembled text and mean confidence per image and engine."""
    rows = rd.engine_regions(_engine_words(spark, d))
    return fu.assemble_results(rows, "image_id", "engine", order=["pos", "partkey", "suppkey", "text"])


@query
def q_pass_selection(spark, d):
    """Recognition pass kept per image."""
    passes = _regions(spark, d).groupBy("image_id", F.substring("engine", 8, 1).cast("int").alias("pass_no")).agg(
        F.count(F.lit(1)).alias("regions_detected"))
    return fu.select_pass(passes, "image_id", "pass_no", "regions_detected")


@query
def q_visual_statistics(spark, d):
    """Recognition statistics per image as a JSON document."""
    return ins.visual_statistics(_regions(spark, d), "image_id").select(
        "image_id", "average_confidence", "regions_detected", "raw_text_length", "image_width", "image_height",
        F.get_json_object("visual_statistics", "$.regions_detected").alias("json_regions"))


@query
def q_keyframes(spark, d):
    """Sharpest frame of each stretch of a video."""
    return fr.keyframes(view(spark, d, "frames"), "video_id", fps=6.0, max_frames=5, sample_fps=2.0)


def _frame_regions(spark: SparkSession, d: str) -> DataFrame:
    """Regions seen on frames: the label regions of an image belong to one of three frames."""
    return _regions(spark, d).withColumns({
        "video_id": F.col("image_id"), "frame_index": (F.col("suppkey") % 3).cast("int")})


@query
def q_frame_fusion(spark, d):
    """Text fused over the frames of a video, in reading order."""
    rows = _frame_regions(spark, d)
    return fr.fuse_frames(rows, "video_id", ["engine", *REGION_ORDER]).select(
        "video_id", "raw_text", "average_confidence", "regions_detected")


@query
def q_video_inspection(spark, d):
    """Keyframes, fusion, extraction and rules per video."""
    rows = _frame_regions(spark, d).drop("image_id")
    lines = F.concat(F.col("text"), F.when(F.col("partkey") % 3 == 0, F.concat(
        F.lit("\nMRP Rs. "), (F.col("partkey") % 500 + 1).cast("string"), F.lit(" incl. of all taxes"))).otherwise(""))
    frames = rows.groupBy("video_id", "frame_index").agg(F.max("y1").alias("sharpness"))
    # frames without any region are still frames: keep indexes dense
    every = frames.select("video_id").distinct().select("video_id", F.explode(F.sequence(F.lit(0), F.lit(2))).alias("frame_index"))
    dense = every.join(frames, ["video_id", "frame_index"], "left").na.fill(0.0, ["sharpness"])
    done = pipelines.inspect_videos(dense, rows.withColumn("text", lines), "video_id", ["engine", *REGION_ORDER], AS_OF,
                                    fps=2.0, max_frames=2, sample_fps=2.0)
    return done.select("video_id", "primary_frame", "frames_analyzed", "regions_detected", "overall_status",
                       "compliance_score", "coverage_note")


@query
def q_panel_merge(spark, d):
    """Best panel per field of a scan."""
    rows = view(spark, d, "panel_fields").withColumn("is_detected", F.lit(True))
    return pn.merge_panels(rows, "scan_id")


@query
def q_panel_note(spark, d):
    """Panel attribution note of a scan."""
    rows = view(spark, d, "panel_fields").withColumn("is_detected", F.lit(True))
    sources = pn.field_sources(pn.merge_panels(rows, "scan_id"), "scan_id")
    images = rows.groupBy("scan_id").agg((F.max("panel") + 1).alias("images"))
    return sources.join(images, "scan_id").select(
        "scan_id", pn.panel_note(F.col("images"), F.col("field_sources")).alias("note"))


def _panels(spark: SparkSession, d: str) -> DataFrame:
    """Panel texts: the label lines of a product spread over two panels."""
    labels = view(spark, d, "label_text", "part")
    lines = tx.label_lines(F.col("raw_text"))
    panel = lambda p: F.filter(lines, lambda ln, i: i % 2 == p)
    parts = F.array(*[F.struct(F.lit(p).alias("panel"), F.array_join(panel(p), "\n").alias("raw_text"),
                               F.size(panel(p)).alias("regions_detected"),
                               (F.lit(90 - 10 * p) / F.lit(100.0)).alias("average_confidence")) for p in (0, 1)])
    return labels.select("product_id", F.inline(parts))


@query
def q_panel_summary(spark, d):
    """Combined text and confidence over the panels of a product."""
    return pn.panel_summary(_panels(spark, d), "product_id").select(
        "product_id", "images_processed", rounded("average_confidence", 4).alias("average_confidence"), "regions_count", "ocr_text")


@query
def q_panel_inspection(spark, d):
    """Panels merged, checked against the rules, with attribution and insight."""
    done = pipelines.inspect_panels(_panels(spark, d), "product_id", AS_OF)
    return done.select("product_id", "overall_status", "compliance_score", "passed", "failed", "summary", "coverage_note", "category")


# ---------------------------------------------------------------------------------------------
# history and dashboard
# ---------------------------------------------------------------------------------------------


def _scans(spark: SparkSession, d: str) -> DataFrame:
    return view(spark, d, "scan_records")


def _rows(spark: SparkSession, d: str) -> DataFrame:
    return view(spark, d, "rule_results")


@query
def q_scan_page(spark, d):
    """Second page of the non-compliant scans of a brand in a year."""
    page = hi.scan_page(_scans(spark, d), limit=20, offset=5, status="non_compliant", product_name="brand 1",
                        date_from=SCAN_YEAR[0], date_to=SCAN_YEAR[1])
    return hi.page_projection(page).select("id", "product_name", "overall_status", "compliance_score", "created_at", "officer_id")


@query
def q_scan_page_deep(spark, d):
    """A page far back in the history of all scans."""
    page = hi.deep_page(_scans(spark, d), limit=50, offset=1000)
    return page.select("id", "product_name", "overall_status", "compliance_score", hi.iso_time(F.col("created_at").cast("timestamp")).alias("created_at"))


@query
def q_scan_total(spark, d):
    return hi.scan_total(_scans(spark, d), status="NON_COMPLIANT", officer_id=5, date_from=SCAN_YEAR[0], date_to=SCAN_YEAR[1])


@query
def q_scan_lookup(spark, d):
    return hi.page_projection(hi.scan_by_id(_scans(spark, d), 1234)).select(
        "id", "product_name", "overall_status", "compliance_score", "created_at", "officer_id")


@query
def q_scan_aggregates(spark, d):
    out = hi.compliance_aggregates(_scans(spark, d))
    shown = F.array_join(F.transform(F.map_entries("status_distribution"), lambda e: F.concat(
        e["key"], F.lit("="), e["value"].cast("string"))), ",")
    return out.withColumn("status_distribution", shown)


@query
def q_scans_deleted(spark, d):
    """Scans left after deleting the orders of one customer group."""
    gone = table(spark, d, "orders").filter(F.col("o_custkey") % 7 == 0).select(F.col("o_orderkey").alias("id"))
    return hi.delete_scans(_scans(spark, d), gone).select("id", "overall_status", "compliance_score")


@query
def q_deletion_report(spark, d):
    """Requested ids (order keys and their doubles) and whether they existed."""
    ids = table(spark, d, "orders").select((F.col("o_orderkey") * 2).alias("id"))
    return hi.deletion_report(_scans(spark, d), ids)


@query
def q_scans_officers(spark, d):
    """Scans with the officer (suppliers play officers) who made them."""
    officers = table(spark, d, "supplier").select(
        F.col("s_suppkey").alias("id"), F.col("s_name").alias("username"), F.lit("x").alias("hashed_password"),
        (F.col("s_suppkey") % 2 == 0).alias("is_active"))
    some = officers.filter(F.col("id") != 3)
    return hi.with_officers(_scans(spark, d), some).select("id", "officer_id", "officer_username", "officer_is_active", "overall_status")


def _stored_scans(spark: SparkSession, d: str) -> str:
    """Path of a scan table that holds all scans, written through the sink."""
    path = f"{shared_dir(spark)}/scans-{uuid.uuid4().hex}"
    wr.append_scans(_payloads(spark, d).withColumn("created_at", F.col("created_at").cast("timestamp")), path)
    return path


@query
def q_scans_rewritten(spark, d):
    """A stored scan table after deletions and corrections that touch some days only, read back."""
    path = _stored_scans(spark, d)
    wr.delete_stored(spark, path, table(spark, d, "orders").filter(F.col("o_custkey") % 7 == 0).select(F.col("o_orderkey").alias("id")))
    again = _payloads(spark, d).withColumn("created_at", F.col("created_at").cast("timestamp")).filter(F.col("id") % 11 == 0).withColumns({"overall_status": F.lit("REVIEWED"), "product_name": F.lit("corrected")})
    wr.upsert_stored(spark, path, again)
    return rd.read_scans(spark, path).select("id", "product_name", "overall_status", "compliance_score", F.date_format("scan_date", "yyyy-MM-dd").alias("scan_date"))


@query
def q_stored_range(spark, d):
    """Scans of a range of days, read from the stored table by its partitions."""
    scans = rd.read_scans(spark, _stored_scans(spark, d), SCAN_YEAR[0], SCAN_YEAR[1])
    return scans.select("id", "officer_id", "overall_status", "compliance_score", F.date_format("scan_date", "yyyy-MM-dd").alias("scan_date"))


@query
def q_csv_overview(spark, d):
    """The overview section of the audit record, written as CSV and read back."""
    scans = ex.normalize_scans(_stored(spark, d)).withColumn("extracted", F.lit(None).cast("string"))
    sections = wr.write_csv_audit(scans, f"{shared_dir(spark)}/audit-{uuid.uuid4().hex}")
    return spark.read.option("header", True).csv(sections["overview"])


@query
def q_index_file(spark, d):
    """The document index, written through its sink and read back in splits."""
    path = f"{shared_dir(spark)}/index-{uuid.uuid4().hex}"
    wr.write_document_index(_index(spark, d).drop("text"), path)
    return rd.read_document_records(spark, path).select(
        "doc_id", "filename", "title", "date", "document_type", "language", F.array_join("key_topics", ",").alias("key_topics"), "char_count")


@query
def q_rules_file(spark, d):
    """A rule catalogue with local rules, written as a JSON array and read back."""
    path = f"{shared_dir(spark)}/rules-{uuid.uuid4().hex}"
    wr.write_rules(_local_rules(spark, d), path)
    return rd.read_rules(spark, path).select("rule_no", "rule_id", "declaration_name", "legal_reference", "severity", "mandatory", "conditional")


@query
def q_regions_file(spark, d):
    """Region rows, written and read with their schema; flat boxes become polygons of two corners."""
    path = f"{shared_dir(spark)}/regions-{uuid.uuid4().hex}"
    flat = F.array("x0", "y0", "x1", "y1")
    rows = _regions(spark, d).select(*_REGION_KEYS, "text", "confidence", F.when(F.col("partkey") % 2 == 0, rd.flat_box(flat)).otherwise(
        g.polygon(*[F.col(n) for n in fu.CORNERS])).alias("bounding_box"))
    wr.write_regions(rows, path)
    back = fu.with_corners(rd.read_regions(spark, path))
    return back.select("image_id", "engine", "pos", "text", "confidence", *fu.CORNERS, F.size("bounding_box").alias("points"))


def _payloads(spark: SparkSession, d: str) -> DataFrame:
    """Incoming scans as JSON documents."""
    s = _scans(spark, d)
    status = F.concat(F.lit("OverallComplianceStatus."), "overall_status")
    return s.select(
        "id", "created_at", "officer_id", "product_name",
        F.to_json(F.struct(status.alias("overall_status"), (F.col("compliance_score") + F.lit(0.004)).alias("compliance_score"))).alias("compliance_result"),
        F.to_json(F.struct(F.struct(F.col("product_name").alias("value")).alias("product_name"))).alias("extracted_data"),
    ).drop("product_name")


@query
def q_shape_scans(spark, d):
    """Stored form of incoming scans."""
    return hi.shape_scan_records(_payloads(spark, d)).select(
        "id", "product_name", "overall_status", "compliance_score", F.date_format("scan_date", "yyyy-MM-dd").alias("scan_date"))


@query
def q_dash_summary(spark, d):
    return an.summary(_scans(spark, d))


@query
def q_dash_summary_range(spark, d):
    """Summary of a range given as texts; the end day means its midnight."""
    return an.summary(an.in_range(_scans(spark, d), "1997-01-01T00:00:00", "1997-06-30"))


@query
def q_dash_fields(spark, d):
    return an.violation_rates(_scans(spark, d), _rows(spark, d)).drop("field_order")


@query
def q_dash_trend(spark, d):
    return an.daily_trend(_scans(spark, d))


@query
def q_dash_brands(spark, d):
    return an.top_brands(_scans(spark, d), _rows(spark, d))


@query
def q_dash_auth(spark, d):
    return an.authenticity_rate(_scans(spark, d))


@query
def q_dash_height(spark, d):
    return an.text_heights(_rows(spark, d))


@query
def q_field_share(spark, d):
    return an.field_share(an.violation_rates(_scans(spark, d), _rows(spark, d))).select(
        "field_name", "violation_count", "percentage")


@query
def q_result_counts(spark, d):
    return an.result_counts(_rows(spark, d), "scan_id")


@query
def q_warned_results(spark, d):
    return an.results_with_status(_rows(spark, d), "WARNING").select("scan_id", "pos", "rule_id", "partkey", "suppkey")


def _stored(spark: SparkSession, d: str) -> DataFrame:
    """Scans with their rule results as a parsed compliance document.

    Rows of a scan are ordered by line, part and supplier.
    """
    r = _rows(spark, d)
    null = F.lit(None).cast("string")
    item = F.struct(
        F.col("pos").alias("o1"), F.col("partkey").alias("o2"), F.col("suppkey").alias("o3"), F.col("status").alias("o4"),
        F.col("pixel_text_height").alias("o5"),
        F.struct("rule_id", "declaration", "status",
                 F.when(F.col("partkey") % 5 == 0, null).otherwise(F.concat(F.lit("value "), (F.col("partkey") % 40).cast("string"))).alias("detected_value"),
                 F.when(F.col("suppkey") % 4 == 0, null).otherwise(F.concat(F.lit("reason "), (F.col("suppkey") % 9).cast("string"))).alias("reason"),
                 null.alias("legal_reference"), null.alias("official_legal_reference"), null.alias("source_pdf"), "severity",
                 F.struct("pixel_text_height", "text_height_pixels").alias("evidence")).alias("r"))
    per_scan = r.groupBy("scan_id").agg(F.transform(F.sort_array(F.collect_list(item)), lambda e: e["r"]).alias("results"))
    counted = F.when(F.col("id") % 2 == 0, F.size("results"))
    doc_ = F.struct(
        F.lit(None).cast("string").alias("product_name"), F.col("overall_status"), F.col("compliance_score"),
        counted.alias("total_checks"), F.lit(None).cast("int").alias("passed"), F.lit(None).cast("int").alias("failed"),
        F.lit(None).cast("int").alias("warnings"), F.lit(None).cast("string").alias("guidance_note"), F.col("results")).cast(schemas.COMPLIANCE)
    return _scans(spark, d).join(per_scan.withColumnRenamed("scan_id", "id"), "id").withColumn("compliance", doc_).drop("results")


@query
def q_stored_fields(spark, d):
    """Dashboard fields from stored JSON documents: write shape, narrow parse, explode, aggregate."""
    stored = _stored(spark, d).withColumn("compliance_result", F.to_json("compliance")).drop("compliance")
    parsed = rd.parse_scans(stored.select("id", "product_name", "created_at", "compliance_result"), schemas.DASHBOARD)
    rows = rd.stored_rule_rows(parsed)
    return an.violation_rates(parsed, rows).select("field_name", "rule_id", "total_evaluations", "violation_count", "violation_rate")


# ---------------------------------------------------------------------------------------------
# exports
# ---------------------------------------------------------------------------------------------


def _result_rows(spark: SparkSession, d: str) -> DataFrame:
    """Long result rows with the scan's name and time."""
    scans = ex.normalize_scans(_scans(spark, d).withColumn("compliance", F.lit(None).cast(schemas.COMPLIANCE)))
    r = _rows(spark, d).select(
        F.col("scan_id").alias("id"), "pos", "partkey", "suppkey", "rule_id", "declaration", "status", "severity",
        F.when(F.col("partkey") % 5 != 0, F.concat(F.lit("value "), (F.col("partkey") % 40).cast("string"))).alias("detected_value"),
        F.when(F.col("suppkey") % 4 != 0, F.concat(F.lit("reason "), (F.col("suppkey") % 9).cast("string"))).alias("reason"))
    return r.join(scans.select("id", "scan_id", "created_at_str", "product_name"), "id")


@query
def q_violations_log(spark, d):
    return ex.violations_log(_result_rows(spark, d))


@query
def q_rule_rows(spark, d):
    return ex.rule_rows(_result_rows(spark, d))


@query
def q_all_scans(spark, d):
    return ex.all_scans(ex.normalize_scans(_stored(spark, d)))


@query
def q_show_cause(spark, d):
    return ex.show_cause_rows(ex.normalize_scans(_stored(spark, d)))


@query
def q_overview_rows(spark, d):
    return ex.overview_rows(ex.normalize_scans(_stored(spark, d)))


@query
def q_kpis(spark, d):
    return ex.kpis(ex.normalize_scans(_stored(spark, d)))


@query
def q_flattened_fields(spark, d):
    """Field rows of scans whose extracted document was read off the customer's order."""
    extracted = F.to_json(F.struct(
        F.struct(F.col("product_name").alias("value"), F.lit("raw").alias("raw_value"),
                 (F.col("id") % 101 / F.lit(100.0)).alias("confidence")).alias("product_name"),
        F.struct(F.lit("").alias("value"), F.when(F.col("id") % 3 == 0, "₹5").alias("raw_value"),
                 F.lit(0.5).alias("confidence")).alias("mrp"),
        F.when(F.col("id") % 2 == 0, "food").otherwise("").alias("category")))
    stored = _stored(spark, d).withColumn("extracted", extracted)
    return ex.flattened_fields(ex.normalize_scans(stored))


@query
def q_visual_metrics(spark, d):
    """Visual metrics of scans, some of them not measured."""
    stats = F.to_json(F.struct(
        F.when(F.col("id") % 3 != 0, F.col("id") % 90 / F.lit(100.0)).alias("pdp_area_ratio"),
        F.when(F.col("id") % 4 != 0, F.col("id") % 30 / F.lit(2.0)).alias("mean_font_size_px"),
        F.when(F.col("id") % 5 != 0, F.col("id") % 12).alias("bounding_box_count")))
    scans = _scans(spark, d).withColumns({"compliance": F.lit(None).cast(schemas.COMPLIANCE), "visual_statistics": stats})
    return ex.visual_metrics(ex.normalize_scans(scans))


# ---------------------------------------------------------------------------------------------
# brands, documents, search, answers
# ---------------------------------------------------------------------------------------------


@query
def q_brand_authenticity(spark, d):
    """Samples against the reference of their brand."""
    refs = br.register_brands(None, view(spark, d, "brand_reference").select(
        F.concat(F.lit(" Brand "), F.col("brand_id").cast("string")).alias("brand_id"), "embedding",
        F.lit(0).alias("registered_at")))
    samples = view(spark, d, "brand_samples").withColumn("brand_id", F.concat(F.lit("BRAND "), F.col("brand_id").cast("string")))
    return br.compare_brands(samples, refs, 0.3).select(
        "sample_id", "brand_id", "similarity_score", "verdict", "threshold_used", "notes")


@query
def q_brand_registry(spark, d):
    """References after repeated registration: the latest entry per cleaned key."""
    new = view(spark, d, "brand_samples").select(
        F.concat(F.lit("  Brand "), F.col("brand_id").cast("string")).alias("brand_id"),
        F.concat(F.lit("Name "), F.col("sample_id").cast("string")).alias("brand_name"), F.col("sample_id").alias("registered_at"))
    old = new.filter(F.col("registered_at") < 100)
    return br.register_brands(br.register_brands(None, old), new).select("brand_id", "brand_name", "registered_at")


def _palette(prefix: int):
    """Eleven colours taken from one half of an embedding, all of its 32 numbers."""
    def channel(i):
        return F.floor(F.abs(F.get("embedding", F.lit(i)).cast("double")) * 1000).cast("int") % 256
    return F.array(*[F.array(*[channel(prefix + (3 * k + j) % 32) for j in range(3)]) for k in range(11)])


@query
def q_palette(spark, d):
    """Colour similarity of two palettes per sample."""
    return table(spark, d, "embeddings").select(
        "vec_id", palette_similarity(_palette(0), _palette(32)).alias("color_similarity"),
        palette_similarity(_palette(0), F.array().cast("array<array<int>>")).alias("without_reference"))


def _index(spark: SparkSession, d: str) -> DataFrame:
    return doc.document_index(view(spark, d, "legal_documents", "documents"))


@query
def q_doc_metadata(spark, d):
    """Index record of every document."""
    return _index(spark, d).select("doc_id", "filename", "title", "date", "document_type", "language",
                                   F.array_join("key_topics", ",").alias("key_topics"), "char_count")


@query
def q_doc_index_totals(spark, d):
    """Documents per type and language."""
    return _index(spark, d).groupBy("document_type", "language").agg(
        F.count(F.lit(1)).alias("documents"), F.sum("char_count").alias("chars"))


@query
def q_intent(spark, d):
    return view(spark, d, "questions").select("q_id", se.intent(F.col("text")).alias("intent"))


def _corpus(spark: SparkSession, d: str) -> DataFrame:
    """The corpus as a stored table, as a search service would keep it: read several times per search."""
    return stored(se.corpus(rd.builtin_rules(spark), _index(spark, d)))


@query
def q_corpus(spark, d):
    """Search corpus: rules and documents."""
    return se.corpus(rd.builtin_rules(spark), _index(spark, d)).select(
        "entry_type", "entry_no", "rule_id", "declaration_name", "official_legal_reference", "source_pdf",
        "last_amended_date", "applicability_notes", F.length("search_text").alias("search_chars"),
        F.length("english_text").alias("english_chars"), F.length("hindi_text_snippet").alias("hindi_chars"))


@query
def q_keyword_search(spark, d):
    """Three best entries of the whole corpus per question."""
    hits = se.keyword_search(view(spark, d, "questions"), _corpus(spark, d), 3, with_entry=False)
    return hits.select("q_id", "hit_rank", "entry_type", "entry_no", "score")


def _vector_sides(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Every vector asks and answers; the corpus texts are rules, cycled."""
    vectors = table(spark, d, "embeddings")
    texts = ["what is mrp 6(1)(e)", "manufacturer address rule", "net quantity", "date of packing", "rule 6 (1) (a)"]
    picked = F.element_at(F.array(*[F.lit(t) for t in texts]), (F.col("vec_id") % 5 + 1).cast("int"))
    questions = vectors.select(F.col("vec_id").alias("q_id"), picked.alias("text"), "embedding")
    rules = rd.builtin_rules(spark).select("rule_no", "rule_id", "declaration_name", "official_legal_reference")
    entries = vectors.withColumn("rule_no", (F.col("vec_id") % 23).cast("bigint")).join(
        rules, "rule_no", "left").select(
        F.when(F.col("rule_id").isNull(), "official_document").otherwise("rule").alias("entry_type"),
        F.col("vec_id").alias("entry_no"), "rule_id", "declaration_name", "official_legal_reference", "embedding")
    return questions, entries


@query
def q_vector_search(spark, d):
    """Three nearest other entries per vector, with boosts."""
    questions, entries = _vector_sides(spark, d)
    return se.vector_search(questions, entries, 3, others_only=True).select("q_id", "hit_rank", "entry_type", "entry_no", "score")


@query
def q_answers(spark, d):
    """Answers to all questions from the rules, the documents and the scan figures."""
    asked = view(spark, d, "questions")
    hits = se.keyword_search(asked, _corpus(spark, d), 2)  # the cited columns come along
    figures = ans.scan_metrics(_scans(spark, d), _rows(spark, d))
    return ans.answer(asked, hits, figures).select(
        "q_id", "intent", "reply", "confidence", F.coalesce(F.size("citations"), F.lit(0)).alias("citations"))


# ---------------------------------------------------------------------------------------------
# streams: the tables arrive as files, everything there is processed once
# ---------------------------------------------------------------------------------------------


def _arriving(spark: SparkSession, d: str, name: str) -> DataFrame:
    schema = table(spark, d, name).schema
    return spark.readStream.schema(schema).option("pathGlobFilter", f"{name}.parquet").parquet(d)


def _drained(stream: DataFrame) -> DataFrame:
    """Run a stream over everything available and read its sink."""
    spark = stream.sparkSession
    folder = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    live.run_available(stream, f"{folder}/out", f"{folder}/state")
    return spark.read.schema(stream.schema).parquet(f"{folder}/out")


def _arriving_scans(spark: SparkSession, d: str) -> DataFrame:
    scans = view(spark, d, "scan_records", given={"orders": _arriving(spark, d, "orders")})
    return scans.withColumn("created_at", F.col("created_at").cast("timestamp"))


@query
def q_stream_trend(spark, d):
    """Daily trend of arriving scans: every day the watermark has closed."""
    return _drained(live.live_trend(_arriving_scans(spark, d)))


@query
def q_stream_scores(spark, d):
    """Score and status of arriving products."""
    products = view(spark, d, "product_input", given={"part": dealt(_arriving(spark, d, "part"))})
    scored = live.evaluate_stream(products, as_of=AS_OF)
    return _drained(scored.select("product_id", "overall_status", "compliance_score", "passed", "failed", "guidance_note"))


@query
def q_stream_first_deliveries(spark, d):
    """Arriving scans of which every second is a re-delivery."""
    scans = _arriving_scans(spark, d).withColumn("id", F.floor(F.col("id") / 2)).withColumn("created_at", F.lit(dt.datetime(2024, 1, 1)))
    return _drained(live.first_deliveries(scans).select("id"))


def _arrival(when, lag):
    """Number of the delivery a scan comes with: two years each, ``lag`` deliveries later."""
    return (F.floor((F.year(when) - 1992) / 2) + lag).cast("int").alias("arrival")


def _delivered(spark: SparkSession, rows: DataFrame, run, last: DataFrame | None = None) -> DataFrame:
    """Sink of a stream whose rows (column ``arrival``) arrive one delivery after the other.

    The stream stops after each delivery and goes on from its checkpoint with the next one.
    """
    folder = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    plain = rows.drop("arrival")
    numbers = [r[0] for r in rows.select("arrival").distinct().orderBy("arrival").collect()]
    stream = None
    for number in numbers:
        now = rows.filter(F.col("arrival") == number).drop("arrival")
        if last is not None and number == numbers[-1]:
            now = now.unionByName(last)
        now.write.mode("append").parquet(f"{folder}/in")
        stream = stream or run(spark.readStream.schema(plain.schema).parquet(f"{folder}/in"))
        with live.rocks_state(spark):
            live.run_available(stream, f"{folder}/out", f"{folder}/state")
    return spark.read.schema(stream.schema).parquet(f"{folder}/out")


def _late_feed(spark: SparkSession, d: str) -> DataFrame:
    """Changes of the trend of all scans; every tenth scan comes one delivery late, and the feed ends with a mark."""
    scans = view(spark, d, "scan_records").withColumn("created_at", F.col("created_at").cast("timestamp")).select(
        "id", "created_at", "overall_status", "compliance_score", _arrival("created_at", F.when(F.col("id") % 10 == 0, 1).otherwise(0)))
    end = scans.agg((F.max("created_at") + F.expr("INTERVAL 4 DAYS")).alias("created_at")).select(
        *[F.col(n) if n == "created_at" else F.lit(None).cast(scans.schema[n].dataType).alias(n) for n in scans.columns if n != "arrival"])
    return _delivered(spark, scans, lambda stream: live.trend_changes(stream, shares=2), end)


@query
def q_stream_corrected(spark, d):
    """Daily trend of scans of which every tenth arrives years late: closed days and their corrections add up to the batch trend."""
    return live.corrected_trend(_late_feed(spark, d)).drop("revisions")


@query
def q_stream_late(spark, d):
    """The scans of that feed that arrived after their day was closed."""
    return live.late_scans(_late_feed(spark, d)).select("id", F.date_format("created_at", "yyyy-MM-dd").alias("date"))


@query
def q_stream_redeliveries(spark, d):
    """Scans of which every third is delivered twice at once and every seventh again after 90 days.

    The second copy is dropped; after 90 days the key is forgotten, unless both come with one delivery.
    """
    scans = view(spark, d, "scan_records").select("id", F.col("created_at").cast("timestamp").alias("created_at"))
    again = scans.filter(F.col("id") % 3 == 0)
    much_later = scans.filter(F.col("id") % 7 == 0).withColumn("created_at", F.col("created_at") + F.expr("INTERVAL 90 DAYS"))
    rows = scans.unionByName(again).unionByName(much_later)
    return _delivered(spark, rows.select("*", _arrival("created_at", F.lit(0))), live.first_deliveries).select(
        "id", F.date_format("created_at", "yyyy-MM-dd").alias("date"))
