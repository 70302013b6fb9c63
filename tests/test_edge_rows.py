"""Rows at the edges: bounds with zones, dropped frames, equal registrations, images without text, odd file names."""

import datetime as dt

from pyspark.sql import functions as F

from declara import schemas
from declara.operators import analytics, brands, frames, fusion, history
from declara.sources import readers
from declara.streaming import live

UTC = dt.timezone.utc


def scans_at(spark, *times):
    rows = [(i, t) for i, t in enumerate(times)]
    return spark.createDataFrame(rows, "id bigint, t string").select("id", F.to_timestamp("t").alias("created_at"))


def test_bounds_without_zone_are_utc(spark):
    rows = scans_at(spark, "2024-01-01T20:00:00Z", "2024-01-01T22:00:00Z")
    for start in ("2024-01-01T21:00:00", dt.datetime(2024, 1, 1, 21), "2024-01-02T02:30:00+05:30"):
        assert [r.id for r in analytics.in_range(rows, start).collect()] == [1]
    assert [r.id for r in history.filter_scans(rows, date_to=dt.datetime(2024, 1, 1, 21)).collect()] == [0]
    assert analytics.parse_bound("x") is None and analytics.parse_bound(dt.date(2024, 1, 2)) == dt.datetime(2024, 1, 2, tzinfo=UTC)


def test_range_keeps_the_day_before_an_offset_bound(spark, tmp_path):
    rows = scans_at(spark, "2024-01-01T20:00:00Z").withColumn("scan_date", F.to_date("created_at"))
    rows = rows.select(*[(F.col(f.name) if f.name in rows.columns else F.lit(None)).cast(f.dataType).alias(f.name)
                         for f in spark.createDataFrame([], schemas.SCANS).schema])
    rows.write.partitionBy("scan_date").parquet(str(tmp_path / "scans"))
    assert readers.read_scans(spark, str(tmp_path / "scans"), "2024-01-02T00:30:00+05:30").count() == 1


def test_keyframes_with_dropped_frames(spark):
    kept = [0, 2, 4, 50, 52, 300_000, 300_002]
    rows = spark.createDataFrame([("v", i, float(n)) for n, i in enumerate(kept)], "video string, frame_index int, sharpness double")
    got = sorted(r.frame_index for r in frames.keyframes(rows, "video", fps=2.0, max_frames=3).collect())
    assert len(got) == 3 and got[-1] == 300_002


def test_registration_has_a_total_order(spark):
    kind = "brand_id string, brand_name string, embedding array<double>, registered_at timestamp"
    t = dt.datetime(2024, 1, 1)
    old = spark.createDataFrame([("a", "Old", [1.0], t), ("b", "Kept", [1.0], None)], kind)
    new = spark.createDataFrame([("A ", "New", [2.0], t), ("c", "", [3.0], None), ("c", "", [3.0], None)], kind)
    got = {r.brand_id: (r.brand_name, r.embedding) for r in brands.register_brands(old, new).collect()}
    assert got == {"a": ("New", [2.0]), "b": ("Kept", [1.0]), "c": ("c", [3.0])}


def test_reference_without_vector_is_told_from_no_reference(spark):
    refs = spark.createDataFrame([("a", None), ("b", [1.0, 0.0])], "brand_id string, embedding array<double>")
    rows = spark.createDataFrame([("a", [1.0, 0.0]), ("x", [1.0, 0.0]), ("b", [1.0, 0.0])], "brand_id string, embedding array<double>")
    got = {r.brand_id: r for r in brands.compare_brands(rows, refs).collect()}
    assert got["a"].notes == "Reference data contains corrupted embedding." and got["a"].verdict == "NO_REFERENCE_AVAILABLE"
    assert "No verified reference" in got["x"].notes and got["b"].verdict == "GENUINE_LIKELY"


def regions(spark, rows):
    return spark.createDataFrame(rows, "image_id int, engine string, pos int, text string, confidence double, "
                                       "x0 double, y0 double, x1 double, y1 double")


def test_images_without_text_have_an_empty_result(spark):
    found = regions(spark, [(1, "e", 0, "Net weight 5 g", 0.9, 0.0, 0.0, 10.0, 10.0)])
    images = spark.createDataFrame([(1,), (2,)], "image_id int")
    got = {r.image_id: r for r in fusion.ensemble(found, "image_id", ["pos"], images=images).collect()}
    assert got[1].winning_engine == "e"
    assert (got[2].winning_engine, got[2].engine_agreement_score, got[2].merged_text, got[2].active_engines) == ("None", 0.0, "", 0)
    assert got[2].regions == [] and got[2].clusters_count == 0


def test_low_threshold_in_a_crowded_image(spark):
    rows = [(1, "e", i, "t", 0.5, 20.0 * (i // 2) + 4 * (i % 2), 0.0, 20.0 * (i // 2) + 4 * (i % 2) + 10, 10.0) for i in range(40)]
    clusters = fusion.cluster_regions(regions(spark, rows), "image_id", ["pos"], threshold=0.3)
    folded = fusion.cluster_regions(regions(spark, rows), "image_id", ["pos"], threshold=0.3)
    assert clusters.count() == folded.count() == 20


def test_odd_file_names_and_whole_texts(spark, tmp_path):
    (tmp_path / "50% x+y z.txt").write_text("long " * 1000 + "needle")
    row = readers.read_extracted_texts(spark, str(tmp_path)).first()
    assert row.stem == "50% x+y z" and row.snippet.endswith("needle")


def test_trend_mean_counts_scored_rows_only(spark):
    rows = scans_at(spark, "2024-01-01T20:00:00Z", "2024-01-01T22:00:00Z").withColumns({
        "overall_status": F.lit("COMPLIANT"), "compliance_score": F.when(F.col("id") == 0, 80.0)})
    assert live.live_trend(rows).first().average_score == 80.0
