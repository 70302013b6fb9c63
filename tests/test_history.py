import datetime as dt

from pyspark.sql import functions as F

from declara import schemas
from declara.operators import analytics, exports, history
from declara.sources import readers, writers

DAY = dt.datetime(2026, 8, 1, 10)
SCANS = [
    (1, "Brand Alpha Cookies", "COMPLIANT", 100.0, 0, ("GENUINE_LIKELY", 0.94), [("E", "MRP", "PASS", 18.0), ("C", "Net Quantity", "PASS", 14.0), ("A", "Manufacturer", "PASS", 10.0)]),
    (2, "Brand Beta Juice", "NON_COMPLIANT", 35.0, 0, ("SUSPICIOUS", 0.42), [("E", "MRP", "FAIL", 6.5), ("C", "Net Quantity", "FAIL", 7.0), ("A", "Manufacturer", "PASS", 32.0)]),
    (3, "Brand Beta Juice", "NON_COMPLIANT", 50.0, 1, ("SUSPICIOUS", 0.51), [("E", "MRP", "FAIL", 10.0), ("C", "Net Quantity", "PASS", 15.0), ("D", "Date of Packing (x)", "WARNING", 11.0)]),
    (4, "Brand Gamma Spices", "COMPLIANT", 90.0, 2, ("NO_REFERENCE_AVAILABLE", 0.0), [("E", "MRP", "PASS", 20.0), ("C", "Net Quantity", "PASS", 20.0)]),
]


def four_scans(spark):
    import json
    rows = [(i, name, status, score, json.dumps({"overall_status": status, "compliance_score": score, "results": [
        {"rule_id": "LMPC_RULE_6_1_" + r, "declaration": d, "status": s, "evidence": {"pixel_text_height": h}} for r, d, s, h in results]}),
        json.dumps({"verdict": auth[0], "similarity_score": auth[1]}), DAY + dt.timedelta(days=day, hours=i))
        for i, name, status, score, day, auth, results in SCANS]
    return spark.createDataFrame(rows, "id bigint, product_name string, overall_status string, compliance_score double, "
                                       "compliance_result string, authenticity_result string, created_at timestamp")


def test_dashboard(spark):
    parsed = readers.parse_scans(four_scans(spark))
    rows = readers.stored_rule_rows(parsed)
    s = analytics.summary(parsed).collect()[0]
    assert tuple(s) == (4, 2, 2, 50.0, 68.75)
    fields = {r.field_name: r for r in analytics.violation_rates(parsed, rows).collect()}
    assert (fields["mrp"].total_evaluations, fields["mrp"].violation_count, fields["mrp"].violation_rate) == (4, 2, 50.0)
    assert len(fields) == 10 and fields["best_before"].total_evaluations == 0
    assert fields["date_declaration"].declaration_name == "Date of Packing" and fields["importer_name"].declaration_name == "Importer Name"
    assert [r.total_scans for r in analytics.daily_trend(parsed).collect()] == [2, 1, 1]
    top = analytics.top_brands(parsed, rows).collect()[0]
    assert (top.brand_name, top.total_scans, top.non_compliant_scans, top.most_common_violation) == ("Brand Beta Juice", 2, 2, "MRP")
    a = analytics.authenticity_rate(parsed).collect()[0]
    assert (a.genuine_count, a.suspicious_count, a.no_reference_count, a.suspicious_flag_rate) == (1, 2, 1, 50.0)
    h = analytics.text_heights(rows).collect()[0]
    assert (h.under_8px, h.between_8_12px, h.between_12_24px, h.over_24px, h.total_regions_evaluated) == (2, 3, 5, 1, 11)
    assert sum(r.total_scans for r in analytics.daily_trend(parsed).collect()) == s.total_scans
    share = analytics.field_share(analytics.violation_rates(parsed, rows)).collect()[0]
    assert (share.field_name, share.percentage) == ("mrp", 50)


def test_empty_history(spark):
    empty = four_scans(spark).filter("id < 0")
    assert tuple(analytics.summary(empty).collect()[0]) == (0, 0, 0, 0.0, 0.0)
    assert history.compliance_aggregates(empty).collect()[0].total_scans == 0


def test_range_and_bounds(spark):
    days = [(i, dt.datetime(2026, 7, d), "COMPLIANT", 1.0) for i, d in enumerate((10, 20, 30))]
    df = spark.createDataFrame(days, "id int, created_at timestamp, overall_status string, compliance_score double")
    assert analytics.in_range(df, "2026-07-15", "2026-07-25T00:00:00Z").count() == 1
    assert analytics.in_range(df, "no date", None).count() == 3
    assert analytics.in_range(df, None, "2026-07-20").count() == 2


def test_aggregates_page_and_delete(spark):
    df = four_scans(spark)
    agg = history.compliance_aggregates(df).collect()[0]
    assert (agg.compliant_count, agg.compliance_rate, agg.average_score, agg.status_distribution) == (2, 50.0, 68.75, {"COMPLIANT": 2, "NON_COMPLIANT": 2})
    page = history.scan_page(df, limit=1, offset=1, status="non_compliant", product_name="BETA")
    assert [r.id for r in page.collect()] == [2]
    assert history.page_projection(page).columns == history.PAGE_COLUMNS
    ids = spark.createDataFrame([(2,), (2,), (9,)], "id bigint")
    assert sorted(r.id for r in history.delete_scans(df, ids).collect()) == [1, 3, 4]
    assert {(r.id, r.deleted) for r in history.deletion_report(df, ids).collect()} == {(2, True), (9, False)}


def test_store_and_read_back(spark, tmp_path):
    payload = four_scans(spark).drop("product_name", "overall_status", "compliance_score").withColumns({
        "extracted_data": F.lit('{"product_name": {"value": "Tea"}}'), "visual_statistics": F.lit(None).cast("string"),
        "image_path": F.lit(None).cast("string"), "officer_id": F.lit(7).cast("bigint"), "updated_at": F.col("created_at")})
    writers.append_scans(payload, str(tmp_path / "scans"))
    back = readers.read_scans(spark, str(tmp_path / "scans"), "2026-08-02", "2026-08-03T23:00:00")
    assert sorted((r.id, r.product_name, r.overall_status) for r in back.collect()) == [(3, "Tea", "NON_COMPLIANT"), (4, "Tea", "COMPLIANT")]
    plan = back._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(scan_date" in plan and "PushedFilters: [IsNotNull(created_at)" in plan
    scans = exports.normalize_scans(readers.parse_scans(readers.read_scans(spark, str(tmp_path / "scans"))))
    out = writers.write_csv_audit(scans, str(tmp_path / "audit"))
    csv = spark.read.option("header", True).csv(out["assessment"])
    assert csv.count() == 11 and csv.filter("rule_id = 'LMPC_RULE_6_1_E'").first().source_document.startswith("2023.7.10")
    assert spark.read.option("header", True).csv(out["overview"]).count() == 40


def test_audit_sections_read_their_scans_once(spark, tmp_path):
    seen = spark.sparkContext.accumulator(0)

    def count(score):
        seen.add(1)
        return score

    scans = readers.parse_scans(four_scans(spark)).withColumns({"officer_id": F.lit(0), "extracted": F.lit(None).cast("string")})
    scans = exports.normalize_scans(scans).withColumn("compliance_score", F.udf(count, "double")("compliance_score"))
    out = writers.write_csv_audit(scans, str(tmp_path / "audit"))
    assert seen.value == 4
    for name, path in out.items():
        files = [f.name for f in (tmp_path / "audit" / name).glob("part-*")]
        assert files and all(f.endswith(".csv.gz") for f in files) and path.endswith(name)
    plain = writers.write_csv_audit(scans, str(tmp_path / "plain"), "none")
    for name in out:
        a, b = (sorted(map(str, spark.read.option("header", True).csv(p[name]).collect())) for p in (out, plain))
        assert a == b and (a or name == "declarations")


def test_exports(spark):
    scans = exports.normalize_scans(readers.parse_scans(four_scans(spark)).withColumns({"officer_id": F.lit(0), "extracted": F.lit(None).cast("string")}))
    sheet = {r.scan_id: r for r in exports.all_scans(scans).collect()}
    assert sheet["2"].failed_rule_ids == "LMPC_RULE_6_1_E, LMPC_RULE_6_1_C" and sheet["3"].violations_count == 1
    assert sheet["1"].failed_rule_ids == "None" and sheet["1"].officer_id == "N/A" and sheet["1"].score == "100.0%"
    log = exports.violations_log(exports.result_rows(scans))
    assert log.count() == 4
    notice = exports.show_cause_rows(scans)
    assert notice.filter("scan_id = '1'").count() == 3 and notice.filter("scan_id = '3'").count() == 2


def test_rule_catalogue_reader(spark, tmp_path):
    import json

    import pytest

    from declara import catalog as c
    path = tmp_path / "rules.json"
    path.write_text(json.dumps([{k: v for k, v in r.items() if v is not None} for r in c.RULES], ensure_ascii=False), encoding="utf-8")
    assert readers.rules_for_plan(readers.read_rules(spark, str(path))) == c.RULES
    assert readers.rules_for_plan(readers.builtin_rules(spark)) == c.RULES
    with pytest.raises(Exception):
        readers.read_rules(spark, str(tmp_path / "none.json")).collect()


def test_engine_rows(spark):
    df = spark.createDataFrame([(1, " MRP ", "87.5", 1, 2, 3, 4), (1, " ", "90", 0, 0, 1, 1), (1, "x", "-1", 0, 0, 1, 1), (1, "y", "n/a", 0, 0, 1, 1), (1, "z", "130", 0, 0, 1, 1)],
                               "image_id int, text string, conf string, left int, top int, width int, height int")
    got = {r.text: r for r in readers.engine_regions(df).collect()}
    assert set(got) == {"MRP", "z"} and got["MRP"].confidence == 0.875 and got["z"].confidence == 1.0
    assert got["MRP"].bounding_box == [[1.0, 2.0], [4.0, 2.0], [4.0, 6.0], [1.0, 6.0]]
    assert schemas.REGIONS


def test_only_touched_days_are_rewritten(spark, tmp_path):
    import os

    path = str(tmp_path / "scans")

    def payload(rows):
        return spark.createDataFrame([(i, dt.datetime(2026, 1, day, 12), name, f"S.{status}", 50.0, None, None) for i, day, name, status in rows],
                                     "id bigint, created_at timestamp, product_name string, overall_status string, compliance_score double, "
                                     "compliance_result string, extracted_data string")

    def files():
        return {f"{d[len(path):]}/{n}" for d, _, names in os.walk(path) for n in names if n.endswith(".parquet")}

    def kept():
        return {r.id: (r.scan_date.day, r.product_name, r.overall_status) for r in readers.read_scans(spark, path).collect()}

    writers.append_scans(payload([(i, 1 + i % 4, f"n{i}", "NEW") for i in range(40)]), path)
    before = files()
    writers.delete_stored(spark, path, spark.createDataFrame([(i,) for i in [1, 5, 5, 999, *range(2, 40, 4)]], "id bigint"))
    after = files()
    assert {f for f in before if "-01-01/" in f or "-01-04/" in f} == {f for f in after if "-01-01/" in f or "-01-04/" in f}
    assert not any("-01-03/" in f for f in after)  # nothing of that day is left
    assert set(kept()) == {i for i in range(40) if i % 4 != 2 and i not in (1, 5)}
    writers.upsert_stored(spark, path, payload([(0, 2, "moved", "B"), (0, 1, "older", "A"), (77, 9, "fresh", "C")]))
    assert {f for f in after if "-01-04/" in f} == {f for f in files() if "-01-04/" in f}
    rows = kept()
    assert rows[0] == (2, "moved", "B") and rows[77] == (9, "fresh", "C") and len(rows) == 29
    writers.delete_stored(spark, path, spark.createDataFrame([(12345,)], "id bigint"))
    writers.upsert_stored(spark, path, payload([]))
    assert kept() == rows


def test_deep_pages_equal_sorted_pages(spark):
    import random as rnd

    made = rnd.Random(3)
    rows = [(i, None if i % 50 == 7 else dt.datetime(2026, 1, 1) + dt.timedelta(days=made.choice([0, 0, 0, 1, 5]), seconds=made.randrange(90)), "X") for i in range(700)]
    scans = spark.createDataFrame(rows, "id bigint, created_at timestamp, overall_status string")
    order = [r[0] for r in sorted(rows, key=lambda r: (r[1] is None, -(r[1] or dt.datetime(2026, 1, 1)).timestamp(), r[0]))]
    for at_once in (5, 100_000):
        for offset in (0, 1, 333, 680, 690, 699, 5000):
            page = history.deep_page(scans, limit=20, offset=offset, at_once=at_once)
            assert [r.id for r in page.collect()] == order[offset:offset + 20], (at_once, offset)
