"""Grounded answers to questions about rules and about the stored scans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from declara import catalog as c
from declara.functions.base import filled, fixed_text, rounded, strip
from declara.operators import analytics as a
from declara.operators.documents import has_devanagari
from declara.operators.search import intent

MIN_RULE_SCORE = 0.05
MIN_SOFT_SCORE = 0.35


def scan_metrics(scans: DataFrame, rows: DataFrame) -> DataFrame:
    """The figures the answers quote, as exactly one row: summary, two brands, field rates.

    ``fields`` has one entry per declared field or unknown rule id, in dashboard order.
    """
    key = F.lit(1).alias("_one")
    brands = a.top_brands(scans, rows, 2).agg(F.sort_array(F.collect_list(F.struct(
        (-F.col("non_compliant_scans")).alias("o1"), F.col("average_compliance_score").alias("o2"), "brand_name",
        "non_compliant_scans", "non_compliance_rate", "most_common_violation"))).alias("brands"))
    fields = a.violation_rates(scans, rows).agg(F.sort_array(F.collect_list(F.struct(
        (-F.col("violation_count")).alias("o1"), (-F.col("violation_rate")).alias("o2"), "field_order", "field_name",
        "rule_id", "declaration_name", "total_evaluations", "violation_count", "violation_rate"))).alias("fields"))
    total = a.summary(scans)
    return (total.select(key, "*").join(brands.select(key, "*"), "_one").join(fields.select(key, "*"), "_one"))


def _say(*parts) -> Column:
    return F.concat(*[p if isinstance(p, Column) else F.lit(p) for p in parts])


def _number(col: Column) -> Column:
    return col.cast("string")


def rule_reply(question: Column, top: Column) -> Column:
    """Answer text from the best hit; in Hindi if the question is and a Hindi text exists."""
    hindi = has_devanagari(question) & filled(top["hindi_text_snippet"]).isNotNull()
    text = {n: F.coalesce(top[n], F.lit("None")) for n in (
        "declaration_name", "official_legal_reference", "source_pdf", "english_text", "last_amended_date")}
    # Answer templates
    in_hindi = _say(
        "विधिक मापविज्ञान (पैकेज्ड कमोडिटीज) नियम, 2011 के अनुसार:\n\n• **प्रावधान**: ", text["declaration_name"],
        "\n• **कानूनी संदर्भ**: ", text["official_legal_reference"], "\n• **विवरण**: ", top["hindi_text_snippet"],
        "\n• **स्रोत दस्तावेज**: `", text["source_pdf"], "` (संशोधन तिथि: ", text["last_amended_date"], ")")
    in_english = _say(
        f"According to the **{c.PCR}**:\n\n• **Declaration**: ", text["declaration_name"],
        "\n• **Statutory Citation**: ", text["official_legal_reference"], "\n• **Official Requirement**: ", text["english_text"],
        "\n• **Official Source Document**: `", text["source_pdf"], "` (Last amended: ", text["last_amended_date"], ")")
    return F.when(hindi, in_hindi).otherwise(in_english)


def data_reply(question: Column) -> Column:
    """Answer text from the metrics columns."""
    low = F.lower(question)
    total = F.col("total_scans")
    b1, b2 = F.get("brands", F.lit(0)), F.get("brands", F.lit(1))
    # Answer templates
    empty = F.lit(
        "The Legal Metrology inspection repository currently has **0 scan records**. "
        "No compliance analytics or violation statistics are available yet.")
    brands = F.when(F.size("brands") > 0, F.concat_ws(
        "\n", _say("Based on ", _number(total), " persistent audit scans, the top non-compliant brands are:"),
        _say("1. **", b1["brand_name"], "**: ", _number(b1["non_compliant_scans"]), " violations (", _number(b1["non_compliance_rate"]),
             "% non-compliance, most common issue: ", b1["most_common_violation"], ")"),
        _say("2. **", b2["brand_name"], "**: ", _number(b2["non_compliant_scans"]), " violations"),
    )).otherwise(_say("All ", _number(total), " scanned brands are currently fully compliant."))
    worst = F.slice(F.filter("fields", lambda f: f["violation_count"] > 0), 1, 3)
    listed = F.array_join(F.transform(worst, lambda f: _say(
        "**", f["declaration_name"], "** (", _number(f["violation_count"]), " violations, ", _number(f["violation_rate"]), "%)")), ", ")
    violated = F.when(F.size(worst) > 0, _say("The most frequently violated statutory declarations are: ", listed, ".")).otherwise(
        _say("No statutory violations recorded across the ", _number(total), " audits."))
    summary = _say(
        "**Legal Metrology Inspection Analytics Summary**:\n\n• **Total Scans Recorded**: ", _number(total),
        "\n• **Overall Compliance Rate**: ", fixed_text("compliance_rate", 1), "%\n• **Compliant Packages**: ",
        _number(F.col("compliant_scans")), "\n• **Non-Compliant / Violations**: ", _number(F.col("non_compliant_scans")),
        "\n• **Average Compliance Score**: ", fixed_text("average_compliance_score", 1), "%")
    return (
        F.when(total == 0, empty).when(low.contains("top") | low.contains("brand"), brands)
        .when(low.contains("violation") | low.contains("field"), violated).otherwise(summary)
    )


def _hybrid_clause(rule_id: Column) -> Column:
    stat = F.get(F.filter("fields", lambda f: f["rule_id"].eqNullSafe(rule_id)), F.lit(0))
    total = F.col("total_scans")
    known = stat.isNotNull() & (total > 0)
    return F.when(known, _say(
        "\n\n**Empirical Repository Statistics**:\n• **Field Violation Rate**: ", _number(stat["violation_rate"]),
        "%\n• **Total Evaluations**: ", _number(stat["total_evaluations"]), " scans (", _number(stat["violation_count"]),
        " violations observed).")).otherwise(_say(
            "\n\n**Repository Metrics**: Total ", _number(total), " scans recorded in the database."))


def answer(questions: DataFrame, hits: DataFrame, metrics: DataFrame) -> DataFrame:
    """One answer per question (q_id, text): intent, reply, confidence, citations.

    ``hits`` are the ranked search results (two per question are cited); ``metrics`` is the single
    row of ``scan_metrics``, the only thing that is broadcast.
    """
    cited = hits.filter(F.col("hit_rank") <= 2)
    entry = F.struct("hit_rank", *[F.col(n) for n in (
        "rule_id", "declaration_name", "official_legal_reference", "source_pdf", "english_text",
        "hindi_text_snippet", "last_amended_date", "score")])
    best = cited.groupBy("q_id").agg(F.sort_array(F.collect_list(entry)).alias("_hits"))
    asked = questions.select("q_id", strip(F.col("text")).alias("question")).join(best, "q_id", "left")
    asked = asked.withColumns({"_intent": intent(F.col("question")), "_top": F.get("_hits", F.lit(0)), "_one": F.lit(1)})
    rows = asked.join(F.broadcast(metrics), "_one")
    top, kind, question = F.col("_top"), F.col("_intent"), F.col("question")
    score = F.coalesce(top["score"], F.lit(0.0))
    grounded = score > MIN_RULE_SCORE
    soft = (kind == "UNKNOWN") & (question != "") & (score >= MIN_SOFT_SCORE)
    as_rule = F.when(grounded, rule_reply(question, top)).otherwise(F.lit(c.REFUSAL))
    reply = (
        F.when((kind == "RULE_LOOKUP") | soft, as_rule).when(kind == "DATA_QUERY", data_reply(question))
        .when(kind == "HYBRID", F.concat(as_rule, _hybrid_clause(F.when(grounded, top["rule_id"])))).otherwise(c.REFUSAL)
    )
    confidence = (
        F.when((kind == "RULE_LOOKUP") | soft, F.when(grounded, F.least(F.lit(1.0), rounded(score + 0.1, 4))).otherwise(0.0))
        .when(kind == "DATA_QUERY", 1.0).when(kind == "HYBRID", 0.95).otherwise(0.0)
    )
    cites = grounded & ((kind == "RULE_LOOKUP") | (kind == "HYBRID") | soft)
    return rows.select(
        "q_id", "question", F.when(soft, "RULE_LOOKUP").otherwise(kind).alias("intent"), reply.alias("reply"),
        confidence.alias("confidence"), F.when(cites, F.col("_hits")).otherwise(F.slice("_hits", 1, 0)).alias("citations"))
