import re

from pyspark.sql import functions as F

from declara import catalog as c
from declara.functions import normalize as n
from declara.functions import text as tx


def brute_line(line):
    """The repairs of one line with Python's own regex engine."""
    if not line or not line.strip():
        return ""
    out = line.strip()
    for pattern, repl in c.TEXT_REPAIRS:
        out = re.sub(pattern, repl.replace("$10", r"\g<1>0"), out, flags=re.I)
    if any(ch.isdigit() for ch in out) or any(w in out.lower() for w in c.NUMERIC_LINE_WORDS):
        for pattern, repl in c.NUMERIC_REPAIRS:
            out = re.sub(pattern, repl, out)
    for pattern, repl in c.UNIT_REPAIRS:
        out = re.sub(pattern, re.sub(r"\$(\d)", r"\\\1", repl), out, flags=re.I)
    return re.sub(r"[ \t]+", " ", out).strip()


LINES = [
    "MRP R5 5O gms", "Rs 50 1l kg", "Net Wt.500gms", "Pkcl by Cust Care", "Rs.45O only", "", "  ", "Net Oty: 1OO g", "M.R.P.R5 20",
    "mrp: r5 12", "B0/- 5", "Mfc 0l/2O25", "Best Befor 6 months", "Made in lndia", "Toll Fre 18OO 123", "é12 gé 5 kgs.", "मात्रा 5O ग्राम",
    "1S5 ltrs 20 pcs", "O5/2024 l2", "Net Vol 5OO mls", "²5 gm", "Rs..5", "10 gms. pack", "x\t\ty  z",
]


def test_repairs_match_brute_force(spark):
    df = spark.createDataFrame([(i, s) for i, s in enumerate(LINES)], "i int, s string")
    got = {r.i: r.c for r in df.select("i", tx.clean_line(F.col("s")).alias("c")).collect()}
    assert {i: got[i] for i in got} == {i: brute_line(s) for i, s in enumerate(LINES)}


def test_repairs_match_brute_force_on_documents(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text")
    got = docs.select("doc_id", "text", tx.clean_text(F.col("text")).alias("c")).collect()
    for r in got:
        want = "\n".join(brute_line(s) for s in r.text.splitlines() if s.strip())
        assert r.c == want, r.doc_id


def test_clean_result(spark):
    region = "array<struct<text:string,confidence:double,bounding_box:array<array<double>>>>"
    df = spark.createDataFrame([
        (1, "ignored", [("R5 20", 0.9, None), ("  ", 0.5, None)], []),
        (2, "a R5\n\nb", [], ["gray", c.REPAIR_MARKER]), (3, "kept", [(" ", 0.5, None)], [])],
        f"id int, raw_text string, regions {region}, applied array<string>")
    out = {r.id: r.x for r in df.select("id", tx.clean_result(F.col("raw_text"), F.col("regions"), F.col("applied")).alias("x")).collect()}
    assert out[1].raw_text == "Rs. 20" and len(out[1].regions) == 1 and out[1].preprocessing_applied == [c.REPAIR_MARKER]
    assert out[2].raw_text == "a Rs.\nb" and out[2].preprocessing_applied == ["gray", c.REPAIR_MARKER]
    assert out[3].raw_text == "kept" and len(out[3].regions) == 1


def test_normal_forms(spark):
    df = spark.createDataFrame([(s,) for s in (
        "Rs 1,234.5 incl", "0.140 L", "1234567 g", "0.00001 g", "Mfd: June 2025", "12/26", "MAY--2026", "made in sri lanka.", "us", "S60017", "A1", "AB12")], "s string")
    s = F.col("s")
    got = {r.s: r for r in df.select("s", n.price(s).alias("p"), n.quantity(s).alias("q"), n.label_date(s).alias("d"),
                                     n.country(s).alias("c"), n.is_code(s).alias("code")).collect()}
    assert got["Rs 1,234.5 incl"].p.value == "₹1234.50 incl. of all taxes"
    assert got["0.140 L"].q.value == "0.14 L" and got["1234567 g"].q.value == f"{1234567.0:g} g" and got["0.00001 g"].q.value == f"{0.00001:g} g"
    assert [got[k].d for k in ("Mfd: June 2025", "12/26", "MAY--2026")] == ["06/2025", "12/2026", "05/2026"]
    assert got["made in sri lanka."].c == "Sri Lanka" and got["us"].c == "US"
    assert [got[k].code for k in ("S60017", "A1", "AB12", "us")] == [True, True, True, False]
