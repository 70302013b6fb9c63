"""Registered queries of the corpus operators and their SQL counterparts, where SQL can state the result."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from declara.llm import (fim, langid, licenses, media, mixing, neighbours, packing, pii, quality, secret_scan, simhash, spelling,
                         url_filter)
from declara.llm.common import table

#: The rules every page is judged by, and words that name unwanted domains.
URL_RULES = [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/")]
UNWANTED = ["adult", "ads", "bets", "casino", "pills", "spam"]


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return url_filter.judge(pages, url_filter.suspicious_domains(pages, UNWANTED), URL_RULES)


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(packing.pieces(table(spark, sf_dir, "documents")))


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op4_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.nearest(table(spark, sf_dir, "embeddings"), F.col("id") % 100 == 0)


def op5_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    files = media.store_media(docs.select(media.payload_of(F.col("text")).alias("payload")))
    pages = docs.select("doc_id", media.as_page(F.col("text"), F.col("source")).alias("html"))
    found = media.resolved(media.sequences(pages, "doc_id", "html"), media.read_back(files))
    return found.select(F.col("id").alias("doc_id"), F.col("bytes_before").alias("n_bytes"), "payload_bytes",
                        "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "position", "caption")


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op7_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan_licenses(table(spark, sf_dir, "documents"))


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    scores = quality.score_documents(quality.describe(table(spark, sf_dir, "documents")), table(spark, sf_dir, "labels"))
    held = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(5)) == 0
    return scores.select("doc_id", F.coalesce(held, F.lit(False)).alias("held_out"), "score",
                         F.when(F.col("score") >= 0.3, 1).otherwise(0).alias("predicted"))


def _spans_sha(spans: Column) -> Column:
    return F.sha2(pii.spans_text(spans).cast("binary"), 256)


def _count(spans: Column, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("bigint").alias(f"n_{kind}")


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find_personal_data(table(spark, sf_dir, "documents"))
    spans = F.col("spans")
    counts = [_count(spans, k) for k in pii.KINDS]
    return found.select("doc_id", *counts[:4], _spans_sha(F.filter(spans, lambda s: s["kind"].isin(*pii.BASE))).alias("base_sha256"),
                        pii.spans_text(spans).alias("spans"), *counts[4:])


def op10_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_scan.find_secrets(table(spark, sf_dir, "documents"))
    spans = F.col("spans")
    counts = [_count(spans, k) for k in secret_scan.KINDS]
    return found.select("doc_id", *counts, _spans_sha(F.filter(spans, lambda s: s["kind"].isin(*secret_scan.KINDS))).alias("base_sha256"),
                        pii.spans_text(spans).alias("spans"))


def op11_fim(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fim.digests(table(spark, sf_dir, "documents"))


def op12_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(spelling.count_words(table(spark, sf_dir, "documents"), delete_every=97))


def op13_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = langid.identify(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.coalesce(~langid.learnable(), F.lit(False)).alias("held_out"), "lang_pred", "score")


QUERIES = {f.__name__: f for f in (op1_url_filter, op2_packing, op3_simhash, op4_neighbours, op5_media, op6_mixing, op7_licenses,
                                   op8_quality, op9_pii, op10_secrets, op11_fim, op12_spelling, op13_language)}

# SQL counterparts -----------------------------------------------------------------------------


def _text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def _rule_sql() -> tuple[str, str]:
    fits = [(say, name + start, f"(host = {_text(name)} OR ends_with(host, {_text('.' + name)})) AND starts_with(path, {_text(start)})")
            for say, name, start in sorted(URL_RULES, key=lambda r: -len(r[1] + r[2]))]
    return ("CASE " + " ".join(f"WHEN {test} THEN {_text(rule)}" for _, rule, test in fits) + " END",
            "CASE " + " ".join(f"WHEN {test} THEN {_text(say)}" for say, _, test in fits) + " END")


_RULE, _VERDICT = _rule_sql()
_OP1 = f"""WITH r AS (SELECT page_id, CASE WHEN position('://' IN url) > 0 THEN substr(url, position('://' IN url) + 3) ELSE '' END AS rest FROM pages),
p AS (SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
  regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM r),
h AS (SELECT DISTINCT host, string_split(host, '.') AS labels FROM p WHERE length(host) <= {url_filter.LONGEST_HOST}),
m AS (SELECT labels, list_position(list_transform(labels, lambda l: list_has_any(string_split(l, '-'), [{', '.join(map(_text, UNWANTED))}])), true) AS i FROM h),
e AS (SELECT DISTINCT array_to_string(labels[i:], '.') AS entry FROM m WHERE i > 0 AND i < len(labels)),
j AS (SELECT *, {_RULE} AS rule, {_VERDICT} AS said FROM p),
x AS (SELECT DISTINCT host FROM h, e WHERE host = entry OR ends_with(host, '.' || entry))
SELECT page_id, j.host, path, rule, coalesce(said, CASE WHEN x.host IS NOT NULL THEN 'block' ELSE 'allow' END) AS verdict,
  (x.host IS NOT NULL AND rule IS NULL) AS listed
FROM j LEFT JOIN x ON x.host = j.host"""

_OP4 = """WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings WHERE vec_id IS NOT NULL AND len(embedding) > 0
  AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
d AS (SELECT q.vec_id AS query_id, c.vec_id, sqrt(list_reduce(list_transform(range(1, len(q.e) + 1), lambda i: (q.e[i] - c.e[i]) * (q.e[i] - c.e[i])), lambda a, x: a + x)) AS score FROM v q JOIN v c ON c.vec_id <> q.vec_id AND len(c.e) = len(q.e) WHERE q.vec_id % 100 = 0)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score, vec_id) AS INT) AS rank, vec_id, score FROM d
QUALIFY rank <= 10"""

_TEMPLATES = ", ".join(f"({i}, {_text(name)}, [{', '.join(map(_text, licenses.template_bigrams(notice)))}])"
                       for i, (name, notice) in enumerate(licenses.TEMPLATES))
_OP7 = f"""WITH d AS (SELECT row_number() OVER () AS row, doc_id, lower(coalesce(text, '')) AS t FROM documents),
s AS (SELECT row, unnest(list_concat(string_split(t, chr(10)),
  list_filter(regexp_split_to_array(t, '\\n[ \\t\\r]*\\n'), lambda p: contains(p, chr(10))))) AS s FROM d),
n AS (SELECT row_number() OVER () AS seg, row, string_split(trim(regexp_replace(s, '[^\\p{{L}}\\p{{N}}]+', ' ', 'g')), ' ') AS w FROM s),
g AS (SELECT seg, row, list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS g FROM n WHERE len(w) > 1),
t AS (SELECT * FROM (VALUES {_TEMPLATES}) AS t(i, name, b)),
c AS (SELECT seg, row, i, name, 2.0::DOUBLE * len(list_intersect(g, b)) / (len(g) + len(b)) AS dice FROM g, t WHERE len(list_intersect(g, b)) > 0),
k AS (SELECT seg, row, i, name, dice FROM c WHERE dice >= 0.8 QUALIFY row_number() OVER (PARTITION BY seg ORDER BY dice DESC, i) = 1),
b AS (SELECT row, name, dice, CAST(count(*) OVER (PARTITION BY row) AS INT) AS n FROM k QUALIFY row_number() OVER (PARTITION BY row ORDER BY dice DESC, i) = 1)
SELECT doc_id, name AS license, dice, coalesce(n, 0) AS n_segments FROM d LEFT JOIN b ON b.row = d.row"""

_UNIT = r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+"
_DRAWS = ", ".join(f"CAST('0x' || substr(h, {8 * k + 1}, 8) AS BIGINT) AS h{k + 1}" for k in range(4))
_OP11 = f"""WITH u AS (SELECT doc_id, coalesce(text, '') AS t, sha256('42:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
v AS (SELECT *, regexp_extract_all(t, {_text(_UNIT)}) AS w, len(w) AS n, {_DRAWS} FROM u),
x AS (SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
  CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 50 THEN 'plain' WHEN h4 % 100 < 80 THEN 'spm' ELSE 'psm' END AS form FROM v),
y AS (SELECT *, array_to_string(w[1:a], '') AS p, array_to_string(w[a + 1:b], '') AS m, array_to_string(w[b + 1:], '') AS s FROM x)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(p) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256,
  sha256(p || m || s) AS restored_sha256 FROM y"""

#: The others decide by learned scores, token ids, checksums, fingerprints or positions of matches, which SQL cannot state.
ORACLE = {"op1_url_filter": _OP1, "op4_neighbours": _OP4, "op7_licenses": _OP7, "op11_fim": _OP11}
