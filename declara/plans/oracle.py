"""DuckDB statements that state, independently of the Spark code, what the queries must return.

The statements work relationally (lines, candidates and results are rows), the Spark operators
row-wise on arrays, so the two share the fixed values and the bridge views but no logic.
"""

from __future__ import annotations

from collections.abc import Iterable

from declara import catalog as c
from declara.plans.bridges import with_views
from declara.plans.queries import AS_OF

ORACLE: dict[str, str] = {}


def add(name: str, sql: str) -> None:
    ORACLE[name] = with_views(sql)


def q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def strip(e: str) -> str:
    return f"trim({e}, ' ' || chr(9) || chr(10) || chr(13))"


def m(e: str, pattern: str, flags: str = "i") -> str:
    return f"regexp_matches({e}, {q(pattern)}, {q(flags)})" if flags else f"regexp_matches({e}, {q(pattern)})"


def x(e: str, pattern: str, group: int = 0, flags: str = "i") -> str:
    tail = f", {q(flags)}" if flags else ""
    return f"nullif(regexp_extract({e}, {q(pattern)}, {group}{tail}), '')"


def words(e: str, options: Iterable[str]) -> str:
    return "(" + " OR ".join(f"contains({e}, {q(w)})" for w in dict.fromkeys(options)) + ")"


def isin(e: str, options: Iterable[str]) -> str:
    return f"{e} IN ({', '.join(q(o) for o in options)})"


def blank(e: str) -> str:
    return f"coalesce({strip(e)} = '', true)"


# ---------------------------------------------------------------------------------------------
# rules
# ---------------------------------------------------------------------------------------------


def res(status: str, detected: str, reason: str, severity: str) -> str:
    return f"{{'s': {q(status)}, 'd': CAST({detected} AS VARCHAR), 'r': {reason}, 'v': {q(severity)}}}"


def case(*branches: tuple[str, str], other: str) -> str:
    return "CASE " + " ".join(f"WHEN {cond} THEN {val}" for cond, val in branches) + f" ELSE {other} END"


def _mrp(r):
    text, num = "mrp_t", "mrp_n"
    problem = (
        "concat_ws('; ', CASE WHEN NOT mrp_cur THEN 'Currency symbol (₹ / Rs.) is missing' END, "
        "CASE WHEN NOT mrp_tax THEN '''inclusive of all taxes'' declaration phrase is missing or truncated in OCR' END)")
    return case(
        ("mrp_t IS NULL", res("FAIL", "NULL", q("Maximum Retail Price (MRP) declaration is missing. Mandatory under Rule 6(1)(e)."), "HIGH")),
        (isin("lower(mrp_t)", c.MRP_PLACEHOLDERS), res("FAIL", text, f"'Invalid MRP value ''' || {text} || '''. Packaged retail commodities must declare a valid positive price.'", "HIGH")),
        ("mrp_n IS NULL", res("FAIL", text, f"'MRP ''' || {text} || ''' could not be parsed into a valid currency denomination format.'", "HIGH")),
        ("mrp_n <= 0", res("FAIL", text, f"'MRP value must be greater than zero. Detected: ' || CAST({num} AS VARCHAR)", "HIGH")),
        ("mrp_cur AND mrp_tax", res("PASS", text, q("Valid MRP declared with currency symbol and 'inclusive of all taxes' per Rule 6(1)(e)."), "HIGH")),
        other=res("WARNING", text, f"'MRP value ₹' || printf('%.2f', {num}) || ' detected, but with format irregularity: ' || {problem} || '. Rule 6(1)(e) requires ''inclusive of all taxes''.'", "MEDIUM"))


def _quantity(r):
    better = "CASE qty_u " + " ".join(f"WHEN {q(k)} THEN {q(v)}" for k, v in c.NON_STANDARD_UNITS.items()) + " END"
    shown = "CAST(qty_n AS VARCHAR)"
    return case(
        ("qty_t IS NULL", res("FAIL", "NULL", q("Net quantity declaration is missing. Mandatory under Rule 6(1)(c)."), "HIGH")),
        ("qty_n IS NULL", res("FAIL", "qty_t", "'Invalid net quantity format ''' || qty_t || '''. Must include numerical value and standard unit.'", "HIGH")),
        ("qty_n <= 0", res("FAIL", "qty_t", f"'Net quantity value must be greater than zero. Found: ' || {shown}", "HIGH")),
        (f"({better}) IS NOT NULL", res("WARNING", "qty_t", f"'Non-standard unit symbol ''' || qty_raw || ''' used. Legal Metrology Rule 13 prescribes standard symbol ''' || ({better}) || ''' (not pluralized or non-metric symbols).'", "MEDIUM")),
        (isin("qty_u", c.STANDARD_UNITS), res("PASS", "qty_t", f"'Valid net quantity declared (' || {shown} || ' ' || qty_raw || ') in standard Legal Metrology units per Rule 6(1)(c) and Rule 13.'", "HIGH")),
        other=res("REQUIRES_HUMAN_VERIFICATION", "qty_t", "'Quantity ''' || qty_t || ''' contains unrecognized or non-standard measurement unit ''' || qty_raw || '''. Verification required against Second/Third Schedule.'", "MEDIUM"))


def _date_cte(name: str, text: str) -> str:
    """Year and format columns of a date text."""
    months = "|".join(c.MONTH_NAMES)
    hits, years, names = [], [], []
    for pattern, fmt, year, month, ignore in c.DATE_FORMATS:
        flags = "i" if ignore else ""
        cond = m(text, pattern, flags)
        if month is not None:
            cond += " AND " + isin(f"lower({x(text, pattern, month, flags)})", c.MONTH_NAMES)
        hits.append(cond)
        years.append(x(text, pattern, year, flags))
        names.append(q(fmt))
    toks = f"regexp_split_to_array(lower({text}), '[\\s/\\-\\.,]+')"
    ytok = f"list_filter({toks}, lambda t: regexp_matches(t, '^(\\d{{4}}|\\d{{2}})$'))[1]"
    natural = f"(len(list_filter({toks}, lambda t: regexp_full_match(t, '{months}'))) > 0 AND {ytok} IS NOT NULL)"
    y = "CASE " + " ".join(f"WHEN {h} THEN {v}" for h, v in zip(hits, years)) + f" WHEN {natural} THEN {ytok} END"
    f = "CASE " + " ".join(f"WHEN {h} THEN {v}" for h, v in zip(hits, names)) + f" WHEN {natural} THEN 'Natural Month Year' END"
    return f"{y} AS {name}_y, {f} AS {name}_f"


def _date(r):
    n = "best" if r["field_name"] == "best_before_date" else "date"
    t, y, f = f"{n}_t", f"{n}_y", f"{n}_f"
    year = f"(CAST({y} AS INTEGER) + CASE WHEN length({y}) = 2 THEN 2000 ELSE 0 END)"
    last = AS_OF.year + 1
    missing = (res("FAIL", "NULL", q("Month and Year of manufacture / packing / import is missing. Mandatory under Rule 6(1)(d)."), "HIGH") if r["mandatory"]
               else res("NOT_APPLICABLE", "NULL", q("Best before / Use by date not declared and not strictly required for this commodity."), "LOW"))
    return case(
        (f"{t} IS NULL", missing),
        (m(t, c.RELATIVE_EXPIRY), res("PASS", t, q("Valid relative expiry duration declared per Rule 6(1)(f) ('Best before X months from manufacture')."), r["severity"])),
        (f"length({t}) < 4", res("REQUIRES_HUMAN_VERIFICATION", t, f"'Ambiguous or partial date declaration ''' || {t} || '''. Requires visual verification of packaging.'", "MEDIUM")),
        (f"{y} IS NULL AND " + m(t, r"\d", ""), res("REQUIRES_HUMAN_VERIFICATION", t, f"'Date string ''' || {t} || ''' contains numbers but does not follow standard Month/Year format (MM/YYYY or Month YYYY). Human verification required.'", "MEDIUM")),
        (f"{y} IS NULL", res("FAIL", t, f"'Unrecognized date declaration format ''' || {t} || '''. Rule 6(1)(d) mandates month and year.'", "HIGH")),
        (f"{year} < 2015 OR {year} > {last}", res("FAIL", t, f"'Declared manufacture/packing year ''' || {y} || ''' is not realistic. Expected year between 2015 and {last}.'", "HIGH")),
        other=res("PASS", t, f"'Valid month/year declaration ''' || {t} || ''' matching format ' || {f} || ' per Rule 6(1)(d).'", r["severity"]))


def _maker(r):
    imp = "IMPORTER" in r["rule_id"]
    label = "Importer" if imp else "Manufacturer / Packer"
    n, a = ("importer_name", "importer_address") if imp else ("maker_n", "maker_a")
    det = (f"concat_ws(' | ', CASE WHEN NOT {blank(n)} THEN 'Name: ' || {strip(n)} END, "
           f"CASE WHEN NOT {blank(a)} THEN 'Address: ' || {strip(a)} END)")
    place = (f"({m(a, c.POSTAL_PIN, '')} OR {words(f'lower({a})', c.ADDRESS_STATES)} OR contains({a}, ',') "
             f"OR len(regexp_extract_all({a}, '\\S+')) >= 3)")
    table = case(
        (f"{blank(n)} AND {blank(a)}", res("FAIL", "NULL", q(f"{label} name and address are completely missing. Mandatory under {r['legal_reference']}."), "HIGH")),
        (blank(a), res("FAIL", det, f"'{label} name is present (''' || {n} || '''), but complete address is missing. Mandatory under Rule 6(1)(a).'", "HIGH")),
        (blank(n), res("FAIL", det, f"'{label} address is present (''' || {a} || '''), but entity name is missing. Mandatory under Rule 6(1)(a).'", "HIGH")),
        (f"length({strip(a)}) < 5", res("REQUIRES_HUMAN_VERIFICATION", det, f"'{label} address ''' || {a} || ''' appears too brief to be a complete postal address. Human verification required.'", "MEDIUM")),
        (place, res("PASS", det, q(f"Valid {label} name and address declared per Rule 6(1)(a) / Rule 6(1)(ab)."), "HIGH")),
        other=res("WARNING", det, q(f"{label} name and address provided, but address details may lack city/state/pin code clarity."), "LOW"))
    if not imp:
        return table
    return case(("NOT is_imported", res("NOT_APPLICABLE", "NULL", q("Product is not marked as imported. Importer declaration is not applicable."), "LOW")), other=table)


def _care(r):
    det = ("coalesce(nullif(consumer_care, ''), 'Phone: ' || coalesce(nullif(consumer_care_phone, ''), 'N/A') || "
           "', Email: ' || coalesce(nullif(consumer_care_email, ''), 'N/A'))")
    chan = ("concat_ws(', ', CASE WHEN care_p THEN 'telephone / toll-free' END, CASE WHEN care_e THEN 'email' END, "
            "CASE WHEN care_a THEN 'contact address' END)")
    return case(
        ("care_t = ''", res("FAIL", "NULL", q("Consumer care contact details (phone/email/address) are completely missing. Mandatory under Rule 6(1)(g) & Rule 6(8)."), "HIGH")),
        ("care_p AND care_e", res("PASS", det, f"'Comprehensive consumer care details provided (' || {chan} || ') satisfying Rule 6(1)(g) & Rule 6(8).'", "HIGH")),
        ("care_p OR care_e OR care_a", res("WARNING", det, f"'Partial consumer care info found (' || {chan} || '). Rule 6(8) recommends multiple channels (name, phone, email, address).'", "MEDIUM")),
        ("length(care_t) >= 5", res("REQUIRES_HUMAN_VERIFICATION", det, "'Consumer care text ''' || care_t || ''' detected, but standard phone or email pattern could not be verified automatically.'", "MEDIUM")),
        other=res("FAIL", "care_t", q("Invalid consumer care declaration. Does not contain recognizable contact number or email."), "HIGH"))


def _origin(r):
    t = strip("country_of_origin")
    return case(
        (f"NOT (is_imported OR is_foreign) AND {blank('country_of_origin')}", res("NOT_APPLICABLE", "NULL", q("Country of origin declaration is specifically mandatory for imported packages under Rule 6(1)(da). Not applicable for domestic goods with complete manufacturer address."), "LOW")),
        (blank("country_of_origin"), res("FAIL", "NULL", q("Product is marked as imported, but Country of Origin is missing. Mandatory under Rule 6(1)(da)."), "HIGH")),
        (f"{words(f'lower({t})', c.KNOWN_COUNTRIES)} OR length({t}) >= 2", res("PASS", t, f"'Country of Origin ''' || {t} || ''' clearly declared per Rule 6(1)(da).'", "HIGH")),
        other=res("REQUIRES_HUMAN_VERIFICATION", t, f"'Country of origin value ''' || {t} || ''' could not be verified automatically. Requires manual verification.'", "MEDIUM"))


def is_code(e: str) -> str:
    s = strip(e)
    d = f"length(regexp_replace({s}, '[^0-9]', '', 'g'))"
    letters = f"length(regexp_replace({s}, '[^\\p{{L}}]', '', 'g'))"
    return f"({d} > 0 AND ({letters} = 0 OR length({s}) < 4 OR {d} >= {letters}))"


def _name(r):
    return case(
        (blank("name_t"), res("FAIL", "NULL", q("Generic or common name of commodity is missing. Mandatory under Rule 6(1)(b)."), "MEDIUM")),
        (is_code("name_t"), res("FAIL", "name_t", "'Detected value ''' || name_t || ''' appears to be a product/batch code, not a common/generic commodity name as required under Rule 6(1)(b).'", "HIGH")),
        ("length(name_t) < 2", res("REQUIRES_HUMAN_VERIFICATION", "name_t", "'Detected product name ''' || name_t || ''' is extremely short and may be an OCR fragment.'", "MEDIUM")),
        other=res("PASS", "name_t", "'Common/generic commodity name ''' || name_t || ''' declared per Rule 6(1)(b).'", "MEDIUM"))


def _usp(r):
    return case(
        ("usp_t IS NULL AND package_type = 'multi_unit'", res("WARNING", "NULL", q("Unit Sale Price is recommended for multi-unit packages under amended Rule 6(1)(e)."), "LOW")),
        ("usp_t IS NULL", res("NOT_APPLICABLE", "NULL", q("Unit Sale Price not declared (conditional on package category / volume)."), "LOW")),
        (m("usp_t", c.UNIT_PRICE), res("PASS", "usp_t", "'Valid Unit Sale Price ''' || usp_t || ''' declared in standard per-unit format.'", "LOW")),
        other=res("WARNING", "usp_t", "'Unit Sale Price ''' || usp_t || ''' does not strictly follow ''₹ X.XX / unit'' standard notation.'", "LOW"))


_TABLES = {
    "MRP_VALIDATION": _mrp, "QUANTITY_VALIDATION": _quantity, "DATE_VALIDATION": _date, "BEST_BEFORE_VALIDATION": _date,
    "MANUFACTURER_VALIDATION": _maker, "IMPORTER_VALIDATION": _maker, "CONSUMER_CARE_VALIDATION": _care,
    "ORIGIN_VALIDATION": _origin, "COMMODITY_NAME_VALIDATION": _name, "UNIT_SALE_PRICE_VALIDATION": _usp,
}
_APPLIES = {
    "LMPC_RULE_6_1_DA_ORIGIN": "is_imported OR is_foreign",
    "LMPC_RULE_6_1_DA_IMPORTER": "is_imported OR is_foreign",
    "LMPC_RULE_6_1_F": "coalesce(lower(category) IN ('food', 'perishable', 'cosmetics', 'pharmaceutical'), false) OR best_before_date IS NOT NULL",
    "LMPC_RULE_6_1_E_USP": "unit_sale_price IS NOT NULL OR coalesce(package_type = 'multi_unit', false)",
}


def rule_ctes(source: str, key: str) -> str:
    """CTEs ``parsed`` and ``checked`` (key, n, rule columns, status ...) over a product relation."""
    full = m("qty_t", c.QUANTITY_FULL)
    texts = f"""texts AS (SELECT s.*,
  CASE WHEN NOT {blank('mrp')} THEN {strip('mrp')} END AS mrp_t,
  CASE WHEN NOT {blank('net_quantity')} THEN {strip('net_quantity')} END AS qty_t,
  CASE WHEN NOT {blank('date_declaration')} THEN {strip('date_declaration')} END AS date_t,
  CASE WHEN NOT {blank('best_before_date')} THEN {strip('best_before_date')} END AS best_t,
  CASE WHEN NOT {blank('unit_sale_price')} THEN {strip('unit_sale_price')} END AS usp_t,
  coalesce(nullif(manufacturer_name, ''), packer_name) AS maker_n,
  coalesce(nullif(manufacturer_address, ''), packer_address) AS maker_a,
  {strip("concat_ws(' ', nullif(consumer_care_phone, ''), nullif(consumer_care_email, ''), nullif(consumer_care_address, ''), nullif(consumer_care, ''))")} AS care_t,
  coalesce(country_of_origin <> '' AND NOT {isin(f"lower({strip('country_of_origin')})", c.HOME_COUNTRY_NAMES)}, false) AS is_foreign,
  {strip("coalesce(nullif(generic_name, ''), product_name)")} AS name_t
  FROM {source} s)"""
    parsed = f"""parsed AS (SELECT t.*,
  CAST(replace({x('mrp_t', c.MRP_NUMBER, 1)}, ',', '') AS DOUBLE) AS mrp_n,
  {m('mrp_t', c.MRP_CURRENCY)} AS mrp_cur, {m('mrp_t', c.MRP_TAX_PHRASE)} AS mrp_tax,
  CAST(CASE WHEN {full} THEN {x('qty_t', c.QUANTITY_FULL, 1)} ELSE {x('qty_t', c.QUANTITY_FALLBACK, 1, '')} END AS DOUBLE) AS qty_n,
  lower({strip(f"CASE WHEN {full} THEN {x('qty_t', c.QUANTITY_FULL, 2)} ELSE {x('qty_t', c.QUANTITY_FALLBACK, 2, '')} END")}) AS qty_raw,
  regexp_replace(qty_raw, '\\.+$', '') AS qty_u,
  {_date_cte('date', 'date_t')}, {_date_cte('best', 'best_t')},
  {m('care_t', c.CARE_EMAIL, '')} AS care_e, {m('care_t', c.CARE_PHONE, '')} AS care_p,
  coalesce(length({strip('consumer_care_address')}) > 3, false) AS care_a
  FROM texts t)"""
    na = res("NOT_APPLICABLE", "NULL", q("Rule is not applicable to this commodity category or configuration."), "{sev}")
    parts = []
    for n, r in enumerate(c.RULES):
        outcome = _TABLES[r["validation_type"]](r)
        cond = _APPLIES.get(r["rule_id"])
        if cond:
            outcome = case((cond, outcome), other=na.replace("{sev}", r["severity"]))
        parts.append(
            f"SELECT {key}, {n} AS n, {q(r['rule_id'])} AS rule_id, {q(r['declaration_name'])} AS declaration, "
            f"{q(r['legal_reference'])} AS legal_reference, {outcome} AS o FROM parsed")
    checked = "checked AS (SELECT " + f"{key}, n, rule_id, declaration, legal_reference, o.s AS status, o.d AS detected_value, o.r AS reason, o.v AS severity FROM (\n" + "\nUNION ALL\n".join(parts) + "))"
    return f"{texts},\n{parsed},\n{checked}"


WEIGHT = "CASE severity WHEN 'HIGH' THEN 3 WHEN 'LOW' THEN 1 ELSE 2 END"
CREDIT = "CASE status WHEN 'PASS' THEN 10 WHEN 'WARNING' THEN 6 WHEN 'REQUIRES_HUMAN_VERIFICATION' THEN 5 ELSE 0 END"


def score_cte(key: str, source: str = "checked") -> str:
    return f"""scored AS (SELECT {key},
  CAST(count(*) AS INTEGER) AS total_checks,
  CAST(sum(CASE WHEN status = 'PASS' THEN 1 ELSE 0 END) AS INTEGER) AS passed,
  CAST(sum(CASE WHEN status = 'FAIL' THEN 1 ELSE 0 END) AS INTEGER) AS failed,
  CAST(sum(CASE WHEN status = 'WARNING' THEN 1 ELSE 0 END) AS INTEGER) AS warnings,
  CAST(sum(CASE WHEN status = 'REQUIRES_HUMAN_VERIFICATION' THEN 1 ELSE 0 END) AS INTEGER) AS human_verification_required,
  CAST(sum(CASE WHEN status = 'NOT_APPLICABLE' THEN 1 ELSE 0 END) AS INTEGER) AS not_applicable,
  sum(CASE WHEN status = 'NOT_APPLICABLE' THEN 0 ELSE {WEIGHT} END) AS w,
  sum(CASE WHEN status = 'NOT_APPLICABLE' THEN 0 ELSE {WEIGHT} * {CREDIT} END) AS e,
  CASE WHEN w > 0 THEN round(CAST(e * 10 AS DOUBLE) / w, 1) ELSE 100.0 END AS compliance_score,
  CASE WHEN failed > 0 THEN 'NON_COMPLIANT' WHEN human_verification_required > 0 THEN 'PARTIAL_COMPLIANCE_NEEDS_REVIEW'
    WHEN warnings > 0 THEN 'POTENTIALLY_NON_COMPLIANT' ELSE 'COMPLIANT' END AS overall_status
  FROM {source} GROUP BY {key})"""


def _none(*names: str) -> str:
    return "CAST(" + " AND ".join(blank(n) for n in names) + " AS INTEGER)"


MISSING = " + ".join([
    _none("mrp"), _none("manufacturer_name", "manufacturer_address", "packer_name", "importer_name"),
    _none("consumer_care", "consumer_care_email", "consumer_care_phone", "consumer_care_address")])
GUIDE = f"CASE WHEN {MISSING} >= 2 THEN {q(c.GUIDANCE_NOTE)} END"

add("q_rule_results", f"""WITH {rule_ctes('product_input', 'product_id')}
SELECT product_id, rule_id, declaration, status, detected_value, reason, legal_reference, severity FROM checked""")

add("q_compliance_score", f"""WITH {rule_ctes('product_input', 'product_id')}, {score_cte('product_id')}
SELECT s.product_id, overall_status, compliance_score, total_checks, passed, failed, warnings, human_verification_required,
  not_applicable, failed + warnings AS violations, {GUIDE} AS guidance_note,
  {q(c.DEFAULT_SUMMARY)} || coalesce(chr(10) || chr(10) || '[INSPECTOR GUIDANCE] ' || guidance_note, '') AS summary
FROM scored s JOIN product_input p ON p.product_id = s.product_id""")

add("q_score_from_rows", f"""WITH {rule_ctes('product_input', 'product_id')}, {score_cte('product_id')}
SELECT product_id, total_checks, passed, failed, warnings, human_verification_required, not_applicable, compliance_score,
  overall_status FROM scored""")

add("q_ecommerce_rescore", f"""WITH {rule_ctes('product_input', 'product_id')}, {score_cte('product_id')}
SELECT product_id, CASE WHEN product_id % 3 = 0 THEN 'ecommerce_listing' ELSE 'physical_package' END AS input_type,
  CASE WHEN product_id % 3 <> 0 THEN overall_status WHEN failed = 0 THEN 'COMPLIANT' ELSE 'NON_COMPLIANT' END AS overall_status,
  CASE WHEN product_id % 3 <> 0 THEN compliance_score WHEN passed + failed + warnings = 0 THEN 100.0
    ELSE round(CAST(passed * 100 AS DOUBLE) / (passed + failed + warnings), 1) END AS compliance_score,
  passed, failed, warnings, not_applicable, failed + warnings AS violations FROM scored""")

add("q_guidance_from_results", f"""
SELECT s.id AS scan_id, CASE WHEN 3 - count(DISTINCT r.rule_id) >= 2 THEN {q(c.GUIDANCE_NOTE)} END AS guidance_note
FROM scan_records s LEFT JOIN rule_results r ON r.scan_id = s.id AND r.status = 'PASS'
  AND r.rule_id IN ('LMPC_RULE_6_1_E', 'LMPC_RULE_6_1_A', 'LMPC_RULE_6_1_G') GROUP BY s.id""")

# ---------------------------------------------------------------------------------------------
# extraction: lines and candidates as rows
# ---------------------------------------------------------------------------------------------


def lines_cte(source: str = "label_text", key: str = "product_id") -> str:
    return f"""parts AS (SELECT {key}, raw_text, list_filter(list_transform(string_split(raw_text, chr(10)), lambda l: {strip('l')}), lambda l: l <> '') AS ls FROM {source}),
lines AS (SELECT {key}, i, ls[i] AS ln FROM parts, unnest(range(1, len(ls) + 1)) AS u(i))"""


def cands(name: str, patterns: list[str], key: str, columns: str, where: str, raw: str, flags: str = "i") -> str:
    """First accepted candidate per key over (line, pattern)."""
    union = " UNION ALL ".join(
        f"SELECT {key}, i, ln, {k} AS k, {raw.replace('{m}', f'regexp_extract(ln, {q(p)}, 0, {q(flags)})').replace('{g1}', f'regexp_extract(ln, {q(p)}, 1, {q(flags)})')} AS raw "
        f"FROM lines WHERE {m('ln', p, flags)}" for k, p in enumerate(patterns))
    return (f"{name}_c AS ({union}),\n{name}_v AS (SELECT *, {columns} FROM {name}_c),\n"
            f"{name} AS (SELECT * FROM {name}_v WHERE {where} QUALIFY row_number() OVER (PARTITION BY {key} ORDER BY i, k) = 1)")


def date_norm(e: str) -> str:
    bare = f"regexp_replace({strip(f'regexp_replace({strip(e)}, {q(c.DATE_PREFIX)}, {q(chr(0)[:0])}, {q(chr(105))})')}, '[\\-\\/\\.\\s]+', '-', 'g')"
    num, word = r"^(0?[1-9]|1[0-2])-(20\d{2}|\d{2})$", r"^([a-zA-Z]+)-(20\d{2}|\d{2})$"
    months = "CASE lower(" + x(bare, word, 1, "") + ") " + " ".join(
        f"WHEN {q(n)} THEN '{i:02d}' WHEN {q(n[:3])} THEN '{i:02d}'" for i, n in enumerate(c.MONTHS, 1)) + " END"

    def year(p):
        y = x(bare, p, 2, "")
        return f"(CASE WHEN length({y}) = 2 THEN '20' || {y} ELSE {y} END)"

    return (f"coalesce(lpad({x(bare, num, 1, '')}, 2, '0') || '/' || {year(num)}, {months} || '/' || {year(word)}, {bare})")


def title_case(e: str) -> str:
    return f"array_to_string(list_transform(string_split(lower({e}), ' '), lambda w: upper(w[1:1]) || w[2:]), ' ')"


QTY = c.QUANTITY_PARTS.replace("²³", "²³")


def extract_ctes(answers: str | None = None) -> str:
    key = "product_id"
    amount = "CAST(replace(num, ',', '') AS DOUBLE)"
    price = cands(
        "price", c.MRP_PATTERNS, key,
        f"CASE WHEN contains(lower(ln), 'incl') THEN ln ELSE raw END AS target, {x('target', c.MRP_AMOUNT, 1, '')} AS num, {amount} AS amount, "
        f"'₹' || CASE WHEN contains(num, '.') THEN printf('%.2f', amount) ELSE CAST(CAST(amount AS BIGINT) AS VARCHAR) END "
        f"|| CASE WHEN contains(lower(target), 'incl') THEN ' incl. of all taxes' ELSE '' END AS value",
        "amount > 0", strip(f"regexp_replace({strip('{m}')}, '[a-zA-Z]+$', '')"))
    qty = cands(
        "qty", c.QUANTITY_PATTERNS, key,
        f"CAST({x('raw', QTY, 1, '')} AS DOUBLE) AS amount, printf('%g', amount) || ' ' || {x('raw', QTY, 2, '')} AS value",
        f"length(raw) <= 12 AND NOT {m('raw', '^(?:1800|19[0-9]{2}|20[0-9]{2})', '')} AND amount > 0", strip("{m}"))
    usp = cands("usp", c.USP_PATTERNS, key, "raw AS value", "true", strip("{m}"))
    best = cands("best", c.BEST_BEFORE_PATTERNS, key, f"{date_norm('raw')} AS value", "true", strip("{m}"))
    made = cands("made", c.DATE_PATTERNS, key, f"{date_norm('raw')} AS value",
                 f"NOT {words('lower(ln)', c.ENTITY_KEYWORDS)} OR {words('lower(raw)', c.DATE_MATCH_WORDS)}", strip("{m}"))
    bare = f"regexp_replace({strip(f'regexp_replace(raw, {q(c.ORIGIN_PREFIX)}, {q(str())}, {q(chr(105))})')}, '[.,;:\\- ]+$', '')"
    origin = cands("orig", c.ORIGIN_PATTERNS, key,
                   f"CASE WHEN length({bare}) > 2 THEN {title_case(bare)} ELSE upper({bare}) END AS value", "true", strip("{g1}"))
    bad = c.ENTITY_KEYWORDS + c.CARE_KEYWORDS + c.PRICE_AND_META_WORDS
    names = f"""name_c AS (SELECT product_id, i, ln, {is_code('ln')} AS code FROM lines WHERE i <= 6 AND length(ln) > 2 AND NOT ends_with(ln, ':')
  AND NOT {words('lower(ln)', bad)}),
pname AS (SELECT product_id, ln AS value FROM name_c QUALIFY row_number() OVER (PARTITION BY product_id
  ORDER BY code, CASE WHEN code THEN 0 ELSE -length(ln) END, i) = 1)"""
    entities = ",\n".join(entity_ctes(k, kw) for k, kw in (
        ("manufacturer", c.MAKER_KEYWORDS), ("packer", c.PACKER_KEYWORDS), ("importer", c.IMPORTER_KEYWORDS)))
    phone = c.PHONE_PATTERN.replace("(?:(?!890)[6-9])[0-9]{9}", "(?:[679][0-9]{9}|8[0-8][0-9]{8}|89[1-9][0-9]{7})")
    all_text = "array_to_string(ls, ' ' || chr(10) || ' ')"
    care = f"""contact AS (SELECT product_id, {x(all_text, c.EMAIL_PATTERN, 0, '')} AS email, {strip(x(all_text, phone, 0, ''))} AS phone FROM parts),
care_1 AS (SELECT product_id, min(i) AS i FROM lines WHERE {words('lower(ln)', c.CARE_KEYWORDS)} GROUP BY product_id),
care_b AS (SELECT a.product_id, string_agg(l.ln, ' ' ORDER BY l.i) AS value, min_by(l.ln, l.i) AS source FROM care_1 a JOIN lines l ON l.product_id = a.product_id
  AND l.i BETWEEN a.i AND a.i + 2 AND NOT EXISTS (SELECT 1 FROM lines z WHERE z.product_id = a.product_id AND z.i > a.i AND z.i <= l.i
    AND {words('lower(z.ln)', c.CARE_STOP_WORDS)}) GROUP BY a.product_id)"""
    ans = answers or "SELECT CAST(NULL AS BIGINT) AS product_id, CAST(NULL AS VARCHAR) AS field, CAST(NULL AS VARCHAR) AS value WHERE false"
    raw_low = "lower(raw_text)"
    cat = "CASE " + " ".join(f"WHEN {words(raw_low, w)} THEN {q(n)}" for n, w in c.CATEGORY_WORDS) + " ELSE 'general' END"
    joined = f"""given AS (SELECT product_id, field, max({strip('value')}) AS value FROM ({ans}) g GROUP BY 1, 2),
base AS (SELECT p.product_id, p.raw_text,
  coalesce(ga.value, price.value) AS mrp, coalesce(ga.value, price.raw) AS mrp_raw, CASE WHEN ga.value IS NOT NULL THEN 0.95 WHEN price.value IS NOT NULL THEN 0.85 ELSE 0 END AS mrp_conf,
  qty.value AS qty0, usp.value AS unit_sale_price, made.value AS date_declaration, best.value AS best_before,
  orig.value AS origin0, orig.raw AS origin_raw, pname.value AS product_name,
  manufacturer.name AS manufacturer_name, manufacturer.address AS maker_addr0, manufacturer.raw AS manufacturer_raw,
  packer.name AS packer_name, packer.address AS packer_address,
  qty.raw AS qty_raw0, made.raw AS made_raw, best.raw AS best_raw, packer.raw AS packer_raw, importer.raw AS importer_raw,
  coalesce(gi.value, importer.name) AS importer_name, importer.address AS importer_address, importer.name IS NOT NULL AS importer_found,
  contact.email AS consumer_care_email, contact.phone AS phone0,
  coalesce(care_b.value, nullif(concat_ws(' | ', contact.phone, contact.email), '')) AS consumer_care,
  coalesce(care_b.source, nullif(concat_ws(' | ', contact.phone, contact.email), '')) AS care_source,
  {cat} AS category,
  {strip(x('raw_text', c.TRUE_QUANTITY, 1))} AS true_qty,
  lower({strip("coalesce(origin0, '')")}) AS origin_key
  FROM parts p LEFT JOIN price USING (product_id) LEFT JOIN qty USING (product_id) LEFT JOIN usp USING (product_id)
  LEFT JOIN made USING (product_id) LEFT JOIN best USING (product_id) LEFT JOIN orig USING (product_id) LEFT JOIN pname USING (product_id)
  LEFT JOIN manufacturer USING (product_id) LEFT JOIN packer USING (product_id) LEFT JOIN importer USING (product_id)
  LEFT JOIN contact USING (product_id) LEFT JOIN care_b USING (product_id)
  LEFT JOIN given ga ON ga.product_id = p.product_id AND ga.field = 'mrp' LEFT JOIN given gi ON gi.product_id = p.product_id AND gi.field = 'importer_name'),
fixed AS (SELECT *,
  CASE WHEN {isin('origin_key', c.INDIAN_PLACES)} THEN 'place' WHEN {m('raw_text', c.HOME_ORIGIN_PHRASE)} THEN 'phrase'
    WHEN ({m('raw_text', c.ADDRESS_PIN, '')} OR {words(raw_low, c.ADDRESS_HINT_PLACES)}) AND (origin0 IS NULL OR NOT {isin('origin_key', c.VALID_COUNTRIES)}) THEN 'address' END AS fix,
  {m("lower(trim(coalesce(qty0, '')))", '^[.]?0[.][0-9]+ *m$', '')} OR {words("lower(coalesce(qty0, ''))", ['per', '/', 'usp'])} AS artefact
  FROM base),
extracted AS (SELECT * EXCLUDE (fix),
  CASE WHEN fix IS NOT NULL THEN 'India' ELSE origin0 END AS country_of_origin,
  CASE fix WHEN 'place' THEN 0.95 WHEN 'phrase' THEN 0.98 WHEN 'address' THEN 0.9 ELSE CASE WHEN origin0 IS NULL THEN 0 ELSE 0.85 END END AS origin_conf,
  CASE WHEN fix = 'place' AND nullif(maker_addr0, '') IS NULL THEN origin0 ELSE maker_addr0 END AS manufacturer_address,
  fix = 'place' AND nullif(maker_addr0, '') IS NULL AS addr_moved, coalesce(fix, '') AS origin_fix,
  fix IS NULL AND ((origin0 IS NOT NULL AND NOT {isin('lower(origin0)', c.HOME_COUNTRY_NAMES)}) OR importer_found) AS is_imported,
  CASE WHEN (artefact OR qty0 IS NULL) AND true_qty IS NOT NULL THEN printf('%g', CAST({x('true_qty', QTY, 1, '')} AS DOUBLE)) || ' ' || {x('true_qty', QTY, 2, '')}
    WHEN artefact AND (contains(raw_text, '0.1') OR contains(raw_text, '100')) THEN '0.1 kg (100 g)' ELSE qty0 END AS net_quantity,
  CASE WHEN (artefact OR qty0 IS NULL) AND true_qty IS NOT NULL THEN 0.95 WHEN artefact AND (contains(raw_text, '0.1') OR contains(raw_text, '100')) THEN 0.92
    WHEN qty0 IS NOT NULL THEN 0.85 ELSE 0 END AS qty_conf,
  CASE WHEN starts_with(phone0, '890') AND length(regexp_replace(phone0, '[^0-9]', '', 'g')) >= 10 THEN NULL ELSE phone0 END AS consumer_care_phone
  FROM fixed)"""
    return ",\n".join([lines_cte(), price, qty, usp, best, made, origin, names, entities, care, joined])


def entity_ctes(name: str, keywords: list[str]) -> str:
    kws = " UNION ALL ".join(f"SELECT {k} AS k, {q(w)} AS kw" for k, w in enumerate(keywords))
    return f"""{name}_k AS ({kws}),
{name}_h AS (SELECT l.product_id, l.i, l.ln, k, kw, {strip("regexp_replace(l.ln, '^.*' || kw || '[:\\-\\s]*', '', 'i')")} AS rest
  FROM lines l JOIN {name}_k ON contains(lower(l.ln), kw)),
{name}_n AS (SELECT h.product_id, h.i, string_agg(l.ln, ', ' ORDER BY l.i) AS more FROM (SELECT DISTINCT product_id, i FROM {name}_h) h
  JOIN lines l ON l.product_id = h.product_id AND l.i BETWEEN h.i + 1 AND h.i + 3
  AND NOT EXISTS (SELECT 1 FROM lines z WHERE z.product_id = h.product_id AND z.i > h.i AND z.i <= l.i AND {words('lower(z.ln)', c.ENTITY_STOP_WORDS)})
  GROUP BY 1, 2),
{name}_t AS (SELECT h.product_id, h.i, h.k, concat_ws(', ', nullif(h.rest, ''), n.more) AS raw FROM {name}_h h LEFT JOIN {name}_n n ON n.product_id = h.product_id AND n.i = h.i),
{name} AS (SELECT product_id, raw, list_filter(list_transform(string_split(raw, ','), lambda s: {strip('s')}), lambda s: s <> '') AS ps,
  coalesce(ps[1], raw) AS name, CASE WHEN len(ps) > 1 THEN array_to_string(ps[2:], ', ') ELSE raw END AS address
  FROM {name}_t WHERE raw <> '' QUALIFY row_number() OVER (PARTITION BY product_id ORDER BY i, k) = 1)"""


EXTRACT = extract_ctes()
add("q_extract_fields", f"""WITH {EXTRACT}
SELECT product_id, mrp, net_quantity, unit_sale_price, date_declaration, best_before, country_of_origin, product_name, mrp_raw,
  CAST(qty_conf AS DOUBLE) AS quantity_confidence, CAST(origin_conf AS DOUBLE) AS origin_confidence, is_imported, category FROM extracted""")
add("q_entity_blocks", f"""WITH {EXTRACT}
SELECT product_id, manufacturer_name, manufacturer_address, packer_name, packer_address, importer_name, importer_address, manufacturer_raw FROM extracted""")
add("q_consumer_care", f"""WITH {EXTRACT}
SELECT product_id, consumer_care, consumer_care_email, consumer_care_phone, care_source FROM extracted""")
PRODUCTS_OF_LABELS = """products AS (SELECT product_id, product_name, product_name AS generic_name, manufacturer_name, manufacturer_address, packer_name, packer_address,
  importer_name, importer_address, net_quantity, mrp, unit_sale_price, date_declaration, best_before AS best_before_date, consumer_care,
  consumer_care_email, consumer_care_phone, CAST(NULL AS VARCHAR) AS consumer_care_address, country_of_origin, is_imported, category,
  'single_unit' AS package_type FROM extracted)"""
add("q_extract_to_score", f"""WITH {EXTRACT}, {PRODUCTS_OF_LABELS}, {rule_ctes('products', 'product_id')}, {score_cte('product_id')}
SELECT s.product_id, overall_status, compliance_score, passed, failed, warnings, human_verification_required, not_applicable, {GUIDE} AS guidance_note
FROM scored s JOIN products p ON p.product_id = s.product_id""")
add("q_override_merge", "WITH " + extract_ctes(
    "SELECT p_partkey AS product_id, 'mrp' AS field, '₹' || CAST(p_size AS VARCHAR) AS value FROM part WHERE p_partkey % 3 = 0 "
    "UNION ALL SELECT p_partkey, 'importer_name', p_brand FROM part WHERE p_partkey % 5 = 0") + """
SELECT product_id, mrp, CAST(mrp_conf AS DOUBLE) AS mrp_confidence, importer_name, importer_name IS NOT NULL AS importer_detected, net_quantity FROM extracted""")


_ROWS = [
    # (field, value, raw value, confidence)
    ("product_name", "product_name", "product_name", "0.85"), ("commodity_name", "product_name", "product_name", "0.85"),
    ("manufacturer_name", "manufacturer_name", "manufacturer_raw", "0.85"),
    ("manufacturer_address", "manufacturer_address", "CASE WHEN addr_moved THEN origin_raw ELSE manufacturer_raw END", "0.85"),
    ("packer_name", "packer_name", "packer_raw", "0.85"), ("packer_address", "packer_address", "packer_raw", "0.85"),
    ("importer_name", "importer_name", "importer_raw", "0.85"), ("importer_address", "importer_address", "importer_raw", "0.85"),
    ("net_quantity", "net_quantity", "CASE WHEN qty_conf = 0.95 THEN true_qty WHEN qty_conf = 0.92 THEN '0.1 kg' ELSE qty_raw0 END", "qty_conf"),
    ("mrp", "mrp", "mrp_raw", "mrp_conf"), ("unit_sale_price", "unit_sale_price", "unit_sale_price", "0.85"),
    ("date_declaration", "date_declaration", "made_raw", "0.85"), ("best_before", "best_before", "best_raw", "0.85"),
    ("consumer_care", "consumer_care", "consumer_care", "0.85"), ("consumer_care_email", "consumer_care_email", "consumer_care_email", "0.85"),
    ("consumer_care_phone", "consumer_care_phone", "consumer_care_phone", "0.85"),
    ("country_of_origin", "country_of_origin", "CASE origin_fix WHEN '' THEN origin_raw WHEN 'place' THEN coalesce(nullif(origin_raw, ''), 'India') ELSE 'India' END", "origin_conf"),
]
add("q_field_rows", f"WITH {EXTRACT}\n" + "\nUNION ALL ".join(
    f"SELECT product_id, {q(n)} AS field_name, {v} AS value, {r} AS raw_value, CAST({k} AS DOUBLE) AS confidence FROM extracted WHERE {v} IS NOT NULL"
    for n, v, r, k in _ROWS))

_INSIGHT = {
    "mrp": "mrp", "manufacturer_name": "coalesce(nullif(trim(manufacturer_name), ''), nullif(trim(manufacturer_address), ''), nullif(trim(packer_name), ''), nullif(trim(importer_name), ''))",
    "commodity_name": "product_name", "net_quantity": "net_quantity", "date_declaration": "date_declaration",
    "consumer_care": "coalesce(nullif(trim(consumer_care), ''), nullif(trim(consumer_care_email), ''), nullif(trim(consumer_care_phone), ''))",
    "country_of_origin": "country_of_origin", "unit_sale_price": "unit_sale_price",
}
_found = {k: f"nullif(trim({v}), '')" for k, v in _INSIGHT.items()}
add("q_extraction_insight", f"""WITH {EXTRACT}
SELECT product_id, concat_ws(',', {', '.join(f"CASE WHEN {e} IS NOT NULL THEN {q(k)} END" for k, e in _found.items())}) AS found,
  concat_ws(',', {', '.join(f"CASE WHEN {e} IS NULL THEN {q(k)} END" for k, e in _found.items())}) AS missing,
  concat_ws('|', {', '.join(_found.values())}) AS found_values,
  'Extracted ' || CAST({' + '.join(f"CAST({e} IS NOT NULL AS INTEGER)" for e in _found.values())} AS VARCHAR) || ' of 8 statutory declarations across 1 package image.' AS coverage_note
FROM extracted""")


def _units(e: str) -> str:
    for pattern, repl in c.UNIT_REPAIRS:
        e = f"regexp_replace({e}, {q(pattern)}, {q(repl.replace('$1', chr(92) + '1'))}, 'gi')"
    return e


add("q_unit_standard", f"SELECT product_id, {_units('raw_text')} AS standard_text FROM label_text")
