"""Rule catalogue, word lists, patterns and lookup tables.

Everything in this module is data.  The values decide which labels pass, so they are stated
plainly and in one place; the code that uses them lives in ``functions`` and ``operators``.
"""

from __future__ import annotations

# --------------------------------------------------------------------------------------------
# The ten statutory declaration rules
# --------------------------------------------------------------------------------------------

PCR = "Legal Metrology (Packaged Commodities) Rules, 2011"

RULE_COLUMNS = [
    "rule_id", "declaration_name", "field_name", "mandatory", "conditional",
    "applicability_condition", "validation_type", "description", "legal_reference", "severity",
    "official_legal_reference", "source_pdf", "english_text", "hindi_text_snippet",
    "last_amended_date", "applicability_notes",
]

RULES = [
    {
        "rule_id": "LMPC_RULE_6_1_A",
        "declaration_name": "Name and Address of Manufacturer / Packer",
        "field_name": "manufacturer_info",
        "mandatory": True,
        "conditional": False,
        "applicability_condition": None,
        "validation_type": "MANUFACTURER_VALIDATION",
        "description": "Every package shall bear the name and complete address of the manufacturer, or where the manufacturer is not the packer, the name and address of the manufacturer and packer.",
        "legal_reference": f"Rule 6(1)(a) read with Rule 6(1)(ab), {PCR}",
        "severity": "HIGH",
        "official_legal_reference": f"Rule 6(1)(a) read with Rule 6(1)(ab), {PCR} (as amended 2022/2023)",
        "source_pdf": "8(i)_0_1732860957.pdf",
        "english_text": "Every package shall bear the name and complete address of the manufacturer, or where the manufacturer is not the packer, the name and address of the manufacturer and packer.",
        "hindi_text_snippet": "प्रत्येक पैकेज पर निर्माता या पैकर का पूरा नाम और पता लिखा होना अनिवार्य है।",
        "last_amended_date": "2023.10.06",
        "applicability_notes": "Applicable to all pre-packaged commodities across food, cosmetics, garments, electronics, medical devices, and general merchandise.",
    },
    {
        "rule_id": "LMPC_RULE_6_1_B",
        "declaration_name": "Generic or Common Name of Commodity",
        "field_name": "product_name",
        "mandatory": True,
        "conditional": False,
        "applicability_condition": None,
        "validation_type": "COMMODITY_NAME_VALIDATION",
        "description": "Every package shall bear the common or generic names of the commodity contained in the package.",
        "legal_reference": f"Rule 6(1)(b), {PCR}",
        "severity": "MEDIUM",
        "official_legal_reference": f"Rule 6(1)(b), {PCR}",
        "source_pdf": "8(i)_0_1732860957.pdf",
        "english_text": "Every package shall bear the common or generic names of the commodity contained in the package.",
        "hindi_text_snippet": "प्रत्येक पैकेज पर उसमें निहित वस्तु का सामान्य या जेनेरिक नाम लिखा होना चाहिए।",
        "last_amended_date": "2021.11.02",
        "applicability_notes": "Mandatory for all packaged goods to prevent misleading or ambiguous product labeling.",
    },
    {
        "rule_id": "LMPC_RULE_6_1_C",
        "declaration_name": "Net Quantity Declaration",
        "field_name": "net_quantity",
        "mandatory": True,
        "conditional": False,
        "applicability_condition": None,
        "validation_type": "QUANTITY_VALIDATION",
        "description": "Every package shall bear the net quantity, in terms of the standard unit of weight or measure, of the commodity contained in the package or where the commodity is packed or sold by number, the number of the commodity contained in the package.",
        "legal_reference": f"Rule 6(1)(c) read with Rule 11, 12, 13 and Second Schedule, {PCR}",
        "severity": "HIGH",
        "official_legal_reference": f"Rule 6(1)(c) read with Rules 11, 12, 13 and Second Schedule, {PCR}",
        "source_pdf": "2023.12.29 Standard Operating Procedure for Edible oil & Fats Net Quantity Measurement signed copy_1732872010.pdf",
        "english_text": "Every package shall bear the net quantity, in terms of standard unit of weight or measure or number. For liquid commodities like edible oils and fats, net quantity by weight or volume shall adhere to SOP guidelines.",
        "hindi_text_snippet": "प्रत्येक पैकेज पर शुद्ध मात्रा (भार या माप की मानक इकाई या संख्या में) अंकित होनी चाहिए।",
        "last_amended_date": "2023.12.29",
        "applicability_notes": "Mandatory for all commodities. Specific SOPs apply for edible oils, fats, liquid produce, and farm produce up to 50 kg.",
    },
    {
        "rule_id": "LMPC_RULE_6_1_D",
        "declaration_name": "Month and Year of Manufacture / Pre-packing",
        "field_name": "date_declaration",
        "mandatory": True,
        "conditional": False,
        "applicability_condition": None,
        "validation_type": "DATE_VALIDATION",
        "description": "Every package shall bear the month and the year in which the commodity is manufactured or pre-packed or imported.",
        "legal_reference": f"Rule 6(1)(d), {PCR}",
        "severity": "HIGH",
        "official_legal_reference": f"Rule 6(1)(d), {PCR} (as amended by G.S.R. 784(E))",
        "source_pdf": "2023.01.27 amendment in amendment of 2023 PCR_1732871665.pdf",
        "english_text": "Every package shall bear the month and year in which the commodity is manufactured or pre-packed or imported.",
        "hindi_text_snippet": "प्रत्येक पैकेज पर निर्माण या प्री-पैकिंग या आयात का माह और वर्ष स्पष्ट रूप से लिखा होना आवश्यक है।",
        "last_amended_date": "2023.01.27",
        "applicability_notes": "Mandatory across all sectors. Extension exemptions granted for specific inventory transitions under 2023 amendments.",
    },
    {
        "rule_id": "LMPC_RULE_6_1_DA_ORIGIN",
        "declaration_name": "Country of Origin for Imported Products",
        "field_name": "country_of_origin",
        "mandatory": False,
        "conditional": True,
        "applicability_condition": "is_imported == true or country_of_origin is not null",
        "validation_type": "ORIGIN_VALIDATION",
        "description": "For imported packages, the name of the country of origin or manufacture or assembly where the product is manufactured or assembled shall be mentioned on the package.",
        "legal_reference": f"Rule 6(1)(da), {PCR}",
        "severity": "HIGH",
        "official_legal_reference": f"Rule 6(1)(da), {PCR} & DoCA E-Commerce COO Guidelines",
        "source_pdf": "2026.02.13 PCR 1st COO Filter on e-commerce websites_1771231030.pdf",
        "english_text": "For imported packages and products listed on e-commerce platforms, the name of the country of origin or manufacture or assembly shall be explicitly mentioned.",
        "hindi_text_snippet": "आयातित वस्तुओं और ई-कॉमर्स वेबसाइटों पर सूचीबद्ध उत्पादों के लिए मूल देश (Country of Origin) का नाम दर्शाना अनिवार्य है।",
        "last_amended_date": "2026.02.13",
        "applicability_notes": "Crucial for imported goods and digital/e-commerce marketplaces. Mandatory 1st & 2nd COO filters required on e-commerce product display pages.",
    },
    {
        "rule_id": "LMPC_RULE_6_1_DA_IMPORTER",
        "declaration_name": "Name and Address of Importer",
        "field_name": "importer_info",
        "mandatory": False,
        "conditional": True,
        "applicability_condition": "is_imported == true",
        "validation_type": "IMPORTER_VALIDATION",
        "description": "For imported packages, the name and complete address of the importer must be declared on the package.",
        "legal_reference": f"Rule 6(1)(da) read with Rule 6(1)(a), {PCR}",
        "severity": "HIGH",
        "official_legal_reference": f"Rule 6(1)(da) read with Rule 6(1)(a), {PCR}",
        "source_pdf": "8(i)_0_1732860957.pdf",
        "english_text": "For imported packages, the name and complete address of the importer must be declared on the package.",
        "hindi_text_snippet": "आयातित पैकेज पर आयातकर्ता का नाम और पूरा पता लिखा जाना अनिवार्य है।",
        "last_amended_date": "2022.07.14",
        "applicability_notes": "Mandatory for all imported items sold in India.",
    },
    {
        "rule_id": "LMPC_RULE_6_1_E",
        "declaration_name": "Maximum Retail Price (MRP)",
        "field_name": "mrp",
        "mandatory": True,
        "conditional": False,
        "applicability_condition": None,
        "validation_type": "MRP_VALIDATION",
        "description": "Every package shall bear the retail sale price of the package in Indian Rupees, inclusive of all taxes, in the prescribed format (e.g. 'MRP Rs. ... incl. of all taxes' or 'MRP ₹ ... incl. of all taxes').",
        "legal_reference": f"Rule 6(1)(e) read with Rule 2(m), {PCR}",
        "severity": "HIGH",
        "official_legal_reference": f"Rule 6(1)(e) read with Rule 2(m), {PCR}",
        "source_pdf": "2023.7.10 Medical Devices revision of prices_1733228304.pdf",
        "english_text": "Every package shall bear the retail sale price of the package in Indian Rupees inclusive of all taxes in the format 'MRP Rs. ... incl. of all taxes' or 'MRP ₹ ... incl. of all taxes'.",
        "hindi_text_snippet": "प्रत्येक पैकेज पर अधिकतम खुदरा मूल्य (सभी करों सहित) रु. या ₹ के रूप में स्पष्ट रूप से अंकित होना चाहिए।",
        "last_amended_date": "2023.07.10",
        "applicability_notes": "Mandatory for all packaged retail goods. Specific price revision guidelines apply to medical devices, pharmaceuticals, and essential commodities.",
    },
    {
        "rule_id": "LMPC_RULE_6_1_G",
        "declaration_name": "Consumer Care Details",
        "field_name": "consumer_care",
        "mandatory": True,
        "conditional": False,
        "applicability_condition": None,
        "validation_type": "CONSUMER_CARE_VALIDATION",
        "description": "Every package shall bear the name of the person or office who can be contacted in case of consumer complaints along with telephone number, email address, and postal address.",
        "legal_reference": f"Rule 6(1)(g) read with Rule 6(8), {PCR}",
        "severity": "HIGH",
        "official_legal_reference": f"Rule 6(1)(g) read with Rule 6(8), {PCR}",
        "source_pdf": "8(i)_0_1732860957.pdf",
        "english_text": "Every package shall bear the name, address, telephone number and email address of the person or office who can be contacted in case of consumer complaints.",
        "hindi_text_snippet": "उपभोक्ता शिकायतों के समाधान के लिए संबंधित व्यक्ति या कार्यालय का नाम, पता, टेलीफोन नंबर और ईमेल आईडी पैकेज पर अनिवार्य है।",
        "last_amended_date": "2021.11.02",
        "applicability_notes": "Mandatory across all consumer packaged products without exception.",
    },
    {
        "rule_id": "LMPC_RULE_6_1_F",
        "declaration_name": "Best Before or Use By Date",
        "field_name": "best_before_date",
        "mandatory": False,
        "conditional": True,
        "applicability_condition": "category in ['food', 'perishable', 'cosmetics', 'pharmaceutical'] or best_before_date is not null",
        "validation_type": "BEST_BEFORE_VALIDATION",
        "description": "For commodities which may become unfit for human consumption after a period of time, the 'best before' or 'use by' date, month and year shall be mentioned.",
        "legal_reference": f"Rule 6(1)(f), {PCR}",
        "severity": "MEDIUM",
        "official_legal_reference": f"Rule 6(1)(f), {PCR}",
        "source_pdf": "2nd PCR Pan Masala_1764736734.pdf",
        "english_text": "For commodities which may become unfit for human consumption after a period of time, the 'best before' or 'use by' date, month and year shall be mentioned.",
        "hindi_text_snippet": "मानव उपभोग के लिए कालावधि के पश्चात अनुपयुक्त होने वाली वस्तुओं पर 'सर्वश्रेष्ठ उपयोग अवधि' (Best Before) या 'उपयोग तिथि' (Use By) अंकित करना अनिवार्य है।",
        "last_amended_date": "2023.10.06",
        "applicability_notes": "Food products, perishable items, cosmetics, pharmaceuticals, edible oils, pan masala, and health supplements.",
    },
    {
        "rule_id": "LMPC_RULE_6_1_E_USP",
        "declaration_name": "Unit Sale Price (USP)",
        "field_name": "unit_sale_price",
        "mandatory": False,
        "conditional": True,
        "applicability_condition": "unit_sale_price is not null or package_type == 'multi_unit'",
        "validation_type": "UNIT_SALE_PRICE_VALIDATION",
        "description": "Unit sale price declared in rupees, rounded off to the nearest two decimal places, per g/kg/ml/l/metre/number.",
        "legal_reference": f"Rule 6(1)(e) clause (ii) & (iii), {PCR} (as amended)",
        "severity": "LOW",
        "official_legal_reference": f"Rule 6(1)(e) clause (ii) & (iii), {PCR} (as amended 2021/2022)",
        "source_pdf": "2022 3rd amendment in PCR Garments_1733228786.pdf",
        "english_text": "Unit sale price declared in rupees, rounded off to nearest two decimal places, per g/kg/ml/l/metre/number.",
        "hindi_text_snippet": "इकाई बिक्री मूल्य (Unit Sale Price) प्रति ग्राम/किग्रा/मिली/लीटर/मीटर/संख्या के आधार पर निकटतम दो दशमलव स्थानों तक अंकित होना चाहिए।",
        "last_amended_date": "2022.12.01",
        "applicability_notes": "Multi-unit packages, garments (per piece/number), large volume food items, and packaged retail items exceeding 1 unit/kg/litre.",
    },
]

# Which extracted field carries the visual evidence of a rule
EVIDENCE_FIELD = {
    "LMPC_RULE_6_1_A": "manufacturer_name",
    "LMPC_RULE_6_1_B": "commodity_name",
    "LMPC_RULE_6_1_C": "net_quantity",
    "LMPC_RULE_6_1_D": "date_declaration",
    "LMPC_RULE_6_1_DA_ORIGIN": "country_of_origin",
    "LMPC_RULE_6_1_DA_IMPORTER": "importer_name",
    "LMPC_RULE_6_1_E": "mrp",
    "LMPC_RULE_6_1_G": "consumer_care",
    "LMPC_RULE_6_1_F": "best_before",
    "LMPC_RULE_6_1_E_USP": "unit_sale_price",
}

# Metadata shown for a rule id that is not in the catalogue
UNKNOWN_RULE_LEGAL_REF = PCR
UNKNOWN_RULE_SOURCE = "Official Gazetted Rules"
KNOWN_RULE_SOURCE_DEFAULT = "Packaged Commodities Rules, 2011"
UNKNOWN_RULE_SEVERITY = "HIGH"

# Severity weights and status credit (in tenths) of the weighted score
SEVERITY_WEIGHT = {"HIGH": 3, "MEDIUM": 2, "LOW": 1}
STATUS_CREDIT_TENTHS = {"PASS": 10, "WARNING": 6, "REQUIRES_HUMAN_VERIFICATION": 5, "FAIL": 0}

# --------------------------------------------------------------------------------------------
# The declared fields
# --------------------------------------------------------------------------------------------

EXTRACTED_FIELDS = [
    "product_name", "commodity_name", "manufacturer_name", "manufacturer_address",
    "packer_name", "packer_address", "importer_name", "importer_address",
    "net_quantity", "mrp", "unit_sale_price", "date_declaration", "best_before",
    "consumer_care", "consumer_care_email", "consumer_care_phone", "consumer_care_address",
    "country_of_origin",
]

PRODUCT_STRING_COLUMNS = [
    "product_name", "generic_name", "manufacturer_name", "manufacturer_address",
    "packer_name", "packer_address", "importer_name", "importer_address", "net_quantity",
    "mrp", "unit_sale_price", "date_declaration", "best_before_date", "consumer_care",
    "consumer_care_email", "consumer_care_phone", "consumer_care_address",
    "country_of_origin", "category", "package_type", "raw_text",
]

# Fields where a longer text is preferred once confidences agree (panel merge)
COMPLETENESS_FIELDS = [
    "manufacturer_address", "packer_address", "importer_address", "consumer_care",
    "consumer_care_address",
]

# The eight declarations every label is compared with
REQUIRED_DECLARATIONS = [
    # (field, label, legal reference, why required, usual place)
    ("mrp", "Maximum Retail Price (MRP)", "Rule 6(1)(e) - PCR 2011",
     "Statutory retail price declaration inclusive of all taxes", "Front / Principal Display Panel"),
    ("manufacturer_name", "Manufacturer / Packer / Importer Details", "Rule 6(1)(a) - PCR 2011",
     "Name and complete address of manufacturer, packer, or importer", "Front or Back Panel"),
    ("commodity_name", "Generic / Commodity Name", "Rule 6(1)(b) - PCR 2011",
     "Common or generic identity of the commodity", "Front / Principal Display Panel"),
    ("net_quantity", "Net Quantity", "Rule 6(1)(c) - PCR 2011",
     "Net weight, volume, or numerical count", "Front / Principal Display Panel"),
    ("date_declaration", "Date of Mfg / Packing / Import", "Rule 6(1)(d) - PCR 2011",
     "Month and year of manufacture, packing, or import", "Back or Side Panel"),
    ("consumer_care", "Consumer Care Details", "Rule 6(1)(g) - PCR 2011",
     "Contact person, address, phone number, or email for consumer complaints",
     "Back Panel / Information Side"),
    ("country_of_origin", "Country of Origin", "Rule 6(1)(da) - PCR 2011",
     "Country of origin for statutory product tracking", "Back Panel / Information Side"),
    ("unit_sale_price", "Unit Sale Price (USP)", "Rule 6(1)(e) - PCR 2011",
     "Price per unit (per g/ml) for standardized comparison", "Front / Price Panel"),
]

# Fields that stand in when the primary field of a declaration was not found
DECLARATION_FALLBACKS = {
    "manufacturer_name": ["manufacturer_address", "packer_name", "importer_name"],
    "consumer_care": ["consumer_care_email", "consumer_care_phone", "consumer_care_address"],
}

# Fields and labels named in the multi-panel note
PANEL_NOTE_LABELS = {
    "mrp": "MRP",
    "manufacturer_name": "Manufacturer",
    "commodity_name": "Commodity Name",
    "net_quantity": "Net Quantity",
    "date_declaration": "Date of Declaration",
    "consumer_care": "Consumer Care",
}

# Labels of the flattened export
EXPORT_LABELS = {
    "product_name": "Product Name",
    "generic_name": "Generic Name of Commodity",
    "manufacturer_name": "Manufacturer Name",
    "manufacturer_address": "Manufacturer Address",
    "packer_name": "Packer Name",
    "packer_address": "Packer Address",
    "importer_name": "Importer Name",
    "importer_address": "Importer Address",
    "net_quantity": "Net Quantity Declaration",
    "mrp": "Maximum Retail Price (MRP)",
    "unit_sale_price": "Unit Sale Price (USP)",
    "date_declaration": "Date of Manufacture / Packing",
    "best_before_date": "Best Before / Expiry Date",
    "consumer_care": "Consumer Care Details",
    "consumer_care_email": "Consumer Care Email",
    "consumer_care_phone": "Consumer Care Helpline",
    "consumer_care_address": "Consumer Care Postal Address",
    "country_of_origin": "Country of Origin",
    "category": "Product Category",
    "package_type": "Packaging Type",
}

GUIDANCE_NOTE = (
    "Possible cause: Only back panel / nutrition side was captured. "
    "Please also upload a clear image of the front / principal display panel where MRP, "
    "manufacturer name & address, and consumer care details are usually printed."
)
DEFAULT_SUMMARY = "Compliance assessment completed."
ECOMMERCE_SUMMARY = (
    "[E-commerce Listing Analysis Mode] All mandatory statutory text declarations (MRP, Net "
    "Quantity, Date of Mfg/Pack, Manufacturer/Importer details, Consumer Care, Country of Origin) "
    "fully evaluated. Physical package dimension/font height checks set to Not Applicable for "
    "online product listing screenshots."
)
PHYSICAL_ONLY_MARKERS = ["font_size", "readability", "placement", "principal_display"]

# --------------------------------------------------------------------------------------------
# Text repair (regular expression, replacement), applied in this order
# --------------------------------------------------------------------------------------------

TEXT_REPAIRS = [
    (r"\b(?:R5|R\$|M\.?R\.?P\.?R5)\b", "Rs."),
    (r"\bRs(?!\.)\b", "Rs."),
    (r"\bRs\.\.\b", "Rs."),
    (r"\b(?:m\.?r\.?p\.?|mrp)\s*[:\-\.]?\s*r5\b", "MRP Rs."),
    (r"\bRs\.\s*([0-9]+)[oO]\b", "Rs. $10"),
    # the next one is the only case-sensitive entry, but it holds no letters
    (r"\b0/-\b", "/-"),
    (r"\b(?:Ncl\s*Qty|Net\s*Oty|Net\s*Ouantity|Net\s*Qtv)\b", "Net Qty"),
    (r"\bNcl\b", "Net"),
    (r"\bNet\s*Wt\.?\s*[:\-\.]?", "Net Wt: "),
    (r"\bNet\s*Vol\.?\s*[:\-\.]?", "Net Vol: "),
    (r"\b(?:Pkcl|Pkl|Pkc|Packd|Pckd|Pkgd)\b", "Pkd"),
    (r"\b(?:Mfd|Mfc|Mfgd|Manufd)\b", "Mfd"),
    (r"\bDate\s*of\s*Packin\b", "Date of Packing"),
    (r"\bBest\s*Befor\b", "Best Before"),
    (r"\b(?:Mfg\s*by|Mfd\s*by|Manuf\s*by|Manufctured\s*by)\b", "Manufactured by"),
    (r"\b(?:Mktd\s*by|Mktg\s*by|Marketd\s*by)\b", "Marketed by"),
    (r"\b(?:Pkd\s*by|Packed\s*&\s*Mktd\s*by)\b", "Packed by"),
    (r"\b(?:Cust\s*Care|Consumr\s*Care|Customr\s*Care|Customer\s*Svc)\b", "Consumer Care"),
    (r"\bToll\s*Fre\b", "Toll Free"),
    (r"\bContct\s*Us\b", "Contact Us"),
    (r"\b(?:Cntry\s*of\s*Origin|Country\s*of\s*Orgin)\b", "Country of Origin"),
    (r"\bMade\s*in\s*lndia\b", "Made in India"),
]

# Digit repair, case-sensitive, only on lines that look numeric
NUMERIC_REPAIRS = [
    (r"(?<=\d)[oO](?=\d|\b)", "0"),
    (r"\b[oO](?=\d)", "0"),
    (r"(?<=\d)[lI](?=\d|\b)", "1"),
    (r"\b[lI](?=\d)", "1"),
    (r"(?<=\d)[sS](?=\d)", "5"),
]
NUMERIC_LINE_WORDS = ["mrp", "rs", "net", "pkd", "mfd", "qty", "exp"]

# Unit standardisation
UNIT_REPAIRS = [
    (r"(\d)\s*(?:gms?\.?|gram|grams)\b", "$1 g"),
    (r"(\d)\s*(?:kgs?\.?|kilo|kilograms?)\b", "$1 kg"),
    (r"(\d)\s*(?:ltrs?\.?|liter|liters|litre|litres)\b", "$1 L"),
    (r"(\d)\s*(?:mls?\.?|milliliter|millilitres)\b", "$1 ml"),
    (r"(\d)\s*(?:pcs|nos|units|count)\b", "$1 N"),
]
REPAIR_MARKER = "ocr_postprocessed"

# --------------------------------------------------------------------------------------------
# Declaration patterns (case-insensitive unless stated otherwise)
# --------------------------------------------------------------------------------------------

_AMOUNT = r"([0-9]{1,4}(?:,[0-9]{3})*(?:\.[0-9]{1,2})?)"
MRP_PATTERNS = [
    r"(?:m\.?r\.?p\.?|max(?:imum)?\s*retail\s*price|mrp)\s*[:\-\.]?\s*(?:rs\.?|inr|₹)?\s*" + _AMOUNT,
    r"(?:(?:rs\.?|inr|₹)\s*" + _AMOUNT + r")\s*(?:incl|inclusive)",
    r"\b(?:rs\.?|inr|₹)\s*" + _AMOUNT + r"\b",
    r"\b([0-9]+(?:\.[0-9]{1,2})?)\s*/\-\b",
    r"(?:m\.?r\.?p\.?|mrp)\s*[:\-\.]?\s*([0-9]+(?:\.[0-9]{1,2})?)",
]
_UNITS = (
    r"(kg|g|mg|l|ml|cl|cm3|mm|cm|m|sq\s*cm|sq\s*m|cm2|m2|gms?\.?|kgs?\.?|ltrs?\.?|litres?|liters?|mls?\.?|n|u|units?|pieces?|pcs|nos?|count)\b"
)
QUANTITY_PATTERNS = [
    r"(?:net\s*(?:qty|quantity|wt|weight|contents?|volume)?\s*[:\-\.]?\s*)?([0-9]+(?:\.[0-9]+)?|\.[0-9]+)\s*" + _UNITS,
    r"\b([0-9]+(?:\.[0-9]+)?)\s*(kg|g|mg|l|ml|cl|n|u|pcs|gms|kgs|ltrs)\b",
]
USP_PATTERNS = [
    r"(?:unit\s*sale\s*price|usp)\s*[:\-\.]?\s*(?:rs\.?|inr|₹)?\s*([0-9]+(?:\.[0-9]{1,2})?)\s*(?:/|per)\s*([a-zA-Z0-9]+)",
    r"(?:rs\.?|inr|₹)\s*([0-9]+(?:\.[0-9]{1,2})?)\s*(?:/|per)\s*(?:g|kg|ml|l|m|piece|n|u|count)",
]
DATE_PATTERNS = [
    r"(?:mfd|mfg|manufactured|pkd|packed|pkg|imported|date\s*of\s*mfg|date\s*of\s*pkg|date\s*of\s*packing)\s*[:\-\.]?\s*"
    r"([0-9]{1,2}[/\-\.][0-9]{2,4}|[a-zA-Z]{3,9}\s*[/\-\.\s]\s*[0-9]{2,4})",
    r"\b(0?[1-9]|1[0-2])[/\-\.](20\d{2}|\d{2})\b",
    r"\b([a-zA-Z]{3,9})[\-\/\s]+(20\d{2}|\d{2})\b",
]
_DURATION = r"[0-9]+\s*months?(?:\s*from\s*(?:mfg|pkg|packaging|manufacture))?"
BEST_BEFORE_PATTERNS = [
    r"(?:best\s*before|use\s*by|expiry\s*date|exp\.?\s*date|exp)\s*[:\-\.]?\s*"
    r"([0-9]{1,2}[/\-\.][0-9]{2,4}|[a-zA-Z]{3,9}\s*[/\-\.\s]\s*[0-9]{2,4}|" + _DURATION + r")",
    r"best\s*before\s*(" + _DURATION + r")",
]
ORIGIN_PATTERNS = [
    r"(?:country\s*of\s*origin|origin|made\s*in|product\s*of)\s*[:\-\.]?\s*([a-zA-Z\s]{2,25})",
    r"\bmade\s*in\s*([a-zA-Z\s]{2,25})\b",
]
# What every line matched by the patterns above holds: words of the lower-cased line, or a short pattern.  The words
# avoid letters that other characters match when case is ignored (dotless i, Kelvin sign); the long s is listed.
MRP_NEEDS = ["mr", "m.r", "max", "rs", "rſ", "nr", "₹", "/-"]
QUANTITY_NEEDS = r"[0-9]\s*" + _UNITS
USP_NEEDS = ["/", "per"]
DATE_NEEDS = r"[/\-.\s]\d\d"
BEST_BEFORE_NEEDS = ["before", "by", "exp"]
ORIGIN_NEEDS = ["or", "made", "product"]
# case-sensitive
EMAIL_PATTERN = r"\b[a-zA-Z0-9_.+-]+@[a-zA-Z0-9-]+\.[a-zA-Z0-9-.]+\b"
PHONE_PATTERN = (
    r"(?:\+?91[\-\s]?)?(?:1800[\-\s]?[0-9]{3,4}[\-\s]?[0-9]{3,4}|(?:(?!890)[6-9])[0-9]{9}|\b\d{3,5}[\-\s]?\d{6,8}\b)"
)

MAKER_KEYWORDS = [
    "manufactured by", "manufactured & marketed by", "mfg by", "mfd by", "produced by", "marketed by",
]
PACKER_KEYWORDS = [
    "packed by", "packed & marketed by", "pkd by", "re-packed by", "packaged by",
]
IMPORTER_KEYWORDS = [
    "imported by", "importer", "imported and marketed by", "imported & distributed by",
]
CARE_KEYWORDS = [
    "consumer care", "customer care", "customer service", "toll free", "helpline", "contact us",
    "for feedback", "for complaints", "in case of complaints", "grievance officer",
]
ENTITY_KEYWORDS = MAKER_KEYWORDS + PACKER_KEYWORDS + IMPORTER_KEYWORDS
ENTITY_STOP_WORDS = ENTITY_KEYWORDS + CARE_KEYWORDS + ["net wt", "net qty", "mrp", "pkd", "mfd", "date of"]
CARE_STOP_WORDS = ["country of origin", "made in", "mrp", "net wt"]
DATE_MATCH_WORDS = ["mfg", "mfd", "pkd", "pkg", "packed", "date"]
PRICE_AND_META_WORDS = [
    "mrp", "net wt", "net qty", "mfd", "pkg", "date of", "best before", "unit sale price",
    "country of origin", "price", "pricers", "lpricer", "usp", "rs.", "inr", "₹", "rate", "amt",
    "amount", "incl",
]

# Category words, first list that hits decides
CATEGORY_WORDS = [
    ("food", ["biscuit", "cookie", "food", "snack", "flour", "atta", "rice", "tea", "coffee", "oil",
              "sugar", "spice", "oats"]),
    ("cosmetics", ["cream", "soap", "lotion", "shampoo", "cosmetic", "perfume"]),
    ("pharmaceutical", ["tablet", "capsule", "syrup", "pharma", "mg", "medicine"]),
]

# normalisation
MRP_AMOUNT = r"([0-9]{1,4}(?:,[0-9]{3})*(?:\.[0-9]{1,2})?|[0-9]+(?:\.[0-9]{1,2})?)"
QUANTITY_PARTS = r"([0-9]+(?:\.[0-9]+)?|\.[0-9]+)\s*([a-zA-Z0-9\.\^²³]+)"
DATE_PREFIX = (
    r"^(?:mfd|mfg|pkd|packed|pkg|imported|best\s*before|use\s*by|date\s*of\s*(?:mfg|pkg|packing))?\s*[:\-\.]?\s*"
)
ORIGIN_PREFIX = r"^(?:country\s*of\s*origin|origin|made\s*in|product\s*of)\s*[:\-\.]?\s*"
MONTHS = ["january", "february", "march", "april", "may", "june", "july", "august", "september",
          "october", "november", "december"]
HOME_COUNTRY_NAMES = ["india", "in", "ind"]

# Place and country names of the origin correction
INDIAN_CITIES = [
    "madurai", "mumbai", "delhi", "chennai", "bengaluru", "bangalore", "kolkata", "pune",
    "hyderabad", "ahmedabad", "surat", "jaipur", "lucknow", "kanpur", "nagpur", "indore", "thane",
    "bhopal", "visakhapatnam", "vadodara", "firozabad", "ludhiana", "rajkot", "agra", "nashik",
    "faridabad", "meerut", "kalyan", "vasai", "varanasi", "srinagar", "aurangabad", "dhanbad",
    "amritsar", "navi mumbai", "allahabad", "ranchi", "howrah", "coimbatore", "jabalpur",
    "gwalior", "vijayawada", "jodhpur", "raipur", "kota", "guwahati", "chandigarh", "solapur",
    "hubballi", "bareilly", "moradabad", "mysuru", "gurgaon", "gurugram", "aligarh", "jalandhar",
    "tiruchirappalli", "bhubaneswar", "salem", "mira-bhayandar", "warangal", "thiruvananthapuram",
    "bhiwandi", "saharanpur", "guntur", "amravati", "bikaner", "noida", "jamshedpur", "bhilai",
    "cuttack", "kochi", "cochin", "nellore", "bhavnagar", "dehradun", "durgapur", "asansol",
    "nanded", "kolhapur", "ajmer", "gulbarga", "jamnagar", "ujjain", "loni", "siliguri", "jhansi",
    "ulhasnagar", "jammu", "sangli-miraj & kupwad", "mangalore", "erode", "belgaum", "ambattur",
    "tirunelveli", "malegaon", "gaya", "jalgaon", "udaipur", "maheshtala", "davanagere",
    "kozhikode", "akola", "kurnool", "rajpur sonarpur", "rajahmundry", "bokaro", "south dumdum",
    "bellary", "patiala", "gopalpur", "agartala", "bhagalpur", "muzaffarnagar", "bhatpara",
    "panihati", "latur", "dhule", "rohtak", "korba", "bhilwara", "berhampur", "muzaffarpur",
    "ahmednagar", "mathura", "kollam", "avadi", "kadapa", "kamarhati", "bilaspur",
    "shahjahanpur", "bijapur", "ramagundam", "shimoga", "chandrapur", "junagadh", "thrissur",
    "alwar", "bardhaman", "kulti", "kakinada", "nizamabad", "parbhani", "tumkur", "khammam",
    "uzhavarkarai", "bihar sharif", "panipat", "dharwad", "darbhanga", "bally", "aizawl", "dewas",
    "ichalkaranji", "karnal", "bathinda", "jalna", "eluru", "kirari suleman nagar", "barasat",
    "satna", "mau", "sonipat", "farrukhabad", "sagar", "rourkela", "durg", "imphal", "ratlam",
    "hapur", "arrah", "karimnagar", "anantapur", "etawah", "ambernath", "north dumdum",
    "bharatpur", "begusarai", "new delhi", "gandhidham", "baranagar", "tiruppur", "pondicherry",
    "puducherry", "sivakasi",
]
INDIAN_STATES_AS_ORIGIN = [
    "tamil nadu", "maharashtra", "karnataka", "gujarat", "uttar pradesh", "west bengal",
    "rajasthan", "madhya pradesh", "andhra pradesh", "telangana", "kerala", "punjab", "haryana",
    "bihar", "odisha", "assam", "jharkhand", "chhattisgarh", "uttarakhand", "himachal pradesh",
    "goa",
]
INDIAN_PLACES = INDIAN_CITIES + INDIAN_STATES_AS_ORIGIN
ADDRESS_HINT_PLACES = ["madurai", "mumbai", "delhi", "chennai", "bengaluru", "tamil nadu",
                       "maharashtra", "karnataka"]
VALID_COUNTRIES = [
    "india", "ind", "in", "united states", "usa", "us", "china", "chn", "prc", "germany", "deu",
    "japan", "jpn", "united kingdom", "uk", "france", "fra", "italy", "ita", "canada", "can",
    "australia", "aus", "spain", "esp", "south korea", "korea", "thailand", "tha", "vietnam",
    "vnm", "malaysia", "mys", "indonesia", "idn", "taiwan", "twn", "singapore", "sgp",
    "switzerland", "che", "netherlands", "nld", "belgium", "bel", "mexico", "mex", "brazil", "bra",
]
HOME_ORIGIN_PHRASE = r"\b(?:made\s*in|origin|product\s*of)\s*[:\-\.]?\s*india\b"
ADDRESS_PIN = r"\b[1-8][0-9]{5}\b"
TRUE_QUANTITY = (
    r"(?:net\s*(?:qty|quantity|wt|weight|contents?|vol|volume)?\s*[:\-\.]?\s*)?"
    r"\b([0-9]+(?:\.[0-9]+)?\s*(?:l|liter|litres?|liters?|ml|kg|g|gms?|kgs?|pcs|n|units?))\b"
)

# --------------------------------------------------------------------------------------------
# Validator tables
# --------------------------------------------------------------------------------------------

MRP_PLACEHOLDERS = ["na", "null", "none", "0", "₹0", "rs.0", "rs 0", "free"]
MRP_NUMBER = r"(?:₹|Rs\.?|INR)?\s*([0-9]{1,3}(?:,[0-9]{3})*(?:\.[0-9]{1,2})?|[0-9]+(?:\.[0-9]{1,2})?)"
MRP_CURRENCY = r"(₹|Rs\.?|INR)"
MRP_TAX_PHRASE = r"(?:incl(?:\.|usive)?\s*(?:of)?\s*all\s*taxes|incl\.?\s*taxes)"

QUANTITY_FULL = (
    r"^\s*(?:net\s*(?:qty|quantity|wt|weight)?\s*[:\-\.]?\s*)?([0-9]+(?:\.[0-9]+)?|\.[0-9]+)\s*"
    r"([a-zA-Z0-9\.\^²³]+(?:\s+[a-zA-Z0-9]+)?)\s*$"
)
QUANTITY_FALLBACK = r"([0-9]+(?:\.[0-9]+)?)\s*([a-zA-Z]+)"
STANDARD_UNITS = [
    "g", "kg", "mg", "ml", "l", "cl", "cm3", "mm", "cm", "m", "sq cm", "sq m", "cm2", "m2",
    "n", "u", "unit", "units", "pcs", "piece", "pieces", "count", "nos", "no",
]
NON_STANDARD_UNITS = {
    "gms": "g", "gm": "g", "gms.": "g", "kgs": "kg", "kgs.": "kg", "kilo": "kg", "kilos": "kg",
    "ltr": "l", "ltrs": "l", "ltr.": "l", "litres": "l", "liter": "l", "liters": "l", "mls": "ml",
    "mls.": "ml", "mtr": "m", "mtrs": "m", "cnt": "N",
}

MONTH_NAMES = ["jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec",
               "january", "february", "march", "april", "june", "july", "august", "september",
               "october", "november", "december"]
# (pattern, format name, group of the year, group of the month word or None, ignore case)
DATE_FORMATS = [
    (r"^(0?[1-9]|1[0-2])[/\-\.](\d{4}|\d{2})$", "MM/YYYY or MM/YY", 2, None, False),
    (r"^(0?[1-9]|[12]\d|3[01])[/\-\.](0?[1-9]|1[0-2])[/\-\.](\d{4}|\d{2})$", "DD/MM/YYYY", 3, None, False),
    (r"^(?:mfg|pkd|packed|mfd|imported)?\s*[:\-\.]?\s*([a-zA-Z]{3,9})\s*[/\-\.\s]\s*(\d{4}|\d{2})$",
     "Month Year", 2, 1, True),
    (r"^(?:mfg|pkd|packed|mfd|imported)?\s*[:\-\.]?\s*(0?[1-9]|1[0-2])[/\-\.](\d{4}|\d{2})$",
     "MM/YYYY with prefix", 2, None, True),
]
RELATIVE_EXPIRY = r"best\s*before\s*\d+\s*months?"
MIN_YEAR = 2015

ADDRESS_STATES = [
    "andhra pradesh", "arunachal pradesh", "assam", "bihar", "chhattisgarh", "goa", "gujarat",
    "haryana", "himachal pradesh", "jharkhand", "karnataka", "kerala", "madhya pradesh",
    "maharashtra", "manipur", "meghalaya", "mizoram", "nagaland", "odisha", "punjab", "rajasthan",
    "sikkim", "tamil nadu", "telangana", "tripura", "uttar pradesh", "uttarakhand", "west bengal",
    "delhi", "puducherry", "chandigarh", "jammu & kashmir", "jammu and kashmir", "ladakh",
]
POSTAL_PIN = r"\b[1-9][0-9]{5}\b"
CARE_EMAIL = r"[a-zA-Z0-9_.+-]+@[a-zA-Z0-9-]+\.[a-zA-Z0-9-.]+"
CARE_PHONE = (
    r"(?:\+?91[\-\s]?)?(?:1800[\-\s]?[0-9]{3,4}[\-\s]?[0-9]{3,4}|[6-9][0-9]{9}|\d{3,5}[\-\s]?\d{6,8})"
)
KNOWN_COUNTRIES = [
    "india", "china", "vietnam", "thailand", "indonesia", "usa", "united states",
    "united kingdom", "uk", "germany", "japan", "south korea", "korea", "france", "italy",
    "malaysia", "taiwan", "bangladesh", "sri lanka", "spain", "brazil", "mexico", "australia",
    "canada", "singapore", "uae", "switzerland", "netherlands",
]
UNIT_PRICE = r"(?:₹|Rs\.?|INR)?\s*([0-9]+(?:\.[0-9]{1,2})?)\s*(?:/|per)\s*([a-zA-Z]+)"

# --------------------------------------------------------------------------------------------
# Readability thresholds (pixels and confidences) and position limits
# --------------------------------------------------------------------------------------------

MIN_CONFIDENCE = 0.70
WARN_CONFIDENCE = 0.50
MIN_HEIGHT_PX = 12.0
WARN_HEIGHT_PX = 8.0
STANDARD_HEIGHT_PX = 24.0
MIN_SHARPNESS = 20.0
DEFAULT_SHARPNESS = 80.0
READABLE_REASON = "Text is sharp, high-confidence, and clearly readable in image."
BLOCK_ORDER = [
    "block_top_left_horiz", "block_top_left_vert", "block_top_right_horiz", "block_top_right_vert",
    "block_bottom_left_horiz", "block_bottom_left_vert", "block_bottom_right_horiz",
    "block_bottom_right_vert",
]

# --------------------------------------------------------------------------------------------
# Text quality score (weights 25 / 35 / 30 / 10, six keyword groups)
# --------------------------------------------------------------------------------------------

QUALITY_KEYWORD_GROUPS = [
    MAKER_KEYWORDS + ["packed by", "pkd by", "mfg", "mfd"],
    ["mrp", "m.r.p", "max retail price", "maximum retail price", "incl of all taxes", "incl. taxes"],
    ["net qty", "net quantity", "net wt", "net weight", "net contents", "100 g", "500 g", "1 kg", "1 l"],
    ["pkd", "mfd", "date of", "best before", "use by", "expiry", "exp"],
    CARE_KEYWORDS + ["email", "toll free", "helpline", "care@"],
    ["country of origin", "made in", "product of", "india"],
]

# --------------------------------------------------------------------------------------------
# Legal text search, question routing, document metadata
# --------------------------------------------------------------------------------------------

STOPWORDS = [
    "what", "is", "the", "for", "of", "and", "in", "to", "a", "an", "on", "are", "tell", "me",
    "about", "how", "who", "write", "best", "current", "list", "do", "does", "with", "from", "as",
    "by", "under", "can", "you", "my", "our", "all", "any", "requirements", "requirement",
    "please", "script", "mandatory", "declaration", "declarations", "provisions", "provision",
    "rules", "rule",
]
DATA_WORDS = [
    "scan", "scans", "history", "trend", "trends", "dashboard", "stats", "statistics", "rate",
    "rates", "count", "how many", "total", "percentage", "brands", "brand", "top", "violations",
    "violation", "failed", "passed", "authenticity rate", "font size", "inspected", "records",
    "database", "average score", "summary", "daily",
]
RULE_WORDS = [
    "rule", "rules", "lmpc", "pcr", "section", "act", "clause", "mrp", "price", "taxes",
    "inclusive", "net quantity", "quantity", "weight", "measure", "volume", "grams", "litres",
    "manufacturer", "packer", "importer", "consumer care", "customer care", "hotline", "date",
    "manufacturing", "expiry", "best before", "origin", "country of origin", "unit sale price",
    "usp", "edible oil", "sop", "mandatory", "conditional", "schedule", "amendment",
    "notification", "guideline", "law", "statutory", "legal", "citation", "document", "pdf",
    "नियम", "शुद्ध", "मात्रा", "निर्माता", "पैकर", "एमआरपी", "तारीख", "उपभोक्ता", "कानून",
]
RULE_QUESTION = r"\b(rule\s*6|6\s*\(\s*1\s*\)|lmpc|pcr|act\s*2009|rules\s*2011)\b"
DATA_QUESTION = r"\b(how many|what is the (compliance|violation) rate|total scans|top brand|average score)\b"
CITATION = r"6\s*\(\s*1\s*\)\s*\(\s*[a-g|da]+\s*\)"
REFUSAL = (
    "I don't have that information. I am an official Legal Metrology assistant and can "
    "only answer questions grounded in the Legal Metrology (Packaged Commodities) Rules, 2011, "
    "official DoCA gazette notifications, and system inspection scan records."
)

TOPICS = [
    ("e-commerce", ["e-commerce", "ecommerce", "online", "marketplace", "website"]),
    ("country_of_origin", ["country of origin", "coo", "imported", "importer"]),
    ("garments", ["garment", "garments", "textile", "hosiery", "wear", "readymade"]),
    ("edible_oil", ["edible oil", "fats", "oil", "fat"]),
    ("medical_devices", ["medical device", "medical devices", "stent", "drug"]),
    ("pan_masala", ["pan masala", "tobacco", "gutkha"]),
    ("qr_code", ["qr code", "qr", "quick response", "digital"]),
    ("unit_sale_price", ["unit sale price", "usp", "per g", "per kg"]),
    ("mrp_declaration", ["mrp", "maximum retail price", "retail sale price", "tax"]),
    ("net_quantity", ["net quantity", "standard pack", "weight", "measure"]),
    ("date_declaration", ["month and year", "pre-packing", "manufacture date"]),
    ("manufacturer_packer", ["manufacturer", "packer", "address", "name and address"]),
    ("consumer_care", ["consumer care", "complaint", "helpline", "toll free"]),
]
DEFAULT_TOPIC = "general_packaged_commodities"
# (type, words in the file name, words in the text), first hit decides
DOCUMENT_TYPES = [
    ("Amendment", ["amendment"], ["amendment"]),
    ("Advisory", ["advisory"], ["advisory"]),
    ("SOP", ["sop"], ["standard operating procedure"]),
    ("Corrigendum", ["corrigendum"], ["corrigendum"]),
    ("Guidelines", ["guideline"], ["guidelines"]),
    ("Notification", ["notification"], ["gazette"]),
]
DEFAULT_DOCUMENT_TYPE = "Legal Metrology Circular/Rule"
DEFAULT_DOCUMENT_DATE = "2011 (as amended)"

# --------------------------------------------------------------------------------------------
# Brand comparison
# --------------------------------------------------------------------------------------------

GENUINE_THRESHOLD = 0.80
