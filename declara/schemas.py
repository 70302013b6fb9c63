"""Explicit schemas of the stored tables; nothing is inferred from data."""

from __future__ import annotations

REGIONS = (
    "image_id bigint, engine string, pos int, text string, confidence double, "
    "bounding_box array<array<double>>"
)
RESULTS = (
    "image_id bigint, raw_text string, regions array<struct<text:string,confidence:double,"
    "bounding_box:array<array<double>>>>, average_confidence double, preprocessing_applied array<string>, "
    "image_width int, image_height int, scale_factor double"
)
LABEL_TEXT = "product_id bigint, raw_text string"
PRODUCTS = (
    "product_id bigint, product_name string, generic_name string, manufacturer_name string, "
    "manufacturer_address string, packer_name string, packer_address string, importer_name string, "
    "importer_address string, net_quantity string, mrp string, unit_sale_price string, "
    "date_declaration string, best_before_date string, consumer_care string, consumer_care_email string, "
    "consumer_care_phone string, consumer_care_address string, country_of_origin string, "
    "is_imported boolean, category string, package_type string, raw_text string, metadata map<string,string>"
)
RULES = (
    "rule_id string, declaration_name string, field_name string, mandatory boolean, conditional boolean, "
    "applicability_condition string, validation_type string, description string, legal_reference string, "
    "severity string, official_legal_reference string, source_pdf string, english_text string, "
    "hindi_text_snippet string, last_amended_date string, applicability_notes string"
)
DOCUMENT_INDEX = (
    "dataset_name string, total_documents bigint, documents array<struct<filename:string,title:string,"
    "date:string,document_type:string,language:string,key_topics:array<string>,char_count:bigint,page_count:bigint>>"
)
DOCUMENT_RECORDS = (
    "doc_id bigint, filename string, title string, date string, document_type string, language string, "
    "key_topics array<string>, char_count bigint"
)
SCANS = (
    "id bigint, product_name string, overall_status string, compliance_score double, compliance_result string, "
    "authenticity_result string, visual_statistics string, extracted_data string, image_path string, "
    "officer_id bigint, created_at timestamp, updated_at timestamp, scan_date date"
)
# the part of a stored compliance document that queries read
RESULT = (
    "struct<rule_id:string,declaration:string,status:string,detected_value:string,reason:string,"
    "legal_reference:string,official_legal_reference:string,source_pdf:string,severity:string,"
    "evidence:struct<pixel_text_height:double,text_height_pixels:double>>"
)
COMPLIANCE = (
    "struct<product_name:string,overall_status:string,compliance_score:double,total_checks:int,passed:int,"
    f"failed:int,warnings:int,guidance_note:string,results:array<{RESULT}>>"
)
# the part the dashboard reads: fewer fields parsed per scan
DASHBOARD = (
    "struct<results:array<struct<rule_id:string,declaration:string,status:string,"
    "evidence:struct<pixel_text_height:double,text_height_pixels:double>>>>"
)
VERDICT = "struct<verdict:string,similarity_score:double>"
BRANDS = (
    "brand_id string, brand_name string, embedding array<float>, logo_embedding array<float>, "
    "palette array<array<int>>, font_height_ratio double, registered_at timestamp"
)
