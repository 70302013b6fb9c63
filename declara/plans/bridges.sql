-- Bridge views: star-schema test tables as label-domain inputs (see FIXTURES.md).

-- view: product_input
SELECT p.p_partkey AS product_id,
  CASE p.p_partkey % 11 WHEN 0 THEN NULL WHEN 1 THEN 'S60017' WHEN 2 THEN 'q' ELSE p.p_name END AS product_name,
  CAST(NULL AS STRING) AS generic_name,
  CASE WHEN p.p_partkey % 7 = 0 THEN NULL ELSE s.s_name END AS manufacturer_name,
  CASE p.p_partkey % 5 WHEN 0 THEN NULL WHEN 1 THEN 'Pune' WHEN 2 THEN 'Plot 14, Pune, Maharashtra 411018'
    WHEN 3 THEN 'Industrial' ELSE concat('Plot ', CAST(p.p_size AS STRING), ', ', n.n_name) END AS manufacturer_address,
  CASE WHEN p.p_partkey % 14 = 0 THEN 'Swift Packing' ELSE NULL END AS packer_name,
  CASE WHEN p.p_partkey % 14 = 0 THEN 'Andheri, Mumbai 400069' ELSE NULL END AS packer_address,
  CASE WHEN p.p_partkey % 6 = 0 THEN 'Apex Trading' ELSE NULL END AS importer_name,
  CASE WHEN p.p_partkey % 12 = 0 THEN 'Connaught Place, New Delhi 110001' ELSE NULL END AS importer_address,
  CASE p.p_partkey % 8 WHEN 0 THEN NULL WHEN 1 THEN concat(CAST(p.p_size AS STRING), ' gms')
    WHEN 2 THEN concat(CAST(p.p_size AS STRING), ' bottle') WHEN 3 THEN '0 g' WHEN 4 THEN 'some'
    WHEN 5 THEN concat(CAST(p.p_size AS STRING), ' N') ELSE concat(CAST(p.p_size AS STRING), ' g') END AS net_quantity,
  CASE p.p_partkey % 7 WHEN 0 THEN NULL WHEN 1 THEN 'free' WHEN 2 THEN 'see pack'
    WHEN 3 THEN CAST(CAST(p.p_retailprice AS DECIMAL(10,2)) AS STRING)
    WHEN 4 THEN concat('Rs. ', CAST(CAST(p.p_retailprice AS DECIMAL(10,2)) AS STRING))
    ELSE concat('Rs. ', CAST(CAST(p.p_retailprice AS DECIMAL(10,2)) AS STRING), ' incl. of all taxes') END AS mrp,
  CASE p.p_partkey % 9 WHEN 0 THEN 'Rs. 0.50 per g' WHEN 1 THEN 'cheap' ELSE NULL END AS unit_sale_price,
  CASE p.p_partkey % 10 WHEN 0 THEN NULL WHEN 1 THEN '06/2026' WHEN 2 THEN 'June 2025' WHEN 3 THEN '12/03/2024'
    WHEN 4 THEN '06/1999' WHEN 5 THEN '6' WHEN 6 THEN 'batch 77x' WHEN 7 THEN 'unknown' ELSE '01-25' END AS date_declaration,
  CASE p.p_partkey % 4 WHEN 0 THEN 'best before 6 months' WHEN 1 THEN '12/2026' ELSE NULL END AS best_before_date,
  CASE p.p_partkey % 6 WHEN 0 THEN 'Care: 1800-123-4567 care@example.in' WHEN 1 THEN 'write to us' WHEN 2 THEN 'hi' ELSE NULL END AS consumer_care,
  CASE WHEN p.p_partkey % 6 = 3 THEN 'help@example.in' ELSE NULL END AS consumer_care_email,
  CASE WHEN p.p_partkey % 6 = 4 THEN '9876543210' ELSE NULL END AS consumer_care_phone,
  CAST(NULL AS STRING) AS consumer_care_address,
  CASE p.p_partkey % 5 WHEN 0 THEN 'India' WHEN 1 THEN n.n_name ELSE NULL END AS country_of_origin,
  p.p_partkey % 6 = 0 AS is_imported,
  CASE p.p_partkey % 4 WHEN 0 THEN 'food' WHEN 1 THEN 'cosmetics' ELSE 'general' END AS category,
  CASE WHEN p.p_partkey % 3 = 0 THEN 'multi_unit' ELSE 'single_unit' END AS package_type
FROM part p
JOIN supplier s ON s.s_suppkey = p.p_partkey % 10
JOIN nation n ON n.n_nationkey = s.s_nationkey;

-- view: label_text
SELECT product_id, concat_ws(chr(10),
  product_name,
  'Manufactured by: ' || manufacturer_name || ', ' || manufacturer_address,
  'Packed by: ' || packer_name || ', ' || packer_address,
  'Net Qty: ' || net_quantity,
  'MRP ' || mrp,
  'Pkd: ' || date_declaration,
  'Consumer ' || consumer_care,
  'Country of Origin: ' || country_of_origin) AS raw_text
FROM product_input;

-- view: rule_results
SELECT l.l_orderkey AS scan_id, l.l_linenumber AS pos, l.l_partkey AS partkey, l.l_suppkey AS suppkey,
  CASE (l.l_partkey % 11) WHEN 0 THEN 'LMPC_RULE_6_1_A' WHEN 1 THEN 'LMPC_RULE_6_1_B' WHEN 2 THEN 'LMPC_RULE_6_1_C'
    WHEN 3 THEN 'LMPC_RULE_6_1_D' WHEN 4 THEN 'LMPC_RULE_6_1_DA_ORIGIN' WHEN 5 THEN 'LMPC_RULE_6_1_DA_IMPORTER'
    WHEN 6 THEN 'LMPC_RULE_6_1_E' WHEN 7 THEN 'LMPC_RULE_6_1_G' WHEN 8 THEN 'LMPC_RULE_6_1_F'
    WHEN 9 THEN 'LMPC_RULE_6_1_E_USP' ELSE 'LOCAL_RULE_X' END AS rule_id,
  concat('Declaration ', CAST(l.l_partkey % 11 AS STRING), ' (v', CAST(l.l_suppkey % 3 AS STRING), ')') AS declaration,
  CASE concat(l.l_returnflag, l.l_linestatus) WHEN 'RF' THEN 'FAIL' WHEN 'RO' THEN 'WARNING' WHEN 'NO' THEN 'PASS'
    WHEN 'NF' THEN 'PASS' WHEN 'AF' THEN 'NOT_APPLICABLE' ELSE 'REQUIRES_HUMAN_VERIFICATION' END AS status,
  CASE l.l_partkey % 3 WHEN 0 THEN 'HIGH' WHEN 1 THEN 'MEDIUM' ELSE 'LOW' END AS severity,
  CASE WHEN l.l_partkey % 4 = 0 THEN NULL ELSE l.l_quantity END AS pixel_text_height,
  CASE WHEN l.l_partkey % 4 = 0 AND l.l_suppkey % 2 = 0 THEN l.l_quantity ELSE NULL END AS text_height_pixels
FROM lineitem l;

-- view: scan_records
SELECT o.o_orderkey AS id,
  CASE WHEN o.o_custkey % 50 = 0 THEN NULL ELSE concat('Brand ', CAST(o.o_custkey % 50 AS STRING)) END AS product_name,
  CASE o.o_orderkey % 5 WHEN 0 THEN 'NON_COMPLIANT' WHEN 1 THEN 'POTENTIALLY_NON_COMPLIANT'
    WHEN 2 THEN 'PARTIAL_COMPLIANCE_NEEDS_REVIEW' ELSE 'COMPLIANT' END AS overall_status,
  CAST(o.o_orderkey % 1001 AS DOUBLE) / 10 AS compliance_score,
  CASE o.o_custkey % 4 WHEN 0 THEN NULL WHEN 1 THEN 'GENUINE_LIKELY' WHEN 2 THEN 'SUSPICIOUS' ELSE 'NO_REFERENCE_AVAILABLE' END AS verdict,
  CASE o.o_custkey % 4 WHEN 0 THEN NULL WHEN 3 THEN CAST(0 AS DOUBLE) ELSE CAST(o.o_orderkey % 100 AS DOUBLE) / 100 END AS similarity_score,
  o.o_orderkey % 10 AS officer_id,
  o.o_orderdate AS created_at
FROM orders o;

-- view: ocr_regions
SELECT l.l_orderkey AS image_id, concat('engine_', CAST(l.l_linenumber % 3 AS STRING)) AS engine,
  l.l_linenumber AS pos, l.l_partkey AS partkey, l.l_suppkey AS suppkey, p.p_name AS text,
  CAST(1 AS DOUBLE) - l.l_discount * 5 AS confidence,
  CAST(l.l_partkey % 4 AS DOUBLE) * 40 AS x0, CAST(l.l_suppkey % 5 AS DOUBLE) * 20 AS y0,
  CAST(l.l_partkey % 4 AS DOUBLE) * 40 + 30 + l.l_quantity AS x1,
  CAST(l.l_suppkey % 5 AS DOUBLE) * 20 + 4 + l.l_quantity / 2 AS y1,
  240 AS image_width, 140 AS image_height
FROM lineitem l JOIN part p ON p.p_partkey = l.l_partkey;

-- view: panel_fields
SELECT l.l_orderkey AS scan_id, l.l_linenumber % 3 AS panel,
  CASE l.l_partkey % 4 WHEN 0 THEN 'mrp' WHEN 1 THEN 'net_quantity' WHEN 2 THEN 'manufacturer_address' ELSE 'consumer_care' END AS field_name,
  max(p.p_name) AS value, max(CAST(1 AS DOUBLE) - l.l_discount) AS confidence
FROM lineitem l JOIN part p ON p.p_partkey = l.l_partkey
GROUP BY 1, 2, 3;

-- view: frames
SELECT user_id AS video_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS frame_index,
  ts, value AS sharpness
FROM events;

-- view: brand_reference
SELECT e.label AS brand_id, e.vec_id, e.embedding FROM embeddings e
JOIN (SELECT label, min(vec_id) AS v FROM embeddings WHERE label < 8 GROUP BY label) m ON m.v = e.vec_id;

-- view: brand_samples
SELECT vec_id AS sample_id, label AS brand_id, embedding FROM embeddings;

-- view: questions
SELECT conv_id * 1000 + turn AS q_id,
  concat(CASE conv_id % 6 WHEN 0 THEN 'What is the MRP rule ' WHEN 1 THEN 'How many total scans '
    WHEN 2 THEN 'violation rate for net quantity rule ' WHEN 3 THEN 'How to bake a cake '
    WHEN 4 THEN 'country of origin for imported goods ' ELSE '' END, coalesce(text, '')) AS text
FROM conversations WHERE role = 'user';

-- view: legal_documents
SELECT doc_id,
  CASE doc_id % 4 WHEN 0 THEN concat('2023.', CAST(1 + doc_id % 12 AS STRING), '.5 amendment_1732871791.pdf')
    WHEN 1 THEN concat('advisory_', CAST(doc_id AS STRING), '.pdf') WHEN 2 THEN '2022 garments_1733228786.pdf'
    ELSE concat('doc-', CAST(doc_id AS STRING), '.pdf') END AS filename,
  text
FROM documents;

-- view: noisy_labels
SELECT product_id,
  CASE product_id % 4 WHEN 1 THEN replace(t, '0', 'O') WHEN 2 THEN replace(t, '1', 'l') WHEN 3 THEN replace(t, '5', 'S') ELSE t END AS raw_text
FROM (SELECT product_id, replace(replace(replace(replace(replace(replace(replace(raw_text, 'Net Qty', 'Net Oty'), 'Pkd:', 'Pkcl:'),
    'Rs. ', CASE product_id % 3 WHEN 0 THEN 'R5 ' WHEN 1 THEN 'Rs' ELSE 'rs ' END), 'Consumer ', 'Cust Care '), 'Country of Origin', 'Cntry of Origin'),
    'Manufactured by', CASE product_id % 2 WHEN 0 THEN 'Mfd by' ELSE 'Manuf by' END), ' g', CASE product_id % 5 WHEN 0 THEN 'gms' WHEN 1 THEN ' grams' ELSE ' g' END) AS t
  FROM label_text) n;
