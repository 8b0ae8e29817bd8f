"""Views over the given tables in the shapes that the operators take.

Each is one SQL text that Spark and DuckDB read alike, so the queries and their oracles start from the same rows. In the
text, a table or another view stands in braces.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docfields.packaging import ship

ORD = "row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_shipdate, l_extendedprice)"

LABELS = ["Bid Validity (Days)", "Payment Terms", "Custom Rules", "Contract Period"]

#: Cells of pages with schedules: (line, column, text as SQL over k and c, pages that have it).
SCHEDULE_CELLS = (
    (0, 0, "'BUYER ' || CAST(c AS STRING)", "true"), (1, 0, "'Schedule ' || CAST(1 + k % 2 AS STRING)", "k % 3 <> 0"), (2, 0, "'12V battery set VRLA ( ' || CAST(c % 90 AS STRING) || ' pieces )'", "k % 2 = 0"), (3, 0, "': Battery Capacity'", "k % 4 <> 1"), (3, 1, "'100 Ah'", "k % 4 <> 1"), (3, 2, "'at C10'", "k % 8 = 0"),
    (4, 0, "'S.No'", "k % 5 <> 4"), (4, 1, "'Consignee Reporting/Officer'", "k % 5 <> 4"), (4, 2, "'Address'", "k % 5 <> 4"), (4, 3, "'Quantity'", "k % 5 <> 4"), (4, 4, "'Delivery Days'", "k % 5 < 3"),
    (5, 0, "'1'", "true"), (5, 1, "'A. Rao'", "true"), (5, 2, "'Unit ' || CAST(c % 7 AS STRING) || ', Pune'", "true"), (5, 3, "CAST(c % 60 AS STRING) || ' nos'", "true"), (5, 4, "'30 Days'", "k % 2 = 1"),
    (6, 0, "'2'", "k % 7 < 3"), (6, 1, "'B. Sen'", "k % 7 < 3"), (6, 2, "'Delhi'", "k % 7 < 2"), (7, 0, "'Total'", "k % 3 <> 1"), (7, 1, "CAST(c AS STRING)", "k % 3 <> 1"), (8, 0, "'3'", "true"), (8, 1, "'C. Das'", "true"), (8, 2, "'Goa'", "true"), (8, 3, "'n/a'", "true"),
    (9, 0, "'Inverter 5 kVA unit (7 nos)'", "k % 4 = 0"), (10, 0, "'OEM voltage'", "k % 3 = 0"), (10, 1, "'48 V'", "k % 3 = 0"),
)

#: Blocks of pages with tables of amounts: (x1, y1, text as SQL over k and c, pages that have it).
PART_CELLS = (
    (0, "10 + k % 7", "CASE k % 3 WHEN 0 THEN 'See 1.2 above' WHEN 1 THEN 'as in 2.3 of this' ELSE 'nothing of 12.3 here' END", "k % 4 <> 3"), (200, "10 + k % 7", "'or 2.1'", "k % 5 = 0"),
    (10, "54", "'Part ' || CAST(1 + k % 2 AS STRING)", "true"), (150, "51 + k % 9", "' value of works executed'", "k % 2 = 0"), (150, "51 + k % 9", "'working capital'", "k % 2 = 1"), (300, "57", "CAST(c % 90 AS STRING) || '.5 Lakh'", "true"), (10, "75", "'part-2 of'", "c % 3 <> 0"), (200, "75", "CAST(c % 9 AS STRING) || ' cr only'", "c % 4 <> 0"), (390, "104", "'half outside Part 1 & 2 at 9 Crore'", "true"),
    *((10, str(y), f"CASE c % 14 WHEN {n} THEN 'Line  of CREDIT from a bank counts' ELSE 'remark {n}' END", "true") for n, y in enumerate(range(118, 258, 10))),
    (10, "305", "'Part 1 & 2'", "k % 3 = 1"), (120, "303", "'Working and'", "true"), (200, "305", "'capital ' || CAST(c AS STRING) || ' Crore'", "true"), (10, "360", "'Bank  note'", "c % 2 = 0"),
)

#: Rows of forms: (y1, label, value, pages that have it); labels at the left, values at the right of a page.
FORM_ROWS = (
    (0, "'EMD Detail'", "CAST(c AS STRING)", "true"), (40, "'Bid Validty (Days)'", "CAST(c % 90 AS STRING)", "true"), (80, "'Payment Terms: ' || CAST(c % 30 AS STRING) || ' days'", "'as agreed'", "k % 2 = 0"), (120, "'Contract'", "'from '", "true"), (135, "'Period'", "CAST(c % 5 AS STRING) || ' years'", "k % 3 <> 0"),
    (200, "'The Contract Period/ ' || CAST(c AS STRING)", "'x: y'", "c % 2 = 0"), (240, "'unrelated'", "'Custom Rules - apply'", "true"), (280, "':'", "' '", "k % 5 = 0"), (320, "'payment trms'", "'Payment Term: none'", "c % 3 = 0"),
)

VIEWS = {
    "occurrences": f"""
        SELECT tender_id, ord, CASE ord % 3 WHEN 0 THEN 'tender_value' WHEN 1 THEN 'pbg_percentage' ELSE 'courier_address' END AS field_name,
               page, CAST(16 AS BIGINT) AS total_pages, conf_pct, ord AS schedule_number,
               CASE ord % 3
                 WHEN 0 THEN CASE p % 4 WHEN 0 THEN 'Rs. ' || n || '/-' WHEN 1 THEN n WHEN 2 THEN CAST(s % 100 AS STRING) || '.5 Lakh' ELSE 'Not Found' END
                 WHEN 1 THEN CAST(s % 11 AS STRING) || '.00%'
                 ELSE 'Cell ' || CAST(s AS STRING) || ', Block ' || CAST(p % 20 AS STRING) || ', City, ' || CAST(110000 + p AS STRING) END AS value_raw
        FROM (SELECT l_orderkey AS tender_id, CAST({ORD} AS BIGINT) AS ord, CAST(1 + (l_partkey + l_suppkey) % 16 AS BIGINT) AS page,
                     CAST(50 + 10 * (l_partkey % 5) AS BIGINT) AS conf_pct, CAST(CAST(floor(l_extendedprice) AS BIGINT) AS STRING) AS n, l_partkey AS p, l_suppkey AS s
              FROM {{lineitem}}) o""",
    "blocks": f"""
        SELECT CAST(floor(doc_id / 4) AS BIGINT) AS doc_id, CAST(1 + doc_id % 4 AS BIGINT) AS page_no, ord, x1, y1, x1 + 20 + q AS x2, y1 + 10 AS y2, r || ' ' || CAST(ord AS STRING) AS text,
               CAST(100 AS BIGINT) AS conf_pct, ord % 3 = 1 AS is_header, ord % 2 AS block_no, CAST(floor(y1 / 12) AS BIGINT) AS line_no
        FROM (SELECT l_orderkey AS doc_id, CAST({ORD} AS BIGINT) AS ord, CAST((l_partkey * 37) % 800 AS BIGINT) AS x1,
                     CAST((l_suppkey * 7 + l_partkey) % 60 AS BIGINT) AS y1, CAST(floor(l_quantity) AS BIGINT) AS q, l_returnflag AS r
              FROM {{lineitem}}) o""",
    "regions": """
        SELECT CAST(floor(o_orderkey / 4) AS BIGINT) AS doc_id, CAST(1 + o_orderkey % 4 AS BIGINT) AS page_no, CAST((o_custkey * 13) % 400 AS BIGINT) AS x1, CAST((o_custkey * 7) % 30 AS BIGINT) AS y1,
               CAST((o_custkey * 13) % 400 + 400 AS BIGINT) AS x2, CAST((o_custkey * 7) % 30 + 35 AS BIGINT) AS y2, CASE o_custkey % 2 WHEN 0 THEN 'table' ELSE 'paragraph' END AS region_type
        FROM {orders}""",
    "labels4": " UNION ALL ".join(f"SELECT CAST({k} AS BIGINT) AS k, '{name}' AS field_name" for k, name in enumerate(LABELS)),
    # a select a label: nothing is multiplied by a join
    "main_fields": " UNION ALL ".join(
        f"""
        SELECT o_orderkey AS doc_id, CAST({k} AS BIGINT) AS ord, '{name}' AS field_name, CASE (o_orderkey + {k}) % 3 WHEN 0 THEN 'Not Found' ELSE 'M' || CAST(o_custkey AS STRING) END AS value,
               CAST(60 + 10 * (o_custkey % 4) AS BIGINT) AS conf_pct, CAST(1 + o_custkey % 9 AS BIGINT) AS source_page
        FROM {{orders}} WHERE o_orderkey % 5 <> 0"""
        for k, name in enumerate(LABELS)
    ),
    "annexure_fields": " UNION ALL ".join(
        f"""
        SELECT o_orderkey AS doc_id, CAST({k} AS BIGINT) AS ord, '{name}' AS field_name, CASE (o_custkey + {k}) % 4 WHEN 0 THEN NULL WHEN 1 THEN '0' ELSE 'A' || CAST(o_custkey AS STRING) END AS value,
               CAST(50 + 10 * (o_orderkey % 5) AS BIGINT) AS conf_pct, CAST(1 + o_orderkey % 9 AS BIGINT) AS source_page
        FROM {{orders}}"""
        for k, name in enumerate(LABELS)
    ),
    "info_records": """
        SELECT k AS doc_id, CASE k % 4 WHEN 0 THEN '5.00%' WHEN 1 THEN 'NA' WHEN 2 THEN 'No' END AS pbg_percentage, CASE c % 3 WHEN 0 THEN 'Yes' WHEN 1 THEN 'No' END AS pbg_required, CASE c % 5 WHEN 0 THEN 'NA' ELSE CAST(c % 40 AS STRING) || ' months' END AS pbg_duration,
          CASE c % 4 WHEN 0 THEN '0%' WHEN 1 THEN '3.00%' WHEN 2 THEN '' END AS sd_percentage, CASE k % 3 WHEN 0 THEN 'DD' WHEN 1 THEN 'N/A' END AS sd_mode, CASE k % 5 WHEN 0 THEN '12 months' END AS sd_duration, 'Yes' AS sd_required,
          CASE k % 9 WHEN 0 THEN 'Not Applicable' WHEN 1 THEN 'OEM' ELSE 'Bidder' END AS avg_annual_turnover_type, CASE c % 6 WHEN 0 THEN '₹0.00' WHEN 1 THEN 'Not applicable' WHEN 2 THEN NULL ELSE CAST(c AS STRING) || ' Lakh' END AS avg_annual_turnover_value,
          CASE c % 7 WHEN 0 THEN 'exempted' ELSE 'Bidder' END AS net_worth_type, CASE k % 2 WHEN 0 THEN 'Not Found' ELSE '1 Crore' END AS net_worth_value, CASE k % 3 WHEN 0 THEN 'Not Applicable' WHEN 1 THEN '60 Days' END AS delivery_time_installation,
          CASE c % 3 WHEN 0 THEN '30 Days' WHEN 1 THEN '⚠️ MISSING' END AS delivery_time_supply, CASE c % 4 WHEN 0 THEN 'Rejected' WHEN 1 THEN 'Pass' END AS te_recommendation, CASE k % 2 WHEN 0 THEN 'late' END AS te_rejection_reason,
          CASE c % 5 WHEN 0 THEN 'No pre-bid meeting' WHEN 1 THEN '12-04-2025 11:00' WHEN 2 THEN 'NA' WHEN 3 THEN '⚠️ MISSING' END AS pre_bid_meeting, CASE k % 3 WHEN 0 THEN 'Not Required' WHEN 1 THEN 'Yes' END AS physical_docs_required, CASE c % 2 WHEN 0 THEN '14-04-2025' END AS physical_docs_deadline,
          'A. Rao' AS client_name_1, CASE c % 3 WHEN 0 THEN 'N/A' WHEN 1 THEN 'B. Sen' END AS client_name_2, CASE c % 2 WHEN 0 THEN 'b@x.org' END AS client_email_2, CASE k % 4 WHEN 0 THEN '2 pieces' WHEN 1 THEN 'NA' END AS schedule_2_details,
          CASE c % 4 WHEN 0 THEN 'ISO certificate' WHEN 1 THEN 'Cancelled cheque' WHEN 2 THEN 'NA' END AS doc_1, CASE c % 3 WHEN 0 THEN 'GST and PAN' WHEN 1 THEN 'ISO certificate' END AS doc_2, CASE k % 5 WHEN 0 THEN 'OEM approval' END AS doc_3, CASE k % 2 WHEN 0 THEN 'Turnover statement' END AS doc_4,
          CASE c % 3 WHEN 0 THEN '₹' || CAST(c AS STRING) || '.00' END AS emd_amount, CASE c % 2 WHEN 0 THEN 'DD' END AS emd_mode, CASE c % 4 WHEN 0 THEN 'NA' WHEN 1 THEN '7' WHEN 2 THEN '3' END AS experience_years, CASE k % 4 WHEN 0 THEN '₹0.00' WHEN 1 THEN '25 Lakh' END AS order_value_1,
          CASE k % 3 WHEN 0 THEN 'Yes' WHEN 1 THEN 'Yes — Project Specific' ELSE 'No' END AS maf_required, CASE c % 5 WHEN 0 THEN 'Yes' END AS mii_preference, CASE k % 4 WHEN 0 THEN 'True' WHEN 1 THEN 'No' END AS reverse_auction_applicable, CASE c % 2 WHEN 0 THEN '12-05-2025' END AS bid_due,
          CASE c % 2 WHEN 0 THEN '1% per week' END AS ld_percentage, CASE k % 2 WHEN 0 THEN '10%' END AS max_ld_percentage,
          CASE k % 7 WHEN 0 THEN 'A mandatory  site visit.' WHEN 1 THEN 'Bidder shall be deemed to have visited the work sites' WHEN 2 THEN 'Site Visit as wished; buy back' WHEN 3 THEN 'Two packet bid, Local Content' WHEN 4 THEN 'Buyback within 2 days' WHEN 5 THEN '' END AS text
        FROM (SELECT o_orderkey AS k, o_custkey AS c FROM {orders}) o""",
    "review_events": """
        SELECT k AS doc_id, 'Payment Terms' AS field_name, 'edit' AS action, 'first' AS value, 'ann' AS reviewer, CAST(c % 10 AS BIGINT) AS ts, CAST(1 AS BIGINT) AS event_id FROM (SELECT o_orderkey AS k, o_custkey AS c FROM {orders}) o WHERE k % 2 = 0
        UNION ALL SELECT k, 'Payment Terms', 'edit', CASE k % 8 WHEN 0 THEN NULL ELSE 'second' END, 'bob', CAST(k % 10 AS BIGINT), CAST(2 AS BIGINT) FROM (SELECT o_orderkey AS k FROM {orders}) o WHERE k % 4 = 0
        UNION ALL SELECT k, CASE k % 3 WHEN 0 THEN 'Payment Terms' WHEN 1 THEN 'Custom Rules' ELSE 'unknown' END, 'verify', NULL, 'cy', CAST(k % 7 AS BIGINT), CAST(3 AS BIGINT) FROM (SELECT o_orderkey AS k FROM {orders}) o
        UNION ALL SELECT k, NULL, 'complete', NULL, 'dan', CAST(k % 6 AS BIGINT), CAST(4 AS BIGINT) FROM (SELECT o_orderkey AS k FROM {orders}) o WHERE k % 3 <> 2""",
    # clauses, contacts and names of documents among words that have nothing to do with them
    "narratives": """
        SELECT k AS doc_id, 'General remarks on the work. ' || CASE k % 5 WHEN 0 THEN 'Payment terms: 80% shall be released on delivery of goods and 20 % after installation. ' WHEN 1 THEN '100% payment within thirty days. ' WHEN 2 THEN 'Payments as per Annexure-II.pdf! '
            WHEN 3 THEN 'No advance. ' ELSE 'Payment shall be ' || CAST(c % 100 AS STRING) || ' % of it against supply at site. ' END
          || CASE c % 4 WHEN 0 THEN 'Liquidated damages at 0.5% of the contract value per week or part thereof, maximum of 10 %, see clause 12.' || CAST(c % 9 AS STRING) || '. ' WHEN 1 THEN 'LD: 1 % weekly capped at 5%. ' WHEN 2 THEN 'Delay is subject to a maximum of 7%. ' ELSE '' END || repeat('filler text of no use, ', CAST(k % 30 AS INT))
          || CASE c % 5 WHEN 0 THEN 'Experience: seven years, PSU experience wanted. One similar work of 80% of the estimated bid value or two similar works costing 50 % of estimated value or three works, Rs. 25.5 lakh each. ' WHEN 1 THEN 'similar nature of work for ' || CAST(c % 12 AS STRING) || ' years, foreign experience counts. ' ELSE '' END
          || CASE k % 6 WHEN 0 THEN 'Annual turnover of bidder and OEM: 30% of estimated bid value. ' WHEN 1 THEN 'AATO of the OEM Rs. 45 Lakh. ' WHEN 2 THEN 'average annual turnover: INR 12,00,000. ' ELSE '' END || CASE c % 3 WHEN 0 THEN 'Working capital 10 % of the contract value. Solvency certificate for Rs 5 crore. ' WHEN 1 THEN 'Positive net worth, Rs.7 Lakh. ' ELSE '' END
          || repeat('more words, ', CAST(c % 50 AS INT)) || CASE k % 4 WHEN 0 THEN 'Security deposit of 5% for 12 months shall be deposited. ' WHEN 1 THEN 'ePBG in lieu of security deposit. ' WHEN 2 THEN 'SD not required. ' ELSE '' END
          || CASE c % 4 WHEN 0 THEN 'Hard copy with original bank instrument within 7 days by courier. ' WHEN 1 THEN 'Postal address on 12/04/2025. ' ELSE '' END || chr(10)
          || CASE k % 4 WHEN 0 THEN 'Contact Person: Mr. Arun Rao, Phone: 0112345' || CAST(100 + c % 900 AS STRING) || ', email: arun' || CAST(c % 7 AS STRING) || '@x.org' || chr(10) || 'Nodal Officer: Dr. Meera Sen Extn: 12-345, Delhi 110001' || chr(10) WHEN 1 THEN 'Consignee / Reporting Officer : Ravi Kumar, PIN 110' || CAST(100 + c % 900 AS STRING) || chr(10) || 'contact ARUN RAO' || chr(10) WHEN 2 THEN 'Contact: Mr Ravi Kumar' || chr(10) || 'Consignee: RAVI' || chr(10) || 'Nodal Officer: ravi kumar, ravi.k@y.co.in' || chr(10) ELSE '' END
          || CASE c % 3 WHEN 0 THEN 'Name of Competent Authority: Narasingha Rao' || chr(10) || 'Designation of Competent Authority: CM' || chr(10) ELSE '' END
          || CASE k % 3 WHEN 0 THEN 'See BOQ_1 and corrigendum 2. Then annexure-ii.PDF again? Volume III.' WHEN 1 THEN 'The BOQ is here. Schedule 4 holds.' ELSE '' END AS text
        FROM (SELECT o_orderkey AS k, o_custkey AS c FROM {orders}) o""",
    # sections in sections, with references between them; some texts have no heading, a heading at once or the same one again
    "sectioned": """
        SELECT k AS doc_id, CASE k % 6 WHEN 0 THEN '' ELSE 'Notice of tender ' || CAST(c AS STRING) || ', security deposit of 9%.' || chr(10) END
          || CASE WHEN k % 17 = 0 THEN '' ELSE 'SECTION-I Instructions' || chr(10) || '1. Scope of ' || CAST(c % 9 AS STRING) || ' works' || chr(10) || '1.1 Delivery in ' || CAST(c % 50 AS STRING) || ' days' || chr(10) || CASE c % 3 WHEN 0 THEN '1.1.1 Security Deposit: see below' || chr(10) ELSE '' END
          || '2. Payment' || chr(10) || CASE c % 4 WHEN 0 THEN 'as per Section II' WHEN 1 THEN CAST(10 + c % 80 AS STRING) || '% on supply' WHEN 2 THEN 'as per Annexure-B' ELSE 'by agreement' END || chr(10)
          || CASE k % 4 WHEN 0 THEN 'section II Special terms' || chr(10) || '3.2.1 Advance of ' || CAST(c % 30 AS STRING) || '%' || chr(10) || 'then 7 % later' || chr(10) WHEN 1 THEN 'SECTION 2' || chr(10) || 'nothing' || chr(10) ELSE '' END
          || 'CLAUSE No. 38 Security Deposit' || chr(10) || CASE c % 5 WHEN 0 THEN 'as agreed.' ELSE CAST(1 + c % 9 AS STRING) || '% of value.' END || chr(10)
          || CASE k % 3 WHEN 0 THEN 'Annexure B forms' || chr(10) || '  4 Payment of ' || CAST(c % 20 AS STRING) || '% at once' || chr(10) WHEN 1 THEN 'ANNEXURE-B' || chr(10) ELSE '' END || CASE k % 5 WHEN 0 THEN 'SECTION-I again' || chr(10) || '5' ELSE 'end' END END AS text
        FROM (SELECT o_orderkey AS k, o_custkey AS c FROM {orders}) o""",
    "schedule_blocks": " UNION ALL ".join(
        f"SELECT CAST(floor(k / 2) AS BIGINT) AS doc_id, CAST(1 + k % 2 AS BIGINT) AS page_no, CAST({line * 10 + column} AS BIGINT) AS ord, CAST({column * 150} AS BIGINT) AS x1, CAST({line * 30} + (k + {column}) % 5 AS BIGINT) AS y1, {text} AS text FROM (SELECT o_orderkey AS k, o_custkey AS c FROM {{orders}}) o WHERE {where}"
        for line, column, text, where in SCHEDULE_CELLS
    ),
    "form_blocks": " UNION ALL ".join(
        f"SELECT CAST(floor(k / 2) AS BIGINT) AS doc_id, CAST(1 + k % 2 AS BIGINT) AS page_no, CAST({2 * n + right} AS BIGINT) AS ord, CAST({400 * right} + k % 4 AS BIGINT) AS x1, CAST({y} + (c + {n}) % 7 AS BIGINT) AS y1, CAST({400 * right} + 300 AS BIGINT) AS x2, CAST({y} + 10 AS BIGINT) AS y2, CAST(60 + (c + {n}) % 40 AS BIGINT) AS conf_pct, {text} AS text FROM (SELECT o_orderkey AS k, o_custkey AS c FROM {{orders}}) o WHERE {where}"
        for n, (y, label, value, where) in enumerate(FORM_ROWS) for right, text in ((0, label), (1, value))
    ),
    "part_blocks": " UNION ALL ".join(
        f"SELECT CAST(floor(k / 2) AS BIGINT) AS doc_id, CAST(1 + k % 2 AS BIGINT) AS page_no, CAST({n} AS BIGINT) AS ord, CAST({x} AS BIGINT) AS x1, CAST({y} AS BIGINT) AS y1, CAST({x} + 60 AS BIGINT) AS x2, CAST({y} + 8 AS BIGINT) AS y2, {text} AS text FROM (SELECT o_orderkey AS k, o_custkey AS c FROM {{orders}}) o WHERE {where}"
        for n, (x, y, text, where) in enumerate(PART_CELLS)
    ),
    "part_tables": " UNION ALL ".join(
        f"SELECT CAST(floor(o_orderkey / 2) AS BIGINT) AS doc_id, CAST(1 + o_orderkey % 2 AS BIGINT) AS page_no, CAST({n} AS BIGINT) AS ord, CAST(0 AS BIGINT) AS x1, CAST({top} AS BIGINT) AS y1, CAST(400 AS BIGINT) AS x2, CAST({end} AS BIGINT) AS y2 FROM {{orders}}" for n, top, end in ((0, 50, 112), (1, 300, 340))
    ),
    # lines of many kinds, so that rules meet values of other rules
    "tender_lines": """
        SELECT CAST(floor(k / 8) AS BIGINT) AS doc_id, CAST(1 + floor(k / 4) % 2 AS BIGINT) AS page_no, CAST(1 + k % 4 AS BIGINT) AS ord, CASE CAST(floor(k / 4) AS BIGINT) * 3 % 29 + k % 2
            WHEN 0 THEN 'Bid End Date/Time 12-04-20' || CAST(10 + c % 20 AS STRING) || ' 14:00:00 hrs' WHEN 1 THEN ' EMD Amount Rs. 1,50,000/- only' WHEN 2 THEN 'INR ' || CAST(c AS STRING) WHEN 3 THEN 'EMD ' || CAST(c % 30 AS STRING) || '.5 Lakh by DD'
            WHEN 4 THEN CAST(c AS STRING) WHEN 5 THEN 'Tender fee: Nil' WHEN 6 THEN 'Fee exempted for MSE, else Rs 500' WHEN 7 THEN 'Bid No. GEM/2025/B/' || CAST(6000000 + c AS STRING) || ' dated 01-02-2025'
            WHEN 8 THEN 'NIT No: AB-' || CAST(c AS STRING) || '/X' WHEN 9 THEN 'PQR/EL/2024/' || CAST(c AS STRING) WHEN 10 THEN CAST(c % 200 AS STRING) || ' days validity' WHEN 11 THEN 'within two weeks of order'
            WHEN 12 THEN 'Experience of ' || CAST(c % 12 AS STRING) || ' years required' WHEN 13 THEN 'Yes' WHEN 14 THEN 'MII: Not required' WHEN 15 THEN 'PBG ' || CAST(c % 150 AS STRING) || '.5 %' WHEN 16 THEN 'ePBG Percentage(%): ' || CAST(c % 12 AS STRING) || '.00'
            WHEN 17 THEN 'Ministry of Power' WHEN 18 THEN 'Name/Department Of Defence Production' WHEN 19 THEN 'Office of CE / Pune' WHEN 20 THEN 'Bid Document' WHEN 21 THEN 'ab' WHEN 22 THEN ''
            WHEN 23 THEN 'Supply of ' || CAST(c AS STRING) || ' Nos battery set, Make: Exide Industries' WHEN 24 THEN 'Online UPS 3 units with switch and mcb' WHEN 25 THEN 'AMC of split AC, 2 years, annual maintenance'
            WHEN 26 THEN 'LT cable 300 m brand: Polycab & Co' WHEN 27 THEN 'Erection and commissioning of upset rooms' WHEN 28 THEN 'turnover of 25 Lakh in 31-03-2024'
            ELSE 'contact a.b' || CAST(c AS STRING) || '@mail.example.org or 10/2024-25/77' END AS text
        FROM (SELECT o_orderkey AS k, o_custkey AS c FROM {orders}) o""",
    "job_events": """
        SELECT user_id AS job_id, ts, event_id, CASE event_type WHEN 'signup' THEN 'pending' WHEN 'view' THEN 'processing' WHEN 'purchase' THEN 'completed'
               WHEN 'error' THEN 'failed' ELSE 'edited' END AS state, props
        FROM {events}""",
    "threads": "SELECT conv_id AS doc_id, turn + 1 AS page, text FROM {conversations}",
    "corrections": """
        SELECT role AS field_key, text AS anchor_text, CAST(length(text) AS STRING) AS value, turn AS ts, conv_id,
               CAST(CASE role WHEN 'user' THEN 99 ELSE 90 END AS BIGINT) AS conf_pct
        FROM {conversations}""",
    "gold": """
        SELECT doc_id, 'quality' AS field_name, CAST(quality AS STRING) AS expected FROM {labels} UNION ALL SELECT doc_id, 'toxic', CAST(toxic AS STRING) FROM {labels}""",
    "predictions": """
        SELECT doc_id, 'quality' AS field_name, CASE WHEN n_chars >= 2000 THEN '1' ELSE '0' END AS value FROM {documents} WHERE lang <> 'es'
        UNION ALL SELECT doc_id, 'toxic', '0' FROM {documents} WHERE lang <> 'es'""",
    "workspace": """
        SELECT o_orderkey AS id, c_name AS title, c_mktsegment AS authority, o_orderpriority AS department, n_name AS city, r_name AS state,
               o_totalprice AS tender_value, CAST(floor(o_totalprice * 0.02) AS BIGINT) AS emd, CAST(o_orderdate AS DATE) AS deadline,
               CASE o_orderstatus WHEN 'P' THEN 'processing' ELSE 'completed' END AS parse_status,
               CASE o_orderstatus WHEN 'F' THEN 'completed' ELSE 'unreviewed' END AS review_status, CAST(50 + o_custkey % 50 AS BIGINT) AS parse_confidence
        FROM {orders} JOIN {customer} ON o_custkey = c_custkey JOIN {nation} ON c_nationkey = n_nationkey JOIN {region} ON n_regionkey = r_regionkey""",
    "clause_docs": """
        SELECT o_orderkey AS doc_id,
          'BID DETAILS' || chr(10) || 'Total Quantity: ' || CAST(o_custkey % 100 AS STRING) || chr(10) || 'TERMS OF PAYMENT' || chr(10)
          || CAST(50 + 10 * (o_orderkey % 5) AS STRING) || '% of supply value on receipt and balance ' || CAST(50 - 10 * (o_orderkey % 5) AS STRING) || '% on installation.' || chr(10)
          || CASE WHEN o_orderkey % 11 = 0 THEN 'PRICE REDUCTION SCHEDULE as per SECTION-III.'
                  ELSE 'PRICE REDUCTION SCHEDULE ' || CASE o_orderkey % 3 WHEN 0 THEN '1/2' WHEN 1 THEN '0.5' ELSE '1' END || '% per complete week, maximum of ' || CAST(5 + o_custkey % 6 AS STRING) || '%.' END || chr(10)
          || 'SECTION-II experience in past ' || CASE o_custkey % 4 WHEN 0 THEN 'seven' WHEN 1 THEN '3' WHEN 2 THEN 'five' ELSE '10' END || ' years. Net Worth: '
          || CASE WHEN o_orderkey % 7 = 0 THEN 'financial criteria not applicable' ELSE 'Rs. ' || CAST(o_custkey % 90 + 1 AS STRING) || CASE o_custkey % 2 WHEN 0 THEN ' Lakh' ELSE ' Crore' END END || chr(10)
          || 'Delivery Period: ' || CAST(1 + o_orderkey % 12 AS STRING) || CASE o_custkey % 3 WHEN 0 THEN ' months' WHEN 1 THEN ' weeks' ELSE ' days' END || chr(10)
          || 'Mode: ' || CASE o_orderkey % 4 WHEN 0 THEN 'Demand Draft or Bank Guarantee' WHEN 1 THEN 'NEFT, FDR' WHEN 2 THEN 'insurance surety bond' ELSE 'cash' END || chr(10)
          || 'Contact Person: Officer ' || chr(CAST(65 + o_custkey % 26 AS INT)) || ', Phone: 0' || CAST(1000000 + o_custkey AS STRING) || ', email: officer' || CAST(o_custkey % 500 AS STRING)
          || '@example.org, Block ' || CAST(o_custkey % 40 AS STRING) || ', City ' || CAST(110000 + o_custkey % 900 AS STRING) || chr(10)
          || 'Refer Annexure-' || CASE o_custkey % 3 WHEN 0 THEN 'I' WHEN 1 THEN 'II' ELSE 'III' END || ' and BOQ.' AS text
        FROM {orders}""",
}

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{folder}/{name}.parquet")


#: Views over one table by the column whose rows a page or document keeps together: (table, key, how many key values share a document).
#: The narrow rows are dealt out by document once, before texts and blocks are made of them; windows, groups and joins by document or page then find them where they are.
DEALT = {
    "blocks": ("lineitem", "l_orderkey", 4), "main_fields": ("orders", "o_orderkey", 1), "narratives": ("orders", "o_orderkey", 1), "sectioned": ("orders", "o_orderkey", 1), "clause_docs": ("orders", "o_orderkey", 1),
    "schedule_blocks": ("orders", "o_orderkey", 2), "form_blocks": ("orders", "o_orderkey", 2), "part_blocks": ("orders", "o_orderkey", 2), "part_tables": ("orders", "o_orderkey", 2), "tender_lines": ("orders", "o_orderkey", 8),
}
#: Rows of the table that a partition takes, about: so partitions grow in number with the input and not in size.
DEALT_ROWS = {"lineitem": 50_000, "orders": 5_000}


def dealt(df: DataFrame, name: str, key: str, share: int) -> DataFrame:
    """The rows of the table with ``document``, in partitions by it; at least as many as shuffles have."""
    parts = max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-df.count() // DEALT_ROWS[name]))
    return df.withColumn("document", (F.floor(F.col(key) / share) if share > 1 else F.col(key)).cast("long")).repartition(parts, "document")


def _at_once(text: str) -> str:
    """A view that is a union of selects over the same table, as one pass over it: each row is read once and makes its rows."""
    parts = [re.fullmatch(r"\s*SELECT (.*) FROM (\(SELECT o_orderkey AS k, o_custkey AS c FROM \{orders\}\) o|\{orders\})(?: WHERE (.*))?", p, re.S) for p in text.split(" UNION ALL ")]
    rows = []
    for part in parts:
        columns = [re.fullmatch(r"(.*) AS (\w+)", c.strip(), re.S) for c in _columns(part[1])]
        names = [c[2] for c in columns[1:]]
        rows.append(f"CASE WHEN {part[3] or 'true'} THEN named_struct({', '.join(f"'{c[2]}', {c[1]}" for c in columns[1:])}) END")
    source = "(SELECT document, o_orderkey AS k, o_custkey AS c, o_orderkey, o_custkey FROM {orders}) o"
    return f"SELECT document AS doc_id, {', '.join(names)} FROM (SELECT document, inline(filter(array({', '.join(rows)}), x -> x IS NOT NULL)) FROM {source})"


def _columns(text: str) -> list[str]:
    """A select's columns: cut at the commas outside brackets and quotes."""
    out, depth, quoted = [""], 0, False
    for ch in text:
        quoted ^= ch == "'"
        depth += 0 if quoted else (ch == "(") - (ch == ")")
        if ch == "," and not depth and not quoted:
            out.append("")
        else:
            out[-1] += ch
    return out


def _dealt_text(name: str) -> str:
    """The view's text over a table that has ``document``: the same rows, its document taken from there."""
    text = VIEWS[name]
    if " UNION ALL " in text:
        return _at_once(text)
    if name == "blocks":
        text = text.replace("CAST(floor(doc_id / 4) AS BIGINT) AS doc_id", "document AS doc_id").replace("SELECT l_orderkey AS doc_id", "SELECT document, l_orderkey AS doc_id")
        return text.replace("PARTITION BY l_orderkey", "PARTITION BY document, l_orderkey")
    if name == "tender_lines":
        return text.replace("CAST(floor(k / 8) AS BIGINT) AS doc_id", "document AS doc_id").replace("SELECT o_orderkey AS k", "SELECT document, o_orderkey AS k")
    return text.replace("SELECT o_orderkey AS k,", "SELECT document AS k,").replace("SELECT o_orderkey AS doc_id", "SELECT document AS doc_id")


def view(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A table of the folder, or a view over its tables."""
    if name in TABLES:
        return table(spark, folder, name)
    text = _dealt_text(name) if name in DEALT else VIEWS[name]
    sources = {x: view(spark, folder, x) for x in re.findall(r"\{([a-z]\w*)\}", text)}
    if name in DEALT:
        of, key, share = DEALT[name]
        sources[of] = dealt(sources[of], of, key, share)
    return spark.sql(text, **sources)


def with_views(sql: str) -> str:
    """Oracle SQL in which {name} stands for a table or view -> plain SQL with the views it needs."""
    needed: dict[str, str] = {}

    def take(text: str) -> str:
        for x in re.findall(r"\{([a-z]\w*)\}", text):
            if x in VIEWS and x not in needed:
                own = take(VIEWS[x])
                needed[x] = own
        return re.sub(r"\{([a-z]\w*)\}", r"\1", text)

    body = take(sql).strip()
    if not needed:
        return body
    views = ", ".join(f"{x} AS ({text})" for x, text in needed.items())
    if body[:14].upper() == "WITH RECURSIVE":
        return f"WITH RECURSIVE {views}, {body[14:]}"
    return f"WITH {views}, {body[4:]}" if body[:4].upper() == "WITH" else f"WITH {views} {body}"
