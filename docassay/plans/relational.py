"""Filters, joins, aggregations, windows, sorts and set operations over the document tables.

Names follow the operator inventory. Each plan reads whole tables; limits appear only where a page or
a top-k is the operator.
"""

from __future__ import annotations

from .portable import plan, split

P: dict[str, tuple] = {}

# ---- filters and predicates -------------------------------------------------------------------
P["fil1_visibility"] = plan("""
  SELECT d.doc_id, d.source, m.site FROM documents d LEFT JOIN {META} m ON m.doc_id = d.doc_id
  WHERE d.source = 'review_notes' OR m.originator = 'Harlan Works' OR m.site = 'HOU'""")
P["fil2_point_access"] = plan("""
  SELECT m.doc_id, (m.site IN ('HOU', 'DEN') OR m.originator = 'Harlan Works') AS readable FROM {META} m""")
P["fil3_optional_equality"] = plan("""
  SELECT doc_id, project_no, doc_type FROM documents WHERE source = 'vendor_upload' AND project_no IS NOT NULL""")
P["fil4_report_filter"] = plan("""
  SELECT issue_id, severity FROM {ISSUES} i WHERE included AND severity NOT IN ('MINOR', 'INFO')""")
P["fil5_export_filter"] = plan("""
  SELECT issue_id, category, type, severity FROM {ISSUES} i
  WHERE included AND type <> 'STANDARD_NOT_IN_BIBLIOGRAPHY' AND NOT (category IN ('GRAMMAR', 'SPELLING', 'LINGUISTIC') OR type IN ('REPEATED_WORD', 'grammar_error'))
    AND severity NOT IN ('MINOR', 'INFO')""")
P["fil6_header_footer_suppression"] = plan("""
  SELECT item_id, doc_id, page_index FROM {SPANS} s WHERE page_height <= 0 OR NOT (y1 <= page_height * 0.08 OR y0 >= page_height * 0.92)""")
P["fil7_boilerplate_suppression"] = plan(
    r"SELECT page_id, footer_text FROM {PAGES} p WHERE footer_text IS NOT NULL AND NOT regexp_matches(lower(trim(footer_text)), '^page\s+[0-9]+(\s+of\s+[0-9]+)?$') AND lower(trim(footer_text)) NOT IN ('confidential', 'printed copies are uncontrolled', 'uncontrolled when printed')",
    r"SELECT page_id, footer_text FROM {PAGES} p WHERE footer_text IS NOT NULL AND NOT lower(trim(footer_text)) RLIKE '^page\\s+[0-9]+(\\s+of\\s+[0-9]+)?$' AND lower(trim(footer_text)) NOT IN ('confidential', 'printed copies are uncontrolled', 'uncontrolled when printed')",
)
P["fil8_cover_page"] = plan("SELECT item_id, doc_id, y0, x0 FROM {SPANS} s WHERE page_index = 0")
P["fil9_expired"] = plan("""
  SELECT doc_id, created_at FROM documents WHERE created_at < (SELECT max(created_at) FROM documents) - INTERVAL 90 DAY""")
# the newest of each text by an aggregate: equal and empty texts are added up before the shuffle
P["fil10_active_newest"] = plan(
    "SELECT md5(text) AS text_key, arg_max(doc_id, struct_pack(a := created_at, b := doc_id)) AS doc_id FROM documents WHERE text IS NOT NULL AND lang IS NOT NULL GROUP BY md5(text)",
    "SELECT md5(text) AS text_key, max_by(doc_id, struct(created_at, doc_id)) AS doc_id FROM documents WHERE text IS NOT NULL AND lang IS NOT NULL GROUP BY md5(text)",
)
P["fil11_term_match"] = plan("SELECT rule_no, title FROM rules WHERE title ILIKE 'limit for shell%'")
P["fil12_fold_equality"] = plan("SELECT doc_id, lang FROM documents WHERE lower(lang) = lower('EN')")
P["fil13_role_predicates"] = plan("""
  SELECT c_custkey, (c_acctbal > 0 AND c_mktsegment IN ('MACHINERY', 'BUILDING')) AS can_review, (c_acctbal > 5000 OR c_nationkey = 3) AS can_finalize FROM customer""")
P["fil14_multi_field_search"] = plan("""
  SELECT doc_id FROM {META} m WHERE lower(coalesce(title, '') || ' ' || coalesce(doc_no, '') || ' ' || coalesce(project_no, '')) LIKE '%inspection%' AND originator IS NOT NULL""")
P["fil15_issue_panel"] = plan("""
  SELECT issue_id FROM {ISSUES} i WHERE category <> 'SYSTEM' AND severity IN ('BLOCKER', 'CRITICAL', 'MAJOR') AND included
    AND lower(type || ' ' || coalesce(message, '') || ' ' || coalesce(CAST(page_number AS VARCHAR(12)), '')) LIKE '%page%'""",
    """SELECT issue_id FROM {ISSUES} i WHERE category <> 'SYSTEM' AND severity IN ('BLOCKER', 'CRITICAL', 'MAJOR') AND included
    AND lower(type || ' ' || coalesce(message, '') || ' ' || coalesce(CAST(page_number AS STRING), '')) LIKE '%page%'""")  # fmt: skip
P["fil16_catalog_scope"] = plan("SELECT doc_id, title FROM {META} m WHERE lower(title) LIKE '%repair%' AND project_no LIKE '13-%'")
P["fil17_filename_search"] = plan("SELECT doc_id, filename FROM {META} m WHERE lower(filename) LIKE '%pip%'")
P["fil18_upload_checks"] = plan("""
  SELECT doc_id, CASE WHEN filename IS NULL OR filename = '' THEN 'NO_NAME' WHEN lower(filename) NOT LIKE '%.pdf' AND lower(filename) NOT LIKE '%.docx' THEN 'TYPE'
    WHEN page_count IS NULL OR page_count < 1 THEN 'EMPTY' WHEN filename LIKE '%/%' OR filename LIKE '%..%' THEN 'PATH' ELSE 'OK' END AS reject_code FROM {META} m""")
P["fil19_traceability"] = plan("SELECT issue_id, type FROM {ISSUES} i WHERE category IN ('TRACEABILITY', 'STANDARD_TRACEABILITY')")

# ---- joins ------------------------------------------------------------------------------------
P["jon1_left_outer"] = plan("SELECT d.doc_id, m.site FROM documents d LEFT JOIN {META} m ON m.doc_id = d.doc_id")
P["jon2_join_chain"] = plan("""
  SELECT i.issue_id, d.project_no, m.site FROM {ISSUES} i JOIN documents d ON d.doc_id = i.doc_id LEFT JOIN {META} m ON m.doc_id = d.doc_id""")
P["jon3_semi"] = plan("""
  SELECT d.doc_id FROM documents d WHERE EXISTS (SELECT 1 FROM issues i WHERE i.doc_id = d.doc_id AND i.included_in_report AND i.severity IN ('BLOCKER', 'CRITICAL', 'HIGH'))""")
P["jon3_anti"] = plan("""
  SELECT d.doc_id FROM documents d WHERE NOT EXISTS (SELECT 1 FROM issues i WHERE i.doc_id = d.doc_id AND i.included_in_report AND i.severity IN ('BLOCKER', 'CRITICAL', 'HIGH'))""")
P["jon4_group_count"] = plan("""
  SELECT s.site, count(m.doc_id) AS documents FROM sites s LEFT JOIN {META} m ON m.site = s.site GROUP BY s.site""")
P["jon5_two_fan_outs"] = plan("""
  SELECT c.c_nationkey, coalesce(o.orders, 0) AS orders, coalesce(s.suppliers, 0) AS suppliers FROM (SELECT DISTINCT c_nationkey FROM customer) c
  LEFT JOIN (SELECT c_nationkey, count(DISTINCT o_orderkey) AS orders FROM customer JOIN orders ON o_custkey = c_custkey GROUP BY c_nationkey) o ON o.c_nationkey = c.c_nationkey
  LEFT JOIN (SELECT s_nationkey, count(DISTINCT s_suppkey) AS suppliers FROM supplier GROUP BY s_nationkey) s ON s.s_nationkey = c.c_nationkey""")
P["jon6_outer_group"] = plan("SELECT c_custkey, count(o_orderkey) AS orders FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey")
# children of one document, not of a project: a project may hold a large part of all documents
P["jon7_nested_children"] = plan(
    "SELECT m.doc_id, m.doc_no, array_to_string(list_sort(list(i.issue_id)), ',') AS issue_ids FROM {META} m JOIN {ISSUES} i ON i.doc_id = m.doc_id WHERE m.doc_no IS NOT NULL AND m.doc_no <> '' AND i.included GROUP BY m.doc_id, m.doc_no",
    "SELECT m.doc_id, m.doc_no, array_join(sort_array(collect_list(i.issue_id)), ',') AS issue_ids FROM {META} m JOIN {ISSUES} i ON i.doc_id = m.doc_id WHERE m.doc_no IS NOT NULL AND m.doc_no <> '' AND i.included GROUP BY m.doc_id, m.doc_no",
)
P["jon8_eager_relations"] = plan("""
  SELECT o.o_orderkey, c.c_name, n.n_name, r.r_name FROM orders o LEFT JOIN customer c ON c.c_custkey = o.o_custkey
  LEFT JOIN nation n ON n.n_nationkey = c.c_nationkey LEFT JOIN region r ON r.r_regionkey = n.n_regionkey""")
P["jon9_hash_lookup"] = plan("""
  SELECT d.doc_id, m.title, (m.doc_id IS NOT NULL) AS imported FROM documents d LEFT JOIN {META} m ON m.doc_id = d.doc_id""")
P["jon10_null_fill"] = plan("""
  SELECT m.doc_id, coalesce(m.doc_no, m.cover_no) AS doc_no, coalesce(m.rev, m.cover_rev) AS rev, coalesce(m.project_no, d.project_no) AS project_no
  FROM {META} m JOIN documents d ON d.doc_id = m.doc_id""")
_ITEMS = "(SELECT item_id, doc_id, seq, text, page_index, y0, x0, 0 AS kind FROM {HEADINGS} h UNION ALL SELECT item_id, doc_id, seq, text, page_index, y0, x0, 1 AS kind FROM {SPANS} s)"
P["jon16_as_of_heading"] = plan(
    f"""SELECT item_id, section FROM (SELECT item_id, kind, last_value(CASE WHEN kind = 0 THEN text END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY page_index, y0, kind, seq, item_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS section FROM {_ITEMS} u) t WHERE kind = 1""",
    f"""SELECT item_id, section FROM (SELECT item_id, kind, last_value(CASE WHEN kind = 0 THEN text END, true) OVER (PARTITION BY doc_id ORDER BY page_index, y0, kind, seq, item_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS section FROM {_ITEMS} u) t WHERE kind = 1""",
)



def _as_of(spark, folder):
    """The same through the operator, which orders a page at a time."""
    from ..operators.asof import with_heading
    from ..operators.references import ordered_items
    from ..sources.tables import table

    items = ordered_items(table(spark, folder, "headings"), table(spark, folder, "spans"))
    return with_heading(items).where("NOT is_heading").selectExpr("item_id", "head.text AS section")


P["jon16_as_of_heading"] = (_as_of, P["jon16_as_of_heading"][1])
P["jon17_adjacent_pages"] = plan("""
  SELECT doc_id, page_index, next_page FROM (SELECT doc_id, page_index, lead(page_index) OVER (PARTITION BY doc_id ORDER BY page_index) AS next_page
  FROM (SELECT DISTINCT doc_id, page_index FROM pdf_pages) p) t WHERE next_page IS NOT NULL""")
P["jon18_below_header"] = plan("""
  SELECT c.cell_id, h.text AS header FROM {CELLS} c JOIN {CELLS} h ON h.doc_id = c.doc_id AND h.table_index = c.table_index AND h.col_index = c.col_index
  WHERE lower(h.text) IN ('remarks', 'note', 'status') AND c.row_index > h.row_index""")
P["jon19_title_discovery"] = plan("""
  SELECT m.doc_id, min(p.page_index) AS page FROM {META} m JOIN {PAGES} p ON p.doc_id = m.doc_id
  WHERE m.title IS NOT NULL AND strpos(lower(p.raw_text), lower(m.title)) > 0 GROUP BY m.doc_id""",
    """SELECT m.doc_id, min(p.page_index) AS page FROM {META} m JOIN {PAGES} p ON p.doc_id = m.doc_id
  WHERE m.title IS NOT NULL AND instr(lower(p.raw_text), lower(m.title)) > 0 GROUP BY m.doc_id""")  # fmt: skip
P["jon22_pack_resolution"] = plan(
    r"""SELECT DISTINCT pack_id FROM rules r JOIN (SELECT DISTINCT json_extract_string(evidence, '$.cited_standard') AS cited FROM issues WHERE category = 'STANDARD_TRACEABILITY' AND json_valid(evidence)) c
  ON replace(upper(c.cited), ' ', '') = replace(upper(r.standard), ' ', '') UNION SELECT pack_id FROM rules WHERE standard = 'Site practice'""",
    r"""SELECT DISTINCT pack_id FROM rules r JOIN (SELECT DISTINCT get_json_object(evidence, '$.cited_standard') AS cited FROM issues WHERE category = 'STANDARD_TRACEABILITY') c
  ON replace(upper(c.cited), ' ', '') = replace(upper(r.standard), ' ', '') UNION SELECT pack_id FROM rules WHERE standard = 'Site practice'""",
)

# ---- aggregations -----------------------------------------------------------------------------
P["agg1_filtered_count"] = plan("SELECT count(*) AS total FROM {ISSUES} i WHERE severity = 'BLOCKER' AND included")
P["agg2_zero_filled"] = plan("""
  SELECT s.severity, coalesce(n.n, 0) AS issues FROM {SEVERITIES} LEFT JOIN (SELECT severity, count(*) AS n FROM {ISSUES} i GROUP BY severity) n ON n.severity = s.severity""")
_EACH = "['BLOCKER', 'CRITICAL', 'HIGH', 'MAJOR', 'MEDIUM', 'MINOR', 'LOW', 'INFO']"
_AGG3 = "SELECT c.category, c.severity, coalesce(n.n, 0) AS issues FROM (SELECT category, {each} AS severity FROM (SELECT DISTINCT category FROM issues) d) c LEFT JOIN (SELECT category, severity, count(*) AS n FROM {ISSUES} i GROUP BY category, severity) n ON n.category = c.category AND n.severity = c.severity"
P["agg3_category_severity"] = plan(_AGG3.replace("{each}", f"unnest({_EACH})"), _AGG3.replace("{each}", f"explode(array({_EACH[1:-1]}))"))
P["agg4_traceability_summary"] = plan("""
  SELECT type, severity, count(*) AS n, count(CASE WHEN severity IN ('CRITICAL', 'BLOCKER') THEN 1 END) AS critical, count(CASE WHEN included THEN 1 END) AS unresolved
  FROM {ISSUES} i WHERE category IN ('TRACEABILITY', 'STANDARD_TRACEABILITY') GROUP BY GROUPING SETS ((type), (severity), ())""")
P["agg5_report_preview"] = plan("""
  SELECT doc_id, count(*) AS included, count(CASE WHEN severity IN ('BLOCKER', 'CRITICAL', 'HIGH') THEN 1 END) AS blockers,
    CASE WHEN count(CASE WHEN severity IN ('BLOCKER', 'CRITICAL', 'HIGH') THEN 1 END) > 0 THEN 'rejected' ELSE 'acceptable' END AS verdict
  FROM {ISSUES} i WHERE included GROUP BY doc_id""")
P["agg6_portfolio_counters"] = plan("""
  SELECT count(*) AS documents, count(DISTINCT project_no) AS projects, count(DISTINCT source) AS sources, count(CASE WHEN text = '' THEN 1 END) AS empty, count(CASE WHEN lang IS NULL THEN 1 END) AS unlabelled FROM documents""")
P["agg7_count_distinct"] = plan("SELECT source, count(DISTINCT project_no) AS projects, count(DISTINCT doc_id) AS documents FROM documents GROUP BY source")
P["agg8_coalesced_count"] = plan("SELECT s.site, coalesce(count(m.doc_no), 0) AS numbered FROM sites s LEFT JOIN {META} m ON m.site = s.site GROUP BY s.site")
P["agg9_retention_metrics"] = plan("""
  SELECT min(created_at) AS oldest, count(*) AS documents, count(CASE WHEN created_at < (SELECT max(created_at) FROM documents) - INTERVAL 90 DAY THEN 1 END) AS expired FROM documents""")
P["agg10_guard_count"] = plan("SELECT c_nationkey, count(CASE WHEN c_acctbal > 9000 THEN 1 END) AS leads FROM customer GROUP BY c_nationkey HAVING count(CASE WHEN c_acctbal > 9000 THEN 1 END) <= 1")
P["agg11_disagreeing"] = plan("""
  WITH v AS (SELECT doc_id, 'METADATA' AS source, 1 AS pos, upper(rev) AS value FROM {META} m UNION ALL SELECT doc_id, 'COVER', 2, replace(upper(cover_rev), 'REV ', '') FROM {META} m
    UNION ALL SELECT doc_id, 'FILENAME', 3, CASE WHEN strpos(upper(filename), '_REV') > 0 THEN substr(upper(filename), strpos(upper(filename), '_REV') + 4, 1) END FROM {META} m),
  c AS (SELECT *, count(*) OVER (PARTITION BY doc_id, value) AS votes, min(pos) OVER (PARTITION BY doc_id, value) AS first_pos FROM v WHERE value IS NOT NULL AND value <> ''),
  t AS (SELECT *, max(votes) OVER (PARTITION BY doc_id) AS top, min(votes) OVER (PARTITION BY doc_id) AS low, min(value) OVER (PARTITION BY doc_id) AS least, max(value) OVER (PARTITION BY doc_id) AS most FROM c),
  w AS (SELECT *, min(CASE WHEN votes = top THEN first_pos END) OVER (PARTITION BY doc_id) AS top_pos FROM t)
  SELECT doc_id, source, value FROM w WHERE least <> most AND (top = 1 OR first_pos <> top_pos)""".replace("strpos(", "instr("))
P["agg16_blocker_groups"] = plan("""
  SELECT category, type, count(*) AS n, min(page_number) AS first_page, count(DISTINCT page_number) AS pages FROM {ISSUES} i WHERE severity IN ('BLOCKER', 'CRITICAL', 'HIGH') AND included GROUP BY category, type""")
P["agg15_report_rows"] = plan(
    "SELECT doc_id, category, type, count(*) AS n, array_to_string(list_sort(list_distinct(list(message))), '; ') AS messages FROM {ISSUES} i WHERE included GROUP BY doc_id, category, type",
    "SELECT doc_id, category, type, count(*) AS n, array_join(sort_array(array_distinct(collect_list(message))), '; ') AS messages FROM {ISSUES} i WHERE included GROUP BY doc_id, category, type",
)
P["agg17_language_rows"] = plan(
    "SELECT type, message, count(*) AS n, array_to_string(list_sort(list_distinct(list(page_number))), ',') AS pages FROM {ISSUES} i WHERE category = 'GRAMMAR' GROUP BY type, message",
    "SELECT type, message, count(*) AS n, array_join(sort_array(collect_set(page_number)), ',') AS pages FROM {ISSUES} i WHERE category = 'GRAMMAR' GROUP BY type, message",
)
P["agg18_by_page"] = plan("SELECT doc_id, page_number, count(*) AS n FROM {ISSUES} i WHERE category = 'GRAMMAR' GROUP BY doc_id, page_number")
P["agg19_tri_partition"] = plan("""
  SELECT doc_id, count(CASE WHEN severity IN ('BLOCKER', 'CRITICAL', 'HIGH') THEN 1 END) AS blockers, count(CASE WHEN severity IN ('MAJOR', 'MEDIUM') THEN 1 END) AS majors,
    count(*) - count(CASE WHEN severity IN ('BLOCKER', 'CRITICAL', 'HIGH') THEN 1 END) - count(CASE WHEN severity IN ('MAJOR', 'MEDIUM') THEN 1 END) AS minors FROM {ISSUES} i GROUP BY doc_id""")
P["agg20_averages"] = plan("""
  SELECT category, CAST(sum(CAST(confidence AS DECIMAL(12, 6))) AS DOUBLE) / nullif(count(confidence), 0) AS mean_confidence, count(*) AS n FROM {ISSUES} i GROUP BY ROLLUP (category)""")
P["agg22_baseline_score"] = plan("""
  SELECT page_id, CAST(coalesce(has_header, false) AS INT) + CAST(coalesce(has_footer, false) AS INT) + CAST(coalesce(has_page_number, false) AS INT) + CAST(coalesce(has_doc_number, false) AS INT) AS score FROM {PAGES} p""")
P["agg25_type_counts"] = plan("SELECT doc_id, count(CASE WHEN type = 'REPEATED_WORD' THEN 1 END) AS repeats, count(CASE WHEN type = 'PAGE_DRIFT' THEN 1 END) AS drifts FROM {ISSUES} i GROUP BY doc_id")
P["agg28_dashboard"] = plan("SELECT o_orderstatus, count(*) AS n, count(CASE WHEN o_totalprice > 100000 THEN 1 END) AS large FROM orders GROUP BY o_orderstatus")
P["agg29_unfinished_gate"] = plan("SELECT o_custkey, count(*) AS unfinished FROM orders WHERE o_orderstatus <> 'F' GROUP BY o_custkey")
P["agg24_page_words"] = plan(
    r"SELECT doc_id, sum(CASE WHEN trim(raw_text) = '' THEN 0 ELSE len(string_split_regex(trim(raw_text), '[ \n\t]+')) END) AS words FROM {PAGES} p WHERE raw_text IS NOT NULL GROUP BY doc_id",
    r"SELECT doc_id, sum(CASE WHEN trim(raw_text) = '' THEN 0 ELSE size(split(trim(raw_text), '[ \\n\\t]+')) END) AS words FROM {PAGES} p WHERE raw_text IS NOT NULL GROUP BY doc_id",
)

# ---- windows ----------------------------------------------------------------------------------
P["win1_latest_per_stage"] = plan("""
  SELECT user_id, event_type, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS nth FROM events) t WHERE nth = 1""")
P["win2_declared_order"] = plan("""
  SELECT event_type, rank, row_number() OVER (ORDER BY rank, first_seen) AS position FROM (SELECT event_type, CASE event_type WHEN 'signup' THEN 1 WHEN 'view' THEN 2 WHEN 'click' THEN 3 ELSE 99 END AS rank, min(event_id) AS first_seen FROM events GROUP BY event_type) t""")
P["win3_current_and_failed"] = plan("""
  SELECT user_id, max(CASE WHEN nth = 1 THEN event_type END) AS current_stage, max(CASE WHEN event_type = 'error' AND nth_of_type = 1 THEN event_id END) AS failed_event
  FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS nth, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS nth_of_type FROM events) t GROUP BY user_id""")
P["win4_next_attempt"] = plan("SELECT event_id, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) + 1 AS next_attempt FROM events")
P["win5_first_wins"] = plan("""
  SELECT issue_id FROM (SELECT issue_id, row_number() OVER (PARTITION BY doc_id, category, type, coalesce(message, ''), coalesce(page_number, -1) ORDER BY created_at, issue_id) AS nth FROM {ISSUES} i) t WHERE nth = 1""")
P["win8_word_page_band"] = plan("""
  SELECT item_id FROM (SELECT item_id, row_number() OVER (PARTITION BY doc_id, page_index, lower(text), round(y0) ORDER BY seq, item_id) AS nth FROM {SPANS} s) t WHERE nth = 1""")
P["win10_stable_codes"] = plan("SELECT standard, min(rule_no) AS first_rule FROM rules GROUP BY standard")
P["win11_three_item_context"] = plan("""
  SELECT item_id, text || coalesce(' ' || lead(text, 1) OVER (PARTITION BY doc_id ORDER BY y0, x0, item_id), '') || coalesce(' ' || lead(text, 2) OVER (PARTITION BY doc_id ORDER BY y0, x0, item_id), '') AS context
  FROM {SPANS} s WHERE page_index = 0""")
P["win12_line_sessions"] = plan("""
  SELECT doc_id, page_index, line_no, count(*) AS spans, min(x0) AS x0, min(y0) AS y0, max(x1) AS x1, max(y1) AS y1 FROM (
    SELECT *, sum(opens) OVER (PARTITION BY doc_id, page_index ORDER BY y0, x0, item_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS line_no FROM (
      SELECT *, CASE WHEN lag(y0) OVER w IS NULL OR abs(y0 - lag(y0) OVER w) > 2.5 OR x0 - lag(x1) OVER w > 18 THEN 1 ELSE 0 END AS opens FROM {SPANS} s WINDOW w AS (PARTITION BY doc_id, page_index ORDER BY y0, x0, item_id)) a) b
  GROUP BY doc_id, page_index, line_no""")
P["win14_segments"] = plan("""
  SELECT cell_id, sum(CASE WHEN marks THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id, table_index, col_index ORDER BY row_index, cell_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS segment
  FROM (SELECT *, text IN ('-', 'TBD', 'N/A') AS marks FROM {CELLS} c WHERE text IS NOT NULL) t""")
P["win15_first_last_block"] = plan("""
  SELECT doc_id, page_index, min_by(item_id, y0 * 100000 + x0 + item_id / 1e9) AS first_item, max_by(item_id, y0 * 100000 + x0 + item_id / 1e9) AS last_item FROM {SPANS} s GROUP BY doc_id, page_index""")
P["win16_interior_pages"] = plan("""
  SELECT page_id FROM (SELECT page_id, page_index, min(page_index) OVER (PARTITION BY doc_id) AS low, max(page_index) OVER (PARTITION BY doc_id) AS high, count(*) OVER (PARTITION BY doc_id) AS n FROM {PAGES} p) t WHERE n >= 3 AND page_index > low AND page_index < high""")
P["win17_first_doc_number"] = plan("""
  SELECT doc_id, min_by(doc_number, page_index) AS doc_number FROM {PAGES} p WHERE page_index < 5 AND length(doc_number) >= 10 GROUP BY doc_id""")
P["win18_latest_row"] = plan("SELECT doc_id, table_index, max(row_index) AS last_row FROM {CELLS} c WHERE col_index = 0 AND text <> '' GROUP BY doc_id, table_index")
P["win19_monotone_order"] = plan("""
  SELECT doc_id, min(CASE WHEN previous IS NULL OR level >= previous - 1 THEN 1 ELSE 0 END) = 1 AS logical FROM (
    SELECT doc_id, level, lag(level) OVER (PARTITION BY doc_id ORDER BY page_index, y0, seq, item_id) AS previous FROM {HEADINGS} h) t GROUP BY doc_id""")
P["win20_flag_flips"] = plan(f"""
  SELECT item_id, CASE WHEN max(flag) OVER (PARTITION BY doc_id ORDER BY page_index, y0, x0, kind, item_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) = 1 THEN 'REFERENCE' ELSE 'BODY' END AS section
  FROM (SELECT *, CASE WHEN kind = 0 AND lower(text) LIKE '%certificates%' THEN 1 ELSE 0 END AS flag FROM {_ITEMS} u) t""")

# ---- sorts, limits, pages ---------------------------------------------------------------------
P["srt1_page"] = plan("SELECT doc_id, created_at FROM documents ORDER BY created_at DESC, doc_id LIMIT 25 OFFSET 50")
P["srt2_ascending"] = plan("SELECT doc_id, created_at FROM documents ORDER BY created_at, doc_id LIMIT 25")
P["srt3_oldest_active"] = plan("SELECT o_custkey, min_by(o_orderkey, o_orderkey) AS oldest FROM orders WHERE o_orderstatus = 'O' GROUP BY o_custkey")
P["srt4_newest_by_hash"] = plan("SELECT md5(text) AS text_key, max_by(doc_id, doc_id) AS newest FROM documents WHERE text IS NOT NULL GROUP BY md5(text)")
P["srt5_multi_key"] = plan("SELECT source, count(DISTINCT project_no) AS projects, row_number() OVER (ORDER BY count(DISTINCT project_no) DESC, source) AS position FROM documents WHERE source IS NOT NULL GROUP BY source")
P["srt6_severity_rank"] = plan("SELECT i.issue_id, s.rank, row_number() OVER (PARTITION BY i.doc_id ORDER BY s.rank, i.created_at, i.issue_id) AS position FROM {ISSUES} i JOIN {SEVERITIES} ON s.severity = i.severity")
P["srt7_alias_rank"] = plan("""
  SELECT issue_id, CASE severity WHEN 'BLOCKER' THEN 0 WHEN 'CRITICAL' THEN 1 WHEN 'HIGH' THEN 2 WHEN 'MAJOR' THEN 2 WHEN 'MEDIUM' THEN 3 WHEN 'MINOR' THEN 3 ELSE 4 END AS rank FROM {ISSUES} i""")
P["srt8_column_sort"] = plan("SELECT doc_id, title FROM {META} m WHERE title IS NOT NULL ORDER BY lower(title), doc_id")
P["srt9_first_seen_five"] = plan("""
  SELECT doc_id, message, nth FROM (SELECT doc_id, message, row_number() OVER (PARTITION BY doc_id ORDER BY first_seen, message) AS nth FROM (SELECT doc_id, message, min(issue_id) AS first_seen FROM {ISSUES} i WHERE message IS NOT NULL GROUP BY doc_id, message) a) b WHERE nth <= 5""")
P["srt10_natural_pages"] = plan("""
  SELECT page_id, page_number, row_number() OVER (PARTITION BY doc_id ORDER BY CASE WHEN n IS NULL THEN 1 ELSE 0 END, n, page_number, page_id) AS position FROM (SELECT *, TRY_CAST(page_number AS INT) AS n FROM {PAGES} p WHERE page_number IS NOT NULL) t""")

# ---- set operations ---------------------------------------------------------------------------
P["set1_union_streams"] = plan("""
  SELECT doc_id, type, 1 AS stream FROM {ISSUES} i WHERE category = 'TRACEABILITY' UNION ALL SELECT doc_id, type, 2 FROM {ISSUES} i WHERE category = 'LAYOUT' UNION ALL SELECT doc_id, type, 3 FROM {ISSUES} i WHERE category = 'GRAMMAR'""")
P["set2_spans_and_headings"] = plan("SELECT item_id, doc_id, true AS is_heading FROM {HEADINGS} h UNION ALL SELECT item_id, doc_id, false FROM {SPANS} s")
P["set3_distinct_texts"] = plan("SELECT doc_id, text FROM {SPANS} s UNION SELECT doc_id, text FROM {HEADINGS} h")
P["set4_intersect_except"] = plan("""
  SELECT doc_id, 'both' AS side FROM (SELECT doc_id FROM issues INTERSECT SELECT doc_id FROM cells) a UNION ALL SELECT doc_id, 'issues only' FROM (SELECT doc_id FROM issues EXCEPT SELECT doc_id FROM cells) b""")
P["set5_missing_parts"] = plan("""
  SELECT m.doc_id FROM (SELECT DISTINCT doc_id FROM doc_metadata) m EXCEPT SELECT doc_id FROM pdf_pages""")
P["set6_explicit_or_detected"] = plan("SELECT pack_id FROM rules WHERE kind = 'terminology' UNION SELECT pack_id FROM benchmarks")
P["set7_used_not_declared"] = plan("SELECT DISTINCT standard FROM rules EXCEPT SELECT DISTINCT standard FROM rules WHERE kind = 'terminology'")
P["set8_local_dedup"] = plan("SELECT filename, page_count, min(doc_id) AS doc_id FROM {META} m GROUP BY filename, page_count")

# ---- further projections, merges and text features --------------------------------------------
P["prj3_revision_issues"] = plan("SELECT issue_id, 'REVISION_MISMATCH' AS type, 'CRITICAL' AS severity, 1.0E0 AS confidence FROM {ISSUES} i WHERE type = 'REVISION_MISMATCH'")
P["prj4_table_math_grades"] = plan("SELECT issue_id, CASE type WHEN 'TABLE_SUM_MISMATCH' THEN 'HIGH' WHEN 'UNIT_CONFLICT' THEN 'MEDIUM' ELSE 'LOW' END AS severity FROM {ISSUES} i WHERE type IN ('TABLE_SUM_MISMATCH', 'UNIT_CONFLICT')")
P["prj5_missing_targets"] = plan(
    "SELECT issue_id, coalesce(json_extract_string(evidence, '$.actual_page_label'), 'NOT_FOUND') AS target, coalesce(TRY_CAST(json_extract_string(evidence, '$.page_delta') AS INT), 0) AS delta FROM {ISSUES} i WHERE type = 'PAGE_DRIFT' AND json_valid(evidence)",
    "SELECT issue_id, coalesce(get_json_object(evidence, '$.actual_page_label'), 'NOT_FOUND') AS target, coalesce(TRY_CAST(get_json_object(evidence, '$.page_delta') AS INT), 0) AS delta FROM {ISSUES} i WHERE type = 'PAGE_DRIFT' AND try_parse_json(evidence) IS NOT NULL",
)
P["prj6_standard_messages"] = plan(
    "SELECT rule_no, replace(replace(message_template, '{standard}', standard), '{clause}', clause) AS message FROM rules WHERE message_template IS NOT NULL"
)
P["prj8_clamped_pages"] = plan("SELECT issue_id, greatest(0, page_number - 1) AS page_index FROM {ISSUES} i WHERE page_number IS NOT NULL")
P["prj22_localized_tokens"] = plan("SELECT issue_id, replace(replace(replace(severity, 'CRITICAL', 'KRITIS'), 'MAJOR', 'UTAMA'), 'MINOR', 'RINGAN') AS label FROM {ISSUES} i")
P["agg21_fallback_averages"] = plan("SELECT category, coalesce(CAST(sum(CASE WHEN included THEN CAST(confidence AS DECIMAL(12, 6)) END) AS DOUBLE) / nullif(count(CASE WHEN included THEN confidence END), 0), 0) AS average FROM {ISSUES} i GROUP BY category")
P["agg26_shared_numbers"] = plan(
    r"""SELECT page_id, len(list_intersect(list_distinct(regexp_extract_all(raw_text, '[0-9]+[.][0-9]+')), list_distinct(regexp_extract_all(next_text, '[0-9]+[.][0-9]+')))) AS shared FROM (SELECT page_id, raw_text, lead(raw_text) OVER (PARTITION BY doc_id ORDER BY page_index, page_id) AS next_text FROM {PAGES} p WHERE raw_text IS NOT NULL) t WHERE next_text IS NOT NULL""",
    r"""SELECT page_id, size(array_intersect(regexp_extract_all(raw_text, '[0-9]+[.][0-9]+', 0), regexp_extract_all(next_text, '[0-9]+[.][0-9]+', 0))) AS shared FROM (SELECT page_id, raw_text, lead(raw_text) OVER (PARTITION BY doc_id ORDER BY page_index, page_id) AS next_text FROM {PAGES} p WHERE raw_text IS NOT NULL) t WHERE next_text IS NOT NULL""",
)
P["win6_kind_code_year"] = plan("SELECT rule_no FROM (SELECT rule_no, row_number() OVER (PARTITION BY kind, standard, edition ORDER BY rule_no) AS nth FROM rules) t WHERE nth = 1")
P["win7_rule_page_text"] = plan("SELECT item_id FROM (SELECT item_id, row_number() OVER (PARTITION BY doc_id, page_index, lower(text), round(y0) ORDER BY seq, item_id) AS nth FROM {HEADINGS} h) t WHERE nth = 1")
P["win9_rule_fact_page"] = plan("SELECT issue_id FROM (SELECT issue_id, row_number() OVER (PARTITION BY doc_id, type, message, page_number ORDER BY issue_id) AS nth FROM {ISSUES} i) t WHERE nth = 1")
P["win13_last_of_section"] = plan(
    f"""SELECT doc_id, section_item, max_by(item_id, page_index * 1000000 + y0 * 1000 + seq) AS last_item FROM (SELECT item_id, doc_id, kind, seq, page_index, y0, last_value(CASE WHEN kind = 0 THEN item_id END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY page_index, y0, kind, seq, item_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS section_item FROM {_ITEMS} u) t WHERE kind = 1 AND section_item IS NOT NULL GROUP BY doc_id, section_item""",
    f"""SELECT doc_id, section_item, max_by(item_id, page_index * 1000000 + y0 * 1000 + seq) AS last_item FROM (SELECT item_id, doc_id, kind, seq, page_index, y0, last_value(CASE WHEN kind = 0 THEN item_id END, true) OVER (PARTITION BY doc_id ORDER BY page_index, y0, kind, seq, item_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS section_item FROM {_ITEMS} u) t WHERE kind = 1 AND section_item IS NOT NULL GROUP BY doc_id, section_item""",
)
P["jon20_title_lookup"] = plan("""
  SELECT m.doc_id, min(CASE WHEN h.text = m.title THEN 1 WHEN lower(trim(h.text)) = lower(trim(m.title)) THEN 2 ELSE 3 END) AS tier FROM {META} m JOIN {HEADINGS} h ON h.doc_id = m.doc_id
  WHERE m.title IS NOT NULL AND (strpos(lower(h.text), lower(m.title)) > 0 OR strpos(lower(m.title), lower(h.text)) > 0) GROUP BY m.doc_id""",
    """SELECT m.doc_id, min(CASE WHEN h.text = m.title THEN 1 WHEN lower(trim(h.text)) = lower(trim(m.title)) THEN 2 ELSE 3 END) AS tier FROM {META} m JOIN {HEADINGS} h ON h.doc_id = m.doc_id
  WHERE m.title IS NOT NULL AND (instr(lower(h.text), lower(m.title)) > 0 OR instr(lower(m.title), lower(h.text)) > 0) GROUP BY m.doc_id""")  # fmt: skip
P["txt19_baselines"] = plan(
    r"""SELECT doc_id, max(CASE WHEN regexp_matches(lower(text), 'scope|background|introduction') THEN 1 ELSE 0 END) + max(CASE WHEN regexp_matches(lower(text), 'summary|conclusion') THEN 1 ELSE 0 END) + max(CASE WHEN regexp_matches(lower(text), 'recommend|repair') THEN 1 ELSE 0 END) + max(CASE WHEN regexp_matches(lower(text), 'survey|assessment|check') THEN 1 ELSE 0 END) AS baselines FROM {HEADINGS} h GROUP BY doc_id""",
    r"""SELECT doc_id, max(CASE WHEN lower(text) RLIKE 'scope|background|introduction' THEN 1 ELSE 0 END) + max(CASE WHEN lower(text) RLIKE 'summary|conclusion' THEN 1 ELSE 0 END) + max(CASE WHEN lower(text) RLIKE 'recommend|repair' THEN 1 ELSE 0 END) + max(CASE WHEN lower(text) RLIKE 'survey|assessment|check' THEN 1 ELSE 0 END) AS baselines FROM {HEADINGS} h GROUP BY doc_id""",
)
P["txt22_not_applicable"] = plan("""
  SELECT m.doc_id, CASE WHEN lower(m.title) LIKE '%procedure%' THEN NULL WHEN count(c.cell_id) > 0 THEN 5 ELSE 3 END AS steps_outlined FROM {META} m LEFT JOIN {CELLS} c ON c.doc_id = m.doc_id GROUP BY m.doc_id, m.title""")
P["txt23_evidence_notes"] = plan("""
  SELECT m.doc_id, coalesce(min(h.text), 'no section') AS note FROM {META} m LEFT JOIN {HEADINGS} h ON h.doc_id = m.doc_id AND lower(h.text) LIKE '%recommend%' GROUP BY m.doc_id""")
P["txt27_cover_values"] = plan(
    r"""SELECT page_id, regexp_extract(raw_text, '([0-9]{2}-[0-9]{4}-[0-9]{3}(-[A-Z]{3}-[0-9]{4})?)', 1) AS doc_number, regexp_extract(coalesce(header_text, ''), 'Rev ([A-Z0-9])', 1) AS revision FROM {PAGES} p WHERE page_index = 0 AND raw_text IS NOT NULL""",
    r"""SELECT page_id, regexp_extract(raw_text, '([0-9]{2}-[0-9]{4}-[0-9]{3}(-[A-Z]{3}-[0-9]{4})?)', 1) AS doc_number, regexp_extract(coalesce(header_text, ''), 'Rev ([A-Z0-9])', 1) AS revision FROM {PAGES} p WHERE page_index = 0 AND raw_text IS NOT NULL""",
)
P["txt28_summary_prose"] = plan("""
  SELECT doc_id, 'The review found ' || CAST(count(*) AS VARCHAR(12)) || ' finding(s) in ' || CAST(count(DISTINCT category) AS VARCHAR(12)) || ' categories.' AS prose FROM {ISSUES} i WHERE included GROUP BY doc_id""",
    """SELECT doc_id, 'The review found ' || CAST(count(*) AS STRING) || ' finding(s) in ' || CAST(count(DISTINCT category) AS STRING) || ' categories.' AS prose FROM {ISSUES} i WHERE included GROUP BY doc_id""")  # fmt: skip


def queries() -> dict:
    return split(P)[0]


def oracle_sql() -> dict:
    return split(P)[1]
