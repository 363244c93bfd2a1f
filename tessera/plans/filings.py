"""Queries over pages, and over filings made from documents: twelve documents are the items of an annual report, three those of a current one.

Some filings have a table of contents, linked references, stub headers, references to pages, a combined header, items out of order, no last item, or all headers at the end.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions.config import ANNUAL, CURRENT, EVENT_LABELS, Form
from tessera.functions.text import collapse_sql, q, word_count_sql
from tessera.operators import html, quality
from tessera.operators import sections as S
from tessera.storage import spread

TITLES = [
    "ITEM 1. BUSINESS", "Item 1A. Risk Factors", "Item 1B. Unresolved Staff Comments", "ITEM 2. PROPERTIES", "ITEM 3. LEGAL PROCEEDINGS", "Item 5. Market for Registrant's Common Equity",
    "ITEM 7. MANAGEMENT'S DISCUSSION", "Item 7A. Quantitative Disclosures", "ITEM 8. FINANCIAL STATEMENTS", "Item 9. Changes in Accountants", "Item 9A. Controls and Procedures", "ITEM 10. DIRECTORS",
]
BOTH = "Items 1 and 2. Business and Properties"
CONTENTS = "<table>" + "".join(f"<tr><td>{t} {k + 3}</td></tr>" for k, t in enumerate(TITLES)) + "</table>"
LINK = """<p><a href="#x">Item 7. Management's Discussion</a></p>"""
PAGES = "<div>Item 1 Business Pages 3-7</div>"
STUB = "<div>Item 3. Legal Proceedings</div>"
#: Nodes that are blank only once decoded, and entities with and without names and semicolons.
ENTITIES = "<p>&#160;</p>" * 5 + "<p>&nbsp;&ensp;&#xA0;</p><p>The Company&rsquo;s report &#8212; &#x41;&amp;B, &notin;&copy 2024 &#147;so&#148;</p>"
EVENTS = [f"Item {n} {label}" for n, label in EVENT_LABELS.items()] + ["Item 3.03 Material Modification to Rights"]


def escaped(text, parted: bool = True):
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        text = F.replace(text, F.lit(a), F.lit(b))
    return F.replace(text, F.lit(". "), F.lit(".</p><p>")) if parted else text


def annual_filings(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.expr("doc_id div 12").alias("filing_id"), (F.col("doc_id") % 12).cast("int").alias("k"), escaped(F.col("text")).alias("body"))
    f, k = F.col("filing_id"), F.col("k")
    bare = ((k == 11) & (f % 5 == 4)) | ((k == 3) & (f % 7 == 3))
    title = F.when((k == 0) & (f % 7 == 3), BOTH).otherwise(F.element_at(F.array(*(F.lit(t) for t in TITLES)), k + 1))
    head = F.when(bare, "").otherwise(F.concat(F.when((k == 4) & (f % 8 == 6), STUB).otherwise(""), F.lit("<div>"), title, F.lit("</div>")))
    text = F.concat(F.lit("<p>"), "body", F.lit("</p>"))
    place = F.when((f % 6 == 5) & (k == 3), 4).when((f % 6 == 5) & (k == 4), 3).otherwise(k)
    blocks = F.when(f % 9 == 2, F.array(F.struct(place.alias("o"), text.alias("b")), F.struct((place + 100).alias("o"), head.alias("b")))).otherwise(F.array(F.struct(place.alias("o"), F.concat(head, text).alias("b"))))
    joined = docs.select("filing_id", F.inline(blocks)).groupBy("filing_id").agg(F.array_sort(F.collect_list(F.struct("o", "b"))).alias("x"))
    prefix = F.concat(F.when(f % 3 == 0, CONTENTS).otherwise(""), F.when(f % 4 == 1, LINK).otherwise(""), F.when(f % 10 == 4, PAGES).otherwise(""), F.when(f % 4 == 2, ENTITIES).otherwise(""))
    return joined.select("filing_id", F.concat(F.lit("<html><body>"), prefix, F.array_join("x.b", ""), F.lit("</body></html>")).alias("html"))


def current_filings(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.expr("doc_id div 3").alias("filing_id"), (F.col("doc_id") % 3).alias("k"), "doc_id", escaped(F.col("text")).alias("body"))
    at = F.when(F.col("filing_id") % 5 == 0, 19).otherwise(F.expr("doc_id * 7 % 21"))
    title = F.element_at(F.array(*(F.lit(t) for t in EVENTS)), (at + 1).cast("int"))
    headed = (F.col("filing_id") % 13 != 1) & ((F.col("filing_id") % 5 != 0) | (F.col("k") == 0))
    block = F.concat(F.when(headed, F.concat(F.lit("<div>"), title, F.lit("</div>"))).otherwise(""), F.lit("<p>"), "body", F.lit("</p>"))
    joined = docs.select("filing_id", F.struct("k", block.alias("b")).alias("s")).groupBy("filing_id").agg(F.array_sort(F.collect_list("s")).alias("x"))
    return joined.select("filing_id", F.concat(F.lit("<html><body>"), F.array_join("x.b", ""), F.lit("</body></html>")).alias("html"))


def _pages(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/pages.parquet")


def text_nodes(spark, sf_dir):
    return html.text_nodes(spread(_pages(spark, sf_dir))).select("page_id", "node_idx", "text")


def node_flags(spark, sf_dir):
    n = html.text_nodes(spread(_pages(spark, sf_dir)), count_nonvisible=False)
    return n.groupBy("page_id").agg(F.count("*").alias("nodes"), F.count_if("in_a").alias("in_a"), F.count_if("in_table").alias("in_table"))


def page_elements(spark, sf_dir):
    return html.elements(spread(_pages(spark, sf_dir)))


def page_text(spark, sf_dir):
    return html.with_extracted_text(spread(_pages(spark, sf_dir))).select("page_id", "text")


def _annual_split(spark, sf_dir, retry=False):
    return S.split_filings(annual_filings(spark, sf_dir), ANNUAL, retry)


def header_candidates_10k(spark, sf_dir):
    return S.candidates(_annual_split(spark, sf_dir)).drop("suspicion", "rank", "item_ord")


def ranked_headers_10k(spark, sf_dir):
    return S.candidates(_annual_split(spark, sf_dir)).select("filing_id", "item", "node_idx", "suspicion", "rank").where("rank is not null")


def page_reference_hits(spark, sf_dir):
    return S.page_references(_annual_split(spark, sf_dir))


def sections_10k(spark, sf_dir):
    return S.sections(_annual_split(spark, sf_dir)).select("filing_id", "item", "start_idx", "words", "combined", F.md5("text").alias("text_md5"))


def section_verdicts(spark, sf_dir):
    return S.verdicts(S.sections(_annual_split(spark, sf_dir))).select("filing_id", "item", "verdict")


def filing_status(spark, sf_dir):
    return S.filing_status(_annual_split(spark, sf_dir))


def sections_repaired(spark, sf_dir):
    return S.verdicts(S.sections(_annual_split(spark, sf_dir, True)))


def sections_8k(spark, sf_dir):
    return S.split_current(current_filings(spark, sf_dir)).select("filing_id", "item", "start_idx", "words", F.md5("text").alias("text_md5"))


def events_8k(spark, sf_dir):
    return S.current_events(S.split_filings(current_filings(spark, sf_dir), CURRENT))


def status_tally(spark, sf_dir):
    return quality.status_tally(filing_status(spark, sf_dir))


def missing_items(spark, sf_dir):
    return quality.missing_items(filing_status(spark, sf_dir))


def length_failures(spark, sf_dir):
    return quality.length_failures(S.sections(_annual_split(spark, sf_dir)))


def item_diagnosis(spark, sf_dir):
    return quality.diagnose(_annual_split(spark, sf_dir))


def order_failures(spark, sf_dir):
    return S.order_check(_annual_split(spark, sf_dir)).where("not order_correct").select("filing_id", "found_order")


# --- DuckDB -----------------------------------------------------------------------------------------------------------------

_esc = "replace(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '. ', '.</p><p>')"


def _list(items: list[str]) -> str:
    return "[" + ", ".join(q(t) for t in items) + "]"


_annual = f"""
d AS (
  SELECT doc_id // 12 AS f, (doc_id % 12)::INT AS k, '<p>' || {_esc} || '</p>' AS body FROM documents
), b AS (
  SELECT f, CASE WHEN f % 6 = 5 AND k IN (3, 4) THEN 7 - k ELSE k END AS o, body,
    CASE WHEN (k = 11 AND f % 5 = 4) OR (k = 3 AND f % 7 = 3) THEN '' ELSE CASE WHEN k = 4 AND f % 8 = 6 THEN {q(STUB)} ELSE '' END || '<div>' || CASE WHEN k = 0 AND f % 7 = 3 THEN {q(BOTH)} ELSE {_list(TITLES)}[k + 1] END || '</div>' END AS head
  FROM d
), s AS (
  SELECT f, o, CASE WHEN f % 9 = 2 THEN body ELSE head || body END AS b FROM b UNION ALL SELECT f, o + 100, head FROM b WHERE f % 9 = 2
), filings AS MATERIALIZED (
  SELECT f AS filing_id, '<html><body>' || CASE WHEN f % 3 = 0 THEN {q(CONTENTS)} ELSE '' END || CASE WHEN f % 4 = 1 THEN {q(LINK)} ELSE '' END
    || CASE WHEN f % 10 = 4 THEN {q(PAGES)} ELSE '' END || CASE WHEN f % 4 = 2 THEN {q(ENTITIES)} ELSE '' END || string_agg(b, '' ORDER BY o) || '</body></html>' AS html
  FROM s GROUP BY f
)"""
_current = f"""
d AS (SELECT doc_id // 3 AS f, doc_id % 3 AS k, CASE WHEN doc_id // 3 % 5 = 0 THEN 19 ELSE doc_id * 7 % 21 END AS e, '<p>' || {_esc} || '</p>' AS body FROM documents),
filings AS MATERIALIZED (
  SELECT f AS filing_id, '<html><body>' || string_agg(CASE WHEN f % 13 <> 1 AND (f % 5 <> 0 OR k = 0) THEN '<div>' || {_list(EVENTS)}[e + 1] || '</div>' ELSE '' END || body, '' ORDER BY k) || '</body></html>' AS html FROM d GROUP BY f
)"""


def _split(form: Form, source: str) -> str:
    """CTEs up to sections; elements add no header to these filings."""
    rows = ", ".join(f"({k}, {q(i)}, {p}, {q('(?i)' + pattern)})" for k, (i, ps) in enumerate(form.patterns.items()) for p, pattern in enumerate(ps))
    hit = f"""hit AS MATERIALIZED (
  SELECT n.*, item_ord, item, p FROM short n JOIN pats ON regexp_matches(n.header, pattern)
  QUALIFY row_number() OVER (PARTITION BY filing_id, node_idx{'' if form.one_item_a_text else ', item'} ORDER BY item_ord, p) = 1{f'''
  UNION ALL SELECT n.*, {len(form.patterns)}, regexp_extract(header, {q('(?i)' + form.generic)}, 1), -1 FROM short n
  WHERE regexp_extract(header, {q('(?i)' + form.generic)}, 1) <> '' AND NOT EXISTS (SELECT 1 FROM pats WHERE regexp_matches(n.header, pattern))''' if form.generic else ''}
)"""
    reference = r"NOT regexp_matches(header, '(?i)\bpages?\s*\d')" if form.page_references else "true"
    return f"""{source},
pats(item_ord, item, p, pattern) AS MATERIALIZED (VALUES {rows}),
nodes AS MATERIALIZED ({html.text_nodes_sql("filings", "filing_id")}),
total AS (SELECT filing_id, count(*) AS n_nodes FROM nodes GROUP BY 1),
short AS MATERIALIZED (SELECT filing_id, node_idx, {collapse_sql("text")} AS header, in_a, in_table FROM nodes WHERE length({collapse_sql("text")}) <= {form.longest_header} AND regexp_matches(text, '(?i)item')),
{hit}, c0 AS (
  SELECT filing_id, item_ord, item, node_idx, n_nodes, header AS text, in_a AS is_link, in_table, node_idx / n_nodes < {form.toc} AS is_toc_region,
    regexp_matches(header, '\\d+\\s*$') AS has_trailing_digits, item = '1' AND p IN (1, 2) AS is_combined
  FROM hit JOIN total USING (filing_id) WHERE {reference}
), c1 AS (
  SELECT *, NOT is_link OR NOT bool_or(NOT is_link) OVER (PARTITION BY filing_id, item) AS usable, in_table::INT + has_trailing_digits::INT + is_toc_region::INT AS suspicion FROM c0
), cand AS MATERIALIZED (
  SELECT * EXCLUDE (usable), CASE WHEN usable THEN row_number() OVER (PARTITION BY filing_id, item ORDER BY usable DESC, suspicion, node_idx)::INT END AS rank FROM c1
), far AS (SELECT filing_id, round(100 * min(node_idx / n_nodes), 1) AS earliest_match_pct FROM cand WHERE rank = 1 GROUP BY 1 HAVING min(node_idx / n_nodes) > {form.far or 2}),
chosen AS MATERIALIZED (SELECT filing_id, item_ord, item, node_idx AS start_idx, is_combined, n_nodes, lead(node_idx, 1, n_nodes::INT) OVER (PARTITION BY filing_id ORDER BY node_idx, item_ord, item) AS end_idx FROM cand WHERE rank = 1 AND filing_id NOT IN (SELECT filing_id FROM far)),
bodies AS (SELECT c.filing_id, item, string_agg(text, ' ' ORDER BY node_idx) AS t FROM chosen c JOIN nodes n ON n.filing_id = c.filing_id AND node_idx >= start_idx AND node_idx < end_idx GROUP BY ALL),
plain AS (
  SELECT c.filing_id, item_ord, c.item, start_idx, coalesce({collapse_sql("t")}, '') AS text, bool_or(is_combined AND c.item = '1') OVER (PARTITION BY c.filing_id) AS combined,
    bool_or(c.item = '2') OVER (PARTITION BY c.filing_id) AS has2
  FROM chosen c LEFT JOIN bodies b ON b.filing_id = c.filing_id AND b.item = c.item WHERE c.item <> {q(form.boundary_only or '')}
), sections AS MATERIALIZED (
  SELECT * EXCLUDE (has2), {word_count_sql("text")}::INT AS words FROM (
    SELECT * FROM plain{"" if form is CURRENT else " UNION ALL SELECT filing_id, 3, '2', NULL, text, combined, has2 FROM plain WHERE item = '1' AND combined AND NOT has2"}
  )
)"""


_bounds = "bounds(item, low, high) AS (VALUES " + ", ".join(f"({q(i)}, {a}, {b})" for i, (a, b) in ANNUAL.bounds.items()) + ")"
_verdict = f"""{_split(ANNUAL, _annual)}, {_bounds}, verdicts AS MATERIALIZED (
  SELECT s.*, CASE WHEN s.item = '2' AND combined THEN 'combined_with_item_1' WHEN low IS NULL THEN 'no_bounds_defined' WHEN words < low THEN printf('too_short (%dw, expected>=%d)', words, low)
    WHEN words > high THEN printf('too_long (%dw, expected<=%d)', words, high) ELSE 'ok' END AS verdict
  FROM sections s LEFT JOIN bounds b ON b.item = s.item
), orders AS (
  SELECT filing_id, string_agg(item, ',' ORDER BY start_idx, item_ord) AS found_order, list(item_ord ORDER BY start_idx, item_ord) = list(item_ord ORDER BY item_ord) AS order_correct FROM verdicts WHERE start_idx IS NOT NULL GROUP BY 1
), zero AS (SELECT filing_id, string_agg(i, ',' ORDER BY k) AS z FROM filings, (SELECT unnest({_list(ANNUAL.order)}) AS i, unnest(range(12)) AS k) WHERE NOT EXISTS (SELECT 1 FROM cand c WHERE c.filing_id = filings.filing_id AND c.item = i) GROUP BY 1),
lens AS (SELECT filing_id, string_agg(item, ',' ORDER BY item_ord) FILTER (verdict LIKE 'too_%') AS bad, count(*) AS n FROM verdicts GROUP BY 1),
status AS (
  SELECT f.filing_id, CASE WHEN earliest_match_pct IS NOT NULL THEN 'incorporated_by_reference' WHEN n IS NULL THEN 'failed' WHEN z IS NOT NULL OR NOT order_correct OR bad IS NOT NULL THEN 'needs_review' ELSE 'verified' END AS status,
    coalesce(z, '') AS zero_occurrence, coalesce(bad, '') AS length_failures, earliest_match_pct
  FROM filings f LEFT JOIN zero USING (filing_id) LEFT JOIN lens USING (filing_id) LEFT JOIN orders USING (filing_id) LEFT JOIN far USING (filing_id)
)"""
_labels = "labels8(item, label) AS (VALUES " + ", ".join(f"({q(k)}, {q(v)})" for k, v in EVENT_LABELS.items()) + ")"
_all = (
    text_nodes, node_flags, page_elements, page_text, header_candidates_10k, ranked_headers_10k, page_reference_hits, sections_10k, section_verdicts, filing_status, sections_repaired,
    sections_8k, events_8k, status_tally, missing_items, length_failures, item_diagnosis, order_failures,
)
QUERIES = {f.__name__: f for f in _all}
SQL = {
    "text_nodes": f"SELECT page_id, node_idx, text FROM ({html.text_nodes_sql('pages')})",
    "node_flags": f"SELECT page_id, count(*) AS nodes, count(*) FILTER (in_a) AS in_a, count(*) FILTER (in_table) AS in_table FROM (SELECT * FROM ({html.text_nodes_sql('pages')}) WHERE visible) GROUP BY page_id",
    "header_candidates_10k": f"WITH {_split(ANNUAL, _annual)} SELECT * EXCLUDE (suspicion, rank, item_ord) FROM cand",
    "ranked_headers_10k": f"WITH {_split(ANNUAL, _annual)} SELECT filing_id, item, node_idx, suspicion, rank FROM cand WHERE rank IS NOT NULL",
    # each is a text node and the element about it
    "page_reference_hits": f"WITH {_split(ANNUAL, _annual)} SELECT filing_id, item, 2 * count(*) AS hits FROM hit WHERE regexp_matches(header, '(?i)\\bpages?\\s*\\d') GROUP BY ALL",
    "sections_10k": f"WITH {_split(ANNUAL, _annual)} SELECT filing_id, item, start_idx, words, combined, md5(text) AS text_md5 FROM sections",
    "section_verdicts": f"WITH {_verdict} SELECT filing_id, item, verdict FROM verdicts",
    "filing_status": f"WITH {_verdict} SELECT * FROM status",
    "sections_8k": f"WITH {_split(CURRENT, _current)} SELECT filing_id, item, start_idx, words, md5(text) AS text_md5 FROM sections",
    "events_8k": f"""WITH {_split(CURRENT, _current)}, {_labels} SELECT f.filing_id, CASE WHEN count(s.item) = 0 THEN 'failed' WHEN count(s.item) = 1 AND max(s.item) = '9.01' THEN 'exhibits_only' ELSE 'extracted' END AS status,
      coalesce(string_agg(s.item, ',' ORDER BY s.item), '') AS items_found, coalesce(string_agg(coalesce(label, 'Item ' || s.item), '; ' ORDER BY s.item), '') AS event_types
      FROM filings f LEFT JOIN sections s ON s.filing_id = f.filing_id LEFT JOIN labels8 l ON l.item = s.item GROUP BY 1""",
    "status_tally": f"WITH {_verdict} SELECT status, count(*) AS n, string_agg(filing_id::VARCHAR, ',' ORDER BY filing_id) AS filings FROM status GROUP BY 1",
    "missing_items": f"WITH {_verdict} SELECT item, string_agg(filing_id::VARCHAR, ',' ORDER BY filing_id) AS filings FROM (SELECT filing_id, unnest(string_split(zero_occurrence, ',')) AS item FROM status WHERE zero_occurrence <> '' AND status <> 'incorporated_by_reference') GROUP BY 1",
    "length_failures": f"WITH {_verdict} SELECT item, filing_id, verdict FROM verdicts WHERE verdict LIKE 'too_%'",
    "item_diagnosis": f"""WITH {_verdict} SELECT f.filing_id, i AS item, CASE WHEN c.filing_id IS NULL THEN 'MISSING' WHEN v.filing_id IS NULL THEN 'NOT SELECTED' WHEN verdict LIKE 'too_%' THEN 'FLAGGED: ' || verdict ELSE 'ok' END AS diagnosis
      FROM filings f CROSS JOIN (SELECT unnest({_list(ANNUAL.order[:-1])}) AS i) LEFT JOIN (SELECT DISTINCT filing_id, item FROM cand) c ON c.filing_id = f.filing_id AND c.item = i LEFT JOIN verdicts v ON v.filing_id = f.filing_id AND v.item = i""",
    "order_failures": f"WITH {_verdict} SELECT filing_id, found_order FROM orders WHERE NOT order_correct",
}
