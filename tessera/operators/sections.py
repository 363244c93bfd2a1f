"""Splitting filings into items: header candidates, their rank, assembly, retry, repair and verdicts; annual and current reports alike.

Filings are rows (filing_id, html). A filing is walked once, in one Arrow pass that gives a row with all that was found (`split_filings`); whatever else is asked for is an
expression on that row. Nothing is shuffled, as no step looks at two filings. Rows with a null id go; a null or empty page has no header, and fails. Rows that repeat an id
are filings of their own.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.config import ANNUAL, COMBINED, CURRENT, EVENT_LABELS, EXHIBITS, PAGE_REFERENCE, TRAILING_DIGITS, Form
from tessera.functions.numbers import half_up
from tessera.operators.html import SLICE, short_elements, walk

KEY = "filing_id"
HEADER = [("item_ord", pa.int32()), ("item", pa.string()), ("node_idx", pa.int32()), ("text", pa.string())] + [
    (c, pa.bool_()) for c in ("is_link", "in_table", "is_toc_region", "has_trailing_digits", "is_combined")
] + [("suspicion", pa.int32()), ("rank", pa.int32())]
SECTION = [("item_ord", pa.int32()), ("item", pa.string()), ("start_idx", pa.int32()), ("place", pa.int32()), ("text", pa.string()), ("words", pa.int32()), ("combined", pa.bool_())]
_sql_kind = {pa.int32(): "int", pa.string(): "string", pa.bool_(): "boolean"}
_struct = lambda fields: "array<struct<" + ",".join(f"{n}:{_sql_kind[t]}" for n, t in fields) + ">>"
SPLIT = f"n_nodes int, headers {_struct(HEADER)}, page_references array<string>, sections {_struct(SECTION)}, found array<string>, order_correct boolean, earliest_match_pct double"
_digits, _reference, _mentions = re.compile(TRAILING_DIGITS), re.compile(PAGE_REFERENCE, re.I), re.compile("item", re.I)


@cache
def _compiled(pattern: str) -> re.Pattern:
    return re.compile(pattern, re.I)


def matches(text: str, form: Form) -> list[tuple[int, str, int]]:
    """(item_ord, item, pattern) of the items that a text is a header of, with the first pattern that matches."""
    out = []
    for k, (item, patterns) in enumerate(form.patterns.items()):
        p = next((p for p, pattern in enumerate(patterns) if _compiled(pattern).search(text)), None)
        if p is not None:
            out.append((k, item, p))
            if form.one_item_a_text:
                break
    if not out and form.generic and (m := _compiled(form.generic).search(text)):
        out.append((len(form.patterns), m[1], -1))
    return out


def find_headers(nodes: list[tuple], elements: list[list], form: Form) -> tuple[list[dict], list[str]]:
    """(candidates, one for each item and node, with signals and rank; the items of references to pages, one for each text). Text nodes come before elements; rank is null for links where others are."""
    texts = [(k, text, in_a, in_table) for k, (text, in_a, in_table, _) in enumerate(nodes)]
    texts += [(first, text, in_a, in_table) for _, _, first, text, in_a, in_table in short_elements(nodes, elements, form.longest_header)]
    found: dict[tuple[str, int], dict] = {}
    references = []
    for node, raw, in_a, in_table in texts:
        if not _mentions.search(raw):
            continue
        text = " ".join(raw.split())
        if len(text) > form.longest_header:
            continue
        to_pages = form.page_references and _reference.search(text)
        for item_ord, item, pattern in matches(text, form):
            if to_pages:
                references.append(item)
            elif (item, node) not in found:
                toc, digits = node / len(nodes) < form.toc, bool(_digits.search(text))
                found[item, node] = {
                    "item_ord": item_ord, "item": item, "node_idx": node, "text": text, "is_link": in_a, "in_table": in_table, "is_toc_region": toc, "has_trailing_digits": digits,
                    "is_combined": item == "1" and pattern in COMBINED, "suspicion": in_table + digits + toc, "rank": None,
                }
    for item in {i for i, _ in found}:
        own = [c for c in found.values() if c["item"] == item]
        usable = [c for c in own if not c["is_link"]] or own
        for rank, c in enumerate(sorted(usable, key=lambda c: (c["suspicion"], c["node_idx"])), 1):
            c["rank"] = rank
    return list(found.values()), references


def _n_words(text: str) -> int:
    return len(text.split())


def build(texts: list[str], chosen: list[dict], form: Form = ANNUAL) -> tuple[dict[str, str], list[dict], bool]:
    """(text of each item, headers by place, combined). A section ends where the next begins; of several headers at one node the last has the text, the others ''."""
    chosen = sorted(chosen, key=lambda c: (c["node_idx"], c["item_ord"], c["item"]))
    out, combined = {}, False
    for k, c in enumerate(chosen):
        if c["item"] == form.boundary_only:
            continue
        end = chosen[k + 1]["node_idx"] if k + 1 < len(chosen) else len(texts)
        out[c["item"]] = " ".join(" ".join(texts[c["node_idx"] : end]).split())
        combined |= c["is_combined"]
    if combined and "1" in out:
        out.setdefault("2", out["1"])
    return out, [c for c in chosen if c["item"] != form.boundary_only], combined


def _ordered(found: list[dict]) -> bool:
    """X11."""
    ords = [c["item_ord"] for c in found]
    return ords == sorted(ords)


def settle(texts: list[str], ranked: dict[str, list[dict]], retries: int = 4) -> tuple[dict[str, str], list[dict], bool]:
    """X12, X13 of an annual report, as `build`. ranked: candidates of each item, the best first. Item by item, one below its bound tries its next headers; the first that reaches it is taken unless it spoils the order."""
    at = {i: 0 for i in ranked if ranked[i]}
    pick = lambda at: build(texts, [ranked[i][k] for i, k in at.items()])
    sections, found, combined = pick(at)
    fine = _ordered(found)
    for item in [i for i in ANNUAL.order if i in sections]:
        options = ranked.get(item, [])
        if item not in ANNUAL.bounds or len(options) < 2 or (item == "2" and combined):
            continue
        least = ANNUAL.bounds[item][0]
        if _n_words(sections[item]) >= least:
            continue
        for k in range(at[item] + 1, min(len(options), at[item] + 1 + retries)):
            trial, order, both = pick(at | {item: k})
            if _n_words(trial.get(item, "")) >= least and (_ordered(order) or not fine):
                at[item], sections, found, combined, fine = k, trial, order, both, _ordered(order)
                break
    return repair(sections, combined), found, combined


def repair(sections: dict[str, str], combined: bool) -> dict[str, str]:
    """Cuts sections beyond their bound at a later item's header inside them; the first header past the bound, else the last of the latest item that has one."""
    out = dict(sections)
    for k, item in enumerate(ANNUAL.order):
        if item not in out or item not in ANNUAL.bounds or (item == "2" and combined):
            continue
        text, most = out[item], ANNUAL.bounds[item][1]
        if _n_words(text) <= most:
            continue
        cut = None
        for later in ANNUAL.order[k + 1 :]:
            if later == ANNUAL.boundary_only:
                continue
            starts = [m.start() for p in ANNUAL.patterns[later] for m in _compiled(p).finditer(text) if m.start() > 100]
            past = [s for s in starts if s >= 5 * most]
            if past:
                cut = (min(past), later)
                break
            if starts:
                cut = (max(starts), later)
        if cut:
            out[item], rest = text[: cut[0]].strip(), text[cut[0] :].strip()
            if _n_words(out.get(cut[1], "")) < 50:
                out[cut[1]] = rest
    return out


def split_page(page: str | None, form: Form = ANNUAL, retry: bool = False) -> tuple:
    """One filing as a row of SPLIT."""
    nodes, elements = walk(page)
    headers, references = find_headers(nodes, elements, form)
    best = [c for c in headers if c["rank"] == 1]
    earliest = min((c["node_idx"] / len(nodes) for c in best), default=0.0)
    if form.far is not None and earliest > form.far:
        return len(nodes), headers, references, [], [], True, half_up(100 * earliest, 1)
    texts = [n[0] for n in nodes]
    if retry:
        ranked = {i: sorted((c for c in headers if c["item"] == i and c["rank"]), key=lambda c: c["rank"]) for i in form.order}
        sections, found, combined = settle(texts, ranked)
    else:
        sections, found, combined = build(texts, best, form)
    place = {c["item"]: k for k, c in enumerate(found)}
    order = {i: k for k, i in enumerate(form.order)}
    rows = []
    for item, text in sections.items():
        k = place.get(item)
        rows.append({"item_ord": order.get(item, len(order)), "item": item, "start_idx": None if k is None else found[k]["node_idx"], "place": k, "text": text, "words": _n_words(text), "combined": combined})
    return len(nodes), headers, references, rows, [c["item"] for c in found], _ordered(found), None


def _split(form: Form, retry: bool):
    kinds = [pa.int32(), pa.list_(pa.struct(HEADER)), pa.list_(pa.string()), pa.list_(pa.struct(SECTION)), pa.list_(pa.string()), pa.bool_(), pa.float64()]
    names = ["n_nodes", "headers", "page_references", "sections", "found", "order_correct", "earliest_match_pct"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                some = batch.slice(at, SLICE)
                rows = [split_page(page.as_py(), form, retry) for page in some.column(1)]
                yield pa.RecordBatch.from_arrays([some.column(0), *(pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds))], names=["id", *names])

    return run


def split_filings(filings: DataFrame, form: Form = ANNUAL, retry: bool = False, id_col: str = KEY, html_col: str = "html") -> DataFrame:
    """A row for each filing, (filing_id, n_nodes, headers, page_references, sections, found, order_correct, earliest_match_pct).

    headers: all candidates; sections: of the best headers, with retry and repair where asked for; found: items of the headers that were chosen, by place. A filing whose content is elsewhere (X8: the best
    header of every item lies past the threshold) has no sections and has earliest_match_pct. start_idx and place are null for text that a repair moved or a combined header lent.
    """
    cut = filings.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(html_col).alias("html"))
    return cut.mapInArrow(_split(form, retry), f"id {dict(cut.dtypes)['id']}, {SPLIT}").withColumnRenamed("id", KEY)


def candidates(split: DataFrame) -> DataFrame:
    """One row for each item and node of `split_filings`, with its signals and rank."""
    return split.select(KEY, "n_nodes", F.inline("headers"))


def page_references(split: DataFrame) -> DataFrame:
    """(filing_id, item, hits)."""
    each = F.explode(F.array_distinct("page_references")).alias("item")
    return split.select(KEY, "page_references", each).select(KEY, "item", F.size(F.filter("page_references", lambda x: x == F.col("item"))).cast("long").alias("hits"))


def far_filings(split: DataFrame) -> DataFrame:
    """(filing_id, earliest_match_pct) of filings whose content is elsewhere."""
    return split.select(KEY, "earliest_match_pct").where("earliest_match_pct is not null")


def sections(split: DataFrame) -> DataFrame:
    """(filing_id, order_correct, item_ord, item, start_idx, place, text, words, combined)."""
    return split.select(KEY, "order_correct", F.inline("sections"))


def split_annual(filings: DataFrame) -> DataFrame:
    """Sections of annual reports, with retry and repair."""
    return sections(split_filings(filings, ANNUAL, retry=True))


def split_current(filings: DataFrame) -> DataFrame:
    """Sections of current reports."""
    return sections(split_filings(filings, CURRENT))


def order_check(split: DataFrame) -> DataFrame:
    """X11: (filing_id, found_order joined by commas, order_correct) of filings with sections."""
    return split.where(F.size("found") > 0).select(KEY, F.array_join("found", ",").alias("found_order"), "order_correct")


def verdict(item: Column, words: Column, combined: Column, form: Form = ANNUAL) -> Column:
    """X14."""
    low, high = (F.create_map(*(F.lit(x) for i, b in form.bounds.items() for x in (i, b[k]))) for k in (0, 1))
    return (
        F.when((item == "2") & combined, "combined_with_item_1")
        .when(low[item].isNull(), "no_bounds_defined")
        .when(words < low[item], F.format_string("too_short (%dw, expected>=%d)", words, low[item]))
        .when(words > high[item], F.format_string("too_long (%dw, expected<=%d)", words, high[item]))
        .otherwise("ok")
    )


def verdicts(rows: DataFrame, form: Form = ANNUAL) -> DataFrame:
    """Sections with the column verdict."""
    return rows.withColumn("verdict", verdict(F.col("item"), F.col("words"), F.col("combined"), form))


def filing_status(split: DataFrame, form: Form = ANNUAL) -> DataFrame:
    """(filing_id, status, zero_occurrence, length_failures, earliest_match_pct), lists joined by commas."""
    judged = F.transform(F.array_sort("sections", lambda a, b: a["item_ord"] - b["item_ord"]), lambda s: F.struct(s["item"].alias("item"), verdict(s["item"], s["words"], s["combined"], form).alias("v")))
    bad = F.transform(F.filter(judged, lambda s: s["v"].startswith("too_")), lambda s: s["item"])
    zero = F.array_except(F.array(*(F.lit(i) for i in form.order)), F.transform("headers", lambda h: h["item"]))
    rows = split.select(KEY, "order_correct", "earliest_match_pct", F.size("sections").alias("n"), F.array_join(zero, ",").alias("zero_occurrence"), F.array_join(bad, ",").alias("length_failures"))
    status = (
        F.when(F.col("earliest_match_pct").isNotNull(), "incorporated_by_reference")
        .when(F.col("n") == 0, "failed")
        .when((F.col("zero_occurrence") != "") | ~F.col("order_correct") | (F.col("length_failures") != ""), "needs_review")
        .otherwise("verified")
    )
    return rows.select(KEY, status.alias("status"), "zero_occurrence", "length_failures", "earliest_match_pct")


def current_events(split: DataFrame) -> DataFrame:
    """(filing_id, status, items_found, event_types) of current reports, lists joined; every filing has a row."""
    labels = F.create_map(*(F.lit(x) for kv in EVENT_LABELS.items() for x in kv))
    rows = split.select(KEY, F.array_sort(F.array_distinct(F.transform("sections", lambda s: s["item"]))).alias("items"))
    status = F.when(F.size("items") == 0, "failed").when(F.array_join("items", ",") == EXHIBITS, "exhibits_only").otherwise("extracted")
    said = F.transform("items", lambda i: F.coalesce(labels[i], F.concat(F.lit("Item "), i)))
    return rows.select(KEY, status.alias("status"), F.array_join("items", ",").alias("items_found"), F.array_join(said, "; ").alias("event_types"))
