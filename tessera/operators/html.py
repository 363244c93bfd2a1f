"""HTML as rows: text nodes with their place in the document, and elements.

One walk over a page gives both, so that they number the same nodes: every text that isn't blank once its entities are decoded, in document order.
A page is a row and its walk is narrow: nothing is shuffled. Rows with a null id go; a null page has no node. Rows that repeat give rows that repeat.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions.text import NOT_WS, decode_entities_sql, strip_sql

TOK = r"(?is)<!--.*?-->|<(?:script|style)\b[^>]*>.*?</(?:script|style)>|<[^>]*>|[^<]+"
_hidden = r"(?is)^<!--(.*)-->$|^<!(doctype[^>]*)>$|^<(?:script|style)\b[^>]*>(.*)</(?:script|style)>$"
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
#: Elements that a new one of this name ends.
ENDS = {"p": ("p",), "li": ("li",), "tr": ("td", "th", "tr"), "td": ("td", "th"), "th": ("td", "th")}
BLOCKS = frozenset("div table ul ol section article nav footer header h1 h2 h3 h4 h5 h6".split())
_tok = re.compile(TOK)
_name = re.compile(r"</?\s*([A-Za-z][\w:.-]*)")
_body = re.compile(_hidden)
#: Pages of which the rows are given out together.
SLICE = 64


def walk(page: str | None) -> tuple[list[tuple], list[list]]:
    """(nodes, elements) of a page.

    Nodes are (stripped text, in_a, in_table, visible); comments, the doctype and bodies of script and style are nodes that aren't visible. in_a: below a link, however deep.
    in_table: the element around it is below a table; text right below <table> isn't. Elements are [name, first node, last node + 1, in_a, in_table] by their start; a link is
    in_a itself, a table isn't in itself. An end tag without a start is nothing.
    """
    stack: list[list] = []
    nodes: list[tuple] = []
    elements: list[list] = []
    open_ = dict.fromkeys(("a", "table"), 0)
    decode, name_of, body_of = entities.unescape, _name.match, _body.match

    def close(at: int) -> None:
        for e in stack[at:]:
            e[2] = len(nodes)
            if e[0] in open_:
                open_[e[0]] -= 1
        del stack[at:]

    for tok in _tok.findall(page or ""):
        shown = tok[0] != "<"
        hidden = None
        if not shown and tok[1:2] in "!sS" and (hidden := body_of(tok)):
            tok = next((g for g in hidden.groups() if g is not None), "")
        if shown or hidden:
            text = (decode(tok) if shown and "&" in tok else tok).strip()
            if text:
                own_table = bool(stack) and stack[-1][0] == "table"
                nodes.append((text, open_["a"] > 0, open_["table"] > own_table, shown))
            continue
        found = name_of(tok)
        if not found:
            continue
        name = found[1].lower()
        if tok[1] == "/":
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == name:
                    close(k)
                    break
            continue
        if name in BLOCKS and stack and stack[-1][0] == "p":
            close(len(stack) - 1)
        if name in ENDS:
            ends = ENDS[name]
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] in ("table", "ul", "ol"):
                    break
                if stack[k][0] in ends:
                    close(k)
        e = [name, len(nodes), len(nodes), name == "a" or open_["a"] > 0, open_["table"] > 0]
        elements.append(e)
        if name not in VOID and not tok.endswith("/>"):
            stack.append(e)
            if name in open_:
                open_[name] += 1
    close(0)
    return nodes, elements


def short_elements(nodes: list[tuple], elements: list[list], longest: int) -> Iterator[tuple]:
    """(order, name, first node, text, in_a, in_table) of elements with a node whose visible text, joined without white space, has at most `longest` characters."""
    upto = [0]
    for text, _, _, shown in nodes:
        upto.append(upto[-1] + (len(text) if shown else 0))
    for order, (name, first, end, in_a, in_table) in enumerate(elements):
        if first < end and upto[end] - upto[first] <= longest:
            yield order, name, first, "".join([n[0] for n in nodes[first:end] if n[3]]), in_a, in_table


def each_page(rows: Callable[[str | None], list[tuple]], kinds: list[tuple[str, pa.DataType]]):
    """A function for mapInArrow over (id, page): the rows of each page behind its id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                some = batch.slice(at, SLICE)
                ids, out = [], []
                for key, page in zip(some.column(0).to_pylist(), some.column(1)):
                    found = rows(page.as_py())
                    ids.extend([key] * len(found))
                    out.extend(found)
                cols = zip(*out) if out else [()] * len(kinds)
                yield pa.RecordBatch.from_arrays([pa.array(ids, some.column(0).type), *(pa.array(c, t) for c, (_, t) in zip(cols, kinds))], names=["id", *(n for n, _ in kinds)])

    return run


def map_pages(pages: DataFrame, rows, kinds: list[tuple[str, pa.DataType]], schema: str, id_col: str, html_col: str) -> DataFrame:
    cut = pages.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(html_col).alias("html"))
    return cut.mapInArrow(each_page(rows, kinds), f"id {dict(cut.dtypes)['id']}, {schema}").withColumnRenamed("id", id_col)


def text_nodes(pages: DataFrame, count_nonvisible: bool = True, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """H1-H3: (id, node_idx, text, in_a, in_table, visible), see `walk`. What isn't visible has no number and no row without count_nonvisible."""

    def rows(page):
        nodes = [n for n in walk(page)[0] if count_nonvisible or n[3]]
        return [(k, *n) for k, n in enumerate(nodes)]

    kinds = [("node_idx", pa.int32()), ("text", pa.string()), ("in_a", pa.bool_()), ("in_table", pa.bool_()), ("visible", pa.bool_())]
    return map_pages(pages, rows, kinds, "node_idx int, text string, in_a boolean, in_table boolean, visible boolean", id_col, html_col)


def elements(pages: DataFrame, longest: int = 200, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """H4, H5: (id, tag_order, tag, node_idx, text, in_a, in_table) of `short_elements`; node_idx is the first text node's, of the numbers that `text_nodes` gives."""
    kinds = [("tag_order", pa.int32()), ("tag", pa.string()), ("node_idx", pa.int32()), ("text", pa.string()), ("in_a", pa.bool_()), ("in_table", pa.bool_())]
    schema = "tag_order int, tag string, node_idx int, text string, in_a boolean, in_table boolean"
    return map_pages(pages, lambda page: list(short_elements(*walk(page), longest)), kinds, schema, id_col, html_col)


def text_nodes_sql(table: str, id_col: str = "page_id", html_col: str = "html") -> str:
    """Tokens and running depths. Of pages whose tables have text in cells alone, and no end tag without a start."""
    hidden = "concat(" + ", ".join(f"regexp_extract(tok, '{_hidden}', {k})" for k in (1, 2, 3)) + ")"
    depth = lambda tag: rf"CASE WHEN regexp_matches(tok, '(?i)^<{tag}[\s>]') THEN 1 WHEN regexp_matches(tok, '(?i)^</{tag}\s*>') THEN -1 ELSE 0 END"
    return f"""
SELECT {id_col}, node_idx, text, in_a, in_table, visible FROM (
  SELECT {id_col}, n, visible, {strip_sql("raw")} AS text, (sum(n) OVER w - 1)::INT AS node_idx, sum(a) OVER w > 0 AS in_a, sum(t) OVER w > 0 AS in_table FROM (
    SELECT *, regexp_matches(raw, '{NOT_WS}')::INT AS n FROM (
      SELECT {id_col}, pos, tok[1] <> '<' AS visible, CASE WHEN tok[1] <> '<' THEN {decode_entities_sql("tok")} ELSE {hidden} END AS raw, {depth("a")} AS a, {depth("table")} AS t
      FROM (SELECT {id_col}, unnest(toks) AS tok, generate_subscripts(toks, 1) AS pos FROM (SELECT {id_col}, regexp_extract_all({html_col}, '{TOK}') AS toks FROM {table}))
    )
  ) WINDOW w AS (PARTITION BY {id_col} ORDER BY pos ROWS UNBOUNDED PRECEDING)
) WHERE n = 1"""


KEPT = frozenset("p div span td li h1 h2 h3 h4 section".split())


def repair_encoding(text: str) -> str:
    """H7: text that was UTF-8 but was read as Windows-1252, and curly quotes; anything else stays."""
    if re.search("[ÃÂâ][\u0080-¿‘-›€™œž¢]", text):
        try:
            text = text.encode("cp1252").decode()
        except UnicodeError:
            pass
    return text.translate({0x2018: "'", 0x2019: "'", 0x201C: '"', 0x201D: '"', 0xA0: " "})


_gone = re.compile(r"(?is)<!--.*?-->|<(script|style|ix:header|ix:nonnumeric|ix:nonfraction)\b[^>]*>.*?</\1\s*>|<!doctype[^>]*>")


def extract_text(page: str | None) -> str:
    """H6: the text of each listed element, so that of nested ones repeats; what only other elements hold is lost."""
    if not page:
        return ""
    nodes, found = walk(_gone.sub("", page))
    parts = [" ".join([n[0] for n in nodes[first:end]]) for name, first, end, _, _ in found if name in KEPT and first < end]
    return " ".join(repair_encoding(" ".join(parts)).split())


def with_extracted_text(pages: DataFrame, html_col: str = "html", to: str = "text") -> DataFrame:
    """H6 for each row, in Arrow batches; '' for null."""

    @F.pandas_udf("string")
    def extracted(column):
        return column.map(extract_text)

    return pages.withColumn(to, extracted(F.coalesce(html_col, F.lit(""))))
