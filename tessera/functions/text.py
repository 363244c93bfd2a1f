"""Text as columns: white space, words, sentences and the financial filter. Null text gives null, or no sentences.

White space is Python's, in Java's and in DuckDB's patterns alike.
"""

from __future__ import annotations

import html
from html import entities

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WS = r"[\s\x{0B}\x{85}\x{1C}-\x{1F}\p{Z}]"
NOT_WS = r"[^\s\x{0B}\x{85}\x{1C}-\x{1F}\p{Z}]"
STRICT_BREAK = rf"(?<=[.!?]){WS}+(?=[A-Z])"
LOOSE_BREAK = r"""(?<=[.!?]) +(?=[A-Z("'])"""

_gap = r"\s+"
#: What no kept sentence has, by name. Words of a phrase are parted by any white space.
NOISE = {
    "checkbox": "[☑☐✓]",
    "numeric": r"^[-\d\s/.,()]+$",
    "zip": r"\b\d{5}(?:-\d{4})?\b.*zip",
    "phone": r"\(\d{3}\)\s*\d{3}[\s-]\d{4}",
    "data_id": r"[a-z]+-\d{8}\s+\d{7,}",
    "form": _gap.join(["form", "(?:20-f|10-q|10-k|8-k)"]),
    "exhibit": _gap.join(["exhibit", r"\d+\.\d+"]),
    "rule": _gap.join(["pursuant", "to", "rule", r"\d+"]),
    "by_reference": r"incorporated\s+(?:herein\s+)?by\s+reference",
    "telephone": r"registrant.s\s+telephone",
} | {
    p.replace(" ", "_"): _gap.join(p.split())
    for p in (
        "current report on form", "table of contents", "name of each exchange", "trading symbol", "address of principal", "irs employer",
        "state or other jurisdiction", "commission file number", "emerging growth company", "indicate by check mark", "check the appropriate box",
        "securities and exchange commission",
    )
}
#: Stems of which a kept sentence has one, wherever in a word.
STEMS = sorted(
    {"%", r"interest\s+rate"}
    | set(
        "acqui billion buyback capital cash charge competit cost customer debt declin decreas demand dividend divest earning employee equity expect "
        "expense fiscal forecast goodwill growth guidance headcount headwind impairment income increas inflation invest litigat loss margin market "
        "merger million operat opportunit outlook percent perform pric product profit quarter recession regulat restructur result return revenue "
        "risk sales segment service settlement share stock supply tailwind volume workforce write".split()
    )
)
NOISE_PATTERN = "|".join(f"(?:{p})" for p in NOISE.values())


def _any_of(words: list[str]) -> str:
    """A pattern that finds any of the words, which tries a letter once for all words that go on with it."""
    if "" in words:
        return ""
    heads = sorted({w[0] for w in words})
    branches = [h + _any_of([w[1:] for w in words if w[0] == h]) for h in heads]
    return branches[0] if len(branches) == 1 else f"(?:{'|'.join(branches)})"


STEM_PATTERN = _any_of([s for s in STEMS if s.isalpha()]) + "|" + "|".join(s for s in STEMS if not s.isalpha())
LEAST_WORDS, MOST_WORDS, LEAST_ALPHA = 8, 120, 0.45

def barrier(df: DataFrame, cols: dict[str, Column]) -> DataFrame:
    """df with more columns that are computed once, however often they are used: projections above a generator aren't merged into it."""
    return df.select(*df.columns, F.inline(F.array(F.struct(*(c.alias(k) for k, c in cols.items())))))


def collapse(text: Column) -> Column:
    """One space for each run of white space, none at the ends."""
    return F.trim(F.regexp_replace(text, f"{WS}+", " "))


def strip(text: Column) -> Column:
    return F.regexp_replace(text, rf"^{WS}+|{WS}+$", "")


def word_count(text: Column) -> Column:
    """T2."""
    return F.regexp_count(text, F.lit(f"{NOT_WS}+"))


def sentences(text: Column) -> Column:
    """Sentences of the collapsed text; a break is followed by a capital, a quote or a bracket."""
    return F.filter(F.split(collapse(text), LOOSE_BREAK), lambda s: s != "")


def strict_sentences(text: Column) -> Column:
    """Sentences of the text as it is, stripped; a break is followed by a capital."""
    return F.transform(F.split(text, STRICT_BREAK), strip)


def is_financial(s: Column) -> Column:
    """8 to 120 words, no noise, a financial stem, and letters for 45 % of its characters."""
    n = word_count(s)
    alpha = F.length(F.regexp_replace(s, r"[^\p{L}]", ""))
    return n.between(LEAST_WORDS, MOST_WORDS) & s.rlike(f"(?iu){STEM_PATTERN}") & ~s.rlike(f"(?iu){NOISE_PATTERN}") & (alpha >= LEAST_ALPHA * F.length(s))


def financial_sentences(text: Column) -> Column:
    """C5."""
    return F.filter(strict_sentences(text), is_financial)


# --- the same in DuckDB's SQL ------------------------------------------------------------------------------------------------

def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def collapse_sql(t: str) -> str:
    return f"trim(regexp_replace({t}, '{WS}+', ' ', 'g'))"


def strip_sql(t: str) -> str:
    return f"regexp_replace({t}, '^{WS}+|{WS}+$', '', 'g')"


def word_count_sql(t: str) -> str:
    return f"len(regexp_extract_all({t}, '{NOT_WS}+'))"


def sentences_sql(t: str) -> str:
    mark = r"regexp_replace(" + collapse_sql(t) + r""", '([.!?]) +([A-Z("''])', concat('\1', chr(1), '\2'), 'g')"""
    return f"list_filter(string_split({mark}, chr(1)), lambda s: s <> '')"


def strict_sentences_sql(t: str) -> str:
    mark = rf"regexp_replace({t}, '([.!?]){WS}+([A-Z])', concat('\1', chr(1), '\2'), 'g')"
    return f"list_transform(string_split({mark}, chr(1)), lambda s: {strip_sql('s')})"


def is_financial_sql(s: str) -> str:
    return (
        f"({word_count_sql(s)} BETWEEN {LEAST_WORDS} AND {MOST_WORDS} AND NOT regexp_matches({s}, {q('(?i)' + NOISE_PATTERN)}) AND regexp_matches({s}, {q('(?i)' + STEM_PATTERN)}) "
        f"AND length(regexp_replace({s}, '[^\\p{{L}}]', '', 'g')) >= {LEAST_ALPHA} * length({s}))"
    )


def _map_sql(pairs: dict) -> str:
    return "MAP {" + ", ".join(f"{q(k) if isinstance(k, str) else k}: {q(v)}" for k, v in pairs.items()) + "}"


def decode_entities_sql(t: str) -> str:
    """All entities of HTML 5, with and without a semicolon, decimal and hexadecimal, as Python's html.unescape."""
    odd = {n: html.unescape(f"&#{n};") for n in (*range(160), *range(0xFDD0, 0xFDF0), *(p << 16 | x for p in range(17) for x in (0xFFFE, 0xFFFF)))}
    odd = {n: c for n, c in odd.items() if c != chr(n)}
    bare = "|".join(sorted((k for k in entities.html5 if k[-1] != ";"), key=lambda k: (-len(k), k)))
    number = r"CASE WHEN regexp_matches(p, '^#[xX]') THEN TRY_CAST('0x' || regexp_extract(p, '^#[xX]([0-9a-fA-F]+)', 1) AS BIGINT) ELSE TRY_CAST(regexp_extract(p, '^#([0-9]+)', 1) AS BIGINT) END"
    char = f"(CASE WHEN n IS NULL OR n > 1114111 OR n BETWEEN 55296 AND 57343 THEN chr(65533) WHEN n IN ({', '.join(map(str, odd))}) THEN {_map_sql(odd)}[n] ELSE chr(n::INT) END)"
    name = r"regexp_extract(p, '^[^\t\n\f <&#;]{1,32};?')"
    known = f"{_map_sql(entities.html5)}"
    piece = (
        r"CASE WHEN regexp_matches(p, '^#([0-9]+|[xX][0-9a-fA-F]+)') "
        f"THEN list_transform([{number}], lambda n: {char})[1] || regexp_replace(p, '^#([0-9]+|[xX][0-9a-fA-F]+);?', '') "
        f"WHEN map_contains({known}, {name}) THEN {known}[{name}] || substr(p, length({name}) + 1) "
        f"WHEN regexp_matches(p, '^(?:{bare})') THEN {known}[regexp_extract(p, '^(?:{bare})')] || regexp_replace(p, '^(?:{bare})', '') ELSE '&' || p END"
    )
    return f"CASE WHEN contains({t}, '&') THEN list_transform([string_split({t}, '&')], lambda x: array_to_string(list_concat([x[1]], list_transform(x[2:], lambda p: {piece})), ''))[1] ELSE {t} END"
