"""Items of annual and current reports: headers, bounds, names and thresholds."""

from __future__ import annotations

import re
from dataclasses import dataclass, field


def _header(number: str, *words: str) -> str:
    """The words of a header, with or without white space, as text joined from several elements has none."""
    return r"\s*".join(["item", number + r"\.?", *words])


@dataclass(frozen=True)
class Form:
    """How a kind of report is split. patterns: of each item in order; of those that match a text the first counts."""

    patterns: dict[str, list[str]]
    longest_header: int
    toc: float
    bounds: dict[str, tuple[int, int]] = field(default_factory=dict)
    page_references: bool = False
    far: float | None = None
    one_item_a_text: bool = False
    generic: str | None = None
    boundary_only: str | None = None

    @property
    def order(self) -> list[str]:
        return list(self.patterns)


ANNUAL = Form(
    patterns={
        "1": [_header("1", "business"), r"items?\s*1\s*(?:&|and)\s*2\.?\s*business", _header("1", "business", "and", "properties")],
        "1A": [_header("1a", "risk", "factors")],
        "1B": [_header("1b", "unresolved", "staff")],
        "2": [_header("2", "properties")],
        "3": [_header("3", "legal", "proceedings")],
        "5": [_header("5", "market", w) for w in ("for", "information")],
        "7": [_header("7", "management")],
        "7A": [_header("7a", "quantitative")],
        "8": [_header("8", "financial", "statements")],
        "9": [_header("9", "changes", "in")],
        "9A": [_header("9a", "controls")],
        "10": [_header("10", "directors")],
    },
    longest_header=200,
    toc=0.08,
    bounds=dict(
        zip(
            "1 1A 1B 2 3 5 7 7A 8 9 9A".split(),
            zip((200, 500, 0, 10, 10, 20, 200, 10, 10, 0, 10), (30000, 35000, 3000, 5000, 8000, 5000, 60000, 15000, 80000, 5000, 5000)),
        )
    ),
    page_references=True,
    far=0.80,
    boundary_only="10",
)
#: Patterns of item 1 that are headers of items 1 and 2.
COMBINED = (1, 2)
PAGE_REFERENCE = r"\bpages?\s*\d"
TRAILING_DIGITS = r"\d+\s*$"


def _event(number: str, *titles: str) -> list[str]:
    title = "|".join(t.replace(" ", r"\s*") for t in titles)
    return [r"item\s*" + re.escape(number) + r"[-.\s]*" + (f"(?:{title})" if len(titles) > 1 else title)]


_EVENTS = """
1.01|Entry into Material Agreement|entry into,material definitive
1.02|Termination of Material Agreement|termination
1.03|Bankruptcy or Receivership|bankruptcy
2.01|Completion of Acquisition/Disposition|completion,acquisition,disposition
2.02|Results of Operations (Earnings)|results of operations
2.03|Creation of Financial Obligation|creation,direct financial
2.04|Triggering Event on Obligation|triggering
2.05|Departure/Election of Directors/Officers|departure,directors,officers
2.06|Amendments to Articles|amendments
3.01|Notice of Delisting|delisting,notice
3.02|Unregistered Sales of Equity|unregistered
4.01|Change in Certifying Accountant|changes,accountant
5.01|Change in Control|changes in control
5.02|Departure/Appointment of Officers|departure,appointment,officers,directors
5.03|Amendments / Fiscal Year Change|amendments,fiscal year
5.07|Submission to Shareholder Vote|submission,vote
6.01|ABS Informational|abs
7.01|Regulation FD Disclosure|regulation fd,reg fd
8.01|Other Events|other events
9.01|Financial Statements and Exhibits|financial statements,exhibits
"""
_events = [line.split("|") for line in _EVENTS.split("\n") if line]
CURRENT = Form(
    patterns={n: _event(n, *titles.split(",")) for n, _, titles in _events},
    longest_header=300,
    toc=0.10,
    one_item_a_text=True,
    generic=r"^item\s*(\d+\.\d+)",
)
EVENT_LABELS = {n: label for n, label, _ in _events}
EXHIBITS = "9.01"

_SECTIONS = """
1|.55|Business
1A|.40|Risk Factors
1B|.65|Unresolved Staff Comments
2|.55|Properties
3|.50|Legal Proceedings
5|.55|Market for Registrant
7|.62|MD&A
7A|.50|Quantitative Disclosures
8|.68|Financial Statements
9|.62|Changes in Accountants
9A|.55|Controls and Procedures
1.01|.62|Entry into Material Agreement
1.02|.62|Termination of Agreement
2.01|.62|Completion of Acquisition
2.02|.62|Results of Operations
2.03|.60|Creation of Financial Obligation
2.05|.62|Departure of Officers
5.02|.62|Departure/Appointment of Officers
7.01|.58|Regulation FD Disclosure
8.01|.58|Other Events
9.01|.70|Financial Statements and Exhibits
"""
_sections = [line.split("|") for line in _SECTIONS.split("\n") if line]
SECTION_NAMES = {k: name for k, _, name in _sections}
THRESHOLDS = {k: float(t) for k, t, _ in _sections}
DEFAULT_THRESHOLD = 0.50

STOPWORDS = sorted(
    "a all also an and any are as at be been but by can could did do does for from had has have if in is it its may might more most no not of on or other our should such than that "
    "the their these they this those to us was we were which who will with would".split()
)
