"""Quality rules: a learned decision list.

Sequential covering over labelled documents, as in RIPPER: a rule grows by the threshold condition with the most FOIL gain until
it covers no good document, is pruned from its end by its worth on documents held out, and is kept if it is precise enough; what it covers is set aside
and the next rule grows. The list is an ordered conditional expression of Spark over features that are themselves Spark expressions.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Labelled documents that are learned from at most, those with the least hash of their id.
MAX_LABELLED = 20_000
PRECISION = 0.97
MAX_CONDITIONS = 3
MAX_RULES = 12
MIN_COVER = 3
SPACE = r"[ \t\n\x0B\f\r]+"


def with_features(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """The features of docs' texts, each named __f_ and its name, in front of docs' columns, which are named c0, c1 and so on: null where the text is null, and ratios where it has no character or word.

    They are generated, as filters on projected columns would be moved below and their texts cut into words again for each use.
    """
    at = docs.columns.index(text_col)
    docs = docs.toDF(*(f"c{i}" for i in range(len(docs.columns))))
    text_col = f"c{at}"
    text = docs[text_col]
    words, lines, n = F.col("__words"), F.col("__lines"), F.length(text)
    ratio = lambda a, b: F.try_divide(a.cast("double"), b.cast("double"))
    cols = {
        "n_words": F.size(words).cast("double"),
        "word_length": ratio(n, F.size(words)),
        "distinct_words": ratio(F.size(F.array_distinct(words)), F.size(words)),
        "distinct_lines": ratio(F.size(F.array_distinct(lines)), F.size(lines)),
        "symbols": ratio(n - F.length(F.translate(text, "#$%&*!|@^~<>{}=_\\", "")), n),
        "digits": ratio(n - F.length(F.translate(text, "0123456789", "")), n),
        "capitals": ratio(n - F.length(F.regexp_replace(text, r"\p{Lu}", "")), n),
    }
    cut = F.struct(F.array_remove(F.split(text, SPACE), "").alias("__words"), F.split(text, "\n").alias("__lines"))
    arrays = docs.select(F.inline(F.array(cut)), *docs.columns)
    return arrays.select(F.inline(F.array(F.struct(*(cols[c].alias(f"__f_{c}") for c in NAMES)))), *docs.columns)


NAMES = ["n_words", "word_length", "distinct_words", "distinct_lines", "symbols", "digits", "capitals"]


@dataclass(frozen=True)
class Condition:
    name: str
    above: bool
    threshold: float

    def holds(self, x: dict[str, np.ndarray]) -> np.ndarray:
        with np.errstate(invalid="ignore"):
            return x[self.name] > self.threshold if self.above else x[self.name] <= self.threshold

    def column(self, x: dict[str, Column]) -> Column:
        c = F.coalesce(x[self.name], F.lit(float("nan")))
        return ~F.isnan(c) & ((c > self.threshold) if self.above else (c <= self.threshold))

    def __str__(self) -> str:
        return f"{self.name} {'>' if self.above else '<='} {self.threshold:.6g}"


Rule = tuple[Condition, ...]


def _covers(rule: Rule, x: dict[str, np.ndarray], n: int) -> np.ndarray:
    out = np.ones(n, bool)
    for c in rule:
        out &= c.holds(x)
    return out


def _best(x: dict[str, np.ndarray], bad: np.ndarray, at: np.ndarray) -> tuple[float, float, Condition] | None:
    """The condition with the most gain over the rows `at`; of equal ones, that with the widest gap about its threshold."""
    p0, n0 = bad[at].sum(), (~bad[at]).sum()
    base, best = np.log2(p0 / (p0 + n0)), None
    for name in NAMES:
        v = x[name][at]
        ok = ~np.isnan(v)
        v, y = v[ok], bad[at][ok]
        if not len(v):
            continue
        order = np.argsort(v, kind="stable")
        v, y = v[order], y[order]
        cut = np.flatnonzero(np.diff(v) > 0)
        if not len(cut):
            continue
        p_low, n_low = np.cumsum(y)[cut], np.cumsum(~y)[cut]
        gap = (v[cut + 1] - v[cut]) / (v[-1] - v[0])
        for above, p, n in ((False, p_low, n_low), (True, y.sum() - p_low, (~y).sum() - n_low)):
            with np.errstate(divide="ignore", invalid="ignore"):
                gain = np.where(p > 0, p * (np.log2(p / (p + n)) - base), -1.0)
            k = int(np.lexsort((gap, gain.round(9)))[-1])
            found = (round(float(gain[k]), 9), float(gap[k]), Condition(name, above, float((v[cut[k]] + v[cut[k] + 1]) / 2)))
            if gain[k] > 1e-9 and (best is None or found[:2] > best[:2]):
                best = found
    return best


def learn(x: dict[str, np.ndarray], bad: np.ndarray, held_out: np.ndarray) -> list[Rule]:
    """Rules for the bad documents; held_out: the rows that rules are pruned on. Without both kinds there are none."""
    rules: list[Rule] = []
    left = np.ones(len(bad), bool)
    while len(rules) < MAX_RULES and (left & bad).sum() >= MIN_COVER:
        rule: Rule = ()
        at = np.flatnonzero(left & ~held_out)
        while len(rule) < MAX_CONDITIONS and bad[at].any() and not bad[at].all():
            found = _best(x, bad, at)
            if not found:
                break
            rule += (found[2],)
            at = at[found[2].holds({k: v[at] for k, v in x.items()})]
        worth = []
        for k in range(1, len(rule) + 1):
            hit = _covers(rule[:k], x, len(bad)) & left & held_out
            p, n = (hit & bad).sum(), (hit & ~bad).sum()
            worth.append(((p - n) / (p + n) if p + n else -1.0, -k))
        if worth:
            rule = rule[: -max(worth)[1]]
        hit = _covers(rule, x, len(bad)) & left
        if not rule or (hit & bad).sum() < MIN_COVER or (hit & bad).sum() < PRECISION * hit.sum():
            break
        rules.append(rule)
        left &= ~hit
    return rules


def fit(docs: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED, id_col: str = "doc_id", text_col: str = "text") -> list[Rule]:
    """Rules learned from labels (doc_id, quality), bad where 0; null ids and qualities are no labels, of several the least counts. Rows of docs that repeat as a whole count once, and those of one id
    with other texts each; without labels or documents there is no rule.

    At most max_labelled labels are used, those with the least hash of their id; their ids are what is broadcast.
    """
    known = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    known = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_labelled)
    text = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).join(F.broadcast(known), "doc_id").select("doc_id", "quality", "text")
    rows = with_features(text).select(F.col("c0").alias("doc_id"), F.col("c1").alias("quality"), *(F.col(f"__f_{c}").alias(c) for c in NAMES)).toPandas()
    rows = rows.drop_duplicates().sort_values(["doc_id", *NAMES], kind="stable")
    x = {c: rows[c].to_numpy(float) for c in NAMES}
    held_out = rows["doc_id"].map(lambda d: hash((int(d) * 2654435761) >> 7) % 3 == 0).to_numpy(bool)
    return learn(x, (rows["quality"] == 0).to_numpy(bool), held_out)


def decide(rules: list[Rule]) -> Column:
    """The number, from 1, of the first rule that holds for the features; 0 if none does."""
    x, out = {c: F.col(f"__f_{c}") for c in NAMES}, None
    for k, rule in enumerate(rules, 1):
        holds = rule[0].column(x)
        for c in rule[1:]:
            holds &= c.column(x)
        out = (F if out is None else out).when(holds, k)
    return F.lit(0) if out is None else out.otherwise(0)


def judge(docs: DataFrame, rules: list[Rule], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, rule, reason, rejected), one row for each row of docs. A null or empty text is kept: no condition holds without a value. Rows that repeat are judged alike."""
    said = F.element_at(F.array(F.lit(""), *(F.lit(" and ".join(map(str, r))) for r in rules)), F.col("rule") + 1)
    found = with_features(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))).select(F.col("c0").alias("doc_id"), decide(rules).alias("rule"))
    return found.select("doc_id", "rule", said.alias("reason"), (F.col("rule") > 0).alias("rejected"))


def keep_good(docs: DataFrame, rules: list[Rule], text_col: str = "text") -> DataFrame:
    """The rows of docs that no rule rejects, as they are, those that repeat and those with nulls among them; of an empty table none."""
    rows = with_features(docs, text_col).where(decide(rules) == 0)
    return rows.select(*(f"c{i}" for i in range(len(docs.columns)))).toDF(*docs.columns)
