"""Quality rules: decision lists learned from labelled statistics by sequential covering.

A rule is a conjunction of thresholds on statistics.  It is grown on two thirds of the
labelled rows by information gain until it covers rejected rows only, pruned on the other
third to the prefix with the best (p - n) / (p + n), and kept if it is precise; the rows it
covers are taken out and the next one is learned.  The list becomes one ordered
Spark conditional expression, so that applying it needs no Python.

Learning uses about ``SAMPLE`` labelled ids at most, those whose hash is below a threshold that
follows from the number of labels, and one row for each; statistics are computed and rules
are applied over all documents.  ``MAX_RULES`` and ``MAX_CONDITIONS`` keep the list readable, and a
rule needs ``LEAST`` rejected rows; documents that no rule reaches stay.

Defined cases: null text has no words and fails the base rule; labels that are null or that
belong to no document are ignored; a doc_id labelled twice takes the larger quality, one of
several texts is learned from by the least of their statistics; with
no labels, or none of one kind, the list is empty and only the base rule decides; repeated
rows repeat results; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import columns, materialize, packed, unpacked
from .stats import BASE, RATIOS, measured, stat_table

SAMPLE = 60_000
MAX_RULES, MAX_CONDITIONS = 64, 4
#: A rule must reach this share of rejected rows among all it covers
PRECISION = 0.97
#: and cover so many rejected rows.
LEAST = 5
THRESHOLDS = 48


@dataclass(frozen=True)
class Condition:
    name: str
    above: bool
    at: float

    def column(self, of: dict[str, Column] | None = None) -> Column:
        value = (of or {}).get(self.name, F.col(self.name))
        return value >= self.at if self.above else value < self.at

    def mask(self, x: np.ndarray, names: tuple[str, ...]) -> np.ndarray:
        v = x[:, names.index(self.name)]
        return v >= self.at if self.above else v < self.at

    def __str__(self) -> str:
        return f"{self.name} {'>=' if self.above else '<'} {self.at:.6g}"


Rule = tuple[Condition, ...]


def covers(rule: Rule, x: np.ndarray, names: tuple[str, ...]) -> np.ndarray:
    out = np.ones(len(x), bool)
    for c in rule:
        out &= c.mask(x, names)
    return out


def _best(x: np.ndarray, bad: np.ndarray, names: tuple[str, ...]) -> Condition | None:
    """The condition with the largest information gain (FOIL) over the rows."""
    p0, n0 = bad.sum(), (~bad).sum()
    base = np.log2((p0 + 1) / (p0 + n0 + 1))
    best, gain = None, 1e-9
    for k, name in enumerate(names):
        v = x[:, k]
        order = np.argsort(v, kind="stable")
        sorted_v, cum = v[order], np.concatenate(([0], np.cumsum(bad[order])))
        at = np.unique(np.quantile(np.unique(sorted_v), np.linspace(0, 1, THRESHOLDS + 2)[1:-1]))
        i = np.searchsorted(sorted_v, at, "left")
        for above, p, size in ((True, cum[-1] - cum[i], len(v) - i), (False, cum[i], i)):
            g = np.where((p >= LEAST) & (size < len(v)), p * (np.log2((p + 1) / (size + 1)) - base), 0)
            j = int(np.argmax(g)) if len(g) else 0
            if len(g) and g[j] > gain:
                best, gain = Condition(name, above, float(at[j])), g[j]
    return best


def grow(x: np.ndarray, bad: np.ndarray, names: tuple[str, ...]) -> Rule:
    rule: list[Condition] = []
    while len(rule) < MAX_CONDITIONS and (~bad).any():
        c = _best(x, bad, names)
        if c is None:
            break
        rule.append(c)
        keep = c.mask(x, names)
        x, bad = x[keep], bad[keep]
    return tuple(rule)


def prune(rule: Rule, x: np.ndarray, bad: np.ndarray, fold: np.ndarray, names: tuple[str, ...]) -> tuple[Rule, float]:
    """The prefix with the best worth on the rows it was not grown on (``fold``), and on all
    rows if that ties; and its precision over all rows."""
    best, worth, precision = (), (-2.0, -2.0), 0.0
    for n in range(1, len(rule) + 1):
        hit = covers(rule[:n], x, names)
        w = tuple(_worth(hit & part, bad) for part in (fold, np.ones(len(x), bool)))
        if w > worth:
            best, worth, precision = rule[:n], w, (w[1] + 1) / 2
    return best, precision


def _worth(hit: np.ndarray, bad: np.ndarray) -> float:
    """(p - n) / (p + n) of the rows that a rule covers."""
    p, n = int((hit & bad).sum()), int((hit & ~bad).sum())
    return (p - n) / (p + n) if p + n else -1.0


def learn(x: np.ndarray, bad: np.ndarray, fold: np.ndarray, names: tuple[str, ...] = RATIOS) -> list[Rule]:
    """Ordered rules that reject; ``fold`` is true for rows to prune on."""
    rules: list[Rule] = []
    while len(rules) < MAX_RULES and (bad & ~fold).sum() >= LEAST:
        rule, precision = prune(grow(x[~fold], bad[~fold], names), x, bad, fold, names)
        hit = covers(rule, x, names) if rule else np.zeros(len(x), bool)
        if precision < PRECISION or (hit & bad).sum() < LEAST:
            break
        rules.append(rule)
        x, bad, fold = x[~hit], bad[~hit], fold[~hit]
    return rules


def verdict(rules: list[Rule], of: dict[str, Column] | None = None) -> Column:
    """The number of the first rule that fires, from 1, or 0."""
    out = F.lit(0)
    for k, rule in reversed(list(enumerate(rules, 1))):
        where = rule[0].column(of)
        for c in rule[1:]:
            where = where & c.column(of)
        out = F.when(where, F.lit(k)).otherwise(out)
    return out


def known_labels(labels: DataFrame) -> DataFrame:
    """doc_id, __quality: one row for each labelled id."""
    return labels.where("quality IS NOT NULL AND doc_id IS NOT NULL").groupBy("doc_id").agg(F.max("quality").alias("__quality"))


def labelled(stats: DataFrame, labels: DataFrame) -> DataFrame:
    return stats.join(known_labels(labels), "doc_id")


def sample_labels(labels: DataFrame, most: int = SAMPLE) -> DataFrame:
    """doc_id, __quality of about ``most`` ids, by a threshold on their hash; no sort."""
    y = known_labels(labels)
    n = y.count()
    place = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30))
    return y if n <= most else y.where(place < F.lit(int((1 << 30) * most / n)))


def fit(stats: DataFrame, sampled: DataFrame) -> list[Rule]:
    """Rules from the rows of ``sampled(doc_id, __quality)``, a bounded table."""
    rows = stats.select("doc_id", F.struct(*RATIOS).alias("x")).join(F.broadcast(sampled), "doc_id")
    rows = rows.groupBy("doc_id", "__quality").agg(F.min("x").alias("x")).select("x.*", "__quality", F.xxhash64("doc_id").alias("__h"))
    rows = rows.toPandas().sort_values(["__h", *RATIOS])
    x = rows[list(RATIOS)].to_numpy(float).reshape(-1, len(RATIOS))
    return learn(x, (rows["__quality"] == 0).to_numpy(bool), (rows["__h"].to_numpy("int64") % 3 == 0))


BASE_FAILED = "n_words < 10 OR 100 * n_repeat_words > 20 * n_words"


def judged(stats: DataFrame, rules: list[Rule]) -> DataFrame:
    """doc_id, the base counts, base_failed, kept, and the number of the rule that decided."""
    failed = F.expr(BASE_FAILED)
    rule = verdict(rules)
    return stats.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        failed.alias("base_failed"), (~failed & (rule == 0)).alias("kept"), F.when(failed, F.lit(0)).otherwise(rule).alias("rule"),
    )


def rule_table(docs: DataFrame, labels: DataFrame) -> DataFrame:
    stats = materialize(stat_table(docs), "stats")
    return judged(stats, fit(stats, sample_labels(labels)))


def keep_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that the rules keep, with the columns of ``docs``.

    Rules are learned from the documents of a bounded set of labelled ids, found by its
    broadcast; all documents are then measured and judged where they stand, so that texts are
    never shuffled.
    """
    y = sample_labels(labels)
    some = columns(docs, "doc_id", "text").join(F.broadcast(y.select("doc_id")), "doc_id", "left_semi")
    rules = fit(stat_table(some), y)
    wide = packed(docs, "text").withColumn("__stats", measured(F.col("text")))
    names = {c: F.col(f"__stats.{c}") for c in (*BASE, *RATIOS)}
    judge = ~F.expr(re.sub(r"\bn_", "__stats.n_", BASE_FAILED)) & (verdict(rules, names) == 0)
    return unpacked(wide.where(judge), docs.columns)
