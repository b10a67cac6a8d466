"""Quality rules: text statistics, and decision lists learned from labelled statistics.

Sequential covering: a rule is a conjunction of thresholds, grown by information gain on two
thirds of the labelled rows, pruned on the rest and kept only if it is precise there; what it
covers is set aside and the next rule is grown.  The list comes out as one ordered ``CASE``.
"""
from __future__ import annotations

from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

#: Labelled rows that the learner looks at, at most; they are those with the smallest hashed ids.
MAX_LABELLED = 20_000
SYMBOLS = b"#*$%&|<>"
STATS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_bangs", "n_capitals", "n_distinct")
SCHEMA = "doc_id long, " + ", ".join(f"{s} long" for s in STATS)
#: Ratios that rules may test, as (name, numerator, denominator).
FEATURES = (
    ("symbol_ratio", "n_symbols", "n_words"),
    ("word_length", "word_chars", "n_words"),
    ("dup_line_ratio", "n_dup_lines", "n_words"),
    ("repeat_ratio", "n_repeat_words", "n_words"),
    ("bang_ratio", "n_bangs", "n_words"),
    ("capital_ratio", "n_capitals", "word_chars"),
    ("distinct_ratio", "n_distinct", "n_words"),
)


def repeated_words(words: list[bytes]) -> int:
    """Words inside a 3-word window that occurs at least twice."""
    windows = list(zip(words, words[1:], words[2:]))
    if len(set(windows)) == len(windows):
        return 0
    count = Counter(windows)
    total, end = 0, 0
    for i, w in enumerate(windows):
        if count[w] > 1:
            total += i + 3 - max(i, end)
            end = i + 3
    return total


def text_stats(text: bytes) -> tuple[int, ...]:
    words = text.split()  # of bytes: breaks at exactly 09-0D and 20
    lines = [x for x in text.split(b"\n") if x and not x.isspace()]
    raw = np.frombuffer(text, np.uint8)
    breaks = int(np.count_nonzero((raw == 32) | ((raw >= 9) & (raw <= 13))))
    points = int(np.count_nonzero((raw & 0xC0) != 0x80))
    capitals = int(np.count_nonzero((raw >= 65) & (raw <= 90)))
    symbols = sum(text.count(s) for s in (b"#", b"*", b"$", b"%", b"&", b"|", b"<", b">"))
    return len(words), points - breaks, symbols, len(lines) - len(set(lines)), repeated_words(words), text.count(b"!"), capitals, len(set(words))


def statistics(docs: DataFrame) -> DataFrame:
    """doc_id and STATS of every whole text; null texts have zeros.  One narrow pass."""

    def run(batches):
        for whole in batches:
            for b in common.pieces(whole):
                rows = [text_stats(t) for t in common.blobs(b.column(1))]
                cols = [pa.array(c, pa.int64()) for c in zip(*rows)]
                yield pa.RecordBatch.from_arrays([b.column(0), *cols], names=["doc_id", *STATS])

    return docs.select(*common.doc_columns(docs, "doc_id")).mapInArrow(common.tidy(run), SCHEMA)


def ratio(a, b):
    return a / b if b else 0.0


@dataclass(frozen=True)
class Test:
    feature: int
    above: bool  # value >= threshold, else value < threshold
    threshold: float

    def holds(self, x: np.ndarray) -> np.ndarray:
        v = x[:, self.feature]
        return v >= self.threshold if self.above else v < self.threshold

    def column(self) -> Column:
        name, num, den = FEATURES[self.feature]
        value = F.when(F.col(den) > 0, F.col(num) / F.col(den)).otherwise(F.lit(0.0))
        return value >= F.lit(self.threshold) if self.above else value < F.lit(self.threshold)

    def __str__(self) -> str:
        return f"{FEATURES[self.feature][0]} {'>=' if self.above else '<'} {self.threshold:.6g}"


Rule = tuple[Test, ...]


def covers(rule: Rule, x: np.ndarray) -> np.ndarray:
    out = np.ones(len(x), bool)
    for t in rule:
        out &= t.holds(x)
    return out


def _best_test(x: np.ndarray, bad: np.ndarray) -> tuple[float, Test | None]:
    """The threshold with the most information gain: midpoints between neighbouring values."""
    p0, n0 = bad.sum(), (~bad).sum()
    base = np.log2(p0 / (p0 + n0))
    best: tuple[float, Test | None] = (1e-9, None)
    for f in range(x.shape[1]):
        order = np.argsort(x[:, f], kind="stable")
        v, y = x[order, f], bad[order]
        cut = np.flatnonzero(v[1:] != v[:-1]) + 1
        if not len(cut):
            continue
        below = np.concatenate(([0], np.cumsum(y)))[cut].astype(float)
        for above, p, t in ((False, below, cut.astype(float)), (True, p0 - below, len(v) - cut.astype(float))):
            with np.errstate(divide="ignore", invalid="ignore"):
                gain = np.where(p > 0, p * (np.log2(p / t) - base), -1)
            k = int(np.argmax(gain))
            if gain[k] > best[0]:
                best = float(gain[k]), Test(f, above, float((v[cut[k] - 1] + v[cut[k]]) / 2))
    return best


def learn(x: np.ndarray, bad: np.ndarray, held: np.ndarray, precision: float = 0.98, max_rules: int = 12, max_tests: int = 4) -> list[Rule]:
    """Ordered rules for the ``bad`` rows.  ``held`` marks the rows that prune and accept rules.

    Deterministic: of thresholds with equal gain the first feature, then the lowest, then "below" wins.  No rows
    of one of the classes: no rules.
    """
    rules: list[Rule] = []
    grow, prune = ~held, held
    while len(rules) < max_rules and (bad & grow).any() and (bad & prune).any():
        rule: Rule = ()
        inside = grow.copy()
        while len(rule) < max_tests and (~bad & inside).any():
            _, test = _best_test(x[inside], bad[inside])
            if test is None:
                break
            rule += (test,)
            inside &= test.holds(x)

        def worth(r: Rule) -> float:
            c = covers(r, x) & prune
            p, n = (c & bad).sum(), (c & ~bad).sum()
            return (p - n) / (p + n) if p + n else -1.0

        while len(rule) > 1 and worth(rule[:-1]) >= worth(rule):
            rule = rule[:-1]
        c = covers(rule, x)
        p, n = (c & bad & prune).sum(), (c & ~bad & prune).sum()
        if not rule or p == 0 or p < precision * (p + n):
            break
        rules.append(rule)
        grow, prune = grow & ~c, prune & ~c
    return rules


def verdict(rules: list[Rule]) -> Column:
    """Ordered conditional: the first rule that fits rejects, else the row is kept."""
    out = None
    for rule in rules:
        test = rule[0].column()
        for t in rule[1:]:
            test = test & t.column()
        out = (F if out is None else out).when(test, F.lit(False))
    return out.otherwise(F.lit(True)) if out is not None else F.lit(True)


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (F.col("n_repeat_words") * 100 > F.col("n_words") * 50)


def learn_from(docs: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED) -> list[Rule]:
    """Rules from at most ``max_labelled`` labelled rows; only those rows come to the driver, as numbers.

    Rows that the base thresholds reject take no part.  Conflicting labels of one id: the lowest.
    """
    chosen = labels.select(labels["doc_id"].cast("long").alias("doc_id"), labels["quality"].cast("int").alias("quality")).dropna().groupBy("doc_id").agg(F.min("quality").alias("quality"))
    chosen = chosen.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_labelled)
    wanted = docs.select(*common.doc_columns(docs, "doc_id")).join(F.broadcast(chosen.select("doc_id")), "doc_id", "left_semi")
    known = statistics(wanted).filter(~base_failed()).join(F.broadcast(chosen), "doc_id")
    one = known.groupBy("doc_id", "quality").agg(F.min(F.struct(*STATS)).alias("s"))  # an id's first row only
    rows = one.select("doc_id", "quality", "s.*").collect()
    rows = sorted(map(tuple, rows))
    if not rows:
        return []
    at = {s: i + 2 for i, s in enumerate(STATS)}
    x = np.array([[ratio(r[at[a]], r[at[b]]) for _, a, b in FEATURES] for r in rows])
    bad = np.array([r[1] == 0 for r in rows])
    return learn(x, bad, np.array([r[0] % 3 == 2 for r in rows]))


def judge(docs: DataFrame, rules: list[Rule]) -> DataFrame:
    """doc_id, STATS, base_failed and kept for each row of ``docs``.

    Null or empty texts have no words and so fail the base thresholds; repeated rows are judged one
    by one; very long texts are judged whole, with memory in proportion; an empty table gives no rows; only doc_id
    and text are read.
    """
    s = statistics(docs)
    return s.select("*", base_failed().alias("base_failed"), (~base_failed() & verdict(rules)).alias("kept"))


def filter_documents(docs: DataFrame, rules: list[Rule]) -> DataFrame:
    """The rows of ``docs`` that pass, with all their columns (one text column), without a join.

    The statistics are computed beside the row in the pass that reads it.  Null and empty texts go; very long
    ones are judged whole; an empty table gives no rows; repeated rows are judged one by one.
    """
    names = docs.columns
    inner = docs.select(*[common.of(docs, c).alias(f"c{i}") for i, c in enumerate(names)])
    text = f"c{names.index('text')}"
    at = inner.columns.index(text)

    def run(batches):
        for whole in batches:
            for b in common.pieces(whole):
                rows = [text_stats(t) for t in common.blobs(b.column(at).cast(pa.string()))]
                cols = [pa.array(c, pa.int64()) for c in zip(*rows)]
                yield pa.RecordBatch.from_arrays([*b.columns, *cols], names=[*b.schema.names, *STATS])

    out = inner.mapInArrow(common.tidy(run), common.with_fields(inner.schema, ", ".join(f"{s} long" for s in STATS)))
    kept = out.filter(~base_failed() & verdict(rules))
    return kept.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(names)])
