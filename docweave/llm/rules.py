"""Quality rules: decision lists learned by sequential covering, applied as Spark columns.

Statistics of every whole text are counted once. From labelled rows, rules are grown one condition
at a time (the threshold with the best information gain), pruned on rows held out, and kept while
they stay precise; rows that a rule covers leave before the next one is grown. The list becomes
one ordered CASE expression over the statistics.

Null texts count as empty: no words, so the base rule rejects them. Repeated rows are counted
each. Rows without a label, or with a null one, teach nothing; without labels of both kinds the list
is empty and keeps whatever the base rule keeps. An empty table gives an empty result.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bounded_sample, map_text

#: Labelled rows that rules are learned from, at most (statistics only, about 150 bytes each).
TRAIN_ROWS = 20_000
WHITE_SPACE = " \t\n\v\f\r"
SYMBOLS = "#*$%&|<>"
WINDOW = 5
#: Distinct words a task remembers the hash of.
TABLE_WORDS = 100_000

COUNTED = (
    "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
    "n_lines", "n_upper", "n_digits", "n_marks", "n_stops", "n_distinct_words",
)


class _Hashes(dict):
    def __missing__(self, word: bytes) -> int:
        self[word] = value = xxhash.xxh64_intdigest(word)
        return value


def repeated_words(hashes: np.ndarray) -> int:
    """Words inside windows of WINDOW words that occur twice or more."""
    n = len(hashes) - WINDOW + 1
    if n < 2:
        return 0
    windows = np.zeros(n, np.uint64)
    for i in range(WINDOW):
        windows = (windows ^ hashes[i : n + i]) * np.uint64(0x9E3779B97F4A7C15)
        windows ^= windows >> np.uint64(29)
    order = np.argsort(windows, kind="stable")
    same = windows[order][1:] == windows[order][:-1]
    if not same.any():
        return 0
    repeated = np.zeros(n + 1, bool)
    repeated[order[1:][same]] = True
    repeated[order[:-1][same]] = True
    covered = np.zeros(n + WINDOW, np.int64)
    starts = np.flatnonzero(repeated)
    np.add.at(covered, starts, 1)
    np.add.at(covered, starts + WINDOW, -1)
    return int((np.cumsum(covered)[: len(hashes)] > 0).sum())


def text_statistics(text: str, hashes: _Hashes) -> tuple:
    words = text.encode().split()
    if len(hashes) > TABLE_WORDS:
        hashes.clear()
    hashed = np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words))
    lines = [line for line in text.split("\n") if line.strip(WHITE_SPACE)]
    ascii_upper = sum(map(text.count, "ABCDEFGHIJKLMNOPQRSTUVWXYZ"))
    return (
        len(words),
        len(text) - sum(map(text.count, WHITE_SPACE)),
        sum(map(text.count, SYMBOLS)),
        sum(n - 1 for n in Counter(lines).values()),
        repeated_words(hashed),
        len(lines),
        ascii_upper,
        sum(map(text.count, "0123456789")),
        sum(map(text.count, "!?")),
        text.count("."),
        len(set(words)),
    )


def statistics(rows: DataFrame, text: str = "text", passed: dict[str, Column] | None = None) -> DataFrame:
    """The passed columns (doc_id unless given) and the counted statistics of each whole text."""

    def factory():
        hashes = _Hashes()
        return lambda texts: [text_statistics(one, hashes) for one in texts]

    made = ", ".join(f"{name} bigint" for name in COUNTED)
    return map_text(rows, text, passed, made, factory)


def base_failed() -> Column:
    words = F.col("n_words")
    return (words < 10) | (100 * F.col("n_repeat_words") > 20 * words)


def features() -> dict[str, Column]:
    """What conditions compare with a threshold; words and lines in a divisor are never zero here."""
    words = F.greatest(F.col("n_words"), F.lit(1))
    chars = F.greatest(F.col("word_chars"), F.lit(1))
    per_word = {
        name: F.col(name) / words
        for name in ("word_chars", "n_symbols", "n_repeat_words", "n_marks", "n_stops")
    }
    return {
        "n_words": F.col("n_words").cast("double"),
        **{f"{name}_per_word": column for name, column in per_word.items()},
        # Unlike their share, the logarithms' ratio hardly depends on how long a text is.
        "variety": F.log1p("n_distinct_words") / F.log1p(words),
        "upper_share": F.col("n_upper") / chars,
        "digit_share": F.col("n_digits") / chars,
        "dup_line_share": F.col("n_dup_lines") / F.greatest(F.col("n_lines"), F.lit(1)),
        "words_per_line": F.col("n_words") / F.greatest(F.col("n_lines"), F.lit(1)),
    }


Condition = tuple[str, str, float]


def _covers(conditions: list[Condition], values: dict[str, np.ndarray]) -> np.ndarray:
    covered = np.ones(len(next(iter(values.values()))), bool)
    for name, sign, threshold in conditions:
        covered &= values[name] >= threshold if sign == ">=" else values[name] <= threshold
    return covered


def _gain(p: float, n: float, p0: float, n0: float) -> float:
    return p * (np.log2(p / (p + n)) - np.log2(p0 / (p0 + n0))) if p else 0.0


def _grow(values: dict[str, np.ndarray], bad: np.ndarray, steps: int) -> list[Condition]:
    rule: list[Condition] = []
    inside = np.ones(len(bad), bool)
    while (inside & ~bad).any() and len(rule) < 4:
        p0, n0 = int((inside & bad).sum()), int((inside & ~bad).sum())
        best = (1e-9, None)
        for name, column in values.items():
            own = column[inside]
            # Thresholds lie halfway between neighbouring quantiles.
            cuts = np.unique(np.quantile(own, np.linspace(0, 1, steps)))
            for threshold in (cuts[1:] + cuts[:-1]) / 2:
                high = own >= threshold
                p, n = int(bad[inside][high].sum()), int((~bad[inside])[high].sum())
                for sign, a, b in ((">=", p, n), ("<=", p0 - p, n0 - n)):
                    if (gain := _gain(a, b, p0, n0)) > best[0]:
                        best = (gain, (name, sign, float(threshold)))
        if best[1] is None:
            break
        rule.append(best[1])
        inside = _covers(rule, values)
    return rule


def learn_rules(
    values: dict[str, np.ndarray], bad: np.ndarray, steps: int = 65, precision: float = 0.9
) -> list[list[Condition]]:
    """Ordered conjunctions that cover bad rows. Every third row is held out for pruning."""
    rules: list[list[Condition]] = []
    left = np.ones(len(bad), bool)
    held = np.arange(len(bad)) % 3 == 2
    while (left & bad & ~held).sum() >= 5:
        grow = left & ~held
        rule = _grow({k: v[grow] for k, v in values.items()}, bad[grow], steps)

        def worth(conditions: list[Condition]) -> float:
            covered = _covers(conditions, values) & left & held
            p, n = (covered & bad).sum(), (covered & ~bad).sum()
            return (p - n) / (p + n) if p + n else -1.0

        while len(rule) > 1:
            shorter = max((rule[:i] for i in range(1, len(rule))), key=worth)
            if worth(shorter) < worth(rule):
                break
            rule = shorter
        covered = _covers(rule, values) & left if rule else np.zeros(len(bad), bool)
        p = (covered & bad).sum()
        if not rule or p < 3 or p < precision * covered.sum():
            break
        rules.append(rule)
        left &= ~covered
    return rules


def verdict(rules: list[list[Condition]]) -> Column:
    """True if no rule rejects; an ordered CASE over the features."""
    columns = features()
    chain = None
    for rule in rules:
        condition = F.lit(True)
        for name, sign, threshold in rule:
            column = columns[name]
            condition = condition & (column >= threshold if sign == ">=" else column <= threshold)
        chain = F.when(condition, False) if chain is None else chain.when(condition, False)
    return F.lit(True) if chain is None else chain.otherwise(True)


def fit(stats: DataFrame, labels: DataFrame, train_rows: int = TRAIN_ROWS) -> list[list[Condition]]:
    """Rules from the rows of `stats` that `labels` (doc_id, quality) has, within the bound."""
    known = labels.where("quality IS NOT NULL").select(
        F.col("doc_id").alias("label_id"), F.col("quality")
    )
    joined = stats.select("doc_id", *COUNTED).join(known, F.col("doc_id") == F.col("label_id"))
    names = list(features())
    sample = bounded_sample(
        joined.select("doc_id", "quality", *[column.alias(name) for name, column in features().items()]),
        F.col("doc_id"),
        train_rows,
    )
    table = sample.toArrow().sort_by([("doc_id", "ascending"), *[(name, "ascending") for name in names]])
    if not table.num_rows:
        return []
    # Bad rows are dealt to both parts alike: sorted by label, then every third is held out.
    bad = table["quality"].to_numpy() == 0
    order = np.argsort(bad, kind="stable")
    values = {name: table[name].to_numpy()[order] for name in names}
    return learn_rules(values, bad[order])
