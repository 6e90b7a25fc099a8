"""Quality rules: boosted trees over document statistics."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowlens.llm.common import BLANKS, add_columns, bounded_sample, folds, sigmoid

SYMBOLS = "#*$%&|<>"
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
FEATURES = ("log_words", "word_length", "symbol_share", "dup_line_share", "repeat_share",
            "upper_share", "digit_share", "mark_share", "distinct_share", "line_words", "same_next_share")
# +1: the score may only rise with the feature, -1: only fall.
MONOTONE = {"symbol_share": -1, "dup_line_share": -1, "repeat_share": -1, "same_next_share": -1}

_UPPER = [chr(c) for c in range(65, 91)]
_DIGITS = [chr(c) for c in range(48, 58)]
_MARKS = "!?;:,."


def repeated_words(ids: np.ndarray, n: int) -> int:
    """Words that lie in a three-word window found at least twice."""
    if n < 4:
        return 0
    base = np.int64(ids.max()) + 1
    if base < 2_000_000:
        codes = (ids[:-2] * base + ids[1:-1]) * base + ids[2:]
    else:
        pairs = np.unique(ids[:-2] * base + ids[1:-1], return_inverse=True)[1]
        codes = pairs * base + ids[2:]
    _, inverse, counts = np.unique(codes, return_inverse=True, return_counts=True)
    hit = counts[inverse] > 1
    covered = np.zeros(n, bool)
    for k in range(3):
        covered[k:n - 2 + k] |= hit
    return int(covered.sum())


def statistics(text: str | None) -> tuple[list[int], list[float]]:
    """The five counts and the features of a text; null counts as empty."""
    text = text or ""
    words = text.encode().split()
    n = len(words)
    seen: dict[bytes, int] = {}
    ids = np.fromiter((seen.setdefault(w, len(seen)) for w in words), np.int64, n)
    word_chars = len(text) - sum(text.count(c) for c in BLANKS)
    symbols = sum(text.count(c) for c in SYMBOLS)
    lines, with_word, dup_lines = set(), 0, 0
    for line in text.split("\n"):
        if line.strip(BLANKS):
            with_word += 1
            dup_lines += line in lines
            lines.add(line)
    repeats = repeated_words(ids, n)
    chars, many = max(word_chars, 1), max(n, 1)
    features = [
        float(np.log1p(n)), word_chars / many, symbols / chars, dup_lines / max(with_word, 1), repeats / many,
        sum(text.count(c) for c in _UPPER) / chars, sum(text.count(c) for c in _DIGITS) / chars,
        sum(text.count(c) for c in _MARKS) / chars, len(seen) / many, n / max(with_word, 1),
        float((ids[1:] == ids[:-1]).sum()) / many,
    ]
    return [n, word_chars, symbols, dup_lines, repeats], features


@dataclass
class Trees:
    """A boosted ensemble as node arrays: leaves point at themselves."""

    feature: np.ndarray    # trees x nodes
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    base: float
    depth: int

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probability of each row: all rows go down all trees together, level by level."""
        n, trees = len(x), len(self.feature)
        rows, tree = np.arange(n)[:, None], np.arange(trees)[None, :]
        node = np.zeros((n, trees), np.int64)
        for _ in range(self.depth):
            low = x[rows, self.feature[tree, node]] <= self.threshold[tree, node]
            node = np.where(low, self.left[tree, node], self.right[tree, node])
        return sigmoid(self.base + self.value[tree, node].sum(axis=1))


def fit_trees(x: np.ndarray, y: np.ndarray, monotone: Sequence[int], n_trees: int = 60, depth: int = 3,
              rate: float = 0.15, bins: int = 64, smooth: float = 1.0, least: float = 5.0) -> Trees:
    """Boosted trees of the log loss on binned features, grown level by level.

    A split that breaks the direction of its feature is not taken, and the midpoint of its
    two values bounds everything below, so that the ensemble is monotone as a whole.
    """
    n, width = x.shape
    share = float(np.clip(y.mean(), 1e-3, 1 - 1e-3)) if n else 0.5
    base, size = float(np.log(share / (1 - share))), 2 ** (depth + 1) - 1
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) if n else np.zeros(0) for j in range(width)]
    binned = np.stack([np.searchsorted(cuts[j], x[:, j], side="left") for j in range(width)], axis=1) if n else x.astype(int)
    shape = (n_trees, size)
    feature, threshold, value = np.zeros(shape, np.int64), np.full(shape, np.inf), np.zeros(shape)
    left = np.tile(np.arange(size), (n_trees, 1))
    right = left.copy()
    margin = np.full(n, base)
    for t in range(n_trees if n else 0):
        p = sigmoid(margin)
        grad, hess = y - p, np.maximum(p * (1 - p), 1e-6)
        node = np.zeros(n, np.int64)
        bounds = {0: (-np.inf, np.inf)}
        for k in range(size):
            if k not in bounds:
                continue
            lo, hi = bounds[k]
            rows = np.flatnonzero(node == k)
            g, h = grad[rows].sum(), hess[rows].sum()
            value[t, k] = np.clip(g / (h + smooth), lo, hi)
            if 2 * k + 2 >= size or len(rows) < 2:
                continue
            best = (1e-6, 0, 0, 0.0, 0.0)
            for j in range(width):
                if not len(cuts[j]):
                    continue
                gl = np.cumsum(np.bincount(binned[rows, j], grad[rows], len(cuts[j]) + 1))[:-1]
                hl = np.cumsum(np.bincount(binned[rows, j], hess[rows], len(cuts[j]) + 1))[:-1]
                vl = np.clip(gl / (hl + smooth), lo, hi)
                vr = np.clip((g - gl) / (h - hl + smooth), lo, hi)
                gain = gl * vl - 0.5 * (hl + smooth) * vl ** 2 + (g - gl) * vr - 0.5 * (h - hl + smooth) * vr ** 2
                gain -= g * value[t, k] - 0.5 * (h + smooth) * value[t, k] ** 2
                gain[(hl < least * 0.05) | (h - hl < least * 0.05) | (monotone[j] * (vr - vl) < 0)] = -np.inf
                at = int(np.argmax(gain))
                if gain[at] > best[0]:
                    best = (float(gain[at]), j, at, float(vl[at]), float(vr[at]))
            gain_k, j, at, vl, vr = best
            if gain_k <= 1e-6:
                continue
            feature[t, k], threshold[t, k] = j, cuts[j][at]
            left[t, k], right[t, k] = 2 * k + 1, 2 * k + 2
            go_left = binned[rows, j] <= at
            node[rows] = np.where(go_left, 2 * k + 1, 2 * k + 2)
            mid = (vl + vr) / 2
            bounds[2 * k + 1], bounds[2 * k + 2] = (lo, hi), (lo, hi)
            if monotone[j] > 0:
                bounds[2 * k + 1], bounds[2 * k + 2] = (lo, mid), (mid, hi)
            elif monotone[j] < 0:
                bounds[2 * k + 1], bounds[2 * k + 2] = (mid, hi), (lo, mid)
        value[t] *= rate
        margin = margin + value[t, node]
    return Trees(feature, threshold, left, right, value, base, depth)


def train(docs: DataFrame, labels: DataFrame, text: str = "text", key: str = "doc_id", target: str = "quality",
          per_label: int = 3000) -> Trees:
    """Fit the trees on at most ``per_label`` labelled rows of each label value.

    The rows are those with the smallest hash of the key outside fold 1 of 3, which stays
    for tests. Rows without key or label teach nothing. Without labelled rows the trees
    give every text the probability 0.5. Of rows with one key and label only the least text
    teaches, however many there are.
    """
    known = labels.select(F.col(f"`{key}`").alias("_k"), F.col(f"`{target}`").cast("int").alias("_y"))
    known = known.filter(F.col("_k").isNotNull() & F.col("_y").isin(0, 1) & (folds(F.col("_k"), 3) != 1))
    chosen = bounded_sample(known, "_y", per_label, "_k")
    pairs = docs.select(F.col(f"`{key}`").alias("_k"), F.col(f"`{text}`").alias("_t")).join(F.broadcast(chosen), "_k")
    pairs = pairs.groupBy("_k", "_y").agg(F.min("_t").alias("_t"))  # rows of one key teach once
    facts = add_columns(pairs, ["_t"], "features array<double>",
                        lambda texts: [[statistics(t)[1] for t in texts]], keep=["_k", "_y"])
    rows = facts.collect()
    rows.sort(key=lambda r: (r["_k"], r["_y"], r["features"]))
    x = np.array([r["features"] for r in rows], float).reshape(len(rows), len(FEATURES))
    y = np.array([r["_y"] for r in rows], float)
    return fit_trees(x, y, [MONOTONE.get(f, 0) for f in FEATURES])


def quality_rules(df: DataFrame, trees: Trees, text: str = "text", least: float = 0.5,
                  keep: Sequence[str] | None = None) -> DataFrame:
    """Add counts, ``base_failed``, ``rule_score`` and ``kept`` of each text.

    ``base_failed``: under 50 words, or more than half of the words repeat in three-word
    windows. ``kept``: not failed and the trees give at least ``least``.

    A null or empty text has no words and fails. Texts are read whole; ties cannot arise,
    repeated rows get equal results, an empty table gives an empty one, and columns named
    like a new one are replaced by it.
    """
    ddl = ", ".join([*[f"{c} bigint" for c in COUNTS], "base_failed boolean", "rule_score double", "kept boolean"])

    def work(texts: list) -> list[list]:
        made = [statistics(t) for t in texts]
        counts = [list(c) for c in zip(*[m[0] for m in made])] or [[] for _ in COUNTS]
        score = trees.score(np.array([m[1] for m in made], float).reshape(len(made), len(FEATURES)))
        failed = [n < 50 or 100 * r > 50 * n for n, r in zip(counts[0], counts[4])]
        kept = [not f and bool(s >= least) for f, s in zip(failed, score)]
        return [*counts, failed, [float(s) for s in score], kept]

    return add_columns(df, [text], ddl, work, keep)
