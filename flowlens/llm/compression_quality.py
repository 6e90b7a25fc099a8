"""Quality by compression: a dictionary of good texts, one of bad texts, a calibrated difference."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowlens.llm.common import add_columns, bounded_sample, folds, sigmoid, stable_hash

FOLDS, HELD_OUT = 3, 1
PIECE = 1 << 20  # bytes compressed at once, so that memory does not grow with the text


@dataclass
class Model:
    good: bytes
    bad: bytes
    slope: np.ndarray   # of the normalised difference, the size ratio and 1
    level: int

    def _tools(self):
        if getattr(self, "_made", None) is None:
            self._made = [
                zstandard.ZstdCompressor(dict_data=_dictionary(d), level=self.level, write_content_size=False, write_checksum=False,
                                         write_dict_id=False)
                for d in (self.good, self.bad)
            ]
        return self._made

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k != "_made"}

    def features(self, text: str | None) -> list[float]:
        """Normalised size difference, bad against good, and what is left of the text by the better one."""
        raw = (text or "").encode()
        if not raw:
            return [0.0, 0.0, 1.0]
        good, bad = (sum(len(c.compress(raw[i:i + PIECE])) for i in range(0, len(raw), PIECE)) for c in self._tools())
        return [(bad - good) / max(bad, good), min(bad, good) / len(raw), 1.0]

    def score(self, texts: Sequence[str | None]) -> list[float]:
        if not self.good:
            return [0.5] * len(texts)
        x = np.array([self.features(t) for t in texts], float).reshape(-1, 3)
        return [float(p) for p in sigmoid(_calibration_row(x) @ self.slope)]


def _dictionary(raw: bytes) -> zstandard.ZstdCompressionDict:
    return zstandard.ZstdCompressionDict(raw, dict_type=zstandard.DICT_TYPE_AUTO)


def _calibration_row(x: np.ndarray) -> np.ndarray:
    """The difference and the size ratio with its square: texts that hardly or hugely shrink are odd."""
    return np.column_stack([x[:, 0] * 20, x[:, 1] * 5, x[:, 1] ** 2 * 5, x[:, 2]])


def train_dictionary(texts: Sequence[str], size: int) -> bytes:
    """A zstandard dictionary of texts; of too few texts, their raw content."""
    samples = [raw[i:i + 4096] for raw in (t.encode() for t in texts) for i in range(0, len(raw), 4096)]
    try:
        return zstandard.train_dictionary(size, samples, level=3).as_bytes()
    except zstandard.ZstdError:
        return b"\n".join(samples)[-size:] or b"\n"


def fit(rows: Sequence[tuple[str, int]], share: float | None = None, size: int = 65_536, level: int = 3) -> Model:
    """Dictionaries from two thirds of the (text, label) rows, the calibration from the rest.

    Texts that built a dictionary compress too well with it, so they do not calibrate.
    ``share`` is the share of good rows to calibrate for; without it, that of the rows.
    """
    labels = {y for _, y in rows}
    if labels != {0, 1}:
        return Model(b"", b"", np.zeros(4), level)
    build = [r for i, r in enumerate(rows) if i % 3 != 2]
    rest = [r for i, r in enumerate(rows) if i % 3 == 2]
    if {y for _, y in build} != labels or {y for _, y in rest} != labels:
        build = rest = list(rows)
    model = Model(*(train_dictionary([t for t, y in build if y == want], size) for want in (1, 0)), np.zeros(4), level)
    x = _calibration_row(np.array([model.features(t) for t, _ in rest]))
    y = np.array([y for _, y in rest], float)
    share = float(y.mean()) if share is None else share
    # The sample has as many rows of either label; weights give it the true shares. Newton steps.
    weight = np.where(y > 0, share / y.mean(), (1 - share) / (1 - y.mean()))
    slope = np.zeros(4)
    for _ in range(50):
        p = sigmoid(x @ slope)
        grad = x.T @ (weight * (y - p)) - 1e-2 * slope
        hess = (x * (weight * p * (1 - p))[:, None]).T @ x + 1e-2 * np.eye(4)
        slope = slope + np.clip(np.linalg.solve(hess, grad), -5, 5)
    model.slope = slope
    return model


def held_out(key: Column) -> Column:
    return folds(key, FOLDS) == HELD_OUT


def train(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", target: str = "quality",
          per_label: int = 1500) -> Model:
    """Fit on at most ``per_label`` rows of each label outside the held-out fold.

    The rows are those with the least hash of the key. Rows without key, text or label
    teach nothing; without both labels every text scores 0.5. Of rows with one key and label
    only the least text teaches, however many there are.
    """
    known = labels.select(F.col(f"`{key}`").alias("_k"), F.col(f"`{target}`").cast("int").alias("_y"))
    known = known.filter(F.col("_k").isNotNull() & F.col("_y").isin(0, 1) & ~held_out(F.col("_k")))
    chosen = bounded_sample(known, "_y", per_label, "_k")
    texts = docs.select(F.col(f"`{key}`").alias("_k"), F.col(f"`{text}`").alias("_t")).filter(F.col("_t").isNotNull())
    # Rows of one key teach once, so the sample stays bounded.
    rows = texts.join(F.broadcast(chosen), "_k").groupBy("_k", "_y").agg(F.min("_t").alias("_t")).collect()
    rows.sort(key=lambda r: (stable_hash(r["_k"]), r["_y"], r["_t"]))
    share = known.agg(F.avg("_y")).first()[0]
    return fit([(r["_t"], r["_y"]) for r in rows], share)


def score(df: DataFrame, model: Model, text: str = "text", keep: Sequence[str] | None = None) -> DataFrame:
    """Add ``score`` (0 to 1, higher for good texts) and ``predicted`` (score of 0.5 or more).

    Whole texts are compressed. Null and empty texts are scored like any other, with a
    difference of 0. Repeated rows get equal scores, an empty table gives an empty one, and
    columns named like the new ones are replaced.
    """

    def work(texts: list) -> list[list]:
        made = model.score(texts)
        return [made, [int(s >= 0.5) for s in made]]

    return add_columns(df, [text], "score double, predicted int", work, keep)
