"""Language identification: string kernels, Nystroem landmarks, kernel ridge regression."""

from __future__ import annotations

from collections import Counter
from collections.abc import Sequence
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowlens.llm.common import add_columns, bounded_sample, folds, fresh, stable_hash, without

UNKNOWN = "und"
FOLDS = 5
ORDERS = (1, 2, 3)  # the lengths of the n-grams of the blended spectrum
LETTERS = 60        # letters with a code of their own; the rarer ones share one
_GAP, _OTHER = 0, 1


def has_letter(text: str | None) -> bool:
    return bool(text) and (text[:1].isalpha() or any(map(str.isalpha, text)))


@dataclass
class Alphabet:
    """Codes of characters: 0 for what is no letter, 1 for rare letters, then the common ones."""

    letters: str
    _table: np.ndarray | None = field(default=None, repr=False)

    @property
    def size(self) -> int:
        return len(self.letters) + 2

    @property
    def grams(self) -> int:
        return sum(self.size ** n for n in ORDERS)

    def codes(self, text: str) -> np.ndarray:
        """Code of each character of the lower-cased text, gaps in a row as one."""
        if self._table is None:
            letter = np.fromiter((chr(c).isalpha() for c in range(0x110000)), np.uint8, 0x110000)
            for i, c in enumerate(self.letters):
                letter[ord(c)] = i + 2
            self._table = letter
        points = np.frombuffer(text.lower().encode("utf-32-le", "replace"), np.uint32)
        codes = self._table[points]
        keep = np.ones(len(codes), bool)
        keep[1:] = (codes[1:] != _GAP) | (codes[:-1] != _GAP)
        return codes[keep].astype(np.int32)

    def present(self, text: str) -> np.ndarray:
        """Sorted distinct n-grams of all lengths; n-grams of gaps alone are left out."""
        codes, size, parts, first = self.codes(text), self.size, [], 0
        for n in ORDERS:
            if len(codes) >= n:
                gram = codes[:len(codes) - n + 1]
                for k in range(1, n):
                    gram = gram * size + codes[k:len(codes) - n + 1 + k]
                seen = np.zeros(size ** n, bool)
                seen[gram] = True
                seen[0] = False
                parts.append(np.flatnonzero(seen) + first)
            first += size ** n
        return np.concatenate(parts) if parts else np.zeros(0, np.int64)


@dataclass
class Model:
    """Landmarks and weights: scores are ``kernel(text, landmarks) @ weights``."""

    alphabet: Alphabet
    languages: list[str]
    place: np.ndarray      # n-gram -> column of the landmarks' matrix, -1 if none has it
    landmarks: np.ndarray  # columns x landmarks, normalised presence
    weights: np.ndarray    # landmarks x languages

    def kernel(self, texts: Sequence[str]) -> np.ndarray:
        """Normalised presence kernel of texts and landmarks, one matrix product a batch."""
        x = np.zeros((len(texts), len(self.landmarks)), np.float32)
        norm = np.ones(len(texts), np.float32)
        for i, t in enumerate(texts):
            grams = self.alphabet.present(t)
            norm[i] = max(len(grams), 1)
            at = self.place[grams]
            x[i, at[at >= 0]] = 1.0
        return (x @ self.landmarks) / np.sqrt(norm)[:, None]

    def predict(self, texts: Sequence[str | None], batch: int = 256) -> tuple[list[str], list[float]]:
        """Best language and its share of the softmax; ``und`` and 0 without a letter."""
        names, scores = [], []
        for at in range(0, len(texts), batch):
            part = texts[at:at + batch]
            known = [i for i, t in enumerate(part) if has_letter(t)] if self.languages else []
            name, score = [UNKNOWN] * len(part), [0.0] * len(part)
            if known:
                margin = (self.kernel([part[i] for i in known]) @ self.weights).astype(float)
                share = np.exp(4.0 * (margin - margin.max(axis=1, keepdims=True)))
                share /= share.sum(axis=1, keepdims=True)
                for i, best, row in zip(known, margin.argmax(axis=1), share):
                    name[i], score[i] = self.languages[best], float(min(row[best], 1.0))
            names += name
            scores += score
        return names, scores


def fit(rows: Sequence[tuple[str, str]], per_language: int = 40, ridge: float = 0.1) -> Model:
    """Model from (text, language) rows, whose order decides which become landmarks."""
    languages = sorted({lang for _, lang in rows})
    common = Counter(c for t, _ in rows for c in set(t.lower()) if c.isalpha() and len(c) == 1)
    letters = sorted(common, key=lambda c: (-common[c], c))[:LETTERS]
    alphabet = Alphabet("".join(sorted(letters)))
    grams = [alphabet.present(t) for t, _ in rows]
    taken: Counter = Counter()
    chosen = []
    for i, (_, lang) in enumerate(rows):
        if len(grams[i]) and taken[lang] < per_language:
            taken[lang] += 1
            chosen.append(i)
    columns = np.unique(np.concatenate([grams[i] for i in chosen])) if chosen else np.zeros(0, np.int64)
    place = np.full(alphabet.grams, -1, np.int32)
    place[columns] = np.arange(len(columns))
    landmarks = np.zeros((len(columns), len(chosen)), np.float32)
    for j, i in enumerate(chosen):
        landmarks[place[grams[i]], j] = 1 / np.sqrt(len(grams[i]))
    model = Model(alphabet, languages if chosen else [], place, landmarks, np.zeros((len(chosen), len(languages)), np.float32))
    if not chosen:
        return model
    kernel = model.kernel([t for t, _ in rows]).astype(float)
    target = np.array([[1.0 if lang == x else -1.0 for x in languages] for _, lang in rows])
    # Nystroem features are K_nm K_mm^(-1/2); each language is regressed against the rest.
    own = kernel[chosen]
    values, vectors = np.linalg.eigh((own + own.T) / 2)
    good = values > 1e-8 * values.max()
    root = vectors[:, good] / np.sqrt(values[good])
    phi = kernel @ root
    # Every language counts alike, however many rows it has.
    rows_of = Counter(lang for _, lang in rows)
    weight = np.array([len(rows) / (len(languages) * rows_of[lang]) for _, lang in rows])
    gram = (phi * weight[:, None]).T @ phi + ridge * np.eye(phi.shape[1])
    model.weights = (root @ np.linalg.solve(gram, (phi * weight[:, None]).T @ target)).astype(np.float32)
    return model


def held_out(key: Column) -> Column:
    return folds(key, FOLDS) == 0


def train(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", per_language: int = 300,
          landmarks: int = 40) -> Model:
    """Fit on at most ``per_language`` rows of each language outside the held-out fold.

    Only texts and languages are learned from. The rows are those with the least hash of
    the key, which are spread evenly; the first ``landmarks`` of each language become
    landmarks. Rows without text or language teach nothing, and a table without any
    labelled row gives a model that answers ``und``. Of rows with one key and language only
    the least text teaches, however many there are.
    """
    known = docs.select(F.col(f"`{key}`").alias("_k"), F.col(f"`{lang}`").alias("_l"), F.col(f"`{text}`").alias("_t"))
    known = known.filter(F.col("_l").isNotNull() & ~held_out(F.col("_k")) & F.col("_t").isNotNull())
    # The text itself is read only for the chosen rows.
    lengths = known.select("_k", "_l")
    chosen = bounded_sample(lengths, "_l", per_language, "_k")
    # Rows of one key teach once, so the sample stays bounded.
    rows = known.join(F.broadcast(chosen), ["_k", "_l"]).groupBy("_k", "_l").agg(F.min("_t").alias("_t")).collect()
    rows.sort(key=lambda r: (stable_hash(r["_k"]), r["_l"], r["_t"]))
    return fit([(r["_t"], r["_l"]) for r in rows], landmarks)


def identify(df: DataFrame, model: Model, text: str = "text", keep: Sequence[str] | None = None) -> DataFrame:
    """Add ``lang_pred`` and ``score`` (0 to 1) from each whole text.

    ``und`` with score 0 for a null text, one without a letter, or an untrained model.
    Between equal margins the first language by name wins. Repeated rows get equal
    results, an empty table gives an empty one, and columns named like the new ones are
    replaced.
    """
    return add_columns(df, [text], "lang_pred string, score double", lambda t: list(model.predict(t)), keep)


def keep_identified(df: DataFrame, model: Model, least: float = 0.3, text: str = "text", lang: str = "lang") -> DataFrame:
    """The rows whose language is known with at least ``least``; a null language is filled in."""
    guess, sure = fresh(df, "_lang_pred"), fresh(df, "_score")
    marked = add_columns(df, [text], f"`{guess}` string, `{sure}` double", lambda t: list(model.predict(t)))
    kept = marked.filter((F.col(guess) != UNKNOWN) & (F.col(sure) >= least))
    if lang in df.columns:
        kept = kept.withColumn(lang, F.coalesce(F.col(f"`{lang}`"), F.col(guess)))
    return without(kept, [guess, sure]).select(*[F.col(f"`{c}`") for c in df.columns])
