"""Personal data: fixed patterns, and a skip-chain conditional random field over tokens."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowlens.llm.common import WORD, add_columns, stable_hash

SPANS = "array<struct<kind:string,start:bigint,end:bigint,base:boolean>>"
KINDS = ("email", "ip", "card", "phone")
LABELS = ("", *KINDS)  # 0: nothing personal

_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
# A match starts at the first digit of a run; looking behind keeps long runs linear.
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]+")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")
_WORD = re.compile(WORD)


def luhn(digits: str) -> bool:
    total = sum(map(int, digits[-1::-2])) + sum(d * 2 - 9 * (d > 4) for d in map(int, digits[-2::-2]))
    return total % 10 == 0


def _emails(text: str) -> list[tuple[int, int]]:
    """Each ``@`` with the run of local characters before it and the domain behind it.

    The run cannot hold another ``@``, so this finds what a search from the left finds,
    in linear time.
    """
    found, last, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > last and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            found.append((start, m.end()))
            last = m.end()
        at = text.find("@", max(at + 1, last))
    return found


def _digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) of the fixed patterns, by kind as listed, then start."""
    found = [(0, *s) for s in _emails(text)] if "@" in text else []
    if not _DIGIT.search(text):
        return found
    if "." in text:
        found += [(1, *m.span()) for m in _IP.finditer(text)
                  if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split("."))]
    for m in _CARD.finditer(text):
        if 13 <= m.end() - m.start():
            d = _digits(m[0])
            if 13 <= len(d) <= 19 and luhn(d):
                found.append((2, *m.span()))
    if "+" in text:
        found += [(3, *m.span()) for m in _PHONE.finditer(text) if 9 <= len(_digits(m[0])) <= 15]
    return found


# ------------------------------------------------------------------ tokens

# What the tokens just before one may announce.
CUES = {
    0: ("mail", "email", "e-mail", "contact"), 1: ("ip", "host", "server", "address"),
    2: ("card", "visa", "mastercard", "credit", "account"), 3: ("phone", "tel", "call", "mobile", "fax"),
}
_CUE = {w: k for k, words in CUES.items() for w in words}
_EDGE = ".,;:!?\"'<>"
_SHAPE = re.compile(r"[0-9]+|[A-Za-z]+")


def shape(token: str) -> str:
    """Digits as their number, letters as one sign, the rest as it is, in at most 24 characters."""
    made = _SHAPE.sub(lambda m: f"d{min(m.end() - m.start(), 20)}" if m[0][0].isdigit() else "a", token)
    return made if len(made) <= 24 else "long"


@dataclass
class Tokens:
    """The candidate tokens of a text: those with a digit or ``@``. All others are clamped to label 0."""

    spans: list[tuple[int, int]]
    index: np.ndarray    # number of the word in the text
    shapes: list[str]
    cues: np.ndarray     # tokens x kinds
    keys: list[list[str]]
    label: np.ndarray    # label of the base span over the token, -1 without one


def tokens_of(text: str, base: Sequence[tuple[int, int, int]]) -> Tokens:
    spans, index, shapes, cues, keys, label = [], [], [], [], [], []
    by_start = sorted((s, e, k) for k, s, e in base)
    recent: list[int] = []
    at = 0
    for i, m in enumerate(_WORD.finditer(text)):
        word = m[0]
        token = word.strip(_EDGE)
        recent = [*recent[-2:], _CUE.get(token.lower().rstrip(":"), -1)]
        if not token or not ("@" in token or _DIGIT.search(token)):
            continue
        start = m.start() + word.index(token)
        end = start + len(token)
        while at < len(by_start) and by_start[at][1] <= start:
            at += 1
        hit = next((k for s, e, k in by_start[at:at + 4] if s < end and e > start), None)
        plain, digits = "".join(c for c in token.lower() if c.isalnum()), _digits(token)
        mine = [f"={plain}"] if len(plain) >= 6 else []
        if len(digits) >= 7:
            mine.append(f"#{digits[-7:]}")
        spans.append((start, end))
        index.append(i)
        shapes.append(shape(token))
        cues.append([float(k in recent[:-1]) for k in range(4)])
        keys.append(mine)
        label.append(-1 if hit is None else hit + 1)
    return Tokens(spans, np.array(index, np.int64), shapes, np.array(cues, float).reshape(-1, 4), keys, np.array(label, np.int64))


def skip_groups(tokens: Tokens) -> list[np.ndarray]:
    """Tokens with a common key, which share a potential; groups of one are left out."""
    groups: dict[str, list[int]] = {}
    for i, keys in enumerate(tokens.keys):
        for k in keys:
            groups.setdefault(k, []).append(i)
    return [np.array(g) for g in groups.values() if len(g) > 1]


# ------------------------------------------------------------------ the field


@dataclass
class Field:
    """Potentials in logs: shapes x labels, cues x labels, neighbours, and the skip strength."""

    shapes: dict[str, int]
    emission: np.ndarray    # shapes (the last for unknown ones) x labels
    cue: np.ndarray         # kinds x labels
    chain: np.ndarray       # label of the left x label of the right token
    skip: float

    def unary(self, t: Tokens) -> np.ndarray:
        """Potential of each label of each token; words that are no candidates have label 0."""
        at = [self.shapes.get(s, len(self.shapes)) for s in t.shapes]
        u = self.emission[at] + t.cues @ self.cue
        joined = np.diff(t.index) == 1
        left, right = np.concatenate([[False], joined]), np.concatenate([joined, [False]])
        return u + np.where(left[:, None], 0, self.chain[0]) + np.where(right[:, None], 0, self.chain[:, 0])

    def marginals(self, t: Tokens, rounds: int = 10) -> np.ndarray:
        """Label probabilities by loopy message passing, all messages of a round at once.

        Tokens under a base span are observed. A skip group passes messages over one hub,
        whose cost is linear in the group.
        """
        n, width = len(t.spans), len(LABELS)
        u = self.unary(t)
        seen = t.label >= 0
        u[seen] = -1e3
        u[seen, t.label[seen]] = 0.0
        joined = np.flatnonzero(np.diff(t.index) == 1)
        right, left = np.zeros((n, width)), np.zeros((n, width))  # messages into a token from its left, its right
        groups = skip_groups(t)
        member = np.concatenate(groups) if groups else np.zeros(0, np.int64)
        hub = np.repeat(np.arange(len(groups)), [len(g) for g in groups]) if groups else np.zeros(0, np.int64)
        up, down = np.zeros((len(member), width)), np.zeros((len(member), width))
        for _ in range(rounds):
            belief = u + right + left
            np.add.at(belief, member, down)
            # Along the chain: a message leaves out what came over the same edge.
            new_right, new_left = right.copy(), left.copy()
            if len(joined):
                new_right[joined + 1] = _send((belief - left)[joined], self.chain)
                new_left[joined] = _send((belief - right)[joined + 1], self.chain.T)
            if len(member):
                potts = self.skip * np.eye(width)
                up = _send(belief[member] - down, potts)
                total = np.zeros((len(groups), width))
                np.add.at(total, hub, up)
                down = _send(total[hub] - up, potts) * 0.5 + down * 0.5
            right, left = new_right, new_left
        belief = u + right + left
        np.add.at(belief, member, down)
        return np.exp(belief - _lse(belief, 1)[:, None])


def _lse(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return np.squeeze(top, axis) + np.log(np.exp(x - top).sum(axis=axis))


def _send(belief: np.ndarray, potential: np.ndarray, block: int = 65_536) -> np.ndarray:
    """Messages over edges: sums over the labels of the sender, scaled to 0 at the best.

    In blocks, so that a text with very many tokens needs little more than its messages.
    """
    out = np.empty_like(belief)
    for at in range(0, len(belief), block):
        part = _lse(belief[at:at + block, :, None] + potential[None], 1)
        out[at:at + block] = part - part.max(axis=1, keepdims=True)
    return out


def fit(texts: Sequence[str], steps: int = 200, rate: float = 0.5) -> Field:
    """Potentials by pseudo-likelihood, with the base spans of the texts as labels.

    Each token is explained by its shape and cues, the labels of its neighbours, and how
    many of its skip partners have each label.
    """
    width = len(LABELS)
    facts = [tokens_of(t, base_spans(t)) for t in texts]
    facts = [f for f in facts if f.spans]
    counts = Counter(s for f in facts for s in f.shapes)
    shapes = {s: i for i, s in enumerate(sorted(s for s, c in counts.items() if c > 1))}
    field = Field(shapes, np.zeros((len(shapes) + 1, width)), np.zeros((4, width)), np.zeros((width, width)), 3.0)
    field.emission[:, 0] = 1.0
    if not facts:
        return field
    at = np.concatenate([[shapes.get(s, len(shapes)) for s in f.shapes] for f in facts])
    cues = np.concatenate([f.cues for f in facts])
    y = np.concatenate([np.maximum(f.label, 0) for f in facts])
    left, right, skip = [], [], []
    for f in facts:
        label, joined = np.maximum(f.label, 0), np.diff(f.index) == 1
        left.append(np.concatenate([[0], np.where(joined, label[:-1], 0)]))
        right.append(np.concatenate([np.where(joined, label[1:], 0), [0]]))
        share = np.zeros((len(label), width))
        for g in skip_groups(f):
            one = np.eye(width)[label[g]]
            share[g] += (one.sum(axis=0) - one) / (len(g) - 1)
        skip.append(share)
    left, right, skip = np.concatenate(left), np.concatenate(right), np.concatenate(skip)
    n, one = len(y), np.eye(width)[y]
    per_shape = np.bincount(at, minlength=len(shapes) + 1)[:, None] + 5.0
    for _ in range(steps):
        score = field.emission[at] + cues @ field.cue + field.chain[left] + field.chain[:, right].T + field.skip * skip
        p = np.exp(score - _lse(score, 1)[:, None])
        miss = one - p
        grad = np.zeros_like(field.emission)
        np.add.at(grad, at, miss)
        field.emission += rate * 4 * (grad / per_shape - 1e-3 * field.emission)
        field.cue += rate * (cues.T @ miss / n - 1e-3 * field.cue)
        chain = np.zeros((width, width))
        np.add.at(chain, left, miss)
        chain_right = np.zeros((width, width))
        np.add.at(chain_right, right, miss)
        field.chain += rate * ((chain + chain_right.T) / n - 1e-3 * field.chain)
        field.skip = float(np.clip(field.skip + rate * ((skip * miss).sum() / max(skip.sum(), 1.0) - 1e-3 * field.skip), 3.0, 6.0))
    return field


def train(docs: DataFrame, key: str = "doc_id", text: str = "text", rows: int = 2000) -> Field:
    """Fit on at most ``rows`` texts that hold a digit or ``@``: those with the least hash of the key."""
    pairs = docs.select(F.col(f"`{key}`").cast("string").alias("k"), F.col(f"`{text}`").alias("t"))
    pairs = pairs.filter(F.col("t").rlike("[0-9@]")).withColumn("h", F.xxhash64("k"))
    chosen = pairs.select("h").orderBy("h").limit(rows)
    # Keys are chosen first, so that no sort carries texts. Equal hashes come along together.
    last = chosen.agg(F.max("h")).first()[0]
    if last is None:
        return fit([])
    found = pairs.filter(F.col("h") <= last).limit(2 * rows).collect()
    return fit([r["t"] for r in sorted(found, key=lambda r: (stable_hash(r["k"]), r["t"]))])


def scan(text: str | None, field: Field, least: float = 0.5) -> list[dict]:
    """All spans of a text: base ones, then tokens that the field labels, neighbours joined."""
    text = text or ""
    base = base_spans(text)
    spans = [(k, s, e, True) for k, s, e in base]
    if "@" in text or _DIGIT.search(text):
        t = tokens_of(text, base)
        if (t.label < 0).any():
            p = field.marginals(t)
            best = np.where((t.label < 0) & (p.max(axis=1) >= least), p.argmax(axis=1), 0)
            run: list[int] = []
            for i in [*np.flatnonzero(best).tolist(), -1]:
                if run and (i < 0 or best[i] != best[run[-1]] or t.index[i] != t.index[run[-1]] + 1):
                    spans.append((int(best[run[0]]) - 1, t.spans[run[0]][0], t.spans[run[-1]][1], False))
                    run = []
                run.append(i)
    return [{"kind": KINDS[k], "start": s, "end": e, "base": b} for k, s, e, b in sorted(spans)]


def find_personal_data(df: DataFrame, field: Field, text: str = "text", out: str = "personal",
                       keep: Sequence[str] | None = None) -> DataFrame:
    """Add the personal data of each text as an array of (kind, start, end, base), in code points.

    ``base`` spans come from fixed patterns. The others are tokens to which the field gives
    a kind: the base spans are observed, and message passing over neighbours and over
    tokens with equal letters and digits, or equal last seven digits, makes the labels
    agree across the document. They never overlap a base span.

    Null and empty texts have an empty array. Repeated rows are scanned alike, an empty
    table gives an empty one, and a column already named ``out`` is replaced. The work is
    linear in the text, whatever its length.
    """
    return add_columns(df, [text], f"`{out}` {SPANS}", lambda texts: [[scan(t, field) for t in texts]], keep)
