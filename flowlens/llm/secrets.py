"""Secret scan: fixed patterns, and windows of high character entropy."""

from __future__ import annotations

import math
import re
from collections.abc import Iterator, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowlens.llm.common import add_columns

SPANS = "array<struct<kind:string,start:bigint,end:bigint>>"
KINDS = ("assign", "access", "hex", "entropy")

_ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
    re.IGNORECASE | re.ASCII,
)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]+")
_HEX_LONG = re.compile(r"[0-9a-f]{16,}")

# Candidates are the runs of the widest class; every class is looked for inside of them.
_RUN = re.compile(r"[A-Za-z0-9+/_-]{20,}={0,2}")

# Character classes whose runs are measured: pattern, window, least bits of entropy a
# character, and how many kinds (lower, upper, digit) a run must show. Letters of one case
# need the most bits, so that long words stay below.
CLASSES = (
    ("hex", re.compile(r"[0-9A-F]{20,}"), 20, 3.0, 2),
    ("base64", _RUN, 20, 3.6, 3),
    ("lower_digit", re.compile(r"[a-z0-9]{20,}"), 20, 3.5, 2),
    ("upper_digit", re.compile(r"[A-Z0-9]{20,}"), 20, 3.3, 2),
    ("letters", re.compile(r"[A-Za-z]{20,}"), 20, 3.6, 2),
    ("one_case", re.compile(r"[a-z]{20,}|[A-Z]{20,}"), 20, 3.85, 1),
)

# A word of a path or name: in one case, with a capital, or in camel case, whose later
# words have three letters or more, or two with a vowel; up to four digits behind it.
_HUMP = r"(?:[A-Z][a-z]{2,}|[A-Z][aeiouy]|[AEIOU][a-z]|[A-Z])"
_NAME = rf"(?:[A-Z]?[a-z]+{_HUMP}*|{_HUMP}+)[0-9]{{0,4}}"

# Candidates that are not secrets though they look random: identifiers, paths, addresses
# and names in camel case.
ALLOWED = (
    re.compile(r"[0-9A-Fa-f]{8}-(?:[0-9A-Fa-f]{4}-){3}[0-9A-Fa-f]{12}"),
    re.compile(rf"[/_-]*(?:{_NAME}[/_-]+)+(?:{_NAME}|[0-9]{{0,4}})"),
    re.compile(r"[a-z]*(?:[A-Z][a-z]{2,})+"),
)

# Parts of a run that are no secret: words that say that it is an example, and dates with
# a time. They cut the run; what stands before and behind them is measured on its own.
HARMLESS = re.compile(
    r"(?i:example|placeholder|changeme|dummy|sample|test|xxxx+|abcdef|123456|qwerty)"
    r"|(?<![0-9])[0-9]{4}-[0-9]{2}-[0-9]{2}(?:[T_-]?[0-9]{2}(?:[0-9]{2}){0,2}Z?)?(?![A-Za-z0-9])"
)


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """Spans of the fixed patterns as (start, kind, end); what fails its length is left out."""
    found = []
    if "=" in text or ":" in text:
        found += [(m.start(), 0, m.end()) for m in _ASSIGN.finditer(text) if len(m[2]) >= 12]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in _ACCESS.finditer(text) if len(m[0]) >= 18]
    # A run is one match, so asking for 16 at once finds the same spans.
    found += [(m.start(), 2, m.end()) for m in _HEX_LONG.finditer(text)]
    return sorted(found)


def window_entropies(run: str, width: int) -> Iterator[float]:
    """Entropy in bits a character of every window, by adding and taking one count each."""
    counts: dict[str, int] = {}
    # n * H = n log n - sum c log c; only the sum changes as the window moves.
    total = 0.0
    whole = width * math.log2(width)
    terms = [0.0] + [c * math.log2(c) for c in range(1, width + 2)]
    for i, c in enumerate(run):
        n = counts.get(c, 0)
        total += terms[n + 1] - terms[n]
        counts[c] = n + 1
        if i >= width:
            old = run[i - width]
            n = counts[old]
            total += terms[n - 1] - terms[n]
            counts[old] = n - 1
        if i >= width - 1:
            yield (whole - total) / width


def _kinds_in(s: str) -> int:
    return (any("a" <= c <= "z" for c in s)) + (any("A" <= c <= "Z" for c in s)) + (any("0" <= c <= "9" for c in s))


def pieces(run: str) -> Iterator[tuple[int, int]]:
    """What is left of a run without its harmless parts."""
    at = 0
    for m in HARMLESS.finditer(run):
        yield at, m.start()
        at = m.end()
    yield at, len(run)


def entropy_spans(text: str, allowed: Sequence[re.Pattern] = ALLOWED) -> list[tuple[int, int]]:
    """Merged windows of high entropy in the candidate strings of every class."""
    found: list[tuple[int, int]] = []
    for run in _RUN.finditer(text):
        for _, pattern, width, least, kinds in CLASSES:
            for m in pattern.finditer(run[0]):
                if _kinds_in(m[0]) < kinds or any(p.fullmatch(m[0]) for p in allowed):
                    continue
                for a, b in pieces(m[0]):
                    piece, at = m[0][a:b], run.start() + m.start() + a
                    if len(piece) < width or any(p.fullmatch(piece) for p in allowed):
                        continue
                    for i, h in enumerate(window_entropies(piece, width)):
                        if h < least or _kinds_in(piece[i:i + width]) < min(kinds, 2):
                            continue
                        if found and found[-1][0] <= at + i <= found[-1][1]:
                            found[-1] = (found[-1][0], max(found[-1][1], at + i + width))
                        else:
                            found.append((at + i, at + i + width))
    merged: list[tuple[int, int]] = []
    for a, b in sorted(found):
        if merged and a < merged[-1][1]:
            merged[-1] = (merged[-1][0], max(b, merged[-1][1]))
        else:
            merged.append((a, b))
    return merged


def scan(text: str | None) -> list[dict]:
    """All spans of a text by start, then kind; entropy spans inside a base span are no news."""
    text = text or ""
    base = base_spans(text)
    spans = list(base)
    for a, b in entropy_spans(text):
        if not any(s <= a and b <= e for s, _, e in base):
            spans.append((a, 3, b))
    return [{"kind": KINDS[k], "start": s, "end": e} for s, k, e in sorted(spans)]


def find_secrets(df: DataFrame, text: str = "text", out: str = "secrets",
                 keep: Sequence[str] | None = None) -> DataFrame:
    """Add the secrets of each text as an array of (kind, start, end), in code points.

    Kinds ``assign``, ``access`` and ``hex`` are fixed patterns. Kind ``entropy`` adds the
    windows over runs of one character class whose Shannon entropy reaches the bound of the
    class, unless the run is on the allow-list, the window overlaps a harmless part of the
    run, or it lies inside a fixed span.

    Null and empty texts have an empty array. Repeated rows are scanned alike, an empty
    table gives an empty one, and a column already named ``out`` is replaced. The work is
    linear in the text, whatever its length.
    """
    return add_columns(df, [text], f"`{out}` {SPANS}", lambda texts: [[scan(t) for t in texts]], keep)


def listing(spans: Column) -> Column:
    """``kind:start:end`` of all spans, joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def masked(text: str | None) -> str | None:
    """The text with each span as its kind in angle brackets; of overlapping ones the first."""
    if not text:
        return text
    parts, at = [], 0
    for s in scan(text):  # by start
        if s["end"] <= at:
            continue
        if s["start"] >= at:
            parts += [text[at:s["start"]], f"<{s['kind'].upper()}>"]
        at = s["end"]
    return "".join([*parts, text[at:]])


def redact(df: DataFrame, text: str = "text") -> DataFrame:
    """Replace every secret by its kind in angle brackets; overlapping ones by the first.

    All rows and columns stay. Null texts stay null.
    """
    clean = add_columns(df, [text], f"`{text}` string", lambda texts: [[masked(t) for t in texts]])
    return clean.select(*[F.col(f"`{c}`") for c in df.columns])
