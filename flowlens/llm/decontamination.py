"""Benchmark decontamination: suffix arrays of training shards, searched for every test suffix."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowlens.llm.common import fresh, schema_of
from flowlens.session import materialize

WINDOW = 10
# Words of the documents in one suffix array, and of the items searched in one pass.
SHARD_WORDS, BLOCK_WORDS = 500_000, 200_000
# Everything but 0-9, a-z and bytes above 127 parts words; bytes.lower() changes only A-Z.
_SPACES = bytes(c if 48 <= c <= 57 or 97 <= c <= 122 or c > 127 else 32 for c in range(256))


def words_of(text: bytes | None) -> list[bytes]:
    return text.lower().translate(_SPACES).split() if text else []


# ------------------------------------------------------------------ suffix arrays


def suffix_array(seq: np.ndarray, least: int, depth: int) -> np.ndarray:
    """Places of ``seq`` in the order of their suffixes.

    A zero ends the suffixes before it. Only suffixes of ``least`` words or more are
    listed, and their order counts up to ``depth`` words, for no longer ones are searched.
    Ranks by 1, 2, 4, ... words come from sorting pairs of ranks.
    """
    ends = np.flatnonzero(seq == 0)
    runs = np.diff(np.concatenate(([-1], ends, [len(seq)])))  # each with the zero behind it
    left = np.repeat(np.cumsum(runs) - 1, runs)[:len(seq)] - np.arange(len(seq))  # words up to the next zero
    places = np.flatnonzero(left >= least)
    if not len(places):
        return places
    # Shorter suffixes of the same run take part, for longer ones look at their rank.
    live = np.flatnonzero((np.repeat(runs - 1, runs)[:len(seq)] >= least) & (left > 0))
    rank, span = seq.astype(np.int64), 1
    while span < depth:
        after = np.minimum(live + span, len(seq) - 1)
        second = np.where(left[live] > span, rank[after], 0)
        pair = rank[live] * (int(second.max()) + 1) + second
        new = np.unique(pair, return_inverse=True)[1] + 1
        done = int(new.max()) == len(live)
        rank[live] = new
        span *= 2
        if done:
            break
    return places[np.argsort(rank[places], kind="stable")]


def _words_at(seq: np.ndarray, places: np.ndarray, first: int, count: int) -> np.ndarray:
    """The words ``first`` to ``first + count`` behind each place; ``seq`` ends in enough zeros."""
    return seq[np.minimum(places[:, None] + np.arange(first, first + count), len(seq) - 1)]


def _compare(seq: np.ndarray, places: np.ndarray, test: np.ndarray, starts: np.ndarray, lengths: np.ndarray
             ) -> tuple[np.ndarray, np.ndarray]:
    """Order (-1, 0, 1) of suffixes of ``seq`` against test suffixes of given lengths, and the words both share.

    A suffix that begins with the whole test suffix is equal to it.
    """
    order, shared = np.zeros(len(places), np.int64), np.zeros(len(places), np.int64)
    rest, at, chunk = np.arange(len(places)), 0, 16
    while len(rest):
        a = _words_at(seq, places[rest], at, chunk)
        b = _words_at(test, starts[rest], at, chunk)
        inside = np.arange(at, at + chunk)[None, :] < lengths[rest, None]
        differ = (a != b) & inside
        first = np.where(differ.any(1), differ.argmax(1), chunk)
        hit = first < chunk
        rows = np.flatnonzero(hit)
        order[rest[rows]] = np.sign(a[rows, first[rows]].astype(np.int64) - b[rows, first[rows]])
        shared[rest] = np.minimum(at + first, lengths[rest])
        rest = rest[~hit & (lengths[rest] > at + chunk)]
        at += chunk
    return order, shared


def search(seq: np.ndarray, array: np.ndarray, test: np.ndarray, starts: np.ndarray, lengths: np.ndarray, after: bool) -> np.ndarray:
    """Binary search of all test suffixes at once: the first place of the array that is not
    below a suffix, or with ``after`` the first one above it."""
    low, high = np.zeros(len(starts), np.int64), np.full(len(starts), len(array), np.int64)
    open_ = np.flatnonzero(low < high)
    while len(open_):
        middle = (low[open_] + high[open_]) // 2
        order, _ = _compare(seq, array[middle], test, starts[open_], lengths[open_])
        right = (order <= 0) if after else (order < 0)
        low[open_[right]] = middle[right] + 1
        high[open_[~right]] = middle[~right]
        open_ = open_[low[open_] < high[open_]]
    return low


# ------------------------------------------------------------------ items


@dataclass
class Items:
    """Items as one sequence of word numbers, numbered in the order of the words."""

    numbers: dict[bytes, int]
    test: np.ndarray          # words of all items, a zero behind each
    starts: np.ndarray        # every suffix
    lengths: np.ndarray
    owners: np.ndarray        # item of each suffix, and the place of its first word there
    words: np.ndarray
    window_at: np.ndarray     # one suffix of each distinct window
    window_size: np.ndarray
    window_items: list[list[int]]
    names: list[str]

    @property
    def least(self) -> int:
        return int(self.window_size.min()) if len(self.window_size) else 1

    @property
    def longest(self) -> int:
        return int(self.lengths.max()) if len(self.lengths) else 1


def items_of(rows: Sequence[tuple[str, bytes | None]], window: int = WINDOW) -> Items:
    """Numbered words, suffixes and distinct windows of (item, text) rows."""
    texts = [words_of(t) for _, t in rows]
    numbers = {w: i + 1 for i, w in enumerate(sorted({w for t in texts for w in t}))}
    names = sorted({n for n, _ in rows})
    place = {n: i for i, n in enumerate(names)}
    test, starts, lengths, owners, words, windows = [], [], [], [], [], {}
    for (name, _), text in zip(rows, texts):
        ids = [numbers[w] for w in text]
        size = min(window, len(ids))
        for j in range(len(ids)):
            starts.append(len(test) + j)
            lengths.append(len(ids) - j)
            owners.append(place[name])
            words.append(j)
            if size and j + size <= len(ids):
                windows.setdefault(tuple(ids[j:j + size]), [len(test) + j, set()])[1].add(place[name])
        test += [*ids, 0]
    found = list(windows.items())
    return Items(numbers, np.array([*test, 0], np.int32), np.array(starts, np.int64), np.array(lengths, np.int64),
                 np.array(owners, np.int64), np.array(words, np.int64), np.array([v[0] for _, v in found], np.int64),
                 np.array([len(k) for k, _ in found], np.int64), [sorted(v[1]) for _, v in found], names)


def item_blocks(items: DataFrame, item: str, text: str, block_words: int = BLOCK_WORDS, window: int = WINDOW) -> Iterator[Items]:
    """The items in blocks of about ``block_words`` words; only one block is on the driver at a time.

    Equal rows count once. A null item id is the empty string; items without a word have no window.
    """
    name = F.coalesce(F.col(f"`{item}`").cast("string"), F.lit(""))
    rows = items.select(name.alias("item"), F.col(f"`{text}`").cast("binary").alias("t")).distinct()
    size = F.coalesce(F.octet_length("t"), F.lit(0)) / 2 + 1  # no more words than this
    total = rows.agg(F.sum(size)).first()[0] or 0
    blocks = max(1, int(-(-total // block_words)))
    if blocks > 1:
        rows = materialize(rows.withColumn("b", F.pmod(F.xxhash64("item", "t"), F.lit(blocks))), "items")
    for b in range(blocks):
        part = rows if blocks == 1 else rows.filter(F.col("b") == b)
        yield items_of([(r["item"], None if r["t"] is None else bytes(r["t"])) for r in part.select("item", "t").collect()], window)


# ------------------------------------------------------------------ shards


class Shard:
    """Documents of one task as one sequence, up to a bound of words; one document at least."""

    def __init__(self, items: Items):
        self.items, self.parts, self.sizes = items, [], []
        self.words = 0

    def add(self, text: bytes | None) -> None:
        words = words_of(text)
        ids = np.fromiter(map(self.items.numbers.get, words, repeat(0)), np.int32, len(words))
        self.parts += [ids, np.zeros(1, np.int32)]
        self.sizes.append(len(words))
        self.words += len(words) + 1

    def build(self, depth: int, least: int) -> None:
        self.seq = np.concatenate([*self.parts, np.zeros(1, np.int32)])
        self.starts = np.concatenate(([0], np.cumsum(np.array(self.sizes, np.int64) + 1)))
        self.array = suffix_array(self.seq, least, depth)

    def hits(self) -> Iterator[tuple[int, int, list[tuple[int, int]], list[str]]]:
        """Of each document: number, words, ranges of words inside a window, and items with a window in it."""
        found, it = {}, self.items
        if len(self.array) and len(it.window_at):
            low = search(self.seq, self.array, it.test, it.window_at, it.window_size, False)
            high = search(self.seq, self.array, it.test, it.window_at, it.window_size, True)
            which = np.repeat(np.arange(len(low)), high - low)
            at = np.arange(len(which)) - np.repeat(np.cumsum(high - low) - (high - low), high - low) + np.repeat(low, high - low)
            places = self.array[at]
            docs = np.searchsorted(self.starts, places, side="right") - 1
            order = np.lexsort((places, docs))
            cuts = np.flatnonzero(np.diff(docs[order])) + 1
            for part in np.split(order, cuts) if len(order) else []:
                found[int(docs[part[0]])] = (places[part] - self.starts[docs[part[0]]], which[part])
        for i, n in enumerate(self.sizes):
            if i not in found:
                yield i, n, [], []
                continue
            begin, windows = found[i]
            end = np.maximum.accumulate(begin + it.window_size[windows])
            fresh = np.flatnonzero(np.append(True, begin[1:] > end[:-1]))
            spans = list(zip(begin[fresh].tolist(), end[np.append(fresh[1:], len(end)) - 1].tolist()))
            own = {k for w in np.unique(windows).tolist() for k in it.window_items[w]}
            yield i, n, spans, sorted(it.names[k] for k in own)

    def longest(self) -> Iterator[tuple[str, int, int, int, int]]:
        """Of each test suffix that begins in the shard: item, its word, length, document, its word."""
        it = self.items
        if not len(self.array) or not len(it.starts):
            return
        at = search(self.seq, self.array, it.test, it.starts, it.lengths, False)
        best = np.zeros(len(at), np.int64)
        place = np.zeros(len(at), np.int64)
        for near in (at - 1, at):  # neighbours in the order share most
            ok = np.flatnonzero((near >= 0) & (near < len(self.array)))
            _, shared = _compare(self.seq, self.array[near[ok]], it.test, it.starts[ok], it.lengths[ok])
            better = shared > best[ok]
            best[ok[better]], place[ok[better]] = shared[better], self.array[near[ok]][better]
        for s in np.flatnonzero(best):
            doc = int(np.searchsorted(self.starts, place[s], side="right") - 1)
            yield it.names[it.owners[s]], int(it.words[s]), int(best[s]), doc, int(place[s] - self.starts[doc])


def _shards(batches: Iterator[pa.RecordBatch], column: str, items: Items, depth: int, least: int, shard_words: int
            ) -> Iterator[tuple[Shard, list[tuple[pa.RecordBatch, int]]]]:
    """Shards of a task, with the rows that went into each."""
    shard, rows = Shard(items), []
    for batch in batches:
        texts = batch.column(column)
        for i in range(batch.num_rows):
            shard.add(texts[i].as_py())
            rows.append((batch, i))
            if shard.words >= shard_words:
                shard.build(depth, least)
                yield shard, rows
                shard, rows = Shard(items), []
    if rows:
        shard.build(depth, least)
        yield shard, rows


# ------------------------------------------------------------------ operator

FOUND = "n_words bigint, spans array<struct<start:bigint,end:bigint>>, items array<string>"


def _joined(a: list[tuple[int, int]], b: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Union of two lists of ranges."""
    out: list[tuple[int, int]] = []
    for start, end in sorted([*a, *b]):
        if out and start <= out[-1][1]:
            out[-1] = out[-1][0], max(end, out[-1][1])
        else:
            out.append((start, end))
    return out


def contamination(docs: DataFrame, benchmark: DataFrame, text: str = "text", item: str = "item_id", item_text: str = "text",
                  keep: Sequence[str] | None = None, window: int = WINDOW, shard_words: int = SHARD_WORDS,
                  block_words: int = BLOCK_WORDS) -> DataFrame:
    """Add ``n_words``, ``spans`` (ranges of words inside a window that occurs) and ``items`` (their ids, sorted).

    Words are runs of 0-9, A-Z, a-z and all characters above U+007F; A-Z count as a-z. A
    window is ``window`` consecutive words of an item, or the whole item if it has fewer.
    A task cuts its documents into shards of about ``shard_words`` words, sorts the suffixes
    of a shard that can begin a window, and looks up every window in them. Whole texts are
    searched: a longer one is a shard of its own. Only the item side is copied to the tasks,
    in blocks of at most about ``block_words`` words, each with a pass of its own, so neither
    side is bounded. Nothing is shuffled.

    Null and empty texts have no words and no spans. Equal rows all stay. Items with one id
    are one item; a null id counts as the empty string, items without a word never occur.
    Columns of ``keep`` (all without it) stay, those named like a new one are replaced. Empty
    tables give no rows, or rows without spans.
    """
    new = schema_of(FOUND)
    kept = [c for c in (docs.columns if keep is None else keep) if c.lower() not in {n.lower() for n in new.names}]
    body = fresh(docs, "_body")
    out = docs.select(*[F.col(f"`{c}`") for c in kept], F.col(f"`{text}`").cast("binary").alias(body))
    out = out.withColumns({"n_words": F.lit(0).cast("bigint"), "spans": F.array().cast(new["spans"].dataType),
                           "items": F.array().cast("array<string>")})
    for block in item_blocks(benchmark, item, item_text, block_words, window):
        out = _searched(out, body, block, window, shard_words)
    return out.drop(body)


def _searched(df: DataFrame, body: str, items: Items, window: int, shard_words: int) -> DataFrame:
    """Add what a block of items finds to the columns of ``FOUND``."""
    names, schema = df.columns, df.schema
    spans = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for shard, rows in _shards(batches, body, items, window, items.least, shard_words):
            found, at = list(shard.hits()), 0
            while at < len(rows):
                batch, first = rows[at]
                size = 1
                while at + size < len(rows) and rows[at + size][0] is batch:
                    size += 1
                part, made = batch.slice(first, size), found[at:at + size]
                old = part.column("spans").to_pylist(), part.column("items").to_pylist()
                ranges = [_joined([(s["start"], s["end"]) for s in o], f[2]) for o, f in zip(old[0], made)]
                arrays = {
                    "n_words": pa.array([f[1] for f in made], pa.int64()),
                    "spans": pa.array([[{"start": a, "end": b} for a, b in r] for r in ranges], spans),
                    "items": pa.array([sorted({*o, *f[3]}) for o, f in zip(old[1], made)], pa.list_(pa.string())),
                }
                yield pa.RecordBatch.from_arrays([arrays[c] if c in arrays else part.column(c) for c in names], names=names)
                at += size

    return df.mapInArrow(run, schema)


def longest_matches(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id",
                    item_text: str = "text", shard_words: int = SHARD_WORDS, block_words: int = BLOCK_WORDS) -> DataFrame:
    """The longest verbatim match of every suffix of every item, in words, and where it is.

    One row for each word of an item that occurs at all: ``item``, ``item_word`` (place of the
    first word), ``length``, ``key`` and ``doc_word`` of a match of that length; of several
    places it is one of them. Each shard gives its best for each suffix, the rest is a
    maximum. Words, nulls, repeated and empty rows are as in ``contamination``.
    """
    name = docs.schema[key].dataType
    schema = schema_of("item string, item_word bigint, length bigint, doc_word bigint").add("key", name)
    source = docs.select(F.col(f"`{key}`").alias("key"), F.col(f"`{text}`").cast("binary").alias("body"))

    def found(items: Items) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for shard, rows in _shards(batches, "body", items, items.longest, 1, shard_words):
                best = list(shard.longest())
                keys = [rows[b[3]] for b in best]
                for first in range(0, len(best), 4096):
                    part = best[first:first + 4096]
                    yield pa.RecordBatch.from_pydict({
                        "item": [b[0] for b in part], "item_word": pa.array([b[1] for b in part], pa.int64()),
                        "length": pa.array([b[2] for b in part], pa.int64()), "doc_word": pa.array([b[4] for b in part], pa.int64()),
                        "key": pa.array([r.column("key")[i].as_py() for r, i in keys[first:first + 4096]],
                                        type=rows[0][0].schema.field("key").type)})

        return source.mapInArrow(run, schema)

    out = None
    for block in item_blocks(benchmark, item, item_text, block_words):
        out = found(block) if out is None else out.unionByName(found(block))
    best = out.groupBy("item", "item_word").agg(F.max_by(F.struct("key", "doc_word"), "length").alias("at"), F.max("length").alias("length"))
    return best.select("item", "item_word", "length", "at.key", "at.doc_word")


def decontaminate(docs: DataFrame, benchmark: DataFrame, text: str = "text", item: str = "item_id", item_text: str = "text",
                  window: int = WINDOW) -> DataFrame:
    """The documents in which no window of an item occurs; all their columns stay."""
    inner = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), F.col(f"`{text}`").alias("_text"))
    found = contamination(inner, benchmark, "_text", item, item_text, ["_row"], window)
    return found.filter(F.size("spans") == 0).select(*[F.col("_row").getField(c).alias(c) for c in docs.columns])
