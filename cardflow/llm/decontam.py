"""Benchmark decontamination by winnowing.

Of every `KEEP` neighbouring `K`-word hashes the smallest is kept (the rightmost of equals), so any shared
span of K + KEEP - 1 = `WINDOW` words leaves a common fingerprint. Documents and benchmark are fingerprinted alike; where
a document's fingerprint is known, the windows around it are compared in full and hits grow over their words.

A benchmark item of fewer than WINDOW words is one window of its own length; such windows are looked up at every
word, for winnowing promises nothing about them. Items without words are never found.

The benchmark is read in blocks of bounded size, each held by every task; documents are scanned once per block and
no text is shuffled. A null text has no words. Rows are told apart by position, so repeated or null ids do no harm.
"""

from __future__ import annotations

from itertools import chain
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cardflow.llm.common import extend, fresh, mix, utf8
from cardflow.sources.store import materialize

WINDOW = 10
K = 5
KEEP = WINDOW - K + 1
# Text bytes of the benchmark per block; a task holds about ten times that.
BLOCK_BYTES = 8 << 20
# Word bytes in lower case, 0 for all that stands between words.
FOLD = np.zeros(256, np.uint8)
FOLD[48:58] = np.arange(48, 58)
FOLD[97:123] = FOLD[65:91] = np.arange(97, 123)
FOLD[128:] = np.arange(128, 256)
# Odd factors of rolling hashes, one per 64-bit lane.
LANES = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F))


class Words(NamedTuple):
    lanes: tuple[np.ndarray, np.ndarray]  # two 64-bit hashes of each word
    starts: np.ndarray  # first word of each text, and the end


def powers(factor: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, factor, np.uint64)
    if n:
        out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


def words_of(texts: pa.Array) -> Words:
    """Hashes of all words of all texts from prefix sums over the bytes, in whole-array steps."""
    raw, bounds = utf8(texts)
    folded = np.zeros(len(raw) + len(texts) + 1, np.uint8)
    row = np.repeat(np.arange(len(texts)), np.diff(bounds))
    folded[np.arange(len(raw)) + row + 1] = FOLD[raw]
    inside = folded != 0
    edges = np.flatnonzero(inside[1:] != inside[:-1]) + 1
    begin, end = edges[::2], edges[1::2] if len(edges) % 2 == 0 else np.append(edges[1::2], len(folded))
    lanes = []
    for factor in LANES:
        inverse = np.uint64(pow(int(factor), -1, 1 << 64))
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(
            mix(folded.astype(np.uint64) + factor) * powers(factor, len(folded)), dtype=np.uint64)])
        lanes.append(mix((sums[end] - sums[begin]) * powers(inverse, len(folded) + 1)[begin]))
    starts = np.searchsorted(begin, bounds + np.arange(len(texts) + 1))
    return Words((lanes[0], lanes[1]), starts)


def spans_hash(words: np.ndarray, length: int) -> np.ndarray:
    """Hash of the `length` words from each word on; the last ones wrap into nothing and are never valid."""
    count = max(0, len(words) - length + 1)
    out = np.zeros(count, np.uint64)
    for i in range(length):
        out = out * LANES[1] + words[i : i + count]
    return mix(out)


def whole(starts: np.ndarray, count: int, length: int) -> np.ndarray:
    """Which of the first `count` words begin `length` words of one text."""
    ok = np.zeros(max(0, int(starts[-1])) + 1, np.int32)
    lengths = np.diff(starts)
    long = lengths >= length
    np.add.at(ok, starts[:-1][long], 1)
    np.add.at(ok, starts[:-1][long] + lengths[long] - length + 1, -1)
    return np.cumsum(ok)[:count] > 0


def winnow(words: Words) -> np.ndarray:
    """Positions of the kept K-grams; texts shorter than WINDOW keep none here."""
    grams = spans_hash(words.lanes[0], K)
    windows = np.flatnonzero(whole(words.starts, max(0, len(grams) - KEEP + 1), WINDOW))
    if not len(windows):
        return windows
    best, place = grams[windows], windows.copy()
    for i in range(1, KEEP):
        other = grams[windows + i]
        smaller = other <= best
        best[smaller], place[smaller] = other[smaller], windows[smaller] + i
    return np.unique(place)


class Lookup(NamedTuple):
    """Sorted 128-bit hashes behind a bitmap that turns most strangers away."""

    bitmap: np.ndarray
    high: np.ndarray
    low: np.ndarray
    value: np.ndarray

    @staticmethod
    def of(high: np.ndarray, low: np.ndarray, value: np.ndarray) -> Lookup:
        order = np.lexsort((low, high))
        bits = max(16, int(len(high)).bit_length() + 4)
        bitmap = np.zeros(1 << bits, bool)
        bitmap[(high >> np.uint64(64 - bits)).astype(np.int64)] = True
        return Lookup(bitmap, high[order], low[order], value[order])

    def maybe(self, high: np.ndarray) -> np.ndarray:
        bits = len(self.bitmap).bit_length() - 1
        return self.bitmap[(high >> np.uint64(64 - bits)).astype(np.int64)]

    def find(self, high: np.ndarray, low: np.ndarray) -> np.ndarray:
        """Place of each hash, or -1. Equal high halves are walked through."""
        out = np.full(len(high), -1, np.int64)
        if not len(self.high):
            return out
        todo = np.flatnonzero(self.maybe(high))
        at = np.searchsorted(self.high, high[todo])
        while len(todo):
            ok = at < len(self.high)
            todo, at = todo[ok], at[ok]
            same = self.high[at] == high[todo]
            todo, at = todo[same], at[same]
            hit = self.low[at] == low[todo]
            out[todo[hit]] = at[hit]
            todo, at = todo[~hit], at[~hit] + 1
        return out


class Block(NamedTuple):
    fingerprints: np.ndarray  # sorted, of windows of full length
    bitmap: np.ndarray
    windows: dict[int, Lookup]  # by length; value: number of the distinct window
    owners: np.ndarray  # item numbers of each distinct window, by bounds
    bounds: np.ndarray
    items: list  # item ids


def block_of(items: list, texts: pa.Array) -> Block:
    words = words_of(texts)
    grams = spans_hash(words.lanes[0], K)
    fingerprints = np.unique(grams[winnow(words)])
    bits = max(16, len(fingerprints).bit_length() + 4)
    bitmap = np.zeros(1 << bits, bool)
    bitmap[(fingerprints >> np.uint64(64 - bits)).astype(np.int64)] = True
    item_of = np.repeat(np.arange(len(items)), np.diff(words.starts))
    lengths = np.diff(words.starts)
    windows, owners, number = {}, [], 0
    for length in sorted({int(min(n, WINDOW)) for n in lengths if n}):
        high, low = (spans_hash(lane, length) for lane in words.lanes)
        own = whole(words.starts, len(high), length) & (
            (lengths[item_of[: len(high)]] == length) if length < WINDOW else True)
        at = np.flatnonzero(own)
        pairs, inverse = np.unique(np.column_stack([high[at], low[at]]), axis=0, return_inverse=True)
        windows[length] = Lookup.of(pairs[:, 0], pairs[:, 1], number + np.arange(len(pairs)))
        owners.append(np.unique(np.column_stack([number + inverse.ravel(), item_of[at]]), axis=0))
        number += len(pairs)
    held = np.concatenate(owners) if owners else np.zeros((0, 2), np.int64)
    return Block(fingerprints, bitmap, windows, held[:, 1], np.searchsorted(held[:, 0], np.arange(number + 1)), items)


def search(texts: pa.Array, block: Block) -> tuple[np.ndarray, list[np.ndarray], list[np.ndarray]]:
    """Per text: number of words, hit words as flat (from, to) runs, and item numbers found."""
    words = words_of(texts)
    n = int(words.starts[-1])
    cover = np.zeros(n + 1, np.int64)
    found_word, found_window = [], []
    for length, lookup in block.windows.items():
        if length == WINDOW:
            kept = winnow(words)
            hashes = spans_hash(words.lanes[0], K)[kept]
            bits = len(block.bitmap).bit_length() - 1
            maybe = block.bitmap[(hashes >> np.uint64(64 - bits)).astype(np.int64)]
            kept, hashes = kept[maybe], hashes[maybe]
            place = np.minimum(np.searchsorted(block.fingerprints, hashes), max(0, len(block.fingerprints) - 1))
            kept = kept[block.fingerprints[place] == hashes] if len(block.fingerprints) else kept[:0]
            # A kept gram lies in the windows that begin up to KEEP - 1 words before it.
            at = np.unique((kept[:, None] - np.arange(KEEP)[None, :]).ravel())
            at = at[at >= 0]
        else:
            at = np.arange(n)
        ok = whole(words.starts, n, length)
        at = at[ok[at]]
        if not len(at):
            continue
        high, low = (spans_hash(lane, length)[at] for lane in words.lanes)
        place = lookup.find(high, low)
        at, place = at[place >= 0], place[place >= 0]
        np.add.at(cover, at, 1)
        np.add.at(cover, at + length, -1)
        found_word.append(at)
        found_window.append(lookup.value[place])
    covered = np.cumsum(cover)[:n] > 0
    at = np.concatenate(found_word) if found_word else np.zeros(0, np.int64)
    window = np.concatenate(found_window) if found_window else at
    row = np.searchsorted(words.starts, at, side="right") - 1
    runs, items = [np.zeros(0, np.int64)] * len(texts), [np.zeros(0, np.int64)] * len(texts)
    for i in np.unique(row):
        start, end = words.starts[i], words.starts[i + 1]
        flag = np.diff(np.concatenate([[0], covered[start:end].astype(np.int8), [0]]))
        runs[i] = np.column_stack([np.flatnonzero(flag > 0), np.flatnonzero(flag < 0)]).ravel()
        own = np.unique(window[row == i])
        items[i] = np.unique(np.concatenate([block.owners[block.bounds[w] : block.bounds[w + 1]] for w in own]))
    return np.diff(words.starts), runs, items


def blocks(benchmark: DataFrame, limit: int):
    """(items, texts) of the benchmark, about `limit` text bytes at a time. Null and wordless items are left out.

    Rows come one Spark partition at a time, and each partition is read in parts of bounded size.
    """
    rows = benchmark.filter(F.col("text").isNotNull()).select(F.col("item_id").cast("string"), "text")
    ids, texts, size = [], [], 0
    for row in rows.toLocalIterator():
        ids.append(row[0])
        texts.append(row[1])
        size += len(row[1].encode())
        if size >= limit:
            yield ids, texts
            ids, texts, size = [], [], 0
    if ids:
        yield ids, texts


FOUND = [T.StructField("n_words", T.LongType()), T.StructField("runs", T.ArrayType(T.LongType())),
         T.StructField("items", T.ArrayType(T.StringType()))]


def search_block(docs: DataFrame, block: Block, names: list[str]) -> DataFrame:
    held = docs.sparkSession.sparkContext.broadcast(block)  # bounded by BLOCK_BYTES

    def compute(texts: pa.Array) -> list[pa.Array]:
        block = held.value
        n, runs, items = search(texts, block)
        return [pa.array(n, pa.int64()), pa.array([r.tolist() for r in runs], pa.list_(pa.int64())),
                pa.array([[block.items[i] for i in own] for own in items], pa.list_(pa.string()))]

    return extend(docs, [T.StructField(n, f.dataType) for n, f in zip(names, FOUND, strict=True)], compute)


def digest(items: Column) -> Column:
    return F.sha2(F.array_join(F.array_sort(F.array_distinct(items)), ","), 256)


def hit_words(runs: Column) -> Column:
    """Number of words in flat (from, to) runs that do not overlap."""
    pair = lambda x, i: F.when(i % 2 == 1, x).otherwise(-x)
    return F.aggregate(F.transform(runs, pair), F.lit(0).cast("long"), lambda total, x: total + x)


def merged(runs: Column) -> Column:
    """Overlapping runs of several blocks as runs that do not overlap."""
    count = (F.size(runs) / 2).cast("int")
    pairs = F.when(count > 0, F.transform(F.sequence(F.lit(1), F.greatest(count, F.lit(1))), lambda i: F.struct(
        F.element_at(runs, 2 * i - 1).alias("a"), F.element_at(runs, 2 * i).alias("b"))))
    start = F.struct(F.lit(0).cast("long").alias("end"), F.lit(0).cast("long").alias("n"))
    step = lambda s, p: F.struct(
        F.greatest(s.end, p.b).alias("end"),
        (s.n + F.greatest(p.b - F.greatest(s.end, p.a), F.lit(0).cast("long"))).alias("n"))
    return F.coalesce(F.aggregate(F.array_sort(pairs), start, step).getField("n"), F.lit(0).cast("long"))


def search_all(docs: DataFrame, benchmark: DataFrame, names: list[str], hits: str, block_bytes: int) -> DataFrame:
    """All columns of `docs` with number of words, runs of hit words (several blocks: those of each), items and number of hit words."""
    made = (block_of(ids, pa.array(texts, pa.string())) for ids, texts in blocks(benchmark, block_bytes))
    first, second = next(made, None) or block_of([], pa.array([], pa.string())), next(made, None)
    if second is None:
        return search_block(docs, first, names).withColumn(hits, hit_words(F.col(names[1])))
    # One block is held at a time; rows keep their place, and the small findings meet by it.
    place = fresh(docs, "place")
    numbered = materialize(docs.withColumn(place, F.monotonically_increasing_id()), "leak-rows")
    every = None
    for block in chain([first, second], made):
        scan = materialize(search_block(numbered.select(place, "text"), block, names).drop("text"), "leak-findings")
        every = scan if every is None else every.unionAll(scan)
    # At most a run and an item list per block and row.
    gathered = every.groupBy(place).agg(
        F.first(names[0]).alias(names[0]), F.flatten(F.collect_list(names[1])).alias(names[1]),
        F.flatten(F.collect_list(names[2])).alias(names[2]))
    found = gathered.withColumn(hits, merged(F.col(names[1])))
    return numbered.join(found, place).drop(place)


def find_leaks(docs: DataFrame, benchmark: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated: one row per row of `docs`."""
    found = search_all(docs.select("doc_id", "text"), benchmark, [f.name for f in FOUND], "n_hit", block_bytes)
    return found.select(
        "doc_id", "n_words", "n_hit", F.size(F.array_distinct("items")).cast("long").alias("n_items"),
        digest(F.col("items")).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def drop_leaks(docs: DataFrame, benchmark: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The rows of `docs` without any hit word."""
    names = [fresh(docs, f.name) for f in FOUND]
    hits = fresh(docs, "n_hit")
    return search_all(docs, benchmark, names, hits, block_bytes).filter(F.col(hits) == 0).select(*docs.columns)
