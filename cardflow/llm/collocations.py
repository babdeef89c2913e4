"""Phrase collocations from counts of all phrases of up to `MOST` words, by multikey quicksort of suffix pointers.

Texts are lower-cased (A-Z), cut into pieces at punctuation and line ends and into words at spaces and tabs. Every word starts a
suffix: its language, the word and the words after it in its piece, `MOST` at most. A task merges equal suffixes of a few MB
of text into one with a weight. Suffixes are then routed by their leading words: splitters drawn from sampled suffixes
cut the order of (language, first word, second word, ..) into ranges, so a frequent word, or a frequent pair, is spread
over as many ranges as it needs; and one suffix weighs in once per few MB of text. The sample only decides how even the ranges are.

A range is sorted by three-way partitions around pivots, on the language first and one word deeper in every equal part. The
weight of an equal part is the count of its phrase. Parts below the least count are left unsorted, unless a splitter of
the range lies in the phrase, whose count is then one of several that are added up. All parts of a range
are partitioned together, one numpy step for all.

Null texts are empty, null languages `UNKNOWN`. Repeated rows count as often as they are there. Long texts are taken in windows of
`WINDOW` bytes that look ahead for the words their last suffixes need. An empty table gives no rows. Other columns are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cardflow.llm.common import bounded
from cardflow.operators import skew
from cardflow.sources.store import materialize

MOST = 3
LEAST = 10
PERCENT = 50
TOP = 2000
UNKNOWN = "und"
# Text bytes whose suffixes a task merges at once; text bytes that one range stands for; documents in the splitters' sample.
WINDOW = 6 << 20
RANGE_BYTES = 8 << 20
SAMPLED = 20_000
# Deals in which a language's candidates are ranked before they are ranked together.
DEALS = 128
# One of this many suffixes of a sampled document is a candidate for a splitter.
STRIDE = 31

# Every byte that ends a piece becomes a line feed, tabs become spaces, A-Z become a-z.
PIECES = bytes(
    10 if chr(b) in ".,;:!?\n\x0b\x0c\r" else 32 if b == 9 else b + 32 if 65 <= b <= 90 else b for b in range(256))
AHEAD = {n: re.compile(rb"(?: +[^ \n]+){0,%d}" % n) for n in range(1, 10)}
BREAK = re.compile(rb"[ \n]")


def cut(data: bytes, most: int, limit: int) -> Iterator[tuple[bytes, int]]:
    """Windows of about `limit` bytes, and how many words at a window's end only follow its own suffixes."""
    at = 0
    while len(data) - at > limit:
        end = data.rfind(b"\n", at, at + limit)
        if end <= at:
            end = data.rfind(b" ", at, at + limit)
        if end <= at:
            found = BREAK.search(data, at + limit)
            if not found:
                break
            end = found.start()
        ahead = AHEAD[most - 1].match(data, end).end() if most > 1 else end
        yield data[at:ahead], len(data[end:ahead].split())
        at = end
    yield data[at:], 0


class Suffixes(NamedTuple):
    """Distinct suffixes in ascending order: words by number, 0 where a piece has ended."""

    words: list[bytes]  # sorted; number n is words[n - 1]
    keys: np.ndarray  # most x suffixes
    weights: np.ndarray


def suffixes(data: bytes, ahead: int, most: int) -> Suffixes:
    """All suffixes of a window, equal ones merged."""
    numbers: dict[bytes, int] = {}
    tokens = data.replace(b"\n", b" \n ").split(b" ")
    at = np.fromiter((numbers.setdefault(t, len(numbers)) for t in tokens), np.int64, len(tokens))
    order = sorted(t for t in numbers if t not in (b"", b"\n"))
    rank = np.zeros(len(numbers), np.int64)
    rank[[numbers[t] for t in order]] = np.arange(1, len(order) + 1)
    at = rank[at[at != numbers.get(b"", -1)]]
    padded = np.concatenate([at, np.zeros(most, np.int64)])
    keys = np.stack([padded[i : i + len(at)] for i in range(most)])
    for i in range(1, most):
        keys[i] *= keys[i - 1] > 0
    starts = np.flatnonzero(keys[0])
    keys = keys[:, starts[: len(starts) - ahead]]
    # Pairs of keys become one dense number in the same order, so that nothing overflows.
    code, back = keys[0], []
    for i in range(1, most):
        found, inverse = np.unique(code * (len(order) + 1) + keys[i], return_inverse=True)
        back.append(found)
        code = inverse
    distinct, weights = np.unique(code, return_counts=True)
    made = np.zeros((most, len(distinct)), np.int64)
    code = distinct
    for i in range(most - 1, 0, -1):
        made[i], code = back[i - 1][code] % (len(order) + 1), back[i - 1][code] // (len(order) + 1)
    made[0] = code
    return Suffixes(order, made, weights)


class Splitters(NamedTuple):
    """Lower limits of all ranges but the first, ascending: the language and words, empty where a piece has ended."""

    columns: list[list[bytes]]

    def __len__(self) -> int:
        return len(self.columns[0])


def places(own: Suffixes, language: bytes, splitters: Splitters) -> np.ndarray:
    """For each splitter, how many of the language's suffixes lie before it."""
    known = np.array([*own.words, b"\xff"], object)
    limit = len(known) + 1
    kind = np.int64 if limit ** len(own.keys) < 1 << 62 else object
    code, exact = np.zeros(len(splitters), kind), np.ones(len(splitters), bool)
    codes = np.zeros(own.keys.shape[1], kind)
    languages = splitters.columns[0]
    for i, column in enumerate(splitters.columns[1:]):
        wanted = np.array([*column, b""], object)[:-1]
        left = np.searchsorted(known[:-1], wanted) + 1
        empty = np.array([not w for w in column], bool)
        number = np.where(empty, 0, left) * exact
        exact &= empty | (known[np.minimum(left, len(known)) - 1] == wanted)
        code = code * limit + number
        codes = codes * limit + own.keys[i]
    at = np.searchsorted(codes, code)
    before = np.array([x < language for x in languages], bool)
    after = np.array([x > language for x in languages], bool)
    return np.where(before, 0, np.where(after, len(codes), at))


ROUTED = "route int, lang binary, words binary, keys binary, weights binary"


def routed(own: Suffixes, language: bytes, splitters: Splitters) -> Iterator[dict]:
    """Suffixes range by range, each part with the words it uses."""
    bounds = np.concatenate([[0], places(own, language, splitters), [own.keys.shape[1]]])
    for route in np.flatnonzero(np.diff(bounds)).tolist():
        keys = own.keys[:, bounds[route] : bounds[route + 1]]
        used, renamed = np.unique(keys, return_inverse=True)
        if used[0] == 0:
            used = used[1:]
        else:
            renamed = renamed + 1
        yield {"route": route, "lang": language, "words": b" ".join(own.words[n - 1] for n in used),
               "keys": renamed.reshape(keys.shape).astype("<i4").tobytes(),
               "weights": own.weights[bounds[route] : bounds[route + 1]].astype("<i8").tobytes()}


def by_language(batches: Iterator[pa.RecordBatch], limit: int) -> Iterator[tuple[bytes, bytes]]:
    """(language, texts joined as pieces) with about `limit` bytes each, or one longer text."""
    held: dict[bytes, list[bytes]] = {}
    sizes: dict[bytes, int] = {}
    total = 0
    for batch in batches:
        for part in bounded(batch, 0, limit):
            for text, language in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                if text:
                    name = (UNKNOWN if language is None else language).encode()
                    held.setdefault(name, []).append(text.encode().translate(PIECES))
                    sizes[name] = sizes.get(name, 0) + len(text)
                    total += len(text)
                    if sizes[name] >= limit:
                        total -= sizes.pop(name)
                        yield name, b"\n".join(held.pop(name))
            if total > 4 * limit:
                for name in list(held):
                    yield name, b"\n".join(held.pop(name))
                sizes.clear()
                total = 0
    for name in held:
        yield name, b"\n".join(held[name])


def three_way(keys: np.ndarray, weights: np.ndarray, least: int, shared: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(depth, pointers, counts) of the distinct prefixes of 1 to len(keys) keys: one suffix that begins with each, and its weight.

    Prefixes below `least` are left out unless `shared`, by depth and suffix, marks them. A key of 0 ends a suffix.
    """
    most = len(keys)
    pointers = np.arange(keys.shape[1])
    starts, depths = np.zeros(min(1, len(pointers)), np.int64), np.zeros(min(1, len(pointers)), np.int64)
    while len(starts):
        sizes = np.diff(np.append(starts, len(pointers)))
        part = np.repeat(np.arange(len(starts)), sizes)
        key = keys[depths[part], pointers]
        three = np.sort(np.stack([key[starts], key[starts + sizes // 2], key[starts + sizes - 1]]), axis=0)
        side = np.sign(key - three[1][part]) + 1
        # A stable counting sort by (part, side).
        group = part * 3 + side
        counts = np.bincount(group, minlength=3 * len(starts))
        offsets = np.cumsum(counts) - counts
        target = np.empty(len(pointers), np.int64)
        for s in range(3):
            mine = np.flatnonzero(side == s)
            own = counts[s::3]
            target[mine] = np.repeat(offsets[s::3] - (np.cumsum(own) - own), own) + np.arange(len(mine))
        moved = np.empty_like(pointers)
        moved[target] = pointers
        pointers = moved
        full = np.flatnonzero(counts)
        starts, sizes = offsets[full], counts[full]
        equal, depths = full % 3 == 1, depths[full // 3]
        total = np.add.reduceat(weights[pointers], starts)
        marked = np.maximum.reduceat(shared[np.repeat(depths, sizes), pointers], starts)
        goes_on = (total >= least) | marked
        done = np.flatnonzero(equal & goes_on)
        for depth in range(most):
            at = done[depths[done] == depth]
            if len(at):
                yield depth, pointers[starts[at]], total[at]
        depths = depths + equal
        goes_on &= depths < most
        # Suffixes that end here go no deeper.
        alive = np.repeat(goes_on, sizes)
        deeper = np.repeat(depths, sizes)
        alive[alive] = keys[deeper[alive], pointers[alive]] > 0
        left = np.add.reduceat(alive, starts)
        pointers, depths = pointers[alive], depths[left > 0]
        left = left[left > 0]
        starts = np.cumsum(left) - left


COUNTED = "lang string, size int, phrase string, n long"


def counted(table: pa.Table, most: int, least: int, splitters: Splitters) -> pa.Table:
    """Counts of the phrases of one range; size 0 is the language with all its words."""
    route = table.column("route")[0].as_py()
    numbers: dict[bytes, int] = {}
    languages: dict[bytes, int] = {}
    parts, weights = [], []
    for lang, words, keys, weight in zip(*(table.column(c).to_pylist() for c in ("lang", "words", "keys", "weights")), strict=True):
        own = np.array([0, *(numbers.setdefault(w, len(numbers) + 1) for w in words.split(b" "))], np.int32)
        keys = own[np.frombuffer(keys, "<i4").reshape(most, -1)]
        parts.append(np.concatenate([np.full((1, keys.shape[1]), languages.setdefault(lang, len(languages) + 1), np.int32), keys]))
        weights.append(np.frombuffer(weight, "<i8"))
    keys, weight = np.concatenate(parts, axis=1), np.concatenate(weights)
    shared = np.zeros(keys.shape, bool)
    shared[0] = True
    for edge in {r for r in (route - 1, route) if 0 <= r < len(splitters)}:
        same = keys[0] == languages.get(splitters.columns[0][edge], -1)
        for depth in range(1, most + 1):
            same = same & (keys[depth] == numbers.get(splitters.columns[depth][edge], 0))
            shared[depth] |= same
    words = [b"", *numbers]
    names = [b"", *languages]
    out: list[tuple[str, int, str, int]] = []
    for depth, pointers, counts in three_way(keys, weight, least, shared):
        for column, n in zip(keys[: depth + 1, pointers].T.tolist(), counts.tolist(), strict=True):
            out.append((names[column[0]].decode(), depth, b" ".join(words[w] for w in column[1:]).decode(), n))
    columns = list(zip(*out, strict=True)) if out else [[], [], [], []]
    return pa.table([pa.array(columns[0], pa.string()), pa.array(columns[1], pa.int32()), pa.array(columns[2], pa.string()),
                     pa.array(columns[3], pa.int64())], names=["lang", "size", "phrase", "n"])


def splitters_of(docs: DataFrame, most: int, ranges: int) -> Splitters:
    """Limits of `ranges` ranges that hold about as many of the sampled suffixes; they are all that comes to the driver."""
    names = ["lang", *(f"w{i}" for i in range(1, most + 1))]
    if ranges < 2:
        return Splitters([[] for _ in names])
    rows = docs.count()
    sample = docs if rows <= SAMPLED else docs.sample(SAMPLED / rows, seed=7)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for language, data in by_language(batches, WINDOW):
            for window, ahead in cut(data, most, WINDOW):
                own = suffixes(window, ahead, most)
                every = np.arange(0, own.keys.shape[1], STRIDE)
                words = [b"", *own.words]
                columns = [[words[n].decode() for n in own.keys[i, every].tolist()] for i in range(most)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([language.decode()] * len(every), pa.string()), *(pa.array(c, pa.string()) for c in columns)], names=names)

    keys = sample.mapInArrow(run, ", ".join(f"{n} string" for n in names))
    firsts = keys.repartitionByRange(ranges, *names).groupBy(F.spark_partition_id().alias("range")).agg(
        F.min(F.struct(*names)).alias("first")).select("first.*").collect()
    limits = sorted(tuple(r[n].encode() for n in names) for r in firsts)[1:]
    return Splitters([[limit[i] for limit in limits] for i in range(len(names))])


def phrase_counts(docs: DataFrame, most: int = MOST, least: int = LEAST, ranges: int | None = None) -> DataFrame:
    """(lang, size, phrase, n): all phrases of 1 to `most` words at or above `least` and, as size 0, each language's words."""
    texts = docs.select("text", F.coalesce("lang", F.lit(UNKNOWN)).alias("lang"))
    if ranges is None:
        size = texts.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
        ranges = max(docs.sparkSession.sparkContext.defaultParallelism, -(-size // RANGE_BYTES))
    splitters = splitters_of(texts, most, ranges)
    held = docs.sparkSession.sparkContext.broadcast(splitters)
    schema = pa.schema([("route", pa.int32()), *((n, pa.binary()) for n in ("lang", "words", "keys", "weights"))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for language, data in by_language(batches, WINDOW):
            for window, ahead in cut(data, most, WINDOW):
                rows = list(routed(suffixes(window, ahead, most), language, held.value))
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema)

    def count(table: pa.Table) -> pa.Table:
        return counted(table, most, least, held.value)

    partial = texts.mapInArrow(run, ROUTED).groupBy("route").applyInArrow(count, COUNTED)
    return partial.groupBy("lang", "size", "phrase").agg(F.sum("n").alias("n")).filter(
        (F.col("size") == 0) | (F.col("n") >= least))


def cuts(counts: DataFrame) -> DataFrame:
    """Every way to cut every candidate in two: lang, phrase, a, k, left, right."""
    whole = counts.filter("size > 1").select("lang", "phrase", F.col("n").alias("a"), "size", F.split("phrase", " ").alias("_words"))
    part = F.explode(F.sequence(F.lit(1), F.col("size") - 1))
    return whole.select("lang", "phrase", "a", "size", "_words", part.alias("k")).select(
        "lang", "phrase", "a", "k", F.array_join(F.slice("_words", 1, F.col("k")), " ").alias("left"),
        F.array_join(F.slice("_words", F.col("k") + 1, F.col("size")), " ").alias("right"))


def with_count(rows: DataFrame, counts: DataFrame, part: str, name: str, heavy_rows: int) -> DataFrame:
    """Adds the count of the phrase in `part`. A word that very many candidates share is salted."""
    asked = rows.groupBy("lang", part).agg(F.count(F.lit(1)).alias("_asked"))
    lookup = asked.join(counts.select("lang", F.col("phrase").alias(part), F.col("n").alias(name)), ["lang", part])
    return skew.spread_join(rows, lookup, ["lang", part], "_asked", ["phrase"], heavy_rows).drop("_asked")


def score(a: Column, left: Column, right: Column) -> Column:
    """floor(1,000,000 a a / (left right)) in exact decimals: counts up to 10^15."""
    wide = lambda c: c.cast("decimal(15,0)")
    return F.call_function("div", wide(a) * wide(a) * F.lit(1_000_000).cast("decimal(7,0)"), wide(left) * wide(right))


def collocations(
    docs: DataFrame, most: int = MOST, least: int = LEAST, percent: int = PERCENT, top: int = TOP,
    ranges: int | None = None, heavy_rows: int = skew.HEAVY_ROWS,
) -> DataFrame:
    """Each language's first `top` phrases of 2 to `most` words: lang, rank, phrase, a, l, r, n, score.

    A phrase is scored by its worst cut; one whose words lie in a longer candidate with at least `percent` of its count is dropped.
    """
    counts = materialize(phrase_counts(docs, most, least, ranges), "phrase-counts")
    phrases = counts.filter("size > 0")
    cut_rows = with_count(with_count(cuts(phrases), phrases, "left", "l", heavy_rows), phrases, "right", "r", heavy_rows)
    worst = cut_rows.groupBy("lang", "phrase", "a").agg(
        F.min(F.struct(score(F.col("a"), F.col("l"), F.col("r")).alias("score"), "k", "l", "r")).alias("cut"))
    # The largest count among the longer candidates around each phrase.
    longer = phrases.filter("size > 2").select(
        "lang", "n", "size", F.split("phrase", " ").alias("_words"), F.explode(F.sequence(F.lit(2), F.col("size") - 1)).alias("_n")
    ).select("lang", "n", "_words", "_n", F.explode(F.sequence(F.lit(1), F.col("size") - F.col("_n") + 1)).alias("_at"))
    around = longer.groupBy("lang", F.array_join(F.slice("_words", F.col("_at"), F.col("_n")), " ").alias("phrase")).agg(
        F.max("n").alias("_around"))
    kept = worst.join(around, ["lang", "phrase"], "left").filter(
        F.col("_around").isNull() | (100 * F.col("_around") < percent * F.col("a")))
    # The first of every deal hold the first of all, so a language's last sort sees `top` rows per deal however many it has.
    order = [F.desc("cut.score"), F.desc("a"), F.asc("phrase")]
    dealt = W.partitionBy("lang", F.pmod(F.xxhash64("phrase"), F.lit(DEALS))).orderBy(*order)
    firsts = kept.withColumn("_rank", F.row_number().over(dealt)).filter(F.col("_rank") <= top)
    ranked = firsts.withColumn("rank", F.row_number().over(W.partitionBy("lang").orderBy(*order))).filter(F.col("rank") <= top)
    totals = counts.filter("size = 0").select("lang", F.col("n").alias("_all"))
    return ranked.join(totals, "lang").select(
        "lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", F.col("cut.l").alias("l"), F.col("cut.r").alias("r"),
        F.col("_all").alias("n"), F.col("cut.score").cast("long").alias("score"))
