"""Brown class-based n-grams: P(text) = product of P(class | class before) * P(word | class).

Counts come from all training documents, and every word in them gets a class. The number of classes grows with the number
of distinct words. The commonest words seed the classes by exchange clustering: starting from classes dealt by frequency,
each word in turn moves to the class that most raises the likelihood of the class bigrams. All other words move in sweeps
run by tasks: a word goes to the class under which the classes before and after all of its occurrences are likeliest,
given the transitions of the seeds. The first sweep moves the `SWEPT` commonest words and knows the seeds' classes, the
second moves every word and knows the classes of all swept ones; other neighbours count as one open class. Transitions
and emissions are counted after that, over all tokens with their own classes. Words never counted share one more class,
and the end of a text has its own, which is also the class before the first word. Emissions add `EMIT` to every known
count; unknown words get one such share. Class transitions mix relative frequencies with `MIX` of the class's own
frequency.

Texts are split twice: to count the words, and to write them as numbers of the commonest words. All later passes read the
numbers; words without one stay beside them as text.

Null and empty texts are just the end. Without training tokens every event has probability one in its vocabulary.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cardflow.llm.common import bounded, fold_of
from cardflow.sources.store import materialize

# The least number of seeds and of classes; both grow with the number of distinct words.
CLUSTERED = 2_000
CLASSES = 64
GROWTH = 0.375
SEEDS_PER_CLASS = 4
SWEEPS = 5
# Text bytes split at once, the words whose contexts a task counts at once, and the entries it weighs at once.
COUNTED = 16 << 20
STRETCH = 2 << 20
WEIGHED = 4_096
# Classes around a word from which on its list is multiplied as a full row.
FULL = 48
# A context and its count in one number.
SHIFT = 40
# Words whose classes and counts every task holds; others are looked up by a join.
HELD = 200_000
# Words whose classes the last sweep knows.
SWEPT = 200_000
# Weights of classes are whole multiples of this share of a decimal power.
FINE = 1 << 16
EMIT = 0.5
MIX = 0.1
# The end of a text as a key among the words: no word has a space.
END = " "


def split(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """All words of the texts in one array, A-Z lower-cased, and where those of each text begin and end."""
    lists = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(texts.cast(pa.string()), "")))
    words, bounds = lists.flatten(), lists.offsets.to_numpy() - lists.offsets[0].as_py()
    # White space at an end of a text leaves an empty word there.
    full = pc.greater(pc.binary_length(words), 0)
    return words.filter(full), np.concatenate([[0], np.cumsum(full.to_numpy(zero_copy_only=False))])[bounds]


def word_counts(docs: DataFrame) -> DataFrame:
    """(word, n) over whole texts, one END per text."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in bounded(batch, 0, COUNTED):
                found = pc.value_counts(split(part.column(0))[0])
                yield pa.RecordBatch.from_arrays(
                    [pa.concat_arrays([found.field(0), pa.array([END])]), pa.concat_arrays([found.field(1), pa.array([part.num_rows])])],
                    names=["word", "n"])

    return docs.select("text").mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def numbered(docs: DataFrame, names: list[str], learned: Column) -> DataFrame:
    """place, doc_id, learned, numbers (place of each word in `names`, one more for words not there, then two more for the
    END of the text), others (the words not there, in order): texts are split once, all that follows reads numbers.
    """
    held = docs.sparkSession.sparkContext.broadcast(pa.array(names, pa.string()))
    rest = len(names)
    fields = [T.StructField("numbers", T.ArrayType(T.IntegerType())), T.StructField("others", T.ArrayType(T.StringType()))]
    given = docs.select("doc_id", learned.alias("learned"), "text")
    schema = T.StructType([*given.schema.fields[:2], *fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in bounded(batch, 2, COUNTED):
                words, bounds = split(part.column(2))
                found = pc.fill_null(pc.index_in(words, value_set=held.value), rest).to_numpy()
                row = np.repeat(np.arange(part.num_rows), np.diff(bounds))
                numbers = np.full(len(words) + part.num_rows, rest + 1, np.int32)
                numbers[np.arange(len(words)) + row] = found
                ends, unknown = bounds + np.arange(len(bounds)), found == rest
                before = np.concatenate([[0], np.cumsum(unknown)])[bounds]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(numbers)),
                     pa.ListArray.from_arrays(pa.array(before.astype(np.int32)), words.filter(pa.array(unknown)))],
                    names=schema.fieldNames())

    return materialize(given.mapInArrow(run, schema).withColumn("place", F.monotonically_increasing_id()), "numbered")


def stretches(numbers: pa.Array, end: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Bounded stretches of the numbers of many texts, with the number before and after each; texts begin after an END."""
    edge = np.array([end], np.int32)
    flat = np.concatenate([edge, numbers.flatten().to_numpy(), edge])
    for at in range(1, len(flat) - 1, STRETCH):
        to = min(at + STRETCH, len(flat) - 1)
        yield flat[at - 1 : to - 1], flat[at:to], flat[at + 1 : to + 1]


def runs(keys: np.ndarray) -> np.ndarray:
    """Where runs of equal sorted keys begin."""
    return np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else np.zeros(0, np.int64)


def pair_counts(rows: DataFrame, seeds: int, rest: int) -> DataFrame:
    """(pair, n): neighbours a, b as a * (seeds + 2) + b; words that are no seeds share the one after the last, then comes END."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seed = np.concatenate([np.arange(seeds), np.full(rest + 1 - seeds, seeds), [seeds + 1]])
        for batch in batches:
            for before, at, _ in stretches(batch.column(0), rest + 1):
                pairs = seed[before] * (seeds + 2) + seed[at]
                pairs.sort()
                starts = runs(pairs)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(pairs[starts]), pa.array(np.diff(np.append(starts, len(pairs))))], names=["pair", "n"])

    return rows.select("numbers").mapInArrow(run, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n"))


def xlogx(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.maximum(x, 1))


def exchange(a: np.ndarray, b: np.ndarray, n: np.ndarray, words: int, classes: int, sweeps: int) -> np.ndarray:
    """Class of each of `words` + 2 numbers (the last two keep classes of their own) by exchange clustering.

    Maximises sum N(c, d) log N(c, d) - sum N(c, .) log N(c, .) - sum N(., d) log N(., d).
    """
    total = words + 2
    own = np.concatenate([np.arange(words) % classes, [classes, classes + 1]])
    size = classes + 2
    table = np.zeros((size, size))
    np.add.at(table, (own[a], own[b]), n)
    order_a, order_b = np.argsort(a, kind="stable"), np.argsort(b, kind="stable")
    from_a = np.searchsorted(a[order_a], np.arange(total + 1))
    from_b = np.searchsorted(b[order_b], np.arange(total + 1))
    for _ in range(sweeps):
        moved = 0
        for w in range(words):
            out_edges, in_edges = order_a[from_a[w] : from_a[w + 1]], order_b[from_b[w] : from_b[w + 1]]
            other_out, other_in = out_edges[b[out_edges] != w], in_edges[a[in_edges] != w]
            loop = n[out_edges].sum() - n[other_out].sum()
            out = np.bincount(own[b[other_out]], n[other_out], size)
            into = np.bincount(own[a[other_in]], n[other_in], size)
            old = own[w]
            table[old, :] -= out
            table[:, old] -= into
            table[old, old] -= loop
            rows, columns = table.sum(axis=1), table.sum(axis=0)
            # Gain of adding w to class c: row c gets `out`, column c gets `into`, the corner all of both.
            after, before = np.flatnonzero(out), np.flatnonzero(into)
            right, left = table[:, after], table[before]
            gain = (xlogx(right + out[after]) - xlogx(right)).sum(axis=1)
            gain += (xlogx(left + into[before, None]) - xlogx(left)).sum(axis=0)
            corner = np.diagonal(table)
            gain += xlogx(corner + out + into + loop) - xlogx(corner + out) - xlogx(corner + into) + xlogx(corner)
            gain -= xlogx(rows + out.sum() + loop) - xlogx(rows) + xlogx(columns + into.sum() + loop) - xlogx(columns)
            best = int(np.argmax(gain[:classes]))
            if gain[best] <= gain[old] + 1e-9:
                best = old
            moved += best != old
            own[w] = best
            table[best, :] += out
            table[:, best] += into
            table[best, best] += loop
        if not moved:
            break
    return own


class Words(NamedTuple):
    rows: DataFrame  # the texts as `numbered`
    names: list[str]  # the commonest words
    counts: np.ndarray  # of each number
    own: np.ndarray  # class of each number, of unknown words and of END
    rare: DataFrame  # word, n, class: every counted word without a number
    held: int  # numbers below are looked up where the row is, other words by a join
    emission: np.ndarray  # per class: count of its words, and of its distinct words
    tokens: int
    distinct: int
    end: int  # count of END

    def divisor(self) -> np.ndarray:
        """log10 of each class's total, with `EMIT` for every word of it; unknown words have one share."""
        unknown = np.arange(len(self.emission)) == len(self.emission) - 2
        return np.log10(EMIT * (self.emission[:, 1] + unknown).clip(1) + self.emission[:, 0])

    def joined(self, first: int) -> DataFrame:
        """word, n, class: every counted word without a number below `first`."""
        if first == len(self.names):
            return self.rare
        table = pa.table({"word": pa.array(self.names[first:], pa.string()), "n": self.counts[first:].astype(np.int64),
                          "class": self.own[first:-2].astype(np.int32)})
        return self.rare.unionByName(self.rare.sparkSession.createDataFrame(table))

    @property
    def table(self) -> DataFrame:
        """word, n, class: every counted word."""
        return self.joined(0)


class ClassModel(NamedTuple):
    numbers: dict[bytes, int]  # the commonest words
    own: np.ndarray  # class of each number, of unknown words and of END
    transition: np.ndarray  # log10 P(class | class before)
    emission: np.ndarray  # per class: count of its words, and of its distinct words
    tokens: int
    distinct: int


class Learned(NamedTuple):
    words: Words
    model: ClassModel


def level() -> Column:
    return F.floor(F.log2("n") * 8)


def commonest(vocabulary: DataFrame, *limits: int) -> tuple[dict[str, int], list[int]]:
    """Counts of the commonest words, highest first, and how many of them come within each limit.

    Counts are binned by an eighth of a doubling and whole levels are taken, so nothing is sorted outside the driver and no
    task gathers candidates of all others.
    """
    bins = vocabulary.groupBy(level().alias("level")).agg(F.count(F.lit(1)).alias("words")).collect()
    least = []
    for room in limits:
        reached = math.inf
        for r in sorted(bins, key=lambda r: -r["level"]):
            room -= r["words"]
            if room < 0:
                break
            reached = r["level"]
        least.append(reached)
    if min(least) == math.inf:
        return {}, [0 for _ in limits]
    top = vocabulary.withColumn("level", level()).filter((F.col("level") >= min(least)) & (F.col("word") != END)).toArrow()
    counts = dict(zip(top.column("word").to_pylist(), top.column("n").to_pylist(), strict=True))
    levels = top.column("level").to_numpy()
    return {w: counts[w] for w in sorted(counts, key=lambda w: (-counts[w], w))}, [int((levels >= x).sum()) for x in least]


def smoothed(table: np.ndarray, rest: int | None = None) -> np.ndarray:
    """P(class | class before). Every class gets a little of its own, so that no transition is impossible."""
    size = len(table)
    if rest is not None:
        # Unknown words have no counts: their one share is spread as the tokens are.
        table = table.copy()
        table[:, rest] += EMIT * table.sum(axis=1) / max(1, table.sum())
    share = (table.sum(axis=0) + 1) / (table.sum() + size)
    rows = table.sum(axis=1, keepdims=True)
    return (1 - MIX) * np.divide(table, rows, out=np.tile(share, (size, 1)), where=rows > 0) + MIX * share


def contexts(rows: DataFrame, own: np.ndarray, fixed: int, to: int) -> DataFrame:
    """(word, around): how often each class stands before (0 ..) and after (size ..) the words numbered `fixed` up to `to`.

    `own` has the class of every number, then of words without one and of END.
    """
    held = rows.sparkSession.sparkContext.broadcast(own)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        classes = held.value
        end, size = len(classes) - 1, int(classes[-1]) + 1
        width = 2 * size
        for batch in batches:
            for before, at, after in stretches(batch.column(0), end):
                where = np.flatnonzero((at >= fixed) & (at < to))
                word = at[where].astype(np.int64) * width
                keys = np.concatenate([word + classes[before[where]], word + (size + classes[after[where]])])
                keys.sort()
                starts = runs(keys)
                n = np.diff(np.append(starts, len(keys)))
                keys = keys[starts]
                word = keys // width
                first = runs(word)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(word[first].astype(np.int32)),
                     pa.ListArray.from_arrays(pa.array(np.append(first, len(keys)).astype(np.int32)), pa.array((keys % width << SHIFT) + n))],
                    names=["word", "around"])

    return rows.select("numbers").mapInArrow(run, "word int, around array<long>")


def other_contexts(rows: DataFrame, own: np.ndarray) -> DataFrame:
    """(word, around): the classes before and after each occurrence of a word without a number, as before * size + after."""
    held = rows.sparkSession.sparkContext.broadcast(own)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        classes = held.value
        end, size = len(classes) - 1, int(classes[-1]) + 1
        for batch in batches:
            others, done = batch.column(1).flatten(), 0
            for before, at, after in stretches(batch.column(0), end):
                where = np.flatnonzero(at == end - 1)
                around = classes[before[where]].astype(np.int64) * size + classes[after[where]]
                yield pa.RecordBatch.from_arrays([others.slice(done, len(where)), pa.array(around)], names=["word", "around"])
                done += len(where)

    return rows.select("numbers", "others").mapInArrow(run, "word string, around long")


class Chooser:
    """The likeliest class of a word given the classes around it. Weights are whole numbers, so sums are exact and the first of equals wins."""

    def __init__(self, table: np.ndarray):
        size, moves = len(table), np.rint(np.log10(smoothed(table)) * FINE)
        self.size = size
        self.weights = np.concatenate([moves, moves.T])[:, : size - 2]
        self.mass = np.rint(np.log10(table.sum(axis=0)[: size - 2] + 1) * FINE)
        # Class of a word seen once, by the classes before and after it; rows are made when first asked for.
        self.single = np.full((size, size), -1, np.int32)

    def of_single(self, before: np.ndarray, after: np.ndarray) -> np.ndarray:
        for c in np.unique(before[self.single[before, 0] < 0]).tolist():
            self.single[c] = np.argmax(self.weights[self.size :] + (self.weights[c] - self.mass), axis=1)
        return self.single[before, after]

    def choose(self, starts: np.ndarray, keys: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Times and class of each word, whose entries begin at `starts` (one more at the end) and are sorted by key."""
        words = len(starts) - 1
        times = np.add.reduceat(np.where(keys < self.size, n, 0), starts[:-1])
        best = np.empty(words, np.int32)
        once = times == 1
        best[once] = self.of_single(keys[starts[:-1][once]], keys[starts[:-1][once] + 1] - self.size)
        lengths = np.diff(starts)
        # Long lists are multiplied as full rows, short ones entry by entry: the sums are the same.
        for full, more in ((True, np.flatnonzero(~once & (lengths >= FULL))), (False, np.flatnonzero(~once & (lengths < FULL)))):
            ends = np.cumsum(lengths[more])
            at = 0
            while at < len(more):
                before = ends[at] - lengths[more[at]]
                to = max(at + 1, int(np.searchsorted(ends, before + (16 if full else 1) * WEIGHED, side="right")))
                some = more[at:to]
                firsts = ends[at:to] - lengths[some] - before
                own = np.arange(ends[to - 1] - before) + np.repeat(starts[some] - firsts, lengths[some])
                if full:
                    rows = np.zeros((len(some), len(self.weights)))
                    rows[np.repeat(np.arange(len(some)), lengths[some]), keys[own]] = n[own]
                    sums = rows @ self.weights
                else:
                    sums = np.add.reduceat(self.weights[keys[own]] * n[own, None], firsts, axis=0)
                best[some] = np.argmax(sums - times[some, None] * self.mass, axis=1)
                at = to
        return times, best


def best_classes(around: DataFrame, table: np.ndarray) -> DataFrame:
    """(word, n, class) of all words of `contexts` or `other_contexts`, given the transition counts of the seeds' classes.

    A word's rows come one after the other, so a task holds the batch and the sums of its last word.
    """
    held = around.sparkSession.sparkContext.broadcast(table)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chooser = Chooser(held.value)
        size, width = chooser.size, 2 * chooser.size

        def choose(words: pa.Array, keys: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
            times, best = chooser.choose(np.searchsorted(keys, np.arange(len(words) + 1) * width), keys % width, n)
            return pa.RecordBatch.from_arrays([words, pa.array(times.astype(np.int64)), pa.array(best)], names=["word", "n", "class"])

        open_word, open_keys, open_n = None, np.zeros(0, np.int64), np.zeros(0, np.int64)
        for batch in batches:
            if not batch.num_rows:
                continue
            names, values = batch.column(0), batch.column(1)
            if open_word is not None:
                names = pa.concat_arrays([open_word, names])
            new = np.append(True, pc.not_equal(names.slice(1), names.slice(0, len(names) - 1)).to_numpy(zero_copy_only=False))
            words, group = names.filter(pa.array(new)), (np.cumsum(new) - 1)[-batch.num_rows :] * width
            if pa.types.is_list(values.type):
                packed = values.flatten().to_numpy()
                keys, n = np.repeat(group, np.diff(values.offsets.to_numpy())) + (packed >> SHIFT), packed & (1 << SHIFT) - 1
            else:
                before, after = np.divmod(values.to_numpy(), size)
                keys, n = np.concatenate([group + before, group + size + after]), np.ones(2 * len(before), np.int64)
            keys, n = np.concatenate([open_keys, keys]), np.concatenate([open_n, n])
            order = np.argsort(keys)
            keys = keys[order]
            starts = runs(keys)
            keys, n = keys[starts], np.add.reduceat(n[order], starts)
            last = int(np.searchsorted(keys, (len(words) - 1) * width))
            if len(words) > 1:
                yield choose(words.slice(0, len(words) - 1), keys[:last], n[:last])
            open_word, open_keys, open_n = words.slice(len(words) - 1), keys[last:] % width, n[last:]
        if open_word is not None:
            yield choose(open_word, open_keys, open_n)

    kind = around.schema["word"].dataType.simpleString()
    return around.repartition("word").sortWithinPartitions("word").mapInArrow(run, f"word {kind}, n long, class int")


def assign(own: np.ndarray, chosen: DataFrame) -> None:
    """Put the classes of the chosen numbers where their numbers say."""
    came = chosen.select("word", "class").toArrow()
    own[came.column("word").to_numpy()] = came.column("class").to_numpy()


def classify(docs: DataFrame, clustered: int | None = None, classes: int | None = None, held: int = HELD,
             learned: Column | None = None) -> Words:
    """A class for every word of the `learned` rows; to the driver come `held` and `SWEPT` words and pairs of the seeds at most."""
    learned = F.lit(True) if learned is None else learned
    vocabulary = materialize(word_counts(docs.filter(learned)), "vocabulary")
    tokens, distinct, end = vocabulary.agg(
        F.coalesce(F.sum("n"), F.lit(0)), F.count(F.lit(1)), F.coalesce(F.sum(F.when(F.col("word") == END, F.col("n"))), F.lit(0))).first()
    classes = classes or max(CLASSES, int(distinct**GROWTH))
    clustered = clustered or max(CLUSTERED, SEEDS_PER_CLASS * classes)
    commons, (held, swept) = commonest(vocabulary, held, SWEPT)
    names, counts = [*commons], np.array([*commons.values()], np.int64)
    rest, seeds = len(names), min(clustered, swept)
    rows = numbered(docs, names, learned)
    known = rows.filter("learned")
    pairs = pair_counts(known, seeds, rest).toArrow()
    a, b = np.divmod(pairs.column("pair").to_numpy(), seeds + 2)
    n = pairs.column("n").to_numpy()
    order = np.lexsort((b, a))
    a, b, n = a[order], b[order], n[order].astype(float)
    clusters = exchange(a, b, n, seeds, min(classes, max(1, seeds)), SWEEPS)
    size = int(clusters[-1]) + 1
    table = np.zeros((size, size))
    np.add.at(table, (clusters[a], clusters[b]), n)

    around = np.append(np.full(rest + 1, size - 2), size - 1)
    around[:seeds] = clusters[:-2]
    own = around.copy()
    assign(around, best_classes(contexts(known, around, seeds, swept), table))
    assign(own, best_classes(contexts(known, around, seeds, rest), table))
    rare = materialize(best_classes(other_contexts(known, around), table), "classes")
    emission = np.column_stack([np.bincount(own[:-2], counts, size), np.bincount(own[:-2], minlength=size).astype(float)])
    for r in rare.groupBy("class").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("words")).collect():
        emission[r["class"]] += r["n"], r["words"]
    return Words(rows, names, counts, own, rare, held, emission, tokens, distinct, end)


def held_classes(words: Words) -> np.ndarray:
    """The class of every number, -1 for those looked up by a join."""
    own = words.own.copy()
    own[words.held : -1] = -1
    return own


def place(words: Words) -> DataFrame:
    """place, learned, emits, n, class, before, after: all occurrences of words that are not held and their class moves.

    A row has up to two moves, as class * size + class; `size * size` stands for none. Moves between two such words have
    rows of their own.
    """
    sent = words.rows.sparkSession.sparkContext.broadcast((held_classes(words), pa.array(words.names[words.held :], pa.string())))
    held, end, size = words.held, len(words.own) - 1, int(words.own[-1]) + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        classes, names = sent.value
        for batch in batches:
            for part in bounded(batch, 2, STRETCH):
                lists, others = part.column(2), part.column(3).flatten()
                numbers, bounds = lists.flatten().to_numpy(), lists.offsets.to_numpy()
                starts = bounds[:-1] - bounds[0]
                c = np.concatenate([classes[-1:], classes[numbers], [-1]])
                where = np.flatnonzero((numbers >= held) & (numbers != end))
                row = np.searchsorted(starts, where, side="right") - 1
                # A word is named by its number or, if it has none, comes from the row.
                at = numbers[where]
                name = np.where(at < end - 1, at - held, len(names) + np.cumsum(at == end - 1) - 1)
                yield pa.RecordBatch.from_arrays(
                    [pa.concat_arrays([names, others]).take(pa.array(name)), part.column(0).take(pa.array(row)), part.column(1).take(pa.array(row)),
                     pa.array((where - starts[row]).astype(np.int32)), pa.array(c[where].astype(np.int32)), pa.array(c[where + 2].astype(np.int32))],
                    names=["word", "place", "learned", "nth", "left", "right"])

    single = words.rows.select("place", "learned", "numbers", "others").mapInArrow(
        run, "word string, place long, learned boolean, nth int, left int, right int")
    wide, none = F.lit(size), F.lit(size * size)
    found = single.join(words.joined(held), "word", "left").withColumn("class", F.coalesce("class", F.lit(size - 2)))
    tails = materialize(found.select(
        "place", "learned", "nth", F.lit(True).alias("emits"), F.coalesce("n", F.lit(0)).alias("n"), "class",
        F.when(F.col("left") >= 0, F.col("left") * wide + F.col("class")).otherwise(none).alias("before"),
        F.when(F.col("right") >= 0, F.col("class") * wide + F.col("right")).otherwise(none).alias("after")), "tails")
    # Two neighbours of this kind each know their own class: the first brings it to the place of the second.
    firsts = tails.filter(F.col("after") == none).select("place", "learned", F.col("nth") + 1, (F.col("class") * wide).alias("part"))
    seconds = tails.filter(F.col("before") == none).select("place", "learned", "nth", F.col("class").alias("part"))
    links = firsts.union(seconds).toDF("place", "learned", "nth", "part").groupBy("place", "learned", "nth").agg(
        F.sum("part").cast("int").alias("before"))
    return tails.drop("nth").unionByName(materialize(links.select(
        "place", "learned", F.lit(False).alias("emits"), F.lit(0).cast("long").alias("n"), F.lit(size - 2).alias("class"),
        "before", none.alias("after")), "links"))


def fit(words: Words, tails: DataFrame) -> ClassModel:
    """Transitions over all tokens of the rows to learn from, each with its own class."""
    sent = words.rows.sparkSession.sparkContext.broadcast(held_classes(words))
    end, size = len(words.own) - 1, int(words.own[-1]) + 1

    def made(counted: np.ndarray) -> pa.RecordBatch:
        at = np.flatnonzero(counted[: size * size])
        return pa.RecordBatch.from_arrays([pa.array(at), pa.array(counted[at])], names=["move", "n"])

    def of_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        classes, counted = sent.value, np.zeros(size * size, np.int64)
        for batch in batches:
            for before, at, _ in stretches(batch.column(0), end):
                first, second = classes[before], classes[at]
                inside = (first >= 0) & (second >= 0)
                counted += np.bincount(first[inside] * size + second[inside], minlength=size * size)
        yield made(counted)

    def of_tails(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counted = np.zeros(size * size + 1, np.int64)
        for batch in batches:
            for column in batch.columns:
                counted += np.bincount(column.to_numpy(), minlength=size * size + 1)
        yield made(counted)

    counts = words.rows.filter("learned").select("numbers").mapInArrow(of_rows, "move long, n long").unionByName(
        tails.filter("learned").select("before", "after").mapInArrow(of_tails, "move long, n long")).groupBy("move").agg(
        F.sum("n").alias("n")).toArrow()
    table = np.zeros(size * size)
    table[counts.column("move").to_numpy()] = counts.column("n").to_numpy()
    return ClassModel({w.encode(): i for i, w in enumerate(words.names)}, words.own,
                      np.log10(smoothed(table.reshape(size, size), size - 2)), words.emission, words.tokens, words.distinct)


def learn(docs: DataFrame, clustered: int | None = None, classes: int | None = None, held: int = HELD) -> Learned:
    """Classes and counts over all of `docs`. `clustered` seeds and `classes` classes; by default both follow the vocabulary."""
    words = classify(docs, clustered, classes, held)
    return Learned(words, fit(words, place(words)))


def score(tails: DataFrame, learned: Learned) -> DataFrame:
    """doc_id, n_tokens, n_known, train_tokens, base_score, score: log10 probabilities of whole texts."""
    words, model = learned
    held, end, size = words.held, len(words.own) - 1, int(words.own[-1]) + 1
    base_total = math.log10(words.tokens + 0.5 * (words.distinct + 1))
    # Of every number: whether it is counted, and its shares of both scores; nothing for words looked up by a join.
    known, base, emit = np.zeros(end + 1, np.int64), np.zeros(end + 1), np.zeros(end + 1)
    known[:held], known[end] = 1, words.end > 0
    base[:held], base[end] = np.log10(words.counts[:held] + 0.5), math.log10(words.end + 0.5)
    emit[:held] = np.log10(words.counts[:held] + EMIT) - words.divisor()[words.own[:held]]
    sent = words.rows.sparkSession.sparkContext.broadcast(
        (np.append(model.transition.ravel(), 0), words.divisor(), held_classes(words), known, base, emit))

    def of_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        transition, _, classes, known, base, emit = sent.value
        for batch in batches:
            for part in bounded(batch, 2, STRETCH):
                lists = part.column(2)
                numbers, bounds = lists.flatten().to_numpy(), lists.offsets.to_numpy()
                starts, lengths = bounds[:-1] - bounds[0], np.diff(bounds)
                c = classes[np.append(end, numbers)]
                first, second = c[:-1], c[1:]
                moves = transition[np.where((first >= 0) & (second >= 0), first * size + second, size * size)]

                def sums(values: np.ndarray, starts: np.ndarray = starts) -> np.ndarray:
                    return np.add.reduceat(values, starts)

                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), pa.array(lengths.astype(np.int64)), pa.array(sums(known[numbers])),
                     pa.array(sums(base[numbers]) - lengths * base_total), pa.array(sums(emit[numbers] + moves))],
                    names=["place", "doc_id", "n_tokens", "n_held", "base", "model"])

    def of_tails(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        transition, divisor = sent.value[:2]
        for batch in batches:
            n, own, before, after = (batch.column(c).to_numpy() for c in ("n", "class", "before", "after"))
            emits = batch.column("emits").to_numpy(zero_copy_only=False)
            total = transition[before] + transition[after] + emits * (np.log10(n + EMIT) - divisor[own])
            # Summed by row before the shuffle, as far as a batch has several occurrences of one.
            places, back = np.unique(batch.column("place").to_numpy(), return_inverse=True)
            yield pa.RecordBatch.from_arrays(
                [pa.array(places), pa.array(np.bincount(back, emits & (n > 0)).astype(np.int64)),
                 pa.array(np.bincount(back, emits * np.log10(n + 0.5))), pa.array(np.bincount(back, total))],
                names=["place", "known_tail", "base_tail", "model_tail"])

    kind = words.rows.schema["doc_id"].dataType.simpleString()
    rows = words.rows.select("place", "doc_id", "numbers").mapInArrow(
        of_rows, f"place long, doc_id {kind}, n_tokens long, n_held long, base double, model double")
    tails = tails.select("place", "emits", "n", "class", "before", "after").mapInArrow(
        of_tails, "place long, known_tail long, base_tail double, model_tail double").groupBy("place").agg(
        *(F.sum(c).alias(c) for c in ("known_tail", "base_tail", "model_tail")))
    none = F.lit(0)
    return rows.join(tails, "place", "left").select(
        "doc_id", "n_tokens", (F.col("n_held") + F.coalesce("known_tail", none)).alias("n_known"),
        F.lit(model.tokens).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("base_tail", none)).alias("base_score"),
        (F.col("model") + F.coalesce("model_tail", none)).alias("score"))


def held_out(doc_id: Column) -> Column:
    return F.coalesce(fold_of(doc_id, 5) == 1, F.lit(False))


def score_corpus(docs: DataFrame, clustered: int | None = None, classes: int | None = None, held: int = HELD) -> DataFrame:
    """Learn from four of five folds of the ids (a null id is learned from) and score all rows."""
    words = classify(docs.select("doc_id", "text"), clustered, classes, held, ~held_out(F.col("doc_id")))
    tails = place(words)
    scored = score(tails, Learned(words, fit(words, tails)))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "n_tokens", "n_known", "train_tokens",
                         "base_score", "score")
