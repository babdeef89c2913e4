"""SimHash near-dedup by a binary-trie self-join.

Fingerprints, not documents, are joined: equal ones meet in one row first. Bits are read in several orders; in each
order two of six blocks of the 64 bits come first and must agree. Two fingerprints within `BUDGET` = 4 bits agree on
at least two blocks, so no link is lost, and the agreeing prefix is the trie node under which a task works on.
From there node pairs are traversed together: differing bits add up, a pair over the budget is pruned with all that
hangs below. A node with too many fingerprints is first opened on the cluster by the same rule, bits of the next
levels choosing the child pairs that stay within the budget. Each task gives one edge per fingerprint, to the
smallest linked one it met, instead of all pairs; connected components are the same.

Null and empty texts and texts without words have fingerprint zero and are linked like any other. Rows with a null
doc_id take part; a component's id is the smallest id that is not null, or null.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cardflow.llm.common import extend, fresh
from cardflow.llm.components import connected_components
from cardflow.sources.store import materialize

SHINGLE = 4
SEED = 42
BUDGET = 4
BLOCKS = BUDGET + 2
# Fingerprints under one node that a task takes without opening the node on the cluster.
NODE_ROWS = 1 << 16
# Node pairs at or below this product of sizes are compared outright.
LEAF = 64
# Node pairs expanded at once.
FRONTIER = 1 << 16
CUTS = [64 * i // BLOCKS for i in range(BLOCKS + 1)]
MASKS = [((1 << CUTS[i + 1]) - 1) ^ ((1 << CUTS[i]) - 1) for i in range(BLOCKS)]
ORDERS = list(combinations(range(BLOCKS), 2))
# Per order, the bits that come after the agreeing blocks, most significant first.
REST = [[bit for i in reversed(range(BLOCKS)) if i not in order for bit in reversed(range(CUTS[i], CUTS[i + 1]))]
        for order in ORDERS]


def fingerprint(text: str | None) -> int:
    """Unsigned; bit set where over half of the shingle hashes have it."""
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= SHINGLE:
        return xxhash.xxh64_intdigest(joined, SEED)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    count = len(words) - SHINGLE + 1
    hash_ = xxhash.xxh64_intdigest
    votes, view = np.zeros(64, np.int64), memoryview(joined)
    for low in range(0, count, 1 << 14):
        high = min(low + (1 << 14), count)
        spans = zip(starts[low:high].tolist(), ends[low + SHINGLE - 1 : high + SHINGLE - 1].tolist(), strict=True)
        hashes = np.array([hash_(view[a:b], SEED) for a, b in spans], np.uint64)
        votes += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(votes * 2 > count, bitorder="little").tobytes(), "little")


def with_fingerprint(docs: DataFrame, name: str = "fingerprint") -> DataFrame:
    """All columns and the fingerprint as a signed long of the same bits."""
    def compute(texts: pa.Array) -> list[pa.Array]:
        values = np.array([fingerprint(t) for t in texts.to_pylist()], np.uint64)
        return [pa.array(values.view(np.int64))]

    return extend(docs, [T.StructField(name, T.LongType())], compute)


def signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def _agreeing(fp: Column) -> Column:
    """(order, prefix) for every bit order."""
    return F.array(*[
        F.struct(F.lit(i).cast("int").alias("order"),
                 fp.bitwiseAND(F.lit(signed(MASKS[a] | MASKS[b]))).alias("prefix"))
        for i, (a, b) in enumerate(ORDERS)])


def trie_nodes(fingerprints: DataFrame, node_rows: int = NODE_ROWS) -> DataFrame:
    """(order, prefix, p, q, fp): under which node pair of which trie each fingerprint is traversed.

    p = q = 0 where the whole node is taken. A larger node is opened `depth` levels at once: a fingerprint goes
    to every pair of children within the budget that has its own child in it.
    """
    rows = fingerprints.select("fp", F.explode(_agreeing(F.col("fp"))).alias("at")).select("at.order", "at.prefix", "fp")
    count = rows.groupBy("order", "prefix").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    sized = rows.join(count, ["order", "prefix"])
    depth = F.least(F.ceil(F.log2(F.col("n") / F.lit(float(node_rows)))), F.lit(10)).cast("int")
    small = sized.filter(F.col("n") <= node_rows).select(
        "order", "prefix", F.lit(0).alias("p"), F.lit(0).alias("q"), "fp")
    # The child: the next bits of the order, read as a number.
    bits = F.lit(None).cast("array<int>")
    for i, rest in enumerate(REST):
        bits = F.when(F.col("order") == i, F.array(*[F.lit(b) for b in rest])).otherwise(bits)
    child = F.aggregate(
        F.slice(F.col("bits"), 1, F.col("depth")), F.lit(0),
        lambda n, b: n * 2 + F.call_function("shiftright", F.col("fp"), b).bitwiseAND(F.lit(1).cast("long")).cast("int"))
    others = F.filter(
        F.transform(F.sequence(F.lit(0), F.call_function("shiftleft", F.lit(1), F.col("depth")) - 1),
                    lambda c: c.bitwiseXOR(F.col("own"))),
        lambda c: F.bit_count(c.bitwiseXOR(F.col("own"))) <= BUDGET)
    large = (
        sized.filter(F.col("n") > node_rows).withColumn("depth", depth).withColumn("bits", bits)
        .withColumn("own", child).withColumn("other", F.explode(others))
        .select("order", "prefix", (F.least("own", "other") + 1).alias("p"), (F.greatest("own", "other") + 1).alias("q"), "fp"))
    return small.unionAll(large)


def permuted(fps: np.ndarray, order: int) -> np.ndarray:
    """The bits after the agreeing blocks, in reading order from the top; block by block."""
    out, used = np.zeros(len(fps), np.uint64), 0
    for i in reversed(range(BLOCKS)):
        if i not in ORDERS[order]:
            width = CUTS[i + 1] - CUTS[i]
            used += width
            out |= (fps >> np.uint64(CUTS[i]) & np.uint64((1 << width) - 1)) << np.uint64(64 - used)
    return out


def linked_pairs(bits: np.ndarray, roots: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Positions (i < j) of fingerprints within the budget under the same root.

    `bits` is sorted inside each root; `roots` holds the bounds. A node is a range of positions at a level.
    """
    low, high = roots[:-1], roots[1:]
    big = high - low > 1
    stack = [(0, low[big], high[big], low[big], high[big], np.zeros(int(big.sum()), np.int64))]
    while stack:
        level, a, b, c, d, errors = stack.pop()
        if len(a) > FRONTIER:
            stack += [(level, *(x[i : i + FRONTIER] for x in (a, b, c, d, errors))) for i in range(0, len(a), FRONTIER)]
            continue
        small = ((b - a) * (d - c) <= LEAF) | (level >= 64)
        if small.any():
            yield from compared(bits, *(x[small] for x in (a, b, c, d)))
        a, b, c, d, errors = (x[~small] for x in (a, b, c, d, errors))
        if not len(a):
            continue
        m, n = split(bits, a, b, level), split(bits, c, d, level)
        same = (a == c) & (b == d)
        one = np.ones(len(a), np.int64)
        pairs = [
            (a, m, c, n, errors), (m, b, n, d, errors), (a, m, n, d, errors + one),
            # Under a pair of one node with itself, (left, right) is (right, left).
            tuple(x[~same] for x in (m, b, c, n, errors + one))]
        a, b, c, d, errors = (np.concatenate(x) for x in zip(*pairs, strict=True))
        keep = (b > a) & (d > c) & (errors <= BUDGET) & ~((a == c) & (b == d) & (b - a < 2))
        stack.append((level + 1, *(x[keep] for x in (a, b, c, d, errors))))


def split(bits: np.ndarray, low: np.ndarray, high: np.ndarray, level: int) -> np.ndarray:
    """Where bit `level` from the top turns to one inside each range, by bisection of all ranges at once."""
    low, high = low.copy(), high.copy()
    shift = np.uint64(63 - level)
    while True:
        open_ = np.flatnonzero(low < high)
        if not len(open_):
            return low
        middle = (low[open_] + high[open_]) >> 1
        one = (bits[middle] >> shift & np.uint64(1)).astype(bool)
        high[open_[one]] = middle[one]
        low[open_[~one]] = middle[~one] + 1


def compared(bits, a, b, c, d) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Every pair of the node pairs, in bounded portions."""
    sizes = (b - a) * (d - c)
    ends = np.cumsum(sizes)
    start = 0
    while start < len(a):
        before = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, before + (1 << 20), side="right")))
        own = np.repeat(np.arange(start, stop), sizes[start:stop])
        within = np.arange(len(own)) - (ends[own] - sizes[own] - before)
        i = a[own] + within // (d - c)[own]
        j = c[own] + within % (d - c)[own]
        ok = (np.bitwise_count(bits[i] ^ bits[j]) <= BUDGET) & (i != j)
        yield np.minimum(i, j)[ok], np.maximum(i, j)[ok]
        start = stop


def forest(n: int, pairs: Iterator[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """Smallest position reachable from each position over the pairs, which are folded in portion by portion."""
    root = np.arange(n)
    for i, j in pairs:
        while len(i):
            i, j = root[i], root[j]
            differ = i != j
            i, j = np.minimum(i[differ], j[differ]), np.maximum(i[differ], j[differ])
            np.minimum.at(root, j, i)
            while True:
                shorter = root[root]
                if (shorter == root).all():
                    break
                root = shorter
    return root


def links_below(nodes: DataFrame) -> DataFrame:
    """Edges (a, b) of a spanning forest of the links under each node pair."""
    keys = ["order", "prefix", "p", "q"]

    def solve(columns: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        order, prefix, p, q, fp = columns
        if not len(fp):
            return
        unsigned = fp.view(np.uint64)
        for number in np.unique(order):
            own = np.flatnonzero(order == number)
            bits = permuted(unsigned[own], int(number))
            sort = np.lexsort((bits, q[own], p[own], prefix[own]))
            own, bits = own[sort], bits[sort]
            change = np.zeros(len(own), bool)
            for column in (prefix, p, q):
                change[1:] |= column[own][1:] != column[own][:-1]
            roots = np.concatenate([[0], np.flatnonzero(change), [len(own)]])
            root = forest(len(own), linked_pairs(bits, roots))
            at = np.flatnonzero(root != np.arange(len(own)))
            yield pa.RecordBatch.from_arrays([pa.array(fp[own[at]]), pa.array(fp[own[root[at]]])], names=["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] | None = None
        for batch in batches:
            columns = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
            if held is not None:
                columns = [np.concatenate(x) for x in zip(held, columns, strict=True)]
            # The last node pair may go on in the next batch.
            tail = np.ones(len(columns[0]), bool)
            for column in columns[:4]:
                tail &= column == column[-1:]
            cut = int(np.flatnonzero(~tail)[-1]) + 1 if (~tail).any() else 0
            yield from solve([c[:cut] for c in columns])
            held = [c[cut:] for c in columns]
        if held is not None:
            yield from solve(held)

    return nodes.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(run, "a long, b long")


def components_of(fingerprinted: DataFrame, node_rows: int = NODE_ROWS) -> DataFrame:
    """(doc_id, fp) to (fp, root, component_id): smallest doc_id of all linked fingerprints."""
    distinct = materialize(fingerprinted.groupBy("fp").agg(F.min("doc_id").alias("least")), "fingerprints")
    edges = links_below(trie_nodes(distinct, node_rows))
    roots = materialize(connected_components(edges), "roots").select(F.col("node").alias("fp"), "root")
    owner = distinct.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    best = owner.groupBy("root").agg(F.min("least").alias("component_id"))
    return owner.join(best, "root").select("fp", "root", "component_id")


def near_duplicates(docs: DataFrame, node_rows: int = NODE_ROWS) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id; one row per row of `docs`."""
    marked = materialize(with_fingerprint(docs.select("doc_id", "text"), "fp").drop("text"), "marked")
    found = marked.join(components_of(marked, node_rows), "fp")
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, node_rows: int = NODE_ROWS) -> DataFrame:
    """The rows of `docs` but for all but one row (smallest doc_id, nulls last) of each component."""
    row, fp = fresh(docs, "row"), fresh(docs, "fp")
    marked = materialize(with_fingerprint(docs, fp).withColumn(row, F.monotonically_increasing_id()), "marked-docs")
    slim = marked.select("doc_id", F.col(fp).alias("fp"), F.col(row).alias("row"))
    roots = components_of(slim, node_rows).select("fp", "root")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row")).alias("first")
    # Smallest row of each fingerprint before the join, then of each component.
    kept = slim.groupBy("fp").agg(first).join(roots, "fp").groupBy("root").agg(F.min("first").alias("first"))
    # The dropped rows are far fewer than the kept ones: while they are small, no text is shuffled.
    dropped = slim.select("row").join(kept.select("first.row"), "row", "left_anti")
    dropped = materialize(dropped.withColumnRenamed("row", row), "dropped-rows")
    return marked.join(dropped, row, "left_anti").drop(row, fp)
