"""Prefix trie of conversations from vertical bitmaps.

A node is a distinct sequence of first turns (role, text). Turns are known by 128-bit digests; a node by two 64-bit lanes, each the
exclusive or of one hash per (depth, turn) on its path, so that a path's name can be put together from parts of it.

Conversations are sorted by id and cut into shards: `BLOCK` conversations in the order of their ids, `BAND` depths. A shard holds, for every
(depth, turn), the bitset of its conversations that have this turn there. From the bitsets of whole paths at the shard's top a depth-first walk
intersects a node's bitset with the postings of the next depth: each intersection is a child, its popcount the child's conversations, its
lowest bit their smallest id; conversations that end in a node make its end list. A shard's size does not depend on how many
conversations begin alike, nor on how long one is. Nodes of several shards are merged by name.

The nodes whose smallest member is c form a chain, the lower part of c's own path; every chain but one hangs from a node of
another. Sums over subtrees are sums over chains of chains: pointer jumping adds up whole chains in as many rounds as the logarithm
of the deepest nesting, and running sums along a chain, `BAND` nodes at a time, give those of single nodes.

Null roles and texts are empty, null turns come first, turns of equal number go by a digest of role and text, and repeated rows are turns of
their own. Rows without a conv_id belong to no conversation and are left out. Texts are read once, however long, and never leave
the task that reads them. An empty table has no nodes, not even the root. Other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cardflow.operators import skew
from cardflow.sources.store import materialize

BLOCK = 512
BAND = 256
# Fixed by the rule of `rebuilt`: conversations share the opening of the one whose number is the last hundred.
FAMILY = 100
MOST_SHARED = 6
SHARED, OWN, END = 0, 1, 2


def digests(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, key (128-bit digest of role and text), chars and row of every turn, written once."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    named = F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text)
    return materialize(conversations.filter(F.col("conv_id").isNotNull()).select(
        "conv_id", "turn", F.unhex(F.md5(named)).alias("key"), F.length(text).cast("long").alias("chars"),
        F.monotonically_increasing_id().alias("row")), "turns")


def own_turns(turns: DataFrame) -> DataFrame:
    """All turns in their places, and one END row per conversation."""
    ends = turns.groupBy("conv_id").agg(F.max("turn").alias("turn")).select(
        "conv_id", F.lit(END).alias("kind"), F.lit(None).cast("int").alias("place"), "turn", F.lit(None).cast("binary").alias("key"),
        F.lit(0).cast("long").alias("chars"), F.lit(None).cast("long").alias("row"))
    return turns.select("conv_id", F.lit(OWN).alias("kind"), F.lit(None).cast("int").alias("place"), "turn", "key", "chars", "row").unionByName(ends)


def shared_count(conv_id: Column) -> Column:
    """How many turns a conversation takes over, and drops of its own."""
    return F.crc32(conv_id.cast("string").cast("binary")) % MOST_SHARED


def rebuilt(turns: DataFrame) -> DataFrame:
    """`own_turns` with the first turns of conversation c - c % FAMILY before them; its own first ones are dropped by `skip` later.

    Only the first turns of family heads are ever ranked, so a long conversation is cut down before it is shuffled, and at
    most FAMILY conversations read one head.
    """
    first = W.partitionBy("conv_id").orderBy(F.asc_nulls_first("turn"), "key", "row")
    heads = (
        turns.filter(F.col("conv_id") % FAMILY == 0).withColumn("place", F.row_number().over(first))
        .filter(F.col("place") < MOST_SHARED).groupBy(F.col("conv_id").alias("head"))
        .agg(F.array_sort(F.collect_list(F.struct("place", "key", "chars"))).alias("opening")))
    ids = turns.select("conv_id").distinct().withColumn("head", F.col("conv_id") - F.col("conv_id") % FAMILY)
    opening = ids.join(heads, "head").select(
        "conv_id", F.explode(F.slice("opening", F.lit(1), shared_count(F.col("conv_id")).cast("int"))).alias("each"))
    shared = opening.select(
        "conv_id", F.lit(SHARED).alias("kind"), F.col("each.place").alias("place"),
        F.lit(None).cast(turns.schema["turn"].dataType).alias("turn"), F.col("each.key").alias("key"),
        F.col("each.chars").alias("chars"), F.lit(None).cast("long").alias("row"))
    return own_turns(turns).unionByName(shared)


def counted(rows: DataFrame) -> DataFrame:
    """Rows in the order of their conversations, with the number of shared and own turns so far and the conversation's number within a task.

    A conversation may begin in one task and go on in the next ones; counts are those of the task (`part`).
    """
    order = [F.asc("conv_id"), F.asc("kind"), F.asc("place"), F.asc_nulls_first("turn"), F.asc("key"), F.asc("row")]
    kind = rows.schema["conv_id"].dataType
    schema = T.StructType([
        T.StructField("part", T.IntegerType()), T.StructField("conv_id", kind), T.StructField("kind", T.IntegerType()),
        T.StructField("key", T.BinaryType()), T.StructField("chars", T.LongType()), T.StructField("shared", T.LongType()),
        T.StructField("own", T.LongType()), T.StructField("number", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        last, number, before = None, -1, {SHARED: 0, OWN: 0}
        for batch in batches:
            if not batch.num_rows:
                continue
            ids, kinds = batch.column(0), batch.column(1).to_numpy()
            fresh = np.ones(len(ids), bool)
            fresh[1:] = pc.not_equal(ids.slice(1), ids.slice(0, len(ids) - 1)).to_numpy(zero_copy_only=False)
            fresh[0] = last is None or ids[0].as_py() != last
            numbers = number + np.cumsum(fresh)
            starts = np.flatnonzero(fresh)
            running = {}
            for which in (SHARED, OWN):
                mine = np.cumsum(kinds == which)
                # What was counted before each conversation began; the one that goes on from the last batch adds to its count.
                offset = np.zeros(len(ids), np.int64)
                offset[starts] = mine[starts] - (kinds[starts] == which)
                offset = np.maximum.accumulate(offset)
                running[which] = mine - offset + np.where(numbers == number, before[which], 0)
                before[which] = int(running[which][-1])
            last, number = ids[-1].as_py(), int(numbers[-1])
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(ids), part, np.int32)), ids, batch.column(1), batch.column(2), batch.column(3),
                 pa.array(running[SHARED]), pa.array(running[OWN]), pa.array(numbers)], names=schema.fieldNames())

    ordered = rows.repartitionByRange(*order).sortWithinPartitions(*order).select("conv_id", "kind", "key", "chars")
    return materialize(ordered.mapInArrow(run, schema), "counted-turns")


def at_depths(rows: DataFrame, skip: Column) -> DataFrame:
    """block, conv_id, kind, key, chars and depth of all turns but the first `skip` own ones; END rows have their conversation's depth."""
    counts = counted(rows)
    # Only the first conversation of a task can have begun in an earlier one: at most one row per task.
    goes_on = counts.filter("number = 0").select("conv_id").distinct()
    pieces = counts.join(F.broadcast(goes_on), "conv_id").groupBy("conv_id", "part").agg(
        F.max("shared").alias("_s"), F.max("own").alias("_o"), F.min("number").alias("_n"))
    earlier = W.partitionBy("conv_id").orderBy("part")
    before = earlier.rowsBetween(W.unboundedPreceding, -1)
    carried = pieces.select(
        "conv_id", "part", F.sum("_s").over(before).alias("_s"), F.sum("_o").over(before).alias("_o"),
        F.first("part").over(earlier).alias("_p"), F.first("_n").over(earlier).alias("_n")).filter("part > _p")
    shared, own = (F.col(c) + F.coalesce(o, F.lit(0)) for c, o in (("shared", "_s"), ("own", "_o")))
    part, number = F.coalesce("_p", "part").cast("long"), F.coalesce("_n", "number")
    placed = counts.join(F.broadcast(carried), ["conv_id", "part"], "left").select(
        (F.shiftleft(part, 32) + F.floor(number / BLOCK)).alias("block"), "conv_id", "kind", "key", "chars",
        shared.alias("_shared"), (own - skip).alias("_own"))
    return placed.filter((F.col("kind") != OWN) | (F.col("_own") > 0)).select(
        "block", "conv_id", "kind", "key", "chars", (F.col("_shared") + F.greatest("_own", F.lit(0))).alias("depth"))


def packed(turns: DataFrame) -> DataFrame:
    """One row per conversation and band of depths: its turns there, where it ends, and the name of the path above."""
    lanes = [F.xxhash64("depth", "key"), F.xxhash64(F.lit(7), "depth", "key")]
    is_turn = F.col("kind") != END
    rows = turns.withColumn("band", F.floor(F.greatest(F.col("depth") - 1, F.lit(0)) / BAND)).select(
        "block", "conv_id", "band", F.when(is_turn, F.struct("depth", *(h.alias(n) for h, n in zip(lanes, "xy")), "chars")).alias("turn"),
        F.when(~is_turn, F.col("depth")).alias("end"))
    bands = materialize(rows.groupBy("block", "conv_id", "band").agg(
        F.array_sort(F.collect_list("turn")).alias("turns"), F.max("end").alias("end"),
        F.coalesce(F.bit_xor("turn.x"), F.lit(0)).alias("x"), F.coalesce(F.bit_xor("turn.y"), F.lit(0)).alias("y")), "bands")
    above = W.partitionBy("conv_id").orderBy("band").rowsBetween(W.unboundedPreceding, -1)
    tops = bands.select("conv_id", "band", F.bit_xor("x").over(above).alias("top_x"), F.bit_xor("y").over(above).alias("top_y")).filter("band > 0")
    return bands.drop("x", "y").join(tops, ["conv_id", "band"], "left").fillna(0, ["top_x", "top_y"])


NODE = pa.schema([(n, pa.int64()) for n in ("up_x", "up_y", "x", "y", "depth", "n")])


def members(bits: int) -> Iterator[int]:
    while bits:
        low = bits & -bits
        yield low.bit_length() - 1
        bits ^= low


def walk(table: pa.Table) -> pa.Table:
    """The nodes of one shard: name of the parent and their own, depth, popcount, smallest member, characters, ends and block."""
    table = table.sort_by("conv_id")
    ids, ends = table.column("conv_id").to_pylist(), table.column("end").to_pylist()
    band = table.column("band")[0].as_py()
    top = band * BAND
    turns = [[(t["x"], t["y"], t["chars"]) for t in own] for own in table.column("turns").to_pylist()]
    postings: dict[tuple[int, int, int], int] = {}
    longer, ending = [0] * (BAND + 1), [0] * (BAND + 1)
    roots: dict[tuple[int, int], int] = {}
    for i, own in enumerate(turns):
        bit = 1 << i
        for level, turn in enumerate(own):
            postings[turn] = postings.get(turn, 0) | bit
            longer[level] |= bit
        if ends[i] is not None:
            ending[ends[i] - top] |= bit
    for i, name in enumerate(zip(table.column("top_x").to_pylist(), table.column("top_y").to_pylist(), strict=True)):
        roots[name] = roots.get(name, 0) | 1 << i
    out: list[tuple] = []

    def note(up: tuple[int | None, int | None], name: tuple[int, int], level: int, bits: int, chars: int) -> None:
        here = bits & ending[level]
        first = ids[(bits & -bits).bit_length() - 1]
        out.append((*up, *name, top + level, bits.bit_count(), first, chars, ",".join(str(ids[i]) for i in members(here)) if here else None))

    stack = [(name, 0, bits) for name, bits in roots.items()]
    if band == 0:
        for name, bits in roots.items():
            note((None, None), name, 0, bits, 0)
    while stack:
        name, level, bits = stack.pop()
        rest = bits & longer[level]
        while rest:
            turn = turns[(rest & -rest).bit_length() - 1][level]
            child = rest & postings[turn]
            rest ^= child
            own = name[0] ^ turn[0], name[1] ^ turn[1]
            note(name, own, level + 1, child, turn[2])
            stack.append((own, level + 1, child))
    columns = list(zip(*out, strict=True)) if out else [[]] * 9
    block = table.column("block")[0].as_py()
    names = [*NODE.names, "conv_id", "chars", "ends", "block"]
    types = [*NODE.types, table.schema.field("conv_id").type, pa.int64(), pa.string(), pa.int64()]
    return pa.table([*(pa.array(c, t) for c, t in zip(columns, types[:-1], strict=True)), pa.array([block] * len(out), pa.int64())], names=names)


def end_digests(shards: DataFrame) -> DataFrame:
    """(x, y, ends_sha256) of nodes in which conversations end: their end lists one after another, in the order of the blocks.

    A digest is read off in order, so one task sees all lists of a node; it holds one list at a time.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, digest = None, None
        for batch in batches:
            out = []
            for x, y, ends in zip(*(batch.column(c).to_pylist() for c in ("x", "y", "ends")), strict=True):
                if (x, y) == name:
                    digest.update(b"," + ends.encode())
                    continue
                if name:
                    out.append((*name, digest.hexdigest()))
                name, digest = (x, y), hashlib.sha256(ends.encode())
            if out:
                yield made(out)
        if name:
            yield made([(*name, digest.hexdigest())])

    def made(rows: list[tuple]) -> pa.RecordBatch:
        x, y, digest = zip(*rows, strict=True)
        return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()), pa.array(y, pa.int64()), pa.array(digest)], names=["x", "y", "ends_sha256"])

    ends = shards.filter(F.col("ends").isNotNull()).select("x", "y", "block", "ends")
    return ends.repartition("x", "y").sortWithinPartitions("x", "y", "block").select("x", "y", "ends").mapInArrow(
        run, "x long, y long, ends_sha256 string")


def with_families(nodes: DataFrame, heavy_rows: int) -> DataFrame:
    """Adds n_children and parent_conv_id. A node with very many children is salted."""
    children = nodes.groupBy(F.col("up_x").alias("x"), F.col("up_y").alias("y")).agg(F.count(F.lit(1)).alias("n_children"))
    counted_nodes = materialize(nodes.join(children, ["x", "y"], "left").fillna(0, ["n_children"]), "trie-nodes")
    parents = counted_nodes.filter("n_children > 0").select(
        F.col("x").alias("up_x"), F.col("y").alias("up_y"), F.col("conv_id").alias("parent_conv_id"), F.col("n_children").alias("_siblings"))
    joined = skew.spread_join(counted_nodes, parents, ["up_x", "up_y"], "_siblings", ["x"], heavy_rows, weights=parents)
    return materialize(joined.drop("_siblings", "up_x", "up_y"), "trie-families")


def chain_totals(chains: DataFrame, heavy_rows: int) -> DataFrame:
    """(conv_id, leaves, saved) over each chain and all that hang from it, at any remove, by pointer jumping."""
    state = chains.select("conv_id", F.col("up").alias("over"), "leaves", "saved")
    while not state.filter(F.col("over").isNotNull()).isEmpty():
        below = state.filter(F.col("over").isNotNull()).groupBy(F.col("over").alias("conv_id")).agg(
            F.sum("leaves").alias("_leaves"), F.sum("saved").alias("_saved"), F.count(F.lit(1)).alias("_below"))
        none = F.lit(0)
        added = materialize(state.join(below, "conv_id", "left").select(
            "conv_id", "over", (F.col("leaves") + F.coalesce("_leaves", none)).alias("leaves"),
            (F.col("saved") + F.coalesce("_saved", none)).alias("saved"), "_below"), "chain-sums")
        jump = added.filter(F.col("_below").isNotNull()).select(F.col("conv_id").alias("over"), F.col("over").alias("_over"), "_below")
        jumped = skew.spread_join(added.drop("_below"), jump, ["over"], "_below", ["conv_id"], heavy_rows, weights=jump)
        state = materialize(jumped.select("conv_id", F.col("_over").alias("over"), "leaves", "saved"), "chain-jumps")
    return state.drop("over")


def with_subtrees(nodes: DataFrame, heavy_rows: int) -> DataFrame:
    """Adds n_leaves and saved_tokens of each node's subtree, itself included."""
    weighed = nodes.withColumns({
        "leaves": (F.col("n_children") == 0).cast("long"), "saved": (F.col("n") - 1) * F.col("chars")})
    other = F.col("parent_conv_id").isNotNull() & (F.col("parent_conv_id") != F.col("conv_id"))
    chains = materialize(weighed.groupBy("conv_id").agg(
        F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved"), F.max(F.when(other, F.col("parent_conv_id"))).alias("up"),
        F.max(F.when(other, F.col("depth") - 1)).alias("depth")), "chains")
    hung = chains.filter(F.col("up").isNotNull()).select("conv_id", "up", "depth").join(
        chain_totals(chains, heavy_rows), "conv_id").groupBy(F.col("up").alias("conv_id"), "depth").agg(
        F.sum("leaves").alias("_leaves"), F.sum("saved").alias("_saved"))
    none = F.lit(0)
    own = materialize(weighed.join(hung, ["conv_id", "depth"], "left").withColumns({
        "leaves": F.col("leaves") + F.coalesce("_leaves", none), "saved": F.col("saved") + F.coalesce("_saved", none),
        "band": F.floor(F.col("depth") / BAND)}).drop("_leaves", "_saved"), "trie-weights")
    deeper = W.partitionBy("conv_id").orderBy(F.desc("band")).rowsBetween(W.unboundedPreceding, -1)
    bands = own.groupBy("conv_id", "band").agg(F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved")).select(
        "conv_id", "band", F.sum("leaves").over(deeper).alias("_leaves"), F.sum("saved").over(deeper).alias("_saved")).filter(
        F.col("_leaves").isNotNull())
    inside = W.partitionBy("conv_id", "band").orderBy(F.desc("depth")).rowsBetween(W.unboundedPreceding, W.currentRow)
    return own.join(bands, ["conv_id", "band"], "left").withColumns({
        "n_leaves": F.sum("leaves").over(inside) + F.coalesce("_leaves", none),
        "saved_tokens": F.sum("saved").over(inside) + F.coalesce("_saved", none)})


def trie(rows: DataFrame, skip: Column | None = None, heavy_rows: int = skew.HEAVY_ROWS) -> DataFrame:
    """The nodes of all conversations in `rows` (`own_turns` or `rebuilt`), without their first `skip` own turns.

    conv_id (smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens and ends_sha256 of every node.
    """
    shape = T.StructType([
        *(T.StructField(n, T.LongType()) for n in NODE.names), T.StructField("conv_id", rows.schema["conv_id"].dataType),
        T.StructField("chars", T.LongType()), T.StructField("ends", T.StringType()), T.StructField("block", T.LongType())])
    turns = at_depths(rows, F.lit(0) if skip is None else skip)
    shards = materialize(packed(turns).groupBy("block", "band").applyInArrow(walk, shape), "trie-shards")
    nodes = shards.groupBy("x", "y").agg(
        *(F.min(c).alias(c) for c in ("up_x", "up_y", "depth", "conv_id", "chars")), F.sum("n").alias("n"))
    full = with_subtrees(with_families(nodes, heavy_rows), heavy_rows).join(end_digests(shards), ["x", "y"], "left")
    return full.select(
        "conv_id", F.col("depth").cast("long").alias("depth"), "parent_conv_id", F.col("n").alias("n_convs"),
        F.col("n_children").cast("long").alias("n_children"), "n_leaves", "saved_tokens",
        F.coalesce("ends_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256"))


def conversation_trie(conversations: DataFrame, heavy_rows: int = skew.HEAVY_ROWS) -> DataFrame:
    """The trie of the given conversations as they are."""
    return trie(own_turns(digests(conversations)), None, heavy_rows)


def rebuilt_trie(conversations: DataFrame, heavy_rows: int = skew.HEAVY_ROWS) -> DataFrame:
    """The trie of `rebuilt` conversations."""
    return trie(rebuilt(digests(conversations)), shared_count(F.col("conv_id")), heavy_rows)
