"""Incremental, reversible line dedup: sharded cuckoo filters in front of exact reference-count tables.

State (`LineIndex`): `postings`, one row per key and document; `refs`, per key the number of postings and the smallest
and largest document; `filters`, per shard a cuckoo filter of the keys that more than one document holds. Inserting documents adds
postings and references and inserts newly shared keys into the filters of their shards; deleting documents takes
both back, so any document can be deduplicated again as if the deleted ones had never been there.

A key is the 128-bit hash of a line stripped of ASCII white space, A-Z in lower case, of at least `MIN_CHARS` code points.
Deduplicating reads a document's lines against the filters: a line the filters do not know is unique and
needs no exact lookup. What they know is settled by the exact table.

Documents are told apart by doc_id: rows with the same id count as one document, a null id as one that
comes after all others. Whole-number ids are ordered by value, ids of other types by their text. What a document loses is kept
per row, so rows without an id, however many, never meet in one list. A null or empty text is one empty line.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cardflow.llm import cuckoo
from cardflow.llm.common import bounded, fresh, without
from cardflow.sources.store import materialize

MIN_CHARS = 10
SPACE = " \t\n\x0b\x0c\r"
# Shared keys a shard is planned for; its filter takes about 2.5 bytes a key.
SHARD_KEYS = 1 << 16
# Filters of at most this size together are held by every task; above it every line goes to the exact table.
FILTER_BYTES = 64 << 20
LAST = (1 << 63) - 1
PAIR = struct.Struct("<qq")


def owner(docs: DataFrame) -> tuple[Column, str]:
    """What orders the documents, and its type: a null id comes last."""
    doc_id = F.col("doc_id")
    if isinstance(docs.schema["doc_id"].dataType, T.IntegralType):
        return F.coalesce(doc_id.cast("long"), F.lit(LAST).cast("long")), "long"
    return F.coalesce(F.concat(F.lit("0"), doc_id.cast("string")), F.lit("1")), "string"


def key_of(line: str) -> tuple[int, int] | None:
    line = line.strip(SPACE)
    return PAIR.unpack(xxhash.xxh3_128_digest(line.encode().lower())) if len(line) >= MIN_CHARS else None


def keys_of(text: str | None) -> set[tuple[int, int]]:
    found = set(map(key_of, (text or "").split("\n")))
    found.discard(None)
    return found


def _halves(keys: list[tuple[int, int]]) -> tuple[np.ndarray, np.ndarray]:
    both = np.array(keys, np.int64).reshape(-1, 2)
    return both[:, 0].copy(), both[:, 1].copy()


def line_keys(docs: DataFrame, known: Broadcast | None = None, shards: int = 1) -> DataFrame:
    """(doc, mark, a, b): the distinct keys of every row, `mark` being a hash of its text; with `known` (joined filters, their
    lengths and offsets in buckets), only keys that the filter of their shard holds."""
    doc_of, kind = owner(docs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in bounded(batch, 2):
                found = [list(keys_of(t)) for t in part.column(2).to_pylist()]
                a, b = _halves([k for keys in found for k in keys])
                row = np.repeat(np.arange(len(found)), [len(k) for k in found])
                if known is not None:
                    flat, lengths, offsets = known.value
                    shard = a % shards
                    held = cuckoo.contains(
                        flat, a.view(np.uint64), b.view(np.uint64), (lengths - 1)[shard].astype(np.uint64), offsets[shard])
                    row, a, b = row[held], a[held], b[held]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0).take(pa.array(row)), part.column(1).take(pa.array(row)), pa.array(a), pa.array(b)],
                    names=["doc", "mark", "a", "b"])

    return docs.select(doc_of.alias("doc"), F.xxhash64("text").alias("mark"), "text").mapInArrow(
        run, f"doc {kind}, mark long, a long, b long")


def references(postings: DataFrame) -> DataFrame:
    return postings.groupBy("a", "b").agg(
        F.count(F.lit(1)).alias("refs"), F.min("doc").alias("least"), F.max("doc").alias("most"))


@dataclass(frozen=True)
class LineIndex:
    postings: DataFrame  # doc, a, b
    refs: DataFrame  # a, b, refs, least, most
    filters: DataFrame  # shard, slots
    shards: int

    def shared(self) -> DataFrame:
        return self.refs.filter("least <> most")


def shard_of(shards: int) -> Column:
    return F.pmod(F.col("a"), F.lit(shards)).cast("int")


def build_filters(shared: DataFrame, shards: int) -> DataFrame:
    """A filter per shard that has keys; a shard's keys are few by the choice of `shards`."""
    def build(table: pa.Table) -> pa.Table:
        a, b = (table.column(c).to_numpy().view(np.uint64) for c in ("a", "b"))
        room = len(a)
        while not cuckoo.insert(slots := cuckoo.empty(room), a, b):
            room *= 2
        return pa.table({"shard": table.column("shard").slice(0, 1), "slots": pa.array([slots.tobytes()], pa.binary())})

    return shared.select(shard_of(shards).alias("shard"), "a", "b").groupBy("shard").applyInArrow(
        build, "shard int, slots binary")


def create(docs: DataFrame) -> LineIndex:
    """Insert documents into an empty index."""
    postings = materialize(line_keys(docs).drop("mark"), "postings")
    refs = materialize(references(postings), "refs")
    shards = max(1, -(-refs.filter("least <> most").count() // SHARD_KEYS))
    filters = materialize(build_filters(refs.filter("least <> most"), shards), "filters")
    return LineIndex(postings, refs, filters, shards)


def _changed(index: LineIndex, postings: DataFrame, touched: DataFrame) -> LineIndex:
    """The index after the postings of the `touched` keys changed: their references and filter entries anew."""
    now = references(postings.join(touched, ["a", "b"], "left_semi"))
    refs = materialize(index.refs.join(touched, ["a", "b"], "left_anti").unionByName(now), "refs")
    old = index.shared().join(touched, ["a", "b"], "left_semi").select("a", "b", F.lit(-1).alias("step"))
    new = refs.filter("least <> most").join(touched, ["a", "b"], "left_semi").select("a", "b", F.lit(1).alias("step"))
    steps = old.unionAll(new).groupBy("a", "b").agg(F.sum("step").alias("step")).filter("step <> 0")

    def update(filters: pa.Table, steps: pa.Table) -> pa.Table:
        shard = (filters if filters.num_rows else steps).column("shard").slice(0, 1)
        a, b, step = (steps.column(c).to_numpy() for c in ("a", "b", "step"))
        a, b = a.view(np.uint64), b.view(np.uint64)
        if filters.num_rows:
            slots = np.frombuffer(filters.column("slots")[0].as_py(), np.uint16).reshape(-1, cuckoo.SLOTS).copy()
        else:
            slots = cuckoo.empty(len(a))
        cuckoo.delete(slots, a[step < 0], b[step < 0])
        ok = cuckoo.insert(slots, a[step > 0], b[step > 0])
        return pa.table({"shard": shard, "slots": pa.array([slots.tobytes() if ok else None], pa.binary())})

    filters = materialize(
        index.filters.groupBy("shard").cogroup(steps.withColumn("shard", shard_of(index.shards)).groupBy("shard"))
        .applyInArrow(update, "shard int, slots binary"), "filters")
    # A filter that ran full is built anew from the exact table.
    full = filters.filter("slots IS NULL").select("shard")
    again = build_filters(
        refs.filter("least <> most").withColumn("shard", shard_of(index.shards)).join(full, "shard", "left_semi"), index.shards)
    filters = materialize(filters.filter("slots IS NOT NULL").unionByName(again), "filters")
    return LineIndex(postings, refs, filters, index.shards)


def insert(index: LineIndex, docs: DataFrame) -> LineIndex:
    """The index with more documents."""
    added = materialize(line_keys(docs).drop("mark"), "postings")
    return _changed(index, index.postings.unionByName(added), added.select("a", "b").distinct())


def delete(index: LineIndex, doc_ids: DataFrame) -> LineIndex:
    """The index without the documents of a doc_id column."""
    gone = doc_ids.select(owner(doc_ids)[0].alias("doc")).distinct()
    touched = materialize(index.postings.join(gone, "doc", "left_semi").select("a", "b").distinct(), "touched")
    return _changed(index, materialize(index.postings.join(gone, "doc", "left_anti"), "postings"), touched)


def suspects(docs: DataFrame, index: LineIndex, filter_bytes: int = FILTER_BYTES) -> DataFrame:
    """(doc, mark, a, b): lines the filters know, or all lines where the filters are too large to hold."""
    size = index.filters.agg(F.sum(F.octet_length("slots"))).first()[0] or 0
    if size > filter_bytes:
        return line_keys(docs)
    tables = {r["shard"]: np.frombuffer(r["slots"], np.uint16).reshape(-1, cuckoo.SLOTS) for r in index.filters.collect()}
    none = np.zeros((1, cuckoo.SLOTS), np.uint16)
    ordered = [tables.get(i, none) for i in range(index.shards)]
    lengths = np.array([len(t) for t in ordered])
    held = docs.sparkSession.sparkContext.broadcast((np.concatenate(ordered), lengths, np.cumsum(lengths) - lengths))
    return line_keys(docs, held, index.shards)


def dedup(docs: DataFrame, index: LineIndex, lines: str = "n_lines", dropped: str = "n_dropped") -> DataFrame:
    """All columns of `docs`, `text` without the lines that an earlier document holds, and line counts.

    Columns of `docs` that are called like the counts give way to them.
    """
    docs = without(docs, [lines, dropped])
    held_first = index.shared().select("a", "b", "least")
    lost = suspects(docs, index).join(held_first, ["a", "b"]).filter("doc <> least")
    # Per text of a document: a list is no longer than the text, even where many rows have no id.
    lists = materialize(lost.groupBy("doc", "mark").agg(F.collect_set(F.struct("a", "b")).alias("lost")), "lost-lines")
    doc, mark, gone = fresh(docs, "doc"), fresh(docs, "mark"), fresh(docs, "lost")
    joined = docs.withColumns({doc: owner(docs)[0], mark: F.xxhash64("text")}).join(
        lists.select(F.col("doc").alias(doc), F.col("mark").alias(mark), F.col("lost").alias(gone)), [doc, mark], "left")
    text, index_of_lost = docs.columns.index("text"), len(docs.columns)
    schema = T.StructType([*docs.schema.fields, T.StructField(lines, T.LongType()), T.StructField(dropped, T.LongType())])
    names = schema.fieldNames()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in bounded(batch, text):
                kept, counts, losses = [], [], []
                for value, lost in zip(part.column(text).to_pylist(), part.column(index_of_lost).to_pylist(), strict=True):
                    own = (value or "").split("\n")
                    counts.append(len(own))
                    if lost:
                        keys = {(k["a"], k["b"]) for k in lost}
                        own = [line for line in own if key_of(line) not in keys]
                        value = "\n".join(own)
                    losses.append(counts[-1] - len(own))
                    kept.append(value)
                columns = part.columns[:index_of_lost]
                columns[text] = pa.array(kept, pa.string())
                yield pa.RecordBatch.from_arrays([*columns, pa.array(counts, pa.int64()), pa.array(losses, pa.int64())], names=names)

    return joined.select(*docs.columns, gone).mapInArrow(run, schema)


def dedup_corpus(docs: DataFrame) -> DataFrame:
    """doc_id, n_lines, n_dropped, kept_sha256 of every row, all rows taken as one corpus."""
    rows = docs.select("doc_id", "text")
    return dedup(rows, create(rows)).select(
        "doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("kept_sha256"))
