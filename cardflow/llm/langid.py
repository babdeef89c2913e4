"""Language ID with one Bloom filter whose slots are language bit masks.

Every byte 5-gram of a language's fitting rows sets that language's bit in `HASHES` slots; the number of slots follows
the number of grams. Reading a gram ANDs its slots and so gives all languages that hold it at once. Per language the
hits of a text are counted, corrected for the filter's false positives (fill rate to the power of the hash count), and
the largest corrected share decides; ties go to the language with more labelled rows, then by name.

Null texts and texts without a letter are `und` with score 0; so is every text if nothing was learned. The score is the
corrected share of the text's grams that the winner holds. Very long texts are read whole, one at a time. Rows alike in
id, text and language are one fitting row; a language with labelled rows has at least one, whatever the ids.
"""

from __future__ import annotations

import re
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cardflow.llm.common import bounded, extend, fold_of, mix, utf8
from cardflow.sources.store import materialize

GRAM = 5
HASHES = 3
# Labelled rows per language the filter is fitted on (whole texts).
FIT_ROWS = 4_000
# Slots per gram of the language with most, at least; a language then fills at most 3 of 32 slots, and under one strange gram in 1,000 is found.
ROOM = 32
LEAST_SLOTS = 1 << 16
# Slots whose masks a task puts together at once.
BLOCK = 1 << 16
UNKNOWN = "und"
ASCII_LETTER = re.compile("[A-Za-z]")
# Letters in lower case, bytes of longer characters as they are, all else a space.
FOLD = np.full(256, 32, np.uint8)
FOLD[128:] = np.arange(128, 256)
FOLD[97:123] = FOLD[65:91] = np.arange(97, 123)
BLANK = np.uint64(int.from_bytes(b" " * GRAM, "little"))


class LanguageFilter(NamedTuple):
    languages: list[str]  # by labelled rows, most first
    masks: np.ndarray  # (words, slots): bit j of word i is language 64 * i + j
    false_positive: np.ndarray


def grams(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Grams of all texts as integers, and where each text's begin; every text stands between GRAM - 1 spaces and one, so that
    a gram over two texts is blank."""
    raw, bounds = utf8(texts)
    rows, pad = len(texts), GRAM
    folded = np.full(len(raw) + pad * rows + pad, 32, np.uint8)
    shift = np.repeat(np.arange(rows), np.diff(bounds)) * pad
    folded[np.arange(len(raw)) + shift + GRAM - 1] = FOLD[raw]
    count = len(raw) + pad * rows
    packed = np.zeros(count, np.uint64)
    for i in range(GRAM):
        packed |= folded[i : i + count].astype(np.uint64) << np.uint64(8 * i)
    return packed, bounds[:-1] + np.arange(rows) * pad


def slots(packed: np.ndarray, size: int) -> list[np.ndarray]:
    return [mix(packed + np.uint64(0x9E3779B97F4A7C15 * (i + 1) & (1 << 64) - 1)) & np.uint64(size - 1)
            for i in range(HASHES)]


def language_grams(docs: DataFrame) -> DataFrame:
    """(lang, gram): the distinct grams of whole texts."""
    def run(batches):
        for batch in batches:
            for part in bounded(batch, 1, 4 << 20):
                langs = np.array(part.column(0).to_pylist(), object)
                for lang in sorted(set(langs)):
                    packed, _ = grams(part.column(1).filter(pa.array(langs == lang)))
                    found = np.unique(packed[packed != BLANK])
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([lang] * len(found), pa.string()), pa.array(found.astype(np.int64))], names=["lang", "gram"])

    return docs.select("lang", F.coalesce("text", F.lit("")).alias("text")).mapInArrow(run, "lang string, gram long").distinct()


def fitting_rows(labelled: DataFrame, fit_rows: int) -> tuple[DataFrame, dict[str, int]]:
    """At most `fit_rows` different rows of every language, those of the smallest hashes of id and text, and the rows of each.

    Hashes above four times the wanted share are left out before anything is ordered, so that no task meets all of them.
    """
    rows = labelled.withColumn("key", F.xxhash64("doc_id", "text", F.lit("language")))
    keys = materialize(rows.groupBy("lang", "key").agg(F.count(F.lit(1)).alias("n")), "language-keys")
    sizes = materialize(keys.groupBy("lang").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("different")), "language-sizes")
    drawn = (F.col("key") / float(1 << 63) + 1) / 2 <= (4 * fit_rows + 100) / F.col("different")
    order = Window.partitionBy("lang").orderBy("key")
    limits = (
        keys.join(F.broadcast(sizes.select("lang", "different")), "lang").filter(drawn)
        .withColumn("place", F.row_number().over(order)).filter(F.col("place") <= fit_rows)
        .groupBy("lang").agg(F.max("key").alias("limit")))
    # Both broadcast tables have one row per language, as many as the masks at the driver have bits: keys and texts stay where
    # they are until drawn or picked.
    picked = rows.join(F.broadcast(materialize(limits, "language-limits")), "lang").filter(F.col("key") <= F.col("limit")).dropDuplicates(["lang", "key"])
    return picked.select("lang", "text"), {r["lang"]: r["n"] for r in sizes.collect()}


def learn(docs: DataFrame, may_learn: Column, fit_rows: int = FIT_ROWS) -> LanguageFilter:
    """Fit on at most `fit_rows` labelled rows per language, picked by a hash of id and text.

    All of their grams enter the filter. Tasks build it in blocks; one number per language and the finished masks come to the driver.
    """
    labelled = docs.filter(may_learn & F.col("lang").isNotNull()).select("doc_id", "text", "lang")
    picked, sizes = fitting_rows(labelled, fit_rows)
    languages = sorted(sizes, key=lambda lang: (-sizes[lang], lang))
    place = {lang: i for i, lang in enumerate(languages)}
    held = materialize(language_grams(picked), "language-grams")
    most = max((r["n"] for r in held.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()), default=0)
    size = max(LEAST_SLOTS, 1 << (ROOM * most - 1).bit_length() if most else 0)

    def bits(batches):
        for batch in batches:
            at = np.array([place[lang] for lang in batch.column(0).to_pylist()], np.int64)
            packed = batch.column(1).to_numpy().astype(np.uint64)
            for slot in slots(packed, size):
                # One entry per word of masks and slot, with the bits of all its languages.
                keys = at // 64 * size + slot.astype(np.int64)
                order = np.argsort(keys, kind="stable")
                found, starts = np.unique(keys[order], return_index=True)
                if len(found):
                    masks = np.bitwise_or.reduceat(np.uint64(1) << (at[order] % 64).astype(np.uint64), starts)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(found // BLOCK), pa.array((found % BLOCK).astype(np.int32)), pa.array(masks.view(np.int64))],
                        names=["block", "slot", "mask"])

    def build(table: pa.Table) -> pa.Table:
        masks = np.zeros(BLOCK, np.uint64)
        np.bitwise_or.at(masks, table.column("slot").to_numpy(), table.column("mask").to_numpy().view(np.uint64))
        return pa.table({"block": table.column("block").slice(0, 1), "masks": pa.array([masks.tobytes()], pa.binary())})

    blocks = held.mapInArrow(bits, "block long, slot int, mask long").groupBy("block").applyInArrow(
        build, "block long, masks binary")
    masks = np.zeros((max(1, -(-len(languages) // 64)), size), np.uint64)
    flat = masks.reshape(-1)
    for r in blocks.toLocalIterator():
        flat[r["block"] * BLOCK : (r["block"] + 1) * BLOCK] = np.frombuffer(r["masks"], np.uint64)
    fill = np.array([np.count_nonzero(masks[i // 64] & np.uint64(1 << i % 64)) for i in range(len(languages))]) / size
    return LanguageFilter(languages, masks, fill**HASHES)


def shares(texts: pa.Array, model: LanguageFilter) -> np.ndarray:
    """(texts, languages): corrected share of each text's grams that a language holds."""
    packed, starts = grams(texts)
    real = packed != BLANK
    total = np.maximum(np.add.reduceat(real, starts, dtype=np.int64), 1)
    found = np.empty((len(texts), len(model.languages)))
    at = slots(packed, model.masks.shape[1])
    for word, masks in enumerate(model.masks):
        held = masks[at[0]]
        for slot in at[1:]:
            held &= masks[slot]
        held[~real] = 0
        for bit, lang in enumerate(range(64 * word, min(64 * word + 64, len(model.languages)))):
            hits = np.add.reduceat((held >> np.uint64(bit)) & np.uint64(1), starts, dtype=np.int64)
            found[:, lang] = hits / total
    return np.clip((found - model.false_positive) / (1 - model.false_positive), 0, 1)


def has_letter(text: str | None) -> bool:
    return bool(text) and (ASCII_LETTER.search(text) is not None or any(map(str.isalpha, text)))


def identify(docs: DataFrame, model: LanguageFilter, language: str = "lang_pred", score: str = "score") -> DataFrame:
    """All columns of `docs`, with the predicted language and its score."""
    # Slots follow the grams of at most languages x FIT_ROWS texts.
    held = docs.sparkSession.sparkContext.broadcast(model)

    def compute(texts: pa.Array) -> list[pa.Array]:
        model = held.value
        lettered = np.array([has_letter(t) for t in texts.to_pylist()], bool)
        if not model.languages or not len(texts):
            return [pa.array([UNKNOWN] * len(texts), pa.string()), pa.array([0.0] * len(texts), pa.float64())]
        got = shares(texts, model)
        best = got.argmax(axis=1)
        names = [model.languages[i] if ok else UNKNOWN for i, ok in zip(best, lettered, strict=True)]
        return [pa.array(names, pa.string()), pa.array(np.where(lettered, got.max(axis=1), 0.0), pa.float64())]

    return extend(docs, [T.StructField(language, T.StringType()), T.StructField(score, T.DoubleType())], compute)


def identify_held_out(docs: DataFrame) -> DataFrame:
    """Learn from three of four folds of the ids; predict all. A null id is never held out."""
    held_out = F.coalesce(fold_of(F.col("doc_id"), 4) == 2, F.lit(False))
    rows = docs.select("doc_id", "text", "lang")
    model = learn(rows, ~held_out)
    return identify(rows.select("doc_id", "text"), model).select(
        "doc_id", held_out.alias("held_out"), "lang_pred", "score")
