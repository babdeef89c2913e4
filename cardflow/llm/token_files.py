"""Token ids as flat files: unsigned integers one after another, and 64-bit offsets of the documents in them.

Documents are dealt over the cluster in ranges of their id, and every task writes one segment of three files:
`.bin` (ids, 2 bytes each if the vocabulary allows, else 4), `.idx` (a 64-bit offset per document and one for the end, in
ids from the segment's start) and `.docs` (document ids as an Arrow stream). Segments are in ascending order of
document ids; a segment's base, the ids in all segments before it, is a prefix sum over the manifest. File names carry a
random part and only the manifest, which Spark commits, says which of them count: what a lost or repeated task wrote is never read.

Readers map files into memory where the folder is a local path and read ranges of them elsewhere.

Null and empty texts are documents of the end id alone. Null ids come first; rows of one id, repeated or null, go by a hash of their
text, and are cut over segments like others. A text is encoded in windows of about `WINDOW` characters, so its length
does not matter; a run without a space is encoded at once. An empty table has no segments.
"""

from __future__ import annotations

import json
import re
import uuid
import zlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyarrow import fs as filesystems
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cardflow.llm.bpe import byte_symbols, read_spec
from cardflow.llm.common import bounded
from cardflow.sources.store import materialize, shared_folder

# Text bytes encoded at once, characters of one text split at once and chunks looked up at once, chunks and plain words a
# worker remembers, documents read back at once.
BATCH_BYTES = 4 << 20
WINDOW = 1 << 20
FLUSHED = 500_000
REMEMBERED = 300_000
REMEMBERED_WORDS = 400_000
READ_DOCS = 50_000
END_ID = 2
# Plain words of Latin letters, perhaps with one mark after them: one or two pieces under any word vocabulary.
PLAIN = re.compile(r"([A-Za-zÀ-ÖØ-öø-ÿ]+)([.,;:!?]?)")


class Numbered(dict):
    """Numbers for chunks in the order in which they come; the new ones wait in `pending`."""

    def __init__(self) -> None:
        self.pending: list[str] = []

    def __missing__(self, chunk: str) -> int:
        self[chunk] = number = len(self)
        self.pending.append(chunk)
        return number


def windows(text: str) -> Iterator[str]:
    """A text in parts of about WINDOW characters, cut at spaces."""
    at = 0
    while len(text) - at > WINDOW and (cut := text.find(" ", at + WINDOW)) >= 0:
        yield text[at:cut]
        at = cut + 1
    yield text[at:]


class Encoder:
    """Ids of whole texts. Where a vocabulary drops white space, no token spans a space: texts are split there, and every
    distinct chunk is encoded once and remembered."""

    def __init__(self, spec: str) -> None:
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_str(spec)
        self.library.no_truncation()
        self.library.no_padding()
        self.stand_in = byte_symbols()
        parsed = json.loads(spec)
        steps = [s["type"] for s in (parsed["normalizer"] or {}).get("normalizers", [])]
        split = ((parsed["pre_tokenizer"] or {}).get("pretokenizers") or [{}])[0]
        self.by_chunk = (
            steps == ["NFC", "Replace", "Lowercase"] and split.get("behavior") == "Removed" and split.get("invert") is True
            and not any(re.search(r"\s", t["content"]) for t in parsed["added_tokens"]))
        self.words: dict[str, bytes] = {}
        self.forget()

    def forget(self) -> None:
        self.numbers = Numbered()
        self.ids, self.counts = np.zeros(0, np.uint32), np.zeros(0, np.int64)
        self.starts = self.counts
        if len(self.words) > REMEMBERED_WORDS:
            self.words.clear()

    def word(self, text: str) -> bytes:
        """Ids of one piece, lower-case Latin letters or one mark, as 32-bit integers."""
        symbols = text if text.isascii() else "".join(map(self.stand_in.__getitem__, text.encode()))
        self.words[text] = found = np.array([token.id for token in self.library.model.tokenize(symbols)], "<u4").tobytes()
        return found

    def remember(self) -> None:
        """Encodes the pending chunks: plain ones from their pieces, all others as the library does."""
        chunks, self.numbers.pending = self.numbers.pending, []
        words, word, odd = self.words.get, self.word, []
        made: list[bytes] = []
        for chunk in chunks:
            plain = PLAIN.fullmatch(chunk)
            if not plain:
                odd.append(len(made))
                made.append(b"")
                continue
            letters, mark = plain[1].lower(), plain[2]
            ids = words(letters) or word(letters)
            made.append(ids + (words(mark) or word(mark)) if mark else ids)
        coded = self.library.encode_batch_fast([chunks[i] for i in odd], add_special_tokens=False)
        for i, own in zip(odd, coded, strict=True):
            made[i] = np.array(own.ids, "<u4").tobytes()
        self.ids = np.concatenate([self.ids, np.frombuffer(b"".join(made), "<u4")])
        self.counts = np.concatenate([self.counts, np.fromiter(map(len, made), np.int64, len(made)) // 4])
        self.starts = np.cumsum(self.counts) - self.counts

    def expand(self, at: np.ndarray) -> np.ndarray:
        """The ids of numbered chunks, one after another."""
        n = self.counts[at]
        ends = np.cumsum(n)
        return self.ids[np.repeat(self.starts[at] - ends + n, n) + np.arange(n.sum())]

    def encode(self, texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Parts of all ids one after another, each with the running number of every text that ends in it: (ids, ends)."""
        if not self.by_chunk:
            for text in texts:
                ids = np.array(self.library.encode(text, add_special_tokens=False).ids, np.uint32)
                yield ids, np.array([len(ids)])
            return
        held: list[np.ndarray] = []
        last: list[int] = []
        size = 0

        def flush() -> tuple[np.ndarray, np.ndarray]:
            if self.numbers.pending:
                self.remember()
            at = np.concatenate(held) if held else np.zeros(0, np.int64)
            tokens = np.concatenate([[0], np.cumsum(self.counts[at])])
            made = self.expand(at), tokens[np.array(last, np.int64)]
            held.clear()
            last.clear()
            return made

        for text in texts:
            for part in windows(text):
                chunks = part.replace("\n", " ").split(" ")
                held.append(np.fromiter(map(self.numbers.__getitem__, chunks), np.int64, len(chunks)))
                size += len(chunks)
                if size > FLUSHED:
                    yield flush()
                    size = 0
            last.append(size)
        yield flush()
        if len(self.numbers) > REMEMBERED:
            self.forget()


_encoders: dict[str, Encoder] = {}


def encoder(spec: str) -> Encoder:
    """One encoder per vocabulary and worker."""
    if spec not in _encoders:
        _encoders.clear()
        _encoders[spec] = Encoder(spec)
    return _encoders[spec]


def unsigned(vocabulary: int) -> str:
    """The narrowest of two file types that holds all ids below `vocabulary`."""
    return "<u2" if vocabulary <= 1 << 16 else "<u4"


class Format(NamedTuple):
    spec: str
    folder: str
    dtype: str
    end_id: int


MANIFEST = "segment int, name string, n_docs long, n_ids long"


def write_segment(batches: Iterator[pa.RecordBatch], to: Format, segment: int) -> Iterator[pa.RecordBatch]:
    """Writes the documents of one task as a segment, batch by batch, and yields its row of the manifest."""
    system, folder = filesystems.FileSystem.from_uri(to.folder)
    name, own = f"{segment:06d}-{uuid.uuid4().hex}", encoder(to.spec)
    docs = ids = 0
    files: list = []
    try:
        for batch in batches:
            for part in bounded(batch, 1, BATCH_BYTES):
                if not files:
                    system.create_dir(folder, recursive=True)
                    files = [system.open_output_stream(f"{folder}/{name}.{kind}") for kind in ("bin", "idx", "docs")]
                    keys = pa.ipc.new_stream(files[2], pa.schema([part.schema.field(0)]))
                    files[1].write(np.zeros(1, "<i8"))
                keys.write_batch(part.select([0]))
                for made, ends in own.encode([t or "" for t in part.column(1).to_pylist()]):
                    files[0].write(np.insert(made, ends, to.end_id).astype(to.dtype))
                    # The end ids before it shift where a document ends.
                    files[1].write((ids + ends + np.arange(1, len(ends) + 1)).astype("<i8"))
                    ids += len(made) + len(ends)
                    docs += len(ends)
        if files:
            keys.close()
    finally:
        for file in files:
            file.close()
    if docs:
        yield pa.RecordBatch.from_pylist(
            [{"segment": segment, "name": name, "n_docs": docs, "n_ids": ids}],
            pa.schema([("segment", pa.int32()), ("name", pa.string()), ("n_docs", pa.int64()), ("n_ids", pa.int64())]))


class TokenFiles(NamedTuple):
    """A written set of segments."""

    folder: str
    dtype: str
    manifest: DataFrame  # segment, name, n_docs, n_ids, first_doc and base: documents and ids in all segments before


def write(docs: DataFrame, path: str, end_id: int = END_ID, folder: str | None = None) -> TokenFiles:
    """Encodes `text` of every row with the vocabulary file at `path` and writes segments in ascending order of `doc_id`.

    Texts are shuffled once, by ranges of (doc_id, hash of the text, place in the table); ids never are. The manifest has one row per
    task, so its prefix sums are one short window.
    """
    spark = docs.sparkSession
    spec = read_spec(path)
    parsed = json.loads(spec)
    highest = max([end_id, *parsed["model"]["vocab"].values(), *(t["id"] for t in parsed["added_tokens"])])
    to = Format("", folder or f"{shared_folder(spark)}/cardflow/tokens-{uuid.uuid4().hex}", unsigned(highest + 1), end_id)
    held = spark.sparkContext.broadcast(spec)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from write_segment(batches, to._replace(spec=held.value), TaskContext.get().partitionId())

    order = ["doc_id", "_hash", "_row"]
    sorted_docs = docs.select(
        "doc_id", "text", F.xxhash64("text").alias("_hash"), F.monotonically_increasing_id().alias("_row")
    ).repartitionByRange(*order).sortWithinPartitions(*order).select("doc_id", "text")
    written = materialize(sorted_docs.mapInArrow(run, MANIFEST), "token-manifest")
    before = W.orderBy("segment").rowsBetween(W.unboundedPreceding, -1)
    summed = [F.coalesce(F.sum(n).over(before), F.lit(0)).alias(name) for n, name in (("n_docs", "first_doc"), ("n_ids", "base"))]
    return TokenFiles(to.folder, to.dtype, written.select("*", *summed))


class Segment:
    """One segment's files, mapped into memory if they lie on a local path."""

    def __init__(self, folder: str, name: str, dtype: str) -> None:
        system, at = filesystems.FileSystem.from_uri(folder)
        self.path, self.system, self.dtype = f"{at}/{name}", system, np.dtype(dtype)
        self.ids, self.offsets = self.open("bin"), self.open("idx")

    def open(self, kind: str) -> pa.NativeFile:
        path = f"{self.path}.{kind}"
        return pa.memory_map(path) if self.system.type_name == "local" else self.system.open_input_file(path)

    def ends(self, first: int, n: int) -> np.ndarray:
        """Offsets of `n` documents from `first` on, and where the last of them ends."""
        return np.frombuffer(self.offsets.read_at(8 * (n + 1), 8 * first), "<i8")

    def read(self, start: int, end: int) -> np.ndarray:
        width = self.dtype.itemsize
        return np.frombuffer(self.ids.read_at((end - start) * width, start * width), self.dtype)

    def document(self, n: int) -> np.ndarray:
        return self.read(*self.ends(n, 1))

    def keys(self) -> Iterator[pa.RecordBatch]:
        """The document ids, in batches of their own sizes."""
        with self.open("docs") as file:
            yield from pa.ipc.open_stream(file)


def summarise(segment: Segment, base: int) -> Iterator[tuple[pa.Array, list[tuple[int, int, int]]]]:
    """(doc_id, [(start, n_tokens, ids_crc32)]) of a segment, READ_DOCS documents at once."""
    first = 0
    for batch in segment.keys():
        for at in range(0, batch.num_rows, READ_DOCS):
            keys = batch.column(0).slice(at, READ_DOCS)
            ends = segment.ends(first, len(keys))
            rows = []
            for start, end in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True):
                rows.append((base + start, end - start, zlib.crc32(segment.read(start, end).astype("<u4"))))
            first += len(keys)
            yield keys, rows


def read(spark: SparkSession, files: TokenFiles, key: str = "long") -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens and ids_crc32, from the files alone; one task a segment."""
    schema = f"doc_id {key}, start long, n_tokens long, ids_crc32 long"
    folder, dtype = files.folder, files.dtype

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                for keys, rows in summarise(Segment(folder, row["name"], dtype), row["base"]):
                    columns = zip(*rows, strict=True)
                    yield pa.RecordBatch.from_arrays(
                        [keys, *(pa.array(c, pa.int64()) for c in columns)], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    placed = materialize(files.manifest, "token-bases")
    return placed.repartitionByRange(max(1, placed.count()), "segment").select("name", "base").mapInArrow(run, schema)


def round_trip(docs: DataFrame, path: str) -> DataFrame:
    """Writes token files of all rows and returns what they hold: doc_id, start, n_tokens, ids_crc32."""
    return read(docs.sparkSession, write(docs, path), docs.schema["doc_id"].dataType.simpleString())
