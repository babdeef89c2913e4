"""BPE encoding and decoding with tree concatenation.

Text is normalised and split as the vocabulary file says (special tokens, NFC, lower case, letters | one digit | others);
each piece's UTF-8 bytes become symbols, the last one marked as word end. A piece of up to `LEAF` symbols is merged
pair by pair. A longer one is halved, down to leaves; joining two encoded halves re-encodes a window of tokens around
the join, which grows on each side until the token outside it and the first one inside are what BPE makes of the two
alone. A sequence whose neighbours all agree in this way is the encoding of the whole.

Null and empty texts have no tokens. Work is in proportion to a piece's length times the depth of its tree, whatever the piece.
"""

from __future__ import annotations

import hashlib
import json
import struct
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from cardflow.llm.common import BATCH_BYTES, extend

LEAF = 24
# Encoded pieces a worker remembers, and the longest one.
REMEMBERED = 150_000
SHORT = 32
SHIFT = 20


def byte_symbols() -> list[str]:
    """The printable stand-in of every byte: itself if visible in Latin-1, else the next character from U+0100 on."""
    visible = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return [chr(b if b in visible else next(spare)) for b in range(256)]


def little_endian(ids: list[int]) -> bytes:
    return struct.pack(f"<{len(ids)}I", *ids)


class NewerCharacter(Exception):
    """A piece holds a character that this Python's Unicode tables do not know; other tables may."""


class Vocabulary:
    """Pieces, merges and tokens of a vocabulary file in the tokenizers library's JSON form."""

    def __init__(self, spec: str) -> None:
        self.spec, spec = spec, json.loads(spec)
        model, steps = spec["model"], spec["normalizer"]["normalizers"]
        if [s["type"] for s in steps] != ["NFC", "Replace", "Lowercase"] or spec["decoder"] is not None:
            raise ValueError("this kind of vocabulary file is not handled")
        ids, end = model["vocab"], model["end_of_word_suffix"] or ""
        self.tokens = {i: t for t, i in ids.items()} | {t["id"]: t["content"] for t in spec["added_tokens"]}
        self.words = np.array([self.tokens[i] for i in range(len(self.tokens))], object)
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.specials = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")") if self.special else None
        self.pieces = regex.compile(spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"])
        stand_in = byte_symbols()
        self.inner = [ids[c] for c in stand_in]
        self.last = [ids[c + end] for c in stand_in]
        # (left << SHIFT | right) to (rank << SHIFT | merged).
        self.merges: dict[int, int] = {}
        self.halves: dict[int, tuple[int, int]] = {}
        for rank, (a, b) in enumerate(model["merges"]):
            merged = ids[a + b]
            self.merges.setdefault(ids[a] << SHIFT | ids[b], rank << SHIFT | merged)
            self.halves.setdefault(merged, (ids[a], ids[b]))
        self.parts: dict[int, list[int]] = {}
        self.agreed: dict[tuple[int, int], bool] = {}
        self.known: dict[str, bytes] = {}
        self.library = None

    def symbols(self, piece: str) -> list[int]:
        raw = piece.encode()
        return [self.inner[b] for b in raw[:-1]] + [self.last[raw[-1]]]

    def merge(self, ids: list[int]) -> list[int]:
        """Plain BPE: the pair of lowest rank first, leftmost of equals."""
        get, none = self.merges.get, 1 << 62
        ids = list(ids)
        found = [get(a << SHIFT | b, none) for a, b in zip(ids, ids[1:])]
        while found:
            best = min(found)
            if best == none:
                break
            i, merged = found.index(best), best & (1 << SHIFT) - 1
            ids[i : i + 2] = [merged]
            del found[i]
            if i:
                found[i - 1] = get(ids[i - 1] << SHIFT | merged, none)
            if i < len(found):
                found[i] = get(merged << SHIFT | ids[i + 1], none)
        return ids

    def split(self, token: int) -> list[int]:
        """The symbols a token is made of."""
        if token not in self.parts:
            pair = self.halves.get(token)
            self.parts[token] = self.split(pair[0]) + self.split(pair[1]) if pair else [token]
        return self.parts[token]

    def agree(self, a: int, b: int) -> bool:
        """BPE of the two tokens' symbols gives the two tokens."""
        if (a, b) not in self.agreed:
            if len(self.agreed) > REMEMBERED:
                self.agreed.clear()
            self.agreed[a, b] = self.merge(self.split(a) + self.split(b)) == [a, b]
        return self.agreed[a, b]

    def concatenate(self, left: list[int], right: list[int]) -> list[int]:
        i = j = 1
        while True:
            i, j = min(i, len(left)), min(j, len(right))
            window = self.merge([s for t in left[len(left) - i :] + right[:j] for s in self.split(t)])
            left_ok = i == len(left) or self.agree(left[-i - 1], window[0])
            right_ok = j == len(right) or self.agree(window[-1], right[j])
            if left_ok and right_ok:
                return left[: len(left) - i] + window + right[j:]
            i, j = i * (1 if left_ok else 2), j * (1 if right_ok else 2)

    def encode_symbols(self, symbols: list[int]) -> list[int]:
        """Leaves first, then neighbours joined, level by level."""
        level = [self.merge(symbols[i : i + LEAF]) for i in range(0, len(symbols), LEAF)]
        while len(level) > 1:
            level = [self.concatenate(*level[i : i + 2]) if i + 1 < len(level) else level[i]
                     for i in range(0, len(level), 2)]
        return level[0] if level else []

    def piece(self, text: str) -> bytes:
        """The ids of a piece as little-endian 32-bit integers."""
        if not text.isascii() and any(unicodedata.category(c) == "Cn" for c in text):
            raise NewerCharacter
        return self.remembered(text)

    def remembered(self, text: str) -> bytes:
        found = little_endian(self.encode_symbols(self.symbols(text)))
        if len(text) <= SHORT:
            if len(self.known) >= REMEMBERED:
                self.known.clear()
            self.known[text] = found
        return found

    def normalise(self, text: str) -> str:
        """NFC, then lower case letter by letter. White space never reaches a piece and is left as it is."""
        if not text.isascii():
            text = unicodedata.normalize("NFC", text).replace("Σ", "σ")
        return text.lower()

    def split_newer(self, text: str) -> list[str]:
        """Pieces of a text with characters that Python's tables do not know yet: the library that the
        vocabulary file is made for says what they are."""
        from tokenizers import Tokenizer

        if self.library is None:
            self.library = Tokenizer.from_str(self.spec)
        byte_of = {c: b for b, c in enumerate(byte_symbols())}
        found = self.library.pre_tokenizer.pre_tokenize_str(self.library.normalizer.normalize_str(text))
        return [bytes(map(byte_of.__getitem__, piece)).decode() for piece, _ in found]

    def encode(self, text: str) -> bytes:
        parts = self.specials.split(text) if self.specials and self.specials.search(text) else [text]
        out, known, piece = [], self.known, self.piece
        for part in parts:
            if part in self.special:
                out.append(self.special[part].to_bytes(4, "little"))
            elif part:
                try:
                    out += [known.get(p) or piece(p) for p in self.pieces.findall(self.normalise(part))]
                except NewerCharacter:
                    out += [little_endian(self.encode_symbols(self.symbols(p))) for p in self.split_newer(part)]
        return b"".join(out)


@lru_cache(maxsize=2)
def vocabulary(spec: str) -> Vocabulary:
    return Vocabulary(spec)


def read_spec(path: str) -> str:
    with open(path, encoding="utf-8") as file:
        return file.read()


def encode_texts(texts: pa.Array, own: Vocabulary) -> pa.ListArray:
    """Token ids of every text."""
    coded = [own.encode(t) if t else b"" for t in texts.to_pylist()]
    ends = np.cumsum([0, *(len(c) // 4 for c in coded)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(coded), "<i4")))


def decode_ids(ids: pa.ListArray, own: Vocabulary) -> list[str | None]:
    """The tokens of every id list joined by spaces, as a vocabulary without a decoder asks for; null gives null."""
    return [None if not ok else " ".join(own.words[ids[i].values.to_numpy()].tolist())
            for i, ok in enumerate(ids.is_valid().to_pylist())]


def encode(docs: DataFrame, path: str, ids: str = "ids") -> DataFrame:
    """All columns and the token ids of `text`. The vocabulary file is read at the driver and sent along."""
    held = docs.sparkSession.sparkContext.broadcast(read_spec(path))

    def compute(texts: pa.Array) -> list[pa.Array]:
        return [encode_texts(texts, vocabulary(held.value))]

    return extend(docs, [T.StructField(ids, T.ArrayType(T.IntegerType()))], compute)


def decode(docs: DataFrame, path: str, ids: str = "ids", decoded: str = "decoded") -> DataFrame:
    """All columns and the text that `ids` stand for."""
    held = docs.sparkSession.sparkContext.broadcast(read_spec(path))
    schema = T.StructType([*docs.schema.fields, T.StructField(decoded, T.StringType())])
    at, names = docs.columns.index(ids), schema.fieldNames()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = max(1, batch.num_rows * BATCH_BYTES // max(BATCH_BYTES, batch.column(at).nbytes))
            for start in range(0, batch.num_rows, rows):
                part = batch.slice(start, rows)
                texts = decode_ids(part.column(at), vocabulary(held.value))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(texts, pa.string())], names=names)

    return docs.mapInArrow(run, schema)


def encode_corpus(docs: DataFrame, path: str, keep: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 (ids as little-endian unsigned 32-bit integers), decoded_sha256 of every row.

    With `keep`, the ids and the decoded text come before the digests. Encoding, decoding and digests of a text happen
    in one Python worker, so without `keep` ids never travel.
    """
    held = docs.sparkSession.sparkContext.broadcast(read_spec(path))
    kept = [T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("decoded", T.StringType())] if keep else []
    fields = [T.StructField("n_tokens", T.LongType()), *kept, T.StructField("ids_sha256", T.StringType()),
              T.StructField("decoded_sha256", T.StringType())]

    def compute(texts: pa.Array) -> list[pa.Array]:
        ids = encode_texts(texts, vocabulary(held.value))
        decoded = decode_ids(ids, vocabulary(held.value))
        values, bounds = np.ascontiguousarray(ids.values.to_numpy(), "<u4"), ids.offsets.to_numpy().tolist()
        spans = list(zip(bounds[:-1], bounds[1:], strict=True))
        return [pa.array([b - a for a, b in spans], pa.int64()),
                *([ids, pa.array(decoded, pa.string())] if keep else []),
                pa.array([hashlib.sha256(values[a:b]).hexdigest() for a, b in spans], pa.string()),
                pa.array([hashlib.sha256(t.encode()).hexdigest() for t in decoded], pa.string())]

    return extend(docs.select("doc_id", "text"), fields, compute).drop("text")
