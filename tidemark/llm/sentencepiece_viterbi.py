"""SentencePiece encoding and decoding: an Aho-Corasick automaton over the pieces drives a single-pass Viterbi.

The automaton reports, at each end position, the longest piece and by output links all shorter ones; each relaxes the
best score at its end. Characters without a piece of their own may be spelled in byte pieces, at ``UNKNOWN_PENALTY``
below the least score. Among equal scores the longer last piece wins. The result is the segmentation of greatest total
score, whatever way the model's scores came about.

No piece has a space after another sign, so texts fall into units at such places, and at signs that no piece has; the
best segmentation of a text is that of its units, and units are kept in a cache of bounded size. Decoding gives back
every text exactly, a literal U+2581 included (it is spelled in bytes).

Defined cases: a null text has null ids, and counts as empty in the digest; an empty text has no ids; a model whose
pieces hold inner spaces, or a normaliser, is refused; all columns pass through ``encode``, where a column of the name
of the new one is replaced.
"""

from __future__ import annotations

import hashlib
import re
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bytes_of, spread, table

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
UNKNOWN_PENALTY = 10.0
CACHE_UNITS = 300_000
_SPACE = "▁"


def _varint(data: bytes, at: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        b = data[at]
        at += 1
        value |= (b & 127) << shift
        shift += 7
        if b < 128:
            return value, at


def _fields(data: bytes) -> Iterator[tuple[int, object]]:
    """Numbers and values of a protocol-buffer message."""
    at = 0
    while at < len(data):
        key, at = _varint(data, at)
        kind = key & 7
        if kind == 0:
            value, at = _varint(data, at)
        elif kind == 2:
            size, at = _varint(data, at)
            value, at = data[at : at + size], at + size
        else:
            size = 4 if kind == 5 else 8
            value, at = struct.unpack("<f" if kind == 5 else "<d", data[at : at + size])[0], at + size
        yield key >> 3, value


class Model:
    """A SentencePiece model file's pieces, ready for encoding and decoding."""

    #: Kinds of pieces in the file format.
    NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6

    def __init__(self, data: bytes):
        import ahocorasick

        pieces: list[tuple[str, float, int]] = []
        self.prefix = True
        for number, value in _fields(data):
            if number == 1:
                got = dict(_fields(value))
                pieces.append((got[1].decode(), got.get(2, 0.0), got.get(3, self.NORMAL)))
            elif number == 3:
                got = dict(_fields(value))
                self.prefix = bool(got.get(3, 1))
                if got.get(2) or got.get(4, 1):
                    raise ValueError("the model's normaliser changes texts")
        self.pieces = pieces
        self.automaton = ahocorasick.Automaton()
        self.single: set[str] = set()
        self.byte = [-1] * 256
        signs: set[str] = set()
        scores = []
        spelled: list[bytes] = []
        for i, (piece, score, kind) in enumerate(pieces):
            text = piece.replace(_SPACE, " ")
            spelled.append(b"")
            if kind == self.BYTE:
                self.byte[int(piece[3:5], 16)] = i
                spelled[i] = bytes([int(piece[3:5], 16)])
            elif kind in (self.NORMAL, self.USER) and text:
                if " " in text.lstrip(" "):
                    raise ValueError("a piece has a space after another sign")
                self.automaton.add_word(text, (len(text), score, i))
                scores.append(score)
                signs |= set(text)
                if len(text) == 1:
                    self.single.add(text)
                spelled[i] = text.encode()
        if min(self.byte) < 0:
            raise ValueError("the model has no byte pieces")
        self.automaton.make_automaton()
        self.unknown = min(scores) - UNKNOWN_PENALTY
        alone = "".join(c for c in "\n\t\r" if c not in signs)
        cut = re.escape(alone)
        self.units = re.compile(rf"[{cut}]| *[^ {cut}]+| +" if alone else " *[^ ]+| +").findall
        self.sizes = np.array([len(x) for x in spelled], np.int64)
        self.starts = np.concatenate([[0], np.cumsum(self.sizes)[:-1]])
        self.bytes = np.frombuffer(b"".join(spelled), np.uint8)
        self.is_byte = np.array([p[2] == self.BYTE for p in pieces])
        self.cache: dict[str, bytes] = {}

    def segment(self, unit: str) -> tuple[list[int], float]:
        """Ids and score of the best segmentation."""
        n = len(unit)
        best: list = [None] * (n + 1)
        best[0] = 0.0
        back: list = [None] * (n + 1)
        done = 0
        single, unknown = self.single, self.unknown
        for end, (size, score, i) in self.automaton.iter(unit):
            while done < end:
                if unit[done] not in single and (best[done + 1] is None or best[done] + unknown > best[done + 1]):
                    best[done + 1], back[done + 1] = best[done] + unknown, (1, -1)
                done += 1
            got = best[end + 1 - size] + score
            if best[end + 1] is None or got > best[end + 1]:
                best[end + 1], back[end + 1] = got, (size, i)
        while done < n:
            if unit[done] not in single and (best[done + 1] is None or best[done] + unknown > best[done + 1]):
                best[done + 1], back[done + 1] = best[done] + unknown, (1, -1)
            done += 1
        out: list[int] = []
        at = n
        while at:
            size, i = back[at]
            if i >= 0:
                out.append(i)
            else:
                out += [self.byte[b] for b in reversed(unit[at - 1].encode())]
            at -= size
        out.reverse()
        return out, best[n]

    def packed(self, text: str) -> bytes:
        """Ids of a text, four bytes each."""
        if not text:
            return b""
        cache, out = self.cache, []
        for unit in self.units(f" {text}" if self.prefix else text):
            got = cache.get(unit)
            if got is None:
                got = np.array(self.segment(unit)[0], np.int32).tobytes()
                if len(unit) <= 64:
                    if len(cache) >= CACHE_UNITS:
                        cache.clear()
                    cache[unit] = got
            out.append(got)
        return b"".join(out)

    def encode(self, text: str) -> list[int]:
        return np.frombuffer(self.packed(text), np.int32).tolist()

    def spell(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The bytes of many ids in a row, and each id's number of bytes."""
        sizes = self.sizes[ids]
        ends = np.cumsum(sizes)
        index = np.repeat(self.starts[ids] - ends + sizes, sizes)
        index += np.arange(len(index))
        return self.bytes[index], sizes

    def decode(self, ids) -> str:
        raw, _ = self.spell(np.asarray(ids, np.int64))
        text = raw.tobytes().decode()
        return text[1:] if self.prefix and len(text) else text


_models: dict[bytes, Model] = {}


def model_of(data: bytes) -> Model:
    """One model a worker process."""
    key = hashlib.sha256(data).digest()
    if key not in _models:
        _models.clear()
        _models[key] = Model(data)
    return _models[key]


def _load(path: str) -> bytes:
    """On the driver; the file (under 1 MB) goes to the tasks with their code."""
    with open(path, "rb") as f:
        return f.read()


_PIECE = 2 << 20


def _parts(batches) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Slices of about 2 MB of text or one row."""
    for batch in batches:
        raw, offsets = bytes_of(batch.column("text"))
        at = 0
        while at < batch.num_rows:
            end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + _PIECE, "right")) - 1)
            yield batch.slice(at, end - at), raw[offsets[at] : offsets[end]], offsets[at : end + 1] - offsets[at]
            at = end


def encode(df: DataFrame, model_path: str = MODEL, column: str = "token_ids") -> DataFrame:
    """df with the ids of its ``text``."""
    data = _load(model_path)
    kept = df.drop(column)
    schema = T.StructType([*kept.schema.fields, T.StructField(column, T.ArrayType(T.IntegerType()))])

    def run(batches):
        model = model_of(data)
        for part, _, _ in _parts(batches):
            texts = part.column("text").to_pylist()
            ids = [model.packed(t) if t is not None else b"" for t in texts]
            flat = pa.array(np.frombuffer(b"".join(ids), np.int32))
            at = np.concatenate([[0], np.cumsum([len(x) // 4 for x in ids])]).astype(np.int32)
            mask = pa.array([t is None for t in texts])
            lists = pa.ListArray.from_arrays(pa.array(at), flat, mask=mask)
            yield pa.RecordBatch.from_arrays([*part.columns, lists], names=[*part.schema.names, column])

    return kept.mapInArrow(run, schema)


def decode(df: DataFrame, model_path: str = MODEL, column: str = "token_ids", to: str = "decoded") -> DataFrame:
    """df with the text that its ids spell."""
    data = _load(model_path)
    kept = df.drop(to)
    schema = T.StructType([*kept.schema.fields, T.StructField(to, T.StringType())])

    def run(batches):
        model = model_of(data)
        for batch in batches:
            lists = batch.column(column).to_pylist()
            text = pa.array([None if x is None else model.decode(x) for x in lists], pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns, text], names=[*batch.schema.names, to])

    return kept.mapInArrow(run, schema)


_DIGEST = pa.schema([("doc_id", pa.int64()), ("n_chars", pa.int64()), ("n_tokens", pa.int64()), ("n_byte_tokens", pa.int64()), ("ids_sha256", pa.string()), ("round_trip", pa.bool_())])


def digests(docs: DataFrame, model_path: str = MODEL) -> DataFrame:
    """doc_id, n_chars, n_tokens, n_byte_tokens, ids_sha256 (ids as little-endian 32-bit numbers) and whether decoding
    gave the text back."""
    data = _load(model_path)

    def run(batches):
        model = model_of(data)
        for part, raw, offsets in _parts(batches):
            texts = ["" if t is None else t for t in part.column("text").to_pylist()]
            ids = [model.packed(t) for t in texts]
            flat = np.frombuffer(b"".join(ids), np.int32)
            ends = np.cumsum([len(x) // 4 for x in ids])
            spelled, sizes = model.spell(flat)
            lead = np.concatenate([[0], np.cumsum(sizes)])[np.concatenate([[0], ends])]
            bits = np.concatenate([[0], np.cumsum(model.is_byte[flat])])[np.concatenate([[0], ends])]
            rows, whole, back = range(len(texts)), raw.tobytes(), spelled.tobytes()
            same = [back[lead[i] + (1 if model.prefix and lead[i + 1] > lead[i] else 0) : lead[i + 1]] == whole[offsets[i] : offsets[i + 1]] for i in rows]
            yield pa.RecordBatch.from_arrays(
                [
                    part.column("doc_id"),
                    pa.array([len(t) for t in texts], pa.int64()),
                    pa.array([len(x) // 4 for x in ids], pa.int64()),
                    pa.array(np.diff(bits), pa.int64()),
                    pa.array([hashlib.sha256(x).hexdigest() for x in ids]),
                    pa.array(same),
                ],
                schema=_DIGEST,
            )

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(run, "doc_id long, n_chars long, n_tokens long, n_byte_tokens long, ids_sha256 string, round_trip boolean")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(spread(table(spark, sf_dir, "documents")))
