"""Document fingerprints by context-triggered piecewise hashing.

A rolling hash over 7 bytes ends a chunk where its value is a multiple of the block size; each chunk gives one of 64
signs by a hash of its bytes. A fingerprint is ``size:signs:signs`` for a block size and for twice that size, the block
size being the power of two times 3 that leaves up to 64 signs; it depends on the text alone. Two fingerprints are
compared where they have a block size in common: likeness = 1 - d / (a + b), d being the edit distance by insertions and
deletions and a, b the lengths.

``next_documents`` deals texts by ranges of (id, hash of the text), one shuffle, and lends each range the first document of
the following one, so that a text and the next one meet in one task without a global window. Ranges are cut at every so many
rows of the sorted pairs, so one id of any number of texts is many ranges.

Defined cases: a null text is empty; empty texts have the fingerprint ``3::``, alike to each other (1) and to nothing
else (0); rows that share an id are in the order of a hash of their texts; null ids come last in descending order; a lone row
is its own next document; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import bytes_of, mix64, settle, spread, table

WINDOW = 7
SIGNS = 64
LEAST = 3
#: Rows of a range; ranges number about MOST_RANGES at most, whose first rows are broadcast (17 bytes each, under 20 MB).
RANGE_ROWS = 2000
MOST_RANGES = 1_000_000
_ALPHABET = np.frombuffer(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/", np.uint8)
_BYTE = mix64(np.arange(1, 257, dtype=np.uint64))
_ROLL = mix64(np.arange(1001, 1257, dtype=np.uint64)).astype(np.uint32)
_MULT = 0x9E3779B97F4A7C15
_SLICE = 1 << 20


def _powers(n: int) -> np.ndarray:
    """_MULT ** i modulo 2**64 for i < n."""
    out = np.ones(n, np.uint64)
    with np.errstate(over="ignore"):
        np.multiply.accumulate(np.full(max(n - 1, 0), _MULT, np.uint64), out=out[1:]) if n > 1 else None
    return out


_UP = _powers(_SLICE)


def _rolling(raw: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """32-bit rolling hash at each byte over up to WINDOW bytes, not across the starts of texts."""
    t = _ROLL[raw]
    h = np.zeros(len(raw), np.uint32)
    for back in range(WINDOW):
        h[back:] += t[: len(t) - back] * np.uint32(pow(0x01000193, back, 1 << 32)) if back else t
    # the first bytes of each text see only that text
    for back in range(min(WINDOW - 1, len(raw))):
        at = starts + back
        at = at[at < len(raw)]
        at = at[np.searchsorted(starts, at, "right") - 1 == np.searchsorted(starts, at - back, "right") - 1]
        fixed = np.zeros(len(at), np.uint32)
        for k in range(back + 1):
            fixed += t[at - k] * np.uint32(pow(0x01000193, k, 1 << 32))
        h[at] = fixed
    h ^= h >> np.uint32(15)
    h *= np.uint32(0x2C1B3C6D)
    h ^= h >> np.uint32(12)
    return h


def _chunk_signs(raw: np.ndarray, cuts: np.ndarray) -> np.ndarray:
    """A sign for each chunk [cuts[i], cuts[i + 1])."""
    out = np.zeros(len(cuts) - 1, np.uint64)
    sizes = np.diff(cuts)
    place = np.arange(len(raw)) - np.repeat(cuts[:-1], sizes)
    with np.errstate(over="ignore"):
        value = _BYTE[raw] * (_UP[place % _SLICE])
        full = sizes > 0
        if full.any():
            out[full] = np.add.reduceat(value, cuts[:-1][full])
    return _ALPHABET[(mix64(out) >> np.uint64(58)).astype(np.int64)]


def fingerprints(raw: np.ndarray, offsets: np.ndarray) -> list[str]:
    """Of the texts raw[offsets[i]:offsets[i + 1]]."""
    n = len(offsets) - 1
    sizes = np.diff(offsets)
    if not len(raw):
        return [f"{LEAST}::"] * n
    full = np.flatnonzero(sizes)
    h = _rolling(raw, offsets[:-1][full])
    # the level of a byte: how many block sizes 3 * 2**level end a chunk at it, -1 for none
    h = h + np.uint32(1)
    third = h // np.uint32(LEAST)
    hits = np.flatnonzero(h == third * np.uint32(LEAST))
    third = third[hits]
    low = third & (~third + np.uint32(1))
    level = np.where(third == 0, 31, np.log2(np.maximum(low, 1)).astype(np.int64))
    text_of = np.searchsorted(offsets, hits, "right") - 1
    want = np.maximum(0, np.ceil(np.log2(np.maximum(sizes / (LEAST * SIGNS), 1))).astype(np.int64))
    # down from the expected level until it has half the signs, so that texts of few triggers still tell apart
    top = int(max(want.max(initial=0), 0)) + 2
    counts = np.zeros((top + 1, n), np.int64)
    for k in range(top + 1):
        counts[k] = np.bincount(text_of[level >= k], minlength=n)
    pick = want.copy()
    for _ in range(top):
        lower = (pick > 0) & (counts[pick, np.arange(n)] < SIGNS // 2)
        if not lower.any():
            break
        pick = pick - lower
    parts = [[], []]
    for double in (0, 1):
        keep = level >= (pick + double)[text_of]
        # at most SIGNS - 1 cuts a text: the rest of the text is its last chunk
        ends, of = hits[keep] + 1, text_of[keep]
        rank = np.arange(len(ends)) - np.searchsorted(of, of)
        ends = ends[rank < SIGNS - 1]
        cuts = np.unique(np.concatenate([ends, offsets[:-1][full], [len(raw)]]))
        signs = _chunk_signs(raw, cuts).tobytes().decode()
        at = np.searchsorted(cuts, offsets)
        parts[double] = [signs[at[i] : at[i + 1]] for i in range(n)]
    return [f"{LEAST << int(p)}:{a}:{b}" for p, a, b in zip(pick, *parts, strict=True)]


def common_length(a: str, b: str) -> int:
    """Length of the longest common subsequence, a bit for each sign of a."""
    at: dict[str, int] = {}
    for i, c in enumerate(a):
        at[c] = at.get(c, 0) | 1 << i
    whole = (1 << len(a)) - 1
    v = whole
    for c in b:
        u = v & at.get(c, 0)
        v = ((v + u) | (v - u)) & whole
    return len(a) - v.bit_count()


def likeness(x: str, y: str) -> float:
    if x == y:
        return 1.0
    (s, a, aa), (t, b, bb) = x.split(":"), y.split(":")
    s, t = int(s), int(t)
    pairs = [(a, b), (aa, bb)] if s == t else [(aa, b)] if t == 2 * s else [(a, bb)] if s == 2 * t else []
    return max((2 * common_length(p, q) / (len(p) + len(q)) for p, q in pairs if p and q), default=0.0)


def _sortable(o: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Pairs of 64-bit numbers as strings that sort like them; a last byte keeps zeros at their ends."""
    sign = np.uint64(1 << 63)
    out = np.ones((len(o), 17), np.uint8)
    for at, x in ((0, o), (8, h)):
        out[:, at : at + 8] = (x.astype(np.int64).view(np.uint64) ^ sign).astype(">u8").view(np.uint8).reshape(-1, 8)
    return out.view("S17").ravel()


def _edges(light: DataFrame, rows: int) -> np.ndarray:
    """Every ``rows``-th pair (o, h) of each partition of a range-partitioned sort, from its first on, without the least of
    all: ranges between edges have up to ``rows`` rows, or those of one pair."""

    def run(batches):
        at = 0
        for batch in batches:
            picked = np.arange(-at % rows, batch.num_rows, rows)
            at += batch.num_rows
            yield batch.take(pa.array(picked))

    got = light.repartitionByRange("o", "h").sortWithinPartitions("o", "h").mapInArrow(run, "o long, h long").toArrow()
    return np.unique(_sortable(got["o"].to_numpy(), got["h"].to_numpy()))[1:]


def next_documents(docs: DataFrame, range_rows: int = RANGE_ROWS) -> DataFrame:
    """(rng, doc_id, text, guest): sorted within partitions, each range in descending order of id, its last row a guest:
    the first of the next range, or of the first range after the last one."""
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    base = base.select("*", F.coalesce("doc_id", F.lit(-(1 << 63))).alias("o"), F.xxhash64("text").alias("h"))
    light = settle(base.select("o", "h"), "ctph-order")
    edges = _edges(light, max(range_rows, -(-light.count() // MOST_RANGES)))

    @F.pandas_udf("int")
    def range_of(o, h):
        import pandas as pd

        return pd.Series(len(edges) - np.searchsorted(edges, _sortable(o.to_numpy(), h.to_numpy()), "right"))

    rng = range_of("o", "h") if len(edges) else F.lit(0)
    heads = light.select(rng.alias("rng"), "o", "h").groupBy("rng").agg(F.max(F.struct("o", "h")).alias("head"))
    # one row a range, at most MOST_RANGES: small enough to sort in one task and to send to all
    by = Window.orderBy("rng")
    before = F.lag("rng").over(by)
    guests = heads.select("head", F.coalesce(before, F.max("rng").over(Window.partitionBy(F.lit(0)))).alias("to"))
    g = F.broadcast(settle(guests.select(F.col("head.o").alias("_o"), F.col("head.h").alias("_h"), "to"), "ctph-heads"))
    rows = base.select("doc_id", "text", "o", "h", rng.alias("rng"))
    rows = rows.join(g, (rows.o == g._o) & (rows.h == g._h), "left")
    own = F.struct(F.col("rng").alias("rng"), F.lit(0).alias("guest"))
    lent = F.struct(F.col("to").alias("rng"), F.lit(1).alias("guest"))
    rows = rows.select("doc_id", "text", "o", "h", F.explode(F.when(F.col("to").isNull(), F.array(own)).otherwise(F.array(own, lent))).alias("at"))
    rows = rows.select(F.col("at.rng").alias("rng"), F.col("at.guest").alias("guest"), "o", "h", "doc_id", "text")
    return rows.repartition("rng").sortWithinPartitions("rng", "guest", F.col("o").desc(), F.col("h").desc()).select("rng", "guest", "doc_id", "text")


_OUT = pa.schema([("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()), ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64())])
_PIECE = 4 << 20


def _pieces(batches) -> Iterator[tuple[list, list, list, list]]:
    """Rows in lists of up to about 4 MB of text."""
    for batch in batches:
        _, offsets = bytes_of(batch.column("text"))
        at = 0
        while at < batch.num_rows:
            end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + _PIECE, "right")) - 1)
            part = batch.slice(at, end - at)
            yield part
            at = end


def fingerprint_texts(texts: list[str]) -> list[str]:
    column = pa.array(texts, pa.large_string())
    raw, offsets = bytes_of(column)
    return fingerprints(raw, offsets)


def compare_with_next(docs: DataFrame, range_rows: int = RANGE_ROWS) -> DataFrame:
    """For each document: its fingerprint, that of the text edited with the next document's head, and both likenesses."""

    def run(batches):
        held = None  # (rng, doc_id, text, fingerprint) that waits for its next document
        for part in _pieces(batches):
            rows = list(zip(*(part.column(k).to_pylist() for k in ("rng", "guest", "doc_id", "text")), strict=True))
            prints = fingerprint_texts([r[3] for r in rows])
            done, edited = [], []
            for row, mark in zip(rows, prints, strict=True):
                if held is not None and held[0] == row[0]:
                    text, n = held[2], len(held[2])
                    edited.append(text[: n - n // 3] + row[3][: n // 3])
                    done.append((held[1], n, held[3], mark))
                held = None if row[1] else (row[0], row[2], row[3], mark)
            if done:
                ends = fingerprint_texts(edited)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([d[0] for d in done], pa.int64()),
                        pa.array([d[1] for d in done], pa.int64()),
                        pa.array([hashlib.sha256(e.encode()).hexdigest() for e in edited]),
                        pa.array([d[2] for d in done]),
                        pa.array(ends),
                        pa.array([likeness(d[2], e) for d, e in zip(done, ends, strict=True)]),
                        pa.array([likeness(d[2], d[3]) for d in done]),
                    ],
                    schema=_OUT,
                )

    return next_documents(docs, range_rows).mapInArrow(run, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compare_with_next(spread(table(spark, sf_dir, "documents").select("doc_id", "text")))
