"""Suffix-array dedup: exact removal of every repeated 100-byte string of a corpus.

1. Texts come in shards of LOT bytes. Each shard gets its suffix array (Larsson-Sadakane refinement) over all its bytes
   and the common prefixes of neighbours in it (Kasai). Runs of 100 common bytes are classes of equal windows, of which
   all but the first, by id and place, are repeats. The firsts go on.
2. Shards are merged where they can have windows in common. Each window has an anchor, the GRAM bytes in it of least
   hash (the leftmost of equals), so equal windows have equal anchors. Neighbouring firsts of one anchor are a piece; a
   shard tells the hashes of its pieces' anchors, and anchors that several shards have are contested.
3. The bytes of contested pieces are fetched and gathered by anchor. Of pieces that are equal byte for byte the first is
   kept; suffix arrays and common prefixes of the rest find the windows that are equal across shards of texts.
4. An anchor with more than SHARD_PIECES contested pieces is spread over many shards of pieces. Its firsts leave each of
   them as a run of windows in suffix order, dealt out by a hash of the window; the runs that meet are merged by binary
   search of one in the other. Such anchors are known before pieces are gathered, from reports of all shards (``_hot``).
5. Repeats of a document are painted on its bytes.

Whether windows are equal is always told by their bytes; hashes only say what meets where. Rows travel as compressed blobs
of columns, a blob for each shard and bucket. Texts are sent twice, compressed; neighbouring ids go together, but the texts
of an id that has more than SHARD bytes of them (as null ids may) are dealt by their own hashes.

Defined cases: a null text is empty; texts under 100 bytes have no windows; null ids come before all others; rows that
repeat id and text count as one document (each gets its result); rows that share an id only are ordered by a hash of
the text; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bytes_of, mix64, settle, spread, table
from .suffixes import common_prefixes, suffix_array

LENGTH = 100
GRAM = 32
#: Bytes of text in one suffix array (a longer text is cut into overlapping shards), of texts in a blob, and that a bucket of documents or pieces is to have.
LOT, BLOB, SHARD = 4 << 20, 8 << 20, 16 << 20
SHARD_PIECES = 50_000
#: A shard reports each anchor of so many pieces, and of fewer with a chance in proportion; at most so many anchors (of 12
#: bytes) are spread ahead, those of most pieces.
REPORTED, MOST_HOT = 64, 1_000_000
_RUN = 64  # neighbouring ids that go to one shard of documents
_CHUNK = 1 << 19
_MULT = 0x9E3779B97F4A7C15
_BYTE = mix64(np.arange(1, 257, dtype=np.uint64))


def _powers(m: int, n: int) -> np.ndarray:
    out = np.ones(n, np.uint64)
    with np.errstate(over="ignore"):
        np.multiply.accumulate(np.full(n - 1, m, np.uint64), out=out[1:])
    return out


class _Tables:
    """Powers of the rolling hash, made once a worker."""

    up = down = None

    @classmethod
    def get(cls):
        if cls.up is None:
            cls.up, cls.down = _powers(_MULT, _CHUNK), _powers(pow(_MULT, -1, 1 << 64), _CHUNK)
        return cls.up, cls.down


# --- blobs -----------------------------------------------------------------------------------------------------------

_KINDS = (np.uint8, np.uint32, np.uint64, np.int64)


def pack(*arrays: np.ndarray) -> bytes:
    import zstandard

    parts = []
    for a in arrays:
        parts += [np.array([_KINDS.index(a.dtype.type), len(a)], np.int64).tobytes(), a.tobytes()]
    return zstandard.ZstdCompressor(level=1).compress(b"".join(parts))


def unpack(blob: bytes) -> list[np.ndarray]:
    import zstandard

    raw = zstandard.ZstdDecompressor().decompress(blob)
    out, at = [], 0
    while at < len(raw):
        kind, n = np.frombuffer(raw, np.int64, 2, at)
        at += 16
        out.append(np.frombuffer(raw, _KINDS[kind], n, at))
        at += out[-1].nbytes
    return out


class Docs:
    """Documents as rows of two arrays, so that other arrays can name them by number: id and hash of the text."""

    @staticmethod
    def order(ids: np.ndarray, marks: np.ndarray) -> np.ndarray:
        return np.lexsort((marks, ids))

    @staticmethod
    def joined(parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """From (ids, marks, numbers) of several blobs: one table in order, and all numbers against it."""
        ids, marks = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
        by = Docs.order(ids, marks)
        i, m = ids[by], marks[by]
        new = np.ones(len(by), bool)
        new[1:] = (i[1:] != i[:-1]) | (m[1:] != m[:-1])
        place = np.empty(len(by), np.int64)
        place[by] = np.cumsum(new) - 1
        base = np.cumsum([0, *(len(p[0]) for p in parts[:-1])])
        numbers = np.concatenate([place[p[2].astype(np.int64) + b] for p, b in zip(parts, base, strict=True)])
        return i[new], m[new], numbers


class Shards:
    """To which of ``n`` shards a document goes. ``wide``: ids of much text, ascending, whose documents are spread."""

    def __init__(self, n: int, wide: np.ndarray):
        self.n, self.wide = n, wide

    def of(self, ids: np.ndarray, marks: np.ndarray) -> np.ndarray:
        h = mix64((ids // _RUN).astype(np.int64).view(np.uint64))
        if len(self.wide):
            own = self.wide[np.minimum(np.searchsorted(self.wide, ids), len(self.wide) - 1)] == ids
            h[own] ^= mix64(marks[own])
        return (h % np.uint64(self.n)).astype(np.int64)


_ROW = pa.schema([("part", pa.int64()), ("kind", pa.int32()), ("blob", pa.binary())])
_ROW_DDL = "part long, kind int, blob binary"
PIECES, REPEATS, WANTED, TEXTS, FETCHED, RUNS, COUNTS = range(7)


def _rows(rows: list[tuple[int, int, bytes]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int32()), pa.array([r[2] for r in rows], pa.binary())], schema=_ROW)


def _split(part: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """Each part's number and rows."""
    by = np.argsort(part, kind="stable")
    p = part[by]
    cuts = np.flatnonzero(np.concatenate([[True], p[1:] != p[:-1]])) if len(p) else np.zeros(0, np.int64)
    for a, b in zip(cuts, [*cuts[1:], len(p)]):
        yield int(p[a]), by[a:b]


def _repeats(ids, marks, doc, start, count, shards: Shards) -> list[tuple[int, int, bytes]]:
    """Rows of kind REPEATS: runs of windows that are repeats, by shard of their documents. doc: numbers in order."""
    if not len(doc):
        return []
    by = np.lexsort((start, doc))
    doc, start, count = doc[by], start[by].astype(np.int64), count[by].astype(np.int64)
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (start[1:] != start[:-1] + count[:-1])
    cuts = np.flatnonzero(new)
    count = np.add.reduceat(count, cuts)
    doc, start = doc[cuts], start[cuts]
    return [(part, REPEATS, _named(ids, marks, doc[rows], start[rows].astype(np.uint32), count[rows].astype(np.uint32))) for part, rows in _split(shards.of(ids[doc], marks[doc]))]


def _steps(a: np.ndarray) -> np.ndarray:
    """Differences of neighbours, which pack better than ascending numbers; np.cumsum undoes it."""
    return np.diff(a, prepend=a.dtype.type(0))


def _pack_pieces(ids, marks, doc, h, start, count) -> bytes:
    """Pieces in order of document and place. Of the hash 32 bits, beside those that chose the bucket: where they clash
    more pieces are compared."""
    by = np.lexsort((start, doc))
    used, numbers = np.unique(doc[by], return_inverse=True)
    place = numbers * (1 << 32) + start[by].astype(np.int64)
    return pack(_steps(ids[used]), marks[used], _steps(numbers).astype(np.uint8), _steps(place).astype(np.uint32), (h[by] >> np.uint64(32)).astype(np.uint32), count[by].astype(np.uint8))


def _unpack_pieces(blob: bytes) -> tuple[np.ndarray, ...]:
    """ids, marks, document, hash, first window and number of windows."""
    ids, marks, numbers, place, h, count = unpack(blob)
    doc = np.cumsum(numbers, dtype=np.int64)
    # differences of places are modulo 2**32, within a document and from one to the next
    return np.cumsum(ids), marks, doc, h, np.cumsum(place, dtype=np.uint32), count


def _named(ids, marks, doc, *columns) -> bytes:
    used, numbers = np.unique(doc, return_inverse=True)
    return pack(ids[used], marks[used], numbers.astype(np.uint32), *columns)


# --- 1: shards of texts ----------------------------------------------------------------------------------------------


def anchors(raw: np.ndarray, use: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pieces of a buffer of up to _CHUNK bytes: hash of the anchor, first window and number of windows. ``use``: which
    positions begin a window that counts."""
    up, down = _Tables.get()
    n = len(raw)
    width = LENGTH - GRAM + 1
    if n < LENGTH:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    with np.errstate(over="ignore"):
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum(_BYTE[raw] * up[:n], out=sums[1:])
        h = mix64((sums[GRAM:] - sums[:-GRAM]) * down[: n - GRAM + 1])
        low = np.uint64(_CHUNK * 2 - 1)
        v = (h & ~low) | np.arange(len(h), dtype=np.uint64)
        m, step = v, 1
        while 2 * step <= width:
            m = np.minimum(m[:-step], m[step:])
            step *= 2
        if step < width:
            size = len(v) - width + 1
            m = np.minimum(m[:size], m[width - step :][:size])
        anchor = (m & low).astype(np.int64)
        ok = use[: len(anchor)]
        new = np.ones(len(anchor), bool)
        new[1:] = (anchor[1:] != anchor[:-1]) | (ok[1:] != ok[:-1])
        stops = np.flatnonzero(new)
        own = ok[stops]
        first = stops[own]
        count = np.concatenate([stops[1:], [len(anchor)]])[own] - first
        return h[anchor[first]], first, count


def equal_windows(raw: np.ndarray, offsets: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of texts in one buffer: which positions begin a window, which of these repeat one of smaller key, and the suffix
    order. key: of each text its first window's; windows count on from there. Windows of equal key are one."""
    sizes = np.diff(offsets)
    live = np.zeros(len(raw), bool)
    edge = np.zeros(len(raw) + 1, np.int32)
    full = sizes >= LENGTH
    np.add.at(edge, offsets[:-1][full], 1)
    np.add.at(edge, offsets[1:][full] - LENGTH + 1, -1)
    np.greater(np.cumsum(edge[:-1]), 0, out=live)
    late = np.zeros(len(raw), bool)
    order, shared = suffix_array(raw, LENGTH)
    common = common_prefixes(raw, order, LENGTH, shared, LENGTH // 2)
    same = common >= LENGTH
    many = same.copy()
    many[:-1] |= same[1:]
    rows = np.flatnonzero(many)
    rows = rows[live[order[rows]]]
    if len(rows):
        at = order[rows]
        text = np.searchsorted(offsets, at, "right") - 1
        keys = key[text] + (at - offsets[text])
        run = np.cumsum(~same)[rows]
        new = np.ones(len(rows), bool)
        new[1:] = run[1:] != run[:-1]
        least = np.minimum.reduceat(keys, np.flatnonzero(new))
        late[at] = keys != least[np.cumsum(new) - 1]
    return live, late, order


def _runs(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First positions and lengths of the runs of a mask of windows. Between those of two texts there are other positions."""
    edge = np.diff(np.concatenate([[False], mask, [False]]).astype(np.int8))
    first = np.flatnonzero(edge == 1)
    return first, np.flatnonzero(edge == -1) - first


def _mark(raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """64-bit hash of each text."""
    whole = raw.tobytes()
    return np.array([int.from_bytes(hashlib.blake2b(whole[a:b], digest_size=8).digest(), "little") for a, b in zip(offsets[:-1], offsets[1:])], np.uint64)


_LEAST, _SIGN = -(1 << 63), np.uint64(1 << 63)


def _ids(column) -> np.ndarray:
    return np.asarray(column.fill_null(_LEAST))


def _null_marks(column, marks: np.ndarray) -> np.ndarray:
    """Null ids stand as the least number; marks tell the two apart, and put null first."""
    own, null = _ids(column), np.asarray(column.is_null())
    return np.where(own == _LEAST, np.where(null, marks & ~_SIGN, marks | _SIGN), marks)


def _lots(batches, most: int):
    """Neighbouring rows of about ``most`` bytes of text: ids, marks, bytes, offsets."""
    ids, marks, texts, size = [], [], [], 0

    def lot():
        at = np.concatenate([[0], np.cumsum(np.concatenate([np.diff(o) for _, o in texts]))])
        return np.concatenate(ids), np.concatenate(marks), np.concatenate([r for r, _ in texts]), at

    for batch in batches:
        raw, offsets = bytes_of(batch.column("text"))
        own = _ids(batch.column("doc_id"))
        column = batch.column("doc_id")
        at = 0
        while at < batch.num_rows:
            end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + most - size, "right")) - 1)
            part, place = raw[offsets[at] : offsets[end]], offsets[at : end + 1] - offsets[at]
            ids.append(own[at:end])
            marks.append(_null_marks(column.slice(at, end - at), _mark(part, place)))
            texts.append((part, place))
            size += len(part)
            at = end
            if size >= most:
                yield lot()
                ids, marks, texts, size = [], [], [], 0
    if ids:
        yield lot()


def _shards(raw: np.ndarray, offsets: np.ndarray, lot: int):
    """Buffers of up to twice ``lot`` bytes, which overlap by a window less 1 where texts are longer: position of the first
    byte, the bytes, first text, offsets."""
    if len(raw) <= 2 * lot:
        yield 0, raw, 0, offsets
        return
    for at in range(0, len(raw), lot):
        end = min(at + lot + LENGTH - 1, len(raw))
        i, j = int(np.searchsorted(offsets, at, "right")) - 1, int(np.searchsorted(offsets, end, "left"))
        yield at, raw[at:end], i, np.clip(offsets[i : j + 1] - at, 0, end - at)


_KEY = 32  # a key is a document's number and, in so many bits, a place in it


def _to_pieces(buckets: int, shards: Shards, lot: int, reported: int):
    def run(batches):
        for ids, marks, all_raw, all_offsets in _lots(batches, lot):
            for begin, raw, first_text, offsets in _shards(all_raw, all_offsets, lot):
                n = len(offsets) - 1
                one_ids, one_marks, doc = Docs.joined([(ids[first_text : first_text + n], marks[first_text : first_text + n], np.arange(n))])
                base = np.maximum(begin - all_offsets[first_text : first_text + n], 0)  # where a text goes on
                live, late, _ = equal_windows(raw, offsets, (doc << _KEY) + base)
                at, count = _runs(late)
                text = np.searchsorted(offsets, at, "right") - 1
                out = _repeats(one_ids, one_marks, doc[text], base[text] + at - offsets[text], count, shards)
                live &= ~late
                parts = []
                for a in range(0, max(len(raw) - LENGTH + 1, 0), _CHUNK - LENGTH + 1):
                    h, at, count = anchors(raw[a : a + _CHUNK], live[a : a + _CHUNK])
                    parts.append((h, at + a, count))
                if parts:
                    h, at, count = (np.concatenate([x[k] for x in parts]) for k in range(3))
                    text = np.searchsorted(offsets, at, "right") - 1
                    start, of = base[text] + at - offsets[text], doc[text]
                    bucket = ((h >> np.uint64(20)) % np.uint64(buckets)).astype(np.int64)
                    for part, rows in _split(bucket):
                        out.append((part, PIECES, _pack_pieces(one_ids, one_marks, of[rows], h[rows], start[rows], count[rows])))
                    names, many = np.unique((bucket.astype(np.uint64) << np.uint64(32)) | (h >> np.uint64(32)), return_counts=True)
                    # expected counts over all shards are the true ones
                    seed = mix64(np.array([one_ids[0] ^ begin], np.int64).view(np.uint64) ^ one_marks[0])
                    told = many > (mix64(names ^ seed) % np.uint64(reported)).astype(np.int64)
                    if told.any():
                        out.append((-1, COUNTS, pack(names[told], np.maximum(many[told], reported).astype(np.uint32))))
                for i in range(0, len(out), 512):
                    yield _rows(out[i : i + 512])

    return run


# --- groups of blobs -------------------------------------------------------------------------------------------------


def _parts(batches) -> Iterator[tuple[int, list[tuple[int, bytes]]]]:
    """Each part's blobs; rows come sorted by part."""
    part, held = None, []
    for batch in batches:
        for p, kind, blob in zip(batch.column("part").to_pylist(), batch.column("kind").to_pylist(), batch.column("blob").to_pylist(), strict=True):
            if p != part and held:
                yield part, held
                held = []
            part = p
            held.append((kind, blob))
    if held:
        yield part, held


def _dealt(rows: DataFrame, run, schema: str = _ROW_DDL) -> DataFrame:
    return rows.repartition("part").sortWithinPartitions("part", "kind").mapInArrow(run, schema)


def _wanted(ids, marks, doc, part, h, start, count, spread, shards: Shards, piece_shards: int) -> list[tuple[int, int, bytes]]:
    """Rows of kind WANTED: pieces whose bytes are to go to a shard of their anchor, or to one of many by their place."""
    h = (np.uint64(part) << np.uint64(32)) | h  # as the reports name anchors
    salt = mix64(ids[doc].view(np.uint64) ^ mix64(start.astype(np.uint64))) % spread.astype(np.uint64)
    to = (mix64(mix64(h) + salt) % np.uint64(piece_shards)).astype(np.uint32)
    return [
        (part, WANTED, _named(ids, marks, doc[rows], start[rows].astype(np.uint32), count[rows].astype(np.uint8), to[rows], (spread[rows] > 1).astype(np.uint8), h[rows].astype(np.uint32)))
        for part, rows in _split(shards.of(ids[doc], marks[doc]))
    ]


def _resolve(shards: Shards, piece_shards: int, most: int):
    """2: the pieces of each bucket whose anchor several shards have."""

    def run(batches):
        for bucket, blobs in _parts(batches):
            got = [_unpack_pieces(b) for k, b in blobs if k == PIECES]
            if not got:
                continue
            ids, marks, doc = Docs.joined([g[:3] for g in got])
            h, start, count = (np.concatenate([g[k] for g in got]) for k in (3, 4, 5))
            of = np.repeat(np.arange(len(got)), [len(g[3]) for g in got])
            by = np.argsort(h, kind="stable")  # within an anchor by shard
            h, doc, start, count, of = h[by], doc[by], start[by], count[by], of[by]
            edge = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
            size = np.diff(np.concatenate([edge, [len(h)]]))
            contested = np.repeat(of[edge] != of[edge + size - 1], size)
            spread = np.repeat(-(-size // most), size)
            h, doc, start, count, spread = h[contested], doc[contested], start[contested], count[contested], spread[contested]
            out = _wanted(ids, marks, doc, bucket, h, start, count, spread, shards, piece_shards)
            for i in range(0, len(out), 512):
                yield _rows(out[i : i + 512])

    return run


def _hot(found: DataFrame, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Anchors with more than ``most`` pieces by the shards' reports, ascending, and how many; MOST_HOT of them at most."""

    def run(batches):
        for batch in batches:
            for blob in batch.column("blob").to_pylist():
                h, n = unpack(blob)
                yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(n.astype(np.int64))], names=["h", "n"])

    counts = found.where(F.col("kind") == COUNTS).select("blob").mapInArrow(run, "h long, n long").groupBy("h").agg(F.sum("n").alias("n"))
    rows = counts.where(F.col("n") > most).orderBy(F.col("n").desc(), "h").limit(MOST_HOT).toArrow()
    h, n = rows["h"].to_numpy().view(np.uint64), rows["n"].to_numpy()
    by = np.argsort(h)
    return h[by], n[by]


def _spread_ahead(hot: tuple[np.ndarray, np.ndarray], shards: Shards, piece_shards: int, most: int):
    """2: pieces of the anchors that are known to be hot are wanted at once; the others go to their buckets."""
    names, many = hot

    def run(batches):
        for batch in batches:
            out = []
            for part, blob in zip(batch.column("part").to_pylist(), batch.column("blob").to_pylist(), strict=True):
                ids, marks, doc, h, start, count = _unpack_pieces(blob)
                name = (np.uint64(part) << np.uint64(32)) | h
                place = np.minimum(np.searchsorted(names, name), len(names) - 1)
                is_hot = names[place] == name
                if not is_hot.any():
                    out.append((part, PIECES, blob))
                    continue
                spread = np.maximum(-(-many[place] // most), 2)
                rest = ~is_hot
                out += _wanted(ids, marks, doc[is_hot], part, h[is_hot], start[is_hot], count[is_hot], spread[is_hot], shards, piece_shards)
                if rest.any():
                    out.append((part, PIECES, _pack_pieces(ids, marks, doc[rest], h[rest].astype(np.uint64) << np.uint64(32), start[rest], count[rest])))
            yield _rows(out)

    return run


def _to_texts(shards: Shards):
    def run(batches):
        for ids, marks, raw, offsets in _lots(batches, BLOB):
            out = []
            # rows that repeat id and text are sent once, with their number
            by = Docs.order(ids, marks)
            new = np.ones(len(by), bool)
            new[1:] = (ids[by[1:]] != ids[by[:-1]]) | (marks[by[1:]] != marks[by[:-1]])
            once = by[new]
            times = np.diff(np.append(np.flatnonzero(new), len(by)))
            for part, own in _split(shards.of(ids[once], marks[once])):
                rows = once[own]
                sizes = np.diff(offsets)[rows]
                body = np.concatenate([raw[offsets[i] : offsets[i + 1]] for i in rows])
                out.append((part, TEXTS, pack(ids[rows], marks[rows], sizes, body, times[own])))
            yield _rows(out)

    return run


def _slices(raw: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The bytes [start, start + size) of each row, one after the other."""
    ends = np.cumsum(size)
    return raw[np.repeat(start - ends + size, size) + np.arange(int(ends[-1]) if len(ends) else 0)]


def _fetch(batches):
    """2: bytes of the wanted pieces, to their shards."""
    for _, blobs in _parts(batches):
        wanted = [unpack(b) for k, b in blobs if k == WANTED]
        if not wanted:
            continue
        out = []
        # rows that repeat id and text are one document here, whose text is held once
        texts: list[np.ndarray] = []
        seen: dict[tuple[int, int], tuple[int, int]] = {}
        for blob in (b for k, b in blobs if k == TEXTS):
            ids, marks, sizes, body, _ = unpack(blob)
            before = len(seen)
            for i, m, a in zip(ids.tolist(), marks.tolist(), (np.cumsum(sizes) - sizes).tolist()):
                seen.setdefault((i, m), (len(texts), a))
            if len(seen) > before:
                texts.append(body)
        ids, marks, doc = Docs.joined([(g[0], g[1], g[2]) for g in wanted])
        start, count, to, spread, group = (np.concatenate([g[k] for g in wanted]) for k in (3, 4, 5, 6, 7))
        place = np.array([seen[k] for k in zip(ids.tolist(), marks.tolist())], np.int64)
        size = count.astype(np.int64) + LENGTH - 1
        for t in np.unique(place[:, 0]):
            rows = np.flatnonzero(place[doc, 0] == t)
            for part, own in _split(to[rows].astype(np.int64)):
                r = rows[own]
                body = _slices(texts[t], place[doc[r], 1] + start[r], size[r])
                out.append((part, FETCHED, _named(ids, marks, doc[r], start[r], count[r], spread[r], group[r], body)))
        for i in range(0, len(out), 256):
            yield _rows(out[i : i + 256])


def _classes(shards: Shards, ranges: int, lot: int):
    """3: suffix arrays of the pieces of each bucket, of about LOT bytes; an anchor's pieces are in one."""

    def run(batches):
        for _, blobs in _parts(batches):
            got = [unpack(b) for _, b in blobs]
            ids, marks, doc = Docs.joined([(g[0], g[1], g[2]) for g in got])
            start, count, spread, group, body = (np.concatenate([g[k] for g in got]) for k in (3, 4, 5, 6, 7))
            start, size = start.astype(np.int64), count.astype(np.int64) + LENGTH - 1
            at = np.cumsum(size) - size
            keep, late = _equal_pieces(body, at, size, (doc << _KEY) + start)
            out = _repeats(ids, marks, doc[late], start[late], count[late], shards)
            for i in range(0, len(out), 512):
                yield _rows(out[i : i + 512])
            by = keep[np.argsort(group[keep], kind="stable")]
            ends = np.cumsum(size[by])
            a = 0
            while a < len(by):
                b = int(np.searchsorted(ends, (ends[a - 1] if a else 0) + lot, "right"))
                b = max(b, a + 1)
                while b < len(by) and group[by[b]] == group[by[b - 1]]:
                    b += 1
                out = _merged_pieces(ids, marks, doc, start, size, at, spread, body, by[a:b], shards, ranges)
                for i in range(0, len(out), 512):
                    yield _rows(out[i : i + 512])
                a = b

    return run


_LONGEST = 2 * LENGTH - GRAM  # bytes of a piece at most


def _equal_pieces(body, at, size, key) -> tuple[np.ndarray, np.ndarray]:
    """Of pieces in one buffer, sorted as strings: those that no equal one precedes by key, and those that one does.
    Pieces of one key and equal bytes are one."""
    places = at[:, None] + np.minimum(np.arange(_LONGEST), (size - 1)[:, None])
    strings = np.ones((len(at), _LONGEST + 2), np.uint8)
    strings[:, :_LONGEST] = body[places]
    strings[:, :_LONGEST][np.arange(_LONGEST) >= size[:, None]] = 0
    strings[:, _LONGEST] = size  # beside the last byte, which keeps zeros at the end
    strings = strings.view(f"S{_LONGEST + 2}").ravel()
    by = np.argsort(strings, kind="stable")
    new = np.ones(len(by), bool)
    new[1:] = strings[by[1:]] != strings[by[:-1]]
    group = np.cumsum(new) - 1
    least = np.minimum.reduceat(key[by], np.flatnonzero(new)) if len(by) else key
    own = key[by] == least[group]
    seen = np.flatnonzero(own)
    _, once = np.unique(group[seen], return_index=True)  # of twins one
    return by[seen[once]], by[~own]


def _merged_pieces(ids, marks, doc, start, size, at, spread, body, rows, shards: Shards, ranges: int) -> list[tuple[int, int, bytes]]:
    """REPEATS among the pieces of these rows, and RUNS of the firsts of spread anchors."""
    raw = _slices(body, at[rows], size[rows])
    offsets = np.concatenate([[0], np.cumsum(size[rows])])
    live, late, order = equal_windows(raw, offsets, (doc[rows] << _KEY) + start[rows])
    first, count = _runs(late)
    own = np.searchsorted(offsets, first, "right") - 1
    out = _repeats(ids, marks, doc[rows[own]], start[rows[own]] + first - offsets[own], count, shards)
    if spread[rows].any():
        order = order[live[order] & ~late[order]]
        own = np.searchsorted(offsets, order, "right") - 1
        hot = spread[rows[own]] > 0
        order, own = order[hot], own[hot]
        windows = raw[order[:, None] + np.arange(LENGTH)]
        with np.errstate(over="ignore"):
            to = mix64((_BYTE[windows] * _powers(_MULT, LENGTH)).sum(axis=1, dtype=np.uint64)) % np.uint64(ranges)
        for part, r in _split(to.astype(np.int64)):
            out.append((part, RUNS, _named(ids, marks, doc[rows[own[r]]], start[rows[own[r]]] + order[r] - offsets[own[r]], windows[r].ravel())))
    return out


def _in_order(windows: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A run without the windows that one has twice: its windows, the least key of each, and the other keys."""
    if not len(windows):
        return windows, keys, keys
    new = np.concatenate([[True], windows[1:] != windows[:-1]])
    least = np.minimum.reduceat(keys, np.flatnonzero(new))
    return windows[new], least, keys[keys != least[np.cumsum(new) - 1]]


def merge_runs(runs: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """Keys of all windows that occur with a smaller key. runs: windows in suffix order as fixed strings, and keys. Two
    runs at a time are merged: each window of one is looked up in the other by binary search."""
    late, ready = [], []
    for windows, keys in runs:
        windows, keys, rest = _in_order(windows, keys)
        ready.append((windows, keys))
        late.append(rest)
    while len(ready) > 1:
        ahead = []
        for (x, kx), (y, ky) in zip(ready[::2], ready[1::2], strict=False):
            at = np.searchsorted(x, y)
            held = np.minimum(at, max(len(x) - 1, 0))
            hit = (at < len(x)) & (x[held] == y) if len(x) else np.zeros(len(y), bool)
            a, b = kx[held[hit]], ky[hit]
            late.append(np.maximum(a, b)[a != b])
            kx = kx.copy()
            kx[held[hit]] = np.minimum(a, b)
            ahead.append((np.insert(x, at[~hit], y[~hit]), np.insert(kx, at[~hit], ky[~hit])))
        ready = ahead + (ready[-1:] if len(ready) % 2 else [])
    return np.concatenate(late) if late else np.zeros(0, np.int64)


def _strings(body: np.ndarray) -> np.ndarray:
    """Windows as strings of fixed size; a last byte keeps zeros at their ends."""
    out = np.ones((len(body) // LENGTH, LENGTH + 1), np.uint8)
    out[:, :LENGTH] = body.reshape(-1, LENGTH)
    return out.view(f"S{LENGTH + 1}").ravel()


def _merge(shards: Shards):
    """4: runs whose windows have hashes in common, merged: all but the first of equal windows are repeats."""

    def run(batches):
        for _, blobs in _parts(batches):
            got = [unpack(b) for _, b in blobs]
            ids, marks, doc = Docs.joined([(g[0], g[1], g[2]) for g in got])
            start = np.concatenate([g[3] for g in got])
            cuts = np.cumsum([0, *(len(g[3]) for g in got)])
            keys = (doc << _KEY) + start
            late = np.unique(merge_runs([(_strings(g[4]), keys[a:b]) for g, a, b in zip(got, cuts, cuts[1:])]))
            out = _repeats(ids, marks, late >> _KEY, late & ((1 << _KEY) - 1), np.ones(len(late), np.int64), shards)
            if out:
                yield _rows(out)

    return run


_DIGEST = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string())])
_KEPT = pa.schema([("doc_id", pa.int64()), ("kept", pa.binary()), ("spans", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))])


def _painted(whole: bool):
    """5: each document with its repeats; ``whole``: the bytes left and the spans, else their digest."""

    def run(batches):
        for _, blobs in _parts(batches):
            gone = [unpack(b) for k, b in blobs if k == REPEATS]
            runs: dict[tuple[int, int], tuple[np.ndarray, np.ndarray]] = {}
            if gone:
                ids, marks, doc = Docs.joined([(g[0], g[1], g[2]) for g in gone])
                start, count = (np.concatenate([g[k] for g in gone]).astype(np.int64) for k in (3, 4))
                names = list(zip(ids.tolist(), marks.tolist()))
                for d, rows in _split(doc):
                    runs[names[d]] = (start[rows], start[rows] + count[rows] + LENGTH - 1)
            for kind, blob in blobs:
                if kind != TEXTS:
                    continue
                ids, marks, sizes, body, times = unpack(blob)
                ends = np.cumsum(sizes)
                out = []
                for i, m, a, b, n in zip(ids.tolist(), marks.tolist(), (ends - sizes).tolist(), ends.tolist(), times.tolist()):
                    text, spans = body[a:b], np.zeros((0, 2), np.int64)
                    if (i, m) in runs:
                        edge = np.zeros(b - a + 1, np.int32)
                        np.add.at(edge, runs[i, m][0], 1)
                        np.add.at(edge, runs[i, m][1], -1)
                        cover = np.concatenate([[False], np.cumsum(edge[:-1]) > 0, [False]])
                        spans = np.flatnonzero(cover[1:] != cover[:-1]).reshape(-1, 2)
                        text = text[~cover[1:-1]]
                    doc_id = None if i == _LEAST and m < 1 << 63 else i
                    if whole:
                        row = {"doc_id": doc_id, "kept": text.tobytes(), "spans": [{"start": int(x), "end": int(y)} for x, y in spans]}
                    else:
                        row = {"doc_id": doc_id, "n_bytes": b - a, "n_removed": int((spans[:, 1] - spans[:, 0]).sum()), "n_spans": len(spans), "kept_sha256": hashlib.sha256(text.tobytes()).hexdigest()}
                    out += [row] * n
                yield pa.RecordBatch.from_pylist(out, _KEPT if whole else _DIGEST)

    return run


def dedup(docs: DataFrame, whole: bool = False, most: int = SHARD_PIECES, lot: int = LOT, reported: int = REPORTED, wide: int = SHARD) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256; or, with ``whole``, doc_id, kept (bytes) and spans (in bytes).
    ``most``: pieces of one anchor that one shard takes; ``lot``: bytes of a suffix array; ``reported``: pieces of an
    anchor that a shard always tells of; ``wide``: bytes of text beyond which an id's texts are spread."""
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    sizes = settle(docs.groupBy(F.coalesce("doc_id", F.lit(_LEAST)).alias("i")).agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("b")), "repeats-sizes")
    total = sizes.agg(F.coalesce(F.sum("b"), F.lit(0))).first()[0]
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // SHARD))
    # ids of more than a shard's text are fewer than shards
    shards = Shards(parts, np.sort(sizes.where(F.col("b") > wide).select("i").toArrow()["i"].to_numpy()))
    found = settle(docs.mapInArrow(_to_pieces(parts, shards, lot, reported), _ROW_DDL), "repeats-pieces")
    pieces = found.where(F.col("kind") == PIECES)
    hot = _hot(found, most)
    ahead = None
    if len(hot[0]):
        split = settle(pieces.mapInArrow(_spread_ahead(hot, shards, parts, most), _ROW_DDL), "repeats-spread")
        pieces, ahead = split.where(F.col("kind") == PIECES), split.where(F.col("kind") == WANTED)
    wanted = _dealt(pieces, _resolve(shards, parts, most))
    wanted = wanted if ahead is None else wanted.unionAll(ahead)
    texts = docs.mapInArrow(_to_texts(shards), _ROW_DDL)
    fetched = _dealt(texts.unionAll(wanted), _fetch)
    classes = settle(_dealt(fetched, _classes(shards, parts, lot)), "repeats-classes")
    gone = found.where(F.col("kind") == REPEATS).unionAll(classes.where(F.col("kind") == REPEATS))
    runs = classes.where(F.col("kind") == RUNS)
    if not runs.isEmpty():
        gone = gone.unionAll(_dealt(runs, _merge(shards)))
    schema = "doc_id long, kept binary, spans array<struct<start:long,end:long>>" if whole else "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"
    return _dealt(texts.unionAll(gone), _painted(whole), schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup(spread(table(spark, sf_dir, "documents").select("doc_id", "text")))


SQL = """
WITH d AS (
  SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents
), w AS (
  SELECT doc_id, p, substr(h, 2 * p + 1, 200) AS s FROM (SELECT doc_id, h, unnest(range(0, length(h) // 2 - 99)) AS p FROM d)
), r AS (
  SELECT doc_id, p FROM (SELECT doc_id, p, row_number() OVER (PARTITION BY s ORDER BY doc_id, p) AS n FROM w) WHERE n > 1
), f AS (
  SELECT doc_id, p, CASE WHEN p - lag(p) OVER (PARTITION BY doc_id ORDER BY p) <= 100 THEN 0 ELSE 1 END AS fresh FROM r
), i AS (
  SELECT doc_id, min(p) AS a, max(p) + 100 AS b FROM (SELECT *, sum(fresh) OVER (PARTITION BY doc_id ORDER BY p) AS island FROM f) GROUP BY doc_id, island
), k AS (
  SELECT doc_id, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS x, a AS y FROM i
  UNION ALL SELECT d.doc_id, coalesce(max(i.b), 0), any_value(length(h)) // 2 FROM d LEFT JOIN i USING (doc_id) GROUP BY d.doc_id
), t AS (
  SELECT k.doc_id, string_agg(substr(h, 2 * x + 1, 2 * (y - x)), '' ORDER BY x) AS kept FROM k JOIN d USING (doc_id) GROUP BY k.doc_id
), s AS (
  SELECT doc_id, CAST(sum(b - a) AS BIGINT) AS n_removed, count(*) AS n_spans FROM i GROUP BY doc_id
)
SELECT d.doc_id, CAST(length(h) // 2 AS BIGINT) AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans,
  sha256(unhex(kept)) AS kept_sha256
FROM d JOIN t USING (doc_id) LEFT JOIN s USING (doc_id)
"""
