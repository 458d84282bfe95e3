"""A hidden Markov language model of words: Baum-Welch over all partitions, exact likelihoods by scaled forward recursion.

A text's tokens are its words, A-Z in lower case, and an end. A state emits symbols. The OWN most frequent words are symbols
of their own; each other word belongs to one of CLASSES symbols, by its length and last two bytes, and is drawn from its
class by the words' smoothed counts, with a share for words that were never seen. So every text has a positive
probability, and those of the words of a class (seen ones and one unseen) sum to one.

1. Words are counted over all training texts; the counts stay a table. At most FREQUENT of the most frequent words (a bounded
   table) go to all tasks, for all other words a text asks the counts by join: none of them has much more than a FREQUENT-th
   of all tokens.
2. Texts become symbols, two bytes a token, and are written once.
3. Baum-Welch: every round goes through all symbols of all training texts; tasks sum their expected counts, Spark adds these
   up by symbol, and the bounded tables of the next round (STATES numbers a symbol) come back. The point to start from is
   the model that fits the neighbours of all training texts: how often each symbol stands before each of CONTEXTS groups of
   symbols is counted over all of them (a bounded table), and rounds on that table are enough.
4. Texts run side by side, in order of length. Those over LONG tokens are cut into pieces; the product of each piece's
   transitions, from every state at once, gives what every piece begins (and ends) with, so the recursions are exact.

Defined cases: null texts are empty; an empty text has one token, its end; a null id has the fold of an empty text; rows
that repeat count and are scored each; without training texts the base score is 0 and all symbols are equally likely; an
empty table gives no rows. In tasks, words are told apart by 64-bit hashes: among a
billion different words two that share one are to be expected with probability 0.03.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bytes_of, mix64, settle, spread, table, text_or_empty

STATES = 8
#: Words with a symbol of their own; classes of the others; words whose counts are sent to all tasks.
OWN, CLASSES, FREQUENT = 8192, 2048, 1 << 16
END_SYMBOL = OWN + CLASSES
SYMBOLS = END_SYMBOL + 1
#: Rounds over all training texts, after so many on the table of neighbours; the table's groups of symbols: frequent words, the
#: other words with symbols, groups of classes, the end.
ROUNDS, START_ROUNDS = 2, 100
CONTEXTS, CONTEXT_WORDS = 128, 95
#: Added to a count: the contract's base, and the share of the whole corpus's distribution in each state's.
ADDED, PRIOR = 0.1, 20.0
#: Tokens of a text that are run through at a time, and of all texts side by side.
LONG, SIDE_BY_SIDE = 8192, 1 << 19
_PIECE = 1 << 19
_END = np.uint64(0x5851F42D4C957F2D)
_IS_WORD = np.ones(256, bool)
_IS_WORD[[9, 10, 11, 12, 13, 32]] = False
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BASE = 0x9E3779B97F4A7C15
#: A number a byte; white space has 0.
_VALUE = np.where(_IS_WORD, mix64(_LOWER.astype(np.uint64) + np.uint64(77)), np.uint64(0))
_kept = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the base and of its inverse, modulo 2 ** 64."""
    if len(_kept[0]) < n:
        for k, x in enumerate((_BASE, pow(_BASE, -1, 1 << 64))):
            table = np.ones(n, np.uint64)
            with np.errstate(over="ignore"):
                np.multiply.accumulate(np.full(n - 1, x, np.uint64), out=table[1:])
            _kept[k] = table
    return _kept[0], _kept[1]


def tokens(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash and class of each word of each text, A-Z in lower case, and the text it is in. A word's hash is the polynomial
    of its bytes: that of its place among all bytes, brought to place 0 by the inverse power."""
    if not len(raw):
        return np.zeros(0, np.uint64), np.zeros(0, np.int16), np.zeros(0, np.int64)
    inside = _IS_WORD[raw]
    step = np.flatnonzero(inside[1:] != inside[:-1]) + 1
    edges = np.concatenate([[0] if inside[0] else [], step, [len(raw)] if inside[-1] else []]).astype(np.int64)
    starts, ends = edges[0::2], edges[1::2]
    inner = offsets[1:-1]
    inner = inner[(inner > 0) & (inner < len(raw))]
    inner = np.unique(inner[inside[inner] & inside[inner - 1]])  # a word doesn't go on into the next text
    if len(inner):
        starts, ends = np.sort(np.concatenate([starts, inner])), np.sort(np.concatenate([ends, inner]))
    if not len(starts):
        return np.zeros(0, np.uint64), np.zeros(0, np.int16), np.zeros(0, np.int64)
    hashes = np.empty(len(starts), np.uint64)
    i = 0
    while i < len(starts):  # some words at a time, so that the powers' table is as long as these or the longest word
        j = max(i + 1, int(np.searchsorted(ends, starts[i] + (1 << 20), "right")))
        a, b = int(starts[i]), int(ends[j - 1])
        up, down = _powers(max(1 << 20, b - a))
        with np.errstate(over="ignore"):
            value = _VALUE[raw[a:b]]
            value *= up[: b - a]
            hashes[i:j] = np.add.reduceat(value, starts[i:j] - a) * down[starts[i:j] - a]
        i = j
    length = ends - starts
    last = _LOWER[raw[ends - 1]].astype(np.uint64)
    before = np.where(length > 1, _LOWER[raw[np.maximum(ends - 2, 0)]], 0).astype(np.uint64)
    kind = mix64((np.minimum(length, 15).astype(np.uint64) << np.uint64(16)) | (before << np.uint64(8)) | last)
    return mix64(hashes), (kind % np.uint64(CLASSES)).astype(np.int16), np.searchsorted(offsets, starts, "right") - 1


def _slices(batch: pa.RecordBatch):
    """(first row, end row, bytes, offsets) of a batch's texts, some half megabyte at a time."""
    raw, offsets = bytes_of(batch.column("text"))
    at = 0
    while at < batch.num_rows:
        end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + _PIECE, "right")) - 1)
        yield at, end, raw[offsets[at] : offsets[end]], offsets[at : end + 1] - offsets[at]
        at = end


def _merged(parts: list[tuple]) -> tuple:
    hashes, kinds, counts = (np.concatenate(x) for x in zip(*parts, strict=True))
    found, first, back = np.unique(hashes, return_index=True, return_inverse=True)
    return found, kinds[first], np.bincount(back, counts, len(found)).astype(np.int64)


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """hash, class, count of the words of a task's training texts."""

    def out(parts):
        found, kinds, counts = _merged(parts)
        return pa.RecordBatch.from_arrays([pa.array(found.view(np.int64)), pa.array(kinds), pa.array(counts)], names=["hash", "kind", "c"])

    held: list[tuple] = []
    size = 0
    for batch in batches:
        ends = batch.num_rows
        held.append((np.array([_END]), np.array([-1], np.int16), np.array([ends])))
        for _, _, raw, offsets in _slices(batch):
            h, kinds, _ = tokens(raw, offsets)
            if len(h):
                held.append(_merged([(h, kinds, np.ones(len(h), np.int64))]))
                size += len(held[-1][0])
            if size > 1 << 20:
                held = [_merged(held)]
                if len(held[0][0]) > 1 << 19:
                    yield out(held)
                    held = []
                size = len(held[0][0]) if held else 0
    if held:
        yield out(held)


class Words:
    """The frequent words: sorted hashes with counts and symbols; totals of all words and of each class."""

    def __init__(self, hashes: np.ndarray, counts: np.ndarray, kinds: np.ndarray, total: int, distinct: int, class_counts: np.ndarray, class_words: np.ndarray, ends: int):
        by = np.argsort(-counts, kind="stable")
        symbol = np.where(np.arange(len(by)) < OWN, np.arange(len(by)), OWN + kinds[by])
        order = np.argsort(hashes[by])
        self.hashes, self.counts, self.symbol = hashes[by][order], counts[by][order], symbol[order].astype(np.int16)
        self.total, self.distinct, self.ends = total, distinct, ends
        self.class_log = np.log10(class_counts + ADDED * (class_words + 1))
        self.base_log = np.log10(total + ADDED * (distinct + 1))
        symbols = np.zeros(SYMBOLS)
        symbols[: min(len(by), OWN)] = counts[by][:OWN]
        symbols[OWN:END_SYMBOL] = class_counts
        symbols[END_SYMBOL] = ends
        self.prior = (symbols + ADDED) / (symbols + ADDED).sum()

    def look(self, hashes: np.ndarray, kinds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Symbols, and counts (-1: not among the frequent)."""
        if not len(self.hashes):
            return OWN + kinds, np.full(len(hashes), -1, np.int64)
        at = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
        here = self.hashes[at] == hashes
        return np.where(here, self.symbol[at], OWN + kinds).astype(np.int16), np.where(here, self.counts[at], -1)


def count_words(texts: DataFrame) -> tuple[DataFrame, Words]:
    """The table of counts (hash, kind, c) of all words, and what tasks get of it. texts: text."""
    pieces = texts.mapInArrow(_counted, "hash long, kind short, c long")
    counts = settle(pieces.groupBy("hash").agg(F.min("kind").alias("kind"), F.sum("c").alias("c")), "hmm-counts")
    total, distinct, ends = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count(F.lit(1)), F.coalesce(F.sum(F.when(F.col("kind") == -1, F.col("c"))), F.lit(0))).first()
    # the words of the highest classes of counts, an eighth of an octave each, as long as they are no more than FREQUENT
    octave = F.floor(8 * F.log2("c")).cast("int").alias("octave")
    least, room = 1 << 30, FREQUENT
    for r in sorted(counts.where("kind >= 0").groupBy(octave).agg(F.count(F.lit(1)).alias("n")).collect(), reverse=True):  # some hundreds
        room -= r.n
        if room < 0:
            break
        least = r.octave
    top = counts.where("kind >= 0").where(octave >= least).toArrow().sort_by([("c", "descending"), ("hash", "ascending")])  # at most FREQUENT rows of 18 bytes
    hashes, kinds, c = np.asarray(top["hash"]).view(np.uint64), np.asarray(top["kind"]), np.asarray(top["c"])
    class_counts, class_words = np.zeros(CLASSES), np.zeros(CLASSES)
    for r in counts.where("kind >= 0").groupBy("kind").agg(F.sum("c").alias("c"), F.count(F.lit(1)).alias("n")).collect():  # at most CLASSES rows
        class_counts[r.kind], class_words[r.kind] = r.c, r.n
    np.subtract.at(class_counts, kinds[:OWN], c[:OWN])  # words with symbols of their own are in no class
    np.subtract.at(class_words, kinds[:OWN], 1)
    return counts, Words(hashes, c, kinds, total, distinct, class_counts, class_words, ends)


_CODED = [("row", pa.int64()), ("symbols", pa.binary()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("base", pa.float64()), ("inner", pa.float64()), ("rare", pa.list_(pa.int64())), ("times", pa.list_(pa.int32()))]
_CODED_DDL = "row long, symbols binary, n_tokens long, n_known long, base double, inner double, rare array<long>, times array<int>"


def _coded(known: Words, names: list[str]):
    """The given columns of each text with its symbols; sums over its frequent words; its other words and how often it
    has them. ``base`` and ``inner`` lack only log10(count + ADDED) of the other words."""

    def run(batches):
        from pyspark import TaskContext

        row = TaskContext.get().partitionId() << 33
        for batch in batches:
            for a, b, raw, offsets in _slices(batch):
                n = b - a
                h, kinds, of = tokens(raw, offsets)
                symbol, counts = known.look(h, kinds)
                size = np.bincount(of, minlength=n)
                firsts = np.concatenate([[0], np.cumsum(size)])
                seen = counts >= 0
                logs = np.where(seen, np.log10(np.maximum(counts, 0) + ADDED), 0)
                base = np.bincount(of, logs, n) + np.log10(known.ends + ADDED) - (size + 1) * known.base_log
                shared = symbol >= OWN
                inner = np.bincount(of[shared], logs[shared] - known.class_log[symbol[shared] - OWN], n) if shared.any() else np.zeros(n)
                n_known = np.bincount(of[seen], minlength=n) + (known.ends > 0)
                rare, rare_of = h[~seen], of[~seen]
                by = np.lexsort((rare, rare_of))
                rare, rare_of = rare[by], rare_of[by]
                new = np.flatnonzero(np.concatenate([[True], (rare[1:] != rare[:-1]) | (rare_of[1:] != rare_of[:-1])])) if len(rare) else np.zeros(0, np.int64)
                times = np.diff(np.append(new, len(rare))).astype(np.int32)
                edges = pa.array(np.searchsorted(rare_of[new], np.arange(n + 1)).astype(np.int32))
                whole = symbol.astype("<i2")
                end = np.array([END_SYMBOL], "<i2").tobytes()
                cells = [
                    pa.array(np.arange(row, row + n)), pa.array([whole[firsts[i] : firsts[i + 1]].tobytes() + end for i in range(n)], pa.binary()), pa.array(size.astype(np.int64) + 1), pa.array(n_known.astype(np.int64)),
                    pa.array(base), pa.array(inner), pa.ListArray.from_arrays(edges, pa.array(rare[new].view(np.int64))), pa.ListArray.from_arrays(edges, pa.array(times)),
                ]
                row += n
                part = batch.select(names).slice(a, n)
                yield pa.RecordBatch.from_arrays([*part.columns, *cells], names=[*names, *(c for c, _ in _CODED)])

    return run


class Model:
    """start (STATES), step (STATES, STATES) and emit (SYMBOLS, STATES), rows and columns that sum to one."""

    def __init__(self, start: np.ndarray, step: np.ndarray, emit: np.ndarray):
        self.start, self.step, self.emit, self.by_state = start, step, emit, np.ascontiguousarray(emit.T)

    @classmethod
    def random(cls, prior: np.ndarray, seed: int = 5) -> Model:
        r = np.random.default_rng(seed)
        emit = prior[:, None] * r.gamma(2.0, size=(len(prior), STATES))
        stay = np.full((STATES, STATES), 0.1 / max(STATES - 1, 1))
        np.fill_diagonal(stay, 0.9 if STATES > 1 else 1.0)
        return cls(np.full(STATES, 1 / STATES), stay, emit / emit.sum(axis=0))


class Counts:
    """Expected counts of starts, steps and emissions, and the log-likelihood."""

    def __init__(self):
        self.start, self.step, self.emit, self.log = np.zeros(STATES), np.zeros((STATES, STATES)), np.zeros((SYMBOLS, STATES)), 0.0

    def model(self, prior: np.ndarray) -> Model:
        emit = self.emit + PRIOR * prior[:, None]
        step, start = self.step + 1e-3, self.start + 1e-3
        return Model(start / start.sum(), step / step.sum(axis=1, keepdims=True), emit / emit.sum(axis=0))


def forward(model: Model, side: np.ndarray, lengths: np.ndarray, begin: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Scaled forward recursion through texts side by side. side: (steps, texts) symbols, the texts in order of falling
    length; begin: (texts, STATES) what the first token's states are drawn from. Gives (steps, STATES, texts) the states
    after each token, scaled to sum one, the scales (steps, texts), and how many texts are longer than each step."""
    steps, n = side.shape
    states, scales = np.zeros((steps, STATES, n)), np.ones((steps, n))
    alive = np.searchsorted(-lengths, -np.arange(steps), "left").tolist()
    step, emit, ones = np.ascontiguousarray(model.step.T), model.by_state, np.ones(STATES)
    for t in range(steps):
        m = alive[t]
        a = emit.take(side[t, :m], axis=1, mode="clip")
        a *= begin.T if t == 0 else step @ states[t - 1, :, :m]
        s = ones @ a
        np.divide(a, s, out=states[t, :, :m])
        scales[t, :m] = s
    return states, scales, alive


def expect(model: Model, side: np.ndarray, lengths: np.ndarray, begin: np.ndarray, finish: np.ndarray, fresh: np.ndarray, got: Counts) -> None:
    """Adds the expected counts of texts side by side. finish: (texts, STATES) the likelihood of what follows the last
    token, given its state, at any scale. fresh: where a text begins anew (elsewhere it goes on from a piece before)."""
    steps, n = side.shape
    states, scales, alive = forward(model, side, lengths, begin)
    step, rest, back, emit = np.zeros((STATES, STATES)), finish.T, np.ones((STATES, n)), model.by_state
    for t in range(steps - 1, -1, -1):
        m, on = alive[t], alive[t + 1] if t + 1 < steps else 0
        now = states[t, :, :m]
        if on:  # what comes back from the next token
            seen = emit.take(side[t + 1, :on], axis=1, mode="clip")
            seen *= back[:, :on]
            seen /= scales[t + 1, :on]
            step += now[:, :on] @ seen.T
            np.matmul(model.step, seen, out=back[:, :on])
        if m > on:  # texts whose last token this is
            back[:, on:m] = rest[:, on:m] / (now[:, on:] * rest[:, on:m]).sum(axis=0)
        now *= back[:, :m]  # from here on the weights of states, given the whole text
    got.step += step * model.step
    got.start += states[0][:, fresh].sum(axis=1)
    used = np.arange(steps)[:, None] < lengths[None, :]
    flat = side[used]
    for k in range(STATES):
        got.emit[:, k] += np.bincount(flat, states[:, k][used], SYMBOLS)
    got.log += float(np.log(scales).sum())


def _side_by_side(parts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(steps, texts) symbols in order of falling length, the lengths and the order."""
    lengths = np.array([len(p) for p in parts])
    order = np.argsort(-lengths, kind="stable")
    side = np.zeros((int(lengths.max()), len(parts)), np.int64)
    for i, j in enumerate(order):
        side[: lengths[j], i] = parts[j]
    return side, lengths[order], order


def _lots(sizes: np.ndarray) -> list[np.ndarray]:
    """Texts of like length together, SIDE_BY_SIDE tokens at a time."""
    out, now, most = [], [], 0
    for i in np.argsort(-sizes, kind="stable"):
        most = most or sizes[i]
        if now and most * (len(now) + 1) > SIDE_BY_SIDE:
            out.append(np.array(now))
            now, most = [], sizes[i]
        now.append(i)
    if now:
        out.append(np.array(now))
    return out


def _cut(model: Model, text: np.ndarray, both: bool) -> tuple[float, list[np.ndarray], np.ndarray, np.ndarray, np.ndarray]:
    """A long text's log-likelihood, its pieces, what each begins with and (``both``) is followed by, and the expected
    counts of the steps between pieces."""
    size = max(64, min(LONG, int(len(text) ** 0.5) * 2))
    pieces = [text[i : i + size] for i in range(0, len(text), size)]
    begin, follow, cross = np.zeros((len(pieces), STATES)), np.ones((len(pieces), STATES)), np.zeros((STATES, STATES))
    per = max(1, SIDE_BY_SIDE // (size * STATES))
    ends, logs = np.zeros((len(pieces), STATES, STATES)), np.zeros((len(pieces), STATES))
    for a in range(0, len(pieces), per):  # each piece from every state at once
        lot = pieces[a : a + per]
        side, lengths, order = _side_by_side([p for p in lot for _ in range(STATES)])
        states, scales, _ = forward(model, side, lengths, np.tile(np.eye(STATES), (len(lot), 1))[order])
        i, k = np.divmod(order, STATES)
        ends[a + i, k], logs[a + i, k] = states[lengths - 1, :, np.arange(len(order))], np.log(scales).sum(axis=0)
    total, now, last = 0.0, model.start, []
    for i in range(len(pieces)):
        begin[i] = now
        top = logs[i].max()
        after = (now * np.exp(logs[i] - top)) @ ends[i]
        s = after.sum()
        total += float(np.log(s) + top)
        last.append(after / s)
        now = last[-1] @ model.step
    if both:
        for i in range(len(pieces) - 1, 0, -1):
            seen = np.exp(logs[i] - logs[i].max()) * (ends[i] @ follow[i])  # by the state of the piece's first token
            step = last[i - 1][:, None] * model.step * seen
            cross += step / step.sum()
            after = model.step @ seen
            follow[i - 1] = after / after.sum()
    return total, pieces, begin, follow, cross


def loglikelihoods(model: Model, texts: list[np.ndarray]) -> np.ndarray:
    """Natural logs of the texts' probabilities."""
    out = np.zeros(len(texts))
    sizes = np.array([len(t) for t in texts])
    short = np.flatnonzero(sizes <= LONG)
    for lot in _lots(sizes[short]):
        rows = short[lot]
        side, lengths, order = _side_by_side([texts[i] for i in rows])
        out[rows[order]] = np.log(forward(model, side, lengths, np.tile(model.start, (len(rows), 1)))[1]).sum(axis=0)
    for i in np.flatnonzero(sizes > LONG):
        out[i] = _cut(model, texts[i], False)[0]
    return out


def gather(model: Model, texts: list[np.ndarray], got: Counts) -> None:
    """Adds the texts' expected counts."""
    sizes = np.array([len(t) for t in texts])
    short = np.flatnonzero(sizes <= LONG)
    for lot in _lots(sizes[short]):
        side, lengths, _ = _side_by_side([texts[i] for i in short[lot]])
        n = len(lot)
        expect(model, side, lengths, np.tile(model.start, (n, 1)), np.ones((n, STATES)), np.ones(n, bool), got)
    for i in np.flatnonzero(sizes > LONG):
        total, pieces, begin, follow, cross = _cut(model, texts[i], True)
        before = got.log
        for lot in _lots(np.array([len(p) for p in pieces])):
            side, lengths, order = _side_by_side([pieces[j] for j in lot])
            rows = lot[order]
            expect(model, side, lengths, begin[rows], follow[rows], rows == 0, got)
        got.log = before + total
        got.step += cross


#: Tokens that a task holds before it runs through them.
_HELD = 1 << 20


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Table, list[np.ndarray]]]:
    """Some batches at a time, and their symbols."""
    held, size = [], 0
    for batch in batches:
        for i in range(0, batch.num_rows, 1024):
            held.append(batch.slice(i, 1024))
            size += held[-1].column("symbols").nbytes // 2
            if size >= _HELD:
                yield _opened(held)
                held, size = [], 0
    if held:
        yield _opened(held)


def _opened(held: list[pa.RecordBatch]) -> tuple[pa.Table, list[np.ndarray]]:
    t = pa.Table.from_batches(held)
    return t, [np.frombuffer(x.as_buffer(), "<i2") for c in t["symbols"].chunks for x in c]


_NUMBERS = [f"k{i}" for i in range(STATES)]


def _expected(model: Model):
    """A task's counts: a row a symbol, then one a state's steps, the starts and the log-likelihood."""

    def run(batches):
        got = Counts()
        for _, texts in _texts(batches):
            gather(model, texts, got)
        rest = np.zeros((2, STATES))
        rest[0], rest[1, 0] = got.start, got.log
        every = np.concatenate([got.emit, got.step, rest])
        used = np.flatnonzero(every.any(axis=1))
        yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), *(pa.array(every[used, k]) for k in range(STATES))], names=["symbol", *_NUMBERS])

    return run


def baum_welch(coded: DataFrame, model: Model) -> Counts:
    """One round over all texts of coded (symbols)."""
    parts = coded.select("symbols").mapInArrow(_expected(model), "symbol int, " + ", ".join(f"{c} double" for c in _NUMBERS))
    t = parts.groupBy("symbol").agg(*[F.sum(c).alias(c) for c in _NUMBERS]).toArrow()  # a row a symbol, and some more
    every = np.zeros((SYMBOLS + STATES + 2, STATES))
    every[np.asarray(t["symbol"])] = np.stack([np.asarray(t[c]) for c in _NUMBERS], axis=1)
    got = Counts()
    got.emit, got.step, got.start, got.log = every[:SYMBOLS], every[SYMBOLS : SYMBOLS + STATES], every[-2], float(every[-1, 0])
    return got


def _contexts() -> np.ndarray:
    """Each symbol's group, as the one after another."""
    symbol = np.arange(SYMBOLS)
    group = np.minimum(symbol, CONTEXT_WORDS)
    group[OWN:] = CONTEXT_WORDS + 1 + symbol[OWN:] % (CONTEXTS - CONTEXT_WORDS - 2)
    group[END_SYMBOL] = CONTEXTS - 1
    return group


def _neighbours(batches):
    """cell (symbol * CONTEXTS + group of the symbol after it), n: a task's counts."""
    group, counts = _contexts(), np.zeros(SYMBOLS * CONTEXTS, np.int64)
    for _, texts in _texts(batches):
        flat = np.concatenate(texts).astype(np.int64)
        inside = flat[:-1] != END_SYMBOL  # each text ends so
        counts += np.bincount(flat[:-1][inside] * CONTEXTS + group[flat[1:][inside]], minlength=len(counts))
    used = np.flatnonzero(counts)
    yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), pa.array(counts[used])], names=["cell", "n"])


def neighbour_counts(model: Model, pairs: np.ndarray) -> Counts:
    """Expected counts of as many texts of two symbols, the second known by its group; pairs: (SYMBOLS, CONTEXTS)."""
    group, got = _contexts(), Counts()
    after = np.stack([np.bincount(group, model.emit[:, k], CONTEXTS) for k in range(STATES)])
    step = model.start[:, None] * model.step
    first = step @ after  # (STATES, CONTEXTS) of the first symbol's state and the second's group
    share = pairs / np.maximum(model.emit @ first, 1e-300)
    seen = share.T @ model.emit
    got.emit = model.emit * (share @ first.T + (seen @ step)[group])
    got.step = step * (after @ seen).T
    got.start = got.step.sum(axis=1)
    return got


def begin(coded: DataFrame, prior: np.ndarray) -> Model:
    """Where Baum-Welch starts from: the same rounds over pairs of neighbours, each pair a text of two, whose counts over all
    of coded (symbols) are one table."""
    parts = coded.select("symbols").mapInArrow(_neighbours, "cell int, n long")
    t = parts.groupBy("cell").agg(F.sum("n").alias("n")).toArrow()  # at most SYMBOLS * CONTEXTS rows of 12 bytes
    counts = np.zeros(SYMBOLS * CONTEXTS)
    counts[np.asarray(t["cell"])] = np.asarray(t["n"])
    model = Model.random(prior)
    for _ in range(START_ROUNDS if counts.any() else 0):
        model = neighbour_counts(model, counts.reshape(SYMBOLS, CONTEXTS)).model(prior)
    return model


def fit(coded: DataFrame, prior: np.ndarray, rounds: int = ROUNDS) -> Model:
    """coded: symbols of the training texts."""
    model = begin(coded, prior)
    for _ in range(rounds):
        model = baum_welch(coded, model).model(prior)
    return model


def _scored(model: Model, names: list[str]):
    def run(batches):
        for t, texts in _texts(batches):
            yield from t.select(names).append_column("lik", pa.array(loglikelihoods(model, texts))).combine_chunks().to_batches()

    return run


def fold(doc_id):
    """crc32 of the id's text modulo 10; a null id counts as an empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 10


def score(docs: DataFrame, held_out) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of all rows of docs (doc_id, text); the model
    learns from those where ``held_out`` is false."""
    rows = docs.select("doc_id", held_out.alias("held_out"), text_or_empty().alias("text"))
    counts, known = count_words(rows.where(~F.col("held_out")).select("text"))
    coded = settle(rows.mapInArrow(_coded(known, ["doc_id", "held_out"]), f"doc_id {dict(docs.dtypes)['doc_id']}, held_out boolean, " + _CODED_DDL), "hmm-texts")
    model = fit(coded.where(~F.col("held_out")), known.prior)
    names = ["row", "doc_id", "held_out", "n_tokens", "n_known", "base", "inner"]
    types = dict(coded.dtypes)
    scored = coded.select(*names, "symbols").mapInArrow(_scored(model, names), ", ".join(f"{c} {types[c]}" for c in names) + ", lik double")
    rare = coded.select("row", F.explode(F.arrays_zip("rare", "times")).alias("x")).select("row", F.col("x.rare").alias("hash"), F.col("x.times").alias("times"))
    asked = rare.join(counts.where("kind >= 0").select("hash", "c"), "hash", "left")
    found = asked.groupBy("row").agg(F.sum(F.col("times") * F.log10(F.coalesce("c", F.lit(0)) + ADDED)).alias("logs"), F.sum(F.when(F.col("c") > 0, F.col("times")).otherwise(0)).alias("more"))
    logs = F.coalesce("logs", F.lit(0.0))
    return scored.join(found, "row", "left").select(
        "doc_id", "held_out", "n_tokens", (F.col("n_known") + F.coalesce("more", F.lit(0))).alias("n_known"), F.lit(int(known.total)).alias("train_tokens"),
        (F.col("base") + logs).alias("base_score"), (F.col("lik") / float(np.log(10)) + F.col("inner") + logs).alias("score"),
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return score(docs, fold(F.col("doc_id")) == 0)
