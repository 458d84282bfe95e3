"""Spelling variants by rolling-hash deletions.

Two words are near if one inserted, deleted or replaced code point makes one the other. Each word is given whole-number
keys, in numpy for many words at a time: with powers of an odd base, the hash of a word without its i-th code point is that
of its prefix plus that of its suffix over the base (modulo 2^64).

* replaced: the hash without i, mixed with i. Words that differ in place i alone share this key, and no other one.
* deleted and whole: the hashes without i (one of each run of equal code points), and the whole word's hash. A word one code
  point longer meets the word that it becomes.

Keys are radix-partitioned by their upper bits and sorted, and each run of equal keys is verified on the strings: words of a
key that stand for different strings are groups of their own. A group of "replaced" has at most as many words as there are
code points, and a group of "whole" is a star around one word, so a group's counts and best partners follow from its two
best words, without any pairs. Words of over CARRIED code points don't go with each of their keys: where such a key is met by
another word, its words are fetched by a join first.

Forms point to words of at least RATIO times the count, so a path to a root has at most 19 steps; five rounds of pointer
doubling find all roots.

Defined cases: null texts have no words; a null id is an empty one in h; rows that repeat count each; ties go to the smaller
word in code-point order; words without near ones have n_near 0; an empty table, and one without words that occur often
enough, give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import mix64, settle, spread, table

#: Code points of a word, and occurrences, at least.
LETTERS, TIMES = 7, 2
#: A form's count, at least so many times the word's.
RATIO = 10
#: Words of more code points don't travel with their keys.
CARRIED = 48
#: Words whose keys are made at a time, in code points.
_CODE_POINTS = 1 << 18
RUN = r"[A-Za-zÀ-ÿ]"
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
REPLACED, DELETED, WHOLE = 0, 1, 2


def counted_words(docs: DataFrame, letters: int = LETTERS, times: int = TIMES) -> DataFrame:
    """word, n. docs: doc_id, text. Runs too short to give a word are left out before anything is counted."""
    low = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    # without capitals, \\u00C0-\\u00FF are as they were; a maximal run of enough code points is one match
    runs = F.regexp_extract_all(low, F.lit(r"[a-zÀ-ÿ]{%d,}" % letters), F.lit(0))
    rows = docs.where("text IS NOT NULL").select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("id"), F.explode(runs).alias("run"))
    h = F.crc32(F.concat("id", F.lit(":"), "run").cast("binary"))
    at = (h % F.length("run")).cast("int")
    word = F.when(h % 31 == 0, F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, F.length("run")))).otherwise(F.col("run"))
    words = rows.select(word.alias("word")).where(F.length("word") >= letters)
    return words.groupBy("word").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= times)


def _code_points(words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The code points of all words, and the n + 1 offsets."""
    text = words.to_pylist()
    lengths = np.array([len(w) for w in text], np.int64)
    return np.frombuffer("".join(text).encode("utf-32-le", "surrogatepass"), np.uint32), np.concatenate([[0], np.cumsum(lengths)])


def keys(points: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of many words' code points: the word, kind, place and key of each of their keys."""
    lengths = np.diff(offsets)
    word = np.repeat(np.arange(len(lengths)), lengths)
    place = np.arange(len(points)) - offsets[:-1][word]
    longest = int(lengths.max(initial=0))
    with np.errstate(over="ignore"):
        power = np.ones(longest + 1, np.uint64)
        np.multiply.accumulate(np.full(longest, _BASE, np.uint64), out=power[1:])
        value = mix64(points.astype(np.uint64) + np.uint64(1)) * power[place]
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(value)])
        start = sums[offsets[:-1]]
        whole = sums[offsets[1:]] - start
        prefix = sums[:-1] - start[word]
        suffix = sums[offsets[1:]][word] - sums[1:]
        without = prefix + suffix * np.uint64(_INVERSE)
        replaced = mix64(without + mix64(place.astype(np.uint64) + np.uint64(1 << 32)))
    other = np.ones(len(points), bool)  # the first of a run of equal code points
    other[1:] = (points[1:] != points[:-1]) | (place[1:] == 0)
    n, m = len(points), int(other.sum())
    kind = np.repeat(np.array([REPLACED, DELETED, WHOLE], np.int8), [n, m, len(lengths)])
    of = np.concatenate([word, word[other], np.arange(len(lengths))])
    places = np.concatenate([place, place[other], np.full(len(lengths), -1)]).astype(np.int32)
    # deleted and whole share one key space, replaced has another: all keys are mixed with that
    apart = mix64(np.concatenate([without[other], whole]) ^ np.uint64(0xD6E8FEB86659FD93))
    return of, kind, places, np.concatenate([replaced, apart])


_KEYS_DDL = "key long, kind byte, place int, id long, n long, size int, word string"
_KEYS = pa.schema([("key", pa.int64()), ("kind", pa.int8()), ("place", pa.int32()), ("id", pa.int64()), ("n", pa.int64()), ("size", pa.int32()), ("word", pa.string())])


def _keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sizes = np.cumsum(np.asarray(batch.column("size"), dtype=np.int64))
        at = 0
        while at < batch.num_rows:
            end = max(at + 1, int(np.searchsorted(sizes, (sizes[at - 1] if at else 0) + _CODE_POINTS, "right")))
            part = batch.slice(at, end - at)
            words = part.column("word")
            of, kind, place, key = keys(*_code_points(words))
            size = np.asarray(part.column("size"))
            carried = words.take(pa.array(np.where(size[of] <= CARRIED, of, -1), mask=size[of] > CARRIED))
            every = pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(kind), pa.array(place), part.column("id").take(pa.array(of)), part.column("n").take(pa.array(of)), part.column("size").take(pa.array(of)), carried], schema=_KEYS)
            for i in range(0, every.num_rows, 1 << 16):
                yield every.slice(i, 1 << 16)
            at = end


def _without(word: str, place: int) -> str:
    return word if place < 0 else word[:place] + word[place + 1 :]


def _group(rows: list[tuple]) -> Iterator[tuple]:
    """(id, near words, count and word of the best of them) of the words of a key; rows: kind, place, id, n, word."""
    same: dict[tuple, list[tuple]] = {}
    for kind, place, i, n, word in rows:
        name = (place, _without(word, place)) if kind == REPLACED else (None, _without(word, place))
        same.setdefault(name, []).append((kind, i, n, word))
    for (place, _), group in same.items():
        if len(group) < 2:
            continue
        if place is not None:
            order = sorted(group, key=lambda x: (-x[2], x[3]))
            for k, (_, i, _, _) in enumerate(order):
                best = order[1 if k == 0 else 0]
                yield i, len(group) - 1, best[2], best[3]
            continue
        centre = [x for x in group if x[0] == WHOLE]
        longer = [x for x in group if x[0] == DELETED]
        if centre and longer:
            (_, i, n, word) = centre[0]  # words are distinct
            best = min(longer, key=lambda x: (-x[2], x[3]))
            yield i, len(longer), best[2], best[3]
            for _, j, _, _ in longer:
                yield j, 1, n, word


_NEAR_DDL = "id long, near long, best_n long, best string, key long"
_NEAR = pa.schema([("id", pa.int64()), ("near", pa.int64()), ("best_n", pa.int64()), ("best", pa.string()), ("key", pa.int64())])


def _met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows in order of key: for each word of a key that others have, its part of the result; ``key`` is only set in rows
    that name a key some of whose words weren't sent along."""
    kept: pa.RecordBatch | None = None

    def out(table: pa.Table) -> Iterator[pa.RecordBatch]:
        found: list[tuple] = []
        key = np.asarray(table["key"])
        edges = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1], [True]]))
        size = np.diff(edges)
        starts = edges[:-1][size > 1]
        wanted = np.repeat(starts, size[size > 1]) + (np.arange(int(size[size > 1].sum())) - np.repeat(np.cumsum(size[size > 1]) - size[size > 1], size[size > 1]))
        part = table.take(pa.array(wanted))
        rows = list(zip(*(part[c].to_pylist() for c in ("kind", "place", "id", "n", "word")), strict=True))
        own, at = part["key"].to_pylist(), 0
        for s in size[size > 1].tolist():
            group = rows[at : at + s]
            if any(r[4] is None for r in group):
                found.append((None, None, None, None, own[at]))
            else:
                found += [(*x, None) for x in _group(group)]
            at += s
        if found:
            yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*found, strict=True), _NEAR, strict=True)], schema=_NEAR)

    for batch in batches:
        table = pa.Table.from_batches([kept, batch] if kept is not None else [batch])
        key = np.asarray(table["key"])
        last = int(np.searchsorted(key, key[-1], "left"))  # the last key may go on
        if last:
            yield from out(table.slice(0, last))
        kept = table.slice(last).combine_chunks().to_batches()[0]
    if kept is not None:
        yield from out(pa.Table.from_batches([kept]))


def _groups(keyed: DataFrame) -> DataFrame:
    """Runs of equal keys: keys are dealt by radix and sorted, then read in one go."""
    return keyed.repartition(F.shiftrightunsigned("key", 32)).sortWithinPartitions("key").mapInArrow(_met, _NEAR_DDL)


def near_words(words: DataFrame) -> DataFrame:
    """id, n_near, best (struct of -n and word) of the words that have near ones. words: id, word, n."""
    sized = words.select("id", "word", "n", F.length("word").alias("size"))
    # a long word's key is met by few others: only such keys' words are fetched
    keyed = sized.mapInArrow(_keyed, _KEYS_DDL)
    longest = words.agg(F.max(F.length("word"))).first()[0] or 0
    if longest <= CARRIED:
        found = _groups(keyed)
    else:
        keyed = settle(keyed, "spelling-keys")
        found = settle(_groups(keyed), "spelling-near")
        open_ = found.where("key IS NOT NULL").select("key")
        fetched = keyed.join(open_, "key").drop("word").join(words.select("id", "word"), "id").select(*[f.name for f in _KEYS])
        found = found.where("key IS NULL").unionByName(_groups(fetched))
    best = F.struct((-F.col("best_n")).alias("m"), F.col("best").alias("word"))
    return found.groupBy("id").agg(F.sum("near").alias("n_near"), F.min(best).alias("best"))


def roots(forms: DataFrame) -> DataFrame:
    """word, root. forms: word, form; paths of forms have no circles."""
    now = settle(forms.select("word", F.col("form").alias("root")), "spelling-forms")
    while True:
        then = now.select(F.col("word").alias("root"), F.col("root").alias("next"))
        step = settle(now.join(then, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "spelling-roots")
        if step.where("moved").isEmpty():
            return step.select("word", "root")
        now = step.drop("moved")


def variants(docs: DataFrame, ratio: int = RATIO) -> DataFrame:
    """word, form, root, n, n_near, form_n of the words of docs (doc_id, text)."""
    counted = counted_words(docs)
    words = settle(counted.select(F.monotonically_increasing_id().alias("id"), "word", "n"), "spelling-words")
    near = near_words(words)
    form_n = -F.col("best.m")
    has = form_n >= ratio * F.col("n")
    out = settle(words.join(near, "id", "left").select("word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.when(has, F.col("best.word")).alias("form"), F.when(has, form_n).alias("form_n")), "spelling-variants")
    ends = roots(out.where("form IS NOT NULL").select("word", "form"))
    return out.join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants(spread(table(spark, sf_dir, "documents").select("doc_id", "text")))
