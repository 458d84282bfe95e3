"""Operators 11 to 13: defined cases, and brute force on small fixtures."""

import collections
import math
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tidemark.llm import hardneg, hmm, spelling

from .test_operators import LONG, ODD, docs

# 11 ------------------------------------------------------------------------------------------------------------------


def dot(a, b):
    return sum(x * y for x, y in zip(a, b))


def brute_mine(rows, anchor, positives=5, negatives=10):
    """rows: (vec_id, label, v)."""
    out = []
    for i, (a, label, q) in enumerate(rows):
        if not anchor(a):
            continue
        others = sorted((-dot(q, v), b, j, mark) for j, (b, mark, v) in enumerate(rows) if j != i)
        for p, b, _, _ in [x for x in others if x[3] == label][:positives]:
            fit = [x for x in others if x[3] != label and 30 * -p <= 100 * -x[0] <= 90 * -p]
            out += [(a, b, k + 1, x[1], -p, -x[0]) for k, x in enumerate(fit[:negatives])]
    return sorted(out)


def mined(spark, rows, **more):
    df = spark.createDataFrame([(i, m, None if v is None else [float(x) for x in v]) for i, m, v in rows], "vec_id long, label long, v array<double>")
    df = df.withColumn("is_anchor", F.col("vec_id") % 10 == 0)
    return sorted(tuple(r) for r in hardneg.mine(df, **more).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score").collect())


@pytest.mark.parametrize("shards", [None, 1, 5])
def test_hard_negatives(spark, shards):
    r = random.Random(2)
    rows = [(i, r.choice([0, 0, 0, 1, 2]), [r.randint(-9, 9) * r.choice([1, 1, 30]) for _ in range(5)]) for i in r.sample(range(3000), 500)]
    rows += rows[:40] + [(10, 1, [0] * 5), (20, 0, [])] + [(4000 + i, 3, [7, 7, 0, 0, 0]) for i in range(700)]  # twins, zero, empty, many alike
    rows += [(5000, 9, [1, 1, 1, 1, 1])]  # a label of its own
    got = mined(spark, rows, shards=shards)
    assert len(got) > 500 and got == brute_mine(rows, lambda a: a % 10 == 0)


def test_hard_negatives_beyond_doubles(spark):
    rows = [(i, i % 2, [2**31 + i * 3, 2**31 - i, 2**30 + i * i]) for i in range(30)]
    assert mined(spark, rows) == brute_mine(rows, lambda a: a % 10 == 0)


def test_hard_negatives_of_odd_rows(spark, tmp_path):
    assert mined(spark, []) == []
    assert mined(spark, [(0, 1, [1]), (None, 1, [1]), (1, None, [1]), (2, 1, None)]) == []
    nan, inf = float("nan"), float("inf")
    rows = [(0, 6, [0.5, 0.5]), (7, 5, [0.5, 0.5]), (1, 7, [0.5, 0.4]), (2, 6, [0.4, 0.4]), (14, 5, [0.3, 0.3]), (3, 1, [nan, 1.0]), (4, 7, [inf, 0.0]), (5, 7, [None, 1.0]), (100, None, [0.5, 0.5])]
    # 0 becomes label 7 and 7 label 6, 14 label 6 as well
    spark.createDataFrame(rows, "vec_id long, label int, embedding array<float>").withColumn("rank", F.lit(1)).write.parquet(f"{tmp_path}/embeddings.parquet")
    got = sorted(tuple(r) for r in hardneg.query(spark, str(tmp_path)).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score").collect())
    assert got == [(0, 1, 1, 2, 128 * 230, 2 * 128 * 102), (0, 1, 2, 14, 128 * 230, 2 * 128 * 76)]


def test_buckets_are_pruned():
    v = np.array([[100.0, 0]] * 4 + [[1.0, 0]] * 4)
    batches = [pa.RecordBatch.from_pydict({"bucket": [j], "n": [4], "most": [float(v[4 * j, 0])], "ids": [np.arange(4 * j, 4 * j + 4).tobytes()], "rows": [np.arange(4 * j, 4 * j + 4).tobytes()], "labels": [np.zeros(4, np.int64).tobytes()], "v": [v[4 * j : 4 * j + 4].tobytes()]}) for j in range(2)]
    shard = hardneg.Shard(batches)
    seen = []
    parts = shard.parts

    class Watched(list):
        def __iter__(self):
            for j, p in enumerate(parts):
                seen.append(j)
                yield p

    shard.parts = Watched(parts)
    ask = lambda low, k: shard.search(np.array([[1.0, 0]]), np.array([99]), np.array([1]), np.array([[low]]), np.array([[1000]]), k, False).held
    assert ask(50, 9)[1].tolist() == [100] * 4 and seen == [0, 1]  # the second bucket is looked at and left by the limit
    assert ask(-5, 2)[2].tolist() == [0, 1]  # by the second score
    assert sorted(ask(-5, 9)[1].tolist()) == [1] * 4 + [100] * 4


# 12 ------------------------------------------------------------------------------------------------------------------


def plain_log(model, symbols):
    a, total = None, 0.0
    for x in symbols:
        a = (model.start if a is None else a @ model.step) * model.emit[x]
        total += math.log(a.sum())
        a = a / a.sum()
    return total


def some_model(seed=1):
    r = np.random.default_rng(seed)
    prior = r.gamma(0.5, size=hmm.SYMBOLS) + 1e-6
    emit = prior[:, None] * r.gamma(0.5, size=(hmm.SYMBOLS, hmm.STATES)) + 1e-9
    k = np.ones(hmm.STATES)
    return hmm.Model(r.dirichlet(k), r.dirichlet(k, hmm.STATES), emit / emit.sum(axis=0)), r


def test_likelihoods_and_counts_against_plain_recursions(monkeypatch):
    model, r = some_model()
    texts = [r.integers(0, hmm.SYMBOLS, n).astype("<i2") for n in (1, 2, 3, 40, 333, 70, 2)]
    want = [plain_log(model, t) for t in texts]
    # expected counts from plain forward and backward recursions, all in logs of a text
    start, step, emit = np.zeros(hmm.STATES), np.zeros((hmm.STATES, hmm.STATES)), np.zeros((hmm.SYMBOLS, hmm.STATES))
    for t in texts:
        f = [model.start * model.emit[t[0]]]
        for x in t[1:]:
            f.append(f[-1] / f[-1].sum() @ model.step * model.emit[x])
        f = [a / a.sum() for a in f]
        b = np.ones(hmm.STATES)
        for i in range(len(t) - 1, -1, -1):
            g = f[i] * b
            emit[t[i]] += g / g.sum()
            if i:
                back = model.emit[t[i]] * b
                pair = f[i - 1][:, None] * model.step * back
                step += pair / pair.sum()
                b = model.step @ back
                b /= b.sum()
            else:
                start += g / g.sum()
    for long, side in ((2048, 1 << 19), (50, 1 << 19), (2048, 100), (64, 500)):
        monkeypatch.setattr(hmm, "LONG", long)
        monkeypatch.setattr(hmm, "SIDE_BY_SIDE", side)
        assert np.allclose(hmm.loglikelihoods(model, texts), want, rtol=1e-12)
        got = hmm.Counts()
        hmm.gather(model, texts, got)
        assert np.allclose(got.start, start) and np.allclose(got.step, step) and np.allclose(got.emit, emit)
        assert got.log == pytest.approx(sum(want))


def test_baum_welch_adds_up_over_partitions_and_climbs(spark):
    model, r = some_model(3)
    texts = [r.integers(0, 50, n).astype("<i2") for n in r.integers(1, 90, 60)]
    df = spark.createDataFrame([(i, bytearray(t.tobytes())) for i, t in enumerate(texts)], "row long, symbols binary").repartition(7)
    whole = hmm.Counts()
    hmm.gather(model, texts, whole)
    got = hmm.baum_welch(df, model)
    assert all(np.allclose(getattr(got, c), getattr(whole, c)) for c in ("start", "step", "emit", "log"))
    logs = []
    for _ in range(4):
        got = hmm.Counts()
        hmm.gather(model, texts, got)
        logs.append(got.log)
        model = got.model(np.full(hmm.SYMBOLS, 1e-12))
    assert logs == sorted(logs)


def plain_tokens(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x20\x09-\x0D]+", low)


def scored(spark, monkeypatch, df):
    """Scores, and the model that they come from."""
    seen = {}
    fit, count = hmm.fit, hmm.count_words
    monkeypatch.setattr(hmm, "fit", lambda *a: seen.setdefault("model", fit(*a)))
    monkeypatch.setattr(hmm, "count_words", lambda *a: seen.setdefault("counts", count(*a)))
    got = hmm.score(df, hmm.fold(F.col("doc_id")) == 0).collect()
    return got, seen["model"], seen["counts"][1]


def test_lm_scores_against_plain_python(spark, monkeypatch):
    r = random.Random(8)
    vocabulary = [f"W{i}ort{'é' * (i % 3)}" for i in range(300)]
    texts = [*ODD, *(" \t".join(r.choice(vocabulary[: r.randrange(2, 300)]) for _ in range(r.randrange(0, 60))) for _ in range(150))]
    df = docs(spark, texts, extra=("row", "symbols", "h", "c", "hash", "base"))
    got, model, known = scored(spark, monkeypatch, df)
    train = [i for i in range(len(texts)) if zlib.crc32(str(i).encode()) % 10]
    count = collections.Counter(w for i in train for w in plain_tokens(texts[i]))
    n = sum(count.values()) + len(train)
    v = len(count) + 1
    by = {int(h): (int(c), int(s)) for h, c, s in zip(known.hashes, known.counts, known.symbol)}
    assert known.total == n and known.distinct == v and sorted(c for c, _ in by.values()) == sorted(count.values())
    for x in got:
        words = plain_tokens(texts[x.doc_id])
        cs = [count[w] for w in words] + [len(train)]
        assert (x.held_out, x.n_tokens, x.n_known, x.train_tokens) == (zlib.crc32(str(x.doc_id).encode()) % 10 == 0, len(cs), sum(c > 0 for c in cs), n)
        assert x.base_score == pytest.approx(sum(math.log10((c + 0.1) / (n + 0.1 * (v + 1))) for c in cs), rel=1e-9)
        raw = (texts[x.doc_id] or "").encode()
        h, kinds, _ = hmm.tokens(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]))
        assert len(h) == len(words)
        symbols = [by.get(int(a), (0, hmm.OWN + int(k)))[1] for a, k in zip(h, kinds)]
        inner = sum(math.log10(c + 0.1) - known.class_log[s - hmm.OWN] for c, s in zip(cs, symbols) if s >= hmm.OWN)
        assert x.score == pytest.approx(plain_log(model, [*symbols, hmm.END_SYMBOL]) / math.log(10) + inner, rel=1e-9)
    assert len(got) == len(texts)


def test_probabilities_sum_to_one():
    r = np.random.default_rng(4)
    counts = np.sort(r.integers(1, 9, hmm.OWN + 500))[::-1]
    kinds = r.integers(0, hmm.CLASSES, len(counts)).astype(np.int16)
    rest = slice(hmm.OWN, None)
    per, some = np.bincount(kinds[rest], counts[rest], hmm.CLASSES), np.bincount(kinds[rest], minlength=hmm.CLASSES)
    known = hmm.Words(r.permutation(10**6)[: len(counts)].astype(np.uint64), counts, kinds, int(counts.sum()) + 7, len(counts) + 1, per, some, 7)
    assert known.prior.sum() == pytest.approx(1)
    for k in range(0, hmm.CLASSES, 100):
        own = counts[rest][kinds[rest] == k]
        assert ((own + 0.1).sum() + 0.1) / 10 ** known.class_log[k] == pytest.approx(1)
    model = hmm.Model.random(known.prior)
    assert np.allclose(model.emit.sum(axis=0), 1) and np.allclose(model.step.sum(axis=1), 1)


def test_words_of_texts_and_their_classes():
    texts = ["a bc", "", "d", " e\tfgh \n", "IJ ij", "x" * 9000 + " é"]
    raw = [t.encode() for t in texts]
    h, kinds, of = hmm.tokens(np.frombuffer(b"".join(raw), np.uint8), np.concatenate([[0], np.cumsum([len(x) for x in raw])]))
    assert of.tolist() == [0, 0, 2, 3, 3, 4, 4, 5, 5]
    assert h[5] == h[6] and kinds[5] == kinds[6] and len(set(h.tolist())) == 8
    for t, word, kind in zip(of, ["a", "bc", "d", "e", "fgh", "ij", "ij", "x" * 9000, "é"], kinds):
        raw = word.encode()
        assert hmm.tokens(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]))[1][0] == kind, t


def test_lm_of_held_out_texts_and_of_nothing(spark):
    df = docs(spark, ["a b", None, ""], [None, None, None], extra=("score",))
    got = hmm.score(df, F.lit(True)).collect()
    assert {(r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 9)) for r in got} == {(3, 0, 0, 0.0), (1, 0, 0, 0.0)}
    assert all(math.isfinite(r.score) and r.score < 0 for r in got)
    assert hmm.score(df.limit(0), F.lit(False)).count() == 0


def test_lm_beats_its_base_on_held_out_texts(spark):
    got = hmm.query(spark, "/root/testdata/sf0.001").where("held_out").agg(F.sum("score").alias("s"), F.sum("base_score").alias("b"), F.sum("n_tokens").alias("n")).first()
    assert got.s - got.b > 0.15 * got.n


# 13 ------------------------------------------------------------------------------------------------------------------


def plain_words(rows):
    c = collections.Counter()
    for i, t in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            run = "".join(x.lower() if "A" <= x <= "Z" else x for x in run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            c[run[: h % len(run)] + run[h % len(run) + 1 :] if h % 31 == 0 else run] += 1
    return {w: n for w, n in c.items() if len(w) >= 7 and n >= 2}


def is_near(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) - len(a) == 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def plain_variants(rows):
    words = plain_words(rows)
    near = {a: [b for b in words if is_near(a, b)] for a in words}
    form = {a: min(near[a], key=lambda b: (-words[b], b)) if near[a] else None for a in words}
    form = {a: f if f and words[f] >= 10 * words[a] else None for a, f in form.items()}
    out = []
    for a in words:
        root = a
        while form[root]:
            root = form[root]
        out.append((a, form[a], root, words[a], len(near[a]), words[form[a]] if form[a] else None))
    return sorted(out)


def found_variants(df):
    return sorted((tuple(r) for r in spelling.variants(df).select("word", "form", "root", "n", "n_near", "form_n").collect()), key=lambda r: r[0])


def spelled(seed=5):
    """Texts of words that are changed once, twice and so on, the changed ones ever rarer."""
    r = random.Random(seed)
    texts = []
    for base in ["question", "aaaaaaaa", "straßenbahn", "ÉLÉPHANTS", "bookkeeper", "missisippi", "x" * 60, "lang" * 30]:
        w, times = base, 250
        while times >= 2:
            texts += [f"{w}, {w.upper() if w.isascii() else w}!"] * (times // 2)
            i = r.randrange(len(w))
            w, times = r.choice([w[:i] + r.choice("abé") + w[i + 1 :], w[:i] + w[i + 1 :], w[:i] + r.choice("xyz") + w[i:]]), times // 11 or 1
            for _ in range(4):
                i = r.randrange(len(w))
                texts += [w[:i] + r.choice("klm") + w[i + r.choice([0, 1]) :]] * r.randrange(1, 4)
    r.shuffle(texts)
    return texts


def test_spelling_variants(spark):
    texts = [*ODD, *spelled(), "short words only", LONG[:500], "ab×cd÷efgh " * 3, "ÀÀÀÀÀÀÀ àààààààà"]
    ids = [None if i % 17 == 3 else i // 2 for i in range(len(texts))]
    got = found_variants(docs(spark, texts, ids, extra=("word", "n", "id", "key", "form")))
    want = plain_variants(list(zip(ids, texts)))
    assert got == want
    assert sum(r[1] is not None for r in want) > 10 and any(r[1] not in (None, r[2]) for r in want) and max(len(r[0]) for r in want) > spelling.CARRIED


def test_spelling_of_nothing(spark):
    assert found_variants(docs(spark, [])) == []
    assert found_variants(docs(spark, [None, "", "seldom", "uncommon"])) == []


def test_keys_are_hashes_of_what_is_left():
    words = ["abcdefg", "aabbccc", "abdefgh", "abxdefgh", "z"]
    points, offsets = spelling._code_points(pa.array(words))
    of, kind, place, key = spelling.keys(points, offsets)
    left = {}
    for i, k, p, x in zip(of.tolist(), kind.tolist(), place.tolist(), key.tolist()):
        word = spelling._without(words[i], p)
        left.setdefault((p, word) if k == spelling.REPLACED else word, set()).add(x)
    assert all(len(v) == 1 for v in left.values()) and len({min(v) for v in left.values()}) == len(left)
    assert (kind == spelling.DELETED).sum() == 7 + 3 + 7 + 8 + 1  # one of each run


def test_equal_keys_of_different_strings():
    """All keys clash: results come from the strings."""
    words = {"abcdefg": 20, "abcdefh": 2, "abcdefgh": 1, "xbcdefgh": 3, "zzzzzzzz": 5}
    points, offsets = spelling._code_points(pa.array(list(words)))
    of, kind, place, _ = spelling.keys(points, offsets)
    names = list(words)
    rows = [(0, int(k), int(p), int(i), words[names[i]], len(names[i]), names[i]) for i, k, p in zip(of, kind, place)]
    batches = [pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*part), spelling._KEYS)], schema=spelling._KEYS) for part in (rows[:9], rows[9:])]
    near, best = collections.Counter(), {}
    for b in spelling._met(iter(batches)):
        for r in b.to_pylist():
            near[names[r["id"]]] += r["near"]
            best[names[r["id"]]] = min(best.get(names[r["id"]], (0, "")), (-r["best_n"], r["best"]))
    assert near == {a: n for a in words if (n := sum(is_near(a, b) for b in words))}
    assert best["abcdefgh"] == (-20, "abcdefg") and best["abcdefg"] == (-2, "abcdefh")
