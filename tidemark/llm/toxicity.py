"""Toxic spans by a linear-chain conditional random field, and document scores from its marginals.

Labels are of documents, so token labels come first: on a bounded sample of labelled documents, words and word heads
are picked greedily, each time the one that explains the most toxic documents not yet explained and hardly occurs in
the others; tokens that show a picked one in a toxic document are labelled toxic. On these tokens the field is fitted:
two labels, transition weights, and hashed features (the word, its first 3, 4 and 5 and its last 4 bytes).

``score_texts`` tokenises whole texts in numpy and runs forward and backward over all their tokens, whatever they are:
many texts make one chain, in which a text's first token forgets what was before, and the chain is worked through in
strips side by side. A document's score is a logistic function, fitted on the sample, of the log-odds of its two most
toxic tokens and of the logarithm of their number, for of more tokens some look more toxic by chance. (The odds that any
token is toxic would rise with every harmless token, without bound.)

Bounds, of the fit alone: of the SAMPLE_TOXIC and SAMPLE_CLEAN labelled documents of least hash those are gathered, whole,
that fit into SAMPLE_BYTES together: they are taken by turns of their kinds, and one that doesn't fit any more is left
out, the ones after it are not; and of the windows of WINDOW tokens without a toxic one, evenly as many as make
FIT_TOKENS. Windows keep to their texts and follow the label before them, that of a text's first window being 0, as in
scoring. The picks, weights and numbers of the logistic function are all that goes to the tasks.

Defined cases: null and empty texts have no tokens and get the score of a text without cues; labels that are null, or
contradict each other for one id, count as the larger; of several texts of one labelled id the shortest stands for it; without usable labels of both kinds all scores are 0.5 less a
hair (nothing is rejected); an empty table gives no rows; repeated rows are scored each; other columns pass through
``score``, but for ``score`` and ``spans``, in whose place the new ones come.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bytes_of, mix64, spread, table

SAMPLE_TOXIC, SAMPLE_CLEAN, SAMPLE_BYTES = 1000, 1500, 10 << 20
FIT_TOKENS = 300_000
WINDOW = 16
BITS = 18
KINDS = 5
_BYTE = mix64(np.arange(1, 257, dtype=np.uint64))
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_IS = np.zeros(256, bool)
_IS[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True
_UP = np.ones(256, np.uint64)
with np.errstate(over="ignore"):
    np.multiply.accumulate(np.full(255, 0x9E3779B97F4A7C15, np.uint64), out=_UP[1:])
_FLOOR, _CEIL = -14.0, 14.0


def tokens(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and texts of the words: runs of letters and digits of ASCII and of all other signs."""
    inside = np.zeros(len(raw) + 2, bool)
    inside[1:-1] = _IS[raw]
    change = inside[1:] != inside[:-1]
    edges = np.flatnonzero(change)
    starts, ends = edges[0::2], edges[1::2]
    # a word doesn't go on into the next text
    inner = offsets[1:-1]
    inner = inner[(inner > 0) & (inner < len(raw))]
    inner = np.unique(inner[inside[inner] & inside[inner + 1]]) if len(inner) else inner
    if len(inner):
        starts, ends = np.sort(np.concatenate([starts, inner])), np.sort(np.concatenate([ends, inner]))
    return starts, ends, np.searchsorted(offsets, starts, "right") - 1


def features(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """(words, KINDS) hashes in lower case: the word, its first 3, 4 and 5 bytes and its last 4."""
    out = np.zeros((len(starts), KINDS), np.uint64)
    if not len(starts):
        return out
    low = _LOWER[raw]
    after = np.zeros(len(raw), bool)
    after[1:] = raw[:-1] == 0xC3
    low = np.where(after & (low >= 0x80) & (low <= 0x9E), low + 32, low)
    sizes = ends - starts
    padded = np.concatenate([low, np.zeros(8, np.uint8)])
    with np.errstate(over="ignore"):
        word = np.zeros(len(raw), bool)
        word[starts] = True
        last = np.zeros(len(raw), np.int64)
        last[starts] = starts
        place = np.arange(len(raw)) - np.maximum.accumulate(last)
        value = np.where(_IS[raw], _BYTE[low] * _UP[place & 255], 0)
        out[:, 0] = np.add.reduceat(value, starts) + sizes.astype(np.uint64)
        head = np.zeros(len(starts), np.uint64)
        for k in range(5):
            here = np.where(sizes > k, _BYTE[padded[starts + k]], 7).astype(np.uint64)
            head = (head ^ here) * np.uint64(0x100000001B3)
            if k >= 2:
                out[:, k - 1] = head + np.uint64(k)
        tail = np.full(len(starts), 99, np.uint64)
        for k in range(1, 5):
            here = np.where(sizes >= k, _BYTE[low[np.maximum(ends - k, 0)]], 11).astype(np.uint64)
            tail = (tail ^ here) * np.uint64(0x100000001B3)
        out[:, 4] = tail
    return mix64(out)


def slots(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> np.uint64(64 - BITS)).astype(np.int32)


def cues_of(hashes: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Distinct pairs of a word or head and a document: the upper 52 bits of a hash and 12 bits for the document."""
    return np.unique(np.concatenate([hashes[:, k] & ~np.uint64(4095) | doc.astype(np.uint64) for k in range(4)]))


def pick_cues(pairs: np.ndarray, toxic: np.ndarray, most: int = 400) -> np.ndarray:
    """Upper 52 bits of the hashes of words and heads that explain toxic documents, greedily."""
    n1, n0 = int(toxic.sum()), int((~toxic).sum())
    of = (pairs & np.uint64(4095)).astype(np.int32)
    pairs = pairs & ~np.uint64(4095)
    hit = toxic[of]
    least = 3 if n1 >= 20 else 1
    # only what comes in enough toxic documents can be picked
    names, bad = np.unique(pairs[hit], return_counts=True)
    names, bad = names[bad >= least], bad[bad >= least]
    if not len(names):
        return np.zeros(0, np.uint64)
    place = np.minimum(np.searchsorted(names, pairs), len(names) - 1).astype(np.int32)
    known = names[place] == pairs
    clean = np.bincount(place[known & ~hit], minlength=len(names))
    fit = clean * n1 <= 0.02 * bad * max(n0, 1)
    keep = known & hit & fit[place]
    at, of = place[keep], of[keep]
    del pairs, place, known, hit, keep
    left = toxic.copy()
    # what is common in toxic documents counts even where other cues explain the same ones
    out = list(names[fit & (bad >= max(4, 0.05 * n1)) & (clean * n1 <= 0.005 * bad * max(n0, 1))])
    for _ in range(most):
        gain = np.bincount(at, minlength=len(names))
        best = int(gain.argmax())  # on a tie the first in the order of hashes
        if not len(at) or gain[best] < least:
            break
        out.append(names[best])
        left[of[at == best]] = False
        keep = left[of]
        at, of = at[keep], of[keep]
    return np.unique(np.array(out, np.uint64))


class Field:
    """Weights of the chain: emission of the toxic label (bias and hashed features) and transitions, the label before a
    text counting as 0; and of the logistic function."""

    def __init__(self, bias: float, trans: np.ndarray, weights: np.ndarray, scale=(1.0, 0.0, 0.0, 0.0)):
        self.bias, self.trans, self.weights, self.scale = bias, trans, weights, np.asarray(scale, float)

    def marginals(self, lift: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Of the toxic label at each token, whose emission is bias + lift. ``first``: the tokens that begin a text.

        Tokens are laid out in strips of equal length. The strips' products of 2 x 2 matrices come first, side by side;
        from these follows what each strip begins and ends with, and then forward and backward run through all strips."""
        n = len(lift)
        if not n:
            return np.zeros(0)
        length = max(int(n**0.5 / 2), 1)
        width = -(-n // length)
        toxic = np.zeros(width * length)
        toxic[:n] = 1 / (1 + np.exp(-np.clip(self.bias + lift, -60, 60)))
        begins = np.ones(width * length)  # beyond the end as well
        begins[:n] = first
        u1 = np.ascontiguousarray(toxic.reshape(width, length).T)
        u0 = 1 - u1
        new = np.ascontiguousarray(begins.reshape(width, length).T)
        t00, t01, t10, t11 = np.exp(self.trans - self.trans.max()).ravel().tolist()
        # from a label before to label 0 and 1; a text's first token has the same from both
        m00, m01 = t00 * u0, t01 * u1
        m10, m11 = np.where(new, t00, t10) * u0, np.where(new, t01, t11) * u1
        a, b, c, d = np.ones(width), np.zeros(width), np.zeros(width), np.ones(width)
        for k in range(length):
            a, b = a * m00[k] + b * m10[k], a * m01[k] + b * m11[k]
            c, d = c * m00[k] + d * m10[k], c * m01[k] + d * m11[k]
            s = a + b + c + d
            a, b, c, d = a / s, b / s, c / s, d / s
        start, end = np.empty((2, width)), np.empty((2, width))
        x, y = 1.0, 0.0
        z, w = 1.0, 1.0
        rows = list(zip(a.tolist(), b.tolist(), c.tolist(), d.tolist()))
        for i, (p, q, r, v) in enumerate(rows):
            start[0, i], start[1, i] = x, y
            x, y = x * p + y * r, x * q + y * v
            x, y = x / (x + y), y / (x + y)
        for i in range(width - 1, -1, -1):
            end[0, i], end[1, i] = z, w
            p, q, r, v = rows[i]
            z, w = p * z + q * w, r * z + v * w
            z, w = z / (z + w), w / (z + w)
        ahead = np.empty((2, length, width))
        x, y = start
        for k in range(length):
            x, y = x * m00[k] + y * m10[k], x * m01[k] + y * m11[k]
            s = x + y
            x, y = x / s, y / s
            ahead[0, k], ahead[1, k] = x, y
        out = np.empty((length, width))
        z, w = end
        for k in range(length - 1, -1, -1):
            one = ahead[1, k] * w
            out[k] = one / (ahead[0, k] * z + one)
            z, w = m00[k] * z + m01[k] * w, m10[k] * z + m11[k] * w
            s = z + w
            z, w = z / s, w / s
        return out.T.ravel()[:n]

    def score(self, sums: np.ndarray) -> np.ndarray:
        """Of documents with these sums (see ``document_sums``)."""
        return 1 / (1 + np.exp(-np.clip(sums @ self.scale[:3] + self.scale[3], -30, 30)))


def document_sums(p: np.ndarray, first: np.ndarray) -> np.ndarray:
    """(documents, 3): log-odds of the most toxic token and of the next one, logarithm of 1 more than the number of
    tokens. first: each document's first token, and the number of tokens."""
    sizes = np.diff(first)
    out = np.full((len(sizes), 3), _FLOOR)
    out[:, 2] = np.log1p(sizes)
    full = np.flatnonzero(sizes)
    if len(full):
        p = np.clip(p, 1e-12, 1 - 1e-12)
        odds = np.clip(np.log(p) - np.log1p(-p), _FLOOR, _CEIL)
        at = first[:-1][full]
        out[full, 0] = np.maximum.reduceat(odds, at)
        of = np.repeat(np.arange(len(full)), sizes[full])
        best = np.flatnonzero(odds == out[full, 0][of])
        odds[best[np.unique(of[best], return_index=True)[1]]] = _FLOOR  # one token of the greatest
        out[full, 1] = np.maximum.reduceat(odds, at)
    return out


def _lots(texts: list[str]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """About half a megabyte of texts at a time: number of the first, bytes, offsets."""
    at = 0
    while at < len(texts):
        end, size = at, 0
        while end < len(texts) and (end == at or size < 1 << 19):
            size += len(texts[end])
            end += 1
        yield at, *bytes_of(pa.array(texts[at:end], pa.large_string()))
        at = end


def window_gradient(lift: np.ndarray, trans: np.ndarray, target: np.ndarray, inside: np.ndarray, before: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
    """Negative log-likelihood of labelled windows, and its gradients by emission (windows, tokens) and by transition.

    Each window follows a token of label ``before`` (0 where a text begins, as in scoring); tokens not ``inside`` don't
    count."""
    m, size = lift.shape
    rows = np.arange(m)
    em = np.stack([np.zeros((m, size)), lift], axis=2)
    alpha, beta = np.empty((size, m, 2)), np.zeros((size, m, 2))
    alpha[0] = trans[before] + em[:, 0]
    for k in range(1, size):
        to = np.logaddexp(alpha[k - 1][:, 0, None] + trans[0], alpha[k - 1][:, 1, None] + trans[1]) + em[:, k]
        alpha[k] = np.where(inside[:, k, None], to, alpha[k - 1])
    for k in range(size - 2, -1, -1):
        ahead = beta[k + 1] + em[:, k + 1]
        back = np.logaddexp(ahead[:, 0, None] + trans[:, 0], ahead[:, 1, None] + trans[:, 1])
        beta[k] = np.where(inside[:, k + 1, None], back, beta[k + 1])
    z = np.logaddexp(alpha[-1][:, 0], alpha[-1][:, 1])
    p = np.exp(alpha[:, :, 1] + beta[:, :, 1] - z).T
    pair = np.zeros((2, 2))
    np.add.at(pair, before, np.stack([1 - p[:, 0], p[:, 0]], axis=1))
    np.subtract.at(pair, (before, target[:, 0]), 1)
    told = trans[before, target[:, 0]].sum() + (lift * target * inside).sum()
    for k in range(1, size):
        both = np.exp(alpha[k - 1][:, :, None] + trans[None] + (em[:, k] + beta[k])[:, None, :] - z[:, None, None])
        on = rows[inside[:, k]]
        pair += both[on].sum(axis=0)
        np.subtract.at(pair, (target[on, k - 1], target[on, k]), 1)
        told += trans[target[on, k - 1], target[on, k]].sum()
    return float(z.sum() - told), (p - target) * inside, pair


def fit(texts: list[str], toxic: np.ndarray) -> Field:
    """From labelled documents. Deterministic."""
    none = Field(-8.0, np.zeros((2, 2)), np.zeros(1 << BITS), (0.0, 0.0, 0.0, -1e-6))
    toxic = np.asarray(toxic, bool)
    if not len(texts) or toxic.all() or not toxic.any():
        return none
    assert len(texts) < 4096, "cues_of keeps 12 bits for a document"
    parts = []
    for first, raw, offsets in _lots(texts):
        starts, ends, of = tokens(raw, offsets)
        found = features(raw, starts, ends)
        parts.append(((of + first).astype(np.int32), found, cues_of(found, of + first)))
    doc, hashes, pairs = (np.concatenate([p[k] for p in parts]) for k in (0, 1, 2))
    del parts
    if not len(doc):
        return none
    cues = np.sort(pick_cues(pairs, toxic))
    del pairs
    if not len(cues):
        return none
    y = toxic[doc] & np.logical_or.reduce([np.isin(hashes[:, k] & ~np.uint64(4095), cues) for k in range(4)])
    # windows with toxic tokens, and every so many of the rest
    begins = np.concatenate([[True], doc[1:] != doc[:-1]])
    place = np.arange(len(doc)) - np.maximum.accumulate(np.where(begins, np.arange(len(doc)), 0))
    at = np.flatnonzero(place % WINDOW == 0)  # a window keeps to its text
    length = np.diff(np.append(at, len(doc)))
    hot = np.add.reduceat(y.astype(int), at) > 0
    plain = np.flatnonzero(~hot)
    every = max(1, len(plain) * WINDOW // FIT_TOKENS)
    used = np.sort(np.concatenate([np.flatnonzero(hot), plain[::every]]))
    at, length = at[used], length[used]
    inside = np.arange(WINDOW)[None, :] < length[:, None]
    rows = np.minimum(at[:, None] + np.arange(WINDOW)[None, :], len(doc) - 1)
    before = np.where(begins[at], 0, y[np.maximum(at - 1, 0)].astype(int))
    s, target = slots(hashes[rows.ravel()]).reshape(*rows.shape, KINDS), (y[rows] & inside).astype(int)
    del hashes
    w, bias, trans = np.zeros(1 << BITS), -4.0, np.zeros((2, 2))
    flat = s.ravel()
    seen = np.bincount(flat, weights=np.repeat(inside.ravel(), KINDS), minlength=1 << BITS) > 0
    gw, gb, gt = np.full(1 << BITS, 1e-3), 1e-3, np.full((2, 2), 1e-3)
    for _ in range(40):
        _, d, pair = window_gradient(bias + w[s].sum(axis=2), trans, target, inside, before)
        g = np.bincount(flat, weights=np.repeat(d.ravel(), KINDS), minlength=1 << BITS) + 0.05 * w * seen
        pair += 0.5 * trans
        gw, gb, gt = gw + g * g, gb + d.sum() ** 2, gt + pair * pair
        w -= 0.5 * g / np.sqrt(gw) * seen
        bias -= 0.5 * d.sum() / np.sqrt(gb)
        trans = trans - 0.3 * pair / np.sqrt(gt)
    field = Field(float(bias), trans, w)
    x = np.concatenate([score_texts(field, raw, offsets)[0] for _, raw, offsets in _lots(texts)])
    # logistic calibration by Newton's method, each kind with equal weight
    v = np.where(toxic, 0.5 / toxic.sum(), 0.5 / (~toxic).sum()) * len(toxic)
    t = np.where(toxic, 0.98, 0.02)
    mid = x.mean(axis=0)
    x = np.concatenate([x - mid, np.ones((len(x), 1))], axis=1)
    ridge = 1e-2 * np.array([1.0, 1.0, 1.0, 0.0])
    k = np.array([0.5, 0.0, 0.0, 0.0])

    def loss(k):
        u = x @ k
        return float((v * (np.logaddexp(0, u) - t * u)).sum() + 0.5 * ridge @ (k * k))

    for _ in range(60):
        q = 1 / (1 + np.exp(-np.clip(x @ k, -30, 30)))
        h = (x * (v * q * (1 - q))[:, None]).T @ x + np.diag(ridge + 1e-9)
        move = np.linalg.solve(h, x.T @ (v * (q - t)) + ridge * k)
        while loss(k - move) > loss(k) and np.abs(move).max() > 1e-9:
            move = move / 2
        k = k - move
    field.scale = np.append(k[:3], k[3] - k[:3] @ mid)
    return field


def score_texts(field: Field, raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, list[list[tuple[int, int, float]]]]:
    """Of each text the sums (see ``document_sums``), and (start, end, marginal) in bytes of the toxic tokens."""
    starts, ends, doc = tokens(raw, offsets)
    lift = field.weights[slots(features(raw, starts, ends))].sum(axis=1) if len(starts) else np.zeros(0)
    p = field.marginals(lift, np.concatenate([[True], doc[1:] != doc[:-1]]) if len(doc) else np.zeros(0, bool))
    spans: list[list[tuple[int, int, float]]] = [[] for _ in range(len(offsets) - 1)]
    for j in np.flatnonzero(p >= 0.5):
        i = doc[j]
        spans[i].append((int(starts[j] - offsets[i]), int(ends[j] - offsets[i]), float(p[j])))
    return document_sums(p, np.searchsorted(doc, np.arange(len(offsets)))), spans


_PIECE = 1 << 19


def score(docs: DataFrame, field: Field) -> DataFrame:
    """docs with ``score`` and ``spans``: the toxic tokens' offsets in code points and their marginals."""
    kept = docs.drop("score", "spans")
    span = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType()), T.StructField("p", T.DoubleType())]))
    schema = T.StructType([*kept.schema.fields, T.StructField("score", T.DoubleType()), T.StructField("spans", span)])
    kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("p", pa.float64())]))

    def run(batches):
        for batch in batches:
            raw, offsets = bytes_of(batch.column("text"))
            at = 0
            while at < batch.num_rows:
                end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + _PIECE, "right")) - 1)
                own, place = raw[offsets[at] : offsets[end]], offsets[at : end + 1] - offsets[at]
                sums, found = score_texts(field, own, place)
                scores, spans = field.score(sums), []
                for i, held in enumerate(found):
                    if held:  # bytes to code points: count the bytes that begin one
                        begins = np.concatenate([[0], np.cumsum((own[place[i] : place[i + 1]] & 0xC0) != 0x80)])
                        held = [{"start": int(begins[a]), "end": int(begins[b]), "p": p} for a, b, p in held]
                    spans.append(held)
                part = batch.slice(at, end - at)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(scores, pa.float64()), pa.array(spans, kind)], names=[*part.schema.names, "score", "spans"])
                at = end

    return kept.mapInArrow(run, schema)


def fold(doc_id) -> object:
    """crc32 of the id's text modulo 5; a null id counts as an empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 5


def fit_on(docs: DataFrame, labels: DataFrame) -> Field:
    """From the documents whose fold is not 0 and whose label is 0 or 1, a bounded sample of them."""
    known = labels.where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull() & (fold(F.col("doc_id")) != 0)).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    by = F.xxhash64("doc_id", F.lit(11))
    pick = lambda k, n: known.where(F.col("toxic") == k).orderBy(by, "doc_id").limit(n)
    ids = F.broadcast(pick(1, SAMPLE_TOXIC).unionAll(pick(0, SAMPLE_CLEAN)))  # at most 2,500 rows of 12 bytes
    rows = docs.select("doc_id", "text", F.octet_length("text").alias("size"), F.xxhash64("text").alias("mark")).where("text IS NOT NULL")
    sizes = rows.drop("text").join(ids, "doc_id").groupBy("doc_id", "toxic").agg(F.min(F.struct("size", "mark")).alias("x")).select("doc_id", "toxic", "x.*", by.alias("by")).collect()
    # toxic and clean ones take turns, so neither kind uses up the bytes
    turn = {r["doc_id"]: i for k in (0, 1) for i, r in enumerate(sorted((r for r in sizes if r["toxic"] == k), key=lambda r: (r["by"], r["doc_id"])))}
    fits, left = [], SAMPLE_BYTES
    for r in sorted(sizes, key=lambda r: (turn[r["doc_id"]], r["toxic"])):
        if r["size"] <= left:
            fits.append((r["doc_id"], r["toxic"], r["size"], r["mark"]))
            left -= r["size"]
    if not fits:
        return fit([], np.zeros(0, bool))
    wanted = F.broadcast(docs.sparkSession.createDataFrame(fits, "doc_id long, toxic int, size int, mark long"))
    got = rows.join(wanted, ["doc_id", "size", "mark"]).groupBy("doc_id", "toxic").agg(F.min("text").alias("text")).collect()
    got.sort(key=lambda r: r["doc_id"])
    return fit([r["text"] for r in got], np.array([r["toxic"] == 1 for r in got], bool))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "text"))
    field = fit_on(docs, table(spark, sf_dir, "labels"))
    joined = F.array_join(F.transform("spans", lambda s: F.concat_ws(":", s["start"], s["end"])), ",")
    return score(docs, field).select("doc_id", (fold(F.col("doc_id")) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), joined.alias("spans"))


def clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: the documents that are not predicted toxic."""
    names = docs.columns
    got = score(docs.select(F.struct(*[docs[c] for c in names]).alias("_row"), F.col("text")), fit_on(docs, table(spark, sf_dir, "labels")))
    return got.where(F.col("score") < 0.5).select(*[F.col("_row").getField(c).alias(c) for c in names])
