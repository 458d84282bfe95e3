"""Hard-negative mining by norm-bucketed search.

Candidates are sorted by their Euclidean norm, longest first, and cut into buckets of BUCKET rows, each one packed row of
a table. By Cauchy and Schwarz no product with a bucket's vectors is larger than the query's norm times the bucket's
largest norm, so a query's walk through the buckets ends at the first where that falls below the lower limit of its
window or, once k results are found, below the k-th score; all later buckets are shorter still.

A shard is a run of neighbouring buckets, held by one task, through which blocks of queries stream. Blocks hold queries of
like reach (lower limit over norm), and go only to the shards that their reach admits. Each block first visits one of the
long shards, and the k-th scores found there are floors for the others. Two searches are made: the k best of the same
label (positives), and then, for all windows of an anchor at once, the k best of other labels within each window.

Defined cases: rows with a null id, label or vector, or with null or non-finite components take no part; empty vectors
have all products 0; vectors of unequal length are compared with zeros added; rows that repeat an id, or id and vector,
are rows of their own, as queries and as candidates; ties go to the smaller id; fewer than k others give all of them; an
anchor without positives, and a window that nothing is in, give no rows; an empty table gives none. Products are summed
in whole numbers and cut to 64 bits.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import settle, table
from .topk import _matrix, _score, _wide, quantise

#: Rows of a bucket, queries of a block.
BUCKET, BLOCK = 512, 256
#: Bytes of a shard as doubles; queries that one task takes through one.
SHARD_BYTES = 64 << 20
GROUP_QUERIES = 1 << 16
#: Runs of neighbouring shards that are told apart where blocks are routed: so many numbers are sent at most.
MOST_RUNS = 1 << 16
#: Results that wait before they are merged into the best.
_PENDING = 1 << 15
_LEAST, _MOST = np.iinfo(np.int64).min, np.iinfo(np.int64).max


class Best:
    """The k best (score, then smaller id, then smaller row) of many units, ragged, with each unit's k-th score."""

    def __init__(self, floor: np.ndarray, k: int):
        self.k, self.floor, self.kth = k, floor, floor.copy()
        self.held = [np.zeros(0, np.int64)] * 4
        self.waiting: list[tuple] = []
        self.n_waiting = 0

    def add(self, unit: np.ndarray, score: np.ndarray, ids: np.ndarray, rows: np.ndarray) -> None:
        self.waiting.append((unit, score, ids, rows))
        self.n_waiting += len(unit)
        if self.n_waiting >= max(_PENDING, len(self.held[0])):
            self.merge()

    def merge(self) -> None:
        if not self.n_waiting:
            return
        unit, score, ids, rows = (np.concatenate(x) for x in zip(self.held, *self.waiting, strict=True))
        self.waiting, self.n_waiting = [], 0
        by = np.lexsort((rows, ids, ~score, unit))
        unit = unit[by]
        first = np.flatnonzero(np.concatenate([[True], unit[1:] != unit[:-1]]))
        rank = np.arange(len(unit)) - np.repeat(first, np.diff(np.append(first, len(unit))))
        kept = rank < self.k
        by, unit, rank = by[kept], unit[kept], rank[kept]
        self.held = [unit, score[by], ids[by], rows[by]]
        last = rank == self.k - 1
        self.kth[unit[last]] = np.maximum(self.floor[unit[last]], self.held[1][last])


class Shard:
    """Buckets of a shard, the longest vectors first."""

    def __init__(self, batches: list[pa.RecordBatch]):
        t = pa.Table.from_batches(batches).sort_by("bucket").combine_chunks()
        self.most = np.asarray(t["most"])
        self.parts = []
        for n, ids, rows, labels, v in zip(*(t[c].to_pylist() for c in ("n", "ids", "rows", "labels", "v")), strict=True):
            of = lambda b: np.frombuffer(b, np.int64)
            self.parts.append((of(ids), of(rows), of(labels), np.frombuffer(v, float).reshape(n, -1)))
        self.largest = [float(np.abs(p[3]).max(initial=0)) for p in self.parts]

    def search(self, q: np.ndarray, rows: np.ndarray, labels: np.ndarray, low: np.ndarray, high: np.ndarray, k: int, same: bool) -> Best:
        """Units are (query, window): low and high have a row a query and a column a window; low > high: no window."""
        n, windows = low.shape
        best = Best(low.ravel(), k)
        high_of = high.ravel()
        norms = np.sqrt((q * q).sum(axis=1)) if q.shape[1] else np.zeros(n)
        open_ = (low <= high).ravel()
        big = float(np.abs(q).max(initial=0))
        for j, (ids, own, marks, v) in enumerate(self.parts):
            with np.errstate(over="ignore", invalid="ignore"):
                reach = norms * self.most[j]
                reach = np.where(np.isnan(reach), np.inf, reach * (1 + 1e-9) + 1)
            unit_on = open_ & (np.repeat(reach, windows) >= best.kth.astype(float))
            on = np.flatnonzero(unit_on.reshape(n, windows).any(axis=1))
            if not len(on):
                break  # later buckets are shorter
            width = max(q.shape[1], v.shape[1])
            exact = big * self.largest[j] * max(width, 1) < 2**53
            s = _score(_wide(q[on], width), _wide(v, width), exact)
            fit = (marks[None, :] == labels[on, None]) == same
            fit &= own[None, :] != rows[on, None]
            for w in range(windows):
                unit = on * windows + w
                use = np.flatnonzero(unit_on[unit])
                if not len(use):
                    continue
                some = s[use] if len(use) < len(on) else s
                inside = (some >= best.kth[unit[use], None]) & (some <= high_of[unit[use], None]) & (fit[use] if len(use) < len(on) else fit)
                if some.shape[1] > k and inside.sum() > 4 * k * len(use):  # of a bucket only its own k best can matter
                    cut = np.partition(np.where(inside, some, _LEAST), some.shape[1] - k, axis=1)[:, some.shape[1] - k]
                    inside &= some >= cut[:, None]
                at, col = np.nonzero(inside)
                if len(at):
                    best.add(unit[use[at]], some[at, col], ids[col], own[col])
            if j == 0:
                best.merge()
        best.merge()
        return best


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows in order of norm, BUCKET at a time."""
    from pyspark import TaskContext

    shard, number = TaskContext.get().partitionId(), 0
    held: list[pa.RecordBatch] = []

    def out(t: pa.Table) -> pa.RecordBatch:
        t = t.combine_chunks()
        v = _matrix(t["v"].combine_chunks())
        raw = [np.ascontiguousarray(np.asarray(t[c], dtype=np.int64)).tobytes() for c in ("vec_id", "row", "label")]
        norms = np.asarray(t["norm"])
        cells = {"shard": [shard], "bucket": [number], "n": [len(norms)], "most": [float(norms.max())], "ids": [raw[0]], "rows": [raw[1]], "labels": [raw[2]], "v": [np.ascontiguousarray(v).tobytes()]}
        return pa.RecordBatch.from_pydict(cells, schema=_BUCKETS)

    n = 0
    for batch in batches:
        at = 0
        while at < batch.num_rows:
            part = batch.slice(at, BUCKET - n)
            held.append(part)
            at, n = at + part.num_rows, n + part.num_rows
            if n == BUCKET:
                yield out(pa.Table.from_batches(held))
                held, n, number = [], 0, number + 1
    if held:
        yield out(pa.Table.from_batches(held))


_BUCKETS = pa.schema([("shard", pa.int32()), ("bucket", pa.int32()), ("n", pa.int32()), ("most", pa.float64()), ("ids", pa.binary()), ("rows", pa.binary()), ("labels", pa.binary()), ("v", pa.binary())])
_BUCKETS_DDL = "shard int, bucket int, n int, most double, ids binary, rows binary, labels binary, v binary"


def buckets(vectors: DataFrame, shards: int) -> DataFrame:
    """vectors (row, vec_id, label, v, norm), packed: shards are ranges of falling norm, vectors of one norm are dealt
    by their rows."""
    order = [F.col("norm").desc(), F.xxhash64("row")]
    dealt = vectors.repartitionByRange(shards, *order).sortWithinPartitions(*order)
    return settle(dealt.mapInArrow(_packed, _BUCKETS_DDL), "hardneg-buckets")


_FOUND = pa.schema([("query", pa.int64()), ("win", pa.int32()), ("vec_id", pa.int64()), ("row", pa.int64()), ("score", pa.int64())])
_FOUND_DDL = "query long, win int, vec_id long, row long, score long"


def _through(k: int, same: bool):
    """Rows come by (shard, grp, kind): buckets, then blocks of queries, which stream through."""

    def run(batches):
        held, shard, key = [], None, None
        for batch in batches:
            for i in range(batch.num_rows):
                part = batch.slice(i, 1)
                name = tuple(part.column(c)[0].as_py() for c in ("shard", "grp"))
                if name != key:
                    held, shard, key = [], None, name
                if part.column("kind")[0].as_py() == 0:
                    held.append(part)
                    continue
                if shard is None:
                    if not held:
                        continue
                    shard, held = Shard(held), []
                n = part.column("n")[0].as_py()
                of = lambda c: np.frombuffer(part.column(c)[0].as_py(), np.int64)  # noqa: B023, E731
                rows, labels = of("rows"), of("labels")
                q = np.frombuffer(part.column("v")[0].as_py(), float).reshape(n, -1)
                low, high = of("low").reshape(n, -1), of("high").reshape(n, -1)
                unit, score, ids, got = shard.search(q, rows, labels, low, high, k, same).held
                windows = low.shape[1]
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (rows[unit // windows], (unit % windows).astype(np.int32), ids, got, score)], schema=_FOUND)

    return run


_BLOCKS_DDL = "block long, n int, rows binary, labels binary, v binary, low binary, high binary, last int"


def _blocks(reach: np.ndarray, shards: int):
    """Queries in order of reach, BLOCK at a time, with the last shard that any of them reaches (-1: none). ``reach``:
    the largest norms of runs of shards, falling."""

    def pack(t: pa.Table, block: int) -> pa.RecordBatch:
        t = t.combine_chunks()
        v = _matrix(t["v"].combine_chunks())
        low, high = (np.asarray(t[c].combine_chunks().flatten(), dtype=np.int64).reshape(len(t), -1) for c in ("low", "high"))
        norms = np.asarray(t["norm"])
        need = np.where(low <= high, low, _MOST).min(axis=1).astype(float)
        some = (low <= high).any(axis=1)
        with np.errstate(over="ignore", invalid="ignore"):
            bound = norms[:, None] * reach[None, :]
            bound = np.where(np.isnan(bound), np.inf, bound * (1 + 1e-9) + 1)
        runs = int(((bound >= need[:, None]) & some[:, None]).any(axis=0).sum())  # falling: the first so many
        last = -(-runs * shards // len(reach)) - 1 if runs else -1
        raw = [np.ascontiguousarray(np.asarray(t[c], dtype=np.int64)).tobytes() for c in ("row", "label")]
        cells = [[block], [len(t)], [raw[0]], [raw[1]], [np.ascontiguousarray(v).tobytes()], [np.ascontiguousarray(low).tobytes()], [np.ascontiguousarray(high).tobytes()], [last]]
        kinds = [pa.int64(), pa.int32(), *[pa.binary()] * 5, pa.int32()]
        return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(cells, kinds, strict=True)], names=["block", "n", "rows", "labels", "v", "low", "high", "last"])

    def run(batches):
        from pyspark import TaskContext

        block = TaskContext.get().partitionId() << 40
        held, n = [], 0
        for batch in batches:
            at = 0
            while at < batch.num_rows:
                part = batch.slice(at, BLOCK - n)
                held.append(part)
                at, n = at + part.num_rows, n + part.num_rows
                if n == BLOCK:
                    yield pack(pa.Table.from_batches(held), block)
                    held, n, block = [], 0, block + 1
        if held:
            yield pack(pa.Table.from_batches(held), block)

    return run


def _ranked(found: DataFrame, k: int) -> DataFrame:
    w = Window.partitionBy("query", "win").orderBy(F.col("score").desc(), "vec_id", "row")
    return found.select("*", F.row_number().over(w).cast("int").alias("rank")).where(F.col("rank") <= k)


def search(packed: DataFrame, reach: np.ndarray, shards: int, queries: DataFrame, n_queries: int, k: int, same: bool) -> DataFrame:
    """query (a row), win, vec_id, row, score, rank: the k best candidates of each window. queries: row, label, v, norm,
    and low and high, arrays of as many numbers as there are windows, the same in all rows."""
    groups = max(1, -(-n_queries // GROUP_QUERIES))
    parts = max(1, min(-(-n_queries // BLOCK), groups * 64))
    need = F.try_divide(F.array_min("low").cast("double"), F.col("norm"))

    def blocks(df: DataFrame) -> DataFrame:
        return df.repartition(parts, F.xxhash64("row")).sortWithinPartitions(need).select("row", "label", "v", "norm", "low", "high").mapInArrow(_blocks(reach, shards), _BLOCKS_DDL)

    grp = F.pmod(F.xxhash64("block"), F.lit(groups)).cast("int")
    none = [F.lit(None).cast("binary").alias(c) for c in ("low", "high")]
    held = packed.select(F.lit(0).alias("kind"), "shard", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("grp"), "bucket", "n", "most", "ids", "rows", "labels", "v", *none)
    blank = [F.lit(None).cast("double").alias("most"), F.lit(None).cast("binary").alias("ids")]

    def answered(b: DataFrame) -> DataFrame:
        asked = b.select(F.lit(1).alias("kind"), "shard", grp.alias("grp"), F.lit(0).alias("bucket"), "n", *blank, "rows", "labels", "v", "low", "high")
        return held.unionByName(asked).repartition("shard", "grp").sortWithinPartitions("shard", "grp", "kind").mapInArrow(_through(k, same), _FOUND_DDL)

    if shards > 1:
        # each block first asks one of the eighth of shards with the longest vectors; k-th scores there are lower limits
        home = F.pmod(F.xxhash64("block", F.lit(3)), F.lit(max(1, shards // 8))).cast("int")
        first = _ranked(answered(blocks(queries).where("last >= 0").select("*", home.alias("shard"))), k)
        kth = first.where(F.col("rank") == k).groupBy("query").agg(F.map_from_entries(F.collect_list(F.struct("win", "score"))).alias("kth"))  # an entry a window
        raised = F.transform("low", lambda x, i: F.coalesce(F.greatest(x, F.try_element_at("kth", i)), x))
        queries = settle(queries.join(kth.withColumnRenamed("query", "row"), "row", "left").withColumn("low", raised).drop("kth"), "hardneg-floors")
    asked = blocks(queries).where("last >= 0").select("*", F.explode(F.sequence(F.lit(0), F.col("last"))).alias("shard"))
    return _ranked(answered(asked), k)


def mine(rows: DataFrame, positives: int = 5, negatives: int = 10, low=(3, 10), high=(9, 10), shards: int | None = None) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score. rows: vec_id and label long, v
    array<double> of whole numbers, is_anchor. A negative's score is at least the low share of the positive's, and at most
    the high share; shares are pairs (numerator, denominator) of positive whole numbers. ``shards``: instead of what
    SHARD_BYTES come to."""
    spark = rows.sparkSession
    known = rows.where("vec_id IS NOT NULL AND label IS NOT NULL AND v IS NOT NULL").select("vec_id", "label", "v", F.coalesce("is_anchor", F.lit(False)).alias("is_anchor"))
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x))
    base = settle(known.select(F.monotonically_increasing_id().alias("row"), "*", norm.alias("norm")), "hardneg-vectors")
    n, n_anchors, width = base.agg(F.count(F.lit(1)), F.count(F.when(F.col("is_anchor"), 1)), F.coalesce(F.max(F.size("v")), F.lit(0))).first()
    if shards is None:
        cores = int(spark.conf.get("spark.sql.shuffle.partitions"))
        shards = max(1, -(-n * 8 * max(width, 1) // SHARD_BYTES), min(cores, n // (8 * BUCKET)))
    packed = buckets(base.drop("is_anchor"), shards)
    runs = packed.agg(F.coalesce(F.max("shard"), F.lit(0)) + 1).first()[0]
    most_runs = min(runs, MOST_RUNS)
    run = F.floor(F.col("shard").cast("long") * most_runs / runs).cast("int")
    tops = {r.run: r.most for r in packed.groupBy(run.alias("run")).agg(F.max("most").alias("most")).collect()}  # at most MOST_RUNS numbers
    reach = np.array([tops.get(i, -np.inf) for i in range(most_runs)])
    reach = np.maximum.accumulate(reach[::-1])[::-1]  # runs that hold nothing
    anchors = base.where("is_anchor").select("row", "vec_id", "label", "v", "norm")
    one = lambda x: F.array(F.lit(x).cast("long"))
    near = search(packed, reach, runs, anchors.select("row", "label", "v", "norm", one(_LEAST).alias("low"), one(_MOST).alias("high")), n_anchors, positives, True)
    pairs = settle(near.select("query", F.col("rank").alias("place"), F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score")), "hardneg-positives")

    # ceil and floor of a share of a whole number, without leaving 64 bits
    def share(x, s, up: bool):
        whole = F.expr(f"positive_score DIV {s[1]}")
        left = x - whole * s[1]  # of the sign of x
        rest = left * s[0]
        cut = F.ceil(rest.cast("double") / s[1]) if up else F.floor(rest.cast("double") / s[1])
        return whole * s[0] + cut.cast("long")

    p = F.col("positive_score")
    limits = pairs.select("query", "place", share(p, low, True).alias("lo"), share(p, high, False).alias("hi"))
    slot = lambda c, empty: F.transform(F.sequence(F.lit(1), F.lit(positives)), lambda i: F.coalesce(F.try_element_at(c, i), F.lit(empty).cast("long")))
    per = limits.groupBy("query").agg(F.map_from_entries(F.collect_list(F.struct("place", "lo"))).alias("los"), F.map_from_entries(F.collect_list(F.struct("place", "hi"))).alias("his"))  # an entry a positive
    windows = per.select(F.col("query").alias("row"), slot("los", _MOST).alias("low"), slot("his", _LEAST).alias("high"))
    far = search(packed, reach, runs, anchors.select("row", "label", "v", "norm").join(windows, "row"), n_anchors, negatives, False)
    named = pairs.join(anchors.select(F.col("row").alias("query"), F.col("vec_id").alias("anchor_id")), "query")
    found = far.select("query", (F.col("win") + 1).alias("place"), "rank", F.col("vec_id").alias("negative_id"), F.col("score").alias("negative_score"))
    return found.join(named, ["query", "place"]).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").select(F.col("vec_id").cast("long").alias("vec_id"), "embedding", F.col("label").cast("long").alias("label"))
    fine = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    known = rows.where(F.col("embedding").isNotNull() & fine)
    return mine(known.select("vec_id", label.alias("label"), quantise(F.col("embedding")).alias("v"), (F.col("vec_id") % 100 == 0).alias("is_anchor")))


SQL = """
WITH e AS MATERIALIZED (
  SELECT row_number() OVER () AS row, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS DOUBLE)) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS MATERIALIZED (
  SELECT q.row, q.vec_id AS anchor_id, e.row AS other, e.vec_id, q.label = e.label AS same, CAST(list_inner_product(q.v, e.v) AS BIGINT) AS score
  FROM e AS q JOIN e ON q.row <> e.row WHERE q.vec_id % 100 = 0
), p AS (
  SELECT *, row_number() OVER (PARTITION BY row ORDER BY score DESC, vec_id, other) AS place FROM s WHERE same
), r AS (
  SELECT p.anchor_id, p.vec_id AS positive_id, s.vec_id AS negative_id, p.score AS positive_score, s.score AS negative_score,
    CAST(row_number() OVER (PARTITION BY p.row, p.place ORDER BY s.score DESC, s.vec_id, s.other) AS INTEGER) AS rank
  FROM p JOIN s ON p.row = s.row AND NOT s.same AND 30 * p.score <= 100 * s.score AND 100 * s.score <= 90 * p.score
  WHERE p.place <= 5
)
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM r WHERE rank <= 10
"""
