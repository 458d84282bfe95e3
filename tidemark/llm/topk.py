"""Exact top-k search by block-at-a-time pruning.

Vectors of whole numbers are cut into blocks of neighbouring ids. A block keeps its forward index (the vectors) and, for
each dimension ("term"), its largest and smallest value; a query's bound for a block is the sum over dimensions of the
larger of weight * max and weight * min. Per query the blocks come in descending order of bound and are scored whole
until the next bound is below the k-th score found: blocks whose bound equals it are still scored, for ties go to the
smaller id.

The corpus is dealt into shards of SHARD_BYTES, each of many blocks. Queries go to shards, not vectors to queries: a shard
is held by one task, through which its queries stream. A first pass takes each query to its own shard; the k-th score there
is a floor under its final one, and the shards tell the extremes of (coarse) blocks. Before the second pass the extremes,
a table of up to ROUTE_BYTES, give each query's bound for each shard, and a query is only sent where that reaches its floor.
Beyond those bytes blocks get coarser, to whole shards, and then all shards are asked. A shard with more than GROUP_QUERIES
queries in all is held by several tasks.

Defined cases: null vectors, vectors with null or non-finite components and rows with a null id take no part; empty
vectors have all products 0; vectors of unequal length are compared with zeros added; every row but the query's own is a
candidate, also those that repeat its id or both id and vector, and each row of a repeated query has its own result; fewer
than k others give all of them; an empty table gives no rows. Components are whole at any size (a double whose 256-fold is
beyond doubles takes the largest double; floats never are) and products are summed in whole numbers; scores are cut to 64
bits, their type.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import settle, table

BLOCK = 128
#: Bytes of a shard as doubles, and queries that one task takes through one.
SHARD_BYTES = 64 << 20
GROUP_QUERIES = 1 << 16
#: Bytes of extremes, by which queries are routed, that are sent to all tasks at most.
ROUTE_BYTES = 32 << 20
#: So many neighbouring ids are dealt to one shard.
RUN = 512
_MOST = float(np.finfo(float).max)


def bounds(queries: np.ndarray, most: np.ndarray, least: np.ndarray) -> np.ndarray:
    """(queries, blocks): no vector of the block has a larger product with the query."""
    return np.maximum(queries, 0) @ most.T + np.minimum(queries, 0) @ least.T


_whole = np.frompyfunc(int, 1, 1)


def _score(q: np.ndarray, v: np.ndarray, exact: bool) -> np.ndarray:
    if exact:
        return (q @ v.T).astype(np.int64)
    whole = _whole(q) @ _whole(v).T
    return np.clip(whole, -(1 << 63), (1 << 63) - 1).astype(np.int64)


def _margins(bound: np.ndarray, q: np.ndarray, most: np.ndarray, least: np.ndarray) -> np.ndarray:
    """Bounds where sums of doubles are rounded: they get a margin in proportion to the terms, and the cut of scores."""
    bound = bound + 1e-9 * (np.abs(q) @ np.maximum(np.abs(most), np.abs(least)).T)
    return np.clip(np.where(np.isnan(bound), np.inf, bound), -(2.0**63), 2.0**63)


def search(q: np.ndarray, own: np.ndarray, q_floor: np.ndarray, v: np.ndarray, k: int, exact: bool, block: int = BLOCK, extremes=None) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """Row of q, row of v and score of the k best of v for each row of q, among those with at least q_floor; and the
    number of (query, block) pairs that were scored. v is sorted by id. own: the row of v that a query leaves out, or -1.
    ``exact``: doubles hold all sums exactly."""
    starts = np.arange(0, len(v), block)
    most, least = extremes or (np.maximum.reduceat(v, starts, axis=0), np.minimum.reduceat(v, starts, axis=0))
    with np.errstate(over="ignore", invalid="ignore"):
        bound = bounds(q, most, least)
        if not exact:
            bound = _margins(bound, q, most, least)
    order = np.argsort(-bound, axis=1, kind="stable")
    n = len(q)
    best = np.full((n, k), np.iinfo(np.int64).min, np.int64)
    rows_of = np.full((n, k), np.iinfo(np.int64).max, np.int64)
    have = np.zeros((n, k), bool)
    kth = q_floor.astype(float)
    alive = np.arange(n)
    scored = 0
    for step in range(len(starts)):
        turn = order[alive, step]
        go = bound[alive, turn] >= kth[alive]
        alive, turn = alive[go], turn[go]
        if not len(alive):
            break
        for b in np.unique(turn):  # the queries whose next block this is share one product
            rows = alive[turn == b]
            part = v[starts[b] : starts[b] + block]
            places = np.arange(starts[b], starts[b] + len(part))
            s = _score(q[rows], part, exact)
            scored += len(rows)
            ok = places[None, :] != own[rows, None]
            if s.shape[1] > k:  # of the block only what reaches its own k-th best can matter
                cut = np.partition(np.where(ok, s, np.iinfo(np.int64).min), s.shape[1] - k, axis=1)[:, s.shape[1] - k]
                ok &= s >= cut[:, None]
            width = max(int(ok.sum(axis=1).max(initial=0)), 1)
            if width < s.shape[1]:
                # the chosen columns first, in order of id
                pick = np.argsort(~ok, axis=1, kind="stable")[:, :width]
                s, ok = np.take_along_axis(s, pick, 1), np.take_along_axis(ok, pick, 1)
                new = places[pick]
            else:
                new = np.broadcast_to(places, s.shape)
            all_s = np.concatenate([best[rows], s], axis=1)
            all_i = np.concatenate([rows_of[rows], new], axis=1)
            all_h = np.concatenate([have[rows], ok], axis=1)
            rank = np.lexsort((all_i, -all_s.astype(float) if exact else _down(all_s), ~all_h), axis=1)[:, :k]
            best[rows], rows_of[rows], have[rows] = (np.take_along_axis(x, rank, 1) for x in (all_s, all_i, all_h))
            kth[rows] = np.maximum(q_floor[rows], np.where(have[rows, k - 1], best[rows, k - 1], -np.inf))
    at, col = np.nonzero(have)
    return at, rows_of[at, col], best[at, col], scored


def _down(s: np.ndarray) -> np.ndarray:
    return ~s  # descending order without overflow


def _matrix(column: pa.Array) -> np.ndarray:
    n = len(column)
    if not n:
        return np.zeros((0, 0))
    lengths = np.diff(np.asarray(column.offsets))
    flat = np.asarray(column.flatten(), dtype=float)
    if (lengths == lengths[0]).all():
        return flat.reshape(n, -1)
    out = np.zeros((n, int(lengths.max())))
    out[np.arange(out.shape[1])[None, :] < lengths[:, None]] = flat
    return out


def _wide(a: np.ndarray, width: int) -> np.ndarray:
    return a if a.shape[1] == width else np.pad(a, ((0, 0), (0, width - a.shape[1])))


_OUT = pa.schema([("query", pa.int64()), ("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64()), ("copies", pa.int64()), ("shard", pa.int32()), ("most", pa.list_(pa.float64())), ("least", pa.list_(pa.float64()))])
_OUT_DDL = "query long, query_id long, vec_id long, score long, copies long, shard int, most array<double>, least array<double>"
_NONE = np.iinfo(np.int64).min


class _Shard:
    """The vectors of a shard in order of id, with the extremes of their blocks."""

    def __init__(self, t: pa.Table):
        t = t.combine_chunks()
        ids, rows = np.asarray(t["vec_id"]), np.asarray(t["row"])
        by = np.lexsort((rows, ids))
        self.ids, self.rows, self.copies = ids[by], rows[by], np.asarray(t["copies"])[by]
        self.v = _matrix(t["v"].combine_chunks())[by]
        self.by_row = np.argsort(self.rows)

    def extremes(self, block: int) -> tuple[np.ndarray, np.ndarray]:
        starts = np.arange(0, len(self.v), block)
        return np.maximum.reduceat(self.v, starts, axis=0), np.minimum.reduceat(self.v, starts, axis=0)

    def answer(self, t: pa.RecordBatch, k: int) -> pa.RecordBatch:
        q, rows = _matrix(t.column("v")), np.asarray(t.column("row"))
        width = max(q.shape[1], self.v.shape[1], 1)
        if self.v.shape[1] < width:
            self.v = _wide(self.v, width)
        q = _wide(q, width)
        place = self.by_row[np.minimum(np.searchsorted(self.rows[self.by_row], rows), len(self.rows) - 1)]
        here = self.rows[place] == rows
        own = np.where(here & (self.copies[place] == 1), place, -1)
        exact = float(np.abs(q).max(initial=0)) * float(np.abs(self.v).max(initial=0)) * width < 2**53
        floor = np.asarray(t.column("floor").fill_null(_NONE))
        at, got, score, _ = search(q, own, floor, self.v, k, exact)
        copies = self.copies[got] - (here[at] & (place[at] == got))
        n = len(at)
        return pa.RecordBatch.from_arrays(
            [pa.array(x) for x in (rows[at], np.asarray(t.column("vec_id"))[at], self.ids[got], score, copies)] + [pa.nulls(n, f.type) for f in list(_OUT)[5:]], schema=_OUT
        )


def _through_shards(k: int, coarse: int):
    """Rows come by (shard, grp, kind): vectors (kind 0), then queries, which stream through. ``coarse``: extremes of so
    many rows at a time are told as well, if it isn't 0."""

    def run(batches):
        held, shard, key = [], None, None
        for batch in batches:
            shards, groups, kinds = (np.asarray(batch.column(c)).astype(np.int64) for c in ("shard", "grp", "kind"))
            name = (shards << 34) | (groups << 2) | kinds
            cuts = [0, *(np.flatnonzero(name[1:] != name[:-1]) + 1).tolist(), batch.num_rows]
            for a, b in zip(cuts, cuts[1:]):
                if a == b:
                    continue
                part = batch.slice(a, b - a)
                if (shards[a], groups[a]) != key:
                    held, shard, key = [], None, (shards[a], groups[a])
                if kinds[a] == 0:
                    held.append(part)
                    continue
                if shard is None:
                    if not held:
                        continue
                    shard, held = _Shard(pa.Table.from_batches(held)), []
                for i in range(0, b - a, 1024):
                    yield shard.answer(part.slice(i, 1024), k)

    def told(batches):
        """The extremes alone."""
        held, key = [], None

        def tell(key, held):
            most, least = _Shard(pa.Table.from_batches(held)).extremes(coarse)
            n = len(most)
            arrays = [pa.nulls(n, f.type) for f in list(_OUT)[:5]] + [pa.array(np.full(n, key, np.int32)), pa.array(most.tolist(), pa.list_(pa.float64())), pa.array(least.tolist(), pa.list_(pa.float64()))]
            return pa.RecordBatch.from_arrays(arrays, schema=_OUT)

        for batch in batches:
            shards = np.asarray(batch.column("shard"))
            cuts = [0, *(np.flatnonzero(shards[1:] != shards[:-1]) + 1).tolist(), batch.num_rows]
            for a, b in zip(cuts, cuts[1:]):
                if a == b:
                    continue
                if key is not None and shards[a] != key:
                    yield tell(key, held)
                    held = []
                key = int(shards[a])
                held.append(batch.slice(a, b - a))
        if held:
            yield tell(key, held)

    return told if coarse else run


def _router(shards: np.ndarray, most: np.ndarray, least: np.ndarray):
    """Each query with the shards, but its own, that have a block whose bound reaches its floor."""
    width = most.shape[1]

    def run(batches):
        for batch in batches:
            for i in range(0, batch.num_rows, 1024):
                t = batch.slice(i, 1024)
                q = _matrix(t.column("v"))
                q = _wide(q, max(width, q.shape[1]))
                hi, lo = _wide(most, q.shape[1]), _wide(least, q.shape[1])
                with np.errstate(over="ignore", invalid="ignore"):
                    bound = _margins(bounds(q, hi, lo), q, hi, lo)
                floor = np.asarray(t.column("floor").fill_null(_NONE)).astype(float)
                at, block = np.nonzero((bound >= floor[:, None]) & (shards[None, :] != np.asarray(t.column("home"))[:, None]))
                if len(at):
                    pairs = np.unique(np.stack([at, shards[block]]), axis=1)
                    rest = t.take(pa.array(pairs[0]))
                    yield pa.RecordBatch.from_arrays([*rest.columns, pa.array(pairs[1].astype(np.int32))], names=[*rest.schema.names, "shard"])

    return run


def _kth(found: DataFrame, k: int) -> DataFrame:
    w = Window.partitionBy("query").orderBy(F.col("score").desc(), "vec_id")
    return found.select("*", F.row_number().over(w).cast("int").alias("rank")).where(F.col("rank") <= k)


def quantise(embedding):
    """floor(256 * x), x as double; doubles from 2^53 on are whole."""

    def one(x):
        y = F.greatest(F.lit(-_MOST), F.least(F.lit(_MOST), x.cast("double") * 256))
        return F.when(F.abs(y) < float(1 << 53), F.floor(y).cast("double")).otherwise(y)

    return F.transform(embedding, one)


def top_k(vectors: DataFrame, queries_where, k: int = 5, shard_rows: int | None = None, group_queries: int = GROUP_QUERIES, route_bytes: int = ROUTE_BYTES) -> DataFrame:
    """query_id, rank, vec_id, score. vectors: vec_id long, v array<double> of whole numbers. ``shard_rows``: instead of
    what SHARD_BYTES come to."""
    spark = vectors.sparkSession
    known = vectors.select("vec_id", "v").where("vec_id IS NOT NULL AND v IS NOT NULL")
    # rows that repeat id and vector are one, with a number
    distinct = known.groupBy("vec_id", "v").agg(F.count(F.lit(1)).alias("copies"))
    base = settle(distinct.select(F.monotonically_increasing_id().alias("row"), "vec_id", "v", "copies", queries_where.alias("is_query"), F.floor(F.col("vec_id") / RUN).alias("run")), "topk-vectors")
    n, n_queries, width = base.agg(F.count(F.lit(1)), F.count(F.when(F.col("is_query"), 1)), F.coalesce(F.max(F.size("v")), F.lit(0))).first()
    rows = shard_rows or max(BLOCK, SHARD_BYTES // (8 * max(width, 1)))
    shards = max(1, -(-n // rows), 1 if shard_rows else min(int(spark.conf.get("spark.sql.shuffle.partitions")), n // (8 * RUN)))
    groups = max(1, -(-n_queries // group_queries))
    # runs of neighbouring ids stay together and are dealt evenly, however the ids are spread; an id of many rows is split
    longest = base.groupBy("run").agg(F.count(F.lit(1)).alias("c")).agg(F.max("c")).first()[0] or 0
    salts = F.lit(-(-longest // (2 * RUN)) or 1)
    shard = F.pmod(F.xxhash64("run", F.pmod(F.xxhash64("row"), salts)), F.lit(shards)).cast("int")
    group = F.pmod(F.xxhash64("row"), F.lit(groups)).cast("int")
    dealt = base.select("row", "vec_id", "v", "copies", "is_query", shard.alias("shard"), group.alias("grp"))
    none = F.lit(None).cast("long")
    q = dealt.where("is_query")
    vs = dealt.select(F.lit(0).alias("kind"), "row", "vec_id", "v", "copies", none.alias("floor"), "shard", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("grp"))

    def answered(qs: DataFrame) -> DataFrame:
        both = vs.unionByName(qs.select(F.lit(1).alias("kind"), "row", "vec_id", "v", "copies", "floor", "shard", "grp"))
        return both.repartition("shard", "grp").sortWithinPartitions("shard", "grp", "kind").mapInArrow(_through_shards(k, 0), _OUT_DDL)

    first = answered(q.withColumn("floor", none))
    if shards == 1:
        found = first
    else:
        first = settle(first, "topk-home")
        floors = _kth(first, k).where(F.col("rank") == k).select(F.col("query").alias("row"), F.col("score").alias("floor"))
        waiting = q.join(floors, "row", "left").withColumnRenamed("shard", "home")
        per = max(1, route_bytes // (16 * max(width, 1) * shards))  # blocks of a shard
        if 16 * max(width, 1) * shards * per <= route_bytes:
            coarse = max(BLOCK, -(-4 * rows // per))  # a shard has up to about 4 times its share
            lines = dealt.select("row", "vec_id", "v", "copies", "shard").repartition("shard").sortWithinPartitions("shard").mapInArrow(_through_shards(k, coarse), _OUT_DDL).select("shard", "most", "least").collect()
            named = np.array([r.shard for r in lines], np.int32)
            most, least = (_matrix(pa.array([r[c] for r in lines], pa.list_(pa.float64()))) for c in ("most", "least"))
            routed = waiting.mapInArrow(_router(named, most, least), T.StructType([*waiting.schema.fields, T.StructField("shard", T.IntegerType())]))
        else:
            routed = waiting.select("*", F.explode(F.filter(F.sequence(F.lit(0), F.lit(shards - 1)), lambda s: s != F.col("home"))).alias("shard"))
        found = first.unionByName(answered(routed))
    # a row of found stands for copies rows, and a query for as many as it has
    some = found.where("copies > 0").select("query", "query_id", "vec_id", "score", F.explode(F.sequence(F.lit(1).cast("long"), F.least("copies", F.lit(k).cast("long")))))
    best = _kth(some, k)
    again = q.where("copies > 1").select(F.col("row").alias("query"), F.explode(F.sequence(F.lit(2).cast("long"), "copies")))
    return best.unionByName(best.join(again.select("query"), "query").select(*best.columns)).select("query_id", "rank", "vec_id", "score")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select(F.col("vec_id").cast("long").alias("vec_id"), "embedding")
    fine = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    ok = vectors.where(F.col("embedding").isNotNull() & fine).select("vec_id", quantise(F.col("embedding")).alias("v"))
    return top_k(ok, F.col("vec_id") % 50 == 0)


SQL = """
WITH e AS MATERIALIZED (
  SELECT row_number() OVER () AS row, vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS DOUBLE)) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.row, q.vec_id AS query_id, e.vec_id, CAST(list_inner_product(q.v, e.v) AS BIGINT) AS score
  FROM e AS q JOIN e ON q.row <> e.row WHERE q.vec_id % 50 = 0
), r AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY row ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""
