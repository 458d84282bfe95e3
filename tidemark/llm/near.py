"""MinHash near-dedup by a chosen-path set similarity join.

Each set has 64 minwise values. A tree starts with all sets in one node; at a node, coordinates picked by a hash of the
node send each set to the child of its value there, so a set follows several paths, and sets of similarity s share a
child with probability s for each pick. Where a path leads depends on the set alone, so all paths of all trees down to
the first depth come from one pass over the texts. Nodes of up to NODE_MOST sets are compared exhaustively by sketches;
larger ones branch on. Trees are repeated; since all pick from the same 64 values, a pair at the threshold is missed with
a probability of 2.2e-5, and of 9e-5 below nodes that branch on for REFINE levels (see ``shared_miss``).

Pairs alike by sketch only tie sets into clusters (a spanning forest, never all pairs); links come from the full sets.
A cluster is cut into blocks of up to BLOCK sets; each block is compared in itself and with a few pivots of its
cluster, pairs that are already connected being skipped. What is then outside the largest component of its cluster is
compared with all other blocks of it. So components are those of the full link graph, without pairs within groups of
copies. Nodes that stay too large after REFINE more levels, or that hardly shrink by one, become clusters as wholes:
the same exact way handles them.

Vertices are sets, named by 128 bits of hash; a set's copies never meet anywhere but in sums. Keys that many rows share
(nodes, stars, components, copies) are joined where their rows are (``common.join_counted``).

Defined cases: null and empty texts, and texts of white space, have empty sets and stay alone; equal sets are one
vertex; rows that share an id only are vertices of their own, each with its component; rows with a null id take no part
(component null); an empty table gives no rows; other columns pass through ``dedup``, which keeps one row of each
component: that of the smallest id, of rows that share this id that of least hash of the text, and of rows that repeat
both that of least hash of all columns; of rows without words it keeps one for each id and text.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bytes_of, join_counted, mix64, settle, spread, table
from .graph import components
from .shingles import MINS, minima, set_keys, sets

TREES = 6
#: Picks per node on each level, at any number of sets; nodes that are still large branch on by 2.
PICKS = (2, 2, 1)
NODE_MOST = 512
REFINE = 3
#: A child with more than this share of a large node is not branched on: it becomes a cluster as a whole.
DENSE = 0.6
BLOCK = 256
PIVOTS = 4
#: Of MINS values, how many agree at least where sets may be linked: a linked pair has fewer with probability 4.2e-6.
AGREE = 36
#: Ids whose texts are compared, sent to all tasks that read texts, at most (some 4 MB).
SENT_IDS = 250_000
_PIECE = 1 << 20


def miss_probability(s: float, picks: tuple[int, ...] = PICKS, trees: int = TREES) -> float:
    """Of a pair of similarity s sharing no node at the first depth, if each tree had minwise values of its own."""
    q = 0.0
    for b in reversed(picks):
        q = (1 - s * (1 - q)) ** b
    return q**trees


def shared_miss(s: float, picks: tuple[int, ...] = PICKS, trees: int = TREES) -> float:
    """The same where all trees pick from the same MINS values, of which a share agrees that is s on average only. Levels
    of refinement count as further picks of 2."""
    return sum(math.comb(MINS, k) * s**k * (1 - s) ** (MINS - k) * miss_probability(k / MINS, picks, trees) for k in range(MINS + 1))


def sketch_miss(s: float) -> float:
    """Of a pair of similarity s agreeing in fewer than AGREE of MINS values."""
    return sum(math.comb(MINS, k) * s**k * (1 - s) ** (MINS - k) for k in range(AGREE))


def leaves(mins: np.ndarray, picks: tuple[int, ...], trees: int) -> np.ndarray:
    """(sets, paths): names of the nodes at the first depth."""
    n = len(mins)
    out = []
    rows = np.arange(n)
    with np.errstate(over="ignore"):
        for tree in range(trees):
            paths = [np.full(n, mix64(np.array([tree + 77], np.uint64))[0], np.uint64)]
            for level, b in enumerate(picks):
                ahead = []
                for node in paths:
                    first = (mix64(node ^ np.uint64(level * 1009 + 1)) % np.uint64(MINS)).astype(np.int64)
                    for pick in range(b):
                        # the picks of a node differ
                        at = (first + pick * (MINS // 2 - 5)) % MINS
                        token = mins[rows, at].astype(np.uint64) + (at.astype(np.uint64) << np.uint64(32))
                        ahead.append(mix64(node + mix64(token)))
                paths = ahead
            out += paths
    return np.stack(out, axis=1)


def sketch(mins: np.ndarray) -> np.ndarray:
    return (mins & np.uint32(255)).astype(np.uint8)


def _lots(batches, *names: str) -> Iterator[tuple]:
    """Slices of about 1 MB of text or one row, with their bytes and offsets."""
    for batch in batches:
        raw, offsets = bytes_of(batch.column("text"))
        at = 0
        while at < batch.num_rows:
            end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + _PIECE, "right")) - 1)
            yield batch.slice(at, end - at), raw[offsets[at] : offsets[end]], offsets[at : end + 1] - offsets[at]
            at = end


def _signed(a: np.ndarray) -> pa.Array:
    return pa.array(a.astype(np.uint64).view(np.int64))


def _keys(values: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two independent 64-bit names of each set, as signed numbers; 0 for the empty set."""
    one, two = set_keys(values, at)
    full = np.diff(at) > 0
    return tuple(np.where(full, mix64(x + np.uint64(k)), 0).astype(np.uint64).view(np.int64) for k, x in enumerate((one, two)))


def profile(docs: DataFrame, k: int, picks: tuple[int, ...], trees: int) -> DataFrame:
    """doc_id, mark, n (set size), key, key2, sketch, leaves. docs: doc_id, mark, text."""
    schema = "doc_id long, mark long, n long, key long, key2 long, sketch binary, leaves array<long>"

    def run(batches):
        for part, raw, offsets in _lots(batches):
            values, at = sets(raw, offsets, k)
            key, key2 = _keys(values, at)
            mins = minima(values, at)
            paths = leaves(mins, picks, trees)
            n, width = paths.shape
            lists = pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * width), _signed(paths.ravel()))
            flat = sketch(mins).tobytes()
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), part.column("mark"), pa.array(np.diff(at), pa.int64()), pa.array(key), pa.array(key2), pa.array([flat[i * MINS : (i + 1) * MINS] for i in range(n)], pa.binary()), lists],
                names=["doc_id", "mark", "n", "key", "key2", "sketch", "leaves"],
            )

    return docs.mapInArrow(run, schema)


def _least_labels(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Label of each of n vertices under edges (a, b): the smallest vertex of its component."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[a], label[b])
        before = label.copy()
        np.minimum.at(label, a, low)
        np.minimum.at(label, b, low)
        label = label[label]
        if (label == before).all():
            return label


def _sketch_edges(node: np.ndarray, vertex: np.ndarray, n: np.ndarray, s: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Spanning forests of the pairs alike by sketch within each node. Rows are sorted by node."""
    m = len(node)
    ends = np.searchsorted(node, node, "right")
    found_a, found_b = [], []
    rows = np.arange(m)
    d = 1
    rows = rows[rows + d < ends[rows]]
    while len(rows):
        other = rows + d
        lo, hi = np.minimum(n[rows], n[other]), np.maximum(n[rows], n[other])
        ok = 5 * lo >= 4 * hi
        a, b = rows[ok], other[ok]
        for i in range(0, len(a), 65536):
            x, y = a[i : i + 65536], b[i : i + 65536]
            like = (s[x] == s[y]).sum(axis=1) >= AGREE
            found_a.append(x[like])
            found_b.append(y[like])
        d += 1
        rows = rows[rows + d < ends[rows]]
    if not found_a:
        return vertex[:0], vertex[:0]
    label = _least_labels(m, np.concatenate(found_a), np.concatenate(found_b))
    tied = np.flatnonzero(label != np.arange(m))
    return vertex[tied], vertex[label[tied]]


def _whole_groups(batches, keys: tuple[str, ...], rows_at_once: int) -> Iterator[pa.Table]:
    """Tables of neighbouring batches cut where the keys change, each of about ``rows_at_once`` rows, 64 MB or one group."""
    held: list[pa.RecordBatch] = []
    count = 0

    def cut(t: pa.Table) -> int:
        """Where the last group begins."""
        last = t.num_rows - 1
        start = 0
        for k in keys:
            c = np.asarray(t[k])
            differ = np.flatnonzero(c != c[last])
            start = max(start, int(differ[-1]) + 1 if len(differ) else 0)
        return start

    for batch in batches:
        if batch.num_rows:
            held.append(batch)
            count += max(batch.num_rows, batch.nbytes * rows_at_once >> 26)
        if count >= rows_at_once:
            t = pa.Table.from_batches(held).combine_chunks()
            at = cut(t)
            if at:
                yield t.slice(0, at).combine_chunks()
            rest = t.slice(at).combine_chunks()
            held, count = rest.to_batches(), rest.num_rows if at else 0
            if not at:  # one long group: wait for more rows
                held, count = t.to_batches(), 0
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def _sketches(column) -> np.ndarray:
    raw, offsets = bytes_of(column)
    return raw.reshape(-1, MINS)


_EDGE = pa.schema([("u", pa.int64()), ("v", pa.int64())])


def _compare_nodes(batches):
    for t in _whole_groups(batches, ("leaf",), 20_000):
        u, v = _sketch_edges(np.asarray(t["leaf"]), np.asarray(t["v"]), np.asarray(t["n"]), _sketches(t["sketch"]))
        pairs = np.unique(np.stack([u, v]), axis=1) if len(u) else np.zeros((2, 0), np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(pairs[0]), pa.array(pairs[1])], schema=_EDGE)


def tree_edges(vertices: DataFrame) -> DataFrame:
    """(u, v): ties between sets that may be linked. vertices: v, n, sketch, leaves."""
    rows = vertices.select(F.explode("leaves").alias("leaf"), "v", F.lit(None).cast("long").alias("above"))
    marks = settle(vertices.select("v", "n", "sketch"), "near-marks")
    out = None
    for level in range(REFINE + 1):
        if level:
            rows = settle(rows, "near-paths")
        counts = settle(rows.groupBy("leaf").agg(F.count(F.lit(1)).alias("c"), F.min("v").alias("head")).where("c > 1"), "near-counts")
        many = settle(join_counted(rows, counts, "leaf"), "near-nodes")
        full = many.where(F.col("c") <= NODE_MOST).join(marks, "v").select("leaf", "v", "n", "sketch")
        got = full.repartition("leaf").sortWithinPartitions("leaf", "v").mapInArrow(_compare_nodes, "u long, v long")
        out = got if out is None else out.unionAll(got)
        large = many.where(F.col("c") > NODE_MOST)
        if large.isEmpty():
            return out
        # most of the node above took the same path: sets much alike, which more picks would copy and not part
        whole = large if level == REFINE else large.where(F.col("c") > DENSE * F.col("above"))
        if level:
            out = out.unionAll(whole.select(F.col("v").alias("u"), F.col("head").alias("v")))
        if level == REFINE:
            return out
        # two more picks, by the bytes of the sketch
        pick = lambda j: F.pmod(F.xxhash64("leaf", F.lit(level), F.lit(j)), F.lit(MINS)).cast("int")
        child = lambda j: F.xxhash64("leaf", pick(j), F.substring("sketch", pick(j) + 1, F.lit(1)))
        sparse = large.where(F.coalesce(F.col("c") <= DENSE * F.col("above"), F.lit(True)))
        rows = sparse.select("v", "leaf", "c").join(marks, "v").select(F.explode(F.array_distinct(F.array(child(0), child(1)))).alias("leaf"), "v", F.col("c").alias("above"))
    return out


def _linked(x: np.ndarray, y: np.ndarray) -> bool:
    """Jaccard similarity of two ascending arrays is at least 0.8, in whole numbers."""
    if 5 * min(len(x), len(y)) < 4 * max(len(x), len(y)):
        return False
    if len(x) > len(y):
        x, y = y, x
    at = np.searchsorted(y, x)
    at[at == len(y)] = 0
    both = int((y[at] == x).sum())
    return 100 * both >= 80 * (len(x) + len(y) - both)


def link_block(members: list[np.ndarray], marks: np.ndarray, side: np.ndarray, comp: np.ndarray) -> list[tuple[int, int]]:
    """Links that connect what ``comp`` doesn't yet, between members of different or equal side as ``side`` says:
    rows of side 2 meet rows of side 1 only, rows of side 0 all rows. Each pair alike by sketch is verified on the full
    sets unless its ends are connected already; the most alike come first."""
    m = len(members)
    sizes = np.array([len(x) for x in members])
    parent = list(range(m))

    def root(i):
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    first: dict[int, int] = {}
    for i, c in enumerate(comp.tolist()):
        parent[i] = first.setdefault(c, i)
    out = []
    pairs_a, pairs_b, likes = [], [], []
    for i in range(1, m):
        ok = (5 * np.minimum(sizes[:i], sizes[i]) >= 4 * np.maximum(sizes[:i], sizes[i])) & (comp[:i] != comp[i])
        if side[i]:
            ok &= side[:i] != side[i]
        js = np.flatnonzero(ok)
        if len(js):
            like = (marks[js] == marks[i]).sum(axis=1)
            keep = like >= AGREE
            pairs_a.append(np.full(int(keep.sum()), i))
            pairs_b.append(js[keep])
            likes.append(like[keep])
    if not pairs_a:
        return out
    a, b, like = np.concatenate(pairs_a), np.concatenate(pairs_b), np.concatenate(likes)
    order = np.argsort(-like, kind="stable")
    for i, j in zip(a[order].tolist(), b[order].tolist()):
        x, y = root(i), root(j)
        if x != y and _linked(members[i], members[j]):
            parent[max(x, y)] = min(x, y)
            out.append((i, j))
    return out


def _link_groups(k: int):
    """Verified links within each (cluster, block, other): rows carry text, v, key, key2, side and comp."""

    def group(t: pa.Table) -> list[tuple[int, int]]:
        raw, offsets = bytes_of(t["text"])
        members, marks, keys, keys2 = [], [], [], []
        at = 0
        while at < t.num_rows:
            end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + _PIECE, "right")) - 1)
            values, place = sets(raw[offsets[at] : offsets[end]], offsets[at : end + 1] - offsets[at], k)
            one, two = _keys(values, place)
            keys.append(one)
            keys2.append(two)
            marks.append(sketch(minima(values, place)))
            members += [values[place[i] : place[i + 1]] for i in range(end - at)]
            at = end
        v, comp, side = (np.asarray(t[c]) for c in ("v", "comp", "side"))
        own = np.flatnonzero((np.concatenate(keys) == np.asarray(t["key"])) & (np.concatenate(keys2) == np.asarray(t["key2"])))  # else another text with this id
        if len(own) < 2:
            return []
        found = link_block([members[i] for i in own], np.concatenate(marks)[own], side[own], comp[own])
        return [(int(v[own[i]]), int(v[own[j]])) for i, j in found]

    def run(batches):
        for t in _whole_groups(batches, ("cluster", "block", "other"), 2 * BLOCK):
            ids = np.stack([np.asarray(t[c]) for c in ("cluster", "block", "other")])
            edges = np.flatnonzero((ids[:, 1:] != ids[:, :-1]).any(axis=0)) + 1
            out = []
            for a, b in zip([0, *edges.tolist()], [*edges.tolist(), t.num_rows]):
                if b - a > 1:
                    out += group(t.slice(a, b - a))
            yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in out], pa.int64()), pa.array([y for _, y in out], pa.int64())], schema=_EDGE)

    return run


def _labelled(docs: DataFrame, k: int) -> DataFrame:
    """doc_id, mark (hash of the text), n (set size), label (of the component; none for empty sets and null ids) and
    component (its smallest id): one row a row of docs."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("mark"), "text")
    base = settle(profile(docs, k, PICKS, TREES), "near-profile")
    some, name = base.where("n > 0 AND doc_id IS NOT NULL"), ["key", "key2"]
    distinct = some.groupBy(*name).agg(F.min(F.struct("doc_id", "mark")).alias("r"), F.first("n").alias("n"), F.first("sketch").alias("sketch"), F.first("leaves").alias("leaves"))
    # a set's text is that of one row: of its id and its own text's hash, for other texts may have this id
    named = distinct.select(*name, F.col("r.doc_id").alias("rep"), F.col("r.mark").alias("rep_mark"), "n", "sketch", "leaves")
    vertices = settle(named.withColumn("v", F.monotonically_increasing_id()), "near-vertices")
    ties = components(tree_edges(vertices))
    labels = settle(ties.unionAll(ties.select(F.col("label").alias("node"), "label").distinct()), "near-clusters")

    size = labels.groupBy("label").agg(F.count(F.lit(1)).alias("size"))
    blocks = F.ceil(F.col("size") / BLOCK).cast("int")
    clustered = join_counted(labels, settle(size, "near-sizes"), "label", "size")
    placed = clustered.select(F.col("node").alias("v"), F.col("label").alias("cluster"), blocks.alias("blocks"), F.pmod(F.xxhash64("node"), blocks).cast("int").alias("block"))
    keyed = settle(placed.join(vertices.select("v", "rep", "rep_mark", *name), "v"), "near-placed")
    wide = keyed.where("blocks > 1")
    pivots = wide.groupBy("cluster", "blocks", F.pmod(F.xxhash64("v", F.lit(5)), F.lit(PIVOTS)).alias("p")).agg(F.min(F.struct(F.xxhash64("v", F.lit(6)).alias("h"), "v", "rep", "rep_mark", *name, "block")).alias("x"))
    lent = pivots.select("cluster", "x.*", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("guest")).where("guest != block")
    zero, who = F.lit(0), ["v", "rep", "rep_mark", *name]
    tasks = keyed.select(*who, "cluster", "block").unionAll(lent.select(*who, "cluster", F.col("guest").alias("block")))
    tasks = tasks.select(*who, "cluster", "block", zero.alias("other"), zero.alias("side"), F.col("v").alias("comp"))

    def verified(tasks: DataFrame) -> DataFrame:
        # each text is sent once to its id's tasks, which then split it up
        texts, ids = docs.select(F.col("doc_id").alias("rep"), F.col("mark").alias("rep_mark"), "text"), tasks.select("rep", "rep_mark").distinct()
        if ids.limit(SENT_IDS + 1).count() <= SENT_IDS:  # else texts are left out by the join itself
            texts = texts.join(F.broadcast(ids), ["rep", "rep_mark"], "left_semi")
        per = texts.join(tasks, ["rep", "rep_mark"])
        dealt = per.repartition("cluster", "block", "other").sortWithinPartitions("cluster", "block", "other", "v")
        return dealt.select("cluster", "block", "other", "v", *name, "side", "comp", "text").mapInArrow(_link_groups(k), "u long, v long")

    links = settle(verified(tasks.hint("merge")), "near-links")  # alike at any size; what follows is of few rows
    joined = components(links)
    if not wide.isEmpty():
        # clusters of several blocks: what is outside the largest component meets all blocks
        of = wide.join(joined, wide.v == joined.node, "left").select(*who, "cluster", "blocks", "block", F.coalesce("label", "v").alias("comp"))
        of = settle(of, "near-wide")
        parts = of.groupBy("cluster", "comp").agg(F.count(F.lit(1)).alias("c"))
        most = settle(parts.groupBy("cluster").agg(F.max(F.struct("c", "comp")).alias("x"), F.sum("c").alias("c")).select("cluster", F.col("x.comp").alias("main"), (F.col("c") - F.col("x.c")).alias("left"), "c"), "near-main")
        rest = settle(join_counted(of, most, "cluster").where("comp != main").select(*of.columns), "near-rest")
        if not rest.isEmpty():
            lots = most.where("left > 0").select("cluster", F.ceil(F.col("left") / BLOCK).cast("int").alias("lots"), "c")
            out = join_counted(rest, lots, "cluster").select(*who, "cluster", F.explode(F.sequence(zero, F.col("blocks") - 1)).alias("block"), (F.pmod(F.xxhash64("v", F.lit(9)), F.col("lots")) + 1).cast("int").alias("other"), F.lit(2).alias("side"), "comp")
            whole = join_counted(of, lots, "cluster").select(*who, "cluster", "block", F.explode(F.sequence(F.lit(1), F.col("lots"))).alias("other"), F.lit(1).alias("side"), "comp")
            links = links.unionAll(verified(whole.unionAll(out)))
            joined = components(links)
    of = settle(vertices.select("v", "rep", *name).join(joined, F.col("v") == F.col("node"), "left").select(*name, "rep", F.coalesce("label", "v").alias("label")), "near-labels")
    least = settle(of.groupBy("label").agg(F.min("rep").alias("component"), F.count(F.lit(1)).alias("c")), "near-least")
    vertex = settle(join_counted(of, least, "label").select(*name, "label", "component"), "near-components")
    got = some.select("doc_id", "mark", "n", *name).join(vertex, name).select("doc_id", "mark", "n", "label", "component")
    # null ids and empty sets are alone
    none = base.where("n = 0 OR doc_id IS NULL").select("doc_id", "mark", "n", F.lit(None).cast("long").alias("label"), F.col("doc_id").alias("component"))
    return got.unionAll(none)


def link_components(docs: DataFrame, k: int = 2) -> DataFrame:
    """doc_id, n_shingles, component_id: one row a row of docs."""
    return _labelled(docs, k).select("doc_id", F.col("n").alias("n_shingles"), F.col("component").alias("component_id"))


def dedup(docs: DataFrame, k: int = 5) -> DataFrame:
    """One row of each component, and all rows with null ids."""
    names = docs.columns
    first = _labelled(docs.select("doc_id", "text"), k).where("doc_id = component")
    kept = settle(first.groupBy("doc_id", "label", F.when(F.col("label").isNull(), F.col("mark")).alias("own")).agg(F.min("mark").alias("mark")).select(F.col("doc_id").alias("_id"), F.col("mark").alias("_mark")).distinct(), "near-kept")
    rows = docs.select(F.struct(*[docs[c] for c in names]).alias("row"), docs["doc_id"].cast("long").alias("id"), F.xxhash64(docs["text"]).alias("mark"), F.xxhash64(*[docs[c] for c in names]).alias("h"))
    # by sorted merge at any size: rows are then in place for the window, one shuffle of the texts in all
    both = rows.join(kept.hint("merge"), (rows["id"] == kept["_id"]) & (rows["mark"] == kept["_mark"]), "left_semi")
    both = both.withColumn("nth", F.row_number().over(Window.partitionBy("id", "mark").orderBy("h"))).where("nth = 1")
    return both.select("row").unionAll(rows.where("id IS NULL").select("row")).select(*[F.col("row").getField(c).alias(c) for c in names])


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = link_components(spread(table(spark, sf_dir, "documents").select("doc_id", "text")), 2)
    return got.select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), s AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) = 1 THEN w
    ELSE list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) END AS s FROM w
), n AS (
  SELECT doc_id, CAST(len(s) AS BIGINT) AS n FROM s
), x AS (
  SELECT doc_id, unnest(s) AS g FROM s
), rare AS (
  SELECT x.doc_id, x.g, row_number() OVER (PARTITION BY x.doc_id ORDER BY c, x.g) AS r, n.n
  FROM x JOIN (SELECT g, count(*) AS c FROM x GROUP BY g) USING (g) JOIN n USING (doc_id)
), prefix AS (
  SELECT doc_id, g FROM rare WHERE r <= n - ceil(0.8 * n) + 1
), candidates AS (
  SELECT DISTINCT a.doc_id AS a, b.doc_id AS b FROM prefix AS a JOIN prefix AS b ON a.g = b.g AND a.doc_id < b.doc_id
), links AS (
  SELECT a, b FROM candidates JOIN x AS p ON p.doc_id = a JOIN x AS q ON q.doc_id = b AND q.g = p.g
    JOIN n AS m ON m.doc_id = a JOIN n AS o ON o.doc_id = b
  GROUP BY a, b HAVING 100 * count(*) >= 80 * (any_value(m.n) + any_value(o.n) - count(*))
), e AS (
  SELECT a, b FROM links UNION ALL SELECT b, a FROM links
), reach AS (
  SELECT doc_id AS a, doc_id AS b FROM n UNION SELECT reach.a, e.b FROM reach JOIN e ON reach.b = e.a
)
SELECT n.doc_id, n.n AS n_shingles, min(reach.b) AS component_id, n.doc_id = min(reach.b) AS kept
FROM n JOIN reach ON reach.a = n.doc_id GROUP BY n.doc_id, n.n
"""
