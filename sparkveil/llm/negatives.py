"""Operator 13: hard negatives by a dual-tree search.

Anchors and candidates are each put into trees of balls: leaves of a few hundred
rows, chunks of leaves, one root for a partition. Rows are ordered by a small
tree of principal directions fitted on a sample, range-partitioned in that order
(so a hot label or dense region is cut like any other), and split within chunks
by their own principal directions. For a pair of nodes the inner product of any
two members lies within ``<c, d> -+ (|c| s + |d| r + r s)`` for centres c, d and
radii r, s, and within the product of their largest norms. A pair whose interval
misses what its anchors still want is dropped with all its descendants, a whole
group of anchors at once; leaf pairs that are left are scored exactly, block by
block. What is pruned is known to be out of reach, so results are exact.

Positives are sought in trees of one label each; the anchors' own leaves give the
first bound. Negatives are sought in trees over all labels, within the windows
that the positives open. How much is pruned depends on the data: on vectors
without clusters in many dimensions the balls overlap and most leaf pairs are
scored (see README for figures).

Scores are inner products of ``floor(scale * x)``, in float64 where that is exact
and in unbounded integers elsewhere. Beyond 64 bits they are clipped, those of
positives before their windows open.

Defined cases: rows with a null id, label or vector, or with a null or
non-finite component, take no part; an empty vector scores 0; vectors of unlike
lengths are compared as if padded with zeros; of rows with one vec_id the
smallest (by label, then vector) takes part; ties go to the smaller vec_id;
an empty table gives no rows; columns besides vec_id, label and embedding are
not read.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import save

#: Factor before rounding down; positives of an anchor; negatives of a positive; the window in percent of the positive's score.
SCALE, POSITIVES, NEGATIVES, LOW, HIGH = 256, 5, 3, 50, 95
#: Rows of a leaf, anchors of a leaf, leaves of a chunk, rows of a partition of a tree.
LEAF, ANCHOR_LEAF, CHUNK, PARTITION = 256, 64, 16, 1 << 18
#: Rows that the tree of directions is fitted on, and rows of its smallest cells.
SAMPLE, CELL = 4096, 32
#: Anchor leaves whose best rows a task holds at a time.
HELD = 1024
_EXACT = 2.0**52


# ---------------------------------------------------------------- vectors

def _matrix(column: pa.Array) -> np.ndarray:
    """(rows, dimensions) of a column of float64 bytes; shorter vectors are padded with zeros."""
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int32)[column.offset: column.offset + len(column) + 1].astype(np.int64) // 8
    data = np.frombuffer(column.buffers()[2] or b"", dtype=np.uint8)
    flat = data[: len(data) // 8 * 8].view(np.float64)[offsets[0]: offsets[-1]] if len(data) else np.zeros(0)
    sizes = np.diff(offsets)
    dim = int(sizes.max(initial=0))
    if (sizes == dim).all():
        return flat.reshape(len(column), dim)
    out = np.zeros((len(column), dim))
    out[np.arange(dim) < sizes[:, None]] = flat
    return out


def prepared(vectors: DataFrame, scale: int = SCALE) -> DataFrame:
    """(vec_id, label, anchor, v) of the rows that take part: ``v`` is ``floor(scale * x)`` as float64 bytes."""
    def run(batches):
        for batch in batches:
            lists = batch.column(3)
            sizes = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
            flat = lists.flatten()
            x = flat.cast(pa.float64()).to_numpy(zero_copy_only=False)
            bad = np.concatenate(([0], np.cumsum(~np.isfinite(x))))  # nulls become nan
            stop = np.cumsum(sizes)
            good = (bad[stop] == bad[stop - sizes]) & lists.is_valid().to_numpy(zero_copy_only=False)
            for i in (0, 1):
                good &= batch.column(i).is_valid().to_numpy(zero_copy_only=False)
            with np.errstate(invalid="ignore", over="ignore"):
                v = np.floor(scale * x)
            made = pa.Array.from_buffers(pa.binary(), len(sizes), [None, pa.py_buffer(np.concatenate(([0], stop * 8)).astype(np.int32)), pa.py_buffer(v.tobytes())])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), made], ["vec_id", "label", "anchor", "v"]).filter(pa.array(good))

    rows = vectors.mapInArrow(run, "vec_id long, label long, anchor boolean, v binary")
    return rows.groupBy("vec_id").agg(F.min(F.struct("label", "anchor", "v")).alias("r")).select("vec_id", "r.label", "r.anchor", "r.v")


def _principal(x: np.ndarray) -> np.ndarray:
    """The direction in which rows spread most, by power iteration."""
    x = x - x.mean(axis=0)
    top = np.abs(x).max(initial=0)
    if not top or not np.isfinite(top):
        return np.zeros(x.shape[1])
    x = x / top
    w = x[np.argmax((x * x).sum(axis=1))]
    for _ in range(6):
        w = x.T @ (x @ w)
        size = np.linalg.norm(w)
        if not size:
            break
        w = w / size
    return w


@dataclass(frozen=True)
class Directions:
    """Median splits along principal directions, as a heap: an order of rows in which near ones are neighbours."""

    direction: np.ndarray
    threshold: np.ndarray
    depth: int

    @staticmethod
    def fit(x: np.ndarray) -> Directions:
        depth = max(0, int(np.log2(max(len(x), 1) / CELL))) if len(x) >= 2 * CELL else 0
        direction, threshold = np.zeros((2**depth, x.shape[1])), np.zeros(2**depth)
        cells = {1: x}
        for node in range(1, 2**depth):
            rows = cells.pop(node)
            direction[node] = _principal(rows)
            along = rows @ direction[node]
            threshold[node] = np.median(along)
            right = along > threshold[node]
            cells[2 * node], cells[2 * node + 1] = (rows[~right], rows[right]) if right.any() else (rows, rows)
        return Directions(direction, threshold, depth)

    def code(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(cell, place along the last direction) of each row."""
        dim = self.direction.shape[1]
        x = x[:, :dim] if x.shape[1] >= dim else np.pad(x, ((0, 0), (0, dim - x.shape[1])))
        node, along = np.ones(len(x), dtype=np.int64), np.zeros(len(x))
        for _ in range(self.depth):
            with np.errstate(invalid="ignore", over="ignore"):
                along = (x * self.direction[node]).sum(axis=1) - self.threshold[node]
            node = 2 * node + (along > 0)
        return node.astype(np.int32), np.nan_to_num(along)


def _bisected(x: np.ndarray, size: int) -> list[np.ndarray]:
    """Rows in groups of at most ``size``, split again and again at the median of their principal direction."""
    todo, done = [np.arange(len(x))], []
    while todo:
        at = todo.pop()
        if len(at) <= size:
            done.append(at)
            continue
        order = at[np.argsort(x[at] @ _principal(x[at]), kind="stable")]
        todo += [order[: len(at) // 2], order[len(at) // 2:]]
    return done


# ---------------------------------------------------------------- trees

_NODE = ("grp long, part int, level int, node long, n int, centre binary, radius double, norm double, ids binary, labels binary, v binary, "
         "seed_ids array<long>, seed_scores array<double>")
_FIELDS = [("grp", pa.int64()), ("part", pa.int32()), ("level", pa.int32()), ("node", pa.int64()), ("n", pa.int32()), ("centre", pa.binary()), ("radius", pa.float64()),
           ("norm", pa.float64()), ("ids", pa.binary()), ("labels", pa.binary()), ("v", pa.binary()), ("seed_ids", pa.list_(pa.int64())), ("seed_scores", pa.list_(pa.float64()))]


def _packed(x: np.ndarray) -> bytes:
    """Whole numbers in the smallest type that holds them; its name comes first."""
    top = np.abs(x).max(initial=0)
    kind = next((k for k, most in (("i1", 127), ("i2", 32767), ("i4", 2**31 - 1)) if top <= most), "f8")
    return kind.encode() + x.shape[1].to_bytes(4, "little") + x.astype(kind).tobytes()


def _unpacked(raw: bytes) -> np.ndarray:
    dim = int.from_bytes(raw[2:6], "little")
    flat = np.frombuffer(raw, dtype=raw[:2].decode(), offset=6)
    return flat.reshape(-1, dim).astype(np.float64) if dim else None


def _ball(x: np.ndarray) -> tuple[np.ndarray, float, float]:
    """Centre, radius and largest norm of rows; the radius is rounded up."""
    with np.errstate(over="ignore", invalid="ignore"):
        centre = x.mean(axis=0)
        radius = np.sqrt(((x - centre) ** 2).sum(axis=1)).max(initial=0) * (1 + 1e-9)
        return centre, float(radius), float(np.sqrt((x * x).sum(axis=1)).max(initial=0) * (1 + 1e-9))


def scores(x: np.ndarray | None, y: np.ndarray | None, rows: int, columns: int) -> np.ndarray:
    """Exact inner products: int64 where float64 sums are exact, Python integers elsewhere."""
    if x is None or y is None:
        return np.zeros((rows, columns), dtype=np.int64)
    dim = min(x.shape[1], y.shape[1])  # what one lacks counts as zeros
    x, y = x[:, :dim], y[:, :dim]
    with np.errstate(over="ignore"):
        bound = np.sqrt((x * x).sum(axis=1)).max(initial=0) * np.sqrt((y * y).sum(axis=1)).max(initial=0)
    if bound < _EXACT:
        return (x @ y.T).astype(np.int64)
    whole = lambda m: np.array([[int(c) for c in r] for r in m], dtype=object).reshape(m.shape)
    return whole(x) @ whole(y).T


def _masked(s: np.ndarray, out: np.ndarray) -> np.ndarray:
    """``s`` with a score below all others where ``out`` holds."""
    return np.where(out, -(1 << 62) if s.dtype == np.int64 else -(1 << 4000), s)


def _tree(rows: DataFrame, by_label: bool, leaf: int, directions: Directions, n_rows: int, seeds: int = 0) -> DataFrame:
    """Nodes of the trees over ``rows`` (vec_id, label, anchor, v): level 0 leaves with their rows, 1 chunks, 2 a root for group and partition."""
    @F.arrow_udf("struct<cell:int,along:double>")
    def code(v: pa.Array) -> pa.Array:
        cell, along = directions.code(_matrix(v))
        return pa.StructArray.from_arrays([pa.array(cell), pa.array(along)], ["cell", "along"])

    def run(batches):
        part, chunk = TaskContext.get().partitionId(), 0
        held: list[pa.RecordBatch] = []
        balls: list[tuple] = []

        def row(grp, level, node, n, ball, **more):
            out = {"grp": grp, "part": part, "level": level, "node": node, "n": n, "centre": ball[0].tobytes(), "radius": ball[1], "norm": ball[2]}
            return {name: (out | more).get(name) for name, _ in _FIELDS}

        def flush():
            nonlocal chunk
            table = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            held.clear()
            grp = table.column(0)[0].as_py()
            ids, labels, flags = (table.column(i).to_numpy(zero_copy_only=False) for i in (1, 2, 3))
            x = _matrix(table.column(4))
            out = []
            for i, at in enumerate(_bisected(x, leaf)):
                at = at[np.argsort(ids[at])]  # ties go to the smaller id
                seed_ids, seed_scores = [], []
                if seeds and flags[at].any() and len(at) > seeds:
                    mine = np.flatnonzero(flags[at])
                    s = _masked(scores(x[at[mine]], x[at], len(mine), len(at)), ids[at[mine]][:, None] == ids[at][None])
                    seed_ids, seed_scores = ids[at[mine]].tolist(), [float(v) for v in np.sort(s, axis=1)[:, -seeds]]
                out.append(row(grp, 0, part << 40 | chunk << 16 | i, len(at), _ball(x[at]), ids=ids[at].astype(np.int64).tobytes(), labels=labels[at].astype(np.int64).tobytes(),
                               v=_packed(x[at]), seed_ids=seed_ids, seed_scores=seed_scores))
            whole = _ball(x)
            balls.append((whole, len(x)))
            out.append(row(grp, 1, part << 40 | chunk << 16, len(x), whole))
            chunk += 1
            return pa.RecordBatch.from_pylist(out, pa.schema(_FIELDS))

        def root(grp):
            dim = max(len(b[0]) for b, _ in balls)
            centres = np.array([np.pad(b[0], (0, dim - len(b[0]))) for b, _ in balls])
            sizes = np.array([n for _, n in balls], dtype=float)
            centre = (centres * (sizes / sizes.sum())[:, None]).sum(axis=0)
            radius = max(float(np.linalg.norm(c - centre)) + b[1] for c, (b, _) in zip(centres, balls)) * (1 + 1e-9)
            out = row(grp, 2, part << 40, int(sizes.sum()), (centre, radius, max(b[2] for b, _ in balls)))
            balls.clear()
            return pa.RecordBatch.from_pylist([out], pa.schema(_FIELDS))

        last = None
        for batch in batches:
            grp = batch.column(0).to_numpy()
            edges = [0, *(np.flatnonzero(np.diff(grp)) + 1), len(grp)]
            for a, b in zip(edges, edges[1:]):
                if a == b:
                    continue
                if last is not None and grp[a] != last:
                    if held:
                        yield flush()
                    yield root(last)
                last = grp[a]
                while a < b:
                    take = min(b - a, CHUNK * leaf - sum(h.num_rows for h in held))
                    held.append(batch.slice(a, take))
                    a += take
                    if sum(h.num_rows for h in held) == CHUNK * leaf:
                        yield flush()
        if last is not None:
            if held:
                yield flush()
            yield root(last)

    grp = F.col("label") if by_label else F.lit(0).cast("long")
    keyed = rows.select(grp.alias("grp"), "vec_id", "label", "anchor", "v", code("v").alias("c"))
    order = ["grp", "c.cell", "c.along", "vec_id"]
    parts = max(1, min(n_rows // (CHUNK * leaf) + 1, max(rows.sparkSession.sparkContext.defaultParallelism, n_rows // PARTITION + 1)))
    dealt = keyed.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    return save(dealt.select("grp", "vec_id", "label", "anchor", "v").mapInArrow(run, _NODE), "negative-tree")


def interval(ca: pa.Array, ra: pa.Array, na: pa.Array, cb: pa.Array, rb: pa.Array, nb: pa.Array) -> pa.Array:
    """Between which values the inner product of a member of one ball and one of the other lies."""
    x, y = _matrix(ca), _matrix(cb)
    dim = min(x.shape[1], y.shape[1])
    ra, na, rb, nb = (c.to_numpy(zero_copy_only=False) for c in (ra, na, rb, nb))
    with np.errstate(over="ignore", invalid="ignore"):
        middle = (x[:, :dim] * y[:, :dim]).sum(axis=1)
        spread = np.sqrt((x * x).sum(axis=1)) * rb + np.sqrt((y * y).sum(axis=1)) * ra + ra * rb
        most = na * nb
        slack = 1 + 1e-9 * most
        lo, hi = np.maximum(middle - spread, -most) - slack, np.minimum(middle + spread, most) + slack
    lo, hi = np.where(np.isnan(lo), -np.inf, lo), np.where(np.isnan(hi), np.inf, hi)  # too large for float64: nothing is known
    return pa.StructArray.from_arrays([pa.array(lo), pa.array(hi)], ["lo", "hi"])


def _side(tree: DataFrame, level: int, side: str) -> DataFrame:
    """Nodes of a level with the columns of a side of a pair; ``up`` is the node above."""
    node = F.col("node")
    up = {0: F.shiftleft(F.shiftright(node, 16), 16), 1: F.shiftleft(F.shiftright(node, 40), 40), 2: node}[level]
    return tree.where(F.col("level") == level).select(F.col("grp").alias(f"{side}grp"), node.alias(side), up.alias(f"{side}up"), *[
        F.col(c).alias(f"{side}{c}") for c in ("centre", "radius", "norm")])


def leaf_pairs(anchors: DataFrame, candidates: DataFrame, wanted: DataFrame, same_group: bool) -> DataFrame:
    """(a, b) of the leaves that may hold a wanted score; ``wanted`` has (a, low, high) of each anchor leaf that wants any.

    Both trees are descended level by level; a pair of nodes below whose interval nothing is wanted is not descended.
    """
    above = {0: wanted.select("a", "low", "high")}
    for level, bits in ((1, 16), (2, 40)):
        above[level] = wanted.groupBy(F.shiftleft(F.shiftright("a", bits), bits).alias("a")).agg(F.min("low").alias("low"), F.max("high").alias("high"))
    if same_group:  # roots are nodes of a group and partition, so the group is part of their name
        above[2] = wanted.groupBy("agrp", F.shiftleft(F.shiftright("a", 40), 40).alias("a")).agg(F.min("low").alias("low"), F.max("high").alias("high"))
    names = ["a", "agrp"] if same_group else ["a"]
    roots = _side(anchors, 2, "a").join(above[2], names)
    others = _side(candidates, 2, "b")
    if same_group:
        pairs = roots.join(others, F.col("agrp") == F.col("bgrp"))
    else:
        parts = [r.b for r in others.select("b").distinct().collect()]  # one root for each partition
        pairs = roots.withColumn("_b", F.explode(F.lit(parts).cast("array<long>"))).join(others, F.col("_b") == F.col("b")).drop("_b")
    pairs = _within(pairs)
    for level in (1, 0):
        a, b = _side(anchors, level, "a"), _side(candidates, level, "b")
        pairs = pairs.select(F.col("a").alias("aup"), F.col("b").alias("bup"), "agrp", "bgrp")
        pairs = _within(pairs.join(a.join(above[level], "a"), ["aup", "agrp"]).join(b, ["bup", "bgrp"]))
    return pairs.select("a", "b")


def _within(pairs: DataFrame) -> DataFrame:
    reach = pairs.withColumn("_i", F.arrow_udf(interval, "struct<lo:double,hi:double>")("acentre", "aradius", "anorm", "bcentre", "bradius", "bnorm"))
    return reach.where((F.col("_i.hi") >= F.col("low")) & (F.col("_i.lo") <= F.col("high"))).select("a", "agrp", "b", "bgrp")


# ---------------------------------------------------------------- leaf pairs

class _Best:
    """The best rows of every question, by score, then by smaller id."""

    def __init__(self, k: int):
        self.k, self.held = k, {}

    def add(self, name, keys: tuple[np.ndarray, ...], s: np.ndarray, ids: np.ndarray) -> None:
        old = self.held.get(name)
        if old is not None:
            s, ids = np.concatenate((old[1], s), axis=1), np.concatenate((old[2], ids), axis=1)
            order = np.lexsort((ids, -s), axis=1)[:, : self.k]
            s, ids = np.take_along_axis(s, order, axis=1), np.take_along_axis(ids, order, axis=1)
        self.held[name] = (keys, s, ids)

    def rows(self, floor: int = -(1 << 62)):
        """(keys, score, id) as flat arrays."""
        for keys, s, ids in self.held.values():
            at, nth = np.nonzero(s > floor)
            yield [k[at] for k in keys], s[at, nth], ids[at, nth]
        self.held.clear()


_LONG = (1 << 63) - 1


def _scored(pairs: DataFrame, anchors: DataFrame, candidates: DataFrame, k: int, low: int, high: int, windows: DataFrame | None) -> DataFrame:
    """The best ``k`` rows, by task, for each anchor (positives), or for each anchor and positive (negatives, if there are ``windows``).

    ``windows`` has (a, asks): array<struct<anchor_id, positive_id, score>> of an anchor leaf.
    """
    asking = windows is not None

    def positives(best, name, ids_a, ids_b, labels_a, labels_b, s, asks):
        s = _masked(s, (ids_a[:, None] == ids_b[None]) | (labels_a[:, None] != labels_b[None]))
        order = np.argsort(-s, axis=1, kind="stable")[:, :k]
        best.add(name, (ids_a, ids_a), np.take_along_axis(s, order, axis=1), ids_b[order])

    def negatives(best, name, ids_a, ids_b, labels_a, labels_b, s, asks):
        s = _masked(s, labels_a[:, None] == labels_b[None])
        order = np.argsort(-s, axis=1, kind="stable")
        s, ids = np.take_along_axis(s, order, axis=1), ids_b[order]
        anchor, positive, score = asks
        row = np.searchsorted(ids_a, anchor)
        s, ids = s[row], ids[row]
        first = (100 * s > high * score[:, None]).sum(axis=1)  # those before score too much
        at = first[:, None] + np.arange(k)
        inside = at < s.shape[1]
        at = np.minimum(at, s.shape[1] - 1)
        got, ids = np.take_along_axis(s, at, axis=1), np.take_along_axis(ids, at, axis=1)
        best.add(name, (anchor, positive), _masked(got, ~(inside & (100 * got >= low * score[:, None]))), ids)

    def run(batches):
        best, large = _Best(k), _Best(k)

        def emitted(held, floor=-(1 << 62)):
            for (anchor, positive), s, ids in held.rows(floor):
                clipped = [int(min(max(v, -_LONG), _LONG)) for v in s] if s.dtype == object else s
                yield pa.RecordBatch.from_arrays([pa.array(anchor), pa.array(positive), pa.array(ids), pa.array(clipped, pa.int64())], ["anchor_id", "positive_id", "vec_id", "score"])

        for batch in batches:
            for r in range(batch.num_rows):
                name, *raw = (batch.column(i)[r] for i in range(7))
                ids_a, labels_a, ids_b, labels_b = (np.frombuffer(raw[i].as_buffer(), dtype=np.int64) for i in (0, 1, 3, 4))
                s = scores(_unpacked(raw[2].as_py()), _unpacked(raw[5].as_py()), len(ids_a), len(ids_b))
                asks = None
                if asking:
                    listed = batch.column(7)[r].values
                    asks = [listed.field(i).to_numpy(zero_copy_only=False) for i in range(3)]
                if s.dtype == object:  # beyond float64: rare, not merged
                    if asks:
                        asks[2] = asks[2].astype(object)
                    (negatives if asking else positives)(large, name.as_py(), ids_a, ids_b, labels_a, labels_b, s, asks)
                    yield from emitted(large, -(1 << 3999))
                    continue
                if asks and np.abs(asks[2]).max(initial=0) > (1 << 55):  # such a positive asks for more than these scores
                    asks = [c[np.abs(asks[2]) <= (1 << 55)] for c in asks]
                (negatives if asking else positives)(best, (name.as_py(), len(asks[0]) if asks else 0), ids_a, ids_b, labels_a, labels_b, s, asks)
                if len(best.held) >= HELD:
                    yield from emitted(best)
        yield from emitted(best)

    payload = lambda tree, x: tree.where("level = 0").select(F.col("node").alias(x), F.col("ids").alias(f"{x}ids"), F.col("labels").alias(f"{x}labels"), F.col("v").alias(f"{x}v"))
    joined = pairs.join(payload(anchors, "a"), "a").join(payload(candidates, "b"), "b")
    columns = ["a", "aids", "alabels", "av", "bids", "blabels", "bv"]
    if asking:
        joined, columns = joined.join(windows.select("a", "asks"), "a"), [*columns, "asks"]
    found = joined.select(*columns).mapInArrow(run, "anchor_id long, positive_id long, vec_id long, score long")
    rank = F.row_number().over(W.partitionBy("anchor_id", "positive_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k)


def mine_hard_negatives(vectors: DataFrame, anchor: Column, positives: int = POSITIVES, negatives: int = NEGATIVES, low: int = LOW, high: int = HIGH,
                        scale: int = SCALE, sample_rows: int = SAMPLE, report: dict | None = None) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) of the rows for which ``anchor`` holds.

    An anchor's positives are the ``positives`` best other rows of its label; a
    positive's negatives the ``negatives`` best rows of other labels that score
    ``low`` to ``high`` percent of it. ``report`` gets the leaf pairs there are and those scored.
    """
    rows = save(prepared(vectors.select(F.col("vec_id").cast("long"), F.col("label").cast("long"), F.coalesce(anchor, F.lit(False)).alias("anchor"), "embedding"), scale), "negative-rows")
    n_rows, n_anchors = rows.agg(F.count("*"), F.count_if("anchor")).first()
    sample = rows.select("v").orderBy(F.xxhash64("vec_id"), "vec_id").limit(sample_rows).toArrow().column("v").combine_chunks()
    sample = sample.chunk(0) if isinstance(sample, pa.ChunkedArray) and sample.num_chunks else sample
    directions = Directions.fit(_matrix(sample) if len(sample) else np.zeros((0, 1)))
    asking = rows.where("anchor")
    own, theirs = _tree(asking, True, ANCHOR_LEAF, directions, n_anchors), _tree(rows, True, LEAF, directions, n_rows, positives)

    # positives: an anchor wants what reaches the worst of the best of its own leaf
    seeds = theirs.where("level = 0 and size(seed_ids) > 0").select(F.explode(F.arrays_zip("seed_ids", "seed_scores")).alias("s"))
    seeds = seeds.select(F.col("s.seed_ids").alias("anchor_id"), F.col("s.seed_scores").alias("least"))
    members = _members(own)
    least = members.join(seeds, "anchor_id", "left").groupBy("a", "agrp").agg(F.min(F.coalesce("least", F.lit(float("-inf")))).alias("least"))
    wanted = least.select("a", "agrp", (F.col("least") - 1 - F.abs("least") * 1e-9).alias("low"), F.lit(float("inf")).alias("high"))
    pairs = save(leaf_pairs(own, theirs, wanted, True), "negative-pairs")
    best = save(_scored(pairs, own, theirs, positives, low, high, None).select("anchor_id", F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score")), "positives")

    # negatives: the windows of a leaf's anchors
    mixed_own, mixed = _tree(asking, False, ANCHOR_LEAF, directions, n_anchors), _tree(rows, False, LEAF, directions, n_rows)
    asks = _members(mixed_own).join(best.where("positive_score >= 0"), "anchor_id")  # below 0 the window is empty
    asks = save(asks.groupBy("a", "agrp").agg(
        F.array_sort(F.collect_list(F.struct("anchor_id", "positive_id", "positive_score"))).alias("asks"),  # of one leaf
        F.min("positive_score").alias("least"), F.max("positive_score").alias("most")), "negative-windows")
    wanted = asks.select("a", "agrp", (F.col("least") * (low / 100) * (1 - 1e-9) - 1).alias("low"), (F.col("most") * (high / 100) * (1 + 1e-9) + 1).alias("high"))
    found = save(leaf_pairs(mixed_own, mixed, wanted, False), "negative-pairs")
    if report is not None:
        count = lambda tree: tree.where("level = 0").groupBy("grp").agg(F.count("*").alias("n"))
        report["positive_pairs"], report["positive_scored"] = count(own).join(count(theirs).withColumnRenamed("n", "m"), "grp").agg(F.sum(F.col("n") * F.col("m"))).first()[0], pairs.count()
        report["negative_pairs"], report["negative_scored"] = mixed_own.where("level = 0").count() * mixed.where("level = 0").count(), found.count()
    scored = _scored(found, mixed_own, mixed, negatives, low, high, asks)
    return scored.join(best, ["anchor_id", "positive_id"]).select(
        "anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("vec_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))


def _ids(raw: pa.Array) -> pa.Array:
    data = [np.frombuffer(b, dtype=np.int64) for b in raw.to_pylist()]
    return pa.array(data, pa.list_(pa.int64()))


def _members(tree: DataFrame) -> DataFrame:
    """(a, agrp, anchor_id) of the rows of the leaves."""
    return tree.where("level = 0").select(F.col("node").alias("a"), F.col("grp").alias("agrp"), F.explode(F.arrow_udf(_ids, "array<long>")("ids")).alias("anchor_id"))
