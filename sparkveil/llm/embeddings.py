"""Operator 7: near-duplicate embeddings by E8 lattice hashing.

A unit vector is projected to eight random dimensions, scaled, and decoded to
the nearest point of the E8 lattice; label and point are its cell. Several
tables repeat this with other projections, each also probing the neighbouring
cells nearest to the vector. Tables are taken a few at a time, so that what is
shuffled at once has a bound. Pairs that meet in a cell are compared there by
128 signs of random projections, and only those that may be near enough become
rows; these are verified by cosine in double precision, so nothing below the
threshold links.

Dense groups never become pairs: vectors within half the threshold angle of a
group leader are all linked to each other, so they form a group with a size and
a radius. Candidates are pairs of groups; from the angle of their leaders and
the radii it follows that all, or none, of their members link. Otherwise their
members are compared in blocks of bounded size by matrix products, of which only
the number of links of each vector is kept: member pairs are never rows.

Defined cases: vectors that are null, empty, all zero, or hold a null or
non-finite component link with nothing, nor do those with a null label;
vectors of different lengths do not link; repeated rows are vectors each;
very long vectors are compared like others; an empty table gives no rows;
columns besides vec_id, embedding and label are not read. A link needs the pair
to meet in one of the tables; the chance to miss one is below 0.5 % at the
threshold itself and falls quickly above it. The signs add less than 0.001 % to
that: they allow five standard deviations of what the widest linked angle gives.
"""

from __future__ import annotations

import itertools
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import connected_components, drop_saved, mix64, save

THRESHOLD = 0.93
#: Tables, probed neighbours a table, and the edge of the lattice in units of the projected unit vectors at 64 dimensions.
TABLES, PROBES, SCALE = 10, 12, 0.14
#: Vectors in a block of a group, on average.
BLOCK = 256
#: Rounds in which ungrouped vectors look for a leader.
GROUP_ROUNDS = 2
#: Signs of random projections that a vector is known by, and the standard deviations by which pairs may differ in more of them than expected.
SIGNS, SLACK = 128, 5.0
#: Vectors times tables whose cells are shuffled at once; one table at least.
PASS_ROWS = 300_000
#: Up to so many vectors of pairs to verify are found by broadcast of their ids.
FEW = 200_000
_SEED = 20240229


def _minimal_vectors() -> np.ndarray:
    """The 240 shortest vectors of E8, that is, the steps to neighbouring points."""
    out = []
    for i, j in itertools.combinations(range(8), 2):
        for s, t in itertools.product((1, -1), repeat=2):
            v = np.zeros(8)
            v[i], v[j] = s, t
            out.append(v)
    out += [np.array(s) for s in itertools.product((0.5, -0.5), repeat=8) if sum(x < 0 for x in s) % 2 == 0]
    return np.array(out)


_STEPS = _minimal_vectors()


def _nearest_d8(x: np.ndarray) -> np.ndarray:
    point = np.rint(x)
    error = x - point
    odd = np.flatnonzero(point.sum(axis=1) % 2 != 0)
    worst = np.abs(error[odd]).argmax(axis=1)
    point[odd, worst] += np.where(error[odd, worst] >= 0, 1.0, -1.0)
    return point


def nearest_e8(x: np.ndarray) -> np.ndarray:
    """Nearest E8 point of each row: E8 is D8 and D8 moved by one half in every coordinate."""
    a, b = _nearest_d8(x), _nearest_d8(x - 0.5) + 0.5
    closer = ((x - a) ** 2).sum(axis=1) <= ((x - b) ** 2).sum(axis=1)
    return np.where(closer[:, None], a, b)


def _projections(dim: int, tables: int) -> np.ndarray:
    rng = np.random.default_rng(_SEED + dim)
    size = max(dim, 8)
    return np.stack([np.linalg.qr(rng.normal(size=(size, 8)))[0][:dim] for _ in range(tables)])


def lattice_cells(unit: np.ndarray, labels: np.ndarray, tables, probes: int = PROBES) -> np.ndarray:
    """(row, table, 1 + probes) cell hashes for the numbers in ``tables``; the first is the vector's own cell."""
    n, dim = unit.shape
    scale = SCALE * np.sqrt(64 / dim)
    out = np.empty((n, len(tables), 1 + probes), dtype=np.uint64)
    with np.errstate(over="ignore"):
        weights = mix64(np.arange(1, 9, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)
        at = _projections(dim, max(tables) + 1)
        steps = ((2 * _STEPS).astype(np.int64).view(np.uint64) * weights).sum(axis=1, dtype=np.uint64)  # what a step adds to a code
        for i, t in enumerate(tables):
            x = unit @ at[t] / scale
            home = nearest_e8(x)
            code = ((2 * home).astype(np.int64).view(np.uint64) * weights).sum(axis=1, dtype=np.uint64)[:, None]
            if probes:
                near = np.argpartition(-((x - home) @ _STEPS.T), probes - 1, axis=1)[:, :probes]
                code = np.concatenate((code, code + steps[near]), axis=1)
            salt = mix64(labels.astype(np.int64).view(np.uint64) * np.uint64(31) + np.uint64(t * 4096 + dim * 65536 * 4096))
            out[:, i] = mix64(code + salt[:, None])
    return out


def signs(unit: np.ndarray) -> np.ndarray:
    """(row, SIGNS / 64) longs: on which side of random planes each vector lies. Two differ in a share of angle / pi of them, on average."""
    planes = np.random.default_rng(_SEED ^ unit.shape[1]).normal(size=(unit.shape[1], SIGNS))
    return np.packbits(unit @ planes > 0, axis=1).view(np.int64)


def _unit_rows(array: pa.Array):
    """Yield (rows, unit vectors in double precision) of an Arrow array of vectors, for each length; only finite ones that are not zero."""
    if array.null_count or array.values.null_count:
        held = array.to_pylist()
        array = pa.array([v if v is not None and None not in v else [] for v in held], pa.list_(array.type.value_type))
    size = array.value_lengths().to_numpy()
    for dim in np.unique(size[size > 0]):
        at = np.flatnonzero(size == dim)
        x = array.take(pa.array(at)).flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, dim)
        with np.errstate(invalid="ignore", over="ignore", divide="ignore"):
            top = np.abs(x).max(axis=1)
            good = np.isfinite(top) & (top > 0)
            at, x, top = at[good], x[good], top[good]
            x = x / top[:, None]
            x = x / np.sqrt((x**2).sum(axis=1))[:, None]
        if len(at):
            yield at, x


def _keys(vectors: DataFrame, tables: int) -> DataFrame:
    """Linkable vectors: rid, their signs, and for each table a hash of their own cells of it and the next."""
    def run(batches):
        for batch in batches:
            rid, label = batch.column(0).to_numpy(), batch.column(2)
            known, label = label.is_valid().to_numpy(zero_copy_only=False), label.fill_null(0).to_numpy(zero_copy_only=False)
            for at, x in _unit_rows(batch.column(1)):
                at, x = at[known[at]], x[known[at]]
                if not len(at):
                    continue
                cells = lattice_cells(x, label[at], range(tables), 0)[:, :, 0]
                both = mix64(cells ^ (np.roll(cells, -1, axis=1) << np.uint64(1))).view(np.int64)
                s = signs(x)
                yield pa.RecordBatch.from_arrays([pa.array(rid[at]), pa.array(s[:, 0]), pa.array(s[:, 1]), pa.ListArray.from_arrays(
                    pa.array(np.arange(0, both.size + 1, tables), pa.int32()), pa.array(both.ravel()))], ["rid", "s0", "s1", "fine"])

    return vectors.select("rid", "embedding", "label").mapInArrow(run, "rid long, s0 long, s1 long, fine array<long>")


_CELL = ["cell", "leader", "s0", "s1", "radius"]


def _cells(placed: DataFrame, tables: range, probes: int) -> DataFrame:
    """(cell, leader, s0, s1, radius): the cells of each vector in some tables, with what is known of its leader; equal rows of a batch once."""
    def run(batches):
        for batch in batches:
            label, of = batch.column(1).to_numpy(), [batch.column(i).to_numpy() for i in range(2, 6)]
            for at, x in _unit_rows(batch.column(0)):
                cells = lattice_cells(x, label[at], tables, probes).reshape(len(at), -1)
                row, cell = np.repeat(at, cells.shape[1]), cells.ravel().view(np.int64)
                order = np.lexsort((cell, of[0][row]))
                row, cell = row[order], cell[order]
                fresh = np.ones(len(row), dtype=bool)
                fresh[1:] = (cell[1:] != cell[:-1]) | (of[0][row[1:]] != of[0][row[:-1]])
                row = row[fresh]
                for some, part in zip(np.array_split(row, -(-len(row) // (1 << 16))), np.array_split(cell[fresh], -(-len(row) // (1 << 16)))):
                    yield pa.RecordBatch.from_arrays([pa.array(part), *(pa.array(c[some]) for c in of)], _CELL)

    return placed.select("embedding", "label", "leader", "s0", "s1", "radius").mapInArrow(run, "cell long, leader long, s0 long, s1 long, radius double")


def _passes(n: int, tables: int) -> list[range]:
    """The tables in runs whose cells are shuffled at once."""
    step = max(1, min(tables, PASS_ROWS // max(n, 1)))
    return [range(i, min(i + step, tables)) for i in range(0, tables, step)]


def _alike(s: tuple[str, str], t: tuple[str, str], angle, slack: float = SLACK):
    """Whether vectors with these signs may lie within ``angle`` of each other."""
    share = F.least(angle / np.pi, F.lit(1.0))
    apart = F.bit_count(F.col(s[0]).bitwiseXOR(F.col(t[0]))) + F.bit_count(F.col(s[1]).bitwiseXOR(F.col(t[1])))
    return apart <= SIGNS * share + slack * F.sqrt(SIGNS * share * (1 - share))


def _cosines(pairs: DataFrame, units: DataFrame) -> DataFrame:
    """``pairs`` (a, b) with ``cosine``, from unit vectors in double precision."""
    wanted = save(pairs.select(F.col("a").alias("rid")).union(pairs.select("b")).distinct(), "vector-wanted")
    units = units.join(F.broadcast(wanted) if wanted.count() <= FEW else wanted, "rid", "left_semi")
    left = units.select(F.col("rid").alias("a"), F.col("embedding").alias("va"))
    right = units.select(F.col("rid").alias("b"), F.col("embedding").alias("vb"))

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            prod = np.zeros(batch.num_rows)
            sides = [{x.shape[1]: (at, x) for at, x in _unit_rows(batch.column(i))} for i in (2, 3)]
            for dim in sides[0].keys() & sides[1].keys():
                (i, x), (j, y) = (side[dim] for side in sides)
                both, i, j = np.intersect1d(i, j, return_indices=True)
                prod[both] = (x[i] * y[j]).sum(axis=1)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(prod)], ["a", "b", "cosine"])

    return pairs.join(left, "a").join(right, "b").select("a", "b", "va", "vb").mapInArrow(run, "a long, b long, cosine double")


def _block_links(pairs: DataFrame, member: DataFrame, size: DataFrame, units: DataFrame, threshold: float) -> DataFrame:
    """Links between the members of each pair (a, b) of groups: (rid, n, a, b), ``rid`` null and ``n`` 0 for the pair itself if it has any."""
    wide = pairs.select(F.col("a").alias("leader")).union(pairs.select("b")).distinct()
    block = F.pmod(F.xxhash64("rid"), F.ceil(F.col("size") / BLOCK)).cast("int")
    held = member.select("rid", "leader").join(wide, "leader", "left_semi").join(size.select("leader", "size"), "leader").withColumn("block", block)
    blocks = held.join(units, "rid").groupBy("leader", "block").agg(F.collect_list(F.struct("rid", "embedding")).alias("v"))  # bounded: even blocks
    blocks = save(blocks.select("leader", "v"), "vector-blocks")

    def run(batches):
        for batch in batches:
            rids, counts, left, right = [], [], [], []
            for a, b, u, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), batch.column(3)):
                (ru, x), (rv, y) = ((w.values.field(0).to_numpy(), {m.shape[1]: (at, m) for at, m in _unit_rows(w.values.field(1))}) for w in (u, v))
                for dim in x.keys() & y.keys():
                    (at_x, mx), (at_y, my) = x[dim], y[dim]
                    cosine = mx @ my.T
                    close = np.argwhere(np.abs(cosine - threshold) < 1e-12)  # the same sum as for single pairs
                    cosine[close[:, 0], close[:, 1]] = (mx[close[:, 0]] * my[close[:, 1]]).sum(axis=1)
                    linked = cosine >= threshold
                    if not linked.any():
                        continue
                    for ids, n in ((ru[at_x], linked.sum(axis=1)), (rv[at_y], linked.sum(axis=0))):
                        rids += ids[n > 0].tolist()
                        counts += n[n > 0].tolist()
                    rids.append(None), counts.append(0)
                    new = len(rids) - len(left)
                    left += [a] * new
                    right += [b] * new
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (rids, counts, left, right)], ["rid", "n", "a", "b"])

    met = pairs.join(blocks.select(F.col("leader").alias("a"), F.col("v").alias("va")), "a").join(
        blocks.select(F.col("leader").alias("b"), F.col("v").alias("vb")), "b").select("a", "b", "va", "vb")
    return met.mapInArrow(run, "rid long, n long, a long, b long")


def near_duplicate_vectors(vectors: DataFrame, threshold: float = THRESHOLD, tables: int = TABLES, probes: int = PROBES) -> DataFrame:
    """vec_id, n_links, component_id, kept of every vector."""
    limit = float(np.arccos(threshold))
    rows = save(vectors.select(F.monotonically_increasing_id().alias("rid"), F.col("vec_id").cast("long"), "embedding", "label"), "vectors")
    keys = save(_keys(rows, tables), "vector-keys")
    units, n = rows.select("rid", "embedding"), keys.count()

    # groups: vectors within half the limit of a leader, which leads itself
    group, free = None, keys
    for _ in range(GROUP_ROUNDS):
        asked = []
        for some in _passes(n, tables):
            here = free.select("rid", "s0", "s1", F.explode(F.slice("fine", some.start + 1, len(some))).alias("cell"))
            first = here.groupBy("cell").agg(F.min(F.struct(F.col("rid").alias("b"), F.col("s0").alias("t0"), F.col("s1").alias("t1"))).alias("l")).select("cell", "l.*")
            near = here.join(first, "cell").where((F.col("rid") != F.col("b")) & _alike(("s0", "s1"), ("t0", "t1"), F.lit(limit / 2), 2.0))
            asked.append(save(near.groupBy(F.col("rid").alias("a")).agg(F.min("b").alias("b")), "vector-asked"))
        one = reduce(DataFrame.union, asked).groupBy("a").agg(F.min("b").alias("b"))
        close = save(_cosines(one, units).where(F.acos(F.least("cosine", F.lit(1.0))) <= limit / 2 - 1e-6), "vector-leaders")
        led = close.join(close.select(F.col("a").alias("b")), "b", "left_anti")
        led = save(led.select(F.col("a").alias("rid"), F.col("b").alias("leader"), F.acos(F.least("cosine", F.lit(1.0))).alias("angle")), "vector-groups")
        drop_saved(*asked)
        group = led if group is None else group.unionByName(led)
        taken = group.select("rid").union(group.select("leader")).distinct()
        free = keys.join(taken, "rid", "left_anti")
    alone = keys.select("rid").join(group.select("rid"), "rid", "left_anti").select("rid", F.col("rid").alias("leader"), F.lit(0.0).alias("angle"))
    member = save(group.unionByName(alone), "vector-members")
    size = save(member.groupBy("leader").agg(F.count("*").alias("size"), F.max("angle").alias("radius")), "vector-sizes")
    of = size.join(keys.select(F.col("rid").alias("leader"), "s0", "s1"), "leader").select("leader", "s0", "s1", "radius")
    placed = save(rows.join(member.select("rid", "leader").join(of, "leader"), "rid", "left"), "vector-placed")
    drop_saved(rows, keys)
    rows, units, linkable = placed.select("rid", "vec_id", "leader"), placed.select("rid", "embedding"), placed.where("leader is not null")

    # candidate pairs of groups that meet in a cell
    met = []
    for some in _passes(n, tables):
        home = _cells(linkable, some, 0).select("cell", *[F.col(c).alias(f"{c}_b") for c in _CELL[1:]])
        meet = _cells(linkable, some, probes).join(home.hint("shuffle_hash"), "cell").where(
            (F.col("leader") != F.col("leader_b")) & _alike(("s0", "s1"), ("s0_b", "s1_b"), F.col("radius") + F.col("radius_b") + limit))
        met.append(save(meet.select(F.least("leader", "leader_b").alias("a"), F.greatest("leader", "leader_b").alias("b")).distinct(), "vector-met"))
    judged = _cosines(save(reduce(DataFrame.union, met).distinct(), "vector-met"), units)
    drop_saved(*met)
    judged = judged.join(size.select(F.col("leader").alias("a"), F.col("size").alias("na"), F.col("radius").alias("ra")), "a")
    judged = judged.join(size.select(F.col("leader").alias("b"), F.col("size").alias("nb"), F.col("radius").alias("rb")), "b")
    angle, spread = F.acos(F.greatest(F.least("cosine", F.lit(1.0)), F.lit(-1.0))), F.col("ra") + F.col("rb")
    state = (
        F.when(spread == 0, F.when(F.col("cosine") >= threshold, "all").otherwise("none"))
        .when(angle + spread <= limit - 1e-6, "all").when(angle - spread > limit + 1e-6, "none").otherwise("some")
    )
    judged = save(judged.withColumn("state", state).where("state != 'none'"), "vector-pairs")
    whole = judged.where("state = 'all'")
    some = judged.where("state = 'some'").select("a", "b")
    single = save(_block_links(some, member, size, units, threshold), "vector-links")

    # links of each vector
    by_group = whole.select(F.col("a").alias("leader"), F.col("nb").alias("n")).union(whole.select("b", "na"))
    by_group = by_group.union(size.select("leader", F.col("size") - 1)).groupBy("leader").agg(F.sum("n").alias("n_group"))
    by_vector = single.where("rid is not null").groupBy("rid").agg(F.sum("n").alias("n_single"))

    # components: over groups, then down to vectors
    linked = single.where("rid is null").select(F.col("a").alias("ga"), F.col("b").alias("gb"))
    edges = whole.select(F.col("a").alias("ga"), F.col("b").alias("gb")).union(linked).distinct()
    root = connected_components(edges, "ga", "gb").withColumnRenamed("node", "leader")
    named = rows.join(root, "leader", "left").withColumn("root", F.coalesce("component", "leader", "rid"))
    smallest = named.groupBy("root").agg(F.min("vec_id").alias("component_id"))
    counted = named.join(by_group, "leader", "left").join(by_vector, "rid", "left").join(smallest, "root")
    n_links = (F.coalesce("n_group", F.lit(0)) + F.coalesce("n_single", F.lit(0))).cast("long")
    return counted.select("vec_id", n_links.alias("n_links"), "component_id", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)).alias("kept"))
