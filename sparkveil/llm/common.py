"""Shared helpers of the training-data operators.

* :func:`save`: where intermediate results go to, the shared folder that every
  executor can read, so a lost executor never loses a stage already saved.
* :func:`connected_components`: alternating large-star / small-star label
  propagation, expressed as joins and ``min`` aggregates only.
* :func:`word_hashes` and friends: vectorised word hashing over raw UTF-8.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkveil.sources.scratch import shared_dir, written

#: While a table is saved: Arrow batches are cut at this size, whatever the length of a row, and Spark removes the shuffle files when the write ends.
_SAVE_CONF = {"spark.sql.execution.arrow.maxBytesPerBatch": str(8 << 20), "spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true"}


def save(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` into the shared folder and read it back, with Arrow batches of bounded size; the shuffle files of the write go with it."""
    conf = df.sparkSession.conf
    before = {key: conf.get(key, None) for key in _SAVE_CONF}
    for key, value in _SAVE_CONF.items():
        conf.set(key, value)
    try:
        return written(df, name)
    finally:
        for key, value in before.items():
            conf.unset(key) if value is None else conf.set(key, value)


def drop_saved(*frames: DataFrame) -> None:
    """Delete tables written by :func:`save` that no later step reads."""
    for df in frames:
        spark = df.sparkSession
        base = f"{shared_dir(spark)}/sparkveil-"
        hadoop = spark.sparkContext._jsc.hadoopConfiguration()
        for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            if "/sparkveil-" in folder and folder.replace("file://", "").startswith(base.replace("file://", "")):
                path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
                path.getFileSystem(hadoop).delete(path, True)


def connected_components(edges: DataFrame, a: str, b: str, max_rounds: int = 60) -> DataFrame:
    """Smallest reachable id for every node that occurs in ``edges``.

    Input: one row per undirected edge between two ids of type long; self
    edges, repeated edges and both directions may occur, nulls are dropped.
    Output: ``node``, ``component`` (component is the smallest id of the set).

    Each round is one large-star and one small-star step: every node hooks its
    larger (then smaller) neighbours onto the smallest node it sees. Both are a
    ``min`` aggregate plus an equi-join, so a node with very many neighbours is
    pre-aggregated before the shuffle and its join can be split; nothing is
    collected. The rounds end when no edge changes.
    """
    spark = edges.sparkSession
    lo, hi = F.least(F.col(a), F.col(b)), F.greatest(F.col(a), F.col(b))
    cur = save(
        edges.where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b)))
        .select(hi.cast("long").alias("u"), lo.cast("long").alias("v")).distinct(), "cc")
    n, total = _edge_state(cur)
    for _ in range(max_rounds):
        if n == 0:
            break
        both = cur.unionByName(cur.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where("u != v").distinct()
        low2 = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (
            large.join(low2, "u")
            .select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")),
                                      F.struct(F.col("u").alias("u"), F.col("m").alias("v")))).alias("e"))
            .select("e.u", "e.v").where("u != v").distinct()
        )
        new = save(small, "cc")
        drop_saved(cur)
        n2, total2 = _edge_state(new)
        cur = new
        if (n2, total2) == (n, total):
            break
        n, total = n2, total2
    else:
        raise RuntimeError("connected components did not converge")
    star = cur.groupBy("u").agg(F.min("v").alias("component")).select(F.col("u").alias("node"), "component")
    roots = star.select(F.col("component").alias("node"), "component").distinct()
    return star.unionByName(roots).distinct()


def _edge_state(df: DataFrame) -> tuple[int, str]:
    row = df.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)")).alias("h")).first()
    return int(row.n), str(row.h)


def contracted(root: DataFrame | None, links: DataFrame) -> DataFrame:
    """Components (``node``, ``component``) after ``links`` (a, b) are added to those of ``root``.

    Only the links between unlike components take part, under the names of these.
    """
    if root is None:
        return save(connected_components(links, "a", "b"), "roots")
    of = lambda x: root.select(F.col("node").alias(x), F.col("component").alias(f"c{x}"))
    bridges = links.join(of("a"), "a", "left").join(of("b"), "b", "left").select(
        F.coalesce("ca", "a").alias("a"), F.coalesce("cb", "b").alias("b")).where("a != b")
    top = save(connected_components(bridges, "a", "b"), "roots")
    moved = root.join(top.select(F.col("node").alias("component"), F.col("component").alias("top")), "component", "left")
    known = moved.select("node", F.coalesce("top", "component").alias("component"))
    return save(known.unionByName(top.join(root.select("node"), "node", "left_anti")), "roots")


#: A key counts as hot from this share of the rows on; so there are at most 1 / HOT_SHARE hot keys.
HOT_SHARE = 0.001


def join_hot(rows: DataFrame, keyed: DataFrame, keys: list[str], copies: str, total: int) -> DataFrame:
    """Inner equi-join of ``rows`` with ``keyed``, which has each key once and the number of its ``rows`` in ``copies``.

    The hot keys, a thousand at most, are broadcast, so the rows of such a key
    stay where they are; all other keys are shuffled.
    """
    least = HOT_SHARE * total
    hot = F.broadcast(keyed.where(F.col(copies) >= least))
    rest = rows.join(hot.select(*keys), keys, "left_anti").join(keyed.where(F.col(copies) < least), keys)
    return rows.join(hot, keys).unionByName(rest)


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z and nothing else.

    ``lower`` is exact on pure ASCII rows and much cheaper than ``translate``,
    which handles the rest.
    """
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(
        F.translate(text, upper, upper.lower()))


def merge_runs(runs: Column) -> Column:
    """Union of (start, stop) runs that are sorted by start."""
    empty = F.array().cast("array<struct<start:int,stop:int>>")

    def add(done: Column, run: Column) -> Column:
        last = F.get(done, F.size(done) - 1)
        joined = F.array_append(F.slice(done, F.lit(1), F.greatest(F.size(done) - 1, F.lit(0))), F.struct(
            last["start"].alias("start"), F.greatest(last["stop"], run["stop"]).alias("stop")))
        return F.when((F.size(done) > 0) & (run["start"] <= last["stop"]), joined).otherwise(F.array_append(done, run))
    return F.aggregate(runs, empty, add)


# ---------------------------------------------------------------- numpy side

#: Mersenne prime of the polynomial word hashes, and their two bases.
_PRIME = (1 << 31) - 1
_BASES = (1_103_529_601, 1_827_364_553)
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}
#: Bytes hashed at a time; longer texts are cut between words.
SEGMENT = 1 << 20


def _reduce(x: np.ndarray) -> np.ndarray:
    """``x`` modulo the prime, for any uint64."""
    p, bits = np.uint64(_PRIME), np.uint64(31)
    x = (x & p) + (x >> bits)
    x = (x & p) + (x >> bits)
    return np.where(x >= p, x - p, x)


def _powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of ``base`` and of its inverse modulo the prime, ``n`` of each at least."""
    have = _POWERS.get(base)
    if have is None or len(have[0]) < n:
        out = []
        for b in (base, pow(base, -1, _PRIME)):
            full = np.ones(1, dtype=np.uint64)
            while len(full) < max(n, SEGMENT + 1):  # doubling: the next half is the first half times base ** len
                full = np.concatenate((full, _reduce(full * np.uint64(pow(b, len(full), _PRIME)))))
            out.append(full.astype(np.uint32))
        if n > 2 * SEGMENT:
            return out[0], out[1]  # a giant word: not worth keeping
        _POWERS[base] = have = (out[0], out[1])
    return have


def release_memory() -> None:
    """Give freed memory of a Python worker back, at the end of a task."""
    import ctypes

    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def mix64(h: np.ndarray) -> np.ndarray:
    """Finaliser of a 64-bit hash: every input bit reaches every output bit."""
    with np.errstate(over="ignore"):
        h = h ^ (h >> np.uint64(33))
        h = h * np.uint64(0xFF51AFD7ED558CCD)
        h = h ^ (h >> np.uint64(33))
        h = h * np.uint64(0xC4CEB9FE1A85EC53)
        return h ^ (h >> np.uint64(33))


def span_hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of ``values[starts[i]:ends[i]]`` for every i, vectorised.

    Two polynomials modulo a prime, so unlike strings of n values agree with a
    chance of about (n / 2**31) ** 2 only, whatever their structure.
    """
    if len(starts) == 0:
        return np.zeros(0, dtype=np.uint64)
    parts, total = [], np.zeros(len(values) + 1, dtype=np.uint64)
    for base in _BASES:
        power, inverse = _powers(base, len(values) + 1)
        x = values.astype(np.uint64)
        x += np.uint64(1)
        x *= power[: len(values)]
        x = (x & np.uint64(_PRIME)) + (x >> np.uint64(31))  # below 2**33: sums of 2**31 of them fit
        np.cumsum(x, out=total[1:])
        parts.append(_reduce(_reduce(total[ends] - total[starts]) * inverse[starts]))
    with np.errstate(over="ignore"):
        return mix64((parts[0] << np.uint64(32) | parts[1]) + (ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


_MASKS = np.array([(1 << 8 * i) - 1 for i in range(9)], dtype=np.uint64)


def chunk_hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of ``values[starts[i]:ends[i]]`` for every i, bytes only: eight of them at a time.

    Each step is a permutation, so strings of one length that differ in one chunk only never agree; others do
    as 64 random bits would. The work goes with the strings, that of :func:`span_hashes` with the bytes.
    """
    if len(starts) == 0:
        return np.zeros(0, dtype=np.uint64)
    padded = np.concatenate((values, np.zeros(8, dtype=np.uint8)))
    eight = np.ndarray(len(values) + 1, dtype="<u8", buffer=padded, strides=(1,))  # the eight bytes from each place on
    size = ends - starts
    with np.errstate(over="ignore"):
        h = mix64((eight[starts] & _MASKS[np.minimum(size, 8)]) ^ size.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        more, at = np.flatnonzero(size > 8), 8
        while len(more):
            h[more] = mix64(h[more] * np.uint64(0xD6E8FEB86659FD93) ^ eight[starts[more] + at] & _MASKS[np.minimum(size[more] - at, 8)])
            at += 8
            more = more[size[more] > at]
    return h


def word_table(separators: str | bytes | None = None, word: bytes | None = None, high: bool = True) -> np.ndarray:
    """256 flags telling which bytes belong to words; bytes over 127 by ``high``."""
    table = np.ones(256, dtype=bool)
    if word is not None:
        table[:128] = False
        table[list(word)] = True
    else:
        table[list(separators if isinstance(separators, bytes) else separators.encode())] = False
    table[128:] = high
    return table


#: Words of the shingle operators: everything but space and the five controls 9 to 13.
SHINGLE_WORDS = word_table(separators=bytes([32, 9, 10, 11, 12, 13]))
#: A-Z to a-z on bytes.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def word_hashes(data: np.ndarray, table: np.ndarray = SHINGLE_WORDS, hashes=span_hashes) -> np.ndarray:
    """Hashes of the A-Z-lower-cased words of one UTF-8 text, in order.

    Works through the text in segments cut between words, so memory is bounded
    by the segment plus eight bytes a word however long the text is.
    """
    out, at, n = [], 0, len(data)
    while at < n:
        end = min(n, at + SEGMENT)
        while end < n and table[data[end]] and table[data[end - 1]]:
            end += 1
        piece = data[at:end]
        flags = np.zeros(len(piece) + 2, dtype=np.int8)
        flags[1:-1] = table[piece]
        edge = np.flatnonzero(np.diff(flags))
        out.append(hashes(LOWER[piece], edge[::2], edge[1::2]))
        at = end
    return np.concatenate(out) if out else np.zeros(0, dtype=np.uint64)


def batch_word_hashes(data: np.ndarray, offsets: np.ndarray, table: np.ndarray = SHINGLE_WORDS, hashes=span_hashes):
    """Yield ``(first_row, row_starts, hashes)`` for groups of neighbouring texts.

    ``data`` and ``offsets`` are the buffers of an Arrow string array. The
    hashes of row ``first_row + i`` are ``hashes[row_starts[i]:row_starts[i + 1]]``.
    """
    row, rows = 0, len(offsets) - 1
    while row < rows:
        last = int(np.searchsorted(offsets, offsets[row] + SEGMENT, side="right")) - 1
        if last <= row:
            h = word_hashes(data[offsets[row]: offsets[row + 1]], table, hashes)
            yield row, np.array([0, len(h)]), h
            row += 1
            continue
        base = offsets[row]
        piece = data[base: offsets[last]]
        cuts = (offsets[row: last + 1] - base).astype(np.int64)
        word = table[piece]
        first = word.copy()
        first[1:] &= ~word[:-1]
        inner = cuts[:-1][cuts[:-1] < len(piece)]
        first[inner] = word[inner]
        starts = np.flatnonzero(first)
        final = word.copy()
        final[:-1] &= ~(word[1:] & ~first[1:])
        ends = np.flatnonzero(final) + 1
        h = hashes(LOWER[piece], starts, ends)
        yield row, np.searchsorted(starts, cuts), h
        row = last


def text_buffers(array) -> tuple[np.ndarray, np.ndarray]:
    """Zero-copy (bytes, offsets) of an Arrow string array; nulls have length 0."""
    import pyarrow as pa

    if pa.types.is_null(array.type):
        array = array.cast(pa.string())
    wide = pa.types.is_large_string(array.type)
    if array.null_count:
        array = array.fill_null("")
    _, off, dat = array.buffers()
    offsets = np.frombuffer(off, dtype=np.int64 if wide else np.int32)[array.offset: array.offset + len(array) + 1]
    data = np.frombuffer(dat, dtype=np.uint8) if dat is not None else np.zeros(0, dtype=np.uint8)
    return data, offsets.astype(np.int64)
