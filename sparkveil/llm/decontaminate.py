"""Operator 9 (built-in functions only): benchmark decontamination by winnowing.

Of every ``WINDOW_GRAMS`` neighbouring ``GRAM``-word hashes the smallest is a
fingerprint; a shared span of ``SPAN`` = GRAM + WINDOW_GRAMS - 1 = 13 words
therefore always shares one. Training and benchmark fingerprints are joined;
each match nominates a document, whose hits are then extended: all its 13-word
windows that an item has are joined and merged to maximal spans. Items of fewer
than 13 words are one window each, and nominate by the hash of their whole.

Every text becomes its word hashes once; they are saved, and all later steps
read these. Windows are rows in the joins, never lists compared with lists.

Defined cases: null texts and texts without words have 0 words and no hits;
items without words are ignored; repeated items count as items each, by
``item_id``; repeated documents are each returned; a repeated window counts
once per word; very long texts are longer lists of hashes; an empty table gives
no rows; columns besides doc_id, item_id and text are not read. Words and
windows are compared by 64-bit hashes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, merge_runs, save

SPAN, GRAM = 13, 8
WINDOW_GRAMS = SPAN - GRAM + 1
#: Tables of a few numbers a row are broadcast up to this many rows (some 40 MB), joined with a shuffle beyond.
BROADCAST_ROWS = 1_000_000
#: Stands for a null doc_id while rows are joined.
_NO_ID = -(2**63)
#: Words: ASCII letters and digits and all beyond ASCII (A-Z are lower-cased first).
_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def contamination_words(text: Column) -> Column:
    """Lower-cased words of a text."""
    return F.regexp_extract_all(ascii_lower(F.coalesce(text, F.lit(""))), F.lit(_WORD), F.lit(0))


def _shifted(array: Column, skip: int, combine) -> Column:
    """Combine each element with the one ``skip`` further on; ``skip`` elements shorter than ``array``."""
    later = F.slice(array, F.lit(skip + 1), F.size(array))
    return F.slice(F.zip_with(array, later, combine), F.lit(1), F.greatest(F.size(array) - skip, F.lit(0)))


def _steps(df: DataFrame, column: str, length: int, combine, out: str) -> DataFrame:
    """``out``: ``combine`` over every ``length`` neighbours of an array column, by doubling.

    Doubling keeps one array per power of two; the last step overlays two of
    them, so the value depends on the neighbours and their number only.
    """
    size, name, made = 1, column, []
    while size * 2 <= length:
        nxt = f"_{out}{size * 2}"
        df = df.withColumn(nxt, _shifted(F.col(name), size, combine))
        made.append(nxt)
        size, name = size * 2, nxt
    if size < length:
        df = df.withColumn(out, _shifted(F.col(name), length - size, combine))
    else:
        df = df.withColumn(out, F.col(name))
    return df.drop(*made)


def _grams(df: DataFrame, hashes: str, length: int, out: str) -> DataFrame:
    return _steps(df, hashes, length, lambda a, b: F.xxhash64(a, b), out)


def _hashed(df: DataFrame) -> DataFrame:
    """Adds ``h``, the hash of every word, from ``text``."""
    return df.withColumn("h", F.transform(contamination_words(F.col("text")), lambda w: F.xxhash64(w)))


def winnow(df: DataFrame, hashes: str = "h", out: str = "prints") -> DataFrame:
    """Adds the distinct winnowed fingerprints of the word hashes in ``hashes``."""
    df = _grams(df, hashes, GRAM, "_gram")
    df = _steps(df, "_gram", WINDOW_GRAMS, lambda a, b: F.least(a, b), "_least")
    return df.withColumn(out, F.array_distinct("_least")).drop("_gram", "_least")


def _bounded(df: DataFrame) -> DataFrame:
    """``df`` with a broadcast hint if it is small enough for one."""
    return F.broadcast(df) if df.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else df


def _windows(hashes: DataFrame, lengths: list[int]) -> DataFrame:
    """Adds ``windows``: array<struct<n, i, g>>, the place and hash of every window of each of the lengths."""
    for n in lengths:
        hashes = _grams(hashes, "h", n, f"_g{n}")
    placed = lambda n: F.transform(f"_g{n}", lambda g, i: F.struct(F.lit(n).alias("n"), i.alias("i"), g.alias("g")))
    return hashes.withColumn("windows", F.concat(*map(placed, lengths))).drop(*[f"_g{n}" for n in lengths])


def find_contamination(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """One row per document: doc_id, n_words, n_hit, n_items, item_ids (sorted as strings), contaminated, spans, text_key.

    ``spans`` are the hit words as (start, stop) in words.
    """
    key = ["doc_id", "text_key"]
    items = _hashed(benchmark.select("item_id", "text")).select("item_id", "h", F.size("h").alias("n")).where("n > 0")
    items = save(items, "items")
    short = sorted(r.n for r in items.where(F.col("n") < SPAN).select("n").distinct().collect())  # at most 12 lengths
    lengths = [*short, SPAN]
    keyed = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(_NO_ID)).alias("doc_id"), F.xxhash64(F.col("text").cast("string")).alias("text_key"), "text")
    hashed = save(_hashed(keyed).select(*key, "h", F.size("h").alias("n_words")), "doc-words")

    # nominate documents: by winnowed fingerprints of 13-word windows (n = 13), by the whole of short items
    # (explode_outer: for explode, the optimizer would copy the whole expression into a filter of its own)
    named = lambda n, of: F.transform(of, lambda g: F.struct(F.lit(n).alias("n"), g.alias("print")))
    wanted = winnow(items.where(F.col("n") >= SPAN)).select(F.explode_outer(named(SPAN, F.col("prints"))).alias("p"))
    for n in short:
        whole = _grams(items.where(F.col("n") == n), "h", n, "g")
        wanted = wanted.unionByName(whole.select(F.explode_outer(named(n, F.col("g"))).alias("p")))
    wanted = save(wanted.where("p is not null").select("p.n", "p.print").distinct(), "wanted-prints")
    offered = winnow(hashed.where("n_words > 0"))
    for n in short:
        offered = _grams(offered, "h", n, f"_g{n}")
    prints = F.concat(named(SPAN, F.col("prints")), *[named(n, F.array_distinct(f"_g{n}")) for n in short])
    offered = offered.select(*key, F.explode_outer(prints).alias("p")).select(*key, "p.n", "p.print")
    nominated = save(offered.join(_bounded(wanted), ["n", "print"], "left_semi").select(*key).distinct(), "nominated")

    # extend: the windows of nominated documents that items have, merged to maximal spans
    own = None
    for n in lengths:
        of_length = _grams(items.where(F.col("n") >= SPAN if n == SPAN else F.col("n") == n), "h", n, "g")
        of_length = of_length.select("item_id", F.lit(n).alias("n"), F.explode_outer("g").alias("g")).distinct()
        own = of_length if own is None else own.unionByName(of_length)
    own = save(own.where("g is not null"), "item-windows")
    windows = _windows(hashed.join(_bounded(nominated), key, "left_semi").select(*key, "h"), lengths)
    windows = windows.select(*key, F.explode_outer("windows").alias("w")).select(*key, "w.n", "w.i", "w.g")
    hits = save(windows.join(_bounded(own.select("n", "g").distinct()), ["n", "g"], "left_semi"), "window-hits")
    runs = hits.groupBy(*key).agg(F.array_sort(F.collect_set(F.struct(F.col("i").alias("start"), (F.col("i") + F.col("n")).alias("stop")))).alias("runs"))
    spans = runs.select(*key, merge_runs(F.col("runs")).alias("spans"))
    found = hits.select(*key, "n", "g").distinct().join(_bounded(own), ["n", "g"]).groupBy(*key).agg(
        F.array_sort(F.transform(F.collect_set("item_id"), lambda i: i.cast("string"))).alias("item_ids"))

    out = hashed.select(*key, F.col("n_words").cast("long").alias("n_words")).join(spans.join(found, key), key, "left")
    n_hit = F.coalesce(F.aggregate("spans", F.lit(0).cast("long"), lambda n, r: n + r["stop"] - r["start"]), F.lit(0).cast("long"))
    ids = F.coalesce("item_ids", F.array().cast("array<string>"))
    return out.select(F.nullif("doc_id", F.lit(_NO_ID)).alias("doc_id"), "n_words", n_hit.alias("n_hit"), F.size(ids).cast("long").alias("n_items"), ids.alias("item_ids"),
                      ((n_hit > 0) & (20 * n_hit >= F.col("n_words"))).alias("contaminated"), "spans", "text_key")


def decontaminate(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs``, all columns, that are not contaminated."""
    bad = find_contamination(docs, benchmark).where("contaminated").select(
        F.coalesce("doc_id", F.lit(_NO_ID)).alias("doc_id"), "text_key").distinct()
    keyed = docs.select(F.struct("*").alias("row"), F.coalesce(F.col("doc_id").cast("long"), F.lit(_NO_ID)).alias("doc_id"),
                        F.xxhash64("text").alias("text_key"))
    return keyed.join(bad, ["doc_id", "text_key"], "left_anti").select("row.*")


def contamination_digest(found: DataFrame) -> DataFrame:
    """Digest columns of :func:`find_contamination`."""
    return found.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("item_ids", ",").cast("binary"), 256).alias("items_sha256"), "contaminated")
