"""Operator 10 (built-in functions only): line dedup by a distributed suffix array.

A text is a sequence of line ids. Lines that occur once end every repeated run,
so only repeated lines enter the suffix array. It is built by prefix doubling:
the rank of a suffix among all suffixes by its first 2k lines follows from the
ranks by the first k lines of itself and of the suffix k lines later. A rank is
the number of smaller suffixes, so a class of equal ranks is exactly one
interval of suffixes whose longest common prefix reaches that depth.

A run counts when it has ``min_words`` words. For each suffix the shortest such
run it begins with, and for each line the shortest it ends, depend on the run's
lines only; two overlapping power-of-two ranks and the length name its interval.
In each interval the earliest run (by doc_id, then line) stays, and the lines
of the later ones are deleted; a copy that overlaps the run that stays, in the
same document, is no later copy, so the one that stays is never eaten by its own
copies. (Its lines may still be the later copy of another run.) The union of
these shortest runs is the union of all maximal repeated runs of ``min_words``
words or more.

Global ranks never pass through one task: counts are summed per bucket, buckets
are summed in a table of bounded size, and rows are ranked inside their bucket.

Defined cases: a null text stays null, an empty text is one empty line; very
long texts are sequences of more lines; an empty table gives no rows; lines end
at ``\\n`` only; equal rows (same id, same text) are one document and get the
same result; rows with equal ids and other texts are ordered by a hash of the
text; a null doc_id sorts first; a document of which every line is deleted
stays with an empty text; other columns are kept as they are, whatever their
names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import drop_saved, join_hot, merge_runs, save

#: Words a repeated run must have for its later copies to be deleted.
MIN_WORDS = 50
#: Buckets of the two-level rank sums; a power of two.
BUCKETS = 4096
_WORD = r"[^\x20\x09-\x0D]+"
_NO_ID = -(2**63)


def _line_rows(docs: DataFrame) -> DataFrame:
    """(d, t, n, h, words): document id, hash of its text, line number, line id and words of each line."""
    keyed = docs.where("text is not null").select(
        F.coalesce(F.col("doc_id").cast("long"), F.lit(_NO_ID)).alias("d"), F.xxhash64("text").alias("t"), F.col("text").cast("string"))
    lines = keyed.select("d", "t", F.posexplode_outer(F.split("text", "\n")).alias("n", "line"))
    return lines.select("d", "t", "n", F.xxhash64("line").alias("h"), F.regexp_count("line", F.lit(_WORD)).alias("words"))


def _first_ranks(rows: DataFrame) -> DataFrame:
    """(h, rank): the number of rows with a smaller line id, for each line id that repeats."""
    count = rows.groupBy("h").count().where("count > 1")
    bucket = F.shiftright("h", 52) + BUCKETS // 2  # ids are hashes: their upper bits are even buckets
    count = save(count.withColumn("bucket", bucket), "line-ids")
    sums = count.groupBy("bucket").agg(F.sum("count").alias("total"))
    before = F.sum("total").over(W.orderBy("bucket").rowsBetween(W.unboundedPreceding, -1))  # at most BUCKETS rows
    sums = sums.select("bucket", F.coalesce(before, F.lit(0)).alias("before"))
    inside = F.sum("count").over(W.partitionBy("bucket").orderBy("h").rowsBetween(W.unboundedPreceding, -1))
    return count.join(F.broadcast(sums), "bucket").select("h", (F.col("before") + F.coalesce(inside, F.lit(0))).alias("rank"))


def _double(rows: DataFrame, level: int, total: int) -> DataFrame:
    """Adds ``r{level + 1}``, ranks by 2**(level + 1) lines, from ``r{level}``; shorter suffixes come first."""
    low, skip = f"r{level}", 2**level
    later = F.first(low).over(W.partitionBy("d", "t").orderBy("n").rangeBetween(skip, skip))
    paired = rows.withColumn("_next", F.coalesce(later, F.lit(-1)))
    classes = paired.groupBy(low, "_next").count()
    width = max(1, total // BUCKETS)
    classes = save(classes.withColumn("_bucket", F.floor(F.col("_next") / width)), "rank-pairs")
    sums = classes.groupBy(low, "_bucket").agg(F.sum("count").alias("_total"))
    before = F.sum("_total").over(W.partitionBy(low).orderBy("_bucket").rowsBetween(W.unboundedPreceding, -1))
    sums = sums.select(low, "_bucket", F.coalesce(before, F.lit(0)).alias("_before"))
    inside = F.sum("count").over(W.partitionBy(low, "_bucket").orderBy("_next").rowsBetween(W.unboundedPreceding, -1))
    ranked = classes.withColumn("_inside", F.coalesce(inside, F.lit(0))).join(sums, [low, "_bucket"]).select(
        low, "_next", (F.col(low) + F.col("_before") + F.col("_inside")).alias(f"r{level + 1}"))
    return paired.join(ranked, [low, "_next"]).drop("_next")


def repeated_runs(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """Later copies of repeated runs: (d, t, start, stop) in lines, d and t as in the docstring."""
    rows = _line_rows(docs)
    ranks = _first_ranks(rows)
    rows = rows.join(ranks, "h").dropDuplicates(["d", "t", "n"]).drop("h").withColumnRenamed("rank", "r0")

    # shortest runs of min_words words inside blocks of neighbouring repeated lines, by running word counts:
    # the run that n begins ends at the last line with fewer than min_words words since n before it, and the run
    # that n ends begins at the first line after which fewer than min_words words are left up to n
    doc = W.partitionBy("d", "t").orderBy("n")
    rows = rows.withColumn("block", F.col("n") - F.row_number().over(doc))
    block = W.partitionBy("d", "t", "block")
    rows = rows.withColumn("upto", F.sum("words").over(block.orderBy("n").rowsBetween(W.unboundedPreceding, W.currentRow)))
    rows = rows.withColumn("past", F.col("upto") - F.col("words"))
    ahead, behind = block.orderBy("past").rangeBetween(0, min_words - 1), block.orderBy("upto").rangeBetween(1 - min_words, 0)
    rows = rows.withColumn("end", F.max("n").over(ahead)).withColumn("end_upto", F.max("upto").over(ahead))
    rows = rows.withColumn("begin", F.min("n").over(behind)).withColumn("begin_past", F.min("past").over(behind))
    rows = rows.select(
        "d", "t", "n", "r0", F.when(F.col("end_upto") - F.col("past") >= min_words, F.col("end")).alias("end"),
        F.when(F.col("upto") - F.col("begin_past") >= min_words, F.col("begin")).alias("begin"))
    rows = save(rows, "line-ranks")
    longest, total = rows.agg(F.max(F.greatest(F.col("end") - F.col("n"), F.col("n") - F.col("begin")) + 1), F.count("*")).first()
    levels = (longest or 1).bit_length()
    for level in range(levels - 1):
        done = rows
        rows = save(_double(rows, level, total), "line-ranks")
        drop_saved(done)

    # each run by the ranks of its first and last power of two lines, and its length
    runs = rows.where("end is not null").select("d", "t", F.col("n").alias("start"), F.col("end").alias("last")).union(
        rows.where("begin is not null").select("d", "t", F.col("begin"), F.col("n"))).distinct()
    runs = runs.withColumn("lines", F.col("last") - F.col("start") + 1)
    level = F.floor(F.log2("lines") + 1e-9).cast("int")
    runs = runs.withColumn("level", level).withColumn("second", F.col("last") + 1 - F.expr("shiftleft(1, level)"))
    ranks = rows.select("d", "t", "n", F.array(*[f"r{i}" for i in range(levels)]).alias("ranks"))
    first = ranks.select("d", "t", F.col("n").alias("start"), F.col("ranks").alias("a"))
    second = ranks.select("d", "t", F.col("n").alias("second"), F.col("ranks").alias("b"))
    runs = runs.join(first, ["d", "t", "start"]).join(second, ["d", "t", "second"]).select(
        "d", "t", "start", (F.col("last") + 1).alias("stop"), "lines",
        F.get("a", F.col("level")).alias("a"), F.get("b", F.col("level")).alias("b"))
    runs = save(runs, "line-runs")
    where = F.struct("d", "t", "start")
    kept = runs.groupBy("a", "b", "lines").agg(F.min(where).alias("kept"), F.count("*").alias("copies")).where("copies > 1")
    later = join_hot(runs, save(kept, "line-kept"), ["a", "b", "lines"], "copies", runs.count())
    kept = F.col("kept")
    own = (F.col("d") == kept["d"]) & (F.col("t") == kept["t"]) & (F.col("start") < kept["start"] + F.col("lines"))
    return later.where((where > kept) & ~own).select("d", "t", "start", "stop")


def remove_repeated_lines(docs: DataFrame, min_words: int = MIN_WORDS, report: str | None = "line_dedup") -> DataFrame:
    """``docs`` with the later copies of repeated line runs deleted from ``text``.

    Adds the struct ``report`` (n_lines, n_deleted) in place of a column of that
    name; all other columns stay. Without a ``report`` the columns are those of ``docs``.
    """
    runs = repeated_runs(docs, min_words).groupBy("d", "t").agg(
        merge_runs(F.array_sort(F.collect_set(F.struct("start", "stop")))).alias("runs"))
    keyed = docs.select(F.struct("*").alias("row"), F.coalesce(F.col("doc_id").cast("long"), F.lit(_NO_ID)).alias("d"),
                        F.xxhash64("text").alias("t"))
    joined = keyed.join(runs, ["d", "t"], "left")
    lines = F.split("row.text", "\n")
    kept = F.filter(lines, lambda _, i: ~F.exists("runs", lambda r: (i >= r["start"]) & (i < r["stop"])))
    text = F.when(F.col("runs").isNull(), F.col("row.text")).otherwise(F.array_join(kept, "\n"))
    n_lines = F.coalesce(F.regexp_count("row.text", F.lit("\n")) + 1, F.lit(0)).cast("long")
    gone = F.coalesce(F.aggregate("runs", F.lit(0).cast("long"), lambda n, r: n + r["stop"] - r["start"]), F.lit(0).cast("long"))
    columns = [text.alias(c) if c == "text" else F.col("row").getField(c).alias(c) for c in docs.columns if c != report]
    said = [F.struct(n_lines.alias("n_lines"), gone.alias("n_deleted")).alias(report)] if report else []
    return joined.select(*columns, *said)


def line_digest(cleaned: DataFrame) -> DataFrame:
    """Per document: counts and the digest of the remaining text."""
    return cleaned.select("doc_id", F.col("line_dedup.n_lines").alias("n_lines"), F.col("line_dedup.n_deleted").alias("n_deleted"),
                          F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("text_sha256"),
                          F.length("text").cast("long").alias("n_chars"))
