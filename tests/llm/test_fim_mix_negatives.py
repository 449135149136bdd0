"""Fill-in-middle, source mix and hard negatives against plain code, with hostile rows."""

import hashlib
import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from sparkveil.llm import fim, lines, mixing, negatives

# ---------------------------------------------------------------- fill in the middle


def _starts(text, unit):
    pattern = {"char": r"[\s\S]", "word": r"[^\x20\x09-\x0D]+", "line": r"(?<![^\n])[\s\S]"}[unit]
    return [m.start() for m in re.finditer(pattern, text)]


def _plain_fim(text, h, unit="char"):
    starts = _starts(text, unit)
    n = len(starts)
    if n == 0 or any(s in text for s in fim.SENTINELS) or h[2] % 100 >= 90:
        return n, "plain", None, None, text
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    at = lambda u: 0 if u == 0 else len(text) if u >= n else starts[u]
    p, m, s = text[:at(a)], text[at(a):at(b)], text[at(b):]
    spm = h[3] % 100 < 20
    return n, "spm" if spm else "psm", a, b - a, f"<S>{s}<P>{p}<M>{m}" if spm else f"<P>{p}<S>{s}<M>{m}"


@pytest.mark.parametrize("unit", ["char", "word", "line"])
def test_cuts_against_plain_code(unit):
    rng = random.Random(5)
    for trial in range(60):
        signs = ["a", "<", "P", ">", "é", "💣", "中", " ", "\n", "<P>", "\r"] if trial % 2 else ["a", "é", "💣", "中", " ", "\n"]
        texts = ["".join(rng.choice(signs) for _ in range(rng.choice([0, 1, 3, 42, 127, 128, 129, 300, 900]))) for _ in range(5)]
        h = [np.array([rng.randrange(2**32) for _ in texts]) for _ in range(4)]
        got = fim.transform_batch(pa.array(texts), h, unit, fim.SENTINELS, 10, 20).to_pylist()
        for text, row, *g in zip(texts, got, *h):
            assert tuple(row.values())[:5] == _plain_fim(text, [int(x) for x in g], unit)
            assert row["n_sentinels"] == sum(text.count(s) for s in fim.SENTINELS) and row["n_malformed"] == 0


def test_segments_and_malformed_bytes(monkeypatch):
    monkeypatch.setattr(fim, "SEGMENT", 512)
    texts = ["é中x" * 2000, "", "q"]
    h = [np.array([12345, 1, 1]), np.array([999, 1, 1]), np.array([3, 3, 3]), np.array([50, 50, 50])]
    got = fim.transform_batch(pa.array(texts), h, "char", fim.SENTINELS, 10, 20).to_pylist()
    assert [r["output"] for r in got] == [_plain_fim(t, [int(x[i]) for x in h])[4] for i, t in enumerate(texts)]
    broken = pa.Array.from_buffers(pa.string(), 2, pa.array([b"a\xe9\xffb", b"\x80ok"], pa.binary()).buffers())
    seen = fim.transform_batch(broken, [np.array([7, 7])] * 2 + [np.array([95, 95])] * 2, "char", fim.SENTINELS, 10, 20)
    assert seen.field("n_malformed").to_pylist() == [2, 1] and seen.field("n").to_pylist() == [4, 2]


def test_states_are_forgotten():
    """A lane may start ``memory`` bytes early in any state: afterwards it agrees on valid text."""
    table = fim.automaton("word", ("<fim_prefix>", "<fim_suffix>", "<fim_middle>"))
    data = ("x<fim_middle>é 中\n<fim_" * 3).encode()
    for begin in range(len(data) - table.memory):
        ends = set()
        for state in {0, 1}:
            for byte in data[begin: begin + table.memory]:
                state = int(table.follow[state * 256 + byte])
            ends.add(state)
        assert len(ends) == 1


def test_sentinels_must_be_told_apart():
    for wrong in (("<P>", "<P>x", "<M>"), ("ab", "bc", "x"), ("", "a", "b"), ("aba", "x", "y")):
        with pytest.raises(ValueError):
            fim.automaton("char", wrong)
    with pytest.raises(ValueError):
        fim.automaton("page")


def test_fill_in_middle_rows(spark):
    long = "".join(f"é{i}💣" for i in range(60_000))
    texts = [(i, t) for i, t in enumerate(["plain words here", "", None, "a<S>b", long, "twin", "twin", "<", "P>"])] + [(None, "no id"), (5, "twin"), (-3, "<P")]
    df = spark.createDataFrame(texts, "doc_id long, text string").withColumn("fim", F.lit("old")).withColumn("h1", F.lit(1)).repartition(3)
    out = fim.fill_in_middle(df)
    assert set(out.columns) == {"doc_id", "text", "fim", "h1"}
    rows = [(r.doc_id, r.text, *r.fim[:5]) for r in out.collect()]
    assert len(rows) == len(texts)
    for i, text, *got in rows:
        x = hashlib.sha256(f"1:{'' if i is None else i}".encode()).hexdigest()
        assert tuple(got) == _plain_fim(text or "", [int(x[8 * k: 8 * k + 8], 16) for k in range(4)])
    back = fim.fim_digest(out).collect()
    assert sorted(r.restored_sha256 for r in back) == sorted(hashlib.sha256((t or "").encode()).hexdigest() for _, t in texts)
    assert fim.fill_in_middle(df.where("false")).count() == 0
    marks = ("<|pre|>", "<|suf|>", "<|mid|>")
    other = fim.fill_in_middle(df, seed="2", unit="word", sentinels=marks, plain_percent=0, column="cut")
    same = other.select("text", fim.restored(F.col("cut.output"), F.col("cut.form"), marks).alias("back"), "cut.form").collect()
    assert all(r.back == (r.text or "") for r in same) and {r.form for r in same} > {"psm"}


# ---------------------------------------------------------------- source mix


def _plain_targets(sizes, weights, most=3):
    total, full = sum(sizes.values()), set()
    while True:
        left = {s: weights[s] for s in sizes if s not in full}
        share = (total - sum(most * sizes[s] for s in full)) / sum(left.values()) if left else 0
        new = {s for s, w in left.items() if share * w > most * sizes[s]}
        if not new:
            return {s: float(most * sizes[s]) if s in full else share * weights[s] for s in sizes}
        full |= new


def test_targets_share_out_everything(spark):
    sizes = {"a": 10, "b": 1000, "c": 5, "d": 0, "e": 400}
    weights = {"a": 1, "b": 2, "c": 3, "d": 1, "e": 2}
    rows = spark.createDataFrame([(s, n, weights[s]) for s, n in sizes.items()], "_key string, source_size long, weight int")
    got = {r._key: r.target for r in mixing.targets(rows).collect()}
    assert got == _plain_targets(sizes, weights) and got["a"] == 30 and got["c"] == 15 and abs(sum(got.values()) - 1415) < 1e-6
    none = {r._key: r.target for r in mixing.targets(rows.withColumn("weight", F.lit(None).cast("int"))).collect()}
    assert set(none.values()) == {0.0}


def test_mix_rows(spark):
    rng = random.Random(2)
    docs = [(i, rng.choice(["s0", "s0", "s0", "s1", None, "é"]), " ".join(["w"] * rng.choice([0, 1, 5, 30, 2000]))) for i in range(400)]
    docs += [(1000, "s0", None), (1001, "s0", ""), (None, "s1", "a b"), (7, "s1", "x y z"), (7, "s1", "x y z"), (1002, "only", "one two"), (1003, "huge", "w " * 50_000)]
    df = spark.createDataFrame(docs, "doc_id long, source string, text string").withColumn("mix", F.lit(1)).withColumn("_key", F.lit(1)).withColumn("a.b", F.lit("x")).repartition(3)
    weights = mixing.ranked_weights(df)
    assert [(r.source, r.weight) for r in weights.orderBy(F.col("source").asc_nulls_last()).collect()] == [("huge", 1), ("only", 2), ("s0", 3), ("s1", 1), ("é", 2), (None, 3)]
    out = mixing.mix_sources(df, weights)
    assert out.columns == ["doc_id", "source", "text", "_key", "a.b", "mix"]
    rows = out.collect()
    again = mixing.mix_sources(df.repartition(5), weights).collect()
    assert sorted(map(str, rows)) == sorted(map(str, again)) and len(rows) == len(docs)
    sizes = {}
    for _, s, t in docs:
        sizes[s] = sizes.get(s, 0) + len((t or "").split())
    want = _plain_targets(sizes, {"huge": 1, "only": 2, "s0": 3, "s1": 1, "é": 2, None: 3})
    used = {}
    for r in rows:
        assert r.mix.size == len((r.text or "").split()) and r.mix.source_size == sizes[r.source] and 0 <= r.mix.times <= 3 and r.mix.target == want[r.source]
        used[r.source] = used.get(r.source, 0) + r.mix.times * r.mix.size
    for s in want:  # near the target, or no document that was left fits into the rest
        rest, mine = want[s] - used[s], [r.mix for r in rows if r.source == s and r.mix.size]
        least = min((m.times for m in mine), default=0)
        assert 0 <= rest and (rest <= 0.02 * want[s] + 5 or all(m.times == 3 or m.times > least or m.size > rest for m in mine)), s
    assert len({r.mix.times for r in rows if r.doc_id == 7 and r.text == "x y z"}) == 1
    assert mixing.mix_sources(df.where("false"), weights).count() == 0
    assert {r.mix.times for r in mixing.mix_sources(df, weights.where("false")).collect()} == {0}


def test_smaller_budgets_are_nested(spark):
    docs = spark.range(3000).select(F.col("id").alias("doc_id"), F.lit("s").alias("source"), F.concat_ws(" ", F.sequence(F.lit(1), 1 + F.col("id") % 7)).alias("text"))
    other = spark.range(1).select((F.col("id") - 1).alias("doc_id"), F.lit("t").alias("source"), F.repeat(F.lit("w "), 20_000).alias("text"))
    taken = []
    for w in (1, 4):  # a larger weight of s gives it a larger target
        weights = spark.createDataFrame([("s", w), ("t", 20)], "source string, weight int")
        rows = mixing.mix_sources(docs.union(other), weights, rounds=1)
        taken.append({r.doc_id for r in rows.where("source = 's' and mix.times > 0").select("doc_id").collect()})
    assert 0 < len(taken[0]) < len(taken[1]) and taken[0] <= taken[1]


def test_many_equal_hashes_are_one_choice(spark):
    docs = spark.range(600).select(F.lit(5).cast("long").alias("doc_id"), F.when(F.col("id") < 300, "s").otherwise("t").alias("source"), F.lit("a b c").alias("text"))
    rows = mixing.mix_sources(docs, spark.createDataFrame([("s", 1), ("t", 3)], "source string, weight int")).collect()
    assert {(r.source, r.mix.times) for r in rows} == {("s", 0), ("t", 1)}


# ---------------------------------------------------------------- hard negatives


def _plain_negatives(rows, every=50, k=5, m=3, low=50, high=95):
    kept = {}
    for i, label, e in sorted((r for r in rows if None not in r), key=lambda r: (r[0], r[1], r[2] and [float(np.floor(256 * x)) if x is not None else 0 for x in r[2]])):
        if i not in kept and all(x is not None and np.isfinite(x) for x in e):
            kept[i] = (label, [int(np.floor(256 * float(x))) for x in e])
    out = []
    for a, (label, e) in kept.items():
        if a % every:
            continue
        scored = sorted((-sum(x * y for x, y in zip(e, f)), i, other) for i, (other, f) in kept.items() if i != a)
        for s, p, other in [x for x in scored if x[2] == label][:k]:
            found = [(n, t) for t, n, o in scored if o != label and 50 * -s <= 100 * -t <= 95 * -s][:m]
            out += [(a, p, r + 1, n, -s, -t) for r, (n, t) in enumerate(found)]
    return sorted(out)


def _vectors(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, label int, embedding array<float>").withColumn("grp", F.lit(1)).repartition(3)


def test_negatives_against_plain_code(spark, monkeypatch):
    monkeypatch.setattr(negatives, "LEAF", 16)
    monkeypatch.setattr(negatives, "ANCHOR_LEAF", 4)
    monkeypatch.setattr(negatives, "CHUNK", 3)
    rng = np.random.default_rng(4)
    rows = [(i, int(i % 3 if i % 4 else 0), [float(np.float32(x)) for x in rng.normal(size=8) / 3]) for i in range(600)]
    rows += [(i + 600, 0, rows[i][2]) for i in range(0, 40)]  # ties
    rows += [(700, None, [1.0] * 8), (750, 1, None), (800, 1, [1.0, None]), (850, 1, [float("nan")] * 8), (900, 1, [float("inf")] * 8), (None, 1, [1.0] * 8),
             (950, 1, []), (1000, 1, [0.5, 0.25]), (50, rows[50][1], rows[50][2]), (100, 2, [9.0] * 8), (1050, 7, [0.5] * 8), (1100, 2, [0.1] * 12)]
    got = negatives.mine_hard_negatives(_vectors(spark, rows), F.col("vec_id") % 50 == 0)
    assert got.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    assert sorted(map(tuple, got.collect())) == _plain_negatives(rows)
    none = _vectors(spark, rows).where("false")
    assert negatives.mine_hard_negatives(none, F.col("vec_id") % 50 == 0).count() == 0
    assert negatives.mine_hard_negatives(_vectors(spark, rows), F.lit(False)).count() == 0


def test_scores_beyond_float64(spark):
    rng = np.random.default_rng(5)
    big = [(i, i % 2, [float(np.float32(x)) for x in rng.integers(1, 2**20, 4) * 1.75]) for i in range(0, 120)]
    got = sorted(map(tuple, negatives.mine_hard_negatives(_vectors(spark, big), F.col("vec_id") % 50 == 0).collect()))
    assert got == _plain_negatives(big) and 2**53 < max(r[4] for r in got) < 2**63


def test_clustered_vectors_are_pruned(spark, monkeypatch):
    monkeypatch.setattr(negatives, "LEAF", 32)  # leaves no wider than a cluster
    monkeypatch.setattr(negatives, "ANCHOR_LEAF", 8)
    rng = np.random.default_rng(6)
    centres = rng.normal(size=(40, 16))
    rows = [(i, int(i // 40 % 4), [float(np.float32(x)) for x in centres[i % 40] + rng.normal(size=16) * 0.15]) for i in range(8000)]
    report = {}
    got = negatives.mine_hard_negatives(_vectors(spark, rows), F.col("vec_id") % 50 == 0, report=report)
    assert got.count() > 0
    assert report["positive_scored"] < 0.5 * report["positive_pairs"] and report["negative_scored"] < 0.5 * report["negative_pairs"], report


# ---------------------------------------------------------------- line stage


def test_line_stage_keeps_clashing_columns(spark):
    import corpus_pipeline

    df = spark.createDataFrame([(1, "a\nb", "en", "s", 3, 9, 8), (2, None, "en", "s", 0, 9, 8)],
                               "doc_id long, text string, lang string, source string, n_chars long, line_dedup int, `x.y` int")
    out = corpus_pipeline.line_stage(spark, df, None)
    assert out.columns == df.columns and sorted(r.line_dedup for r in out.collect()) == [9, 9]
    rows = lines.remove_repeated_lines(df).collect()
    assert {r.line_dedup.n_deleted for r in rows} == {0} and "x.y" in lines.remove_repeated_lines(df).columns
