"""The name tagger, sealed originals, sanitising closed by default, session streams, exact quantiles."""

import glob
import itertools
import json
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkveil.functions.quantiles import greatest, quantiles, ranked_values
from sparkveil.operators import detect, pools, sanitize, sealing, sessions, tagger
from sparkveil.plans import carriers, catalogue, evaluation
from sparkveil.sources import scratch, sinks
from sparkveil.streaming import sessions as streams
from sparkveil.streaming import sse

KEY = "5c" * 32


def key():
    return F.unhex(F.lit(KEY))


# ---------------------------------------------------------------- tagger


@pytest.fixture(scope="module")
def model(spark):
    return tagger.fit_tagger(carriers.carrier_text(spark.range(700), "id", False), epochs=4, shards=3)


def test_names_on_unseen_carriers(spark, model):
    held = carriers.carrier_text(spark.range(400), "id", True)
    gold = held.select(F.col("text_id").alias("example_id"), F.explode("gold").alias("s")).select("example_id", "s.*")
    judged = held.withColumn("_m", tagger.tagger_spans(model, F.col("text"), "closed"))
    found = detect.detect(judged, model=F.col("_m.spans")).select(F.col("text_id").alias("example_id"), F.explode("spans").alias("s"))
    rows = {r.entity_type: r for r in evaluation.prf(evaluation.confusion(gold, found.select("example_id", "s.start", "s.end", "s.entity_type"))).collect()}
    assert set(rows) == set(detect.TYPES)
    assert rows["PERSON"].f1 > 0.7 and rows["ORG"].f1 > 0.6 and rows["ADDRESS"].f1 > 0.9
    assert all(rows[t].f1 == 1.0 for t in detect.DETERMINISTIC)


def test_viterbi_equals_all_sequences():
    rng = np.random.default_rng(1)
    for _ in range(20):
        lengths = rng.integers(1, 5, size=3)
        emitted, moves = rng.normal(size=(3, lengths.max(), len(tagger.LABELS))).astype(np.float32), rng.normal(size=(len(tagger.LABELS),) * 2).astype(np.float32)
        for row, n, got in zip(emitted, lengths, tagger.viterbi(emitted, lengths, moves)):
            worth = lambda s: tagger._BEGIN[s[0]] + sum(row[t, x] for t, x in enumerate(s)) + sum((moves + tagger._ALLOWED)[a, b] for a, b in zip(s, s[1:]))
            best = max(itertools.product(range(len(tagger.LABELS)), repeat=int(n)), key=worth)
            assert worth(tuple(got[:n])) == pytest.approx(worth(best), abs=1e-4)


def test_a_fit_does_not_depend_on_partitions(spark):
    rows = carriers.carrier_text(spark.range(60), "id", False)
    a, b = (tagger.fit_tagger(rows.repartition(n), epochs=2, shards=2) for n in (1, 5))
    assert np.allclose(a.weights, b.weights) and np.allclose(a.moves, b.moves)
    empty = tagger.fit_tagger(rows.where("false"), epochs=1)
    assert not empty.weights.any() and empty.find(["Asha Iyer"]) is not None


def test_tagger_takes_any_text(spark, model):
    long = "word " * 3000 + "Please ask Asha Iyer to sign the form.\n" + "x" * 5000
    texts = ["", None, "\n\n", "💣 ", long, "." * 300]
    found = model.find(texts)
    assert [bool(f) for f in found[:3]] == [False] * 3 and all(0 <= s < e <= len(long) for s, e, _ in found[4])
    assert (15011, 15020, "PERSON") in found[4]
    rows = spark.createDataFrame([(t,) for t in texts], "text string").select(tagger.tagger_spans(model, F.col("text"), "closed").alias("m")).collect()
    assert [r.m.error for r in rows] == [None] * 6
    broken = tagger.Tagger(model.weights[:5], model.moves)
    for mode, error in (("open", None), ("closed", "IndexError")):
        row = spark.createDataFrame([("Asha Iyer",)], "text string").select(tagger.tagger_spans(broken, F.col("text"), mode).alias("m")).first()
        assert row.m.spans == [] and row.m.error == error
    with pytest.raises(ValueError):
        tagger.tagger_spans(model, F.col("text"), "other")


def test_tagged_names_are_exchanged_and_restored(spark, model):
    texts = carriers.carrier_text(spark.range(80), "id", True).select((F.col("text_id") % 3).cast("string").alias("session_id"), F.col("text_id").alias("seq"), "text", "gold")
    out, given = sanitize.sanitize(texts, key(), tagger.tagger_spans(model, F.col("text"), "closed"))
    back = sanitize.rehydrate(out.where("status = 'ok'"), sanitize.decrypt_registry(given, key()), "sanitized").collect()
    assert len(back) > 40 and all(r.rehydrated == r.text for r in back)


# ---------------------------------------------------------------- sanitising


def test_rows_without_a_key_do_not_go_out(spark):
    rows = [(None, 1, "pan ABCPE1234F x"), ("", 1, "pan ABCPE1234F"), ("s", None, "pan ABCPE1234F"), ("s", 2, "pan ABCPE1234F"), ("s", 2, "call +919876543210"),
            ("s", 3, "pan ABCPE1234F"), ("s", 4, None), ("s", 5, ""), ("s", 6, "mail a@b.example")]
    out, given = sanitize.sanitize(spark.createDataFrame(rows, "session_id string, seq long, text string").withColumn("_row", F.lit(1)).withColumn("status", F.lit("old")).drop("status"), key())
    got = {(r.session_id, r.seq, r.text): (r.status, r.sanitized) for r in out.collect()}
    assert [got[r][0] for r in rows] == ["missing_session", "missing_session", "missing_seq", "repeated_seq", "repeated_seq", "ok", "ok", "ok", "surrogate_domain:EMAIL"]
    assert all(v is None for s, v in got.values() if s != "ok") and got[rows[6]][1] is None and got[rows[7]][1] == ""
    assert "ABCPE1234F" not in got[rows[5]][1]


def test_bodies_without_a_key_do_not_go_out(spark):
    body = json.dumps({"messages": [{"role": "user", "content": "pan ABCPE1234F"}]})
    rows = [(None, 1, body), ("s", None, body), ("s", 1, body), ("s", 1, body), ("s", 2, body), ("s", 3, "[]")]
    out, _ = sanitize.sanitize_requests(spark.createDataFrame(rows, "session_id string, request_seq long, body string"), key())
    got = sorted((str(r.session_id), str(r.request_seq), r.status, r.body is None) for r in out.collect())
    assert got == [("None", "1", "missing_session", True), ("s", "1", "repeated_seq", True), ("s", "1", "repeated_seq", True), ("s", "2", "ok", False),
                   ("s", "3", "not_a_json_object", True), ("s", "None", "missing_seq", True)]


def _bytes_below(folder):
    return b"".join(open(f, "rb").read() for f in glob.glob(f"{folder}/**/*", recursive=True) if not __import__("os").path.isdir(f))


def test_no_file_holds_an_original(spark, monkeypatch, tmp_path):
    monkeypatch.setattr(scratch, "shared_dir", lambda _: str(tmp_path))
    spark.conf.set("spark.sql.parquet.compression.codec", "uncompressed")
    try:
        body = json.dumps({"messages": [{"role": "user", "content": "Zelda Quux has pan ABCPE1234F and card 4111111111111111"}]})
        model = detect.gazetteer_model({"PERSON": ["Zelda Quux"]})
        requests = spark.createDataFrame([("s", 1, body)], "session_id string, request_seq long, body string")
        out, given = sanitize.sanitize_requests(requests, key(), lambda t: detect.model_spans(model, "closed")(t))
        assert out.first().status == "ok" and len(given.collect()) == 3
        held = _bytes_below(tmp_path)
        assert len(held) > 1000 and not any(v in held for v in (b"Zelda", b"ABCPE1234F", b"4111111111111111"))
        opened = {r.original for r in sanitize.decrypt_registry(given, key()).collect()}
        assert opened == {"Zelda Quux", "ABCPE1234F", "4111111111111111"}
        with pytest.raises(Exception, match="AES|aes"):
            given.select(sealing.opened(F.col("original"), F.unhex(F.lit("00" * 32)), F.col("session_id"))).collect()
    finally:
        spark.conf.unset("spark.sql.parquet.compression.codec")


def test_rehydrate_joins_true_hits_only(spark):
    known = {"Arjan Balberg": "A", "Arjan Balbergs": "B", "KA11AB1234": "C", "x-y": "D", "é1": "E"}
    registry = spark.createDataFrame([("s", k, "PERSON", v) for k, v in known.items()], "session_id string, surrogate string, entity_type string, original string")
    text = "KA11AB1234 Arjan Balbergs, Arjan BalbergKA11AB1234 x-y é1 Arjun Balberg KA11AB1235"
    df = spark.createDataFrame([("s", text), ("t", text), (None, text), ("s", None), ("s", ""), ("s", text)], "session_id string, text string")
    got = [r.rehydrated for r in sanitize.rehydrate(df, registry).orderBy("session_id", "text").collect()]
    assert sorted(map(str, got)) == sorted(["None", "", text, text, "C B, AC D E Arjun Balberg KA11AB1235", "C B, AC D E Arjun Balberg KA11AB1235"])
    hits = sanitize.surrogate_hits(df, sanitize.known_surrogates(registry), "text").collect()
    assert len(hits) == 7  # the shorter name inside the longer one, too
    assert sanitize.rehydrate(df, registry.where("false")).where("rehydrated is distinct from text").count() == 0


def test_many_shapes_are_searched_by_length(spark, monkeypatch):
    monkeypatch.setattr(sanitize, "MOST_SHAPES", 1)
    registry = spark.createDataFrame([("s", "A1", "PERSON", "one"), ("s", "b-2", "PERSON", "two")], "session_id string, surrogate string, entity_type string, original string")
    df = spark.createDataFrame([("s", "xA1b-2A")], "session_id string, text string")
    assert sanitize.rehydrate(df, registry).first().rehydrated == "xonetwoA"


# ---------------------------------------------------------------- detection


def test_one_scan_equals_every_pattern(spark):
    tricky = ["é123456789012", "x9999900000014 4111111111111111", "+919876543210,09876543210", "a.b@ybl.", "_ABCPE1234F", "HDFC0ABCDEF", "१२३४५६७८९०१२ KA01AB1234", "a@b.co@c.in", "9" * 40,
              "12 3456 7890", "ABCPE1234F-22BH1234AA", "user@okaxis user.1@mail.example.com", "Á999941057058", "z" * 3000 + "1234", ""]
    df = spark.createDataFrame([(t,) for t in tricky], "text string")
    each = F.concat(*[detect.detector_spans(F.col("text"), d) for d in detect.DETECTORS])
    place = lambda spans: F.transform(spans, lambda s: F.struct(s["start"], s["end"], s["entity_type"]))
    rows = df.select("text", F.array_sort(place(each)).alias("a"), F.array_sort(place(detect.deterministic_spans(F.col("text")))).alias("b")).collect()
    assert all(r.a == r.b for r in rows) and sum(len(r.a) for r in rows) > 7


def test_ten_thousand_spans(spark):
    spans = [(i * 2, i * 2 + 3, "PAN", 1, 2, i) for i in range(10_000)]
    df = spark.createDataFrame([(spans,)], f"s {detect.SPANS}").coalesce(1).cache()
    df.count()
    began = time.perf_counter()
    got = df.select(detect.resolve(F.col("s")).alias("r")).first().r
    assert [x.start for x in got] == list(range(0, 20_000, 4)) and time.perf_counter() - began < 5


@pytest.mark.parametrize("n", [33, 200])
def test_halving_equals_comparing_all(spark, n, monkeypatch):
    rng = np.random.default_rng(n)
    spans = [(int(a), int(a + b), t, int(tier), detect.TYPES.index(t), i) for i, (a, b, t, tier) in enumerate(
        zip(rng.integers(0, 400, n), rng.integers(1, 30, n), rng.choice(detect.TYPES, n), rng.integers(1, 3, n)))]
    df = spark.createDataFrame([(spans,)], f"s {detect.SPANS}")
    fast = df.select(detect.resolve(F.col("s")).alias("r")).first().r
    monkeypatch.setattr(detect, "FEW_SPANS", 10**6)
    assert fast == df.select(detect.resolve(F.col("s")).alias("r")).first().r


# ---------------------------------------------------------------- streams


def _requests(n_sessions=2, n=6):
    rows = []
    for s in range(n_sessions):
        for i in range(n):
            said = f"Ada Lane and {['Bob Hill', 'Cy Moss'][i % 2]} with pan {'ABCDE'[i % 5]}BCPE1234F" + (" a@b.example" if i == 3 else "")
            rows.append((f"s{s}", i, json.dumps({"messages": [{"role": "user", "content": said}, {"role": "tool", "content": "Cy Moss"}]})))
    rows.append(("s0", n, "{broken"))
    return rows


@pytest.mark.parametrize("cuts", [(2, 4), (1, 2, 3, 4, 5, 6)])
def test_sanitize_stream_equals_batch(spark, tmp_path, cuts):
    schema = "session_id string, request_seq long, body string"
    rows = _requests()
    model = detect.gazetteer_model({"PERSON": ["Ada Lane", "Bob Hill", "Cy Moss"]})
    names = lambda t: detect.model_spans(model, "closed")(t)
    df = spark.createDataFrame(rows, schema)
    out, given = sanitize.sanitize_requests(df, key(), names)
    want = sorted((r.session_id, r.request_seq, r.status, r.body) for r in out.collect())
    edges = [0, *cuts, 99]
    batches = [df.where((F.col("request_seq") >= a) & (F.col("request_seq") < b)) for a, b in zip(edges, edges[1:])]
    got = catalogue._streamed(spark, "test-requests", batches, lambda s: streams.sanitize_stream(s, key(), names))
    assert sorted((r.session_id, r.request_seq, r.status, r.body) for r in got.select("session_id", "request_seq", "status", "body").collect()) == want
    handed = sanitize.decrypt_registry(got.select("session_id", F.explode("given").alias("g")).select("session_id", "g.*"), key())
    columns = ["session_id", "surrogate", "entity_type", "original"]
    assert sorted(map(tuple, handed.select(columns).collect())) == sorted(map(tuple, sanitize.decrypt_registry(given, key()).select(columns).collect()))


def test_stream_state_holds_no_original_and_refuses_repeats(spark, tmp_path):
    schema = "session_id string, request_seq long, body string"
    body = json.dumps({"messages": [{"role": "user", "content": "Zelda Quux has pan ABCPE1234F"}]})
    model = detect.gazetteer_model({"PERSON": ["Zelda Quux"]})
    for rows in ([("s", 1, body), ("s", 2, body), ("s", 2, body), (None, 1, body)], [("s", 1, body), ("s", 3, body)]):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    source = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    run = streams.sanitize_stream(source, key(), lambda t: detect.model_spans(model, "closed")(t)).writeStream.format("parquet").option(
        "path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    run.awaitTermination()
    got = sorted((str(r.session_id), r.request_seq, r.status) for r in spark.read.parquet(str(tmp_path / "out")).collect())
    assert got == [("None", 1, "missing_session"), ("s", 1, "ok"), ("s", 1, "repeated_seq"), ("s", 2, "repeated_seq"), ("s", 3, "ok")]
    held = _bytes_below(tmp_path / "state") + _bytes_below(tmp_path / "out")
    assert len(held) > 1000 and b"Zelda" not in held and b"ABCPE1234F" not in held


def test_reply_state_holds_no_original(spark, tmp_path):
    event = lambda text: "data: " + json.dumps({"choices": [{"delta": {"content": text}}]}) + "\n\n"
    rows = [("r", "s", 0, event("see A1 and then "), False), ("r", "s", 1, event('A1 "x'), False), ("r", "s", 2, "data: [DONE]\n\n", True)]
    chunks = "stream_id string, session_id string, chunk_seq long, chunk string, is_last boolean"
    for row in rows:
        spark.createDataFrame([row], chunks).coalesce(1).write.mode("append").json(str(tmp_path / "in"))
    registry = spark.createDataFrame([("s", "A1", "PERSON", 'Zelda "Q" Quux')], "session_id string, surrogate string, entity_type string, original string")
    source = spark.readStream.schema(chunks).option("maxFilesPerTrigger", 1).json(str(tmp_path / "in"))
    run = sse.reply_stream(source, registry, 8, key(), None).writeStream.format("memory").queryName("sealed_reply").option(
        "checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    run.awaitTermination()
    out = [r.payload for r in spark.table("sealed_reply").orderBy("out_seq").collect()]
    said = "".join(json.loads(p[6:])["choices"][0]["delta"]["content"] for p in out[:-1])
    assert said == 'see Zelda "Q" Quux and then Zelda "Q" Quux "x' and out[-1] == "data: [DONE]\n\n"
    assert b"Zelda" not in _bytes_below(tmp_path / "state")


def test_sessions_expire_after_their_time(spark, tmp_path):
    at = lambda s: f"2024-01-01 00:{s // 60:02d}:{s % 60:02d}"
    batches = [[("a", 1, at(0)), ("a", 2, at(60)), ("b", 3, at(10))], [("a", 4, at(121)), ("b", 5, at(71))], [("c", 6, at(900))], [("c", 7, at(901)), ("b", 8, at(960))]]
    frames = [spark.createDataFrame(b, "session_id string, access_id long, ts string").withColumn("ts", F.col("ts").cast("timestamp")) for b in batches]
    out = catalogue._streamed(spark, "test-accesses", frames, lambda s: streams.session_store(s, 60, 5)).collect()
    events = {r.access_id: r.event for r in out if r.access_id is not None}
    assert events == {1: "created", 2: "touched", 3: "created", 4: "created", 5: "created", 6: "created", 7: "touched", 8: "created"}
    assert sorted(r.session_id for r in out if r.event == "expired") == ["a"]  # b came back before its timer was looked at


def test_last_used_sessions_stay(spark):
    rows = [(i, i // 3) for i in range(300)] + [(i, 5) for i in range(300, 320)]
    df = spark.createDataFrame(rows, "session_id long, s long").select("session_id", F.timestamp_seconds("s").alias("ts"))
    for capacity in (0, 1, 7, 299, 400):
        want = sorted(rows, key=lambda r: (-r[1], -r[0]))[:capacity]
        assert sorted(r.session_id for r in sessions.evict_least_recent(df, capacity).collect()) == sorted(i for i, _ in want)


def test_candidates_agree_with_the_pools(spark):
    for kind, size in pools.POOL_SIZES.items():
        asked = spark.createDataFrame([("s", kind, r) for r in (0, 1, 77, size - 1)], "session_id string, entity_type string, rank long")
        asked = asked.withColumn("pos", pools.pool_place(F.col("session_id"), F.col("entity_type"), F.col("rank")))
        for r in asked.join(pools.candidate_pools(spark), ["entity_type", "pos"]).collect():
            assert pools.candidate_at("s", kind, r["rank"]) == r.candidate
        assert pools.candidate_at("s", kind, size) is None


# ---------------------------------------------------------------- sinks


def test_audit_and_reports_say_no_value(spark, tmp_path):
    found = detect.detect(spark.createDataFrame([("s", "1", "pan ABCPE1234F to a@b.example")], "session_id string, correlation_id string, text string"))
    rows = sinks.audit_rows(sinks.span_events(found).withColumn("secret", F.lit("ABCPE1234F")))
    assert tuple(rows.columns) == sinks.AUDIT_FIELDS
    sinks.write_jsonl(rows, str(tmp_path / "audit"), ["entity_type"])
    lines = [json.loads(r.value) for r in spark.read.text(str(tmp_path / "audit")).collect()]
    assert sorted((x["entity_type"], x["span_length"], x["status"]) for x in lines) == [("EMAIL", 11, "refused"), ("PAN", 10, "ok")]
    assert not any(v in json.dumps(lines) for v in ("ABCPE1234F", "a@b"))
    report = sinks.markdown_report(rows.groupBy("status").count().orderBy("status"))
    assert report.splitlines() == ["| status | count |", "| - | - |", "| ok | 1 |", "| refused | 1 |"]
    with pytest.raises(ValueError):
        sinks.markdown_report(spark.range(5), 3)


# ---------------------------------------------------------------- quantiles


def test_quantiles_are_exact(spark, monkeypatch):
    monkeypatch.setattr("sparkveil.functions.quantiles.FEW", 20)
    monkeypatch.setattr("sparkveil.functions.quantiles.BUCKETS", 8)
    rng = np.random.default_rng(3)
    groups = {"even": rng.normal(size=500), "ties": np.repeat([1.0, 2.0, 3.0], [400, 5, 100]), "far": np.concatenate((rng.normal(size=300), [1e300, -1e300])), "one": np.array([7.0]), None: np.arange(50.0)}
    rows = [(g, float(v)) for g, vs in groups.items() for v in vs] + [("even", None), ("none", None)]
    df = spark.createDataFrame(rows, "g string, v double").repartition(4)
    got = {r.g.g: (r.q0, r.q1, r.q2, r.q3) for r in quantiles(df, ["g"], "v", (0.0, 0.5, 0.95, 1.0)).collect()}
    assert set(got) == set(groups)
    for g, vs in groups.items():
        assert got[g] == pytest.approx(np.quantile(vs, (0.0, 0.5, 0.95, 1.0)), rel=1e-12)
    odd = spark.createDataFrame([("g", v) for v in (float("inf"), float("-inf"), float("nan"), 0.0, -0.0, 1.0)], "g string, v double")
    ranks = spark.createDataFrame([("g", i) for i in range(-1, 7)], "g string, rank long")
    found = {r["rank"]: r.value for r in ranked_values(odd, ranks).collect()}
    assert found[0] == float("-inf") and found[1] == found[2] == 0.0 and found[3] == 1.0 and found[4] == float("inf") and found[5] != found[5] and len(found) == 6
    assert quantiles(df.where("false"), ["g"], "v", (0.5,)).count() == 0 and greatest(df, "v", "g", 3).count() == 3


def test_features_of_many_sentences_are_those_of_each(monkeypatch):
    said = [["Dear", "Asha", "Iyer", ","], ["x"], ["12", "Hill", "Road", ",", "Pune", "."], ["a", "b"]]
    for words, rows in zip(said, tagger._all_features(said), strict=True):
        assert (rows == tagger.features(words)).all() and len(rows) == len(words)
    rng = np.random.default_rng(1)
    model = tagger.Tagger(rng.normal(size=(tagger.WEIGHTS, len(tagger.LABELS))).astype(np.float32), np.zeros((len(tagger.LABELS),) * 2, dtype=np.float32))
    texts = ["Dear Asha Iyer, come. Yes I will", None, "", "12 Hill Road\nPune", "word " * 300]
    whole = model.find(texts)
    assert whole == [model.find([t])[0] for t in texts] and any(whole)
    monkeypatch.setattr(tagger, "TOGETHER", 3)
    assert model.find(texts) == whole


def test_a_micro_batch_is_written_by_many_tasks(spark):
    batches = [spark.range(0, 400).selectExpr("id", "0 as batch"), spark.range(400, 500).selectExpr("id", "1 as batch")]
    before = spark.conf.get("spark.sql.streaming.noDataMicroBatches.enabled")
    out = catalogue._streamed(spark, "test-spread", batches, lambda s: s.withColumn("file", F.input_file_name()))
    rows = out.collect()
    assert sorted(r.id for r in rows) == list(range(500))
    assert all(len({r.file for r in rows if r.batch == b}) == spark.sparkContext.defaultParallelism for b in (0, 1))
    assert spark.conf.get("spark.sql.streaming.noDataMicroBatches.enabled") == before


def test_texts_alone_take_one_table_and_one_call_of_the_model(spark, monkeypatch, tmp_path):
    calls, tables, really = tmp_path / "calls", [], sanitize.written

    def predict(text):
        with open(calls, "a") as f:
            f.write("x")
        if text.startswith("bad"):
            raise RuntimeError
        return [(0, 5, "PERSON")]

    monkeypatch.setattr(sanitize, "written", lambda df, name: tables.append(name) or really(df, name))
    rows = [("s", i, f"{'bad x' if i % 3 == 0 else 'Zelda'} has pan ABCPE1234F") for i in range(30)] + [("s", 30, None), ("s", 31, ""), (None, 32, "Zelda")]
    texts = spark.createDataFrame(rows, "session_id string, seq long, text string")
    alone = sanitize.sanitized_texts(texts, key(), detect.model_spans(predict, "closed")("text")).collect()
    assert tables == ["spans"] and len(calls.read_text()) == 30
    out, _ = sanitize.sanitize(texts, key(), detect.model_spans(predict, "closed")("text"))
    assert tables == ["spans", "spans", "registry"] and sorted(map(str, alone)) == sorted(map(str, out.collect()))
    status = {r.seq: r.status for r in alone}
    assert all(status[i] == ("model_failed:RuntimeError" if i % 3 == 0 else "ok") for i in range(30)) and status[32] == "missing_session"


def test_fail_modes_write_no_registry(spark, monkeypatch):
    from sparkveil.plans import catalogue

    tables, really = [], sanitize.written
    monkeypatch.setattr(sanitize, "written", lambda df, name: tables.append(name) or really(df, name))
    rows = catalogue.QUERIES["detect_fail_modes"](spark, "/root/testdata/sf0.001").collect()
    assert tables == ["spans", "spans"]
    assert {(r.mode, r.status): r.n == r.n_changed for r in rows} == {("open", "ok"): True, ("closed", "ok"): True, ("closed", "model_failed:RuntimeError"): False}
