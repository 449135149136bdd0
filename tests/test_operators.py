"""Detection, resolution, sanitising, bodies and streams."""

import json
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkveil.operators import detect, pools, sanitize, sessions
from sparkveil.plans import evaluation
from sparkveil.sources import bodies
from sparkveil.streaming import sse


def spans(spark, text):
    df = detect.detect(spark.createDataFrame([(text,)], "text string"))
    return [(s.start, s.end, s.entity_type) for s in df.first().spans]


@pytest.mark.parametrize("text,expected", [
    ("", []), ("no entity", []),
    ("4111111111111111", [(0, 16, "CARD")]), ("4111111111111112", []), ("x4111111111111111", []),
    ("😀 ABCPE1234F", [(2, 12, "PAN")]), ("ABCXE1234F", []),
    ("HDFC0123456!", [(0, 11, "IFSC")]), ("KA01AB1234 22BH1234AA", [(0, 10, "VEHICLE_REG"), (11, 21, "VEHICLE_REG")]),
    ("a.b@ybl", [(0, 7, "UPI")]), ("a.b@sub-x.co", [(0, 12, "EMAIL")]), ("a@b.co.", []),
    ("+919876543210", [(0, 13, "PHONE")]), ("9876543210", [(0, 10, "PHONE")]), ("a9876543210", []), ("98765432101", []),
])
def test_detectors(spark, text, expected):
    assert spans(spark, text) == expected


def test_null_text_has_no_spans(spark):
    assert detect.detect(spark.createDataFrame([(None,)], "text string")).first().spans == []


def test_loser_of_a_rejected_span_survives(spark):
    rows = [(0, 10, "A", 1, 0, 0), (8, 16, "B", 1, 1, 0), (14, 18, "C", 1, 2, 0)]
    df = spark.createDataFrame([(rows,)], f"s {detect.SPANS}")
    assert [(x.start, x.end) for x in df.select(detect.resolve(F.col("s")).alias("r")).first().r] == [(0, 10), (14, 18)]


def test_tier_beats_length_and_neighbours_stay(spark):
    rows = [(0, 30, "PERSON", 2, 8, 0), (5, 10, "PAN", 1, 2, 0), (10, 12, "CARD", 1, 1, 0)]
    df = spark.createDataFrame([(rows,)], f"s {detect.SPANS}")
    assert [x.entity_type for x in df.select(detect.resolve(F.col("s")).alias("r")).first().r] == ["PAN", "CARD"]


def test_model_seam_and_fail_modes(spark):
    model = detect.gazetteer_model({"PERSON": ["Ada Lane"], "ORG": ["Acme"]})
    df = spark.createDataFrame([("Ada Lane of Acme",), (None,)], "text string")
    got = df.select(detect.model_spans(model, "closed")("text").alias("m")).collect()
    assert [(s.start, s.end, s.entity_type) for s in got[0].m.spans] == [(0, 8, "PERSON"), (12, 16, "ORG")]
    wrong = lambda text: [(0, 99, "PERSON")]
    for mode, error in (("open", None), ("closed", "ValueError")):
        row = df.select(detect.model_spans(wrong, mode)("text").alias("m")).first()
        assert row.m.spans == [] and row.m.error == error
    with pytest.raises(ValueError):
        detect.model_spans(model, "other")


def test_sanitize_refuses_restores_and_marks_ingress(spark):
    key = F.unhex(F.lit("11" * 32))
    texts = spark.createDataFrame([("s", 1, "pan ABCPE1234F and ABCPE1234F"), ("s", 2, "mail a@b.co x"), ("s", 3, "nothing"), ("s", 4, None)],
                                  "session_id string, seq long, text string")
    out, registry = sanitize.sanitize(texts, key)
    rows = {r.seq: r for r in out.collect()}
    assert rows[1].status == "ok" and "ABCPE1234F" not in rows[1].sanitized
    assert rows[2].status == "surrogate_domain:EMAIL" and rows[2].sanitized is None
    assert rows[3].sanitized == "nothing" and rows[4].sanitized is None
    minted = registry.first().surrogate
    again = spark.createDataFrame([("s", 9, f"as you said {minted}")], "session_id string, seq long, text string")
    assert sanitize.sanitize(again, key, registry=registry)[0].first().sanitized == f"as you said {minted}"
    back = sanitize.rehydrate(spark.createDataFrame([("s", f"**{minted}**")], "session_id string, text string"), sanitize.decrypt_registry(registry, key))
    assert back.first().rehydrated == "**ABCPE1234F**"


def test_longest_surrogate_first(spark):
    registry = spark.createDataFrame([("s", "Priya Khan", "PERSON", "A"), ("s", "Priya Khanna", "PERSON", "B")],
                                     "session_id string, surrogate string, entity_type string, original string")
    texts = spark.createDataFrame([("s", "Priya Khanna, Priya Khan"), ("t", "Priya Khan")], "session_id string, text string")
    assert sorted(r.rehydrated for r in sanitize.rehydrate(texts, registry).collect()) == ["B, A", "Priya Khan"]


def test_names_are_stable_and_distinct(spark):
    seen = spark.createDataFrame([("s", f"n{i % 60}", "PERSON", i) for i in range(120)], "session_id string, real string, entity_type string, seq long")
    rows = pools.allocate_names(seen, pools.candidate_pools(spark)).collect()
    assert len(rows) == 60 and len({r.surrogate for r in rows}) == 60


def test_epoch_edge(spark):
    rows = [("s", "2024-01-01 00:00:00"), ("s", "2024-01-01 01:00:00"), ("s", "2024-01-01 02:00:01")]
    df = spark.createDataFrame(rows, "session_id string, ts string").withColumn("ts", F.col("ts").cast("timestamp"))
    assert [r.epoch for r in sessions.session_epochs(df, 3600).orderBy("ts").collect()] == [0, 0, 1]


BODY = {"messages": [{"role": "user", "content": "hi"}, {"role": "boss", "content": None}],
        "tools": [{"function": {"arguments": '{"q": "x", "n": 2.50}'}}], "0": "zero"}


def test_walk_and_protocol(spark):
    df = spark.createDataFrame([("s", 0, json.dumps(BODY)), ("s", 1, "[1]"), (None, 2, "{}"), ("s", 3, None)], "session_id string, request_seq int, body string")
    assert [r.text for r in bodies.text_regions(df).orderBy("region_no").collect()] == ["hi", "boss", "x", "zero"]
    assert [r.s for r in df.select(bodies.request_status(F.col("body"), F.col("session_id")).alias("s")).collect()] == [
        "ok", "not_a_json_object", "missing_session", "not_a_json_object"]


def test_rebuild_keeps_untouched_arguments():
    applied = set()
    new = bodies.rebuild(BODY, {("messages", 0, "content"): "yo", ("nope",): "x"}, applied)
    assert new["messages"][0]["content"] == "yo" and new["tools"] == BODY["tools"] and applied == {("messages", 0, "content")}
    changed = bodies.rebuild(BODY, {("tools", 0, "function", "arguments", "q"): "é"}, set())
    assert changed["tools"][0]["function"]["arguments"] == '{"q": "é", "n": 2.5}'


STREAM = 'data: {"choices":[{"delta":{"content":"a"}}]}\r\n\r\n: note\ndata: x\ndata: y\n\nevent: z\rdata: [DONE]'


@pytest.mark.parametrize("n", [1, 2, 3, len(STREAM), len(STREAM) + 2])
def test_sse_any_split(spark, n):
    size = -(-len(STREAM) // n)
    parts = [STREAM[i * size:(i + 1) * size] for i in range(n)]
    df = spark.createDataFrame([("s", i, p) for i, p in enumerate(parts)], "stream_id string, chunk_seq long, chunk string")
    rows = sse.frame_events(df).orderBy("event_seq").collect()
    assert [(r.data, r.kind, r.content) for r in rows][1:] == [("x\ny", "error", ""), ("[DONE]", "done", "")]
    assert (rows[0].kind, rows[0].content) == ("delta", "a")


KNOWN = {"Priya Khan": "Real A", "Priya Khanna": "Real B", "A1": "B2", "B2": "C3"}
WINDOW = sse.Window(KNOWN)
TEXT = "call Priya Khanna now, Priya Khan. A1 B2 Priya"


@pytest.mark.parametrize("size", [1, 3, 10, 100])
def test_release_equals_one_pass(size):
    whole, rest = sse.release(TEXT, True, WINDOW, 12)
    assert rest == "" and "".join(whole) == "call Real B now, Real A. B2 C3 Priya"
    out, buffer = [], ""
    for i in range(0, len(TEXT), size):
        done, buffer = sse.release(buffer + TEXT[i:i + size], False, WINDOW, 12)
        out += done
    assert "".join(out + sse.release(buffer, True, WINDOW, 12)[0]) == "".join(whole)


def test_a_window_takes_any_transform():
    parts, rest = sse.release(TEXT, True, sse.Window(dict.fromkeys(KNOWN, 3), lambda n: ("hit", n)), 12)
    assert rest == "" and parts.count(("hit", 3)) == 4 and parts[0] == "call "
    assert sse.release("A1", False, sse.Window({}), 1) == (["A1"], "")
    with pytest.raises(ValueError):
        sse.release("A1", False, WINDOW, -1)


def test_many_names_cost_no_more_per_character():
    text = "Zora Quill wrote to name 77 x and name 4999 x. " * 400
    cost = {}
    for n in (50, 5000):
        window = sse.Window({f"name {i} x": str(i) for i in range(n)})
        began = time.perf_counter()
        for i in range(0, len(text), 40):
            sse.release(text[i:i + 40], False, window, 12)
        cost[n] = time.perf_counter() - began
    assert cost[5000] < 4 * cost[50]  # hits and noise; an alternation takes a hundred times as long


def _event(content):
    return "data: " + json.dumps({"id": 1, "choices": [{"delta": {"content": content}}]}) + "\r\n\r\n"


FINISH = 'data: {"choices":[{"delta":{},"finish_reason":"stop"}]}\n\n'
REPLY = ": hi\n\n" + _event("call Priya Kh") + FINISH + _event("anna now, Priya Khan. A1") + _event(" B2 Priya") + "data: [DONE]\n\n"
RESTORED = "call Real B now, Real A. B2 C3 Priya"
CHUNKS = "stream_id string, session_id string, chunk_seq long, chunk string, is_last boolean"


def _registry(spark, known=KNOWN, session="s"):
    return spark.createDataFrame([(session, k, "PERSON", v) for k, v in known.items()], "session_id string, surrogate string, entity_type string, original string")


def _content(payloads):
    events = [json.loads(p[6:]) for p in payloads if p.startswith("data: {")]
    return "".join(e["choices"][0]["delta"].get("content", "") for e in events)


@pytest.mark.parametrize("size", [1, 2, 7, 1000])
def test_reply_any_split(size):
    state, out = sse.Reply(), []
    for i in range(0, len(REPLY), size):
        out += sse.take_fragments(state, [(i // size, REPLY[i:i + size], i + size >= len(REPLY))], WINDOW, 12)
    assert _content(p for p, _ in out) == RESTORED and out[-1] == ("data: [DONE]\n\n", "ok") and state.closed
    assert "finish_reason" in out[-2][0] and sum("finish_reason" in p for p, _ in out) == 1
    assert sse.take_fragments(state, [(99, "x", False)], WINDOW, 12) == [(None, "after_end")]


@pytest.mark.parametrize("tail,status,text", [
    ("", "no_done", "see Real A"), ("data: {broken\n\n" + _event("lost"), "malformed_event", "see Real A"), ('data: {"choices":[{"delta":{"content":" cut', "no_done", "see Real A"),
    ('data: {"choices":[{"delta":{"content":" end"}}]}', "no_done", "see Real A end"), ("data: 5\n\n", "malformed_event", "see Real A")])
def test_reply_that_breaks_off_ends_honestly(tail, status, text):
    out = sse.take_fragments(sse.Reply(), [(0, _event("see Priya Khan") + FINISH + tail, True)], WINDOW, 12)
    assert _content(p for p, _ in out) == text and out[-1] == ("data: [DONE]\n\n", status) and "finish_reason" in out[-2][0]


def test_null_content_is_a_slot():
    out = sse.take_fragments(sse.Reply(), [(0, 'data: {"choices":[{"delta":{"content":null}}]}\n\n' + _event("A1") + "data: [DONE]\n\n", True)], WINDOW, 12)
    assert [p for p, _ in out] == [sse.written_event(_event("A1")[6:], ["B2"]), "data: [DONE]\n\n"]


def test_stream_equals_batch(spark, tmp_path):
    parts = [REPLY[i:i + 5] for i in range(0, len(REPLY), 5)]
    both = [(f"r-{s}", s, i, p, i == len(parts) - 1) for s in "st" for i, p in enumerate(parts)]
    for rows in (both[4:], both[:4]):  # later fragments arrive first
        spark.createDataFrame(rows, CHUNKS).coalesce(1).write.mode("append").json(str(tmp_path / "in"))
    registry = _registry(spark).union(_registry(spark, {"Priya Khan": "Other"}, "t"))
    stream = spark.readStream.schema(CHUNKS).option("maxFilesPerTrigger", 1).json(str(tmp_path / "in"))
    run = sse.reply_stream(stream, registry, 12, F.unhex(F.lit("2b" * 32)), None).writeStream.format("memory").queryName("out").option(
        "checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    assert run.awaitTermination(120)
    got = {s: [r.payload for r in spark.table("out").where(f"stream_id = 'r-{s}'").orderBy("out_seq").collect()] for s in "st"}
    assert _content(got["s"]) == RESTORED and _content(got["t"]) == "call Othernanna now, Other. A1 B2 Priya".replace("Othernanna", "Otherna")
    batch = sse.reply_events(spark.createDataFrame(both, CHUNKS), registry, 12).orderBy("stream_id", "out_seq").collect()
    assert {s: [r.payload for r in batch if r.stream_id == f"r-{s}"] for s in "st"} == got


def test_a_silent_stream_ends_after_its_time(spark, tmp_path):
    rows = [("r", "s", 0, _event("see Priya Khan") + FINISH, False)]
    spark.createDataFrame(rows, CHUNKS).coalesce(1).write.json(str(tmp_path / "in"))
    run = sse.reply_stream(spark.readStream.schema(CHUNKS).json(str(tmp_path / "in")), _registry(spark), 12, F.unhex(F.lit("2b" * 32)), 1).writeStream.format("memory").queryName(
        "silent").option("checkpointLocation", str(tmp_path / "cp")).trigger(processingTime="1 second").start()
    try:
        for _ in range(120):
            time.sleep(0.5)
            got = spark.table("silent").orderBy("out_seq").collect()
            if got and got[-1].status == "dropped":
                break
    finally:
        run.stop()
    assert _content(r.payload for r in got) == "see Real A" and got[-1].payload == "data: [DONE]\n\n" and got[-1].status == "dropped"


def test_replies_by_status(spark):
    body = json.dumps({"choices": [{"message": {"role": "A1", "content": "Priya Khan\u00e9"}}], "n": 2.50})
    rows = [("s", 1, 200, body), ("s", 2, 500, body), ("s", 3, 200, "[1]"), ("s", 4, 201, None), ("t", 5, 200, body)]
    df = spark.createDataFrame(rows, "session_id string, request_seq long, http_status int, body string")
    got = {r.request_seq: r.body for r in sanitize.rehydrate_replies(df, _registry(spark)).collect()}
    assert json.loads(got[1])["choices"][0]["message"] == {"role": "B2", "content": "Real A\u00e9"}
    assert {n: got[n] for n in (2, 3, 4, 5)} == {n: b for _, n, _, b in rows if n > 1}


def test_requests_are_refused_whole(spark):
    key = F.unhex(F.lit("11" * 32))
    body = lambda *texts: json.dumps({"messages": [{"role": "user", "content": t} for t in texts]})
    rows = [("s", 1, body("pan ABCPE1234F", "hello Ada Lane")), ("s", 2, body("fine ABCPE1234F", "mail a@b.co")), ("s", 3, "[]"), (None, 4, "{}"), ("s", 5, "{}"),
            ("s", 6, body("boom"))]
    df = spark.createDataFrame(rows, "session_id string, request_seq long, body string")

    def predict(text):
        if "boom" in text:
            raise RuntimeError(text)
        return detect.gazetteer_model({"PERSON": ["Ada Lane"]})(text)

    for mode, failed in (("closed", "model_failed:RuntimeError"), ("open", "ok")):
        out, given = sanitize.sanitize_requests(df, key, detect.model_spans(predict, mode))
        got = {r.request_seq: r for r in out.collect()}
        assert {n: r.status for n, r in got.items()} == {1: "ok", 2: "surrogate_domain:EMAIL", 3: "not_a_json_object", 4: "missing_session", 5: "ok", 6: failed}
        assert all((r.body is None) == (r.status != "ok") for r in got.values())
    assert "ABCPE1234F" not in got[1].body and "Ada" not in got[1].body and got[5].body == "{}"
    back = out.where("request_seq = 1").withColumn("http_status", F.lit(200))
    assert json.loads(sanitize.rehydrate_replies(back, sanitize.decrypt_registry(given, key)).first().body) == json.loads(rows[0][2])


def test_names_differ_across_batches(spark):
    key = F.unhex(F.lit("11" * 32))
    model = detect.model_spans(detect.gazetteer_model({"PERSON": ["Ada Lane", "Bob Hill", "Cy Moss"]}), "closed")
    schema = "session_id string, seq long, text string"
    registry, named = None, {}
    for seq, text in enumerate(("Ada Lane", "Bob Hill met Ada Lane", "Cy Moss and Bob Hill")):
        out, given = sanitize.sanitize(spark.createDataFrame([("s", seq, text)], schema), key, model("text"), registry)
        registry = given if registry is None else registry.unionByName(given)
        known = sanitize.decrypt_registry(registry, key)
        row, new = out.first(), {r.original: r.surrogate for r in sanitize.decrypt_registry(given, key).collect()}
        assert all(named.get(k, v) == v for k, v in new.items())
        named |= new
        assert row.status == "ok" and sanitize.rehydrate(spark.createDataFrame([("s", row.sanitized)], "session_id string, text string"), known).first().rehydrated == text
    assert len(set(named.values())) == 3
    rank = spark.range(5112).select(pools.pool_rank(F.lit("s"), F.lit("PERSON"), pools.pool_place(F.lit("s"), F.lit("PERSON"), F.col("id"))).alias("r"), "id")
    assert rank.where("r != id").count() == 0


def test_a_surrogate_of_two_people_is_an_error(spark):
    registry = _registry(spark).union(_registry(spark, {"A1": "someone else"}))
    fine = spark.createDataFrame([("s", "Priya Khan")], "session_id string, text string")
    assert sanitize.rehydrate(fine, registry).first().rehydrated == "Real A"
    with pytest.raises(Exception, match="name map is broken"):
        sanitize.rehydrate(spark.createDataFrame([("s", "A1")], "session_id string, text string"), registry).collect()


def test_confusion_counts_repeats(spark):
    schema = "example_id int, start int, end int, entity_type string"
    gold = spark.createDataFrame([(1, 0, 4, "PAN"), (1, 5, 9, "PAN")], schema)
    found = spark.createDataFrame([(1, 0, 4, "PAN"), (1, 0, 4, "PAN"), (1, 5, 8, "PAN"), (2, 0, 1, "CARD")], schema)
    rows = {r.entity_type: r for r in evaluation.prf(evaluation.confusion(gold, found)).collect()}
    assert (rows["PAN"].tp, rows["PAN"].fp, rows["PAN"].fn) == (1, 2, 1)
    assert rows["CARD"].precision == 0.0 and rows["CARD"].recall == 0.0 and rows["CARD"].f1 == 0.0


def test_a_value_that_equals_an_earlier_surrogate_comes_back(spark):
    key, schema = F.unhex(F.lit("11" * 32)), "session_id string, seq long, text string"
    first = "+919000000001"
    other = sanitize.sanitize(spark.createDataFrame([("s", 1, first)], schema), key)[0].first().sanitized  # a number that someone else may have
    rows = [("s", 1, f"call {first}"), ("s", 2, f"pan ABCPE1234F, call {other}."), ("s", 3, f"{other} and {first}")]
    out, registry = sanitize.sanitize(spark.createDataFrame(rows, schema), key)
    back = sanitize.rehydrate(out, sanitize.decrypt_registry(registry, key), "sanitized", "kept").collect()
    assert {r.seq: r.rehydrated for r in back} == {n: t for _, n, t in rows} and {r.status for r in back} == {"ok"}
    assert {r.seq: r.kept and [r.sanitized[k.start: k.start + k.length] for k in r.kept] for r in back} == {1: None, 2: [other], 3: [other]}


def test_bodies_are_walked_and_rebuilt_in_slices(spark, monkeypatch):
    import json

    import pyarrow as pa

    monkeypatch.setattr(bodies, "SLICE", 3)
    made = [json.dumps({"m": [{"c": f"t{i}", "arguments": json.dumps({"q": "x"})}] * (i % 3)}) for i in range(10)] + ["{broken", None, "[]"]
    regions = bodies._sliced(bodies._walk_slice, pa.array(made)).to_pylist()
    path = lambda r: tuple(s["idx"] if s["key"] is None else s["key"] for s in r["path"])
    assert [[(path(r), r["text"]) for r in rows] for rows in regions[:10]] == [list(bodies.walk(json.loads(b))) for b in made[:10]] and regions[10:] == [[]] * 3
    changes = [[{"path": r["path"], "text": r["text"] + "!"} for r in rows] or None for rows in regions[:10]]
    back = bodies._sliced(bodies._rebuild_slice, pa.array(made[:10]), pa.array(changes)).to_pylist()
    for body, change, row in zip(made, changes, back):
        n = len(change or [])
        assert (row["applied"], row["unmatched"]) == (n, 0) and [t for _, t in bodies.walk(json.loads(row["body"]))] == [t + "!" for _, t in bodies.walk(json.loads(body))]


def test_shapes_are_found_in_many_texts_at_once():
    import time

    rng = np.random.default_rng(4)
    kind = lambda t: "".join("D" if "0" <= c <= "9" else "u" if "A" <= c <= "Z" else "l" if "a" <= c <= "z" else "o" for c in t)
    texts = ["".join(rng.choice(list("aB1 é\U0001f600"), rng.integers(0, 14))) for _ in range(1500)] + ["", "B", "aB", "1", "aB1"]
    shapes = sorted({kind("".join(rng.choice(list("aB1 "), n))) for n in (1, 2, 3, 5, 6) for _ in range(6)})
    windows = [(i, a, n) for i, t in enumerate(texts) for n in {len(s) for s in shapes} for a in range(len(t) - n + 1)]
    found = lambda finder: sorted(zip(*(x.tolist() for x in finder.places(texts))))
    assert found(sanitize.Shapes(shapes)) == sorted((i, a, n) for i, a, n in windows if kind(texts[i][a: a + n]) in shapes)
    assert found(sanitize.Shapes(None, {len(s) for s in shapes})) == sorted(windows)
    assert found(sanitize.Shapes([])) == [] and [len(x) for x in sanitize.Shapes(shapes).places([])] == [0, 0, 0]
    began = time.process_time()
    row, _, _ = sanitize.Shapes([kind(f"{'A' + 'b' * k} {'C' + 'd' * j}") for k in range(4, 9) for j in range(4, 9)]).places(["Arjan Balakar"] * 20_000)
    assert len(row) >= 20_000 and time.process_time() - began < 3  # text by text: 0.4 ms each
