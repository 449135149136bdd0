"""Nulls, empty and long texts, ties, repeated rows, empty tables and clashing column names, for every operator."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkveil.llm import chat, decontaminate, embeddings, lines, ngram_join, packing, quality, secrets, toxicity, urls
from sparkveil.llm.queries import tokenizer_path

SCHEMA = "doc_id long, text string, row string, d string, t string, runs string, h string, text_key string, score double, bin string"
LONG = " ".join(f"w{i % 977}x{i}" for i in range(30_000))
TEXTS = [(1, "a b c d e f g"), (2, None), (3, ""), (4, " \n\t "), (5, LONG), (6, "short one"), (6, "short one"), (None, "no id here"),
         (7, "a b c d e f g"), (8, "💣 é\x00 z" * 3), (9, "same same same same same same")]
DOCS = [(i, t, "r", "d", "t", "x", "h", "k", 0.5, "b") for i, t in TEXTS]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(DOCS, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def test_quality(spark, docs, none):
    labels = spark.createDataFrame([(i, i % 2) for i in range(50)], "doc_id long, label int")
    model = quality.fit_quality(docs, labels)
    rows = quality.score_quality(docs, model).collect()
    assert len(rows) == len(DOCS) and all(0 <= r.score <= 1 for r in rows)
    assert quality.keep_quality(docs, model).columns == docs.columns
    empty = quality.fit_quality(none, labels.where("false"))
    assert {r.score for r in quality.score_quality(docs, empty).collect()} == {0.5}
    assert quality.score_quality(none, model).count() == 0


def test_trees_learn_and_flatten():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(3000, 5))
    y = ((x[:, 0] > 0.3) ^ (x[:, 3] > 0)).astype(float)
    model = quality.fit_trees(x[:2000], y[:2000])
    assert ((model.score(x[2000:]) > 0.5) == y[2000:]).mean() > 0.95


def test_chat(spark):
    rows = [(1, 0, "user", "\\ <|end|> [INST] </s> \\n"), (1, 1, "assistant", None), (1, 1, "assistant", "ok\n<|says|>"),
            (None, 0, None, "x"), (2, None, "system", ""), (2, 0, "assistant", "<<SYS>> <|turn|>assistant<|says|>\\")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("formatted", F.lit(1))
    read = {r.conv_id: r for r in chat.parse_formatted(chat.format_conversations(df)).collect()}
    assert [(t.role, t.text) for t in read[1].turns] == [("user", rows[0][3]), ("assistant", ""), ("assistant", rows[2][3])]
    assert [(t.role, t.text) for t in read[None].turns] == [("", "x")]
    assert [(t.role, t.text) for t in read[2].turns] == [("system", ""), ("assistant", rows[5][3])]
    assert read[1].formatted.count("<|end|>") == 3 and "[INST]" not in read[1].formatted
    assert chat.chat_digest(chat.format_conversations(df.where("false"))).count() == 0


def test_chat_parts(spark):
    part = lambda kind, text=None, **k: {"type": kind, "text": text, "ref": None, "width": None, "height": None, "seconds": None, "pages": None, **k}
    parts = [part("text", "see "), part("image", ref="i.png", width=56, height=29), part("text", " <|image_0|> and "), part("audio", ref="a.wav", seconds=2.0),
             part("document", pages=3), part(None, "end")]
    df = spark.createDataFrame([(1, 0, "assistant", parts), (1, 1, "user", None)], f"conv_id long, turn long, role string, parts array<{chat.PART}>")
    row = chat.format_conversations(df).first()
    assert row.formatted == "<|turn|>assistant<|says|>see <|image_0|> <\\|image_0|> and <|audio_1|><|document_2|>end<|end|><|turn|>user<|says|><|end|>"
    assert [(a.turn_no, a.place, a.type, a.ref, a.tokens) for a in row.attachments] == [
        (0, 0, "image", "i.png", 4), (0, 1, "audio", "a.wav", 50), (0, 2, "document", None, 768)]
    assert row.attachment_tokens == 822


def test_ngram_join(docs, none):
    got = sorted((r.doc_id or 0, r.n_shingles, r.component_id) for r in ngram_join.near_duplicate_components(docs).collect())
    want = {1: (3, 1), 2: (0, 2), 3: (0, 3), 4: (0, 4), 6: (1, 6), 7: (3, 1), 8: (3, 8), 9: (1, 9)}
    for i, n, c in got:
        if i in want:
            assert (n, c) == want[i]
    assert len(got) == len(DOCS) and (0, 1, None) in got
    kept = ngram_join.keep_one_per_group(docs)
    assert kept.columns == docs.columns and sorted(r.doc_id or 0 for r in kept.collect()) == [0, 1, 2, 3, 4, 5, 6, 8, 9]  # of the equal rows of id 6 one stays
    assert ngram_join.near_duplicate_components(none).count() == 0


def test_packing(docs, none):
    rows = packing.pack_documents(docs, tokenizer_path()).collect()
    assert len({r.row for r in rows}) == len(DOCS) and all(1 <= r.length <= 2048 and len(r.ids) == r.length for r in rows)
    by = {}
    for r in rows:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for places in by.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 2048
    assert [r.length for r in rows if r.doc_id in (2, 3)] == [1, 1]
    assert packing.pack_documents(none, tokenizer_path(), keep_ids=False).count() == 0


def test_tokens_equal_the_library():
    from tokenizers import Tokenizer

    rng = np.random.default_rng(5)
    signs = list("ab'sStrevdlm  \n\t  é1٣!.,😀ß-_") + ["<|endoftext|>", "'ll", " '", "\u200b"]
    texts = ["".join(rng.choice(signs, rng.integers(0, 40))) for _ in range(3000)] + [LONG]
    plain = Tokenizer.from_file(tokenizer_path())
    plain.encode_special_tokens = True
    want = [e.ids for e in plain.encode_batch(texts, add_special_tokens=False)]
    assert [g.tolist() for g in packing.WordTokenizer(tokenizer_path()).encode(texts)] == want


def test_sum_of_squares_fills_sequences():
    lengths = np.random.default_rng(2).integers(1, 2048, 5000)
    where, offset = packing.sum_of_squares(np.sort(lengths)[::-1])
    assert np.bincount(where, np.sort(lengths)[::-1]).max() <= 2048 and where.max() + 1 <= 1.05 * lengths.sum() / 2048


@pytest.mark.parametrize("text,base", [
    ("", []), ("password = 'abcdefghijkl'", [(0, 24, "assign")]), ("token: short", []), ("API_KEY=aaaaaaaaaaaa", [(0, 20, "assign")]),
    ("token:secret:abcdefghijkl", []), ("pa\u017f\u017fword=abcdefghijklm", []),
    ("AKIAABCDEFGHIJKLMN", [(0, 18, "access")]), ("AKIAABC", []), ("é 0123456789abcdef", [(2, 18, "hex")]), ("0123456789abcde", []),
    ("secret=0123456789abcdef", [(0, 23, "assign"), (7, 23, "hex")]),
])
def test_secret_base(text, base):
    assert secrets.base_spans(text) == base


def test_secret_entropy():
    got = secrets.scan_text("key Zx9Qw3Er7Ty1Ui5Op8As2Df6Gh here, 550e8400-e29b-41d4-a716-446655440000 and theverylongplainwordwithoutdigits")[1]
    assert got and {k for _, _, k in got} <= {"entropy", "hex"} and got[0][0] == 4
    text = "Zx9Qw3Er7Ty1Ui5Op8As2Df6Gh"
    for start, entropy in secrets.entropy_windows(text):
        window = text[start:start + secrets.WINDOW]
        share = [window.count(c) / len(window) for c in set(window)]
        assert abs(entropy + sum(p * np.log2(p) for p in share)) < 1e-9


def test_secret_frames(docs, none):
    assert secrets.secret_digest(secrets.find_secrets(docs)).count() == len(DOCS) and secrets.find_secrets(none).count() == 0


def test_toxicity(spark, docs, none):
    train = spark.createDataFrame([(i, ("vile nasty " if i % 3 == 0 else "") + f"plain words number {i} here") for i in range(300)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(300)], "doc_id long, label int")
    index = toxicity.fit_toxicity(train, labels)
    test = spark.createDataFrame([(1, "so vile and nasty"), (2, "plain words"), (3, None)], "doc_id long, text string")
    rows = {r.doc_id: r for r in toxicity.score_toxicity(test, index).collect()}
    assert rows[1].score > 0.7 and rows[2].score < 0.3 and rows[3].score < 0.5 and rows[1].evidence[0].toxic
    blank = toxicity.fit_toxicity(docs, labels.where("false"))
    assert {r.score for r in toxicity.score_toxicity(docs, blank).collect()} == {0.0}
    assert toxicity.score_toxicity(none, index).count() == 0


def test_block_max_is_exact():
    rng = np.random.default_rng(4)
    terms = np.sort(rng.integers(0, 2**63, 40).astype(np.uint64))
    rows = [rng.choice(terms, rng.integers(1, 12)) for _ in range(500)]
    index = toxicity.build_index(np.arange(500), (rng.random(500) < 0.3).astype(float), rows, terms, rng.integers(1, 200, 40), 500)
    dense = np.zeros((500, 40))
    for i, r in enumerate(rows):
        t, w = index.vector(r)
        dense[i, t] = w
    for q in rows[:60]:
        t, w = index.vector(q)
        names, best, told = index.nearest(t, w)
        names = index.ids[names]
        full = dense[:, t] @ w
        order = np.lexsort((np.arange(500), -np.round(full, 12)))[:toxicity.NEIGHBOURS]
        assert names.tolist() == order.tolist() and np.allclose(best, full[order])


def test_documents_are_searched_together():
    """A product of a chunk's bounds and lookups of a whole batch give what each document gives alone."""
    rng = np.random.default_rng(5)
    terms = np.unique(np.concatenate([rng.integers(0, 2**64, 300, dtype=np.uint64), np.array([0, 1, 2**64 - 1], dtype=np.uint64)]))
    rows = [rng.choice(terms, rng.integers(1, 40)) for _ in range(400)] + [terms[-3:], terms[:2]]
    index = toxicity.build_index(np.arange(402), (rng.random(402) < 0.3).astype(float), rows, terms, rng.integers(1, 200, len(terms)), 402)
    strange = rng.integers(0, 2**64, 500, dtype=np.uint64)
    asked = [np.concatenate([r, strange[:n % 7]]) for n, r in enumerate(rows)] + [strange, strange[:0], terms[rng.permutation(len(terms))]]
    cuts = np.concatenate(([0], np.cumsum([len(r) for r in asked])))
    known, at = index.places.of(np.concatenate(asked))
    assert (terms[at] == np.concatenate(asked)[known]).all() and len(known) == np.isin(np.concatenate(asked), terms).sum()
    vectors = index.vectors(cuts, np.concatenate(asked))
    assert len(vectors) == len(asked) > toxicity.TOGETHER and all(len(v[0]) == 0 for v in vectors[402:404])
    for r, (t, w), found in zip(asked, vectors, index.searched(vectors)):
        one = index.vector(r)
        assert (t == one[0]).all() and (w == one[1]).all()
        assert all((a == b).all() for a, b in zip(found, index.nearest(*one)))
    none = toxicity.build_index(np.zeros(0, dtype=np.int64), np.zeros(0), [], terms[:0], np.zeros(0, dtype=np.int64), 3)
    assert [len(v[0]) for v in none.vectors(cuts, np.concatenate(asked))] == [0] * len(asked)


def test_word_beginnings_tell_their_bytes_apart():
    import pyarrow as pa

    words = ["a", "A", "ab", "abc", "abcd", "abcde", "abcx", "\u00e9", "\u00e9\u00e9", "\u00e9\u00e9z", "ba", "z"]
    (_, cuts, found), = toxicity.term_batches(pa.array(words))
    seen = {}
    for w, h in zip(words, found[1::2].tolist()):
        seen.setdefault(w.encode().lower()[:4], set()).add(h)
    assert cuts.tolist() == list(range(0, 2 * len(words) + 1, 2))
    assert all(len(h) == 1 for h in seen.values()) and len(set.union(*seen.values())) == len(seen)


def test_e8_is_nearest():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(200, 8)) * 2
    p = embeddings.nearest_e8(x)
    own = ((x - p) ** 2).sum(axis=1)
    for step in embeddings._STEPS:
        assert (own <= ((x - p - step) ** 2).sum(axis=1) + 1e-9).all()


def test_embeddings(spark):
    rng = np.random.default_rng(3)
    rows = []
    for i in range(150):
        v = rng.normal(size=64)
        rows.append((i, v.tolist(), i % 3))
        if i % 10 == 0:
            rows += [(1000 + 10 * i + k, (v + rng.normal(size=64) * (0.1 if k else 0.33)).tolist(), i % 3) for k in range(5)]
    rows += [(9000, None, 1), (9001, [0.0] * 64, 1), (9002, [float("nan")] * 64, 1), (9003, rows[0][1], None), (9004, [None] * 64, 0), (9005, [1.0, 2.0], 0),
             (9006, rows[0][1], 0), (9006, rows[0][1], 0), (9007, [float("inf")] + [1.0] * 63, 0), (9008, [], 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").withColumn("cell", F.lit(1)).withColumn("rid", F.lit(2))
    good = [(n, np.array(v, dtype=np.float32).astype(float), l) for n, (_, v, l) in enumerate(rows) if v and len(v) == 64 and l is not None and None not in v and np.isfinite(v).all() and any(v)]
    x = np.array([v / np.linalg.norm(v) for _, v, _ in good])
    same = (x @ x.T >= 0.93) & (np.array([l for *_, l in good])[:, None] == np.array([l for *_, l in good])[None])
    np.fill_diagonal(same, False)
    links = {n: int(k) for (n, *_), k in zip(good, same.sum(axis=1))}
    want = sorted((rows[n][0], links.get(n, 0)) for n in range(len(rows)))
    out = embeddings.near_duplicate_vectors(df).collect()
    assert sorted((r.vec_id, r.n_links) for r in out) == want
    assert {r.component_id for r in out if r.vec_id == 9006} == {0} and all(r.kept == (r.vec_id == r.component_id) for r in out)
    assert embeddings.near_duplicate_vectors(df.where("false")).count() == 0


def test_vectors_that_meet_by_chance_are_no_pairs(spark, monkeypatch):
    """Of unlike vectors hardly any pair becomes a row, though many meet in a cell; passes and broadcasts change no result."""
    rng = np.random.default_rng(11)
    x = rng.normal(size=(2000, 64))
    x[1000:1040] = x[:40] + rng.normal(size=(40, 64)) * 0.1
    df = spark.createDataFrame([(i, v.tolist(), 1) for i, v in enumerate(x)], "vec_id long, embedding array<double>, label int").repartition(3)
    cosines, asked = embeddings._cosines, []

    def counted(pairs, units):
        asked.append(pairs.count())
        return cosines(pairs, units)
    monkeypatch.setattr(embeddings, "_cosines", counted)
    want = [(i, int(i < 40 or 1000 <= i < 1040), i - 1000 if 1000 <= i < 1040 else i) for i in range(2000)]
    for rows, few in ((300_000, 200_000), (8000, 10)):
        monkeypatch.setattr(embeddings, "PASS_ROWS", rows, raising=False)
        monkeypatch.setattr(embeddings, "FEW", few, raising=False)
        assert sorted((r.vec_id, r.n_links, r.component_id) for r in embeddings.near_duplicate_vectors(df).collect()) == want
    assert 0 < sum(asked) < 400


def test_urls(spark):
    rules = urls.rules_frame(spark, [("allow", "org", "/"), ("block", "example.org", "/en/"), ("allow", "example.org", "/en/1"), ("block", "x.com", "/"), ("allow", "x.com", "/"), (None, "y", "/")])
    pages = [(1, "https://www.EXAMPLE.org/en/2?q#f"), (2, "http://example.org/en/12"), (3, "http://notexample.org/en/2"), (4, None), (5, "nothing"), (6, "a://x.com"),
             (7, "a://x.com/"), (8, "a://sub.x.com/é"), (8, "a://sub.x.com/é"), (9, "://"), (10, "http://org"), (None, "http://a.org/")]
    df = spark.createDataFrame(pages, "page_id long, url string").withColumn("host", F.lit("z")).withColumn("stack", F.lit(1))
    rows = urls.filter_urls(df, rules).collect()
    got = {(r.page_id, r.rule, r.verdict) for r in rows}
    assert len(rows) == len(pages)
    assert got == {(1, "example.org/en/", "block"), (2, "example.org/en/1", "allow"), (3, "org/", "allow"), (4, None, "allow"), (5, None, "allow"), (6, None, "allow"),
                   (7, "x.com/", "block"), (8, "x.com/", "block"), (9, None, "allow"), (10, None, "allow"), (None, "org/", "allow")}
    assert urls.filter_urls(df.where("false"), rules).count() == 0 and urls.filter_urls(df, rules.where("false")).count() == len(pages)


def test_decontamination(spark, docs, none):
    passage = " ".join(f"p{i}" for i in range(20))
    items = spark.createDataFrame([(1, passage), (2, "alpha beta"), (3, None), (4, "!!"), (10, passage.upper())], "item_id long, text string")
    texts = [(1, f"x y {passage} z"), (2, " ".join(passage.split()[:12])), (3, "Alpha, BETA alpha"), (4, None), (5, f"{passage} {passage}"), (5, "other"), (None, passage)]
    df = spark.createDataFrame(texts, "doc_id long, text string").withColumn("spans", F.lit(1)).withColumn("items", F.lit(1))
    rows = decontaminate.find_contamination(df, items).collect()
    got = sorted(((r.doc_id or 0), r.n_words, r.n_hit, r.n_items, ",".join(r.item_ids), r.contaminated) for r in rows)
    assert got == [(0, 20, 20, 2, "1,10", True), (1, 23, 20, 2, "1,10", True), (2, 12, 0, 0, "", False), (3, 3, 2, 1, "2", True), (4, 0, 0, 0, "", False),
                   (5, 1, 0, 0, "", False), (5, 40, 40, 2, "1,10", True)]
    assert decontaminate.decontaminate(df, items).columns == df.columns and decontaminate.decontaminate(df, items).count() == 3
    assert decontaminate.find_contamination(docs, items).count() == len(DOCS) and decontaminate.find_contamination(none, items).count() == 0
    assert decontaminate.find_contamination(docs, items.where("false")).where("n_hit > 0").count() == 0


def test_lines(spark, docs, none):
    long = " ".join(f"l{i}" for i in range(30))
    other = " ".join(f"m{i}" for i in range(30))
    texts = [(1, f"top\n{long}\n{other}\ntail"), (2, f"{long}\n{other}\ntail"), (3, f"{long}\nnot\n{other}"), (4, None), (5, ""), (None, f"{long}\n{other}"),
             (6, "\n".join(["same six words are said here"] * 20))]
    df = spark.createDataFrame(texts, "doc_id long, text string").withColumn("row", F.lit(1)).withColumn("stop", F.lit(1))
    rows = {r.doc_id: r for r in lines.remove_repeated_lines(df).collect()}
    assert rows[None].text == f"{long}\n{other}" and rows[1].text == "top\ntail" and rows[2].text == "" and rows[3].text == texts[2][1]
    assert rows[4].text is None and rows[5].text == "" and rows[6].line_dedup.n_deleted == 11  # nine lines make 54 words
    assert lines.remove_repeated_lines(docs).count() == len(DOCS) and lines.remove_repeated_lines(none).count() == 0


@pytest.mark.parametrize("small", [0, 60, 1500])
def test_no_round_packs_more_than_a_chunk(spark, monkeypatch, small):
    seen, save = [], packing.save
    monkeypatch.setattr(packing, "save", lambda df, name: seen.append(save(df, name)) or seen[-1])
    pieces = spark.range(3000 + small).selectExpr("id as row", "0 as piece", "bigint(if(id < 3000, 1100, 900)) as length")
    rows = packing.pack(pieces, chunk=500).collect()
    assert len(rows) == 3000 + small and len({r.row for r in rows}) == 3000 + small
    chunk = [f.groupBy(F.shiftright("bin", 17)).count().agg(F.max("count")).first()[0] for f in seen]
    assert max(chunk) <= 500 and len(seen) <= 4
    by = {}
    for r in rows:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert all(sorted(p)[0][0] == 0 and sum(n for _, n in p) <= 2048 and (len(p) < 2 or sorted(p)[1][0] == sorted(p)[0][1]) for p in by.values())
    assert len(by) <= 3000 * 1.02  # chunks this small cost some sequences each
