"""Queries of the training-data operators, each over its whole table with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, decontaminate, embeddings, fim, lines, mixing, negatives, ngram_join, packing, quality, secrets, toxicity, urls

#: Rules of the url query: verdict, host (and its subdomains), path prefix.
URL_RULES = [("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"),
             ("allow", "com", "/fr/"), ("block", "com", "/de/")]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path() -> str:
    """The public 50k byte-level vocabulary; installed beside the library, never copied."""
    import public_tokenizers

    return str(public_tokenizers.path("byte_bpe_50k.json"))


def _held_out(modulus: int, remainder: int):
    return (F.crc32(F.col("doc_id").cast("string")) % modulus == remainder).alias("held_out")


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    labels = quality.training_labels(table(spark, sf_dir, "labels"), "quality", 5, 0)
    scored = quality.score_quality(docs, quality.fit_quality(docs, labels))
    return scored.select("doc_id", _held_out(5, 0), "score", (F.col("score") >= quality.KEEP_SCORE).cast("int").alias("predicted"))


def op2_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], turns.schema)
    return chat.chat_digest(chat.format_conversations(turns.unionByName(extra)))


def op3_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.near_duplicate_components(table(spark, sf_dir, "documents"))


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = packing.pack_documents(table(spark, sf_dir, "documents"), tokenizer_path(), keep_ids=False)
    return packed.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def op5_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.secret_digest(secrets.find_secrets(table(spark, sf_dir, "documents")))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    labels = quality.training_labels(table(spark, sf_dir, "labels"), "toxic", 3, 1)
    scored = toxicity.score_toxicity(docs, toxicity.fit_toxicity(docs, labels))
    return scored.select("doc_id", _held_out(3, 1), "score", (F.col("score") >= toxicity.TOXIC_SCORE).cast("int").alias("predicted"), "evidence")


def op7_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddings.near_duplicate_vectors(table(spark, sf_dir, "embeddings"))


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.filter_urls(table(spark, sf_dir, "pages"), urls.rules_frame(spark, URL_RULES))


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.find_contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return decontaminate.contamination_digest(found)


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.line_digest(lines.remove_repeated_lines(table(spark, sf_dir, "documents")))


def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fim.fim_digest(fim.fill_in_middle(table(spark, sf_dir, "documents").select("doc_id", "text")))


def op12_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return mixing.mix_digest(docs, mixing.ranked_weights(docs))


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", moved.alias("label"), "embedding")
    return negatives.mine_hard_negatives(vectors, F.col("vec_id") % 50 == 0)


QUERIES = {f.__name__: f for f in (
    op1_quality, op2_chat, op3_ngram_jaccard, op4_packing, op5_secrets, op6_toxicity, op7_embedding_dedup, op8_url_filter,
    op9_decontamination, op10_line_dedup, op11_fill_in_middle, op12_source_mix, op13_hard_negatives)}

#: SQL equivalents, where SQL can express the operator at a bearable cost.
ORACLES: dict[str, str] = {}

_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_COMPONENTS = """r(x, c) AS (SELECT id, id FROM node UNION SELECT l.x, r.c FROM r JOIN l ON l.y = r.x)"""

ORACLES["op2_chat"] = r"""
WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, n, role, '</s>[INST] ok [/INST]' FROM (VALUES (0, 'user'), (1, 'assistant')) x(n, role)),
m AS (SELECT *, len(regexp_extract_all(role || ' ' || text, '\\|<\|[A-Za-z0-9_]+\|>|</?s>|\[/?(INST|SYS)\]|<</?SYS>>')) AS marks FROM t)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY turn, role, text), '')) AS loss_sha256,
  sum(23 + length(role) + length(text) + marks)::BIGINT AS formatted_chars FROM m GROUP BY conv_id"""

ORACLES["op3_ngram_jaccard"] = rf"""
WITH RECURSIVE d AS (SELECT doc_id AS id, list_filter(regexp_split_to_array({_LOWER.format("coalesce(text, '')")}, '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w FROM documents),
s AS (SELECT DISTINCT id, array_to_string(w[i:i + 4], ' ') AS g FROM (SELECT id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT id, count(*) AS n FROM s GROUP BY id), node AS (SELECT id FROM d),
p AS (SELECT a.id AS x, b.id AS y, count(*) AS k FROM s a JOIN s b ON a.g = b.g AND a.id <> b.id GROUP BY ALL),
l AS (SELECT x, y FROM p JOIN n a ON a.id = x JOIN n b ON b.id = y WHERE 100 * k >= 75 * (a.n + b.n - k)),
{_COMPONENTS}
SELECT d.id AS doc_id, coalesce(any_value(n.n), 0) AS n_shingles, min(c) AS component_id FROM d LEFT JOIN n USING (id) JOIN r ON r.x = d.id GROUP BY d.id"""

ORACLES["op7_embedding_dedup"] = f"""
WITH RECURSIVE v AS (SELECT vec_id AS id, label, embedding::DOUBLE[] AS e FROM embeddings), node AS (SELECT id FROM v),
l AS (SELECT a.id AS x, b.id AS y FROM v a JOIN v b ON a.label = b.label AND a.id <> b.id WHERE list_cosine_similarity(a.e, b.e) >= 0.93),
k AS (SELECT x AS id, count(*) AS n FROM l GROUP BY x), {_COMPONENTS}
SELECT v.id AS vec_id, coalesce(any_value(k.n), 0) AS n_links, min(c) AS component_id, v.id = min(c) AS kept FROM v LEFT JOIN k USING (id) JOIN r ON r.x = v.id GROUP BY v.id"""

ORACLES["op8_url_filter"] = rf"""
WITH u AS (SELECT page_id, {_LOWER.format("coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), '')")} AS host,
  coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path FROM pages),
h AS (SELECT *, host = 'org' OR ends_with(host, '.org') AS org, host = 'com' OR ends_with(host, '.com') AS com,
  host = 'example.org' OR ends_with(host, '.example.org') AS ex FROM u),
j AS (SELECT page_id, host, path, CASE WHEN ex AND starts_with(path, '/en/1') THEN 'example.org/en/1' WHEN ex AND starts_with(path, '/es/') THEN 'example.org/es/'
  WHEN org AND starts_with(path, '/') THEN 'org/' WHEN com AND starts_with(path, '/fr/') THEN 'com/fr/' WHEN com AND starts_with(path, '/de/') THEN 'com/de/' END AS rule FROM h)
SELECT *, CASE WHEN rule IN ('example.org/en/1', 'example.org/es/', 'com/de/') THEN 'block' ELSE 'allow' END AS verdict FROM j"""

ORACLES["op9_decontamination"] = rf"""
WITH w AS (SELECT doc_id, regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
g AS (SELECT DISTINCT item_id, n, array_to_string(w[i:i + n - 1], ' ') AS g FROM (SELECT item_id, w, least(13, len(w)) AS n, unnest(range(1, len(w) - least(13, len(w)) + 2)) AS i FROM b WHERE len(w) > 0)),
z AS (SELECT DISTINCT n FROM g),
m AS (SELECT doc_id, i, n, item_id FROM (SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS g FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM w, z WHERE len(w) >= n)) JOIN g USING (n, g)),
c AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM m) GROUP BY doc_id),
k AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS ids FROM (SELECT DISTINCT doc_id, item_id FROM m) GROUP BY doc_id)
SELECT doc_id, len(w.w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w.w) AS contaminated FROM w LEFT JOIN c USING (doc_id) LEFT JOIN k USING (doc_id)"""

ORACLES["op11_fill_in_middle"] = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, length(coalesce(text, ''))::BIGINT AS n, sha256('1:' || coalesce(doc_id::VARCHAR, '')) AS x FROM documents),
h AS (SELECT *, ('0x' || x[1:8])::BIGINT AS h1, ('0x' || x[9:16])::BIGINT AS h2, ('0x' || x[17:24])::BIGINT AS h3, ('0x' || x[25:32])::BIGINT AS h4 FROM d),
f AS (SELECT doc_id, t, n, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
  CASE WHEN n = 0 OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 90 THEN 'plain' WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM h),
p AS (SELECT *, substr(t, 1, a) AS p, substr(t, a + 1, b - a) AS m, substr(t, b + 1) AS s FROM f)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN a END AS prefix_chars, CASE WHEN form <> 'plain' THEN b - a END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256,
  sha256(t) AS restored_sha256 FROM p"""


def _mix_sql() -> str:
    """The rounds of the mix, unrolled: documents that still fit, in order of their hash, as far as the rest reaches."""
    out = r"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
  ('0x' || md5(':' || coalesce(doc_id::VARCHAR, '') || ':' || coalesce(text, ''))[1:15])::BIGINT AS h FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS z, ((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::BIGINT AS w FROM d GROUP BY source),
c AS (SELECT *, sum(3 * z) OVER o - 3 * z AS capped, sum(w) OVER () - sum(w) OVER o + w AS left_w, sum(z) OVER () AS total FROM s WINDOW o AS (ORDER BY 3 * z / w, source)),
l AS (SELECT max((total - capped)::DOUBLE / left_w) AS share FROM c WHERE (total - capped)::DOUBLE / left_w * w <= 3 * z),
t AS (SELECT source, z, least((3 * z)::DOUBLE, share * w) AS target FROM s, l),
r0 AS (SELECT d.*, z, target, CASE WHEN z > 0 THEN least(floor(target / z), 3) ELSE 0 END::BIGINT AS times, false AS taken FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)"""
    for n in range(1, mixing.ROUNDS + 1):
        out += f""",
b{n} AS (SELECT *, target - times * z - sum(CASE WHEN taken THEN size ELSE 0 END) OVER (PARTITION BY source) AS rest FROM r{n - 1}),
f{n} AS (SELECT *, NOT taken AND size > 0 AND size <= rest AS fits FROM b{n}),
r{n} AS (SELECT doc_id, source, size, h, z, target, times, taken OR (fits AND sum(CASE WHEN fits THEN size ELSE 0 END) OVER (PARTITION BY source ORDER BY h) <= rest) AS taken FROM f{n})"""
    return out + f"""
SELECT doc_id, size, z AS source_size, target, (size * (times + taken::INT))::BIGINT AS taken FROM r{mixing.ROUNDS}"""


ORACLES["op12_source_mix"] = _mix_sql()

ORACLES["op13_hard_negatives"] = """
WITH v AS (SELECT vec_id AS id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.id AS a, b.id AS b, a.label = b.label AS same, list_inner_product(a.e, b.e)::BIGINT AS score FROM v a JOIN v b ON a.id <> b.id WHERE a.id % 50 = 0),
p AS (SELECT a, b, score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY a ORDER BY score DESC, b) <= 5)
SELECT p.a AS anchor_id, p.b AS positive_id, row_number() OVER (PARTITION BY p.a, p.b ORDER BY n.score DESC, n.b)::INT AS rank, n.b AS negative_id, p.score AS positive_score, n.score AS negative_score
FROM p JOIN s n ON n.a = p.a AND NOT n.same AND 50 * p.score <= 100 * n.score AND 100 * n.score <= 95 * p.score
QUALIFY row_number() OVER (PARTITION BY p.a, p.b ORDER BY n.score DESC, n.b) <= 3"""
