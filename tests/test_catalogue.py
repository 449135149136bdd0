"""Every query of the catalogue against its SQL, on the smallest tables."""

import os

import duckdb
import pytest

from sparkveil.operators import pools
from sparkveil.plans import catalogue

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="needs the test tables")
SAMPLE = ["entity_counts_by_source_lang", "detect_all_injected", "score_prf", "checksum_validity", "mixed_radix_roundtrip",
          "name_alloc_sessions", "session_epochs_events", "walk_regions", "rehydrate_conversations", "sanitize_conversations", "sse_out", "score_hard_cases",
          "resolve_overlaps", "adversarial_recall", "request_log_join", "request_outcomes", "latency_cells", "obfuscate_values", "sse_frame_batch", "latency_stats", "tier_distribution",
          "detect_carriers", "sanitize_hostile_rows", "session_store_stream", "first_log_stream", "audit_log", "lru_sessions"]


def plain(value):
    return round(value, 6) if isinstance(value, float) else str(value)[:19] if hasattr(value, "isoformat") else value


@pytest.mark.parametrize("name", SAMPLE)
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    df = catalogue.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    got = sorted(tuple(str(plain(r[c])) for c in columns) for r in df.collect())
    rel = con.execute(catalogue.ORACLES[name])
    names = [d[0] for d in rel.description]
    rows = sorted(tuple(str(plain(r[names.index(c)])) for c in columns) for r in rel.fetchall())
    assert sorted(names) == columns and got == rows


def test_key_of_a_column_is_not_in_the_plan(spark):
    from pyspark.sql import functions as F

    from sparkveil.operators import domains

    secret = "a5" * 32
    df = spark.createDataFrame([("4111111111111111", bytes.fromhex(secret))], "v string, k binary").repartition(1)
    plan = df.select(domains.phone(F.col("v"), F.col("k")))._jdf.queryExecution().toString().lower()
    assert secret not in plan


def test_names_beyond_the_pool_are_kept(spark, tmp_path):
    orders = spark.range(5200).selectExpr("id * 50 as o_orderkey", "id * 3 as o_custkey")  # one session, persons only
    orders.write.parquet(str(tmp_path / "orders.parquet"))
    got = catalogue.QUERIES["name_alloc_sessions"](spark, str(tmp_path)).select("session_id", "real", "entity_type", "seq", "pos").collect()
    con = duckdb.connect()
    con.execute(f"create view orders as select * from '{tmp_path}/orders.parquet/*.parquet'")
    assert len(got) == 5200 and sorted(map(tuple, got)) == sorted(con.execute(catalogue.ORACLES["name_alloc_sessions"]).fetchall())
    named = pools.allocate_names(catalogue._seen(spark, str(tmp_path)), pools.candidate_pools(spark))
    assert named.where("surrogate is null").count() == 5200 - 5112
    assert named.select("surrogate").distinct().count() == 5112 + 1


def test_bypasses_cover_every_customer_and_type(spark, tmp_path):
    spark.range(1, 41).selectExpr("id as c_custkey").write.parquet(str(tmp_path / "customer.parquet"))
    rows = {r.bypass_class: r for r in catalogue.QUERIES["adversarial_recall"](spark, str(tmp_path)).collect()}
    assert {n: r.total for n, r in rows.items()} == {"clean": 280, "spaced_digits": 120, "number_words": 120, "base64_encoding": 240,
                                                     "homoglyphs": 80, "zero_width": 240, "pii_in_code": 240, "transliterated_names": 40}
    assert rows["clean"].recall == rows["transliterated_names"].recall == 1 and rows["homoglyphs"].caught == rows["zero_width"].caught == 0
    assert rows["pii_in_code"].caught == 40  # phones: an underscore is a boundary for their pattern


@pytest.mark.parametrize("name", ["detect_email_documents", "entity_counts_by_source_lang"])
def test_addresses_within_longer_runs_equal_sql(spark, tmp_path, name):
    texts = ["a@b@c.org", "see b@c.org_2 and b@c.org", "x@y.org%", "+x@y.org+", "x@y.org@", "(x@y.org)", "x@y.org.", "éx@y.orgé", "x@y.org", None, "4111111111111111 x@y.org"]
    rows = [(i, t, "s", "en") for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, source string, lang string").write.parquet(str(tmp_path / "documents.parquet"))
    df = catalogue.QUERIES[name](spark, str(tmp_path))
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    names = ", ".join(df.columns)
    assert sorted(map(tuple, df.collect())) == sorted(con.execute(f"select {names} from ({catalogue.ORACLES[name]})").fetchall())


@pytest.mark.parametrize("name", ["ff1_roundtrip_phone", "ff1_roundtrip_pan", "detect_all_injected", "detect_carriers"])
def test_rows_of_one_file_are_work_for_all_cores(spark, name):
    assert catalogue.table(spark, SF, "customer").rdd.getNumPartitions() == 1
    assert catalogue.QUERIES[name](spark, SF).rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism
