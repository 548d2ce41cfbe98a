from pyspark.sql import functions as F

from logweave.functions import scalars as S


def one(spark, column, **values):
    return spark.createDataFrame([tuple(values.values())], list(values)).select(column).first()[0]


def test_fnv_vectors(spark):
    rows = spark.createDataFrame([("",), ("a",), ("foobar",), ("é☃",), (None,)], "s string")
    got = rows.select(S.unsigned_hex(S.fnv1a(F.col("s"))).alias("h"), S.fnv1a(F.col("s")).alias("a"), S.fnv1a_vector(F.col("s")).alias("b")).collect()
    assert [r.h for r in got[:3]] == ["cbf29ce484222325", "af63dc4c8601ec8c", "85944171f73967e8"]
    assert all(r.a == r.b for r in got[:4]) and got[4].a is None


def test_fnv_vector_of_mixed_lengths(spark):
    values = [bytes(range(n % 256)) * (n % 3 + 1) for n in range(60)]
    rows = spark.createDataFrame([(bytearray(v),) for v in values], "b binary").select(F.col("b"), S.fnv1a_vector(F.col("b")).alias("h")).collect()
    for r in rows:
        h = S.FNV_BASIS
        for x in bytes(r.b):
            h = (h ^ x) * S.FNV_PRIME % (1 << 64)
        assert r.h % (1 << 64) == h


def test_namespaces_and_keys(spark):
    keys = spark.createDataFrame([("prod/payments::v1",), ("a-b_c.D9",), ("::",), ("é",)], "k string").select(S.sanitize_namespace(F.col("k"))).collect()
    assert [r[0] for r in keys][:2] == ["prod_payments__v1", "a-b_c.D9"]
    assert all(r[0].startswith("ns_") and len(r[0]) == 19 for r in keys[2:])
    topic, segment = S.parse_wal_key(F.col("k"))
    rows = spark.createDataFrame([("t_a_s_b_s_12",), ("t_x_s_+3",), ("x_s_1",), ("t_a_s_",)], "k string").select(topic, segment).collect()
    assert [tuple(r) for r in rows] == [("a_s_b", 12), ("x", 3), (None, None), (None, None)]


def test_frames_and_lines(spark):
    rows = spark.createDataFrame([("PUT logs  a b ",), ("é",), ("",)], "s string").withColumn("f", S.frame(F.col("s")))
    got = rows.select("f", S.frame_length(F.col("f")).alias("n"), S.frame_ok(F.col("f")).alias("ok"), S.split_command(F.col("s")).alias("p")).collect()
    assert bytes(got[0].f)[:4] == (14).to_bytes(4, "little") and [r.n for r in got] == [14, 2, 0] and [r.ok for r in got] == [True, True, False]
    assert got[0].p == ["PUT", "logs", " a b"]
    parsed = spark.createDataFrame([("OK",), ("OK x y",), ("EMPTY",), ("ERR no",), ("?",)], "s string").select(S.parse_response(F.col("s")).alias("r")).collect()
    assert [tuple(r.r) for r in parsed] == [("ok", None), ("ok", "x y"), ("empty", None), ("err", "no"), ("unknown", None)]


def test_small_parsers(spark):
    assert one(spark, S.short_number(F.col("v")), v=1234567) == "1.2M" and one(spark, S.bandwidth(F.col("v")), v=1.04e9) == "1.0GB/s"
    assert one(spark, S.peer_id(F.col("v")), v=5003) == 3 and one(spark, S.peer_id(F.col("v")), v=5000) is None
    assert one(spark, S.kv_tokens(F.col("v")), v="  SET  a\tb ") == ["SET", "a", "b"]
    assert one(spark, S.lossy_text(F.col("v")), v=bytearray(b"a\xffb")) == "a�b"
    ids = one(spark, S.payload_ids(F.col("v")), v=bytearray([7, 0, 0, 0, 0, 0, 0, 1, 2, 9]))
    assert ids.topic_index == 7 and int(ids.chunk_index) == 258


def test_histogram_buckets(spark):
    values = list(range(0, 300)) + [1 << 20, (1 << 40) + 5]
    rows = spark.createDataFrame([(v,) for v in values], "v bigint").select("v", S.histogram_bucket(F.col("v")).alias("b")).withColumn("low", S.bucket_minimum(F.col("b"))).collect()
    for r in rows:
        if r.v < 8:
            assert r.low == r.v
        assert r.low <= r.v < r.low * 1.25 + 1
    assert [r.b for r in rows[:300]] == sorted(r.b for r in rows[:300])
