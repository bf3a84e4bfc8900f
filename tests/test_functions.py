"""Checks of parameters, nulls and boundary lengths that no table holds."""

from __future__ import annotations

import hashlib
import random
import time
import zlib

import pytest
from pyspark.sql import functions as F

from bytemill.functions import buffers, ciphers, compression, digests, public_key, randoms
from bytemill.functions.errors import ParameterError
from bytemill.operators import chunks
from bytemill.sources.tables import file_chunks
from bytemill.streaming.chunk_digest import digest_chunks

LENGTHS = [0, 1, 15, 16, 17, 63, 64, 65, 127, 128, 129, 512, 4096, 131071, 131073]
KEY, IV = bytes(range(16)), bytes(range(16, 32))


@pytest.fixture(scope="module")
def blobs(spark):
    rng = random.Random(3)
    data = [(i, rng.randbytes(n)) for i, n in enumerate(LENGTHS)] + [(99, None)]
    return spark.createDataFrame(data, "id long, data binary").cache()


def by_id(df):
    return {r[0]: bytes(r[1]) if isinstance(r[1], (bytes, bytearray)) else r[1] for r in df.collect()}


@pytest.mark.parametrize(
    "wrong",
    [
        lambda c: digests.digest("md4", c),
        lambda c: digests.digest("sha256", c, 30),
        lambda c: digests.digest("sha256", c, 36),
        lambda c: digests.hmac("sha256", b"x" * 68, c),
        lambda c: digests.hmac("sha256", b"abc", c),
        lambda c: digests.hmac("sha256", b"", c),
        lambda c: compression.compress(c, "lzo"),
        lambda c: compression.compress(c, "zlib", 6, 8),
        lambda c: compression.compress(c, "zstd", 23),
        lambda c: compression.decompress(c, "lzo"),
        lambda c: ciphers.ecb_encrypt(b"short", c),
        lambda c: ciphers.cbc_encrypt(KEY, b"short", c),
        lambda c: ciphers.gcm_encrypt(KEY, IV, c),
        lambda c: ciphers.ccm_encrypt(KEY, IV, c),
        lambda c: ciphers.ccm_encrypt(KEY, IV[:12], c, tag=5),
        lambda c: ciphers.cmac(bytes(24), c),
        lambda c: ciphers.cbc_hmac_encrypt(KEY, KEY, IV, c, "md5"),
        lambda c: public_key.pkcs1_block("sha256", 512, c),
        lambda c: public_key.dh_public(512, c, c, c),
        lambda c: buffers.scatter(c, 0),
        lambda c: buffers.cut(c, -1, 5),
        lambda c: randoms.seeded_bytes(1, c, 0),
    ],
)
def test_wrong_parameters_fail_when_the_plan_is_made(spark, wrong):
    with pytest.raises(ParameterError):
        wrong(F.col("data"))


@pytest.mark.parametrize(("bits", "wanted"), [(-15, ("deflate", 15)), (-8, ("deflate", 8)), (8, ("zlib", 8)), (15, ("zlib", 15)), (31, ("gzip", 15))])
def test_window_bits_name_a_format(bits, wanted):
    assert compression.format_of(bits) == wanted


@pytest.mark.parametrize("name", sorted(digests.ALGORITHMS))
def test_digests_and_macs_at_boundaries(spark, blobs, name):
    import hmac

    found = blobs.select("id", digests.digest(name, F.col("data")).alias("d"), digests.hmac(name, KEY, F.col("data")).alias("m")).collect()
    data = by_id(blobs)
    for r in found:
        b = data[r["id"]]
        assert r["d"] == (None if b is None else hashlib.new(name, b).digest())
        assert r["m"] == (None if b is None else hmac.new(KEY, b, name).digest())


@pytest.mark.parametrize("format", sorted(compression.FORMATS))
def test_compression_round_trip_at_boundaries(spark, blobs, format):
    c = F.col("data")
    assert by_id(blobs.select("id", compression.decompress(compression.compress(c, format), format))) == by_id(blobs)


def test_bad_data_is_null_or_a_status_or_an_error(spark):
    whole = zlib.compress(b"text" * 50)
    df = spark.createDataFrame([(0, whole), (1, whole[:-3]), (2, b"\xff" + whole), (3, None), (4, whole + b"more")], "id long, data binary")
    tried = by_id(df.select("id", compression.try_decompress(F.col("data"), "zlib")))
    assert tried == {0: b"text" * 50, 1: None, 2: None, 3: None, 4: b"text" * 50}
    detail = {r["id"]: r["d"] for r in df.select("id", compression.decompress_detail(F.col("data"), "zlib").alias("d")).collect()}
    assert [detail[i]["status"] for i in (0, 1, 2, 4)] == [0, 2, 5, 0] and detail[3] is None and detail[4]["consumed"] == len(whole)
    with pytest.raises(Exception, match="status"):
        df.where("id = 1").select(compression.decompress(F.col("data"), "zlib")).collect()


@pytest.mark.parametrize("mode", ["ctr", "ofb", "gcm", "ccm"])
def test_stream_modes_round_trip_at_boundaries(spark, blobs, mode):
    c = F.col("data")
    both = {
        "ctr": lambda: ciphers.ctr(KEY, IV, ciphers.ctr(KEY, IV, c)),
        "ofb": lambda: ciphers.ofb(KEY, IV, ciphers.ofb(KEY, IV, c)),
        "gcm": lambda: ciphers.gcm_decrypt(KEY, IV[:12], ciphers.gcm_encrypt(KEY, IV[:12], c, b"a"), b"a"),
        "ccm": lambda: ciphers.try_ccm_decrypt(KEY, IV[:12], ciphers.ccm_encrypt(KEY, IV[:12], c, b"a"), b"a"),
    }[mode]()
    assert by_id(blobs.select("id", both)) == by_id(blobs)


def test_block_modes_ask_for_whole_blocks(spark, blobs):
    even = blobs.where("octet_length(data) % 16 = 0 AND octet_length(data) > 0 OR data IS NULL")
    c = F.col("data")
    assert by_id(even.select("id", ciphers.cbc_decrypt(KEY, IV, ciphers.cbc_encrypt(KEY, IV, c)))) == by_id(even)
    assert by_id(even.select("id", ciphers.ecb_decrypt(KEY, ciphers.ecb_encrypt(KEY, c)))) == by_id(even)
    with pytest.raises(Exception, match="multiple of 16"):
        blobs.where("id = 1").select(ciphers.ecb_encrypt(KEY, c)).collect()


def test_chunks_in_order_are_one_message(spark):
    rows = [(1, 2, b"c"), (1, 0, b"a"), (1, 1, None), (2, 0, b""), (3, 0, None)]
    df = spark.createDataFrame(rows, "s long, seq int, chunk binary")
    found = {r["s"]: (r["n_chunks"], bytes(r["digest"])) for r in chunks.digest_stream(df, "sha256", "s", "seq", "chunk").collect()}
    assert found == {k: (n, hashlib.sha256(t).digest()) for k, n, t in [(1, 3, b"ac"), (2, 1, b""), (3, 1, b"")]}
    assert chunks.digest_stream(df.limit(0), "sha256", "s", "seq", "chunk").count() == 0


def test_streams_are_compressed_piece_by_piece(spark):
    rng = random.Random(5)
    parts = [(k, i, rng.randbytes(rng.randrange(2000)) + b"again " * 300) for k in range(5) for i in range(20)]
    df = spark.createDataFrame([*parts, (9, 0, None), (None, 1, b"y"), (None, 0, b"x")], "s long, seq int, chunk binary").repartition(7)
    whole = {k: b"".join(c for j, _, c in parts if j == k) for k in range(5)} | {9: b"", None: b"xy"}
    for bits, sync in ((15, True), (31, False), (-15, True)):
        packed = chunks.compress_stream(df, "s", "seq", "chunk", bits, sync=sync)
        member = {k: b"".join(bytes(r["packed"]) for r in rows) for k, rows in _grouped(packed, "s", "piece").items()}
        assert {k: zlib.decompress(m, bits) for k, m in member.items()} == whole
        back = chunks.decompress_stream(packed, "s", bits)
        assert {k: b"".join(bytes(r["data"]) for r in rows) for k, rows in _grouped(back, "s", "piece").items()} == whole
    with pytest.raises(Exception, match="ends before"):
        chunks.decompress_stream(chunks.compress_stream(df, "s", "seq", "chunk").where("piece = 0"), "s").collect()


def _grouped(df, key, order):
    found = {}
    for r in sorted(df.collect(), key=lambda r: r[order]):
        found.setdefault(r[key], []).append(r)
    return found


def test_counters_go_on_over_chunks_and_carry(spark):
    data = random.Random(6).randbytes(1000)
    cut = spark.createDataFrame([(i, data[i : i + 160]) for i in range(0, 1000, 160)], "at long, data binary")
    for iv in (IV, b"\xff" * 15 + b"\xfe", b"\x00" * 8 + b"\xff" * 8):
        whole = bytes(spark.createDataFrame([(data,)], "data binary").select(ciphers.ctr(KEY, iv, F.col("data"))).first()[0])
        found = by_id(cut.select("at", ciphers.ctr(KEY, iv, F.col("data"), F.col("at") / 16)))
        assert b"".join(found[i] for i in sorted(found)) == whole
        stream = [int.from_bytes(iv, "big") + k for k in range(63)]
        plain = b"".join((x % (1 << 128)).to_bytes(16, "big") for x in stream)
        pad = bytes(spark.createDataFrame([(plain,)], "d binary").select(ciphers.ecb_encrypt(KEY, F.lit(plain))).first()[0])
        assert whole == bytes(a ^ b for a, b in zip(data, pad, strict=False))


def test_cfb_and_both_orders_of_authentication_round_trip(spark, blobs):
    c, even = F.col("data"), blobs.where("octet_length(data) % 16 = 0 AND octet_length(data) > 0 AND octet_length(data) < 5000")
    short = blobs.where("octet_length(data) < 5000 OR data IS NULL")
    assert by_id(short.select("id", ciphers.cfb_decrypt(KEY, IV, ciphers.cfb_encrypt(KEY, IV, c)))) == by_id(short)
    for seal, open_ in ((ciphers.cbc_hmac_encrypt, ciphers.try_cbc_hmac_decrypt), (ciphers.hmac_cbc_encrypt, ciphers.try_hmac_cbc_decrypt)):
        assert by_id(even.select("id", open_(KEY, KEY, IV, seal(KEY, KEY, IV, c, aad=b"a"), aad=b"a"))) == by_id(even)
        assert set(by_id(even.select("id", open_(KEY, KEY, IV, seal(KEY, KEY, IV, c, aad=b"a"), aad=b"b"))).values()) == {None}


@pytest.mark.parametrize("name", ["sha224", "sha384", "sha512", "sm3", "sha512_224", "sha512_256"])
def test_digests_without_sql_agree_with_the_library(spark, blobs, name):
    found = by_id(blobs.select("id", digests.digest(name, F.col("data"))))
    assert found == {i: None if b is None else hashlib.new(name, b).digest() for i, b in by_id(blobs).items()}


def test_lz77_restores_and_finds_repeats(spark, blobs):
    extra = spark.createDataFrame([(100, b"abcd" * 1000)], "id long, data binary")
    both = blobs.where("data IS NOT NULL AND octet_length(data) < 5000").union(extra)
    parts = chunks.lz77(both, "id", "data").cache()
    assert by_id(chunks.lz77_restore(parts, "id")) == by_id(both)
    assert parts.where("id = 100").count() == 2


def test_buffers_cross_chunk_bounds(spark):
    df = spark.createDataFrame([(1, [b"abc", None, b"", b"defg"]), (2, None), (3, [])], "id long, c array<binary>")
    found = {r["id"]: r for r in df.select("id", buffers.gather(F.col("c")).alias("g"), buffers.cut(F.col("c"), 2, 3).alias("p"), buffers.total_bytes(F.col("c")).alias("n")).collect()}
    assert (bytes(found[1]["g"]), bytes(found[1]["p"]), found[1]["n"]) == (b"abcdefg", b"cde", 7)
    assert found[2]["g"] is None and bytes(found[3]["g"]) == b""


def test_rsa_keys_agree_with_their_primes(spark):
    from bytemill.plans.vectors import rsa_key

    key = rsa_key()
    made = spark.range(1).select(public_key.rsa_keys(F.lit(key["e"]), F.lit(key["p"]), F.lit(key["q"])).alias("k")).first()["k"]
    assert all(bytes(made[f]) == key[f] for f in ("n", "d", "dp", "dq", "qinv"))


def test_files_as_chunks_through_a_stream(spark, tmp_path):
    content = random.Random(4).randbytes(1000)
    (tmp_path / "in").mkdir()
    (tmp_path / "in/one.bin").write_bytes(content)
    cut = file_chunks(spark, str(tmp_path / "in"), 300)
    assert cut.count() == 4
    cut.write.parquet(str(tmp_path / "chunks"))
    read = spark.readStream.schema("stream string, seq int, chunk binary, last boolean").parquet(str(tmp_path / "chunks"))
    query = digest_chunks(read).writeStream.format("memory").queryName("digests").outputMode("append").option("checkpointLocation", str(tmp_path / "state")).start()
    query.processAllAvailable()
    query.stop()
    found = spark.table("digests").collect()
    assert [(r["n_chunks"], bytes(r["digest"])) for r in found] == [(4, hashlib.sha256(content).digest())]


def test_a_stream_with_nulls_and_one_that_stays_open(spark, tmp_path):
    rows = [("a", 0, b"x", False), ("a", 1, None, True), ("a", None, b"z", False), (None, 0, b"n", True), ("b", 1, b"y", True), ("c", 0, b"c", None), ("c", 1, b"d", True)]
    schema = "stream string, seq int, chunk binary, last boolean"
    spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / "chunks"))
    read = spark.readStream.schema(schema).parquet(str(tmp_path / "chunks"))
    query = digest_chunks(read, patience_ms=1).writeStream.format("memory").queryName("open").outputMode("append").option("checkpointLocation", str(tmp_path / "state")).start()
    deadline = time.monotonic() + 90
    while spark.table("open").count() < 3 and time.monotonic() < deadline:  # batches go on while there is something to wait for
        time.sleep(0.5)
    query.stop()
    found = {r["stream"]: (r["n_chunks"], r["digest"] and bytes(r["digest"])) for r in spark.table("open").collect()}
    assert found == {"a": (2, hashlib.sha256(b"x").digest()), "c": (2, hashlib.sha256(b"cd").digest()), "b": (1, None)}


@pytest.mark.parametrize("fast", [True, False])
def test_powers_agree_with_python_for_any_modulus(monkeypatch, fast):
    rng = random.Random(8)
    if not fast:
        monkeypatch.setattr(public_key, "_openssl", lambda: None)
    for bits in (1, 8, 9, 512, 1000, 1536):
        for odd in (0, 1):
            m = rng.getrandbits(bits) | 1 << (bits - 1) | odd
            for base, exponent in ((0, 0), (0, 5), (2, rng.getrandbits(256)), (rng.getrandbits(2 * bits), rng.getrandbits(bits))):
                b, e, n = (x.to_bytes((x.bit_length() + 7) // 8 + 1, "big") for x in (base, exponent, m))
                assert public_key._power(b, e, n) == pow(base, exponent, m).to_bytes((m.bit_length() + 7) // 8, "big")


def test_cfb_encrypts_each_block_after_the_one_before_without_a_fold(spark, blobs):
    c, lengths = F.col("data"), blobs.where("octet_length(data) < 5000 OR data IS NULL")
    one = spark.createDataFrame([(100, random.Random(10).randbytes(40))], "id long, data binary")
    for key in (KEY, bytes(24), bytes(range(32))):
        sealed = one.union(lengths).select("id", "data", ciphers.cfb_encrypt(key, IV, c).alias("sealed")).cache()
        found = {r["id"]: r for r in sealed.collect()}
        assert found[99]["sealed"] is None and all(r["data"] is None or len(r["sealed"]) == len(r["data"]) for r in found.values())
        before = [(i, at, (IV + bytes(r["sealed"]))[at : at + 16]) for i, r in found.items() if r["data"] for at in range(0, len(r["data"]), 16)]
        stream = spark.createDataFrame(before, "id long, at int, data binary").select("id", "at", ciphers.ecb_encrypt(key, c).alias("pad"))
        for r in stream.collect():
            plain, made = (bytes(found[r["id"]][f])[r["at"] :][:16] for f in ("data", "sealed"))
            assert made == bytes(a ^ b for a, b in zip(plain, bytes(r["pad"]), strict=False))
        sealed.unpersist()
    # a fold or a lambda would copy or interpret block by block
    plan = lengths.select(ciphers.cfb_encrypt(KEY, IV, c))._jdf.queryExecution().optimizedPlan().toString()
    assert "aggregate(" not in plan and "lambda" not in plan and "PythonUDF" not in plan


def test_a_long_text_takes_cfb_time_in_proportion(spark):
    def seconds(n):
        one = spark.range(1).select(F.unhex(F.repeat(F.lit("a7"), n * (F.col("id") + 1).cast("int"))).alias("data"))
        began = time.monotonic()
        assert one.select(F.octet_length(ciphers.cfb_encrypt(KEY, IV, F.col("data")))).first()[0] == n
        return time.monotonic() - began

    seconds(1 << 10)
    assert seconds(1 << 20) < 10


def test_costly_rows_of_a_small_file_are_spread_over_all_cores(spark):
    from bytemill.plans import registry
    from conftest import DATA

    for name in ("dh_agreement", "rsa_signatures", "x25519_agreement"):
        found = registry.queries()[name](spark, f"{DATA}/sf0.01")
        assert found.select(F.spark_partition_id()).distinct().count() >= spark.sparkContext.defaultParallelism


def test_lz77_restores_in_batches_of_one_row_and_without_lists_of_a_value(spark, blobs):
    extra = spark.createDataFrame([(None, b"xyxyxyxyxyz" * 99), (100, b"a" * 5000), (101, b"")], "id long, data binary")
    both = blobs.where("data IS NOT NULL AND octet_length(data) < 5000").union(extra)
    back = chunks.lz77_restore(chunks.lz77(both, "id", "data").repartition(5), "id")
    assert "collect_list" not in back._jdf.queryExecution().toString()
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1")
    try:
        assert by_id(back) == by_id(both)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_counters_need_no_python_and_a_round_trip_has_two_python_steps(spark, blobs):
    c = F.col("data")
    once = blobs.select(ciphers.ctr(KEY, IV, c))
    assert once._jdf.queryExecution().executedPlan().toString().count("ArrowEvalPython") == 1
    for of in (lambda x: ciphers.try_ccm_decrypt(KEY, IV[:12], ciphers.ccm_encrypt(KEY, IV[:12], x)), lambda x: ciphers.ctr(KEY, IV, ciphers.ctr(KEY, IV, x))):
        plan = blobs.select(F.md5(of(c)))._jdf.queryExecution().executedPlan().toString()
        assert plan.count("ArrowEvalPython") == 2


def test_xor_of_batches_holds_no_object_a_row():
    import tracemalloc

    import pyarrow as pa

    rng = random.Random(9)
    a = [None, b"", *(rng.randbytes(rng.randrange(4000)) for _ in range(2000)), rng.randbytes(1 << 21), None, b"x"]
    b = [b"y", b"", *(rng.randbytes(len(v) + k % 3) if v is not None else None for k, v in enumerate(a[2:]))]
    a[7] = None
    left, right = pa.array(a, pa.binary()), pa.array(b, pa.binary())
    wanted = [None if x is None or y is None else bytes(p ^ q for p, q in zip(x, y, strict=False)) for x, y in zip(a, b, strict=True)]
    tracemalloc.start()
    found = ciphers.xor_bytes.func(left, right)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    found.validate(full=True)
    assert found.to_pylist() == wanted and ciphers.xor_bytes.func(left.slice(5, 40), right.slice(5, 40)).to_pylist() == wanted[5:45]
    assert peak < left.nbytes + 64 * ciphers.BYTES_AT_ONCE
    with pytest.raises(ValueError, match="shorter"):
        ciphers.xor_bytes.func(pa.array([b"ab"], pa.binary()), pa.array([b"a"], pa.binary()))
