"""All queries over the transform columns, with the SQL that checks them.

A round trip is held against the source's own digest and length, and every
cipher, digest and number besides against published test vectors.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from bytemill.functions import buffers, ciphers, compression, digests, public_key, randoms
from bytemill.operators import chunks
from bytemill.plans import vectors
from bytemill.plans.capabilities import ROWS, capabilities
from bytemill.sources.tables import table

FLAGSHIP = "digest_sha256"
KEY, IV, NONCE = bytes(range(16)), bytes(range(16, 32)), bytes(range(12))
MAC_KEY = b"0123456789abcdef0123456789abcdef"

Query = Callable[[SparkSession, str], DataFrame]


def _texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.col("text").cast("binary").alias("data"))


def _spread(df: DataFrame) -> DataFrame:
    """For small files with milliseconds of work a row: parts for all cores. Adaptive execution joins small parts again unless their number is given."""
    return df.repartition(4 * df.sparkSession.sparkContext.defaultParallelism)


def _hex(c: Column) -> Column:
    return F.lower(F.hex(c))


def _digest(name: str) -> Query:
    return lambda spark, d: _texts(spark, d).select("doc_id", _hex(digests.digest(name, F.col("data"))).alias("digest"))


def _hmac(name: str) -> Query:
    return lambda spark, d: _texts(spark, d).select("doc_id", _hex(digests.hmac(name, MAC_KEY, F.col("data"))).alias("mac"))


def _hmac_sql(name: str, block: int = 64) -> str:
    padded = MAC_KEY.ljust(block, b"\0")
    inner, outer = (bytes(b ^ x for b in padded).hex().upper() for x in (0x36, 0x5C))
    return f"SELECT doc_id, {name}(unhex('{outer}') || unhex({name}(unhex('{inner}') || encode(text)))) AS mac FROM documents"


def _restored(of: Callable[[Column], Column]) -> Query:
    """The digest and length of what a round trip gives back."""

    def run(spark: SparkSession, d: str) -> DataFrame:
        back = _texts(spark, d).select("doc_id", of(F.col("data")).alias("back"))
        return back.select("doc_id", F.md5("back").alias("digest"), F.octet_length("back").cast("long").alias("n_bytes"))

    return run


RESTORED_SQL = "SELECT doc_id, md5(text) AS digest, CAST(strlen(text) AS BIGINT) AS n_bytes FROM documents"


def _packed(format: str, level: int = 6) -> Query:
    return _restored(lambda c: compression.decompress(compression.compress(c, format, level), format))


def _cfb(spark: SparkSession, d: str) -> DataFrame:
    """The ciphertext is made a column of its own: inside the decryption it would be worked out once for each use."""
    sealed = _texts(spark, d).select("doc_id", ciphers.cfb_encrypt(KEY, IV, F.col("data")).alias("sealed"))
    back = sealed.select("doc_id", ciphers.cfb_decrypt(KEY, IV, F.col("sealed")).alias("back"))
    return back.select("doc_id", F.md5("back").alias("digest"), F.octet_length("back").cast("long").alias("n_bytes"))


def _padded(c: Column) -> Column:
    """Whole blocks: PKCS padding, in built-in functions."""
    pad = ciphers.BLOCK - F.octet_length(c) % ciphers.BLOCK
    return F.concat(c, F.unhex(F.repeat(F.lpad(F.hex(pad.cast("long")), 2, "0"), pad.cast("int"))))


def _unpadded(c: Column) -> Column:
    pad = F.conv(F.hex(F.substring(c, -1, 1)), 16, 10).cast("int")
    return F.substring(c, F.lit(1), F.octet_length(c) - pad)


def _stream_digest(spark: SparkSession, d: str) -> DataFrame:
    found = chunks.digest_stream(table(spark, d, "conversations"), "sha256", "conv_id", "turn", "text")
    return found.select("conv_id", "n_chunks", _hex(F.col("digest")).alias("digest"))


def _stream_compress(bits: int) -> Query:
    def run(spark: SparkSession, d: str) -> DataFrame:
        packed = chunks.compress_stream(table(spark, d, "conversations"), "conv_id", "turn", "text", bits)
        back = chunks.decompress_stream(packed, "conv_id", bits)
        digests_ = chunks.digest_stream(back, "sha256", "conv_id", "piece", "data").select("conv_id", _hex(F.col("digest")).alias("digest"))
        sizes = back.groupBy("conv_id").agg(F.sum(F.octet_length("data")).cast("long").alias("n_bytes"))
        return digests_.join(sizes, "conv_id")

    return run


def _lz77(spark: SparkSession, d: str) -> DataFrame:
    back = chunks.lz77_restore(chunks.lz77(_texts(spark, d), "doc_id", "data"), "doc_id")
    return back.select("doc_id", F.md5("data").alias("digest"), F.octet_length("data").cast("long").alias("n_bytes"))


def _lz77_sums(spark: SparkSession, d: str) -> DataFrame:
    parts = chunks.lz77(_texts(spark, d), "doc_id", "data")
    return parts.groupBy("doc_id").agg(F.sum(F.octet_length("literals") + F.col("match_length")).cast("long").alias("n_bytes"))


def _ratio(spark: SparkSession, d: str) -> DataFrame:
    """Bytes in and whether gzip makes each source smaller, by source."""
    packed = table(spark, d, "documents").select("source", F.octet_length("text").alias("n"), F.octet_length(compression.compress(F.col("text"), "gzip")).alias("p"))
    return packed.groupBy("source").agg(F.sum("n").cast("long").alias("n_bytes"), (F.sum("p") < F.sum("n")).alias("smaller"))


def _detail(spark: SparkSession, d: str) -> DataFrame:
    """Whole, cut and spoilt zlib members: status and bytes."""
    packed = _texts(spark, d).select("doc_id", F.octet_length("data").cast("long").alias("n"), compression.compress(F.col("data")).alias("p"))
    kinds = packed.select(
        "doc_id",
        F.explode(
            F.array(
                F.struct(F.lit("whole").alias("kind"), F.col("p").alias("p")),
                F.struct(F.lit("cut").alias("kind"), F.substring("p", F.lit(1), F.octet_length("p") - 5).alias("p")),
                F.struct(F.lit("spoilt").alias("kind"), F.concat(F.lit(b"\xff\xff"), "p").alias("p")),
            )
        ).alias("k"),
    )
    seen = kinds.select("doc_id", "k.kind", compression.decompress_detail(F.col("k.p"), "zlib").alias("r"))
    return seen.select("doc_id", "kind", F.col("r.status").alias("status"), F.when(F.col("kind") == "whole", F.col("r.produced")).alias("produced"))


DETAIL_SQL = """
SELECT doc_id, kind, CAST(status AS INTEGER) AS status, CASE WHEN kind = 'whole' THEN CAST(strlen(text) AS BIGINT) END AS produced
FROM documents, (VALUES ('whole', 0), ('cut', 2), ('spoilt', 5)) k(kind, status)
"""


def _tampered(spark: SparkSession, d: str) -> DataFrame:
    """Authenticated texts, whole and with one byte changed, under four schemes."""
    c = F.col("data")
    forms = {
        "aes_gcm": (ciphers.gcm_encrypt(KEY, NONCE, c, b"aad"), lambda x: ciphers.try_gcm_decrypt(KEY, NONCE, x, b"aad")),
        "aes_ccm": (ciphers.ccm_encrypt(KEY, NONCE, c, b"aad"), lambda x: ciphers.try_ccm_decrypt(KEY, NONCE, x, b"aad")),
        "hmac_sha256_cbc": (ciphers.hmac_cbc_encrypt(KEY, MAC_KEY, IV, _padded(c)), lambda x: _unpadded(ciphers.try_hmac_cbc_decrypt(KEY, MAC_KEY, IV, x))),
        "cbc_hmac_sha256": (ciphers.cbc_hmac_encrypt(KEY, MAC_KEY, IV, _padded(c)), lambda x: _unpadded(ciphers.try_cbc_hmac_decrypt(KEY, MAC_KEY, IV, x))),
    }
    out = None
    for name, (sealed, opened) in forms.items():
        kept = _texts(spark, d).select("doc_id", sealed.alias("s"))
        first = F.conv(F.hex(F.substring("s", 1, 1)), 16, 10).cast("long").bitwiseXOR(F.lit(1))
        bad = F.concat(F.unhex(F.lpad(F.hex(first), 2, "0")), F.substring("s", 2, 2**31 - 1))
        rows = kept.select("doc_id", F.lit(name).alias("scheme"), F.md5(opened(F.col("s"))).alias("digest"), opened(bad).isNull().alias("refused"))
        out = rows if out is None else out.union(rows)
    return out


TAMPERED_SQL = """
SELECT doc_id, scheme, md5(text) AS digest, true AS refused
FROM documents, (VALUES ('aes_gcm'), ('aes_ccm'), ('hmac_sha256_cbc'), ('cbc_hmac_sha256')) s(scheme)
"""


def _known(spark: SparkSession, d: str) -> DataFrame:
    """Every published test vector: what the functions make of it."""
    return vectors.results(spark)


def _signatures(spark: SparkSession, d: str) -> DataFrame:
    """Part names signed by both private forms, and verified."""
    key = {k: F.lit(v) for k, v in vectors.rsa_key().items()}
    parts = _spread(table(spark, d, "part").select("p_partkey", F.col("p_name").cast("binary").alias("data")))
    block = public_key.pkcs1_block("sha256", 1024, F.col("data"))
    made = parts.select(
        "p_partkey",
        "data",
        public_key.mod_pow(block, key["d"], key["n"]).alias("plain"),
        public_key.rsa_crt(block, key["p"], key["q"], key["dp"], key["dq"], key["qinv"]).alias("crt"),
    )
    return made.select(
        "p_partkey",
        (F.col("plain") == F.col("crt")).alias("same"),
        F.octet_length("crt").cast("long").alias("n_bytes"),
        public_key.rsa_verify("sha256", 1024, F.col("data"), F.col("crt"), key["e"], key["n"]).alias("valid"),
        public_key.rsa_verify("sha256", 1024, F.concat("data", F.lit(b"!")), F.col("crt"), key["e"], key["n"]).alias("forged"),
    )


def _agreement(spark: SparkSession, d: str) -> DataFrame:
    """Each customer agrees on a secret with the nation's office, both ways."""
    p, g = F.lit(vectors.GROUP_1536), F.lit(b"\x02")
    secret = randoms.seeded_bytes(1, F.col("c_custkey"), 32)
    office = randoms.seeded_bytes(2, F.col("c_nationkey"), 32)
    sides = _spread(table(spark, d, "customer")).select("c_custkey", secret.alias("a"), office.alias("b"))
    public = sides.select("c_custkey", "a", "b", public_key.dh_public(1536, g, F.col("a"), p).alias("ga"), public_key.dh_public(1536, g, F.col("b"), p).alias("gb"))
    shared = public.select("c_custkey", public_key.dh_shared(1536, F.col("gb"), F.col("a"), p).alias("s"), public_key.dh_shared(1536, F.col("ga"), F.col("b"), p).alias("t"))
    return shared.select("c_custkey", (F.col("s") == F.col("t")).alias("same"), F.octet_length("s").cast("long").alias("n_bytes"))


def _curve_agreement(spark: SparkSession, d: str) -> DataFrame:
    base = F.lit((9).to_bytes(32, "little"))
    sides = _spread(table(spark, d, "supplier")).select("s_suppkey", randoms.seeded_bytes(3, F.col("s_suppkey"), 32).alias("a"), randoms.seeded_bytes(4, F.col("s_suppkey"), 32).alias("b"))
    public = sides.select("s_suppkey", "a", "b", public_key.x25519(F.col("a"), base).alias("ga"), public_key.x25519(F.col("b"), base).alias("gb"))
    return public.select("s_suppkey", (public_key.x25519(F.col("a"), F.col("gb")) == public_key.x25519(F.col("b"), F.col("ga"))).alias("same"))


def _scattered(spark: SparkSession, d: str) -> DataFrame:
    """Texts in chunks of 100 bytes: sizes, a cut across chunk bounds, and the whole again."""
    cut = _texts(spark, d).select("doc_id", buffers.scatter(F.col("data"), 100).alias("c"))
    both = buffers.merge(F.col("c"), F.col("c"))
    return cut.select(
        "doc_id",
        F.size("c").cast("long").alias("n_chunks"),
        buffers.total_bytes(F.col("c")).alias("n_bytes"),
        _hex(buffers.cut(F.col("c"), 90, 20)).alias("part"),
        F.md5(buffers.gather(F.col("c"))).alias("digest"),
        buffers.total_bytes(both).alias("twice"),
        buffers.holds(F.col("c"), F.lit(1000)).alias("holds_1000"),
    )


SCATTERED_SQL = """
SELECT doc_id, CAST(ceil(strlen(text) / 100.0) AS BIGINT) AS n_chunks, CAST(strlen(text) AS BIGINT) AS n_bytes,
  lower(substr(hex(encode(text)), 181, 40)) AS part, md5(text) AS digest, CAST(2 * strlen(text) AS BIGINT) AS twice, strlen(text) >= 1000 AS holds_1000
FROM documents
"""


def _copies(spark: SparkSession, d: str) -> DataFrame:
    """Texts that occur more than once, by digest."""
    named = table(spark, d, "documents").select(F.sha2("text", 256).alias("digest"), "doc_id")
    return named.groupBy("digest").agg(F.count("*").alias("copies"), F.min("doc_id").alias("first")).where("copies > 1")


def _fingerprints(spark: SparkSession, d: str) -> DataFrame:
    """A digest of each order's row."""
    cents, day = F.round(F.col("o_totalprice") * 100).cast("long").cast("string"), F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss")
    row = F.concat_ws("|", F.col("o_orderkey").cast("string"), F.col("o_custkey").cast("string"), "o_orderstatus", cents, day, "o_orderpriority")
    return table(spark, d, "orders").select("o_orderkey", F.sha2(row, 256).alias("fingerprint"))


def _seeded(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").select("p_partkey", _hex(randoms.seeded_bytes(7, F.col("p_partkey"), 24)).alias("bytes"))


def _fresh(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").select("p_partkey", F.octet_length(randoms.fresh_bytes(F.col("p_partkey"), 24)).cast("long").alias("n_bytes"))


def _truncated(spark: SparkSession, d: str) -> DataFrame:
    return _texts(spark, d).select("doc_id", _hex(digests.hmac("sha256", MAC_KEY, F.col("data"), 16)).alias("mac"))


def _library(name: str) -> Query:
    """A digest without SQL form: each document with the first one of equal digest. ``known_answers`` and the tests hold its values."""

    def run(spark: SparkSession, d: str) -> DataFrame:
        found = _texts(spark, d).select("doc_id", digests.digest(name, F.col("data")).alias("h"))
        first = found.groupBy("h").agg(F.min("doc_id").alias("first"))
        return found.join(first, "h").select("doc_id", "first", F.octet_length("h").cast("long").alias("n_bytes"))

    return run


def _library_sql(name: str) -> str:
    return f"SELECT doc_id, min(doc_id) OVER (PARTITION BY text) AS first, CAST({digests.ALGORITHMS[name][0]} AS BIGINT) AS n_bytes FROM documents"


def _capabilities(spark: SparkSession, d: str) -> DataFrame:
    return capabilities(spark)


def _all() -> dict[str, tuple[Query, str | None]]:
    found: dict[str, tuple[Query, str | None]] = {
        f"digest_{n}": (_digest(n), f"SELECT doc_id, {n}({'text' if n != 'sha1' else 'text'}) AS digest FROM documents") for n in ("md5", "sha1", "sha256")
    }
    found |= {f"hmac_{n}": (_hmac(n), _hmac_sql(n)) for n in ("md5", "sha1", "sha256")}
    found |= {f"digest_{n}": (_library(n), _library_sql(n)) for n in ("sha224", "sha384", "sha512", *digests.LIBRARY)}
    found["hmac_truncated"] = (_truncated, f"SELECT doc_id, substr(mac, 1, 32) AS mac FROM ({_hmac_sql('sha256')})")
    found |= {f"{f}_round_trip": (_packed(f), RESTORED_SQL) for f in compression.FORMATS}
    found |= {f"{f}_level_{n}": (_packed(f, n), RESTORED_SQL) for f, n in (("deflate", 1), ("gzip", 9), ("zstd", 15))}
    found["auto_detect_round_trip"] = (
        _restored(lambda c: compression.decompress(F.when(F.col("doc_id") % 2 == 0, compression.compress(c, "gzip")).otherwise(compression.compress(c, "zlib")))),
        RESTORED_SQL,
    )
    found["decompress_detail"] = (_detail, DETAIL_SQL)
    found["compression_by_source"] = (_ratio, "SELECT source, CAST(sum(strlen(text)) AS BIGINT) AS n_bytes, true AS smaller FROM documents GROUP BY source")
    found["lz77_round_trip"] = (_lz77, RESTORED_SQL)
    found["lz77_sequences"] = (_lz77_sums, "SELECT doc_id, CAST(strlen(text) AS BIGINT) AS n_bytes FROM documents")
    joined = "SELECT conv_id, count(*) AS n, string_agg(text, '' ORDER BY turn, text) AS t FROM conversations GROUP BY conv_id"
    found["stream_digest"] = (_stream_digest, f"SELECT conv_id, n AS n_chunks, sha256(t) AS digest FROM ({joined})")
    for name, bits in (("deflate", -15), ("zlib", 15), ("gzip", 31)):
        found[f"stream_{name}"] = (_stream_compress(bits), f"SELECT conv_id, sha256(t) AS digest, CAST(strlen(t) AS BIGINT) AS n_bytes FROM ({joined})")
    trips = {
        "aes_ecb": lambda c: _unpadded(ciphers.ecb_decrypt(KEY, ciphers.ecb_encrypt(KEY, _padded(c)))),
        "aes_cbc": lambda c: _unpadded(ciphers.cbc_decrypt(KEY, IV, ciphers.cbc_encrypt(KEY, IV, _padded(c)))),
        "aes_ctr": lambda c: ciphers.ctr(KEY, IV, ciphers.ctr(KEY, IV, c)),
        "aes_ofb": lambda c: ciphers.ofb(KEY, IV, ciphers.ofb(KEY, IV, c)),
        "aes_gcm": lambda c: ciphers.gcm_decrypt(KEY, NONCE, ciphers.gcm_encrypt(KEY, NONCE, c)),
        "aes_ccm": lambda c: ciphers.try_ccm_decrypt(KEY, NONCE, ciphers.ccm_encrypt(KEY, NONCE, c)),
    }
    found |= {f"{n}_round_trip": (_restored(f), RESTORED_SQL) for n, f in trips.items()}
    found["aes_cfb_round_trip"] = (_cfb, RESTORED_SQL)
    found["aead_tampered"] = (_tampered, TAMPERED_SQL)
    found["known_answers"] = (_known, vectors.sql())
    found["rsa_signatures"] = (_signatures, "SELECT p_partkey, true AS same, CAST(128 AS BIGINT) AS n_bytes, true AS valid, false AS forged FROM part")
    found["dh_agreement"] = (_agreement, "SELECT c_custkey, true AS same, CAST(192 AS BIGINT) AS n_bytes FROM customer")
    found["x25519_agreement"] = (_curve_agreement, "SELECT s_suppkey, true AS same FROM supplier")
    found["scatter_gather"] = (_scattered, SCATTERED_SQL)
    found["exact_copies"] = (_copies, "SELECT sha256(text) AS digest, count(*) AS copies, min(doc_id) AS first FROM documents GROUP BY 1 HAVING count(*) > 1")
    found["row_fingerprints"] = (
        _fingerprints,
        "SELECT o_orderkey, sha256(concat_ws('|', CAST(o_orderkey AS VARCHAR), CAST(o_custkey AS VARCHAR), o_orderstatus, CAST(CAST(round(o_totalprice * 100) AS BIGINT) AS VARCHAR), strftime(o_orderdate, '%Y-%m-%d %H:%M:%S'), o_orderpriority)) AS fingerprint FROM orders",
    )
    found["random_seeded"] = (_seeded, "SELECT p_partkey, substr(sha256('7:' || p_partkey || ':0'), 1, 48) AS bytes FROM part")
    found["random_fresh"] = (_fresh, "SELECT p_partkey, CAST(24 AS BIGINT) AS n_bytes FROM part")
    listed = ", ".join(f"('{kind}', '{name}', '{form}')" for kind, name, form in ROWS)
    found["capabilities"] = (_capabilities, f"SELECT * FROM (VALUES {listed}) c(kind, name, form)")
    return found


def queries() -> dict[str, Query]:
    return {name: query for name, (query, _) in _all().items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in _all().items() if sql is not None}
