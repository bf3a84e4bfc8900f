"""What the library offers, as a table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from bytemill.functions import compression, digests, public_key


#: (kind, name, form): form is native (Spark's own functions) or arrow (Arrow-batched Python).
ROWS = [
    *(("digest", n, "native") for n in digests.NATIVE),
    *(("digest", n, "arrow") for n in digests.LIBRARY),
    *(("hmac", n, "native") for n in digests.NATIVE),
    *(("hmac", n, "arrow") for n in digests.LIBRARY),
    *(("compression", n, "arrow") for n in compression.FORMATS),
    ("compression", "lz77", "arrow"),
    *(("cipher", f"aes_{m}", "native") for m in ("ecb", "cbc", "cfb_encrypt")),
    *(("cipher", f"aes_{m}", "native, xor by arrow") for m in ("ctr", "ofb", "cfb_decrypt")),
    ("mac", "aes_cmac", "native"),
    ("aead", "aes_gcm", "native"),
    ("aead", "aes_ccm", "native, xor by arrow"),
    *(("aead", f"aes_cbc_hmac_{n}", "native") for n in ("sha1", "sha256", "sha512")),
    *(("aead", f"hmac_{n}_aes_cbc", "native") for n in ("sha1", "sha256", "sha512")),
    *(("rsa", str(b), "arrow") for b in public_key.RSA_BITS),
    *(("dh", str(b), "arrow") for b in public_key.DH_BITS),
    ("curve", "x25519", "arrow"),
    ("checksum", "crc32", "native"),
    ("checksum", "adler32", "arrow"),
    ("random", "seeded", "native"),
    ("random", "fresh", "arrow"),
]


def capabilities(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(ROWS, "kind string, name string, form string")
