"""Published test vectors, and what the functions make of them."""

from __future__ import annotations

from collections.abc import Callable
from functools import lru_cache

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from bytemill.functions import ciphers, digests, public_key

#: Fixed values. RFC 3526, group 5 (1536 bits).
GROUP_1536 = bytes.fromhex(
    "ffffffffffffffffc90fdaa22168c234c4c6628b80dc1cd129024e088a67cc74020bbea63b139b22514a08798e3404dd"
    "ef9519b3cd3a431b302b0a6df25f14374fe1356d6d51c245e485b576625e7ec6f44c42e9a637ed6b0bff5cb6f406b7ed"
    "ee386bfb5a899fa5ae9f24117c4b1fe649286651ece45b3dc2007cb8a163bf0598da48361c55d39a69163fa8fd24cf5f"
    "83655d23dca3ad961c62f356208552bb9ed529077096966d670c354e4abc9804f1746c08ca237327ffffffffffffffff"
)
#: Fixed values. SP 800-38A: the AES-128 key, IV, counter and plaintext of its examples.
AES_KEY = bytes.fromhex("2b7e151628aed2a6abf7158809cf4f3c")
AES_IV = bytes(range(16))
AES_COUNTER = bytes.fromhex("f0f1f2f3f4f5f6f7f8f9fafbfcfdfeff")
AES_PLAIN = bytes.fromhex("6bc1bee22e409f96e93d7e117393172aae2d8a571e03ac9c9eb76fac45af8e51")


@lru_cache(maxsize=1)
def rsa_key() -> dict[str, bytes]:
    """A 1024-bit test key from the first primes above two round numbers."""

    def prime_above(n: int) -> int:
        n |= 1
        while any(n % k == 0 for k in (3, 5, 7, 11, 13, 17, 19, 23)) or pow(2, n - 1, n) != 1 or pow(3, n - 1, n) != 1 or (n - 1) % 65537 == 0:
            n += 2
        return n

    p, q, e = prime_above(15 << 508), prime_above(14 << 508), 65537
    d = pow(e, -1, (p - 1) * (q - 1))
    numbers = {"n": p * q, "e": e, "d": d, "p": p, "q": q, "dp": d % (p - 1), "dq": d % (q - 1), "qinv": pow(q, -1, p)}
    return {k: v.to_bytes((v.bit_length() + 7) // 8, "big") for k, v in numbers.items()}


def _abc() -> Column:
    return F.lit(b"abc")


def _cases() -> list[tuple[str, Callable[[], Column], str]]:
    """(name, value to be made in a session, expected hex). Expected values: FIPS 180-4, GB/T 32905, RFC 2202, RFC 4231, SP 800-38A to 38D, RFC 4493, RFC 7748."""
    plain = AES_PLAIN
    jefe, what = b"Jefe", b"what do ya want for nothing?"
    x_secret = bytes.fromhex("a546e36bf0527c9d3b16154b82465edd62144c0ac1fc5a18506a2244ba449ac4")
    x_point = bytes.fromhex("e6db6867583030db3594c1a424b15f7c726624ec26b3353b10a903a6d0ab1c4c")
    return [
        ("md5", lambda: digests.digest("md5", _abc()), "900150983cd24fb0d6963f7d28e17f72"),
        ("sha1", lambda: digests.digest("sha1", _abc()), "a9993e364706816aba3e25717850c26c9cd0d89d"),
        ("sha224", lambda: digests.digest("sha224", _abc()), "23097d223405d8228642a477bda255b32aadbce4bda0b3f7e36c9da7"),
        ("sha256", lambda: digests.digest("sha256", _abc()), "ba7816bf8f01cfea414140de5dae2223b00361a396177a9cb410ff61f20015ad"),
        ("sha384", lambda: digests.digest("sha384", _abc()), "cb00753f45a35e8bb5a03d699ac65007272c32ab0eded1631a8b605a43ff5bed8086072ba1e7cc2358baeca134c825a7"),
        ("sha512", lambda: digests.digest("sha512", _abc()), "ddaf35a193617abacc417349ae20413112e6fa4e89a97ea20a9eeee64b55d39a2192992a274fc1a836ba3c23a3feebbd454d4423643ce80e2a9ac94fa54ca49f"),
        ("sha512_224", lambda: digests.digest("sha512_224", _abc()), "4634270f707b6a54daae7530460842e20e37ed265ceee9a43e8924aa"),
        ("sha512_256", lambda: digests.digest("sha512_256", _abc()), "53048e2681941ef99b2e29b76b4c7dabe4c2d0c634fc6d46e0e2f13107e7af23"),
        ("sm3", lambda: digests.digest("sm3", _abc()), "66c7f0f462eeedd9d1f2d46bdc10e4e24167c4875cf2f7a2297da02b8f4ba8e0"),
        ("hmac_md5", lambda: digests.hmac("md5", jefe, F.lit(what)), "750c783e6ab0b503eaa86e310a5db738"),
        ("hmac_sha1", lambda: digests.hmac("sha1", jefe, F.lit(what)), "effcdf6ae5eb2fa2d27416d5f184df9c259a7c79"),
        ("hmac_sha224", lambda: digests.hmac("sha224", jefe, F.lit(what)), "a30e01098bc6dbbf45690f3a7e9e6d0f8bbea2a39e6148008fd05e44"),
        ("hmac_sha256", lambda: digests.hmac("sha256", jefe, F.lit(what)), "5bdcc146bf60754e6a042426089575c75a003f089d2739839dec58b964ec3843"),
        ("hmac_sha384", lambda: digests.hmac("sha384", jefe, F.lit(what)), "af45d2e376484031617f78d2b58a6b1b9c7ef464f5a01b47e42ec3736322445e8e2240ca5e69e2c78b3239ecfab21649"),
        ("hmac_sha512", lambda: digests.hmac("sha512", jefe, F.lit(what)), "164b7a7bfcf819e2e395fbe73b56e0a387bd64222e831fd610270cd7ea2505549758bf75c05a994a6d034f65f8f0e6fdcaeab1a34d4a6b4b636e070a38bce737"),
        ("aes_ecb", lambda: ciphers.ecb_encrypt(AES_KEY, F.lit(plain)), "3ad77bb40d7a3660a89ecaf32466ef97f5d3d58503b9699de785895a96fdbaaf"),
        ("aes_cbc", lambda: ciphers.cbc_encrypt(AES_KEY, AES_IV, F.lit(plain)), "7649abac8119b246cee98e9b12e9197d5086cb9b507219ee95db113a917678b2"),
        ("aes_cfb", lambda: ciphers.cfb_encrypt(AES_KEY, AES_IV, F.lit(plain)), "3b3fd92eb72dad20333449f8e83cfb4ac8a64537a0b3a93fcde3cdad9f1ce58b"),
        ("aes_cfb_back", lambda: ciphers.cfb_decrypt(AES_KEY, AES_IV, F.lit(bytes.fromhex("3b3fd92eb72dad20333449f8e83cfb4ac8a64537a0b3a93fcde3cdad9f1ce58b"))), AES_PLAIN.hex()),
        ("aes_ofb", lambda: ciphers.ofb(AES_KEY, AES_IV, F.lit(plain)), "3b3fd92eb72dad20333449f8e83cfb4a7789508d16918f03f53c52dac54ed825"),
        ("aes_ctr", lambda: ciphers.ctr(AES_KEY, AES_COUNTER, F.lit(plain)), "874d6191b620e3261bef6864990db6ce9806f66b7970fdff8617187bb9fffdff"),
        ("aes_cmac_16", lambda: ciphers.cmac(AES_KEY, F.lit(AES_PLAIN[:16])), "070a16b46b4d4144f79bdd9dd04a287c"),
        ("aes_cmac_40", lambda: ciphers.cmac(AES_KEY, F.lit(bytes.fromhex("6bc1bee22e409f96e93d7e117393172aae2d8a571e03ac9c9eb76fac45af8e5130c81c46a35ce411"))), "dfa66747de9ae63030ca32611497c827"),
        (
            "aes_ccm",
            lambda: ciphers.ccm_encrypt(bytes(range(0x40, 0x50)), bytes(range(0x10, 0x17)), F.lit(bytes(range(0x20, 0x24))), bytes(range(8)), 4),
            "7162015b4dac255d",
        ),
        ("aes_gcm_empty", lambda: ciphers.gcm_encrypt(bytes(16), bytes(12), F.lit(b"")), "58e2fccefa7e3061367f1d57a4e7455a"),
        ("aes_gcm_zeros", lambda: ciphers.gcm_encrypt(bytes(16), bytes(12), F.lit(bytes(16))), "0388dace60b6a392f328c2b971b2fe78ab6e47d42cec13bdf53a67b21257bddf"),
        ("crc32", lambda: F.unhex(F.lpad(F.hex(F.crc32(F.lit(b"123456789"))), 8, "0")), "cbf43926"),
        ("adler32", lambda: F.unhex(F.lpad(F.hex(digests.adler32(F.lit(b"Wikipedia"))), 8, "0")), "11e60398"),
        ("x25519", lambda: public_key.x25519(F.lit(x_secret), F.lit(x_point)), "c3da55379de9c6908e94ea4df28d084f32eccf03491c71f754b4075577a28552"),
    ]


def results(spark: SparkSession) -> DataFrame:
    """(name, value) of every vector."""
    cases = _cases()
    wide = spark.range(1).select(*[F.lower(F.hex(value())).alias(name) for name, value, _ in cases])
    return wide.unpivot([], [name for name, *_ in cases], "name", "value")


def sql() -> str:
    rows = ", ".join(f"('{name}', '{expected}')" for name, _, expected in _cases())
    return f"SELECT name, value FROM (VALUES {rows}) v(name, value)"
