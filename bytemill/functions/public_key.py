"""Public-key operations over binary columns of big-endian numbers.

Each is one Arrow-batched call of a modular exponentiation: that of the OpenSSL
library which Python's own ``hashlib`` is linked to, or Python's, some ten times
slower, where there is none or the modulus is even. Results have the modulus's
width. Null in, null out. Not constant-time: for analytics and tests, not for
live keys.
"""

from __future__ import annotations

import ctypes
import hashlib
from collections.abc import Callable
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from bytemill.functions.errors import require

RSA_BITS = (1024, 2048, 3072, 4096)
DH_BITS = (768, 1024, 1536, 2048, 3072, 4096)
#: DER prefixes of PKCS #1 v1.5 digests.
DIGEST_PREFIX = {
    "sha1": bytes.fromhex("3021300906052b0e03021a05000414"),
    "sha256": bytes.fromhex("3031300d060960864801650304020105000420"),
    "sha384": bytes.fromhex("3041300d060960864801650304020205000430"),
    "sha512": bytes.fromhex("3051300d060960864801650304020305000440"),
}


@lru_cache(maxsize=1)
def _openssl() -> Callable[[bytes, bytes, bytes], bytes] | None:
    """base ** exponent mod an odd modulus by OpenSSL, one set of numbers a Python worker; None without the library."""
    try:
        import _hashlib

        lib = ctypes.CDLL(_hashlib.__file__)
        number, text, whole = ctypes.c_void_p, ctypes.c_char_p, ctypes.c_int
        kinds = {"BN_new": (number,), "BN_CTX_new": (number,), "BN_bin2bn": (number, text, whole, number), "BN_mod_exp": (whole, *[number] * 5), "BN_bn2binpad": (whole, number, text, whole)}
        for name, (result, *arguments) in kinds.items():
            function = getattr(lib, name)
            function.restype, function.argtypes = result, arguments
    except (ImportError, OSError, AttributeError):
        return None
    result, *given = (lib.BN_new() for _ in range(4))
    context = lib.BN_CTX_new()

    def power(*values: bytes) -> bytes:
        for place, value in zip(given, values, strict=True):
            lib.BN_bin2bn(value, len(value), place)
        size = len(values[2])
        out = ctypes.create_string_buffer(size)
        if lib.BN_mod_exp(result, *given, context) != 1 or lib.BN_bn2binpad(result, out, size) != size:
            raise ArithmeticError("OpenSSL could not raise to the power")
        return out.raw

    return power


def _power(base: bytes, exponent: bytes, modulus: bytes) -> bytes:
    """base ** exponent mod modulus, in as many bytes as the modulus has without leading zeros."""
    modulus = modulus.lstrip(b"\0")
    fast = _openssl()
    if fast and modulus and modulus[-1] & 1:
        return fast(base, exponent, modulus)
    return pow(int.from_bytes(base, "big"), int.from_bytes(exponent, "big"), int.from_bytes(modulus, "big")).to_bytes(len(modulus), "big")


@F.pandas_udf(T.BinaryType())
def mod_pow(base: pd.Series, exponent: pd.Series, modulus: pd.Series) -> pd.Series:
    """base ** exponent mod modulus."""

    def one(b: bytes, e: bytes, m: bytes) -> bytes | None:
        return None if b is None or e is None or m is None else _power(b, e, m)

    return pd.Series([one(*x) for x in zip(base, exponent, modulus, strict=True)], dtype=object)


@F.pandas_udf(T.BinaryType())
def rsa_crt(message: pd.Series, p: pd.Series, q: pd.Series, dp: pd.Series, dq: pd.Series, qinv: pd.Series) -> pd.Series:
    """The RSA private operation from the primes, by Chinese remainders."""

    def one(m: bytes, *values: bytes) -> bytes | None:
        if m is None or any(v is None for v in values):
            return None
        p, q, _, _, qinv = (int.from_bytes(v, "big") for v in values)
        high, low = (int.from_bytes(_power(m, values[2 + k], values[k]), "big") for k in (0, 1))
        return (low + q * ((high - low) * qinv % p)).to_bytes(((p * q).bit_length() + 7) // 8, "big")

    return pd.Series([one(*x) for x in zip(message, p, q, dp, dq, qinv, strict=True)], dtype=object)


@F.pandas_udf(T.StructType([T.StructField(name, T.BinaryType()) for name in ("n", "d", "dp", "dq", "qinv")]))
def rsa_keys(e: pd.Series, p: pd.Series, q: pd.Series) -> pd.DataFrame:
    """The key that public exponent and primes give; null fields where e has no inverse."""
    rows = []
    for values in zip(e, p, q, strict=True):
        e_, p_, q_ = (int.from_bytes(v, "big") for v in values)
        n = p_ * q_
        try:
            d = pow(e_, -1, (p_ - 1) * (q_ - 1))
            found = (n, d, d % (p_ - 1), d % (q_ - 1), pow(q_, -1, p_))
            rows.append([x.to_bytes((x.bit_length() + 7) // 8 or 1, "big") for x in found])
        except ValueError:
            rows.append([None] * 5)
    return pd.DataFrame(rows, columns=["n", "d", "dp", "dq", "qinv"])


def pkcs1_block(digest: str, bits: int, data: Column) -> Column:
    """The padded block that an RSA signature (PKCS #1 v1.5) raises to the private exponent; built-in functions only."""
    require(digest in DIGEST_PREFIX, f"no PKCS #1 prefix for {digest}")
    require(bits in RSA_BITS, f"RSA of {bits} bits")
    hashed = F.unhex(F.sha1(data)) if digest == "sha1" else F.unhex(F.sha2(data, int(digest[3:])))
    size = hashlib.new(digest).digest_size + len(DIGEST_PREFIX[digest])
    return F.concat(F.lit(b"\x00\x01" + b"\xff" * (bits // 8 - size - 3) + b"\x00" + DIGEST_PREFIX[digest]), hashed)


def rsa_sign(digest: str, bits: int, data: Column, d: Column, n: Column) -> Column:
    return mod_pow(pkcs1_block(digest, bits, data), d, n)


def rsa_verify(digest: str, bits: int, data: Column, signature: Column, e: Column, n: Column) -> Column:
    block = pkcs1_block(digest, bits, data)
    return mod_pow(signature, e, n) == block


def dh_public(bits: int, g: Column, secret: Column, p: Column) -> Column:
    """Phase one: g ** secret mod p."""
    require(bits in DH_BITS, f"Diffie-Hellman of {bits} bits")
    return mod_pow(g, secret, p)


def dh_shared(bits: int, public: Column, secret: Column, p: Column) -> Column:
    """Phase two: the peer's public value to the own secret."""
    return dh_public(bits, public, secret, p)


@F.pandas_udf(T.BinaryType())
def x25519(secret: pd.Series, point: pd.Series) -> pd.Series:
    """The Montgomery ladder of RFC 7748 on curve25519; both sides 32 bytes, little-endian."""
    prime, a24 = 2**255 - 19, 121665

    def one(k: bytes, u: bytes) -> bytes | None:
        if k is None or u is None:
            return None
        scalar = int.from_bytes(k, "little") & ~7 & (1 << 255) - 1 | 1 << 254
        x = int.from_bytes(u, "little") & (1 << 255) - 1
        x1, z1, x2, z2 = 1, 0, x, 1
        for bit in reversed(range(255)):
            if scalar >> bit & 1:
                x1, z1, x2, z2 = x2, z2, x1, z1
            plus, minus = (x1 + z1) % prime, (x1 - z1) % prime
            cross, other = (x2 - z2) * plus % prime, (x2 + z2) * minus % prime
            x2, z2 = (cross + other) ** 2 % prime, x * (cross - other) ** 2 % prime
            square, small = plus * plus % prime, minus * minus % prime
            gap = (square - small) % prime
            x1, z1 = square * small % prime, gap * (square + a24 * gap) % prime
            if scalar >> bit & 1:
                x1, z1, x2, z2 = x2, z2, x1, z1
        return (x1 * pow(z1, -1, prime) % prime if z1 else 0).to_bytes(32, "little")

    return pd.Series([one(*x) for x in zip(secret, point, strict=True)], dtype=object)
