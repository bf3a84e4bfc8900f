"""AES modes composed of Spark's own ``aes_encrypt`` and ``aes_decrypt``.

Only ECB, CBC and GCM are built in. The others follow from them: OFB's keystream
is the CBC encryption of zeros, CTR's the ECB encryption of counters, the last
block of a CBC encryption is CBC-MAC and hence CMAC, CCM is CTR and CBC-MAC
together, and CFB encryption is the ECB decryption of a CBC encryption. Elsewhere
data is combined with a keystream by one XOR over Arrow's flat bytes. No mode pads:
ECB and CBC ask for whole blocks. Keys and IVs are constants, checked when the plan
is made. Null in, null out. This is not constant-time code: it is for analytics and
tests.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from bytemill.functions.buffers import xor16
from bytemill.functions.digests import hmac
from bytemill.functions.errors import require

BLOCK = 16
ZERO = bytes(BLOCK)


#: Bytes of a batch that are combined at once.
BYTES_AT_ONCE = 1 << 19


def _flat(a: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all values and where each begins, then the end, without a copy of the bytes."""
    _, offsets, data = a.buffers()
    at = np.frombuffer(offsets, np.int32, len(a) + 1, a.offset * 4).astype(np.int64)
    return np.frombuffer(data, np.uint8) if data else np.zeros(0, np.uint8), at


@F.arrow_udf(T.BinaryType())
def xor_bytes(a: pa.Array, b: pa.Array) -> pa.Array:
    """XOR of ``a`` with as many bytes of ``b``, over the flat bytes of the batch: no object a row."""
    (x, begin), (y, other) = _flat(a.cast(pa.binary())), _flat(b.cast(pa.binary()))
    present = np.asarray(a.is_valid()) & np.asarray(b.is_valid())
    size = np.where(present, np.diff(begin), 0)
    if (size > np.diff(other)).any():
        raise ValueError("the keystream is shorter than the data")
    ends = np.concatenate([[0], np.cumsum(size)])
    out = np.empty(ends[-1], np.uint8)
    row = 0
    while row < len(size):
        to = max(row + 1, int(np.searchsorted(ends, ends[row] + BYTES_AT_ONCE, "right")) - 1)
        if to == row + 1:
            np.bitwise_xor(x[begin[row] : begin[row] + size[row]], y[other[row] : other[row] + size[row]], out=out[ends[row] : ends[to]])
        else:
            inside = np.arange(ends[to] - ends[row])
            left, right = (np.repeat(start[row:to] - (ends[row:to] - ends[row]), size[row:to]) for start in (begin, other))
            out[ends[row] : ends[to]] = x[inside + left] ^ y[inside + right]
        row = to
    valid = pa.py_buffer(np.packbits(present, bitorder="little").tobytes())
    return pa.Array.from_buffers(pa.binary(), len(size), [valid, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(out)])


def _key(key: bytes) -> Column:
    require(len(key) in (16, 24, 32), f"AES key of {len(key)} bytes")
    return F.lit(key)


def _iv(iv: bytes) -> bytes:
    require(len(iv) == BLOCK, f"IV of {len(iv)} bytes")
    return iv


def _whole(data: Column) -> Column:
    """``data``, or an error where it isn't whole blocks."""
    bad = F.raise_error(F.lit("data is not a multiple of 16 bytes"))
    return F.when((F.octet_length(data) % BLOCK == 0) & (F.octet_length(data) > 0) | data.isNull(), data).otherwise(bad)


def _blocks(data: Column) -> Column:
    return F.ceil(F.octet_length(data) / BLOCK).cast("int")


def _zeros(blocks: Column) -> Column:
    return F.unhex(F.repeat(F.lit("0" * 2 * BLOCK), blocks))


def _cbc(key: Column, iv: Column, data: Column) -> Column:
    """CBC of whole blocks: the built-in form without its leading IV and its block of padding."""
    return F.substring(F.aes_encrypt(data, key, F.lit("CBC"), F.lit("PKCS"), iv), BLOCK + 1, F.octet_length(data))


def ecb_encrypt(key: bytes, data: Column) -> Column:
    data = _whole(data)
    return F.substring(F.aes_encrypt(data, _key(key), F.lit("ECB"), F.lit("PKCS")), F.lit(1), F.octet_length(data))


def _padding(key: bytes, last: Column | bytes) -> Column:
    """The block that decrypts, after ``last`` in CBC, to a whole block of padding."""
    full = F.lit(bytes([BLOCK]) * BLOCK)
    plain = full if isinstance(last, bytes) else xor16(full, last)
    return F.substring(F.aes_encrypt(plain, _key(key), F.lit("ECB"), F.lit("PKCS")), 1, BLOCK)


def ecb_decrypt(key: bytes, data: Column) -> Column:
    return F.aes_decrypt(F.concat(_whole(data), _padding(key, b"")), _key(key), F.lit("ECB"), F.lit("PKCS"))


def cbc_encrypt(key: bytes, iv: bytes, data: Column) -> Column:
    return _cbc(_key(key), F.lit(_iv(iv)), _whole(data))


def cbc_decrypt(key: bytes, iv: bytes, data: Column) -> Column:
    data = _whole(data)
    return F.aes_decrypt(F.concat(F.lit(_iv(iv)), data, _padding(key, F.substring(data, -BLOCK, BLOCK))), _key(key), F.lit("CBC"), F.lit("PKCS"))


def _counters(first: bytes, blocks: Column, block: Column) -> Column:
    """``blocks`` counters, one at least, from ``block`` after ``first`` on, as 128-bit big-endian numbers; built-in functions only."""
    start = int.from_bytes(first, "big")
    wide, short = (1 << 56) - 1, (1 << 36) - 1

    def digits(x: Column, mask: int, n: int) -> Column:
        return F.lpad(F.hex(x.bitwiseAND(F.lit(mask))), n, "0")

    def one(i: Column) -> Column:
        # 56, 36 and 36 bits, so that no sum leaves the range of a signed long
        low = i + F.lit(start & wide)
        middle = F.shiftright(low, 56) + F.lit(start >> 56 & short)
        high = F.shiftright(middle, 36) + F.lit(start >> 92)
        return F.concat(digits(high, short, 9), digits(middle, short, 9), digits(low, wide, 14))

    return F.unhex(F.array_join(F.transform(F.sequence(block, block + F.greatest(blocks, F.lit(1)).cast("long") - 1), one), ""))


def ctr(key: bytes, iv: bytes, data: Column, block: Column | None = None) -> Column:
    """Encrypts and decrypts; the counter is the whole IV, with carry over all its bits.

    A chunk of a longer message is transformed alone if ``block`` says how many whole blocks precede it.
    """
    counters = _counters(_iv(iv), _blocks(data), F.lit(0).cast("long") if block is None else block.cast("long"))
    return xor_bytes(data, F.aes_encrypt(counters, _key(key), F.lit("ECB"), F.lit("PKCS")))


def ofb(key: bytes, iv: bytes, data: Column) -> Column:
    """Encrypts and decrypts."""
    return xor_bytes(data, F.substring(F.aes_encrypt(_zeros(_blocks(data)), _key(key), F.lit("CBC"), F.lit("PKCS"), F.lit(_iv(iv))), BLOCK + 1, F.octet_length(data)))


def cfb_decrypt(key: bytes, iv: bytes, data: Column) -> Column:
    """Full-block CFB: the keystream is the encryption of the IV and all ciphertext before."""
    seen = F.substring(F.concat(F.lit(_iv(iv)), data, F.lit(ZERO)), F.lit(1), _blocks(data) * BLOCK)
    return xor_bytes(data, F.aes_encrypt(seen, _key(key), F.lit("ECB"), F.lit("PKCS")))


def cfb_encrypt(key: bytes, iv: bytes, data: Column) -> Column:
    """Full-block CFB without a fold, in built-in functions.

    The keystream is the CBC encryption of a zero block and the data: each of its blocks encrypts
    the ciphertext block before. So its decryption, from the second block on, is the ciphertext.
    """
    stream = F.aes_encrypt(F.concat(F.lit(ZERO), data), _key(key), F.lit("CBC"), F.lit("PKCS"), F.lit(_iv(iv)))
    shifted = F.concat(F.substring(stream, 2 * BLOCK + 1, 2**31 - 1), _padding(key, b""))
    return F.substring(F.aes_decrypt(shifted, _key(key), F.lit("ECB"), F.lit("PKCS")), F.lit(1), F.octet_length(data))


def _double(block: bytes) -> bytes:
    n = int.from_bytes(block, "big") << 1
    return ((n ^ 0x87 if n >> 128 else n) & ((1 << 128) - 1)).to_bytes(BLOCK, "big")


def _pad_last(data: Column) -> Column:
    """``data`` with a one bit and zeros up to a whole block."""
    filled = F.concat(data, F.lit(b"\x80"), F.lit(ZERO))
    return F.substring(filled, F.lit(1), (F.floor(F.octet_length(data) / BLOCK).cast("int") + 1) * BLOCK)


def _cbc_mac(key: Column, data: Column) -> Column:
    return F.substring(_cbc(key, F.lit(ZERO), data), -BLOCK, BLOCK)


def cmac(key: bytes, data: Column, length: int = BLOCK) -> Column:
    """AES-CMAC, of a 16-byte key and of non-empty data; cut to ``length`` bytes."""
    require(len(key) == 16, f"CMAC key of {len(key)} bytes")
    require(0 < length <= BLOCK and length % 4 == 0, f"{length} bytes of CMAC")
    from_zero = F.substring(F.aes_encrypt(F.lit(ZERO), _key(key), F.lit("ECB"), F.lit("PKCS")), 1, BLOCK)

    def doubled(block: Column) -> Column:
        # 128-bit shift in four words; the bit that falls out brings in the field's polynomial
        w = [F.conv(F.hex(F.substring(block, at, 4)), 16, 10).cast("long") for at in (1, 5, 9, 13)]
        high = [F.shiftright(x, 31) for x in w]
        low = [F.shiftleft(x, 1).bitwiseAND(F.lit(0xFFFFFFFF)) for x in w]
        shifted = [low[0].bitwiseOR(high[1]), low[1].bitwiseOR(high[2]), low[2].bitwiseOR(high[3]), low[3].bitwiseXOR(high[0] * 0x87)]
        return F.unhex(F.concat(*[F.lpad(F.hex(x), 8, "0") for x in shifted]))

    whole = F.octet_length(data) % BLOCK == 0
    padded = F.when(whole, data).otherwise(_pad_last(data))
    sub = F.when(whole, doubled(from_zero)).otherwise(doubled(doubled(from_zero)))
    ready = F.concat(F.substring(padded, F.lit(1), F.octet_length(padded) - BLOCK), xor16(F.substring(padded, -BLOCK, BLOCK), sub))
    mac = F.substring(_cbc_mac(_key(key), ready), 1, length)
    empty = F.raise_error(F.lit("CMAC of empty data"))
    return F.when((F.octet_length(data) > 0) | data.isNull(), mac).otherwise(empty)


def gcm_encrypt(key: bytes, iv: bytes, data: Column, aad: bytes = b"") -> Column:
    """Ciphertext, then the 16-byte tag."""
    require(len(iv) == 12, f"GCM IV of {len(iv)} bytes")
    return F.substring(F.aes_encrypt(data, _key(key), F.lit("GCM"), F.lit("DEFAULT"), F.lit(iv), F.lit(aad)), 13, 2**31 - 1)


def gcm_decrypt(key: bytes, iv: bytes, data: Column, aad: bytes = b"") -> Column:
    require(len(iv) == 12, f"GCM IV of {len(iv)} bytes")
    return F.aes_decrypt(F.concat(F.lit(iv), data), _key(key), F.lit("GCM"), F.lit("DEFAULT"), F.lit(aad))


def try_gcm_decrypt(key: bytes, iv: bytes, data: Column, aad: bytes = b"") -> Column:
    """Null where the tag doesn't fit."""
    require(len(iv) == 12, f"GCM IV of {len(iv)} bytes")
    return F.try_aes_decrypt(F.concat(F.lit(iv), data), _key(key), F.lit("GCM"), F.lit("DEFAULT"), F.lit(aad))


def _ccm_tag(key: bytes, nonce: bytes, data: Column, aad: bytes, tag: int) -> Column:
    width = 15 - len(nonce)
    flags = (64 if aad else 0) + 8 * ((tag - 2) // 2) + width - 1
    size = F.unhex(F.lpad(F.hex(F.octet_length(data).cast("long")), 2 * width, "0"))
    head = b""
    if aad:
        require(len(aad) < 0xFF00, "associated data too long")
        head = len(aad).to_bytes(2, "big") + aad
        head += bytes(-len(head) % BLOCK)
    filled = F.substring(F.concat(data, F.lit(ZERO)), F.lit(1), _blocks(data) * BLOCK)
    return _cbc_mac(_key(key), F.concat(F.lit(bytes([flags]) + nonce), size, F.lit(head), filled))


def _ccm(key: bytes, nonce: bytes, tag: int) -> tuple[bytes, Column]:
    require(7 <= len(nonce) <= 13, f"CCM nonce of {len(nonce)} bytes")
    require(4 <= tag <= 16 and tag % 2 == 0, f"CCM tag of {tag} bytes")
    first = bytes([14 - len(nonce)]) + nonce + bytes(15 - len(nonce))
    mask = F.substring(F.aes_encrypt(F.lit(first), _key(key), F.lit("ECB"), F.lit("PKCS")), 1, BLOCK)
    return (int.from_bytes(first, "big") + 1).to_bytes(BLOCK, "big"), mask


def ccm_encrypt(key: bytes, nonce: bytes, data: Column, aad: bytes = b"", tag: int = 16) -> Column:
    """Ciphertext, then the tag."""
    counter, mask = _ccm(key, nonce, tag)
    mac = xor16(_ccm_tag(key, nonce, data, aad, tag), mask)
    return F.concat(ctr(key, counter, data), F.substring(mac, 1, tag))


def try_ccm_decrypt(key: bytes, nonce: bytes, data: Column, aad: bytes = b"", tag: int = 16) -> Column:
    """Null where the tag doesn't fit."""
    counter, mask = _ccm(key, nonce, tag)
    plain = ctr(key, counter, F.substring(data, F.lit(1), F.octet_length(data) - tag))
    mac = F.substring(xor16(_ccm_tag(key, nonce, plain, aad, tag), mask), 1, tag)
    return F.when((F.octet_length(data) >= tag) & (mac == F.substring(data, -tag, tag)), plain)


def cbc_hmac_encrypt(key: bytes, mac_key: bytes, iv: bytes, data: Column, digest: str = "sha256", aad: bytes = b"") -> Column:
    """Encrypt, then authenticate: ciphertext and HMAC over the associated data, IV and ciphertext."""
    require(digest in ("sha1", "sha256", "sha512"), f"no AEAD with {digest}")
    body = cbc_encrypt(key, iv, data)
    return F.concat(body, hmac(digest, mac_key, F.concat(F.lit(aad), F.lit(iv), body)))


def try_cbc_hmac_decrypt(key: bytes, mac_key: bytes, iv: bytes, data: Column, digest: str = "sha256", aad: bytes = b"") -> Column:
    require(digest in ("sha1", "sha256", "sha512"), f"no AEAD with {digest}")
    size = {"sha1": 20, "sha256": 32, "sha512": 64}[digest]
    body = F.substring(data, F.lit(1), F.octet_length(data) - size)
    fits = hmac(digest, mac_key, F.concat(F.lit(aad), F.lit(iv), body)) == F.substring(data, -size, size)
    return F.when(fits, cbc_decrypt(key, iv, F.when(fits, body)))


def hmac_cbc_encrypt(key: bytes, mac_key: bytes, iv: bytes, data: Column, digest: str = "sha256", aad: bytes = b"") -> Column:
    """Authenticate, then encrypt: the HMAC over the associated data, IV and plain text is encrypted with it; together they are whole blocks."""
    require(digest in ("sha1", "sha256", "sha512"), f"no AEAD with {digest}")
    return cbc_encrypt(key, iv, F.concat(data, hmac(digest, mac_key, F.concat(F.lit(aad), F.lit(iv), data))))


def try_hmac_cbc_decrypt(key: bytes, mac_key: bytes, iv: bytes, data: Column, digest: str = "sha256", aad: bytes = b"") -> Column:
    """Null where the tag doesn't fit."""
    require(digest in ("sha1", "sha256", "sha512"), f"no AEAD with {digest}")
    size = {"sha1": 20, "sha256": 32, "sha512": 64}[digest]
    both = cbc_decrypt(key, iv, data)
    plain = F.substring(both, F.lit(1), F.octet_length(both) - size)
    return F.when(hmac(digest, mac_key, F.concat(F.lit(aad), F.lit(iv), plain)) == F.substring(both, -size, size), plain)
