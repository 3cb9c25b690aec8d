"""Hashes, owners, Bloom filter arithmetic and the integer codec."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def murmur3_x86_32(data: bytes, seed: int) -> int:
    """The public 32-bit hash of bytes, unsigned."""
    mask = 0xFFFFFFFF
    h, n = seed & mask, len(data)
    for i in range(0, n - n % 4, 4):
        h = _round(h, int.from_bytes(data[i : i + 4], "little"))
        h = (((h << 13) & mask | h >> 19) * 5 + 0xE6546B64) & mask
    if n % 4:
        h = _round(h, int.from_bytes(data[n - n % 4 :], "little"))
    h ^= n
    h = ((h ^ h >> 16) * 0x85EBCA6B) & mask
    h = ((h ^ h >> 13) * 0xC2B2AE35) & mask
    return h ^ h >> 16


def _round(h: int, k: int) -> int:
    k = (k * 0xCC9E2D51) & 0xFFFFFFFF
    k = (k << 15 | k >> 17) & 0xFFFFFFFF
    return h ^ (k * 0x1B873593) & 0xFFFFFFFF


def _unround(x: int, shift: int) -> int:
    out = x
    for _ in range(32 // shift + 1):
        out = x ^ out >> shift
    return out & 0xFFFFFFFF


def int_with_hash(seed: int) -> int:
    """The signed integer whose built-in hash (seed 42) is ``seed``: the inverse of the hash's steps.

    ``hash(int_with_hash(s), key)`` is then the hash of key with seed s, as every argument's hash seeds the next.
    """
    mask = 0xFFFFFFFF
    h = _unround(seed & mask, 16)
    h = _unround((h * pow(0xC2B2AE35, -1, 1 << 32)) & mask, 13)
    h = _unround((h * pow(0x85EBCA6B, -1, 1 << 32)) & mask, 16) ^ 4
    h = ((h - 0xE6546B64) * pow(5, -1, 1 << 32)) & mask
    h = (h >> 13 | h << 19) & mask
    k = h ^ 42
    k = (k * pow(0x1B873593, -1, 1 << 32)) & mask
    k = (k >> 15 | k << 17) & mask
    k = (k * pow(0xCC9E2D51, -1, 1 << 32)) & mask
    return k - (1 << 32) if k >> 31 else k


def hash_native(key: Column, seed: int = 1) -> Column:
    """Unsigned 32-bit hash as bigint, inside generated code; equals the public hash for keys of 4n bytes."""
    return F.hash(F.lit(int_with_hash(seed)), key).cast("bigint").bitwiseAND(F.lit(0xFFFFFFFF))


def _let(x: Column, f) -> Column:
    """f(x), with x computed once however often f uses it."""
    return F.element_at(F.transform(F.array(x), f), 1)


def _times(x: Column, factor: int) -> Column:
    """Product of 32-bit numbers, modulo 2^32; no step leaves 63 bits."""
    high = F.shiftright(x, 16) * F.lit(factor)
    return (x.bitwiseAND(F.lit(0xFFFF)) * F.lit(factor) + F.shiftleft(high.bitwiseAND(F.lit(0xFFFF)), 16)).bitwiseAND(F.lit(0xFFFFFFFF))


def _mixed(x: Column, shifts: tuple[int, ...], factor: int | None = None) -> Column:
    """x with its shifts to the right by exclusive or, times the factor."""

    def step(v: Column) -> Column:
        out = v
        for n in shifts:
            out = out.bitwiseXOR(F.shiftright(v, n))
        return out

    mixed = _let(x, step)
    return mixed if factor is None else _let(mixed, lambda v: _times(v, factor))


def hash_exact(key: Column, seed: int = 1) -> Column:
    """The public hash for keys of any length, in the JVM; null stays null.

    The built-in hash takes the key's whole words; its finish is undone, the bytes that are left go in, and the finish is
    done again with the full length.
    """
    raw = key.cast("binary")
    n = F.octet_length(raw)
    whole = n - n % 4
    inverse = lambda c: pow(c, -1, 1 << 32)
    done = hash_native(raw.substr(F.lit(1), whole), seed)
    body = _mixed(_mixed(_mixed(done, (16,), inverse(0xC2B2AE35)), (13, 26), inverse(0x85EBCA6B)), (16,)).bitwiseXOR(whole.cast("bigint"))
    rest = F.hex(raw.substr(whole + 1, F.lit(3)))
    tail = F.coalesce(F.conv(F.nullif(F.concat(*[F.substring(rest, i, 2) for i in (5, 3, 1)]), F.lit("")), 16, 10).cast("bigint"), F.lit(0).cast("bigint"))
    turned = _let(_times(tail, 0xCC9E2D51), lambda k: F.shiftleft(k, 15).bitwiseOR(F.shiftright(k, 17)).bitwiseAND(F.lit(0xFFFFFFFF)))
    with_tail = body.bitwiseXOR(_let(turned, lambda k: _times(k, 0x1B873593))).bitwiseXOR(n.cast("bigint"))
    return F.when(raw.isNotNull(), _mixed(_mixed(_mixed(with_tail, (16,), 0x85EBCA6B), (13,), 0xC2B2AE35), (16,)))


def owner_of(hash_value: Column, ranks: int) -> Column:
    """Rank that owns a key: the hash modulo the number of ranks."""
    return F.pmod(hash_value, F.lit(ranks)).cast("int")


def first_digit_hash(key: Column) -> Column:
    """The hash of the deterministic fixtures: first character less '0'."""
    return F.ascii(key) - F.lit(48)


def route(df: DataFrame, partitions: int, owner: str = "owner") -> DataFrame:
    """Rows of one owner in one partition, as writes are sent to their owner."""
    return df.repartition(partitions, owner)


def with_owner_predicate(df: DataFrame, key: str, hash_of, ranks: int, owner: str = "owner") -> DataFrame:
    """Rows of one key, with the owner as a literal predicate too, so partitions of other owners aren't read."""
    one = df.sparkSession.range(1).select(owner_of(hash_of(F.lit(key)), ranks).alias("o")).first()["o"]
    return df.where((F.col(owner) == F.lit(one)) & (F.col("key") == F.lit(key)))


def bloom_bits(n: Column, p: Column) -> Column:
    """Bits for n entries at a false-positive rate p; 0 for no entries."""
    return F.ceil(n * F.log(p) / F.log(F.lit(0.6185))).cast("bigint")


def bloom_hashes(n: Column, p: Column) -> Column:
    """Hash functions: bits / n * ln 2, rounded; 0 for no entries."""
    return F.when(n > 0, F.round(bloom_bits(n, p) / n * F.log(F.lit(2.0)))).otherwise(0).cast("bigint")


def splitmix(x: np.ndarray) -> np.ndarray:
    """A mixing function of 64-bit integers."""
    x = (x + np.uint64(0x9E3779B97F4A7C15)).astype(np.uint64)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Bloom:
    """A Bloom filter over 64-bit hashes of keys, by double hashing; its bytes can be kept and loaded."""

    def __init__(self, n: int, p: float = 0.01, bits: bytes | None = None):
        self.size = max(1, math.ceil(n * math.log(p) / math.log(0.6185))) if n else 1
        self.hashes = round(self.size / n * math.log(2)) if n else 0
        self.bits = np.zeros(self.size, bool) if bits is None else np.unpackbits(np.frombuffer(bits, np.uint8), count=self.size).astype(bool)

    def _spots(self, hashes: np.ndarray) -> np.ndarray:
        a = np.asarray(hashes).astype(np.int64).view(np.uint64)
        b = splitmix(a) | np.uint64(1)
        return ((a[:, None] + np.arange(self.hashes, dtype=np.uint64) * b[:, None]) % np.uint64(self.size)).astype(np.int64)

    def insert(self, hashes) -> None:
        self.bits[self._spots(np.asarray(hashes)).ravel()] = True

    def contains(self, hashes) -> np.ndarray:
        """False: surely absent."""
        return self.bits[self._spots(np.asarray(hashes))].all(axis=1)

    def to_bytes(self) -> bytes:
        return np.packbits(self.bits).tobytes()


def encode_int(x: Column) -> Column:
    """An unsigned 32-bit integer as 8 hexadecimal digits, least byte first."""
    big = F.lpad(F.hex(x), 8, "0")
    return F.concat(*[F.substring(big, i, 2) for i in (7, 5, 3, 1)])


def decode_int(h: Column) -> Column:
    """The integer of ``encode_int``'s digits."""
    return F.conv(F.concat(*[F.substring(h, i, 2) for i in (7, 5, 3, 1)]), 16, 10).cast("bigint")
