"""Bloom filters built and asked with DataFrame functions: a bit string as a constant of an expression, so that asking needs no join."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BLOCK_BITS = 4096 * 8  # what one bitmap_construct_agg group covers
LIKELY_RATE = 0.01
LIKELY_BYTES = 8 << 20


@dataclass(frozen=True)
class Level:
    bits: int
    hashes: int
    seed: int
    packed: bytes


def bits_for(count: int, rate: float) -> int:
    return max(8, math.ceil(count * math.log2(1 / rate) / math.log(2)))


def hashes_for(rate: float) -> int:
    return max(1, round(math.log2(1 / rate)))


def level(keys: DataFrame, bits: int, hashes: int, seed: int, most_bytes: int) -> Level | None:
    """The filter of a table with one column `key`; None where it would be larger than most_bytes."""
    if bits / 8 > most_bytes:
        return None
    each = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(hashes - 1).cast("long"))).alias("i")
    places = keys.select("key", each).select(position(F.col("key"), F.col("i"), bits, seed).alias("at"))
    blocks = places.groupBy(F.bitmap_bucket_number("at").alias("block")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("at")).alias("bitmap")).collect()  # at most MAX_LEVEL_BYTES
    packed = bytearray(math.ceil(bits / BLOCK_BITS) * (BLOCK_BITS // 8))
    for block, bitmap in blocks:
        packed[(block - 1) * (BLOCK_BITS // 8) : block * (BLOCK_BITS // 8)] = bitmap
    return Level(bits, hashes, seed, bytes(packed[: math.ceil(bits / 8)]))


def position(key: Column, i: Column, level_bits: int, seed: int) -> Column:
    """The i-th place 1..bits of a key, as bitmap_bucket_number and bitmap_bit_position count. Double hashing of 31-bit halves cannot overflow."""
    h = F.xxhash64(key, F.lit(seed))
    return F.pmod(h.bitwiseAND(F.lit(0x7FFFFFFF)) + F.shiftrightunsigned(h, 33) * i + i * i, F.lit(level_bits)) + F.lit(1)


def reports(level: Level, key: Column) -> Column:
    """Whether every place of the key is set: byte (place - 1) // 8 of the bit string, lowest bit first."""

    def is_set(i: Column) -> Column:
        place = (position(key, i, level.bits, level.seed) - 1).cast("int")
        byte = F.conv(F.hex(F.substr(F.lit(level.packed), F.shiftright(place, 3) + 1, F.lit(1))), 16, 2)
        return F.substr(F.lpad(byte, 8, "0"), 8 - place.bitwiseAND(F.lit(7)), F.lit(1)) == "1"

    return F.forall(F.sequence(F.lit(0).cast("long"), F.lit(level.hashes - 1).cast("long")), is_set)


def likely(keys: DataFrame, key: Column) -> Column:
    """Whether a key may be among those of a table with one column `key`: never false for one that is. The filter has a fixed largest size, from
    which on it lets more through; it spares work before an exact join and replaces none."""
    count = max(1, keys.count())
    bits = min(bits_for(count, LIKELY_RATE), LIKELY_BYTES * 8)
    found = level(keys, bits, max(1, min(hashes_for(LIKELY_RATE), round(bits / count * math.log(2)))), 0, LIKELY_BYTES)
    return reports(found, key)
