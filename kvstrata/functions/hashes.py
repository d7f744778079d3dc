"""Murmur3 (32 bits, over bytes) as a column expression: public-domain hash, JVM-side."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the hash.
C1, C2, STEP, FINAL_1, FINAL_2 = 0xCC9E2D51, 0x1B873593, 0xE6546B64, 0x85EBCA6B, 0xC2B2AE35


def _low(x: Column) -> Column:
    return x.bitwiseAND(F.lit(0xFFFFFFFF))


def _times(x: Column, c: int) -> Column:
    """The product's low 32 bits. The factor is split, so that no step leaves a long."""
    high = (x * F.lit(c >> 16)).bitwiseAND(F.lit(0xFFFF))
    return _low(x * F.lit(c & 0xFFFF) + F.shiftleft(high, 16))


def _turn(x: Column, by: int) -> Column:
    return _low(F.shiftleft(x, by)).bitwiseOR(F.shiftright(x, 32 - by))


def _let(x: Column, f) -> Column:
    """``f`` of a value that is computed once, however often ``f`` names it."""
    return F.element_at(F.transform(F.array(x), f), 1)


def _folded(by: int):
    return lambda x: x.bitwiseXOR(F.shiftright(x, by))


def murmur3(b: Column, seed: int = 0) -> Column:
    """Signed 32-bit hash of a byte string; null of null."""
    n = F.octet_length(b)
    whole = F.floor(n / 4).cast("int")
    # Words of four bytes, the least first; the last one holds what is left, maybe nothing.
    word = lambda i: F.reverse(F.regexp_extract_all(F.hex(F.substring(b, i * 4 + 1, F.lit(4))), F.lit(".."), F.lit(0)))
    words = F.transform(F.sequence(F.lit(0), whole), lambda i: F.coalesce(F.conv(F.array_join(word(i), ""), 16, 10), F.lit("0")).cast("bigint"))
    for f in (lambda k: _times(k, C1), lambda k: _turn(k, 15), lambda k: _times(k, C2)):
        words = F.transform(words, f)

    def mixed(h: Column, k: Column) -> Column:
        return _low(_let(h.bitwiseXOR(k), lambda x: _turn(x, 13)) * 5 + STEP)

    body = lambda ks: F.aggregate(F.slice(ks, F.lit(1), whole), F.lit(seed & 0xFFFFFFFF).cast("bigint"), mixed).bitwiseXOR(F.element_at(ks, -1))
    h = _let(words, body).bitwiseXOR(n.cast("bigint"))
    for f in (_folded(16), lambda x: _times(x, FINAL_1), _folded(13), lambda x: _times(x, FINAL_2), _folded(16)):
        h = _let(h, f)
    return _let(h, lambda x: F.when(x >= 1 << 31, x - (1 << 32)).otherwise(x)).cast("int")
