"""Byte strings compressed by name, and doubles as bytes: functions that Spark lacks, in
Arrow batches. Null stays null."""

from __future__ import annotations

import struct
from collections.abc import Callable

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

_REGISTERED: dict[str, tuple[Callable[[bytes], bytes], Callable[[bytes], bytes]]] = {}


def register(name: str, compress: Callable[[bytes], bytes], decompress: Callable[[bytes], bytes]) -> None:
    """Make a compressor known by its name, which must be free. The functions travel to the
    workers with each call."""
    if name in _REGISTERED:
        raise ValueError(f"there is a compressor {name} already")
    _REGISTERED[name] = compress, decompress


def names() -> list[str]:
    return sorted(_REGISTERED)


def _found(name: str) -> tuple[Callable[[bytes], bytes], Callable[[bytes], bytes]]:
    if name not in _REGISTERED:
        raise ValueError(f"no compressor {name}; there are {', '.join(names())}")
    return _REGISTERED[name]


def _register_arrow(name: str) -> None:
    """One of Arrow's codecs, behind eight bytes with the length of the content."""

    def compress(raw: bytes) -> bytes:
        return struct.pack("<q", len(raw)) + pa.compress(raw, codec=name, asbytes=True)

    def decompress(packed: bytes) -> bytes:
        (size,) = struct.unpack_from("<q", packed)
        return pa.decompress(packed[8:], decompressed_size=size, codec=name, asbytes=True) if size else b""

    register(name, compress, decompress)


register("none", bytes, bytes)
for _name in ("gzip", "snappy", "lz4", "zstd"):
    _register_arrow(_name)


def _mapped(f: Callable[[bytes], bytes]):
    @F.pandas_udf("binary")
    def run(s: pd.Series) -> pd.Series:
        return s.map(f, na_action="ignore")

    return run


def compress(b: Column, name: str) -> Column:
    return _mapped(_found(name)[0])(b)


def decompress(b: Column, name: str) -> Column:
    return _mapped(_found(name)[1])(b)


@F.pandas_udf("binary")
def _double_bytes(s: pd.Series) -> pd.Series:
    return s.map(lambda x: struct.pack("<d", x))


@F.pandas_udf("double")
def _bytes_double(s: pd.Series) -> pd.Series:
    return s.map(lambda x: struct.unpack("<d", x)[0])


def little_endian_double(c: Column) -> Column:
    """Eight bytes of the number's IEEE form, the least first."""
    return F.when(c.isNotNull(), _double_bytes(F.coalesce(c.cast("double"), F.lit(0.0))))


def double_from_little_endian(b: Column) -> Column:
    """The number in eight bytes; null for any other length."""
    return F.when(F.octet_length(b) == 8, _bytes_double(F.when(F.octet_length(b) == 8, b).otherwise(F.lit(bytes(8)))))
