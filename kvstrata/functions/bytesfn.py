"""Byte-string functions as column expressions; all run inside whole-stage codegen."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def successor(prefix: bytes) -> bytes | None:
    """The least byte string above all that start with ``prefix``; None: there is none."""
    cut = prefix.rstrip(b"\xff")
    return cut[:-1] + bytes([cut[-1] + 1]) if cut else None


def has_prefix(key: Column, prefix: bytes | str) -> Column:
    """Prefix test as a range, which the Parquet reader can push down."""
    raw = prefix.encode() if isinstance(prefix, str) else prefix
    end = successor(raw)
    literal = (lambda b: F.lit(b.decode())) if isinstance(prefix, str) else F.lit
    test = key >= literal(raw) if raw else F.lit(True)
    if isinstance(prefix, str):  # the successor of a character may be no text; ask exactly
        return test & key.startswith(prefix)
    return test & (key < F.lit(end)) if end is not None else test


def text_bytes(c: Column, charset: str = "UTF-8") -> Column:
    return F.encode(c, charset)


def bytes_text(c: Column, charset: str = "UTF-8") -> Column:
    return F.decode(c, charset)


def stable_long(c: Column) -> Column:
    """Eight bytes, big-endian, whose unsigned order is the numbers' order."""
    return F.unhex(F.lpad(F.hex(c.cast("bigint").bitwiseXOR(F.lit(-(1 << 63)))), 16, "0"))


def long_from_stable(b: Column) -> Column:
    return _signed(F.hex(b), 16).bitwiseXOR(F.lit(-(1 << 63)))


def stable_int(c: Column) -> Column:
    """Four bytes, like ``stable_long``."""
    return F.unhex(F.lpad(F.hex((c.cast("bigint") + (1 << 31))), 8, "0"))


def int_from_stable(b: Column) -> Column:
    return (F.conv(F.hex(b), 16, 10).cast("bigint") - (1 << 31)).cast("int")


def _signed(hex16: Column, digits: int) -> Column:
    """A signed number from its hex digits: both halves, to stay within a long."""
    half = digits // 2
    hi = F.conv(F.substring(hex16, 1, half), 16, 10).cast("bigint")
    lo = F.conv(F.substring(hex16, half + 1, half), 16, 10).cast("bigint")
    return F.shiftleft(hi, half * 4).bitwiseOR(lo)


def hex_lower(b: Column) -> Column:
    return F.lower(F.hex(b))


def slice_bytes(b: Column, start: int, size: int) -> Column:
    """``size`` bytes from the 0-based ``start``."""
    return F.substring(b, start + 1, size)


def byte_at(b: Column, index: int) -> Column:
    """The byte at a 0-based index, 0 to 255; null beyond the end."""
    return F.when(F.octet_length(b) > index, F.conv(F.hex(F.substring(b, index + 1, 1)), 16, 10).cast("int"))


def index_of(b: Column, byte: int) -> Column:
    """0-based index of the first such byte, -1 if there is none."""
    return F.coalesce(F.array_position(_pairs(b), F.lit(f"{byte:02X}")).cast("int"), F.lit(0)) - 1


def last_index_of(b: Column, byte: int) -> Column:
    back = F.array_position(F.reverse(_pairs(b)), F.lit(f"{byte:02X}")).cast("int")
    return F.when(back > 0, F.octet_length(b) - back).otherwise(F.lit(-1))


def contains_byte(b: Column, byte: int) -> Column:
    return F.array_contains(_pairs(b), f"{byte:02X}")


def contains_all(b: Column, wanted: bytes) -> Column:
    """Whether each of the bytes occurs."""
    return F.size(F.array_except(F.array(*[F.lit(f"{x:02X}") for x in set(wanted)]) if wanted else F.array().cast("array<string>"), _pairs(b))) == 0


def random_bytes(size: int, seed: int | None = None) -> Column:
    """Random bytes, not the same in a task that runs again."""
    one = lambda i: F.lpad(F.hex(F.floor(F.rand(None if seed is None else seed + i) * 256).cast("bigint")), 2, "0")
    return F.unhex(F.concat(*[one(i) for i in range(size)])) if size else F.lit(b"")


def _pairs(b: Column) -> Column:
    return F.regexp_extract_all(F.hex(b), F.lit(".."), F.lit(0))


def little_endian_long(c: Column) -> Column:
    return F.unhex(_reverse_pairs(F.lpad(F.hex(c.cast("bigint")), 16, "0")))


def little_endian_int(c: Column) -> Column:
    return F.unhex(_reverse_pairs(F.lpad(F.hex(F.pmod(c.cast("bigint"), F.lit(1 << 32))), 8, "0")))


def long_from_little_endian(b: Column) -> Column:
    return _signed(_reverse_pairs(F.hex(b)), 16)


def int_from_little_endian(b: Column) -> Column:
    n = F.conv(_reverse_pairs(F.hex(b)), 16, 10).cast("bigint")
    return F.when(n >= 1 << 31, n - (1 << 32)).otherwise(n).cast("int")


def _reverse_pairs(h: Column) -> Column:
    return F.array_join(F.reverse(F.regexp_extract_all(h, F.lit(".."), F.lit(0))), "")


def command_size(key: Column, op: Column, value: Column) -> Column:
    """Bytes of a stored command: mark, key with length, version, and of a put its value
    with length."""
    return 13 + F.octet_length(key) + F.when(op == "PUT", 4 + F.octet_length(value)).otherwise(0)


def binary_size(key: Column, value: Column) -> Column:
    """Like ``command_size``, with a value's length in any case."""
    return 17 + F.octet_length(key) + F.coalesce(F.octet_length(value), F.lit(0))


def key_and_tsn_size(key: Column) -> Column:
    return 12 + F.octet_length(key)


def pack_command(key: Column, tsn: Column, op: Column, value: Column) -> Column:
    """A command as bytes: mark, key length, key, version, and of a put value length and value."""
    head = F.concat(F.when(op == "PUT", F.lit(b"\x01")).otherwise(F.lit(b"\x02")), little_endian_int(F.octet_length(key)), key, little_endian_long(tsn))
    return F.when(op == "PUT", F.concat(head, little_endian_int(F.octet_length(value)), value)).otherwise(head)


def unpack_command(b: Column) -> Column:
    """Struct of key, tsn, op and value from ``pack_command``'s bytes."""
    n = int_from_little_endian(F.substring(b, 2, 4))
    op = F.when(F.substring(b, 1, 1) == F.lit(b"\x01"), "PUT").otherwise("DEL")
    value = F.when(op == "PUT", F.substring(b, n + 18, F.octet_length(b))).otherwise(F.lit(b""))
    return F.struct(F.substring(b, F.lit(6), n).alias("key"), long_from_little_endian(F.substring(b, n + 6, F.lit(8))).alias("tsn"), op.alias("op"), value.alias("value"))


def crc(b: Column) -> Column:
    return F.crc32(b)


def digest(b: Column, name: str = "md5") -> Column:
    return F.md5(b) if name == "md5" else F.sha2(b, int(name.removeprefix("sha")))


def ellipsis(c: Column, most: int) -> Column:
    return F.when(F.length(c) > most, F.concat(F.left(c, F.lit(max(most - 3, 0))), F.lit("..."))).otherwise(c)


def human_size(c: Column) -> Column:
    """Bytes as text with a binary unit and two decimals."""
    out = F.concat(c.cast("string"), F.lit(" B"))
    for power, unit in enumerate(("KiB", "MiB", "GiB", "TiB"), 1):
        out = F.when(c >= 1 << (10 * power), F.concat(F.format_string("%.2f", c / float(1 << (10 * power))), F.lit(f" {unit}"))).otherwise(out)
    return out


def uuid_bytes(text: Column) -> Column:
    return F.unhex(F.regexp_replace(text, "-", ""))


def bytes_uuid(b: Column) -> Column:
    return F.regexp_replace(hex_lower(b), "^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5")


def is_store_id(c: Column) -> Column:
    """Whether a text is a valid store path."""
    device = r"(^|/)(con|prn|aux|nul|com[0-9]|lpt[0-9])(/|$)"
    return c.rlike(r"^[a-z0-9_-]+(/[a-z0-9_-]+)*$") & ~c.rlike(device)
