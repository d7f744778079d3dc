"""Helpers shared by the training-data operators."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

#: Bytes with A-Z lower-cased and every other byte unchanged.
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One input table; read through Spark, so any store that Spark reads will do."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_OWN_ROOT: list[str] = []


def shared_root(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``. Where that is
    unset, a temporary one if all runs on one machine, else an error."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        if not _OWN_ROOT:
            _OWN_ROOT.append("file://" + tempfile.mkdtemp(prefix="kvstrata-"))
            atexit.register(shutil.rmtree, _OWN_ROOT[0][7:], ignore_errors=True)
        root = _OWN_ROOT[0]
    return root.rstrip("/")


def shared_path(spark: SparkSession, label: str) -> str:
    """A fresh path below the shared folder."""
    return f"{shared_root(spark)}/kvstrata/{label}-{uuid.uuid4().hex}"


#: While a table is written: Arrow batches stay small even if every row holds a very long
#: text, and shuffle files go as soon as the table is there.
_WRITING = {"spark.sql.execution.arrow.maxBytesPerBatch": str(32 << 20), "spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true"}


def materialize(df: DataFrame, label: str, by: str | None = None, records: int = 1000) -> DataFrame:
    """Write ``df`` as a Parquet table in the shared folder and read it again: what
    was computed survives the loss of any executor, and its size is known to the
    optimizer. With ``by``, the table lies in buckets of that column, so that later joins
    on it need not shuffle it. ``records`` bounds the rows of an Arrow batch. ``release``
    deletes it."""
    spark = df.sparkSession
    path = shared_path(spark, label)
    settings = _WRITING | {"spark.sql.execution.arrow.maxRecordsPerBatch": str(records)}
    before = {k: spark.conf.get(k, None) for k in settings}
    name = f"kvstrata_{uuid.uuid4().hex}" if by else None
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        if by:
            n = int(spark.conf.get("spark.sql.shuffle.partitions"))
            df.repartition(n, by).write.option("compression", "zstd").option("path", path).bucketBy(n, by).saveAsTable(name)
        else:
            df.write.option("compression", "zstd").parquet(path)
    except BaseException:
        if by:
            spark.sql(f"DROP TABLE IF EXISTS {name}")
        remove_path(spark, path)
        raise
    finally:
        for k, v in before.items():
            spark.conf.set(k, v) if v is not None else spark.conf.unset(k)
    out = spark.table(name) if by else spark.read.schema(df.schema).parquet(path)
    out._kvstrata_path, out._kvstrata_name = path, name
    return out


def owning(out: DataFrame, *what: DataFrame | str) -> DataFrame:
    """``out``, which reads these tables and folders: its release deletes them."""
    out._kvstrata_owned = [*getattr(out, "_kvstrata_owned", []), *what]
    return out


def release(*frames: DataFrame) -> None:
    """Delete the tables that ``materialize`` wrote for these frames, and what they own.
    Nothing may read them any more."""
    for df in frames:
        for x in getattr(df, "_kvstrata_owned", []):
            remove_path(df.sparkSession, x) if isinstance(x, str) else release(x)
        path = getattr(df, "_kvstrata_path", None)
        if getattr(df, "_kvstrata_name", None):
            df.sparkSession.sql(f"DROP TABLE IF EXISTS {df._kvstrata_name}")
        if path:
            remove_path(df.sparkSession, path)


def remove_path(spark: SparkSession, path: str) -> None:
    jvm = spark._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def open_fs(path: str):
    """(pyarrow file system, path in it) for a folder in the shared store."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else f"file://{path}")


def pieces(batches: Iterator[pa.RecordBatch], size: int = 4 << 20, rows: int = 1000) -> Iterator[pa.RecordBatch]:
    """Pieces of batches with at most ``rows`` rows and, but for single rows, ``size`` bytes of
    their column ``text``."""
    for batch in batches:
        lo, held = 0, 0
        for i, text in enumerate(batch["text"]):
            n = len(text.as_buffer()) if text.is_valid else 0
            if i > lo and (i - lo >= rows or held + n > size):
                yield batch.slice(lo, i - lo)
                lo, held = i, 0
            held += n
        if lo < batch.num_rows:
            yield batch.slice(lo)


_U = np.uint64
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mix(x: np.ndarray) -> np.ndarray:
    """A strong 64-bit mixer (splitmix64's finalizer), on a fresh array."""
    x = x ^ (x >> np.uint64(30))
    x *= _M1
    x ^= x >> np.uint64(27)
    x *= _M2
    x ^= x >> np.uint64(31)
    return x


def window_hashes(h: np.ndarray, k: int) -> np.ndarray:
    """64-bit hashes of all runs of ``k`` consecutive words, from word hashes. Doubling:
    a run's hash comes from two runs of half the length, so log2(k) passes do."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    parts, size, cur, offset = [], 1, h, 0
    left = k
    while left:
        if left & 1:
            parts.append((cur, offset))
            offset += size
        left >>= 1
        if left:
            cur = mix(cur[:-size] * np.uint64(0x9E3779B97F4A7C15) + cur[size:])
            size *= 2
    out = np.full(n, k, np.uint64)
    for cur, offset in parts:
        out = mix(out * np.uint64(0xD6E8FEB86659FD93) + cur[offset : offset + n])
    return out


def group_of(key: np.ndarray, groups: int) -> np.ndarray:
    return (key >> _U(64 - (groups.bit_length() - 1))).astype(np.int64) if groups > 1 else np.zeros(len(key), np.int64)


def pack(arrays: list[np.ndarray]) -> bytes:
    """Arrays of one length as bytes, each in the narrowest whole numbers that hold it;
    arrays of zeros take none."""
    parts, codes = [], []
    for a in arrays:
        most = int(a.max()) if len(a) else 0
        kind = np.min_scalar_type(most)
        codes.append(kind.itemsize if most else 0)
        if most:
            parts.append(np.ascontiguousarray(a, kind).tobytes())
    return b"".join([np.array([len(arrays), len(arrays[0]), *codes], "<i8").tobytes(), *parts])


def unpack(raw: bytes) -> list[np.ndarray]:
    k, n = np.frombuffer(raw, "<i8", 2).tolist()
    codes = np.frombuffer(raw, "<i8", k, 16).tolist()
    out, at = [], 16 + 8 * k
    for c in codes:
        out.append(np.frombuffer(raw, f"<u{c}", n, at) if c else np.zeros(n, np.uint8))
        at += n * c
    return out


def dealt(group: np.ndarray, arrays: list[np.ndarray]) -> Iterator[tuple[int, list[np.ndarray]]]:
    """(group, its rows of the arrays)."""
    order = np.argsort(group.astype(np.uint16) if len(group) and group.max() < 1 << 16 else group, kind="stable")
    group = group[order]
    cut = np.concatenate(([0], np.flatnonzero(group[1:] != group[:-1]) + 1, [len(group)])) if len(group) else [0]
    arrays = [a[order] for a in arrays]
    for a, b in zip(cut[:-1], cut[1:], strict=True):
        yield int(group[a]), [x[a:b] for x in arrays]


#: Texts are hashed in blocks of about so many bytes, and longer words one by one.
_BLOCK, _LONG = 1 << 18, 64
_GAP = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])
_BASE = 0x9E6C63D0876A9A35


def _symbols(seed: int) -> np.ndarray:
    """A number for each byte; 0 for gaps."""
    out = np.random.default_rng(seed).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    out[_GAP] = 0
    return out


#: By seed: two tables that have nothing to do with each other give two independent hashes.
_SYMBOL = [_symbols(20240301), _symbols(20240302)]
_SYMBOL_LOWER = [s[np.frombuffer(LOWER, np.uint8)] for s in _SYMBOL]
_POWERS: list[np.ndarray] = []


def _powers() -> list[np.ndarray]:
    """Powers of the base and of its inverse, modulo 2 ** 64."""
    if not _POWERS:
        for x in (_BASE, pow(_BASE, -1, 1 << 64)):
            steps = np.full(_BLOCK + 2, x, np.uint64)
            steps[0] = 1
            _POWERS.append(np.multiply.accumulate(steps))
    return _POWERS


def _long_word(word: bytes, lower: bool, seed: int) -> int:
    from xxhash import xxh3_64_intdigest

    return xxh3_64_intdigest(word.translate(LOWER) if lower else word, seed)


def _hash_block(block: bytes, lower: bool, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts and hashes of a block's words. The block begins and ends with a gap. A word's
    hash is a polynomial of its bytes' symbols, as a difference of sums over the block."""
    power, inverse = _powers()
    x = np.frombuffer(block, np.uint8)
    gap = _GAP[x]
    edge = np.flatnonzero(gap[1:] != gap[:-1]) + 1
    start, end = edge[0::2], edge[1::2]
    sums = np.cumsum((_SYMBOL_LOWER if lower else _SYMBOL)[seed][x] * power[: len(x)])
    size = end - start
    h = mix((sums[end - 1] - sums[start - 1]) * inverse[start] + size.astype(np.uint64))
    for i in np.flatnonzero(size > _LONG).tolist():
        h[i] = _long_word(block[start[i] : end[i]], lower, seed)
    return start, h


def _pieces(text: bytes, lower: bool, seed: int) -> Iterator[np.ndarray]:
    """Hashes of a long text's words, piece by piece; pieces end at gaps."""
    at, x = 0, np.frombuffer(text, np.uint8)
    while at < len(text):
        gaps = np.flatnonzero(_GAP[x[at : at + _BLOCK - 2]])
        last = len(text) <= at + _BLOCK - 2
        if len(gaps) or last:
            end = len(text) if last else at + int(gaps[-1]) + 1
            yield _hash_block(b" " + text[at:end] + b" ", lower, seed)[1]
        else:  # one word fills the piece
            end = at + _BLOCK - 2
            while end < len(text) and not (more := np.flatnonzero(_GAP[x[end : end + _BLOCK]])).size:
                end += _BLOCK
            end = min(len(text), end + (int(more[0]) if end < len(text) else 0))
            yield np.array([_long_word(text[at:end], lower, seed)], np.uint64)
        at = end


def hash_texts(texts: list[bytes | None], lower: bool = False, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words ``[^\\x20\\x09-\\x0D]+`` of all texts end to end (with ``lower``,
    of their words with A-Z lower-cased), and how many words each text has. Seeds 0 and 1 give
    independent hashes."""
    parts, sizes = [], np.zeros(len(texts), np.int64)
    held: list[bytes] = []
    first = room = 0

    def flush() -> None:
        if held:
            start, h = _hash_block(b" " + b" ".join(held) + b" ", lower, seed)
            bounds = np.cumsum([1, *(len(t) + 1 for t in held)])
            sizes[first : first + len(held)] = np.diff(np.searchsorted(start, bounds))
            parts.append(h)

    for i, t in enumerate(texts):
        t = t or b""
        if held and room + len(t) + 2 > _BLOCK or len(t) + 2 > _BLOCK:
            flush()
            held, room = [], 0
        if len(t) + 2 > _BLOCK:
            mine = list(_pieces(t, lower, seed))
            sizes[i] = sum(map(len, mine))
            parts += mine
            continue
        if not held:
            first = i
        held.append(t)
        room += len(t) + 1
    flush()
    return (np.concatenate(parts) if parts else np.zeros(0, np.uint64)), sizes
