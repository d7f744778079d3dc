"""Benchmark decontamination by Wu-Manber multi-pattern search.

Patterns are sequences of words. A table over blocks of two words says how far the
search window may jump; where it may not, the block's bucket holds the patterns that
end with it, and a direct comparison confirms each occurrence.

Defined results: a null or wordless text has no words and no hits; a null or wordless
item has no windows; rows of ``benchmark`` with one ``item_id`` are one item; rows
without ``item_id`` are passed over; repeated document rows are judged one by one; an
empty benchmark hits nothing. A very long text is searched whole. Only the id and text
columns are read, so extra columns may have any names.
"""

from __future__ import annotations

import pickle
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kvstrata.llm.common import open_fs, owning, shared_path

#: Lower-cases A-Z; every other ASCII byte that is no digit or letter becomes a space.
_NORMAL = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))


def words_of(text: bytes | None) -> list[bytes]:
    """Words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` of the lower-cased text, in UTF-8."""
    return text.translate(_NORMAL).split() if text else []


class WuManber:
    """Search for many word sequences of one length at once."""

    BLOCK = 2

    def __init__(self, patterns: dict[tuple[int, ...], int], length: int, base: int):
        """``patterns``: word ids -> pattern number. ``base``: greater than any word id."""
        self.length, self.base = length, base
        self.block = min(self.BLOCK, length)
        self.far = length - self.block + 1
        self.shift: dict[int, int] = {}
        self.bucket: dict[int, list[tuple[list[int], int]]] = {}
        for ids, number in patterns.items():
            for end in range(self.block, length + 1):
                key = self._key(ids, end)
                jump = length - end
                if jump < self.shift.get(key, self.far):
                    self.shift[key] = jump
            self.bucket.setdefault(self._key(ids, length), []).append((list(ids), number))

    def _key(self, ids, end: int) -> int:
        key = ids[end - 1]
        return key if self.block == 1 else ids[end - 2] * self.base + key

    def search(self, ids: list[int]) -> Iterator[tuple[int, int]]:
        """(start, pattern number) of all occurrences, in the order of their starts."""
        m, far, base, n = self.length, self.far, self.base, len(ids)
        shift, bucket, two = self.shift.get, self.bucket, self.block == 2
        end = m
        while end <= n:
            last = ids[end - 1]
            if not last:  # a word of no pattern: no window may hold it
                end += m
                continue
            key = ids[end - 2] * base + last if two else last
            jump = shift(key, far)
            if jump:
                end += jump
                continue
            here = ids[end - m : end]
            for pattern, number in bucket[key]:
                if pattern == here:
                    yield end - m, number
            end += 1


class Matcher:
    """All windows of a block of items, one Wu-Manber search for each window length."""

    def __init__(self, items: list[tuple[str, bytes]], window: int):
        self.vocab: dict[bytes, int] = {}
        owners: dict[tuple[int, ...], set[str]] = {}
        for item, text in items:
            ids = [self.vocab.setdefault(w, len(self.vocab) + 1) for w in words_of(text)]
            size = min(window, len(ids))
            for i in range(len(ids) - size + 1 if size else 0):
                owners.setdefault(tuple(ids[i : i + size]), set()).add(item)
        self.owners = [owners[p] for p in owners]
        by_length: dict[int, dict[tuple[int, ...], int]] = {}
        for number, p in enumerate(owners):
            by_length.setdefault(len(p), {})[p] = number
        self.searches = [WuManber(ps, m, len(self.vocab) + 1) for m, ps in sorted(by_length.items())]

    def find(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set[str]]:
        """Spans of the occurrences, and the items that they belong to."""
        get = self.vocab.get
        ids = [get(w, 0) for w in words]
        spans, items = [], set()
        for s in self.searches:
            for start, number in s.search(ids):
                spans.append((start, start + s.length))
                items |= self.owners[number]
        return spans, items


def _union(spans) -> tuple[int, list[int]]:
    """Number of words covered, and the merged spans as a flat list."""
    total, flat = 0, []
    for a, b in sorted(spans):
        if flat and a <= flat[-1]:
            if b > flat[-1]:
                total += b - flat[-1]
                flat[-1] = b
        else:
            total += b - a
            flat += [a, b]
    return total, flat


def item_blocks(benchmark: DataFrame, item_col: str, text_col: str, block_bytes: int) -> tuple[str, list[str]]:
    """Writes the items to files of at most ``block_bytes`` (plus one item) in a fresh folder
    of the shared store: the folder, and the files' names, which alone come to the driver.
    Rows with one id may fall into several files; sets of ids make that harmless."""
    spark = benchmark.sparkSession
    rows = benchmark.where(F.col(f"`{item_col}`").isNotNull() & F.col(f"`{text_col}`").isNotNull()).select(F.col(f"`{item_col}`").cast("string").alias("item"), F.col(f"`{text_col}`").cast("binary").alias("text"))
    folder = shared_path(spark, "items")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = open_fs(folder)
        fs.create_dir(root, recursive=True)
        block, size = [], 0

        def write() -> pa.RecordBatch:
            name = uuid.uuid4().hex
            with fs.open_output_stream(f"{root}/{name}", compression=None) as out:
                out.write(pickle.dumps(block))
            return pa.RecordBatch.from_arrays([pa.array([name])], ["name"])

        for batch in batches:
            for item, text in zip(batch["item"], batch["text"], strict=True):
                block.append((item.as_py(), text.as_py()))
                size += len(block[-1][1])
                if size >= block_bytes:
                    yield write()
                    block, size = [], 0
        if block:
            yield write()

    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    written = rows.coalesce(max(1, size // (16 * block_bytes))).mapInArrow(run, "name string")
    return folder, sorted(r["name"] for r in written.collect())


_CACHE: dict = {}


def _matcher(folder: str, name: str, window: int) -> Matcher:
    """The matcher of a file of items; a worker keeps one."""
    key = (folder, name, window)
    if key not in _CACHE:
        _CACHE.clear()
        fs, root = open_fs(f"{folder}/{name}")
        with fs.open_input_stream(root, compression=None) as src:
            _CACHE[key] = Matcher(pickle.loads(src.read()), window)
    return _CACHE[key]


def find_items(docs: DataFrame, benchmark: DataFrame, *, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = 8, block_bytes: int = 2 << 20, hold_bytes: int = 64 << 20, keep: list[str]) -> DataFrame:
    """Columns ``keep`` of each row of ``docs``, with ``__n_words``, ``__n_hit`` and
    ``__items`` (sorted ids of items of which a window occurs).

    Items lie in files of at most ``block_bytes`` (plus one item). A task has one file's
    matcher at a time: rows of up to ``hold_bytes`` are held and meet the files one after
    another (with one file, they stream by). So memory is bounded however large the
    benchmark is, and nothing is broadcast. No shuffle of documents.
    """
    names = [f"__k{i}" for i in range(len(keep))]
    folder, files = item_blocks(benchmark, item_col, item_text_col, block_bytes)
    source = docs.select(*[F.col(f"`{c}`").alias(n) for c, n in zip(keep, names, strict=True)], F.col(f"`{text_col}`").cast("binary").alias("__text"))
    schema = source.select(*names, F.lit(0).cast("bigint").alias("__n_words"), F.lit(0).cast("bigint").alias("__n_hit"), F.array(F.lit("")).alias("__items")).schema

    def search(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        spans = [[[] for _ in range(b.num_rows)] for b in held]
        items = [[set() for _ in range(b.num_rows)] for b in held]
        for name in files:
            find = _matcher(folder, name, window).find
            for b, s, ids in zip(held, spans, items, strict=True):
                for i, text in enumerate(b["__text"]):
                    found, which = find(words_of(text.as_py()))
                    if found:
                        s[i] = _union([*found, *zip(s[i][::2], s[i][1::2], strict=True)])[1]
                        ids[i] |= which
        for b, s, ids in zip(held, spans, items, strict=True):
            n = [len(words_of(t.as_py())) for t in b["__text"]]
            hit = [sum(y - x for x, y in zip(f[::2], f[1::2], strict=True)) for f in s]
            yield pa.RecordBatch.from_arrays([*(b[c] for c in names), pa.array(n, pa.int64()), pa.array(hit, pa.int64()), pa.array([sorted(x) for x in ids], pa.list_(pa.string()))], [*names, "__n_words", "__n_hit", "__items"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            for lo in range(0, batch.num_rows, 1000):
                part = batch.slice(lo, 1000)
                held.append(part)
                size += part["__text"].nbytes
                if len(files) < 2 or size >= hold_bytes:
                    yield from search(held)
                    held, size = [], 0
        if held:
            yield from search(held)

    out = source.mapInArrow(run, schema)
    return owning(out.select(*[F.col(n).alias(c) for c, n in zip(keep, names, strict=True)], "__n_words", "__n_hit", F.array_sort("__items").alias("__items")), folder)


def contamination(docs: DataFrame, benchmark: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", window: int = 8, min_items: int = 2) -> DataFrame:
    """Per document row: id, n_words, n_hit, n_items, item_ids (sorted array) and
    contaminated (at least ``min_items`` items)."""
    found = find_items(docs.select(F.col(f"`{id_col}`"), F.col(f"`{text_col}`")), benchmark, text_col=text_col, window=window, keep=[id_col])
    n_items = F.size("__items").cast("bigint")
    out = found.select(F.col(id_col), F.col("__n_words").alias("n_words"), F.col("__n_hit").alias("n_hit"), n_items.alias("n_items"), F.col("__items").alias("item_ids"), (n_items >= min_items).alias("contaminated"))
    return owning(out, found)


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, *, text_col: str = "text", window: int = 8, min_items: int = 1) -> DataFrame:
    """The rows of ``docs`` in which windows of fewer than ``min_items`` items occur,
    all columns unchanged."""
    names = [f"__c{i}" for i in range(len(docs.columns))]
    of = dict(zip(docs.columns, names, strict=True))
    found = find_items(docs.toDF(*names), benchmark, text_col=of[text_col], window=window, keep=names)
    return owning(found.where(F.size("__items") < min_items).select(*[F.col(n).alias(c) for n, c in zip(names, docs.columns, strict=True)]), found)
