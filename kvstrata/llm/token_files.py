"""Token-id files: independent zstandard frames with a trailing seek table.

A file is a row of zstandard frames, each of the ids of whole documents, then one frame
with the directory (which document lies in which frame, and where), then a skippable
frame with the seek table: compressed size, decompressed size and checksum (low 32 bits
of XXH64 of the decompressed bytes) of every frame, in the public seekable layout. A
reader gets at the table from the file's end, reads the directory, and decompresses just
the frames that hold the documents asked for.

Defined results: a null text counts as empty (its end id only); rows without an id come
first; rows with one id are separate documents in the order of their texts; an empty
table gives no files and no rows. A very long text is encoded whole and lies in one frame.
"""

from __future__ import annotations

import io
import os
import re
import struct
import uuid
import zlib
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kvstrata.llm.common import materialize, open_fs, owning, shared_path

SKIPPABLE, SEEKABLE = 0x184D2A5E, 0x8F92EAB1
_ENTRY, _FOOTER = struct.Struct("<III"), struct.Struct("<IBI")


class FrameWriter:
    """Writes documents' ids to an open binary file. ``width``: bytes of an id (2 or 4)."""

    def __init__(self, out, width: int, frame_bytes: int = 1 << 20, level: int = 3):
        import zstandard

        self.out, self.width, self.frame_bytes = out, width, frame_bytes
        self.zstd = zstandard.ZstdCompressor(level=level, write_checksum=True, write_content_size=True)
        self.table: list[tuple[int, int, int]] = []
        self.docs: list[tuple[int, int, int, int]] = []  # row number, frame, offset in ids, ids
        self.held: list[bytes] = []
        self.size = 0

    def add(self, number: int, ids: np.ndarray) -> None:
        self.docs.append((number, len(self.table), self.size // self.width, len(ids)))
        raw = ids.astype(f"<u{self.width}").tobytes()
        self.held.append(raw)
        self.size += len(raw)
        if self.size >= self.frame_bytes:
            self._flush()

    def _flush(self) -> None:
        if self.held:
            self._frame(b"".join(self.held))
            self.held, self.size = [], 0

    def _frame(self, raw: bytes) -> None:
        from xxhash import xxh64_intdigest

        packed = self.zstd.compress(raw)
        self.out.write(packed)
        self.table.append((len(packed), len(raw), xxh64_intdigest(raw) & 0xFFFFFFFF))

    def close(self) -> None:
        self._flush()
        self._frame(struct.pack("<QB", len(self.docs), self.width) + np.array(self.docs, "<i8").tobytes())
        body = b"".join(_ENTRY.pack(*e) for e in self.table) + _FOOTER.pack(len(self.table), 0x80, SEEKABLE)
        self.out.write(struct.pack("<II", SKIPPABLE, len(body)) + body)


class FrameReader:
    """Reads documents from a seekable binary file."""

    def __init__(self, src):
        import zstandard

        self.src, self.zstd = src, zstandard.ZstdDecompressor()
        end = src.seek(0, os.SEEK_END)
        src.seek(end - _FOOTER.size)
        count, flags, magic = _FOOTER.unpack(src.read(_FOOTER.size))
        if magic != SEEKABLE or not flags & 0x80:
            raise ValueError("no seek table")
        body = count * _ENTRY.size + _FOOTER.size
        src.seek(end - body - 8)
        if struct.unpack("<II", src.read(8)) != (SKIPPABLE, body):
            raise ValueError("damaged seek table")
        entries = src.read(count * _ENTRY.size)
        self.table = [_ENTRY.unpack_from(entries, i * _ENTRY.size) for i in range(count)]
        starts = np.cumsum([0, *(e[0] for e in self.table)])
        if starts[-1] != end - body - 8:
            raise ValueError("frames and seek table disagree")
        self.starts = starts.tolist()
        raw = self.frame(count - 1)
        n, self.width = struct.unpack_from("<QB", raw)
        self.docs = np.frombuffer(raw, "<i8", offset=9).reshape(n, 4)
        self.at, self.ids = -1, np.zeros(0, "<u2")

    def frame(self, k: int) -> bytes:
        """One frame's bytes, checked against its entry."""
        from xxhash import xxh64_intdigest

        packed, size, check = self.table[k]
        self.src.seek(self.starts[k])
        raw = self.zstd.decompress(self.src.read(packed), max_output_size=size) if size else b""
        if len(raw) != size or xxh64_intdigest(raw) & 0xFFFFFFFF != check:
            raise ValueError(f"damaged frame {k}")
        return raw

    def read(self, index: int) -> np.ndarray:
        """Ids of the document at ``index`` of the directory; only its frame is read."""
        _, k, start, n = self.docs[index]
        if k != self.at:
            self.ids, self.at = np.frombuffer(self.frame(int(k)), f"<u{self.width}"), int(k)
        return self.ids[start : start + n]


class WordMemo(dict):
    """Packed ids of text parts, made by the tokenizers library and kept while they
    are frequent: two memos bound the size."""

    MOST, CHARS = 500_000, 48

    def __init__(self, tokenizer, old: dict):
        super().__init__()
        self.tokenizer, self.old = tokenizer, old

    def __missing__(self, part: bytes) -> bytes:
        ids = self.old.get(part)
        if ids is None:
            ids = np.array(self.tokenizer.encode(part.decode(), add_special_tokens=False).ids, "<u4").tobytes()
        if len(part) <= self.CHARS:
            self[part] = ids
        return ids


class Encoder:
    """Encodes whole texts as the tokenizers library does. If the tokenizer drops white
    space between words and splits letters from signs (a few probes tell), texts are cut
    at ASCII white space, and between a letter and a sign that follows it, and parts are
    encoded through a memo; else the library gets the whole text."""

    SIGN = re.compile(rb"(?<=[A-Za-z])(?=[,.!?;:])")

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.vocab = self.tokenizer.get_vocab_size()
        probe = lambda t: self.tokenizer.encode(t, add_special_tokens=False).ids
        self.by_word = probe("x \t\n\x0b\x0c\r y") == probe("x y") == probe("x") + probe("y") and probe(" x ") == probe("x") and probe(" \t") == []
        self.by_sign = self.by_word and all(probe(f"ab{c}{d}") == probe("ab") + probe(f"{c}{d}") for c in ",.!?;:" for d in ("", ",", "x", "9", "'s"))
        self.memo = WordMemo(self.tokenizer, {})

    def packed(self, text: bytes | None) -> bytes:
        if not text:
            return b""
        if not self.by_word:
            return np.array(self.tokenizer.encode(text.decode(), add_special_tokens=False).ids, "<u4").tobytes()
        if len(self.memo) > WordMemo.MOST:
            self.memo = WordMemo(self.tokenizer, dict(self.memo))
        if self.by_sign:
            text = self.SIGN.sub(b" ", text)
        return b"".join(map(self.memo.__getitem__, text.split()))


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def write_token_files(docs: DataFrame, tokenizer: str, folder: str, *, end_id: int, id_col: str = "doc_id", text_col: str = "text", partitions: int | None = None) -> DataFrame:
    """Encode every text, append ``end_id``, and write the ids to files in ascending
    order of ids: file k holds what range k of the ids has. Returns the manifest (one
    row a file, in a table in the shared folder): part, path, n_docs, n_tokens and
    start, the number of ids in all files before.

    One shuffle by ranges. A task writes to a name of its own and renames at the end;
    the manifest lists only files of tasks that ended well, so lost executors and
    repeated tasks do no harm.
    """
    source = docs.select(F.col(f"`{id_col}`").cast("bigint").alias("id"), F.col(f"`{text_col}`").cast("binary").alias("text"))
    ranged = source.repartitionByRange(partitions, "id") if partitions else source.repartitionByRange("id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer)
        part = TaskContext.get().partitionId()
        fs, root = open_fs(folder)
        fs.create_dir(root, recursive=True)
        name = f"tokens-{part:06d}-{uuid.uuid4().hex}"
        end = np.array([end_id], "<u4").tobytes()
        width = 2 if max(enc.vocab, end_id + 1) <= 1 << 16 else 4
        writer, n_docs, n_tokens, ids = None, 0, 0, []
        with fs.open_output_stream(f"{root}/{name}.tmp", compression=None) as out:
            writer = FrameWriter(out, width)
            for batch in batches:
                for doc, text in zip(batch["id"].to_pylist(), batch["text"], strict=True):
                    values = np.frombuffer(enc.packed(text.as_py()) + end, "<u4")
                    writer.add(-1 << 63 if doc is None else doc, values)
                    n_docs += 1
                    n_tokens += len(values)
            writer.close()
        if not n_docs:
            fs.delete_file(f"{root}/{name}.tmp")
            return
        fs.move(f"{root}/{name}.tmp", f"{root}/{name}")
        yield pa.RecordBatch.from_arrays([pa.array([part]), pa.array([f"{folder}/{name}"]), pa.array([n_docs]), pa.array([n_tokens])], ["part", "path", "n_docs", "n_tokens"])

    files = materialize(ranged.sortWithinPartitions("id", "text").mapInArrow(run, "part bigint, path string, n_docs bigint, n_tokens bigint"), "token-manifest")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row a file
    return files.withColumn("start", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)))


def read_token_files(manifest: DataFrame, digest: Callable[[np.ndarray], object] | None = None) -> DataFrame:
    """Rows read back from the files: doc_id, start (ids of all documents before),
    n_tokens and ids_crc32 (of the ids as little-endian unsigned 32-bit integers)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, start in zip(batch["path"].to_pylist(), batch["start"].to_pylist(), strict=True):
                fs, root = open_fs(path)
                with fs.open_input_file(root) as src:
                    reader = FrameReader(src)
                    ids, starts, ns, crcs = [], [], [], []
                    for i, row in enumerate(reader.docs.tolist()):
                        values = reader.read(i)
                        ids.append(None if row[0] == -1 << 63 else row[0])
                        starts.append(start)
                        ns.append(len(values))
                        crcs.append(zlib.crc32(values.astype("<u4").tobytes()))
                        start += len(values)
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(starts, pa.int64()), pa.array(ns, pa.int64()), pa.array(crcs, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    # Few rows, each worth a whole file of work: deal them out one by one.
    n = max(1, manifest.count())
    return manifest.select("path", "start").repartition(n).mapInArrow(run, "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint")


def read_documents(path: str, wanted: Iterable[int]) -> dict[int, np.ndarray]:
    """The ids of some documents of one file, decompressing their frames only."""
    fs, root = open_fs(path)
    with fs.open_input_file(root) as src:
        reader, want = FrameReader(src), set(wanted)
        return {row[0]: reader.read(i).copy() for i, row in enumerate(reader.docs.tolist()) if row[0] in want}


def round_trip(docs: DataFrame, tokenizer: str, *, end_id: int) -> DataFrame:
    """Write all documents to a fresh folder of the shared store and read them back."""
    folder = shared_path(docs.sparkSession, "tokens")
    manifest = write_token_files(docs, tokenizer, folder, end_id=end_id)
    return owning(read_token_files(manifest), manifest, folder)


def file_of(docs: list[tuple[int, list[int]]], width: int = 4, frame_bytes: int = 1 << 20) -> bytes:
    """A whole file in memory, for tests and small jobs."""
    out = io.BytesIO()
    w = FrameWriter(out, width, frame_bytes)
    for number, ids in docs:
        w.add(number, np.array(ids, "<u4"))
    w.close()
    return out.getvalue()
