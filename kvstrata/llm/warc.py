"""WARC archives in zstandard, with a shared dictionary.

An archive starts with a skippable frame that holds the dictionary, then has one
zstandard frame for each record. The reader loads the dictionary, decodes frame after
frame, and checks version line, header lines, lengths and digests of each record.

Defined results: a null html is an empty payload; a null url writes no target; records
with equal payloads of at least ``least`` bytes share one response, that with the
smallest page id, and the others revisit it; rows without a page id have records with ids
of their own, revisit the response if a page with an id has their payload, and are read
back with a null id; rows with one page id and one payload are written each, as responses
if that id is the smallest; an empty table gives no archives. A payload of any length is
held as a whole, one at a time.
"""

from __future__ import annotations

import hashlib
import re
import struct
import uuid
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kvstrata.llm.common import materialize, open_fs, owning, release, shared_path

DICTIONARY_FRAME, ZSTD_FRAME = 0x184D2A5D, 0xFD2FB528
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_URN = re.compile(r"<urn:x-page:(-?\d+)>")


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """One WARC record: a response with its payload, or a revisit without."""
    head = ["WARC/1.1", "WARC-Type: " + ("response" if refers_to is None else "revisit"), "WARC-Record-ID: " + (f"<urn:x-page:{page_id}>" if page_id is not None else uuid.uuid4().urn.join("<>")), "WARC-Date: 1970-01-01T00:00:00Z"]
    if url is not None:
        head.append("WARC-Target-URI: " + quote(url, safe="!#$%&'()*+,/:;=?@[]~-._"))
    head += [f"WARC-Payload-Digest: sha256:{digest}", f"X-Payload-Length: {len(payload)}"]
    if refers_to is not None:
        head += [f"WARC-Refers-To: <urn:x-page:{refers_to}>", f"WARC-Profile: {PROFILE}"]
        payload = b""
    head += ["Content-Type: text/html; charset=utf-8", f"Content-Length: {len(payload)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + payload + b"\r\n\r\n"


def parse(raw: bytes) -> dict:
    """Fields and payload of one record, checked."""
    head, mark, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not mark or lines[0] not in ("WARC/1.0", "WARC/1.1"):
        raise ValueError("no WARC record")
    fields: dict[str, str] = {}
    for line in lines[1:]:
        name, colon, value = line.partition(":")
        if not colon or not re.fullmatch(r"[!#$%&'*+.^_`|~0-9A-Za-z-]+", name):
            raise ValueError(f"bad header line {line!r}")
        if name.lower() in fields:
            raise ValueError(f"repeated header {name}")
        fields[name.lower()] = value.strip()
    missing = [x for x in ("warc-type", "warc-record-id", "warc-date", "content-length") if x not in fields]
    if missing or not fields["content-length"].isdigit():
        raise ValueError(f"headers missing or malformed: {missing}")
    length = int(fields["content-length"])
    if len(rest) != length + 4 or rest[length:] != b"\r\n\r\n":
        raise ValueError("content length and record disagree")
    payload = rest[:length]
    if fields["warc-type"] == "response" and "warc-payload-digest" in fields and fields["warc-payload-digest"] != "sha256:" + hashlib.sha256(payload).hexdigest():
        raise ValueError("payload digest differs")
    if fields["warc-type"] == "revisit" and ("warc-refers-to" not in fields or length):
        raise ValueError("malformed revisit")
    return fields | {"payload": payload}


def write_archive(out, records: Iterator[bytes], dictionary: bytes, level: int = 3) -> None:
    import zstandard

    d = zstandard.ZstdCompressionDict(dictionary) if dictionary else None
    if dictionary:
        out.write(struct.pack("<II", DICTIONARY_FRAME, len(dictionary)) + dictionary)
    z = zstandard.ZstdCompressor(level=level, dict_data=d, write_checksum=True, write_content_size=True)
    for r in records:
        out.write(z.compress(r))


def read_archive(src, chunk: int = 1 << 18) -> Iterator[dict]:
    """Records of an archive. At most one record and one chunk are held at a time."""
    import zstandard

    head = src.read(8)
    if not head:
        return
    d = None
    if len(head) == 8 and struct.unpack("<II", head)[0] == DICTIONARY_FRAME:
        size = struct.unpack("<II", head)[1]
        raw = src.read(size)
        if len(raw) != size:
            raise ValueError("dictionary is cut off")
        if raw[:4] == struct.pack("<I", ZSTD_FRAME):  # a dictionary may be packed itself
            raw = zstandard.ZstdDecompressor().decompressobj().decompress(raw)
        d, head = zstandard.ZstdCompressionDict(raw), b""
    z = zstandard.ZstdDecompressor(dict_data=d) if d else zstandard.ZstdDecompressor()
    rest = head or src.read(chunk)
    while rest:
        frame, parts = z.decompressobj(), []
        if len(rest) < 4:
            rest += src.read(chunk)
        if rest[:4] != struct.pack("<I", ZSTD_FRAME):
            raise ValueError("no zstandard frame where a record should start")
        while True:
            parts.append(frame.decompress(rest))
            if frame.eof:
                rest = frame.unused_data or src.read(chunk)
                break
            rest = src.read(chunk)
            if not rest:
                raise ValueError("the last frame is cut off")
        yield parse(b"".join(parts))


def train_dictionary(pages: DataFrame, *, html_col: str = "html", samples: int = 256, sample_chars: int = 8192, size: int = 1 << 16) -> bytes:
    """A dictionary trained on a bounded sample: the first ``sample_chars`` characters of
    the ``samples`` pages with the least hash, once each. Nothing if there is too little
    text. Only hashes are ranked; texts are fetched for those chosen."""
    import zstandard

    text = pages.select(F.substring(F.col(f"`{html_col}`"), 1, sample_chars).alias("t")).where(F.length("t") > 0).withColumn("h", F.xxhash64("t"))
    least = [r["h"] for r in text.select("h").distinct().orderBy("h").limit(samples).collect()]
    rows = text.where(F.col("h").isin(least)).groupBy("h").agg(F.min("t").alias("t")).orderBy("h").collect() if least else []
    try:
        return zstandard.train_dictionary(size, [r["t"].encode() for r in rows]).as_bytes()
    except zstandard.ZstdError:
        return b""


def plan_records(pages: DataFrame, *, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least: int = 100, salts: int = 32) -> DataFrame:
    """Page rows with payload, digest and refers_to (null: a response).

    Only (page id, digest) pairs are shuffled by digest, and the least id of a digest is
    aggregated before the shuffle, so a payload that a third of all pages share costs
    nothing more. The few digests that repeat are joined back to the pages' narrow rows,
    whose hot digests are spread over ``salts`` parts, and then to the pages by id.
    """
    page = pages.select(F.col(f"`{id_col}`").cast("bigint").alias("page_id"), F.col(f"`{url_col}`").cast("string").alias("url"), F.coalesce(F.col(f"`{html_col}`").cast("binary"), F.lit(b"")).alias("payload")).withColumn("digest", F.sha2("payload", 256))
    slim = materialize(page.where("page_id IS NOT NULL").select("page_id", F.unhex("digest").alias("d"), (F.octet_length("payload") >= least).alias("large")).where("large"), "warc-digests")
    firsts = slim.groupBy("d").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1").select("d", "first")
    salted = slim.withColumn("salt", F.pmod(F.xxhash64("page_id"), F.lit(salts)))
    wide = firsts.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1)))).withColumn("salt", F.col("salt").cast("bigint"))
    revisits = salted.join(wide, ["d", "salt"]).where("page_id <> first").select("page_id", F.lower(F.hex("d")).alias("digest"), F.col("first").alias("refers_to")).distinct()
    out = page.where("page_id IS NOT NULL").join(revisits, ["page_id", "digest"], "left").select("page_id", "url", "payload", "digest", "refers_to")
    # Pages without an id meet the first page with their payload, spread likewise.
    nameless = page.where("page_id IS NULL").withColumn("d", F.when(F.octet_length("payload") >= least, F.unhex("digest"))).withColumn("salt", F.pmod(F.xxhash64("url"), F.lit(salts)))
    firsts = slim.join(nameless.select("d").distinct(), "d", "left_semi").groupBy("d").agg(F.min("page_id").alias("refers_to")).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1)))).withColumn("salt", F.col("salt").cast("bigint"))
    return owning(out.unionByName(nameless.join(firsts, ["d", "salt"], "left").select("page_id", "url", "payload", "digest", "refers_to")), slim)


def write_archives(pages: DataFrame, folder: str, **columns) -> DataFrame:
    """Write all pages to archives in ``folder``, one a task. Returns the manifest (path,
    n_records), a table in the shared folder. Tasks write to names of their own; the
    manifest lists only the archives of tasks that ended well."""
    dictionary = pages.sparkSession.sparkContext.broadcast(train_dictionary(pages, html_col=columns.get("html_col", "html")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = open_fs(folder)
        fs.create_dir(root, recursive=True)
        name, n = f"pages-{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}.warc.zst", 0

        def records() -> Iterator[bytes]:
            nonlocal n
            for batch in batches:
                for i in range(batch.num_rows):
                    page_id, url, payload, digest, refers_to = (batch[c][i].as_py() for c in ("page_id", "url", "payload", "digest", "refers_to"))
                    n += 1
                    yield record(page_id, url, payload, digest, refers_to)

        with fs.open_output_stream(f"{root}/{name}.tmp", compression=None) as out:
            write_archive(out, records(), dictionary.value)
        if n:
            fs.move(f"{root}/{name}.tmp", f"{root}/{name}")
            yield pa.RecordBatch.from_arrays([pa.array([f"{folder}/{name}"]), pa.array([n])], ["path", "n_records"])
        else:
            fs.delete_file(f"{root}/{name}.tmp")

    plan = plan_records(pages, **columns)
    out = materialize(plan.mapInArrow(run, "path string, n_records bigint"), "warc-manifest")
    release(plan)
    return out


def read_archives(manifest: DataFrame, with_payload: bool = False) -> DataFrame:
    """The records of all archives: page_id, payload_bytes, payload_digest, record_type,
    refers_to, and with ``with_payload`` url and payload (null for revisits)."""
    schema = "page_id bigint, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint" + ", url string, payload binary" * with_payload

    def rows(path: str) -> Iterator[tuple]:
        fs, root = open_fs(path)
        with fs.open_input_stream(root, compression=None) as src:
            for f in read_archive(src):
                ref = f.get("warc-refers-to")
                own = _URN.fullmatch(f["warc-record-id"])
                row = (int(own[1]) if own else None, int(f["x-payload-length"]), f["warc-payload-digest"].removeprefix("sha256:"), f["warc-type"], int(_URN.fullmatch(ref)[1]) if ref else None)
                yield (*row, f.get("warc-target-uri"), f["payload"] if ref is None else None) if with_payload else row

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.binary()]
        names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url", "payload"]
        for batch in batches:
            for path in batch["path"].to_pylist():
                held: list[tuple] = []
                for row in rows(path):
                    held.append(row)
                    if len(held) >= 500:
                        yield _batch(held, types, names)
                        held = []
                if held:
                    yield _batch(held, types, names)

    n = max(1, manifest.count())
    return manifest.select("path").repartition(n).mapInArrow(run, schema)


def _batch(rows: list[tuple], types, names) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=False)], names[: len(rows[0])])


def round_trip(pages: DataFrame) -> DataFrame:
    """Write all pages to a fresh folder of the shared store and read them back."""
    folder = shared_path(pages.sparkSession, "warc")
    manifest = write_archives(pages, folder)
    return owning(read_archives(manifest), manifest, folder)
