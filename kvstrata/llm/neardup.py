"""Near-duplicate documents: MinHash signatures, joined by a multi-index Hamming search.

A document is its set of word shingles. Its signature is 80 minima of hash functions, cut
to 16 bits each (b-bit MinHash). The signature is split into 16 chunks of five symbols,
and each chunk's allowed error is enumerated: five keys, each leaving one symbol out. Two
signatures that differ in at most 31 symbols have, by the pigeonhole principle, a chunk
with at most one error, so they share a key: every pair within that signature distance
is found. (Texts with a similarity of 0.8 share no key with probability 5e-10.)

Pairs that share a key are candidates, and the full sets of 64-bit shingle hashes confirm
them. A bitmap of 1024 buckets, marked where a set has a hash, spares comparisons without
ever losing a link: a bucket that only one of two sets marks holds a shingle that the other
hasn't, which bounds their intersection from above. Sets that are equal count once, from
the start.

Within a bucket of documents with one key, not all pairs are made. In a few rounds each
document meets the bucket's first member and the nearest ones that it isn't yet connected
with; confirmed links join components. Then all remaining candidates between *different*
components are tested: the sets of two components with a candidate between them meet in
tasks, in blocks of bounded size, and only confirmed links leave a task. No link that
matters is lost: two candidates are left untested only if they are connected.

Defined results: a null or wordless text has an empty set and is linked with nothing; a
text with fewer words than a shingle is one shingle of all its words; rows that share an
id are one node, linked by any of their texts; rows without an id are linked with
nothing and kept, with a null component; an empty table gives no rows. A very long text's
set is held as a whole, and sets meet in tasks by their bytes. Only the id and text columns
are read, so extra columns may have any names. ``drop_near_duplicates`` tells rows apart
by numbers of its own, so repeated rows and rows without an id are links as any others.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kvstrata.llm.common import hash_texts, materialize, mix, owning, release, window_hashes

CHUNKS, CHUNK = 16, 5  # symbols: 80
SYMBOLS, BITS = CHUNKS * CHUNK, 1024
_RNG = np.random.default_rng(20240229)
_A = _RNG.integers(1, 1 << 63, SYMBOLS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_B = _RNG.integers(0, 1 << 63, SYMBOLS, dtype=np.uint64)


def shingle_sets(texts: list[bytes | None], size: int) -> Iterator[np.ndarray]:
    """The sorted, distinct 64-bit hashes of each text's word shingles."""
    for lo in range(0, len(texts), 200):
        h, sizes = hash_texts(texts[lo : lo + 200], lower=True)
        at = 0
        for n in sizes.tolist():
            yield np.unique(window_hashes(h[at : at + n], min(size, n))) if n else np.zeros(0, np.uint64)
            at += n


def signature(items: np.ndarray) -> bytes:
    """80 symbols of 16 bits."""
    low = np.full(SYMBOLS, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(items), 1024):
        np.minimum(low, (items[None, at : at + 1024] * _A[:, None] + _B[:, None]).min(1), out=low)
    return (mix(low) & np.uint64(0xFFFF)).astype("<u2").tobytes()


def sketch(items: np.ndarray) -> bytes:
    """1024 bits: those of the buckets that the set has a hash in."""
    bits = np.zeros(BITS, np.uint8)
    bits[(items >> np.uint64(54)).astype(np.int64)] = 1
    return np.packbits(bits).tobytes()


def apart(a: np.ndarray, others: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """How many items of a set at least are missing in each of the others, and theirs in it."""
    count = lambda x: np.bitwise_count(x).sum(1, dtype=np.int64)
    return count(a & ~others), count(others & ~a)


def may_link(n: int, others: np.ndarray, lacks: np.ndarray, lacked: np.ndarray, similarity: int) -> np.ndarray:
    """Whether sets of ``n`` items and of ``others`` may be similar enough: exact, never no
    where they are."""
    both = np.minimum(n - lacks, others - lacked)
    return 100 * both >= similarity * (n + others - both)


def keys(symbols: np.ndarray) -> np.ndarray:
    """80 keys for each row of 80 symbols: of each chunk, five with one symbol left out."""
    s = symbols.astype(np.uint64).reshape(len(symbols), CHUNKS, CHUNK)
    out = np.empty((len(s), CHUNKS, CHUNK), np.uint64)
    for gone in range(CHUNK):
        h = np.arange(CHUNKS, dtype=np.uint64)[None, :] * np.uint64(CHUNK) + np.uint64(gone)
        h = np.repeat(h, len(s), 0)
        rest = [i for i in range(CHUNK) if i != gone]
        packed = sum(s[:, :, i] << np.uint64(16 * k) for k, i in enumerate(rest))
        out[:, :, gone] = mix(mix(h + np.uint64(0x9E3779B97F4A7C15)) ^ packed)
    return out.reshape(len(s), -1)


def _signatures(docs: DataFrame, size: int) -> DataFrame:
    """id, n (shingles), h1 and h2 (of the whole set) and sig, by row of (id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from xxhash import xxh3_128_digest

        for batch in batches:
            n, h, sig = [], [], []
            for items in shingle_sets(batch["text"].to_pylist(), size):
                n.append(len(items))
                h.append(xxh3_128_digest(items.tobytes()))
                sig.append(signature(items))
            two = np.frombuffer(b"".join(h), "<i8").reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([batch["id"], pa.array(n, pa.int64()), pa.array(two[:, 0].copy()), pa.array(two[:, 1].copy()), pa.array(sig, pa.binary())], ["id", "n", "h1", "h2", "sig"])

    return docs.mapInArrow(run, "id bigint, n bigint, h1 bigint, h2 bigint, sig binary")


def _buckets(reps: DataFrame, chunk: int) -> DataFrame:
    """key, rep, anchor (the bucket's least rep) and block (running number of each
    ``chunk`` members), of keys that two or more documents share. Rows stream by in
    order of their keys, with one row of memory."""

    def explode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 1000):
                part = batch.slice(lo, 1000)
                symbols = np.frombuffer(b"".join(part["sig"].to_pylist()), "<u2").reshape(part.num_rows, -1)
                k = keys(symbols)
                yield pa.RecordBatch.from_arrays([pa.array(k.reshape(-1).view(np.int64)), pa.array(np.repeat(part["rep"].to_numpy(zero_copy_only=False), k.shape[1]))], ["key", "rep"])

    def share(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = anchor = None
        count = 0  # members of the open bucket seen so far
        for batch in batches:
            k, r = batch["key"].to_numpy(), batch["rep"].to_numpy()
            if not len(k):
                continue
            start = np.flatnonzero(np.r_[True, k[1:] != k[:-1]])
            sizes = np.diff(np.r_[start, len(k)])
            rank = np.arange(len(k)) - np.repeat(start, sizes)
            first = np.repeat(r[start], sizes)
            total = np.repeat(sizes, sizes)
            ks, rs, anchors, ranks = [], [], [], []
            if key is not None and k[0] == key:
                n = sizes[0]
                rank[:n] += count
                first[:n] = anchor
                total[:n] += count
                if count == 1:  # the held row turns out to have company
                    ks, rs, anchors, ranks = [[key]], [[anchor]], [[anchor]], [[0]]
            keep = total > 1
            ks.append(k[keep])
            rs.append(r[keep])
            anchors.append(first[keep])
            ranks.append(rank[keep])
            key, anchor, count = k[-1], first[-1], int(rank[-1]) + 1
            cols = [np.concatenate(x).astype(np.int64) for x in (ks, rs, anchors, ranks)]
            if len(cols[0]):
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in (*cols[:3], cols[3] // chunk)], ["key", "rep", "anchor", "block"])

    exploded = reps.select("rep", "sig").mapInArrow(explode, "key bigint, rep bigint")
    return exploded.repartition("key").sortWithinPartitions("key", "rep").mapInArrow(share, "key bigint, rep bigint, anchor bigint, block bigint")


_ROW = ["key", "other", "rep", "anchor", "n", "sketch", "label"]


def _groups(batches: Iterator[pa.RecordBatch], limit: int | None, names: list[str] = _ROW) -> Iterator[list[np.ndarray]]:
    """Columns of each group of equal (key, other), in order. ``limit``: longer groups
    come in pieces; without it, groups are known to be short."""
    held: list[list[np.ndarray]] = []
    size = 0

    def take():
        return [np.concatenate(c) for c in zip(*held, strict=True)]

    for batch in batches:
        if not batch.num_rows:
            continue
        cols = [_matrix(batch[c], _BINARY[c]) if c in _BINARY else batch[c].to_numpy() for c in names]
        k, o = cols[0], cols[1]
        start = np.flatnonzero(np.r_[True, (k[1:] != k[:-1]) | (o[1:] != o[:-1])])
        for a, b in zip(start, np.r_[start[1:], len(k)], strict=True):
            part = [c[a:b] for c in cols]
            if held and (held[-1][0][0] != k[a] or held[-1][1][0] != o[a] or (limit and size >= limit)):
                yield take()
                held, size = [], 0
            held.append(part)
            size += b - a
    if held:
        yield take()


_BINARY = {"sketch": "<u8", "sig": "<u2"}


def _matrix(column, kind: str) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(len(column), -1)


def _near(rows: DataFrame, similarity: int, limit: int, most: int) -> DataFrame:
    """x, y and distance: for each x of the sorted ``rows`` of buckets the first member
    and the ``most`` nearest ones with other labels."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        count = 0

        def batch_of():
            cols = [np.concatenate(c) for c in zip(*out, strict=True)]
            return pa.RecordBatch.from_arrays([pa.array(c.astype(np.int64)) for c in cols], ["x", "y", "distance"])

        for _, _, rep, anchor, n, sk, label in _groups(batches, limit):
            if (label == label[0]).all():
                continue
            first = int(np.searchsorted(rep, anchor[0])) if rep[0] <= anchor[0] else -1
            for i in range(len(rep)):
                j = np.flatnonzero((label != label[i]) & (100 * np.minimum(n, n[i]) >= similarity * np.maximum(n, n[i])))
                if not len(j):
                    continue
                lacks, lacked = apart(sk[i], sk[j])
                ok, d = may_link(int(n[i]), n[j], lacks, lacked, similarity), lacks + lacked
                pick = d.argsort(kind="stable")[:most] if most < len(j) else np.arange(len(j))
                if first >= 0 and label[first] != label[i]:
                    pick = np.union1d(pick, np.flatnonzero(j == first))
                pick = pick[ok[pick]]
                if len(pick):
                    out.append((np.full(len(pick), rep[i]), rep[j[pick]], d[pick]))
                    count += len(pick)
                if count >= 20_000:
                    yield batch_of()
                    out, count = [], 0
        if out:
            yield batch_of()

    return rows.mapInArrow(run, "x bigint, y bigint, distance bigint")


def _open_pairs(rows: DataFrame, similarity: int) -> DataFrame:
    """a and b, a < b: labels of components with a candidate between them. ``rows`` are
    the sorted buckets, or pairs of blocks of long ones. Two documents meet in each bucket
    that they share; the first of their shared keys alone reports them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, _, rep, _, n, sk, label, sig in _groups(batches, None, [*_ROW, "sig"]):
            if (label == label[0]).all():
                continue
            found, all_keys = [], None
            for i in range(len(rep) - 1):
                j = i + 1 + np.flatnonzero((label[i + 1 :] != label[i]) & (100 * np.minimum(n[i + 1 :], n[i]) >= similarity * np.maximum(n[i + 1 :], n[i])))
                if len(j):
                    j = j[may_link(int(n[i]), n[j], *apart(sk[i], sk[j]), similarity)]
                if len(j):
                    if all_keys is None:
                        all_keys = keys(sig).view(np.int64)
                    first = (all_keys[j] == all_keys[i]).argmax(1)
                    j = j[all_keys[i][first] == key[0]]
                if len(j):
                    other = np.unique(label[j])
                    found.append(np.stack([np.minimum(other, label[i]), np.maximum(other, label[i])], 1))
            if found:
                found = np.unique(np.concatenate(found), axis=0)
                yield pa.RecordBatch.from_arrays([pa.array(found[:, 0].copy()), pa.array(found[:, 1].copy())], ["a", "b"])

    return rows.mapInArrow(run, "a bigint, b bigint").distinct()


def _similar(a: np.ndarray, b: np.ndarray, similarity: int) -> bool:
    """Whether ``100 * intersection >= similarity * union`` for two sorted sets."""
    if len(a) > len(b):
        a, b = b, a
    at = np.searchsorted(b, a)
    at[at == len(b)] = 0
    both = int((b[at] == a).sum())
    return 100 * both >= similarity * (len(a) + len(b) - both)


def _confirm(pairs: DataFrame, sets: DataFrame, similarity: int, block: int) -> DataFrame:
    """The pairs (x, y), a table, whose full sets are similar enough. ``sets`` lie in buckets
    by rep. Pairs of one x, which may be many, meet its set in parts of about ``block``; only
    pairs, and the sets that meet, are shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ok = [_similar(np.frombuffer(a.as_buffer(), np.uint64), np.frombuffer(b.as_buffer(), np.uint64), similarity) for a, b in zip(batch["sx"], batch["sy"], strict=True)]
            keep = pa.array(ok, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch["x"].filter(keep), batch["y"].filter(keep)], ["x", "y"])

    hot = pairs.groupBy("x").agg(F.ceil(F.count("*") / block).alias("parts")).where("parts > 1")
    dealt = _join_salted(pairs, hot, ["x"], "y").select("x", "y", F.coalesce(F.pmod(F.xxhash64("y"), "parts"), F.lit(0)).alias("part"))
    with_y = dealt.join(sets.select(F.col("rep").alias("y"), F.col("items").alias("sy")), "y")
    with_x = dealt.select("x", "part").distinct().join(sets.select(F.col("rep").alias("x"), F.col("items").alias("sx")), "x")
    return with_y.join(with_x, ["x", "part"]).select("x", "y", "sx", "sy").mapInArrow(run, "x bigint, y bigint")


def _confirm_blocks(open_: DataFrame, labels: DataFrame, sets: DataFrame, similarity: int, block: int) -> DataFrame:
    """Links (x, y) between the components of each pair (a, b) of ``open_``.

    The larger component of a pair is the host. Its members are dealt to blocks of about
    ``block`` shingles; the other's members go to each of them and stream by, and meet every
    member of the block. One link for each guest component and block will do."""
    sizes = labels.groupBy("label").agg(F.sum("n").alias("size"))
    sized = open_.join(sizes.select(F.col("label").alias("a"), F.col("size").alias("na")), "a").join(sizes.select(F.col("label").alias("b"), F.col("size").alias("nb")), "b")
    swap = F.col("nb") > F.col("na")
    plan = sized.select(F.when(swap, F.col("b")).otherwise(F.col("a")).alias("host"), F.when(swap, F.col("a")).otherwise(F.col("b")).alias("guest"), F.ceil(F.greatest("na", "nb") / block).cast("bigint").alias("blocks"))
    hosts = plan.groupBy("host").agg(F.max("blocks").alias("blocks"))
    inside = labels.join(hosts, F.col("label") == F.col("host")).select("host", F.pmod(F.xxhash64("rep"), F.col("blocks")).alias("part"), F.lit(0).alias("side"), "label", "rep")
    guests = labels.join(plan, F.col("label") == F.col("guest")).select("host", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("blocks") - 1)).alias("part"), F.lit(1).alias("side"), "label", "rep")
    rows = inside.unionByName(guests).join(sets.select("rep", "items", "sketch"), "rep")
    cols = ["host", "part", "side", "label", "rep", "sketch", "items"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held, sk, counts, done = None, [], None, None, None
        for batch in batches:
            xs, ys = [], []
            for host, part, side, label, rep, sketch_, items in zip(*(batch[c] if c == "items" else batch[c].to_pylist() for c in cols), strict=True):
                if key != (host, part):
                    key, held, sk, counts, done = (host, part), [], None, None, None
                if not side:
                    held.append((rep, sketch_, np.frombuffer(items.as_py(), np.uint64)))
                    continue
                if done == label or not held:
                    continue
                if sk is None:
                    sk = np.frombuffer(b"".join(x[1] for x in held), "<u8").reshape(len(held), -1)
                    counts = np.array([len(x[2]) for x in held])
                mine = np.frombuffer(items.as_buffer(), np.uint64)
                lacks, lacked = apart(np.frombuffer(sketch_, "<u8"), sk)
                near, d = np.flatnonzero(may_link(len(mine), counts, lacks, lacked, similarity)), lacks + lacked
                for i in near[d[near].argsort(kind="stable")].tolist():
                    if _similar(held[i][2], mine, similarity):
                        xs.append(held[i][0])
                        ys.append(rep)
                        done = label
                        break
            yield pa.RecordBatch.from_arrays([pa.array(xs, pa.int64()), pa.array(ys, pa.int64())], ["x", "y"])

    return rows.select(*cols).repartition("host", "part").sortWithinPartitions("host", "part", "side", "label").mapInArrow(run, "x bigint, y bigint")


def components(edges: DataFrame) -> DataFrame:
    """node and root (the least node that it is connected with) for the nodes of
    ``edges`` (x, y) that aren't roots themselves.

    Rounds of contraction: each node that isn't least among its neighbours points to the
    least one, pointers are doubled until they end at roots, and edges are mapped to
    roots. Each round at least halves the nodes that still have edges. Minima are
    aggregated before shuffles; joins may split hot nodes. All tables are narrow and
    kept in the shared folder."""
    found = None
    edges = materialize(edges.select("x", "y").where("x <> y").distinct(), "edges")
    while not edges.isEmpty():
        both = edges.unionByName(edges.select(F.col("y").alias("x"), F.col("x").alias("y")))
        up = materialize(both.groupBy("x").agg(F.min("y").alias("y")).where("y < x").select(F.col("x").alias("node"), F.col("y").alias("root")), "pointers")
        while True:
            step = up.select(F.col("node").alias("root"), F.col("root").alias("next"))
            doubled = materialize(up.join(step, "root", "left").select("node", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "pointers")
            release(up)
            up, done = doubled, doubled.where("moved").isEmpty()
            if done:
                break
        up = _kept(up, up.select("node", "root"))
        new = _mapped(_mapped(edges, up, "x"), up, "y").where("x <> y").distinct()
        old, edges = edges, materialize(new, "edges")
        release(old)
        if found is None:
            found = up
        else:
            merged = materialize(_mapped(found, up, "root").unionByName(up), "roots")
            release(found, up)
            found = merged
    release(edges)
    return found if found is not None else edges.select(F.col("x").alias("node"), F.col("y").alias("root")).where("false")


def _kept(table: DataFrame, view: DataFrame) -> DataFrame:
    view._kvstrata_path = table._kvstrata_path
    return view


def _mapped(df: DataFrame, roots: DataFrame, col: str) -> DataFrame:
    """``df`` with the values of ``col`` replaced by their roots, where they have one."""
    return df.join(roots.select(F.col("node").alias(col), F.col("root").alias("__root")), col, "left").withColumn(col, F.coalesce("__root", col)).select(*df.columns)


def _join_salted(left: DataFrame, right: DataFrame, on: list[str], spread_by: str, salts: int = 16) -> DataFrame:
    """Left join to a smaller side whose keys may be hot on the left: left rows of a key
    are spread over ``salts`` parts, and the right side is repeated for each."""
    a = left.withColumn("__salt", F.pmod(F.xxhash64(spread_by), F.lit(salts)).cast("int"))
    b = right.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return a.join(b, [*on, "__salt"], "left").drop("__salt")


def _several(sig: DataFrame) -> DataFrame:
    """id, h1, h2 and n of rows whose id has texts of several classes."""
    rows = sig.where("id IS NOT NULL").select("id", "h1", "h2", "n")
    of = F.struct("h1", "h2")
    ids = rows.groupBy("id").agg(F.min(of).alias("lo"), F.max(of).alias("hi")).where("lo <> hi").select("id")
    return rows.join(ids, "id", "left_semi").distinct()


def near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", shingle: int = 2, similarity: int = 80, rounds: int = 2, chunk: int = 4096, block: int = 1000, block_items: int = 1 << 18) -> DataFrame:
    """Per row with its id: n_shingles, component_id (least id that it is connected with)
    and kept (whether that is its own). Runs at once; the result is read from tables."""
    source = docs.select(F.col(f"`{id_col}`").cast("bigint").alias("id"), F.col(f"`{text_col}`").cast("binary").alias("text"))
    sig = materialize(_signatures(source, shingle), "signatures")
    known = sig.where("id IS NOT NULL AND n > 0")
    classes = materialize(known.groupBy("h1", "h2").agg(F.min(F.struct("id", "n", "sig")).alias("r"), F.count("*").alias("copies")).select("h1", "h2", "copies", F.col("r.id").alias("rep"), "r.n", "r.sig"), "classes")
    members = materialize(_buckets(classes, chunk), "buckets")

    def to_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            items = list(shingle_sets(batch["text"].to_pylist(), shingle))
            yield pa.RecordBatch.from_arrays([batch["id"], pa.array([len(x) for x in items], pa.int64()), pa.array([sketch(x) for x in items], pa.binary()), pa.array([signature(x) for x in items], pa.binary()), pa.array([x.tobytes() for x in items], pa.binary())], ["rep", "n", "sketch", "sig", "items"])

    wanted = source.join(members.select(F.col("rep").alias("id")).distinct(), "id", "left_semi")
    sets = materialize(wanted.mapInArrow(to_sets, "rep bigint, n bigint, sketch binary, sig binary, items binary").where("n > 0"), "sets", by="rep")
    info = materialize(sets.select("rep", "n", "sketch", "sig"), "members")
    labels = materialize(info.select("rep", F.col("rep").alias("label")).distinct(), "labels")
    for number in range(rounds + 1):
        rows = members.join(info, "rep").join(labels, "rep")
        if number < rounds:
            rows = rows.withColumn("other", F.lit(0).cast("bigint")).select(*_ROW).repartition("key").sortWithinPartitions("key", "rep")
            near = _near(rows, similarity, chunk, number + 1).groupBy("x").agg(F.slice(F.array_sort(F.collect_set(F.struct("distance", "y"))), 1, number + 1).alias("a"), F.min("y").alias("b"))
            pairs = near.select("x", F.explode(F.array_distinct(F.concat(F.col("a.y") if number else F.array(), F.array("b")))).alias("y")).select(F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y")).distinct()
            pairs = materialize(pairs, "pairs")
            links = materialize(_confirm(pairs, sets, similarity, block), "links")
            release(pairs)
        else:
            # Only buckets that still hold several components; long ones as pairs of blocks.
            several = rows.groupBy("key").agg(F.min("label").alias("lo"), F.max("label").alias("hi"), F.max("block").alias("last")).where("lo <> hi").select("key", "last")
            rows = rows.join(several, "key").withColumn("b", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("last")))).withColumn("other", F.least("block", "b") * (F.col("last") + 1) + F.greatest("block", "b"))
            rows = rows.select(*_ROW, "sig").repartition("key", "other").sortWithinPartitions("key", "other", "rep")
            open_ = materialize(_open_pairs(rows, similarity), "open")
            links = materialize(_confirm_blocks(open_, labels.join(info.select("rep", "n"), "rep"), sets, similarity, block_items), "links")
            release(open_)
        of = labels.select(F.col("rep").alias("node"), F.col("label").alias("root"))
        roots = components(_mapped(_mapped(links, of, "x"), of, "y"))
        old, labels = labels, materialize(_mapped(labels, roots, "label"), "labels")
        release(old, links, roots)
    release(sets, members, info)
    rooted = classes.select("h1", "h2", "rep", "copies").join(labels, "rep", "left").withColumn("root", F.coalesce("label", "rep"))
    several = materialize(_several(sig), "several")
    tied = None
    if not several.isEmpty():
        ties = materialize(several.where("n > 0").join(rooted, ["h1", "h2"]).select("id", "root").distinct(), "ties")
        least = ties.groupBy("id").agg(F.min("root").alias("x"))
        ends = components(ties.join(least, "id").select("x", F.col("root").alias("y")))
        rooted = _mapped(rooted, ends, "root")
        tied = _mapped(least.withColumnRenamed("x", "tied"), ends, "tied")
    moved = rooted.where("root <> rep OR copies > 1").select("h1", "h2", "root")
    out = _join_salted(sig.select("id", "n", F.when(F.col("n") > 0, F.col("h1")).alias("h1"), "h2"), moved, ["h1", "h2"], "id")
    if tied is not None:  # also for rows without words
        out = out.join(tied, "id", "left").withColumn("root", F.coalesce("tied", "root"))
    out = out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.when(F.col("id").isNotNull(), F.coalesce("root", "id")).alias("component_id"))
    out = materialize(out.withColumn("kept", F.coalesce(F.col(id_col) == F.col("component_id"), F.lit(True))), "components")
    release(sig, classes, labels, several)
    if tied is not None:
        release(ties, ends)
    return out


def drop_near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, similarity: int = 80) -> DataFrame:
    """``docs`` with one row of each group, that with the least id (nulls last; of repeated
    rows, one). Columns unchanged, whatever their names. Rows are numbered in a table, and
    shuffled once by number."""
    names = [f"__c{i}" for i in range(len(docs.columns))]
    of = dict(zip(docs.columns, names, strict=True))
    rows = materialize(docs.toDF(*names).withColumn("__row", F.monotonically_increasing_id()), "numbered")
    found = near_duplicates(rows, id_col="__row", text_col=of[text_col], shingle=shingle, similarity=similarity)
    several = found.groupBy("component_id").agg(F.count("*").alias("n")).where("n > 1")
    grouped = _join_salted(found.select("component_id", "__row"), several, ["component_id"], "__row").where("n IS NOT NULL")
    grouped = materialize(grouped.select("component_id", "__row").join(rows.select("__row", F.col(of[id_col]).alias("id")), "__row"), "groups")
    first = grouped.groupBy("component_id").agg(F.min(F.struct(F.col("id").isNull(), "id", "__row")).alias("first")).select("component_id", F.col("first.__row").alias("first"))
    gone = materialize(_join_salted(grouped, first, ["component_id"], "__row").where(F.col("__row") != F.col("first")).select("__row"), "copies")
    kept = rows.join(gone, "__row", "left_anti").select(*[F.col(n).alias(c) for n, c in zip(names, docs.columns, strict=True)])
    release(found, grouped)
    return owning(kept, rows, gone)
