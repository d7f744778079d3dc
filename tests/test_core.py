"""Fixtures of versions, overlays, policies, logs and names, and random models."""

import random

import pytest
from pyspark.sql import functions as F

from kvstrata import errors
from kvstrata.functions import bytesfn as b
from kvstrata.operators import compaction, reads
from kvstrata.operators import versioning as v
from kvstrata.plans import policies as p
from kvstrata.schema import WAL, BinarySize, LeveledStrategy, StoreId, TieredStrategy
from kvstrata.sources import manifest as mf
from kvstrata.sources import runs, wal

MIB = 1 << 20


def log(spark, *rows):
    """Rows like ("a", 10, "x") or ("a", 20, None) for a deletion."""
    return runs.from_rows(spark, [("s", k.encode(), t, "DEL" if x is None else "PUT", (x or "").encode()) for k, t, x in rows])


def seen(df):
    return sorted((r.key.decode(), r.tsn, None if r.op == "DEL" else r.value.decode()) for r in df.collect())


def test_time_travel(spark):
    rows = []
    for i in range(20):
        rows.append((f"key#{i:06d}", 1, "a"))
        if i % 3 == 0:
            rows.append((f"key#{i:06d}", 2, "b"))
        if i % 5 == 0:
            rows.append((f"key#{i:06d}", 3, None))
        if i % 7 == 0:
            rows.append((f"key#{i:06d}", 4, "c"))
    c = log(spark, *rows)
    sizes = {t: v.as_of(c, t).count() for t in (0, 1, 2, 3, 4)}
    assert sizes == {0: 0, 1: 20, 2: 20, 3: 16, 4: 17}
    assert {int(k[4:]) for k, _, x in seen(v.as_of(c, 4)) if x == "b"} == {3, 6, 9, 12, 18}
    many = v.time_travel(c, spark.createDataFrame([(t,) for t in range(5)], "snapshot bigint"))
    assert {r.snapshot: r["count"] for r in many.groupBy("snapshot").count().collect()} == {k: n for k, n in sizes.items() if n}


def test_history(spark):
    c = log(spark, ("a", 10, "a1"), ("a", 20, None), ("a", 30, "a3"), ("b", 10, "b1"), ("b", 25, "b2"), ("b", 30, "b3"), ("c", 10, "c1"), ("d", 30, "d1"))
    assert [(k, t) for k, t, _ in seen(v.drop_history(c, 25))] == [("a", 30), ("b", 25), ("b", 30), ("c", 10), ("d", 30)]
    assert [(k, t) for k, t, _ in seen(v.drop_history_safe(c, 25))] == [("a", 20), ("a", 30), ("b", 25), ("b", 30), ("c", 10), ("d", 30)]
    c = log(spark, *[("hello", t, str(t)) for t in (100, 200, 300)], ("hello", 350, None), ("hello", 600, "6"), ("foo", 1, "bar"), ("bar", 1, "baz"), ("bar", 2, None))
    assert seen(v.latest(c)) == [("bar", 2, None), ("foo", 1, "bar"), ("hello", 600, "6")]


def test_compaction_never_changes_what_open_readers_see(spark):
    r = random.Random(1)
    rows, last = [], {}
    for t in range(1, 200):
        k = f"k{r.randrange(15)}"
        rows.append((k, t, None if r.random() < 0.3 else str(t)))
    c = log(spark, *rows)
    for oldest in (1, 60, 150, 500):
        for keep in (True, False):
            out = compaction.compact(c.unionByName(c), oldest, keep)
            for t in (oldest, oldest + 20, 999):
                assert seen(v.as_of(out, t)) == seen(v.as_of(c, t))
    assert seen(compaction.compact(c, None, False)) == seen(v.as_of(c))
    assert last == {}


def test_overlays_against_a_model(spark):
    r = random.Random(2)
    data, want = [], {}
    for case in range(60):
        for layer in range(r.randint(1, 4)):
            for k in "bdfhjlnprt":
                if r.random() < 0.5:
                    x = None if layer and r.random() < 0.5 else f"{k}{layer}"
                    data.append((layer, case, k, x))
                    want[case, k] = x
    df = spark.createDataFrame(data, "layer int, case int, key string, value string")
    out = v.overlay([df.where(F.col("layer") == i) for i in range(4)], ["case", "key"])
    assert {(x.case, x.key): x.value for x in out.collect()} == {k: x for k, x in want.items() if x is not None}


def test_seeks_against_a_model(spark):
    r = random.Random(3)
    keys = sorted({r.randrange(500) for _ in range(120)})
    probes = [r.randrange(-5, 510) for _ in range(200)]
    rows = spark.createDataFrame([(k,) for k in keys], "key bigint").repartition(3)
    asked = spark.createDataFrame([(x,) for x in probes], "probe bigint")
    want = {"ceiling": lambda q: min((k for k in keys if k >= q), default=None), "higher": lambda q: min((k for k in keys if k > q), default=None), "floor": lambda q: max((k for k in keys if k <= q), default=None), "lower": lambda q: max((k for k in keys if k < q), default=None)}
    for mode, f in want.items():
        got = {x.probe: x.found for x in reads.seek_many(rows, asked, mode, parts=5).collect()}
        assert got == {q: f(q) for q in probes}
        one = reads.seek(rows, 250, mode).first()
        assert (one and one.key) == f(250)
    assert reads.seek_many(rows.limit(0), asked, "floor").where("found IS NOT NULL").count() == 0


def test_order_check(spark):
    rows = spark.createDataFrame([(1, 1), (2, 5), (3, 5)], "__pos int, x int")
    assert v.check_ordered(rows, ["x"], strict=False).count() == 3
    with pytest.raises(Exception, match="out of order"):
        v.check_ordered(rows, ["x"]).collect()


def test_byte_functions(spark):
    numbers = [0, 1, -1, 127, -128, 1 << 40, -(1 << 40), (1 << 63) - 1, -(1 << 63)]
    df = spark.createDataFrame([(x,) for x in numbers], "x bigint").select("x", b.stable_long(F.col("x")).alias("s"))
    got = df.withColumn("y", b.long_from_stable(F.col("s"))).withColumn("l", b.long_from_little_endian(b.little_endian_long(F.col("x")))).collect()
    assert all(r.x == r.y == r.l and bytes(r.s) == (r.x + (1 << 63)).to_bytes(8, "big") for r in got)
    small = [0, 5, -5, (1 << 31) - 1, -(1 << 31)]
    got = spark.createDataFrame([(x,) for x in small], "x int").select("x", b.int_from_stable(b.stable_int(F.col("x"))).alias("a"), b.int_from_little_endian(b.little_endian_int(F.col("x"))).alias("b")).collect()
    assert all(r.x == r.a == r.b for r in got)
    assert b.successor(b"a\xff\xff") == b"b" and b.successor(b"\xff") is None and b.successor(b"") is None
    raw = spark.createDataFrame([(b"abcabc",), (b"",), (b"\xff\x01",)], "x binary")
    r = raw.select(b.index_of(F.col("x"), 98), b.last_index_of(F.col("x"), 98), b.contains_byte(F.col("x"), 1), b.byte_at(F.col("x"), 1), b.hex_lower(F.col("x"))).collect()
    assert [tuple(x) for x in r] == [(1, 4, False, 98, "616263616263"), (-1, -1, False, None, ""), (-1, -1, True, 1, "ff01")]
    c = log(spark, ("foo", 10000, "bar"), ("hello", 1240, ""), ("x", 1, None))
    packed = c.withColumn("p", b.pack_command(F.col("key"), F.col("tsn"), F.col("op"), F.col("value")))
    for r in packed.select("*", b.unpack_command(F.col("p")).alias("u"), b.command_size(F.col("key"), F.col("op"), F.col("value")).alias("n")).collect():
        assert (r.u.key, r.u.tsn, r.u.op, r.u.value) == (r.key, r.tsn, r.op, r.value) and r.n == len(r.p)


def test_names_and_sizes():
    for ok in ("a", "a/b-c_1", "_sys/x", "com10"):
        StoreId(ok)
    for bad in ("", "A", "a b", "a//b", "/a", "con", "a/lpt1", "a/"):
        with pytest.raises(ValueError):
            StoreId(bad)
    assert StoreId("a").nests_with(StoreId("a/b")) and not StoreId("a/b").nests_with(StoreId("a/bc"))
    assert BinarySize.of(1.5, "KiB").bytes == 1536 and BinarySize.parse("8 MiB") == BinarySize.of(8, "MiB") and str(BinarySize(1536)) == "1.50 KiB"
    with pytest.raises(ValueError):
        BinarySize(-1)
    assert BinarySize.sum([BinarySize(1), BinarySize(2)]) + BinarySize(3) == BinarySize(6)


def test_leveled_sizes():
    gib = 1 << 30
    assert p.target_sizes([0, 0, 0, 0, 0, 300 * MIB], 6, 100 * MIB, 10) == [0, 0, 0, 0, 30 * MIB, 300 * MIB]
    assert p.target_sizes([0, 300 * MIB], 6, 100 * MIB, 10)[-2:] == [30 * MIB, 300 * MIB]
    assert p.target_sizes([30 * gib], 6, 100 * MIB, 10) == [0, 0, int(0.03 * gib), int(0.3 * gib), 3 * gib, 30 * gib]
    ratios = p.size_ratios([10, 1, 0.05, 0.8, 3, 30], [0, 0, 0.03, 0.3, 3, 30])
    assert [int(x * 100) / 100 for x in ratios] == [0, 0, 1.66, 2.66, 0, 0] and p.worst_level(ratios) == 3
    assert p.worst_level([0.0]) is None


def test_leveled_merges():
    f = lambda i, level, lo, hi, size=0, head=1, total=1: p.File(i, level, size, lo.encode(), hi.encode(), 0, 0, head, total)
    s = LeveledStrategy(max_levels=3, level0_trigger=2, base_bytes=100 * MIB)
    files = [f(i, 0, "e", "t") for i in range(3)] + [f(3, 1, "a", "c", 100 * MIB), f(4, 1, "d", "g", 100 * MIB), f(5, 1, "h", "r", 100 * MIB), f(6, 1, "s", "z", 100 * MIB), f(7, 2, "a", "z", 300 * MIB)]
    m = p.leveled(files, s)
    assert (set(m.files), m.keep_tombstones, m.trigger) == ({0, 1, 2, 4, 5, 6}, True, "LEVELED_LEVEL0")
    files = [f(0, 0, "e", "t")] + [f(i, 1, a, z, 100 * MIB, h, t) for i, a, z, h, t in ((3, "a", "c", 900, 1000), (4, "d", "g", 200, 1000), (5, "h", "r", 1000, 1000), (6, "s", "z", 1000, 1500))] + [f(7, 2, "a", "z", 300 * MIB)]
    m = p.leveled(files, s)
    assert (set(m.files), m.keep_tombstones, m.trigger) == ({4, 7}, False, "LEVELED_TARGET_SIZE_RATIO")
    m = p.leveled([f(i, 0, "e", "t") for i in range(8)], s)
    assert (set(m.files), m.keep_tombstones, m.trigger) == (set(range(8)), False, "LEVELED_LEVEL0")
    assert p.leveled([f(0, 0, "a", "b")], s) is None
    assert p.pick([p.File(1, 1, min_tsn=5, max_tsn=9), p.File(2, 1, min_tsn=6, max_tsn=8)], "OLDEST_LARGEST_SEQUENCE_FIRST").index == 2


def test_tiered_merges():
    def tiers(*sizes):
        return [p.File(i, i, x * MIB) for i, x in enumerate(sizes)]

    assert p.tiered([], TieredStrategy()) is None
    cases = [((100, 100, 100), TieredStrategy(number_of_tiers=1), {0, 1, 2}, "TIER_SPACE_AMPLIFICATION"), ((100, 100, 300), TieredStrategy(1, 10.0, 1.0, 1), {0, 1, 2}, "TIER_SIZE_RATIO"), ((100, 200, 400), TieredStrategy(1, 10.0, 1.0, 1), {0, 1}, "TIER_SIZE_RATIO"), ((100, 100, 100, 100), TieredStrategy(3, 10.0, 10.0, 1), {0, 1, 2}, "TIER_HEIGHT_REDUCTION")]
    for sizes, s, want, trigger in cases:
        m = p.tiered(tiers(*sizes), s)
        assert (set(m.files), m.trigger) == (want, trigger)
    assert p.full(tiers(1, 2)).files == {0, 1} and p.full([p.File(4, 3)]) is None


def test_wal(spark):
    rows, seq = [], 0
    tx = {1000: [("s1", "hello", "world"), ("s1", "foo", "bar"), ("s2", "pi", "3.1415"), ("s2", "e", "2.71828"), ("s3", "john", "doe"), ("s3", "jane", "doe")], 1234: [], 777777: [("s1", "hello", None), ("s1", "foo", "baz"), ("s3", "sarah", "doe")], 800000: [("s1", "lost", "x")]}
    for t, cs in tx.items():
        for kind, c in [("START", None), *(("COMMAND", c) for c in cs), *([("COMMIT", None)] if t < 800000 else [])]:
            rows.append((seq, kind, t, c and c[0], c and c[1].encode(), c and ("DEL" if c[2] is None else "PUT"), c and (c[2] or "").encode()))
            seq += 1
    w = spark.createDataFrame(rows, "seq bigint, type string, commit_tsn bigint, store_id string, key binary, op string, value binary")
    got = wal.replay(w, spark.createDataFrame([("s2", 1000)], "store_id string, low_watermark bigint")).orderBy("store_id", "tsn", "key").collect()
    assert [(r.store_id, r.key.decode(), r.tsn, r.op) for r in got] == [("s1", "foo", 1000, "PUT"), ("s1", "hello", 1000, "PUT"), ("s1", "foo", 777777, "PUT"), ("s1", "hello", 777777, "DEL"), ("s3", "jane", 1000, "PUT"), ("s3", "john", 1000, "PUT"), ("s3", "sarah", 777777, "PUT")]
    info = {r.commit_tsn: (r.started, r.completed, r.commands) for r in wal.transactions(w).collect()}
    assert info == {1000: (True, True, 6), 1234: (True, True, 0), 777777: (True, True, 3), 800000: (True, False, 1)}
    assert wal.damaged(wal.with_checksum(w)).count() == 0 and wal.gaps(w.where("seq <> 4")).count() == 1
    a, c = wal.file_checksum(w.withColumn("f", F.lit(1)), "f").first(), wal.file_checksum(w.repartition(5).withColumn("f", F.lit(1)), "f").first()
    assert a == c


def test_manifest():
    ops = [
        {"type": "create_store", "store": "foo/bar", "valid_from": 1, "strategy": {"kind": "leveled"}},
        {"type": "create_store", "store": "foo/baz", "valid_from": 2, "strategy": {"kind": "tiered"}},
        *({"type": "flush", "store": "foo/bar", "file": i} for i in range(3)),
        *({"type": "flush", "store": "foo/baz", "file": i} for i in range(2)),
        {"type": "leveled_compaction", "store": "foo/bar", "inputs": {"0": [0, 1, 2]}, "outputs": [3], "output_level": 1},
        {"type": "tiered_compaction", "store": "foo/baz", "inputs": {"0": [1], "1": [0]}, "outputs": [2]},
    ]
    lines = [mf.encode_line({"sequence": i, **op}) for i, op in enumerate(ops, 1)]
    m = mf.replay(lines)
    assert m.last == 9 and m.stores["foo/bar"].files == {3: 1} and m.stores["foo/baz"].files == {2: 1}
    again = mf.replay([mf.encode_line(m.checkpoint())])
    assert again.stores == m.stores
    for bad in (lines[:2] + lines[3:], [lines[0].replace("bar", "bax")], [lines[0], mf.encode_line({"sequence": 2, "type": "leveled_compaction", "store": "foo/bar", "inputs": {"0": [7]}, "outputs": [], "output_level": 1})]):
        with pytest.raises(errors.ManifestException):
            mf.replay(bad)


def test_runs(spark, tmp_path):
    c = log(spark, *[(f"k{i:04d}", t, "x" * 20) for i in range(300) for t in (1, 2)])
    sizes = runs.codec_sizes(spark, c, str(tmp_path / "codecs"))
    assert set(sizes) == set(runs.CODECS) and sizes["gzip"] < sizes["none"]
    runs.write_run(c, str(tmp_path / "run"), target_bytes=6400, partitions=1)
    back = runs.read_runs(spark, [str(tmp_path / "run")])
    # Commands of 42 bytes each: 152 make 6400.
    assert seen(back) == seen(c) and len(list((tmp_path / "run").glob("*.parquet"))) == 4
    assert runs.read_runs(spark, []).count() == 0
    with pytest.raises(errors.FlushException):
        runs.write_run(c, str(tmp_path / "bad"), compression="zip")


def test_seeks_and_neighbours_over_thousands_of_ranges(spark):
    rows = spark.range(0, 40_000, 2).select(F.col("id").alias("key"))
    probes = spark.createDataFrame([(x,) for x in (-1, 0, 1, 777, 39_998, 40_001)], "probe bigint")
    found = {m: {r.probe: r.found for r in reads.seek_many(rows, probes, m, parts=2000).collect()} for m in reads.SEEKS}
    assert found["ceiling"] == {-1: 0, 0: 0, 1: 2, 777: 778, 39_998: 39_998, 40_001: None}
    assert found["floor"] == {-1: None, 0: 0, 1: 0, 777: 776, 39_998: 39_998, 40_001: 39_998}
    assert found["higher"] == {-1: 0, 0: 2, 1: 2, 777: 778, 39_998: None, 40_001: None}
    assert found["lower"] == {-1: None, 0: None, 1: 0, 777: 776, 39_998: 39_996, 40_001: 39_998}
    near = reads.neighbours(rows, parts=2000).where("coalesce(previous_key, -2) <> key - 2 OR coalesce(next_key, 40000) <> key + 2")
    assert near.count() == 0


def test_running_total_by_ranges(spark):
    r = random.Random(5)
    rows = [(r.choice(["a", "b", None]), i // 3, i, r.randrange(10)) for i in range(500)]
    df = spark.createDataFrame(rows, "g string, k int, t int, n int")
    for parts in (1, 7, 300):
        out = {x.t: x.before for x in reads.running_total(df, F.col("n"), ["g"], ["k", "t"], "before", parts).collect()}
        assert out == {t: sum(m for h, _, u, m in rows if h == g and u < t) for g, _, t, _ in rows}


def test_time_travel_in_blocks(spark):
    r = random.Random(8)
    c = log(spark, *{(k, t): (k, t, None if r.random() < 0.3 else str(t)) for k, t in ((f"k{r.randrange(9)}", r.randrange(1, 60)) for _ in range(200))}.values())
    asked = [-3, 0, 5, 5, 17, 18, 40, 59, 1000]
    snapshots = spark.createDataFrame([(t,) for t in asked] + [(None,)], "snapshot bigint")
    for block in (2, 1000):
        got = sorted((x.snapshot, x.key.decode(), x.tsn) for x in v.time_travel(c, snapshots, block).collect())
        assert got == sorted((t, k, n) for t in set(asked) for k, n, _ in seen(v.as_of(c, t)))
    assert v.time_travel(c, snapshots.where("false")).count() == 0


def test_more_bytes(spark):
    row = spark.createDataFrame([(b"\x01\x02\xff",)], "b binary").select(b.contains_all(F.col("b"), b"\xff\x01").alias("x"), b.contains_all(F.col("b"), b"\x03\x01").alias("y"), b.contains_all(F.col("b"), b"").alias("z"), b.random_bytes(7, 1).alias("r")).first()
    assert row.x and not row.y and row.z and len(row.r) == 7


def _murmur3(data: bytes, seed: int = 0) -> int:
    m, h, n = 0xFFFFFFFF, seed & 0xFFFFFFFF, len(data) // 4 * 4
    for i in range(0, len(data), 4):
        k = int.from_bytes(data[i : i + 4], "little") * 0xCC9E2D51 & m
        h ^= ((k << 15 | k >> 17) & m) * 0x1B873593 & m
        if i < n:
            h = ((h << 13 | h >> 19) & m) * 5 + 0xE6546B64 & m
    h ^= len(data)
    h = (h ^ h >> 16) * 0x85EBCA6B & m
    h = (h ^ h >> 13) * 0xC2B2AE35 & m
    h ^= h >> 16
    return h - (1 << 32) if h >> 31 else h


def test_murmur3(spark):
    from kvstrata.functions.hashes import murmur3

    assert (_murmur3(b""), _murmur3(b"hello"), _murmur3(b"The quick brown fox jumps over the lazy dog")) == (0, 0x248BFA47, 0x2E4FF723)  # published values
    raw = [None, b"", b"\xff" * 1000, *(bytes((i * 37 + j * 91) % 256 for j in range(i % 23)) for i in range(100))]
    rows = spark.createDataFrame([(r,) for r in raw], "b binary").select("b", murmur3(F.col("b")).alias("h"), murmur3(F.col("b"), -7).alias("seeded")).collect()
    for r in rows:
        assert (r.h, r.seeded) == ((None, None) if r.b is None else (_murmur3(bytes(r.b)), _murmur3(bytes(r.b), -7)))


def test_compressors(spark):
    from kvstrata.functions import codecs

    raw = [None, b"", b"a", b"abc" * 5000, bytes(range(256))]
    df = spark.createDataFrame([(r,) for r in raw], "b binary")
    assert {"none", "gzip", "snappy", "lz4", "zstd"} <= set(codecs.names())
    for name in ("none", "gzip", "snappy", "lz4", "zstd"):
        packed = df.select("b", codecs.compress(F.col("b"), name).alias("c"))
        for r in packed.select("b", F.octet_length("c").alias("n"), codecs.decompress(F.col("c"), name).alias("back")).collect():
            assert r.back == r.b and (name == "none" or r.b is None or len(r.b) < 9999 or r.n < 1000)
    with pytest.raises(ValueError):
        codecs.register("gzip", bytes, bytes)
    with pytest.raises(ValueError):
        codecs.compress(F.col("b"), "brotli9")
    codecs.register("reversed", lambda b: b[::-1], lambda b: b[::-1])
    try:
        assert [r[0] for r in df.select(codecs.compress(F.col("b"), "reversed")).collect()] == [r and r[::-1] for r in raw]
    finally:
        codecs._REGISTERED.pop("reversed")


def test_doubles_as_bytes(spark):
    import struct

    from kvstrata.functions import codecs

    numbers = [None, 0.0, -0.0, -1.5, 5e-324, 1e300, float("inf")]
    df = spark.createDataFrame([(x,) for x in numbers], "d double").withColumn("b", codecs.little_endian_double(F.col("d")))
    for r in df.select("d", "b", codecs.double_from_little_endian(F.col("b")).alias("back")).collect():
        assert (r.b, r.back) == ((None, None) if r.d is None else (struct.pack("<d", r.d), r.d))
    assert spark.createDataFrame([(b"short",)], "b binary").select(codecs.double_from_little_endian(F.col("b"))).first()[0] is None


def test_bloom_filters(spark):
    from kvstrata.operators.bloom import bloom_filters, might_contain

    key = F.encode(F.col("id").cast("string"), "UTF-8").alias("key")
    rows = spark.range(20000).select((F.col("id") % 3).alias("file"), key).union(spark.createDataFrame([(1, None), (1, b"0"), (7, b"0")], "file bigint, key binary"))
    files = rows.groupBy("file").agg(F.count("*").alias("total_entries"))
    filters = bloom_filters(rows, files, ["file"])
    sizes = {r.file: r.level for r in filters.select("file", "level").distinct().collect()}
    assert sizes[0] > 0 and sizes[7] == 0
    found = might_contain(filters, spark.range(60000).select(key), ["file"]).select("file", F.decode("key", "UTF-8").cast("int").alias("k")).collect()
    got = {(r.file, r.k) for r in found}
    true = {(i % 3, i) for i in range(20000)} | {(1, 0), (7, 0)}
    assert len(found) == len(got) and true <= got and len(got - true) < 0.01 * 60000 * 4
    nothing = spark.createDataFrame([], "key binary")
    assert might_contain(filters, nothing, ["file"]).isEmpty() and might_contain(bloom_filters(rows.limit(0), files, ["file"]), spark.range(5).select(key), ["file"]).isEmpty()


def test_bloom_lookup_joins_no_key_with_each_file(spark):
    """Keys and files of one block all meet: a join that tests bits would do so pair by pair."""
    from kvstrata.operators.bloom import bloom_filters, might_contain

    key = F.encode((F.col("id") * 577 % 6000).cast("string"), "UTF-8").alias("key")
    rows = spark.range(5000).select((F.col("id") % 500).alias("file"), key)
    files = rows.groupBy("file").agg(F.count("*").alias("total_entries"))
    found = might_contain(bloom_filters(rows, files, ["file"]), spark.range(3000).select(key), ["file"])
    got = found.collect()
    assert len(got) == len(set(got)) and set(rows.join(spark.range(3000).select(key), "key", "left_semi").select("file", "key").collect()) <= set(got)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert not [line for line in plan.splitlines() if "Join" in line and "bits" in line]


def test_bloom_lookup_in_groups_and_parts(spark, monkeypatch):
    """Files of several sizes in many groups, keys in several parts: the same as each key
    tested in each file by itself, less files whose range leaves the key out."""
    from kvstrata.operators import bloom

    monkeypatch.setattr(bloom, "GROUP_FILES", 70)
    monkeypatch.setattr(bloom, "PART_KEYS", 300)
    key = F.encode(F.lpad(F.col("id").cast("string"), 5, "0"), "UTF-8").alias("key")
    small = spark.range(6000).select(F.concat(F.lit("s"), F.floor(F.col("id") / 40)).alias("file"), F.lit(1).alias("n"), key)
    rows = small.union(spark.range(40000).select(F.lit("large"), (F.col("id") % 2).cast("int"), key)).union(spark.createDataFrame([("empty", 1, None)], small.schema))
    files = rows.groupBy("file", "n").agg(F.count("*").alias("total_entries"), F.min("key").alias("min_key"), F.max("key").alias("max_key"))
    by, fpp = ["file", "n"], 0.3
    filters = bloom.bloom_filters(rows, files, by, fpp)
    probes = spark.range(0, 12000, 3).select(key).union(spark.createDataFrame([(None,)], "key binary"))
    tested = filters.crossJoin(probes.where("key IS NOT NULL")).where(F.col("block") == bloom._block())
    for spot in bloom._spots(bloom._hashes(fpp)):
        tested = tested.where(F.ascii(F.substring(F.lpad(F.conv(F.hex(F.substring("bits", F.floor(spot / 8).cast("int") + 1, F.lit(1))), 16, 2), 8, "0"), 8 - (spot % 8).cast("int"), F.lit(1))) == 49)
    expected = {(r.file, r.n, bytes(r.key)) for r in tested.select(*by, "key").collect()}
    open_ = [(r.file, r.n, bytes(r.key)) for r in bloom.might_contain(filters, probes, by, fpp).collect()]
    ranged = [(r.file, r.n, bytes(r.key)) for r in bloom.might_contain(filters, probes, by, fpp, files).collect()]
    span = {(r.file, r.n): (r.min_key, r.max_key) for r in files.where("min_key IS NOT NULL").collect()}
    assert len({x[0] for x in expected}) == 151 and {r.level for r in filters.select("level").distinct().collect()} > {0}
    assert len(open_) == len(set(open_)) and set(open_) == expected
    assert len(ranged) == len(set(ranged)) and set(ranged) == {x for x in expected if span[x[:2]][0] <= x[2] <= span[x[:2]][1]} != expected


def test_entries_with_murmur3_checksums(spark):
    log = spark.createDataFrame([(1, "START", 5, None, None, None, None), (2, "COMMAND", 5, "s", b"k", "PUT", b"v"), (3, "COMMIT", 5, None, None, None, None)], WAL)
    marked = wal.with_checksum(log, "murmur3")
    assert wal.damaged(marked, "murmur3").isEmpty()
    assert [r.seq for r in wal.damaged(marked.withColumn("value", F.when(F.col("seq") == 2, F.lit(b"w")).otherwise(F.col("value"))), "murmur3").collect()] == [2]
