"""Queries over the test tables, one for each operator, and their SQL.

``events`` is read as a change log: the user is the key, the event's number the version, an
event of type ``error`` a deletion, and ``props`` the value."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kvstrata import stats
from kvstrata.functions import bytesfn as b
from kvstrata.operators import bloom, compaction, reads
from kvstrata.operators import versioning as v
from kvstrata.plans import policies
from kvstrata.schema import LeveledStrategy, TieredStrategy
from kvstrata.sources import manifest, wal

S, T = 5000, 2500  # versions that queries ask for
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str):
    """Registers a query under its name with its SQL."""

    def add(f):
        QUERIES[f.__name__] = f
        ORACLES[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def commands(spark: SparkSession, sf: str) -> DataFrame:
    put = F.col("event_type") != "error"
    return table(spark, sf, "events").select(F.concat(F.lit("s"), (F.col("user_id") % 4).cast("string")).alias("store_id"), b.stable_long(F.col("user_id")).alias("key"), F.col("event_id").alias("tsn"), F.when(put, "PUT").otherwise("DEL").alias("op"), F.when(put, F.encode("props", "UTF-8")).otherwise(F.lit(b"")).alias("value"))


C = """c AS (SELECT 's' || (user_id % 4) AS store_id, '8' || lpad(lower(to_hex(user_id)), 15, '0') AS key, event_id AS tsn,
  CASE WHEN event_type = 'error' THEN 'DEL' ELSE 'PUT' END AS op, CASE WHEN event_type = 'error' THEN '' ELSE props END AS value FROM events)"""


def shown(df: DataFrame) -> DataFrame:
    """Keys as hex and values as text."""
    out = df.withColumn("key", b.hex_lower(F.col("key"))) if "key" in df.columns else df
    return out.withColumn("value", F.decode("value", "UTF-8")) if "value" in df.columns else out


def _last(where: str = "true", then: str = "true") -> str:
    return f"WITH {C} SELECT * EXCLUDE rn FROM (SELECT *, row_number() OVER (PARTITION BY store_id, key ORDER BY tsn DESC) AS rn FROM c WHERE {where}) WHERE rn = 1 AND {then}"


@query(_last(f"tsn <= {S}", "op = 'PUT'"))
def snapshot_as_of(spark, sf):
    return shown(v.as_of(commands(spark, sf), S))


@query(_last(f"tsn <= {S}"))
def snapshot_with_deletions(spark, sf):
    return shown(v.as_of(commands(spark, sf), S, include_deletions=True))


SNAPS = [0, 10, 500, 2500, 5000, 7500]


@query(f"WITH {C}, n AS (SELECT *, lead(tsn) OVER (PARTITION BY store_id, key ORDER BY tsn) AS nx FROM c) SELECT store_id, key, tsn, op, value, CAST(s AS BIGINT) AS snapshot FROM n JOIN (SELECT unnest({SNAPS}) AS s) ON tsn <= s AND (nx IS NULL OR s < nx) WHERE op = 'PUT'")
def time_travel_many(spark, sf):
    return shown(v.time_travel(commands(spark, sf), spark.createDataFrame([(s,) for s in SNAPS], "snapshot bigint")))


def _key(user: int) -> bytes:
    return ((1 << 63) + user).to_bytes(8, "big")


@query(_last(f"tsn <= {S} AND key = '8' || lpad(lower(to_hex(ONE)), 15, '0')", "op = 'PUT'").replace("ONE", "4"))
def get_one(spark, sf):
    return shown(reads.get(commands(spark, sf), "s0", _key(4), S))


ASKED = [1, 2, 2, 3, 50, 149, 999_999]


def _asked(spark) -> DataFrame:
    return spark.createDataFrame([(f"s{u % 4}", _key(u)) for u in ASKED], "store_id string, key binary")


_A = f"a AS (SELECT DISTINCT 's' || (u % 4) AS store_id, '8' || lpad(lower(to_hex(u)), 15, '0') AS key FROM (SELECT unnest({ASKED}) AS u))"


@query(f"WITH {C}, {_A} SELECT store_id, key, tsn, op, value FROM (SELECT *, row_number() OVER (PARTITION BY store_id, key ORDER BY tsn DESC) AS rn FROM c WHERE tsn <= {S}) JOIN a USING (store_id, key) WHERE rn = 1 AND op = 'PUT'")
def get_multiple(spark, sf):
    return shown(reads.get_multiple(v.as_of(commands(spark, sf), S), _asked(spark), ["store_id", "key"]))


@query(f"WITH {C}, {_A}, l AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY store_id, key ORDER BY tsn DESC) AS rn FROM c WHERE tsn <= {S}) WHERE rn = 1) SELECT a.store_id, a.key, a.key = '8' || lpad(lower(to_hex(2)), 15, '0') OR l.tsn IS NOT NULL AS is_hit, a.key = '8' || lpad(lower(to_hex(2)), 15, '0') AS is_modified_in_transaction, CASE WHEN a.key <> '8' || lpad(lower(to_hex(2)), 15, '0') THEN l.tsn END AS last_modification_tsn, CASE WHEN a.key = '8' || lpad(lower(to_hex(2)), 15, '0') THEN 'new' WHEN l.op = 'PUT' THEN l.value END AS value FROM a LEFT JOIN l USING (store_id, key)")
def get_with_details(spark, sf):
    own = spark.createDataFrame([("s2", _key(2), b"new")], "store_id string, key binary, value binary")
    return shown(reads.get_with_details(commands(spark, sf), _asked(spark), S, own))


def _customers(spark, sf) -> DataFrame:
    return table(spark, sf, "customer").select(F.col("c_name").alias("key"), F.col("c_mktsegment").alias("value"))


_P = "c_name LIKE 'Customer#00000012%'"


@query(f"SELECT c_name AS key FROM customer WHERE {_P}")
def prefix_scan_keys(spark, sf):
    return reads.ordered(reads.with_prefix(_customers(spark, sf), "Customer#00000012"), columns=["key"])


@query(f"SELECT c_mktsegment AS value FROM customer WHERE {_P}")
def prefix_scan_values(spark, sf):
    return reads.ordered(reads.with_prefix(_customers(spark, sf), "Customer#00000012"), columns=["value"])


@query(f"SELECT c_name AS key, c_mktsegment AS value FROM customer WHERE {_P}")
def prefix_scan_entries(spark, sf):
    return reads.ordered(reads.with_prefix(_customers(spark, sf), "Customer#00000012"))


@query(f"WITH {C} SELECT * REPLACE ('8' || lpad(lower(to_hex(tsn)), 15, '0') AS key) FROM c WHERE tsn >= 256 AND tsn < 512")
def prefix_scan_bytes(spark, sf):
    rows = commands(spark, sf).withColumn("key", b.stable_long(F.col("tsn")))
    return shown(reads.with_prefix(rows, b"\x80\x00\x00\x00\x00\x00\x01"))


def _orders(spark, sf) -> DataFrame:
    return table(spark, sf, "orders").select(F.col("o_orderkey").alias("key"), F.col("o_orderpriority").alias("value"), F.col("o_orderstatus").alias("status"))


@query("SELECT o_orderkey AS key FROM orders")
def ordered_keys(spark, sf):
    return reads.ordered(_orders(spark, sf), columns=["key"])


@query("SELECT o_orderkey AS key, o_orderpriority AS value FROM orders")
def ordered_entries_desc(spark, sf):
    return reads.ordered(_orders(spark, sf), descending=True, columns=["key", "value"])


@query("SELECT o_orderkey AS key, o_orderpriority AS value FROM orders WHERE o_orderkey BETWEEN 1000 AND 2000")
def range_scan(spark, sf):
    return reads.between(_orders(spark, sf), 1000, 2000).select("key", "value")


@query("SELECT o_orderkey AS key, o_orderpriority AS value FROM orders WHERE o_orderkey < 500")
def entries_from_here_desc(spark, sf):
    return reads.entries_from(_orders(spark, sf), 500, ascending=False, include_current=False).select("key", "value")


@query("SELECT o_orderkey AS key, o_orderpriority AS value FROM orders ORDER BY 1 LIMIT 1")
def first_entry(spark, sf):
    return reads.first_entry(_orders(spark, sf)).select("key", "value")


@query("SELECT o_orderkey AS key, o_orderpriority AS value FROM orders ORDER BY 1 DESC LIMIT 1")
def last_entry(spark, sf):
    return reads.last_entry(_orders(spark, sf)).select("key", "value")


def _seek(mode: str, test: str, best: str):
    """Probes are event numbers that fall between, on and beyond the keys."""

    def run(spark, sf):
        keys = table(spark, sf, "events").where("event_type = 'purchase'").select(F.col("event_id").alias("key"))
        probes = table(spark, sf, "events").select((F.col("event_id") - 3).alias("probe"))
        return reads.seek_many(keys, probes, mode)

    run.__name__ = f"seek_{mode}"
    asof = f"SELECT p.probe, k.key AS found FROM (SELECT DISTINCT event_id - 3 AS probe FROM events) p ASOF LEFT JOIN (SELECT event_id AS key FROM events WHERE event_type = 'purchase') k ON p.probe {test} k.key"
    query(asof)(run)


for _mode, _test in (("ceiling", "<="), ("floor", ">="), ("higher", "<"), ("lower", ">")):
    _seek(_mode, _test, "")


@query("SELECT o_orderkey AS key, o_orderstatus AS status, lag(o_orderkey) OVER w AS previous_key, lead(o_orderkey) OVER w AS next_key FROM orders WINDOW w AS (PARTITION BY o_orderstatus ORDER BY o_orderkey)")
def neighbours(spark, sf):
    return reads.neighbours(_orders(spark, sf).select("key", "status"), within=["status"])


def _parts(spark, sf) -> DataFrame:
    return table(spark, sf, "part").select(F.col("p_partkey").alias("key"), F.col("p_name").alias("value"))


@query("SELECT p_partkey AS key, upper(p_name) AS value FROM part")
def map_value(spark, sf):
    return v.map_value(_parts(spark, sf), F.upper)


@query("SELECT p_partkey * 2 + 1 AS key, p_name AS value FROM part")
def map_key(spark, sf):
    return v.map_key(_parts(spark, sf), lambda k: k * 2 + 1)


@query("SELECT p_partkey - 5 AS key, CAST(length(p_name) AS INT) AS value FROM part")
def map_key_and_value(spark, sf):
    return v.map_key_and_value(_parts(spark, sf), lambda k: k - 5, F.length)


@query("SELECT p_partkey AS key, p_name AS value FROM part WHERE p_partkey % 3 = 1")
def filter_keys(spark, sf):
    return v.filter_keys(_parts(spark, sf), lambda k: k % 3 == 1)


@query("SELECT p_partkey AS key, p_name AS value FROM part WHERE contains(p_name, 'a')")
def filter_values(spark, sf):
    return v.filter_values(_parts(spark, sf), lambda x: x.contains("a"))


def _layer(spark, sf, lo: int, hi: int) -> DataFrame:
    """The last change of each user in a range of events; null: a deletion."""
    last = v.latest(commands(spark, sf).where(F.col("tsn").between(lo, hi)))
    return last.select("store_id", "key", F.when(F.col("op") == "PUT", F.col("value")).alias("value"))


def _layers(cuts: list[tuple[int, int]]) -> str:
    one = [f"SELECT store_id, key, CASE WHEN op = 'PUT' THEN value END AS value, {i} AS p FROM (SELECT *, row_number() OVER (PARTITION BY store_id, key ORDER BY tsn DESC) AS rn FROM c WHERE tsn BETWEEN {lo} AND {hi}) WHERE rn = 1" for i, (lo, hi) in enumerate(cuts)]
    return f"WITH {C}, l AS ({' UNION ALL '.join(one)}) SELECT store_id, key, value FROM (SELECT *, row_number() OVER (PARTITION BY store_id, key ORDER BY p DESC) AS rn FROM l) WHERE rn = 1 AND value IS NOT NULL"


@query(_layers([(0, 4000), (4001, 4100)]))
def overlay_two(spark, sf):
    return shown(v.overlay_onto(_layer(spark, sf, 4001, 4100), _layer(spark, sf, 0, 4000), ["store_id", "key"]))


@query(_layers([(0, 300), (2000, 2100), (1000, 1050)]))
def overlay_three(spark, sf):
    return shown(v.overlay([_layer(spark, sf, *x) for x in ((0, 300), (2000, 2100), (1000, 1050))], ["store_id", "key"]))


@query(f"WITH {C}, l AS (SELECT store_id, key, value FROM (SELECT *, row_number() OVER (PARTITION BY store_id, key ORDER BY tsn DESC) AS rn FROM c WHERE tsn <= {S}) WHERE rn = 1 AND op = 'PUT') SELECT * FROM l WHERE key NOT IN ('8000000000000005', '8000000000000006') UNION ALL VALUES ('s2', '8000000000000006', 'mine'), ('s1', '800000000000ffff', 'new')")
def transient_overlay(spark, sf):
    own = spark.createDataFrame([("s1", _key(5), None), ("s2", _key(6), b"mine"), ("s1", _key(65535), b"new")], "store_id string, key binary, value binary")
    base = v.as_of(commands(spark, sf), S).select("store_id", "key", "value")
    return shown(v.overlay_onto(own, base, ["store_id", "key"]))


@query(_last())
def latest_version_only(spark, sf):
    return shown(v.latest(commands(spark, sf)))


_N = f"WITH {C}, n AS (SELECT *, lead(tsn) OVER (PARTITION BY store_id, key ORDER BY tsn) AS nx FROM c)"


@query(f"{_N} SELECT * EXCLUDE nx FROM n WHERE nx IS NULL OR tsn >= {T}")
def drop_history(spark, sf):
    return shown(v.drop_history(commands(spark, sf), T))


@query(f"{_N} SELECT * EXCLUDE nx FROM n WHERE nx IS NULL OR nx > {T}")
def drop_history_safe(spark, sf):
    return shown(v.drop_history_safe(commands(spark, sf), T))


@query(f"WITH {C} SELECT * FROM c WHERE op = 'PUT'")
def drop_tombstones(spark, sf):
    return shown(v.drop_tombstones(commands(spark, sf)))


@query(f"WITH {C} SELECT * FROM c")
def distinct_commands(spark, sf):
    rows = commands(spark, sf)
    return shown(v.distinct_commands(rows.unionByName(rows.where(F.col("tsn") % 3 == 0))))


@query(f"{_N} SELECT * EXCLUDE nx FROM n WHERE nx IS NULL OR nx > {T}")
def compact_minor(spark, sf):
    return shown(compaction.compact(commands(spark, sf), T, keep_tombstones=True))


@query(_last("true", "op = 'PUT'"))
def compact_major(spark, sf):
    return shown(compaction.compact(commands(spark, sf), None, keep_tombstones=False))


def _filed(spark, sf) -> DataFrame:
    return commands(spark, sf).withColumn("file_index", F.expr("tsn DIV 1000"))


_SIZE = "(13 + 8 + CASE WHEN op = 'PUT' THEN 4 + strlen(value) ELSE 0 END)"
_F = f"WITH {C}, f AS (SELECT *, tsn // 1000 AS file_index, {_SIZE} AS sz FROM c)"
_FS = f"""{_F}, k AS (SELECT store_id, file_index, key, min(tsn) AS lo, max(tsn) AS hi, count(*) AS n, arg_max(op, tsn) AS last, sum(sz) AS sz FROM f GROUP BY ALL),
s AS (SELECT store_id, file_index, min(key) AS min_key, max(key) AS max_key, arg_min(lo, key) AS first_tsn, arg_max(hi, key) AS last_tsn, min(lo) AS min_tsn, max(hi) AS max_tsn, CAST(sum(n) AS BIGINT) AS total_entries, count(*) FILTER (last = 'PUT') AS head_entries, CAST(sum(sz) AS BIGINT) AS size_bytes FROM k GROUP BY ALL)"""


def _hex_keys(df: DataFrame) -> DataFrame:
    return df.withColumns({c: b.hex_lower(F.col(c)) for c in ("min_key", "max_key") if c in df.columns})


@query(f"{_FS} SELECT *, total_entries - head_entries AS history_entries, head_entries / total_entries AS head_history_ratio FROM s")
def file_stats(spark, sf):
    return _hex_keys(compaction.file_stats(_filed(spark, sf), ["store_id", "file_index"]))


@query(f"{_F}, b AS (SELECT *, coalesce(sum(sz) OVER (PARTITION BY store_id ORDER BY key, tsn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) // 4096 AS block FROM f) SELECT store_id, CAST(block AS BIGINT) AS block, min(key) AS min_key, max(key) AS max_key, min(tsn) AS min_tsn, max(tsn) AS max_tsn, count(*) AS entries, CAST(sum(sz) AS BIGINT) AS size_bytes FROM b GROUP BY ALL")
def block_stats(spark, sf):
    return _hex_keys(compaction.block_stats(commands(spark, sf), ["store_id"], 4096))


@query(f"{_F}, b AS (SELECT *, coalesce(sum(sz) OVER (PARTITION BY store_id ORDER BY key, tsn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) // 10000 AS part FROM f) SELECT store_id, key, tsn, op, value, CAST(part AS BIGINT) AS part FROM b")
def split_by_floor(spark, sf):
    return shown(compaction.split_by_floor(commands(spark, sf), 10_000, ["store_id"]))


_level = lambda size: f"SELECT o_orderkey // {size} AS file_index, min(o_orderkey) AS min_key, max(o_orderkey) AS max_key FROM orders GROUP BY 1"


@query(f"SELECT a.file_index AS a, b.file_index AS b FROM ({_level(100)}) a JOIN ({_level(170)}) b ON a.min_key <= b.max_key AND b.min_key <= a.max_key")
def file_overlap(spark, sf):
    """Two levels of files; those of one against those of the next."""
    level = lambda size: table(spark, sf, "orders").groupBy(F.expr(f"o_orderkey DIV {size}").alias("file_index")).agg(F.min("o_orderkey").alias("min_key"), F.max("o_orderkey").alias("max_key"))
    return compaction.overlapping_pairs(level(100), level(170), lambda k: F.floor(k / 256))


@query(f"{_FS} SELECT store_id, file_index FROM s WHERE min_key <= '8000000000000032' AND max_key >= '8000000000000032' AND min_tsn <= {S}")
def may_contain(spark, sf):
    return compaction.may_contain(compaction.file_stats(_filed(spark, sf), ["store_id", "file_index"]), _key(50), S).select("store_id", "file_index")


@query(f"WITH {C} SELECT DISTINCT store_id, tsn // 1000 AS file_index, key FROM c WHERE key IN (SELECT '8' || lpad(lower(to_hex(c_custkey)), 15, '0') FROM customer)")
def bloom_lookup(spark, sf):
    """Which files hold which of the customers' keys: only files whose filters let a key pass
    are searched for it."""
    by = ["store_id", "file_index"]
    filed = _filed(spark, sf)
    files = compaction.file_stats(filed, by)
    filters = bloom.bloom_filters(filed, files, by)
    asked = table(spark, sf, "customer").select(b.stable_long(F.col("c_custkey")).alias("key"))
    return shown(bloom.might_contain(filters, asked, by, files=files).join(filed, [*by, "key"], "left_semi"))


def _catalog(spark, sf) -> DataFrame:
    return compaction.file_stats(_filed(spark, sf), ["store_id", "file_index"]).withColumn("level_or_tier", (F.col("file_index") % 3).cast("int"))


@query(f"{_FS} SELECT store_id, CAST(file_index % 3 AS INT) AS level_or_tier, CAST(sum(size_bytes) AS BIGINT) AS size_bytes, count(*) AS files FROM s GROUP BY ALL")
def level_sizes(spark, sf):
    return policies.level_sizes(_catalog(spark, sf))


@query(f"""{_FS}, t AS (SELECT store_id, CAST(file_index % 3 AS INT) AS tier, sum(size_bytes) AS size, count(*) AS files FROM s GROUP BY ALL),
r AS (SELECT *, sum(size) OVER (PARTITION BY store_id ORDER BY tier ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS below, row_number() OVER (PARTITION BY store_id ORDER BY tier) AS k FROM t)
SELECT store_id, count(*) AS tiers, CAST(sum(CASE WHEN tier = 0 THEN files ELSE 0 END) AS BIGINT) AS tier0_files, count(*) - 1 + sum(CASE WHEN tier = 0 THEN files ELSE 0 END) >= 3 AS gate_open, (sum(size) - arg_max(size, tier)) / arg_max(size, tier) AS space_amplification, min(CASE WHEN size / below > 0.6 AND k >= 2 THEN tier END) AS size_ratio_tier FROM r GROUP BY store_id""")
def tiered_triggers(spark, sf):
    return policies.tier_triggers(_catalog(spark, sf), TieredStrategy(number_of_tiers=3, size_ratio=0.6, min_merge_tiers=2))


def _picked(order: str) -> str:
    return f"SELECT store_id, file_index FROM (SELECT *, row_number() OVER (PARTITION BY store_id ORDER BY {order}) AS rn FROM s) WHERE rn = 1"


@query(f"""{_FS}, a AS ({_picked("head_entries / total_entries, min_tsn, file_index")}), b AS ({_picked("min_tsn, file_index")}), d AS ({_picked("max_tsn, file_index")})
SELECT store_id, a.file_index AS most_deletions, b.file_index AS oldest_smallest, d.file_index AS oldest_largest FROM a JOIN b USING (store_id) JOIN d USING (store_id)""")
def pick_file(spark, sf):
    """The policies choose from a store's catalog, a few rows for terabytes of data."""
    stores: dict[str, list[policies.File]] = {}
    for r in compaction.file_stats(_filed(spark, sf), ["store_id", "file_index"]).collect():
        stores.setdefault(r["store_id"], []).append(policies.File(r["file_index"], 0, r["size_bytes"], bytes(r["min_key"]), bytes(r["max_key"]), r["min_tsn"], r["max_tsn"], r["head_entries"], r["total_entries"]))
    rows = [(s, *(policies.pick(f, x).index for x in ("BY_MOST_DELETIONS", "OLDEST_SMALLEST_SEQUENCE_FIRST", "OLDEST_LARGEST_SEQUENCE_FIRST"))) for s, f in sorted(stores.items())]
    return spark.createDataFrame(rows, "store_id string, most_deletions bigint, oldest_smallest bigint, oldest_largest bigint")


def _wal(spark, sf) -> DataFrame:
    """Events as log entries: ten commands a transaction; those ending in 9 never commit."""
    c = commands(spark, sf).withColumn("t", F.expr("tsn DIV 10"))
    none = F.lit(None)
    body = c.select((F.col("tsn") * 3 + 1).alias("seq"), F.lit("COMMAND").alias("type"), F.col("t").alias("commit_tsn"), "store_id", "key", "op", "value")
    edge = lambda kind, at, rows: rows.select((F.col("t") * 30 + at).alias("seq"), F.lit(kind).alias("type"), F.col("t").alias("commit_tsn"), none.cast("string").alias("store_id"), none.cast("binary").alias("key"), none.cast("string").alias("op"), none.cast("binary").alias("value"))
    t = c.select("t").distinct()
    return body.unionByName(edge("START", 0, t)).unionByName(edge("COMMIT", 29, t.where("t % 10 <> 9")))


@query(f"WITH {C} SELECT store_id, key, tsn // 10 AS tsn, op, value FROM c WHERE (tsn // 10) % 10 <> 9 AND NOT (store_id = 's1' AND tsn // 10 <= 300)")
def wal_replay(spark, sf):
    return shown(wal.replay(_wal(spark, sf), spark.createDataFrame([("s1", 300)], "store_id string, low_watermark bigint")))


@query("SELECT event_id // 10 AS commit_tsn, true AS started, (event_id // 10) % 10 <> 9 AS completed, count(*) AS commands FROM events GROUP BY ALL")
def wal_transactions(spark, sf):
    return wal.transactions(_wal(spark, sf))


@query("WITH s AS (SELECT event_id AS seq, lag(event_id) OVER (ORDER BY event_id) AS previous FROM events WHERE event_type <> 'error') SELECT seq, previous FROM s WHERE seq <> previous + 1")
def wal_gaps(spark, sf):
    return wal.gaps(table(spark, sf, "events").where("event_type <> 'error'").select(F.col("event_id").alias("seq")))


@query(f"WITH {C} SELECT tsn FROM c WHERE tsn % 100 = 13 AND op = 'PUT'")
def wal_damaged(spark, sf):
    rows = wal.with_checksum(_wal(spark, sf).where("type = 'COMMAND'"))
    hurt = rows.withColumn("value", F.when(((F.col("seq") - 1) / 3 % 100 == 13) & (F.col("op") == "PUT"), F.lit(b"x")).otherwise(F.col("value")))
    return wal.damaged(hurt).select(((F.col("seq") - 1) / 3).cast("bigint").alias("tsn"))


@query(f"WITH {C} SELECT store_id, max(tsn) AS high_watermark, max(tsn) FILTER (tsn % 3 = 0) AS low_watermark FROM c GROUP BY store_id")
def store_watermarks(spark, sf):
    c = commands(spark, sf)
    return stats.store_watermarks(c, c.where("tsn % 3 = 0").groupBy("store_id", F.expr("tsn DIV 1000").alias("file_index")).agg(F.max("tsn").alias("max_completely_written_tsn")))


@query(f"WITH {C}, s AS (SELECT store_id, max(tsn) AS hi, max(tsn) FILTER (tsn % 3 = 0) AS lo FROM c GROUP BY store_id) SELECT max(hi) AS high_watermark, min(lo) AS low_watermark FROM s")
def engine_watermarks(spark, sf):
    return stats.engine_watermarks(store_watermarks(spark, sf))


@query(f"{_FS} SELECT store_id, CAST(sum(head_entries) AS BIGINT) AS estimated_entries FROM s GROUP BY store_id")
def estimated_entries(spark, sf):
    return stats.estimated_entries(_catalog(spark, sf))


@query(f"{_FS} SELECT store_id, count(*) AS n_files, CAST(sum(size_bytes) AS BIGINT) AS size_bytes, string_agg(DISTINCT CAST(file_index % 3 AS VARCHAR), ',' ORDER BY CAST(file_index % 3 AS VARCHAR)) AS layers FROM s GROUP BY store_id")
def structure_report(spark, sf):
    return stats.structure_report(_catalog(spark, sf)).withColumn("layers", F.array_join(F.col("layers.level_or_tier"), ","))


_CE = "SELECT event_type AS cursor_type, CASE user_id % 8 WHEN 0 THEN 'opened' WHEN 1 THEN 'closed' WHEN 2 THEN 'first' WHEN 3 THEN 'last' WHEN 4 THEN 'next' WHEN 5 THEN 'previous' WHEN 6 THEN 'seek_floor' ELSE 'seek_ceiling' END AS operation, event_id % 5 AS n FROM events"
_sum = lambda o: f"CAST(sum(CASE WHEN operation IN ({o}) THEN n ELSE 0 END) AS BIGINT)"


@query(f"WITH e AS ({_CE}) SELECT cursor_type, " + ", ".join(f"{_sum(repr(o))} AS {o}" for o in ("opened", "closed", "first", "last", "next", "previous", "seek_floor", "seek_ceiling")) + f", {_sum("'first', 'last'")} AS jumps, {_sum("'next', 'previous'")} AS moves, {_sum("'seek_floor', 'seek_ceiling'")} AS seeks, {_sum("'first', 'last', 'next', 'previous', 'seek_floor', 'seek_ceiling'")} AS operations FROM e GROUP BY 1")
def cursor_statistics(spark, sf):
    table(spark, sf, "events").createOrReplaceTempView("kvstrata_events")
    return stats.cursor_statistics(spark.sql(_CE.replace("FROM events", "FROM kvstrata_events")))


@query("SELECT CASE WHEN user_id % 3 = 0 THEN 'READ_ONLY' WHEN user_id % 3 = 1 THEN 'READ_WRITE' ELSE 'EXCLUSIVE' END AS mode, count(*) FILTER (event_id % 4 = 0) AS opened, count(*) FILTER (event_id % 4 = 1) AS committed, count(*) FILTER (event_id % 4 = 2) AS rolled_back, count(*) FILTER (event_id % 4 = 3) AS dangling FROM events GROUP BY 1")
def transaction_statistics(spark, sf):
    e = table(spark, sf, "events")
    mode = F.element_at(F.array(*map(F.lit, ("READ_ONLY", "READ_WRITE", "EXCLUSIVE"))), (F.col("user_id") % 3 + 1).cast("int"))
    outcome = F.element_at(F.array(*map(F.lit, ("opened", "committed", "rolled_back", "dangling"))), (F.col("event_id") % 4 + 1).cast("int"))
    return stats.transaction_statistics(e.select(mode.alias("mode"), outcome.alias("outcome")))


@query("SELECT user_id AS cache, count(*) AS requests, count(*) FILTER (event_type = 'error') AS misses, count(*) FILTER (event_type <> 'error') AS hits, round(count(*) FILTER (event_type <> 'error') / count(*), 9) AS hit_rate FROM events GROUP BY 1")
def cache_statistics(spark, sf):
    e = table(spark, sf, "events").groupBy(F.col("user_id").alias("cache")).agg(F.count("*").alias("requests"), F.count_if(F.col("event_type") == "error").alias("misses"))
    return stats.cache_statistics(e).withColumn("hit_rate", F.round("hit_rate", 9))


@query("SELECT event_id, event_id * 10 AS bytes, event_id AS entries, user_id AS millis, round(CASE WHEN user_id > 0 THEN event_id * 10 * 1000.0 / user_id END, 6) AS bytes_per_second, round(CASE WHEN user_id > 0 THEN event_id * 1000.0 / user_id END, 6) AS entries_per_second FROM events")
def flush_throughput(spark, sf):
    e = table(spark, sf, "events").select("event_id", (F.col("event_id") * 10).alias("bytes"), F.col("event_id").alias("entries"), F.col("user_id").alias("millis"))
    return stats.flush_throughput(e).withColumns({c: F.round(c, 6) for c in ("bytes_per_second", "entries_per_second")})


_at = lambda p: f"max(CASE WHEN rn = CAST(floor(n * {p} / 100) AS BIGINT) + 1 THEN x END) AS p{p}"


@query("WITH r AS (SELECT l_returnflag AS flag, l_quantity AS x, row_number() OVER (PARTITION BY l_returnflag ORDER BY l_quantity) AS rn, count(*) OVER (PARTITION BY l_returnflag) AS n FROM lineitem) SELECT flag, max(n) AS n, min(x) AS min, max(x) AS max, sum(x) AS sum, round(avg(x), 6) AS mean, round(stddev_pop(x), 6) AS stddev, " + ", ".join(map(_at, (5, 25, 50, 75, 95, 99))) + " FROM r GROUP BY flag")
def nearest_rank_stats(spark, sf):
    rows = table(spark, sf, "lineitem").select(F.col("l_returnflag").alias("flag"), F.col("l_quantity").alias("x"))
    return stats.descriptive(rows, "x", ["flag"]).withColumns({"mean": F.round("mean", 6), "stddev": F.round("stddev", 6)})


@query("SELECT doc_id, md5(text) AS md5, sha256(text) AS sha256, lower(to_hex(encode(left(text, 3)))) AS head, CAST(strlen(text) AS INT) AS size FROM documents")
def hash_columns(spark, sf):
    raw = b.text_bytes(F.col("text"))
    return table(spark, sf, "documents").select("doc_id", b.digest(raw).alias("md5"), b.digest(raw, "sha256").alias("sha256"), b.hex_lower(b.text_bytes(F.left("text", F.lit(3)))).alias("head"), F.octet_length(raw).alias("size"))


@query("SELECT c_custkey, '8' || lpad(lower(to_hex(c_custkey)), 15, '0') AS stable, c_custkey AS back, lower(to_hex(encode(c_name[2:4]))) AS slice, CAST(instr(c_name, '#') - 1 AS INT) AS at, ascii('C') AS first, c_name[1:10] || '...' AS short, c_custkey AS little FROM customer")
def bytes_functions(spark, sf):
    name = b.text_bytes(F.col("c_name"))
    stable = b.stable_long(F.col("c_custkey"))
    return table(spark, sf, "customer").select("c_custkey", b.hex_lower(stable).alias("stable"), b.long_from_stable(stable).alias("back"), b.hex_lower(b.slice_bytes(name, 1, 3)).alias("slice"), b.index_of(name, 35).alias("at"), b.byte_at(name, 0).alias("first"), b.ellipsis(F.col("c_name"), 13).alias("short"), b.long_from_little_endian(b.little_endian_long(F.col("c_custkey"))).alias("little"))


@query(f"{_F} SELECT tsn, CAST(sz AS INT) AS command_size, CAST(sz AS INT) AS packed, 20 AS key_size, key AS unpacked_key, tsn AS unpacked_tsn FROM f")
def command_sizes(spark, sf):
    c = commands(spark, sf)
    p = b.pack_command(F.col("key"), F.col("tsn"), F.col("op"), F.col("value"))
    c = c.withColumn("p", p).withColumn("u", b.unpack_command(F.col("p")))
    return c.select("tsn", b.command_size(F.col("key"), F.col("op"), F.col("value")).alias("command_size"), F.octet_length("p").alias("packed"), b.key_and_tsn_size(F.col("key")).alias("key_size"), b.hex_lower(F.col("u.key")).alias("unpacked_key"), F.col("u.tsn").alias("unpacked_tsn"))


@query("SELECT p_name AS id, regexp_full_match(replace(p_name, ' ', '/'), '[a-z0-9_-]+(/[a-z0-9_-]+)*') AS valid FROM part")
def store_ids(spark, sf):
    return table(spark, sf, "part").select(F.col("p_name").alias("id"), b.is_store_id(F.replace(F.col("p_name"), F.lit(" "), F.lit("/"))).alias("valid"))


@query("WITH l AS (SELECT user_id AS file_index, arg_max(event_type, event_id) AS t, arg_max(event_id % 4, event_id) AS level FROM events GROUP BY 1) SELECT 's' AS store_id, file_index, CAST(level AS INT) AS level_or_tier FROM l WHERE t <> 'error'")
def manifest_live_files(spark, sf):
    e = table(spark, sf, "events").select(F.col("event_id").alias("sequence"), F.lit("s").alias("store_id"), F.col("user_id").alias("file_index"), F.when(F.col("event_type") != "error", (F.col("event_id") % 4).cast("int")).alias("level_or_tier"))
    return manifest.live_files(e)


@query("SELECT 'missing' AS state, o_custkey AS file_index FROM (SELECT DISTINCT o_custkey FROM orders) WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0) UNION ALL SELECT 'superfluous', c_custkey FROM customer WHERE c_acctbal > 0 AND c_custkey NOT IN (SELECT o_custkey FROM orders)")
def reconcile_files(spark, sf):
    known = table(spark, sf, "orders").select(F.col("o_custkey").alias("file_index")).distinct()
    there = table(spark, sf, "customer").where("c_acctbal > 0").select(F.col("c_custkey").alias("file_index"))
    missing, extra = manifest.reconcile(known, there, ["file_index"])
    return missing.select(F.lit("missing").alias("state"), "file_index").unionByName(extra.select(F.lit("superfluous").alias("state"), "file_index"))


def split_exact(spark, sf):
    return shown(compaction.split_exact(commands(spark, sf), 10_000, ["store_id"]))


QUERIES["split_exact"] = split_exact  # the rolling rule is sequential; tests hold it against plain code


@query("SELECT o_orderpriority AS value FROM orders")
def ordered_values(spark, sf):
    return reads.ordered(_orders(spark, sf), descending=True, columns=["value"])


@query("SELECT o_orderkey AS key, o_orderpriority AS value FROM orders WHERE o_orderkey >= 500")
def entries_from_here(spark, sf):
    return reads.entries_from(_orders(spark, sf), 500).select("key", "value")


@query("SELECT o_orderkey AS key, o_orderpriority AS value FROM orders")
def check_ordered(spark, sf):
    """Fails as it runs if the keys of a status ever fall."""
    return v.check_ordered(_orders(spark, sf).withColumn("__pos", F.col("key")), ["key"], within=["status"]).select("key", "value")


@query(_last("tsn // 1000 = 2"))
def latest_in_file(spark, sf):
    return shown(v.latest(_filed(spark, sf).where("file_index = 2").drop("file_index")))


@query(f"WITH {C} SELECT DISTINCT key, key < '800000000000004b' AS less, key = '800000000000004b' AS same FROM c")
def bytes_compare(spark, sf):
    keys = commands(spark, sf).select("key").distinct()
    return shown(keys.select("key", (F.col("key") < F.lit(_key(75))).alias("less"), (F.col("key") == F.lit(_key(75))).alias("same")))


@query("""WITH x AS (SELECT o_orderkey, 2 * CAST(floor(o_totalprice * o_orderkey) AS BIGINT) + 1 AS n FROM orders)
SELECT o_orderkey, CASE WHEN n >= 1099511627776 THEN printf('%.2f', n / 1099511627776.0) || ' TiB' WHEN n >= 1073741824 THEN printf('%.2f', n / 1073741824.0) || ' GiB'
  WHEN n >= 1048576 THEN printf('%.2f', n / 1048576.0) || ' MiB' WHEN n >= 1024 THEN printf('%.2f', n / 1024.0) || ' KiB' ELSE n || ' B' END AS size FROM x""")
def human_sizes(spark, sf):
    n = 2 * F.floor(F.col("o_totalprice") * F.col("o_orderkey")).cast("bigint") + 1
    return table(spark, sf, "orders").select("o_orderkey", b.human_size(n).alias("size"))


@query("SELECT o_orderkey, md5(CAST(o_orderkey AS VARCHAR)) AS bytes, regexp_replace(md5(CAST(o_orderkey AS VARCHAR)), '^(.{8})(.{4})(.{4})(.{4})(.{12})$', '\\1-\\2-\\3-\\4-\\5') AS uuid FROM orders")
def uuids(spark, sf):
    """Bytes to the text form and back."""
    text = b.bytes_uuid(F.unhex(F.md5(F.col("o_orderkey").cast("string"))))
    return table(spark, sf, "orders").select("o_orderkey", b.hex_lower(b.uuid_bytes(text)).alias("bytes"), text.alias("uuid"))


@query(f"WITH {C} SELECT tsn * 3 + 1 AS seq, 'COMMAND' AS type, tsn // 10 AS commit_tsn FROM c WHERE tsn // 10 > 300 UNION ALL SELECT DISTINCT tsn // 10 * 30, 'START', tsn // 10 FROM c WHERE tsn // 10 > 300 UNION ALL SELECT DISTINCT tsn // 10 * 30 + 29, 'COMMIT', tsn // 10 FROM c WHERE tsn // 10 > 300 AND (tsn // 10) % 10 <> 9")
def wal_shortened(spark, sf):
    return wal.shorten(_wal(spark, sf), 300).select("seq", "type", "commit_tsn")


def _merges(spark, sf, plan) -> DataFrame:
    """The merge that a policy asks for, of each store's catalog (a few rows a store)."""
    stores: dict[str, list[policies.File]] = {}
    small = commands(spark, sf).withColumn("file_index", F.expr("tsn DIV 100"))
    for r in compaction.file_stats(small, ["store_id", "file_index"]).withColumn("level_or_tier", (F.col("file_index") % 3).cast("int")).collect():
        stores.setdefault(r["store_id"], []).append(policies.File(r["file_index"], r["level_or_tier"], r["size_bytes"], bytes(r["min_key"]), bytes(r["max_key"]), r["min_tsn"], r["max_tsn"], r["head_entries"], r["total_entries"]))
    found = [(s, plan(files)) for s, files in sorted(stores.items())]
    rows = [(s, m.trigger, m.output, m.keep_tombstones, ",".join(map(str, sorted(m.files)))) for s, m in found if m]
    return spark.createDataFrame(rows, "store_id string, trigger string, output int, keep_tombstones boolean, files string")


_LEVELS = f"{_FS}, l AS (SELECT *, CAST(file_index % 3 AS INT) AS level FROM s)".replace("tsn // 1000", "tsn // 100")
_LIST = "string_agg(CAST(file_index AS VARCHAR), ',' ORDER BY file_index) AS files"


@query(f"{_LEVELS} SELECT store_id, 'FULL_COMPACTION' AS trigger, max(level) AS output, false AS keep_tombstones, {_LIST} FROM l GROUP BY store_id")
def merge_full(spark, sf):
    return _merges(spark, sf, policies.full)


@query(f"""{_LEVELS}, z AS (SELECT store_id, min(min_key) AS lo, max(max_key) AS hi FROM l WHERE level = 0 GROUP BY store_id)
SELECT store_id, 'LEVELED_LEVEL0' AS trigger, CAST(1 AS INT) AS output, true AS keep_tombstones, {_LIST} FROM l JOIN z USING (store_id) WHERE level = 0 OR level = 1 AND min_key <= hi AND lo <= max_key GROUP BY store_id""")
def merge_leveled_level0(spark, sf):
    return _merges(spark, sf, lambda files: policies.leveled(files, LeveledStrategy(level0_trigger=1, max_levels=3)))


@query(f"""{_LEVELS}, p AS (SELECT store_id, file_index AS chosen, min_key AS lo, max_key AS hi FROM (SELECT *, row_number() OVER (PARTITION BY store_id ORDER BY min_tsn, file_index) AS rn FROM l WHERE level = 1) WHERE rn = 1)
SELECT store_id, 'LEVELED_TARGET_SIZE_RATIO' AS trigger, CAST(2 AS INT) AS output, false AS keep_tombstones, {_LIST} FROM l JOIN p USING (store_id) WHERE file_index = chosen OR level = 2 AND min_key <= hi AND lo <= max_key GROUP BY store_id""")
def merge_leveled_ratio(spark, sf):
    """Level 1 is over its target, as levels are to grow by a thousand."""
    return _merges(spark, sf, lambda files: policies.leveled(files, LeveledStrategy(level0_trigger=99_999, max_levels=3, base_bytes=1, level_size_multiplier=1000.0, file_selection="OLDEST_SMALLEST_SEQUENCE_FIRST")))


@query(f"{_LEVELS} SELECT store_id, 'TIER_SPACE_AMPLIFICATION' AS trigger, max(level) AS output, false AS keep_tombstones, {_LIST} FROM l GROUP BY store_id")
def merge_tiered_space(spark, sf):
    return _merges(spark, sf, lambda files: policies.tiered(files, TieredStrategy(number_of_tiers=1, max_space_amplification=0.01)))


@query(f"""{_LEVELS}, t AS (SELECT store_id, level, sum(size_bytes) AS size FROM l GROUP BY ALL),
r AS (SELECT *, sum(size) OVER (PARTITION BY store_id ORDER BY level ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS below FROM t),
g AS (SELECT store_id, min(level) AS goal FROM r WHERE size / below > 0.1 GROUP BY store_id), m AS (SELECT store_id, max(level) AS last FROM t GROUP BY store_id)
SELECT store_id, 'TIER_SIZE_RATIO' AS trigger, max(goal) AS output, max(goal) < max(last) AS keep_tombstones, {_LIST} FROM l JOIN g USING (store_id) JOIN m USING (store_id) WHERE level <= goal GROUP BY store_id""")
def merge_tiered_ratio(spark, sf):
    return _merges(spark, sf, lambda files: policies.tiered(files, TieredStrategy(number_of_tiers=1, max_space_amplification=1e9, size_ratio=0.1)))


@query(f"{_LEVELS} SELECT store_id, 'TIER_HEIGHT_REDUCTION' AS trigger, CAST(1 AS INT) AS output, true AS keep_tombstones, {_LIST} FROM l WHERE level < 2 GROUP BY store_id")
def merge_tiered_height(spark, sf):
    return _merges(spark, sf, lambda files: policies.tiered(files, TieredStrategy(number_of_tiers=3, max_space_amplification=1e9, size_ratio=1e9)))
