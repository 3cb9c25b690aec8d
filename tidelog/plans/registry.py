"""Registered queries over the driver's tables, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelog.functions import hashing as h
from tidelog.operators import analytics as a
from tidelog.operators import consistency, folds, state, storage, workload
from tidelog.operators.tables import fresh_folder
from tidelog.sources import events, measurements
from tidelog.streaming import streams

QUERIES: dict = {}
ORACLE_SQL: dict = {}

LOG = """log AS (
  SELECT event_id AS seq, CAST(floor(event_id / 1000) AS BIGINT) AS epoch, CAST(event_id * 7 % 4 AS INT) AS writer,
         CAST(user_id % 4 AS INT) AS owner, CAST(user_id AS VARCHAR) AS key, props AS value,
         CASE WHEN event_type IN ('signup', 'purchase') THEN 'PUT' WHEN event_type = 'error' THEN 'DEL' ELSE 'GET' END AS op
  FROM events),
latest AS (
  SELECT key, arg_max(op, seq) AS op, CASE WHEN arg_max(op, seq) = 'PUT' THEN arg_max(value, seq) END AS value, max(seq) AS seq
  FROM log WHERE op <> 'GET' GROUP BY key)"""
M = """m AS (
  SELECT l_returnflag AS db, CAST(l_linenumber AS INT) AS rank, CAST(l_suppkey % 7 AS INT) AS owner, CAST(l_suppkey % 10 AS INT) AS run,
         l_extendedprice AS optime, l_linestatus AS op, l_orderkey AS seq
  FROM lineitem)"""
STATUS = "CASE op WHEN 'PUT' THEN 'FOUND' WHEN 'DEL' THEN 'DELETED' ELSE 'NOT_FOUND' END"


def query(sql: str | None = None, name: str | None = None):
    """Register a function of (spark, sf_dir) under its name, with its SQL."""

    def put(f):
        QUERIES[name or f.__name__] = f
        if sql is not None:
            ORACLE_SQL[name or f.__name__] = sql
        return f

    return put


def _probes(spark: SparkSession) -> DataFrame:
    return spark.range(200).select(F.col("id").cast("string").alias("key"))


# ---------------------------------------------------------------- key-value semantics


@query(f"WITH {LOG} SELECT key, op, value, seq FROM latest")
def kv_put_lww(spark, d):
    return state.latest(events.oplog(spark, d))


@query(f"WITH {LOG} SELECT key, value, seq FROM latest WHERE op = 'PUT'")
def kv_live_scan(spark, d):
    return state.live(events.oplog(spark, d))


@query(f"WITH {LOG} SELECT '42' AS key, {STATUS} AS status, value FROM (SELECT 1) LEFT JOIN latest ON key = '42'")
def kv_get(spark, d):
    return state.get(events.oplog(spark, d), "42")


@query(
    f"""WITH {LOG} SELECT p.key, CASE WHEN op = 'PUT' AND octet_length(encode(value)) > 8 THEN 'BUFFER_TOO_SMALL' ELSE {STATUS} END AS status,
    CAST(CASE WHEN op = 'PUT' THEN octet_length(encode(value)) ELSE 0 END AS BIGINT) AS value_len, CASE WHEN octet_length(encode(value)) <= 8 THEN value END AS value
    FROM (SELECT CAST(range AS VARCHAR) AS key FROM range(200)) p LEFT JOIN latest ON latest.key = p.key"""
)
def kv_get_buffered(spark, d):
    return state.multi_get(events.oplog(spark, d), _probes(spark), 8)


@query(
    f"""WITH {LOG} SELECT p.key, {STATUS} AS status, CAST(CASE WHEN op = 'PUT' THEN octet_length(encode(value)) ELSE 0 END AS BIGINT) AS value_len, value
    FROM (SELECT CAST(range AS VARCHAR) AS key FROM range(200)) p LEFT JOIN latest ON latest.key = p.key"""
)
def kv_multi_get(spark, d):
    return state.multi_get(events.oplog(spark, d), _probes(spark))


@query(f"WITH {LOG} SELECT key, seq FROM latest WHERE op = 'DEL'")
def kv_delete_tombstones(spark, d):
    return state.tombstones(events.oplog(spark, d))


@query(
    f"""WITH {LOG}, r AS (
      SELECT *, last_value(CASE WHEN op <> 'GET' THEN op END IGNORE NULLS) OVER w AS rop, last_value(CASE WHEN op = 'PUT' THEN value WHEN op = 'DEL' THEN '' END IGNORE NULLS) OVER w AS rv
      FROM log WINDOW w AS (PARTITION BY key ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
    SELECT seq, key, {STATUS.replace("CASE op", "CASE rop")} AS status, CASE WHEN rop = 'PUT' THEN rv END AS value FROM r WHERE op = 'GET'"""
)
def kv_replay_sequential(spark, d):
    return consistency.replay_sequential(events.oplog(spark, d))


@query(
    f"""WITH {LOG}, c AS (
      SELECT r.seq, r.key, w.op, w.value,
        (CASE WHEN r.owner <> r.writer AND w.writer = r.writer AND w.epoch = r.epoch THEN 1 ELSE 0 END) * 1000000000000000
        + w.epoch * 10000000000 + (CASE WHEN w.writer <> w.owner THEN 1 ELSE 0 END) * 1000000000 + w.seq AS k
      FROM (SELECT * FROM log WHERE op = 'GET') r
      LEFT JOIN (SELECT * FROM log WHERE op <> 'GET') w
        ON w.key = r.key AND w.seq < r.seq AND (w.epoch < r.epoch OR w.writer = r.writer OR w.writer = w.owner)),
    b AS (SELECT seq, key, arg_max(op, k) AS op, arg_max(coalesce(value, ''), k) AS value FROM c GROUP BY seq, key)
    SELECT seq, key, {STATUS} AS status, CASE WHEN op = 'PUT' THEN value END AS value FROM b"""
)
def kv_fence_visibility(spark, d):
    return consistency.replay_relaxed(events.oplog(spark, d))


@query(
    f"""WITH {LOG}, w AS (SELECT *, epoch * 10000000000 + (CASE WHEN writer <> owner THEN 1 ELSE 0 END) * 1000000000 + seq AS k FROM log WHERE op <> 'GET')
    SELECT key, arg_max(op, k) AS op, CASE WHEN arg_max(op, k) = 'PUT' THEN arg_max(value, k) END AS value, arg_max(seq, k) AS seq FROM w GROUP BY key"""
)
def kv_relaxed_final_state(spark, d):
    return consistency.relaxed_final_state(events.oplog(spark, d))


@query(
    f"""WITH {LOG} SELECT seq, key, op, epoch, CASE WHEN epoch < 3 THEN 'RELAXED' ELSE 'SEQUENTIAL' END AS consistency,
    CASE WHEN epoch < 3 THEN 'READANDWRITE' WHEN epoch < 7 THEN 'READONLY' ELSE 'READANDWRITE' END AS mode FROM log"""
)
def kv_mode_timeline(spark, d):
    options = spark.createDataFrame([(0, "RELAXED", "READANDWRITE"), (3, "SEQUENTIAL", "READONLY"), (7, "SEQUENTIAL", "READANDWRITE")], "epoch bigint, consistency string, mode string")
    return consistency.options_timeline(events.oplog(spark, d), options).select("seq", "key", "op", "epoch", "consistency", "mode")


@query(f"WITH {LOG} SELECT DISTINCT key, CAST((ascii(key) - 48) % 4 AS INT) AS owner FROM log")
def kv_owner(spark, d):
    keys = events.oplog(spark, d).select("key").distinct()
    return keys.select("key", h.owner_of(h.first_digit_hash(F.col("key")), 4).alias("owner"))


@query(f"WITH {LOG} SELECT CAST((ascii(key) - 48) % 4 AS INT) AS owner, count(DISTINCT key) AS n_keys, count(*) AS n_ops FROM log GROUP BY 1")
def kv_owner_histogram(spark, d):
    ops = events.oplog(spark, d).groupBy("key").agg(F.count("*").alias("n"))
    return ops.groupBy(h.owner_of(h.first_digit_hash(F.col("key")), 4).alias("owner")).agg(F.count("*").alias("n_keys"), F.sum("n").alias("n_ops"))


def _murmur(keys: str, seed: int) -> str:
    """SQL of the public hash: key, hash and owner of the (ASCII) keys of a query, a word at a time."""
    byte = lambda at: f"ascii(substr(key, {at}, 1))"
    times = lambda x, c: f"CAST(CAST({x} AS HUGEINT) * {c} % 4294967296 AS BIGINT)"
    turn = lambda x, n: f"((({x}) << {n}) | (({x}) >> {32 - n})) & 4294967295"
    word = f"({byte('4 * i + 1')} + {byte('4 * i + 2')} * 256 + {byte('4 * i + 3')} * 65536 + {byte('4 * i + 4')} * 16777216)"
    rest = f"({byte('n - n % 4 + 1')} + {byte('n - n % 4 + 2')} * 256 + {byte('n - n % 4 + 3')} * 65536)"
    scrambled = lambda w: times(turn(times(w, 3432918353), 15), 461845907)
    return f"""WITH RECURSIVE {keys},
    b(key, n, i, h) AS (
      SELECT key, octet_length(encode(key)), 0, CAST({seed} AS BIGINT) FROM keys
      UNION ALL SELECT key, n, i + 1, ({turn(f'xor(h, {scrambled(word)})', 13)}) * 5 + 3864292196 & 4294967295 FROM b WHERE 4 * (i + 1) <= n),
    t AS (SELECT key, xor(xor(h, {scrambled(rest)}), CAST(n AS BIGINT)) AS h FROM b WHERE 4 * (i + 1) > n),
    f1 AS (SELECT key, {times('xor(h, h >> 16)', 2246822507)} AS h FROM t),
    f2 AS (SELECT key, {times('xor(h, h >> 13)', 3266489909)} AS h FROM f1),
    f3 AS (SELECT key, xor(h, h >> 16) AS h FROM f2)
    SELECT key, CAST(h AS BIGINT) AS hash, CAST(h % 4 AS INT) AS owner FROM f3"""


@query(_murmur(f"{LOG}, keys AS (SELECT DISTINCT substr(md5(key), 1, 16) AS key FROM log)", 1))
def kv_owner_murmur(spark, d):
    keys = events.oplog(spark, d).select(F.substring(F.md5(F.col("key").cast("binary")), 1, 16).alias("key")).distinct()
    return keys.select("key", h.hash_native(F.col("key"), 1).alias("hash"), h.owner_of(h.hash_native(F.col("key"), 1), 4).alias("owner"))


@query(_murmur(f"{LOG}, keys AS (SELECT DISTINCT key FROM log)", 7))
def kv_owner_murmur_any_length(spark, d):
    keys = events.oplog(spark, d).select("key").distinct()
    return keys.select("key", h.hash_exact(F.col("key"), 7).alias("hash"), h.owner_of(h.hash_exact(F.col("key"), 7), 4).alias("owner"))


GENS = """runs AS (
  SELECT epoch AS gen, key, arg_max(owner, seq) AS owner, arg_max(op, seq) = 'DEL' AS tombstone, CASE WHEN arg_max(op, seq) = 'PUT' THEN arg_max(value, seq) END AS value
  FROM log WHERE op <> 'GET' GROUP BY epoch, key),
newest AS (SELECT key, max(gen) AS gen, arg_max(tombstone, gen) AS tombstone, arg_max(coalesce(value, ''), gen) AS v, arg_max(owner, gen) AS owner FROM runs GROUP BY key)"""


@query(f"WITH {LOG}, {GENS} SELECT key, gen, tombstone, CASE WHEN NOT tombstone THEN v END AS value FROM newest")
def kv_newest_run_wins(spark, d):
    return storage.newest(storage.run_of(events.oplog(spark, d)))


def _stored(spark: SparkSession, d: str) -> DataFrame:
    root = fresh_folder(spark, "generations")
    storage.checkpoint(storage.run_of(events.oplog(spark, d)), root)
    return storage.open_store(spark, root)


@query(f"WITH {LOG}, {GENS} SELECT key, gen, CAST(owner AS INT) AS owner, tombstone, value FROM runs")
def kv_checkpoint_roundtrip(spark, d):
    return _stored(spark, d).select("key", F.col("gen").cast("bigint").alias("gen"), F.col("owner").cast("int").alias("owner"), "tombstone", "value")


@query(f"WITH {LOG}, {GENS} SELECT p.key, CASE WHEN gen IS NULL THEN 'NOT_FOUND' WHEN tombstone THEN 'DELETED' ELSE 'FOUND' END AS status, CASE WHEN NOT tombstone THEN v END AS value FROM (SELECT CAST(range AS VARCHAR) AS key FROM range(200)) p LEFT JOIN newest ON newest.key = p.key")
def kv_restart_newest_gen(spark, d):
    return storage.read(_stored(spark, d), _probes(spark))


@query(f"WITH {LOG}, {GENS} SELECT max(gen) AS gen FROM runs")
def kv_highest_generation(spark, d):
    return _stored(spark, d).agg(F.max("gen").cast("bigint").alias("gen"))


@query(f"WITH {LOG}, {GENS} SELECT key, gen, CAST(owner AS INT) AS owner, v AS value FROM newest WHERE NOT tombstone")
def kv_compact_merge(spark, d):
    return storage.merge(storage.run_of(events.oplog(spark, d))).select("key", "gen", F.col("owner").cast("int").alias("owner"), "value")


@query(f"WITH {LOG} SELECT key, value FROM latest WHERE op = 'PUT' AND key NOT IN (SELECT key FROM log WHERE op <> 'GET' AND epoch = 9)")
def kv_cache_invalidate(spark, d):
    log = events.oplog(spark, d)
    return state.cache_invalidate(state.live(log).select("key", "value"), state.writes(log).where("epoch = 9"))


@query(
    f"""WITH {LOG}, l AS (SELECT epoch, key, CASE WHEN arg_max(op, seq) = 'PUT' THEN octet_length(encode(arg_max(value, seq))) ELSE 0 END + octet_length(encode(key)) + 1 AS n FROM log WHERE op <> 'GET' GROUP BY epoch, key)
    SELECT epoch, count(*) AS entries, CAST(sum(n) AS BIGINT) AS bytes FROM l GROUP BY epoch"""
)
def kv_memtable_bytes(spark, d):
    return state.memtable_bytes(events.oplog(spark, d))


@query(
    f"""WITH {LOG}, t AS (SELECT CASE WHEN epoch >= 8 THEN 0 WHEN epoch >= 4 THEN 1 ELSE 2 END AS tier, * FROM log WHERE op <> 'GET'),
    l AS (SELECT tier, key, arg_max(op, seq) AS op, arg_max(value, seq) AS value FROM t GROUP BY tier, key),
    f AS (SELECT key, CAST(min(tier) AS INT) AS tier, arg_min(op, tier) AS op, arg_min(coalesce(value, ''), tier) AS value FROM l GROUP BY key)
    SELECT p.key, tier, {STATUS} AS status, CASE WHEN op = 'PUT' THEN value END AS value FROM (SELECT CAST(range AS VARCHAR) AS key FROM range(200)) p LEFT JOIN f ON f.key = p.key"""
)
def kv_tier_lookup(spark, d):
    log = events.oplog(spark, d)
    tiers = [state.latest(log.where(c)) for c in ("epoch >= 8", "epoch >= 4 AND epoch < 8", "epoch < 4")]
    return state.tier_lookup(_probes(spark), tiers)


#: Bytes that seal a table, so small that tables are sealed at every scale.
ROLLOVER = 30


@query(
    f"""WITH RECURSIVE {LOG}, w AS (
      SELECT owner, row_number() OVER (PARTITION BY owner ORDER BY seq) AS i, seq, key, CASE WHEN op = 'PUT' THEN octet_length(encode(value)) ELSE 0 END AS n FROM log WHERE op <> 'GET'),
    f(owner, i, seq, run, m, entries, bytes) AS (
      SELECT owner, i, seq, CASE WHEN octet_length(encode(key)) + n + 1 > {ROLLOVER} THEN 1 ELSE 0 END, MAP {{key: n}}, 1, octet_length(encode(key)) + n + 1 FROM w WHERE i = 1
      UNION ALL SELECT owner, i, seq, run + CASE WHEN bytes > {ROLLOVER} THEN 1 ELSE 0 END, m, len(map_keys(m)), bytes FROM (
        SELECT *, list_sum(map_values(m)) + list_sum(list_transform(map_keys(m), lambda k: octet_length(encode(k)) + 1)) AS bytes FROM (
          SELECT w.owner, w.i, w.seq, f.run, map_concat(CASE WHEN f.bytes > {ROLLOVER} THEN map_from_entries(list_slice(map_entries(f.m), 1, 0)) ELSE f.m END, MAP {{w.key: w.n}}) AS m
          FROM f JOIN w ON w.owner = f.owner AND w.i = f.i + 1)))
    SELECT CAST(owner AS INT) AS owner, CAST(run AS BIGINT) AS run, seq AS last_seq, CAST(entries AS BIGINT) AS entries, CAST(bytes AS BIGINT) AS bytes FROM f WHERE bytes > {ROLLOVER}"""
)
def kv_memtable_rollover(spark, d):
    return folds.memtable_rollover(events.oplog(spark, d), ROLLOVER)


def _lru(limit: int) -> str:
    """SQL of every owner's cache, an operation at a time: reads and hits; the list holds entries, the oldest first."""
    total = "coalesce(list_sum(list_transform(x, lambda e: e.n)), 0)"
    return f"""{LOG}, o AS (
      SELECT owner, row_number() OVER (PARTITION BY owner ORDER BY seq) AS i, op, key,
        last_value(CASE WHEN op = 'PUT' THEN octet_length(encode(value)) WHEN op = 'DEL' THEN 0 END IGNORE NULLS) OVER (PARTITION BY key ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS below
      FROM log),
    c(owner, i, x, reads, hits) AS (
      SELECT DISTINCT owner, CAST(0 AS BIGINT), CAST([] AS STRUCT(k VARCHAR, n BIGINT)[]), CAST(0 AS BIGINT), CAST(0 AS BIGINT) FROM o
      UNION ALL SELECT owner, i, list_slice(x, coalesce(list_min(list_filter(range(1, len(x) + 2), lambda s: coalesce(list_sum(list_transform(list_slice(x, s, len(x)), lambda e: e.n)), 0) <= {limit})), 1), len(x)), reads, hits FROM (
        SELECT o.owner, o.i, c.reads + CASE WHEN o.op = 'GET' THEN 1 ELSE 0 END AS reads, c.hits + CASE WHEN o.op = 'GET' AND len(list_filter(c.x, lambda e: e.k = o.key)) > 0 THEN 1 ELSE 0 END AS hits,
          list_concat(list_filter(c.x, lambda e: e.k <> o.key), CASE
            WHEN o.op <> 'GET' THEN CAST([] AS STRUCT(k VARCHAR, n BIGINT)[])
            WHEN len(list_filter(c.x, lambda e: e.k = o.key)) > 0 THEN list_filter(c.x, lambda e: e.k = o.key)
            ELSE [CAST(struct_pack(k := o.key, n := octet_length(encode(o.key)) + coalesce(o.below, 0)) AS STRUCT(k VARCHAR, n BIGINT))] END) AS x
        FROM c JOIN o ON o.owner = c.owner AND o.i = c.i + 1)),
    done AS (SELECT owner, max(reads) AS reads, max(hits) AS hits FROM c GROUP BY owner)"""


@query(f"WITH RECURSIVE {_lru(200)} SELECT CAST(owner AS INT) AS owner, reads, hits, round(hits / reads, 6) AS ratio FROM done WHERE reads > 0")
def kv_lru_hit_ratio(spark, d):
    return folds.lru_hit_ratio(events.oplog(spark, d), 200)


# ---------------------------------------------------------------- buffers, flush, shutdown, caches

FITS = "CASE WHEN op = 'PUT' AND octet_length(encode(value)) > 8 THEN 'BUFFER_TOO_SMALL' ELSE {status} END AS status, CAST(CASE WHEN op = 'PUT' THEN octet_length(encode(value)) ELSE 0 END AS BIGINT) AS value_len, CASE WHEN op = 'PUT' AND octet_length(encode(value)) <= 8 THEN value END AS value"


@query(
    f"""WITH {LOG}, t AS (SELECT CASE WHEN epoch >= 8 THEN 0 WHEN epoch >= 4 THEN 1 ELSE 2 END AS tier, * FROM log WHERE op <> 'GET'),
    l AS (SELECT tier, key, arg_max(op, seq) AS op, arg_max(value, seq) AS value FROM t GROUP BY tier, key),
    f AS (SELECT key, CAST(min(tier) AS INT) AS tier, arg_min(op, tier) AS op, arg_min(coalesce(value, ''), tier) AS value FROM l GROUP BY key)
    SELECT p.key, tier, {FITS.format(status=STATUS)} FROM (SELECT CAST(range AS VARCHAR) AS key FROM range(200)) p LEFT JOIN f ON f.key = p.key"""
)
def kv_tier_lookup_buffered(spark, d):
    log = events.oplog(spark, d)
    tiers = [state.latest(log.where(c)) for c in ("epoch >= 8", "epoch >= 4 AND epoch < 8", "epoch < 4")]
    return state.tier_lookup(_probes(spark), tiers, 8)


@query(f"SELECT seq, key, {FITS.format(status=STATUS)} FROM (SELECT seq, key, CASE status WHEN 'FOUND' THEN 'PUT' WHEN 'DELETED' THEN 'DEL' END AS op, value FROM ({ORACLE_SQL['kv_fence_visibility']}))")
def kv_fence_visibility_buffered(spark, d):
    return consistency.replay_relaxed(events.oplog(spark, d), 8)


@query(f"WITH {LOG}, {GENS} SELECT p.key, {FITS.format(status=STATUS)} FROM (SELECT CAST(range AS VARCHAR) AS key FROM range(200)) p LEFT JOIN (SELECT key, CASE WHEN tombstone THEN 'DEL' ELSE 'PUT' END AS op, v AS value FROM newest) n ON n.key = p.key")
def kv_stored_read_buffered(spark, d):
    return storage.read(_stored(spark, d), _probes(spark), 8)


@query(f"WITH {LOG}, {GENS} SELECT '42' AS key, CASE WHEN gen IS NULL THEN 'NOT_FOUND' WHEN tombstone THEN 'DELETED' ELSE 'FOUND' END AS status, CASE WHEN NOT tombstone THEN v END AS value FROM (SELECT 1) LEFT JOIN newest ON key = '42'")
def kv_stored_point_read(spark, d):
    return storage.get_key(_stored(spark, d), "42", 42 % 4)


@query(f"WITH {LOG}, {GENS} SELECT key, gen, tombstone, CASE WHEN NOT tombstone THEN v END AS value FROM newest")
def kv_flush_and_close(spark, d):
    log, root = events.oplog(spark, d), fresh_folder(spark, "generations")
    storage.flush(log.where("epoch < 4"), root)
    storage.flush(log.where("epoch < 4"), root)
    return storage.newest(storage.close(log, root)).select("key", F.col("gen").cast("bigint").alias("gen"), "tombstone", "value")


@query(
    f"""WITH {LOG} SELECT seq, writer, key, epoch >= 3 AND epoch < 7 AND row_number() OVER (PARTITION BY writer, key, epoch >= 3 AND epoch < 7 ORDER BY seq) > 1 AS hit
    FROM log WHERE op = 'GET' AND writer <> owner"""
)
def kv_remote_cache_hits(spark, d):
    options = spark.createDataFrame([(0, "RELAXED", "READANDWRITE"), (3, "SEQUENTIAL", "READONLY"), (7, "SEQUENTIAL", "READANDWRITE")], "epoch bigint, consistency string, mode string")
    return consistency.remote_cache_hits(events.oplog(spark, d), options)


@query(f"WITH {LOG} SELECT key, op, value, seq FROM latest ORDER BY key")
def kv_sorted_run(spark, d):
    return state.sorted_run(events.oplog(spark, d))


@query(
    """SELECT CAST(n AS BIGINT) AS n, p, CAST(ceil(n * ln(p) / ln(0.6185)) AS BIGINT) AS bits, CAST(round(ceil(n * ln(p) / ln(0.6185)) / n * ln(2.0)) AS BIGINT) AS hashes
    FROM (SELECT unnest([5, 100, 1000, 1000000]) AS n) CROSS JOIN (SELECT unnest([CAST(0.05 AS DOUBLE), CAST(0.01 AS DOUBLE)]) AS p)"""
)
def bloom_sizing(spark, d):
    grid = spark.createDataFrame([(n, p) for n in (5, 100, 1000, 1000000) for p in (0.05, 0.01)], "n bigint, p double")
    return grid.select("n", "p", h.bloom_bits(F.col("n"), F.col("p")).alias("bits"), h.bloom_hashes(F.col("n"), F.col("p")).alias("hashes"))


@query(
    """SELECT CAST(range AS BIGINT) AS x, printf('%02X%02X%02X%02X', range & 255, (range >> 8) & 255, (range >> 16) & 255, (range >> 24) & 255) AS code, CAST(range AS BIGINT) AS back
    FROM range(500000)"""
)
def codec_roundtrip(spark, d):
    x = spark.range(500000).select(F.col("id").alias("x"))
    return x.withColumn("code", h.encode_int(F.col("x"))).withColumn("back", h.decode_int(F.col("code")))


# ---------------------------------------------------------------- workloads


@query("SELECT CAST(range % 4 AS INT) AS rank, CASE WHEN (range // 4) % 100 < 5 THEN 'UPDATE' ELSE 'GET' END AS op, count(*) AS n FROM range(40000) GROUP BY ALL")
def workload_mix(spark, d):
    return workload.mix(spark, 10000, 4, 5).groupBy("rank", "op").agg(F.count("*").alias("n"))


@query("SELECT CAST(range AS INT) AS rank, CAST(500 AS BIGINT) AS n, CAST(500 AS BIGINT) AS keys, 16 AS shortest, 16 AS longest, true AS in_charset FROM range(4)")
def workload_keys(spark, d):
    keys = workload.key_set(spark, 500, 4)
    return keys.groupBy("rank").agg(F.count("*").alias("n"), F.countDistinct("key").alias("keys"), F.min(F.length("key")).alias("shortest"), F.max(F.length("key")).alias("longest"), F.bool_and(F.col("key").rlike("^[a-zA-Z0-9]+$")).alias("in_charset"))


@query("SELECT CAST(range % 4 AS INT) AS rank, CASE WHEN range // 4 % 2 = 0 THEN 'FOUND' ELSE 'DELETED' END AS status, CAST(CASE WHEN range // 4 % 2 = 0 THEN 32 ELSE 0 END AS BIGINT) AS value_len, count(*) AS n FROM range(2000) GROUP BY ALL")
def workload_phases(spark, d):
    keys = workload.key_set(spark, 500, 4)
    ops = workload.put_phase(keys, 32).unionByName(workload.delete_phase(keys.where("i % 2 = 1")))
    log = ops.withColumn("seq", F.col("epoch") * 1_000_000 + F.col("i") * 4 + F.col("rank"))
    read = state.multi_get(log, keys.select("key")).join(keys, "key")
    return read.groupBy("rank", "status", "value_len").agg(F.count("*").alias("n"))


@query("SELECT CAST(range AS INT) AS rank, CAST(5000 AS BIGINT) AS n, CAST(100 AS BIGINT) AS keys, CAST(0 AS BIGINT) AS least, CAST(99 AS BIGINT) AS greatest, true AS even FROM range(4)")
def workload_probe(spark, d):
    ops = workload.uniform_probe(workload.mix(spark, 5000, 4, 5), 100, 7).groupBy("rank", "key_no").agg(F.count("*").alias("n"))
    return ops.groupBy("rank").agg(F.sum("n").alias("n"), F.count("*").alias("keys"), F.min("key_no").alias("least"), F.max("key_no").alias("greatest"), F.bool_and(F.col("n").between(20, 90)).alias("even"))


@query("SELECT CAST(16 AS BIGINT) AS key_len, v AS value_len, CAST((16 + v) * 10000 * 24 AS BIGINT) AS bytes, (16 + v) * 240000 / 1024.0 AS kb, (16 + v) * 240000 / 1048576.0 AS mb, (16 + v) * 240000 / 1073741824.0 AS gb FROM (SELECT CAST(unnest([256, 65536, 131072]) AS BIGINT) AS v)")
def dataset_size(spark, d):
    v = spark.createDataFrame([(16, n) for n in (256, 65536, 131072)], "key_len bigint, value_len bigint")
    return v.select("key_len", "value_len", *workload.dataset_size(F.col("key_len"), F.col("value_len"), F.lit(10000), F.lit(24)))


@query(f"WITH {M} SELECT db, min(t) AS t_min, max(t) AS t_max, round(sum(t), 2) AS t_sum, round(sum(t) / count(t), 4) AS t_avg FROM (SELECT db, rank, round(sum(optime), 2) AS t FROM m GROUP BY db, rank) GROUP BY db")
def reduce_min_max_avg(spark, d):
    t = events.measurements(spark, d).groupBy("db", "rank").agg(F.round(F.sum("optime"), 2).alias("t"))
    return workload.reduce_ranks(t, ["db"])


@query(f"WITH {M} SELECT db, round(7 * 1000 / a / 1000, 8) AS krps, round((16 + 131072) * 7 * 1000 / a / 1048576, 8) AS mbps FROM (SELECT db, sum(t) / count(t) AS a FROM (SELECT db, rank, round(sum(optime), 2) AS t FROM m GROUP BY db, rank) GROUP BY db)")
def krps_mbps(spark, d):
    t = events.measurements(spark, d).groupBy("db", "rank").agg(F.round(F.sum("optime"), 2).alias("t"))
    krps, mbps = workload.rates(F.lit(7), F.lit(1000), 16, 131072, F.sum("t") / F.count("t"))
    return t.groupBy("db").agg(F.round(krps, 8).alias("krps"), F.round(mbps, 8).alias("mbps"))


# ---------------------------------------------------------------- analytics

THROUGHPUT = "coalesce(count(optime) * 1e9 / nullif(sum(optime), 0) / 1024, 0)"


@query(f"WITH {M} SELECT db, op, rank, round({THROUGHPUT}, 4) AS throughput FROM m GROUP BY ALL")
def throughput_per_rank(spark, d):
    return a.throughput_per_rank(events.measurements(spark, d), ["db", "op"]).withColumn("throughput", F.round("throughput", 4))


@query(f"WITH {M} SELECT db, op, round(sum(t), 4) AS throughput FROM (SELECT db, op, rank, {THROUGHPUT} AS t FROM m GROUP BY ALL) GROUP BY ALL")
def throughput_total(spark, d):
    return a.throughput_total(events.measurements(spark, d), ["db", "op"]).withColumn("throughput", F.round("throughput", 4))


@query(f"WITH {M} SELECT db, op, round({THROUGHPUT}, 4) AS throughput FROM m GROUP BY ALL")
def throughput_micro(spark, d):
    return a.throughput_micro(events.measurements(spark, d), ["db", "op"]).withColumn("throughput", F.round("throughput", 4))


@query(f"WITH {M} SELECT db, round(sum(n / t * 1e9), 4) AS throughput FROM (SELECT db, rank, count(*) AS n, round(sum(optime), 2) AS t FROM m GROUP BY ALL) GROUP BY db")
def scalar_throughput(spark, d):
    t = events.measurements(spark, d).groupBy("db", "rank").agg(F.count("*").alias("count"), F.round(F.sum("optime"), 2).alias("value"))
    return a.scalar_throughput(t, ["db"]).withColumn("throughput", F.round("throughput", 4))


@query(f"WITH {M} SELECT db, op, round(sum(t) * 131072 / 1024, 2) AS bandwidth FROM (SELECT db, op, rank, {THROUGHPUT} AS t FROM m GROUP BY ALL) GROUP BY ALL")
def bandwidth(spark, d):
    t = a.throughput_total(events.measurements(spark, d), ["db", "op"])
    return a.bandwidth(t, F.lit(131072)).select("db", "op", F.round("bandwidth", 2).alias("bandwidth"))


@query(f"WITH {M} SELECT seq, rank, optime / 1e9 AS seconds, optime / 1e6 AS ms, optime / 1024 AS kib FROM m")
def unit_scale(spark, d):
    t = F.col("optime")
    return events.measurements(spark, d).select("seq", "rank", (t / 1e9).alias("seconds"), (t / 1e6).alias("ms"), (t / 1024).alias("kib"))


@query(f"WITH {M} SELECT db, CASE WHEN owner = rank THEN 'local' ELSE 'remote' END AS place, count(*) AS n, round(avg(optime), 4) AS mean FROM m GROUP BY ALL")
def local_remote_split(spark, d):
    return a.local_remote(events.measurements(spark, d)).groupBy("db", "place").agg(F.count("*").alias("n"), F.round(F.avg("optime"), 4).alias("mean"))


@query(f"WITH {M} SELECT db, count(*) AS n FROM m WHERE (db = 'R' OR db = 'A') AND op <> 'O' AND NOT (rank = 3) AND optime > 1000 GROUP BY db")
def predicate_and_or(spark, d):
    m = events.measurements(spark, d)
    return m.where(((F.col("db") == "R") | (F.col("db") == "A")) & (F.col("op") != "O") & ~(F.col("rank") == 3) & (F.col("optime") > 1000)).groupBy("db").agg(F.count("*").alias("n"))


@query(f"WITH {M} SELECT seq, rank, optime, 'put' AS optype, CAST(24 AS INT) AS rank_size FROM m")
def label_projection(spark, d):
    return a.label(events.measurements(spark, d).select("seq", "rank", "optime"), optype="put", rank_size=24)


@query(f"WITH {M} SELECT mode, count(*) AS n FROM (SELECT db || CASE WHEN op = 'F' THEN ' seq' WHEN run = 0 THEN ' rel' ELSE ' rel: ' || (run * 10) || '%' END AS mode FROM m) GROUP BY mode")
def mode_label(spark, d):
    m = events.measurements(spark, d)
    mode = F.concat("db", F.when(F.col("op") == "F", " seq").when(F.col("run") == 0, " rel").otherwise(F.concat(F.lit(" rel: "), (F.col("run") * 10).cast("string"), F.lit("%"))))
    return m.groupBy(mode.alias("mode")).agg(F.count("*").alias("n"))


@query(f"WITH {M} SELECT replace(CASE WHEN op = 'F' THEN 'update/get' ELSE 'put' END, 'update/get', 'get') AS optype, count(*) AS n FROM m GROUP BY 1")
def relabel(spark, d):
    optype = F.replace(F.when(F.col("op") == "F", "update/get").otherwise("put"), F.lit("update/get"), F.lit("get"))
    return events.measurements(spark, d).groupBy(optype.alias("optype")).agg(F.count("*").alias("n"))


@query(f"WITH {M} SELECT optype, count(*) AS n, round(sum(optime), 2) AS total FROM (SELECT 'put' AS optype, optime FROM m WHERE op = 'O' UNION ALL SELECT 'get', optime FROM m WHERE op = 'F' UNION ALL SELECT 'all', optime FROM m) GROUP BY optype")
def union_all(spark, d):
    m = events.measurements(spark, d)
    parts = [a.label(m.where("op = 'O'").select("optime"), optype="put"), a.label(m.where("op = 'F'").select("optime"), optype="get"), a.label(m.select("optime"), optype="all")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).groupBy("optype").agg(F.count("*").alias("n"), F.round(F.sum("optime"), 2).alias("total"))


@query(f"WITH {M} SELECT db, owner, count(DISTINCT rank) AS ranks FROM m GROUP BY ALL")
def distinct_owners(spark, d):
    return events.measurements(spark, d).groupBy("db", "owner").agg(F.countDistinct("rank").alias("ranks"))


@query(f"WITH {M} SELECT db, rank, run, seq, owner, optime, row_number() OVER (PARTITION BY db, rank, run ORDER BY seq, owner, optime) - 1 AS nth FROM m")
def op_sequence(spark, d):
    m = a.op_sequence(events.measurements(spark, d), ["db", "rank", "run"], ["seq", "owner", "optime"])
    return m.select("db", "rank", "run", "seq", "owner", "optime", F.col("nth").cast("bigint").alias("nth"))


@query("SELECT o_orderkey, o_orderpriority, o_orderstatus, row_number() OVER (PARTITION BY o_custkey % 8, o_orderpriority, o_orderstatus ORDER BY o_orderkey) - 1 AS run FROM orders")
def run_number(spark, d):
    o = events.read(spark, d, "orders").select("o_orderkey", "o_orderpriority", "o_orderstatus", (F.col("o_custkey") % 8).alias("file"))
    return a.run_number(o, "file", ["o_orderpriority", "o_orderstatus"], ["o_orderkey"]).select("o_orderkey", "o_orderpriority", "o_orderstatus", F.col("run").cast("bigint").alias("run"))


def _lines(spark: SparkSession, d: str) -> DataFrame:
    """Throughput lines made from orders, as text."""
    o = events.read(spark, d, "orders")
    part = lambda name, c: F.concat(F.lit(f"{name}:"), c.cast("string"))
    fields = [
        part("rank_count", F.lit(4) * (1 + F.col("o_custkey") % 4)), part("keylen", F.lit(16)), part("vallen", F.lit(131072)), part("count", F.lit(1000)),
        part("update_ratio", F.lit(5) * (F.col("o_orderkey") % 2)), part("batch_size", F.lit(1000)), part("put_time", F.col("o_orderkey") * 1000 + 1), part("get_update_time", F.col("o_custkey") * 1000 + 1),
    ]
    return o.select("o_orderkey", F.concat_ws(",", *fields).alias("value"))


PARSED = """l AS (SELECT o_orderkey, CAST(4 * (1 + o_custkey % 4) AS BIGINT) AS rank_count, CAST(5 * (o_orderkey % 2) AS BIGINT) AS update_ratio,
  CAST(o_orderkey * 1000 + 1 AS BIGINT) AS put_time, CAST(o_custkey * 1000 + 1 AS BIGINT) AS get_update_time FROM orders)"""


@query(f"WITH {PARSED} SELECT o_orderkey, rank_count, CAST(16 AS BIGINT) AS keylen, CAST(131072 AS BIGINT) AS vallen, CAST(1000 AS BIGINT) AS count, update_ratio, CAST(1000 AS BIGINT) AS batch_size, put_time, get_update_time FROM l")
def regex_parse(spark, d):
    return measurements.parse_lines(_lines(spark, d)).drop("value")


@query(f"WITH {PARSED} SELECT o_orderkey, rank_count, 'put' AS optype, put_time AS time FROM l UNION ALL SELECT o_orderkey, rank_count, 'update/get', get_update_time FROM l")
def unpivot_ops(spark, d):
    return a.unpivot_ops(measurements.parse_lines(_lines(spark, d)), ["o_orderkey", "rank_count"], {"put_time": "put", "get_update_time": "update/get"})


@query(f"WITH {M} SELECT db, op, rank, run, CAST(sum(seq) AS BIGINT) AS seq FROM m WHERE db IS NOT NULL AND op IS NOT NULL AND rank IS NOT NULL AND run IS NOT NULL GROUP BY ALL")
def group_sum(spark, d):
    return a.group_sum(events.measurements(spark, d), ["db", "op", "rank", "run"], "seq")


BOX = "SELECT db, rank, quantile_cont(optime, 0.25) AS q1, quantile_cont(optime, 0.5) AS median, quantile_cont(optime, 0.75) AS q3 FROM m GROUP BY ALL"


@query(f"WITH {M}, b AS ({BOX}) SELECT db, rank, round(q1, 6) AS q1, round(median, 6) AS median, round(q3, 6) AS q3 FROM b")
def box_stats(spark, d):
    return a.box_stats(events.measurements(spark, d), ["db", "rank"], "optime").select("db", "rank", *[F.round(c, 6).alias(c) for c in ("q1", "median", "q3")])


@query(
    f"""WITH {M}, b AS ({BOX}), j AS (SELECT m.db, m.rank, q1, median, q3, optime, optime BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1) AS inside FROM m JOIN b ON m.db = b.db AND m.rank = b.rank)
    SELECT db, rank, round(q1, 6) AS q1, round(median, 6) AS median, round(q3, 6) AS q3, min(optime) FILTER (inside) AS whisker_low, max(optime) FILTER (inside) AS whisker_high, count(*) FILTER (NOT inside) AS outliers FROM j GROUP BY ALL"""
)
def tukey_whiskers(spark, d):
    return a.whiskers(events.measurements(spark, d), ["db", "rank"], "optime").withColumns({c: F.round(c, 6) for c in ("q1", "median", "q3")})


@query(
    f"""WITH {M}, s AS (SELECT db, rank, optime * optime * optime AS x FROM m), b AS (SELECT db, rank, quantile_cont(x, 0.25) AS q1, quantile_cont(x, 0.75) AS q3 FROM s GROUP BY ALL)
    SELECT s.db, s.rank, s.x FROM s JOIN b ON s.db = b.db AND s.rank = b.rank WHERE NOT (x BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1))"""
)
def tukey_outliers(spark, d):
    x = events.measurements(spark, d).select("db", "rank", (F.col("optime") * F.col("optime") * F.col("optime")).alias("x"))
    return a.outliers(x, ["db", "rank"], "x")


@query(f"WITH {M} SELECT DISTINCT db, optime, count(*) OVER (PARTITION BY db, optime) AS n, round(cume_dist() OVER (PARTITION BY db ORDER BY optime), 9) AS share FROM m WHERE optime IS NOT NULL")
def ecdf(spark, d):
    return a.ecdf(events.measurements(spark, d), ["db"], "optime").withColumn("share", F.round("share", 9))


@query(f"WITH {M} SELECT db, CAST(floor(log10(optime) / 0.05) AS BIGINT) AS bin, count(*) AS n FROM m WHERE optime > 0 GROUP BY ALL")
def log_histogram(spark, d):
    return a.log_histogram(events.measurements(spark, d), ["db"], "optime")


@query(f"WITH {M} SELECT db, rank, round(avg(optime), 4) AS mean, round(coalesce(1.96 * stddev_samp(optime) / sqrt(count(optime)), 0), 4) AS half_width FROM m GROUP BY ALL")
def mean_line(spark, d):
    return a.mean_line(events.measurements(spark, d), ["db", "rank"], "optime").select("db", "rank", F.round("mean", 4).alias("mean"), F.round("half_width", 4).alias("half_width"))


# ---------------------------------------------------------------- measurement files, written and read back


@query(f"WITH {M} SELECT optime, owner, count(*) AS n FROM m WHERE run = 3 GROUP BY ALL")
def source_optimes(spark, d):
    m, root = events.measurements(spark, d).where("run = 3"), fresh_folder(spark, "optimes")
    measurements.write_optimes(m.select("db", "run", "op", "rank", "optime", "owner").withColumn("optime", F.col("optime").cast("double")), root)
    return measurements.read_optimes(spark, root, "*.csv").groupBy("optime", "owner").agg(F.count("*").alias("n"))


@query(
    f"""WITH {M} SELECT db, run AS ratio, CAST(24 AS INT) AS ranks, rank AS run, CASE WHEN run % 2 = 0 THEN owner END AS mem_table_size, CASE op WHEN 'F' THEN 'get' ELSE 'put_total' END AS op, rank,
    16 AS key_size, CAST(power(2, run) AS INT) AS value_size, count(*) AS n FROM m GROUP BY ALL"""
)
def path_dimensions(spark, d):
    m = events.measurements(spark, d)
    part = lambda *c: F.concat(*[x if not isinstance(x, str) else F.lit(x) for x in c])
    path = part("file:/data/16ksize", F.pow(F.lit(2), F.col("run")).cast("int").cast("string"), "vsize/", F.col("db"), "/ratio", F.col("run").cast("string"), "/ranks24/run", F.col("rank").cast("string"), F.when(F.col("run") % 2 == 0, part("/mt", F.col("owner").cast("string"))).otherwise(""), "/", F.when(F.col("op") == "F", "get").otherwise("put_total"), F.col("rank").cast("string"), ".txt")
    dimensions = measurements.path_dimensions(F.col("path"))
    found = m.select(path.alias("path")).groupBy("path").agg(F.count("*").alias("n"))
    return found.select(*[c.alias(n) for n, c in dimensions.items()], "n").groupBy(*dimensions).agg(F.sum("n").alias("n"))


@query(f"WITH {PARSED} SELECT rank_count, update_ratio, CAST(16 AS BIGINT) AS keylen, count(*) AS n, CAST(sum(put_time) AS BIGINT) AS put_time, CAST(sum(get_update_time) AS BIGINT) AS get_update_time FROM l GROUP BY ALL")
def source_lines(spark, d):
    root = fresh_folder(spark, "lines")
    _lines(spark, d).select("value").write.text(root)
    found = measurements.read_lines(spark, root, "*.txt")
    return found.groupBy("rank_count", "update_ratio", "keylen").agg(F.count("*").alias("n"), F.sum("put_time").alias("put_time"), F.sum("get_update_time").alias("get_update_time"))


@query("SELECT CAST(n_nationkey AS BIGINT) * 1000003 AS value FROM nation")
def source_scalars(spark, d):
    root = fresh_folder(spark, "scalars")
    n = events.read(spark, d, "nation")
    n.select((F.col("n_nationkey").cast("bigint") * 1000003).cast("string").alias("value"), F.col("n_nationkey").alias("rank")).write.partitionBy("rank").text(root)
    return measurements.read_scalars(spark, root, "*.txt").select("value")


@query("SELECT p_type AS bench_name, p_size AS key_len, CAST(p_partkey % 2 AS INT) AS equal, p_partkey * 7 AS cycles FROM part")
def source_csv(spark, d):
    root = fresh_folder(spark, "csv")
    p = events.read(spark, d, "part")
    p.select(F.col("p_type").alias("bench_name"), F.col("p_size").alias("key_len"), (F.col("p_partkey") % 2).cast("int").alias("equal"), (F.col("p_partkey") * 7).alias("cycles")).write.option("header", "true").csv(root)
    return measurements.read_csv(spark, root)


@query("SELECT CAST(row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) - 1 AS INT) AS nth, (n_nationkey * 1000 + 17) / 1000.0 AS runtime, count(*) OVER (PARTITION BY n_regionkey) AS of_file FROM nation")
def source_runtimes(spark, d):
    root = fresh_folder(spark, "runtimes")
    n = events.read(spark, d, "nation").repartition("n_regionkey").sortWithinPartitions("n_regionkey", "n_nationkey")
    text = F.concat(F.lit("[READ], Operations, 5\n[OVERALL], RunTime(ms), "), (F.col("n_nationkey") * 1000 + 17).cast("string"), F.lit("\n[OVERALL], Throughput(ops/sec), 1.5"))
    n.select(text.alias("value"), "n_regionkey").write.partitionBy("n_regionkey").text(root)
    found = measurements.read_runtimes(spark, root, "*.txt")
    return found.join(found.groupBy("file").agg(F.count("*").alias("of_file")), "file").select("nth", "runtime", "of_file")


# ---------------------------------------------------------------- streams


@query(f"WITH {LOG} SELECT key, op, value, seq FROM latest")
def stream_lww(spark, d):
    return streams.stream_lww(spark, d)


@query(f"WITH RECURSIVE {_lru(200)} SELECT CAST(owner AS INT) AS owner, reads, hits FROM done WHERE reads > 0")
def stream_lru(spark, d):
    return streams.stream_lru(spark, d, 200)
