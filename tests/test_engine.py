"""The engine's operators on literal sets, traces and simulations."""

import random
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidelog.functions import hashing
from tidelog.model import OPLOG, STATUS, KVOptions
from tidelog.operators import analytics, consistency, folds, state, storage, workload
from tidelog.operators.tables import fresh_folder, running_total
from tidelog.sources import measurements
from tidelog.store import Store
from tidelog.streaming import streams


def log(spark, rows):
    """rows: (seq, epoch, writer, owner, op, key, value)"""
    return spark.createDataFrame(rows, OPLOG)


def one(df):
    r = df.collect()
    assert len(r) == 1
    return r[0]


API = [(0, 0, 0, 1, "PUT", "1key", "1value"), (1, 0, 0, 0, "PUT", "2key", "2value"), (2, 0, 1, 1, "PUT", "3key", "3value")]


def test_codes():
    assert STATUS == {"NOT_FOUND": 0, "FOUND": 1, "DELETED": 2, "BUFFER_TOO_SMALL": 3, "NOT_IN_CACHE": 4}


def test_options():
    o = KVOptions()
    assert (o.max_local_memtable_size, o.dispatch_batch_size, o.consistency, o.mode) == (1_000_000, 1000, "RELAXED", "READANDWRITE")
    assert o.with_(consistency="SEQUENTIAL").consistency == "SEQUENTIAL" and o.consistency == "RELAXED"
    assert KVOptions.from_env({"MAX_LOCAL_MEMTABLE_SIZE": "7", "DISPATCH_IN_CHUNKS": "0", "STORAGE_LOCATION": "/x"}) == o.with_(max_local_memtable_size=7, dispatch_in_chunks=False, storage_location="/x")
    with pytest.raises(TypeError):
        o.with_(nothing=1)


def test_get_put_overwrite_delete(spark):
    empty = log(spark, [])
    assert one(state.get(empty, "1key"))["status"] == "NOT_FOUND"
    some = log(spark, API)
    assert tuple(one(state.get(some, "2key"))) == ("2key", "FOUND", "2value")
    more = state.put(some, log(spark, [(3, 0, 0, 1, "PUT", "1key", "new"), (4, 0, 0, 0, "DEL", "2key", None), (5, 0, 0, 0, "PUT", "4key", "")]))
    assert one(state.get(more, "1key"))["value"] == "new"
    assert tuple(one(state.get(more, "2key"))) == ("2key", "DELETED", None)
    assert tuple(one(state.get(more, "4key"))) == ("4key", "FOUND", "")
    assert [r["key"] for r in state.tombstones(more).collect()] == ["2key"]
    assert [r["key"] for r in state.sorted_run(more).collect()] == ["1key", "2key", "3key", "4key"]


def test_buffers(spark):
    some = log(spark, [(0, 0, 0, 0, "PUT", "key", "value"), (1, 0, 0, 0, "PUT", "u", "é")])
    assert tuple(one(state.get_buffered(some, "key", 5))) == ("key", "FOUND", 5, "value")
    for size in (3, 0):
        assert tuple(one(state.get_buffered(some, "key", size))) == ("key", "BUFFER_TOO_SMALL", 5, None)
    assert tuple(one(state.get_buffered(some, "nonexistent", 200))) == ("nonexistent", "NOT_FOUND", 0, None)
    assert one(state.get_buffered(some, "u", 1))["value_len"] == 2


def test_memtable_and_cache_bytes():
    table, cache = folds.Memtable(), folds.LRUCache(1000)
    for key, value, t, c in ((b"key", b"value", 9, 8), (b"key", b"overwrite", 13, 12), (b"another_key", b"another_value", 38, 36)):
        table.put(key, len(value))
        cache.put(key, "FOUND", len(value))
        assert (table.bytes, cache.bytes) == (t, c)
    small = folds.LRUCache(25)
    small.put(b"key", "FOUND", 5)
    small.put(b"another_key", "FOUND", 13)
    assert small.get(b"key") is None and small.get(b"another_key") == ("FOUND", 13)
    small.put(b"k" * 30, "NOT_FOUND", 0)
    assert small.bytes == 0 and not small.entries
    small.put(b"a", "FOUND", 1)
    small.invalidate([b"a", b"b"])
    assert small.bytes == 0


def test_rollover_at_zero_seals_every_entry(spark):
    some = log(spark, [(i, 0, 0, i % 2, "PUT", f"key{i}", f"value{i}") for i in range(100)])
    got = folds.memtable_rollover(some, 0).collect()
    assert len(got) == 100 and all(r["entries"] == 1 for r in got)


def test_rollover_and_lru_against_models(spark):
    rnd = random.Random(8)
    rows = [(i, 0, 0, (k := rnd.randint(0, 40)) % 4, rnd.choice(("PUT", "DEL", "GET", "GET")), str(k), "v" * rnd.randint(0, 30)) for i in range(2000)]
    want, tables = [], {}
    for seq, _, _, o, op, k, v in rows:
        if op != "GET":
            t = tables.setdefault(o, {})
            t[k] = len(v) if op == "PUT" else 0
            size = sum(len(a) + b + 1 for a, b in t.items())
            if size > 200:
                want.append((o, seq, len(t), size))
                tables[o] = {}
    got = folds.memtable_rollover(log(spark, rows), 200).collect()
    assert sorted((r["owner"], r["last_seq"], r["entries"], r["bytes"]) for r in got) == sorted(want)
    caches, store, want = {}, {}, []
    for seq, _, _, o, op, k, v in rows:
        cache = caches.setdefault(o, [])  # (key, size), most recent last
        if op != "GET":
            store[k] = v if op == "PUT" else None
            cache[:] = [c for c in cache if c[0] != k]
            continue
        hit = next((c for c in cache if c[0] == k), None)
        if hit:
            cache.remove(hit)
        entry = hit or (k, len(k) + len(store.get(k) or ""))
        cache.append(entry)
        while sum(c[1] for c in cache) > 60:
            cache.pop(0)
        want.append((seq, "NOT_FOUND" if k not in store else "DELETED" if store[k] is None else "FOUND", hit is not None))
    got = folds.lru_reads(log(spark, rows), 60).collect()
    assert sorted((r["seq"], r["status"], r["hit"]) for r in got) == want


TRACE = [
    (0, 0, 0, 1, "PUT", "1key", "1value"), (1, 0, 0, 1, "GET", "1key", None), (2, 0, 1, 1, "GET", "1key", None), (3, 0, 1, 1, "PUT", "1key", "2value"),
    (4, 0, 0, 1, "GET", "1key", None), (6, 1, 1, 1, "GET", "1key", None), (7, 1, 0, 0, "DEL", "2key", None), (8, 1, 1, 0, "GET", "2key", None),
]


def test_golden_trace(spark):
    relaxed = {r["seq"]: (r["status"], r["value"]) for r in consistency.replay_relaxed(log(spark, TRACE)).collect()}
    assert relaxed == {1: ("FOUND", "1value"), 2: ("NOT_FOUND", None), 4: ("FOUND", "1value"), 6: ("FOUND", "1value"), 8: ("DELETED", None)}
    strict = {r["seq"]: (r["status"], r["value"]) for r in consistency.replay_sequential(log(spark, TRACE)).collect()}
    assert strict == {1: ("FOUND", "1value"), 2: ("FOUND", "1value"), 4: ("FOUND", "2value"), 6: ("FOUND", "2value"), 8: ("DELETED", None)}


def simulate(rows, ranks):
    """Event by event: a store for each owner, a buffer for each rank, sent at fences after the owner's own writes."""
    stores, buffers, epoch, out = [{} for _ in range(ranks)], [[] for _ in range(ranks)], 0, {}
    for seq, e, w, o, op, k, v in rows:
        while epoch < e:
            for s, rank, key, value in sorted((s, r, key, value) for r, b in enumerate(buffers) for s, key, value, _ in b):
                owner = next(x[3] for x in buffers[rank] if x[0] == s)
                stores[owner][key] = value
            buffers = [[] for _ in range(ranks)]
            epoch += 1
        if op != "GET":
            value = ("PUT", v) if op == "PUT" else ("DEL", None)
            if w == o:
                stores[o][k] = value
            else:
                buffers[w].append((seq, k, value, o))
        else:
            own = [x[2] for x in buffers[w] if x[1] == k] if w != o else []
            found = own[-1] if own else stores[o].get(k)
            out[seq] = ("NOT_FOUND", None) if found is None else ("FOUND", found[1]) if found[0] == "PUT" else ("DELETED", None)
    return out


@pytest.mark.parametrize("seed", range(3))
def test_relaxed_equals_a_simulation(spark, seed):
    rnd = random.Random(seed)
    rows, epoch = [], 0
    for i in range(1500):
        epoch += rnd.random() < 0.02
        k = rnd.randint(0, 9)
        rows.append((i, epoch, rnd.randint(0, 3), k % 4, rnd.choice(("PUT", "PUT", "DEL", "GET", "GET")), str(k), f"v{i}"))
    got = {r["seq"]: (r["status"], r["value"]) for r in consistency.replay_relaxed(log(spark, rows)).collect()}
    assert got == simulate(rows, 4)
    state_now = {}
    for seq, _, _, _, op, k, v in rows:
        if op == "GET":
            state_now[seq] = state_now.get(("k", k), ("NOT_FOUND", None))
        else:
            state_now["k", k] = ("FOUND", v) if op == "PUT" else ("DELETED", None)
    got = {r["seq"]: (r["status"], r["value"]) for r in consistency.replay_sequential(log(spark, rows)).collect()}
    assert got == {s: v for s, v in state_now.items() if isinstance(s, int)}


def test_strict_readonly_leaves_out_writes(spark):
    options = spark.createDataFrame([(0, "RELAXED", "READANDWRITE"), (1, "SEQUENTIAL", "READONLY")], "epoch bigint, consistency string, mode string")
    rows = log(spark, [(0, 0, 0, 0, "PUT", "a", "1"), (1, 1, 0, 0, "PUT", "a", "2"), (2, 1, 0, 0, "GET", "a", None)])
    assert consistency.options_timeline(rows, options).count() == 3
    assert [r["seq"] for r in consistency.options_timeline(rows, options, strict=True).orderBy("seq").collect()] == [0, 2]


def test_generations(spark):
    pad = lambda s: s.ljust(64, "\0")
    runs = [(i, 1, 0, 0, "PUT", pad(str(i + 1) * (i + 1)), pad(w)) for i, w in enumerate(("one", "two", "three", "four"))]
    root = fresh_folder(spark, "test")
    storage.checkpoint(storage.run_of(log(spark, runs)), root)
    storage.checkpoint(storage.run_of(log(spark, [(9, 2, 0, 0, "DEL", pad("22"), None)])), root)
    store = storage.open_store(spark, root)
    assert storage.highest_generation(store) == 2
    probes = spark.createDataFrame([(pad(k),) for k in ("22", "1", "55555")], "key string")
    assert {r["key"].rstrip("\0"): r["status"] for r in storage.read(store, probes).collect()} == {"22": "DELETED", "1": "FOUND", "55555": "NOT_FOUND"}
    assert storage.read_key(store, pad("22"), 0).first()["tombstone"]
    assert storage.merge(store).count() == 3
    storage.drop_store(spark, root)
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        storage.open_store(spark, root)


def test_hashes(spark):
    assert hashing.murmur3_x86_32(b"", 1) == 0x514E28B7
    assert hashing.murmur3_x86_32(b"test", 0x9747B28C) == 0x704B81DC
    assert hashing.int_with_hash(1) == -1910889132 and hashing.int_with_hash(7) == 405075492
    keys = ["abcdefghijklmnop", "0123", "x" * 64, "odd", "fives", ""]
    df = spark.createDataFrame([(k,) for k in keys], "key string")
    for seed in (1, 7, 12345):
        for r in df.select("key", hashing.hash_native(F.col("key"), seed).alias("n"), hashing.hash_exact(F.col("key"), seed).alias("e")).collect():
            assert r["e"] == hashing.murmur3_x86_32(r["key"].encode(), seed)
            if len(r["key"]) % 4 == 0:
                assert r["n"] == r["e"]
    got = df.where("key != ''").select("key", hashing.owner_of(hashing.first_digit_hash(F.col("key")), 2).alias("owner"))
    assert hashing.with_owner_predicate(got, "0123", hashing.first_digit_hash, 2).count() == 1


def test_bloom():
    b = hashing.Bloom(5, 0.05)
    assert (b.size, b.hashes) == (32, 4)
    rng = np.random.default_rng(1)
    present, absent = rng.integers(-(1 << 62), 1 << 62, 2000), rng.integers(-(1 << 62), 1 << 62, 20000)
    b = hashing.Bloom(2000, 0.01)
    b.insert(present)
    assert b.contains(present).all() and b.contains(absent).mean() < 0.02
    assert (hashing.Bloom(2000, 0.01, b.to_bytes()).contains(absent) == b.contains(absent)).all()
    assert hashing.Bloom(0).hashes == 0


def test_codec(spark):
    got = spark.createDataFrame([(x,) for x in (0, 1, 255, 499_999, 2**32 - 1)], "x bigint").select("x", hashing.encode_int(F.col("x")).alias("c"))
    for r in got.withColumn("b", hashing.decode_int(F.col("c"))).collect():
        assert bytes.fromhex(r["c"]) == struct.pack("<I", r["x"]) and r["b"] == r["x"]


def test_order_of_keys_is_bytewise(spark):
    keys = [b"", b"\x7f", b"\x7f\x00", b"\x80", b"\x00"]
    got = spark.createDataFrame([(k,) for k in keys], "key binary").orderBy("key").collect()
    assert [bytes(r[0]) for r in got] == sorted(keys)


def test_workload(spark):
    keys = workload.key_set(spark, 50, 4).collect()
    assert len({r["key"] for r in keys}) == 200 and all(len(r["key"]) == 16 and set(r["key"]) <= set(workload.CHARSET) for r in keys)
    ops = workload.mix(spark, 200, 2, 5)
    assert ops.where("op = 'UPDATE'").count() == 20
    assert workload.uniform_probe(ops, 10, 1).where("key_no < 0 OR key_no >= 10").count() == 0
    puts, gone = workload.put_phase(workload.key_set(spark, 5, 2), 7), workload.delete_phase(workload.key_set(spark, 5, 2))
    both = puts.union(gone).withColumn("seq", F.col("epoch") * 100 + F.col("i"))
    assert state.live(both).count() == 0 and state.tombstones(both).count() == 10


def test_measurement_files(spark, tmp_path):
    base = tmp_path / "exp" / "storeA" / "ratio5" / "ranks2" / "run3"
    base.mkdir(parents=True)
    (base / "get0.txt").write_text("100.0 0\n200.0 1\n")
    (base / "put1.txt").write_text("")
    (base / "put_total0.txt").write_text("12345\n")
    got = measurements.read_optimes(spark, str(tmp_path), "get*.txt").collect()
    assert [(r["optime"], r["owner"], r["db"], r["ratio"], r["ranks"], r["run"], r["op"], r["rank"]) for r in got] == [(100.0, 0, "storeA", 5, 2, 3, "get", 0), (200.0, 1, "storeA", 5, 2, 3, "get", 0)]
    assert [r["value"] for r in measurements.read_scalars(spark, str(tmp_path)).collect()] == [12345]
    line = "rank_count:4,keylen:16,vallen:8,count:10,update_ratio:5,batch_size:1000,put_time:77,get_update_time:88"
    (tmp_path / "out0.txt").write_text(f"{line}\n{line}\nbroken\n{line}\n")
    (tmp_path / "out1.txt").write_text(f"{line}\n")
    got = measurements.read_lines(spark, str(tmp_path))
    assert got.count() == 3 and {r["put_time"] for r in got.collect()} == {77}
    assert sorted(r["run"] for r in analytics.run_number(got.drop("run"), "file", ["rank_count", "keylen"], ["line_no"]).collect()) == [0, 0, 1]
    (tmp_path / "run.txt").write_text("x\n[OVERALL], RunTime(ms), 1500\n[READ], 1\n[OVERALL], RunTime(ms), 2000\n")
    assert [r["runtime"] for r in measurements.read_runtimes(spark, str(tmp_path)).orderBy("nth").collect()] == [1.5, 2.0]
    (tmp_path / "c.csv").write_text("bench_name,key_len,equal,cycles\nv,8,1,99\n")
    assert tuple(one(measurements.read_csv(spark, str(tmp_path / "c.csv")))) == ("v", 8, 1, 99)
    out = tmp_path / "sink"
    frame = spark.createDataFrame([("s", 1, 5.0, 2)], "db string, run int, optime double, owner int")
    measurements.write_optimes(frame, str(out))
    assert next(out.glob("db=s/run=1/*.csv")).read_text() == "5.0 2\n"
    measurements.write_run_config(spark, {"rank_count": 4, "keylen": 16}, str(tmp_path / "runconfig"))
    assert spark.read.text(str(tmp_path / "runconfig")).count() == 2


def test_throughput_of_nothing_is_zero(spark):
    none = spark.createDataFrame([(1, None)], "rank int, optime double")
    assert one(analytics.throughput_per_rank(none, []))["throughput"] == 0.0


def test_group_sum_drops_null_keys(spark):
    df = spark.createDataFrame([("a", 1), (None, 5), ("a", 2)], "k string, v int")
    assert [tuple(r) for r in analytics.group_sum(df, ["k"], "v").collect()] == [("a", 3)]


def test_streams_equal_the_batch(spark, tmp_path):
    from tidelog.sources.events import oplog, read

    d = "/root/testdata/sf0.001"
    folder = tmp_path / "events.parquet"
    read(spark, d, "events").repartition(4).write.parquet(str(folder))
    want = sorted(tuple(r) for r in state.latest(oplog(spark, d)).collect())
    for source in (d, str(tmp_path)):
        assert sorted(tuple(r) for r in streams.stream_lww(spark, source).collect()) == want
    batch = {r["owner"]: (r["reads"], r["hits"]) for r in folds.lru_hit_ratio(oplog(spark, d)).collect()}
    assert {r["owner"]: (r["reads"], r["hits"]) for r in streams.stream_lru(spark, d).collect()} == batch


class CountedState:
    """A map state and a value state of a stream, and the calls on them."""

    def __init__(self):
        self.entries, self.calls = {}, 0

    def getMapState(self, *_):  # noqa: N802
        return self

    def getValueState(self, *_):  # noqa: N802
        return CountedState()

    def exists(self):
        return None in self.entries

    def get(self):
        return self.entries[None]

    def update(self, value):
        self.entries[None] = value

    def containsKey(self, key):  # noqa: N802
        self.calls += 1
        return key in self.entries

    def getValue(self, key):  # noqa: N802
        self.calls += 1
        return self.entries.get(key)

    def updateValue(self, key, value):  # noqa: N802
        self.calls += 1
        self.entries[key] = value


def test_stream_touches_the_state_of_a_key_once_a_batch():
    import pandas as pd

    rng, held, cache = random.Random(5), {}, folds.LRUCache(40)
    map_state, reads = CountedState(), streams.CachedReads(40)
    reads.init(map_state)
    for batch in range(3):
        rows = [(batch * 2000 + i, rng.choice(["PUT", "DEL", "GET", "GET"]), f"k{rng.randrange(12)}", "v" * rng.randrange(9)) for i in range(2000)]
        want = []
        for seq, op, key, value in rows:
            below, n = held.get(key, (None, 0))
            found = folds.through_cache(cache, op, key.encode(), below, n)
            if op != "GET":
                held[key] = (op, len(value) if op == "PUT" else 0)
            if found is not None:
                want.append((0, seq, *found))
        rng.shuffle(rows)
        df = pd.DataFrame(rows, columns=["seq", "op", "key", "value"])
        df["n"] = [len(v) if op == "PUT" else 0 for op, v in zip(df["op"], df["value"])]
        got = reads.handleInputRows((0,), iter([df[:700], df[700:]]), None)
        assert [r for frame in got for r in frame.itertuples(index=False, name=None)] == want
    assert map_state.calls <= 3 * 3 * 12  # it was several for each row


def test_codec_roundtrip_over_the_whole_range(spark):
    x = spark.range(500000).withColumn("code", hashing.encode_int(F.col("id")))
    bad = x.where(~hashing.decode_int(F.col("code")).eqNullSafe(F.col("id")) | (F.length("code") != 8) | F.col("code").isNull())
    assert x.count() == 500000 and bad.count() == 0


def test_buffered_reads_on_every_path(spark):
    some = log(spark, [(0, 0, 0, 0, "PUT", "key", "value"), (1, 1, 0, 0, "GET", "key", None), (2, 1, 0, 0, "DEL", "key", None), (3, 1, 0, 0, "GET", "key", None), (4, 1, 0, 0, "GET", "none", None)])
    for size, first in ((5, ("FOUND", 5, "value")), (3, ("BUFFER_TOO_SMALL", 5, None)), (0, ("BUFFER_TOO_SMALL", 5, None))):
        for replay in (consistency.replay_sequential, consistency.replay_relaxed):
            got = {r["seq"]: (r["status"], r["value_len"], r["value"]) for r in replay(some, size).collect()}
            assert got == {1: first, 3: ("DELETED", 0, None), 4: ("NOT_FOUND", 0, None)}
        probes = spark.createDataFrame([("key",), ("none",)], "key string")
        tier = state.latest(some.where("epoch = 0"))
        assert {r["key"]: (r["status"], r["value_len"], r["value"]) for r in state.tier_lookup(probes, [tier], size).collect()} == {"key": first, "none": ("NOT_FOUND", 0, None)}
        store = storage.run_of(some.where("epoch = 0"))
        assert {r["key"]: (r["status"], r["value_len"], r["value"]) for r in storage.read(store, probes, size).collect()} == {"key": first, "none": ("NOT_FOUND", 0, None)}
        assert tuple(one(storage.get_key(store, "key", 0, size)))[1:] == first
    assert tuple(one(storage.get_key(storage.run_of(some), "key", 0))) == ("key", "DELETED", None)
    assert tuple(one(storage.get_key(storage.run_of(some), "none", 0))) == ("none", "NOT_FOUND", None)


def test_cache_size_and_clear():
    cache = folds.LRUCache(100)
    assert len(cache) == 0
    cache.put(b"key", "FOUND", 5)
    cache.put(b"another_key", "FOUND", 13)
    assert len(cache) == 32
    cache.put(b"key", "FOUND", 9)
    assert len(cache) == 36
    cache.clear()
    assert len(cache) == 0 and cache.get(b"key") is None
    cache.put(b"key", "FOUND", 5)
    assert len(cache) == 8


def read_rows(df):
    """Rows that the scans of a plan gave to it."""
    df.collect()
    plan, found = df._jdf.queryExecution().executedPlan(), []

    def visit(node):
        if "Scan" in node.nodeName():
            found.append(node.metrics().get("numOutputRows").get().value())
        children = node.children()
        for i in range(children.size()):
            visit(children.apply(i))

    visit(plan)
    return sum(found)


def test_bloom_filters_are_sized_by_rows_and_prune(spark, tmp_path):
    import glob
    import os

    def rows(gen, n):
        return [(i, gen, 0, 0, "PUT", f"key{2 * i:06}", "v") for i in range(n)]

    root = str(tmp_path / "store")
    storage.checkpoint(storage.run_of(log(spark, rows(1, 10) + rows(2, 3000))), root)
    size = {g: sum(os.path.getsize(f) for f in glob.glob(f"{root}/gen={g}/*/*.parquet")) for g in (1, 2)}
    assert size[1] < 3000 and size[2] < 60_000  # an unsized filter takes a megabyte
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        store = storage.open_store(spark, root).where("gen = 2")
        assert read_rows(storage.of_key(store, "key000200", 0)) > 0
        absent = [read_rows(storage.of_key(store, f"key{i:06}", 0)) for i in range(201, 241, 2)]  # inside the bounds, not in the run
        assert sum(n == 0 for n in absent) >= 18
        plain = str(tmp_path / "plain")
        store.drop("gen", "owner").coalesce(1).sortWithinPartitions("key").write.option("parquet.enable.dictionary", "false").parquet(plain)
        assert read_rows(spark.read.parquet(plain).where("key = 'key000201'")) > 0  # no filter, nothing pruned
        assert read_rows(storage.of_key(storage.open_store(spark, root), "key000200", 7)) == 0  # no such owner: no folder is read
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")


def test_many_generations_share_folders(spark, tmp_path):
    import glob

    root = str(tmp_path / "store")
    some = log(spark, [(i, i // 4, 0, i % 2, "DEL" if i % 7 == 6 else "PUT", f"k{i % 6}", None if i % 7 == 6 else f"v{i}") for i in range(800)])
    storage.checkpoint(storage.run_of(some), root)
    assert len(glob.glob(f"{root}/*/*/*.parquet")) <= 2 * storage.FOLDERS  # of 200 generations of two owners
    store = storage.open_store(spark, root)
    whole = ["gen", "owner", "key", "tombstone", "value"]
    assert sorted(map(repr, store.select(whole).collect())) == sorted(map(repr, storage.run_of(some).select(whole).collect()))
    assert storage.highest_generation(store) == 199 and store.where("gen = 150").count() == 4
    assert storage.flush(some, root) == 199 and storage.open_store(spark, root).count() == 800  # nothing is written twice
    assert storage.read_key(store, "k1", 1).first()["value"] == "v799"
    storage.run_of(log(spark, [(900, 500, 0, 1, "DEL", "k1", None)])).write.partitionBy("gen", "owner").mode("append").parquet(root)
    assert storage.read_key(storage.open_store(spark, root), "k1", 1).first()["gen"] == 500  # files without a row's own generation


def test_flush_close_and_reopen(spark, tmp_path):
    root = str(tmp_path / "store")
    some = log(spark, [(i, i // 4, 0, 0, "DEL" if i % 5 == 4 else "PUT", f"k{i % 3}", None if i % 5 == 4 else f"v{i}") for i in range(12)])
    assert storage.flush(some.where("epoch = 0"), root) == 0
    assert storage.flush(some.where("epoch = 0"), root) == 0  # nothing is written twice
    store = storage.close(some, root)
    assert sorted((r["key"], r["value"]) for r in storage.newest(store).collect()) == sorted((r["key"], r["value"]) for r in state.latest(some).collect())
    assert store.groupBy("gen", "key").count().where("count > 1").count() == 0
    assert storage.flush(log(spark, []), str(tmp_path / "none")) == -1


def test_facade(spark, tmp_path):
    root = str(tmp_path / "facade")
    db = Store(spark, root, ranks=4)
    assert (db.options.consistency, db.options.mode) == ("SEQUENTIAL", "READANDWRITE")
    db.put("1key", "1value")
    db.put("2key", "2value")
    db.put("1key", "new")
    assert tuple(db.get("1key")) == ("1key", "FOUND", "new") and db.get("3key")["status"] == "NOT_FOUND"
    assert tuple(db.get("1key", 2)) == ("1key", "BUFFER_TOO_SMALL", 3, None)
    db.checkpoint()
    db.delete("2key")
    assert db.get("2key")["status"] == "DELETED" and db.get("1key")["value"] == "new"
    db.put_all(spark.createDataFrame([("4key", "a"), ("4key", "b")], "key string, value string"))
    assert db.get("4key")["value"] == "b"
    db.finalize()
    again = Store(spark, root, ranks=4)
    assert [again.get(k)["status"] for k in ("1key", "2key", "3key", "4key")] == ["FOUND", "DELETED", "NOT_FOUND", "FOUND"]
    again.put("2key", "back")
    again.checkpoint()
    assert Store(spark, root, ranks=4).get("2key")["value"] == "back"


def test_remote_answers_are_cached_while_nothing_may_change(spark):
    some = log(spark, [(0, 0, 1, 1, "PUT", "1key", "v"), (1, 0, 0, 1, "GET", "1key", None), (2, 0, 0, 1, "GET", "1key", None), (3, 1, 0, 1, "GET", "1key", None), (4, 1, 0, 1, "GET", "1key", None), (5, 2, 0, 1, "GET", "1key", None), (6, 3, 0, 1, "GET", "1key", None), (7, 1, 1, 1, "GET", "1key", None)])
    options = spark.createDataFrame([(0, "SEQUENTIAL", "READANDWRITE"), (1, "SEQUENTIAL", "READONLY"), (3, "RELAXED", "READONLY")], "epoch bigint, consistency string, mode string")
    got = {r["seq"]: r["hit"] for r in consistency.remote_cache_hits(some, options).collect()}
    assert got == {1: False, 2: False, 3: False, 4: True, 5: True, 6: False}


def test_quantiles_and_totals_against_numpy(spark):
    rnd = random.Random(8)
    rows = [(rnd.choice(("a", "b", None)), rnd.choice((rnd.random(), 1.0, 2.0, None))) for _ in range(900)] + [("single", 3.0), ("none", None)]
    df = spark.createDataFrame(rows, "g string, x double")
    got = {r["g"]: r for r in analytics.quantiles(df, ["g"], "x", {"q1": 0.25, "median": 0.5, "p99": 0.99}).collect()}
    for g in ("a", "b", None, "single"):
        own = [x for h, x in rows if h == g and x is not None]
        assert np.allclose((got[g]["q1"], got[g]["median"], got[g]["p99"]), np.quantile(own, (0.25, 0.5, 0.99)))
    assert "none" not in got
    hot = spark.range(1000).select((F.col("id") % 10 == 0).cast("int").alias("g"), F.col("id").alias("at"), F.lit(1).alias("one"))
    total = running_total(hot, ["g"], ["at"], "one", "before").collect()
    for g in (0, 1):
        some = sorted((r["at"], r["before"], r["before_all"]) for r in total if r["g"] == g)
        assert [b for _, b, _ in some] == list(range(len(some))) and {n for *_, n in some} == {len(some)}


def test_hash_of_any_length_against_the_plain_form(spark):
    rnd = random.Random(5)
    keys = [bytes(rnd.randrange(256) for _ in range(n)) for n in range(40)] + [b"\xff" * 7, b"", None]
    df = spark.createDataFrame([(k,) for k in keys], "k binary")
    for seed in (0, 1, 7, 0xFFFFFFFF):
        got = [r[0] for r in df.select(hashing.hash_exact(F.col("k"), seed)).collect()]
        assert got == [None if k is None else hashing.murmur3_x86_32(k, seed) for k in keys]


def test_a_cluster_needs_a_shared_folder():
    from tidelog.operators import tables

    class Context:
        master = "spark://host:7077"

        def getCheckpointDir(self):  # noqa: N802
            return None

    class Session:
        sparkContext = Context()  # noqa: N815
        conf = {}

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        tables.shared_folder(Session())
