"""N-gram Jaccard join by a token-group matrix: exact links and components of documents with similar shingle sets.

1. Documents with equal shingle sets form a class; only classes go on.
2. Shingles are dealt by hash, counted over classes, and those that two classes share go back to their classes, as
   packed blocks. Shingles that very many classes have are counted as their texts are read, by partial sums, and never
   meet in one place. A class that shares fewer than three quarters of its shingles can't have a link and goes.
3. Similar classes are partitioned into groups: min-hash keys over the rarer half of the shared shingles bring
   classes together, and each is compared with a few pivots of its key, the most central classes first (those whose
   shingles are most widely shared: of copies with changes, the original). Verified links make the groups.
4. Groups whose prefix shingles meet, within the bounds on size and position, are compared by their most central members
   first. For those that stay apart, the matrix holds each group's token union: every shingle that a member has, with the
   range of the sizes of those that have it. A class is a query: the shingles of its prefix are counted in the union of the
   other group. How many are there, and how many shingles follow the prefix, bounds its overlap with the union, and so
   with any member; groups that fall short stay closed. A group that qualifies is opened for its query: members meet it
   in prefix shingles, within the bounds on size and position, and every candidate is verified. No true link can be missed: sets with a similarity of 3/4 share ceil(3n/4) shingles of
   the longer one's n, so at least l of any n - ceil(3n/4) + l of them; and they share a shingle of the longer one's
   first n - ceil(3n/4) + 1 and the shorter one's first n - ceil(6n/7) + 1 shingles in any common order.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidelog.llm.common import chunks, durable, map_text, release, stored, table

#: Words of a shingle; similarity as a share.
SHINGLE, NUMER, DENOM = 5, 75, 100
#: Shingles that a task gathers before it deals them out, those of a bucket, about, and the least of a dealt block, on
#: average: with more buckets than that allows, they are dealt out in two steps.
FLUSH_TOKENS, BUCKET_TOKENS, BLOCK_LEAST = 1_500_000, 1_500_000, 64
#: Classes of a chunk of texts that make a shingle common there; classes that make it hot, at least; and how many
#: shingles can be hot (all shingles divided by this is the least number, so there can't be more; 16 bytes each).
LOCAL, HOT, HOT_MOST = 3, 2000, 1_000_000
#: Names of classes that a task remembers, so as not to deal copies again.
SEEN = 200_000
#: Members of a key's subgroup, about, pivots that a subgroup compares with, and keys that are tried in turn.
SUBGROUP, PIVOTS, KEYS = 400, 8, 4
#: Rows of a partition of the small tables (links, groups), about, and rows up to which one of them is broadcast.
SMALL, BROADCAST = 300_000, 300_000

_LOW48 = np.uint64((1 << 48) - 1)


@lru_cache(maxsize=1)
def _constants():
    rng = np.random.default_rng(20240229)
    wide = lambda n: rng.integers(0, 1 << 64, n, np.uint64)
    fold = np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)], np.uint8)
    blank = np.zeros(256, bool)
    blank[[32, 9, 10, 11, 12, 13]] = True
    return wide(256)[fold] | np.uint64(1), blank, wide(64) | np.uint64(1), wide(SHINGLE + 2) | np.uint64(1)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def shingles(texts: list[str | None]) -> list[np.ndarray]:
    """The distinct shingles of each text, as sorted 64-bit hashes; fewer words than a shingle are one."""
    value, blank, place, weight = _constants()
    raw = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
    data = np.frombuffer(b" " + b" ".join(raw) + b" ", np.uint8)
    space = blank[data]
    begin = np.flatnonzero(space[:-1] & ~space[1:]) + 1
    end = np.flatnonzero(~space[:-1] & space[1:]) + 1
    out = [np.zeros(0, np.uint64)] * len(texts)
    if not len(begin):
        return out
    size = end - begin
    offset = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
    where = np.repeat(begin, size) + offset
    # a sum over the bytes of a word: value of the byte times a factor of its place, which grows beyond 64 places
    factor = place[offset & 63] + (offset.astype(np.uint64) >> np.uint64(6)) * np.uint64(0x9E3779B97F4A7C15) * np.uint64(2)
    term = value[data[where]] * factor
    word = _mix(np.add.reduceat(term, np.cumsum(size) - size) + size.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F))
    starts = np.cumsum([1, *(len(r) + 1 for r in raw)])
    cut = np.searchsorted(begin, starts)
    many = len(word) - SHINGLE + 1
    every = np.zeros(max(many, 0), np.uint64)
    for j in range(SHINGLE if many > 0 else 0):
        every += word[j : j + many] * weight[j]
    every = _mix(every)
    for i in range(len(texts)):
        a, b = cut[i], cut[i + 1]
        if b - a >= SHINGLE:
            x = np.sort(every[a : b - SHINGLE + 1])
            out[i] = x[np.concatenate([[True], x[1:] != x[:-1]])]
        elif b > a:
            out[i] = _mix((word[a:b] * weight[: b - a]).sum(keepdims=True, dtype=np.uint64) + weight[SHINGLE : SHINGLE + 1] * np.uint64(b - a))
    return out


def class_of(sorted_shingles: np.ndarray) -> int:
    """A signed 64-bit name of a shingle set."""
    return int.from_bytes(hashlib.blake2b(sorted_shingles.tobytes(), digest_size=8).digest(), "little", signed=True)


def need(n: int) -> int:
    """Least intersection of a set of n with any linked set: ceil(3n/4)."""
    return -(-NUMER * n // DENOM)


def need_long(n: int) -> int:
    """Least intersection of a set of n with a linked set that is no smaller: ceil(6n/7)."""
    return -(-2 * NUMER * n // (NUMER + DENOM))


def common(a: np.ndarray, b: np.ndarray) -> int:
    """Size of the intersection of two sets without repetitions."""
    c = np.concatenate([a, b])
    c.sort()
    return int((c[1:] == c[:-1]).sum())


def linked(a: np.ndarray, na: int, b: np.ndarray, nb: int) -> bool:
    if min(na, nb) * DENOM < max(na, nb) * NUMER:
        return False
    both = common(a, b)
    return DENOM * both >= NUMER * (na + nb - both)


# ---------------------------------------------------------------- steps 1 and 2


_COMMON = T.ArrayType(T.StructType([T.StructField("token", T.LongType()), T.StructField("n", T.LongType())]))


def _runs(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where runs of equal values of a sorted array begin, and how long they are."""
    at = np.flatnonzero(np.concatenate([[True], x[1:] != x[:-1]])) if len(x) else np.zeros(0, np.int64)
    return at, np.diff(np.append(at, len(x)))


def measured(docs: DataFrame, text: str, keep: tuple[str, ...]) -> DataFrame:
    """Kept columns with n_shingles, the class of the shingle set, and ``common``.

    That is null but in the last row of each chunk of texts: the shingles that LOCAL and more classes of the chunk have,
    with the number of these classes.
    """

    def make():
        def apply(texts):
            sets = shingles(texts)
            names = [class_of(s) for s in sets]
            common: list = [None] * len(sets)
            own = np.sort(np.concatenate(list(dict(zip(names, sets)).values()))) & _LOW48
            own.sort()
            at, n = _runs(own)
            many = n >= LOCAL
            if many.any():
                common[-1] = list(zip(own[at[many]].astype(np.int64).tolist(), n[many].tolist()))
            return [[len(s) for s in sets], names, common]

        return apply

    return map_text(docs, text, keep, [("n_shingles", T.LongType()), ("class", T.LongType()), ("common", _COMMON)], make)


def hot_shingles(rows: DataFrame, total: int) -> tuple[np.ndarray, np.ndarray]:
    """The shingles that very many classes have (sorted), and the sums of their counts in the chunks where they are common.

    At most HOT_MOST, whatever the corpus: their counts add up to no more than ``total``, the shingles of all rows.
    """
    least = max(HOT, -(-total // HOT_MOST))
    found = rows.select(F.explode("common").alias("c")).groupBy("c.token").agg(F.sum("c.n").alias("n")).where(F.col("n") >= least).toArrow()
    token, n = (found.column(c).to_numpy() for c in ("token", "n"))
    order = np.argsort(token)
    return token[order].astype(np.uint64), n[order].astype(np.int64)


def _code(n: np.ndarray) -> np.ndarray:
    """Counts in 16 bits that keep their order: exact up to 2047, then with eleven leading bits."""
    n = n.astype(np.int64)
    shift = np.maximum(np.frexp(n.astype(float))[1] - 11, 0).astype(np.int64)
    return (shift << 10) + (n >> shift)


def _count(code: np.ndarray) -> np.ndarray:
    """The counts of ``_code``, to one part in a thousand."""
    code = code.astype(np.int64)
    shift = np.maximum((code >> 10) - 1, 0)
    return (code - (shift << 10)) << shift


class Plan(NamedTuple):
    """How shingles are dealt: partitions, buckets (handled one by one inside them), and buckets of a coarse bucket."""

    parts: int
    buckets: int
    per: int

    @classmethod
    def of(cls, spark: SparkSession, total: int) -> Plan:
        parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
        buckets = max(1, math.ceil(total / BUCKET_TOKENS), min(parts, math.ceil(total / 200_000)))
        return cls(min(parts, buckets), buckets, math.ceil(buckets / max(1, FLUSH_TOKENS // BLOCK_LEAST)))

    def spot(self, x: np.ndarray) -> np.ndarray:
        """Bucket of each 48-bit hash: ranges of equal width."""
        return ((x >> np.uint64(16)) * np.uint64(self.buckets) >> np.uint64(32)).astype(np.int64)

    def of_token(self, names: np.ndarray, owner: np.ndarray, tokens: np.ndarray) -> np.ndarray:
        return self.spot(tokens & _LOW48)

    def of_class(self, names: np.ndarray, owner: np.ndarray, tokens: np.ndarray) -> np.ndarray:
        return self.spot(names.astype(np.uint64) >> np.uint64(16))[owner]


_BLOCK = T.StructType([T.StructField("bucket", T.IntegerType()), T.StructField("block", T.BinaryType())])


def _pack(classes: np.ndarray, sizes: np.ndarray, counts: np.ndarray, tokens: np.ndarray, width: int) -> bytes:
    """Number of classes; their names, set sizes and numbers of tokens here; the tokens in order of the classes."""
    body = tokens.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].tobytes()
    return b"".join([len(classes).to_bytes(4, "little"), classes.astype("<i8").tobytes(), sizes.astype("<u4").tobytes(), counts.astype("<u4").tobytes(), body])


def _unpack(block: bytes, width: int) -> tuple[np.ndarray, ...]:
    k = int.from_bytes(block[:4], "little")
    classes = np.frombuffer(block, "<i8", k, 4)
    sizes = np.frombuffer(block, "<u4", k, 4 + 8 * k)
    counts = np.frombuffer(block, "<u4", k, 4 + 12 * k)
    body = np.frombuffer(block, np.uint8, offset=4 + 16 * k).reshape(-1, width)
    tokens = np.zeros((len(body), 8), np.uint8)
    tokens[:, :width] = body
    return classes, sizes, counts, tokens.view("<u8").ravel()


def _gather(blocks: list[bytes], width: int) -> tuple[np.ndarray, ...]:
    """Distinct classes with their sizes, and for each token the index of its class."""
    parts = [_unpack(b, width) for b in blocks]
    names = np.concatenate([p[0] for p in parts])
    sizes = np.concatenate([p[1] for p in parts])
    names, first, back = np.unique(names, return_index=True, return_inverse=True)
    owner = np.repeat(back, np.concatenate([p[2] for p in parts])).astype(np.int32)
    return names, sizes[first], np.concatenate([p[3] for p in parts]), owner


def _deal(names, sizes, owner, tokens, bucket, width):
    """Packed blocks, one for each bucket that occurs."""
    order = np.lexsort((owner, bucket))
    owner, tokens, bucket = owner[order], tokens[order], bucket[order]
    cuts = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1], [True]])) if len(bucket) else []
    for a, b in zip(cuts[:-1], cuts[1:]):
        some = owner[a:b]
        at = np.flatnonzero(np.concatenate([[True], some[1:] != some[:-1]]))
        counts = np.diff(np.append(at, len(some)))
        yield int(bucket[a]), _pack(names[some[at]], sizes[some[at]], counts, tokens[a:b], width)


def _row(bucket: int, block: bytes) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([bucket], pa.int32()), pa.array([block], pa.binary())], names=["bucket", "block"])


class _Dealer:
    """Gathers classes with their shingles and deals them out as packed blocks, one for each bucket that occurs."""

    def __init__(self, where: Callable, per: int, width: int, turn: Callable[[int], int] = lambda b: b):
        self.where, self.per, self.width, self.turn = where, per, width, turn
        self.parts: list[tuple] = []
        self.names = self.held = 0

    def add(self, names: np.ndarray, sizes: np.ndarray, owner: np.ndarray, tokens: np.ndarray) -> Iterator[pa.RecordBatch]:
        self.parts.append((names, sizes, owner.astype(np.int32) + np.int32(self.names), tokens))
        self.names += len(names)
        self.held += len(tokens)
        if self.held >= FLUSH_TOKENS:
            yield from self.flush()

    def flush(self) -> Iterator[pa.RecordBatch]:
        if self.held:
            names, sizes, owner, tokens = (np.concatenate(c) for c in zip(*self.parts))
            self.parts, self.names, self.held = [], 0, 0
            for bucket, block in _deal(names, sizes, owner, tokens, self.where(names, owner, tokens) // self.per, self.width):
                yield _row(self.turn(bucket), block)


def dealt_shingles(docs: DataFrame, text: str, plan: Plan, hot: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    """Blocks of shingles by the shingle's bucket; copies of a set that a task meets again are dealt once.

    Hot shingles are known to be shared and counted already. They go by the bucket of their class, which is written as a
    negative number.
    """
    shared = docs.sparkSession.sparkContext.broadcast(hot)

    def run(batches):
        common, count = shared.value
        ordinary = _Dealer(plan.of_token, plan.per, 6)
        apart = _Dealer(plan.of_class, plan.per, 8, lambda b: -1 - b)
        seen: set[int] = set()
        for batch in batches:
            for at, n in chunks(batch.column(0)):
                names, sets = [], []
                for s in shingles(batch.column(0).slice(at, n).to_pylist()):
                    if len(s):
                        name = class_of(s)
                        if name not in seen:
                            seen.add(name)
                            names.append(name)
                            sets.append(s)
                if len(seen) > SEEN:
                    seen.clear()
                if not sets:
                    continue
                names, sizes = np.array(names, np.int64), np.array([len(s) for s in sets], np.int64)
                flat = np.concatenate(sets) & _LOW48
                owner = np.repeat(np.arange(len(sets), dtype=np.int32), sizes)
                if len(common):
                    place = np.minimum(np.searchsorted(common, flat), len(common) - 1)
                    wide = common[place] == flat
                    key = (_code(count[place[wide]]).astype(np.uint64) << np.uint64(48)) | flat[wide]
                    yield from apart.add(names, sizes, owner[wide], key)
                    flat, owner = flat[~wide], owner[~wide]
                yield from ordinary.add(names, sizes, owner, flat)
        yield from ordinary.flush()
        yield from apart.flush()
        del seen
        release()

    return docs.select(F.col(text).cast("string").alias("__text")).where("__text IS NOT NULL").mapInArrow(run, _BLOCK)


def _by_bucket(blocks: DataFrame, plan: Plan, make: Callable, schema, most: int | None = None, through: bool = False) -> DataFrame:
    """``make()`` gives a function for the blocks of a bucket, which lie together, and one for the partition's end.

    One bucket is in memory at a time, or about ``most`` bytes of it. With ``through``, blocks of negative buckets pass
    as they are.
    """
    dealt = blocks.repartitionById(plan.parts, F.pmod("bucket", F.lit(plan.parts))).sortWithinPartitions("bucket")

    def each(batches):
        step, end = make()
        now, held, size = None, [], 0
        for batch in batches:
            for b, block in zip(batch.column(0).to_pylist(), batch.column(1)):
                if through and b < 0:
                    yield _row(b, block.as_py())
                    continue
                if held and (b != now or (most and size > most)):
                    yield from step(held)
                    held, size = [], 0
                now = b
                held.append(block.as_py())
                size += len(held[-1])
        if held:
            yield from step(held)
        yield from end()
        del step, end, held
        release()

    return dealt.mapInArrow(each, schema)


def _refined(blocks: DataFrame, plan: Plan, where: Callable, width: int) -> DataFrame:
    """Blocks of coarse buckets dealt out to the buckets themselves."""
    if plan.per == 1:
        return blocks

    def make():
        dealer = _Dealer(where, 1, width)

        def step(held):
            names, sizes, tokens, owner = _gather(held, width)
            yield from dealer.add(names, sizes, owner, tokens)

        return step, dealer.flush

    return _by_bucket(blocks, plan, make, _BLOCK, most=8 * FLUSH_TOKENS, through=True)


def shared_blocks(blocks: DataFrame, plan: Plan) -> DataFrame:
    """The shingles that two classes have, with the number of classes, dealt by class; hot ones pass, turned round.

    A shingle becomes the code of its number of classes above its lower 48 bits, so plain order is rare-first.
    """

    def make():
        dealer = _Dealer(plan.of_class, plan.per, 8)

        def step(held):
            names, sizes, tokens, owner = _gather(held, 6)
            order = np.argsort(tokens)
            tokens, owner = tokens[order], owner[order]
            same = np.concatenate([[False], tokens[1:] == tokens[:-1], [False]])
            twice = same[:-1] | same[1:]
            tokens, owner = _distinct(tokens[twice], owner[twice])
            at, n = _runs(tokens)
            n = np.repeat(n, n)
            tokens, owner, n = tokens[n > 1], owner[n > 1], n[n > 1]
            if len(tokens):
                used, owner = np.unique(owner, return_inverse=True)
                key = (_code(n).astype(np.uint64) << np.uint64(48)) | tokens
                yield from dealer.add(names[used], sizes[used].astype(np.int64), owner, key)

        return step, dealer.flush

    found = _by_bucket(_refined(blocks, plan, plan.of_token, 6), plan, make, _BLOCK, through=True)
    return found.select(F.when(F.col("bucket") < 0, -1 - F.col("bucket")).otherwise(F.col("bucket")).alias("bucket"), "block")


def _distinct(tokens: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of a shingle and its class, sorted, without repetitions."""
    order = np.lexsort((owner, tokens))
    tokens, owner = tokens[order], owner[order]
    fresh = np.concatenate([[True], (tokens[1:] != tokens[:-1]) | (owner[1:] != owner[:-1])]) if len(tokens) else np.zeros(0, bool)
    return tokens[fresh], owner[fresh]


_SURVIVOR = T.StructType(
    [T.StructField("class", T.LongType()), T.StructField("n", T.IntegerType()), T.StructField("shared", T.BinaryType()), T.StructField("central", T.DoubleType())]
    + [T.StructField(f"k{j}", T.LongType()) for j in range(KEYS)]
)
_SALTS = _mix(np.arange(1, KEYS + 1, dtype=np.uint64))


def _min_keys(tokens: np.ndarray) -> list[int]:
    """The shingles of least salted hash among the rarer half of a class's shared ones, one for each salt."""
    rare = tokens[: (len(tokens) + 1) // 2]
    return [int(rare[_mix((rare & _LOW48) ^ salt).argmin()].astype(np.int64)) for salt in _SALTS]


def survivors(blocks: DataFrame, plan: Plan) -> DataFrame:
    """Classes that share at least three quarters of their shingles.

    Name, set size, shared shingles rare-first, by how many classes they are shared on average, and the class's keys.
    """

    def make():
        def step(held):
            names, sizes, tokens, owner = _gather(held, 8)
            owner, tokens = _distinct(owner, tokens)  # by class, then rare-first
            count = np.bincount(owner, minlength=len(names))
            ends = np.cumsum(count)
            keep = np.flatnonzero(count * DENOM >= sizes.astype(np.int64) * NUMER)
            for a in range(0, len(keep), 1000):
                some = keep[a : a + 1000]
                own = [tokens[ends[i] - count[i] : ends[i]] for i in some]
                keys = [_min_keys(x) for x in own]
                central = [float(_count(x >> np.uint64(48)).sum()) / int(sizes[i]) for x, i in zip(own, some)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(names[some], pa.int64()), pa.array(sizes[some].astype(np.int32), pa.int32()), pa.array([x.astype("<u8").tobytes() for x in own], pa.binary()), pa.array(central, pa.float64())]
                    + [pa.array([k[j] for k in keys], pa.int64()) for j in range(KEYS)],
                    names=_SURVIVOR.names,
                )

        return step, lambda: iter(())

    return _by_bucket(_refined(blocks, plan, plan.of_class, 8), plan, make, _SURVIVOR)


# ---------------------------------------------------------------- step 3


_EDGE = T.StructType([T.StructField("a", T.LongType()), T.StructField("b", T.LongType())])


def _sized(df: DataFrame) -> DataFrame:
    """A durable table with the hint to broadcast it if it has at most BROADCAST rows (of a few numbers each)."""
    return F.broadcast(df) if df.count() <= BROADCAST else df


def _stars(members: DataFrame) -> DataFrame:
    """Verified links of members (key, part, rank, central, class, n, shared) with a pivot of their subgroup.

    A member that links with no pivot becomes one, as long as there is room. What isn't linked here is left to later
    keys and to the matrix.
    """

    def run(batches):
        now, pivots = None, []
        for batch in batches:
            a, b = [], []
            key, part, name, n, blob = (batch.column(i).to_pylist() for i in range(5))
            for k, p, c, size, raw in zip(key, part, name, n, blob):
                if (k, p) != now:
                    now, pivots = (k, p), []
                x = np.frombuffer(raw, "<u8")
                for other, y, m in pivots:
                    if c == other:
                        break
                    if linked(x, size, y, m):
                        a.append(c)
                        b.append(other)
                        break
                else:
                    if len(pivots) < PIVOTS:
                        pivots.append((c, x, size))
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    dealt = members.repartition("key", "part").sortWithinPartitions("key", "part", "rank", F.desc("central"), "class")
    return dealt.select("key", "part", "class", "n", "shared").mapInArrow(run, _EDGE)


def starred(shared: DataFrame, parts: int) -> DataFrame:
    """Links (a, b) found by comparing classes with the pivots of their keys, one key after the other.

    A class that a key has linked is represented by its pivot when the next key is tried. A key is a shingle, so its
    number of classes bounds the members: they are dealt into subgroups of about SUBGROUP, and the most central
    member of a key with several subgroups is the first pivot of all of them.
    """
    edges = None
    code = F.shiftrightunsigned("key", 48)
    shift = F.greatest(F.floor(code / 1024) - 1, F.lit(0))
    count = (code - shift * 1024) * F.pow(F.lit(2.0), shift)  # as _count has it
    for j in range(KEYS):
        active = shared if edges is None else shared.join(_sized(edges).select(F.col("a").alias("class")), "class", "left_anti")
        active = active.withColumn("key", F.col(f"k{j}"))
        parts_of = F.ceil(count / SUBGROUP)
        placed = active.select("key", F.pmod(F.xxhash64("class"), parts_of).alias("part"), F.lit(1).alias("rank"), "central", "class", "n", "shared")
        leads = active.select("class", "key", "central").where(count > SUBGROUP).groupBy("key").agg(F.max_by("class", F.struct("central", "class")).alias("class"))
        first = shared.join(_sized(stored(leads.coalesce(parts))), "class").select("key", F.explode(F.sequence(F.lit(0).cast("bigint"), parts_of - 1)).alias("part"), F.lit(0).alias("rank"), "central", "class", "n", "shared")
        found = _stars(placed.unionByName(first)).where("a != b").distinct().coalesce(parts)
        edges = stored(found if edges is None else edges.unionByName(found).coalesce(parts)).coalesce(parts)
    return edges


# ---------------------------------------------------------------- components


def components(edges: DataFrame, parts: int = 4) -> DataFrame:
    """(node, comp): the least node that each node of the edges (a, b) reaches; hooking and pointer jumping.

    Every round hooks each component to its least neighbour and shortens the paths, so components at least halve;
    tables are written in ``parts`` parts, nothing but counts reaches the driver.
    """
    keep = lambda df: stored(df.coalesce(parts)).coalesce(parts)  # noqa: E731  one part needs no further exchange
    edges = keep(edges.select("a", "b").where("a != b"))
    label = None
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).coalesce(parts)
        parent = keep(both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("up")))
        while True:
            over = parent.select(F.col("a").alias("up"), F.col("up").alias("top"))
            jumped = keep(parent.join(over, "up").select("a", F.col("top").alias("up"), (F.col("top") != F.col("up")).alias("moved")))
            parent = jumped.select("a", "up")
            if not jumped.where("moved").take(1):
                break
        step = parent.select(F.col("a").alias("comp"), "up")
        if label is None:
            label = parent.select(F.col("a").alias("node"), F.col("up").alias("comp"))
        else:
            label = keep(label.join(step, "comp", "left").select("node", F.coalesce("up", "comp").alias("comp")))
        left = edges.join(step.select(F.col("comp").alias("a"), F.col("up").alias("ua")), "a").join(step.select(F.col("comp").alias("b"), F.col("up").alias("ub")), "b")
        edges = keep(left.where("ua != ub").select(F.col("ua").alias("a"), F.col("ub").alias("b")).distinct())
        if not edges.take(1):
            return label


def _grouped(shared: DataFrame, edges: DataFrame, parts: int) -> DataFrame:
    """(class, g): the group of each class, named by its most central member; a class without links is its own group."""
    label = components(edges, parts).select(F.col("node").alias("class"), F.col("comp").alias("g"))
    own = stored(shared.select("class", "central").join(label, "class", "left").select("class", "central", F.coalesce("g", "class").alias("g")).coalesce(parts))
    lead = own.groupBy("g").agg(F.max_by("class", F.struct("central", "class")).alias("lead"))
    return stored(own.join(lead, "g").select("class", F.col("lead").alias("g")).coalesce(parts))


# ---------------------------------------------------------------- step 4


_PREFIX = T.StructType([T.StructField("class", T.LongType()), T.StructField("g", T.LongType()), T.StructField("n", T.IntegerType()), T.StructField("token", T.LongType()), T.StructField("at", T.IntegerType()), T.StructField("long", T.BooleanType()), T.StructField("short", T.BooleanType())])
_UNION = T.StructType([T.StructField("token", T.LongType()), T.StructField("g", T.LongType()), T.StructField("low", T.IntegerType()), T.StructField("high", T.IntegerType())])


def least_met(n):
    """Shingles of a query's prefix that must be in a group's union: an eighth of its set, and one more."""
    return 1 + n // 8


def prefixes(shared: DataFrame) -> DataFrame:
    """Prefix shingles of each class: token, place in the rare-first order, and whether the prefixes of the longer and
    of the shorter set of a pair have it. All of them together are the prefix by which a class asks for groups.

    Shingles of one class only come first in that order and can't meet; they are counted, not stored.
    """

    def run(batches):
        for batch in batches:
            cols: list[list] = [[], [], [], [], [], [], []]
            for name, g, n, blob in zip(*(batch.column(i).to_pylist() for i in range(4))):
                x = np.frombuffer(blob, "<u8")
                alone = n - len(x)
                far, near = n - need(n) + 1 - alone, n - need_long(n) + 1 - alone
                x = x[: max(far - 1 + least_met(n), 0)].astype(np.int64).tolist()
                cols[0] += [name] * len(x)
                cols[1] += [g] * len(x)
                cols[2] += [n] * len(x)
                cols[3] += x
                cols[4] += range(alone, alone + len(x))
                cols[5] += [i < far for i in range(len(x))]
                cols[6] += [i < near for i in range(len(x))]
            kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.bool_(), pa.bool_())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=_PREFIX.names)

    return shared.select("class", "g", "n", "shared").mapInArrow(run, _PREFIX)


def unions(shared: DataFrame) -> DataFrame:
    """The matrix: each group's token union (token, g), with the range of sizes of the members that have the token."""

    def run(batches):
        for batch in batches:
            g, n, blobs = batch.column(0).to_numpy(), batch.column(1).to_numpy(), batch.column(2)
            for a in range(0, len(g), 2000):
                sets = [np.frombuffer(x.as_buffer(), "<u8").astype(np.int64) for x in blobs[a : a + 2000]]
                size = [len(x) for x in sets]
                token, group, own = np.concatenate(sets), np.repeat(g[a : a + 2000], size), np.repeat(n[a : a + 2000], size)
                order = np.lexsort((token, group))
                token, group, own = token[order], group[order], own[order]
                at = np.flatnonzero(np.concatenate([[True], (token[1:] != token[:-1]) | (group[1:] != group[:-1])])) if len(token) else np.zeros(0, np.int64)
                low, high = (f.reduceat(own, at) if len(at) else own for f in (np.minimum, np.maximum))
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip((token[at], group[at], low, high), (pa.int64(), pa.int64(), pa.int32(), pa.int32()))], names=_UNION.names)

    found = shared.select("g", "n", "shared").mapInArrow(run, _UNION)
    return found.groupBy("token", "g").agg(F.min("low").alias("low"), F.max("high").alias("high"))


def verified(pairs: DataFrame, shared: DataFrame) -> DataFrame:
    """The pairs (a, b) whose sets are linked."""
    left = shared.select(F.col("class").alias("a"), F.col("n").alias("na"), F.col("shared").alias("sa"))
    right = shared.select(F.col("class").alias("b"), F.col("n").alias("nb"), F.col("shared").alias("sb"))

    def run(batches):
        for batch in batches:
            a, b, na, nb, sa, sb = (batch.column(i).to_pylist() for i in range(6))
            ok = [linked(np.frombuffer(x, "<u8"), n, np.frombuffer(y, "<u8"), m) for x, n, y, m in zip(sa, na, sb, nb)]
            yield pa.RecordBatch.from_arrays([pa.array([v for v, k in zip(a, ok) if k], pa.int64()), pa.array([v for v, k in zip(b, ok) if k], pa.int64())], names=["a", "b"])

    known = _sized(pairs)
    return left.join(known, "a").join(right.join(known, "b"), ["a", "b"]).select("a", "b", "na", "nb", "sa", "sb").mapInArrow(run, _EDGE)


def across(shared: DataFrame, group: DataFrame, parts: int) -> DataFrame:
    """Links between groups (class, g), by the token-group matrix."""
    grouped = shared.join(_sized(group), "class")
    tokens = stored(prefixes(grouped))
    # two groups can have a link only where the prefixes of the longer and of the shorter set meet, within the bounds on
    # size (of the members with the token) and position (the shingles from there on must suffice for the overlap needed)
    sizes = (F.min("n").alias("low"), F.max("n").alias("high"), F.max(F.col("n") - F.col("at")).alias("rest"))
    probe = tokens.where("long").groupBy("token", "g").agg(*sizes).select("token", F.col("g").alias("ga"), F.col("low").alias("la"), F.col("high").alias("ha"), F.col("rest").alias("ra"))
    index = tokens.where("short").groupBy("token", "g").agg(*sizes).select("token", F.col("g").alias("gb"), F.col("low").alias("lb"), F.col("high").alias("hb"), F.col("rest").alias("rb"))
    meet = probe.join(index, "token").where(f"ga != gb AND ha >= lb AND hb * {DENOM} >= la * {NUMER} AND least(ra, rb) * {NUMER + DENOM} >= {NUMER} * (la + lb)")
    meet = stored(meet.select("token", "ga", "gb", "lb", "hb", "rb"))
    if not meet.take(1):
        return shared.sparkSession.createDataFrame([], _EDGE)
    # a group is named by its most central class, which serves as its pivot
    once = stored(meet.select(F.least("ga", "gb").alias("a"), F.greatest("ga", "gb").alias("b")).distinct().coalesce(parts))
    by_pivot = stored(verified(once, shared).coalesce(parts))
    merged = components(by_pivot, parts)
    to = lambda g, out: _sized(merged).select(F.col("node").alias(g), F.col("comp").alias(out))
    apart = meet.join(to("ga", "ca"), "ga", "left").join(to("gb", "cb"), "gb", "left")
    apart = stored(apart.where("coalesce(ca, ga) != coalesce(cb, gb)").select("token", "ga", "gb", "lb", "hb", "rb"))
    if not apart.take(1):
        return by_pivot
    apart = _sized(apart)
    long = tokens.where("long").select("token", F.col("g").alias("ga"), F.col("class").alias("x"), F.col("n").alias("nx"), F.col("at").alias("ax"))
    asks = long.join(apart, ["token", "ga"]).where(f"nx >= lb AND hb * {DENOM} >= nx * {NUMER} AND least(nx - ax, rb) * {NUMER + DENOM} >= {NUMER} * (nx + lb)")
    asks = _sized(stored(asks.select("x", "gb").distinct().coalesce(parts)))
    # of groups that stay apart: the prefix of a class of the one is counted in the token union of the other
    matrix = unions(grouped.join(_sized(stored(asks.select(F.col("gb").alias("g")).distinct().coalesce(parts))), "g", "left_semi")).withColumnRenamed("g", "gb")
    queries = tokens.select("token", F.col("class").alias("x"), F.col("n").alias("nx")).join(asks, "x")
    met = queries.join(matrix, ["token", "gb"]).where(f"low <= nx AND high * {DENOM} >= nx * {NUMER}").groupBy("x", "nx", "gb").agg(F.count("*").alias("met"))
    opened = _sized(stored(met.where(F.col("met") >= 1 + F.floor(F.col("nx") / 8)).select("x", "gb").coalesce(parts)))  # as least_met has it
    # qualifying groups are opened: their members meet the query in prefix shingles
    short = tokens.where("short").select("token", F.col("g").alias("gb"), F.col("class").alias("y"), F.col("n").alias("ny"), F.col("at").alias("ay"))
    enough = f"least(nx - ax, ny - ay) * {NUMER + DENOM} >= {NUMER} * (nx + ny)"
    fit = long.join(opened, "x").join(short, ["token", "gb"]).where(f"x != y AND ny <= nx AND ny * {DENOM} >= nx * {NUMER} AND {enough}")
    candidates = stored(fit.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct())
    return by_pivot.unionByName(verified(candidates, shared))


def similar(docs: DataFrame, text: str = "text", key: str = "doc_id", keep: tuple[str, ...] = ()) -> DataFrame:
    """The key and kept columns with n_shingles, class, component (its least class) and component_id (the least key
    that links reach).

    Null texts and texts without words have no shingles and link with nothing, not even each other. Texts of fewer
    than five words are one shingle. Repeated rows and equal sets are one class; rows that share a key but not a
    text are separate. Where all keys of a component are null, component_id is null. A kept column that is called like a
    result gives way to it, others may have any name. An empty table gives an empty result. Whole texts are read twice;
    classes are named by 64-bit digests and shingles by 48 bits of a hash.
    """
    spark = docs.sparkSession
    keep = tuple(c for c in keep if c not in (key, "n_shingles", "class", "component", "component_id", "common", "__least"))
    rows = durable(measured(docs, text, (key, *keep)))
    every = rows.agg(F.sum("n_shingles")).first()[0] or 0
    hot = hot_shingles(rows, every)
    rows = rows.drop("common")
    some = rows.where("n_shingles > 0")
    classes = some.groupBy("class").agg(F.min(key).alias("__least"), F.first("n_shingles").alias("n"))
    size = classes.agg(F.count("*").alias("k"), F.sum("n").alias("n")).first()
    parts = max(1, math.ceil(size["k"] / SMALL))
    plan = Plan.of(spark, size["n"] or 0)
    shared = durable(survivors(shared_blocks(dealt_shingles(docs, text, plan, hot), plan), plan))
    stars = starred(shared, parts)
    more = stored(across(shared, _grouped(shared, stars, parts), parts).coalesce(parts))
    label = components(stars.unionByName(more), parts).select(F.col("node").alias("class"), "comp")
    named = stored(classes.join(label, "class", "left").select("class", "__least", F.coalesce("comp", "class").alias("comp")).coalesce(parts))
    least = named.groupBy("comp").agg(F.min("__least").alias("component_id"))
    named = named.join(least, "comp").select("class", F.col("comp").alias("component"), "component_id")
    alone = rows.where("n_shingles = 0").withColumns({"component": F.lit(None).cast("bigint"), "component_id": F.col(key)})
    return some.join(named, "class").unionByName(alone).select(key, *keep, "n_shingles", "class", "component", "component_id")


def op9_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of all whole texts of ``documents`` under links of 75 % shingle similarity."""
    return similar(table(spark, sf_dir, "documents", "doc_id", "text")).select("doc_id", "n_shingles", "component_id")


OP9_SQL = r"""
WITH RECURSIVE w AS (
  SELECT row_number() OVER () AS r, doc_id,
         coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+'), []) AS w
  FROM documents),
s AS (
  SELECT DISTINCT r, CASE WHEN len(w) < 5 THEN array_to_string(w, ' ') ELSE array_to_string(list_slice(w, i, i + 4), ' ') END AS x
  FROM (SELECT r, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM w WHERE len(w) > 0)),
n AS (SELECT r, count(*) AS n FROM s GROUP BY r),
p AS (SELECT a.r AS a, b.r AS b, count(*) AS c FROM s a JOIN s b ON a.x = b.x AND a.r < b.r GROUP BY ALL),
e AS (
  SELECT a, b FROM (SELECT a, b, c, na.n AS n, nb.n AS m FROM p JOIN n na ON na.r = a JOIN n nb ON nb.r = b)
  WHERE 100 * c >= 75 * (n + m - c)),
g AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
reach(a, b) AS (SELECT r, r FROM w UNION SELECT reach.a, g.b FROM reach JOIN g ON reach.b = g.a)
SELECT w.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, c.component_id
FROM w LEFT JOIN n ON n.r = w.r
JOIN (SELECT reach.a, min(w.doc_id) AS component_id FROM reach JOIN w ON w.r = reach.b GROUP BY reach.a) c ON c.a = w.r
"""
