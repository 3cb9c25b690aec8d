"""Secrets: base patterns, and a battery of randomness tests with length-aware control of false discoveries.

Strings of 16 and more characters are read in their inferred encoding. Three tests ask whether each could be random:
chi-squared uniformity over the alphabet, runs about the middle symbol, and serial correlation. Simes' rule combines
their p-values to one, s. A discovery needs that the battery doesn't reject (s above a level), and that words would not
pass it as well: under the null that a string is text, s is at least as large as seen with a probability of at most
P(chi-squared of text <= x), x being the value whose p-value under randomness is s / 3. These p-values, one for each
string, of all three tests and aware of its length, go through the Benjamini-Hochberg rule over all strings of the corpus,
within strata of encoding and length.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidelog.llm.common import durable, joined, release, table, with_spans

KINDS = ("assign", "access", "hex")
#: Level of the combined p-value at which the battery rejects randomness, and the false-discovery rate.
BATTERY, FDR = 0.003, 0.01
#: Bins of the p-values' logarithm: the rule works on their counts, whose number doesn't grow with the corpus.
P_BINS = 256

# The base patterns (letters of the key words in either case). The bounds on hex and access find the
# same matches as the unbounded forms after short ones are dropped.
PATTERNS = {
    "assign": r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
    "access": r"AKIA[A-Z0-9]{16,}",
    "hex": r"(?<![0-9a-f])[0-9a-f]{24,}",
}
STRING = r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{16,}+={0,2}"

#: Alphabets: name, symbols, and how letters of words appear in them.
_ENCODINGS = ("hex", "base32", "letters", "base64", "base36", "base32 lower", "base36 lower", "mixed letters")
_SIZE = np.array([16, 32, 26, 64, 36, 32, 36, 52], float)
# Shares of the letters a to z in running English text, in per cent.
_LETTERS = np.array([8.2, 1.5, 2.8, 4.3, 12.7, 2.2, 2.0, 6.1, 7.0, 0.15, 0.77, 4.0, 2.4, 6.7, 7.5, 1.9, 0.095, 6.0, 6.3, 9.1, 2.8, 0.98, 2.4, 0.15, 2.0, 0.074])


def _excess() -> np.ndarray:
    """k times the sum of squared shares, less one, for words written in each alphabet."""
    out = []
    for name, k in zip(_ENCODINGS, _SIZE):
        q = _LETTERS[:6] if name == "hex" else _LETTERS
        q = q / q.sum()
        out.append(k * (q * q).sum() - 1)
    return np.array(out)


def _normal_tail(z: np.ndarray) -> np.ndarray:
    """P(Z > z), by the rational form of Abramowitz and Stegun 26.2.17."""
    t = 1 / (1 + 0.2316419 * np.abs(z))
    poly = t * (0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429))))
    tail = np.exp(-np.minimum(z * z, 1400) / 2) / np.sqrt(2 * np.pi) * poly
    return np.where(z >= 0, tail, 1 - tail)


def _normal_upper(p: np.ndarray) -> np.ndarray:
    """The z with P(Z > z) = p for p up to 1/2, by the rational form of Abramowitz and Stegun 26.2.23."""
    t = np.sqrt(-2 * np.log(np.clip(p, 1e-300, 0.5)))
    return t - (2.515517 + t * (0.802853 + t * 0.010328)) / (1 + t * (1.432788 + t * (0.189269 + t * 0.001308)))


def simes(*p: np.ndarray) -> np.ndarray:
    """One p-value for several: the least of the k-th smallest times their number by k."""
    ordered = np.sort(np.stack(p), axis=0)
    return np.minimum((ordered * len(p) / np.arange(1, len(p) + 1)[:, None]).min(0), 1.0)


def _maps() -> np.ndarray:
    """Symbol of each byte in each encoding, -1 where it has none."""
    m = np.full((8, 256), -1, np.int64)
    for i in range(10):
        m[0, 48 + i] = m[4, 48 + i] = m[6, 48 + i] = i
        m[3, 48 + i] = 52 + i
    for i in range(6):
        m[0, 97 + i] = m[0, 65 + i] = 10 + i
    for i in range(26):
        m[1, 65 + i] = m[5, 97 + i] = i
        m[2, 97 + i] = m[2, 65 + i] = i
        m[4, 65 + i] = m[6, 97 + i] = 10 + i
        m[3, 65 + i], m[3, 97 + i] = i, 26 + i
        m[7, 65 + i], m[7, 97 + i] = i, 26 + i
    for i in range(2, 8):
        m[1, 48 + i] = m[5, 48 + i] = 24 + i
    for c, v in ((43, 62), (45, 62), (47, 63), (95, 63)):
        m[3, c] = v
    return m


_MAPS = _maps()


def battery(strings: list[str]) -> dict[str, np.ndarray]:
    """Encoding, length, p-values of the three tests under randomness, their combination, and the p-value of that under
    the null of text."""
    size = np.array([len(s.rstrip("=")) for s in strings], np.int64)
    raw = np.frombuffer("".join(s.rstrip("=") for s in strings).encode("ascii"), np.uint8)
    ends = np.cumsum(size)
    begin = ends - size

    def count(mask: np.ndarray) -> np.ndarray:
        c = np.concatenate([[0], np.cumsum(mask)])
        return c[ends] - c[begin]

    digit = count((raw >= 48) & (raw <= 57))
    upper, lower = count((raw >= 65) & (raw <= 90)), count((raw >= 97) & (raw <= 122))
    hexa = count(_MAPS[0][raw] >= 0)
    b32, b32_lower = count(_MAPS[1][raw] >= 0), count(_MAPS[5][raw] >= 0)
    enc = np.full(len(strings), 3)
    enc[upper + lower == size] = 7
    enc[(upper == size) | (lower == size)] = 2
    enc[(upper + digit == size) & (digit > 0)] = 4
    enc[(lower + digit == size) & (digit > 0)] = 6
    enc[(b32_lower == size) & (digit > 0)] = 5
    enc[(b32 == size) & (digit > 0)] = 1
    enc[(hexa == size) & ((upper == 0) | (lower == 0)) & (digit > 0)] = 0
    only_digits = digit == size

    which = np.repeat(np.arange(len(strings)), size)
    symbol = _MAPS[enc[which], raw]
    k, n = _SIZE[enc], np.maximum(size, 2).astype(float)
    counts = np.bincount(which * 64 + symbol, minlength=64 * len(strings)).reshape(-1, 64)
    x2 = (counts.astype(float) ** 2).sum(1) * k / n - n
    # Wilson and Hilferty's cube root for the upper tail of chi-squared
    df = k - 1
    chi = _normal_tail((np.cbrt(np.maximum(x2, 1e-9) / df) - (1 - 2 / (9 * df))) / np.sqrt(2 / (9 * df)))
    high = symbol >= (k / 2)[which]
    up = count(high).astype(float)
    down = n - up
    change = np.concatenate([[False], (high[1:] != high[:-1]) & (which[1:] == which[:-1])]) if len(raw) else np.zeros(0, bool)
    runs = count(change) + 1.0
    mean = 2 * up * down / n + 1
    var = np.maximum((mean - 1) * (mean - 2) / (n - 1), 1e-9)
    run = np.where(up * down > 0, 2 * _normal_tail(np.abs(runs - mean) / np.sqrt(var)), 0.0)
    v = symbol - np.repeat(np.bincount(which, symbol, len(strings)) / n, size)
    product = np.concatenate([v[:-1] * v[1:] * (which[1:] == which[:-1]), [0.0]]) if len(raw) else v
    square = np.bincount(which, v * v, len(strings))
    r = np.bincount(which, product, len(strings)) / np.maximum(square, 1e-9)
    serial = 2 * _normal_tail(np.abs((r + 1 / n) * np.sqrt(n)))
    d = _excess()[enc]
    text_mean, text_sd = df + (n - 1) * d, np.sqrt(2 * df + 4 * (n - 1) * d)
    random = simes(chi, run, serial)
    # the chi-squared value that would have a third of the combined p-value: never below the string's own
    equal = df * np.maximum(1 - 2 / (9 * df) + _normal_upper(random / 3) * np.sqrt(2 / (9 * df)), 0) ** 3
    text = _normal_tail((text_mean - np.maximum(equal, x2)) / text_sd)
    text[only_digits] = 1.0
    return {"encoding": enc, "n": size, "chi": chi, "runs": run, "serial": serial, "random": random, "text": text}


def _stratum(enc: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Encoding and power of two of the length (16, 32, 64, ... up to 1024 and more)."""
    return enc * 8 + np.clip(np.log2(np.maximum(n, 16)).astype(int) - 4, 0, 6)


def _bin(p: np.ndarray) -> np.ndarray:
    """Bins of -log10 p, eight to a decade; a larger bin is a smaller p."""
    return np.clip(np.floor(-np.log10(np.maximum(p, 1e-40)) * 8), 0, P_BINS - 1).astype(int)


def cutoffs(rows: list[tuple[int, int, int]], rate: float = FDR) -> dict[int, int]:
    """Least bin of each stratum that the Benjamini-Hochberg rule accepts, from counts of (stratum, bin)."""
    out = {}
    for s in sorted({r[0] for r in rows}):
        counts = np.zeros(P_BINS)
        for t, b, n in rows:
            if t == s:
                counts[b] += n
        m, above = counts.sum(), counts[::-1].cumsum()[::-1]
        edge = 10 ** (-np.arange(P_BINS) / 8)  # the largest p of a bin
        good = np.flatnonzero((above > 0) & (edge * m <= rate * above))
        if len(good):
            out[s] = int(good[0])
    return out


def _rows_of(lists: pa.ListArray) -> np.ndarray:
    """The row of each value of a list column."""
    return np.repeat(np.arange(len(lists)), lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))


def _overlaps(strings: pa.StructArray, row: np.ndarray, base: pa.ListArray) -> np.ndarray:
    """Which strings overlap a base match of their row; base matches are sorted by their start. Logarithmic for each."""
    if not len(strings):
        return np.zeros(0, bool)
    of, spans = _rows_of(base), base.flatten()
    place = lambda x, r: x.to_numpy(zero_copy_only=False).astype(np.int64) + (r.astype(np.int64) << 32)
    begin, reach = place(spans.field("s"), of), np.maximum.accumulate(np.append(0, place(spans.field("e"), of)))
    before = np.searchsorted(begin, place(strings.field("e"), row))  # those that begin before the string ends
    return reach[before] > place(strings.field("s"), row)


def scan(docs: DataFrame, text: str, keep: tuple[str, ...]) -> DataFrame:
    """One pass: base (array of kind, s, e by start and kind) and tested strings (s, e, stratum, bin, random)."""
    out = docs.select(*keep, F.col(text).alias("__text"))
    for kind in KINDS:
        out = with_spans(out, "__text", kind, PATTERNS[kind], (lambda x: F.length(x["g"]) >= 6) if kind == "assign" else None, group=2 if kind == "assign" else 0)
    out = with_spans(out, "__text", "__strings", STRING)

    def of(i: int) -> Column:
        return F.transform(KINDS[i], lambda x: F.struct(x["s"].alias("s"), F.lit(i).alias("k"), x["e"].alias("e")))

    base = F.array_sort(F.concat(*[of(i) for i in range(len(KINDS))]))
    names = F.array(*[F.lit(k) for k in KINDS])
    out = out.withColumn("base", F.transform(base, lambda x: F.struct(F.get(names, x["k"]).alias("kind"), x["s"].alias("s"), x["e"].alias("e"))))
    slim = F.transform("__strings", lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e"), x["m"].alias("m")))
    out = out.select(*keep, "base", slim.alias("__strings"))
    tested = T.ArrayType(T.StructType([T.StructField(n, T.LongType()) for n in ("s", "e", "stratum", "bin")] + [T.StructField("random", T.BooleanType())]))
    schema = T.StructType([*out.schema.fields[:-1], T.StructField("tested", tested)])

    def run(batches):
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow = to_arrow_schema(schema)
        for batch in batches:
            strings = batch.column(batch.num_columns - 1)
            flat, row = strings.flatten(), _rows_of(strings)
            free = ~_overlaps(flat, row, batch.column(batch.num_columns - 2))
            flat, row = flat.filter(pa.array(free)), row[free]
            kept = [batch.column(i).cast(arrow.field(i).type) for i in range(batch.num_columns - 1)]
            parts = []
            for a in range(0, len(flat), 20_000):
                some = flat.slice(a, 20_000)
                t = battery(some.field("m").to_pylist())
                random = (t["random"] > BATTERY) & (t["text"] < 1)
                columns = [some.field("s"), some.field("e"), pa.array(_stratum(t["encoding"], t["n"])), pa.array(_bin(t["text"])), pa.array(random)]
                parts.append(pa.StructArray.from_arrays([c.cast(f.type) for c, f in zip(columns, arrow.field(len(kept)).type.value_type)], fields=list(arrow.field(len(kept)).type.value_type)))
            values = pa.concat_arrays(parts) if parts else pa.array([], arrow.field(len(kept)).type.value_type)
            offsets = pa.array(np.searchsorted(row, np.arange(batch.num_rows + 1)).astype(np.int32))
            tested_now = pa.ListArray.from_arrays(offsets, values).cast(arrow.field(len(kept)).type)
            yield pa.RecordBatch.from_arrays([*kept, tested_now], names=arrow.names)
        release()

    return out.mapInArrow(run, schema)


def find(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",), rate: float = FDR) -> DataFrame:
    """Kept columns with ``base`` and ``spans``: arrays of (kind, s, e) by start, then kind.

    ``spans`` has the base matches and strings of kind ``random`` that overlap none of them. Null and empty texts
    have none. Strings of digits only are never discoveries; words with hyphens, slashes or capitals are left to the
    rule. Ties in p share a bin and are accepted together. Repeated rows have equal results; an empty table gives an empty
    result; a kept column that is called like a result (base, spans) gives way to it, others may have any name. Texts are
    read once, whole; only counts are shuffled.
    """
    keep = tuple(c for c in keep if c not in ("base", "spans"))
    own = [f"__keep{i}" for i in range(len(keep))]  # kept columns travel under names of their own
    docs = docs.select(*[F.col(f"`{c}`").alias(o) for c, o in zip(keep, own)], F.col(f"`{text}`").cast("string").alias("__given"))
    scanned = durable(scan(docs, "__given", tuple(own)))
    counts = scanned.select(F.explode("tested").alias("t")).where("t.bin > 0 OR t.random").groupBy("t.stratum", "t.bin").count()
    totals = scanned.select(F.explode("tested").alias("t")).groupBy("t.stratum").count().collect()
    rows = [(r[0], r[1], r[2]) for r in counts.collect()]
    for stratum, n in totals:  # the strings with the largest p count in the rule as well
        rows.append((stratum, 0, n - sum(r[2] for r in rows if r[0] == stratum)))
    cut = cutoffs(rows, rate)
    least = F.create_map(*[F.lit(v).cast("bigint") for kv in cut.items() for v in kv]) if cut else F.create_map().cast("map<bigint,bigint>")
    hit = F.filter("tested", lambda x: x["random"] & (x["bin"] >= F.coalesce(least[x["stratum"]], F.lit(P_BINS))))
    more = F.transform(hit, lambda x: F.struct(F.lit("random").alias("kind"), x["s"].alias("s"), x["e"].alias("e")))
    order = F.array(*[F.lit(k) for k in (*KINDS, "random")])
    ranked = F.array_sort(F.transform(F.concat("base", more), lambda x: F.struct(x["s"].alias("s"), F.array_position(order, x["kind"]).alias("k"), x["e"].alias("e"), x["kind"].alias("kind"))))
    return scanned.select(*[F.col(o).alias(c) for c, o in zip(keep, own)], "base", F.transform(ranked, lambda x: F.struct(x["kind"].alias("kind"), x["s"].alias("s"), x["e"].alias("e"))).alias("spans"))


def op2_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets in every whole text of ``documents``."""
    found = find(table(spark, sf_dir, "documents", "doc_id", "text"))
    count = lambda k: F.size(F.filter("base", lambda x: x["kind"] == k)).cast("bigint")
    return found.select("doc_id", *[count(k).alias(f"n_{k}") for k in KINDS], F.sha2(joined(F.col("base")).cast("binary"), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))
