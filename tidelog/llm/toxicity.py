"""Toxicity by a weighted lexicon, matched by an Aho-Corasick automaton over folded text.

Folding lower-cases, maps look-alike letters and digits that stand for letters, one character to one. The lexicon
(whole words, and stems that begin words) and its weights are learned from labelled documents, as are exception
phrases (a lexicon word with a neighbour that is common in clean documents). The sum of the weights, with and
without division by the length, goes through a fitted logistic curve.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidelog.llm.common import crc_mod, durable, exact_sample, map_text, table

#: Labelled documents of each label that are learned from at most. Nothing else bounds the lexicon and the phrases.
SAMPLE = 5000
#: An entry is in so many toxic documents at least, with so large a logarithm of the odds ratio and so large a
#: likelihood ratio (2 ln) against no association.
SUPPORT, LOG_ODDS, LIKELIHOOD = 4, 3.0, 20.0
#: Letters of a stem, least and most. An entry gives way to a longer one that has this share of its toxic documents.
STEM, COVERED = (4, 8), 0.9

# Look-alike letters of other scripts and the Latin letters they stand for.
_LOOKALIKES = {
    "а": "a", "в": "b", "с": "c", "ԁ": "d", "е": "e", "ѕ": "s", "һ": "h", "і": "i", "ј": "j", "к": "k", "ӏ": "l", "м": "m",
    "н": "h", "о": "o", "р": "p", "ԛ": "q", "г": "r", "т": "t", "у": "y", "ѵ": "v", "ԝ": "w", "х": "x", "ё": "e", "ї": "i",
    "α": "a", "β": "b", "ε": "e", "η": "n", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x",
    "ı": "i", "ɡ": "g", "ɑ": "a", "ʏ": "y", "ƒ": "f", "ℓ": "l", "ⅰ": "i", "ⅼ": "l", "ⅽ": "c", "ⅾ": "d", "ⅿ": "m",
}
# Digits and signs that stand for letters inside a word.
_DIGITS = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "l"}

_TABLE = {ord(k): v for k, v in _LOOKALIKES.items()}
_TABLE |= {ord(k.upper()): v for k, v in _LOOKALIKES.items() if len(k.upper()) == 1 and ord(k.upper()) > 127}
_TABLE |= {0xFF21 + i: chr(97 + i) for i in range(26)} | {0xFF41 + i: chr(97 + i) for i in range(26)} | {0xFF10 + i: chr(48 + i) for i in range(10)}
_TABLE |= {65 + i: chr(97 + i) for i in range(26)}
_TABLE |= {c: None for c in (0x200B, 0x200C, 0x200D, 0x2060, 0xFEFF, 0xAD)}
#: Signs beside which a digit or sign is read as a letter: a letter after it, or (digits only) a letter before it and no letter or digit after it.
_STANDS = re.compile(r"[01345789@$!|]+(?=[^\W\d_])|(?<=[^\W\d_])[013457]+(?![^\W_])")
_WORD = re.compile(r"[^\W\d_]+")
#: One search that tells whether a text needs the slow part of folding: any of the signs that may stand for letters.
_ODD = re.compile(f"[{re.escape(''.join(_DIGITS))}]")


def _letters(m: re.Match) -> str:
    return "".join(_DIGITS[c] for c in m[0])


def fold(text: str) -> str:
    """Lower-cased text, look-alikes and digit substitutions undone; invisible joiners go."""
    text = text.lower() if text.isascii() else text.lower().translate(_TABLE)
    return _STANDS.sub(_letters, text) if _ODD.search(text) else text


def _entries(text: str) -> set[str]:
    """The words of a folded text, and their stems with an asterisk."""
    out = set(_WORD.findall(text))
    return out | {f"{w[:k]}*" for w in out for k in range(STEM[0], min(len(w), STEM[1] + 1))}


def _is_entry(word: str, lexicon) -> bool:
    return word in lexicon or any(f"{word[:k]}*" in lexicon for k in range(STEM[0], min(len(word), STEM[1] + 1)))


def _phrases(text: str, lexicon) -> set[str]:
    """Two-word phrases with a lexicon word, as they stand in a folded text."""
    words = list(_WORD.finditer(text))
    pairs = ((a, b) for a, b in zip(words, words[1:]) if text[a.end() : b.start()] == " ")
    return {f"{a[0]} {b[0]}" for a, b in pairs if _is_entry(a[0], lexicon) or _is_entry(b[0], lexicon)}


def _counted(df: DataFrame, lexicon: dict | None) -> DataFrame:
    """Toxic and clean documents of each entry of the texts or, given a lexicon, of each phrase with an entry."""
    shared = df.sparkSession.sparkContext.broadcast(lexicon)

    def make():
        known = shared.value

        def apply(texts, labels):
            seen: dict[int, Counter] = {0: Counter(), 1: Counter()}
            for t, toxic in zip(texts, labels):
                seen[toxic].update(_entries(fold(t)) if known is None else _phrases(fold(t), known))
            grams = list(seen[0].keys() | seen[1].keys())
            return [grams, [seen[1][g] for g in grams], [seen[0][g] for g in grams]]

        return apply

    fields = [("gram", T.StringType()), ("toxic", T.LongType()), ("clean", T.LongType())]
    found = map_text(df, "text", [], fields, make, also=("toxic",), rows=True)
    return found.groupBy("gram").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))


def signature(text: str) -> int:
    """The least hash of a folded text's three-word runs: alike for most near copies."""
    w = _WORD.findall(fold(text))
    return min((zlib.crc32(" ".join(w[i : i + 3]).encode()) for i in range(max(1, len(w) - 2))), default=0)


def matches(text: str, automaton) -> tuple[float, int, int]:
    """Sum of weights, number of matches and number of words of a folded text.

    Entries begin words; whole words and phrases end with a word, too. Where several meet, the longest counts; an
    exception phrase has weight 0 and so covers the words in it.
    """
    n_words = len(_WORD.findall(text))
    if automaton is None or not text:
        return 0.0, 0, n_words
    found = []
    for end, (size, weight, stem) in automaton.iter(text):
        begin = end - size + 1
        if (begin == 0 or not text[begin - 1].isalnum()) and (stem or end + 1 == len(text) or not text[end + 1].isalnum()):
            found.append((begin, end, weight))
    found.sort(key=lambda x: (x[0] - x[1], x[0]))
    covered, total, n = set(), 0.0, 0
    for begin, end, weight in found:
        if begin in covered or end in covered:
            continue
        covered.update(range(begin, end + 1))
        total += weight
        n += weight > 0
    return total, n, n_words


def automaton_of(entries: dict[str, float]):
    """The automaton of words, stems (with an asterisk) and phrases; None for no entries."""
    import ahocorasick

    if not entries:
        return None
    a = ahocorasick.Automaton()
    for entry, weight in sorted(entries.items(), reverse=True):  # a word after its own stem, so the word stays
        bare = entry.rstrip("*")
        if bare not in a or not entry.endswith("*"):
            a.add_word(bare, (len(bare), weight, entry.endswith("*") or f"{bare}*" in entries))
    a.make_automaton()
    return a


def _signals(total: float, n: int, n_words: int) -> tuple[float, float, float]:
    """What the curve sees: matches at all, their weight, their weight by length."""
    return float(n > 0), math.log1p(total), math.log1p(100 * total / (n_words + 20))


def chosen(docs: DataFrame, labels: DataFrame, text: str = "text", toxic: str = "toxic", key: str = "doc_id", sample: int = SAMPLE) -> tuple[DataFrame, dict[int, int]]:
    """(text, toxic) of ``sample`` documents of each label at most, and how many keys each label has.

    A key with several labels is toxic if one of them says so; null keys and other labels are left out. ``sample`` keys of
    each label are drawn from the labels alone, by a hash, and broadcast, so no text is moved but the sample's. Documents
    that share a key share its label, and the sample is cut again by key and text: no hot key makes it larger.
    """
    rows = labels.where(F.col(f"`{toxic}`").isin(0, 1) & F.col(f"`{key}`").isNotNull()).select(F.col(f"`{key}`").alias("key"), F.col(f"`{toxic}`").cast("int").alias("toxic"))
    rows = rows.groupBy("key").agg(F.max("toxic").alias("toxic"))
    totals = {r[0]: r[1] for r in rows.groupBy("toxic").count().collect()}
    spot = F.pmod(F.xxhash64(F.lit("sample"), F.col("key").cast("string")), F.lit(1 << 30))
    share = F.lit(0.0)
    for label, n in totals.items():
        share = F.when(F.col("toxic") == label, min(1.0, (2 * sample + 20) / n)).otherwise(share)
    near = rows.withColumn("spot", spot).where(F.col("spot") < share * (1 << 30))
    order = Window.partitionBy("toxic").orderBy("spot", "key")
    drawn = durable(near.withColumn("at", F.row_number().over(order)).where(F.col("at") <= sample).select("key", "toxic"))
    found = docs.select(F.col(f"`{key}`").alias("key"), F.col(f"`{text}`").alias("text")).join(F.broadcast(drawn), "key")
    return durable(exact_sample(found, "key", "text", "toxic", sample, 2 * sample)), totals


def train(labelled: DataFrame, text: str = "text", toxic: str = "toxic", sample: int = SAMPLE, totals: dict[int, int] | None = None) -> dict:
    """Lexicon, exceptions and curve from ``sample`` different texts of each label at most, chosen by a hash.

    Null texts and other labels are left out; with one label only, all texts score alike. Entries are chosen by support,
    odds and likelihood alone. ``totals`` says how often each label occurs where ``labelled`` is a sample itself.
    """
    rows = labelled.where(F.col(f"`{toxic}`").isin(0, 1)).select(F.col(f"`{text}`").alias("text"), F.col(f"`{toxic}`").cast("int").alias("toxic"))
    rows = durable(exact_sample(rows, "text", "text", "toxic", sample, 2 * sample))

    def make():
        return lambda texts: [[signature(t) for t in texts]]

    # of near copies one is enough: the others would make all of its words look telling
    rows = map_text(rows, "text", ["text", "toxic"], [("signature", T.LongType())], make)
    rows = durable(rows.groupBy("signature", "toxic").agg(F.min("text").alias("text")).select("text", "toxic"))
    size = {r["toxic"]: r["count"] for r in rows.groupBy("toxic").count().collect()}
    n1, n0 = size.get(1, 0), size.get(0, 0)
    if not n1 or not n0:
        return {"entries": {}, "curve": [math.log((n1 + 1) / (n0 + 1)), 0.0, 0.0, 0.0]}
    a, b = F.col("toxic"), F.col("clean")
    odds = F.log((a + 0.5) / (n1 - a + 0.5)) - F.log((b + 0.5) / (n0 - b + 0.5))
    part = lambda x, whole, of: F.when(x > 0, x * F.log(x * (n1 + n0) / (whole * of))).otherwise(0.0)
    ratio = 2 * (part(a, a + b, n1) + part(b, a + b, n0) + part(n1 - a, n1 + n0 - a - b, n1) + part(n0 - b, n1 + n0 - a - b, n0))
    best = _counted(rows, None).where(a >= SUPPORT).withColumns({"w": odds, "g": ratio}).where((F.col("w") >= LOG_ODDS) & (F.col("g") >= LIKELIHOOD))
    best = best.orderBy(F.desc("g"), F.desc(F.length("gram")), "gram").collect()
    known = {r["gram"]: (r["toxic"], r["w"]) for r in best}
    covered = {f"{r['gram'][:k]}*" for r in best for k in range(STEM[0], len(r["gram"])) if r["toxic"] >= COVERED * known.get(f"{r['gram'][:k]}*", (math.inf,))[0] and f"{r['gram'][:k]}*" != r["gram"]}
    lexicon = {g: w for g, (_, w) in known.items() if g not in covered}
    entries = dict(lexicon)
    if lexicon:
        share = n1 / max(n0, 1)
        bad = _counted(rows, lexicon).where((b >= 5) & (b * share > 2 * a))
        entries |= {r["gram"]: 0.0 for r in bad.collect()}
    model = {"entries": entries, "curve": None}
    seen = score(rows, model, keep=("toxic",), raw=True).select("toxic", "total", "n", "n_words").collect()
    x = np.array([(1.0, *_signals(r["total"], r["n"], r["n_words"])) for r in seen]).reshape(len(seen), 4)
    y = np.array([r["toxic"] for r in seen], float)
    base = math.log((n1 + 1) / (n0 + 1))
    curve = np.array([base, 0.0, 0.0, 0.0])
    share = y.mean() if len(y) else 0.0
    # rows weigh as the labels occur in the whole table, not as in the sample
    whole = totals or {r[0]: r[1] for r in labelled.where(F.col(f"`{toxic}`").isin(0, 1)).groupBy(F.col(f"`{toxic}`").cast("int")).count().collect()}
    weight = np.where(y == 1, whole.get(1, 0) / max(n1, 1), whole.get(0, 0) / max(n0, 1))
    if 0 < share < 1:
        weight /= weight.sum()
        for _ in range(50):  # Newton's steps with a small ridge
            p = 1 / (1 + np.exp(-np.clip(x @ curve, -30, 30)))
            g = x.T @ (weight * (p - y)) + 1e-5 * curve
            h = (x * (weight * p * (1 - p))[:, None]).T @ x + 1e-5 * np.eye(4)
            step = np.linalg.solve(h, g)
            curve = curve - step * min(1.0, 3.0 / (np.abs(step).max() + 1e-12))
    return {"entries": entries, "curve": curve.tolist()}


def score(docs: DataFrame, model: dict, text: str = "text", keep: tuple[str, ...] = ("doc_id",), raw: bool = False) -> DataFrame:
    """Kept columns with score (0 to 1) and n_matches; with ``raw`` the sums behind it (total, n, n_words).

    Null and empty texts score as texts without a match. Very long texts are read whole, in linear time; repeated
    rows have repeated results; an empty table gives an empty result; without labels all texts score alike. A kept
    column that is called like a result gives way to it; others, ``toxic`` among them, may have any name. Where matches
    tie, the longest counts, then the first.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    if raw:
        fields = [("total", T.DoubleType()), ("n", T.LongType()), ("n_words", T.LongType())]
    else:
        fields = [("score", T.DoubleType()), ("n_matches", T.LongType())]

    def make():
        automaton, curve = automaton_of(shared.value["entries"]), shared.value["curve"]

        def apply(texts):
            found = [matches(fold(t or ""), automaton) for t in texts]
            if raw:
                return [list(c) for c in zip(*found)] if found else [[], [], []]
            out = []
            for f in found:
                z = curve[0] + sum(a * b for a, b in zip(curve[1:], _signals(*f)))
                out.append(1 / (1 + math.exp(-max(-30.0, min(30.0, z)))))
            return [out, [f[1] for f in found]]

        return apply

    return map_text(docs, text, keep, fields, make)


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every whole text of ``documents``, scored as ``labels.toxic`` marks it."""
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    labels = table(spark, sf_dir, "labels", "doc_id", "toxic").where((crc_mod("doc_id", 5) != 0) & F.col("toxic").isNotNull())
    sampled, totals = chosen(docs, labels)
    found = score(docs, train(sampled, totals=totals))
    return found.select("doc_id", (crc_mod("doc_id", 5) == 0).alias("held_out"), "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"), "n_matches")
