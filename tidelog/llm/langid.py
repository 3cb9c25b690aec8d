"""Language identification by error-correcting output codes.

Each language has a codeword; each bit of the code is a binary logistic classifier over hashed byte n-grams;
decoding takes the codeword of least weighted logistic loss, flags texts whose two best codewords are close and
rejects texts that are far from every codeword.
"""

from __future__ import annotations

import itertools
import pickle
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidelog.llm.common import crc_mod, exact_sample, map_text, release, table

#: Hashed features of a text.
DIMS = 4096
#: Training rows for each language at most (the bounded sample that is fitted), and for all of them together: above 10
#: languages each has its part of these, so that every language is learned and the task that fits holds 131 MB of features
#: at most (two rows of DIMS half-precision numbers for each text).
SAMPLE, SAMPLE_TOTAL = 800, 8_000
#: Difference of the two best codewords' shares below which a text is ambiguous.
AMBIGUOUS = 0.1
#: Weighted logistic loss for each bit from which on a text may be far from a codeword (a bit that knows nothing costs
#: 0.69), and the share of the sample that is never far: where labels can't be told apart, few texts are rejected.
FAR, NEAR_SHARE = 0.4, 0.999
#: Letters below which a text has too little in it to be rejected as far.
FAR_LETTERS = 20
#: Answer where there is no letter.
UNKNOWN = "und"

_LETTER = re.compile(r"[^\W\d_]")
#: ASCII letters and all bytes above 0x7F stay, everything else is a blank.
_FOLD = np.array([b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256)], np.uint64)


def features(texts: list[str], dims: int = DIMS) -> np.ndarray:
    """Square roots of the shares of hashed byte bigrams and trigrams (lower-cased letters), a unit row per text."""
    out = np.zeros((len(texts), dims), np.float32)
    for i, text in enumerate(texts):
        b = _FOLD[np.frombuffer(f" {text.lower()} ".encode("utf-8", "surrogatepass"), np.uint8)]
        two = b[:-1] * np.uint64(257) + b[1:]
        two = two[two != 32 * 257 + 32]
        three = (b[:-2] * np.uint64(66049) + b[1:-1] * np.uint64(257) + b[2:])[(b[:-2] != 32) | (b[1:-1] != 32)]
        both = np.concatenate([two * np.uint64(0x9E3779B97F4A7C15), three * np.uint64(0xC2B2AE3D27D4EB4F)]) >> np.uint64(40)
        out[i] = np.sqrt(np.bincount((both % np.uint64(dims)).astype(np.int64), minlength=dims))
    norm = np.sqrt((out * out).sum(1, keepdims=True))
    return out / np.maximum(norm, 1e-9)


def code_matrix(k: int, seed: int = 7) -> np.ndarray:
    """Codewords of k classes in -1 and 1: the exhaustive code up to 7 classes, else the best of dense random codes."""
    if k < 2:
        return np.zeros((k, 0))
    if k <= 7:
        columns = [c for c in itertools.product((-1, 1), repeat=k) if c[0] == 1 and -1 in c]
        return np.array(columns, float).T
    rng = np.random.default_rng(seed)
    best, most = None, -1
    for _ in range(200):
        m = rng.choice((-1.0, 1.0), size=(k, int(np.ceil(10 * np.log2(k)))))
        alike = m @ m.T
        np.fill_diagonal(alike, -m.shape[1])
        apart = int((m.shape[1] - alike.max()) // 2)
        if apart > most:
            best, most = m, apart
    return best


def fit(x: np.ndarray, y: np.ndarray, k: int, steps: int = 200, rate: float = 4.0, ridge: float = 1e-5) -> dict:
    """The bits' classifiers by gradient descent with momentum; classes weigh alike; a bit's weight is its accuracy."""
    code = code_matrix(k)
    if not code.shape[1]:
        return {"code": code, "w": np.zeros((x.shape[1], 0)), "b": np.zeros(0), "bit": np.zeros(0)}
    target = code[y].astype(np.float32)
    weight = (1.0 / np.maximum(np.bincount(y, minlength=k), 1))[y]
    weight = (weight / weight.sum()).astype(np.float32)[:, None]
    w, b = np.zeros((x.shape[1], code.shape[1]), np.float32), np.zeros(code.shape[1], np.float32)
    vw, vb = np.zeros_like(w), np.zeros_like(b)
    # rows are half precision and are widened block by block, so the sample is held once
    blocks = [slice(a, a + 512) for a in range(0, len(x), 512)]
    for _ in range(steps):
        gw, gb = ridge * w, np.zeros_like(b)
        for s in blocks:
            some = x[s].astype(np.float32)
            g = -target[s] * weight[s] / (1 + np.exp(np.clip(target[s] * (some @ w + b), -30, 30)))
            gw += some.T @ g
            gb += g.sum(0)
        vw, vb = 0.9 * vw - rate * gw, 0.9 * vb - rate * gb
        w, b = w + vw, b + vb
    right = np.concatenate([(x[s].astype(np.float32) @ w + b) * target[s] > 0 for s in blocks])
    accuracy = np.clip((right * weight).sum(0), 0.5, 0.999)
    return {"code": code, "w": w.astype(np.float32), "b": b, "bit": np.log(accuracy / (1 - accuracy)) + 1e-3}


def decode(model: dict, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Class, share of the nearest codeword, distance to the second one's share, and loss to the nearest codeword."""
    code, bit = model["code"], model["bit"]
    if not code.shape[1]:
        return np.zeros(len(x), int), np.ones(len(x)), np.ones(len(x)), np.zeros(len(x))
    margin = x @ model["w"] + model["b"]
    each = np.logaddexp(0, -margin[:, None, :] * code[None]) @ (bit / bit.sum())
    loss = each * np.log2(len(code) + 1) * 2
    share = np.exp(loss.min(1, keepdims=True) - loss)
    share /= share.sum(1, keepdims=True)
    first = share.argmax(1)
    ordered = np.sort(share, 1)
    return first, ordered[:, -1], ordered[:, -1] - ordered[:, -2], each.min(1)


def far_from(model: dict, x: np.ndarray) -> float:
    """The loss above which a text is far from every codeword, given the sample that was fitted."""
    seen = [decode(model, x[a : a + 512].astype(np.float32))[3] for a in range(0, len(x), 512)]
    return max(FAR, float(np.quantile(np.concatenate(seen), NEAR_SHARE)))


def _learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The pickled model of all rows (x, y), sorted by label and features; none where there is no row. The rows are held once."""
    held, label = bytearray(), []
    for batch in batches:
        held += b"".join(batch.column("x").to_pylist())
        label += batch.column("y").to_pylist()
    if label:
        names = sorted(set(label))
        number = {n: i for i, n in enumerate(names)}
        x, y = np.frombuffer(held, np.float16).reshape(-1, DIMS), np.array([number[n] for n in label], int)
        model = fit(x, y, len(names))
        model = {"names": names} | model | {"far": far_from(model, x)}
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(model)], pa.binary())], names=["model"])
        del x
    del held
    release()


def train(labelled: DataFrame, text: str = "text", lang: str = "lang", key: str = "doc_id", sample: int = SAMPLE) -> dict:
    """Fit on ``sample`` different rows of each language at most, chosen by a hash of key and text; whole texts are read.

    Every language is learned, however many there are (``SAMPLE_TOTAL``); null and hot keys are drawn like others.
    One task fits the sample, in the order of label and features; the driver gets the model alone.
    """
    rows = exact_sample(labelled.where(F.col(text).rlike(r"\p{L}")), key, text, lang, sample, SAMPLE_TOTAL)

    def make():
        def apply(texts, langs):
            x, y = [], []
            for t, g in zip(texts, langs):
                if _LETTER.search(t):
                    middle = len(t) // 2
                    for s in (t, t[middle : middle + 80]):  # a short window too, as there are short texts
                        if _LETTER.search(s):
                            x.append(s)
                            y.append(g)
            f = features(x)
            return [[r.astype(np.float16).tobytes() for r in f], y]

        return apply

    found = map_text(rows, text, [], [("x", T.BinaryType()), ("y", T.StringType())], make, also=(lang,), rows=True)
    got = found.repartition(1).sortWithinPartitions("y", "x").mapInArrow(_learn, "model binary").collect()
    return pickle.loads(got[0]["model"]) if got else {"names": []}


def identify(docs: DataFrame, model: dict, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Kept columns with lang_pred, score (share of the nearest codeword, 0 to 1), ambiguous and rejected.

    Null texts and texts without a letter are ``und`` with score 0 and not ambiguous, as are all texts where
    nothing was learned. Rejected are null texts, texts without a letter and, where two labels and more were learned,
    texts of ``FAR_LETTERS`` letters and more that are far from every codeword. Ties go to the first language in
    alphabetical order. Very long texts are read whole; an empty table gives an empty result; repeated rows have repeated
    results; a kept column that is called like a result gives way to it, others may have any name. No shuffle.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    fields = [("lang_pred", T.StringType()), ("score", T.DoubleType()), ("ambiguous", T.BooleanType()), ("rejected", T.BooleanType())]

    def make():
        m = shared.value

        def apply(texts):
            has = [i for i, t in enumerate(texts) if t and _LETTER.search(t)]
            pred, score, unsure, out = [UNKNOWN] * len(texts), [0.0] * len(texts), [False] * len(texts), [True] * len(texts)
            for i in has:
                out[i] = False
            has = has if m["names"] else []
            for a in range(0, len(has), 128):
                some = has[a : a + 128]
                first, share, gap, loss = decode(m, features([texts[i] for i in some]))
                for i, f, s, g, d in zip(some, first.tolist(), share.tolist(), gap.tolist(), loss.tolist()):
                    pred[i], score[i], unsure[i] = m["names"][f], min(1.0, s), g < AMBIGUOUS
                    out[i] = d > m["far"] and sum(1 for _ in itertools.islice(_LETTER.finditer(texts[i]), FAR_LETTERS)) == FAR_LETTERS
            return [pred, score, unsure, out]

        return apply

    return map_text(docs, text, keep, fields, make)


def held_in(docs: DataFrame) -> DataFrame:
    """The rows that may be learned from: crc32 of doc_id as text, modulo 4, is not 2."""
    return docs.where(crc_mod("doc_id", 4) != 2)


def op7_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every whole text of ``documents``."""
    docs = table(spark, sf_dir, "documents", "doc_id", "text", "lang")
    found = identify(docs, train(held_in(docs)))
    return found.select("doc_id", (crc_mod("doc_id", 4) == 2).alias("held_out"), "lang_pred", "score", "ambiguous")
