"""Benchmark decontamination by a prefix-filtered join with exact containment over item-sized windows.

A window is contained in a document only if all of its words are, so the necessary prefix is one word: the
rarest of the window by the counts of the whole corpus. Document words join those prefix words; the place of the
word in the window gives the only place where the window can begin; windows that would begin before or end after
the document are dropped (positional and length bound); the rest are compared word by word.

A benchmark of up to a megabyte is broadcast as an index. Of a larger one only the prefix words are, in blocks; the
document windows they point at and the benchmark's windows meet in a join by their words.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidelog.llm.common import durable, map_text, release, sized, stored, table

#: Words of a window.
WINDOW = 13
#: Bytes of benchmark text that are broadcast as an index, and prefix words of a larger benchmark that one pass over the
#: documents takes with it (some 30 MB).
BLOCK_BYTES, PREFIX_WORDS = 1_000_000, 200_000

#: Bytes of words: 0-9, a-z and all above 0x7F; A-Z are lower-cased, all other bytes separate words.
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def words(text: str | None) -> list[bytes]:
    """The words of a text, as UTF-8."""
    return text.encode("utf-8", "surrogatepass").translate(_FOLD).split() if text else []


def windows(item: list[bytes], size: int = WINDOW) -> list[list[bytes]]:
    """All runs of ``size`` words; an item of fewer words is one window, an item without words has none."""
    return [item[i : i + size] for i in range(max(1, len(item) - size + 1))] if item else []


def document_counts(docs: DataFrame, text: str, vocabulary: set[bytes]) -> dict[bytes, int]:
    """In how many documents each word of a bounded vocabulary occurs, over all documents."""
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def make():
        known = shared.value

        def apply(texts):
            seen: Counter = Counter()
            for t in texts:
                seen.update(known.intersection(words(t)))
            return [list(seen), list(seen.values())]

        return apply

    found = map_text(docs, text, [], [("word", T.BinaryType()), ("n", T.LongType())], make, rows=True)
    return {bytes(r[0]): r[1] for r in found.groupBy("word").agg(F.sum("n")).collect()}


def prefix_index(block: list[tuple[str, list[bytes]]], counts: dict[bytes, int], size: int) -> dict:
    """rarest word -> {(place in the window, length): {window: ids of its items}}."""
    index: dict = {}
    for key, item in block:
        for window in windows(item, size):
            place = min(range(len(window)), key=lambda i: (counts.get(window[i], 0), window[i], i))
            if counts.get(window[place], 0) == 0:
                continue  # a word that no document has
            spots = index.setdefault(window[place], {})
            ids = spots.setdefault((place, len(window)), {}).setdefault(b" ".join(window), [])
            if key not in ids:
                ids.append(key)
    return index


def merge(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Sorted spans without overlaps."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            if b > out[-1][1]:
                out[-1] = (out[-1][0], b)
        else:
            out.append((a, b))
    return out


def contained(doc: list[bytes], index: dict) -> tuple[list[tuple[int, int]], set[str]]:
    """Word spans of all occurrences of the index's windows, and the ids of their items."""
    spans, ids = [], set()
    for at, word in enumerate(doc):
        if word in index:
            for (place, length), held in index[word].items():
                begin = at - place
                if begin >= 0 and begin + length <= len(doc):
                    found = held.get(b" ".join(doc[begin : begin + length]))
                    if found:
                        spans.append((begin, begin + length))
                        ids.update(found)
    return merge(spans), ids


_PAIRS = T.ArrayType(T.ArrayType(T.IntegerType()))
_FIELDS = [("n_words", T.LongType()), ("n_hit", T.LongType()), ("hit_spans", _PAIRS), ("items", T.ArrayType(T.StringType()))]


def contamination(docs: DataFrame, benchmark: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",), item_id: str = "item_id", item_text: str = "text", size: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Kept columns with n_words, n_hit, hit_spans (word positions, merged) and items (ids of the items found).

    Null and empty texts have no words and no hits. A null item id counts as the empty string; items of null text
    or without words have no window; equal ids are one item. Repeated rows have repeated results; very long texts are read
    whole; an empty table of documents gives an empty result, an empty benchmark no hits. A kept column that is called
    like a result gives way to it, others may have any name. A benchmark of up to ``block_bytes`` is counted over all
    documents, broadcast, and sought in one pass without a shuffle; see ``_joined`` for a larger one.
    """
    items = benchmark.select(F.coalesce(F.col(f"`{item_id}`").cast("string"), F.lit("")).alias("id"), F.col(f"`{item_text}`").cast("string").alias("text")).where("text != ''")
    if (items.agg(F.sum(F.octet_length("text"))).first()[0] or 0) > block_bytes:
        return _joined(docs, items, text, keep, size)
    block = [(r["id"], words(r["text"])) for r in items.toLocalIterator(prefetchPartitions=False)]
    counts = document_counts(docs, text, {w for _, item in block for w in item}) if any(i for _, i in block) else {}
    shared = docs.sparkSession.sparkContext.broadcast(prefix_index(block, counts, size))

    def make():
        index = shared.value

        def apply(texts):
            n_words, n_hit, spans, ids = [], [], [], []
            for t in texts:
                doc = words(t)
                found, names = contained(doc, index)
                n_words.append(len(doc))
                n_hit.append(sum(b - a for a, b in found))
                spans.append(found)
                ids.append(sorted(names))
            return [n_words, n_hit, spans, ids]

        return apply

    return map_text(docs, text, keep, _FIELDS, make)


# ---------------------------------------------------------------- large benchmarks


def _words_of(df: DataFrame, text: str, key: str | None) -> DataFrame:
    """With ``key``: (key, at, word) of each text. Without: (word, n), the documents of a chunk of texts that have it."""

    def make():
        def apply(texts, *keys):
            if keys:
                found = [(k, i, w) for t, k in zip(texts, keys[0]) for i, w in enumerate(words(t))]
                return [list(c) for c in zip(*found)] if found else [[], [], []]
            seen: Counter = Counter()
            for t in texts:
                seen.update(set(words(t)))
            return [list(seen), list(seen.values())]

        return apply

    if key is None:
        return map_text(df, text, [], [("word", T.BinaryType()), ("n", T.LongType())], make, rows=True)
    return map_text(df, text, [], [("key", T.LongType()), ("at", T.IntegerType()), ("word", T.BinaryType())], make, also=(key,), rows=True)


def _windows_of(items: DataFrame, size: int) -> DataFrame:
    """(word, spot, window, ids): each window of each item (text, ids, counts by position), by its rarest word.

    ``spot`` is the word's place in the window times 64, plus the window's length. Windows with a word that no document has
    are left out.
    """

    def make():
        def apply(texts, ids, counts):
            out = []
            for t, own, count in zip(texts, ids, counts):
                item = words(t)
                known = dict.fromkeys(range(len(item)), 0) | {c["at"]: c["n"] for c in count or ()}
                for begin, window in enumerate(windows(item, size)):
                    place = min(range(len(window)), key=lambda i: (known[begin + i], window[i], i))
                    if known[begin + place]:
                        out.append((window[place], place * 64 + len(window), b" ".join(window), own))
            return [list(c) for c in zip(*out)] if out else [[], [], [], []]

        return apply

    fields = [("word", T.BinaryType()), ("spot", T.IntegerType()), ("window", T.BinaryType()), ("ids", T.ArrayType(T.StringType()))]
    return map_text(items, "text", [], fields, make, also=("ids", "counts"), rows=True)


def _pointed_at(docs: DataFrame, text: str, index: dict[bytes, list[int]]) -> DataFrame:
    """(k1, k2, begin, window): document windows that a prefix word points at, within the document."""
    shared = docs.sparkSession.sparkContext.broadcast(index)

    def make():
        known = shared.value

        def apply(texts, k1, k2):
            out = []
            for t, a, b in zip(texts, k1, k2):
                doc = words(t)
                seen = set()
                for at, word in enumerate(doc):
                    for spot in known.get(word, ()):
                        place, length = divmod(spot, 64)
                        begin = at - place
                        if begin >= 0 and begin + length <= len(doc) and (begin, length) not in seen:
                            seen.add((begin, length))
                            out.append((a, b, begin, b" ".join(doc[begin : begin + length])))
            return [list(c) for c in zip(*out)] if out else [[], [], [], []]

        return apply

    fields = [("k1", T.LongType()), ("k2", T.LongType()), ("begin", T.IntegerType()), ("window", T.BinaryType())]
    return map_text(docs, text, [], fields, make, also=("__k1", "__k2"), rows=True)


def _joined(docs: DataFrame, items: DataFrame, text: str, keep: tuple[str, ...], size: int) -> DataFrame:
    """``contamination`` for a benchmark of any size: two passes over the documents and one more for each PREFIX_WORDS.

    Words are counted by partial sums. Hits belong to texts, named by 128 bits of hashes, so copies of a document are one.
    Benchmark windows and hits are stored tables, a row for each window or text, so skewed joins can be split.
    """
    assert size < 64
    counts = stored(_words_of(docs, text, None).groupBy("word").agg(F.sum("n").alias("n")))
    items = stored(items.groupBy("text").agg(F.collect_set("id").alias("ids")).withColumn("key", F.xxhash64("text")))
    known = _words_of(items, "text", "key").join(counts, "word").groupBy("key").agg(F.collect_set(F.struct("at", "n")).alias("counts"))
    found = stored(_windows_of(items.join(known, "key"), size))
    prefix = stored(found.groupBy("word").agg(F.collect_set("spot").alias("spots")))
    by_window = stored(found.groupBy("window").agg(F.array_distinct(F.flatten(F.collect_set("ids"))).alias("ids")))
    given = docs.withColumns({"__k1": F.xxhash64(F.col(f"`{text}`").cast("string")), "__k2": F.xxhash64(F.lit("text"), F.col(f"`{text}`").cast("string"))})
    hits = None
    for index in _prefix_blocks(prefix, PREFIX_WORDS):
        some = _pointed_at(given, text, index).distinct().join(by_window, "window")
        length = F.octet_length("window") - F.octet_length(F.expr("replace(cast(window AS string), ' ', '')")) + 1
        some = stored(some.select("k1", "k2", F.struct("begin", (F.col("begin") + length).alias("end")).alias("span"), "ids"))
        hits = some if hits is None else hits.unionByName(some)
    if hits is None:
        hits = docs.sparkSession.createDataFrame([], "k1 bigint, k2 bigint, span struct<begin:int,end:int>, ids array<string>")
    hits = stored(hits.groupBy("k1", "k2").agg(F.collect_set("span").alias("spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("ids")))).alias("ids")))

    def count():
        return lambda texts: [[len(words(t)) for t in texts]]

    keep = tuple(c for c in keep if c not in {n for n, _ in _FIELDS})
    counted = map_text(given, text, (*keep, "__k1", "__k2"), [("n_words", T.LongType())], count)
    small = sized(hits.select(F.col("k1").alias("__k1"), F.col("k2").alias("__k2"), "spans", F.col("ids").alias("__ids")), weight=F.size("spans") + F.size("__ids"))
    joined = counted.join(small, ["__k1", "__k2"], "left")
    schema = T.StructType([*(joined.schema[c] for c in keep), *(T.StructField(n, t) for n, t in _FIELDS)])

    def finish(batches):
        import pyarrow as pa
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow = to_arrow_schema(schema)
        for batch in batches:
            n_words, spans, ids = (batch.column(len(keep) + i) for i in range(3))
            merged = [merge([(x["begin"], x["end"]) for x in s or ()]) for s in spans.to_pylist()]
            columns = [batch.column(i).cast(arrow.field(i).type) for i in range(len(keep))]
            made = [n_words.to_pylist(), [sum(b - a for a, b in m) for m in merged], merged, [i or [] for i in ids.to_pylist()]]
            yield pa.RecordBatch.from_arrays(columns + [pa.array(c, arrow.field(len(keep) + i).type) for i, c in enumerate(made)], names=arrow.names)
        release()

    return joined.select(*[F.col(f"`{c}`") for c in keep], "n_words", "spans", "__ids").mapInArrow(finish, schema)


def _prefix_blocks(prefix: DataFrame, most: int) -> Iterator[dict[bytes, list[int]]]:
    """The prefix words (word, spots), in blocks of a bounded number."""
    index: dict[bytes, list[int]] = {}
    for r in prefix.toLocalIterator(prefetchPartitions=False):
        index[bytes(r["word"])] = r["spots"]
        if len(index) >= most:
            yield index
            index = {}
    if index:
        yield index


def is_contaminated():
    """At least one hit word, and at least a twentieth of the words."""
    return (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))


def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hits of all ``benchmark`` windows in every whole text of ``documents``."""
    found = contamination(table(spark, sf_dir, "documents", "doc_id", "text"), table(spark, sf_dir, "benchmark", "item_id", "text"))
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("bigint").alias("n_items"),
        F.sha2(F.concat_ws(",", F.array_sort("items")).cast("binary"), 256).alias("items_sha256"),
        is_contaminated().alias("contaminated"),
    )


OP6_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id,
         coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w
  FROM documents),
b AS (
  SELECT CAST(item_id AS VARCHAR) AS item,
         coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w
  FROM benchmark),
win AS (
  SELECT DISTINCT item, least(len(w), 13) AS n, array_to_string(list_slice(w, i, i + least(len(w), 13) - 1), ' ') AS x
  FROM (SELECT item, w, unnest(range(1, greatest(len(w) - 13, 0) + 2)) AS i FROM b WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM win),
dw AS (
  SELECT r, n, i, array_to_string(list_slice(w, i, i + n - 1), ' ') AS x
  FROM (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, sizes WHERE len(w) >= n)),
hit AS (SELECT dw.r, dw.i, dw.n, win.item FROM dw JOIN win ON dw.x = win.x AND dw.n = win.n),
spot AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT DISTINCT r, unnest(range(i, i + n)) AS p FROM hit) GROUP BY r),
it AS (SELECT r, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS items FROM hit GROUP BY r)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(items, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(d.w) AS contaminated
FROM d LEFT JOIN spot ON d.r = spot.r LEFT JOIN it ON d.r = it.r
"""
