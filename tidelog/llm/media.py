"""Media columns: interleaved document sequences.

HTML is parsed to an ordered sequence of text and media-reference structs, with the caption and the position of
each reference. Media are stored losslessly in PNG form (8-bit grey samples, 64 to a row) in a content-addressed
table; a join on the digest resolves the references to payloads, so that positions, captions and media stay aligned.
"""

from __future__ import annotations

import binascii
import hashlib
import html as html_text
import math
import struct
import zlib
from html.parser import HTMLParser

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidelog.llm.common import durable, map_text, release, table

#: Samples of a row.
WIDTH = 64
#: References of one digest that may meet in one task, and how many digests can have more (all references divided by this
#: is the least number of a hot one, so there can't be more; they are broadcast).
HOT_REFS, HOT_DIGESTS = 500, 10_000
ITEM = T.StructType([T.StructField("position", T.IntegerType()), T.StructField("kind", T.StringType()), T.StructField("text", T.StringType()), T.StructField("ref", T.StringType()), T.StructField("digest", T.StringType()), T.StructField("caption", T.StringType())])
_SILENT = ("script", "style", "template", "noscript")
_BLOCKS = ("p", "div", "article", "section", "h1", "h2", "h3", "h4", "h5", "h6", "li", "ul", "ol", "table", "tr", "td", "th", "blockquote", "pre", "br", "hr", "title", "nav", "footer", "header", "body", "head", "html", "figure", "main", "aside", "form")
_MEDIA = ("img", "video", "audio", "source", "embed", "object")


class _Sequence(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.items: list[dict] = []
        self.text: list[str] = []
        self.silent = 0
        self.figure: list[int] = []
        self.caption: list[str] | None = None

    def flush(self) -> None:
        text = " ".join("".join(self.text).split())
        self.text = []
        if text:
            self.items.append({"kind": "text", "text": text, "ref": None, "digest": None, "caption": None})

    def handle_starttag(self, tag, attrs):
        if tag in _SILENT:
            self.silent += 1
        elif tag == "figcaption":
            self.flush()
            self.caption = []
        elif tag in _MEDIA:
            a = dict(attrs)
            ref = a.get("src") or a.get("data")
            if ref:
                self.flush()
                digest = ref[len("digest:sha256/") :] if ref.startswith("digest:sha256/") else None
                self.items.append({"kind": "media", "text": None, "ref": ref, "digest": digest, "caption": a.get("alt") or a.get("title")})
        elif tag in _BLOCKS:
            self.flush()
            if tag == "figure":
                self.figure.append(len(self.items))

    def handle_startendtag(self, tag, attrs):
        if tag not in _SILENT:
            self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag):
        if tag in _SILENT:
            self.silent = max(0, self.silent - 1)
        elif tag == "figcaption" and self.caption is not None:
            caption = " ".join("".join(self.caption).split())
            self.caption = None
            inside = self.figure[-1] if self.figure else len(self.items)
            media = [x for x in self.items[inside:] if x["kind"] == "media"]
            for x in media:  # a figure's caption goes before the reference's own words
                x["caption"] = caption or x["caption"]
            if not media and caption:
                self.items.append({"kind": "text", "text": caption, "ref": None, "digest": None, "caption": None})
        elif tag in _BLOCKS:
            self.flush()
            if tag == "figure" and self.figure:
                self.figure.pop()

    def handle_data(self, data):
        if not self.silent:
            (self.text if self.caption is None else self.caption).append(data)


def sequence(page: str | None) -> list[dict]:
    """Text and media references of an HTML page in document order; null and empty pages have none."""
    parser = _Sequence()
    parser.feed(page or "")
    parser.close()
    if parser.caption:
        parser.text.extend(parser.caption)
    parser.flush()
    return [{"position": i} | x for i, x in enumerate(parser.items)]


def sequences(pages: DataFrame, html: str = "html", keep: tuple[str, ...] = ("page_id",)) -> DataFrame:
    """Kept columns with ``items``: array of (position, kind, text, ref, digest, caption) in document order.

    Null and empty pages have no items; very long pages are parsed whole, in linear time; repeated rows have repeated
    results. A kept column that is called ``items`` gives way; others may have any name.
    """

    def make():
        return lambda pages: [[sequence(p) for p in pages]]

    return map_text(pages, html, keep, [("items", T.ArrayType(ITEM))], make)


# ---------------------------------------------------------------- storing


def _chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", binascii.crc32(kind + data))


def payload_of(text: str | None) -> tuple[int, bytes]:
    """UTF-8 length, and the bytes with zeros appended up to a positive multiple of 64."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    return len(raw), raw.ljust(max(WIDTH, -(-len(raw) // WIDTH) * WIDTH), b"\0")


def to_png(payload: bytes) -> bytes:
    """The payload as 8-bit grey samples, 64 to a row, without filters."""
    rows = np.zeros((len(payload) // WIDTH, WIDTH + 1), np.uint8)
    rows[:, 1:] = np.frombuffer(payload, np.uint8).reshape(-1, WIDTH)
    head = struct.pack(">IIBBBBB", WIDTH, len(rows), 8, 0, 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + _chunk(b"IHDR", head) + _chunk(b"IDAT", zlib.compress(rows.tobytes(), 1)) + _chunk(b"IEND", b"")


def from_png(media: bytes) -> bytes:
    """The samples of a PNG that ``to_png`` wrote; checks every chunk's sum and the form."""
    if media[:8] != b"\x89PNG\r\n\x1a\n":
        raise ValueError("not a PNG")
    at, data, head = 8, b"", None
    while at < len(media):
        (n,) = struct.unpack_from(">I", media, at)
        kind, body = media[at + 4 : at + 8], media[at + 8 : at + 8 + n]
        if binascii.crc32(kind + body) != struct.unpack_from(">I", media, at + 8 + n)[0]:
            raise ValueError("a chunk's sum is wrong")
        head, data = (body if kind == b"IHDR" else head), (data + body if kind == b"IDAT" else data)
        at += 12 + n
    width, height = struct.unpack(">II", head[:8])
    rows = np.frombuffer(zlib.decompress(data), np.uint8).reshape(height, width + 1)
    if rows[:, 0].any():
        raise ValueError("a filter that isn't in use here")
    return rows[:, 1:].tobytes()


def feature(payload: bytes) -> str:
    """Rows, distinct samples, sum, sum of squares and counts of the samples in 16 equal bins, as text."""
    x = np.frombuffer(payload, np.uint8)
    counts = np.bincount(x, minlength=256)
    value = np.arange(256)
    bins = counts.reshape(16, 16).sum(1)
    return f"rows={len(x) // WIDTH};distinct={int((counts > 0).sum())};sum={int((counts * value).sum())};squares={int((counts * value * value).sum())};bins=" + ",".join(map(str, bins.tolist()))


def page_of(text: str | None, digest: str) -> str:
    """An HTML page with the lines of a text as paragraphs, and a figure of the media named after the first half of them."""
    lines = [x for x in (text or "").split("\n") if x.strip()]
    body = [f"<p>{html_text.escape(x)}</p>" for x in lines]
    n = len((text or "").encode("utf-8", "surrogatepass"))
    figure = f'<figure><img src="digest:sha256/{digest}" alt="text"><figcaption>{n} bytes</figcaption></figure>'
    half = (len(body) + 1) // 2
    return "".join(["<article>", *body[:half], figure, *body[half:], "</article>"])


def to_pages(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Kept columns with n_bytes and ``html``: each text as a page that shows its media between its paragraphs."""

    def make():
        def apply(texts):
            n_bytes, pages = [], []
            for t in texts:
                n, payload = payload_of(t)
                n_bytes.append(n)
                pages.append(page_of(t, hashlib.sha256(to_png(payload)).hexdigest()))
            return [n_bytes, pages]

        return apply

    return map_text(docs, text, keep, [("n_bytes", T.LongType()), ("html", T.StringType())], make)


def to_media(docs: DataFrame, text: str = "text") -> DataFrame:
    """The content-addressed table of the texts' media: digest, media; equal texts may have a row each."""

    def make():
        def apply(texts):
            media = [to_png(payload_of(t)[1]) for t in dict.fromkeys(t or "" for t in texts)]
            return [[hashlib.sha256(m).hexdigest() for m in media], media]

        return apply

    return map_text(docs, text, [], [("digest", T.StringType()), ("media", T.BinaryType())], make, rows=True)


_RESOLVED = ("position", "ref", "caption", "digest", "media", "n_items", "texts_sha256")


def resolve(sequenced: DataFrame, store: DataFrame, keep: tuple[str, ...] = ("page_id",)) -> DataFrame:
    """One row per media reference: kept columns, position, ref, caption, digest, and the media that the digest names.

    Also n_items, and the digest of the sequence's texts (joined by line feeds). References that no media has, or without a
    digest, stay with null media. ``store``: digest, media; rows of one digest count once. A digest that very many
    references share (they are counted first) is dealt out in parts, and its one row of the store goes to each of them.
    Repeated rows have a row each; empty tables give empty results. A kept column that is called like a result gives way;
    others may have any name.
    """
    keep = tuple(c for c in keep if c not in _RESOLVED)
    texts = F.array_join(F.transform(F.filter("items", lambda x: x["kind"] == "text"), lambda x: x["text"]), "\n")
    # kept columns travel in a struct, so their names clash with nothing
    kept = F.struct(*[F.col(f"`{c}`") for c in keep]) if keep else F.lit(None).cast("int")
    refs = sequenced.select(kept.alias("kept"), F.explode("items").alias("item"), F.size("items").alias("n_items"), F.sha2(texts.cast("binary"), 256).alias("texts_sha256")).where("item.kind = 'media'")
    refs = durable(refs.select("kept", "n_items", "texts_sha256", "item.position", "item.ref", "item.caption", "item.digest"))
    most = max(HOT_REFS, math.ceil(refs.count() / HOT_DIGESTS))
    hot = refs.where("digest IS NOT NULL").groupBy("digest").agg(F.count("*").alias("n")).where(F.col("n") > most)
    hot = F.broadcast(durable(hot.select("digest", F.ceil(F.col("n") / most).cast("int").alias("parts"))))
    # the references are a stored table, so a row has the same number whenever it is read
    keyed = refs.where("digest IS NOT NULL").withColumn("row", F.monotonically_increasing_id()).join(hot, "digest", "left")
    known = store.where("digest IS NOT NULL")
    # media are moved once: what brings the rows of a digest together serves the join, too
    single = known.join(hot, "digest", "left_anti").groupBy("digest").agg(F.first("media").alias("media"))
    found = keyed.where("parts IS NULL").drop("row", "parts").join(single, "digest", "left")
    spread = known.join(hot, "digest").groupBy("digest", "parts").agg(F.first("media").alias("media"))
    spread = spread.select("digest", "media", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    dealt = keyed.where("parts IS NOT NULL").withColumn("part", F.pmod("row", "parts").cast("int")).drop("row", "parts")
    found = found.unionByName(dealt.join(spread, ["digest", "part"], "left").drop("part"))
    rest = refs.where("digest IS NULL").withColumn("media", F.lit(None).cast("binary"))
    return found.unionByName(rest).select(*[F.col(f"kept.`{c}`").alias(c) for c in keep], *_RESOLVED)


_FIGURES = T.StructType(
    [T.StructField("payload_bytes", T.LongType()), T.StructField("payload_sha256", T.StringType()), T.StructField("tail_crc32", T.LongType()), T.StructField("media_bytes", T.LongType()), T.StructField("media_sha256", T.StringType()), T.StructField("feature", T.StringType())]
)


def _figures(name: str | None, media: bytes | None) -> tuple:
    if media is None:
        return (None,) * len(_FIGURES)
    own = hashlib.sha256(media).hexdigest()
    if own != name:
        raise ValueError(f"stored media {name} has another digest: {own}")
    payload = from_png(media)
    return len(payload), hashlib.sha256(payload).hexdigest(), binascii.crc32(payload[-WIDTH:]), len(media), own, feature(payload)


def described(resolved: DataFrame, keep: tuple[str, ...]) -> DataFrame:
    """Kept columns with the figures of each row's media: the samples' bytes, sum and tail sum, the stored form's, features.

    The stored bytes are read back and held against their digest. Null media have null figures. Rows of one digest that
    follow each other are computed once.
    """
    keep = tuple(c for c in keep if c not in _FIGURES.names)
    schema = T.StructType([*(resolved.schema[c] for c in keep), *_FIGURES])

    def run(batches):
        import pyarrow as pa
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow = to_arrow_schema(schema)
        last = None, (None,) * len(_FIGURES)
        for batch in batches:
            rows = []
            for name, media in zip(batch.column(len(keep)).to_pylist(), batch.column(len(keep) + 1)):
                if name is None or name != last[0] or not media.is_valid:
                    last = (name if media.is_valid else None), _figures(name, media.as_py())
                rows.append(last[1])
            columns = [batch.column(i).cast(arrow.field(i).type) for i in range(len(keep))]
            columns += [pa.array([r[i] for r in rows], arrow.field(len(keep) + i).type) for i in range(len(_FIGURES))]
            yield pa.RecordBatch.from_arrays(columns, names=arrow.names)
        release()

    return resolved.select(*[F.col(f"`{c}`") for c in keep], F.col("digest").alias("__digest"), F.col("media").alias("__media")).mapInArrow(run, schema)


def op3_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every whole text of ``documents`` stored as media and shown between its paragraphs on a page, parsed and resolved.

    Null texts are empty; equal texts have equal values; an empty table gives an empty result.
    """
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    sequenced = sequences(to_pages(docs), keep=("doc_id", "n_bytes"))
    found = resolve(sequenced, to_media(docs), keep=("doc_id", "n_bytes"))
    return described(found, ("doc_id", "n_bytes", "position", "caption", "n_items", "texts_sha256"))
