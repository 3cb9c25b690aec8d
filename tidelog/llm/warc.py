"""WARC: records of web archives, and revisit records ("not modified") resolved to the full response they repeat.

The resolution is an as-of join by canonical URL: a revisit takes the latest earlier full response, or the one that its
record names by URL and date. Its validators or digests are checked, and the headers that a not-modified answer may
update are merged into the stored ones.
"""

from __future__ import annotations

import io
import zlib
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidelog.llm.common import durable, release, table

#: Headers that a not-modified answer may carry on to the stored response (RFC 9110, 15.4.5, and validators).
PERMITTED = ("cache-control", "content-location", "date", "etag", "expires", "last-modified", "vary")

RECORD = T.StructType(
    [T.StructField("record_id", T.StringType()), T.StructField("type", T.StringType()), T.StructField("url", T.StringType()), T.StructField("date", T.StringType()), T.StructField("headers", T.MapType(T.StringType(), T.StringType())), T.StructField("status", T.IntegerType()), T.StructField("http", T.MapType(T.StringType(), T.StringType())), T.StructField("payload", T.BinaryType()), T.StructField("at", T.LongType()), T.StructField("error", T.StringType())]
)
#: Bytes of a gzip file that are decompressed at a time, and bytes of records that leave a task together, about.
READ_BYTES, BATCH_BYTES = 1 << 16, 8_000_000
#: Profile of revisits that say that the payload is the same (the last part of its URI).
IDENTICAL = "identical-payload-digest"


# ---------------------------------------------------------------- files


def _members(data: bytes) -> Iterator[tuple[int, bytes | None]]:
    """(place, bytes) of each gzip member, one for each record as the format has it; None for what is damaged or cut off.

    Reading goes on at the next gzip signature after a damaged member. Every byte is decompressed once.
    """
    at, view = 0, memoryview(data)
    while at < len(data):
        if data[at : at + 2] != b"\x1f\x8b":  # padding between members, or the rest of a damaged one
            next_one = data.find(b"\x1f\x8b\x08", at)
            if data[at : next_one if next_one >= 0 else None].strip(b"\0\r\n "):
                yield at, None
            if next_one < 0:
                return
            at = next_one
        member, out, spot = zlib.decompressobj(31), [], at
        try:
            while not member.eof and spot < len(data):
                out.append(member.decompress(view[spot : spot + READ_BYTES]))
                spot = min(spot + READ_BYTES, len(data))
        except zlib.error:
            pass
        if member.eof:
            yield at, b"".join(out)
            at = spot - len(member.unused_data)
        else:
            yield at, None
            next_one = data.find(b"\x1f\x8b\x08", at + 3)
            if next_one < 0:
                return
            at = next_one


def _fields(lines: list[bytes]) -> dict[str, str]:
    out: dict[str, str] = {}
    last = None
    for line in lines:
        text = line.decode("utf-8", "replace")
        if text[:1] in " \t" and last:
            out[last] += " " + text.strip()
        elif ":" in text:
            name, value = text.split(":", 1)
            last = name.strip().lower()
            value = value.strip()
            out[last] = f"{out[last]}, {value}" if last in out else value
    return out


def _damaged(at: int, error: str) -> dict:
    return {"record_id": None, "type": None, "url": None, "date": None, "headers": {}, "status": None, "http": {}, "payload": None, "at": at, "error": error}


def parse(data: bytes) -> Iterator[dict]:
    """Records of one WARC file, plain or gzipped by record, in its order.

    What is damaged or cut off is a record of its own, null but for the place in the file and an error; whole records
    after it are read.
    """
    if data[:2] != b"\x1f\x8b":
        yield from _records(io.BytesIO(data), 0)
        return
    for at, member in _members(data):
        if member is None:
            yield _damaged(at, "damaged member")
        else:
            for record in _records(io.BytesIO(member), 0):
                yield record | {"at": at}


def _records(stream: io.BytesIO, base: int) -> Iterator[dict]:
    while True:
        at = base + stream.tell()
        line = stream.readline()
        while line in (b"\r\n", b"\n"):
            at = base + stream.tell()
            line = stream.readline()
        if not line:
            return
        if not line.startswith(b"WARC/"):
            continue
        lines = []
        while (line := stream.readline()) not in (b"\r\n", b"\n", b""):
            lines.append(line.rstrip(b"\r\n"))
        head = _fields(lines)
        try:
            length = max(0, int(head.get("content-length", "0")))
        except ValueError:
            length = 0
        block = stream.read(length)
        if len(block) < length or line == b"":
            yield _damaged(at, "cut off")
            return
        status, http, payload = None, {}, block
        if head.get("content-type", "").lower().startswith("application/http"):
            top, _, payload = block.partition(b"\r\n\r\n")
            rows = top.split(b"\r\n")
            word = rows[0].split(b" ")
            status = int(word[1]) if len(word) > 1 and word[1].isdigit() and len(word[1]) < 10 else None
            http = _fields(rows[1:])
        yield {"record_id": head.get("warc-record-id"), "type": head.get("warc-type"), "url": head.get("warc-target-uri"), "date": head.get("warc-date"), "headers": head, "status": status, "http": http, "payload": payload, "at": at, "error": None}


def build(record: dict) -> bytes:
    """One record as WARC/1.1 bytes: type, record_id, url, date, status, http (a dict), payload and headers (further ones)."""
    http = f"HTTP/1.1 {record.get('status') or 200} -\r\n" + "".join(f"{k}: {v}\r\n" for k, v in (record.get("http") or {}).items()) + "\r\n"
    block = http.encode() + (record.get("payload") or b"")
    more = "".join(f"{k}: {v}\r\n" for k, v in (record.get("headers") or {}).items())
    head = f"WARC/1.1\r\nWARC-Type: {record['type']}\r\nWARC-Record-ID: {record['record_id']}\r\nWARC-Target-URI: {record['url']}\r\nWARC-Date: {record['date']}\r\n{more}Content-Type: application/http;msgtype=response\r\nContent-Length: {len(block)}\r\n\r\n"
    return head.encode() + block + b"\r\n\r\n"


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """Records of all WARC files under ``path``, damaged ones with their error.

    A file is one task's unit (up to 2 GB, as the format's writers keep well below); records leave it a few MB at a time.
    """

    def run(batches):
        import pyarrow as pa
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow = to_arrow_schema(RECORD)
        for batch in batches:
            for data in batch.column(0):
                held, size = [], 0
                for record in parse(data.as_py() or b""):
                    held.append(record | {"headers": list(record["headers"].items()), "http": list(record["http"].items())})
                    size += len(record["payload"] or b"") + 1000
                    if size >= BATCH_BYTES:
                        yield pa.RecordBatch.from_pylist(held, schema=arrow)
                        held, size = [], 0
                if held:
                    yield pa.RecordBatch.from_pylist(held, schema=arrow)
        release()

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.warc*").load(path)
    return files.select("content").mapInArrow(run, RECORD)


def to_records(read: DataFrame) -> DataFrame:
    """What ``resolve`` takes, from what ``read_warc`` gives; damaged records and other types go.

    Times are microseconds since 1970 (null where the date can't be read). A digest is the record's own payload digest,
    else the SHA-256 of the payload.
    """
    h = F.col("headers")
    micros = lambda c: F.unix_micros(F.try_to_timestamp(c))
    full = F.col("type") == "response"
    sha = F.when(full, F.sha2("payload", 256))
    return read.where("error IS NULL AND type IN ('response', 'revisit')").select(
        "record_id", "url", micros(F.col("date")).alias("ts"), "type", "http",
        sha.alias("payload_sha256"),
        F.when(full, F.octet_length("payload").cast("bigint")).alias("payload_bytes"),
        F.coalesce(F.lower(h["warc-payload-digest"]), F.concat(F.lit("sha256:"), sha)).alias("digest"),
        F.regexp_extract(h["warc-profile"], "([^/]*)/*$", 1).alias("profile"),
        h["warc-refers-to-target-uri"].alias("refers_url"),
        micros(h["warc-refers-to-date"]).alias("refers_ts"),
    )


def with_payloads(resolved: DataFrame, read: DataFrame) -> DataFrame:
    """Resolved records with their payload: a response's own, a resolved revisit's that of the response it refers to.

    Responses that are read twice have one payload. Ids are joined, so payloads are moved once; a response that very many
    revisits refer to is left to the split of skewed joins, its side being a stored row.
    """
    stored = read.where("error IS NULL AND type = 'response'").groupBy(F.col("record_id").alias("__of")).agg(F.min("payload").alias("payload"))
    of = F.when(F.col("type") == "response", F.col("record_id")).otherwise(F.col("refers_to"))
    return resolved.withColumn("__of", of).join(durable(stored), "__of", "left").drop("__of")


# ---------------------------------------------------------------- resolution


def canonical(url: Column) -> Column:
    """Host in lower case without www., user and default port, path without a closing slash, sorted query without utm_
    parameters; no scheme or fragment. Null stays null; what has no scheme is taken as it is, without its fragment."""
    bare = F.regexp_replace(url, "#.*$", "")
    whole = r"^([A-Za-z][A-Za-z0-9+.-]*)://([^/?]*)([^?]*)(.*)$"
    scheme, place = F.lower(F.regexp_extract(bare, whole, 1)), F.lower(F.regexp_extract(bare, whole, 2))
    host = F.regexp_replace(place, "^.*@", "")
    host = F.when(scheme == "http", F.regexp_replace(host, ":80$", "")).when(scheme == "https", F.regexp_replace(host, ":443$", "")).otherwise(host)
    host = F.regexp_replace(host, r"^www\.", "")
    path = F.regexp_replace(F.regexp_extract(bare, whole, 3), "/$", "")
    parts = F.filter(F.split(F.regexp_replace(F.regexp_extract(bare, whole, 4), r"^\?", ""), "&"), lambda x: (x != "") & ~x.startswith("utm_"))
    query = F.when(F.size(parts) > 0, F.concat(F.lit("?"), F.array_join(F.array_sort(parts), "&"))).otherwise("")
    return F.when(bare.rlike(whole), F.concat(host, path, query)).otherwise(bare)


def _prior(records: DataFrame, group: str, order: tuple[str, ...], value: str, out: str) -> DataFrame:
    """A column with the latest earlier non-null ``value`` of the same group in the order of ``order``.

    An as-of join that no hot group can hurt: rows are dealt by ranges of (group, order), so a large group lies in
    many parts; within a part a window finds the latest value; across parts a window over one row for each part and
    group carries it on. Rows of a null group have no earlier value.
    """
    n = int(records.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    parts = durable(records.repartitionByRange(n, group, *order).withColumn("__part", F.spark_partition_id()))
    inside = Window.partitionBy("__part", group).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    local = parts.withColumn("__local", F.last(value, ignorenulls=True).over(inside))
    ends = parts.where(F.col(value).isNotNull()).groupBy(group, "__part").agg(F.max_by(value, F.struct(*order)).alias("__end"))
    every = parts.groupBy(group, "__part").agg(F.lit(1).alias("__one")).join(ends, [group, "__part"], "left")
    before = Window.partitionBy(group).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    carried = every.select(group, "__part", F.last("__end", ignorenulls=True).over(before).alias("__carry")).where("__carry IS NOT NULL")
    return local.join(carried, [group, "__part"], "left").withColumn(out, F.coalesce("__local", "__carry")).drop("__part", "__local", "__carry")


def resolve(records: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """Revisits joined with the latest earlier full response of their canonical URL.

    ``records``: record_id, url, ts, type (response or revisit), http (map of lower-case names), payload_sha256,
    payload_bytes; and, if they exist, digest, profile, refers_url and refers_ts. Earlier means a smaller ts or, at the
    same ts, a smaller record_id; rows alike in both are ordered by type, digest and headers. A revisit that names a URL or
    a date takes the latest full response of that URL, up to and at that date. Adds canonical, refers_to and ``status``:
    ``full`` (a response), ``resolved``, ``changed`` (validators or digests differ), ``unchecked`` (nothing in common to
    compare; not resolved) or ``missing`` (no earlier response; so too where URL or time is null). An entity tag decides if
    both have one (weak comparison), else the modification date, else the digest; the digest first where the profile says
    that payloads are identical. A resolved revisit takes payload figures and headers of the response, with those of its
    own that a not-modified answer may carry. Only figures move, never payloads. Repeated rows have a row each. Empty tables
    give empty results; other types of records are left out; null headers are empty maps. ``keep`` names further columns;
    one that is called like a result gives way to it.
    """
    none = F.create_map().cast("map<string,string>")
    text = F.lit(None).cast("string")
    optional = lambda c, other: F.col(c) if c in records.columns else other
    names = ("record_id", "url", "canonical", "ts", "type", "status", "refers_to", "http", "payload_sha256", "payload_bytes")
    keep = tuple(c for c in keep if c not in names)
    r = records.where(F.col("type").isin("response", "revisit")).select(
        "record_id", "url", "ts", "type", F.coalesce("http", none).alias("http"), "payload_sha256", "payload_bytes",
        optional("digest", text).alias("__digest"), optional("profile", text).alias("__profile"),
        optional("refers_url", text).alias("__refers_url"), optional("refers_ts", F.lit(None).cast("bigint")).alias("__refers_ts"),
        F.struct(*[F.col(f"`{c}`") for c in keep]).alias("__kept") if keep else F.lit(None).cast("int").alias("__kept"),
    )
    response = F.col("type") == "response"
    named = ~response & F.col("__refers_ts").isNotNull()
    r = r.withColumns({
        "canonical": canonical(F.col("url")),
        "__named": F.when(named, 1).otherwise(0),
        "__asof": F.when(named, F.col("__refers_ts")).otherwise(F.col("ts")),
        "__http": F.xxhash64(F.array_sort(F.map_entries("http"))),
    })
    r = r.withColumn("__key", F.when(F.col("__asof").isNotNull(), F.when(~response & F.col("__refers_url").isNotNull(), canonical(F.col("__refers_url"))).otherwise(F.col("canonical"))))
    full = F.when(response & F.col("__key").isNotNull(), F.struct("record_id", "http", "payload_sha256", "payload_bytes", "__digest"))
    r = _prior(r.withColumn("__full", full), "__key", ("__asof", "__named", "record_id", "type", "payload_sha256", "__http"), "__full", "__prior").drop("__full")
    weak = lambda c: F.regexp_replace(c, "^W/", "")
    both = lambda a, b, same: F.when(a.isNotNull() & b.isNotNull(), same(a) == same(b))
    plain = lambda c: c
    by_digest = both(F.col("__digest"), F.col("__prior.__digest"), plain)
    identical = F.coalesce(F.col("__profile"), F.lit("")) == IDENTICAL
    same = F.coalesce(
        F.when(identical, by_digest),
        both(F.col("http")["etag"], F.col("__prior.http")["etag"], weak),
        both(F.col("http")["last-modified"], F.col("__prior.http")["last-modified"], plain),
        by_digest,
    )
    status = F.when(response, "full").when(F.col("__prior").isNull() | F.col("__key").isNull(), "missing").when(same.isNull(), "unchecked").when(same, "resolved").otherwise("changed")
    r = r.withColumn("status", status)
    carried = F.map_filter("http", lambda k, v: k.isin(*PERMITTED))
    kept = F.map_filter("__prior.http", lambda k, v: ~F.array_contains(F.map_keys(carried), k))
    done = F.col("status") == "resolved"
    pick = lambda c: F.when(response, F.col(c)).when(done, F.col(f"__prior.{c}"))
    return r.select(
        "record_id", "url", "canonical", "ts", "type", "status",
        F.when(done, F.col("__prior.record_id")).alias("refers_to"),
        F.when(done, F.map_concat(kept, carried)).otherwise(F.col("http")).alias("http"),
        pick("payload_sha256").alias("payload_sha256"),
        pick("payload_bytes").alias("payload_bytes"),
        *[F.col(f"__kept.`{c}`").alias(c) for c in keep],
    )


def captures(pages: DataFrame) -> DataFrame:
    """Four captures of each page, as archive records; what they carry follows from the page's id and size alone.

    The first is a full response, but for every fifth page. The second is a not-modified answer under another spelling of
    the URL, with the validators of the first, of another version, or none. The third is a new version, or an answer for
    the old one. The fourth answers for the newest version, by its digest (some) or by naming the first capture (some).
    Some servers send no entity tag, some of these no date either.
    """
    n, k = F.col("page_id"), F.col("k")
    html = F.coalesce("html", F.lit(""))
    p = pages.select(n, "url", html.alias("html"), F.octet_length(html).cast("bigint").alias("size"), F.explode(F.array(*[F.lit(i) for i in range(4)])).alias("k"))
    again = (k >= 2) & (n % 2 == 0)
    response = ((k == 0) & (n % 5 != 0)) | ((k == 2) & again)
    version = F.col("size") % 3 + F.when((k == 1) & (n % 3 == 1), 10).when(again, 20).otherwise(0)
    payload = F.when(again, F.concat("html", F.lit("#2"))).otherwise(F.col("html")).cast("binary")
    size = F.col("size") + F.when(again, 2).otherwise(0)
    digest = F.concat(F.lit("sha256:"), F.sha2(payload, 256))
    tagged = (n % 7 != 3) & ~((k == 1) & (n % 3 == 2))
    dated = ((n % 7 == 3) & (n % 14 != 3)) | (n % 4 == 1)
    by_digest, by_name = (k == 3) & (n % 6 == 1), (k == 3) & (n % 6 == 5)
    url = F.when(k == 1, F.regexp_replace(F.regexp_replace("url", "^(http://[^/?#]*)", "$1:80"), "^(https://[^/?#]*)", "$1:443")).when(k == 2, F.concat("url", F.lit("#again"))).otherwise(F.col("url"))
    none = F.create_map().cast("map<string,string>")
    only = lambda when, name, value: F.when(when, F.create_map(F.lit(name), value)).otherwise(none)
    http = F.map_concat(
        F.create_map(F.lit("cache-control"), F.concat(F.lit("max-age="), ((n + k) % 100).cast("string")), F.lit("content-length"), F.when(response, size.cast("string")).otherwise("0"), F.lit("date"), F.concat(F.lit("t"), (k * 1_000_000 + n).cast("string"))),
        only(tagged, "etag", F.concat(F.when((n + k) % 2 == 0, "W/").otherwise(""), F.lit('"v'), version.cast("string"), F.lit('"'))),
        only(dated, "last-modified", F.concat(F.lit("m"), version.cast("string"))),
        only(response, "content-type", F.lit("text/html")),
        only(~response, "x-cache", F.lit("hit")),
    )
    return p.select(
        (n * 4 + k).alias("record_id"), n, k, url.alias("url"), (k * 1_000_000 + n).cast("bigint").alias("ts"),
        F.when(response, "response").otherwise("revisit").alias("type"), http.alias("http"),
        F.when(response, F.sha2(payload, 256)).alias("payload_sha256"), F.when(response, size).alias("payload_bytes"),
        F.when(response | by_digest, digest).alias("digest"), F.when(by_digest, IDENTICAL).alias("profile"),
        F.when(by_name, F.col("url")).alias("refers_url"), F.when(by_name, n).cast("bigint").alias("refers_ts"),
    )


def op5_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All ``pages``, captured four times each, with not-modified captures resolved."""
    found = resolve(captures(table(spark, sf_dir, "pages", "page_id", "url", "html")), keep=("page_id",))
    headers = F.array_join(F.transform(F.array_sort(F.map_entries("http")), lambda x: F.concat_ws(": ", x["key"], x["value"])), "\n")
    return found.select("record_id", "page_id", "canonical", "type", "status", "refers_to", headers.alias("headers"), "payload_sha256", "payload_bytes")


_CANONICAL = r"""CASE WHEN regexp_matches(u, '^[A-Za-z][A-Za-z0-9+.-]*://') THEN
  regexp_replace(regexp_replace(regexp_replace(lower(regexp_extract(u, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?]*)', 1)), '^.*@', ''),
    CASE WHEN lower(u) LIKE 'http://%' THEN ':80$' WHEN lower(u) LIKE 'https://%' THEN ':443$' ELSE '^$' END, ''), '^www\.', '')
  || regexp_replace(regexp_extract(u, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?]*([^?]*)', 1), '/$', '')
  || CASE WHEN len(q) > 0 THEN '?' || array_to_string(list_sort(q), '&') ELSE '' END
  ELSE u END"""
OP5_SQL = rf"""
WITH p AS (
  SELECT page_id AS n, k, url, coalesce(html, '') AS html, coalesce(octet_length(encode(html)), 0) AS size
  FROM pages CROSS JOIN (SELECT unnest([0, 1, 2, 3]) AS k)),
f AS (
  SELECT *, k >= 2 AND n % 2 = 0 AS again, (k = 0 AND n % 5 <> 0) OR (k = 2 AND n % 2 = 0) AS response,
    k = 3 AND n % 6 = 1 AS by_digest, k = 3 AND n % 6 = 5 AS by_name,
    n % 7 <> 3 AND NOT (k = 1 AND n % 3 = 2) AS tagged, (n % 7 = 3 AND n % 14 <> 3) OR n % 4 = 1 AS dated,
    size % 3 + CASE WHEN k = 1 AND n % 3 = 1 THEN 10 WHEN k >= 2 AND n % 2 = 0 THEN 20 ELSE 0 END AS version,
    CASE WHEN k = 1 THEN regexp_replace(regexp_replace(url, '^(http://[^/?#]*)', '\1:80'), '^(https://[^/?#]*)', '\1:443') WHEN k = 2 THEN url || '#again' ELSE url END AS own
  FROM p),
u AS (
  SELECT *, regexp_replace(own, '#.*$', '') AS u, n * 4 + k AS id, k * 1000000 + n AS ts, sha256(CASE WHEN again THEN html || '#2' ELSE html END) AS sha, size + CASE WHEN again THEN 2 ELSE 0 END AS bytes
  FROM f),
q AS (SELECT *, list_filter(string_split(regexp_extract(u, '^[A-Za-z][A-Za-z0-9+.-]*://[^?]*\?(.*)$', 1), '&'), lambda x: x <> '' AND NOT starts_with(x, 'utm_')) AS q FROM u),
c AS (
  SELECT *, {_CANONICAL} AS canonical,
    CASE WHEN tagged THEN '"v' || version || '"' END AS tag, CASE WHEN dated THEN 'm' || version END AS modified,
    CASE WHEN response OR by_digest THEN sha END AS digest
  FROM q),
w AS (
  SELECT *, last_value(CASE WHEN response AND canonical IS NOT NULL THEN struct_pack(id := id, bytes := bytes, sha := sha, tag := tag, modified := modified) END IGNORE NULLS)
    OVER (PARTITION BY canonical ORDER BY CASE WHEN by_name THEN n ELSE ts END, CASE WHEN by_name THEN 1 ELSE 0 END, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prior
  FROM c),
s AS (
  SELECT *, CASE WHEN response THEN 'full' WHEN prior IS NULL OR canonical IS NULL THEN 'missing' ELSE CASE
    coalesce(CASE WHEN by_digest THEN digest = prior.sha END, tag = prior.tag, modified = prior.modified, digest = prior.sha)
    WHEN true THEN 'resolved' WHEN false THEN 'changed' ELSE 'unchecked' END END AS status
  FROM w)
SELECT id AS record_id, n AS page_id, canonical, CASE WHEN response THEN 'response' ELSE 'revisit' END AS type, status,
  CASE WHEN status = 'resolved' THEN prior.id END AS refers_to,
  'cache-control: max-age=' || ((n + k) % 100) || chr(10)
  || 'content-length: ' || CASE WHEN status = 'resolved' THEN prior.bytes WHEN response THEN bytes ELSE 0 END || chr(10)
  || CASE WHEN status = 'resolved' OR response THEN 'content-type: text/html' || chr(10) ELSE '' END
  || 'date: t' || ts
  || coalesce(chr(10) || 'etag: ' || CASE WHEN tagged THEN CASE WHEN (n + k) % 2 = 0 THEN 'W/' ELSE '' END || tag
       WHEN status = 'resolved' THEN CASE WHEN (prior.id // 4 + prior.id % 4) % 2 = 0 THEN 'W/' ELSE '' END || prior.tag END, '')
  || coalesce(chr(10) || 'last-modified: ' || CASE WHEN status = 'resolved' THEN coalesce(modified, prior.modified) ELSE modified END, '')
  || CASE WHEN NOT response AND status <> 'resolved' THEN chr(10) || 'x-cache: hit' ELSE '' END AS headers,
  CASE WHEN response THEN sha WHEN status = 'resolved' THEN prior.sha END AS payload_sha256,
  CAST(CASE WHEN response THEN bytes WHEN status = 'resolved' THEN prior.bytes END AS BIGINT) AS payload_bytes
FROM s
"""
