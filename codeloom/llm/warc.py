"""WARC records and the resolution of not-modified revisits."""

import hashlib
import re
import zlib
from datetime import UTC, datetime

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codeloom.llm.scratch import Scratch

# Headers that a 304 answer may replace in the stored response.
PERMITTED = ("cache-control", "content-location", "date", "etag", "expires", "vary")
RECORD = (
    "record_id string, kind string, url string, at bigint, status int, etag string, last_modified string, "
    "payload_digest string, headers map<string,string>, length bigint"
)


def canonical_url(url: Column) -> Column:
    """Host in lower case without ``www.`` or ``m.`` and default port, no scheme, fragment, tracking parameters or closing slash."""
    rest = F.regexp_replace(F.regexp_replace(F.trim(url), "(?i)^[a-z][a-z0-9+.-]*://", ""), "(?s)#.*$", "")
    host = F.regexp_replace(F.regexp_replace(F.lower(F.regexp_extract(rest, "^([^/?]*)", 1)), "^(www\\d*|m)\\.", ""), ":(80|443)$", "")
    path = F.regexp_replace(F.regexp_replace(F.regexp_extract(rest, "^[^/?]*([^?]*)", 1), "/index\\.html?$", "/"), "/+$", "")
    query = F.regexp_extract(rest, "(?s)\\?(.*)$", 1)
    kept = F.array_sort(F.filter(F.split(query, "&"), lambda p: (p != "") & ~p.rlike("^(utm_[a-z]+|ref|sid|sessionid)(=|$)")))
    return F.concat(host, path, F.when(F.size(kept) > 0, F.concat(F.lit("?"), F.array_join(kept, "&"))).otherwise(""))


def warc_record(kind: Column, record_id: Column, url: Column, at: Column, status: Column, headers: Column, payload: Column, digest: Column) -> Column:
    """One uncompressed WARC/1.1 record as text; ``headers`` is an array of 'Name: value' lines, ``digest`` may be null."""
    block = F.concat(F.lit("HTTP/1.1 "), status.cast("string"), F.lit(" -\r\n"), F.array_join(headers, "\r\n"), F.lit("\r\n\r\n"), F.coalesce(payload, F.lit("")))
    utc = F.date_format(F.to_utc_timestamp(F.timestamp_seconds(at), F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    lines = F.array_compact(
        F.array(
            F.lit("WARC/1.1"), F.concat(F.lit("WARC-Type: "), kind), F.concat(F.lit("WARC-Record-ID: <"), record_id, F.lit(">")),
            F.concat(F.lit("WARC-Target-URI: "), url), F.concat(F.lit("WARC-Date: "), utc), F.concat(F.lit("WARC-Payload-Digest: md5:"), digest),
            F.concat(F.lit("Content-Length: "), F.octet_length(block).cast("string")),
        )
    )
    return F.concat(F.array_join(lines, "\r\n"), F.lit("\r\n\r\n"), block, F.lit("\r\n\r\n"))


def _fields(block: bytes) -> dict[str, str]:
    """Header fields by lower-case name; of repeated fields the last."""
    out = {}
    for line in block.split(b"\r\n")[1:]:
        name, colon, value = line.partition(b":")
        if colon:
            out[name.strip().lower().decode("latin-1")] = value.strip().decode("utf-8", "replace")
    return out


def _plain(data: bytes) -> bytes:
    """What can be read of a gzip file, member by member, up to the first broken one."""
    out = []
    while data[:2] == b"\x1f\x8b":
        member = zlib.decompressobj(zlib.MAX_WBITS | 16)
        try:
            out.append(member.decompress(data))
        except zlib.error:
            # The bytes before the fault are read in small steps.
            member = zlib.decompressobj(zlib.MAX_WBITS | 16)
            try:
                for a in range(0, len(data), 64):
                    out.append(member.decompress(data[a : a + 64]))
            except zlib.error:
                break
        if not member.eof:
            break
        data = member.unused_data
    return b"".join(out)


def _second(text: str | None) -> int | None:
    """Seconds of an ISO 8601 time, UTC where it names no zone."""
    try:
        when = datetime.fromisoformat(text or "")
        return int((when if when.tzinfo else when.replace(tzinfo=UTC)).timestamp())
    except (ValueError, OverflowError):
        return None


def parse_warc(data: bytes):
    """The records of one WARC file, plain or gzip.

    A broken or cut-off compressed member and a record without a length in plain digits end the file; what
    comes before is kept, and of a record that would end after the file what is there.  A status that is not three digits, or a time that is none, is null.
    """
    if data[:2] == b"\x1f\x8b":
        data = _plain(data)
    at = 0
    while (at := data.find(b"WARC/", at)) >= 0:
        end = data.find(b"\r\n\r\n", at)
        if end < 0:
            return
        warc = _fields(data[at:end])
        length = warc.get("content-length", "")
        if not re.fullmatch("[0-9]{1,18}", length):
            return
        block = data[end + 4 : end + 4 + int(length)]
        at = end + 4 + int(length)
        head, _, payload = block.partition(b"\r\n\r\n")
        http = _fields(head)
        status = re.match(rb"HTTP/[^ ]* ([0-9]{3})(?![0-9])", head)
        kind = warc.get("warc-type")
        digest = warc.get("warc-payload-digest", "").removeprefix("md5:") or (hashlib.md5(payload).hexdigest() if kind == "response" else None)
        yield {
            "record_id": warc.get("warc-record-id", "").strip("<>") or None, "kind": kind, "url": warc.get("warc-target-uri"), "at": _second(warc.get("warc-date")),
            "status": int(status[1]) if status else None, "etag": http.get("etag"), "last_modified": http.get("last-modified"),
            "payload_digest": digest, "headers": list(http.items()), "length": len(payload),
        }


def read_warc(files: DataFrame, column: str = "content") -> DataFrame:
    """Records of the WARC files in a binary or text column.  Null files and files without records give no rows."""
    kinds = pa.schema(
        [("record_id", pa.string()), ("kind", pa.string()), ("url", pa.string()), ("at", pa.int64()), ("status", pa.int32()), ("etag", pa.string()),
         ("last_modified", pa.string()), ("payload_digest", pa.string()), ("headers", pa.map_(pa.string(), pa.string())), ("length", pa.int64())]
    )

    def run(batches):
        for batch in batches:
            rows = [r for data in batch.column(0) if data.is_valid for r in parse_warc(data.as_py())]
            for a in range(0, len(rows), 5000):
                yield pa.RecordBatch.from_pylist(rows[a : a + 5000], schema=kinds)

    return files.select(F.col(f"`{column}`").cast("binary")).mapInArrow(run, RECORD)


RESOLVED = ("canonical_url", "resolved_id", "verdict", "merged", "resolved_digest")


def resolve_revisits(records: DataFrame, bucket_seconds: int = 86_400, scratch: Scratch | None = None) -> DataFrame:
    """Adds canonical_url, resolved_id, verdict, merged and resolved_digest to each record.

    A full response (kind response, status 200) resolves to itself.  A revisit resolves to the latest full response of its
    canonical url with an earlier time, of several at one time the one with the largest record_id.  Verdicts: ``full``; ``orphan`` (no such
    response, one without a record_id, or no url or time); ``changed`` (a validator that the revisit gives - ETag compared weakly, Last-Modified, payload digest -
    differs); ``unverified`` (it gives none); ``resolved``; ``other`` for all other records.  ``merged`` holds the response's headers
    with the permitted ones of a resolved revisit in place of its own.  Repeated rows are resolved alike.

    The as-of join is cut by url and time bucket: the last response of each bucket is carried on over the url's buckets, so a hot
    url costs a task its rows of one bucket.  Payloads take no part in it.  Columns named like the added ones are replaced.
    """
    scratch = scratch or Scratch(records.sparkSession, "warc")
    used = ["record_id", "kind", "at", "status", "etag", "last_modified", "payload_digest", "headers"]
    own = F.struct(*[F.col(f"`{c}`") for c in records.columns]).alias("row")
    rows = records.select(own, *used, canonical_url(F.col("url")).alias("canonical_url"))
    full = (F.col("kind") == "response") & (F.col("status") == 200)
    rows = scratch.cut(rows.withColumns({"full": F.coalesce(full, F.lit(False)), "bucket": F.floor(F.col("at") / bucket_seconds)}), "records")
    placed = rows.filter("canonical_url is not null and at is not null")
    response = F.when(F.col("full"), F.struct("at", "record_id"))
    per_bucket = placed.groupBy("canonical_url", "bucket").agg(F.max(response).alias("last"))
    earlier = Window.partitionBy("canonical_url").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    carried = per_bucket.select("canonical_url", "bucket", F.max("last").over(earlier).alias("carried"))
    inside = Window.partitionBy("canonical_url", "bucket").orderBy("at").rangeBetween(Window.unboundedPreceding, -1)
    found = placed.withColumn("inside", F.max(response).over(inside)).join(carried, ["canonical_url", "bucket"])
    found = found.withColumn("earlier_id", F.coalesce("inside", "carried").getField("record_id")).drop("inside", "carried")
    lost = rows.filter("canonical_url is null or at is null").withColumn("earlier_id", F.lit(None).cast("string"))
    every = found.unionByName(lost).withColumn("resolved_id", F.when(F.col("full"), F.col("record_id")).when(F.col("kind") == "revisit", F.col("earlier_id")))
    source = rows.filter("full").groupBy("record_id").agg(F.max(F.struct("at", "etag", "last_modified", "payload_digest", F.array_sort(F.map_entries("headers")).alias("headers"))).alias("s"))
    source = source.select(F.col("record_id").alias("resolved_id"), "s")
    out = every.join(source, "resolved_id", "left")
    strong = lambda tag: F.regexp_replace(tag, "^W/", "")
    differs = F.lit(False)
    for own, theirs in ((strong(F.col("etag")), strong(F.col("s.etag"))), (F.col("last_modified"), F.col("s.last_modified")), (F.col("payload_digest"), F.col("s.payload_digest"))):
        differs = differs | (own.isNotNull() & ~own.eqNullSafe(theirs))
    given = F.coalesce("etag", "last_modified", "payload_digest").isNotNull()
    verdict = (
        F.when(F.col("full"), "full").when(~F.coalesce(F.col("kind") == "revisit", F.lit(False)), "other").when(F.col("s").isNull(), "orphan")
        .when(differs, "changed").when(~given, "unverified").otherwise("resolved")
    )
    fresh = F.map_filter("headers", lambda k, _: k.isin(*PERMITTED))
    stored = F.map_from_entries("s.headers")
    updated = F.map_concat(F.map_filter(stored, lambda k, _: ~F.map_contains_key(fresh, k)), fresh)
    merged = F.when(F.col("full"), F.col("headers")).when(verdict == "resolved", updated)
    return out.select(
        *[F.col("row").getField(c).alias(c) for c in records.columns if c not in RESOLVED], "canonical_url", F.when(verdict.isin("full", "resolved", "unverified"), F.col("resolved_id")).alias("resolved_id"), verdict.alias("verdict"),
        merged.alias("merged"), F.when(verdict.isin("full", "resolved", "unverified"), F.col("s.payload_digest")).alias("resolved_digest"),
    )
