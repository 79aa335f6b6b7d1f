"""Content-addressed archive of WARC records.

Payload bytes are stored once under their SHA-256; the exact bytes before each payload (the
WARC header and, for responses, the HTTP header) are kept apart, one row a record, with the
digest. Joining the two on the digest gives back every record byte for byte. Digests are
verified: all rows of one digest must agree in length and in a second, independent hash,
stored payloads are hashed again when records are rebuilt, and a record whose own header
names another SHA-256 than its payload has is marked.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import forget, fresh, name, small, written

CRLF = "\r\n"
END = CRLF * 2
MAGIC = b"\x1f\x8b\x08"
#: So many bytes are unzipped, or looked through, at a time.
PIECE = 1 << 20
#: Payloads that more records than this share are spread over several tasks when rebuilding.
HOT = 10_000


def records_of_pages(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """A response record per page: page_id, url, header (string) and payload (string).

    A null html makes a record without a block: a null payload and Content-Length 0. A null
    url leaves out WARC-Target-URI; a null page_id counts as "" in the record id.
    """
    h = F.md5(F.concat(F.lit("page:"), F.coalesce(name(page_id).cast("string"), F.lit(""))))
    uuid = F.concat_ws("-", *[F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))])
    uri = F.coalesce(F.concat(F.lit("WARC-Target-URI: "), name(url), F.lit(CRLF)), F.lit(""))
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}Content-Length: "), F.coalesce(F.octet_length(name(html)), F.lit(0)).cast("string"), F.lit(END))
    digest = F.coalesce(F.concat(F.lit("WARC-Payload-Digest: sha256:"), F.sha2(name(html).cast("binary"), 256), F.lit(CRLF)), F.lit(""))
    length = (F.octet_length(http) + F.coalesce(F.octet_length(name(html)), F.lit(0))).cast("string")
    head = F.concat(F.lit(f"WARC/1.0{CRLF}WARC-Type: response{CRLF}WARC-Record-ID: <urn:uuid:"), uuid, F.lit(f">{CRLF}"), uri, digest, F.lit(f"Content-Type: application/http; msgtype=response{CRLF}Content-Length: "), length, F.lit(END), http)
    return pages.select(name(page_id).alias("page_id"), name(url).alias("url"), head.alias("header"), name(html).alias("payload"))


def _declared(header: Column) -> Column:
    found = F.lower(F.regexp_extract(header.cast("string"), r"(?i)WARC-Payload-Digest:[ \t]*sha-?256:([0-9a-fA-F]{64})", 1))
    return F.nullif(found, F.lit(""))


def archive(records: DataFrame, header: str = "header", payload: str = "payload") -> tuple[DataFrame, DataFrame]:
    """(headers, payloads) of records.

    headers: all columns but the payload, with ``payload_digest`` (hex SHA-256, null for a
    null payload) and ``digest_ok`` (false if the header declares another SHA-256; null if
    it declares none). payloads: payload_digest, payload, n_records, each digest once; rows
    of a digest that differ in length or in a second hash raise an error. Repeated records
    are all kept as headers; an empty payload is a payload of its own. A column that has
    one of these names already keeps it, and the new one gets a leading underscore.
    """
    rest = [c for c in records.columns if c != payload]
    digest, ok = fresh(rest, "payload_digest", "digest_ok")
    sha = F.sha2(name(payload).cast("binary"), 256)
    headers = records.select(*map(name, rest), sha.alias(digest)).withColumn(ok, _declared(name(header)) == name(digest))
    body = records.filter(name(payload).isNotNull()).select(sha.alias("payload_digest"), name(payload).alias("payload"))
    body = body.withColumn("len", F.octet_length("payload")).withColumn("second", F.xxhash64("payload"))
    once = body.groupBy("payload_digest").agg(F.first("payload").alias("payload"), F.count("*").alias("n_records"), *[f(c).alias(f"{c}_{n}") for c in ("len", "second") for f, n in ((F.min, "lo"), (F.max, "hi"))])
    same = (F.col("len_lo") == F.col("len_hi")) & (F.col("second_lo") == F.col("second_hi"))
    one = F.when(same, F.col("payload")).otherwise(F.raise_error(F.concat(F.lit("two payloads have the SHA-256 "), F.col("payload_digest"))).cast(records.schema[payload].dataType))
    return headers, once.select("payload_digest", one.alias("payload"), "n_records")


def rebuild(headers: DataFrame, payloads: DataFrame, header: str = "header", payload: str = "payload", digest: str = "payload_digest", hot: int = HOT) -> DataFrame:
    """The records again: the columns of ``headers`` with the payload.

    A stored payload that no longer has its digest raises an error, and so does a missing
    one. Records of a payload that more than ``hot`` records share are spread by a hash of
    their header; the payload is repeated for each share of them. Where no payload is that
    hot, all records are joined in the one way.
    """
    p, d, n, salt, shares = fresh(headers, payload, "stored_digest", "stored_n", "salt", "shares")
    stored = payloads.select(F.col("payload_digest").alias(d), F.col("payload").alias(p), F.col("n_records").alias(n))
    good = F.sha2(F.col(p).cast("binary"), 256) == F.col(d)
    stored = stored.withColumn(p, F.when(good, F.col(p)).otherwise(F.raise_error(F.concat(F.lit("bad payload "), F.col(d))).cast(stored.schema[p].dataType)))
    per = headers.filter(name(digest).isNotNull()).groupBy(name(digest).alias(d)).count().filter(F.col("count") > hot)
    heat = written(per.select(d, F.ceil(F.col("count") / hot).cast("int").alias(shares)), "warc-heat")
    n_hot = heat.count()
    kind = payloads.schema["payload"].dataType
    lost = F.when(F.col(d).isNull(), F.raise_error(F.concat(F.lit("no payload "), name(digest))).cast(kind)).otherwise(F.col(p))
    out = [*map(name, headers.columns)]
    bare = headers.filter(name(digest).isNull()).select(*out, F.lit(None).cast(kind).alias(p))
    if not n_hot:
        forget(heat)
        return headers.filter(name(digest).isNotNull()).join(stored, name(digest) == F.col(d), "left").select(*out, lost.alias(p)).unionByName(bare)
    marked = headers.filter(name(digest).isNotNull()).join(small(heat, n_hot), name(digest) == F.col(d), "left").drop(d)
    cold = marked.filter(F.col(shares).isNull()).join(stored, name(digest) == F.col(d), "left").select(*out, lost.alias(p))
    spread = stored.filter(F.col(n) > hot).withColumn(salt, F.explode(F.sequence(F.lit(0), F.ceil(F.col(n) / hot).cast("int") - 1)))
    key = F.pmod(F.xxhash64(*[name(c) for c in headers.columns]), F.col(shares).cast("long")).cast("int")
    warm = marked.filter(F.col(shares).isNotNull()).withColumn(salt, key)
    left, right = warm.alias("h"), spread.withColumnRenamed(salt, salt + "_p")
    warm = left.join(right, (name(digest) == F.col(d)) & (F.col(salt) == F.col(salt + "_p")), "left").select(*out, lost.alias(p))
    return cold.unionByName(warm).unionByName(bare)


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """Records of .warc and .warc.gz files: file, offset, header and payload (binary), error.

    ``header`` is all before the payload: the WARC header and, for HTTP records, the HTTP
    header; with the payload and the final CRLF CRLF it is the exact record. ``offset`` counts
    unzipped bytes. A file is read by one task, gzip member by member and record by record.
    Damage costs no more than it covers: a row with an ``error`` and neither header nor
    payload stands for a gzip member that can't be unzipped to its end, for bytes that are
    no record and for a last record that is cut; reading goes on behind them. An empty file
    has no records.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "content")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for p, content in zip(batch.column(0).to_pylist(), batch.column(1)):
                for at, head, body, error in read_records(content.as_py()):
                    yield pa.RecordBatch.from_arrays([pa.array([p]), pa.array([at], pa.int64()), pa.array([head], pa.binary()), pa.array([body], pa.binary()), pa.array([error], pa.string())], names=["file", "offset", "header", "payload", "error"])

    return files.mapInArrow(run, "file string, offset long, header binary, payload binary, error string")


def _unzipped(content: bytes) -> Iterator[tuple[bytes, str | None]]:
    """Pieces of a file, unzipped if it is gzip; after a damaged member an error, then what follows its end or the next member."""
    if content[:2] != MAGIC[:2]:
        yield content, None
        return
    at = 0
    while 0 <= at < len(content):
        inflate, error = zlib.decompressobj(31), None
        try:
            for i in range(at, len(content), PIECE):
                piece = inflate.decompress(content[i : i + PIECE])
                if piece:
                    yield piece, None
                if inflate.eof:
                    break
        except zlib.error as e:
            error = f"a damaged gzip member: {e}"
        if inflate.eof and error is None:
            at = i + min(PIECE, len(content) - i) - len(inflate.unused_data)
            if content[at : at + 3] != MAGIC and at < len(content):
                following = content.find(MAGIC, at)
                if content[at : following if following >= 0 else None].strip(b"\0"):
                    yield b"", "bytes between gzip members"
                at = following
            continue
        yield b"", error or "a gzip member ends early"
        at = content.find(MAGIC, at + 3)


def read_records(content: bytes) -> Iterator[tuple[int, bytes | None, bytes | None, str | None]]:
    """(offset, bytes before the payload, payload, error) of each record of a file's bytes; see ``read_warc``."""
    held, base = b"", 0
    for piece, error in _unzipped(content):
        held += piece
        if error is None and len(held) < PIECE:
            continue
        used = yield from _records_in(held, base, error is not None)
        held, base = held[used:], base + used
        if error is not None:
            yield base, None, None, error
    yield from _records_in(held, base, True)


def _records_in(held: bytes, base: int, last: bool) -> Iterator[tuple[int, bytes | None, bytes | None, str | None]]:
    """Records at the start of some bytes; returns how many bytes are done with. Unless they are the last, a record that isn't whole is left."""
    at = 0
    while at < len(held):
        if held[at] in b"\r\n":
            at += 1
            continue
        begun = held.startswith(b"WARC/", at)
        start = held.find(b"\r\n\r\n", at) if begun else -1
        length = start >= 0 and re.search(rb"(?im)^content-length:[ \t]*(\d+)", held[at:start])
        stop = start + 4 + int(length[1]) if length else -1
        if length and stop <= len(held):
            kind = re.search(rb"(?im)^content-type:[ \t]*application/http", held[at:start])
            http = held.find(b"\r\n\r\n", start + 4, stop) if kind else -1
            cut = http + 4 if http >= 0 else start + 4
            yield base + at, held[at:cut], held[cut:stop], None
            at = stop
            continue
        following = held.find(b"\nWARC/", at + 1)
        if not last and (length or start < 0 and (begun or following < 0)):
            break
        yield base + at, None, None, "the record is cut" if length else "no record"
        at = following + 1 if following >= 0 else len(held)
    return at


def split_records(content: bytes) -> Iterator[tuple[int, bytes, bytes]]:
    """(offset, bytes before the payload, payload) of the sound records of a file's bytes."""
    return (r[:3] for r in read_records(content) if r[3] is None)


def append(headers: DataFrame, payloads: DataFrame, new_headers: DataFrame, new_payloads: DataFrame) -> tuple[DataFrame, DataFrame]:
    """An archive with another one added: payloads whose digest it has already aren't stored again.

    Only the lengths and hashes of new payloads meet the stored ones; n_records is added up.
    """
    known = payloads.select("payload_digest", "n_records")
    added = new_payloads.join(known.select("payload_digest"), "payload_digest", "left_anti")
    more = new_payloads.select("payload_digest", F.col("n_records").alias("more"))
    grown = payloads.join(more, "payload_digest", "left").select("payload_digest", "payload", (F.col("n_records") + F.coalesce("more", F.lit(0))).alias("n_records"))
    return headers.unionByName(new_headers), grown.unionByName(added)


def write_warc(records: DataFrame, path: str, header: str = "header", payload: str = "payload") -> None:
    """Write the records of each partition to a gzip file under ``path``.

    Spark's own committer places the files, so a lost task leaves no half file. A null
    payload is written like an empty one, and so is a null header: such a record can't be
    read again. A file is one gzip stream.
    """
    whole = F.concat(F.coalesce(name(header).cast("binary"), F.lit(b"")), F.coalesce(name(payload).cast("binary"), F.lit(b"")))
    records.select(whole.cast("string").alias("value")).write.option("lineSep", END).option("compression", "gzip").text(path)


def sha256(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()


def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    headers, payloads = archive(records_of_pages(spark.read.parquet(f"{sf_dir}/pages.parquet")))
    whole = F.concat("header", F.coalesce("payload", F.lit("")), F.lit(END))
    return rebuild(headers, payloads).select("page_id", "url", "payload_digest", "digest_ok", F.octet_length(whole).cast("long").alias("n_bytes"), whole.alias("record"))


def op1_sql() -> str:
    n = "chr(13) || chr(10)"
    return f"""
WITH p AS (
  SELECT page_id, url, html, sha256(html) AS payload_digest, md5('page:' || coalesce(page_id::VARCHAR, '')) AS h,
         'HTTP/1.1 200 OK' || {n} || 'Content-Type: text/html; charset=utf-8' || {n} || 'Content-Length: ' || coalesce(strlen(html), 0)::VARCHAR || {n} || {n} AS http
  FROM pages),
r AS (
  SELECT page_id, url, payload_digest, CASE WHEN html IS NOT NULL THEN true END AS digest_ok,
    'WARC/1.0' || {n} || 'WARC-Type: response' || {n} || 'WARC-Record-ID: <urn:uuid:'
    || substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-' || substr(h, 13, 4) || '-' || substr(h, 17, 4) || '-' || substr(h, 21, 12) || '>' || {n}
    || coalesce('WARC-Target-URI: ' || url || {n}, '') || coalesce('WARC-Payload-Digest: sha256:' || payload_digest || {n}, '')
    || 'Content-Type: application/http; msgtype=response' || {n} || 'Content-Length: ' || (strlen(http) + coalesce(strlen(html), 0))::VARCHAR || {n} || {n}
    || http || coalesce(html, '') || {n} || {n} AS record
  FROM p)
SELECT page_id, url, payload_digest, digest_ok, strlen(record)::BIGINT AS n_bytes, record FROM r"""
