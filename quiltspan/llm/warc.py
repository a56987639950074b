"""WARC archives: written with revisit records, read back by verifying the chain of record boundaries."""

from __future__ import annotations

import base64
import gzip
import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType

from ..storage import rename_files
from .common import cut, new_path, table, text_batches

#: What the version lines that are read begin with; they end in one of VERSIONS.
MAGIC = "WARC/1."
VERSIONS = (b"0\r\n", b"1\r\n")
END = "\r\n\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def payload_digest(payload: bytes) -> str:
    """Bare upper-case base32 SHA-1."""
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def write_warc(pages: DataFrame, path: str, min_bytes: int = 0, per_file: int = 2000, date: str = "2000-01-01T00:00:00Z", compression: str = "gzip") -> None:
    """Write a record per row of ``pages`` (page_id, url, html) to archives of at most ``per_file`` records in ``path``.

    The payload is the html in UTF-8 (null: empty). Of the records whose payloads are equal and have ``min_bytes`` or
    more, the one with the largest page_id is the response and the others revisit it; shorter ones are responses.
    A revisit keeps the HTTP head, with the full payload's length, and drops the payload. Rows with the largest
    page_id are all responses if it repeats; a null page_id never is the largest unless all are null. Null urls
    are written as ``urn:none``; control characters in urls are percent-encoded.

    With ``compression`` gzip each record is a gzip member of its own, so that an archive can be read from any record's
    offset; with none the records stand as they are. Files are named ``*.warc.gz`` or ``*.warc``. Spark's text writer
    makes them, so that ``path`` can be in any store that Spark writes to. Payloads move between tasks only if the
    list of digests that occur more than once is too large for Spark to broadcast.
    """
    if compression not in ("gzip", "none"):
        raise ValueError(f"compression is gzip or none, not {compression}")

    base = text_batches(pages).select("page_id", F.col("page_id").cast("string").alias("id"), F.col("url").cast("string").alias("url"), F.coalesce("html", F.lit("")).alias("payload"))
    base = base.withColumns({"digest": base32_sha1(F.col("payload")), "n": F.octet_length("payload")})
    copies = cut(base.where(F.col("n") >= min_bytes).groupBy("digest").agg(F.max("page_id").alias("first"), F.count(F.lit(1)).alias("rows")).where("rows > 1 and first is not null").select("digest", "first"), "warc-copies")
    rows = base.join(copies, "digest", "left")
    revisit = F.col("first").isNotNull() & (F.col("n") >= min_bytes) & ~F.col("page_id").eqNullSafe(F.col("first"))
    url = F.coalesce(F.regexp_replace("url", r"[\x00-\x20\x7f]", "%20"), F.lit("urn:none"))
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("n").cast("string"), F.lit(END))
    head = F.concat(
        F.lit("WARC/1.1\r\nWARC-Type: "),
        F.when(revisit, F.lit("revisit")).otherwise(F.lit("response")),
        F.lit("\r\nWARC-Record-ID: <urn:page:"),
        F.coalesce("id", F.lit("")),
        F.lit(f">\r\nWARC-Date: {date}\r\nWARC-Target-URI: "),
        url,
        F.lit("\r\nWARC-Payload-Digest: sha1:"),
        F.col("digest"),
        F.when(revisit, F.concat(F.lit(f"\r\nWARC-Profile: {PROFILE}\r\nWARC-Refers-To: <urn:page:"), F.col("first").cast("string"), F.lit(">"))).otherwise(F.lit("")),
        F.lit("\r\nContent-Type: application/http; msgtype=response\r\nContent-Length: "),
    )
    block = F.concat(http, F.when(revisit, F.lit("")).otherwise(F.col("payload")))
    record = F.concat(head, F.octet_length(block).cast("string"), F.lit(END), block)
    out = rows.select(record.alias("value"))
    if compression == "gzip":
        # the writer puts the byte 0 after each row: the members' last one, which is left out
        out = text_batches(out).select(_member(F.concat("value", F.lit(END)).cast("binary")).cast("string").alias("value"))
    out.write.option("lineSep", "\x00" if compression == "gzip" else END).option("maxRecordsPerFile", per_file).text(path)
    ending = "warc.gz" if compression == "gzip" else "warc"
    rename_files(pages.sparkSession, path, ".txt", lambda k, n: f"part-{k:05d}.{ending}")


@F.arrow_udf(BinaryType())
def _member(records: pa.Array) -> pa.Array:
    """Each record as a gzip member less its last byte, which is 0: it is the highest one of the size, and a record of
    16 MB or more is followed by a member of size 0."""
    out = []
    for r in records:
        raw = gzip.compress(r.as_py(), mtime=0)
        out.append((raw if raw[-1] == 0 else raw + gzip.compress(b"", mtime=0))[:-1])
    return pa.array(out, pa.binary())


def base32_sha1(payload: Column) -> Column:
    """The bare upper-case base32 SHA-1 of a text's bytes: 20 bits at a time, from base 16 to base 32."""
    digest = F.sha1(payload)
    parts = [F.lpad(F.conv(F.substring(digest, 1 + 5 * k, 5), 16, 32), 4, "0") for k in range(8)]
    return F.translate(F.concat(*parts), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


_FIELDS = {
    "record_type": re.compile(rb"(?i)(?:\A|\r\n)WARC-Type:[ \t]*([^\r\n]*)"),
    "record_id": re.compile(rb"(?i)(?:\A|\r\n)WARC-Record-ID:[ \t]*<([^\r\n]*)>"),
    "url": re.compile(rb"(?i)(?:\A|\r\n)WARC-Target-URI:[ \t]*([^\r\n]*)"),
    "refers_to": re.compile(rb"(?i)(?:\A|\r\n)WARC-Refers-To:[ \t]*<([^\r\n]*)>"),
    "content_type": re.compile(rb"(?i)(?:\A|\r\n)Content-Type:[ \t]*([^\r\n]*)"),
    "header_digest": re.compile(rb"(?i)(?:\A|\r\n)WARC-Payload-Digest:[ \t]*sha1:([^\r\n]*)"),
}
_LENGTH = re.compile(rb"(?i)(?:\A|\r\n)Content-Length:[ \t]*([0-9]{1,15})(?:\r\n|\Z)")


def _payload(block: bytes, kind: str | None, content: str | None) -> tuple[bytes, int]:
    """The payload of a record's block and its length: of an HTTP message what follows its head, of other blocks all.
    A revisit has lost its payload; its length is the one that its HTTP head states."""
    if not (content or "").lower().startswith("application/http"):
        return block, len(block)
    at = block.find(b"\r\n\r\n")
    payload = block[at + 4 :] if at >= 0 else block
    stated = _LENGTH.search(block[:at]) if at >= 0 and kind == "revisit" else None
    return payload, int(stated[1]) if stated else len(payload)


def _scan(keep_payload: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here, offset, claimed = None, 0, 0
        for batch in batches:
            out: dict[str, list] = {k: [] for k in ("bytes", "header_bytes", "content_length", "whole", *_FIELDS, "payload_bytes", "payload_digest", "payload", "piece")}
            for value, file, block in zip(*(batch.column(c) for c in ("value", "file", "block")), strict=True):
                raw = value.as_py()
                if here != (file.as_py(), block.as_py()):
                    here, offset, claimed = (file.as_py(), block.as_py()), -len(MAGIC), 0
                at = raw.find(b"\r\n\r\n") if raw.startswith(VERSIONS) else -1
                head = raw[3:at] if at >= 0 else b""
                length = _LENGTH.search(head)
                n = int(length[1]) if length else None
                whole = n is not None and len(raw) == at + 4 + n + 4 and raw.endswith(b"\r\n\r\n")
                out["bytes"].append(len(raw))
                out["header_bytes"].append(at + 4 if length else None)
                out["content_length"].append(n)
                out["whole"].append(whole)
                for k, pattern in _FIELDS.items():
                    m = pattern.search(head)
                    out[k].append(m[1].decode("utf-8", "replace") if m else None)
                payload, size = _payload(raw[at + 4 : -4], out["record_type"][-1], out["content_type"][-1]) if whole else (None, None)
                out["payload_bytes"].append(size)
                out["payload_digest"].append(None if payload is None else payload_digest(payload))
                out["payload"].append(payload if keep_payload else None)
                # a part of a payload that an earlier record here, or one before this split, may claim
                part = not whole or offset < claimed or here[1] > 0
                out["piece"].append(raw if part else None)
                if n is not None and not whole:
                    claimed = max(claimed, offset + len(MAGIC) + at + 4 + n + len(END))
                offset += len(MAGIC) + len(raw)
            kinds = {"bytes": pa.int64(), "header_bytes": pa.int64(), "content_length": pa.int64(), "whole": pa.bool_(), "payload_bytes": pa.int64(), "payload": pa.binary(), "piece": pa.binary()}
            names = ["file", "block", "row"]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), *(pa.array(v, kinds.get(k, pa.string())) for k, v in out.items())], names=[*names, *out])

    return run


_SMALL = "file string, block long, row long, bytes long, header_bytes long, content_length long, whole boolean, record_type string, record_id string, url string, refers_to string, content_type string, header_digest string, payload_bytes long, payload_digest string"


def _chain(rows: pd.DataFrame) -> pd.DataFrame:
    """Offsets of a file's candidates, and which of them the chain from the file's start reaches, by pointer jumping."""
    rows = rows.sort_values(["block", "row"], kind="stable").reset_index(drop=True)
    size = rows["bytes"].to_numpy(np.int64)
    # row k is what follows the k-th magic; row 0 is what precedes the first
    offset = np.concatenate([[-len(MAGIC)], np.cumsum(size + len(MAGIC))[:-1] - len(MAGIC)]) if len(rows) else np.zeros(0, np.int64)
    n = len(rows)
    good = rows["content_length"].notna().to_numpy() & (offset >= 0)
    ends = offset + len(MAGIC) + rows["header_bytes"].fillna(0).to_numpy(np.int64) + rows["content_length"].fillna(0).to_numpy(np.int64) + len(END)
    successor = np.searchsorted(offset, ends)
    hit = good & (successor < n)
    hit[hit] = offset[successor[hit]] == ends[hit]
    jump = np.where(hit, successor, n)
    jump = np.append(jump, n)
    reached = np.zeros(n + 1, bool)
    if n > 1 and offset[1] == 0:
        reached[1] = True
    steps = 1
    while steps < 2 * (n + 1):
        reached[jump[reached]] = True
        jump = jump[jump]
        steps *= 2
    rows["offset"] = offset
    rows["reached"] = reached[:n] & good
    # every row belongs to the last reached candidate at or before it
    at = np.maximum.accumulate(np.where(rows["reached"], np.arange(n), -1)) if n else np.zeros(0, np.int64)
    rows["record_offset"] = np.where(at >= 0, offset[np.maximum(at, 0)], -1) if n else at
    return rows


def read_warc(spark: SparkSession, path: str, keep_payload: bool = True) -> DataFrame:
    """The records of the archives in ``path``: file, offset, record_type, record_id (without its brackets), url,
    refers_to, content_type, header_digest (if SHA-1), payload_bytes (of a revisit: as its HTTP head states it, the
    full one), payload_digest (of a revisit: as its header states it), payload (binary).

    Archives are of version 1.0 or 1.1, plain or gzipped, with a gzip member for each record or one for all, and have
    records of any type and id. The payload of an HTTP message is what follows its head, that of other blocks all.

    Each occurrence of the version line is a candidate record; tasks parse it where they meet it and emit its place and
    its successor's. Per archive (whose candidates are a few numbers and header lines each: some 10^5 in a gigabyte) pointer
    jumping from the file's start keeps the candidates that the chain reaches, so that a magic line inside a payload
    opens no record. A payload without magic lines is digested where it is read; only one that a magic line splits is
    gathered from its parts. Compressed archives are read one per task, plain ones in splits.
    """
    lines = spark.read.option("lineSep", MAGIC).text(path).select(F.col("value").cast("binary").alias("value"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("row"))
    # the rows' numbers hold in this one pass only, so that it is written before anything else uses them
    seen = cut(text_batches(lines).mapInArrow(_scan(keep_payload), _SMALL + ", payload binary, piece binary"), "warc-candidates")
    small = seen.drop("payload", "piece")
    chained = cut(small.groupBy("file").applyInPandas(_chain, _SMALL + ", offset long, reached boolean, record_offset long"), "warc-chain")
    keys = ["file", "block", "row"]
    fields = ["file", "offset", "record_type", "record_id", "url", "refers_to", "content_type", "header_digest", "payload_bytes", "payload_digest"]
    whole = chained.where("reached and whole")
    whole = whole.join(seen.select(*keys, "payload"), keys).select(*fields, "payload") if keep_payload else whole.select(*fields, F.lit(None).cast("binary").alias("payload"))
    split = chained.where("reached and not whole")
    odd = split.select("file", F.col("offset").alias("record_offset"))
    parts = chained.join(odd, ["file", "record_offset"], "left_semi").join(seen.select(*keys, "piece"), keys).select("file", "record_offset", "offset", "piece")

    @F.arrow_udf("payload_bytes long, payload_digest string, payload binary")
    def joined(pieces: pa.Array, header: pa.Array, length: pa.Array, kind: pa.Array, content: pa.Array) -> pa.Array:
        out = []
        for p, h, n, k, c in zip(pieces, header, length, kind, content, strict=True):
            block = MAGIC.encode().join(p.as_py())[h.as_py() :][: n.as_py()]
            payload, size = _payload(block, k.as_py(), c.as_py())
            out.append({"payload_bytes": size, "payload_digest": payload_digest(payload), "payload": payload if keep_payload else None})
        return pa.array(out, pa.struct([("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("payload", pa.binary())]))

    gathered = parts.groupBy("file", "record_offset").agg(F.transform(F.array_sort(F.collect_list(F.struct("offset", "piece"))), lambda x: x["piece"]).alias("pieces"))
    heads = split.select("file", F.col("offset").alias("record_offset"), "offset", "record_type", "record_id", "url", "refers_to", "content_type", "header_digest", "header_bytes", "content_length")
    rebuilt = heads.join(gathered, ["file", "record_offset"]).withColumn("b", joined("pieces", "header_bytes", "content_length", "record_type", "content_type"))
    rebuilt = rebuilt.select("file", "offset", "record_type", "record_id", "url", "refers_to", "content_type", "header_digest", "b.payload_bytes", "b.payload_digest", "b.payload")
    out = whole.union(rebuilt)
    return out.withColumn("payload_digest", F.when(F.col("record_type") == "revisit", F.col("header_digest")).otherwise(F.col("payload_digest")))


def op4_warc(spark, sf_dir):
    pages = table(spark, sf_dir, "pages")
    path = new_path(spark, "warc")
    write_warc(pages, path)
    kind = pages.schema["page_id"].dataType
    back = read_warc(spark, path, keep_payload=False)

    def page(c: str) -> Column:
        return F.nullif(F.regexp_replace(c, "^urn:page:", ""), F.lit("")).cast(kind).alias(c)

    ids = back.withColumns({c: page(c) for c in ("record_id", "refers_to")})
    return ids.select(F.col("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", "refers_to")
