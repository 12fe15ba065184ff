"""WARC archives of pages: written by Spark's own committed writer, read back with segments put together again.

Writing.  Of pages with equal payloads of some length the one with the smallest page_id is a response record, the others are
revisits that name it and carry no payload.  A payload is an HTTP body in chunks; a block longer than a segment goes on in
continuation records.  A task packs its records into archives of bounded size, and each is one value of a text
table whose line separator is the end of a record, so that the files hold nothing but WARC, any store will do, and a lost executor's
files are never seen.  Copies are found by digest alone; the payloads of all other pages are not shuffled.

Reading.  An archive is parsed record by record by its lengths.  Segments are grouped by the identifier of their origin and ordered by
number; numbers without a gap and the total length are verified before the HTTP framing is decoded.  What does not
hold is reported in ``problem``, with a null payload, and stops nothing.

Edge cases: a null html is an empty payload; blanks and control characters of an url are percent-encoded, and a null url is left out; a
null page_id is never referred to, so such pages revisit a page that has an id, and are responses otherwise; rows that repeat a page_id with
the same payload have one record identifier and are a record each, all responses if theirs is the smallest page_id; an empty
table gives an archive without records; other columns are not read.
"""

from __future__ import annotations

import gzip
import hashlib
import re
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ripplegraph.llm import textkit as T

#: Bytes of a segment's block, of a chunk of HTTP, and of an archive (and one record more) before compression.
SEGMENT_BYTES, CHUNK_BYTES, ARCHIVE_BYTES = 16 << 10, 4 << 10, 8 << 20
#: Fixed values of the format.
_VERSION, _END = b"WARC/1.1\r\n", b"\r\n\r\n"
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n"
#: What a parsed record has; ``origin``, ``number`` and ``total`` belong to segments.
RECORD = "record_id string, record_type string, page_id long, url string, digest string, refers_id string, origin string, number int, total long, data binary, problem string"
_FIELDS = [c.split()[0] for c in RECORD.split(", ")]
_TYPES = dict(zip(_FIELDS, (pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.string(), pa.int32(), pa.int64(), pa.binary(), pa.string())))


def _urn(*parts) -> str:
    return f"<urn:uuid:{uuid.UUID(hashlib.sha256(':'.join(map(str, parts)).encode()).hexdigest()[:32])}>"


def record(fields: dict[str, object], block: bytes) -> bytes:
    """A record without the mark of its end; fields that are None are left out."""
    head = "".join(f"{k}: {v}\r\n" for k, v in fields.items() if v is not None)
    return b"".join((_VERSION, head.encode(), b"Content-Length: %d" % len(block), _END, block))


def chunked(payload: bytes, size: int = CHUNK_BYTES) -> bytes:
    """The payload as an HTTP body in chunks."""
    parts = [payload[i : i + size] for i in range(0, len(payload), size)]
    return b"".join([x for p in parts for x in (b"%x\r\n" % len(p), p, b"\r\n")] + [b"0\r\n\r\n"])


def dechunked(body: bytes) -> bytes:
    """The payload of a chunked body, extensions and trailers left out; a ValueError where the framing is broken."""
    out, at = [], 0
    while True:
        end = body.find(b"\r\n", at)
        line = body[at:end].split(b";")[0].strip() if end >= 0 else b""
        if not re.fullmatch(rb"[0-9A-Fa-f]{1,15}", line):
            raise ValueError("no chunk size")
        size, at = int(line, 16), end + 2
        if not size:
            break
        if body[at + size : at + size + 2] != b"\r\n":
            raise ValueError("chunk without an end")
        out.append(body[at : at + size])
        at += size + 2
    if body[at : at + 2] != b"\r\n" and _END not in body[at:]:
        raise ValueError("trailer without an end")
    return b"".join(out)


def decoded(block: bytes) -> bytes:
    """The payload of an HTTP response."""
    head, mark, body = block.partition(_END)
    fields = dict(_field(x) for x in head.split(b"\r\n")[1:])
    if not mark or not head.startswith(b"HTTP/"):
        raise ValueError("no HTTP head")
    if "chunked" in fields.get("transfer-encoding", "").lower():
        return dechunked(body)
    if int(fields.get("content-length", len(body))) != len(body):
        raise ValueError("body of another length")
    return body


def _field(line: bytes) -> tuple[str, str]:
    name, _, value = line.decode("utf-8", "replace").partition(":")
    return name.strip().lower(), value.strip()


def page_records(page_id: int | None, url: str | None, digest: str, payload: bytes, first: int | None, date: str, segment: int) -> Iterator[bytes]:
    """The records of a page: a revisit of page ``first`` if that is given, else a response and its continuations."""
    own = _urn(page_id, digest)
    url = url and re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url)
    same = {"WARC-Record-ID": own, "WARC-Date": date, "WARC-Target-URI": url or None, "WARC-Payload-Digest": f"sha256:{digest}", "X-Page-ID": page_id, "Content-Type": "application/http;msgtype=response"}
    if first is not None:
        yield record({"WARC-Type": "revisit", **same, "WARC-Profile": _PROFILE, "WARC-Refers-To": _urn(first, digest)}, _HTTP)
        return
    block = _HTTP + chunked(payload)
    if len(block) <= segment:
        yield record({"WARC-Type": "response", **same}, block)
        return
    yield record({"WARC-Type": "response", **same, "WARC-Segment-Number": 1}, block[:segment])
    for number, at in enumerate(range(segment, len(block), segment), 2):
        total = len(block) if at + segment >= len(block) else None
        fields = {"WARC-Type": "continuation", "WARC-Record-ID": _urn(own, number), "WARC-Date": date, "WARC-Target-URI": url or None, "WARC-Segment-Origin-ID": own, "WARC-Segment-Number": number, "WARC-Segment-Total-Length": total}
        yield record(fields, block[at : at + segment])


def write_archives(pages: DataFrame, path: str, least: int = 100, date: str = "2000-01-01T00:00:00Z", segment: int = SEGMENT_BYTES, archive: int = ARCHIVE_BYTES) -> None:
    """Write a record per row of ``pages`` (page_id, url, html); payloads of at least ``least`` bytes are kept once."""
    T.session(pages.sparkSession)
    html = F.coalesce(F.col("html").cast("string"), F.lit(""))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), html.alias("html"), F.sha2(html, 256).alias("digest"))
    large = rows.where(F.octet_length("html") >= least).select("page_id", "url", "digest")
    copies = T.stash(large.groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1 and first is not null").drop("n"))
    revisits = T.stash(T.thin(large, copies, "digest").join(copies, "digest").where("page_id is null or page_id <> first"))
    responses = T.without(rows, revisits, "page_id", "digest").withColumn("first", F.lit(None).cast("long"))
    records = responses.unionByName(revisits.withColumn("html", F.lit("")))

    def run(batches: Iterator[pa.RecordBatch]):
        info = record({"WARC-Type": "warcinfo", "WARC-Record-ID": _urn("info", date), "WARC-Date": date, "Content-Type": "application/warc-fields"}, b"format: WARC file version 1.1\r\n")
        held, size = [info], len(info)
        for b in T.pieces(batches, column="html"):
            page, url, html, digest, first = (b.column(b.schema.get_field_index(c)) for c in ("page_id", "url", "html", "digest", "first"))
            for p, u, h, d, f in zip(page.to_pylist(), url.to_pylist(), html, digest.to_pylist(), first.to_pylist()):
                for x in page_records(p, u, d, h.as_buffer().to_pybytes(), f, date, segment):
                    held.append(x)
                    size += len(x) + len(_END)
                    if size >= archive:
                        yield pa.RecordBatch.from_arrays([pa.array([_END.join(held)], pa.binary())], ["data"])
                        held, size = [info], len(info)
        if len(held) > 1:
            yield pa.RecordBatch.from_arrays([pa.array([_END.join(held)], pa.binary())], ["data"])

    # a value is one archive, and each goes to a file of its own
    out = records.select("page_id", "url", "html", "digest", "first").mapInArrow(run, "data binary").select(F.col("data").cast("string").alias("value"))
    out.write.options(lineSep=_END.decode(), maxRecordsPerFile=1, compression="gzip").mode("overwrite").text(path)


def records_of(data: bytes) -> Iterator[tuple[dict[str, str], bytes, str | None]]:
    """Fields, block and problem of each record of an archive; the rest of a file is one problem once a record can't be read."""
    at = 0
    while at < len(data):
        end = data.find(_END, at)
        fields = dict(_field(x) for x in data[at:end].split(b"\r\n")[1:]) if end >= 0 else {}
        if not data.startswith(b"WARC/1.", at) or not fields.get("content-length", "").isdigit():
            yield {}, b"", "no record"
            return
        start = end + len(_END)
        at = start + int(fields["content-length"])
        short = data[at : at + len(_END)] != _END
        yield fields, data[start:at], "cut short" if short else None
        if short:
            return
        at += len(_END)


def _row(fields: dict[str, str], block: bytes, problem: str | None) -> dict:
    page, number, total = (fields.get(k, "") for k in ("x-page-id", "warc-segment-number", "warc-segment-total-length"))
    row = dict.fromkeys(_FIELDS) | {"record_id": fields.get("warc-record-id"), "record_type": fields.get("warc-type"), "url": fields.get("warc-target-uri"), "refers_id": fields.get("warc-refers-to"), "problem": problem}
    row |= {"page_id": int(page) if re.fullmatch(r"-?\d+", page) else None, "digest": fields.get("warc-payload-digest", "").removeprefix("sha256:") or None}
    if number.isdigit() and not problem:
        return row | {"origin": fields.get("warc-segment-origin-id", row["record_id"]), "number": int(number), "total": int(total) if total.isdigit() else None, "data": block}
    if row["record_type"] == "response" and not problem:
        row |= _payload(block)
    return row


def _payload(block: bytes) -> dict:
    try:
        return {"data": decoded(block)}
    except ValueError as e:
        return {"problem": str(e)}


def _batches(rows: Iterator[dict]) -> Iterator[pa.RecordBatch]:
    held, size = [], 0
    for r in rows:
        held.append(r)
        size += len(r["data"] or b"")
        if size >= T.PIECE_BYTES or len(held) >= T.BATCH_ROWS:
            yield pa.RecordBatch.from_pylist(held, pa.schema(_TYPES))
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_pylist(held, pa.schema(_TYPES))


def _parsed(spark: SparkSession, path: str, segments: bool) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]):
        def rows():
            for b in batches:
                for x in b.column(0):
                    data = x.as_buffer().to_pybytes()
                    for fields, block, problem in records_of(gzip.decompress(data) if data[:2] == b"\x1f\x8b" else data):
                        if ("warc-segment-number" in fields and not problem) == segments and fields.get("warc-type") != "warcinfo":
                            yield _row(fields, block, problem)

        yield from _batches(rows())

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(run, RECORD)


def _reassembled(parts: DataFrame) -> DataFrame:
    """One record for the segments of each origin, as often as the origin was written."""
    first = lambda c: F.max(F.when(F.col("number") == 1, F.col(c))).alias(c)
    # a record that was written several times has several copies of each segment
    once = parts.groupBy("origin", "number").agg(F.count("*").alias("copies"), F.first("data").alias("data"), F.max("total").alias("total"), *(F.max(c).alias(c) for c in ("page_id", "url", "digest")))
    whole = once.groupBy("origin").agg(F.max("copies").alias("copies"), F.min("copies").alias("least"), F.max("total").alias("total"), *map(first, ("page_id", "url", "digest")), F.sort_array(F.collect_list(F.struct("number", "data"))).alias("parts"))

    def run(batches: Iterator[pa.RecordBatch]):
        def rows():
            for b in batches:
                for r in (b.slice(i, 1).to_pylist()[0] for i in range(b.num_rows)):
                    blocks = [p["data"] for p in r["parts"]]
                    row = dict.fromkeys(_FIELDS) | {"record_id": r["origin"], "record_type": "response", **{k: r[k] for k in ("page_id", "url", "digest")}, "number": r["copies"]}
                    if [p["number"] for p in r["parts"]] != list(range(1, len(blocks) + 1)) or r["copies"] != r["least"]:
                        row["problem"] = "missing segment"
                    elif r["total"] != sum(map(len, blocks)):
                        row["problem"] = "segments of another length"
                    else:
                        row |= _payload(b"".join(blocks))
                    yield row

        yield from _batches(rows())

    return whole.mapInArrow(run, RECORD).withColumn("number", F.explode(F.sequence(F.lit(1), "number")))


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """record_id, record_type, page_id, url, digest, refers_id, payload, problem of every record in the files, segments put together."""
    T.session(spark)
    found = _parsed(spark, path, False).unionByName(_reassembled(_parsed(spark, path, True)))
    wrong = F.when(F.sha2("data", 256) != F.col("digest"), "payload of another digest")
    return found.select("record_id", "record_type", "page_id", "url", "digest", "refers_id", F.col("data").alias("payload"), F.coalesce("problem", wrong).alias("problem"))


def page_digests(records: DataFrame) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to, problem: a revisit has its numbers from the response that it names."""
    light = T.stash(records.select("record_id", "record_type", "page_id", "refers_id", F.octet_length("payload").cast("long").alias("payload_bytes"), F.sha2("payload", 256).alias("payload_digest"), "problem"))
    named = light.where("record_type = 'response'").groupBy(F.col("record_id").alias("refers_id")).agg(F.min("payload_bytes").alias("payload_bytes"), F.min("payload_digest").alias("payload_digest"), F.min("page_id").alias("refers_to"), F.min("record_id").alias("found"))
    again = light.where("record_type = 'revisit'").select("page_id", "record_type", "refers_id", "problem").join(named, "refers_id", "left")
    columns = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    again = again.select(*columns, F.coalesce("problem", F.when(F.col("found").isNull(), "refers to nothing")).alias("problem"))
    return light.where("record_type is null or record_type <> 'revisit'").withColumn("refers_to", F.lit(None).cast("long")).select(*columns, "problem").unionByName(again)


def archived_pages(pages: DataFrame, least: int = 100) -> DataFrame:
    """Write ``pages`` to archives in the shared folder, and read these back."""
    spark = pages.sparkSession
    path = f"{T.shared_dir(spark)}/warc-{uuid.uuid4().hex}"
    write_archives(pages, path, least)
    return page_digests(read_archives(spark, path))
