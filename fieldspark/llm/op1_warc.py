"""Operator 1: WARC archives with a salvage reader.

Archives are written by Spark tasks, a gzip member per record, to a folder that all executors share;
only archives that a finished task has reported are read. The reader checks each record (version
line, headers, lengths, digests); where a check fails it searches for the next gzip member or version
line that gives a valid record, goes on from there, and logs the bytes between as a gap. Inside a member of
several records it does the same, and keeps those before a damage of the member.
"""

from __future__ import annotations

import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldspark.llm.common import ship, slices, table, text_of
from fieldspark.session import cut_lineage, ensure_checkpoint_dir

LEAST_REVISIT = 100  # payloads of fewer bytes are always stored
ARCHIVE_BYTES = 64 << 20  # a task begins a new archive beyond this size
CHUNK = 1 << 20
STEP = 4096  # bytes inflated at a time where a chunk does not inflate
DATE = "1970-01-01T00:00:00Z"  # a capture date, as pages have none
# fixed values: names of the archive format
HEADER = 4 << 10  # first bytes read where a record may begin
VERSION, MAGIC = b"WARC/1.", b"\x1f\x8b\x08"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

RECORDS = "archive string, kind string, start long, end long, reason string, record_type string, record_id string, refers_to string, uri string, payload_bytes long, payload_digest string, payload binary"


class Bad(Exception):
    """A record that fails a check."""


def record(kind: str, record_id: str, uri: str, payload: bytes, digest: str, refers_to: str | None) -> bytes:
    """One record: an HTTP response with its payload, or for a revisit its headers alone."""
    block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block += payload if kind == "response" else b""
    head = [("WARC-Type", kind), ("WARC-Record-ID", record_id), ("WARC-Date", DATE), ("WARC-Target-URI", uri)]
    if refers_to is not None:
        head += [("WARC-Refers-To", refers_to), ("WARC-Profile", PROFILE)]
    head += [("WARC-Payload-Digest", f"sha256:{digest}"), ("WARC-Block-Digest", f"sha256:{hashlib.sha256(block).hexdigest()}")]
    head += [("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(block)))]
    lines = "".join(f"{k}: {_CONTROL.sub(lambda m: f'%{ord(m[0]):02X}', v)}\r\n" for k, v in head)
    return b"WARC/1.1\r\n" + lines.encode() + b"\r\n" + block + b"\r\n\r\n"


_CONTROL = re.compile(r"[\x00-\x1f\x7f]")


def member(raw: bytes) -> bytes:
    z = zlib.compressobj(6, zlib.DEFLATED, 31)
    return z.compress(raw) + z.flush()


def _headers(raw: bytes, at: int = 0, end: int | None = None) -> dict[str, str]:
    """The header lines from ``at`` to ``end``, read one by one: the first that is none ends the search."""
    out, end = {}, len(raw) if end is None else end
    while at < end:
        stop = raw.find(b"\r\n", at, end)
        stop = end if stop < 0 else stop
        name, colon, value = raw[at:stop].partition(b":")
        if not colon:
            raise Bad("header line without a colon")
        out[name.strip().lower().decode("latin-1")] = value.strip().decode("utf-8", "replace")
        at = stop + 2
    return out


def parse(raw: bytes, at: int = 0, close: int | None = None) -> tuple[dict, int]:
    """The record at ``at`` and where it ends; raises ``Bad``. ``close`` is where the next empty line after
    ``at`` begins, if that is known."""
    if raw[at : at + len(VERSION)] != VERSION:
        raise Bad("no version line")
    first = raw.find(b"\r\n", at, at + 64)
    if first < 0:
        raise Bad("header without an end")
    close = raw.find(b"\r\n\r\n", at) if close is None else close
    if close < first:
        raise Bad("header without an end")
    head = _headers(raw, first + 2, close)
    if not head.get("content-length", "").isdigit() or "warc-type" not in head:
        raise Bad("no length or type")
    start = close + 4
    end = start + int(head["content-length"])
    if raw[end : end + 4] != b"\r\n\r\n":
        raise Bad("wrong length")
    block = raw[start:end]
    digest = head.get("warc-block-digest", "")
    if digest.startswith("sha256:") and digest[7:] != hashlib.sha256(block).hexdigest():
        raise Bad("block digest differs")
    payload, size = block, len(block)
    if head.get("content-type", "").startswith("application/http"):
        cut = block.find(b"\r\n\r\n")
        if cut < 0:
            raise Bad("message without an end of headers")
        http = _headers(block[:cut].partition(b"\r\n")[2]) if b"\r\n" in block[:cut] else {}
        payload = block[cut + 4 :]
        size = int(http["content-length"]) if head["warc-type"] == "revisit" and http.get("content-length", "").isdigit() else len(payload)
    digest = head.get("warc-payload-digest", "")
    if head["warc-type"] == "response" and digest.startswith("sha256:") and digest[7:] != hashlib.sha256(payload).hexdigest():
        raise Bad("payload digest differs")
    return {"head": head, "payload": payload, "payload_bytes": size, "payload_digest": digest.partition(":")[2]}, end + 4


def _sound(z, chunk: bytes) -> bytes:
    """What ``chunk``, which does not inflate as a whole, gives before its damage."""
    out, step = [], STEP
    while step:
        at, keep = 0, z.copy()
        try:
            for at in range(0, len(chunk), step):
                keep = z.copy() if step > 1 else None
                out.append(z.decompress(chunk[at : at + step]))
        except zlib.error:
            z, chunk = keep, chunk[at : at + step]
        step = 1 if step > 1 else 0
    return b"".join(out)


def _inside(raw: bytes) -> list[dict | str]:
    """The records in the bytes of a member, and why what lies between them is none."""
    out, p, close = [], 0, -1

    def at(p: int) -> tuple[dict, int]:
        nonlocal close
        if close < p:  # one search for all starts before the next empty line
            close = raw.find(b"\r\n\r\n", p)
            close = len(raw) if close < 0 else close
        return parse(raw, p, close if close < len(raw) else -1)

    while 0 <= p < len(raw):
        try:
            r, p = at(p)
            out.append(r)
        except Bad as e:
            out.append(str(e))
            while (p := raw.find(VERSION, p + 1)) >= 0:
                try:
                    at(p)
                    break
                except Bad:
                    continue
    return out


def _records_at(file, at: int, size: int) -> tuple[list[dict | str], int | None]:
    """The records of the member (or the plain record) at ``at`` with the reasons of gaps between them,
    and where it ends, None for a member that is damaged after its first records."""
    file.seek(at)
    chunk = file.read(min(HEADER, size - at))
    if chunk[:3] == MAGIC:
        z, out, pos, damage = zlib.decompressobj(31), [], at, None
        while not z.eof and damage is None:
            if not chunk:
                damage = "member breaks off"
                break
            before = z.copy()
            try:
                out.append(z.decompress(chunk))
            except zlib.error:
                damage = "member does not inflate"
                out.append(_sound(before, chunk))
            pos += len(chunk)
            chunk = b"" if z.eof else file.read(min(CHUNK, size - pos))
        found = _inside(b"".join(out))
        if not any(isinstance(r, dict) for r in found):
            raise Bad(damage or (found[0] if found else "member without a record"))
        if damage is None:
            return found, pos - len(z.unused_data)
        return (found if isinstance(found[-1], dict) else found[:-1]) + [damage], None
    if chunk[: len(VERSION)] != VERSION:
        raise Bad("neither member nor version line")
    seen = chunk.find(b"\r\n", 0, 64) + 2  # header lines up to here have a colon
    while (close := chunk.find(b"\r\n\r\n", max(seen - 4, 0))) < 0 and seen > 1:
        last = chunk.rfind(b"\r\n", seen)
        if last >= 0:
            _headers(chunk, seen, last)
            seen = last + 2
        if not (more := file.read(min(len(chunk), size - at - len(chunk)))):
            break
        chunk += more
    m = re.search(rb"(?i)\r\ncontent-length:\s*(\d+)", chunk[: max(close, 0)])
    need = close + 8 + int(m[1]) if m else 0
    if need > size - at:
        raise Bad("wrong length")
    if need > len(chunk):
        chunk += file.read(need - len(chunk))
    r, end = parse(chunk)
    return [r], at + end


def _starts(file, at: int, size: int) -> Iterator[int]:
    """Where members or version lines may begin, from ``at`` on."""
    keep = b""
    while at < size:
        file.seek(at)
        chunk = file.read(min(CHUNK, size - at))
        both, base = keep + chunk, at - len(keep)
        for m in re.finditer(rb"\x1f\x8b\x08|WARC/1\.", both):
            if m.end() > len(keep):
                yield base + m.start()
        keep = both[-(len(VERSION) - 1) :]
        at += len(chunk)


def salvage(file, size: int) -> Iterator[tuple[str, int, int, object]]:
    """("record", start, end, record) and ("gap", start, end, reason) in the order of the bytes; together
    they cover the file. Records and gaps of one member have its place. An empty file gives nothing."""
    at = 0
    while at < size:
        try:
            found, end = _records_at(file, at, size)
        except Bad as e:
            found, end = [str(e)], None
        if end is None:
            end = size
            for start in _starts(file, at + 1, size):
                try:
                    _records_at(file, start, size)
                except Bad:
                    continue
                end = start
                break
        for r in found:
            yield "gap" if isinstance(r, str) else "record", at, end, r
        at = end


def write_archives(records: DataFrame, folder: str) -> DataFrame:
    """Archives from rows (record_id, uri, payload, digest, refers_to); returns archive, records, bytes of
    each finished one. A task that is run again writes archives of other names, which are the ones
    reported then."""

    def run(batches):
        store, path = fs.FileSystem.from_uri(folder)
        store.create_dir(path, recursive=True)
        out, written, n, name = None, 0, 0, ""
        done: list[tuple[str, int, int]] = []
        for b in slices(batches, "payload"):
            for row in b.to_pylist():
                if out is None:
                    name = f"part-{TaskContext.get().partitionId():05d}-{uuid.uuid4().hex}.warc.gz"
                    out, written, n = store.open_output_stream(f"{path}/{name}", compression=None), 0, 0
                kind = "response" if row["refers_to"] is None else "revisit"
                raw = member(record(kind, row["record_id"], row["uri"] or "", row["payload"].encode("utf-8", "surrogatepass"), row["digest"], row["refers_to"]))
                out.write(raw)
                written, n = written + len(raw), n + 1
                if written >= ARCHIVE_BYTES:
                    out.close()
                    done.append((name, n, written))
                    out = None
        if out is not None:
            out.close()
            done.append((name, n, written))
        yield pa.RecordBatch.from_arrays([pa.array([f"{folder}/{d[0]}" for d in done], pa.string()), pa.array([d[1] for d in done], pa.int64()), pa.array([d[2] for d in done], pa.int64())], names=["archive", "records", "bytes"])

    ship(records.sparkSession)
    return cut_lineage(records.select("record_id", "uri", "payload", "digest", "refers_to").mapInArrow(run, "archive string, records long, bytes long"))


def read_archives(archives: DataFrame, payloads: bool = True) -> DataFrame:
    """Records and gaps (``kind``) of the files named in column ``archive``, a task for each file; see
    ``RECORDS`` for the columns. Files are read in chunks, a record at a time."""

    def run(batches):
        names = [f.split()[0] for f in RECORDS.split(", ")]
        types = {"string": pa.string(), "long": pa.int64(), "binary": pa.binary()}
        schema = pa.schema([(f.split()[0], types[f.split()[1]]) for f in RECORDS.split(", ")])
        for b in batches:
            for uri in b.column(0).to_pylist():
                store, path = fs.FileSystem.from_uri(uri)
                rows, held = [], 0
                with store.open_input_file(path) as file:
                    for kind, start, end, what in salvage(file, file.size()):
                        row = dict.fromkeys(names) | {"archive": uri, "kind": kind, "start": start, "end": end}
                        if kind == "gap":
                            row["reason"] = what
                        else:
                            h = what["head"]
                            row |= {"record_type": h["warc-type"], "record_id": h.get("warc-record-id"), "refers_to": h.get("warc-refers-to"), "uri": h.get("warc-target-uri"), "payload_bytes": what["payload_bytes"], "payload_digest": what["payload_digest"], "payload": what["payload"] if payloads else None}
                        rows.append(row)
                        held += len(row["payload"] or b"")
                        if len(rows) >= 5000 or held >= 4 << 20:
                            yield pa.RecordBatch.from_pylist(rows, schema)
                            rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema)

    ship(archives.sparkSession)
    n = max(archives.count(), 1)
    return archives.select("archive").repartitionByRange(n, "archive").mapInArrow(run, RECORDS)


def page_records(pages: DataFrame) -> DataFrame:
    """Rows for ``write_archives``: of equal payloads of LEAST_REVISIT bytes or more, the one with the
    least page_id is stored, the others refer to it. Counting goes before the join, which Spark splits
    where one payload has very many pages."""
    name = lambda c: F.format_string("<urn:page:%s>", F.col(c).cast("string"))
    rows = pages.select("page_id", F.col("url").cast("string").alias("uri"), text_of("html").alias("payload"), F.sha2(text_of("html").cast("binary"), 256).alias("digest"))
    long = rows.where(F.octet_length("payload") >= LEAST_REVISIT)
    first = cut_lineage(long.groupBy("digest").agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").select("digest", "first"))
    to = F.when(F.col("page_id").isNotNull() & (F.col("page_id") != F.col("first")), name("first"))
    return rows.join(first, "digest", "left").select(name("page_id").alias("record_id"), "uri", "payload", "digest", to.alias("refers_to"))


def archive_pages(pages: DataFrame, folder: str | None = None) -> DataFrame:
    """One row per row of ``pages``, from archives written and read back: page_id, payload_bytes,
    payload_digest, record_type, refers_to, uri.

    A null html is an empty payload. Rows that share the least page_id of equal payloads are all stored;
    rows with a null page_id are stored and come back with a null page_id. A null url is an empty one;
    control characters in it are percent-encoded. Very long pages are one record. An empty table gives
    no archives and an empty result; other columns are not looked at.
    """
    spark = pages.sparkSession
    folder = folder or f"{_uri(ensure_checkpoint_dir(spark))}/warc-{uuid.uuid4().hex}"
    back = read_archives(write_archives(page_records(pages), folder), payloads=False).where("kind = 'record'")
    kind = pages.schema["page_id"].dataType.simpleString()
    key = lambda c: F.regexp_extract(c, "^<urn:page:(.*)>$", 1).try_cast(kind)
    return back.select(key("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", key("refers_to").alias("refers_to"), "uri")


def _uri(folder: str) -> str:
    return folder if ":/" in folder else f"file://{folder}"


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return archive_pages(table(spark, sf_dir, "pages"))


OP1_SQL = """
WITH p AS (SELECT page_id, url, encode(coalesce(html, '')) AS b, coalesce(html, '') AS h FROM pages),
d AS (SELECT page_id, url, octet_length(b) AS payload_bytes, sha256(h) AS payload_digest FROM p),
g AS (SELECT payload_digest, min(page_id) AS first FROM d WHERE payload_bytes >= 100 GROUP BY payload_digest)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN page_id <> first THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN page_id <> first THEN first END AS refers_to, coalesce(url, '') AS uri
FROM d LEFT JOIN g USING (payload_digest)
"""
