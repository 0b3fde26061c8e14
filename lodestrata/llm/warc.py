"""WARC archives with an index that is written first and read by coalesced byte ranges.

Writing: each task writes archives of its own, one gzip member to a record, into a folder that
all executors share, and returns a row for each record: archive, offset, length, url, digest,
type. That table is the index, and only archives that it names count, so a task that is run
again after a lost executor leaves at most an archive nobody refers to.

Reading: the selected index rows are dealt by archive and stretch of it, sorted by offset, and
neighbouring ranges (gaps of up to ``GAP`` bytes, ``SPAN`` at most) are fetched in one read; each
record is then cut out of it, parsed, and its digest recomputed from the bytes.

Of records with equal payloads the one with the smallest id is a response, the others are
revisits of it, with the response's HTTP headers and no payload. Payloads are compared by
SHA-256; the digest written is the SHA-1 that the format has by custom.

Defined cases: a null payload counts as empty; a null url leaves its header out; a null id sorts
before any other; rows that agree in id and payload are all responses if theirs is the smallest
id; very long payloads are one record each; ids are whole numbers or strings; other columns, whatever
their names, aren't read, and the index has names of its own; control characters in urls are percent-encoded; an empty table gives an empty index.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from urllib.parse import quote, unquote

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise, shared_dir

ARCHIVE_BYTES = 1 << 28
GAP, SPAN = 1 << 16, 1 << 23
STRETCH = 1 << 26
INDEX = "archive string, offset long, length long, url string, digest string, record_type string, {id} {kind}, refers_to {kind}"


def sha1_base32(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _header(url: str | None) -> str:
    # a percent sign is encoded too, so that reading gives the same url back
    return quote(url, safe="!#$&'()*+,/:;=?@[]~-._") if url else ""


def record(key, url: str | None, payload: bytes, refers_to, is_revisit: bool) -> tuple[bytes, str]:
    """One record as a gzip member, and its payload digest."""
    digest = sha1_base32(payload)
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    body = http if is_revisit else http + payload
    lines = ["WARC/1.1", f"WARC-Type: {'revisit' if is_revisit else 'response'}", f"WARC-Record-ID: <urn:page:{'' if key is None else key}>", "WARC-Date: 1970-01-01T00:00:00Z", f"WARC-Payload-Digest: sha1:{digest}"]
    if url:
        lines.append(f"WARC-Target-URI: {_header(url)}")
    if is_revisit:
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:page:{'' if refers_to is None else refers_to}>"]
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(body)}", "", ""]
    member = zlib.compressobj(6, zlib.DEFLATED, 31)
    return member.compress("\r\n".join(lines).encode() + body + b"\r\n\r\n") + member.flush(), digest


def parse(member: bytes) -> dict:
    """Headers, HTTP headers and payload of one record."""
    raw = zlib.decompress(member, 31)
    head, _, rest = raw.partition(b"\r\n\r\n")
    first, *lines = head.decode().split("\r\n")
    if not first.startswith("WARC/"):
        raise ValueError("no WARC record begins here")
    headers = dict(x.split(": ", 1) for x in lines)
    body = rest[: int(headers["Content-Length"])]
    http, _, payload = body.partition(b"\r\n\r\n")
    return {"headers": headers, "http": dict(x.split(": ", 1) for x in http.decode().split("\r\n")[1:]), "payload": payload}


def _writer(folder: str, names: tuple[str, str], kind: pa.DataType, archive_bytes: int):
    def run(batches):
        store, path = fs.FileSystem.from_uri(folder)
        out, name, offset = None, "", 0
        try:
            for batch in batches:
                rows = {c: [] for c in ("archive", "offset", "length", "url", "digest", "record_type", names[0], "refers_to")}
                for key, url, payload, first, revisit in zip(*(batch.column(c).to_pylist() for c in ("_id", "_url", "_payload", "_first", "_revisit")), strict=True):
                    if out is None or offset >= archive_bytes:
                        if out is not None:
                            out.close()
                        name, offset = f"{uuid.uuid4().hex}.warc.gz", 0
                        store.create_dir(path, recursive=True)
                        out = store.open_output_stream(f"{path}/{name}", compression=None)
                    member, digest = record(key, url, payload or b"", first, revisit)
                    out.write(member)
                    values = (name, offset, len(member), url, digest, "revisit" if revisit else "response", key, first if revisit else None)
                    for c, v in zip(rows, values, strict=True):
                        rows[c].append(v)
                    offset += len(member)
                types = [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), kind, kind]
                yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(rows.values(), types, strict=True)], names=list(rows))
        finally:
            if out is not None:
                out.close()

    return run


def _arrow(kind: str) -> pa.DataType:
    known = {"bigint": pa.int64(), "int": pa.int32(), "smallint": pa.int16(), "tinyint": pa.int8(), "string": pa.string()}
    if kind not in known:
        raise ValueError(f"record ids are whole numbers or strings, not {kind}; cast them")
    return known[kind]


def write_archives(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Write a record for each row below ``folder`` and return the index, itself written there."""
    kind = pages.schema[id_col].dataType.simpleString()
    payload = F.coalesce(F.col(payload_col).cast("binary"), F.lit(b""))
    rows = pages.select(F.col(id_col).alias("_id"), F.col(url_col).alias("_url"), payload.alias("_payload"))
    rows = rows.withColumn("_sha", F.unhex(F.sha2("_payload", 256)))
    firsts = rows.groupBy("_sha").agg(F.min(F.struct("_id")).alias("_least"), F.count("*").alias("_n")).filter("_n > 1").select(F.col("_sha").alias("_g"), F.col("_least._id").alias("_first"))
    firsts = materialise(firsts, "firsts")  # both sides of the join are then dealt anew, and a hot payload can be split
    both = rows.join(firsts, F.col("_sha") == F.col("_g"), "left")
    revisit = F.col("_g").isNotNull() & ~F.col("_id").eqNullSafe(F.col("_first"))
    both = both.select("_id", "_url", "_payload", "_first", revisit.alias("_revisit"))
    index = both.mapInArrow(_writer(folder, (id_col, url_col), _arrow(kind), archive_bytes), INDEX.format(id=id_col, kind=kind))
    path = f"{folder}/index"
    index.write.parquet(path)
    return pages.sparkSession.read.schema(index.schema).parquet(path)


def _reader(folder: str, id_col: str, kind: pa.DataType, with_payload: bool):
    def flush(file, waiting):
        low = waiting[0][1]
        file.seek(low)
        data = file.read(max(o + n for _, o, n in waiting) - low)
        for _, offset, length in waiting:
            yield parse(data[offset - low : offset - low + length])

    def run(batches):
        store, path = fs.FileSystem.from_uri(folder)
        name, file, waiting, got = None, None, [], []

        def take():
            return flush(file, waiting) if waiting else ()

        def batch_of(records):
            keys, sizes, digests, types, refs, urls, payloads = [], [], [], [], [], [], []
            number = (lambda x: x) if pa.types.is_string(kind) else int
            for r in records:
                h = r["headers"]
                name_of = lambda x: number(x) if (x := x.removeprefix("<urn:page:").removesuffix(">")) else None
                revisit = h["WARC-Type"] == "revisit"
                written = h["WARC-Payload-Digest"].removeprefix("sha1:")
                if not revisit and sha1_base32(r["payload"]) != written:
                    raise ValueError(f"the payload of {h['WARC-Record-ID']} doesn't match its digest")
                keys.append(name_of(h["WARC-Record-ID"]))
                sizes.append(int(r["http"]["Content-Length"]) if revisit else len(r["payload"]))
                digests.append(written)
                types.append(h["WARC-Type"])
                refs.append(name_of(h["WARC-Refers-To"]) if revisit else None)
                urls.append(unquote(h["WARC-Target-URI"]) if "WARC-Target-URI" in h else None)
                payloads.append(None if revisit or not with_payload else r["payload"])
            columns = {id_col: pa.array(keys, kind), "payload_bytes": pa.array(sizes, pa.int64()), "payload_digest": pa.array(digests, pa.string()), "record_type": pa.array(types, pa.string()), "refers_to": pa.array(refs, kind), "url": pa.array(urls, pa.string()), "payload": pa.array(payloads, pa.binary())}
            return pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))

        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in ("archive", "offset", "length")), strict=True):
                if waiting and (row[0] != name or row[1] - (waiting[-1][1] + waiting[-1][2]) > GAP or row[1] + row[2] - waiting[0][1] > SPAN):
                    yield batch_of(take())
                    waiting = []
                if row[0] != name:
                    if file is not None:
                        file.close()
                    name, file = row[0], store.open_input_file(f"{path}/{row[0]}")
                waiting.append(row)
        yield batch_of(take())
        if file is not None:
            file.close()

    return run


def read_records(index: DataFrame, folder: str, id_col: str = "page_id", with_payload: bool = True) -> DataFrame:
    """The records that ``index`` lists: id_col, payload_bytes, payload_digest, record_type, refers_to, url, payload (null for revisits)."""
    kind = index.schema[id_col].dataType.simpleString()
    places = index.select("archive", "offset", "length", F.floor(F.col("offset") / STRETCH).alias("stretch"))
    stretches = places.select("archive", "stretch").distinct().count()  # as many tasks, however small the index is
    sorted_ = places.repartition(max(1, stretches), "archive", "stretch").drop("stretch").sortWithinPartitions("archive", "offset")
    return sorted_.mapInArrow(_reader(folder, id_col, _arrow(kind), with_payload), f"{id_col} {kind}, payload_bytes long, payload_digest string, record_type string, refers_to {kind}, url string, payload binary")


def round_trip(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html") -> DataFrame:
    """Write all rows as archives in shared storage, read them all back; without the payloads."""
    folder = f"{shared_dir(pages.sparkSession)}/warc"
    index = write_archives(pages, folder, id_col, url_col, payload_col)
    return read_records(index, folder, id_col, with_payload=False).drop("payload")
