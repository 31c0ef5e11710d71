"""Web archives written with an index, and read back by byte ranges.

Tasks write archives (WARC 1.1, one gzip member a record) straight into a shared folder
and return the index: file, offset, length, URL and digest of every record. Records are
read by sorting the wanted index rows by file and offset and reading neighbours with one
request. A file takes its name from the attempt that writes it, and only the index makes
it known, so a lost or repeated task leaves at most a file nobody refers to.

Of records with equal payloads of at least ``LEAST`` bytes the one with the smallest
``page_id`` is a response and the others are revisits without payload; rows tied in that
id are all responses. A null id comes after all others. Null markup is an empty
payload, a null URL an empty one. The folder is anything ``pyarrow.fs`` opens by URI.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dateline.session import cut

LEAST = 100
FILE_BYTES = 1 << 30  # an archive is closed beyond this size
GAP, SPAN = 64 << 10, 8 << 20  # bytes skipped between neighbours, bytes of one request
SHARE = 16 << 20  # bytes of archive that a task reads, about
DATE = "1970-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

INDEX = (
    "file string, offset long, length long, url string, digest string, page_id long, "
    "record_id string, record_type string, refers_to long"
)
RECORD = (
    "page_id long, url string, record_id string, record_type string, refers_to long, "
    "refers_to_record string, digest string, payload binary"
)
_INDEX_SCHEMA = pa.schema(
    [(n, pa.int64() if k == "long" else pa.string()) for n, k in (c.split() for c in INDEX.split(", "))]
)


def _record_id(page_id: int | None, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page_id}:{digest}')}>"


def record(row: dict, date: str) -> bytes:
    """One record, compressed; a revisit has the block's header only."""
    payload = row["payload"].encode("utf-8")
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n"
    block = head.encode()
    fields = {
        "WARC-Type": row["record_type"],
        "WARC-Record-ID": _record_id(row["page_id"], row["digest"]),
        "WARC-Date": date,
        "WARC-Target-URI": quote(row["url"] or "", safe="%/:=&?~#+!$,;'@()*[]"),
        "WARC-Payload-Digest": f"sha256:{row['digest']}",
    }
    if row["record_type"] == "revisit":
        fields |= {"WARC-Profile": PROFILE, "WARC-Refers-To": _record_id(row["refers_to"], row["digest"])}
    else:
        block += payload
    fields |= {"Content-Type": "application/http; msgtype=response", "Content-Length": len(block)}
    text = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields.items()) + "\r\n"
    squeeze = zlib.compressobj(1, zlib.DEFLATED, 31)
    return squeeze.compress(text.encode() + block + b"\r\n\r\n") + squeeze.flush()


def parsed(data: bytes) -> dict:
    """Header fields and payload of one record, checked against its digest."""
    whole = zlib.decompress(data, 31)
    head, _, rest = whole.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    block = rest[: int(fields["Content-Length"])]
    payload = None
    if fields["WARC-Type"] == "response":
        payload = block.partition(b"\r\n\r\n")[2]
        if f"sha256:{hashlib.sha256(payload).hexdigest()}" != fields["WARC-Payload-Digest"]:
            raise ValueError(f"damaged record {fields['WARC-Record-ID']}")
    return fields | {"payload": payload}


def _writer(folder: str, date: str):
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, top = pyarrow.fs.FileSystem.from_uri(folder)
        store.create_dir(top, recursive=True)
        sink, name, at = None, "", 0
        for batch in batches:
            for part in range(0, batch.num_rows, 256):
                rows = []
                for row in batch.slice(part, 256).to_pylist():
                    if sink is None or at >= FILE_BYTES:
                        if sink is not None:
                            sink.close()
                        name, at = f"{uuid.uuid4().hex}.warc.gz", 0
                        sink = store.open_output_stream(f"{top}/{name}", compression=None)
                    data = record(row, date)
                    sink.write(data)
                    rows.append(
                        {c: row[c] for c in ("url", "digest", "page_id", "record_type", "refers_to")}
                        | {"file": f"{folder}/{name}", "offset": at, "length": len(data),
                           "record_id": _record_id(row["page_id"], row["digest"])}
                    )
                    at += len(data)
                yield pa.RecordBatch.from_pylist(rows, _INDEX_SCHEMA)
        if sink is not None:
            sink.close()

    return write


def write_archives(pages: DataFrame, folder: str, least: int = LEAST, date: str = DATE) -> DataFrame:
    """Write ``pages(page_id, url, html)`` as archives below ``folder``; returns the index.

    Runs a job: archives and index are written, the index to the shared folder.
    """
    html = F.coalesce("html", F.lit(""))
    rows = pages.select("page_id", "url", html.alias("payload")).withColumn("digest", F.sha2("payload", 256))
    long = F.octet_length("payload") >= least
    copies = rows.where(long).groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n"))
    copies = cut(copies.where("n > 1").select("digest", "first"), "copies")
    # Below ``least`` a digest has no copies row: equal digests mean equal lengths.
    revisit = F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first"))
    marked = rows.join(copies, "digest", "left").select(
        "page_id", "url", "payload", "digest",
        F.when(revisit, "revisit").otherwise("response").alias("record_type"),
        F.when(revisit, F.col("first")).alias("refers_to"),
    )
    return cut(marked.mapInArrow(_writer(folder, date), INDEX), "index")


def _reader(gap: int, span: int):
    def fetch(rows: list[dict]) -> pa.RecordBatch:
        store, path = pyarrow.fs.FileSystem.from_uri(rows[0]["file"])
        first, end = rows[0]["offset"], max(r["offset"] + r["length"] for r in rows)
        with store.open_input_file(path) as source:
            data = source.read_at(end - first, first)
        out = []
        for row in rows:
            at = row["offset"] - first
            got = parsed(data[at : at + row["length"]])
            out.append(
                {
                    "page_id": row["page_id"], "url": row["url"], "record_id": got["WARC-Record-ID"],
                    "record_type": got["WARC-Type"], "refers_to": row["refers_to"],
                    "refers_to_record": got.get("WARC-Refers-To"),
                    "digest": got["WARC-Payload-Digest"].removeprefix("sha256:"), "payload": got["payload"],
                }
            )
        return pa.RecordBatch.from_pylist(out, _RECORD_SCHEMA)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[dict] = []
        for batch in batches:
            for row in batch.to_pylist():
                if held:
                    end = held[-1]["offset"] + held[-1]["length"]
                    near = row["file"] == held[0]["file"] and row["offset"] - end <= gap
                    if not near or row["offset"] + row["length"] - held[0]["offset"] > span:
                        yield fetch(held)
                        held = []
                held.append(row)
        if held:
            yield fetch(held)

    return read


_RECORD_SCHEMA = pa.schema(
    [
        (n, {"long": pa.int64(), "string": pa.string(), "binary": pa.binary()}[k])
        for n, k in (c.split() for c in RECORD.split(", "))
    ]
)


def read_records(index: DataFrame, gap: int = GAP, span: int = SPAN, share: int = SHARE) -> DataFrame:
    """The records of the given index rows, each checked; revisits have a null payload.

    A task reads about ``share`` bytes of archive: index rows are few bytes, so their
    number of partitions is set by the bytes they name. Runs a job over the index.
    """
    wanted = index.select("file", "offset", "length", "page_id", "url", "refers_to")
    named = wanted.agg(F.coalesce(F.sum("length"), F.lit(0)).alias("n")).first()["n"]
    ordered = wanted.repartitionByRange(max(1, -(-named // share)), "file", "offset")
    return ordered.sortWithinPartitions("file", "offset").mapInArrow(_reader(gap, span), RECORD)


def described(records: DataFrame) -> DataFrame:
    """``page_id, payload_bytes, payload_digest, record_type, refers_to``; what a revisit
    stands for is taken from the response it refers to. Runs a job."""
    slim = cut(
        records.select(
            "page_id", "record_id", "record_type", "refers_to", "refers_to_record",
            F.octet_length("payload").cast("long").alias("payload_bytes"), F.sha2("payload", 256).alias("payload_digest"),
        ),
        "records",
    )
    of = slim.where("record_type = 'response'").groupBy(F.col("record_id").alias("refers_to_record")).agg(
        F.first("payload_bytes").alias("payload_bytes"), F.first("payload_digest").alias("payload_digest")
    )
    columns = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    revisits = slim.where("record_type = 'revisit'").drop("payload_bytes", "payload_digest").join(of, "refers_to_record", "left")
    return slim.where("record_type = 'response'").select(*columns).unionByName(revisits.select(*columns))
