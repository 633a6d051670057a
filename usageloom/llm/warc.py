"""WARC archives with an index that is written first and read by coalesced byte ranges.

Writing: each task writes its pages as WARC records, gzipped one by one, into files of its own in the shared folder, and
returns a row for each record: file, offset, length, URL and digest. Only the rows of tasks that succeeded reach the index
table, so files of lost attempts are never read. Reading: the selected index rows of a file's stretch are sorted by
offset and neighbours coalesced into ranges; each range is one read, from which its records are parsed and verified.
Stretches are dealt to tasks in proportion to the bytes that are to be read.

Payloads that occur more than once (of MIN_REVISIT bytes or more) are stored once: the page with the smallest id has a
response record, the others revisit it. The hash of a payload is counted before the shuffle, and only digests that repeat
are joined, so a payload that a third of all pages share is split like any skewed join.

Defined cases: a null page is an empty payload; rows that repeat the smallest id are all responses; a null id is never
smaller than another and revisits if its payload has a page with an id, else it is a response; a null URL is written as
an empty one; a page of any length is one record, which the task that writes or reads it holds; ids are integers; an
empty table writes no files. Columns other than the three named are ignored.
"""

import gzip
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from usageloom.llm.shared import col, scratch, stored

MIN_REVISIT = 100
#: Bytes after which a task starts another file; of a file's stretch that is read by one group; gaps that a read bridges.
FILE_BYTES, STRETCH_BYTES, GAP_BYTES = 256 << 20, 4 << 20, 64 << 10
#: Compressed bytes that a task reads back.
TASK_BYTES = 64 << 20
DATE = "1970-01-01T00:00:00Z"


def payload_digest(html: Column) -> Column:
    return F.sha2(F.coalesce(html, F.lit("")), 256)


def classified(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Rows (page_id, url, html, digest, refers_to); refers_to is null for responses."""
    rows = pages.select(col(id_col).alias("page_id"), col(url_col).alias("url"), col(html_col).alias("html"))
    rows = rows.withColumn("digest", payload_digest(F.col("html")))
    large = F.octet_length(F.coalesce("html", F.lit(""))) >= MIN_REVISIT
    counts = rows.where(large).groupBy("digest").agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n"))
    # As a table, so that the join can split a hot digest on the pages' side, or broadcast where there are few repeats.
    repeats = stored(counts.where("n > 1 and first is not null").select("digest", "first"), "repeated-payloads")
    joined = rows.join(repeats, "digest", "left")
    return joined.withColumn("refers_to", F.when(~F.col("page_id").eqNullSafe(F.col("first")), F.col("first"))).drop("first")


def _filesystem(uri: str) -> tuple[pafs.FileSystem, str]:
    """Arrow's file system of a folder that Spark names: s3a and s3n are s3 there."""
    named = re.sub(r"^s3[an]:", "s3:", uri)
    return pafs.FileSystem.from_uri(named if re.match(r"\w+:/", named) else f"file://{named}")


def _headers(fields: dict[str, str]) -> bytes:
    clean = {k: re.sub(r"[\r\n]+", " ", v) for k, v in fields.items()}
    return ("WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in clean.items()) + "\r\n").encode()


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """A gzipped WARC record; a revisit holds no payload, but its size and digest."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    fields = {
        "WARC-Type": "response" if refers_to is None else "revisit",
        "WARC-Record-ID": f"<urn:page:{'' if page_id is None else page_id}>",
        "WARC-Date": DATE,
        "WARC-Target-URI": url or "",
        "WARC-Payload-Digest": f"sha256:{digest}",
        "Content-Type": "application/http; msgtype=response",
    }
    if refers_to is not None:
        fields |= {
            "WARC-Profile": "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest",
            "WARC-Refers-To": f"<urn:page:{refers_to}>",
        }
    fields["Content-Length"] = str(len(block))
    return gzip.compress(_headers(fields) + block + b"\r\n\r\n", compresslevel=4, mtime=0)


def parse(raw: bytes) -> dict:
    """The fields of a gzipped record; its payload is verified against the digest, a revisit's is empty."""
    head, _, rest = zlib.decompress(raw, wbits=31).partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    block = rest[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    size = int(re.search(rb"Content-Length: (\d+)", http)[1])
    digest = fields["WARC-Payload-Digest"].removeprefix("sha256:")
    kind, number = fields["WARC-Type"], lambda name: int(m[1]) if (m := re.fullmatch(r"<urn:page:(-?\d+)>", fields.get(name, ""))) else None
    if rest[len(block) :] != b"\r\n\r\n" or kind == "response" and (len(payload) != size or hashlib.sha256(payload).hexdigest() != digest):
        raise ValueError(f"record {fields['WARC-Record-ID']} is damaged")
    return {
        "page_id": number("WARC-Record-ID"),
        "url": fields["WARC-Target-URI"],
        "payload_bytes": size,
        "payload_digest": digest,
        "record_type": kind,
        "refers_to": number("WARC-Refers-To"),
        "payload": payload if kind == "response" else None,
    }


INDEX = "page_id long, file string, offset long, length long, url string, digest string"


def _writer(folder: str):
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, path = _filesystem(folder)
        out, name, at = None, "", 0
        try:
            for batch in batches:
                rows = []
                for r in batch.to_pylist():
                    if out is None or at >= FILE_BYTES:
                        if out is not None:
                            out.close()
                        name, at = f"{uuid.uuid4().hex}.warc.gz", 0
                        fs.create_dir(path, recursive=True)
                        out = fs.open_output_stream(f"{path}/{name}", compression=None)
                    raw = record(r["page_id"], r["url"], (r["html"] or "").encode(), r["digest"], r["refers_to"])
                    out.write(raw)
                    rows.append((r["page_id"], f"{folder}/{name}", at, len(raw), r["url"], r["digest"]))
                    at += len(raw)
                kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
                columns = list(zip(*rows, strict=True)) or [()] * len(kinds)
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], [f.split()[0] for f in INDEX.split(", ")])
        finally:
            if out is not None:
                out.close()

    return write


def write_archives(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Write every page's record; return the index, a stored table of INDEX's columns."""
    folder = scratch(pages.sparkSession, "warc")
    rows = classified(pages, id_col, url_col, html_col).select(F.col("page_id").cast("long"), "url", "html", "digest", F.col("refers_to").cast("long"))
    return stored(rows.mapInArrow(_writer(folder), INDEX), "warc-index")


def ranges(index: DataFrame) -> DataFrame:
    """Rows (file, start, stop, records): sorted index rows, coalesced into byte ranges of about STRETCH_BYTES at most.

    Stretches are cut at multiples of STRETCH_BYTES, so that no group grows with its file. The index rows are few bytes, but
    stand for many: so a stated number of tasks, by what they read, which isn't merged when Spark sees small partitions.
    """
    stretch = F.floor(F.col("offset") / STRETCH_BYTES).alias("stretch")
    n_tasks = max(index.sparkSession.sparkContext.defaultParallelism, -(-(index.agg(F.sum("length")).first()[0] or 0) // TASK_BYTES))
    rows = index.select("file", stretch, "offset", (F.col("offset") + F.col("length")).alias("end")).repartition(n_tasks, "file", "stretch")
    order = Window.partitionBy("file", "stretch").orderBy("offset")
    gap = F.col("offset") - F.lag("end", 1).over(order) > GAP_BYTES
    runs = rows.withColumn("run", F.sum(F.coalesce(gap, F.lit(False)).cast("int")).over(order))
    return runs.groupBy("file", "stretch", "run").agg(
        F.min("offset").alias("start"), F.max("end").alias("stop"), F.sort_array(F.collect_list(F.struct("offset", "end"))).alias("records")
    )


RECORD = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary"


def _reader(with_payload: bool):
    kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary()]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                fs, path = _filesystem(r["file"])
                with fs.open_input_file(path) as f:
                    f.seek(r["start"])
                    raw = f.read(r["stop"] - r["start"])
                found = [parse(raw[x["offset"] - r["start"] : x["end"] - r["start"]]) for x in r["records"]]
                if not with_payload:
                    found = [x | {"payload": None} for x in found]
                names = [f.split()[0] for f in RECORD.split(", ")]
                yield pa.RecordBatch.from_arrays([pa.array([x[n] for x in found], k) for n, k in zip(names, kinds, strict=True)], names)

    return read


def read_records(index: DataFrame, with_payload: bool = False) -> DataFrame:
    """The records of the index rows given (all, or a selection of them), read back and verified; columns of RECORD."""
    return ranges(index).mapInArrow(_reader(with_payload), RECORD)
