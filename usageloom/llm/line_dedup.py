"""Removal of lines that repeat across documents, with two Bloom filters.

One filter holds the hashes of lines seen once, the other those seen twice or more. Tasks fill both over their own rows,
and merging is associative: twice = either's twice, or in both of the once filters. A line that the merged second filter
doesn't hold is in one document only, and never shuffles. The suspected rest is confirmed exactly, by SHA-256 of the
line's key, with partial counts before the shuffle; a line keeps its place in one document and goes from the others.

The filters' size follows the number of lines. Two filters of MOST_BITS are what a task may hold: more lines are dealt to
ranges by their hash, each of which has filters of its own, so that they never fill up. The digests are then written once
more, a folder for each range, so that each range reads its own ones only; RANGES_AT_ONCE ranges are worked on at a time.

Defined cases: a null text is an empty line; a text of any length is split whole; rows with a null id count as one document
together and are never the one that keeps a line if another holds it; rows with the same id are one document; ties can't
occur, as the keeping document is named by its id, and all its copies of the line stay. An empty table gives an empty
result. Extra columns pass through, and clashing result names get a trailing underscore.
"""

import hashlib
import zlib
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from usageloom.llm.shared import col, fresh, scratch, stored

BITS_A_LINE = 12
#: Filters have from 2^20 to 2^29 bits; they are dealt in segments of 2^20 bits, and the second one is broadcast (64 MB at most).
SEGMENT_BITS = 20
LEAST_BITS, MOST_BITS = 20, 29
PROBES = 3
#: Ranges that are worked on at a time (64 MB of the driver each at most), and the tasks that a range's digests are dealt to at least.
RANGES_AT_ONCE, RANGE_TASKS = 4, 16


def line_keys(lines: pa.Array) -> pa.Array:
    """The lines without white space at their ends (blank and \\x09-\\x0D), with A-Z in lower case."""
    return pc.ascii_lower(pc.ascii_trim(lines, " \t\n\x0b\x0c\r"))


def _digests(min_chars: int):
    """Rows (id, row, at, digest) of a task's lines of min_chars code points or more: their numbers and SHA-256 hashes."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lines = pc.split_pattern(batch.column("text").fill_null(""), "\n")
            starts, of = lines.offsets.to_numpy(), pc.list_parent_indices(lines).to_numpy()
            keys = line_keys(lines.flatten())
            long = np.flatnonzero(pc.greater_equal(pc.utf8_length(keys), min_chars).to_numpy(zero_copy_only=False))
            digests = [hashlib.sha256(k.as_buffer()).digest() for k in keys.take(pa.array(long))]
            at = (long - (starts[of[long]] - starts[0])).astype(np.int32)
            own = [batch.column(c).take(pa.array(of[long])) for c in ("id", "row")]
            yield pa.RecordBatch.from_arrays([*own, pa.array(at), pa.array(digests, pa.binary())], ["id", "row", "at", "digest"])

    return rows


def _hashes(digests: pa.Array) -> np.ndarray:
    """The first 64 bits of each digest."""
    return np.frombuffer(b"".join(d[:8] for d in digests.to_pylist()), np.uint64)


def _spots(hashes: np.ndarray, bits: int) -> np.ndarray:
    """The PROBES bit numbers of each hash, by double hashing."""
    h = hashes
    step = (h >> np.uint64(33)) | np.uint64(1)
    return np.stack([(h + np.uint64(i) * step) & np.uint64((1 << bits) - 1) for i in range(PROBES)]).astype(np.int64)


def _held(bitmap: np.ndarray, spots: np.ndarray) -> np.ndarray:
    return ((bitmap[spots >> 3] >> (spots & 7).astype(np.uint8)) & 1).all(axis=0)


def _put(bitmap: np.ndarray, spots: np.ndarray) -> None:
    np.bitwise_or.at(bitmap, spots.ravel() >> 3, (1 << (spots.ravel() & 7)).astype(np.uint8))


def _filters(bits: int):
    """Rows (segment, once, twice) of a task's two filters, without empty segments."""

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        once, twice = (np.zeros(1 << (bits - 3), np.uint8) for _ in range(2))
        for batch in batches:
            hashes, counts = np.unique(_hashes(batch.column(0)), return_counts=True)
            spots = _spots(hashes, bits)
            _put(twice, spots[:, (counts > 1) | _held(once, spots)])
            _put(once, spots)
        size = 1 << (SEGMENT_BITS - 3)
        for i in range(0, len(once), size):
            if (a := once[i : i + size]).any():
                packed = [zlib.compress(x.tobytes(), 1) for x in (a, twice[i : i + size])]
                yield pa.RecordBatch.from_pydict({"segment": pa.array([i // size], pa.int32()), "once": packed[:1], "twice": packed[1:]})

    return fill


def _merged(segment: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One segment of the second filter, from all tasks' parts of it, one at a time."""
    once, twice = (np.zeros(1 << (SEGMENT_BITS - 3), np.uint8) for _ in range(2))
    for batch in batches:
        for a, b in zip(batch.column("once"), batch.column("twice"), strict=True):
            a, b = (np.frombuffer(zlib.decompress(x.as_py()), np.uint8) for x in (a, b))
            twice |= b | (once & a)
            once |= a
    if twice.any():
        yield pa.RecordBatch.from_pydict({"segment": pa.array([segment[0].as_py()], pa.int32()), "twice": [zlib.compress(twice.tobytes(), 1)]})


def range_of(digest: str, n_ranges: int) -> Column:
    """The range of a digest, told by other bytes than those that are hashed into the filters."""
    return F.pmod(F.conv(F.hex(F.substring(digest, 9, 6)), 16, 10).cast("long"), F.lit(n_ranges)).cast("int")


def repeated_filter(digests: DataFrame, n_lines: int) -> tuple[int, list[tuple[int, bytes]]]:
    """The second filter over a column of digests: its size as a power of 2, and its packed segments."""
    bits = min(max((max(n_lines, 1) * BITS_A_LINE - 1).bit_length(), LEAST_BITS), MOST_BITS)
    # Few tasks fill the filters: each may hand on up to the filters' whole size.
    spark = digests.sparkSession
    tasks = max(spark.sparkContext.defaultParallelism, n_lines >> 23)
    parts = digests.coalesce(tasks).mapInArrow(_filters(bits), "segment int, once binary, twice binary")
    whole = parts.groupBy("segment").applyInArrow(_merged, "segment int, twice binary")
    return bits, [(r[0], bytes(r[1])) for r in whole.toLocalIterator()]


def _suspected(filter_cast, bits: int):
    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bitmap = np.zeros(1 << (bits - 3), np.uint8)
        size = 1 << (SEGMENT_BITS - 3)
        for i, packed in filter_cast.value:
            bitmap[i * size : (i + 1) * size] = np.frombuffer(zlib.decompress(packed), np.uint8)
        for batch in batches:
            held = _held(bitmap, _spots(_hashes(batch.column("digest")), bits))
            yield batch.filter(pa.array(held.astype(bool)))

    return keep


def _suspects(rows: DataFrame, n_lines: int, schema: str) -> DataFrame:
    """The rows whose digest the second filter over all of them holds."""
    bits, segments = repeated_filter(rows.select("digest"), n_lines)
    return rows.mapInArrow(_suspected(rows.sparkSession.sparkContext.broadcast(segments), bits), schema)


def dropped_lines(docs: DataFrame, id_col: str, text_col: str, min_chars: int, min_docs: int) -> DataFrame:
    """Rows (id, row, drops): the numbers, from 0, of the lines that a row loses; only rows that lose some.

    row is a hash of the text, so that rows that repeat an id with other texts keep their own line numbers.
    """
    spark = docs.sparkSession
    id_type = docs.schema[id_col].dataType.simpleString()
    schema = f"id {id_type}, row long, at int, digest binary"
    whole = docs.select(col(id_col).alias("id"), F.xxhash64(col(text_col)).alias("row"), col(text_col).alias("text"))
    # A line that one document holds twice goes in twice: it is suspected, and the exact count clears it.
    rows = stored(whole.mapInArrow(_digests(min_chars), schema), "line-digests")
    n_lines = rows.count()
    n_ranges = max(1, -(-n_lines * BITS_A_LINE // (1 << MOST_BITS)))
    if n_ranges == 1:
        suspects = stored(_suspects(rows, n_lines, schema), "suspect-lines")
    else:
        dealt, path = scratch(spark, "ranged-digests"), scratch(spark, "suspect-lines")
        ranged = rows.withColumn("range", range_of("digest", n_ranges)).withColumn("salt", F.pmod(F.xxhash64("row", "at"), F.lit(RANGE_TASKS)))
        ranged.repartition(n_ranges * RANGE_TASKS, "range", "salt").drop("salt").write.partitionBy("range").parquet(dealt)
        sizes = {r[0]: r[1] for r in spark.read.parquet(dealt).groupBy("range").count().collect()}

        def work(i: int) -> None:
            _suspects(spark.read.schema(schema).parquet(f"{dealt}/range={i}"), sizes[i], schema).write.parquet(f"{path}/range={i}")

        with ThreadPoolExecutor(RANGES_AT_ONCE) as pool:
            list(pool.map(work, sorted(sizes)))
        suspects = spark.read.schema(schema).parquet(path)
    held = suspects.groupBy("digest", "id").agg(F.lit(1).alias("one"))
    counts = held.groupBy("digest").agg(F.count("one").alias("n"), F.max("id").alias("keeper")).where(F.col("n") >= min_docs)
    counts = stored(counts.select("digest", "keeper"), "repeated-lines")  # as a table, so that the join can split a hot line
    gone = suspects.join(counts, "digest").where(~F.col("id").eqNullSafe(F.col("keeper")))
    return gone.groupBy("id", "row").agg(F.collect_set("at").alias("drops"))


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 40, min_docs: int = 5) -> DataFrame:
    """docs with the repeated lines gone from the text, and columns n_lines (before) and n_dropped.

    A key is a line stripped and lower-cased (see line_keys). Keys of min_chars code points or more, found in min_docs
    documents or more, lose their lines in all but the document with the largest id that holds the key.
    """
    n_lines, n_dropped, drops, lines, key, row = fresh(docs, "n_lines", "n_dropped", "drops", "lines", "id_", "row")
    gone = dropped_lines(docs, id_col, text_col, min_chars, min_docs).toDF(key, row, drops)
    joined = docs.join(gone, col(id_col).eqNullSafe(col(key)) & (F.xxhash64(col(text_col)) == col(row)), "left").drop(key, row)
    split = joined.withColumn(lines, F.split(F.coalesce(col(text_col), F.lit("")), "\n", -1))
    places = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), col(drops))
    kept = F.transform(places, lambda i: F.get(col(lines), i))
    text = F.when(col(drops).isNull(), col(text_col)).otherwise(F.concat_ws("\n", kept)).alias(text_col)
    return split.select(
        *[text if c == text_col else col(c) for c in docs.columns],
        F.size(lines).cast("long").alias(n_lines),
        F.coalesce(F.size(drops), F.lit(0)).cast("long").alias(n_dropped),
    )
