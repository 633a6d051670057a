"""Hard negatives through vector-approximation files.

Vectors are whole numbers: floor(256 x) of every component. The rows are dealt to blocks of about BLOCK_ROWS by a hash, and
every block is a vector-approximation file: each dimension is quantised into CELLS cells, a byte each, whose edges lie
midway between those of equal shares of the rows and those of equal widths. For an anchor, two tables of a block hold the
least and the greatest product of its component with what a cell really holds; the sums of table entries are a lower and
an upper bound of every row's score. Of a block only rows whose bounds let them be among an anchor's best are scored exactly:
  - positives: rows of the anchor's label whose upper bound reaches the least of the `positives` greatest lower bounds;
  - negatives, for each positive: rows of other labels whose bounds meet the window, and whose upper bound reaches the
    least of the `negatives` greatest lower bounds of those that are surely in it.
A block's best are merged with those of the other blocks by rank, so the results are exact.

Anchors are a stated share of the rows; blocks of them meet blocks of rows, keyed by the block of rows, so that every task has the same
amount of work and no side is broadcast or collected.

Defined cases: rows with a null label or vector, with a null or non-finite component, or without an id take no part; rows
that repeat id, label and vector count once, and rows of one id that differ are rows of their own; a row is never its
own positive; equal scores are ordered by id; vectors of different lengths aren't compared; components so large that a
score could leave the range of a long are clamped (beyond 3 * 10^9 / sqrt(dimensions)); an empty table gives an
empty result; columns besides id, label and vector are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from usageloom.llm.shared import col, small_batches, stored

#: Rows and anchors of a block, and cells of a dimension (256 at most).
BLOCK_ROWS, BLOCK_ANCHORS, CELLS = 8192, 256, 64
ROW = ["id", "label", "anchor", "vector"]


def whole_vectors(rows: DataFrame, anchors: Column, id_col: str, label_col: str, vector_col: str) -> DataFrame:
    """Rows (dim, id, label, anchor, vector) that take part; vector is array<int>."""
    vector = col(vector_col).cast("array<double>")
    usable = col(id_col).isNotNull() & col(label_col).isNotNull() & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    most = F.least(F.lit(2.0**31 - 1), F.floor(F.lit(3.0e9) / F.sqrt(F.greatest(F.size(vector), F.lit(1)))).cast("double"))
    whole = F.transform(vector, lambda x: F.greatest(-most, F.least(most, F.floor(256 * x).cast("double"))).cast("int"))
    named = [col(id_col).cast("long").alias("id"), col(label_col).cast("long").alias("label"), F.coalesce(anchors, F.lit(False)).alias("anchor"), whole.alias("vector")]
    return rows.where(usable).select(F.size(vector).alias("dim"), *named)


class Approximation:
    """A block's vectors, as codes of cells with their real bounds, and what is needed to score a few of them exactly."""

    def __init__(self, vectors: np.ndarray, codes: np.ndarray, low: np.ndarray, high: np.ndarray):
        self.vectors, self.codes, self.low, self.high = vectors, codes, low, high

    @classmethod
    def of(cls, vectors: np.ndarray) -> Approximation:
        n, dim = vectors.shape
        ends, codes = np.zeros((2, dim, CELLS), np.int64), np.zeros((dim, n), np.uint8)
        for d in range(dim):
            values = np.sort(vectors[:, d])
            edges = (values[np.arange(1, CELLS) * n // CELLS] + np.linspace(values[0], values[-1], CELLS + 1)[1:-1]) / 2
            codes[d] = np.searchsorted(edges, vectors[:, d], side="right")
            cuts = np.concatenate([[0], np.searchsorted(values, edges, side="left"), [n]])
            held = np.flatnonzero(cuts[1:] > cuts[:-1])
            ends[:, d, held] = values[cuts[held]], values[cuts[held + 1] - 1]
        return cls(vectors, codes, *ends)

    def bounds(self, anchor: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(least, greatest) possible score of every row: sums of table entries."""
        ends = anchor[:, None] * self.low, anchor[:, None] * self.high
        out = []
        for tables in (np.minimum(*ends), np.maximum(*ends)):
            total = np.zeros(len(self.vectors), np.int64)
            for table, codes in zip(tables, self.codes, strict=True):
                total += table[codes]
            out.append(total)
        return out[0], out[1]

    def scores(self, anchor: np.ndarray, at: np.ndarray) -> np.ndarray:
        return self.vectors[at].astype(np.int64) @ anchor


def _least_of_best(values: np.ndarray, k: int) -> int | None:
    """The k-th greatest; None where there are fewer."""
    return None if len(values) < k else int(np.partition(values, len(values) - k)[len(values) - k])


def _best(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """The places of the k that come first: by score, greatest first, then by id."""
    if len(scores) > k:
        near = np.flatnonzero(scores >= _least_of_best(scores, k))
        return near[np.lexsort((ids[near], -scores[near]))[:k]]
    return np.lexsort((ids, -scores))


def best_positives(block: Approximation, bounds: tuple[np.ndarray, np.ndarray], anchor: np.ndarray, same: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, int]:
    """(places, scores, how many were scored) of the k best rows among those marked in `same`."""
    low, high = bounds
    at = np.flatnonzero(same)
    if (least := _least_of_best(low[at], k)) is not None:
        at = at[high[at] >= least]
    scores = block.scores(anchor, at)
    first = _best(scores, ids[at], k)
    return at[first], scores[first], len(at)


def window_of(positive: int, low: int, high: int) -> tuple[int, int]:
    """The whole scores s for which low * positive <= 100 * s <= high * positive."""
    return -(-low * positive // 100), high * positive // 100


def best_negatives(block: Approximation, bounds: tuple[np.ndarray, np.ndarray], anchor: np.ndarray, other: np.ndarray, ids: np.ndarray, windows: list[tuple[int, int]], k: int) -> tuple[list[tuple[np.ndarray, np.ndarray]], int]:
    """For each window (places, scores) of the k best rows among those marked in `other`; and how many rows were scored."""
    low, high = bounds
    rows = np.flatnonzero(other)
    low, high = low[rows], high[rows]
    wanted, found = np.zeros(len(rows), bool), []
    for least, most in windows:
        may = (high >= least) & (low <= most)
        sure = low[(low >= least) & (high <= most)]
        if (enough := _least_of_best(sure, k)) is not None:
            may &= high >= enough
        wanted |= may
    at = rows[wanted]
    scores = block.scores(anchor, at)
    for least, most in windows:
        inside = np.flatnonzero((scores >= least) & (scores <= most))
        first = inside[_best(scores[inside], ids[at[inside]], k)]
        found.append((at[first], scores[first]))
    return found, len(at)


def _matrix(lists: pa.Array, dim: int) -> np.ndarray:
    return lists.flatten().to_numpy().reshape(len(lists), dim)


def _approximated(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        files = []
        for dim, vectors in zip(batch.column("dim").to_pylist(), batch.column("vector"), strict=True):
            block = Approximation.of(_matrix(vectors.values, dim))
            files.append([block.codes.tobytes(), block.low.tobytes(), block.high.tobytes()])
        for name, held in zip(("codes", "low", "high"), zip(*files, strict=True) if files else ([], [], []), strict=True):
            batch = batch.append_column(name, pa.array(held, pa.binary()))
        yield batch


def approximation_files(rows: DataFrame, n_rows: int) -> DataFrame:
    """Rows (dim, block, id, label, anchor, vector, codes, low, high), a block each: lists of what its rows hold, and its file.

    Rows are dealt by the hash of all that they hold, so repeated rows meet, and count once.
    """
    block = F.pmod(F.xxhash64(*ROW), F.lit(max(1, -(-n_rows // BLOCK_ROWS)))).cast("int")
    blocks = rows.groupBy("dim", block.alias("block")).agg(F.collect_set(F.struct(*ROW)).alias("held"))
    blocks = blocks.select("dim", "block", *[F.col(f"held.{c}").alias(c) for c in ROW])
    return blocks.mapInArrow(_approximated, "dim int, block int, id array<long>, label array<long>, anchor array<boolean>, vector array<array<int>>, codes binary, low binary, high binary")


def _tiles(anchors: DataFrame, files: DataFrame) -> DataFrame:
    """Every block of anchors with every block of rows of its dimension, keyed by the block of rows, which holds as much as any other."""
    n_blocks = (files.agg(F.max("block")).first()[0] or 0) + 1
    n_anchors = anchors.count()
    part = F.pmod(F.xxhash64("uid"), F.lit(max(1, -(-n_anchors // BLOCK_ANCHORS))))
    held = F.collect_list(F.struct(*[c for c in anchors.columns if c != "dim"])).alias("anchors")
    parts = anchors.groupBy("dim", part.alias("part")).agg(held).drop("part")
    dealt = parts.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(n_blocks - 1))))
    return dealt.join(files.drop("anchor"), ["dim", "block"])


def _walked(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Array, Approximation, np.ndarray, np.ndarray, np.ndarray]]:
    """(anchors, block, ids, labels, uids of the block) of each tile; tiles of a block follow one another, so its file is kept."""
    key, block = None, None
    for batch in batches:
        for i in range(len(batch)):
            row = {c: batch.column(c)[i] for c in batch.schema.names}
            dim, number = row["dim"].as_py(), row["block"].as_py()
            if (dim, number) != key:
                n, tables = len(row["id"].values), [np.frombuffer(row[c].as_buffer(), np.int64).reshape(-1, CELLS) for c in ("low", "high")]
                block = Approximation(_matrix(row["vector"].values, dim), np.frombuffer(row["codes"].as_buffer(), np.uint8).reshape(-1, n), *tables)
                key, ids, labels = (dim, number), row["id"].values.to_numpy(), row["label"].values.to_numpy()
            yield row["anchors"].values, block, ids, labels, (number << 32) + np.arange(len(ids))


def _each_anchor(anchors: pa.Array, dim: int) -> Iterator[tuple[int, int, int, np.ndarray]]:
    vectors = _matrix(anchors.field("vector"), dim).astype(np.int64)
    yield from zip(*(anchors.field(c).to_pylist() for c in ("uid", "id", "label")), vectors, strict=True)


def _table(rows: list[tuple], names: list[str]) -> pa.RecordBatch:
    columns = zip(*rows, strict=True) if rows else [[] for _ in names]
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names)


POSITIVES = ["dim", "uid", "positive_id", "positive_score"]
FOUND = ["dim", "uid", "anchor_id", "place", "positive_id", "positive_score", "negative_id", "negative_score"]


def _positives(k: int):
    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for anchors, block, ids, labels, uids in _walked(batches):
            dim, out = block.vectors.shape[1], []
            for uid, _, label, vector in _each_anchor(anchors, dim):
                at, scores, _ = best_positives(block, block.bounds(vector), vector, (labels == label) & (uids != uid), ids, k)
                out += [(dim, uid, int(i), int(s)) for i, s in zip(ids[at], scores, strict=True)]
            yield _table(out, POSITIVES)

    return walk


def _negatives(k: int, low: int, high: int):
    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for anchors, block, ids, labels, _ in _walked(batches):
            dim, out = block.vectors.shape[1], []
            of = anchors.field("positives").to_pylist()
            for (uid, anchor_id, label, vector), positives in zip(_each_anchor(anchors, dim), of, strict=True):
                windows = [window_of(p["positive_score"], low, high) for p in positives]
                found, _ = best_negatives(block, block.bounds(vector), vector, labels != label, ids, windows, k)
                for p, (at, scores) in zip(positives, found, strict=True):
                    out += [(dim, uid, anchor_id, p["place"], p["positive_id"], p["positive_score"], int(i), int(s)) for i, s in zip(ids[at], scores, strict=True)]
            yield _table(out, FOUND)

    return walk


def _longs(names: list[str]) -> str:
    return ", ".join(f"{c} long" for c in names)


def mine(rows: DataFrame, anchors: Column, id_col: str = "vec_id", label_col: str = "label", vector_col: str = "embedding", positives: int = 5, negatives: int = 10, low: int = 30, high: int = 90) -> DataFrame:
    """Rows (anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    anchors tells which rows are such. An anchor's positives are the first `positives` other rows of its label, by score; of
    each the first `negatives` rows of other labels are returned whose score lies between low and high percent of the positive's.
    """
    spark = rows.sparkSession
    small_batches(spark)
    files = stored(approximation_files(whole_vectors(rows, anchors, id_col, label_col, vector_col), rows.count()), "vector-approximations")
    zipped = F.arrays_zip("anchor", "id", "label", "vector")
    chosen = files.select("dim", "block", F.posexplode(zipped).alias("at", "row")).where("row.anchor")
    uid = F.shiftleft(F.col("block").cast("long"), 32) + F.col("at")
    chosen = stored(chosen.select(F.col("dim"), uid.alias("uid"), "row.id", "row.label", "row.vector"), "anchors")
    first = _tiles(chosen, files).mapInArrow(_positives(positives), _longs(POSITIVES))
    nearest = Window.partitionBy("dim", "uid").orderBy(F.desc("positive_score"), "positive_id")
    ranked = first.withColumn("place", F.row_number().over(nearest)).where(F.col("place") <= positives)
    told = ranked.groupBy("dim", "uid").agg(F.collect_list(F.struct("place", "positive_id", "positive_score")).alias("positives"))
    with_positives = stored(chosen.join(told, ["dim", "uid"]), "anchors-with-positives")
    found = _tiles(with_positives, files).mapInArrow(_negatives(negatives, low, high), _longs(FOUND))
    hardest = Window.partitionBy("dim", "uid", "place").orderBy(F.desc("negative_score"), "negative_id")
    best = found.withColumn("rank", F.row_number().over(hardest)).where(F.col("rank") <= negatives)
    return best.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
