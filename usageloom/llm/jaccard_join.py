"""Jaccard self-join of documents on their sets of word 5-grams, by chosen paths.

Every document is mapped to COORDINATES minimum hashes of its 5-gram set. Those with which the runs begin are kept whole, and
of all of them two bytes each, the sketch. A run splits the distinct sets by a sampled coordinate: those that share its token go on together. Buckets of up to SMALL sets are compared by brute force; larger
ones are split again by the next sampled coordinate, down to DEPTH. Two sets of similarity s share a bucket of depth d
with probability s^d; no two runs share a coordinate, so RUNS runs reach the target recall even for pairs at the threshold in the
deepest buckets, with what the sketches lose counted in (found_probability). A bucket that is still large is compared whole, in blocks.

Brute force in a bucket compares the sketches, and hands on a spanning forest of its candidates.
The candidates' components are then verified with the exact sets, in groups (large components in blocks, each pair in one
group only): that gives the number of links and the forest of the exact links, without pairs as rows.

The recall is also measured, on the links that were verified: of the times that a run's full path meets a link, the share
of links that another run's path meets, too. That is what all runs but one find of what one finds by itself. While it is
under TARGET_RECALL, MORE_RUNS further runs are made; when all coordinates are used up, others are drawn, with sketches of their
own, so runs end when the recall is there, and not before. It leans to the better, as links that are found at all are
rather the more similar ones.

Words are the lower-cased text's runs without white space; a text with one to four words has one gram, of all its words.
Defined cases: a null, empty or blank text has no grams, links with nothing and is a class of its own; equal sets are one
class whatever their number, and count in each other's links; a text of any length is one set of all its grams, which is
held by the tasks that verify it; rows with a null id take part, but never name a class; rows that repeat an id each
count, with their own texts. An empty table gives an empty result. near_duplicates ignores columns other than the two
named; keep_one_of_each keeps all columns, whatever their names.
"""

import hashlib
import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from fractions import Fraction
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from usageloom.llm.components import components, least_labels, linked_classes
from usageloom.llm.shared import col, shared_dir, stored

GRAM = 5
THRESHOLD = Fraction(4, 5)
#: A sketch holds a token of 16 bits for each coordinate.
COORDINATES, TOKENS = 128, 1 << 16
DEPTH, SMALL = 5, 64
TARGET_RECALL = 0.998
#: A pair goes on if its estimated similarity is over the threshold less MARGIN (nearly four standard errors).
MARGIN = 0.13
#: Rows of a large bucket, and sets or grams of a large component, that meet in one group.
BLOCK_ROWS, BLOCK_SETS, BLOCK_GRAMS = 1024, 2048, 2_000_000
#: Rows that may be broadcast (some 16 MB at 400 bytes in memory); more are joined by a shuffle.
BROADCAST_ROWS = 40_000
#: Bytes that one task compares or verifies.
TASK_BYTES = 64 << 20
#: Links of a group on which the recall is measured, at most.
MEASURED = 4096


def found_probability(similarity: float, runs: int) -> float:
    """With which a pair becomes a candidate if all its buckets are DEPTH deep: a run's whole path agrees, and so do enough tokens of the sketch.

    Exact for paths without a common coordinate. The polynomials hold the probability of each number of equal tokens.
    """
    chance = (1 - similarity) / TOKENS
    one = np.array([1 - similarity - chance, similarity + chance])
    path = _power(one, DEPTH)
    path[DEPTH] -= similarity**DEPTH
    missed = np.convolve(_power(path, runs), _power(one, COORDINATES - DEPTH * runs))
    return float((_power(one, COORDINATES) - missed)[math.ceil(LEAST_SAME) :].sum())


def _power(polynomial: np.ndarray, n: int) -> np.ndarray:
    out = np.ones(1)
    for _ in range(n):
        out = np.convolve(out, polynomial)
    return out


#: Tokens of the sketch that must be equal.
LEAST_SAME = (float(THRESHOLD) - MARGIN) * COORDINATES
#: The least number of runs that finds pairs at the threshold with TARGET_RECALL, the sketch's loss included.
MOST_RUNS, MORE_RUNS = COORDINATES // DEPTH, 3
RUNS = next(n for n in range(1, MOST_RUNS + 1) if found_probability(float(THRESHOLD), n) >= TARGET_RECALL)


@dataclass(frozen=True)
class Draw:
    """The hash functions of COORDINATES coordinates, and the runs' paths: each has coordinates of its own, so that runs fail independently."""

    number: int

    @cached_property
    def _drawn(self) -> tuple[np.ndarray, np.ndarray]:
        rng = np.random.default_rng(20 + self.number)
        factors = rng.integers(1, 1 << 63, COORDINATES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        return factors, rng.permutation(COORDINATES)[: MOST_RUNS * DEPTH].reshape(MOST_RUNS, DEPTH)

    @property
    def factors(self) -> np.ndarray:
        return self._drawn[0]

    @property
    def paths(self) -> np.ndarray:
        return self._drawn[1]


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)


def gram_sets(texts: pa.Array) -> list[np.ndarray]:
    """For each text the sorted distinct 64-bit hashes of its word 5-grams."""
    trimmed = pc.utf8_trim_whitespace(pc.utf8_lower(texts.fill_null("")))
    words = pc.utf8_split_whitespace(trimmed)
    coded = words.flatten().dictionary_encode()
    names = np.array([xxhash.xxh64_intdigest(w.as_buffer()) for w in coded.dictionary], np.uint64)
    h = _mixed(names)[coded.indices.to_numpy()] if len(coded) else np.zeros(0, np.uint64)
    rolled = h.copy()
    for i in range(1, GRAM):
        rolled[: len(h) - i] = _mixed(rolled[: len(h) - i]) + h[i:]
    rolled = _mixed(rolled)
    offsets = words.offsets.to_numpy() - words.offsets[0].as_py()
    some = pc.greater(pc.binary_length(trimmed), 0).to_numpy(zero_copy_only=False)
    out = []
    for i, (a, b) in enumerate(zip(offsets, offsets[1:], strict=False)):
        if not some[i]:
            out.append(np.zeros(0, np.uint64))
        elif b - a < GRAM:
            whole = np.array([b - a], np.uint64)
            for j in range(a, b):
                whole = _mixed(whole) + h[j : j + 1]
            out.append(whole)
        else:
            out.append(np.unique(rolled[a : b - GRAM + 1]))
    return out


def set_digest(grams: np.ndarray) -> bytes:
    return hashlib.blake2b(grams.tobytes(), digest_size=16).digest()


def minima(grams: np.ndarray, factors: np.ndarray) -> np.ndarray:
    """The least hash of the set under each coordinate's function."""
    least = np.full(COORDINATES, np.iinfo(np.uint64).max, np.uint64)
    for i in range(0, len(grams), 4096):
        part = grams[i : i + 4096]
        for j in range(0, COORDINATES, 16):
            least[j : j + 16] = np.minimum(least[j : j + 16], (factors[j : j + 16, None] * part).min(axis=1))
    return least


SIGNATURE = "row bigint, digest binary, firsts array<bigint>, sketch binary, n_grams bigint"


def _signatures(draw: Draw):
    """Rows (id, row, digest, firsts, sketch, n_grams); firsts are the tokens of the runs' first coordinates."""

    def signatures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in (batch.slice(i, 1024) for i in range(0, batch.num_rows, 1024)):
                sets = gram_sets(part.column("text"))
                tokens = _mixed(np.stack([minima(s, draw.factors) for s in sets]))
                sketches = (tokens >> np.uint64(48)).astype("<u2")
                firsts = pa.FixedSizeListArray.from_arrays(pa.array(tokens[:, draw.paths[:, 0]].ravel().view(np.int64)), len(draw.paths))
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("id"),
                        part.column("row"),
                        pa.array([set_digest(s) if len(s) else None for s in sets], pa.binary()),
                        firsts.cast(pa.list_(pa.int64())),
                        pa.array([x.tobytes() for x in sketches], pa.binary()),
                        pa.array([len(s) for s in sets], pa.int64()),
                    ],
                    ["id", "row", "digest", "firsts", "sketch", "n_grams"],
                )

    return signatures


def _sketches(column: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(column), "<u2").reshape(len(column), -1)


def _groups(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[pa.Table]:
    """Tables of whole groups, from batches that are sorted by the key."""
    kept: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        column = batch.column(key)
        ends = pc.not_equal(column.slice(1), column.slice(0, len(column) - 1)).to_numpy(zero_copy_only=False)
        cut = int(np.flatnonzero(ends)[-1]) + 1 if ends.any() else 0
        if not cut and kept and kept[-1].column(key)[-1] != column[0]:
            yield pa.Table.from_batches(kept)
            kept = []
        if cut:
            yield pa.Table.from_batches([*kept, batch.slice(0, cut)])
            kept = []
        kept.append(batch.slice(cut))
    if kept:
        yield pa.Table.from_batches(kept)


def _forest(digests: list[bytes], i: np.ndarray, j: np.ndarray) -> pa.RecordBatch:
    label = least_labels(len(digests), i, j)
    moved = np.flatnonzero(label != np.arange(len(digests)))
    return pa.RecordBatch.from_arrays([pa.array([digests[x] for x in moved], pa.binary()), pa.array([digests[label[x]] for x in moved], pa.binary())], ["a", "b"])


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A spanning forest of each bucket's pairs whose sketches agree enough."""
    for table in _groups(batches, "bucket"):
        table = table.combine_chunks()
        bucket = table.column("bucket").to_numpy()
        sketches = _sketches(table.column("sketch").to_pylist())
        pairs_i, pairs_j = [], []
        n = len(bucket)
        # Row r with row r + step, for all rows at once, as long as any bucket is so large.
        ends = np.searchsorted(bucket, bucket, side="right") if (bucket[1:] >= bucket[:-1]).all() else None
        if ends is None:
            change = np.append(np.flatnonzero(bucket[1:] != bucket[:-1]) + 1, n)
            ends = change[np.searchsorted(change, np.arange(n), side="right")]
        rows, step = np.arange(n), 1
        while len(rows := rows[rows + step < ends[rows]]):
            for part in np.array_split(rows, len(rows) // 65536 + 1):
                same = (sketches[part] == sketches[part + step]).sum(axis=1)
                hit = part[same >= LEAST_SAME]
                pairs_i.append(hit)
                pairs_j.append(hit + step)
            step += 1
        if pairs_i:
            yield _forest(table.column("digest").to_pylist(), np.concatenate(pairs_i), np.concatenate(pairs_j))


def _bucket(paths: np.ndarray, run: int, depth: int) -> Column:
    """The bucket that a run's path leads to: a hash of the run and of the tokens of its first coordinates, but for the first in 16 bits."""
    return F.xxhash64(F.lit(run), F.get("firsts", F.lit(run)), *[F.substring("sketch", 2 * int(c) + 1, 2) for c in paths[run, 1 : depth + 1]])


def _buckets(sets: DataFrame, runs: range, paths: np.ndarray) -> DataFrame:
    """Rows (bucket, digest, size): for each run the bucket in which a set's splitting ended, if it isn't alone there."""
    live, ended = sets.select("digest", F.explode(F.array(*[F.struct(F.lit(r).alias("run"), _bucket(paths, r, 0).alias("bucket")) for r in runs])).alias("b")), None
    live = live.select("digest", "b.run", "b.bucket")
    for d in range(DEPTH):
        if d:
            # Few sets are in large buckets still; they get their sketches again for the next coordinate.
            deeper = F.get(F.array(*[_bucket(paths, r, d) for r in runs]), F.col("run") - runs.start)
            live = live.join(sets.select("digest", "firsts", "sketch"), "digest").select("digest", "run", deeper.alias("bucket"))
        counts = stored(live.groupBy("bucket").agg(F.count(F.lit(1)).alias("size")).where("size > 1"), "bucket-sizes")
        shared = stored(live.join(counts, "bucket"), "shared-buckets")
        last = d == DEPTH - 1
        small = shared.where(F.lit(last) | (F.col("size") <= SMALL)).select("bucket", "digest", "size")
        ended = small if ended is None else ended.unionByName(small)
        live = shared.where(F.col("size") > SMALL).select("digest", "run")
        if last or live.isEmpty():
            return ended


def _in_blocks(rows: DataFrame, group: str, n_blocks: Column, by: str) -> DataFrame:
    """Rows of the groups of more than one block go to every pair of blocks that has theirs; `unit` replaces the group's name.

    `mine` and `other` are the numbers of the unit's two blocks, `block` is the row's own.
    """
    dealt = rows.withColumn("n_blocks", n_blocks.cast("int")).withColumn("block", F.pmod(F.xxhash64(by), F.col("n_blocks")).cast("int"))
    spread = dealt.withColumn("mate", F.explode(F.expr("sequence(0, n_blocks - 1)")))
    mine, other = F.least("block", "mate"), F.greatest("block", "mate")
    return spread.withColumn("unit", F.xxhash64(group, mine, other)).withColumn("across", F.col("block") != F.col("mate"))


def _inner_counts(sets: list[np.ndarray], sizes: np.ndarray) -> Iterator[tuple[int, int, np.ndarray]]:
    """(first row, first column, intersection sizes) of blocks that hold every pair i < j."""
    if len(sets) <= 24:
        inner = np.zeros((len(sets), len(sets)), np.int64)
        for i in range(len(sets)):
            for j in range(i + 1, len(sets)):
                if min(sizes[i], sizes[j]) * THRESHOLD.denominator >= max(sizes[i], sizes[j]) * THRESHOLD.numerator:
                    inner[i, j] = len(np.intersect1d(sets[i], sets[j], assume_unique=True))
        yield 0, 0, inner
        return
    grams, number, counts = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    renamed = np.where(counts > 1, np.cumsum(counts > 1) - 1, -1)
    number, row = renamed[number], np.repeat(np.arange(len(sets)), sizes)
    row, number = row[number >= 0], number[number >= 0]
    width, size = int((counts > 1).sum()), 256
    starts = np.searchsorted(row, np.arange(0, len(sets) + size, size))
    del grams

    def dense(b: int, lo: int, hi: int) -> np.ndarray:
        out = np.zeros((size, hi - lo), np.float32)
        r, c = row[starts[b] : starts[b + 1]], number[starts[b] : starts[b + 1]]
        inside = (c >= lo) & (c < hi)
        out[r[inside] - b * size, c[inside] - lo] = 1
        return out

    n_blocks = -(-len(sets) // size)
    for a in range(n_blocks):
        for b in range(a, n_blocks):
            inner = np.zeros((size, size), np.float32)
            for lo in range(0, width, 16384):
                hi = min(lo + 16384, width)
                inner += dense(a, lo, hi) @ dense(b, lo, hi).T
            yield a * size, b * size, np.rint(inner).astype(np.int64)


def _met(sketches: np.ndarray, i: np.ndarray, j: np.ndarray, paths: np.ndarray) -> tuple[int, int]:
    """(how often a run's full path meets a link, how often of these another run's does, too), of up to MEASURED links."""
    some = np.linspace(0, len(i) - 1, min(len(i), MEASURED)).astype(np.int64)
    equal = sketches[i[some]] == sketches[j[some]]
    times = sum(equal[:, path].all(axis=1).astype(np.int64) for path in paths)
    return int(np.sum(times)), int(np.sum(times * (times > 1)))


MEMBER = ["digest", "component", "copies", "n_blocks", "sketch"]
VERIFIED = "a binary, b binary, n bigint, met bigint, again bigint"


def _verifier(paths: np.ndarray):
    return lambda batches: _verify(batches, paths)


def _verify(batches: Iterator[pa.RecordBatch], paths: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Rows of VERIFIED for each unit: a spanning forest (a, b) of its exact links, each set's linked documents, and _met's counts."""
    for tables in _groups(batches, "unit"):
        unit = tables.column("unit").to_numpy()
        cuts = np.flatnonzero(np.diff(unit, prepend=unit[0] - 1 if len(unit) else 0))
        for start, end in zip(cuts, [*cuts[1:], len(unit)], strict=True):
            rows = {r["digest"]: r for r in tables.slice(start, end - start).to_pylist()}
            digests = sorted(rows)
            sets = [np.frombuffer(rows[d]["grams"], np.uint64) for d in digests]
            sizes = np.array([len(s) for s in sets])
            copies = np.array([rows[d]["copies"] for d in digests], np.int64)
            block = np.array([rows[d]["block"] for d in digests])
            # In a unit of two blocks only pairs across them count; the others belong to the blocks' own units.
            across = any(rows[d]["across"] for d in digests)
            found_i, found_j = [], []
            for i0, j0, inner in _inner_counts(sets, sizes):
                i, j = np.nonzero(inner)
                common, i, j = inner[i, j], i + i0, j + j0
                union = sizes[i] + sizes[j] - common
                ok = (i < j) & (common * THRESHOLD.denominator >= union * THRESHOLD.numerator)
                if across:
                    ok &= block[i] != block[j]
                found_i.append(i[ok])
                found_j.append(j[ok])
            i, j = np.concatenate(found_i), np.concatenate(found_j)
            n = np.bincount(i, weights=copies[j], minlength=len(sets)) + np.bincount(j, weights=copies[i], minlength=len(sets))
            label = least_labels(len(sets), i, j)
            linked = np.flatnonzero(n)
            counts = np.zeros((2, len(linked)), np.int64)
            if len(linked):
                counts[:, 0] = _met(_sketches([rows[d]["sketch"] for d in digests]), i, j, paths)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([digests[x] for x in linked], pa.binary()),
                    pa.array([digests[label[x]] for x in linked], pa.binary()),
                    pa.array(n[linked].astype(np.int64)),
                    *(pa.array(c) for c in counts),
                ],
                ["a", "b", "n", "met", "again"],
            )


def _exact_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds the sets of grams; rows whose text isn't the one meant (two texts of one hash) go."""
    for batch in batches:
        for part in (batch.slice(i, 1024) for i in range(0, batch.num_rows, 1024)):
            sets = gram_sets(part.column("text"))
            meant = [set_digest(s) == d.as_py() for s, d in zip(sets, part.column("digest"), strict=True)]
            whole = part.drop_columns(["text"]).append_column("grams", pa.array([s.tobytes() for s in sets], pa.binary()))
            yield whole.filter(pa.array(meant))


def _sorted_by(rows: DataFrame, key: str, n_bytes: int, fn: Callable, schema: str) -> DataFrame:
    """fn over whole groups of the key, dealt to tasks of about TASK_BYTES."""
    n = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-n_bytes // TASK_BYTES))
    return rows.repartition(n, key).sortWithinPartitions(key).mapInArrow(fn, schema)


def candidate_edges(sets: DataFrame, runs: range, paths: np.ndarray) -> DataFrame:
    """Rows (a, b) of set digests: a forest that holds the candidates of the runs; sets are distinct rows (digest, firsts, sketch)."""
    buckets = _buckets(sets, runs, paths)
    n_blocks = F.ceil(F.col("size") / BLOCK_ROWS)
    n_rows = buckets.agg(F.sum(n_blocks)).first()[0] or 0
    blocked = _in_blocks(buckets, "bucket", n_blocks, "digest").select(F.col("unit").alias("bucket"), "digest")
    rows = blocked.join(sets.select("digest", "sketch"), "digest")
    return stored(_sorted_by(rows, "bucket", n_rows * (2 * COORDINATES + 24), _compare, "a binary, b binary").distinct(), "candidate-edges")


def exact_links(texts: DataFrame, sets: DataFrame, edges: DataFrame, paths: np.ndarray) -> DataFrame:
    """Rows of VERIFIED from the candidates' components; texts are rows (id, row, text), sets those of near_classes, with the sketches of all draws."""
    candidates = components(edges).select(F.col("node").alias("digest"), "component")
    members = stored(candidates.join(sets.select("digest", "copies", "rep", "n_grams", "sketch"), "digest"), "candidate-sets")
    sums = members.groupBy("component").agg(F.count(F.lit(1)).alias("n"), F.sum("n_grams").alias("grams"))
    n_blocks = F.ceil(F.greatest(F.col("n") / BLOCK_SETS, F.col("grams") / BLOCK_GRAMS))
    sums = stored(sums.select("component", n_blocks.alias("n_blocks")), "component-sizes")
    members = stored(members.join(sums, "component").select("digest", "component", "copies", "rep.id", "rep.row", "n_grams", "n_blocks", "sketch"), "members")
    n_rows, n_bytes = members.agg(F.count(F.lit(1)), F.sum(F.col("n_blocks") * (8 * F.col("n_grams") + 200))).first()
    wanted = members.withColumnsRenamed({"id": "rep_id", "row": "rep_row"})
    wanted = F.broadcast(wanted) if n_rows <= BROADCAST_ROWS else wanted
    meant = texts.join(wanted, F.col("id").eqNullSafe(F.col("rep_id")) & (F.col("row") == F.col("rep_row")))
    exact = meant.select(*MEMBER, "text").mapInArrow(_exact_sets, "digest binary, component binary, copies bigint, n_blocks bigint, sketch binary, grams binary")
    units = _in_blocks(exact, "component", F.col("n_blocks"), "digest").select("unit", "digest", "copies", "block", "across", "sketch", "grams")
    return stored(_sorted_by(units, "unit", n_bytes or 0, _verifier(paths), VERIFIED), "exact-links")


def _drawn_again(texts: DataFrame, sets: DataFrame, draw: Draw) -> DataFrame:
    """The sets with the firsts and sketches of another draw."""
    id_type = texts.schema["id"].dataType.simpleString()
    drawn = texts.mapInArrow(_signatures(draw), f"id {id_type}, {SIGNATURE}").where("digest is not null")
    new = drawn.groupBy("digest").agg(F.first("firsts").alias("firsts"), F.first("sketch").alias("sketch"))
    return stored(sets.drop("firsts", "sketch").join(new, "digest").select(*sets.columns), "sets-drawn-again")


def near_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (id, row, class_id, n_links), one for each row of docs; row is a hash of the text. See near_duplicates."""
    shared_dir(docs.sparkSession)
    id_type = docs.schema[id_col].dataType.simpleString()
    texts = docs.select(col(id_col).alias("id"), F.xxhash64(col(text_col)).alias("row"), col(text_col).alias("text"))
    draw = Draw(0)
    signatures = stored(texts.mapInArrow(_signatures(draw), f"id {id_type}, {SIGNATURE}"), "signatures")
    # The row that stands for a set: the least id, and of those that repeat it one text.
    rep = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "row")).alias("rep")
    same = [F.first(c).alias(c) for c in ("n_grams", "firsts", "sketch")]  # equal for equal sets
    sets = stored(signatures.where("digest is not null").groupBy("digest").agg(F.count(F.lit(1)).alias("copies"), rep, *same), "distinct-sets")
    # now has the sketches of the last draw; every those of all draws, one after the other, which the paths that were gone tell by.
    now, every, gone, runs, edges = sets, sets, np.zeros((0, DEPTH), int), 0, None
    while True:
        if len(gone) >= RUNS:
            links = exact_links(texts, every, edges, gone)
            met, again = links.agg(F.sum("met"), F.sum("again")).first()
            if not met or again >= TARGET_RECALL * met:
                break
        if runs == MOST_RUNS:
            draw, runs = Draw(draw.number + 1), 0
            now = _drawn_again(texts, sets, draw)
            both = every.withColumnRenamed("sketch", "before").join(now.select("digest", "sketch"), "digest")
            every = stored(both.withColumn("sketch", F.concat("before", "sketch")).select(*sets.columns), "all-sketches")
        further = range(runs, min(runs + (RUNS - len(gone) if len(gone) < RUNS else MORE_RUNS), MOST_RUNS))
        found = candidate_edges(now, further, draw.paths)
        edges, runs = found if edges is None else stored(edges.unionByName(found).distinct(), "candidate-edges"), further.stop
        gone = np.concatenate([gone, draw.paths[further.start : further.stop] + COORDINATES * draw.number])
    return linked_classes(signatures.select("id", "row", "digest"), sets.select("digest", "rep.id", "copies"), links)


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (id, class_id, n_links), one for each row of docs.

    class_id is the least id among those that links lead to, the row's own included; n_links counts the other rows whose
    5-gram sets have a Jaccard similarity of THRESHOLD or more with the row's.
    """
    return near_classes(docs, id_col, text_col).select(F.col("id").alias(id_col), "class_id", "n_links")


def keep_one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs without the rows whose class has a smaller id.

    Rows with a null id stay, and so do rows that repeat a kept id; an id that repeats with texts of several classes is
    told by its texts.
    """
    classes = near_classes(docs, id_col, text_col)
    gone = stored(classes.where("id <> class_id").select(F.col("id").alias("gone_id"), F.col("row").alias("gone_row")).distinct(), "near-copies")
    gone = F.broadcast(gone) if gone.count() <= BROADCAST_ROWS else gone
    return docs.join(gone, (col(id_col) == gone["gone_id"]) & (F.xxhash64(col(text_col)) == gone["gone_row"]), "left_anti")
