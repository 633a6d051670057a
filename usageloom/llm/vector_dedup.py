"""Near-duplicate vectors by hierarchical navigable small-world graphs, one for each shard.

Equal vectors are collapsed first. The distinct ones are dealt to shards by hash; each shard's graph is built by one task
and written as a file to the shared folder. All vectors then search every shard: many queries walk a graph in step, so
that each hop is one array operation. Before that, recall is audited against brute force in all shards, with two kinds of
queries: a sample of the vectors, their own rows left out, and near copies of each shard's rows that are made for the
audit, so that there is evidence where the table has no links. The beam is the least that finds RECALL of the links of
both kinds. A query whose whole beam links, so that more may, is compared with the whole shard. Links are verified by
cosine in double precision.

A shard's vectors search their own shard first, which gives its components. Then parts of its vectors search the other
shards, some of which a task takes, and loads one after the other: there a link counts for its query, but as an edge only the two components that
it joins go on, each pair once. So what leaves the tasks is a forest of each shard, and few edges between shards even
where a group of near copies is in all of them.

Defined cases: vectors that are null, zero, or hold null or non-finite components link with nothing and are kept; vectors
of different lengths never link, and a vector of any length is compared whole; equal vectors link with each other; rows
with a null id take part but never name a component; rows that repeat an id each count. An empty table gives an empty
result. Columns other than the two named are ignored.
"""

import hashlib
import io
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from usageloom.llm.components import least_labels, linked_classes
from usageloom.llm.shared import col, scratch, stored
from usageloom.llm.warc import _filesystem

THRESHOLD = 0.9
#: Shards have about SHARD_BYTES of vectors (65,536 at 64 dimensions), and there are LEAST_SHARDS at least; a task's
#: queries have as many at most, and search SHARDS_A_TASK; what is compared by brute force at once gives MATRIX_BYTES of cosines.
LEAST_SHARDS, SHARD_BYTES, SHARDS_A_TASK, MATRIX_BYTES = 6, 32 << 20, 64, 32 << 20
LINKS, BASE_LINKS, BUILD_BEAM, BEAM = 12, 24, 48, 48
#: The beam doubles up to WIDEST until its recall of the audited links is RECALL; brute force takes over if none has it.
RECALL, WIDEST = 0.99, 384
#: Vectors, of the whole table, that are audited in every shard, and copies made of each shard's rows; their cosines begin at
#: the threshold and end at most NEAREST above it. Queries with links that a shard's graph walks for an audit.
AUDITED, COPIES, NEAREST, WALKED = 1024, 256, 0.05, 1024
STEP_QUERIES, EXPANDED = 512, 4


def _best(sims: np.ndarray, ids: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The n best columns of each row, best first."""
    n = min(n, sims.shape[1])
    top = np.argpartition(-sims, n - 1, axis=1)[:, :n] if n < sims.shape[1] else np.tile(np.arange(n), (len(sims), 1))
    order = np.argsort(-np.take_along_axis(sims, top, 1), axis=1, kind="stable")
    top = np.take_along_axis(top, order, 1)
    return np.take_along_axis(sims, top, 1), np.take_along_axis(ids, top, 1)


def walk(x: np.ndarray, links: np.ndarray, queries: np.ndarray, starts: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
    """(similarities, rows), best first, of each query's beam in one layer; links hold -1 where there is none."""
    n = len(queries)
    rows = np.full((n, beam), -1, np.int64)
    sims = np.full((n, beam), -np.inf, np.float32)
    rows[:, 0], sims[:, 0] = starts, np.einsum("qd,qd->q", queries, x[starts])
    done = np.zeros((n, beam), bool)
    seen = np.zeros((n, len(x)), bool)
    seen[np.arange(n), starts] = True
    active = np.arange(n)
    while len(active):
        open_ = np.where(done[active] | (rows[active] < 0), -np.inf, sims[active])
        at = np.argpartition(-open_, min(EXPANDED, beam) - 1, axis=1)[:, :EXPANDED]
        fresh = np.isfinite(np.take_along_axis(open_, at, 1))
        going = fresh.any(axis=1)
        active, at, fresh = active[going], at[going], fresh[going]
        if not len(active):
            break
        done[active[:, None], at] |= fresh
        near = np.where(fresh[:, :, None], links[np.take_along_axis(rows[active], at, 1)], -1).reshape(len(active), -1)
        near.sort(axis=1)
        new = near >= 0
        new[:, 1:] &= near[:, 1:] != near[:, :-1]
        new &= ~seen[active[:, None], near]
        who, place = np.nonzero(new)
        targets = near[who, place]
        seen[active[who], targets] = True
        got = np.full(near.shape, -np.inf, np.float32)
        got[who, place] = np.einsum("qd,qd->q", queries[active[who]], x[targets])
        both_s = np.concatenate([sims[active], got], axis=1)
        both_r = np.concatenate([rows[active], np.where(new, near, -1)], axis=1)
        both_d = np.concatenate([done[active], np.zeros(near.shape, bool)], axis=1)
        top = np.argpartition(-both_s, beam - 1, axis=1)[:, :beam]
        sims[active], rows[active], done[active] = (np.take_along_axis(a, top, 1) for a in (both_s, both_r, both_d))
    order = np.argsort(-sims, axis=1, kind="stable")
    return np.take_along_axis(sims, order, 1), np.take_along_axis(rows, order, 1)


def _diverse(x: np.ndarray, sims: np.ndarray, rows: np.ndarray, n: int) -> np.ndarray:
    """Of each row's candidates (best first, -1 for none) up to n, each nearer to the row than to any chosen before it."""
    found = x[np.maximum(rows, 0)]
    between = np.matmul(found, found.transpose(0, 2, 1))
    chosen = np.zeros(rows.shape, bool)
    for c in range(rows.shape[1]):
        clear = ~(chosen[:, :c] & (between[:, c, :c] >= sims[:, c : c + 1])).any(axis=1)
        chosen[:, c] = (rows[:, c] >= 0) & clear & (chosen.sum(axis=1) < n)
    # Free places go to the nearest of the rest.
    rank = np.argsort(np.where(chosen, 0, np.where(rows >= 0, 1, 2)), axis=1, kind="stable")
    return np.take_along_axis(rows, rank, 1)[:, :n]


def _padded(rows: np.ndarray, n: int) -> np.ndarray:
    return np.concatenate([rows, np.full((len(rows), n - rows.shape[1]), -1, rows.dtype)], axis=1) if rows.shape[1] < n else rows


class Graph:
    """Layers over unit vectors in single precision; layer 0 has all rows, each higher one about a LINKS-th of those below."""

    def __init__(self, x: np.ndarray):
        self.x = np.ascontiguousarray(x, np.float32)
        level = np.random.default_rng(len(x)).geometric(1 - 1 / LINKS, len(x)) - 1
        self.members = [np.flatnonzero(level >= i) for i in range(int(level.max(initial=0)) + 1)]
        self.links = [self._layer(self.x[m], BASE_LINKS if i == 0 else LINKS) for i, m in enumerate(self.members)]

    @staticmethod
    def _layer(x: np.ndarray, n_links: int) -> np.ndarray:
        """Batches that double: each walks the graph so far, and looks at its own rows by brute force."""
        links, have = np.full((len(x), n_links), -1, np.int64), 0
        while have < len(x):
            size = min(len(x) - have, max(64, min(have, STEP_QUERIES)))
            new = np.arange(have, have + size)
            own = x[new] @ x[new].T
            np.fill_diagonal(own, -np.inf)
            sims, rows = _best(own, np.tile(new, (size, 1)), BUILD_BEAM)
            if have:
                s, r = walk(x, links[:, :], x[new], np.zeros(size, np.int64), BUILD_BEAM)
                sims, rows = _best(np.concatenate([sims, s], axis=1), np.concatenate([rows, r], axis=1), BUILD_BEAM)
            rows = np.where(np.isfinite(sims), rows, -1)
            links[new] = _padded(_diverse(x, sims, rows, n_links), n_links)
            # The links back: a target's old and new links are chosen from anew.
            to = links[new].ravel()
            back, to = np.repeat(new, n_links)[to >= 0], to[to >= 0]
            order = np.argsort(to, kind="stable")
            to, back = to[order], back[order]
            targets, first, counts = np.unique(to, return_index=True, return_counts=True)
            place = np.arange(len(to)) - np.repeat(first, counts)
            wide = np.full((len(targets), n_links + min(int(counts.max(initial=1)), 2 * n_links)), -1, np.int64)
            wide[:, :n_links] = links[targets]
            fits = place < wide.shape[1] - n_links
            wide[np.repeat(np.arange(len(targets)), counts)[fits], n_links + place[fits]] = back[fits]
            wide.sort(axis=1)
            wide[:, 1:][wide[:, 1:] == wide[:, :-1]] = -1
            near = np.where(wide >= 0, np.einsum("td,tcd->tc", x[targets], x[np.maximum(wide, 0)]), -np.inf)
            near, wide = _best(near, wide, wide.shape[1])
            links[targets] = _padded(_diverse(x, near, wide, n_links), n_links)
            have += size
        return links

    def search(self, queries: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
        queries = np.ascontiguousarray(queries, np.float32)
        starts = np.zeros(len(queries), np.int64)
        for i in range(len(self.members) - 1, -1, -1):
            sims, rows = walk(self.x[self.members[i]], self.links[i], queries, starts, beam if i == 0 else 4)
            if i:
                starts = np.searchsorted(self.members[i - 1], self.members[i][rows[:, 0]])
        return sims, rows

    def dump(self, **more: np.ndarray) -> bytes:
        out = io.BytesIO()
        np.savez(out, n=len(self.links), **{f"m{i}": m for i, m in enumerate(self.members)}, **{f"l{i}": x.astype(np.int32) for i, x in enumerate(self.links)}, **more)
        return out.getvalue()

    @classmethod
    def load(cls, found: dict, x: np.ndarray) -> "Graph":
        graph = cls.__new__(cls)
        graph.x, n = np.ascontiguousarray(x, np.float32), int(found["n"])
        graph.members, graph.links = [found[f"m{i}"] for i in range(n)], [found[f"l{i}"].astype(np.int64) for i in range(n)]
        return graph


def beams() -> list[int]:
    return [BEAM << i for i in range((WIDEST // BEAM).bit_length())]


def _walked(graph: Graph, units: np.ndarray, q: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, row) of the links found, and the queries of which the beam may have left links out as it links to its end."""
    sims, rows = graph.search(q, beam)
    who, at = np.nonzero(sims >= THRESHOLD - 1e-4)
    row = rows[who, at]
    exact = np.einsum("qd,qd->q", q[who], units[row]) >= THRESHOLD
    return who[exact], row[exact], np.flatnonzero(sims[:, -1] >= THRESHOLD - 1e-4)


def _matrix_rows(units: np.ndarray) -> int:
    return max(1, MATRIX_BYTES // (8 * max(len(units), 1)))


def audit(graph: Graph, units: np.ndarray, queries: np.ndarray, own: np.ndarray) -> list[tuple[int, int, int]]:
    """For each beam (beam, true links, those found) of the queries that the beam decides; their own rows don't count.

    Queries that are compared with the whole shard anyway are no evidence for the graph, and neither are those without links.
    """
    linked, truth = [], []
    step = _matrix_rows(units)
    for start in range(0, len(queries), step):
        q, at = queries[start : start + step], own[start : start + step]
        true = q @ units.T >= THRESHOLD
        true[np.flatnonzero(at >= 0), at[at >= 0]] = False
        some = np.flatnonzero(true.any(axis=1))[: WALKED - len(linked)]
        linked += (some + start).tolist()
        truth += [np.flatnonzero(true[i]) for i in some]
        if len(linked) == WALKED:
            break
    out = []
    for beam in (b for b in beams() if b < len(units)):
        seen = found = 0
        for start in range(0, len(linked), STEP_QUERIES):
            mine = linked[start : start + STEP_QUERIES]
            who, row, rest = _walked(graph, units, queries[mine], beam)
            for i in np.setdiff1d(np.arange(len(mine)), rest):
                true = truth[start + i]
                seen += len(true)
                found += int(np.isin(true, row[who == i]).sum())
        out.append((beam, seen, found))
    return out


def near_copies(units: np.ndarray) -> np.ndarray:
    """Unit vectors that are just near enough to rows of a shard, in directions of their own."""
    rng = np.random.default_rng(len(units))
    rows = units[rng.permutation(len(units))[:COPIES]]
    away = rng.normal(size=rows.shape)
    away -= (away * rows).sum(axis=1, keepdims=True) * rows
    size = np.sqrt((away * away).sum(axis=1, keepdims=True))
    cosine = np.where(size > 1e-9, THRESHOLD + NEAREST * rng.random((len(rows), 1)), 1.0)
    return cosine * rows + np.sqrt(1 - cosine * cosine) * away / np.maximum(size, 1e-9)


def decided(audits: dict[tuple[int, str], tuple[int, int]]) -> int:
    """The least beam that has the recall with each kind of queries; 0, for brute force, if none has it."""
    missed = {beam for (beam, _), (seen, found) in audits.items() if found < RECALL * seen}
    return min({beam for beam, _ in audits} - missed, default=0)


def links_in_shard(graph: Graph, units: np.ndarray, queries: np.ndarray, own: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
    """(query, row) of the links found; units are the shard's vectors in double precision, own a query's row there or -1.

    A beam of 0, or one of the shard's size, stands for brute force.
    """
    found_q, found_r = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for start in range(0, len(queries), STEP_QUERIES):
        q = queries[start : start + STEP_QUERIES]
        if 0 < beam < len(units):
            who, row, rest = _walked(graph, units, q, beam)
        else:
            who, row, rest = np.zeros(0, np.int64), np.zeros(0, np.int64), np.arange(len(q))
        open_ = ~np.isin(who, rest)
        found_q.append(who[open_] + start)
        found_r.append(row[open_])
        step = _matrix_rows(units)
        for part in (rest[i : i + step] for i in range(0, len(rest), step)):
            more_q, more_r = np.nonzero(q[part] @ units.T >= THRESHOLD)
            found_q.append(part[more_q] + start)
            found_r.append(more_r)
    who, row = np.concatenate(found_q), np.concatenate(found_r)
    other = own[who] != row
    return who[other], row[other]


def _valid(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (id, digest, vector): unit vectors as bytes of doubles, and a hash of them; null for those that never link."""
    for batch in batches:
        vectors, digests = [], []
        for v in batch.column("vector"):
            values = np.array(v.as_py() if v.is_valid else [], float)  # a null component becomes not-a-number
            ok = len(values) and np.isfinite(values).all() and np.abs(values).max() > 0
            raw = (values + 0.0).tobytes() if ok else None
            if ok:
                values = values / np.abs(values).max()
                vectors.append((values / np.sqrt((values * values).sum())).tobytes())
            else:
                vectors.append(None)
            digests.append(hashlib.blake2b(raw, digest_size=16).digest() if ok else None)
        yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(digests, pa.binary()), pa.array(vectors, pa.binary())], ["id", "digest", "vector"])


def _builder(folder: str):
    def build(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(list(batches))
        order = np.argsort(np.array(table.column("digest").to_pylist(), object), kind="stable")
        digests = [table.column("digest")[int(i)].as_py() for i in order]
        units = np.frombuffer(b"".join(table.column("vector")[int(i)].as_py() for i in order)).reshape(len(order), -1)
        copies = table.column("copies").to_numpy()[order]
        fs, path = _filesystem(folder)
        fs.create_dir(path, recursive=True)
        name = f"{uuid.uuid4().hex}.npz"
        with fs.open_output_stream(f"{path}/{name}", compression=None) as f:
            f.write(Graph(units).dump(units=units, copies=copies, digests=np.frombuffer(b"".join(digests), np.uint8)))
        yield pa.RecordBatch.from_arrays([pa.array([units.shape[1]], pa.int32()), pa.array([f"{folder}/{name}"]), pa.array([len(units)], pa.int64())], ["size", "file", "n"])

    return build


def _edges(rows: list[tuple[bytes, bytes, int]]) -> pa.RecordBatch:
    kinds = [pa.binary(), pa.binary(), pa.int64()]
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds)], ["a", "b", "n"])


def _opened(file: str) -> tuple[dict, list[bytes]]:
    fs, path = _filesystem(file)
    with fs.open_input_file(path) as f:
        found = dict(np.load(io.BytesIO(f.read())))
    return found, [x.tobytes() for x in found["digests"].reshape(-1, 16)]


def _auditor(sample):
    """For each shard (a row with its file) the audits of the queries in `sample`, a broadcast dictionary by size, and of copies of its rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for size, file in zip(batch.column("size").to_pylist(), batch.column("file").to_pylist(), strict=True):
                found, theirs = _opened(file)
                units, place, rows = found["units"], {d: i for i, d in enumerate(theirs)}, sample.value[size]
                graph, copies = Graph.load(found, units), near_copies(units)
                queries = np.frombuffer(b"".join(v for _, v in rows)).reshape(-1, size)
                own = np.array([place.get(d, -1) for d, _ in rows])
                audits = [(size, "own", *x) for x in audit(graph, units, queries, own)]
                audits += [(size, "copies", *x) for x in audit(graph, units, copies, np.full(len(copies), -1))]
                kinds = [pa.int32(), pa.string(), pa.int64(), pa.int64(), pa.int64()]
                yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in audits], kind) for i, kind in enumerate(kinds)], ["size", "kind", "beam", "seen", "found"])

    return run


def beam_of_each_size(distinct: DataFrame, files: DataFrame) -> dict[int, int]:
    """The beam for each length of vectors, from audits that are pooled over all shards."""
    spark, size = distinct.sparkSession, (F.octet_length("vector") / 8).cast("int")
    sample: dict[int, list] = {}
    ranked = distinct.select(size.alias("size"), "digest", "vector").withColumn("rank", F.row_number().over(Window.partitionBy("size").orderBy(F.xxhash64("digest"), "digest")))
    for r in ranked.where(F.col("rank") <= AUDITED).toLocalIterator():
        sample.setdefault(r["size"], []).append((bytes(r["digest"]), bytes(r["vector"])))
    cast = spark.sparkContext.broadcast(sample)  # AUDITED vectors of each length
    todo = files.repartitionByRange(max(1, files.count()), "file")
    pooled = todo.mapInArrow(_auditor(cast), "size int, kind string, beam long, seen long, found long").groupBy("size", "beam", "kind").agg(F.sum("seen"), F.sum("found")).collect()
    return {size: decided({(r["beam"], r["kind"]): (r[3], r[4]) for r in pooled if r["size"] == size}) for size in sample}


def _own_links(beam: dict[int, int]):
    """For each shard (a row with its file): a forest of the links in it and their numbers; its components are written beside it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for size, file in zip(batch.column("size").to_pylist(), batch.column("file").to_pylist(), strict=True):
                found, names = _opened(file)
                units, copies = found["units"], found["copies"]
                who, row = links_in_shard(Graph.load(found, units), units, units, np.arange(len(units)), beam[size])
                label, n = least_labels(len(units), who, row), np.bincount(who, weights=copies[row], minlength=len(units)).astype(np.int64)
                fs, path = _filesystem(file)
                with fs.open_output_stream(f"{path}.labels", compression=None) as f:
                    f.write(label.astype(np.int32).tobytes())
                linked = np.union1d(who, row)
                yield _edges([(names[x], names[label[x]], int(n[x])) for x in linked])

    return run


def _labels(file: str) -> np.ndarray:
    fs, path = _filesystem(f"{file}.labels")
    with fs.open_input_file(path) as f:
        return np.frombuffer(f.read(), np.int32)


def _cross_links(beam: dict[int, int]):
    """For each part (file, first, stop) of a shard: its components' edges to those of `others`, a list of shards, and its vectors' links there."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in batch.to_pylist():
                mine, names = _opened(part["file"])
                at = slice(part["first"], part["stop"])
                queries, own = mine["units"][at], _labels(part["file"])[at]
                n, none = np.zeros(len(queries), np.int64), np.full(len(queries), -1)
                for file in part["others"]:
                    if file == part["file"]:
                        continue
                    found, theirs = _opened(file)
                    who, row = links_in_shard(Graph.load(found, found["units"]), found["units"], queries, none, beam[part["size"]])
                    n += np.bincount(who, weights=found["copies"][row], minlength=len(n)).astype(np.int64)
                    pairs = np.unique(np.stack([own[who], _labels(file)[row]], axis=1), axis=0) if len(who) else np.zeros((0, 2), int)
                    yield _edges([(names[a], theirs[b], 0) for a, b in pairs.tolist()])
                yield _edges([(names[part["first"] + i], names[part["first"] + i], int(n[i])) for i in np.flatnonzero(n)])

    return run


def near_vectors(table: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """Rows (id, n_links, component_id, kept), one for each row of the table."""
    spark = table.sparkSession
    id_type = table.schema[id_col].dataType.simpleString()
    raw = table.select(col(id_col).alias("id"), col(vector_col).cast("array<double>").alias("vector"))
    vectors = stored(raw.mapInArrow(_valid, f"id {id_type}, digest binary, vector binary"), "vectors")
    known = vectors.where("digest is not null")
    distinct = stored(known.groupBy("digest").agg(F.count(F.lit(1)).alias("copies"), F.min("id").alias("id"), F.first("vector").alias("vector")), "distinct-vectors")
    n_bytes = distinct.agg(F.sum(F.octet_length("vector"))).first()[0] or 0
    n_shards = max(LEAST_SHARDS, -(-n_bytes // SHARD_BYTES))
    dealt = distinct.withColumn("shard", F.pmod(F.xxhash64("digest"), F.lit(n_shards))).withColumn("size", F.octet_length("vector"))
    folder = scratch(spark, "graphs")
    built = dealt.groupBy("size", "shard").applyInArrow(_builder(folder), "size int, file string, n long")
    files = stored(built, "graph-files")
    n_files = max(1, files.count())
    beam = beam_of_each_size(distinct, files)
    own = stored(files.repartitionByRange(n_files, "file").mapInArrow(_own_links(beam), "a binary, b binary, n bigint"), "own-links")
    # Parts are whole shards, or so many that all tasks have some.
    spread = -(-4 * spark.sparkContext.defaultParallelism // n_files)
    rows = F.ceil(F.col("n") / spread).cast("long")
    firsts = files.withColumn("rows", F.greatest(rows, F.lit(1))).withColumn("first", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1, F.col("rows"))))
    # Every shard is one of some that a task takes; only names are joined here.
    group = F.pmod(F.xxhash64("file"), F.lit(-(-n_files // SHARDS_A_TASK))).alias("group")
    groups = files.groupBy("size", group).agg(F.array_sort(F.collect_list("file")).alias("others"))
    parts = firsts.select("size", "file", "first", F.least(F.col("first") + F.col("rows"), "n").alias("stop")).join(groups, "size")
    parts = stored(parts, "vector-parts")
    n_parts = max(1, parts.count())
    cross = parts.repartitionByRange(n_parts, "group", "file", "first").mapInArrow(_cross_links(beam), "a binary, b binary, n bigint")
    links = own.unionByName(stored(cross, "cross-links"))
    found = linked_classes(vectors.select("id", "digest"), distinct.select("digest", "id", "copies"), links)
    return found.select(F.col("id").alias(id_col), "n_links", F.col("class_id").alias("component_id"), F.col("id").eqNullSafe(F.col("class_id")).alias("kept"))
