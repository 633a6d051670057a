"""Toxicity scores from a linear classifier over character n-grams, scaled by naive Bayes log-count ratios.

A text's features are the distinct character n-grams of its lower-cased, blank-padded words, hashed into a fixed number
of slots. Each slot is scaled by the log ratio of its smoothed counts in toxic and other training texts, drawn towards 0
where chance may have made it: a ratio keeps z * z / (z * z + DOUBT * DOUBT) of its size, where z is the difference of the
two shares in standard errors. So a long text's many ordinary n-grams don't drown the few that tell, and no slot is left
out. A logistic regression is fitted on the scaled slots, all of them. The counts, and with them the ratios, are of all
labelled training rows, summed in the executors; only the regression takes a bounded sample (SAMPLE_A_CLASS of each class, by
hash of the id). It is fitted by one task: a row of the sample is a list of slots, or a bit for each where that is shorter,
so whatever the texts' lengths the sample has 200 MB at most (20 MB usually), and only the weights reach the driver. The
shares of the classes come from all labels. Scoring covers every whole text, map-only.

Defined cases: a null or empty text has no features and gets the score of the intercept; rows without a label, or with
a null label or id, aren't learnt from; a document with several labels is toxic if one says so; rows that repeat a labelled
id are each learnt from, with their own texts; with labels of one class only, or none, every score is the toxic share (0
without labels). Repeated rows get equal scores; ties of the sample's order go by the row's features; an empty table gives an
empty result. Extra columns pass, and train reads only the columns named to it.
"""

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

from usageloom.llm.shared import col, fresh, small_batches, stored

SLOT_BITS = 18
SIZES = (3, 4, 5)
#: The sample that is fitted: so many labelled rows of each class at most.
SAMPLE_A_CLASS = 3000
#: Added to each slot's counts.
SMOOTHING = 1.0
#: Standard errors at which half of a log-count ratio is believed.
DOUBT = 4.0
#: Weight of the squared coefficients, and the passes over the sample.
PENALTY, STEPS = 1e-3, 60
HELD_OUT = 5
#: Slots whose counts are summed in one group, and rows of the sample that the fit goes through at once.
CHUNK, FIT_ROWS = 4096, 256
#: Labels of numbered documents that may be broadcast (some 15 MB in memory); more, or ids of any length, are joined by a shuffle.
BROADCAST_IDS = 200_000


def is_held_out(id_col: str) -> Column:
    """Whether the id's CRC-32 is divisible by 5; such rows are never learnt from."""
    return F.coalesce(F.crc32(col(id_col).cast("string")) % HELD_OUT == 0, F.lit(False))


def slots(text: str | None) -> np.ndarray:
    """The slots of all of a text's character n-grams, with repeats."""
    words = (text or "").lower().split()
    if not words:
        return np.zeros(0, np.uint32)
    c = np.frombuffer((" " + " ".join(words) + " ").encode("utf-32-le"), np.uint32)
    h, found = c * np.uint32(0x9E3779B1), []
    for n in range(1, min(max(SIZES), len(c))):
        # h holds the hashes of all runs of n characters; one more each time.
        h = (h[:-1] ^ (h[:-1] >> np.uint32(15))) * np.uint32(0x85EBCA6B) + c[n:]
        if n + 1 in SIZES:
            found.append((h * np.uint32(0xC2B2AE35)) >> np.uint32(32 - SLOT_BITS))
    return np.concatenate(found) if found else np.zeros(0, np.uint32)


#: For each slot the last place in a text where it was seen: told apart without sorting, and used for one text after another.
_last = np.zeros(1 << SLOT_BITS, np.int32)


def features(text: str | None) -> np.ndarray:
    """The distinct slots of a text's character n-grams, in the order of their last places."""
    found = slots(text)
    places = np.arange(len(found), dtype=np.int32)
    _last[found] = places
    return found[_last[found] == places].astype(np.int32)


def packed(found: np.ndarray) -> bytes:
    """A text's slots as 32-bit numbers, or as a bit for each slot: whichever is shorter."""
    if len(found) * 32 < 1 << SLOT_BITS:
        return np.sort(found).tobytes()
    bits = np.zeros(1 << SLOT_BITS, bool)
    bits[found] = True
    return np.packbits(bits).tobytes()


def unpacked(held: bytes) -> np.ndarray:
    """The slots in order; a list of them is always shorter than the bits are."""
    if len(held) == 1 << (SLOT_BITS - 3):
        return np.flatnonzero(np.unpackbits(np.frombuffer(held, np.uint8))).astype(np.int32)
    return np.frombuffer(held, np.int32)


@dataclass(frozen=True)
class Model:
    """Slot weights, with the log-count ratios already multiplied in, and the intercept."""

    weights: np.ndarray
    intercept: float

    def score(self, text: str | None) -> float:
        z = self.intercept + float(self.weights[features(text)].sum())
        return float(1 / (1 + np.exp(-np.clip(z, -500, 500))))


@dataclass(frozen=True)
class Counts:
    """How many toxic and other texts hold each slot, and how many there are."""

    p: np.ndarray
    q: np.ndarray
    n_toxic: int
    n_other: int

    def scales(self) -> np.ndarray:
        """Each slot's log-count ratio, as far as it is believed."""
        p, q, n_toxic, n_other = self.p, self.q, self.n_toxic, self.n_other
        if not n_toxic or not n_other:
            return np.zeros(len(p))
        mean = (p + q) / (n_toxic + n_other)
        error = np.sqrt(mean * (1 - mean) * (1 / n_toxic + 1 / n_other))
        z = (p / n_toxic - q / n_other) / np.maximum(error, 1e-12)
        ratio = np.log((p + SMOOTHING) / (p + SMOOTHING).sum()) - np.log((q + SMOOTHING) / (q + SMOOTHING).sum())
        return ratio * z**2 / (z**2 + DOUBT**2)


@dataclass(frozen=True)
class Sampled:
    """Some rows of the sample: all their slots one after the other, how many each has, and their 0/1 labels."""

    slots: np.ndarray
    sizes: np.ndarray
    toxic: np.ndarray

    @classmethod
    def of(cls, rows: list[np.ndarray], toxic: list[int]) -> "Sampled":
        return cls(np.concatenate([np.zeros(0, np.int32), *rows]), np.array([len(x) for x in rows]), np.array(toxic, float))

    def sums(self, values: np.ndarray) -> np.ndarray:
        """For each row the sum of its slots' values."""
        found, some = np.zeros(len(self.sizes)), self.sizes > 0
        if some.any():
            starts = np.cumsum(self.sizes) - self.sizes
            found[some] = np.add.reduceat(values[self.slots], starts[some])
        return found


def fit(parts: list[Sampled], share: float, ratio: np.ndarray) -> Model:
    """Fit on the sample; share is that of toxic rows among all that are labelled, ratio the slots' scales."""
    n, share = len(ratio), min(max(share, 0.0), 1.0)
    y = np.concatenate([np.zeros(0), *(p.toxic for p in parts)])
    if not len(y) or y.min() == y.max():
        return Model(np.zeros(n), float(np.log(max(share, 1e-9) / max(1 - share, 1e-9))))
    w, b, share_of = np.zeros(n), 0.0, {1: 0.5 / y.sum(), 0: 0.5 / (1 - y).sum()}
    # Adam on the whole sample: deterministic, and sure of its step whatever the slots' scales.
    m, v, mb, vb = np.zeros(n), np.zeros(n), 0.0, 0.0
    for t in range(1, STEPS + 1):
        g, gb, rate = np.zeros(n), 0.0, 0.05 / (1 + t / 40)
        scaled = ratio * w
        for part in parts:
            z = part.sums(scaled) + b
            r = (1 / (1 + np.exp(-np.clip(z, -500, 500))) - part.toxic) * np.where(part.toxic == 1, share_of[1], share_of[0])
            g += np.bincount(part.slots, weights=np.repeat(r, part.sizes), minlength=n)
            gb += r.sum()
        g = PENALTY * w + ratio * g
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        mb, vb = 0.9 * mb + 0.1 * gb, 0.99 * vb + 0.01 * gb * gb
        w -= rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)
        b -= rate * (mb / (1 - 0.9**t)) / (np.sqrt(vb / (1 - 0.99**t)) + 1e-8)
    # The fit weighs both classes alike; half the log odds of the classes' shares goes back in, between balance and prior.
    return Model(w * ratio, float(b + 0.5 * np.log(share / (1 - share)) if 0 < share < 1 else b))


def _counts_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The slot counts of a task's texts, in chunks; the numbers of texts go with each."""
    counts, n = np.zeros((2, 1 << SLOT_BITS), np.uint32), [0, 0]
    for batch in batches:
        for text, toxic in zip(batch.column("text"), batch.column("toxic").to_pylist(), strict=True):
            counts[toxic, features(text.as_py())] += 1
            n[toxic] += 1
    if sum(n):
        parts = counts.reshape(2, -1, CHUNK)
        k = parts.shape[1]
        columns = [pa.array(np.arange(k), pa.int32()), *(pa.array([x.tobytes() for x in parts[y]], pa.binary()) for y in (1, 0)), *(pa.array([n[y]] * k, pa.int64()) for y in (1, 0))]
        yield pa.RecordBatch.from_arrays(columns, ["chunk", "p", "q", "n_toxic", "n_other"])


def _sum_chunk(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The tasks' counts are of 32 bits, their sums of 64."""
    sums, n = np.zeros((2, CHUNK), np.int64), np.zeros(2, np.int64)
    for batch in batches:
        for i, (one, number) in enumerate((("p", "n_toxic"), ("q", "n_other"))):
            for x in batch.column(one):
                sums[i] += np.frombuffer(x.as_py(), np.uint32)
            n[i] += sum(batch.column(number).to_pylist())
    columns = [pa.array([key[0].as_py()], pa.int32()), *(pa.array([x.tobytes()], pa.binary()) for x in sums), *(pa.array([x], pa.int64()) for x in n)]
    yield pa.RecordBatch.from_arrays(columns, ["chunk", "p", "q", "n_toxic", "n_other"])


CHUNKS = "chunk int, p binary, q binary, n_toxic long, n_other long"


def count_slots(rows: DataFrame) -> Counts:
    """Counts of all rows (text, toxic); 4 MB reach the driver, whatever the rows."""
    found = rows.select("text", "toxic").mapInArrow(_counts_of, CHUNKS).groupBy("chunk").applyInArrow(_sum_chunk, CHUNKS).collect()
    counts, n = np.zeros((2, 1 << SLOT_BITS)), (0, 0)
    for r in found:
        at = slice(r["chunk"] * CHUNK, (r["chunk"] + 1) * CHUNK)
        counts[0, at], counts[1, at] = np.frombuffer(r["p"], np.int64), np.frombuffer(r["q"], np.int64)
        n = (r["n_toxic"], r["n_other"])
    return Counts(counts[0], counts[1], *n)


def _coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (order, toxic, slots)."""
    for batch in batches:
        held = [packed(features(t.as_py())) for t in batch.column("text")]
        yield pa.RecordBatch.from_arrays([batch.column("order"), batch.column("toxic"), pa.array(held, pa.binary())], ["order", "toxic", "slots"])


def _fitted(ratio, share: float):
    """The one task that gets the sample, in order; a row (weights, intercept). ratio is a broadcast array."""

    def fitted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Put together a few rows at a time, so that the sample is held once.
        parts = []
        for batch in batches:
            for some in (batch.slice(i, FIT_ROWS) for i in range(0, len(batch), FIT_ROWS)):
                parts.append(Sampled.of([unpacked(x.as_py()) for x in some.column("slots")], some.column("toxic").to_pylist()))
        model = fit(parts, share, ratio.value)
        yield pa.RecordBatch.from_pydict({"weights": pa.array([model.weights.tobytes()], pa.binary()), "intercept": [model.intercept]})

    return fitted


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Model:
    """Fit on the labelled documents that aren't held out; what reaches the driver is counts and weights of the slots."""
    small_batches(docs.sparkSession)
    known = labels.select(col(id_col).alias("id"), col(label_col).alias("toxic")).where("id is not null and toxic is not null")
    known = stored(known.where(~is_held_out("id")).groupBy("id").agg(F.max("toxic").cast("int").alias("toxic")), "training-labels")
    counts = {r[0]: r[1] for r in known.groupBy("toxic").count().collect()}
    share = counts.get(1, 0) / max(sum(counts.values()), 1)
    texts = docs.select(col(id_col).alias("id"), col(text_col).alias("text"))
    few = sum(counts.values()) <= BROADCAST_IDS and isinstance(known.schema["id"].dataType, NumericType)
    labelled = F.broadcast(known) if few else known
    ratio = count_slots(texts.join(labelled.where("toxic in (0, 1)"), "id")).scales()
    order = F.xxhash64("id").alias("order")
    per_class = [known.where(F.col("toxic") == y).select("id", "toxic", order).orderBy("order", "id").limit(SAMPLE_A_CLASS) for y in (0, 1)]
    sample = per_class[0].unionByName(per_class[1])  # 2 * SAMPLE_A_CLASS rows at most
    coded = stored(texts.join(F.broadcast(sample) if few else sample, "id").select("order", "toxic", "text").mapInArrow(_coded, "order long, toxic int, slots binary"), "training-sample")
    # Ids may repeat: then the rows are bounded once more, in the same order.
    bounded = [coded.where(F.col("toxic") == y).orderBy("order", "slots").limit(SAMPLE_A_CLASS) for y in (0, 1)]
    cast = docs.sparkSession.sparkContext.broadcast(ratio)  # 2 MB
    whole = bounded[0].unionByName(bounded[1]).repartition(1).sortWithinPartitions("toxic", "order", "slots")
    found = whole.mapInArrow(_fitted(cast, share), "weights binary, intercept double").first()
    if found is None:  # no sample, so no task
        return fit([], share, ratio)
    return Model(np.frombuffer(found["weights"], float), found["intercept"])


def score(docs: DataFrame, model: Model, text_col: str = "text", name: str = "score") -> DataFrame:
    """docs with the column `name`: 0 to 1, higher for texts that are likelier toxic."""
    small_batches(docs.sparkSession)
    cast = docs.sparkSession.sparkContext.broadcast(model)  # 2 MB

    def scores(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in texts:
            yield pa.array([cast.value.score(t.as_py()) for t in batch], pa.float64())

    return docs.withColumn(name, F.arrow_udf(scores, "double")(col(text_col)))


def reject_toxic(docs: DataFrame, labels: DataFrame, threshold: float = 0.5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs without the rows that score threshold or more."""
    model = train(docs, labels, id_col, text_col)
    (name,) = fresh(docs, "toxicity")
    return score(docs, model, text_col, name).where(col(name) < threshold).drop(name)
