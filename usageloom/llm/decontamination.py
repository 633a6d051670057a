"""Benchmark decontamination: approximate occurrences of test items, by pigeonhole and Myers' bit-parallel distance.

Texts and items are lower-cased, with every run of characters other than letters, marks and digits as one blank. An item
of m characters may occur with a budget of k = floor(m * ERROR_RATE) edits. Cut into k + 1 pieces, one piece at least
must occur unchanged: an Aho-Corasick automaton of all pieces finds those hits in one pass over the text, and the window
around each is verified by the edit distance of the whole item to the best substring.

The items are the stated query set: they are broadcast in blocks of at most BLOCK_CHARS characters, one pass over the
documents for each block; documents are never shuffled. A worker builds a block's automaton once and keeps it for its
further tasks. Defined cases: null or empty texts match nothing, and so do items without a letter or digit; a text of any
length is searched whole; items with a budget of 0 must match whole words; equal items match each by itself; repeated rows
give repeated results; without documents or items there are no matches. Extra columns are ignored by find_matches and kept
by drop_contaminated, whatever their names.
"""

import uuid
from collections.abc import Iterator
from functools import reduce

import ahocorasick
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from usageloom.llm.shared import col, small_batches

ERROR_RATE = 0.06
#: Characters of items that are broadcast at once, and the automaton's text (some 70 MB in a worker).
BLOCK_CHARS = 1_000_000


def normal_text(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{M}\p{N}]+", " "))


class Myers:
    """The least edit distance of a pattern to any substring of a text; a Python integer is the bit vector."""

    def __init__(self, pattern: str):
        self.size, self.masks = len(pattern), {}
        for i, c in enumerate(pattern):
            self.masks[c] = self.masks.get(c, 0) | 1 << i

    def best(self, text: str) -> int:
        full = (1 << self.size) - 1
        high, masks, pv, mv = 1 << (self.size - 1), self.masks, full, 0
        score = least = self.size
        for c in text:
            eq = masks.get(c, 0)
            xv = eq | mv
            xh = (((eq & pv) + pv) ^ pv) | eq
            ph = mv | (full & ~(xh | pv))
            mh = pv & xh
            if ph & high:
                score += 1
            elif mh & high:
                score -= 1
                if score < least:
                    least = score
            ph, mh = ph << 1 & full, mh << 1 & full
            pv, mv = mh | (full & ~(xv | ph)), ph & xv
        return least


class Matcher:
    def __init__(self, items: list[tuple[int, str]], rate: float):
        """items: (number, normal text)."""
        self.items, places = {}, {}
        for number, text in items:
            if not text:
                continue
            k = int(len(text) * rate)
            padded = text if k else f" {text} "
            cuts = [len(padded) * i // (k + 1) for i in range(k + 2)]
            self.items[number] = (padded, k, Myers(padded))
            for a, b in zip(cuts, cuts[1:], strict=False):
                places.setdefault(padded[a:b], []).append((number, a))
        self.pieces = ahocorasick.Automaton()
        for piece, at in places.items():
            self.pieces.add_word(piece, (len(piece), at))
        if places:
            self.pieces.make_automaton()

    def find(self, text: str) -> list[tuple[int, int]]:
        """(number, distance) of each item that occurs in a normal text within its budget."""
        if not self.items or not text:
            return []
        padded, starts = f" {text} ", {}
        for end, (size, at) in self.pieces.iter(padded):
            for number, offset in at:
                starts.setdefault(number, set()).add(end + 1 - size - offset)
        found = []
        for number, begins in starts.items():
            item, k, myers = self.items[number]
            if item in padded:
                found.append((number, 0))
                continue
            least, ordered, i = k + 1, sorted(begins), 0
            while i < len(ordered):
                # Windows that overlap are one.
                first = last = ordered[i]
                while i < len(ordered) and ordered[i] - k <= last + len(item) + k:
                    last, i = ordered[i], i + 1
                least = min(least, myers.best(padded[max(0, first - k) : last + len(item) + k]))
            if least <= k:
                found.append((number, least))
        return found


_kept: dict[str, Matcher] = {}


def matcher_of(name: str, block: list, rate: float) -> Matcher:
    """The matcher of a block of items, which this worker builds once; one block is kept at a time."""
    if name not in _kept:
        _kept.clear()
        _kept[name] = Matcher([(i, text) for i, (_, text) in enumerate(block)], rate)
    return _kept[name]


def _blocks(items: DataFrame, id_col: str, text_col: str) -> Iterator[list]:
    """The items as (id, normal text), in blocks of about BLOCK_CHARS."""
    normal = items.select(col(id_col).alias("id"), normal_text(col(text_col)).alias("text"))
    chars = normal.agg(F.sum(F.length("text") + 64)).first()[0] or 0
    n = chars // BLOCK_CHARS + 1
    for i in range(n):
        yield [tuple(r) for r in normal.where(F.pmod(F.xxhash64("id", "text"), F.lit(n)) == i).collect()]


def find_matches(
    docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text", rate: float = ERROR_RATE
) -> DataFrame:
    """Rows (doc_id, item_id, distance): every item that occurs in a document within its error budget, once."""
    small_batches(docs.sparkSession)
    id_type, item_type = docs.schema[id_col].dataType.simpleString(), items.schema[item_id].dataType.simpleString()
    texts = docs.select(col(id_col).alias("id"), normal_text(col(text_col)).alias("text"))

    def of_block(block: list) -> DataFrame:
        cast, name = docs.sparkSession.sparkContext.broadcast(block), uuid.uuid4().hex
        kind = pa.from_numpy_dtype("int64")

        def match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            matcher = matcher_of(name, cast.value, rate)
            for batch in batches:
                rows = [(i, *hit) for i, text in enumerate(batch.column("text")) for hit in matcher.find(text.as_py())]
                ids = batch.column("id").take(pa.array([r[0] for r in rows], kind))
                yield pa.RecordBatch.from_arrays([ids, pa.array([r[1] for r in rows], kind), pa.array([r[2] for r in rows], pa.int32())], ["id", "number", "distance"])

        numbered = docs.sparkSession.createDataFrame([(i, r[0]) for i, r in enumerate(block)], f"number long, item {item_type}")
        hits = texts.mapInArrow(match, f"id {id_type}, number long, distance int")
        return hits.join(F.broadcast(numbered), "number").select(F.col("id").alias(id_col), F.col("item").alias(item_id), "distance")

    return reduce(DataFrame.unionByName, map(of_block, _blocks(items, item_id, item_text)))


def _cleaner(cast, rate: float):
    name = uuid.uuid4().hex

    def clean(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        matcher = matcher_of(name, cast.value, rate)
        for batch in texts:
            yield pd.Series([not matcher.find(t) for t in batch], dtype=bool)

    return clean


def drop_contaminated(docs: DataFrame, items: DataFrame, text_col: str = "text", item_id: str = "item_id", item_text: str = "text", rate: float = ERROR_RATE) -> DataFrame:
    """docs without the rows in which an item occurs within its error budget."""
    small_batches(docs.sparkSession)
    for block in _blocks(items, item_id, item_text):
        cast = docs.sparkSession.sparkContext.broadcast(block)
        docs = docs.where(F.pandas_udf(_cleaner(cast, rate), "boolean")(normal_text(col(text_col))))
    return docs
