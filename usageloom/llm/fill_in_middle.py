"""Fill-in-the-middle texts, cut through succinct rank and select over packed bitvectors.

A unit is a word with the blanks before it, or the blanks at a text's end. An Arrow batch's texts are one run of UTF-8
bytes; one bitvector marks the bytes at which a unit begins, another those at which a code point begins. Both are packed,
eight bytes a byte, with a directory of the ones before each block of BLOCK_BYTES of them. A text's number of units is the
difference of two ranks; where a prefix or middle of k units ends is a select, and its length in code points a difference
of ranks again. Only these five numbers leave the worker: the JVM cuts the texts at those bytes.

Which texts are turned, where they are cut, and into which form, comes from the SHA-256 of a seed and the row's id, so it
is the same in every run and on every machine.

Defined cases: a null text is an empty text; an empty text, and one that holds a sentinel, stays plain; a null id is hashed
as an empty one; a text of blanks only is one unit; a text of any length is worked on whole; rows that repeat give equal
results; ties don't occur; an empty table gives an empty result; columns of the input stay, and clashing result names get
a trailing underscore.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from usageloom.llm.shared import col, fresh, small_batches

#: Packed bytes for each entry of a directory, and bytes of text that are marked at once (a multiple of eight).
BLOCK_BYTES, MARKED_BYTES = 64, 1 << 20


class BitVector:
    """Packed bits with a directory of popcounts: rank and select, for many positions at once."""

    def __init__(self, packed: np.ndarray):
        self.blocks = np.zeros((len(packed) // BLOCK_BYTES + 1, BLOCK_BYTES), np.uint8)
        self.blocks.reshape(-1)[: len(packed)] = packed
        self.before = np.concatenate([[0], np.cumsum(np.bitwise_count(self.blocks).sum(axis=1, dtype=np.int64))])

    def rank(self, at: np.ndarray) -> np.ndarray:
        """How many ones lie before each position."""
        block, inside = at // (8 * BLOCK_BYTES), at % (8 * BLOCK_BYTES)
        rows, rest = self.blocks[block], (inside % 8).astype(np.uint8)
        whole = np.where(np.arange(BLOCK_BYTES) < (inside // 8)[:, None], np.bitwise_count(rows), 0).sum(axis=1, dtype=np.int64)
        last = rows[np.arange(len(at)), inside // 8] & ((1 << rest) - 1).astype(np.uint8)
        return self.before[block] + whole + np.bitwise_count(last)

    def select(self, k: np.ndarray) -> np.ndarray:
        """The position of the one that has k ones before it."""
        block = np.searchsorted(self.before, k, side="right") - 1
        upto = np.cumsum(np.bitwise_count(self.blocks[block]), axis=1, dtype=np.int64)
        left = k - self.before[block]
        byte = (upto <= left[:, None]).sum(axis=1)
        rows = np.arange(len(k))
        left = left - np.where(byte > 0, upto[rows, byte - 1], 0)
        bits = np.unpackbits(self.blocks[block, byte][:, None], axis=1, bitorder="little")
        bit = (np.cumsum(bits, axis=1, dtype=np.int64) <= left[:, None]).sum(axis=1)
        return (block * BLOCK_BYTES + byte) * 8 + bit


def _packed(data: np.ndarray, starts: np.ndarray) -> tuple[BitVector, BitVector]:
    """(beginnings of units, beginnings of code points) in the texts that lie in data, beginning at starts."""
    units, points, blank_before = [], [], False
    for a in range(0, len(data), MARKED_BYTES):
        part = data[a : a + MARKED_BYTES]
        blank = (part == 0x20) | ((part >= 0x09) & (part <= 0x0D))
        begins = blank.copy()
        begins[1:] &= ~blank[:-1]
        begins[0] &= not blank_before
        blank_before = bool(blank[-1])
        begins[starts[np.searchsorted(starts, a) : np.searchsorted(starts, a + len(part))] - a] = True
        units.append(np.packbits(begins, bitorder="little"))
        points.append(np.packbits((part & 0xC0) != 0x80, bitorder="little"))
    none = [np.zeros(0, np.uint8)]
    return BitVector(np.concatenate(units or none)), BitVector(np.concatenate(points or none))


def cuts(texts: pa.Array, h1: np.ndarray, h2: np.ndarray) -> list[np.ndarray]:
    """For each text (none null): units, where prefix and middle end in bytes, code points of the prefix and of the middle.

    The prefix has the lesser, prefix and middle have the greater of h1 and h2, modulo one more than there are units.
    """
    offsets = np.frombuffer(texts.buffers()[1], np.int64 if pa.types.is_large_string(texts.type) else np.int32)
    ends = offsets[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    held = texts.buffers()[2]
    data = np.frombuffer(held, np.uint8)[ends[0] : ends[-1]] if held is not None else np.zeros(0, np.uint8)
    ends = ends - ends[0]
    starts, stops = ends[:-1], ends[1:]
    units, points = _packed(data, starts[stops > starts])
    first = units.rank(starts)
    n = units.rank(stops) - first
    low, high = np.minimum(h1 % (n + 1), h2 % (n + 1)), np.maximum(h1 % (n + 1), h2 % (n + 1))
    # The unit after the last one is the next text's, or none: there the text's end is the cut.
    at = [np.where(k < n, units.select(np.where(k < n, first + k, 0)), stops) if len(data) else stops for k in (low, high)]
    ranks = [points.rank(x) for x in (starts, *at)]
    return [n, at[0] - starts, at[1] - starts, ranks[1] - ranks[0], ranks[2] - ranks[1]]


CUTS = ["n", "prefix_bytes", "middle_end", "prefix_chars", "middle_chars"]


def _cut(batches: Iterator[tuple[pa.Array, pa.Array, pa.Array]]) -> Iterator[pa.Array]:
    for texts, h1, h2 in batches:
        found = cuts(texts, h1.to_numpy(), h2.to_numpy())
        yield pa.StructArray.from_arrays([pa.array(x, pa.int64()) for x in found], CUTS)


@dataclass(frozen=True)
class Sentinels:
    """What marks the parts; no text that holds one is turned. None may hold, or end with what another begins with."""

    prefix: str = "<P>"
    suffix: str = "<S>"
    middle: str = "<M>"

    def __post_init__(self) -> None:
        every = self.all()
        overlaps = any(a.endswith(b[:k]) for a in every for b in every for k in range(1, len(b)))
        if not all(every) or any(a in b for i, a in enumerate(every) for j, b in enumerate(every) if i != j) or overlaps:
            raise ValueError("sentinels must be distinct, not empty, and not overlap")

    def all(self) -> list[str]:
        return [self.prefix, self.suffix, self.middle]


def _hashes(id_: Column, seed: int) -> list[Column]:
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(id_.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 1 + 8 * i, 8), 16, 10).cast("long") for i in range(4)]


def _bytes(text: Column, start: Column | int, size: Column) -> Column:
    """The stretch of a text that begins after `start` bytes."""
    return F.substring(text.cast("binary"), F.lit(start) + 1 if isinstance(start, int) else (start + 1).cast("int"), size.cast("int")).cast("string")


def fill_in_middle(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", seed: int = 42, turned: int = 50, suffix_first: int = 80, sentinels: Sentinels = Sentinels()) -> DataFrame:
    """docs with n (units), form (plain, psm or spm), prefix_chars, middle_chars (null if plain) and output.

    Of 100 texts `turned` are turned, and of 100 of those `suffix_first` have the suffix first (spm).
    """
    small_batches(docs.sparkSession)
    names = fresh(docs, "n", "form", "prefix_chars", "middle_chars", "output")
    cut, form, whole = fresh(docs, "cut_", "form_", "whole_")
    h1, h2, h3, h4 = _hashes(col(id_col), seed)
    full = docs.withColumn(whole, F.coalesce(col(text_col), F.lit("")))
    text = F.col(whole)
    found = full.withColumn(cut, F.arrow_udf(_cut, f"struct<{', '.join(f'{c}: long' for c in CUTS)}>")(text, h1, h2))
    marked = F.lit(False)
    for s in sentinels.all():
        marked = marked | text.contains(s)
    plain = (text == "") | marked | (h3 % 100 >= turned)
    found = found.withColumn(form, F.when(plain, "plain").when(h4 % 100 < suffix_first, "spm").otherwise("psm"))
    at = F.col(cut)
    prefix, middle, suffix = (
        _bytes(text, 0, at.prefix_bytes),
        _bytes(text, at.prefix_bytes, at.middle_end - at.prefix_bytes),
        _bytes(text, at.middle_end, F.octet_length(text)),
    )
    p, s, m = (F.lit(x) for x in sentinels.all())
    output = F.when(F.col(form) == "plain", text).when(F.col(form) == "psm", F.concat(p, prefix, s, suffix, m, middle)).otherwise(F.concat(s, suffix, p, prefix, m, middle))
    turned_only = lambda c: F.when(F.col(form) != "plain", at[c])
    values = [at.n, F.col(form), turned_only("prefix_chars"), turned_only("middle_chars"), output]
    return found.select(*[col(c) for c in docs.columns], *[v.alias(n) for v, n in zip(values, names, strict=True)])


def restored(output: Column, form: Column, sentinels: Sentinels = Sentinels()) -> Column:
    """The text that an output was made of. The sentinels are found from the left: no text holds one."""

    def after(mark: str, text: Column) -> Column:
        return F.substring(text, F.locate(mark, text) + len(mark), F.length(text))

    def before(mark: str, text: Column) -> Column:
        return F.substring(text, F.lit(1), F.locate(mark, text) - 1)

    p, s, m = sentinels.all()
    psm = F.concat(before(s, after(p, output)), after(m, output), before(m, after(s, output)))
    spm = F.concat(before(m, after(p, output)), after(m, output), before(p, after(s, output)))
    return F.when(form == "plain", output).when(form == "psm", psm).otherwise(spm)
