"""Chat formatting with offset-aligned loss masks.

A conversation is rendered whole: every turn is `open` + role + `role_end` + text + `close`, with the control strings inside
roles and texts written as codes behind an escape character, so that a template's marks occur where turns begin and end
only, and every rendering can be read back. It is encoded once, by byte-level BPE; the sizes of the pieces give each
token's offsets. The texts of the trained roles are sorted spans of the rendering's bytes; two binary searches for each
span find the tokens that it meets: those are in the mask. A token may reach over a span's edge, where it is cut, so what
lies under the mask is each trained text, once and in order.

Turns are gathered in two steps, TURNS_A_PART by their number first, so that the second one gathers few rows even of a very long conversation.
A conversation is one value in the end, in one task: its text, tokens and digest are that by definition.

Defined cases: a null text or role is an empty one; turns with a null number come first, and turns with equal numbers are in the
order of role and text, repeated rows included; rows with a null conversation id are one conversation, with a null id; an
empty table gives an empty result; texts of any length are worked on whole; extra columns are ignored, whatever
their names; a conversation of empty texts has an empty mask.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from usageloom.llm.byte_bpe import _encoded, _id_lists, codec, pre_tokens
from usageloom.llm.shared import col, small_batches

#: Turn numbers whose turns are joined to one row first.
TURNS_A_PART = 64


@dataclass(frozen=True)
class Template:
    """The strings around roles and texts, and the escape character, which is a rare one: most texts stay as they are."""

    open: str = "### "
    role_end: str = ": "
    close: str = " </turn>\n"
    escape: str = "␛"
    #: What is written as a code inside texts, and in roles: each mark without blanks.
    controls: tuple[str, ...] = ("###", "</turn>")
    role_controls: tuple[str, ...] = (":",)

    def __post_init__(self) -> None:
        held = [any(c in mark for c in self.controls) for mark in (self.open, self.close)]
        if len(self.escape) != 1 or not all(held) or not any(c in self.role_end for c in self.role_controls):
            raise ValueError("open and close must hold a control string, role_end one of roles, and the escape be a character")
        if len(self.controls) + len(self.role_controls) > 25 or any(self.escape in x for x in (*self.controls, *self.role_controls, self.open, self.role_end, self.close)):
            raise ValueError("25 control strings at most, without the escape character")

    def codes(self, role: bool) -> list[tuple[str, str]]:
        """(what is escaped, what it is written as); the escape character itself is the first."""
        controls = [self.escape, *self.controls, *(self.role_controls if role else ())]
        return [(c, self.escape + chr(ord("a") + i)) for i, c in enumerate(controls)]

    def escaped(self, text: Column, role: bool = False) -> Column:
        for plain, code in self.codes(role):
            text = F.replace(text, F.lit(plain), F.lit(code))
        return text

    def unescaped(self, text: Column, role: bool = False) -> Column:
        # An escape character always begins a code, so the codes can be undone one after the other, its own at last.
        for plain, code in reversed(self.codes(role)):
            text = F.replace(text, F.lit(code), F.lit(plain))
        return text


def render(rows: DataFrame, template: Template = Template(), trained: Sequence[str] = ("assistant",), id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """Rows (conv_id, n_turns, formatted, turns): turns are struct<head, body, tail, trained>, sizes in bytes, in order."""
    role, text = F.coalesce(col(role_col).cast("string"), F.lit("")), F.coalesce(col(text_col), F.lit(""))
    turn = F.struct(col(turn_col).alias("turn"), role.alias("role"), text.alias("text"))
    sliced = rows.select(col(id_col).alias("conv_id"), F.floor(col(turn_col) / TURNS_A_PART).alias("part"), turn.alias("row"))
    parts = sliced.groupBy("conv_id", "part").agg(F.array_sort(F.collect_list("row")).alias("rows"))
    head = lambda r: F.concat(F.lit(template.open), template.escaped(r.role, role=True), F.lit(template.role_end))
    drawn = F.transform("rows", lambda r: F.struct(head(r).alias("head"), template.escaped(r.text).alias("body"), r.role.isin(list(trained)).alias("trained")))
    parts = parts.select("conv_id", "part", F.explode(F.array(drawn)).alias("drawn"))
    sizes = F.transform("drawn", lambda d: F.struct(F.octet_length(d.head).cast("long").alias("head"), F.octet_length(d.body).cast("long").alias("body"), F.lit(len(template.close.encode())).cast("long").alias("tail"), d.trained.alias("trained")))
    written = F.array_join(F.transform("drawn", lambda d: F.concat(d.head, d.body, F.lit(template.close))), "")
    gathered = parts.select("conv_id", F.struct("part", written.alias("text"), sizes.alias("turns")).alias("piece")).groupBy("conv_id").agg(F.array_sort(F.collect_list("piece")).alias("pieces"))
    turns = F.flatten(F.transform("pieces", lambda p: p.turns))
    whole = gathered.select("conv_id", F.array_join(F.transform("pieces", lambda p: p.text), "").alias("formatted"), turns.alias("turns"))
    return whole.select("conv_id", F.size("turns").cast("long").alias("n_turns"), "formatted", "turns")


def masked(stops: np.ndarray, starts_of: np.ndarray, stops_of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first, last + 1) of the tokens that each span meets, by binary search; tokens follow one another and end at stops."""
    first = np.searchsorted(stops, starts_of, side="right")
    after = np.searchsorted(stops, stops_of, side="left") + 1
    return first, np.where(stops_of > starts_of, np.minimum(after, len(stops)), first)


TURNS = "array<struct<head: long, body: long, tail: long, trained: boolean>>"
ALIGNED = ["conv_id", "n_turns", "formatted", "turns", "ids", "mask", "spans", "loss_text"]


def _spans_of(turns: pa.Array, row: int) -> tuple[np.ndarray, np.ndarray]:
    """Where the trained texts of a row lie in its rendering: starts and stops in bytes, ascending."""
    a, b = turns.offsets[row].as_py(), turns.offsets[row + 1].as_py()
    each = turns.values.slice(a, b - a)
    head, body, tail = (each.field(i).to_numpy() for i in range(3))
    stops = np.cumsum(head + body + tail) - tail
    on = each.field(3).to_numpy(zero_copy_only=False).astype(bool)
    return (stops - body)[on], stops[on]


def _pairs(starts: list[np.ndarray], stops: list[np.ndarray]) -> pa.Array:
    ends = np.concatenate([[0], np.cumsum([len(s) for s in starts])])
    none = [np.zeros(0, np.int64)]
    both = pa.StructArray.from_arrays([pa.array(np.concatenate(x or none), pa.int64()) for x in (starts, stops)], ["start", "stop"])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), both)


def _stretches(starts: np.ndarray, stops: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Stretches that follow on one another, joined."""
    apart = starts[1:] != stops[:-1]
    return starts[np.concatenate([[True], apart])[: len(starts)]], stops[np.concatenate([apart, [True]])[: len(stops)]]


def _aligned(path: str):
    def align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = codec(path)
        for batch in batches:
            row, turns = 0, batch.column("turns")
            for ids, counts in _encoded(known, batch.column("pieces")):
                ends, masks, spans, texts = np.concatenate([[0], np.cumsum(counts)]), [], ([], []), []
                for i in range(len(counts)):
                    own = ids[ends[i] : ends[i + 1]]
                    stops = np.cumsum(known.sizes[own])
                    starts = stops - known.sizes[own]
                    a, b = _spans_of(turns, row + i)
                    first, after = masked(stops, a, b)
                    sizes = after - first
                    met = np.repeat(first - np.cumsum(sizes) + sizes, sizes) + np.arange(sizes.sum())
                    mask = np.zeros(len(own), bool)
                    mask[met] = True
                    # What these tokens have in common with the spans that they meet, read from the tokens.
                    read = memoryview(known.decode(own))
                    under = _stretches(np.maximum(starts[met], np.repeat(a, sizes)), np.minimum(stops[met], np.repeat(b, sizes)))
                    texts.append(b"".join(read[x:y] for x, y in zip(*under, strict=True)).decode("utf-8", "surrogatepass"))
                    masks.append(mask)
                    spans[0].append(a)
                    spans[1].append(b)
                flags = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate([np.zeros(0, bool), *masks])))
                kept = [batch.column(c).slice(row, len(counts)) for c in ALIGNED[:4]]
                yield pa.RecordBatch.from_arrays([*kept, _id_lists(ids, counts), flags, _pairs(*spans), pa.array(texts, pa.string())], ALIGNED)
                row += len(counts)

    return align


def format_chats(rows: DataFrame, path: str, pattern: str, template: Template = Template(), trained: Sequence[str] = ("assistant",), **columns: str) -> DataFrame:
    """Rows (conv_id, n_turns, formatted, turns, ids, mask, spans, loss_text).

    ids are the tokens of `formatted` by a rank file and its pattern; mask tells for each whether it counts in the loss.
    spans are the trained texts in bytes of `formatted`; loss_text is what the mask's tokens hold of them, unescaped.
    """
    small_batches(rows.sparkSession)
    drawn = render(rows, template, trained, **columns)
    id_type = drawn.schema["conv_id"].dataType.simpleString()
    cut = drawn.withColumn("pieces", pre_tokens(F.col("formatted"), pattern))
    kinds = [id_type, "long", "string", TURNS, "array<int>", "array<boolean>", "array<struct<start: long, stop: long>>", "string"]
    read = cut.mapInArrow(_aligned(path), ", ".join(f"{c} {k}" for c, k in zip(ALIGNED, kinds, strict=True)))
    return read.withColumn("loss_text", template.unescaped(F.col("loss_text")))


def read_turns(formatted: Column, template: Template = Template()) -> Column:
    """array<struct<role, text>>: the turns of a rendering, as they were."""
    # No text holds `close` or its control string, and no role the one of role_end: so the marks are where turns end.
    drawn = F.split(formatted, _quoted(template.close))
    whole = F.slice(drawn, F.lit(1), F.size(drawn) - 1)

    def turn(t: Column) -> Column:
        inner = F.substring(t, F.lit(len(template.open) + 1), F.length(t))
        at = F.locate(template.role_end, inner)
        role, text = F.substring(inner, F.lit(1), at - 1), F.substring(inner, at + len(template.role_end), F.length(inner))
        return F.struct(template.unescaped(role, role=True).alias("role"), template.unescaped(text).alias("text"))

    return F.transform(whole, turn)


def _quoted(text: str) -> str:
    return "".join(f"\\x{{{ord(c):x}}}" for c in text)
