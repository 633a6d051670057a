"""Byte-level BPE through a sentencepiece model that is written directly from a rank file.

Every byte is mapped to one printable character; a vocabulary entry becomes a piece of such characters with the score
-rank, and the model neither normalises nor adds blanks. Highest score first, leftmost first, is lowest rank first,
leftmost first: the merges of a byte-level BPE. Texts are cut into pre-tokens by the JVM's regular expressions; each
distinct pre-token of a slice is encoded once, and a text's ids are gathered from them. Decoding maps pieces back to bytes.

A worker goes through an Arrow batch in slices of about SLICE_PIECES pre-tokens, and a longer text in parts, so that what
it holds beside the batch (which Spark bounds by bytes) doesn't follow the number or length of the texts.

Defined cases: a null text is an empty text, with no tokens; repeated rows give equal results; a text of any length is
encoded whole; an empty table gives an empty result. encode and digests ignore extra columns; add_tokens keeps them, and
clashing result names get a trailing underscore.
"""

import base64
import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from usageloom.llm.shared import col, fresh, small_batches

#: Pre-tokens that a worker keeps encoded; beyond it the store starts anew, with the same results.
KEPT_PIECES = 100_000
#: Pre-tokens, and ids to be decoded, that are worked on at once.
SLICE_PIECES = 1 << 18

#: Unicode's White_Space, which \s stands for in the tokenizer's pattern; Java's \s is ASCII only.
WHITE_SPACE = r"\t-\r\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"


def java_pattern(pattern: str) -> str:
    """The pre-token pattern for Java: the same, with \\s and \\S spelt out."""
    spelt = pattern.replace(r"[^\s", "[^" + WHITE_SPACE)
    return spelt.replace(r"\s", f"[{WHITE_SPACE}]").replace(r"\S", f"[^{WHITE_SPACE}]")


def pre_tokens(text: Column, pattern: str) -> Column:
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(java_pattern(pattern)), F.lit(0))


def byte_characters() -> list[str]:
    """A character for each byte: its own where Latin-1 has a printable one, else one from U+0100 on."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    chars, after = {b: chr(b) for b in printable}, 0x100
    for b in range(256):
        if b not in chars:
            chars[b], after = chr(after), after + 1
    return [chars[b] for b in range(256)]


def read_ranks(path: str) -> list[bytes]:
    """The entries of a rank file (base64, blank, rank), by rank; ranks must run from 0 without gaps."""
    with open(path, "rb") as f:
        rows = sorted((int(rank), base64.b64decode(entry)) for entry, rank in map(bytes.split, f.read().splitlines()))
    if [r for r, _ in rows] != list(range(len(rows))):
        raise ValueError(f"{path}: ranks have gaps or repeats")
    return [entry for _, entry in rows]


def _varint(n: int) -> bytes:
    out = b""
    while n > 127:
        out, n = out + bytes([n & 127 | 128]), n >> 7
    return out + bytes([n])


def _field(number: int, value: bytes | int) -> bytes:
    """A protobuf field: length-delimited for bytes, else a varint."""
    if isinstance(value, int):
        return _varint(number << 3) + _varint(value)
    return _varint(number << 3 | 2) + _varint(len(value)) + value


def model_bytes(ranks: list[bytes]) -> bytes:
    """The serialised model: a piece for each entry, id = rank; after them the unknown piece, which never occurs."""
    chars = byte_characters()

    def piece(text: str, score: float, kind: int) -> bytes:
        return _field(1, _field(1, text.encode()) + _varint(2 << 3 | 5) + np.float32(score).tobytes() + _field(3, kind))

    pieces = [piece("".join(chars[b] for b in entry), -rank, 1) for rank, entry in enumerate(ranks)]
    pieces.append(piece("<unk>", 0.0, 2))
    trainer = _field(3, 2) + _field(4, len(pieces))  # model type BPE, vocabulary size
    normalizer = _field(1, b"identity") + _field(3, 0) + _field(4, 0) + _field(5, 0)  # no prefix, no trimming, blanks stay
    return b"".join(pieces) + _field(2, trainer) + _field(3, normalizer)


class Codec:
    """Ids of pre-tokens and bytes of ids, for one rank file."""

    def __init__(self, path: str):
        ranks = read_ranks(path)
        self.whole = {entry: rank for rank, entry in enumerate(ranks)}
        self.model = sentencepiece.SentencePieceProcessor(model_proto=model_bytes(ranks))
        chars = byte_characters()
        self.to_chars = {b: c for b, c in enumerate(chars)}
        back = {c: b for b, c in enumerate(chars)}
        pieces = [bytes(back[c] for c in self.model.id_to_piece(i)) for i in range(len(ranks))]
        self.sizes = np.array([len(p) for p in pieces])
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.bytes_of = np.frombuffer(b"".join(pieces), np.uint8)
        self.known: dict[str, bytes] = {}

    def ids(self, pieces: list[str]) -> list[bytes]:
        """For each pre-token its ids, as little-endian unsigned 32-bit integers."""
        if len(self.known) > KEPT_PIECES:
            self.known = {}
        new = [p for p in pieces if p not in self.known]
        raw = [p.encode("utf-8", "surrogatepass") for p in new]
        # An entry of the vocabulary is one token, even one that no merges lead to.
        rest = [i for i, r in enumerate(raw) if r not in self.whole]
        mapped = [r.decode("latin-1").translate(self.to_chars) for r in (raw[i] for i in rest)]
        found: list[list[int]] = [[self.whole.get(r, -1)] for r in raw]
        for i, ids in zip(rest, self.model.encode(mapped, num_threads=1) if mapped else [], strict=True):
            found[i] = ids
        self.known.update((p, np.array(ids, "<u4").tobytes()) for p, ids in zip(new, found, strict=True))
        return [self.known[p] for p in pieces]

    def encode(self, pieces: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(the ids of all pre-tokens one after the other, how many each has)."""
        coded = pieces.dictionary_encode()
        codes = self.ids(coded.dictionary.to_pylist())
        which, sizes = coded.indices.to_numpy(), np.array([len(c) // 4 for c in codes], np.int64)
        return _gathered(np.frombuffer(b"".join(codes), "<u4"), (np.cumsum(sizes) - sizes)[which], sizes[which]), sizes[which]

    def decode(self, ids: np.ndarray) -> np.ndarray:
        """The bytes that the ids stand for, one after the other."""
        parts = [ids[i : i + SLICE_PIECES] for i in range(0, len(ids), SLICE_PIECES)]
        return np.concatenate([np.zeros(0, np.uint8), *(_gathered(self.bytes_of, self.starts[p], self.sizes[p]) for p in parts)])


def _gathered(table: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The stretches of a table that begin at starts, one after the other."""
    ends = np.cumsum(sizes)
    if not len(ends) or not ends[-1]:
        return table[:0]
    return table[np.repeat(starts - ends + sizes, sizes) + np.arange(ends[-1])]


@lru_cache(maxsize=2)
def codec(path: str) -> Codec:
    return Codec(path)


def _encoded(known: Codec, lists: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(ids, the number of ids of each row) for slices of rows that have about SLICE_PIECES pre-tokens, in order."""
    offsets = lists.offsets.to_numpy()
    values, row = lists.values, 0
    if not len(lists):
        yield np.zeros(0, "<u4"), np.zeros(0, np.int64)
    while row < len(lists):
        stop = max(row + 1, int(np.searchsorted(offsets, offsets[row] + SLICE_PIECES, side="right")) - 1)
        stop, first, last = min(stop, len(lists)), int(offsets[row]), int(offsets[min(stop, len(lists))])
        # One text may hold more than a slice; it goes in parts.
        parts = [known.encode(values.slice(i, min(SLICE_PIECES, last - i))) for i in range(first, last, SLICE_PIECES)]
        ids = np.concatenate([np.zeros(0, "<u4"), *(p[0] for p in parts)])
        ends = np.concatenate([[0], np.cumsum(np.concatenate([np.zeros(0, np.int64), *(p[1] for p in parts)]))])
        yield ids, np.diff(ends[offsets[row : stop + 1] - first])
        row = stop


def _rows(flat: np.ndarray, sizes: np.ndarray) -> list[memoryview]:
    """The bytes of each row's stretch of flat."""
    view, ends = memoryview(flat).cast("B"), np.cumsum(sizes) * flat.itemsize
    return [view[a:b] for a, b in zip(ends - sizes * flat.itemsize, ends, strict=True)]


def _byte_sizes(known: Codec, ids: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """How many bytes each row decodes to."""
    ends = np.concatenate([[0], np.cumsum(known.sizes[ids])])
    stops = np.cumsum(sizes)
    return ends[stops] - ends[stops - sizes]


def _id_lists(ids: np.ndarray, sizes: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32()), pa.array(ids.view(np.int32)))


def _encoder(path: str):
    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = codec(path)
        for batch in batches:
            row = 0
            for ids, sizes in _encoded(known, batch.column("pieces")):
                yield pa.RecordBatch.from_arrays([batch.column("id").slice(row, len(sizes)), _id_lists(ids, sizes)], ["id", "ids"])
                row += len(sizes)

    return encode


def _decoder(path: str):
    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = codec(path)
        for batch in batches:
            rows = [known.decode(ids.values.to_numpy()).tobytes() for ids in batch.column("ids")]
            yield batch.append_column("decoded", pa.array(rows, pa.binary()))

    return decode


def encode(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (id, ids): the token ids of each whole text."""
    small_batches(docs.sparkSession)
    id_type = docs.schema[id_col].dataType.simpleString()
    cut = docs.select(col(id_col).alias("id"), pre_tokens(col(text_col), pattern).alias("pieces"))
    return cut.mapInArrow(_encoder(path), f"id {id_type}, ids array<int>")


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """Rows (id, ids, decoded): with the bytes that the ids stand for."""
    id_type = encoded.schema["id"].dataType.simpleString()
    return encoded.mapInArrow(_decoder(path), f"id {id_type}, ids array<int>, decoded binary")


def _digested(known: Codec, lists: pa.Array) -> Iterator[tuple[pa.Array, pa.Array, pa.Array, pa.Array]]:
    """(ids, n_tokens, ids_sha256, decoded_sha256) of slices of rows; the last is of what the ids decode to."""
    for ids, sizes in _encoded(known, lists):
        decoded = known.decode(ids)
        shas = [hashlib.sha256(x).hexdigest() for x in _rows(ids, sizes)]
        back = [hashlib.sha256(x).hexdigest() for x in _rows(decoded, _byte_sizes(known, ids, sizes))]
        yield _id_lists(ids, sizes), pa.array(sizes, pa.int64()), pa.array(shas, pa.string()), pa.array(back, pa.string())


def _digester(path: str):
    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = codec(path)
        for batch in batches:
            row = 0
            for _, n, shas, back in _digested(known, batch.column("pieces")):
                yield pa.RecordBatch.from_arrays([batch.column("id").slice(row, len(n)), n, shas, back], ["id", "n_tokens", "ids_sha256", "decoded_sha256"])
                row += len(n)

    return digest


def digests(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (id, n_tokens, ids_sha256, decoded_sha256), encoded and decoded in one pass over the texts."""
    small_batches(docs.sparkSession)
    id_type = docs.schema[id_col].dataType.simpleString()
    cut = docs.select(col(id_col).alias("id"), pre_tokens(col(text_col), pattern).alias("pieces"))
    return cut.mapInArrow(_digester(path), f"id {id_type}, n_tokens long, ids_sha256 string, decoded_sha256 string").withColumnRenamed("id", id_col)


def add_tokens(docs: DataFrame, path: str, pattern: str, text_col: str = "text") -> DataFrame:
    """docs with ids, n_tokens, ids_sha256 and decoded_sha256 (of the bytes that the ids decode to); every column of docs stays."""
    small_batches(docs.sparkSession)
    names = ["ids", "n_tokens", "ids_sha256", "decoded_sha256"]

    def tokens(pieces: Iterator[pa.Array]) -> Iterator[pa.Array]:
        known = codec(path)
        for lists in pieces:
            slices = list(_digested(known, lists))
            yield pa.StructArray.from_arrays([pa.concat_arrays(x) for x in zip(*slices, strict=True)], names)

    coded = F.arrow_udf(tokens, "struct<ids: array<int>, n_tokens: long, ids_sha256: string, decoded_sha256: string>")
    (both,) = fresh(docs, "tokens")
    counted = docs.withColumn(both, coded(pre_tokens(col(text_col), pattern)))
    return counted.select(*[col(c) for c in docs.columns], *[F.col(both)[n].alias(x) for n, x in zip(names, fresh(docs, *names), strict=True)])
