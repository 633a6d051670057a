"""Token counts of a unigram tokenizer, by a Viterbi pass that keeps the best score and the piece count only.

Blanks become the piece mark and one is put before the text, as the tokenizer does. A piece holds marks at its start only (or
is a run of them), so each run of marks with the word after it is a unit that is counted by itself, and each distinct unit of
a batch once. An Aho-Corasick automaton enumerates the pieces that end at each character, the longest first; a piece
replaces another only if its path scores more, so ties go to the longest piece, the tokenizer's rule. A character that is
no piece by itself may also be unknown, at the least score less 10, and then counts once for each byte.

Defined cases: a null or empty text has no tokens and the score 0; blanks at a text's end are a unit without a word; texts of any
length are counted whole; repeated rows give equal results; an empty table gives an empty result. Columns other than the
two named are ignored.
"""

from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import sentencepiece
from pyspark.sql import DataFrame

from usageloom.llm.shared import col, small_batches

MARK = "▁"
UNKNOWN_PENALTY = 10.0
#: Words that a worker keeps counted; beyond it the store starts anew, with the same results.
KEPT_WORDS = 500_000


def read_vocabulary(path: str, own_scores: bool = False) -> list[tuple[str, float]]:
    """The ordinary pieces of a sentencepiece file with their scores, as a unigram vocabulary.

    Specials and byte pieces match no text. Counting takes the file's own scores: runs of marks have -1e9, of which sums in double
    precision stay exact over millions of pieces. The sentencepiece library sums in single precision, where one -1e9 hides the
    scores that follow; for it, and without own_scores, those under minus the number of pieces are raised to that.
    """
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    size = model.get_piece_size()
    special = [model.is_unknown, model.is_control, model.is_byte, model.is_unused]
    least = -np.inf if own_scores else -float(size)
    rows = [(model.id_to_piece(i), max(model.get_score(i), least)) for i in range(size) if not any(is_(i) for is_ in special)]
    crossing = [piece for piece, _ in rows if MARK in piece.lstrip(MARK)]
    if crossing:
        raise ValueError(f"pieces go on past a word's end: {crossing[:5]}")
    return rows


class Counter:
    def __init__(self, vocabulary: list[tuple[str, float]]):
        self.pieces = ahocorasick.Automaton()
        for piece, score in vocabulary:
            self.pieces.add_word(piece, (len(piece), score))
        self.pieces.make_automaton()
        self.single = {p for p, _ in vocabulary if len(p) == 1}
        self.unknown = min(s for _, s in vocabulary) - UNKNOWN_PENALTY
        self.known: dict[str, tuple[int, float]] = {}

    def viterbi(self, text: str) -> tuple[int, float]:
        """(pieces, score) of the best path through a text; marks are already in it."""
        single, unknown = self.single, self.unknown
        scores, counts = [0.0], [0]
        hits: list[list[tuple[int, float]]] = [[] for _ in text]
        for end, hit in self.pieces.iter(text):
            hits[end].append(hit)
        for end, c in enumerate(text):
            best = count = None
            for size, score in hits[end]:
                total = scores[end + 1 - size] + score
                if best is None or total > best:
                    best, count = total, counts[end + 1 - size] + 1
            if c not in single:
                total = scores[end] + unknown
                if best is None or total > best:
                    best, count = total, counts[end] + len(c.encode("utf-8", "surrogatepass"))
            scores.append(best)
            counts.append(count)
        return counts[-1], scores[-1]

    def words(self, words: list[str]) -> list[tuple[int, float]]:
        if len(self.known) > KEPT_WORDS:
            self.known = {}
        for w in words:
            if w not in self.known:
                self.known[w] = self.viterbi(MARK + w)
        return [self.known[w] for w in words]


@lru_cache(maxsize=2)
def counter(path: str) -> Counter:
    return Counter(read_vocabulary(path, own_scores=True))


def _sums(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    ends = np.concatenate([[0], np.cumsum(values)])
    return ends[offsets[1:]] - ends[offsets[:-1]]


def _count(path: str):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = counter(path)
        for batch in batches:
            texts = batch.column("text").fill_null("")
            words = pc.split_pattern(pc.replace_substring(texts, MARK, " "), " ")
            offsets = words.offsets.to_numpy() - words.offsets[0].as_py()
            values, ends = words.flatten(), offsets[1:] - 1
            # Empty words stand for further blanks: they go to the next word of the text, or to its last one.
            whole = pc.greater(pc.binary_length(values), 0).to_numpy(zero_copy_only=False).copy()
            whole[ends] = True
            blanks = np.diff(np.flatnonzero(whole), prepend=-1) - 1
            offsets = np.concatenate([[0], np.cumsum(whole)[ends]]).astype(np.int64)
            coded = values.filter(pa.array(whole)).dictionary_encode()
            most = int(blanks.max(initial=0)) + 1
            units, which = np.unique(coded.indices.to_numpy().astype(np.int64) * most + blanks, return_inverse=True)
            names = coded.dictionary.to_pylist()
            found = known.words([MARK * (u % most) + names[u // most] for u in units.tolist()])
            n, score = np.array([f[0] for f in found], np.int64), np.array([f[1] for f in found], float)
            some = pc.greater(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)
            columns = [pa.array(np.where(some, _sums(v[which], offsets), 0).astype(v.dtype)) for v in (n, score)]
            yield pa.RecordBatch.from_arrays([batch.column("id"), *columns], ["id", "n_tokens", "score"])

    return count


def count_tokens(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (id, n_tokens, score): the piece count and the score of each whole text's best path. Map-only."""
    small_batches(docs.sparkSession)
    id_type = docs.schema[id_col].dataType.simpleString()
    texts = docs.select(col(id_col).alias("id"), col(text_col).alias("text"))
    return texts.mapInArrow(_count(path), f"id {id_type}, n_tokens long, score double").withColumnRenamed("id", id_col)
