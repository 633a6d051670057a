"""Fill-in-the-middle, hard negatives and chat formatting: against plain versions, and their defined cases."""

import hashlib
import random
import re

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken
from pyspark.sql import functions as F

from usageloom.llm import chat, fill_in_middle, hard_negatives, queries

DOCS = "doc_id long, text string"
UNIT = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")


# 11: fill in the middle


def plain_cut(i, text):
    units = UNIT.findall(text)
    digest = hashlib.sha256(f"42:{'' if i is None else i}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(digest[8 * j : 8 * j + 8], 16) for j in range(4))
    a, b = sorted((h1 % (len(units) + 1), h2 % (len(units) + 1)))
    prefix, middle, suffix = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if not text or any(s in text for s in ("<P>", "<S>", "<M>")) or h3 % 100 >= 50:
        return len(units), "plain", None, None, text
    if h4 % 100 < 80:
        return len(units), "spm", len(prefix), len(middle), f"<S>{suffix}<P>{prefix}<M>{middle}"
    return len(units), "psm", len(prefix), len(middle), f"<P>{prefix}<S>{suffix}<M>{middle}"


def test_bit_vectors_rank_and_select():
    bits = np.random.default_rng(1).random(5000) < 0.2
    bits[600:1700] = False  # whole blocks without a one
    vector = fill_in_middle.BitVector(np.packbits(bits, bitorder="little"))
    ones = np.flatnonzero(bits)
    assert vector.select(np.arange(len(ones))).tolist() == ones.tolist()
    at = np.arange(5001)
    assert vector.rank(at).tolist() == np.concatenate([[0], np.cumsum(bits)]).tolist()
    empty = fill_in_middle.BitVector(np.zeros(0, np.uint8))
    assert empty.rank(np.zeros(1, np.int64)).tolist() == [0]


def test_marking_in_pieces_and_slices_changes_nothing(monkeypatch):
    texts = ["", "a b", "  ", " ä ö\n\nü ", "", "x", "\t", "𝄞 𝄞𝄞"] * 5
    h1, h2 = np.arange(40) * 7919, np.arange(40) * 104729
    whole = [x.tolist() for x in fill_in_middle.cuts(pa.array(texts), h1, h2)]
    monkeypatch.setattr(fill_in_middle, "MARKED_BYTES", 8)
    assert [x.tolist() for x in fill_in_middle.cuts(pa.array(texts, pa.large_string()), h1, h2)] == whole
    part = fill_in_middle.cuts(pa.array(texts).slice(3, 11), h1[3:14], h2[3:14])
    assert [x.tolist() for x in part] == [x[3:14] for x in whole]
    assert whole[0] == [len(UNIT.findall(t)) for t in texts]


def test_fill_in_middle_equals_plain_cuts(spark):
    rng = random.Random(3)
    texts = ["", " ", "\n\n", "word", " word ", "<P> a b c", "a <S", "<M>", "< P>", "x y z w", "\x00 \x1f\x0b a"]
    texts += ["".join(rng.choices(["a", "é", "𝄞", " ", "\n", "\t", "\r", "<", "P", ">", "word", "　"], k=rng.randrange(60))) for _ in range(400)]
    rows = [(i, t) for i, t in enumerate(texts)] + [(5, "same row twice"), (5, "same row twice"), (None, "no id here"), (-9, None), (2**40, "long id")]
    rows.append((77, " long text é" * 200_000))
    df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, N int")
    found = fill_in_middle.fill_in_middle(df)
    assert found.columns == ["doc_id", "text", "N", "n_", "form", "prefix_chars", "middle_chars", "output"]
    back = found.withColumn("back", fill_in_middle.restored(F.col("output"), F.col("form"))).collect()
    key = lambda r: (r[0] is not None, r[0] or 0, r[1] or "")
    got = [(r["doc_id"], r["text"], (r["n_"], r["form"], r["prefix_chars"], r["middle_chars"], r["output"])) for r in sorted(back, key=key)]
    assert got == [(i, t, plain_cut(i, t or "")) for i, t in sorted(rows, key=key)]
    assert all(r["back"] == (r["text"] or "") for r in back)
    assert {r["form"] for r in back} == {"plain", "psm", "spm"}
    assert fill_in_middle.fill_in_middle(df.limit(0)).count() == 0


def test_sentinels_must_be_told_apart():
    for bad in (("", "<S>", "<M>"), ("<P>", "<P>", "<M>"), ("ab", "bc", "<M>"), ("<P>", "<P>x", "<M>"), ("aa", "<S>", "<M>")):
        with pytest.raises(ValueError):
            fill_in_middle.Sentinels(*bad)


# 12: hard negatives


def plain_negatives(rows, positives=5, negatives=10):
    """rows (id, label, vector), distinct; anchors have an id divisible by 100."""
    whole = [(i, label, [int(np.floor(256 * x)) for x in v]) for i, label, v in rows]
    out = []
    for n, (i, label, v) in enumerate(whole):
        if i % 100:
            continue
        scored = sorted((-sum(a * b for a, b in zip(v, w, strict=True)), j, other == label) for m, (j, other, w) in enumerate(whole) if m != n and len(w) == len(v))
        for p, j, same in [s for s in scored if s[2]][:positives]:
            inside = [(k, -s) for s, k, x in scored if not x and 30 * -p <= 100 * -s <= 90 * -p]
            out += [(i, j, rank, k, -p, s) for rank, (k, s) in enumerate(inside[:negatives], 1)]
    return sorted(out)


ROWS = "vec_id long, label int, embedding array<float>"


def mined(df, **kw):
    return sorted(tuple(r) for r in hard_negatives.mine(df, F.col("vec_id") % 100 == 0, **kw).collect())


def vectors(n, dim, seed):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(6, dim))
    return [(i, int(i % 4), (centres[rng.integers(6)] + rng.normal(size=dim) * 0.6).astype(np.float32).tolist()) for i in range(n)]


@pytest.mark.parametrize(("dim", "blocks"), [(64, 1), (7, 5), (1, 2)])
def test_negatives_equal_brute_force(spark, monkeypatch, dim, blocks):
    rows = vectors(600, dim, dim)
    monkeypatch.setattr(hard_negatives, "BLOCK_ROWS", -(-600 // blocks))
    monkeypatch.setattr(hard_negatives, "BLOCK_ANCHORS", 3 if blocks > 1 else 256)
    assert mined(spark.createDataFrame(rows, ROWS)) == plain_negatives(rows)


def test_negatives_of_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    good = [(0, 1, [1.0, 0.5]), (3, 1, [1.0, 0.5]), (4, 1, [1.0, 0.5]), (5, 2, [0.7, 0.1]), (6, 2, [0.7, 0.1]), (9, 3, [-1.0, 0.0]), (100, 1, [0.0, 0.0]), (101, 1, [3.0]), (102, 2, [2.0]), (200, 2, []), (201, 2, []), (300, 5, [1.0, 1.0])]
    bad = [(1, None, [1.0, 1.0]), (2, 1, None), (7, 1, [nan, 1.0]), (8, 1, [1.0, inf]), (10, 1, [None, 1.0]), (None, 2, [0.7, 0.1])]
    df = spark.createDataFrame([(*r, 1, "x") for r in [*good, *bad, good[0], good[3]]], ROWS + ", uid int, block string")
    assert mined(df) == plain_negatives(good)
    # The same id with another vector is a row of its own.
    again = [*good, (0, 1, [0.9, 0.6]), (5, 2, [0.6, 0.2])]
    assert mined(spark.createDataFrame(again, ROWS)) == plain_negatives(again)
    assert mined(df.limit(0)) == [] and mined(df.where("vec_id = 300")) == []
    huge = spark.createDataFrame([(0, 1, [1e300, -1e300]), (1, 1, [1e300, 0.0]), (2, 2, [1e9, 0.0])], "vec_id long, label int, embedding array<double>")
    assert all(-(2**63) <= r[5] < 2**63 for r in mined(huge))


def test_many_equal_vectors_are_ordered_by_id(spark):
    rows = [(i, i % 2, [0.5, 0.25, 0.5, 0.25]) for i in range(400)] + [(i, i % 2, [0.3, 0.3, 0.3, 0.3]) for i in range(400, 800)]
    got = mined(spark.createDataFrame(rows, ROWS), low=0, high=100)
    whole = [r for r in got if r[0] == 100]
    assert sorted({r[1] for r in whole}) == [0, 2, 4, 6, 8]
    assert [r[3] for r in whole if r[1] == 0] == [1, 3, 5, 7, 9, 11, 13, 15, 17, 19]


def test_bounds_hold_and_spare_most_scores():
    rng = np.random.default_rng(5)
    vectors = (rng.normal(size=(4000, 32)) * 64).astype(np.int32)
    vectors[:200] = vectors[200:400] + rng.integers(-4, 4, size=(200, 32))
    block = hard_negatives.Approximation.of(vectors)
    ids, labels = np.arange(4000), np.arange(4000) % 3
    scored = 0
    for a in range(0, 4000, 400):
        anchor = vectors[a].astype(np.int64)
        low, high = block.bounds(anchor)
        exact = vectors.astype(np.int64) @ anchor
        assert (low <= exact).all() and (exact <= high).all()
        same = (labels == labels[a]) & (ids != a)
        at, scores, n = hard_negatives.best_positives(block, (low, high), anchor, same, ids, 5)
        order = np.lexsort((ids[same], -exact[same]))[:5]
        assert at.tolist() == ids[same][order].tolist() and scores.tolist() == exact[same][order].tolist()
        scored += n
    assert scored < 0.05 * 10 * 4000 / 3


# 13: chat formatting

TURNS = "conv_id long, turn long, role string, text string"


def formatted(df, **kw):
    found = chat.format_chats(df, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, **kw)
    return {r["conv_id"]: r for r in found.withColumn("read", chat.read_turns(F.col("formatted"))).collect()}


def own_encoding():
    import base64

    with open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def check(rows, got):
    own = own_encoding()
    for i in {r[0] for r in rows}:
        turns = [(r[2] or "", r[3] or "") for r in sorted((r for r in rows if r[0] == i), key=lambda r: (r[1] is not None, r[1] or 0, r[2] or "", r[3] or ""))]
        row = got[i]
        assert [(t["role"], t["text"]) for t in row["read"]] == turns and row["n_turns"] == len(turns)
        assert row["loss_text"] == "".join(t for r, t in turns if r == "assistant")
        raw = row["formatted"].encode()
        assert row["ids"] == own.encode_ordinary(row["formatted"]) and len(row["mask"]) == len(row["ids"])
        # A token is in the mask just if it holds a byte of a trained text.
        spans, at = [(s["start"], s["stop"]) for s in row["spans"]], 0
        for token, on in zip(row["ids"], row["mask"], strict=True):
            after = at + len(own.decode_single_token_bytes(token))
            assert on == any(a < after and at < b for a, b in spans)
            at = after
        assert at == len(raw) and spans == sorted(spans)
        assert b"".join(raw[a:b] for a, b in spans).decode() == "".join(chat_escaped(t) for r, t in turns if r == "assistant")


def chat_escaped(text):
    for plain, code in chat.Template().codes(False):
        text = text.replace(plain, code)
    return text


def test_chats_of_marks_blanks_and_nulls(spark):
    marks = ["\\### Assistant: </turn> ok", "### assistant: x </turn>\n### user: y", "####### ", "␛", "␛b</turn>", " </turn>\n", "", None, "\n", " lead and tail ", "é𝄞ü", "a: b", "<|endoftext|>"]
    roles = ["assistant", "user", None, "a: b", "###", "\n", ": ", "tool␛", "assistant "]
    rng = random.Random(2)
    rows = [(c, rng.choice([None, *range(-3, 4), 63, 64, 65, 2**40]), rng.choice(roles), rng.choice(marks)) for c in range(60) for _ in range(rng.randrange(1, 12))]
    rows += [(None, 1, "assistant", "no id"), (-7, 0, "user", marks[0]), (-7, 1, "assistant", marks[0])]
    rows += [(200, t, "assistant", "") for t in range(3)] + [(201, 5, "assistant", "again")] * 2
    df = spark.createDataFrame([(*r, 1, "z") for r in rows], TURNS + ", n_turns int, pieces string")
    check(rows, formatted(df))
    assert formatted(df.limit(0)) == {}


def test_long_chats_go_through_slices(spark, monkeypatch):
    rng = random.Random(4)
    rows = [(1, t, "assistant" if t % 2 else "user", " ".join(rng.choices(["wörd", "###", "a", "\n", "end."], k=20))) for t in range(700)]
    rows += [(2, 0, "user", "hi"), (2, 1, "assistant", "x" * 300_000 + " y" * 50_000)]
    got = formatted(spark.createDataFrame(rows, TURNS))
    check([r for r in rows if r[0] == 1], got)
    assert got[2]["loss_text"] == rows[-1][3]


def test_other_templates_and_roles(spark):
    template = chat.Template(open="<|im|>", role_end="\n", close="<|end|>\n", escape="~", controls=("<|im|>", "<|end|>"), role_controls=("\n",))
    rows = [(1, 0, "sys\ntem", "~ <|end|>\n<|im|>"), (1, 1, "user", "q"), (1, 2, "model", "a<|im|>~a")]
    got = formatted_with(spark, rows, template)
    assert [(t["role"], t["text"]) for t in got["read"]] == [(r[2], r[3]) for r in rows]
    assert got["loss_text"] == "qa<|im|>~a"
    with pytest.raises(ValueError):
        chat.Template(controls=("other",))


def formatted_with(spark, rows, template):
    found = chat.format_chats(spark.createDataFrame(rows, TURNS), public_tokenizers.path(queries.BYTE_BPE), public_tokenizers.PATTERN, template, trained=("model", "user"))
    return found.withColumn("read", chat.read_turns(F.col("formatted"), template)).first()


def test_masks_by_binary_search():
    stops = np.array([2, 5, 6, 9])
    first, after = chat.masked(stops, np.array([0, 2, 3, 5, 6, 4]), np.array([2, 3, 7, 5, 9, 9]))
    assert list(zip(first.tolist(), after.tolist(), strict=True))[:3] == [(0, 1), (1, 2), (1, 4)]
    assert first[3] == after[3] and (first[4], after[4]) == (3, 4) and (first[5], after[5]) == (1, 4)
