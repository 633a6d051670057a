"""The registered queries: those with SQL against DuckDB, the others against plain versions on whole tables."""

import base64

import brute
import public_tokenizers
import pytest
import tiktoken
from compare import spark_rows, sql_rows

from usageloom.llm import queries


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_query_matches_sql(spark, sf_dir, name):
    assert spark_rows(queries.QUERIES[name](spark, sf_dir)) == sql_rows(queries.ORACLE[name], sf_dir)


def test_thirteen_operators_are_registered():
    assert sorted(int(name[2:].split("_")[0]) for name in queries.QUERIES) == list(range(1, 14))


def test_op3_tells_held_out_documents(spark, sf_dir):
    sf_dir = sf_dir.replace("sf0.001", "sf0.01")
    scored = queries.op3_toxicity(spark, sf_dir)
    n = spark.read.parquet(f"{sf_dir}/documents.parquet").count()
    known = scored.join(spark.read.parquet(f"{sf_dir}/labels.parquet"), "doc_id").collect()
    assert scored.count() == n
    held = [r for r in known if r["held_out"]]
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) for r in known)
    assert sum(r["predicted"] == r["toxic"] for r in held) >= 0.95 * len(held)
    # A plain version over the n-grams themselves, unhashed and fitted otherwise, tells nearly all rows alike.
    rows = [(r[0], r[1]) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    plain = brute.plain_toxicity(rows, {r["doc_id"]: r["toxic"] for r in known if not r["held_out"]})
    told = {r["doc_id"]: r["predicted"] for r in scored.collect()}
    assert set(told) == set(plain) and sum(told[i] == plain[i] for i in told) >= 0.97 * len(told)


def test_op4_equals_brute_force(spark, sf_dir):
    sf_dir = sf_dir.replace("sf0.001", "sf0.1")  # 2000 vectors; sf0.01 has no more than sf0.001
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in queries.op4_vector_dedup(spark, sf_dir).collect()}
    rows = [(r[0], r[1]) for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding").collect()]
    assert got == brute.near_vectors(rows)


def test_op5_equals_brute_force(spark, sf_dir, documents):
    got = {r["doc_id"]: r for r in queries.op5_secret_scan(spark, sf_dir).collect()}
    assert len(got) == len(documents)
    assert {i: [x for x in r["spans"].split(",") if x.startswith("random")] for i, r in got.items()} == brute.random_spans(documents)
    for i, text in documents:
        spans = brute.base_spans(text)
        assert got[i]["base_sha256"] == brute.sha(",".join(spans).encode())
        assert [got[i][f"n_{k}"] for k in ("assign", "access", "hex")] == [sum(s.startswith(f"{k}:") for s in spans) for k in ("assign", "access", "hex")]
        assert set(spans) <= set(got[i]["spans"].split(","))


def test_op6_equals_the_tokenizer(spark, sf_dir, documents):
    from test_operators import unigram_model

    from usageloom.llm import token_counts

    path = public_tokenizers.path(queries.UNIGRAM)
    # All pieces; only the scores of -1e9, which the library's single precision can't add up, are raised.
    model = unigram_model(token_counts.read_vocabulary(path))
    got = {r["doc_id"]: r["n_tokens"] for r in queries.op6_token_counts(spark, sf_dir).collect()}
    assert got == {i: len(model.encode(t or "")) for i, t in documents}


def test_op7_equals_brute_force(spark, sf_dir, documents):
    from usageloom.llm.decontamination import ERROR_RATE

    got = {(r["doc_id"], r["item_id"]): r["distance"] for r in queries.op7_decontamination(spark, sf_dir).collect()}
    items = [(r[0], brute.normal(r[1])) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text").collect()]
    hit = {d for d, _ in got}
    want = {}
    for i, text in ((i, brute.normal(t)) for i, t in documents):
        # Long texts without a hit are held against a fixed share of the items.
        some = items if i in hit or len(text) < 2500 else items[i % 25 :: 25]
        for j, item in some:
            k = int(len(item) * ERROR_RATE)
            if item and (d := brute.best_distance(item, text)) <= k:
                want[i, j] = d
    assert got == want


def test_op8_equals_tiktoken(spark, sf_dir, documents):
    got = {r["doc_id"]: r for r in queries.op8_byte_bpe(spark, sf_dir).collect()}
    with open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    own = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    for i, text in documents:
        ids = own.encode_ordinary(text or "")
        raw = b"".join(x.to_bytes(4, "little") for x in ids)
        assert (got[i]["n_tokens"], got[i]["ids_sha256"], got[i]["decoded_sha256"]) == (len(ids), brute.sha(raw), brute.sha((text or "").encode()))


def test_op10_equals_brute_force(spark, sf_dir):
    sf_dir = sf_dir.replace("sf0.001", "sf0.01")
    got = {r["doc_id"]: (r["class_id"], r["n_links"]) for r in queries.op10_jaccard_join(spark, sf_dir).collect()}
    rows = [(r[0], r[1]) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    assert got == brute.near_classes(rows) and sum(n for _, n in got.values()) > 0
