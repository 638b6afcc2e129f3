"""The stages of the pipeline, each on its own input, and the whole of it."""

import hashlib
from collections import Counter

import corpus_pipeline
import pytest
from test_text_operators import SCHEMA, brute_components  # noqa: F401

from opsweave.llm import mixing, toxicity


@pytest.fixture(scope="module")
def docs(spark):
    base = " ".join(f"w{i}x{i * 7 % 13}" for i in range(160))
    rows = [(i, " ".join(f"d{i}t{k}" for k in range(60 + i)), "en", f"s{i % 3}", 5) for i in range(12)]
    rows += [(20, base, "en", "s0", 1), (21, base, "en", "s1", 1), (22, base + " more", "en", None, 1), (23, None, None, "s2", None), (24, "", "en", "s2", 0), (25, rows[3][1] + " " + base[:700], "en", "s2", 9)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")


def test_near_duplicates_keep_one_of_each_group(spark, docs):
    out = corpus_pipeline.near_duplicate_groups(spark, docs, "")
    want = brute_components([(r.doc_id, r.text, None) for r in docs.collect()], 5)
    assert out.columns == docs.columns
    assert sorted(r.doc_id for r in out.collect()) == sorted(i for i, (_, _, kept) in want.items() if kept)


def test_repeats_go_and_lengths_follow(spark, docs):
    """Word by word against all windows of 50 words."""
    out = {r.doc_id: r for r in corpus_pipeline.repeated_passages(spark, docs, "").collect()}
    before = {r.doc_id: r.text for r in docs.collect()}
    words = {i: (t or "").split() for i, t in before.items()}
    often = Counter(tuple(w[k : k + 50]) for w in words.values() for k in range(len(w) - 49))
    for i, w in words.items():
        gone = {j for k in range(len(w) - 49) if often[tuple(w[k : k + 50])] > 1 for j in range(k, k + 50)}
        assert (out[i].text or "").split() == [x for j, x in enumerate(w) if j not in gone]
    assert out[20].text == "" and out[20].n_chars == 0 and out[3].text == "" and out[5].text == before[5]
    assert out[25].text == " w" and out[22].text == " more"
    assert out[23].text is None and out[24].text == ""


def test_whole_pipeline(spark, docs, tmp_path):
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(0, 0), (1, 0)], "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    rows = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {"doc_id", "n_tokens", "ids_sha256", "decoded_sha256"} <= set(rows[0].asDict())
    assert {r.doc_id for r in rows} <= {r.doc_id for r in docs.collect()}
    text = {r.doc_id: r.text or "" for r in docs.collect()}
    plain = [r for r in rows if r.doc_id < 12 and r.doc_id != 3]
    assert plain and all(r.decoded_sha256 == hashlib.sha256(text[r.doc_id].encode()).hexdigest() for r in plain)


@pytest.fixture(scope="module")
def odd(spark, docs):
    """Rows with nulls anywhere, repeated rows and a further column."""
    rows = [(*r, 1) for r in docs.collect()] + [(None, "no id here", None, None, None, None), (2, "d2t0 d2t1", "en", "s2", 5, 7), (2, "d2t0 d2t1", "en", "s2", 5, 7)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, row int")


def test_toxic_documents_go(spark, odd, tmp_path):
    labels = [(i, 0, int(i % 4 == 1)) for i in range(12)] + [(None, 1, 1), (7, None, None)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    out = corpus_pipeline.toxicity(spark, odd, str(tmp_path))
    scored = toxicity.toxicity_scores(odd, spark.read.parquet(f"{tmp_path}/labels.parquet")).collect()
    assert out.columns == odd.columns
    assert sorted(str(r.doc_id) for r in out.collect()) == sorted(str(r.doc_id) for r in scored if r.score < 0.3)


def test_mixing_repeats_rows(spark, odd):
    out = corpus_pipeline.mixing(spark, odd, "")
    copies = mixing.mixed(odd).collect()
    assert out.columns == odd.columns
    want = Counter()
    for r in copies:
        want[r.doc_id] += r.copies
    assert Counter(r.doc_id for r in out.collect()) == +want
    sizes = Counter()
    for r in odd.collect():
        sizes[r.source] += len((r.text or "").split())
    taken = Counter()
    for r in copies:
        taken[r.source] += r.taken
    assert all(abs(taken[r.source] - r.target) <= max(60, 0.03 * r.target) for r in copies if sizes[r.source])


def test_encoding_of_all_rows(spark, odd):
    out = corpus_pipeline.encoding(spark, odd, "").collect()
    assert sorted((str(r.doc_id), r.decoded_sha256) for r in out) == sorted((str(r.doc_id), hashlib.sha256((r.text or "").encode()).hexdigest()) for r in odd.collect())


def test_near_duplicates_and_repeats_take_odd_rows(spark, odd):
    near = corpus_pipeline.near_duplicate_groups(spark, odd, "")
    assert near.columns == odd.columns and [r.text for r in near.where("doc_id is null").collect()] == ["no id here"]
    cut = corpus_pipeline.repeated_passages(spark, odd, "")
    assert cut.columns == odd.columns and cut.count() == odd.count()


@pytest.mark.parametrize("stage", [f for _, f in corpus_pipeline.STAGES], ids=[n for n, _ in corpus_pipeline.STAGES])
def test_stages_take_an_empty_table(spark, docs, stage, tmp_path):
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert stage(spark, docs.where("false"), str(tmp_path)).count() == 0
