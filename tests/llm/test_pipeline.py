"""The pipeline's stages against brute force on a small fixture, and the registered queries."""

import random

import pytest

import corpus_pipeline
from strandlake.llm import queries


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    r = random.Random(8)
    vocabulary = "the house was built near a river and people walk there every morning with their children because weather seems fine today while birds sing over old green trees beside stone bridges".split()
    text = lambda n: " ".join(r.choice(vocabulary) for _ in range(n))
    passage, leak = text(60), text(30)
    rows = [(i, "\n".join(text(45) for _ in range(3)), "en", "s", 0) for i in range(12)]
    rows.append((20, rows[0][1], "en", "s", 0))
    rows.append((21, rows[1][1].replace("\n", " "), "en", "s", 0))
    rows += [(30 + i, f"{text(70)}\n{passage}", "en", "s", 0) for i in range(3)]
    rows.append((40, f"{text(40)} {leak} {text(40)}", "en", "s", 0))
    rows += [(50, "too short", "en", "s", 0), (51, None, "en", "s", 0), (52, "", None, None, None)]
    at = str(tmp_path_factory.mktemp("corpus"))
    spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint").write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame([(1, leak)], "item_id bigint, text string").write.parquet(f"{at}/benchmark.parquet")
    return at, {r[0]: r[1] for r in rows}, passage, leak


def test_stages(spark, folder):
    at, texts, passage, leak = folder
    docs = spark.read.parquet(f"{at}/documents.parquet")
    columns, kept = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        docs = corpus_pipeline.materialize(stage(spark, docs, at))
        if name != "byte_bpe":
            assert docs.columns == columns
        kept[name] = {r.doc_id: r for r in docs.collect()}
    assert set(kept["quality_rules"]) == set(texts) - {50, 51, 52}
    lines = kept["line_dedup"]
    assert 20 not in lines and passage in lines[30].text and passage not in lines[31].text + lines[32].text
    assert all(lines[i].text == texts[i] and lines[i].n_chars == len(texts[i]) for i in range(12))
    near = kept["near_duplicates"]
    assert 21 not in near and set(range(12)) <= set(near)
    clean = kept["decontamination"]
    assert 40 not in clean and set(clean) == set(near) - {40} and all(clean[i].text == near[i].text for i in clean)
    assert all(r.round_trip and len(r.token_ids) == 4 * r.n_tokens for r in kept["byte_bpe"].values())


def test_run_and_names(spark, folder):
    rows = corpus_pipeline.run(spark, folder[0]).collect()
    assert {r.doc_id for r in rows} == set(range(12)) | {30, 31, 32}
    assert [name.split("_")[0] for name in queries.QUERIES] == [f"op{i}" for i in range(1, 11)]
    assert len(corpus_pipeline.STAGES) == 5 and corpus_pipeline.ORACLE_SQL is None
