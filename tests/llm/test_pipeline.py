"""The pipeline's stages against plain Python, on a small corpus."""

import numpy as np
import pytest
import sentencepiece
from pyspark.sql import functions as F

import corpus_pipeline as C
from tidewater.llm import queries


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    deal = np.random.default_rng(11)
    words = ["".join(deal.choice(list("abcdefghiklmnoprstuv"), int(deal.integers(3, 8)))) for _ in range(400)]
    rows, labels = [], []
    for i in range(240):
        bad = i % 8 == 1
        lines = [" ".join(deal.choice(words, 25)) for _ in range(4)]
        if bad:
            lines[1] += " rotten scoundrel rotten scoundrel"
        if i % 3 == 0:
            lines.append("A common line that many documents share with one another")
        rows.append((i, "\n".join(lines)))
        if i < 200:
            labels.append((i, 1, int(bad)))
    rows += [(300, rows[0][1]), (301, rows[2][1].replace(words[0], "swapped"))]
    at = tmp_path_factory.mktemp("sf")
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("lang", F.lit("en")).withColumn("source", F.lit("s")).withColumn("n_chars", F.length("text").cast("long"))
    docs.write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
    return str(at)


def test_stages_in_turn(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    kept = {}
    for name, stage in C.STAGES:
        out = stage(spark, docs, folder)
        if name != "sentencepiece":
            assert out.columns == docs.columns
            assert out.schema == docs.schema or [f.dataType for f in out.schema] == [f.dataType for f in docs.schema]
        docs = spark.createDataFrame(out.collect(), out.schema)
        kept[name] = {r.doc_id for r in docs.collect()}
    clean = {i for i in range(240) if i % 8 != 1}
    assert clean <= kept["toxicity"] and len(kept["toxicity"] - clean - {300, 301}) <= 15
    assert 300 not in kept["line_dedup"] and clean <= kept["line_dedup"]
    assert clean <= kept["ngram_join"] and clean <= kept["mixing"]
    assert kept["sentencepiece"] == kept["mixing"]


def test_run_gives_the_last_stage(spark, folder):
    library = sentencepiece.SentencePieceProcessor(model_file=queries.model_path())
    got = C.run(spark, folder).collect()
    assert len(got) > 200 and all(r.n_tokens > 2 for r in got)
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    first = next(r for r in got if r.doc_id == 4)
    assert first.n_tokens == len(library.encode(docs[4])) + 2


def test_empty_corpus(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet").where("false")
    for _, stage in C.STAGES:
        docs = stage(spark, docs, folder)
        assert docs.collect() == []
