"""The pipeline against its stages' operators, on a small table."""

import random

import corpus_pipeline
from siltstone.llm import registry


def test_stages(spark, tmp_path):
    rng = random.Random(1)
    words = ["".join(rng.choice("abcdefg") for _ in range(5)) for _ in range(400)]
    item = "what is the sum of all the numbers that the teacher wrote on the board"
    rows = [(i, " ".join(rng.choices(words, k=60)) + (f" mail{i}@x.org" if i % 10 == 0 else ""), "en", "s") for i in range(150)]
    rows += [(200, rows[3][1], "en", "s"), (201, rows[4][1] + " end", "en", "s"), (202, rows[5][1] + "\n" + item, "en", "s"), (203, None, None, None), (204, "too short", "en", "s")]
    docs = spark.createDataFrame([(*r, len(r[1] or ""), "extra") for r in rows], "doc_id long, text string, lang string, source string, n_chars long, more string")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert 4 <= len(corpus_pipeline.STAGES) <= 5
    kept = {r.doc_id for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert kept == set(range(150))
    stage = dict(corpus_pipeline.STAGES)["surrogates"]
    masked = stage(spark, spark.read.parquet(f"{tmp_path}/documents.parquet"), str(tmp_path))
    assert masked.columns == list(corpus_pipeline.COLUMNS) and masked.where("text like '%mail0@%'").count() == 0
    assert masked.where("n_chars <> length(text)").count() == 0


def test_names():
    assert sorted(int(n[2:].split("_")[0]) for n in registry.queries()) == list(range(1, 11))
