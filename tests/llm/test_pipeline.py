"""The pipeline's stages: decisions take effect, columns stay, odd tables pass."""

import random

import corpus_pipeline
from tallyloom.llm import sentencepiece_codec


def prose(rng, n):
    return ". ".join(" ".join("".join(rng.choice("aeioutnrsl") for _ in range(rng.randint(2, 8))) for _ in range(9)).capitalize() for _ in range(n)) + "."


def test_run_drops_copies_junk_and_leaks(spark, tmp_path):
    rng = random.Random(1)
    good = [prose(rng, 6) for _ in range(120)]
    junk = [" ".join(["spam"] * 60) + str(i) for i in range(60)]
    leak = prose(rng, 3)
    texts = good + junk + [good[0], good[1], f"{prose(rng, 4)} {leak}", prose(rng, 5) + " password=9f86d081884c7d659a2f here"]
    rows = [(i, t, "en", "src", len(t), i) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, score int").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, int(i < 120), 0) for i in range(180)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(0, leak)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = {r.doc_id: r for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert set(range(120)) <= set(got) and not set(got) & {*range(120, 180), 180, 181, 182} and 183 in got
    docs, columns = spark.read.parquet(f"{tmp_path}/documents.parquet"), ["doc_id", "text", "lang", "source", "n_chars", "score"]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == columns and dict(out.dtypes) == dict(docs.dtypes)
    clean = corpus_pipeline.redact_secrets(spark, docs, str(tmp_path)).where("doc_id = 183").first()
    assert clean.text.endswith("password=[SECRET] here") and clean.n_chars == len(clean.text) and clean.score == 183
    assert got[183].ids_sha256 == sentencepiece_codec.digests(corpus_pipeline.public_tokenizers.path("piece_bpe_32k.model"), clean.text)[1]


def test_empty_tables_and_null_ids(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([(None, "a b c", "en", None, 5), (1, None, None, None, None), (1, None, None, None, None)], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    assert sorted((r.doc_id or 0, r.n_tokens) for r in corpus_pipeline.run(spark, str(tmp_path)).collect()) == [(0, 3), (1, 0)]
