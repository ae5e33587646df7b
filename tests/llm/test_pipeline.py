"""The pipeline's stages on a small table."""

import random

from pyspark.sql import functions as F


def test_stages(spark, tmp_path):
    import corpus_pipeline

    rng = random.Random(7)
    kinds = {"xx": "the and of that with ing".split(), "yy": "der die und nicht ein ung".split()}
    text = lambda k, n: " ".join(rng.choice(kinds[k]) + rng.choice(["", "er", "en", "ly", "ab", "or"]) + rng.choice("abcdefg") for _ in range(n))
    rows = [(i, text(k, 60), k, f"s{i % 4}", 0) for i in range(120) for k in ["xx" if i % 2 else "yy"]]
    rows += [(200, rows[0][1], "yy", "s0", 0), (201, rows[1][1] + " more", "xx", "s1", 0), (202, None, None, None, 0), (203, "99", None, "s1", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    seen = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs.write.mode("overwrite").parquet(f"{tmp_path}/{name}")
        docs = stage(spark, spark.read.parquet(f"{tmp_path}/{name}"), str(tmp_path))
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        seen[name] = sorted(r[0] for r in docs.select("doc_id").collect())
    assert not {202, 203} & set(seen["language"]) and len(seen["language"]) >= 122
    assert 200 not in seen["exact_copies"] and 201 in seen["exact_copies"] and 201 not in seen["near_copies"]
    assert set(seen["mix"]) <= set(seen["near_copies"]) and len(seen["mix"]) > 0.5 * len(seen["near_copies"])
    out = corpus_pipeline.run(spark, str(tmp_path))
    assert sorted(r[0] for r in out.select("doc_id").collect()) == seen["mix"]
    assert out.where(~F.col("round_trip")).count() == 0
