"""The corpus pipeline, stage by stage, on a small corpus with planted cases."""

import random

import corpus_pipeline
from veldt.llm import ngram_join


def test_stages(spark, tmp_path):
    rng = random.Random(11)
    text = lambda tag, n: [f"{tag}{rng.randrange(10**6)}" for _ in range(n)]
    lines = lambda ws: "\n".join(" ".join(ws[i : i + 12]) for i in range(0, len(ws), 12))
    leak, passage, base = text("q", 30), text("p", 70), text("b", 200)
    near = list(base)
    near[100] = "edited"
    docs = {i: lines(text("c", 120)) for i in range(20)}
    docs |= {20: "too short", 21: "a b c " * 100, 30: lines(base), 31: lines(base), 32: lines(near)}
    docs |= {40: lines(text("d", 90) + passage + text("d", 40)), 41: lines(text("e", 60) + passage + text("e", 99)), 50: lines(text("f", 70) + leak + text("f", 70))}
    rows = [(i, t, "en", "host", len(t)) for i, t in docs.items()] + [(60, None, "en", "host", 0)]
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    spark.createDataFrame([(1, " ".join(leak[5:25]))], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    d.write.parquet(f"{tmp_path}/documents.parquet")
    clean, now, kept = set(range(20)), d, {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, now, str(tmp_path))
        out.write.parquet(f"{tmp_path}/{name}")
        now = spark.read.parquet(f"{tmp_path}/{name}")
        kept[name] = {r.doc_id for r in now.select("doc_id").collect()}
        assert clean <= kept[name]
        if name != "pack":
            assert now.columns == d.columns
    assert kept["quality"] == set(docs) - {20, 21}
    assert kept["near_duplicates"] == kept["quality"] - {31, 32}
    left = {r.doc_id: r.text for r in spark.read.parquet(f"{tmp_path}/passages").collect()}
    assert passage[35] in left[40] and passage[35] not in left[41] and all(left[i] == docs[i] for i in clean | {40})
    assert kept["decontaminate"] == kept["near_duplicates"] - {50} == kept["pack"]
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == now.count()
    assert ngram_join.keep_one(d.limit(0)).count() == 0
