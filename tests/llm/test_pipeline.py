import random

import corpus_pipeline


def test_stages_keep_clean_documents(spark, tmp_path):
    r = random.Random(6)
    word = lambda: "".join(r.choice("abcdefghij") for _ in range(6))
    text = lambda n: " ".join(word() for _ in range(n))
    bench = [(i, text(20)) for i in range(5)]
    docs = [(i, "\n".join(text(30) for _ in range(3)), "en", "s", 1) for i in range(120)]
    toxic = {i for i in range(0, 120, 4)}
    docs = [(i, t + "\nwhat a vilebad " + word() if i in toxic else t, *rest) for i, t, *rest in docs]
    clean = {i for i in range(120)} - toxic
    shared = text(60)
    docs += [(200, docs[1][1], "en", "s", 1), (201, docs[2][1].replace(docs[2][1].split()[7], "other", 1), "en", "s", 1), (202, text(40) + "\n" + bench[2][1], "en", "s", 1)]
    docs += [(203, text(50) + "\n" + shared, "en", "s", 1), (204, text(50) + "\n" + shared, "en", "s", 1), (205, None, "en", "s", 0), (206, "", "en", "s", 0)]
    schema = "doc_id long, text string, lang string, source string, n_chars int"
    spark.createDataFrame(docs, schema).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 1, int(i in toxic)) for i in range(120)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame(bench, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert [s for s, _ in corpus_pipeline.STAGES] == ["toxicity", "line dedup", "minhash near-dedup", "benchmark decontamination", "sentencepiece"]
    out = {x.doc_id: x for x in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert clean <= set(out) and not toxic & set(out)
    assert not {200, 202} & set(out) and {203, 204, 205, 206} <= set(out)
    assert shared in out[203].text and shared not in out[204].text
    assert all(x.round_trip for x in out.values() if x.text is not None)
