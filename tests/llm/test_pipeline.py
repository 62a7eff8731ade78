def test_stages_follow_each_other(spark):
    import corpus_pipeline as p

    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    assert [n for n, _ in p.STAGES] == ["language_id", "line_dedup", "near_dedup", "mixture", "bpe_ids"]
    kept = docs
    for name, stage in p.STAGES[:-1]:
        out = p.written(stage(spark, kept, sf))
        assert out.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        if name in ("language_id", "line_dedup"):
            assert out.count() == docs.count()  # no document here is without a language
        kept = out
    direct = p.run(spark, sf)
    staged = p.STAGES[-1][1](spark, kept, sf)
    assert sorted(map(tuple, direct.select("doc_id", "n_tokens").collect())) == sorted(map(tuple, staged.select("doc_id", "n_tokens").collect()))
    assert direct.where("not round_trip").count() == 0
    assert p.run(spark, sf).where("n_tokens = 0").count() == 0
