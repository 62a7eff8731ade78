import numpy as np
from pyspark.sql import functions as F

from fundstelle.llm import quality
from fundstelle.llm.quality import score_quality

SF = "/root/testdata/sf0.1"


def test_scores_keep_to_the_tables_classes_where_the_sample_is_capped(spark, monkeypatch):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    monkeypatch.setattr(quality, "TRAIN_DOCS_PER_CLASS", 400)  # 3409 good and 571 bad: the sample is half good
    got = score_quality(docs, labels).join(labels.groupBy("doc_id").agg(F.min("quality").alias("quality")), "doc_id").collect()
    share = np.mean([r.quality for r in got])
    means = [np.mean([getattr(r, c) for r in got]) for c in ("p_text", "p_meta", "score")]
    print("share, means of p_text, p_meta and score, kept:", share, means, np.mean([r.keep for r in got]))
    assert abs(means[0] - share) < 0.04 and abs(means[1] - share) < 0.04
