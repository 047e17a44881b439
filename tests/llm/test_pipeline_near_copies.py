import corpus_pipeline
from tabspark.llm import quality, toxicity
from tests.llm.test_near_copies import plain_kept


def test_run_keeps_the_smallest_of_each_jaccard_component(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    labels = spark.read.parquet(f"{small}/labels.parquet")
    good, clean = quality.train(docs, labels), toxicity.train(docs, labels)
    kept = {r["doc_id"]: r["text"] for r in docs.collect()}
    kept = {k: t for k, t in kept.items() if good.scores([t])[0] >= quality.THRESHOLD}
    kept = {k: t for k, t in kept.items() if clean.scores([t])[0] < toxicity.THRESHOLD}
    found = {p["doc_id"] for r in corpus_pipeline.run(spark, small).collect() for p in r["pieces"]}
    assert found == plain_kept(kept)[0]
