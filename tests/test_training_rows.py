from tabspark.operators.models import train
from tabspark.plans.model_queries import labelled_documents


def test_texts_are_measured_once(spark, small):
    """What prepares and assesses the rows reads their written measures and no text."""
    rows = labelled_documents(spark, small)
    assert not [f for f in rows.inputFiles() if "documents" in f]
    text = spark.read.parquet(f"{small}/documents.parquet").join(
        spark.read.parquet(f"{small}/labels.parquet").select("doc_id"), "doc_id").select("doc_id", "text").collect()
    wanted = {r["doc_id"]: sum(c in "0123456789" for c in r["text"]) for r in text}
    assert {r["doc_id"]: r["n_digits"] for r in rows.collect()} == wanted


def test_all_folds_are_fitted_at_once():
    assert train.FITS_AT_ONCE >= 5
