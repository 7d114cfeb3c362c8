import brute
import corpus_pipeline
from lumenrec.llm.storage import materialize


def test_stages_in_a_row(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns, before = docs.columns, docs
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        after = materialize(stage(spark, before, sf))
        old, new = before.select("doc_id").distinct(), after.select("doc_id").distinct()
        assert new.count() and not new.join(old, "doc_id", "left_anti").count()
        if i < 4:
            assert after.columns == columns
        if name == "n-gram Jaccard join":
            sets = {r["doc_id"]: brute.shingles(r["text"]) for r in after.collect()}
            assert brute.jaccard_links(sets) == []
        before = after
    assert corpus_pipeline.run(spark, sf).count() > 0


def test_empty_documents(spark, sf, tmp_path):
    spark.read.parquet(f"{sf}/documents.parquet").limit(0).write.parquet(f"{tmp_path}/documents.parquet")
    spark.read.parquet(f"{sf}/labels.parquet").write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_a_score_column_of_the_documents_stays(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").selectExpr("doc_id", "doc_id * 2.5 as score", "text")
    kept = corpus_pipeline.drop_toxic(spark, docs, sf)
    assert kept.columns == docs.columns
    assert kept.where("score <> doc_id * 2.5").isEmpty() and 0 < kept.count() < docs.count()
