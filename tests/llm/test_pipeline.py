import corpus_pipeline
from recordloom.llm import near_dedup


def test_each_stage_works_on_what_the_one_before_kept(spark):
    sf_dir = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns, sizes = docs.columns, [docs.count()]
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "toxicity", "near_dedup", "mixing", "packing"]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = corpus_pipeline.written(stage(spark, docs, sf_dir))
        assert docs.columns == columns
        sizes.append(docs.count())
        if name == "near_dedup":
            left = near_dedup.near_duplicates(docs)
            assert left.where("kept").count() == sizes[-1]
    assert sizes[0] > sizes[1] >= sizes[2] > sizes[3]
    assert corpus_pipeline.run(spark, sf_dir).count() == sizes[4]
