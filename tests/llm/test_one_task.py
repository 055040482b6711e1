"""Only bounded rows go to one task."""

import os


def test_training_reads_documents_in_all_tasks(spark, tmp_path):
    from stratarc.llm.toxicity import fit

    def read(batches, at=str(tmp_path)):
        import pyspark

        open(f"{at}/{pyspark.TaskContext.get().partitionId()}", "w").close()
        yield from batches

    docs = spark.createDataFrame([(i, f"text {i}", "en") for i in range(400)], "doc_id bigint, text string, lang string").repartition(6)
    labels = spark.createDataFrame([(i, i % 2) for i in range(400)], "doc_id bigint, toxic int")
    assert fit(docs.mapInArrow(read, docs.schema), labels)
    assert len(os.listdir(tmp_path)) == 6
