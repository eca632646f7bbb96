from martlight.llm import base


def test_a_worker_keeps_the_store_of_the_running_operator_only():
    mine, other = base.worker_store("mine"), base.worker_store("other")
    mine["a"], other["b"] = 1, 2
    base.release("mine")
    assert base.worker_store("mine") is mine and mine == {"a": 1} and not other
    base.release()
    assert not mine


def test_batches_of_texts_are_small(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")
    docs = spark.range(3 * base.BATCH, numPartitions=1).selectExpr("id", "'text' AS text")

    def sizes(batches):
        import pyarrow as pa

        for batch in batches:
            yield pa.RecordBatch.from_pydict({"n": [batch.num_rows]}, schema=pa.schema([("n", pa.int64())]))

    assert {r["n"] for r in base.map_texts(docs, sizes, "n long").collect()} == {base.BATCH}
