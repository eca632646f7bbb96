import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def documents(spark):
    """Makes a documents table of ``(doc_id, text)`` or ``(doc_id, text, source)`` rows over several partitions."""

    def make(rows, extra=()):
        full = [(r[0], r[1], "en", r[2] if len(r) > 2 else "s", len(r[1]) if r[1] is not None else None) for r in rows]
        df = spark.createDataFrame(full, SCHEMA).repartition(3)
        for name in extra:
            from pyspark.sql import functions as F

            df = df.withColumn(name, F.lit("clash"))
        return df

    return make


@pytest.fixture(scope="session")
def odd_rows():
    """Null, empty, blank and very long texts, repeated rows, and a row without id."""
    long = " ".join(f"w{i % 997} of the {i}" for i in range(30_000))
    same = "the same words are written here more than once in the table"
    return [(1, None), (2, ""), (3, " \n\t "), (4, long), (5, same), (5, same), (6, same), (None, same), (None, None), (7, "x")]
