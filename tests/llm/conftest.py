import pytest


@pytest.fixture(scope="session")
def docs(spark):
    """200 documents and the awkward ones: null, empty, blank, long, repeated, odd symbols, clashing columns."""
    from pyspark.sql import functions as F

    d = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text", "lang", "source")
    odd = [
        (900001, None, None, None),
        (900002, "", "en", "src1"),
        (900003, " \n\t ", "en", None),
        (900004, "word " * 6000, "en", "src0"),
        (900005, "x" * 150 + "ab" * 700, None, "src0"),
        (900006, "Ünïcode ’tis don't   <|endoftext|>\r\n漢字 ½ Ⅷ 🎉", "zz", "é"),
        (900007, "Licensed undr the Apache Lisense, Version 2.0; mit license MIT LICENSE cc-by-sa", "en", "src0"),
        (900008, "é" * 120 + "k", "fr", "src2"),
        (900009, "é" * 120 + "m", "fr", "src2"),
        (None, "a text without an id", "en", "src3"),
    ]
    more = spark.createDataFrame(odd, d.schema)
    out = d.unionByName(more).union(d.limit(1)).union(more.where("doc_id = 900006"))
    return out.withColumns({"n_tokens_": F.lit(1), "id": F.lit("x"), "row": F.lit(2), "sig": F.lit(3), "key": F.lit(4), "block": F.lit(5)}).cache()


@pytest.fixture(scope="session")
def rows(docs):
    return [(r.doc_id, r.text, r.lang, r.source) for r in docs.collect()]


@pytest.fixture(scope="session")
def none(docs):
    """The same columns and no rows."""
    return docs.where("false")


@pytest.fixture(scope="session")
def by_id():
    """Rows of a frame as sorted tuples, null ids first."""
    return lambda df, *cols: sorted((tuple(r) for r in df.select(*cols).collect()), key=lambda t: tuple((x is not None, str(x)) for x in t))
