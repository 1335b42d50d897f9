"""Languages of texts that the model has not seen."""

from pyspark.sql import functions as F

from newsprism.operators import language

SF = "/root/testdata/sf0.001"


def test_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").where("text is not null and lang is not null").selectExpr("doc_id as id", "text", "lang as language")
    held = F.crc32(F.col("id").cast("string")) % 4 == 2
    found = language.detect(docs.where(held).select("id", "text"), language.train(docs.where(~held)))
    told_of = {r.id: r.language for r in docs.select("id", "language").collect()}
    rows = [(r.language, told_of[r.id]) for r in found.collect()]
    told = [r for r in rows if r[0] is not None]
    assert len(told) >= 0.9 * len(rows) > 20 and sum(got == want for got, want in told) >= 0.95 * len(told)
    plan = found._jdf.queryExecution().toString()
    assert "Python" not in plan and "Pandas" not in plan


def test_language_odd(spark):
    known = spark.createDataFrame([(1, "the house and the garden of the king", "en"), (2, "das Haus und der Garten des Königs", "de"), (3, None, "de"), (4, "abc", None)], "id long, text string, language string")
    model = language.train(known)
    texts = spark.createDataFrame([(1, "the garden and the house"), (2, "der Garten und das Haus der Könige"), (3, "the"), (4, None), (5, "1234567890 1234567890 !!"), (6, "zzzzzz qqqqqq xxxxxx jjjjjj")], "id long, text string")
    got = {r.id: r.language for r in language.detect(texts, model).collect()}
    assert got[1] == "en" and got[2] == "de" and got[3] is None and got[4] is None and got[5] is None and got[6] in ("de", "en")
    assert language.detect(texts.limit(0), model).count() == 0
