from pyspark.sql import functions as F

from lekhani.operators import analytics as an


def test_terms_are_counted_where_texts_were_cut(spark):
    docs = spark.createDataFrame([(1, "chai ki Chai"), (2, "é chai"), (3, None)], "doc_id long, text string")
    plan = an.frequencies(docs, 3)
    assert {(r["term"], r["cf"], r["df"]) for r in plan.collect()} == {("chai", 3, 2), ("ki", 1, 1)}
    # Texts by document, counts by term; the pairs of both stay where they are.
    assert docs.select(F.lit(1)).count() == 3 and an.frequencies(docs, 3)._jdf.queryExecution().executedPlan().toString().count("Exchange hash") == 2
