from lekhani.operators import index as ix
from lekhani.operators import retrieval as rank


def test_a_grid_makes_no_row_for_a_term_and_a_point(spark):
    docs = spark.createDataFrame([(1, "chai", "subah ki chai"), (2, "", "chai doodh")], "doc_id long, title string, body string")
    terms = rank.query_terms(spark.createDataFrame([(1, "chai doodh")], "qid long, text string"), "all")
    points = spark.createDataFrame([(0.9, 0.3), (1.4, 0.6)], "k1 double, b double")
    plan = rank.bm25_grid(terms, ix.Index(docs, ["all"], False), points)
    text = plan._jdf.queryExecution().optimizedPlan().toString()
    assert "Join Cross" not in text and "k1" in plan.columns and plan.count() == 4
