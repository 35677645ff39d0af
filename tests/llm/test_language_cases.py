"""Language identification on texts without letters, repeats, ties, clashing columns and empty tables; and held out."""

import pyspark.sql.functions as F

from lekhani.llm import language
from lekhani.llm.common import id_bucket, table


def test_held_out_accuracy(spark):
    out = language.op1_language(spark, "/root/testdata/sf0.01").where("held_out")
    rows = out.join(table(spark, "/root/testdata/sf0.01", "documents").select("doc_id", "lang"), "doc_id").where("lang is not null and lang_pred <> 'und'")
    assert rows.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0] > 0.97


def test_cases(spark):
    docs = table(spark, "/root/testdata/sf0.001", "documents")
    model = language.train(docs.where(id_bucket("doc_id", 5) != 0))
    texts = ["²", "½ ¾", "١٢٣", "123 _ !", "", None, "der Hund und die Katze " * 20_000, "der Hund und die Katze", "der Hund und die Katze"]
    rows = spark.createDataFrame([(i if i else None, t, "xx", 1.0) for i, t in enumerate(texts)], "doc_id int, text string, lang_pred string, score double")
    out = language.identify(rows, model)
    got = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in out.collect()}
    assert out.dtypes[0] == ("doc_id", "int") and len(got) == len(texts)
    assert all(got[k] == ("und", 0.0) for k in (None, 1, 2, 3, 4, 5)) and got[7] == got[8] and got[6][0] == got[7][0] in model.languages
    assert language.identify(rows.limit(0), model).count() == 0
    assert language.train(docs.limit(0)) is None and {r["lang_pred"] for r in language.identify(rows, None).collect()} == {"und"}


def test_repeats_do_not_swell_the_sample(spark):
    rows = [("same words again", "aa")] * 3000 + [(f"text {i}", "bb") for i in range(50)]
    drawn = language.train(spark.createDataFrame(rows, "text string, lang string"))
    assert drawn.languages == ["aa", "bb"]
    got = language.identify(spark.createDataFrame([(1, "same words again"), (2, "text 7")], "doc_id long, text string"), drawn).collect()
    assert {r["doc_id"]: r["lang_pred"] for r in got} == {1: "aa", 2: "bb"}


def test_ties_go_to_the_first_language(spark):
    rows = [("equal words here", "bb"), ("equal words here", "aa")]
    model = language.train(spark.createDataFrame(rows, "text string, lang string"))
    got = language.identify(spark.createDataFrame([(1, "equal words here")], "doc_id long, text string"), model).first()
    assert got["lang_pred"] == "aa" and got["ambiguous"]
