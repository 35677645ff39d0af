"""An index by document and by zone: what is made, what is read, and that no posting moves or is met twice."""

import pytest
from pyspark.sql import functions as F

from lekhani.functions import text as T
from lekhani.operators import index as ix
from lekhani.plans import retrieval_queries as q
from lekhani.plans.systems import Engine

TEXTS = [(1, "chai\nsubah ki chai रेलगाड़ी"), (2, "शाम की चाय 1947"), (3, None), (4, "kheton mein dhaan"), (4, "chai chai")]


@pytest.fixture
def folder(spark, tmp_path):
    spark.createDataFrame(TEXTS, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    return str(tmp_path)


def test_a_search_makes_its_zones_only(spark, folder, monkeypatch):
    made, whole = [], ix.zone_postings
    monkeypatch.setattr(ix, "zone_postings", lambda docs, zones, *more: made.append(list(zones)) or whole(docs, zones, *more))
    ask = spark.createDataFrame([(1, "chai")], "qid long, text string")
    for system, want in (("B0", ["raw"]), ("B1", ["all"]), ("S2", ["dhvani"]), ("S1", None)):
        assert Engine(q.ready_index(spark, folder)).search(ask, system).count() > 0
        assert made.pop() == want if want else not made
    own = q.ready_index(spark, folder).only(["all", "dhvani", "dhvani"])
    assert {tuple(r) for r in own.postings.groupBy("zone", "term", "doc_id").count().where("count > 1").collect()} == set()


def test_postings_are_summed_where_texts_were_cut(spark, folder):
    docs = ix.corpus(spark.read.parquet(f"{folder}/documents.parquet"))
    plan = ix.zone_postings(docs, ["all", "title", "dhvani", "nostem"], False, 3)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1
    a = ix.postings(ix.zone_terms(docs), False)
    b = ix.zone_postings(docs, positions=False, parts=3)
    columns = ["zone", "term", "doc_id", "tf"]
    assert sorted(map(tuple, a.select(columns).collect())) == sorted(map(tuple, b.select(columns).collect()))


def test_places_without_kept_positions(spark, folder):
    docs = ix.corpus(spark.read.parquet(f"{folder}/documents.parquet"))
    terms, run = (spark.createDataFrame(rows, kind) for rows, kind in (([("CY",), ("SBH",)], "term string"), ([(1,), (2,)], "doc_id long")))
    rows = [sorted((r["term"], r["doc_id"], tuple(r["positions"])) for r in ix.Index(docs, ["dhvani"], positions).places("dhvani", terms, run).where(F.col("term").isin("CY", "SBH") & F.col("doc_id").isin(1, 2)).collect()) for positions in (True, False)]
    assert rows[0] == rows[1] and len(rows[0]) == 2


def test_ascii_needs_no_python(spark):
    words = ["abc", "é", "é", "बन्दर", "a‍b", "", None]
    got = spark.createDataFrame([(i, w) for i, w in enumerate(words)], "i int, t string").select("i", T.compose(F.col("t")).alias("c")).orderBy("i").collect()
    assert [r["c"] for r in got] == ["abc", "é", "é", "बन्दर", "a‍b", "", None]
