import math

import pytest

from lekhani.functions import text as T
from lekhani.operators import boolean, dense
from lekhani.operators import evaluation as ev
from lekhani.operators import index as ix
from lekhani.operators import retrieval as rank
from lekhani.operators.retrieval import Params
from lekhani.plans.systems import Engine

#: Six short documents in two scripts; words that sound alike stand in both.
TOY = [
    (10, "रेलगाड़ी", "सुबह की रेलगाड़ी जयपुर से चली और शाम को पहुँची"),
    (11, "chai", "subah ki chai adrak aur doodh ke saath banti hai"),
    (12, "पुस्तकालय", "शहर के पुस्तकालय में नई किताबें आई हैं"),
    (13, "bazaar", "shahar ke bazaar mein kitaben aur chai sab milte hain"),
    (14, "खेत", "वर्षा के बाद खेत में धान की फसल हरी है"),
    (15, "", "kheton mein dhaan aur aam ke ped"),
]


@pytest.fixture(scope="module")
def index(spark):
    return ix.Index(spark.createDataFrame(TOY, "doc_id long, title string, body string"), keep=lambda _, make: make().persist())


def ask(spark, text):
    return spark.createDataFrame([(1, text)], "qid long, text string")


def ids(df):
    return sorted(r["doc_id"] for r in df.collect())


def content(text):
    return [w for w in text.split() if T.plain_normalize(w) not in T.STOP_WORDS]


def test_df_and_bm25_formula(spark, index):
    post = {(r["doc_id"], r["tf"]) for r in index.postings.where("zone = 'all' and term = 'chai'").collect()}
    assert post == {(11, 2), (13, 1)} and index.term_stats.where("zone = 'all' and term = 'chai'").first()["df"] == 2
    lengths = {i: len(content(f"{t} {b}")) for i, t, b in TOY}
    assert {r["doc_id"]: r["doc_len"] for r in index.doc_stats.where("zone = 'all'").collect()} == lengths
    run = {r["doc_id"]: r["score"] for r in Engine(index, Params(1.4, 0.6)).search(ask(spark, "chai"), "B1").collect()}
    idf, avg = math.log(1 + (6 - 2 + 0.5) / 2.5), sum(lengths.values()) / 6
    assert run == {i: pytest.approx(idf * tf * 2.4 / (tf + 1.4 * (0.4 + 0.6 * lengths[i] / avg)), abs=1e-6) for i, tf in ((11, 2), (13, 1))}


def test_grid_gives_what_single_searches_give(spark, index):
    points = [(0.9, 0.3), (1.4, 0.6)]
    q = ask(spark, "chai kitaben")
    e = Engine(index)
    got = {(r["k1"], r["b"], r["doc_id"], r["score"], r["rank"]) for r in rank.bm25_grid(e.terms(q, "B1"), index, spark.createDataFrame(points, "k1 double, b double")).collect()}
    assert got == {(k1, b, r["doc_id"], r["score"], r["rank"]) for k1, b in points for r in Engine(index, Params(k1, b)).search(q, "B1", 100).collect()}


def test_across_scripts(spark, index):
    for word, both in (("subah", {10, 11}), ("शहर", {12, 13}), ("dhaan", {14, 15})):
        assert set(ids(Engine(index).search(ask(spark, word), "S1"))) == both
        assert rank.pooled_df(ask(spark, word), index).first()["df"] == 2
    # Soundex codes of Devanagari tokens are those of their romanisation.
    assert set(ids(Engine(index).search(ask(spark, "subah"), "S0"))) >= {10, 11}
    assert set(ids(Engine(index).search(ask(spark, "dhaan"), "B2"))) >= {14}


def test_boolean_and_phrases(spark, index):
    def search(q):
        return ids(boolean.boolean_search(boolean.clauses(spark, [(1, q)]), index.postings))

    assert search("chai AND kitaben") == [13] and search("chai AND NOT kitaben") == [11] and search("adrak OR खेत") == [11, 14] and search("NOT chai") == []
    terms = ix.zone_terms(index.docs, ["all"])
    assert ids(boolean.phrase_search(ask(spark, "adrak aur doodh"), terms)) == [11] and ids(boolean.phrase_search(ask(spark, "doodh aur adrak"), terms)) == []
    a, b = list(range(0, 700, 3)), list(range(0, 700, 90))
    (x, n), (y, m) = boolean.skip_merge(a, b), boolean.skip_merge(a, b, False)
    assert x == y == sorted(set(a) & set(b)) and n < m


def test_windows(spark):
    rows = [(1, 1, "a", [1, 10]), (1, 1, "b", [3, 20]), (1, 2, "a", [5]), (1, 2, "b", [5]), (1, 3, "a", [1])]
    got = {r["doc_id"]: (r["window"], r["proximity"]) for r in rank.smallest_windows(spark.createDataFrame(rows, "qid long, doc_id long, term string, positions array<int>")).collect()}
    assert got == {1: (3, 0.5), 2: (1, 1.0), 3: (0, 0.0)}


def test_cosine_and_fusion(spark, index):
    run = Engine(index).search(ask(spark, "शहर पुस्तकालय"), "V1").collect()
    assert run[0]["doc_id"] == 12 and run[0]["score"] <= 1
    a, b = (spark.createDataFrame([(1, d, i + 1) for i, d in enumerate(x)], "qid long, doc_id long, rank int") for x in ([1, 2, 3], [2, 3, 1]))
    assert rank.rrf(a, b).where("rank = 1").first()["doc_id"] == 2


def test_top_k_ties(spark):
    scores = spark.createDataFrame([(1, 0, 0.0), (1, 1, 3.0), (1, 2, 1.0), (1, 3, 3.0)], "qid long, doc_id long, score double")
    assert [r["doc_id"] for r in rank.top_k(scores, 3).orderBy("rank").collect()] == [1, 3, 2]


def test_save_and_load(spark, index, tmp_path):
    index.save(str(tmp_path))
    back = ix.Index.load(spark, str(tmp_path))
    for name in ix.Index.TABLES:
        columns = sorted(index.tables[name].columns)
        rows = [sorted(map(repr, t.select(*columns).collect())) for t in (index.tables[name], back.tables[name])]
        assert rows[0] == rows[1] and rows[0]
    q = ask(spark, "subah chai")
    assert Engine(back).search(q, "S3").collect() == Engine(index).search(q, "S3").collect()


def test_postings_are_those_of_all_places(spark, index):
    """By the dictionary of distinct tokens, and from one row for each place."""
    places = ix.postings(ix.zone_terms(index.docs), True)
    a, b = ({(r["zone"], r["term"], r["doc_id"], r["tf"]) for r in t.collect()} for t in (places, index.postings))
    assert a == b
    a, b = ({(r["zone"], r["term"], r["doc_id"], tuple(r["positions"])) for r in t.where(f"zone in ('all', 'dhvani')").collect()} for t in (places, index.postings))
    assert a == b


def test_metrics(spark):
    run = spark.createDataFrame([(1, d, d) for d in (1, 2, 3, 4, 5)], "qid long, doc_id long, rank int")
    qrels = spark.createDataFrame([(1, 2, 1), (1, 4, 1), (1, 9, 1), (2, 1, 1), (3, 1, 0)], "qid long, doc_id long, rel int")
    got = {r["qid"]: r for r in ev.per_query(run, qrels).collect()}
    assert got[1]["p5"] == 2 / 5 and got[1]["recall100"] == pytest.approx(2 / 3) and got[1]["mrr10"] == 0.5
    assert set(got) == {1, 2} and got[2]["ndcg10"] == 0
    same = ev.rbo(run, run).first()["rbo"]
    assert same == pytest.approx(1)
    other = spark.createDataFrame([(1, 100 + d, d) for d in (1, 2)], "qid long, doc_id long, rank int")
    assert ev.rbo(run, other).first()["rbo"] == 0


def test_consistency_of_scripts_and_timing(spark, index):
    e = Engine(index)
    q = spark.createDataFrame([(1, "शहर"), (2, "chai"), (3, "सुबह")], "qid long, text string")
    got = {(r["system"], r["qid"]): r for r in e.consistency(q, ["S1", "B1"]).collect()}
    assert set(got) == {("S1", 1), ("S1", 3), ("B1", 1), ("B1", 3)} and got["S1", 1]["roman"] == "shahar"
    assert got["S1", 1]["shared_top10"] == 2 and got["S1", 1]["rbo"] > 0.8 and got["B1", 1]["shared_top10"] == 0 and got["B1", 1]["rbo"] == 0
    rows, ms = e.timed_search(q, "S1", 3)
    assert [(r["qid"], r["rank"]) for r in rows][:2] == [(1, 1), (1, 2)] and ms > 0


def test_encoder_hook(spark):
    def encoder(texts):
        return [[len(t), t.count("a"), 1.0] for t in texts]

    rows = spark.createDataFrame([(i, t) for i, t in enumerate(["banana", "", None, "a" * 500, "kela"])], "doc_id int, text string")
    got = {r["doc_id"]: r["v"] for r in dense.encode(rows, encoder, prefix="passage: ", batch=2).collect()}
    for i, t in enumerate(["banana", "", "", "a" * 500, "kela"]):
        raw = [len(t) + 9, t.count("a") + 2, 1.0]
        size = math.sqrt(sum(x * x for x in raw))
        assert got[i] == pytest.approx([x / size for x in raw])


def test_pruned_vocabulary(spark):
    vocabulary = spark.createDataFrame([("<unk>", 3), ("b", 1 << 40), ("a", 7), ("c", 2), ("d", 5 << 38)], "token string, id long")
    used = spark.createDataFrame([("b",), ("a",), ("zz",), ("a",)], "token string")
    pruned = dense.prune_vocabulary(vocabulary, used)
    assert {r["token"]: r["new_id"] for r in pruned.collect()} == {"<unk>": 0, "a": 1, "b": 2, "c": 0, "d": 0}
    table = spark.createDataFrame([(i, [float(i)]) for i in (3, 1 << 40, 7, 2, 5 << 38)], "id long, v array<double>")
    assert [(r["new_id"], r["v"]) for r in dense.select_rows(table, pruned).collect()] == [(0, [3.0]), (1, [7.0]), (2, [float(1 << 40)])]


def test_pairs_and_pivot(spark):
    rows = [(s, f, q, v) for s, k in (("B1", 0.2), ("S1", 0.5)) for f, m in (("F1", 1.0), ("F2", 0.5)) for q in range(8) for v in [k * m + 0.01 * q]]
    scores = spark.createDataFrame(rows, "system string, form string, qid long, ndcg10 double")
    got = {(r["pair"], r["form"]): r for r in ev.pair_table(scores, [("S1", "B1"), ("S3", "B1")], permutations=400).collect()}
    assert set(got) == {("S1-B1", "F1"), ("S1-B1", "F2")} and got["S1-B1", "F1"]["observed"] == pytest.approx(0.3) and got["S1-B1", "F1"]["n"] == 8 and got["S1-B1", "F1"]["p"] < 0.05
    table = {r["system"]: r for r in ev.pivot(scores.groupBy("system", "form").agg({"ndcg10": "avg"}).withColumnRenamed("avg(ndcg10)", "ndcg10"), "ndcg10", ["F1", "F2"]).collect()}
    assert table["S1"]["range"] == pytest.approx(0.25) and table["B1"]["F1"] - table["B1"]["F2"] == pytest.approx(0.1)
