"""Queries over evaluation, learning features, gating and corpus analytics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lekhani.functions import text as T
from lekhani.operators import analytics as an
from lekhani.operators import evaluation as ev
from lekhani.operators import index as ix
from lekhani.operators import learning
from lekhani.operators import retrieval as rank
from lekhani.operators.dense import dot
from lekhani.plans import sql as S
from lekhani.plans.retrieval_queries import VECTORS, WINDOWS, _dot, docs_of, engine, query_vectors, topics, vectors_of
from lekhani.sources.store import kept, parts_of, read_spread

FORMS = ["F1", "F2", "F3"]


def forms(spark: SparkSession, d: str) -> DataFrame:
    """qid = 10 * item + form number, form, text: the topics and two respellings."""
    q = topics(spark, d)
    f2 = F.replace(F.replace(F.replace("text", F.lit("sh"), F.lit("s")), F.lit("ee"), F.lit("i")), F.lit("w"), F.lit("v"))
    f3 = F.replace(F.replace("text", F.lit("th"), F.lit("t")), F.lit("i"), F.lit("ee"))
    return q.select(F.col("qid").alias("item"), F.inline(F.array(*(F.struct((F.col("qid") * 10 + i).alias("qid"), F.lit(f).alias("form"), t.alias("text")) for i, (f, t) in enumerate(zip(FORMS, (F.col("text"), f2, f3), strict=True))))))


def token_lists(spark: SparkSession, d: str) -> DataFrame:
    """doc_id, tokens of every document, written once."""
    source = f"{d}/documents.parquet"
    return kept(spark, "token_lists", [source], lambda: read_spread(spark, source).select("doc_id", T.tokenize(F.col("text")).alias("tokens")))


def qrels(spark: SparkSession, d: str) -> DataFrame:
    """Documents that hold an item's tokens in a row; written once.

    Each item is sought by the token of it that the fewest documents hold: its places give the only starts that the item
    can have, and there the document's tokens are compared. An item without tokens is held by none.
    """
    items_source, source = f"{d}/benchmark.parquet", f"{d}/documents.parquet"

    def make() -> DataFrame:
        held = token_lists(spark, d)
        items = spark.read.parquet(items_source).select(F.col("item_id").alias("qid"), T.tokenize(F.col("text")).alias("item")).where("size(item) > 0")
        words = items.select("qid", F.posexplode("item").alias("offset", "token"))
        wanted = words.select("token").distinct()
        places = held.select("doc_id", F.posexplode("tokens").alias("at", "token")).join(wanted, "token", "left_semi")
        df = places.groupBy("token", "doc_id").agg(F.lit(1)).groupBy("token").agg(F.count("*").alias("df"))
        anchors = words.join(df, "token", "left").groupBy("qid").agg(F.min(F.struct(F.coalesce("df", F.lit(0)), "token", "offset")).alias("a")).select("qid", "a.token", "a.offset")
        starts = places.join(anchors, "token").select("qid", "doc_id", (F.col("at") - F.col("offset")).alias("start")).where("start >= 0")
        met = starts.join(items, "qid").join(held, "doc_id").where(F.slice("tokens", F.col("start") + 1, F.size("item")) == F.col("item"))
        return met.select("qid", "doc_id").distinct().withColumn("rel", F.lit(1))

    return kept(spark, "qrels", [items_source, source], make)


def runs(spark: SparkSession, d: str) -> DataFrame:
    """system, form, qid (the item), doc_id, score, rank of B1 and S1 at 100; written once, as metrics read a run several times."""

    def make() -> DataFrame:
        f = forms(spark, d)
        e, _ = engine(spark, d)
        out = None
        for s in ("B1", "S1"):
            one = e.search(f.select("qid", "text"), s, 100).join(f.select("qid", "item", "form"), "qid").select(F.lit(s).alias("system"), "form", F.col("item").alias("qid"), "doc_id", "score", "rank")
            out = one if out is None else out.unionByName(one)
        return out

    return kept(spark, "runs", [f"{d}/benchmark.parquet", f"{d}/documents.parquet"], make)


def rounded(df: DataFrame, columns: list[str], digits: int = 6) -> DataFrame:
    return df.withColumns({c: F.round(c, digits) for c in columns})


METRICS = ["p5", "p10", "recall100", "mrr10", "ndcg10"]


def scores(spark, d):
    return ev.per_query(runs(spark, d), qrels(spark, d), ["system", "form"])


def eval_metrics(spark, d):
    return rounded(ev.averages(scores(spark, d), ["system", "form"]), METRICS)


def eval_qrels(spark, d):
    return qrels(spark, d)


def eval_rbo_csc(spark, d):
    return rounded(ev.consistency(runs(spark, d).where("system = 'S1'").select("qid", "form", "doc_id", "rank")), ["csc"])


def eval_invariance(spark, d):
    out = ev.invariance(scores(spark, d), FORMS)
    return rounded(out, [c for c in out.columns if c not in ("system", "n_queries")])


def eval_significance(spark, d):
    own = scores(spark, d)
    pairs = own.groupBy("form", "qid").agg(F.max(F.when(F.col("system") == "S1", F.col("ndcg10"))).alias("a"), F.max(F.when(F.col("system") == "B1", F.col("ndcg10"))).alias("b"))
    pairs = pairs.select("form", "qid", F.round("a", 9).alias("a"), F.round("b", 9).alias("b"))
    return rounded(ev.randomisation_test(pairs, ["form"]), ["observed", "p"])


GRID = [(k1, b) for k1 in ev.PROTOCOL[0][2]["k1"] for b in ev.PROTOCOL[0][2]["b"]]


def eval_grid(spark, d):
    """The first stage of tuning: a grid of parameters is data, and one plan scores all its points."""
    e, q = engine(spark, d)
    points = spark.createDataFrame(GRID, "k1 double, b double")
    run = rank.bm25_grid(e.terms(q, "B1"), e.index.only(["all"]), points, settle=e.settle)
    return rounded(ev.averages(ev.per_query(run, qrels(spark, d), ["k1", "b"]), ["k1", "b"]).select("k1", "b", "ndcg10"), ["ndcg10"])


def eval_latency(spark, d):
    """Percentiles by event type, with the events' values as times."""
    t = spark.read.parquet(f"{d}/events.parquet").select("event_type", F.col("value").cast("double").alias("ms"))
    return rounded(ev.latency_summary(t, ["event_type"]), ["median_ms", "p95_ms"])


def cand_features(spark, d):
    """Candidates of S3 and of the dense run at 100, with all eleven features from their own sources."""
    e, q = engine(spark, d, vectors=True)
    return rounded(e.ltr_features(q), learning.LTR_FEATURES, 5)


def _relevance(spark, d, rows: DataFrame) -> DataFrame:
    return rows.join(qrels(spark, d).select("qid", "doc_id", F.lit(1).alias("label")), ["qid", "doc_id"], "left").na.fill(0, ["label"])


def _gate_table(spark, d, e, q) -> DataFrame:
    """qid, the gate's features, sparse and neural quality, label: did fusion beat the sparse run."""
    sources = [f"{d}/{t}.parquet" for t in ("benchmark", "documents", "embeddings")]

    def make() -> DataFrame:
        sparse = kept(spark, "topic_run_s3", sources, lambda: e.search(q, "S3", 100))
        fused = kept(spark, "topic_run_h1", sources, lambda: e.search(q, "H1", 100))
        quality = [ev.per_query(r, qrels(spark, d)).select("qid", F.col("ndcg10").alias(n)) for r, n in ((sparse, "sparse"), (fused, "neural"))]
        return e.gate_features(q, sparse).join(quality[0].join(quality[1], "qid"), "qid").withColumn("label", (F.col("neural") > F.col("sparse")).cast("int"))

    return kept(spark, "gate_rows", sources, make)


def trained(spark, d) -> tuple[learning.LogisticRanker, tuple[learning.LogisticRanker, float]]:
    """The ranker, from the judged candidates of the topics whose hash is in the lower half, and the gate with its threshold."""
    e, q = engine(spark, d, vectors=True)
    rows = kept(spark, "ltr_rows", [f"{d}/{t}.parquet" for t in ("benchmark", "documents", "embeddings")], lambda: _relevance(spark, d, e.ltr_features(q)))
    ranker = learning.LogisticRanker(learning.LTR_FEATURES, balanced=True, max_iter=200).fit(rows.where(an.bucket(F.col("qid"), "ltr") < 50))
    own = _gate_table(spark, d, e, q)
    gate = learning.LogisticRanker(learning.GATE_FEATURES, max_iter=200).fit(own)
    return ranker, (gate, learning.choose_threshold(gate.predict(own).select("qid", "p", "sparse", "neural")).first()["threshold"])


def ltr_l1(spark, d):
    """System L1, asked with all topics."""
    e, q = engine(spark, d, vectors=True)
    e.ltr, _ = trained(spark, d)
    return e.search(q, "L1", 10)


def gated_g1(spark, d):
    """System G1: the gate learns where fusion beats the sparse run, its threshold is chosen by its own curve."""
    e, q = engine(spark, d, vectors=True)
    _, e.gate = trained(spark, d)
    return e.search(q, "G1", 10)


def gate_features(spark, d):
    e, q = engine(spark, d)
    return rounded(e.gate_features(q, e.search(q, "S1", 100)), learning.GATE_FEATURES, 5)


def _gate_rows(spark, d):
    """qid, p, sparse, neural: qualities of the two systems by item, and a probability from a hash."""
    own = scores(spark, d).where("form = 'F3'").groupBy("qid").agg(F.max(F.when(F.col("system") == "B1", F.col("ndcg10"))).alias("sparse"), F.max(F.when(F.col("system") == "S1", F.col("ndcg10"))).alias("neural"))
    p = an.bucket(F.col("qid"), "gate") / 100.0
    return own.select("qid", p.alias("p"), F.round("sparse", 9).alias("sparse"), F.round("neural", 9).alias("neural"))


def gate_threshold_curve(spark, d):
    return rounded(learning.threshold_curve(_gate_rows(spark, d), 21), ["threshold", "quality", "neural_share"])


def gate_threshold(spark, d):
    return rounded(learning.choose_threshold(_gate_rows(spark, d)), ["threshold"])


def budget_curve(spark, d):
    return rounded(learning.budget_curve(_gate_rows(spark, d)), ["threshold", "neural_share", "gate", "random", "oracle"])


def _labelled(spark, d):
    v, q = vectors_of(spark, d), query_vectors(spark, d)
    own = v.select(F.col("doc_id").alias("qid"), F.col("label").alias("q_label"))
    pairs = q.crossJoin(v).join(own, "qid")
    return pairs.select("qid", "doc_id", dot(F.col("q"), F.col("v")).alias("cosine"), dot(F.slice("q", 1, 16), F.slice("v", 1, 16)).alias("head"), (F.col("label") == F.col("q_label")).cast("int").alias("label"))


def ltr_rerank(spark, d):
    rows = _labelled(spark, d)
    model = learning.LogisticRanker(["cosine", "head"], balanced=True, max_iter=100).fit(rows)
    return learning.rerank(model.predict(rows), 10)


def gate_train(spark, d):
    rows = _labelled(spark, d)
    model = learning.LogisticRanker(["cosine", "head"], max_iter=100).fit(rows)
    return learning.decide(model.predict(rows), 0.2).groupBy("neural").agg(F.count("*").alias("n"))


def documents(spark, d):
    return read_spread(spark, f"{d}/documents.parquet").select("doc_id", "text", "lang")


def _frequencies(spark, d) -> DataFrame:
    """Written, as those who ask read them more than once."""
    source = f"{d}/documents.parquet"
    return kept(spark, "frequencies", [source], lambda: an.frequencies(spark.read.parquet(source).select("doc_id", "text"), parts_of(spark, source)))


def corpus_df_top(spark, d):
    docs = documents(spark, d)
    return rounded(an.top_terms(_frequencies(spark, d), docs.count()), ["idf"])


def corpus_zipf(spark, d):
    return an.zipf(_frequencies(spark, d)).withColumn("rank", F.col("rank").cast("long"))


def corpus_idf_hist(spark, d):
    docs = documents(spark, d)
    return an.idf_histogram(_frequencies(spark, d), docs.count()).withColumn("bin", F.col("bin").cast("long"))


def corpus_scalars(spark, d):
    docs = documents(spark, d)
    return rounded(an.scalars(docs, _frequencies(spark, d)), ["avg_tokens", "roman_share", "docs_with_roman"])


def length_bias(spark, d):
    e, q = engine(spark, d)
    run = e.search(q, "B1", 1).select(F.lit("B1").alias("system"), "qid", "doc_id", "rank").unionByName(e.search(q, "S1", 1).select(F.lit("S1").alias("system"), "qid", "doc_id", "rank"))
    return an.length_bias(run, e.index.only(["all"]).doc_stats.select("doc_id", "doc_len"))


def key_ablation(spark, d):
    tokens = documents(spark, d).select(F.explode(T.tokenize(F.col("text"))).alias("token")).distinct()
    return rounded(an.key_ablation(tokens), ["words_per_key"])


def agreement(spark, d):
    f = forms(spark, d).select(F.col("form").alias("annotator"), F.col("item").alias("qid"), "text")
    return rounded(an.agreement(f), ["jaccard", "edit", "same_spelling", "same_key"])


def sample_corpus(spark, d):
    return an.sample_corpus(documents(spark, d), qrels(spark, d).select("doc_id").distinct(), 100)


def mixed_corpus(spark, d):
    """Over the language names, which have no Devanagari, so that the rows can be held against SQL."""
    return an.mixed_corpus(documents(spark, d).select("doc_id", F.col("lang").alias("text")))


def mixed_corpus_texts(spark, d):
    """Over whole texts. SQL can't romanise, so this has none; tests hold it against brute force."""
    return an.mixed_corpus(documents(spark, d).select("doc_id", "text"))


def idf_examples(spark, d):
    docs = docs_of(spark, d)
    q = topics(spark, d)
    e, _ = engine(spark, d)
    own = rank.query_tokens(q).where("not stop").select("qid", F.col("position").cast("long").alias("position"), "token", T.stem(F.col("token")).alias("term"), T.phonetic_key(F.col("token")).alias("key"))
    return an.idf_examples(own, e.index.only(["all", "dhvani"]).term_stats, docs.count(), 5, 5)


def overlap(spark, d):
    e, q = engine(spark, d)
    return rounded(an.overlap_at(e.search(q, "B1", 20), e.search(q, "S1", 20), 20), ["overlap"])


def held_out_split(spark, d):
    return an.hash_split(documents(spark, d).select("doc_id"), "doc_id").groupBy("held_out").agg(F.count("*").alias("n"), F.sum("doc_id").alias("ids"))


QUERIES = {f.__name__: f for f in (eval_qrels, eval_metrics, eval_rbo_csc, eval_invariance, eval_significance, eval_grid, eval_latency, cand_features, ltr_l1, gated_g1, gate_features, gate_threshold_curve, gate_threshold, budget_curve, ltr_rerank, gate_train, corpus_df_top, corpus_zipf, corpus_idf_hist, corpus_scalars, length_bias, key_ablation, agreement, sample_corpus, mixed_corpus, mixed_corpus_texts, idf_examples, overlap, held_out_split)}

_F2 = "replace(replace(replace(text, 'sh', 's'), 'ee', 'i'), 'w', 'v')"
_F3 = "replace(replace(text, 'th', 't'), 'i', 'ee')"
_Q0 = S.TOPICS.replace("q AS", "q0 AS", 1)
FSQL = f"{_Q0}, forms AS (SELECT qid AS item, qid * 10 AS qid, 'F1' AS form, text FROM q0 UNION ALL SELECT qid, qid * 10 + 1, 'F2', {_F2} FROM q0 UNION ALL SELECT qid, qid * 10 + 2, 'F3', {_F3} FROM q0), q AS (SELECT qid, text FROM forms)"
REL = f"rel AS (SELECT item_id AS qid, doc_id FROM (SELECT doc_id, ' ' || array_to_string({S.tok('text')}, ' ') || ' ' AS t FROM documents) JOIN (SELECT item_id, ' ' || array_to_string({S.tok('text')}, ' ') || ' ' AS p FROM benchmark) ON contains(t, p)), nrel AS (SELECT qid, count(*) AS n_rel FROM rel GROUP BY qid)"


def _metrics(run: str, keys: str) -> str:
    """Table pq from a run with keys, qid, doc_id, rank."""
    k = f"{keys}, " if keys else ""
    asked = f"(SELECT DISTINCT {keys} FROM {run}) CROSS JOIN nrel" if keys else "nrel"
    on = " AND ".join(f"h.{c.strip()} = a.{c.strip()}" for c in [*filter(None, keys.split(",")), "qid"])
    ak = "".join(f"a.{c.strip()}, " for c in filter(None, keys.split(",")))
    return f"""hits AS (SELECT {k}qid, sum((rank <= 5)::INT) AS h5, sum((rank <= 10)::INT) AS h10, sum((rank <= 100)::INT) AS h100, min(CASE WHEN rank <= 10 THEN rank END) AS first, sum(CASE WHEN rank <= 10 THEN 1 / log2(rank + 1) ELSE 0 END) AS gain FROM {run} JOIN rel USING (qid, doc_id) GROUP BY ALL),
pq AS (SELECT {ak}a.qid, coalesce(h5, 0) / 5 AS p5, coalesce(h10, 0) / 10 AS p10, coalesce(h100, 0) / n_rel AS recall100, coalesce(1.0 / first, 0) AS mrr10, coalesce(gain, 0) / list_sum([1 / log2(i + 1) for i in range(1, least(10, n_rel) + 1)]) AS ndcg10 FROM ({'SELECT * FROM ' + asked}) a LEFT JOIN hits h ON {on})"""


RUNS = f"{S.base(['all', 'dhvani'], True, FSQL)}, {REL}, {S.bm25({'all': 1.0, 'dhvani': 2.0})}, s1 AS (SELECT qid, doc_id, score FROM zs WHERE zone = 'all'), {S.top('s1', 100, name='ra')}, {S.top('s', 100, name='rb')}, runs AS (SELECT 'B1' AS system, form, item AS qid, doc_id, rank FROM ra JOIN forms USING (qid) UNION ALL SELECT 'S1', form, item, doc_id, rank FROM rb JOIN forms USING (qid))"
SCORES = f"{RUNS}, {_metrics('runs', 'system, form')}"
_AVG = ", ".join(f"round(avg({m}), 6) AS {m}" for m in METRICS)
_HEX = "('0x' || substr(md5({0}), 1, {1}))::BIGINT"
GATE = f"{SCORES}, g AS (SELECT qid, ({_HEX.format(chr(113) + 'id::VARCHAR || ' + S.lit('gate'), 8)} % 100) / 100.0 AS p, round(max(CASE WHEN system = 'B1' THEN ndcg10 END), 9) AS sparse, round(max(CASE WHEN system = 'S1' THEN ndcg10 END), 9) AS neural FROM pq WHERE form = 'F3' GROUP BY qid)"


def _curve(steps: int) -> str:
    return f"curve AS (SELECT threshold, avg(CASE WHEN p >= threshold THEN neural ELSE sparse END) AS quality, avg((p >= threshold)::INT) AS neural_share FROM g CROSS JOIN (SELECT i / {steps - 1}.0::DOUBLE AS threshold FROM range({steps}) t(i)) GROUP BY threshold)"


FREQ = f"fr AS (SELECT term, sum(tf)::BIGINT AS cf, count(*) AS df FROM (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest({S.tok('text')}) AS term FROM documents) GROUP BY ALL) GROUP BY term)"
_N = "(SELECT count(*) FROM documents)"
_GRID = " UNION ALL ".join(f"SELECT {k1}::DOUBLE AS k1, {b}::DOUBLE AS b, (WITH {S.bm25({'all': 1.0}, k1, b)}, {S.top(k=100)}, {_metrics('run', '')} SELECT round(avg(ndcg10), 6) FROM pq) AS ndcg10" for k1, b in GRID)
_ABL = " UNION ALL ".join(f"SELECT '{n}' AS variant, token, {S.key_from('u', 'token', r)} AS key FROM (SELECT token, {S.units('token', r)} AS u FROM ts)" for n, r in ({"default": T.KeyRules()} | {f"no_{x}": T.KeyRules().without(x) for x in T.KEY_RULES}).items())
_BI = "list_distinct([substr(' ' || {0} || ' ', i, 2) for i in range(1, length({0}) + 2)])"
_JAC = f"len(list_intersect({_BI.format('x')}, {_BI.format('y')})) / len(list_distinct({_BI.format('x')} || {_BI.format('y')}))"
_S1RUN = f"{S.base(['all', 'dhvani'], True)}, {S.bm25({'all': 1.0, 'dhvani': 2.0})}, s1 AS (SELECT qid, doc_id, score FROM zs WHERE zone = 'all')"
#: The eleven features: candidates of S3 and of the dense run; windows are taken for all of them.
_FEATURES = f"""{S.base(['all', 'dhvani', 'title'], True)}, {VECTORS}, sd AS (SELECT qid // 50 AS qid, doc_id, {_dot('q', 'v')} AS score FROM qv CROSS JOIN v), {S.top('sd', 100, 5, 'rb')}, {S.bm25({'all': 1.0, 'dhvani': 2.0, 'title': 1.0}, pooled=True)}, {S.top(k=100, name='r100')},
r20 AS (SELECT qid, doc_id FROM r100 UNION SELECT qid, doc_id FROM rb), {WINDOWS}, x AS (SELECT r.qid, r.doc_id, round(r.score + 2.0 * coalesce(p.proximity, 0), 6) AS score, r.rank AS before FROM r100 r LEFT JOIN prox p USING (qid, doc_id)),
ra AS (SELECT qid, doc_id, row_number() OVER (PARTITION BY qid ORDER BY score DESC, before) AS rank FROM x), cand AS (SELECT qid, doc_id, ra.rank AS r1, rb.rank AS r2 FROM ra FULL JOIN rb USING (qid, doc_id)),
wq AS (SELECT qt.qid, qt.term, (1 + log10(qt.qtf)) * log10(z.n / t.df) AS w FROM qt JOIN tstat t ON t.zone = 'all' AND t.term = qt.term JOIN zstat z ON z.zone = 'all' WHERE qt.zone = 'all'), ln AS (SELECT qid, sqrt(sum(w * w)) AS l FROM wq WHERE w <> 0 GROUP BY qid),
tc AS (SELECT wq.qid, p.doc_id, sum(w / l * (1 + log10(p.tf)) / d.lnc_norm) AS tfidf FROM wq JOIN ln USING (qid) JOIN post p ON p.zone = 'all' AND p.term = wq.term JOIN dstat d ON d.zone = 'all' AND d.doc_id = p.doc_id WHERE w <> 0 GROUP BY ALL),
zf AS (SELECT qid, doc_id, sum(CASE WHEN zone = 'all' THEN score ELSE 0 END) AS bm25_all, sum(CASE WHEN zone = 'dhvani' THEN score ELSE 0 END) AS bm25_dhvani, sum(CASE WHEN zone = 'title' THEN score ELSE 0 END) AS bm25_title FROM zs GROUP BY ALL),
rq AS (SELECT qid, max(({S.script('token')} = 'roman')::INT)::DOUBLE AS roman_query FROM qtok GROUP BY qid)"""
ORACLES = {
    "cand_features": f"{_FEATURES} SELECT c.qid, c.doc_id, " + ", ".join(f"round(coalesce({e}, 0)::DOUBLE, 5) AS {n}" for n, e in {"bm25_all": "zf.bm25_all", "bm25_dhvani": "zf.bm25_dhvani", "bm25_title": "zf.bm25_title", "proximity": "prox.proximity", "tfidf": "tc.tfidf", "dense": "sd.score", "sparse_recip": "1.0::DOUBLE / r1", "dense_recip": "1.0::DOUBLE / r2", "lead_passage": "0", "log_length": "ln(1.0 + dl.doc_len)", "roman_query": "rq.roman_query"}.items())
    + " FROM cand c LEFT JOIN zf ON zf.qid = c.qid AND zf.doc_id = c.doc_id LEFT JOIN prox ON prox.qid = c.qid AND prox.doc_id = c.doc_id LEFT JOIN tc ON tc.qid = c.qid AND tc.doc_id = c.doc_id LEFT JOIN sd ON sd.qid = c.qid AND sd.doc_id = c.doc_id LEFT JOIN dstat dl ON dl.zone = 'all' AND dl.doc_id = c.doc_id LEFT JOIN rq ON rq.qid = c.qid",
    "eval_qrels": f"WITH {REL} SELECT qid, doc_id, 1 AS rel FROM rel",
    "eval_metrics": f"{SCORES} SELECT system, form, {_AVG}, count(*) AS n_queries FROM pq GROUP BY ALL",
    "eval_rbo_csc": f"""{RUNS}, r AS (SELECT qid, form, doc_id, rank FROM runs WHERE system = 'S1' AND rank <= 10), n AS (SELECT qid, form, max(rank) AS n FROM r GROUP BY ALL),
pr AS (SELECT a.form AS f, b.form AS g FROM (VALUES ('F1'), ('F2'), ('F3')) a(form), (VALUES ('F1'), ('F2'), ('F3')) b(form) WHERE a.form < b.form), qs AS (SELECT DISTINCT qid FROM r),
d2 AS (SELECT qs.qid, f, g, least(coalesce((SELECT n FROM n WHERE n.qid = qs.qid AND form = f), 0), coalesce((SELECT n FROM n WHERE n.qid = qs.qid AND form = g), 0)) AS n, coalesce((SELECT max(n) FROM n WHERE n.qid = qs.qid AND form IN (f, g)), 0) AS longest FROM qs CROSS JOIN pr),
met AS (SELECT a.qid, a.form AS f, b.form AS g, list(greatest(a.rank, b.rank)) AS l FROM r a JOIN r b ON a.qid = b.qid AND a.doc_id = b.doc_id AND a.form < b.form GROUP BY ALL),
v AS (SELECT d2.qid, f, g, n, coalesce(l, []) AS l FROM d2 LEFT JOIN met USING (qid, f, g) WHERE longest > 0)
SELECT qid, round(avg(CASE WHEN n = 0 THEN 0 ELSE len([x for x in l if x <= n]) / n * power(0.9, n) + (1 - 0.9) / 0.9 * list_sum([len([x for x in l if x <= d]) / d * power(0.9, d) for d in range(1, n + 1)]) END), 6) AS csc FROM v GROUP BY qid""",
    "eval_invariance": f"{SCORES}, w AS (SELECT system, qid, count(DISTINCT form) AS n, min(ndcg10) AS worst, max(CASE WHEN form = 'F1' THEN ndcg10 END) AS a, max(CASE WHEN form = 'F2' THEN ndcg10 END) AS b, max(CASE WHEN form = 'F3' THEN ndcg10 END) AS c FROM pq GROUP BY ALL) SELECT system, count(*) AS n_queries, round(avg(a), 6) AS \"mean_F1\", round(avg(b), 6) AS \"mean_F2\", round(avg(c), 6) AS \"mean_F3\", round(avg(a) - avg(b), 6) AS \"gap_F2\", round(avg(a) - avg(c), 6) AS \"gap_F3\", round(avg(worst), 6) AS worst FROM w WHERE n = 3 GROUP BY system",
    "eval_significance": f"{SCORES}, df AS (SELECT form, qid, round(max(CASE WHEN system = 'S1' THEN ndcg10 END), 9) - round(max(CASE WHEN system = 'B1' THEN ndcg10 END), 9) AS d FROM pq GROUP BY ALL), o AS (SELECT form, avg(d) AS observed, count(*) AS n FROM df GROUP BY form), fl AS (SELECT form, perm, avg(CASE WHEN {_HEX.format(chr(113) + 'id::VARCHAR || ' + S.lit('-') + ' || perm::VARCHAR', 1)} % 2 = 0 THEN d ELSE -d END) AS m FROM df CROSS JOIN range(10000) t(perm) GROUP BY ALL) SELECT form, round(observed, 6) AS observed, n, round((sum((abs(m) >= abs(observed) - 1e-12)::INT) + 1) / 10001, 6) AS p FROM fl JOIN o USING (form) GROUP BY form, observed, n",
    "eval_latency": "SELECT event_type, round(quantile_cont(value::DOUBLE, 0.5), 6) AS median_ms, round(quantile_cont(value::DOUBLE, 0.95), 6) AS p95_ms FROM events GROUP BY event_type",
    "eval_grid": f"{S.base(['all'], True)}, {REL} {_GRID}",
    "gate_threshold_curve": f"{GATE}, {_curve(21)} SELECT round(threshold, 6) AS threshold, round(quality, 6) AS quality, round(neural_share, 6) AS neural_share FROM curve",
    "gate_threshold": f"{GATE}, {_curve(101)} SELECT round(coalesce(max(CASE WHEN quality >= 0.99 * (SELECT avg(neural) FROM g) THEN threshold END), 0), 6) AS threshold FROM curve",
    "budget_curve": f"{GATE}, {_curve(51)}, dr AS (SELECT qid, sparse, neural, seed, row_number() OVER (PARTITION BY seed ORDER BY md5(qid::VARCHAR || '-' || seed::VARCHAR), qid) AS place FROM g CROSS JOIN range(20) t(seed)), rn AS (SELECT threshold, avg(CASE WHEN place <= round(neural_share * (SELECT count(*) FROM g)) THEN neural ELSE sparse END) AS random FROM dr CROSS JOIN curve GROUP BY threshold) SELECT round(threshold, 6) AS threshold, round(quality, 6) AS gate, round(neural_share, 6) AS neural_share, round(random, 6) AS random, round((SELECT avg(greatest(sparse, neural)) FROM g), 6) AS oracle FROM curve JOIN rn USING (threshold)",
    "corpus_df_top": f"WITH {FREQ} SELECT term, df, cf, round(log10({_N} / df), 6) AS idf, {S.stop('term')} AS stop FROM fr ORDER BY df DESC, term LIMIT 40",
    "corpus_zipf": f"WITH RECURSIVE {FREQ}, n AS (SELECT count(*) AS n FROM fr), rk(r) AS (SELECT 1::BIGINT UNION ALL SELECT CASE WHEN r < 100 THEN r + 1 ELSE floor(r * 1.1::DOUBLE)::BIGINT + 1 END FROM rk WHERE r < (SELECT n FROM n)) SELECT term, cf, rank FROM (SELECT term, cf, row_number() OVER (ORDER BY cf DESC, term) AS rank FROM fr) WHERE rank IN (SELECT r FROM rk)",
    "corpus_idf_hist": f"WITH {FREQ}, i AS (SELECT log10({_N} / df) AS idf FROM fr), e AS (SELECT min(idf) AS lo, max(idf) AS hi FROM i) SELECT least(floor((idf - lo) / ((hi - lo) / 25)), 24)::BIGINT AS bin, count(*) AS n FROM i CROSS JOIN e GROUP BY 1",
    "corpus_scalars": f"WITH {FREQ}, t AS (SELECT {S.tok('text')} AS ts FROM documents), c AS (SELECT len(ts) AS n, len([x for x in ts if regexp_matches(x, '[a-z]') AND NOT {S.deva('x')}]) AS r FROM t) SELECT count(*) AS num_docs, sum(n)::BIGINT AS num_tokens, round(avg(n), 6) AS avg_tokens, round(sum(r) / sum(n), 6) AS roman_share, round(avg((r > 0)::INT), 6) AS docs_with_roman, (SELECT count(*) FROM fr) AS vocabulary, (SELECT count(*) FROM fr WHERE cf = 1) AS hapaxes, (SELECT count(*) FROM (SELECT term FROM fr ORDER BY df DESC, term LIMIT 40) WHERE {S.stop('term')}) AS top40_stop FROM c",
    "length_bias": f"{_S1RUN}, {S.top('s1', 1, name='ra')}, {S.top('s', 1, name='rb')}, ln AS (SELECT doc_id, doc_len FROM dstat WHERE zone = 'all') SELECT 'B1' AS system, median(doc_len)::DOUBLE AS median_len FROM ra JOIN ln USING (doc_id) UNION ALL SELECT 'S1', median(doc_len)::DOUBLE FROM rb JOIN ln USING (doc_id) UNION ALL SELECT 'corpus', median(doc_len)::DOUBLE FROM ln",
    "key_ablation": f"WITH ts AS (SELECT DISTINCT unnest({S.tok('text')}) AS token FROM documents), k AS ({_ABL}) SELECT variant, count(*) AS keys, round(avg(n), 6) AS words_per_key FROM (SELECT variant, key, count(*) AS n FROM k WHERE key <> '' GROUP BY ALL) GROUP BY variant",
    "agreement": f"WITH {FSQL}, p AS (SELECT a.text AS x, b.text AS y, {S.tok('a.text')} AS tx, {S.tok('b.text')} AS ty FROM forms a JOIN forms b ON a.item = b.item AND a.form < b.form), w AS (SELECT unnest(tx) AS u, unnest(ty) AS v FROM p WHERE len(tx) = len(ty)), k AS (SELECT u, v, {S.key_from(S.units('u'), 'u')} AS ku, {S.key_from(S.units('v'), 'v')} AS kv FROM w) SELECT (SELECT count(*) FROM p) AS pairs, (SELECT round(avg({_JAC}), 6) FROM p) AS jaccard, (SELECT round(avg(levenshtein(x, y) / greatest(length(x), length(y), 1)), 6) FROM p) AS edit, count(*) AS words, round(avg((u = v)::INT), 6) AS same_spelling, round(avg((ku = kv)::INT), 6) AS same_key FROM k",
    "sample_corpus": f"WITH {REL} SELECT DISTINCT doc_id FROM (SELECT doc_id FROM rel UNION ALL SELECT doc_id FROM (SELECT doc_id FROM documents ORDER BY md5(doc_id::VARCHAR || 'sample'), doc_id LIMIT 100))",
    "mixed_corpus": f"SELECT doc_id, {_HEX.format('doc_id::VARCHAR || ' + S.lit('mixed'), 8)} % 100 < 30 AS romanised, lang AS text FROM documents",
    "idf_examples": f"{S.base(['all', 'dhvani'], True)} SELECT qid, pos AS position, token, key, a.df AS own_df, b.df AS pooled_df, round(log10({_N} / a.df), 6) AS own_idf, round(log10({_N} / b.df), 6) AS pooled_idf FROM qown JOIN tstat a ON a.zone = 'all' AND a.term = stem JOIN tstat b ON b.zone = 'dhvani' AND b.term = key WHERE a.df >= 5 AND b.df - a.df >= 5 ORDER BY qid, pos LIMIT 15",
    "overlap": f"{_S1RUN}, {S.top('s1', 20, name='ra')}, {S.top('s', 20, name='rb')} SELECT qid, round(coalesce(n / 20, 0), 6) AS overlap FROM (SELECT DISTINCT qid FROM ra) LEFT JOIN (SELECT qid, count(*) AS n FROM ra JOIN rb USING (qid, doc_id) GROUP BY qid) USING (qid)",
    "held_out_split": f"SELECT {_HEX.format('doc_id::VARCHAR || ' + S.lit('split'), 8)} % 100 < 10 AS held_out, count(*) AS n, sum(doc_id)::BIGINT AS ids FROM documents GROUP BY 1",
    "gate_features": f"""{_S1RUN}, {S.top('s', 100)}, rf AS (SELECT qid, max(score) AS t, max(CASE WHEN rank = 10 THEN score END) AS tenth, stddev_pop(score) AS sp FROM run GROUP BY qid),
tf AS (SELECT qid, avg((a.df IS NULL AND b.df IS NOT NULL)::INT) AS dhvani_only, avg((a.df IS NULL AND b.df IS NULL)::INT) AS unmatched, max(CASE WHEN coalesce(a.df, b.df) > 0 THEN ln(1 + ({_N} - coalesce(a.df, b.df) + 0.5) / (coalesce(a.df, b.df) + 0.5)) ELSE 0 END) AS max_idf, count(*)::DOUBLE AS query_length, max(({S.script('qown.token')} = 'roman')::INT)::DOUBLE AS roman_query FROM qown LEFT JOIN tstat a ON a.zone = 'all' AND a.term = stem LEFT JOIN tstat b ON b.zone = 'dhvani' AND b.term = key GROUP BY qid)
SELECT q.qid, round(coalesce(t, 0), 5) AS top_score, round(coalesce((t - coalesce(tenth, 0)) / t, 0), 5) AS score_gap, round(coalesce(sp / t, 0), 5) AS nqc, round(coalesce(dhvani_only, 0), 5) AS dhvani_only, round(coalesce(unmatched, 0), 5) AS unmatched, round(coalesce(max_idf, 0), 5) AS max_idf, coalesce(query_length, 0) AS query_length, coalesce(roman_query, 0) AS roman_query FROM q LEFT JOIN rf USING (qid) LEFT JOIN tf USING (qid)""",
}
