"""Named ranking systems as compositions of operators, over batches of queries."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from lekhani.functions import romanize as R
from lekhani.functions import text as T
from lekhani.operators import dense, evaluation, learning
from lekhani.operators import retrieval as rank
from lekhani.operators.index import Index
from lekhani.operators.retrieval import Params

#: Zones that each sparse system scores.
SPARSE = {"B0": ["raw"], "B1": ["all"], "B1N": ["nostem"], "B2": ["all"], "V1": ["all"], "S0": ["all", "soundex"], "S1": ["all", "dhvani"], "S2": ["all", "dhvani"], "S3": ["all", "dhvani", "title"]}


class Engine:
    """index: the corpus's tables. vectors: doc_id, v. query_vectors: system (D0 or D1), qid, q. ltr, gate: trained models."""

    def __init__(self, index: Index, params: Params = Params(), vectors: DataFrame | None = None, query_vectors: DataFrame | None = None, ltr: learning.LogisticRanker | None = None, gate: tuple[learning.LogisticRanker, float] | None = None, settle: Callable[[DataFrame], DataFrame] = lambda rows: rows):
        """settle: writes a batch's scored terms and cut runs, which are read more than once, so that Spark knows their size."""
        self.settle = settle
        self.index, self.params, self.vectors, self.query_vectors, self.ltr, self.gate = index, params, vectors, query_vectors, ltr, gate

    def available(self) -> list[str]:
        dense_ready = self.vectors is not None and self.query_vectors is not None
        return [*SPARSE, *(["D0", "D1", "H1"] if dense_ready else []), *(["L1"] if dense_ready and self.ltr else []), *(["G1"] if dense_ready and self.gate else [])]

    def search(self, queries: DataFrame, system: str, k: int = 10, champions: bool = False) -> DataFrame:
        """queries: qid, text. Returns qid, doc_id, score, rank."""
        if system not in self.available():
            raise ValueError(f"unknown or unavailable system {system}")
        if system in SPARSE:
            return self.sparse(queries, system, k, champions)
        if system in ("D0", "D1"):
            return dense.exact_search(self.query_vectors.where(F.col("system") == system).select("qid", "q"), self.vectors, k)
        if system == "H1":
            return rank.rrf(self.search(queries, "S3", 100), self.search(queries, "D1", 100)).where(F.col("rank") <= k)
        if system == "L1":
            return learning.rerank(self.ltr.predict(self.ltr_features(queries)), k)
        return self.gated(queries, k)

    def terms(self, queries: DataFrame, system: str) -> DataFrame:
        out = None
        for zone in SPARSE[system]:
            one = self.transliterated(queries) if system == "B2" else rank.query_terms(queries, zone)
            out = one if out is None else out.unionByName(one)
        return out

    def transliterated(self, queries: DataFrame) -> DataFrame:
        own = rank.query_tokens(queries).where("not stop")
        deva = F.when(T.token_script(F.col("token")) == "roman", R.itrans(F.col("token"))).otherwise(F.col("token"))
        again = own.select("qid", F.explode(T.tokenize(deva)).alias("token")).select("qid", T.stem(F.col("token")).alias("term"))
        return again.groupBy("qid", "term").agg(F.count("*").alias("qtf")).select("qid", F.lit("all").alias("zone"), "term", "qtf")

    def zone_scores(self, queries: DataFrame, system: str, champions: bool = False, by: tuple[str, ...] = ("qid", "doc_id", "zone")) -> DataFrame:
        p = self.params
        index = self.index.only([*SPARSE[system], *(["dhvani"] if system in ("S2", "S3") else [])])
        weights = {"dhvani": p.w_dhvani, "soundex": p.w_soundex, "title": p.w_title}
        df = None
        if system in ("S2", "S3"):
            df = rank.pooled_df(queries, index)
            df = df.unionByName(df.withColumn("zone", F.lit("title"))) if system == "S3" else df
        return rank.bm25(self.terms(queries, system), index, p, weights, df, champions, by, self.settle)

    def sparse(self, queries: DataFrame, system: str, k: int, champions: bool = False) -> DataFrame:
        if system == "V1":
            return rank.top_k(rank.tfidf_cosine(self.terms(queries, system), self.index.only(SPARSE[system]), self.settle), k)
        run = rank.top_k(self.zone_scores(queries, system, champions, ("qid", "doc_id")), k)
        if system == "S3" and self.params.proximity:
            run = self.settle(run)
            run = rank.add_proximity(run, rank.proximity(run, queries, self.index), self.params.proximity)
        return run

    def ltr_features(self, queries: DataFrame) -> DataFrame:
        found = self.settle(learning.candidates(self.search(queries, "S3", 100), self.search(queries, "D1", 100)))
        pairs = found.join(self.query_vectors.where("system = 'D1'").select("qid", "q"), "qid").join(self.vectors, "doc_id")
        scored = pairs.select("qid", "doc_id", dense.dot(F.col("q"), F.col("v")).alias("score"))
        scripts = queries.select("qid", T.query_script(T.tokenize(F.col("text"))).isin("roman", "mixed").cast("double").alias("roman_query"))
        lengths = self.index.only(["all"]).doc_stats.select("doc_id", "doc_len")
        lead = self.index.docs.select("doc_id", F.col("doc_id").cast("string").endswith("#0").cast("double").alias("lead_passage"))
        cosine = rank.tfidf_cosine(rank.query_terms(queries, "all"), self.index.only(["all"]), self.settle)
        return learning.ltr_features(found, self.zone_scores(queries, "S3"), rank.proximity(found, queries, self.index), cosine, scored, lengths, scripts, lead)

    def gate_features(self, queries: DataFrame, run: DataFrame) -> DataFrame:
        own = rank.query_tokens(queries).where("not stop")
        tokens = own.select("qid", T.stem(F.col("token")).alias("term"), T.phonetic_key(F.col("token")).alias("key"), (T.token_script(F.col("token")) == "roman").alias("roman"))
        n = self.index.only(["all"]).zone_stats.select("num_docs")
        out = queries.select("qid").join(learning.gate_run_features(run), "qid", "left").join(learning.gate_term_features(tokens, self.index.only(["all", "dhvani"]).term_stats, n), "qid", "left")
        return out.select("qid", *(F.coalesce(F.col(c), F.lit(0.0)).alias(c) for c in learning.GATE_FEATURES))

    def gated(self, queries: DataFrame, k: int) -> DataFrame:
        """The sparse run, but for queries whose gate opens the fusion with the dense one."""
        model, threshold = self.gate
        sparse = self.settle(self.search(queries, "S3", 100))
        decided = learning.decide(model.predict(self.gate_features(queries, sparse)), threshold).select("qid", "neural")
        open_queries = queries.join(decided.where("neural").select("qid"), "qid", "left_semi")
        fused = rank.rrf(sparse.join(open_queries.select("qid"), "qid", "left_semi"), self.search(open_queries, "D1", 100).join(open_queries.select("qid"), "qid", "left_semi"))
        return sparse.join(decided.where("not neural").select("qid"), "qid", "left_semi").unionByName(fused).where(F.col("rank") <= k)

    def explain(self, queries: DataFrame, system: str, k: int = 10) -> dict[str, DataFrame]:
        """Tokens with stem, key and stop flag; df and idf by zone; pooled df; zone scores and windows of the top documents."""
        tokens = rank.analyze(queries)
        terms = rank.scored_terms(self.terms(queries, system), self.index.only(SPARSE[system])).withColumn("idf", rank.bm25_idf(F.col("n"), F.col("df")))
        run = self.search(queries, system, k)
        out = {"tokens": tokens, "terms": terms, "run": run}
        if system not in ("V1",):
            out["zones"] = self.zone_scores(queries, system).join(run.select("qid", "doc_id"), ["qid", "doc_id"], "left_semi")
        if system == "S3":
            out |= {"pooled": rank.pooled_df(queries, self.index.only(["all", "dhvani"])), "windows": rank.proximity(run, queries, self.index)}
        return out

    def consistency(self, queries: DataFrame, systems: list[str], k: int = 10) -> DataFrame:
        """system, qid, roman, rbo, shared_top10 of each Devanagari query and its romanisation."""
        own = queries.where(T.query_script(T.tokenize(F.col("text"))) == "deva").select("qid", "text")
        roman = own.select("qid", R.romanize(F.col("text")).alias("text"))
        out = None
        for system in systems:
            runs = [self.search(q, system, k) for q in (own, roman)]
            one = evaluation.rbo(*runs, k=k).join(evaluation.shared_top(*runs, k), "qid").join(roman.withColumnRenamed("text", "roman"), "qid")
            one = one.select(F.lit(system).alias("system"), "qid", "roman", F.round("rbo", 3).alias("rbo"), F.col("shared").alias("shared_top10"))
            out = one if out is None else out.unionByName(one)
        return out

    def timed_search(self, queries: DataFrame, system: str, k: int = 10) -> tuple[list[Row], float]:
        """The rows of a search, and the milliseconds that it took."""
        began = time.perf_counter()
        rows = self.search(queries, system, k).orderBy("qid", "rank").collect()  # k rows for each query
        return rows, (time.perf_counter() - began) * 1000

    def present(self, run: DataFrame) -> DataFrame:
        """Titles and snippets, joined last."""
        docs = self.index.docs.select("doc_id", "title", T.snippet(F.col("body")).alias("snippet"))
        return run.join(docs, "doc_id").orderBy("qid", "rank")
