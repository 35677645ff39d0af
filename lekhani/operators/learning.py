"""Learning to rank and the gated cascade: candidates, features, logistic models on Spark ML, thresholds, budgets."""

from __future__ import annotations

from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

LTR_FEATURES = ["bm25_all", "bm25_dhvani", "bm25_title", "proximity", "tfidf", "dense", "sparse_recip", "dense_recip", "lead_passage", "log_length", "roman_query"]
GATE_FEATURES = ["top_score", "score_gap", "nqc", "dhvani_only", "unmatched", "max_idf", "query_length", "roman_query"]


def candidates(sparse: DataFrame, dense: DataFrame) -> DataFrame:
    """qid, doc_id, sparse_rank, dense_rank: the union of two runs."""
    a, b = sparse.select("qid", "doc_id", F.col("rank").alias("sparse_rank")), dense.select("qid", "doc_id", F.col("rank").alias("dense_rank"))
    return a.join(b, ["qid", "doc_id"], "full")


def ltr_features(found: DataFrame, zone_scores: DataFrame, windows: DataFrame, tfidf: DataFrame, dense: DataFrame, lengths: DataFrame, scripts: DataFrame, lead: DataFrame) -> DataFrame:
    """Eleven features of each candidate. zone_scores: qid, doc_id, zone, score; lengths: doc_id, doc_len; scripts: qid, roman_query; lead: doc_id, lead_passage."""
    zones = zone_scores.groupBy("qid", "doc_id").agg(*(F.sum(F.when(F.col("zone") == z, F.col("score")).otherwise(0.0)).alias(f"bm25_{z}") for z in ("all", "dhvani", "title")))
    out = found
    for df, on in ((zones, ["qid", "doc_id"]), (windows.select("qid", "doc_id", "proximity"), ["qid", "doc_id"]), (tfidf.select("qid", "doc_id", F.col("score").alias("tfidf")), ["qid", "doc_id"]), (dense.select("qid", "doc_id", F.col("score").alias("dense")), ["qid", "doc_id"]), (lengths.select("doc_id", F.log(1.0 + F.col("doc_len")).alias("log_length")), ["doc_id"]), (scripts, ["qid"]), (lead, ["doc_id"])):
        out = out.join(df, on, "left")
    out = out.withColumn("sparse_recip", 1.0 / F.col("sparse_rank")).withColumn("dense_recip", 1.0 / F.col("dense_rank"))
    return out.select("qid", "doc_id", *(F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c) for c in LTR_FEATURES))


def gate_run_features(run: DataFrame) -> DataFrame:
    """run: qid, score, rank. top_score, score_gap to the tenth, and spread of the scores over the top; 0 without a run."""
    agg = run.groupBy("qid").agg(F.max("score").alias("top_score"), F.max(F.when(F.col("rank") == 10, F.col("score"))).alias("tenth"), F.stddev_pop("score").alias("spread"))
    return agg.select("qid", "top_score", F.when(F.col("top_score") > 0, (F.col("top_score") - F.coalesce("tenth", F.lit(0.0))) / F.col("top_score")).otherwise(0.0).alias("score_gap"), F.when(F.col("top_score") > 0, F.col("spread") / F.col("top_score")).otherwise(0.0).alias("nqc"))


def gate_term_features(tokens: DataFrame, term_stats: DataFrame, num_docs: DataFrame) -> DataFrame:
    """tokens: qid, term (stem), key, roman of content tokens. Shares of tokens known by key only or not at all, largest idf, length."""
    surface = term_stats.where("zone = 'all'").select("term", F.col("df").alias("own"))
    keyed = term_stats.where("zone = 'dhvani'").select(F.col("term").alias("key"), F.col("df").alias("pool"))
    known = tokens.join(surface, "term", "left").join(keyed, "key", "left").crossJoin(num_docs)
    own, pool = F.coalesce("own", F.lit(0)), F.coalesce("pool", F.lit(0))
    df = F.when(own > 0, own).otherwise(pool)
    idf = F.when(df > 0, F.log(1 + (F.col("num_docs") - df + 0.5) / (df + 0.5))).otherwise(0.0)
    return known.groupBy("qid").agg(F.avg(((own == 0) & (pool > 0)).cast("double")).alias("dhvani_only"), F.avg(((own == 0) & (pool == 0)).cast("double")).alias("unmatched"), F.max(idf).alias("max_idf"), F.count("*").cast("double").alias("query_length"), F.max(F.col("roman").cast("double")).alias("roman_query"))


class Scaler:
    """Centres and scales columns by mean and population deviation; a constant column is only centred."""

    def __init__(self, rows: DataFrame, columns: list[str]):
        got = rows.agg(*(f(c).alias(f"{n}_{c}") for c in columns for n, f in (("m", F.avg), ("s", F.stddev_pop)))).first()
        self.columns = columns
        self.mean = {c: got[f"m_{c}"] or 0.0 for c in columns}
        self.scale = {c: got[f"s_{c}"] or 1.0 for c in columns}

    def apply(self, rows: DataFrame) -> DataFrame:
        scaled = rows.withColumns({f"z_{c}": (F.col(c) - self.mean[c]) / self.scale[c] for c in self.columns})
        return VectorAssembler(inputCols=[f"z_{c}" for c in self.columns], outputCol="features").transform(scaled).drop(*(f"z_{c}" for c in self.columns))


class LogisticRanker:
    """Logistic regression with penalty C on standardised features; balanced: classes weigh the same."""

    def __init__(self, columns: list[str], c: float = 1.0, balanced: bool = False, max_iter: int = 2000):
        self.columns, self.c, self.balanced, self.max_iter = columns, c, balanced, max_iter

    def fit(self, rows: DataFrame, label: str = "label") -> LogisticRanker:
        self.scaler = Scaler(rows, self.columns)
        counts = {r[label]: r["count"] for r in rows.groupBy(label).count().collect()}
        n = sum(counts.values())
        weights = F.lit(1.0)
        if self.balanced:
            for k, v in counts.items():
                weights = F.when(F.col(label) == k, F.lit(n / (2.0 * v))).otherwise(weights)
        ready = self.scaler.apply(rows.withColumn("weight", weights)).withColumn("label", F.col(label).cast("double"))
        self.model = LogisticRegression(regParam=1.0 / (self.c * n), standardization=False, weightCol="weight", maxIter=self.max_iter, tol=1e-9).fit(ready)
        return self

    def predict(self, rows: DataFrame, out: str = "p") -> DataFrame:
        return self.model.transform(self.scaler.apply(rows)).withColumn(out, vector_to_array("probability")[1]).drop("features", "rawPrediction", "probability", "prediction")

    def coefficients(self) -> list[tuple[str, float]]:
        return list(zip(self.columns, map(float, self.model.coefficients), strict=True))

    def save(self, path: str) -> None:
        self.model.write().overwrite().save(f"{path}/model")
        SparkSession.active().createDataFrame([(i, c, self.scaler.mean[c], self.scaler.scale[c]) for i, c in enumerate(self.columns)], "i int, name string, mean double, scale double").write.mode("overwrite").parquet(f"{path}/scaler")

    @classmethod
    def load(cls, spark, path: str) -> LogisticRanker:
        rows = spark.read.parquet(f"{path}/scaler").orderBy("i").collect()
        out = cls([r["name"] for r in rows])
        out.scaler = Scaler.__new__(Scaler)
        out.scaler.columns, out.scaler.mean, out.scaler.scale = out.columns, {r["name"]: r["mean"] for r in rows}, {r["name"]: r["scale"] for r in rows}
        out.model = LogisticRegressionModel.load(f"{path}/model")
        return out


def rerank(scored: DataFrame, k: int, digits: int = 6) -> DataFrame:
    by = W.partitionBy("qid").orderBy(F.desc("score"), "doc_id")
    out = scored.select("qid", "doc_id", F.round("p", digits).alias("score"))
    return out.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= k)


def decide(gated: DataFrame, threshold: float) -> DataFrame:
    return gated.withColumn("neural", F.col("p") >= threshold)


def threshold_curve(rows: DataFrame, steps: int = 101) -> DataFrame:
    """rows: qid, p, sparse, neural (qualities). threshold, quality, neural_share of gating at each of the steps."""
    grid = rows.sparkSession.range(steps).select((F.col("id") / float(steps - 1)).alias("threshold"))
    taken = F.col("p") >= F.col("threshold")
    return rows.crossJoin(grid).groupBy("threshold").agg(F.avg(F.when(taken, F.col("neural")).otherwise(F.col("sparse"))).alias("quality"), F.avg(taken.cast("double")).alias("neural_share"))


def choose_threshold(rows: DataFrame, keep: float = 0.99, steps: int = 101) -> DataFrame:
    """The largest threshold whose quality is at least keep of always taking the neural side; 0 if none is."""
    always = rows.agg(F.avg("neural").alias("always"))
    return threshold_curve(rows, steps).crossJoin(always).agg(F.coalesce(F.max(F.when(F.col("quality") >= keep * F.col("always"), F.col("threshold"))), F.lit(0.0)).alias("threshold"))


def budget_curve(rows: DataFrame, steps: int = 51, seeds: int = 20) -> DataFrame:
    """threshold, neural_share, gate, random (mean over seeds of taking as many queries by hash order), oracle."""
    curve = threshold_curve(rows, steps)
    spark = rows.sparkSession
    n = rows.agg(F.count("*").alias("n"), F.avg(F.greatest("sparse", "neural")).alias("oracle"))
    drawn = rows.crossJoin(spark.range(seeds).select(F.col("id").alias("seed")))
    place = F.row_number().over(W.partitionBy("seed").orderBy(F.md5(F.concat(F.col("qid").cast("string"), F.lit("-"), F.col("seed").cast("string"))), "qid"))
    drawn = drawn.withColumn("place", place)
    taken = F.col("place") <= F.round(F.col("neural_share") * F.col("n"))
    random = drawn.crossJoin(curve.select("threshold", "neural_share")).crossJoin(n).groupBy("threshold").agg(F.avg(F.when(taken, F.col("neural")).otherwise(F.col("sparse"))).alias("random"))
    return curve.withColumnRenamed("quality", "gate").join(random, "threshold").crossJoin(n.select("oracle"))


def sample_queries(queries: DataFrame, n: int, seed: str) -> DataFrame:
    return queries.orderBy(F.md5(F.concat(F.lit(seed), F.col("qid").cast("string"))), "qid").limit(n)
