"""Ranked retrieval for a batch of queries: BM25 over zones, pooled df, tf-idf cosine, proximity, top-k, rank fusion.

Queries are rows of query_terms (qid, zone, term, qtf): a batch is data, not a loop. The side of the queries is joined by an
ordinary equi-join; Spark broadcasts it when it is small enough by its own measure.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from lekhani.functions import text as T
from lekhani.operators.index import terms_of


@dataclass(frozen=True)
class Params:
    k1: float = 0.9
    b: float = 0.5
    w_dhvani: float = 2.0
    w_soundex: float = 2.0
    w_title: float = 1.0
    proximity: float = 2.0


#: Digits that scores are rounded to before ranking, so that sums taken in another order rank alike.
DIGITS = 6


def query_tokens(queries: DataFrame) -> DataFrame:
    """queries: qid, text. Returns qid, position, token, stop."""
    out = queries.select("qid", F.posexplode(T.tokenize(F.col("text"))).alias("position", "token"))
    return out.withColumn("stop", T.is_stop(F.col("token")))


def analyze(texts: DataFrame) -> DataFrame:
    """texts: qid, text. qid, position, token, script, stop, stem, key of every token."""
    return query_tokens(texts).select("qid", "position", "token", T.token_script(F.col("token")).alias("script"), "stop", T.stem(F.col("token")).alias("stem"), T.phonetic_key(F.col("token")).alias("key"))


def query_terms(queries: DataFrame, zone: str, source: str | None = None) -> DataFrame:
    """qid, zone, term, qtf of one zone. source: the kind of term, if not the zone's own."""
    kind = source or ("all" if zone == "title" else zone)
    if kind == "raw":
        terms = queries.select("qid", F.explode(T.white_words(F.col("text"))).alias("term"))
    else:
        terms = query_tokens(queries).where("not stop").select("qid", terms_of(F.col("token"))[kind].alias("term")).where("term <> ''")
    return terms.groupBy("qid", "term").agg(F.count("*").alias("qtf")).select("qid", F.lit(zone).alias("zone"), "term", "qtf")


def bm25_idf(n: Column, df: Column) -> Column:
    return F.log(1 + (n - df + 0.5) / (df + 0.5))


def scored_terms(terms: DataFrame, index, df: DataFrame | None = None) -> DataFrame:
    """Query terms with df and N of their zone. df: other numbers to take, qid, zone, term, df."""
    stats = index.zone_stats.select("zone", F.col("num_docs").alias("n"), "avg_len")
    counted = terms.join(index.term_stats.select("zone", "term", F.col("df").alias("own_df")), ["zone", "term"])
    if df is not None:
        counted = counted.join(df.select("qid", "zone", "term", F.col("df").alias("other_df")), ["qid", "zone", "term"], "left").withColumn("own_df", F.coalesce("other_df", "own_df")).drop("other_df")
    return counted.withColumnRenamed("own_df", "df").join(stats, "zone")


def bm25(terms: DataFrame, index, p: Params = Params(), weights: dict[str, float] | None = None, df: DataFrame | None = None, champions: bool = False, by: tuple[str, ...] = ("qid", "doc_id", "zone"), settle: Callable[[DataFrame], DataFrame] = lambda rows: rows) -> DataFrame:
    """qid, doc_id, zone, score: the weighted BM25 sum of each zone (by: of all zones, if zone isn't named). With champions the df stays that of all postings. settle: writes the scored terms, so that Spark knows how few they are."""
    weight = F.lit(1.0)
    for zone, w in (weights or {}).items():
        weight = F.when(F.col("zone") == zone, F.lit(w)).otherwise(weight)
    found = settle(scored_terms(terms, index, df)).join((index.champions if champions else index.postings).select("zone", "term", "doc_id", "tf"), ["zone", "term"])
    found = found.join(index.doc_stats.select("zone", "doc_id", "doc_len"), ["zone", "doc_id"])
    part = weight * F.col("qtf") * bm25_idf(F.col("n"), F.col("df")) * F.col("tf") * (p.k1 + 1) / (F.col("tf") + p.k1 * (1 - p.b + p.b * F.col("doc_len") / F.col("avg_len")))
    return found.groupBy(*by).agg(F.sum(part).alias("score"))


def bm25_grid(terms: DataFrame, index, points: DataFrame, k: int = 100, digits: int = DIGITS, settle: Callable[[DataFrame], DataFrame] = lambda rows: rows) -> DataFrame:
    """k1, b, qid, doc_id, score, rank of one zone for every point (k1, b): postings are met once, only the formula is repeated."""
    found = settle(scored_terms(terms, index)).join(index.postings.select("zone", "term", "doc_id", "tf"), ["zone", "term"]).join(index.doc_stats.select("zone", "doc_id", "doc_len"), ["zone", "doc_id"])
    parts = found.select("qid", "doc_id", (F.col("qtf") * bm25_idf(F.col("n"), F.col("df"))).alias("gain"), "tf", (F.col("doc_len") / F.col("avg_len")).alias("length"))
    # A grid is few points: a column for each, so that a document's terms are summed once, not once for each point.
    own = [(r["k1"], r["b"]) for r in points.distinct().collect()]
    sums = [F.sum(F.col("gain") * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("length")))).alias(f"s{i}") for i, (k1, b) in enumerate(own)]
    each = F.array(*(F.struct(F.lit(k1).alias("k1"), F.lit(b).alias("b"), F.round(f"s{i}", digits).alias("score")) for i, (k1, b) in enumerate(own)))
    scored = parts.groupBy("qid", "doc_id").agg(*sums).select("qid", "doc_id", F.inline(each)).where("score > 0")
    by = W.partitionBy("k1", "b", "qid").orderBy(F.desc("score"), "doc_id")
    return scored.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= k)


def combine(zone_scores: DataFrame) -> DataFrame:
    return zone_scores.groupBy("qid", "doc_id").agg(F.sum("score").alias("score"))


def pooled_df(queries: DataFrame, index, zone: str = "all") -> DataFrame:
    """qid, zone, term, df: the larger of a term's own df and that of its phonetic key; of tokens with one stem the last key counts."""
    own = query_tokens(queries).where("not stop").select("qid", "position", T.stem(F.col("token")).alias("term"), T.phonetic_key(F.col("token")).alias("key"))
    keys = own.groupBy("qid", "term").agg(F.max_by("key", "position").alias("key"))
    stats = index.term_stats
    out = keys.join(stats.where(F.col("zone") == zone).select("term", F.col("df").alias("own")), "term", "left")
    out = out.join(stats.where("zone = 'dhvani'").select(F.col("term").alias("key"), F.col("df").alias("pool")), "key", "left")
    return out.select("qid", F.lit(zone).alias("zone"), "term", F.greatest(F.coalesce("own", F.lit(0)), F.coalesce("pool", F.lit(0))).alias("df")).where("df > 0")


def top_k(scores: DataFrame, k: int, digits: int = DIGITS) -> DataFrame:
    """qid, doc_id, score, rank: positive scores, highest first, ties by the smaller doc_id."""
    rounded = scores.select("qid", "doc_id", F.round("score", digits).alias("score")).where("score > 0")
    by = W.partitionBy("qid").orderBy(F.desc("score"), "doc_id")
    return rounded.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= k)


def tfidf_cosine(terms: DataFrame, index, settle: Callable[[DataFrame], DataFrame] = lambda rows: rows) -> DataFrame:
    """qid, doc_id, score: lnc.ltc; terms of idf 0 take no part."""
    n = index.zone_stats.select("zone", F.col("num_docs").alias("n"))
    weighed = terms.join(index.term_stats, ["zone", "term"]).join(n, "zone").withColumn("w", (1 + F.log10("qtf")) * F.log10(F.col("n") / F.col("df"))).where("w <> 0")
    length = weighed.groupBy("qid").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("length"))
    found = settle(weighed.join(length, "qid")).join(index.postings.select("zone", "term", "doc_id", "tf"), ["zone", "term"]).join(index.doc_stats, ["zone", "doc_id"])
    return found.groupBy("qid", "doc_id").agg(F.sum(F.col("w") / F.col("length") * (1 + F.log10("tf")) / F.col("lnc_norm")).alias("score"))


def smallest_windows(places: DataFrame) -> DataFrame:
    """places: qid, doc_id, term, positions. Returns qid, doc_id, m (terms present), window, proximity.

    The window that ends at a place begins at the earliest of the terms' last places up to there; a running map of last
    places over the sorted places gives all ends in one pass over a document's own array.
    """
    spread = places.select("qid", "doc_id", "term", F.explode("positions").alias("p"))
    numbered = spread.groupBy("qid", "doc_id").agg(F.count_distinct("term").alias("m"), F.sort_array(F.collect_list(F.struct("p", "term"))).alias("all"))
    start = F.struct(F.create_map().cast("map<string,int>").alias("last"), F.lit(None).cast("int").alias("best"))

    def step(acc: Column, x: Column) -> Column:
        last = F.map_concat(F.map_filter(acc["last"], lambda k, _: k != x["term"]), F.map_from_arrays(F.array(x["term"]), F.array(x["p"])))
        span = F.when(F.size(last) == F.col("m"), x["p"] - F.array_min(F.map_values(last)) + 1)
        return F.struct(last.alias("last"), F.least(acc["best"], span).alias("best"))

    out = numbered.withColumn("window", F.when(F.col("m") >= 2, F.aggregate("all", start, step, lambda acc: acc["best"])).otherwise(0))
    score = F.when(F.col("m") < 2, 0.0).otherwise((F.col("m") - 1) / F.when(F.col("window") > 1, F.col("window") - 1).otherwise(1))
    return out.select("qid", "doc_id", "m", "window", score.alias("proximity"))


def proximity(run: DataFrame, queries: DataFrame, index) -> DataFrame:
    """run: qid, doc_id. The windows of the queries' phonetic keys in these documents only."""
    terms = query_terms(queries, "dhvani").select("qid", "term")
    wanted = run.select("qid", "doc_id").join(terms, "qid")
    return smallest_windows(wanted.join(index.places("dhvani", terms, run), ["term", "doc_id"]))


def add_proximity(run: DataFrame, windows: DataFrame, weight: float, digits: int = DIGITS) -> DataFrame:
    """Adds weight * proximity to a cut run and ranks anew; ties keep their earlier order."""
    own = run.join(windows.select("qid", "doc_id", "proximity"), ["qid", "doc_id"], "left")
    own = own.select("qid", "doc_id", F.round(F.col("score") + weight * F.coalesce("proximity", F.lit(0.0)), digits).alias("score"), F.col("rank").alias("before"))
    by = W.partitionBy("qid").orderBy(F.desc("score"), "before")
    return own.withColumn("rank", F.row_number().over(by)).drop("before")


def rrf(first: DataFrame, second: DataFrame, k: int = 60, digits: int = 9) -> DataFrame:
    """Reciprocal rank fusion of two runs; ties: the first run's order, then the second's."""
    both = first.select("qid", "doc_id", F.col("rank").alias("r1")).join(second.select("qid", "doc_id", F.col("rank").alias("r2")), ["qid", "doc_id"], "full")
    gain = F.coalesce(1.0 / (k + F.col("r1")), F.lit(0.0)) + F.coalesce(1.0 / (k + F.col("r2")), F.lit(0.0))
    scored = both.withColumn("score", F.round(gain, digits))
    by = W.partitionBy("qid").orderBy(F.desc("score"), F.asc_nulls_last("r1"), F.asc_nulls_last("r2"))
    return scored.withColumn("rank", F.row_number().over(by)).select("qid", "doc_id", "score", "rank")
