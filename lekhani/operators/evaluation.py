"""Evaluation of runs: precision, recall, MRR, nDCG, RBO, consistency over forms, invariance, significance, latencies, grids.

A run is run(qid, doc_id, rank), with more key columns (system, form) where wanted; judgments are qrels(qid, doc_id, rel).
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

METRICS = ["p@5", "p@10", "recall@100", "mrr@10", "ndcg@10"]


def relevant(qrels: DataFrame) -> DataFrame:
    return qrels.where("rel > 0").select("qid", "doc_id").distinct()


def per_query(run: DataFrame, qrels: DataFrame, keys: list[str] = []) -> DataFrame:
    """keys, qid, p5, recall100, mrr10, ndcg10, p10. Queries without a relevant document are left out; an empty run scores 0."""
    rel = relevant(qrels)
    sizes = rel.groupBy("qid").agg(F.count("*").alias("n_rel"))
    asked = (run.select(*keys).distinct().crossJoin(sizes) if keys else sizes)
    hits = run.join(rel, ["qid", "doc_id"]).groupBy(*keys, "qid").agg(
        F.sum((F.col("rank") <= 5).cast("int")).alias("h5"), F.sum((F.col("rank") <= 10).cast("int")).alias("h10"), F.sum((F.col("rank") <= 100).cast("int")).alias("h100"),
        F.min(F.when(F.col("rank") <= 10, F.col("rank"))).alias("first"), F.sum(F.when(F.col("rank") <= 10, 1 / F.log2(F.col("rank") + 1)).otherwise(0.0)).alias("gain"),
    )
    ideal = F.aggregate(F.sequence(F.lit(1), F.least(F.lit(10), F.col("n_rel")).cast("int")), F.lit(0.0), lambda s, i: s + 1 / F.log2(i + 1))
    out = asked.join(hits, [*keys, "qid"], "left")
    zero = lambda c: F.coalesce(c, F.lit(0))
    return out.select(*keys, "qid", (zero("h5") / 5).alias("p5"), (zero("h10") / 10).alias("p10"), (zero("h100") / F.col("n_rel")).alias("recall100"), F.coalesce(1 / F.col("first"), F.lit(0.0)).alias("mrr10"), (F.coalesce("gain", F.lit(0.0)) / ideal).alias("ndcg10"))


def averages(scores: DataFrame, keys: list[str]) -> DataFrame:
    return scores.groupBy(*keys).agg(*(F.avg(m).alias(m) for m in ("p5", "p10", "recall100", "mrr10", "ndcg10")), F.count("*").alias("n_queries"))


def rbo(a: DataFrame, b: DataFrame, p: float = 0.9, k: int = 10) -> DataFrame:
    """Extrapolated rank-biased overlap of two runs (qid, doc_id, rank) at depth k, for each query of either; 0 if one is empty."""
    a, b = (r.where(F.col("rank") <= k).select("qid", "doc_id", F.col("rank").alias(n)) for r, n in ((a, "r1"), (b, "r2")))
    depth = a.groupBy("qid").agg(F.max("r1").alias("n1")).join(b.groupBy("qid").agg(F.max("r2").alias("n2")), "qid", "full")
    depth = depth.select("qid", F.least(F.coalesce("n1", F.lit(0)), F.coalesce("n2", F.lit(0))).alias("n"))
    seen = a.join(b, ["qid", "doc_id"]).groupBy("qid").agg(F.collect_list(F.greatest("r1", "r2")).alias("at"))
    own = depth.join(seen, "qid", "left").withColumn("at", F.coalesce("at", F.array().cast("array<int>")))

    def share(d: Column) -> Column:
        return F.size(F.filter("at", lambda x: x <= d)) / d

    total = F.aggregate(F.when(F.col("n") > 0, F.sequence(F.lit(1), F.col("n").cast("int"))).otherwise(F.array().cast("array<int>")), F.lit(0.0), lambda s, d: s + share(d) * F.pow(F.lit(p), d.cast("double")))
    value = F.when(F.col("n") > 0, share(F.col("n")) * F.pow(F.lit(p), F.col("n").cast("double")) + (1 - p) / p * total).otherwise(0.0)
    return own.select("qid", value.alias("rbo"))


def shared_top(a: DataFrame, b: DataFrame, k: int = 10) -> DataFrame:
    """qid, shared: how many of two runs' first k documents are the same."""
    a, b = (r.where(F.col("rank") <= k).select("qid", "doc_id") for r in (a, b))
    every = a.select("qid").union(b.select("qid")).distinct()
    return every.join(a.intersect(b).groupBy("qid").agg(F.count("*").alias("shared")), "qid", "left").na.fill(0, ["shared"])


def consistency(run: DataFrame, p: float = 0.9, k: int = 10) -> DataFrame:
    """run: qid, form, doc_id, rank. The mean RBO of a query's pairs of forms; 1 with fewer than two forms."""
    forms = sorted(r["form"] for r in run.select("form").distinct().collect())
    asked = run.select("qid").distinct()
    parts = None
    for i, f in enumerate(forms):
        for g in forms[:i]:
            one = rbo(run.where(F.col("form") == g), run.where(F.col("form") == f), p, k)
            parts = one if parts is None else parts.unionByName(one)
    if parts is None:
        return asked.select("qid", F.lit(1.0).alias("csc"))
    return parts.groupBy("qid").agg(F.avg("rbo").alias("csc"))


def invariance(scores: DataFrame, forms: list[str], metric: str = "ndcg10") -> DataFrame:
    """scores: system, form, qid, metric. Over queries that all forms share: mean of each form, gap of the first form to each, worst form's mean."""
    full = scores.where(F.col("form").isin(forms)).groupBy("system", "qid").agg(F.count_distinct("form").alias("n"), F.min(metric).alias("worst"), *(F.max(F.when(F.col("form") == f, F.col(metric))).alias(f"m_{f}") for f in forms)).where(F.col("n") == len(forms))
    agg = [F.avg(f"m_{f}").alias(f"mean_{f}") for f in forms] + [(F.avg(f"m_{forms[0]}") - F.avg(f"m_{f}")).alias(f"gap_{f}") for f in forms[1:]]
    return full.groupBy("system").agg(F.count("*").alias("n_queries"), *agg, F.avg("worst").alias("worst"))


def randomisation_test(pairs: DataFrame, keys: list[str], permutations: int = 10_000) -> DataFrame:
    """pairs: keys, qid, a, b. Two-sided p of the mean difference; signs by the parity of an md5 of (query, permutation)."""
    diffs = pairs.select(*keys, "qid", (F.col("a") - F.col("b")).alias("d"))
    observed = diffs.groupBy(*keys).agg(F.avg("d").alias("observed"), F.count("*").alias("n"))
    spark = pairs.sparkSession
    digit = F.substring(F.md5(F.concat(F.col("qid").cast("string"), F.lit("-"), F.col("perm").cast("string"))), 1, 1)
    flipped = diffs.crossJoin(spark.range(permutations).select(F.col("id").alias("perm"))).groupBy(*keys, "perm").agg(F.avg(F.when(F.conv(digit, 16, 10).cast("int") % 2 == 0, F.col("d")).otherwise(-F.col("d"))).alias("mean"))
    out = flipped.join(observed, keys) if keys else flipped.crossJoin(observed)
    return out.groupBy(*keys, "observed", "n").agg(((F.sum((F.abs("mean") >= F.abs("observed") - 1e-12).cast("int")) + 1) / (permutations + 1)).alias("p"))


#: The pairs of systems whose differences are tested.
PAIRS = [("S1", "B1"), ("S1", "S0"), ("S3", "B2"), ("S2", "S1"), ("S3", "S2"), ("D1", "D0"), ("H1", "S3"), ("L1", "H1"), ("G1", "H1"), ("B1", "B1N")]


def pair_table(scores: DataFrame, pairs: list[tuple[str, str]] = PAIRS, metric: str = "ndcg10", permutations: int = 10_000) -> DataFrame:
    """scores: system, form, qid, metric. a, b, form, observed difference, n, p of each pair over the queries that both have."""
    names = scores.sparkSession.createDataFrame(pairs, "a string, b string")
    left, right = (scores.select(F.col("system").alias(c), "form", "qid", F.round(metric, 9).alias(v)) for c, v in (("a", "x"), ("b", "y")))
    rows = names.join(left, "a").join(right, ["b", "form", "qid"]).select("a", "b", "form", "qid", "x", "y")
    return randomisation_test(rows.select(F.concat_ws("-", "a", "b").alias("pair"), "form", "qid", F.col("x").alias("a"), F.col("y").alias("b")), ["pair", "form"], permutations)


def pivot(averages: DataFrame, metric: str, forms: list[str]) -> DataFrame:
    """averages: system, form, metric. One row for each system: the metric by form, and its range over the forms."""
    out = averages.groupBy("system").pivot("form", forms).agg(F.first(metric))
    values = [F.col(f) for f in forms]
    return out.withColumn("range", F.greatest(*values) - F.least(*values))


def latency_summary(times: DataFrame, keys: list[str]) -> DataFrame:
    return times.groupBy(*keys).agg(F.percentile("ms", 0.5).alias("median_ms"), F.percentile("ms", 0.95).alias("p95_ms"))


def grid(axes: dict[str, Iterable]) -> list[dict]:
    return [dict(zip(axes, v, strict=True)) for v in product(*axes.values())]


def tune(points: list[dict], quality: Callable[[dict], float]) -> tuple[dict, list[tuple[dict, float]]]:
    """The first best point, and all points with their quality."""
    tried = [(p, quality(p)) for p in points]
    best = max(range(len(tried)), key=lambda i: (tried[i][1], -i))
    return tried[best][0], tried


#: The grid of the tuning protocol. Stages of sparse tuning: (system, forms, axes), each starting from the best so far.
PROTOCOL = [
    ("B1", ["F1"], {"k1": [0.6, 0.9, 1.2, 1.5, 1.8], "b": [0.3, 0.5, 0.75, 0.9]}),
    ("S1", ["F1", "F2", "F3"], {"w_dhvani": [0.5, 1.0, 1.5, 2.0, 3.0, 4.0]}),
    ("S0", ["F1", "F2", "F3"], {"w_soundex": [0.5, 1.0, 1.5, 2.0, 3.0, 4.0]}),
    ("S3", ["F1", "F2", "F3"], {"w_title": [0.0, 0.5, 1.0, 1.5, 2.0, 3.0], "proximity": [0.0, 1.0, 2.0, 4.0]}),
]


def tune_in_stages(start: dict, quality: Callable[[str, list[str], dict], float], prepare: Callable[[str, list[str], list[dict]], None] | None = None) -> tuple[dict, list[tuple[str, dict, float]]]:
    """prepare(system, forms, points) is told of a stage's points before their quality is asked, so that one plan can score them all."""
    best, log = dict(start), []
    for system, forms, axes in PROTOCOL:
        points = [best | p for p in grid(axes)]
        if prepare:
            prepare(system, forms, points)
        chosen, tried = tune(points, lambda p, s=system, f=forms: quality(s, f, p))
        log += [(system, p, q) for p, q in tried]
        best = chosen
    return best, log
