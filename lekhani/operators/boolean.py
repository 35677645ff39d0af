"""Boolean and phrase retrieval. A query's words are parsed on the driver; documents are found by one aggregation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lekhani.functions import text as T
from lekhani.operators.retrieval import query_tokens


def parse(query: str) -> list[tuple[str, str]]:
    """(kind, word): and, or, not. Words without an operator are joined by and; operators are upper case; not wins over the other two."""
    out, kind = [], "and"
    for word in query.split():
        if word in ("AND", "OR", "NOT"):
            kind = word.lower() if kind != "not" else kind
        else:
            out.append((kind, word))
            kind = "and"
    return out


def clauses(spark, queries: list[tuple[int, str]]) -> DataFrame:
    """qid, n, kind, term: the stem of each word's first token, null if it has none."""
    rows = [(q, n, kind, word) for q, text in queries for n, (kind, word) in enumerate(parse(text))]
    words = spark.createDataFrame(rows, "qid long, n int, kind string, word string")
    token = F.get(T.tokenize(F.col("word")), F.lit(0))
    return words.select("qid", "n", "kind", T.stem(token).alias("term"))


def boolean_search(wanted: DataFrame, postings: DataFrame) -> DataFrame:
    """qid, doc_id: (all and-terms, or any or-term) and no not-term. Without an and-term only or-terms find anything."""
    size = wanted.groupBy("qid").agg(F.count_distinct(F.when(F.col("kind") == "and", F.coalesce("term", F.lit("")))).alias("need"))
    found = wanted.where("term is not null").join(postings.where("zone = 'all'").select("term", "doc_id"), "term").join(size, "qid")
    held = found.groupBy("qid", "doc_id", "need").agg(F.count_distinct(F.when(F.col("kind") == "and", F.col("term"))).alias("ands"), F.max((F.col("kind") == "or").cast("int")).alias("ors"), F.max((F.col("kind") == "not").cast("int")).alias("nots"))
    return held.where("((need > 0 and ands = need) or ors = 1) and nots = 0").select("qid", "doc_id")


def explain_order(wanted: DataFrame, term_stats: DataFrame) -> DataFrame:
    """qid, term, df of the and-terms, rarest first."""
    df = term_stats.where("zone = 'all'").select("term", "df")
    return wanted.where("kind = 'and'").join(df, "term", "left").select("qid", "term", F.coalesce("df", F.lit(0)).alias("df")).orderBy("qid", "df", "term")


def intersect(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.select("doc_id").intersect(b.select("doc_id"))


def union(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.select("doc_id").union(b.select("doc_id")).distinct()


def difference(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.select("doc_id").subtract(b.select("doc_id"))


def phrase_search(queries: DataFrame, terms: DataFrame) -> DataFrame:
    """qid, doc_id: documents where every term of the phrase stands at its distance from the first; stop words leave gaps.

    queries: qid, text. terms: zone, term, doc_id, position. Relational division: a start at which as many offsets meet as there are.
    """
    offsets = query_tokens(queries).where("not stop").select("qid", "position", T.stem(F.col("token")).alias("term"))
    first = offsets.groupBy("qid").agg(F.min("position").alias("first"), F.count_distinct("position").alias("need"))
    offsets = offsets.join(first, "qid").select("qid", "term", "need", (F.col("position") - F.col("first")).alias("offset"))
    met = offsets.join(terms.where("zone = 'all'").select("term", "doc_id", "position"), "term").groupBy("qid", "doc_id", "need", (F.col("position") - F.col("offset")).alias("start")).agg(F.count_distinct("offset").alias("met"))
    return met.where("met = need").select("qid", "doc_id").distinct()


def skip_merge(a: list[int], b: list[int], skips: bool = True) -> tuple[list[int], int]:
    """Intersection of two sorted lists and the comparisons that it took, with jumps of the square root of a list's length."""
    out, i, j, seen = [], 0, 0, 0
    leap = [max(1, int(len(x) ** 0.5)) for x in (a, b)]
    while i < len(a) and j < len(b):
        seen += 1
        if a[i] == b[j]:
            out.append(a[i])
            i, j = i + 1, j + 1
            continue
        behind_a = a[i] < b[j]
        own, at, other, step = (a, i, b[j], leap[0]) if behind_a else (b, j, a[i], leap[1])
        moved = False
        while skips and at % step == 0 and at + step < len(own):
            seen += 1
            if own[at + step] > other:
                break
            at, moved = at + step, True
        at += 0 if moved else 1
        i, j = (at, j) if behind_a else (i, at)
    return out, seen
