"""Corpus statistics and experiments: frequent terms, Zipf, idf histogram, scalars, length bias, key ablation, agreement, samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from lekhani.functions import romanize as R
from lekhani.functions import text as T


def frequencies(docs: DataFrame, parts: int | None = None) -> DataFrame:
    """docs: doc_id, text. term, cf, df with stop words. A document's terms are counted in the one of the parts that cut its text."""
    own = docs.select("doc_id", T.compose(F.col("text")).alias("text"))
    own = own.repartition(parts, "doc_id") if parts else own.repartition("doc_id")
    return own.select("doc_id", F.explode(T.tokenize(F.col("text"), True)).alias("term")).groupBy("term", "doc_id").agg(F.count("*").alias("tf")).groupBy("term").agg(F.sum("tf").alias("cf"), F.count("*").alias("df"))


def top_terms(freq: DataFrame, num_docs: int, n: int = 40) -> DataFrame:
    top = freq.orderBy(F.desc("df"), "term").limit(n)
    return top.select("term", "df", "cf", F.log10(F.lit(float(num_docs)) / F.col("df")).alias("idf"), T.is_stop(F.col("term")).alias("stop"))


def zipf_ranks(n: int) -> list[int]:
    """1 to 100, then each a tenth more and one."""
    out = list(range(1, min(n, 100) + 1))
    while out and out[-1] >= 100 and (nxt := int(out[-1] * 1.1) + 1) <= n:
        out.append(nxt)
    return out


def zipf(freq: DataFrame) -> DataFrame:
    """rank, term, cf at sampled ranks. A term's rank: terms of a larger cf, which a window over the few distinct cf counts, and its place among its own."""
    n = freq.count()
    sizes = freq.groupBy("cf").agg(F.count("*").alias("m"))
    before = sizes.withColumn("before", F.sum("m").over(W.orderBy(F.desc("cf")).rowsBetween(W.unboundedPreceding, -1)))
    numbered = freq.select("term", "cf", F.row_number().over(W.partitionBy("cf").orderBy("term")).alias("own")).join(before, "cf")
    numbered = numbered.select("term", "cf", (F.coalesce("before", F.lit(0)) + F.col("own")).cast("int").alias("rank"))
    wanted = freq.sparkSession.createDataFrame([(r,) for r in zipf_ranks(n)], "rank int")
    return numbered.join(wanted, "rank")


def idf_histogram(freq: DataFrame, num_docs: int, bins: int = 25) -> DataFrame:
    """bin, low, n: equal bins from the least to the largest idf, the last closed."""
    idf = freq.select(F.log10(F.lit(float(num_docs)) / F.col("df")).alias("idf"))
    ends = idf.agg(F.min("idf").alias("lo"), F.max("idf").alias("hi"))
    placed = idf.crossJoin(ends).withColumn("width", (F.col("hi") - F.col("lo")) / bins)
    number = F.when(F.col("width") > 0, F.least(F.floor((F.col("idf") - F.col("lo")) / F.col("width")), F.lit(bins - 1))).otherwise(0)
    return placed.groupBy(number.cast("int").alias("bin")).agg(F.count("*").alias("n"))


def scalars(docs: DataFrame, freq: DataFrame) -> DataFrame:
    own = docs.select(T.tokenize(F.col("text")).alias("t")).select(F.size("t").alias("n"), F.size(F.filter("t", lambda t: T.token_script(t) == "roman")).alias("r"))
    a = own.agg(F.count("*").alias("num_docs"), F.sum("n").alias("num_tokens"), F.avg("n").alias("avg_tokens"), (F.sum("r") / F.sum("n")).alias("roman_share"), F.avg((F.col("r") > 0).cast("double")).alias("docs_with_roman"))
    b = freq.agg(F.count("*").alias("vocabulary"), F.sum((F.col("cf") == 1).cast("long")).alias("hapaxes"))
    top = freq.orderBy(F.desc("df"), "term").limit(40).agg(F.sum(T.is_stop(F.col("term")).cast("long")).alias("top40_stop"))
    return a.crossJoin(b).crossJoin(top)  # one row each


def length_bias(runs: DataFrame, lengths: DataFrame) -> DataFrame:
    """runs: system, qid, doc_id, rank; lengths: doc_id, doc_len. Median length of first documents by system, and of the corpus."""
    first = runs.where("rank = 1").join(lengths, "doc_id").groupBy("system").agg(F.median("doc_len").alias("median_len"))
    return first.unionByName(lengths.agg(F.median("doc_len").alias("median_len")).select(F.lit("corpus").alias("system"), "median_len"))


def key_ablation(tokens: DataFrame) -> DataFrame:
    """tokens: token (distinct). variant, keys, words_per_key: for the default rules and with each one off."""
    variants = {"default": T.KeyRules()} | {f"no_{r}": T.KeyRules().without(r) for r in T.KEY_RULES}
    rows = tokens.select("token", F.inline(F.array(*(F.struct(F.lit(n).alias("variant"), T.phonetic_key(F.col("token"), r).alias("key")) for n, r in variants.items()))))
    by_key = rows.where("key <> ''").groupBy("variant", "key").agg(F.count("*").alias("n"))
    return by_key.groupBy("variant").agg(F.count("*").alias("keys"), F.avg("n").alias("words_per_key"))


def agreement(sheets: DataFrame) -> DataFrame:
    """sheets: annotator, qid, text. Over pairs of annotators of a query: mean bigram Jaccard and relative edit distance of the
    texts; over words of texts with as many tokens: shares of equal spellings and of equal keys (two empty ones are equal)."""
    a, b = sheets.alias("a"), sheets.alias("b")
    pairs = a.join(b, (F.col("a.qid") == F.col("b.qid")) & (F.col("a.annotator") < F.col("b.annotator"))).select(F.col("a.qid").alias("qid"), F.col("a.text").alias("x"), F.col("b.text").alias("y"))
    pairs = pairs.withColumns({"tx": T.tokenize(F.col("x")), "ty": T.tokenize(F.col("y"))})
    texts = pairs.agg(F.count("*").alias("pairs"), F.avg(T.set_jaccard(T.bigrams(F.col("x")), T.bigrams(F.col("y")))).alias("jaccard"), F.avg(T.relative_edit_distance(F.col("x"), F.col("y"))).alias("edit"))
    words = pairs.where(F.size("tx") == F.size("ty")).select(F.explode(F.arrays_zip("tx", "ty")).alias("w")).select(F.col("w.tx").alias("u"), F.col("w.ty").alias("v"))
    spelled = words.agg(F.count("*").alias("words"), F.avg((F.col("u") == F.col("v")).cast("double")).alias("same_spelling"), F.avg((T.phonetic_key(F.col("u")) == T.phonetic_key(F.col("v"))).cast("double")).alias("same_key"))
    return texts.crossJoin(spelled)


def bucket(key: Column, seed: str) -> Column:
    """0 to 99 by the md5 of a key and a seed."""
    return F.conv(F.substring(F.md5(F.concat(key.cast("string"), F.lit(seed))), 1, 8), 16, 10).cast("long") % 100


def mixed_corpus(docs: DataFrame, share: int = 30, seed: str = "mixed") -> DataFrame:
    """docs: doc_id, text. The share of documents whose hash says so is romanised."""
    chosen = bucket(F.col("doc_id"), seed) < share
    return docs.select("doc_id", chosen.alias("romanised"), F.when(chosen, R.romanize(F.col("text"))).otherwise(F.col("text")).alias("text"))


def sample_corpus(docs: DataFrame, judged: DataFrame, n: int, seed: str = "sample") -> DataFrame:
    """doc_id: judged documents and n others drawn by hash order; those drawn twice count once."""
    drawn = docs.orderBy(F.md5(F.concat(F.col("doc_id").cast("string"), F.lit(seed))), "doc_id").limit(n).select("doc_id")
    return docs.join(judged, "doc_id", "left_semi").select("doc_id").union(drawn).distinct()


def idf_examples(tokens: DataFrame, term_stats: DataFrame, num_docs: int, own_df: int, key_df: int, n: int = 15) -> DataFrame:
    """tokens: qid, position, token, term, key. Tokens whose own df is at least own_df and whose key's is larger by key_df; the first n."""
    a = term_stats.where("zone = 'all'").select("term", F.col("df").alias("own_df"))
    b = term_stats.where("zone = 'dhvani'").select(F.col("term").alias("key"), F.col("df").alias("pooled_df"))
    out = tokens.join(a, "term").join(b, "key").where((F.col("own_df") >= own_df) & (F.col("pooled_df") - F.col("own_df") >= key_df))
    idf = lambda c: F.round(F.log10(F.lit(float(num_docs)) / F.col(c)), 6)
    return out.orderBy("qid", "position").limit(n).select("qid", "position", "token", "key", "own_df", "pooled_df", idf("own_df").alias("own_idf"), idf("pooled_df").alias("pooled_idf"))


def overlap_at(a: DataFrame, b: DataFrame, k: int) -> DataFrame:
    """qid, overlap: the share of k documents that two runs have in common."""
    both = a.where(F.col("rank") <= k).select("qid", "doc_id").join(b.where(F.col("rank") <= k).select("qid", "doc_id"), ["qid", "doc_id"])
    return a.select("qid").distinct().join(both.groupBy("qid").agg((F.count("*") / k).alias("overlap")), "qid", "left").select("qid", F.coalesce("overlap", F.lit(0.0)).alias("overlap"))


def hash_split(rows: DataFrame, key: str, percent: int = 10, seed: str = "split") -> DataFrame:
    return rows.withColumn("held_out", bucket(F.col(key), seed) < percent)


def query_forms(topics: DataFrame, seed: int, p: float = 0.3) -> DataFrame:
    """topics: qid, text. form, qid, text: the original (F1), its romanisation (F2) and a casual respelling (F3), drawn by hashes of seed and qid."""
    forms = [("F1", F.col("text")), ("F2", R.romanize(F.col("text"))), ("F3", R.casual(F.col("text"), F.col("qid"), seed, p))]
    out = None
    for name, text in forms:
        one = topics.select(F.lit(name).alias("form"), "qid", text.alias("text"))
        out = one if out is None else out.unionByName(one)
    return out


def variant_postings(found: DataFrame, tokens: DataFrame, variants: dict[str, T.KeyRules]) -> DataFrame:
    """found: occurrences. tokens: token, stop. zone, term, doc_id, tf of one zone of phonetic keys for each variant of the rules."""
    keys = F.array(*(F.struct(F.lit(name).alias("zone"), T.phonetic_key(F.col("token"), rules).alias("term")) for name, rules in variants.items()))
    words = tokens.where("not stop").select("token", F.inline(keys)).where("term <> ''")
    return found.join(words, "token").groupBy("zone", "term", "doc_id").agg(F.sum("tf").alias("tf"))
