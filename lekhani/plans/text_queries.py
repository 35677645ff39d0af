"""Queries over text functions, on the corpus and on golden words."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lekhani.functions import romanize as R
from lekhani.functions import text as T
from lekhani.operators import index as ix
from lekhani.operators import retrieval as rank
from lekhani.plans import sql as S
from lekhani.plans.systems import Engine
from lekhani.sources.store import read_spread

#: Golden words for what the corpus, which has no Devanagari, cannot show.
GOLDEN = ["सुबह", "subah", "subha", "बन्दर", "बंदर", "bandar", "दिल", "dil", "चंपा", "चम्पा", "champa", "कृपा", "kripa", "विज्ञान", "vigyan", "फ़सल", "fasal", "जमीन", "ज़मीन", "zameen", "बच्चा", "bachcha", "आवाज", "aavaaz", "aawaaz", "पाँच", "paanch", "कमरे", "कमरों", "मेजें", "mejen", "१९४७", "1947", "ACHHAAAA", "swagat", "svagat", "स्वागत", "nimmi", "निम्मी", "nana", "se", "मंत्री", "mantri", "शहर", "shahar", "tiger", "tager", "summer", "pfister", "jackson", "डंडा", "danda", "पेड़", "ped", "झूठ", "jhooth", "chain", "chhat", "छत", "taxi", "quiet", "ऋतु", "ओस", "os", "नगर", "बरसना", "गया", "कोई", "फूल", "phool", "fool"]
VALUES = ", ".join(f"({i}, {S.lit(w)})" for i, w in enumerate(GOLDEN))
GOLD = f"gold AS (SELECT * FROM (VALUES {VALUES}) v(n, word))"
GTOK = f"gtok AS (SELECT n, word, unnest({S.tok('word')}) AS token FROM gold)"


def golden(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(enumerate(GOLDEN)), "n int, word string")


def golden_tokens(spark: SparkSession) -> DataFrame:
    return golden(spark).select("n", "word", F.explode(T.tokenize(F.col("word"))).alias("token"))


def documents(spark: SparkSession, d: str) -> DataFrame:
    return read_spread(spark, f"{d}/documents.parquet")


def tokens_of(spark: SparkSession, d: str) -> DataFrame:
    return documents(spark, d).select("doc_id", F.posexplode(T.tokenize(F.col("text"))).alias("position", "token"))


def tok_normalize(spark, d):
    return golden(spark).select(F.col("n").cast("long").alias("n"), T.normalize(F.col("word")).alias("normal"))


def tok_tokens(spark, d):
    return tokens_of(spark, d).groupBy("doc_id").agg(F.count("*").alias("n_tokens"), F.count_distinct("token").alias("n_types"), F.min("token").alias("first_type"), F.max("token").alias("last_type"))


def tok_script(spark, d):
    return tokens_of(spark, d).groupBy(T.token_script(F.col("token")).alias("script")).agg(F.count("*").alias("n")).unionByName(golden_tokens(spark).groupBy(F.concat(F.lit("golden_"), T.token_script(F.col("token"))).alias("script")).agg(F.count("*").alias("n")))


def query_script(spark, d):
    texts = [(0, "subah ki चाय garam है"), (1, "सुबह की चाय"), (2, "subah ki chai"), (3, "1947 ??"), (4, "")]
    return spark.createDataFrame(texts, "n long, text string").select("n", T.query_script(T.tokenize(F.col("text"))).alias("script"))


def tok_stop_flags(spark, d):
    return tokens_of(spark, d).groupBy("token").agg(F.count("*").alias("n")).where(T.is_stop(F.col("token")))


def tok_stem(spark, d):
    return golden_tokens(spark).select(F.col("n").cast("long").alias("n"), "token", T.stem(F.col("token")).alias("stem"))


def tok_phonetic_key(spark, d):
    corpus = tokens_of(spark, d).select("token").distinct().select(F.lit(-1).cast("long").alias("n"), "token", T.phonetic_key(F.col("token")).alias("key"))
    return corpus.unionByName(golden_tokens(spark).select(F.col("n").cast("long").alias("n"), "token", T.phonetic_key(F.col("token")).alias("key")))


def tok_soundex_variant(spark, d):
    return tokens_of(spark, d).select("token").distinct().select("token", T.soundex(F.col("token")).alias("code"))


def tok_key_rules_off(spark, d):
    own = golden_tokens(spark).select(F.col("n").cast("long").alias("n"), "token")
    entries = [F.struct(F.lit(r).alias("rule"), T.phonetic_key(F.col("token"), T.KeyRules().without(r)).alias("key")) for r in T.KEY_RULES]
    return own.select("n", "token", F.inline(F.array(*entries)))


def tok_romanize(spark, d):
    return golden(spark).select(F.col("n").cast("long").alias("n"), R.romanize(F.col("word")).alias("roman"))


def tok_casual(spark, d):
    return golden(spark).select(F.col("n").cast("long").alias("n"), R.casual(F.col("word"), F.col("n"), 13, 1.0).alias("casual"))


def tok_translit(spark, d):
    return golden_tokens(spark).where(T.token_script(F.col("token")) == "roman").select(F.col("n").cast("long").alias("n"), T.stem(R.itrans(F.col("token"))).alias("term"))


def pairs_of(spark, d):
    b = spark.read.parquet(f"{d}/benchmark.parquet").select("item_id", F.get(T.tokenize(F.col("text")), F.lit(0)).alias("a"), F.get(T.tokenize(F.col("text")), F.lit(2)).alias("b"))
    return b.select("item_id", F.coalesce("a", F.lit("")).alias("a"), F.coalesce("b", F.lit("")).alias("b"))


def str_bigram_jaccard(spark, d):
    return pairs_of(spark, d).select("item_id", F.round(T.set_jaccard(T.bigrams(F.col("a")), T.bigrams(F.col("b"))), 6).alias("jaccard"))


def str_edit_distance(spark, d):
    return pairs_of(spark, d).select("item_id", T.edit_distance(F.col("a"), F.col("b")).cast("long").alias("distance"), F.round(T.relative_edit_distance(F.col("a"), F.col("b")), 6).alias("relative"))


def str_snippet(spark, d):
    return documents(spark, d).select("doc_id", T.snippet(F.col("text")).alias("snippet"))


def str_highlight(spark, d):
    stems, keys = F.array(*map(F.lit, ["the", "सुबह"])), F.array(*map(F.lit, ["SBH"]))
    marked = F.filter(T.highlight(F.coalesce(F.col("text"), F.lit("")), stems, keys), lambda w: w["hit"])
    return spark.read.parquet(f"{d}/benchmark.parquet").select("item_id", F.size(marked).cast("long").alias("n_hits"))


def starts_with_sign(spark, d):
    return golden(spark).select(F.col("n").cast("long").alias("n"), T.starts_with_sign(F.substring("word", 2, 100)).alias("sign"))


def tok_analyze(spark, d):
    """Every token of the golden words and of the benchmark's items, analysed."""
    items = spark.read.parquet(f"{d}/benchmark.parquet").select(F.col("item_id").alias("qid"), "text")
    texts = items.unionByName(golden(spark).select((-1 - F.col("n")).cast("long").alias("qid"), F.col("word").alias("text")))
    return rank.analyze(texts).withColumn("position", F.col("position").cast("long"))


def bm25_golden(spark, d):
    """System S1 over the golden words, each a document and a query: words of one sound in two scripts find each other."""
    docs = golden(spark).select(F.col("n").cast("long").alias("doc_id"), F.lit("").alias("title"), F.col("word").alias("body"))
    queries = golden(spark).select(F.col("n").cast("long").alias("qid"), F.col("word").alias("text"))
    return Engine(ix.Index(docs, ["all", "dhvani"])).search(queries, "S1", 10).withColumn("rank", F.col("rank").cast("long"))


QUERIES = {f.__name__: f for f in (tok_analyze, bm25_golden, tok_normalize, tok_tokens, tok_script, query_script, tok_stop_flags, tok_stem, tok_phonetic_key, tok_soundex_variant, tok_key_rules_off, tok_romanize, tok_casual, tok_translit, str_bigram_jaccard, str_edit_distance, str_snippet, str_highlight, starts_with_sign)}

DTOK = f"dtok AS (SELECT doc_id, unnest({S.tok('text')}) AS token FROM documents)"
_RULES = " UNION ALL ".join(f"SELECT n, token, '{r}' AS rule, {S.key_from('u', 'token', T.KeyRules().without(r))} AS key FROM (SELECT n, token, {S.units('token', T.KeyRules().without(r))} AS u FROM gtok)" for r in T.KEY_RULES)
_PAIR = f"p AS (SELECT item_id, coalesce(ts[1], '') AS a, coalesce(ts[3], '') AS b FROM (SELECT item_id, {S.tok('text')} AS ts FROM benchmark))"
_BI = "list_distinct([substr(' ' || {0} || ' ', i, 2) for i in range(1, length({0}) + 2)])"
ORACLES = {
    "tok_analyze": f"WITH {GOLD}, x AS (SELECT item_id AS qid, {S.tok('text')} AS ts FROM benchmark UNION ALL SELECT -1 - n, {S.tok('word')} FROM gold), t AS (SELECT qid, unnest(ts) AS token, unnest(range(len(ts))) AS position FROM x) SELECT qid, position, token, {S.script('token')} AS script, {S.stop('token')} AS stop, {S.stem('token')} AS stem, {S.key_from(S.units('token'), 'token')} AS key FROM t",
    "bm25_golden": f"WITH {GOLD}, documents AS (SELECT n::BIGINT AS doc_id, word AS text FROM gold), {S.base(['all', 'dhvani'], True, 'q AS (SELECT n::BIGINT AS qid, word AS text FROM gold)')[5:]}, {S.bm25({'all': 1.0, 'dhvani': 2.0})}, {S.top()} SELECT qid, doc_id, score, rank FROM run",
    "tok_normalize": f"WITH {GOLD} SELECT n::BIGINT AS n, {S.norm('word')} AS normal FROM gold",
    "tok_tokens": f"WITH {DTOK} SELECT doc_id, count(*) AS n_tokens, count(DISTINCT token) AS n_types, min(token) AS first_type, max(token) AS last_type FROM dtok GROUP BY doc_id",
    "tok_script": f"WITH {DTOK}, {GOLD}, {GTOK} SELECT {S.script('token')} AS script, count(*) AS n FROM dtok GROUP BY 1 UNION ALL SELECT 'golden_' || {S.script('token')}, count(*) FROM gtok GROUP BY 1",
    "query_script": "SELECT * FROM (VALUES (0::BIGINT, 'mixed'), (1, 'deva'), (2, 'roman'), (3, 'none'), (4, 'none')) v(n, script)",
    "tok_stop_flags": f"WITH {DTOK} SELECT token, count(*) AS n FROM dtok WHERE {S.stop('token')} GROUP BY token",
    "tok_stem": f"WITH {GOLD}, {GTOK} SELECT n::BIGINT AS n, token, {S.stem('token')} AS stem FROM gtok",
    "tok_phonetic_key": f"WITH {DTOK}, {GOLD}, {GTOK}, every AS (SELECT DISTINCT -1::BIGINT AS n, token FROM dtok UNION ALL SELECT n::BIGINT, token FROM gtok), u AS (SELECT n, token, {S.units('token')} AS u FROM every) SELECT n, token, {S.key_from('u', 'token')} AS key FROM u",
    "tok_soundex_variant": f"WITH {DTOK} SELECT token, {S.soundex('token')} AS code FROM (SELECT DISTINCT token FROM dtok)",
    "tok_key_rules_off": f"WITH {GOLD}, {GTOK} SELECT n::BIGINT AS n, token, rule, key FROM ({_RULES})",
    "str_bigram_jaccard": f"WITH {_PAIR} SELECT item_id, round(CASE WHEN len(list_distinct(x || y)) = 0 THEN 1.0 ELSE len(list_intersect(x, y)) / len(list_distinct(x || y)) END, 6) AS jaccard FROM (SELECT item_id, {_BI.format('a')} AS x, {_BI.format('b')} AS y FROM p)",
    "str_edit_distance": f"WITH {_PAIR} SELECT item_id, levenshtein(a, b)::BIGINT AS distance, round(levenshtein(a, b) / greatest(length(a), length(b), 1), 6) AS relative FROM p",
    "str_snippet": "SELECT doc_id, CASE WHEN length(text) > 220 THEN substr(text, 1, 220) || '…' ELSE text END AS snippet FROM documents",
    "str_highlight": f"WITH w AS (SELECT item_id, unnest(string_split(text, ' ')) AS word FROM benchmark), t AS (SELECT item_id, row_number() OVER () AS r, {S.tok('word')} AS ts FROM w), x AS (SELECT item_id, r, unnest(ts) AS token FROM t), y AS (SELECT item_id, r, max((stem IN ('the', 'सुबह') OR key = 'SBH')::INT) AS hit FROM (SELECT item_id, r, {S.stem('token')} AS stem, {S.key_from(S.units('token'), 'token')} AS key FROM x) GROUP BY ALL) SELECT b.item_id, coalesce(sum(hit), 0)::BIGINT AS n_hits FROM benchmark b LEFT JOIN y USING (item_id) GROUP BY b.item_id",
    "starts_with_sign": f"WITH {GOLD} SELECT n::BIGINT AS n, regexp_matches(substr(word, 2), '^[ऀ-ःऺ-ॏ]') AS sign FROM gold",
}
