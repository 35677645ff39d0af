"""Zoned positional postings and their statistics as DataFrames.

A corpus is docs(doc_id, title, body). The zones of a document: `all` (stems), `title`, `dhvani` (phonetic keys), `soundex`,
`nostem` (tokens) and `raw` (words between white space). Positions count all tokens, stop words too; the body starts one
place after the title's end, so no phrase crosses from one to the other.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from lekhani.functions import romanize as R
from lekhani.functions import text as T

ZONES = ["all", "title", "dhvani", "soundex", "nostem", "raw"]
POSITIONAL = ["all", "dhvani"]
CHAMPIONS = 200


def corpus(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Title: the text before the first line feed, if there is one. Null texts are empty."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    at = F.instr(text, "\n")
    return documents.select(F.col(id_col).alias("doc_id"), F.when(at > 0, F.substring(text, F.lit(1), at - 1)).otherwise("").alias("title"), F.when(at > 0, F.substring(text, at + 1, F.length(text))).otherwise(text).alias("body"))


def by_document(docs: DataFrame, parts: int | None = None) -> DataFrame:
    """doc_id, title, body, composed; all of a document's rows in one of the parts, so that sums by document need no further exchange."""
    own = docs.select("doc_id", T.compose(F.col("title")).alias("title"), T.compose(F.col("body")).alias("body"))
    return own.repartition(parts, "doc_id") if parts else own.repartition("doc_id")


def tokens(docs: DataFrame, composed: bool = False) -> DataFrame:
    """doc_id, token, position, in_title."""
    cut = docs.select("doc_id", T.tokenize(F.col("title"), composed).alias("t"), T.tokenize(F.col("body"), composed).alias("b"))
    both = F.concat(
        F.transform("t", lambda x, i: F.struct(x.alias("token"), i.alias("position"), F.lit(True).alias("in_title"))),
        F.transform("b", lambda x, i: F.struct(x.alias("token"), (i + F.size("t") + 1).alias("position"), F.lit(False).alias("in_title"))),
    )
    return cut.select("doc_id", F.inline(both))


def terms_of(token: Column) -> dict[str, Column]:
    """The term of a token that isn't a stop word, by zone; "" is none. For query tokens; a corpus takes them from its dictionary."""
    return {"all": T.stem(token), "nostem": token, "dhvani": T.phonetic_key(token), "soundex": T.soundex(token, R.romanize(F.when(token.rlike(T.DEVANAGARI), token)))}


def dictionary(tokens: DataFrame) -> DataFrame:
    """tokens: token. One row for each distinct token: stop, stem, key, sdx. Only here are tokens analysed, romanised ones in Python."""
    made = terms_of(F.col("token"))
    return tokens.select("token").distinct().select("token", T.is_stop(F.col("token")).alias("stop"), made["all"].alias("stem"), made["dhvani"].alias("key"), made["soundex"].alias("sdx"))


#: Columns of the dictionary that hold the zones' terms.
TERM = {"all": "stem", "title": "stem", "dhvani": "key", "soundex": "sdx", "nostem": "token"}


def occurrences(docs: DataFrame, parts: int | None = None, positions: bool = True) -> DataFrame:
    """doc_id, token, in_title, tf and, if asked for, positions (sorted): one row for each token of a document."""
    apart = by_document(docs, parts)
    if positions:
        return tokens(apart, True).groupBy("doc_id", "token", "in_title").agg(F.count("*").alias("tf"), F.sort_array(F.collect_list("position")).alias("positions"))
    cut = apart.select("doc_id", T.tokenize(F.col("title"), True).alias("t"), T.tokenize(F.col("body"), True).alias("b"))
    zoned = F.array(F.struct(F.lit(True).alias("in_title"), F.col("t").alias("own")), F.struct(F.lit(False).alias("in_title"), F.col("b").alias("own")))
    return cut.select("doc_id", F.inline(zoned)).select("doc_id", "in_title", F.explode("own").alias("token")).groupBy("doc_id", "token", "in_title").agg(F.count("*").alias("tf"))


def _raw(docs: DataFrame) -> DataFrame:
    words = T.white_words(F.concat_ws(" ", "title", "body"))
    return docs.select("doc_id", F.posexplode(words).alias("position", "term")).select(F.lit("raw").alias("zone"), "term", "doc_id", "position")


def _entries(zones: list[str]) -> Column:
    cooked = [z for z in zones if z != "raw"]
    return F.array(*(F.struct(F.lit(z).alias("zone"), F.col(TERM[z]).alias("term"), (F.col("in_title") if z == "title" else F.lit(True)).alias("ok")) for z in cooked))


def zone_terms(docs: DataFrame, zones: list[str] = ZONES) -> DataFrame:
    """zone, term, doc_id, position: one row for each place."""
    out = None
    if set(zones) != {"raw"}:
        every = tokens(docs)
        own = every.join(dictionary(every).where("not stop"), "token")
        out = own.select("doc_id", "position", F.inline(_entries(zones))).where("ok and term <> ''").select("zone", "term", "doc_id", "position")
    if "raw" in zones:
        out = _raw(docs) if out is None else out.unionByName(_raw(docs))
    return out


def _sounds(docs: DataFrame, parts: int | None) -> DataFrame:
    """zone, term, doc_id, tf of the zone soundex. Only texts with Devanagari meet Python, after which Spark forgets where rows are."""
    deva = F.col("title").rlike(T.DEVANAGARI) | F.col("body").rlike(T.DEVANAGARI)
    plain = occurrences(docs, parts, False).where(~T.is_stop(F.col("token")) & ~F.col("token").rlike(T.DEVANAGARI)).select("doc_id", "tf", T.soundex(F.col("token")).alias("term"))
    spelt = occurrences(docs.where(deva), parts, False).where(~T.is_stop(F.col("token")) & F.col("token").rlike(T.DEVANAGARI)).select("doc_id", "tf", terms_of(F.col("token"))["soundex"].alias("term"))
    both = plain.unionByName(spelt).where("term <> ''")
    return both.groupBy(F.lit("soundex").alias("zone"), "term", "doc_id").agg(F.sum("tf").alias("tf"))


def zone_postings(docs: DataFrame, zones: list[str] = ZONES, positions: bool = True, parts: int | None = None) -> DataFrame:
    """zone, term, doc_id, tf and, if asked for, the sorted positions (of the zones in POSITIONAL).

    A document's postings are summed where its text was cut, so texts move once and postings don't (but for soundex).
    """
    out = None
    group = [z for z in zones if z not in ("raw", "soundex")]
    placed = positions and bool(set(group) & set(POSITIONAL))
    more = ["positions"] if placed else []
    if group:
        found = occurrences(docs, parts, placed).where(~T.is_stop(F.col("token")))
        used, made = {TERM[z] for z in group}, terms_of(F.col("token"))
        own = found.select("doc_id", "tf", "in_title", "token", *more, *(made[z].alias(c) for z, c in (("all", "stem"), ("dhvani", "key")) if c in used))
        own = own.select("doc_id", "tf", *more, F.inline(_entries(group))).where("ok and term <> ''")
        places = F.sort_array(F.flatten(F.collect_list(F.when(F.col("zone").isin(POSITIONAL), F.col("positions"))))).alias("positions")
        out = own.groupBy("zone", "term", "doc_id").agg(F.sum("tf").alias("tf"), *([places] if placed else []))
        out = out.withColumn("positions", F.array().cast("array<int>")) if positions and not placed else out
    if "soundex" in zones:
        sounds = _sounds(docs, parts)
        sounds = sounds.withColumn("positions", F.array().cast("array<int>")) if positions else sounds
        out = sounds if out is None else out.unionByName(sounds)
    if "raw" in zones:
        apart = docs.select("doc_id", "title", "body")
        raw = postings(_raw(apart.repartition(parts, "doc_id") if parts else apart.repartition("doc_id")))
        raw = raw.withColumn("positions", F.array().cast("array<int>")) if positions else raw
        out = raw if out is None else out.unionByName(raw)
    return out


def postings(terms: DataFrame, positions: bool = False) -> DataFrame:
    """zone, term, doc_id, tf and, if asked for, the sorted positions."""
    more = [F.sort_array(F.collect_list("position")).alias("positions")] if positions else []
    return terms.groupBy("zone", "term", "doc_id").agg(F.count("*").alias("tf"), *more)


def term_stats(post: DataFrame) -> DataFrame:
    return post.groupBy("zone", "term").agg(F.count("*").alias("df"), F.sum("tf").alias("cf"))


def doc_stats(post: DataFrame, docs: DataFrame, zones: list[str] = ZONES) -> DataFrame:
    """zone, doc_id, doc_len, lnc_norm; a document without terms has length 0 and norm 1."""
    own = post.groupBy("zone", "doc_id").agg(F.sum("tf").alias("doc_len"), F.sqrt(F.sum(F.pow(1 + F.log10("tf"), F.lit(2.0)))).alias("lnc_norm"))
    every = docs.select("doc_id", F.explode(F.array(*map(F.lit, zones))).alias("zone"))
    out = every.join(own, ["zone", "doc_id"], "left")
    return out.select("zone", "doc_id", F.coalesce("doc_len", F.lit(0)).cast("long").alias("doc_len"), F.coalesce("lnc_norm", F.lit(1.0)).alias("lnc_norm"))


def zone_stats(stats: DataFrame) -> DataFrame:
    return stats.groupBy("zone").agg(F.count("*").alias("num_docs"), F.avg("doc_len").alias("avg_len"))


def plain_idf(n: Column, df: Column) -> Column:
    return F.when(df > 0, F.log10(n / df)).otherwise(0.0)


def champions(post: DataFrame, r: int = CHAMPIONS) -> DataFrame:
    """The r postings of each term with the highest tf, ties by the smaller doc_id; all of them where there are no more than r."""
    by = W.partitionBy("zone", "term").orderBy(F.desc("tf"), "doc_id")
    return post.withColumn("place", F.row_number().over(by)).where(F.col("place") <= r).drop("place")


class Index:
    """The tables of an index, each a plan until written, and made only when asked for."""

    TABLES = ["postings", "term_stats", "doc_stats", "zone_stats", "champions"]

    def __init__(self, docs: DataFrame, zones: list[str] = ZONES, positions: bool = True, tables: dict[str, DataFrame] | None = None, keep: Callable[[str, Callable[[], DataFrame]], DataFrame] | None = None, by_zone: Callable[[str, list[str], Callable[[list[str]], DataFrame]], DataFrame] | None = None, parts: int | None = None):
        """keep(name, make): where a table's rows are to be taken from; otherwise they are made anew by each plan that reads them.

        by_zone(name, zones, make): the same of tables that are kept zone by zone; make gives those of some zones.
        """
        keep = keep or (lambda _, make: make())
        self.docs, self.zones, self.positions, self.parts, self.given, self._made = docs, zones, positions, parts, tables, {}
        self._by_zone = by_zone or (lambda name, zones, make: keep(name, lambda: make(zones)))
        self._kept_by_zone = by_zone

    def _make(self, name: str, zones: list[str]) -> DataFrame:
        if name == "postings":
            return zone_postings(self.docs, zones, self.positions, self.parts)
        own = self.only(zones) if self._kept_by_zone else self
        if name == "term_stats":
            return term_stats(own.postings)
        if name == "doc_stats":
            return doc_stats(own.postings, self.docs, zones)
        if name == "zone_stats":
            return zone_stats(own.doc_stats)
        return champions(own.postings.select("zone", "term", "doc_id", "tf"))

    def __getattr__(self, name: str) -> DataFrame:
        if name not in Index.TABLES:
            raise AttributeError(name)
        if self.given is not None:
            return self.given[name]
        if name not in self._made:
            self._made[name] = self._by_zone(name, self.zones, lambda zones: self._make(name, zones))
        return self._made[name]

    @property
    def tables(self) -> dict[str, DataFrame]:
        return {name: getattr(self, name) for name in Index.TABLES}

    def only(self, zones: list[str]) -> Index:
        """The index of some zones: what is kept by zone is made and read of these only."""
        zones = list(dict.fromkeys(zones))
        if self._kept_by_zone:
            return Index(self.docs, zones, self.positions, by_zone=self._kept_by_zone, parts=self.parts)
        return _Part(self, zones)

    def places(self, zone: str, queries: DataFrame, run: DataFrame | None = None) -> DataFrame:
        """term, doc_id, positions of the terms (term) of queries, in the documents of a run if one is given.

        Where postings have no positions, they come from the texts of these documents; a token is analysed once.
        """
        own = self.only([zone])
        if self.positions:
            return own.postings.where(F.col("zone") == zone).select("term", "doc_id", "positions")
        docs = self.docs if run is None else self.docs.join(run.select("doc_id").distinct(), "doc_id", "left_semi")
        every = tokens(docs).select("doc_id", "token", "position")
        words = every.select("token").distinct().where(~T.is_stop(F.col("token"))).select("token", terms_of(F.col("token"))["all" if zone == "title" else zone].alias("term")).join(queries.select("term").distinct(), "term", "left_semi")
        return every.join(words, "token").groupBy("term", "doc_id").agg(F.sort_array(F.collect_list("position")).alias("positions"))

    def save(self, path: str) -> None:
        """Parquet by zone, postings sorted by term, so that a zone filter prunes files and a term filter row groups."""
        for name, df in self.tables.items():
            order = [c for c in ("term", "doc_id") if c in df.columns]
            (df.repartition("zone", *order[:1]).sortWithinPartitions("zone", *order) if order else df).write.mode("overwrite").partitionBy("zone").parquet(f"{path}/{name}")
        self.docs.write.mode("overwrite").parquet(f"{path}/docs")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> Index:
        tables = {name: spark.read.parquet(f"{path}/{name}") for name in cls.TABLES}
        return cls(spark.read.parquet(f"{path}/docs"), tables=tables)


class _Part(Index):
    """Some zones of an index, by filters of its tables."""

    def __init__(self, whole: Index, zones: list[str]):
        super().__init__(whole.docs, zones, whole.positions)
        self.whole = whole

    def __getattr__(self, name: str) -> DataFrame:
        if name not in Index.TABLES:
            raise AttributeError(name)
        return getattr(self.whole, name).where(F.col("zone").isin(self.zones))
