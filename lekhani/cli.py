"""python -m lekhani.cli search|boolean|phrase|compare over a Parquet folder of documents(doc_id, text)."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession

from lekhani.operators import boolean, evaluation
from lekhani.operators import index as ix
from lekhani.plans.systems import SPARSE, Engine


def main(argv: list[str] | None = None) -> None:
    p = argparse.ArgumentParser(prog="lekhani")
    p.add_argument("command", choices=["search", "boolean", "phrase", "compare"])
    p.add_argument("text")
    p.add_argument("--documents", required=True)
    p.add_argument("--system", default="S3", choices=list(SPARSE))
    p.add_argument("--systems", default="B1,S3")
    p.add_argument("--k", type=int, default=10)
    p.add_argument("--explain", action="store_true")
    a = p.parse_args(argv)
    spark = SparkSession.builder.appName("lekhani").getOrCreate()
    docs = ix.corpus(spark.read.parquet(a.documents))
    queries = spark.createDataFrame([(1, a.text)], "qid long, text string")
    if a.command == "boolean":
        wanted = boolean.clauses(spark, [(1, a.text)])
        index = ix.Index(docs, ["all"], False)
        if a.explain:
            boolean.explain_order(wanted, index.term_stats).show()
        boolean.boolean_search(wanted, index.postings).orderBy("doc_id").show(a.k)
    elif a.command == "phrase":
        boolean.phrase_search(queries, ix.zone_terms(docs, ["all"])).orderBy("doc_id").show(a.k)
    else:
        systems = [a.system] if a.command == "search" else a.systems.split(",")
        zones = sorted({z for s in systems for z in [*SPARSE[s], *(["dhvani"] if s == "S3" else [])]})
        engine = Engine(ix.Index(docs, zones))
        runs = {s: engine.search(queries, s, a.k) for s in systems}
        for s in systems:
            print(s)
            engine.present(runs[s]).show(a.k, 60)
            if a.explain:
                for name, table in engine.explain(queries, s, a.k).items():
                    print(name)
                    table.show(a.k, 60)
        if len(systems) == 2:
            evaluation.rbo(*runs.values()).show()


if __name__ == "__main__":
    main()
