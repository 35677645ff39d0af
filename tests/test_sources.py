"""Readers, writers, shared tables, the stream and the command line."""

import gzip
import json

import pytest
from pyspark.sql import functions as F

from lekhani import cli
from lekhani.operators import index as ix
from lekhani.sources import files, store
from lekhani.streaming.incremental import index_stream


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_topics_and_qrels(spark, tmp_path):
    (tmp_path / "t.tsv").write_text("7\tone two\n\n  \n8\n9\tx\ty\n")
    assert rows(files.read_topics(spark, str(tmp_path / "t.tsv"))) == [("7", "one two"), ("8", ""), ("9", "x")]
    (tmp_path / "q.txt").write_text("7 0 a 1\n7 0 b 0\nbroken line\n7  0\tb 2\n8 0 a 0\n")
    got = files.read_qrels(spark, str(tmp_path / "q.txt"))
    assert rows(got) == [("7", "a", 1), ("7", "b", 2), ("8", "a", 0)]
    assert rows(files.relevant_docs(got)) == [("7", "a"), ("7", "b")]


def test_corpus_packed_or_not(spark, tmp_path):
    lines = [json.dumps({"docid": str(i), "title": "t", "text": f"चाय {i}"}, ensure_ascii=False) for i in range(5)]
    (tmp_path / "a.jsonl").write_text("\n".join(lines[:2]) + "\n")
    with gzip.open(tmp_path / "b.jsonl.gz", "wt") as f:
        f.write("\n".join(lines[2:]) + "\n")
    got = files.read_corpus(spark, str(tmp_path))
    assert rows(got) == [(str(i), "t", f"चाय {i}") for i in range(5)]
    counted, kept = files.scan_corpus(spark, str(tmp_path), F.col("docid") != "3")
    assert counted == 5 and rows(kept.select("docid")) == [("0",), ("1",), ("2",), ("4",)]


def test_queries_and_forms(spark, tmp_path):
    q = spark.createDataFrame([("1", "sham ki chai"), ("2", "SKIP"), ("3", " "), ("4", 'a "quoted" word')], "qid string, text string")
    files.write_queries(q, str(tmp_path / "f"))
    want = [("1", "sham ki chai"), ("4", 'a "quoted" word')]
    assert rows(files.read_queries(spark, str(tmp_path / "f"))) == want
    assert rows(files.read_forms(spark, {"F1": str(tmp_path / "f"), "F2": str(tmp_path / "f")})) == sorted((f, *w) for f in ("F1", "F2") for w in want)


def test_sheets(spark, tmp_path):
    head = "row\tqid\tdevanagari\troman\tcode_mixed\tenglish\n"
    (tmp_path / "s1.tsv").write_text(head + "1\t7\tचाय\tchai\tskip\ttea\n2\t8\tदूध\t \tdoodh ka glass\n")
    (tmp_path / "s2.tsv").write_text(head + "1\t7\tचाय\tchaay\t\t\n")
    sheets = [files.read_sheet(spark, str(tmp_path / f"s{i}.tsv")) for i in (1, 2)]
    assert rows(files.human_forms(sheets)) == [("F1", "7", "चाय"), ("F1", "8", "दूध"), ("H-CM", "8", "doodh ka glass"), ("H-EN", "7", "tea"), ("H-R1", "7", "chai"), ("H-R2", "7", "chaay")]
    (tmp_path / "s3.tsv").write_text(head + "1\t7\tचाय\tSKIP\t\t\n")
    assert files.human_forms([files.read_sheet(spark, str(tmp_path / "s3.tsv"))]).count() == 0
    blank = files.blank_sheet(files.sample_queries(spark.createDataFrame([(str(i), f"चाय {i}") for i in range(30)], "qid string, text string"), 10, "seed"))
    assert blank.count() == 10 and blank.columns == sheets[0].columns and rows(blank.select("row")) == sorted((str(i),) for i in range(1, 11)) and {r["roman"] for r in blank.collect()} == {""}


def test_runs_rows_and_vectors(spark, tmp_path):
    run = spark.createDataFrame([("B1", "F1", 1, 5, 0.5, 1), ("S1", "F2", 1, 6, 0.25, 2)], "system string, form string, qid long, doc_id long, score double, rank int")
    files.write_runs(run, str(tmp_path / "runs"))
    assert rows(spark.read.parquet(str(tmp_path / "runs")).select(*run.columns)) == rows(run)
    files.write_rows(run, str(tmp_path / "csv"), ["qid", "rank"])
    assert rows(spark.read.csv(str(tmp_path / "csv"), header=True)) == [("1", "1"), ("1", "2")]
    v = spark.createDataFrame([(1, [0.5, 1.0]), (2, [0.25, 0.0])], "doc_id long, v array<double>")
    files.write_vectors(v, str(tmp_path / "v"))
    assert rows(files.read_vectors(spark, str(tmp_path / "v"))) == rows(v)


def test_kept_tables_follow_their_source(spark, tmp_path):
    made = []

    def make():
        made.append(1)
        return spark.read.parquet(f"{tmp_path}/t").select((F.col("id") * 2).alias("x"))

    spark.range(5).write.parquet(f"{tmp_path}/t")
    for _ in range(2):
        assert rows(store.kept(spark, "twice", [f"{tmp_path}/t"], make)) == [(0,), (2,), (4,), (6,), (8,)]
    assert len(made) == 1
    spark.range(7).write.mode("overwrite").parquet(f"{tmp_path}/t")
    assert store.kept(spark, "twice", [f"{tmp_path}/t"], make).count() == 7 and len(made) == 2
    store.forget(spark)
    assert store.kept(spark, "twice", [f"{tmp_path}/t"], make).count() == 7 and len(made) == 3
    assert store.read_spread(spark, f"{tmp_path}/t").rdd.getNumPartitions() == spark.sparkContext.defaultParallelism


@pytest.fixture
def texts(spark, tmp_path):
    spark.createDataFrame([(1, "chai\nsubah ki chai"), (2, "शाम की चाय"), (3, None)], "doc_id long, text string").write.parquet(f"{tmp_path}/docs")
    return f"{tmp_path}/docs"


def test_stream_appends_postings(spark, texts, tmp_path):
    stream = spark.readStream.schema("doc_id long, text string").parquet(texts)
    index_stream(stream, f"{tmp_path}/index", f"{tmp_path}/checkpoint").awaitTermination(120)
    got = spark.read.parquet(f"{tmp_path}/index/postings").select("zone", "term", "doc_id", "tf")
    want = ix.zone_postings(ix.corpus(spark.read.parquet(texts)), positions=False).select("zone", "term", "doc_id", "tf")
    assert rows(got) == rows(want) and got.count() > 0
    assert spark.read.parquet(f"{tmp_path}/index/docs").count() == 3


def test_command_line(spark, texts, capfd):
    cli.main(["search", "chai", "--documents", texts, "--system", "S1", "--k", "2"])
    cli.main(["boolean", "chai AND subah", "--documents", texts, "--explain"])
    cli.main(["phrase", "subah ki chai", "--documents", texts])
    cli.main(["compare", "chai", "--documents", texts, "--systems", "B1,S1"])
    out = capfd.readouterr().out
    assert "S1" in out and "chai" in out and "rbo" in out
