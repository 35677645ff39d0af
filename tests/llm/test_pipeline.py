"""The five stages on a small table, each written and read again, against plain Python on the stage's own input."""

import random
import re

import corpus_pipeline
import pytest
import tokenizers

from lekhani.llm import bpe, decontaminate

rng = random.Random(21)
WORDS = ["".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(3, 9))) for _ in range(500)]


def prose(n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


def page(lines, n=25):
    return "\n".join(prose(n).capitalize() + "." for _ in range(lines))


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("tables"))
    items = [prose(30) for _ in range(3)]
    good = [page(6) for _ in range(30)]
    good[5] = "\n".join([good[4].split("\n")[0], *page(5).split("\n")])  # a repeated line
    good[6] = "\n".join([good[4].split("\n")[1].replace("a", "b", 1), *page(5).split("\n")])  # a line that is nearly one
    good[7] = good[8]  # an exact copy
    good[9] = page(1, 80)
    good[10] = good[9].replace(" ", "  ", 3).rsplit(" ", 3)[0] + " zzz yyy xxx."  # a near copy in one line
    good[11] = page(2) + "\n" + prose(12) + " " + items[0] + " " + prose(12)
    bad = [" ".join(w + "!!" for w in prose(60).upper().split()) + " | $$ {%d}" % i for i in range(12)]
    rows = [(i, t, "aa", "web", len(t)) for i, t in enumerate(good + bad)] + [(90, None, None, None, None), (91, "", "aa", "web", 0), (92, good[20], "bb", "x", 1)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{d}/documents.parquet")
    labels = [(i, 1, 0) for i in range(0, 30, 2)] + [(30 + i, 0, 0) for i in range(0, 12, 2)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    spark.createDataFrame([(i, t) for i, t in enumerate(items)] + [(8, None), (9, "")], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    return d, items


def low(n, linked):
    label = list(range(n))
    while True:
        new = [min([label[i], *(label[j] for j in range(n) if linked(i, j))]) for i in range(n)]
        if new == label:
            return label
        label = new


def similar(a, b, least):
    return bool(a and b) and 100 * len(a & b) >= least * len(a | b)


def lines_left(rows):
    every = [(i, k, re.sub(r"[ \t\r\x0b\x0c]+", " ", x.lower()).strip(" ")) for i, t in rows for k, x in enumerate((t or "").split("\n"))]
    every = sorted(x for x in every if x[2])
    sets = [{s[i : i + 8] for i in range(len(s) - 7)} or {s} for _, _, s in every]
    label = low(len(every), lambda i, j: similar(sets[i], sets[j], 80))
    gone = {every[i][:2] for i in range(len(every)) if label[i] != i}
    return {i: t if not any(g[0] == i for g in gone) else "\n".join(x for k, x in enumerate(t.split("\n")) if (i, k) not in gone) for i, t in rows}


def documents_left(rows):
    rows = sorted(rows)
    words = [re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")) for _, t in rows]
    sets = [{tuple(w[i : i + 5]) for i in range(len(w) - 4)} or ({tuple(w)} if w else set()) for w in words]
    label = low(len(rows), lambda i, j: similar(sets[i], sets[j], 80))
    return {rows[i][0]: rows[i][1] for i in range(len(rows)) if label[i] == i}


def test_stages(spark, folder, tmp_path):
    d, items = folder
    docs, seen = spark.read.parquet(f"{d}/documents.parquet"), {}
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES:
        before = [(r["doc_id"], r["text"]) for r in docs.collect()]
        stage(spark, docs, d).write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        if name != "bpe":
            assert docs.columns == columns
            got = {r["doc_id"]: r["text"] for r in docs.collect()}
            assert len(got) == docs.count()
        if name == "quality":
            assert set(range(30)) | {92} <= set(got) and not set(got) & set(range(30, 42)) and all(got[i] == dict(before)[i] for i in got)
        elif name == "lines":
            assert got == lines_left(before)
            assert got[5] != dict(before)[5] and got[6] != dict(before)[6] and got[92] == "" and all(r["n_chars"] == len(r["text"]) for r in docs.where("text is not null").collect())
        elif name == "near_duplicates":
            assert got == documents_left(before)
        elif name == "decontamination":
            want = {i: t for i, t in before if not any(decontaminate.normal(x) in decontaminate.normal(t) for x in items)}
            assert got == want and 11 not in got
        else:
            theirs = tokenizers.Tokenizer.from_file(bpe.tokenizer_path())
            theirs.no_truncation()
            theirs.no_padding()
            ids = {i: theirs.encode(t or "", add_special_tokens=False).ids for i, t in before}
            assert {r["doc_id"]: (list(r["ids"]), r["decoded"]) for r in docs.collect()} == {i: (x, theirs.decode(x, skip_special_tokens=False)) for i, x in ids.items()}
            seen = {r["doc_id"]: list(r["ids"]) for r in docs.collect()}
    assert {r["doc_id"]: list(r["ids"]) for r in corpus_pipeline.run(spark, d).collect()} == seen


def test_near_duplicates_alone(spark, folder, tmp_path):
    """On documents whose lines still stand, so that there are copies to find."""
    d, _ = folder
    docs = spark.read.parquet(f"{d}/documents.parquet")
    before = [(r["doc_id"], r["text"]) for r in docs.collect()]
    got = {r["doc_id"]: r["text"] for r in corpus_pipeline.near_duplicate_stage(spark, docs, d).collect()}
    assert got == documents_left(before) and 8 not in got and 10 not in got and 92 not in got


def test_empty_tables(spark, folder, tmp_path):
    d, _ = folder
    for t in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{d}/{t}.parquet").limit(0).write.parquet(f"{tmp_path}/{t}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
