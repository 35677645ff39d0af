"""Pools that need several blocks, and pools held bucket by bucket, against brute force; items of a benchmark in several chunks."""

import random
import re

import pytest

from lekhani.llm import decontaminate, linking, lines, minhash

rng = random.Random(4)
WORDS = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 7))) for _ in range(300)]


def prose(n):
    return [rng.choice(WORDS) for _ in range(n)]


def edited(w, n):
    w = list(w)
    for i in rng.sample(range(len(w)), n):
        w[i] = rng.choice(WORDS)
    return w


def low(n, linked):
    label = list(range(n))
    while True:
        new = [min([label[i], *(label[j] for j in range(n) if linked[i][j])]) for i in range(n)]
        if new == label:
            return label
        label = new


#: A group around one text in which many pairs are near the threshold on either side, and some other texts.
BASE = prose(60)
TEXTS = [edited(BASE, k) for k in (1, 2, 2, 3, 3, 4, 4, 5, 5, 6, 6, 7, 8, 9, 10) for _ in range(3)] + [prose(60) for _ in range(10)]


@pytest.mark.parametrize(("block", "pool"), [(5, 1 << 16), (7, 3), (512, 1 << 16)])
def test_documents(spark, monkeypatch, block, pool):
    monkeypatch.setattr(minhash, "BLOCK", block)
    monkeypatch.setattr(linking, "POOL", pool)
    sets = [{tuple(w[i : i + 3]) for i in range(len(w) - 2)} for w in TEXTS]
    linked = [[100 * len(a & b) >= 60 * len(a | b) for b in sets] for a in sets]
    rows = [(f"d{i:03}", " ".join(w), 1, "x") for i, w in enumerate(TEXTS)]
    got = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id string, text string, n int, component string"), 3, 60)
    assert got.dtypes[0] == ("doc_id", "string") and got.dtypes[2] == ("component_id", "string")
    assert {r["doc_id"]: r["component_id"] for r in got.collect()} == {f"d{i:03}": f"d{c:03}" for i, c in enumerate(low(len(TEXTS), linked))}


@pytest.mark.parametrize(("block", "pool"), [(5, 1 << 16), (7, 3), (512, 1 << 16)])
def test_lines(spark, monkeypatch, block, pool):
    monkeypatch.setattr(lines, "BLOCK", block)
    monkeypatch.setattr(linking, "POOL", pool)
    every = [" ".join(w) for w in TEXTS]
    sets = [{s[i : i + 8] for i in range(len(s) - 7)} for s in every]
    linked = [[100 * len(a & b) >= 80 * len(a | b) for b in sets] for a in sets]
    got = lines.line_groups(spark.createDataFrame([(i, s) for i, s in enumerate(every)], "doc_id int, text string"))
    assert {r["doc_id"]: r["keeper_id"] for r in got.collect()} == dict(enumerate(low(len(every), linked)))


def test_chunks_of_items(spark, monkeypatch):
    monkeypatch.setattr(decontaminate, "CHUNK", 200)
    items = [" ".join(prose(20)) for _ in range(12)]
    docs = [" ".join(prose(30)) + " " + items[i % 12].upper() + " " + " ".join(prose(30)) if i % 3 else " ".join(prose(60)) for i in range(40)]
    bench = spark.createDataFrame(list(enumerate(items)), "item_id int, text string")
    found = decontaminate.find_leaks(spark.createDataFrame([(str(i), t, "a") for i, t in enumerate(docs)], "doc_id string, text string, item string"), bench)
    want = {(str(i), k) for i, t in enumerate(docs) for k, x in enumerate(items) if re.sub(r"\W+", " ", x) in t.lower()}
    assert found.dtypes[:2] == [("doc_id", "string"), ("item_id", "int")] and {(r["doc_id"], r["item_id"]) for r in found.collect()} == want
    d = spark.createDataFrame([(i, t, 0) for i, t in enumerate(docs)], "doc_id int, text string, item_id int")
    left = decontaminate.without_leaks(d, bench)
    assert left.columns == d.columns and {str(r["doc_id"]) for r in left.collect()} == {str(i) for i in range(40)} - {i for i, _ in want}
