"""Every operator on texts: nulls, empty and very long texts, repeated rows, ties, empty tables, ids of other types, clashing columns."""

import hashlib

import numpy as np
import pytest

from lekhani.llm import bpe, decontaminate, language, licenses, lines, lm, minhash, quality
from lekhani.llm.common import table

SF = "/root/testdata/sf0.001"
LONG = "Some plain words about rivers and hills, told one after another without any end in sight.\n" * 3000
TEXTS = [None, "", " \n\t ", "one", "Some plain words about rivers.", "Some plain words about rivers.", "!!! ### @@@", LONG]
#: Names that operators use inside or return.
CLASHES = {"id": "int", "key": "string", "n": "double", "score": "string", "norm": "int", "bucket": "int", "component": "string", "set": "int", "kept": "string", "item": "int", "x": "string", "t": "int", "b": "int", "part": "string", "_gone": "int", "_id": "int", "line": "int", "side": "int", "label": "string"}


@pytest.fixture(scope="module")
def learned(spark):
    docs = table(spark, SF, "documents")
    labels = table(spark, SF, "labels")
    return {"language": language.train(docs), "labels": labels, "docs": docs, "items": spark.createDataFrame([(1, "plain words about rivers")], "item_id int, text string")}


def quality_of(docs, known):
    both = known["docs"].select("doc_id", "text").unionByName(docs.selectExpr("-1 - cast(doc_id as long) as doc_id", "text"))
    return quality.rate(both, known["labels"]).where("doc_id < 0 or doc_id is null").selectExpr("cast(-1 - doc_id as int) as doc_id", "score", "predicted")


OPERATORS = {
    "language": lambda d, k: language.identify(d, k["language"]),
    "decontaminate": lambda d, k: decontaminate.find_leaks(d, k["items"]),
    "minhash": lambda d, k: minhash.near_duplicates(d),
    "lm": lambda d, k: lm.exact_scores(d, d.where("doc_id = 4")),
    "lines": lambda d, k: lines.line_groups(d),
    "bpe": lambda d, k: bpe.token_digests(d, bpe.tokenizer_path()),
    "licenses": lambda d, k: licenses.scan_licenses(d),
    "quality": quality_of,
}


@pytest.mark.parametrize("name", OPERATORS)
def test_rows_of_all_kinds(spark, learned, name):
    run = OPERATORS[name]
    rows = [(i if i else None, t) for i, t in enumerate(TEXTS)]
    rows.append(rows[4])  # a row that is repeated whole
    plain = spark.createDataFrame(rows, "doc_id int, text string")
    crowded = plain.selectExpr("doc_id", "text", *(f"cast(1 as {kind}) as `{c}`" for c, kind in CLASHES.items()))
    got = run(plain, learned)
    assert got.schema["doc_id"].dataType.simpleString() == "int"
    assert sorted(map(repr, got.collect())) == sorted(map(repr, run(crowded, learned).collect()))
    if name not in ("decontaminate", "lines"):
        by = {}
        for r in got.collect():
            by.setdefault(r["doc_id"], []).append(r)
        assert sorted(len(v) for v in by.values()) == [1] * (len(TEXTS) - 1) + [2] and by[4][0] == by[4][1]
        if name != "minhash":  # equal texts get equal rows
            assert by[4][0][1:] == by[5][0][1:]
    empty = run(plain.limit(0), learned)
    assert empty.columns == got.columns and empty.count() == 0


def test_lines_pass_all_columns_through(spark):
    docs = spark.createDataFrame([(1, "A line of some length\nb"), (2, "a  line of some length")], "doc_id int, text string").selectExpr("doc_id", "text", *(f"cast(1 as {kind}) as `{c}`" for c, kind in CLASHES.items()))
    out = lines.drop_repeated_lines(docs)
    assert out.dtypes == docs.dtypes and {r["doc_id"]: r["text"] for r in out.collect()} == {1: "A line of some length\nb", 2: ""}


def test_digests_by_the_library(spark):
    import tokenizers

    theirs = tokenizers.Tokenizer.from_file(bpe.tokenizer_path())
    theirs.no_truncation()
    theirs.no_padding()
    texts = [*TEXTS, "Ünïcödé — “quotes” 12345 <|endoftext|> it's"]
    got = {r["doc_id"]: r for r in bpe.token_digests(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), bpe.tokenizer_path()).collect()}
    for i, t in enumerate(texts):
        ids = theirs.encode(t or "", add_special_tokens=False).ids
        want = (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(theirs.decode(ids, skip_special_tokens=False).encode()).hexdigest())
        assert tuple(got[i][1:4]) == want


def test_quality_held_out(spark):
    out = quality.op6_quality(spark, "/root/testdata/sf0.01").where("held_out").join(table(spark, "/root/testdata/sf0.01", "labels"), "doc_id").select("quality", "predicted", "score").collect()
    assert len(out) > 50 and np.mean([r["quality"] == r["predicted"] for r in out]) > 0.95
    good, bad = ([r["score"] for r in out if r["quality"] == k] for k in (1, 0))
    assert np.mean([g > b for g in good for b in bad]) > 0.98


def test_quality_by_plain_bradley_terry():
    """Pairs' logistic loss: the fitted weights leave no gradient, and the cut is the quantile of the rows' scores."""
    rng = np.random.default_rng(5)
    good, bad = (np.abs(rng.standard_normal((n, len(quality.FEATURES)))) + shift for n, shift in ((300, 0.0), (100, 0.7)))
    model = quality.fit(good, bad, steps=3000)
    z = np.clip((quality.expand(np.concatenate([good, bad])) - model.mean) / model.scale, -8, 8)
    draws = np.random.default_rng(11)
    n = min(quality.PAIRS, 20 * 400)
    d = z[draws.integers(0, 300, n)] - z[300 + draws.integers(0, 100, n)]
    gradient = -(d / (1 + np.exp(d @ model.weights))[:, None]).mean(0) + 1e-3 * model.weights
    assert np.abs(gradient).max() < 1e-4
    s = model.latent(np.concatenate([good, bad]))
    assert (s < model.cut).sum() == 100 and (model.score(np.concatenate([good, bad])) >= quality.THRESHOLD).sum() == 300
