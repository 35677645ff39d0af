"""op5_lm: what rows on disk carry beside the pairs' hashes and the sums, and that slices are kept apart."""

import pytest

from lekhani.llm import lm


def test_rows_carry_little_beside_hashes_and_sums(spark, monkeypatch):
    """Texts whose words are nearly all in parts of their own: 8 bytes of hash and 16 of sums a word, and few more."""
    texts, each = 1000, 60
    docs = spark.range(texts).selectExpr("id AS doc_id", f"array_join(transform(sequence(1, {each}), i -> concat('w', id * {each} + i)), ' ') AS text").repartition(2)
    monkeypatch.setattr(lm, "HOT", 100)
    monkeypatch.setattr(lm, "PART_TOKENS", 200)
    sent, dealt = [], lm._dealt

    def spy(rows):
        sizes = rows.selectExpr("kind", "length(a) + length(b) + length(c) + length(d) AS n").groupBy("kind").sum("n").collect()
        sent.append(dict(map(tuple, sizes)))
        return dealt(rows)

    monkeypatch.setattr(lm, "_dealt", spy)
    assert lm.exact_scores(docs, docs.where("doc_id < 500")).selectExpr("sum(n_tokens)").first()[0] == texts * each
    entries = sum(x[lm.ENTRIES] for x in sent if lm.ENTRIES in x)
    sums = sum(x[lm.SUMS] for x in sent if set(x) == {lm.SUMS})
    assert texts * each * 8 <= entries < texts * each * 12, entries
    assert 0 < sums < texts * each * 20, sums


def test_slices_that_begin_alike(spark, monkeypatch):
    """Sums of slices whose first texts are equal do not mix, whichever texts share a slice."""
    rows = [(i, "the same text first" if i % 2 == 0 else " ".join(f"w{(i * k) % 97}" for k in range(1, 30 + i))) for i in range(80)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartitionByRange(2, "doc_id")

    def scores():
        return sorted(map(tuple, lm.exact_scores(docs, docs.where("doc_id < 30")).collect()))

    whole = scores()
    monkeypatch.setattr(lm, "SLICE", 150)
    monkeypatch.setattr(lm, "HOT", 50)
    cut = scores()
    assert [x[:2] for x in cut] == [x[:2] for x in whole]
    assert all(x[2:] == pytest.approx(y[2:], abs=1e-9) for x, y in zip(cut, whole, strict=True))
