"""op5_lm: what a Python worker and a row hold is bounded, whatever a table's size."""

import pyarrow as pa

from lekhani.llm import lm


def test_rows_and_batches_are_small(spark, monkeypatch):
    """1.6 million words, all different, in one shuffle partition: no part's counts take more than 32 MB, no batch many times BATCH."""
    n, each = 1_600_000, 4000
    docs = spark.range(n // each).selectExpr("id AS doc_id", f"array_join(transform(sequence(1, {each}), i -> concat('w', id * {each} + i)), ' ') AS text").repartition(1)
    seen, counted = [], lm._pair_counts

    def batches(it):
        for b in it:
            yield pa.record_batch([pa.array([b.nbytes])], ["n"])

    def spy(texts, totals, mine):
        sent = texts.mapInArrow(batches, "n long").agg({"n": "max"}).first()[0]
        out = counted(texts, totals, mine)
        seen.append((sent, out.selectExpr("max(length(a) + length(b) + length(c) + length(d))").first()[0]))
        return out

    monkeypatch.setattr(lm, "_pair_counts", spy)
    before = spark.conf.get("spark.sql.shuffle.partitions"), spark.conf.get(lm.BATCH_BYTES)
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    try:
        got = lm.exact_scores(docs, docs.limit(0))
        assert got.selectExpr("sum(n_tokens)").first()[0] == n
        assert spark.conf.get(lm.BATCH_BYTES) == before[1]
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before[0])
    assert seen and all(sent < 10 << 20 and row < 32 << 20 for sent, row in seen), seen
