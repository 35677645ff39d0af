"""op5_lm against counts of plain words and pairs, on more pairs than small hashed slots can keep apart."""

import math
import random
from collections import Counter

import pytest

from lekhani.llm import lm


@pytest.mark.parametrize(("hot", "slice_bytes", "part_tokens"), [(lm.HOT, lm.SLICE, lm.PART_TOKENS), (300, 5000, 1000), (1, 1, 1 << 30)])
def test_counts_are_exact(spark, tmp_path, monkeypatch, hot, slice_bytes, part_tokens):
    """Also with few hot words and pairs, in many slices and parts."""
    for name, value in (("HOT", hot), ("SLICE", slice_bytes), ("PART_TOKENS", part_tokens)):
        monkeypatch.setattr(lm, name, value)
    rng = random.Random(8)
    words = [f"w{i}" for i in range(3000)]
    rows = [(i, " ".join(rng.choice(words) for _ in range(100))) for i in range(300)]
    rows += [(i, " ".join(rng.choice(words[:3]) if rng.random() < 0.4 else rng.choice(words) for _ in range(400))) for i in range(304, 340)]
    rows += [(300, rows[0][1]), (301, None), (302, ""), (303, "one"), (303, "One two"), (None, "w1 w2")]
    good = range(0, 100)
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, int(i in good), 0) for i in range(300)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")

    def split(t):
        w = (t or "").lower().split()
        return list(zip([None, *w], w))

    def model(texts):
        pairs = Counter(p for t in texts for p in split(t))
        own, before = Counter(), Counter()
        for (a, b), n in pairs.items():
            own[b] += n
            before[a] += n
        return pairs, own, before

    t, b = model([x for i, x in rows if i in good]), model([x for _, x in rows])
    size, totals = len(b[1]), [sum(m[1].values()) for m in (t, b)]

    def mean(text, k, scale):
        pairs, own, before = (t, b)[k]
        out = [-math.log((pairs[p] * scale + lm.PRIOR * (own[p[1]] * scale + lm.ADDED) / (totals[k] * scale + lm.ADDED * size)) / (before[p[0]] * scale + lm.PRIOR)) for p in split(text)]
        return sum(out) / max(len(out), 1)

    want = sorted((i is None, i or 0, len(split(x)), mean(x, 0, 1.0), mean(x, 1, totals[0] / totals[1])) for i, x in rows)
    got = sorted((r["doc_id"] is None, r["doc_id"] or 0, r["n_tokens"], r["target_loss"], r["background_loss"]) for r in lm.op5_lm(spark, str(tmp_path)).collect())
    assert [x[:3] for x in got] == [x[:3] for x in want]
    assert all(math.isclose(g, w, abs_tol=1e-9) for x, y in zip(got, want, strict=True) for g, w in zip(x[3:], y[3:], strict=True))
