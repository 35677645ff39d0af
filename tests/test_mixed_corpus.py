import hashlib

import __spark_entry__ as entry
from lekhani.functions import romanize as R


def test_whole_texts_are_romanised(spark, tmp_path):
    rows = [(i, f"नमस्ते दुनिया {i}\nplain पानी", "hi") for i in range(60)] + [(60, None, "hi"), (61, "", "en")]
    spark.createDataFrame(rows, "doc_id long, text string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["doc_id"]: (r["romanised"], r["text"]) for r in entry.queries()["mixed_corpus_texts"](spark, str(tmp_path)).collect()}
    want = {}
    for i, t, _ in rows:
        chosen = int(hashlib.md5(f"{i}mixed".encode()).hexdigest()[:8], 16) % 100 < 30
        want[i] = (chosen, R.romanize_text(t) if chosen and t is not None else t)
    assert got == want
    chosen = [t for c, t in got.values() if c and t]
    assert chosen and not any("\u0900" <= c <= "\u097f" for t in chosen for c in t)
