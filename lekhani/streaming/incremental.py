"""An extension: postings and lengths of documents that arrive as a stream, appended batch by batch."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from lekhani.operators import index as ix


def index_stream(documents: DataFrame, path: str, checkpoint: str, zones: list[str] = ix.ZONES) -> StreamingQuery:
    """documents: a stream of doc_id, text, each id once. Each batch's postings go to `path`/postings/batch=n, written over if it is run again."""

    def append(batch: DataFrame, n: int) -> None:
        docs = ix.corpus(batch)
        ix.postings(ix.zone_terms(docs, zones), True).write.mode("overwrite").parquet(f"{path}/postings/batch={n}")
        docs.write.mode("overwrite").parquet(f"{path}/docs/batch={n}")

    return documents.writeStream.foreachBatch(append).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
