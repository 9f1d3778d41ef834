"""Questions as a stream: each micro-batch is ranked against a static index."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from textloom.functions.text import tokens
from textloom.operators.index import Index
from textloom.operators.ranking import Calibration, decide, top_k


def answer_stream(index: Index, questions: DataFrame, out: str, checkpoint: str, calibration: Calibration = Calibration()) -> StreamingQuery:
    """questions: a stream of (q_id, question). Decisions are appended to ``out``, once for each batch.

    The work is stateless, so there is no watermark; a batch that runs again replaces its own folder.
    """

    def answer(batch: DataFrame, n: int) -> None:
        rows = batch.select("q_id", "question").withColumn("toks", tokens(batch["question"])).persist()
        decide(index, rows, top_k(index, rows), calibration).write.mode("overwrite").parquet(f"{out}/batch={n}")
        rows.unpersist()

    return questions.writeStream.foreachBatch(answer).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
