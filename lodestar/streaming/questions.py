"""A stream of questions: each micro-batch is answered by the batch plan."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from lodestar.config import Settings
from lodestar.plans.answer import answer, prompt_json
from lodestar.sources.shared import owned
from lodestar.sources.store import Store


def answer_stream(store: Store, questions: DataFrame, out: str, checkpoint: str, config: Settings | None = None, available_now: bool = False) -> StreamingQuery:
    """Append (batch_id, query_id, prompt) rows to the Parquet folder ``out`` for every question of the stream.

    A batch writes its own folder ``batch_id=N`` and overwrites it when it is
    replayed after a failure, so each question is answered once.
    """

    def one(batch: DataFrame, batch_id: int) -> None:
        if batch.isEmpty():
            return
        with owned(batch.sparkSession):
            prompt_json(answer(store, batch, config).prompts).write.mode("overwrite").parquet(f"{out}/batch_id={batch_id}")

    writer = questions.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()
