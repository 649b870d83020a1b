"""Masking of a stream of documents, batch by batch; each document is masked by itself, so no state is kept."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from lexmill.operators.masking import mask
from lexmill.operators.recognize import RULES, Rule


def mask_stream(docs: DataFrame, path: str, checkpoint: str, rules: tuple[Rule, ...] = RULES, *, id_col: str = "doc_id", text_col: str = "text") -> StreamingQuery:
    """Writes masked texts and mappings of each micro-batch to its own folder under ``path``; a batch that runs again overwrites its own."""

    def write(batch: DataFrame, number: int) -> None:
        out = mask(batch, rules, id_col=id_col, text_col=text_col)
        for name in ("masked", "mapping"):
            table = out[name].drop(text_col) if name == "masked" else out[name]
            table.write.mode("overwrite").parquet(f"{path}/{name}/batch={number}")

    return docs.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
