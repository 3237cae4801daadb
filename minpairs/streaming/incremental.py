"""Incremental masking of treebank files as they arrive.

The reference has no streaming operators; this is the batch plan (scan,
match, mask) run by Structured Streaming over a folder that receives new
CoNLL-U files.  Every step is per sentence, so each micro-batch is
complete on its own and needs no state.  ``foreachBatch`` writes each
micro-batch into its own ``batch_id=<n>`` folder with overwrite, so a
retried batch replaces its output instead of duplicating it (the file
source's checkpoint records which files each batch consumed).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.mask import build_masked
from ..operators.pattern import Pattern
from ..sources.conllu import parse_blocks, sentence_blocks
from ..sources.treebank import with_alignment_columns


def masked_stream(spark: SparkSession, input_dir: str, pattern: Pattern, target: str, output_path: str,
                  checkpoint_location: str, mask_token: str = "[MASK]", keep: str = "last",
                  legacy: bool = False, available_now: bool = False,
                  max_files_per_trigger: int | None = None) -> StreamingQuery:
    reader = spark.readStream.option("lineSep", "\n")
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    raw = reader.text(input_dir).select("value", F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block_start"))

    def process(batch: DataFrame, batch_id: int) -> None:
        blocks = sentence_blocks(batch).select(
            "value", F.struct(F.lit(batch_id).alias("batch_id"), "path", "block_start", "row_id").alias("sent_ord"))
        sentences = with_alignment_columns(parse_blocks(blocks)).persist()
        try:
            r = build_masked(sentences, pattern, target, mask_token=mask_token, keep=keep, legacy=legacy)
            frame = r.frame.persist()
            r = r._replace(frame=frame)
            r.masked.write.mode("overwrite").parquet(f"{output_path}/masked/batch_id={batch_id}")
            r.exceptions.write.mode("overwrite").parquet(f"{output_path}/exceptions/batch_id={batch_id}")
            frame.unpersist()
        finally:
            sentences.unpersist()

    w = raw.writeStream.foreachBatch(process).option("checkpointLocation", checkpoint_location)
    w = w.trigger(availableNow=True) if available_now else w
    return w.start()
