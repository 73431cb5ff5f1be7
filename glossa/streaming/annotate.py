"""Annotation of a growing folder: files are found once, by the stream's checkpoint.

Each batch of the stream writes one partition of the table of finished documents, and
then a marker.  A batch that is repeated after a failure finds its marker and does nothing,
or writes its partition again from the replies that it had got.  So a batch costs what its
files cost, however long the stream has been running.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from glossa.plans.annotate import Predict, Settings, filed_as, finished, pending, write_batch
from glossa.plans.ledger import Ledger
from glossa.sources import files
from glossa.sources.readers import stem


def watch(spark: SparkSession, folder: str, done_path: str, checkpoint: str, predict: Predict, model: str, prompt: str, settings: Settings, files_a_batch: int = 1000, ledger_path: str | None = None, **how) -> StreamingQuery:
    """Annotates each new .txt file of the folder and appends the result to the table at done_path.

    Documents that the table holds from elsewhere when the stream first starts are left
    out.  A checkpoint that was lost cannot be told from a new one by its path alone, so
    one whose batches the table has is an error.
    """
    stream = spark.readStream.format("text").option("wholetext", True).option("pathGlobFilter", "*.txt").option("maxFilesPerTrigger", files_a_batch).load(folder)
    docs = stream.select(stem(F.col("_metadata.file_path")).alias("doc_id"), F.col("value").alias("text"))
    filed, own = filed_as(prompt, settings), hashlib.sha256(f"{files.qualified(spark, checkpoint)}\0{model}\0{prompt}".encode()).hexdigest()[:16]
    marks = f"{done_path.rstrip('/')}/_batches/{own}"
    if not files.exists(spark, f"{checkpoint}/offsets"):
        if files.exists(spark, marks):
            raise ValueError(f"{done_path} holds batches of {checkpoint}, which is not there any more: take another checkpoint or another table")
        if files.exists(spark, done_path):
            files.mark(spark, f"{marks}/others")

    def each(batch: DataFrame, epoch: int) -> None:
        if files.exists(spark, f"{marks}/{epoch}"):
            return
        if files.exists(spark, f"{marks}/others"):  # fixed when the stream began
            batch = pending(batch, finished(batch, done_path, ["doc_id"], model, filed).where(~F.startswith("run", F.lit(own))), ["doc_id"])
        ledger = Ledger(ledger_path or done_path.rstrip("/") + "_replies", model, filed, f"{own}-{epoch}", whole=False)
        write_batch(batch, done_path, predict, ledger, prompt, ["doc_id"], settings, **how)
        files.mark(spark, f"{marks}/{epoch}")

    return docs.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
