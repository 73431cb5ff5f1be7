"""Replies that were paid for: each different chunk is asked once, whatever fails later.

A ledger is a folder.  Tasks write what a model replied as soon as it has replied, a file
a batch of prompts, before anything reads it.  A chunk is told by the digest of its whole
prompt, so copies are asked once.  Chunks are dealt by the first digits of their digests,
and a task's files lie in folders named by these digits: a task that starts again, on
whatever machine, finds what its forerunner wrote and asks for the rest alone.

Layout: path / run (model and prompt) / job (one call, or one batch of a stream) / digits.
The folder must be one that both Spark and pyarrow.fs reach: a shared or mounted one, or
HDFS, S3, GCS.  Files appear under their names when they are complete.

Two attempts of one task that run at the same time (speculation) may both ask.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pandas as pd
import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from glossa.sources import files

#: Hexadecimal digits of a digest by which chunks are dealt: 256 tasks at most ask at the same time.
DIGITS = 2
#: Prompts that a task hands to the model, and whose replies it writes, together.
BATCH = 32

REPLIES = "digest string, tagged_text string, entities map<string,array<string>>, answered boolean"

Answer = Callable[[list[str]], list[tuple[str, dict, bool]]]


def prompt_digest(template: str, slot: str, chunk: Column) -> Column:
    """The digest of the prompt that a chunk makes; null of a null chunk."""
    return F.sha2(F.replace(F.lit(template), F.lit(slot), chunk), 256)


@dataclass
class Ledger:
    """Where replies of one model to one prompt lie.

    whole: earlier jobs' replies count too; without it only those of this job do, so that
    the cost of a stream's batch does not grow with what came before.
    """

    path: str
    model: str
    prompt: str
    job: str = field(default_factory=lambda: uuid.uuid4().hex)
    whole: bool = True

    @property
    def run(self) -> str:
        return f"{self.path}/{hashlib.sha256(json.dumps([self.model, self.prompt]).encode()).hexdigest()[:32]}"

    @property
    def folder(self) -> str:
        return f"{self.run}/{self.job}"

    def replies(self, spark: SparkSession) -> DataFrame:
        """digest, tagged_text, entities, answered: one row a digest."""
        at = self.run if self.whole else self.folder
        if not files.exists(spark, at):
            return spark.createDataFrame([], REPLIES)
        return spark.read.schema(REPLIES).option("recursiveFileLookup", True).parquet(at).dropDuplicates(["digest"])

    def fill(self, chunks: DataFrame, answer: Answer, digits: int = DIGITS, batch: int = BATCH) -> int:
        """Asks for what the ledger lacks of chunks (digest, chunk), and returns how many were asked for."""
        spark = chunks.sparkSession
        lacking = chunks.where("digest is not null").dropDuplicates(["digest"]).join(self.replies(spark).select("digest"), "digest", "left_anti")
        tasks = min(16**digits, max(2, 4 * spark.sparkContext.defaultParallelism))
        dealt = lacking.select("digest", "chunk", F.substring("digest", 1, digits).alias("part")).repartition(tasks, "part")
        root = files.qualified(spark, self.folder)
        asked = dealt.mapInPandas(lambda frames: _ask(frames, root, answer, batch), "asked long")
        return asked.agg(F.coalesce(F.sum("asked"), F.lit(0))).first()[0]


def _ask(frames: Iterator[pd.DataFrame], root: str, answer: Answer, batch: int) -> Iterator[pd.DataFrame]:
    """Within a task: asks for the chunks that no file of the job has, and writes the replies."""
    where, top = pafs.FileSystem.from_uri(root)
    known: dict[str, set[str]] = {}
    for frame in frames:
        for part, own in frame.groupby("part", sort=True):
            if part not in known:
                known[part] = _written(where, f"{top}/{part}")
            own = own[~own["digest"].isin(known[part])]
            for at in range(0, len(own), batch):
                rows = own.iloc[at : at + batch]
                _write(where, f"{top}/{part}", rows["digest"].tolist(), answer(rows["chunk"].tolist()))
                known[part].update(rows["digest"])
            yield pd.DataFrame({"asked": [len(own)]})


def _written(where: pafs.FileSystem, folder: str) -> set[str]:
    out: set[str] = set()
    for f in where.get_file_info(pafs.FileSelector(folder, allow_not_found=True)):
        if f.base_name.endswith(".parquet") and not f.base_name.startswith("_"):
            with where.open_input_file(f.path) as source:
                out.update(pq.read_table(source, columns=["digest"])["digest"].to_pylist())
    return out


def _write(where: pafs.FileSystem, folder: str, digests: list[str], replies: list[tuple[str, dict, bool]]) -> None:
    types = [("digest", pa.string()), ("tagged_text", pa.string()), ("entities", pa.map_(pa.string(), pa.list_(pa.string()))), ("answered", pa.bool_())]
    texts, entities, answered = zip(*replies, strict=True)
    table = pa.table([digests, list(texts), [list(e.items()) for e in entities], list(answered)], schema=pa.schema(types))
    name = uuid.uuid4().hex + ".parquet"
    where.create_dir(folder, recursive=True)
    # readers pass over names that begin with an underscore
    with where.open_output_stream(f"{folder}/_{name}") as out:
        pq.write_table(table, out)
    where.move(f"{folder}/_{name}", f"{folder}/{name}")
