"""Questions to a model about many rows: numbered prompts, replies that are kept, and updates that overwrite nothing.

A reply is kept under a hash of its prompt as soon as it is there. A task that is lost, or a job that runs again,
finds what was answered before and asks only for the rest.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions import replies
from tessera.operators.providers import Chat
from tessera.sources.archives import opened


class Replies:
    """Kept replies in a folder, one file each, under a hash of model and prompt."""

    def __init__(self, path: str, model: str):
        self.store, self.base = opened(path)
        self.model = model

    def _file(self, prompt: str) -> str:
        name = hashlib.sha256(f"{self.model}\n{prompt}".encode()).hexdigest()
        return f"{self.base}/{name[:2]}/{name}.json"

    def get(self, prompt: str) -> str | None:
        file = self._file(prompt)
        if self.store.get_file_info(file).type != fs.FileType.File:
            return None
        with self.store.open_input_stream(file) as f:
            return json.loads(f.read())["reply"]

    def put(self, prompt: str, reply: str) -> None:
        file = self._file(prompt)
        part = f"{file}.{uuid.uuid4().hex}"
        self.store.create_dir(file.rsplit("/", 1)[0], recursive=True)
        with self.store.open_output_stream(part) as f:
            f.write(json.dumps({"model": self.model, "prompt": prompt, "reply": reply}).encode())
        self.store.move(part, file)  # a reply is there whole or not at all


def answered(prompts: DataFrame, prompt: str, chat: Chat, path: str, model: str) -> DataFrame:
    """(prompt, reply): every different prompt once, from the kept replies or else asked. Null prompts are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = Replies(path, model)
        for batch in batches:
            for text in batch.column(0).to_pylist():
                reply = kept.get(text)
                if reply is None:
                    reply = chat(text)
                    kept.put(text, reply)
                yield pa.RecordBatch.from_arrays([pa.array([text]), pa.array([reply], pa.string())], names=[prompt, "reply"])

    asked = prompts.select(prompt).where(F.col(prompt).isNotNull()).distinct()
    return asked.repartition(F.xxhash64(prompt)).mapInArrow(run, f"`{prompt}` string, reply string")


def batched(items: DataFrame, key: str, size: int, spread: int = 32) -> DataFrame:
    """items with `_of` and `_number`: batches of `size`, numbered from 1 within, the same whenever the same items are given.

    Items are dealt by a hash of the key into groups of about `spread` batches and numbered there in the key's order.
    """
    from pyspark.sql import Window

    groups = max(1, -(-items.count() // (size * spread)))
    w = Window.partitionBy("_group").orderBy(key)
    numbered = items.withColumn("_group", F.pmod(F.xxhash64(key), F.lit(groups))).withColumn("_at", F.row_number().over(w) - 1)
    of = F.concat_ws("-", F.col("_group").cast("string"), F.floor(F.col("_at") / size).cast("string"))
    return numbered.withColumn("_of", of).withColumn("_number", F.col("_at") % size + 1).drop("_group", "_at")


def enriched(items: DataFrame, key: str, line: Column, value: str, source: str, chat: Chat, path: str, model: str, intro: str, size: int = 10) -> DataFrame:
    """items with value and source set where source is null: 'ai' and what the model says of the row's line.

    Rows with a source keep what they have. A row that a reply leaves out, or whose reply is no JSON, stays as it is and is
    asked about again the next time. Keys tell rows apart.
    """
    due = batched(items.where(F.col(source).isNull()).select(F.col(key), line.alias("_line")), key, size)
    told = F.concat_ws("\n", F.lit(intro), F.transform(F.array_sort(F.collect_list(F.struct("_number", "_line"))), lambda x: F.concat(x["_number"].cast("string"), F.lit(". "), F.coalesce(x["_line"], F.lit("")))))
    prompts = due.groupBy("_of").agg(told.alias("_prompt"))  # a batch is `size` rows
    told = prompts.join(answered(prompts, "_prompt", chat, path, model), "_prompt")
    answers = told.select("_of", F.posexplode(replies.numbered("reply", size)).alias("_i", "_answer")).select("_of", (F.col("_i") + 1).alias("_number"), "_answer").where("_answer is not null")
    found = due.join(answers, ["_of", "_number"]).select(F.col(key).alias("_key"), "_answer")
    joined = items.join(found, F.col(key) == F.col("_key"), "left")
    sure = F.col(source).isNull() & F.col("_answer").isNotNull()  # a source that came meanwhile stands
    out = joined.withColumn(value, F.when(sure, F.col("_answer")).otherwise(F.col(value))).withColumn(source, F.when(sure, "ai").otherwise(F.col(source)))
    return out.select(items.columns)
