"""Writing a document: a plan, its parts one after another, and their assembly."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions import text as tx
from tessera.operators import citations
from tessera.operators.providers import Chat

TAIL = 1500


def write(parts: DataFrame, chat: Chat) -> DataFrame:
    """(document, markdown, sources): each document's parts (document, part, prompt, ids) written in order and assembled.

    A part sees the end of what came before, so a document is one task's work; documents run beside each other.
    A document has at most thirty parts.
    """

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        done: list[str] = []
        for row in frame.sort_values("part").itertuples():
            before = done[-1][-TAIL:] if done else ""
            done.append(citations.to_places(chat(f"{before}\n\n{row.prompt}" if before else row.prompt), list(row.ids)))
        text, order = citations.assemble(done, {i for ids in frame["ids"] for i in ids})
        return pd.DataFrame([{"document": frame["document"].iloc[0], "markdown": text, "sources": order}])

    kind = dict(parts.dtypes)["document"]
    return parts.groupBy("document").applyInPandas(run, f"document {kind}, markdown string, sources array<string>")


def assemble(parts: DataFrame) -> DataFrame:
    """(document, markdown, sources) of parts (document, part, text, ids) with place marks; ids are the sources a part was given.

    Marked ids that no part of the document was given are left out. Without a column ids all of them count.
    """
    given = "ids" in parts.columns

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            found = [citations.assemble(list(t), set(i) if given else None) for t, i in zip(frame["texts"], frame["ids"])]
            yield pd.DataFrame({"document": frame["document"], "markdown": [f[0] for f in found], "sources": [f[1] for f in found]})

    kind = dict(parts.dtypes)["document"]
    ids = F.flatten(F.collect_list("ids")) if given else F.array().cast("array<string>")
    listed = parts.groupBy("document").agg(F.array_sort(F.collect_list(F.struct("part", "text"))).alias("p"), ids.alias("ids"))
    listed = listed.select("document", F.transform("p", lambda x: x["text"]).alias("texts"), "ids")
    return listed.mapInPandas(run, f"document {kind}, markdown string, sources array<string>")


def export(written: DataFrame, sources: DataFrame, origin: str) -> DataFrame:
    """(document, text): written documents (document, title, markdown) as files, with a numbered list of linked sources.

    sources has (document, n, title, item, seq, kind, start, day); one document's list is one row.
    """
    shown = F.replace("title", F.lit("]"), F.lit("\\]"))
    link = F.concat(F.col("n").cast("string"), F.lit(". ["), shown, F.lit(f"]({origin}/episodes/"), F.col("item").cast("string"), F.lit("#t-"), F.col("seq").cast("string"), F.lit("), "))
    where = F.when(F.col("kind") == "summary", "summary").when(F.col("start").isNotNull(), F.concat(F.lit("at "), tx.format_time("start")))
    lines = sources.select("document", "n", F.concat(link, F.concat_ws(", ", "day", where)).alias("line"))
    listed = lines.groupBy("document").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", "line"))), lambda x: x["line"]), "\n").alias("list"))
    text = F.concat(F.lit("# "), "title", F.lit("\n\n"), "markdown", F.lit("\n\n## Sources\n\n"), F.coalesce("list", F.lit("")), F.lit("\n"))
    return written.join(listed, "document", "left").select("document", text.alias("text"))


def export_transcripts(items: DataFrame, chunks: DataFrame, origin: str, place: str = "", markdown: bool = True) -> DataFrame:
    """(item, text): transcripts as files, in Markdown or plain.

    items has (item, title, day, speaker, summary, main_reference, topics, references), chunks (item, seq, text,
    start); one item's chunks are one row.
    """
    stamp = F.when(F.col("start").isNotNull(), F.concat(F.lit("**" if markdown else "["), tx.format_time("start"), F.lit("** " if markdown else "] "))).otherwise("")
    said = chunks.select("item", "seq", F.concat(stamp, tx.full_trim("text"), F.lit("" if markdown else "\n")).alias("line"))
    between = "\n\n" if markdown else "\n"
    listed = said.groupBy("item").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", "line"))), lambda x: x["line"]), between).alias("body"))
    filled = lambda c: F.when(c != "", c)
    about = F.concat_ws(" · ", filled(F.col("day")), filled(F.col("speaker")), filled(F.lit(place)))
    link = F.concat(F.lit(f"From {origin}/episodes/"), F.col("item").cast("string"))
    named = lambda name, c: F.when(c != "", F.concat(F.lit(f"**{name}:** "), c))
    if markdown:
        parts = [
            F.concat(F.lit("# "), "title"), filled(about), F.concat(F.lit("## Summary\n\n"), tx.full_trim("summary")), named("Main text", F.col("main_reference")), named("Topics", F.array_join("topics", ", ")),
            named("Scripture", F.array_join("references", ", ")), F.lit("## Transcript"), filled(F.col("body")), F.concat(F.lit("---\n\n"), link),
        ]
    else:
        parts = [F.col("title"), about, F.lit(""), F.col("body"), link]
    return items.join(listed, "item", "left").select("item", F.concat(F.concat_ws(between, *parts), F.lit("\n")).alias("text"))
