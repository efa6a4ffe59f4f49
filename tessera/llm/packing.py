"""Best-two-fit packing of tokenised documents into sequences of a fixed length.

Pieces of equal length are interchangeable, so the packer works on the table of lengths (at most max_tokens
rows, whatever the corpus) and writes down each bin once with the number of times it repeats. Spark then gives
every piece its place from its rank among the pieces of its length.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import public_tokenizers
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import materialize, ranked

MAX_TOKENS = 2048
END_ID = 0
TOKENIZER = "byte_bpe_50k.json"
#: As the vocabulary's own pattern; possessive, so that nothing is tried twice.
SPLIT = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"


@lru_cache(maxsize=4)
def _fast(path: str):
    """The vocabulary as byte ranks for tiktoken, which gives the ids of tokenizers several times faster; its special tokens."""
    import json

    import tiktoken

    with open(path, encoding="utf-8") as file:
        read = json.load(file)
    special = {t["content"] for t in read["added_tokens"]}
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in set(printable)]
    byte = {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(others)}
    ranks = {bytes(byte[c] for c in token): i for token, i in read["model"]["vocab"].items() if token not in special}
    return tiktoken.Encoding("ranks", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={}).encode_ordinary, special


@lru_cache(maxsize=4)
def _slow(path: str):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def encode(text: str, path: str) -> list[int]:
    """The ids of a whole text as tokenizers gives them without special tokens added."""
    fast, special = _fast(path)
    if any(s in text for s in special):
        return _slow(path).encode(text, add_special_tokens=False).ids
    return fast(text)


def pieces(docs: DataFrame, max_tokens: int = MAX_TOKENS, tokenizer: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, piece, start, length, ids_crc32): each document's ids and END_ID, cut to max_tokens with the first piece short."""
    path = tokenizer or public_tokenizers.path(TOKENIZER)
    names = ["id", "piece", "start", "length", "ids_crc32"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[], [], [], [], []]
            for doc, text in zip(batch.column(0), batch.column(1)):
                doc = doc.as_py()
                ids = encode(text.as_py() or "", path)
                ids.append(END_ID)
                raw = np.array(ids, dtype="<u4").tobytes()
                end = len(ids) % max_tokens or max_tokens
                start = piece = 0
                while start < len(ids):
                    for column, value in zip(out, (doc, piece, start, end - start, zlib.crc32(raw[4 * start : 4 * end]))):
                        column.append(value)
                    start, end, piece = end, end + max_tokens, piece + 1
            types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, types)], names=names)

    return docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string")).mapInArrow(run, "id long, piece int, start long, length long, ids_crc32 long")


def two_fit(counts: dict[int, int], capacity: int) -> list[tuple[dict[int, int], int]]:
    """Bins as ({length: how many}, repeats) for counts {length: how many}.

    A bin is filled greedily with the longest piece that fits. If room is left, its smallest piece gives way to
    the two unpacked pieces that fill the room with it more tightly, if there are such. A bin repeats as long as
    all its lengths last: until then each choice would come out the same.
    """
    left = np.zeros(capacity + 1, np.int64)
    for length, n in counts.items():
        left[length] = n
    bins = []
    while (there := np.flatnonzero(left)).size:
        room, used, free = capacity, {}, left.copy()
        while room and (i := np.searchsorted(there, room, "right") - 1) >= 0:
            while i >= 0 and not free[there[i]]:
                i -= 1
            if i < 0:
                break
            length = int(there[i])
            n = int(min(free[length], room // length))
            used[length] = used.get(length, 0) + n
            free[length] -= n
            room -= n * length
        least = min(used)
        if room and (have := np.flatnonzero(free)).size:
            wide = room + least
            have = have[have <= wide]
            at = np.searchsorted(have, wide - have, "right") - 1
            same = (at >= 0) & (have[at] == have) & (free[have] < 2)
            at = np.where(same, at - 1, at)
            total = np.where(at >= 0, have + have[at], 0)
            if total.size and total.max() > least:
                best = int(np.flatnonzero(total == total.max())[-1])
                used[least] -= 1
                for length in (int(have[best]), int(have[at[best]])):
                    used[length] = used.get(length, 0) + 1
                used = {k: v for k, v in used.items() if v}
        repeats = int(min(left[k] // v for k, v in used.items()))
        for k, v in used.items():
            left[k] -= v * repeats
        bins.append((used, repeats))
    return bins


def pack(cut: DataFrame, max_tokens: int = MAX_TOKENS) -> DataFrame:
    """Adds sequence_id and offset to pieces (id, piece, start, length, ids_crc32); a column row that tells them apart is used and dropped.

    The lengths' counts, at most max_tokens rows, are all that the driver sees; the plan that goes back to the
    tasks has a row for each length of each different bin, a number that the lengths bound and the corpus does not.
    """
    counts = {r["length"]: r["n"] for r in cut.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    rows, taken, base = [], dict.fromkeys(counts, 0), 0
    for used, repeats in two_fit(counts, max_tokens):
        offset = 0
        for length, n in sorted(used.items(), reverse=True):
            rows.append((length, taken[length], n, base, offset))
            taken[length] += n * repeats
            offset += n * length
        base += repeats
    plan = np.array(sorted(rows), dtype=np.int64).reshape(-1, 5)
    starts = (plan[:, 0] << 44) + plan[:, 1]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = (batch.column(batch.schema.get_field_index(c)).to_numpy() for c in ("length", "rank"))
            row = plan[np.searchsorted(starts, (length << 44) + rank, "right") - 1]
            turn, slot = np.divmod(rank - row[:, 1], row[:, 2])
            keep = [batch.column(i) for i in range(5)]
            yield pa.RecordBatch.from_arrays(
                [*keep, pa.array(row[:, 3] + turn), pa.array(row[:, 4] + slot * length)],
                names=["id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"],
            )

    order = ranked(cut, ["length"], ["id", "piece", "start", "ids_crc32"], "rank", salts=128, tie="row" if "row" in cut.columns else None).drop("row")
    return order.mapInArrow(place, "id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")


def op10(docs: DataFrame) -> DataFrame:
    """One row per piece, with its sequence and its offset there.

    Null and empty texts are the one id END_ID. Rows with equal or null ids are separate documents. An empty table
    gives an empty result. Texts of any length are tokenised whole. Other columns, whatever their names, are not read.
    """
    cut = materialize(pieces(docs).withColumn("row", F.monotonically_increasing_id()), "pieces")
    return pack(cut).withColumnRenamed("id", "doc_id")
