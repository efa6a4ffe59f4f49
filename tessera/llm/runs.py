"""Periodic runs: stretches of words that repeat with a period, found exactly and in every document whole.

A run of period q and length L is q words that come again for the L - q words after them. Cut a document into aligned
blocks of 2^k words: one lies wholly in any stretch of 2^(k+1) - 1 words, so a run with L - q of at least that has
an aligned block that comes again q words later. A block of B words therefore only has to be looked for at the
distances 2B - 1 to 4B - 2, its scale; short periods, whose runs have at least LEAST words, go with the smallest blocks.
An automaton finds all places of all blocks of a scale at once, and each pair of places is grown word by word to
both sides until the words differ. Pairs inside a known run at a multiple of its period would grow to that run
again and are passed over, so a text that is one word throughout costs no more than any other.

A word of a block that recurs at a distance d recurs within d; blocks with a word that does not recur within their
scale cannot seed a run and are no keys. In prose that leaves few.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LEAST = 12
#: Words compared at first when a pair is grown; doubles as long as they agree.
STEP = 16
#: Bytes of collapsed text in a batch that leaves a task, about.
BATCH = 1 << 22


def scales(n: int) -> list[tuple[int, int, int]]:
    """(block, least distance, largest distance) of each scale. Together they have every period from 1 to n // 2, n being LEAST or more.

    A run of period q repeats max(LEAST - q, q) words at least, which has to hold 2 * block - 1. So blocks of four take
    periods up to 14 but for six, which blocks of two take.
    """
    found = [(4, 1, min(14, n // 2)), (2, 6, 6)]
    block = 8
    while 2 * block - 1 <= n // 2:
        found.append((block, 2 * block - 1, min(4 * block - 2, n // 2)))
        block *= 2
    return found


def numbered(words: list[bytes]) -> np.ndarray:
    """Words as numbers, equal words alike."""
    ids = pa.array(words, pa.large_binary()).dictionary_encode().indices.to_numpy()
    return ids.astype(np.uint16) if len(ids) <= 1 << 16 else ids  # short keys sort faster


def recurs(ids: np.ndarray) -> np.ndarray:
    """How far from each word the next equal one is; the number of words where there is none."""
    order = np.argsort(ids, kind="stable")
    gap = np.full(len(ids), len(ids), np.int64)
    same = ids[order[1:]] == ids[order[:-1]]
    gap[order[:-1][same]] = (order[1:] - order[:-1])[same]
    return gap


def agree(a: np.ndarray, b: np.ndarray) -> int:
    """How many leading words of two stretches of equal length agree."""
    at, step = 0, STEP
    while at < len(a):
        wrong = np.flatnonzero(a[at : at + step] != b[at : at + step])
        if len(wrong):
            return at + int(wrong[0])
        at, step = at + step, 2 * step
    return len(a)


def grown(ids: np.ndarray, at: int, d: int) -> tuple[int, int]:
    """The longest stretch around word `at` in which words d apart are equal, given that this one and the next are."""
    start = at - agree(ids[:at][::-1], ids[d : at + d][::-1])
    return start, at + d + agree(ids[at : len(ids) - d], ids[at + d :])


def places(ids: np.ndarray, starts: np.ndarray, block: int, reach: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(aligned starts, all places) of each different block, looked for from each of its starts to reach beyond."""
    automaton = ahocorasick.Automaton(ahocorasick.STORE_ANY, ahocorasick.KEY_SEQUENCE)
    keys: dict[tuple, int] = {}
    aligned: list[list[int]] = []
    for at in starts.tolist():
        key = tuple(ids[at : at + block].tolist())
        k = keys.setdefault(key, len(keys))
        if k == len(aligned):
            automaton.add_word(key, k)
            aligned.append([])
        aligned[k].append(at)
    automaton.make_automaton()
    found: list[list[int]] = [[] for _ in aligned]
    ends = np.minimum(starts + reach + block, len(ids))
    cut = np.flatnonzero(starts[1:] > ends[:-1]) + 1  # stretches that overlap are read once
    for part in np.split(np.arange(len(starts)), cut):
        low = int(starts[part[0]])
        for end, k in automaton.iter(tuple(ids[low : int(ends[part[-1]])].tolist())):
            found[k].append(low + end - block + 1)
    for own, all_places in zip(aligned, found):
        yield np.array(own), np.array(all_places)


def runs(ids: np.ndarray) -> list[tuple[int, int, int]]:
    """(start, length, period) of all runs of a sequence, by start, then period.

    A run is a stretch with smallest period q and of max(LEAST, 2q) words or more that no word beside it continues.
    """
    n = len(ids)
    if n < LEAST:
        return []
    ids = np.ascontiguousarray(ids)
    gap = recurs(ids)
    period: dict[tuple[int, int], int] = {}  # by stretch
    known: list[tuple[int, int, int]] = []  # (start, end, period)
    farthest = {b: gap[: n // b * b].reshape(-1, b).max(1) for b in (2, 4)}
    for block, low, high in scales(n):
        if block not in farthest:
            half = farthest.pop(block // 2)
            farthest[block] = half[: len(half) // 2 * 2].reshape(-1, 2).max(1)
        starts = np.flatnonzero(farthest[block] <= high) * block
        if not len(starts):
            continue
        pairs = []
        for own, found in places(ids, starts, block, high):
            first, last = np.searchsorted(found, own + low).tolist(), np.searchsorted(found, own + high, "right").tolist()
            at_all, found = own.tolist(), found.tolist()
            pairs += [(at, found[i:j]) for at, i, j in zip(at_all, first, last) if i < j]
        pairs.sort(key=lambda p: p[0])
        done: dict[int, int] = {}  # by distance, where the last stretch that is known for it ends
        cover, fresh, live, k = sorted(known), [], [], 0
        for at, others in pairs:
            while k < len(cover) and cover[k][0] <= at:
                live.append(cover[k])
                k += 1
            if live:
                live = [r for r in live if r[1] > at + block]
            for other in others:
                d, least_end = other - at, other + block
                if done.get(d, -1) >= least_end:
                    continue
                inside = next((end for start, end, q in live if d % q == 0 and end >= least_end), None)
                if inside is not None:
                    done[d] = inside
                    continue
                start, end = grown(ids, at, d)
                done[d] = end
                if end - start >= max(LEAST, 2 * d):
                    known_period = period.get((start, end))
                    if known_period is None:
                        live.append((start, end, d))
                        fresh.append((start, end, d))
                    if known_period is None or known_period > d:
                        period[start, end] = d
        known += fresh
    return sorted((s, e - s, q) for (s, e), q in period.items())


def kept(n: int, found: list[tuple[int, int, int]]) -> np.ndarray:
    """Which words stay when each run is collapsed to its first period."""
    edge = np.zeros(n + 1, np.int64)
    for start, length, q in found:
        edge[start + q] += 1
        edge[start + length] -= 1
    return np.cumsum(edge[:-1]) == 0


Words = Callable[[int | None, bytes], list[bytes]]


def split_words(doc: int | None, text: bytes) -> list[bytes]:
    return text.split()  # bytes: at 0x20 and 0x09-0x0D only


def periodic_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: Words = split_words) -> DataFrame:
    """(doc_id, n_words, runs, collapsed): each text's runs, and its words without their repetitions, joined by a space.

    runs is an array of (start, length, period) in words, by start, then period; a word goes if any run has it
    after that run's first period. words gives the words of a row. A null text has none. Rows are read and
    written where they are, one text at a time and whole.
    """
    run_type = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))
    names = ["doc_id", "n_words", "runs", "collapsed"]

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        kinds = [pa.int64(), pa.int64(), run_type, pa.string()]
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, size = [], 0
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                own = words(doc, text.as_py()) if text.is_valid else []
                n, found = len(own), runs(numbered(own))
                if found:
                    own = [own[k] for k in np.flatnonzero(kept(n, found)).tolist()]
                collapsed = b" ".join(own)
                rows.append((doc, n, [{"start": s, "length": m, "period": q} for s, m, q in found], collapsed))
                size += len(collapsed) + 100
                if size >= BATCH:
                    yield batch_of(rows)
                    rows, size = [], 0
            if rows:
                yield batch_of(rows)

    text = F.col(text_col).cast("string").cast("binary")
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text")).mapInArrow(run, "doc_id long, n_words long, runs array<struct<start: long, length: long, period: long>>, collapsed string")


def planted(doc: int | None, text: bytes) -> list[bytes]:
    """The words of op11: in documents that their id picks, the rest of the text from some word on repeats with a period."""
    words = text.split()
    h = zlib.crc32(str(doc).encode()) if doc is not None else 1
    g, n = h // 10, len(words)
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words[a:] = (words[a : a + p] * ((n - a) // p + 1))[: n - a]
    return words


def op11(docs: DataFrame) -> DataFrame:
    """One row per row of docs: its runs after repetitions were planted, as digests, and the longest of them.

    A null or empty text has no words and no runs; its digests are those of the empty string. Nothing is planted in a
    row without an id. Of runs of equal length the first counts, then the one of smaller period. Rows that repeat are
    rows each; an empty table gives an empty result; texts of any length are read whole. Other columns, whatever their
    names, are not read.
    """
    found = periodic_runs(docs, words=planted)
    text = F.concat_ws("", F.transform("runs", lambda r: F.concat(r["start"].cast("string"), F.lit(","), r["length"].cast("string"), F.lit(","), r["period"].cast("string"), F.lit("\n"))))
    best = F.array_min(F.transform("runs", lambda r: F.struct((-r["length"]).alias("less"), r["start"].alias("start"), r["period"].alias("period"))))
    return found.withColumn("best", best).select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), F.col("best.start").alias("start"), (-F.col("best.less")).alias("length"), F.col("best.period").alias("period"),
        F.expr("(-1000 * best.less) div best.period").alias("exponent_milli"), F.sha2(text.cast("binary"), 256).alias("runs_sha256"), F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )
