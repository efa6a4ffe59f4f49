"""Model calls as injected callables, with deterministic stand-ins that need no network."""

from __future__ import annotations

import time
import zlib
from collections.abc import Callable, Iterator
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import types as T


class Embedder(Protocol):
    def __call__(self, texts: list[str]) -> list[list[float]]: ...


class Chat(Protocol):
    def __call__(self, prompt: str) -> str: ...


class HashedWords:
    """An embedder for tests: words hashed to signed dimensions, so that texts sharing words are near."""

    def __init__(self, dim: int = 64):
        self.dim = dim

    def __call__(self, texts: list[str]) -> list[list[float]]:
        out = np.zeros((len(texts), self.dim))
        for row, text in zip(out, texts):
            for word in text.lower().split():
                h = zlib.crc32(word.encode())
                row[h % self.dim] += 1 if h >> 16 & 1 else -1
            norm = np.linalg.norm(row)
            row /= norm or 1
        return out.tolist()


def with_retries(call: Callable, attempts: int = 3, wait: float = 0.0) -> Callable:
    """The call, tried again after an error, each time after a longer wait."""

    def run(*args):
        for k in range(attempts):
            try:
                return call(*args)
            except Exception:
                if k + 1 == attempts:
                    raise
                time.sleep(wait * 2**k)

    return run


def with_fallbacks(calls: list[Callable]) -> Callable:
    """The first of the calls that succeeds; the last one's error if none does."""

    def run(*args):
        for k, call in enumerate(calls):
            try:
                return call(*args)
            except Exception:
                if k + 1 == len(calls):
                    raise

    return run


def embed(rows: DataFrame, text: str, embedder: Embedder, dim: int, batch: int = 64) -> DataFrame:
    """rows with an embedding of their text, asked for in batches; a reply of the wrong size is an error."""
    schema = T.StructType([*rows.schema.fields, T.StructField("embedding", T.ArrayType(T.FloatType()))])

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            found: list = []
            for at in range(0, len(frame), batch):
                reply = embedder(frame[text].fillna("").iloc[at : at + batch].tolist())
                if any(len(v) != dim for v in reply):
                    raise ValueError("an embedding has the wrong size")
                found += reply
            if len(found) != len(frame):
                raise ValueError("embeddings are missing")
            yield frame.assign(embedding=found)

    return rows.mapInPandas(run, schema)


def ask(rows: DataFrame, prompt: str, chat: Chat, out: str = "reply") -> DataFrame:
    """rows with the reply to their prompt."""
    schema = T.StructType([*rows.schema.fields, T.StructField(out, T.StringType())])

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield frame.assign(**{out: [chat(p) for p in frame[prompt]]})

    return rows.mapInPandas(run, schema)


def transcribe_parts(recordings: DataFrame, call: Callable[[object, float, float], list[tuple[str, float, float]]], part: float = 240.0, least: float = 30.0) -> DataFrame:
    """(id, segments, done, part): each recording (id, seconds, done, segments) transcribed part by part from where it stands.

    call(id, from, to) gives a part's segments or raises TimeoutError, after which parts are half as long, never
    below least. If it fails at that length, or in another way, what is done so far comes back, to be resumed.
    """
    kind = dict(recordings.dtypes)["id"]
    segment = "array<struct<text:string,start:double,end:double>>"

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        length = part
        for frame in frames:
            out = []
            for row in frame.itertuples():
                at, found = float(row.done), [tuple(s.values()) if isinstance(s, dict) else tuple(s) for s in row.segments]
                while at < row.seconds:
                    end = min(row.seconds, at + length)
                    try:
                        found += call(row.id, at, end)
                    except TimeoutError:
                        if length <= least:
                            break
                        length = max(least, length // 2)
                        continue
                    except Exception:
                        break
                    at = end
                out.append((row.id, [{"text": t, "start": a, "end": b} for t, a, b in found], at, length))
            yield pd.DataFrame(out, columns=["id", "segments", "done", "part"])

    return recordings.select("id", "seconds", "done", "segments").mapInPandas(run, f"id {kind}, segments {segment}, done double, part double")
