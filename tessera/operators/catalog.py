"""The catalogue of an archive: scopes, filters, facets, counts and pages."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions import text as tx
from tessera.operators import folds


@dataclass(frozen=True)
class Scope:
    """What a question is about. None leaves a part open; an empty tuple of ids admits nothing."""

    ids: tuple[int, ...] | None = None
    series: str | None = None
    speaker: str | None = None
    first_day: str | None = None
    last_day: str | None = None

    @property
    def open(self) -> bool:
        return self == Scope()


def day(c: str) -> Column:
    return F.date_format(c, "yyyy-MM-dd")


def in_scope(entries: DataFrame, scope: Scope, id_col: str = "id", series: str = "series", speaker: str = "speaker", published: str = "published_at") -> DataFrame:
    """Entries that a scope admits: series by exact case, speaker ignoring case, days inclusive; no date fails any bound."""
    out = entries
    if scope.ids is not None:
        out = out.where(F.col(id_col).isin(*scope.ids)) if scope.ids else out.limit(0)
    if scope.series is not None:
        out = out.where(F.col(series) == scope.series)
    if scope.speaker is not None:
        out = out.where(F.lower(speaker) == scope.speaker.lower())
    if scope.first_day is not None:
        out = out.where(day(published) >= scope.first_day)
    if scope.last_day is not None:
        out = out.where(day(published) <= scope.last_day)
    return out


def api_filter(entries: DataFrame, series: str | None = None, speaker: str | None = None, series_col: str = "series", speaker_col: str = "speaker") -> DataFrame:
    """The looser filter of the programming interface: series ignoring case, speaker by a part of the name."""
    out = entries
    if series is not None:
        out = out.where(F.lower(series_col) == series.lower())
    if speaker is not None:
        out = out.where(F.contains(F.lower(speaker_col), F.lit(speaker.lower())))
    return out


def keyword_search(entries: DataFrame, columns: list[str], needle: str) -> DataFrame:
    return entries.where(tx.any_contains(columns, needle))


def with_status(entries: DataFrame, *wanted: str, status: str = "status") -> DataFrame:
    """Entries in any of some states."""
    return entries.where(F.col(status).isin(*wanted))


def first_matches(entries: DataFrame, columns: list[str], needle: str, order: list, most: int) -> DataFrame:
    """The first so many entries that hold the words, in a given order, such as that of a book."""
    return keyword_search(entries, columns, needle).orderBy(*order).limit(most)


def prefix_or_contains(entries: DataFrame, date: Column, columns: list[str], needle: str) -> DataFrame:
    """Entries whose date starts with the words, or whose columns hold them."""
    return entries.where(F.coalesce(F.startswith(date, F.lit(needle)), F.lit(False)) | tx.any_contains(columns, needle))


def clamp(value: object, low: int, high: int, fallback: int) -> int:
    """A whole number within bounds from a request, or the fallback if it is not one."""
    try:
        return max(low, min(high, int(str(value).strip())))
    except ValueError:
        return fallback


def status_counts(rows: DataFrame, status: str, all_statuses: list[str]) -> DataFrame:
    """(status, n) for every status there is, zero where nothing has it."""
    known = rows.sparkSession.createDataFrame([(s,) for s in all_statuses], "status string")
    counts = rows.groupBy(F.col(status).alias("status")).agg(F.count(F.lit(1)).alias("n"))
    return known.join(counts, "status", "left").select("status", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def facet(rows: DataFrame, value: str, newest: str) -> DataFrame:
    """(value, n, newest): how often each value occurs and when last."""
    return rows.where(F.col(value).isNotNull()).groupBy(F.col(value).alias("value")).agg(F.count(F.lit(1)).alias("n"), F.max(newest).alias("newest"))


def page(rows: DataFrame, order: list, size: int, number: int) -> DataFrame:
    """One page of rows in a total order, with the number of all rows."""
    total = rows.agg(F.count(F.lit(1)).alias("total"))
    return rows.orderBy(*order).offset(size * (number - 1)).limit(size).join(F.broadcast(total))


def newest_first(rows: DataFrame, order: list, n: int, flag: str = "within") -> DataFrame:
    """rows with a flag: whether they are among the first n. Only the n-th row's place is looked up, not a rank of all."""
    head = rows.orderBy(*order).limit(n).select(F.col("id").alias("_id"))
    return rows.join(head, F.col("id") == F.col("_id"), "left").withColumn(flag, F.col("_id").isNotNull()).drop("_id")


def threads(turns: DataFrame, thread: str, order: list[str], question: str, at: str) -> DataFrame:
    """(thread, n, question, updated): how many turns, the first question, the last time."""
    return turns.groupBy(thread).agg(F.count(F.lit(1)).alias("n"), F.min_by(question, F.struct(*order)).alias("question"), F.max(at).alias("updated"))


def estimate(items: DataFrame, order: list, n: int, seconds: str, fallback_minutes: float, price: float) -> DataFrame:
    """Cost of the newest n items: minutes (a fallback where a duration is missing), guesses, price and tokens."""
    newest = items.orderBy(*order).limit(n)
    known = newest.agg(
        F.count(F.lit(1)).alias("n"),
        F.floor(F.sum(F.coalesce(F.col(seconds) / 60, F.lit(fallback_minutes))) + 0.5).cast("long").alias("minutes"),
        F.count_if(F.col(seconds).isNull()).alias("guessed"),
    )
    return known.select("n", "minutes", "guessed", F.round(F.col("minutes") * price, 4).alias("usd"), (F.col("minutes") * 600 + F.col("n") * 4000).alias("tokens"))


def ranked_values(rows: DataFrame, value: str) -> DataFrame:
    """(value, n, rank): by number, then by name."""
    counts = rows.where(F.col(value).isNotNull()).groupBy(F.col(value).alias("value")).agg(F.count(F.lit(1)).alias("n"))
    return folds.numbered_by(counts, [F.desc("n"), F.col("value")], "rank")


def summary_of_facets(entries: DataFrame, values: dict[str, str], id_col: str, published: str) -> DataFrame:
    """(kind, value, n, rank, total, earliest, latest) of several facets of a catalogue that is read newest first.

    The facet called series is ranked by when a value is first seen in that order, others by number and then name.
    """
    place = F.struct(F.col(published).isNull(), -F.unix_micros(F.col(published).cast("timestamp")), F.col(id_col))
    each = [F.struct(F.lit(kind).alias("kind"), F.col(c).cast("string").alias("value")) for kind, c in values.items()]
    told = entries.select(place.alias("_place"), F.explode(F.array(*each)).alias("f")).select("_place", "f.kind", "f.value").where("value <> ''")
    counts = told.groupBy("kind", "value").agg(F.count(F.lit(1)).alias("n"), F.min("_place").alias("_seen"))
    series = F.col("kind") == "series"
    counts = counts.withColumn("_by", F.when(series, F.col("_seen"))).withColumn("_many", F.when(~series, F.col("n")))
    ranked = folds.numbered_by(counts, [F.col("kind"), F.col("_by"), F.desc("_many"), F.col("value")], "_rank")
    first = ranked.groupBy("kind").agg(F.min("_rank").alias("_first"))  # a row a facet
    ranked = ranked.join(F.broadcast(first), "kind").withColumn("rank", F.col("_rank") - F.col("_first") + 1)
    totals = entries.agg(F.count(F.lit(1)).alias("total"), F.min(day(published)).alias("earliest"), F.max(day(published)).alias("latest"))  # one row
    return ranked.drop("_seen", "_by", "_many", "_rank", "_first").join(F.broadcast(totals))


def limited_then_filtered(rows: DataFrame, order: list, most: int, keep: Column) -> DataFrame:
    """Of the first so many rows those that pass: what a page shows, which may be fewer than there are."""
    return rows.orderBy(*order).limit(most).where(keep)


def filtered_then_sliced(rows: DataFrame, order: list, offset: int, most: int, keep: Column) -> DataFrame:
    """A slice of the rows that pass, with their total: what an interface returns."""
    passing = rows.where(keep)
    return passing.orderBy(*order).offset(offset).limit(most).join(F.broadcast(passing.agg(F.count(F.lit(1)).alias("total"))))


def reading_order(published: str, item: str, seq: str) -> list:
    """Oldest first, what has no date before all."""
    return [F.asc_nulls_first(published), F.asc(item), F.asc(seq)]


#: Forms of a day and an id in requests, how long a text and how many ids they may have.
DAY, ID, MAX_TEXT, MAX_IDS = re.compile(r"\d{4}-\d{2}-\d{2}"), re.compile(r"[\w-]{1,64}"), 120, 50


def read_filters(params: dict[str, list[str]]) -> dict | str:
    """Filters of a request (series, speaker, from, to, ids), or what is wrong with it. Texts are cut, ids taken once each."""
    texts = {k: (params.get(k) or [""])[0].strip()[:MAX_TEXT] for k in ("series", "speaker", "from", "to")}
    for k in ("from", "to"):
        if texts[k] and not DAY.fullmatch(texts[k]):
            return f"{k} must be a day like 2024-01-31"
    ids = [i for given in params.get("id", []) for i in map(str.strip, given.split(",")) if i]
    if not all(ID.fullmatch(i) for i in ids):
        return "each id must be one of the catalogue's"
    found = {k: v for k, v in texts.items() if v}
    return found | ({"ids": list(dict.fromkeys(ids))[:MAX_IDS]} if ids else {})


def read_count(params: dict[str, list[str]], name: str, fallback: int, most: int) -> int | str:
    """A whole number of a request, the fallback if it is not given, or what is wrong with it."""
    raw = (params.get(name) or [""])[0]
    least = 0 if name == "offset" else 1
    if raw == "":
        return fallback
    return int(raw) if re.fullmatch(r"\s*\+?\d+\s*", raw) and least <= int(raw) <= most else f"{name} must be a whole number from {least} to {most}"
