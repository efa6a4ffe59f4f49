"""Ordered folds: greedy packing, budgets, run merging, neighbours and as-of lookups."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.functions import text as tx
from tessera.operators import tables


def greedy_parts(sizes: list[int], cap: int, between: int = 0, each: int = 0) -> list[int]:
    """Part numbers from 1: an item joins the open part unless that would exceed cap; one too large stands alone.

    between is added for each join, each for every item, the first of a part included.
    """
    part, used, out = 0, 0, []
    for size in sizes:
        if part and used + between + size + each <= cap:
            used += between + size + each
        else:
            part, used = part + 1, size + each
        out.append(part)
    return out


def running(rows: DataFrame, key: list[str], order: list[str], schema: str, start: Callable[[], Callable[..., tuple]]) -> DataFrame:
    """One output row for each row, from a fold over each key's rows in order.

    start() gives a function with a fresh state for a key; called with a row's values it returns the output. Rows
    come sorted in Arrow batches, so a key of any size needs its state in memory and no more.
    """
    kinds = rows.sparkSession.createDataFrame([], schema).toArrow().schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, step = None, None
        for batch in batches:
            out = []
            for values in zip(*(c.to_pylist() for c in batch.columns)):
                if step is None or values[: len(key)] != known:
                    known, step = values[: len(key)], start()
                out.append(step(*values))
            yield pa.RecordBatch.from_arrays([pa.array([o[k] for o in out], f.type) for k, f in enumerate(kinds)], names=kinds.names)

    rest = [c for c in rows.columns if c not in key]
    return rows.select(*key, *rest).repartition(*key).sortWithinPartitions(*key, *order).mapInArrow(run, schema)


def pack_greedy(rows: DataFrame, sizes: str, cap: int, between: int = 0, each: int = 0, out: str = "parts") -> DataFrame:
    """Adds an array of part numbers to rows that each hold one sequence's sizes; one pass over each array."""
    schema = T.StructType([*rows.schema.fields, T.StructField(out, T.ArrayType(T.IntegerType()))])
    names = [*rows.columns, out]
    at = names.index(sizes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = [greedy_parts(s.as_py() or [], cap, between, each) for s in batch.column(at)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(parts, pa.list_(pa.int32()))], names=names)

    return rows.mapInArrow(run, schema)


def lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, segments): the non-blank lines of each text, trimmed."""
    trimmed = F.transform(F.split(text_col, "\n"), lambda x: F.trim(x))
    return docs.select(id_col, F.filter(trimmed, lambda x: x != "").alias("segments"))


def packed_lines(docs: DataFrame, cap: int, between: int, each: int = 0, texts: bool = True) -> DataFrame:
    """(doc_id, part, n, first, last, chars, text): parts of packed lines, in one pass over each document and without a shuffle.

    Without texts only the lines' sizes leave the plan for the packing.
    """
    sized = lines(docs).select("doc_id", F.transform("segments", lambda x: F.length(x)).alias("sizes"), *(["segments"] if texts else []))
    names = ["doc_id", "part", "n", "first", "last", "chars", *(["text"] if texts else [])]
    kinds = [pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.int64()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            owner, rows, said = [], [], []
            for doc, sizes in enumerate(batch.column(1).to_pylist()):
                parts = greedy_parts(sizes or [], cap, between, each)
                own = batch.column(2)[doc].as_py() if texts else None
                at = 0
                while at < len(parts):
                    end = at + 1
                    while end < len(parts) and parts[end] == parts[at]:
                        end += 1
                    n = end - at
                    rows.append((parts[at], n, at + 1, end, sum(sizes[at:end]) + between * (n - 1) + each * n))
                    owner.append(doc)
                    if texts:
                        said.append(" ".join(own[at:end]))
                    at = end
            found = [batch.column(0).take(pa.array(owner, pa.int64())), *(pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds))]
            yield pa.RecordBatch.from_arrays(found + ([pa.array(said, pa.string())] if texts else []), names=names)

    schema = f"doc_id {dict(docs.dtypes)['doc_id']}, part int, n long, first int, last int, chars long" + (", text string" if texts else "")
    return sized.mapInArrow(run, schema)


def built_chunks(items: DataFrame, segments: DataFrame, cap: int = 1200, key: str = "item") -> DataFrame:
    """(item, seq, kind, text, start, end): each item's summary as chunk 0, then its segments packed to cap with their times.

    items has (item, summary, main_reference, topics, references), segments (item, at, text, start, end). One item's
    segments are one array.
    """
    line = lambda name, c: F.when(c != "", F.concat(F.lit(f"{name}: "), c))
    told = [F.col("summary"), line("Main text", F.col("main_reference")), line("Topics", F.array_join("topics", ", ")), line("Scripture", F.array_join("references", ", "))]
    nothing = F.lit(None).cast("double")
    summaries = items.select(key, F.lit(0).alias("seq"), F.lit("summary").alias("kind"), F.concat_ws("\n", *told).alias("text"), nothing.alias("start"), nothing.alias("end"))
    listed = segments.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("at", "text", F.col("start").cast("double").alias("start"), F.col("end").cast("double").alias("end")))).alias("segments"))
    packed = pack_greedy(listed.withColumn("sizes", F.transform("segments", lambda x: F.length(x["text"]))), "sizes", cap, 1)
    flat = packed.select(key, F.explode(F.arrays_zip("segments", "parts")).alias("s")).select(key, F.col("s.parts").alias("seq"), "s.segments.at", "s.segments.text", "s.segments.start", "s.segments.end")
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "text"))), lambda x: x["text"]), " ")
    chunks = flat.groupBy(key, "seq").agg(joined.alias("text"), F.min_by("start", "at").alias("start"), F.max_by("end", "at").alias("end"))
    return summaries.unionByName(chunks.withColumn("kind", F.lit("transcript")))


def prefix_budget(rows: DataFrame, group: list[str], order: list, size: str, cap: int) -> DataFrame:
    """The first row of each group, and the rows after it while the running total stays within cap."""
    w = Window.partitionBy(*group).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    rank = F.row_number().over(Window.partitionBy(*group).orderBy(*order))
    return rows.withColumn("_total", F.sum(size).over(w)).withColumn("_rank", rank).where((F.col("_rank") == 1) | (F.col("_total") <= cap)).drop("_total", "_rank")


def first_fit(rows: DataFrame, group: list[str], order: list[str], item: str, size: str, cap: int) -> DataFrame:
    """(group, item): everything if it fits, else, in order, each item that fits what is left. Groups are candidate lists of one question."""
    listed = rows.groupBy(*group).agg(F.array_sort(F.collect_list(F.struct(*order, F.col(item).alias("_item"), F.col(size).cast("long").alias("_size")))).alias("_list"))

    def step(acc: Column, x: Column) -> Column:
        fits = x["_size"] <= acc["left"]
        return F.struct(
            F.when(fits, acc["left"] - x["_size"]).otherwise(acc["left"]).alias("left"),
            F.when(fits, F.array_append(acc["kept"], x["_item"])).otherwise(acc["kept"]).alias("kept"),
        )

    kind = dict(rows.dtypes)[item]
    start = F.struct(F.lit(cap).cast("long").alias("left"), F.array().cast(f"array<{kind}>").alias("kept"))
    return listed.select(*group, F.explode(F.aggregate("_list", start, step)["kept"]).alias(item))


def merge_runs(rows: DataFrame, group: list[str], seq: str, cap: int, text: str, kind: str | None = None, carried: list[str] | None = None, best: str | None = None) -> DataFrame:
    """(group, first, last, n, text, carried): consecutive numbers joined, at most cap to a run.

    Given a kind column, only 'transcript' rows join; any other stands alone. The columns carried are the first
    row's; given a column best, its least value is the run's `rank`.
    """
    w = Window.partitionBy(*group).orderBy(seq)
    joins = F.lit(True) if kind is None else F.col(kind) == "transcript"
    follows = joins & F.lag(joins, 1, False).over(w) & (F.col(seq) == F.lag(seq).over(w) + 1)
    island = rows.withColumn("_starts", F.when(F.coalesce(follows, F.lit(False)), 0).otherwise(1)).withColumn("_island", F.sum("_starts").over(w))
    inside = Window.partitionBy(*group, "_island").orderBy(seq)
    runs = island.withColumn("_sub", F.floor((F.row_number().over(inside) - 1) / cap))
    joined = F.concat_ws("\n\n", F.transform(F.array_sort(F.collect_list(F.struct(F.col(seq).alias("s"), F.col(text).alias("t")))), lambda x: x["t"]))
    kept = [F.min_by(c, seq).alias(c) for c in carried or []] + ([F.min(best).alias("rank")] if best else [])
    out = runs.groupBy(*group, "_island", "_sub").agg(F.min(seq).alias("first"), F.max(seq).alias("last"), F.count(F.lit(1)).alias("n"), joined.alias("text"), *kept)
    return out.drop("_island", "_sub")


def neighbours(hits: DataFrame, rows: DataFrame, group: list[str], seq: str, before: int, after: int) -> DataFrame:
    """Rows at most so far before or after a hit in its group, each once: an equi-join on the exploded numbers."""
    near = hits.select(*group, F.explode(F.sequence(F.col(seq) - before, F.col(seq) + after)).alias(seq)).distinct()
    return rows.join(near, [*group, seq], "left_semi")


def overlapping(left: DataFrame, right: DataFrame, key: str, span: tuple[str, str], other: tuple[str, str]) -> DataFrame:
    """Rows of left and right of one key whose spans of numbers, ends included, overlap. A span that ends before it starts overlaps none.

    Spans are posted in bins of time rather than met by key: a span's class is the power of two at or above its length,
    and at the level of a class bins are as wide, so a span lies in three bins at most of its own and of each wider level.
    Two spans meet at the level of the wider one, in the bin of the later start, and nowhere else. So a key's pairs are
    dealt over its time, and long spans do not fill the bins of short ones.
    """
    sides, present = [], []
    for rows, start, end, name in ((left, *span, "l"), (right, *other, "r")):
        length = F.col(end).cast("double") - F.col(start).cast("double")
        rows = rows.where(length >= 0).withColumn(f"_class_{name}", F.ceil(F.log2(F.greatest(length, F.lit(1.0)))).cast("int"))
        present.append([r[0] for r in rows.select(f"_class_{name}").distinct().collect()])  # powers of two in doubles: a thousand at most
        sides.append((rows, start, end, name))
    posted = []
    for (rows, start, end, name), others in zip(sides, reversed(present)):
        own = f"_class_{name}"
        # its own level, where narrower spans of the other side are posted, too, and each level above at which the other side has spans
        above = F.filter(F.array(*[F.lit(c) for c in sorted(others)]).cast("array<int>"), lambda c: c > F.col(own))  # noqa: B023
        rows = rows.withColumn("_level", F.explode(F.concat(F.array(F.col(own)), above)))
        first, last = (F.floor(F.col(c).cast("double") / F.pow(F.lit(2.0), F.col("_level"))) for c in (start, end))
        posted.append(rows.withColumn("_bin", F.explode(F.sequence(first, last))))
    met = posted[0].join(posted[1], [key, "_level", "_bin"])
    later = F.greatest(F.col(span[0]).cast("double"), F.col(other[0]).cast("double"))
    here = (F.col("_level") == F.greatest("_class_l", "_class_r")) & (F.floor(later / F.pow(F.lit(2.0), F.col("_level"))) == F.col("_bin"))
    overlap = (F.col(span[0]) <= F.col(other[1])) & (F.col(span[1]) >= F.col(other[0]))
    return met.where(here & overlap).drop("_level", "_bin", "_class_l", "_class_r")


def overlap_counts(spans: DataFrame, key: str, start: str, end: str, ids: list[str], stretches: int = 16) -> DataFrame:
    """(ids, n, first): how many spans of its key each overlaps, ends and itself included, and the least start of these.

    No pairs are made. Those that a span overlaps have started by its end, less those that had ended before its start; the
    least start is that of those which end at its start or later. So a span is two rows, in the order of time, with counts up to
    each and the least start from each on. A key's rows are dealt by stretches of time, so many over all of it; what goes from
    one to another comes from a table with a row a key and stretch. Spans that end before they start overlap none, as do those
    without a key, start or end; spans that share ids are added up.
    """
    whole = spans.where(F.col(key).isNotNull() & (F.col(start) <= F.col(end)))
    ends = whole.agg(F.min(start).cast("double").alias("a"), F.max(end).cast("double").alias("b")).first()
    low, width = ends["a"] or 0.0, max(((ends["b"] or 0.0) - (ends["a"] or 0.0)) / stretches, 1e-9)
    # starts come before ends of the same time, so both counts run up to the row itself
    mark = lambda at, is_end: F.struct(F.col(at).alias("_at"), F.lit(is_end).alias("_end"), F.when(F.lit(is_end == 1), F.col(start)).alias("_from"))
    marks = whole.select(*ids, F.col(key).alias("_key"), F.explode(F.array(mark(start, 0), mark(end, 1))).alias("_m")).select(*ids, "_key", "_m.*")
    marks = marks.withColumn("_part", F.least(F.lit(stretches - 1), F.floor((F.col("_at").cast("double") - low) / width)).cast("int"))
    parts = marks.groupBy("_key", "_part").agg(F.count_if(F.col("_end") == 0).alias("_starts"), F.sum("_end").alias("_ends"), F.min("_from").alias("_least"))
    along = Window.partitionBy("_key").orderBy("_part")
    before, after = along.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy("_key").orderBy(F.desc("_part")).rowsBetween(Window.unboundedPreceding, -1)
    carried = parts.select("_key", "_part", F.coalesce(F.sum("_starts").over(before), F.lit(0)).alias("_begun"), F.coalesce(F.sum("_ends").over(before), F.lit(0)).alias("_over"), F.min("_least").over(after).alias("_later"))
    inside = Window.partitionBy("_key", "_part").orderBy("_at", "_end")
    upto, onward = inside.rowsBetween(Window.unboundedPreceding, 0), Window.partitionBy("_key", "_part").orderBy(F.desc("_at"), F.desc("_end")).rowsBetween(Window.unboundedPreceding, 0)
    # rows of one time and kind: starts need the ends before them, ends the starts; neither counts its own kind
    counted = marks.withColumns({"_s": F.count_if(F.col("_end") == 0).over(upto), "_e": F.sum("_end").over(upto)}).withColumn("_l", F.min("_from").over(onward))
    joined = counted.join(carried, ["_key", "_part"])
    n = F.sum(F.when(F.col("_end") == 1, F.col("_begun") + F.col("_s")).otherwise(-F.col("_over") - F.col("_e")))
    first = F.min(F.when(F.col("_end") == 0, F.least("_l", "_later")))
    return joined.groupBy(*ids).agg(n.alias("n"), first.alias("first"))


def as_of(left: DataFrame, right: DataFrame, group: list[str], time: str, value: str, stretches: int = 256, or_first: bool = True) -> DataFrame:
    """left with the value of the last row of right at or before its time, or of the first row if all come later (null without or_first).

    A left row with a null time gets the first value, as nothing moves on; rows of right without a time or a value are no
    marks. A group's rows are dealt by stretches of time, so many over all the time there is; a stretch's last mark goes
    to the ones after it through a table with a row a stretch.
    """
    kind = dict(right.dtypes)[value]
    right = right.where(F.col(value).isNotNull() & F.col(time).isNotNull())
    both = left.withColumn("_v", F.lit(None).cast(kind)).withColumn("_side", F.lit(1))
    marks = right.select(*[F.col(c) if c in (*group, time) else F.lit(None).cast(t).alias(c) for c, t in left.dtypes], F.col(value).alias("_v"), F.lit(0).alias("_side"))
    dated = dict(left.dtypes)[time].startswith(("timestamp", "date"))
    number = (F.col(time).cast("timestamp") if dated else F.col(time)).cast("double")
    ends = right.agg(F.min(number).alias("a"), F.max(number).alias("b")).first()
    low, width = (ends["a"] or 0.0), max(((ends["b"] or 0.0) - (ends["a"] or 0.0)) / stretches, 1e-9)
    # what comes before the first mark, rows without a time among it, is a stretch, too
    part = F.least(F.lit(stretches), F.greatest(F.lit(-1), F.floor((number - low) / width))).cast("int")
    both = both.unionByName(marks).withColumn("_part", part)
    inside = Window.partitionBy(*group, "_part").orderBy(F.asc_nulls_first(time), "_side")
    local = both.withColumn("_seen", F.last("_v", ignorenulls=True).over(inside.rowsBetween(Window.unboundedPreceding, 0)))
    at = F.when(F.col("_side") == 0, F.col(time))
    parts = both.groupBy(*group, "_part").agg(F.max_by("_v", at).alias("_last"), F.min_by("_v", at).alias("_first"))
    along = Window.partitionBy(*group).orderBy("_part")
    carried = F.last("_last", ignorenulls=True).over(along.rowsBetween(Window.unboundedPreceding, -1))
    earliest = F.first("_first", ignorenulls=True).over(along.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    parts = parts.select(*(F.col(g).alias(f"_g{k}") for k, g in enumerate(group)), F.col("_part").alias("_of"), carried.alias("_carried"), earliest.alias("_earliest"))
    same = F.col("_part") == F.col("_of")
    for k, g in enumerate(group):
        same = same & F.col(g).eqNullSafe(F.col(f"_g{k}"))
    found = local.where("_side = 1").join(parts, same).withColumn("_found", F.coalesce("_seen", "_carried", *(["_earliest"] if or_first else [])))
    return found.select(*left.columns, F.col("_found").alias(value))


def spoken(times: DataFrame, segments: DataFrame, group: list[str], time: str) -> DataFrame:
    """times with (segment, index, word): what is being said then, in segments (group, start, end, text); nulls before the first segment.

    The segment is the last that has started. Its words share its length evenly; past its end the last one stays.
    """
    marks = segments.select(*group, F.col("start").cast(dict(times.dtypes)[time]).alias(time), F.struct(F.col("start").cast("double").alias("start"), F.col("end").cast("double").alias("end"), "text").alias("segment"))
    found = as_of(times, marks, group, time, "segment", or_first=False)
    words = found.withColumn("_words", F.filter(F.split("segment.text", f"{tx.SPACE}+"), lambda w: w != ""))
    index = tx.word_index(F.col(time).cast("double"), F.col("segment.start"), F.col("segment.end"), F.size("_words"))
    return words.withColumn("index", F.when(F.col("segment").isNotNull(), index)).withColumn("word", F.get("_words", F.col("index"))).drop("_words")


def numbered_by(rows: DataFrame, order: list, out: str, parts: int = 64) -> DataFrame:
    """rows with their number, from 1 without gaps, in an order over all of them.

    Rows are sorted in ranges, which are written with each row's place, since ranges may fall otherwise if they are
    worked out again; a range starts where those before it end.
    """
    ranged = rows.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn("_id", F.monotonically_increasing_id())
    placed = ranged.select(*rows.columns, F.shiftright("_id", 33).alias("_range"), F.col("_id").bitwiseAND(F.lit((1 << 33) - 1)).alias("_place"))
    placed = tables.written(placed, "numbered")
    sizes = placed.groupBy("_range").agg(F.count(F.lit(1)).alias("_n"))  # a row for each range, `parts` at most
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("_range", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    return placed.join(F.broadcast(starts), "_range").select(*rows.columns, (F.col("_start") + F.col("_place") + 1).cast("int").alias(out))


def quietest(samples: DataFrame, pos: str, value: str, width: int, hop: int, last: int) -> DataFrame:
    """(pos, energy): the start of the quietest window among those at multiples of hop in the last so many samples.

    Samples are numbered from 0. Only the last ones are read on; their energies come from a window sum, dealt by
    blocks that overlap by the width.
    """
    total = samples.agg(F.count(F.lit(1)).alias("n"))
    samples = samples.where(F.col(pos) >= total.first()["n"] - last)
    block = 1 << 20
    own = F.floor(F.col(pos) / block)
    spread = samples.select(pos, value, F.explode(F.array_distinct(F.array(own, F.floor((F.col(pos) - width + 1) / block)))).alias("_block"))
    w = Window.partitionBy("_block").orderBy(pos).rowsBetween(0, width - 1)
    summed = spread.withColumn("energy", F.sum(F.col(value) * F.col(value)).over(w)).where(F.floor(F.col(pos) / block) == F.col("_block"))
    fits = summed.join(F.broadcast(total)).where((F.col(pos) % hop == 0) & (F.col(pos) + width <= F.col("n")) & (F.col(pos) >= F.col("n") - last))
    return fits.orderBy("energy", pos).limit(1).select(pos, "energy")


def decimate(samples: DataFrame, pos: str, value: str, source_rate: int, rate: int) -> DataFrame:
    """Samples at a lower rate: the mean of those that fall in each step."""
    step = F.floor(F.col(pos) * rate / source_rate).cast("long")
    return samples.groupBy(step.alias("step")).agg(F.avg(value).alias("level"), F.count(F.lit(1)).alias("n"))
