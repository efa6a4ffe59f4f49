"""SimHash near-duplicates by an inverted index on byte positions.

A fingerprint has eight positional bytes. Two fingerprints that differ in at most two bits differ in at most
two bytes, so they share at least six positional bytes: the guaranteed minimum. A single (position, byte) posting
would hold a 256th of the corpus, so postings are split by further bytes: a fingerprint is posted under fourteen
sets of four positions, chosen so that any six shared positions are covered by the sets among them. A posting that
is still hot is split once more, by two further bytes. All pairs that meet in a posting are tallied: the shared
positions of their postings add up to all that they share if that is six or more, and to fewer than six otherwise.
Pairs with six shared positions are retained and verified by their differing bits.

Links by similarity (the Jaccard index of sets of word shingles) need a wider fingerprint. Shingles are dealt by
their hashes into groups, two to a group at most on average, and the SimHash of each group is a positional word. A shingle
that only one side has spoils one word at most, and similar sets have few such shingles, so a pair is sure to share a
number of words: the guaranteed minimum. Words are put in one order for all sets, rare ones first, and of each
set's words only so many first ones are posted that a similar pair still meets in TALLY postings, or in as many as its
minimum says. First all meet the heads of their postings: these meetings are tallied, and pairs that reach this are
retained. What heads do not connect meets guides, a few members of each posting's largest component, and is joined to it
by one link. What is apart then meets each other, a pair at its least common word, if sketches do not rule it out.
All are verified by their sets. Sets too small to be sure of a common word post all words and all shingles. So no
pair is missed, and common words, of which a text always has rarer ones beside it, are hardly ever posted.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from functools import reduce
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import components, drop_tables, least_names, materialize, spread_join

SEED = 42
SHINGLE = 3
MAX_BITS = 2
#: Sets of four of eight positions. Any three positions lie in one set, so of six shared positions each lies in one with three others of them.
SETS = (
    (0, 1, 2, 3), (0, 1, 4, 5), (0, 1, 6, 7), (0, 2, 4, 6), (0, 2, 5, 7), (0, 3, 4, 7), (0, 3, 5, 6),
    (4, 5, 6, 7), (2, 3, 6, 7), (2, 3, 4, 5), (1, 3, 5, 7), (1, 3, 4, 6), (1, 2, 5, 6), (1, 2, 4, 7),
)
#: A posting with more fingerprints is split by two further bytes; then at most 2^16 can be in it.
HOT = 64
#: Shingles hashed at once; bounds memory for very long texts.
BLOCK = 1 << 16
#: Postings that a similar pair has in common at least, if its guaranteed minimum allows.
TALLY = 4
#: Counters of words, which words are put in order by; what shares a counter is counted together. Their number bounds what tasks hold.
COUNTERS = 1 << 22
#: Words of a set by which pairs are told that meet in a lesser word, too.
LOW = 32
#: Times that what is not connected meets guides, at most, and how many orders of sets tell who is a guide each time.
TURNS, GUIDES = 2, 8
#: Slices in which the tasks' counters are added up.
SLICES = 256
#: Fingerprints that a task remembers, to post equal sets once.
SEEN = 1 << 20
#: Bits of a set's sketch.
SKETCH = 2048
MIX, STEP = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


def fingerprint(text: bytes | None) -> int:
    """The 64-bit fingerprint of a text; 0 for null, empty and blank texts.

    A bit is 1 if it is set in over half of the XXH64 hashes of the text's word shingles, repeats included.
    """
    words = (text or b"").lower().split()  # bytes: lowers A-Z only, splits at 0x20 and 0x09-0x0D only
    if not words:
        return 0
    whole = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    n = max(1, len(words) - SHINGLE + 1)
    starts, ends = starts[:n].tolist(), ends[min(SHINGLE, len(words)) - 1 :].tolist()
    ones = np.zeros(64, np.int64)
    digest = xxhash.xxh64_intdigest
    for at in range(0, n, BLOCK):
        hashes = np.array([digest(whole[a:b], SEED) for a, b in zip(starts[at : at + BLOCK], ends[at : at + BLOCK])], dtype=">u8")
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(ones * 2 > n).tobytes(), "big", signed=True)


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, same, fp): one row per row of docs; same is a hash of the text, fp the fingerprint as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = [fingerprint(None if t is None else t.as_py()) for t in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(prints, pa.int64())], names=["id", "same", "fp"])

    text = F.col(text_col).cast("binary")
    return docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(text).alias("same"), text.alias("text")).mapInArrow(run, "id long, same long, fp long")


def shingles(text: bytes | None, shingle: int) -> np.ndarray:
    """The distinct XXH64 hashes of a text's word shingles, ascending; none for null, empty and blank texts."""
    words = (text or b"").lower().split()
    whole = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words], dtype=np.int64) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    n = max(1, len(words) - shingle + 1) if words else 0
    starts, ends = starts[:n].tolist(), ends[min(shingle, len(words)) - 1 :].tolist() if words else []
    digest = xxhash.xxh64_intdigest
    blocks = [np.unique(np.array([digest(whole[a:b], SEED) for a, b in zip(starts[at : at + BLOCK], ends[at : at + BLOCK])], np.uint64)) for at in range(0, n, BLOCK)]
    return blocks[0] if len(blocks) == 1 else np.unique(np.concatenate([np.empty(0, np.uint64), *blocks]))


def exponent(size: int) -> int:
    """The groups of a set are two to this power: the least such number with two shingles a group at most, on average."""
    return max(0, (size - 1).bit_length() - 1)


def positional(found: np.ndarray, groups: int) -> np.ndarray:
    """The words of a set of shingle hashes in so many groups, one for each group that is not empty; keys name group and number of groups, too.

    A word is its group's SimHash: a bit is 1 if it is set in over half of the hashes.
    """
    place = (found * MIX >> np.uint64(20)) & np.uint64(groups - 1)
    order = np.argsort(place, kind="stable")
    place, hashes = place[order], found[order]
    starts = np.flatnonzero(np.concatenate(([True], place[1:] != place[:-1])))
    counts = np.diff(np.append(starts, len(place)))
    word = hashes[starts]
    two = counts == 2
    word[two] &= hashes[starts[two] + 1]
    more = np.flatnonzero(counts > 2)
    if len(more):
        ends = np.cumsum(counts[more])
        own = hashes[np.repeat(starts[more] - ends + counts[more], counts[more]) + np.arange(ends[-1])]
        bits = np.unpackbits(own.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
        ones = np.add.reduceat(bits, ends - counts[more], axis=0, dtype=np.int32)
        word[more] = np.packbits(ones * 2 > counts[more][:, None], axis=1).view(">u8").ravel()
    return _mixed(word ^ ((np.uint64(groups) + place[starts]) * STEP))


def _mixed(key: np.ndarray) -> np.ndarray:
    key = key * MIX
    return (key ^ (key >> np.uint64(29))) * STEP


def words_of(found: np.ndarray, similarity: float) -> list[tuple[np.ndarray, int]]:
    """(words, number to post) for each number of groups that a set of shingle hashes may meet a similar set in.

    That is its own and the one of the largest similar set; the smaller of two sets always has the larger one's. A set
    of a shingles has at most a (1 - s) / s that a similar one has not or the other way round: so many words may be
    spoilt. Where that may be all of them, all shingles are posted as words, too.
    """
    if not len(found):
        return []
    apart = int(len(found) * (1 - similarity) / similarity + 1e-9)
    out, unsure = [], False
    for e in sorted({exponent(len(found)), exponent(int(len(found) / similarity + 1e-9))}):
        words = positional(found, 1 << e)
        unsure |= len(words) <= apart
        out.append((words, len(words) if len(words) <= apart else min(len(words), apart + TALLY)))
    if unsure:
        out.append((_mixed(found), len(found)))
    return out


def sketch(found: np.ndarray) -> np.ndarray:
    """SKETCH bits of a set of shingle hashes: those that its members are dealt to."""
    bits = np.zeros(SKETCH, bool)
    bits[(found >> np.uint64(7)) % np.uint64(SKETCH)] = True
    return np.packbits(bits).view(np.int64)


def wide_fingerprints(docs: DataFrame, id_col: str, text_col: str, shingle: int, similarity: float) -> DataFrame:
    """(id, same, fp, size, e, m, wider, bits, counters): as fingerprints; fp is a hash of the set of shingles, size their number.

    e is the set's exponent, m the number of its words, wider that for the next exponent if it has one; bits is a sketch.
    Each task adds a row of its own, all null but for counters: how often it met the words of each counter.
    """
    numbers = ["size", "e", "m", "wider"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = np.zeros(COUNTERS, np.uint32)
        for batch in batches:
            rows, prints, bits = [], [], []
            for text in batch.column(2):
                found = shingles(None if not text.is_valid else text.as_py(), shingle)
                own = words_of(found, similarity)
                for words, _ in own:
                    np.add.at(count, words % np.uint64(COUNTERS), 1)
                e = exponent(len(found))
                steps = exponent(int(len(found) / similarity + 1e-9)) - e
                rows.append((len(found), e, len(own[0][0]) if own else 0, len(own[1][0]) if steps else None))
                prints.append(xxhash.xxh64_intdigest(found.tobytes(), SEED))
                bits.append(sketch(found))
            columns = [batch.column(0), batch.column(1), pa.array(np.array(prints, np.uint64).view(np.int64))]
            columns += [pa.array([r[k] for r in rows], pa.int64()) for k in range(len(numbers))]
            columns += [pa.array(bits, pa.list_(pa.int64())), pa.nulls(len(rows), pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=["id", "same", "fp", *numbers, "bits", "counters"])
        kinds = [pa.int64()] * 7 + [pa.list_(pa.int64())]
        yield pa.RecordBatch.from_arrays([*(pa.nulls(1, k) for k in kinds), pa.array([zlib.compress(count.tobytes(), 1)], pa.binary())], names=["id", "same", "fp", *numbers, "bits", "counters"])

    text = F.col(text_col).cast("binary")
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(text).alias("same"), text.alias("text"))
    return rows.mapInArrow(run, "id long, same long, fp long, size long, e long, m long, wider long, bits array<long>, counters binary")


def added_up(counters: DataFrame) -> np.ndarray:
    """The sum of the tasks' counters (counters), slice by slice, as eight times its logarithm; COUNTERS bytes, whatever the size of the corpus."""
    width = COUNTERS // SLICES

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for own in batch.column(0):
                parts = np.frombuffer(zlib.decompress(own.as_py()), np.uint32).reshape(SLICES, width)
                there = np.flatnonzero(parts.any(1))
                yield pa.RecordBatch.from_arrays([pa.array(there, pa.int32()), pa.array([zlib.compress(parts[k].tobytes(), 1) for k in there], pa.binary())], names=["slice", "part"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for k, part in zip(batch.column(0).to_pylist(), batch.column(1)):
                own = np.frombuffer(zlib.decompress(part.as_py()), np.uint32).astype(np.int64)
                total[k] = total[k] + own if k in total else own
        parts = [np.floor(8 * np.log2(np.minimum(v, 1 << 31) + 1)).astype(np.uint8).tobytes() for v in total.values()]
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array(parts, pa.binary())], names=["slice", "part"])

    parts = counters.select("counters").mapInArrow(cut, "slice int, part binary").repartition("slice").mapInArrow(add, "slice int, part binary")
    found = np.zeros((SLICES, width), np.uint8)
    for row in parts.collect():  # SLICES rows
        found[row["slice"]] = np.frombuffer(row["part"], np.uint8)
    return found.ravel()


def postings(docs: DataFrame, text_col: str, shingle: int, similarity: float, counts: np.ndarray) -> DataFrame:
    """(word, fp): each set's posted words, the rarest by counts first; of equal sets a task posts one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            words, prints = [], []
            for text in batch.column(0):
                found = shingles(None if not text.is_valid else text.as_py(), shingle)
                fp = xxhash.xxh64_intdigest(found.tobytes(), SEED)
                if fp in seen:
                    continue
                if len(seen) >= SEEN:
                    seen.clear()
                seen.add(fp)
                for own, most in words_of(found, similarity):
                    order = np.lexsort((own, counts[own % np.uint64(COUNTERS)]))[:most]
                    words.append(own[order])
                    prints.append(np.full(len(order), fp, np.uint64))
            if words:
                columns = [pa.array(np.concatenate(c).view(np.int64)) for c in (words, prints)]
                yield pa.RecordBatch.from_arrays(columns, names=["word", "fp"])

    return docs.select(F.col(text_col).cast("binary").alias("text")).mapInArrow(run, "word long, fp long")


def met(posted: DataFrame) -> DataFrame:
    """(word, fp, head): postings with at least two sets, each set once; head is the least of the posting.

    Rows come sorted, so a posting of any size passes through holding its head.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        word = last = head = None
        alone = False  # the head of the open posting has not been given yet
        for batch in batches:
            if not batch.num_rows:
                continue
            w, f = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            new = np.concatenate(([word is None or w[0] != word], w[1:] != w[:-1]))
            fresh = new | np.concatenate(([last is None or f[0] != last], f[1:] != f[:-1]))
            w, f, new = w[fresh], f[fresh], new[fresh]
            if not len(w):
                continue
            starts = np.flatnonzero(new)
            lead = int(starts[0]) if len(starts) else len(w)  # rows that go on with the open posting
            owner = np.concatenate((np.full(lead, head, np.int64) if lead else np.empty(0, np.int64), np.repeat(f[starts], np.diff(np.append(starts, len(w))))))
            single = np.zeros(len(w), bool)
            single[starts] = np.diff(np.append(starts, len(w))) == 1
            out = [w[~single], f[~single], owner[~single]]
            if lead and alone:
                out = [np.concatenate(([x], c)) for x, c in zip((word, head, head), out)]
            alone = bool(single[-1]) if len(starts) else False
            word, last, head = w[-1], f[-1], owner[-1]
            yield pa.RecordBatch.from_arrays([pa.array(c.astype(np.int64)) for c in out], names=["word", "fp", "head"])

    return posted.repartition("word").sortWithinPartitions("word", "fp").mapInArrow(run, "word long, fp long, head long")


def _similar(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """Those of pairs (u, v) whose sets (fp, members) are similar enough."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for a, b in zip(batch.column(2), batch.column(3)):
                a, b = np.frombuffer(a.as_buffer(), np.uint64), np.frombuffer(b.as_buffer(), np.uint64)
                shared = len(np.intersect1d(a, b, assume_unique=True))
                keep.append(shared >= similarity * (len(a) + len(b) - shared))
            yield batch.filter(pa.array(keep, pa.bool_())).select(["u", "v"])

    both = pairs.join(sets.select(F.col("fp").alias("u"), F.col("members").alias("a")), "u")
    both = both.join(sets.select(F.col("fp").alias("v"), F.col("members").alias("b")), "v").select("u", "v", "a", "b")
    return both.mapInArrow(run, "u long, v long")


def retained(tally: DataFrame, known: DataFrame, similarity: float) -> DataFrame:
    """The pairs (u, v) of tally (u, v, n) that reach the guaranteed minimum, or TALLY, and whose sketches (known) do not rule them out."""
    u, v = (known.select(F.col("fp").alias(side), *(F.col(c).alias(f"{c}_{side}") for c in known.columns if c != "fp")) for side in "uv")
    both = tally.join(u, "u").join(v, "v")
    e = F.greatest("e_u", "e_v")
    words = [F.when(F.col(f"e_{x}") == e, F.col(f"m_{x}")).otherwise(F.col(f"wider_{x}")) for x in "uv"]
    total = F.col("size_u") + F.col("size_v")
    sure = F.greatest(*words) - F.floor(total * ((1 - similarity) / (1 + similarity)) + 1e-6)
    enough = F.col("n") >= F.greatest(F.lit(1), F.least(F.lit(TALLY), sure))
    return both.where(enough & _may("u", "v", similarity, lambda side, k: F.get(f"bits_{side}", F.lit(k)))).select("u", "v")


def _mixed_postings(rows: DataFrame, joined: DataFrame, turn: int) -> DataFrame:
    """(word, fp, c, main) for the postings of rows (word, fp) whose sets are in several components (node, component).

    c is a set's component, main the one that most sets of the posting are in; which of several is drawn anew each turn.
    """
    named = rows.join(joined, F.col("fp") == F.col("node"), "left").select("word", "fp", F.coalesce("component", "fp").alias("c"))
    sizes = named.groupBy("word", "c").agg(F.count(F.lit(1)).alias("n"))
    most = F.max(F.struct("n", F.xxhash64("c", F.lit(turn)), "c"))
    mixed = sizes.groupBy("word").agg(F.count(F.lit(1)).alias("parts"), most.getField("c").alias("main"))
    return named.join(mixed.where("parts > 1").select("word", "main"), "word")


def _guided(named: DataFrame, known: DataFrame, similarity: float, turn: int) -> DataFrame:
    """(u, v): each set of a posting (word, fp, c, main) outside its main component with one guide of that, if sketches (known) leave any.

    A posting's guide is the first of its main component in an order of all sets. There are GUIDES orders, words are dealt
    to them, and they change each turn: so near copies meet few guides, however many words they share, but several.
    """
    order = F.xxhash64("fp", F.pmod("word", F.lit(GUIDES)), F.lit(turn))
    guides = named.where("c = main").groupBy("word").agg(F.min(F.struct(order.alias("order"), "fp")).getField("fp").alias("guide"))
    met = named.where("c <> main").join(guides, "word").select("fp", "main", "guide").distinct()
    x, y = (known.select(F.col("fp").alias(name), *(F.col(c).alias(f"{c}_{name}") for c in ("size", "ones", "bits"))) for name in ("fp", "guide"))
    may = _may("fp", "guide", similarity, lambda side, k: F.get(f"bits_{side}", F.lit(k)))
    one = met.join(x, "fp").join(y, "guide").where(may).groupBy("fp", "main").agg(F.min("guide").alias("guide"))
    return one.select(F.greatest("fp", "guide").alias("u"), F.least("fp", "guide").alias("v")).distinct()


def _apart(named: DataFrame, similarity: float) -> DataFrame:
    """(u, v) for all sets of a posting (word, fp, c, main, low) that are not in one component (c) and may be similar enough.

    One of a pair is not in the posting's main component, so those alone meet all others. Pairs that
    sizes and sketches (size, ones, b0, b1, ...) rule out do not leave the join, and the others leave it at their least
    common word only: where both lists of first words (low) hold a lesser one, that one's posting gives the pair. Words
    beyond the lists may give a pair again.
    """
    x, y = (named.select("word", *(F.col(c).alias(f"{c}_{side}") for c in named.columns if c != "word")) for side in "xy")
    apart = (F.col("c_x") != F.col("c_y")) & (F.col("c_y").eqNullSafe(F.col("main_y")) | (F.col("fp_x") < F.col("fp_y")))
    apart = apart & _may("x", "y", similarity, lambda side, k: F.col(f"b{k}_{side}"))
    apart = apart & F.coalesce(F.array_min(F.array_intersect("low_x", "low_y")) >= F.col("word_x"), F.lit(True))
    x = x.withColumn("word_x", F.col("word"))
    return x.where("c_x <> main_x").join(y, "word").where(apart).select(F.greatest("fp_x", "fp_y").alias("u"), F.least("fp_x", "fp_y").alias("v"))


def _may(a: str, b: str, similarity: float, bits: Callable[[str, int], Column]) -> Column:
    """Whether sizes (size_a, size_b) and sketches leave it open that two sets are similar enough.

    A bit that only one side has is at least one member that only it has, and of those a similar pair has few; ones_a
    and ones_b are the sketches' numbers of bits.
    """
    sizes = [F.col(f"size_{side}") for side in (a, b)]
    shared = (sizes[0] + sizes[1]) * (similarity / (1 + similarity)) - 1e-6
    both = _sum([F.bit_count(bits(a, k).bitwiseAND(bits(b, k))) for k in range(SKETCH // 64)])
    in_reach = F.least(*sizes) >= F.greatest(*sizes) * similarity - 1e-6
    return in_reach & (both >= F.greatest(*(F.col(f"ones_{side}") - size + shared for side, size in zip((a, b), sizes))))


def _sum(terms: list[Column]) -> Column:
    """The terms' sum, added up in pairs, which keeps the expression shallow."""
    while len(terms) > 1:
        terms = [reduce(lambda x, y: x + y, terms[k : k + 2]) for k in range(0, len(terms), 2)]
    return terms[0]


def similar_links(docs: DataFrame, prints: DataFrame, counters: DataFrame, classes: DataFrame, id_col: str, text_col: str, shingle: int, similarity: float) -> DataFrame:
    """Edges (u, v) that connect all sets of shingles that are similar enough.

    First each posting's members meet its head only. Whoever that connects need not meet again, so near copies,
    however many, cost a pair a member. Where heads are far from most, as in a wide cloud of near copies, guides from
    the largest components connect the others, a pair a member each turn. Then the members of a posting that are still
    not connected to its largest component meet all of it that they are not connected to, so no link depends on heads
    or guides; a pair is made once, whatever the number of words that it shares.
    """
    spark = docs.sparkSession
    posted = postings(docs, text_col, shingle, similarity, added_up(counters))
    index = materialize(met(posted), "postings")
    known = prints.groupBy("fp").agg(*(F.first(c).alias(c) for c in ("size", "e", "m", "wider", "bits")))
    known = materialize(known.withColumn("ones", F.aggregate("bits", F.lit(0), lambda n, x: n + F.bit_count(x))), "known")
    row = classes.select("fp", F.col("row.none").alias("_none"), F.coalesce("row.id", F.lit(0)).alias("_id"), F.col("row.same").alias("_same"))
    number = F.col(id_col).cast("long")
    text = F.col(text_col).cast("binary")
    texts = docs.select(number.isNull().alias("_none"), F.coalesce(number, F.lit(0)).alias("_id"), F.xxhash64(text).alias("_same"), text.alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            members = [shingles(None if not t.is_valid else t.as_py(), shingle).tobytes() for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(members, pa.binary())], names=["fp", "members"])

    def verified(candidates: DataFrame, name: str) -> DataFrame:
        pairs = materialize(candidates, "pairs")
        wanted = pairs.select(F.col("u").alias("fp")).union(pairs.select(F.col("v").alias("fp"))).distinct().join(row, "fp")
        sets = materialize(texts.join(wanted, ["_none", "_id", "_same"]).select("fp", "text").dropDuplicates(["fp"]).mapInArrow(run, "fp long, members binary"), "sets")
        found = materialize(_similar(pairs, sets, similarity), name)
        drop_tables(spark, [pairs, sets])
        return found

    tally = index.where("fp <> head").groupBy(F.col("fp").alias("u"), F.col("head").alias("v")).agg(F.count(F.lit(1)).alias("n"))
    found = verified(retained(tally, known, similarity), "stars")
    edges, named = found, index
    for turn in range(TURNS + 1):
        joined = materialize(components(edges), "joined")
        drop_tables(spark, [found] + [edges] * (turn > 0))
        rows, named = named, materialize(_mixed_postings(named.select("word", "fp"), joined, turn), "mixed")
        drop_tables(spark, [rows])
        if turn == TURNS:
            break
        found = verified(_guided(named, known, similarity, turn), "guided")
        if found.isEmpty():
            break
        edges = materialize(joined.select(F.col("node").alias("u"), F.col("component").alias("v")).where("u <> v").union(found), "connected")
        drop_tables(spark, [joined])
    lists = named.groupBy("fp").agg(F.slice(F.array_sort(F.collect_list("word")), 1, LOW).alias("low"))
    about = known.join(lists, "fp").select("fp", "low", "size", "ones", *(F.get("bits", F.lit(k)).alias(f"b{k}") for k in range(SKETCH // 64)))
    rest = verified(_apart(named.join(about, "fp"), similarity).distinct(), "rest")
    drop_tables(spark, [known, named])
    return joined.select(F.col("node").alias("u"), F.col("component").alias("v")).where("u <> v").union(rest)


def _key(fp: str, positions: tuple[int, ...]) -> Column:
    """The bytes of a fingerprint at some positions, the others zero."""
    mask = sum(0xFF << 8 * p for p in positions)
    return F.col(fp).bitwiseAND(F.lit(mask - (1 << 64) if mask >> 63 else mask))


def _postings(rows: DataFrame, sets: list[tuple[int, ...]]) -> DataFrame:
    """rows (fp, ...) once for each set of positions, with those as a bit mask and the bytes there as the key."""
    posted = [F.struct(F.lit(sum(1 << p for p in s)).alias("positions"), _key("fp", s).alias("key")) for s in sets]
    return rows.withColumn("_p", F.explode(F.array(*posted))).select(*rows.columns, "_p.positions", "_p.key")


def links(classes: DataFrame) -> DataFrame:
    """Edges (u, v) of all fingerprints at most MAX_BITS apart; classes: (fp), distinct.

    What meets in a posting agrees in four or six bytes, so however many fingerprints there are, chance meetings
    are few; members of a hot posting meet again only where they share two bytes more. Of these at least 2^48
    different keys none can hold more than 2^16 fingerprints.
    """
    posted = _postings(classes.select("fp"), list(SETS))
    sizes = posted.groupBy("positions", "key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    posted = materialize(posted.join(sizes, ["positions", "key"]), "postings")
    hot, split = posted.where(F.col("n") > HOT), []
    for s in SETS:
        wider = [tuple(sorted((*s, *more))) for more in combinations(sorted(set(range(8)) - set(s)), 2)]
        split.append(_postings(hot.where(F.col("positions") == sum(1 << p for p in s)).select("fp"), wider))
    met = posted.where(F.col("n") <= HOT).select("fp", "positions", "key")
    if not hot.isEmpty():
        met = met.union(reduce(DataFrame.union, split).select("fp", "positions", "key").distinct())
    pairs = met.select("positions", "key", F.col("fp").alias("u")).join(met.select("positions", "key", F.col("fp").alias("v")), ["positions", "key"]).where("u < v")
    tally = pairs.groupBy("u", "v").agg(F.bit_count(F.bit_or("positions")).alias("shared"))
    retained = tally.where(F.col("shared") >= 8 - MAX_BITS)
    return retained.where(F.bit_count(F.col("u").bitwiseXOR(F.col("v"))) <= MAX_BITS).select("u", "v")


def labelled(prints: DataFrame, edges: Callable[[DataFrame], DataFrame] = links) -> DataFrame:
    """(fp, component, component_id, row): the component of each fingerprint of prints (id, same, fp).

    component is its least fingerprint, component_id its least id, row (none, id, same) the first row of the
    fingerprint: ids before none, then by id and by same. Equal fingerprints are one row before any join.
    """
    first = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "same")).alias("row")
    classes = materialize(prints.groupBy("fp").agg(F.min("id").alias("first"), first), "classes")
    found = least_names(classes, "fp", "first", edges(classes)).withColumnRenamed("node", "fp")
    return classes.join(found, "fp", "left").select(
        "fp", F.coalesce("component", "fp").alias("component"), F.coalesce("name", "first").alias("component_id"), "row"
    )


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fp, component_id): one row per row of docs.

    component_id is the smallest id reachable by links, itself included. Null, empty and blank texts have
    fingerprint zero and link like any other. Rows with equal ids stay separate rows, linked only if their texts
    are; rows with a null id take part, but give no component its name: a component of such rows only has
    component_id null. An empty table gives an empty result. Texts of any length are read whole. Other columns,
    whatever their names, are not read. Equal texts meet in one class before anything is compared.
    """
    prints = materialize(fingerprints(docs, id_col, text_col), "fingerprints")
    return spread_join(prints, labelled(prints).select("fp", "component_id"), ["fp"], ["id", "same"]).select("id", "fp", "component_id")


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(_doc, _none, _id, _same): rows as structs, with a key of each row's id and text that has no nulls, so that the partitions of joins serve later steps, too."""
    number = F.col(id_col).cast("long")
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_doc")
    return docs.select(whole, number.isNull().alias("_none"), F.coalesce(number, F.lit(0)).alias("_id"), F.xxhash64(F.col(text_col).cast("binary")).alias("_same"))


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, similarity: float | None = None) -> DataFrame:
    """docs with one document of each component: the one with the smallest id.

    Fingerprints are linked within MAX_BITS, as in op1, or, given a similarity, texts whose sets of shingles of
    so many words have at least that Jaccard index. Of several rows with that id, one with the smallest hash of its
    text stays, and of rows equal in both, any one. A component without any id keeps one row in the same way. Null,
    empty and blank texts are alike, so one of them stays. Texts of any length are read whole; an empty table gives an
    empty result; all columns come through as they are, whatever their names. Texts are shuffled once; given a
    similarity, those that share a word with others, also to be verified.
    """
    if similarity is None:
        if shingle != SHINGLE:
            raise ValueError("fingerprints within MAX_BITS have shingles of SHINGLE words")
        classes = labelled(materialize(fingerprints(docs, id_col, text_col), "fingerprints"))
    else:
        made = materialize(wide_fingerprints(docs, id_col, text_col, shingle, similarity), "fingerprints")
        prints = made.where("counters is null")
        classes = labelled(prints, lambda found: similar_links(docs, prints, made.where("counters is not null"), found, id_col, text_col, shingle, similarity))
    kept = classes.groupBy("component").agg(F.min("row").alias("row")).select("row.*")
    key = ["_none", "_id", "_same"]
    kept = kept.select(F.col("none").alias("_none"), F.coalesce("id", F.lit(0)).alias("_id"), F.col("same").alias("_same"))
    return _keyed(docs, id_col, text_col).join(kept, key, "left_semi").dropDuplicates(key).select("_doc.*")


def op1(docs: DataFrame) -> DataFrame:
    found = near_duplicates(docs)
    return found.select(F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
