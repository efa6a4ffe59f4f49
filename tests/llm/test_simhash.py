import itertools
import random

import xxhash
from pyspark.sql import functions as F

from tessera.llm import simhash
from tessera.llm.common import components


def plain_print(text):
    words = [w for w in "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in (text or "").translate({c: " " for c in [*range(9, 14)]})).split(" ") if w]
    if not words:
        return 0
    grams = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] if len(words) >= 3 else [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute(rows):
    """(fingerprint, component) of each (id, text), comparing all with all."""
    prints = [plain_print(t) for _, t in rows]
    parent = list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, j in itertools.combinations(range(len(rows)), 2):
        if (prints[i] ^ prints[j]).bit_count() <= 2:
            parent[find(i)] = find(j)
    least = {}
    for k, (i, _) in enumerate(rows):
        if i is not None:
            least[find(k)] = min(least.get(find(k), i), i)
    return sorted((-1 if i is None else i, f"{p:016x}", least.get(find(k))) for k, ((i, _), p) in enumerate(zip(rows, prints)))


def test_against_brute_force(spark, docs, monkeypatch):
    monkeypatch.setattr(simhash, "HOT", 3)  # so that postings are split further
    rng = random.Random(3)
    words = [f"w{k}" for k in range(300)]
    base = [" ".join(rng.choices(words, k=60)) for _ in range(12)]
    rows = []
    for b in base:
        for _ in range(8):
            own = b.split()
            own[rng.randrange(60)] = rng.choice(words)
            rows.append(" ".join(own) if rng.random() < 0.7 else b.upper())
    rows += ["", None, " \t\n", "one", "one two", "Été été été", "a\u00a0b c d", base[0], base[0]]
    rows = [(k, t) for k, t in enumerate(rows)] + [(5, rows[5]), (None, base[1]), (None, "alone here now")]
    df = docs(rows).withColumn("fp", F.lit(1)).withColumn("id", F.lit("x"))  # names that the operator uses inside
    got = sorted((-1 if r["doc_id"] is None else r["doc_id"], r["fingerprint"], r["component_id"]) for r in simhash.op1(df).collect())
    assert got == brute(rows)


def test_tally_of_shared_positions():
    """Sets among six or more shared positions add up to these; among fewer they stay below six."""
    for n in range(9):
        for shared in itertools.combinations(range(8), n):
            met = set().union(*(s for s in simhash.SETS if set(s) <= set(shared)))
            assert met == set(shared) if n >= 6 else len(met) < 6


def test_links_of_planted_fingerprints(spark, monkeypatch):
    rng = random.Random(9)
    prints = {rng.getrandbits(64) for _ in range(100)}
    for base in list(prints)[:20]:
        prints |= {base ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)) for _ in range(6)}
        prints |= {base ^ rng.getrandbits(16) << 8 * rng.randrange(7) for _ in range(6)}
    dense = rng.getrandbits(64)
    prints |= {dense ^ (b & 15) ^ (b >> 4) << 40 for b in range(256)}
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    want = {(min(a, b), max(a, b)) for a, b in itertools.combinations(signed, 2) if ((a ^ b) % (1 << 64)).bit_count() <= 2}
    for hot in (1 << 20, 16):
        monkeypatch.setattr(simhash, "HOT", hot)
        found = simhash.links(spark.createDataFrame([(p,) for p in signed], "fp long")).collect()
        assert len(found) == len(want) and {(r["u"], r["v"]) for r in found} == want


def test_long_text_and_empty_table(spark, docs):
    long = " ".join(f"w{k % 977}" for k in range(70_000))
    assert simhash.fingerprint(long.encode()) % (1 << 64) == plain_print(long)
    assert simhash.op1(docs([])).count() == 0


def test_dedup_keeps_the_smallest(spark, docs):
    text = " ".join(f"w{k}" for k in range(50))
    df = docs([(7, text), (3, text), (3, text), (9, "something else entirely here")])
    kept = simhash.dedup(df)
    assert kept.columns == df.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == [3, 9]


def test_dedup_keeps_what_has_no_id_or_shares_one(spark, docs):
    df = docs([(None, "alone without an id here"), (None, "alone without an id here"), (4, "one text of this id"), (4, "one text of this id"), (4, "quite another one of the same id"), (None, None)])
    kept = simhash.dedup(df)
    assert sorted((r["doc_id"] is None, str(r["text"])) for r in kept.collect()) == [
        (False, "one text of this id"),
        (False, "quite another one of the same id"),
        (True, "None"),
        (True, "alone without an id here"),
    ]


def test_components_of_a_chain(spark):
    edges = spark.createDataFrame([(i + 1, i) for i in range(200)] + [(500, 400), (400, 500), (7, 7), (None, 3)], "u long, v long")
    found = {r["node"]: r["component"] for r in components(edges).collect()}
    assert found == {**{i: 0 for i in range(201)}, 400: 400, 500: 400}


def similar_components(rows, shingle, similarity):
    """The smallest id of each component of (id, text) rows, comparing all sets with all."""
    sets = []
    for _, t in rows:
        words = (t or "").lower().split()
        sets.append({" ".join(words[i : i + shingle]) for i in range(max(1, len(words) - shingle + 1))} if words else {""})
    parent = list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, j in itertools.combinations(range(len(rows)), 2):
        shared = len(sets[i] & sets[j])
        if shared >= similarity * len(sets[i] | sets[j]):
            a, b = find(i), find(j)
            parent[max(a, b)] = min(a, b)
    return {rows[find(i)][0] for i in range(len(rows))}


def test_dedup_by_similarity_against_brute_force(spark, docs):
    rng = random.Random(11)
    words = [f"w{k}" for k in range(2000)]
    texts = ["", None, " \t", "one two", "One  TWO", "one two three four five six"]
    for size in (12, 60, 120, 127, 128, 200, 255, 260, 700, 1500):
        base = rng.choices(words, k=size)
        texts.append(" ".join(base))
        for share in (0.005, 0.01, 0.02, 0.03, 0.05):  # about 45 of 2000 words changed give a similarity of 0.8
            own = list(base)
            for _ in range(max(1, round(share * size))):
                own[rng.randrange(size)] = rng.choice(words)
            texts.append(" ".join(own))
        texts += [" ".join(base[: int(size * 0.83)]), " ".join(base + rng.choices(words, k=int(size * 0.2)))]
    rows = list(enumerate(texts))
    kept = simhash.dedup(docs(rows), shingle=5, similarity=0.8)
    got = {r["doc_id"] for r in kept.collect()}
    assert got == similar_components(rows, 5, 0.8)
    assert len(got) < len({r["component_id"] for r in simhash.op1(docs(rows)).collect()})


def test_a_pair_leaves_the_join_once(spark, docs, monkeypatch):
    """However many words two texts share that no head connects, the join on words gives them once."""
    rng = random.Random(7)
    base = [f"p{k}" for k in range(160)]
    texts = []
    for k in range(60):
        own = list(base)
        for j in range(2 + k % 3):
            own[(53 * j + rng.randrange(50)) % 160] = f"own{k}x{j}"
        texts.append(" ".join(own))
    rows, met, apart = list(enumerate(texts)), [], simhash._apart

    def counted(*args):
        found = apart(*args)
        met.extend(tuple(r) for r in found.select("u", "v").collect())
        return found

    monkeypatch.setattr(simhash, "_apart", counted)
    kept = {r["doc_id"] for r in simhash.dedup(docs(rows), shingle=5, similarity=0.8).collect()}
    assert kept == similar_components(rows, 5, 0.8)
    assert met and len(met) == len(set(met))


def test_a_cloud_of_near_copies_is_connected_without_its_pairs(spark, docs, monkeypatch):
    """Texts around one base, some of them too far from all others: the join on words gives two pairs a text at most, not all links."""
    rng = random.Random(5)
    base = [f"p{k}" for k in range(150)]
    texts = []
    for k in range(240):
        own = list(base)
        for j in range(1 + k % 6):
            own[rng.randrange(150)] = f"own{k}x{j}"
        texts.append(" ".join(own))
    rows, met, apart = list(enumerate(texts)), [], simhash._apart

    def counted(*args):
        found = apart(*args)
        met.extend(tuple(r) for r in found.select("u", "v").collect())
        return found

    monkeypatch.setattr(simhash, "_apart", counted)
    kept = {r["doc_id"] for r in simhash.dedup(docs(rows), shingle=5, similarity=0.8).collect()}
    assert kept == similar_components(rows, 5, 0.8) and len(kept) > 1
    assert len(met) <= 2 * len(rows)
