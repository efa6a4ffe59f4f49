import random
import zlib
from collections import defaultdict

from tessera.llm import sharding


def least_capacity(sizes, shards):
    """By trying every capacity that a run of groups can have."""
    for cap in sorted({sum(sizes[i:j]) for i in range(len(sizes)) for j in range(i + 1, len(sizes) + 1)}):
        n, room = 1, cap
        for s in sizes:
            if s > cap:
                n = shards + 1
                break
            if s > room:
                n, room = n + 1, cap
            room -= s
        if n <= shards:
            return cap


def test_minimax_against_brute_force(spark, monkeypatch):
    rng = random.Random(4)
    for first in (1, 4):
        monkeypatch.setattr(sharding, "FIRST_BITS", first)
        keys = sorted({rng.getrandbits(64) - 2**63 for _ in range(60)})
        sizes = [rng.choice([1, 5, 20, 300]) for _ in keys]
        groups = spark.createDataFrame(list(zip(keys, sizes)), "key long, bytes long")
        cuts = sharding.minimax_cuts(groups, 7)
        loads = defaultdict(int)
        for k, s in zip(keys, sizes):
            loads[sum(k >= c for c in cuts)] += s
        assert max(loads.values()) == least_capacity(sizes, 7)


def test_whole_result(spark, docs):
    texts = [f"text {k} " * (k % 30) for k in range(300)] + ["same"] * 150 + [None, None, "", ""]
    df = docs(list(enumerate(texts)) + [(3, texts[3]), (None, "no id")])
    got = sharding.op7(df).collect()
    assert len(got) == df.count()
    slots, shards = defaultdict(list), defaultdict(set)
    for r in got:
        slots[r["shard"]].append(r["slot"])
        shards[r["text_crc32"]].add(r["shard"])
        assert r["law"] == "bytes" and r["grown_shard"] is None and 0 <= r["shard"] < 40
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert all(len(s) == 1 for s in shards.values())
    by_id = {r["doc_id"]: r for r in got}
    assert by_id[17]["size"] == len(texts[17].encode()) + 16 and by_id[17]["text_crc32"] == zlib.crc32(texts[17].encode())
    assert by_id[450]["size"] == 16 and by_id[450]["text_crc32"] is None
    assert sharding.op7(docs([])).count() == 0
