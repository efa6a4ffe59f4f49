import random
import zlib

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from tessera.llm import packing

PATH = public_tokenizers.path("byte_bpe_50k.json")


def test_ids_equal_tokenizers():
    slow = Tokenizer.from_file(PATH)
    rng = random.Random(1)
    chars = "abc ABC  \n\t'sré—日本語\U0001f600 0123.,!?\u00a0\u200b\ufeff½Ⅷ\u0301"
    texts = ["", " ", "it's we'll", "a<|endoftext|>b", "x" * 3000, *("".join(rng.choices(chars, k=rng.randrange(1, 200))) for _ in range(400))]
    assert [packing.encode(t, PATH) for t in texts] == [slow.encode(t, add_special_tokens=False).ids for t in texts]


def best_fit_decreasing(sizes, capacity):
    rooms = []
    for s in sorted(sizes, reverse=True):
        fitting = [k for k, r in enumerate(rooms) if r >= s]
        if fitting:
            rooms[min(fitting, key=lambda k: rooms[k])] -= s
        else:
            rooms.append(capacity - s)
    return len(rooms)


def test_round_trip_and_fit(spark, docs):
    rng = random.Random(2)
    texts = [" ".join(rng.choices(["alpha", "beta", "gamma!", "été"], k=rng.choice([1, 5, 80, 700, 3000]))) for _ in range(120)] + ["", None, "", "dup", "dup"]
    rows = list(enumerate(texts)) + [(3, texts[3]), (None, "no id")]
    got = packing.op10(docs(rows)).collect()
    slow = Tokenizer.from_file(PATH)
    want = []
    for i, t in rows:
        ids = [*slow.encode(t or "", add_special_tokens=False).ids, 0]
        cut = [len(ids) % 2048] if len(ids) % 2048 else []
        at = 0
        for k, n in enumerate(cut + [2048] * (len(ids) // 2048)):
            want.append((str(i), k, at, n, zlib.crc32(np.array(ids[at : at + n], "<u4").tobytes())))
            at += n
    assert sorted((str(r["doc_id"]), r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got) == sorted(want)
    bins = {}
    for r in got:
        bins.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for own in bins.values():
        end = 0
        for at, n in sorted(own):
            assert at == end
            end += n
        assert end <= 2048
    assert len(bins) <= best_fit_decreasing([w[3] for w in want], 2048)
    assert packing.op10(docs([])).count() == 0


def test_two_fit_replaces_the_smallest():
    # greedy takes 6 + 3; 3 gives way to 2 + 2, which leaves no room
    assert packing.two_fit({6: 1, 3: 1, 2: 2}, 10) == [({6: 1, 2: 2}, 1), ({3: 1}, 1)]
    assert sum(n for _, n in packing.two_fit({5: 1000}, 10)) == 500
    used = packing.two_fit({k: 7 for k in range(1, 101)}, 100)
    total = {}
    for b, n in used:
        assert sum(k * v for k, v in b.items()) <= 100
        for k, v in b.items():
            total[k] = total.get(k, 0) + v * n
    assert total == {k: 7 for k in range(1, 101)}
