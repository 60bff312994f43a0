import random

import pytest
import xxhash
from llm_odd import ODD

from keelson.llm.common import Scratch
from keelson.llm.simhash import _keys, fingerprint, keep_one, links, near_duplicates


def plain_fingerprint(text):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").translate({9: 32, 10: 32, 11: 32, 12: 32, 13: 32}).split(" ")
    words = [w for w in words if w]
    if not words:
        return 0
    shingles = [" ".join(words[k : k + 3]) for k in range(len(words) - 2)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_fingerprints_by_bits():
    for text in [*ODD, "The Cat sat on THE mat. " * 3, "Éa É a b c d"]:
        assert fingerprint((text or "").encode()) & (1 << 64) - 1 == plain_fingerprint(text)


def components(prints):
    root = list(range(len(prints)))

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for i in range(len(prints)):
        for j in range(i):
            if ((prints[i] ^ prints[j]) & (1 << 64) - 1).bit_count() <= 2:
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return [find(k) for k in range(len(prints))]


@pytest.mark.parametrize("seed", [1, 2])
def test_links_lose_no_pair(spark, seed):
    rng = random.Random(seed)
    prints = []
    for _ in range(12):  # families of neighbours, some crowded, some chains
        p = rng.getrandbits(64)
        for _ in range(rng.choice([1, 2, 3, 30])):
            prints.append(p)
            for b in rng.sample(range(64), rng.choice([1, 2, 3])):
                p ^= 1 << b
            if rng.random() < 0.7:
                p = prints[-1] ^ (1 << rng.randrange(64))
    prints = list(dict.fromkeys(prints))
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    df = spark.createDataFrame([(p,) for p in signed], "fp bigint")
    assert _keys(df).count() == 33 * len(prints)
    edges = {(r["u"], r["v"]) for r in links(df, Scratch(spark, "t")).collect()}
    assert all(((u ^ v) & (1 << 64) - 1).bit_count() <= 2 for u, v in edges)
    at = {p: k for k, p in enumerate(signed)}
    root = list(range(len(prints)))

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for u, v in edges:
        a, b = sorted((find(at[u]), find(at[v])))
        root[b] = a
    assert [find(k) for k in range(len(prints))] == components(signed)


def test_every_row_gets_its_component(spark, docs):
    rng = random.Random(4)
    texts = list(ODD)
    for _ in range(6):
        words = [f"w{rng.randrange(400)}" for _ in range(120)]
        for _ in range(6):
            texts.append(" ".join(words))
            words = list(words)
            words[rng.randrange(120)] = f"w{rng.randrange(400)}"
    texts += texts[:8]
    rows = near_duplicates(docs(texts)).collect()
    prints = [plain_fingerprint(t) for t in texts]
    expected = components(prints)
    assert {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in rows} == {k: (f"{p:016x}", c) for k, (p, c) in enumerate(zip(prints, expected))}
    assert len(rows) == len(texts)


def test_nulls_repeats_and_empty_tables(spark, docs):
    rows = near_duplicates(docs(["a b c d", "a b c d", "q r s t u", None], [None, 5, None, 9])).collect()
    assert sorted((str(r["doc_id"]), str(r["component_id"])) for r in rows) == [("5", "5"), ("9", "9"), ("None", "5"), ("None", "None")]
    assert near_duplicates(docs([])).count() == 0
    more = docs(["a b c", "a b c"], [1, 1]).withColumnRenamed("lang", "fp").withColumnRenamed("source", "root")
    assert [r["component_id"] for r in near_duplicates(more).collect()] == [1, 1]


def test_keep_one(spark, docs):
    df = docs(["x y z w", "x y z w", "other words stand here", "x y z w", "other words stand here"], [3, 1, 7, 1, 9])
    kept = keep_one(df)
    assert kept.columns == df.columns and sorted(r["doc_id"] for r in kept.collect()) == [1, 7]
