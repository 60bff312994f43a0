import re
import zlib

import pytest
from llm_odd import ODD

from keelson.llm import sharding


def check(rows, texts, shards):
    n = len(texts)
    assert len(rows) == n
    by = {}
    for r in rows:
        by.setdefault(r["shard"], []).append(r["slot"])
        assert r["law"] == "rows" and r["grown_shard"] is None and 0 <= r["shard"] < shards
    assert sorted(len(by.get(s, [])) for s in range(shards)) == sorted(n // shards + (s < n % shards) for s in range(shards))
    assert all(sorted(own) == list(range(len(own))) for own in by.values())


def test_sizes_and_checksums(spark, docs):
    texts = [*ODD, "", None, "x" * 5000]
    rows = {r["doc_id"]: r for r in sharding.assign_shards(docs(texts)).collect()}
    check(list(rows.values()), texts, 16)
    for k, t in enumerate(texts):
        data = (t or "").encode()
        assert (rows[k]["size"], rows[k]["text_crc32"]) == (len(data) + 1, zlib.crc32(data))


@pytest.mark.parametrize("groups, singles", [([2] * 60 + [5] * 20 + [15] * 6, 300), ([400, 3, 3, 2], 300), ([1000], 0), ([3] * 200, 0)])
def test_groups_stay_together_as_far_as_quotas_allow(spark, docs, groups, singles):
    texts = [f"group {g}" for g, n in enumerate(groups) for _ in range(n)] + [f"single {k}" for k in range(singles)]
    rows = sharding.assign_shards(docs(texts)).collect()
    check(rows, texts, 16)
    quota = -(-len(texts) // 16)
    spread = {}
    for r in rows:
        spread.setdefault(texts[r["doc_id"]], set()).add(r["shard"])
    small = [g for g, n in enumerate(groups) if n <= quota // 8]
    whole = sum(len(spread[f"group {g}"]) == 1 for g in small)
    assert whole >= 0.85 * len(small)
    if singles == 300 and len(groups) > 10:
        assert whole == len(small)


def test_odd_tables_and_no_python(spark, docs):
    assert sharding.assign_shards(docs([])).count() == 0
    three = docs(["a", "a", None], [None, None, None]).withColumnRenamed("lang", "label").withColumnRenamed("source", "part")
    check(sharding.assign_shards(three).collect(), ["a"] * 3, 16)
    plan = sharding.assign_shards(docs(["a"]))._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow|Cartesian", plan)


def test_shuffled_joins_give_a_right_result_too(spark, docs, monkeypatch):
    monkeypatch.setattr(sharding, "MOST_BROADCAST", -1)
    texts = [f"g{k % 40}" for k in range(200)]
    check(sharding.assign_shards(docs(texts)).collect(), texts, 16)
