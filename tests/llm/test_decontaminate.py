import hashlib
import random
import re

import pytest
from llm_odd import ODD

from keelson.llm.decontaminate import find_contamination, remove_contaminated

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def low(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


def plain(texts, items):
    windows = {}
    for item, text in items:
        words = WORD.findall(low(text))
        for k in range(max(1, len(words) - 9) if words else 0):
            windows.setdefault(tuple(words[k : k + 10]), set()).add(item)
    sizes = {len(w) for w in windows}
    out = []
    for text in texts:
        words = WORD.findall(low(text))
        hit, own = set(), set()
        for size in sizes:
            for k in range(len(words) - size + 1):
                if (w := tuple(words[k : k + size])) in windows:
                    hit |= set(range(k, k + size))
                    own |= windows[w]
        ids = sorted(str(x) for x in own if x is not None)
        out.append((len(words), len(hit), len(ids), hashlib.sha256(",".join(ids).encode()).hexdigest(), bool(hit)))
    return out


@pytest.mark.parametrize("block_bytes", [4 << 20, 300])
def test_against_brute_force(spark, docs, block_bytes):
    rng = random.Random(2)
    words = [f"w{k}" for k in range(30)] + ["É", "ñandú", "X9"]
    items = [(k, " ".join(rng.choices(words, k=rng.choice([0, 3, 9, 10, 11, 25])))) for k in range(25)] + [(90, None), (91, "..."), (None, " ".join(words[:12])), (3, "Again THE same id, here")]
    texts = list(ODD)
    for _ in range(40):
        own = rng.choices(words, k=rng.randrange(40))
        for _ in range(rng.randrange(3)):
            item = WORD.findall(rng.choice(items)[1] or "")
            k = rng.randrange(len(item) + 1)
            own[rng.randrange(len(own) + 1) :] = [w.upper() if rng.random() < 0.3 else w for w in item[k : k + rng.randrange(1, 15)]] + rng.choices(words, k=3)
        texts.append(rng.choice([" ", ", ", "-\n"]).join(own))
    benchmark = spark.createDataFrame(items, "item_id bigint, text string")
    rows = {r["doc_id"]: r for r in find_contamination(docs(texts), benchmark, block_bytes=block_bytes).collect()}
    expected = plain(texts, items)
    assert [tuple(rows[k][c] for c in ("n_words", "n_hit", "n_items", "items_sha256", "contaminated")) for k in range(len(texts))] == expected
    assert any(x[1] for x in expected) and not all(x[1] for x in expected)
    for k, text in enumerate(texts):  # the places hold just the hit words
        assert sum(len(WORD.findall(low(text[s["start"] : s["end"]]))) for s in rows[k]["spans"]) == expected[k][1]
    kept = remove_contaminated(docs(texts), benchmark, block_bytes=block_bytes)
    assert sorted(r["doc_id"] for r in kept.collect()) == [k for k, x in enumerate(expected) if not x[4]]
    assert kept.schema == docs([]).schema


def test_empty_sides(spark, docs):
    none = spark.createDataFrame([], "item_id bigint, text string")
    assert [r["n_hit"] for r in find_contamination(docs(["a b c"]), none).collect()] == [0]
    some = spark.createDataFrame([(1, "a")], "item_id bigint, text string")
    assert find_contamination(docs([]), some).count() == 0
    clash = docs(["a b", None], [None, None]).withColumnRenamed("lang", "items").withColumnRenamed("source", "spans")
    assert sorted(r["n_hit"] for r in find_contamination(clash, some).collect()) == [0, 1]
    assert remove_contaminated(clash, some).count() == 1
