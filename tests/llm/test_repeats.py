import random
import re

import numpy as np
import pytest
from llm_odd import ODD

from keelson.llm import repeats


def plain(texts, ids, least):
    places = {}
    for k, t in enumerate(texts):
        words = [w for w in re.split(r"[\x20\x09-\x0D]+", t or "") if w]
        for j in range(len(words) - least + 1):
            places.setdefault(tuple(words[j : j + least]), []).append((k, j))
    covered = {}
    for own in places.values():
        if len(own) > 1:
            for k, j in own:
                covered.setdefault(k, set()).add(j)
    out = set()
    for k, firsts in covered.items():
        run = None
        for j in sorted(firsts):
            if run and j <= run[1]:
                run[1] = j + least
            else:
                if run:
                    out.add((ids[k], *run))
                run = [j, j + least]
        out.add((ids[k], *run))
    return out


def corpus(seed):
    rng = random.Random(seed)
    words = [f"w{k}" for k in range(60)] + ["é", "漢"]
    passages = [rng.choices(words, k=rng.choice([40, 49, 50, 51, 80, 130])) for _ in range(8)]
    texts = list(ODD)
    for _ in range(70):
        own = rng.choices(words, k=rng.randrange(120))
        for _ in range(rng.randrange(3)):
            p = rng.choice(passages)
            a, b = sorted((rng.randrange(len(p) + 1), rng.randrange(len(p) + 1)))
            own[rng.randrange(len(own) + 1) : 0] = p if rng.random() < 0.5 else p[a:b]
        texts.append(rng.choice([" ", "\n", "\t "]).join(own))
    return texts + texts[12:18]


@pytest.mark.parametrize("seed, filtered", [(1, 10**9), (2, -1)])
def test_against_brute_force(spark, docs, seed, filtered):
    texts = corpus(seed)
    rows = repeats.find_repeats(docs(texts), most_filtered=filtered).collect()
    expected = plain(texts, list(range(len(texts))), 50)
    assert {(r["doc_id"], r["first_word"], r["end_word"]) for r in rows} == expected and len(rows) == len(expected) > 20
    assert all(r["n_words"] == r["end_word"] - r["first_word"] >= 50 for r in rows)


def test_other_lengths(spark, docs):
    texts = corpus(3)
    rows = repeats.find_repeats(docs(texts), least=12, prefix=5).collect()
    assert {(r["doc_id"], r["first_word"], r["end_word"]) for r in rows} == plain(texts, list(range(len(texts))), 12)


def test_sliding_extremes():
    rng = np.random.default_rng(1)
    for n, size in ((50, 1), (50, 7), (50, 26), (26, 26), (300, 26)):
        x = rng.integers(0, 1 << 62, n).astype(np.uint64)
        view = np.lib.stride_tricks.sliding_window_view(x, size)
        assert (repeats._sliding(x, size) == view.min(axis=1)).all() and (repeats._sliding(x, size, np.maximum) == view.max(axis=1)).all()
        chosen = repeats._sliding(x, size)
        assert sorted(repeats._retained(x, chosen, size).tolist()) == sorted({int(v) for v in view.min(axis=1)})


def test_nulls_and_rows_of_one_id(spark, docs):
    p = " ".join(f"p{k}" for k in range(60))
    rows = repeats.find_repeats(docs([p, p, "other " * 3, p + " x"], [None, None, 5, 5])).collect()
    assert sorted((str(r["doc_id"]), r["first_word"], r["end_word"]) for r in rows) == [("5", 0, 60), ("None", 0, 60)]
    assert repeats.find_repeats(docs([p, None, ""])).count() == 0 and repeats.find_repeats(docs([])).count() == 0
    clash = docs([p, p]).withColumnRenamed("lang", "key").withColumnRenamed("source", "first")
    assert repeats.find_repeats(clash).count() == 2


def test_cut_leaves_the_source(spark, docs):
    p = " ".join(f"p{k}" for k in range(60))
    made = docs(["before " + p, "head\n" + p + "\ntail end", "nothing shared here"])
    found = {r["doc_id"]: r["text"] for r in repeats.cut_repeats(made).collect()}
    assert found == {0: "before " + p, 1: "head\ntail end", 2: "nothing shared here"}
    assert repeats.cut_repeats(made).schema == made.schema


def test_words_that_collide_under_polynomial_hashes_differ(spark, docs):
    morse = "a"
    while len(morse) < 2048:
        morse += morse.translate(str.maketrans("ab", "ba"))
    other = morse.translate(str.maketrans("ab", "ba"))
    before, after = " ".join(f"p{k}" for k in range(30)), " ".join(f"q{k}" for k in range(30))
    assert repeats._word_hashes(morse.encode())[0] == repeats._word_hashes(other.encode())[0]
    assert repeats.find_repeats(docs([f"{before} {morse} {after}", f"{before} {other} {after}"])).count() == 0


def test_a_farther_suffix_with_a_longer_left_match(spark, docs):
    rng = random.Random(5)
    core, texts = [f"c{k}" for k in range(30)], []
    for _ in range(60):  # what precedes and what follows the core is shared in all combinations
        left, right = rng.choice("xyz"), rng.choice("uvw")
        texts.append(" ".join([f"own{len(texts)}", *[f"{left}{k}" for k in range(25 - rng.randrange(25), 25)], *core, *[f"{right}{k}" for k in range(rng.randrange(30))]]))
    rows = repeats.find_repeats(docs(texts)).collect()
    assert {(r["doc_id"], r["first_word"], r["end_word"]) for r in rows} == plain(texts, list(range(len(texts))), 50)
    assert len(rows) > 20


def test_cut_leaves_one_of_many(spark, docs):
    rng = random.Random(6)
    p = " ".join(f"p{k}" for k in range(60))
    ids = rng.sample(range(100), 30)
    made = docs([f"before{k} {p} behind{k}" for k in ids], ids).withColumnRenamed("lang", "_row")
    found = {r["doc_id"]: r["text"] for r in repeats.cut_repeats(made).collect()}
    assert [k for k in sorted(ids) if p in found[k]] == [min(ids)]
    assert all(found[k] == f"before{k}\nbehind{k}" for k in ids if k != min(ids))
