import random
import zlib

import numpy as np
import pytest
from llm_odd import ODD

from keelson.llm.packing import RoomTree, pack, plan, sequences
from keelson.llm.tokens import encoder, word_vocabulary


def test_tree_finds_the_least_room_that_holds():
    rng, tree, open_at = random.Random(1), RoomTree(100), {}
    for _ in range(800):
        room = rng.randrange(1, 101)
        if rng.random() < 0.6:
            open_at[room] = open_at.get(room, 0) + 1
            tree.add(room, 1)
        elif open_at.get(room):
            open_at[room] -= 1
            tree.add(room, -1)
        length = rng.randrange(1, 101)
        assert tree.tightest(length) == min((r for r, n in open_at.items() if n and r >= length), default=None)


def one_by_one(lengths, capacity):
    """Best-fit decreasing, a piece at a time: how full each sequence is."""
    rooms = []
    for n in sorted(lengths, reverse=True):
        fits = [(r, k) for k, r in enumerate(rooms) if r >= n]
        if fits:
            rooms[min(fits)[1]] -= n
        else:
            rooms.append(capacity - n)
    return sorted(capacity - r for r in rooms)


@pytest.mark.parametrize("seed", range(6))
def test_runs_fill_sequences_as_best_fit_decreasing_does(seed):
    rng = random.Random(seed)
    capacity = rng.choice([10, 64, 200])
    lengths = [rng.randrange(1, capacity + 1) if rng.random() < 0.6 else rng.choice([1, capacity // 3, capacity]) for _ in range(400)]
    histogram = {n: lengths.count(n) for n in set(lengths)}
    made = plan(histogram, capacity)
    used, placed = {}, 0
    runs = list(zip(made["length"], made["rank"], made["per"], made["first"], made["offset"]))
    for k, (n, rank, per, first, offset) in enumerate(runs):
        end = runs[k + 1][1] if k + 1 < len(runs) and runs[k + 1][0] == n else histogram[n]
        for j in range(end - rank):
            at = offset + (j % per) * n
            used.setdefault(first + j // per, []).append((at, at + n))
            placed += 1
    assert placed == len(lengths) and len(used) == made["sequences"]
    for spans in used.values():
        spans.sort()
        assert spans[0][0] == 0 and all(a[1] == b[0] for a, b in zip(spans, spans[1:])) and spans[-1][1] <= capacity
    assert sorted(s[-1][1] for s in used.values()) == one_by_one(lengths, capacity)


def whole_ids(text):
    e = encoder(word_vocabulary())
    return [*e._tokenizer.encode(text or "", add_special_tokens=False).ids, 0]


def test_words_encode_as_whole_texts_do():
    e = encoder(word_vocabulary())
    texts = [x or "" for x in ODD] + ["Don't stop... it's **x** <|endoftext|> 3.14! naïve\x1cé", "a.b, c,. d., 'll 've"]
    assert [np.frombuffer(x, "<u4").tolist() for x in e.encode([t.encode() for t in texts])] == [whole_ids(t)[:-1] for t in texts]


def test_memory_may_overflow():
    from keelson.llm.tokens import WordEncoder

    e = WordEncoder(word_vocabulary(), limit=5)
    texts = [f"alpha beta{k} gamma." for k in range(20)]
    assert [np.frombuffer(x, "<u4").tolist() for x in e.encode([t.encode() for t in texts])] == [whole_ids(t)[:-1] for t in texts]


def test_pieces_cover_every_document(spark, docs):
    texts = [*ODD, *ODD[-2:], None]
    rows = pack(docs(texts, [*range(len(texts) - 1), None]), with_ids=True).collect()
    by_doc = {}
    for r in rows:
        by_doc.setdefault(r["doc_id"], []).append(r)
        assert 1 <= r["length"] <= 2048 and r["ids_crc32"] == zlib.crc32(np.array(r["ids"], "<u4").tobytes())
    for k, text in enumerate(texts):
        own = sorted(by_doc[k if k < len(texts) - 1 else None], key=lambda r: r["piece"])
        assert [r["piece"] for r in own] == list(range(len(own))) and all(r["length"] == 2048 for r in own[:-1])
        assert [i for r in own for i in r["ids"]] == whole_ids(text)
        assert [r["start"] for r in own] == [2048 * k for k in range(len(own))]
    places = {}
    for r in rows:
        places.setdefault(r["sequence_id"], []).append((r["offset"], r["offset"] + r["length"]))
    for spans in places.values():
        spans.sort()
        assert spans[0][0] == 0 and all(a[1] == b[0] for a, b in zip(spans, spans[1:])) and spans[-1][1] <= 2048
    assert len(places) == len(one_by_one([r["length"] for r in rows], 2048))


def test_sequences_hold_the_ids(spark, docs):
    packed = pack(docs(["one two", "three", None]), with_ids=True)
    made = sequences(packed).collect()
    assert len(made) == 1 and sorted(made[0]["ids"]) == sorted(whole_ids("one two") + whole_ids("three") + [0])


def test_repeated_rows_and_an_empty_table(spark, docs):
    same = docs(["equal text here"] * 50, [7] * 50)
    rows = pack(same).collect()
    assert len(rows) == 50 and len({(r["sequence_id"], r["offset"]) for r in rows}) == 50
    assert pack(same.where("false")).count() == 0
    assert pack(same.withColumn("length", same.n_chars).withColumn("rank", same.n_chars)).count() == 50
