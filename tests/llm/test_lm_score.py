import math
import random

import numpy as np
import pytest
from llm_odd import ODD

from keelson.llm.lm_score import chances, score, shares
from keelson.llm.tokens import encoder, vocabulary_size, word_vocabulary


def ids_of(text):
    return encoder(word_vocabulary())._tokenizer.encode(text or "", add_special_tokens=False).ids


def model(texts):
    """The probability of a token after a history, by lists of all tokens and pairs."""
    tokens, pairs, before = {}, {}, {}
    for ids in texts:
        for last, t in zip([None, *ids], ids):
            tokens[t] = tokens.get(t, 0) + 1
            before[last] = before.get(last, 0) + 1
            pairs[last, t] = pairs.get((last, t), 0) + 1
    total = sum(tokens.values())

    def of(last, t):
        alone = 0.9 * tokens.get(t, 0) / total + 0.1 / 49408 if total else 1 / 49408
        return 0.6 * pairs.get((last, t), 0) / before[last] + 0.4 * alone if last in before else alone

    return of


def plain(texts, aims):
    """Scores by models of all documents and of all other target documents, counted anew for each."""
    ids, out = [ids_of(t) for t in texts], []
    rest = model(ids)
    for k, own in enumerate(ids):
        target = model([x for j, x in enumerate(ids) if j != k and aims[j]])
        out.append((len(own), sum(math.log(rest(last, t) / target(last, t)) for last, t in zip([None, *own], own)) / len(own) if own else None))
    return out


def corpus():
    rng = random.Random(7)
    good, bad = [f"river{k} stone" for k in range(12)], [f"cheap{k} offer" for k in range(12)]
    texts = [" ".join(rng.choices(good if k % 2 else bad, k=30)) for k in range(60)]
    return texts + list(ODD) + texts[:3] + ["only here", "river once"]


@pytest.mark.parametrize("held", [10**9, 100])
def test_scores_by_brute_force(spark, docs, held):
    texts = corpus()
    labels = spark.createDataFrame([(k, k % 2, 0) for k in range(40)] + [(1, 1, 0), (None, 1, 0), (999, 1, 0)], "doc_id bigint, quality int, toxic int")
    rows = {r["doc_id"]: r for r in score(docs(texts), labels, held=held).collect()}
    assert len(rows) == len(texts)
    for k, (n, s) in enumerate(plain(texts, [k % 2 if k < 40 else 0 for k in range(len(texts))])):
        assert rows[k]["n_tokens"] == n
        assert rows[k]["score"] is None if s is None else math.isclose(rows[k]["score"], s, rel_tol=1e-9, abs_tol=1e-9)


def test_probabilities_of_a_history_sum_to_one():
    rng = np.random.default_rng(3)
    size = vocabulary_size(word_vocabulary())
    assert size == 49408
    own = rng.integers(0, 5, size).astype(float)
    share = shares(own, own.sum(), size)
    seen = np.zeros(size)
    seen[rng.integers(0, size, 40)] = 2
    for counts in (seen, np.zeros(size)):
        assert math.isclose(chances(counts, np.full(size, counts.sum()), share).sum(), 1, rel_tol=1e-12)


def test_held_out_documents_rank_right(spark, docs):
    texts = corpus()
    labels = spark.createDataFrame([(k, k % 2, 0) for k in range(40)], "doc_id bigint, quality int, toxic int")
    rows = {r["doc_id"]: r["score"] for r in score(docs(texts), labels).collect()}
    assert max(rows[k] for k in range(41, 60, 2)) < min(rows[k] for k in range(40, 60, 2))


def test_odd_tables(spark, docs):
    none = spark.createDataFrame([], "doc_id bigint, quality int, toxic int")
    assert score(docs([]), none).count() == 0
    rows = score(docs(["a b", "a b", None], [None, 3, 3]).withColumnRenamed("lang", "total").withColumnRenamed("source", "block"), none).collect()
    assert len(rows) == 3 and sorted(r["n_tokens"] for r in rows) == [0, 2, 2]
    assert len({r["score"] for r in rows}) == 2


def test_held_out_labels(spark):
    """Documents of good quality rank before bad ones that the target model has not seen labelled."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    held = {r["doc_id"]: r["quality"] for r in labels.where("doc_id % 2 = 1").collect()}
    rows = [(r["score"], held[r["doc_id"]]) for r in score(docs, labels.where("doc_id % 2 = 0")).collect() if r["doc_id"] in held and r["score"] is not None]
    good, bad = [s for s, q in rows if q], [s for s, q in rows if not q]
    assert sum(g < b for g in good for b in bad) > 0.95 * len(good) * len(bad)


def test_nothing_but_counts_by_token_is_broadcast(spark, docs):
    labels = spark.createDataFrame([(0, 1, 0)], "doc_id bigint, quality int, toxic int")
    plan = score(docs(["a b c", "a d"]), labels)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("InArrow") == 1 and "Cartesian" not in plan
