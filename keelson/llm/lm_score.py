"""Language-model scoring by cross-entropy difference.

Two bigram models, one of labelled good documents and one of all documents, share the vocabulary of a
public tokenizer. A token's probability is weight * n(before, token) / n(before) + (1 - weight) * share(token)
where the history `before` was seen, and share(token) alone where it wasn't; share mixes the unigram estimate with
the uniform one. So the probabilities of every history sum to 1 over the vocabulary, and the models are matched: a
token that neither has seen costs the same in both, whatever their sizes. A document's score is the mean over its
tokens of the target's loss less the background's: the lower, the more it is like the target.

A target document is scored by the rest of the target: its own tokens are taken from the target's counts first. Else
it would look like the target for being in it. The background is the whole corpus for every document, itself included,
so documents of the target and others stand alike.

Everything is counted over all documents. Encoded documents form blocks of some HELD tokens; the distinct bigrams
of a block are joined with the counts by key, and a block meets its documents again in one task. So nothing that
grows with the corpus reaches the driver or is broadcast, and a task holds a block.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keelson.llm.common import Scratch, utf8
from keelson.llm.tokens import encoder, vocabulary_size, word_vocabulary

#: Weight of bigrams, and of the uniform estimate among the unigrams.
WEIGHT, UNIFORM = 0.6, 0.1
#: Tokens of a block; a longer document is a block of its own.
HELD = 1_000_000
#: Labelled ids broadcast at most; beyond it, the join is shuffled.
MOST_BROADCAST = 1_000_000


def _width(size: int) -> str:
    """Ids of a small vocabulary are kept in two bytes."""
    return "<u2" if size <= 1 << 16 else "<u4"


def _bigrams(packed: bytes, size: int) -> np.ndarray:
    """Keys before * size + id of a document's tokens; before the first one is `size`."""
    ids = np.frombuffer(packed, _width(size)).astype(np.int64)
    before = np.empty_like(ids)
    if len(ids):
        before[0] = size
        before[1:] = ids[:-1]
    return before * size + ids


def shares(counts: np.ndarray, total: np.ndarray | float, size: int, uniform: float = UNIFORM) -> np.ndarray:
    """Unigram estimates of counts; without any token, the uniform ones."""
    known = np.asarray(total) > 0
    return np.where(known, (1 - uniform) * counts / np.where(known, total, 1) + uniform / size, 1 / size)


def chances(seen: np.ndarray, before: np.ndarray, share: np.ndarray, weight: float = WEIGHT) -> np.ndarray:
    """Probabilities of tokens seen so often after histories seen so often, with these unigram estimates."""
    known = before > 0
    return np.where(known, weight * seen / np.where(known, before, 1) + (1 - weight) * share, share)


def encode(docs: DataFrame, tokenizer: str, size: int, held: int = HELD) -> DataFrame:
    """block, doc_id, is_target and ids (packed) of docs(doc_id, text, is_target)."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, filled = TaskContext.get().partitionId() << 32, 0
        for batch in batches:
            ids = encoder(tokenizer).encode(utf8(batch.column(1)))
            blocks = []
            for x in ids:
                if filled and filled + len(x) // 4 > held:
                    block, filled = block + 1, 0
                blocks.append(block)
                filled += len(x) // 4 + 1  # empty documents count, too
            ids = [np.frombuffer(x, "<u4").astype(_width(size)).tobytes() for x in ids]
            yield pa.RecordBatch.from_arrays([pa.array(blocks, pa.int64()), batch.column(0), batch.column(2), pa.array(ids, pa.binary())], ["block", "doc_id", "is_target", "ids"])

    return docs.select("doc_id", "text", "is_target").mapInArrow(run, f"block bigint, doc_id {kind}, is_target boolean, ids binary")


def tally(encoded: DataFrame, size: int) -> DataFrame:
    """block, key, n, n_target: a row for each distinct bigram of a block (or of the part of it that a task reads)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, aims, now = [], [], None

        def made() -> pa.RecordBatch:
            keys = np.concatenate(held)
            target = np.repeat(np.array(aims), [len(x) for x in held])
            keys, at, counts = np.unique(keys, return_inverse=True, return_counts=True)
            aimed = np.bincount(at, weights=target, minlength=len(keys)).astype(np.int64)
            return pa.RecordBatch.from_arrays([pa.array(np.full(len(keys), now)), pa.array(keys), pa.array(counts.astype(np.int64)), pa.array(aimed)], ["block", "key", "n", "n_target"])

        for batch in batches:
            for block, packed, aim in zip(*(batch.column(k).to_pylist() for k in range(3))):
                if block != now and held:
                    yield made()
                    held, aims = [], []
                now = block
                if packed:
                    held.append(_bigrams(packed, size))
                    aims.append(bool(aim))
        if held:
            yield made()

    return encoded.select("block", "ids", "is_target").mapInArrow(run, "block bigint, key bigint, n bigint, n_target bigint")


def totals(counts: DataFrame, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Counts (background, target) by token, and by history: as many rows as the vocabulary has, whatever the corpus."""
    own, before = np.zeros((size, 2)), np.zeros((size + 1, 2))
    for into, key in ((own, F.col("key") % size), (before, F.expr(f"key div {size}"))):
        for r in counts.groupBy(key.alias("id")).agg(F.sum("n").alias("n"), F.sum("n_target").alias("t")).toLocalIterator():
            into[r["id"]] = r["n"], r["t"]
    return own, before


def _score_block(packed: list[bytes], aims: np.ndarray, keys: np.ndarray, counts: np.ndarray, own: np.ndarray, before: np.ndarray, weight: float, uniform: float) -> tuple[np.ndarray, np.ndarray]:
    """Tokens, and sums of loss differences, of the documents of a block; keys are sorted, counts (background, target) go with them."""
    size = len(own)
    grams = [_bigrams(x, size) for x in packed]
    lengths = np.array([len(x) for x in grams], np.int64)
    if not lengths.sum():
        return lengths, np.zeros(len(lengths))
    doc = np.repeat(np.arange(len(grams)), lengths)
    # a bigram counts once a document, with the number of its tokens there
    pairs, n = np.unique(doc * (size * (size + 1)) + np.concatenate(grams), return_counts=True)
    doc, key = (pairs // (size * (size + 1))).astype(np.int32), pairs % (size * (size + 1))
    del pairs, grams
    token, history = (key % size).astype(np.int32), (key // size).astype(np.int32)

    def of_document(value: np.ndarray, span: int) -> np.ndarray:
        groups, at = np.unique(doc.astype(np.int64) * span + value, return_inverse=True)
        return np.bincount(at, weights=n, minlength=len(groups))[at]

    seen = counts[np.searchsorted(keys, key)].astype(np.float64)
    worth = np.zeros(len(key))
    own_token, own_history, total = of_document(token, size), of_document(history, size + 1), own.sum(axis=0)
    for model, sign in ((1, 1.0), (0, -1.0)):
        out = aims[doc] * model  # whether the document's own tokens are taken out
        share = shares(own[token, model] - out * own_token, total[model] - out * lengths[doc], size, uniform)
        worth -= sign * np.log(chances(seen[:, model] - out * n, before[history, model] - out * own_history, share, weight))
    return lengths, np.bincount(doc, weights=n * worth, minlength=len(lengths))


def score(docs: DataFrame, labels: DataFrame, tokenizer: str | None = None, weight: float = WEIGHT, uniform: float = UNIFORM, held: int = HELD) -> DataFrame:
    """doc_id, n_tokens and score (mean loss difference a token, null without tokens) of each row of docs.

    The target is every row of docs whose doc_id has quality 1 in labels, the background all rows; a row
    of the target is scored without its own tokens there. A null or empty text has no tokens; a doc_id that labels list twice
    counts once; null ids are in no target; repeated rows are counted and scored each, and each still counts
    for the others; texts count whole, however long: a text is held by one task. Without any target row, the
    target's estimates are flat. Equal texts of one standing score the same. An empty table gives no rows.
    Other columns are ignored.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "lm")
    tokenizer = tokenizer or word_vocabulary()
    size = vocabulary_size(tokenizer)
    good = labels.where("quality = 1 AND doc_id IS NOT NULL").select("doc_id").distinct().withColumn("is_target", F.lit(True))
    small = good.count() <= MOST_BROADCAST
    marked = docs.select("doc_id", "text").join(F.broadcast(good) if small else good, "doc_id", "left")
    encoded = scratch.save(encode(marked, tokenizer, size, held), "ids")  # tokenised once
    tallies = scratch.save(tally(encoded, size), "tallies")
    counts = scratch.save(tallies.groupBy("key").agg(F.sum("n").alias("n"), F.sum("n_target").alias("n_target")), "bigrams")
    own, before = totals(counts, size)
    sent = spark.sparkContext.broadcast((own, before))
    known = tallies.select("block", "key").join(counts, "key").select("block", "key", "n", "n_target")
    kind = docs.schema["doc_id"].dataType.simpleString()

    def scored(rows: pa.Table, grams: pa.Table) -> pa.Table:
        own, before = sent.value
        keys, first = np.unique(grams.column("key").to_numpy(), return_index=True)
        counts = np.stack([grams.column(c).to_numpy() for c in ("n", "n_target")], axis=1)[first]
        aims = np.array([bool(x) for x in rows.column("is_target").to_pylist()], np.float64)
        lengths, sums = _score_block(rows.column("ids").to_pylist(), aims, keys, counts, own, before, weight, uniform)
        return pa.table({"doc_id": rows.column("doc_id"), "n_tokens": pa.array(lengths), "total": pa.array(sums)})

    found = encoded.groupBy("block").cogroup(known.groupBy("block")).applyInArrow(scored, f"doc_id {kind}, n_tokens bigint, total double")
    return found.select("doc_id", "n_tokens", F.when(F.col("n_tokens") > 0, F.col("total") / F.col("n_tokens")).alias("score"))
