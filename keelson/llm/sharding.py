"""Sharding by balanced label propagation.

Documents of equal text are linked. Each document starts in a shard by its hash; then, in rounds of
joins, the linked documents of a shard move to the shard that holds most of their neighbours, as far
as that shard's quota of rows has room, the best-connected first. In the end every shard takes the
documents with its label up to its quota, and the rest, with the unlinked documents, fills what is
left, so that shards differ by one row at most.

Groups of a larger part of a shard, of which there are few, are placed before the rounds: the largest
first, each whole into the fullest shard that has room for it, and one that fits nowhere into the
fewest shards. The rounds fill what room they leave.

Built-in functions only. Linked documents of one group and shard move alike, so the rounds join counts
by group and shard.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keelson.llm.common import Scratch, parts, ranked

SHARDS, ROUNDS = 16, 4
#: Groups over this part of a shard are placed before the rounds: fewer than SHARDS * PART.
PART = 64
#: Rows of groups broadcast at most; beyond it, the join is shuffled.
MOST_BROADCAST = 500_000
_LEVELS = 64


def _rows(docs: DataFrame, shards: int) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    return docs.select(
        "doc_id", (F.octet_length(text) + 1).cast("bigint").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"),
        F.xxhash64(text).alias("a"), F.xxhash64(F.lit(1), text).alias("b"), F.monotonically_increasing_id().alias("at"),
    ).withColumn("first", F.pmod(F.xxhash64("doc_id", "a"), F.lit(shards)).cast("int"))


def _propagate(linked: DataFrame, quota: list[int], rounds: int, scratch: Scratch) -> DataFrame:
    """(a, b, first, label): where the linked documents that began in shard `first` end up."""
    shards, unit = len(quota), ["a", "b"]
    state = scratch.save(linked.groupBy(*unit, "first").agg(F.count(F.lit(1)).alias("n")).withColumn("label", F.col("first")), "labels")
    for _ in range(rounds):
        held = state.groupBy(*unit, "label").agg(F.sum("n").alias("n"))
        # ties go by hash, so that they spread over the shards
        best = held.groupBy(*unit).agg(F.max(F.struct("n", F.xxhash64("a", "b", "label").alias("tie"), "label")).alias("best"))
        wish = state.join(best.select(*unit, F.col("best.label").alias("to"), F.col("best.n").alias("gain")), unit)
        level = F.least(F.floor(F.log2(F.col("gain"))), F.lit(_LEVELS - 1)).cast("int")
        wish = scratch.save(wish.withColumn("level", level), "wishes")
        load, leaving, asked = [0] * shards, [0] * shards, {}
        # at most shards * shards * _LEVELS rows
        for r in wish.groupBy("label", "to", "level").agg(F.sum("n").alias("n")).collect():
            load[r["label"]] += r["n"]
            if r["label"] != r["to"]:
                leaving[r["label"]] += r["n"]
                asked[r["to"], r["level"]] = asked.get((r["to"], r["level"]), 0) + r["n"]
        if not asked:
            scratch.drop(wish)
            break
        chance = [0.0] * (shards * _LEVELS)
        for to in range(shards):
            room = max(0, quota[to] - load[to] + leaving[to])
            for k in reversed(range(_LEVELS)):
                n = asked.get((to, k), 0)
                if n:
                    chance[to * _LEVELS + k] = min(1.0, room / n)
                    room = max(0, room - n)
        chances = F.array(*[F.lit(x) for x in chance])
        draw = F.pmod(F.xxhash64("b", "a"), F.lit(1 << 20)) / float(1 << 20)  # a group's documents move together
        moved = F.when(draw < F.get(chances, F.col("to") * _LEVELS + F.col("level")), F.col("to")).otherwise(F.col("label"))
        after = scratch.save(wish.select(*unit, "first", "n", moved.alias("label")), "labels")
        scratch.drop(state, wish)
        state = after
    return state.select(*unit, "first", "label")


def _place(groups: list[tuple[int, int, int]], room: list[int]) -> list[tuple[int, int, list[int], list[int], list[int]]]:
    """(a, b, ends, shards, slots) of groups (a, b, n): rows up to ends[k] of a group go to shards[k], the first of them to slots[k]. Takes from room."""
    full, out = list(room), []
    for a, b, n in sorted(groups, key=lambda g: (-g[2], g[0], g[1])):
        end, ends, into, slots = 0, [], [], []
        while end < n:
            fits = [s for s in range(len(room)) if room[s] >= n - end]
            s = min(fits, key=lambda s: room[s]) if fits else max(range(len(room)), key=lambda s: room[s])
            taken = min(n - end, room[s])
            end += taken
            ends.append(end)
            into.append(s)
            slots.append(full[s] - room[s])
            room[s] -= taken
        out.append((a, b, ends, into, slots))
    return out


def assign_shards(docs: DataFrame, shards: int = SHARDS, rounds: int = ROUNDS) -> DataFrame:
    """doc_id, size, text_crc32, law ('rows'), shard, slot and grown_shard (null) of every row of docs.

    size is UTF-8 bytes of the text plus 1; slot numbers a shard's rows from 0. A null text counts as
    empty, and equal to an empty one; repeated rows are linked rows of their own; null ids are placed
    like others; with fewer rows than shards some shards are empty; other columns are ignored.
    """
    scratch = Scratch(docs.sparkSession, "shards")
    salts = parts(docs.sparkSession)
    rows = scratch.save(_rows(docs, shards), "rows")
    total = rows.count()
    quota = [total // shards + (s < total % shards) for s in range(shards)]
    groups = scratch.save(rows.groupBy("a", "b").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "groups")
    known = F.broadcast(groups) if groups.count() <= MOST_BROADCAST else groups
    joined = scratch.save(rows.join(known, ["a", "b"], "left"), "joined")
    scratch.drop(rows)
    floor = total // shards // PART
    large = [(r["a"], r["b"], r["n"]) for r in groups.where(F.col("n") > floor).collect()]  # fewer than shards * PART, or than half the rows of a tiny table
    room = list(quota)
    schema = "a bigint, b bigint, ends array<bigint>, shards array<int>, slots array<bigint>"
    places = docs.sparkSession.createDataFrame(_place(large, room), schema)
    taken, quota = [q - r for q, r in zip(quota, room)], room
    # any order of a group's rows will do; they are numbered by salts
    inside = ranked(joined.where(F.col("n") > floor), ["a", "b"], ["at"], salts).join(F.broadcast(places), ["a", "b"])
    at = F.size(F.filter("ends", lambda x: x <= F.col("rank")))
    start = F.when(at > 0, F.get("ends", at - 1)).otherwise(0)
    placed = inside.select("doc_id", "size", "text_crc32", F.get("shards", at).alias("shard"), (F.get("slots", at) + F.col("rank") - start).alias("slot"))

    linked = joined.where(F.col("n") <= floor)
    labels = _propagate(linked, quota, rounds, scratch)
    labels = F.broadcast(labels) if labels.count() <= MOST_BROADCAST else labels
    alone = joined.where("n IS NULL").withColumn("label", F.lit(shards))
    labelled = scratch.save(linked.join(labels, ["a", "b", "first"]).select(*alone.columns).unionByName(alone), "labelled")

    count = dict.fromkeys(range(shards + 1), 0) | {r["label"]: r["n"] for r in labelled.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    own = [min(count[s], quota[s]) for s in range(shards)]  # rows that stay where their label says
    spill, free = [0], [0]  # running sums: rows of earlier labels that must go elsewhere; open places of earlier shards
    for s in range(shards):
        spill.append(spill[-1] + count[s] - own[s])
        free.append(free[-1] + quota[s] - own[s])
    # a group's rows follow each other, so that what spills over a quota splits few groups
    numbered = ranked(labelled, ["label"], ["a", "b", "at"], salts, together=["a", "b"])
    listed = lambda xs: F.array(*[F.lit(x).cast("bigint") for x in xs])
    stays = F.col("rank") < F.get(listed([*own, 0]), F.col("label"))
    place = F.get(listed(spill), F.col("label")) + F.col("rank") - F.get(listed([*own, 0]), F.col("label"))
    numbered = numbered.withColumn("place", place)
    into = (F.size(F.filter(listed(free), lambda x: x <= F.col("place"))) - 1).cast("int")
    numbered = numbered.withColumn("into", into)
    shard = F.when(stays, F.col("label")).otherwise(F.col("into"))
    slot = F.when(stays, F.col("rank")).otherwise(F.get(listed([*own, 0]), F.col("into")) + F.col("place") - F.get(listed(free), F.col("into")))
    rest = numbered.select("doc_id", "size", "text_crc32", shard.cast("int").alias("shard"), slot.alias("slot")).withColumn("slot", F.col("slot") + F.get(listed(taken), F.col("shard")))
    return placed.unionByName(rest).select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", F.col("slot").cast("bigint").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
