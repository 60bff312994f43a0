from test_sharding import check

from keelson.llm import sharding


def spread_of(spark, docs, groups, singles):
    texts = [f"group {g}" for g, n in enumerate(groups) for _ in range(n)] + [f"single {k}" for k in range(singles)]
    rows = sharding.assign_shards(docs(texts)).collect()
    check(rows, texts, 16)
    spread = {}
    for r in rows:
        spread.setdefault(texts[r["doc_id"]], set()).add(r["shard"])
    return [len(spread[f"group {g}"]) for g in range(len(groups))]


def test_groups_that_fit_a_shard_stay_whole(spark, docs):
    groups = [90] * 10 + [40] * 12 + [13] * 6  # a shard has 100 rows
    assert spread_of(spark, docs, groups, 1600 - sum(groups)) == [1] * len(groups)


def test_larger_groups_take_the_fewest_shards(spark, docs):
    assert spread_of(spark, docs, [533, 40, 2], 1600 - 575) == [6, 1, 1]


def test_few_rows_and_many_partitions_keep_links(spark, docs):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "300")
    try:
        assert spread_of(spark, docs, [2] * 8 + [3, 7], 174) == [1] * 10
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
