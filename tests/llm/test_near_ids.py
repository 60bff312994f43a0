from keelson.llm import simhash


def test_shared_and_null_ids_lose_no_text(spark, docs):
    one, two, three, four = (" ".join(f"{x}{k}" for k in range(30)) for x in "abcd")
    df = docs([one, one, two, three, two + " more", four, four], [1, None, None, None, 7, 7, 7])
    kept = simhash.keep_one(df)
    assert kept.columns == df.columns
    assert sorted((str(r["doc_id"]), r["text"]) for r in kept.collect()) == [("1", one), ("7", two + " more"), ("7", four), ("None", three)]
    copies = docs([one, two, one], [1, 2, 2])
    assert sorted((r["doc_id"], r["text"]) for r in simhash.keep_one(copies).collect()) == [(1, one), (2, two)]
