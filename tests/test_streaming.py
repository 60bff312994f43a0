from keelson.config import ReadTracking
from keelson.operators import coaccess
from keelson.streaming.coaccess import CappedGraph, GraphSink, bounded, streaming_capped_edges, streaming_edges

T = ReadTracking(max_keys_per_session=4, max_pair_inserts_per_query=5)
QUERIES = [(k, [k % 5, (k * 3) % 7, (k * 5) % 11, k % 5, 20 + k % 2, 30]) for k in range(40)]


def feed(spark, path, rows, schema, files=4):
    for k in range(files):
        spark.createDataFrame(rows[k::files], schema).coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)


def edges(df):
    return {(r["a"], r["b"]): r["weight"] for r in df.collect()}


def expected(spark):
    df = spark.createDataFrame(QUERIES, "query_id bigint, keys array<bigint>")
    return edges(coaccess.edges(bounded(df, T).select("keys"), T))


def test_streamed_sums_equal_the_batch(spark, tmp_path):
    stream = feed(spark, str(tmp_path / "q"), QUERIES, "query_id bigint, keys array<bigint>")
    q = streaming_edges(stream, T).writeStream.outputMode("complete").format("memory").queryName("edges").option("checkpointLocation", str(tmp_path / "c")).start()
    q.processAllAvailable()
    q.stop()
    assert edges(spark.table("edges")) == expected(spark)


def test_sink_equals_the_batch_and_survives_replay(spark, tmp_path):
    stream = feed(spark, str(tmp_path / "q"), QUERIES, "query_id bigint, keys array<bigint>")
    sink = GraphSink(spark, str(tmp_path / "g"), T)
    q = stream.writeStream.foreachBatch(sink).option("checkpointLocation", str(tmp_path / "c")).start()
    q.processAllAvailable()
    q.stop()
    assert edges(sink.graph()) == expected(spark)
    sink(spark.createDataFrame(QUERIES, "query_id bigint, keys array<bigint>"), 0)
    assert edges(GraphSink(spark, str(tmp_path / "g"), T).graph()) == expected(spark)


def test_sink_decays_between_batches(spark, tmp_path):
    sink = GraphSink(spark, str(tmp_path / "g"), T, decay=0.5)
    batch = spark.createDataFrame([(0, [1, 2])], "query_id bigint, keys array<bigint>")
    for k in range(3):
        sink(batch, k)
    assert edges(sink.graph()) == {(1, 2): 1.75}


def test_capped_graph_in_state(spark, tmp_path):
    pairs = [(0, n, n % 9, 9 + n % 13, 1.0 + n % 3) for n in range(200)]
    schema = "graph_id bigint, seq bigint, a bigint, b bigint, weight double"
    for k in range(4):
        spark.createDataFrame(pairs[50 * k : 50 * k + 50], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "p"))
        import time

        time.sleep(0.05)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("latestFirst", "false").parquet(str(tmp_path / "p"))
    seen = []
    q = streaming_capped_edges(stream, 30).writeStream.outputMode("update").foreachBatch(lambda df, k: seen.append(edges(df))).option("checkpointLocation", str(tmp_path / "c")).start()
    q.processAllAvailable()
    q.stop()
    plain = CappedGraph(30)
    for _, _, a, b, w in pairs:
        plain.add(a, b, w)
    assert seen[-1] == plain.edges
