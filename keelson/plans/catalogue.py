"""One query per operator over the driver's tables, each with the same query in SQL where SQL can say it.

Mapping: the parts are the records of a store (key = p_partkey, payload = p_name), laid out 512 to a segment
in key order; an order is a read batch of its distinct parts; events are a log of user records whose
version is event_id and whose tombstones are errors.
"""

from __future__ import annotations

import dataclasses
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from keelson.config import PlannerConfig, ReadMergePolicy, ReadTracking, WorkloadSpec
from keelson.functions import codec, scalars
from keelson.functions import statistics as stats

from keelson.operators import coaccess, layout, planner, ranges, relocation, scheduler, versions
from keelson.operators.components import connected_components
from keelson.plans import harness, workload, workload_sql
from keelson.session import saved
from keelson.sources import manifest, segments

ROTATION, THRESHOLD, GROUP_KEYS = 512, 0.5, 8
POLICY = ReadMergePolicy(4096, 1 << 20)
CAPPED = ReadMergePolicy(4096, 600)
TRACKING = ReadTracking(max_keys_per_session=256, max_pair_inserts_per_query=4096)
PLANNER = PlannerConfig(max_keys_per_group=GROUP_KEYS, affinity_threshold=THRESHOLD, min_expected_gain=0.5, hysteresis_per_key=0.02)

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


# --- inputs -----------------------------------------------------------------------------------------


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def event_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    payload = F.col("props").cast("binary")
    return e.select(
        F.col("user_id").alias("key"), F.col("event_id").alias("version"), (F.col("event_type") == "error").cast("int").alias("flags"), payload.alias("payload"),
        (F.floor(F.col("event_id") / 1000) + 1).cast("bigint").alias("segment_id"), (F.col("event_id") % 1000).alias("offset"), scalars.record_size(F.length(payload)).alias("size"),
    )


def part_layout(spark: SparkSession, sf_dir: str) -> DataFrame:
    """key, segment_id, offset, size: p_partkey is dense from 0 and so is its own sequence number."""
    p = table(spark, sf_dir, "part")
    return layout.append(p.select(F.col("p_partkey").alias("key"), scalars.record_size(F.octet_length("p_name")).alias("size")), "key", ROTATION)


def part_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    rows = p.select(F.col("p_partkey").alias("key"), F.lit(1).cast("bigint").alias("version"), F.lit(0).alias("flags"), F.col("p_name").cast("binary").alias("payload"), scalars.record_size(F.octet_length("p_name")).alias("size"))
    return layout.append(rows, "key", ROTATION).select("key", "version", "flags", "payload", "segment_id", "offset", "size")


def order_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("batch_id"), F.col("l_partkey").alias("key")).distinct()


def part_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tracking makes a batch's keys distinct itself, so one shuffle by order is enough."""
    return coaccess.track(table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("batch_id"), F.col("l_partkey").alias("key")), TRACKING)


_LAYOUT = f"""
lay AS (SELECT key, segment_id, size, CAST(64 + coalesce(sum(size) OVER (PARTITION BY segment_id ORDER BY key ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS "offset"
        FROM (SELECT p_partkey AS key, 1 + p_partkey // {ROTATION} AS segment_id, CAST(36 + strlen(p_name) AS BIGINT) AS size FROM part))"""
_BATCHES = "bat AS (SELECT DISTINCT l_orderkey AS batch_id, l_partkey AS key FROM lineitem)"
_GRAPH = f"{_BATCHES}, edg AS (SELECT x.key AS a, y.key AS b, CAST(count(*) AS DOUBLE) AS weight FROM bat x JOIN bat y ON x.batch_id = y.batch_id AND x.key < y.key GROUP BY 1, 2)"
_LATEST = "ranked AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS rn FROM events)"


def _ranges_sql(policy: ReadMergePolicy = POLICY, layout_name: str = "lay") -> str:
    """Ranges by windows, right where no range can reach max_range_bytes."""
    return f"""
loc AS (SELECT batch_id, l.* FROM bat JOIN {layout_name} l USING (key)),
prv AS (SELECT *, max("offset" + size) OVER (PARTITION BY batch_id, segment_id ORDER BY "offset" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM loc),
ran AS (SELECT *, sum(CASE WHEN reach IS NULL OR "offset" - reach > {policy.max_read_gap_bytes} THEN 1 ELSE 0 END) OVER (PARTITION BY batch_id, segment_id ORDER BY "offset") AS range_id FROM prv),
rng AS (SELECT batch_id, segment_id, range_id, min("offset") AS "start", max("offset" + size) AS "end", count(*) AS records FROM ran GROUP BY 1, 2, 3)"""


# --- versions and lookups -----------------------------------------------------------------------------


@query(f"WITH {_LATEST} SELECT user_id AS key, event_id AS version, CAST(event_type = 'error' AS INT) AS flags, props AS payload FROM ranked WHERE rn = 1")
def latest_wins(spark, sf_dir):
    return versions.latest(event_log(spark, sf_dir)).select("key", "version", "flags", F.col("payload").cast("string").alias("payload"))


@query(f"WITH {_LATEST} SELECT user_id AS key, event_id AS version, props AS payload FROM ranked WHERE rn = 1 AND event_type <> 'error'")
def live_view(spark, sf_dir):
    return versions.live(event_log(spark, sf_dir)).select("key", "version", F.col("payload").cast("string").alias("payload"))


@query(f"WITH {_LATEST} SELECT (SELECT count(*) FROM events) AS records_verified, count(*) AS keys, count(*) FILTER (event_type <> 'error') AS live_keys, count(*) FILTER (event_type = 'error') AS tombstones FROM ranked WHERE rn = 1")
def replay_report(spark, sf_dir):
    return versions.replay_report(event_log(spark, sf_dir))


def _requests(spark, sf_dir):
    """Batches of eight requests over users, every fourth a miss, with duplicates."""
    e = table(spark, sf_dir, "events")
    key = F.when(F.col("event_id") % 4 == 3, F.col("user_id") + 1_000_000).otherwise(F.col("user_id"))
    return e.select(F.floor(F.col("event_id") / 8).cast("bigint").alias("batch_id"), (F.col("event_id") % 8).cast("int").alias("pos"), key.alias("key"))


_REQUESTS = "req AS (SELECT event_id // 8 AS batch_id, CAST(event_id % 8 AS INT) AS pos, CASE WHEN event_id % 4 = 3 THEN user_id + 1000000 ELSE user_id END AS key FROM events)"


@query(
    f"WITH {_LATEST}, {_REQUESTS} SELECT batch_id, pos, key, user_id IS NOT NULL AS found, CASE WHEN event_type <> 'error' THEN event_id END AS version, "
    "CASE WHEN event_type <> 'error' THEN props END AS payload FROM req LEFT JOIN (SELECT * FROM ranked WHERE rn = 1) ON user_id = key"
)
def get_many_ordered(spark, sf_dir):
    return versions.get_many(_requests(spark, sf_dir), event_log(spark, sf_dir)).withColumn("payload", F.col("payload").cast("string"))


@query(f"WITH {_LATEST} SELECT user_id AS key, event_id AS version, props AS payload FROM ranked WHERE rn = 1 AND event_type <> 'error' AND user_id = 7")
def point_get(spark, sf_dir):
    return versions.get(event_log(spark, sf_dir), 7).select("key", "version", F.col("payload").cast("string").alias("payload"))


@query(f"WITH {_LATEST} SELECT user_id AS key, event_id AS version, CAST(event_type = 'error' AS INT) AS flags FROM ranked WHERE rn = 1 AND user_id IN (SELECT o_custkey FROM orders)")
def select_live_records(spark, sf_dir):
    keys = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("key"))
    return versions.select_for_rewrite(event_log(spark, sf_dir), keys).select("key", "version", "flags")


@query(f"WITH {_LATEST} SELECT DISTINCT event_id // 1000 + 1 AS segment_id FROM ranked WHERE rn = 1 AND user_id IN (SELECT o_custkey FROM orders)")
def source_segments(spark, sf_dir):
    keys = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("key"))
    return versions.source_segments(versions.index(event_log(spark, sf_dir)), keys)


@query(f"WITH {_LATEST} SELECT DISTINCT event_id // 1000 + 1 AS segment_id FROM events WHERE event_id // 1000 + 1 NOT IN (SELECT event_id // 1000 + 1 FROM ranked WHERE rn = 1)")
def stale_segments(spark, sf_dir):
    log = event_log(spark, sf_dir)
    return versions.stale_segments(log.select("segment_id").distinct(), versions.index(log))


# --- layout and codec ---------------------------------------------------------------------------------


@query(f'WITH {_LAYOUT} SELECT key, segment_id, "offset", size, lpad(CAST(segment_id AS VARCHAR), 20, \'0\') || \'.seg\' AS file_name FROM lay')
def record_layout(spark, sf_dir):
    return part_layout(spark, sf_dir).withColumn("file_name", scalars.segment_file_name("segment_id"))


@query(f'WITH {_LAYOUT} SELECT key, "offset" // 65536 AS block, "offset" % 65536 AS within, ("offset" + size - 1) // 65536 - "offset" // 65536 + 1 AS blocks FROM lay')
def blocks_touched(spark, sf_dir):
    lay = part_layout(spark, sf_dir)
    return lay.select("key", scalars.block_index("offset").alias("block"), scalars.block_within("offset").alias("within"), scalars.blocks_touched("offset", "size").alias("blocks"))


@query(
    f'WITH {_LAYOUT}, hol AS (SELECT * FROM lay WHERE key % 100 <> 99), chk AS (SELECT segment_id, "offset", size, "offset" = coalesce(lag("offset" + size) OVER (PARTITION BY segment_id ORDER BY "offset"), 64) AS good FROM hol), '
    'pre AS (SELECT *, sum(CASE WHEN good THEN 0 ELSE 1 END) OVER (PARTITION BY segment_id ORDER BY "offset" ROWS UNBOUNDED PRECEDING) = 0 AS valid FROM chk) '
    'SELECT segment_id, bool_and(valid) AS contiguous, count(*) FILTER (valid) AS valid_prefix, coalesce(max("offset" + size) FILTER (valid), 64) AS "end" FROM pre GROUP BY 1'
)
def segment_contiguity(spark, sf_dir):
    return layout.contiguity(part_layout(spark, sf_dir).where("key % 100 <> 99"))


def _crc_sql(octets: str) -> str:
    """CRC-32 of a list of bytes; the table is made from its rule."""
    return f"xor(list_reduce(list_prepend(4294967295::BIGINT, {octets}), lambda c, x: xor(c >> 8, crc[(xor(c, x) & 255) + 1])), 4294967295::BIGINT)"


_CRC = "tab AS (SELECT list_transform(range(256), lambda i: list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384::BIGINT) ELSE c >> 1 END)) AS crc)"


def _octets(value: str, size: int) -> str:
    """A non-negative integer as a list of little-endian bytes."""
    return f"list_transform(range({size}), lambda i: CASE WHEN i < 8 THEN (({value})::BIGINT >> least(8 * i, 56)::INT) & 255 ELSE 0 END)"


_RECORD = f"rec AS (SELECT p_partkey AS key, strlen(p_name) AS n, list_transform(range(strlen(p_name)), lambda i: CAST('0x' || substr(hex(encode(p_name)), 2 * i + 1, 2) AS BIGINT)) AS data FROM part), body AS (SELECT key, n, list_concat(list_concat(list_concat({_octets('key', 16)}, {_octets('1', 8)}), list_concat({_octets('0', 4)}, {_octets('n', 4)})), data) AS octets FROM rec)"


@query(f"WITH {_CRC}, {_RECORD} SELECT key, true AS same_size, true AS same_key, 'ok' AS status, {_crc_sql('octets')} AS checksum FROM body, tab")
def crc_check(spark, sf_dir):
    """Every part as an encoded record, decoded again; statuses and sizes must agree."""
    rows = part_log(spark, sf_dir).withColumn("data", codec.encode(F.col("key"), F.col("version"), F.col("flags"), F.col("payload")))
    back = rows.select("key", "size", F.length("data").alias("bytes"), codec.decode(F.col("data")).alias("d"))
    return back.select("key", (F.col("size") == F.col("bytes")).alias("same_size"), (F.col("d.key") == F.col("key")).alias("same_key"), F.col("d.status").alias("status"), F.col("d.checksum").alias("checksum"))


@query(f"WITH {_CRC}, {_RECORD} SELECT key, CASE WHEN key % 3 = 1 THEN 'length' WHEN key % 7 <> 0 AND key % 5 = 2 THEN 'checksum' ELSE 'ok' END AS status, {_crc_sql('octets')} AS computed FROM body, tab")
def rewrite_status(spark, sf_dir):
    """Records of which some have a wrong length, some a wrong checksum and some none."""
    rows = part_log(spark, sf_dir).withColumn("computed", codec.checksum(F.col("key"), F.col("version"), F.col("flags"), F.col("payload")))
    stored = F.when(F.col("key") % 7 == 0, 0).when(F.col("key") % 5 == 2, F.col("computed") + 1).otherwise(F.col("computed"))
    length = F.length("payload") + F.when(F.col("key") % 3 == 1, 1).otherwise(0)
    return rows.select("key", codec.rewrite_status(F.col("payload"), length, stored, F.col("computed")).alias("status"), "computed")


_SEGMENT_ROWS = f'WITH {_LAYOUT}, lst AS (SELECT segment_id, max(key) AS last FROM lay GROUP BY 1) SELECT key, CAST(1 AS BIGINT) AS version, 0 AS flags, p_name AS payload, CAST(segment_id AS BIGINT) AS segment_id, "offset", size, {{healed}} AS healed FROM lay JOIN part ON p_partkey = key JOIN lst USING (segment_id) WHERE {{which}}'


def _segment_rows(images: DataFrame) -> DataFrame:
    return segments.parse_segments(images).select("key", "version", "flags", F.col("payload").cast("string").alias("payload"), "segment_id", "offset", "size", "healed")


@query(_SEGMENT_ROWS.format(healed="false", which="true"))
def segment_roundtrip(spark, sf_dir):
    """All parts as sealed segment files, read back by their footers."""
    return _segment_rows(segments.segment_images(part_log(spark, sf_dir)))


@query(_SEGMENT_ROWS.format(healed="true", which="key < last"))
def segment_recovery(spark, sf_dir):
    """The same files without their footer and the end of their last record: recovered by a scan up to the tear."""
    images = segments.segment_images(part_log(spark, sf_dir))
    footer = F.locate(segments.SegmentFormat().footer_magic.hex().upper(), F.hex("content"))
    torn = F.substring("content", F.lit(1), F.floor((footer - 1) / 2).cast("int") - 7)
    return _segment_rows(images.withColumn("content", torn).withColumn("length", F.length("content").cast("bigint")))


# --- range reads --------------------------------------------------------------------------------------


@query(f'WITH {_LAYOUT}, {_BATCHES}, {_ranges_sql()} SELECT batch_id, segment_id, "start", "end", records FROM rng')
def range_merge(spark, sf_dir):
    return ranges.merged_ranges(versions.locate(order_batches(spark, sf_dir), part_layout(spark, sf_dir)), ["batch_id"], POLICY)


_COUNTERS_SQL = f"""WITH {_LAYOUT}, {_BATCHES}, {_ranges_sql()},
per AS (SELECT batch_id, count(*) AS range_read_ops, sum("end" - "start") AS range_bytes_read, sum(records) AS records_in_ranges FROM rng GROUP BY 1),
seg AS (SELECT batch_id, segment_id, count(*) AS c, max("offset") - min("offset") AS span, sum(size) AS bytes FROM loc GROUP BY 1, 2),
tot AS (SELECT batch_id, count(*) AS file_opens, sum(span) AS offsets_span_total, sum(bytes) AS bytes_read, sum(c) AS n, sum(c * (c - 1) / 2.0) AS pairs FROM seg GROUP BY 1),
gap AS (SELECT batch_id, sum(CASE WHEN reach IS NOT NULL AND "offset" - reach <= {POLICY.max_read_gap_bytes} THEN greatest(0, "offset" - reach) ELSE 0 END) AS gap_bytes_merged FROM prv GROUP BY 1)
SELECT batch_id, CAST(file_opens AS BIGINT) AS file_opens, CAST(offsets_span_total AS BIGINT) AS offsets_span_total, CAST(bytes_read AS BIGINT) AS bytes_read, CAST(range_read_ops AS BIGINT) AS range_read_ops,
CAST(range_bytes_read AS BIGINT) AS range_bytes_read, CAST(records_in_ranges AS BIGINT) AS records_in_ranges, CAST(records_in_ranges - range_read_ops AS BIGINT) AS range_merges, CAST(gap_bytes_merged AS BIGINT) AS gap_bytes_merged,
round(CASE WHEN n < 2 THEN 0 ELSE pairs / (n * (n - 1) / 2.0) END, 9) AS colocated_pair_ratio
FROM per JOIN tot USING (batch_id) JOIN gap USING (batch_id)"""
_SHOWN = ("file_opens", "offsets_span_total", "bytes_read", "range_read_ops", "range_bytes_read", "records_in_ranges", "range_merges", "gap_bytes_merged")


@query(_COUNTERS_SQL)
def batch_io_counters(spark, sf_dir):
    found = ranges.io_counters(order_batches(spark, sf_dir), part_layout(spark, sf_dir), POLICY)
    return found.select("batch_id", *_SHOWN, F.round("colocated_pair_ratio", 9).alias("colocated_pair_ratio"))


@query(
    f"""WITH RECURSIVE {_LAYOUT}, {_BATCHES}, loc AS (SELECT batch_id, l.* FROM bat JOIN lay l USING (key)),
num AS (SELECT *, row_number() OVER (PARTITION BY batch_id, segment_id ORDER BY "offset") AS k FROM loc),
fold AS (SELECT batch_id, segment_id, k, "offset" AS s, "offset" + size AS e, 1 AS opened FROM num WHERE k = 1 UNION ALL
  SELECT n.batch_id, n.segment_id, n.k, CASE WHEN {{join}} THEN f.s ELSE n."offset" END, CASE WHEN {{join}} THEN greatest(f.e, n."offset" + n.size) ELSE n."offset" + n.size END, CASE WHEN {{join}} THEN 0 ELSE 1 END
  FROM fold f JOIN num n ON n.batch_id = f.batch_id AND n.segment_id = f.segment_id AND n.k = f.k + 1)
SELECT batch_id, CAST(sum(opened) AS BIGINT) AS range_read_ops, CAST(count(*) - sum(opened) AS BIGINT) AS range_merges FROM fold GROUP BY 1""".replace(
        "{join}", f'n."offset" - f.e <= {CAPPED.max_read_gap_bytes} AND greatest(f.e, n."offset" + n.size) - f.s <= {CAPPED.max_range_bytes}'
    )
)
def range_merge_capped(spark, sf_dir):
    """A cap that binds, so that ranges depend on the fold."""
    return ranges.batch_counters(versions.locate(order_batches(spark, sf_dir), part_layout(spark, sf_dir)), ["batch_id"], CAPPED).select("batch_id", "range_read_ops", "range_merges")


@query(f'WITH {_LAYOUT}, {_BATCHES} SELECT batch_id, segment_id, max("offset") - min("offset") AS span FROM bat JOIN lay USING (key) GROUP BY 1, 2')
def offset_span(spark, sf_dir):
    return ranges.offset_spans(versions.locate(order_batches(spark, sf_dir), part_layout(spark, sf_dir)), ["batch_id"])


@query(
    f"WITH {_LAYOUT}, {_BATCHES}, seg AS (SELECT batch_id, segment_id, count(*) AS c FROM bat JOIN lay USING (key) GROUP BY 1, 2) "
    "SELECT batch_id, round(CASE WHEN sum(c) < 2 THEN 0 ELSE sum(c * (c - 1) / 2.0) / (sum(c) * (sum(c) - 1) / 2.0) END, 9) AS colocated_pair_ratio FROM seg GROUP BY 1"
)
def colocated_pair_ratio(spark, sf_dir):
    found = ranges.colocated_pair_ratio(versions.locate(order_batches(spark, sf_dir), part_layout(spark, sf_dir)), ["batch_id"])
    return found.withColumn("colocated_pair_ratio", F.round("colocated_pair_ratio", 9))


@query(
    f"WITH {_LAYOUT}, {_BATCHES}, seg AS (SELECT batch_id AS group_id, segment_id, count(*) AS c FROM bat JOIN lay USING (key) GROUP BY 1, 2) "
    "SELECT group_id, round(max(c) / sum(c), 9) AS share, max(c) / sum(c) >= 0.6 AS colocated FROM seg GROUP BY 1"
)
def already_colocated(spark, sf_dir):
    groups = order_batches(spark, sf_dir).withColumnRenamed("batch_id", "group_id")
    return ranges.already_colocated(groups, part_layout(spark, sf_dir), 0.6).withColumn("share", F.round("share", 9))


@query(
    f"WITH per AS ({_COUNTERS_SQL}) SELECT count(*) AS query_count, round(avg(file_opens), 6) AS mean_file_opens, round(avg(range_read_ops), 6) AS mean_range_read_ops, round(avg(range_bytes_read), 6) AS mean_range_bytes_read, "
    "round(avg(records_in_ranges / range_read_ops), 6) AS mean_records_per_range_read, round(avg(range_merges / records_in_ranges), 6) AS mean_range_merge_ratio, "
    "round(avg(CASE WHEN range_merges = 0 THEN 0 ELSE gap_bytes_merged / range_merges END), 6) AS mean_gap_bytes_merged FROM per"
)
def mean_of_ratios(spark, sf_dir):
    found = ranges.phase_metrics(ranges.io_counters(order_batches(spark, sf_dir), part_layout(spark, sf_dir), POLICY), [])
    names = ("mean_file_opens", "mean_range_read_ops", "mean_range_bytes_read", "mean_records_per_range_read", "mean_range_merge_ratio", "mean_gap_bytes_merged")
    return found.select("query_count", *[F.round(c, 6).alias(c) for c in names])


# --- co-access graph ----------------------------------------------------------------------------------


@query("SELECT l_orderkey AS batch_id, array_to_string(list_sort(list(DISTINCT l_partkey))[1:3], ',') AS keys FROM lineitem GROUP BY 1 HAVING count(DISTINCT l_partkey) >= 2")
def bounded_query_keys(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("batch_id"), F.col("l_partkey").alias("key"))
    found = coaccess.bounded_queries(rows, dataclasses.replace(TRACKING, max_keys_per_session=3))
    return found.select("batch_id", F.array_join(F.col("keys").cast("array<string>"), ",").alias("keys"))


@query(
    "WITH o AS (SELECT user_id, CAST(ts AS DATE) AS day, event_id % 40 AS key, row_number() OVER (PARTITION BY user_id, CAST(ts AS DATE) ORDER BY event_id) AS rn FROM events) "
    "SELECT user_id, day, array_to_string(list_sort(list(DISTINCT key)), ',') AS keys FROM o WHERE rn <= 5 GROUP BY 1, 2 HAVING count(DISTINCT key) >= 2"
)
def session_keys(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("user_id", F.to_date("ts").alias("day"), (F.col("event_id") % 40).alias("key"), F.col("event_id").alias("pos"))
    found = coaccess.session_queries(e, dataclasses.replace(TRACKING, max_keys_per_session=5), ["user_id", "day"])
    return found.select("user_id", "day", F.array_join(F.col("keys").cast("array<string>"), ",").alias("keys"))


@query(f"WITH {_GRAPH} SELECT a, b, weight FROM edg")
def coaccess_edges(spark, sf_dir):
    return part_graph(spark, sf_dir)


@query(
    "WITH k AS (SELECT l_orderkey AS batch_id, l_partkey AS key, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_partkey) AS i FROM (SELECT DISTINCT l_orderkey, l_partkey FROM lineitem)), "
    "p AS (SELECT x.batch_id, x.key AS a, y.key AS b, row_number() OVER (PARTITION BY x.batch_id ORDER BY x.i, y.i) AS n FROM k x JOIN k y ON x.batch_id = y.batch_id AND x.i < y.i) "
    "SELECT a, b, CAST(count(*) AS DOUBLE) AS weight FROM p WHERE n <= 3 GROUP BY 1, 2"
)
def pair_downsample(spark, sf_dir):
    """At most three pairs a query."""
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("batch_id"), F.col("l_partkey").alias("key"))
    return coaccess.track(rows, dataclasses.replace(TRACKING, max_pair_inserts_per_query=3))


@query(f"WITH {_GRAPH} SELECT a, b, weight * 7e-13 * 1e12 AS weight FROM edg WHERE weight * 7e-13 > 1e-12")
def edge_decay(spark, sf_dir):
    """So strong a decay that edges of weight 1 fall below the floor."""
    return coaccess.decay(part_graph(spark, sf_dir), 7e-13).withColumn("weight", F.col("weight") * F.lit(1e12))


@query(f"WITH {_GRAPH} SELECT a, b, sum(weight) AS weight FROM (SELECT * FROM edg UNION ALL SELECT a, b, weight * 0.5 FROM edg WHERE a % 2 = 0) GROUP BY 1, 2")
def edge_merge(spark, sf_dir):
    graph = part_graph(spark, sf_dir)
    return coaccess.merge(graph, coaccess.decay(graph.where("a % 2 = 0"), 0.5))


@query(f"WITH {_GRAPH}, r AS (SELECT *, row_number() OVER (ORDER BY weight, a, b) AS rn, count(*) OVER () AS n FROM edg) SELECT a, b, weight FROM r WHERE rn > ceil(0.1 * n)")
def edge_prune(spark, sf_dir):
    return coaccess.prune_weakest(part_graph(spark, sf_dir))


@query(f"WITH {_GRAPH}, r AS (SELECT *, row_number() OVER (ORDER BY weight DESC, a, b) AS rn FROM edg) SELECT a, b, weight FROM r WHERE rn <= 5000")
def edge_cap(spark, sf_dir):
    return coaccess.keep_strongest(part_graph(spark, sf_dir), 5000)


@query(f"WITH {_GRAPH} SELECT count(*) AS edge_count, max(weight) AS max_weight, sum(weight) AS total_weight FROM edg")
def graph_stats(spark, sf_dir):
    return coaccess.statistics(part_graph(spark, sf_dir))


@query(f"WITH {_GRAPH}, p AS (SELECT DISTINCT l_partkey AS b, l_suppkey AS a FROM lineitem) SELECT p.a, p.b, coalesce(weight, 0) AS weight FROM p LEFT JOIN edg e ON e.a = least(p.a, p.b) AND e.b = greatest(p.a, p.b)")
def edge_lookup(spark, sf_dir):
    pairs = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("a"), F.col("l_partkey").alias("b")).distinct()
    return coaccess.weights_of(pairs, part_graph(spark, sf_dir))


# --- planning -----------------------------------------------------------------------------------------


@query(f"WITH {_GRAPH} SELECT a, b, weight, round(weight / max(weight) OVER (), 9) AS affinity FROM edg")
def affinity_edges(spark, sf_dir):
    return planner.affinities(part_graph(spark, sf_dir)).withColumn("affinity", F.round("affinity", 9))


_STRONG = f"{_GRAPH}, str AS (SELECT a, b FROM edg WHERE weight / (SELECT max(weight) FROM edg) >= {THRESHOLD}), bth AS (SELECT a, b FROM str UNION SELECT b, a FROM str)"
_COMPONENTS = f"{_STRONG}, reach AS (SELECT a AS key, a AS root FROM bth UNION SELECT r.key, n.root FROM reach n JOIN (SELECT a AS root, b AS key FROM bth) r ON r.root = n.key), cmp AS (SELECT key, min(root) AS component FROM reach GROUP BY 1)"


@query(f"WITH {_STRONG} SELECT a AS key, array_to_string(list_sort(list(DISTINCT b)), ',') AS neighbours FROM bth GROUP BY 1")
def adjacency(spark, sf_dir):
    found = planner.adjacency(planner.strong(part_graph(spark, sf_dir), THRESHOLD))
    return found.select("key", F.array_join(F.col("neighbours").cast("array<string>"), ",").alias("neighbours"))


@query(f"WITH RECURSIVE {_COMPONENTS} SELECT key, component FROM cmp")
def components(spark, sf_dir):
    return connected_components(planner.strong(part_graph(spark, sf_dir), THRESHOLD).select("a", "b"))


_GROUPS = (
    f"{_COMPONENTS}, nrm AS (SELECT max(weight) AS norm FROM edg), ins AS (SELECT x.component, sum(e.weight / norm) AS inner_gain FROM edg e JOIN cmp x ON x.key = e.a JOIN cmp y ON y.key = e.b AND y.component = x.component, nrm GROUP BY 1), "
    f"siz AS (SELECT component, count(*) AS n, list_sort(list(key)) AS keys FROM cmp GROUP BY 1), gai AS (SELECT component, keys, n, inner_gain - {PLANNER.hysteresis_per_key} * n AS gain FROM siz JOIN ins USING (component)), "
    f"grp AS (SELECT row_number() OVER (ORDER BY component) - 1 AS group_id, keys, n, gain FROM gai WHERE n >= 2 AND gain >= {PLANNER.min_expected_gain})"
)


def _plan(spark, sf_dir):
    """Limits that no component exceeds, so that the order of its keys is free (SQL can't walk it) and shown sorted."""
    wide = dataclasses.replace(PLANNER, max_keys_per_group=1 << 30, max_bytes_per_group=1 << 60)
    sizes = part_layout(spark, sf_dir).select("key", F.col("size").alias("bytes"))
    return saved(planner.plan(part_graph(spark, sf_dir), sizes, wide), "plan")


@query(f"WITH RECURSIVE {_GROUPS} SELECT CAST(group_id AS INT) AS group_id, array_to_string(keys, ',') AS keys, CAST(group_id % 4 AS INT) AS target_segment_class, round(gain, 6) AS expected_gain FROM grp")
def layout_plan(spark, sf_dir):
    keys = F.array_join(F.sort_array("keys").cast("array<string>"), ",")
    return _plan(spark, sf_dir).select("group_id", keys.alias("keys"), "target_segment_class", F.round("expected_gain", 6).alias("expected_gain"))


@query(f"WITH RECURSIVE {_GROUPS} SELECT count(*) AS groups, CAST(sum(n) AS BIGINT) AS total_keys, round(sum(gain), 6) AS total_gain, false AS overlapping FROM grp")
def plan_summary(spark, sf_dir):
    return planner.summary(_plan(spark, sf_dir)).withColumn("total_gain", F.round("total_gain", 6))


@query(
    # a key's place in breadth-first order: the shortest path from the least key, the least such path first
    f"WITH RECURSIVE {_COMPONENTS}, wlk AS (SELECT component, component AS key, [component] AS path FROM cmp WHERE key = component UNION ALL SELECT w.component, n.b, list_append(w.path, n.b) FROM wlk w JOIN bth n ON n.a = w.key WHERE NOT list_contains(w.path, n.b)), "
    "sho AS (SELECT component, key, path, row_number() OVER (PARTITION BY component, key ORDER BY len(path), path) AS rn FROM wlk), ord AS (SELECT component, key, row_number() OVER (PARTITION BY component ORDER BY len(path), path) - 1 AS place FROM sho WHERE rn = 1), "
    "chk AS (SELECT component, place // 2 AS chunk, list(key ORDER BY place) AS keys FROM ord GROUP BY 1, 2 HAVING count(*) > 1), nrm AS (SELECT max(weight) AS norm FROM edg), "
    f"gai AS (SELECT component, chunk, keys, coalesce(sum(weight / norm), 0) - {PLANNER.hysteresis_per_key} * 2 AS gain FROM chk LEFT JOIN edg ON edg.a = least(keys[1], keys[2]) AND edg.b = greatest(keys[1], keys[2]) CROSS JOIN nrm GROUP BY 1, 2, 3) "
    "SELECT CAST(row_number() OVER (ORDER BY component, chunk) - 1 AS INT) AS group_id, array_to_string(keys, ',') AS keys, CAST((row_number() OVER (ORDER BY component, chunk) - 1) % 4 AS INT) AS target_segment_class, round(gain, 6) AS expected_gain FROM gai WHERE gain >= 0"
)
def layout_plan_packed(spark, sf_dir):
    """Groups of at most two keys, cut from components in visit order."""
    narrow = dataclasses.replace(PLANNER, max_keys_per_group=2, min_expected_gain=0.0)
    made = planner.plan(part_graph(spark, sf_dir), part_layout(spark, sf_dir).select("key", F.col("size").alias("bytes")), narrow)
    return made.withColumn("keys", F.array_join(F.col("keys").cast("array<string>"), ",")).withColumn("expected_gain", F.round("expected_gain", 6))


# --- scheduling and relocation ------------------------------------------------------------------------


@query(
    f"WITH RECURSIVE {_GROUPS}, {_LAYOUT}, i AS (SELECT (SELECT count(*) FROM edg) AS edge_count, CAST(500000 AS BIGINT) AS max_graph_edges, (SELECT count(DISTINCT segment_id) FROM lay) AS segment_count, (SELECT round(sum(gain), 6) FROM grp) AS plan_total_gain) "
    "SELECT *, array_to_string(list_filter([CASE WHEN segment_count >= 12 THEN 'Fragmentation' END, CASE WHEN edge_count / max_graph_edges >= 0.35 THEN 'GraphPressure' END, CASE WHEN plan_total_gain >= 2.0 THEN 'LocalityGain' END], lambda x: x IS NOT NULL), ',') AS fired, "
    "CASE WHEN segment_count >= 12 THEN 'Fragmentation' WHEN edge_count / max_graph_edges >= 0.35 THEN 'GraphPressure' WHEN plan_total_gain >= 2.0 THEN 'LocalityGain' END AS \"primary\" FROM i"
)
def scheduler_triggers(spark, sf_dir):
    counts = part_graph(spark, sf_dir).agg(F.count(F.lit(1)).alias("edge_count")).join(part_layout(spark, sf_dir).agg(F.count_distinct("segment_id").alias("segment_count")))
    gain = planner.summary(_plan(spark, sf_dir)).select(F.round("total_gain", 6).alias("plan_total_gain"))
    inputs = counts.join(gain).select("edge_count", F.lit(500_000).cast("bigint").alias("max_graph_edges"), "segment_count", "plan_total_gain")
    return scheduler.triggers_fired(inputs).withColumn("fired", F.array_join("fired", ","))


@query(
    "SELECT p_partkey AS key, CAST(floor(p_size * 1000 * least(greatest(p_retailprice / 2000 - 0.2, 0), 1)) AS BIGINT) AS max_bytes, CAST(floor(p_size * least(greatest(p_retailprice / 2000 - 0.2, 0), 1)) AS BIGINT) AS max_groups FROM part"
)
def effective_budget(spark, sf_dir):
    max_bytes, max_groups = scheduler.budget_columns(F.col("p_size") * 1000, F.col("p_size"), F.col("p_retailprice") / 2000 - 0.2)
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("key"), max_bytes.alias("max_bytes"), max_groups.alias("max_groups"))


@query(
    f"WITH RECURSIVE {_GROUPS}, {_LAYOUT}, est AS (SELECT group_id, gain, sum(size) AS bytes FROM (SELECT group_id, gain, unnest(keys) AS key FROM grp) JOIN lay USING (key) GROUP BY 1, 2), "
    "run AS (SELECT *, sum(bytes) OVER w AS used, row_number() OVER w AS k FROM est WINDOW w AS (ORDER BY round(gain, 9) DESC, group_id)) SELECT CAST(group_id AS INT) AS group_id, CAST(bytes AS BIGINT) AS estimated_bytes FROM run WHERE used <= 1000 AND k <= 20"
)
def budget_select(spark, sf_dir):
    groups = _plan(spark, sf_dir).withColumn("expected_gain", F.round("expected_gain", 9))
    idx = part_layout(spark, sf_dir)
    facts = scheduler.group_facts(groups, idx, idx.select("key", F.col("size").alias("bytes")))
    return scheduler.select_within_budget(facts, scheduler.Budget(1000, 20)).select("group_id", "estimated_bytes")


_MOVED = (
    f"WITH RECURSIVE {_GROUPS}, {_LAYOUT}, top AS (SELECT max(segment_id) AS top FROM lay), mov AS (SELECT top + 1 + group_id AS segment_id, key, size, 64 + coalesce(sum(size) OVER (PARTITION BY group_id ORDER BY key ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS \"offset\" "
    "FROM (SELECT group_id, unnest(keys) AS key FROM grp) JOIN lay USING (key), top), new AS (SELECT key, segment_id, size, \"offset\" FROM mov UNION ALL SELECT key, segment_id, size, \"offset\" FROM lay WHERE key NOT IN (SELECT key FROM mov))"
)


def _relocated(spark, sf_dir):
    log, groups = part_log(spark, sf_dir), _plan(spark, sf_dir)
    top = log.agg(F.max("segment_id")).first()[0]
    return relocation.apply_moves(log, relocation.relocate_plan(log, groups, top + 1))


@query(f'{_MOVED} SELECT key, CAST(segment_id AS BIGINT) AS segment_id, CAST("offset" AS BIGINT) AS "offset", size FROM new')
def relocated_layout(spark, sf_dir):
    return versions.index(_relocated(spark, sf_dir)).select("key", "segment_id", "offset", "size")


_ADAPTED = (
    f"{_MOVED}, {_ranges_sql(POLICY, 'lay')}, old AS (SELECT count(*) AS ops, sum(\"end\" - \"start\") AS bytes, count(DISTINCT (batch_id, segment_id)) AS opens FROM rng), {_ranges_sql(POLICY, 'new').replace('loc', 'loc2').replace('prv', 'prv2').replace('ran AS', 'ran2 AS').replace('FROM ran', 'FROM ran2').replace('rng', 'rng2')}, "
    "neu AS (SELECT count(*) AS ops, sum(\"end\" - \"start\") AS bytes, count(DISTINCT (batch_id, segment_id)) AS opens FROM rng2) "
)


@query(
    f"{_ADAPTED} SELECT old.ops AS range_ops_baseline, neu.ops AS range_ops_adapted, CAST(old.bytes AS BIGINT) AS range_bytes_baseline, CAST(neu.bytes AS BIGINT) AS range_bytes_adapted, old.opens AS file_opens_baseline, neu.opens AS file_opens_adapted, round((old.ops - neu.ops) / old.ops, 9) AS range_ops_gain FROM old, neu"
)
def adapted_vs_baseline(spark, sf_dir):
    """What do all orders cost before and after strongly co-bought parts are put together?"""
    batches = order_batches(spark, sf_dir)

    def cost(idx, name):
        c = ranges.batch_counters(versions.locate(batches, idx), ["batch_id"], POLICY)
        return c.agg(F.sum("range_read_ops").alias(f"range_ops_{name}"), F.sum("range_bytes_read").alias(f"range_bytes_{name}"), F.sum("file_opens").alias(f"file_opens_{name}"))

    both = cost(part_layout(spark, sf_dir), "baseline").join(cost(saved(versions.index(_relocated(spark, sf_dir)), "index"), "adapted"))
    return both.withColumn("range_ops_gain", F.round(scalars.signed_gain("range_ops_baseline", "range_ops_adapted"), 9))


@query(f"{_MOVED} SELECT CAST((SELECT sum(size) FROM mov) AS BIGINT) AS rewrite_bytes, CAST((SELECT sum(size - 36) FROM lay) AS BIGINT) AS user_bytes, round((SELECT sum(size) FROM mov) / (SELECT sum(size - 36) FROM lay), 9) AS rewrite_amplification")
def rewrite_amplification(spark, sf_dir):
    log = part_log(spark, sf_dir)
    facts = relocation.relocation_facts(_plan(spark, sf_dir), versions.index(log), 1)
    both = facts.agg(F.coalesce(F.sum("bytes_written"), F.lit(0)).alias("rewrite_bytes")).join(log.agg(F.sum(F.length("payload")).alias("user_bytes")))
    return both.withColumn("rewrite_amplification", F.round(scalars.ratio("rewrite_bytes", "user_bytes"), 9))


@query(
    f"WITH RECURSIVE {_GROUPS}, {_LAYOUT}, bat AS (SELECT group_id AS batch_id, unnest(keys) AS key FROM grp), {_ranges_sql()} SELECT CAST(batch_id AS INT) AS group_id, count(*) AS ranges, CAST(sum(\"end\" - \"start\") AS BIGINT) AS bytes, count(DISTINCT segment_id) AS opens FROM rng GROUP BY 1".replace(
        f"{_BATCHES}, edg", "bats AS (SELECT DISTINCT l_orderkey AS batch_id, l_partkey AS key FROM lineitem), edg"
    ).replace("FROM bat x JOIN bat y", "FROM bats x JOIN bats y")
)
def predict_range_reads(spark, sf_dir):
    return ranges.predict_reads(planner.assigned_keys(_plan(spark, sf_dir)), part_layout(spark, sf_dir), POLICY)


# --- manifests ----------------------------------------------------------------------------------------

_DISK = "dsk AS (SELECT DISTINCT lpad(CAST(event_id // 1000 + 1 AS VARCHAR), 20, '0') || '.seg' AS name, CASE WHEN (event_id // 1000) % 3 = 0 THEN 0 ELSE 9 END AS len FROM events UNION ALL SELECT 'MANIFEST.json', 5), lst AS (SELECT name FROM dsk WHERE len = 9 AND name < '00000000000000000007.seg' UNION ALL SELECT 'gone.seg')"


def _disk(spark, sf_dir):
    k = F.floor(F.col("event_id") / 1000)
    files = table(spark, sf_dir, "events").select(scalars.segment_file_name((k + 1).cast("bigint")).alias("name"), F.when(k % 3 == 0, 0).otherwise(9).alias("len")).distinct()
    disk = files.union(spark.createDataFrame([("MANIFEST.json", 5)], "name string, len int"))
    listed = files.where("len = 9 AND name < '00000000000000000007.seg'").select("name").union(spark.createDataFrame([("gone.seg",)], "name string"))
    return disk, listed


@query(f"WITH {_DISK} SELECT name, len FROM dsk WHERE name LIKE '%.seg' AND name NOT IN (SELECT name FROM lst)")
def orphan_segments(spark, sf_dir):
    return manifest.orphans(*_disk(spark, sf_dir))


@query(f"WITH {_DISK} SELECT name, len FROM dsk WHERE name LIKE '%.seg' AND len = 0 AND name NOT IN (SELECT name FROM lst)")
def empty_orphan_segments(spark, sf_dir):
    return manifest.empty_orphans(*_disk(spark, sf_dir))


@query(f"WITH {_DISK} SELECT name FROM dsk WHERE name LIKE '%.seg'")
def segments_to_replay(spark, sf_dir):
    disk, listed = _disk(spark, sf_dir)
    return manifest.scan_list(listed, disk)


@query(
    "WITH m AS (SELECT user_id AS version, event_id AS generation, CAST(value AS INT) % 5 AS n, event_id % 2 = 0 AS is_primary FROM events) "
    "SELECT 1 AS version, generation, n AS segments FROM m WHERE version = 1 ORDER BY generation DESC, n DESC, is_primary DESC LIMIT 1"
)
def newest_manifest(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    m = e.select(F.col("user_id").cast("int").alias("version"), F.col("event_id").alias("generation"), F.array_repeat(F.lit("s"), F.round("value").cast("int") % 5).alias("segments"), (F.col("event_id") % 2 == 0).alias("is_primary"))
    return manifest.pick_newest(m).select("version", "generation", F.size("segments").alias("segments"))


# --- statistics ---------------------------------------------------------------------------------------


@query(
    "WITH v AS (SELECT event_type, list_sort(list(value)) AS x FROM events GROUP BY 1) SELECT event_type, x[CAST(floor((len(x) - 1) * 0.5 + 0.5) AS INT) + 1] AS p50, x[CAST(floor((len(x) - 1) * 0.95 + 0.5) AS INT) + 1] AS p95 FROM v"
)
def nearest_rank_p50_p95(spark, sf_dir):
    return stats.nearest_ranks(table(spark, sf_dir, "events"), ["event_type"], "value", {"p50": 0.5, "p95": 0.95})


@query(
    "SELECT event_type, round(quantile_cont(value, 0.5), 9) AS median, round(quantile_cont(value, 0.75) - quantile_cont(value, 0.25), 9) AS iqr, min(value) AS least, max(value) AS greatest FROM events WHERE event_id % 7 <> 0 GROUP BY 1"
)
def median_iqr(spark, sf_dir):
    """Every seventh value is no number and drops out."""
    value = F.when(F.col("event_id") % 7 == 0, F.lit(float("nan"))).otherwise(F.col("value"))
    g = table(spark, sf_dir, "events").withColumn("value", value).groupBy("event_type")
    return g.agg(F.round(stats.median("value"), 9).alias("median"), F.round(stats.iqr("value"), 9).alias("iqr"), stats.least("value").alias("least"), stats.greatest("value").alias("greatest"))


_GAINS = "g AS (SELECT user_id, event_id, CASE WHEN abs(sin(event_id)) < 0.3 THEN 0.0 ELSE sin(event_id) END AS gain FROM events)"


def _gains(spark, sf_dir):
    gain = F.when(F.abs(F.sin("event_id")) < 0.3, F.lit(0.0)).otherwise(F.sin("event_id"))
    return table(spark, sf_dir, "events").select("user_id", "event_id", gain.alias("gain"))


@query(f"WITH {_GAINS} SELECT user_id, count(*) FILTER (gain >= 0.01) AS positive, count(*) FILTER (gain <= -0.01) AS negative, count(*) FILTER (abs(gain) < 0.01) AS zeroish FROM g GROUP BY 1")
def signed_gain_counts(spark, sf_dir):
    return _gains(spark, sf_dir).groupBy("user_id").agg(stats.positive_runs("gain").alias("positive"), stats.negative_runs("gain").alias("negative"), stats.zeroish_runs("gain").alias("zeroish"))


@query(
    f"WITH {_GAINS}, l AS (SELECT *, lag(gain) OVER (PARTITION BY user_id ORDER BY event_id) AS b FROM g) SELECT user_id, CAST(coalesce(sum(CASE WHEN abs(gain) >= 0.01 AND abs(b) >= 0.01 AND sign(gain) <> sign(b) THEN 1 ELSE 0 END), 0) AS BIGINT) AS flips FROM l GROUP BY 1"
)
def sign_flips(spark, sf_dir):
    return _gains(spark, sf_dir).withColumn("f", stats.flips("gain", ["user_id"], "event_id")).groupBy("user_id").agg(F.sum("f").alias("flips"))


# --- workloads and the benchmark ----------------------------------------------------------------------


@query("WITH w AS (SELECT r AS rank, 1 / pow(r, 1.2) AS w FROM range(1, 1001) t(r)) SELECT rank, round(sum(w) OVER (ORDER BY rank) / (SELECT sum(w) FROM w), 9) AS cdf FROM w")
def zipf_cdf_table(spark, sf_dir):
    """Shares of ranks as a window; ranks are a bounded parameter. workload sampling searches the same shares."""
    w = spark.range(1, 1001).select(F.col("id").alias("rank"), (1 / F.pow("id", F.lit(1.2))).alias("w"))
    total = float(w.agg(F.sum("w")).first()[0])
    return w.select("rank", F.round(F.sum("w").over(Window.orderBy("rank")) / total, 9).alias("cdf"))


SEED = 0xBEEFC0DE


def _spec(pattern: str) -> WorkloadSpec:
    return WorkloadSpec(pattern, key_space=2000, num_query_batches=48, mixed_steps=96)


def _workload(pattern: str) -> Query:
    def made(spark, sf_dir):
        spec = _spec(pattern)
        steps = workload.generate(spark, workload.schedule([pattern], 3, SEED), spec)
        return steps.select("scenario", "run_id", "step", "kind", F.array_join(F.col("keys").cast("array<string>"), ",").alias("keys"), "key", "version", F.hex("payload").alias("payload"))

    return made


for _pattern, _name in (("Random", "workload_random"), ("Clustered", "workload_clustered"), ("SkewedZipfian", "workload_zipfian"), ("MixedReadWrite", "workload_mixed"), ("AdversarialAlternating", "workload_adversarial")):
    QUERIES[_name] = _workload(_pattern)
    SQL[_name] = workload_sql.query(_pattern, _spec(_pattern), 3, SEED)


_DIGESTED = ("Random", "Clustered", "MixedReadWrite")


@query(" UNION ALL ".join(f"SELECT * FROM ({workload_sql.digest(p, _spec(p), 3, 42)})" for p in _DIGESTED))
def workload_digest(spark, sf_dir):
    return workload.digest(workload.generate(spark, workload.schedule(list(_DIGESTED), 3, 42), _spec("Random")))


@query()
def harness_results(spark, sf_dir):
    """Five scenarios, three seeds, before and after adaptation."""
    runs = workload.schedule(list(harness.PATTERNS), 3, 0xBEEFC0DE)
    return harness.run(spark, runs, harness.template(2000, 48, 12))["results"]


@query()
def harness_small(spark, sf_dir):
    """The published small preset: 35 runs."""
    runs, keys, batches, cycles = harness.PRESETS["small"]
    return harness.run(spark, workload.schedule(list(harness.PATTERNS), runs, 0xBEEFC0DE), harness.template(keys, batches, cycles))["results"]


@query()
def harness_summary(spark, sf_dir):
    return harness.summarize(harness_results(spark, sf_dir), 0xBEEFC0DE)


def entry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many range reads does fetching every order's parts need, before and after adapting the layout?"""
    return adapted_vs_baseline(spark, sf_dir)


