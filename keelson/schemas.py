"""Schemas of the tables that operators pass to each other."""

RECORDS = "key bigint, version bigint, flags int, payload binary, segment_id bigint, offset bigint, size bigint"
INDEX = "key bigint, segment_id bigint, offset bigint, version bigint, flags int, size bigint"
BATCHES = "batch_id bigint, pos int, key bigint"
EDGES = "a bigint, b bigint, weight double"
PLAN = "group_id int, keys array<bigint>, target_segment_class int, expected_gain double"
KEY_SIZES = "key bigint, bytes bigint"
STEPS = "scenario string, run_id int, step int, kind string, keys array<bigint>, key bigint, version bigint, payload_len int"
RUN_COUNTERS = (
    "query_count", "segments_touched", "bytes_read", "colocated_pair_ratio", "file_opens", "physical_read_ops", "physical_bytes_read",
    "segment_groups", "offsets_span_total", "range_read_ops", "range_bytes_read", "records_in_ranges", "range_merges", "gap_bytes_merged",
)

#: Fixed values of the record format: bytes of a record's header and checksum, where a segment's first record begins, and the tombstone flag.
RECORD_HEADER = 32
RECORD_OVERHEAD = 36
SEGMENT_HEADER = 64
TOMBSTONE = 1
BLOCK = 65_536
