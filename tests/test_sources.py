import json
import os

import pytest

from keelson import faults
from keelson.errors import CorruptFooter, InjectedFault, InvalidSegmentHeader, ManifestDecodeError, UnsupportedManifestVersion
from keelson.operators import versions
from keelson.sources import manifest, segments
from keelson.sources.manifest import Manifest
from keelson.sources.reports import summary_lines, write_artifacts


def segment(records, sealed=True, segment_id=1):
    data, offsets = segments.encode_header(segment_id), []
    for r in records:
        offsets.append(len(data))
        data += segments.encode_record(*r)
    return (data + segments.encode_footer(offsets) if sealed else data), offsets


RECORDS = [(k, k + 1, 0, f"payload-{k}".encode()) for k in range(5)]


def test_footer_and_header_round_trip():
    assert segments.decode_footer(segments.encode_footer([64, 120, 400])) == [64, 120, 400]
    assert segments.decode_header(segments.encode_header(9)) == (1, 9)
    assert segments.segment_name(3) == "00000000000000000003.seg"
    assert segments.decode_footer(b"short") is None and segments.decode_header(b"x" * 64) is None


def test_recovery_of_good_torn_and_flipped_files():
    data, offsets = segment(RECORDS)
    assert segments.recover(data)[::2] == (offsets, False)
    unsealed, _ = segment(RECORDS, sealed=False)
    assert segments.recover(unsealed)[::2] == (offsets, True)
    assert segments.recover(unsealed[:-3])[0] == offsets[:-1]
    assert segments.recover(unsealed + b"garbage")[0] == offsets
    assert segments.recover(data + b"garbage")[0] == offsets
    flipped = bytearray(data)
    flipped[offsets[2] + 40] ^= 1
    assert segments.recover(bytes(flipped))[0] == offsets[:2]
    with pytest.raises(CorruptFooter):
        segments.recover(b"tiny")
    with pytest.raises(InvalidSegmentHeader):
        segments.recover(b"\0" * 200)


def test_heal_is_stable(tmp_path):
    path = tmp_path / segments.segment_name(1)
    data, offsets = segment(RECORDS, sealed=False)
    path.write_bytes(data[:-3])
    assert segments.heal(str(path)) == offsets[:-1] == segments.heal(str(path))
    assert segments.find_footer(path.read_bytes())[0] == offsets[:-1]


def test_read_and_write_through_spark(spark, tmp_path):
    os.makedirs(tmp_path / "in")
    (tmp_path / "in" / segments.segment_name(1)).write_bytes(segment(RECORDS)[0])
    (tmp_path / "in" / segments.segment_name(2)).write_bytes(segment([(1, 9, 1, b"")], sealed=False, segment_id=2)[0] + b"torn")
    (tmp_path / "in" / segments.segment_name(3)).write_bytes(b"junk" * 50)
    (tmp_path / "in" / segments.segment_name(4)).write_bytes(segment([], segment_id=4)[0])
    read = segments.read_segments(spark, str(tmp_path / "in"))
    assert tuple(segments.replay_summary(read).first()) == (4, 6, 1, 1)
    log = segments.records_of(read)
    assert {r["key"]: r["segment_id"] for r in versions.index(log).collect()} == {0: 1, 1: 2, 2: 1, 3: 1, 4: 1}
    os.makedirs(tmp_path / "out")
    assert sorted(r["records"] for r in segments.write_segments(log, str(tmp_path / "out")).collect()) == [1, 5]
    assert (tmp_path / "out" / segments.segment_name(1)).read_bytes() == segment(RECORDS)[0]
    other = segments.SegmentFormat(b"OTHERSG1", b"OTHERFT1")
    os.makedirs(tmp_path / "other")
    segments.write_segments(log.where("segment_id = 1"), str(tmp_path / "other"), other).collect()
    assert segments.records_of(segments.read_segments(spark, str(tmp_path / "other"), other)).count() == 5


def test_manifest_versions_and_backup(tmp_path):
    folder = str(tmp_path)
    assert manifest.load_robust(folder) == Manifest()
    manifest.save(folder, Manifest(2, ("a",)))
    manifest.save(folder, Manifest(9, ("a", "b")))
    assert manifest.load_robust(folder) == Manifest(9, ("a", "b"))
    (tmp_path / manifest.NAME).write_text("{broken")
    assert manifest.load_robust(folder) == Manifest(2, ("a",))
    with pytest.raises(ManifestDecodeError):
        manifest.load(str(tmp_path / manifest.NAME))
    (tmp_path / manifest.NAME).write_text(json.dumps({"version": 2, "segments": []}))
    with pytest.raises(UnsupportedManifestVersion):
        manifest.load(str(tmp_path / manifest.NAME))
    (tmp_path / manifest.NAME).write_text(json.dumps({"version": 1, "segments": ["x"]}))
    assert manifest.load(str(tmp_path / manifest.NAME)).generation == 0
    assert Manifest(1, ("a",)).newer(Manifest(1, ("b",))).segments == ("a",)
    assert Manifest(1, ("a",)).newer(Manifest(1, ("b", "c"))).segments == ("b", "c")


def test_a_fault_before_saving_changes_nothing(tmp_path):
    manifest.save(str(tmp_path), Manifest(1))
    faults.arm("before_manifest_save")
    with pytest.raises(InjectedFault):
        manifest.save(str(tmp_path), Manifest(2))
    assert manifest.load_robust(str(tmp_path)).generation == 1
    manifest.save(str(tmp_path), Manifest(3))
    with pytest.raises(ValueError):
        faults.arm("nowhere")


def test_manifest_frames(spark):
    m = spark.createDataFrame([(1, 4, ["a"], True), (1, 4, ["a", "b"], False), (2, 9, [], True)], "version int, generation bigint, segments array<string>, is_primary boolean")
    assert tuple(manifest.pick_newest(m).first()) == (1, 4, ["a", "b"])
    assert manifest.pick_newest(m.where("version = 2")).count() == 0
    disk = spark.createDataFrame([("1.seg", 0), ("2.seg", 7), ("3.seg", 9), ("MANIFEST.json", 3)], "name string, len bigint")
    listed = spark.createDataFrame([("3.seg",), ("9.seg",)], "name string")
    assert [r["name"] for r in manifest.scan_list(listed, disk).collect()] == ["1.seg", "2.seg", "3.seg"]
    assert [r["name"] for r in manifest.orphans(disk, listed).collect()] == ["1.seg", "2.seg"]
    assert [r["name"] for r in manifest.empty_orphans(disk, listed).collect()] == ["1.seg"]


def test_report_files(spark, tmp_path):
    from keelson.sources.reports import CSV_COLUMNS

    row = {c: 1.0 for c in CSV_COLUMNS} | {"run_id": 0, "seed": 18446744073709551615, "scenario": "a,b"}
    import decimal

    results = spark.createDataFrame([tuple(decimal.Decimal(v) if k == "seed" else v for k, v in row.items())], ", ".join(f"{k} {'string' if k == 'scenario' else 'decimal(20,0)' if k == 'seed' else 'int' if k == 'run_id' else 'double'}" for k in row))
    from keelson.plans.harness import summarize

    summary = summarize(results, 5)
    paths = write_artifacts(results, summary, str(tmp_path / "out"), True)
    assert [os.path.basename(p) for p in paths] == ["raw_runs.json", "summary.json", "runs.csv"]
    assert json.loads(open(paths[0]).read())[0]["seed"] == 18446744073709551615
    assert '"a,b"' in open(paths[2]).read()
    assert "a,b: p95 gain +1.000" in summary_lines(summary).first()["line"]


def test_graph_snapshot_file(spark, tmp_path):
    from keelson.sources.reports import as_json, write_graph

    graph = spark.createDataFrame([(3, 4, 1.0), (1, 2, 2.0)], "a bigint, b bigint, weight double")
    write_graph(graph, str(tmp_path / "g"))
    assert sorted(tuple(r) for r in spark.read.parquet(str(tmp_path / "g")).collect()) == [(1, 2, 2.0), (3, 4, 1.0)]
    assert json.loads(as_json(graph.where("a = 1")).first()["json"]) == {"a": 1, "b": 2, "weight": 2.0}


def test_written_tables_can_be_released(spark):
    from keelson.session import Scratch, numbered, release

    made = Scratch(spark, "t").save(spark.range(5), "x")
    assert made.count() == 5 and os.path.isdir(made._keelson_path.removeprefix("file://"))
    assert [r["rank"] for r in numbered(spark.range(100), ["id"], "rank").orderBy("id").collect()] == list(range(100))
    release(spark)
    assert not os.path.isdir(made._keelson_path.removeprefix("file://"))
