"""Manifests: which segments a store consists of, replaced as a whole with the one before kept as backup."""

from __future__ import annotations

import json
import os
import shutil
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keelson import faults
from keelson.errors import ManifestDecodeError, UnsupportedManifestVersion

NAME, BACKUP, VERSION = "MANIFEST.json", "MANIFEST.json.bak", 1


@dataclass(frozen=True)
class Manifest:
    generation: int = 0
    segments: tuple[str, ...] = ()
    version: int = VERSION

    def newer(self, other: Manifest) -> Manifest:
        """The greater generation, then the more segments, then this one."""
        return max((self, other), key=lambda m: (m.generation, len(m.segments), m is self))


def load(path: str) -> Manifest:
    with open(path, encoding="utf-8") as f:
        try:
            data = json.load(f)
            made = Manifest(int(data.get("generation", 0)), tuple(map(str, data["segments"])), int(data["version"]))
        except (ValueError, KeyError, TypeError, AttributeError) as e:
            raise ManifestDecodeError(str(e)) from e
    if made.version != VERSION:
        raise UnsupportedManifestVersion(str(made.version))
    return made


def load_robust(folder: str) -> Manifest:
    """The newer of primary and backup; one that is missing or undecodable counts as absent, and none as empty."""
    found = None
    for name in (NAME, BACKUP):
        try:
            one = load(os.path.join(folder, name))
        except (OSError, ManifestDecodeError, UnsupportedManifestVersion):
            continue
        found = one if found is None else found.newer(one)
    return found or Manifest()


def save(folder: str, manifest: Manifest) -> str:
    faults.hit("before_manifest_save")
    path = os.path.join(folder, NAME)
    if os.path.exists(path):
        shutil.copyfile(path, os.path.join(folder, BACKUP))
    text = json.dumps({"version": manifest.version, "generation": manifest.generation, "segments": list(manifest.segments)}, indent=2)
    with open(f"{path}.tmp", "w", encoding="utf-8") as f:
        f.write(text)
        f.flush()
        os.fsync(f.fileno())
    os.replace(f"{path}.tmp", path)
    return path


def pick_newest(manifests: DataFrame) -> DataFrame:
    """Of rows (version, generation, segments, is_primary), the one to use: one row, none if all are of other versions."""
    rank = F.struct("generation", F.size("segments"), "is_primary")
    best = manifests.where(F.col("version") == VERSION).agg(F.max_by(F.struct("version", "generation", "segments"), rank).alias("m"))
    return best.where("m IS NOT NULL").select("m.*")


def scan_list(listed: DataFrame, on_disk: DataFrame) -> DataFrame:
    """Segment names to replay: listed ones that exist, and all on disk, by name. Unlisted ones are replayed too."""
    present = listed.join(on_disk.select("name"), "name", "left_semi").select("name")
    return present.union(on_disk.where(F.col("name").endswith(".seg")).select("name")).distinct().orderBy("name")


def orphans(on_disk: DataFrame, listed: DataFrame) -> DataFrame:
    """Segment files (name, len) that the manifest doesn't list, by name."""
    return on_disk.where(F.col("name").endswith(".seg")).join(listed.select("name"), "name", "left_anti").orderBy("name")


def empty_orphans(on_disk: DataFrame, listed: DataFrame) -> DataFrame:
    return orphans(on_disk, listed).where("len = 0")


@dataclass
class RecoveryReport:
    manifest_generation: int = 0
    segments_replayed: int = 0
    orphan_files: list[str] = field(default_factory=list)
    empty_orphan_segments_removed: int = 0
    checksum_records_verified: int = 0
