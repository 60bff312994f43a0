"""Errors of the store. Inside jobs a row carries a status instead; see functions.codec."""


class StoreError(Exception):
    """Base of all."""


class StoreIOError(StoreError):
    """A file could not be read or written."""


class CorruptRecord(StoreError):
    def __init__(self, offset: int, reason: str):
        super().__init__(f"corrupt record at {offset}: {reason}")
        self.offset, self.reason = offset, reason


class ChecksumMismatch(StoreError):
    def __init__(self, offset: int, expected: int, got: int):
        super().__init__(f"checksum at {offset}: expected {expected}, got {got}")
        self.offset, self.expected, self.got = offset, expected, got


class CorruptFooter(StoreError):
    """A segment's footer is unusable and can't be rebuilt."""


class InvalidSegmentHeader(StoreError):
    """A segment file doesn't begin as one."""


class ManifestDecodeError(StoreError):
    """A manifest is not the expected JSON."""


class UnsupportedManifestVersion(StoreError):
    """A manifest of another format version."""


class InvalidDataDir(StoreError):
    """The data folder is a file."""


class InjectedFault(StoreError):
    """Raised by a fault hook of a test."""


class InternalError(StoreError):
    """A broken invariant, such as relocating no keys."""
