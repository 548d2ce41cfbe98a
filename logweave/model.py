"""Sizes, limits and errors of the log model."""

from __future__ import annotations

# Fixed values of the log model.
HEADER_BYTES = 256
BLOCK_BYTES = 10 * 1024 * 1024
FILE_BLOCKS = 100
MAX_BATCH_ENTRIES = 2000
MAX_BATCH_BYTES = 10 * 1024**3
MAX_ENTRY_BYTES = 1024**3
MAX_FRAME_BYTES = 64 * 1024

LOG_SCHEMA = "ns string, topic string, seq bigint, payload binary, payload_len bigint, checksum bigint, append_ts timestamp, batch_id bigint"


class LogError(Exception):
    """Base of the engine's errors."""


class InvalidBatch(LogError, ValueError):
    """A batch or entry breaks a limit; nothing was written."""


class ConcurrentWrite(LogError):
    """Another writer has the topic."""


class CorruptEntry(LogError):
    """A checksum does not match and the reader was asked to fail."""


class UnknownTopic(LogError, KeyError):
    """No such topic."""


class NotLeader(LogError):
    """The node does not hold the lease that the write needs."""


class UnknownCommand(LogError, ValueError):
    """A protocol line that is no command."""
