"""Column expressions for the log's rules: sizes, sequence order, status codes, key hashing, integrity."""

from __future__ import annotations

from enum import IntEnum

from pyspark.sql import Column
from pyspark.sql import functions as F

PAGE = 4096
#: Bytes of an entry besides its value: header 16, key 8, length 4, checksum 4.
OVERHEAD = 32
#: Largest value, and largest page count that a location can hold.
MAX_VALUE = 256 << 20
MAX_PAGES = 65535
MAX_FILES = 1024
MAX_OFFSET = (1 << 21) - 1
#: Segments of a scattered value.
MAX_SEGMENTS = 16
#: Marks an entry: "TLOG".
MAGIC = 0x544C4F47


class Status(IntEnum):
    """Result codes, fixed values."""

    OK = 0
    NOT_FOUND = -1
    TOO_SMALL = -2
    CORRUPT = -5
    INVALID = -6
    NOT_READY = -7
    BUSY = -9
    EXISTS = -10


def value_length(value: Column) -> Column:
    """Bytes of a value; null counts as none."""
    return F.coalesce(F.octet_length(value), F.lit(0)).cast("long")


def page_count(length: Column) -> Column:
    """Pages of an entry with a value of that many bytes; a tombstone takes one."""
    return F.floor((length + (OVERHEAD + PAGE - 1)) / PAGE).cast("long")


def aligned_size(length: Column) -> Column:
    return page_count(length) * PAGE


def put_status(length: Column, cap: int = MAX_VALUE) -> Column:
    """Empty values are invalid; those beyond the cap, or whose pages don't fit a location, don't fit."""
    return F.when(length == 0, int(Status.INVALID)).when((length > cap) | (page_count(length) > MAX_PAGES), int(Status.TOO_SMALL)).otherwise(int(Status.OK))


def segmented_put_status(segments: Column, first_length: Column) -> Column:
    """A scattered put needs 1 to 16 segments, and a first one of a page at least."""
    return F.when(~segments.between(1, MAX_SEGMENTS) | (first_length < PAGE), int(Status.INVALID)).otherwise(int(Status.OK))


def segmented_pages(total_length: Column) -> Column:
    """Pages of a scattered value, whose header lies inside its first page."""
    return F.floor(total_length / PAGE).cast("long")


def is_newer(a: Column, b: Column) -> Column:
    """Whether the 32-bit sequence a is newer than b, across a wrap; not transitive beyond half the range."""
    return F.pmod(a - b, F.lit(1 << 32)).between(1, (1 << 31) - 1)


def unwrapped(sequence: Column, epoch: Column) -> Column:
    """A 64-bit sequence, which orders like time, from the number of wraps so far and the 32-bit sequence."""
    return epoch * (1 << 32) + sequence


def unsigned_order(key: Column) -> Column:
    """Orders 64-bit patterns as unsigned numbers."""
    return key.bitwiseXOR(F.lit(-(1 << 63)))


def unsigned_key(key: Column) -> Column:
    """The unsigned number of a 64-bit pattern."""
    return F.when(key >= 0, key.cast("decimal(20,0)")).otherwise(key.cast("decimal(20,0)") + F.lit(str(1 << 64)).cast("decimal(20,0)"))


def fnv1a(key: Column) -> Column:
    """64-bit FNV-1a of the key's eight bytes, lowest first, without overflow under ANSI arithmetic."""
    low = lambda x: x.bitwiseAND(F.lit(0xFFFFFFFF))

    def multiplied(x: Column) -> Column:
        # The prime is 2**40 + 435: multiply the halves by 435 and add the shifted low bits.
        part = low(x) * 435
        high = low(F.shiftrightunsigned(part, 32) + F.shiftrightunsigned(x, 32) * 435 + F.shiftleft(x.bitwiseAND(F.lit(0xFFFFFF)), 8))
        return F.shiftleft(high, 32).bitwiseOR(low(part))

    octets = F.array(*[F.shiftrightunsigned(key, 8 * i).bitwiseAND(F.lit(255)) for i in range(8)])
    return F.aggregate(octets, F.lit(-3750763034362895579), lambda h, octet: multiplied(h.bitwiseXOR(octet)))


def tag(key: Column) -> Column:
    return F.shiftrightunsigned(fnv1a(key), 56)


def bucket(key: Column, capacity: int) -> Column:
    """The key's place in a table of a power of two slots."""
    return fnv1a(key).bitwiseAND(F.lit(capacity - 1))


def segment_of(key: Column, capacity: int = 4096, segments: int = 80) -> Column:
    """The checkpoint segment of a key; the last takes the buckets that don't divide evenly."""
    width = capacity // segments
    return F.least(F.floor(bucket(key, capacity) / width), F.lit(segments - 1)).cast("long")


def little_endian(value: Column, size: int) -> Column:
    """An integer's lowest bytes, lowest first."""
    return F.unhex(F.concat(*[F.lpad(F.hex(F.shiftrightunsigned(value, 8 * i).bitwiseAND(F.lit(255))), 2, "0") for i in range(size)]))


def entry_image(key: Column, seq: Column, value: Column, deleted: Column) -> Column:
    """The bytes that an entry's checksum covers: magic, version, flags, sequence, key, length, value."""
    head = F.concat(
        little_endian(F.lit(MAGIC).cast("long"), 4), little_endian(F.lit(1).cast("long"), 4), little_endian(F.when(deleted, 1).otherwise(0).cast("long"), 4), little_endian(seq, 4), little_endian(key, 8), little_endian(value_length(value), 4)
    )
    return F.concat(head, F.coalesce(value.cast("binary"), F.lit(b"")))


def entry_crc(key: Column, seq: Column, value: Column, deleted: Column) -> Column:
    return F.crc32(entry_image(key, seq, value, deleted))


def capacity_for(max_entries: int, load_factor: float = 0.55) -> int:
    """Slots of an index for so many entries: the next power of two."""
    return 1 << max(0, (int(max_entries / load_factor) - 1).bit_length())


def throttle(pending: Column) -> Column:
    """Compaction's share of its rate by the number of waiting foreground operations."""
    return F.when(pending >= 1000, 0.0).when(pending >= 500, 0.25).when(pending >= 100, 0.5).otherwise(1.0)


def checkpoint_due(seconds: Column, written: Column, dirty_segments: Column) -> Column:
    """Whether a checkpoint should begin: after 300 seconds, 10 GiB of log, or eight changed segments."""
    return (seconds >= 300) | (written >= 10 << 30) | (dirty_segments >= 8)


def flush_due(buffers: Column, entries: Column, milliseconds: Column) -> Column:
    """Whether pending writes are flushed: 16 buffers, 128 entries, or 10 ms since the first."""
    return (buffers >= 16) | (entries >= 128) | (milliseconds >= 10)


def back_pressure(buffers: Column, was_on: Column) -> Column:
    """Whether writers wait: from 12 pending buffers on, until there are 6."""
    return F.when(buffers >= 12, True).when(buffers <= 6, False).otherwise(was_on)
