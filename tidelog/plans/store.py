"""A key-value store on a shared folder: an append-only log in generations of Parquet files, snapshots, manifests.

Operations gather in a buffer, which a flush appends to the active file's folder; a manifest then names that folder,
so what a crash leaves unnamed is never read, and vacuum() deletes it. Visible state is a query: the newest snapshot
and the log after it, the latest version of each key. A snapshot lies in segments of keys; a checkpoint writes those
that changed. The byte counters are in the manifest, as far as a checkpoint or a compaction went, and the log after it
adds to them, so neither changes them.
"""

from __future__ import annotations

import json
import time
import uuid
import zlib
from collections import deque
from collections.abc import Callable, Iterable
from dataclasses import asdict, dataclass
from enum import Enum

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelog.functions.semantics import MAGIC, MAX_FILES, MAX_SEGMENTS, MAX_VALUE, PAGE, Status, capacity_for, entry_crc, page_count, segment_of, value_length
from tidelog.operators import compaction, stats, view
from tidelog.operators.layout import file_stats
from tidelog.operators.ordered import with_position
from tidelog.plans import manifest as M


class State(Enum):
    """A store's life: every verb but create() and open() needs READY."""

    UNINITIALIZED = 0
    OPENING = 1
    RECOVERING = 2
    READY = 3
    CLOSING = 4
    CLOSED = 5
    ERROR = 6


_IDLE = (State.UNINITIALIZED, State.CLOSED, State.ERROR)


@dataclass(frozen=True)
class Options:
    data_file_size: int = 8 << 30
    max_entries: int = 1_000_000
    load_factor: float = 0.55
    #: A flush writes what waits once there are so many operations, buffers of so many bytes, or milliseconds.
    flush_entries: int = 128
    buffer_bytes: int = 2 << 20
    flush_buffers: int = 16
    flush_ms: int = 10
    #: Waiting asynchronous operations, at most.
    queue_size: int = 4096
    #: A checkpoint after so many bytes of log, seconds, or changed segments.
    checkpoint_bytes: int = 10 << 30
    checkpoint_seconds: int = 300
    checkpoint_segments: int = 8


ROW = "key long, seq long, op string, value binary, value_len long, file_id long, crc long, magic long"
_COLUMNS = [c.split()[0] for c in ROW.split(", ")]
_STAGED = "key long, seq long, op string, value binary"


class KvStore:
    """Put, get and delete with integer results; a missing key is a status, never an exception."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.folder, self.state = spark, M.Folder(spark, path), State.UNINITIALIZED
        self._reset()

    def _reset(self) -> None:
        self.buffer: list[tuple[int, int, str, bytes | None]] = []
        self.buffered_bytes, self.buffered_since = 0, 0.0
        self.waiting: deque[tuple[str, int, bytes | None, int, Callable | None]] = deque()
        self.scheduled: deque[int] = deque()
        self.tokens, self.paused = 0.0, False
        self.checkpointed = time.monotonic()

    # -- lifecycle

    def create(self, options: Options | None = None) -> int:
        if self.state not in _IDLE or M.load(self.folder):
            return Status.EXISTS
        self._reset()
        self.folder.make("manifest")
        self.meta = {
            "version": 0, "epoch": 1, "options": asdict(options or Options()), "next_seq": 1, "files": [], "headers": {}, "next_file": 0, "snapshot": None, "since_checkpoint": 0,
            "dirty": [], "counted": {"data": 0, "garbage": 0}, "staged": {}, "cut": {},
        }
        self._open_file()
        self._publish()
        self.state = State.READY
        return Status.OK

    def open(self, recover: bool = True) -> int:
        """Reads the newest whole manifest, checks the log after the snapshot, and goes on from its last sequence."""
        if self.state not in _IDLE:
            return Status.EXISTS
        self.state = State.OPENING
        found = M.load(self.folder)
        if found is None:
            self.state = State.ERROR
            return Status.CORRUPT
        self._reset()
        self.meta = found
        self.state = State.RECOVERING
        if recover:
            self._recover()
        top = self._log().agg(F.max("seq")).first()[0] or 0
        snapshot = self.meta["snapshot"]["seq"] if self.meta["snapshot"] else 0
        self.meta["next_seq"] = max(self.meta["next_seq"], snapshot + 1, top + 1)
        self.meta["epoch"] += 1
        self.state = State.READY
        return Status.OK

    def close(self) -> int:
        """Flushes, answers what waits with NOT_READY, and publishes the manifest."""
        if self.state is not State.READY:
            return Status.NOT_READY
        self.state = State.CLOSING
        self._flush()
        while self.waiting:
            kind, _, _, _, done = self.waiting.popleft()
            if done:
                done(*((Status.NOT_READY, None, None) if kind == "GET" else (Status.NOT_READY,)))
        self._publish()
        self.state = State.CLOSED
        return Status.OK

    # -- writes

    def put(self, key: int, value: bytes) -> int:
        if self.state is not State.READY:
            return Status.NOT_READY
        if not value:
            return Status.INVALID
        if len(value) > MAX_VALUE:
            return Status.TOO_SMALL
        self._append(key, "PUT", bytes(value))
        return Status.OK

    def put_segments(self, key: int, segments: Iterable[bytes]) -> int:
        """A scattered value; the first segment must be a page at least."""
        parts = list(segments)
        if self.state is State.READY and (not 1 <= len(parts) <= MAX_SEGMENTS or len(parts[0]) < PAGE):
            return Status.INVALID
        return self.put(key, b"".join(parts))

    #: The same: every put goes through the buffer, whose flush writes it whole.
    put_buffered = put
    put_vectored = put_segments

    def delete(self, key: int) -> int:
        if self.state is not State.READY:
            return Status.NOT_READY
        if self._buffered(key) is None:
            if view.get(self._log(), _signed(key)).isEmpty():
                return Status.NOT_FOUND
        elif self._buffered(key)[2] == "DEL":
            return Status.NOT_FOUND
        self._append(key, "DEL", None)
        return Status.OK

    def put_all(self, rows: DataFrame) -> int:
        """Appends rows (key, seq, op, value) as one batch; sequences are the caller's, and continue those before.
        Empty puts, and deletes of keys that were never put, are left out, as put() and delete() refuse them."""
        if self.state is not State.READY:
            return Status.NOT_READY
        self._flush()
        self._write(self._effective(_accepted(rows)))
        return Status.OK

    def flush(self) -> int:
        if self.state is not State.READY:
            return Status.NOT_READY
        self._flush()
        return Status.OK

    # -- reads

    def get(self, key: int, buffer: int = MAX_VALUE) -> tuple[int, int | None, bytes | None]:
        """(status, length, value); a buffer that is too small still tells the length."""
        if self.state is not State.READY:
            return Status.NOT_READY, None, None
        if buffer <= 0:
            return Status.INVALID, None, None
        held = self._buffered(key)
        if held is not None:
            value = held[3]
        else:
            found = view.get(self._log(), _signed(key)).select("value").first()
            value = bytes(found.value) if found else None
        if value is None:
            return Status.NOT_FOUND, None, None
        return (Status.OK, len(value), value) if len(value) <= buffer else (Status.TOO_SMALL, len(value), None)

    def multi_get(self, requests: DataFrame, buffer: int = MAX_VALUE) -> DataFrame:
        self._flush()
        return view.multi_get(self._log(), requests, F.lit(buffer))

    def scan(self) -> DataFrame:
        """All live entries."""
        self._flush()
        return view.live(self._log()).select("key", "seq", "value")

    def as_of(self, seq: int) -> DataFrame:
        """Live entries at a sequence since the newest snapshot (an extension)."""
        self._flush()
        return view.as_of(self._log(), seq).where(F.col("op") == "PUT").select("key", "seq", "value")

    # -- asynchronous verbs: they wait until poll(), which answers them by their callbacks

    def put_async(self, key: int, value: bytes | list[bytes], done: Callable[[int], None] | None = None) -> int:
        """A list is a scattered value. The result tells whether the request was taken; `done` gets the status."""
        if isinstance(value, list):
            if not 1 <= len(value) <= MAX_SEGMENTS or len(value[0]) < PAGE:
                return Status.INVALID if self.state is State.READY else Status.NOT_READY
            value = b"".join(value)
        return self._wait("PUT", key, value, 0, done)

    def delete_async(self, key: int, done: Callable[[int], None] | None = None) -> int:
        return self._wait("DEL", key, None, 0, done)

    def get_async(self, key: int, done: Callable[[int, int | None, bytes | None], None], buffer: int = MAX_VALUE) -> int:
        """`done` gets (status, length, value); a buffer that is too small is INVALID here, with the length."""
        return self._wait("GET", key, None, buffer, done)

    def pending(self) -> int:
        """Asynchronous operations that wait."""
        return len(self.waiting)

    def _wait(self, kind: str, key: int, value: bytes | None, buffer: int, done: Callable | None) -> int:
        if self.state is not State.READY:
            return Status.NOT_READY
        if (kind == "PUT" and not value) or (kind == "GET" and buffer <= 0):
            return Status.INVALID
        if len(self.waiting) >= self.meta["options"]["queue_size"]:
            return Status.BUSY
        self.waiting.append((kind, key, value, buffer, done))
        return Status.OK

    def _answer(self) -> None:
        """All waiting operations in order, on one look at the log for all their keys."""
        if not self.waiting:
            return
        batch = list(self.waiting)
        self.waiting.clear()
        keys = sorted({_signed(key) for kind, key, _, _, _ in batch if kind != "PUT"} - {x[0] for x in self.buffer})
        held: dict[int, bytes | None] = {}
        for k in range(0, len(keys), 1000):
            asked = self._log().where(F.col("key").isin(keys[k : k + 1000]))
            held |= {r.key: bytes(r.value) for r in view.live(asked).select("key", "value").collect()}
        held |= {x[0]: x[3] for x in self.buffer}
        for kind, key, value, buffer, done in batch:
            now = held.get(_signed(key))
            if kind == "GET":
                size = None if now is None else len(now)
                result = (Status.NOT_FOUND, None, None) if now is None else (Status.OK, size, now) if size <= buffer else (Status.INVALID, size, None)
            elif kind == "DEL" and now is None:
                result = (Status.NOT_FOUND,)
            elif kind == "PUT" and len(value) > MAX_VALUE:
                result = (Status.TOO_SMALL,)
            else:
                self._append(key, kind, value)
                held[_signed(key)] = value
                result = (Status.OK,)
            if done:
                done(*result)

    # -- counters

    def stats(self) -> dict:
        """Counters over all that was written: neither a checkpoint, a compaction nor a reopening changes them."""
        self._flush()
        data, garbage, entries = self._counters()
        slots = capacity_for(self.meta["options"]["max_entries"], self.meta["options"]["load_factor"])
        return {"total_data_bytes": data, "total_garbage_bytes": garbage, "entry_count": entries, "garbage_ratio": garbage * 100 // data if data else 0, "load_factor": entries / slots, "pending": len(self.waiting)}

    def _counters(self) -> tuple[int, int, int]:
        """(data bytes, garbage bytes, keys ever put): the manifest's, and what the log since then adds to them."""
        found = stats.added(self._log(True)).first()
        return self.meta["counted"]["data"] + found.data, self.meta["counted"]["garbage"] + found.garbage, found.entries

    def _count(self) -> None:
        """Takes the counters into the manifest; the folders there are counted from now on."""
        data, garbage, _ = self._counters()
        self.meta["counted"] = {"data": data, "garbage": garbage}
        for f in self.meta["files"]:
            f["counted"] = True

    # -- two-phase puts: rows are staged in a folder of their own, and count from the commit on

    def stage(self, rows: DataFrame) -> tuple[str, int]:
        """Writes rows (key, seq, op, value) aside; the slot that commits them, and its epoch."""
        slot = f"staging/{uuid.uuid4().hex}"
        _accepted(rows).write.parquet(f"{self.folder.path}/{slot}")
        self.meta["staged"][slot] = self.meta["epoch"]
        self._publish()
        return slot, self.meta["epoch"]

    def commit_slot(self, slot: str, epoch: int) -> int:
        """Appends what was staged; a slot that isn't there, was committed already, or is of another epoch (the store
        was reopened since) is invalid. The manifest that names the rows drops the slot, so it counts once."""
        if self.state is not State.READY:
            return Status.NOT_READY
        if self.meta["staged"].get(slot) != epoch or epoch != self.meta["epoch"]:
            return Status.INVALID
        self._flush()
        self._write(self._effective(self.spark.read.schema(_STAGED).parquet(f"{self.folder.path}/{slot}")), slot)
        self.folder.delete(slot)
        return Status.OK

    # -- maintenance

    def poll(self, foreground: int | None = None) -> int:
        """What the loop between operations does, in order: answers, flush if due, checkpoint if due, and a step of
        compaction as far as `foreground` operations (those that wait, if not given) leave room."""
        if self.state is not State.READY:
            return Status.NOT_READY
        load = len(self.waiting) if foreground is None else foreground
        self._answer()
        options = self.meta["options"]
        full = self.buffered_bytes >= options["flush_buffers"] * options["buffer_bytes"]
        if self.buffer and (full or len(self.buffer) >= options["flush_entries"] or 1000 * (time.monotonic() - self.buffered_since) >= options["flush_ms"]):
            self._flush()
        status = self.checkpoint() if self.checkpoint_due() else Status.OK
        self._compaction_step(load)
        return status

    def checkpoint_due(self) -> bool:
        options, changed = self.meta["options"], self.meta["since_checkpoint"]
        waited = time.monotonic() - self.checkpointed >= options["checkpoint_seconds"]
        return changed > 0 and (changed >= options["checkpoint_bytes"] or waited or len(self.meta["dirty"]) >= options["checkpoint_segments"])

    def checkpoint(self) -> int:
        """Writes the segments that changed since the last one, tombstones too, and lets the log begin after them."""
        if self.state is not State.READY:
            return Status.NOT_READY
        self._flush()
        self._count()
        at = self.meta["next_seq"] - 1
        name = f"snapshot/{at:020d}-{uuid.uuid4().hex[:8]}"
        before = self.meta["snapshot"] or {"segments": {}}
        dirty = sorted(self.meta["dirty"])
        if dirty:
            # Of the old snapshot only the changed segments are read.
            parts = [f["dir"] for f in self.meta["files"]] + [d for s, d in before["segments"].items() if int(s) in dirty]
            rows = self._rows(parts).withColumn("segment", segment_of(F.col("key"))).where(F.col("segment").isin(dirty))
            view.latest(rows).repartition("segment").write.partitionBy("segment").parquet(f"{self.folder.path}/{name}")
        found = {n.partition("=")[2]: f"{name}/{n}" for n in self.folder.names(name) if n.startswith("segment=")}
        kept = {s: d for s, d in before["segments"].items() if int(s) not in dirty}
        self.meta |= {"snapshot": {"seq": at, "segments": kept | found}, "files": [], "since_checkpoint": 0, "dirty": [], "cut": {}}
        self._open_file()
        self._publish()
        self.checkpointed = time.monotonic()
        return Status.OK

    def located(self) -> DataFrame:
        """Effective entries of the log's files with their pages and offsets, for statistics."""
        self._flush()
        log = self._rows([f["dir"] for f in self.meta["files"]])
        placed = with_position(log.select("key", "seq", "op", "file_id", page_count(F.col("value_len")).alias("page_count")))
        return placed.withColumnRenamed("position", "offset_index")

    def files(self) -> DataFrame:
        return file_stats(self.located())

    def headers(self) -> DataFrame:
        """file_id, created and sealed (seconds; 0 while active), whether the header's checksum holds."""
        rows = [(int(i), h["created"], h["sealed"], h["crc"] == _header_crc(int(i), h)) for i, h in self.meta["headers"].items()]
        return self.spark.createDataFrame(rows, "file_id long, created long, sealed long, whole boolean")

    def schedule(self, file_ids: Iterable[int]) -> int:
        """Queues sealed files for compaction by poll(), first come first served."""
        if self.state is not State.READY:
            return Status.NOT_READY
        self.scheduled.extend(i for i in file_ids if i not in self.scheduled)
        return Status.OK

    def _compaction_step(self, load: int) -> None:
        """A scheduled file for each whole token: a poll adds one, or a half or a quarter of it under load; from 1000
        waiting operations on it pauses, until there are 100."""
        self.paused = load >= 1000 or (self.paused and load > 100)
        if self.paused or not self.scheduled:
            return
        self.tokens = min(1.0, self.tokens + (0.25 if load >= 500 else 0.5 if load >= 100 else 1.0))
        if self.tokens >= 1.0:
            self.tokens -= 1.0
            self.compact([self.scheduled.popleft()])

    def compact(self, file_ids: list[int] | None = None) -> int:
        """Rewrites sealed files (those with enough garbage, if none are named), each into a new one: their newest
        versions whose checksum holds go on with their sequences, tombstones too, as they are the index here."""
        if self.state is not State.READY:
            return Status.NOT_READY
        chosen = file_ids if file_ids is not None else [r.file_id for r in compaction.candidates(self.located()).select("file_id").collect()]
        self._flush()
        sealed = {f["file_id"] for f in self.meta["files"]} - {self.meta["active"]}
        chosen = sorted(sealed & set(chosen))
        if not chosen:
            return Status.NOT_FOUND
        self._count()
        # Only the folders of these files are read for what moves.
        rows = self._rows([f["dir"] for f in self.meta["files"] if f["file_id"] in chosen])
        newest = view.latest(self._log().select("key", "seq")).select("key", "seq")
        fine = F.col("crc") == entry_crc(F.col("key"), F.col("seq"), F.col("value"), F.col("op") == "DEL")
        target = {old: self.meta["next_file"] + k for k, old in enumerate(chosen)}
        number = F.element_at(F.create_map(*[F.lit(x).cast("long") for pair in target.items() for x in pair]), F.col("file_id"))
        moved = rows.where(fine).join(newest, ["key", "seq"], "left_semi").withColumn("file_id", number).withColumn("destination", F.col("file_id"))
        name = f"log/compact-{uuid.uuid4().hex[:8]}"
        moved.select(*_COLUMNS, "destination").write.partitionBy("destination").parquet(f"{self.folder.path}/{name}")
        written = {n: f"{name}/{n}" for n in self.folder.names(name) if n.startswith("destination=")}
        sizes = {r.file_id: r.bytes for r in self._rows(list(written.values())).groupBy("file_id").agg(F.sum(page_count(F.col("value_len")) * PAGE).alias("bytes")).collect()} if written else {}
        now = int(time.time())
        self.meta["files"] = [f for f in self.meta["files"] if f["file_id"] not in chosen]
        for n, folder in written.items():
            new = int(n.partition("=")[2])
            self.meta["files"].append({"file_id": new, "dir": folder, "bytes": sizes[new], "counted": True})
            self._header(new, created=now, sealed=now)
        for old in chosen:
            self.meta["headers"].pop(str(old), None)
        self.meta["next_file"] += len(chosen)
        self._publish()
        return Status.OK

    def verify(self) -> DataFrame:
        """key, seq of entries whose magic or checksum doesn't hold."""
        self._flush()
        return self._log().where(~_whole()).select("key", "seq")

    def vacuum(self) -> list[str]:
        """Deletes folders that neither of the two kept manifests names, staged ones of former epochs too; their
        names. So the store still opens by the older manifest."""
        self._flush()
        named = set()
        for m in [*M.all_whole(self.folder), self.meta]:
            named |= {"/".join(f["dir"].split("/")[:2]) for f in m["files"]}
            named |= {"/".join(d.split("/")[:2]) for d in (m["snapshot"] or {"segments": {}})["segments"].values()}
            named |= {s for s, epoch in m["staged"].items() if epoch == self.meta["epoch"]}
        gone = [f"{top}/{n}" for top in ("log", "snapshot", "staging") for n in self.folder.names(top) if f"{top}/{n}" not in named]
        for name in gone:
            self.folder.delete(name)
        self.meta["staged"] = {s: e for s, e in self.meta["staged"].items() if s not in gone}
        return gone

    # -- inside

    def _append(self, key: int, op: str, value: bytes | None) -> None:
        if not self.buffer:
            self.buffered_since = time.monotonic()
        self.buffer.append((_signed(key), self.meta["next_seq"], op, value))
        self.buffered_bytes += len(value or b"")
        self.meta["next_seq"] += 1
        options = self.meta["options"]
        if len(self.buffer) >= options["flush_entries"] or self.buffered_bytes >= options["flush_buffers"] * options["buffer_bytes"]:
            self._flush()

    def _buffered(self, key: int):
        return next((x for x in reversed(self.buffer) if x[0] == _signed(key)), None)

    def _flush(self) -> None:
        if self.buffer:
            rows, self.buffer, self.buffered_bytes = self.buffer, [], 0
            self._write(self.spark.createDataFrame(rows, _STAGED))

    def _header(self, file_id: int, created: int, sealed: int = 0) -> None:
        head = {"created": created, "sealed": sealed}
        self.meta["headers"][str(file_id)] = head | {"crc": _header_crc(file_id, head)}

    def _open_file(self) -> None:
        """Seals the active file and opens the next one."""
        now = int(time.time())
        active = self.meta.get("active")
        if str(active) in self.meta["headers"]:
            self._header(active, self.meta["headers"][str(active)]["created"], now)
        self.meta["active"] = self.meta["next_file"]
        self.meta["next_file"] += 1
        named = {f["file_id"] for f in self.meta["files"]}
        if len(named) >= MAX_FILES:
            raise RuntimeError("the store has all its files; checkpoint or compact it")
        self.meta["headers"] = {i: h for i, h in self.meta["headers"].items() if int(i) in named}
        self._header(self.meta["active"], now)

    def _write(self, rows: DataFrame, slot: str | None = None) -> None:
        name = f"log/{self.meta['active']:06d}-{uuid.uuid4().hex[:8]}"
        deleted = F.col("op") == "DEL"
        full = rows.withColumns({"value_len": value_length(F.col("value")), "file_id": F.lit(self.meta["active"]).cast("long"), "crc": entry_crc(F.col("key"), F.col("seq"), F.col("value"), deleted), "magic": F.lit(MAGIC).cast("long")})
        full.write.parquet(f"{self.folder.path}/{name}")
        done = self._rows([name]).agg(F.sum(page_count(F.col("value_len")) * PAGE).alias("size"), F.max("seq").alias("top"), F.collect_set(segment_of(F.col("key"))).alias("segments")).first()
        size = done.size or 0
        self.meta["next_seq"] = max(self.meta["next_seq"], (done.top or 0) + 1)
        self.meta["files"].append({"file_id": self.meta["active"], "dir": name, "bytes": size})
        self.meta["since_checkpoint"] += size
        self.meta["dirty"] = sorted({*self.meta["dirty"], *done.segments})  # 80 at most
        if slot:
            self.meta["staged"].pop(slot)
        if sum(f["bytes"] for f in self.meta["files"] if f["file_id"] == self.meta["active"]) >= self.meta["options"]["data_file_size"]:
            self._open_file()
        self._publish()

    def _effective(self, rows: DataFrame) -> DataFrame:
        """Rows without deletes of keys that were never put, which write nothing: so every key of the log was."""
        deletes = rows.where(F.col("op") == "DEL")
        if deletes.isEmpty():
            return rows
        put = self._log().select("key").unionByName(rows.where(F.col("op") == "PUT").select("key")).distinct()
        return rows.where(F.col("op") == "PUT").unionByName(deletes.join(put, "key", "left_semi"))

    def _publish(self) -> None:
        self.meta["version"] += 1
        M.commit(self.folder, self.meta)

    def _recover(self) -> None:
        """Finds, in the log's folders, where a checksum fails: from there on a folder isn't trusted. Rows without the
        magic are passed over. One scan; a damaged folder is a row."""
        parts = [f["dir"] for f in self.meta["files"]]
        if not parts:
            return
        bad = self._rows(parts, trusted=False).where((F.col("magic") == MAGIC) & ~_whole())
        for r in bad.withColumn("dir", _folder_name()).groupBy("dir").agg(F.min("seq").alias("seq")).collect():
            self.meta["cut"][r.dir] = r.seq

    def _rows(self, parts: list[str], trusted: bool = True) -> DataFrame:
        if not parts:
            return self.spark.createDataFrame([], ROW)
        rows = self.spark.read.schema(ROW).parquet(*[f"{self.folder.path}/{p}" for p in parts])
        if not trusted:
            return rows
        rows = rows.where(F.col("magic") == MAGIC)
        if self.meta["cut"]:
            name = _folder_name()
            for folder, seq in sorted(self.meta["cut"].items()):
                rows = rows.where((name != folder) | (F.col("seq") < seq))
        return rows

    def _log(self, marked: bool = False) -> DataFrame:
        """The snapshot and the log after it; `marked` tells which rows the manifest's counters hold."""
        snapshot = list((self.meta["snapshot"] or {"segments": {}})["segments"].values())
        if not marked:
            return self._rows([f["dir"] for f in self.meta["files"]] + snapshot)
        counted = [f["dir"] for f in self.meta["files"] if f.get("counted")] + snapshot
        fresh = [f["dir"] for f in self.meta["files"] if not f.get("counted")]
        return self._rows(counted).withColumn("counted", F.lit(True)).unionByName(self._rows(fresh).withColumn("counted", F.lit(False)))


def _accepted(rows: DataFrame) -> DataFrame:
    """Rows (key, seq, op, value) without empty puts."""
    kept = rows.where((F.col("op") == "DEL") | (F.octet_length("value") > 0))
    return kept.select("key", "seq", "op", F.col("value").cast("binary").alias("value"))


def _whole():
    return (F.col("magic") == MAGIC) & (F.col("crc") == entry_crc(F.col("key"), F.col("seq"), F.col("value"), F.col("op") == "DEL"))


def _folder_name():
    """The folder of the store that a row was read from: log/<name>, with the destination of a compacted one."""
    return F.regexp_extract(F.input_file_name(), r"(log/[^/]+(?:/destination=\d+)?)/[^/]+$", 1)


def _header_crc(file_id: int, head: dict) -> int:
    return zlib.crc32(json.dumps([file_id, head["created"], head["sealed"]]).encode())


def _signed(key: int) -> int:
    """The 64-bit pattern of an unsigned key, as a signed number."""
    return key - (1 << 64) if key >= 1 << 63 else key
