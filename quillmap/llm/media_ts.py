"""Media columns: MPEG transport streams (ISO/IEC 13818-1) made from and read back to bytes.

`mux` cuts a payload into access units, wraps each in a packetized elementary stream (PES) packet
with a timestamp, and splits these into 188-byte packets; the first packet of a unit carries the
random-access flag and the clock. `demux` reads any stream: it finds the packets, the programs and
their elementary streams by the tables (whose sections may go over several packets), checks the
continuity counters, drops packets that are sent again, reassembles the PES packets and lists
timestamps and random-access points.

Defined results: a null payload counts as empty, an empty one has one (empty) access unit; equal
payloads give equal streams; null, empty and damaged media are read as far as they can be, and
what is wrong is counted; `restore` gives the first elementary stream; repeated rows are treated
one by one; other columns are kept.
"""

from __future__ import annotations

import hashlib
import math
import zlib
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import by_document, id_and_text, ship, text_slices, to_batch

PACKET, SYNC = 188, 0x47
PMT_PID, DATA_PID, PROGRAM = 0x1000, 0x0101, 1
PRIVATE_DATA, PRIVATE_STREAM_1 = 0x06, 0xBD
UNIT_BYTES, CLOCK, UNIT_TICKS = 32_768, 90_000, 3_600


def crc32_mpeg(data: bytes) -> int:
    """The tables' checksum: polynomial 0x04C11DB7, not reflected, no final xor."""
    crc = 0xFFFFFFFF
    for byte in data:
        crc ^= byte << 24
        for _ in range(8):
            crc = (crc << 1 ^ 0x04C11DB7 if crc & 0x80000000 else crc << 1) & 0xFFFFFFFF
    return crc


def _table_packet(pid: int, table_id: int, number: int, body: bytes) -> bytes:
    head = bytes([table_id, 0xB0 | (len(body) + 9) >> 8, (len(body) + 9) & 0xFF, number >> 8, number & 0xFF, 0xC1, 0, 0])
    section = head + body
    section += crc32_mpeg(section).to_bytes(4, "big")
    return (bytes([SYNC, 0x40 | pid >> 8, pid & 0xFF, 0x10, 0]) + section).ljust(PACKET, b"\xff")


_TABLES = _table_packet(0, 0, 1, bytes([0, PROGRAM, 0xE0 | PMT_PID >> 8, PMT_PID & 0xFF])) + _table_packet(
    PMT_PID, 2, PROGRAM, bytes([0xE0 | DATA_PID >> 8, DATA_PID & 0xFF, 0xF0, 0, PRIVATE_DATA, 0xE0 | DATA_PID >> 8, DATA_PID & 0xFF, 0xF0, 0])
)


def _timestamp(ticks: int) -> bytes:
    return bytes([0x21 | ticks >> 29 & 0x0E, ticks >> 22 & 0xFF, 0x01 | ticks >> 14 & 0xFE, ticks >> 7 & 0xFF, 0x01 | ticks << 1 & 0xFE])


def _unit_packets(data: bytes, ticks: int, counter: int) -> tuple[bytes, int]:
    pes = b"\x00\x00\x01" + bytes([PRIVATE_STREAM_1]) + (len(data) + 8).to_bytes(2, "big") + b"\x80\x80\x05" + _timestamp(ticks) + data
    first = 176  # the first packet has 8 bytes of adaptation field: length, flags, clock
    n = 1 + max(0, -(-(len(pes) - first) // 184))
    out = np.full((n, PACKET), 0xFF, np.uint8)
    out[:, 0] = SYNC
    out[:, 1] = DATA_PID >> 8
    out[0, 1] |= 0x40
    out[:, 2] = DATA_PID & 0xFF
    out[:, 3] = 0x10 | (np.arange(counter, counter + n) & 15)
    body = np.frombuffer(pes, np.uint8)
    out[0, 3] |= 0x20
    clock = ticks & (1 << 33) - 1
    out[0, 5:12] = np.frombuffer(bytes([0x50]) + (clock << 15 | 0x3F << 9).to_bytes(6, "big"), np.uint8)
    if n == 1:
        out[0, 4] = 183 - len(pes)
        out[0, PACKET - len(pes) :] = body
        return out.tobytes(), counter + n
    out[0, 4] = 7
    out[0, 12:] = body[:first]
    whole = (len(pes) - first) // 184
    out[1 : 1 + whole, 4:] = body[first : first + 184 * whole].reshape(whole, 184)
    rest = len(pes) - first - 184 * whole
    if rest:
        out[-1, 3] |= 0x20
        out[-1, 4] = 183 - rest
        if rest < 183:
            out[-1, 5] = 0
        out[-1, PACKET - rest :] = body[len(pes) - rest :]
    return out.tobytes(), counter + n


def mux(payload: bytes, unit_bytes: int = UNIT_BYTES) -> bytes:
    """The payload as one transport stream."""
    parts, counter = [_TABLES], 0
    for k in range(max(1, -(-len(payload) // unit_bytes))):
        packets, counter = _unit_packets(payload[k * unit_bytes : (k + 1) * unit_bytes], CLOCK + k * UNIT_TICKS, counter)
        parts.append(packets)
    return b"".join(parts)


#: packet number, timestamp (or -1), bytes, random access, decoding timestamp (or -1)
Unit = tuple[int, int, int, bool, int]


@dataclass
class Elementary:
    """One elementary stream of a program."""

    pid: int
    kind: int
    program: int
    payload: bytes = b""
    units: list[Unit] = field(default_factory=list)


@dataclass
class Stream:
    """What a transport stream holds, and what is wrong with it. `payload`, `program`, `table_pid`,
    `pid`, `kind` and `units` are those of the first elementary stream."""

    payload: bytes = b""
    program: int = -1
    table_pid: int = -1
    pid: int = -1
    kind: int = -1
    packets: int = 0
    sync_errors: int = 0  #: places where no packet begins and the next one is looked for
    lost_bytes: int = 0  #: bytes that belong to no packet
    packet_errors: int = 0  #: packets marked as damaged, or with a field that can't be
    counter_errors: int = 0  #: gaps in the continuity counters
    duplicates: int = 0  #: packets sent twice in a row, as the standard allows
    table_errors: int = 0  #: sections with a wrong checksum or length
    unit_errors: int = 0  #: elementary packets without a valid header or with too few bytes
    programs: dict[int, int] = field(default_factory=dict)  #: program and the identifier of its map
    streams: list[Elementary] = field(default_factory=list)
    units: list[Unit] = field(default_factory=list)


def _starts(media: bytes, out: Stream) -> np.ndarray:
    """Where the packets begin. After damage, the next place counts at which packets follow one another."""
    whole = np.arange(len(media) // PACKET) * PACKET
    if len(media) % PACKET == 0 and (np.frombuffer(media, np.uint8)[whole] == SYNC).all():
        return whole
    found, at = [], 0
    while at + PACKET <= len(media):
        if media[at] == SYNC:
            found.append(at)
            at += PACKET
            continue
        out.sync_errors += 1
        after = at + 1
        while 0 <= (after := media.find(b"\x47", after)):
            if all(media[k] == SYNC for k in (after + PACKET, after + 2 * PACKET) if k < len(media)):
                break
            after += 1
        after = len(media) if after < 0 else after
        out.lost_bytes += after - at
        at = after
    out.lost_bytes += max(0, len(media) - at)
    return np.array(found, np.int64)


@dataclass
class _Packets:
    """The fields of all packets."""

    grid: np.ndarray
    pid: np.ndarray
    begins: np.ndarray  #: whether a unit or section begins in the packet
    counter: np.ndarray
    data: np.ndarray  #: where the data begins; PACKET if there are none
    access: np.ndarray
    jump: np.ndarray  #: the counter may go on anywhere
    fine: np.ndarray


def _fields(media: bytes, out: Stream) -> _Packets:
    at = _starts(media, out)
    raw = np.frombuffer(media, np.uint8)
    grid = raw[: len(at) * PACKET].reshape(-1, PACKET) if not out.sync_errors else raw[at[:, None] + np.arange(PACKET)]
    one, three, length = grid[:, 1], grid[:, 3], grid[:, 4].astype(np.int64)
    adapted, filled = three & 0x20 != 0, three & 0x10 != 0
    fine = (one & 0x80 == 0) & (adapted | filled) & ~(adapted & (length > np.where(filled, 182, 183)))
    flagged = adapted & (length > 0)
    data = np.where(filled, np.where(adapted, 5 + length, 4), PACKET)
    out.packets, out.packet_errors = len(grid), int((~fine).sum())
    pid = (one.astype(np.int32) & 0x1F) << 8 | grid[:, 2]
    return _Packets(grid, pid, one & 0x40 != 0, three & 15, data, flagged & (grid[:, 5] & 0x40 != 0), flagged & (grid[:, 5] & 0x80 != 0), fine)


def _in_order(p: _Packets, pid: int, out: Stream) -> np.ndarray:
    """The packets of a stream that hold data, without those that are sent again."""
    rows = np.flatnonzero((p.pid == pid) & p.fine & (p.data < PACKET))
    step = (p.counter[rows][1:] - p.counter[rows][:-1]) & 15
    again = np.zeros(len(rows), bool)
    for k in np.flatnonzero(step == 0).tolist():
        x, y = rows[k], rows[k + 1]
        again[k + 1] = not again[k] and p.data[x] == p.data[y] and (p.grid[x, p.data[x] :] == p.grid[y, p.data[y] :]).all()
    out.duplicates += int(again.sum())
    out.counter_errors += int(((step != 1) & ~again[1:] & ~p.jump[rows][1:]).sum())
    return rows[~again]


def _sections(p: _Packets, pid: int, table: int, out: Stream) -> list[bytes]:
    """The valid sections of a table, which may go over several packets or share one."""
    found: list[bytes] = []
    held: bytes | None = None

    def take(last: bool) -> None:
        nonlocal held
        while held and held[0] != 0xFF:
            size = 3 + ((held[1] & 0x0F) << 8 | held[2]) if len(held) >= 3 else 1 << 30
            if size > len(held):
                out.table_errors += last
                return
            section, held = held[:size], held[size:]
            if size < 12 or crc32_cached(section):
                out.table_errors += 1
            elif section[0] == table and section[5] & 1:
                found.append(section)
        held = None

    for k in _in_order(p, pid, out).tolist():
        data = p.grid[k, p.data[k] :].tobytes()
        if p.begins[k]:
            if held is not None:
                held += data[1 : 1 + data[0]]
                take(True)
            held = data[1 + data[0] :]
        elif held is not None:
            held += data
        take(False)
    out.table_errors += bool(held)
    return list(dict.fromkeys(found))


_known_sections: dict[bytes, int] = {}


def crc32_cached(section: bytes) -> int:
    """Streams repeat few tables; a section that was checked before isn't computed again."""
    if section not in _known_sections:
        if len(_known_sections) > 1000:
            _known_sections.clear()
        _known_sections[section] = crc32_mpeg(section)
    return _known_sections[section]


def _stamp(x: bytes) -> int:
    return (x[0] & 0x0E) << 29 | x[1] << 22 | (x[2] & 0xFE) << 14 | x[3] << 7 | x[4] >> 1


#: Elementary packets of these kinds have no header behind the length: maps, padding, private data without timestamps.
_BARE = frozenset((0xBC, 0xBE, 0xBF, 0xF0, 0xF1, 0xF2, 0xF8, 0xFF))


def _unit(pes: bytes, out: Stream) -> tuple[bytes, int, int] | None:
    """(data, timestamp, decoding timestamp) of an elementary packet."""
    if pes[:3] != b"\x00\x00\x01" or len(pes) < 6:
        return None
    length, begin, shown, decoded = pes[4] << 8 | pes[5], 6, -1, -1
    if pes[3] not in _BARE:
        if len(pes) < 9 or 9 + pes[8] > len(pes):
            return None
        begin = 9 + pes[8]
        if pes[7] & 0x80 and pes[8] >= 5:
            shown = decoded = _stamp(pes[9:14])
        if pes[7] & 0xC0 == 0xC0 and pes[8] >= 10:
            decoded = _stamp(pes[14:19])
    end = 6 + length if length else len(pes)
    out.unit_errors += end > len(pes) or end < begin
    return pes[begin:end], shown, decoded


def _assemble(p: _Packets, stream: Elementary, out: Stream) -> None:
    rows = _in_order(p, stream.pid, out)
    if not len(rows):
        return
    begin = p.data[rows]
    inside = np.arange(PACKET)[None, :] >= begin[:, None]
    flat = p.grid[rows][inside].tobytes()
    offsets = np.concatenate([[0], np.cumsum(PACKET - begin)]).tolist()
    firsts = np.flatnonzero(p.begins[rows]).tolist()
    out.unit_errors += not firsts or firsts[0] > 0  # data before the first unit belong to none
    parts = []
    for first, last in zip(firsts, [*firsts[1:], len(rows)]):
        unit = _unit(flat[offsets[first] : offsets[last]], out)
        if unit is None:
            out.unit_errors += 1
            continue
        data, shown, decoded = unit
        stream.units.append((int(rows[first]), shown, len(data), bool(p.access[rows[first]]), decoded))
        parts.append(data)
    stream.payload = b"".join(parts)


def demux(media: bytes) -> Stream:
    """Read a stream: all programs of the table of programs and all their elementary streams. Damage
    is counted, not raised, and what can be read beside it is read."""
    out = Stream()
    p = _fields(media, out)
    for section in _sections(p, 0, 0, out):
        for at in range(8, len(section) - 7, 4):
            if number := section[at] << 8 | section[at + 1]:  # 0 is the network's own
                out.programs[number] = (section[at + 2] & 0x1F) << 8 | section[at + 3]
    seen: set[int] = set()
    for number, pid in out.programs.items():
        for section in _sections(p, pid, 2, out) if pid not in seen else ():
            if section[3] << 8 | section[4] != number:
                continue
            at = 12 + ((section[10] & 0x0F) << 8 | section[11])
            while at + 5 <= len(section) - 4:
                own = (section[at + 1] & 0x1F) << 8 | section[at + 2]
                if own not in {x.pid for x in out.streams}:
                    out.streams.append(Elementary(own, section[at], number))
                at += 5 + ((section[at + 3] & 0x0F) << 8 | section[at + 4])
            out.table_errors += at != len(section) - 4
        seen.add(pid)
    for stream in out.streams:
        _assemble(p, stream, out)
    if out.programs:
        out.program, out.table_pid = next(iter(out.programs.items()))
    if out.streams:
        first = out.streams[0]
        out.program, out.table_pid = first.program, out.programs[first.program]
        out.payload, out.pid, out.kind, out.units = first.payload, first.pid, first.kind, first.units
    return out


def padded(text: bytes, unit: int = 64) -> bytes:
    """Zero bytes up to a positive multiple of `unit`."""
    return text.ljust(unit * max(1, -(-len(text) // unit)), b"\0")


def feature(stream: Stream) -> str:
    """Tables, counters, timestamps and random-access points, and statistics of the samples: mean,
    deviation, mean step between neighbours, entropy in bits, distinct values."""
    samples = np.frombuffer(stream.payload, np.uint8)
    counts = np.bincount(samples, minlength=256)
    share = counts / max(1, len(samples))
    mean = float(share @ np.arange(256))
    spread = math.sqrt(max(0.0, float(share @ np.arange(256) ** 2) - mean * mean))
    step = float(np.abs(np.diff(samples.astype(np.int16))).mean()) if len(samples) > 1 else 0.0
    entropy = -float((share[counts > 0] * np.log2(share[counts > 0])).sum()) + 0.0
    units = stream.units
    errors = stream.sync_errors + stream.packet_errors + stream.counter_errors + stream.table_errors + stream.unit_errors
    return (
        f"ts packets={stream.packets} programs={len(stream.programs)} pmt={stream.table_pid} pid={stream.pid} type={stream.kind}"
        f" errors={errors} units={len(units)} first_pts={units[0][1] if units else -1} last_pts={units[-1][1] if units else -1}"
        f" last_unit_bytes={units[-1][2] if units else 0} access_points={sum(u[3] for u in units)}"
        f" mean={mean:.6f} deviation={spread:.6f} step={step:.6f} entropy={entropy:.6f} distinct={int((counts > 0).sum())}"
    )


def store(df: DataFrame, data_col: str = "payload", media_col: str = "media") -> DataFrame:
    """Add a binary column with the transport stream of a binary or string column."""
    return _with_column(df, data_col, media_col, "binary", mux)


def restore(df: DataFrame, media_col: str = "media", data_col: str = "payload") -> DataFrame:
    """Add a binary column with what the transport stream holds."""
    return _with_column(df, media_col, data_col, "binary", lambda media: demux(media).payload)


def _with_column(df: DataFrame, source: str, target: str, kind: str, fn) -> DataFrame:
    ship(df.sparkSession)
    if target in df.columns:
        raise ValueError(f"column {target} is there already")
    at = df.columns.index(source)

    def run(batches):
        for batch in batches:
            for part, values in text_slices(batch, at):
                made = pa.array([fn(x) for x in values], pa.binary())
                yield pa.RecordBatch.from_arrays([*part.columns, made], names=[*batch.schema.names, target])

    return df.mapInArrow(run, df.withColumn(target, F.lit(None).cast(kind)).schema)


def access_units(df: DataFrame, id_col: str = "doc_id", media_col: str = "media") -> DataFrame:
    """One row for each elementary packet: its stream's program and identifier, its number there, the
    number of its first packet, timestamps (-1: none), bytes, whether it is a random-access point,
    and seconds."""
    ship(df.sparkSession)
    fields = [("doc_id", pa.int64()), ("program", pa.int32()), ("pid", pa.int32()), ("unit", pa.int32()), ("packet_no", pa.int64())]
    fields += [("pts", pa.int64()), ("n_bytes", pa.int64()), ("random_access", pa.bool_()), ("dts", pa.int64())]
    schema = pa.schema(fields)

    def run(batches):
        for batch in batches:
            for part, media in text_slices(batch):
                found = zip(part.column(0).to_pylist(), map(demux, media))
                rows = [(i, x.program, x.pid, k, *u) for i, stream in found for x in stream.streams for k, u in enumerate(x.units)]
                yield to_batch([], rows, schema)

    slim = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(media_col).alias("media"))
    ddl = "doc_id long, program int, pid int, unit int, packet_no long, pts long, n_bytes long, random_access boolean, dts long"
    return slim.mapInArrow(run, ddl).withColumn("seconds", F.when(F.col("pts") >= 0, F.col("pts") / CLOCK))


def _digest(text: bytes) -> tuple:
    media = mux(padded(text))
    back = demux(media)
    read, tail = back.payload, zlib.crc32(back.payload[-64:])
    return len(text), len(read), hashlib.sha256(read).hexdigest(), tail, len(media), hashlib.sha256(media).hexdigest(), feature(back)


def digest(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each whole text padded, stored as a transport stream, read back and described: sizes and
    checksums of what was read back and of the stream, and the stream's features."""
    ship(docs.sparkSession)
    numbers = ("n_bytes", "payload_bytes", "tail_crc32", "media_bytes")
    order = ("n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature")
    schema = pa.schema([("doc_id", pa.int64()), *((c, pa.int64() if c in numbers else pa.string()) for c in order)])
    ddl = "doc_id long, " + ", ".join(f"{c} {'long' if c in numbers else 'string'}" for c in order)
    return id_and_text(docs, id_col, text_col).mapInArrow(by_document(_digest, schema), ddl)
