"""Laser scans in E57 files (ASTM E2807) as a data source: points, scan metadata and pictures, read and written by Spark's tasks.

A file is a row of checksummed pages; behind its header lie binary sections, at its end an XML tree that names them. The
points of a scan are a compressed vector: packets of at most 64 KB that hold, for each field, a piece of that field's stream
of floats or bit-packed integers. A scan is cut into ranges of its packets' bytes, one for each task. A task reads the packets'
headers up to its range (a few bytes in 64 KB) to know which record each stream has come to, then decodes with numpy the
fields that are asked for and no others; records that begin before a range and end in it belong to it.

    spark.read.format("e57").schema("scan int, x double, y double, z double").load(folder)     points
    spark.read.format("e57").option("part", "scans").load(folder)                              scans and their poses
    spark.read.format("e57").option("part", "images").load(folder)                             pictures and their poses

Points: a schema of fewer columns decodes fewer fields; option "guids" (a JSON list) chooses scans before anything is read.
(Conditions are not pushed down: Spark 4.1 keeps a Python reader's filters for later queries on the same frame.) Coordinates are those of the site: the scan's pose is applied unless option "transform" is "false"; spherical ones are
turned into x, y, z where a scan has no Cartesian ones.

Cases: a scan without points, or a file without scans, has no point rows; missing fields are null, missing guids are scan_0,
scan_1, ... and img_0, img_1, ...; a pose with gaps is the identity there; a picture without a pose has no position; of
several representations the spherical is taken, then pinhole, then cylindrical, JPEG before PNG; a page whose checksum is
wrong fails the read and is named; `bad_pages` lists all such pages; other damage (no E57 header, packets that do not fit, fewer
records than stated) fails too. Integer fields of more than 63 bits are not read.
"""

from __future__ import annotations

import json
import struct
import uuid
import xml.etree.ElementTree as ET
from collections import OrderedDict
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage
from pyspark.sql.pandas.types import to_arrow_schema

from quillmesh.sources.files import Bytes, batches, listed, located

# Fixed values of the format: sizes, signatures, section and packet types, field names.
PAGE, HEADER, SIGNATURE = 1024, "<8sIIQQQQ", b"ASTM-E57"
BLOB_SECTION, VECTOR_SECTION = 0, 1
INDEX_PACKET, DATA_PACKET = 0, 1
PACKET_BYTES = 1 << 16
NAMESPACE = "http://www.astm.org/COMMIT/E57/2010-e57-v1.0"
FIELDS = {"x": "cartesianX", "y": "cartesianY", "z": "cartesianZ", "invalid": "cartesianInvalidState", "r": "colorRed", "g": "colorGreen", "b": "colorBlue", "intensity": "intensity"}
SPHERICAL = ("sphericalRange", "sphericalAzimuth", "sphericalElevation")

#: Pages that are read and checked together, and how many such runs a reader keeps.
RUN, HELD = 64, 128
#: Bytes of packets in a task's range, records decoded at a time, and points in a file that a task writes.
SPLIT_BYTES, CHUNK, FILE_POINTS = 32 << 20, 1 << 16, 1 << 20

POINTS = "path string, scan int, guid string, n long, x double, y double, z double, invalid int, r int, g int, b int, intensity double"
_POSE = "rotation struct<w:double,x:double,y:double,z:double>, translation struct<x:double,y:double,z:double>"
SCANS = f"path string, scan int, guid string, name string, {_POSE}, points long"
IMAGES = f"path string, image int, guid string, name string, scan_guid string, {_POSE}, representation string, coding string, picture binary"


class Corrupt(ValueError):
    """A file that is not what its header, checksums or packets say."""


# ---- pages


def _crc_table() -> np.ndarray:
    value = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        value = np.where(value & 1, (value >> 1) ^ np.uint32(0x82F63B78), value >> 1)
    return value


_CRC = _crc_table()


def checksums(pages: np.ndarray) -> np.ndarray:
    """CRC-32C of each row of bytes: row by row where they are few, else a byte of all rows at a time."""
    if len(pages) < 16:
        return np.array([_checksum(row.tobytes()) for row in pages], np.uint32)
    crc = np.full(len(pages), 0xFFFFFFFF, np.uint32)
    for column in np.ascontiguousarray(pages.T):
        crc = _CRC[(crc ^ column) & 0xFF] ^ (crc >> 8)
    return ~crc


def _checksum(data: bytes, table: tuple = tuple(_CRC.tolist())) -> int:
    crc = 0xFFFFFFFF
    for b in data:
        crc = table[(crc ^ b) & 0xFF] ^ (crc >> 8)
    return crc ^ 0xFFFFFFFF


class Paged:
    """The bytes of a file without its checksums, which are looked at whenever a page is read."""

    def __init__(self, path: str):
        self.path, self.data, self.page = path, Bytes(path, 1 << 20), PAGE
        head = self.data.read(0, struct.calcsize(HEADER))
        if len(head) < struct.calcsize(HEADER) or head[:8] != SIGNATURE:
            raise Corrupt(f"{path} is no E57 file")
        _, _, _, self.length, self.xml_at, self.xml_length, self.page = struct.unpack(HEADER, head)
        if self.page < 64 or self.length > self.data.size:
            raise Corrupt(f"{path} ends before its stated length")
        self.own = self.page - 4
        self.held: OrderedDict[int, bytes] = OrderedDict()

    def logical(self, physical: int) -> int:
        page, inner = divmod(physical, self.page)
        return page * self.own + min(inner, self.own)

    def bad(self, first: int, n: int) -> np.ndarray:
        """Numbers of the pages from `first` on, n at most, whose checksum is wrong."""
        raw = np.frombuffer(self.data.read(first * self.page, n * self.page), np.uint8)
        rows = raw[: len(raw) // self.page * self.page].reshape(-1, self.page)
        stated = rows[:, self.own :].copy().view(">u4")[:, 0]
        return first + np.flatnonzero(checksums(rows[:, : self.own]) != stated)

    def block(self, k: int) -> bytes:
        """The k-th run of RUN pages without their checksums; the last HELD are kept, so fields of the same packets cost one check."""
        if k in self.held:
            self.held.move_to_end(k)
            return self.held[k]
        wrong = self.bad(k * RUN, RUN)
        if len(wrong):
            raise Corrupt(f"{self.path}: checksum of page {wrong[0]} (byte {wrong[0] * self.page})")
        raw = np.frombuffer(self.data.read(k * RUN * self.page, RUN * self.page), np.uint8)
        self.held[k] = raw[: len(raw) // self.page * self.page].reshape(-1, self.page)[:, : self.own].tobytes()
        if len(self.held) > HELD:
            self.held.popitem(last=False)
        return self.held[k]

    def read(self, at: int, n: int) -> bytes:
        """n bytes from a place that does not count checksums."""
        run, parts, want = RUN * self.own, [], n
        while want > 0:
            k, inner = divmod(at, run)
            part = self.block(k)[inner : inner + want]
            if not part:
                raise Corrupt(f"{self.path} ends inside a section")
            parts.append(part)
            at, want = at + len(part), want - len(part)
        return b"".join(parts)

    def close(self) -> None:
        self.data.close()


# ---- the tree


@dataclass
class Field:
    """How a field's values lie in its stream."""

    name: str
    kind: str
    low: int = 0
    bits: int = 0
    scale: float = 1.0
    offset: float = 0.0

    def decode(self, data: bytes, skip: int, n: int) -> np.ndarray:
        """n values, the first of which begins `skip` bits into the bytes."""
        if self.kind == "Float":
            return np.frombuffer(data, "<f4" if self.bits == 32 else "<f8", n).astype(np.float64)
        if self.bits == 0:
            raw = np.zeros(n, np.int64)
        else:
            flat = np.unpackbits(np.frombuffer(data, np.uint8), bitorder="little")[skip : skip + n * self.bits].reshape(n, self.bits)
            raw = np.zeros(n, np.int64)
            for k in range(self.bits):
                raw |= flat[:, k].astype(np.int64) << k
        raw += self.low
        return raw * self.scale + self.offset if self.kind == "ScaledInteger" else raw


@dataclass
class Scan:
    number: int
    guid: str
    name: str | None
    rotation: dict[str, float]
    translation: dict[str, float]
    at: int = 0
    count: int = 0
    fields: list[Field] = field(default_factory=list)

    def world(self, x: np.ndarray, y: np.ndarray, z: np.ndarray) -> list[np.ndarray]:
        w, i, j, k = (self.rotation[a] for a in "wxyz")
        turned = [
            x * (1 - 2 * (j * j + k * k)) + y * (2 * (i * j - w * k)) + z * (2 * (i * k + w * j)),
            x * (2 * (i * j + w * k)) + y * (1 - 2 * (i * i + k * k)) + z * (2 * (j * k - w * i)),
            x * (2 * (i * k - w * j)) + y * (2 * (j * k + w * i)) + z * (1 - 2 * (i * i + j * j)),
        ]
        return [t + self.translation[a] for t, a in zip(turned, "xyz", strict=True)]


def _text(node, name: str) -> str | None:
    found = None if node is None else node.find(name)
    return None if found is None else (found.text or "").strip()


def _numbers(node, names: str, defaults: dict[str, float]) -> dict[str, float]:
    return {k: defaults[k] if _text(node, k) is None else float(_text(node, k) or 0) for k in names}


def _pose(node) -> tuple[dict[str, float], dict[str, float]]:
    pose = node.find("pose")
    none = pose is None
    return _numbers(None if none else pose.find("rotation"), "wxyz", {"w": 1.0, "x": 0.0, "y": 0.0, "z": 0.0}), _numbers(None if none else pose.find("translation"), "xyz", dict.fromkeys("xyz", 0.0))


def _field(node) -> Field:
    kind, get = node.get("type"), node.get
    if kind == "Float":
        return Field(node.tag, kind, bits=32 if get("precision") == "single" else 64)
    low, high = int(get("minimum", -(2**63))), int(get("maximum", 2**63 - 1))
    return Field(node.tag, kind, low, (high - low).bit_length(), float(get("scale", 1)), float(get("offset", 0)))


class Tree:
    """What a file's XML says."""

    def __init__(self, paged: Paged):
        raw = paged.read(paged.logical(paged.xml_at), paged.xml_length)
        try:
            root = ET.fromstring(raw)
        except ET.ParseError as e:
            raise Corrupt(f"{paged.path}: {e}") from None
        for node in root.iter():
            node.tag = node.tag.rpartition("}")[2]
        self.scan_nodes, self.image_nodes = (list(root.find(k)) if root.find(k) is not None else [] for k in ("data3D", "images2D"))

    def scans(self) -> Iterator[Scan]:
        for i, node in enumerate(self.scan_nodes):
            guid, name, points = _text(node, "guid"), _text(node, "name"), node.find("points")
            out = Scan(i, f"scan_{i}" if guid is None else guid, f"Scan {i}" if name is None else name, *_pose(node))
            if points is not None:
                out.at, out.count = int(points.get("fileOffset", 0)), int(points.get("recordCount", 0))
                prototype = points.find("prototype")
                out.fields = [_field(f) for f in (prototype if prototype is not None else ())]
            yield out

    def images(self, paged: Paged) -> Iterator[tuple]:
        for i, node in enumerate(self.image_nodes):
            guid, name, posed = _text(node, "guid"), _text(node, "name"), node.find("pose") is not None
            rotation, translation = _pose(node)
            found = ((kind, coding, node.find(f"{kind}Representation/{coding}Image")) for kind in ("spherical", "pinhole", "cylindrical") for coding in ("jpeg", "png"))
            kind, coding, blob = next((f for f in found if f[2] is not None), (None, None, None))
            yield (
                paged.path, i, f"img_{i}" if guid is None else guid, f"Image_{i}" if name is None else name, _text(node, "associatedData3DGuid"),
                rotation, translation if posed else None, kind, coding, None if blob is None else _blob(paged, blob),
            )


def _blob(paged: Paged, node) -> bytes:
    at = paged.logical(int(node.get("fileOffset")))
    if paged.read(at, 1)[0] != BLOB_SECTION:
        raise Corrupt(f"{paged.path}: no picture at byte {node.get('fileOffset')}")
    return paged.read(at + 16, int(node.get("length")))


# ---- points


def section(paged: Paged, scan: Scan) -> tuple[int, int]:
    """Where the packets of a scan begin and end."""
    at = paged.logical(scan.at)
    kind, length, data_at, _ = struct.unpack("<B7xQQQ", paged.read(at, 32))
    if kind != VECTOR_SECTION:
        raise Corrupt(f"{paged.path}: no points at byte {scan.at}")
    return paged.logical(data_at), at + length


class Packets:
    """The packets of a scan up to a place: where each stream's piece lies, and how much of the stream came before it."""

    def __init__(self, paged: Paged, scan: Scan, until: int):
        self.paged, self.scan = paged, scan
        at, end = section(paged, scan)
        n = len(scan.fields)
        self.starts: list[int] = []
        self.pieces: list[list[int]] = []
        self.before: list[list[int]] = [[0] * n]
        while at < min(end, until):
            kind, _, length = struct.unpack("<BBH", paged.read(at, 4))
            length += 1
            if kind == DATA_PACKET:
                sizes = struct.unpack(f"<H{n}H", paged.read(at + 4, 2 + 2 * n))
                if sizes[0] != n or 6 + 2 * n + sum(sizes[1:]) > length:
                    raise Corrupt(f"{paged.path}: packet at {at} does not fit scan {scan.number}")
                place, places = at + 6 + 2 * n, []
                for size in sizes[1:]:
                    places.append(place)
                    place += size
                self.starts.append(at)
                self.pieces.append(places)
                self.before.append([b + s for b, s in zip(self.before[-1], sizes[1:], strict=True)])
            at += length
        self.ended = at >= end

    def records(self, before: int) -> int:
        """How many records lie whole in the packets that begin before a place."""
        i = int(np.searchsorted(self.starts, before))
        if self.ended and i == len(self.starts):
            done = [8 * b // f.bits for b, f in zip(self.before[-1], self.scan.fields, strict=True) if f.bits]
            if done and min(done) < self.scan.count:
                raise Corrupt(f"{self.paged.path}: scan {self.scan.number} holds {min(done)} of {self.scan.count} records")
            return self.scan.count
        return min([self.scan.count, *(8 * b // f.bits for b, f in zip(self.before[i], self.scan.fields, strict=True) if f.bits)])

    def values(self, k: int, first: int, n: int) -> np.ndarray:
        """n values of a field from a record on."""
        f = self.scan.fields[k]
        low, high = first * f.bits // 8, -(-(first + n) * f.bits // 8)
        parts, reached = [], [b[k] for b in self.before]
        i = max(0, int(np.searchsorted(reached, low, "right")) - 1)
        while low < high:
            take = min(high, reached[i + 1]) - low
            if take > 0:
                parts.append(self.paged.read(self.pieces[i][k] + low - reached[i], take))
                low += take
            i += 1
        return f.decode(b"".join(parts), first * f.bits % 8, n)


def decoded(paged: Paged, scan: Scan, low: int, high: int, names: list[str], transform: bool) -> Iterator[dict[str, np.ndarray]]:
    """Columns of the records that the packets in [low, high) complete, some 65,536 at a time."""
    packets = Packets(paged, scan, high)
    place = {f.name: k for k, f in enumerate(scan.fields)}
    first, last = (0 if low <= section(paged, scan)[0] else packets.records(low)), packets.records(high)
    polar = FIELDS["x"] not in place and all(s in place for s in SPHERICAL)
    turned = transform and any(k in names for k in "xyz")
    for at in range(first, last, CHUNK):
        n = min(CHUNK, last - at)
        out: dict[str, np.ndarray] = {"n": np.arange(at, at + n)}
        for name in {*names, *("xyz" if turned else "")}:
            if FIELDS.get(name) in place:
                out[name] = packets.values(place[FIELDS[name]], at, n)
        if polar and any(k in names for k in "xyz"):
            far, round_, up = (packets.values(place[s], at, n) for s in SPHERICAL)
            out |= {"x": far * np.cos(up) * np.cos(round_), "y": far * np.cos(up) * np.sin(round_), "z": far * np.sin(up)}
        if turned and all(k in out for k in "xyz"):
            out |= dict(zip("xyz", scan.world(out["x"], out["y"], out["z"]), strict=True))
        yield out


# ---- the data source


class E57Files(DataSource):
    """format("e57"): reads *.e57; writes points. Options: path; part (points, scans, images); transform; guids; splitBytes."""

    @classmethod
    def name(cls) -> str:
        return "e57"

    def schema(self) -> str:
        return {"points": POINTS, "scans": SCANS, "images": IMAGES}[self.options.get("part", "points")]

    def reader(self, schema) -> DataSourceReader:
        part = self.options.get("part", "points")
        if part != "points":
            return _Records(self.options["path"], to_arrow_schema(schema), part)
        return _Points(self.options["path"], to_arrow_schema(schema), self.options.get("transform", "true").lower() != "false", int(self.options.get("splitBytes", SPLIT_BYTES)), json.loads(self.options["guids"]) if "guids" in self.options else None)

    def writer(self, schema, overwrite: bool) -> DataSourceArrowWriter:
        return _Writer(self.options["path"], int(self.options.get("filePoints", FILE_POINTS)))


class _Records(DataSourceReader):
    """Scans or images: a task for each file."""

    def __init__(self, path: str, arrow: pa.Schema, part: str):
        self.path, self.arrow, self.part = path, arrow, part

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(path) for path, _ in listed(self.path, ".e57")]

    def read(self, partition: InputPartition | None) -> Iterator[pa.RecordBatch]:
        if partition is None:
            return
        paged = Paged(partition.value)
        tree = Tree(paged)
        rows = tree.images(paged) if self.part == "images" else ((paged.path, s.number, s.guid, s.name, s.rotation, s.translation, s.count) for s in tree.scans())
        names = [c.split()[0] for c in ("path image guid name scan_guid rotation translation representation coding picture" if self.part == "images" else "path scan guid name rotation translation points").split()]
        wanted = [names.index(n) for n in self.arrow.names]
        yield from batches((tuple(row[k] for k in wanted) for row in rows), self.arrow, 1024, lambda row: sum(len(v) for v in row if isinstance(v, bytes)))
        paged.close()


class _Points(DataSourceReader):
    """A task for each range of a scan's packets."""

    def __init__(self, path: str, arrow: pa.Schema, transform: bool, split: int, guids: list[str] | None):
        self.path, self.arrow, self.transform, self.split, self.guids = path, arrow, transform, split, guids

    def partitions(self) -> list[InputPartition]:
        out = []
        for path, _ in listed(self.path, ".e57"):
            paged = Paged(path)
            for scan in Tree(paged).scans():
                if scan.count and (self.guids is None or scan.guid in self.guids):
                    low, high = section(paged, scan)
                    out += [InputPartition((path, scan.number, a, min(high, a + self.split))) for a in range(low, max(high, low + 1), self.split)]
            paged.close()
        return out

    def read(self, partition: InputPartition | None) -> Iterator[pa.RecordBatch]:
        if partition is None:
            return
        path, number, low, high = partition.value
        paged = Paged(path)
        scan = next(s for s in Tree(paged).scans() if s.number == number)
        same = {"path": path, "scan": number, "guid": scan.guid}
        for columns in decoded(paged, scan, low, high, self.arrow.names, self.transform):
            n = len(columns["n"])
            held = [pa.array([same[f.name]] * n, f.type) if f.name in same else pa.array(columns[f.name]).cast(f.type) if f.name in columns else pa.nulls(n, f.type) for f in self.arrow]
            yield pa.RecordBatch.from_arrays(held, schema=self.arrow)
        paged.close()


# ---- writing


class Builder:
    """Puts a file together in memory: sections, then the tree, then pages with their checksums."""

    def __init__(self):
        self.data, self.scans, self.images = bytearray(48), [], []

    def physical(self, logical: int) -> int:
        return logical // (PAGE - 4) * PAGE + logical % (PAGE - 4)

    def blob(self, content: bytes) -> int:
        at = len(self.data)
        self.data += struct.pack("<B7xQ", BLOB_SECTION, 16 + len(content)) + content + bytes(-len(content) % 4)
        return self.physical(at)

    def scan(self, guid: str | None, name: str | None, pose: str, fields: list[Field], columns: list[np.ndarray], records: int | None = None) -> None:
        """A scan of columns as its fields say; packets are cut without regard to records, as the format allows."""
        at, n = len(self.data), len(columns[0]) if columns else 0
        streams = [packed(f, c) for f, c in zip(fields, columns, strict=True)]
        room = PACKET_BYTES - 8 - 2 * len(fields)
        many = max(1, -(-sum(map(len, streams)) // (room - 4 * len(fields)))) if n else 0
        self.data += bytes(32)
        first = len(self.data)
        for j in range(many):
            pieces = [s[len(s) * j // many : len(s) * (j + 1) // many] for s in streams]
            body = struct.pack(f"<H{len(pieces)}H", len(pieces), *map(len, pieces)) + b"".join(pieces)
            body += bytes(-(4 + len(body)) % 4)
            self.data += struct.pack("<BBH", DATA_PACKET, 0, 4 + len(body) - 1) + body
        index = len(self.data)
        self.data += struct.pack("<BBHHB9x", INDEX_PACKET, 0, 31, 1, 0) + struct.pack("<QQ", 0, self.physical(first))
        self.data[at : at + 32] = struct.pack("<B7xQQQ", VECTOR_SECTION, len(self.data) - at, self.physical(first), self.physical(index))
        tag = lambda k, v: "" if v is None else f'<{k} type="String"><![CDATA[{v}]]></{k}>'
        prototype = "".join(_prototype(f) for f in fields)
        points = f'<points type="CompressedVector" fileOffset="{self.physical(at)}" recordCount="{n if records is None else records}"><prototype type="Structure">{prototype}</prototype></points>'
        self.scans.append(f'<vectorChild type="Structure">{tag("guid", guid)}{tag("name", name)}{pose}{points}</vectorChild>')

    def image(self, inner: str) -> None:
        self.images.append(f'<vectorChild type="Structure">{inner}</vectorChild>')

    def finished(self) -> bytes:
        vector = lambda k, rows: f'<{k} type="Vector" allowHeterogeneousChildren="1">{"".join(rows)}</{k}>' if rows else ""
        tree = f'<?xml version="1.0" encoding="UTF-8"?><e57Root type="Structure" xmlns="{NAMESPACE}">{vector("data3D", self.scans)}{vector("images2D", self.images)}</e57Root>'.encode()
        at = len(self.data)
        data = self.data + tree
        data += bytes(-len(data) % (PAGE - 4))
        pages = len(data) // (PAGE - 4)
        data[:48] = struct.pack(HEADER, SIGNATURE, 1, 0, pages * PAGE, self.physical(at), len(tree), PAGE)
        rows = np.frombuffer(bytes(data), np.uint8).reshape(pages, PAGE - 4)
        return np.concatenate([rows, checksums(rows).astype(">u4").view(np.uint8).reshape(pages, 4)], 1).tobytes()


def packed(f: Field, values: np.ndarray) -> bytes:
    """A field's stream."""
    if f.kind == "Float":
        return np.asarray(values, "<f4" if f.bits == 32 else "<f8").tobytes()
    raw = (np.round((np.asarray(values) - f.offset) / f.scale).astype(np.int64) if f.kind == "ScaledInteger" else np.asarray(values, np.int64)) - f.low
    bits = ((raw[:, None] >> np.arange(f.bits)) & 1).astype(np.uint8)
    return np.packbits(bits.ravel(), bitorder="little").tobytes()


def _prototype(f: Field) -> str:
    if f.kind == "Float":
        return f'<{f.name} type="Float" precision="{"single" if f.bits == 32 else "double"}"/>'
    more = f' scale="{f.scale!r}" offset="{f.offset!r}"' if f.kind == "ScaledInteger" else ""
    return f'<{f.name} type="{f.kind}" minimum="{f.low}" maximum="{f.low + (1 << f.bits) - 1}"{more}/>'


def pose_xml(rotation: dict[str, float] | None, translation: dict[str, float] | None) -> str:
    part = lambda name, values: "" if values is None else f'<{name} type="Structure">' + "".join(f'<{k} type="Float">{v!r}</{k}>' for k, v in values.items()) + f"</{name}>"
    return f'<pose type="Structure">{part("rotation", rotation)}{part("translation", translation)}</pose>'


@dataclass
class _Files(WriterCommitMessage):
    names: list[str]


class _Writer(DataSourceArrowWriter):
    """Points (guid, x, y, z; also invalid, r, g, b, intensity) as files of bounded size, a scan for each guid in a file; the commit moves whole files to their place."""

    def __init__(self, path: str, file_points: int):
        self.path, self.file_points = path, file_points

    def write(self, iterator: Iterator[pa.RecordBatch]) -> _Files:
        system, folder = located(self.path)
        system.create_dir(f"{folder}/_written", recursive=True)
        names, held, size = [], [], 0

        def flush() -> None:
            names.append(f"{uuid.uuid4().hex}.e57")
            with system.open_output_stream(f"{folder}/_written/{names[-1]}", compression=None) as out:
                out.write(_file_of(pa.Table.from_batches(held)))
            held.clear()

        for batch in iterator:
            for at in range(0, batch.num_rows, self.file_points):
                part = batch.slice(at, self.file_points)
                if held and size + part.num_rows > self.file_points:
                    flush()
                    size = 0
                held.append(part)
                size += part.num_rows
        if held:
            flush()
        return _Files(names)

    def commit(self, messages: list[_Files | None]) -> None:
        system, folder = located(self.path)
        system.create_dir(folder, recursive=True)
        for m in messages:
            for name in m.names if m else ():
                system.move(f"{folder}/_written/{name}", f"{folder}/{name}")
        self.abort(messages)

    def abort(self, messages: list[_Files | None]) -> None:
        system, folder = located(self.path)
        if system.get_file_info(f"{folder}/_written").type == fs.FileType.Directory:
            system.delete_dir(f"{folder}/_written")


def _file_of(table: pa.Table) -> bytes:
    out = Builder()
    for guid in sorted(set(table["guid"].to_pylist()), key=str):
        rows = table.filter(pc.equal(table["guid"], guid) if guid is not None else pc.is_null(table["guid"]))
        fields, columns = [], []
        for name in (n for n in FIELDS if n in table.column_names):
            values = rows[name].to_numpy(zero_copy_only=False)
            if name in ("x", "y", "z", "intensity"):
                fields.append(Field(FIELDS[name], "Float", bits=64))
                columns.append(values.astype(np.float64))
            else:
                whole = np.nan_to_num(values.astype(np.float64)).astype(np.int64)
                fields.append(Field(FIELDS[name], "Integer", int(whole.min()), int(whole.max() - whole.min()).bit_length()))
                columns.append(whole)
        out.scan(guid, None, "", fields, columns)
    return out.finished()


# ---- for callers


def register(spark: SparkSession) -> None:
    spark.dataSource.register(E57Files)


def points(spark: SparkSession, path: str, columns: str = POINTS, guids: list[str] | None = None, **options) -> DataFrame:
    """Points of the files of a folder; name fewer columns to decode fewer fields, guids to read those scans alone."""
    register(spark)
    if guids is not None:
        options["guids"] = json.dumps(guids)
    return spark.read.format("e57").schema(columns).options(**options).load(path)


def scans(spark: SparkSession, path: str) -> DataFrame:
    register(spark)
    return spark.read.format("e57").option("part", "scans").load(path)


def images(spark: SparkSession, path: str) -> DataFrame:
    register(spark)
    return spark.read.format("e57").option("part", "images").load(path)


def write_points(rows: DataFrame, path: str, **options) -> None:
    register(rows.sparkSession)
    rows.write.format("e57").options(**options).mode("append").save(path)


def bad_pages(spark: SparkSession, path: str, pages: int = 1 << 15) -> DataFrame:
    """(path, page) of the pages whose checksum is wrong, looked for in ranges of pages."""
    ranges = [(file, first, pages) for file, size in listed(path, ".e57") for first in range(0, size // PAGE + 1, pages)]

    def look(batches_: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches_:
            for file, first, n in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                paged = Paged(file)
                for at in range(first, first + n, 1024):
                    wrong = paged.bad(at, min(1024, first + n - at))
                    yield pa.RecordBatch.from_arrays([pa.array([file] * len(wrong), pa.string()), pa.array(wrong, pa.int64())], ["path", "page"])
                paged.close()

    todo = spark.createDataFrame(ranges, "path string, first long, n long")
    return todo.repartition(max(1, len(ranges))).mapInArrow(look, "path string, page long")
