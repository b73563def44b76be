"""GeoTIFF files: a reader whose strips and tiles are read by tasks, and a writer of the frame that tasks fill with strips."""

from __future__ import annotations

import re
import struct
import zlib
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, replace
from xml.sax.saxutils import escape

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from gridloom.functions.dtypes import DataType
from gridloom.plans import crs
from gridloom.plans.geometry import Window

_SIZES = {1: ("B", 1), 2: ("s", 1), 3: ("H", 2), 4: ("I", 4), 6: ("b", 1), 8: ("h", 2), 9: ("i", 4), 11: ("f", 4), 12: ("d", 8), 16: ("Q", 8), 17: ("q", 8), 18: ("Q", 8)}
_FORMATS = {"u": 1, "i": 2, "f": 3}


@dataclass(frozen=True)
class Info:
    """What the header says."""

    width: int
    height: int
    bands: int
    datatype: DataType
    order: str
    compression: int
    predictor: int
    planar: int
    block: tuple[int, int]  # width, height
    offsets: tuple[int, ...]
    counts: tuple[int, ...]
    transform: tuple[float, float, float, float, float, float]
    projection: str | None
    nodata: float | None
    descriptions: tuple[str | None, ...]

    @property
    def sparse(self) -> bool:
        return 0 in self.counts


def describe(path: str) -> Info:
    with open(path, "rb") as f:
        head = f.read(16)
        order = {b"II": "<", b"MM": ">"}.get(head[:2])
        if order is None:
            raise ValueError(f"{path} is no TIFF file")
        big = struct.unpack(order + "H", head[2:4])[0] == 43
        f.seek(struct.unpack(order + "Q", head[8:16])[0] if big else struct.unpack(order + "I", head[4:8])[0])
        n = struct.unpack(order + ("Q" if big else "H"), f.read(8 if big else 2))[0]
        size = 20 if big else 12
        raw = f.read(n * size)
        tags: dict[int, tuple] = {}
        for i in range(n):
            tag, kind, count = struct.unpack(order + ("HHQ" if big else "HHI"), raw[i * size : i * size + (12 if big else 8)])
            code, width = _SIZES.get(kind, ("B", 1))
            field = raw[i * size + (12 if big else 8) : (i + 1) * size]
            if count * width > len(field):
                f.seek(struct.unpack(order + ("Q" if big else "I"), field)[0])
                field = f.read(count * width)
            tags[tag] = (field[:count],) if kind == 2 else struct.unpack(f"{order}{count}{code}", field[: count * width])
    text = lambda t: tags[t][0].rstrip(b"\0").decode() if t in tags else None
    bands = tags.get(277, (1,))[0]
    bits, form = tags.get(258, (1,))[0], tags.get(339, (1,))[0]
    kind = DataType(np.dtype(f"{ {1: 'u', 2: 'i', 3: 'f'}[form]}{bits // 8}").name)
    width, height = tags[256][0], tags[257][0]
    if 322 in tags:
        block, offsets, counts = (tags[322][0], tags[323][0]), tags[324], tags[325]
    else:
        block, offsets, counts = (width, min(tags.get(278, (height,))[0], height)), tags[273], tags[279]
    if 34264 in tags:
        m = tags[34264]
        transform = (m[3], m[0], m[1], m[7], m[4], m[5])
    elif 33550 in tags:
        sx, sy, tie = tags[33550][0], tags[33550][1], tags[33922]
        transform = (tie[3] - tie[0] * sx, sx, 0.0, tie[4] + tie[1] * sy, 0.0, -sy)
    else:
        transform = (0.0, 1.0, 0.0, 0.0, 0.0, -1.0)
    keys = tags.get(34735, ())
    geo = {keys[i]: (keys[i + 1], keys[i + 3]) for i in range(4, len(keys) - 3, 4)}
    projection = None
    if 3072 in geo and geo[3072][1] != 32767:
        projection = f"EPSG:{geo[3072][1]}"
    elif "mollweide" in (text(34737) or "").lower():
        projection = "ESRI:54009"
    elif 2048 in geo and geo.get(1024, (0, 2))[1] == 2:
        projection = f"EPSG:{geo[2048][1]}"
    names: list[str | None] = [None] * bands
    for sample, name in re.findall(r'<Item name="DESCRIPTION" sample="(\d+)"[^>]*>([^<]*)</Item>', text(42112) or ""):
        names[int(sample)] = name
    nodata = text(42113)
    return Info(width, height, bands, kind, order, tags.get(259, (1,))[0], tags.get(317, (1,))[0], tags.get(284, (1,))[0], block, offsets, counts, transform, projection, float(nodata) if nodata else None, tuple(names))


def _lzw(data: bytes) -> bytes:
    """TIFF's LZW: most significant bits first, codes grow one early."""
    out, table, width = bytearray(), [bytes([i]) for i in range(256)] + [b"", b""], 9
    bits = held = 0
    before = b""
    for byte in data:
        bits, held = bits << 8 | byte, held + 8
        if held < width:
            continue
        held -= width
        code = bits >> held
        bits &= (1 << held) - 1
        if code == 257:
            break
        if code == 256:
            del table[258:]
            width, before = 9, b""
            continue
        entry = table[code] if code < len(table) else before + before[:1]
        out += entry
        if before:
            table.append(before + entry[:1])
        before = entry
        n = len(table) + 1
        width = 9 if n < 512 else 10 if n < 1024 else 11 if n < 2048 else 12
    return bytes(out)


def _packbits(data: bytes) -> bytes:
    out, i = bytearray(), 0
    while i < len(data):
        n = data[i]
        if n < 128:
            out += data[i + 1 : i + 2 + n]
            i += n + 2
        else:
            if n > 128:
                out += data[i + 1 : i + 2] * (257 - n)
            i += 2
    return bytes(out)


def _block(data: bytes, info: Info, rows: int) -> np.ndarray:
    """(rows, width, samples) of a block's bytes."""
    if info.compression in (8, 32946):
        data = zlib.decompress(data)
    elif info.compression == 5:
        data = _lzw(data)
    elif info.compression == 32773:
        data = _packbits(data)
    elif info.compression != 1:
        raise ValueError(f"TIFF compression {info.compression} isn't supported")
    samples = info.bands if info.planar == 1 else 1
    shape, kind = (rows, info.block[0], samples), info.datatype.numpy.newbyteorder(info.order)
    if info.predictor == 3:
        size = info.datatype.sizeof
        flat = np.frombuffer(data, np.uint8, rows * info.block[0] * samples * size).reshape(rows, -1).astype(np.uint8)
        flat = np.cumsum(flat.reshape(rows, -1, samples), axis=1, dtype=np.uint8).reshape(rows, size, -1)
        return np.ascontiguousarray(flat.transpose(0, 2, 1)).view(info.datatype.numpy.newbyteorder(">")).reshape(shape)
    out = np.frombuffer(data, kind, rows * info.block[0] * samples).reshape(shape)
    return np.cumsum(out, axis=1, dtype=info.datatype.numpy) if info.predictor == 2 else out


def blocks(info: Info, y0: int, x0: int, window: Window | None, bands: Sequence[int]) -> list[tuple[int, list[int], list[int]]]:
    """(number, offsets, sizes) of the stored blocks that a window of pixels numbered from y0, x0 meets; one offset and size,
    or where each band is a plane of its own, one for each of ``bands``."""
    across, down = -(-info.width // info.block[0]), -(-info.height // info.block[1])
    rows, columns = range(down), range(across)
    if window is not None:
        first = [max(0, v) for v in (window.yoff - y0, window.xoff - x0)]
        end = [min(v, most) for v, most in ((window.yend - y0, info.height), (window.xend - x0, info.width))]
        rows, columns = (range(a // size, -(-b // size) if b > a else a // size) for a, b, size in zip(first, end, info.block[::-1], strict=True))
    planes = [0] if info.planar == 1 else [b - 1 for b in bands]
    out = []
    for by in rows:
        for bx in columns:
            places = [by * across + bx + p * across * down for p in planes]
            if any(info.counts[i] for i in places):
                out.append((by * across + bx, [info.offsets[i] for i in places], [info.counts[i] for i in places]))
    return out


def pixels(path: str, info: Info, y0: int, x0: int, window: Window | None = None, bands: Sequence[int] | None = None) -> DataFrame:
    """(y, x, b1 ...): the stored pixels of a window (all without one), numbered from y0, x0, of some bands (all: None)."""
    return scan([(path, info, y0, x0)], window, bands)


def scan(files: Sequence[tuple[str, Info, int, int]], window: Window | None = None, bands: Sequence[int] | None = None) -> DataFrame:
    """The pixels of several files of one pixel type.

    A task reads and decodes some of the blocks that the window meets; no other is touched.
    """
    from gridloom.plans.layer import session, within

    first = files[0][1]
    bands = list(range(1, first.bands + 1) if bands is None else sorted(set(bands)))
    found = [(i, *block) for i, (_, info, y0, x0) in enumerate(files) for block in blocks(info, y0, x0, window, bands)]
    spark = session()
    schema = pa.schema([("file", pa.int32()), ("block", pa.int32()), ("offsets", pa.list_(pa.int64())), ("sizes", pa.list_(pa.int64()))])
    tasks = pa.Table.from_arrays([pa.array(list(c), f.type) for c, f in zip(list(zip(*found, strict=True)) or [()] * 4, schema, strict=True)], schema=schema)
    table = spark.createDataFrame(tasks).repartition(max(1, min(len(found), spark.sparkContext.defaultParallelism * 4)))
    kind = np.float64 if first.datatype.is_float else np.int64
    slim = [(path, replace(info, offsets=(), counts=()), y0, x0) for path, info, y0, x0 in files]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for number, i, offsets, sizes in zip(*(batch.column(c).to_pylist() for c in ("file", "block", "offsets", "sizes")), strict=True):
                path, info, y0, x0 = slim[number]
                by, bx = divmod(i, -(-info.width // info.block[0]))
                rows = info.block[1] if info.block != (info.width, info.block[1]) else min(info.block[1], info.height - by * info.block[1])
                layers = []
                with open(path, "rb") as f:
                    for offset, size in zip(offsets, sizes, strict=True):
                        f.seek(offset)
                        data = f.read(size)
                        layers.append(_block(data, info, rows) if data else np.full((rows, info.block[0], 1), info.nodata or 0, info.datatype.numpy))
                values = [layers[0][:, :, b - 1] for b in bands] if info.planar == 1 else [v[:, :, 0] for v in layers]
                h, w = min(rows, info.height - by * info.block[1]), min(info.block[0], info.width - bx * info.block[0])
                y, x = np.mgrid[0:h, 0:w]
                columns = [pa.array(y.ravel() + by * info.block[1] + y0), pa.array(x.ravel() + bx * info.block[0] + x0)]
                columns += [pa.array(v[:h, :w].ravel().astype(kind)) for v in values]
                yield pa.RecordBatch.from_arrays(columns, ["y", "x", *(f"b{b}" for b in bands)])

    spark_kind = "double" if first.datatype.is_float else "long"
    rows = table.mapInArrow(run, "y long, x long, " + ", ".join(f"b{b} {spark_kind}" for b in bands))
    return rows if window is None else within(rows, window)


# -------------------------------------------------------------------------------------------------------- writing
def _geo(projection: str) -> tuple[list[int], bytes]:
    system = crs.lookup(projection)
    if system.kind == "geographic":
        return [1, 1, 0, 2, 1024, 0, 1, 2, 2048, 0, 1, 4326], b""
    if system.epsg:
        return [1, 1, 0, 2, 1024, 0, 1, 1, 3072, 0, 1, system.epsg], b""
    text = b"World_Mollweide|"
    return [1, 1, 0, 4, 1024, 0, 1, 1, 1026, 34737, len(text), 0, 3072, 0, 1, 32767, 3076, 0, 1, 9001], text + b"\0"


def write(path: str, sizes: dict[int, int], width: int, height: int, bands: int, rows: int, datatype: DataType, transform, projection: str, nodata: float | None, labels: list[str | None]) -> dict[int, int]:
    """The frame of a BigTIFF file of deflated strips of ``rows`` rows, each band in a plane of its own.

    sizes: bytes of each strip by number; strips that have none are left out of the file (sparse).  Returns where each strip
    is to be written.
    """
    per = -(-height // rows)
    offsets, counts, at = [0] * (per * bands), [0] * (per * bands), 16
    for number in sorted(sizes):
        offsets[number], counts[number] = at, sizes[number]
        at += sizes[number]
    with open(path, "wb") as f:
        f.write(struct.pack("<2sHHHQ", b"II", 43, 8, 0, 0))
        f.truncate(at)
        f.seek(at)
        keys, text = _geo(projection)
        left, xs, _, top, _, ys = transform
        bits, form = 8 * datatype.sizeof, _FORMATS[datatype.numpy.kind]
        tags: list[tuple[int, int, list | bytes]] = [
            (256, 4, [width]), (257, 4, [height]), (258, 3, [bits] * bands), (259, 3, [8]), (262, 3, [1]), (273, 16, offsets), (277, 3, [bands]),
            (278, 4, [rows]), (279, 16, counts), (284, 3, [2 if bands > 1 else 1]), (339, 3, [form] * bands),
        ]
        if bands > 1:
            tags.append((338, 3, [0] * (bands - 1)))
        if ys < 0:
            tags += [(33550, 12, [xs, -ys, 0.0]), (33922, 12, [0.0, 0.0, 0.0, left, top, 0.0])]
        else:
            tags.append((34264, 12, [xs, 0.0, 0.0, left, 0.0, ys, 0.0, top, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 1.0]))
        tags.append((34735, 3, keys))
        if text:
            tags.append((34737, 2, text))
        if any(labels):
            items = "".join(f'<Item name="DESCRIPTION" sample="{i}" role="description">{escape(n)}</Item>' for i, n in enumerate(labels) if n)
            tags.append((42112, 2, f"<GDALMetadata>{items}</GDALMetadata>".encode() + b"\0"))
        if nodata is not None:
            tags.append((42113, 2, f"{nodata:.17g}".encode() + b"\0"))
        tags.sort(key=lambda t: t[0])
        entries = []
        for tag, kind, values in tags:
            data = values if isinstance(values, bytes) else struct.pack(f"<{len(values)}{_SIZES[kind][0]}", *values)
            if len(data) > 8:
                at = f.tell()
                f.write(data)
                data = struct.pack("<Q", at)
            entries.append(struct.pack("<HHQ", tag, kind, len(values)) + data.ljust(8, b"\0"))
        at = f.tell()
        f.write(struct.pack("<Q", len(entries)) + b"".join(entries) + struct.pack("<Q", 0))
        f.seek(8)
        f.write(struct.pack("<Q", at))
    return {number: offsets[number] for number in sizes}
