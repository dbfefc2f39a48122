"""GeoTIFF files as a data source: windows are read strip by strip, files are written by executors.

Reading gives pixels (path, y, x, band, value) or, with the option what =
"rasters", a row a file. Bounds on y, x and band and names of files are pushed
down: a task opens its file, reads the header and then only those strips or
tiles that the window meets, at their own offsets. Large files are shared out
among tasks by their size, so planning opens no file at all.

Writing takes a row a raster, as TIFF or PNG. Tasks write into the job's own
folder; only a commit moves the files to their place, and an abort removes the
folder.

Files are 8, 16 or 32 bits a sample or floating point, in strips or tiles, not
packed or deflated, with or without the horizontal predictor. The file system
is pyarrow's, so paths may be local, shared or URIs of object stores.
"""

from __future__ import annotations

import json
import math
import struct
import uuid
import zlib
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual, WriterCommitMessage

from tessella.sources import images

FORMAT = "geotiff"
PIXELS = "path string, y int, x int, band int, value double"
RASTERS = "path string, width int, height int, bands int, kind string, transform struct<a:double,b:double,c:double,d:double,e:double,f:double>, epsg int, nodata double"
#: Bytes of a file that one task reads at most, as a rule.
SHARE = 32 << 20

# Numbers of the format's tags, sizes and letters of its types.
WIDTH, HEIGHT, BITS, PACKING, STRIPS, SAMPLES, STRIP_ROWS, STRIP_BYTES, PLANES, PREDICTOR = 256, 257, 258, 259, 273, 277, 278, 279, 284, 317
TILE_WIDTH, TILE_HEIGHT, TILES, TILE_BYTES, KIND = 322, 323, 324, 325, 339
PIXEL_SCALE, TIE_POINTS, MATRIX, GEO_KEYS, NODATA = 33550, 33922, 34264, 34735, 42113
GEOGRAPHIC, PROJECTED = 2048, 3072
TYPES = {1: "B", 2: "s", 3: "H", 4: "I", 5: "II", 6: "b", 8: "h", 9: "i", 11: "f", 12: "d", 13: "I", 16: "Q", 17: "q", 18: "Q"}


def opened(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path or URI, and the path in it."""
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


@dataclass
class Header:
    """What the first directory of a file says."""

    order: str
    tags: dict[int, tuple]
    first: dict[int, int] = field(default_factory=dict)

    def one(self, tag: int, default=None):
        return self.tags[tag][0] if self.tags.get(tag) else default

    @property
    def shape(self) -> tuple[int, int, int]:
        return self.one(HEIGHT), self.one(WIDTH), self.one(SAMPLES, 1)

    @property
    def kind(self) -> np.dtype:
        bits, kind = self.one(BITS, 1), self.one(KIND, 1)
        if len(set(self.tags.get(BITS, (1,)))) > 1 or bits not in (8, 16, 32, 64) or kind not in (1, 2, 3) or (kind == 3 and bits < 32):
            raise ValueError(f"samples of {bits} bits and format {kind} are not read")
        return np.dtype(f"{self.order}{'?uif'[kind]}{bits // 8}")

    @property
    def block(self) -> tuple[int, int]:
        """Rows and columns of a strip or tile."""
        height, width, _ = self.shape
        return (self.one(TILE_HEIGHT), self.one(TILE_WIDTH)) if TILES in self.tags else (min(self.one(STRIP_ROWS, height), height), width)

    def transform(self) -> dict[str, float] | None:
        if len(m := self.tags.get(MATRIX, ())) == 16:
            return dict(zip("abcdef", (m[0], m[1], m[3], m[4], m[5], m[7]), strict=True))
        scale, tie = self.tags.get(PIXEL_SCALE), self.tags.get(TIE_POINTS)
        if not scale or not tie or len(tie) < 6:
            return None
        return {"a": scale[0], "b": 0.0, "c": tie[3] - tie[0] * scale[0], "d": 0.0, "e": -scale[1], "f": tie[4] + tie[1] * scale[1]}

    def epsg(self) -> int | None:
        keys = self.tags.get(GEO_KEYS, ())
        known = {keys[i]: keys[i + 3] for i in range(4, len(keys) - 3, 4) if keys[i + 1] == 0}
        code = known.get(PROJECTED) or known.get(GEOGRAPHIC)
        return code if code and code != 32767 else None

    def nodata(self) -> float | None:
        try:
            return float(self.tags[NODATA][0].rstrip(b"\0 "))
        except (KeyError, ValueError, IndexError):
            return None

    def blocks(self, window: tuple[int, int, int, int]) -> list[tuple[int, int, int]]:
        """(number, first row, first column) of the blocks of one plane that meet rows and columns first to last."""
        (height, width, _), (bh, bw) = self.shape, self.block
        y0, y1, x0, x1 = max(window[0], 0), min(window[1], height - 1), max(window[2], 0), min(window[3], width - 1)
        across = math.ceil(width / bw)
        return [(r * across + c, r * bh, c * bw) for r in range(y0 // bh, y1 // bh + 1) for c in range(x0 // bw, x1 // bw + 1)] if y0 <= y1 and x0 <= x1 else []


def read_header(file: pa.NativeFile) -> Header:
    at = lambda pos, size: file.read_at(size, pos)
    start = at(0, 16)
    order = {b"II": "<", b"MM": ">"}.get(start[:2])
    version = struct.unpack(f"{order}H", start[2:4])[0] if order else 0
    if version not in (42, 43):
        raise ValueError("no TIFF file")
    big = version == 43
    pos = struct.unpack(f"{order}Q", start[8:16])[0] if big else struct.unpack(f"{order}I", start[4:8])[0]
    number, entry, inside = ("Q", 20, 8) if big else ("H", 12, 4)
    count = struct.unpack(order + number, at(pos, struct.calcsize(number)))[0]
    raw = at(pos + struct.calcsize(number), count * entry)
    tags = {}
    for i in range(count):
        tag, type_, n = struct.unpack_from(f"{order}HH{'Q' if big else 'I'}", raw, i * entry)
        letters = TYPES.get(type_)
        if letters is None:
            continue
        size = n * struct.calcsize(f"={letters}")
        spot = i * entry + entry - inside
        data = raw[spot : spot + size] if size <= inside else at(struct.unpack_from(f"{order}{'Q' if big else 'I'}", raw, spot)[0], size)
        tags[tag] = (data,) if letters == "s" else struct.unpack(f"{order}{n}{letters}" if len(letters) == 1 else f"{order}{letters * n}", data)
    return Header(order, tags)


def read_block(file: pa.NativeFile, header: Header, number: int, rows: int, plane: int) -> np.ndarray:
    """(rows, columns, samples) of a block; its bytes alone are read. Planes apart have one sample each."""
    apart = header.one(PLANES, 1) == 2
    (height, width, samples), (bh, bw) = header.shape, header.block
    offsets, sizes = (TILES, TILE_BYTES) if TILES in header.tags else (STRIPS, STRIP_BYTES)
    if apart:
        number += plane * math.ceil(height / bh) * math.ceil(width / bw)
    raw = file.read_at(header.tags[sizes][number], header.tags[offsets][number])
    packing, predictor = header.one(PACKING, 1), header.one(PREDICTOR, 1)
    if packing not in (1, 8, 32946) or predictor not in (1, 2):
        raise ValueError(f"packing {packing} with predictor {predictor} is not read")
    if packing != 1:
        raw = zlib.decompress(raw)
    n = 1 if apart else samples
    found = np.frombuffer(raw, header.kind, rows * bw * n).reshape(rows, bw, n)
    return np.cumsum(found, axis=1, dtype=found.dtype) if predictor == 2 else found


@dataclass
class Share(InputPartition):
    """The blocks of a file from number / of on."""

    path: str
    number: int
    of: int


class Reader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.options = options
        self.low, self.high = {}, {}
        self.paths: set[str] | None = None

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:  # noqa: N802
        """Takes bounds on y, x and band and names of files; Spark applies all others."""
        for f in filters:
            name, value = (f.attribute[0], f.value) if hasattr(f, "attribute") and hasattr(f, "value") else (None, None)
            if name == "path" and isinstance(f, EqualTo | In) and self.options.get("what") != "rasters":
                named = {value} if isinstance(f, EqualTo) else set(value)
                self.paths = named if self.paths is None else self.paths & named
            elif name in ("y", "x", "band") and isinstance(value, int) and isinstance(f, EqualTo | GreaterThan | GreaterThanOrEqual | LessThan | LessThanOrEqual):
                if isinstance(f, EqualTo | GreaterThan | GreaterThanOrEqual):
                    self.low[name] = max(self.low.get(name, -(1 << 62)), value + isinstance(f, GreaterThan))
                if isinstance(f, EqualTo | LessThan | LessThanOrEqual):
                    self.high[name] = min(self.high.get(name, 1 << 62), value - isinstance(f, LessThan))
            else:
                yield f

    def partitions(self) -> Sequence[InputPartition]:
        system, path = opened(self.options["path"])
        info = system.get_file_info(path)
        files = [info] if info.type == fs.FileType.File else [f for f in system.get_file_info(fs.FileSelector(path, recursive=True)) if f.type == fs.FileType.File]
        share = int(self.options.get("share", SHARE))
        wanted = [f for f in files if f.path.lower().endswith((".tif", ".tiff")) and "/_job-" not in f.path and (self.paths is None or f.path in self.paths)]
        if self.options.get("what") == "rasters":
            return [Share(f.path, 0, 1) for f in wanted] or [Share("", 0, 1)]
        return [Share(f.path, i, n) for f in wanted for n in [max(1, math.ceil(f.size / share))] for i in range(n)] or [Share("", 0, 1)]

    def read(self, partition: Share) -> Iterator[pa.RecordBatch] | Iterator[tuple]:
        if not partition.path:
            return
        system, _ = opened(self.options["path"])
        with system.open_input_file(partition.path) as file:
            header = read_header(file)
            if self.options.get("what") == "rasters":
                height, width, samples = header.shape
                t = header.transform()
                yield partition.path, width, height, samples, header.kind.name, tuple(t.values()) if t else None, header.epsg(), header.nodata()
                return
            yield from self._pixels(partition, file, header)

    def _pixels(self, partition: Share, file: pa.NativeFile, header: Header) -> Iterator[pa.RecordBatch]:
        (height, width, samples), (bh, _) = header.shape, header.block
        low = {k: max(0, self.low.get(k, 0)) for k in ("y", "x", "band")}
        high = {k: min(n - 1, self.high.get(k, n - 1)) for k, n in (("y", height), ("x", width), ("band", samples))}
        met = header.blocks((low["y"], high["y"], low["x"], high["x"]))
        apart = header.one(PLANES, 1) == 2
        for number, top, left in met[len(met) * partition.number // partition.of : len(met) * (partition.number + 1) // partition.of]:
            rows = bh if TILES in header.tags else min(bh, height - top)
            for plane in range(low["band"], high["band"] + 1) if apart else (0,):
                block = read_block(file, header, number, rows, plane)
                y0, y1 = max(low["y"], top), min(high["y"], top + rows - 1, height - 1)
                x0, x1 = max(low["x"], left), min(high["x"], left + block.shape[1] - 1)
                b0, b1 = (plane, plane) if apart else (low["band"], high["band"])
                cut = block[y0 - top : y1 - top + 1, x0 - left : x1 - left + 1, slice(0, 1) if apart else slice(b0, b1 + 1)]
                y, x, band = (a.ravel().astype(np.int32) for a in np.meshgrid(np.arange(y0, y1 + 1), np.arange(x0, x1 + 1), np.arange(b0, b1 + 1), indexing="ij"))
                names = pa.DictionaryArray.from_arrays(np.zeros(len(y), np.int8), [partition.path]).cast(pa.string())
                yield pa.RecordBatch.from_arrays([names, pa.array(y), pa.array(x), pa.array(band), pa.array(cut.astype(np.float64).ravel())], names=["path", "y", "x", "band", "value"])


def file_bytes(image: np.ndarray, transform: Sequence[float] | None = None, epsg: int | None = None, strip: int = 64, packed: bool = True, nodata: float | None = None) -> bytes:
    """A TIFF file of (height, width, samples), in strips of so many rows, its samples side by side."""
    height, width, samples = image.shape
    image = image.astype(image.dtype.newbyteorder("<"))
    strips = [image[a : a + strip].tobytes() for a in range(0, height, strip)]
    strips = [zlib.compress(s) for s in strips] if packed else strips
    kind = {"u": 1, "i": 2, "f": 3}[image.dtype.kind]
    tags = {
        WIDTH: ("I", [width]), HEIGHT: ("I", [height]), BITS: ("H", [image.dtype.itemsize * 8] * samples), PACKING: ("H", [8 if packed else 1]), 262: ("H", [2 if samples in (3, 4) else 1]), SAMPLES: ("H", [samples]),
        STRIP_ROWS: ("I", [strip]), STRIP_BYTES: ("I", [len(s) for s in strips]), PLANES: ("H", [1]), KIND: ("H", [kind] * samples),
    }
    if transform is not None:
        a, b, c, d, e, f = transform
        tags[MATRIX] = ("d", [a, b, 0, c, d, e, 0, f, 0, 0, 0, 0, 0, 0, 0, 1])
    if epsg is not None:
        geographic = 4000 <= epsg < 5000
        tags[GEO_KEYS] = ("H", [1, 1, 0, 2, 1024, 0, 1, 2 if geographic else 1, GEOGRAPHIC if geographic else PROJECTED, 0, 1, epsg])
    if nodata is not None:
        tags[NODATA] = ("s", f"{nodata:.17g}\0".encode())
    starts = np.cumsum([8, *map(len, strips)])
    tags[STRIPS] = ("I", starts[:-1].tolist())
    numbers = {v: k for k, v in TYPES.items() if k in (2, 3, 4, 12)}
    directory, beyond = [], b""
    at = int(starts[-1])
    after = at + 2 + 12 * len(tags) + 4
    for tag in sorted(tags):
        letter, values = tags[tag]
        data = values if letter == "s" else struct.pack(f"<{len(values)}{letter}", *values)
        spot = data.ljust(4, b"\0") if len(data) <= 4 else struct.pack("<I", after + len(beyond))
        beyond += data if len(data) > 4 else b""
        directory.append(struct.pack("<HHI", tag, numbers[letter], len(values)) + spot)
    return struct.pack("<2sHI", b"II", 42, at) + b"".join(strips) + struct.pack("<H", len(tags)) + b"".join(directory) + bytes(4) + beyond


@dataclass
class Written(WriterCommitMessage):
    """The names of a task's files, and the folder that they wait in."""

    folder: str
    names: list[str]


#: The formats that are written, and the endings of their files.
ENDINGS = {"tiff": ".tif", "png": ".png"}


class Writer(DataSourceArrowWriter):
    def __init__(self, options: dict[str, str], overwrite: bool):
        self.options, self.overwrite = options, overwrite
        self.job = f"_job-{uuid.uuid4().hex}"
        self.kind_of_file = options.get("file", "tiff")
        if self.kind_of_file not in ENDINGS:
            raise ValueError(f"files of {self.kind_of_file} are not written; {', '.join(ENDINGS)} are")
        self.palette = json.loads(options["palette"]) if "palette" in options else None

    def _bytes(self, image: np.ndarray, given: dict) -> bytes:
        if self.kind_of_file == "png":
            if image.dtype.kind not in "ui" or image.min(initial=0) < 0 or image.max(initial=0) > 255:
                raise ValueError("samples of PNG files are whole numbers from 0 to 255")
            return images.encode(image, self.palette)
        t = given.get("transform")
        return file_bytes(image, [t[k] for k in "abcdef"] if t else None, given.get("epsg"), int(self.options.get("strip", 64)), nodata=given.get("nodata"))

    def _place(self) -> tuple[fs.FileSystem, str]:
        system, path = opened(self.options["path"])
        return system, path.rstrip("/")

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        system, path = self._place()
        folder, names = f"{path}/{self.job}/{uuid.uuid4().hex}", []
        system.create_dir(folder, recursive=True)
        made = set()
        for batch in iterator:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1)
                given = {k: row.column(k)[0].as_py() for k in row.schema.names if k != "data"}
                data = row.column("data").flatten().to_numpy(zero_copy_only=False)
                if kind := self.options.get("kind"):
                    if np.dtype(kind).kind in "iu" and data.size and not (data.min() >= np.iinfo(kind).min and data.max() <= np.iinfo(kind).max):
                        raise ValueError(f"samples from {data.min()} to {data.max()} do not fit {kind}")
                    data = data.astype(kind)
                image = data.reshape(given["height"], given["width"], -1)
                parts = given["name"].split("/")
                if any(p in ("", ".", "..") or p.startswith("_job-") for p in parts):
                    raise ValueError(f"no name of a file: {given['name']}")
                name = given["name"] + ENDINGS[self.kind_of_file]
                if len(parts) > 1 and (inner := "/".join(parts[:-1])) not in made:
                    system.create_dir(f"{folder}/{inner}", recursive=True)
                    made.add(inner)
                with system.open_output_stream(f"{folder}/{name}") as out:
                    out.write(self._bytes(image, given))
                names.append(name)
        return Written(folder, names)

    def commit(self, messages: list[Written | None]) -> None:
        system, path = self._place()
        names = {n for m in messages if m for n in m.names}
        if len(names) < sum(len(m.names) for m in messages if m):
            raise ValueError("several rasters have one name")
        every = system.get_file_info(fs.FileSelector(path, recursive=True))
        there = {f.path[len(path) + 1 :] for f in every if f.type == fs.FileType.File and f"/{self.job}/" not in f.path}
        if not self.overwrite and there & names:
            raise ValueError(f"{len(there & names)} files are there already")
        for folder in sorted({n.rpartition("/")[0] for n in names} - {""}):
            system.create_dir(f"{path}/{folder}", recursive=True)
        for m in messages:
            for name in m.names if m else ():
                system.move(f"{m.folder}/{name}", f"{path}/{name}")
        if self.overwrite:
            for name in sorted(there - names):
                if name.endswith(ENDINGS[self.kind_of_file]):
                    system.delete_file(f"{path}/{name}")
        system.delete_dir(f"{path}/{self.job}")

    def abort(self, messages: list[Written | None]) -> None:
        system, path = self._place()
        if system.get_file_info(f"{path}/{self.job}").type == fs.FileType.Directory:
            system.delete_dir(f"{path}/{self.job}")


class GeoTiff(DataSource):
    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return RASTERS if self.options.get("what") == "rasters" else PIXELS

    def reader(self, schema) -> Reader:
        return Reader(dict(self.options))

    def writer(self, schema, overwrite: bool) -> Writer:
        return Writer(dict(self.options), overwrite)


def register(spark: SparkSession) -> None:
    """Makes the source known to a session, which pushes filters down to it from then on."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(GeoTiff)


def read_pixels(spark: SparkSession, path: str, **options: str) -> DataFrame:
    """path, y, x, band, value of all files below path; filters on these decide what is read."""
    register(spark)
    return spark.read.format(FORMAT).options(**options).load(path)


def read_rasters(spark: SparkSession, path: str) -> DataFrame:
    """A row a file below path: size, kind of samples, transform, EPSG code, nodata."""
    return read_pixels(spark, path, what="rasters")


def write_rasters(rasters: DataFrame, path: str, mode: str = "append", **options: str) -> None:
    """A file for each row: name, width, height, data (row by row, samples side by side), and if there transform, epsg and nodata.

    file: tiff or png. kind: the samples' type (uint8 and so on; else that of
    data's elements); strip: rows of a strip; palette: JSON of the colours of a
    PNG file's indices. A name may have folders in it. mode "append" adds files
    and fails if one is there; "overwrite" leaves these files only. All files
    appear at once at the end, or none if a task fails for good.
    """
    register(rasters.sparkSession)
    rasters.write.format(FORMAT).mode(mode).options(**options).save(path)
