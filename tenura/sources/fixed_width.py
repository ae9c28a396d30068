"""Fixed-width record files (dBase-style ``.dbf``) as a Spark data source.

Layout: a 32-byte header (bytes 4-7 record count, 8-9 header size, 10-11 record
size, little-endian), 32-byte field descriptors from byte 32 (name in bytes
0-10, type in byte 11, length in byte 16) ended by 0x0D, then fixed-size
records, each starting with a deletion byte ('*' = deleted); 0x1A ends the file.

Reading is splittable: the driver reads only the headers and cuts every file
into record ranges; each range is one input partition, read with ranged reads
by an executor and returned as Arrow record batches.  Files are opened through
pyarrow's filesystem layer, so local paths and shared-storage URIs (file://,
hdfs://, s3://, ...) are read the same way.  All shards of a
table (``name.dbf``, ``name.2.dbf``, ...) are one DataFrame.  Values land as
strings (bronze); typing is done by ``tenura.sources.landing.decode`` with the
field types from the header, as JVM expressions.

Writing (``df.write.format("dbf")``) emits one shard per partition in
parallel; each shard carries its own header, so shards written by different
tasks need not agree on field widths.  The writer targets a mounted path and
holds one partition's encoded records while it sizes the fields, so bound the
partition size (``repartition``) before writing large tables.
"""

from __future__ import annotations

import glob as _glob
import json
import os
import struct
import uuid
from dataclasses import dataclass

from pyspark.sql.datasource import (DataSource, DataSourceReader, DataSourceWriter, InputPartition,
                                    WriterCommitMessage)
from pyspark.sql.types import StringType, StructField, StructType

# Format constants.
HEADER_SIZE = 32
DESCRIPTOR_SIZE = 32
FIELD_TERMINATOR = 0x0D
END_OF_FILE = 0x1A
DELETED = ord("*")


@dataclass(frozen=True)
class Field:
    name: str
    type: str
    length: int
    offset: int  # from record start (byte 0 is the deletion flag)


@dataclass(frozen=True)
class Layout:
    n_records: int
    header_size: int
    record_size: int
    fields: tuple[Field, ...]


def _open_fs(path: str):
    """(pyarrow FileSystem, path inside it) for a local path or a URI (file://,
    hdfs://, s3://, ...), so the same code reads shared storage on a cluster."""
    from pyarrow import fs as pafs
    return pafs.FileSystem.from_uri(path if "://" in path else os.path.abspath(path))


def _scheme(path: str) -> str:
    return path[:path.index("://") + 3] if "://" in path else ""


def read_layout(path: str) -> Layout:
    """Parse a file's header and field descriptors (a few hundred bytes)."""
    fs, inner = _open_fs(path)
    with fs.open_input_file(inner) as f:
        size = f.size()
        head = f.read_at(HEADER_SIZE, 0)
        if len(head) < HEADER_SIZE:
            raise ValueError(f"{path}: not a fixed-width record file (short header)")
        n_records, header_size, record_size = struct.unpack("<IHH", head[4:12])
        desc = f.read_at(max(header_size - HEADER_SIZE, 0), HEADER_SIZE)
    fields, offset, i = [], 1, 0
    while i + DESCRIPTOR_SIZE <= len(desc) and desc[i] != FIELD_TERMINATOR:
        d = desc[i:i + DESCRIPTOR_SIZE]
        name = d[0:11].split(b"\x00", 1)[0].decode("ascii", "replace").strip().lower()
        ftype = chr(d[11])
        length = d[16]
        fields.append(Field(name, ftype, length, offset))
        offset += length
        i += DESCRIPTOR_SIZE
    names = [f.name for f in fields]
    if len(set(names)) < len(names):
        raise ValueError(f"{path}: field names occur more than once: {sorted(n for n in set(names) if names.count(n) > 1)}")
    available = max(size - header_size, 0) // record_size if record_size else 0
    return Layout(min(n_records, available), header_size, record_size, tuple(fields))


def expand_paths(path: str) -> list[str]:
    """Comma-separated paths, directories (their ``*.dbf``) or globs in the last
    path component; each expansion sorted, so shard order is kept."""
    import fnmatch

    from pyarrow import fs as pafs
    out = []
    for p in [p.strip() for p in path.split(",") if p.strip()]:
        fs, inner = _open_fs(p)
        pre = _scheme(p)
        base = inner.rstrip("/").rsplit("/", 1)[-1]
        if any(ch in base for ch in "*?["):
            parent, pattern = inner.rstrip("/").rsplit("/", 1)[0] or "/", base
        elif fs.get_file_info(inner).type == pafs.FileType.Directory:
            parent, pattern = inner, "*.dbf"
        else:
            out.append(p)
            continue
        infos = fs.get_file_info(pafs.FileSelector(parent, allow_not_found=True))
        out.extend(sorted(pre + i.path for i in infos
                          if i.type == pafs.FileType.File and fnmatch.fnmatch(i.base_name, pattern)))
    if not out:
        raise FileNotFoundError(f"no fixed-width files match {path!r}")
    return out


def field_types(path: str) -> dict[str, str]:
    """Field name -> type code of the first file matching ``path`` (for ``decode``)."""
    return {f.name: f.type for f in read_layout(expand_paths(path)[0]).fields}


# Characters Python's str.strip() removes (str.isspace() below U+3001; none above).
_PY_SPACE = "".join(chr(c) for c in range(0x3001) if chr(c).isspace())


def _decode_field(cells, encoding: str, errors: str):
    """One field of a batch of records (n x length bytes) -> Arrow strings.

    Vectorised: trailing NUL bytes dropped, UTF-8 validated by a cast, then
    trimmed like ``str.strip()``.  Text in another encoding, or a batch with
    bytes that are not UTF-8, is decoded value by value with ``errors``.
    """
    import numpy as np
    import pyarrow as pa
    import pyarrow.compute as pc

    n, length = cells.shape
    block = np.ascontiguousarray(cells)
    if encoding.lower().replace("-", "").replace("_", "") in ("utf8", "ascii") and length > 0:
        arr = pa.FixedSizeBinaryArray.from_buffers(pa.binary(length), n, [None, pa.py_buffer(block.tobytes())])
        try:
            text = arr.cast(pa.binary()).cast(pa.string())
            if encoding.lower() != "ascii" or pc.all(pc.string_is_ascii(text)).as_py() is not False:
                return pc.utf8_trim(pc.utf8_rtrim(text, characters="\x00"), characters=_PY_SPACE)
        except pa.ArrowInvalid:
            pass
    raw = block.view(f"S{max(length, 1)}").ravel() if length else [b""] * n
    return pa.array([v.decode(encoding, errors).strip() for v in (raw.tolist() if length else raw)], pa.string())


class RecordRange(InputPartition):
    def __init__(self, path: str, start: int, stop: int):
        super().__init__((path, start, stop))
        self.path, self.start, self.stop = path, start, stop


class FixedWidthReader(DataSourceReader):
    def __init__(self, options: dict, schema: StructType):
        self.options = options
        self.schema = schema
        self.paths = expand_paths(options["path"])
        self.per_partition = int(options.get("recordsPerPartition", 1_000_000))
        self.encoding = options.get("encoding", "utf-8")
        self.errors = options.get("errors", "replace")
        self.with_file = options.get("includeSourceFile", "false").lower() == "true"
        self.find_ends = options.get("findEnds", "false").lower() == "true"
        # path -> number of the record that holds an end marker, for files that hold one
        # before their last record; unknown: a file is one range, so that no range is
        # read behind a marker in an earlier one
        self.ends = json.loads(options["ends"]) if "ends" in options else None

    def partitions(self):
        parts = []
        for p in self.paths:
            n = read_layout(p).n_records
            if self.ends is not None:
                n = min(n, self.ends.get(p, n))
            step = max(n, 1) if self.ends is None and not self.find_ends else self.per_partition
            for start in range(0, n, step):
                parts.append(RecordRange(p, start, min(start + step, n)))
        return parts or [RecordRange(self.paths[0], 0, 0)]

    def _first_end(self, partition: RecordRange):
        """(path, number of the first record of the range that starts with an end marker)."""
        import numpy as np
        import pyarrow as pa

        lay = read_layout(partition.path)
        fs, inner = _open_fs(partition.path)
        with fs.open_input_file(inner) as fh:
            for lo in range(partition.start, partition.stop, 65536):
                hi = min(lo + 65536, partition.stop)
                buf = np.frombuffer(fh.read_at((hi - lo) * lay.record_size,
                                               lay.header_size + lo * lay.record_size), dtype=np.uint8)
                eof = np.flatnonzero(buf[::lay.record_size] == END_OF_FILE)
                if len(eof):
                    yield pa.RecordBatch.from_arrays([pa.array([partition.path]), pa.array([lo + int(eof[0])])],
                                                     names=["path", "record"])
                    return

    def read(self, partition: RecordRange):
        import numpy as np
        import pyarrow as pa

        if self.find_ends:
            yield from self._first_end(partition)
            return
        lay = read_layout(partition.path)
        names = [f.name for f in self.schema.fields if f.name != "source_file"]
        by_name = {f.name: f for f in lay.fields}
        step = 65536  # records per Arrow batch
        fs, inner = _open_fs(partition.path)
        with fs.open_input_file(inner) as fh:
            for lo in range(partition.start, partition.stop, step):
                hi = min(lo + step, partition.stop)
                buf = fh.read_at((hi - lo) * lay.record_size, lay.header_size + lo * lay.record_size)
                n = len(buf) // lay.record_size
                if n == 0:
                    break
                rec = np.frombuffer(buf, dtype=np.uint8, count=n * lay.record_size).reshape(n, lay.record_size)
                flag = rec[:, 0]
                eof = np.nonzero(flag == END_OF_FILE)[0]
                if eof.size:
                    rec, flag = rec[:eof[0]], flag[:eof[0]]
                rec = rec[flag != DELETED]
                cols = []
                for name in names:
                    f = by_name.get(name)
                    if f is None:
                        cols.append(pa.nulls(len(rec), pa.string()))
                        continue
                    cols.append(_decode_field(rec[:, f.offset:f.offset + f.length], self.encoding, self.errors))
                if self.with_file:
                    cols.append(pa.array([partition.path] * len(rec), pa.string()))
                    batch_names = names + ["source_file"]
                else:
                    batch_names = names
                yield pa.RecordBatch.from_arrays(cols, names=batch_names)
                if eof.size:
                    return


@dataclass
class ShardWritten(WriterCommitMessage):
    tmp_path: str
    final_path: str


def _field_code(dtype) -> str:
    from pyspark.sql import types as T
    if isinstance(dtype, (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.DecimalType,
                          T.FloatType, T.DoubleType)):
        return "N"
    if isinstance(dtype, T.DateType):
        return "D"
    if isinstance(dtype, T.BooleanType):
        return "L"
    return "C"


def _text(v, code: str) -> str:
    if v is None:
        return ""
    if code == "D":
        return v.strftime("%Y%m%d")
    if code == "L":
        return "T" if v else "F"
    return str(v)


# A field length is one header byte, a field name at most ten.
MAX_FIELD_BYTES = 254
MAX_NAME_BYTES = 10


def header_names(columns: list[str]) -> list[bytes]:
    """Header names of the columns: upper case, and where names are too long or clash when
    cut, a running number at the end (``ttl_title_no_flw`` beside ``TTL_TITLE_``: ``TTL_TITL_1``).

    Columns that differ in case only are refused."""
    whole = [c.upper().encode("ascii", "replace") for c in columns]
    if len({c.upper() for c in columns}) < len(columns):
        raise ValueError(f"column names differ in case only: {columns}")
    out = [n if len(n) <= MAX_NAME_BYTES and whole.count(n) == 1 else None for n in whole]   # these fit as they are
    taken = {n for n in out if n}
    for at, n in enumerate(whole):
        if out[at] is not None:
            continue
        name, k = n[:MAX_NAME_BYTES], 0
        while name in taken:
            k += 1
            end = f"_{k}".encode()
            name = n[:MAX_NAME_BYTES - len(end)] + end
        taken.add(name)
        out[at] = name
    return out


def _check_widths(schema, sizes, limits=None) -> None:
    """Refuse values that do not fit their field instead of cutting them."""
    limits = limits or [MAX_FIELD_BYTES] * len(sizes)
    over = [f.name for f, n, lim in zip(schema.fields, sizes, limits) if n > lim]
    if over:
        raise ValueError(f"values longer than their fixed-width field in {over} "
                         f"(a field holds at most {MAX_FIELD_BYTES} bytes)")


class FixedWidthWriter(DataSourceWriter):
    def __init__(self, options: dict, schema: StructType, overwrite: bool):
        self.path = options["path"]
        self.schema = schema
        self.overwrite = overwrite
        self.encoding = options.get("encoding", "utf-8")
        self.prefix = options.get("shardPrefix", "part")
        w = options.get("fieldWidths")
        self.widths = [max(int(x), 1) for x in w.split(",")] if w else None
        if self.widths is not None:
            _check_widths(schema, self.widths)

    def write(self, iterator):
        from pyspark import TaskContext

        ctx = TaskContext.get()
        pid = ctx.partitionId() if ctx else 0
        codes = [_field_code(f.dataType) for f in self.schema.fields]
        os.makedirs(self.path, exist_ok=True)
        final = os.path.join(self.path, f"{self.prefix}-{pid:05d}.dbf")
        tmp = os.path.join(self.path, f".{self.prefix}-{pid:05d}-{uuid.uuid4().hex}.tmp")
        if self.widths is not None:
            # widths measured beforehand (write_fixed_width): stream the records and
            # patch the record count into the header at the end
            widths = self.widths
            with open(tmp, "wb") as out:
                self._header(out, 0, codes, widths)
                n = 0
                for row in iterator:
                    enc = [_text(v, c).encode(self.encoding) for v, c in zip(row, codes)]
                    _check_widths(self.schema, [len(v) if len(v) > w else 0 for v, w in zip(enc, widths)], widths)
                    out.write(b" " + b"".join(v[:w].ljust(w, b" ") for v, w in zip(enc, widths)))
                    n += 1
                out.write(bytes([END_OF_FILE]))
                out.seek(4)
                out.write(struct.pack("<I", n))
            return ShardWritten(tmp, final)
        rows = [[_text(v, c).encode(self.encoding) for v, c in zip(row, codes)] for row in iterator]
        widths = [max([len(r[i]) for r in rows] + [1]) for i in range(len(codes))]
        _check_widths(self.schema, widths)
        with open(tmp, "wb") as out:
            self._header(out, len(rows), codes, widths)
            for r in rows:
                out.write(b" " + b"".join(v[:w].ljust(w, b" ") for v, w in zip(r, widths)))
            out.write(bytes([END_OF_FILE]))
        return ShardWritten(tmp, final)

    def _header(self, out, n_rows: int, codes, widths) -> None:
        header_size = HEADER_SIZE + DESCRIPTOR_SIZE * len(codes) + 1
        record_size = 1 + sum(widths)
        out.write(struct.pack("<B3xIHH20x", 3, n_rows, header_size, record_size))
        for name, code, w in zip(header_names(self.schema.names), codes, widths):
            out.write(name.ljust(11, b"\x00") + code.encode() + b"\x00" * 4 + bytes([w]) + b"\x00" * 15)
        out.write(bytes([FIELD_TERMINATOR]))

    def commit(self, messages):
        finals = set()
        for m in messages:
            if m is not None:
                os.replace(m.tmp_path, m.final_path)
                finals.add(m.final_path)
        if self.overwrite:          # drop shards of an earlier write
            for old in _glob.glob(os.path.join(self.path, "*.dbf")):
                if old not in finals:
                    os.remove(old)

    def abort(self, messages):
        for m in messages:
            if m is not None and os.path.exists(m.tmp_path):
                os.remove(m.tmp_path)


class FixedWidthDataSource(DataSource):
    """``spark.read.format("dbf").load(path)`` / ``df.write.format("dbf").save(dir)``.

    Read options: ``recordsPerPartition`` (default 1,000,000), ``encoding``
    (utf-8), ``errors`` (``replace`` or ``ignore`` for undecodable bytes),
    ``includeSourceFile`` (adds ``source_file``).  An end marker ends its file, not
    its range: ``read_fixed_width`` looks for markers first and passes what it found
    as ``ends``; without that option every file is one partition.
    """

    @classmethod
    def name(cls):
        return "dbf"

    def schema(self):
        if self.options.get("findEnds", "false").lower() == "true":
            return "path string, record long"
        lay = read_layout(expand_paths(self.options["path"])[0])
        fields = [StructField(f.name, StringType(), True) for f in lay.fields]
        if self.options.get("includeSourceFile", "false").lower() == "true":
            fields.append(StructField("source_file", StringType(), True))
        return StructType(fields)

    def reader(self, schema: StructType):
        return FixedWidthReader(self.options, schema)

    def writer(self, schema: StructType, overwrite: bool):
        return FixedWidthWriter(self.options, schema, overwrite)


def register(spark) -> None:
    """Make ``format("dbf")`` available in this session."""
    spark.dataSource.register(FixedWidthDataSource)


def measured_widths(df) -> list[int]:
    """Field widths in bytes for ``df`` as the writer encodes it, from one
    distributed aggregate: dates 8, flags 1, text/numbers the longest UTF-8
    value (floats at least 24, the longest repr of a double)."""
    from pyspark.sql import functions as F
    from pyspark.sql import types as T
    aggs = []
    for i, f in enumerate(df.schema.fields):
        code = _field_code(f.dataType)
        if code == "D":
            aggs.append(F.lit(8).alias(f"w{i}"))
        elif code == "L":
            aggs.append(F.lit(1).alias(f"w{i}"))
        else:
            w = F.coalesce(F.max(F.octet_length(F.col(f.name).cast("string"))), F.lit(1))
            if isinstance(f.dataType, (T.FloatType, T.DoubleType)):
                w = F.greatest(w, F.lit(24))
            elif isinstance(f.dataType, (T.TimestampType, T.TimestampNTZType)):
                w = F.greatest(w, F.lit(26))      # Python prints six fractional digits
            aggs.append(w.alias(f"w{i}"))
    row = df.agg(*aggs).first()
    return [max(int(row[f"w{i}"]), 1) for i in range(len(df.schema.fields))]


def write_fixed_width(df, path: str, mode: str = "overwrite", **options) -> None:
    """Write ``df`` as fixed-width shards (one per partition) with the field
    widths measured first, so every task streams its records (constant memory)
    and all shards share one layout."""
    from pyspark.sql import types as T
    register(df.sparkSession)
    w = df.write.format("dbf").mode(mode).options(**{k: str(v) for k, v in options.items()})
    # nested and binary values print differently in Python than in Spark's cast;
    # such frames keep the writer's own (in-memory) sizing
    if not any(isinstance(f.dataType, (T.ArrayType, T.MapType, T.StructType, T.BinaryType))
               for f in df.schema.fields):
        w = w.option("fieldWidths", ",".join(map(str, measured_widths(df))))
    w.save(path)


def read_fixed_width(spark, path: str, **options):
    """All shards matching ``path`` as one bronze (all-string) DataFrame.

    One pass over the record flags first finds the files that an end marker cuts short
    (one row for each of these reaches the driver, which lists the files anyway), so the
    rows do not depend on ``recordsPerPartition``."""
    from pyspark.sql import functions as F
    register(spark)
    given = {k: str(v).lower() if isinstance(v, bool) else str(v) for k, v in options.items()}
    marks = spark.read.format("dbf").options(**given, findEnds="true").load(path)
    ends = {r.path: r.record for r in marks.groupBy("path").agg(F.min("record").alias("record")).collect()}
    return spark.read.format("dbf").options(**given, ends=json.dumps(ends)).load(path)
