"""Text, binary and alignment formats."""

from __future__ import annotations

import re
import struct
import zlib
from collections.abc import Iterator
from itertools import islice

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

from locuspark.operators.sequences import TILE
from locuspark.sources.alignment_index import join_offset, parse_index, plan, split_offset
from locuspark.sources.opening import open_input

READ_SCHEMA = (
    "sample string, qname string, flag int, tid int, pos int, mapq int, cigar string, seq string, qual array<int>, mtid int, mpos int, rg string"
)


def read_tsv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A headerless tab-separated file with a declared schema."""
    return spark.read.csv(path, sep="\t", schema=schema, header=False, mode="FAILFAST")


def read_samples(spark: SparkSession, path: str) -> DataFrame:
    """sample, path; a label twice or longer than 100 characters fails."""
    df = read_tsv(spark, path, "sample string, path string")
    wrong = df.groupBy("sample").count().where("count > 1 or length(sample) > 100")
    if not wrong.isEmpty():
        raise ValueError("sample labels must be unique and at most 100 characters")
    return df


def read_pairs(spark: SparkSession, path: str, samples: DataFrame) -> DataFrame:
    """s1, s2; labels must be samples, or REF as the second."""
    df = read_tsv(spark, path, "s1 string, s2 string")
    named = df.select(F.col("s1").alias("sample")).union(df.where("s2 <> 'REF'").select("s2"))
    if not named.join(samples, "sample", "left_anti").isEmpty():
        raise ValueError("a pair names an unknown sample")
    return df


def read_ranges(spark: SparkSession, path: str) -> DataFrame:
    return read_tsv(spark, path, "contig string, first int, last int")


def read_fai(spark: SparkSession, path: str) -> DataFrame:
    """tid, name, len from a FASTA index; tid is the line's place."""
    from pyspark.sql import Window

    lines = read_tsv(spark, path, "name string, len int, offset long, width int, bytes int")
    # A FASTA index lists contigs in file order, so offsets order them; it has one line a contig.
    return lines.select((F.row_number().over(Window.orderBy("offset")) - 1).alias("tid"), "name", "len")


def read_groups(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path).select(F.trim("value").alias("rg")).where("rg <> ''").distinct()


def read_depth_index(spark: SparkSession, path: str) -> DataFrame:
    """name, path, is_norm, avg_depth, haploid (array) of depth samples."""
    df = read_tsv(spark, path, "name string, path string, norm string, avg_depth float, haploid string")
    return df.select("name", "path", (F.col("norm") == "Y").alias("is_norm"), "avg_depth", F.filter(F.split("haploid", " +"), lambda x: (x != "") & (x != "none")).alias("haploid"))


def read_numbers(spark: SparkSession, path: str) -> DataFrame:
    """value for each whitespace-separated number of a file."""
    return spark.read.text(path).select(F.explode(F.split(F.trim("value"), r"\s+")).alias("v")).where("v <> ''").select(F.col("v").cast("double").alias("value"))


def read_sparse_pileup(spark: SparkSession, path: str) -> DataFrame:
    return read_tsv(spark, path, "contig string, pos int, ref_base string, depth double").select("contig", "pos", "depth")


def write_tsv(df: DataFrame, path: str, *order: str) -> None:
    """A headerless tab-separated file set; files and their rows are in the given order."""
    (df.orderBy(*order) if order else df).write.csv(path, sep="\t", header=False, quote="")


def _paths(spark: SparkSession, path: str) -> DataFrame:
    """The files of a path, without their contents."""
    return spark.read.format("binaryFile").load(path).select("path")


def read_fastq(spark: SparkSession, path: str, block: int = 20_000) -> DataFrame:
    """file, record, id, seq, spacer, qual; a group of fewer than four lines fails.

    A file is read as a stream, `block` records at a time, plain or gzipped.
    """
    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import gzip

        for pdf in batches:
            for name in pdf.path:
                with open_input(name) as raw:
                    lines = (x.rstrip(b"\r\n").decode() for x in (gzip.open(raw) if name.endswith(".gz") else raw))
                    done = 0
                    while part := list(islice(lines, 4 * block)):
                        if len(part) % 4:
                            raise ValueError(f"{name}: truncated record")
                        n = len(part) // 4
                        yield pd.DataFrame({"file": name, "record": range(done, done + n), "id": part[::4], "seq": part[1::4], "spacer": part[2::4], "qual": part[3::4]})
                        done += n

    return _paths(spark, path).mapInPandas(parse, "file string, record long, id string, seq string, spacer string, qual string")


def read_fasta_tiles(spark: SparkSession, path: str, index: str | None = None, width: int = TILE) -> DataFrame:
    """tid, tile, seq of a FASTA file, upper case, read by byte ranges that its index (.fai) gives.

    Tiles are dealt over tasks; no task or row holds a contig. See sequences.fetch for regions and
    sequences.with_reference for the base at a locus.
    """
    lines = read_tsv(spark, index or f"{path}.fai", "name string, len long, offset long, bases long, width long")
    from pyspark.sql import Window

    named = lines.select((F.row_number().over(Window.orderBy("offset")) - 1).alias("tid"), "len", "offset", "bases", "width").where("len > 0")
    tiles = named.withColumn("tile", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("len") - 1) / width)))).repartition("tid", "tile")

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        with open_input(path) as f:
            for pdf in batches:
                out = []
                for x in pdf.itertuples(index=False):
                    beg, stop = x.tile * width, min((x.tile + 1) * width, x.len)
                    place = [x.offset + p // x.bases * x.width + p % x.bases for p in (beg, stop - 1)]
                    f.seek(place[0])
                    out.append(f.read(place[1] - place[0] + 1).replace(b"\n", b"").replace(b"\r", b"").decode().upper())
                yield pd.DataFrame({"tid": pdf.tid, "tile": pdf.tile, "seq": out})

    return tiles.mapInPandas(parse, "tid int, tile int, seq string")


def pack_depth(contigs: list[tuple[str, str, int]], values, body: bool = True) -> bytes:
    """A dense track: size_t count, (name[10], short[10], size_t) each, then float32 values."""
    head = struct.pack("<Q", len(contigs)) + b"".join(struct.pack("<10s10s4xQ", a.encode(), b.encode(), n) for a, b, n in contigs)
    return head if not body else head + struct.pack(f"<{sum(n for _, _, n in contigs)}f", *values)


def read_dense_depth(spark: SparkSession, path: str, chunk: int = 1 << 20) -> DataFrame:
    """file, contig, pos (from 1), depth of dense tracks, read in ranges of `chunk` values."""
    import numpy as np

    def head(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for name in pdf.path:
                with open_input(name) as f:
                    (n,) = struct.unpack("<Q", f.read(8))
                    found = [struct.unpack("<10s10s4xQ", f.read(32)) for _ in range(n)]
                at = 8 + 32 * n
                for contig, _, size in found:
                    yield pd.DataFrame({"file": name, "contig": contig.split(b"\0")[0].decode(), "size": [size], "at": [at]})
                    at += 4 * size

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for x in pdf.itertuples(index=False):
                lo, n = x.chunk * chunk, min(chunk, x.size - x.chunk * chunk)
                with open_input(x.file) as f:
                    f.seek(x.at + 4 * lo)
                    yield pd.DataFrame({"file": x.file, "contig": x.contig, "pos": np.arange(lo + 1, lo + n + 1), "depth": np.frombuffer(f.read(4 * n), "<f4")})

    spans = _paths(spark, path).mapInPandas(head, "file string, contig string, size long, at long").where("size > 0")
    spans = spans.withColumn("chunk", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("size") - 1) / chunk)))).repartition("file", "contig", "chunk")
    return spans.mapInPandas(parse, "file string, contig string, pos long, depth float")


def write_dense_depth(track: DataFrame, contigs: list[tuple[str, str, int]], path: str, chunk: int = 1 << 20) -> None:
    """One dense track (contig, pos from 1, depth) as a file at `path`, a local or mounted path.

    Chunks are packed by tasks and put in their places in the file, which the driver has laid
    out; gaps are zeros. An unknown contig or a position beyond its end fails.
    """
    import numpy as np

    sizes = {name: n for name, _, n in contigs}
    starts, at = {}, 8 + 32 * len(contigs)
    for name, _, n in contigs:
        starts[name] = at
        at += 4 * n
    with open(path, "wb") as f:
        f.write(pack_depth(contigs, [], body=False))
        f.truncate(at)
    known = track.sparkSession.createDataFrame([(name, n) for name, _, n in contigs], "contig string, len long")
    checked = track.join(F.broadcast(known), "contig", "left")
    wrong = F.col("len").isNull() | (F.col("pos") < 1) | (F.col("pos") > F.col("len"))
    told = F.raise_error(F.concat(F.lit("unknown contig or position: "), F.concat_ws(" ", "contig", "pos")))
    rows = checked.select("contig", F.when(wrong, told.cast("long")).otherwise(F.col("pos").cast("long")).alias("pos"), F.col("depth").cast("float").alias("depth"))

    def put(pdf: pd.DataFrame) -> pd.DataFrame:
        name, part = pdf.contig.iloc[0], int(pdf.chunk.iloc[0])
        values = np.zeros(min(chunk, sizes[name] - part * chunk), "<f4")
        values[pdf.pos.to_numpy() - 1 - part * chunk] = pdf.depth.to_numpy()
        with open(path, "r+b") as f:
            f.seek(starts[name] + 4 * part * chunk)
            f.write(values.tobytes())
        return pd.DataFrame({"n": [len(values)]})

    dealt = rows.withColumn("chunk", F.floor((F.col("pos") - 1) / chunk))
    dealt.groupBy("contig", "chunk").applyInPandas(put, "n long").write.format("noop").mode("overwrite").save()


def read_contigs(spark: SparkSession, path: str) -> DataFrame:
    """tid, name, short, len of a contig dictionary (name and length), in the file's order."""
    from pyspark.sql import Window

    from locuspark.functions.codes import short_contig

    rows = spark.read.csv(path, sep="\t", schema="name string, len long", header=False, mode="FAILFAST")
    # One small file, whose lines come in order in one partition; it has one line a contig.
    held = rows.coalesce(1).withColumn("at_", F.monotonically_increasing_id())
    return held.select((F.row_number().over(Window.orderBy("at_")) - 1).alias("tid"), "name", short_contig(F.col("name")).alias("short"), "len")


_NT16 = "=ACMGRSVTWYHKDBN"
_CIGAR = "MIDNSHP=X"


def parse_record(raw: bytes) -> tuple:
    """The fields of one alignment record, behind its length."""
    tid, pos, l_name, mapq, _, n_cigar, flag, l_seq, mtid, mpos, _ = struct.unpack_from("<iiBBHHHiiii", raw)
    at = 32
    qname = raw[at : at + l_name - 1].decode()
    at += l_name
    cigar = "".join(f"{v >> 4}{_CIGAR[v & 15]}" for v in struct.unpack_from(f"<{n_cigar}I", raw, at))
    at += 4 * n_cigar
    packed = raw[at : at + (l_seq + 1) // 2]
    seq = "".join(_NT16[b >> 4] + _NT16[b & 15] for b in packed)[:l_seq]
    at += (l_seq + 1) // 2
    qual = list(raw[at : at + l_seq])
    at += l_seq
    rg, tags = None, raw[at:]
    sizes = {"A": 1, "c": 1, "C": 1, "s": 2, "S": 2, "i": 4, "I": 4, "f": 4}
    i = 0
    while i + 3 <= len(tags):
        tag, kind = tags[i : i + 2], chr(tags[i + 2])
        i += 3
        if kind in "ZH":
            end = tags.index(0, i)
            if tag == b"RG":
                rg = tags[i:end].decode()
            i = end + 1
        elif kind == "B":
            i += 5 + sizes[chr(tags[i])] * struct.unpack_from("<I", tags, i + 1)[0]
        else:
            i += sizes[kind]
    return qname, flag, tid, pos, mapq, cigar, seq, qual, mtid, mpos, rg


def inflate_blocks(read) -> Iterator[bytes]:
    """The inflated blocks of a BGZF stream; read(n) gives its bytes."""
    while head := read(18):
        extra = struct.unpack_from("<H", head, 10)[0]
        rest = head[12:18] + read(extra - 6)
        at, size = 0, None
        while at < extra:
            if rest[at : at + 2] == b"BC":
                size = struct.unpack_from("<H", rest, at + 4)[0] + 1
            at += 4 + struct.unpack_from("<H", rest, at + 2)[0]
        body = read(size - 12 - extra)
        yield zlib.decompress(body[:-8], -15)


class AlignmentSource(DataSource):
    """spark.read.format("alignments").option("samples", "label=path,label=path").load()

    Options: regions ("tid:beg-stop;..." half-open, 0-based) keeps the records that overlap any
    of them; split_bytes is about the compressed size of a partition. With an index beside a
    file (path.bai, or the option "indexes", label=path,...) only the byte ranges of the regions
    are read, and files are split; without one a file is one partition. A record comes once,
    however many regions it overlaps. Paths may be URIs of stores that pyarrow reads.
    """

    @classmethod
    def name(cls) -> str:
        return "alignments"

    def schema(self) -> str:
        return READ_SCHEMA

    def reader(self, schema: StructType) -> DataSourceReader:
        return AlignmentReader(self.options)


def _named(text: str) -> list[tuple[str, str]]:
    return [tuple(x.split("=", 1)) for x in text.split(",") if x]


def parse_region_option(text: str) -> list[tuple[int, int, int]]:
    out = []
    for one in filter(None, text.split(";")):
        tid, span = one.split(":")
        beg, stop = map(int, span.split("-"))
        if beg < 0 or stop <= beg:
            raise ValueError(f"bad region: {one}")
        out.append((int(tid), beg, stop))
    return out


class BlockReader:
    """Inflated bytes of a BGZF stream from a virtual offset on."""

    def __init__(self, stream, offset: int = 0):
        self.stream = stream
        self.block, within = split_offset(offset)
        stream.seek(self.block)
        self.held, self.at, self.next = b"", 0, self.block
        if self._load():
            self.at = within

    def _load(self) -> bool:
        self.block = self.next
        self.stream.seek(self.block)
        data = next(inflate_blocks(self.stream.read), None)
        self.held, self.at, self.next = data or b"", 0, self.stream.tell()
        return data is not None

    def tell(self) -> int:
        """Virtual offset of the next byte."""
        while self.at == len(self.held) and self._load():
            pass
        return join_offset(self.block, self.at)

    def read(self, n: int) -> bytes:
        """n bytes, or fewer at the end."""
        out = bytearray()
        while len(out) < n:
            if self.at == len(self.held) and not self._load():
                break
            part = self.held[self.at : self.at + n - len(out)]
            self.at += len(part)
            out += part
        return bytes(out)


def read_header(blocks: BlockReader) -> list[tuple[str, int]]:
    """Contig names and lengths; leaves the reader at the first record."""
    if blocks.read(4) != b"BAM\1":
        raise ValueError("not an alignment file")
    blocks.read(struct.unpack("<i", blocks.read(4))[0])
    out = []
    for _ in range(struct.unpack("<i", blocks.read(4))[0]):
        name = blocks.read(struct.unpack("<i", blocks.read(4))[0])[:-1].decode()
        out.append((name, struct.unpack("<i", blocks.read(4))[0]))
    return out


_ADVANCE = re.compile(r"(\d+)[MDN=X]")


class AlignmentReader(DataSourceReader):
    def __init__(self, options):
        self.files = _named(options["samples"])
        self.indexes = dict(_named(options.get("indexes", "")))
        self.regions = parse_region_option(options["regions"]) if "regions" in options else None
        self.split = int(options.get("split_bytes", 32 << 20))

    def partitions(self):
        out = []
        for sample, path in self.files:
            try:
                with open_input(self.indexes.get(sample, f"{path}.bai")) as f:
                    index = parse_index(f.read())
            except FileNotFoundError:
                index = None
            with open_input(path) as f:
                blocks = BlockReader(f)
                read_header(blocks)
                first = blocks.tell()
            ranges = [(first, None)] if index is None else plan(index, self.regions, first, self.split)
            out += [InputPartition((sample, path, *r)) for r in ranges]
        return out or [InputPartition(None)]

    def read(self, partition):
        if partition.value is None:
            return
        sample, path, beg, stop = partition.value
        with open_input(path) as f:
            blocks = BlockReader(f, beg)
            while stop is None or blocks.tell() < stop:
                size = blocks.read(4)
                if len(size) < 4:
                    break
                row = parse_record(blocks.read(struct.unpack("<i", size)[0]))
                if self.regions is None or self._wanted(*row[2:6]):
                    yield (sample, *row)

    def _wanted(self, tid: int, pos: int, mapq: int, cigar: str) -> bool:
        end = pos + max(sum(map(int, _ADVANCE.findall(cigar))), 1)
        return any(t == tid and pos < stop and end > beg for t, beg, stop in self.regions)
