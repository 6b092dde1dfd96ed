"""Token ids in flat binary files with document offsets.

Documents are dealt into ranges of ascending doc_id (nulls first); the task of a range
encodes its documents in order and writes three files under names of their own:

    <range>.ids    token ids, little-endian uint16, or uint32 for a larger vocabulary
    <range>.off    n + 1 little-endian uint64 offsets of documents, from 0
    <range>.doc    n little-endian int64 doc_ids, null ids as the least int64

A file is written under a temporary name and renamed, so that an attempt that is lost or runs
twice leaves the same files. Row counts and prefix sums over the ranges, one row each, give
the bases; base + offset is a document's global start. Reading maps the files into memory.
The folder must be a path that all executors mount (POSIX), as memory mapping needs one.

Null and empty texts give the end id alone. Rows with the same doc_id follow each other, in
the order of a hash of their texts, so that several ranges can share a frequent id.
"""

from __future__ import annotations

import os
import re
import uuid
import zlib
from array import array

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from locuspark.llm.common import fresh_path, table

TOKENIZER, END_ID = "word_bpe_49k.json", 2
NO_ID = np.iinfo(np.int64).min
#: Distinct parts of texts that a Python worker remembers, in each of two generations (about
#: 200 bytes each); the longest of them; characters of a text that are cut at once.
REMEMBERED, LONGEST, SLICE = 600_000, 100, 1 << 18
#: What keeps a text from being lower-cased as a whole: characters outside PLAIN, and what
#: may be a special token, which is looked for before lower-casing.
PLAIN = "\u017f"
WORD_AND_SIGNS = re.compile(r"([^\W\d_]+)([!-/:-@\[-`{-~]+)").fullmatch
ODD = re.compile("[^\0-\u012f\u0131-\u017f]|<\\|")


class Parts(dict):
    """Ids of the parts of texts between ASCII spaces and line feeds, as bytes.

    The tokenizer composes (NFC), puts a space for white space, lower-cases character by
    character, drops white space and never looks across it. A space neither composes with
    anything nor moves, and no special token holds one, so that the ids of a text are those
    of its parts, each encoded by itself. Up to U+017F, but for U+0130, characters are
    composed already and lower-case to one such character, with or without their
    neighbours; a part of such letters alone is one piece for the merge model, and what
    ASCII punctuation ends the part is another piece. Every other part goes through encode().
    """

    def __init__(self, path: str, bits: int | None = None):
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import ByteLevel

        self.tokenizer = Tokenizer.from_file(path)
        least = 16 if self.tokenizer.get_vocab_size() <= 1 << 16 else 32
        if (bits or least) not in (16, 32) or (bits or least) < least:
            raise ValueError(f"ids of this vocabulary need {least} bits")
        self.width = np.uint16 if (bits or least) == 16 else np.uint32
        self.merge = self.tokenizer.model.tokenize
        shown = ByteLevel(add_prefix_space=False, use_regex=False).pre_tokenize_str
        self.letters = {c: shown(chr(c))[0][0] for c in range(128, ord(PLAIN) + 1)}
        self.kind = "H" if self.width is np.uint16 else "I"
        self.old: dict[str, bytes] = {}

    def __missing__(self, part: str) -> bytes:
        found = self.old.get(part)
        if found is None:
            found = self._encoded(part)
        if len(part) > LONGEST:
            return found
        if len(self) >= REMEMBERED:
            self.old = dict(self)
            self.clear()
        self[part] = found
        return found

    def _encoded(self, part: str) -> bytes:
        if not _plain_word(part):
            cut = WORD_AND_SIGNS(part)
            if not cut or not _plain_word(cut[1]):
                return self._whole(part)
            return self[cut[1]] + self[cut[2]]
        low = part.lower()
        if low != part:
            return self[low]
        return array(self.kind, [t.id for t in self.merge(part if part.isascii() else part.translate(self.letters))]).tobytes()

    def _whole(self, text: str) -> bytes:
        return array(self.kind, self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def encode(self, texts: list[str | None]) -> list[bytes]:
        return [self._ids(t) if t else b"" for t in texts]

    def _ids(self, text: str) -> bytes:
        get = self.__getitem__
        if ("<|" not in text) if text.isascii() else not ODD.search(text):
            text = text.lower()
        text = text.replace("\n", " ")
        if len(text) <= SLICE:
            return b"".join(map(get, text.split(" ")))
        out, at = [], 0
        while at < len(text):
            end = text.find(" ", at + SLICE)
            end = len(text) if end < 0 else end
            out.append(b"".join(map(get, text[at:end].split(" "))))
            at = end + 1
        return b"".join(out)


def _plain_word(part: str) -> bool:
    return part.isalpha() and (part.isascii() or (max(part) <= PLAIN and "\u0130" not in part))


_encoders: dict[tuple[str, int | None], Parts] = {}


def encoder(path: str, bits: int | None = None) -> Parts:
    if (path, bits) not in _encoders:
        _encoders[path, bits] = Parts(path, bits)
    return _encoders[path, bits]


def _local(uri: str) -> str:
    if uri.startswith("file:"):
        return "/" + uri[5:].lstrip("/")
    if "://" in uri:
        raise ValueError(f"{uri}: token files need a folder that executors mount, such as file:///shared")
    return uri


def _writer(folder: str, vocabulary: str, bits: int | None):
    def run(batches):
        from pyspark import TaskContext

        os.makedirs(folder, exist_ok=True)
        part = TaskContext.get().partitionId()
        names = [f"{folder}/{part:06d}.{kind}" for kind in ("ids", "off", "doc")]
        drafts = [f"{n}.{uuid.uuid4().hex}" for n in names]
        enc = encoder(vocabulary, bits)
        end = np.array([END_ID], enc.width).tobytes()
        size, docs, tokens = np.dtype(enc.width).itemsize, 0, 0
        with open(drafts[0], "wb") as ids, open(drafts[1], "wb") as off, open(drafts[2], "wb") as doc:
            off.write(np.zeros(1, "<u8").tobytes())
            for batch in batches:
                for at in range(0, batch.num_rows, 512):
                    rows = batch.slice(at, 512)
                    found = [raw + end for raw in enc.encode(rows.column("text").to_pylist())]
                    ids.writelines(found)
                    ends = tokens + np.cumsum([len(raw) // size for raw in found], dtype=np.uint64)
                    off.write(ends.astype("<u8").tobytes())
                    doc.write(np.array([NO_ID if i is None else i for i in rows.column("doc_id").to_pylist()], "<i8").tobytes())
                    docs, tokens = docs + len(found), int(ends[-1])
        if docs:
            for draft, name in zip(drafts, names):
                os.replace(draft, name)
            yield pa.RecordBatch.from_pydict({"part": [part], "docs": [docs], "tokens": [tokens], "bits": [8 * size]})
        else:
            for draft in drafts:
                os.remove(draft)

    return run


def write_tokens(docs: DataFrame, uri: str, vocabulary: str, parts: int | None = None, bits: int | None = None) -> DataFrame:
    """Writes docs (doc_id, text) to uri; returns the manifest: part, docs, tokens, bits, base, first.

    The manifest has one row a range, however many documents there are. bits, 16 or 32, is
    the width of an id, by default the least that the vocabulary needs.
    """
    spark = docs.sparkSession
    n = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    order = [F.col("doc_id").asc_nulls_first(), F.xxhash64("text")]
    ordered = slim.repartitionByRange(n, *order).sortWithinPartitions(*order)
    written = ordered.mapInArrow(_writer(_local(uri), vocabulary, bits), "part long, docs long, tokens long, bits long").collect()
    held = spark.createDataFrame(written, "part long, docs long, tokens long, bits long").coalesce(1)
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    return held.withColumns(
        {"base": F.coalesce(F.sum("tokens").over(before), F.lit(0)), "first": F.coalesce(F.sum("docs").over(before), F.lit(0))}
    )


def _reader(folder: str, block: int = 4096):
    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                path = f"{folder}/{row['part']:06d}"
                ids = np.memmap(f"{path}.ids", f"<u{row['bits'] // 8}", "r")
                off = np.memmap(f"{path}.off", "<u8", "r")
                doc = np.memmap(f"{path}.doc", "<i8", "r")
                for at in range(0, len(doc), block):
                    cuts = off[at : at + block + 1].astype(np.int64)
                    crcs = [zlib.crc32(ids[s:e].astype("<u4").tobytes()) for s, e in zip(cuts[:-1], cuts[1:])]
                    names = np.array(doc[at : at + block])
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(names, mask=names == NO_ID), pa.array(cuts[:-1] + row["base"]), pa.array(np.diff(cuts)), pa.array(crcs, pa.int64())],
                        names=["doc_id", "start", "n_tokens", "ids_crc32"],
                    )

    return run


def read_tokens(manifest: DataFrame, uri: str) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of every document, from the files."""
    spread = manifest.select("part", "bits", "base").repartition(manifest.sparkSession.sparkContext.defaultParallelism * 2, "part")
    return spread.mapInArrow(_reader(_local(uri)), "doc_id long, start long, n_tokens long, ids_crc32 long")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    uri = fresh_path(spark, "tokens")
    manifest = write_tokens(table(spark, sf_dir, "documents"), uri, public_tokenizers.path(TOKENIZER))
    return read_tokens(manifest, uri)


QUERIES = {"op10_token_binary": query}
ORACLES: dict[str, str] = {}
