"""Planning of alignment scans from a file's index: which byte ranges hold a region's records.

A virtual offset is the place of a compressed block in the file, in its upper 48 bits, and a
place in the inflated block.
"""

from __future__ import annotations

import struct
from bisect import bisect_right
from dataclasses import dataclass, field

# Fixed values of the index format: first bin and log2 of the positions in a bin, by level,
# positions in a window of the linear index, and the bin that holds metadata.
LEVELS = ((0, 29), (1, 26), (9, 23), (73, 20), (585, 17), (4681, 14))
WINDOW_SHIFT, META_BIN = 14, 37450


def split_offset(v: int) -> tuple[int, int]:
    """Place of the block in the file, and place in the block."""
    return v >> 16, v & 0xFFFF


def join_offset(block: int, within: int) -> int:
    return block << 16 | within


def bins_of(beg: int, stop: int) -> list[int]:
    """All bins whose positions meet [beg, stop)."""
    return [b for first, shift in LEVELS for b in range(first + (beg >> shift), first + ((stop - 1) >> shift) + 1)]


def merge_chunks(chunks: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Chunks in order, joined where they overlap or touch."""
    out: list[tuple[int, int]] = []
    for beg, stop in sorted(chunks):
        if out and beg <= out[-1][1]:
            out[-1] = out[-1][0], max(out[-1][1], stop)
        elif beg < stop:
            out.append((beg, stop))
    return out


@dataclass
class Contig:
    bins: dict[int, list[tuple[int, int]]] = field(default_factory=dict)
    #: Least virtual offset of a record that reaches into each window.
    linear: list[int] = field(default_factory=list)

    def least(self, beg: int) -> int:
        """No record that ends behind beg begins before this virtual offset."""
        at = beg >> WINDOW_SHIFT
        return self.linear[min(at, len(self.linear) - 1)] if self.linear else 0

    def chunks(self, beg: int, stop: int) -> list[tuple[int, int]]:
        least = self.least(beg)
        found = [c for b in bins_of(beg, stop) for c in self.bins.get(b, ())]
        return [(max(a, least), z) for a, z in found if z > least]


def parse_index(raw: bytes) -> list[Contig]:
    if raw[:4] != b"BAI\1":
        raise ValueError("not an alignment index")
    (n_ref,), at = struct.unpack_from("<i", raw, 4), 8
    out = []
    for _ in range(n_ref):
        contig = Contig()
        (n_bin,) = struct.unpack_from("<i", raw, at)
        at += 4
        for _ in range(n_bin):
            name, n = struct.unpack_from("<Ii", raw, at)
            at += 8
            flat = struct.unpack_from(f"<{2 * n}Q", raw, at)
            at += 16 * n
            if name != META_BIN:
                contig.bins[name] = list(zip(flat[::2], flat[1::2]))
        (n,) = struct.unpack_from("<i", raw, at)
        contig.linear = list(struct.unpack_from(f"<{n}Q", raw, at + 4))
        at += 4 + 8 * n
        out.append(contig)
    return out


def chunk_bytes(chunk: tuple[int, int]) -> int:
    """Compressed bytes of a chunk, but for its last block."""
    return split_offset(chunk[1])[0] - split_offset(chunk[0])[0]


def plan(index: list[Contig], regions: list[tuple[int, int, int]] | None, first: int, most: int) -> list[tuple[int, int | None]]:
    """Disjoint ranges of virtual offsets that hold all records of regions, of about `most` bytes.

    Ranges are cut only at offsets that the linear index names, as records begin there.
    Without regions, all records from the virtual offset `first` on; the last range then has no
    end, for records without a place stand behind the others.
    """
    marks = sorted({v for c in index for v in c.linear if v > first})
    if regions is None:
        whole: list[tuple[int, int | None]] = [(first, None)]
    else:
        whole = list(merge_chunks([c for tid, beg, stop in regions if tid < len(index) for c in index[tid].chunks(beg, stop)]))
    out: list[tuple[int, int | None]] = []
    for beg, stop in whole:
        at = bisect_right(marks, beg)
        while at < len(marks) and (stop is None or marks[at] < stop):
            if chunk_bytes((beg, marks[at])) >= most:
                out.append((beg, marks[at]))
                beg = marks[at]
            at += 1
        out.append((beg, stop))
    return out
