"""Sampled segmentations into the pieces of a SentencePiece vocabulary, and their decoding.

A text is a lattice whose edges are the vocabulary's pieces, with a space for U+2581, and,
for each character that is no piece, its UTF-8 bytes as byte pieces. A piece's log
probability is alpha times minus the log of its place in the vocabulary (Zipf). Forward
filtering sums the paths to each character; backward sampling then draws the last piece of
the text, the one before it and so on, in proportion to the paths it closes. Draws come from
a hash of (seed, row key, place), so the same key, text and seed give the same pieces
anywhere. Between two characters that stand side by side in no piece every path has a node;
sampling hence splits there, exactly, and a part's filtered lattice is kept, under a 64-bit
hash, for when it comes again.

Decoding joins the pieces' bytes and gives the text back exactly: there is no normalisation
and no added space, and a U+2581 of the text itself is spelled in bytes. Null texts give null
ids and decode to null; empty texts give empty ids; a null key counts as 0.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from locuspark.llm.common import table
from locuspark.llm.shingles import INVERSE, MULTIPLIER, mix, power

MODEL, ALPHA, SEED = "piece_bpe_32k.model", 1.0, 11
#: Lattice edges that a Python worker remembers, and characters and texts that are sampled at
#: once. Some 200 bytes a character are in use meanwhile, so these bound a worker's memory;
#: only a part without any cut that is longer than that goes beyond.
REMEMBERED, AT_ONCE, TEXTS = 3_000_000, 1 << 18, 2048
BASE = np.uint64(0x9E3779B97F4A7C15)


def _pair(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return mix(a.astype(np.uint64) << np.uint64(21) | b.astype(np.uint64)) >> np.uint64(42)


def _points(words: list[str]) -> np.ndarray:
    return np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), "<u4")


class Column:
    """A flat array that grows; its room is taken once, and only what is filled is in memory."""

    def __init__(self, kind, room: int):
        self.room, self.n = np.zeros(room, kind), 0

    def add(self, values: np.ndarray) -> None:
        if self.n + len(values) > len(self.room):
            self.room = np.concatenate((self.room[: self.n], np.zeros(len(values) + (1 << 20), self.room.dtype)))
        self.room[self.n : self.n + len(values)] = values
        self.n += len(values)

    def __getitem__(self, at: np.ndarray) -> np.ndarray:
        return self.room[at]


class Lattices:
    """Filtered lattices of parts of texts, in flat arrays."""

    def __init__(self, path: str, alpha: float = ALPHA):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = model.get_piece_size()
        names = [model.id_to_piece(i) for i in range(n)]
        self.bytes_of = [b""] * n
        self.byte_id = np.zeros(256, np.int32)
        texts, ids = [], []
        for i, name in enumerate(names):
            if model.is_byte(i):
                self.byte_id[int(name[1:-1], 16)] = i
                self.bytes_of[i] = bytes([int(name[1:-1], 16)])
            elif not (model.is_control(i) or model.is_unknown(i) or model.is_unused(i)):
                texts.append(name.replace("▁", " "))
                ids.append(i)
                self.bytes_of[i] = texts[-1].encode()
        self.longest = max(map(len, texts))
        self.byte_cost = -alpha * np.log(n)
        self.joined = np.zeros(1 << 22, bool)
        for t in texts:
            points = _points([t])
            self.joined[_pair(points[:-1], points[1:])] = True
        hashes = []
        for t in texts:
            h = np.uint64(0)
            with np.errstate(over="ignore"):
                for c in _points([t]):
                    h = h * BASE + mix(np.array([c + 1], np.uint64))[0]
            hashes.append((len(t), int(h)))
        self.tables = {}
        for length in {length for length, _ in hashes}:
            at = [k for k, (m, _) in enumerate(hashes) if m == length]
            h = np.array([hashes[k][1] for k in at], np.uint64)
            order = np.argsort(h)
            if len(np.unique(h)) < len(h):
                raise ValueError("two pieces with the same hash")
            seen = np.zeros(1 << 20, bool)
            seen[h >> np.uint64(44)] = True
            self.tables[length] = h[order], np.array([ids[k] for k in at], np.int32)[order], seen
        first = min(ids)
        self.cost = -alpha * np.log(np.arange(n) - first + 2.0, where=np.arange(n) >= first, out=np.zeros(n))
        n = REMEMBERED + (1 << 22)
        #: Of a part: its first node and its characters. Of a node: its first edge.
        self.base, self.length, self.head = Column(np.int32, n), Column(np.int32, n), Column(np.int32, n)
        #: Of an edge: running share among the node's edges, characters, ids in the pool.
        self.sums, self.back = Column(np.float64, n), Column(np.int32, n)
        self.first, self.count = Column(np.int32, n), Column(np.int8, n)
        self.pool = Column(np.int32, n)
        self.forget()

    def forget(self) -> None:
        #: Hashes of the parts that are known, ascending, and their rows in what follows.
        self.names, self.rows = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        for column in vars(self).values():
            if isinstance(column, Column):
                column.n = 0

    def learn(self, points: np.ndarray, lengths: np.ndarray) -> None:
        """Adds the lattices of new parts, given one after the other."""
        n, ends = len(points), np.cumsum(lengths)
        left = np.repeat(ends, lengths) - np.arange(n)  # characters up to the end of the part
        coded = mix(points.astype(np.uint64) + np.uint64(1))
        starts, spans, ids = [], [], []
        h = np.zeros(n, np.uint64)
        covered = np.zeros(n, bool)
        for length in range(1, self.longest + 1):
            h = h[: n - length + 1] * BASE + coded[length - 1 :]
            if length not in self.tables or not len(h):
                continue
            known, names, seen = self.tables[length]
            hit = np.flatnonzero(seen[h >> np.uint64(44)] & (left[: len(h)] >= length))
            at = np.minimum(np.searchsorted(known, h[hit]), len(known) - 1)
            real = known[at] == h[hit]
            hit, at = hit[real], at[real]
            starts.append(hit)
            spans.append(np.full(len(hit), length))
            ids.append(names[at])
            if length == 1:
                covered[hit] = True
        single = np.concatenate(ids)
        pool, first, count = [single], [np.arange(len(single))], [np.ones(len(single), np.int64)]
        cost = [self.cost[single]]
        plain = np.flatnonzero(~covered)
        if len(plain):
            raws = [chr(c).encode("utf-8", "surrogatepass") for c in points[plain]]
            counts = np.array([len(r) for r in raws])
            starts.append(plain)
            spans.append(np.ones(len(plain), np.int64))
            first.append(len(single) + np.cumsum(counts) - counts)
            count.append(counts)
            cost.append(counts * self.byte_cost)
            pool.append(self.byte_id[np.frombuffer(b"".join(raws), np.uint8)])
        start, span, cost, first, count = map(np.concatenate, (starts, spans, cost, first, count))
        # Node j of a part stands after its j-th character; a part of m characters has m + 1.
        word = np.repeat(np.arange(len(lengths)), lengths)[start]
        base = np.cumsum(lengths + 1) - (lengths + 1)
        begin = ends - lengths
        source = base[word] + start - begin[word]
        target = source + span
        depth = start - begin[word] + span
        nodes = n + len(lengths)
        order = np.argsort(depth * nodes + target)
        paths = np.full(nodes, -np.inf)
        paths[base] = 0.0
        sorted_target, sorted_depth = target[order], depth[order]
        levels = np.flatnonzero(np.r_[True, sorted_depth[1:] != sorted_depth[:-1]])
        heads = np.flatnonzero(np.r_[True, sorted_target[1:] != sorted_target[:-1]])
        head_at = np.searchsorted(heads, np.r_[levels, len(order)])
        weight = np.empty(len(order))
        for i, lo in enumerate(levels):
            hi = levels[i + 1] if i + 1 < len(levels) else len(order)
            part = order[lo:hi]
            weight[lo:hi] = paths[source[part]] + cost[part]
            mine = heads[head_at[i] : head_at[i + 1]]
            paths[sorted_target[mine]] = np.logaddexp.reduceat(weight[lo:hi], mine - lo)
        share = np.exp(weight - paths[sorted_target])
        by_node = np.lexsort((-share, sorted_target))
        node, share, chosen = sorted_target[by_node], share[by_node], order[by_node]
        running = np.cumsum(share)
        heads = np.flatnonzero(np.r_[True, node[1:] != node[:-1]])
        last = np.r_[heads[1:], len(node)] - 1
        before = np.repeat(np.r_[0.0, running[last[:-1]]], np.diff(np.r_[heads, len(node)]))
        inside = running - before
        inside[last] = 2.0
        head = np.zeros(nodes, np.int64)
        head[node[heads]] = heads + self.sums.n
        self.base.add(base + self.head.n)
        self.length.add(lengths)
        self.head.add(head)
        self.sums.add(inside)
        self.back.add(span[chosen])
        self.first.add(first[chosen] + self.pool.n)
        self.count.add(count[chosen])
        for ids in pool:
            self.pool.add(ids)

    def slices(self, text: str) -> list[str]:
        """A text in slices of about AT_ONCE characters that end where no piece crosses."""
        if len(text) <= AT_ONCE:
            return [text]
        out, at = [], 0
        while at < len(text):
            end = at + AT_ONCE
            while end < len(text):
                points = _points([text[end - 1 : end + 1024]])
                cuts = np.flatnonzero(~self.joined[_pair(points[:-1], points[1:])])
                if len(cuts):
                    end += int(cuts[0])
                    break
                end += len(points) - 1
            out.append(text[at:end])
            at = end
        return out

    def sample(self, texts: list[str], keys: np.ndarray, seed: int, places: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Piece ids of all texts in a row, and the offsets of the texts in them.

        places: how many parts of each text came before in other slices; counted on here.
        """
        if self.sums.n > REMEMBERED:
            self.forget()
        points = _points(texts)
        n = len(points)
        if not n:
            return np.zeros(0, np.int32), np.zeros(len(texts) + 1, np.int64)
        lengths = np.array([len(t) for t in texts], np.int64)
        cut = np.ones(n, bool)
        cut[1:] = ~self.joined[_pair(points[:-1], points[1:])]
        outer = np.cumsum(lengths) - lengths
        cut[outer[lengths > 0]] = True
        starts = np.flatnonzero(cut)
        spans = np.diff(np.r_[starts, n])
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum(mix(points.astype(np.uint64) + np.uint64(1)) * power(MULTIPLIER, n), out=sums[1:])
        named = mix((sums[starts + spans] - sums[starts]) * power(INVERSE, n)[starts] + spans.astype(np.uint64))
        names, one, which = np.unique(named, return_index=True, return_inverse=True)
        at = np.minimum(np.searchsorted(self.names, names), max(len(self.names) - 1, 0))
        new = np.flatnonzero(self.names[at] != names) if len(self.names) else np.arange(len(names))
        if len(new):
            size = spans[one[new]]
            ends = np.cumsum(size)
            self.learn(points[np.arange(ends[-1]) + np.repeat(starts[one[new]] - (ends - size), size)], size)
            order = np.argsort(np.r_[self.names, names[new]])
            self.rows = np.r_[self.rows, np.arange(len(self.rows), len(self.rows) + len(new))][order]
            self.names = np.r_[self.names, names[new]][order]
            at = np.searchsorted(self.names, names)
        words = self.rows[at][which]
        total = len(words)
        sizes = np.searchsorted(starts, np.r_[outer, n])
        sizes = np.diff(sizes)
        place = np.arange(total) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        if places is not None:
            place += np.repeat(places, sizes)
            places += sizes
        state = np.repeat(mix(keys.astype(np.int64).view(np.uint64) + np.array([seed], np.uint64) * BASE), sizes) + place.astype(np.uint64) * np.uint64(0xD1342543DE82EF95)
        state = mix(state)
        base, node = self.base[words], self.base[words] + self.length[words]
        active, steps = np.arange(total), []
        used = np.zeros(total, np.int64)
        while len(active):
            draw = mix(state[active] + np.array([len(steps) + 1], np.uint64) * BASE)
            u = (draw >> np.uint64(12)).astype(np.float64) * 2.0**-52
            edge = self.head[node[active]]
            on = np.flatnonzero(u >= self.sums[edge])
            while len(on):
                edge[on] += 1
                on = on[u[on] >= self.sums[edge[on]]]
            steps.append((active, edge))
            used[active] += 1
            node[active] -= self.back[edge]
            active = active[node[active] > base[active]]
        ends = np.cumsum(used)
        edges = np.empty(int(ends[-1]) if total else 0, np.int32)
        for i, (rows, edge) in enumerate(steps):
            edges[ends[rows] - 1 - i] = edge
        many = self.count[edges].astype(np.int64)
        stops = np.cumsum(many)
        flat = np.arange(int(stops[-1]) if len(stops) else 0) + np.repeat(self.first[edges] - (stops - many), many)
        pieces = np.r_[0, stops][np.r_[0, ends][np.r_[0, np.cumsum(sizes)]]]
        return self.pool[flat], pieces

    def decode(self, ids) -> str:
        return b"".join(map(self.bytes_of.__getitem__, ids)).decode("utf-8", "surrogatepass")


_loaded: dict[tuple[str, float], Lattices] = {}


def lattices(path: str, alpha: float) -> Lattices:
    if (path, alpha) not in _loaded:
        _loaded[path, alpha] = Lattices(path, alpha)
    return _loaded[path, alpha]


def _blocks(batches, path: str, alpha: float, seed: int):
    """(rows, texts, ids, offsets) for each block of texts; a null text has no ids.

    A block has AT_ONCE characters and TEXTS texts at most, or one longer text, which is
    sampled slice by slice.
    """
    own = lattices(path, alpha)
    for batch in batches:
        column, at = batch.column("text"), 0
        while at < batch.num_rows:
            texts, size = [], 0
            while at + len(texts) < batch.num_rows and len(texts) < TEXTS:
                text = column[at + len(texts)].as_py()
                if texts and size + len(text or "") > AT_ONCE:
                    break
                texts.append(text)
                size += len(text or "")
            rows = batch.slice(at, len(texts))
            at += len(texts)
            keys = np.array([k or 0 for k in rows.column("doc_id").to_pylist()], np.int64)
            if size <= AT_ONCE:
                yield own, rows, texts, *own.sample([t or "" for t in texts], keys, seed)
                continue
            place, found = np.zeros(1, np.int64), []
            for part in own.slices(texts[0]):
                found.append(own.sample([part], keys, seed, place)[0])
            ids = np.concatenate(found)
            yield own, rows, texts, ids, np.array([0, len(ids)])


def sample_pieces(docs: DataFrame, path: str, alpha: float = ALPHA, seed: int = SEED) -> DataFrame:
    """doc_id and ids (array of int) for every row of docs (doc_id, text)."""

    def run(batches):
        for _, rows, texts, ids, cuts in _blocks(batches, path, alpha, seed):
            lists = pa.ListArray.from_arrays(pa.array(cuts.astype(np.int32)), pa.array(ids), mask=pa.array([t is None for t in texts]))
            yield pa.RecordBatch.from_arrays([rows.column("doc_id"), lists], names=["doc_id", "ids"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, ids array<int>")


def decode_pieces(encoded: DataFrame, path: str) -> DataFrame:
    """doc_id and text for every row of encoded (doc_id, ids)."""

    def run(batches):
        own = lattices(path, ALPHA)
        for batch in batches:
            texts = [None if x is None else own.decode(x) for x in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")


def encode_digest(docs: DataFrame, path: str, alpha: float = ALPHA, seed: int = SEED) -> DataFrame:
    """doc_id, n_pieces, ids_crc32 (of little-endian uint32 ids) and lossless: decodes to the text."""

    def run(batches):
        for own, rows, texts, ids, cuts in _blocks(batches, path, alpha, seed):
            whole = ids.astype("<u4")
            crcs = [zlib.crc32(whole[s:e].tobytes()) for s, e in zip(cuts[:-1], cuts[1:])]
            same = [own.decode(ids[s:e].tolist()) == (t or "") for t, s, e in zip(texts, cuts[:-1], cuts[1:])]
            yield pa.RecordBatch.from_arrays(
                [rows.column("doc_id"), pa.array(np.diff(cuts)), pa.array(crcs, pa.int64()), pa.array(same)],
                names=["doc_id", "n_pieces", "ids_crc32", "lossless"],
            )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(
        run, "doc_id long, n_pieces long, ids_crc32 long, lossless boolean"
    )


def model_path() -> str:
    import public_tokenizers

    return public_tokenizers.path(MODEL)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_digest(table(spark, sf_dir, "documents"), model_path())


QUERIES = {"op4_pieces": query}
ORACLES: dict[str, str] = {}
