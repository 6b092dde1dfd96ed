"""Token counts that follow edits.

A document is cut into pre-tokens by the tokenizer's pattern; a segment tree over them holds
sums of characters and of tokens. An edit (start, remove, insert) descends to the pre-token
CONTEXT characters before it, cuts the changed text anew from there until a cut falls on an
old one behind the edit, encodes those pre-tokens alone and updates the sums above them. The
pattern matches from left to right, looks back at nothing and looks ahead less than CONTEXT
characters, so that all other pre-tokens are what cutting the whole text would give.

build_trees() makes a table of trees, edit_trees() gives that table after edits without cutting
or encoding the rest of the texts again; its sums come from the table. count_edited() does
both for rows that are counted once, without a table between, which would be larger than the
texts.

Null and empty texts have no tokens. Starts and lengths are clamped to the text; edits apply
one after the other, each to what the one before left. Null edits change nothing. Repeated
rows are counted each for itself.
"""

from __future__ import annotations

import base64

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from locuspark.llm.common import table

RANKS, CONTEXT, REMEMBERED, AHEAD = "byte_bpe_50k.tiktoken", 8, 500_000, 64


class Counter:
    """Pre-tokens of a text, and the number of tokens of each."""

    def __init__(self, path: str, pattern: str):
        import tiktoken

        with open(path, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.coder = tiktoken.Encoding("counts", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.cut = regex.compile(pattern).findall
        self.known: dict[str, int] = {}

    def counts(self, pieces: list[str]) -> list[int]:
        known = self.known
        try:
            return list(map(known.__getitem__, pieces))
        except KeyError:
            if len(known) > REMEMBERED:
                known.clear()
            for p in pieces:
                if p not in known:
                    known[p] = len(self.coder._encode_single_piece(p))
            return list(map(known.__getitem__, pieces))


class SegmentTree:
    """Pre-tokens of one document with sums; slots an edit has rewritten hold several or none."""

    #: The text that slots are slices of, where they are not held one by one.
    whole = ""

    def __init__(self, pieces: list[str], counts: list[int]):
        self.n = max(len(pieces), 1)
        self.size = 1 << (self.n - 1).bit_length()
        self.slots = dict(enumerate(pieces))
        self.tokens, self.chars = np.zeros(2 * self.size, np.int64), np.zeros(2 * self.size, np.int64)
        self.tokens[self.size : self.size + len(counts)] = counts
        self.chars[self.size : self.size + len(pieces)] = [len(p) for p in pieces]
        at = self.size
        while at > 1:
            for sums in (self.tokens, self.chars):
                sums[at // 2 : at] = sums[at : 2 * at : 2] + sums[at + 1 : 2 * at : 2]
            at //= 2

    @classmethod
    def kept(cls, text: str, slots: int, chars: np.ndarray, tokens: np.ndarray) -> SegmentTree:
        """A tree as build_trees() keeps it; slots are read from the text when an edit needs them."""
        own = cls.__new__(cls)
        own.n, own.size, own.slots = slots, (len(chars) + 1) // 2, {}
        own.chars, own.tokens = (np.r_[0, x].astype(np.int64) for x in (chars, tokens))
        own.whole, own.starts = text, np.r_[0, np.cumsum(own.chars[own.size : own.size + slots])]
        return own

    def find(self, place: int) -> tuple[int, int]:
        """The slot that holds a character, or the last one, and the characters before it."""
        at, before = 1, 0
        while at < self.size:
            at *= 2
            if place >= before + self.chars[at]:
                before += int(self.chars[at])
                at += 1
        slot = min(at - self.size, self.n - 1)
        if slot < at - self.size:
            before = int(self.chars[1] - self.chars[self.size + slot])
        return slot, before

    def text(self, slot: int) -> str:
        held = self.slots.get(slot)
        if held is None:
            return self.whole[self.starts[slot] : self.starts[slot + 1]] if self.whole else ""
        return held

    def now(self) -> str:
        """The text after all edits: what is between rewritten slots comes from the text as it was."""
        if not self.whole:
            return "".join(self.text(i) for i in range(self.n))
        out, at = [], 0
        for slot in sorted(self.slots):
            out += [self.whole[self.starts[at] : self.starts[slot]], self.slots[slot]]
            at = slot + 1
        return "".join([*out, self.whole[self.starts[at] :]])

    def put(self, slot: int, pieces: list[str], tokens: int) -> None:
        self.slots[slot] = "".join(pieces)
        at = self.size + slot
        more, longer = tokens - self.tokens[at], sum(map(len, pieces)) - self.chars[at]
        if more or longer:
            while at:
                self.tokens[at] += more
                self.chars[at] += longer
                at //= 2

    def edit(self, counter: Counter, start: int, remove: int, insert: str) -> int:
        """Applies an edit; returns the number of pre-tokens encoded for it."""
        whole = int(self.chars[1])
        start = min(max(start, 0), whole)
        remove = min(max(remove, 0), whole - start)
        first, before = self.find(max(start - CONTEXT, 0))
        parts, ends, end, slot = [], [], before, first
        goal = start + remove + AHEAD
        while True:
            while slot < self.n and end < goal:
                parts.append(self.text(slot))
                end += len(parts[-1])
                slot += 1
                ends.append(end)
            old = "".join(parts)
            new = old[: start - before] + insert + old[start - before + remove :]
            shift = len(insert) - remove
            pieces = counter.cut(new)
            known = {e + shift - before: i for i, e in enumerate(ends)}
            place, at_end = 0, slot >= self.n
            for k, p in enumerate(pieces):
                place += len(p)
                sure = at_end or place <= len(new) - CONTEXT
                if sure and place >= start - before + len(insert) and place in known:
                    pieces, last = pieces[: k + 1], known[place]
                    break
            else:
                if not at_end:
                    goal = end + 2 * (end - before)
                    continue
                last = len(ends) - 1
            self.put(first, pieces, sum(counter.counts(pieces)))
            for i in range(first + 1, first + last + 1):
                self.put(i, [], 0)
            return len(pieces)


_counters: dict[str, Counter] = {}


def counter(path: str, pattern: str) -> Counter:
    if path not in _counters:
        _counters[path] = Counter(path, pattern)
    return _counters[path]


TREES = "doc_id long, text string, slots int, chars array<long>, tokens array<long>"


def _trees_batch(ids, trees: list[SegmentTree], texts: list[str | None], extra: dict) -> pa.RecordBatch:
    sums = [pa.array([getattr(t, c)[1:] for t in trees], pa.list_(pa.int64())) for c in ("chars", "tokens")]
    columns = [ids, pa.array(texts, pa.string()), pa.array([t.n for t in trees], pa.int32()), *sums, *extra.values()]
    return pa.RecordBatch.from_arrays(columns, names=["doc_id", "text", "slots", "chars", "tokens", *extra])


def build_trees(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id, text, slots, chars and tokens (sums, level by level from the root) for docs (doc_id, text)."""

    def run(batches):
        own = counter(path, pattern)
        for batch in batches:
            for at in range(0, batch.num_rows, 128):
                rows, trees = batch.slice(at, 128), []
                texts = rows.column("text").to_pylist()
                for text in texts:
                    pieces = own.cut(text or "")
                    trees.append(SegmentTree(pieces, own.counts(pieces)))
                yield _trees_batch(rows.column("doc_id"), trees, texts, {})

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, TREES)


def edit_trees(trees: DataFrame, path: str, pattern: str) -> DataFrame:
    """The table of trees after edits, for trees (as of build_trees, and edits), with n_recoded.

    A tree whose row has no edits comes back as it is. Texts that were null stay null unless
    an edit inserts something.
    """

    def run(batches):
        own = counter(path, pattern)
        for batch in batches:
            for at in range(0, batch.num_rows, 128):
                rows = batch.slice(at, 128)
                held, texts, again = [], [], []
                for text, slots, chars, tokens, edits in zip(*[rows.column(c) for c in ("text", "slots", "chars", "tokens", "edits")]):
                    text, edits = text.as_py(), [e for e in edits.as_py() or () if e]
                    tree = SegmentTree.kept(text or "", slots.as_py(), chars.values.to_numpy(), tokens.values.to_numpy())
                    again.append(sum(_applied(tree, own, e) for e in edits))
                    new = tree.now() if edits else text
                    held.append(tree)
                    texts.append(new if new or text is not None else None)
                yield _trees_batch(rows.column("doc_id"), held, texts, {"n_recoded": pa.array(again, pa.int64())})

    return trees.select("doc_id", "text", "slots", "chars", "tokens", "edits").mapInArrow(run, f"{TREES}, n_recoded long")


def _applied(tree: SegmentTree, own: Counter, e: dict) -> int:
    return tree.edit(own, e["start"] or 0, e["remove"] or 0, e["insert"] or "")


def count_edited(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """Counts before and after edits, for docs (doc_id, text, edits).

    edits: array of structs (start, remove, insert). Returns doc_id, n_pretokens, n_tokens,
    n_tokens_edited and n_recoded, the pre-tokens encoded for the edits.
    """

    def run(batches):
        own = counter(path, pattern)
        for batch in batches:
            out = []
            for text, edits in zip(batch.column("text"), batch.column("edits").to_pylist()):
                pieces = own.cut(text.as_py() or "")
                tree = SegmentTree(pieces, own.counts(pieces))
                n, before = len(pieces), int(tree.tokens[1])
                again = sum(_applied(tree, own, e) for e in edits or () if e)
                out.append((n, before, int(tree.tokens[1]), again))
            made = [pa.array(c, pa.int64()) for c in (zip(*out) if out else ((), (), (), ()))]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *made], names=["doc_id", "n_pretokens", "n_tokens", "n_tokens_edited", "n_recoded"])

    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", "edits")
    return slim.mapInArrow(run, "doc_id long, n_pretokens long, n_tokens long, n_tokens_edited long, n_recoded long")


def with_edits(docs: DataFrame, edits: DataFrame) -> DataFrame:
    """docs, or trees, with the rows of edits (doc_id, seq, start, remove, insert) as an array in order of seq.

    Rows with the same id get the same edits, rows with a null id none; other columns stay.
    """
    one = F.struct("seq", F.col("start").cast("long").alias("start"), F.col("remove").cast("long").alias("remove"), "insert")
    grouped = edits.groupBy("doc_id").agg(F.array_sort(F.collect_list(one)).alias("edits"))
    return docs.join(grouped, "doc_id", "left")


def planned_edits() -> Column:
    """Three edits that a row's id and length give: an insertion, a removal and a replacement."""
    n, i = F.coalesce(F.char_length("text"), F.lit(0)).cast("long"), F.coalesce(F.abs("doc_id"), F.lit(0)).cast("long") % 1000003
    one = lambda at, remove, insert: F.struct((at % (n + 1)).alias("start"), F.lit(remove).cast("long").alias("remove"), F.lit(insert).alias("insert"))
    return F.array(one(i * 7919 + 13, 0, " an inserted phrase"), one(i * 104729 + 71, 9, ""), one(i * 1299709 + 5, 4, "'s new"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = table(spark, sf_dir, "documents").withColumn("edits", planned_edits())
    return count_edited(docs, public_tokenizers.path(RANKS), public_tokenizers.PATTERN)


QUERIES = {"op9_token_counts": query}
ORACLES: dict[str, str] = {}
