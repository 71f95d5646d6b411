"""Alignment of two tokenizers' tokens over the same text by a sweep over their ends.

Each token is an event at the byte offset where it ends.  Events of both sides
are united (in rows of up to BLOCK consecutive events of one side, as lengths
and ids), dealt out by document, sorted by offset and streamed through a
machine that knows the open token of each side: at every offset with an event
the two open tokens overlap, which is one link; where both end, the group of
tokens since the last such offset closes.  The machine holds what a batch of
rows left open, never a document.

How many documents hold a pair of ids is counted from chunks of documents:
a chunk's different pairs are a dictionary with counts, and its documents refer
to entries.  So the shuffle carries a pair once a chunk, not once a document.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from changelens.llm.base import Scratch
from changelens.llm.packing import Encoder, token_bytes, tokenizer_path

#: Events in a row; links in a chunk (one document more at most).
BLOCK, CHUNK_LINKS = 8192, 1 << 20
EVENTS = "key long, doc_id long, at long, side int, lengths binary, ids binary"
#: One row a document (docs null), or one row a chunk (doc_id null) with its different pairs and their documents.
CHUNKS = "chunk long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, entries binary, times binary, pairs array<long>, docs array<int>"
GROUPS = "doc_id long, start long, end long, a_ids array<int>, b_ids array<int>"
DOC = CHUNKS.split(", ")[1:7]


def narrow(top: int) -> np.dtype:
    """The smallest unsigned type for numbers up to `top`."""
    return np.dtype("<u1" if top < 1 << 8 else "<u2" if top < 1 << 16 else "<u4")


class Sides:
    """Both tokenizers with the bytes of their entries."""

    def __init__(self, a_path: str, b_path: str):
        import sentencepiece

        self.a = Encoder(a_path).coder
        self.b = sentencepiece.SentencePieceProcessor(model_file=b_path)
        of_a = {i: x for x, i in token_bytes(a_path).items()}
        self.a_bytes = [of_a.get(i, b"") for i in range(max(of_a) + 1)]
        piece = lambda i: bytes([int(self.b.id_to_piece(i)[3:-1], 16)]) if self.b.is_byte(i) else self.b.id_to_piece(i).replace("▁", " ").encode()
        self.b_bytes = [piece(i) for i in range(self.b.get_piece_size())]
        self.lengths = [np.array([len(x) for x in side]) for side in (self.a_bytes, self.b_bytes)]
        self.id_type = [narrow(len(side)) for side in self.lengths]
        self.length_type = [narrow(int(side.max())) for side in self.lengths]

    def encode(self, text: str) -> tuple[np.ndarray, np.ndarray] | None:
        """Ids of both sides for a space and the text; None where their bytes are others."""
        if not text:
            return None
        whole = f" {text}"
        a = self.a.encode_to_numpy(whole, disallowed_special=())
        b = np.array(self.b.encode(text, num_threads=1), np.int64)
        raw = whole.encode()
        if any(b"".join(map(side.__getitem__, ids.tolist())) != raw for side, ids in ((self.a_bytes, a), (self.b_bytes, b))):
            return None
        return a, b


@lru_cache(maxsize=2)
def sides(a_path: str | None, b_path: str | None) -> Sides:
    return Sides(a_path or tokenizer_path(), b_path or piece_path())


def piece_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def _events(a_path: str | None, b_path: str | None, block: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of, key = sides(a_path, b_path), TaskContext.get().partitionId() << 40
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.binary()]
        names, rows = [c.split()[0] for c in EVENTS.split(", ")], []
        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                both, key = of.encode(text.as_py() or ""), key + 1
                if both is None:
                    rows.append((key, doc, 0, 0, b"", b""))
                    continue
                for side, ids in enumerate(both):
                    lengths = of.lengths[side][ids]
                    starts = np.cumsum(lengths) - lengths
                    for k in range(0, len(ids), block):
                        cut = slice(k, k + block)
                        rows.append((key, doc, int(starts[k]), side, lengths[cut].astype(of.length_type[side]).tobytes(), ids[cut].astype(of.id_type[side]).tobytes()))
                if len(rows) >= 1000:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names)
                    rows = []
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    return run


def events(docs: DataFrame, a_path: str | None = None, b_path: str | None = None, block: int = BLOCK) -> DataFrame:
    """Events of both sides by document (an inner key), in the order of their offsets."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(_events(a_path, b_path, block), EVENTS).repartition("key").sortWithinPartitions("key", "at", "side")


class Swept:
    """What lies between two offsets at which both sides end: tokens in order and links, over documents in a row."""

    def __init__(self, ids: list[np.ndarray], lengths: list[np.ndarray]):
        a, b = (np.cumsum(x, dtype=np.int64) for x in lengths)
        order = np.argsort(np.concatenate([a, b]), kind="stable")  # a merge of two sorted runs; A before B at one offset
        ends, is_a = np.concatenate([a, b])[order], order < len(a)
        seen_a = np.cumsum(is_a)
        seen_b = np.arange(1, len(order) + 1) - seen_a
        last = np.append(ends[1:] != ends[:-1], True)
        shared = np.append(False, ~last[:-1])
        self.closes = np.flatnonzero(shared)  # places in `order` at which a group closes
        done = int(self.closes[-1]) + 1 if len(self.closes) else 0
        self.used = (int(seen_a[done - 1]), int(seen_b[done - 1])) if done else (0, 0)
        order, is_a, last, shared = order[:done], is_a[:done], last[:done], shared[:done]
        self.link_ends = ends[:done][last]
        self.link_a = ids[0][(seen_a[:done] - (is_a | shared))[last]]
        self.link_b = ids[1][(seen_b[:done] - ~is_a)[last]]
        self.group_ends = ends[self.closes]
        group = np.cumsum(shared) - shared  # of each event
        side_order = np.argsort(2 * group + ~is_a, kind="stable")  # within a group A's tokens, then B's
        n_a = len(a)
        token = order[side_order]
        self.side = (token >= n_a).astype(np.int8)
        self.token_ids = np.where(self.side == 0, ids[0][np.minimum(token, max(n_a - 1, 0))], ids[1][np.maximum(token - n_a, 0)]) if done else np.zeros(0, np.int64)
        self.token_group = group[side_order]
        self.a_ends, self.b_ends = a[: self.used[0]], b[: self.used[1]]


class Machine:
    """Streams event rows; `documents` gives each (doc_id, part, is its last part) with the part's tokens and links."""

    def __init__(self, of: Sides, limit: int = CHUNK_LINKS):
        self.of, self.limit = of, limit
        self.key = self.doc = None
        self.waiting: list[tuple] = []  # (doc_id, tokens A, tokens B) of documents that are whole in the buffer
        self.ids: list[list] = [[], []]
        self.lengths: list[list] = [[], []]
        self.counts, self.size = [0, 0], 0

    def _take(self, whole: bool) -> Iterator[tuple]:
        """Sweeps the buffer: all of it if its last document is whole, else what has closed."""
        ids = [np.concatenate([np.zeros(0, np.int64), *x]) for x in self.ids]
        lengths = [np.concatenate([np.zeros(0, np.int64), *x]) for x in self.lengths]
        swept = Swept(ids, lengths)
        docs = self.waiting + ([] if whole else [(self.doc, *self.counts)])
        yield swept, docs, whole
        rest = [len(x) - n for x, n in zip(ids, swept.used, strict=True)]
        self.ids = [[x[n:]] for x, n in zip(ids, swept.used, strict=True)]
        self.lengths = [[x[n:]] for x, n in zip(lengths, swept.used, strict=True)]
        self.waiting, self.counts, self.size = [], rest, sum(rest)

    def feed(self, batch: pa.RecordBatch) -> Iterator[tuple]:
        for key, doc, _, side, lengths, ids in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if key != self.key:
                yield from self._close()
                self.key, self.doc = key, doc
            one = np.frombuffer(ids, self.of.id_type[side])
            self.ids[side].append(one)
            self.lengths[side].append(np.frombuffer(lengths, self.of.length_type[side]))
            self.counts[side] += len(one)
            self.size += len(one)
            if self.size > 2 * self.limit:
                yield from self._take(False)

    def _close(self) -> Iterator[tuple]:
        if self.key is not None:
            self.waiting.append((self.doc, *self.counts))
            self.counts = [0, 0]
            if self.size > self.limit:
                yield from self._take(True)

    def end(self) -> Iterator[tuple]:
        yield from self._close()
        if self.waiting:
            yield from self._take(True)


class Chunks:
    """Counts, group digests and chunk dictionaries from what the machine emits."""

    def __init__(self, of: Sides):
        self.n = TaskContext.get().partitionId() << 32
        top = max(len(x) for x in of.lengths)
        self.top = top
        # each id with the mark before it: first of all, same side, A to B, next group
        self.text = [mark + str(i).encode() for mark in (b"", b",", b"|", b";") for i in range(top)]
        self.open()

    def open(self) -> None:
        """A document that the last sweep has left open: digest, counts, pairs."""
        self.digest, self.totals, self.pairs = hashlib.sha256(), np.zeros(4, np.int64), (np.zeros(0, np.int64), np.zeros(0, np.int64))
        self.begun = False

    def add(self, swept: Swept, docs: list[tuple], whole: bool) -> Iterator[pa.RecordBatch]:
        # documents' shares of tokens, groups and links; both sides of a document end together
        count_a, count_b = (np.array([d[k] for d in docs], np.int64) for k in (1, 2))
        if not whole:
            count_a[-1] -= count_a.sum() - swept.used[0]
            count_b[-1] -= count_b.sum() - swept.used[1]
        upto = np.append(0, swept.a_ends)[np.cumsum(count_a)]
        groups, links = (np.searchsorted(x, upto, "right") for x in (swept.group_ends, swept.link_ends))
        first = np.append(True, swept.token_group[1:] != swept.token_group[:-1])
        turn = np.append(False, swept.side[1:] != swept.side[:-1])
        mark = np.where(first, 3, np.where(turn, 2, 1))
        upto_tokens = np.cumsum(count_a + count_b)
        starts = np.append(0, upto_tokens[:-1])[count_a > 0]
        mark[starts] = 0
        if self.totals[0] and count_a[0]:
            mark[0] = 3  # goes on where the last sweep stopped
        text = list(map(self.text.__getitem__, (mark * self.top + swept.token_ids).tolist()))
        pairs = swept.link_a.astype(np.int64) << 32 | swept.link_b.astype(np.int64)
        known, entry = np.unique(pairs, return_inverse=True)
        of_doc = np.repeat(np.arange(len(docs)), np.diff(links, prepend=0))
        held, times = np.unique(of_doc * max(1, len(known)) + entry, return_counts=True)
        bounds = np.searchsorted(held // max(1, len(known)), np.arange(len(docs) + 1)) if len(held) else np.zeros(len(docs) + 1, np.int64)
        held = held % max(1, len(known))
        rows = []
        for k, (doc, _, _) in enumerate(docs):
            self.digest.update(b"".join(text[upto_tokens[k] - count_a[k] - count_b[k] : upto_tokens[k]]))
            self.totals += (count_a[k], count_b[k], groups[k] - (groups[k - 1] if k else 0), links[k] - (links[k - 1] if k else 0))
            at = slice(bounds[k], bounds[k + 1])
            mine = known[held[at]], times[at]
            if not whole and k == len(docs) - 1:
                self.begun, self.pairs = True, self._sum(mine)
                break
            if self.begun:
                mine = self._sum(mine)
            rows.append((doc, *map(int, self.totals), self.digest.hexdigest() if self.totals[0] else "", *mine))
            self.open()
        if rows:
            yield from self._emit(rows)

    def _sum(self, more: tuple) -> tuple:
        pairs, at = np.unique(np.concatenate([self.pairs[0], more[0]]), return_inverse=True)
        return pairs, np.bincount(at, np.concatenate([self.pairs[1], more[1]]), len(pairs)).astype(np.int64)

    def _emit(self, rows: list[tuple]) -> Iterator[pa.RecordBatch]:
        known, entry, docs = np.unique(np.concatenate([r[6] for r in rows]), return_inverse=True, return_counts=True)
        sizes = np.cumsum([len(r[6]) for r in rows])
        entries = [x.astype("<u4").tobytes() for x in np.split(entry, sizes[:-1])]
        n, null = len(rows), [None]
        cols = [list(c) for c in zip(*(r[:6] for r in rows), strict=True)]
        kinds = [pa.int64()] * 5 + [pa.string()]
        out = [pa.array([self.n] * (n + 1), pa.int64()), *(pa.array(c + null, t) for c, t in zip(cols, kinds, strict=True))]
        out += [pa.array(entries + null, pa.binary()), pa.array([r[7].astype("<u4").tobytes() for r in rows] + null, pa.binary())]
        out += [pa.array([None] * n + [known], pa.list_(pa.int64())), pa.array([None] * n + [docs.astype(np.int32)], pa.list_(pa.int32()))]
        yield pa.RecordBatch.from_arrays(out, [c.split()[0] for c in CHUNKS.split(", ")])
        self.n += 1


def _chunks(a_path: str | None, b_path: str | None, limit: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = sides(a_path, b_path)
        machine, chunks = Machine(of, limit), Chunks(of)
        for batch in batches:
            for swept in machine.feed(batch):
                yield from chunks.add(*swept)
        for swept in machine.end():
            yield from chunks.add(*swept)

    return run


def _counted(docs: pa.Table, entries: pa.Table) -> pa.Table:
    """Documents of a chunk with sums over their links of the counts of the links' pairs."""
    at = entries.column("at").to_numpy()
    docs_of, best_of = np.zeros(len(at), np.int64), np.zeros(len(at), np.int64)
    docs_of[at], best_of[at] = entries.column("n").to_numpy(), entries.column("best").to_numpy(zero_copy_only=False)
    n_best, count_sum = [], []
    for held, times in zip(docs.column("entries"), docs.column("times"), strict=True):
        held, times = np.frombuffer(held.as_py(), "<u4"), np.frombuffer(times.as_py(), "<u4").astype(np.int64)
        n_best.append(int((times * best_of[held]).sum()))
        count_sum.append(int((times * docs_of[held]).sum()))
    kept = [c.split()[0] for c in DOC]
    return pa.Table.from_arrays([*(docs.column(c) for c in kept), pa.array(n_best, pa.int64()), pa.array(count_sum, pa.int64())], names=[*kept, "n_best", "count_sum"])


def _counts(entries: DataFrame) -> DataFrame:
    """pair, n (documents that hold it linked), best: no pair of the same A id is held by more."""
    counts = entries.groupBy("pair").agg(F.sum("docs").alias("n")).withColumn("a", F.shiftright("pair", 32))
    most = counts.groupBy("a").agg(F.max("n").alias("most"))
    return counts.join(most, "a").select("pair", "n", (F.col("n") == F.col("most")).alias("best"))


def _entries(chunks: DataFrame) -> DataFrame:
    both = F.posexplode(F.arrays_zip("pairs", "docs")).alias("at", "x")
    return chunks.where("docs is not null").select("chunk", both).select("chunk", "at", F.col("x.pairs").alias("pair"), F.col("x.docs").alias("docs"))


def align(docs: DataFrame, a_path: str | None = None, b_path: str | None = None, limit: int = CHUNK_LINKS, block: int = BLOCK) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, groups_sha256, n_best, count_sum of each text under tokenizers A and B.

    A: a byte-level tokenizer file, over a space and the text; B: a sentencepiece
    model, which adds the space itself.  Strings of special tokens are plain text.

    Defined cases: a text that is null or empty, or that one side doesn't give
    back byte by byte, has no tokens: zeros, and '' for the digest; repeated rows
    and ids are documents each; a null doc_id stays null; an empty table gives an
    empty result; other columns are ignored.
    """
    scratch = Scratch(docs.sparkSession, "alignment")
    chunks = scratch.write(events(docs, a_path, b_path, block).mapInArrow(_chunks(a_path, b_path, limit), CHUNKS), "chunks")
    counts = scratch.write(_counts(_entries(chunks)), "counts")
    found = _entries(chunks).join(counts, "pair").select(F.col("chunk").alias("of_chunk"), "at", "n", "best")
    held = chunks.where("docs is null").select("chunk", *[c.split()[0] for c in DOC], "entries", "times")
    return held.groupBy("chunk").cogroup(found.groupBy("of_chunk")).applyInArrow(_counted, ", ".join([*DOC, "n_best long", "count_sum long"]))


def pair_counts(docs: DataFrame, a_path: str | None = None, b_path: str | None = None, limit: int = CHUNK_LINKS, block: int = BLOCK) -> DataFrame:
    """a_id, b_id, docs: how many documents hold a token a overlapping a token b."""
    chunks = events(docs, a_path, b_path, block).mapInArrow(_chunks(a_path, b_path, limit), CHUNKS)
    out = _entries(chunks).groupBy("pair").agg(F.sum("docs").alias("docs"))
    return out.select(F.shiftright("pair", 32).cast("int").alias("a_id"), F.col("pair").bitwiseAND(0xFFFFFFFF).cast("int").alias("b_id"), "docs")


def groups(docs: DataFrame, a_path: str | None = None, b_path: str | None = None, limit: int = CHUNK_LINKS, block: int = BLOCK) -> DataFrame:
    """doc_id, start, end, a_ids, b_ids: the smallest runs of tokens of both sides over the same bytes of a space and the text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine, before = Machine(sides(a_path, b_path), limit), 0

        def rows(swept: Swept, docs: list[tuple], whole: bool) -> pa.RecordBatch:
            nonlocal before
            count = np.array([d[1] for d in docs], np.int64)
            if not whole:
                count[-1] -= count.sum() - swept.used[0]
            upto = np.append(0, swept.a_ends)[np.cumsum(count)]
            starts = np.append(0, swept.group_ends[:-1])[: len(swept.group_ends)]
            of = np.searchsorted(upto, starts, "right")
            base = np.append(-before, upto[:-1])
            sizes = [np.bincount(swept.token_group[swept.side == s], minlength=len(starts)) for s in (0, 1)]
            lists = [pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(n)), pa.int32()), pa.array(swept.token_ids[swept.side == s], pa.int32())) for s, n in enumerate(sizes)]
            out = [pa.array([docs[k][0] for k in of], pa.int64()), pa.array(starts - base[of]), pa.array(swept.group_ends - base[of]), *lists]
            before = 0 if whole else int(upto[-1] - base[-1])
            return pa.RecordBatch.from_arrays(out, [c.split()[0] for c in GROUPS.split(", ")])

        for batch in batches:
            for swept in machine.feed(batch):
                yield rows(*swept)
        for swept in machine.end():
            yield rows(*swept)

    return events(docs, a_path, b_path, block).mapInArrow(run, GROUPS)
