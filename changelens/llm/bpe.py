"""Byte-pair encoding of long texts by concatenation in a tree, and decoding.

A text of more than LEAF characters is cut into leaves wherever the count
falls, not where a word ends.  Leaves are rows that are encoded in parallel;
then neighbours are joined, level by level, each node being the exact encoding
of its own text.  A join re-encodes a window around the cut and lets it grow
until it agrees with both sides: word boundaries until one of the window's is
one of the right side's too, and inside a word that spans the cut the tokens
until the window's first is the left side's and its last the right side's.
Every pair of neighbours then lies within an encoding that is exact, which is
what makes a sequence of tokens the encoding of its bytes.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from changelens.llm.packing import Encoder, added_tokens, token_bytes, tokenizer_path

#: Characters of a leaf.
LEAF = 16_384
NODE = "key long, doc_id long, at long, ids binary, tail long"
IDS = np.dtype("<u4")
#: Characters after a word's first that decide whether it is a contraction.
AHEAD = 3
BREAK = re.compile(r"(?<=[A-Za-z]) (?=[A-Za-z])")


class Coder:
    """Exact encodings of texts and of their joins, for one byte-level tokenizer file."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.encoder = Encoder(path)
        self.added = added_tokens(path)
        self.literal = re.compile("|".join(map(re.escape, self.added)) or r"(?!)")
        self.split = Tokenizer.from_file(path).pre_tokenizer.pre_tokenize_str
        known = {i: b for b, i in token_bytes(path).items()} | {i: x.encode() for x, i in self.added.items()}
        self.bytes = [known.get(i, b"") for i in range(max(known) + 1)]
        self.lengths = np.array([len(b) for b in self.bytes])
        self.held = np.dtype("<u2" if len(self.bytes) <= 1 << 16 else "<u4")  # ids on their way up the tree
        self.added_ids = np.array(sorted(self.added.values()), IDS)

    def encode(self, text: str) -> np.ndarray:
        return np.frombuffer(self.encoder.encode(text), IDS)

    def word(self, raw: bytes) -> np.ndarray:
        """The encoding of bytes that are not split any more."""
        return np.array(self.encoder.coder._encode_single_piece(raw), IDS)

    def raw(self, ids: np.ndarray) -> bytes:
        """The bytes of ids; unknown ids have none."""
        return b"".join([self.bytes[i] if i < len(self.bytes) else b"" for i in ids.tolist()])

    def words(self, text: str) -> list[tuple[int, int]]:
        return [span for _, span in self.split(text)]

    def cuts(self, text: str, leaf: int) -> list[str]:
        """The text in leaves; the literal of an added token is never cut."""
        inside = {k: m.end() for m in self.literal.finditer(text) for k in range(m.start() + 1, m.end())}
        at, out = 0, []
        while at < len(text):
            end = min(len(text), at + leaf)
            end = inside.get(end, end)
            out.append(text[at:end])
            at = end
        return out or [""]

    def unsettled(self, text: str) -> int:
        """How many tokens at the end may change once more text follows."""
        last = [m.end() for m in self.literal.finditer(text)]
        text = text[last[-1] :] if last else text
        near = 256
        while near < len(text):  # a space between two letters begins a word, whatever stands around it
            found = BREAK.search(text, len(text) - near, len(text) - AHEAD * 4)
            if found:
                text = text[found.start() :]
                break
            near *= 4
        start = next((a for a, b in self.words(text) if b >= len(text) or a > len(text) - AHEAD), len(text))
        return len(self.encode(text[start:]))

    def join_words(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The encoding of one word from the encodings of its two parts."""
        k = 2
        while True:
            a, b = max(0, len(left) - k), min(len(right), k)
            window = self.word(self.raw(left[a:]) + self.raw(right[:b]))
            if (not a or window[0] == left[a]) and (b == len(right) or window[-1] == right[b - 1]):
                return np.concatenate([left[:a], window, right[b:]])
            k *= 2

    def _count(self, ids: np.ndarray, n_bytes: int) -> int:
        """How many of the first tokens make up the first bytes."""
        return int(np.searchsorted(np.cumsum(self.lengths[ids]), n_bytes)) + 1 if n_bytes else 0

    def _head(self, right: np.ndarray, tail: int, start: str) -> tuple[str, int | None, list, list]:
        """Text at the head of `right` up to where words after `start` fall as they do in `right` alone.

        Gives that text, the number of its tokens (None: all of `right`), its words alone, and its words after `start`.
        """
        stops = np.flatnonzero(np.isin(right, self.added_ids))
        end, k = int(stops[0]) if len(stops) else len(right), 32
        while k < end:
            text = self.raw(right[:k]).decode("utf-8", "ignore")
            alone, joint = self.words(text), self.words(start + text)
            settled = lambda spans, n: {b for a, b in spans if b < n and a <= n - AHEAD}
            own = settled(alone, len(text))
            both = [b for b in own if b + len(start) in settled(joint, len(start) + len(text))]
            for b in sorted(both):
                n = self._count(right, len(text[:b].encode()))
                if len(stops) or n <= len(right) - tail:
                    return text[:b], n, [w for w in alone if w[1] <= b], [w for w in joint if w[1] <= b + len(start)]
                break
            k *= 4
        text = self.raw(right[:end]).decode("utf-8")
        return text, (end if len(stops) else None), self.words(text), self.words(start + text)

    def join(self, left: np.ndarray, left_tail: int, right: np.ndarray, right_tail: int) -> tuple[np.ndarray, int]:
        """The encoding of two neighbouring texts from theirs, and how many tokens at its end are unsettled."""
        if not len(left) or not len(right):
            return (left, left_tail) if len(left) else (right, right_tail)
        kept, loose = left[: len(left) - left_tail], left[len(left) - left_tail :]
        start = self.raw(loose).decode("utf-8")
        head, n, head_words, words = self._head(right, right_tail, start)
        start_words, cut, new = self.words(start), len(start), []
        for a, b in words:
            word = (start + head)[a:b]
            if not a < cut < b:
                new.append(self.word(word.encode()))
                continue
            l_raw, r_raw = word[: cut - a].encode(), word[cut - a :].encode()
            l_ids = loose[len(loose) - self._count(loose[::-1], len(l_raw)) :] if (a, cut) in start_words else self.word(l_raw)
            r_ids = right[: self._count(right, len(r_raw))] if (0, b - cut) in head_words else self.word(r_raw)
            new.append(self.join_words(l_ids, r_ids))
        ids = np.concatenate([kept, *new, right[len(right) if n is None else n :]]).astype(IDS)
        return ids, (right_tail if n is not None else self.unsettled(start + head))


@lru_cache(maxsize=4)
def coder(path: str) -> Coder:
    return Coder(path)


def _encode_short(path: str | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = coder(path or tokenizer_path())
        for batch in batches:
            ids = [of.encoder.encode(x.as_py() or "") for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.binary())], ["doc_id", "ids"])

    return run


def _cut(path: str | None, leaf: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = coder(path or tokenizer_path())
        for batch in batches:
            for key, doc, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                parts = of.cuts(text, leaf)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([key] * len(parts)), pa.array([doc] * len(parts), pa.int64()), pa.array(range(len(parts)), pa.int64()), pa.array(parts, pa.string())], ["key", "doc_id", "at", "text"]
                )

    return run


def _encode_leaves(path: str | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = coder(path or tokenizer_path())
        for batch in batches:
            texts = batch.column(3).to_pylist()
            ids, tails = [of.encode(t).astype(of.held).tobytes() for t in texts], [of.unsettled(t) for t in texts]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(ids, pa.binary()), pa.array(tails, pa.int64())], ["key", "doc_id", "at", "ids", "tail"])

    return run


def _join_pairs(path: str | None, last: bool):
    def run(group: pa.Table) -> pa.Table:
        of, rows = coder(path or tokenizer_path()), group.sort_by("at").to_pylist()
        parts = [(np.frombuffer(r["ids"], of.held).astype(IDS), r["tail"]) for r in rows]
        ids, tail = of.join(*parts[0], *parts[1]) if len(parts) > 1 else parts[0]
        one = [[rows[0]["key"]], [rows[0]["doc_id"]], [rows[0]["at"] // 2], [ids.astype(IDS if last else of.held).tobytes()], [tail]]
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64()]
        return pa.Table.from_arrays([pa.array(v, t) for v, t in zip(one, kinds, strict=True)], names=["key", "doc_id", "at", "ids", "tail"])

    return run


def encode(docs: DataFrame, tokenizer: str | None = None, leaf: int = LEAF) -> DataFrame:
    """doc_id, ids (little-endian unsigned 32-bit) of each text, as the tokenizers library encodes it without special tokens around it.

    Texts of up to `leaf` characters are a tree of one leaf and aren't shuffled.
    Longer ones shuffle their leaves once, then the ids of two neighbours at a
    time, so that no task holds more than one text.

    Defined cases: a null or empty text has no ids; a null doc_id stays null;
    repeated rows and ids are encoded each (an inner key tells them apart); the
    literal of an added token is its single id; an empty table gives an empty
    result; other columns are ignored.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    size = F.coalesce(F.length("text"), F.lit(0))
    short = rows.where(size <= leaf).mapInArrow(_encode_short(tokenizer), "doc_id long, ids binary")
    longest = rows.agg(F.max(size)).first()[0] or 0
    if longest <= leaf:
        return short
    long = rows.withColumn("key", F.monotonically_increasing_id()).where(size > leaf).select("key", "doc_id", "text")
    nodes = long.mapInArrow(_cut(tokenizer, leaf), "key long, doc_id long, at long, text string").repartition("key", "at")
    nodes = nodes.mapInArrow(_encode_leaves(tokenizer), NODE)
    levels = (-(-longest // leaf) - 1).bit_length()
    for level in range(levels):
        nodes = nodes.groupBy("key", F.expr("at div 2").alias("pair")).applyInArrow(_join_pairs(tokenizer, level == levels - 1), NODE)
    return short.unionByName(nodes.select("doc_id", "ids"))


def decode(encoded: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """The rows of `encoded` with `text`, the decoding of their ids; special tokens keep their text, unknown ids have none, bytes that are no UTF-8 become U+FFFD."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = coder(tokenizer or tokenizer_path())
        for batch in batches:
            texts = [of.raw(np.frombuffer(x.as_py() or b"", IDS)).decode("utf-8", "replace") for x in batch.column("ids")]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], [*batch.schema.names, "text"])

    kept = encoded.drop("text")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema)
    return kept.mapInArrow(run, f"{schema}, text string")


def digests(docs: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256: every text encoded, its ids decoded again."""
    both = decode(encode(docs, tokenizer), tokenizer)
    return both.select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("text").cast("binary"), 256).alias("decoded_sha256"))
