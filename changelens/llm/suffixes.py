"""Suffix-array deduplication of long repeated byte strings.

Suffixes matter through `threshold` bytes only, and are sorted by radix passes
from the most significant digit on; a suffix that is alone in its group leaves.

The first pass deals suffixes out by a digit that no order needs but equality
does: a window's minimiser (the smallest hash of K bytes among the window's)
and its place there.  Equal windows agree in it, so groups don't mix, and runs
of windows with one minimiser travel as one row.  Runs that are equal as a whole
are repeated throughout and need no sorting.  Within what is left, the suffixes
near the ends of repeats, passes over digits of DIGIT bytes order the windows to
their full depth; the groups of equals after the last are exactly the repeated
windows, by their bytes.

Hot groups: counts are pre-aggregated, copies of a text become one row before
anything is collected, joins are of two shuffled sides that adaptive execution
can split, and minimisers with more than GROUP_LIMIT different runs are sorted
across the cluster: one pass, the window's hash as its only digit.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from changelens.llm.base import Scratch

THRESHOLD, K, DIGIT = 200, 73, 8
#: Runs of one minimiser compared in memory, and rows of a bucket of such groups, at most about.
GROUP_LIMIT, BUCKET_ROWS = 2048, 4096
MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
SPREAD = (np.arange(1, 257, dtype=np.uint64) * np.uint64(0xBF58476D1CE4E5B9)) ^ (np.arange(1, 257, dtype=np.uint64) * np.uint64(0x94D049BB133111EB) >> np.uint64(17))
SEED = 42


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(29))


def rolling(data: np.ndarray, k: int) -> np.ndarray:
    """Hash of the k bytes from each position, by doubling lengths."""
    power, length, part = MULTIPLIER, 1, SPREAD[data]
    out, done = None, 0
    while k:
        if k & 1:
            n = len(data) - done - length + 1
            out = part[:n].copy() if out is None else out[:n] * power + part[done : done + n]
            done += length
        k >>= 1
        if k:
            part = part[: len(part) - length] * power + part[length:]
            power, length = np.uint64(int(power) * int(power) % 2**64), 2 * length
    return _mixed(out)


def minimisers(data: np.ndarray, threshold: int, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(position, first window, last window, hash): runs of windows with the same leftmost smallest k-byte hash."""
    if len(data) < threshold:
        return (np.zeros(0, np.int64),) * 3 + (np.zeros(0, np.uint64),)
    h = rolling(data, k)
    value, offset, length, width = h, np.zeros(len(h), np.uint8), 1, threshold - k + 1
    while length < width:
        step = min(length, width - length)
        left, right = value[: len(value) - step], value[step:]
        keep = left <= right
        offset = np.where(keep, offset[: len(offset) - step], offset[step:] + np.uint8(step))
        value = np.where(keep, left, right)
        length += step
    owner = np.arange(len(value)) + offset
    first = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]]))
    last = np.concatenate([first[1:] - 1, [len(owner) - 1]])
    return owner[first], first, last, h[owner[first]]


FOUND = "doc_id long, th long, at long, first long, last long, h long, c long, n_bytes long, sha string"


def _find(threshold: int, k: int):
    names = [c.split()[0] for c in FOUND.split(", ")]

    def one(doc, text):
        raw = (text or "").encode()
        th = xxhash.xxh64_intdigest(raw, SEED)  # as F.xxhash64 gives it
        at, first, last, h = minimisers(np.frombuffer(raw, np.uint8), threshold, k)
        c = np.fromiter((xxhash.xxh3_64_intdigest(raw[a : b + threshold], p - a) for p, a, b in zip(at.tolist(), first.tolist(), last.tolist(), strict=True)), np.uint64, len(at))
        return np.uint64(th).astype(np.int64), len(raw), hashlib.sha256(raw).hexdigest(), at, first, last, h, c

    def run(batches):
        for batch in batches:
            for k0 in range(0, batch.num_rows, 64):
                some = batch.slice(k0, 64)
                docs = some.column(0).to_pylist()
                got = [one(d, t) for d, t in zip(docs, some.column(1).to_pylist(), strict=True)]
                yield pa.RecordBatch.from_arrays(  # a row for each document
                    [pa.array(docs, pa.int64()), pa.array([g[0] for g in got], pa.int64()), *[pa.nulls(len(got), pa.int64())] * 5, pa.array([g[1] for g in got], pa.int64()), pa.array([g[2] for g in got])], names
                )
                lens = [len(g[3]) for g in got]
                if not sum(lens):
                    continue
                cols = [np.concatenate([g[j] for g in got]).view(np.int64) for j in range(3, 8)]
                yield pa.RecordBatch.from_arrays(  # and one for each run of windows
                    [pa.nulls(sum(lens), pa.int64()), pa.array(np.repeat(np.array([g[0] for g in got], np.int64), lens))]
                    + [pa.array(c) for c in cols] + [pa.nulls(sum(lens), pa.int64()), pa.nulls(sum(lens), pa.string())], names
                )

    return run


RUNS = "th long, at long, first long, last long, h long, own boolean, span binary"


def _spans(threshold: int):
    """The bytes of the runs that are still open, and of one run of each closed group for them to meet."""

    def run(batches):
        names = [c.split()[0] for c in RUNS.split(", ")]
        for batch in batches:
            for r in batch.to_pylist():
                raw = (r["text"] or "").encode()
                runs = [x for x in r["runs"] if x["need"]]
                if runs:
                    cols = [[r["th"]] * len(runs), *([x[c] for x in runs] for c in ("at", "first", "last", "h")), [not x["closed"] for x in runs], [raw[x["first"] : x["last"] + threshold] for x in runs]]
                    kinds = [pa.int64()] * 5 + [pa.bool_(), pa.binary()]
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names)

    return run


def _windows(table: pa.Table, threshold: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row, window start, first digit, position in the bytes, bytes) of each window of each run; the digit is of minimiser and place."""
    first, last, at = (table.column(c).to_numpy() for c in ("first", "last", "at"))
    data = np.frombuffer(b"".join(table.column("span").to_pylist()), np.uint8)
    counts = last - first + 1
    begins = np.concatenate([[0], np.cumsum(counts + threshold - 1)[:-1]])
    row = np.repeat(np.arange(len(counts)), counts)
    inner = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
    start = first[row] + inner
    digit = _mixed(table.column("h").to_numpy().view(np.uint64)[row] + (at[row] - start).astype(np.uint64) * MULTIPLIER)
    return row, start, digit, begins[row] + inner, data


def repeated(data: np.ndarray, at: np.ndarray, group: np.ndarray, depth: int) -> np.ndarray:
    """Which of the suffixes of `data` at `at` equal another of their group through `depth` bytes.

    Most significant digits first: each pass sorts what is left by group and
    the next DIGIT bytes, makes groups of equals, and drops those of one.
    """
    wide = np.zeros(max(0, len(data) - DIGIT + 1), np.uint64)  # the digit that begins at each byte
    for k in range(DIGIT):
        wide = wide << np.uint64(8) | data[k : k + len(wide)]
    left = np.arange(len(at))
    depths = [*range(0, depth - DIGIT + 1, DIGIT)]
    if depth % DIGIT:
        depths.append(depth - DIGIT)  # the last digit overlaps the one before
    for done in [None, *depths]:
        if not len(left):
            break
        digit = group[left] if done is None else wide[at[left] + done]
        order = np.argsort(digit, kind="stable") if done is None else np.lexsort((digit, group))
        left, digit = left[order], digit[order]
        new = np.ones(len(left), bool)
        new[1:] = digit[1:] != digit[:-1]
        if done is not None:
            group = group[order]
            new[1:] |= group[1:] != group[:-1]
        number = np.cumsum(new) - 1
        keep = np.bincount(number)[number] > 1
        left, group = left[keep], number[keep]
    out = np.zeros(len(at), bool)
    out[left] = True
    return out


COVER = "th long, least long, most long"


def _compare(threshold: int):
    """First and last repeated window of each open run, within a bucket of whole groups."""

    def run(group: pa.Table) -> pa.Table:
        row, start, digit, at, data = _windows(group, threshold)
        ok = repeated(data, at, digit, threshold) & np.array(group.column("own").to_pylist(), bool)[row]
        row, start = row[ok], start[ok]
        new = np.flatnonzero(np.concatenate([[True], row[1:] != row[:-1]])) if len(row) else np.zeros(0, np.int64)
        ends = np.concatenate([new[1:] - 1, [len(row) - 1]]) if len(row) else new
        return pa.Table.from_arrays([group.column("th").take(pa.array(row[new])), pa.array(start[new]), pa.array(start[ends])], names=["th", "least", "most"])

    return run


def _expand(threshold: int):
    def run(batches):
        for batch in batches:
            for k in range(0, batch.num_rows, 2000):
                some = pa.Table.from_batches([batch.slice(k, 2000)])
                row, start, digit, at, data = _windows(some, threshold)
                key, who = rolling(data, threshold)[at] ^ digit, pa.array(row)
                yield pa.RecordBatch.from_arrays(
                    [*(some.column(c).take(who).combine_chunks() for c in ("th", "at", "own")), pa.array(start), pa.array(key.view(np.int64))], ["th", "at", "own", "start", "key"]
                )

    return run


def removed_spans(covers, n: int) -> list[list[int]]:
    """Maximal runs of covered bytes of (first byte, end) pairs."""
    out: list[list[int]] = []
    for a, b in sorted(covers):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return out


def _cut(threshold: int, keep: bool):
    def run(batches):
        names = ["th", "n_removed", "n_spans", "kept_sha256", "kept"]
        for batch in batches:
            rows = []
            for r in batch.to_pylist():
                raw = (r["text"] or "").encode()
                covers = [(x["first"], x["last"] + threshold) for x in r["runs"] if x["closed"]]
                covers += [(x["least"], x["most"] + threshold) for x in r["found"] or ()]
                spans = removed_spans(covers, len(raw))
                ends = [0] + [b for _, b in spans]
                kept = b"".join(raw[a:b] for a, b in zip(ends, [a for a, _ in spans] + [len(raw)], strict=True))
                rows.append((r["th"], sum(b - a for a, b in spans), len(spans), hashlib.sha256(kept).hexdigest(), kept if keep else None))
            kinds = [pa.int64()] * 3 + [pa.string(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)] if rows else [pa.array([], t) for t in kinds], names)

    return run


def remove_repeats(docs: DataFrame, threshold: int = THRESHOLD, k: int = K, keep: bool = True) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept (bytes; null if nothing was removed, or without `keep`) for each row of `docs`.

    A byte goes if a string of `threshold` bytes that covers it starts
    anywhere else as well, in the same document or another.

    Defined cases: null and empty texts have nothing to remove; rows with the
    same text are copies of each other, whatever their ids, and are worked on
    as one; other columns are ignored; an empty table gives an empty result.
    """
    if not 1 <= threshold - k + 1 <= 255 or threshold < DIGIT:
        raise ValueError("1 to 255 hashes a window")
    scratch = Scratch(docs.sparkSession, "suffixes")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    found = scratch.write(texts.mapInArrow(_find(threshold, k), FOUND), "found")
    meta = found.where("sha is not null").select("doc_id", "th", "n_bytes", "sha")
    runs = found.where("h is not null").select("th", "at", "first", "last", "h", "c")
    # first pass: the minimiser
    shared = scratch.write(runs.groupBy("h").agg(F.count("*").alias("n")).where("n > 1").select("h"), "shared")
    alive = scratch.write(runs.join(shared, "h"), "alive")
    # whole runs that are equal
    groups = scratch.write(alive.groupBy("h", "c").agg(F.count("*").alias("n"), F.min(F.struct("th", "at")).alias("one")), "groups")
    open_h = scratch.write(groups.where("n = 1").groupBy("h").agg(F.lit(True).alias("is_open")), "open")
    classes = scratch.write(
        groups.join(open_h, "h", "left").where("n > 1").select("h", "c", F.when(F.col("is_open"), F.col("one")).alias("one"), F.lit(True).alias("closed")), "classes"
    )
    marked = alive.join(classes, ["h", "c"], "left")
    rep = F.struct("th", "at").eqNullSafe(F.col("one"))
    closed = F.coalesce("closed", F.lit(False))
    run = F.struct("at", "first", "last", "h", closed.alias("closed"), (~closed | F.coalesce(rep, F.lit(False))).alias("need"))
    per_text = scratch.write(marked.groupBy("th").agg(F.collect_set(run).alias("runs")), "texts")  # at most the runs of one text; its copies meet map-side
    scratch.drop(alive, groups, classes)
    # one row of each text: copies meet map-side, and the join needs no second shuffle of texts
    once = texts.groupBy(F.xxhash64(F.coalesce("text", F.lit(""))).alias("th")).agg(F.first("text").alias("text"))
    held = scratch.write(once.join(per_text.hint("merge"), "th").select("th", "text", "runs"), "held")
    scratch.drop(per_text)
    # the passes over bytes
    spans = scratch.write(held.mapInArrow(_spans(threshold), RUNS), "spans")
    sizes = scratch.write(spans.groupBy("h").agg(F.count("*").alias("n")), "sizes")
    total = sizes.agg(F.sum("n")).first()[0] or 0
    sized = scratch.write(spans.join(sizes, "h"), "sized")
    few = sized.where(F.col("n") <= GROUP_LIMIT).withColumn("bucket", F.pmod(F.xxhash64("h"), F.lit(max(1, -(-total // BUCKET_ROWS)))))
    covers = few.groupBy("bucket").applyInArrow(_compare(threshold), COVER)
    many = sized.where(F.col("n") > GROUP_LIMIT).select("th", "at", "own", "first", "last", "h", "span")
    windows = scratch.write(many.mapInArrow(_expand(threshold), "th long, at long, own boolean, start long, key long"), "windows")
    twice = scratch.write(windows.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key"), "twice")
    more = windows.where("own").join(twice, "key").groupBy("th", "at").agg(F.min("start").alias("least"), F.max("start").alias("most"))
    covers = scratch.write(covers.unionByName(more.drop("at")), "covers")
    scratch.drop(spans, sized, windows)
    found_in = scratch.write(covers.groupBy("th").agg(F.collect_list(F.struct("least", "most")).alias("found")), "covered")
    cut = scratch.write(held.join(found_in, "th", "left").mapInArrow(_cut(threshold, keep), "th long, n_removed long, n_spans long, kept_sha256 string, kept binary"), "cut")
    scratch.drop(held)
    m, c = meta.alias("m"), cut.alias("c")
    return m.join(c, "th", "left").select(
        "m.doc_id", "m.n_bytes", F.coalesce("c.n_removed", F.lit(0)).cast("long").alias("n_removed"), F.coalesce("c.n_spans", F.lit(0)).cast("long").alias("n_spans"),
        F.coalesce("c.kept_sha256", "m.sha").alias("kept_sha256"), "c.kept",
    )
