"""SimHash near-duplicates by Golay-code fuzzy hashing.

A 64-bit fingerprint is cut into three segments, each read as a word of the
perfect binary Golay code (23, 12).  If two fingerprints differ in at most two
bits, some segment is equal in both and the one after it, in a circle, differs
in at most one bit: with one differing bit in each of two segments, the third
is equal and its follower has one; with both in one segment, the segment after
it is equal and so is the next.  A word's keys are the codewords nearest to it
and to its neighbours at one bit, so two words that differ in one bit share
one.  Fingerprints meet on (equal segment, codeword index of the next) and are
then verified.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce
from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from changelens.llm.base import Scratch, components

SEED = 42
SEGMENTS = ((0, 22), (22, 21), (43, 21))
#: Buckets up to this many fingerprints are compared in pairs; those beyond link through one-bit neighbours, which is exact too.
PAIR_LIMIT = 24
GENERATOR = 0b101011100011  # fixed value: x^11 + x^9 + x^7 + x^6 + x^5 + x + 1
LANE = np.uint64(0x0101010101010101)


def _remainder(word: int) -> int:
    for bit in range(22, 10, -1):
        if word >> bit & 1:
            word ^= GENERATOR << (bit - 11)
    return word


def golay_tables() -> tuple[np.ndarray, np.ndarray]:
    """Remainders of the 12 message bits, and the error of at most three bits for each of the 2048 syndromes."""
    high = np.array([_remainder(k << 11) for k in range(1 << 12)], np.uint32)
    errors = np.zeros(1 << 11, np.uint32)
    for n in (1, 2, 3):
        for bits in combinations(range(23), n):
            e = sum(1 << b for b in bits)
            errors[_remainder(e)] = e
    return high, errors


HIGH, ERRORS = golay_tables()


def nearest(words: np.ndarray) -> np.ndarray:
    """Index (message bits) of the codeword nearest to each 23-bit word."""
    words = words.astype(np.uint32)
    return (words ^ ERRORS[HIGH[words >> np.uint32(11)] ^ (words & np.uint32(0x7FF))]) >> np.uint32(11)


def keys_of(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(key, position in `fps`) for each fingerprint and each of its distinct keys."""
    seg = [(fps >> np.uint64(at)) & np.uint64((1 << n) - 1) for at, n in SEGMENTS]
    out, where = [], []
    at = np.arange(len(fps))
    for k, (_, n) in enumerate(SEGMENTS):
        follower = (k + 1) % 3
        word = seg[follower].astype(np.uint32)
        flips = np.array([0] + [1 << b for b in range(SEGMENTS[follower][1])], np.uint32)
        index = np.sort(nearest(word[:, None] ^ flips[None, :]), axis=1)
        new = np.ones(index.shape, bool)
        new[:, 1:] = index[:, 1:] != index[:, :-1]
        key = (np.uint64(k) << np.uint64(34)) | (seg[k] << np.uint64(12))
        out.append((key[:, None] | index.astype(np.uint64))[new])
        where.append(np.broadcast_to(at[:, None], index.shape)[new])
    return np.concatenate(out), np.concatenate(where)


def shingles(text: str | None, size: int) -> list[bytes]:
    """Space-joined runs of `size` words of the text with A-Z in small letters; one of all words if there are fewer."""
    words = (text or "").encode().lower().split()
    if len(words) <= size:
        return [b" ".join(words)] if words else []
    return list(map(b" ".join, zip(*(words[k:] for k in range(size)), strict=False)))


def shingle_hashes(text: str | None, size: int) -> np.ndarray:
    some = shingles(text, size)
    return np.fromiter(map(xxhash.xxh64_intdigest, some, repeat(SEED)), np.uint64, len(some))


def fingerprints(hashes: list[np.ndarray]) -> np.ndarray:
    """Majority bits of each document's hashes; zero for none."""
    lens = np.array([len(h) for h in hashes], np.int64)
    out = np.zeros(len(hashes), np.uint64)
    full = np.flatnonzero(lens)
    if not len(full):
        return out
    joined, lens = np.concatenate(hashes), lens[full]
    starts = np.concatenate([[0], np.cumsum(lens)[:-1]])
    pieces = -(-lens // 255)  # a byte lane counts to 255
    first = np.concatenate([[0], np.cumsum(pieces)[:-1]])
    inner = np.arange(pieces.sum()) - np.repeat(first, pieces)
    cuts = np.repeat(starts, pieces) + 255 * inner
    for shift in range(8):
        lanes = np.add.reduceat((joined >> np.uint64(shift)) & LANE, cuts)
        counts = np.add.reduceat(lanes.astype("<u8").view(np.uint8).reshape(-1, 8).astype(np.int64), first, axis=0)
        on = counts * 2 > lens[:, None]
        for byte in range(8):
            out[full] |= on[:, byte].astype(np.uint64) << np.uint64(8 * byte + shift)
    return out


def fingerprint_column(docs: DataFrame, size: int) -> DataFrame:
    """doc_id, fp (the fingerprint's 64 bits as a signed long) for each row."""

    def run(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            for a in range(0, batch.num_rows, 128):
                some = batch.slice(a, 128)
                fps = fingerprints([shingle_hashes(t.as_py(), size) for t in some.column(1)])
                yield pa.RecordBatch.from_arrays([some.column(0), pa.array(fps.view(np.int64))], ["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, fp long")


def links(fps: DataFrame, scratch: Scratch) -> DataFrame:
    """(a, b) edges over the distinct values of `fps`.fp whose components are those of all pairs within two bits."""

    def run(batches):
        for batch in batches:
            got = batch.column(0).to_numpy(zero_copy_only=False)
            for a in range(0, len(got), 4096):
                some = got[a : a + 4096]
                key, at = keys_of(some.view(np.uint64))
                yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(some[at])], ["key", "fp"])

    keys = scratch.write(fps.select("fp").mapInArrow(run, "key long, fp long"), "keys")
    sizes = scratch.write(keys.groupBy("key").agg(F.count("*").alias("n")).where("n > 1"), "sizes")
    shared = scratch.write(keys.join(sizes, "key"), "shared")
    scratch.drop(keys, sizes)
    small = shared.where(F.col("n") <= PAIR_LIMIT)
    a, b = small.select("key", F.col("fp").alias("a")), small.select("key", F.col("fp").alias("b"))
    pairs = a.join(b, "key").where((F.col("a") < F.col("b")) & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= 2)).select("a", "b")

    def neighbours(batches):
        bits = np.concatenate([[0], np.uint64(1) << np.arange(64, dtype=np.uint64)]).astype(np.uint64)
        for batch in batches:
            got = batch.column(0).to_numpy(zero_copy_only=False)
            for k in range(0, len(got), 4096):
                some = got[k : k + 4096].view(np.uint64)
                near = (some[:, None] ^ bits[None, :]).ravel()
                yield pa.RecordBatch.from_arrays([pa.array(near.view(np.int64)), pa.array(np.repeat(some, 65).view(np.int64))], ["near", "fp"])

    crowded = shared.where(F.col("n") > PAIR_LIMIT).select("fp").distinct()
    near = scratch.write(crowded.mapInArrow(neighbours, "near long, fp long"), "near")
    least = scratch.write(near.groupBy("near").agg(F.min("fp").alias("b"), F.count("*").alias("n")).where("n > 1").drop("n"), "least")
    stars = near.join(least, "near").where("fp <> b").select(F.col("fp").alias("a"), "b")
    return scratch.write(pairs.unionByName(stars).distinct(), "links")


def near_components(docs: DataFrame, size: int = 3) -> DataFrame:
    """doc_id, fingerprint (16 hexadecimal digits), component_id for each row of `docs`.

    Defined cases: null, empty and blank texts have fingerprint zero and link
    like any other; a null doc_id takes part and is never a component's id
    unless all its members are null; repeated rows get equal values; an empty
    table gives an empty result; other columns are ignored.
    """
    scratch = Scratch(docs.sparkSession, "simhash")
    fps = scratch.write(fingerprint_column(docs, size), "fingerprints")
    nodes = scratch.write(fps.groupBy("fp").agg(F.min("doc_id").alias("first")), "nodes")
    roots = components(scratch, links(nodes, scratch))
    named = nodes.join(roots, nodes["fp"] == roots["node"], "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    named = scratch.write(named, "named")
    ids = scratch.write(named.groupBy("root").agg(F.min("first").alias("component_id")), "ids")
    final = scratch.write(named.join(ids, "root").select("fp", "component_id"), "classes")
    out = fps.join(final, "fp")
    return out.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


#: Min-hash bands of the similarity join: with 21 bands of 6 a pair of similarity 0.8 is missed once in 600.
BANDS, ROWS = 21, 6
#: Bits that hold the parity of a text's shingles.
PARITY = 512
#: Counters by hash that order shingles by the number of texts that hold them.
SLOTS = 1 << 17


def min_hashes(hashes: np.ndarray) -> np.ndarray:
    """BANDS * ROWS minima of one hash dealt to as many bins; an empty bin takes the next full one's, marked by the distance."""
    n = BANDS * ROWS
    spread = hashes * np.uint64(0x9E3779B97F4A7C15)
    spread ^= spread >> np.uint64(32)
    bins = ((spread >> np.uint64(40)) * np.uint64(n) >> np.uint64(24)).astype(np.int64)
    order = np.lexsort((spread, bins))
    first = order[np.concatenate([[True], bins[order][1:] != bins[order][:-1]])]
    full = bins[first]
    at = np.searchsorted(full, np.arange(n)) % len(full)
    away = (full[at] - np.arange(n)) % n
    return spread[first][at] + away.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)


def band_keys(hashes: np.ndarray) -> np.ndarray:
    rows = min_hashes(hashes).reshape(BANDS, ROWS)
    key = np.arange(BANDS, dtype=np.uint64) * np.uint64(0xBF58476D1CE4E5B9)
    for k in range(ROWS):
        key = (key ^ rows[:, k]) * np.uint64(0x94D049BB133111EB)
        key ^= key >> np.uint64(29)
    return key


def _slots(hashes: np.ndarray) -> np.ndarray:
    return (hashes * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(65 - SLOTS.bit_length())).astype(np.int64)


def _text_key(text):
    return F.xxhash64(F.coalesce(text.cast("string"), F.lit("")))


def similar_links(texts: DataFrame, scratch: Scratch, size: int, similarity: float) -> DataFrame:
    """(a, b) of text keys whose word shingles have that Jaccard similarity.

    `texts`: th, text, one row for each different text.  Golay keys of the
    fingerprints bring together what differs in two bits at most; similar texts
    often differ in ten, so min-hash bands bring together the rest.  Every link
    is verified on the whole shingle sets.  Crowded buckets are first compared
    with hubs, the member nearest to the bucket's majority fingerprint and the
    first, so that a group of copies gives as many rows as it has members; what
    that leaves apart meets by an exact prefix filter.
    """

    def keys(batches):
        for batch in batches:
            for a in range(0, batch.num_rows, 128):
                some = batch.slice(a, 128)
                ths = some.column(0).to_numpy(zero_copy_only=False)
                sets = [np.unique(shingle_hashes(t.as_py(), size)) for t in some.column(1)]
                fps = fingerprints(sets)
                golay, at = keys_of(fps)
                full = np.array([k for k, s in enumerate(sets) if len(s)], np.int64)
                golay, at = golay[np.isin(at, full)], at[np.isin(at, full)]
                key = np.concatenate([golay, *[band_keys(sets[k]) for k in full]])
                at = np.concatenate([at, np.repeat(full, BANDS)]).astype(np.int64)
                counts = np.array([len(s) for s in sets], np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (key.view(np.int64), ths[at], fps.view(np.int64)[at], counts[at])], ["key", "th", "fp", "n"])

    keyed = scratch.write(texts.select("th", "text").mapInArrow(keys, "key long, th long, fp long, n long"), "keyed")
    sizes = scratch.write(keyed.groupBy("key").agg(F.count("*").alias("members")).where("members > 1"), "sizes")
    shared = scratch.write(keyed.join(sizes, "key"), "shared")
    scratch.drop(keyed)
    near = F.least("na", "nb") >= similarity * F.greatest("na", "nb")  # as sets of that similarity are
    side = lambda df, s: df.select("key", *[F.col(c).alias(c[0] + s if c != "th" else s) for c in ("th", "fp", "n")])
    small = shared.where(F.col("members") <= PAIR_LIMIT)
    pairs = side(small, "a").join(side(small, "b"), "key").where((F.col("a") < F.col("b")) & near).select("a", "b")
    crowded = shared.where(F.col("members") > PAIR_LIMIT)
    bits = [F.sum(F.shiftright("fp", k).bitwiseAND(1)).alias(f"b{k}") for k in range(64)]
    majority = crowded.groupBy("key").agg(F.count("*").alias("m"), *bits)
    centre = reduce(lambda x, y: x.bitwiseOR(y), [F.when(F.col(f"b{k}") * 2 > F.col("m"), F.shiftleft(F.lit(1).cast("long"), k)).otherwise(F.lit(0).cast("long")) for k in range(64)])
    majority = scratch.write(majority.select("key", centre.alias("centre")), "centres")
    away = F.bit_count(F.col("fp").bitwiseXOR(F.col("centre")))
    member = F.struct("th", "fp", "n")
    hubs = crowded.join(majority, "key").groupBy("key").agg(F.min(F.struct(away.alias("d"), member.alias("x"))).alias("c"), F.min(member).alias("x"))
    hubs = hubs.select("key", F.explode(F.array_distinct(F.array("c.x", "x"))).alias("x")).select("key", "x.*")
    hubs = scratch.write(hubs, "hubs")
    stars = side(crowded, "a").join(side(hubs, "b"), "key").where((F.col("a") != F.col("b")) & near).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    pairs = scratch.write(pairs.unionByName(stars).distinct(), "pairs")
    first = _verified(texts, pairs, scratch, size, similarity)
    # a bucket whose members the hubs have brought into one component has nothing left to link
    roots = components(scratch, first)
    members = crowded.select("key", "th").join(roots, F.col("th") == F.col("node"), "left").select("key", "th", F.coalesce("root", "th").alias("root"))
    members = scratch.write(members, "members")
    apart = members.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low < high").select("key")
    rest = scratch.write(members.join(scratch.write(apart, "apart"), "key").select("th").distinct(), "crowded")
    if rest.limit(1).count():
        more = _prefix_pairs(texts.join(rest, "th"), roots, scratch, size, similarity)
        first = scratch.write(first.unionByName(_verified(texts, more, scratch, size, similarity)), "all_links")
    scratch.drop(shared)
    return first


def _prefix_pairs(texts: DataFrame, roots: DataFrame, scratch: Scratch, size: int, similarity: float) -> DataFrame:
    """(a, b) of the texts that may be that similar and aren't in one component of `roots` (node, root) yet; loses none.

    Shingles are ordered by the number of texts that hold them, as counters by
    hash bound it from above: any order that all texts share loses none, and a
    bound of one is exact.  So a text gives its prefix alone.  Similar texts
    share one among the first n - o + 1 of each, with o the least overlap that
    the similarity allows: 2 s / (1 + s) n for the smaller set, s n for the
    larger.  What a template puts in all of its pages comes last in this order.
    Of a shingle's texts those in its largest component meet the others only.
    Two bounds that lose none drop most candidates before their texts are read:
    the places of the first shared shingle bound the overlap from above, and
    where bits hold the parity of the shingles dealt to them, the bits in which
    two texts differ bound the number of shingles in which they do from below.
    """

    def sets_of(batches):
        for batch in batches:
            for a in range(0, batch.num_rows, 128):
                some = batch.slice(a, 128)
                yield some.column(0).to_numpy(zero_copy_only=False), [np.unique(shingle_hashes(t.as_py(), size)) for t in some.column(1)]

    def tally(batches):
        counts = np.zeros(SLOTS, np.int64)
        for _, sets in sets_of(batches):
            counts += np.bincount(_slots(np.concatenate(sets)), minlength=SLOTS)
        yield pa.RecordBatch.from_arrays([pa.array([counts.tobytes()], pa.binary())], ["counts"])

    def total(batches):
        counts = np.zeros(SLOTS, np.int64)
        for batch in batches:
            for x in batch.column(0):
                counts += np.frombuffer(x.as_py(), np.int64)
        yield pa.RecordBatch.from_arrays([pa.array([counts.tobytes()], pa.binary())], ["counts"])

    tallied = texts.select("th", "text").mapInArrow(tally, "counts binary").repartition(8).mapInArrow(total, "counts binary")
    held_by = sum(np.frombuffer(r.counts, np.int64) for r in scratch.write(tallied, "tally").collect())

    def run(batches):
        for ths, sets in sets_of(batches):
            rows = []
            for th, h in zip(ths.tolist(), sets, strict=True):
                n, f = len(h), held_by[_slots(h)]
                order = np.lexsort((h, f))
                short, long = (n - math.ceil(share * n - 1e-9) + 1 for share in (2 * similarity / (1 + similarity), similarity))
                place = np.arange(min(long, n))
                place = place[f[order[place]] > 1]  # shingles of one text alone come first and meet nothing
                rows.append((np.full(len(place), th), h[order[place]].view(np.int64), np.full(len(place), n), place, place < short))
            names = ["th", "h", "n", "place", "index"]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*rows, strict=True)], names)

    def parities(batches):
        for batch in batches:
            rows = []
            for text in batch.column(1):
                h = np.unique(shingle_hashes(text.as_py(), size)) * np.uint64(0x9E3779B97F4A7C15)
                odd = np.bincount((h >> np.uint64(64 - PARITY.bit_length() + 1)).astype(np.int64), minlength=PARITY) % 2 == 1
                rows.append(np.packbits(odd).view("<i8").tolist())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, pa.list_(pa.int64()))], ["th", "bits"])

    bits = scratch.write(texts.select("th", "text").mapInArrow(parities, "th long, bits array<long>"), "parities")
    held = scratch.write(texts.select("th", "text").mapInArrow(run, "th long, h long, n long, place long, index boolean"), "shingles")
    keys = held.join(roots, held["th"] == roots["node"], "left").withColumn("root", F.coalesce("root", "th")).drop("node").join(bits, "th")
    keys = scratch.write(keys.select("h", "th", "n", "root", "bits", "place", "index"), "prefixes")
    scratch.drop(held)
    groups = keys.groupBy("h", "root").agg(F.count("*").alias("m")).groupBy("h").agg(F.count("*").alias("roots"), F.max(F.struct("m", "root"))["root"].alias("main"))
    keys = scratch.write(keys.join(groups.where("roots > 1").select("h", "main"), "h").withColumn("other", F.col("root") != F.col("main")), "meeting")
    side = lambda df, s: df.select("h", *[F.col(c).alias(f"{c}_{s}") for c in ("th", "n", "root", "bits", "place")])
    both, after = F.col("n_a") + F.col("n_b"), F.least(F.col("n_a") - F.col("place_a"), F.col("n_b") - F.col("place_b"))
    apart = reduce(lambda x, y: x + y, [F.bit_count(F.col("bits_a")[k].bitwiseXOR(F.col("bits_b")[k])) for k in range(PARITY // 64)])
    bounds = (after >= similarity / (1 + similarity) * both - 1e-9) & (apart <= (1 - similarity) / (1 + similarity) * both + 1e-9)
    may = bounds & (F.col("root_a") != F.col("root_b")) & (F.struct("n_a", "th_a") < F.struct("n_b", "th_b")) & (F.col("n_a") >= similarity * F.col("n_b") - 1e-9)
    out = None
    for short, long in ((keys.where("index and other"), keys), (keys.where("index and not other"), keys.where("other"))):
        met = side(short, "a").join(side(long, "b"), "h").where(may)
        met = met.select(F.least("th_a", "th_b").alias("a"), F.greatest("th_a", "th_b").alias("b"))
        out = met if out is None else out.unionByName(met)
    return scratch.write(out.distinct(), "prefix_pairs")


def _verified(texts: DataFrame, pairs: DataFrame, scratch: Scratch, size: int, similarity: float) -> DataFrame:
    """The pairs (a, b) whose whole shingle sets have that similarity."""

    def sets(batches):
        for batch in batches:
            raw = [np.unique(shingle_hashes(t.as_py(), size)).tobytes() for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(raw, pa.binary())], ["th", "hashes"])

    used = scratch.write(pairs.select(F.explode(F.array("a", "b")).alias("th")).distinct(), "used")
    held = scratch.write(texts.join(used, "th").select("th", "text").mapInArrow(sets, "th long, hashes binary"), "sets")

    def verify(batches):
        for batch in batches:
            a, b = batch.column(0), batch.column(1)
            keep = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                x, y = np.frombuffer(x.as_py(), np.uint64), np.frombuffer(y.as_py(), np.uint64)
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(both >= similarity * (len(x) + len(y) - both))
            yield pa.RecordBatch.from_arrays([a.filter(pa.array(keep, pa.bool_())), b.filter(pa.array(keep, pa.bool_()))], ["a", "b"])

    left = held.select(F.col("th").alias("a"), F.col("hashes").alias("ha"))
    right = held.select(F.col("th").alias("b"), F.col("hashes").alias("hb"))
    return scratch.write(pairs.join(left, "a").join(right, "b").select("a", "b", "ha", "hb").mapInArrow(verify, "a long, b long"), "verified")


def drop_near_duplicates(docs: DataFrame, size: int = 5, similarity: float = 0.8) -> DataFrame:
    """`docs` with one row of each group of equal or similar texts: that of the smallest doc_id.

    Defined cases: null and empty texts are one group; texts without words are
    similar only to equal ones; a text of fewer words than a shingle is one
    shingle; of equal rows one stays; null ids come last; other columns are
    kept as they are; an empty table gives an empty result.
    """
    scratch = Scratch(docs.sparkSession, "near")
    keyed = docs.withColumn("_th", _text_key(F.col("text")))
    order = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("doc_id"), F.col("_th").alias("th"))
    firsts = scratch.write(keyed.groupBy("_th").agg(F.min(order).alias("first")).select(F.col("_th").alias("th"), "first"), "firsts")
    one = firsts.select(F.col("th").alias("_th"), F.col("first.doc_id").alias("doc_id"))
    k, o = keyed.alias("k"), one.alias("o")
    same = F.col("k.doc_id").eqNullSafe(F.col("o.doc_id")) & (F.col("k._th") == F.col("o._th"))
    texts = scratch.write(k.join(o, same).select(F.col("k._th").alias("th"), F.col("k.text").cast("string").alias("text")).dropDuplicates(["th"]), "texts")
    roots = components(scratch, similar_links(texts, scratch, size, similarity))
    named = firsts.join(roots, firsts["th"] == roots["node"], "left").select(F.coalesce("root", "th").alias("root"), "first")
    kept = scratch.write(named.groupBy("root").agg(F.min("first").alias("x")).select(F.col("x.doc_id").alias("doc_id"), F.col("x.th").alias("_th")), "kept")
    d, e = keyed.alias("d"), kept.alias("e")
    out = d.join(e, F.col("d.doc_id").eqNullSafe(F.col("e.doc_id")) & (F.col("d._th") == F.col("e._th"))).select("d.*")
    return out.dropDuplicates(["doc_id", "_th"]).drop("_th")
