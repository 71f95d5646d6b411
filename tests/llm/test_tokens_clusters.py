"""BPE by tree concatenation, weighted clustering and cross-tokenizer alignment against brute-force versions."""

import collections
import hashlib
import random

import duckdb
import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from changelens.llm import alignment, bpe, clusters

ODD = [(900, None), (901, ""), (902, " \t\n "), (903, "one"), (903, "one"), (None, "no id here"), (904, "é漢字🙂 " * 9000)]
BITS = ["a", "aa", "the", " the", "'", "'s", "'re", "re", " ", "  ", "\n", "\t", "1", "12", "!", "?!", "é", "漢", "🙂", "<|endoftext|>", "<|endof", "text|>", "ing", " don't", "x'll", "　", "\x85", "====", "▁"]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


def some_text(r):
    kind = r.random()
    if kind < 0.7:
        return "".join(r.choice(BITS) for _ in range(r.choice([1, 3, 10, 40])))
    if kind < 0.85:
        return "".join(r.choice("abcdeorstn") for _ in range(r.randint(1, 300)))
    return r.choice("ab -\n") * r.randint(1, 700) + r.choice(BITS)


def test_joins_of_leaves_equal_the_library(library):
    of, r = bpe.Coder(public_tokenizers.path("byte_bpe_50k.json")), random.Random(5)
    for _ in range(4000):
        text = "".join(some_text(r) for _ in range(r.choice([1, 1, 4])))
        nodes = [(of.encode(x), of.unsettled(x)) for x in of.cuts(text, r.choice([1, 2, 3, 5, 7, 16, 50]))]
        while len(nodes) > 1:
            nodes = [of.join(*nodes[i], *nodes[i + 1]) if i + 1 < len(nodes) else nodes[i] for i in range(0, len(nodes), 2)]
        assert nodes[0][0].tolist() == library.encode(text, add_special_tokens=False).ids, text


def test_unsettled_ends_of_long_texts():
    of = bpe.Coder(public_tokenizers.path("byte_bpe_50k.json"))
    long = "some plain words " * 400
    for end in ("", "'", "don'", "x  ", "=" * 2000):
        whole = of.encode(long + end)
        assert 0 < of.unsettled(long + end) < len(whole)


def test_encode_and_decode_equal_the_library(documents, library):
    r = random.Random(9)
    some = [(i, "".join(some_text(r) for _ in range(r.randint(1, 8)))) for i in range(60)]
    for leaf, rows in ((bpe.LEAF, ODD + some), (64, ODD[:-1] + some), (9, ODD[:-1] + some[:20])):
        both = bpe.decode(bpe.encode(documents(rows), leaf=leaf))
        got = sorted(((x.doc_id, np.frombuffer(x.ids, "<u4").tolist(), x.text) for x in both.collect()), key=str)
        ids = [library.encode(t or "", add_special_tokens=False).ids for _, t in rows]
        assert got == sorted(((d, i, library.decode(i, skip_special_tokens=False)) for (d, _), i in zip(rows, ids, strict=True)), key=str)


def test_bpe_digests(documents, library):
    rows = [*ODD, (1, "a<|endoftext|>b")]
    got = {(x.doc_id, x.n_tokens, x.ids_sha256, x.decoded_sha256) for x in bpe.digests(documents(rows)).collect()}
    ids = [np.array(library.encode(t or "", add_special_tokens=False).ids, "<u4") for _, t in rows]
    assert got == {(d, len(i), hashlib.sha256(i.tobytes()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()) for (d, t), i in zip(rows, ids, strict=True)}
    assert bpe.digests(documents([])).count() == 0


def test_decoding_of_unknown_ids_and_broken_bytes(spark, library):
    ids = [[50256, 70_000, 64], [447], [447, 247]]  # a special token and an unknown id; the first bytes of a character; a whole one
    rows = spark.createDataFrame([(k, bytearray(np.array(i, "<u4").tobytes()), "clash") for k, i in enumerate(ids)], "k int, ids binary, text string")
    assert [x.text for x in bpe.decode(rows).orderBy("k").collect()] == [library.decode(i, skip_special_tokens=False) for i in ids]


# --- clusters ---


def clusters_by_force(rows, k, rounds, dim, scale):
    kept = [(i, [int(np.floor(scale * float(x))) for x in v]) for i, v in rows if v is not None and len(v) == dim and all(x is not None and np.isfinite(x) for x in v)]
    order = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"3:{r[0]}".encode()).hexdigest() if r[0] is not None else "", np.array(r[1], "<i4").tobytes()))
    centres = [v for _, v in order[:k]]
    near = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), n) for n, c in enumerate(centres))
    for _ in range(rounds):
        members = collections.defaultdict(list)
        for _, v in kept:
            members[near(v)[1]].append(v)
        centres = [[sum(col) // len(members[n]) for col in zip(*members[n], strict=True)] if members[n] else c for n, c in enumerate(centres)]
    found = [(i, *reversed(near(v))) for i, v in kept]
    sums = collections.Counter()
    for _, c, d in found:
        sums[c] += d
    return [(i, c, d, sums[c], sum(sums.values()), hashlib.sha256(",".join(map(str, centres[c])).encode()).hexdigest()) for i, c, d in found]


@pytest.mark.parametrize("scale", [16, 1 << 20])
def test_clusters_equal_brute_force(spark, scale):
    r, inf, nan = random.Random(scale), float("inf"), float("nan")
    rows = [(i, [r.choice([-1.5, 0.25, 0.9, 3.0]) + r.random() / 9 for _ in range(4)]) for i in range(120)] + [(i, [0.5, 0.5, 0.5, -0.5]) for i in range(200, 260)]
    rows += [(5, [1.0, 1.0, 1.0, 1.0]), (5, [1.0, 1.0, 1.0, 1.0]), (None, [2.0] * 4), (300, None), (301, [1.0] * 3), (302, [1.0, None, 1.0, 1.0]), (303, [nan] * 4), (304, [1.0, -inf, 1.0, 1.0]), (305, [])]
    df = spark.createDataFrame([(i, v, i, 1.0) for i, v in rows], "vec_id long, embedding array<double>, cluster long, distance double").repartition(3)
    got = clusters.cluster(df, k=8, rounds=10, dim=4, scale=scale).collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, clusters_by_force(rows, 8, 10, 4, scale)))
    few = clusters.cluster(df.where("vec_id in (1, 2, 300)"), dim=4, scale=scale).collect()
    assert sorted(x.distance for x in few) == [0, 0]
    assert clusters.cluster(df.where("vec_id = 300"), dim=4).count() == 0 == clusters.cluster(df.limit(0), dim=4).count()


def test_clusters_refuse_what_does_not_fit(spark):
    df = spark.createDataFrame([(1, [1e30] * 4)], "vec_id long, embedding array<double>")
    with pytest.raises(Exception, match="64 bits"):
        clusters.cluster(df, dim=4)


def test_clusters_equal_their_sql(spark):
    path = "/root/testdata/sf0.001/embeddings.parquet"
    db = duckdb.connect()
    db.execute(f"create view embeddings as select * from '{path}'")
    want = db.sql(clusters.ORACLE)
    got = clusters.cluster(spark.read.parquet(path)).select(*want.columns)
    assert sorted(map(tuple, got.collect())) == sorted(want.fetchall())


# --- alignment ---


def alignment_by_force(of, rows):
    out, held, all_links = [], collections.Counter(), []
    for doc, text in rows:
        both = of.encode(text or "")
        spans = [[], []]
        for side, ids in enumerate(both or ([], [])):
            at = 0
            for i in list(ids):
                n = len((of.a_bytes, of.b_bytes)[side][i])
                spans[side].append((at, at + n, int(i)))
                at += n
        a, b = spans
        links = [(x[2], y[2]) for x in a for y in b if x[0] < y[1] and y[0] < x[1]]
        before, groups = 0, []
        for end in sorted({x[1] for x in a} & {y[1] for y in b}):
            groups.append(tuple([x[2] for x in side if before < x[1] <= end] for side in spans) + (before, end))
            before = end
        text = ";".join("|".join(",".join(map(str, ids)) for ids in g[:2]) for g in groups)
        out.append([doc, len(a), len(b), len(groups), len(links), hashlib.sha256(text.encode()).hexdigest() if groups else ""])
        all_links.append((links, [(doc, g[2], g[3], g[0], g[1]) for g in groups]))
        held.update(set(links))
    most = collections.Counter()
    for (x, _), n in held.items():
        most[x] = max(most[x], n)
    counted = [(*o, sum(held[p] == most[p[0]] for p in links), sum(held[p] for p in links)) for o, (links, _) in zip(out, all_links, strict=True)]
    return counted, held, [g for _, groups in all_links for g in groups]


def test_alignment_equals_brute_force(documents):
    of, r = alignment.sides(None, None), random.Random(3)
    words = [*BITS, "tokenization", "naïve", "<s>", "supercalifragilistic", "12345"]
    rows = [(i, "".join(r.choice(words) + r.choice([" ", "", "  "]) for _ in range(r.randint(0, 50)))) for i in range(60)]
    rows += [*ODD[:-1], (905, "▁"), (906, "word " * 900), (907, "a" * 1500), (908, "é漢字🙂 " * 300)]
    want, held, groups = alignment_by_force(of, rows)
    columns = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "n_best", "count_sum"]
    for limit, block in ((alignment.CHUNK_LINKS, alignment.BLOCK), (60, 64), (7, 5)):
        df = documents(rows)
        got = alignment.align(df, limit=limit, block=block).select(*columns).collect()
        assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))
        assert sorted(map(str, map(tuple, alignment.groups(df, limit=limit, block=block).collect()))) == sorted(map(str, groups))
    assert {(x.a_id, x.b_id): x.docs for x in alignment.pair_counts(documents(rows), limit=60).collect()} == held
    assert alignment.align(documents([])).count() == 0
    assert {x.groups_sha256 for x in alignment.align(documents([(1, None), (2, "")])).collect()} == {""}
