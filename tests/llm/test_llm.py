"""Every operator against a brute-force version on small rows: nulls, empty and long texts, ties, repeated rows, empty tables."""

import collections
import hashlib
import json
import random
import re
import zlib
from itertools import product

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from changelens.llm import catalog, knn, lines, media, mixing, packing, quality, simhash, suffixes, surrogates, toxicity
from changelens.llm.base import Scratch, components

DATA = "/root/testdata/sf0.001"
ODD = [(900, None), (901, ""), (902, " \t\n "), (903, "one"), (903, "one"), (None, "no id here"), (904, "é漢字🙂 " * 9000)]


# --- toxicity ---


def edits(a, b):
    d = [[max(i, j) if not i or not j else 0 for j in range(len(b) + 1)] for i in range(len(a) + 1)]
    for i, j in product(range(1, len(a) + 1), range(1, len(b) + 1)):
        d[i][j] = min(d[i - 1][j] + 1, d[i][j - 1] + 1, d[i - 1][j - 1] + (a[i - 1] != b[j - 1]))
        if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
            d[i][j] = min(d[i][j], d[i - 2][j - 2] + 1)
    return d[-1][-1]


@pytest.mark.parametrize("most", [1, 2])
def test_automaton_equals_edit_distance(most):
    r = random.Random(most)
    for _ in range(400):
        terms = {"".join(r.choice("abc") for _ in range(r.randint(1, 6))): r.random() for _ in range(5)}
        word = "".join(r.choice("abc") for _ in range(r.randint(1, 7)))
        got, best = toxicity.Trie(terms).search(word, most), min((edits(word, t), -terms[t], t) for t in terms)
        assert (got is None) == (best[0] > most) and (got is None or (got[1], got[0]) == (best[0], best[2]))


def test_misspelling_quotation_and_address():
    m = toxicity.Matcher({"stupid": 5.0, "idiot": 5.0, "scum": 5.0}, frozenset(["stupit"]))
    assert m.match("idoit")[0] == "idiot" and m.match("stup1d!")[0] == "stupid" and m.match("stuuupid")[0] == "stupid"
    assert m.match("scam") is None and m.match("stupit") is None
    assert m.strength("he called them idiot") == (0.0, 5.0) and m.strength("he called you idiot") == (6.25, 0.0)
    assert m.strength("you idiot") == (6.25, 0.0) and m.strength('she said "an idiot"') == (0.0, 5.0) and m.strength(None) == (0.0, 0.0)


def strength_by_force(terms, text):
    """Every word against every term, by edit distance, in its window."""
    words, inside, out = text.split(), False, [0.0, 0.0]
    bares = [toxicity.bare(w) for w in words]
    for k, w in enumerate(words):
        quoted = inside or w.startswith('"')
        inside = quoted and '"' not in w[w.startswith('"') :]
        best = min((edits(bares[k], t), -terms[t], t) for t in terms)
        most = 2 if len(best[2]) >= 11 else 1 if len(best[2]) >= 5 else 0
        if not bares[k] or best[0] > most:
            continue
        near = set(bares[max(0, k - 8) : k + 9])
        you, told = near & toxicity.ADDRESS, near & toxicity.REPORTING
        told_before = set(bares[max(0, k - 3) : k]) & toxicity.REPORTING
        less = told_before and not you or quoted and (told or not you)
        weight = terms[best[2]] * (1.0, 0.8, 0.6)[best[0]]
        out[bool(less)] += weight * (1.25 if you and not less else 1.0)
    return out


def test_windows_equal_brute_force():
    r = random.Random(12)
    terms = {"stupid": 5.0, "idiots": 4.0, "scum": 3.0, "contemptible": 2.0}

    def spoilt(t):
        for _ in range(r.choice([0, 0, 1, 1, 2, 3])):
            k = r.randrange(len(t))
            t = r.choice([t[:k] + t[k + 1 :], t[:k] + "z" + t[k:], t[:k] + "q" + t[k + 1 :], t[:k] + t[k : k + 2][::-1] + t[k + 2 :]])
        return t

    matcher = toxicity.Matcher(terms)
    for _ in range(1500):
        words = [r.choice([spoilt(r.choice(list(terms))), "plain", "you", "said", "word", "the", "called", '"', '"the', 'end"', "house,"]) for _ in range(r.randint(1, 30))]
        got, want = matcher.strength(" ".join(words)), strength_by_force(terms, " ".join(words))
        assert got == pytest.approx(want), words


def test_the_learned_lexicon_equals_its_definition(spark, documents):
    r = random.Random(2)
    rows = [(k, " ".join(r.choice([f"w{chr(97 + k % 26)}{r.randrange(400)}x"] * 6 + ["vile" if k % 3 == 0 else "kind", "both"]) for _ in range(40))) for k in range(240)]
    labels = spark.createDataFrame([(d, int(d % 3 == 0)) for d, _ in rows], "doc_id long, toxic int")
    got = toxicity.learn(documents(rows), labels, "toxic", F.lit(True))[0].trie.terms
    own = [({toxicity.bare(w) for w in t.split()}, d % 3 == 0) for d, t in rows]
    want, n1 = {}, sum(y for _, y in own)
    for w in set().union(*(x for x, _ in own)):
        a, b = sum(w in x and y for x, y in own), sum(w in x and not y for x, y in own)
        p, table = (a + b) / len(own), ((a, n1), (b, len(own) - n1))
        ratio = 2 * sum(x * np.log(x / (n * p)) + ((n - x) * np.log((n - x) / (n * (1 - p))) if n > x else 0) for x, n in table if x) + 2 * sum(n * np.log(1 / (1 - p)) for x, n in table if not x and p < 1)
        if a >= 3 and a / (a + b) >= toxicity.MIN_PRECISION and ratio >= toxicity.MIN_RATIO:
            want[w] = np.log((a + 0.5) / (b + 0.5)) - np.log(n1 / (len(own) - n1))
    assert want and got == pytest.approx(want)


def test_toxicity_learns_and_ignores_copies(spark, documents):
    r = random.Random(1)
    word = lambda: "".join(r.choice("bcdfglmnprst") + r.choice("aeiou") for _ in range(3))
    rows = [(k, " ".join([word() for _ in range(30)] + (["vile", "nasty"] if k % 4 == 0 else []))) for k in range(200)]
    copy = " ".join(["vile", "nasty", *(word() for _ in range(30))])
    rows += [(1000 + k, copy) for k in range(100)]
    labels = spark.createDataFrame([(d, int("vile" in (t or ""))) for d, t in rows], "doc_id long, toxic int")
    got = toxicity.toxicity(documents(rows + ODD), labels).toPandas()
    assert len(got) == len(rows + ODD) and got.score.between(0, 1).all()
    truth = {d: "vile" in t for d, t in rows}
    assert all(p == truth[d] for d, p in zip(got.doc_id, got.predicted, strict=True) if d in truth)
    fold = {d: zlib.crc32(str(int(d)).encode()) % 5 == 0 for d in truth}
    assert all(h == fold[d] for d, h in zip(got.doc_id, got.held_out, strict=True) if d in fold)
    matcher = toxicity.learn(documents(rows), labels, "toxic", F.lit(True))[0]
    assert set(matcher.trie.terms) == {"vile", "nasty"}
    none = toxicity.toxicity(documents(rows[:3]), labels.limit(0)).toPandas()
    assert set(none.score) == {0.5} and toxicity.toxicity(documents([]), labels).count() == 0


# --- repeated strings ---


def removed_by_force(rows, threshold):
    raw = [(d, (t or "").encode()) for d, t in rows]
    seen = collections.Counter(b[i : i + threshold] for _, b in raw for i in range(len(b) - threshold + 1))
    out = []
    for d, b in raw:
        gone = np.zeros(len(b) + 1, bool)
        for i in range(len(b) - threshold + 1):
            if seen[b[i : i + threshold]] > 1:
                gone[i : i + threshold] = True
        spans = int(((gone[:-1]) & ~np.concatenate([[False], gone[:-2]])).sum()) if len(b) else 0
        out.append((d, len(b), int(gone.sum()), spans, hashlib.sha256(bytes(x for x, g in zip(b, gone, strict=False) if not g)).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("limit", [2048, 2])
def test_repeats_equal_brute_force(documents, limit, monkeypatch):
    monkeypatch.setattr(suffixes, "GROUP_LIMIT", limit)
    r = random.Random(4)
    parts = ["".join(r.choice("abcde é") for _ in range(r.choice([150, 199, 200, 210, 400]))) for _ in range(8)]
    rows = []
    for k in range(70):
        text = ""
        for _ in range(r.randint(0, 3)):
            p = r.choice(parts)
            cut = r.randrange(len(p))
            text += (p if r.random() < 0.5 else p[:cut] + "X" + p[cut + 1 :])[r.choice([0, 0, 20]) :] + "".join(r.choice("vwxyz ") for _ in range(r.randint(0, 60)))
        rows.append((k, text))
    rows += [(3, rows[3][1]), (None, rows[5][1]), (801, "a" * 700), (802, "ab" * 300), (803, "q" * 199), (804, "w" * 200), *ODD[:-1]]
    got = sorted([tuple(x)[:5] for x in suffixes.remove_repeats(documents(rows)).collect()], key=str)
    assert got == removed_by_force(rows, 200)


def test_radix_passes_equal_brute_force():
    rng = np.random.default_rng(2)
    for depth in (8, 13, 16, 21):
        data = rng.integers(0, 2, 600).astype(np.uint8)
        data[300:340] = data[20:60]
        at = np.arange(len(data) - depth + 1)
        for groups in (1, 3):
            group = rng.integers(0, groups, len(at)).astype(np.uint64)
            seen = collections.Counter((g, data[a : a + depth].tobytes()) for a, g in zip(at, group.tolist(), strict=True))
            want = [seen[g, data[a : a + depth].tobytes()] > 1 for a, g in zip(at, group.tolist(), strict=True)]
            assert suffixes.repeated(data, at, group, depth).tolist() == want


def test_many_equal_rows_cost_no_more_than_their_text(documents):
    r = random.Random(6)
    long = "".join(r.choice("abcdefgh ") for _ in range(20_000))
    rows = [(7, long)] * 600 + [(None, long)] * 200 + [(9, "own " + long[500:900] + " words")]
    got = collections.Counter(tuple(x)[:5] for x in suffixes.remove_repeats(documents(rows)).collect())
    none = hashlib.sha256(b"").hexdigest()
    assert got == {(7, 20_000, 20_000, 1, none): 600, (None, 20_000, 20_000, 1, none): 200, (9, 410, 400, 1, hashlib.sha256(b"own  words").hexdigest()): 1}


def test_repeats_of_an_empty_table(documents):
    assert suffixes.remove_repeats(documents([])).count() == 0


# --- media ---


@pytest.mark.parametrize("n", [0, 1, 63, 64, 1416, 1417, 1418, 50_000])
def test_media_round_trip(n):
    payload = media.padded("x" * n) if n < 70 else random.Random(n).randbytes(n)
    data = media.encode(payload)
    got = media.parse(data)
    assert media.decode(data) == payload and got["crc_bad"] == got["resyncs"] == 0
    assert got["table"]["frames"] == len(got["offsets"]) and got["samples"] == 1152 * len(got["offsets"])
    assert all(media.header(data, at) for at in got["offsets"])


def test_media_payload_that_looks_like_a_tag():
    for n, at in ((100, 29), (5000, None), (1416 + 90, None)):
        text = "x" * at + "TAG" + "x" * (n - at - 3) if at else "TAG" * (n // 3)
        for pad in range(3):
            payload = media.padded("." * pad + text)
            data = media.encode(payload)
            bare = data[:-128]  # as a writer without ID3v1 leaves it
            for d in (data, bare):
                got = media.parse(d)
                assert media.decode(d) == payload and got["table"]["frames"] == len(got["offsets"]) and got["resyncs"] == 0
    assert media.encode(media.padded("x" * 29 + "TAG" + "x" * 68))[:-128][-128:-125] == b"TAG"


def test_media_damage_is_seen():
    data = media.encode(random.Random(2).randbytes(20_000))
    offsets = media.parse(data)["offsets"]
    hit = bytearray(data)
    hit[offsets[3] + 8] ^= 1  # side information
    assert media.parse(bytes(hit))["crc_bad"] == 1
    cut = data[: offsets[5]] + b"\xff\xfa junk \xff" * 9 + data[offsets[5] :]
    got = media.parse(cut)
    assert got["resyncs"] == 1 and len(got["offsets"]) == len(offsets)
    tagged = data + b"TAG" + b"Song".ljust(30, b"\0") + bytes(95)
    assert media.parse(tagged)["tags"]["TIT2"] == "Song" and len(media.parse(tagged)["offsets"]) == len(offsets)


def test_media_of_other_writers(spark):
    plain = media._frame(b"x" * 9, 9).ljust(media.ROOM[9] + 23, b"\0")
    vbri = media._frame(bytes(32 - 19) + b"", 9).ljust(media.ROOM[9] + 23, b"\0")
    table = b"VBRI" + (1).to_bytes(2, "big") + bytes(4) + (4000).to_bytes(4, "big") + (8).to_bytes(4, "big") + b"".join(x.to_bytes(2, "big") for x in (2, 3, 2, 4)) + (100).to_bytes(2, "big") + (200).to_bytes(2, "big")
    vbri = vbri[:36] + table + vbri[36 + len(table) :]
    got = media.parse(vbri + plain * 2)
    assert got["table"] == {"kind": "VBRI", "bytes": 4000, "frames": 8, "toc": [300, 600], "frames_a_run": 4} and len(got["offsets"]) == 2
    files = [(1, b""), (2, b"no audio at all \xff\xfb"), (3, plain * 3), (4, None), (5, b"ID3\x04\0\0\0\0\0\x7f short"), (6, media.encode(b"p" * 4000))]
    broken = bytearray(files[-1][1])
    broken[-1000] ^= 1
    files += [(7, bytes(broken)), (8, files[-1][1][:2000])]
    rows = {r.doc_id: r for r in media.read_media(spark.createDataFrame([(d, 0, f) for d, f in files], "doc_id long, n_bytes long, media binary")).collect()}
    assert all(rows[d].feature is None and rows[d].payload_bytes is None and rows[d].frame_offsets == [] for d in (1, 2, 5)) and rows[4].media_bytes is None
    assert rows[3].payload_sha256 is None and json.loads(rows[3].feature)["frames"] == 3 and rows[3].intact is None
    assert rows[6].intact is True and rows[7].intact is False and rows[7].crc_failures == 0 and rows[8].intact is False and rows[8].payload_bytes is None


@pytest.mark.parametrize(("b1", "b2", "b3", "bits"), [(0xFE, 0x14, 0xC0, 128), (0xFE, 0x14, 0x50, 4 * (8 * 2 + 24)), (0xFC, 0x48, 0xC0, 88), (0xFC, 0xC0, 0x00, 188), (0xFC, 0xC4, 0x00, 176)])
def test_checksums_of_layers_one_and_two(b1, b2, b3, bits):
    """No allocation, so no scale selectors: a Layer I or II frame's CRC covers header and allocation bits."""
    head = bytes([0xFF, b1, b2, b3])
    h = media.header(head + bytes(2000), 0)
    assert media.covered_bits(head + bytes(h["length"]), 0, h) == bits
    value = 0xFFFF
    for bit in "".join(f"{x:08b}" for x in head[2:]) + "0" * bits:
        value = (value << 1 ^ (0x8005 if (value >> 15) ^ int(bit) else 0)) & 0xFFFF
    frame = (head + value.to_bytes(2, "big")).ljust(h["length"], b"\0")
    got = media.parse(frame * 3)
    assert got["crc_good"] == 3 and got["crc_bad"] == 0 and got["samples"] == 3 * h["samples"]
    assert media.parse(frame[:4] + b"\0\1" + frame[6:] + frame)["crc_bad"] == 1


def test_media_columns(documents):
    got = {(r.doc_id, r.n_bytes): r for r in media.media_columns(documents(ODD)).collect()}
    for doc, text in ODD:
        raw = (text or "").encode()
        r, want = got[doc, len(raw)], media.padded(text)
        assert r.payload_bytes == len(want) and r.payload_sha256 == hashlib.sha256(want).hexdigest() and r.tail_crc32 == zlib.crc32(want[-64:])
        assert json.loads(r.feature)["crc_bad"] == 0
    assert media.media_columns(documents([])).count() == 0


# --- lines ---


def lines_by_force(rows, sites):
    site, texts = collections.defaultdict(set), collections.defaultdict(set)
    for _, t, s in rows:
        for x in {x.strip(" ") for x in (t or "").split("\n")} - {""}:
            site[x].add(s or ""), texts[x].add(t)
    common = {x for x in site if len(site[x]) >= sites and len(texts[x]) >= sites}
    out = []
    for d, t, _ in rows:
        ls = [] if t is None else t.split("\n")
        cut = [x for x in ls if x.strip(" ") in common]
        out.append((d, t if not cut else "\n".join(x for x in ls if x not in cut), len(ls), len(cut)))
    return sorted(out, key=str)


def line_rows():
    r = random.Random(3)
    rows = [(k, "\n".join(r.choice(["common footer", "rare line", " common footer", "", f"own {k}", "half known " * 4] + [f"text {r.randrange(9)}"] * 3) + "" for _ in range(r.randint(1, 9))) + "\nbody text that is this document's own " + str(k), f"s{r.randrange(9)}") for k in range(120)]
    rows += [(500 + k, "copied everywhere\nagain", f"s{k}") for k in range(9)] + [(d, t, None) for d, t in ODD]
    page = [f"a line of one page {k}" for k in range(30)]
    rows += [(600 + k, "\n".join([*page[:k], f"edited {k}", *page[k + 1 :]]), f"s{k}") for k in range(30)]
    return rows + [(700 + k, f"note {k}\na licence much longer than what stands above it", f"s{k}") for k in range(7)]


def test_lines_equal_brute_force(documents):
    rows = line_rows()
    got = sorted([(r.doc_id, r.text, r.n_lines, r.n_cut) for r in lines.remove_boilerplate(documents(rows)).collect()], key=str)
    assert got == lines_by_force(rows, lines.MIN_SITES)
    cut = {g[0]: g[3] for g in got}
    assert all(cut[500 + k] == 0 for k in range(9)) and all(cut[600 + k] == 29 for k in range(30))  # copies; copies with an edit share 29 lines
    assert all(cut[700 + k] == 1 for k in range(7)) and sum(cut.values()) > 7  # boilerplate, even where it is most of a text
    assert lines.remove_boilerplate(documents([])).count() == 0


def test_footers_of_any_length_go(documents):
    """Footers of 1 to 40 lines under 1 to 40 own lines, each on five sites."""
    rows = []
    for n, footer in enumerate((1, 2, 5, 20, 40)):
        for m, own in enumerate((1, 5, 40)):
            common = [f"footer {footer} of {own}, line {k}" for k in range(footer)]
            rows += [(1000 * n + 100 * m + k, "\n".join([*[f"own {footer} {own} {k} {j}" for j in range(own)], *common]), f"s{k % 5}") for k in range(10)]
    lengths = {(1000 * n + 100 * m + k): footer for n, footer in enumerate((1, 2, 5, 20, 40)) for m in range(3) for k in range(10)}
    assert {r.doc_id: r.n_cut for r in lines.remove_boilerplate(documents(rows)).collect()} == lengths


def test_lines_equal_their_sql(documents):
    import duckdb

    rows = line_rows()
    db = duckdb.connect()
    db.execute("create table documents (doc_id bigint, text varchar, source varchar)")
    db.executemany("insert into documents values (?, ?, ?)", rows)
    got = lines.remove_boilerplate(documents(rows)).select("doc_id", "n_lines", "n_cut", F.md5(F.col("text").cast("binary")))
    assert sorted(map(tuple, got.collect()), key=str) == sorted(db.sql(lines.ORACLE).fetchall(), key=str)


def test_lines_replace_columns_of_their_names(documents):
    df = documents([(1, "a\nb", "s")]).withColumn("n_cut", F.lit(9)).withColumn("key", F.lit("mine")).withColumn("row", F.lit("mine"))
    out = lines.remove_boilerplate(df)
    assert out.columns == ["doc_id", "text", "lang", "source", "n_chars", "label", "key", "row", "n_lines", "n_cut"]
    assert out.first().n_cut == 0 and out.first().key == "mine" and out.first().row == "mine"


# --- surrogates ---


def test_surrogates_keep_form_and_coreference(documents):
    rows = [
        (1, "mail Bob.Smith@corp.com, BOB.SMITH@CORP.COM or al@corp.com; call +1 (275) 555-5927, +1 275 555 5927"), (2, "card 4111 1111 1111 1111 and 4111111111111111, ip 10.1.2.3"),
        (3, "Herr Karl Meier und Frau Anna Meier; госпожа Анна Петрова"), (4, "mail bob.smith@corp.com v1.2.3.4.5 in 2024"), (5, 'a token = "9c8b45435718dcc700c1" here'), *ODD,
    ]
    got = {r.doc_id: r for r in surrogates.replace_pii(documents(rows), "key").collect()}
    a, b = got[1].text, got[2].text
    mails = [w.strip(",;") for w in a.split() if "@" in w]
    assert mails[1] == mails[0].upper() and mails[0] in got[4].text and len(set(m.lower() for m in mails)) == 2 and mails[0].split("@")[1] == mails[2].split("@")[1]
    assert "corp.com" not in a and "v1.2.3.4.5" in got[4].text and got[4].n_entities == 1
    cards = b.split("card ")[1].split(", ip ")[0].split(" and ")
    assert cards[0].replace(" ", "") == cards[1] and cards[1] != "4111111111111111" and got[2].n_entities == 3
    digits = [int(x) for x in cards[1]][::-1]
    assert sum(d if k % 2 == 0 else d * 2 - 9 * (d > 4) for k, d in enumerate(digits)) % 10 == 0
    male, female = (surrogates.GIVEN[f"{g}_latin"].split() for g in ("male", "female"))
    words = got[3].text.split()
    assert words[0] == "Herr" and words[1] in male and words[4] == "Frau" and words[5] in female and "Петрова" not in got[3].text
    assert any(g in got[3].text for g in surrogates.GIVEN["female_cyrillic"].split())
    assert got[5].text.startswith('a token = "') and got[5].text.endswith('" here') and "9c8b" not in got[5].text and len(got[5].text) == len(rows[4][1])
    for d, t in ODD[:3]:
        assert got[d].text == t and got[d].n_entities == 0


def test_secrets_of_letters_alone(documents):
    rows = [(1, "password: correcthorsebattery"), (2, "so api_key=AbCdEfGhIjKl ends"), (3, 'My Token = "qwertyuiop"'), (4, "Password: ____________ (fill in)"), (5, "a key: none")]
    got = {r.doc_id: r for r in surrogates.replace_pii(documents(rows), "key").collect()}
    for d, secret in ((1, "correcthorsebattery"), (2, "AbCdEfGhIjKl"), (3, "qwertyuiop")):
        assert got[d].n_entities == 1 and secret not in got[d].text and len(got[d].text) == len(rows[d - 1][1])
    assert got[1].text.startswith("password: ") and got[2].text.endswith(" ends") and got[3].text.startswith('My Token = "')
    assert all(got[d].text == rows[d - 1][1] and got[d].n_entities == 0 for d in (4, 5))  # a blank to fill in is no secret


def test_secrets_go_whole(documents):
    """Tokens of several parts and base64 keys; a sentence's end is none of it."""
    values = ["abcdefgh.ijkl", "eyJhbGciOi.eyJzdWIiOiIx.SflKxwRJSM-eKKF2QT4", "abc/def+ghi/jklmnop==", "a.b.c.d.e.f", "Zm9v/YmFy"]
    rows = [(k, f"see token={v}. And more") for k, v in enumerate(values)] + [(90, "token: short. Next sentence"), (91, "password: ........")]
    got = {r.doc_id: r for r in surrogates.replace_pii(documents(rows), "key").collect()}
    for k, v in enumerate(values):
        new = got[k].text.removeprefix("see token=").removesuffix(". And more")
        assert got[k].n_entities == 1 and len(new) == len(v) and [c for c in new if not c.isalnum()] == [c for c in v if not c.isalnum()], got[k].text
        assert not any(part in new for part in re.split("[./+=-]", v) if len(part) > 3)
    assert got[90].text == rows[-2][1] and got[91].text == rows[-1][1]


def test_surrogates_never_clash(spark):
    found = spark.createDataFrame([("email", f"{a}{b}@x.com", "") for a in "abcdef" for b in "abcdef"] + [("ipv4", f"10.0.0.{k}", "") for k in range(200)] + [("given", f"n{k}", "male") for k in range(60)], "kind string, norm string, gender string")
    got = surrogates.surrogate_table(found, "k", Scratch(spark, "t")).toPandas()
    assert len(got) == 296 and got.new.nunique() == 296 and not set(got.new) & set(got.norm)


def test_formats_grow_with_the_attempt(spark):
    df = spark.createDataFrame([("ssn", "123456789"), ("ipv4", "10.1.2.3"), ("card", "4111111111111111"), ("phone", "2755555927"), ("family", "smith"), ("given", "anna"), ("secret", "token=abcdefgh")], "kind string, norm string")
    for attempt in (0, 1, 3, 9, 40):
        digest = surrogates._digest("k", F.col("kind"), F.col("norm"), F.lit(str(attempt)), blocks=F.lit(1))
        got = {r.kind: r.new for r in df.select("kind", surrogates.surrogate(F.col("kind"), F.col("norm"), F.lit("female"), digest, F.lit(attempt), "k").alias("new")).collect()}
        assert len(got["ssn"]) == 9 + (max(0, attempt // 4 - 1) if attempt >= 8 else 0) and got["ssn"][:3] not in ("000", "666") and got["ssn"][0] != "9"
        assert len(got["family"]) >= 9 + 2 * (attempt // 4) and all(got.values())


def iban_remainder(x):
    x = x.replace(" ", "")
    return int("".join(str(int(c, 36)) for c in x[4:] + x[:4])) % 97


def test_people_stay_themselves(documents):
    rows = [
        (1, "Mr John Smith met Mr Smith and Dr John Smith. Smith left; JOHN SMITH stayed, Johnson too."), (2, "Dr. Jane Smith wrote."), (3, "Smith and John here, no title"),
        (4, "call +1 275 555 5927 or 275 555 5927 or +12755555927, (0275) 555-5927"), (5, "pay DE89 3704 0044 0532 0130 00 or GB82WEST12345698765432, id 123-45-6789"), (6, "Prof Jane Doe, Mrs Jane Doe"),
    ]
    got = {r.doc_id: r for r in surrogates.replace_pii(documents(rows), "key").collect()}
    w = got[1].text.replace(",", "").replace(".", "").replace(";", "").split()
    given, family = w[1], w[2]
    assert w == f"Mr {given} {family} met Mr {family} and Dr {given} {family} {family} left {given.upper()} {family.upper()} stayed Johnson too".split()
    assert given in surrogates.GIVEN["male_latin"].split() and got[1].n_entities == 5 + 1
    assert got[2].text.split()[2] == family and got[3].text == rows[2][1] and got[3].n_entities == 0
    a, b, c, d = (x.strip() for x in got[4].text.removeprefix("call ").replace(" or ", "|").replace(", ", "|").split("|"))
    assert a == "+1 " + b and c == "+1" + b.replace(" ", "") and d == "(0" + b.replace(" ", ") ", 1).replace(" ", "-").replace(")-", ") ") and b != "275 555 5927"
    de, rest = got[5].text.removeprefix("pay ").split(" or ")
    gb, ssn = rest.split(", id ")
    assert iban_remainder(de) == iban_remainder(gb) == 1 and de[:2] == "DE" and gb[:2] == "GB" and [len(x) for x in de.split()] == [4, 4, 4, 4, 4, 2] and gb[4:8].isalpha() and ssn[3] == ssn[6] == "-"
    jane = got[6].text.split()[1]
    assert jane in surrogates.GIVEN["female_latin"].split() and got[6].text == f"Prof {jane} {got[6].text.split()[2].strip(',')}, Mrs {jane} {got[6].text.split()[2].strip(',')}"


def test_surrogates_against_brute_force(spark, documents):
    """All texts of the smallest scale: what isn't an entity stays, and entities and surrogates correspond one to one."""
    import regex

    secret = regex.compile(r'^[^:=]*[:=]\s*"?')
    for scale in ("sf0.001",):
        docs = spark.read.parquet(DATA.replace("sf0.001", scale) + "/documents.parquet")
        got = {r.doc_id: r for r in surrogates.replace_pii(docs, "key").collect()}
        texts, news, n = {r.doc_id: r.text for r in docs.collect()}, {}, 0
        for d, t in texts.items():
            hits = list(regex.finditer(surrogates.ANY, t or ""))
            n += len(hits)
            assert got[d].n_entities == len(hits)
            ends = [0, *(m.end() for m in hits)]
            pieces = [t[a:b] for a, b in zip(ends, [*(m.start() for m in hits), len(t)], strict=True)] if t else [""]
            form = "(.+?)".join(map(regex.escape, pieces))
            found = regex.fullmatch(form, got[d].text or "", regex.DOTALL)
            assert found
            for m, new in zip(hits, found.groups(), strict=True):
                kind = next(k for k, p in surrogates.PATTERNS.items() if regex.fullmatch(p, m[0]))
                assert regex.fullmatch(surrogates.PATTERNS[kind], new) and len(new) >= len(m[0]) // 2
                key = (kind, secret.sub("", m[0]) if kind == "secret" else m[0])
                news.setdefault(key, set()).add(secret.sub("", new) if kind == "secret" else new)
        assert n and all(len(x) == 1 for k, x in news.items() if k[0] != "secret")
        assert len({next(iter(x)) for x in news.values()}) == len(news) and not {x for s in news.values() for x in s} & {k[1] for k in news}
    assert surrogates.replace_pii(documents([]), "key").count() == 0


def test_surrogates_replace_a_column_of_their_name(documents):
    df = documents([(1, "a@b.com"), (2, "no")]).withColumn("n_entities", F.lit("x")).withColumn("key", F.lit("k")).withColumn("found", F.lit("f"))
    out = surrogates.replace_pii(df, "key")
    assert out.columns == ["doc_id", "text", "lang", "source", "n_chars", "label", "key", "found", "n_entities"]
    assert sorted((r.doc_id, r.key, r.found, r.n_entities) for r in out.collect()) == [(1, "k", "f", 1), (2, "k", "f", 0)]


# --- mixing ---


def test_mixing_levels_and_repeats(documents):
    r = random.Random(6)
    rows = [(k, "w " * r.randint(0, 40), "abcd"[min(3, k % 7)]) for k in range(400)] + [(d, t, None) for d, t in ODD]
    p = mixing.mix(documents(rows)).toPandas()
    assert len(p) == len(rows) and (p.taken <= 2 * p["size"]).all()
    total = 0
    for _, g in p.groupby("source", dropna=False):
        goal = g.target.iloc[0]
        total += goal
        assert goal <= 2 * g.source_size.iloc[0] + 1e-6 and abs(g.taken.sum() - goal) <= g["size"].max()
    assert abs(total - 1.5 * p["size"].sum()) < 1e-6
    again = mixing.mix(documents(rows, parts=7)).toPandas()
    assert sorted(zip(p.doc_id.astype(str), p.taken, strict=True)) == sorted(zip(again.doc_id.astype(str), again.taken, strict=True))
    assert mixing.mix(documents([])).count() == 0


def test_mixing_copies_by_source_and_id(documents):
    rows = [(k, "w " * (5 + k % 9), "ABC"[k % 3]) for k in range(60)] + [(1, "w w w", "C"), (1, "w w w", "C"), (1, "v v", None)]
    docs = documents(rows).withColumn("g", F.lit(1)).withColumn("copies", F.lit(7)).withColumn("_copy", F.lit(8))
    plan = {(r.doc_id, r.source): r.copies for r in mixing.mix(docs).collect()}
    out = mixing.apply_mix(docs)
    assert out.columns == docs.columns and {(r.copies, r._copy) for r in out.collect()} == {(7, 8)}
    got = collections.Counter((r.doc_id, r.source) for r in out.collect())
    have = collections.Counter((d, s) for d, _, s in rows)
    assert got == collections.Counter({x: n * plan[x] for x, n in have.items() if plan[x]})
    assert mixing.apply_mix(documents([])).count() == 0


# --- SimHash ---


def prints_by_force(rows, size=3):
    out = []
    for _, t in rows:
        w = (t or "").encode().lower().split()
        some = [b" ".join(w[k : k + size]) for k in range(max(1, len(w) - size + 1))] if w else []
        h = [xxhash.xxh64_intdigest(x, 42) for x in some]
        out.append(sum((2 * sum(x >> b & 1 for x in h) > len(h)) << b for b in range(64)))
    return out


def test_fingerprints_and_components(documents):
    r = random.Random(8)
    base = [r.choice("abcdefgh") * 3 + str(r.randrange(50)) for _ in range(400)]
    rows = [(k, " ".join(base[: 399 - k % 5] + [str(r.randrange(9))])) for k in range(60)] + [(100 + k, " ".join(r.sample(base, 40))) for k in range(30)] + [r for r in ODD if r[0] is not None]
    fps = prints_by_force(rows)
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 2:
                root[find(i)] = find(j)
    least = collections.defaultdict(lambda: 10**9)
    for i, (d, _) in enumerate(rows):
        least[find(i)] = min(least[find(i)], d)
    want = sorted((d, f"{fps[i]:016x}", least[find(i)]) for i, (d, _) in enumerate(rows))
    assert sorted(map(tuple, simhash.near_components(documents(rows)).collect())) == want
    assert simhash.near_components(documents([])).count() == 0


@pytest.mark.parametrize("limit", [24, 2])
def test_links_lose_none(spark, limit, monkeypatch):
    monkeypatch.setattr(simhash, "PAIR_LIMIT", limit)
    r = random.Random(limit)
    fps = set()
    for _ in range(40):
        x = r.getrandbits(64)
        fps.add(x)
        for _ in range(r.choice([1, 2, 12])):
            x ^= 1 << r.randrange(64) ^ (1 << r.randrange(64) if r.random() < 0.6 else 0)
            fps.add(x % 2**64)
    signed = sorted(np.array(sorted(fps), np.uint64).view(np.int64).tolist())
    scratch = Scratch(spark, "t")
    got = components(scratch, simhash.links(spark.createDataFrame([(x,) for x in signed], "fp long"), scratch))
    root = {x: x for x in signed} | {x.node: x.root for x in got.collect()}
    for a, b in product(signed, signed):
        if ((a ^ b) % 2**64).bit_count() <= 2:
            assert root[a] == root[b]
    assert len(set(root.values())) < len(signed)


def test_golay_code_is_perfect():
    errors = simhash.ERRORS
    assert len(set(errors.tolist())) == 2048 and max(bin(e).count("1") for e in errors.tolist()) == 3


def test_near_duplicates_keep_one(documents):
    r = random.Random(9)
    base = [f"w{r.randrange(10**6)}" for _ in range(200)]
    rows = [(0, " ".join(base))]
    for k in range(1, 40):
        words = list(base)
        words[r.randrange(200)] = f"x{k}"
        rows.append((k, " ".join(words)))
    rows += [(100 + k, " ".join(f"w{r.randrange(10**6)}" for _ in range(60))) for k in range(30)] + [(200, "A b c"), (201, "a  B c"), *ODD]
    got = sorted((r.doc_id for r in simhash.drop_near_duplicates(documents(rows)).collect()), key=str)
    assert got == sorted([0, *range(100, 130), 200, 900, 902, 903, None, 904], key=str)


def test_similar_pages_of_one_template_are_found(spark):
    r = random.Random(10)
    word = lambda: f"w{r.randrange(10**9)}"
    template = [word() for _ in range(314)]
    pages = []
    for _ in range(60):  # two pages of 0.81, any other two of 0.73
        own, shared = [[word() for _ in range(36)] for _ in range(2)], [word() for _ in range(22)]
        pages += [template + shared + x for x in own]
    pages += [template + [word() for _ in range(58)] for _ in range(180)]
    sets = [set(simhash.shingles(" ".join(p), 5)) for p in pages]
    want = {(i, j) for j in range(len(sets)) for i in range(j) if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])}
    assert want == {(k, k + 1) for k in range(0, 120, 2)}
    texts = spark.createDataFrame([(k, " ".join(p)) for k, p in enumerate(pages)], "th long, text string")
    got = simhash.similar_links(texts, Scratch(spark, "t"), 5, 0.8)
    assert {(x.a, x.b) for x in got.collect()} == want


def test_texts_that_hubs_leave_apart_give_their_prefixes_alone(spark, monkeypatch):
    r, counts, write = random.Random(11), {}, Scratch.write
    template = [f"w{r.randrange(10**9)}" for _ in range(314)]
    texts = [(k, " ".join(template + [f"w{r.randrange(10**9)}" for _ in range(58)])) for k in range(120)]

    def counted(self, df, name):
        out = write(self, df, name)
        counts[name] = out.count()
        return out

    monkeypatch.setattr(Scratch, "write", counted)
    assert simhash.similar_links(spark.createDataFrame(texts, "th long, text string"), Scratch(spark, "t"), 5, 0.8).count() == 0
    assert 0 < counts["shingles"] <= 120 * (0.2 * 368 + 2)


def test_near_duplicates_of_the_documents_equal_brute_force(spark):
    """Every pair of the smaller scale at 0.8: recall is 1 here; and an empty table."""
    docs = spark.read.parquet(DATA.replace("sf0.001", "sf0.01") + "/documents.parquet")
    rows = {r.doc_id: set(simhash.shingles(r.text, 5)) for r in docs.collect()}
    by = collections.defaultdict(list)
    root = {d: d for d in rows}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    shared = collections.Counter()
    for d, x in rows.items():
        for h in x:
            shared.update((e, d) for e in by[h])
            by[h].append(d)
    for (a, b), n in shared.items():
        if n >= 0.8 * (len(rows[a]) + len(rows[b]) - n):
            a, b = sorted((find(a), find(b)))
            root[b] = a
    got = {r.doc_id for r in simhash.drop_near_duplicates(docs).select("doc_id").collect()}
    assert got == {d for d in rows if find(d) == d or (not rows[d] and d == min(e for e in rows if not rows[e]))}
    assert simhash.drop_near_duplicates(docs.limit(0)).count() == 0


# --- packing ---


def test_ids_equal_the_tokenizers_library():
    from tokenizers import Tokenizer

    path = packing.tokenizer_path()
    lib, own = Tokenizer.from_file(path), packing.Encoder(path)
    import duckdb

    texts = [t for (t,) in duckdb.sql(f"select text from '{DATA}/documents.parquet'").fetchall()]
    texts += ["", " ", "a  b", " a ", "x\n\n y\t", "don't 's", "q" * 3000, "　é 漢字🙂", "<|endoftext|> a", "\x1c b", "1 22,333"]
    for t in texts:
        assert np.frombuffer(own.encode(t), "<u4").tolist() == lib.encode(t, add_special_tokens=False).ids


def test_added_tokens_are_single_ids(documents):
    from tokenizers import Tokenizer

    lib = Tokenizer.from_file(packing.tokenizer_path())
    texts = ["a <|endoftext|> b", "<|endoftext|>", "x<|endoftext|><|endoftext|>\n y", "  <|endoftext|>  1", "<|endoftext", "don't <|ENDOFTEXT|>"]
    got = {r.doc_id: r for r in packing.pack(documents(list(enumerate(texts)), parts=1)).where("start = 0").collect()}
    own = packing.Encoder(packing.tokenizer_path())
    for k, t in enumerate(texts):
        ids = lib.encode(t, add_special_tokens=False).ids
        assert np.frombuffer(own.encode(t), "<u4").tolist() == ids and got[k].doc_tokens == len(ids) + 1
    assert np.frombuffer(own.encode(texts[0]), "<u4").tolist() == [64, 220, 50256, 275]


def test_packing_covers_every_id_once(documents):
    from tokenizers import Tokenizer

    lib = Tokenizer.from_file(packing.tokenizer_path())
    r = random.Random(5)
    rows = [(k, "word " * r.choice([1, 5, 300, 900, 3000])) for k in range(150)] + [(700, "cut <|endoftext|> here " * 400)] + ODD
    p = packing.pack(documents(rows)).toPandas()
    ids = {(d, t): np.array([*lib.encode(t or "", add_special_tokens=False).ids, 1], "<u4") for d, t in rows}
    for _, g in p.groupby("sequence_id"):
        g = g.sort_values("offset")
        ends = (g.offset + g.length).tolist()
        total = ends[-1]
        assert g.offset.tolist() == [0, *ends[:-1]] and (total == 2048 or total & (total - 1) == 0) and total <= 2048
    got = collections.Counter((None if x.doc_id != x.doc_id else x.doc_id, k) for x in p.itertuples() for k in range(x.start, x.start + x.length))
    want = collections.Counter((d, k) for d, t in rows for k in range(len(ids[d, t])))
    assert got == want
    whole = {d: v for (d, _), v in ids.items()}
    for x in p.itertuples():
        mine = whole[None if x.doc_id != x.doc_id else x.doc_id]
        assert zlib.crc32(mine[x.start : x.start + x.length].tobytes()) == x.ids_crc32 and x.doc_tokens == len(mine)
    assert packing.pack(documents([])).count() == 0


def test_sum_of_squares_choice():
    bins = packing.SumOfSquares(10)
    r = random.Random(2)
    for k in range(300):
        n = r.randint(1, 9)
        options = {f: None for f in range(1, 11 - n) if bins.levels[f]} | {0: None}
        before = bins.levels.copy()
        bins.place((k, 0, b"", n), n)
        cost = lambda v: int((v[1:10] ** 2).sum())

        def after(f):
            v = before.copy()
            v[f] -= f > 0
            if f + n < 10:
                v[f + n] += 1
            return cost(v)

        assert cost(bins.levels) == min(map(after, options))


# --- quality ---


def test_machine_equals_all_pairs():
    rng = np.random.default_rng(1)
    m = quality.FactorisationMachine(50, 4)
    m.w[:], m.w0 = rng.normal(size=50), 0.3
    index = np.array([1, 5, 9, 2, 3], np.int32)
    value = rng.normal(size=5).astype(np.float32)
    got, _ = m.raw(index, value, np.array([0, 3]))
    for row, (a, b) in enumerate(((0, 3), (3, 5))):
        want = m.w0 + sum(m.w[index[i]] * value[i] for i in range(a, b)) + sum(m.v[index[i]] @ m.v[index[j]] * value[i] * value[j] for i in range(a, b) for j in range(a, i))
        assert got[row] == pytest.approx(want, rel=1e-4)


def test_quality_learns(spark, documents):
    r = random.Random(4)
    rows = [(k, " ".join(r.choice(["fine", "good", "plain", "word"]) + (r.choice(["%%%", "###", "***"]) if k % 3 == 0 else "") for _ in range(r.randint(3, 60)))) for k in range(300)]
    labels = spark.createDataFrame([(d, int(d % 3 != 0)) for d, _ in rows], "doc_id long, quality int")
    got = quality.classify(documents(rows + ODD), labels).toPandas()
    assert len(got) == len(rows + ODD) and got.score.between(0, 1).all() and "label" in got
    held = got[got.held_out & (got.doc_id < 300)]
    assert len(held) > 30 and ((held.doc_id % 3 != 0).astype(int) == held.predicted).mean() > 0.95
    assert set(quality.classify(documents(rows[:3]), labels.limit(0)).toPandas().score) == {0.5}
    assert quality.classify(documents([]), labels).count() == 0


def test_quality_replaces_columns_of_its_names(spark, documents):
    docs = documents([(k, f"w{k} x") for k in range(20)] * 2).withColumn("score", F.lit("old")).withColumn("predicted", F.lit("old")).withColumn("kept", F.lit(3))
    labels = spark.createDataFrame([(k, k % 2) for k in range(20)], "doc_id long, quality int")
    out = quality.classify(docs, labels)
    assert out.columns == ["doc_id", "text", "lang", "source", "n_chars", "label", "kept", "score", "held_out", "predicted"]
    assert all(0 <= r.score <= 1 and r.kept == 3 for r in out.collect())


# --- top k ---


def test_top_k_equals_brute_force(spark, monkeypatch):
    monkeypatch.setattr(knn, "BLOCK", 16)
    rng = np.random.default_rng(3)
    rows = [(k, (rng.normal(size=6) + 3 * (k % 4)).astype(np.float32).tolist()) for k in range(240)]
    rows += [(240 + k, rows[0][1]) for k in range(80)]  # one vector many times
    bad = [(1000, None), (1001, [1.0, None, 1.0, 1.0, 1.0, 1.0]), (1020, [float("nan")] * 6), (1040, [float("inf")] * 6), (None, rows[1][1])]
    small = [(2000, [1.0]), (2001, [2.0]), (2020, [])]
    df = spark.createDataFrame([(*r, "x") for r in rows + rows[:5] + bad + small], "vec_id long, embedding array<float>, score string").repartition(4)
    got = sorted(map(tuple, knn.top_k(df).collect()))
    ints = [(k, np.floor(64 * np.array(v, np.float64)).astype(np.int64)) for k, v in rows + rows[:5] + small]
    want = []
    for n, (q, x) in enumerate(ints):
        if q % 20 == 0:
            s = sorted((-int(x @ v), k) for m, (k, v) in enumerate(ints) if m != n and len(v) == len(x))
            want += [(q, rank, k, -score) for rank, (score, k) in enumerate(s[:20], 1)]
    assert got == sorted(want) and knn.top_k(df.limit(0)).count() == 0


def test_top_k_broadcasts_no_blocks(spark, tmp_path):
    # a query that visits many cells repeats its vector, so megabytes on disk are gigabytes in the driver
    row = (1, 0, 1, b"r" * 8, b"i" * 8, b"v" * 8, b"f" * 8)
    sides = []
    for name in ("data", "visits"):
        spark.createDataFrame([row], knn.BLOCKS).write.parquet(str(tmp_path / name))
        sides.append(spark.read.schema(knn.BLOCKS).parquet(str(tmp_path / name)))
    with knn.arrow_rows(spark, 8):
        met = knn._met(*sides)
        plan = met._jdf.queryExecution().executedPlan().toString()
        assert met.count() == 1
    assert "SortMergeJoin" in plan and "Broadcast" not in plan


def test_top_k_keeps_rows_that_share_an_id(spark, monkeypatch):
    import duckdb

    monkeypatch.setattr(knn, "BLOCK", 16)
    rng = np.random.default_rng(5)
    rows = [(k % 90, rng.normal(size=4).astype(np.float32).tolist()) for k in range(150)]
    rows += rows[15:22] * 2  # and equal vectors with them, queries and candidates
    db = duckdb.connect()
    db.execute("create table embeddings (vec_id bigint, embedding float[])")
    db.executemany("insert into embeddings values (?, ?)", rows)
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(3)
    assert sorted(map(tuple, knn.top_k(df).collect())) == sorted(db.sql(knn.ORACLE).fetchall())


# --- the whole ---


def test_catalog_names():
    names = list(catalog.queries())
    assert [int(n[2:].split("_")[0]) for n in names] == list(range(1, 14)) and set(catalog.oracle_sql()) <= set(names)


def test_pipeline_stages_work_on_what_is_kept(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    counts = [docs.count()]
    scratch = Scratch(spark, "t")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = scratch.write(stage(spark, docs, DATA), name)
        assert docs.columns == list(corpus_pipeline.COLUMNS)
        counts.append(docs.count())
    assert counts[1] < counts[0] and counts[2] == counts[1] and counts[3] < counts[2]
    p = corpus_pipeline.STAGES[-1][1](spark, docs, DATA).toPandas()
    own = packing.Encoder(packing.tokenizer_path())
    assert p.length.sum() == sum(len(own.encode(r.text or "")) // 4 + 1 for r in docs.collect())
