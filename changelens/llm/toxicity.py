"""Toxicity by a learned lexicon: Levenshtein automata against a trie, scored in context windows.

Terms are the words whose presence tells toxic documents apart in the labelled
rows.  A word of a text matches a term within one edit (terms of five letters
and more) or two (terms of eleven and more) if the automaton of the word and
the trie of the terms accept a common string.  Each match counts by its window:
speech inside quotation marks, or reported by a word close before, counts less
than direct address.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from changelens.llm.base import Scratch, bounded_labels, label_fold
from changelens.llm.simhash import shingle_hashes

#: Labelled documents learned from, at most; their words bound the lexicon, which has no limit of its own.
TRAIN_LIMIT = 20_000
#: Log-likelihood ratio a term must reach, and the share of toxic documents among those that have it.
MIN_RATIO, MIN_PRECISION = 20.0, 0.6
WINDOW, REPORTED, FUZZY_LETTERS, FUZZY_TRUST = 8, 3, (5, 11), (0.8, 0.6)
#: Shingle minima of a text, of which copies share at least half, and how many make a band.
MINIMA, BAND = 16, 2
CACHE = 300_000
LEET = str.maketrans("@4831!05$7", "aabeiiosst")
EDGES = ".,;:!?\"'`()[]{}<>*_~|/\\-–—…“”„«»‹›‘’¿¡#"
# Words that report speech or address a reader, in the corpus's languages.
REPORTING = frozenset("said says say saying called calls wrote writes quoted quote quotes word term slur according told sagte sagt nannte schrieb zitat wort laut a dit dixit appelé écrit mot selon dijo dice llamó escribió palabra según".split()) - {"a"}
ADDRESS = frozenset("you your you're u ur du dich dir dein deine ihr euch tu te toi ton ta vous votre usted tú te ti eres".split())
THRICE = re.compile(r"(.)\1{2,}")
OPEN, CLOSE = "“„«‹", "”“»›"


class Trie:
    """Terms as nested nodes: children by letter, and the term that ends there."""

    def __init__(self, terms: dict[str, float]):
        self.children: list[dict[str, int]] = [{}]
        self.ends: list[str | None] = [None]
        self.terms = terms
        for term in terms:
            at = 0
            for c in term:
                if c not in self.children[at]:
                    self.children[at][c] = len(self.children)
                    self.children.append({})
                    self.ends.append(None)
                at = self.children[at][c]
            self.ends[at] = term

    def search(self, word: str, most: int) -> tuple[str, int] | None:
        """The nearest term within `most` edits, swaps of neighbours included; ties: the heavier, then the smaller term.

        States of the word's automaton are bit sets over its positions, one
        for each number of edits; a branch of the trie ends when all are empty.
        """
        where: dict[str, int] = {}
        for k, c in enumerate(word):
            where[c] = where.get(c, 0) | 1 << k
        full = 1 << len(word)

        def close(states):  # dropping a letter of the word
            for e in range(most):
                states[e + 1] |= (states[e] << 1) & (2 * full - 1)
            return states

        best = None
        stack = [(0, close([1] + [0] * most), None, None)]
        while stack:
            node, states, last, previous = stack.pop()
            term = self.ends[node]
            if term is not None:
                d = next((e for e in range(most + 1) if states[e] & full), None)
                if d is not None:
                    key = (d, -self.terms[term], term)
                    best = min(best or key, key)
            for c, child in self.children[node].items():
                hits = where.get(c, 0)
                new = [(states[e] & hits) << 1 for e in range(most + 1)]
                for e in range(most):
                    new[e + 1] |= states[e] | (states[e] << 1) & (2 * full - 1)  # a letter added or changed
                    if last is not None:  # this letter and the last stand in the word the other way round
                        new[e + 1] |= (previous[e] & hits & (where.get(last, 0) >> 1)) << 2
                new = close(new)
                if any(new):
                    stack.append((child, new, c, states))
        return (best[2], best[0]) if best else None


def bare(word: str) -> str:
    """A word without marks around it, in plain small letters; digits and signs that stand for letters replaced."""
    word = word.strip(EDGES)
    if not word.isascii():
        word = unicodedata.normalize("NFKC", word)
    word = word.lower()
    if not word.isalpha():
        if sum(map(str.isalpha, word)) * 2 < len(word):
            return ""
        word = "".join(c for c in word.translate(LEET) if c.isalpha())
    return word


class Matcher:
    """Terms and their weights, with words seen in harmless documents kept from fuzzy matching."""

    def __init__(self, terms: dict[str, float], harmless: frozenset[str] = frozenset()):
        self.trie, self.harmless = Trie(terms), harmless
        self.known: set[str] = set()  # raw words looked at, and those of them that match
        self.found: dict[str, tuple[str, float]] = {}
        # one edit, or a swap, touches only one side of a term's middle letter: the other side is as it was
        long = [t for t in terms if len(t) >= FUZZY_LETTERS[0]]
        self.begins = {(t[: (len(t) - 1) // 2], len(t) + d) for t in long for d in (-1, 0, 1)}
        self.ends = {(t[1 + (len(t) - 1) // 2 :], len(t) + d) for t in long for d in (-1, 0, 1)}
        self.sides = sorted({len(x) for x, _ in self.begins | self.ends})
        # two of them leave one of three pieces, a letter apart each, as it was, moved by two places at most
        self.pieces: dict[int, set[tuple[str, int]]] = {}
        for t in terms:
            if len(t) >= FUZZY_LETTERS[1]:
                size = (len(t) - 2) // 3
                for at in (0, size + 1, 2 * size + 2):
                    for d in range(-2, 3):
                        self.pieces.setdefault(len(t) + d, set()).update((t[at : at + size], at + move) for move in range(-2, 3))

    def match(self, word: str) -> tuple[str, float] | None:
        """The term of a raw word and its trust."""
        if word not in self.known:
            if len(self.known) > CACHE:
                self.known.clear()
            self.known.add(word)
            got = self._match(bare(word))
            if got:
                self.found[word] = got
        return self.found.get(word)

    def _match(self, word: str):
        if not word or not self.trie.terms:
            return None
        if word in self.trie.terms:
            return word, 1.0
        if THRICE.search(word) and (thinned := THRICE.sub(r"\1", word)) in self.trie.terms:
            return thinned, 1.0
        n = len(word)
        one = any((word[:k], n) in self.begins or (word[-k:], n) in self.ends for k in self.sides)
        pieces = self.pieces.get(n)
        two = pieces and any((word[k : k + m], k) in pieces for m in {len(x) for x, _ in pieces} for k in range(n - m + 1))
        if not (one or two) or word in self.harmless:
            return None
        got = self.trie.search(word, 2 if two else 1)
        return (got[0], FUZZY_TRUST[got[1] - 1]) if got and len(got[0]) >= FUZZY_LETTERS[got[1] - 1] else None

    def strength(self, text: str | None) -> tuple[float, float]:
        """Sums of the weights of a text's matches: those said in earnest, and those quoted or reported."""
        words = (text or "").split()
        own = set(words)
        for w in own.difference(self.known):
            self.match(w)
        hits = own.intersection(self.found)
        if not hits:
            return 0.0, 0.0
        earnest = quoted = 0.0
        inside, spans = False, []
        for w in words:  # is a word inside quotation marks
            opens = w[0] in OPEN or w[0] == '"'
            spans.append(inside or opens)
            closes = any(c in CLOSE or c == '"' for c in w[opens:])
            inside = (inside or opens) and not closes
        for k, w in enumerate(words):
            if w not in hits:
                continue
            term, trust = self.found[w]
            around = {bare(x) for x in words[max(0, k - WINDOW) : k + WINDOW + 1]}
            weight = self.trie.terms[term] * trust
            reported = any(bare(x) in REPORTING for x in words[max(0, k - REPORTED) : k])
            if reported and not around & ADDRESS or spans[k] and (around & REPORTING or not around & ADDRESS):
                quoted += weight
            else:
                earnest += weight * (1.25 if around & ADDRESS else 1.0)
        return earnest, quoted


def _counts(batches):
    seen: Counter = Counter()
    toxic: Counter = Counter()
    for batch in batches:
        for label, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            own = {bare(w) for w in set((text or "").split())} - {""}
            seen.update(own)
            if label:
                toxic.update(own)
    rows = [(w, c, toxic[w]) for w, c in seen.items()]
    for k in range(0, len(rows), 50_000):
        w, c, t = zip(*rows[k : k + 50_000], strict=True)
        yield pa.RecordBatch.from_arrays([pa.array(w), pa.array(c, pa.int64()), pa.array(t, pa.int64())], ["word", "docs", "toxic"])


def _originals(rows: DataFrame) -> DataFrame:
    """doc_id of the sampled documents that are no copies of an earlier one, as half of their shingle minima tell.

    A toxic document copied a thousand times, with an edit here and there,
    would else make a term of each of its words.  The sample is bounded, so
    its minima are compared on the driver.
    """
    factors = np.random.default_rng(1).integers(1, 1 << 63, MINIMA, np.uint64) * np.uint64(2) + np.uint64(1)

    def run(batches):
        for batch in batches:
            minima = []
            for text in batch.column(1).to_pylist():
                h = shingle_hashes(text, 3)
                h = h if len(h) else np.zeros(1, np.uint64)
                mixed = (h ^ (h >> np.uint64(29)))[:, None] * factors
                minima.append((mixed ^ (mixed >> np.uint64(32))).min(0).tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(minima, pa.binary())], ["doc_id", "minima"])

    kind = rows.schema["doc_id"].dataType.simpleString()
    got = rows.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, minima binary").toArrow().sort_by("doc_id")
    kept, bands = [], {}
    for doc, raw in zip(got.column("doc_id").to_pylist(), got.column("minima").to_pylist(), strict=True):
        own = np.frombuffer(raw, np.uint64)
        keys = [(k, raw[8 * k : 8 * (k + BAND)]) for k in range(0, MINIMA, BAND)]
        met = {id(x): x for key in keys for x in bands.get(key, ())}
        if any(2 * (x == own).sum() >= MINIMA for x in met.values()):
            continue
        kept.append(doc)
        for key in keys:
            bands.setdefault(key, []).append(own)
    return rows.sparkSession.createDataFrame(pa.table({"doc_id": pa.array(kept, got.schema.field("doc_id").type)}))


def _ratio(a, n1, b, n0):
    """Signed log-likelihood ratio columns: a of n1 toxic and b of n0 other documents."""
    p = (a + b) / (n1 + n0)
    part = lambda x, n: F.when(x > 0, x * F.log(x / (n * p))).otherwise(0.0)
    return 2 * (part(a, n1) + part(b, n0) + part(n1 - a, n1 * (1 - p) / p) + part(n0 - b, n0 * (1 - p) / p))


def learn(docs: DataFrame, labels: DataFrame, label: str, allowed, limit: int = TRAIN_LIMIT):
    """(matcher, (bias, slope), quoted weight) from at most about `limit` labelled documents."""
    scratch = Scratch(docs.sparkSession, "toxicity")
    chosen = bounded_labels(labels.select("doc_id", label), label, allowed, limit)
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text")).join(F.broadcast(chosen), "doc_id")
    # one row an id, however often the id is repeated, so that the bound on labels is one on rows
    rows = scratch.write(rows.groupBy("doc_id").agg(F.first("label").alias("label"), F.min_by("text", F.xxhash64("text")).alias("text")), "sample")
    rows = rows.join(F.broadcast(_originals(rows)), "doc_id").select("label", "text")
    n, n1 = rows.agg(F.count("*"), F.sum("label")).first()
    n1 = n1 or 0
    if not n1 or n1 == n:
        return Matcher({}), (math.log((n1 + 0.5) / (n - n1 + 0.5)) if n else 0.0, 0.0), 0.25
    words = rows.mapInArrow(_counts, "word string, docs long, toxic long").groupBy("word").agg(F.sum("docs").alias("docs"), F.sum("toxic").alias("toxic"))
    a, b = F.col("toxic").cast("double"), (F.col("docs") - F.col("toxic")).cast("double")
    found = words.where((a >= 3) & (a / (a + b) >= MIN_PRECISION)).withColumn("ratio", _ratio(a, float(n1), b, float(n - n1)))
    found = found.where(F.col("ratio") >= MIN_RATIO).orderBy(F.desc("ratio"), "word").collect()  # words of at most `limit` documents
    prior = math.log(n1 / (n - n1))
    terms = {r["word"]: math.log((r["toxic"] + 0.5) / (r["docs"] - r["toxic"] + 0.5)) - prior for r in found}
    trie = Matcher(terms)

    def near(batches):  # words of harmless documents that a fuzzy match would take
        for batch in batches:
            keep = [w for w in batch.column(0).to_pylist() if w not in terms and trie.match(w)]
            yield pa.RecordBatch.from_arrays([pa.array(keep, pa.string())], ["word"])

    clean = words.where((a == 0) | (a / (a + b) < MIN_PRECISION)).select("word").mapInArrow(near, "word string")
    matcher = Matcher(terms, frozenset(r["word"] for r in clean.collect()))  # words of at most `limit` documents
    tried = (0.25, 0.0, 0.5, 1.0)

    def strengths(batches):
        for batch in batches:
            y, texts = (c.to_pylist() for c in batch.columns)
            earnest, quoted = zip(*map(matcher.strength, texts), strict=True) if texts else ((), ())
            yield pa.RecordBatch.from_arrays([pa.array(y, pa.int32()), pa.array(earnest, pa.float64()), pa.array(quoted, pa.float64())], ["y", "earnest", "quoted"])

    got = rows.mapInArrow(strengths, "y int, earnest double, quoted double").toArrow()
    y, earnest, quotes = (np.array(got.column(c), np.float64) for c in ("y", "earnest", "quoted"))
    fits = [(*_logistic(earnest + q * quotes, y), q) for q in tried]
    loss, bias, slope, quoted = min(fits, key=lambda f: round(f[0], 3))  # ties: the first, 0.25
    return matcher, (bias, slope), quoted


def _squash(s):
    return np.minimum(1.0, np.asarray(s, np.float64) / 6.0)


def _logistic(s: np.ndarray, y: np.ndarray) -> tuple[float, float, float]:
    """(loss, bias, slope) of a ridge logistic fit on squashed strengths, by Newton's method."""
    x, b = np.stack([np.ones_like(s), _squash(s)], 1), np.zeros(2)
    for _ in range(30):
        p = 1 / (1 + np.exp(-x @ b))
        g = x.T @ (p - y) + np.array([0, 0.01 * b[1]])
        h = (x * (p * (1 - p) + 1e-9)[:, None]).T @ x + np.diag([1e-6, 0.01])
        step = np.linalg.solve(h, g)
        b -= np.clip(step, -3, 3)
        if np.abs(step).max() < 1e-8:
            break
    p = np.clip(1 / (1 + np.exp(-x @ b)), 1e-12, 1 - 1e-12)
    return float(-(y * np.log(p) + (1 - y) * np.log(1 - p)).mean()), float(b[0]), float(max(b[1], 0.0))


def toxicity(docs: DataFrame, labels: DataFrame, label: str = "toxic", modulus: int = 5, held_out: int = 0, threshold: float = 0.5, limit: int = TRAIN_LIMIT) -> DataFrame:
    """doc_id, held_out, score, predicted, strength for each row of `docs`.

    Defined cases: null and empty texts match nothing and get the base score;
    without labels, or with one class only, all texts get the base rate (0.5
    without any row); labels that disagree count by majority; null labels and
    ids teach nothing; an id with several texts teaches with one of them;
    repeated rows are scored each; other columns are ignored; an empty table
    gives an empty result.
    """
    fold = label_fold(F.col("doc_id"), modulus) == held_out
    matcher, (bias, slope), quoted = learn(docs, labels, label, ~fold, limit)

    def run(batches):
        for batch in batches:
            s = np.array([a + quoted * b for a, b in (matcher.strength(t.as_py()) for t in batch.column(1))], np.float64)
            score = 1 / (1 + np.exp(-(bias + slope * _squash(s))))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(score), pa.array(s)], ["doc_id", "score", "strength"])

    rows = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    out = rows.mapInArrow(run, f"doc_id {kind}, score double, strength double")
    return out.select("doc_id", fold.alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"), "strength")
