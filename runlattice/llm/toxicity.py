"""Toxicity scores from a learned lexicon, met by Levenshtein automata, weighed by the words around each hit.

The lexicon is learnt from labelled documents: words that are significantly more frequent in toxic ones. Each word of a text gives a
Levenshtein automaton (bit vectors of the states with 0, 1, ... errors), which is intersected with the lexicon's trie; branches die with the
automaton, so misspelled terms are found without comparing every pair. A window around each hit tells quotation and report from abuse. A
logistic model over these counts gives the score.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from runlattice.llm.common import ensure_workers_import, fresh

#: Most labelled documents that the lexicon and the model are learnt from: those with the least hash of their id.
TRAINING_DOCS = 20_000
#: Least z-value of a term's log odds. It asks for some number of documents, not for a share of them, so the words of a small language can pass.
LEAST_Z = 3.0
#: Least log odds of a term: what it adds to those of a document without it.
LEAST_ODDS = 4.0
#: Lengths of stems: beginnings of words that count as terms, written with a star, where many different endings follow.
STEM_LENGTHS = (4, 5, 6)
#: A stem is left out if one word makes up this share of it.
STEM_OF_ONE = 0.5
#: Words on each side of a hit that are its context.
WINDOW = 6
#: Most distinct words that a worker remembers; beyond it the memory is emptied.
MEMO = 500_000
#: Usual stand-ins for letters, quotation marks, and words that report speech or address a reader (English, German, French, Spanish).
STAND_INS = str.maketrans("013457@$!", "oieastasi")
QUOTES = "\"'“”„«»‘’`"
REPORTING = frozenset("said says say called calls call term word quote quoted wrote writes sagte sagt nannte wort schrieb zitat dit disait mot terme dijo dice palabra escribió llamó".split())
ADDRESS = frozenset("you your you're youre yourself du dein deine dich ihr euch tu toi ton ta vous votre tú usted eres".split())
EDGES = " \t\n.,;:!?()[]{}<>|*%&#~+=/\\_-" + QUOTES
N_FEATURES = 10
#: Pairs of word and branch that are followed together, and the most letters of such words: positions are bits of 64.
TOGETHER, MOST_LETTERS = 8192, 62


def allowed(term: str) -> int:
    """Errors that a term may have: none to 3 letters and in stems, one to 7, two above."""
    return 0 if term.endswith("*") else 0 if len(term) <= 3 else 1 if len(term) <= 7 else 2


class Trie:
    """A lexicon as nested nodes: [children, term index or -1, most errors of the terms below]; a stem ends at its star."""

    def __init__(self, terms: list[str]) -> None:
        self.terms = terms
        self.root: list = [{}, -1, 0]
        self.stem = min((len(t) - 1 for t in terms if t.endswith("*")), default=1 << 30)
        for i, term in enumerate(terms):
            node, e = self.root, allowed(term)
            node[2] = max(node[2], e)
            for c in term:
                node = node[0].setdefault(c, [{}, -1, 0])
                node[2] = max(node[2], e)
            node[1] = i
        self.heads: dict[int, set[str]] = {}
        self.tails: dict[int, set[str]] = {}
        self.middles: dict[int, set[tuple[int, str]]] = {}
        for term in terms:
            e, term = allowed(term), term.rstrip("*")
            cuts = [len(term) * i // (e + 1) for i in range(e + 2)]
            pieces = [term[a:b] for a, b in zip(cuts, cuts[1:])]
            self.heads.setdefault(len(pieces[0]), set()).add(pieces[0])
            self.tails.setdefault(len(pieces[-1]), set()).add(pieces[-1])
            for at, piece in zip(cuts[1:-2], pieces[1:-1]):
                for a in range(at - e + 1, at + e):
                    self.middles.setdefault(len(piece), set()).add((a, piece))
        self.lengths = {n + d for t in terms for n in [len(t)] for d in range(-allowed(t), allowed(t) + 1)}
        self.longest = max(self.lengths, default=0)
        self.stems = {t[:-1]: i for i, t in reversed(list(enumerate(terms))) if t.endswith("*")}
        self.pieces = self._pieces()
        self.alphabet = np.array(sorted({ord(c) for t in terms for c in t}), dtype=np.uint32)
        self.size = np.array([len(t) for t in terms], dtype=np.int64)
        self.errors = np.array([allowed(t) for t in terms], dtype=np.int64)
        self.letters = np.zeros((len(terms), max(map(len, terms), default=0)), dtype=np.int64)
        for i, t in enumerate(terms):
            self.letters[i, : len(t)] = np.searchsorted(self.alphabet, [ord(c) for c in t])

    def _pieces(self) -> dict[int, list[tuple[int, int, dict[str, set[int]]]]]:
        """By the letters of a word: places in it, and the terms that can be near if the word has their piece there.

        Of errors + 1 pieces one is whole and, of those that are, one is moved by no more errors than there are pieces before it, and for the rest of the term than pieces after it.
        """
        found: dict[int, dict[tuple[int, int], dict[str, set[int]]]] = {}
        for i, term in enumerate(self.terms):
            e = allowed(term)
            cuts = [len(term) * j // (e + 1) for j in range(e + 2)]
            for d in range(-e, e + 1) if not term.endswith("*") else ():
                for j, (p, q) in enumerate(zip(cuts, cuts[1:])):
                    for a in range(max(p - j, p + d - (e - j), 0), min(p + j, p + d + (e - j)) + 1):
                        found.setdefault(len(term) + d, {}).setdefault((a, a + q - p), {}).setdefault(term[p:q], set()).add(i)
        return {n: [(a, b, some) for (a, b), some in places.items()] for n, places in found.items()}

    def possible(self, word: str) -> bool:
        """Whether a term can be near at all: of its errors + 1 pieces one is whole, the first one in front, the last one at the end, one between near its place."""
        return (
            any(word[:n] in some for n, some in self.heads.items())
            or any(word[-n:] in some for n, some in self.tails.items())
            or any((a, word[a : a + n]) in some for n, some in self.middles.items() for a in range(max(0, len(word) - n + 1)))
        )

    def nearest(self, word: str) -> tuple[int, int] | None:
        """(term, errors) of the nearest term within its allowed errors, the first of equals; None if there is none."""
        n = len(word)
        if n > self.longest:
            found = [self.stems[word[:m]] for m in {len(s) for s in self.stems} if word[:m] in self.stems]
            return (min(found), 0) if found else None
        if (n not in self.lengths and n < self.stem) or not self.possible(word):
            return None
        masks: dict[str, int] = {}
        for i, c in enumerate(word):
            masks[c] = masks.get(c, 0) | 1 << i
        end, full = 1 << n, (1 << n + 1) - 1
        start = [(1 << e + 1) - 1 & full for e in range(self.root[2] + 1)]
        best: tuple[int, int] | None = None
        stack = [(self.root, start)]
        while stack:
            node, states = stack.pop()
            if node[1] >= 0:
                for e in range(min(allowed(self.terms[node[1]]), len(states) - 1) + 1):
                    if states[e] & end:
                        if best is None or (e, node[1]) < (best[1], best[0]):
                            best = (node[1], e)
                        break
            if "*" in node[0] and states[0] and (best is None or best[1] > 0):
                best = (node[0]["*"][1], 0)
            for c, child in node[0].items():
                m = masks.get(c, 0)
                low = (states[0] & m) << 1
                now, alive = [low], low
                for e in range(1, min(child[2], len(states) - 1) + 1):
                    before = states[e - 1]
                    low = ((states[e] & m) << 1 | before | before << 1 | low << 1) & full
                    now.append(low)
                    alive |= low
                if alive:
                    stack.append((child, now))
        return best

    def nearest_of_each(self, words: list[str]) -> list[tuple[int, int] | None]:
        """nearest() of many words: each automaton runs down the branches of the trie that end in a term with a piece of the word, all a letter at a time."""
        out: list[tuple[int, int] | None] = [None] * len(words)
        lengths = sorted({len(s) for s in self.stems})
        owners: list[int] = []
        terms: list[int] = []
        for i, w in enumerate(words):
            if len(w) > MOST_LETTERS:
                out[i] = self.nearest(w)
                continue
            begun = [self.stems[w[:n]] for n in lengths if w[:n] in self.stems]
            if begun:
                out[i] = (min(begun), 0)
            possible: set[int] = set()
            for a, b, some in self.pieces.get(len(w), ()):
                if (found := some.get(w[a:b])) is not None:
                    possible |= found
            owners += [i] * len(possible)
            terms += possible
        owner, term = np.array(owners, dtype=np.int64), np.array(terms, dtype=np.int64)
        for a in range(0, len(owner), TOGETHER):
            own, row = np.unique(owner[a : a + TOGETHER], return_inverse=True)
            for i, t, e in zip(*self._accepted([words[i] for i in own], row, term[a : a + TOGETHER])):
                i = int(own[i])
                if out[i] is None or (e, t) < (out[i][1], out[i][0]):
                    out[i] = (t, e)
        return out

    def _accepted(self, words: list[str], row: np.ndarray, term: np.ndarray) -> tuple[list[int], list[int], list[int]]:
        """Word, term and errors of the pairs whose automaton accepts."""
        n = np.array([len(w) for w in words], dtype=np.int64)
        codes = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        at = np.minimum(np.searchsorted(self.alphabet, codes), len(self.alphabet) - 1)
        known = self.alphabet[at] == codes
        place = np.arange(len(codes)) - np.repeat(np.cumsum(n) - n, n)
        masks = np.zeros((len(words), len(self.alphabet)), dtype=np.uint64)
        np.bitwise_or.at(masks, (np.repeat(np.arange(len(words)), n)[known], at[known]), _BITS[place[known]])
        full, one, out = _BITS[n + 1] - _BITS[0], np.uint64(1), []
        states = [(_BITS[e + 1] - _BITS[0]) & full[row] for e in range(int(self.errors[term].max()) + 1)]
        for depth in range(int(self.size[term].max()) + 1):
            over = self.size[term] == depth
            for e, state in enumerate(states):
                out.append([x[over & (self.errors[term] >= e) & (state & _BITS[n[row]] != 0)] for x in (row, term)] + [e])
            m, own = masks[row, self.letters[term, min(depth, self.letters.shape[1] - 1)]], full[row]
            now = [(states[0] & m) << one]
            for e in range(1, len(states)):
                before = states[e - 1]
                now.append(((states[e] & m) << one | before | before << one | now[-1] << one) & own)
            alive = ~over & np.logical_or.reduce([(x != 0) & (self.errors[term] >= e) for e, x in enumerate(now)])
            row, term, states = row[alive], term[alive], [x[alive] for x in now]
        return [i for r, _, _ in out for i in r.tolist()], [i for _, t, _ in out for i in t.tolist()], [e for r, _, e in out for _ in range(len(r))]


_BITS = np.uint64(1) << np.arange(64, dtype=np.uint64)


def normal(word: str) -> str:
    return word.strip(EDGES).lower()


class Matcher(dict):
    """The lexicon entry of each word as it stands, remembered; emptied when large."""

    def __init__(self, trie: Trie) -> None:
        self.trie = trie

    def __missing__(self, word: str) -> tuple[int, int] | None:
        if len(self) > MEMO:
            self.clear()
        plain = normal(word)
        got = self.trie.nearest(plain)
        if (got is None or got[1]) and (other := plain.translate(STAND_INS)) != plain:
            other = self.trie.nearest(other)
            if other and (got is None or other[1] + 1 < got[1] + 1):
                got = (other[0], max(1, other[1]))
        self[word] = got
        return got

    def meet(self, texts: list[str]) -> None:
        """Looks up the words of some texts that aren't known yet, together."""
        new = {w for t in texts for w in t.split()} - self.keys()
        if len(self) + len(new) > MEMO:
            self.clear()
            new = {w for t in texts for w in t.split()}
        plain = {w: normal(w) for w in new}
        found = self._nearest(set(plain.values()))
        other = {p: t for p, got in found.items() if (got is None or got[1]) and (t := p.translate(STAND_INS)) != p}
        stood_in = self._nearest(set(other.values()))
        for w, p in plain.items():
            got, near = found[p], stood_in.get(other.get(p, ""))
            self[w] = (near[0], max(1, near[1])) if near and (got is None or near[1] < got[1]) else got

    def _nearest(self, words: set[str]) -> dict[str, tuple[int, int] | None]:
        return dict(zip(words, self.trie.nearest_of_each(list(words))))


def features(text: str, match: Matcher, weight: np.ndarray) -> np.ndarray:
    """Of one text: exact, misspelled and quoted hits, hits that address a reader, and their density, by the terms' log odds."""
    out = np.zeros(N_FEATURES)
    words = text.split()
    out[0], out[1] = 1.0, np.log1p(len(words))
    got = list(map(match.__getitem__, words))
    hits = [i for i, g in enumerate(got) if g is not None]
    for i in hits:
        term, errors = got[i]
        around = words[max(0, i - WINDOW) : i] + words[i + 1 : i + 1 + WINDOW]
        near = {normal(w) for w in around}
        before, after = words[max(0, i - WINDOW) : i], words[i : i + 1 + WINDOW]
        opened = any(w[:1] in QUOTES for w in [*before, words[i]]) and any(w.rstrip(".,;:!?")[-1:] in QUOTES and w.rstrip(".,;:!?") for w in after)
        if opened or near & REPORTING:
            out[4] += weight[term]
            out[5] += 1
        elif errors:
            out[3] += weight[term] / errors
        else:
            out[2] += weight[term]
        out[6] += bool(near & ADDRESS)
    if hits:
        out[7] = any(got[i][1] == 0 for i in hits)
        out[8] = 100 * len(hits) / len(words)
        out[9] = len({got[i][0] for i in hits})
        out[2:7] = np.log1p(np.maximum(out[2:7], 0))
        out[8:] = np.log1p(out[8:])
    return out


def fitted(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2, steps: int = 40) -> np.ndarray:
    """Weights of a logistic model by Newton's method; the first feature is the constant."""
    w = np.zeros(x.shape[1])
    penalty = ridge * len(y) * np.eye(x.shape[1]) / 100
    penalty[0, 0] = 1e-9
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = x.T @ (x * (p * (1 - p) + 1e-9)[:, None]) + penalty
        step = np.linalg.solve(h, x.T @ (y - p) - penalty @ w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w


class Model:
    """Lexicon terms with their log odds, and the weights of the features."""

    def __init__(self, terms: list[str], odds: list[float], weights: np.ndarray) -> None:
        self.terms, self.odds, self.weights = terms, np.array(odds), weights


def _texts(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    return docs.select(F.col(f"`{doc_id}`").cast("bigint").alias("doc_id"), F.col(f"`{text}`").cast("string").alias("text"))


def chosen(rows: list) -> list:
    """All words, those that a stem covers too, as only words may have errors; a stem only where no single word makes up most of it, the shortest that does."""
    words = {r["word"]: r for r in rows if not r["word"].endswith("*")}
    most: Counter = Counter()
    for w, r in words.items():
        for n in STEM_LENGTHS:
            most[w[:n] + "*"] = max(most[w[:n] + "*"], r["bad"])
    stems: dict[str, object] = {}
    for r in sorted((r for r in rows if r["word"].endswith("*")), key=lambda r: (len(r["word"]), r["word"])):
        if most[r["word"]] < STEM_OF_ONE * r["bad"] and not any(r["word"][:n] + "*" in stems for n in STEM_LENGTHS if n < len(r["word"]) - 1):
            stems[r["word"]] = r
    return sorted([*words.values(), *stems.values()], key=lambda r: (-r["z"], r["word"]))


def learned(docs: DataFrame, labels: DataFrame, training_docs: int = TRAINING_DOCS, doc_id: str = "doc_id", text: str = "text") -> Model:
    """Learns lexicon and weights from labelled rows whose crc32(doc_id) mod 5 isn't 0, training_docs at most.

    Rows without id or label aren't used; where an id has several labels, toxic wins. Word counts are summed by Spark; the driver receives
    the terms, each found in several training documents, and one feature row per training document, both bounded by training_docs. Without training rows of both kinds every score is the share of toxic ones.
    """
    ensure_workers_import(docs.sparkSession)
    usable = labels.select(F.col("doc_id").cast("bigint").alias("id"), F.col("toxic").cast("int").alias("toxic")).filter("id IS NOT NULL AND toxic IS NOT NULL AND crc32(CAST(CAST(id AS STRING) AS BINARY)) % 5 <> 0")
    sample = usable.groupBy("id").agg(F.max("toxic").alias("toxic")).orderBy(F.xxhash64("id"), "id").limit(training_docs)
    rows = _texts(docs, doc_id, text).join(F.broadcast(sample), F.col("doc_id") == F.col("id")).select("doc_id", "text", "toxic")

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            count: Counter = Counter()
            for t, y in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                found = {normal(w) for w in (t or "").split()}
                count.update((w, y) for w in found if len(w) > 2 and "*" not in w)
                count.update((w, y) for w in {w[:n] + "*" for w in found for n in STEM_LENGTHS if len(w) > n and "*" not in w})
                count[("", y)] += 1
            yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in count], pa.string()), pa.array([k[1] for k in count], pa.int32()), pa.array(list(count.values()), pa.int64())], ["word", "toxic", "n"])

    counts = rows.mapInArrow(words, "word string, toxic int, n bigint").groupBy("word").agg(F.sum(F.when(F.col("toxic") == 1, F.col("n")).otherwise(0)).alias("bad"), F.sum(F.when(F.col("toxic") == 1, 0).otherwise(F.col("n"))).alias("good"))
    total = {r["word"]: (r["bad"], r["good"]) for r in counts.filter("word = ''").collect()}.get("", (0, 0))
    bad, good = total
    if not bad or not good:
        w = np.zeros(N_FEATURES)
        w[0] = 10.0 if bad and not good else -10.0
        return Model([], [], w)
    log_odds = F.log((F.col("bad") + 0.5) / (bad + 1.0)) - F.log((F.col("good") + 0.5) / (good + 1.0))
    z = log_odds / F.sqrt(1 / (F.col("bad") + 0.5) + 1 / (F.col("good") + 0.5))
    good_terms = counts.filter("word <> ''").select("word", "bad", log_odds.alias("odds"), z.alias("z"))
    good_terms = good_terms.filter((F.col("z") >= LEAST_Z) & (F.col("odds") >= LEAST_ODDS))
    terms = chosen(good_terms.collect())
    model = Model([r["word"] for r in terms], [r["odds"] for r in terms], np.zeros(N_FEATURES))
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        match = Matcher(Trie(sent.value.terms))
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            match.meet(texts)
            x = [features(t, match, sent.value.odds).tolist() for t in texts]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(x, pa.list_(pa.float64())), batch.column(2)], ["doc_id", "x", "toxic"])

    got = sorted(rows.mapInArrow(measured, "doc_id bigint, x array<double>, toxic int").collect(), key=lambda r: (r["doc_id"], r["x"]))
    model.weights = fitted(np.array([r["x"] for r in got]), np.array([float(r["toxic"] == 1) for r in got]))
    return model


def scored(docs: DataFrame, model: Model, text: str = "text", out: str = "score") -> DataFrame:
    """docs with a column out (0 to 1) added, replacing one of that name; a null text counts as empty, repeated rows have equal scores.

    A map over rows: no shuffle, one Arrow batch at a time.
    """
    ensure_workers_import(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(model)
    matchers: list[Matcher] = []

    @F.arrow_udf("double")
    def score(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        m = sent.value
        if not matchers:
            matchers.append(Matcher(Trie(m.terms)))
        for col in batches:
            texts = [t or "" for t in col.to_pylist()]
            matchers[0].meet(texts)
            yield pa.array([float(1 / (1 + np.exp(-np.clip(features(t, matchers[0], m.odds) @ m.weights, -30, 30)))) for t in texts], pa.float64())

    return docs.withColumn(out, score(F.col(f"`{text}`")))


def held_out(doc_id: str = "doc_id") -> object:
    """Whether the remainder of the id is 0; false without an id."""
    return F.expr(f"coalesce(crc32(CAST(CAST(`{doc_id}` AS STRING) AS BINARY)) % 5 = 0, false)")


def judged(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted of every row of docs."""
    model = learned(docs, labels)
    return scored(docs.select("doc_id", "text"), model).select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def without_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """docs without those that score 0.5 or more; columns as before, whatever their names. Null texts count as empty, repeated rows go or stay together, an empty table stays empty."""
    score = fresh(docs, "score")
    return scored(docs, learned(docs, labels), out=score).filter(F.col(score) < 0.5).drop(score)
