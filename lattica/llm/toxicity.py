"""Toxicity by a lexicon: Levenshtein automata intersected with its trie, and scores of the words around each hit.

The lexicon is learned from labelled rows: words, and stems that words begin with,
that stand in toxic rows far more often than in others. Its trie is intersected with the
automaton that accepts everything within a term's edit distance; the product is made
deterministic step by step, as words ask for it, so most words leave it after a few letters.
"""

import math
import re
import unicodedata
from collections import Counter, defaultdict
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lattica.llm.shared import fresh, release, small_batches, table

THRESHOLD = 0.7
#: Labelled rows that the lexicon is learned from at most: these many toxic ones and these many others, by a hash of their ids.
MAX_TOXIC, MAX_OTHER = 2000, 4000
#: Words whose place in the automaton a worker remembers at most.
REMEMBERED = 200_000
STEM = range(4, 9)
#: Labelled rows are near copies from this Jaccard similarity of their words on; pairs of min-hashes by which they are looked for.
SIMILAR, COPY_BANDS = 0.5, 12
#: Words before and after a hit that its score looks at.
WINDOW = 8
#: What each edit leaves of a term's chance, where no labelled row has the term so misspelled; rows that have it give a chance of their own.
EDIT = 0.9
QUOTES = "\"“”„«»‹›‘’"
#: Share of its chance that a quoted or reported term keeps before any labelled row is seen, and the rows that this guess counts for.
QUOTED, QUOTED_ROWS = 0.3, 10
REPORTING = frozenset("said says called calls quote quoted quotes word words term terms wrote writes called named insult insults slur slurs dit mot wort sagte dijo palabra".split())


def edits_for(n: int) -> int:
    """Edits allowed for a term of n letters."""
    return 0 if n < 5 else 1 if n < 8 else 2


def fold(word: str) -> str:
    return unicodedata.normalize("NFC", word.casefold())


_HEAD = re.compile(r"[^\w@$!]*")


def core(token: str) -> str:
    """A token without the marks around it, folded; digits and signs inside stay, as they may stand for letters. Each character is looked at once."""
    start, stop = _HEAD.match(token).end(), len(token)
    while stop > start and not (token[stop - 1].isalnum() or token[stop - 1] in "_@$"):
        stop -= 1
    return fold(token[start:stop])


class Automaton:
    """The lexicon's trie times the Levenshtein automaton of each term, made deterministic lazily.

    A state is a set of (trie node, edits so far); a letter leads from a node to its
    child, to any child with one edit more (substitution), back to the node with one edit more
    (insertion), and an edit alone leads to any child (deletion). States that no term can
    be reached from within its own distance are dropped.
    """

    def __init__(self, words: dict[str, float], stems: dict[str, float]):
        self.children: list[dict[str, int]] = [{}]
        self.terms: list[str | None] = [None]
        self.stems: list[str | None] = [None]
        for store, terms in ((self.terms, words), (self.stems, stems)):
            for w in terms:
                at = 0
                for c in w:
                    if c not in self.children[at]:
                        self.children[at][c] = len(self.children)
                        self.children.append({})
                        self.terms.append(None)
                        self.stems.append(None)
                    at = self.children[at][c]
                store[at] = w
        self.most = [0] * len(self.children)
        for at in range(len(self.children) - 1, -1, -1):  # children come after their parents
            own = edits_for(len(self.terms[at])) if self.terms[at] else 0
            self.most[at] = max([own, *(self.most[c] for c in self.children[at].values())])
        self.letters = {c for d in self.children for c in d}
        self.states: list[tuple[tuple[int, int], ...]] = []
        self.ids: dict[tuple[tuple[int, int], ...], int] = {}
        self.moves: list[dict[str, int]] = []
        self.begins: list[str | None] = []
        self.start = self._state({0: 0})

    def _state(self, best: dict[int, int]) -> int:
        todo = list(best)
        while todo:  # deletions
            at = todo.pop()
            for c in self.children[at].values():
                e = best[at] + 1
                if e <= self.most[c] and e < best.get(c, 99):
                    best[c] = e
                    todo.append(c)
        key = tuple(sorted(best.items()))
        if key not in self.ids:
            self.ids[key] = len(self.states)
            self.states.append(key)
            self.moves.append({})
            exact = [self.stems[at] for at, e in key if e == 0 and self.stems[at]]
            self.begins.append(max(exact, key=len) if exact else None)
        return self.ids[key]

    def _move(self, state: int, letter: str) -> int:
        best: dict[int, int] = {}
        for at, e in self.states[state]:
            if e < self.most[at]:
                best[at] = min(best.get(at, 99), e + 1)
            for c, to in self.children[at].items():
                cost = e + (c != letter)
                if cost <= self.most[to]:
                    best[to] = min(best.get(to, 99), cost)
                elif cost == 0:
                    best[to] = 0
        return self._state(best) if best else -1

    def find(self, word: str) -> tuple[str, int, bool] | None:
        """(term, edits, whether it is a stem) of the nearest term, None if none is near."""
        at, stem = self.start, None
        for letter in word:
            known = letter if letter in self.letters else "\0"
            moves = self.moves[at]
            at = moves[known] if known in moves else moves.setdefault(known, self._move(at, known))
            if at < 0:
                break
            stem = self.begins[at] or stem
        near = [(e, self.terms[n]) for n, e in self.states[at] if self.terms[n] and e <= edits_for(len(self.terms[n]))] if at >= 0 else []
        if near and (not stem or min(near)[0] == 0):
            e, term = min(near)
            return term, e, False
        return (stem, 0, True) if stem else None


@dataclass
class Model:
    """Terms with the chance that a row with one is toxic; plain data, some KB."""

    base: float = 0.05
    words: dict[str, float] = field(default_factory=dict)
    stems: dict[str, float] = field(default_factory=dict)
    #: of misspelled hits, by term and edits
    fuzzy: dict[tuple[str, int], float] = field(default_factory=dict)
    #: what is left of a term's chance where it is quoted or told of
    quoted: float = QUOTED


class Scorer:
    def __init__(self, model: Model):
        self.model, self.automaton = model, Automaton(model.words, model.stems)
        self.known: dict[str, tuple[str, int, bool] | None] = {}
        self.hits: dict[str, tuple[str, int, bool]] = {}

    def look_up(self, tokens: Iterable[str]) -> set[str]:
        """The distinct tokens among those given that hit the lexicon."""
        distinct = set(tokens)
        if len(self.known) + len(distinct) > REMEMBERED:
            self.known, self.hits = {}, {}
        for t in distinct:
            if t not in self.known:
                w = core(t)
                self.known[t] = r = self.automaton.find(w) if w else None
                if r:
                    self.hits[t] = r
        return distinct & self.hits.keys() if len(self.hits) > len(distinct) else {t for t in self.hits if t in distinct}

    def chance(self, hit: tuple[str, int, bool]) -> float:
        term, edits, stem = hit
        if stem:
            return self.model.stems[term]
        known = self.model.fuzzy.get((term, edits)) if edits else None
        return self.model.words[term] * EDIT**edits if known is None else known

    def score(self, text: str | None) -> float:
        """Chance that the text is toxic: none of its hits counts as abuse with the product of their doubts.

        A hit counts less if it is quoted: if it stands between quotation marks, or next to a word
        of saying or naming with no other hit nearby. Hits near one another support each other.
        """
        base = self.model.base
        tokens = (text or "").split()
        hit = self.look_up(tokens)
        if not hit:
            return base
        doubt, seen = 1.0 - base, Counter()
        for t, quoted, near in self.contexts(tokens, hit):
            p = self.chance(self.hits[t])
            if quoted:
                p *= self.model.quoted
            elif near:
                p = 1 - (1 - p) ** 1.5
            term = self.hits[t][0]
            seen[term] += 1
            doubt *= (1 - min(p, 0.99)) ** (1 / seen[term] ** 2)  # the same word again adds ever less
        return 1.0 - doubt

    def contexts(self, tokens: list[str], hit: set[str]) -> Iterator[tuple[str, bool, bool]]:
        """(token, whether it is quoted or told of, whether another hit is near) of each place that hits."""
        places = [i for i, t in enumerate(tokens) if t in hit]
        marks = [0]
        for t in tokens:
            marks.append(marks[-1] + sum(c in QUOTES for c in t))
        for k, i in enumerate(places):
            near = any(abs(places[j] - i) <= WINDOW for j in (k - 1, k + 1) if 0 <= j < len(places))
            lo, hi = max(0, i - WINDOW), min(len(tokens), i + WINDOW + 1)
            own = marks[i + 1] - marks[i]
            inside = own >= 2 or (marks[i] % 2 == 1 and marks[hi] > marks[i + 1] - own and marks[i] > marks[lo]) or (own == 1 and (marks[hi] - marks[i + 1] > 0 or marks[i] - marks[lo] > 0))
            told = any(core(x) in REPORTING for x in tokens[max(0, i - 2) : i])
            yield tokens[i], inside or (told and not near), near


def near_copies(rows: list[frozenset[str]]) -> list[int]:
    """For each set of words, the first one of its family: those that one row of it resembles by a Jaccard similarity of SIMILAR or more.

    Sets that share a pair of min-hashes are compared; none is taken for alike unseen.
    """
    add, by = np.random.default_rng(6).integers(0, 1 << 64, (2, 2 * COPY_BANDS, 1), np.uint64) | np.array([[[0]], [[1]]], np.uint64)
    met: dict[tuple[int, bytes], list[int]] = defaultdict(list)
    family = list(range(len(rows)))
    for k, words in enumerate(rows):
        own = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))
        if not len(own):
            continue
        x = (own ^ add) * by
        low = (x ^ (x >> np.uint64(29))).min(axis=1).reshape(COPY_BANDS, 2)
        keys = [(i, r.tobytes()) for i, r in enumerate(low)]
        for first in sorted({j for key in keys for j in met[key]}):
            both = len(words & rows[first])
            if both >= SIMILAR * (len(words) + len(rows[first]) - both):
                family[k] = first
                break
        else:
            for key in keys:
                met[key].append(k)
    return family


def learn(rows: Iterable[tuple[str | None, int]]) -> Model:
    """A model from (text, toxic) pairs; without toxic rows it finds nothing and scores the base rate.

    Every row is used, but a word counts once in a family of near copies with one label, or the words of
    a much-copied toxic row would look toxic.
    """
    found, texts = [], []
    pool: dict[str, str] = {}
    for text, y in rows:
        found.append(frozenset(pool.setdefault(w, w) for w in map(core, set((text or "").split())) if w))
        texts.append((text or "", y))
    families: dict[tuple[int, int], frozenset[str]] = {}
    for first, words, (_, y) in zip(near_copies(found), found, texts, strict=True):
        families[first, y] = families[first, y] | words if (first, y) in families else words
    docs = [(words, y) for (_, y), words in families.items()]
    del found, families
    n = Counter(y for _, y in docs)
    if not n[1] or not n[0]:
        return Model(base=min(0.5, max(0.01, n[1] / max(1, len(docs)))))
    least_w, least_s = max(4, n[1] // 200), max(6, n[1] // 150)

    def stems_of(words: Iterable[str]) -> set[str]:
        return {w[:k] for w in words for k in STEM if len(w) > k}

    w_toxic, s_toxic = Counter(), Counter()
    for ws, y in docs:
        if y:
            w_toxic.update(ws)
            s_toxic.update(stems_of(ws))
    w_in = {w: [0, a] for w, a in w_toxic.items() if a >= least_w}
    s_in = {x: [0, a] for x, a in s_toxic.items() if a >= least_s}
    del s_toxic
    for ws, y in docs:
        if not y:
            for w in ws & w_in.keys():
                w_in[w][0] += 1
            for x in stems_of(ws) & s_in.keys():
                s_in[x][0] += 1
    # what a word of toxic rows only would show by chance
    prior = n[1] / (n[0] + n[1])
    # the sample holds more toxic rows than the table, so chances are of equal classes
    even = n[0] / n[1]

    def chance(a: int, b: int) -> float:
        return (a * even + 0.5) / (a * even + b + 1.5)

    def holds(a: int, b: int, least: int) -> bool:
        return a >= least and chance(a, b) >= 0.97 and a * math.log(1 / max(prior, 1e-9)) > 8 and b <= 0.03 * a * even

    words = {w: chance(*reversed(c)) for w, c in w_in.items() if len(w) >= 3 and holds(c[1], c[0], least_w)}
    likely = {x for x, (b, a) in s_in.items() if holds(a, b, least_s)}
    variety: dict[str, set[str]] = defaultdict(set)
    for w in w_toxic:
        for x in stems_of([w]) & likely:
            variety[x].add(w)
    stems: dict[str, float] = {}
    for x in sorted(likely, key=lambda x: (len(x), x)):
        b, a = s_in[x]
        # a stem has many endings, none of which makes up most of its rows
        if len(variety[x]) >= max(5, a // 8) and not any(x[:k] in stems for k in range(4, len(x))) and max(w_toxic[w] for w in variety[x]) <= 0.6 * a:
            stems[x] = chance(a, b)
    words = {w: p for w, p in words.items() if not any(w[:k] in stems for k in STEM)}
    model = Model(words=words, stems=stems)
    seeker = Scorer(model)
    fuzzy: dict[tuple[str, int], list[int]] = defaultdict(lambda: [0, 0])
    missed = [0, 0]
    for ws, y in docs:
        found = [seeker.hits[t] for t in seeker.look_up(ws)]
        for term, e in {(t, e) for t, e, stem in found if e}:
            if not any(not e2 for _, e2, _ in found):  # only where no exact hit tells
                fuzzy[term, e][y] += 1
        missed[y] += not found
    model.fuzzy = {k: (c[1] * even + 0.5) / (c[1] * even + c[0] + 1.0) for k, c in fuzzy.items()}
    model.base = min(0.6, max(0.01, (missed[1] + 0.5) / (missed[0] + missed[1] + 1)))
    told = [0, 0]  # rows whose exact hits are all quoted or told of
    for text, y in texts:
        tokens = text.split()
        hit = {t for t in seeker.look_up(tokens) if not seeker.hits[t][1]}
        told[y] += bool(hit) and all(quoted for _, quoted, _ in seeker.contexts(tokens, hit))
    model.quoted = (told[1] * even + QUOTED * QUOTED_ROWS) / (told[1] * even + told[0] + QUOTED_ROWS)
    return model


def train(docs: DataFrame, labels: DataFrame, max_toxic: int = MAX_TOXIC, max_other: int = MAX_OTHER) -> Model:
    """Learn from labelled rows whose crc32(doc_id as text) mod 3 is not 1.

    The sample is bounded by max_toxic and max_other, taken by a hash of the doc_id; every row of it is used. Rows with null ids or labels are left out, a doc_id with
    several labels counts as toxic if one says so, one with several texts gives the least of them.
    """
    y = labels.where("doc_id is not null and toxic is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    y = y.where(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 != 1)
    order = F.xxhash64(F.lit("train"), "doc_id")
    picked = y.where("toxic = 1").orderBy(order).limit(max_toxic).unionByName(y.where("toxic = 0").orderBy(order).limit(max_other))
    # max_toxic + max_other ids at most
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).join(F.broadcast(picked), "doc_id")
    rows = rows.groupBy("doc_id").agg(F.min("text").alias("text"), F.first("toxic").alias("toxic")).orderBy("doc_id")
    model = learn((r["text"], r["toxic"]) for r in rows.toLocalIterator())
    release()
    return model


def scores(docs: DataFrame, model: Model, name: str = "score") -> DataFrame:
    """docs with a column of that name; one that docs has already is replaced. Null and empty texts score the base rate."""
    spark = docs.sparkSession
    small_batches(spark, 1000)
    sent = spark.sparkContext.broadcast(model)  # a lexicon, learned from a bounded sample

    def run(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        scorer = Scorer(sent.value)
        try:
            for t in texts:
                yield pd.Series([scorer.score(x) for x in t], dtype="float64")
        finally:
            del scorer
            release()

    score = F.pandas_udf(run, "double")
    score = score.asNondeterministic()  # else a filter on it would run it again
    return docs.withColumn(name, score(F.col("text").cast("string")))


def keep_clean(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs that score below the threshold, with the columns of docs; repeated rows are all kept or all dropped."""
    model = train(docs, labels)
    (own,) = fresh(docs, "score")
    return scores(docs, model, own).where(F.col(own) < threshold).select(*docs.columns)


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of all documents by a lexicon learned from the labelled rows that are not held out."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = scores(docs, train(docs, table(spark, sf_dir, "labels")))
    held_out = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1
    return out.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


QUERIES = {"op6_toxicity": op6_toxicity}
ORACLE_SQL: dict[str, str] = {}
