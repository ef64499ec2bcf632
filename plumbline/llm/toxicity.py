"""Toxicity scores from a learned lexicon.

The lexicon (words and word beginnings that mark toxic rows) is learned from labelled rows and kept as a trie. A token
is looked up exactly, by its beginning, and else through a Levenshtein automaton: the token's non-deterministic
automaton, held as one bit set per number of edits, walks the trie and ends wherever no state is left, so misspelt
terms are found without listing their variants. Hits are then weighed by their context window: a hit inside quotation
marks or beside words of report counts little, hits close together count as abuse. A logistic regression over these
few features gives the score.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import give_back, id_text, sole, texts

#: Labelled rows that are read to learn; the lexicon and the words known to be harmless are all that these rows tell.
TRAIN_ROWS = 16_000
#: Tokens to either side that make a hit's context; a burst of abuse is measured over as many.
WINDOW = 8
STEMS = (4, 5, 6)
LEET = str.maketrans("013457@$!|", "oieastasil")
STRIP = re.compile(r"[\W_]+")
QUOTES = frozenset("\"'“”„«»‘’‚‹›`")
#: Words of report beside a quoted term, in the four languages of the corpus.
REPORT = frozenset("said says wrote called quote quoted quotes word term means meaning example sagte schrieb zitat wort begriff nannte dit écrit mot terme appelé citation dijo escribió palabra término llamó cita".split())
#: Tokens remembered by a worker; then its memory starts anew.
MEMO_SIZE = 1 << 18


def reach(term: str) -> int:
    """Edits within which a token is a misspelling of a term: each other word of three letters is near one of three."""
    return 0 if len(term) < 4 else 1 if len(term) < 9 else 2


class Trie:
    """Lexicon terms; nodes are dicts by character, and the key "" holds the term that ends there."""

    def __init__(self, terms):
        self.root: dict = {}
        for term in terms:
            node = self.root
            for ch in term:
                node = node.setdefault(ch, {})
            node[""] = term

    def stem(self, word: str) -> str | None:
        """The longest term that the word begins with."""
        node, best = self.root, None
        for ch in word:
            node = node.get(ch)
            if node is None:
                return best
            best = node.get("", best)
        return best

    def near(self, word: str, most: int) -> tuple[int, str] | None:
        """(edits, term) of the nearest term within ``most`` edits and its own reach; ties go to the smaller term."""
        n = len(word)
        bits = Counter()
        for i, ch in enumerate(word):
            bits[ch] |= 1 << i
        full, start = (1 << n + 1) - 1, [(1 << e + 1) - 1 for e in range(most + 1)]
        best = None
        todo = [(self.root, start)]
        while todo:
            node, states = todo.pop()
            for ch, below in node.items():
                if ch == "":
                    for edits, s in enumerate(states):
                        if s >> n & 1:
                            if edits <= reach(below) and (best is None or (edits, below) < best):
                                best = (edits, below)
                            break
                    continue
                same, new, prev = bits.get(ch, 0), [], 0
                for e, s in enumerate(states):
                    moved = (s & same) << 1  # state i: i characters of the word are read
                    if e:
                        moved |= states[e - 1] | states[e - 1] << 1 | prev << 1  # a character too many, another one, one too few
                    prev = moved & full
                    new.append(prev)
                if new[-1]:
                    todo.append((below, new))
        return best


@dataclass
class Model:
    """words and stems: the lexicon, whose words are also matched with edits; spelt: further terms matched with edits; known: words that are no misspelling; then the regression."""

    words: list[str] = field(default_factory=list)
    stems: list[str] = field(default_factory=list)
    spelt: list[str] = field(default_factory=list)
    known: list[str] = field(default_factory=list)
    weights: list[float] = field(default_factory=lambda: [-3.0, 2.0, 1.0, 1.0, -0.5])

    def prepare(self) -> None:
        self._words, self._known = set(self.words), set(self.known)
        self._stems = Trie(self.stems)
        spelt = sorted(w for w in {*self.words, *self.spelt} if reach(w))
        # Pigeonhole: a word within e edits of a term holds one of the term's e + 1 parts unchanged: its first at the
        # start, its last at the end, or, with an edit in either of these, its middle at most one place off. It is also
        # at most e longer or shorter. So the trie is dealt into one for each part, with the lengths as a bit set, and
        # only those of the word's own parts are walked.
        heads, tails, mids = {}, {}, {}
        for w in spelt:
            parts = reach(w) + 1
            cut = len(w) // parts
            heads.setdefault(w[:cut], []).append(w)
            tails.setdefault(w[cut * (parts - 1) :], []).append(w)
            if parts == 3:
                mids.setdefault((cut, w[cut : 2 * cut]), []).append(w)
        self._heads, self._tails, self._mids = ({part: (sum({1 << n for w in own for n in range(len(w) - reach(w), len(w) + reach(w) + 1)}), Trie(own)) for part, own in by.items()} for by in (heads, tails, mids))
        self._head_sizes, self._tail_sizes, self._cuts = sorted({*map(len, heads)}), sorted({*map(len, tails)}), sorted({cut for cut, _ in mids})
        model = self

        class Memo(dict):
            def __missing__(self, token: str) -> float:
                if len(self) >= MEMO_SIZE:
                    self.clear()
                self[token] = out = model._strength(token)
                return out

        self._memo = Memo()

    def forget(self) -> None:
        """Drop what prepare() and scoring have built, which refers to itself."""
        self.__dict__ = self.__getstate__()

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k[0] != "_"}

    def _strength(self, token: str) -> float:
        """How sure it is that a token is a term: 1 for an exact one, less by each edit, 0 for none.

        Terms that punctuation joins to one token add up, unless the token without it is one itself.
        """
        fused, parts = self._term(token), list(filter(None, STRIP.split(token)))
        return max(fused, sum(map(self._term, parts))) if len(parts) > 1 else fused

    def _term(self, token: str) -> float:
        word = STRIP.sub("", token)
        if not word:
            return 0.0
        if word in self._words:
            return 1.0
        if self._stems.stem(word):
            return 1.0
        plain = STRIP.sub("", token.translate(LEET))
        if plain != word and plain in self._words:
            return 0.9
        if word in self._known:
            return 0.0
        size, best = len(plain), 3
        places = [self._heads.get(plain[:n]) for n in self._head_sizes if n <= size]
        places += [self._tails.get(plain[-n:]) for n in self._tail_sizes if n <= size]
        places += [self._mids.get((cut, plain[at : at + cut])) for cut in self._cuts if size >= 3 * cut - 2 for at in (cut - 1, cut, cut + 1)]
        for place in places:
            if place and place[0] >> size & 1 and best > 1:
                near = place[1].near(plain, min(best - 1, 2 if size >= 7 else 1))
                best = near[0] if near else best
        return 0.7**best if best < 3 else 0.0

    def features(self, text: str) -> list[float]:
        """(1, log of the strength, log of the strongest window, strength by length, log of quoted hits)."""
        tokens = text.lower().split()
        found = list(map(self._memo.__getitem__, tokens))
        if not any(found):
            return [1.0, 0.0, 0.0, 0.0, 0.0]
        total, quoted, hits = 0.0, 0, []
        for i, s in enumerate(found):
            if s:
                near = tokens[max(0, i - WINDOW) : i + WINDOW + 1]
                own = tokens[i]
                in_marks = own[0] in QUOTES and own.rstrip(".,;:!?")[-1:] in QUOTES and len(own) > 2
                if not in_marks:
                    before, after = tokens[max(0, i - WINDOW) : i + 1], tokens[i : i + WINDOW + 1]
                    in_marks = any(t[0] in QUOTES for t in before) and any(t.rstrip(".,;:!?")[-1:] in QUOTES for t in after)
                if in_marks or not REPORT.isdisjoint(near):
                    quoted += 1
                    s *= 0.25
                total += s
                hits.append((i, s))
        best = at = 0
        window = 0.0
        for i, s in hits:
            window += s
            while hits[at][0] < i - 2 * WINDOW:
                window -= hits[at][1]
                at += 1
            best = max(best, window)
        return [1.0, math.log1p(total), math.log1p(best), total / math.sqrt(len(tokens)), math.log1p(quoted)]

    def score(self, text: str) -> float:
        z = sum(w * f for w, f in zip(self.weights, self.features(text), strict=True))
        return 1 / (1 + math.exp(-max(-60.0, min(60.0, z))))


def fit_regression(x: np.ndarray, y: np.ndarray, penalty: float = 1.0) -> list[float]:
    """Logistic regression by Newton steps; the penalty leaves the intercept alone. One class only: its base rate."""
    w, ridge = np.zeros(x.shape[1]), penalty * np.eye(x.shape[1])
    ridge[0, 0] = 1e-3
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -60, 60)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge, x.T @ (y - p) - ridge @ w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return [float(v) for v in w]


def held_out(doc_id: str | Column = "doc_id") -> Column:
    return F.crc32((F.col(doc_id) if isinstance(doc_id, str) else doc_id).cast("string")) % 5 == 0


def _count_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sole("toxicity")
    counts = (Counter(), Counter())
    for batch in batches:
        for toxic, text in zip(batch.column("toxic").to_pylist(), texts(batch), strict=True):
            words = {STRIP.sub("", t) for t in set(text.lower().split())}
            counts[toxic].update(words)
            counts[toxic].update({f"{w[:n]}*" for w in words for n in STEMS if len(w) > n})
        if sum(map(len, counts)) > 400_000:
            yield _term_rows(counts)
            counts = (Counter(), Counter())
    yield _term_rows(counts)
    del counts
    give_back()


def _term_rows(counts) -> pa.RecordBatch:
    terms = [t for t in {*counts[0], *counts[1]} if t]
    return pa.RecordBatch.from_arrays([pa.array(terms, pa.string()), *(pa.array([c[t] for t in terms], pa.int64()) for c in counts)], ["term", "clean", "toxic"])


def train(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> Model:
    """Learns from at most ``rows`` labelled documents, those of least hash; held-out ones are never read.

    Repeated label rows of one id count once, as toxic if any is. Three in five chosen rows give the lexicon, the others
    the regression, so that words met by chance weigh no more there than elsewhere. The chosen ids (bounded by ``rows``)
    are broadcast; no text is shuffled. Without labelled rows the model has an empty lexicon and a low fixed score.
    """
    spark = docs.sparkSession
    chosen = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~held_out()).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    chosen = chosen.withColumn("turn", F.pmod(F.xxhash64("doc_id"), F.lit(5))).orderBy(F.xxhash64("doc_id", F.lit("sample")), "doc_id").limit(rows).toPandas()
    if not len(chosen):
        return Model()
    picked = F.broadcast(spark.createDataFrame(chosen.astype("int64")))
    read = docs.join(picked, "doc_id")
    tox, clean = int(chosen[chosen.turn < 3].toxic.sum()), int((1 - chosen[chosen.turn < 3].toxic).sum())
    counts = read.where("turn < 3").select("toxic", "text").mapInArrow(_count_terms, "term string, clean long, toxic long").groupBy("term").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
    odds = F.log((F.col("toxic") + 0.5) / (tox + 1.0)) - F.log((F.col("clean") + 0.5) / (clean + 1.0))
    least = max(3, round(0.004 * tox))
    marks = counts.where((F.col("toxic") >= least) & (odds >= 3) & (F.col("clean") * 20 <= F.col("toxic"))).orderBy(F.desc("toxic"), "term").select("term").toPandas().term
    known = counts.where((F.col("clean") >= 3) & ~F.col("term").endswith("*")).select("term").toPandas().term
    stems = sorted(t[:-1] for t in marks if t.endswith("*"))
    model = Model([t for t in marks if t[-1] != "*"], [s for i, s in enumerate(stems) if not any(s != o and s.startswith(o) for o in stems[max(0, i - 3) : i])], known=list(known))
    # A beginning is only of use where it says more than the words themselves: it must hold several of them.
    model.stems = [s for s in model.stems if sum(w.startswith(s) for w in model.words) != 1 or not any(w.startswith(s) for w in model.words)]

    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sole("toxicity")
        model.prepare()
        for batch in batches:
            found = [model.features(text) for text in texts(batch)]
            yield pa.RecordBatch.from_arrays([batch.column("toxic"), pa.array(found, pa.list_(pa.float64()))], ["toxic", "x"])
        model.forget()
        give_back()

    fit = read.where("turn >= 3").select("toxic", "text").mapInArrow(measured, "toxic long, x array<double>").toPandas()
    if len(fit):
        model.weights = fit_regression(np.array(fit.x.tolist()), fit.toxic.to_numpy(float))
    return model


def scorer(model: Model):
    """A column function: text to score."""

    @F.pandas_udf("double")
    def score(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        sole("toxicity")
        model.prepare()
        for part in parts:
            yield pd.Series([model.score(text or "") for text in part], dtype="float64")
        model.forget()
        give_back()

    return score


def toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", rows: int = TRAIN_ROWS) -> DataFrame:
    """(doc_id, held_out, score, predicted), one row per input row.

    Null and empty text have no hits and get the score of such a text. A null id is never learned from and counts as
    not held out. Repeated rows get equal scores; an empty table gives an empty result.
    """
    docs = id_text(docs, id_col, text_col)
    scored = docs.select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), scorer(train(docs, labels, rows))("text").alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
