"""Mixing sources to target weights by soft membership, in DataFrame operations only.

A classifier learned from a labelled table gives every document posteriors over the domains (languages, say), so mixed
documents count for several. Each document has a nonnegative rate, its expected number of copies, and rates are fitted
so that the expected tokens of every domain meet its target: projected gradient on the least squares of the domain
totals, each weighed by the inverse of the domain's size. Its gradient for one document is a product of the
document's posteriors with one residual per domain, so the driver sees nothing but one total per domain, and each step
goes against the gradient and is projected onto the rates allowed, where the document is. The gradient is scaled by the
curvature between the domains, one small matrix that comes with the totals; a step that leads away is halved, and in
the end taken plain. The rates are a column; every few steps it is checkpointed, which keeps plans short and what a
lost executor costs small.
"""

from __future__ import annotations

import logging
import math
import re

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import checkpoint, release

#: A fit has stalled once so many steps leave more than four fifths of its least squares.
PATIENCE = 10
#: The shortest of the scaled steps, the most domains with such; with a least rate, each domain's mean rate is at least
#: so many times that, which leaves the rates room to be fitted.
SHORTEST, MOST_SCALED, SLACK = 1 / 64, 32, 1.05
#: Labelled rows that are read to learn, words that tell of each domain, words of evidence after which belief is capped.
TRAIN_ROWS, WORDS_EACH, EVIDENCE = 4_000, 25, 20.0
TOLERANCE = 1e-5
#: Steps between two checkpoints of the rates.
HELD = 4
NO_ID = 2**63 - 1
LOG = logging.getLogger(__name__)


def labelled(docs: DataFrame, labels: DataFrame, domain_col: str = "lang", rows: int = TRAIN_ROWS) -> DataFrame:
    """(domain, text) of at most ``rows`` documents that the labelled table names, those of least hash.

    The chosen ids are bounded by ``rows`` and broadcast; no text is shuffled.
    """
    chosen = labels.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id")).distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(domain_col).cast("string").alias("domain"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    return own.where("domain is not null").join(F.broadcast(chosen), "doc_id").select("domain", "text")


def _pattern(words: list[str]) -> str:
    """A pattern of those words between white space or ends of the text; words of one beginning share its letters."""
    tree: dict = {}
    for word in words:
        node = tree
        for ch in word:
            node = node.setdefault(ch, {})
        node[""] = {}

    def of(node: dict) -> str:
        ends, below = "" in node, [re.escape(ch) + of(node[ch]) for ch in sorted(node) if ch]
        if not below:
            return ""
        return f"(?:{'|'.join(below)})?" if ends else below[0] if len(below) == 1 else f"(?:{'|'.join(below)})"

    return rf"(?<!\S){of(tree)}(?!\S)"


def _hits(words: list[str], text: str | Column) -> Column:
    """Array of the occurrences of the words in a text, as they come; one pass over the text."""
    return F.regexp_extract_all(text, F.lit(_pattern(words)), F.lit(0)) if words else F.array().cast("array<string>")


class Classifier:
    """Naive Bayes over telling words, with evidence capped so that membership stays soft."""

    def __init__(self, domains: list[str], words: list[str], prior: list[float], likelihood: list[list[float]]):
        self.domains, self.words, self.prior, self.likelihood = domains, words, prior, likelihood

    def posteriors(self, hits: Column) -> Column:
        """Array of one number per domain, from the hits."""
        if not self.words:
            return F.array(*map(F.lit, self.prior))
        logs = F.create_map(*(x for i, w in enumerate(self.words) for x in (F.lit(w), F.array(*(F.lit(math.log(row[i])) for row in self.likelihood)))))
        zero = F.array(*(F.lit(0.0) for _ in self.domains))
        sums = F.aggregate(hits, zero, lambda acc, w: F.zip_with(acc, F.element_at(logs, w), lambda a, b: a + b))
        scale = F.least(F.lit(1.0), F.lit(EVIDENCE) / F.greatest(F.size(hits), F.lit(1)))
        prior = F.array(*(F.lit(math.log(p)) for p in self.prior))
        logits = F.zip_with(prior, sums, lambda p, x: p + scale * x)
        return F.transform(logits, lambda z: 1 / F.aggregate(logits, F.lit(0.0), lambda acc, o: acc + F.exp(o - z)))


def train(table: DataFrame) -> Classifier:
    """From (domain, text); every domain counts. An empty table gives one domain that holds all."""
    table = checkpoint(table.select("domain", F.lower("text").alias("lower")))
    sizes = table.groupBy("domain").agg(F.count(F.lit(1)).alias("n")).collect()
    if not sizes:
        return Classifier([""], [], [1.0], [[]])
    domains = sorted(r.domain for r in sizes)
    counts = checkpoint(table.select("domain", F.explode(F.regexp_extract_all("lower", F.lit(r"\S+"), F.lit(0))).alias("word")).groupBy("domain", "word").agg(F.count(F.lit(1)).alias("c")))
    share = counts.join(F.broadcast(counts.groupBy("domain").agg(F.sum("c").alias("all"))), "domain").withColumn("share", F.col("c") / F.col("all"))
    both = share.groupBy("word").agg(F.max(F.struct("share", "domain")).alias("most"), F.sum("share").alias("sum"))
    gain = (2 * F.col("most.share") - F.col("sum")).alias("gain")
    best = both.select("word", F.col("most.domain").alias("domain"), gain).where("gain > 0").withColumn("place", F.row_number().over(Window.partitionBy("domain").orderBy(F.desc("gain"), F.desc("word")))).where(F.col("place") <= WORDS_EACH)
    words = sorted({r.word for r in best.collect()})
    sums = {(r.domain, r.word): r.c for r in counts.where(F.col("word").isin(words)).collect()}
    release(table, counts)
    n = {r.domain: r.n for r in sizes}
    rows = [[sums.get((d, w), 0) + 1.0 for w in words] for d in domains]
    return Classifier(domains, words, [n[d] / sum(n.values()) for d in domains], [[x / sum(row) for x in row] for row in rows])


def memberships(docs: DataFrame, model: Classifier, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, d, t, n_tokens, p0, p1, ...): one row per input row; tokens are runs of non-blanks."""
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    own = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.xxhash64(text).alias("t"), F.regexp_count(text, F.lit(r"\S+")).cast("long").alias("n_tokens"), _hits(model.words, F.lower(text)).alias("hits"))
    own = own.select("doc_id", F.coalesce("doc_id", F.lit(NO_ID)).alias("d"), "t", "n_tokens", model.posteriors(F.col("hits")).alias("p"))
    return own.select("doc_id", "d", "t", "n_tokens", *(F.col("p")[k].alias(f"p{k}") for k in range(len(model.domains))))


def fit(members: DataFrame, k: int, targets: list[float] | None, least_rate: float, temper: float) -> tuple[DataFrame, list[float], list[float]]:
    """(members with their rate, targets in tokens, totals reached); the last are the nearest if targets cannot be met.

    members should be checkpointed. Steps end at the tolerance or when the fit has stalled; each lowers the error.
    """
    names = members.columns
    p = [F.col(f"p{j}") for j in range(k)]
    parts = [F.sum(F.col("n_tokens") * x * F.col("rate")) for x in p]
    # The curvature of the totals over rates that are free to fall; for very many domains steps go unscaled.
    free = F.when(F.col("rate") > least_rate, F.col("n_tokens")).otherwise(0)
    bends = [F.sum(free * p[i] * p[j]) for i in range(k) for j in range(i + 1)] if k <= MOST_SCALED else []

    def measured(df: DataFrame) -> tuple[list[float], np.ndarray]:
        found = [float(x or 0) for x in df.agg(*parts, *bends).first()]
        bend = np.zeros((k, k))
        bend[np.tril_indices(k)] = found[k:] or 0.0
        return found[:k], bend + np.tril(bend, -1).T

    at_first = float(max(1.0, least_rate))
    state = members.select(*names, F.lit(at_first).alias("rate"))
    reached, bend = measured(state)
    natural = [x / at_first for x in reached]
    if targets is None:
        targets = [x**temper for x in natural]
    whole = sum(targets)
    goal = [t / whole * sum(natural) if whole else 0.0 for t in targets]
    if least_rate > 0:  # no document may be lost: enough tokens that every domain's mean rate is above that
        up = max((least_rate * SLACK * x / g for x, g in zip(natural, goal, strict=True) if g > 0), default=1.0)
        goal = [g * up for g in goal]
    residual = lambda now: [(r - g) / x if x > 0 else 0.0 for r, g, x in zip(now, goal, natural, strict=True)]
    error = lambda now: sum(e * e * x for e, x in zip(residual(now), natural, strict=True))
    far = lambda now: max((abs(r - g) / max(g, 1.0) for r, g, x in zip(now, goal, natural, strict=True) if x > 0), default=0.0)
    errors, pace, held = [error(reached)], 1.0 if bends else 0.0, []
    while far(reached) >= TOLERANCE and not (len(errors) > PATIENCE and errors[-1] > 0.8 * errors[-1 - PATIENCE]):
        step = residual(reached)
        if pace >= SHORTEST:
            gap = [r - g if x > 0 else 0.0 for r, g, x in zip(reached, goal, natural, strict=True)]
            step = list(pace * np.linalg.solve(bend + np.diag([1e-6 * x if x > 0 else 1.0 for x in natural]), gap))
        pull = sum((x * F.lit(float(e)) for x, e in zip(p, step, strict=True)), F.lit(0.0))
        moved = state.select(*names, F.greatest(F.lit(float(least_rate)), F.col("rate") - pull).alias("rate"))
        now, bend_now = measured(moved)
        if pace >= SHORTEST and error(now) >= errors[-1]:
            pace /= 2  # too far; the plain step never is, since memberships add up to one
            continue
        state, reached, bend, pace = moved, now, bend_now, min(1.0, pace * 4)
        errors.append(error(reached))
        if len(errors) % HELD == 0:
            state = checkpoint(state)
            held.append(state)
    done = checkpoint(state)
    release(*held)
    return done, goal, reached


def mix(docs: DataFrame, table: DataFrame, targets: dict[str, float] | None = None, least_rate: float = 0.0, temper: float = 0.5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_tokens, posteriors: map, rate, copies), one row per input row.

    targets gives each domain's weight; by default a domain gets its own tokens to the power ``temper``, which lifts the
    small ones; a weight of a domain that the labelled rows do not hold is an error. copies is the rate rounded up or down by a hash of id and text, so that its expectation is the rate and
    every run gives the same. Null and empty text have no tokens and the prior as posteriors. Repeated rows get equal
    rates. An empty table gives an empty result, no labelled rows one domain.
    """
    members, model = rated(docs, table, targets, least_rate, temper, id_col, text_col)
    posteriors = F.create_map(*(x for k, d in enumerate(model.domains) for x in (F.lit(d), F.col(f"p{k}"))))
    return members.select("doc_id", "n_tokens", posteriors.alias("posteriors"), "rate", "copies")


def rated(docs, table, targets, least_rate, temper, id_col="doc_id", text_col="text") -> tuple[DataFrame, Classifier]:
    model = train(table)
    if unknown := sorted({*(targets or {})} - {*model.domains}):
        raise ValueError(f"no labelled rows of the domains {unknown}, so their targets cannot be met")
    members = checkpoint(memberships(docs, model, id_col, text_col))
    weights = None if targets is None else [float(targets.get(d, 0.0)) for d in model.domains]
    members, goal, reached = fit(members, len(model.domains), weights, least_rate, temper)
    for d, g, r in zip(model.domains, goal, reached, strict=True):
        met = abs(r - g) <= 10 * TOLERANCE * max(g, 1.0)
        LOG.log(logging.INFO if met else logging.WARNING, "domain %s: target %.1f tokens, reached %.1f", d, g, r)
    toss = F.pmod(F.xxhash64("d", "t", F.lit("copies")), F.lit(1 << 30)) / float(1 << 30)
    return members.withColumn("copies", F.floor("rate") + F.when(toss < F.col("rate") - F.floor("rate"), 1).otherwise(0)), model


def mixed(docs: DataFrame, table: DataFrame, targets: dict[str, float] | None = None, least_rate: float = 1.0, temper: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs, each as often as its copies say; with least_rate=1 no row is lost, only repeated.

    Columns pass through, whatever their names. Null and empty texts, which have no tokens to mix, keep the rate that
    their prior gives them; rows that repeat id and text are copied alike; a null id is an id of its own. An empty
    table gives an empty result.
    """
    members, _ = rated(docs, table, targets, least_rate, temper, id_col, text_col)
    copies = members.groupBy("d", "t").agg(F.max("copies").alias("copies"))
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    keyed = docs.select(F.coalesce(F.col(f"`{id_col}`").cast("long"), F.lit(NO_ID)).alias("d"), F.xxhash64(text).alias("t"), F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"))
    many = keyed.join(copies, ["d", "t"]).where("copies > 0")
    return many.select("row", F.explode(F.sequence(F.lit(1).cast("long"), "copies")).alias("copy")).select(*(F.col("row")[c].alias(c) for c in docs.columns))
