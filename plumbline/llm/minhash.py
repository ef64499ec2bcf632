"""Near-duplicates by DartMinHash signatures, banded joining and exact verification.

Each shingle of five words owns a region of unit height per unit of its weight, which is how often it occurs. Darts hit a region as a Poisson process
along the rank axis, drawn from hashes of the shingle alone, so equal shingles of any two documents catch equal darts.
A document looks at no rank beyond what fills its coordinates (its total weight sets the bound), which most shingles
never reach: the cost is one hash a shingle and k log k darts a document. The earliest dart of each of k coordinates is
the signature; two signatures agree at a coordinate with the (weighted) Jaccard similarity as probability.

Texts with equal words are one node. Nodes that share a band are candidates: each is compared with the hub of
its bucket (the member with most company), exactly, on whole shingle sets. Two members that are both similar to the
hub are of one class already; for the others ``_across`` draws exactly those pairs that can still be similar, by what
they share beyond the hub. So a bucket costs about as many comparisons as it has members, and no link is lost to it.
All buckets, components and counts are DataFrames.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import checkpoint, give_back, id_text, join_counted, release, sole, texts

WORDS, SIMILARITY = 5, 0.8
#: 20 bands of 4: a pair of similarity 0.8 shares none with probability 3e-5.
BANDS, ROWS = 20, 4
C1, C2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)
CHUNK_WORDS, MEMO_SIZE = 100_000, 1 << 17
#: Up to so many texts that share a band (40 bytes each) are named to the scan of the texts by broadcast.
BROADCAST_NODES = 200_000


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * C2
    x = (x ^ (x >> np.uint64(32))) * C2
    return x ^ (x >> np.uint64(32))


class _Words(dict):
    def __missing__(self, word: str) -> int:
        if len(self) >= MEMO_SIZE:
            self.clear()
        self[word] = out = xxhash.xxh3_64_intdigest(word.encode("utf-8", "surrogatepass"))
        return out


_WORDS = _Words()


def forget_words() -> None:
    _WORDS.clear()


def words_of(text: str) -> list[str]:
    return text.lower().split()


def shingles(words: list[str]) -> np.ndarray:
    """Hashes of all runs of five words, repeated ones included; of all words if there are fewer."""
    if not words:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(_WORDS.__getitem__, words), np.uint64, len(words))
    size = min(WORDS, len(words))
    out = h[: len(h) - size + 1] * C1
    for i in range(1, size):
        out = (mix(out) ^ h[i : len(h) - size + 1 + i]) * C1
    return mix(out + np.uint64(size))


def layers(elements: np.ndarray, weights: str) -> np.ndarray:
    """The unit regions: "set" gives each element one, "count" one for each time that it occurs."""
    if weights == "set":
        return elements
    order = np.argsort(elements, kind="stable")
    own = elements[order]
    first = np.flatnonzero(np.r_[True, own[1:] != own[:-1]])
    nth = np.arange(len(own)) - np.repeat(first, np.diff(np.r_[first, len(own)]))
    return mix(own + nth.astype(np.uint64) * C1)


def signatures(regions: list[np.ndarray], k: int = BANDS * ROWS) -> np.ndarray:
    """One row of k dart numbers for each document; documents without regions get zeros."""
    sizes = np.array([len(r) for r in regions])
    out = np.zeros((len(regions), k), np.uint64)
    filled = np.zeros((len(regions), k), bool)
    bound = np.where(sizes > 0, (math.log(k) + 2) / np.maximum(sizes, 1), 0.0)
    missing = np.flatnonzero(sizes)
    while len(missing):
        element = np.concatenate([regions[i] for i in missing])
        doc = np.repeat(missing, sizes[missing])
        rank, found = np.zeros(len(element)), []
        draw = 1
        while len(element):
            dart = mix(element + np.uint64(draw * int(C1) % 2**64))
            rank = rank - np.log(((dart >> np.uint64(11)).astype(np.float64) + 1.0) * 2.0**-53) / k
            near = rank < bound[doc]
            element, doc, rank, dart = element[near], doc[near], rank[near], dart[near]
            found.append((doc, rank, dart))
            draw += 1
        doc, rank, dart = (np.concatenate(x) for x in zip(*found, strict=True))
        last_wins = np.argsort(-rank, kind="stable")
        doc, dart = doc[last_wins], dart[last_wins]
        coordinate = (mix(dart) % np.uint64(k)).astype(np.int64)
        out[doc, coordinate] = dart
        filled[doc, coordinate] = True
        missing = missing[~filled[missing].all(axis=1)]
        bound[missing] *= 2
    return out


def bands(signature: np.ndarray) -> np.ndarray:
    """BANDS bucket numbers for each row of a signature array."""
    parts = signature.reshape(len(signature), BANDS, -1)
    out = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64) * C1, parts.shape[:2])
    for i in range(parts.shape[2]):
        out = mix((out ^ parts[:, :, i]) * C1)
    return out.view(np.int64)


def _signed(weights: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sole("minhash", forget_words)

        def done(ids, hashes, nodes, regions):
            found = bands(signatures(regions))
            lists = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *(BANDS if len(r) else 0 for r in regions)]), pa.int32()), pa.array(found[[len(r) > 0 for r in regions]].ravel(), pa.int64()))
            return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(hashes, pa.int64()), pa.array(nodes, pa.binary()), lists], ["doc_id", "th", "node", "bands"])

        for batch in batches:
            ids, hashes, nodes, regions, size = [], [], [], [], 0
            for doc_id, th, text in zip(batch.column("doc_id").to_pylist(), batch.column("th").to_pylist(), texts(batch), strict=True):
                words = words_of(text)
                ids.append(doc_id)
                hashes.append(th)
                nodes.append(xxhash.xxh3_128_digest(" ".join(words).encode("utf-8", "surrogatepass")))
                regions.append(layers(shingles(words), weights))
                size += len(words)
                if size >= CHUNK_WORDS:
                    yield done(ids, hashes, nodes, regions)
                    ids, hashes, nodes, regions, size = [], [], [], [], 0
            if ids:
                yield done(ids, hashes, nodes, regions)
        ids, hashes, nodes, regions = [], [], [], []
        forget_words()
        give_back()

    return run


def _sets(weights: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sole("minhash", forget_words)
        for whole in batches:
            for start in range(0, whole.num_rows, 200):
                batch = _own_text(whole.slice(start, 200))
                found = [np.unique(layers(shingles(words_of(text)), weights)).view(np.int64) for text in texts(batch)]
                lists = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, found)]), pa.int32()), pa.array(np.concatenate(found) if found else [], pa.int64()))
                yield pa.RecordBatch.from_arrays([batch.column("node"), lists], ["node", "items"])
        forget_words()
        give_back()

    return run


def _own_text(batch: pa.RecordBatch) -> pa.RecordBatch:
    """The rows whose text is the node's: a short hash may name several."""
    own = [xxhash.xxh3_128_digest(" ".join(words_of(text)).encode("utf-8", "surrogatepass")) == node for node, text in zip(batch.column("node").to_pylist(), texts(batch), strict=True)]
    return batch.filter(pa.array(own, pa.bool_()))


def components(edges: DataFrame) -> DataFrame:
    """(node, label) of the connected components of (a, b) edges: label is the component's least node.

    Labels fall to the least label among neighbours and then jump to the label of their label, until none changes. Each
    step is checkpointed, so a lost executor repeats one step, and the files of the step before are deleted. Nodes of
    many neighbours and labels of many nodes are joined apart.
    """
    edges = edges.select(F.col("a").alias("node"), F.col("b").alias("other")).union(edges.select(F.col("b").alias("node"), F.col("a").alias("other"))).distinct()
    edges = checkpoint(edges)
    total = edges.count()
    labels = checkpoint(edges.groupBy("node").agg(F.min("other").alias("label"), F.count(F.lit(1)).alias("degree")).select("node", F.least("node", "label").alias("label"), "degree"))
    while True:
        theirs = labels.select(F.col("node").alias("other"), F.col("label").alias("theirs"), "degree")
        heard = join_counted(edges, theirs, ["other"], "degree", total).groupBy("node").agg(F.min("theirs").alias("theirs"))
        lower = checkpoint(labels.join(heard, "node").select("node", F.least("label", "theirs").alias("next"), F.col("label").alias("before"), "degree"))
        top = labels.select(F.col("node").alias("next"), F.col("label").alias("top")).join(lower.groupBy("next").agg(F.count(F.lit(1)).alias("c")), "next")
        raised = join_counted(lower, top, ["next"], "c", total).select("node", F.least("next", "top").alias("label"), "degree", (F.least("next", "top") != F.col("before")).alias("moved"))
        before, labels = labels, checkpoint(raised)
        release(before, lower)
        if labels.where("moved").isEmpty():
            return labels.select("node", "label")
        labels = labels.select("node", "label", "degree")


def _with_items(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    items = lambda name: sets.select(F.col("node").alias(name), F.col("items").alias(f"{name}_items"))
    return pairs.join(items("a"), "a").where(F.size("a_items") > 0).join(items("b"), "b")


def _similar(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """(a, b, linked) of (a, b) pairs: whether their sets are similar enough."""
    n, m = F.size("a_items"), F.size("b_items")
    common = F.size(F.array_intersect("a_items", "b_items"))
    linked = F.when(F.least(n, m) < similarity * F.greatest(n, m), F.lit(False)).otherwise(common >= similarity * (n + m - common) - 1e-9)
    return _with_items(pairs, sets).select("a", "b", linked.alias("linked"))


def _across(checked: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """(a, b) pairs of one hub that may be similar although one of them is not similar to the hub.

    Let E(x) be what x and the hub do not share, c = (1 - s) / (1 + s). A pair is similar if |x| and |y| are at least
    1 / c times the size of their symmetric difference, which is |E(x)| + |E(y)| - 2 |E(x) & E(y)|. If x is not similar
    to the hub, |E(x)| > c (|x| + |hub|), so y must share at least t = (|E(y)| - c (|y| - |hub|)) / 2 of its elements
    of E(y) with E(x), about half. One of them is then among the |E(y)| - t + 1 rarest of E(y): only these are looked
    up in the sets E(x) of the unlike, and where they meet at their first common element, what is left of both sets must
    still hold (|E(x)| - c |x| + |E(y)| - c |y|) / 2. Edits of one's own are rarest of all, so copies with chance edits
    meet nobody.
    """
    c = (1 - similarity) / (1 + similarity)
    groups = checked.groupBy("b").agg(F.count(F.lit(1)).alias("n"), F.min("linked").alias("all")).where("n > 1 and not all").select("b")
    own = _with_items(checked.join(groups, "b"), sets)
    edits = F.concat(F.array_except("a_items", "b_items"), F.array_except("b_items", "a_items"))
    size = F.size("edits")
    own = own.select("a", "b", "linked", F.size("a_items").alias("na"), F.size("b_items").alias("nb"), edits.alias("edits"))
    t = F.ceil((size - c * (F.col("na") - F.col("nb"))) / 2 - 1e-9)
    own = checkpoint(own.select("a", "b", "linked", size.alias("size"), (size - c * F.col("na")).alias("excess"), (size - F.greatest(t, F.lit(1)) + 1).alias("most"), F.explode("edits").alias("e")))
    df = own.groupBy("b", "e").agg(F.count(F.lit(1)).alias("df"))
    ranked = own.join(df, ["b", "e"]).withColumn("rank", F.row_number().over(Window.partitionBy("a", "b").orderBy("df", "e"))).where("df > 1")
    # What a side can still share from its element at this rank on.
    ranked = checkpoint(ranked.select("a", "b", "e", "linked", "excess", "most", "rank", (F.col("size") - F.col("rank") + 1).alias("rest")))
    release(own)
    y = ranked.where("rank <= most").select("b", "e", F.col("a").alias("y"), F.col("excess").alias("y_excess"), F.col("rest").alias("y_rest"))
    x = ranked.where("not linked").select("b", "e", F.col("a").alias("x"), F.col("excess").alias("x_excess"), F.col("rest").alias("x_rest"))
    enough = F.least("x_rest", "y_rest") >= (F.col("x_excess") + F.col("y_excess")) / 2 - 1e-9
    return y.join(x, (y.b == x.b) & (y.e == x.e) & (F.col("x") != F.col("y")) & enough).select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = SIMILARITY, weights: str = "count") -> DataFrame:
    """(doc_id, class_id, class_size, kept, text_hash), one row per input row.

    A class is a connected component of texts with at least that weighted Jaccard similarity of their lower-case
    five-word shingles, each weighing as often as it occurs ("count") or the same ("set"). class_id is its least doc_id;
    kept is true for one text of it: that of the least id, a null one last, and then of the least text_hash (xxhash64 of
    the text), so that rows which repeat both are all kept. Texts of fewer than five words are near only to equal ones;
    empty and null texts are equal to each other. class_id is null only where all ids of the class are. Other columns
    are not read. An empty table gives an empty result.
    """
    docs = id_text(docs, id_col, text_col).withColumn("th", F.xxhash64("text"))
    signed = checkpoint(docs.mapInArrow(_signed(weights), "doc_id long, th long, node binary, bands array<long>"))
    # Ids in order, null last: the first row of a node stands for it.
    place = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "th")
    nodes = checkpoint(signed.groupBy("node").agg(F.min(place).alias("first"), F.first("bands").alias("bands"), F.count(F.lit(1)).alias("c")))
    rows = nodes.select("node", F.explode("bands").alias("bucket"))
    shared = rows.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    members = checkpoint(rows.join(shared, "bucket").select("bucket", "node", "n"))
    weights_ = members.groupBy("node").agg(F.sum("n").alias("weight"))
    hubs = members.join(weights_, "node").groupBy("bucket").agg(F.max(F.struct("weight", "node")).alias("top")).select("bucket", F.col("top.node").alias("hub"))
    stars = members.join(hubs, "bucket").where("node <> hub").select(F.col("node").alias("a"), F.col("hub").alias("b")).distinct()
    wanted = members.select("node").distinct()
    one = checkpoint(nodes.join(wanted, "node", "left_semi").select("node", F.coalesce("first.doc_id", F.lit(-1)).alias("one_id"), F.col("first.th").alias("one_th")))
    one = F.broadcast(one) if one.count() <= BROADCAST_NODES else one.hint("shuffle_hash")
    read = docs.join(one, (F.coalesce(docs.doc_id, F.lit(-1)) == F.col("one_id")) & (docs.th == F.col("one_th"))).select("node", "text")
    # A hash may name several texts: each is hashed again in full, and only the one that belongs to the node counts.
    sets = read.mapInArrow(_sets(weights), "node binary, items array<long>")
    sets = checkpoint(sets.groupBy("node").agg(F.first("items").alias("items")))
    checked = checkpoint(_similar(stars, sets, similarity))
    links = checked.where("linked").select("a", "b")
    more = checkpoint(_similar(_across(checked, sets, similarity), sets, similarity).where("linked").select("a", "b"))
    release(sets, members)  # what is left to do reads links, nodes and rows only
    labels = components(links.union(more))
    # Classes are made up of nodes, so that a text of many copies is one row until the last join.
    classed = checkpoint(nodes.join(labels, "node", "left").select("node", "first", "c", F.coalesce("label", "node").alias("class")))
    sizes = classed.groupBy("class").agg(F.min("first").alias("kept"), F.sum("c").alias("class_size"), F.count(F.lit(1)).alias("n"))
    total = signed.count()
    known = join_counted(classed.select("node", "class", "c"), sizes, ["class"], "n", total).select("node", "kept", "class_size", "c")
    own = join_counted(signed.select("doc_id", "th", "node"), known, ["node"], "c", total)
    return own.select("doc_id", F.col("kept.doc_id").alias("class_id"), "class_size", (F.col("doc_id").eqNullSafe(F.col("kept.doc_id")) & (F.col("th") == F.col("kept.th"))).alias("kept"), F.col("th").alias("text_hash"))
