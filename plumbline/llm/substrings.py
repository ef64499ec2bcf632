"""Suffix-array deduplication by a common-prefix-aware distributed merge sort.

Every byte under a 100-byte string that also starts earlier is removed. Not every suffix need be sorted for that: each
100-byte window is represented by the suffix that starts at its anchor, the window's leftmost 8-byte gram of least hash
among the first 51. Equal windows have equal anchors, so a sparse suffix array over anchors (one byte in 26) loses none.

1. Candidates. Every task sends the Golomb-coded 48-bit hashes of the 50 bytes behind its anchors to owners, who mark
   the repeated ones in a bit array of fixed size. It is a filter: a saturated one lets more through, never less.
2. Runs. Candidate suffixes (100 bytes rightwards, then 50 leftwards as tie-breakers) are sorted in each task. A suffix
   equal to an earlier one of its run is resolved at once; the others go, front-coded, to the owner of their range.
3. Merge. A loser tree combines the runs. Each head carries its common prefix with the last winner; heads with unlike
   prefixes are ordered by these numbers alone and equal prefixes are compared only from their end on, so no byte known
   to be equal is read again. The prefix lengths also tell which neighbours are equal (all but the earliest go) and
   which share at least 50 bytes: within such a group every offset of a window is settled by the earliest occurrence.
4. A group too large for a task, or with an anchor seen in very many tasks, is spread over tasks and settled by an
   aggregation over its windows instead, which Spark can split.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpoint, id_text, shuffle_partitions
from .exact_dedup import golomb_decode, golomb_encode

#: Bytes of a duplicate string, of a gram, grams among which the anchor is chosen, bytes surely shared behind it.
LENGTH, GRAM, CHOICE = 100, 8, 51
SHARED, LEFT = LENGTH - CHOICE + 1, CHOICE - 1
#: 6 bytes of hash, the suffix, what stands before it (reversed), both lengths.
KEY = 6 + LENGTH + LEFT + 2
POSITION = np.uint64((1 << 27) - 1)
C1, C2, C3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
CHUNK, RUN, BATCH, MOST_IN_TASK = 1 << 20, 150_000, 20_000, 200_000
#: Bytes of keys, before front coding, that one target merges.
TARGET_BYTES = 64 << 20
#: Hashes that may be spread from the start; groups beyond this list are spread when they outgrow a task.
MOST_HOT = 1 << 16
NO_ID = np.iinfo(np.int64).max


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(bytes, starts of documents with the end, ids, text hashes) of about CHUNK bytes."""
    parts, size, ids, hashes = [], 0, [], []

    def done():
        data = np.frombuffer(b"".join(parts) + bytes(64), np.uint8)
        return data, np.cumsum([0, *map(len, parts)]), np.array(ids, np.int64), np.array(hashes, np.int64)

    for batch in batches:
        for doc_id, th, text in zip(batch.column("doc_id").to_pylist(), batch.column("th").to_pylist(), batch.column("text"), strict=True):
            data = (text.as_py() or "").encode("utf-8", "surrogatepass")
            if len(data) < LENGTH:
                continue
            parts.append(data)
            ids.append(NO_ID if doc_id is None else doc_id)
            hashes.append(th)
            size += len(data)
            if size >= CHUNK:
                yield done()
                parts, size, ids, hashes = [], 0, [], []
    if parts:
        yield done()


def _anchors(data: np.ndarray, starts: np.ndarray):
    """(anchor, first window, last window, 48-bit hash of the SHARED bytes behind the anchor) over one chunk."""
    n = int(starts[-1])
    if n > int(POSITION) + 1:
        raise ValueError(f"a chunk of {n} bytes: positions are packed for {int(POSITION) + 1} at most, so a text may not be longer")
    grams = np.ndarray((n,), "<u8", data, 0, (1,))
    h = grams * C1
    h ^= h >> np.uint64(29)
    h *= C2
    h ^= h >> np.uint64(32)
    least = (h & ~POSITION) | np.arange(n, dtype=np.uint64)
    for step in (1, 2, 4, 8, 16):
        least = np.minimum(least[:-step], least[step:])
    least = np.minimum(least[: -(CHOICE - 32)], least[CHOICE - 32 :])
    mark = np.zeros(n + 1, np.int8)
    mark[starts[:-1]] = 1
    mark[starts[1:] - LENGTH + 1] -= 1
    window = np.flatnonzero(np.cumsum(mark[:-1], dtype=np.int8))
    at = (least[window] & POSITION).astype(np.int64)
    first = np.flatnonzero(np.diff(at, prepend=-1))
    last = np.r_[first[1:], len(at)] - 1
    anchor = at[first]
    x = np.zeros(len(anchor), np.uint64)
    for off in (*range(0, SHARED - GRAM + 1, GRAM), SHARED - GRAM):
        x = (x ^ h[anchor + off]) * C3
        x ^= x >> np.uint64(31)
    return anchor, window[first], window[last], x >> np.uint64(16)


def _candidate_messages(owners: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = [np.empty(0, np.uint64)]
        for data, starts, _, _ in _chunks(batches):
            found.append(_anchors(data, starts)[3])
        values, counts = np.unique(np.concatenate(found), return_counts=True)
        owner = (values * np.uint64(owners)) >> np.uint64(48)
        rows = []
        cuts = np.flatnonzero(np.diff(owner)) + 1
        for v, c in zip(np.split(values, cuts), np.split(counts, cuts), strict=True):
            if len(v):
                rows.append((int((v[0] * np.uint64(owners)) >> np.uint64(48)), len(v), *golomb_encode(v), np.packbits(c > 1).tobytes()))
        columns = list(zip(*rows, strict=True)) if rows else [[]] * 7
        kinds = (pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.binary())
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], ["owner", "n", "first", "k", "unary", "rest", "twice"])

    return run


def _mark(owners: int, bits: int, hot_tasks: int):
    """An owner's slice of the bit array, and the hashes that most tasks hold (more than hot_tasks of them)."""

    def run(own: pd.DataFrame) -> pd.DataFrame:
        lists, twice = [], []
        for m in own.itertuples():
            lists.append(golomb_decode(m.n, int(m.first), m.k, m.unary, m.rest))
            twice.append(lists[-1][np.unpackbits(np.frombuffer(m.twice, np.uint8))[: m.n].astype(bool)])
        values, counts = np.unique(np.concatenate(lists), return_counts=True)
        dup = np.concatenate([values[counts > 1], *twice])
        owner, width = int(own.owner.iloc[0]), (1 << bits) // owners
        field = np.zeros(width, bool)
        field[(dup >> np.uint64(48 - bits)).astype(np.int64) - owner * width] = True
        wide = np.argsort(-counts, kind="stable")[: max(1, MOST_HOT // owners)]
        candidates = int(counts[counts > 1].sum()) + sum(map(len, twice))
        return pd.DataFrame({"owner": [owner], "n": [candidates], "bits": [zstandard.compress(np.packbits(field).tobytes(), 1)], "hot": [values[wide[counts[wide] > hot_tasks]].tobytes()]})

    return run


def _front_code(keys: np.ndarray, lcp: np.ndarray) -> bytes:
    lcp = lcp.copy()
    lcp[0] = 0
    return zstandard.compress(lcp.astype(np.uint8).tobytes() + keys[np.arange(KEY)[None, :] >= lcp[:, None]].tobytes(), 1)


def _common(keys: np.ndarray) -> np.ndarray:
    """Common prefix of each row with the row before; 0 for the first."""
    unlike = keys[1:] != keys[:-1]
    out = unlike.argmax(axis=1)
    out[~unlike.any(axis=1)] = KEY
    return np.r_[0, out]


META = np.dtype([("doc", "<i8"), ("th", "<i8"), ("pos", "<i4"), ("lo", "u1"), ("hi", "u1")])
SPAN = np.dtype([("doc", "<i8"), ("th", "<i8"), ("s", "<i4"), ("e", "<i4")])


def _runs(targets: int, field, bits: int, hot_values):
    def emit(keys: np.ndarray, meta: np.ndarray, part: int) -> Iterator[tuple]:
        order = np.lexsort((meta["pos"], meta["th"], meta["doc"]))
        keys, meta = keys[order], meta[order]
        order = np.argsort(np.ascontiguousarray(keys).view(f"S{KEY}").ravel(), kind="stable")
        keys, meta = keys[order], meta[order]
        lcp = _common(keys)
        new = lcp < KEY
        spans = np.empty(int((~new).sum()), SPAN)
        gone = meta[~new]
        spans["doc"], spans["th"], spans["s"], spans["e"] = gone["doc"], gone["th"], gone["pos"] - gone["hi"], gone["pos"] - gone["lo"] + LENGTH
        if len(spans):
            yield part % targets, 1, 0, b"", zstandard.compress(_joined(spans).tobytes(), 1)
        keys, meta, lcp = keys[new], meta[new], lcp[new]
        h48 = (keys[:, :6].astype(np.uint64) << np.arange(40, -1, -8, dtype=np.uint64)).sum(axis=1, dtype=np.uint64)
        hot = np.isin(h48, hot_values) if len(hot_values) else np.zeros(len(h48), bool)
        if hot.any():
            spread = np.zeros(int(hot.sum()), np.uint64)
            for column in keys[hot].T[6:]:
                spread = (spread ^ column) * C3
                spread ^= spread >> np.uint64(31)
            to = (spread % np.uint64(targets)).astype(np.int64)
            for target in np.unique(to):
                own = np.flatnonzero(hot)[to == target]
                yield int(target), 2, len(own), _front_code(keys[own], _common(keys[own])), zstandard.compress(meta[own].tobytes(), 1)
            keys, meta, h48 = keys[~hot], meta[~hot], h48[~hot]
            lcp = _common(keys) if len(keys) else lcp[:0]
        to = ((h48 * np.uint64(targets)) >> np.uint64(48)).astype(np.int64)
        edges = np.r_[0, np.flatnonzero(np.diff(to)) + 1, len(to)] if len(to) else [0]
        for a, b in zip(edges[:-1], edges[1:], strict=True):
            yield int(to[a]), 0, int(b - a), _front_code(keys[a:b], lcp[a:b]), zstandard.compress(meta[a:b].tobytes(), 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, held, metas, count = TaskContext.get().partitionId(), [], [], 0
        marked = np.frombuffer(field.value, np.uint8)

        def flush():
            rows = list(emit(np.concatenate(held), np.concatenate(metas), part))
            kinds = (pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.binary())
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], ["target", "kind", "n", "keys", "meta"])

        for data, starts, ids, hashes in _chunks(batches):
            anchor, lo, hi, h48 = _anchors(data, starts)
            bit = (h48 >> np.uint64(48 - bits)).astype(np.int64)
            picked = np.flatnonzero(marked[bit >> 3] >> (7 - (bit & 7)).astype(np.uint8) & 1)
            if not len(picked):
                continue
            anchor, lo, hi, h48 = anchor[picked], lo[picked], hi[picked], h48[picked]
            doc = np.searchsorted(starts, anchor, "right") - 1
            right, left = np.minimum(starts[doc + 1] - anchor, LENGTH), np.minimum(anchor - starts[doc], LEFT)
            keys = np.empty((len(anchor), KEY), np.uint8)
            keys[:, :6] = (h48[:, None] >> np.arange(40, -1, -8, dtype=np.uint64)).astype(np.uint8)
            steps = np.arange(LENGTH)
            keys[:, 6 : 6 + LENGTH] = np.where(steps < right[:, None], data[anchor[:, None] + steps], 0)
            steps = np.arange(LEFT)
            keys[:, 6 + LENGTH : -2] = np.where(steps < left[:, None], data[np.maximum(anchor[:, None] - 1 - steps, 0)], 0)
            keys[:, -2], keys[:, -1] = right, left
            meta = np.empty(len(anchor), META)
            meta["doc"], meta["th"], meta["pos"], meta["lo"], meta["hi"] = ids[doc], hashes[doc], anchor - starts[doc], anchor - hi, anchor - lo
            held.append(keys)
            metas.append(meta)
            count += len(keys)
            if count >= RUN:
                yield flush()
                held, metas, count = [], [], 0
        if count:
            yield flush()

    return run


def _joined(spans: np.ndarray) -> np.ndarray:
    """Overlapping and touching spans of a document as one."""
    if not len(spans):
        return spans
    spans = spans[np.lexsort((spans["s"], spans["th"], spans["doc"]))]
    other = np.r_[True, (spans["doc"][1:] != spans["doc"][:-1]) | (spans["th"][1:] != spans["th"][:-1])]
    doc = np.cumsum(other)
    reach = np.maximum.accumulate(spans["e"].astype(np.int64) + doc * (1 << 32)) - doc * (1 << 32)
    first = np.flatnonzero(other | np.r_[True, spans["s"][1:] > reach[:-1]])
    out = spans[first]
    out["e"] = reach[np.r_[first[1:], len(spans)] - 1]
    return out


def merge_runs(runs: list[tuple[np.ndarray, bytes]]) -> Iterator[tuple[int, bytes, int, int]]:
    """(common prefix with the key before, key, run, place in the run) in order, from front-coded sorted runs.

    A loser tree: each loser keeps its common prefix with the key that beat it, which is the last output whenever its
    match is replayed. Ties go to the run that comes first.
    """
    k = len(runs)
    lcps = [r[0].tolist() for r in runs]
    data = [r[1] for r in runs]
    at, place, keys, head = [KEY] * k, [0] * k, [d[:KEY] for d in data], [0] * k

    def common(a: bytes, b: bytes, i: int) -> int:
        while i < KEY:
            j = i + 16
            if a[i:j] == b[i:j]:
                i = j
                continue
            while a[i] == b[i]:
                i += 1
            return i
        return KEY

    tree = [-1] * max(k, 1)
    for leaf in range(k):
        c, node = leaf, (k + leaf) // 2
        while node:
            if tree[node] < 0:
                tree[node] = c
                c = -1
                break
            o = tree[node]
            if head[c] != head[o]:
                lose = head[c] < head[o]
            else:
                n = common(keys[c], keys[o], head[c])
                lose = (keys[c], c) > (keys[o], o)
                head[c if lose else o] = n
            if lose:
                tree[node], c = c, o
            node //= 2
        if c >= 0:
            tree[0] = c
    winner = tree[0] if k else -1
    while winner >= 0 and keys[winner] is not None:
        c = winner
        yield head[c], keys[c], c, place[c]
        place[c] += 1
        if place[c] < len(lcps[c]):
            n = lcps[c][place[c]]
            end = at[c] + KEY - n
            keys[c], head[c], at[c] = keys[c][:n] + data[c][at[c] : end], n, end
        else:
            keys[c], head[c] = None, -1
        node = (k + c) // 2
        while node:
            o = tree[node]
            a, b = head[c], head[o]
            if a < b:
                tree[node], c = c, o
            elif a == b and a >= 0:
                n = common(keys[c], keys[o], a)
                if n < KEY and keys[c][n] > keys[o][n] or n >= KEY and c > o:
                    head[c] = n
                    tree[node], c = c, o
                else:
                    head[o] = n
            node //= 2
        winner = c


def _hashes(seed: np.ndarray, columns: np.ndarray) -> list[np.ndarray]:
    """Running 64-bit hashes over the columns: after none, after the first, and so on."""
    out = [seed]
    for column in columns.T:
        x = (out[-1] ^ column) * C3
        out.append(x ^ (x >> np.uint64(29)))
    return out


def _settle(keys: np.ndarray, group: np.ndarray, meta: np.ndarray) -> np.ndarray:
    """Spans of windows with an earlier equal one, among contexts of which those of a group share SHARED bytes."""
    order = np.lexsort((meta["pos"], meta["th"], meta["doc"]))
    keys, group, meta = keys[order], group[order], meta[order]
    right = _hashes((group.astype(np.uint64) + np.uint64(1)) * C1, keys[:, 6 + SHARED : 6 + LENGTH])
    left = _hashes(np.full(len(keys), C2), keys[:, 6 + LENGTH : -2])
    late = np.zeros((len(keys), CHOICE + 2), bool)
    for d in range(CHOICE):
        own = np.flatnonzero((meta["lo"] <= d) & (d <= meta["hi"]))
        value = right[LENGTH - d - SHARED][own] ^ (left[d][own] * C1)
        by = np.argsort(value, kind="stable")
        late[own[by[1:][value[by[1:]] == value[by[:-1]]]], d + 1] = True
    edge = np.diff(late.astype(np.int8), axis=1)
    row, first = np.nonzero(edge == 1)
    _, end = np.nonzero(edge == -1)
    spans = np.empty(len(row), SPAN)
    spans["doc"], spans["th"] = meta["doc"][row], meta["th"][row]
    spans["s"], spans["e"] = meta["pos"][row] - (end - 1), meta["pos"][row] - first + LENGTH
    return spans


def _windows(keys: np.ndarray, meta: np.ndarray) -> pd.DataFrame:
    """Each window of the contexts with a 128-bit hash of its bytes."""
    lanes = [(_hashes(np.full(len(keys), s), keys[:, 6 : 6 + LENGTH]), _hashes(np.full(len(keys), s), keys[:, 6 + LENGTH : -2])) for s in (C1, C2)]
    frames = []
    for d in range(CHOICE):
        own = np.flatnonzero((meta["lo"] <= d) & (d <= meta["hi"]))
        if len(own):
            k = [(r[LENGTH - d][own] ^ (l[d][own] * C1) + np.uint64(d)).view(np.int64) for r, l in lanes]
            frames.append(pd.DataFrame({"doc": meta["doc"][own], "th": meta["th"][own], "s": meta["pos"][own] - d, "e": meta["pos"][own] - d + LENGTH, "k1": k[0], "k2": k[1]}))
    return pd.concat(frames, ignore_index=True) if frames else pd.DataFrame({c: [] for c in ("doc", "th", "s", "e", "k1", "k2")})


def _merged(most: int):
    def run(own: pd.DataFrame) -> pd.DataFrame:
        spans = [np.frombuffer(zstandard.decompress(m), SPAN) for m in own.meta[own.kind == 1]]
        open_windows = []
        for kind in (0, 2):
            part = own[own.kind == kind]
            runs, metas = [], []
            for r in part.itertuples():
                data = zstandard.decompress(r.keys)
                runs.append((np.frombuffer(data[: r.n], np.uint8), data[r.n :]))
                metas.append(np.frombuffer(zstandard.decompress(r.meta), META).tolist())
            batch, group, spread = [], [], kind == 2  # (key, group number, meta) of contexts to settle; those of this group
            number, gone = 0, []

            def settle(rows):
                if rows:
                    spans.append(_settle(np.frombuffer(b"".join(r[0] for r in rows), np.uint8).reshape(-1, KEY), np.array([r[1] for r in rows]), np.array([r[2] for r in rows], META)))

            def to_windows(rows):
                if rows:
                    open_windows.append(_windows(np.frombuffer(b"".join(r[0] for r in rows), np.uint8).reshape(-1, KEY), np.array([r[2] for r in rows], META)))

            for lcp, key, which, place in merge_runs(runs):
                meta = metas[which][place]
                if lcp == KEY:
                    if meta < group[-1][2]:
                        meta, group[-1] = group[-1][2], (key, number, meta)
                    gone.append((meta[0], meta[1], meta[2] - meta[4], meta[2] - meta[3] + LENGTH))
                    continue
                if kind == 2:
                    if len(group) >= BATCH:
                        to_windows(group)
                        group = []
                elif lcp < 6 + SHARED:
                    if spread:
                        to_windows(group)
                    elif len(group) > 1:
                        batch += group
                        if len(batch) >= BATCH:
                            settle(batch)
                            batch = []
                    group, spread = [], False
                    number += 1
                elif len(group) >= most:
                    to_windows(group)
                    group, spread = [], True
                group.append((key, number, meta))
            if spread:
                to_windows(group)
            elif len(group) > 1:
                batch += group
            settle(batch)
            if gone:
                spans.append(np.array(gone, SPAN))
        found = _joined(np.concatenate(spans)) if spans else np.empty(0, SPAN)
        out = pd.DataFrame({"doc": found["doc"], "th": found["th"], "s": found["s"], "e": found["e"], "k1": np.int64(0), "k2": np.int64(0), "open": False})
        return pd.concat([out, *(w.assign(open=True) for w in open_windows)], ignore_index=True)[["doc", "th", "s", "e", "k1", "k2", "open"]]

    return run


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for doc_id, text, spans in zip(batch.column("doc_id").to_pylist(), batch.column("text"), batch.column("spans").to_pylist(), strict=True):
            data = (text.as_py() or "").encode("utf-8", "surrogatepass")
            runs: list[list[int]] = []
            for span in sorted((x["s"], x["e"]) for x in spans or ()):
                if runs and span[0] <= runs[-1][1]:
                    runs[-1][1] = max(runs[-1][1], span[1])
                else:
                    runs.append(list(span))
            edges = [0, *(x for r in runs for x in r), len(data)]
            rest = b"".join(data[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True))
            rows.append((doc_id, len(data), len(data) - len(rest), len(runs), [x for r in runs for x in r], hashlib.sha256(rest).hexdigest(), rest))
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int32()), pa.string(), pa.binary())
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True) if rows else [[]] * 7, kinds, strict=True)], ["doc_id", "n_bytes", "n_removed", "n_spans", "removed", "kept_sha256", "kept"])


def suffix_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", filter_bits: int = 26, hot_tasks: int = 256, most_in_task: int = MOST_IN_TASK) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, removed, kept_sha256, kept), one row per input row.

    removed lists start and end of each removed run; kept is the rest, which may cut a character in two. Texts under 100
    bytes, empty and null ones lose nothing. A null id counts as the largest. Rows of one id are ordered by a hash of
    their text; rows that repeat id and text are one document and lose the same. An empty table gives an empty result.
    """
    spark = docs.sparkSession
    docs = id_text(docs, id_col, text_col).withColumn("th", F.xxhash64("text"))
    targets = shuffle_partitions(spark)
    owners = min(1 << filter_bits, 1 << max(0, (targets - 1).bit_length()))
    messages = docs.mapInArrow(_candidate_messages(owners), "owner int, n int, first long, k int, unary binary, rest binary, twice binary")
    slices = messages.groupBy("owner").applyInPandas(_mark(owners, filter_bits, hot_tasks), "owner int, n long, bits binary, hot binary").collect()
    width = (1 << filter_bits) // owners // 8 or 1
    field = bytearray(max(1, (1 << filter_bits) // 8))
    for s in slices:
        field[s.owner * width : (s.owner + 1) * width] = zstandard.decompress(bytes(s.bits))
    hot = np.concatenate([np.empty(0, np.uint64), *(np.frombuffer(bytes(s.hot), np.uint64) for s in slices)])
    shared = spark.sparkContext.broadcast(bytes(field))
    # As many targets as keep what one of them merges, one frame of a task, at about that size.
    targets = max(targets, -(-sum(s.n for s in slices) * KEY // TARGET_BYTES))
    runs = docs.mapInArrow(_runs(targets, shared, filter_bits, hot), "target int, kind int, n int, keys binary, meta binary")
    found = runs.repartition(targets, "target").groupBy("target").applyInPandas(_merged(most_in_task), "doc long, th long, s int, e int, k1 long, k2 long, open boolean")
    found = checkpoint(found)
    windows = found.where("open")
    firsts = windows.groupBy("k1", "k2").agg(F.min(F.struct("doc", "th", "s")).alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").select("k1", "k2", "first")
    late = windows.join(firsts, ["k1", "k2"]).where(F.struct("doc", "th", "s") != F.col("first"))
    spans = found.where("not open").select("doc", "th", "s", "e").unionByName(late.select("doc", "th", "s", "e")).groupBy("doc", "th").agg(F.collect_list(F.struct("s", "e")).alias("spans"))
    joined = docs.withColumn("doc", F.coalesce("doc_id", F.lit(int(NO_ID)))).join(spans, ["doc", "th"], "left").select("doc_id", "text", "spans")
    return joined.mapInArrow(_cut, "doc_id long, n_bytes long, n_removed long, n_spans long, removed array<int>, kept_sha256 string, kept binary")


def digest(found: DataFrame) -> DataFrame:
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
