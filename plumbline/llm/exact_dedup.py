"""Exact deduplication by a Golomb-coded fingerprint exchange.

1. Every input partition hashes its normalised texts and sends each owner (a range of the fingerprint space) one
   message: its sorted distinct fingerprints as Golomb-Rice coded gaps, with a bitmap of those it holds twice.
2. An owner decodes the messages of its range and answers each with a bitmap: which of its fingerprints occur elsewhere.
3. Only texts with a marked fingerprint are suspects. Each partition folds equal suspects into one row, and these rows
   meet, grouped by fingerprint and by the bytes themselves, so a colliding fingerprint never joins different texts.

A group that holds a third of all rows is one row per partition after the local fold, and the last join is an outer
join whose left side may be split by AQE. Nothing is collected on the driver but a row count.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WHITE, checkpoint, id_text, shuffle_partitions, texts

#: An owner gets about this many fingerprints where there are partitions enough, and at most MOST in any case.
PER_OWNER, MOST = 20_000, 4_000_000


def golomb_encode(values: np.ndarray) -> tuple[int, int, bytes, bytes]:
    """Sorted distinct uint64 values as (first, k, unary quotients, k-bit remainders) of their gaps."""
    gaps = np.diff(values)
    if not len(gaps):
        return int(values[0]), 0, b"", b""
    mean = float(gaps.astype(np.float64).mean())
    k = min(62, max(0, int(math.log2(max(1.0, mean * math.log(2))))))
    quotients = (gaps >> np.uint64(k)).astype(np.int64)
    unary = np.zeros(int(quotients.sum()) + len(gaps), np.uint8)
    unary[np.cumsum(quotients + 1) - 1] = 1
    bits = (gaps[:, None] >> np.arange(k - 1, -1, -1, dtype=np.uint64)) & np.uint64(1) if k else np.zeros((0, 0))
    return int(values[0]), k, np.packbits(unary).tobytes(), np.packbits(bits.astype(np.uint8).ravel()).tobytes()


def golomb_decode(n: int, first: int, k: int, unary: bytes, rest: bytes) -> np.ndarray:
    out = np.empty(n, np.uint64)
    out[0] = first
    if n > 1:
        ends = np.flatnonzero(np.unpackbits(np.frombuffer(unary, np.uint8)))[: n - 1]
        gaps = (np.diff(ends, prepend=-1) - 1).astype(np.uint64) << np.uint64(k)
        if k:
            bits = np.unpackbits(np.frombuffer(rest, np.uint8))[: (n - 1) * k].reshape(n - 1, k).astype(np.uint64)
            gaps |= (bits << np.arange(k - 1, -1, -1, dtype=np.uint64)).sum(axis=1, dtype=np.uint64)
        out[1:] = np.uint64(first) + np.cumsum(gaps, dtype=np.uint64)
    return out


def owner_of(values: np.ndarray, owners: int) -> np.ndarray:
    return ((values >> np.uint64(32)) * np.uint64(owners)) >> np.uint64(32)


def by_owner(fingerprints: np.ndarray, owners: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(owner, its sorted distinct fingerprints, whether this partition holds each twice)."""
    values, counts = np.unique(fingerprints, return_counts=True)
    owner = owner_of(values, owners)
    cuts = np.flatnonzero(np.diff(owner)) + 1
    for at, part, n in zip(owner[np.r_[0, cuts]] if len(owner) else [], np.split(values, cuts), np.split(counts, cuts), strict=False):
        yield int(at), part, n > 1


def _fingerprint_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    part = TaskContext.get().partitionId()
    for batch in batches:
        fp, chars, sha = [], [], []
        for text in texts(batch):
            norm = text.encode("utf-8", "surrogatepass").translate(None, WHITE)
            fp.append(xxhash.xxh3_64_intdigest(norm) - (1 << 63))
            chars.append(len(text))
            sha.append(hashlib.sha256(norm).hexdigest())
        n = len(fp)
        yield pa.RecordBatch.from_arrays([pa.array([part] * n, pa.int32()), batch.column("doc_id"), pa.array(fp, pa.int64()), pa.array(chars, pa.int64()), pa.array(sha, pa.string())], ["part", "doc_id", "fp", "n_chars", "text_sha256"])


def _unsigned(fp: pd.Series) -> np.ndarray:
    return fp.to_numpy(np.int64).view(np.uint64) ^ np.uint64(1 << 63)


def _messages(owners: int):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[int, list[np.ndarray]] = {}
        for frame in frames:
            for part, own in frame.groupby("part"):
                held.setdefault(int(part), []).append(_unsigned(own.fp))
        for part, own in held.items():
            rows = [(owner, part, len(v), *golomb_encode(v), np.packbits(twice).tobytes()) for owner, v, twice in by_owner(np.concatenate(own), owners)]
            frame = pd.DataFrame(rows, columns=["owner", "part", "n", "first", "k", "unary", "rest", "twice"])
            frame["first"] = frame["first"].astype(np.uint64).to_numpy().view(np.int64) if len(frame) else frame["first"].astype("int64")
            yield frame

    return run


def _answer(messages: pd.DataFrame) -> pd.DataFrame:
    """The bitmap for each message of one owner: bit i is set if its i-th fingerprint is held twice anywhere."""
    lists = [golomb_decode(m.n, int(m.first) & (2**64 - 1), m.k, m.unary, m.rest) for m in messages.itertuples()]
    twice = [np.unpackbits(np.frombuffer(m.twice, np.uint8))[: m.n].astype(bool) for m in messages.itertuples()]
    values, counts = np.unique(np.concatenate(lists), return_counts=True)
    dup = np.union1d(values[counts > 1], np.concatenate([v[t] for v, t in zip(lists, twice, strict=True)]))
    return pd.DataFrame({"owner": messages.owner, "part": messages.part, "bitmap": [np.packbits(np.isin(v, dup, assume_unique=True)).tobytes() for v in lists]})


def _suspects(owners: int):
    def run(own: pd.DataFrame, answers: pd.DataFrame) -> pd.DataFrame:
        bitmaps = dict(zip(answers.owner, answers.bitmap, strict=True))
        found = [v[np.unpackbits(np.frombuffer(bitmaps[owner], np.uint8))[: len(v)].astype(bool)] for owner, v, _ in by_owner(_unsigned(own.fp), owners)] if len(own) else []
        fp = (np.concatenate(found) ^ np.uint64(1 << 63)).view(np.int64) if found else np.empty(0, np.int64)
        return pd.DataFrame({"fp": fp})

    return run


def _folded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per batch and normalised text: its fingerprint, bytes, count, most code points and the id that has them."""
    for batch in batches:
        held: dict[bytes, list] = {}
        for doc_id, text in zip(batch.column("doc_id").to_pylist(), texts(batch), strict=True):
            norm = text.encode("utf-8", "surrogatepass").translate(None, WHITE)
            mine = (-len(text), doc_id is None, doc_id or 0)
            if (old := held.get(norm)) is None:
                held[norm] = [1, mine]
            else:
                old[0] += 1
                old[1] = min(old[1], mine)
        fp = [xxhash.xxh3_64_intdigest(k) - (1 << 63) for k in held]
        best = [v[1] for v in held.values()]
        yield pa.RecordBatch.from_arrays([pa.array(fp, pa.int64()), pa.array(list(held), pa.binary()), pa.array([v[0] for v in held.values()], pa.int64()), pa.array([b[0] for b in best], pa.int64()), pa.array([None if b[1] else b[2] for b in best], pa.int64())], ["fp", "norm", "n", "neg_chars", "doc_id"])


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, keep_id, group_size, kept, text_sha256), one row per input row.

    Null text counts as empty and all empty texts are one group. An id that comes twice is one document: its rows are
    marked alike. A null id loses ties; keep_id is null only if every row of the group has none. An empty table gives
    an empty result; further columns of ``docs`` are not read.
    """
    spark = docs.sparkSession
    docs = id_text(docs, id_col, text_col)
    rows = checkpoint(docs.mapInArrow(_fingerprint_rows, "part int, doc_id long, fp long, n_chars long, text_sha256 string"))
    n = rows.count()
    owners = max(1, min(shuffle_partitions(spark), math.ceil(n / PER_OWNER)), math.ceil(n / MOST))
    messages = rows.select("part", "fp").mapInPandas(_messages(owners), "owner int, part int, n int, first long, k int, unary binary, rest binary, twice binary")
    answers = messages.groupBy("owner").applyInPandas(_answer, "owner int, part int, bitmap binary")
    suspects = rows.select("part", "fp").groupBy("part").cogroup(answers.groupBy("part")).applyInPandas(_suspects(owners), "fp long").distinct()
    folded = docs.mapInArrow(_folded, "fp long, norm binary, n long, neg_chars long, doc_id long")
    groups = (
        folded.join(suspects, "fp", "left_semi")
        .groupBy("fp", "norm")
        .agg(F.sum("n").alias("group_size"), F.min(F.struct("neg_chars", F.col("doc_id").isNull().alias("none"), "doc_id")).alias("best"))
        .select(F.sha2("norm", 256).alias("text_sha256"), "group_size", F.col("best.doc_id").alias("keep_id"))
    )
    joined = rows.select("doc_id", "text_sha256").join(groups, "text_sha256", "left")
    keep = F.when(F.col("group_size").isNull(), F.col("doc_id")).otherwise(F.col("keep_id"))
    return joined.select("doc_id", keep.alias("keep_id"), F.coalesce("group_size", F.lit(1).cast("long")).alias("group_size"), keep.eqNullSafe(F.col("doc_id")).alias("kept"), "text_sha256")


OP3_SQL = r"""
WITH d AS (SELECT doc_id, length(coalesce(text, '')) AS n, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS norm FROM documents),
g AS (SELECT norm, count(*) AS group_size, arg_min(doc_id, (-n, doc_id)) AS keep_id FROM d GROUP BY norm)
SELECT doc_id, keep_id, CAST(group_size AS BIGINT) AS group_size, doc_id = keep_id AS kept, sha256(norm) AS text_sha256
FROM d JOIN g USING (norm)
"""
