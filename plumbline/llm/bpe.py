"""Byte-level BPE encoding and decoding with a hierarchical-bitmap rank queue.

Pairs wait in one bucket per merge rank; a bucket holds linked-list positions. Two levels of bitmaps say which buckets
have entries: a word of 256 bits for each block of ranks and one word over the blocks. Find-first-set on both gives the
next rank in constant time, entries whose pair has changed meanwhile are skipped when they surface, and a pre-token of
n bytes costs O(n log n) at worst, however long it is.
"""

from __future__ import annotations

import base64
import hashlib
from array import array
from collections.abc import Iterator
from heapq import heappop, heappush
from itertools import pairwise

import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .common import id_text, sole

#: Pre-tokens up to this many characters are remembered; then the bound of known pairs of tokens.
MEMO_CHARS, MOST_PAIRS = 64, 1 << 18
#: Pre-tokens in each of two generations of the memo (some 200 bytes each): those that are met again move to the newer
#: one, the older is dropped as it fills. It changes speed and memory only.
MEMO_SIZE = 1 << 19
BIT = [1 << i for i in range(256)]


def read_ranks(data: bytes) -> dict[bytes, int]:
    return {base64.b64decode(a): int(b) for a, b in (line.split() for line in data.splitlines() if line)}


class Row(dict):
    """What a left token merges to with each right token met so far; -1 if it does not."""

    __slots__ = ("pairs", "left")

    def __init__(self, pairs: Pairs, left: bytes):
        super().__init__()
        self.pairs, self.left = pairs, left

    def __missing__(self, right: int) -> int:
        self.pairs.known += 1
        self[right] = rank = self.pairs.ranks.get(self.left + self.pairs.token[right], -1)
        return rank


class Pairs:
    """A vocabulary with its pairs by left and right token, and the rank queue, which is empty between pre-tokens."""

    def __init__(self, ranks: dict[bytes, int]):
        size = max(ranks.values()) + 1
        self.ranks, self.token, self.known = ranks, [b""] * size, 0
        for token, rank in ranks.items():
            self.token[rank] = token
        self.byte = [ranks[bytes([b])] for b in range(256)]
        self.rows = [Row(self, token) for token in self.token]
        self.buckets: list[list[int] | None] = [None] * size
        self.words = [0] * (size // 256 + 1)

    def bound(self) -> None:
        """Forget the pairs once there are many."""
        if self.known >= MOST_PAIRS:
            self.known = 0
            for row in self.rows:
                row.clear()


def merge(piece: bytes, pairs: Pairs) -> list[int]:
    """The ids of one pre-token: always the pair of lowest rank, leftmost first, as the rank files define it."""
    if (whole := pairs.ranks.get(piece)) is not None:
        return [whole]
    pairs.bound()
    rows, buckets, words, n = pairs.rows, pairs.buckets, pairs.words, len(piece)
    ids = list(map(pairs.byte.__getitem__, piece))
    after, before = list(range(1, n + 1)), list(range(-1, n))
    pair, top = [rows[x][y] for x, y in pairwise(ids)], 0
    for at, rank in enumerate(pair):
        if rank >= 0:
            if (bucket := buckets[rank]) is None:
                buckets[rank] = [at]
                words[rank >> 8] |= BIT[rank & 255]
                top |= 1 << (rank >> 8)
            else:
                bucket.append(at)
    pair.append(-1)
    while top:
        block = (top & -top).bit_length() - 1
        bits = words[block]
        low = bits & -bits
        rank = block << 8 | low.bit_length() - 1
        bucket = buckets[rank]
        if len(bucket) > 1:
            at = heappop(bucket)
        else:
            at, buckets[rank] = bucket[0], None
            words[block] = bits = bits ^ low
            if not bits:
                top ^= 1 << block
        if pair[at] != rank:
            continue  # stale: one side has been merged since
        gone = after[at]
        after[at] = end = after[gone]
        pair[gone], ids[at] = -1, rank
        if end < n:
            before[end] = at
            pair[at] = new = rows[rank][ids[end]]
            if new >= 0:
                if (bucket := buckets[new]) is None:
                    buckets[new] = [at]
                    words[new >> 8] |= BIT[new & 255]
                    top |= 1 << (new >> 8)
                else:
                    heappush(bucket, at)
        else:
            pair[at] = -1
        left = before[at]
        if left >= 0:
            pair[left] = new = rows[ids[left]][rank]
            if new >= 0:
                if (bucket := buckets[new]) is None:
                    buckets[new] = [left]
                    words[new >> 8] |= BIT[new & 255]
                    top |= 1 << (new >> 8)
                else:
                    heappush(bucket, left)
    out, at = [], 0
    while at < n:
        out.append(ids[at])
        at = after[at]
    return out


class Coder:
    """Encodes and decodes with one vocabulary; remembers short pre-tokens, each with its ids as packed bytes."""

    def __init__(self, ranks: dict[bytes, int], pattern: str, memo_size: int = MEMO_SIZE):
        self.pairs, self.split = Pairs(ranks), regex.compile(pattern).findall
        self.bytes_of, self.text_of = self.pairs.token, [str(i) for i in range(len(self.pairs.token))]
        coder, self.older = self, {}

        class Memo(dict):
            def __missing__(self, text: str) -> bytes:
                ids = coder.older.get(text)
                if ids is None:
                    ids = array("I", merge(text.encode("utf-8", "surrogatepass"), coder.pairs)).tobytes()
                if len(text) <= MEMO_CHARS:
                    if len(self) >= memo_size:
                        coder.older = dict(self)
                        self.clear()
                    self[text] = ids
                return ids

        self.memo = Memo()

    def encode(self, text: str) -> list[int]:
        return array("I", b"".join(map(self.memo.__getitem__, self.split(text)))).tolist()

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))

    def joined(self, ids: list[int]) -> str:
        return ",".join(map(self.text_of.__getitem__, ids))


_CODERS: dict[tuple[int, str, int], Coder] = {}


def coder_of(data: bytes, pattern: str, memo_size: int) -> Coder:
    """The worker's own coder, which outlives its tasks. (A task's function would carry a copy of the dict itself.)"""
    sole("bpe", _CODERS.clear)
    key = (hash(data), pattern, memo_size)
    if key not in _CODERS:
        _CODERS.clear()
        _CODERS[key] = Coder(read_ranks(data), pattern, memo_size)
    return _CODERS[key]


def bpe(docs: DataFrame, vocabulary: str | None = None, pattern: str | None = None, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = True, memo_size: int = MEMO_SIZE) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) and, with_ids, the ids themselves; one row per input row.

    vocabulary is the path of a rank file, which the driver reads once; its bytes (under a megabyte) travel with the
    tasks. Null and empty text have no tokens; repeated rows and ids get a row each, null ids included; other columns are
    not read. No shuffle: each text is encoded where it is read, and its ids are then decoded again. memo_size bounds a
    worker's memo of pre-tokens. An empty table gives an empty result.
    """
    if vocabulary is None or pattern is None:
        import public_tokenizers

        vocabulary, pattern = vocabulary or public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), pattern or public_tokenizers.PATTERN
    with open(vocabulary, "rb") as file:
        shared = docs.sparkSession.sparkContext.broadcast(file.read())
    schema = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string()), *[("ids", pa.list_(pa.int32()))] * with_ids])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = coder_of(shared.value, pattern, memo_size)
        for whole in batches:
            for start in range(0, whole.num_rows, 1000):
                batch = whole.slice(start, 1000)
                count, sha, back, kept = [], [], [], []
                for value in batch.column("text"):
                    ids = coder.encode(value.as_py() or "")
                    count.append(len(ids))
                    sha.append(hashlib.sha256(coder.joined(ids).encode()).hexdigest())
                    back.append(hashlib.sha256(coder.decode(ids)).hexdigest())
                    if with_ids:
                        kept.append(pa.array(ids, pa.int32()))
                columns = [batch.column("doc_id"), pa.array(count, pa.int64()), pa.array(sha, pa.string()), pa.array(back, pa.string())]
                if with_ids:
                    ends = [0]
                    for ids in kept:
                        ends.append(ends[-1] + len(ids))
                    columns.append(pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.concat_arrays(kept) if kept else pa.array([], pa.int32())))
                yield pa.RecordBatch.from_arrays(columns, schema=schema)

    return id_text(docs, id_col, text_col).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids)
