"""Token-id output: best-fit-decreasing packing into fixed-width id matrices.

Documents are encoded, cut losslessly into pieces of at most ``width`` tokens, and
packed window by window: pieces in descending length, each into the fullest row
that still has room, found by a segment tree over free capacities. A window holds
about WINDOW tokens, so memory doesn't grow with the input and there is no shuffle.
Each packed row has its ids as little-endian uint16 or uint32, the cumulative
lengths of its segments, and position ids that start anew at each segment.
``unpacked`` gives the documents' ids back.

Defined results: null or empty text has no tokens and no segment; repeated rows are
packed each; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import base64
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import with_package

WIDTH, WINDOW = 2048, 1 << 20
SCHEMA = "shard long, window long, row long, n_tokens long, input_ids binary, position_ids binary, cu_seqlens array<int>, doc_ids array<long>, pieces array<int>"


class CapacityTree:
    """Bins by free capacity 0..width; the least capacity of at least n that a bin has, in log(width) steps."""

    def __init__(self, width: int):
        self.size = 1 << width.bit_length()
        self.count = [0] * (2 * self.size)
        self.bins: list[list[int]] = [[] for _ in range(width + 1)]

    def _add(self, capacity: int, by: int) -> None:
        k = self.size + capacity
        while k:
            self.count[k] += by
            k >>= 1

    def put(self, capacity: int, bin_: int) -> None:
        self.bins[capacity].append(bin_)
        self._add(capacity, 1)

    def take(self, n: int) -> tuple[int, int] | None:
        """Remove and return (bin, capacity) of the fullest bin with room for n."""
        k = self.size + n
        if not self.count[k]:
            while k > 1 and not (k % 2 == 0 and self.count[k + 1]):
                k >>= 1
            if k <= 1:
                return None
            k += 1
            while k < self.size:
                k = 2 * k if self.count[2 * k] else 2 * k + 1
        capacity = k - self.size
        self._add(capacity, -1)
        return self.bins[capacity].pop(), capacity


def best_fit_decreasing(lengths: list[int], width: int) -> list[list[int]]:
    """Bins of piece numbers, each of at most ``width`` tokens."""
    tree, out = CapacityTree(width), []
    for k in sorted(range(len(lengths)), key=lambda k: (-lengths[k], k)):
        if (found := tree.take(lengths[k])) is None:
            out.append([])
            found = len(out) - 1, width
        out[found[0]].append(k)
        tree.put(found[1] - lengths[k], found[0])
    return out


def rank_encoder(ranks: str, pattern: str) -> Callable[[list[str]], list[list[int]]]:
    """Encoder from the text of a rank file (base64 token, rank) and its split pattern."""
    import tiktoken

    table = {base64.b64decode(a): int(b) for a, b in (line.split() for line in ranks.splitlines() if line)}
    enc = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=table, special_tokens={})
    return lambda texts: [enc.encode_ordinary(t) for t in texts]


_ENCODERS: dict[tuple[str, str], Callable] = {}


def cached_encoder(spec: tuple[str, str]) -> Callable[[list[str]], list[list[int]]]:
    """A Python worker builds a vocabulary's encoder once and keeps it for its later tasks."""
    if spec not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[spec] = rank_encoder(*spec)
    return _ENCODERS[spec]


def pack(spark: SparkSession, docs: DataFrame, ranks_path: str, pattern: str, pad: int, width: int = WIDTH, window: int = WINDOW) -> DataFrame:
    """A row for each packed row of ``width`` ids; rows are named by shard (the task), window and row."""
    with open(ranks_path, encoding="ascii") as f:
        spec = with_package(spark).sparkContext.broadcast((f.read(), pattern))  # a vocabulary: about 1 MB
    kind = np.dtype("<u2") if pad < 1 << 16 else np.dtype("<u4")

    def rows_of(pieces: list[tuple[int, int, np.ndarray]], shard: int, no: int) -> pa.RecordBatch:
        cols: list[list] = [[] for _ in range(9)]
        for r, members in enumerate(best_fit_decreasing([len(p[2]) for p in pieces], width)):
            ids, pos = np.full(width, pad, kind), np.zeros(width, kind)
            cu = np.concatenate([[0], np.cumsum([len(pieces[k][2]) for k in members])])
            for k, a, b in zip(members, cu, cu[1:], strict=False):
                ids[a:b], pos[a:b] = pieces[k][2], np.arange(b - a)
            for c, v in zip(cols, (shard, no, r, int(cu[-1]), ids.tobytes(), pos.tobytes(), cu.tolist(), [pieces[k][0] for k in members], [pieces[k][1] for k in members]), strict=True):
                c.append(v)
        kinds = [pa.int64()] * 4 + [pa.binary()] * 2 + [pa.list_(pa.int32()), pa.list_(pa.int64()), pa.list_(pa.int32())]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], ["shard", "window", "row", "n_tokens", "input_ids", "position_ids", "cu_seqlens", "doc_ids", "pieces"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, shard = cached_encoder(spec.value), TaskContext.get().partitionId()
        held, tokens, no = [], 0, 0
        for b in batches:
            for at in range(0, b.num_rows, 64):
                part = b.slice(at, 64)
                for d, ids in zip(part.column(0).to_pylist(), encode([t or "" for t in part.column(1).to_pylist()]), strict=True):
                    ids = np.array(ids, kind)
                    for k, a in enumerate(range(0, len(ids), width)):
                        held.append((d, k, ids[a : a + width]))
                        tokens += len(held[-1][2])
                        if tokens >= window:
                            yield rows_of(held, shard, no)
                            held, tokens, no = [], 0, no + 1
        if held:
            yield rows_of(held, shard, no)

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, SCHEMA)


def unpacked(packed: DataFrame, width: int = WIDTH) -> DataFrame:
    """(doc_id, piece, ids): every segment's token ids, from the packed rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            d, p, x = [], [], []
            for ids, cu, docs, pieces in zip(*(c.to_pylist() for c in b.columns), strict=True):

                ids = np.frombuffer(ids, "<u2" if len(ids) == 2 * width else "<u4")
                for k in range(len(docs)):
                    d.append(docs[k])
                    p.append(pieces[k])
                    x.append(ids[cu[k] : cu[k + 1]].tolist())
            yield pa.RecordBatch.from_arrays([pa.array(d, pa.int64()), pa.array(p, pa.int32()), pa.array(x, pa.list_(pa.int32()))], ["doc_id", "piece", "ids"])

    return packed.select("input_ids", "cu_seqlens", "doc_ids", "pieces").mapInArrow(run, "doc_id long, piece int, ids array<int>")


def write_packed(packed: DataFrame, path: str) -> None:
    """Packed rows as Parquet with binary columns, committed as a whole."""
    packed.write.mode("overwrite").parquet(path)
