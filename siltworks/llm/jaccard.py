"""N-gram Jaccard join: all documents whose word-shingle sets have a Jaccard similarity of at least 80 %, as connected components.

1. Documents with the same set form a class, named by 128 bits of its set. A sketch of
   fixed size counts shingles over all documents.
2. Each class emits its prefix: its n - ceil(0.8 n) + 1 first shingles in a global
   order, common ones last. Two linked sets share a prefix shingle, whatever the
   order; the sketch only decides how many other sets do.
3. The sets of a shingle fall into runs by size; between runs no link is possible.
   Shingles whose runs have the same sets make one group, which is joined once: copies
   and shared passages meet in hundreds of shingles. Sets of a group are compared with the
   smallest of their size band; exact links make first components.
4. Where a group has sets of several first components they meet in tiles of bounded
   size, sorted by set size. Parity bitmaps bound each pair's overlap from above; a tile
   emits the forest of what they can't keep apart, so less than it has rows.
5. What these forests join up makes families. Only inside a family can there still be
   a link. The sets of a family meet in tiles once more, each with its sorted array:
   bitmaps first, exact intersections of what is left, and a tile emits the forest
   of its links.

In both kinds of tile a component too large for one has tiles of its own, which never
meet each other: a set costs one row for each tile of other components. No group is ever expanded
into pairs, no link between different texts is lost, and no step holds more than a
tile or a batch. Sets are of 64-bit hashes.

Defined results: null or empty text has no shingles and its own id as component;
fewer words than a shingle count as one shingle; repeated rows share a component, as do
rows that share an id only if their texts are linked; a component's id is its smallest
non-null id, null if it has none; an empty table gives no rows; further columns,
whatever their names, are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import discard, staged, with_package

SHINGLE, NUM, DEN = 5, 80, 100
#: Counters of the sketch, and in how many pieces they are summed.
COUNTERS, PIECES = 1 << 20, 64
#: Words whose hashes a worker keeps; sets of one side of a tile, and members of its sets in all (a larger set has a tile of its own).
MAX_WORDS, TILE, MEMBERS = 300_000, 2048, 1 << 20
#: Places for each member in the bitmaps that are shuffled, and in those that a tile makes of whole sets.
PLACES, FINE_PLACES = 2, 8

_P, _M1, _M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


class WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= MAX_WORDS:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


_HASHES = WordHashes()


def shingle_set(text: bytes | None) -> np.ndarray:
    """Sorted distinct hashes of the text's word shingles."""
    words = (text or b"").lower().split()  # of bytes: A-Z only, and the six ASCII blanks
    n = len(words)
    if not n:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(_HASHES.__getitem__, words), np.uint64, n)
    k = min(SHINGLE, n)
    s = h[: n - k + 1].copy()
    for j in range(1, k):
        s *= _P
        s += h[j : n - k + 1 + j]
    s += np.uint64(k)
    s ^= s >> np.uint64(30)
    s *= _M1
    s ^= s >> np.uint64(27)
    s *= _M2
    s ^= s >> np.uint64(31)
    return np.unique(s)


def class_of(s: np.ndarray) -> bytes:
    return xxhash.xxh3_128_digest(s.tobytes(), seed=len(s))


def bitmap(s: np.ndarray, places: int = PLACES) -> np.ndarray:
    """Parity of the hashes in each of 2**k places, one to two times ``places`` as many as hashes; halves fold onto each other by XOR."""
    bits = 64
    while bits < places * len(s) and bits < 1 << 17:
        bits *= 2
    return np.packbits((np.bincount((s >> np.uint64(24)).astype(np.int64) & (bits - 1), minlength=bits) & 1).astype(np.uint8))


def needed(total):
    """The least overlap of two sets with ``total`` members together that are similar enough."""
    return -(-NUM * total // (NUM + DEN))


def prefix(s: np.ndarray, counts: np.ndarray, common: int) -> np.ndarray:
    n = len(s)
    p = n - -(-NUM * n // DEN) + 1
    if n < 2:
        return s[:0]
    c = counts[slot(s)]
    often = c > common
    if not often.any():
        return s[:p]
    rare = s[~often]
    if len(rare) >= p:
        return rare[:p]
    rest, c = s[often], c[often]
    return np.concatenate([rare, rest[np.lexsort((rest, c))][: p - len(rare)]])


def slot(s: np.ndarray) -> np.ndarray:
    return (s >> np.uint64(44)).astype(np.int64)


def _texts(batches: Iterator[pa.RecordBatch], rows: int = 256) -> Iterator[tuple[pa.RecordBatch, list]]:
    """Small batches, and the texts in their last column."""
    for b in batches:
        for at in range(0, b.num_rows, rows):
            part = b.slice(at, rows)
            yield part, part.column(part.num_columns - 1).to_pylist()


def _names(cls: np.ndarray) -> pa.Array:
    """Rows of two 64-bit words as 16 bytes each."""
    return pa.Array.from_buffers(pa.binary(16), len(cls), [None, pa.py_buffer(np.ascontiguousarray(cls, "<u8").tobytes())]).cast(pa.binary())


def _words(names: pa.Array) -> np.ndarray:
    """The reverse of ``_names``."""
    if not len(names):
        return np.empty((0, 2), np.uint64)
    at = np.frombuffer(names.buffers()[1], np.int32)[names.offset : names.offset + len(names) + 1]
    return np.frombuffer(names.buffers()[2], np.uint8)[at[0] : at[-1]].copy().view("<u8").reshape(-1, 2)


def _summaries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each document (id, hash of the text, n, cls, bits), and at the end the task's counters in pieces."""
    counts, any_row = np.zeros(COUNTERS, np.int64), False
    names = ["doc_id", "h", "n", "cls", "bits", "piece", "counts"]
    for part, texts in _texts(batches):
        sets = [shingle_set(t) for t in texts]
        counts += np.bincount(slot(np.concatenate(sets)), minlength=COUNTERS)
        any_row, k = True, len(sets)
        yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array([len(s) for s in sets], pa.int64()), pa.array([class_of(s) if len(s) else None for s in sets], pa.binary()), pa.array([bitmap(s).tobytes() if len(s) else None for s in sets], pa.binary()), pa.nulls(k, pa.int32()), pa.nulls(k, pa.binary())], names)
    if any_row:
        parts = [c.astype(np.uint32).tobytes() for c in np.split(counts, PIECES)]
        yield pa.RecordBatch.from_arrays([*[pa.nulls(PIECES, pa.int64())] * 3, *[pa.nulls(PIECES, pa.binary())] * 2, pa.array(range(PIECES), pa.int32()), pa.array(parts, pa.binary())], names)


def _sum_pieces(key, rows):
    total = np.zeros(COUNTERS // PIECES, np.int64)
    for x in rows.column("counts").to_pylist():
        total += np.frombuffer(x, np.uint32)
    return pa.table({"piece": pa.array([key[0].as_py()], pa.int32()), "counts": pa.array([total.tobytes()], pa.binary())})


def _leaders(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows sorted by (token, n, cls): those with a neighbour of their token that their size allows, with the first of their size band as leader. A token's sets fall into runs without a gap in size that is too wide for a link; each run has a token of its own. Between batches only the last leader and the sizes of the run are kept."""
    held, last_n, run_n = [np.empty(0, np.int64), np.empty(0, np.int64), np.empty((0, 2), np.uint64)], 0, 0
    for b in batches:
        token, n, cls = (np.concatenate([h, x]) for h, x in zip(held, (np.asarray(b.column(0)), np.asarray(b.column(1)), _words(b.column(2))), strict=True))
        if not len(token):
            continue
        fresh = np.ones(len(token), dtype=bool)
        fresh[1:] = (token[1:] != token[:-1]) | (cls[1:] != cls[:-1]).any(axis=1)
        token, n, cls = token[fresh], n[fresh], cls[fresh]
        at = np.arange(len(token))
        starts = np.ones(len(token), dtype=bool)
        starts[1:] = token[1:] != token[:-1]
        while True:  # a set too large for its leader starts the next band of its token
            lead = np.maximum.accumulate(np.where(starts, at, 0))
            far = DEN * n[lead] < NUM * n
            if not far.any():
                break
            new = far.copy()
            new[1:] &= ~(far[:-1] & (lead[1:] == lead[:-1]))
            starts |= new
        before, first_n = n[:-1].copy(), n.copy()
        if len(held[0]):  # the row at 0 is a leader from before; others may have followed it
            first_n[0] = run_n
            before[:1] = last_n
        near = np.zeros(len(token), dtype=bool)
        near[1:] = (token[1:] == token[:-1]) & (DEN * before >= NUM * n[1:])
        run = first_n[np.maximum.accumulate(np.where(near, 0, at))]
        kept = near.copy()
        kept[:-1] |= near[1:]
        if kept.any():
            own = ((token.astype(np.uint64) ^ (run.astype(np.uint64) * _P)) * _M1).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(own[kept]), _names(cls[kept]), pa.array(n[kept]), _names(cls[lead][kept])], ["token", "cls", "n", "leader"])
        k = lead[-1]
        last_n = max(last_n, n[-1]) if len(token) == 1 and len(held[0]) else n[-1]
        held, run_n = [token[k : k + 1], n[k : k + 1], cls[k : k + 1]], run[-1]


def _bounded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows (a, b, size and bits of each): the pairs whose overlap, bounded from above by the bitmaps, may be enough."""
    for b in batches:
        m, n = (np.asarray(b.column(k)) for k in (2, 3))
        least, out = needed(m + n), []
        for k in np.flatnonzero(np.minimum(m, n) >= least):
            p, q = (np.frombuffer(b.column(j)[int(k)].as_buffer(), np.uint8) for j in (4, 5))
            p, q = (p, q) if len(p) <= len(q) else (q, p)
            while len(q) > len(p):
                q = q[: len(q) // 2] ^ q[len(q) // 2 :]
            if (m[k] + n[k] - int(np.bitwise_count(p ^ q).sum())) // 2 >= least[k]:
                out.append(int(k))
        if out:
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(out)), b.column(1).take(pa.array(out))], ["a", "b"])


def _overlap(x: np.ndarray, y: np.ndarray) -> int:
    return len(np.intersect1d(x, y, assume_unique=True))


def _star_links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows (a, salt, b, members) sorted by (a, salt), the leader itself with a null b first: the pairs that are similar enough. Only the leader's set is kept."""
    key, lead = None, np.empty(0, np.uint64)
    for batch in batches:
        out = []
        for k, (a, salt, b) in enumerate(zip(*(batch.column(c).to_pylist() for c in range(3)), strict=True)):
            x = np.frombuffer(batch.column(3)[k].as_buffer(), np.uint64)
            if b is None:
                key, lead = (a, salt), x.copy()
            elif (a, salt) == key and _overlap(lead, x) >= needed(len(lead) + len(x)):
                out.append(k)
        if out:
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(out)), batch.column(2).take(pa.array(out))], ["a", "b"])


class _Tile:
    """Sets of one key and pair of tiles, by ascending size: rows (cls, n, comp, side, bitmap), or (cls, n, comp, side, set) if ``whole``."""

    def __init__(self, rows: list[tuple], whole: bool):
        self.names = [r[2] for r in rows]
        seen: dict[bytes, int] = {}
        self.comp = np.array([seen.setdefault(c, len(seen)) for c in self.names], np.int64)
        self.n, self.side = (np.array([r[k] for r in rows], np.int64) for k in (1, 3))
        self.sets = [np.frombuffer(r[4], np.uint64) for r in rows] if whole else None
        self.bits = [bitmap(s, FINE_PLACES) for s in self.sets] if whole else [np.frombuffer(r[4], np.uint8) for r in rows]
        self.width = np.array([len(x) for x in self.bits])
        self.at = np.zeros(len(rows), np.int64)
        self.stacks: dict[int, np.ndarray] = {}
        for w in np.unique(self.width):
            who = np.flatnonzero(self.width == w)
            self.at[who] = np.arange(len(who))
            self.stacks[int(w)] = np.stack([self.bits[k] for k in who])

    def forest(self, crossed: bool) -> Iterator[tuple[bytes, bytes]]:
        """Pairs of components that join up what the bitmaps can't keep apart, or if the tile has whole sets, what is linked: less than the tile has rows. Of different sides only, if ``crossed``."""
        folded = {w: m[:, : w // 2] ^ m[:, w // 2 :] for w, m in self.stacks.items()}
        for i in range(len(self.n)):
            n, w = self.n[i], int(self.width[i])
            to = np.searchsorted(self.n, DEN * n // NUM, side="right")
            j = np.arange(i + 1, to)
            j = j[(self.comp[j] != self.comp[i]) & ((self.side[j] != self.side[i]) | (not crossed))]
            for width, rows in ((w, self.stacks.get(w)), (2 * w, folded.get(2 * w))):
                k = j[self.width[j] == width]
                if not len(k):
                    continue
                apart = np.bitwise_count(rows[self.at[k]] ^ self.bits[i]).sum(axis=1, dtype=np.int64)
                total = n + self.n[k]
                for m in k[(total - apart) // 2 >= needed(total)]:
                    if self.comp[m] == self.comp[i] or (self.sets is not None and _overlap(self.sets[i], self.sets[m]) < needed(n + self.n[m])):
                        continue
                    self.comp[self.comp == self.comp[m]] = self.comp[i]
                    yield self.names[i], self.names[m]


def _tile_forests(batches: Iterator[pa.RecordBatch], whole: bool) -> Iterator[pa.RecordBatch]:
    """Of rows sorted by (key, lo, hi, n): the forest of each tile, as pairs of components."""
    key, rows = None, []

    def flush() -> list[tuple[bytes, bytes]]:
        return list(_Tile(rows, whole).forest(key[1] != key[2])) if len({r[2] for r in rows}) > 1 else []

    def batch(found: list[tuple[bytes, bytes]]) -> pa.RecordBatch:
        a, b = zip(*found, strict=True)
        return pa.RecordBatch.from_arrays([pa.array(a, pa.binary()), pa.array(b, pa.binary())], ["a", "b"])

    for b in batches:
        for at in range(0, b.num_rows, 256):  # sets are large: few are copied out of the batch at once
            for k, lo, hi, *row in zip(*(c.to_pylist() for c in b.slice(at, 256).columns), strict=True):
                if (k, lo, hi) != key:
                    if found := flush():
                        yield batch(found)
                    key, rows = (k, lo, hi), []
                if not rows or rows[-1][0] != row[0]:  # a class once, if several tasks made its set
                    rows.append(row)
    if found := flush():
        yield batch(found)


def _bitmap_forests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    yield from _tile_forests(batches, False)


def _link_forests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    yield from _tile_forests(batches, True)


def connected(spark: SparkSession, edges: DataFrame) -> DataFrame:
    """(node, label) of all nodes of ``edges`` (a, b): label is the smallest node of its component. Alternating large and small stars, each round a written table."""
    e = staged(spark, edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "links")
    sign = None
    while True:
        now = e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if sign == tuple(now) or not now[0]:
            return e.select(F.col("u").alias("node"), F.col("v").alias("label")).unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("label")).distinct())
        sign = tuple(now)
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("x"), F.least("u", "m").alias("m"))
        large = both.join(least, both["u"] == least["x"]).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u > v")
        low = large.groupBy("u").agg(F.min("v").alias("m")).withColumnRenamed("u", "x")
        small = large.join(low, large["u"] == low["x"]).select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("e")).select("e.*").where("u > v").distinct()
        old, e = e, staged(spark, small, "links")
        discard(spark, old)


def grouped(spark: SparkSession, shared: DataFrame) -> DataFrame:
    """Rows (token, cls, ...) of one token for each set of classes that tokens have in common: the others would only repeat its pairs. Sets of classes are told apart by their size and 96 bits of hashes."""
    low = F.xxhash64("cls", F.lit(1)).bitwiseAND(F.lit(0xFFFFFFFF))
    groups = shared.groupBy("token").agg(F.count(F.lit(1)).alias("rows"), F.bit_xor(F.xxhash64("cls")).alias("x"), F.sum(low).alias("y"))
    one = groups.groupBy("rows", "x", "y").agg(F.min("token").alias("first"))
    out = staged(spark, shared.join(one, shared["token"] == one["first"], "left_semi"), "groups")
    discard(spark, shared)
    return out


def tiled(rows: DataFrame, key: str) -> DataFrame:
    """Rows (key, cls, n, comp) of keys that have several components, once for each pair of tiles (lo, hi) that they take part in, with their own tile as side. A component too large for a tile has tiles of its own, which don't meet each other; the others share the first tiles."""
    sizes = rows.groupBy(key, "comp").agg(F.count(F.lit(1)).alias("rows"), F.sum("n").alias("members"))
    tiles = lambda r, m: F.ceil(F.greatest(r / F.lit(TILE), m / F.lit(MEMBERS))).cast("int")
    sizes = sizes.withColumn("tiles", tiles(F.col("rows"), F.col("members")))
    rest = lambda c: F.coalesce(F.sum(F.when(F.col("tiles") <= 1, F.col(c))), F.lit(0))
    keys = sizes.groupBy(key).agg(F.count(F.lit(1)).alias("comps"), tiles(rest("rows"), rest("members")).alias("shared"), F.coalesce(F.sum(F.when(F.col("tiles") > 1, F.col("tiles"))), F.lit(0)).cast("int").alias("own")).where("comps > 1").select(F.col(key).alias("k"), "shared", (F.col("shared") + F.col("own")).alias("all"))
    # a window over large components only: of a key, there are at most as many as it has tiles
    last = F.sum("tiles").over(Window.partitionBy(key).orderBy("comp")).cast("int")
    large = sizes.where("tiles > 1").select(F.col(key).alias("large_k"), F.col("comp").alias("large_comp"), F.col("tiles").alias("width"), last.alias("last"))
    out = rows.join(keys, rows[key] == keys["k"]).join(large, (F.col(key) == F.col("large_k")) & (F.col("comp") == F.col("large_comp")), "left")
    first = F.col("shared") + F.col("last") - F.col("width")
    deal = F.xxhash64("cls")
    side = F.when(F.col("width").isNull(), F.pmod(deal, F.col("shared"))).otherwise(first + F.pmod(deal, F.col("width"))).cast("int")
    meets = F.filter(F.sequence(F.lit(0), F.col("all") - 1), lambda t: F.col("width").isNull() | (t < first) | (t >= first + F.col("width")))
    return out.select(key, "cls", "n", "comp", side.alias("side"), F.explode(meets).alias("other")).select(key, F.least("side", "other").alias("lo"), F.greatest("side", "other").alias("hi"), "cls", "n", "comp", "side")


def near_duplicates(spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id, text_hash) of every row; ids are integers. text_hash, Spark's xxhash64 of the text, tells rows of one id apart."""
    with_package(spark)
    texts = docs.select(docs[id_col].cast("long").alias("doc_id"), F.xxhash64(docs[text_col].cast("string")).alias("h"), docs[text_col].cast("string").cast("binary").alias("text"))
    both = staged(spark, texts.mapInArrow(_summaries, "doc_id long, h long, n long, cls binary, bits binary, piece int, counts binary"), "sets")
    rows = both.where("piece IS NULL").select("doc_id", "n", "cls", F.col("h").alias("text_hash"))
    pieces = both.where("piece IS NOT NULL").select("piece", "counts").groupBy("piece").applyInArrow(_sum_pieces, "piece int, counts binary").collect()  # PIECES rows, 8 * COUNTERS bytes
    counts = np.concatenate([np.frombuffer(r["counts"], np.int64) for r in sorted(pieces, key=lambda r: r["piece"])]) if pieces else np.zeros(COUNTERS, np.int64)
    mean = counts.sum() / COUNTERS
    common = int(mean + 4 * mean**0.5 + 8)  # above what unrelated shingles add to a counter
    sketch = spark.sparkContext.broadcast(np.minimum(counts, np.iinfo(np.uint32).max).astype(np.uint32))

    def prefixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done: set[bytes] = set()  # copies within a task emit once
        for _, got in _texts(batches):
            token, cls, n = [], [], []
            for t in got:
                s = shingle_set(t)
                if len(s) < 2 or (c := class_of(s)) in done:
                    continue
                if len(done) < MAX_WORDS:
                    done.add(c)
                p = prefix(s, sketch.value, common)
                token.append(p.astype(np.int64))
                cls.append(np.tile(np.frombuffer(c, "<u8"), (len(p), 1)))
                n.append(np.full(len(p), len(s)))
            if token:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(token)), pa.array(np.concatenate(n).astype(np.int64)), _names(np.concatenate(cls))], ["token", "n", "cls"])

    def arrays(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done: set[bytes] = set()  # repeated rows share a class: a task emits it once
        for _, got in _texts(batches):
            found = {}
            for s in map(shingle_set, got):
                if len(s) and (c := class_of(s)) not in done:
                    found[c] = s.tobytes()
            if len(done) < MAX_WORDS:
                done.update(found)
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(found.keys(), pa.binary()), pa.array(found.values(), pa.binary())], ["cls", "members"])

    tokens = texts.select("text").mapInArrow(prefixes, "token long, n long, cls binary")
    shared = grouped(spark, staged(spark, tokens.repartition("token").sortWithinPartitions("token", "n", "cls").mapInArrow(_leaders, "token long, cls binary, n long, leader binary"), "shared"))
    least = both.where("cls IS NOT NULL").groupBy("cls").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "h", "n", "bits")).alias("x"))
    classes = staged(spark, least.select("cls", F.col("x.doc_id").alias("rep"), F.col("x.h").alias("h"), F.col("x.n").alias("n"), F.col("x.bits").alias("bits")), "classes")

    def sets_of(met: DataFrame) -> DataFrame:
        """(cls, members) of the classes in ``met``: only their sets are made again, from the text of one row each. A row is named by its id, null included, and its text's hash."""
        reps = staged(spark, classes.join(met, "cls", "left_semi").select(F.col("rep").alias("r"), F.col("h").alias("g")).distinct(), "representatives")
        made = texts.join(reps, texts["doc_id"].eqNullSafe(reps["r"]) & (texts["h"] == reps["g"]), "left_semi").select("text").mapInArrow(arrays, "cls binary, members binary")
        out = staged(spark, made, "arrays")
        discard(spark, reps)
        return out

    # links of each set with the smallest of a size band; a leader's followers are dealt out over salts, each with a copy of the leader
    stars = shared.where("cls <> leader").groupBy("cls").agg(F.min("leader").alias("a")).select("a", F.col("cls").alias("b"))
    x, y = (classes.select(F.col("cls").alias(c), F.col("n").alias(f"n_{c}"), F.col("bits").alias(f"bits_{c}")) for c in "ab")
    near = staged(spark, stars.join(y, "b").join(x, "a").select("a", "b", "n_a", "n_b", "bits_a", "bits_b").mapInArrow(_bounded, "a binary, b binary"), "stars")
    members = sets_of(near.select(F.explode(F.array("a", "b")).alias("cls")).distinct())
    many = near.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / F.lit(TILE)).cast("int").alias("salts"))
    followers = near.join(many, "a").select("a", F.pmod(F.xxhash64("b"), F.col("salts")).cast("int").alias("salt"), "b").join(members, F.col("b") == F.col("cls")).select("a", "salt", "b", "members")
    leaders = many.join(members, F.col("a") == F.col("cls")).select("a", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), F.lit(None).cast("binary").alias("b"), "members")
    links = staged(spark, leaders.unionByName(followers).repartition("a", "salt").sortWithinPartitions("a", "salt", F.asc_nulls_first("b")).mapInArrow(_star_links, "a binary, b binary"), "verified")
    for t in (near, members):
        discard(spark, t)
    comp = staged(spark, connected(spark, links), "first-components")
    discard(spark, links)

    # families: components that the bitmaps can't keep apart somewhere
    known = shared.join(comp, shared["cls"] == comp["node"], "left").select("token", "cls", "n", F.coalesce("label", "cls").alias("comp"))
    known = staged(spark, known, "known")
    tiles = tiled(known, "token").join(classes.select(F.col("cls").alias("c"), "bits"), F.col("cls") == F.col("c")).select("token", "lo", "hi", "cls", "n", "comp", "side", "bits")
    maybe = tiles.repartition("token", "lo", "hi").sortWithinPartitions("token", "lo", "hi", "n", "cls").mapInArrow(_bitmap_forests, "a binary, b binary")
    family = staged(spark, connected(spark, maybe), "families")
    for t in (known, shared):
        discard(spark, t)

    # links inside families
    inside = comp.join(family.select(F.col("node").alias("f"), F.col("label").alias("family")), comp["label"] == F.col("f")).select("family", F.col("node").alias("cls"), F.col("label").alias("comp"))
    alone = family.join(comp, family["node"] == comp["node"], "left_anti").select(F.col("label").alias("family"), F.col("node").alias("cls"), F.col("node").alias("comp"))
    inside = staged(spark, inside.unionByName(alone).join(classes.select("cls", "n"), "cls").select("family", "cls", "n", "comp"), "family-members")
    members = sets_of(inside.select("cls"))
    tiles = tiled(inside, "family").join(members.withColumnRenamed("cls", "c"), F.col("cls") == F.col("c")).select("family", "lo", "hi", "cls", "n", "comp", "side", "members")
    joined = staged(spark, connected(spark, tiles.repartition("family", "lo", "hi").sortWithinPartitions("family", "lo", "hi", "n", "cls").mapInArrow(_link_forests, "a binary, b binary")), "joined")
    for t in (inside, members, family):
        discard(spark, t)

    named = classes.join(comp, classes["cls"] == comp["node"], "left").select(classes["cls"], "rep", F.coalesce("label", "cls").alias("first"))
    named = named.join(joined, named["first"] == joined["node"], "left").select("cls", "rep", F.coalesce("label", "first").alias("label"))
    named = staged(spark, named, "named")
    for t in (comp, joined, classes):
        discard(spark, t)
    ids = named.groupBy("label").agg(F.min("rep").alias("component_id"))
    by_class = named.join(ids, "label").select(F.col("cls").alias("c"), "component_id")
    some = rows.where("cls IS NOT NULL")
    out = some.join(by_class, some["cls"] == by_class["c"], "left").select("doc_id", F.col("n").alias("n_shingles"), "component_id", "text_hash")
    return out.unionByName(rows.where("cls IS NULL").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"), "text_hash"))
