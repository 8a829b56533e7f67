"""Byte-level BPE encoding and decoding by prefix-sharing trie traversal.

The encoding of a byte string is determined by the last token of each of its
prefixes: enc(p) = enc(p minus its last token) + last token, and among the
vocabulary entries that end p exactly one follows its predecessor without a
merge across the border. The distinct new words of a block of documents go into
a trie; one depth-first walk hands the last-token states down, so a prefix that
many words share is encoded once.

Defined results: null text counts as empty (no token, empty decoded text);
repeated rows give repeated results; a text of any length is read whole; an empty table gives no rows; extra
columns are ignored. The added token of the vocabulary file is cut out of the
text first, as the tokenizers library does.
"""

from __future__ import annotations

import gc
import hashlib
import json
import re
from collections.abc import Iterable, Iterator
from itertools import chain

import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from .common import with_package

#: Chunks and pairs kept by a Python worker; a full store starts anew.
MAX_CHUNKS, MAX_PAIRS = 500_000, 500_000
#: Characters of text per trie.
BLOCK_CHARS = 4_000_000

WORD = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+")
#: Before a blank and a visible character the word pattern always cuts, whatever stands around.
ODD_BLANK, CUT = re.compile(r" (?:\s|\Z)"), re.compile(r" (?=\S)")


def byte_alphabet() -> dict[str, int]:
    """Printable stand-in of each byte in byte-level vocabulary files -> byte."""
    kept = [*range(33, 127), *range(161, 173), *range(174, 256)]
    moved = [b for b in range(256) if b not in set(kept)]
    return {chr(b): b for b in kept} | {chr(256 + k): b for k, b in enumerate(moved)}


class BytePairCodec:
    """Encoder and decoder of one byte-level vocabulary (the JSON text of a tokenizers file)."""

    def keep(self, ids: tuple[int, ...]) -> object:
        """What the store holds of a chunk's ids."""
        return ids

    def __init__(self, spec: str):
        doc = json.loads(spec)
        model, alphabet = doc["model"], byte_alphabet()
        self.added = {x["content"]: x["id"] for x in doc["added_tokens"]}
        raw = lambda s: bytes(alphabet[c] for c in s)
        ids = {s: k for s, k in model["vocab"].items() if s not in self.added}
        self.vocab = {raw(s): k for s, k in ids.items()}
        size = max([*model["vocab"].values(), *self.added.values()]) + 1
        self.rank, self.left, self.right = [-1] * size, [0] * size, [0] * size
        self.merges: dict[tuple[int, int], int] = {}
        for r, m in enumerate(model["merges"]):
            a, b = m if isinstance(m, list) else m.split(" ")
            k = ids[a + b]
            self.merges[ids[a], ids[b]] = r
            self.rank[k], self.left[k], self.right[k] = r, ids[a], ids[b]
        #: automaton over the starts of vocabulary entries: a state is the longest such start that ends the text read so far
        self.starts = {t[:k] for t in self.vocab for k in range(1, len(t) + 1)}
        self.names, self.steps, self.ends, self.state_of = [b""], [{}], [()], {b"": 0}
        self.bytes_of = [b""] * size
        for t, k in self.vocab.items():
            self.bytes_of[k] = t
        for s, k in self.added.items():
            self.bytes_of[k] = s.encode()
        self.str_of = [str(k) for k in range(size)]
        self.split_added = re.compile("(" + "|".join(map(re.escape, sorted(self.added, key=len, reverse=True))) + ")") if self.added else None
        self.chunks: dict[str, object] = {}
        self.pairs: dict[int, bool] = {}

    def _stay_apart(self, a: int, b: int) -> bool:
        """Whether BPE leaves tokens a and b side by side: no pair across the border has a merge that comes before its parts grow on."""
        rank, merges, limit = self.rank, self.merges, 1 << 60
        while True:
            if merges.get((a, b), limit) < limit:
                return False
            if rank[a] > rank[b]:
                limit, a = rank[a], self.right[a]
            elif rank[b] >= 0:
                limit, b = rank[b] + 1, self.left[b]
            else:
                return True

    def _step(self, state: int, byte: int) -> int:
        """The state after one more byte; ends[state] are the entries that end there, longest first, as (length, id)."""
        name = self.names[state] + bytes([byte])
        while name and name not in self.starts:
            name = name[1:]
        if (to := self.state_of.get(name)) is None:
            to = self.state_of[name] = len(self.names)
            self.names.append(name)
            self.steps.append({})
            self.ends.append(tuple((len(name) - k, self.vocab[name[k:]]) for k in range(len(name)) if name[k:] in self.vocab))
        self.steps[state][byte] = to
        return to

    def _encode_words(self, words: set[str]) -> dict[str, tuple[int, ...]]:
        """Encode new distinct words: sorted, they lie in the depth-first order of their trie, and what a word shares with the one before is the path from the root to where it branches off. Only nodes below that point are visited."""
        steps, ends, pairs, apart, found = self.steps, self.ends, self.pairs, self._stay_apart, {}
        last, size, states, before = [-1], [0], [0], b""  # by depth on the current path: the last token of the prefix, its length, the automaton's state
        for raw, w in sorted((w.encode(), w) for w in words):
            depth, most = 0, min(len(raw), len(before))
            while depth < most and raw[depth] == before[depth]:
                depth += 1
            del last[depth + 1 :], size[depth + 1 :], states[depth + 1 :]
            state = states[depth]
            for byte in raw[depth:]:
                depth += 1
                if (to := steps[state].get(byte)) is None:
                    to = self._step(state, byte)
                state = to
                for n, t in ends[state]:
                    if n == depth:
                        break
                    pair = last[depth - n] << 32 | t
                    if (ok := pairs.get(pair)) is None:
                        ok = pairs[pair] = apart(pair >> 32, t)
                    if ok:
                        break
                last.append(t)
                size.append(n)
                states.append(state)
            before, ids, at = raw, [], len(raw)
            while at:
                ids.append(last[at])
                at -= size[at]
            ids.reverse()
            found[w] = tuple(ids)
        return found

    def _learn(self, chunks: set[str]) -> None:
        if len(self.pairs) > MAX_PAIRS:
            self.pairs.clear()
        cut = {c: WORD.findall(c) for c in chunks}
        words = self._encode_words(set(chain.from_iterable(cut.values())))
        for c, parts in cut.items():
            self.chunks[c] = self.keep(words[parts[0]] if len(parts) == 1 else tuple(chain.from_iterable(map(words.__getitem__, parts))))

    def _chunked(self, text: str) -> list[str]:
        """The text cut before blanks that a visible character follows; the first chunk is marked by having no blank."""
        parts = CUT.split(text) if ODD_BLANK.search(text) else text.split(" ")
        return [parts[0], *[" " + p for p in parts[1:]]] if parts[0] else [" " + p for p in parts[1:]]

    def _pieces(self, text: str) -> list[str]:
        """The text's chunks and added tokens, in order."""
        if not any(s in text for s in self.added):
            return self._chunked(text) if text else []
        return list(chain.from_iterable([p] if p in self.added else self._chunked(p) for p in self.split_added.split(text) if p))

    def encode_block(self, texts: list[str]) -> Iterator[list]:
        """What ``keep`` makes of each chunk's ids, by text. Each distinct new chunk of the block is encoded once."""
        rows = [self._pieces(t) for t in texts]
        needed = set().union(*rows)
        if len(self.chunks) + len(new := needed - self.chunks.keys()) > MAX_CHUNKS:
            self.chunks.clear()
            new = needed
        for s, k in self.added.items():
            self.chunks[s] = self.keep((k,))
        self._learn(new - self.added.keys())
        get = self.chunks.__getitem__
        return (list(map(get, row)) for row in rows)

    def encode_chunks(self, texts: Iterable[str]) -> Iterator[list]:
        """encode_block over any number of texts; memory holds one block."""
        block, chars = [], 0
        for t in texts:
            block.append(t)
            chars += len(t)
            if chars >= BLOCK_CHARS:
                yield from self.encode_block(block)
                block, chars = [], 0
        if block:
            yield from self.encode_block(block)

    def encode(self, texts: Iterable[str]) -> Iterator[list[int]]:
        """Token ids of each text, in order."""
        return (list(chain.from_iterable(row)) for row in self.encode_chunks(texts))

    def decode(self, ids: list[int]) -> str:
        return b"".join(map(self.bytes_of.__getitem__, ids)).decode("utf-8", "replace")


class DigestCodec(BytePairCodec):
    """Keeps a chunk's ids as written out for the digest, and the bytes they decode to: both are concatenations, so a shared chunk is written and decoded once."""

    def keep(self, ids: tuple[int, ...]) -> tuple[str, bytes]:
        return ",".join([self.str_of[k] for k in ids]), b"".join([self.bytes_of[k] for k in ids])

    def digests(self, texts: Iterable[str]) -> Iterator[tuple[int, str, str]]:
        for row in self.encode_chunks(texts):
            names = ",".join([x[0] for x in row])
            decoded = b"".join([x[1] for x in row])
            yield names.count(",") + bool(names), hashlib.sha256(names.encode()).hexdigest(), hashlib.sha256(decoded.decode("utf-8", "replace").encode()).hexdigest()


_CODECS: dict[tuple[type, str], BytePairCodec] = {}


def codec_of(kind: type, spec: str) -> BytePairCodec:
    """A Python worker builds a vocabulary's codec once and keeps it for its later tasks. No cycles are made, so the collector only costs time."""
    key = kind, hashlib.sha256(spec.encode()).hexdigest()
    if key not in _CODECS:
        _CODECS.clear()
        _CODECS[key] = kind(spec)
        gc.freeze()
    gc.disable()
    return _CODECS[key]


def load_spec(path: str) -> str:
    """The vocabulary file's text, read on the driver; it is a few MB whatever the corpus and goes to executors as a broadcast."""
    with open(path, encoding="utf-8") as f:
        return f.read()


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def encode_documents(spark: SparkSession, docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ids ARRAY<INT>, decoded STRING) of every row, without a shuffle."""
    spec = with_package(spark).sparkContext.broadcast(load_spec(vocabulary))
    kind = docs.schema[id_col].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = codec_of(BytePairCodec, spec.value)
        for batch in batches:
            ids = list(codec.encode(x or "" for x in batch.column(1).to_pylist()))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.list_(pa.int32())), pa.array([codec.decode(x) for x in ids], pa.string())], ["id", "ids", "decoded"])

    out = T.StructType([T.StructField("id", kind), T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("decoded", T.StringType())])
    return docs.select(docs[id_col].alias("id"), docs[text_col].cast("string").alias("text")).mapInArrow(run, out)


def digest_documents(spark: SparkSession, docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256): as encode_documents, but only digests leave the worker."""
    spec = with_package(spark).sparkContext.broadcast(load_spec(vocabulary))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = codec_of(DigestCodec, spec.value)
        for batch in batches:
            n, enc, dec = list(zip(*codec.digests(x or "" for x in batch.column(1).to_pylist()), strict=True)) or [(), (), ()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(enc, pa.string()), pa.array(dec, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    out = T.StructType([T.StructField("doc_id", docs.schema[id_col].dataType), T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())])
    return docs.select(docs[id_col].alias("doc_id"), docs[text_col].cast("string").alias("text")).mapInArrow(run, out)
