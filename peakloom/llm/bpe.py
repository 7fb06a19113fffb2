"""Problem 7: encoding with a public byte-level BPE vocabulary.

A text is cut into pre-tokens by the vocabulary's pattern. Inside a pre-token the tokens form a doubly
linked list of positions, and every neighbouring pair that can merge lies in the bucket of its
merge rank. A hierarchical bitmap over the ranks, one bit per bucket and one summary bit per word,
gives the lowest rank in use by two find-first-set steps. Entries that a merge has made stale are
recognised by their tokens when they come up and are skipped. A pre-token of n bytes takes O(n) merges
with constant queue steps each, so that very long pre-tokens cost no more per byte than short ones.
"""

from __future__ import annotations

import base64
import hashlib
import os
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from peakloom.session import table

# Fixed value: the pattern that cuts text before the merges of this vocabulary family.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
VOCABULARY = "byte_bpe_50k.tiktoken"
#: Bits of a bitmap word: 256.
WORD_SHIFT = 8
WORD_MASK = (1 << WORD_SHIFT) - 1
#: Pre-tokens kept with their ids, and the longest of them; pairs kept with their rank.
CACHE_TOKENS, CACHE_LENGTH, CACHE_PAIRS = 200_000, 64, 2_000_000
MAX_VOCABULARY = 64 * 2**20


def vocabulary_path(name: str = VOCABULARY) -> str:
    """The file of a vocabulary: in the folder PEAKLOOM_TOKENIZERS names, else where the public package has it."""
    folder = os.environ.get("PEAKLOOM_TOKENIZERS")
    if folder is None:
        try:
            import public_tokenizers

            return public_tokenizers.path(name)
        except ImportError:
            folder = "/opt/tokenizers"
    return os.path.join(folder, name)


class RankQueue:
    """Positions by merge rank, lowest rank first. Words of the bitmap exist while they have a bit set."""

    __slots__ = ("buckets", "summary", "words")

    def __init__(self) -> None:
        self.words: dict[int, int] = {}
        self.summary = 0
        self.buckets: dict[int, list[int]] = {}

    def push(self, rank: int, position: int) -> None:
        bucket = self.buckets.get(rank)
        if bucket is not None:
            bucket.append(position)
            return
        self.buckets[rank] = [position]
        word, bit = rank >> WORD_SHIFT, 1 << (rank & WORD_MASK)
        if word in self.words:
            self.words[word] |= bit
        else:
            self.words[word] = bit
            self.summary |= 1 << word

    def pop(self) -> tuple[int, list[int]]:
        """Remove the bucket of the lowest rank: (rank, its positions from left to right), (-1, []) if none is left.

        Find-first-set in the summary gives the word, find-first-set in the word the rank.
        """
        summary = self.summary
        if not summary:
            return -1, []
        low = summary & -summary
        word = low.bit_length() - 1
        bits = self.words[word]
        bit = bits & -bits
        rank = (word << WORD_SHIFT) + bit.bit_length() - 1
        if bits == bit:
            del self.words[word]
            self.summary = summary ^ low
        else:
            self.words[word] = bits ^ bit
        bucket = self.buckets.pop(rank)
        if len(bucket) > 1:
            bucket.sort()
        return rank, bucket


class Encoder:
    """ids of a text by a file of base64 tokens and their ranks, which are the ids too."""

    def __init__(self, vocabulary: str | bytes, pattern: str = PATTERN):
        """vocabulary: a file's path or its bytes."""
        if isinstance(vocabulary, str):
            with open(vocabulary, "rb") as file:
                vocabulary = file.read()
        self.ranks = {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in vocabulary.splitlines() if line.strip())}
        self.bytes_of = {rank: token for token, rank in self.ranks.items()}
        self.of_byte = [self.ranks[bytes([b])] for b in range(256)]
        self.cut = regex.compile(pattern).findall
        self.top = max(self.ranks.values()) + 1
        self.shift = self.top.bit_length()
        self.pairs: dict[int, int] = {}
        self.known: dict[str, list[int]] = {}

    def pair(self, left: int, right: int) -> int:
        """The rank of the token that two neighbours make, -1 if they make none."""
        key = left << self.shift | right
        rank = self.pairs.get(key)
        if rank is None:
            rank = self.ranks.get(self.bytes_of[left] + self.bytes_of[right], -1)
            if len(self.pairs) >= CACHE_PAIRS:
                self.pairs.clear()
            self.pairs[key] = rank
        return rank

    def merge(self, piece: bytes) -> list[int]:
        """ids of one pre-token."""
        if (whole := self.ranks.get(piece)) is not None:
            return [whole]
        of_byte, pair, known = self.of_byte, self.pair, self.pairs.get
        shift = self.shift
        ids = [of_byte[b] for b in piece]
        n = len(ids)
        # after[i], before[i]: the neighbours of position i in the list; n and -1 are its ends.
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        queue = RankQueue()
        push, pop = queue.push, queue.pop
        left = ids[0]
        for i in range(n - 1):
            right = ids[i + 1]
            rank = known(left << shift | right)
            if rank is None:
                rank = pair(left, right)
            if rank >= 0:
                push(rank, i)
            left = right
        while True:
            rank, positions = pop()
            if rank < 0:
                return [t for t in ids if t >= 0]
            low = rank
            for at, i in enumerate(positions):
                if (left := ids[i]) < 0 or (j := after[i]) >= n:
                    continue  # stale: a merge has taken the left one, or all that was right of it
                r = known(left << shift | ids[j])
                if r is None:
                    r = pair(left, ids[j])
                if r != rank:
                    continue  # stale: one of the two has grown
                ids[i], ids[j] = rank, -1
                after[i] = k = after[j]
                if k < n:
                    before[k] = i
                    r = known(rank << shift | ids[k])
                    if r is None:
                        r = pair(rank, ids[k])
                    if r >= 0:
                        push(r, i)
                        if r < low:
                            low = r
                h = before[i]
                if h >= 0:
                    r = known(ids[h] << shift | rank)
                    if r is None:
                        r = pair(ids[h], rank)
                    if r >= 0:
                        push(r, h)
                        if r < low:
                            low = r
                if low < rank:  # a lower rank came up: it goes first
                    for p in positions[at + 1 :]:
                        push(rank, p)
                    break

    def encode(self, text: str | None) -> list[int]:
        """ids without special tokens; [] for null and empty texts."""
        if not text:
            return []
        out: list[int] = []
        known, extend = self.known, out.extend
        for word in self.cut(text):
            ids = known.get(word)
            if ids is None:
                ids = self.merge(word.encode("utf-8", "surrogatepass"))
                if len(word) <= CACHE_LENGTH:
                    if len(known) >= CACHE_TOKENS:
                        known.clear()
                    known[word] = ids
            extend(ids)
        return out

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(self.bytes_of[i] for i in ids)


@lru_cache(maxsize=4)
def encoder(path: str, pattern: str = PATTERN) -> Encoder:
    """One encoder per process and file."""
    return Encoder(path, pattern)


_encoders: dict[str, Encoder] = {}


def shipped(spark: SparkSession, path: str, pattern: str = PATTERN) -> Callable[[], Encoder]:
    """A function for workers that gives the encoder of a file which only the driver need have.

    The file's bytes are broadcast: a vocabulary has a fixed size (at most ``MAX_VOCABULARY`` bytes, else an error), whatever the data.
    A worker process builds one encoder per file.
    """
    with open(path, "rb") as file:
        content = file.read(MAX_VOCABULARY + 1)
    if len(content) > MAX_VOCABULARY:
        raise ValueError(f"a vocabulary of more than {MAX_VOCABULARY} bytes")
    name = hashlib.sha256(content + pattern.encode()).hexdigest()
    sent = spark.sparkContext.broadcast(content)

    def get() -> Encoder:
        if name not in _encoders:
            _encoders[name] = Encoder(sent.value, pattern)
        return _encoders[name]

    return get


def encode_column(df: DataFrame, key: str, text: str, path: str | None = None, *, counts_only: bool = False) -> DataFrame:
    """(key, ids ARRAY<INT>), or (key, n_tokens INT) with counts_only, of every row.

    Null and empty texts give an empty list and 0. Strings of special tokens are ordinary text. Rows
    stay one to one, repeated ones too; whole texts are encoded; other columns are dropped. path is the
    vocabulary file on the driver.
    """
    get = shipped(df.sparkSession, path or vocabulary_path())
    out = "n_tokens INT" if counts_only else "ids ARRAY<INT>"

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = get()
        for batch in batches:
            texts = batch.column("__text")
            for start in range(0, max(batch.num_rows, 1), 256):  # bounds what a batch of long texts holds at once
                ids = [own.encode(t) for t in texts.slice(start, 256).to_pylist()]
                sizes = np.fromiter((len(x) for x in ids), np.int32, len(ids))
                if counts_only:
                    column: pa.Array = pa.array(sizes, pa.int32())
                else:
                    flat = np.fromiter((i for x in ids for i in x), np.int32, int(sizes.sum()))
                    column = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(sizes)].astype(np.int32)), pa.array(flat))
                yield pa.RecordBatch.from_arrays([batch.column("__key").slice(start, 256), column], names=[key, out.split()[0]])

    kind = df.schema[key].dataType.simpleString()
    source = df.select(F.col(f"`{key}`").alias("__key"), F.col(f"`{text}`").alias("__text"))
    return source.mapInArrow(encode, f"`{key}` {kind}, {out}")


def p7_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_column(table(spark, sf_dir, "documents"), "doc_id", "text")


def decode_column(df: DataFrame, key: str, ids: str = "ids", path: str | None = None) -> DataFrame:
    """(key, text STRING) of every row of ids; a null list gives null, an empty one an empty text."""
    get = shipped(df.sparkSession, path or vocabulary_path())
    kind = df.schema[key].dataType.simpleString()

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = get()
        for batch in batches:
            texts = [None if x is None else own.decode(x).decode("utf-8", "replace") for x in batch.column("__ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("__key"), pa.array(texts, pa.string())], names=[key, "text"])

    return df.select(F.col(f"`{key}`").alias("__key"), F.col(f"`{ids}`").alias("__ids")).mapInArrow(decode, f"`{key}` {kind}, text STRING")


def p7_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's ids turned back into its text."""
    return decode_column(p7_ids(spark, sf_dir), "doc_id")
