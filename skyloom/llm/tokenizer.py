"""Encoding a corpus by a byte-level BPE vocabulary, exactly and distributed.

Texts are cut into words by the vocabulary's pattern, as its public implementations do.
The corpus' frequent words, counted over all texts, are compiled with their ids into
a memory-mapped lexicon (``lexicon``); words that aren't there are merged by rank.
"""

from __future__ import annotations

import base64
import heapq
import os
from collections import Counter
from functools import lru_cache

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skyloom.llm import lexicon
from skyloom.session import hadoop, local_path, run_dir

VOCABULARY = os.environ.get("SKYLOOM_TOKENIZERS", "/opt/tokenizers") + "/byte_bpe_50k.tiktoken"
# Fixed value: the vocabulary's published pattern of words.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


@lru_cache(maxsize=4)
def ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


@lru_cache(maxsize=1)
def _cutter():
    import regex

    return regex.compile(PATTERN).findall


def words(text: str) -> list[str]:
    """The words of a text; joined they are the text again."""
    return _cutter()(text)


def merge(word: bytes, rank: dict[bytes, int]) -> list[int]:
    """Ids of a word: of all neighbouring pieces the pair of lowest rank (the leftmost of
    several) is joined, again and again. O(n log n) in the word's length."""
    whole = rank.get(word)
    if whole is not None:
        return [whole]
    n = len(word)
    end = list(range(1, n + 1))  # piece at i spans [i, end[i])
    before = list(range(-1, n - 1))
    heap = [(r, i, i + 2) for i in range(n - 1) if (r := rank.get(word[i : i + 2])) is not None]
    heapq.heapify(heap)
    dead = bytearray(n)
    while heap:
        r, i, stop = heapq.heappop(heap)
        if dead[i]:
            continue
        j = end[i]
        if j >= n or end[j] != stop:  # one of the two pieces has grown since
            continue
        dead[j] = 1
        end[i] = stop
        if stop < n:
            before[stop] = i
            if (q := rank.get(word[i : end[stop]])) is not None:
                heapq.heappush(heap, (q, i, end[stop]))
        h = before[i]
        if h >= 0 and (q := rank.get(word[h:stop])) is not None:
            heapq.heappush(heap, (q, h, stop))
    return [rank[word[i : end[i]]] for i in range(n) if not dead[i]]


def count_words(texts: DataFrame, column: str = "text", at_once: int = 200_000) -> DataFrame:
    """word binary, n long: how often each word occurs in all texts."""

    def count(batches):
        import pyarrow as pa

        seen: Counter = Counter()

        def out():
            return pa.RecordBatch.from_arrays([pa.array([w.encode() for w in seen], pa.binary()), pa.array(list(seen.values()), pa.int64())], names=["word", "n"])

        for b in batches:
            for t in b.column(0):
                if (t := t.as_py()) is not None:
                    seen.update(words(t))
            if len(seen) >= at_once:
                yield out()
                seen.clear()
        if seen:
            yield out()

    return texts.select(F.col(column).cast("string").alias("t")).mapInArrow(count, "word binary, n bigint").groupBy("word").agg(F.sum("n").alias("n"))


def build_lexicon(texts: DataFrame, column: str = "text", *, most: int = 60_000, least: int = 2, longest: int = 64, vocabulary: str = VOCABULARY) -> str:
    """Compile the ``most`` most frequent words of the corpus; returns the file's URI.

    Counting covers every text; only words seen ``least`` times and up to ``longest``
    bytes long go in. ``most`` bounds what the driver gets. The file is written to the
    shared folder.
    """
    spark = texts.sparkSession
    top = count_words(texts, column).where((F.col("n") >= least) & (F.length("word") <= longest)).orderBy(F.desc("n"), "word").limit(most).select("word").toPandas()["word"]
    rank = ranks(vocabulary)
    data = lexicon.to_bytes(lexicon.build({bytes(w): merge(bytes(w), rank) for w in top}))
    uri = run_dir(spark, "lexicon") + "/words.lex"
    path = local_path(uri)
    if path:
        os.makedirs(os.path.dirname(path), exist_ok=True)
        with open(path, "wb") as f:
            f.write(data)
    else:
        fs, at = hadoop(spark, uri)
        out = fs.create(at)
        out.write(bytearray(data))
        out.close()
        spark.sparkContext.addFile(uri)
    return uri


@lru_cache(maxsize=2)
def _opened(uri: str) -> lexicon.Lexicon:
    path = local_path(uri)
    if path is None:
        from pyspark import SparkFiles

        path = SparkFiles.get(uri.rsplit("/", 1)[1])
    return lexicon.Lexicon(path)


class Encoder:
    """Encodes texts batch by batch, through a lexicon and by merging what it lacks."""

    def __init__(self, uri: str, vocabulary: str = VOCABULARY, remember: int = 300_000):
        self.lex, self.rank, self.remember = _opened(uri), ranks(vocabulary), remember
        self.known: dict[str, list[int]] = {}

    def learn(self, new: list[str]) -> None:
        """Ids of words not met before: looked up all at once, else merged."""
        raw = [w.encode() for w in new]
        for w, b, p in zip(new, raw, self.lex.places(raw).tolist()):
            self.known[w] = self.lex.of(p) if p >= 0 else merge(b, self.rank)

    def encode(self, texts: list[str | None]) -> list[list[int]]:
        if len(self.known) > self.remember:
            self.known = {}
        cut = [words(t) if t else [] for t in texts]
        fresh = set().union(*cut) - self.known.keys() if cut else set()
        if fresh:
            self.learn(list(fresh))
        known = self.known
        return [[i for w in ws for i in known[w]] for ws in cut]


def _grouped(batches, chars: int = 2_000_000):
    """Parts of Arrow batches of about so many characters of their second column."""
    import pyarrow.compute as pc

    for b in batches:
        if not b.num_rows:
            continue
        size = pc.fill_null(pc.utf8_length(b.column(1)), 0).to_numpy(zero_copy_only=False).cumsum()
        a = 0
        while a < b.num_rows:
            z = int(size.searchsorted((size[a - 1] if a else 0) + chars, "right"))
            z = max(z, a + 1)
            yield b.slice(a, z - a)
            a = z


def encode(df: DataFrame, key: str, column: str = "text", *, lexicon_uri: str | None = None, vocabulary: str = VOCABULARY) -> DataFrame:
    """key, ids array<int>: every row's text encoded, special-token strings as ordinary text.

    Null and empty texts both give an empty list. Rows are kept one for one, repeated
    and null keys too; other columns are left aside. Texts of any length are encoded
    whole. Needs no shuffle besides the lexicon's word counts.
    """
    uri = lexicon_uri or build_lexicon(df, column, vocabulary=vocabulary)

    def run(batches):
        import pyarrow as pa

        enc = Encoder(uri, vocabulary)
        for b in _grouped(batches):
            ids = enc.encode(b.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(ids, pa.list_(pa.int32()))], names=[key, "ids"])

    schema = T.StructType([T.StructField(key, df.schema[key].dataType), T.StructField("ids", T.ArrayType(T.IntegerType()))])
    return df.select(F.col(key), F.col(column).cast("string")).mapInArrow(run, schema)


def token_counts(df: DataFrame, key: str, column: str = "text", *, lexicon_uri: str | None = None, vocabulary: str = VOCABULARY) -> DataFrame:
    """key, n_tokens int: lengths of what ``encode`` gives, without moving the ids."""
    uri = lexicon_uri or build_lexicon(df, column, vocabulary=vocabulary)

    def run(batches):
        import pyarrow as pa

        enc = Encoder(uri, vocabulary)
        for b in _grouped(batches):
            n = [len(x) for x in enc.encode(b.column(1).to_pylist())]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int32())], names=[key, "n_tokens"])

    schema = T.StructType([T.StructField(key, df.schema[key].dataType), T.StructField("n_tokens", T.IntegerType())])
    return df.select(F.col(key), F.col(column).cast("string")).mapInArrow(run, schema)


def decode(ids: list[int], vocabulary: str = VOCABULARY) -> str:
    """The text of ids; the inverse of encoding."""
    back = _inverse(vocabulary)
    return b"".join(back[i] for i in ids).decode()


@lru_cache(maxsize=2)
def _inverse(vocabulary: str) -> dict[int, bytes]:
    return {i: b for b, i in ranks(vocabulary).items()}


