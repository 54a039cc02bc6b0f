"""Byte-level BPE by the tokenizers library, from a table of ranks, and back.

Encoding.  The ranks become a library model: each byte is mapped to a printable character
(the usual byte-to-character table), tokens are strings of those, and the merges are all
ways to cut a token into two others, in the order of the ranks.  A text is cut by the
piece pattern and each piece goes through ``model.tokenize``; a piece that is a token
itself is not merged.  Texts arrive and leave as Arrow batches.

A text is first cut before each single space, where no match of the pattern can cross, and
each such word is looked up in a bounded cache, so only new words are encoded.  Words that
begin or end with white space could join a run of it with their neighbours: such a text is
cut by the pattern as a whole.

Decoding looks up each id's bytes; the bytes are joined before they become text, so a
character that is split over tokens comes out whole.  ``offsets`` gives each token's first
byte, and ``char_offsets`` its first character (a token that begins inside a character has
that character's number).

Null and empty texts have no tokens; repeated rows each give a row; other columns are not
read.
"""

from __future__ import annotations

import base64
import hashlib
import re

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from tokenizers import Regex, Tokenizer, models, pre_tokenizers

from postlens.llm.byte_chars import BYTE_CHARS
from postlens.llm.common import BoundedCache, map_arrow, pack_ids, table
from postlens.llm.registry import register

RANKS = "byte_bpe_multi_50k.tiktoken"
CACHE_WORDS = 500_000
#: public_tokenizers.PATTERN for texts of printable ASCII
_ASCII = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?[A-Za-z]+| ?[0-9]+| ?[^\s0-9A-Za-z]+|\s+(?!\S)|\s+", re.A)


class ByteBpe:
    def __init__(self, file: str = RANKS, pattern: str = public_tokenizers.PATTERN):
        with open(public_tokenizers.path(file), "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        text = lambda b: b.decode("latin-1").translate(BYTE_CHARS)
        merges = [(text(t[:i]), text(t[i:])) for t in sorted(ranks, key=ranks.get)
                  for i in range(1, len(t)) if t[:i] in ranks and t[i:] in ranks]
        self.model = models.BPE(vocab={text(t): r for t, r in ranks.items()}, merges=merges, ignore_merges=True)
        self.library = Tokenizer(self.model)
        self.library.pre_tokenizer = pre_tokenizers.Sequence([
            pre_tokenizers.Split(Regex(pattern), "isolated"),
            pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        self.ascii = _ASCII if pattern == public_tokenizers.PATTERN else None
        self.latin = regex.compile(pattern)
        # decoding table: the bytes of all tokens in a row, and where each begins
        tokens = [b""] * (max(ranks.values()) + 1)
        for t, r in ranks.items():
            tokens[r] = t
        self.size = np.array([len(t) for t in tokens], np.int64)
        self.begin = np.cumsum(self.size) - self.size
        self.bytes = np.frombuffer(b"".join(tokens), np.uint8)
        self.cache, self.head = _Words(self, " "), _Words(self, "")

    def plain(self, text: str) -> bytes:
        """Ids (little-endian, 32 bits) of a text, each match of the pattern by itself."""
        if self.ascii is not None and text.isascii():
            pieces = [p.translate(BYTE_CHARS) for p in self.ascii.findall(text)]
        elif max(text) < "\u0250" and text.isprintable():   # no white space but spaces
            pieces = [p.encode().decode("latin-1").translate(BYTE_CHARS) for p in self.latin.findall(text)]
        else:
            pieces = [p for p, _ in self.library.pre_tokenizer.pre_tokenize_str(text)]
        tokenize = self.model.tokenize
        return pack_ids([t.id for p in pieces for t in tokenize(p)])

    def encode(self, text: str | None) -> bytes:
        if not text:
            return b""
        words = text.split(" ")
        try:
            return self.head[words[0]] + b"".join(map(self.cache.__getitem__, words[1:]))
        except Unsafe:
            return self.plain(text)

    def decode(self, ids: np.ndarray) -> bytes:
        size = self.size[ids]
        end = np.cumsum(size)
        if not len(end):
            return b""
        return self.bytes[np.arange(end[-1]) + np.repeat(self.begin[ids] - end + size, size)].tobytes()

    def offsets(self, ids: np.ndarray) -> np.ndarray:
        return np.cumsum(self.size[ids]) - self.size[ids]

    def char_offsets(self, ids: np.ndarray) -> np.ndarray:
        raw = np.frombuffer(self.decode(ids), np.uint8)
        char = np.cumsum((raw & 0xC0) != 0x80) - 1
        return char[self.offsets(ids)] if len(ids) else np.zeros(0, np.int64)


class Unsafe(Exception):
    """A word that can't be encoded apart from its neighbours."""


class _Words(BoundedCache):
    def __init__(self, bpe: ByteBpe, before: str):
        super().__init__(CACHE_WORDS if before else CACHE_WORDS // 20)
        self.bpe, self.before = bpe, before

    def __missing__(self, word: str) -> bytes:
        if not word or word[0].isspace() or word[-1].isspace():
            raise Unsafe
        ids = self.bpe.plain(self.before + word)
        return self.put(word, ids) if len(word) <= 64 else ids


_READY: dict[str, ByteBpe] = {}


def _bpe(file: str) -> ByteBpe:
    if file not in _READY:
        _READY[file] = ByteBpe(file)
    return _READY[file]


def encode(df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", ranks: str = RANKS) -> DataFrame:
    """(id, ids array<int>, offsets array<long> in bytes, char_offsets array<long>) per row."""
    def fn(b: pa.RecordBatch) -> pa.RecordBatch:
        bpe = _bpe(ranks)
        ids = [np.frombuffer(bpe.encode(x.as_py()), "<u4").astype(np.int32) for x in b.column(1)]
        return pa.RecordBatch.from_arrays(
            [b.column(0), pa.array(ids, pa.list_(pa.int32())),
             pa.array([bpe.offsets(i) for i in ids], pa.list_(pa.int64())),
             pa.array([bpe.char_offsets(i) for i in ids], pa.list_(pa.int64()))],
            ["id", "ids", "offsets", "char_offsets"])
    src = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    return map_arrow(src, fn, "id long, ids array<int>, offsets array<long>, char_offsets array<long>", keep_caches=True)


def decode(df: DataFrame, *, id_col: str = "id", ids_col: str = "ids", ranks: str = RANKS) -> DataFrame:
    """(id, raw binary, text string): text has U+FFFD where the bytes are not UTF-8; null
    ids give null."""
    def fn(b: pa.RecordBatch) -> pa.RecordBatch:
        bpe = _bpe(ranks)
        raw = [bpe.decode(np.asarray(x.values, np.int64)) if x.is_valid else None for x in b.column(1)]
        return pa.RecordBatch.from_arrays(
            [b.column(0), pa.array(raw, pa.binary()),
             pa.array([r if r is None else r.decode("utf-8", "replace") for r in raw], pa.string())],
            ["id", "raw", "text"])
    src = df.select(F.col(id_col).cast("long").alias("id"), F.col(ids_col).alias("ids"))
    return map_arrow(src, fn, "id long, raw binary, text string", keep_caches=True)


def round_trip(df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", ranks: str = RANKS) -> DataFrame:
    """Encodes each text, decodes its ids, and returns (id, n_tokens, ids_sha256,
    decoded_sha256): the digests of both without the arrays, for whole tables."""
    def fn(b: pa.RecordBatch) -> pa.RecordBatch:
        bpe = _bpe(ranks)
        sha = lambda x: hashlib.sha256(x).hexdigest()
        n, ids_sha, raw_sha = [], [], []
        for x in b.column(1):
            blob = bpe.encode(x.as_py())
            n.append(len(blob) // 4)
            ids_sha.append(sha(blob))
            raw_sha.append(sha(bpe.decode(np.frombuffer(blob, "<u4"))))
        return pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(ids_sha, pa.string()),
                                           pa.array(raw_sha, pa.string())],
                                          ["id", "n_tokens", "ids_sha256", "decoded_sha256"])
    src = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    return map_arrow(src, fn, "id long, n_tokens long, ids_sha256 string, decoded_sha256 string", keep_caches=True)


@register("op8_byte_bpe")
def op8_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: token count, digest of the ids, digest of the decoded bytes."""
    return round_trip(table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")
