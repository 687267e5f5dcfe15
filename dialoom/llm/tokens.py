"""Encoding of texts with a public byte-level BPE vocabulary (problem 8).

Method: forced-boundary splitting. A pair of bytes that stands next to each other inside no token of the vocabulary
can't be joined by any merge, so a text may be cut there: the fragments are encoded independently (each distinct one
once, then from a cache) and their ids concatenated. A cut is not used where it could move a boundary of the
pre-tokeniser, that is after white space (its look-ahead) and before an apostrophe (its contractions); everywhere
else the pattern's classes are decided by single characters. The ids are those of the whole text.

The vocabulary file's path is a parameter; its content (under a megabyte, checked against ``MAX_FILE_BYTES``) is
broadcast, so executors need no copy of the file.

Behaviour at the edges
----------------------
* null, and empty, texts have the empty list of ids; strings that look like special tokens are ordinary text;
* texts of any length and any characters are encoded whole; repeated rows and ties get equal ids;
* an empty table gives an empty result; an existing column of the output's name is replaced, all others pass through.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
MAX_FILE_BYTES = 8 << 20
CACHE = 1 << 18
# Fixed value: the pre-tokeniser's published pattern.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
_WIDE_SPACE = re.compile("[\u0085   -     　]")


def read_vocabulary(path: str = VOCABULARY) -> bytes:
    """The content of a rank file."""
    with open(path, "rb") as f:
        content = f.read(MAX_FILE_BYTES + 1)
    if len(content) > MAX_FILE_BYTES:
        raise ValueError(f"{path} is larger than {MAX_FILE_BYTES} bytes")
    return content


class Encoder:
    """Encodes texts by forced-boundary splitting."""

    def __init__(self, vocabulary: bytes) -> None:
        import tiktoken

        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, vocabulary.splitlines()) if a}
        self.whole = tiktoken.Encoding("public", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        joined = np.zeros(1 << 16, bool)
        for token in ranks:
            t = np.frombuffer(token, np.uint8).astype(np.int32)
            joined[(t[:-1] << 8) | t[1:]] = True
        pairs = np.arange(1 << 16)
        left, right = pairs >> 8, pairs & 255
        space = np.isin(left, [*range(9, 14), *range(28, 33)])
        #: Whether a text may be cut between two bytes: no token joins them, both belong to different characters.
        self.may_cut = ~joined & ((right & 0xC0) != 0x80) & ~space & (right != 0x27)
        self.cache: dict[bytes, np.ndarray] = {}

    def fragments(self, text: str) -> list[bytes]:
        data = text.encode("utf-8", "replace")
        if len(data) < 2:
            return [data] if data else []
        b = np.frombuffer(data, np.uint8).astype(np.int32)
        cut = self.may_cut[(b[:-1] << 8) | b[1:]]
        for m in _WIDE_SPACE.finditer(text):
            end = len(text[: m.end()].encode("utf-8", "replace"))
            if end <= len(cut):
                cut[end - 1] = False
        at = [0, *(np.flatnonzero(cut) + 1).tolist(), len(data)]
        return [data[i:j] for i, j in zip(at, at[1:], strict=False)]

    def ids(self, text: str) -> list[int]:
        out: list[int] = []
        cache = self.cache
        for f in self.fragments(text):
            got = cache.get(f)
            if got is None:
                if len(cache) >= CACHE:
                    cache.clear()
                got = self.whole.encode_ordinary(f.decode("utf-8"))
                if len(f) <= 64:
                    cache[f] = got
            out += got
        return out


def _typed(df: DataFrame, out_col: str, kind: T.DataType) -> tuple[DataFrame, T.StructType]:
    kept = df.drop(out_col)
    return kept, T.StructType([*kept.schema.fields, T.StructField(out_col, kind)])


def encode(df: DataFrame, text_col: str, out_col: str = "ids", path: str = VOCABULARY, keep_text: bool = False) -> DataFrame:
    """Add the list of token ids; the text itself is dropped unless ``keep_text``."""
    shared = df.sparkSession.sparkContext.broadcast(read_vocabulary(path))
    _, full = _typed(df, out_col, T.ArrayType(T.IntegerType()))
    schema = full if keep_text else T.StructType([f for f in full.fields if f.name != text_col])
    names = [f.name for f in schema.fields if f.name != out_col]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(shared.value)
        for batch in batches:
            flat, offsets = [], [0]
            for text in batch.column(text_col).to_pylist():
                if text:
                    flat.append(np.asarray(encoder.ids(text), dtype=np.int32))
                offsets.append(offsets[-1] + (len(flat[-1]) if text else 0))
            values = np.concatenate(flat) if flat else np.zeros(0, np.int32)
            lists = pa.ListArray.from_arrays(pa.array(np.asarray(offsets, np.int32)), pa.array(values, pa.int32()))
            yield pa.RecordBatch.from_arrays([*[batch.column(n) for n in names], lists], [*names, out_col])

    return df.mapInArrow(run, T.StructType([*[f for f in schema.fields if f.name != out_col], schema[out_col]]))


def count(df: DataFrame, text_col: str, out_col: str = "tokens", path: str = VOCABULARY) -> DataFrame:
    """Replace the text by its number of tokens, 0 for null."""
    shared = df.sparkSession.sparkContext.broadcast(read_vocabulary(path))
    names = [c for c in df.columns if c not in (text_col, out_col)]
    schema = T.StructType([*[df.schema[n] for n in names], T.StructField(out_col, T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(shared.value)
        for batch in batches:
            sizes = [len(encoder.ids(t)) if t else 0 for t in batch.column(text_col).to_pylist()]
            yield pa.RecordBatch.from_arrays([*[batch.column(n) for n in names], pa.array(sizes, pa.int64())], [*names, out_col])

    return df.mapInArrow(run, schema)
