"""Encoding of a corpus with a public byte-level BPE tokenizer by forced boundaries.

Two bytes that never stand side by side inside any vocabulary token can't be
merged, so the text may be cut between them.  Of these pairs the ones are used
whose left byte is an ASCII character other than white space and whose right
byte is ASCII white space: there the pre-tokenizer splits too, whatever stands
around, as no pre-token holds white space after another character.  Fragments
between certain cuts are encoded independently and concatenated.

A corpus repeats its fragments, so each Arrow batch is cut by one table lookup
over its bytes, its fragments are dictionary-encoded, only distinct ones go
through the tokenizer, and the ids are gathered back with array arithmetic.  No
shuffle; memory is bound by ``SLICE_BYTES`` of text (or one longer text) at a time.

Defined results of edge cases
* null text and empty text: an empty list of ids (count 0)
* text without any certain cut: one fragment, whole
* strings that look like special tokens: ordinary text
* repeated rows and null ids: every row is encoded and keeps its id
"""

from __future__ import annotations

import base64
import importlib.util
import os

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TOKENIZER_DIR = os.environ.get("SEQLOOM_TOKENIZERS", "/opt/tokenizers")
VOCABULARY = "byte_bpe_50k.tiktoken"
SLICE_BYTES = 8 << 20
CACHE_ENTRIES = 500_000

#: Fixed value: the public pre-tokenizer pattern of these vocabularies.
SPLIT_PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

WHITE = np.zeros(256, bool)
WHITE[[9, 10, 11, 12, 13, 32]] = True


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


def certain_cuts(vocabulary) -> np.ndarray:
    """256 x 256 table, flat: True where a text may be cut between left and right byte."""
    inside = np.zeros(65536, bool)
    for token in vocabulary:
        if len(token) > 1:
            b = np.frombuffer(token, np.uint8)
            inside[b[:-1].astype(np.uint32) * 256 + b[1:]] = True
    left = ~WHITE
    left[128:] = False
    return ~inside & (left[:, None] & WHITE[None, :]).reshape(-1)


class FragmentEncoder:
    """Encodes texts fragment by fragment; one for each Python worker and vocabulary."""

    _made: dict[str, FragmentEncoder] = {}

    def __init__(self, path: str):
        import tiktoken

        ranks = load_ranks(path)
        self.cuts = certain_cuts(ranks)
        self.encoding = tiktoken.Encoding("own", pat_str=SPLIT_PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.cache: dict[bytes, np.ndarray] = {}

    @classmethod
    def of(cls, path: str) -> FragmentEncoder:
        if path not in cls._made:
            cls._made[path] = cls(path)
        return cls._made[path]

    def _encode(self, fragment: bytes) -> np.ndarray:
        ids = self.cache.get(fragment)
        if ids is None:
            ids = np.array(self.encoding.encode_ordinary(fragment.decode("utf-8")), np.int32)
            if len(fragment) <= 64:
                self.cache[fragment] = ids
        return ids

    def encode(self, data: np.ndarray, starts: np.ndarray, counts_only: bool = False):
        """``data``: bytes of all texts on end; ``starts``: n + 1 offsets.  Returns (ids, offsets),
        or the counts alone."""
        n = len(starts) - 1
        if len(data) == 0:
            return np.zeros(n, np.int64) if counts_only else (np.zeros(0, np.int32), np.zeros(n + 1, np.int64))
        is_cut = np.empty(len(data) + 1, bool)
        is_cut[0] = is_cut[-1] = True
        is_cut[1:-1] = self.cuts[data[:-1].astype(np.uint16) * np.uint16(256) + data[1:]]
        is_cut[starts] = True
        offsets = np.flatnonzero(is_cut).astype(np.int32)
        fragments = pa.BinaryArray.from_buffers(
            pa.binary(), len(offsets) - 1, [None, pa.py_buffer(offsets), pa.py_buffer(data)]
        ).dictionary_encode()
        which = fragments.indices.to_numpy()
        if len(self.cache) > CACHE_ENTRIES:
            self.cache.clear()
        known = [self._encode(f) for f in fragments.dictionary.to_pylist()]
        lengths = np.fromiter(map(len, known), np.int64, len(known))
        each = lengths[which]
        ends = np.concatenate([[0], np.cumsum(each)])
        bounds = ends[np.searchsorted(offsets, starts)]
        if counts_only:
            return np.diff(bounds)
        flat = np.concatenate(known)
        begin = np.cumsum(lengths) - lengths
        place = np.repeat(begin[which] - ends[:-1], each) + np.arange(ends[-1])
        return flat[place], bounds


def text_slices(texts: pa.Array, slice_bytes: int = SLICE_BYTES):
    """(first row, last row, bytes, offsets) of consecutive rows with at most ``slice_bytes``
    together, or one longer row.  Null counts as empty."""
    texts = pa.compute.fill_null(texts, "") if texts.null_count else texts
    size = np.int64 if pa.types.is_large_string(texts.type) else np.int32
    offsets = np.frombuffer(texts.buffers()[1], size)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    body = texts.buffers()[2]
    data = np.frombuffer(body, np.uint8) if body is not None else np.zeros(0, np.uint8)
    at = 0
    while at < len(texts):
        end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + slice_bytes, "right")) - 1)
        end = min(end, len(texts))
        lo, hi = offsets[at], offsets[end]
        yield at, end, np.ascontiguousarray(data[lo:hi]), offsets[at : end + 1] - lo
        at = end


def vocabulary_path(name: str = VOCABULARY, folder: str | None = None) -> str:
    folder = folder or TOKENIZER_DIR
    if not os.path.exists(os.path.join(folder, name)):
        spec = importlib.util.find_spec("public_tokenizers")
        if spec and spec.origin:
            folder = os.path.dirname(spec.origin)
    return os.path.join(folder, name)


def encode_corpus(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None) -> DataFrame:
    """(id, ids ARRAY<INT>) of every row; ``path`` names a rank file that every executor can read."""
    path = path or vocabulary_path()

    def run(batches):
        encoder = FragmentEncoder.of(path)
        for batch in batches:
            for a, b, data, starts in text_slices(batch.column(1)):
                ids, bounds = encoder.encode(data, starts)
                lists = pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(ids))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), lists], names=["_id", "ids"])

    kind = docs.schema[id_col].dataType.simpleString()
    out = docs.select(F.col(id_col).alias("_id"), F.col(text_col).cast("string").alias("_text")).mapInArrow(
        run, f"_id {kind}, ids array<int>"
    )
    return out.withColumnRenamed("_id", id_col)


def count_tokens(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None) -> DataFrame:
    """(id, n_tokens) of every row, without building the lists."""
    path = path or vocabulary_path()

    def run(batches):
        encoder = FragmentEncoder.of(path)
        for batch in batches:
            for a, b, data, starts in text_slices(batch.column(1)):
                n = encoder.encode(data, starts, counts_only=True)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(n)], names=["_id", "n_tokens"])

    kind = docs.schema[id_col].dataType.simpleString()
    out = docs.select(F.col(id_col).alias("_id"), F.col(text_col).cast("string").alias("_text")).mapInArrow(
        run, f"_id {kind}, n_tokens bigint"
    )
    return out.withColumnRenamed("_id", id_col)
