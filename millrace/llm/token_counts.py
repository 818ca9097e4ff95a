"""Token counts: overlap resynchronisation.

A document of more than ``huge`` characters is encoded in overlapping chunks, and the encodings are spliced at a boundary
that both have and that is proven stable: a place where a letter is followed by something that is no letter. The vocabulary's
pattern splits there whatever comes before (no alternative runs from a letter on into a non-letter), and what it does from
there on looks only ahead. So the left encoding is final up to that place (the next character is in the chunk), and the
right one is that of the whole document from there on. If the overlap holds no such place, or the two encodings' token
offsets don't both have it, the left chunk is encoded again with twice the overlap, up to the document's end if need be.
So the counts are those of encoding whole documents, in memory for one chunk. Shorter documents are encoded at once.

Cases: NULL counts NULL, the empty text 0. The strings of special tokens are ordinary text. Repeated rows are counted each
for itself; an empty table gives an empty table. Other columns are not used.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.llm._shared import batches
from millrace.llm.token_files import FILE, FOLDER, encoding, token_lengths

HUGE, CHUNK, OVERLAP = 32_768, 16_384, 128


def stable_places(text: str, start: int, end: int) -> list[int]:
    """Places p with start < p < end where a letter at p - 1 is followed by no letter at p."""
    return [p for p in range(start + 1, end) if text[p - 1].isalpha() and not text[p].isalpha()]


def _encode(text: str, enc, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ids, and where each token ends in bytes."""
    ids = enc.encode_to_numpy(text, disallowed_special=()).astype(np.int32)
    return ids, np.cumsum(lengths[ids])


def encode_huge(text: str, enc, lengths: np.ndarray, chunk: int = CHUNK, overlap: int = OVERLAP) -> Iterator[np.ndarray]:
    """The ids of the whole text, in pieces."""
    start = 0  # a stable place: everything before it is encoded
    while True:
        wide, stop = overlap, start + chunk
        while True:
            end = min(len(text), stop + wide)
            ids, ends = _encode(text[start:end], enc, lengths)
            if end == len(text):
                yield ids
                return
            # the right chunk begins where the overlap does, in the middle of whatever is there
            right = text[stop : min(len(text), stop + chunk)]
            _, right_ends = _encode(right[: 2 * wide + 64], enc, lengths)
            cut = None
            for p in stable_places(text, stop, min(end, stop + len(right))):
                a, b = len(text[start:p].encode()), len(text[stop:p].encode())
                i, j = np.searchsorted(ends, a), np.searchsorted(right_ends, b)
                if i < len(ends) and ends[i] == a and j < len(right_ends) and right_ends[j] == b:
                    cut = p, int(i) + 1
                    break
            if cut:
                yield ids[: cut[1]]
                start = cut[0]
                break
            wide *= 2


def count_tokens(text: str | None, enc, lengths: np.ndarray, huge: int = HUGE, chunk: int = CHUNK, overlap: int = OVERLAP) -> int | None:
    if text is None:
        return None
    if len(text) <= huge:
        return len(enc.encode_to_numpy(text, disallowed_special=()))
    return sum(len(x) for x in encode_huge(text, enc, lengths, chunk, overlap))


def _counter(huge: int, chunk: int, overlap: int, folder: str, file: str):
    """The text is the last column; its count takes its place."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, lengths = encoding(folder, file), token_lengths(folder, file)
        for b in it:
            for b in batches([b], column=b.num_columns - 1):
                n = [count_tokens(t, enc, lengths, huge, chunk, overlap) for t in b.columns[-1].to_pylist()]
                yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(n, pa.int64())], b.schema.names)

    return run


def counted(df: DataFrame, huge: int = HUGE, chunk: int = CHUNK, overlap: int = OVERLAP, folder: str = FOLDER, file: str = FILE) -> DataFrame:
    """df, whose last column is a text, with the text's token count in that column instead."""
    schema = T.StructType([*df.schema[:-1], T.StructField(df.columns[-1], T.LongType())])
    return df.mapInArrow(_counter(huge, chunk, overlap, folder, file), schema)


def token_counts(df: DataFrame, doc_id: str = "doc_id", text: str = "text", **how) -> DataFrame:
    """(doc_id, n_tokens) of every row; ``how``: sizes and the tokenizer's file, see ``counted``."""
    return counted(df.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").alias("n_tokens")), **how)


def query(spark, sf_dir: str) -> DataFrame:
    """op7: the token count of every document."""
    return token_counts(spark.read.parquet(f"{sf_dir}/documents.parquet"))
