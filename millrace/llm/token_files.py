"""Loading of public tokenizer files; their folder is a parameter, and nothing is copied into the repository."""

from __future__ import annotations

import base64
from functools import lru_cache

import tiktoken

FOLDER, FILE = "/opt/tokenizers", "byte_bpe_50k.tiktoken"
#: How the byte-level vocabularies split a text before merging.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


@lru_cache(maxsize=4)
def encoding(folder: str = FOLDER, file: str = FILE) -> tiktoken.Encoding:
    """One a worker process."""
    with open(f"{folder}/{file}", "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding(file, pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


@lru_cache(maxsize=4)
def token_lengths(folder: str = FOLDER, file: str = FILE):
    """Bytes of each token id."""
    import numpy as np

    enc = encoding(folder, file)
    out = np.zeros(enc.n_vocab, np.int32)
    for b, i in enc._mergeable_ranks.items():
        out[i] = len(b)
    return out
