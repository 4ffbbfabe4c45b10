"""Token ids of texts under a public byte-level BPE vocabulary, read from a file; its path is a parameter everywhere."""

from __future__ import annotations

import base64

import numpy as np
import tiktoken
import tiktoken.registry

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def encoder(path: str = VOCABULARY) -> tiktoken.Encoding:
    """The tokenizer of a vocabulary of base64 tokens and their ranks, a pair to a line. The library's registry keeps one for each process."""
    known = tiktoken.registry.ENCODINGS
    if path not in known:
        with open(path, "rb") as lines:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
        known[path] = tiktoken.Encoding(path, pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return known[path]


def ids(text: str | None, path: str = VOCABULARY) -> np.ndarray:
    """A text's ids, uint32; of a null or empty text none. Strings that look like special tokens are ordinary text."""
    return np.asarray(encoder(path).encode_to_numpy(text, disallowed_special=()), np.uint32) if text else np.zeros(0, np.uint32)
