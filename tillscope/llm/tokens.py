"""Token ids of whole texts by a public byte-level BPE.

Texts are encoded from the rank file of the vocabulary, by the library that writes ids straight
into a buffer; ids are those of the vocabulary's tokenizer file, special tokens included
(tested). Nothing is remembered between texts, so a worker's memory is that of the vocabulary.
"""

from __future__ import annotations

import base64
from functools import lru_cache

import numpy as np

RANKS = "byte_bpe_50k.tiktoken"
SPECIAL = {"<|endoftext|>": 50256}  # fixed values: special tokens of that vocabulary


def tokenizer_path(name: str = RANKS) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class Encoder:
    def __init__(self, path: str):
        import public_tokenizers
        import tiktoken

        with open(path, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.bpe = tiktoken.Encoding("corpus", pat_str=public_tokenizers.PATTERN,
                                     mergeable_ranks=ranks, special_tokens=SPECIAL)

    def ids(self, text: str | None) -> np.ndarray:
        """The ids of the whole text, unsigned 32-bit; null and empty texts have none."""
        return self.bpe.encode_to_numpy(text, allowed_special="all") if text else \
            np.empty(0, np.uint32)

    def encode(self, text: str | None) -> bytes:
        """The same as little-endian bytes."""
        return self.ids(text).astype("<u4").tobytes()


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    """The worker's encoder, loaded once."""
    return Encoder(path)
