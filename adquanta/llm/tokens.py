"""Token ids of whole texts in a public tokenizer's vocabulary."""

from __future__ import annotations

import json
import os

import numpy as np
import public_tokenizers
import tiktoken
from tokenizers import Tokenizer

VOCABULARY = "byte_bpe_50k.json"
# Up to here the character classes of all libraries agree.
COMMON = "ɏ"


def byte_characters() -> dict[str, int]:
    """The byte behind each character of a byte-level vocabulary: printable Latin-1
    characters stand for themselves, the others follow from U+0100 on."""
    own = [b for b in range(256) if 0x21 <= b <= 0x7E or 0xA1 <= b <= 0xAC or 0xAE <= b]
    others = [b for b in range(256) if b not in own]
    return {**{chr(b): b for b in own}, **{chr(256 + i): b for i, b in enumerate(others)}}


class Encoder:
    """Encodes texts with the ids of a ``tokenizers`` file, without special tokens.

    A byte-level vocabulary lists tokens in the order of their merges, so the
    same file also serves as a rank table, and texts of common characters are
    encoded from that, several times faster with equal ids. Other texts go to
    the ``tokenizers`` library, whose character classes may be of another age.
    """

    def __init__(self, vocabulary: str = VOCABULARY):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        path = public_tokenizers.path(vocabulary)
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True  # their strings in a text are ordinary text
        self.size = self.tokenizer.get_vocab_size()
        self.dtype = np.dtype("<u2" if self.size <= 1 << 16 else "<u4")
        with open(path, encoding="utf-8") as file:
            described = json.load(file)
        special = {t["content"] for t in described["added_tokens"]}
        of = byte_characters()
        ranks = {bytes(of[c] for c in token): rank
                 for token, rank in described["model"]["vocab"].items() if token not in special}
        self.ranked = tiktoken.Encoding("ranked", pat_str=public_tokenizers.PATTERN,
                                        mergeable_ranks=ranks, special_tokens={})

    def _ids(self, text: str) -> np.ndarray:
        if text.isascii() or max(text) <= COMMON:
            return np.array(self.ranked.encode_ordinary(text), self.dtype)  # does not look for special tokens
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, self.dtype)

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Ids of each text as little-endian bytes; null is an empty text."""
        return [self._ids(t).tobytes() if t else b"" for t in texts]
