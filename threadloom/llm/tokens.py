"""Token ids of public vocabularies, for use inside Arrow tasks.

The ids are those of the ``tokenizers`` library. For text of plain Latin, Greek and
Cyrillic characters, where the two libraries split alike, ``tiktoken`` gives the same ids
from the same vocabulary in a third of the time; any other text goes to ``tokenizers``.
"""

from __future__ import annotations

import json
import os
import re
from array import array
from functools import lru_cache

import numpy as np

#: The vocabulary that token-id operators use, and the folder's own name for it.
VOCABULARY = "byte_bpe_50k.json"
#: A vocabulary that spells characters it lacks byte by byte.
PIECE_VOCABULARY = "piece_bpe_32k.model"
#: Id 1 ends every document.
END_ID = 1

#: Fixed value: the split rule of the byte-level vocabulary.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

_not_plain = re.compile(r"[^\t\n\r\x20-\x7e\xa1-\u0377\u0384-\u052f\u2010-\u2027]")


def vocabulary_path(name: str) -> str:
    """Place of a public vocabulary file; an absolute path stands for itself."""
    if os.path.isabs(name):
        return name
    import public_tokenizers

    return public_tokenizers.path(name)


def _byte_of() -> dict[str, int]:
    """Byte of each character by which a byte-level vocabulary writes it.

    Printable Latin-1 characters stand for themselves, the other bytes for the
    characters from U+0100 on, in order.
    """
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(0x100 + i): b for i, b in enumerate(hidden)}


class ByteBpe:
    """Ids of one byte-level BPE vocabulary."""

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import tiktoken
        from tokenizers import Tokenizer

        self._exact = Tokenizer.from_file(path)
        self._exact.encode_special_tokens = True
        with open(path, encoding="utf-8") as file:
            described = json.load(file)
        special = {x["content"] for x in described["added_tokens"]}
        byte_of = _byte_of()
        ranks = {bytes(byte_of[c] for c in token): rank for token, rank in described["model"]["vocab"].items() if token not in special}
        self._bytes = {rank: token for token, rank in ranks.items()} | {x["id"]: x["content"].encode() for x in described["added_tokens"]}
        self._fast = tiktoken.Encoding("plain", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={})
        wide = self._exact.get_vocab_size() > 1 << 16
        self.size = self._exact.get_vocab_size()
        self._code, self.dtype = ("I", np.dtype("<u4")) if wide else ("H", np.dtype("<u2"))

    def token_bytes(self) -> list[bytes]:
        """The bytes that each id stands for."""
        return [self._bytes.get(i, b"") for i in range(self.size)]

    def encode(self, text: str) -> list[int]:
        if _not_plain.search(text):
            return self._exact.encode(text, add_special_tokens=False).ids
        return self._fast.encode_ordinary(text)

    def packed(self, text: str) -> bytes:
        """Ids of a whole text as little-endian integers of ``dtype``."""
        return array(self._code, self.encode(text)).tobytes()

    def ids(self, text: str) -> np.ndarray:
        return np.frombuffer(self.packed(text), dtype=self.dtype)


@lru_cache(maxsize=4)
def byte_bpe(path: str) -> ByteBpe:
    """One tokenizer for each worker process and vocabulary."""
    return ByteBpe(path)


@lru_cache(maxsize=4)
def piece_alphabet(path: str) -> frozenset[str]:
    """Characters that a sentencepiece vocabulary has as pieces, so need no byte pieces."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces = (model.id_to_piece(i) for i in range(model.get_piece_size()) if not model.is_byte(i))
    return frozenset(x for x in pieces if len(x) == 1)
