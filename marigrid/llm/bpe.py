"""Byte-level BPE ids of a public vocabulary, word by word through a bounded cache."""

from __future__ import annotations

import json
import re

import numpy as np

#: Distinct words that a worker keeps.
CACHED_WORDS = 300_000
_TWO = re.compile(r"\s\s")


def byte_alphabet() -> dict[str, int]:
    """The characters that stand for bytes in byte-level vocabularies: printable ones for themselves, others from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(other)}


def read_vocabulary(path: str) -> tuple[dict[bytes, int], dict[str, int]]:
    """(bytes of ordinary tokens -> id, special tokens -> id) of a ``tokenizers`` file."""
    with open(path, encoding="utf-8") as f:
        model = json.load(f)
    alphabet = byte_alphabet()
    special = {t["content"]: t["id"] for t in model.get("added_tokens", []) if t.get("special")}
    return {bytes(alphabet[c] for c in t): i for t, i in model["model"]["vocab"].items() if t not in special}, special


class Encoder:
    """``encode(text)``: the ids as little-endian unsigned 32-bit integers in bytes.

    The ids equal those of ``tokenizers`` with add_special_tokens=False. The pattern that splits texts never
    joins across a single blank between two other characters, so a text is cut there and each word with its
    blank is looked up. Texts with adjoining white space are encoded whole.
    """

    def __init__(self, path: str):
        import public_tokenizers
        import tiktoken

        ranks, self.special = read_vocabulary(path)
        self.bpe = tiktoken.Encoding("vocabulary", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=self.special)
        self.cache = _Words(self)

    def pack(self, text: str) -> bytes:
        return np.asarray(self.bpe.encode_ordinary(text), "<u4").tobytes()

    def encode(self, text: str | None) -> bytes:
        if not text:
            return b""
        if any(s in text for s in self.special):
            return np.asarray(self.bpe.encode(text, allowed_special="all"), "<u4").tobytes()
        if _TWO.search(text) or text[0].isspace() or text[-1].isspace():
            return self.pack(text)
        head, *rest = text.split(" ")
        return self.pack(head) + b"".join(map(self.cache.__getitem__, rest))


class _Words(dict):
    def __init__(self, owner: Encoder):
        super().__init__()
        self.owner = owner

    def __missing__(self, word: str) -> bytes:
        if len(self) >= CACHED_WORDS:
            self.clear()
        self[word] = ids = self.owner.pack(" " + word)
        return ids


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """The worker's encoder for ``path``."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]
