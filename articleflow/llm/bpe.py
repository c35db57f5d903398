"""Tokenizer files as small values that travel with a task, and their encoders inside it."""

from __future__ import annotations

import base64
import hashlib
import json
import os
from dataclasses import dataclass
from functools import cached_property, lru_cache
from pathlib import Path

import numpy as np

# Fixed value: the pattern byte-level BPE splits text by before its merges.
BYTE_LEVEL_PATTERN = (
    r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
)


@dataclass(frozen=True)
class Tokenizer:
    """A vocabulary file by content: ``kind`` is its suffix, ``pattern`` splits text for rank files."""

    kind: str
    content: bytes
    pattern: str = BYTE_LEVEL_PATTERN

    @classmethod
    def read(cls, path: str, pattern: str = BYTE_LEVEL_PATTERN) -> Tokenizer:
        return cls(Path(path).suffix[1:], Path(path).read_bytes(), pattern)

    @cached_property
    def digest(self) -> str:
        """Names this version: the same digest gives the same tokens."""
        return hashlib.sha256(f"{self.kind}\0{self.pattern}\0".encode() + self.content).hexdigest()

    def encoder(self) -> Encoder:
        return _encoder(self)


class Encoder:
    """Ids of a text, without added special tokens; special strings in it as the library's default."""

    def ids(self, text: str) -> np.ndarray:
        raise TypeError("use Tokenizer.encoder()")


class RankEncoder(Encoder):
    def __init__(self, ranks: dict[bytes, int], pattern: str, special: dict[str, int]):
        import tiktoken

        self.ranks = ranks
        self._allowed = set(special)
        self._encoding = tiktoken.Encoding(
            "own", pat_str=pattern, mergeable_ranks=ranks, special_tokens=special
        )

    def ids(self, text: str) -> np.ndarray:
        return self._encoding.encode_to_numpy(
            text, allowed_special=self._allowed, disallowed_special=()
        )


class LibraryEncoder(Encoder):
    def __init__(self, content: bytes):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer as Library

        self._library = Library.from_str(content.decode())
        self._library.no_truncation()
        self._library.no_padding()

    def ids(self, text: str) -> np.ndarray:
        return np.array(self._library.encode(text, add_special_tokens=False).ids, np.uint32)


class PieceEncoder(Encoder):
    def __init__(self, content: bytes):
        import sentencepiece

        self._library = sentencepiece.SentencePieceProcessor(model_proto=content)

    def ids(self, text: str) -> np.ndarray:
        return np.array(self._library.encode(text), np.uint32)


@lru_cache(maxsize=2)
def _encoder(tokenizer: Tokenizer) -> Encoder:
    if tokenizer.kind == "model":
        return PieceEncoder(tokenizer.content)
    if tokenizer.kind == "tiktoken":
        lines = map(bytes.split, tokenizer.content.splitlines())
        ranks = {base64.b64decode(word): int(rank) for word, rank in lines}
        return RankEncoder(ranks, tokenizer.pattern, {})
    return ranked(tokenizer.content) or LibraryEncoder(tokenizer.content)


def ranked(content: bytes) -> RankEncoder | None:
    """A rank encoder equal to a ``.json`` file of plain byte-level BPE, several times as fast.

    Plain: no normalizer, the byte-level pattern, merges in the order of their ids, and special
    tokens that take no white space with them. Any other file gives None.
    """
    file = json.loads(content)
    model, split = file["model"], file.get("pre_tokenizer") or {}
    added = file.get("added_tokens", [])
    plain = (
        model.get("type", "BPE") == "BPE"
        and not any(
            model.get(k)
            for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "ignore_merges")
        )
        and file.get("normalizer") is None
        and split.get("type") == "ByteLevel"
        and not split.get("add_prefix_space")
        and split.get("use_regex", True)
        and not any(t.get("lstrip") or t.get("rstrip") or t.get("single_word") for t in added)
    )
    if not plain:
        return None
    vocabulary = model["vocab"]
    special = {t["content"]: t["id"] for t in added}
    letters = _byte_letters()
    ranks = {
        bytes(letters[c] for c in word): rank
        for word, rank in vocabulary.items()
        if word not in special
    }
    merged = ["".join(m if isinstance(m, list) else m.split(" ")) for m in model["merges"]]
    at = [vocabulary[word] for word in merged]
    if at != sorted(at) or len(ranks) != 256 + len(set(merged)):
        return None
    return RankEncoder(ranks, BYTE_LEVEL_PATTERN, special)


def _byte_letters() -> dict[str, int]:
    """The letter that byte-level files write for each byte: itself if printable, else from 256 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + n): b for n, b in enumerate(hidden)}
