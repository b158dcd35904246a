"""Token ids of whole texts under a public byte-level BPE vocabulary, word by word.

A text in which every white-space character stands alone falls apart at its
spaces and line ends into chunks whose tokens do not depend on each other, so
ids are kept per chunk. Plain Latin chunks are encoded by the rank encoder,
everything else, and texts with runs of white space or special strings, by the
library of the vocabulary file itself.
"""

from __future__ import annotations

import json
import re
import sys
import types
from array import array
from collections.abc import Callable
from typing import Any

VOCABULARY = "byte_bpe_50k.json"
#: Chunks kept per Python worker; beyond it the table is emptied and filled anew.
KEPT_CHUNKS = 400_000
LONG_CHUNK = 1000
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
SPACES = re.compile(r"\s\s")
#: Characters on whose class all encoders agree.
OTHER = re.compile(r"[^\t\n\x20-\x7e\xa1-ɏ]")


def kept(name: str, make: Callable[[], Any]) -> Any:
    """A value made once per Python process and kept for its later tasks."""
    store = sys.modules.setdefault("_sightline_kept", types.ModuleType("_sightline_kept")).__dict__
    if name not in store:
        store[name] = make()
    return store[name]


def vocabulary_path(path: str | None) -> str:
    """The given file, or the public one."""
    if path:
        return path
    import public_tokenizers

    return public_tokenizers.path(VOCABULARY)


def byte_ranks(path: str) -> tuple[dict[bytes, int], list[str]]:
    """Tokens as bytes with their ids, and the special strings, from a byte-level BPE file."""
    with open(path, encoding="utf-8") as file:
        spec = json.load(file)
    special = [t["content"] for t in spec["added_tokens"]]
    # Printable bytes stand for themselves, the others for code points from 256 on.
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letters = {chr(b): b for b in plain}
    letters |= {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in set(plain))}
    vocab = {t: i for t, i in spec["model"]["vocab"].items() if t not in special}
    return {bytes(letters[c] for c in t): i for t, i in vocab.items()}, special


class Encoder:
    """Ids of texts as little-endian unsigned 32-bit bytes."""

    def __init__(self, path: str | None = None):
        import tiktoken

        self.path = vocabulary_path(path)
        self.ranks, self.special = byte_ranks(self.path)
        self.plain = tiktoken.Encoding("plain", pat_str=PATTERN, mergeable_ranks=self.ranks, special_tokens={})
        self.piece_ids = self.plain._core_bpe.encode_single_piece
        self._whole = None
        self.chunks = Chunks(self.encode_chunk)

    @property
    def whole(self):
        """The library of the vocabulary file, loaded when first needed."""
        if self._whole is None:
            from tokenizers import Tokenizer

            self._whole = Tokenizer.from_file(self.path)
            self._whole.no_truncation()
            self._whole.no_padding()
        return self._whole

    def has_special(self, text: str) -> bool:
        return any(s in text for s in self.special)

    def encode(self, text: str) -> bytes:
        """Ids of any string, encoded as one."""
        if OTHER.search(text) or self.has_special(text) or (len(text) > LONG_CHUNK and " " not in text):
            ids = self.whole.encode(text, add_special_tokens=False).ids
        else:
            ids = self.plain.encode_ordinary(text)
        return array("I", ids).tobytes()

    def encode_chunk(self, chunk: str) -> bytes:
        """Ids of a chunk of a text without special strings; a plain word is one piece."""
        if chunk.isalpha() and is_plain(chunk):
            return array("I", self.piece_ids(b" " + chunk.encode())).tobytes()
        return self.encode(chunk_text(chunk))

    def ids(self, text: str) -> bytes:
        if SPACES.search(text) or self.has_special(text):
            return self.encode(text)
        first, *rest = split_chunks(text)
        return self.encode(first) + b"".join(map(self.chunks.__getitem__, rest))


def is_plain(text: str) -> bool:
    return len(text) <= LONG_CHUNK and (text.isascii() or max(text) <= "ɏ") and not OTHER.search(text)


def split_chunks(text: str) -> list[str]:
    """The opening of a text, then its chunks without their space; those that begin with a line end have none."""
    return text.replace("\n", " \n").split(" ")


def chunk_text(chunk: str) -> str:
    return chunk if chunk.startswith("\n") else " " + chunk


class Chunks(dict):
    """What ``make`` gives for a chunk, kept for a bounded number of chunks."""

    def __init__(self, make: Callable[[str], bytes]):
        super().__init__()
        self.make = make

    def __missing__(self, chunk: str) -> bytes:
        if len(self) >= KEPT_CHUNKS:
            self.clear()
        value = self.make(chunk)
        if len(chunk) <= LONG_CHUNK:
            self[chunk] = value
        return value


def encoder(path: str | None) -> Encoder:
    return kept(f"encoder {path}", lambda: Encoder(path))
