"""Public byte-level tokenizers from a rank file (tiktoken's text format); nothing is trained and nothing is downloaded."""

from __future__ import annotations

import base64

import numpy as np

_LOADED: dict[tuple[str, str | None], object] = {}


def load(path: str, pattern: str | None = None):
    """The tokenizer of the rank file at ``path``, loaded once a process. ``pattern`` splits a text before pieces are merged; by default that of the package the vocabulary files come with."""
    if (path, pattern) not in _LOADED:
        import tiktoken

        if pattern is None:
            from public_tokenizers import PATTERN as default
        with open(path, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        _LOADED[path, pattern] = tiktoken.Encoding("ranks", pat_str=pattern or default, mergeable_ranks=ranks, special_tokens={})
    return _LOADED[path, pattern]


def offsets(path: str, pattern: str | None = None):
    """A function from a text to the character offsets (start, end) of its pieces; a piece that holds a part of a character has the whole of it."""

    def of(text: str) -> list[tuple[int, int]]:
        coder = load(path, pattern)
        sizes = np.array([len(coder.decode_single_token_bytes(t)) for t in coder.encode_ordinary(text)], dtype=np.int64)
        if not len(sizes):
            return []
        ends = np.cumsum(sizes)
        if text.isascii():
            return list(zip((ends - sizes).tolist(), ends.tolist()))
        starts_of = np.concatenate([[0], np.cumsum([len(c.encode()) for c in text])])
        first = np.searchsorted(starts_of, ends - sizes, side="right") - 1
        last = np.searchsorted(starts_of, ends - 1, side="right")
        return list(zip(first.tolist(), last.tolist()))

    return of
