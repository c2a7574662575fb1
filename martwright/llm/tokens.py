"""Token ids of public vocabularies, loaded once in each Python worker."""

from __future__ import annotations

import base64
import json
import os
from collections.abc import Callable

import numpy as np
import public_tokenizers
import tiktoken
from tokenizers import Tokenizer

from martwright.llm.common import per_worker


def _ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


def _special(path: str) -> dict[str, int]:
    """The added tokens of the ``.json`` file beside a ``.tiktoken`` file."""
    beside = path.removesuffix(".tiktoken") + ".json"
    if not os.path.exists(beside):
        return {}
    with open(beside, encoding="utf-8") as file:
        return {token["content"]: token["id"] for token in json.load(file)["added_tokens"]}


def _fast(path: str) -> tiktoken.Encoding:
    return tiktoken.Encoding(
        path,
        pat_str=public_tokenizers.PATTERN,
        mergeable_ranks=_ranks(path),
        special_tokens=_special(path),
    )


def encoder(path: str, special: bool = False) -> Callable[[str], np.ndarray]:
    """The ids of a text as unsigned 32-bit integers, by the vocabulary file at ``path``.

    A ``.tiktoken`` file is read by tiktoken, a ``.json`` file by tokenizers. The byte-level
    vocabulary comes in both forms with equal ids (a test compares them on every code point);
    tiktoken needs a fifth of the time. Strings of added tokens in a text are ordinary text, or
    with ``special`` these tokens, as an unchanged tokenizer reads them.
    """
    if path.endswith(".tiktoken"):
        fast = per_worker(path, lambda: _fast(path))
        if special:
            return lambda text: np.array(fast.encode(text, allowed_special="all"), dtype="<u4")
        return lambda text: np.array(fast.encode_ordinary(text), dtype="<u4")

    def load() -> Tokenizer:
        tokenizer = Tokenizer.from_file(path)
        tokenizer.encode_special_tokens = not special
        return tokenizer

    slow = per_worker(f"{path} {special}", load)
    return lambda text: np.array(slow.encode(text, add_special_tokens=False).ids, dtype="<u4")
