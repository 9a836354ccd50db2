"""Byte-level BPE ids by a tokenizer file."""

from __future__ import annotations

import json
from array import array

from acctrisk.llm.common import worker_cache


def byte_symbols() -> dict[str, int]:
    """The printable character that stands for each byte in a byte-level vocabulary."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Encoder:
    """Ids of whole texts; strings of special tokens are ordinary text.

    The vocabulary of the file is given to ``tiktoken``, which finds the same ids as ``tokenizers``
    (the tests compare them) several times faster.
    """

    def __init__(self, path: str):
        import public_tokenizers
        import tiktoken

        with open(path, encoding="utf-8") as file:  # on every machine: an installed library's data
            model = json.load(file)
        symbols, special = byte_symbols(), {t["content"] for t in model["added_tokens"]}
        ranks = {bytes(symbols[c] for c in token): i for token, i in model["model"]["vocab"].items() if token not in special}
        own = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self._encode = own.encode_ordinary

    def __call__(self, text: str | None) -> array:
        """Unsigned 32-bit ids; a missing text has none."""
        return array("I", self._encode(text) if text else ())


def encoder(path: str) -> Encoder:
    """The encoder of a tokenizer file, one per process."""
    cache = worker_cache()
    if ("bpe", path) not in cache:
        cache["bpe", path] = Encoder(path)
    return cache["bpe", path]


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")
