"""Encoders from the vocabulary files of public tokenizers; the files' folder is a parameter and nothing of it is copied here."""

from __future__ import annotations

import base64
import json
from functools import lru_cache
from pathlib import Path


def vocabulary_file(name: str, folder: str | None = None) -> str:
    """folder / name; without a folder the one that the installed package of public vocabularies has. It is on every machine."""
    if folder:
        return f"{folder}/{name}"
    import public_tokenizers

    return public_tokenizers.path(name)


def split_pattern() -> str:
    import public_tokenizers

    return public_tokenizers.PATTERN


def read_ranks(file: str) -> dict[bytes, int]:
    lines = Path(file).read_bytes().splitlines()
    return {base64.b64decode(a): int(b) for a, b in (x.split() for x in lines if x.strip())}


def special_tokens(file: str) -> dict[str, int]:
    """The special tokens that a JSON vocabulary of the tokenizers library names."""
    return {t["content"]: t["id"] for t in json.loads(Path(file).read_text())["added_tokens"] if t["special"]}


@lru_cache(maxsize=2)
def encoder(file: str, special: str | None = None):
    """Encodes by a rank file; one for each worker process. Special tokens are those of the JSON vocabulary `special`, else none.

    Strings of special tokens are ordinary text to encode_ordinary, and their ids to encode with allowed_special="all".
    """
    import tiktoken

    return tiktoken.Encoding("own", pat_str=split_pattern(), mergeable_ranks=read_ranks(file), special_tokens=special_tokens(special) if special else {})
