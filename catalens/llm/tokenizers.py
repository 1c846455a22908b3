"""Where the files of public tokenizers are."""

from __future__ import annotations

import os


def tokenizer_path(name: str) -> str:
    """A file of the installed public tokenizers; CATALENS_TOKENIZERS names another folder."""
    if folder := os.environ.get("CATALENS_TOKENIZERS"):
        return os.path.join(folder, name)
    import public_tokenizers

    return public_tokenizers.path(name)


def tokenizer_pattern() -> str:
    """How the byte-level tokenizers cut a text before merging."""
    import public_tokenizers

    return public_tokenizers.PATTERN
