"""Public tokenizers' vocabulary files, read where they are; the folder is a parameter."""

from __future__ import annotations

import base64
import os

#: Where the vocabulary files lie unless the caller says otherwise: the folder that the environment names, else the usual one.
FOLDER = os.environ.get("TAPELOOM_TOKENIZERS", "/opt/tokenizers")
#: The pattern GPT-2 splits text by before byte pairs are merged. Fixed value, published with that tokenizer.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

_READY: dict[str, object] = {}


def gpt2(folder: str = FOLDER):
    """A tiktoken encoding of GPT-2's 50,256 ranks, made once in each process."""
    if folder not in _READY:
        import tiktoken

        with open(f"{folder}/byte_bpe_50k.tiktoken", "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        _READY[folder] = tiktoken.Encoding("gpt2-ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _READY[folder]
