"""Public tokenizers, loaded once in each Python worker. The folder of their files is a parameter."""

from __future__ import annotations

import base64
import os
from functools import cache

#: Folder of the vocabulary files; they are read there and never copied.
TOKENIZER_DIR = os.environ.get("MILLRACE_TOKENIZERS", "/opt/tokenizers")
#: Vocabulary that sizes in tokens refer to. It bounds every table by token id: ids are below VOCABULARY.
TOKENIZER_FILE = "byte_bpe_50k.tiktoken"
VOCABULARY = 50_257
#: Fixed value: how the vocabulary's text was split before it was merged.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


@cache
def encoding(folder: str = TOKENIZER_DIR, name: str = TOKENIZER_FILE):
    import tiktoken

    with open(os.path.join(folder, name), "rb") as file:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, file)}
    return tiktoken.Encoding(name, pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def encode(texts: list[str], folder: str = TOKENIZER_DIR, name: str = TOKENIZER_FILE) -> list[list[int]]:
    """Token ids of each text. Very long texts are encoded in parts cut before a space, which is where the split cuts too."""
    e = encoding(folder, name)
    return [e.encode_ordinary(t) if len(t) < 1_000_000 else _in_parts(e, t) for t in texts]


def _in_parts(e, text: str, most: int = 500_000) -> list[int]:
    out: list[int] = []
    at = 0
    while at < len(text):
        end = min(len(text), at + most)
        if end < len(text):
            cut = text.rfind("\n", at + 1, end)
            cut = cut if cut > at else text.rfind(" ", at + 1, end)
            end = cut if cut > at else end
        out += e.encode_ordinary(text[at:end])
        at = end
    return out


def chars_per_token(texts: list[str], folder: str = TOKENIZER_DIR, name: str = TOKENIZER_FILE) -> list[float]:
    """Characters per subword: words of a language reach 4 or more, random strings stay under 2.5."""
    e = encoding(folder, name)
    return [len(t) / max(1, len(e.encode_ordinary(t))) for t in texts]
