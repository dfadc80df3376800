"""Token ids of texts by a public byte-level BPE vocabulary.

Most text is encoded by ``tiktoken``, which is several times faster with the same
vocabulary and the same splitting pattern; the remaining text by ``tokenizers``, from
the same vocabulary in its own format. Both give the same ids where the two
libraries agree on what a letter is and no special token is spelled out, so only
texts of Latin, Greek and Cyrillic letters and general punctuation without a long run
of one kind go the fast way.
"""

from __future__ import annotations

import base64
import re
from functools import cache

import numpy as np

#: Texts that the fast way takes: code points known alike to both libraries.
_PLAIN = re.compile("[\t\n\r\x20-\x7e\xa0-ɏΑ-ΡΣ-ώЀ-џ‐-‧‰-⁞€]*")
#: A run of white space or of one word longer than this is left to the slower library.
_RUN = re.compile(r"\s{500}|\S{5000}")


@cache
def _slow(path: str):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


@cache
def _fast(path: str):
    import public_tokenizers
    import tiktoken

    with open(path, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    return tiktoken.Encoding("bytes", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def vocabulary(name: str = "byte_bpe_50k") -> tuple[str, str]:
    """Paths of a vocabulary for ``tokenizers`` and for ``tiktoken``."""
    import public_tokenizers

    return public_tokenizers.path(f"{name}.json"), public_tokenizers.path(f"{name}.tiktoken")


def encode(text: str | None, paths: tuple[str, str], end: int) -> np.ndarray:
    """Ids of the whole text, then ``end``; those of a null text are ``end`` alone."""
    if not text:
        ids = []
    elif "<|" not in text and _PLAIN.fullmatch(text) and not _RUN.search(text):
        ids = _fast(paths[1]).encode_ordinary(text)
    else:
        ids = _slow(paths[0]).encode(text, add_special_tokens=False).ids
    out = np.empty(len(ids) + 1, dtype="<u4")
    out[:-1] = ids
    out[-1] = end
    return out


@cache
def _slow_plain(path: str):
    from tokenizers import Tokenizer

    found = Tokenizer.from_file(path)
    found.encode_special_tokens = True
    return found


def encode_plain(text: str, paths: tuple[str, str]) -> np.ndarray:
    """Ids of a text in which the strings of special tokens are ordinary text."""
    if is_plain(text):
        return _fast(paths[1]).encode_to_numpy(text, disallowed_special=())
    return np.array(_slow_plain(paths[0]).encode(text, add_special_tokens=False).ids, dtype=np.uint32)


def is_plain(text: str) -> bool:
    """Whether both libraries surely give the same ids."""
    return bool(_PLAIN.fullmatch(text)) and not _RUN.search(text)


@cache
def token_bytes(path: str) -> list[bytes]:
    """Bytes of each id of a file of ranks."""
    with open(path, "rb") as lines:
        ranks = {int(rank): base64.b64decode(token) for token, rank in map(bytes.split, lines)}
    return [ranks.get(i, b"") for i in range(max(ranks) + 1)]
