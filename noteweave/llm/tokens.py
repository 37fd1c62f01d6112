"""Token ids of whole texts, by the public tokenizer file named by path.

A text without unusual characters is joined by ranks in one call, several times faster than by the
list of merges; that is taken only where both give the same (see ``Vocabulary.ids_follow_merges``).  Other texts
are cut into chunks, a run of white space with the run of other characters behind it.  The splitting
pattern always ends a token in front of white space that follows another character, so the ids of a
text are those of its chunks, one after the other (tests hold this against whole texts).
"""

from __future__ import annotations

import os
import re
from array import array
from collections.abc import Iterable
from itertools import groupby

from noteweave.llm.bpe import Vocabulary

#: Characters of Unicode's White_Space, as the splitting pattern of the tokenizer counts them.
SPACE = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
CHUNK = re.compile(f"[{SPACE}]*[^{SPACE}]+|[{SPACE}]+")
#: The splitting pattern of the vocabulary, a fixed value.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Texts with other characters take the general path, and chunks with them go to the tokenizer itself,
#: since the two libraries may know different Unicode versions.
ODD = re.compile("[^\n -~\xa1-\u024f]")


class TokenIds:
    """Ids as little-endian unsigned 32-bit bytes, special strings handled as the library does."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        import tiktoken
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        vocabulary = Vocabulary(path)
        self.special, self.ranked = vocabulary.special, None
        if vocabulary.ids_follow_merges():
            self.ranked = tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=vocabulary.ids, special_tokens={}).encode_ordinary

    def odd(self, text: str) -> bool:
        return self.ranked is None or ODD.search(text) is not None or any(mark in text for mark in self.special)

    def ids(self, text: str) -> list[int]:
        return self.ranked(text) if not self.odd(text) else memoryview(self.encode(text)).cast("I").tolist()

    def encode(self, text: str) -> bytes:
        ids = array("I")
        for odd, run in [(False, [text])] if not self.odd(text) else groupby(CHUNK.findall(text), self.odd):
            part = "".join(run)
            ids.extend(self.tokenizer.encode(part, add_special_tokens=False).ids if odd else self.ranked(part))
        return ids.tobytes()


_loaded: dict[str, TokenIds] = {}


def token_ids(path: str) -> TokenIds:
    """One tokenizer per worker process and file."""
    if path not in _loaded:
        _loaded[path] = TokenIds(path)
    return _loaded[path]


def slices(texts: list[str | None], characters: int) -> Iterable[tuple[int, int]]:
    """Ranges of texts with about so many characters each; a longer text stands alone."""
    start, size = 0, 0
    for at, text in enumerate(texts):
        n = len(text or "")
        if at > start and size + n > characters:
            yield start, at
            start, size = at, 0
        size += n
    if start < len(texts):
        yield start, len(texts)
