"""Byte-level BPE vocabularies: merge trees and which tokens may stand next to each other.

Every token comes from one merge (left, right) of a rank.  A part inside a token lives until the
merge that consumes it.  Two tokens stay apart when no merge joins a part on the right edge of the
first with a part on the left edge of the second while both live.
"""

from __future__ import annotations

import json
from collections import defaultdict

NEVER = 1 << 60

#: Bytes that the vocabulary's printable characters name by themselves; the other bytes
#: follow from code point 256 on.
PRINTABLE = [*range(33, 127), *range(161, 173), *range(174, 256)]


def byte_names() -> dict[str, int]:
    names = {chr(b): b for b in PRINTABLE}
    rest = [b for b in range(256) if b not in PRINTABLE]
    return names | {chr(256 + n): b for n, b in enumerate(rest)}


class Vocabulary:
    """Tokens, ids and merges of a tokenizer file; ``special`` strings are no part of the merges."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            model = json.load(file)
        names = byte_names()
        to_bytes = lambda token: bytes(names[c] for c in token)
        self.special = [token["content"] for token in model["added_tokens"]]
        pairs = [pair.split(" ") if isinstance(pair, str) else pair for pair in model["model"]["merges"]]
        self.ids = {to_bytes(t): n for t, n in model["model"]["vocab"].items() if t not in self.special and all(c in names for c in t)}
        #: token -> left, right, rank
        self.made: dict[bytes, tuple[bytes, bytes, int]] = {}
        self.merges: dict[bytes, list[tuple[bytes, int]]] = defaultdict(list)
        for rank, (a, b) in enumerate(pairs):
            left, right = to_bytes(a), to_bytes(b)
            if left + right in self.made:
                raise ValueError("a token that two merges make is not supported")
            self.made[left + right] = (left, right, rank)
            self.merges[left].append((right, rank))

    def right_edge(self, token: bytes):
        """Parts at the right edge with the rank that consumes them."""
        until = NEVER
        while True:
            yield token, until
            if token not in self.made:
                return
            _, token, until = self.made[token]

    def left_edge(self, token: bytes) -> list[tuple[bytes, int]]:
        out, until = [], NEVER
        while True:
            out.append((token, until))
            if token not in self.made:
                return out
            token, _, until = self.made[token]

    def blocks(self, last: bytes) -> dict[bytes, int]:
        """Parts that cannot follow ``last``, if they live beyond the rank given (itself included)."""
        out: dict[bytes, int] = {}
        for part, until in self.right_edge(last):
            for right, rank in self.merges.get(part, ()):
                if rank < until:
                    out[right] = min(rank, out.get(right, NEVER))
        return out

    def stable_tokens(self) -> set[bytes]:
        """The tokens whose own bytes give the token itself when they are split."""
        ranks = {(left, right): rank for left, right, rank in self.made.values()}
        stable = {token for token in self.ids if len(token) == 1}
        for token, (left, right, rank) in self.made.items():
            if left in stable and right in stable and token in self.ids:
                crossing = (
                    (ranks.get((a, b), NEVER), until, other)
                    for b, other in self.left_edge(right)
                    for a, until in self.right_edge(left)
                )
                if not any(k < until and k <= other and k < rank for k, until, other in crossing):
                    stable.add(token)
        return stable

    def ids_follow_merges(self) -> bool:
        """Whether joining by the id of the joined bytes gives the same as joining by merges.

        True when ids rise with the ranks and every token is what its own bytes give.
        """
        ids = [self.ids.get(token, -1) for token in self.made]
        return all(a < b for a, b in zip(ids, ids[1:])) and len(self.stable_tokens()) == len(self.ids)
