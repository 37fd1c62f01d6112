"""Plain-Python versions of the operators, for comparison on small tables."""

from __future__ import annotations

import re
from collections import defaultdict

import xxhash


def components(nodes, links):
    root = {n: n for n in nodes}

    def find(n):
        while root[n] != n:
            n = root[n]
        return n

    for a, b in links:
        a, b = find(a), find(b)
        if a != b:
            root[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def simhash(text: str | None, words: int = 4, seed: int = 42) -> int:
    lowered = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    parts = re.findall(r"[^\x20\x09-\x0D]+", lowered)
    if not parts:
        return 0
    shingles = [" ".join(parts[i : i + words]) for i in range(max(1, len(parts) - words + 1))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), seed) for s in shingles]
    return sum(1 << bit for bit in range(64) if 2 * sum(h >> bit & 1 for h in hashes) > len(hashes))


def shingles(text: str | None, words: int = 5) -> set[str]:
    parts = (text or "").lower().split()
    return {" ".join(parts[i : i + words]) for i in range(max(1, len(parts) - words + 1))} if parts else set()


def jaccard(a: set, b: set) -> float:
    return len(a & b) / len(a | b) if a | b else 1.0


def sketch(text: str, words: int, bits: int) -> list[int]:
    signed = lambda n: n - (1 << 64) if n >> 63 else n
    parts = re.findall(r"[^ \t\n\x0B\f\r]+", text)
    hashes = [xxhash.xxh64_intdigest(p.encode(), 42) for p in parts]
    if not hashes:
        return []

    def combined(some):
        seed = 42
        for h in some:
            seed = xxhash.xxh64_intdigest(h.to_bytes(8, "little"), seed)
        return signed(seed)

    found = {combined(hashes[i : i + words]) for i in range(max(1, len(hashes) - words + 1))}
    low = sorted(h for h in found if 0 <= h < 1 << (64 - bits))
    return low or [min(found)]


def top_k(vectors, k: int):
    """vectors: [(id, list of ints)]; queries are the ids divisible by 50."""
    out = []
    for query, q in {(i, tuple(v)) for i, v in vectors if i % 50 == 0}:
        scored = sorted((-sum(a * b for a, b in zip(q, v)), i) for i, v in vectors if i != query)
        out += [(query, n + 1, i, -s) for n, (s, i) in enumerate(scored[:k])]
    return sorted(out)


def water_filling(budget: int, nodes: dict[str, tuple[int, int]]) -> dict[str, int]:
    """nodes: name -> (weight, room); fill one node after the other until the shares fit."""
    left, open_, got = budget, dict(nodes), {}
    while open_:
        total = sum(w for w, _ in open_.values())
        full = {n for n, (w, room) in open_.items() if room * total <= left * w}
        if not full:
            return got | {n: left * w // total for n, (w, _) in open_.items()}
        for n in full:
            got[n] = open_.pop(n)[1]
            left -= got[n]
    return got


def near_groups(texts: dict[int, str], similarity: float = 0.8) -> dict[int, int]:
    sets = {d: shingles(t) for d, t in texts.items()}
    inverted = defaultdict(list)
    for d, s in sets.items():
        for x in s or {""}:
            inverted[x].append(d)
    candidates = {(a, b) for ds in inverted.values() for i, a in enumerate(ds) for b in ds[i + 1 :]}
    return components(sorted(texts), [(a, b) for a, b in candidates if jaccard(sets[a], sets[b]) >= similarity])


def text_lines(text: str | None) -> list[str]:
    return [line for line in (text or "").split("\n") if line.strip(" \t\n\x0b\f\r")]


def line_runs(lines: list[str], least: int):
    """(lines, positions) of the shortest runs with ``least`` words from each line on."""
    for begin in range(len(lines)):
        words = 0
        for end in range(begin, len(lines)):
            words += len(lines[end].split())
            if words >= least:
                yield tuple(lines[begin : end + 1]), range(begin, end + 1)
                break


def kept_lines(before: str, after: str) -> list[bool]:
    """Which lines of ``before`` stand in ``after``, where lines only go; of equal neighbours the last are taken to stand."""
    lines, left, out = text_lines(before), text_lines(after), []
    for line in reversed(lines):
        out.append(bool(left) and left[-1] == line)
        if out[-1]:
            left.pop()
    assert not left
    return out[::-1]


def line_dedup(texts: dict[int, str], least: int, common_blocks) -> dict[int, tuple[str, int]]:
    """Every document against the first holder of each of its runs, and of each run read from its end, one pair after the other."""
    lines = {d: text_lines(t) for d, t in texts.items()}
    words = {d: [len(x.split()) for x in some] for d, some in lines.items()}
    first, out = {}, {}
    for d in sorted(texts):
        runs = {p for _, p in line_runs(lines[d], least)}
        runs |= {range(len(lines[d]) - p.stop, len(lines[d]) - p.start) for _, p in line_runs(lines[d][::-1], least)}
        holders, seen = set(), defaultdict(int)
        for run in sorted(runs, key=lambda r: (r.start, r.stop)):
            content = tuple(lines[d][run.start : run.stop])
            key = content, seen[content]
            seen[content] += 1
            holders.add(first.setdefault(key, d))
        gone = {p for e in holders - {d} for p in common_blocks(lines[d], lines[e], words[d], words[e], least)}
        at, kept = -1, []
        for line in (texts[d] or "").split("\n"):
            at += bool(text_lines(line))
            if not (text_lines(line) and at in gone):
                kept.append(line)
        out[d] = (texts[d] if texts[d] is None else "\n".join(kept), len(gone))
    return out
