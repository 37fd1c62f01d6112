"""Token counts by a byte-level BPE tokenizer compiled to a deterministic transducer.

The transducer reads characters.  Its state holds where the splitting pattern is inside the current
pretoken and, for the merges, the last token of every prefix from which a vocabulary entry may
still grow.  A transition is annotated with the change of the token count, so the counts on a path
add up to the number of tokens of what was read.  States and transitions are compiled when a text first needs them.

A text is cut into chunks.  Chunks are read side by side from the start state; then every chunk is read
from the states in which its predecessor can end, until it meets its first path.  This fills the
part of each chunk's state map (entry state -> exit state, count) that can be reached; a
parallel prefix scan composes the maps along each text.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from noteweave.llm.bpe import NEVER, Vocabulary
from noteweave.llm.tokens import slices

CHUNK = 256
SLICE_CHARACTERS = 2_000_000
#: The compiled tables start anew beyond so many states; only a repeated compilation is lost.
MOST_STATES = 200_000

LETTER, NUMBER, SPACE, OTHER_SPACE, OTHER, APOSTROPHE = range(6)
#: What may follow an apostrophe at the start of a pretoken.
CONTRACTIONS = ("s", "t", "re", "ve", "m", "ll", "d")

class Merges:
    """The determinised merges: states over the bytes of one pretoken.

    A state is a tuple of (suffix, blocked, behind): ``suffix`` of what was read is a proper prefix
    of a vocabulary entry, ``blocked`` numbers what the last token in front of it forbids for entries with
    that prefix, and ``behind`` is how many tokens fewer the text in front of it has.  Entries from which no
    token can grow are left out, so texts with the same future share a state.
    """

    START = ((b"", 0, 0),)

    def __init__(self, vocabulary: Vocabulary):
        self.vocabulary = vocabulary
        self.tokens = vocabulary.stable_tokens()
        #: Tokens that grow from a proper prefix.
        self.grown: dict[bytes, list[bytes]] = defaultdict(list)
        for token in sorted(self.tokens):
            for n in range(len(token)):
                self.grown[token[:n]].append(token)
        self.edges: dict[bytes, list[tuple[bytes, int]]] = {}
        self.clear()

    def clear(self) -> None:
        self.sets: list[dict[bytes, int]] = []
        self.numbers: dict[frozenset, int] = {}
        self.behind_token: dict[bytes, int] = {}
        self.narrowed: dict[tuple[int, bytes], int | None] = {}
        self.steps: dict[tuple, tuple] = {}
        self.numbered({})

    def numbered(self, blocked: dict[bytes, int]) -> int:
        key = frozenset(blocked.items())
        if key not in self.numbers:
            self.numbers[key] = len(self.sets)
            self.sets.append(blocked)
        return self.numbers[key]

    def allows(self, blocked: dict[bytes, int], token: bytes) -> bool:
        if token not in self.edges:
            self.edges[token] = self.vocabulary.left_edge(token)
        return not any(blocked.get(part, NEVER) <= until for part, until in self.edges[token] if part in blocked)

    def narrow(self, number: int, suffix: bytes) -> int | None:
        """What is still forbidden once ``suffix`` was read; None if no token can grow."""
        key = (number, suffix)
        if key not in self.narrowed:
            n = len(suffix)
            blocked = {part: rank for part, rank in self.sets[number].items() if part[:n] == suffix[: len(part)]}
            can = any(self.allows(blocked, token) for token in self.grown[suffix])
            self.narrowed[key] = self.numbered(blocked) if can else None
        return self.narrowed[key]

    def after(self, token: bytes) -> int:
        if token not in self.behind_token:
            self.behind_token[token] = self.numbered(self.vocabulary.blocks(token))
        return self.behind_token[token]

    def step(self, state: tuple, byte: bytes) -> tuple[tuple, int]:
        """The state behind one more byte and the change of the token count."""
        key = (state, byte)
        if key not in self.steps:
            token, behind = next(
                (suffix + byte, behind)
                for suffix, number, behind in reversed(state)
                if suffix + byte in self.tokens and self.allows(self.sets[number], suffix + byte)
            )
            change = 1 - behind
            grown = [(b"", self.after(token), 0)]
            for suffix, number, was in state:
                if suffix + byte in self.grown and (left := self.narrow(number, suffix + byte)) is not None:
                    grown.append((suffix + byte, left, was + change))
            self.steps[key] = tuple(grown), change
        return self.steps[key]

    def read(self, state: tuple, piece: bytes) -> tuple[tuple, int]:
        total = 0
        for i in range(len(piece)):
            state, change = self.step(state, piece[i : i + 1])
            total += change
        return state, total


class Transducer:
    """Splitting pattern and merges as one machine over characters, in tables that grow."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        vocabulary = Vocabulary(path)
        self.special = vocabulary.special
        self.merges = Merges(vocabulary)
        self.splitter = Tokenizer.from_file(path).pre_tokenizer
        self.symbol_of = np.full(0x110000, -1, np.int32)
        self.symbols: list[tuple[int, str]] = []
        self.clear()

    # -- characters ----------------------------------------------------------------------------

    def class_of(self, char: str) -> int:
        """The class the tokenizer's own splitter gives a character."""
        if char == "'":
            return APOSTROPHE
        if char == " ":
            return SPACE
        parts = lambda text: len(self.splitter.pre_tokenize_str(text))
        if parts("x" + char) == 1:
            return LETTER
        if parts("1" + char) == 1:
            return NUMBER
        return OTHER if parts("!" + char) == 1 else OTHER_SPACE

    def symbols_for(self, points: np.ndarray) -> np.ndarray:
        out = self.symbol_of[points]
        if len(out) and out.min() < 0:
            for point in np.unique(points[out < 0]).tolist():
                self.symbol_of[point] = len(self.symbols)
                self.symbols.append((self.class_of(chr(point)), chr(point)))
            if len(self.symbols) > self.table.shape[1]:
                wide = np.full((self.table.shape[0], len(self.symbols) + 32), -1, np.int32)
                wide[:, : self.table.shape[1]] = self.table
                self.table = wide
            out = self.symbol_of[points]
        return out

    # -- states --------------------------------------------------------------------------------

    def clear(self) -> None:
        """Forget the compiled states; state 0 is the start of a pretoken."""
        self.states: list[tuple] = []
        self.numbers: dict[tuple, int] = {}
        self.table = np.full((1024, len(self.symbols) + 64), -1, np.int32)
        self.merges.clear()
        self.number(("start",))

    def number(self, state: tuple) -> int:
        if state not in self.numbers:
            self.numbers[state] = len(self.states)
            self.states.append(state)
            if len(self.states) > len(self.table):
                self.table = np.concatenate([self.table, np.full_like(self.table, -1)])
        return self.numbers[state]

    def begin(self, kind: int, char: str, lead: bytes = b"") -> tuple[tuple, int]:
        """A new pretoken that starts with ``lead`` (a space or nothing) and the character."""
        state, count = self.merges.read(Merges.START, lead + char.encode())
        if kind in (SPACE, OTHER_SPACE):
            return ("space", state, count, kind == SPACE, count), count
        if kind == APOSTROPHE:
            return (("'", state) if not lead else ("run", OTHER, state)), count
        return ("run", kind, state), count

    def step(self, state: tuple, kind: int, char: str) -> tuple[tuple, int]:
        mode = state[0]
        if mode == "start":
            return self.begin(kind, char)
        if mode == "space":
            # (mode, merges of the run, tokens of the run's last character alone, it is " ", run - run without it)
            _, run, alone, blank, last = state
            if kind in (SPACE, OTHER_SPACE):
                grown, change = self.merges.read(run, char.encode())
                _, single = self.merges.read(Merges.START, char.encode())
                return ("space", grown, single, kind == SPACE, change), change
            # The last character leaves the run: a blank opens the new pretoken, another one stands alone.
            new, count = self.begin(kind, char, b" " if blank else b"")
            return new, count - last + (0 if blank else alone)
        if mode == "'":
            _, merges = state
            if kind == LETTER and char in CONTRACTIONS:
                _, whole = self.merges.read(Merges.START, b"'" + char.encode())
                _, mark = self.merges.read(Merges.START, b"'")
                return ("start",), whole - mark
            if kind == LETTER and any(x[0] == char for x in CONTRACTIONS if len(x) == 2):
                new, count = self.begin(kind, char)
                return ("'letter", char, new), count
            state = ("run", OTHER, merges)
        elif mode == "'letter":
            _, first, run = state
            if kind == LETTER and first + char in CONTRACTIONS:
                _, whole = self.merges.read(Merges.START, ("'" + first + char).encode())
                _, apart = self.merges.read(Merges.START, b"'")
                _, letter = self.merges.read(Merges.START, first.encode())
                return ("start",), whole - apart - letter
            state = run
        _, group, merges = state
        if kind == group or (kind == APOSTROPHE and group == OTHER):
            grown, change = self.merges.read(merges, char.encode())
            return ("run", group, grown), change
        return self.begin(kind, char)

    # Packed transition: next state * 64 + change + 32.

    def compile(self, missing: np.ndarray, width: int) -> None:
        for at in np.unique(missing).tolist():
            state, symbol = divmod(at, width)
            new, change = self.step(self.states[state], *self.symbols[symbol])
            if not -32 <= change < 32:
                raise OverflowError("a character changes the count by more than a transition can hold")
            self.table[state, symbol] = self.number(new) * 64 + change + 32

    def advance(self, states: np.ndarray, symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Next states and count changes of many chunks at once."""
        width = self.table.shape[1]
        where = states.astype(np.int64) * width + symbols
        packed = self.table.ravel().take(where)
        if len(packed) and packed.min() < 0:
            self.compile(where[packed < 0], width)
            packed = self.table.ravel().take(where)
        return packed >> 6, (packed & 63) - 32

    # -- texts ---------------------------------------------------------------------------------

    def parts(self, text: str) -> list[str]:
        """The text between special strings; each string counts one token."""
        parts = [text]
        for mark in self.special:
            if mark in text:
                parts = [x for part in parts for x in part.split(mark)]
        return parts

    def counts(self, texts: list[str], chunk: int = CHUNK) -> np.ndarray:
        if len(self.states) > MOST_STATES:
            self.clear()
        pieces = [self.parts(text) for text in texts]
        owner = np.repeat(np.arange(len(texts)), [len(p) for p in pieces])
        flat = [x for p in pieces for x in p]
        out = np.array([len(p) - 1 for p in pieces], np.int64)
        sizes = np.array([len(x) for x in flat], np.int64)
        symbols = self.symbols_for(np.frombuffer("".join(flat).encode("utf-32-le"), np.uint32))
        np.add.at(out, owner, self.count_parts(symbols, sizes, chunk))
        return out

    def count_parts(self, symbols: np.ndarray, sizes: np.ndarray, chunk: int) -> np.ndarray:
        """Tokens of each part; ``symbols`` holds the parts one after the other."""
        per = -(-sizes // chunk)
        part = np.repeat(np.arange(len(sizes)), per)
        if not len(part):
            return np.zeros(len(sizes), np.int64)
        inside = np.arange(len(part)) - np.repeat(np.cumsum(per) - per, per)
        begin = (np.cumsum(sizes) - sizes)[part] + inside * chunk
        length = np.minimum(chunk, sizes[part] - inside * chunk)
        maps = self.chunk_maps(symbols, begin, length, inside > 0)
        total = compose(*maps, first=inside == 0)
        last = np.cumsum(per)[per > 0] - 1
        result = np.zeros(len(sizes), np.int64)
        result[per > 0] = total[last]
        return result

    def chunk_maps(self, symbols, begin, length, linked):
        """State maps of all chunks: entry, exit and count, one column per entry state, -1 where unused.

        Column 0 is the start state.  ``linked`` chunks continue the one before; for these, exits of
        the predecessor that are no entry yet are added until there are none.
        """
        n = len(begin)
        order = np.argsort(-length, kind="stable")
        rank = np.empty(n, np.int64)
        rank[order] = np.arange(n)
        steps = int(length.max())
        at, left = begin[order], length[order]
        path = np.full((steps, n), -1, np.int32)
        sums = np.zeros((steps, n), np.int32)
        state, total = np.zeros(n, np.int32), np.zeros(n, np.int32)
        active = np.searchsorted(-left, -np.arange(steps), side="left")  # chunks longer than the step
        for j in range(steps):
            k = active[j]
            state[:k], change = self.advance(state[:k], symbols[at[:k] + j])
            total[:k] += change
            path[j, :k], sums[j, :k] = state[:k], total[:k]
        entry = [np.zeros(n, np.int32)]
        leave, count = [state[rank]], [total[rank]]
        ask = np.flatnonzero(linked)
        wanted = leave[0][ask - 1]
        while True:
            known = np.zeros(len(ask), bool)
            for column in entry:
                known |= column[ask] == wanted
            ask, wanted = ask[~known], wanted[~known]
            if not len(ask):
                break
            new_leave, new_count = self.follow(symbols, begin[ask], length[ask], wanted, path, sums, rank[ask])
            column = [np.full(n, -1, np.int32), np.full(n, -1, np.int32), np.zeros(n, np.int32)]
            column[0][ask], column[1][ask], column[2][ask] = wanted, new_leave, new_count
            for table, values in zip((entry, leave, count), column):
                table.append(values)
            follow = ask + 1 < n
            follow[follow] &= linked[ask[follow] + 1]
            ask, wanted = ask[follow] + 1, new_leave[follow]
        return np.stack(entry), np.stack(leave), np.stack(count).astype(np.int64)

    def follow(self, symbols, begin, length, state, path, sums, column):
        """Read chunks from the given states until each meets its first path, or ends."""
        leave, count = np.empty(len(begin), np.int32), np.empty(len(begin), np.int32)
        open_, state, total = np.arange(len(begin)), state.astype(np.int32), np.zeros(len(begin), np.int32)
        j = 0
        while len(open_):
            state, change = self.advance(state, symbols[begin[open_] + j])
            total = total + change
            same = path[j, column[open_]] == state
            done = same | (length[open_] == j + 1)
            if done.any():
                ended = open_[done]
                last = length[ended] - 1
                met = same[done]
                rest = sums[last, column[ended]] - sums[j, column[ended]]
                leave[ended] = np.where(met, path[last, column[ended]], state[done])
                count[ended] = total[done] + np.where(met, rest, 0)
                open_, state, total = open_[~done], state[~done], total[~done]
            j += 1
        return leave, count


def compose(entry: np.ndarray, leave: np.ndarray, count: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Count from the start state to the end of each chunk, by a segmented parallel prefix scan.

    ``entry``, ``leave`` and ``count`` are (columns, chunks).  A map is rewritten as: column of the
    predecessor's exit -> own column.  Composed maps of runs of 1, 2, 4, ... chunks are doubled until they
    reach the first chunk of their text.
    """
    columns, n = entry.shape
    # Entry column of chunk i for each exit column of chunk i - 1.
    link = np.zeros((columns, n), np.int64)
    for c in range(columns):
        came = np.empty(n, np.int32)
        came[0] = 0
        came[1:] = leave[c, :-1]
        for own in range(columns - 1, -1, -1):
            link[c] = np.where((entry[own] == came) & (came >= 0), own, link[c])
    link[:, first] = 0
    span = np.where(first, 1 << 40, 1)
    reach, total = link, np.take_along_axis(count, link, 0)
    step = 1
    while step < n:
        # A run that begins at a text's first chunk is complete; others join the run in front of them.
        grow = np.flatnonzero(span < (1 << 40))
        if not len(grow):
            break
        before = grow - step
        front = reach[:, before]
        total_new = total[:, before] + np.take_along_axis(total[:, grow], front, 0)
        reach_new = np.take_along_axis(reach[:, grow], front, 0)
        span_new = np.where(span[before] >= (1 << 40), 1 << 40, span[grow] + span[before])
        total[:, grow], reach, span[grow] = total_new, _put(reach, grow, reach_new), span_new
        step *= 2
    return total[0]


def _put(table: np.ndarray, at: np.ndarray, values: np.ndarray) -> np.ndarray:
    out = table.copy()
    out[:, at] = values
    return out


_compiled: dict[str, Transducer] = {}


def transducer(path: str) -> Transducer:
    """One machine per worker process and file."""
    if path not in _compiled:
        _compiled[path] = Transducer(path)
    return _compiled[path]


def count_tokens(docs: DataFrame, tokenizer: str, *, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc, n_bytes (UTF-8), n_tokens.

    A null text counts as empty: 0 bytes, 0 tokens.  Null and repeated docs get a row each; other
    columns are not read.  A map over rows without a shuffle: memory holds a slice of texts, or one longer text.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = transducer(tokenizer)
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            tokens = [machine.counts(texts[low:high]) for low, high in slices(texts, SLICE_CHARACTERS)]
            tokens = np.concatenate(tokens) if tokens else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(tokens)], names=["doc", "n_bytes", "n_tokens"])

    schema = StructType([StructField("doc", docs.schema[doc].dataType), StructField("n_bytes", LongType()), StructField("n_tokens", LongType())])
    narrow = docs.select(F.col(doc).alias("doc"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    return narrow.withColumn("n_bytes", F.octet_length("text").cast("long")).mapInArrow(count, schema).withColumnRenamed("doc", doc)
