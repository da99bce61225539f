"""Token counts by compiled finite-state machines.

Splitting. The rule that cuts a text before merging is a deterministic automaton of eight states over nine symbols
(a character's class with what the two characters behind it decide). A text is cut in chunks; all chunks run
in lockstep from all eight states, which gives each chunk's state map; the maps compose in a parallel prefix scan;
with each chunk's true entry state a second lockstep run marks where pieces start.

Merging. The pieces run through a deterministic transducer over bytes whose transitions carry the change of the
token count. Byte-pair merging of a prefix ends in one token, the only suffix in the vocabulary that keeps next to
the last token before it; so a state is what later tokens can still reach: the longest suffix that begins a
vocabulary entry, with the last token and the count at each place in it. States and transitions are compiled when
they are first met. Each distinct piece of a batch runs once, and counts of pieces are kept up to a bound.
Beyond the bound on transitions the same steps are followed without being kept.

Special strings are cut out first and count as one token each, as the library does by default.

Cases: null and empty texts have no tokens; repeated rows are counted one by one; very long texts are cut where a
piece surely starts and never at a fixed length; an empty table gives no rows. Only id and text are read.
"""

from __future__ import annotations

import json
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

RESET, WHITE, WHITE_LAST, JOINED, LETTER, NUMBER, OTHER, QUOTE1, QUOTE2 = range(9)
INIT, IN_LETTERS, IN_NUMBERS, IN_OTHERS, IN_WHITE, AFTER_SPACE, LAST_LETTER, TWO_LETTERS = range(8)
#: What may follow an apostrophe as a piece of its own.
SHORT_ENDS, LONG_ENDS = "stmd", ("re", "ve", "ll")
CHUNK = 512
MOST_TRANSITIONS, MOST_PIECES = 100_000, 500_000
LONGEST_KEPT = 64  # bytes of a piece whose count is kept
_PIECE, _LONGEST = 1 << 20, 4 << 20


def _machine() -> tuple[np.ndarray, np.ndarray]:
    """Next state, and whether a piece starts, for each (symbol, state)."""
    to, starts = np.zeros((9, 8), np.uint8), np.ones((9, 8), bool)

    def rule(symbol, new, inside=(), stay=None):
        to[symbol] = new
        for state in inside:
            starts[symbol, state] = False
            to[symbol, state] = new if stay is None else stay

    rule(RESET, INIT)
    rule(WHITE, IN_WHITE, (IN_WHITE,))
    rule(WHITE_LAST, INIT)
    rule(JOINED, AFTER_SPACE)
    rule(LETTER, IN_LETTERS, (IN_LETTERS, AFTER_SPACE))
    rule(NUMBER, IN_NUMBERS, (IN_NUMBERS, AFTER_SPACE))
    rule(OTHER, IN_OTHERS, (IN_OTHERS, AFTER_SPACE))
    rule(QUOTE1, LAST_LETTER, (IN_OTHERS, AFTER_SPACE), IN_OTHERS)
    rule(QUOTE2, TWO_LETTERS, (IN_OTHERS, AFTER_SPACE), IN_OTHERS)
    for state, after in ((LAST_LETTER, INIT), (TWO_LETTERS, LAST_LETTER)):
        starts[LETTER, state], to[LETTER, state] = False, after
    return to, starts


_TO, _STARTS = _machine()
_classes: list[np.ndarray] = []


def character_classes() -> np.ndarray:
    """LETTER, NUMBER, WHITE or OTHER for each code point."""
    if not _classes:
        kind = {"L": LETTER, "N": NUMBER}
        table = np.array([kind.get(unicodedata.category(chr(c))[0], OTHER) for c in range(0x110000)], np.uint8)
        # White space in Unicode.
        white = [*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
        table[white] = WHITE
        _classes.append(table)
    return _classes[0]


def symbols(points: np.ndarray, reset: np.ndarray) -> np.ndarray:
    """The automaton's symbol for each code point; reset marks characters that are not text."""
    out = character_classes()[points]
    out[reset] = RESET
    after = np.append(out[1:], RESET)
    last = (out == WHITE) & (after != WHITE) & (after != RESET)
    quote = np.flatnonzero((points == 39) & (out == OTHER))
    if len(quote):
        padded = np.append(points, [0, 0])
        one, two = padded[quote + 1], padded[quote + 2]
        letters = np.append(out, [RESET, RESET])
        short = np.isin(one, [ord(c) for c in SHORT_ENDS]) & (letters[quote + 1] == LETTER)
        long = np.zeros(len(quote), bool)
        for a, b in LONG_ENDS:
            long |= (one == ord(a)) & (two == ord(b)) & (letters[quote + 1] == LETTER) & (letters[quote + 2] == LETTER)
        out[quote[short]] = QUOTE1
        out[quote[long]] = QUOTE2
    out[last] = np.where(points[last] == 32, JOINED, WHITE_LAST)
    return out


def piece_starts(symbol: np.ndarray) -> np.ndarray:
    """Where pieces start, by composing the state maps of chunks in a parallel prefix scan."""
    n = len(symbol)
    rows = -(-n // CHUNK)
    grid = np.zeros((CHUNK, rows), np.intp)
    grid.T.flat[:n] = symbol
    grid *= 8
    to = _TO.ravel().astype(np.intp)
    maps = np.repeat(np.arange(8)[:, None], rows, axis=1)
    for column in grid:
        maps = to.take(maps + column)
    # maps[s, c]: the state after chunk c if it is entered in s. Doubling composes c with all chunks before it.
    span = 1
    while span < rows:
        maps[:, span:] = np.take_along_axis(maps[:, span:], maps[:, :-span].copy(), axis=0)
        span *= 2
    state = np.append(INIT, maps[INIT, :-1]).astype(np.intp)
    starts = np.empty((CHUNK, rows), bool)
    flags = _STARTS.ravel()
    for k, column in enumerate(grid):
        at = state + column
        starts[k] = flags.take(at)
        state = to.take(at)
    return starts.T.ravel()[:n]


class Vocabulary:
    """Bytes of the tokens and ranks of the merges of a byte-level BPE file, and its special strings."""

    def __init__(self, content: bytes):
        spec = json.loads(content)
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        signs = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in plain)}
        self.special = [t["content"].encode() for t in spec.get("added_tokens", [])]
        raw = lambda t: bytes(signs[c] for c in t)
        self.ids = {raw(t): i for t, i in spec["model"]["vocab"].items() if t.encode() not in self.special}
        merges = [m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]]
        self.ranks, self.made, self.split = {}, dict.fromkeys(self.ids.values(), -1), {}
        for rank, (a, b) in enumerate(merges):
            left, right = raw(a), raw(b)
            pair, token = (self.ids[left], self.ids[right]), self.ids[left + right]
            self.ranks[pair] = rank
            if self.made[token] < 0:
                self.made[token], self.split[token] = rank, pair
        self.begins = {b[:k] for b in self.ids for k in range(1, len(b) + 1)}

    def keeps(self, a: int, b: int) -> bool:
        """Whether merging the bytes of a and b gives those two tokens again: undoing the latest merge at either
        side of the seam, step by step, no earlier merge across the seam may come up."""
        limit = 1 << 60
        while True:
            across = self.ranks.get((a, b))
            if across is not None and across < limit:
                return False
            made_a, made_b = self.made[a], self.made[b]
            if made_a < 0 and made_b < 0:
                return True
            # Equal merges go from the left, so one across the seam comes before the same one in b.
            if made_a > made_b:
                limit, a = made_a, self.split[a][1]
            else:
                limit, b = made_b + 1, self.split[b][0]


class Transducer:
    """Bytes -> change of the token count, compiled state by state up to MOST_TRANSITIONS."""

    def __init__(self, vocabulary: Vocabulary):
        self.v = vocabulary
        self.pairs: dict[tuple[int, int], bool] = {}
        # A state: the suffix, and for each place in it and its end the last token and the count, relative to the end.
        self.start = (b"", ((-1, 0),))
        self.states, self.index, self.steps = [self.start], {self.start: 0}, {}

    def _keeps(self, a: int, b: int) -> bool:
        got = self.pairs.get((a, b))
        if got is None:
            if len(self.pairs) > MOST_TRANSITIONS:
                self.pairs.clear()
            got = self.pairs[a, b] = self.v.keeps(a, b)
        return got

    def follow(self, state: tuple, byte: int) -> tuple[tuple, int]:
        """The state behind one more byte, and the change of the count."""
        suffix, places = state
        text, ids = suffix + bytes((byte,)), self.v.ids
        for at in range(len(text)):
            token = ids.get(text[at:])
            if token is not None:
                before, count = places[at]
                if before < 0 or self._keeps(before, token):
                    count += 1
                    break
        else:
            raise ValueError(f"no token ends with {text!r}")
        begins, at = self.v.begins, 0
        while text[at:] not in begins:
            at += 1
        return (text[at:], (*[(t, c - count) for t, c in places[at:]], (token, 0))), count

    def compile(self, state: int, byte: int) -> int | None:
        if len(self.steps) >= MOST_TRANSITIONS:
            return None
        new, change = self.follow(self.states[state], byte)
        to = self.index.get(new)
        if to is None:
            to = self.index[new] = len(self.states)
            self.states.append(new)
        step = self.steps[state << 8 | byte] = to << 16 | (change + 0x8000)
        return step

    def count(self, data: bytes) -> int:
        """Tokens of one piece; what lies beyond the compiled part is followed without being kept."""
        number, total, steps = 0, 0, self.steps
        for i, byte in enumerate(data):
            step = steps.get(number << 8 | byte)
            if step is None:
                step = self.compile(number, byte)
                if step is None:
                    state = self.states[number]
                    for rest in data[i:]:
                        state, change = self.follow(state, rest)
                        total += change
                    return total
            number, total = step >> 16, total + (step & 0xFFFF) - 0x8000
        return total


class Counter:
    """Token counts of texts; keeps its compiled machines and the counts of pieces it has met."""

    def __init__(self, content: bytes):
        self.vocabulary = Vocabulary(content)
        self.transducer = Transducer(self.vocabulary)
        self.known: dict[bytes, int] = {}

    def _special(self, data: bytes) -> list[tuple[int, int]]:
        """Places of special strings, from the left, the longest first at a place."""
        found, at = [], 0
        while True:
            hits = [(data.find(s, at), -len(s)) for s in self.vocabulary.special if s]
            hits = [h for h in hits if h[0] >= 0]
            if not hits:
                return found
            start, length = min(hits)
            found.append((start, start - length))
            at = start - length

    def _cuts(self, data: np.ndarray, offsets: np.ndarray) -> list[tuple[int, int, int]]:
        """(text, from, to): whole texts, or parts of a very long one that end where a piece surely starts."""
        out = []
        for i, (a, b) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)):
            while b - a > _LONGEST:
                span = data[a + _LONGEST : b]
                white = (span[1:] == 32) & (span[:-1] > 32) & (span[:-1] < 128)
                cut = int(np.argmax(white)) if white.any() else -1
                if cut < 0:
                    break
                out.append((i, a, a + _LONGEST + 1 + cut))
                a += _LONGEST + 1 + cut
            out.append((i, a, b))
        return out

    def counts(self, column: pa.Array) -> np.ndarray:
        data, offsets = common.binary_column(column)
        total = np.zeros(len(offsets) - 1, np.int64)
        parts, held = [], 0
        for part in self._cuts(data, offsets):
            parts.append(part)
            held += part[2] - part[1]
            if held >= _PIECE:
                self._add(data, parts, total)
                parts, held = [], 0
        if parts:
            self._add(data, parts, total)
        return total

    def _add(self, data: np.ndarray, parts: list[tuple[int, int, int]], total: np.ndarray) -> None:
        # One buffer, a zero byte behind each text.
        joined = b"\0".join(data[a:b].tobytes() for _, a, b in parts) + b"\0"
        buffer = np.frombuffer(joined, np.uint8)
        ends = np.cumsum([b - a + 1 for _, a, b in parts])
        points = np.frombuffer(joined.decode("utf-8", "replace").encode("utf-32-le"), np.uint32)
        width = 1 + (points >= 0x80) + (points >= 0x800) + (points >= 0x10000)
        place = np.append(0, np.cumsum(width))
        if place[-1] != len(joined):
            raise ValueError("a text is not UTF-8")
        reset = np.zeros(len(points), bool)
        reset[np.searchsorted(place, ends - 1)] = True
        specials = np.array(self._special(joined), np.int64).reshape(-1, 2)
        for a, b in np.searchsorted(place, specials):
            reset[a:b] = True
        symbol = symbols(points, reset)
        begin = np.flatnonzero(piece_starts(symbol))
        text = symbol[begin] != RESET
        first, last = place[begin], place[np.append(begin[1:], len(points))]
        first, last = first[text], last[text]
        keys = common.string_hashes(buffer, first, last, 8)
        _, at, back = np.unique(keys, return_index=True, return_inverse=True)
        # A piece counts as another only if all bytes agree; one that only shares the hash is counted by itself.
        size, twin = last - first, at[back]
        other = np.flatnonzero((size != size[twin]) | ~common.same_strings(buffer, first, first[twin], np.minimum(size, size[twin])))
        back[other] = len(at) + np.arange(len(other))
        at = np.append(at, other)
        if len(self.known) > MOST_PIECES:
            self.known.clear()
        known, sizes = self.known, np.empty(len(at), np.int64)
        for i, (a, b) in enumerate(zip(first[at].tolist(), last[at].tolist(), strict=True)):
            piece = joined[a:b]
            size = known.get(piece)
            if size is None:
                size = self.transducer.count(piece)
                if b - a <= LONGEST_KEPT:
                    known[piece] = size
            sizes[i] = size
        owner = np.searchsorted(ends, first, side="right")
        got = np.bincount(owner, weights=sizes[back], minlength=len(parts)).astype(np.int64)
        if len(specials):
            got += np.bincount(np.searchsorted(ends, specials[:, 0], side="right"), minlength=len(parts))
        np.add.at(total, [i for i, _, _ in parts], got)


_counters: dict[int, Counter] = {}


def _counter(content: bytes) -> Counter:
    """One a worker process, so that what is compiled serves its next tasks."""
    key = hash(content)
    if key not in _counters:
        _counters.clear()
        _counters[key] = Counter(content)
    return _counters[key]


def count_tokens(docs: DataFrame, vocabulary_path: str, limit: int = 512, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit of every row; the vocabulary file is read once, on the driver."""
    spark = docs.sparkSession
    with open(vocabulary_path, "rb") as file:
        shared = spark.sparkContext.broadcast(file.read())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts = _counter(shared.value).counts(batch.column(1))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(counts), pa.array(counts > limit)], names=["doc_id", "n_bytes", "n_tokens", "over_limit"])

    picked = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"), F.coalesce(F.octet_length(text), F.lit(0)).cast("long").alias("n_bytes"))
    return picked.mapInArrow(run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")


def query(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return count_tokens(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("byte_bpe_50k.json"))
