"""Byte-level BPE as a lazily determinised finite-state transducer, with a streaming UTF-8 decoder.

The merges of a rank file are compiled into a transducer that reads bytes and emits token ids. Two tokens may stand
side by side exactly when merging their joint bytes gives back these two tokens, and the tokenisation of a string is
its only split into tokens whose neighbours all fit. So the nondeterministic machine follows, for each place where a
token may start, one path through the trie of the vocabulary. The deterministic machine holds the live paths of one
input prefix together: each path is (tokens not yet emitted, trie node). A path dies as soon as no token continues it;
what all live paths agree on is emitted. The lookahead is therefore bounded by the longest token. Determinising is
lazy: a transition is built when it is asked for the second time, a piece that asks for one the first time is run on
the nondeterministic machine. States are thrown away when there are too many, to be built again.

Decoding streams: token bytes go through an incremental UTF-8 state machine which keeps an incomplete character at
the end of a chunk for the next one.

Nulls and edge cases: a null or empty text has no ids; a null id list decodes to the empty string; very long texts and
very long words run in linear time; repeated rows are encoded each; further columns stay as they are.
"""

from __future__ import annotations

import base64
from array import array
from collections.abc import Iterable, Iterator
from itertools import chain, islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

#: Characters with the property White_Space, as a character class body; engines differ in their ``\\s``.
SPACE = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: Bound of each cache, in entries. A full cache makes room and fills again; results do not depend on it.
CACHE = 300_000
#: Words in each of the two generations of remembered words; about 100 MB each.
WORDS = 450_000


def read_ranks(path: str) -> dict[bytes, int]:
    """Token bytes -> id of a rank file (base64 token, space, rank per line)."""
    with open(path, "rb") as file:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in file if line.strip())}


class Transducer:
    """Encodes one pattern match (``piece``) at a time."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.token = {i: b for b, i in ranks.items()}
        self.edge: dict[int, int] = {}  # trie: node * 256 + byte -> node
        self.at: list[int] = [-1]  # trie node -> token id or -1
        for word, i in ranks.items():
            node = 0
            for byte in word:
                nxt = self.edge.get(node << 8 | byte)
                if nxt is None:
                    nxt = self.edge[node << 8 | byte] = len(self.at)
                    self.at.append(-1)
                node = nxt
            self.at[node] = i
        size = max(self.token, default=-1) + 1
        self.length, self.shorter = [0] * size, [-1] * size  # of every token, and the longest token that is a proper prefix of it
        for i, b in self.token.items():
            self.length[i] = len(b)
            self.shorter[i] = next((ranks[b[:k]] for k in range(len(b) - 1, 0, -1) if b[:k] in ranks), -1)
        self._fits: dict[int, bool] = {}
        self._reset()

    def _reset(self) -> None:
        # a state: the last emitted token (where a path still needs it) and the live paths, (pending tokens, trie node)
        # each, in the order in which their open tokens start
        start = (-1, (((), 0),))
        self.states, self.paths = {start: 0}, [start]
        self.moves: dict[int, int | tuple[int, tuple[int, ...]]] = {}  # state * 256 + byte -> state, or with tokens
        self.asked: set[int] = set()  # transitions that were missing once

    def stay_apart(self, x: bytes, y: bytes) -> bool:
        """Merges the joint bytes by definition, lowest rank first and leftmost among equals: whether x and y come out."""
        rank, none = self.ranks.get, 1 << 30
        parts = [x[i:i + 1] for i in range(len(x))] + [y[i:i + 1] for i in range(len(y))]
        ranks = [rank(parts[i] + parts[i + 1], none) for i in range(len(parts) - 1)]
        border = len(x) - 1  # the pair on both sides of the border
        while len(parts) > 2:
            best = min(ranks)
            i = ranks.index(best)
            if best == none or i == border:
                return False
            parts[i:i + 2] = [parts[i] + parts[i + 1]]
            del ranks[i]
            border -= i < border
            if i < len(ranks):
                ranks[i] = rank(parts[i] + parts[i + 1], none)
            if i:
                ranks[i - 1] = rank(parts[i - 1] + parts[i], none)
        return parts[0] == x and ranks[0] == none

    def fits(self, a: int, b: int) -> bool:
        """Whether token b may follow token a inside a piece."""
        known = self._fits.get(a << 24 | b)
        if known is None:
            if len(self._fits) > CACHE:
                self._fits.clear()
            known = self._fits[a << 24 | b] = self.stay_apart(self.token[a], self.token[b])
        return known

    def step(self, state: int, byte: int) -> int | tuple[int, tuple[int, ...]]:
        """Next state, together with the tokens emitted on the way if there are any."""
        last, paths = self.paths[state]
        live, ended = [], None
        for pending, node in paths:
            nxt = self.edge.get(node << 8 | byte)
            if nxt is None:
                continue
            live.append((pending, nxt))
            t = self.at[nxt]
            if t >= 0 and ended is None:
                before = pending[-1] if pending else last
                if before < 0 or self.fits(before, t):
                    ended = ((*pending, t), 0)
        if ended is None:
            raise ValueError("the rank file lacks a byte")
        live.append(ended)
        k, n, first = 0, min([len(p) for p, _ in live]), live[0][0]
        while k < n and all([p[k] == first[k] for p, _ in live]):
            k += 1
        if k:
            live, last = [(p[k:], node) for p, node in live], first[k - 1]
        key = (last if k == n else -1, tuple(live))
        to = self.states.get(key)
        if to is None:
            to = self.states[key] = len(self.paths)
            self.paths.append(key)
        return (to, first[:k]) if k else to

    def simulate(self, piece: bytes) -> list[int]:
        """One piece on the nondeterministic machine: longest tokens first, stepping back where no token fits.

        A place that has failed is never entered again, since only one chain of tokens leads to it.
        """
        edge, tokens, fits, length, shorter = self.edge.get, self.at, self._fits.get, self.length, self.shorter
        n, at, out, failed, last = len(piece), 0, [], set(), -1
        while at < n:
            node, t = 0, -1
            for i in range(at, n):
                node = edge(node << 8 | piece[i])
                if node is None:
                    break
                if tokens[node] >= 0:
                    t = tokens[node]
            while True:
                if at + length[t] not in failed:
                    if last < 0:
                        break
                    good = fits(last << 24 | t)
                    if good or good is None and self.fits(last, t):
                        break
                t = shorter[t]
                while t < 0:
                    failed.add(at)
                    t = out.pop()
                    last = out[-1] if out else -1
                    at -= length[t]
                    t = shorter[t]
            out.append(t)
            last = t
            at += length[t]
        return out

    def encode(self, piece: bytes) -> list[int]:
        whole = self.ranks.get(piece)
        if whole is not None:
            return [whole]
        if len(self.moves) > CACHE:
            self._reset()
        if len(self.asked) > CACHE:
            self.asked.clear()
        out: list[int] = []
        state, moves = 0, self.moves
        for byte in piece:
            key = state << 8 | byte
            move = moves.get(key)
            if move is None:
                if key not in self.asked and len(piece) <= 64:
                    self.asked.add(key)
                    return self.simulate(piece)
                self.asked.discard(key)
                move = moves[key] = self.step(state, byte)
            if type(move) is int:
                state = move
            else:
                state, emitted = move
                out += emitted
        return out + [*self.paths[state][1][-1][0]]  # the path that has just ended a token is the last one


class Encoder:
    """Whole texts: split by the pattern, each match through the transducer, frequent matches remembered."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        import re

        import regex

        self.find = regex.compile(pattern.replace(r"\S", f"[^{SPACE}]").replace(r"[^\s", f"[^{SPACE}").replace(r"\s", f"[{SPACE}]")).findall
        plain = pattern.replace(r"[^\s\p{L}\p{N}]", "[^\t-\r A-Za-z0-9]").replace(r"\p{L}", "[A-Za-z]").replace(r"\p{N}", "[0-9]")
        plain = plain.replace(r"\s", "[\t-\r ]").replace(r"\S", "[^\t-\r ]")
        self.find_ascii = re.compile(plain).findall if r"\p" not in plain else self.find
        self.machine = Transducer(ranks)
        self.known: dict[str, tuple[int, ...]] = {}
        self.older: dict[str, tuple[int, ...]] = {}

    def __call__(self, text: str | None) -> list[int]:
        text = text or ""
        pieces = (self.find_ascii if text.isascii() else self.find)(text)
        ids = [*map(self.known.get, pieces)]
        if None in ids:
            ids = [self.one(p) if i is None else i for p, i in zip(pieces, ids)]
        return [*chain.from_iterable(ids)]

    def one(self, piece: str) -> tuple[int, ...]:
        known = self.known
        ids = known.get(piece) or self.older.get(piece) or tuple(self.machine.encode(piece.encode()))
        if len(piece) <= 64:
            if len(known) > WORDS:
                self.older, self.known = known, {}
            self.known[piece] = ids
        return ids


_ENCODERS: dict[tuple[str, str], Encoder] = {}


def encoder_for(path: str, pattern: str, ranks: dict[bytes, int]) -> Encoder:
    """The encoder of this Python process, kept from task to task."""
    found = _ENCODERS.get((path, pattern))
    if found is None:
        _ENCODERS.clear()
        found = _ENCODERS[path, pattern] = Encoder(ranks, pattern)
    return found


_DECODERS: dict[str, dict[int, bytes]] = {}


def decoder_for(path: str, ranks: dict[bytes, int]) -> dict[int, bytes]:
    if path not in _DECODERS:
        _DECODERS.clear()
        _DECODERS[path] = {i: b for b, i in ranks.items()}
    return _DECODERS[path]


class Utf8Stream:
    """Incremental UTF-8 decoder: ``feed`` returns the text of all complete characters so far.

    The state is the incomplete character at the end of the input: how many bytes are missing, and which values the
    next byte may take. Malformed bytes become U+FFFD.
    """

    def __init__(self):
        self.held = b""

    @staticmethod
    def incomplete(data: bytes) -> int:
        """Length of an unfinished but so far well-formed character at the end of ``data``."""
        for back in range(1, min(3, len(data)) + 1):
            lead = data[-back]
            if 0x80 <= lead <= 0xBF:
                continue
            need = 2 if 0xC2 <= lead <= 0xDF else 3 if 0xE0 <= lead <= 0xEF else 4 if 0xF0 <= lead <= 0xF4 else 1
            if need <= back:
                return 0
            if back > 1:  # the second byte has a narrower range after some leads
                low = {0xE0: 0xA0, 0xF0: 0x90}.get(lead, 0x80)
                high = {0xED: 0x9F, 0xF4: 0x8F}.get(lead, 0xBF)
                if not low <= data[-back + 1] <= high:
                    return 0
            return back
        return 0

    def feed(self, data: bytes) -> str:
        data = self.held + data
        cut = len(data) - self.incomplete(data)
        self.held = data[cut:]
        return data[:cut].decode("utf-8", "replace")

    def end(self) -> str:
        left, self.held = self.held, b""
        return left.decode("utf-8", "replace")


def decode_stream(ids: Iterable[int], token: dict[int, bytes], chunk: int = 4096) -> Iterator[str]:
    """Text of ``ids`` in pieces, never splitting a character."""
    stream, ids = Utf8Stream(), iter(ids)
    while part := [*islice(ids, chunk)]:
        yield stream.feed(b"".join(map(token.__getitem__, part)))
    yield stream.end()


def _rebatched(batches: Iterator[pa.RecordBatch], rows: int = 256) -> Iterator[pa.RecordBatch]:
    """Smaller batches, so that the results of a batch of long texts stay small."""
    for batch in batches:
        for i in range(0, batch.num_rows, rows):
            yield batch.slice(i, rows)


def _ids(texts: pa.Array, encoder: Encoder) -> pa.ListArray:
    offsets, flat = [0], array("i")
    for text in texts:
        flat.extend(encoder(text.as_py()))
        offsets.append(len(flat))
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(np.frombuffer(flat, np.int32)))


def _texts(ids: pa.ListArray, token: dict[int, bytes]) -> pa.Array:
    return pa.array(["".join(decode_stream(x.values.to_pylist() if x.is_valid else (), token)) for x in ids], pa.string())


def _mapped(df: DataFrame, rank_path: str, added: list[T.StructField], make) -> DataFrame:
    """``df`` with the columns ``added``, which ``make(batch, ranks)`` returns for every batch."""
    known = df.sparkSession.sparkContext.broadcast(read_ranks(rank_path))  # bounded by the vocabulary
    names = [f.name for f in added]
    keep = [c for c in df.columns if c not in names]
    schema = T.StructType([df.schema[c] for c in keep] + added)

    def run(batches):
        for batch in _rebatched(batches):
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), *make(batch, known.value)], names=[*keep, *names])

    return df.mapInArrow(run, schema)


def encode(docs: DataFrame, rank_path: str, pattern: str, text_col: str = "text", to: str = "ids") -> DataFrame:
    """``docs`` with the token ids of ``text_col`` in the new array<int> column ``to``."""
    return _mapped(docs, rank_path, [T.StructField(to, T.ArrayType(T.IntegerType()))],
                   lambda batch, ranks: [_ids(batch.column(text_col), encoder_for(rank_path, pattern, ranks))])


def decode(encoded: DataFrame, rank_path: str, ids_col: str = "ids", to: str = "decoded") -> DataFrame:
    """``encoded`` with the text of ``ids_col`` in the new string column ``to``."""
    return _mapped(encoded, rank_path, [T.StructField(to, T.StringType())],
                   lambda batch, ranks: [_texts(batch.column(ids_col), decoder_for(rank_path, ranks))])


def round_trip(docs: DataFrame, rank_path: str, pattern: str, text_col: str = "text", ids: str = "ids", decoded: str = "decoded") -> DataFrame:
    """``encode`` and ``decode`` of the ids in one pass, so that ids do not travel between two Python workers."""

    def make(batch, ranks):
        made = _ids(batch.column(text_col), encoder_for(rank_path, pattern, ranks))
        return [made, _texts(made, decoder_for(rank_path, ranks))]

    return _mapped(docs, rank_path, [T.StructField(ids, T.ArrayType(T.IntegerType())), T.StructField(decoded, T.StringType())], make)
