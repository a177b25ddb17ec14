"""Byte-level BPE as a finite-state transducer, and streaming decoding by a UTF-8 state machine.

A sequence of tokens is the encoding of its bytes exactly if every two neighbours are, so the merges compile into a
transducer whose states are (last token, bytes read of the next one). It does not know at once where a token ends;
determinising it keeps all open readings side by side, each with the tokens it has not emitted yet, and emits
what all of them share, after a lookahead of at most a longest token. States are made when a text first
reaches them, and forgotten together when there are too many.

Decoding joins the bytes of the tokens. A second automaton, compiled from bytes to whole tokens, follows the UTF-8 form
across tokens, so that a stream can be cut only between characters.
"""

from __future__ import annotations

import base64
from collections.abc import Iterable, Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridtally.session import ship_package

#: States, checked token pairs and matches that one Python worker remembers; beyond them it starts anew.
STATES, PAIRS, MATCHES = 250_000, 600_000, 150_000
#: Matches of a text encoded at once; longer matches than LONG bytes are not remembered.
CHUNK, LONG = 20_000, 64
#: Documents encoded between two batches of results.
ROWS = 256


def vocabulary_path(name: str = "byte_bpe_multi_50k.tiktoken") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def read_ranks(path: str) -> dict[bytes, int]:
    """Bytes of every token and its rank, which is its id too."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


BYTE = [bytes((b,)) for b in range(256)]
NO_MOVES: dict = {}


class State:
    """A set of open readings: (bytes of ids not emitted yet, last token, bytes of the open token), longest open token first."""

    __slots__ = ("readings", "moves")

    def __init__(self, readings: tuple):
        self.readings, self.moves = readings, NO_MOVES


class Transducer:
    """Token ids of one match as little-endian unsigned 32-bit bytes."""

    def __init__(self, ranks: dict[bytes, int]):
        missing = [b for b in range(256) if bytes([b]) not in ranks]
        if missing:
            raise ValueError(f"the vocabulary lacks {len(missing)} single bytes")
        self.ranks = ranks
        self.tokens: list[bytes] = [b""] * (max(ranks.values()) + 1)
        for t, i in ranks.items():
            self.tokens[i] = t
        more = {t[:n] for t in ranks for n in range(1, len(t))}
        #: Every beginning of a token: the token it is (or -1), whether a longer one begins with it, and the one copy of its bytes.
        self.beginnings = {p: (ranks.get(p, -1), p in more, p) for p in more.union(ranks)}
        self.packed = [i.to_bytes(4, "little") for i in range(len(self.tokens))]
        self.halves: dict[int, tuple[int, int]] = {}
        self.pairs: dict[int, bool] = {}
        self._forget()

    def _forget(self) -> None:
        self.start = State(((b"", -1, b""),))
        self.states: dict[tuple, State] = {}

    def parts(self, token: int) -> tuple[int, int]:
        """The two tokens that the last merge within ``token`` joins."""
        if token not in self.halves:
            word = self.tokens[token]
            parts = [word[i : i + 1] for i in range(len(word))]
            while len(parts) > 2:
                found = [(self.ranks[a + b], i) for i, (a, b) in enumerate(zip(parts, parts[1:])) if a + b in self.ranks]
                if not found:
                    raise ValueError(f"no merges lead to token {token}")
                _, i = min(found)
                parts[i : i + 2] = [parts[i] + parts[i + 1]]
            self.halves[token] = (self.ranks[parts[0]], self.ranks[parts[1]])
        return self.halves[token]

    def follows(self, a: int, b: int) -> bool:
        """Whether ``a`` then ``b`` stays as it is: no merge ever joined a piece that ended ``a`` with one that began ``b``.

        The merges of both are undone from the last one on. At each step two pieces touch at the seam; they were joined if their
        merge came before the one that took the left piece (of equal merges the left one is first) and not after that of the right.
        """
        tokens, ranks = self.tokens, self.ranks
        x, y, taken_x, taken_y, answer = a, b, len(tokens), len(tokens), True
        while True:
            left, right = tokens[x], tokens[y]
            joined = ranks.get(left + right)
            if joined is not None and joined < taken_x and joined <= taken_y:
                answer = False
                break
            single_x, single_y = len(left) == 1, len(right) == 1
            if single_x and single_y:
                break
            if single_y or (not single_x and x > y):
                taken_x, x = x, self.parts(x)[1]
            else:
                taken_y, y = y, self.parts(y)[0]
        if len(self.pairs) >= PAIRS:
            self.pairs.clear()
        self.pairs[a * len(tokens) + b] = answer
        return answer

    def _step(self, readings: tuple, byte: int) -> tuple[tuple, bytes]:
        """The open readings after one more byte, and what all of them share and is emitted."""
        b, beginnings, pairs, width, on, ended = BYTE[byte], self.beginnings, self.pairs, len(self.tokens), [], False
        for out, last, part in readings:
            grown = part + b
            known = beginnings.get(grown)
            if known is None:
                continue
            token, more, grown = known
            if more:
                on.append((out, last, grown))
            if token >= 0 and not ended:
                fits = True if last < 0 else pairs.get(last * width + token)
                if self.follows(last, token) if fits is None else fits:
                    end, ended = (out + self.packed[token] if out else self.packed[token], token, b""), True
        on.append(end)  # the one encoding of the bytes so far comes last
        first = on[0][0]
        n = min([len(r[0]) for r in on]) if first else 0
        while n and any([not r[0].startswith(first[:n]) for r in on]):
            n -= 4
        return tuple([(out[n:], last, part) for out, last, part in on] if n else on), first[:n]

    def _grow(self, state: State, byte: int) -> tuple[State, bytes]:
        """Adds the move from ``state`` by ``byte``."""
        readings, emitted = self._step(state.readings, byte)
        found = self.states.get(readings)
        if found is None:
            if len(self.states) >= STATES:
                self._forget()
            found = self.states[readings] = State(readings)
        if state.moves is NO_MOVES:
            state.moves = {}
        move = state.moves[byte] = (found, emitted)
        return move

    def __call__(self, word: bytes) -> bytes:
        state, out = self.start, []
        for byte in word:
            move = state.moves.get(byte)
            if move is None:
                move = self._grow(state, byte)
            state, emitted = move
            if emitted:
                out.append(emitted)
        out.append(state.readings[-1][0])
        return b"".join(out)


class Matches(dict):
    """Ids of the matches met before, in two generations; the transducer gives those of new ones."""

    def __init__(self, transducer: Transducer):
        self.transducer, self.older = transducer, {}

    def __missing__(self, match: str) -> bytes:
        ids = self.older.get(match)
        if ids is None:
            ids = self.transducer(match.encode("utf-8"))
        if len(match) <= LONG:
            self[match] = ids
        return ids

    def age(self) -> None:
        """Keeps what was used lately once there are MATCHES of them."""
        if len(self) > MATCHES:
            self.older = dict(self)
            self.clear()


_encoders: dict[tuple[str, str], tuple] = {}


def encoder(path: str, pattern: str):
    """A function from a text to its ids in chunks, sharing what this worker has learnt."""
    import regex

    if (path, pattern) not in _encoders:
        _encoders[path, pattern] = (regex.compile(pattern), Matches(Transducer(read_ranks(path))))
    split, known = _encoders[path, pattern]

    def encode(text: str) -> Iterator[bytes]:
        found = (m[0] for m in split.finditer(text)) if len(text) > 8 * CHUNK else iter(split.findall(text))
        while some := list(islice(found, CHUNK)):
            known.age()
            yield b"".join(map(known.__getitem__, some))

    return encode


#: The bytes that may follow in each state of the UTF-8 form, as (first, last, next state). State 0 is between characters,
#: 1 to 3 await that many continuation bytes, 4 to 7 follow a leading byte E0, ED, F0, F4; BROKEN is not left again.
UTF8 = {
    0: [(0x00, 0x7F, 0), (0xC2, 0xDF, 1), (0xE0, 0xE0, 4), (0xE1, 0xEC, 2), (0xED, 0xED, 5), (0xEE, 0xEF, 2), (0xF0, 0xF0, 6), (0xF1, 0xF3, 3), (0xF4, 0xF4, 7)],
    1: [(0x80, 0xBF, 0)], 2: [(0x80, 0xBF, 1)], 3: [(0x80, 0xBF, 2)],
    4: [(0xA0, 0xBF, 1)], 5: [(0x80, 0x9F, 1)], 6: [(0x90, 0xBF, 2)], 7: [(0x80, 0x8F, 2)],
}
BROKEN = 8


def byte_moves() -> np.ndarray:
    moves = np.full((9, 256), BROKEN, dtype=np.uint8)
    for state, spans in UTF8.items():
        for first, last, to in spans:
            moves[state, first : last + 1] = to
    return moves


class StreamDecoder:
    """Bytes of a stream of tokens, handed out up to the last whole character.

    ``valid`` tells whether all bytes so far are well-formed UTF-8; bytes that are not are handed out unchanged.
    """

    _tables: dict[str, tuple] = {}

    def __init__(self, path: str):
        if path not in self._tables:
            ranks = read_ranks(path)
            tokens = [b""] * (max(ranks.values()) + 1)
            for t, i in ranks.items():
                tokens[i] = t
            moves, after = byte_moves(), np.zeros((len(tokens), 9), dtype=np.uint8)
            for i, t in enumerate(tokens):
                states = np.arange(9)
                for b in t:
                    states = moves[states, b]
                after[i] = states
            self._tables[path] = (tokens, after, moves)
        self.tokens, self.after, self.moves = self._tables[path]
        self.state, self.tail = 0, b""

    @property
    def valid(self) -> bool:
        return self.state != BROKEN

    def feed(self, ids: np.ndarray) -> bytes:
        """Bytes of whole characters that ``ids`` complete."""
        raw = self.tail + b"".join(map(self.tokens.__getitem__, ids.tolist()))
        # Tokens that begin and end between characters need no look unless a character is open before them.
        mixed = np.flatnonzero(self.after[ids, 0] != 0) if len(ids) else ids
        state, at = self.state, 0
        if state:
            mixed = np.arange(len(ids)) if not len(mixed) or mixed[0] else mixed
        i = 0
        while i < len(mixed) or (state and at < len(ids)):
            if state == 0:
                if i < len(mixed) and mixed[i] < at:
                    i = int(np.searchsorted(mixed, at))
                    continue
                at = int(mixed[i])
            state = int(self.after[ids[at], state])
            at += 1
            if state == BROKEN:
                break
            i = max(i, int(np.searchsorted(mixed, at)))
        self.state = state
        if state in (0, BROKEN):
            self.tail = b""
            return raw
        open_at = len(raw) - 1
        while raw[open_at] & 0xC0 == 0x80:
            open_at -= 1
        self.tail = raw[open_at:]
        return raw[:open_at]

    def close(self) -> bytes:
        """What is left of a character that never was completed."""
        rest, self.tail = self.tail, b""
        if self.state:
            self.state = BROKEN
        return rest


def _encoded(batches: Iterable[pa.RecordBatch], path: str, pattern: str) -> Iterator[pa.RecordBatch]:
    """(doc_id, ids, n_tokens) of batches of (doc_id, text)."""
    tokens = encoder(path, pattern)
    for batch in batches:
        for at in range(0, batch.num_rows, ROWS):
            some = batch.slice(at, ROWS)
            ids = [b"".join(tokens(t)) if t else b"" for t in some.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([some.column("doc_id"), pa.array(ids, pa.binary()), pa.array([len(i) // 4 for i in ids], pa.int64())], ["doc_id", "ids", "n_tokens"])


def _decoded(batches: Iterable[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    """The columns of ``_encoded`` with the decoded bytes and whether they are well-formed."""
    for batch in batches:
        for at in range(0, batch.num_rows, ROWS):
            some = batch.slice(at, ROWS)
            decoded, valid = [], []
            for ids in some.column("ids").to_pylist():
                stream, out = StreamDecoder(path), []
                ids = np.frombuffer(ids or b"", dtype="<u4")
                for i in range(0, len(ids), CHUNK):
                    out.append(stream.feed(ids[i : i + CHUNK]))
                out.append(stream.close())
                decoded.append(b"".join(out))
                valid.append(stream.valid)
            yield pa.RecordBatch.from_arrays(
                [*(some.column(c) for c in ("doc_id", "ids", "n_tokens")), pa.array(decoded, pa.binary()), pa.array(valid, pa.bool_())], ["doc_id", "ids", "n_tokens", "decoded", "valid"]
            )


ENCODED = "doc_id long, ids binary, n_tokens long"
DECODED = ENCODED + ", decoded binary, valid boolean"


def _texts(docs: DataFrame) -> DataFrame:
    ship_package(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def encode(docs: DataFrame, path: str | None = None, pattern: str | None = None) -> DataFrame:
    """(doc_id, ids, n_tokens) per row: ids of the whole text as little-endian unsigned 32-bit bytes.

    ``pattern`` splits a text before the merges (by default that of the public rank files); what it leaves out is not encoded. Null and
    empty texts have no ids. Null and repeated doc_id, other columns and rows of any length make no difference.
    """
    import public_tokenizers

    path, pattern = path or vocabulary_path(), pattern or public_tokenizers.PATTERN
    return _texts(docs).mapInArrow(lambda batches: _encoded(batches, path, pattern), ENCODED)


def decode(tokens: DataFrame, path: str | None = None) -> DataFrame:
    """``encode``'s rows with ``decoded`` (bytes) and ``valid`` (they are well-formed UTF-8); null ids decode to nothing."""
    path = path or vocabulary_path()
    ship_package(tokens.sparkSession)
    return tokens.select("doc_id", "ids", "n_tokens").mapInArrow(lambda batches: _decoded(batches, path), DECODED)


def encode_and_decode(docs: DataFrame, path: str | None = None, pattern: str | None = None) -> DataFrame:
    """``decode(encode(docs))`` within one worker: no second process and vocabulary per task, and the ids travel once."""
    import public_tokenizers

    path, pattern = path or vocabulary_path(), pattern or public_tokenizers.PATTERN
    return _texts(docs).mapInArrow(lambda batches: _decoded(_encoded(batches, path, pattern), path), DECODED)


def round_trip(docs: DataFrame, path: str | None = None) -> DataFrame:
    """Digests of every text's ids and of the bytes they decode to."""
    both = encode_and_decode(docs, path)
    return both.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
