"""Byte-level BPE by a lazily determinised finite-state transducer, and decoding by an incremental UTF-8 machine.

The encoding of a byte string ends, for each of its prefixes, in exactly one token, and two tokens may stand side by
side exactly if encoding their concatenation gives the two again. So a nondeterministic transducer that has read a
prefix is in one state for each way to go on: the last token of a shorter prefix and the bytes read since, as long as
some token begins with them. Its subsets become deterministic states when a text first needs them. A step from state to
state gives the token that ends with the byte read. A state with a single open way says so, and all tokens before that
way are emitted with the step that leads to it; where several ways stay open for LOOK bytes, the tokens that all of them go
back to are emitted. So tokens leave a few tokens' length after they were read: tests measure it.
"""

from __future__ import annotations

import base64
import gc
import re
from array import array
from collections.abc import Iterator
from contextlib import contextmanager
from functools import lru_cache

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stayflow.llm.common import free_name

#: Splits a text before the merges; GPT-2's public pattern.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: PATTERN for texts that have characters up to U+00FF only, of which it spells out the classes.
_L, _N, _S = "A-Za-zªµºÀ-ÖØ-öø-ÿ", "0-9²³¹¼-¾", r"\t-\r \x85\xa0"
LATIN_PATTERN = rf"'(?:s|t|re|ve|m|ll|d)| ?[{_L}]+| ?[{_N}]+| ?[^{_S}{_L}{_N}]+|[{_S}]+(?![^{_S}])|[{_S}]+"
#: Letters and numbers that were assigned after Unicode 16, which the tokenizer library does not know as such
#: and the regex module may.
NEWER = (
    "558 58B-58C 88F C5C CDC 208F 209D-209F A7CE-A7CF A7D2 A7D4 A7DD A7E2 A7F1 AB6C-AB6D 107BB-107BF 10940-10959 10EC5-10EC7 "
    "10ED9-10EEE 11B0A 11DB0-11DDB 11DE0-11DE9 11DF1 1246F 12475-1247F 12550-12686 16EA0-16EB8 16EBB-16ED3 16FF2-16FF6 "
    "187F8-187FF 18CD6-18CDA 18D09-18D20 18D80-18DF2 18E00-19191 191A0-191D2 1B123-1B128 1B168 1D6A6 1DF1F-1DF24 1DF2B-1DF81 "
    "1DF90-1DF96 1DFCD-1DFFF 1E6C0-1E6DE 1E6E0-1E6E2 1E6E4-1E6E5 1E6E7-1E6ED 1E6F0-1E6F4 1E6FE-1E6FF 2B73A-2B73F 2B81E "
    "2CEA2-2CEAD 323B0-33479 3D000-3FC3F"
)
_NEWER = "".join("-".join(chr(int(c, 16)) for c in span.split("-")) for span in NEWER.split())
#: PATTERN for texts that have such characters: they are neither letters nor numbers.
NEWER_PATTERN = rf"""'s|'t|'re|'ve|'m|'ll|'d| ?(?:(?![{_NEWER}])\p{{L}})+| ?(?:(?![{_NEWER}])\p{{N}})+| ?(?:[{_NEWER}]|[^\s\p{{L}}\p{{N}}])+|\s+(?!\S)|\s+"""
#: Deterministic states, moves between them, known pieces of a generation, and pairs of tokens that a worker keeps before it
#: begins anew.
STATES, MOVES, PIECES, PAIRS = 200_000, 1_000_000, 100_000, 250_000
#: Bytes for which several ways may stay open before they are traced back to what they have in common.
LOOK = 64


def load_ranks(path: str) -> dict[bytes, int]:
    """A tiktoken rank file: a line holds a token in base64 and its rank."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines if line.strip())}


class Transducer:
    """Encodes byte strings by merge ranks, a byte at a time."""

    def __init__(self, ranks: dict[bytes, int], states: int = STATES, moves: int = MOVES):
        if missing := [i for i in range(256) if bytes([i]) not in ranks]:
            raise ValueError(f"no token for {len(missing)} single bytes")
        self.ranks, self.limit, self.most = ranks, states, moves
        self.token = {rank: token for token, rank in ranks.items()}
        self.length = {rank: len(token) for token, rank in ranks.items()}
        self.proper = {token[:n] for token in ranks for n in range(1, len(token))}
        self.pairs: dict[tuple[int, int], bool] = {}
        self._clear()

    def _clear(self) -> None:
        # A state is a multiple of 256; with a byte added it is a key of moves. Its content is the longest of the runs of
        # bytes read since the end of a token, then for each way the last token and how many of these bytes came since.
        self.known: dict[tuple, int] = {}
        self.content: list[tuple] = []
        self.moves: dict[int, tuple[int, int, int]] = {}
        self.start = self._state((b"", -1, 0))

    def _state(self, ways: tuple) -> int:
        at = self.known.get(ways)
        if at is None:
            at = self.known[ways] = len(self.content) << 8
            self.content.append(ways)
        return at

    def merged(self, data: bytes) -> list[int]:
        """The encoding by its definition: merge the neighbours of lowest joint rank, leftmost first, until none is left."""
        parts = [data[i : i + 1] for i in range(len(data))]
        while len(parts) > 1:
            joint = [self.ranks.get(a + b, 1 << 60) for a, b in zip(parts, parts[1:], strict=False)]
            best = min(joint)
            if best == 1 << 60:
                break
            at = joint.index(best)
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return [self.ranks[p] for p in parts]

    def fits(self, last: int, token: int) -> bool:
        """May token follow last? -1 stands for the beginning."""
        found = self.pairs.get((last, token))
        if found is None:
            if len(self.pairs) >= PAIRS:
                self.pairs.clear()
            before = self.token[last] if last >= 0 else b""
            found = self.merged(before + self.token[token]) == ([last, token] if last >= 0 else [token])
            self.pairs[last, token] = found
        return found

    def _move(self, state: int, byte: int) -> tuple[int, int, int]:
        """The next state, the token that ends with byte (or -1), and the bytes since the only open way began (or -1)."""
        since, *old = self.content[state >> 8]
        read, ways, ended = since + bytes((byte,)), [], -1
        for last, n in zip(old[::2], old[1::2], strict=True):
            part = read[len(since) - n :]
            if part in self.proper:
                ways += (last, n + 1)
            token = self.ranks.get(part)
            if token is not None and ended < 0 and self.fits(last, token):
                ended = token
        longest = ways[1] if ways else 0
        ways = (read[len(read) - longest :], *ways, ended, 0) if ended >= 0 else (read[len(read) - longest :], *ways)
        since = ways[2] if len(ways) == 3 else -1
        if len(self.content) >= self.limit and ways not in self.known or len(self.moves) >= self.most:
            self._clear()
            return self._state(ways), ended, since
        found = self.moves[state + byte] = self._state(ways), ended, since
        return found

    def settled(self, state: int, ended: list[int]) -> int:
        """The end of the last token that all ways open in state have in common, after the bytes that gave ended."""
        starts = sorted(len(ended) - n for n in self.content[state >> 8][2::2])
        chain, at = {0}, starts[0]
        while at > 0:
            chain.add(at)
            at -= self.length[ended[at - 1]]
        common = starts[0]
        for at in starts:
            while at not in chain:
                at -= self.length[ended[at - 1]]
            common = min(common, at)
        return common

    def pieces(self, data: bytes) -> Iterator[tuple[int, list[int]]]:
        """(bytes read, tokens) whenever tokens are certain; the last with the end of the data."""
        state, ended, moves, wait = self.start, [], self.moves, LOOK
        for read, byte in enumerate(data, 1):
            state, token, since = moves.get(state + byte) or self._move(state, byte)
            moves = self.moves
            ended.append(token)
            if since >= 0:
                cut = len(ended) - since
            elif len(ended) >= wait:
                cut = self.settled(state, ended)
            else:
                continue
            if cut:
                yield read, self._back(ended[:cut])
                del ended[:cut]
            wait = len(ended) + LOOK
        if ended:
            yield len(data), self._back(ended)

    def encode(self, data: bytes) -> list[int]:
        return [token for _, tokens in self.pieces(data) for token in tokens]

    def _back(self, ended: list[int]) -> list[int]:
        at, tokens = len(ended), []
        while at > 0:
            tokens.append(token := ended[at - 1])
            at -= self.length[token]
        tokens.reverse()
        return tokens


class Encoder(dict):
    """Token ids of whole texts. A dictionary of the pieces met, each with its ids as 32-bit integers.

    When it is full, its pieces become the older generation, of which those met again are kept.
    """

    def __init__(self, ranks: dict[bytes, int], pattern: str = PATTERN, states: int = STATES, pieces: int = PIECES):
        self.machine, self.limit = Transducer(ranks, states), pieces
        self.any = regex.compile(pattern).findall
        self.latin = re.compile(LATIN_PATTERN).findall if pattern == PATTERN else self.any
        self.newer = regex.compile(NEWER_PATTERN).findall if pattern == PATTERN else self.any
        self.has_newer = re.compile(f"[{_NEWER}]").search
        self.older: dict[str, bytes] = {}

    def __missing__(self, piece: str) -> bytes:
        ids = self.older.get(piece)
        if ids is None:
            ids = array("i", self.machine.encode(piece.encode("utf-8", "surrogatepass"))).tobytes()
        if len(piece) <= 64:
            if len(self) >= self.limit:
                self.older = dict(self)
                self.clear()
            self[piece] = ids
        return ids

    def find(self, text: str) -> list[str]:
        try:
            text.encode("latin-1")
        except UnicodeEncodeError:
            return (self.newer if self.has_newer(text) else self.any)(text)
        return self.latin(text)

    def encode(self, text: str) -> bytes:
        return b"".join(map(self.__getitem__, self.find(text)))


class Utf8Machine:
    """Turns bytes that come in pieces into text; its state is the beginning of a character that is not complete."""

    def __init__(self):
        self.rest = b""

    @staticmethod
    def follows(lead: int) -> tuple[int, int, int]:
        """For a first byte: how many bytes follow and the bounds of the next one; (0, 0, 0) if none may follow."""
        if 0xC2 <= lead <= 0xDF:
            return 1, 0x80, 0xBF
        if 0xE0 <= lead <= 0xEF:
            return 2, 0xA0 if lead == 0xE0 else 0x80, 0x9F if lead == 0xED else 0xBF
        if 0xF0 <= lead <= 0xF4:
            return 3, 0x90 if lead == 0xF0 else 0x80, 0x8F if lead == 0xF4 else 0xBF
        return 0, 0, 0

    @classmethod
    def pending(cls, data: bytes) -> int:
        """How many bytes at the end begin a character that more bytes may complete."""
        for back in range(1, min(3, len(data)) + 1):
            n, low, high = cls.follows(data[-back])
            if n:
                for byte in data[len(data) - back + 1 :]:
                    if not low <= byte <= high:
                        return 0
                    n, low, high = n - 1, 0x80, 0xBF
                return back if n else 0
            if not 0x80 <= data[-back] <= 0xBF:
                return 0
        return 0

    def feed(self, data: bytes) -> str:
        data = self.rest + data
        cut = len(data) - self.pending(data)
        self.rest = data[cut:]
        return data[:cut].decode("utf-8", "replace")

    def finish(self) -> str:
        rest, self.rest = self.rest, b""
        return rest.decode("utf-8", "replace")


class Decoder:
    """Texts of token ids, a few thousand tokens at a time. An id that no token has gives U+FFFD."""

    def __init__(self, ranks: dict[bytes, int], at_once: int = 4096):
        self.at_once = at_once
        self.token = [b"\xef\xbf\xbd"] * (max(ranks.values()) + 1)
        for token, rank in ranks.items():
            self.token[rank] = token

    def _bytes(self, i: int | None) -> bytes:
        return self.token[i] if i is not None and 0 <= i < len(self.token) else b"\xef\xbf\xbd"

    def decode(self, ids: list[int] | array) -> str:
        machine, out = Utf8Machine(), []
        for at in range(0, len(ids), self.at_once):
            part = ids[at : at + self.at_once]
            try:
                data = b"".join(map(self.token.__getitem__, part)) if min(part) >= 0 else None
            except (IndexError, TypeError):
                data = None
            out.append(machine.feed(b"".join(map(self._bytes, part)) if data is None else data))
        return "".join([*out, machine.finish()])


@lru_cache(4)
def _encoder(path: str, pattern: str) -> Encoder:
    return Encoder(load_ranks(path), pattern)


@lru_cache(4)
def _decoder(path: str) -> Decoder:
    return Decoder(load_ranks(path))


@contextmanager
def _no_gc() -> Iterator[None]:
    """The states and pieces hold no cycles, and looking for some in them takes long."""
    on = gc.isenabled()
    gc.disable()
    try:
        yield
    finally:
        if on:
            gc.enable()


def encode(docs: DataFrame, vocabulary: str, text: str = "text", out: str = "token_ids", pattern: str = PATTERN, keep_text: bool = True, decoded: str | None = None) -> DataFrame:
    """Add the token ids of each whole text as array<int>; a null or empty text has none.

    vocabulary: the path of a rank file that every executor can open. Rows, repeats and other columns stay as they are
    (columns named `out` or `decoded` are replaced); the text goes if keep_text is false. With `decoded`, the ids are
    decoded again in the same pass, to a column of that name.
    """
    new = [out, *[decoded] * bool(decoded)]
    others = [c for c in docs.columns if c.lower() not in {n.lower() for n in new} and (keep_text or c.lower() != text.lower())]
    kept = [F.col(f"`{c}`") for c in others]
    schema = docs.select(*kept, F.lit(None).cast("array<int>").alias(out), *[F.lit(None).cast("string").alias(n) for n in new[1:]]).schema
    at = free_name(docs, "encoded_text")

    def ids(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, decoder = _encoder(vocabulary, pattern), _decoder(vocabulary) if decoded else None
        for whole in batches:
            for start in range(0, whole.num_rows, 500):
                batch = whole.slice(start, 500)
                data, offsets = [], [0]
                with _no_gc():
                    for t in batch.column(len(others)).to_pylist():
                        data.append(encoder.encode(t or ""))
                        offsets.append(offsets[-1] + len(data[-1]) // 4)
                flat = pa.Array.from_buffers(pa.int32(), offsets[-1], [None, pa.py_buffer(b"".join(data))])
                columns = [*batch.columns[: len(others)], pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), flat)]
                if decoder:
                    columns.append(pa.array([decoder.decode(array("i", d)) for d in data], pa.string()))
                yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return docs.select(*kept, F.col(text).alias(at)).mapInArrow(ids, schema)


def decode(docs: DataFrame, vocabulary: str, ids: str = "token_ids", out: str = "decoded") -> DataFrame:
    """Add the text of an array<int> of token ids; null ids give null, no ids the empty text, unknown ids U+FFFD."""

    @F.arrow_udf("string")
    def decoded(rows: pa.Array) -> pa.Array:
        decoder = _decoder(vocabulary)
        return pa.array([None if not r.is_valid else decoder.decode(r.values.to_numpy(zero_copy_only=False).tolist() if not r.values.null_count else r.as_py()) for r in rows], pa.string())

    return docs.withColumn(out, decoded(F.col(ids)))
