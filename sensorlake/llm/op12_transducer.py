"""Byte-level BPE as a finite-state transducer, determinised as texts ask for it.

Encoding. A token sequence is the encoding of its bytes if, and only if, every two
neighbours, encoded together, give these two tokens again: merges never act across
any other border, and whatever else happens does not touch the two. So each prefix of
a piece has exactly one possible last token, and the encoder needs to know
of a prefix only which tokens may still be open.

A state of the transducer holds the starts at which a longer token may still begin
(as nodes of a trie of the vocabulary), each with the tokens that lead to it from the last
one they all share. Reading a byte moves every start down the trie, closes the
one token that agrees with its predecessor, drops starts whose node has no such
child, and emits the tokens that all remaining starts share. A start lives for no more
bytes than the longest token has, which bounds the lookahead. States and their transitions are made when
a text first takes them and remembered; equal situations are one state.

Decoding streams ids through an incremental UTF-8 state machine: bytes come out
once they complete a character, the rest waits for the next id.

* each match of the pattern is encoded separately; a piece that is a token as a whole is that token, as the library has it
* null text: the empty text, no ids; null ids: no ids
* strings of special tokens are ordinary text
* ids whose bytes are no UTF-8: the decoded bytes are as they are; the decoded text has replacement characters for them
* what is remembered (states, pieces) is bounded and dropped as a whole when full; that changes no result
* repeated rows and ids are encoded each; other columns are untouched and may have any name
"""

from __future__ import annotations

import base64
import gc
import hashlib
from collections.abc import Iterable, Iterator
from contextlib import contextmanager
from itertools import chain

import numpy as np
import regex
from pyspark.sql import DataFrame, SparkSession

from sensorlake.llm.common import map_rows, table
from sensorlake.llm.op2_bpe import NEWER

#: States, neighbour pairs and words that are remembered, and the longest word among them.
STATES, PAIRS, PIECES, PIECE_CHARS = 200_000, 500_000, 300_000, 48

# Fixed value: the pattern whose pieces start at each single space.
SPACE_STARTS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

START, PASSED, NEVER = -1, -2, float("inf")


class _Node:
    """A place in the trie of token bytes; ``stands`` says whether the merges of its token's bytes give the token (None: not asked yet)."""

    __slots__ = ("token", "child", "stands")

    def __init__(self):
        self.token, self.stands = -1, None
        self.child: dict[int, _Node] = {}


class _State(dict):
    """Byte -> (state after it, tokens emitted), made when first asked for.

    ``live`` are the starts as (node, tokens from the last shared one to the start), the latest start last; ``end`` is what the end of a piece emits.
    """

    __slots__ = ("live", "end", "of")

    def __init__(self, live: tuple, of: Transducer):
        self.live, self.end, self.of = live, None, of

    def __missing__(self, byte: int) -> tuple[_State, tuple[int, ...]]:
        return self.of._step(self, byte)


@contextmanager
def _no_collector() -> Iterator[None]:
    """States, tries and words are many small objects without garbage in cycles, which the collector would visit again and again."""
    on = gc.isenabled()
    gc.disable()
    try:
        yield
    finally:
        if on:
            gc.enable()


class Transducer:
    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks = ranks
        self.bytes_of: dict[int, bytes] = {r: b for b, r in ranks.items()}
        self.root = _Node()
        for token, rank in ranks.items():
            node = self.root
            for b in token:
                nxt = node.child.get(b)
                if nxt is None:
                    nxt = node.child[b] = _Node()
                node = nxt
            node.token = rank
        self.pattern = regex.compile(pattern)
        self.newer = regex.compile(f"[{NEWER}]")
        #: Under this pattern a single space between two other characters always starts a piece.
        self.cut_at_spaces = pattern == SPACE_STARTS
        self.two_spaces = regex.compile(r"\s\s")
        self.agreed: dict[tuple[int, int], bool] = {}
        self.courses: dict[int, list | None] = {}
        #: Words used since the last change of generation, and those of the generation before.
        self.pieces: dict[str, tuple[int, ...]] = {}
        self.earlier: dict[str, tuple[int, ...]] = {}
        self.states: dict[tuple, _State] = {}
        self._forget()
        self.utf8 = Utf8()

    def _forget(self) -> None:
        for s in self.states.values():
            s.clear()  # states refer to each other
        self.states = {}
        self.start = self._state(((self.root, (START,)),))

    def _state(self, live: tuple) -> _State:
        s = self.states.get(live)
        if s is None:
            s = self.states[live] = _State(live, self)
        return s

    # -- the compiled merges -------------------------------------------------

    def merged(self, raw: bytes) -> tuple[list[bytes], list[tuple[float, bytes, bytes]]]:
        """The merges themselves on a token's bytes, the lowest rank first, the leftmost of equals.

        Returns what is left, and the course: before each merge its rank and the symbols at both edges; at the end infinity.
        """
        parts = [raw[i : i + 1] for i in range(len(raw))]
        get, course = self.ranks.get, []
        ranks = [get(x + y, NEVER) for x, y in zip(parts, parts[1:])]
        while ranks and (best := min(ranks)) != NEVER:
            course.append((best, parts[0], parts[-1]))
            at = ranks.index(best)
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
            del ranks[at]
            if at < len(ranks):
                ranks[at] = get(parts[at] + parts[at + 1], NEVER)
            if at:
                ranks[at - 1] = get(parts[at - 1] + parts[at], NEVER)
        course.append((NEVER, parts[0], parts[-1]))
        return parts, course

    def _course(self, token: int) -> list[tuple[float, bytes, bytes]] | None:
        """The course of a token's merges; None if they do not end in the token."""
        try:
            return self.courses[token]
        except KeyError:
            parts, course = self.merged(self.bytes_of[token])
            self.courses[token] = course if len(parts) == 1 else None
            return self.courses[token]

    def _agree(self, a: int, b: int) -> bool:
        """Whether the merges of both tokens' bytes together leave the border between them alone.

        Up to the first merge across the border each token takes its own course, so
        both courses are followed in the order of ranks, and at each point the pair at the border is compared with what comes next.
        """
        known = self.agreed.get((a, b))
        if known is None:
            if len(self.agreed) >= PAIRS:
                self.agreed.clear()
            known = self.agreed[a, b] = self._border_holds(self._course(a), self._course(b))
        return known

    def _border_holds(self, left: list, right: list) -> bool:
        get = self.ranks.get
        i = j = 0
        (x, _, a), (y, b, _) = left[0], right[0]
        across = get(a + b, NEVER)
        while across >= x or across > y:
            if x == y == NEVER:
                return True
            if x <= y:
                i += 1
                x, _, edge = left[i]
                if edge is not a:
                    a = edge
                    across = get(a + b, NEVER)
            else:
                j += 1
                y, edge, _ = right[j]
                if edge is not b:
                    b = edge
                    across = get(a + b, NEVER)
        return False

    # -- determinisation -----------------------------------------------------

    def _step(self, s: _State, byte: int) -> tuple[_State, tuple[int, ...]]:
        live, closed = [], None
        agreed = self.agreed
        for node, tokens in s.live:
            nxt = node.child.get(byte)
            if nxt is None:
                continue
            last = tokens[-1]
            if nxt.child or last == START:
                live.append((nxt, tokens))
            token = nxt.token
            if token >= 0 and closed is None:
                if nxt.stands is None:
                    nxt.stands = self._course(token) is not None
                if nxt.stands:
                    if last != START:
                        holds = agreed.get((last, token))
                        if holds is None:
                            holds = self._agree(last, token)
                        if not holds:
                            continue
                    closed = (*tokens, token)
        if closed is None:
            raise ValueError(f"byte {byte} is no token of this vocabulary")
        live.append((self.root, closed))
        emitted: tuple[int, ...] = ()
        base = live[0][1]
        if len(base) > 1:  # else a start is live right after the last emitted token, and nothing more is sure
            shared, least = 1, min([len(tokens) for _, tokens in live])
            while shared < least and all([tokens[shared] == base[shared] for _, tokens in live]):
                shared += 1
            emitted = base[1:shared]
            live = [(node, tokens[shared - 1 :]) for node, tokens in live]
            if all([len(tokens) > 1 for _, tokens in live]):  # no start follows the last emitted token directly, so it no longer matters which it is
                live = [(node, (PASSED, *tokens[1:])) for node, tokens in live]
        out = (self._state(tuple(live)), emitted)
        if len(self.states) > STATES:
            self._forget()
        else:
            s[byte] = out
        return out

    def _end(self, s: _State) -> tuple[int, ...]:
        node, tokens = s.live[0]
        s.end = (node.token,) if tokens == (START,) and node.token >= 0 else s.live[-1][1][1:]
        return s.end

    def piece(self, raw: bytes) -> tuple[int, ...]:
        """One piece through the transducer, byte by byte."""
        s, out = self.start, []
        for b in raw:
            s, emitted = s[b]
            if emitted:
                out += emitted
        out += s.end if s.end is not None else self._end(s)
        return tuple(out)

    # -- texts ---------------------------------------------------------------

    def split(self, text: str) -> list[str]:
        if text.isascii() or not self.newer.search(text):
            return self.pattern.findall(text)
        # Letters that the library's tables do not know are neither letters nor numbers there.
        shape = self.newer.sub("\u0378", text)
        return [text[m.start() : m.end()] for m in self.pattern.finditer(shape)]

    def _passage(self, text: str) -> tuple[int, ...]:
        """Tokens of a text, or of a word with the space before it; short ones are remembered."""
        known = self.pieces.get(text)
        if known is None:
            known = self.earlier.get(text)
            if known is None:
                known = tuple(chain.from_iterable([self.piece(p.encode("utf-8", "surrogatepass")) for p in self.split(text)]))
            if len(text) <= PIECE_CHARS:
                if len(self.pieces) >= PIECES:
                    self.pieces, self.earlier = {}, self.pieces
                self.pieces[text] = known
        return known

    def encode(self, text: str | None) -> list[int]:
        if not text:
            return []
        if not self.cut_at_spaces or text[-1] == " " or self.two_spaces.search(text):
            return list(self._passage(text))
        # Here each space stands between two other characters and starts a piece, whatever follows.
        known = self.pieces.get
        first, *rest = text.split(" ")
        return [*self._passage(first), *chain.from_iterable([known(w) or self._passage(w) for w in [" " + r for r in rest]])]

    def decode(self, ids: Iterable[int] | None) -> Iterator[bytes]:
        """Bytes of whole characters as soon as they are complete; what is no UTF-8 comes out as it is."""
        return self.utf8.stream(map(self.bytes_of.__getitem__, ids or ()))


class Utf8:
    """Incremental state machine of UTF-8: a state is how many bytes a character still wants and the range of the next one."""

    #: Fixed values (the UTF-8 standard): first byte from, to, further bytes, range of the second byte.
    LEADS = [
        (0x00, 0x7F, 0, 0x80, 0xBF), (0xC2, 0xDF, 1, 0x80, 0xBF), (0xE0, 0xE0, 2, 0xA0, 0xBF), (0xE1, 0xEC, 2, 0x80, 0xBF), (0xED, 0xED, 2, 0x80, 0x9F),
        (0xEE, 0xEF, 2, 0x80, 0xBF), (0xF0, 0xF0, 3, 0x90, 0xBF), (0xF1, 0xF3, 3, 0x80, 0xBF), (0xF4, 0xF4, 3, 0x80, 0x8F),
    ]

    def __init__(self):
        self.lead = {b: (n, low, high) for a, z, n, low, high in self.LEADS for b in range(a, z + 1)}
        #: (state, bytes) -> (state after, how many of the bytes are past their last complete character), filled as streams ask for it.
        self.after: dict[tuple, tuple[tuple, int]] = {}

    def _run(self, state: tuple, raw: bytes) -> tuple[tuple, int]:
        want, low, high = state
        open_from = 0
        for i, b in enumerate(raw):
            if want and low <= b <= high:
                want, low, high = want - 1, 0x80, 0xBF
            else:  # a new character; one that was cut off before it is not waited for any longer
                open_from = i if want else open_from
                want, low, high = self.lead.get(b, (0, 0x80, 0xBF))
            if not want:
                open_from = i + 1
        return (want, low, high) if want else (0, 0x80, 0xBF), len(raw) - open_from

    def stream(self, parts: Iterable[bytes]) -> Iterator[bytes]:
        state, waiting = (0, 0x80, 0xBF), b""
        clean = state
        for raw in parts:
            if state is clean and raw.isascii():
                yield raw
                continue
            key = (state, raw)
            known = self.after.get(key)
            if known is None:
                if len(self.after) >= PIECES:
                    self.after.clear()
                known = self.after[key] = self._run(state, raw)
            state, rest = known
            waiting += raw
            cut = len(waiting) if not state[0] else len(waiting) - rest if rest < len(raw) else 0
            if not state[0]:
                state = clean
            if cut:
                yield waiting[:cut]
                waiting = waiting[cut:]
        if waiting:
            yield waiting


_LOADED: dict[tuple[str, str], Transducer] = {}


def transducer(path: str, pattern: str) -> Transducer:
    """One transducer per Python worker, file and pattern; its states grow with the texts the worker sees."""
    if (path, pattern) not in _LOADED:
        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        _LOADED[path, pattern] = Transducer(ranks, pattern)
    return _LOADED[path, pattern]


def vocabulary(name: str = "byte_bpe_multi_50k.tiktoken") -> tuple[str, str]:
    """(file, pattern)."""
    import public_tokenizers

    return public_tokenizers.path(name), public_tokenizers.PATTERN


def encode(df: DataFrame, path: str, pattern: str, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(key, ids array<int>) for every row of ``df``."""
    kind = dict(df.dtypes)[key]

    def run(c: dict) -> dict:
        t = transducer(path, pattern)
        with _no_collector():
            return {"key": c["key"], "ids": [t.encode(x.as_py()) for x in c["text"]]}

    return map_rows(df.selectExpr(f"`{key}` AS key", f"`{text}` AS text"), run, f"key {kind}, ids array<int>").withColumnRenamed("key", key)


def decode(df: DataFrame, path: str, pattern: str, ids: str = "ids", key: str = "doc_id") -> DataFrame:
    """(key, text) for every row of ``df``."""
    kind = dict(df.dtypes)[key]

    def run(c: dict) -> dict:
        t = transducer(path, pattern)
        return {"key": c["key"], "text": [b"".join(t.decode(i.as_py())).decode("utf-8", "replace") for i in c["ids"]]}

    return map_rows(df.selectExpr(f"`{key}` AS key", f"`{ids}` AS ids"), run, f"key {kind}, text string").withColumnRenamed("key", key)


def round_trip(df: DataFrame, path: str, pattern: str, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(key, n_tokens, ids_sha256, decoded_sha256): encodes, then decodes the ids, within one pass over the texts."""
    kind = dict(df.dtypes)[key]

    def run(c: dict) -> dict:
        t = transducer(path, pattern)
        out: dict[str, list] = {"n_tokens": [], "ids_sha256": [], "decoded_sha256": []}
        with _no_collector():
            for x in c["text"]:
                ids = t.encode(x.as_py())
                out["n_tokens"].append(len(ids))
                out["ids_sha256"].append(hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest())
                out["decoded_sha256"].append(hashlib.sha256(b"".join(t.decode(ids))).hexdigest())
        return {"key": c["key"], **out}

    schema = f"key {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string"
    return map_rows(df.selectExpr(f"`{key}` AS key", f"`{text}` AS text"), run, schema).withColumnRenamed("key", key)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op12: every whole text of ``documents`` encoded and decoded again."""
    return round_trip(table(spark, sf_dir, "documents"), *vocabulary())
