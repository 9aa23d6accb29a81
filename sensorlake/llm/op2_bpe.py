"""Byte-level BPE encoding and decoding.

The text is cut into pieces by the tokenizer's pattern. Within a piece, a
priority queue holds the merges that are possible by rank and place over a
doubly linked list of symbols; an entry whose symbols have changed since it was
pushed is stale and skipped. Decoding concatenates the vocabulary's byte strings.

* null text: encoded as the empty text (no ids), decoded to the empty text
* null ids: decoded as no ids
* a special token's string inside a text is that token, as the file says
* pieces are cached by their string, within a fixed number of entries; the cache changes no result
* other columns are untouched and may have any name
"""

from __future__ import annotations

import json
from collections.abc import Iterable
from heapq import heapify, heappop, heappush
from itertools import chain

import regex
from pyspark.sql import DataFrame, SparkSession

from sensorlake.llm.common import map_rows, sha256_hex, table

PIECES = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

# Letters and numbers of Unicode 17, which the tokenizer's tables (Unicode 16) do not know as such.
NEWER = (
    "՘֋֌࢏౜೜₏₝-₟꟎꟏꟒꟔꟝꟢꟱꭬꭭"
    "\U000107bb-\U000107bf\U00010940-\U00010959\U00010ec5-\U00010ec7\U00010ed9-\U00010eee\U00011b0a\U00011db0-\U00011ddb\U00011de0-\U00011de9\U00011df1"
    "\U0001246f\U00012475-\U0001247f\U00012550-\U00012686\U00016ea0-\U00016eb8\U00016ebb-\U00016ed3\U00016ff2-\U00016ff6\U000187f8-\U000187ff"
    "\U00018cd6-\U00018cda\U00018d09-\U00018d20\U00018d80-\U00018df2\U00018e00-\U00019191\U000191a0-\U000191d2\U0001b123-\U0001b128\U0001b168"
    "\U0001d6a6\U0001df1f-\U0001df24\U0001df2b-\U0001df81\U0001df90-\U0001df96\U0001dfcd-\U0001dfff\U0001e6c0-\U0001e6de\U0001e6e0-\U0001e6e2"
    "\U0001e6e4\U0001e6e5\U0001e6e7-\U0001e6ed\U0001e6f0-\U0001e6f4\U0001e6fe\U0001e6ff\U0002b73a-\U0002b73f\U0002b81e\U0002cea2-\U0002cead"
    "\U000323b0-\U00033479\U0003d000-\U0003fc3f"
)

CACHE_ENTRIES = 300_000
CACHE_CHARS = 48


def _byte_letters() -> dict[int, str]:
    """The printable letter by which the vocabulary writes each byte: itself where it is printable Latin-1, else the next one from 256 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


class _Cache(dict):
    """Remembers what ``make`` gives for short keys: the entries used since the last change of generation and those of the one before."""

    def __init__(self, make):
        super().__init__()
        self.make, self.old = make, {}

    def __missing__(self, key):
        out = self.old.get(key)
        if out is None:
            out = self.make(key)
            if len(key) > CACHE_CHARS:
                return out
        if len(self) >= CACHE_ENTRIES:
            self.old = dict(self)
            self.clear()
        self[key] = out
        return out


class Bpe:
    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            doc = json.load(f)
        vocab, letters = doc["model"]["vocab"], _byte_letters()
        back = {c: b for b, c in letters.items()}
        self.byte_id = [vocab[letters[b]] for b in range(256)]
        special = {t["content"]: t["id"] for t in doc.get("added_tokens", [])}
        size = 1 + max([*vocab.values(), *special.values()])
        #: left id -> right id -> rank (from 1, in the upper bits); rank -> the id that the merge makes. The last entry is that of a dead symbol, -1.
        self.partners: list[dict[int, int]] = [{} for _ in range(size + 1)]
        self.made = [-1]
        for r, m in enumerate(doc["model"]["merges"], 1):
            a, b = m if isinstance(m, list) else m.split(" ")
            self.partners[vocab[a]][vocab[b]] = r << 32
            self.made.append(vocab[a + b])
        self.vocab_bytes = [b""] * size
        for token, i in vocab.items():
            self.vocab_bytes[i] = bytes(back[c] for c in token)
        for token, i in special.items():
            self.vocab_bytes[i] = token.encode()
        self.decimal = [str(i) for i in range(size)]
        self.special = special
        self.special_pattern = regex.compile("(" + "|".join(regex.escape(s) for s in sorted(special, key=len, reverse=True)) + ")") if special else None
        self.pieces = regex.compile(PIECES)
        self.newer = regex.compile(f"[{NEWER}]")
        self.two_spaces = regex.compile(r"[\s\x1c-\x1f][\s\x1c-\x1f]")
        self.lone_space = regex.compile(r"(?<=[^\s\x1c-\x1f]) (?=[^\s\x1c-\x1f])")
        self.of_first = _Cache(self._chunk)
        self.of_rest = _Cache(lambda c: self._chunk(" " + c))

    def _merge(self, piece: str) -> tuple[int, ...]:
        """Priority queue of merges over a doubly linked list of symbols; an entry is rank and place in one int."""
        sym = list(map(self.byte_id.__getitem__, piece.encode("utf-8", "surrogatepass")))
        n = len(sym)
        if n == 1:
            return (sym[0],)
        partners, made = self.partners, self.made
        queue = [q + i for i, (a, b) in enumerate(zip(sym, sym[1:])) if (q := partners[a].get(b))]
        heapify(queue)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        sym.append(-1)
        while queue:
            top = heappop(queue)
            i = top & 0xFFFFFFFF
            j = after[i]
            if partners[sym[i]].get(sym[j]) != top - i:
                continue  # stale: this symbol or its neighbour has been merged since
            new = sym[i] = made[top >> 32]
            sym[j] = -1
            k = after[i] = after[j]
            near = partners[new]
            if k < n:
                before[k] = i
                if q := near.get(sym[k]):
                    heappush(queue, q + i)
            h = before[i]
            if h >= 0 and (q := partners[sym[h]].get(new)):
                heappush(queue, q + h)
        return tuple([s for s in sym if s >= 0])

    def _piece(self, piece: str) -> tuple[int, ...]:
        return self.of_rest[piece[1:]] if piece[0] == " " and len(piece) > 1 else self.of_first[piece]

    def _chunk(self, chunk: str) -> tuple[int, ...]:
        if not chunk:
            return ()
        if (chunk[1:] if chunk[0] == " " else chunk).isalpha():  # letters of these tables are letters of the tokenizer's
            return self._merge(chunk)
        if self.newer.search(chunk):
            shape = self.newer.sub("\u0378", chunk)  # an unassigned code point: neither letter nor number
            pieces = [chunk[m.start() : m.end()] for m in self.pieces.finditer(shape)]
        else:
            pieces = self.pieces.findall(chunk)
        if len(pieces) == 1:
            return self._merge(chunk)
        return tuple(chain.from_iterable(map(self._piece, pieces)))

    def _encode_ordinary(self, text: str) -> list[int]:
        """A space between two other characters always starts a piece, so the text may be cut there first."""
        if not text:
            return []
        if text[-1] == " " or self.two_spaces.search(text):
            first, *rest = self.lone_space.split(text)
        else:
            first, *rest = text.split(" ")
        return [*self.of_first[first], *chain.from_iterable(map(self.of_rest.__getitem__, rest))]

    def encode(self, text: str | None) -> list[int]:
        if not text:
            return []
        if self.special_pattern is None or not self.special_pattern.search(text):
            return self._encode_ordinary(text)
        out: list[int] = []
        for part in self.special_pattern.split(text):
            out.extend([self.special[part]] if part in self.special else self._encode_ordinary(part))
        return out

    def decode_bytes(self, ids: Iterable[int]) -> bytes:
        """The vocabulary's strings, one after the other; bytes that are no UTF-8 become replacement characters."""
        raw = b"".join(map(self.vocab_bytes.__getitem__, ids))
        try:
            raw.decode("utf-8")
        except UnicodeDecodeError:
            return raw.decode("utf-8", "replace").encode()
        return raw

    def decode(self, ids: Iterable[int] | None) -> str:
        return self.decode_bytes(ids or ()).decode("utf-8")

    def ids_digest(self, ids: Iterable[int]) -> str:
        return sha256_hex(",".join(map(self.decimal.__getitem__, ids)).encode())


_LOADED: dict[str, Bpe] = {}


def bpe(path: str) -> Bpe:
    """One tokenizer per Python worker and file."""
    if path not in _LOADED:
        _LOADED[path] = Bpe(path)
    return _LOADED[path]


def vocabulary(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def encode(df: DataFrame, path: str, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(key, ids array<int>) for every row of ``df``."""
    kind = dict(df.dtypes)[key]

    def run(c: dict) -> dict:
        b = bpe(path)
        return {"key": c["key"], "ids": [b.encode(t) for t in c["text"].to_pylist()]}

    return map_rows(df.selectExpr(f"`{key}` AS key", f"`{text}` AS text"), run, f"key {kind}, ids array<int>").withColumnRenamed("key", key)


def decode(df: DataFrame, path: str, ids: str = "ids", key: str = "doc_id") -> DataFrame:
    """(key, text) for every row of ``df``."""
    kind = dict(df.dtypes)[key]

    def run(c: dict) -> dict:
        b = bpe(path)
        return {"key": c["key"], "text": [b.decode(i) for i in c["ids"].to_pylist()]}

    return map_rows(df.selectExpr(f"`{key}` AS key", f"`{ids}` AS ids"), run, f"key {kind}, text string").withColumnRenamed("key", key)


def round_trip(df: DataFrame, path: str, text: str = "text", key: str = "doc_id", with_ids: bool = False) -> DataFrame:
    """(key, n_tokens, ids_sha256, decoded_sha256[, ids]): encodes, then decodes the ids, within one pass over the texts."""
    kind = dict(df.dtypes)[key]
    schema = f"key {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids

    def run(c: dict) -> dict:
        b = bpe(path)
        out: dict[str, list] = {"n_tokens": [], "ids_sha256": [], "decoded_sha256": [], "ids": []}
        for t in c["text"]:
            ids = b.encode(t.as_py())
            out["n_tokens"].append(len(ids))
            out["ids_sha256"].append(b.ids_digest(ids))
            out["decoded_sha256"].append(sha256_hex(b.decode_bytes(ids)))
            if with_ids:
                out["ids"].append(ids)
        return {"key": c["key"], **out}

    return map_rows(df.selectExpr(f"`{key}` AS key", f"`{text}` AS text"), run, schema).withColumnRenamed("key", key)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op2: every whole text of ``documents`` encoded and decoded again."""
    return round_trip(table(spark, sf_dir, "documents"), vocabulary())
