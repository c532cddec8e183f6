"""Byte-level BPE encoding and decoding (operator 3).

Encoding: the merges are compiled into a transducer that is determinised as texts need it. Two tokens may follow
each other if the merges, applied to their joined bytes, give these two tokens again; a piece's encoding is its only
division into tokens whose neighbours all may follow each other. A state is what can still matter after a prefix of
the piece: for each place at which a token in progress may have begun, the node of that token in the tree of tokens and
the class of the token before it. The distinct pieces of a block of texts go through the transducer together, a byte
of each at a time, in numpy. Tokens are given out where all live branches agree, so the delay is bounded by the longest
token or two. Decoding streams the tokens' bytes through an incremental UTF-8 machine.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterable, Iterator
from itertools import chain, islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import grown, kept, mix64, slices, table

LONG_TEXT = 1 << 20
#: What a worker remembers at most: moves of the transducer, pieces.
MOST_MOVES, MOST_PIECES = 400_000, 100_000
#: Tokens have numbers of so many bits; bytes after which a piece gives out what is settled.
BITS, MASK, AHEAD, FOREVER = 24, (1 << 24) - 1, 512, 1 << 60
NARROW = 0x3000


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def merge(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The encoding of a piece by its definition: join the adjacent pair of the least rank, again and again."""
    parts = [piece[i : i + 1] for i in range(len(piece))]
    while len(parts) > 1:
        best = min(((ranks.get(parts[i] + parts[i + 1], 1 << 60), i) for i in range(len(parts) - 1)), default=None)
        if best is None or best[0] == 1 << 60:
            break
        parts[best[1] : best[1] + 2] = [parts[best[1]] + parts[best[1] + 1]]
    return [ranks[p] for p in parts]


class Table:
    """A map of 64-bit keys (not -1) to values from 0, whole arrays at a time: open addressing in two arrays."""

    def __init__(self, keys: np.ndarray | None = None, values: np.ndarray | None = None):
        self.size, self.bits = 0, 12
        self.keys, self.values = np.full(1 << self.bits, -1, np.int64), np.zeros(1 << self.bits, np.int64)
        if keys is not None and values is not None:
            self.add(keys, values)

    def _slots(self, keys: np.ndarray) -> np.ndarray:
        return (mix64(keys.view(np.uint64)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Values, -1 for keys that aren't there."""
        out, at = np.full(len(keys), -1, np.int64), self._slots(keys)
        open_, wanted = np.arange(len(keys)), keys
        while len(open_):
            there = self.keys[at]
            hit = there == wanted
            out[open_[hit]] = self.values[at[hit]]
            left = ~hit & (there != -1)
            open_, wanted, at = open_[left], wanted[left], (at[left] + 1) & (len(self.keys) - 1)
        return out

    def add(self, keys: np.ndarray, values: np.ndarray) -> None:
        """Distinct keys that aren't there."""
        if 2 * (self.size + len(keys)) > len(self.keys):
            old = self.keys != -1
            old_keys, old_values = self.keys[old], self.values[old]
            self.bits = max(self.bits, int(2 * (self.size + len(keys))).bit_length())
            self.keys, self.values = np.full(1 << self.bits, -1, np.int64), np.zeros(1 << self.bits, np.int64)
            self._put(old_keys, old_values)
        self._put(keys, values)
        self.size += len(keys)

    def _put(self, keys: np.ndarray, values: np.ndarray) -> None:
        at = self._slots(keys)
        while len(keys):
            free = np.flatnonzero(self.keys[at] == -1)
            self.keys[at[free]] = keys[free]  # of several with one slot the last stays
            done = free[self.keys[at[free]] == keys[free]]
            self.values[at[done]] = values[done]
            left = np.ones(len(keys), bool)
            left[done] = False
            keys, values, at = keys[left], values[left], (at[left] + 1) & (len(self.keys) - 1)


class Rows:
    """Rows of several int64 columns and of any length, added at the end."""

    def __init__(self, columns: int):
        self.flat, self.used = np.zeros((columns, 1024), np.int64), 0
        self.starts, self.lengths, self.size = np.zeros(256, np.int64), np.zeros(256, np.int64), 0

    def add(self, flat: np.ndarray, lengths: np.ndarray) -> None:
        while self.used + flat.shape[1] > self.flat.shape[1]:
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)], 1)
        while self.size + len(lengths) > len(self.starts):
            self.starts, self.lengths = (np.concatenate([x, np.zeros_like(x)]) for x in (self.starts, self.lengths))
        self.flat[:, self.used : self.used + flat.shape[1]] = flat
        own = slice(self.size, self.size + len(lengths))
        self.starts[own], self.lengths[own] = self.used + np.cumsum(lengths) - lengths, lengths
        self.used, self.size = self.used + flat.shape[1], self.size + len(lengths)

    def take(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The columns of these rows laid end to end, and of each entry which of them it is of."""
        n = self.lengths[rows]
        of = np.repeat(np.arange(len(rows)), n)
        return self.flat[:, np.arange(len(of)) + np.repeat(self.starts[rows] - (np.cumsum(n) - n), n)], of


class Transducer:
    """Takes pieces byte by byte, many at once. A state is the set of branches that are alive, each a token in progress:
    the node of the token in the tree of tokens, and the class of the token before it. States and moves are made
    when a piece first needs them, and dropped when there are too many. A move gives the next state and the one token
    that ends at this byte; the tokens of the piece are those on the way back from a place on which all live branches
    agree: its end, or one that lies back by the longest token or two in a piece that is still going on.

    Tokens are of one class if the same tokens may follow them: only the parts at a token's right end count, and of
    these the ones with which some token begins. States are told apart by 64-bit hashes of their branches."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.tokens: list[bytes | None] = [None] * (max(ranks.values()) + 1)
        for text, token in ranks.items():
            self.tokens[token] = text
        self.lengths = np.array([len(t or b"") for t in self.tokens], np.int64)
        self._grow_tree()
        halves = ((ranks.get(t[:i], -1), ranks.get(t[i:], -1), k) for t, k in ranks.items() for i in range(1, len(t)))
        split = np.array([(a << BITS | b, k) for a, b, k in halves if a >= 0 and b >= 0], np.int64).reshape(-1, 2)
        self.merged = Table(split[:, 0], split[:, 1])  # two tokens' numbers: the token of their joined bytes
        self.class_of = np.full(len(self.tokens), -1, np.int64)
        self.left_of = np.full(len(self.tokens), -1, np.int64)  # token: its row in lefts
        self.lefts, self.rights = Rows(3), Rows(3)  # parts at an end as (token, when it was made, when it went)
        self.numbered: dict[tuple, int] = {}
        self.clear()

    def _grow_tree(self) -> None:
        """The tree of tokens, level by level: child (node << 8 | byte: node), and of each node token, inner, depth."""
        texts = [t for t in self.tokens if t]
        numbers = np.array([self.ranks[t] for t in texts], np.int64)
        raw, lengths = np.frombuffer(b"".join(texts), np.uint8), np.array([len(t) for t in texts], np.int64)
        starts, node = np.cumsum(lengths) - lengths, np.zeros(len(texts), np.int64)
        keys, tokens, levels = [], [np.full(1, -1, np.int64)], [1]
        for level in range(int(lengths.max())):
            alive = np.flatnonzero(lengths > level)
            own, of = np.unique(node[alive] << 8 | raw[starts[alive] + level], return_inverse=True)
            node[alive] = sum(levels) + of
            keys.append(own)
            ended = np.full(len(own), -1, np.int64)
            whole = lengths[alive] == level + 1
            ended[of[whole]] = numbers[alive[whole]]
            tokens.append(ended)
            levels.append(len(own))
        every = np.concatenate(keys)
        self.child = Table(every, np.arange(1, len(every) + 1))
        self.token, self.depth = np.concatenate(tokens), np.repeat(np.arange(len(levels)), levels)
        self.inner = np.zeros(len(self.token), bool)
        self.inner[every >> 8] = True

    def clear(self, keep: int = 0) -> int:
        """Forgets all states and moves but for this state; returns its number."""
        kept_rows = self.states.take(np.array([keep]))[0] if keep else None
        self.states, self.numbers, self.moves = Rows(2), Table(), Table()  # a state's branches; its hash: its number; state << 8 | byte: state << BITS | token
        self.states.add(np.array([[0], [-1]]), np.array([1]))
        if kept_rows is None:
            return 0
        self.states.add(kept_rows, np.array([kept_rows.shape[1]]))
        return 1

    def _begins(self, part: int) -> bool:
        """Whether some longer token begins with this one."""
        node = 0
        for b in self.tokens[part] or b"":
            node = int(self.child.find(np.array([node << 8 | b]))[0])
        return bool(self.inner[node])

    def _learn(self, tokens: np.ndarray) -> None:
        """The parts at both ends of tokens while their bytes are merged. A time is the greatest rank applied so far."""
        for token in tokens.tolist():
            text, ranks = self.tokens[token], self.ranks
            parts, now = [text[i : i + 1] for i in range(len(text))], -1
            sides = {0: [[parts[0], -1, FOREVER]], -1: [[parts[-1], -1, FOREVER]]}
            while len(parts) > 1:
                rank, i = min((ranks.get(parts[i] + parts[i + 1], FOREVER), i) for i in range(len(parts) - 1))
                now = max(now, rank)
                parts[i : i + 2] = [parts[i] + parts[i + 1]]
                for end, spine in sides.items():
                    if parts[end] != spine[-1][0]:
                        spine[-1][2] = now
                        spine.append([parts[end], now, FOREVER])
            left, right = ([(ranks[p], made, gone) for p, made, gone in sides[end]] for end in (0, -1))
            right = tuple(p for p in right if self._begins(p[0]))
            if (known := self.numbered.get(right)) is None:
                known = self.numbered[right] = self.rights.size
                self.rights.add(np.array(right, np.int64).reshape(-1, 3).T, np.array([len(right)]))
            self.class_of[token], self.left_of[token] = known, self.lefts.size
            self.lefts.add(np.array(left, np.int64).T, np.array([len(left)]))

    def may_follow(self, before: np.ndarray, token: np.ndarray) -> np.ndarray:
        """Whether merging the joined bytes of a token of class `before` and of this one leaves them apart: no part at
        the end of the first meets one at the start of the second, both still there, whose merge comes before either
        goes (the left merge goes first on a tie)."""
        (x, made_x, gone_x), one = self.rights.take(before)
        n = self.lefts.lengths[self.left_of[token]]
        pick = np.repeat(np.arange(len(one)), n[one])
        (y, made_y, gone_y), _ = self.lefts.take(self.left_of[token][one])
        rank = self.merged.find(x[pick] << BITS | y)
        at = np.maximum(np.maximum(rank, made_x[pick]), made_y)
        out = np.ones(len(token), bool)
        out[one[pick][(rank >= 0) & (at < gone_x[pick]) & (at <= gone_y)]] = False
        return out

    def _determinise(self, keys: np.ndarray) -> None:
        """Makes the moves of these distinct keys."""
        (node, before), of = self.states.take(keys >> 8)
        node = self.child.find(node << 8 | (keys & 255)[of])
        node, before, of = (v[node >= 0] for v in (node, before, of))
        token = self.token[node]
        ends = np.flatnonzero(token >= 0)
        later = ends[before[ends] >= 0]
        fresh = np.unique(token[ends])
        self._learn(fresh[self.left_of[fresh] < 0])
        fits = np.ones(len(node), bool)
        fits[later] = self.may_follow(before[later], token[later])
        ends = ends[fits[ends]]
        if len(ends) != len(keys) or (of[ends] != np.arange(len(keys))).any():
            raise ValueError("these ranks aren't those of a byte pair encoding")
        ended, live = token[ends], self.inner[node]
        node, before, of = (np.concatenate([v[live], w]) for v, w in ((node, np.zeros(len(keys), np.int64)), (before, self.class_of[ended]), (of, np.arange(len(keys)))))
        order = np.argsort(of, kind="stable")  # the branch that begins here is a state's last
        node, before = node[order], before[order]
        n = np.bincount(of, minlength=len(keys))
        first = np.cumsum(n) - n
        place = np.arange(len(node)) - np.repeat(first, n)
        mixed = mix64((node << BITS | before + 1).view(np.uint64) + mix64(place.view(np.uint64)))
        hashed = mix64(np.add.reduceat(mixed, first)).view(np.int64) & ((1 << 63) - 1)
        own, at, which = np.unique(hashed, return_index=True, return_inverse=True)
        numbers = self.numbers.find(own)
        new = np.flatnonzero(numbers < 0)
        if len(new):
            numbers[new] = self.states.size + np.arange(len(new))
            rows = at[new]
            take = np.arange(n[rows].sum()) + np.repeat(first[rows] - (np.cumsum(n[rows]) - n[rows]), n[rows])
            self.states.add(np.stack([node[take], before[take]]), n[rows])
            self.numbers.add(own[new], numbers[new])
        self.moves.add(keys, numbers[which] << BITS | ended)

    def step(self, keys: np.ndarray) -> np.ndarray:
        """The moves of keys (state << 8 | byte)."""
        got = self.moves.find(keys)
        if len(missing := np.flatnonzero(got < 0)):
            self._determinise(np.unique(keys[missing]))
            got[missing] = self.moves.find(keys[missing])
        return got

    def encode(self, pieces: list[bytes]) -> list[bytes]:
        """The tokens of each piece (none is empty), as the bytes of int32 numbers."""
        if self.moves.size > MOST_MOVES:
            self.clear()
        out: dict[int, bytes] = {i: self._long(p) for i, p in enumerate(pieces) if len(p) > AHEAD}
        order = sorted((i for i in range(len(pieces)) if i not in out), key=lambda i: -len(pieces[i]))
        if order:
            raw, n = np.frombuffer(b"".join(pieces[i] for i in order), np.uint8), np.array([len(pieces[i]) for i in order])
            first = np.cumsum(n) - n
            state, ends = np.zeros(len(order), np.int64), np.zeros(len(raw), np.int64)
            for k in range(int(n[0])):
                alive = np.searchsorted(-n, -k)  # the longest come first
                got = self.step(state[:alive] << 8 | raw[first[:alive] + k])
                state[:alive], ends[first[:alive] + k] = got >> BITS, got & MASK
            marked, at = np.zeros(len(raw), bool), n.copy()
            going = np.arange(len(order))
            while len(going):
                last = first[going] + at[going] - 1
                marked[last] = True
                at[going] -= self.lengths[ends[last]]
                going = going[at[going] > 0]
            bounds, every = (4 * np.cumsum(np.add.reduceat(marked, first, dtype=np.int64))).tolist(), ends[marked].astype(np.int32).tobytes()
            out |= {i: every[a:b] for i, a, b in zip(order, [0, *bounds], bounds, strict=False)}
        return [out[i] for i in range(len(pieces))]

    def _long(self, piece: bytes) -> bytes:
        """A long piece, byte by byte; what is settled is given out on the way."""
        out: list[int] = []
        ends: list[int] = []  # the token that ends at each byte that isn't settled
        known: dict[int, int] = {}
        state = 0

        def back(at: int) -> list[int]:
            found = []
            while at > 0:
                found.append(ends[at - 1])
                at -= len(self.tokens[ends[at - 1]])
            return found[::-1]

        for byte in piece:
            key = state << 8 | byte
            if (got := known.get(key)) is None:
                got = known[key] = int(self.step(np.array([key]))[0])
            ends.append(got & MASK)
            state = got >> BITS
            if len(ends) >= AHEAD:
                places = {len(ends) - int(d) for d in self.depth[self.states.take(np.array([state]))[0][0]]}
                while len(places) > 1:  # to where all live branches agree
                    last = max(places)
                    places.remove(last)
                    places.add(last - len(self.tokens[ends[last - 1]]))
                place = places.pop()
                out += back(place)
                del ends[:place]
                if self.moves.size > MOST_MOVES:
                    state = self.clear(state)
                    known.clear()
        return np.array(out + back(len(ends)), np.int32).tobytes()


_WIDE = re.compile(f"[^\\x00-{chr(NARROW - 1)}]")


def narrow(pattern: str) -> re.Pattern | None:
    """The pattern for the faster `re`, right for texts whose code points are below NARROW: its classes are written out.
    None if it holds anything that this doesn't know."""
    inside, out, bodies = False, [], {}
    for part in regex.findall(r"\\p\{[LN]\}|\\.|\[\^?|\(\?.|.", pattern, regex.DOTALL):
        name = part.replace("S", "s") if part in (r"\s", r"\S") else part
        if name in (r"\s", r"\p{L}", r"\p{N}"):
            if name not in bodies:
                bodies[name] = "".join(f"\\u{c:04x}" for c in range(NARROW) if regex.match(name, chr(c)))
            if inside and part == r"\S":
                return None
            out.append(bodies[name] if inside else f"[{'^' * (part == r'\S')}{bodies[name]}]")
            continue
        if part[0] == "\\" and (part[-1].isalnum() or len(part) == 1) or part[:2] == "(?" and part not in ("(?:", "(?!", "(?="):
            return None
        inside = part[0] == "[" or inside and part != "]"
        out.append(part)
    return re.compile("".join(out))


class Encoder:
    """Encodes texts; remembers the tokens of the pieces of late, as the bytes of int32 numbers."""

    def __init__(self, path: str, pattern: str):
        self.pattern, self.narrow, self.transducer = regex.compile(pattern), narrow(pattern), Transducer(load_ranks(path))
        self.pieces: dict[str, bytes] = {}

    def _of(self, text: str) -> regex.Pattern | re.Pattern:
        return self.pattern if self.narrow is None or _WIDE.search(text) else self.narrow

    def _join(self, found: list[list[str]]) -> list[bytes]:
        seen = set(chain.from_iterable(found))
        new = [p for p in seen if p not in self.pieces]
        if len(self.pieces) + len(new) > MOST_PIECES:
            self.pieces = {p: self.pieces[p] for p in seen if p in self.pieces}
        self.pieces.update(zip(new, self.transducer.encode([p.encode() for p in new]), strict=True))
        return [b"".join(map(self.pieces.__getitem__, own)) for own in found]

    def __call__(self, texts: list[str]) -> list[np.ndarray]:
        """The tokens of each text; a text of LONG_TEXT characters or more is taken in blocks."""
        short = [i for i, t in enumerate(texts) if len(t) < LONG_TEXT]
        joined = dict(zip(short, self._join([self._of(texts[i]).findall(texts[i]) for i in short]), strict=True))
        for i, t in enumerate(texts):
            if i not in joined:
                found, parts = (m[0] for m in self._of(t).finditer(t)), []
                while block := list(islice(found, 100_000)):
                    parts += self._join([block])
                joined[i] = b"".join(parts)
        return [np.frombuffer(joined[i], np.int32) for i in range(len(texts))]


class Utf8Stream:
    """Takes bytes as they come and gives the characters that are complete; at most three bytes wait.

    Bytes that can't be part of a character give U+FFFD."""

    def __init__(self):
        self.waiting = b""

    @staticmethod
    def open_tail(data: bytes) -> int:
        """How many bytes at the end begin a character that isn't complete."""
        for back in range(1, min(3, len(data)) + 1):
            b = data[-back]
            if b & 0xC0 != 0x80:
                need = 2 if b >= 0xC2 and b < 0xE0 else 3 if 0xE0 <= b < 0xF0 else 4 if 0xF0 <= b < 0xF5 else 1
                if need <= back:
                    return 0
                second = data[-back + 1] if back > 1 else None
                low, high = {0xE0: (0xA0, 0xBF), 0xED: (0x80, 0x9F), 0xF0: (0x90, 0xBF), 0xF4: (0x80, 0x8F)}.get(b, (0x80, 0xBF))
                return back if second is None or low <= second <= high else 0
        return 0

    def feed(self, data: bytes) -> str:
        data = self.waiting + data
        tail = self.open_tail(data)
        self.waiting = data[len(data) - tail :]
        return data[: len(data) - tail].decode("utf-8", "replace")

    def end(self) -> str:
        out, self.waiting = self.waiting.decode("utf-8", "replace"), b""
        return out


def decode_stream(ids: Iterable[int], tokens: list[bytes | None], block: int = 65_536) -> Iterator[str]:
    ids, machine = iter(ids), Utf8Stream()
    while part := list(islice(ids, block)):
        try:
            yield machine.feed(b"".join(map(tokens.__getitem__, part)))
        except TypeError:
            raise ValueError("an id isn't in the vocabulary") from None
    yield machine.end()


def _encoder(path: str, pattern: str) -> Encoder:
    made = kept("bpe")
    if ("e", path, pattern) not in made:
        made["e", path, pattern] = Encoder(path, pattern)
    return made["e", path, pattern]


def _tokens(path: str) -> list[bytes | None]:
    made = kept("bpe")
    if ("t", path) not in made:
        ranks = load_ranks(path)
        out: list[bytes | None] = [None] * (max(ranks.values()) + 1)
        for k, v in ranks.items():
            out[v] = k
        made["t", path] = out
    return made["t", path]


def default_vocabulary() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


def encode(docs: DataFrame, path: str, pattern: str, text: str = "text", ids: str = "ids", decoded: str | None = None) -> DataFrame:
    """docs with ids, an array of the text's tokens; each match of pattern is encoded alone, without special
    tokens. A null or empty text has no tokens; given columns of these names give way. path: a file of ranks that
    every machine has. decoded: the name of one more column, for what the ids decode to, made by the same worker."""

    def run(batches):
        encoder, tokens = _encoder(path, pattern), _tokens(path) if decoded else []
        for batch in slices(batches, "__dg_text", 1 << 20, owner="bpe"):
            texts = [t or "" for t in batch.column("__dg_text").to_pylist()]
            own = dict.fromkeys(texts)  # copies often lie together
            own.update(zip(own, encoder(list(own)), strict=True))
            found = [own[t] for t in texts]
            offsets = np.concatenate([[0], np.cumsum([len(x) for x in found])]).astype(np.int32)
            made = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(found)))
            new = {ids: made}
            if decoded:
                said = {t: "".join(decode_stream(x.tolist(), tokens)) for t, x in own.items()}
                new[decoded] = pa.array([said[t] for t in texts], pa.string())
            names = [n for n in batch.schema.names if n != "__dg_text"]
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), *new.values()], [*names, *new])

    rest = docs.drop(ids, *([decoded] if decoded else []))
    schema = grown(rest.schema, **{ids: T.ArrayType(T.IntegerType())}, **({decoded: T.StringType()} if decoded else {}))
    return rest.withColumn("__dg_text", F.col(text).cast("string")).mapInArrow(run, schema)


def decode(encoded: DataFrame, path: str, ids: str = "ids", text: str = "text") -> DataFrame:
    """encoded with the decoded text (a given column of that name gives way); null ids give an empty text."""

    def run(batches):
        tokens = _tokens(path)
        for batch in batches:
            column = batch.column("__dg_ids")
            values, offsets = np.asarray(pc.fill_null(column.values, -1)), np.asarray(column.offsets)
            valid = np.asarray(column.is_valid())
            texts = ["".join(decode_stream(values[a:b].tolist() if ok else (), tokens)) for a, b, ok in zip(offsets[:-1], offsets[1:], valid, strict=True)]
            names = [n for n in batch.schema.names if n != "__dg_ids"]
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), pa.array(texts, pa.string())], [*names, text])

    rest = encoded.drop(text)
    return rest.withColumn("__dg_ids", F.col(ids)).mapInArrow(run, grown(rest.schema, **{text: T.StringType()}))


def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row a row of documents, repeated ones too: a null or empty text has no tokens, and the digests of empty
    strings; a null doc_id stays null; an empty table gives no rows. Columns but doc_id and text aren't read."""
    path, pattern = default_vocabulary()
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    coded = encode(docs, path, pattern, decoded="decoded").drop("text")
    digest = F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256)
    return coded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), digest.alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
