"""SentencePiece encoding and decoding by a weighted finite-state transducer.

Four machines are compiled from a model file, to arrays of states, arcs and weights:

* the normaliser, a transducer of one state: a space before the text, spaces to
  U+2581, each character to its symbol (models with further rules are refused);
* the pieces: a trie of arcs by symbol; its final states give a piece, have the
  piece's weight and lead back to the root. In a unigram model the weight is the
  score, negated; in a BPE model it is 0;
* the pairs, of a BPE model only. Its result isn't the path of the best sum of
  scores, but that of merging: a state for each piece, and an arc from one to
  another of weight 0 if merging the two together gives the two again, else of
  infinite weight (compare Berglund and van der Merwe, "Formalizing BPE
  Tokenization", 2023). These arcs are made when they are first asked for;
* byte fallback: from the root to the root by a character that is no piece, to the
  bytes of its UTF-8.

They are composed with the input lazily, state by state, and the shortest path in
the tropical semiring (min, +) is kept for each prefix, for all distinct
stretches of a batch at once. A stretch ends where no piece can go on: before
U+2581 that follows another character, and around characters of no piece. A long
stretch is cut into overlapping segments that are worked on side by side; where
weights (up to a constant) and pieces agree over as many places as the longest
piece has, they agree from there on, so the segments can be joined exactly. What
stretches gave is remembered by the worker process, and compared character by
character before it is used again.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import vectext as V
from .common import Positional, pick, table, widened

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
SPACE = 0x2581
NORMAL, UNKNOWN, CONTROL, USER, BYTE = 1, 2, 3, 4, 6
#: Segments of long stretches go on by SEGMENT characters and overlap by OVERLAP.
SEGMENT, OVERLAP = 192, 64
#: Weights are whole numbers: a score times this.
UNIT, FAR = 1 << 20, 1 << 60
#: What a character that is no piece costs more than the worst piece (as the library has it).
FALLBACK = 10.0
#: So much text is encoded at a time, in bytes; a longer text by itself.
SLICE = 1_000_000
#: A worker forgets the stretches it remembers when there are so many.
REMEMBERED = 400_000


def _fields(raw: bytes) -> Iterator[tuple[int, int | bytes]]:
    """Fields of a protocol buffer: number, and value as integer or bytes."""
    at = 0

    def varint() -> int:
        nonlocal at
        out = shift = 0
        while True:
            b = raw[at]
            at += 1
            out |= (b & 127) << shift
            shift += 7
            if b < 128:
                return out

    while at < len(raw):
        tag = varint()
        kind = tag & 7
        if kind == 0:
            yield tag >> 3, varint()
            continue
        n = {1: 8, 5: 4}.get(kind) or varint()
        yield tag >> 3, raw[at : at + n]
        at += n


class Machine(NamedTuple):
    """States, arcs and weights."""

    #: Normaliser: character -> symbol, 0 if no piece has it; whether a space comes first.
    symbol: np.ndarray
    prefix: bool
    #: Pieces: sorted state << 32 | symbol of each arc, and the state it leads to (0 is the root).
    arcs: np.ndarray
    to: np.ndarray
    #: Of each state the piece it gives, -1 if it isn't final; of each piece its weight and length.
    gives: np.ndarray
    weight: np.ndarray
    sizes: np.ndarray
    longest: int
    #: Pairs: sorted left << 32 | right of every merge, the piece it gives; of each piece when
    #: it is merged (-1: a character) and from what. No merges: all arcs have weight 0.
    pairs: np.ndarray
    of_pair: np.ndarray
    rank: np.ndarray
    left: np.ndarray
    right: np.ndarray
    #: Byte fallback: the piece of each byte; symbols that have no piece of their own.
    bytes_: np.ndarray
    bare: np.ndarray
    #: All pieces' bytes in a row, and where each piece's start.
    text: np.ndarray
    starts: np.ndarray


def _last_merge(piece: str, ids: dict[str, int], rank: dict[str, int]) -> tuple[str, str] | None:
    """The two parts a piece is merged from, if merging gives it at all."""
    parts = list(piece)
    while len(parts) > 2:
        best = min(range(len(parts) - 1), key=lambda i: (rank.get(parts[i] + parts[i + 1], 1 << 40), i))
        if parts[best] + parts[best + 1] not in rank:
            return None
        parts[best : best + 2] = [parts[best] + parts[best + 1]]
    return (parts[0], parts[1]) if parts[0] in ids and parts[1] in ids else None


def compiled(path: str = MODEL) -> Machine:
    """The machines of a BPE or unigram model file with byte fallback."""
    pieces, model_type, prefix = [], 1, True
    for number, value in _fields(open(path, "rb").read()):
        if number == 1:
            f = dict(_fields(value))
            pieces.append((f[1].decode(), struct.unpack("<f", f[2])[0] if 2 in f else 0.0, f.get(3, NORMAL)))
        elif number == 2:
            model_type = dict(_fields(value)).get(3, 1)
        elif number == 3:
            f = dict(_fields(value))
            prefix = bool(f.get(3, 1))
            if f.get(2) or f.get(4, 1) or not f.get(5, 1):
                raise ValueError("a normaliser with rules of its own isn't supported")
    if model_type not in (1, 2) or any(kind == USER for _, _, kind in pieces):
        raise ValueError("not a BPE or unigram model without user-defined pieces")
    bpe = model_type == 2
    ids = {p: i for i, (p, _, kind) in enumerate(pieces) if kind == NORMAL}
    if bpe and any(c not in ids for p in ids for c in p):
        raise ValueError("a piece has a character that is no piece")
    if any(SPACE in map(ord, p.lstrip(chr(SPACE))) for p in ids):
        raise ValueError("a piece has a space after other characters")
    if sum(kind == BYTE for _, _, kind in pieces) != 256:
        raise ValueError("no byte fallback")
    n = len(pieces)
    ranks, left, right = np.full(n, -1, np.int64), np.arange(n), np.arange(n)
    pairs, reached = [], list(ids.values())
    if bpe:
        order = sorted((i for p, i in ids.items() if len(p) > 1), key=lambda i: (-pieces[i][1], i))
        rank = {pieces[i][0]: k for k, i in enumerate(order)}
        reached = [i for p, i in ids.items() if len(p) == 1]
        for p, k in rank.items():
            i = ids[p]
            ranks[i] = k
            pairs += [(ids[p[:c]] << 32 | ids[p[c:]], i) for c in range(1, len(p)) if p[:c] in ids and p[c:] in ids]
            if (split := _last_merge(p, ids, rank)) is not None:
                left[i], right[i] = ids[split[0]], ids[split[1]]
                reached.append(i)
        pairs.sort()
    characters = sorted({c for i in reached for c in pieces[i][0]})
    number = {c: k + 1 for k, c in enumerate(characters)}
    symbol = np.zeros(0x110000, np.uint32)
    symbol[[ord(c) for c in characters]] = np.arange(1, len(characters) + 1)
    symbol[32] = symbol[SPACE]
    arcs: dict[int, int] = {}
    final = {}
    for i in reached:
        state = 0
        for c in pieces[i][0]:
            state = arcs.setdefault(state << 32 | number[c], len(arcs) + 1)
        final[state] = i
    keys = np.array(list(arcs), np.int64)
    by = np.argsort(keys)
    gives = np.full(len(arcs) + 1, -1, np.int64)
    gives[list(final)] = list(final.values())
    worst = min((pieces[i][1] for i in reached), default=0.0) - FALLBACK
    weight = np.zeros(n + 1, np.int64)
    if not bpe:
        weight[:] = [round(-score * UNIT) for _, score, _ in pieces] + [round(-worst * UNIT)]
    bytes_ = np.zeros(256, np.int64)
    for i, (p, _, kind) in enumerate(pieces):
        if kind == BYTE:
            bytes_[int(p[3:5], 16)] = i
    texts = [
        bytes([int(p[3:5], 16)]) if kind == BYTE else p.replace(chr(SPACE), " ").encode() if kind == NORMAL else b""
        for p, _, kind in pieces
    ]
    return Machine(
        symbol, prefix, keys[by], np.array(list(arcs.values()), np.int64)[by], gives, weight, np.array([*(len(p) for p, _, _ in pieces), 1]),
        max((len(pieces[i][0]) for i in reached), default=1), np.array([p for p, _ in pairs], np.int64), np.array([i for _, i in pairs], np.int64), ranks, left, right,
        bytes_, np.array([False, *(c not in ids for c in characters)]), np.frombuffer(b"".join(texts), np.uint8), np.concatenate([[0], np.cumsum([*map(len, texts)])]),
    )


_P = V.U64(V.BASE)


class _Index:
    """Sorted 64-bit keys, found by their upper bits."""

    def __init__(self, keys: np.ndarray):
        self.keys = np.append(np.sort(keys), V.U64(V.MASK))
        self.shift = V.U64(64 - 18)
        self.first = np.searchsorted(self.keys[:-1] >> self.shift, np.arange((1 << 18) + 1, dtype=V.U64)).astype(np.int32)
        self.steps = int(np.diff(self.first).max(initial=1))

    def find(self, keys: np.ndarray) -> np.ndarray:
        at = self.first[(keys >> self.shift).astype(np.int64)].astype(np.int64)
        out = np.where(self.keys[at] == keys, at, -1)
        left = np.flatnonzero(out < 0)
        for step in range(1, self.steps):
            place = np.minimum(at[left] + step, len(self.keys) - 1)
            now = self.keys[place]
            hit = now == keys[left]
            out[left[hit]] = place[hit]
            left = left[now < keys[left]]
            if not len(left):
                break
        return out


class Encoder:
    """The machines, with indexes of their arcs, and memory of stretches."""

    def __init__(self, machine: Machine):
        self.m = machine
        self.arc_at, self.arc_to = self._indexed(machine.arcs, machine.to)
        self.pair_at, self.by_pair = self._indexed(machine.pairs, machine.of_pair)
        #: Arcs between pieces that were asked for: left << 32 | right, and whether it is open.
        self.asked, self.open = np.full(1 << 20, -1, np.int64), np.zeros(1 << 20, bool)
        self.forget()

    @staticmethod
    def _indexed(keys: np.ndarray, of: np.ndarray) -> tuple[_Index, np.ndarray]:
        spread = keys.astype(V.U64) * _P  # odd, so no two keys become one
        return _Index(spread), of[np.argsort(spread, kind="stable")]

    def forget(self) -> None:
        #: Sorted hashes of stretches; where in ``ids`` each one's pieces start, and how many;
        #: where in ``codes`` its characters start, and how many.
        self.memory = np.zeros(0, V.U64)
        self.ids, self.codes = np.zeros(0, np.int32), np.zeros(0, np.uint32)
        self.place = np.zeros((0, 4), np.int32)

    def merged(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether merging pieces a and b, from characters, gives just a and b: no
        merge across comes before one of those that made the two."""
        m = self.m
        out = np.zeros(len(a), bool)
        todo, limit = np.arange(len(a)), np.full(len(a), 1 << 40)
        a, b = a.copy(), b.copy()
        while len(todo):
            at = self.pair_at.find((a.astype(V.U64) << V.U64(32) | b.astype(V.U64)) * _P)
            joined = np.where(at >= 0, m.rank[self.by_pair[at]], 1 << 41)
            ra, rb = m.rank[a], m.rank[b]
            fine = joined >= limit
            done = (ra < 0) & (rb < 0)
            out[todo[fine & done]] = True
            go = fine & ~done
            todo, a, b, ra, rb = todo[go], a[go], b[go], ra[go], rb[go]
            first = ra > rb  # the last merge of all is undone first; of equals, the right one is the later
            limit = np.where(first, ra, rb + 1)
            a, b = np.where(first, m.right[a], a), np.where(first, b, m.left[b])
        return out

    def pair_open(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether the arc from piece a to piece b has weight 0."""
        key = a << 32 | b
        slot = (key.astype(V.U64) * _P >> V.U64(44)).astype(np.int64)
        new = np.flatnonzero(self.asked[slot] != key)
        out = self.open[slot]
        if len(new):
            fresh, of = np.unique(key[new], return_inverse=True)
            said = self.merged(fresh >> 32, fresh & 0xFFFFFFFF)
            out[new] = said[of]
            self.asked[slot[new]], self.open[slot[new]] = key[new], out[new]
        return out

    def shortest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of each prefix of each row of symbols (0 after its end) the weight of the
        shortest path, and the last piece on it; of equals, the longest piece."""
        m, (rows, n) = self.m, x.shape
        weight, last = np.full((rows, n + 1), FAR), np.full((rows, n + 1), -1, np.int64)
        weight[:, 0] = 0
        none = len(m.weight) - 1
        for i in range(n):
            row = np.flatnonzero((x[:, i] > 0) & (weight[:, i] < FAR))
            before, base = last[row, i], weight[row, i]
            if m.bare.any() and len(bare := np.flatnonzero(m.bare[x[row, i]])):
                self._relax(weight, last, row[bare], i + 1, base[bare] + m.weight[none], np.full(len(bare), none))
            state = np.zeros(len(row), np.int64)
            for size in range(1, min(m.longest, n - i) + 1):
                at = self.arc_at.find((state.astype(V.U64) << V.U64(32) | x[row, i + size - 1].astype(V.U64)) * _P)
                there = at >= 0
                row, before, base, state = row[there], before[there], base[there], self.arc_to[at[there]]
                if not len(row):
                    break
                piece = m.gives[state]
                ends = np.flatnonzero(piece >= 0)
                if i and len(m.pairs) and len(ends):
                    ends = ends[self.pair_open(before[ends], piece[ends])]
                if len(ends):
                    self._relax(weight, last, row[ends], i + size, base[ends] + m.weight[piece[ends]], piece[ends])
        return weight, last

    @staticmethod
    def _relax(weight: np.ndarray, last: np.ndarray, row: np.ndarray, at: int, cost: np.ndarray, piece: np.ndarray) -> None:
        less = cost < weight[row, at]
        weight[row[less], at], last[row[less], at] = cost[less], piece[less]

    def _in_turn(self, x: np.ndarray) -> np.ndarray:
        """``shortest`` of one stretch, arc by arc: for one whose segments never meet."""
        m, n = self.m, len(x)
        none = len(m.weight) - 1
        bare = np.flatnonzero(m.bare[x])
        begins, ends, pieces = [bare], [bare + 1], [np.full(len(bare), none)]
        place, state = np.arange(n), np.zeros(n, np.int64)
        for size in range(1, min(m.longest, n) + 1):
            fits = place + size <= n
            place, state = place[fits], state[fits]
            at = self.arc_at.find((state.astype(V.U64) << V.U64(32) | x[place + size - 1].astype(V.U64)) * _P)
            place, state = place[at >= 0], self.arc_to[at[at >= 0]]
            some = m.gives[state] >= 0
            begins, ends, pieces = [*begins, place[some]], [*ends, place[some] + size], [*pieces, m.gives[state[some]]]
        begins, ends, pieces = map(np.concatenate, (begins, ends, pieces))
        order = np.lexsort((ends, begins))
        weight, last, memo, paired = [0] + [FAR] * n, [-1] * (n + 1), {}, len(m.pairs) > 0
        costs = m.weight[pieces]
        for i, j, t, c in zip(*(v[order].tolist() for v in (begins, ends, pieces, costs))):
            c += weight[i]
            if c >= weight[j]:
                continue
            if i and paired:
                pair = (last[i], t)
                if pair not in memo:
                    memo[pair] = bool(self.pair_open(np.array([pair[0]]), np.array([t]))[0])
                if not memo[pair]:
                    continue
            weight[j], last[j] = c, t
        return np.array(last[1:])

    def last_pieces(self, x: np.ndarray, begin: np.ndarray, length: np.ndarray) -> np.ndarray:
        """The last piece of the shortest path of every prefix of every stretch of ``x``,
        all stretches in a row."""
        base = np.cumsum(length) - length
        out = np.full(int(length.sum()), -1, np.int64)
        wide = SEGMENT + max(OVERLAP, 2 * self.m.longest)
        over = wide - SEGMENT
        n_segments = np.where(length <= wide, 1, -(-(length - over) // SEGMENT))
        of = np.repeat(np.arange(len(length)), n_segments)
        start = (np.arange(len(of)) - np.repeat(np.cumsum(n_segments) - n_segments, n_segments)) * SEGMENT
        n = np.minimum(length[of] - start, wide)
        long = np.flatnonzero(n_segments[of] > 1)
        row_of = np.full(len(of), -1)
        row_of[long] = np.arange(len(long))
        head_w, head_p = np.zeros((len(long), over), np.int64), np.zeros((len(long), over), np.int64)
        tail_w, tail_p = np.zeros((len(long), over), np.int64), np.zeros((len(long), over), np.int64)
        order = np.argsort(n, kind="stable")
        a = 0
        while a < len(order):
            room = max(1, (1 << 20) // int(n[order[a]] + 1))
            most = int(n[order[a]]) * 9 // 8 + 1
            b = min(a + room, int(np.searchsorted(n[order], most, "right")))
            mine = order[a:b]
            width = int(n[mine].max())
            place = np.arange(width)
            inside = place < n[mine][:, None]
            symbols = np.where(inside, x[np.where(inside, (begin[of[mine]] + start[mine])[:, None] + place, 0)], 0)
            weight, last = self.shortest(symbols)
            new = inside & ((start[mine][:, None] == 0) | (place >= over))
            r, c = np.nonzero(new)
            out[(base[of[mine]] + start[mine])[r] + c] = last[r, c + 1]
            if len(some := np.flatnonzero(row_of[mine] >= 0)):
                k = row_of[mine[some]]
                head_w[k], head_p[k] = weight[some, 1 : over + 1], last[some, 1 : over + 1]
                if len(full := some[n[mine[some]] == wide]):
                    k = row_of[mine[full]]
                    tail_w[k], tail_p[k] = weight[full, SEGMENT + 1 : wide + 1], last[full, SEGMENT + 1 : wide + 1]
            a = b
        later = long[start[long] > 0]
        if len(later):
            k = row_of[later]
            apart = head_w[k] - tail_w[k - 1]
            same = head_p[k] == tail_p[k - 1]
            same[:, 1:] &= apart[:, 1:] == apart[:, :-1]
            run = np.zeros(len(k), np.int64)
            met = np.zeros(len(k), bool)
            for c in range(over):
                run = np.where(same[:, c], run + 1, 0)
                met |= run > self.m.longest
            for i in np.unique(of[later[~met]]):  # never met: the stretch as a whole
                out[base[i] : base[i] + length[i]] = self._in_turn(x[begin[i] : begin[i] + length[i]])
        return out

    def stretches(self, codes: np.ndarray, begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(pieces in a row, start, count) of each of the given stretches."""
        m, length = self.m, end - begin
        last = self.last_pieces(m.symbol[codes], begin, length)
        #: From the end of each stretch back to its beginning, by leaps of twice as many pieces each time.
        upto = np.cumsum(length)
        first = np.repeat(upto - length, length)
        back = np.arange(len(last)) - m.sizes[last]
        nowhere = len(last)
        back = np.append(np.where(back < first, nowhere, back), nowhere)
        on = np.zeros(nowhere + 1, bool)
        on[upto - 1] = True
        while True:
            reached = back[np.flatnonzero(on)]
            reached = reached[~on[reached]]
            if not len(reached) or (reached == nowhere).all():
                break
            on[reached] = True
            back = back[back]
        on = on[:nowhere]
        ids = last[on]
        count = np.diff(np.concatenate([[0], np.cumsum(on)])[np.concatenate([[0], upto])])
        none = len(m.weight) - 1
        if (ids == none).any():  # characters to their bytes
            at = (np.arange(nowhere) - first + np.repeat(begin, length))[on]
            alien = ids == none
            b_ids, b_n = self._bytes(codes[at[alien]])
            n = np.ones(len(ids), np.int64)
            n[alien] = b_n
            spread = np.repeat(ids, n)
            spread[np.repeat(alien, n)] = b_ids
            count = np.diff(np.concatenate([[0], np.cumsum(n)])[np.concatenate([[0], np.cumsum(count)])])
            ids = spread
        return ids.astype(np.int32), np.cumsum(count) - count, count

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in a row, and where each text's start (n + 1 offsets)."""
        raw, starts = V.code_points(texts)
        n = np.diff(starts)
        some = n > 0
        add = (some & self.m.prefix).astype(np.int64)
        begin = starts[:-1] + np.cumsum(add) - add
        codes = np.full(len(raw) + int(add.sum()), SPACE, np.uint32)
        codes[np.arange(len(raw)) + np.repeat(np.cumsum(add), n)] = np.where(raw == 32, np.uint32(SPACE), raw)
        starts = np.append(begin, len(codes))
        if not len(codes):
            return np.zeros(0, np.int32), np.zeros(len(n) + 1, np.int64)
        space, known = codes == SPACE, self.m.symbol[codes] > 0
        cut = ~known
        cut[1:] |= ~known[:-1] | (space[1:] & ~space[:-1])
        cut[begin[some]] = True
        at = np.flatnonzero(cut)
        end = np.append(at[1:], len(codes))
        owned = known[at]
        ids, first, count = self._spans(codes, at[owned], end[owned])
        alien = codes[at[~owned]]
        b_ids, b_n = self._bytes(alien)
        pool = np.concatenate([ids, b_ids])
        s, c = np.zeros(len(at), np.int64), np.zeros(len(at), np.int64)
        s[owned], c[owned] = first, count
        s[~owned], c[~owned] = len(ids) + np.cumsum(b_n) - b_n, b_n
        ends = np.cumsum(c)
        out = pool[np.arange(ends[-1]) + np.repeat(s - (ends - c), c)]
        upto = np.concatenate([[0], ends])
        return out, upto[np.searchsorted(at, starts)]

    def _bytes(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        raw = np.frombuffer(codes.astype("<u4").tobytes().decode("utf-32-le").encode(), np.uint8)
        n = 1 + (codes > 0x7F).astype(np.int64) + (codes > 0x7FF) + (codes > 0xFFFF)
        return self.m.bytes_[raw].astype(np.int32), n

    def _spans(self, codes: np.ndarray, begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        if not len(begin):
            return np.zeros(0, np.int32), begin, begin
        length = end - begin
        h = V.span_hashes(codes, begin, end) ^ (length.astype(V.U64) * V.U64(V.STEP))
        distinct, first, of = np.unique(h, return_index=True, return_inverse=True)
        if len(self.memory) > REMEMBERED:
            self.forget()
        at = np.minimum(np.searchsorted(self.memory, distinct), max(len(self.memory) - 1, 0))
        new = np.flatnonzero(self.memory[at] != distinct) if len(self.memory) else np.arange(len(distinct))
        if len(new):
            b, e = begin[first[new]], end[first[new]]
            ids, start, count = self.stretches(codes, b, e)
            n = e - b
            kept = codes[np.arange(n.sum()) + np.repeat(b - (np.cumsum(n) - n), n)]
            made = np.column_stack([start + len(self.ids), count, np.cumsum(n) - n + len(self.codes), n]).astype(np.int32)
            memory = np.concatenate([self.memory, distinct[new]])
            order = np.argsort(memory, kind="stable")
            self.memory, self.place = memory[order], np.concatenate([self.place, made])[order]
            self.ids, self.codes = np.concatenate([self.ids, ids]), np.concatenate([self.codes, kept])
            at = np.searchsorted(self.memory, distinct)
        place = self.place[at[of]].astype(np.int64)
        same = place[:, 3] == length
        some = np.flatnonzero(same)
        n = length[some]
        within = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        equal = codes[within + np.repeat(begin[some], n)] == self.codes[within + np.repeat(place[some, 2], n)]
        same[some] = np.logical_and.reduceat(equal, np.cumsum(n) - n)
        out, start, count = self.ids, place[:, 0].copy(), place[:, 1].copy()
        if not same.all():  # another stretch of the same hash
            rest = np.flatnonzero(~same)
            ids, s, c = self.stretches(codes, begin[rest], end[rest])
            start[rest], count[rest] = s + len(out), c
            out = np.concatenate([out, ids])
        return out, start, count

    def decode(self, ids: np.ndarray, starts: np.ndarray) -> list[str]:
        """The text of each run of ids; broken UTF-8 gives U+FFFD."""
        m = self.m
        n = np.diff(m.starts)[ids]
        ends = np.cumsum(n)
        total = int(ends[-1]) if len(ends) else 0
        raw = m.text[np.arange(total) + np.repeat(m.starts[ids] - (ends - n), n)].tobytes()
        upto = np.concatenate([[0], ends])[starts]
        skip = int(m.prefix)
        out = []
        for a, b in zip(upto[:-1].tolist(), upto[1:].tolist()):
            text = raw[a:b].decode("utf-8", "replace")
            out.append(text[skip:] if skip and text.startswith(" ") else text)
        return out


_encoders: dict[str, Encoder] = {}


def encoder_of(name: str, machine: Machine) -> Encoder:
    """The encoder of this worker process; it stays for later tasks."""
    if name not in _encoders:
        _encoders[name] = Encoder(machine)
    return _encoders[name]


def _sent(spark: SparkSession, path: str) -> tuple[str, object]:
    """The machine, compiled once by the driver and sent: some MB, whatever the data."""
    machine = compiled(path)
    return f"{path}#{hash((len(machine.pairs), machine.text.tobytes()))}", spark.sparkContext.broadcast(machine)


def with_ids(df: DataFrame, text: str, path: str = MODEL) -> DataFrame:
    """All columns of ``df``, and ids__ of the text."""
    name, machine = _sent(df.sparkSession, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoder_of(name, machine.value)
        for batch in batches:
            for part in V.slices(batch, text, SLICE):
                ids, starts = encoder.encode(part.column(text))
                missing = pc.is_null(part.column(text))
                made = pa.ListArray.from_arrays(pa.array(starts.astype(np.int32)), pa.array(ids, pa.int32()), mask=missing)
                yield pa.RecordBatch.from_arrays([*part.columns, made], names=[*part.schema.names, "ids__"])

    return df.mapInArrow(run, widened(df, ids__="array<int>"))


def with_ids_and_text(df: DataFrame, text: str, path: str = MODEL) -> DataFrame:
    """The same with what the ids decode to, text__, in one pass through Python."""
    name, machine = _sent(df.sparkSession, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoder_of(name, machine.value)
        for batch in batches:
            for part in V.slices(batch, text, SLICE):
                ids, starts = encoder.encode(part.column(text))
                missing = pc.is_null(part.column(text))
                made = pa.ListArray.from_arrays(pa.array(starts.astype(np.int32)), pa.array(ids, pa.int32()), mask=missing)
                back = pa.array(encoder.decode(ids, starts), pa.string(), mask=missing.to_numpy(zero_copy_only=False))
                yield pa.RecordBatch.from_arrays([*part.columns, made, back], names=[*part.schema.names, "ids__", "text__"])

    return df.mapInArrow(run, widened(df, ids__="array<int>", text__="string"))


def with_text(df: DataFrame, ids: str, path: str = MODEL) -> DataFrame:
    """All columns of ``df``, and text__ of the ids."""
    name, machine = _sent(df.sparkSession, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoder_of(name, machine.value)
        for batch in batches:
            column = batch.column(ids)
            n = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False)
            flat = pc.fill_null(pc.list_flatten(column), 0).to_numpy(zero_copy_only=False)
            ok = (flat >= 0) & (flat < len(encoder.m.rank))
            text = encoder.decode(np.where(ok, flat, 0), np.concatenate([[0], np.cumsum(n)]))
            made = pa.array(text, pa.string(), mask=pc.is_null(column).to_numpy(zero_copy_only=False))
            yield pa.RecordBatch.from_arrays([*batch.columns, made], names=[*batch.schema.names, "text__"])

    return df.mapInArrow(run, widened(df, text__="string"))


def encode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str = MODEL) -> DataFrame:
    """(doc_id, ids) of every row. A null text has null ids, an empty one none.
    Texts are encoded whole, however long; equal texts alike, repeated rows each.
    Other columns are left out, whatever their names."""
    rows = pick(docs, id_col, text_col).toDF("doc_id", "text").withColumn("text", F.col("text").cast("string"))
    return with_ids(rows, "text", path).select("doc_id", F.col("ids__").alias("ids"))


def decode(encoded: DataFrame, id_col: str = "doc_id", ids_col: str = "ids", path: str = MODEL) -> DataFrame:
    """(doc_id, text) of every row. Null ids have a null text. Control and unknown
    pieces, nulls in the ids and numbers that are no piece have no text."""
    rows = pick(encoded, id_col, ids_col).toDF("doc_id", "ids").withColumn("ids", F.col("ids").cast("array<int>"))
    return with_text(rows, "ids", path).select("doc_id", F.col("text__").alias("text"))


def tokenized(docs: DataFrame, text_col: str = "text", path: str = MODEL) -> DataFrame:
    """All rows with all their columns and ``ids``; a column of that name is replaced."""
    p = Positional(docs)
    text = p.at(text_col)
    out = with_ids(p.df.withColumn(text, F.col(text).cast("string")), text, path)
    return out.select(*[F.col(i).alias(c) for i, c in zip(p.inner, p.names) if c.lower() != "ids"], F.col("ids__").alias("ids"))


def op4_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, ids, text): each document's pieces, and what these decode to."""
    both = with_ids_and_text(pick(table(spark, sf_dir, "documents"), "doc_id", "text"), "text")
    return both.select("doc_id", F.col("ids__").alias("ids"), F.col("text__").alias("text"))
