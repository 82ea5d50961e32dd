"""Byte-level BPE: boundaries by a scan of transition functions, cached merges of pieces, offsets, decoding.

The pattern is the one of the rank files: contractions, then an optional blank with letters, numbers or other
signs, then white space that leaves its last character to what follows. An automaton over character classes says
before which characters a piece starts. Each character is a function from states to states; functions compose
associatively, so all prefixes of a text are composed by a blocked scan over small integers that name the
functions, and no regular expression runs."""

from __future__ import annotations

import base64
import hashlib
import heapq
import unicodedata
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
import tiktoken
from public_tokenizers import PATTERN
from pyspark.sql import DataFrame

from .common import KEPT, text_slices, tidy

#: Bytes that kept merges of pieces may take in a worker, about; a full cache is emptied, and each one when its task ends.
CACHE = 24 << 20
#: Bytes of a kept piece besides its characters and ids.
ENTRY = 200
#: Bytes of text that are split and merged at once.
AT_ONCE = 1 << 20
#: Bytes beyond which a piece is merged by a heap, in n log n.
LONG = 64

#: No rank; and the odd multiplier of the table of pairs.
NONE, HASH = 1 << 40, 0x9E3779B97F4A7C15
LETTER, NUMBER, OTHER, BLANK, SPACE = range(5)
#: White space by the Unicode property, a fixed value.
WHITE = [9, 10, 11, 12, 13, 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
#: Contraction endings after an apostrophe, a fixed value of the pattern.
ENDINGS = ["s", "t", "re", "ve", "m", "ll", "d"]


@lru_cache(1)
def classes() -> np.ndarray:
    """The class of every code point."""
    table = np.full(0x110000, OTHER, np.uint8)
    every = "".join(chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000)
    for name, kind in (("L", LETTER), ("N", NUMBER)):
        table[np.frombuffer("".join(regex.findall(rf"\p{{{name}}}", every)).encode("utf-32-le"), np.uint32)] = kind
    table[WHITE] = SPACE
    table[32] = BLANK
    # Where this Python's Unicode knows no character, the encoder that we must agree with is asked for its own:
    # a first byte joins the character before it only if both have one class.
    new = [c for c in np.flatnonzero(table <= NUMBER).tolist() if unicodedata.category(chr(c)) == "Cn"]
    firsts = sorted({chr(c).encode()[:1] for c in new})
    ranks = {bytes([i]): i for i in range(256)} | {a + b: 256 + 2 * i + (a == b"1") for i, b in enumerate(firsts) for a in (b"a", b"1")}
    probe = tiktoken.Encoding("probe", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    for c in new:
        joins = [probe.encode_ordinary(x + chr(c))[0] > 255 for x in "a1"]
        table[c] = LETTER if joins[0] else NUMBER if joins[1] else OTHER
    return table


# States after a character: what a piece that is still open consists of. TAIL1 and TAIL2: so many letters of a
# contraction are to come. LEAD: a blank that the next solid character joins. EDGE: nothing is open.
EDGE, IN_LETTER, IN_NUMBER, IN_OTHER, LEAD, IN_SPACE, TAIL1, TAIL2 = range(8)
# Symbols: the class of a character and what stands behind it. APOS1, APOS2: an apostrophe before an ending of one
# or two letters. _MORE: white space before other white space or the end of its text, _LAST: before a solid one.
SYM_LETTER, SYM_NUMBER, SYM_OTHER, APOS1, APOS2, BLANK_MORE, BLANK_LAST, SPACE_MORE, SPACE_LAST, RESET = range(10)
#: Bits that name a function: the ten symbols generate fewer than 2**9.
WIDTH = 9


def _step(state: int, symbol: int) -> tuple[int, bool]:
    """The state after a character, and whether a piece starts at it."""
    if symbol == RESET:
        return EDGE, True
    if state in (TAIL1, TAIL2):
        return (TAIL1 if state == TAIL2 else EDGE), False
    if symbol in (SYM_LETTER, SYM_NUMBER, SYM_OTHER, APOS1, APOS2):
        kind = min(symbol, SYM_OTHER)
        to = (IN_LETTER, IN_NUMBER, IN_OTHER)[kind]
        if state in (to, LEAD):
            return to, False
        return {APOS1: TAIL1, APOS2: TAIL2}.get(symbol, to), True
    inside = state == IN_SPACE
    if symbol == BLANK_LAST:
        return LEAD, True
    if symbol == SPACE_LAST:  # a piece of its own
        return EDGE, True
    return IN_SPACE, not inside


@lru_cache(1)
def automaton() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Function of each symbol; composition table of functions; their value at EDGE; starts[state, symbol]."""
    found: dict[tuple, int] = {}
    name = lambda f: found.setdefault(f, len(found))
    basic = [name(tuple(_step(s, x)[0] for s in range(8))) for x in range(10)]
    table: dict[tuple[int, int], int] = {}
    while len(table) < len(found) ** 2:
        for (f, i) in list(found.items()):
            for (g, j) in list(found.items()):
                if (i, j) not in table:
                    table[i, j] = name(tuple(g[s] for s in f))
    n = len(found)
    compose = np.zeros(n << WIDTH, np.uint16)
    for (i, j), k in table.items():
        compose[i << WIDTH | j] = k
    at_edge = np.array([f[EDGE] for f in found], np.uint8)
    starts = np.array([[_step(s, x)[1] for x in range(10)] for s in range(8)], bool)
    return np.array(basic, np.uint16), compose, at_edge, starts.ravel()


def scan(names: np.ndarray, compose: np.ndarray, block: int = 64) -> np.ndarray:
    """Compositions of all prefixes: inside blocks side by side, then over the blocks, then both together."""
    n = len(names)
    if n <= block:
        out = names.copy()
        for i in range(1, n):
            out[i] = compose[int(out[i - 1]) << WIDTH | int(names[i])]
        return out
    rows = -(-n // block)
    grid = np.zeros((block, rows), np.uint32)
    padded = np.zeros(rows * block, np.uint16)
    padded[:n] = names
    grid[:] = padded.reshape(rows, block).T
    for i in range(1, block):
        grid[i] = compose[grid[i - 1] << WIDTH | grid[i]]
    ahead = scan(grid[-1].astype(np.uint16), compose, block).astype(np.uint32)
    grid[:, 1:] = compose[ahead[None, :-1] << WIDTH | grid[:, 1:]]
    return grid.T.reshape(-1)[:n].astype(np.uint16)


def boundaries(text: str, ends: Iterable[int] = ()) -> np.ndarray:
    """Where pieces start in a text of one or more documents; ends: where documents end, in code points."""
    points = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    n = len(points)
    if not n:
        return np.zeros(0, np.int64)
    kind = classes()[points]
    last = np.zeros(n, bool)
    last[[e - 1 for e in ends if e] or [n - 1]] = True
    last[n - 1] = True
    white = kind >= BLANK
    before_solid = np.zeros(n, bool)
    before_solid[:-1] = ~white[1:]
    before_solid &= ~last
    symbol = np.array([SYM_LETTER, SYM_NUMBER, SYM_OTHER, BLANK_MORE, SPACE_MORE], np.uint8)[kind]
    symbol += (white & before_solid).astype(np.uint8)
    for at in np.flatnonzero(points == 39):
        for tail in ENDINGS:
            if text[at + 1 : at + 1 + len(tail)] == tail and not last[at : at + len(tail)].any():
                symbol[at] = APOS1 if len(tail) == 1 else APOS2
                break
    basic, compose, at_edge, starts = automaton()
    fresh = np.zeros(n, bool)
    fresh[0] = True
    fresh[1:] = last[:-1]
    names = basic[symbol]
    names[fresh] = compose[(int(basic[RESET]) << WIDTH) | names[fresh].astype(np.uint32)]  # each document starts at EDGE
    before = np.zeros(n, np.int64)
    before[1:] = at_edge[scan(names, compose)[:-1]]
    before[fresh] = EDGE
    return np.flatnonzero(starts[before * 10 + symbol])


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


class Codec:
    """Encodes and decodes by a rank file. Equal pairs merge lowest rank first, leftmost among equals."""

    def __init__(self, ranks: dict[bytes, int], cache: int = CACHE):
        self.ranks, self.size, self.weight = ranks, cache, 0
        self.bytes_of = {v: k for k, v in ranks.items()}
        self.kept: dict[str, tuple[int, ...]] = {}
        self.ints = list(range(max(ranks.values()) + 1))  # one object an id, shared by all pieces kept
        self.texts = [str(i) for i in self.ints]
        self.byte = np.array([ranks[bytes([i])] for i in range(256)], np.int64)
        pairs = {(ranks[t[:i]] << 32 | ranks[t[i:]]): r for t, r in ranks.items() for i in range(1, len(t)) if t[:i] in ranks and t[i:] in ranks}
        bits = max(4, (len(pairs) * 2).bit_length())
        self.shift = np.uint64(64 - bits)
        self.slots, self.joined = np.full((1 << bits) + 64, -1, np.int64), np.full((1 << bits) + 64, NONE, np.int64)
        self.probes = 0
        for key, rank in pairs.items():
            at = at0 = (key * HASH & 0xFFFFFFFFFFFFFFFF) >> (64 - bits)
            while self.slots[at] >= 0:
                at += 1
            self.slots[at], self.joined[at] = key, rank
            self.probes = max(self.probes, at - at0 + 1)

    def ranks_of(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank that each pair of ids merges to, NONE if to none: an open-addressing table probed for all at once."""
        keys = left << 32 | right
        at = ((keys.view(np.uint64) * np.uint64(HASH)) >> self.shift).astype(np.int64)
        out = np.where(self.slots[at] == keys, self.joined[at], NONE)
        rest = np.flatnonzero((self.slots[at] != keys) & (self.slots[at] >= 0))
        for k in range(1, self.probes):
            if not len(rest):
                break
            there = self.slots[at[rest] + k]
            hit = there == keys[rest]
            out[rest[hit]] = self.joined[at[rest[hit]] + k]
            rest = rest[~hit & (there >= 0)]
        return out

    def merge_all(self, pieces: list[bytes]) -> list[list[int]]:
        """Ids of non-empty pieces. All take their next merge in the same numpy step, until none has one left."""
        out: list = [None] * len(pieces)
        todo = []
        for i, p in enumerate(pieces):
            if (r := self.ranks.get(p)) is not None:
                out[i] = [r]
            elif len(p) > LONG:
                out[i] = self._merge_long(p)
            else:
                todo.append(i)
        if not todo:
            return out
        lengths = np.array([len(pieces[i]) for i in todo])
        owner = np.repeat(np.array(todo), lengths)
        ids = self.byte[np.frombuffer(b"".join([pieces[i] for i in todo]), np.uint8)]

        def pair_ranks(at: np.ndarray) -> np.ndarray:
            found = np.full(len(at), NONE, np.int64)
            inside = np.flatnonzero((at >= 0) & (at + 1 < len(ids)))
            inside = inside[owner[at[inside]] == owner[at[inside] + 1]]
            found[inside] = self.ranks_of(ids[at[inside]], ids[at[inside] + 1])
            return found

        ranks = pair_ranks(np.arange(len(ids)))
        while len(ids):
            first = np.flatnonzero(np.append(True, owner[1:] != owner[:-1]))
            sizes = np.diff(np.append(first, len(ids)))
            best = np.minimum.reduceat(ranks, first)
            done = best == NONE
            if done.any():
                of = np.repeat(done, sizes)
                flat, cuts = ids[of].tolist(), np.cumsum(sizes[done]).tolist()
                for piece, a, b in zip(owner[first[done]].tolist(), [0, *cuts], cuts):
                    out[piece] = flat[a:b]
                ids, owner, ranks, sizes, best = ids[~of], owner[~of], ranks[~of], sizes[~done], best[~done]
                if not len(ids):
                    break
            hits = np.flatnonzero(ranks == np.repeat(best, sizes))
            hits = hits[np.append(True, owner[hits[1:]] != owner[hits[:-1]])]  # the leftmost of each piece
            ids[hits] = ranks[hits]
            keep = np.ones(len(ids), bool)
            keep[hits + 1] = False
            ids, owner, ranks = ids[keep], owner[keep], ranks[keep]
            hits = hits - np.arange(len(hits))
            ranks[hits] = pair_ranks(hits)
            before = hits[hits > 0] - 1
            ranks[before] = pair_ranks(before)
        return out

    def _merge_long(self, piece: bytes) -> list[int]:
        """The same merges in n log n: a heap of (rank, place) over a linked list of parts."""
        ranks, n = self.ranks, len(piece)
        end, left, alive = list(range(1, n + 1)), list(range(-1, n - 1)), [True] * n
        heap: list[tuple[int, int, int]] = []

        def offer(i: int) -> None:
            j = end[i]
            if j < n and (r := ranks.get(piece[i : end[j]])) is not None:
                heapq.heappush(heap, (r, i, end[j]))

        for i in range(n):
            offer(i)
        while heap:
            _, i, to = heapq.heappop(heap)
            j = end[i]
            if not alive[i] or j >= n or end[j] != to:
                continue  # one of the two has merged meanwhile
            alive[j], end[i] = False, to
            if to < n:
                left[to] = i
            offer(i)
            if left[i] >= 0:
                offer(left[i])
        return [ranks[piece[i : end[i]]] for i in range(n) if alive[i]]

    def pieces(self, texts: list[str]) -> list[list[str]]:
        """The pieces of each text."""
        joined, ends, at = "".join(texts), [], 0
        for t in texts:
            at += len(t)
            ends.append(at)
        cuts = boundaries(joined, ends)
        stops = np.append(cuts[1:], len(joined)).tolist()
        cuts = cuts.tolist()
        parts = [joined[a:b] for a, b in zip(cuts, stops)]
        where = np.searchsorted(np.array(cuts, np.int64), [0, *ends]).tolist()
        return [parts[a:b] for a, b in zip(where, where[1:])]

    def learn(self, wanted: Iterable[str]) -> dict[str, tuple[int, ...]]:
        """Ids of pieces: those kept, and the others merged together and then kept."""
        wanted = set(wanted)
        kept, ints = self.kept, self.ints
        missing = [p for p in wanted if p not in kept]
        more = sum(map(len, missing)) * 4 + len(missing) * ENTRY
        if kept and self.weight + more > self.size:
            self.forget()
            missing = list(wanted)
            more = sum(map(len, missing)) * 4 + len(missing) * ENTRY
        self.weight += more
        kept.update((p, tuple([ints[i] for i in ids])) for p, ids in zip(missing, self.merge_all([p.encode() for p in missing])))
        return kept

    def forget(self) -> None:
        self.kept.clear()
        self.weight = 0

    def encode(self, text: str) -> list[int]:
        pieces = self.pieces([text])[0] if text else []
        of = self.learn(pieces)
        return [i for p in pieces for i in of[p]]

    def decode(self, ids: Iterable[int]) -> bytes:
        of = self.bytes_of
        return b"".join([of[i] for i in ids])

    def offsets(self, ids: Iterable[int]) -> list[int]:
        """The byte at which each token starts, and the end: where decoding may begin inside a document."""
        of = self.bytes_of
        return np.cumsum([0, *(len(of[i]) for i in ids)]).tolist()


_codecs: dict[str, Codec] = {}


def codec(path: str) -> Codec:
    """The codec of a rank file, one a worker and file."""
    if path not in _codecs:
        _codecs[path] = Codec(load_ranks(path))
    return _codecs[path]


def _forget() -> None:
    for c in _codecs.values():
        c.forget()


KEPT.append(_forget)


DIGEST = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


def digest(docs: DataFrame, path: str) -> DataFrame:
    """n_tokens and SHA-256 of the ids and of the decoded bytes for every document.

    docs needs doc_id and text; other columns are ignored. Null and empty texts have no tokens. Repeated rows give
    repeated results, an empty table none. Map-only; texts are handled in slices of bounded size."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path)
        for batch in batches:
            for part in text_slices(batch, limit=AT_ONCE):
                texts = [t or "" for t in part["text"].to_pylist()]
                n, ids_hash, text_hash = [], [], []
                split = c.pieces(texts)
                of = c.learn(p for pieces in split for p in pieces)
                for pieces in split:
                    ids = [i for p in pieces for i in of[p]]
                    n.append(len(ids))
                    ids_hash.append(hashlib.sha256(",".join([c.texts[i] for i in ids]).encode()).hexdigest())
                    text_hash.append(hashlib.sha256(c.decode(ids)).hexdigest())
                yield pa.record_batch([part["doc_id"], pa.array(n, pa.int64()), pa.array(ids_hash), pa.array(text_hash)], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.selectExpr("CAST(doc_id AS BIGINT) doc_id", "text").mapInArrow(tidy(run), DIGEST)


def encode(docs: DataFrame, path: str, offsets: bool = True) -> DataFrame:
    """doc_id and token_ids of every document, with byte offsets (one more than ids) from which a part can be decoded.

    docs needs doc_id and text; other columns are ignored. Null and empty texts have no tokens (and offset 0 alone).
    Repeated rows give repeated results, an empty table none."""
    kept = [("token_ids", pa.list_(pa.int32()), "array<int>")] + [("offsets", pa.list_(pa.int64()), "array<long>")] * offsets

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path)
        for batch in batches:
            for part in text_slices(batch, limit=AT_ONCE):
                split = c.pieces([t or "" for t in part["text"].to_pylist()])
                of = c.learn(p for pieces in split for p in pieces)
                ids = [[i for p in pieces for i in of[p]] for pieces in split]
                found = [ids, [c.offsets(x) for x in ids]] if offsets else [ids]
                yield pa.record_batch([part["doc_id"], *(pa.array(x, k[1]) for x, k in zip(found, kept))], names=["doc_id", *(k[0] for k in kept)])

    return docs.selectExpr("CAST(doc_id AS BIGINT) doc_id", "text").mapInArrow(tidy(run), "doc_id long, " + ", ".join(f"{k[0]} {k[2]}" for k in kept))


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """doc_id and text from encode()'s rows; null ids give a null text, none an empty one. Other columns are ignored;
    repeated rows give repeated results, an empty table none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path)
        for batch in batches:
            texts = [None if x is None else c.decode(x).decode() for x in batch["token_ids"].to_pylist()]
            yield pa.record_batch([batch["doc_id"], pa.array(texts, pa.string())], names=["doc_id", "text"])

    return encoded.select("doc_id", "token_ids").mapInArrow(tidy(run), "doc_id long, text string")
