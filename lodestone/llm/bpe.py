"""Byte-level BPE by a lazily determinised finite-state transducer.

A token sequence is what the merges give exactly if each two neighbours are: if the
merges turn their joint bytes back into the two. So after each prefix there is one last
token. The non-deterministic transducer walks the vocabulary's trie; an item is (trie
node, token before it). Where an item's node is a token that may follow the token
before it, that token ends here and a new item starts at the root. The set of live
items, each with its place among the tokens not yet emitted, is a state of the
deterministic transducer; its transitions are made when first asked for. A token is
emitted as soon as all live items agree on it, so the lookahead is bounded by the
longest token.
"""

from __future__ import annotations

import base64
import hashlib
import re
from array import array
from collections.abc import Callable, Iterable, Iterator
from functools import partial
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import map_arrow, process_cache, text_of


NEVER = 1 << 60


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


def packed_items(items: list[tuple[int, int]]) -> bytes:
    return array("q", [node << 21 | before + 1 for node, before in items]).tobytes()


def items_of(state: bytes) -> list[tuple[int, int]]:
    return [(x >> 21, (x & 0x1FFFFF) - 1) for x in array("q", state)]


class Transducer:
    """Encodes strings of symbols (0 to 511) by merges.

    ``symbols_of`` gives each token's symbols; every symbol that occurs must be a token.
    ``merge_rank(a, b)`` is the rank of the merge of two tokens, or NEVER, and
    ``merged(a, b)`` its result. Every token must be what the merges make of its symbols.
    """

    def __init__(self, symbols_of: dict[int, tuple[int, ...]], merge_rank: Callable, merged: Callable, most_states: int = 300_000, lookahead: int = 4096):
        self.merge_rank, self.merged = merge_rank, merged
        self.symbols_of = symbols_of
        self.single = {s[0]: t for t, s in symbols_of.items() if len(s) == 1}
        self.length_of = np.zeros(max(symbols_of) + 1, np.int32)
        self.child: dict[int, int] = {}  # of the trie: node and symbol -> node
        self.inner = bytearray(1)  # whether a node has children
        self.token_at: list[int | None] = [None]
        self.depth = array("l", [0])
        for token, symbols in symbols_of.items():
            node = 0
            for b in symbols:
                to = self.child.get(node << 9 | b)
                if to is None:
                    to = self.child[node << 9 | b] = len(self.token_at)
                    self.inner[node] = 1
                    self.inner.append(0)
                    self.token_at.append(None)
                    self.depth.append(self.depth[node] + 1)
                node = to
            self.token_at[node] = token
            self.length_of[token] = len(symbols)
        self.most_states = most_states
        self.lookahead = max(lookahead, 4 * max(self.depth))
        self.follows: dict[int, bool] = {}
        self.histories: dict[int, tuple | None] = {}
        self.reset()

    def reset(self) -> None:
        # a state is its items, each a node and the token before it, packed into bytes
        self.states: dict[bytes, int] = {}
        self.kept: list[bytes] = []
        self.moves: dict[int, int] = {}  # state and symbol -> state and token, packed
        self.sorted_keys = np.zeros(0, np.int64)  # the moves again, for whole arrays
        self.sorted_moves = np.zeros(0, np.int64)
        self.start = self._state(packed_items([(0, -1)]))

    def _state(self, items: bytes) -> int:
        at = self.states.setdefault(items, len(self.kept))
        if at == len(self.kept):
            self.kept.append(items)
        return at

    def _history(self, token: int) -> tuple | None:
        """The merges that build a token: (ranks, left ends, right ends) with the ends
        before each merge and after the last; None if the merges don't give it."""
        if token not in self.histories:
            parts = [self.single[x] for x in self.symbols_of[token]]
            ranks, left, right = [], [parts[0]], [parts[-1]]
            while len(parts) > 1:
                rank, at = min((self.merge_rank(parts[i], parts[i + 1]), i) for i in range(len(parts) - 1))
                if rank == NEVER:
                    break
                parts[at : at + 2] = [self.merged(parts[at], parts[at + 1])]
                ranks.append(rank)
                left.append(parts[0])
                right.append(parts[-1])
            self.histories[token] = ([*ranks, NEVER], left, right) if parts == [token] else None
        return self.histories[token]

    def may_follow(self, before: int, token: int) -> bool:
        """Whether the merges of the two tokens' joint symbols give back the two: whether
        no merge over their border has its turn while each is being built. before = -1:
        the piece starts here."""
        key = before + 1 << 20 | token
        known = self.follows.get(key)
        if known is None:
            if len(self.follows) > self.most_states:
                self.follows.clear()
            known = self.follows[key] = self._stay_apart(before, token)
        return known

    def _stay_apart(self, before: int, token: int) -> bool:
        own = self._history(token)
        if own is None or before < 0:
            return own is not None
        (ranks_a, _, ends), (ranks_b, starts, _) = self._history(before), own
        i = j = 0
        while True:
            over = self.merge_rank(ends[i], starts[j])
            a, b = ranks_a[i], ranks_b[j]
            if over < a and over <= b:  # of equal merges the leftmost comes first
                return False
            if a == b == NEVER:
                return True
            if a <= b:
                i += 1
            else:
                j += 1

    def _move(self, state: int, symbol: int) -> int:
        live, ended = [], None
        for node, before in items_of(self.kept[state]):
            to = self.child.get(node << 9 | symbol)
            if to is None:
                continue
            token = self.token_at[to]
            if token is not None and ended is None and self.may_follow(before, token):
                ended = token
            if self.inner[to]:
                live.append((to, before))
        if ended is None:
            raise ValueError("no token ends here: the vocabulary is not closed under its merges")
        move = self._state(packed_items([*sorted(live), (0, ended)])) << 32 | ended
        self.moves[state << 9 | symbol] = move
        return move

    def encode(self, symbols: Iterable[int]) -> list[int]:
        """The token ids of one piece, to which merges are confined; a stream of symbols
        is encoded with a bounded memory."""
        if len(self.kept) > self.most_states:
            self.reset()
        state, moves, out, last = self.start, self.moves, [], []
        for b in symbols:
            move = moves.get(state << 9 | b)
            if move is None:
                if len(self.kept) > 2 * self.most_states:  # within one very long piece
                    items = self.kept[state]
                    self.reset()
                    moves, state = self.moves, self._state(items)
                move = self._move(state, b)
            state, token = move >> 32, move & 0xFFFFFFFF
            last.append(token)
            if len(last) >= self.lookahead:
                sure = self._agreed(state, last)
                out += self._back(last, sure)
                del last[:sure]
        return out + self._back(last, len(last))

    def _back(self, last: list[int], end: int) -> list[int]:
        out = []
        while end > 0:
            out.append(last[end - 1])
            end -= int(self.length_of[last[end - 1]])
        return out[::-1]

    def _agreed(self, state: int, last: list[int]) -> int:
        """Up to where the live items' tokens are the same: the last place that all pass."""
        at = {len(last) - self.depth[node] for node, _ in items_of(self.kept[state])}
        while len(at) > 1:
            most = max(at)
            at.remove(most)
            at.add(most - int(self.length_of[last[most - 1]]))
        return max(at.pop(), 0)

    def _moves_of(self, keys: np.ndarray) -> np.ndarray:
        if not len(self.sorted_keys):
            self._sort_moves()
        at = np.searchsorted(self.sorted_keys, keys)
        at[at == len(self.sorted_keys)] = 0
        out = self.sorted_moves[at] if len(self.sorted_keys) else np.zeros(len(keys), np.int64)
        new = np.flatnonzero(self.sorted_keys[at] != keys) if len(self.sorted_keys) else np.arange(len(keys))
        if len(new):
            asked, back = np.unique(keys[new], return_inverse=True)
            get = self.moves.get
            found = [get(k) for k in asked.tolist()]
            for i, (k, m) in enumerate(zip(asked.tolist(), found)):
                if m is None:
                    found[i] = self._move(k >> 9, k & 511)
            out[new] = np.array(found, np.int64)[back]
        return out

    def _sort_moves(self) -> None:
        keys = np.fromiter(self.moves.keys(), np.int64, len(self.moves))
        moves = np.fromiter(self.moves.values(), np.int64, len(self.moves))
        order = np.argsort(keys)
        self.sorted_keys, self.sorted_moves = keys[order], moves[order]

    def encode_many(self, flat: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All pieces at once: (ids in the order of pieces, their number for each piece).
        Piece i is flat[starts[i] : starts[i] + lengths[i]]; pieces lie end to end."""
        if len(self.kept) > self.most_states:
            self.reset()
        if len(self.moves) > 1.1 * len(self.sorted_keys):
            self._sort_moves()
        order = np.argsort(-lengths, kind="stable")
        at, length = starts[order], lengths[order]
        last = np.zeros(len(flat), np.int32)
        state = np.full(len(order), self.start, np.int64)
        for step in range(int(length[0]) if len(length) else 0):
            n = int(np.searchsorted(-length, -step, "left"))
            moves = self._moves_of(state[:n] << 9 | flat[at[:n] + step])
            state = moves >> 32
            last[at[:n] + step] = moves & 0xFFFFFFFF
        ends = np.zeros(len(flat), bool)
        left = length.astype(np.int64)
        while len(left):
            spot = at + left - 1
            ends[spot] = True
            left = left - self.length_of[last[spot]]
            more = left > 0
            at, left = at[more], left[more]
        counts = np.add.reduceat(ends, starts, dtype=np.int64) if len(starts) else np.zeros(0, np.int64)
        return last[ends], counts


def by_ranks(ranks: dict[bytes, int]) -> Transducer:
    """Merges of a ranks file: any two tokens whose joint bytes are a token, by its rank."""
    bytes_of = {r: t for t, r in ranks.items()}
    find = ranks.get
    return Transducer({r: tuple(t) for t, r in ranks.items()}, lambda a, b: find(bytes_of[a] + bytes_of[b], NEVER), lambda a, b: ranks[bytes_of[a] + bytes_of[b]])


LONGEST = 64  # bytes of a chunk that is looked up with others
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd number modulo 2^64, and those of its inverse."""
    size = 1 << max(16, (n - 1).bit_length())
    if size not in _POWERS:
        base = 0x9E3779B97F4A7C15
        _POWERS.clear()
        _POWERS[size] = tuple(np.cumprod(np.r_[np.uint64(1), np.full(size - 1, b, np.uint64)]) for b in (base, pow(base, -1, 1 << 64)))
    return _POWERS[size]


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The indices starts[0] .. starts[0] + lengths[0] - 1, starts[1] .. and so on."""
    ends = np.cumsum(lengths)
    return np.repeat(starts - ends + lengths, lengths) + np.arange(int(ends[-1]) if len(ends) else 0)


def distinct_chunks(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(indices of one chunk of each kind, the kind of each chunk), by a 64-bit hash of
    the bytes; chunks over LONGEST are kinds of their own."""
    powers, inverses = _powers(len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(data.astype(np.uint64) * powers[1 : len(data) + 1], out=sums[1:])
    hashes = (sums[starts + lengths] - sums[starts]) * inverses[starts]
    hashes ^= lengths.astype(np.uint64) << np.uint64(56)
    long = np.flatnonzero(lengths > LONGEST)
    hashes[long] = (np.uint64(255) << np.uint64(56)) | long.astype(np.uint64)
    _, one, kind = np.unique(hashes, return_index=True, return_inverse=True)
    return one, kind


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes of all texts end to end, offsets) of a string column without nulls."""
    column = column.cast(pa.large_string())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    return np.frombuffer(column.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]], offsets - offsets[0]


def portions(offsets: np.ndarray, most: int = 2_000_000) -> Iterator[tuple[int, int]]:
    """Runs of texts of about ``most`` bytes, one text at least."""
    at = 0
    while at < len(offsets) - 1:
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + most, "right")) - 1)
        yield at, to
        at = to


def gathered(kind: np.ndarray, ids: np.ndarray, begins: np.ndarray, counts: np.ndarray, first_of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(ids of all chunks in order, number for each text), from those of each kind.
    first_of: each text's first chunk, and the number of chunks at the end."""
    n = counts[kind]
    totals = np.r_[0, np.cumsum(n)][first_of]
    return ids[ragged(begins[kind], n)], np.diff(totals)


class Utf8Decoder:
    """Incremental UTF-8: bytes in, text out, at any chunking. Invalid bytes: U+FFFD, one
    for each maximal valid start. The states are (bytes still due, least and most next
    byte, bits so far); moves over whole chunks (tokens) are kept when first made."""

    START = (0, 0x80, 0xBF, 0)

    def __init__(self, most_moves: int = 500_000):
        self.state = self.START
        self.moves: dict[tuple, tuple] = {}
        self.most_moves = most_moves
        self.wide = re.compile(rb"[\x80-\xff]+").finditer

    @classmethod
    def step(cls, state: tuple, byte: int) -> tuple[tuple, str]:
        due, least, most, bits = state
        if due:
            if least <= byte <= most:
                bits = bits << 6 | byte & 0x3F
                return ((due - 1, 0x80, 0xBF, bits), "") if due > 1 else (cls.START, chr(bits))
            state, text = cls.step(cls.START, byte)
            return state, "�" + text
        if byte < 0x80:
            return cls.START, chr(byte)
        if 0xC2 <= byte <= 0xDF:
            return (1, 0x80, 0xBF, byte & 0x1F), ""
        if 0xE0 <= byte <= 0xEF:
            return (2, 0xA0 if byte == 0xE0 else 0x80, 0x9F if byte == 0xED else 0xBF, byte & 0x0F), ""
        if 0xF0 <= byte <= 0xF4:
            return (3, 0x90 if byte == 0xF0 else 0x80, 0x8F if byte == 0xF4 else 0xBF, byte & 0x07), ""
        return cls.START, "�"

    def _run(self, chunk: bytes) -> str:
        known = self.moves.get((self.state, chunk))
        if known is None:
            state, out = self.state, []
            for b in chunk:
                state, text = self.step(state, b)
                out.append(text)
            known = (state, "".join(out))
            if len(self.moves) > self.most_moves:
                self.moves.clear()
            if len(chunk) <= 64:
                self.moves[(self.state, chunk)] = known
        self.state = known[0]
        return known[1]

    def feed(self, chunk: bytes) -> str:
        """Runs of ASCII leave the machine in its start and go through as they are; runs
        of other bytes are moves of their own, with the byte that follows them."""
        if self.state == self.START and chunk.isascii():
            return chunk.decode("ascii")
        out, at = [], 0
        for m in self.wide(chunk):
            if self.state == self.START:
                out.append(chunk[at : m.start()].decode("ascii"))
            else:
                out.append(self._run(chunk[at : m.start()]))
            out.append(self._run(m[0]))
            at = m.end()
        out.append(chunk[at:].decode("ascii") if self.state == self.START else self._run(chunk[at:]))
        return "".join(out)

    def finish(self) -> str:
        left, self.state = self.state != self.START, self.START
        return "�" if left else ""


# Classes of bytes in the chunks that need no pattern: letters, digits, others, newline.
_CLASS = np.zeros(256, np.uint8)
_CLASS[[*range(0x41, 0x5B), *range(0x61, 0x7B)]] = 1
_CLASS[0x30:0x3A] = 2
_CLASS[[b for b in range(0x21, 0x7F) if not _CLASS[b]]] = 3
_CLASS[0x27] = 0  # an apostrophe may start a contraction


def latin_letters(flat: np.ndarray) -> np.ndarray:
    """Where two-byte Latin letters (U+00C0 to U+00FF without the signs) have their bytes."""
    lead = flat == 0xC3
    tail = np.r_[False, lead[:-1]] & (flat >= 0x80) & (flat != 0x97) & (flat != 0xB7)
    return tail | np.r_[tail[1:], False]


class ByteBpe:
    """Encoder and decoder for texts: pieces by ``pattern``, each encoded separately.

    ``pattern`` must be of the kind whose pieces are runs of letters, of digits or of
    others, each with one space before it, contractions, and white space.
    """

    def __init__(self, path: str, pattern: str):
        import regex

        self.ranks = load_ranks(path)
        self.transducer = by_ranks(self.ranks)
        self.vocabulary = {r: t for t, r in self.ranks.items()}
        self.pieces = regex.compile(pattern).findall
        self.utf8 = Utf8Decoder()

    def encode(self, text: str) -> list[int]:
        """The ids of one text."""
        out: list[int] = []
        for piece in self.pieces(text):
            raw = piece.encode("utf-8", "surrogatepass")
            out += [self.ranks[raw]] if raw in self.ranks else self.transducer.encode(raw)
        return out

    def encode_column(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, their number for each text). Texts are cut into chunks where
        a piece must end under the pattern: before a single space between two others, and
        around a single newline between two others. Each kind of chunk is encoded once."""
        n = len(data)
        begins = np.zeros(n + 1, bool)
        begins[offsets] = True
        if n:
            # bytes that neither are nor may belong to white space; more than needed are
            # left out, which only makes chunks longer
            before = np.r_[[0, 0, 0], data]
            solid = (data > 0x20) & (data != 0x7F)
            wide = (before[:-3] >= 0xE1) & (before[:-3] <= 0xE3) | (before[1:-2] == 0xC2)
            ends_solid = solid & ~(wide & (data >= 0x80))
            starts_solid = solid & ((data < 0x7F) | (data >= 0xC3)) & ~((data >= 0xE1) & (data <= 0xE3))
            same = np.ones(n + 1, bool)
            same[offsets] = False
            lone = np.zeros(n, bool)
            lone[1:-1] = ends_solid[:-2] & starts_solid[2:] & same[1 : n - 1] & same[2:n]
            spaces = lone & (data == 0x20)
            lines = lone & (data == 0x0A)
            begins[:-1] |= spaces | lines
            begins[1:] |= lines
        places = np.flatnonzero(begins)
        starts, lengths = places[:-1], np.diff(places)
        one, kind = distinct_chunks(data, starts, lengths)
        own, size = starts[one], lengths[one]
        flat = data[ragged(own, size)]
        heads = np.r_[0, np.cumsum(size)][:-1]
        classes = _CLASS[flat]
        classes[latin_letters(flat)] = 1
        classes[(flat == 0x0A)] = 4
        led = np.zeros(len(flat), bool)
        led[heads[flat[heads] == 0x20]] = True
        led &= np.r_[heads[1:] - 1 != heads[:-1], size[-1:] > 1].repeat(size) if len(size) else led
        classes[led] = 5
        plain = np.minimum.reduceat(classes, heads) > 0 if len(heads) else np.zeros(0, bool)
        plain &= (size <= LONGEST) & ((size == 1) | (np.add.reduceat(classes == 4, heads, dtype=np.int64) == 0 if len(heads) else True))
        regular = np.flatnonzero(plain)
        taken = ragged(heads[regular], size[regular])
        flat_r, class_r = flat[taken].astype(np.int64), classes[taken]
        first = np.zeros(len(flat_r), bool)
        first[np.r_[0, np.cumsum(size[regular])][:-1]] = True
        if len(flat_r):
            first[1:] |= (class_r[1:] != class_r[:-1]) & (class_r[:-1] != 5)
        piece_at = np.flatnonzero(first)
        ids, counts = self.transducer.encode_many(flat_r, piece_at, np.diff(np.r_[piece_at, len(flat_r)]))
        per_piece = np.r_[0, np.cumsum(counts)]
        bounds = np.searchsorted(piece_at, np.r_[0, np.cumsum(size[regular])])
        totals = per_piece[bounds]
        count, at = np.zeros(len(one), np.int64), np.zeros(len(one), np.int64)
        count[regular], at[regular] = np.diff(totals), totals[:-1]
        others, more = [], len(ids)
        for k in np.flatnonzero(~plain).tolist():
            found = self.encode(bytes(flat[heads[k] : heads[k] + size[k]]).decode("utf-8", "surrogatepass"))
            count[k], at[k] = len(found), more
            more += len(found)
            others += found
        ids = np.r_[ids, np.array(others, np.int32)]
        return gathered(kind, ids, at, count, np.searchsorted(starts, offsets))

    def decode(self, ids: Iterable[int], block: int = 8192) -> Iterator[str]:
        """The text of a stream of ids, as it becomes known."""
        self.utf8.state = Utf8Decoder.START
        ids = iter(ids)
        while some := list(islice(ids, block)):
            yield self.utf8.feed(b"".join(map(self.vocabulary.__getitem__, some)))
        yield self.utf8.finish()


def shared_bpe(path: str, pattern: str) -> ByteBpe:
    """One for each process: its states serve all tasks."""
    cache = process_cache()
    if ("bpe", path, pattern) not in cache:
        cache["bpe", path, pattern] = ByteBpe(path, pattern)
    return cache["bpe", path, pattern]


def _encoded(path: str, pattern: str, digest: bool, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    bpe = shared_bpe(path, pattern)
    for batch in batches:
        data, offsets = text_bytes(batch.column(1))
        for i, j in portions(offsets):
            ids, counts = bpe.encode_column(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
            ends = np.r_[0, np.cumsum(counts)]
            keys = batch.column(0).slice(i, j - i)
            if not digest:
                yield pa.RecordBatch.from_arrays([keys, pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(ids, pa.int32()))], names=["doc_id", "ids"])
                continue
            ids_sha, decoded_sha = [], []
            for a, b in zip(ends[:-1].tolist(), ends[1:].tolist()):
                own = ids[a:b].tolist()
                ids_sha.append(hashlib.sha256(" ".join(map(str, own)).encode()).hexdigest())
                decoded_sha.append(hashlib.sha256("".join(bpe.decode(own)).encode("utf-8")).hexdigest())
            yield pa.RecordBatch.from_arrays([keys, pa.array(counts, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(decoded_sha, pa.string())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])


def _decoded(path: str, pattern: str, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    bpe = shared_bpe(path, pattern)
    for batch in batches:
        texts = [None if ids is None else "".join(bpe.decode(ids)) for ids in batch.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["doc_id", "text"])


def encode(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """(doc_id, ids) of every row. Null text: empty, no ids. Repeated rows and null ids of
    documents are kept; other columns are ignored; an empty table gives no rows."""
    return map_arrow(text_of(docs, "doc_id"), partial(_encoded, path, pattern, False), f"doc_id {dict(docs.dtypes)['doc_id']}, ids array<int>")


def decode(encoded: DataFrame, path: str, pattern: str) -> DataFrame:
    """(doc_id, text) of every row of (doc_id, ids); null ids give null text."""
    return map_arrow(encoded.select("doc_id", "ids"), partial(_decoded, path, pattern), f"doc_id {dict(encoded.dtypes)['doc_id']}, text string")


def round_trip(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of every row: ids of the whole text,
    and the bytes that they decode to. Rows as in ``encode``."""
    return map_arrow(text_of(docs, "doc_id"), partial(_encoded, path, pattern, True), f"doc_id {dict(docs.dtypes)['doc_id']}, n_tokens long, ids_sha256 string, decoded_sha256 string")
