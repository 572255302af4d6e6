"""Byte-level BPE encoding and decoding.

Pre-tokenisation uses no regex. Each character becomes a symbol (its code-point class, refined by the
one or two characters after it), each symbol is a function on the four states of a small automaton,
and because composing such functions is associative a blocked scan gives the state before every
character. State and neighbouring classes decide where tokens start; the slices between starts feed a
cache of merged pairs. ``offsets`` (the byte at which each token starts) are kept for decoding ranges.

Defined results: a null text counts as empty; an empty text has no ids; repeated rows are encoded
each on its own; other columns pass through unchanged (an input column named like an output is
replaced); an empty table gives an empty table.
"""

from __future__ import annotations

import base64
import heapq
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from bidlake.common import small_batches
from bidlake.llm.textclass import LETTER, NUMBER, OTHER, SEPARATOR, SPACE, chunks, class_table, code_points

RANKS_FILE = "byte_bpe_50k.tiktoken"
CHUNK_CHARS = 1_000_000
CACHE_ENTRIES = 300_000
CACHED_BYTES = 64
NO_PAIR = 1 << 30

# States: a token may start here with an apostrophe; it may not (after a space that joins or after
# punctuation); two or one letters of a contraction are still to come.
FREE, BOUND, TWO, ONE = range(4)
# Symbols and what each makes of the four states.
S_LETTER, S_RESET, S_BIND, S_SHORT, S_LONG, S_SAME = range(6)
MOVES = {
    S_LETTER: (FREE, FREE, ONE, FREE),
    S_RESET: (FREE, FREE, FREE, FREE),
    S_BIND: (BOUND, BOUND, BOUND, BOUND),
    S_SHORT: (ONE, BOUND, ONE, ONE),
    S_LONG: (TWO, BOUND, TWO, TWO),
    S_SAME: (FREE, BOUND, TWO, ONE),
}


@lru_cache(maxsize=1)
def automaton() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Function code of each symbol; table composing two codes; table applying a code to a state.

    A code packs the four results in two bits each, so there are 256 functions.
    """
    code = np.array([sum(to << (2 * s) for s, to in enumerate(MOVES[k])) for k in sorted(MOVES)], dtype=np.uint8)
    f = np.arange(256)
    apply = np.stack([(f >> (2 * s)) & 3 for s in range(4)], axis=1).astype(np.uint8)
    compose = np.zeros((256, 256), dtype=np.uint8)
    for s in range(4):
        compose |= (apply[:, apply[:, s]].T << (2 * s)).astype(np.uint8)
    return code, compose.reshape(-1), apply.reshape(-1)


def scan_states(codes: np.ndarray, block: int = 256) -> np.ndarray:
    """State before each position of a sequence of function codes, from FREE: an exclusive scan.

    Blocks are composed side by side, the block functions are scanned in turn, and a second pass
    inside the blocks yields the states: two table look-ups a character, no dependence between blocks.
    """
    _, compose, apply = automaton()
    n = len(codes)
    if n == 0:
        return np.zeros(0, dtype=np.uint8)
    if n <= block:
        out, state = np.empty(n, dtype=np.uint8), FREE
        for i, c in enumerate(codes.tolist()):
            out[i] = state
            state = (c >> (2 * state)) & 3
        return out
    rows = -(-n // block)
    grid = np.full(rows * block, sum(s << (2 * s) for s in range(4)), dtype=np.uint8)
    grid[:n] = codes
    grid = np.ascontiguousarray(grid.reshape(rows, block).T)
    total = grid[0]
    for k in range(1, block):
        total = compose[(total.astype(np.uint16) << 8) | grid[k]]
    state = scan_states(total, block)
    out = np.empty((block, rows), dtype=np.uint8)
    for k in range(block):
        out[k] = state
        state = apply[(grid[k].astype(np.uint16) << 2) | state]
    return np.ascontiguousarray(out.T).reshape(-1)[:n]


def token_starts(points: np.ndarray, separators: np.ndarray) -> np.ndarray:
    """Positions at which a pre-token starts. ``separators``: positions between texts, of no text."""
    kind = class_table()[points]
    kind[separators] = SEPARATOR
    n = len(points)
    after = np.empty(n, dtype=np.uint8)
    after[:-1], after[-1:] = kind[1:], SEPARATOR
    space = kind == SPACE
    last = space & (after != SPACE) & (after != SEPARATOR)  # white space right before a visible character
    join = last & (points == 0x20)

    symbol = np.full(n, S_RESET, dtype=np.uint8)
    symbol[kind == LETTER] = S_LETTER
    symbol[(kind == OTHER) | join] = S_BIND
    quote = np.flatnonzero((points == 0x27) & (kind == OTHER))
    if len(quote):
        one = np.where(quote + 1 < n, points[np.minimum(quote + 1, n - 1)], 0)
        two = np.where(quote + 2 < n, points[np.minimum(quote + 2, n - 1)], 0)
        symbol[quote[np.isin(one, [ord(c) for c in "stmd"])]] = S_SHORT
        long = (np.isin(one, [ord("r"), ord("v")]) & (two == ord("e"))) | ((one == ord("l")) & (two == ord("l")))
        symbol[quote[long]] = S_LONG
    code, _, _ = automaton()
    state = scan_states(code[symbol])

    before = np.empty(n, dtype=np.uint8)
    before[1:], before[:1] = kind[:-1], SEPARATOR
    joined = np.zeros(n, dtype=bool)
    joined[1:] = join[:-1]
    ended = np.zeros(n, dtype=bool)  # a contraction ended just before
    ended[1:] = ((state == ONE) & (symbol == S_LETTER))[:-1]
    start = (kind != before) | ended | last
    start &= ~(joined & ~space)
    start &= ~((kind == LETTER) & (state >= TWO))
    start &= kind != SEPARATOR
    return np.flatnonzero(start)


def slices(texts: list[str]) -> tuple[list[bytes], np.ndarray]:
    """All pre-tokens of the texts as bytes, in order, and how many each text has."""
    whole = "\0".join(texts) + "\0"
    points = code_points(whole)
    ends = np.cumsum([len(t) + 1 for t in texts]) - 1
    starts = token_starts(points, ends)
    width = np.ones(len(points), dtype=np.int64)
    for edge in (0x80, 0x800, 0x10000):
        width += points >= edge
    at = np.empty(len(points) + 1, dtype=np.int64)
    at[0] = 0
    np.cumsum(width, out=at[1:])
    text_of = np.searchsorted(ends, starts)
    stops = np.empty_like(starts)
    stops[:-1] = starts[1:]
    if len(starts):
        stops[-1] = ends[-1]
    stops = np.minimum(stops, ends[text_of])
    raw = whole.encode("utf-8", "surrogatepass")
    pieces = [raw[a:b] for a, b in zip(at[starts].tolist(), at[stops].tolist(), strict=True)]
    return pieces, np.bincount(text_of, minlength=len(texts))


def merge_pairs(piece: bytes, ranks: dict[bytes, int]) -> tuple[int, ...]:
    """Merge the adjacent pair of lowest rank, the leftmost first, until none is left.

    For long pieces: a heap of candidate pairs over a linked list, O(n log n), so a run of 100,000 letters
    is no trap.
    """
    whole = ranks.get(piece)
    if whole is not None:
        return (whole,)
    n = len(piece)
    stop = list(range(1, n + 1))
    back = list(range(-1, n - 1))
    alive = [True] * n
    heap = [(r, i, i + 1, i + 2) for i in range(n - 1) if (r := ranks.get(piece[i : i + 2])) is not None]
    heapq.heapify(heap)
    while heap:
        _, i, j, end = heapq.heappop(heap)
        if not alive[i] or stop[i] != j or j >= n or not alive[j] or stop[j] != end:
            continue
        alive[j] = False
        stop[i] = end
        if end < n:
            back[end] = i
            if (r := ranks.get(piece[i : stop[end]])) is not None:
                heapq.heappush(heap, (r, i, end, stop[end]))
        h = back[i]
        if h >= 0 and (r := ranks.get(piece[h:end])) is not None:
            heapq.heappush(heap, (r, h, i, end))
    return tuple(ranks[piece[i : stop[i]]] for i in range(n) if alive[i])


class PieceCache:
    """Piece to its row of ids, bounded: emptied when full, so that frequent pieces soon come back.

    ``make`` gets all missing pieces of a chunk at once and returns their ids in one array and how many
    ids each piece has.
    """

    def __init__(self, make, entries: int = CACHE_ENTRIES):
        self.make, self.entries = make, entries
        self.clear()

    def clear(self) -> None:
        self.row: dict[bytes, int] = {}
        self.ids, self.used, self.counts = np.empty(1 << 16, np.int32), 0, np.zeros(0, np.int64)

    def rows(self, pieces: list[bytes]) -> np.ndarray:
        if len(self.row) > self.entries or self.used > 8 * self.entries:
            self.clear()
        missing = list(set(pieces).difference(self.row))
        if missing:
            ids, counts = self.make(missing)
            first = len(self.counts)
            self.row.update(zip(missing, range(first, first + len(missing)), strict=True))
            self.counts = np.concatenate([self.counts, counts])
            if self.used + len(ids) > len(self.ids):
                self.ids = np.concatenate([self.ids[: self.used], np.empty(self.used + 2 * len(ids), np.int32)])
            self.ids[self.used : self.used + len(ids)] = ids
            self.used += len(ids)
        return np.fromiter(map(self.row.__getitem__, pieces), dtype=np.int64, count=len(pieces))

    def find_counts(self, pieces: list[bytes]) -> np.ndarray:
        """How many ids each piece has."""
        row = self.rows(pieces)
        return self.counts[row]

    def find(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all pieces in one array, and how many each piece has."""
        row = self.rows(pieces)
        counts = self.counts[row]
        return spread(self.ids, (np.cumsum(self.counts) - self.counts)[row], counts), counts


def spread(values: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The slices of ``values`` that begin at ``start`` and have ``size`` items, one after the other."""
    at = np.cumsum(size) - size
    return values[np.repeat(start - at, size) + np.arange(int(size.sum()))]


class PairTable:
    """Rank of the token that two adjacent tokens make, for arrays of ids."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        pairs = {}
        for token, rank in ranks.items():
            for k in range(1, len(token)):
                left, right = ranks.get(token[:k]), ranks.get(token[k:])
                if left is not None and right is not None:
                    pairs[left << 32 | right] = rank
        keys = np.fromiter(pairs, dtype=np.int64, count=len(pairs))
        order = np.argsort(keys)
        self.keys = keys[order]
        self.rank = np.fromiter(pairs.values(), dtype=np.int32, count=len(pairs))[order]
        self.byte = np.array([ranks.get(bytes([b]), -1) for b in range(256)], dtype=np.int64)
        self.byte_pair = self.look_up(np.repeat(self.byte, 256), np.tile(self.byte, 256)).reshape(256, 256)

    def look_up(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left.astype(np.int64) << 32 | right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where((self.keys[at] == key) & (left >= 0) & (right >= 0), self.rank[at], NO_PAIR)

    def merge_equal_width(self, pieces: list[bytes], width: int, out: np.ndarray) -> np.ndarray:
        """Merge many pieces of at most ``width`` bytes, one pair of each piece at a step; returns the counts."""
        size = np.array([len(p) for p in pieces])
        raw = np.frombuffer(b"".join([p.ljust(width, b"\0") for p in pieces]), dtype=np.uint8).reshape(-1, width)
        column = np.arange(width)
        ids = np.where(column < size[:, None], self.byte[raw], -1).astype(np.int32)
        rank = np.where(column[1:] < size[:, None], self.byte_pair[raw[:, :-1], raw[:, 1:]], NO_PAIR).astype(np.int32)
        row = np.arange(len(pieces))
        while len(row):
            at = rank.argmin(axis=1)
            best = rank[np.arange(len(row)), at]
            live = best < NO_PAIR
            out[row[~live], :width] = ids[~live]
            row, ids, rank, at, best = row[live], ids[live], rank[live], at[live], best[live]
            if not len(row):
                break
            size[row] -= 1
            own = np.arange(len(row))
            ids = np.where(column > at[:, None], np.concatenate([ids[:, 1:], np.full((len(row), 1), -1, np.int32)], axis=1), ids)
            ids[own, at] = best
            rank = np.where(column[:-1] > at[:, None], np.concatenate([rank[:, 1:], np.full((len(row), 1), NO_PAIR, np.int32)], axis=1), rank)
            here = at < width - 1
            rank[own[here], at[here]] = self.look_up(best[here], ids[own[here], at[here] + 1])
            left = at > 0
            rank[own[left], at[left] - 1] = self.look_up(ids[own[left], at[left] - 1], best[left])
        return size

    def merge(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all pieces in one array, and how many each piece has."""
        lengths = np.array([len(p) for p in pieces])
        whole = np.fromiter((self.ranks.get(p, -1) for p in pieces), dtype=np.int64, count=len(pieces))
        counts = np.where(whole >= 0, 1, 0)
        parts = [(np.flatnonzero(whole >= 0), whole[whole >= 0, None])]
        floor = 0
        for width in (4, 8, 12, 16, 24, 32, CACHED_BYTES):
            own = np.flatnonzero((whole < 0) & (lengths > floor) & (lengths <= width))
            if len(own):
                table = np.full((len(own), width), -1, dtype=np.int32)
                counts[own] = self.merge_equal_width([pieces[k] for k in own.tolist()], width, table)
                parts.append((own, table))
            floor = width
        for k in np.flatnonzero((whole < 0) & (lengths > CACHED_BYTES)).tolist():
            ids = np.array(merge_pairs(pieces[k], self.ranks))
            counts[k] = len(ids)
            parts.append((np.array([k]), ids[None, :]))
        start = np.cumsum(counts) - counts
        out = np.empty(int(counts.sum()), dtype=np.int32)
        for own, table in parts:
            column = np.arange(table.shape[1])
            used = column < counts[own, None]
            out[(start[own, None] + column)[used]] = table[used]
        return out, counts


@lru_cache(maxsize=4)
def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines if line.strip())}


@lru_cache(maxsize=4)
def piece_ids(path: str) -> PieceCache:
    return PieceCache(PairTable(load_ranks(path)).merge)


@lru_cache(maxsize=4)
def vocabulary(path: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All token bytes in one array, and the start and length of each id."""
    ranks = load_ranks(path)
    size = max(ranks.values()) + 1
    length = np.zeros(size, dtype=np.int64)
    tokens = [b""] * size
    for token, rank in ranks.items():
        tokens[rank], length[rank] = token, len(token)
    return np.frombuffer(b"".join(tokens), dtype=np.uint8), np.cumsum(length) - length, length


def encode_texts(texts: list[str], path: str) -> tuple[np.ndarray, np.ndarray]:
    """All ids in one array, and how many each text has."""
    pieces, per_text = slices(texts)
    ids, per_piece = piece_ids(path).find(pieces)
    edges = np.concatenate([[0], np.cumsum(per_piece)])
    stop = np.cumsum(per_text)
    return ids, edges[stop] - edges[stop - per_text]


def decode_ids(ids: np.ndarray, counts: np.ndarray, path: str) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all ids in one array, and how many each text has."""
    blob, start, length = vocabulary(path)
    size = length[ids]
    raw = spread(blob, start[ids], size)
    edges = np.concatenate([[0], np.cumsum(size)])
    stop = np.cumsum(counts)
    return raw, edges[stop] - edges[stop - counts]


def list_array(values: np.ndarray, counts: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)), pa.array(values))


def replaced(batch: pa.RecordBatch, columns: dict[str, pa.Array]) -> pa.RecordBatch:
    """The batch with these columns put in place of its own of the same names, or added."""
    kept = [(n, c) for n, c in zip(batch.schema.names, batch.columns, strict=True) if n not in columns]
    return pa.RecordBatch.from_arrays([c for _, c in kept] + list(columns.values()), names=[n for n, _ in kept] + list(columns))


def with_fields(df: DataFrame, *fields: T.StructField) -> T.StructType:
    names = {f.name for f in fields}
    return T.StructType([f for f in df.schema.fields if f.name not in names] + list(fields))


def bpe_encode(df: DataFrame, text_col: str = "text", path: str | None = None, offsets: bool = True, keep: list[str] | None = None) -> DataFrame:
    """Add ``ids`` array<int> and, unless ``offsets`` is off, ``offsets`` array<int> (byte at which each token starts).

    ``keep`` names the input columns to pass on (all by default).
    """
    path = path or public_tokenizers.path(RANKS_FILE)
    df = small_batches(df)
    source = df if keep is None else df.select(*dict.fromkeys([*keep, text_col]))
    out_fields = [T.StructField("ids", T.ArrayType(T.IntegerType(), True))]
    out_fields += [T.StructField("offsets", T.ArrayType(T.IntegerType(), True))] if offsets else []
    schema = with_fields(source if keep is None else source.select(*keep), *out_fields)
    return source.mapInArrow(_encoder(path, text_col, offsets, [] if keep is None or text_col in keep else [text_col]), schema)


def _encoder(path: str, text_col: str, offsets: bool, drop: list[str]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t or "" for t in batch.column(text_col).to_pylist()]
            for a, b in chunks(texts, CHUNK_CHARS):
                ids, counts = encode_texts(texts[a:b], path)
                columns = {"ids": list_array(ids, counts)}
                if offsets:
                    size = vocabulary(path)[2][ids]
                    at = np.cumsum(size) - size
                    first = np.cumsum(counts) - counts
                    base = np.repeat(np.where(counts > 0, at[np.minimum(first, max(len(at) - 1, 0))] if len(at) else 0, 0), counts)
                    columns["offsets"] = list_array((at - base).astype(np.int32), counts)
                part = batch.slice(a, b - a)
                yield replaced(part.drop_columns(drop) if drop else part, columns)

    return encode


def bpe_decode(df: DataFrame, ids_col: str = "ids", path: str | None = None) -> DataFrame:
    """Add ``decoded`` binary: the bytes of the ids. Null ids decode to no bytes."""
    path = path or public_tokenizers.path(RANKS_FILE)
    return df.mapInArrow(_decoder(path, ids_col), with_fields(df, T.StructField("decoded", T.BinaryType())))


def bpe_round_trip(df: DataFrame, text_col: str, keep: list[str], path: str | None = None) -> DataFrame:
    """The columns ``keep`` with ``ids`` and ``decoded``, as ``bpe_encode`` and ``bpe_decode`` give them, in one step: a task needs one Python worker."""
    path = path or public_tokenizers.path(RANKS_FILE)
    source = small_batches(df).select(*dict.fromkeys([*keep, text_col]))
    encode, decode = _encoder(path, text_col, False, [] if text_col in keep else [text_col]), _decoder(path, "ids")
    schema = with_fields(source.select(*keep), T.StructField("ids", T.ArrayType(T.IntegerType(), True)), T.StructField("decoded", T.BinaryType()))
    return source.mapInArrow(lambda batches: decode(encode(batches)), schema)


def _decoder(path: str, ids_col: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(ids_col)
            counts = np.nan_to_num(lists.value_lengths().to_numpy(zero_copy_only=False)).astype(np.int64)
            ends = np.cumsum(counts)
            start = 0
            while start < len(counts):
                stop = max(start + 1, int(np.searchsorted(ends, (ends[start - 1] if start else 0) + CHUNK_CHARS)))
                raw, sizes = decode_ids(lists.slice(start, stop - start).flatten().to_numpy(zero_copy_only=False), counts[start:stop], path)
                edges = pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32))
                decoded = pa.Array.from_buffers(pa.binary(), len(sizes), [None, edges.buffers()[1], pa.py_buffer(raw.tobytes())])
                yield replaced(batch.slice(start, stop - start), {"decoded": decoded})
                start = stop

    return decode


def bpe_digests(docs: DataFrame) -> DataFrame:
    """Per document: the count of its ids and the digests of the ids and of their decoded bytes."""
    decoded = bpe_decode(bpe_encode(docs, offsets=False, keep=["doc_id"]))
    return decoded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.concat_ws(" ", F.col("ids").cast("array<string>")), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
