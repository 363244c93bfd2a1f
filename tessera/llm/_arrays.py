"""Vectorised work on the bytes of Arrow text columns, shared by the operators of this package.

Words are runs of word bytes. Their 64-bit hash is the polynomial sum((byte + 1) * BASE ** i) modulo 2**64, put through `mix`.
`WORD_HASH_SQL` is the same in DuckDB's SQL.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U = np.uint64
BASE = 0x1B873593CC9E2D51
MASK = (1 << 64) - 1
MIX1, MIX2 = 0xBF58476D1CE4E5B9, 0x94D049BB133111EB
#: Bytes of text that are worked on at once; a longer text is a part of its own.
PART = 2 << 20

_space = np.ones(256, bool)
_space[[9, 10, 11, 12, 13, 32]] = False
#: Everything but ASCII white space.
NOT_SPACE = _space
_alnum = np.zeros(256, bool)
_alnum[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True
#: ASCII letters and digits, and every byte of other characters.
ALNUM = _alnum

_powers = np.ones(1, U)


def _power(n: int) -> np.ndarray:
    global _powers
    if len(_powers) < n:
        more = np.full(max(n, 64), BASE, U)
        more[0] = 1
        _powers = np.cumprod(more)
    return _powers


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every bit."""
    x = x ^ (x >> U(30))
    x = x * U(MIX1)
    x = x ^ (x >> U(27))
    x = x * U(MIX2)
    return x ^ (x >> U(31))


def column_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Offsets and bytes of a text column; null counts as empty."""
    if column.null_count:
        column = pc.fill_null(column, "")
    column = column.cast(pa.large_binary())
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1] if offsets else np.zeros(1, np.int64)
    data = np.frombuffer(data, np.uint8) if data and data.size else np.zeros(0, np.uint8)
    return offsets, data


def parts(column: pa.Array, rows: int = 60_000) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row after the last, offsets from 0, bytes) of parts of a column, whole texts each."""
    offsets, data = column_bytes(column)
    at, n = 0, len(offsets) - 1
    while at < n:
        end = int(np.searchsorted(offsets, offsets[at] + PART, "right")) - 1
        end = min(max(end, at + 1), n, at + rows)
        yield at, end, offsets[at : end + 1] - offsets[at], data[offsets[at] : offsets[end]]
        at = end


def words(offsets: np.ndarray, data: np.ndarray, table: np.ndarray = NOT_SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, rows) of the words, in order."""
    if not len(data):
        return (np.zeros(0, np.int64),) * 3
    is_word = table[data]
    start, end = is_word.copy(), is_word.copy()
    start[1:] &= ~is_word[:-1]
    end[:-1] &= ~is_word[1:]
    full = np.flatnonzero(np.diff(offsets))
    firsts, lasts = offsets[full], offsets[full + 1] - 1
    start[firsts], end[lasts] = is_word[firsts], is_word[lasts]
    starts, ends = np.flatnonzero(start), np.flatnonzero(end) + 1
    return starts, ends, np.searchsorted(offsets, starts, "right") - 1


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    if not len(starts):
        return np.zeros(0, U)
    lengths = ends - starts
    firsts = np.zeros(len(lengths), np.int64)
    np.cumsum(lengths[:-1], out=firsts[1:])
    total = int(lengths.sum())
    shift = np.repeat(starts - firsts, lengths)
    at = np.arange(total)
    values = data[at + shift].astype(U) + U(1)
    values *= _power(int(lengths.max()))[at - np.repeat(firsts, lengths)]
    return mix(np.add.reduceat(values, firsts))


def windows(hashes: np.ndarray, width: int) -> np.ndarray:
    """The hash of the `width` words from each word on, by doubling; as many as there are words, those past the end are of no use."""
    out, have, block, size = np.zeros_like(hashes), 0, hashes.copy(), 1
    factor = 0x9E3779B97F4A7C15 | 1
    while True:
        if width & size:
            # appends the block that starts `have` words further on
            moved = np.zeros_like(block)
            moved[: len(block) - have] = block[have:] if have else block
            out = out + moved * U(pow(factor, have, 1 << 64))
            have += size
        if have == width:
            return mix(out)
        moved = np.zeros_like(block)
        if size < len(block):
            moved[:-size] = block[size:]
        block = block + moved * U(pow(factor, size, 1 << 64))
        size *= 2


# --- rows packed by bucket -------------------------------------------------------------------------------------------

#: Values that are packed into one batch at most, so that their offsets stay within 32 bits.
PACKED_AT_ONCE = 8_000_000


def packed(bucket: np.ndarray, columns: dict[str, np.ndarray]) -> Iterator[pa.RecordBatch]:
    """`pack` of any number of values."""
    for at in range(0, len(bucket), PACKED_AT_ONCE):
        yield pack(bucket[at : at + PACKED_AT_ONCE], {k: v[at : at + PACKED_AT_ONCE] for k, v in columns.items()})


def pack(bucket: np.ndarray, columns: dict[str, np.ndarray]) -> pa.RecordBatch:
    """A row for each bucket, with its values as bytes: rows of Spark are few, and the shuffle moves plain arrays."""
    order = np.argsort(bucket, kind="stable")
    bucket = bucket[order]
    cuts = np.flatnonzero(np.diff(bucket)) + 1
    first = np.concatenate([[0], cuts]) if len(bucket) else np.zeros(0, np.int64)
    bounds = np.concatenate([first, [len(bucket)]]) if len(bucket) else np.zeros(1, np.int64)
    arrays = [pa.array(bucket[first].astype(np.int32), pa.int32())]
    for values in columns.values():
        values = np.ascontiguousarray(values[order])
        offsets = pa.py_buffer((bounds * values.dtype.itemsize).astype(np.int32).tobytes())
        arrays.append(pa.Array.from_buffers(pa.binary(), len(first), [None, offsets, pa.py_buffer(values.tobytes())]))
    return pa.RecordBatch.from_arrays(arrays, names=["bucket", *columns])


def unpack(batches: list[pa.RecordBatch], kinds: dict[str, type]) -> dict[str, np.ndarray]:
    """The arrays of packed rows, one after the other."""
    out = {}
    for name, kind in kinds.items():
        pieces = []
        for b in batches:
            offsets, data = column_bytes(b.column(name))
            pieces.append(data[offsets[0] : offsets[-1]])
        joined = np.concatenate(pieces) if pieces else np.zeros(0, np.uint8)
        out[name] = np.frombuffer(joined.tobytes(), kind)
    return out


def components(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nodes of the graph with edges a-b, and the least node of each one's component."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[x], label[y])
        new = label.copy()
        np.minimum.at(new, label[x], low)
        np.minimum.at(new, label[y], low)
        while True:
            jumped = new[new]
            if (jumped == new).all():
                break
            new = jumped
        if (new == label).all():
            return nodes, nodes[label]
        label = new


def hash_sql(word: str) -> str:
    """The hash of a word as a UBIGINT of DuckDB."""
    raw = (
        f"list_reduce(list_prepend(0::HUGEINT, list_transform(range(octet_length(encode({word})) - 1, -1, -1), "
        f"lambda k: ('0x' || substr(hex(encode({word})), 2 * k + 1, 2))::INTEGER::HUGEINT + 1)), "
        f"lambda x, y: (x * {BASE}::HUGEINT + y) % {1 << 64}::HUGEINT)"
    )
    return mix_sql(raw)


def times_sql(x: str, factor: int) -> str:
    """x * factor modulo 2**64; the factor is split, as the product of two 64-bit numbers passes a HUGEINT."""
    high, low = factor >> 32, factor & 0xFFFFFFFF
    return f"(((({x}::HUGEINT * {high}) % {1 << 32}::HUGEINT) * {1 << 32}::HUGEINT + {x}::HUGEINT * {low}) % {1 << 64}::HUGEINT)::UBIGINT"


def mix_sql(x: str) -> str:
    out = f"[({x})::UBIGINT]"
    for shift, factor in ((30, MIX1), (27, MIX2), (31, None)):
        out = f"list_transform({out}, lambda v: xor(v, v >> {shift}))"
        if factor:
            out = f"list_transform({out}, lambda v: {times_sql('v', factor)})"
    return f"({out})[1]"
