"""Hashes of word runs, vectorised: helpers that run inside Python workers."""

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

_A = np.uint64(0x9E3779B97F4A7C15)
_B = np.uint64(0xC2B2AE3D27D4EB4F)
_C = np.uint64(0x165667B19E3779F9)


def word_hashes(words):
    """64-bit hash of each word (bytes)."""
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


def mix(left, right):
    """One hash of two, in order."""
    x = left * _A + ((right << np.uint64(31)) | (right >> np.uint64(33))) * _B
    x ^= x >> np.uint64(29)
    x *= _C
    x ^= x >> np.uint64(32)
    return x


def run_hashes(hashes, length):
    """Hash of each run of `length` consecutive words; doubling, so about log2(length) steps."""
    size = 1
    while size * 2 <= length:
        hashes = mix(hashes[:-size], hashes[size:])
        size *= 2
    rest = length - size
    return mix(hashes[:-rest], hashes[rest:]) if rest else hashes


# The lowest 0 to 8 bytes of a number.
_LOW = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)
# Bytes of a span that `packed` keeps.
PACKED = 24


def text_bytes(column):
    """(bytes, offsets) of a binary column as two arrays; NULL is empty."""
    column = pc.fill_null(column.cast(pa.binary()), b"")
    offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1]
    if not len(column) or offsets[0] == offsets[-1]:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    return np.frombuffer(column.buffers()[2], np.uint8)[offsets[0] : offsets[-1]], (offsets - offsets[0]).astype(np.int64)


def spans(inside, cuts):
    """(starts, ends) of the runs of true values; none goes across a position of `cuts`."""
    begin, cuts = inside.copy(), cuts[(cuts > 0) & (cuts < len(inside))]
    begin[1:] &= ~inside[:-1]
    begin[cuts] = inside[cuts]
    end = inside.copy()
    end[:-1] &= ~inside[1:]
    end[cuts - 1] = inside[cuts - 1]
    return np.flatnonzero(begin), np.flatnonzero(end) + 1


def packed(data, starts, sizes):
    """The first PACKED bytes of spans, as three numbers each; zeros follow those of shorter ones."""
    padded = np.concatenate([data, np.zeros(PACKED, np.uint8)])
    view = np.ndarray(len(padded) - 7, "<u8", padded, strides=(1,))
    found = [view[starts] & _LOW[np.minimum(sizes, 8)]]
    for skip in (8, 16):
        part = np.zeros(len(starts), np.uint64)
        long = np.flatnonzero(sizes > skip)
        part[long] = view[starts[long] + skip] & _LOW[np.minimum(sizes[long] - skip, 8)]
        found.append(part)
    return found


def span_hashes(data, starts, ends):
    """64-bit hash of each span of bytes."""
    sizes = ends - starts
    first, *rest = packed(data, starts, sizes)
    hashes = mix(first, sizes.astype(np.uint64))
    for skip, part in zip((8, 16), rest, strict=True):
        long = np.flatnonzero(sizes > skip)
        hashes[long] = mix(hashes[long], part[long])
    for i in np.flatnonzero(sizes > PACKED):
        hashes[i] = xxhash.xxh3_64_intdigest(data[starts[i] : ends[i]])
    return hashes
