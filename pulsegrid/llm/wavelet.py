"""A wavelet matrix of token ids in one compressed file: access, counting and occurrence lookup.

Layout (little-endian): the magic, the length of a JSON header, the header, and sections compressed
with Zstandard.  Ids are renamed to their rank in the sorted ids of the file, so a file of ``d``
different ids has as many bit-planes as ``d - 1`` has bits.  Plane ``k`` holds bit ``k`` (from the
top) of all ids in the order that the planes above leave: first those with a 0, then those with a
1.  A plane is stored in blocks of ``BLOCK`` bits that are compressed one by one; beside them lie
each block's place and the ones before it, so rank reads one block and select finds its block by
binary search.
"""

from __future__ import annotations

import json
import struct

import numpy as np
import zstandard

MAGIC = b"PGWAVE1\n"
BLOCK = 1 << 16  # bits


def _pack(array: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(array.tobytes())


def _planes(seq: np.ndarray, depth: int):
    """The bit-planes of ``seq``, top bit first, as compressed blocks and the ones before each.

    Every plane parts the ids stably by its bit, block by block, so that temporary arrays stay small.
    """
    compress = zstandard.ZstdCompressor(level=1).compress
    for shift in range(depth - 1, -1, -1):
        bit, blocks, ones, parted = seq.dtype.type(1 << shift), [], [0], ([], [])
        for start in range(0, len(seq), BLOCK):
            block = seq[start:start + BLOCK]
            bits = (block & bit) != 0
            blocks.append(compress(np.packbits(bits, bitorder="little")))
            parted[0].append(block.take(np.flatnonzero(~bits)))
            parted[1].append(block.take(np.flatnonzero(bits)))
            ones.append(ones[-1] + len(parted[1][-1]))
        yield blocks, ones
        seq = np.concatenate(parted[0] + parted[1])


def encode(ids: np.ndarray, ends: np.ndarray, keys: list[int | None]) -> bytes:
    """The file of a shard: its token ids, and the key and end position of each document."""
    alphabet = np.flatnonzero(np.bincount(ids)) if len(ids) else np.zeros(0, np.int64)
    depth = max(1, int(len(alphabet) - 1).bit_length()) if len(alphabet) else 0
    renamed = np.zeros(int(alphabet[-1]) + 1 if len(alphabet) else 1, np.uint16 if depth <= 16 else np.uint32)
    renamed[alphabet] = np.arange(len(alphabet))
    body, header = bytearray(), {"tokens": len(ids), "documents": len(ends), "depth": depth, "zeros": [], "sections": {}}

    def add(name: str, *pieces: bytes) -> None:
        header["sections"][name] = [len(body), sum(map(len, pieces))]
        for piece in pieces:
            body.extend(piece)

    add("alphabet", _pack(alphabet.astype("<u4")))
    add("keys", _pack(np.array([k or 0 for k in keys], "<i8")))
    add("missing", _pack(np.array([k is None for k in keys], bool)))
    add("ends", _pack(np.asarray(ends, "<u8")))
    for k, (blocks, ones) in enumerate(_planes(renamed[ids], depth) if len(ids) else ()):
        header["zeros"].append(len(ids) - ones[-1])
        add(f"ones{k}", _pack(np.array(ones, "<u8")))
        add(f"places{k}", _pack(np.cumsum([0, *map(len, blocks)]).astype("<u8")))
        add(f"plane{k}", *blocks)
    told = json.dumps(header).encode()
    return MAGIC + struct.pack("<Q", len(told)) + told + bytes(body)


class WaveletFile:
    """Reads a shard from a seekable file; what a lookup does not touch is not read."""

    def __init__(self, file):
        self._file = file
        start = file.read(len(MAGIC) + 8)
        if start[:len(MAGIC)] != MAGIC:
            raise ValueError("not a wavelet file")
        size = struct.unpack("<Q", start[len(MAGIC):])[0]
        self._header = json.loads(file.read(size))
        self._body = len(start) + size
        self._held: dict[str, np.ndarray] = {}
        self.tokens, self.documents, self.depth = (self._header[k] for k in ("tokens", "documents", "depth"))
        self._zeros = self._header["zeros"]

    def _bytes(self, name: str, start: int = 0, size: int | None = None) -> bytes:
        place, length = self._header["sections"][name]
        self._file.seek(self._body + place + start)
        return self._file.read(length if size is None else size)

    def _array(self, name: str, kind: str) -> np.ndarray:
        if name not in self._held:
            self._held[name] = np.frombuffer(zstandard.ZstdDecompressor().decompress(self._bytes(name)), kind)
        return self._held[name]

    @property
    def alphabet(self) -> np.ndarray:
        return self._array("alphabet", "<u4")

    @property
    def ends(self) -> np.ndarray:
        return self._array("ends", "<u8").astype(np.int64)

    @property
    def keys(self) -> list[int | None]:
        missing = self._array("missing", "bool")
        return [None if gone else int(k) for k, gone in zip(self._array("keys", "<i8"), missing)]

    def _block(self, plane: int, block: int) -> np.ndarray:
        """The bits of one block."""
        places = self._array(f"places{plane}", "<u8")
        raw = self._bytes(f"plane{plane}", int(places[block]), int(places[block + 1] - places[block]))
        bits = np.frombuffer(zstandard.ZstdDecompressor().decompress(raw, max_output_size=BLOCK // 8), np.uint8)
        return np.unpackbits(bits, bitorder="little")[:min(BLOCK, self.tokens - block * BLOCK)]

    def _rank(self, plane: int, at: int) -> int:
        """Ones of a plane before position ``at``."""
        block, inside = divmod(at, BLOCK)
        before = int(self._array(f"ones{plane}", "<u8")[block])
        return before + (int(np.count_nonzero(self._block(plane, block)[:inside])) if inside else 0)

    def _select(self, plane: int, bit: int, order: np.ndarray) -> np.ndarray:
        """Positions of the ``order``-th (from 0, ascending) ones or zeros of a plane."""
        counts = self._array(f"ones{plane}", "<u8").astype(np.int64)
        if not bit:
            counts = np.minimum(np.arange(len(counts)) * BLOCK, self.tokens) - counts
        blocks = np.searchsorted(counts, order, "right") - 1
        found = np.empty(len(order), np.int64)
        for block in np.unique(blocks):
            own = blocks == block
            found[own] = block * BLOCK + np.flatnonzero(self._block(plane, block) == bit)[order[own] - counts[block]]
        return found

    def access(self, at: int) -> int:
        """The id at a position."""
        if not 0 <= at < self.tokens:
            raise IndexError(at)
        name = 0
        for plane in range(self.depth):
            bit = int(self._block(plane, at // BLOCK)[at % BLOCK])
            ones = self._rank(plane, at)
            at = self._zeros[plane] + ones if bit else at - ones
            name = name << 1 | bit
        return int(self.alphabet[name])

    def _path(self, token: int) -> list[int] | None:
        name = int(np.searchsorted(self.alphabet, token))
        if name == len(self.alphabet) or self.alphabet[name] != token:
            return None
        return [name >> shift & 1 for shift in range(self.depth - 1, -1, -1)]

    def _range(self, path: list[int], start: int, end: int) -> tuple[int, int]:
        """Where the ids of ``path`` within a range of positions lie below the last plane."""
        for plane, bit in enumerate(path):
            a, b = self._rank(plane, start), self._rank(plane, end)
            start, end = (self._zeros[plane] + a, self._zeros[plane] + b) if bit else (start - a, end - b)
        return start, end

    def count(self, token: int, start: int = 0, end: int | None = None) -> int:
        """Occurrences of an id from ``start`` to before ``end``."""
        path = self._path(token)
        if path is None:
            return 0
        a, b = self._range(path, start, self.tokens if end is None else end)
        return b - a

    def occurrences(self, token: int, first: int = 0, limit: int | None = None) -> np.ndarray:
        """Positions of an id in ascending order, from its ``first`` occurrence on."""
        path = self._path(token)
        if path is None:
            return np.zeros(0, np.int64)
        a, b = self._range(path, 0, self.tokens)
        places = np.arange(a + first, b if limit is None else min(b, a + first + limit))
        for plane in range(self.depth - 1, -1, -1):
            bit = path[plane]
            places = self._select(plane, bit, places - (self._zeros[plane] if bit else 0))
        return places

    def decode(self) -> np.ndarray:
        """All ids in order: planes are undone from the last to the first, block by block."""
        names = np.zeros(self.tokens, np.uint16 if self.depth <= 16 else np.uint32)
        undo = zstandard.ZstdDecompressor()
        for plane in range(self.depth - 1, -1, -1):
            places, raw = self._array(f"places{plane}", "<u8").astype(np.int64), self._bytes(f"plane{plane}")
            ones = self._array(f"ones{plane}", "<u8").astype(np.int64)
            above, high = np.empty_like(names), names.dtype.type(1 << (self.depth - 1 - plane))
            for block, start in enumerate(range(0, self.tokens, BLOCK)):
                own = above[start:start + BLOCK]
                packed = undo.decompress(raw[places[block]:places[block + 1]], max_output_size=BLOCK // 8)
                bits = np.unpackbits(np.frombuffer(packed, np.uint8), count=len(own), bitorder="little").view(bool)
                first, zeros = int(ones[block]), start - int(ones[block])
                last = int(ones[block + 1])
                own[np.flatnonzero(~bits)] = names[zeros:zeros + len(own) - (last - first)]
                own[np.flatnonzero(bits)] = names[self._zeros[plane] + first:self._zeros[plane] + last] | high
            names = above
        return self.alphabet[names] if self.tokens else np.zeros(0, np.uint32)
