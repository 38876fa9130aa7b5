"""Token ids of whole texts in wavelet-matrix files, one per shard, in ascending order of documents."""

from __future__ import annotations

import json
import os
import uuid
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pulsegrid.llm.mixing import running_sums
from pulsegrid.llm.wavelet import WaveletFile, encode
from pulsegrid.session import scratch_folder, stage

END_ID = 0
SHARD_TOKENS = 1 << 22
HELD_PIECES = 1 << 20
HELD_CHARACTERS = 1 << 26
CALL_BYTES = 1 << 22  # of the texts that are encoded in one call
MANIFEST = "part int, seq int, path string, documents long, tokens long, bytes long"


#: What is known of a character by its byte: the classes of ``_class_of_bytes``.
OTHER, LETTER, DIGIT, SIGN, APOSTROPHE, SPACE, LINE, SOLID, LETTER_END, CONTROL = range(10)


def _class_of_bytes() -> np.ndarray:
    """The class of every byte.  ``SOLID`` bytes begin characters beyond ASCII that are no blanks."""
    kinds = np.full(256, OTHER, np.uint8)
    kinds[:0x80], kinds[0x21:0x7F] = CONTROL, SIGN
    kinds[0x30:0x3A] = DIGIT
    kinds[0x41:0x5B] = kinds[0x61:0x7B] = LETTER
    kinds[0x27], kinds[0x20], kinds[0x09:0x0E] = APOSTROPHE, SPACE, LINE
    kinds[0xC3:0xE1] = kinds[0xE4:0xF5] = SOLID
    return kinds


def _pairs(first: list[int], second: list[int]) -> np.ndarray:
    found = np.zeros(256, bool)
    found[[a << 4 | b for a in first for b in second]] = True
    return found


KINDS = _class_of_bytes()
KINDS_TABLE = KINDS.tobytes()
NO_BLANKS = [LETTER, DIGIT, SIGN, APOSTROPHE, SOLID]
#: Two-byte letters: U+00C0 to U+024F (but for the signs U+00D7 and U+00F7) and U+0400 to U+047F.
LETTER_LEADS = np.isin(np.arange(256), [*range(0xC3, 0xCA), 0xD0, 0xD1])
CUT_BETWEEN = (
    _pairs([LETTER, LETTER_END], [DIGIT, SIGN, APOSTROPHE, SPACE, LINE, CONTROL])
    | _pairs([DIGIT], [LETTER, SIGN, APOSTROPHE, SPACE, LINE, CONTROL])
    | _pairs([SIGN], [LETTER, DIGIT, SPACE, LINE]) | _pairs([APOSTROPHE], [DIGIT, SPACE, LINE]) | _pairs([LINE], NO_BLANKS)
)
CUT_BEFORE = _pairs([SPACE, LINE], NO_BLANKS)
CUTS_TABLE = (CUT_BETWEEN * 2 + CUT_BEFORE).astype(np.uint8).tobytes()


def piece_starts(raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Where pieces begin in the UTF-8 bytes ``raw`` of texts, which begin and end at ``offsets``.

    Byte-level tokenizers part a text into ``'s`` and the like, runs of letters, of digits and of
    signs, each with a space before it, and runs of blanks without the last one before another
    character.  So a text may be cut without changing its ids where a run of one kind meets another
    kind of character (but for a letter after an apostrophe), before a blank that no blank follows,
    and behind such a blank that is not a space.  Characters whose kind is not known from their bytes
    are left with their neighbours.
    """
    kinds = np.frombuffer(bytearray(raw).translate(KINDS_TABLE), np.uint8)
    leads = np.flatnonzero(kinds == SOLID)
    leads = leads[LETTER_LEADS[raw[leads]]]
    letters = leads[(raw[leads] != 0xC3) | ((raw[leads + 1] != 0x97) & (raw[leads + 1] != 0xB7))]
    kinds[letters + 1] = LETTER_END
    pairs = kinds[:-1] << 4 | kinds[1:]
    inner = offsets[(offsets > 0) & (offsets < len(raw))]
    pairs[inner - 1] = 0  # no character meets one of the next text
    found = np.frombuffer(pairs.tobytes().translate(CUTS_TABLE), np.uint8)
    cuts = np.zeros(len(raw), bool)
    cuts[:-1] = found & 1
    cuts[1:] |= found > 1
    cuts[inner] = True
    cuts[:1] = True
    return np.flatnonzero(cuts)


class Encoder:
    """Encodes texts with a tokenizers file, each different piece of text once.

    Texts are cut into the pieces of ``piece_starts``, and those of a call are numbered by Arrow.
    Texts that hold a special token's string are encoded whole, and so are all texts if the tokenizer
    is not byte-level.  Pieces that were met before are looked up; when ``HELD_PIECES`` pieces or
    ``HELD_CHARACTERS`` bytes are held, those that only one call met are forgotten, and all if the rest
    fills over half of that room.
    """

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark's tasks use the cores already
        from tokenizers import Tokenizer

        self._tokenizer = Tokenizer.from_file(path)
        self._specials = [t.content for t in self._tokenizer.get_added_tokens_decoder().values()]
        told = json.loads(self._tokenizer.to_str())
        before = told["pre_tokenizer"] or {}
        vocabulary = self._tokenizer.get_vocab()
        self._in_pieces = (
            before.get("type") == "ByteLevel" and not before["add_prefix_space"] and before.get("use_regex", True)
            and not told["normalizer"] and sum(len(t) == 1 for t in vocabulary) >= 256
        )
        # A byte-level token has one character for each of its bytes.
        self._bytes = np.zeros(max(vocabulary.values()) + 1, np.int64)
        self._bytes[list(vocabulary.values())] = list(map(len, vocabulary))
        self._clear()

    def _clear(self) -> None:
        self._seen: dict[bytes, int] = {}  # a piece -> its entry
        self._flat, self._bounds = np.zeros(1 << 16, np.uint32), np.zeros(1 << 15, np.int64)
        self._again = np.zeros(1 << 15, bool)  # entries that a later call met, too
        self._held = 0

    def _forget(self) -> None:
        """Make room: pieces that only one call met go first."""
        entries = np.flatnonzero(self._again[:len(self._seen)])
        pieces = [p for p, again in zip(self._seen, self._again.tolist()) if again]
        ids, ends = self._ids_of(entries)
        self._clear()
        if 2 * len(pieces) <= HELD_PIECES and 2 * sum(map(len, pieces)) <= HELD_CHARACTERS:
            self._hold(pieces, ids, ends)

    def _raw(self, texts: list[str]) -> list[np.ndarray]:
        found = self._tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        return [np.array(e.ids, np.uint32) for e in found]

    def _learn(self, pieces: list[bytes]) -> None:
        """Entries for new pieces.

        One that the tokenizer would not part before it merges goes to its model; others are encoded in
        a row where each may be cut from the one before it, or else by themselves.
        """
        words, spaced, solid, alone = [], [], [], []
        for piece in pieces:
            if piece.isalpha() or piece[0] == 0x20 and piece[1:].isalpha():  # of ASCII letters
                words.append(piece)
            elif KINDS_TABLE[piece[0]] in NO_BLANKS:
                solid.append(piece)
            elif piece[0] == 0x20 and len(piece) > 1 and KINDS_TABLE[piece[1]] in NO_BLANKS:
                spaced.append(piece)
            else:
                alone.append(piece)
        self._hold(words, *self._merged(words))
        self._hold(spaced, *self._in_rows(spaced))
        ids, ends = self._in_rows([b"\n" + p for p in solid])  # a single line break is a token of its own
        breaks = np.append(0, ends)[:-1]
        self._hold(solid, np.delete(ids, breaks), ends - np.arange(1, len(ends) + 1))
        found = self._raw([p.decode() for p in alone])
        self._hold(alone, np.concatenate([np.zeros(0, np.uint32), *found]), np.cumsum([len(f) for f in found], dtype=np.int64))

    def _merged(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all words, and where those of each end."""
        tokenize, ids, ends = self._tokenizer.model.tokenize, [], []
        for word in words:
            ids += [t.id for t in tokenize(word.decode().replace(" ", "\u0120"))]  # so byte-level tokens write a space
            ends.append(len(ids))
        return np.array(ids, np.uint32), np.array(ends, np.int64)

    def _in_rows(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all pieces, which are parted again by their bytes, and where those of each end."""
        rows = [b"".join(pieces[a:a + 256]).decode() for a in range(0, len(pieces), 256)]
        ids = np.concatenate([np.zeros(0, np.uint32), *self._raw(rows)])
        sizes = np.fromiter(map(len, pieces), np.int64, len(pieces))
        return ids, np.searchsorted(np.cumsum(self._bytes[ids]), np.cumsum(sizes)) + 1

    def _hold(self, pieces: list[bytes], ids: np.ndarray, ends: np.ndarray) -> None:
        """Entries for ``pieces``, whose ``ids`` end at ``ends``."""
        known = len(self._seen)
        first = int(self._bounds[known])
        while first + len(ids) > len(self._flat):
            self._flat = np.concatenate([self._flat, np.zeros_like(self._flat)])
        while known + len(ends) >= len(self._bounds):
            self._bounds = np.concatenate([self._bounds, np.zeros_like(self._bounds)])
            self._again = np.concatenate([self._again, np.zeros_like(self._again)])
        self._flat[first:first + len(ids)] = ids
        self._bounds[known + 1:known + 1 + len(ends)] = first + ends
        self._seen.update(zip(pieces, range(known, known + len(ends))))
        self._held += sum(map(len, pieces))

    def _ids_of(self, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of entries in a row, and where those of each end."""
        first = self._bounds[entries]
        lengths = self._bounds[entries + 1] - first
        ends = np.cumsum(lengths)
        places = np.repeat(first - (ends - lengths), lengths)
        places += np.arange(len(places))
        return self._flat[places], ends

    def encode(self, texts: list[str] | pa.Array) -> list[np.ndarray]:
        """The ids of every text, as the tokenizer gives them without special tokens added."""
        texts = pa.array(texts, pa.string()) if isinstance(texts, list) else texts.cast(pa.string())
        if not self._in_pieces:
            return self._raw(texts.to_pylist())
        if len(self._seen) > HELD_PIECES or self._held > HELD_CHARACTERS:
            self._forget()
        special = np.zeros(len(texts), bool)
        for s in self._specials:
            special |= pc.match_substring(texts, s).to_numpy(zero_copy_only=False)
        whole = np.flatnonzero(special)
        out = self._by_pieces(texts if not len(whole) else pc.if_else(pa.array(special), "", texts))
        for k, ids in zip(whole, self._raw(texts.take(pa.array(whole)).to_pylist())):
            out[k] = ids
        return out

    def _by_pieces(self, texts: pa.Array) -> list[np.ndarray]:
        if not len(texts):
            return []
        offsets = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset:texts.offset + len(texts) + 1].astype(np.int64)
        if offsets[0] == offsets[-1]:
            return [np.zeros(0, np.uint32)] * len(texts)
        raw, offsets = np.frombuffer(texts.buffers()[2], np.uint8)[offsets[0]:offsets[-1]], offsets - offsets[0]
        starts = piece_starts(raw, offsets)
        bounds = pa.py_buffer(np.append(starts, len(raw)).astype(np.int32))
        found = pa.Array.from_buffers(pa.binary(), len(starts), [None, bounds, pa.py_buffer(raw)]).dictionary_encode()
        pieces = found.dictionary.to_numpy(zero_copy_only=False).tolist()
        known = len(self._seen)
        entries = list(map(self._seen.get, pieces))
        gaps = [k for k, e in enumerate(entries) if e is None]
        self._learn([pieces[k] for k in gaps])
        for k in gaps:
            entries[k] = self._seen[pieces[k]]
        numbers = np.array(entries, np.int64)
        self._again[numbers[numbers < known]] = True
        ids, ends = self._ids_of(numbers[found.indices.to_numpy()])
        bounds = np.append(0, ends)[np.searchsorted(starts, offsets)].tolist()
        return [ids[a:b] for a, b in zip(bounds, bounds[1:])]


@lru_cache(maxsize=1)
def encoder_of(path: str) -> Encoder:
    """One encoder per worker process, so that later tasks find the pieces of earlier ones."""
    return Encoder(path)


def _open(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def _store(uri: str, data: bytes) -> None:
    system, path = _open(uri)
    system.create_dir(path.rsplit("/", 1)[0], recursive=True)
    with system.open_output_stream(path) as out:
        out.write(data)


def write_shards(
    docs: DataFrame, tokenizer: str, folder: str | None = None, id_col: str = "doc_id", text_col: str = "text",
    end_id: int = END_ID, shard_tokens: int = SHARD_TOKENS,
) -> DataFrame:
    """Write the token ids of ``docs`` and return the manifest of the files.

    Rows are dealt by ranges of ``(id, text hash)`` and sorted, so the files in order of ``(part,
    seq)`` hold the documents in ascending order of their ids.  Every document's ids are followed by
    ``end_id``; a file is closed when it holds ``shard_tokens`` ids, so only a single document can
    make it much longer.  ``tokenizer`` is a path that every executor can read.

    NULL and empty texts have the end id alone; ids that are NULL come last; rows that repeat an id
    are documents of their own, in the order of their texts' hashes; an empty table gives no files.
    Very long texts are encoded whole, one at a time in a task's memory.

    ``folder`` is a URI that all executors can write through ``pyarrow.fs``; by default it lies below
    ``spark.checkpoint.dir``.  A task that is run again writes files with other names, and only those
    that a finished task has named are in the manifest, which is itself a table written by Spark.
    """
    spark = docs.sparkSession
    folder = folder or f"{scratch_folder(spark)}/tokens-{uuid.uuid4().hex}"

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoder_of(tokenizer)
        part, seq, held, keys, total = TaskContext.get().partitionId(), 0, [], [], 0
        end = np.array([end_id], np.uint32)

        def flush() -> pa.RecordBatch:
            data = encode(np.concatenate(held), np.cumsum([len(h) for h in held]), keys)
            path = f"{folder}/shard-{part:06d}-{seq:06d}-{uuid.uuid4().hex}.wm"
            _store(path, data)
            row = {"part": part, "seq": seq, "path": path, "documents": len(held), "tokens": total, "bytes": len(data)}
            return pa.RecordBatch.from_pylist([row], schema)

        schema = pa.schema([
            ("part", pa.int32()), ("seq", pa.int32()), ("path", pa.string()),
            ("documents", pa.int64()), ("tokens", pa.int64()), ("bytes", pa.int64()),
        ])
        for batch in batches:
            texts = pc.fill_null(batch.column(1), "")
            reach, a = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False), dtype=np.int64), 0
            while a < len(texts):
                b = max(a + 1, int(np.searchsorted(reach, (reach[a - 1] if a else 0) + CALL_BYTES, "right")))
                keyed, a = zip(batch.column(0)[a:b].to_pylist(), encoder.encode(texts[a:b])), b
                for key, ids in keyed:
                    own = np.concatenate([ids, end])
                    held.append(own)
                    keys.append(key)
                    total += len(own)
                    if total >= shard_tokens:
                        yield flush()
                        seq, held, keys, total = seq + 1, [], [], 0
        if held:
            yield flush()

    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    order = [F.col("id").isNull(), F.col("id"), F.xxhash64("text")]
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    dealt = rows.repartitionByRange(n, *order).sortWithinPartitions(*order)
    return stage(dealt.mapInArrow(write, MANIFEST), "token-files")


def read_documents(manifest: DataFrame) -> DataFrame:
    """``(id, start, n_tokens, ids_crc32)`` per document, from the files alone.

    ``start`` counts the ids of all documents before it; ``ids_crc32`` is over the document's ids as
    little-endian unsigned 32-bit integers, its end id included.
    """
    n = int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = running_sums(manifest.withColumn("all", F.lit(0)), "all", ["part", "seq"], "tokens", "start")
    schema = pa.schema([("id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder_of.cache_clear()  # the files are written: what a worker held for them is not needed any more
        for batch in batches:
            for row in batch.to_pylist():
                system, path = _open(row["path"])
                with system.open_input_file(path) as file:
                    shard = WaveletFile(file)
                    ids, ends, keys = shard.decode().astype("<u4"), shard.ends, shard.keys
                starts = np.concatenate([[0], ends[:-1]]).astype(np.int64)
                sums = [zlib.crc32(ids[a:b]) for a, b in zip(starts, ends)]
                yield pa.RecordBatch.from_arrays([
                    pa.array(keys, pa.int64()), pa.array(starts + row["start"]), pa.array(ends - starts), pa.array(sums, pa.int64()),
                ], schema=schema)

    files = placed.select("path", "start").repartition(n, "path")
    return files.mapInArrow(read, "id long, start long, n_tokens long, ids_crc32 long")


def token_counts(manifest: DataFrame, tokens: list[int]) -> DataFrame:
    """``(token, n)``: occurrences of each id over all files, from ranks; no file is decoded."""
    wanted = list(dict.fromkeys(tokens))

    def read(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for uri in frame["path"]:
                system, path = _open(uri)
                with system.open_input_file(path) as file:
                    shard = WaveletFile(file)
                    yield pd.DataFrame({"token": wanted, "n": [shard.count(t) for t in wanted]})

    found = manifest.select("path").mapInPandas(read, "token long, n long")
    return found.groupBy("token").agg(F.sum("n").alias("n"))


def token_occurrences(manifest: DataFrame, tokens: list[int], step: int = 1 << 16) -> DataFrame:
    """``(token, id, position)``: every occurrence of each id, as a position within its document.

    Found by select from the planes, ``step`` occurrences at a time.
    """
    wanted = list(dict.fromkeys(tokens))

    def read(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for uri in frame["path"]:
                system, path = _open(uri)
                with system.open_input_file(path) as file:
                    shard = WaveletFile(file)
                    ends, keys = shard.ends, shard.keys
                    starts = np.concatenate([[0], ends[:-1]])
                    for token in wanted:
                        for first in range(0, shard.count(token), step):
                            places = shard.occurrences(token, first, step)
                            own = np.searchsorted(ends, places, "right")
                            yield pd.DataFrame({
                                "token": token, "id": pd.array([keys[k] for k in own], "Int64"), "position": places - starts[own],
                            })

    return manifest.select("path").mapInPandas(read, "token long, id long, position long")
