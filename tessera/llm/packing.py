"""Bounded-space online packing of token sequences (operator 4).

A partition keeps a fixed number of open windows. A document's full windows
leave at once; what remains goes where it fits best. If it fits nowhere, the
fullest window is emitted, topped up with the head of the piece if the gap
is worth a cut. Windows left open at the end of partitions are merged by
further rounds, each of a bounded number of windows to a task.
"""

from __future__ import annotations

import base64
import re
import zlib
from collections.abc import Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import by_bytes, column_buffer, materialize, partitions
from .shingles import span_hashes, word_spans

#: Open windows of a partition, the least gap that is worth cutting a piece, partitions merged by one task.
WINDOWS, LEAST_CUT, FAN_IN = 16, 16, 64
SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, ids binary, part long"

#: What the two libraries might part differently: unusual or very long white space, characters
#: beyond the basic plane, and what looks like a special token.
RARE = re.compile("[\\x1c-\\x1f\\x85\\xa0\\u1680\\u180e\\u2000-\\u200f\\u2028\\u2029\\u202f\\u205f\\u3000\\ufeff\\U00010000-\\U0010ffff]|<\\||\\s{500}")
#: White space that counts as very long.
LONG_GAP = 500


#: Bytes of which a text must have one to be rare.
_SUSPECT = np.array([b < 9 or 13 < b < 32 or b in (ord("<"), 0xC2, 0xE1, 0xE2, 0xE3, 0xEF) or b >= 0xF0 for b in range(256)])


class Encoder:
    """Ids of whole texts as little-endian 32-bit words, by the tokenizer file at path.

    The public byte-level BPE is there for two libraries with the same ids.
    The faster one encodes plain texts, the tokenizer file itself all others,
    and whatever another file is given for. Byte-level pre-tokenizers never
    join white space to what precedes it, so a plain text's ids are those of
    its units, of white space and the word after it, one after the other;
    each different unit of a batch is encoded once. Units are told apart by
    hashes, and those of equal hashes are then compared byte by byte.
    """

    def __init__(self, path: str | None = None):
        self.plain = None
        if path is None:
            import public_tokenizers
            import tiktoken

            path = public_tokenizers.path("byte_bpe_50k.json")
            with open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as lines:
                ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
            self.plain = tiktoken.Encoding("byte_bpe_50k", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
            self.bytes_of = np.zeros(max(ranks.values()) + 1, np.int64)
            for token, rank in ranks.items():
                self.bytes_of[rank] = len(token)
        self.path = path

    @cached_property
    def tokenizer(self):
        """The tokenizer file itself, loaded only for texts that need it."""
        from tokenizers import Tokenizer

        return Tokenizer.from_file(self.path)

    def encode(self, text: str) -> bytes:
        return self.encode_all(pa.array([text], pa.string()))[0]

    def _whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _ids(self, raw: bytes) -> np.ndarray:
        return self.plain.encode_to_numpy(raw.decode(), disallowed_special=()).astype("<u4", copy=False)

    def encode_all(self, column: pa.Array) -> list[bytes]:
        if self.plain is None:
            return [self._whole(t or "") for t in column.to_pylist()]
        data, offsets = column_buffer(column)
        raw = data.tobytes()
        starts, stops, at = word_spans(data, offsets)
        begins = np.concatenate(([0], stops[:-1]))[: len(starts)]
        filled = np.flatnonzero(np.diff(at))
        begins[at[filled]] = offsets[filled]
        keys, first, which = np.unique(span_hashes(data, begins, stops, lower=False), return_index=True, return_inverse=True)
        lo, hi = begins[first], stops[first]
        unlike = np.searchsorted(at, _unlike(data, begins, stops, lo[which], hi[which]), "right") - 1
        # A unit without white space before it would run into another, so it is encoded alone: one for each text at most.
        alone = np.flatnonzero(lo == starts[first])
        together = np.flatnonzero(lo != starts[first])
        ids = self._ids(b"".join([raw[a:b] for a, b in zip(lo[together].tolist(), hi[together].tolist(), strict=True)]))
        ends = np.searchsorted(np.cumsum(self.bytes_of[ids]), np.cumsum(hi[together] - lo[together])) + 1
        own = [self._ids(raw[lo[k] : hi[k]]) for k in alone]
        count, begin = np.zeros(len(keys), np.int64), np.zeros(len(keys), np.int64)
        count[together], begin[together] = np.diff(ends, prepend=0), np.concatenate(([0], ends[:-1]))[: len(ends)]
        count[alone] = [len(x) for x in own]
        begin[alone] = len(ids) + np.cumsum(count[alone]) - count[alone]
        ids = np.concatenate([ids, *own])
        each = count[which]
        past = np.concatenate(([0], np.cumsum(each)))
        all_ids = ids[np.repeat(begin[which] - past[:-1], each) + np.arange(past[-1])].astype("<u4", copy=False).tobytes()
        cuts = (past[at] * 4).tolist()
        last = offsets[:-1].copy()
        last[filled] = stops[at[filled + 1] - 1]
        out = [all_ids[a:b] for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
        for k in np.flatnonzero(last < offsets[1:]):  # white space at the end
            out[k] += self._ids(raw[last[k] : offsets[k + 1]]).tobytes()
        suspects = np.searchsorted(offsets, np.flatnonzero(_SUSPECT[data]), "right") - 1
        long_gaps = np.searchsorted(offsets, starts[starts - begins >= LONG_GAP], "right") - 1
        for k in {*np.unique(suspects).tolist(), *long_gaps.tolist(), *np.flatnonzero(offsets[1:] - last >= LONG_GAP).tolist()}:
            text = raw[offsets[k] : offsets[k + 1]].decode()
            if RARE.search(text):
                out[k] = self._whole(text)
        for k in np.unique(unlike).tolist():
            out[k] = self._whole(raw[offsets[k] : offsets[k + 1]].decode())
        return out


def _unlike(data: np.ndarray, starts: np.ndarray, stops: np.ndarray, lo: np.ndarray, hi: np.ndarray, block: int = 1 << 20) -> np.ndarray:
    """Places of the spans, in order, whose bytes aren't those of the span lo to hi that stands for them."""
    length = stops - starts
    odd = length != hi - lo
    at = 0
    while at < len(starts):
        to = max(at + 1, int(np.searchsorted(stops, starts[at] + block, "right")))
        n = np.where(odd[at:to], 0, length[at:to])
        own = np.repeat(starts[at:to] - np.cumsum(n) + n, n) + np.arange(n.sum())
        differ = data[own] != data[own + np.repeat(lo[at:to] - starts[at:to], n)]
        if differ.any():
            odd[at + np.repeat(np.arange(to - at), n)[differ]] = True
        at = to
    return np.flatnonzero(odd)


class Packer:
    """Packs pieces (doc_id, start, ids, doc_tokens) into windows of at most size ids; full ones land in out."""

    def __init__(self, size: int, first_id: int, windows: int = WINDOWS, least_cut: int = LEAST_CUT):
        self.size, self.next, self.windows, self.least_cut = size, first_id, windows, least_cut
        self.open: list[list] = []  # of [ids held, pieces]
        self.out: list[tuple] = []

    def place(self, doc_id, start: int, ids: bytes, tokens: int) -> None:
        whole, ids = self.size * 4, memoryview(ids)  # cuts copy nothing
        while len(ids) >= whole:
            self.emit([(doc_id, start, ids[:whole], tokens)])
            start, ids = start + self.size, ids[whole:]
        while ids:
            n = len(ids) // 4
            fits = [w for w in self.open if w[0] + n <= self.size]
            if fits:
                best = max(fits, key=lambda w: w[0])
            elif len(self.open) < self.windows:
                self.open.append(best := [0, []])
            else:
                best = max(self.open, key=lambda w: w[0])
                gap = self.size - best[0]
                if gap < self.least_cut:
                    self.close(best)
                    continue
                n = gap
            best[0] += n
            best[1].append((doc_id, start, ids[: 4 * n], tokens))
            start, ids = start + n, ids[4 * n :]
            if best[0] == self.size:
                self.close(best)

    def close(self, window: list) -> None:
        self.open.remove(window)
        self.emit(window[1])

    def emit(self, pieces: list[tuple]) -> None:
        at = 0
        for doc_id, start, ids, tokens in pieces:
            n = len(ids) // 4
            self.out.append((doc_id, start, n, zlib.crc32(ids), tokens, self.next, at, None, None))
            at += n
        self.next += 1

    def leave(self, part: int) -> None:
        """Hand open windows over, with their ids."""
        for k, (_, pieces) in enumerate(self.open):
            at = 0
            for doc_id, start, ids, tokens in pieces:
                self.out.append((doc_id, start, len(ids) // 4, zlib.crc32(ids), tokens, k, at, bytes(ids), part))
                at += len(ids) // 4
        self.open = []

    def finish(self) -> None:
        """Merge the open windows into full ones; the last, shorter one is cut into powers of two, which need no padding."""
        pieces = [p for _, held in self.open for p in held]
        self.open = []
        total = sum(len(p[2]) // 4 for p in pieces)
        sizes = [self.size] * (total // self.size) + [1 << b for b in range((total % self.size).bit_length() - 1, -1, -1) if total % self.size >> b & 1]
        now: list[tuple] = []
        for size in sizes:
            now, need = [], size
            while need:
                doc_id, start, ids, tokens = pieces.pop(0)
                n = min(need, len(ids) // 4)
                now.append((doc_id, start, ids[: 4 * n], tokens))
                if len(ids) > 4 * n:
                    pieces.insert(0, (doc_id, start + n, ids[4 * n :], tokens))
                need -= n
            self.emit(now)


NAMES = [f.split()[0] for f in SCHEMA.split(", ")]
KINDS = [pa.binary() if n == "ids" else pa.int64() for n in NAMES]


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = zip(*rows, strict=True) if rows else [[] for _ in NAMES]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, KINDS, strict=True)], names=NAMES)


def _first_id(level: int) -> int:
    """Sequences of a round and a task are numbered apart from all others."""
    return (level << 58) + (TaskContext.get().partitionId() << 32)


def _packed(tokenizer: str | None, size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, packer = Encoder(tokenizer), Packer(size, _first_id(0))
        for batch in by_bytes(batches, 1):
            for doc_id, ids in zip(batch.column(0).to_pylist(), encoder.encode_all(batch.column(1)), strict=True):
                ids += b"\0\0\0\0"
                packer.place(doc_id, 0, ids, len(ids) // 4)
            if len(packer.out) >= 2000:
                yield _batch(packer.out)
                packer.out = []
        packer.leave(TaskContext.get().partitionId())
        yield _batch(packer.out)

    return run


def _merged(level: int, size: int, last: bool):
    """Rows sorted by group, part, window and offset."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer, group = Packer(size, _first_id(level)), None
        for batch in batches:
            for row in zip(*(batch.column(k).to_pylist() for k in range(5)), strict=True):
                if group is not None and row[0] != group:
                    packer.finish() if last else packer.leave(group)
                group = row[0]
                packer.place(*row[1:])
        if group is not None:
            packer.finish() if last else packer.leave(group)
        yield _batch(packer.out)

    return run


def pack(docs: DataFrame, size: int = 1024, tokenizer: str | None = None) -> DataFrame:
    """Pieces of documents (doc_id, text) in sequences of at most size ids.

    doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset; each
    document's ids, followed by id 0, lie in exactly one piece each. Null
    texts are empty and have id 0 only. Rows that share or lack a doc_id are
    packed as documents of their own; other columns are ignored; an empty
    table gives an empty result. tokenizer: path of a byte-level BPE file;
    the public one by default.
    """
    spark = docs.sparkSession
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    made = materialize(texts.mapInArrow(_packed(tokenizer, size), SCHEMA))
    done, level = [made.where("ids is null")], 0
    left = made.where("ids is not null")
    parts = (left.agg(F.max("part").alias("n")).first()["n"] or 0) + 1
    while True:
        level, parts, last = level + 1, -(-parts // FAN_IN), parts <= FAN_IN
        grouped = left.withColumn("group", F.floor(F.col("part") / FAN_IN))
        rows = grouped.repartition(min(parts, partitions(spark)), "group").sortWithinPartitions("group", "part", "sequence_id", "offset")
        made = rows.select("group", "doc_id", "start", "ids", "doc_tokens").mapInArrow(_merged(level, size, last), SCHEMA)
        if last:
            done.append(made)
            break
        made = materialize(made)
        done.append(made.where("ids is null"))
        left = made.where("ids is not null")
    out = done[0]
    for rows in done[1:]:
        out = out.union(rows)
    return out.drop("ids", "part")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
