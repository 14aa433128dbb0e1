"""Rows that stay where they are read: tasks send compressed fingerprints to owners, and answers come back to the rows.

A frame's RDD has fixed partitions, so (partition, number in it) is a place that a later pass finds again. Answers are
dealt out by partition, put in the order of their rows and zipped with them; the texts themselves are never shuffled.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import RDD
from pyspark.sql import DataFrame

from wattweave.llm.common import task

CHUNK_BYTES = 2_000_000
CHUNK_ROWS = 4_096
WORKER_MB = 256
COUNT = -1


class Homes:
    """The rows of a frame as tuples. `size` gives a row's bytes; a chunk has about CHUNK_BYTES, or one larger row."""

    def __init__(self, df: DataFrame, size: Callable[[tuple], int], chunk_bytes: int = CHUNK_BYTES, chunk_rows: int = CHUNK_ROWS):
        self.rdd, self.size, self.chunk_bytes, self.chunk_rows = df.rdd.map(tuple), size, chunk_bytes, chunk_rows
        self.parts = self.rdd.getNumPartitions()

    def send(self, work: Callable[[int, int, list], Iterator[tuple]], owners: int) -> RDD:
        """Messages (owner, message) that work(partition, row of the chunk's start, rows) makes of each chunk, and from
        each partition its number of rows, which an owner sends back."""
        size, chunk_bytes, chunk_rows = self.size, self.chunk_bytes, self.chunk_rows

        def run(part, rows):
            n = 0
            for rows_of_chunk in chunks(rows, size, chunk_bytes, chunk_rows):
                yield from work(part, n, rows_of_chunk)
                n += len(rows_of_chunk)
            yield part % owners, (part, COUNT, n)

        return self.rdd.mapPartitionsWithIndex(task(run))

    def receive(self, answers: RDD, work: Callable[[int, int, list, list], Iterator]) -> RDD:
        """Zip answers ((partition, row), value) with the rows: work(partition, row of the chunk's start, rows, values)
        for each chunk. Answers are addressed to the first row of a chunk; ((partition, COUNT), rows) must be there."""
        size, chunk_bytes, chunk_rows = self.size, self.chunk_bytes, self.chunk_rows

        def in_line(messages):
            count, row, values = 0, -1, []
            for (_, at), value in messages:
                if at == COUNT:
                    count = value
                    continue
                if at != row:
                    if row >= 0:
                        yield values
                    for _ in range(row + 1, at):
                        yield None
                    row, values = at, []
                values.append(value)
            if row >= 0:
                yield values
            for _ in range(row + 1, count):
                yield None

        def run(part, pairs):
            n, values = 0, []

            def rows():
                for row, got in pairs:
                    if got is not None:
                        values.append(got)
                    yield row

            for rows_of_chunk in chunks(rows(), size, chunk_bytes, chunk_rows):
                got = [v for some in values for v in some]
                values.clear()
                yield from work(part, n, rows_of_chunk, got)
                n += len(rows_of_chunk)

        dealt = modest(answers).repartitionAndSortWithinPartitions(self.parts, lambda place: place[0]).mapPartitions(task(in_line))
        rows, extra = self.rdd, dealt.getNumPartitions() - self.parts
        if extra:
            rows = rows.union(rows.context.parallelize([], extra))
        return rows.zip(dealt).mapPartitionsWithIndex(task(run))


def modest(rdd: RDD) -> RDD:
    """The rows to be dealt out, of which a worker keeps at most WORKER_MB megabytes before it writes or spills them. By
    itself a worker keeps as much as spark.python.worker.memory says, and there is one to each core."""
    most = min(WORKER_MB, rdd._memory_limit())
    rdd._memory_limit = lambda: most
    return rdd


def chunks(rows, size, most, most_rows=CHUNK_ROWS) -> Iterator[list]:
    """Runs of rows, cut as soon as a run has `most` bytes or `most_rows` rows; the same rows make the same runs."""
    run, total = [], 0
    for row in rows:
        run.append(row)
        total += size(row)
        if total >= most or len(run) >= most_rows:
            yield run
            run, total = [], 0
    if run:
        yield run


def rice_encode(values: np.ndarray, low: int, bits: int) -> tuple[int, int, bytes, bytes]:
    """Golomb code with a power of two of sorted distinct integers in [low, low + 2**bits): count, width of the
    remainders, remainders, and unary quotients."""
    n = len(values)
    gaps = np.diff(values, prepend=np.uint64(low)).astype(np.uint64)
    width = max(0, bits - max(0, int(n).bit_length()))
    quotients = (gaps >> np.uint64(width)).astype(np.int64)
    ends = np.cumsum(quotients + 1) - 1
    unary = np.zeros(int(ends[-1]) + 1 if n else 0, np.uint8)
    unary[ends] = 1
    return n, width, pack(gaps & np.uint64((1 << width) - 1), width), np.packbits(unary).tobytes()


def rice_decode(code: tuple[int, int, bytes, bytes], low: int) -> np.ndarray:
    n, width, rests, unary = code
    ends = np.flatnonzero(np.unpackbits(np.frombuffer(unary, np.uint8)))[:n]
    quotients = np.diff(ends, prepend=-1) - 1
    gaps = (quotients.astype(np.uint64) << np.uint64(width)) | unpack(rests, width, n)
    return np.uint64(low) + np.cumsum(gaps, dtype=np.uint64)


def pack(values: np.ndarray, width: int) -> bytes:
    if not width or not len(values):
        return b""
    rows = values.astype(">u8").view(np.uint8).reshape(-1, 8)
    return np.packbits(np.unpackbits(rows, axis=1)[:, 64 - width :]).tobytes()


def unpack(data: bytes, width: int, n: int) -> np.ndarray:
    if not width or not n:
        return np.zeros(n, np.uint64)
    bits = np.zeros((n, 64), np.uint8)
    bits[:, 64 - width :] = np.unpackbits(np.frombuffer(data, np.uint8), count=n * width).reshape(n, width)
    return np.packbits(bits, axis=1).view(">u8").reshape(-1).astype(np.uint64)


def squeezed(data: np.ndarray) -> bytes:
    return pa.Codec("zstd", compression_level=1).compress(np.ascontiguousarray(data), asbytes=True)


def packed(values: np.ndarray) -> bytes:
    """Integers as their differences: those byte by byte, the lowest bytes of all first, and compressed."""
    gaps = np.diff(np.asarray(values, np.int64), prepend=np.int64(0))
    signed = ((gaps << 1) ^ (gaps >> 63)).view(np.uint64)
    width = (int(signed.max(initial=0)).bit_length() + 7) // 8
    return bytes([width]) + (squeezed(signed.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].T) if width else b"")


def unpacked(data: bytes, n: int) -> np.ndarray:
    out, width = np.zeros((n, 8), np.uint8), data[0]
    if width:
        out[:, :width] = np.frombuffer(pa.Codec("zstd").decompress(data[1:], n * width), np.uint8).reshape(width, n).T
    signed = out.view("<u8").reshape(-1)
    return np.cumsum((signed >> np.uint64(1)).astype(np.int64) ^ -(signed & np.uint64(1)).astype(np.int64))


def flags(bits: np.ndarray) -> bytes:
    return np.packbits(bits).tobytes()


def unflags(data: bytes, n: int) -> np.ndarray:
    return np.unpackbits(np.frombuffer(data, np.uint8), count=n).astype(bool)


def to_owners(values: np.ndarray, several: np.ndarray, place: tuple, bits: int, owner_bits: int,
              met: tuple[np.ndarray, ...] = ()) -> Iterator[tuple]:
    """Messages (owner, (place, code, flags)) of sorted distinct integers below 2**bits; the owner is the top bits.
    `several` marks values that the sender alone has met in more than one text; `met` says in how many of its parts it
    has met each value, and in how many of them in unlike contexts."""
    shift = bits - owner_bits
    borders = np.flatnonzero(np.diff((values >> np.uint64(shift)).astype(np.int64), prepend=-1))
    for a, b in zip(borders, [*borders[1:], len(values)]):
        owner = int(values[a]) >> shift
        yield owner, (place, rice_encode(values[a:b], owner << shift, shift), flags(several[a:b]), *(packed(m[a:b]) for m in met))


def found_twice(messages: RDD, owners: int, bits: int, hot: tuple[int, int] | None = None) -> RDD:
    """What owners answer: ((partition, row), (owner, place, n, flags)) with a bit for each value that was sent in
    several messages or marked; with `hot`, further bits for values met in unlike contexts in hot[0] parts or more, or
    in hot[1] parts or more."""
    owner_bits = owners.bit_length() - 1

    def decide(got):
        by_owner: dict[int, list] = {}
        for owner, message in got:
            if message[1] == COUNT:
                yield (message[0], COUNT), message[2]
                continue
            by_owner.setdefault(owner, []).append(message)
        for owner, sent in by_owner.items():
            low = owner << (bits - owner_bits)
            each = [rice_decode(m[1], low) for m in sent]
            values, inverse, counts = np.unique(np.concatenate(each), return_inverse=True, return_counts=True)
            twice = counts > 1
            twice[inverse[np.concatenate([unflags(m[2], len(v)) for v, m in zip(each, sent)])]] = True
            if hot:
                parts, unlike = (np.concatenate([unpacked(m[k], len(v)) for v, m in zip(each, sent)]) for k in (3, 4))
                twice |= np.bincount(inverse, parts, len(values)) > 1
                often = (np.bincount(inverse, unlike, len(values)) >= hot[0]) | (np.bincount(inverse, parts, len(values)) >= hot[1])
            at = 0
            for v, (place, *_) in zip(each, sent):
                own = inverse[at : at + len(v)]
                at += len(v)
                answer = (owner, place, len(v), flags(twice[own]))
                yield place[:2], (*answer, flags(often[own])) if hot else answer

    return modest(messages).partitionBy(owners, lambda owner: owner).mapPartitions(task(decide))


def answered(values: np.ndarray, answers: list[tuple], bits: int, owner_bits: int, which: int = 3) -> np.ndarray:
    """The bits of all owners in the order of the sorted values that were sent."""
    owner_of = (values >> np.uint64(bits - owner_bits)).astype(np.int64)
    out, seen = np.zeros(len(values), bool), 0
    for answer in answers:
        a, b = np.searchsorted(owner_of, [answer[0], answer[0] + 1])
        if b - a != answer[2]:
            raise RuntimeError("a partition has other rows than when it was read first; store the input and run again")
        out[a:b] = unflags(answer[which], b - a)
        seen += b - a
    if seen != len(values):
        raise RuntimeError("a partition has other rows than when it was read first; store the input and run again")
    return out
