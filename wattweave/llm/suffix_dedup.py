"""Repeated passages by a radix sort of suffixes that stops at the threshold's depth."""

from __future__ import annotations

import hashlib
import pickle

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wattweave.llm.common import id_and_text, stored, task
from wattweave.llm.homes import (CHUNK_ROWS, COUNT, Homes, answered, found_twice, modest, packed, squeezed, to_owners,
                                 unpacked)

#: The multipliers of the rolling hashes, odd and without structure.
FACTORS = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F,
           0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3)
BITS = 52
PLACE_BITS = 22
PART = 1 << 19
#: Positions hashed and records compared at once: what they take stays in a core's cache.
HASHED, COMPARED = 1 << 15, 4_000
HOT = (64, 100_000)
#: Bytes whose digits travel together, and records that do: an owner's message then stays large when there are many owners.
CHUNK_BYTES = 16_000_000
RECORDS = 400_000
PER_OWNER = 3_000_000
NO_ID = np.iinfo(np.int64).max
ANSWERS = "part long, at long, kind int, value binary"
OUT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(29))) * np.uint64(FACTORS[5])
    return h ^ (h >> np.uint64(32))


def gram_hash(data: np.ndarray, length: int) -> np.ndarray:
    """A 64-bit hash of the `length` bytes from each position; shorter by length - 1."""
    out = np.empty(len(data) - length + 1, np.uint64)
    for a in range(0, len(out), HASHED):
        out[a : a + HASHED] = doubled_hash(data[a : a + HASHED + length - 1], length)
    return out


def doubled_hash(data: np.ndarray, length: int) -> np.ndarray:
    h, n = data.astype(np.uint64) + np.uint64(1), len(data) - length + 1
    out, done = None, 0
    for bit in range(length.bit_length()):
        if length >> bit & 1:
            block = h[done : done + n]
            out = block.copy() if out is None else out * np.uint64(FACTORS[6]) + block
            done += 1 << bit
        if length >> (bit + 1):
            h = h[: -(1 << bit)] * np.uint64(FACTORS[bit]) + h[1 << bit :]
    return mixed(out)


def window_min(v: np.ndarray, width: int) -> np.ndarray:
    have = 1
    while have * 2 <= width:
        v = np.minimum(v[:-have], v[have:])
        have *= 2
    rest = width - have
    return np.minimum(v[: len(v) - rest], v[rest:]) if rest else v


class Part:
    """Up to about PART bytes of whole texts, or a piece of a long one that overlaps the next by depth - 1 bytes.

    The window of `depth` bytes from each position starts its sort at its anchor, the `first` bytes in it with the
    least hash (the leftmost of equals): equal windows have equal anchors in equal places, and all windows from `low`
    to `high` share the anchor at `at`. So the first digit is looked up once a run and not once a window.
    """

    def __init__(self, pieces: list[tuple[int, int, bytes]], depth: int):
        """pieces: (text's number in the chunk, offset in the text, bytes)."""
        self.depth, self.first = depth, (depth + 1) // 2 - 1
        self.pieces = [(number, offset, len(data)) for number, offset, data in pieces]
        lengths = np.array([len(p[2]) for p in pieces], np.int64)
        self.starts = np.concatenate([[0], np.cumsum(lengths)])
        self.data = np.frombuffer(b"".join(p[2] for p in pieces), np.uint8)
        self.at = self.low = self.high = np.zeros(0, np.int32)
        self.key = np.zeros(0, np.uint64)
        if len(self.data) >= depth:
            h = gram_hash(self.data, self.first)
            place = np.uint64((1 << PLACE_BITS) - 1)
            v = (h & ~place) | np.arange(len(h), dtype=np.uint64)
            anchor = (window_min(v, depth - self.first + 1) & place).astype(np.int64)
            whole = np.zeros(len(anchor), bool)
            for a, b in zip(self.starts[:-1], self.starts[1:]):
                whole[a : max(a, b - depth + 1)] = True
            start = np.flatnonzero(whole)
            if len(start):
                anchor = anchor[start]
                cut = np.flatnonzero((np.diff(anchor) != 0) | (np.diff(start) != 1)) + 1
                begin, end = np.concatenate([[0], cut]), np.concatenate([cut, [len(start)]]) - 1
                self.at, self.low, self.high = (x.astype(np.int32) for x in (anchor[begin], start[begin], start[end]))
                self.key = mixed(h[self.at])  # mixed again: anchors have small hashes, and owners are to be alike
        self.text = np.array([p[0] for p in pieces], np.int32)[np.searchsorted(self.starts, self.low, "right") - 1]

    @property
    def digit(self):
        return self.key >> np.uint64(64 - BITS)

    def digits(self):
        """Sorted distinct first digits, and each run's number in that list."""
        return np.unique(self.digit, return_inverse=True)

    def distinct(self):
        """Sorted distinct first digits, which of them are in several texts, and which in runs that differ in their ends."""
        values, inverse = self.digits()
        least, most = np.full(len(values), NO_ID), np.full(len(values), -1)
        np.minimum.at(least, inverse, self.text)
        np.maximum.at(most, inverse, self.text)
        context = (self.at - self.low + 256 * (self.high - self.low)).astype(np.int64)
        if len(values):
            context += 65_536 * (self.data[self.low] + 256 * self.data[self.high + self.depth - 1].astype(np.int64))
        one, other = np.full(len(values), NO_ID), np.full(len(values), -1)
        np.minimum.at(one, inverse, context)
        np.maximum.at(other, inverse, context)
        return values, least != most, one != other

    def around(self):
        """A function of (low, high, at) of records: records × (reach + depth), the record's bytes with the anchor in the
        place `reach`, and zeros beside them."""
        reach = self.depth - self.first
        width = reach + self.depth
        padded = np.concatenate([np.zeros(reach, np.uint8), self.data, np.zeros(self.depth, np.uint8)])
        views, column = np.lib.stride_tricks.sliding_window_view(padded, width), np.arange(width, dtype=np.uint8)

        def cut(low, high, at):
            begin = (reach - (at - low)).astype(np.uint8)[:, None]
            end = (reach - (at - high) + self.depth).astype(np.uint8)[:, None]
            return views[at] * ((column >= begin) & (column < end))

        return cut

    def records(self, repeated: np.ndarray, hot: np.ndarray):
        """Runs whose first digit is repeated; where it is hot, single windows instead, to be dealt by their own hash.

        Arrays key (the hash whose top bits are the digit), low, high, at, text, and 'same', a hash of all bytes of the
        run and the anchor's place in it.
        """
        run, single = np.flatnonzero(repeated & ~hot), np.flatnonzero(repeated & hot)
        count = self.high[single] - self.low[single] + 1
        low1 = np.repeat(self.low[single], count) + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
        low, high = np.concatenate([self.low[run], low1]), np.concatenate([self.high[run], low1])
        at = np.concatenate([self.at[run], low1])
        text = np.concatenate([self.text[run], np.repeat(self.text[single], count)])
        if not len(low):
            return np.zeros(0, np.uint64), low, high, at, text, np.zeros(0, np.uint64)
        window = gram_hash(self.data, self.depth)
        key = np.concatenate([self.key[run], window[low1]])
        same = (window[low] * np.uint64(FACTORS[0]) + window[high] * np.uint64(FACTORS[1])
                + ((high - low) * 64 + (at - low)).astype(np.uint64) * np.uint64(FACTORS[2]))
        return key, low, high, at, text, mixed(same ^ key)


def parts_of(rows: list[tuple], depth: int):
    """(Part, ids of its texts by number, …) of a chunk of (doc_id, text) rows."""
    pieces, size = [], 0
    for number, (_, text) in enumerate(rows):
        data = text.encode("utf-8")
        for offset in range(0, max(1, len(data) - depth + 1), PART):
            piece = data[offset : offset + PART + depth - 1]
            pieces.append((number, offset, piece))
            size += len(piece)
            if size >= PART:
                yield Part(pieces, depth)
                pieces, size = [], 0
    if pieces:
        yield Part(pieces, depth)


def ids_of(rows: list[tuple]) -> np.ndarray:
    return np.array([NO_ID if r[0] is None else r[0] for r in rows], np.int64)


def batches(items, most: int):
    """Lists of the items of (bytes, item), cut as soon as a list has `most` bytes."""
    held, size = [], 0
    for n, item in items:
        held.append(item)
        size += n
        if size >= most:
            yield held
            held, size = [], 0
    if held:
        yield held


def together(found):
    """Of several parts' distinct(): sorted distinct first digits, which are in several texts of a part, in how many
    parts each is, and in how many it is in runs that differ in their ends."""
    values, inverse = np.unique(np.concatenate([f[0] for f in found]), return_inverse=True)
    several, unlike = (inverse[np.concatenate([f[k] for f in found])] for k in (1, 2))
    marked = np.zeros(len(values), bool)
    marked[several] = True
    return values, marked, np.bincount(inverse, minlength=len(values)), np.bincount(unlike, minlength=len(values))


def owners_of(key: np.ndarray, owner_bits: int) -> np.ndarray:
    return (key >> np.uint64(64 - owner_bits)).astype(np.int64)


def dealt(key, same, owner_bits):
    """Of a part's records: the first of each distinct one, each record's number among these, their owners, and the
    order in which they are sent: by owner, then by place."""
    _, first, inverse = np.unique(same, return_index=True, return_inverse=True)
    owner = owners_of(key[first], owner_bits)
    return first, inverse, owner, np.lexsort((first, owner))


def beside(off, length, depth):
    """Records × (2 × reach), which of the `reach` bytes before and after the anchor are in the record."""
    first = (depth + 1) // 2 - 1
    column = np.arange(depth - first)
    off, after = off.astype(np.int64)[:, None], (length.astype(np.int64) - off - first)[:, None]
    return np.concatenate([column >= depth - first - off, column < after], axis=1)


def written(key, off, length, ids, content, depth, owner_bits):
    """Records of one owner as bytes: their keys without the bytes that the owner's number gives, places and lengths,
    ids, and the bytes beside the anchors, whose own bytes the key stands for."""
    keys = key.astype("<u8").view(np.uint8).reshape(-1, 8)[:, : 8 - owner_bits // 8]
    return keys.tobytes(), squeezed(np.stack([off, length])), packed(ids), squeezed(content[beside(off, length, depth)])


def read(message, n, owner, depth, owner_bits):
    """key, off, length, ids and content of n records."""
    keys, places, ids, content = message
    codec, width = pa.Codec("zstd"), 8 - owner_bits // 8
    key = np.zeros((n, 8), np.uint8)
    key[:, :width] = np.frombuffer(keys, np.uint8).reshape(n, width)
    key = key.view("<u8").reshape(-1) | np.uint64(owner << (64 - owner_bits))
    off, length = np.frombuffer(codec.decompress(places, 2 * n), np.uint8).reshape(2, n)
    has = beside(off, length, depth)
    out = np.zeros(has.shape, np.uint8)
    out[has] = np.frombuffer(codec.decompress(content, int(np.count_nonzero(has))), np.uint8)
    return key, off, length, unpacked(ids, n), out


def least_ids(digit, off, length, ids, content, depth):
    """For each place of the anchor in a window and each record, the least id of all records with that window.

    Records have the anchor at `off` of `length` bytes, and these in `content` as Part.around gives them. Windows are
    compared digit by digit: first the anchor's, then the 64-bit hash of all their bytes. Returns (places, records) of
    ids, NO_ID where there is no window.
    """
    reach, n = depth - ((depth + 1) // 2 - 1), len(digit)
    width = reach + depth
    factor = mixed(np.arange(1, width + 1, dtype=np.uint64) * np.uint64(FACTORS[3])) | np.uint64(1)
    grid = np.zeros((width + 1, n), np.uint64)
    np.add(content.T, np.uint64(1), out=grid[1:])
    grid[1:] *= factor[:, None]
    np.cumsum(grid, axis=0, out=grid)
    seed = digit * np.uint64(FACTORS[4])
    out = np.full((reach + 1, n), NO_ID)
    for o in range(reach + 1):
        has = np.flatnonzero((off >= o) & (o >= off + depth - length))
        if not len(has):
            continue
        key = mixed(mixed((grid[reach - o + depth] - grid[reach - o])[has]) + seed[has])
        order = np.argsort(key)
        key, order = key[order], has[order]
        borders = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        least = np.minimum.reduceat(ids[order], borders)
        out[o, order] = np.repeat(least, np.diff(np.append(borders, len(order))))
    return out


def compare(messages, depth: int, owner_bits: int):
    """The second pass of an owner: ((partition, row), (batch, owner, number of spans, parts, numbers of the part's
    records of this owner, places from and to, ids)) for windows that a smaller id than the record's own also has."""
    got = list(messages)
    if not got:
        return
    sizes = np.array([m[4] for _, m in got])
    starts = np.concatenate([[0], np.cumsum(sizes)])
    reach, first = depth - ((depth + 1) // 2 - 1), (depth + 1) // 2 - 1
    digit, off, length, ids, content = (
        np.empty((starts[-1], *shape), kind)
        for kind, shape in ((np.uint64, ()), (np.uint8, ()), (np.uint8, ()), (np.int64, ()), (np.uint8, (2 * reach,))))
    for (owner, m), a, b in zip(got, starts[:-1], starts[1:]):
        digit[a:b], off[a:b], length[a:b], ids[a:b], content[a:b] = read(m[5:], m[4], owner, depth, owner_bits)
    got = [(owner, m[:4]) for owner, m in got]
    order = np.argsort(digit)
    borders = np.flatnonzero(np.concatenate([[True], np.diff(digit[order]) != 0]))
    sizes = np.diff(np.append(borders, len(order)))
    order = order[np.repeat(sizes, sizes) > 1]
    found = []
    for some in whole_groups(order, digit, COMPARED):
        whole = np.zeros((len(some), reach + depth), np.uint8)
        whole[:, :reach], whole[:, reach + first :] = content[some, :reach], content[some, reach:]
        least = least_ids(digit[some], off[some].astype(np.int64), length[some].astype(np.int64), ids[some], whole, depth)
        some_better = np.flatnonzero((least < ids[some]).any(0))
        if not len(some_better):
            continue
        some, least = some[some_better], np.ascontiguousarray(least[:, some_better].T)
        rows, places = np.nonzero(least < ids[some][:, None])
        values = least[rows, places]
        new = np.flatnonzero(np.concatenate([[True], (np.diff(rows) != 0) | (np.diff(places) != 1) | (np.diff(values) != 0)]))
        last = np.concatenate([new[1:], [len(rows)]]) - 1
        found.append((some[rows[new]], places[new], places[last], values[new]))
    if not found:
        return
    record, low, high, value = (np.concatenate(x) for x in zip(*found))
    by = np.lexsort((low, record))
    record, low, high, value = record[by], low[by], high[by], value[by]
    borders = np.searchsorted(record, starts)
    for (owner, ((part, row, batch), sub, n, counts)), start, a, b in zip(got, starts, borders[:-1], borders[1:]):
        if a == b:
            continue
        parts = np.concatenate([[0], np.cumsum(unpacked(counts, n))])
        number = record[a:b] - start
        which = np.searchsorted(parts, number, "right") - 1
        yield (part, row), (batch, owner, int(b - a), packed(which + sub), packed(number - parts[which]),
                            squeezed(np.stack([low[a:b], high[a:b]]).astype(np.uint8)), packed(value[a:b]))


def whole_groups(order, digit, most):
    """Slices of about `most` records that do not cut a group of equal digits."""
    a = 0
    while a < len(order):
        b = min(len(order), a + most)
        while b < len(order) and digit[order[b]] == digit[order[b - 1]]:
            b += 1
        yield order[a:b]
        a = b


def suffix_dedup(docs: DataFrame, depth: int = 50, hot: tuple[int, int] = HOT, per_owner: int = PER_OWNER,
                 chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept_sha256 of every whole text, as UTF-8.

    Removed is each byte covered by a string of `depth` bytes that starts in a document of a smaller doc_id too. The
    passes: the first digit of all windows, Golomb-coded, finds which are repeated; the bytes of repeated runs, one copy
    a part, without the anchors, which their hashes stand for, go to the owner of their digit, who sorts the windows by the rest of their bytes; the ids come back to the
    rows, where the covered bytes are cut. A digit that is in unlike runs in hot[0] parts, or is in hot[1] parts, is
    dealt by whole windows, so no owner has all contexts of a common passage. Windows are compared by a
    64-bit hash that joins the anchor's 64-bit hash and all other bytes. Messages to owners are made of about `chunk_bytes`
    of text, so that they stay large, and what is added to them small, when there are many owners. `depth` is 8 to 120, as records keep places in a byte. Texts are
    read three times and never shuffled. Null text: empty. Null doc_id: larger than any, and equal ids remove nothing from each other. Texts
    shorter than `depth` keep all. Repeated rows stay, a row each. Empty table: no rows. Other columns are not read.
    """
    if not 8 <= depth <= 120:
        raise ValueError("depth must be 8 to 120")
    spark = docs.sparkSession
    texts = id_and_text(docs)
    total = texts.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    home = Homes(texts.select("doc_id", "text"), lambda r: len(r[1]), chunk_bytes, 16 * CHUNK_ROWS)
    owners = 1 << max(1, int(total // (depth // 4) // per_owner).bit_length())
    owner_bits = owners.bit_length() - 1

    def send(part, row, rows):
        found = ((len(p.data), p.distinct()) for p in parts_of(rows, depth))
        for number, batch in enumerate(batches(found, chunk_bytes)):
            values, several, *met = together(batch)
            yield from to_owners(values, several, (part, row, number), BITS, owner_bits, met)

    def with_answers(rows, answers):
        """The number of each batch, and (part's number in the chunk, Part, its records) one by one."""
        by_batch: dict[int, list] = {}
        for answer in answers:
            by_batch.setdefault(answer[0], []).append(answer[1:])
        sub = 0
        for number, batch in enumerate(batches(((len(p.data), p) for p in parts_of(rows, depth)), chunk_bytes)):
            values, inverse = np.unique(np.concatenate([p.digit for p in batch]), return_inverse=True)
            own = by_batch.pop(number, [])
            bits = [answered(values, own, BITS, owner_bits, k)[inverse] for k in (3, 4)]
            del values, inverse

            def settled(sub=sub, bits=bits):
                at = 0
                batch.reverse()
                while batch:
                    p = batch.pop()
                    yield sub, p, p.records(*(b[at : at + len(p.key)] for b in bits))
                    sub, at = sub + 1, at + len(p.key)

            n = len(batch)
            yield number, settled()
            sub += n

    def second(part, row, rows, answers):
        ids = ids_of(rows)

        def sent(number, held):
            sub, n = held[0][0], len(held)
            counts = [len(h[1]) for h in held]
            owner, key, off, length, least, content = (np.concatenate([h[k] for h in held]) for k in range(1, 7))
            parts = np.repeat(np.arange(n), counts)
            held.clear()
            order = np.argsort(owner, kind="stable")
            borders = np.flatnonzero(np.diff(owner[order], prepend=-1))
            for a, b in zip(borders, [*borders[1:], len(order)]):
                some = order[a:b]
                yield int(owner[some[0]]), ((part, row, number), sub, n, packed(np.bincount(parts[some], minlength=n)), len(some), *written(
                    key[some], off[some], length[some], least[some], content[some], depth, owner_bits))

        for number, settled in with_answers(rows, answers):
            held, size = [], 0
            for sub, p, (key, low, high, at, text, same) in settled:
                first, inverse, owner, order = dealt(key, same, owner_bits)
                least = np.full(len(first), NO_ID)
                np.minimum.at(least, inverse, ids[text])
                f, content, reach = first[order], p.around(), depth - p.first
                whole = content(low[f], high[f], at[f])
                held.append((sub, owner[order], key[f], (at - low)[f].astype(np.uint8), (high[f] - low[f] + depth).astype(np.uint8),
                             least[order], np.concatenate([whole[:, :reach], whole[:, reach + p.first :]], axis=1)))
                size += len(f)
                if size >= RECORDS:
                    yield from sent(number, held)
                    size = 0
            if size:
                yield from sent(number, held)

    def spans_of(answers, number):
        """By part: owners, numbers of the part's records of this owner, places from and to, ids, of a batch's answers."""
        own = [a for a in answers if a[0] == number]
        if not own:
            return {}
        codec = pa.Codec("zstd")
        owner = np.repeat([a[1] for a in own], [a[2] for a in own])
        sub, record, value = (np.concatenate([unpacked(a[k], a[2]) for a in own]) for k in (3, 4, 6))
        low, high = (np.concatenate([np.frombuffer(codec.decompress(a[5], 2 * a[2]), np.uint8)[k * a[2] : (k + 1) * a[2]] for a in own]).astype(
            np.int64) for k in (0, 1))
        order = np.argsort(sub, kind="stable")
        subs, borders = np.unique(sub[order], return_index=True)
        return {int(s): tuple(x[order[a:b]] for x in (owner, record, low, high, value))
                for s, a, b in zip(subs, borders, [*borders[1:], len(order)])}

    def last(part, row, rows, answers):
        ids = ids_of(rows)
        firsts, seconds = [a[1] for a in answers if a[0] == 1], [a[1] for a in answers if a[0] == 2]
        masks = {}
        for sub, p, (key, low, high, at, text, same), spans in (
                (sub, p, records, spans.get(sub)) for number, settled in with_answers(rows, firsts)
                for spans in [spans_of(seconds, number)] for sub, p, records in settled):
            first, inverse, owner, order = dealt(key, same, owner_bits)
            least = np.full(len(first), NO_ID)
            np.minimum.at(least, inverse, ids[text])
            reach = depth - p.first
            grid = np.tile(least, (reach + 1, 1))
            if spans:
                owners_own, record, a, b, value = spans
                record = order[np.searchsorted(owner[order], owners_own) + record]
                n = b - a + 1
                column = np.repeat(a, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                grid[column, np.repeat(record, n)] = np.repeat(value, n)
            own = ids[text]
            some = np.flatnonzero(grid.min(0)[inverse] < own)
            low, high, at, own, inverse = low[some], high[some], at[some], own[some], inverse[some]
            starts = np.zeros(len(p.data) + depth, bool)  # of windows to be removed, after `depth` places
            for o in range(reach + 1):
                begin = at - o
                starts[depth + begin[(begin >= low) & (begin <= high) & (grid[o, inverse] < own)]] = True
            begun = np.cumsum(starts)
            removed = begun[depth:] > begun[: len(p.data)]
            for (number, offset, size), a in zip(p.pieces, p.starts):
                mask = masks.get(number)
                if mask is None:
                    mask = masks[number] = np.zeros(len(rows[number][1].encode("utf-8")), bool)
                mask[offset : offset + size] |= removed[a : a + size]
        for number, (doc_id, text) in enumerate(rows):
            data, mask = text.encode("utf-8"), masks[number]
            kept = np.frombuffer(data, np.uint8)[~mask].tobytes()
            spans = int(np.count_nonzero(np.diff(mask.astype(np.int8), prepend=0) == 1))
            yield doc_id, len(data), len(data) - len(kept), spans, hashlib.sha256(kept).hexdigest()

    def coded(kind):
        def run(answers):
            for (part, at), value in answers:
                yield part, at, kind, pickle.dumps(value, 5)

        return run

    def answers_of(df, with_kind):
        def decoded(r):
            value = pickle.loads(bytes(r[3]))
            return (r[0], r[1]), value if r[1] == COUNT or not with_kind else (r[2], value)

        return df.rdd.map(decoded)

    def by_sub(answers):
        for (part, at), value in answers:
            yield (part, at), value if at == COUNT else (value[1][2], value[0], value[1], *value[2:])

    first = found_twice(home.send(send, owners), owners, BITS, hot).mapPartitions(by_sub)
    first = stored(spark.createDataFrame(first.mapPartitions(coded(1)), ANSWERS, verifySchema=False), "first-digits")
    runs = modest(home.receive(answers_of(first, False), second)).partitionBy(owners, lambda owner: owner)
    found = runs.mapPartitions(task(lambda got: compare(got, depth, owner_bits)))
    found = stored(spark.createDataFrame(found.mapPartitions(coded(2)), ANSWERS, verifySchema=False), "shared-windows")
    settled = home.receive(answers_of(first.unionAll(found), True), last)
    return spark.createDataFrame(settled, OUT, verifySchema=False)
