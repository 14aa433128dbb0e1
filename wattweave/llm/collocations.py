"""Phrase collocations from count streams in prefix and suffix order."""

from __future__ import annotations

import functools
import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wattweave.llm.common import stored

LOWER = ("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
BREAKS = b".,;:!?\n\x0b\x0c\r"
LONGEST = 5
LEAST = 100
TOP = 2_000
CHUNK_BYTES = 12_000_000
FILTER_BITS = 1 << 24
STREAM_ROWS = 500_000
COUNTS = "lang string, phrase string, n long"

#: Odd multipliers without structure.
MIX, STEP = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)

#: Class of each byte: 0 between words, 1 in a word, 2 between pieces; and the byte in lower case.
CLASSES = np.ones(256, np.uint8)
CLASSES[list(b" \t")] = 0
CLASSES[list(BREAKS)] = 2
LOWERED = np.arange(256, dtype=np.uint8)
LOWERED[65:91] += 32


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * MIX
    return h ^ (h >> np.uint64(29))


def bytes_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of an array of large strings without nulls, and where each string begins and ends."""
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = texts.buffers()[2]
    flat = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None and len(data) else np.zeros(0, np.uint8)
    return flat, offsets - offsets[0]


@functools.lru_cache(maxsize=4_096)
def hash_of_lang(lang: str) -> int:
    return int.from_bytes(hashlib.blake2b(lang.encode(), digest_size=8).digest(), "little")


class Tokens:
    """The words of some texts as numbers of a dictionary, and which neighbours are in one piece of one text."""

    def __init__(self, langs: pa.Array, texts: pa.Array):
        data, begin = bytes_of(texts.cast(pa.large_string()))
        kind = CLASSES[data]
        word = kind == 1
        first = word.copy()
        first[1:] &= ~word[:-1]
        starts_text = begin[:-1][begin[:-1] < len(data)]
        first[starts_text] = word[starts_text]
        border = (kind == 2).astype(np.int32)
        np.add.at(border, starts_text, 1)
        at = np.flatnonzero(first)
        piece = np.cumsum(border)[at]
        self.size = len(at)
        self.joined = piece[1:] == piece[:-1]
        offsets = np.append(np.flatnonzero(first[word]), np.count_nonzero(word)).astype(np.int64)
        words = pa.LargeStringArray.from_buffers(self.size, pa.py_buffer(offsets.tobytes()), pa.py_buffer(LOWERED[data[word]].tobytes()))
        coded = words.dictionary_encode()
        self.words, self.ids = coded.dictionary, coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        coded = langs.dictionary_encode()
        self.langs = coded.dictionary
        per_text = np.diff(np.searchsorted(at, begin))
        self.lang = np.repeat(coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), per_text)
        self.text = np.repeat(np.arange(len(per_text)), per_text)

    def hashes(self, order: int) -> tuple[np.ndarray, np.ndarray]:
        """A 64-bit hash of the lang and the `order` words from each place, and whether they are in one piece."""
        data, begin = bytes_of(self.words)
        if not self.size:
            return np.zeros(0, np.uint64), np.zeros(0, bool)
        place = np.arange(len(data)) - np.repeat(begin[:-1], np.diff(begin))
        of_word = mixed(np.add.reduceat((data.astype(np.uint64) + np.uint64(1)) * (mixed(place.astype(np.uint64) + np.uint64(7)) | np.uint64(1)), begin[:-1]))
        of_lang = np.array([hash_of_lang(x) for x in self.langs.to_pylist()], np.uint64)
        each = of_word[self.ids]
        out, whole = mixed(each + of_lang[self.lang]), np.ones(self.size, bool)
        for m in range(1, order):
            out = mixed(out[:-1] * STEP + each[m:])
            whole = whole[:-1] & self.joined[m - 1 :]
        return out, whole

    def counts(self, order: int, may_be: np.ndarray | None) -> pa.RecordBatch:
        """lang, phrase and number of the distinct phrases of `order` words whose parts of one word less may be frequent
        by the filter. Phrases are told apart by their words; the hash only brings them together."""
        if order == 1:
            key = self.lang * len(self.words) + self.ids
            found, first, n = np.unique(key, return_index=True, return_counts=True)
            return self.batch(first, 1, n)
        h, whole = self.hashes(order - 1)
        fine = whole & (np.unpackbits(may_be, bitorder="little")[(h % np.uint64(FILTER_BITS)).astype(np.int64)] == 1)
        place = np.flatnonzero(fine[:-1] & fine[1:] & self.joined[order - 2 :] if order > 2 else fine[:-1] & fine[1:] & self.joined)
        if not len(place):
            return self.batch(place, order, place)
        key, _ = self.hashes(order)
        key = key[place]
        by = np.argsort(key, kind="stable")
        place, key = place[by], key[by]
        new = np.concatenate([[True], key[1:] != key[:-1]])
        alike = ~new
        for m in range(order):
            alike[1:] &= self.ids[place[1:] + m] == self.ids[place[:-1] + m]
        alike[1:] &= self.lang[place[1:]] == self.lang[place[:-1]]
        if not np.array_equal(alike, ~new):  # two phrases with one hash in this chunk: sort by the words themselves
            by = np.lexsort([*[self.ids[place + m] for m in range(order)], self.lang[place]])
            place = place[by]
            new = np.concatenate([[True], np.any([self.ids[place[1:] + m] != self.ids[place[:-1] + m] for m in range(order)]
                                                 + [self.lang[place[1:]] != self.lang[place[:-1]]], axis=0)])
        begin = np.flatnonzero(new)
        return self.batch(place[begin], order, np.diff(np.append(begin, len(place))))

    def batch(self, place: np.ndarray, order: int, n: np.ndarray) -> pa.RecordBatch:
        words = [self.words.take(pa.array(self.ids[place + m])) for m in range(order)]
        phrase = pc.binary_join_element_wise(*words, pa.scalar(" ", pa.large_string())) if order > 1 else words[0]
        return pa.RecordBatch.from_arrays([self.langs.take(pa.array(self.lang[place])).cast(pa.string()), phrase.cast(pa.string()),
                                           pa.array(n, pa.int64())], names=["lang", "phrase", "n"])


def chunked(batches, columns: tuple[str, ...], most: int):
    """Arrays of the columns for runs of rows with about so many bytes of the last column; no text is cut."""
    held, size = [], 0
    for b in batches:
        whole = b.column(columns[-1]).cast(pa.large_string())
        _, ends = bytes_of(whole)
        a = 0
        while a < b.num_rows:
            z = max(a + 1, int(np.searchsorted(ends, ends[a] + most - size, "right")) - 1)
            held.append([*[b.column(c).slice(a, z - a) for c in columns[:-1]], whole.slice(a, z - a)])
            size += int(ends[z] - ends[a])
            a = z
            if size >= most:
                yield [pa.concat_arrays(x) for x in zip(*held)]
                held, size = [], 0
    if held:
        yield [pa.concat_arrays(x) for x in zip(*held)]


def count_phrases(texts: DataFrame, order: int, may_be: bytes | None, chunk_bytes: int) -> DataFrame:
    """lang, phrase, n of all phrases of `order` words in (lang, text) whose shorter parts pass the filter. A chunk
    sends each of its phrases once, a task's chunks are added up before the shuffle."""

    def run(batches):
        bits = None if may_be is None else np.frombuffer(may_be, np.uint8)
        for langs, part in chunked(batches, ("lang", "text"), chunk_bytes):
            counted = Tokens(langs, part).counts(order, bits)
            for a in range(0, counted.num_rows, 50_000):
                yield counted.slice(a, 50_000)

    return texts.mapInArrow(run, COUNTS).groupBy("lang", "phrase").agg(F.sum("n").alias("n"))


def phrase_filter(frequent: DataFrame, order: int) -> bytes:
    """A bitmap of FILTER_BITS bits with those of the frequent phrases set. Its size does not grow with the data; a phrase
    that is let through wrongly is only counted in vain."""

    def run(batches):
        for langs, phrases in chunked(batches, ("lang", "phrase"), CHUNK_BYTES):
            t = Tokens(langs, phrases)
            h, _ = t.hashes(order)
            at = np.searchsorted(t.text, np.arange(len(phrases)))
            yield pa.RecordBatch.from_arrays([pa.array((h[at] % np.uint64(FILTER_BITS)).astype(np.int64) + 1)], names=["bit"])

    bits = frequent.select("lang", "phrase").mapInArrow(run, "bit long")
    slices = bits.groupBy(F.bitmap_bucket_number("bit").alias("slice")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("bit")).alias("bits"))
    out = bytearray(FILTER_BITS // 8)
    for r in slices.collect():
        out[(r["slice"] - 1) * 4_096 : r["slice"] * 4_096] = r["bits"]
    return bytes(out)


def frequent_phrases(texts: DataFrame, least: int = LEAST, longest: int = LONGEST, chunk_bytes: int = CHUNK_BYTES) -> tuple[DataFrame, DataFrame]:
    """(lang, phrase, words, n of every phrase of 1 to `longest` words that occurs `least` times or more; lang, total of
    all words), both stored. A phrase is as frequent as its parts at most, so each length looks only at places where both
    parts of one word less may be frequent, and infrequent phrases are never kept."""
    # infrequent words count in the totals alone: one row a lang stands for them, without a phrase
    words = count_phrases(texts, 1, None, chunk_bytes).groupBy("lang", F.when(F.col("n") >= least, F.col("phrase")).alias("phrase"))
    words = stored(words.agg(F.sum("n").alias("n")), "words")
    totals = stored(words.groupBy("lang").agg(F.sum("n").alias("total")), "totals")
    levels = [words.where("phrase is not null")]
    for order in range(2, longest + 1):
        may_be = phrase_filter(levels[-1], order - 1)
        if not any(may_be):
            break
        levels.append(stored(count_phrases(texts, order, may_be, chunk_bytes).where(F.col("n") >= least), "phrases"))
    phrases = functools.reduce(DataFrame.unionAll, levels)
    return phrases.withColumn("words", F.split("phrase", " ")), totals


def stream(phrases: DataFrame, order: Column, longest: int, rows: int) -> DataFrame:
    """A count stream: phrases sorted by the words of `order`, each with the counts of the phrases it begins with
    (`part`, by length) and the greatest count of one with one more word (`more`).

    Range partitions hold about `rows` phrases, wherever the borders fall. In that order a phrase stands behind all it
    begins with, so one pass that keeps the open ones, `longest` at most, joins all lengths in lockstep. What a partition
    has open from earlier ones is at most `longest` - 1 phrases: their counts and what it met of their extensions are
    exchanged by a table of that many rows a partition.
    """
    n = phrases.count()
    sorted_rows = phrases.select("lang", "phrase", "n", order.alias("key")).repartitionByRange(max(1, -(-n // rows)), "lang", "key")
    sorted_rows = sorted_rows.sortWithinPartitions("lang", "key")

    def lockstep(batches):
        out, path, lang = [], [], None  # path: the open phrases as [key, n, more, row or None]

        def close(depth):
            while len(path) > depth:
                key, count, more, row = path.pop()
                if row is None:
                    out.append((lang, None, None, key, None, more))
                else:
                    out.append((lang, row[0], count, key, row[1], more))

        def ready():
            columns = list(zip(*out)) or [[]] * 6
            out.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, TYPES)], names=STREAM_NAMES)

        for batch in batches:
            langs, phrase, counts, keys = (c.to_pylist() for c in batch.columns)
            for where, text, count, key in zip(langs, phrase, counts, keys):
                if where != lang:
                    close(0)
                    lang = where
                shared = 0
                while shared < len(path) and shared < len(key) - 1 and path[shared][0][-1] == key[shared]:
                    shared += 1
                close(shared)
                while len(path) < len(key) - 1:  # begun in an earlier partition
                    path.append([key[: len(path) + 1], None, 0, None])
                if path and path[-1][2] < count:
                    path[-1][2] = count
                path.append([key, count, 0, (text, [p[1] for p in path])])
                if len(out) > 20_000:
                    yield ready()
        close(0)
        yield ready()

    found = stored(sorted_rows.mapInArrow(lockstep, STREAM), "stream")
    abroad = found.where("phrase is null").groupBy("lang", "key").agg(F.max("more").alias("more_abroad"))
    abroad = stored(abroad, "borders")
    rows_of = found.where("phrase is not null")
    known = stored(rows_of.join(F.broadcast(abroad), ["lang", "key"]).select("lang", "key", "n", "more_abroad"), "border-counts")
    out = rows_of.join(F.broadcast(known.select("lang", "key", "more_abroad")), ["lang", "key"], "left").withColumn(
        "more", F.greatest("more", F.coalesce("more_abroad", F.lit(0))))
    for k in range(1, longest):
        side = F.broadcast(known.select("lang", F.col("key").alias("__key"), F.col("n").alias(f"p{k}")).where(F.size("__key") == k))
        out = out.join(side.withColumnRenamed("lang", "__lang"), (F.col("__lang") == F.col("lang")) & (F.slice("key", 1, k) == F.col("__key"))
                       & (F.size("key") > k) & F.get("part", F.lit(k - 1)).isNull(), "left").drop("__lang", "__key")
    part = F.array(*[F.coalesce(F.get("part", F.lit(k - 1)), F.col(f"p{k}")) for k in range(1, longest)])
    return out.select("lang", "phrase", F.size("key").alias("length"), "n", part.alias("part"), "more")


STREAM = "lang string, phrase string, n long, key array<string>, part array<long>, more long"
STREAM_NAMES = ["lang", "phrase", "n", "key", "part", "more"]
TYPES = [pa.string(), pa.string(), pa.int64(), pa.list_(pa.string()), pa.list_(pa.int64()), pa.int64()]


def scored_candidates(phrases: DataFrame, totals: DataFrame, longest: int = LONGEST, stream_rows: int = STREAM_ROWS) -> DataFrame:
    """lang, phrase, a, l, r, n, score and is_part of every phrase of two words or more.

    Left counts and right extensions come from the stream in prefix order, right counts and left extensions from the one
    in suffix order; the two meet in a sort-merge join. A phrase as frequent as one that holds it is as frequent as one
    with a single word more, so the extensions by one word tell whether it is only a part.
    """
    ahead = stream(phrases, F.col("words"), longest, stream_rows)
    back = stream(phrases, F.reverse("words"), longest, stream_rows)
    back = back.where("length > 1").select("lang", "phrase", F.col("part").alias("tail"), F.col("more").alias("before"))
    both = ahead.where("length > 1").join(back.hint("merge"), ["lang", "phrase"]).join(totals, "lang")

    def wide(c: Column) -> Column:
        return c.cast("decimal(16,0)")

    def cut(k: int) -> Column:
        left, right = F.element_at("part", k), F.element_at("tail", F.col("length") - k)
        score = F.call_function("div", wide(F.col("n")) * wide(F.col("total")) * F.lit(1000).cast("decimal(4,0)"), wide(left) * wide(right))
        return F.when(F.col("length") > k, F.struct(score.alias("score"), F.lit(k).alias("k"), left.alias("l"), right.alias("r")))

    best = F.array_min(F.filter(F.array(*[cut(k) for k in range(1, longest)]), lambda x: x.isNotNull()))
    return both.withColumn("best", best).select(
        "lang", "phrase", F.col("n").alias("a"), "best.l", "best.r", F.col("total").alias("n"), F.col("best.score").alias("score"),
        (F.greatest("more", "before") >= F.col("n")).alias("is_part"))


def collocations(docs: DataFrame, least: int = LEAST, longest: int = LONGEST, top: int = TOP, chunk_bytes: int = CHUNK_BYTES,
                 stream_rows: int = STREAM_ROWS) -> DataFrame:
    """lang, rank, phrase, a, l, r, n and score: the `top` best collocations of each lang.

    Texts are lower-cased in A-Z only, cut into pieces at punctuation and line ends, and those into words at spaces and
    tabs. a, l and r count all contiguous occurrences of the phrase and of the two parts of its lowest-scoring cut, n all
    words of the lang. Null lang: `und`, one with rows of that name. Null, empty and word-less texts add nothing. Repeated
    rows count each. Equal scores are ordered by a, then by the bytes of the phrase. Empty table: no rows. Other columns
    are not read.
    """
    texts = docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), F.coalesce("text", F.lit("")).alias("text"))
    phrases, totals = frequent_phrases(texts, least, longest, chunk_bytes)
    found = scored_candidates(phrases, totals, longest, stream_rows).where("not is_part")
    ranked = Window.partitionBy("lang").orderBy(F.col("score").desc(), F.col("a").desc(), F.col("phrase").asc())
    found = found.withColumn("rank", F.row_number().over(ranked)).where(F.col("rank") <= top)
    return found.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


ORACLE = rf"""
WITH p AS (
  SELECT coalesce(lang, 'und') AS lang,
         unnest(string_split_regex(translate(coalesce(text, ''), '{LOWER[0]}', '{LOWER[1]}'), '[.,;:!?\x0A-\x0D]')) AS piece
  FROM documents
), w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM p
), c AS (SELECT lang, sum(len(w)) AS n FROM w GROUP BY 1
), i AS (SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM w
), j AS (SELECT lang, w, i, unnest(range(1, 6)) AS m FROM i
), g AS (
  SELECT lang, m, array_to_string(w[i : i + m - 1], ' ') AS phrase, count(*) AS f FROM j WHERE i + m - 1 <= len(w)
  GROUP BY 1, 2, 3 HAVING count(*) >= 100
), x AS (
  SELECT lang, m, phrase, f, string_split(phrase, ' ') AS s, unnest(range(1, m)) AS k FROM g WHERE m > 1
), y AS (
  SELECT x.*, a.f AS l, b.f AS r, c.n,
         CAST((CAST(1000 AS HUGEINT) * x.f * c.n) // (CAST(a.f AS HUGEINT) * b.f) AS BIGINT) AS score
  FROM x JOIN g a ON a.lang = x.lang AND a.phrase = array_to_string(x.s[1 : k], ' ')
         JOIN g b ON b.lang = x.lang AND b.phrase = array_to_string(x.s[k + 1 :], ' ') JOIN c ON c.lang = x.lang
), z AS (SELECT *, row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) AS nth FROM y
), o AS (
  SELECT DISTINCT z.lang, z.phrase FROM z JOIN g ON g.lang = z.lang AND g.m > z.m AND 100 * g.f >= 100 * z.f
  AND contains(' ' || g.phrase || ' ', ' ' || z.phrase || ' ') WHERE z.nth = 1
), t AS (
  SELECT z.*, row_number() OVER (PARTITION BY z.lang ORDER BY z.score DESC, z.f DESC, z.phrase) AS rank
  FROM z ANTI JOIN o ON z.lang = o.lang AND z.phrase = o.phrase WHERE z.nth = 1
)
SELECT lang, CAST(rank AS INTEGER) AS rank, phrase, f AS a, l, r, CAST(n AS BIGINT) AS n, score FROM t WHERE rank <= 2000
"""
