"""The numbered operators against the libraries and brute force, on texts with every awkward case."""

import collections
import hashlib
import random
import re

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from wattweave.llm import chat_format, language_id, license_scan, mixing, quality_rules
from wattweave.llm.chosen_path import similar_texts
from wattweave.llm.common import Memo, join_counted
from wattweave.llm.exact_dedup import exact_groups
from wattweave.llm.graphs import components
from wattweave.llm.homes import rice_decode, rice_encode
from wattweave.llm.piece_codec import MergeVocabulary, encode_ids, piece_digests
from wattweave.llm.suffix_dedup import suffix_dedup
from wattweave.llm.token_counts import token_counts

NO_ID = 1 << 62
COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, digest string, kept string, size string, row string, place string"
MODEL = public_tokenizers.path("piece_bpe_32k.model")
BYTES = public_tokenizers.path("byte_bpe_50k.json")
ODD = [None, "", " ", "\n\n a", "\n", "▁▁x▁", " " * 70 + "q", "\x00\x1c \x1fa\x85 b\xa0 c　 \x0b d", "<|endoftext|> a <|endoftext|>",
       "  <|endoftext|>\n", "é́ 中힣😀", "don't  we'll\t\tx", "x" * 6_000, "ab " * 4_000, "#*$ <x> | a", "...", "a\r\nb"]


def hexed(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(3)
    vocabulary = [f"w{i}" for i in range(200)]
    base = [[rng.choice(vocabulary) for _ in range(rng.randrange(6, 120))] for _ in range(15)]
    out = [(i, t) for i, t in enumerate(ODD)]
    for i in range(200):
        b = list(rng.choice(base))
        for _ in range(rng.choice([0, 0, 1, 1, 2, 4])):
            b[rng.randrange(len(b))] = rng.choice(vocabulary)
        out.append((100 + i, rng.choice([" ", " ", "\n"]).join(b)))
    out += [(None, out[30][1]), (None, out[31][1]), (None, None), (500, out[40][1]), (500, out[40][1]), (501, " ".join(base[0])),
            (502, " " + "  ".join(base[0])), (-7, "a b"), (503, "a  b")]
    rng.shuffle(out)
    return out


def frame(spark, rows):
    rng = random.Random(5)
    full = [(i, t, rng.choice(["en", "de", None]), rng.choice(["s1", "s1", "s1", "s2", "é", None]), None, "d", "k", "s", "r", "p") for i, t in rows]
    return spark.createDataFrame(full, COLUMNS).repartition(4)


@pytest.fixture(scope="module")
def docs(spark, rows):
    df = frame(spark, rows).persist()
    df.count()
    return df


@pytest.fixture(scope="module")
def placed(docs):
    """(doc_id, text) in the order of the frame's partitions, which breaks the last ties."""
    return [(r.doc_id, r.text) for r in docs.collect()]


def sorted_rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


@pytest.mark.parametrize("run", [
    lambda d: token_counts(d, BYTES), suffix_dedup, similar_texts, language_id.identify, language_id.with_language,
    lambda d: piece_digests(d, MODEL), lambda d: encode_ids(d, MODEL), quality_rules.quality_rules, mixing.mix, mixing.mixed_documents,
    exact_groups, license_scan.document_licenses])
def test_empty_table(spark, run):
    assert run(frame(spark, [])).count() == 0


def test_token_counts_equal_the_library(docs, placed):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(BYTES)
    want = [(i, len((t or "").encode()), n := len(library.encode(t or "", add_special_tokens=False)), n > 512) for i, t in placed]
    assert sorted_rows(token_counts(docs, BYTES)) == sorted(want, key=repr)


def test_other_tokenizers_are_counted_too(spark, docs, placed):
    import sentencepiece
    from tokenizers import Tokenizer

    words, library = public_tokenizers.path("word_bpe_49k.json"), sentencepiece.SentencePieceProcessor(model_file=MODEL)
    other = Tokenizer.from_file(words)
    assert sorted(r.n_tokens for r in token_counts(docs, words).collect()) == sorted(
        len(other.encode(t or "", add_special_tokens=False)) for _, t in placed)
    assert sorted(r.n_tokens for r in token_counts(docs, MODEL).collect()) == sorted(len(library.encode(t or "")) for _, t in placed)


def test_a_warm_cache_is_used_and_only_grows_by_misses(spark, docs, tmp_path):
    cache = str(tmp_path / "cache")
    first = sorted_rows(token_counts(docs, BYTES, cache))
    size = spark.read.parquet(cache).count()
    assert size == docs.select(F.coalesce("text", F.lit(""))).distinct().count()
    assert sorted_rows(token_counts(docs, BYTES, cache)) == first and spark.read.parquet(cache).count() == size
    token_counts(docs.unionByName(docs.limit(1).withColumn("text", F.lit("a new one"))), BYTES, cache).count()
    assert spark.read.parquet(cache).count() == size + 1


def brute_removal(rows, depth=50):
    first = {}
    for i, t in rows:
        data, key = (t or "").encode(), NO_ID if i is None else i
        for p in range(len(data) - depth + 1):
            w = data[p : p + depth]
            first[w] = min(first.get(w, NO_ID), key)
    out = []
    for i, t in rows:
        data, key = (t or "").encode(), NO_ID if i is None else i
        mask = bytearray(len(data))
        for p in range(len(data) - depth + 1):
            if first[data[p : p + depth]] < key:
                mask[p : p + depth] = b"\1" * depth
        kept = bytes(x for x, m in zip(data, mask) if not m)
        spans = sum(1 for j in range(len(data)) if mask[j] and (j == 0 or not mask[j - 1]))
        out.append((i, len(data), len(data) - len(kept), spans, hexed(kept)))
    return sorted(out, key=repr)


@pytest.mark.parametrize("options", [{}, {"hot": (2, 4), "chunk_bytes": 3_000}, {"hot": (1, 1), "per_owner": 10, "chunk_bytes": 500}])
def test_suffix_dedup_equals_brute_force(docs, placed, options):
    assert sorted_rows(suffix_dedup(docs, **options)) == brute_removal(placed)


def test_records_lie_around_their_anchors_and_windows_meet():
    """Contents have one width, the anchor in one place; the least id of each window is that of a plain dictionary."""
    import numpy as np
    from wattweave.llm import suffix_dedup as module

    rng, depth = np.random.default_rng(5), 50
    common = bytes(rng.integers(97, 123, 90).astype(np.uint8))
    texts = [bytes(rng.integers(97, 123, 30 + 5 * i).astype(np.uint8)) + common + b"%d" % i for i in range(6)]
    part = module.Part([(i, 0, t) for i, t in enumerate(texts)], depth)
    reach = depth - part.first
    content = part.around()(part.low, part.high, part.at)
    off, length, ids = part.at - part.low, part.high - part.low + depth, 100 - part.text
    assert content.shape == (len(part.low), reach + depth)
    for row, low, o, n in zip(content, part.low, off, length):
        want = np.zeros(reach + depth, np.uint8)
        want[reach - o : reach - o + n] = part.data[low : low + n]
        assert row.tolist() == want.tolist()
    codec = module.pa.Codec("zstd")
    assert codec.decompress(module.squeezed(content), content.size).to_pybytes() == content.tobytes()
    got = module.least_ids(part.digit, off, length, ids, content, depth)
    windows = {(i, r): part.data[at - i : at - i + depth].tobytes() for r, at in enumerate(part.at) for i in range(reach + 1)
               if part.low[r] <= at - i <= part.high[r]}
    least = {}
    for (i, r), w in windows.items():
        least[w] = min(least.get(w, module.NO_ID), ids[r])
    assert len(least) < len(windows)
    for i, r in np.ndindex(got.shape):
        assert got[i, r] == (least[windows[i, r]] if (i, r) in windows else module.NO_ID)


def test_suffix_dedup_reads_long_texts_in_parts(spark, monkeypatch):
    rng = random.Random(9)
    long = "".join(rng.choice("abc ") for _ in range(30_000))
    rows = [(1, long[5_000:9_000]), (2, long), (3, "zz" + long[20_000:29_000] + "yy"), (4, "b" * 5_000), (5, "b" * 700)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    monkeypatch.setattr("wattweave.llm.suffix_dedup.PART", 1_000)
    assert sorted_rows(suffix_dedup(df)) == brute_removal(rows)


def test_suffix_dedup_messages_stay_small_and_alike_with_many_owners(spark, monkeypatch):
    """The bytes sent for repeated runs are about the same for 128 owners as for two, and no owner gets far more."""
    import pickle
    from wattweave.llm import suffix_dedup as module

    rng = random.Random(11)
    vocabulary = ["".join(rng.choice("etaoinshrdlu") for _ in range(rng.randint(2, 9))) for _ in range(3_000)]
    once = [" ".join(rng.choice(vocabulary) for _ in range(600)) for _ in range(150)]
    rows = [(i, t + (" x" if i % 2 else "")) for i, t in enumerate(once + once)]
    df = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    dealt = []
    monkeypatch.setattr(module, "modest", lambda rdd, f=module.modest: dealt.append(rdd) or f(rdd))
    results = [sorted_rows(module.suffix_dedup(df, per_owner=n)) for n in (10**9, 1_000)]
    assert results[0] == results[1] and sum(r[2] for r in results[0]) >= sum(len(t) for t in once)
    few, many = (dict(rdd.map(lambda m: (m[0], len(pickle.dumps(m, 5)))).reduceByKey(lambda a, b: a + b).collect()) for rdd in dealt)
    assert len(few) == 2 and len(many) == 128
    assert sum(many.values()) < 1.2 * sum(few.values())
    assert max(many.values()) < 2 * sum(many.values()) / 128


def test_integers_and_records_come_back_from_their_bytes():
    import numpy as np
    from wattweave.llm import homes, suffix_dedup as module

    for values in ([], [0, 0], [5, -7, module.NO_ID, 3, -2**62], list(range(300, 0, -1))):
        assert homes.unpacked(homes.packed(np.array(values, np.int64)), len(values)).tolist() == values
    rng, depth = np.random.default_rng(3), 50
    part = module.Part([(0, 0, bytes(rng.integers(0, 256, 3_000).astype(np.uint8))), (1, 0, b"a" * 60)], depth)
    whole = part.around()(part.low, part.high, part.at)
    reach = depth - part.first
    content = np.concatenate([whole[:, :reach], whole[:, reach + part.first :]], axis=1)
    off, length, ids = (part.at - part.low).astype(np.uint8), (part.high - part.low + depth).astype(np.uint8), part.text.astype(np.int64)
    for bits in (1, 8, 12):
        for owner in np.unique(module.owners_of(part.key, bits)).tolist():
            some = module.owners_of(part.key, bits) == owner
            sent = part.key[some], off[some], length[some], ids[some], content[some]
            message = module.written(*sent, depth, bits)
            assert all((a == b).all() for a, b in zip(sent, module.read(message, int(some.sum()), owner, depth, bits)))


def brute_similar(rows, least=0.8):
    sets = {}
    for k, (_, t) in enumerate(rows):
        w = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        sets[k] = frozenset(tuple(w[j : j + 5]) for j in range(max(1, len(w) - 4))) if w else ("none", k)
    classes = collections.defaultdict(list)
    for k, s in sets.items():
        classes[s].append(k)

    def order(k):
        return rows[k][0] is None, rows[k][0] or 0, k

    reps = {min(v, key=order): s for s, v in classes.items()}
    parent, links = {r: r for r in reps}, collections.Counter()

    def root(k):
        while parent[k] != k:
            k = parent[k]
        return k

    some = [(r, s) for r, s in reps.items() if isinstance(s, frozenset)]
    for x, (a, sa) in enumerate(some):
        for b, sb in some[:x]:
            if 5 * len(sa & sb) >= 4 * len(sa | sb):
                links[a] += 1
                links[b] += 1
                low, high = sorted((root(a), root(b)), key=order)
                parent[high] = low
    return sorted(((rows[k][0], rows[root(min(v, key=order))][0], rows[min(v, key=order)][0], links[min(v, key=order)])
                   for v in classes.values() for k in v), key=repr)


@pytest.mark.parametrize("options", [{}, {"limit": 6, "block": 5, "depth": 3}, {"limit": 6, "block": 5, "depth": 3, "dense": 2.0}])
def test_similar_texts_equal_brute_force(docs, placed, options):
    got = similar_texts(docs, **options).collect()
    assert sorted((tuple(r)[:4] for r in got), key=repr) == brute_similar(placed)
    none = [r for r in got if r.n_links == 0 and r.doc_id == r.class_id == r.copy_id]
    assert sum(r.kept for r in got) <= len({r.class_id for r in got}) + len(none)
    assert all(sum(r.kept for r in got if r.class_id == c) == 1 for c in {r.class_id for r in got if r.n_links})


def test_components_of_a_long_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 101), (103, 101)], "a long, b long")
    got = {r.node: r.root for r in components(edges).collect()}
    assert set(got) == set(range(61)) | {100, 101, 103}
    assert all(got[i] == 0 for i in range(61)) and got[103] == got[101] == got[100] == 100


def test_language_is_learned_from_the_other_rows(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = language_id.identify(docs).join(docs.select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in got if r.held_out]
    assert len(got) == docs.count() and all(0 <= r.score <= 1 for r in got)
    assert sum(r.lang == r.lang_pred for r in held) >= 0.98 * len(held)


def test_language_of_awkward_texts(spark, docs, placed):
    got = language_id.identify(docs).collect()
    assert len(got) == len(placed) and {r.lang_pred for r in got} <= {"en", "de", "und"}
    unlettered = sum(not t or not re.search(r"[^\W\d_]", t) for _, t in placed)
    assert sum(r.lang_pred == "und" and r.score == 0 for r in got) == unlettered
    nothing = language_id.identify(docs.withColumn("lang", F.lit(None).cast("string")))
    assert {r[0] for r in nothing.select("lang_pred").distinct().collect()} == {"und"}
    assert language_id.with_language(docs).columns == docs.columns


def test_kernel_ridge_separates_languages():
    x = language_id.presence(["the cat sat", "der Hund saß", "the dog ran", "die Katze lief"] * 5)
    model = language_id.fit(x, ["en", "de", "en", "de"] * 5, landmarks=4)
    assert model.score(["the cat ran", "der Hund lief"])[0] == ["en", "de"]
    assert (language_id.presence(["abc" * 9]) == language_id.presence(["abc" * 30])).all()


def test_language_of_held_out_texts_joined_to_a_million_characters(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    model = language_id.train(docs)
    held = docs.where("crc32(cast(cast(doc_id as string) as binary)) % 5 = 0 and lang is not null and text is not null")
    joined = collections.defaultdict(list)
    for r in held.orderBy("doc_id").select("lang", "text").collect():
        joined[r.lang].append(r.text)
    texts = {k: "\n".join(v) for k, v in joined.items()}
    whole = {k: t * (1 + 1_000_000 // len(t)) for k, t in texts.items()}
    short, _ = model.score([t[:8_000] for t in texts.values()])
    found, scores = model.score(list(whole.values()))
    assert short == found == list(whole) and min(len(t) for t in whole.values()) > 1_000_000
    assert scores.min() > 0.55


def test_windows_cover_the_text(monkeypatch):
    monkeypatch.setattr(language_id, "WINDOW", 10)
    for n in (0, 1, 9, 10, 11, 35, 100):
        text = "".join(chr(97 + i % 26) + str(i) for i in range(n))[:n]
        parts = language_id.windows(text)
        grams = {text[i : i + k] for k in language_id.ORDERS for i in range(len(text) - k + 1)}
        assert grams == {p[i : i + k] for p in parts for k in language_id.ORDERS for i in range(len(p) - k + 1)}
        assert max(map(len, parts)) <= 10 + 3


def test_presence_of_long_texts_is_whole(monkeypatch):
    text = "".join(random.Random(2).choice("abcdefgh ") for _ in range(5_000))
    whole = language_id.presence([text])
    monkeypatch.setattr(language_id, "RUN", 300)
    assert (language_id.presence([text]) == whole).all()


def test_pieces_equal_the_library(docs, placed):
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    want = []
    for i, t in placed:
        ids = library.encode(t or "")
        want.append((i, len(ids), hexed(",".join(map(str, ids)).encode()), hexed(library.decode(ids).encode())))
    assert sorted_rows(piece_digests(docs, MODEL)) == sorted(want, key=repr)
    got = sorted_rows(encode_ids(docs, MODEL))
    assert got == sorted(((i, ids := library.encode(t or ""), library.decode(ids)) for i, t in placed), key=repr)


def test_both_agendas_give_the_library_pieces():
    v, rng = MergeVocabulary(MODEL), random.Random(1)
    for _ in range(500):
        chunk = "▁" * rng.randrange(3) + "".join(rng.choice("theingonré中") for _ in range(rng.randrange(1, 60)))
        assert v.merge_long(chunk) == v.merge_short(chunk)
        assert v.encode(chunk.replace("▁", " ")) == v.library.encode(chunk.replace("▁", " "))


def test_quality_counts_equal_brute_force(docs, placed):
    want = []
    for i, t in placed:
        t = t or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        seen = collections.Counter(tuple(w[k : k + 3]) for k in range(len(w) - 2))
        repeat = {k + d for k in range(len(w) - 2) if seen[tuple(w[k : k + 3])] > 1 for d in range(3)}
        lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        base = len(w) < 50 or 100 * len(repeat) > 50 * len(w)
        want.append((i, len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(repeat), base))
    got = sorted_rows(quality_rules.quality_rules(docs))
    assert [r[:7] for r in got] == sorted(want, key=repr) and not any(r[6] and r[7] for r in got)


def test_the_order_of_rules_changes_no_verdict(docs, monkeypatch):
    one = sorted_rows(quality_rules.quality_rules(docs))
    monkeypatch.setattr(quality_rules, "order", lambda e: sorted(e, reverse=True))
    assert sorted_rows(quality_rules.quality_rules(docs)) == one


def test_rules_are_ordered_by_rejection_per_cost(monkeypatch):
    monkeypatch.undo()
    assert quality_rules.order({"a": (2.0, 0.5), "b": (1.0, 0.5), "c": (1.0, 0.0)}) == ["b", "a", "c"]


def test_kept_can_be_filtered_without_recounting_per_word(docs):
    every = sorted_rows(quality_rules.quality_rules(docs))
    assert sorted_rows(quality_rules.quality_rules(docs).where("kept")) == [r for r in every if r[7]]


def test_mix_meets_its_targets(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = mixing.taken_words(mixing.mix(docs)).join(docs.select("doc_id", "source"), "doc_id")
    for r in rows.groupBy("source").agg(F.first("target").alias("target"), F.sum("taken").alias("taken"), F.max("size").alias("most")).collect():
        assert abs(r.taken - r.target) <= 3 * r.most
    assert rows.where("taken > 3 * size").isEmpty()


def test_mix_targets_by_hand(spark):
    sizes = spark.createDataFrame([("a", 100), ("b", 10), ("c", 1), (None, 0)], "source string, size long")
    got = {r.source: r.target for r in mixing.source_targets(sizes).collect()}
    assert got == {"a": 111 - 33.0, "b": 30.0, "c": 3.0, None: 0.0}


def test_mix_of_awkward_rows(docs, placed):
    got = mixing.mix(docs).collect()
    assert len(got) == len(placed) and all(0 <= r.copies <= 3 for r in got)
    assert sorted_rows(mixing.mix(docs)) == sorted((tuple(r) for r in got), key=repr)
    emitted = mixing.mixed_documents(docs)
    assert emitted.columns == docs.columns and emitted.count() == sum(r.copies for r in got)


def test_exact_groups_equal_brute_force(docs, placed):
    groups = collections.defaultdict(list)
    for k, (i, t) in enumerate(placed):
        groups[re.sub(r"[\x20\x09-\x0D]", "", t or "")].append(k)
    want = []
    for norm, members in groups.items():
        best = min(members, key=lambda k: (-len(placed[k][1] or ""), placed[k][0] is None, placed[k][0] or 0, k))
        want += [(placed[k][0], placed[best][0], len(members), k == best, hexed(norm.encode())) for k in members]
    assert sorted_rows(exact_groups(docs)) == sorted(want, key=repr)
    assert sorted_rows(exact_groups(docs, per_owner=3)) == sorted(want, key=repr)


def test_golomb_code_round_trip():
    rng = np.random.default_rng(2)
    for bits, n in ((40, 1_000), (60, 3), (12, 4_000), (64, 500)):
        values = np.unique(rng.integers(0, 1 << min(bits, 63), n, dtype=np.uint64))
        assert (rice_decode(rice_encode(values, 0, bits), 0) == values).all()
        low = 1 << 20
        assert (rice_decode(rice_encode(values[: len(values) // 2] + np.uint64(low), low, bits), low) == values[: len(values) // 2] + np.uint64(low)).all()


def test_preference_pairs(spark):
    schema = "pair_id long, turn long, role string, text string, side string"
    chosen = spark.createDataFrame([(1, 0, "user", "hi", ""), (1, 1, "assistant", "yes", ""), (2, 0, "user", None, ""), (None, 5, None, "x", ""),
                                    (3, 0, "user", "same", ""), (4, 1, "assistant", "b", ""), (4, 0, "system", "é", "")], schema)
    rejected = spark.createDataFrame([(1, 0, "user", "hi", ""), (1, 1, "assistant", "no", ""), (1, 2, "user", "why", ""),
                                      (3, 0, "user", "same", ""), (4, 0, "system", "é", "")], schema)
    got = {r.pair_id: r for r in chat_format.preference_pairs(chosen, rejected).collect()}
    assert set(got) == {1, 2, 3, 4, None}
    r = got[1]
    assert (r.n_prefix, r.prompt, r.chosen) == (1, "<|user|>\nhi\n", "<|assistant|>\nyes\n")
    assert r.rejected == "<|assistant|>\nno\n<|user|>\nwhy\n"
    assert [r.rejected[s.start : s.start + s.length] for s in r.rejected_spans] == ["no"]
    assert [r.chosen[s.start : s.start + s.length] for s in r.chosen_spans] == ["yes"]
    assert (got[3].prompt, got[3].chosen, got[3].rejected) == ("<|user|>\nsame\n", "", "")
    assert (got[4].prompt, got[4].chosen, got[4].rejected) == ("<|system|>\né\n", "<|assistant|>\nb\n", "")
    assert (got[2].prompt, got[2].chosen, got[2].rejected) == ("", "<|user|>\n\n", "") and got[None].chosen == "<||>\nx\n"
    assert chat_format.preference_pairs(chosen.limit(0), rejected.limit(0)).count() == 0


def test_licences_are_inherited_from_the_nearest_directory(spark):
    mit, gpl = "Released under the MIT License.", "This work is licensed under the GNU General Public License, version 3."
    rows = [(1, "a/LICENSE", mit), (2, "a/x.txt", "no words"), (3, "a/b/COPYING.md", gpl), (4, "a/b/c/d.txt", None), (5, "a/b/own.txt", f"top\n# {mit}\n"),
            (6, "z/y.txt", "plain"), (7, None, mit), (8, None, None), (9, "a/LICENSES/x", "text"), (10, "a/c/notalicense.txt", gpl), (11, "a/c/q.txt", ""),
            (12, "ab/q.txt", "")]
    df = spark.createDataFrame(rows, "file long, path string, text string").withColumn("license", F.lit("clash")).withColumn("dir", F.lit(1))
    got = {r.file: (r.license, r.found, r.from_dir) for r in license_scan.scan_licenses(df).collect()}
    assert got == {
        1: ("MIT", "header", None), 2: ("MIT", "directory", "a"), 3: ("GPL-3.0", "header", None), 4: ("GPL-3.0", "directory", "a/b"),
        5: ("MIT", "header", None), 6: (None, "none", None), 7: ("MIT", "header", None), 8: (None, "none", None),
        9: ("MIT", "directory", "a"), 10: ("GPL-3.0", "header", None), 11: ("MIT", "directory", "a"), 12: (None, "none", None)}


def test_licences_in_the_root_directory(spark):
    mit, gpl = "Released under the MIT License.", "This work is licensed under the GNU General Public License, version 3."
    rows = [(1, "LICENSE", mit), (2, "src/a.py", "plain"), (3, "b.py", "plain"), (4, "src/deep/COPYING", gpl), (5, "src/deep/c.py", ""),
            (6, "/LICENSE", gpl), (7, "/src/a.py", "plain"), (8, "/b.py", None), (9, None, "plain"), (10, None, mit)]
    df = spark.createDataFrame(rows, "file long, path string, text string")
    got = {r.file: (r.license, r.found, r.from_dir) for r in license_scan.scan_licenses(df).collect()}
    assert got == {
        1: ("MIT", "header", None), 2: ("MIT", "directory", ""), 3: ("MIT", "directory", ""), 4: ("GPL-3.0", "header", None),
        5: ("GPL-3.0", "directory", "src/deep"), 6: ("GPL-3.0", "header", None), 7: ("GPL-3.0", "directory", "/"),
        8: ("GPL-3.0", "directory", "/"), 9: (None, "none", None), 10: ("MIT", "header", None)}


def test_licence_headers_of_null_and_repeated_ids(spark):
    mit, gpl = "Released under the MIT License.", "This work is licensed under the GNU General Public License, version 3."
    part = "under the MIT License, see below"  # nearer than half to MIT, and not near enough
    rows = [(None, "a/x", mit), (None, "a/y", gpl), (1, "b/x", mit), (1, "b/x", mit), (2, "c/x", part), (2, "c/x", part), (2, "c/x", part),
            (3, "d/x", mit), (3, "d/y", gpl), (3, "d/z", "plain")]
    df = spark.createDataFrame(rows, "file long, path string, text string").repartition(3)
    got = sorted((tuple(r) for r in license_scan.scan_licenses(df).collect()), key=repr)
    assert got == sorted([
        (None, "MIT", 1.0, "header", None), (None, "GPL-3.0", 1.0, "header", None), *[(1, "MIT", 1.0, "header", None)] * 2,
        *[(2, None, None, "none", None)] * 3, (3, "MIT", 1.0, "header", None), (3, "GPL-3.0", 1.0, "header", None),
        (3, None, None, "none", None)], key=repr)


def test_usual_forms_of_licences_are_found(spark):
    mit_text = """// Copyright (c) 2001 Someone
//
// Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated
// documentation files (the "Software"), to deal in the Software without restriction, including without limitation the
// rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit
// persons to whom the Software is furnished to do so, subject to the following conditions:
"""
    forms = [
        ("All rights reserved.", "Proprietary"), ("MIT License", "MIT"), ("Apache License", "Apache-2.0"), ("GNU GENERAL PUBLIC LICENSE", "GPL-3.0"),
        ("# SPDX-License-Identifier: MIT", "MIT"), (mit_text, "MIT"), ("Licensed under the MIT license", "MIT"),
        ("This project is released under the MIT License.", "MIT"), ("SPDX-License-Identifier: GPL-3.0-or-later", "GPL-3.0"),
        ("GNU Lesser General Public License, version 3", "LGPL-3.0"),
        # no licence is named: prose on licences, a driving licence, an unknown name
        ("He has a licence to drive and a copy of it.", None), ("license", None), ("Copyright 2020 the authors", None),
        ("SPDX-License-Identifier: Own-1.0", None), ("plain words", None), ("the public domain is not discussed in this book about software", None)]
    rows = [(i, f"d{i}/x.txt", f"words before\n{text}\nand after") for i, (text, _) in enumerate(forms)]
    df = spark.createDataFrame(rows, "file long, path string, text string")
    got = {r.file: r.license for r in license_scan.scan_licenses(df).collect()}
    assert {forms[i][0]: k for i, k in got.items()} == dict(forms)


def test_licence_files_are_compared_whole_and_hot_roots_are_split(spark):
    whole = "Permission is hereby granted, free of charge,\nto any person obtaining\na copy"
    rows = [(0, "LICENSE", whole), (1, "a/b.txt", whole + " " + "word " * 60_000)] + [(i, f"d{i}/x.txt", None) for i in range(2, 3_000)]
    df = spark.createDataFrame(rows, "file long, path string, text string").withColumn("units", F.lit(1)).withColumn("up", F.lit("x"))
    got = license_scan.scan_licenses(df, least=0.95).groupBy("license", "found", "from_dir").count().collect()
    assert sorted(map(tuple, got), key=repr) == sorted([("MIT", "header", None, 1), ("MIT", "directory", "", 2_999)], key=repr)
    named = license_scan.scan_licenses(df.limit(1), {"It's": ["free of charge to any person"], "none": []}, 0.3).collect()
    assert [r.license for r in named] == ["It's"]
    assert license_scan.scan_licenses(df.limit(0)).count() == 0
    assert license_scan.scan_licenses(df.limit(5), {}).where("license is not null").isEmpty()


def test_join_counted_splits_hot_keys(spark):
    rows = spark.range(5_000).select(F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("k"), F.col("id") % 2_000)).alias("k"), "id")
    classes = rows.groupBy("k").agg(F.count("*").alias("n"))
    got = join_counted(rows, classes, "k", "n", 5_000)
    assert got.count() == 5_000 and got.where("n is null").isEmpty()
    assert {r.n for r in got.where("k = 'hot'").collect()} == {1_667}


def test_memo_is_bounded_and_keeps_what_is_used():
    memo, asked = Memo(10), []
    for i in range(200):
        known = memo.lookup({0, i}, lambda keys: asked.extend(keys) or [k * 2 for k in keys])
        assert known[0] == 0 and known[i] == 2 * i
    assert asked.count(0) == 1 and len(memo.new) + len(memo.old) <= 24


@pytest.mark.parametrize("depth", [7, 121, 200])
def test_depths_that_records_cannot_hold_are_refused(docs, depth):
    with pytest.raises(ValueError):
        suffix_dedup(docs, depth)
