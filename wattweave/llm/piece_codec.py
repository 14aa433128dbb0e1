"""Encoding and decoding with merge-type (BPE) SentencePiece vocabularies."""

from __future__ import annotations

import functools
import hashlib
import heapq
import re

import pyarrow as pa
from pyspark.sql import DataFrame

from wattweave.llm.common import HELD, Memo, id_and_text, slices, small_batches, task

SPACE = "▁"
ROOM = 400_000
SHORT = 32
NONE = float("-inf")
OUT = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


class MergeVocabulary:
    """Pieces, scores and the agenda of adjacent symbol pairs of one model file.

    Only models of the merge type without a character map and without user-defined pieces can be read.
    """

    def __init__(self, path: str):
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2

        self.library = sentencepiece.SentencePieceProcessor(model_file=path)
        model = sentencepiece_model_pb2.ModelProto()
        model.ParseFromString(self.library.serialized_model_proto())
        norm, kinds = model.normalizer_spec, sentencepiece_model_pb2.ModelProto.SentencePiece
        if (model.trainer_spec.model_type != 2 or norm.precompiled_charsmap or norm.remove_extra_whitespaces
                or not norm.escape_whitespaces or model.trainer_spec.treat_whitespace_as_suffix
                or not model.trainer_spec.byte_fallback
                or any(p.type in (kinds.USER_DEFINED, kinds.UNUSED) for p in model.pieces)):
            raise ValueError(f"{path} is not a plain merge-type model with byte fallback")
        self.prefix = SPACE if norm.add_dummy_prefix else ""
        self.score = {p.piece: p.score for p in model.pieces if p.type == kinds.NORMAL}
        self.id = {p.piece: i for i, p in enumerate(model.pieces) if p.type == kinds.NORMAL}
        self.byte = {int(p.piece[3:5], 16): i for i, p in enumerate(model.pieces) if p.type == kinds.BYTE}
        self.piece = {i: p for p, i in self.id.items()}
        self.of_byte = {i: b for b, i in self.byte.items()}
        joints = {a + b for p in self.score for a, b in zip(p, p[1:])}
        if any(j[1] == SPACE != j[0] for j in joints):
            raise ValueError(f"{path} has pieces that go over the start of a word")
        self.alone = alone = "" if any("\n" in j for j in joints) else "\n"
        # no piece goes over these borders, so no merge does
        self.chunks = re.compile(f"{alone}|{SPACE}*[^{SPACE}{alone}]+|{SPACE}+" if alone else f"{SPACE}*[^{SPACE}]+|{SPACE}+").findall
        self.memo = Memo(ROOM)

    def merge(self, chunk: str) -> list[str]:
        """Join the adjacent pair with the highest score, the leftmost of equals, until no pair is a piece."""
        return self.merge_short(chunk) if len(chunk) <= SHORT else self.merge_long(chunk)

    def merge_short(self, chunk: str) -> list[str]:
        score, symbols = self.score.get, list(chunk)
        agenda = [score(a + b, NONE) for a, b in zip(symbols, symbols[1:])]
        while agenda:
            best = max(agenda)
            if best == NONE:
                break
            i = agenda.index(best)
            symbols[i : i + 2] = [symbols[i] + symbols[i + 1]]
            del agenda[i]
            if i < len(agenda):
                agenda[i] = score(symbols[i] + symbols[i + 1], NONE)
            if i:
                agenda[i - 1] = score(symbols[i - 1] + symbols[i], NONE)
        return symbols

    def merge_long(self, chunk: str) -> list[str]:
        """The same with a heap as agenda; an entry whose pair has changed meanwhile is passed over."""
        score, symbols, n = self.score, list(chunk), len(chunk)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        agenda = [(-score[p], i, p) for i in range(n - 1) if (p := chunk[i : i + 2]) in score]
        heapq.heapify(agenda)
        while agenda:
            _, i, pair = heapq.heappop(agenda)
            j = after[i]
            if symbols[i] is None or j >= n or symbols[i] + symbols[j] != pair:
                continue
            symbols[i], symbols[j], after[i] = pair, None, after[j]
            if after[i] < n:
                before[after[i]] = i
                if (p := pair + symbols[after[i]]) in score:
                    heapq.heappush(agenda, (-score[p], i, p))
            if (h := before[i]) >= 0 and (p := symbols[h] + pair) in score:
                heapq.heappush(agenda, (-score[p], h, p))
        return [s for s in symbols if s is not None]

    def ids(self, chunk: str) -> list[int]:
        found = []
        for symbol in self.merge(chunk):
            i = self.id.get(symbol)
            if i is None:
                found += [self.byte[b] for b in symbol.encode("utf-8")]
            else:
                found.append(i)
        return found

    def text(self, ids: list[int]) -> str:
        """The text of one chunk's ids. The bytes of a character are never in two chunks."""
        out = b"".join(self.piece[i].encode("utf-8") if i in self.piece else bytes([self.of_byte[i]]) for i in ids)
        return out.decode("utf-8", "replace").replace(SPACE, " ")

    def compute(self, chunks: list[str]) -> list[str | tuple[str, str]]:
        """Ids of chunks not met before, each held against the library's; with the decoded text if that isn't the
        chunk itself."""
        ids = [self.ids(c) for c in chunks]
        # the library puts its prefix before what it is given: a chunk goes behind a border, and the border's ids go off
        border = "\n" if self.alone else SPACE
        before = self.ids(self.prefix + border) if self.alone else []
        given, expected = [], []
        for c, own in zip(chunks, ids):
            if self.prefix and c.startswith(SPACE) and len(c) > 1:
                given.append(c[1:])
                expected.append(own)
            elif self.alone:
                given.append(border + c)
                expected.append([*before[:-1], *self.ids(border), *own])
        for chunk, own, lib in zip(given, expected, self.library.encode(given, num_threads=1)):
            if own != lib:
                raise RuntimeError(f"the agenda and the library differ on {chunk[:80]!r}: {own[:40]} and {lib[:40]}")
        plain = [",".join(map(str, x)) for x in ids]
        return [p if (t := self.text(x)) == c.replace(SPACE, " ") else (p, t) for c, p, x in zip(chunks, plain, ids)]

    def encode(self, text: str) -> list[int]:
        return [i for c in self.chunks(self.prefix + text.replace(" ", SPACE)) for i in self.ids(c)] if text else []

    def decode(self, ids: list[int]) -> str:
        text = self.text(ids)
        return text[1:] if self.prefix and text.startswith(" ") else text

    def digests(self, texts: list[str]) -> list[tuple[int, str, str]]:
        """Number of ids, digest of the ids and digest of the decoded text of each text."""
        out = []
        for run in slices(texts):
            given = [self.prefix + t.replace(" ", SPACE) if t else "" for t in run]
            cut = [self.chunks(g) for g in given]
            known = self.memo.lookup(set().union(*cut), self.compute)
            for g, x in zip(given, cut):
                found = [known[c] for c in x]
                try:
                    ids, text = ",".join(found), g.replace(SPACE, " ")
                except TypeError:  # some chunk decodes to another text
                    both = [(f, c.replace(SPACE, " ")) if isinstance(f, str) else f for f, c in zip(found, x)]
                    ids, text = ",".join([f[0] for f in both]), "".join([f[1] for f in both])
                if self.prefix and text.startswith(" "):
                    text = text[1:]
                out.append((ids.count(",") + 1 if ids else 0, hashlib.sha256(ids.encode()).hexdigest(),
                            hashlib.sha256(text.encode("utf-8")).hexdigest()))
        return out


@functools.lru_cache(maxsize=2)
def vocabulary(path: str) -> MergeVocabulary:
    return MergeVocabulary(path)


HELD["pieces"] = vocabulary.cache_clear


def encode_ids(docs: DataFrame, model: str) -> DataFrame:
    """doc_id, ids, decoded: the real ids and the text decoded from them. Rows and nulls as in piece_digests()."""

    def run(batches):
        v = vocabulary(model)
        for b in batches:
            ids = [v.encode(t) for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), pa.array(ids, pa.list_(pa.int32())), pa.array([v.decode(x) for x in ids], pa.string())],
                names=["doc_id", "ids", "decoded"])

    return id_and_text(docs).mapInArrow(task(run, "pieces"), "doc_id long, ids array<int>, decoded string")


def piece_digests(docs: DataFrame, model: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of every whole text; `model` is a path that every executor has.

    No shuffle: each Arrow batch is encoded where it is read. The ids of a chunk between two borders that no piece
    crosses are remembered in a memo of bounded size; the first meeting with a chunk runs the agenda and holds its
    ids against the library's. Null text counts as empty: 0 tokens, digests of the empty string. Null doc_id and
    repeated rows stay, a row each. Empty table: no rows. Other columns are not read.
    """

    def run(batches):
        v = vocabulary(model)
        for b in batches:
            n, ids, text = zip(*found) if (found := v.digests(b.column("text").to_pylist())) else ((), (), ())
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), pa.array(n, pa.int64()), pa.array(ids, pa.string()), pa.array(text, pa.string())],
                names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    small_batches(docs.sparkSession)
    return id_and_text(docs).mapInArrow(task(run, "pieces"), OUT)
