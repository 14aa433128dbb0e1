"""The pipeline's stages on their own input, the numbered queries against SQL, and the guard in the entry module."""

import re

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
import corpus_pipeline
from tools.check_oracle import compare, connect
from wattweave.llm import language_id
from wattweave.llm.catalog import ORACLES, QUERIES

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def docs(spark):
    df = spark.read.parquet(f"{FOLDER}/documents.parquet")
    more = df.limit(3).withColumns({"doc_id": F.lit(None).cast("long"), "source": F.lit(None).cast("string")})
    odd = df.limit(1).withColumns({"doc_id": F.lit(90_001).cast("long"), "text": F.lit(None).cast("string"), "lang": F.lit(None).cast("string")})
    return df.unionByName(more).unionByName(odd).unionByName(df.where("doc_id = 5"))


def normal(text):
    return re.sub(r"[\x20\x09-\x0D]", "", text or "")


def test_stages(spark, docs):
    names = [name for name, _ in corpus_pipeline.STAGES]
    assert len(names) == len(set(names)) == 5
    language, exact, similar, mixed, last = (stage for _, stage in corpus_pipeline.STAGES)
    known = language(spark, docs, FOLDER).persist()
    assert known.columns == docs.columns and known.count() == docs.where("text is not null").count()
    once = exact(spark, known, FOLDER).persist()
    texts = [normal(r.text) for r in once.collect()]
    assert once.columns == docs.columns and len(texts) == len(set(texts)) == len({normal(r.text) for r in known.collect()})
    apart = similar(spark, once, FOLDER).persist()
    sets = {}
    for i, r in enumerate(apart.collect()):
        w = re.findall(r"[^\x20\x09-\x0D]+", r.text)
        sets[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))}
    assert apart.columns == docs.columns and 0 < len(sets) <= len(texts)
    assert not any(5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]) for a in sets for b in sets if a < b)
    mix = mixed(spark, apart, FOLDER).persist()
    assert mix.columns == docs.columns and mix.groupBy("doc_id").count().where("count > 3").isEmpty()
    assert last(spark, mix, FOLDER).count() == mix.count()


@pytest.mark.parametrize("stage", [stage for _, stage in corpus_pipeline.STAGES])
def test_stages_take_an_empty_table(spark, docs, stage):
    assert stage(spark, docs.limit(0), FOLDER).count() == 0


def test_language_stage_decides_by_score(spark, docs):
    strange = ["这是一个中文文本,没有别的东西。", "これは日本語の文章です。", "Это русский текст о погоде.", "هذا نص باللغة العربية."]
    more = docs.limit(1).select(*[c for c in docs.columns if c not in ("doc_id", "text", "lang")]).crossJoin(
        spark.createDataFrame([(95_000 + i, t, None) for i, t in enumerate(strange)], "doc_id long, text string, lang string"))
    every = docs.unionByName(more.select(docs.columns))
    kept = corpus_pipeline.known_language(spark, every, FOLDER).persist()
    assert kept.where("doc_id >= 95000").isEmpty()
    assert kept.count() == docs.where("text is not null").count()
    assert corpus_pipeline.known_language(spark, docs.withColumn("lang", F.lit(None).cast("string")), FOLDER).isEmpty()


def test_least_score_follows_the_training_rows():
    rng = np.random.default_rng(4)
    low, high = (rng.random((200, language_id.BINS)) < share for share in (0.02, 0.3))
    labels = ["a", "b"] * 100
    for rows in (low, high):  # the bins of one language are half those of the other
        rows[::2, : language_id.BINS // 2] = rows[1::2, language_id.BINS // 2 :] = False
    borders = []
    for rows in (low, high):
        norm = np.sqrt(np.maximum(rows.sum(axis=1, keepdims=True), 1))
        border = language_id.least_score(rows.astype(np.float32), labels, norm)
        assert 0 < border < 0.6
        borders.append(border)
    assert borders[0] < borders[1]
    assert language_id.least_score(low[:4].astype(np.float32), labels[:4], np.ones((4, 1))) == 0.0


def test_language_model_and_border_come_from_every_row(spark, docs):
    x, labels, norm = language_id.sample(docs, 60)  # landmarks of a few rows, a model of all
    basis, languages = language_id.Basis.of(x, labels, norm), sorted(set(labels))
    model, without, n = language_id.fit_all(docs, basis, languages)
    rows = language_id.learnable(docs).where(F.col("lang").isin(languages)).collect()
    assert len(rows) > 100 and n == sum(r.held for r in rows)
    z = basis.place([r.text for r in rows])
    for got, use in ((model, [True] * len(rows)), (without, [not r.held for r in rows])):
        some, y = z[use], np.array([[r.lang == x for x in languages] for r, u in zip(rows, use) if u], float)
        weight = (y / y.sum(0)).sum(1)[:, None] / len(languages)
        want = basis.model(languages, some.T @ (weight * some), some.T @ (weight * y))
        assert np.allclose(got.weights, want.weights, atol=1e-4)
    scores = without.score([r.text for r in rows if r.held])[1]
    assert language_id.least_held_score(docs, without, n) == pytest.approx(0.5 * np.quantile(scores, 0.001), abs=1e-9)


def test_whole_run(spark):
    rows = corpus_pipeline.run(spark, FOLDER)
    assert rows.count() > 100 and rows.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]


def test_registration():
    numbers = sorted(int(re.match(r"op(\d+)_", name)[1]) for name in QUERIES)
    assert numbers == list(range(1, 14)) and set(QUERIES) | {"pipeline"} <= set(entry.queries())


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_equals_sql(spark, name):
    assert compare(QUERIES[name](spark, FOLDER), connect(FOLDER).sql(ORACLES[name])) == ""
