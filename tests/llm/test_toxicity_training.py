"""The toxicity net learns from every labelled row that is not held out, whole."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestrata.llm import toxicity
from lodestrata.llm.labelled import remainder
from tests.oracle import SF


def test_every_labelled_row_is_learned_from(spark):
    """of more than 5,000 labelled rows, those whose ids hash highest were left out, here a language."""
    usable = spark.range(7_200).where(remainder(F.col("id"), toxicity.FOLDS) != toxicity.HELD_OUT)
    ids = [r["id"] for r in usable.orderBy(F.xxhash64("id"), "id").collect()]
    assert len(ids) > 5_100
    made = [(d, f"{'bad' if n % 2 else 'good'} w{d}", "xx" if n >= len(ids) - 60 else "en", n % 2) for n, d in enumerate(ids)]
    docs = spark.createDataFrame(made, "doc_id long, text string, lang string, toxic int")
    net = toxicity.train(docs.drop("toxic"), docs.select("doc_id", "toxic"))
    assert set(net.thresholds) == {None, "en", "xx"}


def test_shards_learn_alike_however_the_rows_arrive(spark, monkeypatch):
    labels = spark.read.parquet(f"{SF}/../sf0.01/labels.parquet")
    docs = spark.read.parquet(f"{SF}/../sf0.01/documents.parquet")
    monkeypatch.setattr(toxicity, "SHARD_ROWS", 100)
    seen, every = [], toxicity._round
    monkeypatch.setattr(toxicity, "_round", lambda lists, *more: seen.append(lists) or every(lists, *more))
    one, other = toxicity.train(docs, labels), toxicity.train(docs.repartition(7), labels)
    assert seen[0].select("shard").distinct().count() > 1 and len(seen) == 2 * toxicity.EPOCHS
    usable = labels.where(F.col("toxic").isNotNull() & (remainder(F.col("doc_id"), toxicity.FOLDS) != toxicity.HELD_OUT)).join(docs, "doc_id")
    assert seen[0].count() == usable.select("doc_id").distinct().count()
    assert np.array_equal(one.embed, other.embed) and one.base == other.base and one.thresholds == other.thresholds
    monkeypatch.setattr(toxicity, "train", lambda *_: one)
    scored = toxicity.classify(docs, labels).join(labels, "doc_id").where("held_out").toPandas()
    apart = scored[scored.toxic == 1].score.to_numpy()[:, None] > scored[scored.toxic == 0].score.to_numpy()[None, :]
    assert apart.mean() > 0.75


def test_a_long_text_is_learned_from_in_pieces(monkeypatch):
    rng = np.random.default_rng(25)
    docs = [rng.integers(0, toxicity.BUCKETS, (n, 1 + len(toxicity.STARTS))).astype(np.uint16) for n in (0, 1, 2, 3, 40, 97, 0, 5)]
    net = toxicity.fit(docs, np.arange(8) % 2.0)
    top, won = net.winners(docs)
    for size in (1, 2, 7, 41):
        monkeypatch.setattr(toxicity, "SCORED", size)
        monkeypatch.setattr(toxicity, "PLACES", max(3, size))
        got, of = net.winners(docs)
        assert np.allclose(got, top, atol=1e-6)
        assert np.allclose(net.vectors(of.reshape(-1, of.shape[-1])), net.vectors(won.reshape(-1, won.shape[-1])))
    text = np.frombuffer(" a bc, def. ghij Klmnopqrst 12 Ünï x".encode() * 5, np.uint8)
    whole = toxicity.tokens(text, np.array([0, len(text)]))[0]
    for size in (1, 5, 60, 1_000):
        monkeypatch.setattr(toxicity, "SLICE", size)
        assert np.array_equal(toxicity._long_tokens(text), whole)


def test_threshold_of_counted_rows():
    rng = np.random.default_rng(26)
    for _ in range(50):
        s, y, n = rng.integers(0, 9, 30) / 8, rng.integers(0, 2, 30).astype(float), rng.integers(1, 5, 30)
        y[0] = 1
        best = toxicity.best_threshold(s, y, n)
        f1 = lambda t: 2 * (y * n)[s >= t].sum() / (n[s >= t].sum() + (y * n).sum())  # noqa: E731, B023
        assert f1(best) == pytest.approx(max(f1(t) for t in s))
        assert best == toxicity.best_threshold(s.repeat(n), y.repeat(n))
