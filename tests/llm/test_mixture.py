import itertools
import random

import pytest
from pyspark.sql import functions as F

from plumbline.llm import mixture, queries
from tests.conftest import SMALL


def test_fit_is_exact_where_a_subset_is():
    rnd = random.Random(11)
    for _ in range(60):
        lengths = sorted(rnd.sample(range(0, 30), rnd.randrange(1, 5)))
        counts = [rnd.randrange(0, 4) for _ in lengths]
        total = sum(a * b for a, b in zip(lengths, counts, strict=True))
        budget = rnd.randrange(0, total + 5)
        take = mixture.fit(lengths, counts, budget, 1 << 16)
        assert all(0 <= t <= c for t, c in zip(take, counts, strict=True))
        got = sum(a * b for a, b in zip(lengths, take, strict=True))
        best = max((s for s in (sum(a * b for a, b in zip(lengths, c, strict=True)) for c in itertools.product(*[range(x + 1) for x in counts])) if s <= budget), default=0)
        assert got == best
    lengths = list(range(50, 900, 7))
    counts = [rnd.randrange(1, 4000) for _ in lengths]
    total = sum(a * b for a, b in zip(lengths, counts, strict=True))
    for budget in (total // 3, total // 7 + 1, 12345):
        take = mixture.fit(lengths, counts, budget)
        assert sum(a * b for a, b in zip(lengths, take, strict=True)) == budget and all(t <= c for t, c in zip(take, counts, strict=True))
    many = list(range(1, 3000))
    take = mixture.fit(many, [1] * len(many), 2_000_003, knapsack=64)
    assert sum(a * b for a, b in zip(many, take, strict=True)) == 2_000_003


def test_budgets():
    got = mixture.budgets({"a": 100, "b": 10, "c": 1000}, {"a": (0.5, 2), "b": (0.25, 2), "c": (0.25, 1), "none": (0.0, 5), "gone": (0.1, 3)}, 400)
    assert got == {"a": 200, "b": 20, "c": 180, "none": 0, "gone": 0}
    assert sum(mixture.budgets({"a": 7, "b": 7}, {"a": (1 / 3, 9), "b": (2 / 3, 9)}, 10).values()) == 10
    assert mixture.budgets({}, {"a": (1.0, 2)}, 10) == {"a": 0}


def test_mix_of_small_tables(spark, monkeypatch):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "source", mixture.token_count(F.col("text")).alias("n"))
    targets = spark.read.parquet(f"{SMALL}/source_targets.parquet")
    monkeypatch.setattr(mixture, "BUCKET_ROWS", 2)
    sel, shares = mixture.mix(docs, "doc_id", "source", "n", targets)
    rows, by = sel.collect(), {r["source"]: r for r in shares.collect()}
    limit = {r["source"]: r["max_repeats"] for r in targets.collect()}
    assert len({r["doc_id"] for r in rows}) == len(rows) and all(1 <= r["copies"] <= limit[r["source"]] for r in rows)
    for s, r in by.items():
        assert sum(x["copies"] * x["n_tokens"] for x in rows if x["source"] == s) == r["actual_tokens"] <= r["budget_tokens"]
        assert r["budget_tokens"] - r["actual_tokens"] <= max((x["n_tokens"] for x in rows if x["source"] == s), default=0)
    assert sum(r["actual_share"] for r in by.values()) == pytest.approx(1)
    again, _ = mixture.mix(docs, "doc_id", "source", "n", targets)
    assert sorted(again.collect()) == sorted(rows)
    other, _ = mixture.mix(docs, "doc_id", "source", "n", targets, seed=8)
    assert sorted(other.collect()) != sorted(rows)


def test_edges(spark):
    docs = spark.createDataFrame([(1, "a", 10), (1, "a", 10), (2, None, 5), (3, "x", 5), (4, "a", None), (5, "a", 0)], "id long, source string, n long")
    targets = spark.createDataFrame([("a", 0.7, 3), ("b", 0.3, 2), (None, 0.5, 1), ("a", None, None)], "source string, target_share double, max_repeats int")
    sel, shares = mixture.mix(docs, "id", "source", "n", targets, total=50)
    assert sorted((r["doc_id"], r["copies"]) for r in sel.collect())[:2] in ([(1, 2), (1, 3)], [(1, 3), (1, 3)], [(1, 2), (1, 2)])
    assert {r["source"]: (r["budget_tokens"], r["actual_tokens"]) for r in shares.collect()} == {"a": (50, 50), "b": (0, 0)}
    sel, shares = mixture.mix(docs.limit(0), "id", "source", "n", targets)
    assert sel.count() == 0 and [r["actual_tokens"] for r in shares.collect()] == [0, 0]
    texts = spark.createDataFrame([(None,), ("",), ("Hello world, hello <|endoftext|>",), ("a b " * 50_000,)], "t string")
    assert [r[0] for r in texts.select(mixture.token_count(F.col("t"))).collect()][:2] == [0, 0]
