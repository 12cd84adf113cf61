"""Mixing sources to target weights, sized in tokens (problem 7).

Documents are counted by exact token length per source. Each source gets a token budget: its target share of the
total, or all it can give (its tokens x ``max_repeats``) where that is less; what such a source can't give goes to
the others in proportion to their targets. A budget is met by whole copies of the source, then by a subset of it: an
even share of every length, and a bounded-knapsack search over the lengths left for the rest of the budget, widened
until the sum fits to the token or the whole budget was searched. Which documents of a length are taken is decided by a seeded hash.

Only lengths and counts meet in a task (per source as many rows as it has distinct lengths), only one row per target
comes to the driver, and documents of one length are ranked in buckets of bounded size.
"""

from __future__ import annotations

import base64
from functools import lru_cache

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from plumbline.operators.skew import salted_join
from plumbline.session import cut

#: A byte-level BPE vocabulary as ranks, and the pattern that splits text before merging (fixed values of that vocabulary).
TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Documents of one source and length ranked in one task.
BUCKET_ROWS = 50_000
#: The knapsack search starts with the last so many tokens of a budget, or four times the longest document if that is
#: more, and doubles them until the budget is met to the token or the search covers all of it.
KNAPSACK_TOKENS = 1 << 12
#: A search over so many tokens (150 MB) is not widened any more; what is left open then stands in the shares.
KNAPSACK_MOST = 1 << 24


@lru_cache(maxsize=2)
def _encoding(path: str):
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def token_count(text: Column, path: str = TOKENIZER) -> Column:
    """The number of tokens of a text (null and empty: 0); whole texts, in Arrow batches."""

    @F.pandas_udf(T.LongType())
    def count(texts):
        import pandas as pd

        enc = _encoding(path)
        return pd.Series([len(enc.encode_ordinary(t)) if t else 0 for t in texts], dtype="int64")

    return count(text)


def budgets(supply: dict, targets: dict, total: int) -> dict:
    """Tokens per source: ``targets`` has (share, max repeats), ``supply`` the tokens a source has.

    Shares of sources that can't reach theirs are cut to what they can give, and the rest is scaled up to the total.
    """
    room = {s: supply.get(s, 0) * r for s, (_, r) in targets.items()}
    out = {s: 0 for s in targets}
    free = {s for s in targets if targets[s][0] > 0 and room[s] > 0}
    left = min(total, sum(room[s] for s in free))
    while free:
        whole = sum(targets[s][0] for s in free)
        full = {s for s in free if left * targets[s][0] / whole >= room[s]}
        if not full:
            exact = {s: left * targets[s][0] / whole for s in free}
            out |= {s: int(x) for s, x in exact.items()}
            for s in sorted(free, key=lambda s: (int(exact[s]) - exact[s], s))[: left - sum(int(x) for x in exact.values())]:
                out[s] += 1
            break
        for s in full:
            out[s] = room[s]
            left -= room[s]
        free -= full
    return out


def fit(lengths: list[int], counts: list[int], budget: int, knapsack: int = KNAPSACK_TOKENS, seed: int = 7) -> list[int]:
    """How many documents of each length to take so that their sum is the largest at or under ``budget``.

    The even share of every length leaves some tokens open, and these with what the search gives back are filled with
    lengths in a seeded order, so no length is preferred. If no subset fills them, the search gives back twice as many
    tokens. It ends when the budget is met (or the next smaller multiple of what all lengths are multiples of), when it
    covers the whole budget, so that no subset of the documents comes closer, or at KNAPSACK_MOST.
    """
    import math
    import random

    total = sum(n * c for n, c in zip(lengths, counts, strict=True))
    if budget >= total:
        return list(counts)
    order = [i for i in range(len(lengths)) if lengths[i] > 0]
    random.Random(seed).shuffle(order)
    common = math.gcd(*(lengths[i] for i in order if lengths[i] <= budget)) or 1
    window, best, best_sum = max(knapsack, 4 * max(lengths, default=0)), None, -1
    while True:
        got, reached = _fit_window(lengths, counts, budget, total, order, window)
        if reached > best_sum:
            best, best_sum = got, reached
        if best_sum >= budget - budget % common or window >= 2 * budget or window >= KNAPSACK_MOST:
            return best
        window *= 2


def _fit_window(lengths: list[int], counts: list[int], budget: int, total: int, order: list[int], window: int) -> tuple[list[int], int]:
    """``fit`` with a search over some ``window`` tokens, and the sum it reaches."""
    import numpy as np

    # the even share of what lies outside the window
    even = max(0, budget - window // 2)
    take = [c * even // total for c in counts]
    rest = budget - sum(n * t for n, t in zip(lengths, take, strict=True))
    for i in order:
        # the even share is short of each length by less than one document
        if even and take[i] < counts[i] and rest - lengths[i] >= window // 2:
            take[i] += 1
            rest -= lengths[i]
    parent = np.full(rest + 1, -1, np.int64)
    reached = np.zeros(rest + 1, bool)
    reached[0] = True
    parts: list[tuple[int, int]] = []
    for i in order:
        left, size = min(counts[i] - take[i], rest // lengths[i]), 1
        while left > 0 and not reached[rest]:
            k = min(size, left)
            step = k * lengths[i]
            if step > rest:
                break
            new = reached[: rest + 1 - step] & ~reached[step:]
            at = np.flatnonzero(new) + step
            parent[at] = len(parts)
            reached[at] = True
            parts.append((i, k))
            left, size = left - k, size * 2
        if reached[rest]:
            break
    w = int(np.flatnonzero(reached)[-1])
    filled = budget - rest + w
    while w:
        i, k = parts[parent[w]]
        take[i] += k
        w -= k * lengths[i]
    return take, filled


def mix(docs: DataFrame, doc_id: str, source: str, size: str, targets: DataFrame, total: int | None = None, seed: int = 7) -> tuple[DataFrame, DataFrame]:
    """(selection, shares) of ``docs``, which has a token count ``size`` per row.

    The selection has ``doc_id, source, n_tokens, copies`` for the rows taken. The shares have per target ``source,
    target_share, max_repeats, n_docs, available_tokens, budget_tokens, actual_tokens, open_tokens, actual_share`` (share of the
    whole selection; open is what no subset found fills). ``total`` defaults to the tokens of the targets' sources. Rows of a source without a target, or
    with a null source or size, are not taken; targets with a null or negative share or repeats count as zero; a
    repeated target source counts once (its largest share). Repeated rows are documents of their own. Without documents
    nothing is taken and every share is null; further columns are not looked at.
    """
    spark = docs.sparkSession
    t = targets.where(F.col("source").isNotNull()).groupBy("source").agg(F.max("target_share").alias("share"), F.max("max_repeats").alias("reps"))
    wanted = {r["source"]: (max(0.0, r["share"] or 0.0), max(0, int(r["reps"] or 0))) for r in t.collect()}  # one row per target
    names = list(wanted)
    sized = cut(docs.where(F.col(source).isin(names) & F.col(size).isNotNull()).select(F.col(doc_id).alias("doc_id"), F.col(source).alias("source"), F.col(size).cast("long").alias("n_tokens")))
    hist = cut(sized.groupBy("source", "n_tokens").agg(F.count(F.lit(1)).alias("n")))
    have = {r["source"]: (r["d"], r["s"]) for r in hist.groupBy("source").agg(F.sum("n").alias("d"), F.sum(F.col("n") * F.col("n_tokens")).alias("s")).collect()}
    supply = {s: have.get(s, (0, 0))[1] for s in names}
    plan = budgets(supply, wanted, sum(supply.values()) if total is None else total)
    whole = {s: min(wanted[s][1], plan[s] // supply[s]) if supply[s] else 0 for s in names}
    rest = {s: plan[s] - whole[s] * supply[s] if whole[s] < wanted[s][1] else 0 for s in names}

    def choose(pdf):
        pdf = pdf.sort_values("n_tokens")
        s = pdf["source"].iloc[0]
        pdf["extra"] = fit(pdf["n_tokens"].tolist(), pdf["n"].tolist(), rest[s], seed=seed)
        pdf["whole"] = whole[s]
        return pdf[["source", "n_tokens", "n", "whole", "extra"]]

    chosen = cut(hist.groupBy("source").applyInPandas(choose, "source string, n_tokens long, n long, whole long, extra long"))
    h = F.xxhash64(F.lit(seed), F.col("doc_id").cast("string"))
    # one source and length may hold a third of all rows
    pair = F.concat_ws("|", F.col("n_tokens").cast("string"), "source")
    ranked = salted_join(sized.withColumn("__pair", pair), chosen.withColumn("__pair", pair).drop("source", "n_tokens"), "__pair").drop("__pair").withColumn("h", h).withColumn("bucket", F.pmod(F.col("h"), F.ceil(F.col("n") / BUCKET_ROWS)))
    of = ["source", "n_tokens", "bucket"]
    by_bucket = ranked.groupBy(*of).agg(F.count(F.lit(1)).alias("here"))
    before = by_bucket.select(*of, F.coalesce(F.sum("here").over(Window.partitionBy("source", "n_tokens").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    placed = ranked.join(before, of).withColumn("place", F.col("before") + F.row_number().over(Window.partitionBy(*of).orderBy("h", "doc_id")))
    selection = placed.select("doc_id", "source", "n_tokens", (F.col("whole") + (F.col("place") <= F.col("extra")).cast("long")).alias("copies")).where("copies > 0")
    actual = chosen.groupBy("source").agg(F.sum(F.col("n_tokens") * (F.col("whole") * F.col("n") + F.col("extra"))).alias("actual_tokens"))
    rows = [(s, float(wanted[s][0]), int(wanted[s][1]), int(have.get(s, (0, 0))[0]), int(supply[s]), int(plan[s])) for s in names]
    base = spark.createDataFrame(rows, "source string, target_share double, max_repeats int, n_docs long, available_tokens long, budget_tokens long")
    shares = base.join(actual, "source", "left").withColumn("actual_tokens", F.coalesce("actual_tokens", F.lit(0)))
    shares = shares.withColumn("open_tokens", F.col("budget_tokens") - F.col("actual_tokens"))
    shares = shares.crossJoin(F.broadcast(shares.agg(F.sum("actual_tokens").alias("all")))).withColumn("actual_share", F.try_divide("actual_tokens", "all")).drop("all")
    return selection, shares
