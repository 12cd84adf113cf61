import random

import numpy as np

from plumbline.llm import leaks
from tests.conftest import SMALL


def test_words():
    text = r"Both the \emph{Wex}-orbit~\cite[p.~3]{a2011,b} and \ref*{x}\\Then 3.5\% \alpha_2 \citep{kept} %Note: \label {q}Ünder_score \input{../y} end"
    assert [w.decode() for w in leaks.words_of(text)] == "both the wex orbit and then 3 5 2 kept note ünder score end".split()
    plain = text.replace("Ü", "U")
    assert [w.decode() for w in leaks.words_of(plain)] == "both the wex orbit and then 3 5 2 kept note under score end".split()
    assert [text[a:b].lower() for a, b in leaks.word_spans(text)] == [w.decode() for w in leaks.words_of(text)]
    assert leaks.words_of(None) == leaks.words_of("") == leaks.words_of("\\alpha{}--") == []


def test_index_counts_and_locates_like_a_scan():
    rnd = random.Random(8)
    for top, n in ((3, 40), (1, 20), (50, 60)):
        runs = [np.array([rnd.randrange(1, top + 1) for _ in range(rnd.randrange(1, 60))]) for _ in range(n)]
        index = leaks.ShardIndex(runs, top)
        flat = np.concatenate([np.append(r, 0) for r in runs])
        for m in (1, 2, 4):
            phrases = np.array([[rnd.randrange(1, top + 1) for _ in range(m)] for _ in range(60)])
            low, high = index.search(phrases)
            for p, lo, hi in zip(phrases, low, high, strict=True):
                want = [i for i in range(len(flat) - m + 1) if (flat[i : i + m] == p).all()]
                assert sorted(index.locate(np.arange(lo, hi)).tolist()) == want


def brute(docs, items, run):
    grams = {}
    for i, t in items:
        w = leaks.words_of(t)
        for k in range(len(w) - run + 1):
            grams.setdefault(tuple(w[k : k + run]), set()).add(i)
    out = set()
    for d, t in docs:
        w = leaks.words_of(t)
        for k in range(len(w) - run + 1):
            out |= {(d, i) for i in grams.get(tuple(w[k : k + run]), ())}
    return out


def test_against_brute_force(spark, monkeypatch):
    rnd = random.Random(9)
    word = lambda: rnd.choice("ab cd ef gh ij kl mn".split())
    docs = [(i, " ".join(word() for _ in range(rnd.randrange(400)))) for i in range(60)] + [(100, None), (101, ""), (None, "ab " * 50), (102, "ab " * 5000), (102, "ab cd")]
    items = [(i, " ".join(word() for _ in range(rnd.randrange(3, 12)))) for i in range(80)] + [(90, None), (91, ""), (92, "AB ab Ab aB ab ab"), (93, "ab ab ab ab ab ab")]
    d, e = spark.createDataFrame(docs, "id int, text string"), spark.createDataFrame(items, "n int, t string")
    want = brute([x for x in docs if x[0] is not None and x[1]], [x for x in items if x[1]], 5)
    assert {tuple(r) for r in leaks.leaks(d, "id", "text", e, "n", "t", 5).collect()} == want
    monkeypatch.setattr(leaks, "BLOCK_WORDS", 50)
    assert {tuple(r) for r in leaks.leaks(d, "id", "text", e, "n", "t", 5).collect()} == want
    assert leaks.leaks(d, "id", "text", e.limit(0), "n", "t").count() == 0
    assert leaks.leaks(d.limit(0), "id", "text", e, "n", "t").count() == 0


def test_small_tables_and_spans(spark):
    d, e = spark.read.parquet(f"{SMALL}/documents.parquet"), spark.read.parquet(f"{SMALL}/eval_items.parquet")
    docs, items = {r["doc_id"]: r["text"] for r in d.collect()}, [(r["item_id"], r["text"]) for r in e.collect()]
    want = brute(docs.items(), items, 12)
    assert {tuple(r) for r in leaks.leaks(d, "doc_id", "text", e, "item_id", "text").collect()} == want and want
    spans = leaks.removal_spans(d, "doc_id", "text", e, "item_id", "text").collect()
    assert {(r["doc_id"], i) for r in spans for i in r["item_ids"]} == want
    for r in spans:
        cut = docs[r["doc_id"]][r["start_char"] : r["end_char"]]
        assert r["n_words"] >= 12 and brute([(0, cut)], items, 12)


def test_spans_do_not_depend_on_blocks_or_shards(monkeypatch):
    rnd = random.Random(10)
    vocab = "ab cd ef gh ij kl İb".split()
    docs = [(i, " ".join(rnd.choice(vocab) for _ in range(rnd.randrange(300)))) for i in range(40)] + [(50, "ab cd " * 400)]
    items = [(i, " ".join(rnd.choice(vocab) for _ in range(rnd.randrange(3, 12)))) for i in range(200)] + [(300, "ab cd " * 4)]

    def run(block_words, shard_words, emit):
        monkeypatch.setattr(leaks, "SHARD_WORDS", shard_words)
        grams: dict = {}
        blocks = []
        for lo in range(0, len(items), block_words):
            words, grams = {}, {}
            for n, t in items[lo : lo + block_words]:
                ids = [words.setdefault(x, len(words)) for x in leaks.words_of(t)]
                for i in range(len(ids) - 4):
                    grams.setdefault(tuple(ids[i : i + 5]), set()).add(n)
            if grams:
                blocks.append(type("B", (), {"value": (list(words), np.array(list(grams)), [sorted(v) for v in grams.values()])})())
        shards = leaks._Shards(blocks, 5, emit)
        out = [r for d, t in docs for df in shards.add(d, t) for r in df.itertuples(index=False, name=None)]
        return sorted(out + [r for df in shards.finish() for r in df.itertuples(index=False, name=None)])

    want = brute(docs, items, 5)
    one = run(10_000, 1 << 20, leaks._spans)
    assert len(one) > 40 and {(r[0], i) for r in one for i in r[4]} == want
    for blocks, shards in ((7, 1 << 20), (10_000, 37), (20, 150), (3, 6)):
        assert run(blocks, shards, leaks._spans) == one
        assert set(run(blocks, shards, leaks._pairs)) == want


def test_letters_that_change_length_in_lower_case(spark):
    item = "one two three four five six seven eight nine ten eleven twelve"
    text = "İb İb İb " + item.upper()
    d, e = spark.createDataFrame([(1, text)], "id int, text string"), spark.createDataFrame([(7, item)], "n int, t string")
    got = leaks.removal_spans(d, "id", "text", e, "n", "t").collect()
    assert [(text[r["start_char"] : r["end_char"]], r["n_words"], r["item_ids"]) for r in got] == [(item.upper(), 12, [7])]
