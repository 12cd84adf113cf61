import random

import pytest
from pyspark.sql import functions as F

from plumbline.llm import truncation as tr
from tests.conftest import SMALL

WHOLE = [
    "\\documentclass{article}\n\\begin{document}\nText.\n\\end{document}\n% after the",
    "\\section{A}\nOne thing follows.\n\\input{parts/x}\n",
    "\\section{A}\nSo it goes, and so on \\ldots.\n",
    "\\section{A}\n\\begin{itemize}\n\\item One.\n\\end{itemize}\n\\[ a = b \\]\n",
    "\\section{A}\nAt $5\\%$.\n% a draft that stops\n\n",
    "\\section{A}\nDoes it hold?",
    "\\textbf{T} Works (well).",
    "一句话到此结束。",
    "「一句话。」",
    "यह वाक्य पूरा है।",
    "Works (well.)",
    "",
    "  ",
    None,
]
CUT = [
    "\\documentclass{article}\n\\begin{document}\nText.\n",
    "\\documentclass{article}\n\\begin{document}\nText. % \\end{document}\n",
    "\\section{A}\nOne thing fol",
    "\\section{A}\nOne thing follows [...]",
    "\\section{A}\nOne thing follows the\n[truncated]",
    "\\section{A}\nOne thing follows th…",
    "\\section{A}\n\\begin{itemize}\n\\item One.\n",
    "\\section{A}\nThe value is $a + b.",
    "\\section{A}\nSee \\emph{this.",
    "\\section{A}\n\\iffalse old.",
    "\\section{A}\nOne,",
    "\\section{A}\nOne.\n\\section{B",
    "\\section{A}\nOne.\n\\section{B}",
]


@pytest.mark.parametrize("text", WHOLE)
def test_whole(text):
    assert tr.closing(text)[0] in ("whole", "ends")


@pytest.mark.parametrize("text", CUT)
def test_cut(text):
    assert tr.closing(text)[0] not in ("whole", "ends")


def test_evidence_from_copies_and_words(spark):
    rnd = random.Random(12)
    vocab = [f"w{i}" for i in range(400)]
    body = lambda n: " ".join(rnd.choice(vocab) for _ in range(n))
    long = body(150)
    words = long.split()
    rows = [
        (1, "a", "\\section{X}\n" + long + ". And it ends."),
        (2, "b", "\\section{X}\n" + " ".join(words[:140]) + "."),  # a full stop was appended to a cut
        (3, "b", "\\section{X}\n" + long + "."),  # the same, without the last sentence
        (4, "a", "Another " + body(60) + " etc."),
        (5, None, "cut off in the mid"),
        (6, "c", None),
        (7, "c", ""),
        (1, "a", "\\section{X}\n" + long + ". And it ends."),
    ] + [(100 + i, "c", f"Things etc. like {body(30)} stop here.") for i in range(6)]
    df = spark.createDataFrame(rows, "id long, src string, text string")
    got = tr.find_truncated(df, "id", "src", "text")
    assert {(r["doc_id"], r["evidence"]) for r in got.collect() if r["evidence"]} == {(2, "copy"), (4, "word"), (5, "sentence")}
    assert got.count() == len(rows)
    rates = {r["source"]: (r["n_docs"], r["n_cut"]) for r in tr.truncation_rates(got).collect()}
    assert rates == {"a": (3, 1), "b": (2, 1), "c": (8, 0), None: (1, 1)}
    assert tr.find_truncated(df.limit(0), "id", "src", "text").count() == 0


def test_small_tables(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    got = tr.find_truncated(docs, "doc_id", "source", "text").collect()
    assert len(got) == docs.count() and 0 < sum(bool(r["evidence"]) for r in got) < len(got) / 4


def test_copies_that_are_not_the_longest_of_their_bucket(spark):
    rnd = random.Random(15)
    vocab = [f"w{i}" for i in range(4000)]
    words = [rnd.choice(vocab) for _ in range(200)]
    # longer versions with other endings lead every bucket; only the shorter full copy goes on where the first was cut
    rows = [(1, " ".join(words[:192]) + "."), (2, " ".join(words) + ".")]
    rows += [(10 + i, " ".join(words[:191] + [rnd.choice(vocab) for _ in range(20)]) + ".") for i in range(30)]
    rows += [(4, rows[0][1]), (5, " ".join(rnd.choice(vocab) for _ in range(100)) + ".")]
    df = spark.createDataFrame(rows, "id long, text string").withColumn("src", F.lit("a"))
    got = {r["doc_id"] for r in tr.find_truncated(df, "id", "src", "text").where("evidence = 'copy'").collect()}
    assert got == {1, 4}


@pytest.mark.parametrize("share", [0.6, 0.5, 0.3, 0.1])
def test_copies_of_early_cuts(spark, share):
    rnd = random.Random(16)
    vocab = [f"w{i}" for i in range(4000)]
    rows, opening = [], " ".join(f"common{i}" for i in range(15))
    for i in range(40):
        words = [rnd.choice(vocab) for _ in range(400)]
        edited = [rnd.choice(vocab) if k % 50 == 20 else w for k, w in enumerate(words)]
        rows += [(2 * i, f"{opening} {' '.join(words[: int(400 * share)])}."), (2 * i + 1, f"{opening} {' '.join(edited)}.")]
    df = spark.createDataFrame(rows, "id long, text string").withColumn("src", F.lit("a"))
    got = {r["doc_id"] for r in tr.find_truncated(df, "id", "src", "text").where("evidence = 'copy'").collect()}
    assert got == {2 * i for i in range(40)}


def test_bands_shared_by_near_copies_only():
    rnd, known = random.Random(17), tr._Known()
    met = tried = far = 0
    for n in [*range(40, 60), 100, 187, 500] * 8:
        a = [f"w{rnd.randrange(5000)}" for _ in range(n)]
        b = list(a)
        for k in rnd.sample(range(n), n // 40):
            b[k] = "new"
        b += ["more"] * 10
        other = [f"w{rnd.randrange(5000)}" for _ in range(n)]
        mine, theirs, strange = (set(tr._bands(t, known).tolist()) for t in (a, b, other))
        least = -(-len(mine) // 5)
        far += len(mine & strange) >= least
        if tr._near(a, b):
            tried += 1
            met += len(mine & theirs) >= least
    assert tried > 150 and met >= 0.98 * tried and far == 0
    assert tr._bands([], known) is None and len(tr._bands(["one"], known)) == 0
    # 20 words in a row share a band wherever they stand
    run = [f"r{i}" for i in range(20)]
    for _ in range(50):
        a, b = ([f"w{rnd.randrange(5000)}" for _ in range(rnd.randrange(60))] + run + [f"w{rnd.randrange(5000)}" for _ in range(rnd.randrange(60))] for _ in range(2))
        assert set(tr._bands(a, known).tolist()) & set(tr._bands(b, known).tolist())


def test_endings_are_aligned_with_edits():
    words = [f"w{i}" for i in range(120)]
    cut = " ".join(words[:100]) + "."
    for k in (95, 96, 97, 98):  # one of the last words is edited in the copy: replaced, left out, or one is added
        assert tr.goes_on(cut, " ".join(words[:k] + ["new"] + words[k + 1 :]))
        assert tr.goes_on(cut, " ".join(words[:k] + words[k + 1 :]))
        assert tr.goes_on(cut, " ".join(words[:k] + ["new"] + words[k:]))
    # the last words occur again at the end of the copy
    assert tr.goes_on(cut, " ".join(words + words[95:100]) + ".")
    # the passage ends there in the copy too, another ending, and the same ending with a passage after it
    assert not tr.goes_on(cut, cut + " And more.")
    assert not tr.goes_on(cut, " ".join(words[:99] + ["other", "end", "of", "it."]))
    assert not tr.goes_on(cut, " ".join(words[:90] + [f"x{i}" for i in range(30)]))
