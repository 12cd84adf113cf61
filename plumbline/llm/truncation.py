r"""Texts cut off by field limits or in transfer (problem 8).

Two kinds of evidence, for whole texts, in this order:

* Near-copies, for every text whose article isn't closed. Min-hash banding by windows: of every WINDOW shingles (five
  words) in a row the least hash is taken, and two of them that follow each other make a band, so texts that share 20 words in a row share a band wherever
  those stand, and a cut text shares its bands with its copy however early it was cut. A text is compared with every
  longer text that shares SHARED of its bands, likeliest first and in growing batches, until one goes on or none is left.
  Pairs are verified by their shingles (0.8 or more of the shorter text's shingles are the other's), and the shorter
  text's ending is aligned in the longer one. If the longer text goes on in the middle of a word, sentence, formula,
  environment or entry where the shorter one stops, the shorter one was cut.
* Closing-word terminality, for the texts that no alignment shows to be cut. Each text's ending is scored: an article that is opened must be closed; environments,
  groups and formulas must be balanced; what follows the last of them must end a sentence (of any script) or be a command that stands
  alone; and the closing word must be one that ends sentences elsewhere in the corpus. Marks that tools append after a
  cut (dots, ``[truncated]``, replacement characters) are taken off first, and whatever comes after an article's close
  is ignored.

The terminality of closing words is counted over the whole corpus (a table of words, added up per word). The corpus is
read twice: for keys and endings, and for the texts of candidate pairs, which a Bloom filter of fixed size picks out
before anything is shuffled.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from plumbline.operators.lastknown import hot_keys
from plumbline.operators.skew import maybe_known, salted_join
from plumbline.session import cut

#: Words of a shingle, and least share of the shorter text's shingles for near-copies.
SHINGLE = 5
SIMILARITY = 0.8
#: A closing word counts as not terminal if it was seen so often and went on in more than half of the cases.
SEEN = 5
#: Shingles in a row of which the least one counts.
WINDOW = 8
#: Least share of a text's bands that its copy has. A shingle of a near-copy is shared with 0.8 or more, a window's least
#: one is the same in both texts if none of the shingles that differ has a lower hash (0.8 / 1.2), a band takes two.
SHARED = 0.2
#: Words before the last one that are aligned with the longer text and the largest share of them that may be edited; of
#: them the nearest ones, and how many of those may be edited.
TAIL, EDITS = 64, 0.25
CLOSE, CLOSE_EDITS = 8, 2
#: Candidates of a text in the first round of comparisons; each later round takes so many times as many as all before.
#: A round shuffles the texts once more, so there are few.
FIRST, GROWTH = 8, 256

#: Marks that tools append after a cut.
MARKS = ["…", "...", "[...]", "[…]", "[truncated]", "[cut]", "(truncated)", "\ufffd"]
_MARK = re.compile(r"(?:\s|" + "|".join(map(re.escape, sorted(MARKS, key=len, reverse=True))) + r")+\Z", re.I)
_COMMENT = re.compile(r"(?<!\\)((?:\\\\)*)%[^\n]*")
_CLOSED = re.compile(r"^[^%\n]*?\\end\s*\{document\}", re.M)
_OPENED = re.compile(r"^[^%\n]*?\\(?:begin\s*\{document\}|documentclass\b)", re.M)
_STRUCTURE = re.compile(r"\\(begin|end)\s*\{([^{}]*)\}|\\(iffalse|fi)\b|\\([\[\]()])|\\[A-Za-z]+|\\.|(\$\$?)|([{}])", re.S)
#: Ends that stand: sentence marks with closing quotes, brackets or formulas after them; a display; a command with its arguments.
_ENDS = regex.compile(r"(?:[\p{Sentence_Terminal}:][\"'$\p{Pe}\p{Pf}\p{Pi}]*|\\\]|\\\)|\$\$|\\(?:end|input|include|bibliography|bibliographystyle|label|maketitle|tableofcontents|appendix|printbibliography|fi|newpage|clearpage|cleardoublepage|noindent|par|vfill|hfill|protect)(?:\s*(?:\[[^\]]*\]|\{[^{}]*\}))*)\Z")
#: A heading or an empty entry with nothing after it.
_HEADING = re.compile(r"\\(?:(?:section|subsection|subsubsection|chapter|paragraph|part|title|author)\*?\s*(?:\[[^\]]*\]\s*)?\{(?:[^{}]|\{[^{}]*\})*\}(?:\s*\\label\s*\{[^{}]*\})?|(?:item|bibitem)\s*(?:\[[^\]]*\]\s*)?(?:\{[^{}]*\})?)\Z")
_STOPS = frozenset(regex.findall(r"\p{Sentence_Terminal}", "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))))


def closing(text: str | None) -> tuple[str, str | None]:
    """``(verdict, closing word)``: verdict is ``whole``, or what was left open: ``article, structure, mark, sentence``; or ``ends`` if only the closing word can tell."""
    if not text or not text.strip():
        return "whole", None
    if _CLOSED.search(text):
        return "whole", None
    if _OPENED.search(text):
        return "article", None
    body = _COMMENT.sub(r"\1", text)
    bare = _MARK.sub("", body)
    marked = body.rstrip() != bare
    if _open(bare):
        return "structure", None
    if marked:
        return "mark", None
    if _HEADING.search(bare) or not _ENDS.search(bare):
        return "sentence", None
    return "ends", bare.rsplit(None, 1)[-1]


def _open(text: str) -> bool:
    """Whether an environment, group, formula or switched-off passage is still open at the end."""
    stack: list[str] = []
    for m in _STRUCTURE.finditer(text):
        begin, env, switch, display, dollar, brace = m.groups()
        if begin == "begin":
            stack.append("e" + env)
        elif begin == "end":
            if "e" + env in stack:
                while stack.pop() != "e" + env:
                    pass
        elif switch == "iffalse":
            stack.append("if")
        elif switch == "fi":
            if "if" in stack:
                while stack.pop() != "if":
                    pass
        elif display in ("[", "("):
            stack.append("m" + display)
        elif display:
            want = "m" + ("[" if display == "]" else "(")
            if want in stack:
                while stack.pop() != want:
                    pass
        elif dollar:
            if dollar == "$$" and "$" in stack:
                stack.remove("$")  # the end of one formula and the start of the next
                stack.append("$")
            elif dollar in stack:
                while stack.pop() != dollar:
                    pass
            else:
                stack.append(dollar)
        elif brace == "{":
            stack.append("{")
        elif brace == "}" and "{" in stack:
            while stack.pop() != "{":
                pass
    return bool(stack)


_P = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F)


class _Known(dict):
    """The hash of each word, computed once."""

    def __missing__(self, word: str) -> int:
        import xxhash

        if len(self) > 1_000_000:
            self.clear()
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h


def _hashes(words: list[str], known: _Known):
    """The hash of each shingle of a text, in order; a text shorter than a shingle is filled up."""
    import numpy as np

    w = np.zeros(max(len(words), SHINGLE), np.uint64)
    w[: len(words)] = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
    n = len(w) - SHINGLE + 1
    h = np.zeros(n, np.uint64)
    for k in range(SHINGLE):
        h += w[k : k + n] * np.uint64(_P[k])
        h ^= h >> np.uint64(29)
    h *= np.uint64(_P[1])
    h ^= h >> np.uint64(32)
    h *= np.uint64(_P[2])
    return h


def _bands(words: list[str], known: _Known):
    """The distinct bands of a text, which has some if it has 20 words or more; None for a text without words."""
    import numpy as np

    if not words:
        return None
    low, k = _hashes(words, known), 1
    if len(low) < WINDOW:
        return np.zeros(0, np.int64)
    while k < WINDOW:  # after each step the least of twice as many in a row
        low, k = np.minimum(low[:-k], low[k:]), 2 * k
    low = low[np.concatenate([[True], low[1:] != low[:-1]])]
    bands = low[:-1] * np.uint64(_P[3]) ^ low[1:] * np.uint64(_P[4])
    return np.unique(bands ^ (bands >> np.uint64(29))).view(np.int64)


def _first_pass(batches: Iterator):
    """One row per text with its verdict and bands, and one per closing word with how often it ended or went on."""
    import pandas as pd
    import xxhash

    columns = ["doc_id", "source", "verdict", "last", "n_words", "digest", "bands", "ended", "went_on"]
    known = _Known()
    ended: dict = {}
    name = xxhash.xxh3_64_digest
    for pdf in batches:
        rows = []
        for doc, source, text in zip(pdf["doc_id"], pdf["source"], pdf["text"], strict=True):
            verdict, last = closing(text)
            words: list[str] = []
            for line in text.split("\n") if isinstance(text, str) else ():
                here = line.split()
                words += here
                # a lower-case word on the same line shows that the sentence went on
                for w, after in zip(here, here[1:], strict=False):
                    if w[-1] in _STOPS and len(w) > 1:
                        ended.setdefault(w, [0, 0])[after[0].islower()] += 1
                if here and here[-1][-1] in _STOPS and len(here[-1]) > 1:
                    ended.setdefault(here[-1], [0, 0])[0] += 1
            digest = xxhash.xxh3_128_digest(text) if words else None
            rows.append((doc, source, verdict, None if last is None else name(last), len(words), digest, _bands(words, known), 0, 0))
        if len(ended) > 200_000:
            rows += [(None, None, "word", name(w), 0, None, None, a, b) for w, (a, b) in ended.items()]
            ended = {}
        yield pd.DataFrame(rows, columns=columns)
    yield pd.DataFrame([(None, None, "word", name(w), 0, None, None, a, b) for w, (a, b) in ended.items()], columns=columns)


def _near(a: list[str], b: list[str]) -> bool:
    """Whether SIMILARITY of the shingles of ``a`` are shingles of ``b``."""
    grams = lambda w: {tuple(w[i : i + SHINGLE]) for i in range(len(w) - SHINGLE + 1)}
    mine = grams(a)
    return len(mine & grams(b)) >= SIMILARITY * len(mine)


def goes_on(short: str, long: str) -> bool:
    """Whether ``long`` is a near-copy of ``short`` that continues in the middle of something where ``short`` ends."""
    a, b = _MARK.sub("", short).split(), long.split()
    if len(a) < 2 * SHINGLE or len(b) <= len(a) or not _near(a, b):
        return False
    last = a[-1].rstrip(".…!?")
    if not last:
        return False
    # the last word may be cut, so what stands before it is aligned, and the word is looked for where that ends
    far, close = _alignment(a[-TAIL - 1 : -1], b), _alignment(a[-CLOSE - 1 : -1], b)
    cost = [f + (j == len(b) or not b[j].startswith(last)) for j, f in enumerate(far)]
    least = min(cost)
    if least > EDITS * min(TAIL, len(a) - 1):
        return False
    return all(close[j] <= CLOSE_EDITS and _open_at(a[-1], last, b, j) for j, c in enumerate(cost) if c == least)


def _open_at(word: str, last: str, b: list[str], j: int) -> bool:
    """Whether ``b`` goes on at its word ``j``, where the other text stops with ``word`` (``last`` without its marks)."""
    if j == len(b) or not b[j].startswith(last) or b[j] == word:
        return False  # the same last word: the longer text may simply have one more passage
    rest = b[j][len(last) :]
    return not re.match(r"[.!?:;]", rest) and (bool(rest) or j + 1 < len(b))


def _alignment(tail: list[str], b: list[str]) -> list[int]:
    """The fewest edits (words added, left out or replaced) between ``tail`` and a passage of ``b`` that ends before its word j, for each j."""
    import numpy as np

    number = {w: i for i, w in enumerate(dict.fromkeys(tail))}
    other = np.array([number.get(w, -1) for w in b])
    at = np.arange(len(b) + 1)
    d = np.zeros(len(b) + 1, np.int64)
    for w in tail:
        e = d + 1
        e[1:] = np.minimum(e[1:], d[:-1] + (other != number[w]))
        d = np.minimum.accumulate(e - at) + at
    return d.tolist()


def _second_pass(batches: Iterator):
    for pdf in batches:
        yield pdf[[goes_on(s, t) for s, t in zip(pdf["text"], pdf["long"], strict=True)]][["doc_id"]]


def _candidates(texts: DataFrame) -> DataFrame:
    """``doc_id, other, place``: the longer texts that share enough bands with one whose article isn't closed, likeliest first.

    A text has to share ``least`` of its bands. So half as many, the most frequent ones, can be left out, as the rest of
    ``least`` must be shared among the others: bands of what everybody writes make no pairs unless the text has no others.
    """
    short = (F.col("verdict") != "whole") & (F.col("n_words") >= 2 * SHINGLE)
    least = F.ceil(F.lit(SHARED) * F.size("bands")).cast("int")
    bands = texts.where("bands is not null and doc_id is not null").select("doc_id", "n_words", least.alias("least"), short.alias("short"), F.explode("bands").alias("print")).repartition("print")
    same = Window.partitionBy("print")
    met = bands.withColumns({"n": F.count(F.lit(1)).over(same), "any": F.max("short").over(same)}).where("n > 1 and any").drop("any")
    met = cut(met)
    frequent = F.row_number().over(Window.partitionBy("doc_id").orderBy(F.col("n").desc(), "print"))
    shorts = met.where("short").withColumn("r", frequent).where("r > least div 2").select("doc_id", "n_words", "least", "print")
    others = met.select("print", F.col("doc_id").alias("other"), F.col("n_words").alias("m"))
    pairs = salted_join(shorts, others, "print").where("m > n_words").groupBy("doc_id", "other").agg(F.countDistinct("print").alias("shared"), F.max("m").alias("m"), F.max("least").alias("least"))
    likeliest = Window.partitionBy("doc_id").orderBy(F.col("shared").desc(), F.col("m").desc(), "other")
    return cut(pairs.where("shared >= least - least div 2").select("doc_id", "other", F.row_number().over(likeliest).alias("place")))


def _going_on(pairs: DataFrame, held: DataFrame, kind: str) -> DataFrame:
    """The texts that one of their candidates goes on from. Those without a match meet further candidates until none is left."""
    found = pairs.select("doc_id").limit(0)
    longs = held.select(F.col("doc_id").alias("other"), F.col("text").alias("long"))
    done, upto, last = 0, FIRST, pairs.agg(F.max("place")).first()[0] or 0
    while done < last:
        now = cut(pairs.where(F.col("place").between(done + 1, upto)).join(found, "doc_id", "left_anti").select("doc_id", "other"))
        # one text may be a candidate of a third of all: its followers are spread
        got = salted_join(held.join(now, "doc_id"), longs, "other", hot=hot_keys(now, "other")).select("doc_id", "text", "long").mapInPandas(_second_pass, f"doc_id {kind}").distinct()
        found = cut(found.unionByName(got))
        done, upto = upto, upto + GROWTH * upto
    return found


def find_truncated(docs: DataFrame, doc_id: str, source: str, text: str) -> DataFrame:
    """Every row of ``docs`` as ``doc_id, source, evidence``: null, or why the text counts as cut.

    Evidence: ``copy`` (a near-copy goes on), else ``article`` (opened, never closed), ``structure``, ``mark``,
    ``sentence``, ``word`` (the closing word goes on elsewhere). Null and blank texts are not cut; exact copies get the same
    evidence; rows with null ids stay (without the evidence of copies), repeated rows too. Texts of any length are read
    whole. An empty table gives no rows; further columns are not looked at.
    """
    kind = dict(docs.dtypes)[doc_id]
    base = docs.select(F.col(doc_id).alias("doc_id"), F.col(source).alias("source"), F.col(text).alias("text"))
    both = cut(base.mapInPandas(_first_pass, f"doc_id {kind}, source string, verdict string, last binary, n_words int, digest binary, bands array<long>, ended long, went_on long"))
    texts = both.where("verdict <> 'word'")
    # near-copies: exact copies stand for each other
    first = texts.where("digest is not null and doc_id is not null").groupBy("digest").agg(F.min("doc_id").alias("as"), F.count(F.lit(1)).alias("k")).where("k > 1").drop("k")
    repeats = cut(salted_join(texts.where("doc_id is not null").select("digest", "doc_id"), first, "digest").where(F.col("doc_id") != F.col("as")).select("doc_id", "as"))
    repeated = maybe_known(texts, "doc_id", repeats)
    pairs = _candidates(texts.where(~repeated).unionByName(texts.where(repeated).join(repeats, "doc_id", "left_anti")))
    needed = pairs.select("doc_id").union(pairs.select("other")).distinct()
    held = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    held = held.where(maybe_known(held, "doc_id", needed)).join(needed, "doc_id", "left_semi")
    copies = _going_on(pairs, cut(held), kind)
    copies = copies.unionByName(salted_join(repeats, copies.withColumnRenamed("doc_id", "as"), "as", "left_semi").select("doc_id")).distinct().withColumn("copy", F.lit(True))
    # what no alignment shows to be cut is scored by its ending
    words = both.where("verdict = 'word'").groupBy("last").agg(F.sum("ended").alias("ended"), F.sum("went_on").alias("went_on"))
    loose = words.where((F.col("ended") + F.col("went_on") >= SEEN) & (F.col("went_on") > F.col("ended"))).select("last", F.lit(True).alias("loose"))
    out = salted_join(texts.select("doc_id", "source", "verdict", "last"), loose, "last", "left").join(copies, "doc_id", "left")
    scored = F.when(~F.col("verdict").isin("whole", "ends"), F.col("verdict")).when(F.col("loose"), "word")
    return out.select("doc_id", "source", F.when(F.col("copy"), "copy").otherwise(scored).alias("evidence"))


def truncation_rates(found: DataFrame) -> DataFrame:
    """``source, n_docs, n_cut, cut_share`` per source (a null source is one of them)."""
    return found.groupBy("source").agg(F.count(F.lit(1)).alias("n_docs"), F.count("evidence").alias("n_cut")).withColumn("cut_share", F.col("n_cut") / F.col("n_docs"))
