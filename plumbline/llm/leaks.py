r"""Evaluation passages inside a training corpus (problem 6).

A document leaks an item if both share a run of at least ``run`` consecutive words. Words are runs of letters and
digits without regard to case; names of TeX commands, and the arguments of ``\cite, \ref, \eqref, \label, \input,
\include``, are no words.

Every partition of the corpus is indexed in shards, with all its words, so an index answers any item set: the shard's
words become a Burrows-Wheeler transform with a wavelet matrix. All test phrases (each item's windows of ``run`` words)
are searched backward at once through its ranks, and occurrences are located from sampled suffix positions. A shard is
indexed once and searched by one block of items after the other; what all blocks found in a document is merged before
it comes out, so blocks and shards don't show in the result. A text longer than a shard is indexed in pieces that
overlap by ``run - 1`` words. The corpus is neither shuffled nor collected, and is read once: only the items, a stated
query set, are sent to the tasks, in blocks of at most BLOCK_WORDS words, of which driver and tasks hold one at a time.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Words of items searched at once: a block is at most some tens of MB.
BLOCK_WORDS = 500_000
#: A shard ends at so many indexed words, or so many characters of text.
SHARD_WORDS = 1 << 20
SHARD_CHARS = 16 << 20
#: Every so many positions of a run of words has its place stored.
SAMPLE = 8

_COMMAND = re.compile(r"\\(?:(?:cite|ref|eqref|label|input|include)(?![A-Za-z])\*?\s*(?:\[[^\]]*\]\s*)*\{[^{}]*\}|[A-Za-z]+\*?|.)", re.S)
_WORD = re.compile(r"[^\W_]+")
_OTHER = bytes(c if chr(c).isalnum() and c < 128 else 32 for c in range(128)).lower() + bytes(range(128, 256))


def words_of(text: str | None) -> list:
    """The words of a text, lower case; as bytes where the text is ASCII."""
    if not text:
        return []
    bare = _COMMAND.sub(" ", text) if "\\" in text else text
    if bare.isascii():
        return bare.encode("ascii").translate(_OTHER).split()
    # lower case may change a word's length, so it is applied to whole words
    return [w.lower().encode() for w in _WORD.findall(bare)]


def word_spans(text: str) -> list[tuple[int, int]]:
    """The character offsets of each word of ``words_of``."""
    # a command is replaced by as many blanks, so offsets stay
    return [m.span() for m in _WORD.finditer(_COMMAND.sub(lambda m: " " * len(m.group()), text))]


class ShardIndex:
    """An FM-index over runs of positive word ids, each followed by a terminator of its own."""

    def __init__(self, runs: list, top: int):
        import numpy as np

        self.np = np
        lens = np.array([len(r) for r in runs], np.int64)
        self.starts = np.concatenate([[0], np.cumsum(lens + 1)])[:-1]
        n = int((lens + 1).sum())
        text = np.zeros(n, np.int64)
        for s, r in zip(self.starts, runs, strict=True):
            text[s : s + len(r)] = r
        ends = text == 0
        n_ends = int(ends.sum())
        rank = text + n_ends - 1
        rank[ends] = np.arange(n_ends)  # terminators differ, so no comparison goes past the end of a run
        sa = self._suffixes(rank, n_ends + top + 1)
        self.n = n
        bwt = text[sa - 1]
        counts = np.bincount(text, minlength=top + 2)
        self.before = np.concatenate([[0], np.cumsum(counts)])  # how many symbols are smaller
        self.levels = max(1, int(top + 1).bit_length())
        self.bits, self.sums, self.zeros = [], [], []
        cur = bwt
        for level in range(self.levels - 1, -1, -1):
            bit = (cur >> level) & 1
            words = np.packbits(np.concatenate([bit.astype(np.uint8), np.zeros(64 - n % 64 if n % 64 else 64, np.uint8)]), bitorder="little").view(np.uint64)
            self.bits.append(words)
            self.sums.append(np.concatenate([[0], np.cumsum(np.bitwise_count(words).astype(np.int64))]))
            self.zeros.append(int(n - bit.sum()))
            cur = np.concatenate([cur[bit == 0], cur[bit == 1]])
        self.bwt = bwt
        place = sa - self.starts[np.searchsorted(self.starts, sa, side="right") - 1]
        keep = place % SAMPLE == 0
        self.kept = np.cumsum(keep) - 1
        self.is_kept, self.positions = keep, sa[keep]

    def _suffixes(self, rank, base: int):
        """The suffix order by prefix doubling: after the first few symbols only suffixes that are still tied are sorted."""
        np = self.np
        n = len(rank)
        k = 3 if base < 1 << 20 else 1
        first = rank
        for j in range(1, k):
            first = first * base
            first[:-j] += rank[j:]
        sa = np.argsort(first)
        new = np.concatenate([[True], first[sa[1:]] != first[sa[:-1]]])
        at = np.arange(n)
        # the rank of a suffix is the place where its group of equals starts
        start = np.maximum.accumulate(np.where(new, at, 0))
        rank = np.empty(n, np.int64)
        rank[sa] = start
        tied = np.flatnonzero(~(new & np.concatenate([new[1:], [True]])))
        while len(tied):
            pos = sa[tied]
            after = np.where(pos + k < n, rank[np.minimum(pos + k, n - 1)] + 1, 0)
            both = rank[pos] * (n + 1) + after
            order = np.argsort(both)
            both, pos = both[order], pos[order]
            sa[tied] = pos
            new = np.concatenate([[True], both[1:] != both[:-1]])
            rank[pos] = np.maximum.accumulate(np.where(new, tied, 0))
            tied = tied[~(new & np.concatenate([new[1:], [True]]))]
            k *= 2
        return sa

    def _ones(self, level: int, i):
        w = i >> 6
        mask = (self.np.uint64(1) << (i & 63).astype(self.np.uint64)) - self.np.uint64(1)
        return self.sums[level][w] + self.np.bitwise_count(self.bits[level][w] & mask).astype(self.np.int64)

    def rank(self, symbol, i):
        """How often each symbol occurs in the transform before each index."""
        np = self.np
        low = np.zeros_like(i)
        for at in range(self.levels):
            bit = ((symbol >> (self.levels - 1 - at)) & 1).astype(bool)
            up_i, up_low = self._ones(at, i), self._ones(at, low)
            i = np.where(bit, self.zeros[at] + up_i, i - up_i)
            low = np.where(bit, self.zeros[at] + up_low, low - up_low)
        return i - low

    def search(self, phrases):
        """``phrases``: rows of ids. The interval of suffixes that start with each phrase (empty: low = high)."""
        np = self.np
        m = len(phrases)
        low, high = np.zeros(m, np.int64), np.full(m, self.n, np.int64)
        live = np.arange(m)
        for col in range(phrases.shape[1] - 1, -1, -1):
            c = phrases[live, col]
            low[live] = self.before[c] + self.rank(c, low[live])
            high[live] = self.before[c] + self.rank(c, high[live])
            live = live[low[live] < high[live]]
            if not len(live):
                break
        done = np.zeros(m, bool)
        done[live] = True
        return np.where(done, low, 0), np.where(done, high, 0)

    def locate(self, rows):
        """Text positions of suffixes: step back through the transform to a stored position."""
        np = self.np
        rows, steps = rows.copy(), np.zeros(len(rows), np.int64)
        todo = np.flatnonzero(~self.is_kept[rows])
        while len(todo):
            c = self.bwt[rows[todo]]
            rows[todo] = self.before[c] + self.rank(c, rows[todo])
            steps[todo] += 1
            todo = todo[~self.is_kept[rows[todo]]]
        return self.positions[self.kept[rows]] + steps


class _Words(dict):
    """Numbers from 1 for the words of a shard."""

    def __missing__(self, word):
        self[word] = n = len(self) + 1
        return n


class _Shards:
    """Cuts a partition into shards, indexes each once, searches all blocks of items, and gives each document's hits together."""

    def __init__(self, blocks: list, run: int, emit):
        self.blocks, self.run, self.emit = blocks, run, emit
        self.docs: dict[int, tuple] = {}
        self.hits: dict[int, list] = {}
        self.seen = 0
        self._clear()

    def _clear(self):
        self.vocab, self.runs, self.owner, self.offset, self.n_words, self.n_chars = _Words(), [], [], [], 0, 0

    def add(self, doc, text) -> Iterator:
        import numpy as np

        found = words_of(text)
        if len(found) < self.run:
            return
        at, self.seen = self.seen, self.seen + 1
        self.docs[at] = (doc, text)
        self.n_chars += len(text)
        for b in range(0, len(found) - self.run + 1, SHARD_WORDS):
            piece = found[b : b + SHARD_WORDS + self.run - 1]
            self.runs.append(np.fromiter(map(self.vocab.__getitem__, piece), np.int64, len(piece)))
            self.owner.append(at)
            self.offset.append(b)
            self.n_words += len(piece) + 1
            if self.n_words >= SHARD_WORDS or self.n_chars >= SHARD_CHARS:
                last = b + SHARD_WORDS > len(found) - self.run
                self._search()
                if last:
                    yield from self.finish()
        # documents whose pieces are all searched come out with the shard

    def _search(self):
        import numpy as np

        index = ShardIndex(self.runs, len(self.vocab))
        owner, offset, get = np.asarray(self.owner), np.asarray(self.offset), self.vocab.get
        for block in self.blocks:
            words, phrases, owners = block.value
            own = np.fromiter((get(w, 0) for w in words), np.int64, len(words))[phrases]
            known = np.flatnonzero((own > 0).all(1))
            low, high = index.search(own[known])
            count = high - low
            which = known[np.repeat(np.arange(len(known)), count)]
            if len(which):
                rows = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + np.repeat(low, count)
                at = index.locate(rows)
                seg = np.searchsorted(index.starts, at, side="right") - 1
                for o, f, p in zip(owner[seg].tolist(), (offset[seg] + at - index.starts[seg]).tolist(), which.tolist(), strict=True):
                    self.hits.setdefault(o, []).append((f, owners[p]))
            if len(self.blocks) > 1:
                block.__dict__.pop("_value", None)  # read again for the next shard, so that one block is held at a time
        self._clear()

    def finish(self) -> Iterator:
        """What ``emit`` makes of the documents that have hits."""
        if self.runs:
            self._search()
        if self.hits:
            yield self.emit([(*self.docs[o], h) for o, h in sorted(self.hits.items())], self.run)
        self.docs, self.hits = {}, {}


def _pairs(found: list[tuple], run: int):
    import pandas as pd

    return pd.DataFrame(sorted({(doc, i) for doc, _, hits in found for _, items in hits for i in items}), columns=["doc_id", "item_id"])


def _spans(found: list[tuple], run: int):
    """Merged character spans of each document, with the items found in them."""
    import pandas as pd

    out = []
    for doc, text, hits in found:
        at = word_spans(text)
        merged: list[list] = []
        for b, items in sorted(hits):
            if merged and b <= merged[-1][1]:
                merged[-1][1] = max(b + run, merged[-1][1])
            else:
                merged.append([b, b + run, set()])
            merged[-1][2].update(items)
        out += [(doc, at[b][0], at[e - 1][1], e - b, sorted(s)) for b, e, s in merged]
    return pd.DataFrame(out, columns=["doc_id", "start_char", "end_char", "n_words", "item_ids"])


def _blocks(items: DataFrame, item_id: str, text: str, run: int) -> Iterator[tuple]:
    """(words, phrases as rows of word numbers, items of each phrase) of one block of items after the other."""
    import numpy as np

    def block():
        return list(words), np.array(list(phrases), np.int32), [sorted(v) for v in phrases.values()]

    words: dict = {}
    phrases: dict = {}
    size = 0
    rows = items.where(F.col(item_id).isNotNull() & F.col(text).isNotNull()).select(item_id, text).toLocalIterator()
    for r in rows:
        w = words_of(r[1])
        if len(w) < run:
            continue
        for b in range(0, len(w) - run + 1, BLOCK_WORDS):
            ids = [words.setdefault(x, len(words)) for x in w[b : b + BLOCK_WORDS + run - 1]]
            for i in range(len(ids) - run + 1):
                phrases.setdefault(tuple(ids[i : i + run]), set()).add(r[0])
            size += len(ids)
            if size >= BLOCK_WORDS:
                yield block()
                words, phrases, size = {}, {}, 0
    if phrases:
        yield block()


def _search(corpus: DataFrame, doc_id: str, text: str, items: DataFrame, item_id: str, item_text: str, run: int, emit, schema: str) -> DataFrame:
    src = corpus.where(F.col(doc_id).isNotNull() & F.col(text).isNotNull()).select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    blocks = [corpus.sparkSession.sparkContext.broadcast(b) for b in _blocks(items, item_id, item_text, run)]
    if not blocks:
        return corpus.sparkSession.createDataFrame([], schema)

    def task(batches):
        shards = _Shards(blocks, run, emit)
        for pdf in batches:
            for doc, t in zip(pdf["doc_id"].tolist(), pdf["text"].tolist(), strict=True):
                yield from shards.add(doc, t)
        yield from shards.finish()

    return src.mapInPandas(task, schema)


def leaks(corpus: DataFrame, doc_id: str, text: str, items: DataFrame, item_id: str, item_text: str, run: int = 12) -> DataFrame:
    """Distinct (``doc_id``, ``item_id``) that share a run of at least ``run`` words.

    Null ids and texts, empty texts and texts or items of fewer than ``run`` words leak nothing. Documents with the
    same id count as one; items that share a phrase are each reported. Texts of any length are searched whole. Without
    documents or items there are no rows; further columns, whatever their names, are not looked at.
    """
    kinds = f"doc_id {dict(corpus.dtypes)[doc_id]}, item_id {dict(items.dtypes)[item_id]}"
    return _search(corpus, doc_id, text, items, item_id, item_text, run, _pairs, kinds).distinct()


def removal_spans(corpus: DataFrame, doc_id: str, text: str, items: DataFrame, item_id: str, item_text: str, run: int = 12) -> DataFrame:
    """Per document the merged character spans [``start_char``, ``end_char``) to remove, with ``n_words`` and the ``item_ids``.

    One row per document row and span. Spans that overlap or touch are one, whichever items and blocks they come from.
    """
    kinds = f"doc_id {dict(corpus.dtypes)[doc_id]}, start_char int, end_char int, n_words int, item_ids array<{dict(items.dtypes)[item_id]}>"
    return _search(corpus, doc_id, text, items, item_id, item_text, run, _spans, kinds)
