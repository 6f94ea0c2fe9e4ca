"""Spelling variants: words one edit apart, found in a trie of letter-group counts, and grouped under their commonest form.

Letters fall into GROUPS groups; a word is its length and how many of its letters each group has. One replaced letter
moves one count up and one down (or none, inside a group), an inserted letter moves one up. The trie has a level for each
group's count, so a search may go one over a count once (a surplus) and one under it once (a deficit), and the words at
the leaves it reaches are verified letter by letter.

The length and the first ROUTED counts deal the words to tasks: a word is data in its own cell, and asks there and in the
few cells behind its own that one edit can reach (of the same length in lexicographic order, or one letter longer), so
that each pair meets once. A cell of more than PIECE letters is cut by a hash and its askers go to each piece; a piece is
what a task holds. In a task the search runs depth first over the levels with all askers of a block at once, an array of
(asker, node) for each budget spent. What leaves the task is one row a word: how many near words the piece had, and the
best of them.

Words are maximal runs of A-Z, a-z and U+00C0 to U+00FF; only A-Z are lower-cased. Null texts have no words. Occurrences
are counted before anything is shuffled, so a word that makes up a third of a corpus is one row a task. Rows that repeat
count each time; a null doc_id counts as an empty one. Texts of any length are read whole, words of any length are words.
An empty table gives no rows, a vocabulary without near pairs gives words without forms. Ties of the best near word go to
the smallest in code-point order. Columns other than the two named ones are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyloom.llm.shared import Store

RUN, UPPER, LOWER = "[A-Za-zÀ-ÿ]+", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SHORTEST, FEWEST, RATIO = 5, 3, 2
#: Letters by how common they are; the nth is in group n mod GROUPS, any other letter in that of its code point.
COMMON, GROUPS, ROUTED = "enirtsahdulocmgbfkpwzvyjxq", 10, 2
#: Letters of the words that a task holds as data, of the askers it takes through the trie at once, of the pairs it
#: verifies at once.
PIECE, ASKERS, PAIRS = 600_000, 1 << 18, 1 << 21


def group_of(code: int) -> int:
    at = COMMON.find(chr(code))
    return (at if at >= 0 else code) % GROUPS


GROUP = np.array([group_of(c) for c in range(256)], np.int8)
NEAR = pa.schema([("word", pa.string()), ("n_near", pa.int64()), ("best_n", pa.int64()), ("best", pa.string())])


def runs(text: Column) -> Column:
    """The words of a text: array<string>."""
    lower = lambda w: F.when(w == F.lower(w), w).otherwise(F.translate(w, UPPER, LOWER))
    return F.transform(F.regexp_extract_all(text, F.lit(f"({RUN})"), F.lit(0)), lower)


def vocabulary(words: DataFrame, word: str = "word", shortest: int = SHORTEST, fewest: int = FEWEST) -> DataFrame:
    """(word, n): the distinct words of some length that stand often enough."""
    rows = words.select(F.col(word).alias("word")).where(F.length("word") >= shortest)
    return rows.groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= fewest)


def _count_of(word: Column, group: int) -> Column:
    letters = "".join(chr(c) for c in range(256) if GROUP[c] == group and (chr(c) in LOWER or c >= 0xC0))
    return (F.length(word) - F.length(F.translate(word, letters, ""))).cast("int")


def _reached() -> list[tuple[int, tuple[int, ...]]]:
    """(more letters, change of the routed counts) for each cell in which a word asks; the first is its own."""
    unit = lambda g, by: tuple(by if i == g else 0 for i in range(ROUTED))
    none, over, under = (0,) * ROUTED, [unit(g, 1) for g in range(ROUTED)], [unit(g, -1) for g in range(ROUTED)]
    both = [tuple(map(sum, zip(u, d))) for g, u in enumerate(over) for h, d in enumerate(under) if g != h]
    return [(0, none)] + [(0, c) for c in over + under + both if c > none] + [(1, c) for c in [none, *over]]


REACHED = _reached()


class Trie:
    """Distinct words of one length as a trie over their counts of groups ROUTED and later, in arrays of edges."""

    def __init__(self, letters: np.ndarray):
        counts = self.counts(letters)
        self.order = np.lexsort(counts.T[::-1])
        counts = counts[self.order]
        self.pairs = max(PAIRS // max(letters.shape[1], 1), 1)
        self.wide = letters.shape[1] + 3  # larger than any count that an asker can look for
        node, self.edges = np.zeros(len(counts), np.int64), []
        for level in range(counts.shape[1]):
            key = node * self.wide + counts[:, level] + 1
            new = np.r_[True, key[1:] != key[:-1]]
            self.edges.append(key[new])
            node = np.cumsum(new) - 1
        self.first = np.flatnonzero(np.r_[True, node[1:] != node[:-1]])  # the words of a leaf are a range of the order
        self.last = np.r_[self.first[1:], len(node)]

    @staticmethod
    def counts(letters: np.ndarray) -> np.ndarray:
        groups = GROUP[letters]
        return np.stack([(groups == g).sum(axis=1) for g in range(ROUTED, GROUPS)], axis=1)

    def search(self, counts: np.ndarray, surplus: int, deficit: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(asker, word) of every leaf that spends at most the budgets; words as rows of what the trie was made from."""
        stack = [(0, np.arange(len(counts)), np.zeros(len(counts), np.int64), surplus, deficit)]
        while stack:
            level, asker, node, up, down = stack.pop()
            if level == len(self.edges):
                yield from self._leaves(asker, node)
                continue
            edges = self.edges[level]
            for step in (0, 1, -1):
                if (step > 0 and not up) or (step < 0 and not down):
                    continue
                key = node * self.wide + counts[asker, level] + step + 1
                at = np.minimum(np.searchsorted(edges, key), len(edges) - 1)
                there = edges[at] == key
                if there.any():
                    stack.append((level + 1, asker[there], at[there], up - (step > 0), down - (step < 0)))

    def _leaves(self, asker: np.ndarray, leaf: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        size = self.last[leaf] - self.first[leaf]
        ends = np.cumsum(size)
        lo = 0
        while lo < len(size):  # bounded numbers of pairs; a leaf that is larger than the bound goes alone
            hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + self.pairs, "right")))
            n = size[lo:hi]
            within = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            yield np.repeat(asker[lo:hi], n), self.order[np.repeat(self.first[leaf[lo:hi]], n) + within]
            lo = hi


def one_edit(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Of rows of letters, whether b is a with one letter replaced, or (one column wider) with one letter inserted."""
    if a.shape[1] == b.shape[1]:
        return (a != b).sum(axis=1) == 1
    ahead, behind = a == b[:, :-1], a == b[:, 1:]
    same_before = np.c_[np.ones(len(a), bool), np.logical_and.accumulate(ahead, axis=1)]
    same_after = np.c_[np.logical_and.accumulate(behind[:, ::-1], axis=1)[:, ::-1], np.ones(len(a), bool)]
    return (same_before & same_after).any(axis=1)


def _letters(words: np.ndarray, length: int) -> np.ndarray:
    """Latin-1 letters, one row a word."""
    return np.frombuffer(b"".join(w.encode("latin-1") for w in words), np.uint8).reshape(len(words), length)


def _priority(words: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each word's place when the most frequent come first, ties in code-point order; and the words in this order."""
    order = np.lexsort((words, -n))
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    return place, order


def _rows(words: np.ndarray, near: np.ndarray, best_n: np.ndarray, best: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(words, pa.string()), pa.array(near, pa.int64()), pa.array(best_n, pa.int64()), pa.array(best, pa.string())], schema=NEAR)


class _Piece:
    """The data of a piece: a trie of its words, and of each of them how many near words asked and the best of these."""

    def __init__(self, words: np.ndarray, n: np.ndarray, length: int):
        self.words, self.n, self.length, self.letters = words, n, length, _letters(words, length)
        self.trie, (self.place, self.order) = Trie(self.letters), _priority(words, n)
        self.near, self.best_n, self.best = np.zeros(len(n), np.int64), np.zeros(len(n), np.int64), np.full(len(n), "", object)

    def meet(self, asks: int, words: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
        """The rows of a block of askers; what they are to the data is kept for `rows`."""
        longer, change = REACHED[asks]
        asked, pairs = _letters(words, self.length - longer), []
        for a, b in self.trie.search(Trie.counts(asked), 1 - (1 in change), 1 - longer - (-1 in change)):
            if asks == 0:  # both ask in their own cell: the smaller one counts
                once = (words[a] < self.words[b]).astype(bool)
                a, b = a[once], b[once]
            near = one_edit(asked[a], self.letters[b])
            pairs.append((a[near], b[near]))
        a, b = (np.concatenate(x) for x in zip(*pairs)) if pairs else (np.zeros(0, np.int64),) * 2
        at = np.unique(a)
        best = np.full(len(words), len(self.words), np.int64)
        np.minimum.at(best, a, self.place[b])
        mine = self.order[best[at]]
        if len(at):
            self._keep(b, np.searchsorted(at, a), words[at], n[at])
        return _rows(words[at], np.bincount(a, minlength=len(words))[at], self.n[mine], self.words[mine])

    def _keep(self, at: np.ndarray, by: np.ndarray, words: np.ndarray, n: np.ndarray) -> None:
        """Data words `at` are near to `by`, places in words and n."""
        self.near += np.bincount(at, minlength=len(self.near))
        (place, order), touched = _priority(words, n), np.unique(at)
        best = np.full(len(self.words), len(words), np.int64)
        np.minimum.at(best, at, place[by])
        new = order[best[touched]]
        better = (n[new] > self.best_n[touched]) | ((n[new] == self.best_n[touched]) & (words[new] < self.best[touched]).astype(bool))
        self.best_n[touched[better]], self.best[touched[better]] = n[new[better]], words[new[better]]

    def rows(self) -> pa.RecordBatch:
        some = self.near > 0
        return _rows(self.words[some], self.near[some], self.best_n[some], self.best[some])


def _searched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (cell columns, asks, word, n), sorted: the data of a piece (asks -1), then its askers by their place in REACHED."""
    at, words, counts, data = None, [], [], None
    for batch in batches:
        cell = np.stack([batch.column(i).to_numpy(zero_copy_only=False) for i in range(ROUTED + 3)], axis=1)
        columns = [batch.column(ROUTED + 3 + i).to_numpy(zero_copy_only=False) for i in range(2)]
        cuts = np.flatnonzero((cell[1:] != cell[:-1]).any(axis=1)) + 1
        for lo, hi in zip(np.r_[0, cuts], np.r_[cuts, len(cell)]):
            if lo == hi:
                continue
            key, asks = tuple(cell[lo, :-1]), int(cell[lo, -1])
            if key != at:
                if data is not None:
                    yield data.rows()
                at, words, counts, data = key, [], [], None
            if asks < 0:
                words.append(columns[0][lo:hi])
                counts.append(columns[1][lo:hi])
                continue
            if not words and data is None:
                continue  # a piece without data
            if data is None:
                data, words, counts = _Piece(np.concatenate(words), np.concatenate(counts), int(key[0])), [], []
            block = max(ASKERS // max(int(key[0]), 1), 1)
            for part in range(lo, hi, block):
                yield data.meet(asks, *(c[part : min(part + block, hi)] for c in columns))
    if data is not None:
        yield data.rows()


def near_words(words: DataFrame, piece: int = PIECE) -> DataFrame:
    """(word, n_near, best_n, best) for each of the distinct words (word, n) that has a near one: how many it has, and the
    most frequent of them, ties to the smallest. The table is read more than once: give a stored one."""
    c = [f"c{g}" for g in range(ROUTED)]
    cells = words.select("word", "n", F.length("word").alias("len"), *(_count_of(F.col("word"), g).alias(c[g]) for g in range(ROUTED)))
    pieces = cells.groupBy("len", *c).agg(F.ceil(F.count("*") * F.col("len") / piece).cast("int").alias("pieces"))
    home = cells.join(pieces, ["len", *c]).select("len", *c, F.pmod(F.xxhash64("word"), F.col("pieces")).cast("int").alias("piece"), F.lit(-1).alias("asks"), "word", "n")
    moves = F.array(*(F.struct(F.lit(k).alias("asks"), (F.col("len") + more).alias("len"), *((F.col(x) + d).alias(x) for x, d in zip(c, by))) for k, (more, by) in enumerate(REACHED)))
    asking = cells.select("word", "n", F.explode(moves).alias("to")).select("word", "n", "to.*").join(pieces, ["len", *c])
    asking = asking.select("len", *c, F.explode(F.sequence(F.lit(0), F.col("pieces") - 1)).alias("piece"), "asks", "word", "n")
    key = ["len", *c, "piece"]
    rows = home.unionByName(asking).repartition(*key).sortWithinPartitions(*key, "asks")
    found = rows.mapInArrow(_searched, "word string, n_near long, best_n long, best string")
    least = F.min(F.struct((-F.col("best_n")).alias("k"), F.col("best").alias("word")))
    return found.groupBy("word").agg(F.sum("n_near").alias("n_near"), least.alias("b")).select("word", "n_near", (-F.col("b.k")).alias("best_n"), F.col("b.word").alias("best"))


def grouped(words: DataFrame, ratio: int = RATIO, piece: int = PIECE) -> DataFrame:
    """(word, form, root, n, n_near, form_n) for the distinct words (word, n).

    A form is at least `ratio` (over 1) times as frequent as its word, so a chain of forms is at most as long as the
    logarithm of the largest frequency, and following it doubles in each step.
    """
    if ratio < 2:
        raise ValueError("forms must be at least twice as frequent, or chains of them need not end")
    store = Store(words.sparkSession, "variants")
    words = store.put(words, "words")
    near = near_words(words, piece)
    found = words.join(near, "word", "left")
    is_form = F.col("best_n") >= ratio * F.col("n")
    rows = store.put(found.select("word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.when(is_form, F.col("best")).alias("form"), F.when(is_form, F.col("best_n")).alias("form_n")), "forms")
    most = rows.agg(F.max("n")).first()[0] or 1
    up = rows.where("form IS NOT NULL").select("word", F.col("form").alias("root"))
    longest, covered = max(int(np.log2(most)), 1), 1
    while covered < longest:
        further = up.select(F.col("word").alias("root"), F.col("root").alias("further"))
        up = store.put(up.join(further, "root", "left").select("word", F.coalesce("further", "root").alias("root")), "roots")
        covered *= 2
    return rows.join(up, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def damaged_runs(docs: DataFrame, key: str = "doc_id", text: str = "text", every: int = 97) -> DataFrame:
    """(word): the words of all texts, one row an occurrence; a word whose checksum with its document's id `every` divides
    loses the code point that the checksum points to."""
    rows = docs.select(F.coalesce(F.col(key).cast("string"), F.lit("")).alias("id"), F.explode(runs(F.col(text))).alias("w"))
    h = F.crc32(F.concat(F.col("id"), F.lit(":"), F.col("w")).cast("binary"))
    at = F.pmod(h, F.length("w")).cast("int")
    cut = F.concat(F.substring("w", F.lit(1), at), F.substring("w", at + 2, F.length("w")))
    return rows.where(F.length("w") >= SHORTEST).select(F.when(h % every == 0, cut).otherwise(F.col("w")).alias("word"))
