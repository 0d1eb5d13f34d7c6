"""Spelling variants of frequent words by a trie of letter-group counts.

A word's letters fall into a few groups; its counts per group, in a fixed order,
are its path.  Inserting, deleting or replacing one letter adds at most one to
one count and takes at most one from another, so all words near a word are found
by a depth-first search that may spend a surplus of one and a deficit of one on
the way down; the words of the leaves it reaches are verified.

The trie is dealt out by its first levels: every word is kept under the prefix of
its own path and asked under every prefix that the budget reaches, each question
carrying what is left of the budget.  A prefix under which more than ``crowd``
words are kept is dealt out by its next levels, and so on down, so one task holds
a bounded number of words however large the vocabulary grows (words of equal
counts in all groups stay together).

Defined cases: words are maximal runs of ``[A-Za-z\\u00C0-\\u00FF]``, A-Z
lower-cased; null and empty texts have none; a null id counts as the text
``null`` in the hash that plants deletions; rows of one id are rows of their own;
without any frequent word the result is empty; further columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.session import cut_lineage

from .common import ship

ship(__name__)

LETTER = "[A-Za-z\u00C0-\u00FF]"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: Letter groups in the order of the path, chosen to have counts of like spread; all other letters are the last group.
GROUPS = ("e", "t", "a", "o", "n", "i", "h", "r", "s", "dl", "uc", "mfw", "gypb", "vkjxqz")
LEVELS = (3, 2)   # levels by which the trie is dealt out at first, and in every further step


def runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_length: int = 1) -> DataFrame:
    """(doc, word): every run of so many letters in the texts, lower-cased."""
    found = F.regexp_extract_all(F.col(text_col), F.lit(f"{LETTER}{{{least_length},}}"), F.lit(0))
    named = docs.select(F.coalesce(F.col(id_col).cast("long").cast("string"), F.lit("null")).alias("doc"), F.explode(found).alias("run"))
    return named.select("doc", F.translate("run", UPPER, LOWER).alias("word"))


def with_deletions(words: DataFrame, every: int = 199) -> DataFrame:
    """(word): runs after one code point of every ``every``-th (by a hash of id and run) is deleted."""
    h = F.crc32(F.concat_ws(":", "doc", "word").cast("binary"))
    at = (F.col("h") % F.char_length("word")).cast("int")
    cut = F.concat(F.substring(F.col("word"), F.lit(1), at), F.substring(F.col("word"), at + 2, F.char_length("word")))
    return words.select("word", h.alias("h")).select(F.when(F.col("h") % every == 0, cut).otherwise(F.col("word")).alias("word"))


def frequent(words: DataFrame, least_length: int = 6, least_count: int = 5) -> DataFrame:
    """(word, n): distinct words of so many code points and occurrences."""
    return words.where(F.char_length("word") >= least_length).groupBy("word").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least_count)


def group_counts(word: Column, groups: tuple = GROUPS) -> Column:
    """A word's path: letters per group, then the letters of no group."""
    lost = lambda letters: F.char_length(word) - F.char_length(F.translate(word, letters, ""))
    return F.array(*[lost(g) for g in groups], F.char_length(F.translate(word, "".join(groups), "")))


def reached(path: Column, surplus: Column, deficit: Column, first: int, last: int) -> Column:
    """Array of (cells, surplus, deficit): the counts of levels ``first`` to ``last`` - 1 that a search reaches, and its budget after them."""
    out = []
    levels = range(first, last)
    for up in (None, *levels):
        for down in (None, *levels):
            if up is not None and up == down:
                continue
            cells = [path.getItem(i) + int(i == up) - int(i == down) for i in levels]
            paid = [F.lit(True) if up is None else surplus > 0, F.lit(True) if down is None else (deficit > 0) & (path.getItem(down) > 0)]
            out.append(F.when(paid[0] & paid[1], F.struct(F.concat_ws(".", *cells).alias("cells"), (surplus - int(up is not None)).alias("surplus"),
                                                          (deficit - int(down is not None)).alias("deficit"))))
    return F.filter(F.array(*out), lambda x: x.isNotNull())


def dealt_out(words: DataFrame, groups: tuple = GROUPS, crowd: int = 20_000) -> DataFrame:
    """(prefix, level, word, kept, surplus, deficit): the trie's words and the questions, under bounded prefixes."""
    path, total = group_counts(F.col("word"), groups), len(groups) + 1
    one = F.lit(1)
    kept = words.select("word", F.lit("").alias("prefix"), F.lit(True).alias("kept"), (one * 0).alias("surplus"), (one * 0).alias("deficit"))
    asked = words.select("word", F.lit("").alias("prefix"), F.lit(False).alias("kept"), one.alias("surplus"), one.alias("deficit"))
    rows, level, done = kept.unionByName(asked), 0, None
    while True:
        upto = min(total, level + LEVELS[bool(level)])
        steps = reached(path, F.col("surplus"), F.col("deficit"), level, upto)
        rows = rows.select("word", "prefix", "kept", F.explode(steps).alias("s")).select(
            "word", F.concat_ws(".", "prefix", "s.cells").alias("prefix"), "kept", "s.surplus", "s.deficit")
        level = upto
        at = F.lit(level).alias("level")
        full = rows.where("kept").groupBy("prefix").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > crowd).select("prefix")
        full = cut_lineage(full, "full-prefixes")
        if level == total or full.isEmpty():
            rest = rows.select("prefix", at, "word", "kept", "surplus", "deficit")
            return rest if done is None else done.unionByName(rest)
        calm = rows.join(full, "prefix", "left_anti").select("prefix", at, "word", "kept", "surplus", "deficit")
        done = calm if done is None else done.unionByName(calm)
        rows = rows.join(full, "prefix", "left_semi")


class Trie:
    """Nested dictionaries keyed by counts; leaves are lists of word numbers."""

    def __init__(self, paths):
        self.root: dict = {}
        for i, path in enumerate(paths):
            node = self.root
            for c in path[:-1]:
                node = node.setdefault(c, {})
            node.setdefault(path[-1], []).append(i)

    def search(self, path, surplus: int, deficit: int):
        """Words whose counts exceed ``path`` by ``surplus`` in one level at most and fall short by ``deficit`` in one at most."""
        stack, last = [(self.root, 0, surplus, deficit)], len(path) - 1
        while stack:
            node, level, up, down = stack.pop()
            c = path[level]
            for count, u, d in ((c, up, down), (c + 1, up - 1, down), (c - 1, up, down - 1)):
                if u >= 0 and d >= 0 and count in node:
                    if level == last:
                        yield from node[count]
                    else:
                        stack.append((node[count], level + 1, u, d))


def one_edit(a: str, b: str) -> bool:
    """One code point inserted, deleted or replaced."""
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1 or a == b:
        return False
    i = 0
    while i < len(a) and a[i] == b[i]:
        i += 1
    return a[i + 1:] == b[i + 1:] if len(a) == len(b) else a[i:] == b[i + 1:]


def path_of(word: str, group_of: dict, total: int) -> list:
    """``group_counts`` of one word."""
    out = [0] * total
    for c in word:
        out[group_of.get(c, total - 1)] += 1
    return out


def near_pairs(words: DataFrame, groups: tuple = GROUPS, crowd: int = 20_000) -> DataFrame:
    """(word, near): both directions of every pair of distinct words one edit apart."""
    group_of, total = {c: i for i, g in enumerate(groups) for c in g}, len(groups) + 1

    def descend(key, rows):
        import pyarrow as pa

        a, b = [], []
        kept = rows.column("kept").to_pylist()
        if any(kept):
            level = key[1].as_py()
            word, surplus, deficit = (rows.column(c).to_pylist() for c in ("word", "surplus", "deficit"))
            own = [w for w, k in zip(word, kept) if k]
            questions: dict = {}
            for w, k, up, down in zip(word, kept, surplus, deficit):
                if not k:  # words of equal counts ask the same
                    questions.setdefault((*path_of(w, group_of, total)[level:], up, down), []).append(w)
            if level == total:
                trie = None
            else:
                trie = Trie([path_of(w, group_of, total)[level:] for w in own])
            for (*rest, up, down), askers in questions.items():
                found = own if trie is None else [own[j] for j in trie.search(rest, up, down)]
                for w in askers:
                    near = [x for x in found if one_edit(w, x)]
                    a.extend([w] * len(near))
                    b.extend(near)
        return pa.table({"word": pa.array(a, pa.string()), "near": pa.array(b, pa.string())})

    return dealt_out(words, groups, crowd).groupBy("prefix", "level").applyInArrow(descend, "word string, near string")


def variants(words: DataFrame, ratio: int = 5) -> DataFrame:
    """(word, n, n_near, form, form_n, root) for (word, n) rows.

    A word's form is its near word of largest n (ties: the smallest), if that n is
    ``ratio`` times its own at least; roots follow forms, halving the way left each
    round, until no word moves.
    """
    words = cut_lineage(words, "words")
    pairs = near_pairs(words)
    told = pairs.join(words.select(F.col("word").alias("near"), F.col("n").alias("near_n")), "near")
    best = told.groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("less"), "near")).alias("first"))
    out = words.join(best, "word", "left")
    form = F.when(-F.col("first.less") >= ratio * F.col("n"), F.col("first.near"))
    out = cut_lineage(out.select("word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), form.alias("form"),
                                 F.when(form.isNotNull(), -F.col("first.less")).alias("form_n")), "forms")
    step = out.where("form is not null").select("word", F.col("form").alias("to"))
    while True:  # every round doubles the forms that a step follows
        on = step.select(F.col("word").alias("to"), F.col("to").alias("further"))
        moved = cut_lineage(step.join(on, "to", "left").select("word", F.coalesce("further", "to").alias("to"), F.col("further").isNotNull().alias("moved")), "roots")
        step = moved.select("word", "to")
        if moved.where("moved").isEmpty():
            break
    roots = step.withColumnRenamed("to", "root")
    return out.join(roots, "word", "left").select("word", "n", "n_near", "form", "form_n", F.coalesce("root", "word").alias("root"))


def spelling_variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", every: int = 199, least_length: int = 6,
                      least_count: int = 5, ratio: int = 5) -> DataFrame:
    """Variant groups of the frequent words of ``docs`` (see ``variants``)."""
    return variants(frequent(with_deletions(runs(docs, id_col, text_col, least_length), every), least_length, least_count), ratio)
