"""Spelling variants: words one edit apart, found by a rare-first prefix filter over positional bigrams.

Two words are near if one inserted, deleted or replaced code point makes one of the other. One edit changes at most two bigrams of a word,
so of the three rarest bigrams of each (rare by the number of distinct words with it, over all words; ties by the bigram, then
by position) two near words share at least one, and it stands at the same position in both, or, after an inserted code point, one further in the longer
word. Words are therefore joined on (bigram, position, length), three rows a word against nine, and the join itself verifies
the edit distance, so no table of candidates is made.

A bucket of more than HOT words is split by halves: of two near words either what is before the middle of the shorter one is equal, or
what is behind it, so its rows also carry one half or the other in their key. Nothing is left out.

A null text has no words; words of other lengths than asked for are left to the caller. Of an empty table nothing is returned.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftwell.llm._store import written
from siftwell.operators.graph import by_size, stored

#: Code points of a word, at least: with fewer than four a word has fewer than three bigrams.
LEAST = 7
#: Bigrams joined: bigrams that an edit changes, and one more.
PREFIX = 3
#: Words of a (bigram, position, length) that is not split by halves.
HOT = 128
#: A word's form occurs so many times as often, at least.
RATIO = 10


def runs(df: DataFrame, keep: list[str], text: str = "text", least: int = LEAST) -> DataFrame:
    """(keep..., run): maximal runs of Latin letters of least code points or more, A to Z in lower case."""
    # Greedy runs of a least length are the maximal runs of that length.
    found = F.regexp_extract_all(F.col(f"`{text}`"), F.lit("[A-Za-zÀ-ÿ]{%d,}" % least), F.lit(0))
    own = df.select(*[F.col(f"`{c}`") for c in keep], F.explode(found).alias("run"))
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    lowered = F.when(F.col("run").rlike("[A-Z]"), F.translate("run", upper, upper.lower())).otherwise(F.col("run"))
    return own.withColumn("run", lowered)


def count(words: DataFrame, least: int = LEAST, times: int = 2) -> DataFrame:
    """(word, n) of the words of at least so many code points that occur so many times."""
    return words.where(F.char_length("word") >= least).groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= times)


def prefixes(counts: DataFrame) -> DataFrame:
    """(word, size, gram, pos): the three rarest bigrams of each word, with their positions from 0."""
    grams = F.expr("transform(sequence(0, char_length(word) - 2), i -> struct(substring(word, i + 1, 2) AS gram, i AS pos))")
    own = counts.select("word", F.inline(grams))
    rank, n = stored(own.groupBy("gram").agg(F.countDistinct("word").alias("f")), "bigrams")
    ranked = own.join(by_size(rank, n), "gram").groupBy("word").agg(F.array_sort(F.collect_list(F.struct("f", "gram", "pos"))).alias("all"))
    return ranked.select("word", F.char_length("word").alias("size"), F.inline(F.slice("all", 1, PREFIX))).drop("f")


def _halves(size: Column) -> Column:
    """The parts before and behind the middle of a word of this size, of its own word or of one with one code point more."""
    middle = (size / 2).cast("int")
    return F.array(F.concat(F.lit("<"), F.expr("word").substr(F.lit(1), middle)), F.concat(F.lit(">"), F.expr("word").substr(F.char_length("word") - (size - middle) + 1, size - middle)))


def near_pairs(counts: DataFrame, hot: int = HOT) -> DataFrame:
    """(a, b) of near words of counts (word, ...), each pair once; words must be distinct and have four code points at least."""
    marks = written(prefixes(counts), "prefixes")
    large, n = stored(marks.groupBy("gram", "pos", "size").agg(F.count("*").alias("members")).where(F.col("members") > hot).drop("members"), "large")
    none = F.array(F.lit(""))

    def keyed(df: DataFrame, size: Column, longer: Column, at: Column, to: Column) -> DataFrame:
        """Rows of df in bucket (gram, at, to), where size is that of the shorter word."""
        own = df.select("word", "gram", at.alias("pos"), to.alias("size"), size.alias("shorter"), longer.alias("longer"))
        split = F.when(F.col("is_large"), _halves(F.col("shorter"))).otherwise(none)
        own = own.join(by_size(large.withColumn("is_large", F.lit(True)), n), ["gram", "pos", "size"], "left").withColumn("part", F.explode(split))
        return own.select("word", "longer", F.xxhash64("gram", "pos", "size", "longer", "part").alias("key"))

    size, pos, no, yes = F.col("size"), F.col("pos"), F.lit(False), F.lit(True)
    left = keyed(marks, size, no, pos, size).unionByName(keyed(marks, size, yes, pos, size + 1)).unionByName(keyed(marks, size, yes, pos + 1, size + 1))
    right = keyed(marks, size, no, pos, size).unionByName(keyed(marks, size - 1, yes, pos, size))
    a, b = left.select(F.col("word").alias("a"), "key", "longer"), right.select(F.col("word").alias("b"), "key")
    # Of equally long words each pair once; the cheap tests come first.
    order = F.when(F.col("longer"), F.char_length("a") + 1 == F.char_length("b")).otherwise((F.col("a") < F.col("b")) & (F.char_length("a") == F.char_length("b")))
    met = a.hint("merge").join(b, (a["key"] == b["key"]) & order & (F.levenshtein("a", "b", 1) == 1))
    return met.select("a", "b").distinct()


def variants(counts: DataFrame, ratio: int = RATIO, hot: int = HOT) -> DataFrame:
    """(word, n, n_near, form, form_n, root) of counts (word, n).

    form is the near word of largest n (ties: smallest in code-point order) if its n is ratio times the word's n at least; root is where
    forms lead to. Counts grow along forms, so they never run in circles.
    """
    pairs = written(near_pairs(counts, hot), "near_pairs")
    both = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
    of = both.join(counts.select(F.col("word").alias("b"), F.col("n").alias("m")), "b")
    best = of.groupBy(F.col("a").alias("word")).agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("m")).alias("m"), "b")).alias("best"))
    own = counts.select("word", "n").join(best, "word", "left")
    taken = -F.col("best.m") >= ratio * F.col("n")
    near = written(own.select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(taken, F.col("best.b")).alias("form"), F.when(taken, -F.col("best.m")).alias("form_n")), "forms")
    ends = roots(near.where("form IS NOT NULL").select("word", "form"))
    return near.join(ends, "word", "left").withColumn("root", F.coalesce("root", "word"))


def roots(forms: DataFrame) -> DataFrame:
    """(word, root): where forms (word, form) lead to; each step doubles how far a word sees."""
    seen = written(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        further = seen.select(F.col("word").alias("root"), F.col("root").alias("further"))
        after = written(seen.join(further, "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")), "roots")
        seen = after.select("word", "root")
        if after.where("moved").isEmpty():
            return seen
