"""Operator 13: spelling variants grouped by wildcards, without making pairs.

Words are near if they differ by exactly one inserted, deleted or replaced code point.

* Replacements: a word of m code points is in m groups (position, prefix + suffix), and two
  words share one exactly if they differ at that position alone. A group keeps its size and
  its two most frequent words: of these the one that isn't the word itself is its best near
  word there, and size - 1 is how many it has.
* Insertions and deletions: each word's different deletions join the vocabulary, at most one
  row for each of the word's code points; a row that is found counts for both of its words.

Both are summed word by word. A group has no more words than the alphabet has letters and a
word no more near ones by insertion than (m + 1) times that, so no key becomes hot. Counts
are aggregated before they are shuffled. ``form`` is followed to its ``root`` by pointer
doubling: n grows at least ``RATIO`` times a step, which bounds the rounds.

Defined results: null and empty texts have no words. A null doc_id is hashed as an empty one.
Rows that repeat count as often as they stand there. Equally frequent near words are ordered
by code points. An empty table gives no rows. Only ``doc_id`` and ``text`` are looked at.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.llm.common import materialise

#: Fixed values of the contract: letters of a run, code points and occurrences of a word, and how much more frequent a form is.
LETTERS = "[A-Za-zÀ-ÿ]"
LENGTH, OCCURRENCES, RATIO = 7, 2, 10
#: One run in so many, by its hash, loses a code point.
DELETED = 31
CAPITALS, SMALL = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def without(word: Column, i: Column) -> Column:
    """The word without its code point number i, from 1."""
    return F.concat(F.substring(word, F.lit(1), i - 1), F.substring(word, i + 1, F.length(word)))


def vocabulary(docs: DataFrame) -> DataFrame:
    """(word, n): the words of the texts, runs with the contract's deletions, and how often each occurs."""
    # Shorter runs than a word can't become one, so the pattern leaves them out; greedy, it still takes whole runs.
    runs = F.regexp_extract_all(F.translate("text", CAPITALS, SMALL), F.lit(LETTERS + f"{{{LENGTH},}}"), F.lit(0))
    each = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("doc"), F.explode(runs).alias("run"))
    h = F.crc32(F.concat("doc", F.lit(":"), "run"))
    word = F.when(h % DELETED == 0, without(F.col("run"), (h % F.length("run")).cast("int") + 1)).otherwise(F.col("run"))
    counted = each.select(word.alias("word")).where(F.length("word") >= LENGTH).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    return counted.where(F.col("n") >= OCCURRENCES)


def replaced(words: DataFrame) -> DataFrame:
    """(word, n, n_near, best): for each group that a word shares, how many others are in it and the first of them."""
    place = F.explode(F.sequence(F.lit(1), F.length("word")))
    each = words.select("word", "n", place.alias("i")).select("word", "n", "i", without(F.col("word"), F.col("i")).alias("rest"))
    group = Window.partitionBy("i", "rest").orderBy(F.desc("n"), "word").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    entry = F.struct((-F.col("n")).alias("rank"), F.col("word").alias("word"))
    top = [F.nth_value(entry, k).over(group).alias(f"top{k}") for k in (1, 2)]
    grouped = each.select("word", "n", F.count(F.lit(1)).over(group).alias("size"), *top).where("size > 1")
    best = F.when(F.col("top1.word") == F.col("word"), F.col("top2")).otherwise(F.col("top1"))
    return grouped.select("word", "n", (F.col("size") - 1).alias("n_near"), best.alias("best"))


def shortened(words: DataFrame) -> DataFrame:
    """(word, n, n_near, best): a row for both words of each deletion that leads from one to the other."""
    every = F.array_distinct(F.transform(F.sequence(F.lit(1), F.length("word")), lambda i: without(F.col("word"), i)))
    deletions = words.where(F.length("word") > LENGTH).select(F.col("word").alias("long"), F.col("n").alias("long_n"), F.explode(every).alias("word"))
    found = deletions.join(words, "word")
    entry = lambda n, word: F.struct((-F.col(n)).alias("rank"), F.col(word).alias("word"))
    both = F.array(
        F.struct(F.col("word").alias("word"), F.col("n").alias("n"), entry("long_n", "long").alias("best")),
        F.struct(F.col("long").alias("word"), F.col("long_n").alias("n"), entry("n", "word").alias("best")),
    )
    return found.select(F.inline(both)).select("word", "n", F.lit(1).cast("long").alias("n_near"), "best")


def near_words(words: DataFrame) -> DataFrame:
    """(word, n, n_near, form, form_n) of a vocabulary (word, n); a form is the best near word, if it is frequent enough."""
    alone = words.select("word", "n", F.lit(0).cast("long").alias("n_near"), F.lit(None).cast("struct<rank:bigint,word:string>").alias("best"))
    every = alone.unionByName(replaced(words)).unionByName(shortened(words))
    summed = every.groupBy("word", "n").agg(F.sum("n_near").alias("n_near"), F.min("best").alias("best"))
    taken = -F.col("best.rank") >= RATIO * F.col("n")
    return summed.select("word", "n", "n_near", F.when(taken, F.col("best.word")).alias("form"), F.when(taken, -F.col("best.rank")).alias("form_n"))


def roots(near: DataFrame) -> DataFrame:
    """(word, root): where the forms of the words that have one end."""
    links = near.where("form IS NOT NULL").select("word", F.col("form").alias("root"))
    most = near.agg(F.max("n")).first()[0] or 1
    steps = math.floor(math.log(max(1, most), RATIO)) + 1
    for _ in range(math.ceil(math.log2(steps)) if steps > 1 else 0):
        on = links.select(F.col("word").alias("root"), F.col("root").alias("further"))
        links = materialise(links.join(on, "root", "left").select("word", F.coalesce("further", "root").alias("root")), "roots")
    return links


def groups(docs: DataFrame) -> DataFrame:
    """(word, form, root, n, n_near, form_n): every word of the texts with the more frequent spelling it is a variant of."""
    words = materialise(vocabulary(docs), "vocabulary")
    near = materialise(near_words(words), "near-words")
    found = near.join(roots(near), "word", "left")
    return found.select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
