"""Joins of texts that are alike, without comparing all pairs: what two alike texts must share is joined on, rarest first."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations, count, takewhile
from math import comb

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lectern.operators.graph import kept

#: Rows of a key on one side that one task takes; a key with more is dealt to several.
PER_TASK = 5_000
#: Shortened forms that a word may have to be joined on them.
MOST_FORMS = 600
#: Words of which a task holds the forms at a time.
WORDS = 200
KINDS = [pa.string(), pa.string(), pa.int32(), pa.int32()]


def indel_ratio(a: str, b: str) -> float:
    """100 * 2 * (longest common subsequence) / (both lengths); rows of the table as bits of one integer."""
    if not a or not b:
        return 0.0
    at: dict[str, int] = {}
    for i, c in enumerate(a):
        at[c] = at.get(c, 0) | 1 << i
    row, full = 0, (1 << len(a)) - 1
    for c in b:
        x = row | at.get(c, 0)
        row = x & ~(x - (row << 1 | 1)) & full
    return 200.0 * row.bit_count() / (len(a) + len(b))


def lengths_fit(m: Column, n: Column, least: float) -> Column:
    """Whether texts of such lengths can score ``least``: at most the shorter one is common."""
    return 200 * F.least(m, n) >= least * (m + n) - 1e-6


def scored(pairs: DataFrame, least: float, a: str = "name", b: str = "other_name") -> DataFrame:
    """pairs with their score, those of ``least`` or more. The plain edit distance, which Spark counts up to a bound, is no more than the characters left out and is asked first."""
    left_out = f"CAST(floor({1 - least / 100!r} * (length({a}) + length({b})) + 1e-6) AS INT)"
    pairs = pairs.where(F.expr(f"levenshtein({a}, {b}, {left_out}) >= 0")).distinct()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield batch.assign(score=[indel_ratio(x, y) for x, y in zip(batch[a], batch[b], strict=True)])

    return pairs.mapInPandas(run, ", ".join(f"{c} {t}" for c, t in pairs.dtypes) + ", score double").where(F.col("score") >= least)


def dealt(asked: DataFrame, held: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame, list[str]]:
    """Both sides of a join on keys, with one key more that deals the held rows of a frequent key to several tasks; the asked rows go to each of them.

    They are partitioned by number, as their work is the pairs that they meet, not their bytes.
    """
    tasks = int(held.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    parts = held.groupBy(*keys).agg(F.ceil(F.count(F.lit(1)) / PER_TASK).alias("_parts"))
    spread = held.join(parts, keys).withColumn("_part", F.pmod(F.xxhash64(*[c for c in held.columns if c not in keys]), F.col("_parts"))).drop("_parts")
    sent = asked.join(parts, keys).withColumn("_part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_parts") - 1))).drop("_parts")
    keys = [*keys, "_part"]
    return sent.repartition(tasks, *keys), spread.repartition(tasks, *keys), keys


@F.pandas_udf(T.ArrayType(T.StringType()))
def numbered_bigrams(words: pd.Series) -> pd.Series:
    """The pairs of characters in a row, each with the number of its occurrence, so that a multiset is a set."""

    def one(word: str) -> list[str]:
        seen: dict[str, int] = {}
        out = []
        for i in range(len(word) - 1):
            gram = word[i : i + 2]
            seen[gram] = seen.get(gram, 0) + 1
            out.append(f"{gram}{seen[gram]}")
        return out

    return words.map(one)


@F.pandas_udf(T.ArrayType(T.StringType()))
def numbered_characters(words: pd.Series) -> pd.Series:
    def one(word: str) -> list[str]:
        seen: dict[str, int] = {}
        out = []
        for c in word:
            seen[c] = seen.get(c, 0) + 1
            out.append(f"{c}{seen[c]}")
        return out

    return words.map(one)


def prefixes(rows: DataFrame, text: str, tokens: Column, shared: Column, within: list[str] | None = None) -> DataFrame:
    """rows with ``token``: each row's rarest tokens, so many that two rows sharing ``shared`` tokens or more have one of them in common.

    Of k tokens in one order for all, two texts that share s have one in their first k - s + 1.
    Frequencies are counted over all rows of ``within``.
    """
    each = rows.select("*", F.explode(tokens).alias("token"))
    rare = each.groupBy(*(within or []), "token").agg(F.count(F.lit(1)).alias("_n"))
    order = Window.partitionBy(*(within or []), text).orderBy("_n", "token")
    count = F.count(F.lit(1)).over(Window.partitionBy(*(within or []), text))
    placed = each.join(rare, [*(within or []), "token"]).select("*", F.row_number().over(order).alias("_k"), count.alias("_all"))
    return placed.where(F.col("_k") <= F.col("_all") - F.greatest(F.lit(1), F.ceil(shared - 1e-6)) + 1).drop("_n", "_k", "_all")


def may_lack(length: int, least: float) -> int:
    """How many characters two words with so many in common may have beside these, both counted, to score ``least``."""
    return max(takewhile(lambda n: 200.0 * length / (2 * length + n) >= least, count()), default=0) if length else 0


def left_out(m: int, least: float) -> list[int]:
    """How many characters of a word of m another that scores ``least`` may lack."""
    return [i for i in range(m) if i <= may_lack(m - i, least)]


def longest_joined(least: float) -> int:
    """The most characters of which words have at most ``MOST_FORMS`` shortened forms."""
    return max(takewhile(lambda m: sum(comb(m, i) for i in left_out(m, least)) <= MOST_FORMS, count(1)), default=0)


def shortened(words: DataFrame, least: float) -> DataFrame:
    """(word, form, out, most): what is left of each word without ``out`` characters, and how many a pair with that in common may leave out in all."""
    longest = longest_joined(least)
    out = {m: left_out(m, least) for m in range(1, longest + 1)}
    most = {n: may_lack(n, least) for n in range(1, longest + 1)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, len(batch), WORDS):
                held = batch.slice(at, WORDS).column(0).to_pylist()
                found = [(w, x, i, most[len(w) - i]) for w in held for i in out[len(w)] if most[len(w) - i] for x in {"".join(c) for c in combinations(w, len(w) - i)}]
                if found:
                    yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(zip(*found, strict=True), KINDS, strict=True)], ["word", "form", "out", "most"])

    # By number, as the work is the forms, not the words' bytes.
    tasks = int(words.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    short = words.where(F.length("word").between(1, longest)).select("word").repartition(tasks, "word")
    return short.mapInArrow(run, "word string, form string, out int, most int")


def near_words(words: DataFrame, least: float) -> DataFrame:
    """(word, near): all ordered pairs of different words (word) that score ``least`` or more, which is over 80.

    Words that are not long are joined on what is left of them without a few characters: the
    longest common subsequence of such a pair is one of these forms of both. How many characters
    each lacks is part of the key, so that all that meets is a pair. Pairs with a longer word
    come from ``near_long_words``.
    """
    words = words.select("word").distinct()
    forms = kept(shortened(words, least))  # read on both sides
    more = forms.select("word", "form", "out", F.explode(F.sequence(F.lit(0), F.least("out", F.col("most") - F.col("out")))).alias("other_out"))
    less = forms.where("2 * out <= most").select(F.col("word").alias("near"), "form", F.col("out").alias("other_out"), F.explode(F.sequence(F.col("out"), F.col("most") - F.col("out"))).alias("out"))
    pairs = more.join(less, ["form", "out", "other_out"]).where("word <> near").select(F.least("word", "near").alias("word"), F.greatest("word", "near").alias("near"))
    found = pairs.union(near_long_words(words, least, longest_joined(least))).distinct()
    return found.union(found.select("near", "word"))


def near_long_words(words: DataFrame, least: float, beyond: int) -> DataFrame:
    """(word, near): the pairs that score ``least`` of which one word at least has more than ``beyond`` characters, word < near.

    With t = least / 200, the longest common subsequence of such a pair of m and n characters has
    t (m + n) or more. Every character that it leaves out breaks one pair of characters in a row,
    so that (3 t - 1) (m + n) - 1 of these are common, at least one for all lengths that fit.
    n is m t / (1 - t) at least.
    """
    t = least / 200
    m = F.length("word")
    shared = (3 * t - 1) * (m + m * t / (1 - t)) - 1
    partners = words.where((m > 1) & (m * (1 - t) >= (beyond + 1) * t - 1e-6))
    held = prefixes(partners, "word", numbered_bigrams("word"), shared)
    asked, spread, keys = dealt(held, held.withColumnRenamed("word", "near"), ["token"])
    met = asked.join(spread, keys).where(F.col("word") < F.col("near")).where(lengths_fit(m, F.length("near"), least)).where(F.greatest(m, F.length("near")) > beyond)
    return scored(met.select("word", "near"), least, "word", "near").select("word", "near")


def signature(word: str) -> Column:
    """A bit for each word, or-ed: what is not in one signature is not in the words."""
    return F.expr(f"bit_or(shiftleft(1L, CAST(pmod(xxhash64({word}), 64) AS INT)))")


def word_candidates(words: DataFrame, least: float, near: float) -> DataFrame:
    """(type_id, name, other_name): pairs of names of which one has each of its telling words, or one near to it, among the words of the other, and lengths that fit ``least``.

    words: type_id, name, word, telling. A name asks for its rarest telling word; what it finds has
    to hold its other telling words too, by 64 bits of them, which rule out most of what
    shares a frequent word alone.
    """
    alike = near_words(words.select("word").distinct(), near)
    holds = words.select("type_id", "name", "word").union(words.join(alike, "word").select("type_id", "name", "near"))
    wanted = words.where("telling").select("type_id", "word").distinct()
    posts = holds.join(wanted, ["type_id", "word"], "left_semi").distinct()
    size = posts.groupBy("type_id", "word").agg(F.count(F.lit(1)).alias("n"))
    asked = words.where("telling").join(size, ["type_id", "word"]).groupBy("type_id", "name").agg(F.min_by("word", F.struct("n", "word")).alias("word"), signature("word").alias("_asks"))
    held = posts.join(posts.groupBy("type_id", "name").agg(signature("word").alias("_holds")), ["type_id", "name"]).withColumnRenamed("name", "other_name")
    asked, held, keys = dealt(asked, held, ["type_id", "word"])
    m, n = F.length("name"), F.length("other_name")
    met = asked.join(held, keys).where(F.col("name") != F.col("other_name")).where(lengths_fit(m, n, least)).where(F.expr("_asks & ~_holds = 0"))
    return met.select("type_id", F.least("name", "other_name").alias("name"), F.greatest("name", "other_name").alias("other_name"))


def plain_candidates(plain: DataFrame, names: DataFrame, least: float) -> DataFrame:
    """(type_id, name, other_name): pairs that may score ``least`` of which one is in ``plain``, names without a telling word.

    Such a pair shares t (m + n) characters, so that both have one of their rarest in common.
    """
    t = least / 200
    longest = plain.agg(F.max(F.length("name")).alias("_longest"))
    short = names.crossJoin(F.broadcast(longest)).where(F.length("name") * t <= F.col("_longest") * (1 - t) + 1e-6).drop("_longest")  # one row
    m = F.length("name")
    first = prefixes(short, "name", numbered_characters("name"), t * (m + m * t / (1 - t)), ["type_id"])
    asked, held, keys = dealt(first.join(plain, ["type_id", "name"], "left_semi"), first.withColumnRenamed("name", "other_name"), ["type_id", "token"])
    met = asked.join(held, keys).where(F.col("name") != F.col("other_name")).where(lengths_fit(m, F.length("other_name"), least))
    return met.select("type_id", F.least("name", "other_name").alias("name"), F.greatest("name", "other_name").alias("other_name"))
