"""Operator 5: quality rules with thresholds that adapt to each language and source. DataFrame functions only.

Base rules are fixed. The method's verdict compares five measures of a text with limits read
from KLL quantile sketches, one per language and source (``RULES``): symbols per word
character, repeated lines per line, the share of repeated words, mean word length and the
logarithm of the number of words. Sketches merge, so a group of fewer than ``min_group``
documents takes the merged sketches of its language.

Texts are measured once; the numbers, without texts, are written and read for the sketches
and for the verdicts. ``keep`` takes the rejected rows' hashes back to the texts.

Defined results: a null text is empty (no words: base_failed). A null language or source is
a group of its own. Repeated rows are judged row by row, and alike. A measure that no text of
a group has sets no limit. An empty table gives no rows. Further columns of the input are
left alone whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.llm.common import WHITE, boxed, materialise, small, unboxed

SYMBOLS = "#*$%&|<>"
#: Measures that every text has: (name, factor). Limits: the quartiles, widened by so many times their distance, or NARROW times
#: the upper one if they are closer to each other.
SPREAD = (("word_length", 6.0), ("log_words", 4.0))
#: Measures that most texts have none of: (name, quantile of the sketch over texts that have some, factor). Limit: factor
#: times that quantile; where a quarter of the group or more has some, the limit of ``SPREAD`` with WIDE if that is higher.
RARE = (("symbols", 0.25, 0.5), ("dup_lines", 0.99, 1.2), ("repeat_share", 0.99, 1.2))
WIDE, NARROW = 4.0, 0.05


def let(value: Column, body) -> Column:
    """body(value) with the value worked out once, although body names it in inner lambdas."""
    return F.element_at(F.transform(F.array(value), body), 1)


def split_words(text: Column) -> Column:
    """Words of a text; one empty word if there are none."""
    return F.split(F.btrim(text, F.lit(WHITE)), "[ \\t-\\r]+")


def repeated_words(words: Column, n: Column, k: int = 5) -> Column:
    """Words in k-word windows that occur twice or more; windows are compared by 64-bit hashes within one text."""

    def windows(h: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.size(h) - k), lambda i: F.xxhash64(*[F.get(h, i + j) for j in range(k)]))

    def covered(grams: Column) -> Column:
        def twice(s: Column) -> Column:
            return F.transform(s, lambda x, i: F.when((F.get(s, i - 1)["h"] == x["h"]) | (F.get(s, i + 1)["h"] == x["h"]), x["p"]))

        pairs = F.sort_array(F.transform(grams, lambda h, p: F.struct(h.alias("h"), p.alias("p"))))
        places = F.sort_array(F.array_compact(let(pairs, twice)))
        start = F.struct(F.lit(-k).alias("last"), F.lit(0).alias("total"))
        step = lambda a, p: F.struct(p.alias("last"), (a["total"] + F.least(F.lit(k), p - a["last"])).alias("total"))
        return F.aggregate(places, start, step, lambda a: a["total"])

    found = let(let(F.transform(words, lambda w: F.xxhash64(w)), windows), lambda g: F.when(F.size(F.array_distinct(g)) == F.size(g), 0).otherwise(covered(g)))
    return F.when(n < k, F.lit(0)).otherwise(found).cast("long")


def measure(docs: DataFrame) -> DataFrame:
    """(doc_id, lang, source, text_hash, ...): what the base rules and the method look at, without texts."""
    out = docs.select("doc_id", "lang", "source", F.coalesce("text", F.lit("")).alias("text"), *hashes())
    out = out.select(
        "*",
        F.length(F.translate("text", WHITE, "")).cast("long").alias("word_chars"),
        (F.length("text") - F.length(F.translate("text", SYMBOLS, ""))).cast("long").alias("n_symbols"),
        split_words(F.col("text")).alias("words"),
        F.filter(F.split("text", "\n"), lambda x: x.rlike("[^ \\t-\\r]")).alias("lines"),
    ).drop("text")
    out = out.withColumn("n_words", F.when(F.col("word_chars") == 0, 0).otherwise(F.size("words")).cast("long"))
    out = out.withColumn("n_dup_lines", (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long"))
    out = out.withColumn("n_repeat_words", repeated_words(F.col("words"), F.col("n_words")))
    some = lambda c: F.nullif(c, F.lit(0.0))
    return out.select(
        "doc_id", "lang", "source", "h1", "h2", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        ((F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))).alias("base_failed"),
        some(F.col("n_symbols") / F.greatest("word_chars", F.lit(1))).alias("symbols"),
        some(F.col("n_dup_lines") / F.greatest(F.size("lines"), F.lit(1))).alias("dup_lines"),
        some(F.col("n_repeat_words") / F.greatest("n_words", F.lit(1))).alias("repeat_share"),
        (F.col("word_chars") / F.nullif("n_words", F.lit(0))).alias("word_length"),
        F.ln(F.nullif("n_words", F.lit(0))).alias("log_words"),
    )


def hashes() -> list[Column]:
    """Two hashes of a row's text, language and source; a verdict depends on nothing else."""
    held = [x for c in ("text", "lang", "source") for x in (F.col(c), F.col(c).isNull())]
    return [F.xxhash64(*held).alias("h1"), F.xxhash64(F.lit("second"), *held).alias("h2")]


def thresholds(measured: DataFrame, min_group: int = 50) -> DataFrame:
    """(q_lang, q_source, least and most of each measure): limits per language and source."""
    names = [name for name, *_ in (*RARE, *SPREAD)] + [f"{name}_any" for name, *_ in RARE]
    told = measured.where("n_words > 0").withColumns({f"{name}_any": F.coalesce(name, F.lit(0.0)) for name, *_ in RARE})
    sketched = told.groupBy("lang", "source")
    found = [F.count(F.lit(1)).alias("n")] + [F.kll_sketch_agg_double(c).alias(c) for c in names] + [F.count(c).alias(f"n_{c}") for c in names]
    own = materialise(sketched.agg(*found), "quality-sketches")
    merged = own.groupBy(F.col("lang").alias("of")).agg(*[F.kll_merge_agg_double(c).alias(f"all_{c}") for c in names], *[F.sum(f"n_{c}").alias(f"n_all_{c}") for c in names])
    both = own.join(merged, own["lang"].eqNullSafe(merged["of"]))

    def quantile(name: str, q: float) -> Column:
        of = lambda held: F.when(F.col(f"n_{held}") > 0, F.kll_sketch_get_quantile_double(held, F.lit(q)))
        return F.when(F.col("n") >= min_group, of(name)).otherwise(of(f"all_{name}"))

    def around(name: str, factor: float) -> tuple[Column, Column]:
        q1, q3 = quantile(name, 0.25), quantile(name, 0.75)
        width = factor * F.greatest(q3 - q1, NARROW * q3)
        return q1 - width, q3 + width

    limits = [F.when(quantile(name, q).isNotNull(), F.greatest(factor * quantile(name, q), around(f"{name}_any", WIDE)[1])).alias(f"{name}_most") for name, q, factor in RARE]
    for name, factor in SPREAD:
        limits += [x.alias(f"{name}_{end}") for x, end in zip(around(name, factor), ("least", "most"), strict=True)]
    return materialise(both.select(F.col("lang").alias("q_lang"), F.col("source").alias("q_source"), *limits), "quality-limits")


def judge(docs: DataFrame) -> DataFrame:
    """The measures of every row, and kept."""
    measured = materialise(measure(docs), "quality-measures")
    limits = small(thresholds(measured), 128)
    joined = measured.join(limits, measured["lang"].eqNullSafe(limits["q_lang"]) & measured["source"].eqNullSafe(limits["q_source"]), "left")
    fine = ~F.col("base_failed")
    for name, *_ in (*RARE, *SPREAD):
        fine &= F.coalesce(F.col(name) <= F.col(f"{name}_most"), F.lit(True))
    for name, _ in SPREAD:
        fine &= F.coalesce(F.col(name) >= F.col(f"{name}_least"), F.lit(True))
    return joined.withColumn("kept", fine)


def report(docs: DataFrame) -> DataFrame:
    return judge(docs).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def keep(docs: DataFrame) -> DataFrame:
    """The rows that pass, with the columns they came with."""
    gone = materialise(judge(docs).where("NOT kept").select("h1", "h2").distinct(), "quality-rejected")
    h1, h2 = hashes()
    return unboxed(boxed(docs, h1=h1, h2=h2).join(small(gone, 32), ["h1", "h2"], "left_anti"))
