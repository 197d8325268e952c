"""Where documents agree and where they don't: wordings, relations that several documents state, standing tensions."""

from __future__ import annotations

from collections.abc import Iterator
from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.functions.scalar import words_only
from lectern.operators.graph import kept

#: From this likeness on, two excerpts are one wording; the least number of documents that agree.
COPIED, LEAST_DOCUMENTS = 0.92, 2


def alike(a: str, b: str) -> bool:
    """Whether two texts are one wording. Lengths and counts of characters bound the likeness from above and are asked first."""
    if not a or not b:
        return not a and not b
    if a == b:
        return True
    if 2 * min(len(a), len(b)) < COPIED * (len(a) + len(b)):
        return False
    matcher = SequenceMatcher(None, a, b)
    return matcher.quick_ratio() >= COPIED and matcher.ratio() >= COPIED


def cluster(texts: list[str]) -> list[int]:
    """The number of each text's group: the first group whose first text it is like, else a new one."""
    heads: list[str] = []
    known: dict[str, int] = {}
    out = []
    for text in texts:
        if text not in known:
            known[text] = next((i for i, head in enumerate(heads) if alike(text, head)), len(heads))
            if known[text] == len(heads):
                heads.append(text)
        out.append(known[text])
    return out


def wordings(sources: DataFrame, keys: list[str]) -> DataFrame:
    """sources (keys, document_id, excerpt) grouped into wordings: (keys, n_documents, n_wordings, n_copied, independent, note).

    Equal normalised texts are one row before any two are compared, so that a sentence that
    stands in very many documents is compared once. n_copied counts wordings of several documents.
    """
    normal = sources.select(*keys, "document_id", words_only(F.coalesce("excerpt", F.lit(""))).alias("text"))
    documents = normal.groupBy(*keys).agg(F.count_distinct("document_id").alias("n_documents"))
    # What is compared is each different text once, in the order of the first document that has it.
    each = normal.groupBy(*keys, "text").agg(F.min("document_id").alias("first"), F.count_distinct("document_id").alias("d"))
    several = each.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_texts"), F.max("d").alias("most"), F.sort_array(F.collect_list(F.struct("first", "text", "d"))).alias("texts"))
    alone = several.where("n_texts = 1").select(*keys, F.lit(1).cast("long").alias("n_wordings"), (F.col("most") > 1).cast("long").alias("n_copied"))
    kinds = ", ".join(f"{k} {dict(sources.dtypes)[k]}" for k in keys)

    def grouped(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            counts = []
            for held, documents in zip(batch["texts"], batch["d"], strict=True):
                sizes: dict[int, int] = {}
                for group, d in zip(cluster(list(held)), documents, strict=True):
                    sizes[group] = sizes.get(group, 0) + d
                counts.append((len(sizes), sum(n > 1 for n in sizes.values())))
            yield batch[keys].assign(n_wordings=[n for n, _ in counts], n_copied=[c for _, c in counts])

    compared = several.where("n_texts > 1").select(*keys, "texts.text", "texts.d").toDF(*keys, "texts", "d").mapInPandas(grouped, f"{kinds}, n_wordings long, n_copied long")
    out = documents.join(alone.unionByName(compared), keys)
    note = F.when(F.col("n_documents") < LEAST_DOCUMENTS, "one document").when(F.col("n_wordings") == 1, "one wording, copied").when(F.col("n_wordings") < F.col("n_documents"), "some copied").otherwise("each its own")
    return out.select(*keys, "n_documents", "n_wordings", "n_copied", (F.col("n_wordings") >= 2).alias("independent"), note.alias("note"))


def corroborated_values(claims: DataFrame, reviewed_only: bool = False) -> DataFrame:
    """Values that several documents state: wordings, and how many other values the page has of that property."""
    live = claims.where("NOT rejected AND value <> ''")
    live = live.where("reviewed") if reviewed_only else live
    keys = ["entity_id", "property_id", "value"]
    several = live.groupBy(*keys).agg(F.count_distinct("document_id").alias("d")).where(F.col("d") >= LEAST_DOCUMENTS).select(*keys)
    told = wordings(live.join(several, keys, "left_semi"), keys)
    others = live.groupBy("entity_id", "property_id").agg((F.count_distinct("value") - 1).alias("n_other_values"))
    return told.join(others, ["entity_id", "property_id"])


def corroborated_relations(statements: DataFrame) -> DataFrame:
    """statements (from_page, link_type_id, to_page, document_id, excerpt) of several documents, by wordings."""
    keys = ["from_page", "link_type_id", "to_page"]
    statements = kept(statements.select(*keys, "document_id", "excerpt"))  # read twice; the joins that make it are shuffled once
    several = statements.groupBy(*keys).agg(F.count_distinct("document_id").alias("d")).where(F.col("d") >= LEAST_DOCUMENTS).select(*keys)
    return wordings(statements.join(several, keys, "left_semi"), keys)


def summary(values: DataFrame) -> DataFrame:
    """One row: corroborated values, those of independent wordings, those of one copied wording, and pages that have any."""
    return values.agg(F.count(F.lit(1)).alias("n_values"), F.count_if("independent").alias("n_independent"), F.count_if(~F.col("independent")).alias("n_copied"), F.count_distinct("entity_id").alias("n_pages"))


def conflict_sides(claims: DataFrame) -> DataFrame:
    """(entity_id, property_id, value, instance_id): one side for each different value of a contested property, the smallest instance speaking for it."""
    live = claims.where("reviewed AND NOT rejected AND value <> ''")
    sides = live.groupBy("entity_id", "property_id", "value").agg(F.min("instance_id").alias("instance_id"))
    contested = sides.groupBy("entity_id", "property_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("entity_id", "property_id")
    return sides.join(contested, ["entity_id", "property_id"], "left_semi")


def tensions_of_documents(sides: DataFrame) -> DataFrame:
    """(document_id, n_tensions): standing tensions whose sides (tension_id, document_id, status) touch each document."""
    return sides.where("status IN ('open', 'accepted')").groupBy("document_id").agg(F.count_distinct("tension_id").alias("n_tensions"))


def tensions_of_instances(sides: DataFrame) -> DataFrame:
    """(instance_id, tensions): the standing tensions that each instance is a side of."""
    return sides.where("status IN ('open', 'accepted')").groupBy("instance_id").agg(F.array_join(F.array_sort(F.collect_set("tension_id")), ",").alias("tensions"))
