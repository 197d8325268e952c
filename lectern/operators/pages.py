"""What is known of a page: its mentions with their evidence, the values that they state, and lists of pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.functions.scalar import words_only
from lectern.operators import review

SETTLED = ("confirmed", "amended")


def document_instances(instances: DataFrame, provenance: DataFrame, include_rejected: bool = False) -> DataFrame:
    """Instances with their best provenance row: the highest confidence, then the smallest id."""
    live = instances if include_rejected else instances.where("status <> 'rejected'")
    order = Window.partitionBy("instance_id").orderBy(F.desc("confidence"), "provenance_id")
    best = provenance.withColumn("_k", F.row_number().over(order)).where("_k = 1").select("instance_id", F.col("confidence").alias("claimed"), "excerpt", "alignment")
    return live.join(best, "instance_id", "left")


def listed(entities: DataFrame, mentions: DataFrame, tensions: DataFrame | None = None, query: str | None = None, limit: int | None = None) -> DataFrame:
    """Live pages with how many live mentions, documents, reviewed links and standing tensions they have; most documents first."""
    live = mentions.where("NOT unlinked")
    counts = live.groupBy("entity_id").agg(F.count(F.lit(1)).alias("n_mentions"), F.count_distinct("document_id").alias("n_documents"), F.count_if(F.col("status").isin(*SETTLED)).alias("n_confirmed"))
    own = entities.where("merged_into IS NULL")
    if query:
        own = own.where(F.contains(F.lower("canonical_name"), F.lit(query.lower())))
    out = own.join(counts, "entity_id", "left")
    if tensions is not None:
        out = out.join(tensions.where("status IN ('open', 'accepted')").groupBy(F.col("subject_id").alias("entity_id")).agg(F.count(F.lit(1)).alias("n_tensions")), "entity_id", "left")
    else:
        out = out.withColumn("n_tensions", F.lit(0).cast("long"))
    out = out.fillna(0, ["n_mentions", "n_documents", "n_confirmed", "n_tensions"]).select("entity_id", "type_id", "canonical_name", "n_mentions", "n_documents", "n_confirmed", "n_tensions")
    return out.orderBy(F.desc("n_documents"), "canonical_name", "entity_id").limit(limit) if limit else out


def in_document(mentions: DataFrame, entities: DataFrame) -> DataFrame:
    """(document_id, entity_id): the live pages that each document's mentions are on."""
    return mentions.where("NOT unlinked").join(entities.where("merged_into IS NULL").select("entity_id"), "entity_id", "left_semi").select("document_id", "entity_id").distinct()


def values(mentions: DataFrame, properties: DataFrame) -> DataFrame:
    """(entity_id, property_id, value, n_mentions, n_documents, n_confirmed, rank): every value that live mentions state, best confirmed first. properties: instance_id, property_id, value."""
    live = mentions.where("NOT unlinked")
    told = live.join(properties.where("value <> ''"), "instance_id").groupBy("entity_id", "property_id", "value")
    out = told.agg(F.count(F.lit(1)).alias("n_mentions"), F.count_distinct("document_id").alias("n_documents"), F.count_if(F.col("status").isin(*SETTLED)).alias("n_confirmed"))
    order = Window.partitionBy("entity_id", "property_id").orderBy(F.desc("n_confirmed"), F.desc("n_mentions"), "value")
    return out.withColumn("rank", F.row_number().over(order))


def page(entities: DataFrame, mentions: DataFrame, properties: DataFrame, names: DataFrame) -> DataFrame:
    """One row a live page: counts, other names of its mentions (instance_id, name), how many properties it has values of, how many of them have several, and whether its links are settled."""
    live = mentions.where("NOT unlinked")
    settled = F.col("status").isin(*SETTLED)
    counts = live.groupBy("entity_id").agg(F.count(F.lit(1)).alias("n_mentions"), F.count_distinct("document_id").alias("n_documents"), F.count_if(settled).alias("n_confirmed"))
    aliases = live.join(names, "instance_id").groupBy("entity_id").agg(F.collect_set("name").alias("names"))
    held = values(mentions, properties).groupBy("entity_id", "property_id").agg(F.count(F.lit(1)).alias("n")).groupBy("entity_id").agg(F.count(F.lit(1)).alias("n_properties"), F.count_if(F.col("n") > 1).alias("n_contested"))
    out = entities.where("merged_into IS NULL").join(counts, "entity_id", "left").join(aliases, "entity_id", "left").join(held, "entity_id", "left")
    out = out.fillna(0, ["n_mentions", "n_documents", "n_confirmed", "n_properties", "n_contested"])
    other = F.array_except(F.coalesce("names", F.array().cast("array<string>")), F.array("canonical_name"))
    quality = F.when((F.col("n_mentions") > 0) & (F.col("n_mentions") == F.col("n_confirmed")), "resolved").otherwise("naive_unresolved")
    return out.select("entity_id", "canonical_name", F.array_join(F.array_sort(other), "|").alias("aliases"), "n_mentions", "n_documents", "n_confirmed", "n_properties", "n_contested", quality.alias("resolution_quality"))


def shared_values_of(claims: DataFrame, a: str, b: str) -> DataFrame:
    """Values that two pages both state, with how many pages of all share them, rarest first."""
    own = claims.where("value <> '' AND NOT rejected").select("entity_id", "property_id", "value").distinct()
    both = own.where(F.col("entity_id").isin(a, b)).groupBy("property_id", "value").agg(F.count(F.lit(1)).alias("n")).where("n = 2").drop("n")
    share = own.join(F.broadcast(both), ["property_id", "value"], "left_semi").groupBy("property_id", "value").agg(F.count(F.lit(1)).alias("n_pages_sharing"))
    total = own.groupBy("property_id").agg(F.count_distinct("entity_id").alias("n_pages_of_type"))
    return share.join(total, "property_id")


def resolution_evidence(claims: DataFrame, mentions: DataFrame, a: str, b: str) -> DataFrame:
    """One row for and against two pages being one: values both state, and documents both stand in."""
    values_both = shared_values_of(claims, a, b).agg(F.count(F.lit(1)).alias("n_values"), F.min(F.col("n_pages_sharing") / F.col("n_pages_of_type")).alias("rarest"))
    live = mentions.where("NOT unlinked").where(F.col("entity_id").isin(a, b)).select("document_id", "entity_id").distinct()
    documents = live.groupBy("document_id").agg(F.count(F.lit(1)).alias("n")).agg(F.count_if(F.col("n") == 2).alias("n_documents"))
    return values_both.crossJoin(documents)  # two single rows


def evidence_of_pairs(pairs: DataFrame, claims: DataFrame, mentions: DataFrame, bearing: DataFrame, identifiers: list[str]) -> DataFrame:
    """One row for each pair (a, b): what speaks for and against its two pages being one, and a digest of it.

    claims: entity_id, property_id, value; those of ``identifiers`` are counted apart. rarest: the least share of
    the property's pages that have a common value. mentions: entity_id, document_id; documents
    that both stand in. bearing: entity_id, register_id, identifier; registers that give both a common number, and those that
    give both numbers, none in common. Nulls and empty values count for nothing; a pair without evidence keeps its row.
    The digest takes what is common to the pair, not how rare it is among others.
    """
    pairs = pairs.select("a", "b").where("a <> b").distinct()

    def common(rows: DataFrame, *keys: str) -> DataFrame:
        own = rows.dropna(subset=["entity_id", *keys]).select("entity_id", *keys).distinct()
        return pairs.join(own.withColumnRenamed("entity_id", "a"), "a").join(own.withColumnRenamed("entity_id", "b"), ["b", *keys])

    def mark(*columns: str) -> Column:
        return F.bit_xor(F.xxhash64(*columns))

    stated = claims.where("value <> ''").select("entity_id", "property_id", "value").distinct()
    sharing = stated.groupBy("property_id", "value").agg(F.count(F.lit(1)).alias("n"))
    of_type = stated.groupBy("property_id").agg(F.count_distinct("entity_id").alias("all"))
    share = sharing.join(of_type, "property_id").select("property_id", "value", (F.col("n") / F.col("all")).alias("share"))
    known = F.col("property_id").isin(identifiers)
    values = common(stated, "property_id", "value").join(share, ["property_id", "value"]).groupBy("a", "b").agg(F.count_if(known).alias("n_identifiers"), F.count_if(~known).alias("n_values"), F.min("share").alias("rarest"), mark("property_id", "value").alias("_values"))
    documents = common(mentions, "document_id").groupBy("a", "b").agg(F.count(F.lit(1)).alias("n_documents"), mark("document_id").alias("_documents"))
    numbered = bearing.where("identifier <> ''")
    agreed = common(numbered, "register_id", "identifier").select("a", "b", "register_id").distinct().withColumn("agrees", F.lit(True))
    registers = common(numbered, "register_id").join(agreed, ["a", "b", "register_id"], "left").groupBy("a", "b").agg(F.count("agrees").alias("n_registers_for"), F.count_if(F.col("agrees").isNull()).alias("n_registers_against"), mark("register_id", "agrees").alias("_registers"))
    found = pairs.join(values, ["a", "b"], "left").join(documents, ["a", "b"], "left").join(registers, ["a", "b"], "left")
    counts = ["n_identifiers", "n_values", "n_documents", "n_registers_for", "n_registers_against"]
    found = found.fillna(0, [*counts, "_values", "_documents", "_registers"])
    digest = F.sha2(F.concat_ws(":", *counts, "_values", "_documents", "_registers"), 256)
    return found.select("a", "b", *counts, "rarest", digest.alias("digest"))


def pair_verdicts(evidence: DataFrame, judgements: DataFrame) -> DataFrame:
    """(a, b, status, stale) of the pairs that somebody has judged (seq, a, b, status, digest, rationale), in either order of the two: the last judgement. One that rests on other evidence is stale and settles nothing: its pair is open again."""
    pair = F.concat_ws(":", F.least("a", "b"), F.greatest("a", "b"))
    said = judgements.select("seq", pair.alias("fingerprint"), "status", "digest", "rationale")
    asked = evidence.select(pair.alias("fingerprint"), "digest", "a", "b").join(said, "fingerprint", "left_semi")
    return review.judged(asked, said).select("a", "b", "status", "stale")


def unextracted(pages: DataFrame, instances: DataFrame, name: str) -> DataFrame:
    """Documents (doc_id) whose pages hold a name as a phrase but that have no instance of it (doc_id, name)."""
    phrase = F.concat(F.lit(" "), words_only(F.lit(name)), F.lit(" "))
    holding = pages.where(F.contains(F.concat(F.lit(" "), words_only(F.col("text")), F.lit(" ")), phrase)).select("doc_id").distinct()
    return holding.join(instances.where(words_only(F.col("name")) == words_only(F.lit(name))).select("doc_id"), "doc_id", "left_anti")


# ---- references -----------------------------------------------------------------------------

#: What a reference's prefix stands for.
KINDS = {"doc": "document", "ent": "entity", "ins": "instance", "edge": "edge", "ten": "tension", "reg": "register", "act": "actor"}


def resolved(refs: DataFrame, known: DataFrame) -> DataFrame:
    """refs (place, ref) as cards, each ref once at its first place. known: ref, label, visible, redacted."""
    once = refs.groupBy("ref").agg(F.min("place").alias("place"))
    prefix = F.element_at(F.split("ref", "_"), 1)
    kind = F.lit("unknown")
    for short, name in KINDS.items():
        kind = F.when(prefix == short, name).otherwise(kind)
    state = F.when(F.col("visible").isNull(), "not_found").when(~F.col("visible"), "denied").when(F.col("redacted"), "redacted").otherwise("ok")
    told = once.join(known, "ref", "left").withColumn("state", state)
    return told.select("place", "ref", kind.alias("kind"), "state", F.when(F.col("state") == "ok", F.col("label")).alias("label"))


def found_refs(known: DataFrame, query: str, limit: int | None = None) -> DataFrame:
    """Visible references whose label holds the query, shortest labels first."""
    held = known.where("visible AND NOT redacted").where(F.contains(F.lower("label"), F.lit(query.lower())))
    return held.select("ref", "label").orderBy(F.length("label"), "label", "ref").limit(limit) if limit else held.select("ref", "label")
