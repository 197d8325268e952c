"""Names to pages: proposals, duplicates, conflicts, agreement, counterparties."""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lectern.functions.scalar import HONORIFICS, LEGAL_FORMS, name_key, words_only
from lectern.operators import likeness
from lectern.operators.graph import kept

#: The least score of a fuzzy pair and of a near spelling.
SIMILAR, NEAR = 80.0, 0.85
#: Words that don't say which thing is meant, beside legal forms and titles; what pairs are offered for, strongest first.
PLAIN = ["the", "and", "of", "for", "a", "an"]
BASES = ["naive_key", "initials", "similar"]
COMMON = {*LEGAL_FORMS, *HONORIFICS, *PLAIN}
#: Words for the part that somebody plays in a document, which are no names.
ROLES = """franchisee franchisor licensor licensee sublicensee supplier customer buyer seller purchaser vendor contractor subcontractor client consultant
party parties distributor reseller sponsor agent lender borrower guarantor employer employee manufacturer developer owner tenant landlord disclosing
receiving recipient assignor assignee lessor lessee""".split()


def unlinked(instances: DataFrame, mentions: DataFrame) -> DataFrame:
    return instances.join(mentions.where("NOT unlinked"), "instance_id", "left_anti")


def propose(named: DataFrame, style: str = "organisation", scoped: list[str] | None = None) -> DataFrame:
    """named (instance_id, document_id, name, identifier) grouped by identifier, else by the name's key, else by itself; titled by the longest name.

    Names of types that are scoped to a document (column type_id, where there are any) are titles:
    they group within their document alone.
    """
    own = F.col("type_id").isin(scoped) if scoped else F.lit(False)
    key = name_key(F.col("name"), style)
    basis = F.when(own, "document").when(F.coalesce("identifier", F.lit("")) != "", "identifier").when(F.coalesce(key, F.lit("")) != "", "name_key").otherwise("instance")
    keyed = named.withColumn("basis", basis).withColumn("_key", key)
    group = F.when(F.col("basis") == "document", F.concat_ws(":", "document_id", "_key")).when(F.col("basis") == "identifier", F.col("identifier")).when(F.col("basis") == "name_key", F.col("_key")).otherwise(F.col("instance_id").cast("string") if "instance_id" in named.columns else F.lit(""))
    keyed = keyed.withColumn("group_key", group)
    title = F.min_by("name", F.struct(-F.length("name"), F.col("name")))
    return keyed.groupBy("basis", "group_key").agg(title.alias("title"), F.count(F.lit(1)).alias("n_mentions"), F.count_distinct("document_id").alias("n_documents"))


def attached(proposals: DataFrame, pages: DataFrame) -> DataFrame:
    """proposals with the page (entity_id, identifier, name_key) that each belongs to on its own basis, the smallest of several; null for a new page."""
    by_id = pages.where("identifier <> ''").groupBy(F.lit("identifier").alias("basis"), F.col("identifier").alias("group_key")).agg(F.min("entity_id").alias("entity_id"))
    by_key = pages.where("name_key <> ''").groupBy(F.lit("name_key").alias("basis"), F.col("name_key").alias("group_key")).agg(F.min("entity_id").alias("entity_id"))
    return proposals.join(by_id.unionByName(by_key), ["basis", "group_key"], "left")


def same_key(pages: DataFrame, style: str = "organisation") -> DataFrame:
    """Keys that several live pages of a type share."""
    keyed = pages.where("merged_into IS NULL").withColumn("name_key", name_key(F.col("canonical_name"), style))
    return keyed.groupBy("type_id", "name_key").agg(F.count(F.lit(1)).alias("n_pages"), F.min("entity_id").alias("first_page")).where("n_pages > 1")


def distinguishing(a: str, b: str) -> tuple[set[str], set[str]]:
    """The words of each name that say which thing is meant and that the other has in no spelling."""
    left, right = (set(re.findall(r"\w+", (x or "").lower())) for x in (a, b))
    def own(mine: set[str], others: set[str]) -> set[str]:
        told = {w for w in mine - others if len(w) > 1 and w not in COMMON}
        return {w for w in told if all(SequenceMatcher(None, w, o).ratio() < NEAR for o in others - mine)}

    return own(left, right), own(right, left)


def could_be_one(a: str, b: str) -> bool:
    """Not if each name has a distinctive word that the other lacks."""
    return not all(distinguishing(a, b))


def initials_differ(a: str, b: str) -> bool:
    """Whether two personal names are one but for a middle initial: first and last are equal, and no two middle names contradict each other."""
    left, right = (re.findall(r"\w+", (x or "").lower()) for x in (a, b))
    if min(len(left), len(right)) < 2 or (left[0], left[-1]) != (right[0], right[-1]) or left[1:-1] == right[1:-1]:
        return False
    middles = left[1:-1] + right[1:-1]
    fits = lambda x, y: x[0] == y[0] if 1 in (len(x), len(y)) else x == y
    return any(len(m) == 1 for m in middles) and all(fits(x, y) for x in left[1:-1] for y in right[1:-1])


def basis_of(pairs: DataFrame, a: str = "name", b: str = "other_name") -> DataFrame:
    """pairs with the basis that their names give, those left out that name two things."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            names = zip(batch[a], batch[b], strict=True)
            yield batch.assign(basis=["initials" if initials_differ(x, y) else "similar" if could_be_one(x, y) else None for x, y in names])

    return pairs.mapInPandas(run, ", ".join(f"{c} {t}" for c, t in pairs.dtypes) + ", basis string").where("basis IS NOT NULL")


def sorted_words(name: Column) -> Column:
    return F.array_join(F.array_sort(F.split(F.btrim(F.lower(name)), r"\s+")), " ")


def telling_words(name: str) -> set[str]:
    """The words of a name that say which thing is meant."""
    return {w for w in re.findall(r"\w+", (name or "").lower()) if len(w) > 1 and w not in COMMON}


@F.pandas_udf(T.ArrayType(T.StructType().add("word", "string").add("telling", "boolean")))
def words_of(names: pd.Series) -> pd.Series:
    return names.map(lambda name: [{"word": w, "telling": w in told} for told in [telling_words(name)] for w in set(re.findall(r"\w+", (name or "").lower()))])


def near_name_pairs(names: DataFrame, least: float = SIMILAR) -> DataFrame:
    """(type_id, name, other_name, score): the pairs of different names (type_id, name) of a type that score ``least`` or more and could be one thing, name < other_name.

    Of two names that could be one thing one has all its telling words in the other, equal or in
    a near spelling (``could_be_one``). So a name is compared with those that hold its rarest
    telling word, and a name without any with those that share its rarest characters. Names
    with one middle initial more or less are such pairs too: what differs tells nothing on one side.
    Near spellings are taken a little too widely here, so some pairs more are left; ``basis_of`` decides.
    """
    names = names.distinct()
    words = kept(names.select("type_id", "name", F.explode(words_of("name")).alias("w")).select("type_id", "name", "w.*"))
    plain = names.join(words.where("telling"), ["type_id", "name"], "left_anti")
    pairs = likeness.word_candidates(words, least, 100 * NEAR).union(likeness.plain_candidates(plain, names, least))
    return likeness.scored(pairs, least)


def duplicate_names(pages: DataFrame, least: float = SIMILAR) -> DataFrame:
    """(type_id, name, other_name, n_pages, n_other_pages, basis, score): pairs of different names that may be one thing, each with the number of live pages under it.

    Names are compared as lower-case words in order; pages of one name are a class, which has one
    row for each other class, whatever its size. Pages without a name are left out.
    """
    held = pages.where("merged_into IS NULL").groupBy("type_id", sorted_words(F.col("canonical_name")).alias("name")).agg(F.count(F.lit(1)).alias("n"), F.min("canonical_name").alias("told")).where("name <> ''")
    near = near_name_pairs(held.select("type_id", "name"), least)
    one = held.select("type_id", "name", F.col("n").alias("n_pages"), "told")
    other = held.select("type_id", F.col("name").alias("other_name"), F.col("n").alias("n_other_pages"), F.col("told").alias("other_told"))
    return basis_of(near.join(one, ["type_id", "name"]).join(other, ["type_id", "other_name"]), "told", "other_told").select("type_id", "name", "other_name", "n_pages", "n_other_pages", "basis", "score")


def duplicate_pages(pages: DataFrame, settled: DataFrame | None = None, least: float = SIMILAR, styles: dict[str, str] | None = None) -> DataFrame:
    """(type_id, entity_id, other_id, basis, score): pairs of live pages of a type that may be one thing.

    Pages of one key come first, at 100. Others score 100 * 2 LCS / (m + n) over their lower-case
    words in order, ``least`` or more, and are left out if each has a distinctive word that the
    other lacks. Different names are scored once, however many pages have them. Pairs that a
    person has settled (entity_id, other_id) are left out too.
    """
    key = name_key(F.col("canonical_name"))
    for type_id, style in (styles or {}).items():
        key = F.when(F.col("type_id") == type_id, name_key(F.col("canonical_name"), style)).otherwise(key)
    live = pages.where("merged_into IS NULL").select("entity_id", "type_id", "canonical_name", key.alias("key"), sorted_words(F.col("canonical_name")).alias("name"))
    near = near_name_pairs(live.where("name <> ''").select("type_id", "name").distinct(), least)
    own = live.select("type_id", "name", "key", "entity_id", "canonical_name")
    others = own.select("type_id", F.col("name").alias("other_sorted"), F.col("key").alias("other_key"), F.col("entity_id").alias("other_id"), F.col("canonical_name").alias("other_name"))
    ahead = F.col("entity_id") < F.col("other_id")
    ids = [F.when(ahead, F.col("entity_id")).otherwise(F.col("other_id")).alias("entity_id"), F.when(ahead, F.col("other_id")).otherwise(F.col("entity_id")).alias("other_id")]
    named = [F.col("canonical_name").alias("name"), "other_name"]
    similar = near.withColumnRenamed("other_name", "other_sorted").join(own, ["type_id", "name"]).join(others, ["type_id", "other_sorted"]).where("NOT key <=> other_key").select("type_id", *ids, "score", *named)
    equal = own.where("name <> ''").join(others, "type_id").where("name = other_sorted AND NOT key <=> other_key AND entity_id < other_id").select("type_id", "entity_id", "other_id", F.lit(100.0).alias("score"), *named)
    by_key = own.where("key <> ''").join(others, "type_id").where("key = other_key AND entity_id < other_id").select("type_id", "entity_id", "other_id", F.lit("naive_key").alias("basis"), F.lit(100.0).alias("score"))
    out = by_key.unionByName(basis_of(similar.unionByName(equal)).select("type_id", "entity_id", "other_id", "basis", "score"))
    return out if settled is None else out.join(settled.select("entity_id", "other_id"), ["entity_id", "other_id"], "left_anti")


def duplicate_classes(pages: DataFrame, least: float = SIMILAR, styles: dict[str, str] | None = None) -> tuple[DataFrame, DataFrame]:
    """What ``duplicate_pages`` tells, with copies not expanded: members (type_id, entity_id, class_id) and pairs (type_id, class_id, other_id, n_pairs, basis, score).

    Live pages of one type and name are a class, named by its smallest page. Each pair of classes
    stands for all pairs of their pages, ``n_pairs`` of them; a class is paired with itself if its
    pages have a key, which makes them one thing.
    """
    key = name_key(F.col("canonical_name"))
    for type_id, style in (styles or {}).items():
        key = F.when(F.col("type_id") == type_id, name_key(F.col("canonical_name"), style)).otherwise(key)
    live = pages.where("merged_into IS NULL").select("entity_id", "type_id", "canonical_name")
    classes = live.groupBy("type_id", "canonical_name").agg(F.min("entity_id").alias("class_id"), F.count(F.lit(1)).alias("n"))
    classes = kept(classes.select("*", key.alias("key"), sorted_words(F.col("canonical_name")).alias("name")))
    held = classes.select("type_id", "canonical_name", F.col("class_id"))
    same = [live["type_id"].eqNullSafe(held["type_id"]), live["canonical_name"].eqNullSafe(held["canonical_name"])]
    members = live.join(held, same).select(live["type_id"], live["entity_id"], held["class_id"])
    others = classes.select("type_id", F.col("name").alias("other_sorted"), F.col("key").alias("other_key"), F.col("class_id").alias("other_id"), F.col("canonical_name").alias("other_name"), F.col("n").alias("m"))
    ahead = F.col("class_id") < F.col("other_id")
    ids = [F.least("class_id", "other_id").alias("class_id"), F.greatest("class_id", "other_id").alias("other_id")]
    told = lambda df, score: df.select("type_id", *ids, (F.col("n") * F.col("m")).alias("n_pairs"), score.alias("score"), F.col("canonical_name").alias("name"), "other_name")
    near = near_name_pairs(classes.where("name <> ''").select("type_id", "name"), least).withColumnRenamed("other_name", "other_sorted")
    similar = told(near.join(classes, ["type_id", "name"]).join(others, ["type_id", "other_sorted"]).where("NOT key <=> other_key"), F.col("score"))
    equal = told(classes.where("name <> ''").join(others, [classes["type_id"] == others["type_id"], classes["name"] == others["other_sorted"]]).drop(others["type_id"]).where("NOT key <=> other_key").where(ahead), F.lit(100.0))
    by_key = classes.where("key <> ''").join(others, [classes["type_id"] == others["type_id"], classes["key"] == others["other_key"]]).drop(others["type_id"]).where("class_id <= other_id")
    by_key = by_key.select("type_id", "class_id", "other_id", F.when(ahead, F.col("n") * F.col("m")).otherwise(F.expr("n * (n - 1) div 2")).alias("n_pairs"), F.lit("naive_key").alias("basis"), F.lit(100.0).alias("score"))
    return members, by_key.where("n_pairs > 0").unionByName(basis_of(similar.unionByName(equal)).select("type_id", "class_id", "other_id", "n_pairs", "basis", "score"))


def first_pairs(members: DataFrame, pairs: DataFrame, limit: int = 50) -> DataFrame:
    """(entity_id, other_id, basis, score) of the pages of ``duplicate_classes``: enough of them that the first by basis, score and ids are among them.

    Of pairs of classes only those count whose own first pair of pages is among the first; of a
    class its first pages, as each later one stands behind as many pairs.
    """
    rank = F.array_position(F.array(*map(F.lit, BASES)), F.col("basis"))
    shared = F.col("class_id") == F.col("other_id")
    place = F.row_number().over(Window.partitionBy("type_id", "class_id").orderBy("entity_id"))
    seconds = members.where("entity_id <> class_id").groupBy("class_id").agg(F.min("entity_id").alias("_second"))
    first = pairs.withColumn("_rank", rank).join(seconds, "class_id", "left").withColumn("_after", F.when(shared, F.col("_second")).otherwise(F.col("other_id")))
    first = kept(first.orderBy("_rank", F.desc("score"), "class_id", "_after").limit(limit).select("class_id", "other_id", "basis", "score"))
    wanted = first.select("class_id").union(first.select("other_id")).distinct()
    page = kept(members.join(F.broadcast(wanted), "class_id", "left_semi").withColumn("_k", place).where(F.col("_k") <= limit + 1).select("class_id", "entity_id"))  # a row for each of few classes and places
    each = first.join(page.withColumnRenamed("entity_id", "_a"), "class_id").join(page.select(F.col("class_id").alias("other_id"), F.col("entity_id").alias("_b")), "other_id").where(~shared | (F.col("_a") < F.col("_b")))
    return each.select(F.least("_a", "_b").alias("entity_id"), F.greatest("_a", "_b").alias("other_id"), "basis", "score")


def ranked_offers(pairs: DataFrame, mentions: DataFrame, limit: int = 50) -> DataFrame:
    """The first pairs by basis and score, with the page to keep: that of more live mentions, then the smaller id."""
    n = mentions.where("NOT unlinked").groupBy("entity_id").agg(F.count(F.lit(1)).alias("n"))
    rank = F.array_position(F.array(*map(F.lit, BASES)), F.col("basis"))
    first = pairs.withColumn("rank", rank).orderBy("rank", F.desc("score"), "entity_id", "other_id").limit(limit)
    told = first.join(n, "entity_id", "left").join(n.select(F.col("entity_id").alias("other_id"), F.col("n").alias("m")), "other_id", "left").fillna(0, ["n", "m"])
    return told.select("rank", "entity_id", "other_id", "basis", "score", F.when(F.col("m") > F.col("n"), F.col("other_id")).otherwise(F.col("entity_id")).alias("keep_id"))


def candidates_for(mentions: DataFrame, pages: DataFrame, least: float = SIMILAR, bases: Sequence[str] = ("identifier", *BASES)) -> DataFrame:
    """(instance_id, entity_id, basis, score): pages that a mention (instance_id, type_id, name, identifier) may belong to, each once on its strongest basis.

    pages: entity_id, type_id, canonical_name, identifier, merged_into. Of the ``bases`` that are asked for,
    names are compared only for those that a comparison gives; as these come last, the others are the same without them.
    """
    live = pages.where("merged_into IS NULL").withColumn("key", name_key(F.col("canonical_name"))).withColumn("name_sorted", sorted_words(F.col("canonical_name")))
    asked = mentions.withColumn("key", name_key(F.col("name"))).withColumn("asked_sorted", sorted_words(F.col("name")))
    by_id = asked.where("identifier <> ''").join(live.select("type_id", "identifier", "entity_id"), ["type_id", "identifier"]).select("instance_id", "entity_id", F.lit("identifier").alias("basis"), F.lit(100.0).alias("score"))
    by_key = asked.where("key <> ''").join(live.select("type_id", "key", "entity_id"), ["type_id", "key"]).select("instance_id", "entity_id", F.lit("naive_key").alias("basis"), F.lit(100.0).alias("score"))
    rank = F.array_position(F.array(*map(F.lit, ["identifier", *BASES])), F.col("basis"))
    order = Window.partitionBy("instance_id", "entity_id").orderBy(rank, F.desc("score"))
    first = lambda out: out.withColumn("_k", F.row_number().over(order)).where("_k = 1").drop("_k").where(F.col("basis").isin(list(bases)))
    if not {"initials", "similar"} & set(bases):
        return first(by_id.unionByName(by_key))
    both = asked.select("type_id", F.col("asked_sorted").alias("name")).union(live.select("type_id", F.col("name_sorted").alias("name"))).where("name <> ''").distinct()
    near = near_name_pairs(both, least)
    near = near.union(near.select("type_id", "other_name", "name", "score"))
    found = near.select("type_id", F.col("name").alias("asked_sorted"), F.col("other_name").alias("name_sorted"), "score").join(asked.select("instance_id", "type_id", "asked_sorted", "name"), ["type_id", "asked_sorted"])
    found = found.join(live.select("type_id", "name_sorted", "entity_id", F.col("canonical_name").alias("other_name")), ["type_id", "name_sorted"])
    fuzzy = basis_of(found.select("instance_id", "entity_id", "score", "name", "other_name")).select("instance_id", "entity_id", "basis", "score")
    return first(by_id.unionByName(by_key).unionByName(fuzzy))


def unnamed(pages: DataFrame) -> DataFrame:
    """Live pages under the part that somebody plays, or under a name without letters."""
    name = F.btrim(F.coalesce("canonical_name", F.lit("")))
    bare = F.btrim(F.regexp_replace(F.btrim(F.lower(name), F.lit(".")), "^the ", ""))
    return pages.where("merged_into IS NULL").where(bare.isin(ROLES) | ~name.rlike(r"\p{L}"))


def conflicts(claims: DataFrame) -> DataFrame:
    """Properties of which a page's reviewed, live claims state different values."""
    live = claims.where("reviewed AND NOT rejected AND value <> ''")
    found = live.groupBy("entity_id", "property_id").agg(F.count_distinct("value").alias("n_values"), F.array_join(F.array_sort(F.collect_set("value")), "|").alias("stated"))
    return found.where("n_values > 1")


def corroborated(claims: DataFrame, min_documents: int = 2) -> DataFrame:
    """Values that several documents state, and in how many wordings."""
    live = claims.where("NOT rejected AND value <> ''")
    found = live.groupBy("entity_id", "property_id", "value").agg(F.count_distinct("document_id").alias("n_documents"), F.count_distinct(words_only(F.col("excerpt"))).alias("n_wordings"))
    return found.where(F.col("n_documents") >= min_documents).withColumn("independent", F.col("n_wordings") >= 2)


def shared_values(claims: DataFrame, property_id: str) -> DataFrame:
    """Values of a property with the pages that state them: how many of all."""
    own = claims.where(F.col("property_id") == property_id).where("value <> ''")
    total = own.agg(F.count_distinct("entity_id").alias("n_pages_of_type"))
    return own.groupBy("value").agg(F.count_distinct("entity_id").alias("n_pages_sharing")).crossJoin(F.broadcast(total))  # one row


def counterparties(mentions: DataFrame) -> DataFrame:
    """Pages that live mentions put into several documents: documents, and whether a reviewed link says so."""
    live = mentions.where("NOT unlinked")
    found = live.groupBy("entity_id").agg(F.count_distinct("document_id").alias("n_documents"), F.count_if(F.col("status").isin("confirmed", "amended")).alias("n_reviewed"))
    return found.where("n_documents > 1")


def matches_elsewhere(instances: DataFrame, mentions: DataFrame) -> DataFrame:
    """Per mention (instance_id, document_id, type_id, name, name_key): in how many other documents it stands, as its type and as another, and under how many other names.

    A reviewed link's page says so where there is one; else an equal key does, in types of any
    name. Groups are counted, not gathered: documents of a type, those of that type alone, and all.
    """
    live = mentions.where("NOT unlinked AND status IN ('confirmed', 'amended')").select("instance_id", "entity_id")
    # Looked at several times from here on.
    held = kept(instances.select("instance_id", "document_id", "type_id", "name", "name_key").join(live, "instance_id", "left"))

    def counted(own: DataFrame, key: str) -> DataFrame:
        """own with the counts of its groups by a column."""
        grouped = held.where(F.coalesce(key, F.lit("")) != "")
        # Each type of a document once, with how many types the document has under the key.
        each = grouped.groupBy(key, "document_id").agg(F.collect_set("type_id").alias("types"))
        cells = each.select(key, "document_id", F.size("types").alias("n_types"), F.explode("types").alias("type_id"))
        same = cells.groupBy(key, "type_id").agg(F.count("document_id").alias("n_same"), F.count_if(F.col("n_types") == 1).alias("n_alone"))
        whole = each.groupBy(key).agg(F.count(F.lit(1)).alias("n_all")).join(grouped.groupBy(key).agg(F.count_distinct("name").alias("n_names")), key)
        told = own.join(each.select(key, "document_id", F.size("types").alias("n_types")), [key, "document_id"]).join(same.join(whole, key), [key, "type_id"])
        elsewhere = F.col("n_all") - F.col("n_alone") - F.when(F.col("n_types") > 1, 1).otherwise(0)
        basis = "reviewed_link" if key == "entity_id" else "naive_key"
        return told.select("instance_id", F.lit(basis).alias("basis"), (F.col("n_same") - 1).alias("n_documents"), elsewhere.alias("n_cross_type"), (F.col("n_names") - 1).alias("n_other_names"))

    return counted(held.where("entity_id IS NOT NULL"), "entity_id").unionByName(counted(held.where("entity_id IS NULL AND name_key <> ''"), "name_key"))


def identifier_matches(instances: DataFrame) -> DataFrame:
    """(identifier, n_documents, n_names): identifiers that stand in several documents."""
    own = instances.where("identifier <> ''")
    return own.groupBy("identifier").agg(F.count_distinct("document_id").alias("n_documents"), F.count_distinct("name").alias("n_names")).where("n_documents > 1")


def against_peers(orders: DataFrame, key: str, value: str) -> DataFrame:
    """Each group's median, extremes and count."""
    return orders.groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.median(value).alias("median_value"), F.max(value).alias("max_value"), F.min(value).alias("min_value"))


def compared_values(contracts: DataFrame) -> DataFrame:
    """contracts (document_id, counterparty, currency, value): each against its counterparty's others in the same currency, none being a currency too.

    What the others' median and extremes are follows from a contract's rank and a few values of
    its group, those in the middle and at both ends; no group is gathered.
    """
    group = ["counterparty", "_currency"]
    held = contracts.withColumn("_currency", F.coalesce("currency", F.lit("")))
    ranked = held.withColumn("r", F.row_number().over(Window.partitionBy(*group).orderBy("value", "document_id")))
    n = ranked.groupBy(*group).agg(F.max("r").alias("n")).where("n > 1")
    told = ranked.join(n, group)
    # Place p of the others (from 1) is place p of all, or the next if the contract itself stands before.
    low, high = F.floor(F.col("n") / 2).cast("int"), F.floor((F.col("n") + 1) / 2).cast("int")
    at = {"a": low, "b": low + 1, "c": high, "d": high + 1, "first": F.lit(1), "second": F.lit(2), "last": F.col("n"), "before": F.col("n") - 1}
    spots = told.groupBy(*group, "n").agg(*[F.max(F.when(F.col("r") == p, F.col("value"))).alias(f"at_{k}") for k, p in at.items()])
    out = told.join(spots, [*group, "n"])
    pick = lambda p, here, after: F.when(F.col("r") > p, F.col(f"at_{here}")).otherwise(F.col(f"at_{after}"))
    median = (pick(low, "a", "b") + pick(high, "c", "d")) / 2
    out = out.select(
        "document_id", "value", (F.col("n") - 1).cast("long").alias("n_peers"), median.alias("median_value"),
        F.when(F.col("r") == F.col("n"), F.col("at_before")).otherwise(F.col("at_last")).alias("max_value"),
        F.when(F.col("r") == 1, F.col("at_second")).otherwise(F.col("at_first")).alias("min_value"),
    )
    return out.withColumn("ratio", F.round(F.col("value") / F.nullif("median_value", F.lit(0.0)), 2))


def follow_merges(pages: DataFrame) -> DataFrame:
    """(entity_id, survivor): merge pointers followed to their end, twice as far each round; pointers in a ring come to its smallest page."""
    out = pages.select("entity_id", F.coalesce("merged_into", "entity_id").alias("survivor"))
    seen = None
    while True:
        step = out.select(F.col("entity_id").alias("_at"), F.col("survivor").alias("_to"))
        out = out.join(step, F.col("survivor") == F.col("_at"), "left").select("entity_id", F.coalesce("_to", "survivor").alias("survivor"))
        out = out.checkpoint() if pages.sparkSession.sparkContext.getCheckpointDir() else out.persist()
        # Survivors that are themselves merged; rings leave as many from one round to the next.
        ends = out.select(F.col("entity_id").alias("_e"), F.col("survivor").alias("_s")).where("_e <> _s")
        left = out.join(ends, F.col("survivor") == F.col("_e"), "left_semi").count()
        if left == 0:
            return out
        if left == seen:
            break
        seen = left
    ring = pages.where("merged_into IS NOT NULL").select(F.col("entity_id").alias("a"), F.col("merged_into").alias("b"))
    from lectern.operators.graph import components

    found = components(ring.join(out.join(ends, F.col("survivor") == F.col("_e"), "left_semi").select(F.col("entity_id").alias("a")), "a", "left_semi"))
    return out.join(found, out["entity_id"] == found["node"], "left").select("entity_id", F.coalesce("component", "survivor").alias("survivor"))
