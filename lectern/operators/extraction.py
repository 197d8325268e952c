"""From what an engine or a pattern finds in a text to instances, provenance and edges."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.functions.scalar import aligned_confidence, in_vocabulary, name_key, snap_confidence
from lectern.operators.text import align, extract, page_at, page_offsets

#: The source that a tier's findings carry.
SOURCES = {"deterministic": "deterministic", "local": "ai_local", "cloud": "ai_cloud"}


def instances(proposed: DataFrame, declared: dict[str, list[str]], named: dict[str, str] | None = None) -> DataFrame:
    """proposed (instance_id, document_id, type_id, properties map<string,array<string>>, confidence, source) as instance rows.

    Declared properties are kept, lists joined by "; ", confidence is snapped to its level, and
    types that are named (type -> style) get the key of their name.
    """
    known = F.create_map(*[x for t, ps in declared.items() for x in (F.lit(t), F.array(*map(F.lit, ps)))])
    wanted = F.element_at(known, F.col("type_id"))
    kept = F.map_filter("properties", lambda k, v: F.array_contains(wanted, k))
    held = F.transform_values(kept, lambda k, v: F.array_join(v, "; "))
    name = F.element_at(held, F.lit("name"))
    key = F.lit(None).cast("string")
    for type_id, style in (named or {}).items():
        key = F.when(F.col("type_id") == type_id, name_key(name, style)).otherwise(key)
    fine = proposed.where(wanted.isNotNull())
    return fine.select("instance_id", "document_id", "type_id", held.alias("properties"), key.alias("name_key"), snap_confidence(F.col("confidence")).alias("confidence"), "source", F.lit("unconfirmed").alias("status"))


def undeclared(proposed: DataFrame, declared: dict[str, list[str]]) -> DataFrame:
    """(type_id, property_id, occurrences, observed_value) of what no type declares; property_id is null for a type that is unknown."""
    known = F.create_map(*[x for t, ps in declared.items() for x in (F.lit(t), F.array(*map(F.lit, ps)))])
    wanted = F.element_at(known, F.col("type_id"))
    each = proposed.select("type_id", wanted.alias("wanted"), F.explode("properties").alias("property_id", "v"))
    stray = each.where("wanted IS NULL OR NOT array_contains(wanted, property_id)")
    return stray.select("type_id", F.when(F.col("wanted").isNotNull(), F.col("property_id")).alias("property_id"), F.array_join("v", "; ").alias("value")).groupBy("type_id", "property_id").agg(F.count(F.lit(1)).alias("occurrences"), F.min("value").alias("observed_value"))


def edges(relations: DataFrame, ids: DataFrame, link_types: list[str]) -> tuple[DataFrame, DataFrame]:
    """relations (document_id, from_local, to_local, link_type_id) over ids (document_id, local_id, instance_id): edges with both ends kept, and link types that are not declared."""
    end = lambda side: ids.select("document_id", F.col("local_id").alias(f"{side}_local"), F.col("instance_id").alias(f"{side}_instance_id"))
    both = relations.join(end("from"), ["document_id", "from_local"]).join(end("to"), ["document_id", "to_local"])
    known = F.col("link_type_id").isin(link_types)
    strays = both.where(~known).groupBy("link_type_id").agg(F.count(F.lit(1)).alias("occurrences"))
    return both.where(known).select("document_id", "from_instance_id", "to_instance_id", "link_type_id"), strays


def with_container(rows: DataFrame, primaries: DataFrame, container: str) -> DataFrame:
    """rows with an empty container filled by their document's primary instance of the highest confidence, then the largest id."""
    best = primaries.where("status <> 'rejected'").groupBy("document_id").agg(F.max_by("instance_id", F.struct("confidence", "instance_id")).alias("_best"))
    held = F.coalesce(F.nullif(F.col(container), F.lit("")), F.col("_best"))
    return rows.join(best, "document_id", "left").withColumn(container, held).drop("_best")


def deterministic_pass(pages: DataFrame, existing: DataFrame) -> DataFrame:
    """Dates and amounts of pages (doc_id, page_no, text, char_count) that no live finding (doc_id, page_no, raw) has yet, with their places in the document."""
    told = "start" in pages.columns  # then pages know where they begin, and don't have to meet their offsets
    found = extract(pages.where("text IS NOT NULL"), ["doc_id", "page_no", "start"] if told else ["doc_id", "page_no"])
    new = found.join(existing.select("doc_id", "page_no", "raw"), ["doc_id", "page_no", "raw"], "left_anti")
    placed = new if told else new.join(page_offsets(pages).select("doc_id", "page_no", "start"), ["doc_id", "page_no"])
    begin = (F.col("start") + F.col("position")).cast("long")
    return placed.select("doc_id", "page_no", "kind", "raw", "value", "currency", "role", "confidence", begin.alias("char_start"), (begin + F.length("raw")).alias("char_end"), F.lit("match_exact").alias("alignment"), F.lit("deterministic").alias("source"))


def superseded(rows: DataFrame, source: str) -> DataFrame:
    """(row_id, document_id): unreviewed rows of a source, which a new run of it replaces."""
    return rows.where((F.col("source") == source) & (F.col("status") == "unconfirmed")).select(F.col("instance_id").alias("row_id"), "document_id")


def pending(documents: DataFrame, runs: DataFrame, tier: str, force: bool = False) -> DataFrame:
    """Documents that a tier has not been run on with success."""
    return documents if force else documents.join(runs.where((F.col("tier") == tier) & (F.col("status") == "complete")).select("document_id"), "document_id", "left_anti")


# ---- engines ------------------------------------------------------------------------------

#: An engine makes findings (dicts of type_id, properties, quote, confidence) of a text.
Engine = Callable[[str], list[dict]]
_ENGINES: dict[str, Engine] = {}


def register_engine(name: str, engine: Engine) -> None:
    _ENGINES[name] = engine


def engine_names() -> list[str]:
    return sorted(_ENGINES)


def resolve_engine(requested: str | None = None) -> Engine:
    """The engine of a name, or the only one there is."""
    if requested is None and len(_ENGINES) == 1:
        return next(iter(_ENGINES.values()))
    if requested not in _ENGINES:
        raise KeyError(f"no engine {requested}; there are {', '.join(engine_names()) or 'none'}")
    return _ENGINES[requested]


def populate(documents: DataFrame, engine: Engine) -> DataFrame:
    """What an engine finds in documents (document_id, text), with where each quotation stands; one row with the error where it fails.

    How sure a finding is follows from its quotation: what the engine says of itself counts only as far as the quotation was found.
    """
    names = ["local_id", "type_id", "properties", "quote", "said", "char_start", "char_end", "alignment", "error"]
    kinds = [pa.string(), pa.string(), pa.map_(pa.string(), pa.list_(pa.string())), pa.string(), pa.float64(), pa.int32(), pa.int32(), pa.string(), pa.string()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for row, text in enumerate(batch.column(1).to_pylist()):
                try:
                    for i, f in enumerate(engine(text or "")):
                        start, end, status = align(text or "", f.get("quote") or "", f.get("position"))
                        held = [(k, [str(x) for x in (v if isinstance(v, list) else [v])]) for k, v in (f.get("properties") or f.get("fields") or f.get("attributes") or {}).items() if v is not None]
                        rows.append((row, str(f.get("id", i)), f.get("type_id") or f.get("type"), held, f.get("quote"), f.get("confidence"), start, end, status, None))
                except Exception as e:  # noqa: BLE001  a failing engine leaves the run partial, not the job broken
                    rows.append((row, None, None, None, None, None, None, None, None, f"{type(e).__name__}: {e}"))
            of, *columns = zip(*rows, strict=True) if rows else [[]] * 10
            arrays = [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(of, pa.int32())), *arrays], ["document_id", *names])

    kind = dict(documents.dtypes)["document_id"]
    schema = f"document_id {kind}, local_id string, type_id string, properties map<string,array<string>>, quote string, said double, char_start int, char_end int, alignment string, error string"
    found = documents.select("document_id", "text").mapInArrow(run, schema)
    return found.withColumn("confidence", F.when(F.col("error").isNull(), F.least(F.coalesce("said", F.lit(1.0)), aligned_confidence(F.col("alignment"))))).drop("said")


def provenance(found: DataFrame, offsets: DataFrame, source: str) -> DataFrame:
    """(doc_id, local_id, page_no, excerpt, alignment, ...) of found (doc_id, local_id, quote, char_start, char_end, alignment, confidence): the page follows from the place, whatever the engine said."""
    at = page_at(offsets, found.where("char_start IS NOT NULL").select("doc_id", F.col("char_start").alias("offset")).distinct())
    held = found.join(at.withColumnRenamed("offset", "char_start").hint("merge"), ["doc_id", "char_start"], "left")
    return held.select("doc_id", "local_id", "page_no", F.coalesce("quote", F.lit("")).alias("excerpt"), "alignment", "char_start", "char_end", "confidence", F.lit(source).alias("source"))


# ---- classification and facts -------------------------------------------------------------


def classify(documents: DataFrame, cues: dict[str, list[str]], allowed: list[str], most: int = 12_000) -> DataFrame:
    """(document_id, proposed, document_type): the type whose cues stand most often in the first characters, in closed vocabulary; none is other."""
    text = F.lower(F.substring(F.coalesce("text", F.lit("")), 1, most))
    scored = F.array(*[F.struct(sum((F.size(F.split(text, F.lit(f"\\Q{c.lower()}\\E"))) - 1 for c in words), F.lit(0)).alias("n"), F.lit(-i).alias("order"), F.lit(name).alias("name")) for i, (name, words) in enumerate(cues.items())])
    best = F.array_max(scored)
    told = documents.select("document_id", F.when(best["n"] > 0, best["name"]).alias("proposed"))
    return told.select("document_id", "proposed", F.coalesce(in_vocabulary(F.col("proposed"), allowed), F.lit("other")).alias("document_type"))


def facts(stated: DataFrame, documents: DataFrame) -> tuple[DataFrame, DataFrame]:
    """stated (fact_id, document_id, quote) by people: those whose quotation stands in the document, confirmed, and those that are refused."""
    from lectern.operators.text import align_quotes

    held = stated.join(documents.select("document_id", "text"), "document_id").select(F.struct("document_id", "fact_id").alias("document_id"), "text", F.col("quote").alias("span"))
    found = align_quotes(held).select("document_id.document_id", "document_id.fact_id", "start", "end_", F.col("status").alias("alignment"))
    fine = found.where("alignment IS NOT NULL AND alignment <> 'match_fuzzy'")
    return fine.select("*", F.lit("confirmed").alias("status"), F.lit("human").alias("source"), F.lit(1.0).alias("confidence")), stated.join(fine.select("fact_id"), "fact_id", "left_anti")
