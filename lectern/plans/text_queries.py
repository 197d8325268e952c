"""Queries of texts, names as scalars, surveys and files."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.functions import scalar
from lectern.operators import corpus, search, survey, text
from lectern.operators import pages as page_ops
from lectern.plans.registry import add
from lectern.session import new_folder
from lectern.sources import export, files
from lectern.sources.store import Store

# ---- pages of texts -----------------------------------------------------------------------------
FORMED = "SELECT document_id AS doc_id, concat(text, chr(12), '  ', chr(12), header, chr(12)) AS text FROM contracts"


def _formed(c: DataFrame) -> DataFrame:
    feed = F.lit("\f")
    return c.select(F.col("document_id").alias("doc_id"), F.concat("text", feed, F.lit("  "), feed, "header", feed).alias("text"))


add("split_pages", "contracts", lambda c: text.pages_of(_formed(c)).select("doc_id", "page_no", "char_count"), "SELECT document_id AS doc_id, n::INTEGER AS page_no, CASE n WHEN 1 THEN length(text) WHEN 2 THEN 2 ELSE length(header) END::INTEGER AS char_count FROM contracts, (VALUES (1), (2), (3)) AS v(n)")
add("document_text", "contracts", lambda c: text.document_text(text.pages_of(_formed(c))), "SELECT document_id AS doc_id, concat('--- Page 1 ---', chr(10), text, chr(10), chr(10), '--- Page 2 ---', chr(10), '  ', chr(10), chr(10), '--- Page 3 ---', chr(10), header) AS text FROM contracts")
add("has_text", "documents", lambda d: text.has_text(text.pages_of(d)), "SELECT doc_id, trim(regexp_replace(coalesce(text, ''), '\\s+', ' ', 'g')) <> '' AS has_text FROM documents")
add("page_at_offset", "contracts", lambda c: text.page_at(text.page_offsets(text.pages_of(_formed(c))), c.select(F.col("document_id").alias("doc_id"), F.explode(F.array(F.lit(0), F.length("text"), F.length("text") + 2, F.lit(100_000))).alias("offset"))),
    "SELECT document_id AS doc_id, o::INTEGER AS \"offset\", p::INTEGER AS page_no FROM (SELECT document_id, unnest([0, length(text), length(text) + 2, 100000]) AS o, unnest([1, 2, 3, 3]) AS p FROM contracts)")
WORDS = "SELECT doc_id, regexp_extract_all(lower(strip_accents(text)), '[\\p{L}\\p{N}]+') AS w FROM documents WHERE text IS NOT NULL"
add("search_pages", "documents", lambda d: search.search(d, '"mit license" released', ["doc_id"]).select("doc_id"),
    f"WITH t AS (SELECT doc_id, concat(' ', array_to_string(w, ' '), ' ') AS t FROM ({WORDS})) SELECT doc_id FROM t WHERE regexp_matches(t, ' mit licens(e|es|ed|ing) ') AND regexp_matches(t, ' releas(e|es|ed|ing) ')")
add("search_excerpts", "findings", lambda f: search.search(f, "parts 77", ["instance_id"], "excerpt").select("instance_id", "n"), "SELECT instance_id, 2::BIGINT AS n FROM findings WHERE excerpt = 'part 77'")
# Every form that has the stem in question, told one by one.
LICENSE, EN = "licens(e|es|ed|ing)", "en(e|es|ed|ing|s|ings)?"
RANKED = f"""WITH f AS (SELECT doc_id, len(w) AS d, len([x FOR x IN w IF regexp_full_match(x, '{LICENSE}')]) AS a, len([x FOR x IN w IF regexp_full_match(x, '{EN}')]) AS b,
  len([x FOR x IN w IF starts_with(x, 'releas')]) AS c FROM ({WORDS})),
g AS (SELECT count(*) AS n, sum(d) / count(*)::DOUBLE AS mean, count(*) FILTER (a > 0) AS na, count(*) FILTER (b > 0) AS nb, count(*) FILTER (c > 0) AS nc FROM f)"""


def _part(times: str, having: str) -> str:
    """What a term adds to the score, in SQL."""
    return f"CASE WHEN ln((n - {having} + 0.5) / ({having} + 0.5)) > 0 THEN ln((n - {having} + 0.5) / ({having} + 0.5)) ELSE 0.000001 END * {times} * 2.2 / ({times} + 1.2 * (0.25 + 0.75 * d / mean))"


add("search_ranked", "documents", lambda d: search.search(d, "licensing ENES", ["doc_id"]).select("doc_id", F.round("score", 4).alias("score"), "n"),
    f"{RANKED} SELECT doc_id, round({_part('a', 'na')} + {_part('b', 'nb')}, 4) AS score, (a + b)::BIGINT AS n FROM f, g WHERE a > 0 AND b > 0")
add("search_alternatives", "documents", lambda d: search.search(d, "licensed NOT ening OR releas*", ["doc_id"]).select("doc_id", F.round("score", 4).alias("score"), "n"),
    f"{RANKED} SELECT doc_id, round({_part('a', 'na')} + {_part('c', 'nc')}, 4) AS score, (a + c)::BIGINT AS n FROM f, g WHERE a > 0 AND b = 0 OR c > 0")


def _stored(d):
    """The index of a store, added to in two steps that overlap, and asked for a phrase."""
    store = Store(d.sparkSession, new_folder(d.sparkSession, "search"))
    index = search.Index(store, "pages", ["doc_id"])
    index.add(d.where("doc_id % 2 = 0").withColumn("text", F.concat(F.lit("to be replaced "), F.coalesce("text", F.lit("")))))
    index.add(d)
    return index.search('"mit license"').select("doc_id", "n", "first")


add("search_stored", "documents", _stored)
add("unextracted_mentions", "documents", lambda d: page_ops.unextracted(d.where("text IS NOT NULL"), d.where("doc_id % 2 = 0").select("doc_id", F.lit("MIT License").alias("name")), "MIT  license"), "SELECT doc_id FROM documents WHERE contains(concat(' ', trim(regexp_replace(lower(text), '[^\\p{L}\\p{N}_]+', ' ', 'g')), ' '), ' mit license ') AND doc_id % 2 <> 0")



def _variant(c: DataFrame) -> DataFrame:
    """Quotations of a contract: as it is, in capitals, with wider spaces, with another end, and one that isn't there."""
    part = F.expr("substring(text, 6, 36)")
    forms = F.array(part, F.upper(part), F.replace(part, F.lit(" "), F.lit("   ")), F.concat(part, F.lit(" zebras")), F.lit("nothing of the kind here"))
    return c.select("document_id", "text", F.get(forms, (F.col("document_id") % 5).cast("int")).alias("span"))


add("align_variants", "contracts", lambda c: text.align_quotes(_variant(c)).select("document_id", F.coalesce("start", F.lit(-1)).alias("start"), F.coalesce("end_", F.lit(-1)).alias("end_"), "status"),
    "SELECT document_id, CASE WHEN document_id % 5 = 4 THEN -1 ELSE 5 END::INTEGER AS start, CASE WHEN document_id % 5 = 4 THEN -1 ELSE 41 - (substr(text, 41, 1) = ' ' AND document_id % 5 IN (1, 2))::INTEGER END::INTEGER AS end_, CASE document_id % 5 WHEN 0 THEN 'match_exact' WHEN 1 THEN CASE WHEN substr(text, 41, 1) = ' ' THEN 'match_lesser' ELSE 'match_exact' END WHEN 2 THEN 'match_lesser' WHEN 3 THEN 'match_fuzzy' END AS status FROM contracts")


def _dated(o: DataFrame) -> DataFrame:
    d = F.col("o_orderdate")
    forms = F.array(F.concat(F.lit("It expires on "), F.date_format(d, "d MMMM yyyy"), F.lit(".")), F.concat(F.lit("Signed "), F.date_format(d, "MMM d, yyyy")), F.concat(F.lit("delivery date: "), F.date_format(d, "dd/MM/yyyy")), F.concat(F.lit("on "), F.date_format(d, "yyyy-MM-dd"), F.lit(", the start date")))
    return o.select(F.col("o_orderkey").alias("document_id"), F.get(forms, (F.col("o_orderkey") % 4).cast("int")).alias("text"))


add("date_forms", "orders", lambda o: text.extract(_dated(o), kinds=("date",)).select("document_id", "value", "role", "confidence"),
    "SELECT o_orderkey AS document_id, o_orderdate::DATE::VARCHAR AS value, ['end', 'signature', 'milestone', 'start'][o_orderkey % 4 + 1] AS role, CASE WHEN o_orderkey % 4 = 2 AND day(o_orderdate) <= 12 THEN 0.5 ELSE 1.0 END::DOUBLE AS confidence FROM orders")


def _priced(o: DataFrame) -> DataFrame:
    n = F.format_number(F.round("o_totalprice").cast("bigint"), 0)
    forms = F.array(F.concat(F.lit("total price €"), n), F.concat(F.lit("capped at USD "), n), F.concat(F.lit("a penalty of "), n, F.lit(" GBP")), F.concat(n, F.lit(" dollars per day")))
    return o.select(F.col("o_orderkey").alias("document_id"), F.get(forms, (F.col("o_orderkey") % 4).cast("int")).alias("text"))


add("amount_forms", "orders", lambda o: text.extract(_priced(o), kinds=("amount",)).select("document_id", "value", "currency", "role", "confidence"),
    "SELECT o_orderkey AS document_id, round(o_totalprice)::BIGINT::VARCHAR AS value, ['EUR', 'USD', 'GBP', 'USD'][o_orderkey % 4 + 1] AS currency, ['contract_value', 'cap', 'penalty', 'rate'][o_orderkey % 4 + 1] AS role, CASE WHEN o_orderkey % 4 = 3 THEN 0.9 ELSE 1.0 END::DOUBLE AS confidence FROM orders")

# ---- scalars ------------------------------------------------------------------------------------
add("alignment_confidence", "findings", lambda f: f.select("instance_id", scalar.aligned_confidence(F.col("alignment")).alias("level")), "SELECT instance_id, CASE alignment WHEN 'match_exact' THEN 1e0 WHEN 'match_fuzzy' THEN 0.5e0 ELSE 0.2e0 END AS level FROM findings")
add("vocabulary_values", "part", lambda p: p.select("p_partkey", scalar.in_vocabulary(F.concat(F.lit(" "), F.lower("p_type")), ["Economy", "Small"]).alias("kind")), "SELECT p_partkey, CASE lower(p_type) WHEN 'economy' THEN 'Economy' WHEN 'small' THEN 'Small' END AS kind FROM part")
add("proposed_identifiers", "part", lambda p: p.select("p_partkey", scalar.identifier(F.concat(F.col("p_name"), F.lit(" / "), F.col("p_brand"))).alias("property_id"), scalar.identifier(F.col("p_name"), "type").alias("type_id")),
    "SELECT p_partkey, concat(replace(p_name, ' ', '_'), '_', lower(replace(p_brand, '#', '_'))) AS property_id, array_to_string([concat(upper(left(w, 1)), substr(w, 2)) FOR w IN string_split(p_name, ' ')], '') AS type_id FROM part")
add("instance_labels", "findings", lambda f: f.select("instance_id", scalar.instance_label({"title": F.when(F.col("quantity") > 40, F.lit(" ")), "value": F.when(F.col("quantity") > 20, F.col("quantity")), "text": F.col("excerpt")}, F.col("type_id")).alias("label")), "SELECT instance_id, CASE WHEN quantity > 20 THEN quantity::VARCHAR WHEN excerpt <> '' THEN excerpt ELSE type_id END AS label FROM findings")
add("finding_fingerprints", "findings", lambda f: f.groupBy(scalar.fingerprint(F.col("type_id"), F.col("excerpt"), F.col("alignment")).alias("fp")).agg(F.count(F.lit(1)).alias("n")).groupBy("n").agg(F.count(F.lit(1)).alias("n_groups")), ", g AS (SELECT count(*) AS n FROM findings GROUP BY type_id, excerpt, alignment) SELECT n, count(*) AS n_groups FROM g GROUP BY 1")
add("excerpts_around", "contracts", lambda c: c.select("document_id", scalar.excerpt_around(F.col("text"), F.lit(28), F.lit("x"), 10).alias("around")), "SELECT document_id, trim(substr(text, 19, 21)) AS around FROM contracts")
add("file_kinds", "part", lambda p: p.select("p_partkey", _file(p).alias("name")).select("p_partkey", files.kind_of_file(F.col("name")).alias("kind"), files.mime_of(files.kind_of_file(F.col("name")), F.col("name")).alias("mime")),
    """WITH f AS (SELECT p_partkey, ['PDF', 'docx', 'doc', 'Md', 'jpeg', 'rtf'][p_partkey % 6 + 1] AS e FROM part) SELECT p_partkey, CASE e WHEN 'PDF' THEN 'pdf' WHEN 'docx' THEN 'docx' WHEN 'doc' THEN 'unsupported_doc' WHEN 'Md' THEN 'text' WHEN 'jpeg' THEN 'image' ELSE 'unknown' END AS kind,
 CASE e WHEN 'PDF' THEN 'application/pdf' WHEN 'docx' THEN 'application/vnd.openxmlformats-officedocument.wordprocessingml.document' WHEN 'Md' THEN 'text/plain' WHEN 'jpeg' THEN 'image/jpeg' ELSE 'application/octet-stream' END AS mime FROM f""")


def _file(p: DataFrame):
    endings = F.array(*map(F.lit, ["PDF", "docx", "doc", "Md", "jpeg", "rtf"]))
    return F.concat(F.lit("a.b"), F.col("p_partkey"), F.lit("."), F.get(endings, (F.col("p_partkey") % 6).cast("int")))


# ---- surveys ------------------------------------------------------------------------------------
add("survey_headers", "contracts", lambda c: survey.header_survey(c, "header").select("property_id", "support", "data_type", "accepted"), "SELECT k AS property_id, count(*) AS support, any_value(t) AS data_type, count(*) >= 2 AS accepted FROM contracts, (VALUES ('order', 'integer'), ('priority', 'string')) AS v(k, t) GROUP BY 1")
add("survey_sample", "orders", lambda o: survey.sampled(o.select(F.col("o_orderkey").alias("document_id"), F.col("o_orderdate").alias("added")), 25).select("document_id"), "SELECT o_orderkey AS document_id FROM orders ORDER BY o_orderdate, o_orderkey LIMIT 25")
add("survey_support", "contracts", lambda c: survey.corroborated(c.select(F.lit("Contract").alias("type_id"), F.when(F.col("amount") > 200_000, "value").otherwise("start").alias("property_id"), "document_id", F.when(F.col("amount") % 2 == 0, F.expr("substring(text, 6, 40)")).otherwise("made up words entirely").alias("quote")), c),
    "SELECT 'Contract' AS type_id, CASE WHEN amount > 200000 THEN 'value' ELSE 'start' END AS property_id, count(*) AS support FROM contracts WHERE amount % 2 = 0 GROUP BY 1, 2 UNION ALL SELECT 'Contract', NULL, count(*) FROM contracts WHERE amount % 2 = 0")
add("survey_candidates", "part", lambda p: survey.candidates(survey.upserted(_known(p), p.where("p_size > 20").groupBy(F.lit("property").alias("kind"), F.col("p_type").alias("type_id"), F.col("p_brand").alias("property_id")).agg(F.count(F.lit(1)).alias("n_documents")), "s2"), "proposed").select("candidate_id", "n_documents", "n_total"),
    """WITH a AS (SELECT p_type, p_brand, count(*) FILTER (p_size > 20) AS n, count(*) FILTER (p_size <= 20) AS b FROM part GROUP BY 1, 2), c AS (SELECT concat_ws(':', 'property', p_type, p_brand) AS candidate_id, CASE WHEN n > 0 THEN n ELSE b END AS n_documents, CASE WHEN b > 0 AND p_brand = 'Brand#1' THEN 'accepted' ELSE 'proposed' END AS s, p_type, p_brand FROM a)
 SELECT candidate_id, n_documents, (SELECT count(*) FROM c WHERE s = 'proposed') AS n_total FROM c WHERE s = 'proposed' ORDER BY n_documents DESC, p_type, p_brand LIMIT 25""")


def _known(p: DataFrame) -> DataFrame:
    own = p.where("p_size <= 20").groupBy(F.lit("property").alias("kind"), F.col("p_type").alias("type_id"), F.col("p_brand").alias("property_id")).agg(F.count(F.lit(1)).alias("n_documents"))
    return own.select(F.concat_ws(":", "kind", "type_id", "property_id").alias("candidate_id"), "kind", "type_id", "property_id", "n_documents", F.when(F.col("property_id") == "Brand#1", "accepted").otherwise("proposed").alias("status"), F.lit("s1").alias("survey_id"))


# ---- files --------------------------------------------------------------------------------------
add("register_table", "supplier", lambda s: files.register_rows(s.select(F.col("s_name").alias("Company Name"), F.col("s_suppkey").alias("Reg No"), "s_nationkey").orderBy("s_suppkey"), "r1", after=5)[0].select("row_no", "name", "identifier", "status"), "SELECT (row_number() OVER (ORDER BY s_suppkey) + 5)::INTEGER AS row_no, s_name AS name, s_suppkey::VARCHAR AS identifier, 'staged' AS status FROM supplier")
add("entity_markdown", "entities claims", lambda e, c: export.entity_markdown(e.select("entity_id", "type_id", "canonical_name", F.lit("confirmed").alias("status")), c.where("value <> ''").select("entity_id", "property_id", "value", "document_id", "excerpt", F.when(F.col("reviewed"), "confirmed").otherwise("unconfirmed").alias("status"))).select("entity_id", "file_name", (F.size(F.split("body", "\n- "))-1).cast("long").alias("n_lines")),
    """, n AS (SELECT entity_id, count(DISTINCT (property_id, value, document_id, excerpt, reviewed)) AS k FROM claims WHERE value <> '' GROUP BY 1), g AS (SELECT e.entity_id, trim(regexp_replace(lower(canonical_name), '[^a-z0-9]+', '-', 'g'), '-') AS s, k FROM entities e JOIN n ON n.entity_id = e.entity_id)
 SELECT entity_id, concat('entities/', CASE WHEN (SELECT count(*) FROM g h WHERE h.s = g.s) > 1 THEN concat(s, '-', entity_id) ELSE s END, '.md') AS file_name, k AS n_lines FROM g""")
add("new_originals", "documents", lambda d: files.ingested(d.select(F.concat(F.lit("f/"), F.lpad(F.col("doc_id").cast("string"), 9, "0"), F.lit(".txt")).alias("path"), F.lit("x.txt").alias("filename"), F.lit("text").alias("kind"), F.lit("text/plain").alias("mime"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("file_hash"), F.lit(1).cast("long").alias("byte_size"))).select("file_hash", "path", "n_copies", "storage_path"),
    "SELECT sha256(coalesce(text, '')) AS file_hash, concat('f/', lpad(min(doc_id)::VARCHAR, 9, '0'), '.txt') AS path, count(*) AS n_copies, concat('documents/', left(sha256(coalesce(text, '')), 2), '/', sha256(coalesce(text, '')), '.txt') AS storage_path FROM documents GROUP BY 1")
add("redacted_documents", "findings", lambda f: corpus.redact(f, f.where("quantity = 50").select("document_id").distinct()).groupBy("type_id").agg(F.count(F.lit(1)).alias("n")), "SELECT type_id, count(*) AS n FROM findings WHERE document_id NOT IN (SELECT document_id FROM findings WHERE quantity = 50) GROUP BY 1")
