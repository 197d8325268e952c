"""Operator 6: line dedup by overlapping three-line windows.

Every three consecutive lines of a document are hashed (two 64-bit hashes). A window that
occurs more than once anywhere keeps its first occurrence, by (doc_id, text's hash, line); the
lines that later occurrences cover are merged and removed. The first place of any line is
never in a later occurrence, so no line is lost altogether. Windows without a single word are left out.

Defined results: null and empty texts, and texts of fewer than three lines, stay as they
are; so do rows whose doc_id is null. Rows that repeat a doc_id with other texts are documents of
their own, in the order of the texts' hashes; rows that repeat both are one and do not remove
each other. An empty table gives no rows. Only ``doc_id`` and ``text`` are looked at
(``clean`` sets ``n_chars`` too); other columns may have any names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.llm.common import boxed, materialise, salted_join, small, unboxed
from lectern.llm.quality_rules import let


def signature() -> Column:
    """Tells texts of one doc_id apart: 60 bits of the text's MD5."""
    return F.conv(F.substring(F.md5("text"), 1, 15), 16, 10).cast("long")


def windows(docs: DataFrame) -> DataFrame:
    """(doc_id, sig, pos, a, b): the two hashes of lines pos, pos + 1 and pos + 2."""
    lines = docs.where("doc_id IS NOT NULL AND text IS NOT NULL").select("doc_id", signature().alias("sig"), F.split("text", "\n").alias("lines")).where("size(lines) >= 3")
    each = lines.select("doc_id", "sig", F.posexplode(F.expr("transform(sequence(0, size(lines) - 3), i -> slice(lines, i + 1, 3))")).alias("pos", "w"))
    each = each.where(F.concat(*[F.get("w", F.lit(i)) for i in range(3)]).rlike("[^ \\t-\\r]"))
    return each.select("doc_id", "sig", "pos", F.xxhash64("w").alias("a"), F.xxhash64(F.lit("second"), "w").alias("b"))


def covered(docs: DataFrame) -> DataFrame:
    """(doc_id, sig, begin, end): the runs of lines that later occurrences cover, ends exclusive, for the documents that have any."""
    all_windows, at = windows(docs), F.struct("doc_id", "sig", "pos")
    first = all_windows.groupBy("a", "b").agg(F.min(at).alias("first"), F.max(at).alias("last"), F.count(F.lit(1)).alias("n"))
    repeated = materialise(first.where("first != last").select("a", "b", "first", "n"), "line-windows")
    total = repeated.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    later = salted_join(all_windows, repeated, ["a", "b"], "n", total).where(at != F.col("first"))
    places = later.groupBy("doc_id", "sig").agg(F.sort_array(F.collect_set("pos")).alias("at"))
    # A window begins a run if the one before it doesn't reach it, and ends one if it doesn't reach the next.
    begin = F.filter("at", lambda p, i: (i == 0) | (p > F.get("at", i - 1) + 3))
    end = F.filter("at", lambda p, i: (i == F.size("at") - 1) | (F.get("at", i + 1) > p + 3))
    return places.select("doc_id", "sig", begin.alias("begin"), F.transform(end, lambda p: p + 3).alias("end"))


def apply(docs: DataFrame) -> DataFrame:
    """(row, lines, removed, left): rows whole, how many lines they have and lose, and the text that is left."""
    found = materialise(covered(docs).select(F.col("doc_id").alias("gone_from"), F.col("sig").alias("gone_sig"), "begin", "end"), "line-dedup")
    rows = boxed(docs, doc_id=F.col("doc_id"), text=F.col("text"), sig=signature())
    joined = rows.join(small(found, 40 + 8 * F.size("begin")), (F.col("doc_id") == F.col("gone_from")) & (F.col("sig") == F.col("gone_sig")), "left")

    def rest(lines):
        piece = lambda b, i: F.slice(lines, F.coalesce(F.get("end", i - 1), F.lit(0)) + 1, b - F.coalesce(F.get("end", i - 1), F.lit(0)))
        return F.flatten(F.transform(F.concat("begin", F.array(F.size(lines))), piece))

    lines = F.split("text", "\n")
    out = joined.withColumn("left", F.when(F.col("begin").isNull(), F.lit(None)).otherwise(let(lines, rest)))
    removed = F.when(F.col("begin").isNull(), 0).otherwise(F.aggregate(F.arrays_zip("begin", "end"), F.lit(0), lambda n, r: n + r["end"] - r["begin"]))
    count = F.when(F.col("text").isNull(), 0).otherwise(F.size(lines))
    return out.select("row", count.cast("long").alias("lines"), removed.cast("long").alias("removed"), F.coalesce(F.array_join("left", "\n"), "text").alias("left"))


def report(docs: DataFrame) -> DataFrame:
    """One row per row of docs: lines, removed lines, and the SHA-256 of the text that is left."""
    out = apply(docs.select("doc_id", "text"))
    return out.select("row.doc_id", F.col("lines").alias("n_lines"), F.col("removed").alias("n_removed"), F.sha2(F.coalesce("left", F.lit("")), 256).alias("kept_sha256"))


def clean(docs: DataFrame) -> DataFrame:
    """docs with the lines removed and n_chars set anew; documents that lose every line go."""
    out = apply(docs).where("removed = 0 OR removed < lines")
    kinds = dict(docs.dtypes)
    new = F.col("row").withField("text", F.col("left").cast(kinds["text"]))
    if "n_chars" in kinds:
        new = new.withField("n_chars", F.when(F.col("removed") == 0, F.col("row.n_chars")).otherwise(F.length("left")).cast(kinds["n_chars"]))
    return unboxed(out.select(new.alias("row")))


ORACLE = """
WITH l AS (SELECT doc_id, text, CAST('0x' || md5(text)[1:15] AS BIGINT) AS sig, string_split(text, chr(10)) AS lines FROM documents),
w AS (SELECT doc_id, sig, i AS pos, lines[i + 1] || chr(10) || lines[i + 2] || chr(10) || lines[i + 3] AS w
      FROM l, unnest(range(0, len(lines) - 2)) AS t(i) WHERE len(lines) >= 3),
f AS (SELECT w, min((doc_id, sig, pos)) AS first FROM w WHERE regexp_matches(w, '[^ \\t-\\r]') GROUP BY w HAVING min((doc_id, sig, pos)) <> max((doc_id, sig, pos))),
gone AS (SELECT DISTINCT doc_id, sig, pos + k AS pos FROM w JOIN f USING (w), unnest([0, 1, 2]) AS t(k) WHERE (doc_id, sig, pos) <> f.first),
g AS (SELECT doc_id, sig, list(pos) AS gone FROM gone GROUP BY doc_id, sig)
SELECT l.doc_id, CASE WHEN text IS NULL THEN 0 ELSE len(lines) END::BIGINT AS n_lines, coalesce(len(gone), 0)::BIGINT AS n_removed,
       sha256(CASE WHEN gone IS NULL THEN coalesce(text, '') ELSE array_to_string([lines[i + 1] FOR i IN range(0, len(lines)) IF NOT list_contains(gone, i)], chr(10)) END) AS kept_sha256
FROM l LEFT JOIN g USING (doc_id, sig)
"""
