"""Scalar functions over names, confidences and small texts, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The confidence rubric.
RUBRIC = [("explicit", 1.0), ("named", 0.9), ("implied", 0.7), ("inferred", 0.5), ("speculative", 0.2)]
#: The legal forms that a name's key leaves out at its end, and the titles at its beginning.
LEGAL_FORMS = """limited ltd plc llp llc lp inc incorporated corporation corp company co sa nv bv ag gmbh oy ab as aps pty dac cic ug kg srl spa
teoranta teo cpt ct""".split()
HONORIFICS = "mr mrs ms miss mx dr prof professor sir dame lord lady rev reverend fr hon capt col maj sgt lt gen".split()
#: The level of a quotation by how it was found.
ALIGNED = {"match_exact": 1.0, "match_greater": 0.9, "match_lesser": 0.9, "match_fuzzy": 0.5}


def name_key(name: Column, style: str = "organisation") -> Column:
    """Lower case without punctuation, a leading "the", and trailing legal forms or leading honorifics that other words stand beside; never empty if the name is not."""
    plain = F.btrim(F.regexp_replace(F.regexp_replace(F.lower(name), r"(?U)[^\w\s]", " "), r"(?U)\s+", " "))
    base = F.regexp_replace(plain, "^the ", "")
    pattern = rf"^(?:(?:{'|'.join(HONORIFICS)}) )+" if style == "personal" else rf"(?: (?:{'|'.join(LEGAL_FORMS)}))+$"
    short = F.btrim(F.regexp_replace(base, pattern, ""))
    return F.coalesce(F.nullif(short, F.lit("")), base)


def aligned_confidence(alignment: Column) -> Column:
    """The level of a quotation's alignment; the lowest if it was not found."""
    return F.coalesce(F.element_at(F.create_map(*[F.lit(x) for pair in ALIGNED.items() for x in pair]), alignment), F.lit(0.2))


def in_vocabulary(value: Column, allowed: list[str]) -> Column:
    """The allowed word that a value is, whatever its case; null if none."""
    out = F.lit(None).cast("string")
    for word in reversed(allowed):
        out = F.when(F.lower(F.btrim(value)) == word.lower(), F.lit(word)).otherwise(out)
    return out


def identifier(raw: Column, style: str = "property") -> Column:
    """A model's proposal as an identifier: words in lower case with underscores; in capitals run together for a type."""
    words = F.split(F.btrim(F.regexp_replace(F.btrim(raw), "[^A-Za-z0-9]+", " ")), " ")
    if style == "type":
        joined = F.array_join(F.transform(words, lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.substr(w, F.lit(2)))), "")
    else:
        joined = F.lower(F.array_join(words, "_"))
    return F.nullif(F.when(joined.rlike("^[0-9]"), F.concat(F.lit("x_"), joined)).otherwise(joined), F.lit(""))


def instance_label(row: dict[str, Column], type_id: Column) -> Column:
    """The first of name, title, value, summary, date_value and text that isn't blank, else the type."""
    known = [F.nullif(F.btrim(row[c].cast("string")), F.lit("")) for c in ("name", "title", "value", "summary", "date_value", "text") if c in row]
    return F.coalesce(*known, type_id)


def fingerprint(*values: Column) -> Column:
    """32 hexadecimal digits that are equal for equal values: of their JSON, maps by sorted keys."""
    return F.substring(F.sha2(F.to_json(F.struct(*[v.alias(f"v{i}") for i, v in enumerate(values)]), {"ignoreNullFields": "false"}), 256), 1, 32)


def snap_confidence(score: Column) -> Column:
    """The highest level that a score reaches; the lowest level under all, 0.5 for what is no number."""
    out = F.when(score.isNull() | F.isnan(score), F.lit(0.5))
    for _, level in RUBRIC[:-1]:
        out = out.when(score >= level - 1e-9, F.lit(level))
    return out.otherwise(F.lit(RUBRIC[-1][1]))


def confidence_label(level: Column) -> Column:
    out = F.when(level.isNull(), F.lit(None))
    for name, value in RUBRIC:
        out = out.when(level == value, F.lit(name))
    return out


def other_reading(raw: Column) -> Column:
    """The month-first reading of a day-first date d/m/yyyy where both readings exist and differ; else null."""
    d, m, y = (F.regexp_extract(raw, r"^\s*(\d{1,2})[/.](\d{1,2})[/.](\d{4})\s*$", i) for i in (1, 2, 3))
    day, month = d.try_cast("int"), m.try_cast("int")
    two = (day <= 12) & (month <= 12) & (day >= 1) & (month >= 1) & (day != month)
    return F.when(two, F.concat_ws("-", y, F.lpad(d, 2, "0"), F.lpad(m, 2, "0")))


def property_id(key: Column) -> Column:
    slug = F.regexp_replace(F.regexp_replace(F.lower(key), "[^a-z0-9]+", "_"), "^_+|_+$", "")
    return F.when(slug == "", "field").otherwise(slug)


def words_only(text: Column) -> Column:
    """Lower case with runs of other characters than word characters as one space."""
    return F.btrim(F.regexp_replace(F.lower(text), r"(?U)\W+", " "))


def excerpt_around(text: Column, position: Column, needle: Column, window: int = 120) -> Column:
    begin = F.greatest(position - window, F.lit(0))
    found = F.btrim(F.substr(text, begin + 1, position + F.length(needle) + window - begin))
    return F.when(position.isNull(), needle).otherwise(found)


def data_type(value: Column) -> Column:
    """An aggregate: the narrowest type that every value that isn't blank has; numbers of at most 12 digits before the point."""
    full = F.btrim(value) != ""
    fits = lambda pattern: F.coalesce(F.bool_and(F.when(full, F.btrim(value).rlike(pattern))), F.lit(False))
    return F.when(fits(r"^-?\d{1,12}$"), "integer").when(fits(r"^-?\d{1,12}(\.\d+)?$"), "number").when(fits(r"^\d{4}-\d{2}-\d{2}$|^\d{1,2}[-/][A-Za-z]{3}[-/]\d{2,4}$"), "date").otherwise("string")
