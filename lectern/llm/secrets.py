"""Operator 1: secret scans with character Markov models. DataFrame functions only.

Base patterns find assignments, access keys and hexadecimal strings. The method adds other
strings: two character bigram models, one of random strings and one of ordinary identifiers,
are trained by counting in Spark over labelled samples; a candidate of ``CANDIDATE`` that does
not touch a base span is a secret if its log-likelihood ratio per character is over ``RATIO``
and, unless it has ``LONG`` characters with digits and letters among them, its sum is over
``EVIDENCE``: short strings, and letters or digits alone, need more to each character.

Places are in code points, end exclusive; an assignment's span is the whole match. Positions
come from splitting a text by the pattern: lengths of what is between matches and of the
matches themselves, summed in blocks.

Defined results: null and empty texts have no spans and the hash of the empty string. Rows
are scanned one by one, repeated ones too, whatever their doc_id. An empty table gives no
rows. Only ``doc_id`` and ``text`` are looked at.
"""

from __future__ import annotations

import json
import math
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.llm.quality_rules import let

ASSIGN = "(?i:password|passwd|secret|token|api_?key)[\"']?\\x20*[:=]\\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
#: These two only match where the plain pattern's match is long enough, and then the same text.
ACCESS = "AKIA[A-Z0-9]{16,}"
HEX = "[0-9a-f]{24,}"
CANDIDATE = "[A-Za-z0-9+/_-]{12,}"
RATIO, EVIDENCE, LONG = 0.4, 28.5, 20
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_-"
#: Parts that the labelled identifiers are made of.
PARTS = """get set is has to from user name id list map file path read write open close data value key index count size
time date start end begin next prev first last node tree root leaf item order line page text word char string number int
float double bool array vector matrix table row column field record type class object method function call return error
code status state event message request response client server session token cache buffer queue stack thread process
task job batch load store save delete update insert select filter sort group merge split join parse format encode decode
config option default max min total average source target input output log debug test check valid version update view""".split()


def samples(spark: SparkSession, rows: int = 4000) -> DataFrame:
    """(text, random): strings labelled by how they were made, half of them random."""
    parts = F.array(*map(F.lit, PARTS))
    part = lambda k: F.element_at(parts, (F.pmod(F.xxhash64("id", F.lit(k)), F.lit(len(PARTS))) + 1).cast("int"))
    digest = F.sha2(F.concat(F.lit("sample"), F.col("id").cast("string")), 256)
    base64 = F.regexp_replace(F.base64(F.unhex(digest)), "=", "")
    coded = F.when(F.col("id") % 4 == 0, digest).when(F.col("id") % 4 == 1, F.upper(F.regexp_replace(base64, "[^A-Za-z0-9]", ""))).otherwise(base64)
    words = [part(k) for k in range(5)]
    version = F.when(F.pmod(F.xxhash64("id"), F.lit(3)) == 0, F.concat(F.lit("_"), (F.col("id") % 100).cast("string"))).otherwise(F.lit(""))
    camel = F.concat(words[0], *[F.initcap(w) for w in words[1:]])
    forms = [F.concat_ws("_", *words), camel, F.concat_ws("-", *words), F.concat_ws("/", *words), F.upper(F.concat_ws("_", *words))]
    name = F.element_at(F.array(*forms), (F.col("id") % len(forms) + 1).cast("int"))
    ids = spark.range(rows)
    return ids.select(coded.alias("text"), F.lit(True).alias("random")).union(ids.select(F.concat(name, version).alias("text"), F.lit(False).alias("random")))


def train(labelled: DataFrame) -> list[float]:
    """Log-likelihood ratios of each character after each other, random against ordinary; add-half smoothing."""
    each = labelled.where("length(text) > 1").select("random", F.explode(F.expr("transform(sequence(1, length(text) - 1), i -> substring(text, i, 2))")).alias("pair"))
    found = {(r["random"], r["pair"]): r["count"] for r in each.groupBy("random", "pair").count().collect()}
    n = len(ALPHABET)
    out = []
    for a in ALPHABET:
        total = {kind: sum(found.get((kind, a + b), 0) for b in ALPHABET) for kind in (True, False)}
        for b in ALPHABET:
            p, q = ((found.get((kind, a + b), 0) + 0.5) / (total[kind] + 0.5 * n) for kind in (True, False))
            out.append(round(math.log(p / q), 6))
    return out


def log_ratio(token: Column, table: list[float]) -> Column:
    """The mean log-likelihood ratio of a token's steps."""
    values = F.from_json(F.lit(json.dumps(table)), "array<double>")

    def steps(codes: Column) -> Column:
        step = lambda total, i: total + F.get(values, F.get(codes, i - 1) * len(ALPHABET) + F.get(codes, i))
        return F.aggregate(F.sequence(F.lit(1), F.size(codes) - 1), F.lit(0.0), step) / (F.size(codes) - 1)

    return let(F.transform(F.split(token, ""), lambda c: F.instr(F.lit(ALPHABET), c) - 1), steps)


def before(values: Column, combine, block: int = 256) -> Column:
    """What combine (a sum or a maximum) makes of the numbers before each place, and of all as one more. Blocks' totals come first, so that a text of very many matches costs little more than a pass for each."""
    zero = F.lit(0).cast("long")
    total = lambda part: F.aggregate(part, zero, combine)

    def by_block(v: Column) -> Column:
        width = F.greatest(F.lit(block), F.sqrt(F.size(v)).cast("int"))
        blocks = F.sequence(F.lit(0), F.floor(F.size(v) / width).cast("int"))

        def each(sums: Column) -> Column:
            def start(k: Column) -> Column:
                inner = lambda t: F.transform(F.slice(v, k * width + 1, width), lambda _, i: combine(t, total(F.slice(v, k * width + 1, i))))
                return let(total(F.slice(sums, 1, k)), inner)

            return F.concat(F.flatten(F.transform(blocks, start)), F.array(total(sums)))

        return let(F.transform(blocks, lambda k: total(F.slice(v, k * width + 1, width))), each)

    return let(values, by_block)


def located(text: Column, pattern: str, group: int = 0) -> Column:
    """Structs (start, end, found) of a pattern's matches; found is the group's text."""
    size = lambda x: F.length(x).cast("long")

    def places(parts: Column) -> Column:
        def at(whole: Column) -> Column:
            def from_sums(sums: Column) -> Column:
                def one(found: Column, i: Column) -> Column:
                    start = F.get(sums, i) + F.length(F.get(parts, i))
                    return F.struct(start.cast("int").alias("start"), (start + F.length(F.get(whole, i))).cast("int").alias("end"), found.alias("found"))

                return F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else whole, one)

            return let(before(F.zip_with(F.slice(parts, 1, F.size(whole)), whole, lambda p, w: size(p) + size(w)), lambda x, y: x + y), from_sums)

        return let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), at)

    empty = F.array().cast("array<struct<start:int,end:int,found:string>>")
    return F.when(text.rlike(pattern), let(F.split(text, pattern, -1), places)).otherwise(empty)


def free(base: Column, candidates: Column) -> Column:
    """The candidates, which don't overlap each other, that no base span overlaps: sorted together, none before reaches into one and the next doesn't begin in it."""
    tag = lambda spans, mine: F.transform(spans, lambda s: F.struct(s["start"].alias("start"), F.lit(mine).alias("mine"), s["end"].alias("end"), (s["found"] if mine else F.lit("")).alias("found")))

    def with_reach(both: Column) -> Column:
        def alone(reach: Column) -> Column:
            def keep(s: Column, i: Column) -> Column:
                after = F.get(both, i + 1)
                return s["mine"] & (F.get(reach, i) <= s["start"]) & F.coalesce(after["mine"] | (after["start"] >= s["end"]), F.lit(True))

            return F.filter(both, keep)

        return let(before(F.transform(both, lambda s: F.when(s["mine"], 0).otherwise(s["end"]).cast("long")), lambda x, y: F.greatest(x, y)), alone)

    return let(F.sort_array(F.concat(tag(base, False), tag(candidates, True))), with_reach)


def listed(spans: Column) -> Column:
    return F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))))


def scan(docs: DataFrame, table: list[float]) -> DataFrame:
    """(doc_id, assign, access, hex, base, all): arrays of spans, sorted by start, then by kind as listed."""
    kinds = ("assign", "access", "hex", "markov")
    text = F.col("text")
    out = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    out = out.select(
        "doc_id",
        "text",
        F.filter(located(text, ASSIGN, 1), lambda s: F.length(s["found"]) >= 6).alias("assign"),
        located(text, ACCESS).alias("access"),
        located(text, HEX).alias("hex"),
        F.when(text.rlike(CANDIDATE), located(text, CANDIDATE)).otherwise(F.array().cast("array<struct<start:int,end:int,found:string>>")).alias("candidates"),
    )
    tagged = lambda name: F.transform(name, lambda s: F.struct(s["start"].alias("start"), F.lit(kinds.index(name)).alias("rank"), s["end"].alias("end"), F.lit(name).alias("kind")))
    out = out.withColumn("base", F.sort_array(reduce(F.concat, [tagged(k) for k in kinds[:3]])))
    enough = lambda t: F.when((F.length(t) >= LONG) & t.rlike("[0-9]") & t.rlike("[A-Za-z]"), RATIO).otherwise(F.greatest(F.lit(RATIO), EVIDENCE / (F.length(t) - 1)))
    random = F.filter("candidates", lambda s: log_ratio(s["found"], table) > enough(s["found"]))
    out = out.withColumn("candidates", F.when(F.size("candidates") > 0, random).otherwise(F.col("candidates")))
    plain = lambda spans: F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["found"].alias("found")))
    out = out.withColumn("markov", F.when(F.size("candidates") > 0, plain(free(F.col("base"), F.col("candidates")))).otherwise(F.col("candidates")))
    return out.withColumn("all", F.sort_array(F.concat("base", tagged("markov")))).drop("text", "candidates")


def report(docs: DataFrame) -> DataFrame:
    found = scan(docs, train(samples(docs.sparkSession)))
    return found.select(
        "doc_id",
        *[F.size(k).cast("long").alias(f"n_{k}") for k in ("assign", "access", "hex")],
        F.sha2(listed(F.col("base")), 256).alias("base_sha256"),
        listed(F.col("all")).alias("spans"),
        F.size("markov").cast("long").alias("n_markov"),
    )
