"""Full-text search over a positional inverted index of stems, ranked by BM25.

``postings`` turns texts into rows (term, key, n, at): where each stem stands in each text. It
can be used as it is or stored: an ``Index`` keeps postings in a ``Store``, sorted by term and
key, so that a query reads only the row groups of its own terms; texts are added, changed and
taken out by what differs, without a rebuild, each change in one commit. A query is
words (all are wanted), "quoted phrases", prefixes (pre*), NOT before what must be absent, and
OR between alternatives. Any other sign parts words and is never an error.

Words are runs of letters, marks and digits, without accents and case; stems are those of the
Porter algorithm in its author's later form.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.operators.graph import kept
from lectern.sources.store import NotFound, Store

WORD = re.compile(r"[^\W_]+", re.UNICODE)
#: Bytes of text that are read into words at a time.
PART = 1 << 20
#: The parameters of BM25, and the least weight of a term.
K1, B, LEAST_IDF = 1.2, 0.75, 1e-6

# The suffixes of the Porter algorithm and what they become, of each step.
STEP_1A = {"sses": "ss", "ies": "i", "ss": "ss", "s": ""}
STEP_2 = {
    "ational": "ate", "tional": "tion", "enci": "ence", "anci": "ance", "izer": "ize", "bli": "ble", "alli": "al", "entli": "ent", "eli": "e", "ousli": "ous", "ization": "ize",
    "ation": "ate", "ator": "ate", "alism": "al", "iveness": "ive", "fulness": "ful", "ousness": "ous", "aliti": "al", "iviti": "ive", "biliti": "ble", "logi": "log",
}
STEP_3 = {"icate": "ic", "ative": "", "alize": "al", "iciti": "ic", "ical": "ic", "ful": "", "ness": ""}
STEP_4 = ("al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ion", "ou", "ism", "ate", "iti", "ous", "ive", "ize")
LONGEST_FIRST = [tuple(sorted(s, key=len, reverse=True)) for s in (STEP_1A, STEP_2, STEP_3, STEP_4)]


# ---- stems ------------------------------------------------------------------------------


def shape(stem: str) -> str:
    """A v for each vowel and a c for each consonant; y is a vowel behind a consonant."""
    out = ""
    for letter in stem:
        out += "v" if letter in "aeiou" or (letter == "y" and out[-1:] == "c") else "c"
    return out


def measure(stem: str) -> int:
    return shape(stem).count("vc")


def short(stem: str) -> bool:
    """Whether it ends in consonant, vowel, consonant, the last none of w, x and y."""
    return shape(stem)[-3:] == "cvc" and stem[-1] not in "wxy"


def replaced(word: str, suffixes: tuple[str, ...], to: dict[str, str] | None, least: int) -> str:
    """The word with the longest of the suffixes, told longest first, that it has replaced, if what stands before it measures ``least``."""
    if not word.endswith(suffixes):
        return word
    for suffix in suffixes:
        if word.endswith(suffix):
            before = word[: len(word) - len(suffix)]
            if measure(before) >= least and (suffix != "ion" or before[-1:] in ("s", "t")):
                return before + (to[suffix] if to else "")
            return word
    return word


@lru_cache(maxsize=1 << 18)
def stem(word: str) -> str:
    """The Porter stem of a lower-case word."""
    if not 3 <= len(word) <= 64:
        return word
    word = replaced(word, LONGEST_FIRST[0], STEP_1A, 0)
    if word.endswith("eed"):
        word = replaced(word, ("eed",), {"eed": "ee"}, 1)
    else:
        for suffix in ("ed", "ing"):
            before = word[: len(word) - len(suffix)]
            if word.endswith(suffix) and "v" in shape(before):
                if before.endswith(("at", "bl", "iz")) or (measure(before) == 1 and short(before)):
                    word = before + "e"
                elif before[-1:] == before[-2:-1] and shape(before)[-1] == "c" and before[-1] not in "lsz":
                    word = before[:-1]
                else:
                    word = before
                break
    if word.endswith("y") and "v" in shape(word[:-1]):
        word = word[:-1] + "i"
    word = replaced(word, LONGEST_FIRST[1], STEP_2, 1)
    word = replaced(word, LONGEST_FIRST[2], STEP_3, 1)
    word = replaced(word, LONGEST_FIRST[3], None, 2)
    if word.endswith("e") and (measure(word[:-1]) > 1 or (measure(word[:-1]) == 1 and not short(word[:-1]))):
        word = word[:-1]
    return word[:-1] if word.endswith("ll") and measure(word[:-1]) > 1 else word


def folded(text: str) -> str:
    """Lower case, without accents."""
    if text.isascii():
        return text.lower()
    text = unicodedata.normalize("NFD", text.lower())
    for mark in filter(unicodedata.combining, set(text)):
        text = text.replace(mark, "")
    return text


def terms(text: str) -> list[str]:
    return [stem(w) for w in WORD.findall(folded(text))]


# ---- queries ----------------------------------------------------------------------------


@dataclass(frozen=True)
class Clause:
    """Stems in a row, the last of them a beginning if ``prefix``; wanted, or not."""

    terms: tuple[str, ...]
    prefix: bool = False
    wanted: bool = True


def clauses(query: str) -> list[list[Clause]]:
    """The alternatives of a query, each with what it wants and what it doesn't; those that want nothing are left out."""
    out: list[list[Clause]] = [[]]
    wanted = True
    for phrase, word, star in re.findall(r'"([^"]*)"|([^\s"*]+)(\*?)', query):
        if word == "OR" and not star:
            out.append([])
        elif word in ("NOT", "AND") and not star:
            wanted = word != "NOT"
        else:
            words = WORD.findall(folded(phrase or word))
            if star and words:
                # A beginning is no word yet: it is looked up as it is written.
                found = (*map(stem, words[:-1]), words[-1])
            else:
                found = tuple(map(stem, words))
            if found:
                out[-1].append(Clause(found, bool(star), wanted))
                wanted = True
    return [a for a in out if any(c.wanted for c in a)]


def asked_terms(asked: Sequence[Clause]) -> tuple[set[str], tuple[str, ...]]:
    """The terms that clauses need, and the beginnings of terms."""
    return {t for c in asked for t in (c.terms[:-1] if c.prefix else c.terms)}, tuple(sorted({c.terms[-1] for c in asked if c.prefix}))


def looked_up(asked: Sequence[Clause]) -> Column:
    """Which terms the clauses need."""
    whole, beginnings = asked_terms(asked)
    found = F.col("term").isin(sorted(whole)) if whole else F.lit(False)
    for beginning in beginnings:
        found = found | F.col("term").startswith(beginning)
    return found


# ---- postings ---------------------------------------------------------------------------


def in_parts(batch: pa.RecordBatch, text: int) -> Iterator[pa.RecordBatch]:
    """The rows of a batch, a few at a time: of about ``PART`` bytes of text."""
    size = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False)
    at = [0, *(np.flatnonzero(np.diff(np.cumsum(size, dtype=np.int64) // PART)) + 1).tolist(), len(batch)]
    for i, j in zip(at, at[1:], strict=False):
        if j > i:
            yield batch.slice(i, j - i)


def postings(docs: DataFrame, keys: Sequence[str], text: str = "text", asked: Sequence[Clause] | None = None) -> DataFrame:
    """(term, *keys, n, at, length): the places of each stem in each text, and how many words the text has; of those that clauses ask for, if any are given. Texts without a word have none."""
    kinds = dict(docs.dtypes)
    whole, beginnings = asked_terms(asked or [])
    may_be = re.compile(asked_pattern(asked or []), re.DOTALL)

    def wanted(term: str) -> bool:
        return asked is None or term in whole or term.startswith(beginnings)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in chain.from_iterable(in_parts(b, b.schema.get_field_index(text)) for b in batches):
            words = [WORD.findall(folded(told)) if told else [] for told in part.column(len(keys)).to_pylist()]
            length = np.fromiter(map(len, words), np.int32, len(words))
            # Each different word of the part is stemmed once; what follows is done with numbers.
            number: dict[str, int] = {}
            # Of words that can have no asked stem all are one, which is not wanted.
            own_stem = stem if asked is None else lambda w: stem(w) if may_be.fullmatch(w) else ""
            code = {w: number.setdefault(own_stem(w), len(number)) for w in set().union(*words)}
            own = np.fromiter(map(code.__getitem__, chain.from_iterable(words)), np.int64, int(length.sum()))
            row = np.repeat(np.arange(len(words)), length)
            place = np.arange(len(own)) - np.repeat(np.cumsum(length) - length, length)
            if asked is not None:
                told = np.fromiter(map(wanted, number), bool, len(number))[own]
                own, row, place = own[told], row[told], place[told]
            group = row * len(number) + own
            order = np.argsort(group, kind="stable")
            first = np.flatnonzero(np.diff(group[order], prepend=-1))
            if len(first):
                at = np.append(first, len(order)).astype(np.int32)
                text_of = row[order[first]]
                columns = [pa.array(list(number), pa.string()).take(own[order[first]]), *[part.column(i).take(text_of) for i in range(len(keys))]]
                columns += [np.diff(at), pa.ListArray.from_arrays(at, pa.array(place[order].astype(np.int32))), length[text_of]]
                yield pa.RecordBatch.from_arrays([pa.array(c) if isinstance(c, np.ndarray) else c for c in columns], ["term", *keys, "n", "at", "length"])

    told = ", ".join(f"`{k}` {kinds[k]}" for k in keys)
    return docs.select(*keys, text).mapInArrow(run, f"term string, {told}, n int, at array<int>, length int")


# ---- postings of asked terms ------------------------------------------------------------


def stemmed_to(term: str) -> str:
    """A regular expression of the words that could have a stem; of others Python need not be asked.

    The stem is the word without its end, which is a suffix or several, all of a to z, and maybe
    a doubled character before them; e, i or le may stand in their place, and the e may go from le.
    """
    cut = [0, *([1] if term[-1] in "eil" else []), *([2] if term.endswith("le") else [])]
    return "|".join([term, *(f"{term[: len(term) - k]}.?[a-z]+" for k in cut)])


def begun_with(beginning: str) -> str:
    """The same for stems that begin so."""
    cut = 2 if beginning.endswith("le") else 1 if beginning[-1] in "eil" else 0
    return f"{beginning[: len(beginning) - cut]}.*"


def asked_pattern(asked: Sequence[Clause]) -> str:
    """A regular expression of all words that could have an asked stem."""
    whole, beginnings = asked_terms(asked)
    return "|".join([stemmed_to(t) for t in sorted(whole)] + [begun_with(b) for b in beginnings]) or "(?!)"


def asked_postings(docs: DataFrame, keys: Sequence[str], text: str, asked: Sequence[Clause]) -> DataFrame:
    """What ``postings`` gives of asked terms, in rows of a place each where Spark finds them.

    Spark reads plain texts, of ASCII alone; words that are equal to an asked stem it tells too,
    and Python stems those others that could have one. Other texts are read by Python.
    """
    whole, beginnings = asked_terms(asked)
    plain = F.length(text) == F.octet_length(text)
    found = postings(docs.where(~plain), keys, text, asked)
    equal = [t for t in sorted(whole) if stem(t) == t]
    held = docs.where(plain).select(*keys, F.lower(text).alias("_folded"))

    def words_where(part: str) -> DataFrame:
        """A row for each word of the texts that have such a part."""
        words = held.where(F.col("_folded").rlike(part)).select(*keys, F.regexp_extract_all("_folded", F.lit("[a-z0-9]+"), F.lit(0)).alias("_words"))
        return words.select(*keys, F.size("_words").alias("length"), "_words").select(*keys, "length", F.posexplode("_words").alias("place", "word"))

    if equal:
        found = found.union(words_where("|".join(equal)).where(F.col("word").isin(equal)).select("word", *keys, F.lit(1), F.array("place"), "length"))
    # What such words have in them, so that a text with equal ones alone is not looked through.
    parts = [p.replace(".?[a-z]+", "[a-z0-9]?[a-z]") for t in sorted(whole) for p in stemmed_to(t).split("|") if p not in equal] + [begun_with(b)[:-2] for b in beginnings]
    rest = words_where("|".join(parts) or "(?!)").where(~F.col("word").isin(equal) & F.col("word").rlike(f"^(?:{asked_pattern(asked)})$")).select("word", *keys, "place", "length")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            terms = [stem(w) for w in batch.column(0).to_pylist()]
            told = pa.array([t in whole or t.startswith(beginnings) for t in terms], pa.bool_())
            at = pa.ListArray.from_arrays(np.arange(len(batch) + 1, dtype=np.int32), batch.column(len(keys) + 1))
            columns = [pa.array(terms, pa.string()), *batch.columns[1 : len(keys) + 1], pa.array(np.ones(len(batch), np.int32)), at, batch.column(len(keys) + 2)]
            yield pa.RecordBatch.from_arrays(columns, ["term", *keys, "n", "at", "length"]).filter(told)

    return found.union(rest.mapInArrow(run, ", ".join(f"`{c}` {t}" for c, t in found.dtypes)))


# ---- what a query finds -------------------------------------------------------------------


def moved_back(places: str, by: int) -> Column:
    return F.transform(places, lambda p: p - by)


def found_at(clause: Clause, i: int) -> tuple[list[Column], Column, Column]:
    """Aggregates over a text's postings, and from them how often the clause stands there, and where first. A single term is counted, which takes no lists."""
    own = [F.col("term").startswith(t) if clause.prefix and j == len(clause.terms) - 1 else F.col("term") == t for j, t in enumerate(clause.terms)]
    if len(own) == 1:
        often = F.coalesce(F.sum(F.when(own[0], F.size("at"))), F.lit(0)).cast("int")
        return [often.alias(f"_c{i}"), F.min(F.when(own[0], F.array_min("at"))).alias(f"_f{i}")], F.col(f"_c{i}"), F.col(f"_f{i}")
    kept = [F.flatten(F.collect_list(F.when(c, F.col("at")))).alias(f"_c{i}_{j}") for j, c in enumerate(own)]
    places = F.col(f"_c{i}_0")
    for j in range(1, len(clause.terms)):
        places = F.array_intersect(places, moved_back(f"_c{i}_{j}", j))
    return kept, F.size(places), F.array_min(places)


def matched(rows: DataFrame, keys: Sequence[str], query: str, n_texts: int, n_words: int) -> DataFrame:
    """(*keys, score, n, first): the texts that the query finds among postings, of so many texts and words in all; n is how often, and first where first."""
    alternatives = clauses(query)
    asked = list(dict.fromkeys(c for a in alternatives for c in a))
    if not asked:
        return rows.where("false").select(*keys, F.lit(0.0).alias("score"), F.lit(0).cast("long").alias("n"), F.lit(0).alias("first"))
    aggregates, told = [], []
    for i, clause in enumerate(asked):
        more, often, earliest = found_at(clause, i)
        aggregates += more
        told += [often.alias(f"_t{i}"), earliest.alias(f"_p{i}")]
    held = rows.where(looked_up(asked)).groupBy(*keys).agg(F.first("length").alias("_length"), *aggregates)
    held = kept(held.select(*keys, "_length", *told))  # read twice
    times = {c: F.col(f"_t{i}") for i, c in enumerate(asked)}
    # How many texts have each clause: one row.
    having = held.agg(*[F.count_if(times[c] > 0).alias(f"_n{i}") for i, c in enumerate(asked)]).first()
    any_of = F.lit(False)
    for alternative in alternatives:
        all_of = F.lit(True)
        for c in alternative:
            all_of = all_of & ((times[c] > 0) if c.wanted else (times[c] == 0))
        any_of = any_of | all_of
    score, n, first = F.lit(0.0), F.lit(0), []
    average = max(1.0, n_words / max(1, n_texts))
    for i, c in enumerate(asked):
        if c.wanted:
            idf = F.log((F.lit(float(n_texts)) - having[i] + 0.5) / (having[i] + 0.5))
            weight = F.when(idf > 0, idf).otherwise(LEAST_IDF)
            score = score + weight * times[c] * (K1 + 1) / (times[c] + K1 * (1 - B + B * F.col("_length") / average))
            n = n + times[c]
            first.append(F.col(f"_p{i}"))
    earliest = F.least(*first) if len(first) > 1 else first[0]
    return held.where(any_of).select(*keys, score.alias("score"), n.cast("long").alias("n"), earliest.alias("first"))


def best(found: DataFrame, keys: Sequence[str], limit: int) -> DataFrame:
    return found.orderBy(F.desc("score"), *keys).limit(limit)


def search(docs: DataFrame, query: str, keys: Sequence[str], text: str = "text") -> DataFrame:
    """What ``matched`` gives of texts that no index holds yet; these are read whole."""
    totals = docs.select(F.size(F.regexp_extract_all(F.coalesce(F.col(text), F.lit("")), F.lit(r"[\p{L}\p{N}\p{M}]+"), F.lit(0))).alias("n")).agg(F.count(F.lit(1)), F.sum("n")).first()
    return matched(asked_postings(docs, keys, text, [c for a in clauses(query) for c in a]), keys, query, totals[0], totals[1] or 0)


def with_snippets(found: DataFrame, docs: DataFrame, keys: Sequence[str], words: int = 8, text: str = "text") -> DataFrame:
    """found with the words around the first place of each hit, of a list that was cut to its best."""
    begin = F.greatest(F.col("first") - words, F.lit(0))
    held = F.slice(F.split(F.btrim(F.regexp_replace(F.col(text), r"[^\p{L}\p{N}\p{M}]+", " ")), " "), begin + 1, F.lit(2 * words + 1))
    return F.broadcast(found).join(docs.select(*keys, text), list(keys)).withColumn("snippet", F.array_join(held, " ")).drop(text)


# ---- a stored index ---------------------------------------------------------------------


class Index:
    """An index of texts by key in a store: tables ``<name>_postings`` and ``<name>_texts``, which has a row for every state of every text."""

    def __init__(self, store: Store, name: str, keys: Sequence[str]) -> None:
        self.store, self.name, self.keys = store, name, list(keys)

    def exists(self) -> bool:
        return f"{self.name}_texts" in self.store.tables()

    def texts(self) -> DataFrame:
        """Every state of every text: keys, hash, length and the step that made it."""
        if not self.exists():
            raise NotFound(f"{self.name} is not indexed for search yet")
        return self.store.table(f"{self.name}_texts")

    def totals(self) -> dict:
        return self.store.setting(f"{self.name}_totals", {"texts": 0, "words": 0, "step": 0})

    def _latest(self, wanted: DataFrame | None = None) -> DataFrame:
        """The last state of each text, of the keys that are wanted."""
        rows = self.texts() if wanted is None else self.texts().join(wanted.select(*self.keys).distinct(), self.keys, "left_semi")
        last = Window.partitionBy(*self.keys).orderBy(F.desc("step"))
        return rows.withColumn("_k", F.row_number().over(last)).where("_k = 1").drop("_k")

    def add(self, docs: DataFrame, text: str = "text") -> int:
        """Index the texts that are new or that differ from their last state; how many these were. A null text is taken out."""
        docs = docs.select(*self.keys, F.col(text).alias("text")).dropDuplicates(self.keys)
        known = docs.select(*self.keys, "text", F.sha2("text", 256).alias("hash"))
        step = self.totals()["step"] + 1
        if self.exists():
            before = self._latest(docs).select(*self.keys, F.col("hash").alias("_hash"), F.col("length").alias("_length"))
            changed = known.join(before, self.keys, "left").where("NOT hash <=> _hash")
        else:
            changed = known.where("hash IS NOT NULL").withColumns({"_hash": F.lit(None).cast("string"), "_length": F.lit(None).cast("int")})
        part = f"{self.store.folder}/{self.name}_step/{step:09d}"
        length = F.size(F.regexp_extract_all("text", F.lit(r"[\p{L}\p{N}\p{M}]+"), F.lit(0)))
        changed.withColumn("length", F.when(F.col("text").isNotNull(), length).otherwise(0)).write.mode("overwrite").parquet(part)
        changed = self.store.spark.read.parquet(part)
        gone = F.count_if(F.col("_hash").isNotNull())
        sums = changed.agg(F.count(F.lit(1)), F.count_if(F.col("hash").isNotNull()) - gone, F.coalesce(F.sum(F.col("length") - F.coalesce("_length", F.lit(0))), F.lit(0))).first()
        if sums[0] or not self.exists():
            totals = self.totals()
            # Written before they are dealt out: ranges are found by looking at a sample, and texts are to be read into words once.
            draft = f"{part}-postings"
            new = postings(changed.where("text IS NOT NULL"), self.keys)
            new.write.mode("overwrite").parquet(draft)
            new = self.store.spark.read.schema(new.schema).parquet(draft).withColumn("step", F.lit(step))
            # By term and key, so that a common term is many tasks' work and a query reads few row groups.
            new = new.repartitionByRange("term", *self.keys).sortWithinPartitions("term", *self.keys)
            texts = changed.select(*self.keys, "hash", "length", F.lit(step).alias("step"))
            settings = {f"{self.name}_totals": {"texts": totals["texts"] + sums[1], "words": totals["words"] + int(sums[2]), "step": step}}
            self.store.transaction({f"{self.name}_postings": new, f"{self.name}_texts": texts}, append=True, settings=settings)
            self.store.drop_folder(draft)
        self.store.drop_folder(part)
        return sums[0]

    def remove(self, gone: DataFrame) -> int:
        """Take texts out by key."""
        return self.add(gone.select(*self.keys, F.lit(None).cast("string").alias("text")))

    def search(self, query: str, limit: int | None = None) -> DataFrame:
        """(*keys, score, n, first) of the texts that the query finds, read from the index alone; the best if a limit is given."""
        totals, asked = self.totals(), [c for a in clauses(query) for c in a]
        self.texts()
        rows = self.store.table(f"{self.name}_postings").where(looked_up(asked))
        live = self._latest(rows).select(*self.keys, "step")
        found = matched(rows.join(live, [*self.keys, "step"], "left_semi"), self.keys, query, totals["texts"], totals["words"])
        return found if limit is None else best(found, self.keys, limit)

    def compact(self) -> None:
        """Write the postings of the present states alone, in one part."""
        live = self._latest()
        rows = self.store.table(f"{self.name}_postings").join(live.where("hash IS NOT NULL").select(*self.keys, "step"), [*self.keys, "step"], "left_semi")
        rows = rows.select(*self.store.table(f"{self.name}_postings").columns).repartitionByRange("term", *self.keys).sortWithinPartitions("term", *self.keys)
        self.store.transaction({f"{self.name}_postings": rows, f"{self.name}_texts": live.where("hash IS NOT NULL")})
