"""Scheduled work in chunks: a task plans what there is to do, runs one chunk at a time, and combines the results, which a scheduler may keep between runs."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.operators import corpus, history
from lectern.operators.search import Index


class TaskFailed(Exception):
    """A task found what it was there to find; the result says what."""

    def __init__(self, name: str, result: dict) -> None:
        super().__init__(f"{name}: {result}")
        self.result = result


@dataclass(frozen=True)
class Task:
    """plan(tables) names the chunks, run(tables, chunk) works through one, combine(results) is pure; fails says whether a result is a finding."""

    name: str
    plan: Callable[[dict[str, DataFrame]], list[dict]]
    run: Callable[[dict[str, DataFrame], dict], dict]
    combine: Callable[[list[dict]], dict]
    fails: Callable[[dict], bool] = field(default=lambda result: False)

    def __call__(self, tables: dict[str, DataFrame]) -> dict:
        result = self.combine([self.run(tables, chunk) for chunk in self.plan(tables)])
        if self.fails(result):
            raise TaskFailed(self.name, result)
        return result


def total(results: list[dict]) -> dict:
    """The sum of every number of the results."""
    return {k: sum(r.get(k, 0) for r in results) for k in sorted({k for r in results for k in r})}


def ranges(name: str, column: str, size: int) -> Callable[[dict[str, DataFrame]], list[dict]]:
    """A plan of ranges of a number column, so many to a chunk."""

    def plan(tables: dict[str, DataFrame]) -> list[dict]:
        low, high = tables[name].agg(F.min(column), F.max(column)).first()
        return [] if low is None else [{"from": a, "to": min(a + size, high + 1)} for a in range(low, high + 1, size)]

    return plan


def within(df: DataFrame, column: str, chunk: dict) -> DataFrame:
    return df.where((F.col(column) >= chunk["from"]) & (F.col(column) < chunk["to"]))


def _verify(tables: dict[str, DataFrame], chunk: dict) -> dict:
    held = corpus.audit_storage(within(tables["expected"], "doc_id", chunk), tables["stored"])
    return {r["reason"]: r["n"] for r in corpus.audit_summary(held).collect()}  # six reasons at most


def _due(tables: dict[str, DataFrame], chunk: dict) -> dict:
    return {r["state"]: r["n"] for r in history.upcoming(tables["entries"], chunk["as_of"]).groupBy("state").agg(F.count(F.lit(1)).alias("n")).collect()}  # two states


def _unreviewed(tables: dict[str, DataFrame], chunk: dict) -> dict:
    return {"unlinked": within(tables["instances"], "seq", chunk).join(tables["mentions"].where("NOT unlinked"), "instance_id", "left_anti").count()}


def _indexed(index: Index) -> Callable[[dict[str, DataFrame], dict], dict]:
    return lambda tables, chunk: {"indexed": index.add(within(tables["pages"], index.keys[0], chunk)), "chunks": 1}


def catalogue(as_of: str, chunk: int = 1_000_000, index: Index | None = None) -> dict[str, Task]:
    """The tasks by name. Verifying fails if an original is not sound; proposing pages and the digest of dates only report; given an index, what is new or has changed is indexed."""
    faults = ("missing", "altered", "misfiled", "not_stored")
    own = {"search-index": Task("search-index", ranges("pages", index.keys[0], chunk), _indexed(index), total)} if index else {}
    return own | {
        "verify": Task("verify", ranges("expected", "doc_id", chunk), _verify, total, lambda r: any(r.get(f) for f in faults)),
        "propose": Task("propose", ranges("instances", "seq", chunk), _unreviewed, total),
        "calendar": Task("calendar", lambda tables: [{"as_of": as_of}], _due, total),
    }
