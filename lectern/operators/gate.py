"""Whether a text may leave the house: the policy, the consent and the budget that a call to a model of others needs, and the record of such calls."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class Refused(Exception):
    pass


@dataclass(frozen=True)
class Policy:
    """never, ask (a call needs consent) or always; characters that may be sent in a window; and the window: day, month or total."""

    cloud: str = "ask"
    budget_chars: int | None = None
    window: str = "month"
    excerpt_only: bool = False


def spent(calls: DataFrame, policy: Policy, now: str) -> DataFrame:
    """One row: calls and characters of the window that holds a time; failed calls count too."""
    at = F.lit(now).cast("timestamp")
    within = F.lit(True) if policy.window == "total" else F.date_trunc(policy.window, "called_at") == F.date_trunc(policy.window, at)
    return calls.where((F.col("tier") == "cloud") & within).agg(F.count(F.lit(1)).alias("n_calls"), F.coalesce(F.sum("prompt_chars"), F.lit(0)).alias("chars"))


def assert_allowed(calls: DataFrame, policy: Policy, opt_in: bool, now: str, chars: int = 0) -> None:
    """Raises ``Refused`` with the reason if a call may not be made."""
    if policy.cloud == "never":
        raise Refused("the policy allows no model outside")
    if policy.cloud == "ask" and not opt_in:
        raise Refused("nobody consented to this call")
    if policy.budget_chars is not None:
        used = spent(calls, policy, now).first()["chars"]
        if used + chars > policy.budget_chars:
            raise Refused(f"{used} of {policy.budget_chars} characters are spent")


def calls_by_document(calls: DataFrame) -> DataFrame:
    """(document_id, n_calls, n_failed, chars): what was sent of each document."""
    return calls.where("tier = 'cloud'").groupBy("document_id").agg(F.count(F.lit(1)).alias("n_calls"), F.count("error").alias("n_failed"), F.sum("prompt_chars").alias("chars"))
