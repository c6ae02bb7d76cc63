"""Calls of models: how often they are tried, what a failure means, and what stands in for them offline."""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterable
from typing import Any

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Names of errors that may pass, and of those that end a run.
RETRYABLE = ("APIConnectionError", "APIConnectionTimeout", "APIError", "InternalServerError", "OverloadedError", "RateLimitError", "ServiceUnavailableError", "Timeout")
UNAVAILABLE = ("AuthenticationError", "BudgetExceededError", "InvalidRequestError", "NotFoundError", "PermissionDeniedError")
#: The categories of a reply.
CATEGORIES = ("answer", "clarify", "refusal")


class ModelUnavailable(RuntimeError):
    """The model cannot serve this run at all; no further call is made."""


def failure_class(name: Column) -> Column:
    """``unavailable``, ``retryable`` or ``item`` of an error's class name."""
    return F.when(name.isin(*UNAVAILABLE, "ModelUnavailable"), "unavailable").when(name.isin(*RETRYABLE), "retryable").otherwise("item")


def failure_of(error: BaseException) -> str:
    """The same of an error, by the names of its classes."""
    names = {c.__name__ for c in type(error).__mro__}
    return "unavailable" if names & {*UNAVAILABLE, "ModelUnavailable"} else "retryable" if names & set(RETRYABLE) else "item"


def json_object(text: str) -> dict | None:
    """A model's JSON object: the whole text, without a fence around it, or its widest braces."""
    bare = re.sub(r"\A```\w*\s*|\s*```\Z", "", text.strip())
    for candidate in (bare, *re.findall(r"(?s)\{.*\}", bare)):
        try:
            found = json.loads(candidate)
        except json.JSONDecodeError:
            continue
        if isinstance(found, dict):
            return found
    return None


def tried(call: Callable[[], Any], read: Callable[[Any], tuple[Any, str]], retries: int) -> tuple[Any, str]:
    """``(value, error)`` of the first usable reply; ``read`` gives a reply's value and what is wrong with it.

    An error that ends the run is raised at once; any other one costs a try. Without a usable reply the value is None.
    """
    wrong = ""
    for _ in range(retries + 1):
        try:
            value, wrong = read(call())
        except Exception as error:  # noqa: BLE001 - a failed call is a try
            if failure_of(error) == "unavailable":
                raise ModelUnavailable(f"{type(error).__name__}: {error}") from error
            value, wrong = None, f"{type(error).__name__}: {error}"
        if not wrong:
            return value, ""
    return None, wrong


def read_category(raw: str) -> tuple[str | None, str]:
    category = (json_object(raw) or {}).get("category") if raw.strip() not in CATEGORIES else raw.strip()
    return (category, "") if category in CATEGORIES else (None, f"malformed_classifier_output: {raw[:120]!r}")


def read_text(raw: str) -> tuple[str | None, str]:
    return (raw.strip(), "") if raw.strip() else (None, "empty_clarifier_output")


def read_score(raw: str) -> tuple[tuple[int, str] | None, str]:
    data = json_object(raw)
    if not data:
        return None, f"malformed_judge_output: {raw[:200]!r}"
    score = data.get("score")
    if isinstance(score, bool) or not isinstance(score, int) or score not in (0, 1, 2, 3):
        return None, f"invalid_score: {score!r}"
    return (score, str(data.get("remark") or "").strip() or "(no remark)"), ""


def classified(call: Callable[[], str], retries: int = 1) -> tuple[str, str]:
    """The category of a reply; an answer where the classifier gives none, so that the row is judged."""
    category, wrong = tried(call, read_category, retries)
    return category or "answer", wrong


def clarified(call: Callable[[], str], retries: int = 1) -> tuple[str, str]:
    text, wrong = tried(call, read_text, retries)
    return text or "", wrong


def judged(call: Callable[[], str], retries: int = 2) -> tuple[int | None, str]:
    """Score and remark; no score where the judge gives none, and the reason as the remark."""
    found, wrong = tried(call, read_score, retries)
    return found or (None, f"[judge_failed] {wrong}")


def summarised(call: Callable[[], str], retries: int = 2) -> tuple[tuple[str, str] | None, str]:
    """Title and description of a folder."""

    def read(raw: str) -> tuple[tuple[str, str] | None, str]:
        data = json_object(raw)
        return ((str(data.get("title", "Untitled")).strip(), str(data.get("long_description", "")).strip()), "") if data else (None, f"malformed_summary: {raw[:200]!r}")

    return tried(call, read, retries)


def replayed(replies: Iterable[Any]) -> Callable[[], Any]:
    """A stand-in that gives recorded replies in order, raising those that are errors."""
    rest = iter(replies)

    def call() -> Any:
        reply = next(rest)
        if isinstance(reply, BaseException):
            raise reply
        return reply

    return call


def summaries(content: Column, summarise: Callable[[str], str] | None = None, most_chars: int = 20_000, retries: int = 2) -> Column:
    """``struct<title,long,error>`` of folders' contents by an injected model; a model that cannot serve stops the run."""
    def run(texts: pd.Series) -> pd.DataFrame:
        out = []
        for text in texts:
            found, wrong = summarised(lambda text=text: summarise(text[:most_chars]), retries) if (text or "").strip() else (None, "no content")
            out.append((*(found or (None, None)), wrong or None))
        return pd.DataFrame(out, columns=["title", "long", "error"])

    return F.pandas_udf(run, "struct<title:string,long:string,error:string>")(content)
