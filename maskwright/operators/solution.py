"""Anonymisers that no Column can express: models with a life cycle.

A Solution is set up once, used for many batches, and torn down. `keep` says for how long a worker holds it: "task" tears it down
at the end of each task, whatever its end; "worker" keeps it for the worker's later tasks, until another solution takes its place
(a worker that Spark ends takes the model with it, without a call). Rows go through in Arrow batches, in Spark's partitions; what the
solution returns is checked: one result for each text.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator, Sequence
from typing import Any, Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from ..session import ship
from .redact import MAPPING

RESULT = f"text string, mapping {MAPPING}"


class Solution(Protocol):
    name: str

    def setup(self) -> Any:
        """The model, made where it is used."""

    def run(self, model: Any, texts: list[str], langs: list[str | None]) -> Sequence[tuple[str, Sequence[tuple[str, str, str]]]]:
        """For each text what it becomes, and (original, fake, type) of what was replaced."""

    def teardown(self, model: Any) -> None: ...


_held: dict[str, tuple[Solution, Any]] = {}


def _model(name: str, solution: Solution) -> Any:
    """This worker's model; the one of another solution is torn down first."""
    if name not in _held:
        for other in list(_held):
            drop(other)
        _held[name] = solution, solution.setup()
    return _held[name][1]


def drop(name: str) -> None:
    if name in _held:
        solution, model = _held.pop(name)
        solution.teardown(model)


def results(solution: Solution, keep: str = "task") -> Callable[[Column, Column], Column]:
    """A function from text and language to struct<text, mapping>. Null text stays null and is not shown to the solution."""
    if keep not in ("task", "worker"):
        raise ValueError("keep is task or worker")
    name = f"{solution.name}-{uuid.uuid4().hex}"

    def run(batches):
        try:
            for texts, langs in batches:
                there = texts.notna().tolist()
                given = [t for t, x in zip(texts, there, strict=True) if x]
                spoken = [None if pd.isna(v) else v for v, x in zip(langs, there, strict=True) if x]
                made = list(solution.run(_model(name, solution), given, spoken)) if given else []
                if len(made) != len(given):
                    raise ValueError(f"{solution.name}: {len(made)} results for {len(given)} texts")
                each = iter(made)
                out = [next(each) if x else (None, []) for x in there]
                yield pd.DataFrame({"text": [t for t, _ in out], "mapping": [[{"original": o, "fake": f, "type": k} for o, f, k in m] for _, m in out]})
        finally:
            if keep == "task":
                drop(name)

    run.__annotations__ = {"batches": Iterator[tuple[pd.Series, pd.Series]], "return": Iterator[pd.DataFrame]}
    return F.pandas_udf(run, RESULT)


def anonymize(docs: DataFrame, solution: Solution, keep: str = "task", text: str = "text", lang: str | None = "lang") -> DataFrame:
    """docs with text as the solution leaves it, and the column mapping."""
    ship(docs.sparkSession)
    spoken = F.col(lang) if lang else F.lit(None).cast("string")
    done = docs.withColumn("__r", results(solution, keep)(F.col(text), spoken))
    return done.withColumns({text: F.col("__r.text"), "mapping": F.col("__r.mapping")}).drop("__r")
