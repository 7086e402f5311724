"""Operators around injected callables: evaluation runs and cascades, by partition.

The callables (a model, a verifier) are the user's; they run in ``mapInPandas``, so a lost executor's
tasks are run again elsewhere, and the rows that they return are ordinary rows.
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomtrace import schemas


def run_groups(tasks: DataFrame, groups: dict[str, Callable[[str, str], dict]]) -> DataFrame:
    """Every task (task_id, task) under every group's run function: evaluation records with ``error``."""
    pairs = tasks.select("task_id", "task", F.explode(F.array(*[F.lit(g) for g in groups])).alias("group"))
    names = [f.name for f in tasks.sparkSession.createDataFrame([], schemas.EVAL.replace("\n", " ")).schema.fields]
    defaults = {"final_pass": False, "has_evidence": True, "escalated": False, "latency_ms": 0.0, "general_score": None}

    def run(frames):
        for f in frames:
            rows = []
            for task_id, task, group in zip(f["task_id"], f["task"], f["group"], strict=True):
                row = {n: defaults.get(n, 0) for n in names} | {"task_id": task_id, "group": group, "error": None}
                try:
                    row |= groups[group](task_id, task)
                except Exception as e:  # a failing run is a result
                    row["error"] = f"{type(e).__name__}: {e}"
                rows.append(row)
            yield pd.DataFrame(rows, columns=[*names, "error"])

    return pairs.mapInPandas(run, schemas.EVAL.replace("\n", " ") + ", error string")


def cascade(tasks: DataFrame, small: Callable, repair: Callable, large: Callable, verify: Callable, max_rounds: int = 3, hard_limit: int | None = 10) -> DataFrame:
    """Small model first, then repair rounds, then the large model; tasks may carry ``n_hard``."""
    has_hard = "n_hard" in tasks.columns and hard_limit is not None

    def one(task: str, n_hard: float) -> tuple[str, str, bool, int, bool]:
        if n_hard > (hard_limit or 0) and has_hard:
            out = large(task)
            return "large", out, verify(task, out)[0], 0, True
        out = small(task)
        passed, hints = verify(task, out)
        if passed:
            return "small", out, True, 0, False
        for k in range(1, max_rounds + 1):
            out = repair(task, out, hints)
            passed, hints = verify(task, out)
            if passed:
                return "repair", out, True, k, False
        out = large(task)
        passed = verify(task, out)[0]
        return "large" if passed else "failed", out, passed, max_rounds, True

    def run(frames):
        for f in frames:
            hard = f["n_hard"] if has_hard else [0] * len(f)
            rows = [(i, *one(t, h)) for i, t, h in zip(f["task_id"], f["task"], hard, strict=True)]
            yield pd.DataFrame(rows, columns=["task_id", "tier_used", "artifact", "final_pass", "repair_rounds", "escalated"])

    return tasks.mapInPandas(run, "task_id string, tier_used string, artifact string, final_pass boolean, repair_rounds int, escalated boolean")
