"""Deterministic replay of a run's actions, debug stops, and regression of two runs.

A run is one row with its action array, and replaying it folds over its actions with a state of its own,
so runs are mapped in Arrow batches where they lie: no shuffle, and no task holds more than a batch.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MISMATCH = "struct<action_id:string,kind:string,recorded:string,replayed:string,detail:string>"
RESULT = f"""run_id string, determinism_score double, n_replayed int, n_matched int, n_actions int, mismatches array<{MISMATCH}>,
final_state_digest string, side_effect_calls int, side_effect_divergences int, stop_reason string, stop_action_id string, state string""".replace("\n", " ")


def digest(value) -> str:
    """sha256 of the value's canonical JSON."""
    return hashlib.sha256(json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False).encode()).hexdigest()


class Store:
    """Versioned keys and values; ``snapshot`` and ``restore`` move it back and forth."""

    def __init__(self, initial: dict | None = None):
        self.values, self.seq, self.history = dict(initial or {}), 0, []

    def set(self, key: str, value) -> None:
        self.update({key: value})

    def update(self, values: dict) -> None:
        if values:
            self.values.update(values)
            self.seq += 1

    def digest(self) -> str:
        return digest(self.values)

    def snapshot(self) -> tuple[int, dict]:
        self.history.append((self.seq, dict(self.values)))
        return self.history[-1]

    def restore(self, snapshot: tuple[int, dict]) -> None:
        self.seq, self.values = snapshot[0], dict(snapshot[1])


class Divergence(Exception):
    """The replay asked for a side effect that the recording lacks at this place."""


def _identity(action: dict) -> tuple:
    args = action.get("args")
    return action.get("tool_name") or "", digest(args) if args else "", action.get("action_id")


class Cassette:
    """The recorded side effects of state-changing actions, given out in their order."""

    def __init__(self, actions: list[dict]):
        self.left = [a for a in actions if a.get("state_changing")][::-1]
        self.calls: list[tuple] = []

    def consume(self, action: dict) -> dict:
        self.calls.append(_identity(action))
        if not self.left:
            raise Divergence(f"no recorded side effect is left for action {action.get('action_id')!r}")
        if _identity(self.left[-1]) != self.calls[-1]:
            raise Divergence(f"the recording has another side effect at the place of action {action.get('action_id')!r}")
        return self.left.pop()


#: (action, state, cassette) -> the replayed result digest; Divergence if it can't be had.
Executor = Callable[[dict, Store, Cassette], str | None]


def faithful(action: dict, state: Store, cassette: Cassette) -> str | None:
    """The recorded outcome; a state-changing action takes it from the cassette and writes its post-state."""
    if action.get("state_changing"):
        action = cassette.consume(action)
        if action.get("post_state_digest") is not None:
            state.set(f"post_state:{action.get('action_id')}", action["post_state_digest"])
    return action.get("result_digest")


def fold(actions: list[dict], executor: Executor = faithful, cassette: list[dict] | None = None, seed: int = 0, initial: dict | None = None, stop_at: str | None = None, stop_at_mismatch: bool = False) -> dict:
    """One run's replay. An action counts once as mismatched, by its id, whatever went wrong with it.

    ``stop_at`` ends before that action; ``stop_at_mismatch`` ends at the first one, with the state before it.
    """
    tape, state = Cassette(actions if cassette is None else cassette), Store(initial)
    if "_seed" not in state.values:
        state.set("_seed", seed)
    found, bad, done, why, where = [], set(), 0, "completed", None
    for a in actions:
        name, before = a.get("action_id"), state.snapshot()
        if stop_at is not None and name == stop_at:
            why, where = "action_id", name
            break
        done += 1
        wrong = []
        if a.get("pre_state_digest") is not None and a["pre_state_digest"] != state.digest():
            wrong.append(("causal", a["pre_state_digest"], state.digest(), "the recorded state is not the replayed one"))
        recorded = a.get("result_digest")
        try:
            replayed = executor(a, state, tape)
            if None not in (recorded, replayed) and recorded != replayed:
                wrong.append(("fidelity", recorded, replayed, "the replayed result is not the recorded one"))
        except Divergence as e:
            wrong.append(("side_effect", recorded, None, str(e)))
        found += [dict(zip(("action_id", "kind", "recorded", "replayed", "detail"), (name, *w), strict=True)) for w in wrong]
        if wrong:
            bad.add(name)
        if stop_at_mismatch and name in bad:
            state.restore(before)
            why, where = "mismatch", name
            break
    return {
        "determinism_score": (done - len(bad)) / done if done else 1.0, "n_replayed": done, "n_matched": done - len(bad), "n_actions": len(actions), "mismatches": found,
        "final_state_digest": state.digest(), "side_effect_calls": len(tape.calls), "side_effect_divergences": sum(f["kind"] == "side_effect" for f in found),
        "stop_reason": why, "stop_action_id": where, "state": json.dumps(state.values, sort_keys=True),
    }


def replay(records: DataFrame, executor: Executor = faithful, cassettes: str | None = None, seed: int = 0, initial: dict | None = None, stop_at: str | None = None, stop_at_mismatch: bool = False) -> DataFrame:
    """A row a run: its score, mismatches, and the state at its end or stop.

    ``cassettes`` names a column of recorded actions to serve side effects from, else the run's own serve.
    """
    tapes = F.to_json(cassettes) if cassettes else F.lit(None).cast("string")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = []
            for name, own, tape in zip(f["run_id"], f["a"], f["t"], strict=True):
                rows.append({"run_id": name} | fold(json.loads(own) if own else [], executor, json.loads(tape) if tape else None, seed, initial, stop_at, stop_at_mismatch))
            yield pd.DataFrame(rows, columns=["run_id", *(c.split()[0] for c in _columns(RESULT)[1:])])

    return records.select("run_id", F.to_json("actions").alias("a"), tapes.alias("t")).mapInPandas(run, RESULT)


def _columns(schema: str) -> list[str]:
    out, depth = [""], 0
    for c in schema:
        depth += {"<": 1, ">": -1}.get(c, 0)
        if c == "," and not depth:
            out.append("")
        else:
            out[-1] += c
    return [x.strip() for x in out]


def regression(baseline: DataFrame, candidate: DataFrame) -> DataFrame:
    """Actions of both versions of a run whose digests differ (a null differs from a value)."""
    each = lambda d, name: d.select("run_id", F.posexplode("actions").alias("k", "a")).groupBy("run_id", F.col("a.action_id").alias("action_id")).agg(F.max_by("a.result_digest", "k").alias(name))
    joined = each(baseline, "baseline_digest").join(each(candidate, "candidate_digest"), ["run_id", "action_id"])
    return joined.where(~F.col("baseline_digest").eqNullSafe(F.col("candidate_digest")))
