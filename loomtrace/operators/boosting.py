"""Boosted trees for more than two classes, over Spark: all folds and classes of a round grow together.

Features are cut into bins once, at quantiles, and written with the label and the fold as a narrow table. Rows of
one label, fold and bins have the same gradients, so every ``KEPT`` rounds they are counted once, with those that
take part in each of these rounds, and the counts are what is learnt from. For each level of a round's trees, one
job over the counts adds up, for every model, class, node, feature and bin, the rows, their
gradients and their curvatures of the multinomial loss; the driver picks the splits from these sums, whose
number depends on the parameters alone. Sums are taken in fixed point, so they don't depend on how rows are
dealt to tasks or on a task that ran twice. Margins follow from the trees; those of the rounds before the counts
are written with them, so a job looks at few trees.

Model k of the folds learns from all rows but those of fold k, the last from all.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomtrace.functions.running import running
from loomtrace.shared import written

BINS, KEPT, POINT = 32, 16, 1 << 20


@dataclass(frozen=True)
class Settings:
    rounds: int = 200
    depth: int = 4
    rate: float = 0.05
    share: float = 0.8
    least: int = 5
    seed: int = 42


@dataclass
class Tree:
    """A complete tree: per inner node the feature and the last bin that goes left; a node of feature -1 sends all left."""

    feature: np.ndarray
    bin: np.ndarray
    value: np.ndarray
    gain: dict[int, float] = field(default_factory=dict)

    def leaf(self, x: np.ndarray, depth: int) -> np.ndarray:
        """Node reached after ``depth`` levels, counted from 0 within the level."""
        node = np.zeros(len(x), np.int64)
        rows = np.arange(len(x))
        for level in range(depth):
            at = (1 << level) - 1 + node
            f = self.feature[at]
            node = 2 * node + ((f >= 0) & (x[rows, np.maximum(f, 0)] > self.bin[at]))
        return node


def dealt(rows: DataFrame, label: str, id_col: str, folds: int = 5) -> DataFrame:
    """``rows`` with a fold: those of a label in the order of their id's hash go round the folds, so that a label's folds differ by one row at most."""
    hashed = rows.withColumn("_h", F.md5(F.coalesce(F.col(id_col).cast("string"), F.lit(""))))
    ranked = running(hashed, [label], "_h", {"_rank": F.lit(1).cast("long")}, (id_col,))
    return ranked.withColumn("fold", ((F.col("_rank") - 1) % folds).cast("int")).drop("_rank", "_h")


def cuts(rows: DataFrame, columns: list[str], bins: int = BINS) -> list[list[float]]:
    """At most ``bins`` - 1 distinct quantiles of each feature."""
    at = [k / bins for k in range(1, bins)]
    found = rows.agg(*[F.percentile_approx(F.coalesce(F.col(c).cast("double"), F.lit(0.0)), at, 100_000).alias(c) for c in columns]).first()
    return [sorted(set(found[c] or [])) for c in columns]


def gradients(margins: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Fixed-point gradient and curvature of each class."""
    p = np.exp(margins - margins.max(axis=1, keepdims=True))
    p /= p.sum(axis=1, keepdims=True)
    g = (np.arange(margins.shape[1]) == y[:, None]) - p
    return np.rint(g * POINT).astype(np.int64), np.rint(p * (1 - p) * POINT).astype(np.int64)


def drawn(h: np.ndarray, turn: int, s: Settings) -> np.ndarray:
    """Whether a row takes part in a round, by its hash."""
    mixed = (h.astype(np.uint64) ^ np.uint64((turn * 0x9E3779B97F4A7C15 + s.seed) % (1 << 64))) * np.uint64(0xBF58476D1CE4E5B9)
    mixed = (mixed ^ (mixed >> np.uint64(31))) * np.uint64(0x94D049BB133111EB)
    return (mixed >> np.uint64(11)) / (1 << 53) < s.share


@dataclass
class Boosted:
    """The models: trees[turn][model][class], of which the first ``held`` rounds are in the rows' margins."""

    columns: list[str]
    cuts: list[list[float]]
    labels: list[str]
    folds: int
    settings: Settings
    trees: list[list[list[Tree]]] = field(default_factory=list)
    held: int = 0

    @property
    def models(self) -> int:
        return self.folds + 1

    def margins(self, x: np.ndarray, before: np.ndarray) -> np.ndarray:
        """rows x models x classes."""
        out = before.reshape(len(x), self.models, len(self.labels)).copy()
        for turn in self.trees[self.held :]:
            for m, of_model in enumerate(turn):
                for k, tree in enumerate(of_model):
                    out[:, m, k] += self.settings.rate * tree.value[tree.leaf(x, self.settings.depth)]
        return out

    def sums(self, x: np.ndarray, y: np.ndarray, fold: np.ndarray, times: np.ndarray, before: np.ndarray, growing: list[list[Tree]], level: int) -> tuple[np.ndarray, ...]:
        """Rows, gradients and curvatures by model, class, node of the level, feature and bin; ``times``: how many rows of each kind take part."""
        nodes, features, classes = 1 << level, x.shape[1], len(self.labels)
        shape = (self.models, classes, nodes, features, BINS)
        out = [np.zeros(shape, np.int64) for _ in range(3)]
        margins = self.margins(x, before)
        for m in range(self.models):
            use = (times > 0) & (fold != m)
            n = times[use]
            g, s = gradients(margins[use, m], y[use])
            for k in range(classes):
                node = growing[m][k].leaf(x[use], level)
                for f in range(features):
                    at = node * BINS + x[use, f]
                    for o, w in zip(out, (n, g[:, k] * n, s[:, k] * n), strict=True):
                        o[m, k, :, f] += np.rint(np.bincount(at, w, nodes * BINS)).astype(np.int64).reshape(nodes, BINS)
        return tuple(out)

    def grow(self, tree: Tree, level: int, n: np.ndarray, g: np.ndarray) -> None:
        """The best split of each node of a level: the greatest drop in squared error with enough rows on both sides; ties go to the first."""
        for node in range(1 << level):
            left_n, left_g = np.cumsum(n[node], axis=1)[:, :-1], np.cumsum(g[node], axis=1)[:, :-1].astype(np.float64)
            all_n, all_g = n[node, 0].sum(), float(g[node, 0].sum())
            right_n, right_g = all_n - left_n, all_g - left_g
            fits = (left_n >= self.settings.least) & (right_n >= self.settings.least)
            gain = np.where(fits, left_g**2 / np.maximum(left_n, 1) + right_g**2 / np.maximum(right_n, 1) - all_g**2 / max(all_n, 1), 0.0)
            best = int(gain.argmax())
            f, b = divmod(best, gain.shape[1])
            if gain[f, b] > 0:
                at = (1 << level) - 1 + node
                tree.feature[at], tree.bin[at] = f, b
                tree.gain[f] = tree.gain.get(f, 0.0) + float(gain[f, b])

    def value(self, g: np.ndarray, s: np.ndarray) -> np.ndarray:
        """A Newton step for each leaf."""
        k = len(self.labels)
        return np.where(s > 0, (k - 1) / k * g / np.maximum(s, 1), 0.0)

    def predicted(self, x: np.ndarray, before: np.ndarray, model: np.ndarray) -> np.ndarray:
        return self.margins(x, before)[np.arange(len(x)), model].argmax(axis=1)

    def importances(self) -> dict[str, float]:
        """Mean share of the gains of the last model's trees that each feature has."""
        total, trees = np.zeros(len(self.columns)), [t for turn in self.trees for t in turn[-1] if t.gain]
        for t in trees:
            whole = sum(t.gain.values())
            for f, v in t.gain.items():
                total[f] += v / whole
        return dict(zip(self.columns, (total / max(1, total.sum())).tolist(), strict=True))


_BINNED = "y int, fold int, h long, x binary"


def _arrays(batch: pa.RecordBatch, features: int):
    x = np.frombuffer(b"".join(batch.column("x").to_pylist()), np.uint8).reshape(batch.num_rows, features)
    return x, batch.column("y").to_numpy(), batch.column("fold").to_numpy()


def _kinds(x: np.ndarray, y: np.ndarray, fold: np.ndarray) -> tuple[np.ndarray, ...]:
    """Bins, class and fold of the distinct rows, and which of them each row is."""
    key = np.ascontiguousarray(np.column_stack([y.astype("<i4"), fold.astype("<i4")])).view(np.uint8).reshape(len(x), 8)
    key = np.ascontiguousarray(np.column_stack([key, x]))
    _, at, which = np.unique(key.view([("", key.dtype, key.shape[1])]).ravel(), return_index=True, return_inverse=True)
    return x[at], y[at], fold[at], which.ravel()


def binned(flat: DataFrame, model: Boosted) -> DataFrame:
    """One row a sample: class, fold, hash and a byte a feature."""
    at = model.cuts
    y = F.coalesce(*[F.when(F.col("label") == x, F.lit(k)) for k, x in enumerate(model.labels)])

    def run(batches):
        for b in batches:
            x = np.stack([np.searchsorted(np.array(at[k]), b.column(f"f{k}").to_numpy(), "left") for k in range(len(at))], axis=1).astype(np.uint8)
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in ("y", "fold", "h")], pa.array([r.tobytes() for r in x], pa.binary())], names=["y", "fold", "h", "x"])

    return written(flat.withColumn("y", y).where("y is not null").select("y", "fold", "h", *[f"f{k}" for k in range(len(at))]).mapInArrow(run, _BINNED), "binned")


def counted(table: DataFrame, model: Boosted, rounds: int) -> DataFrame:
    """One row a kind of samples, with those that take part in each of the next ``rounds``, and the margins by the trees so far."""
    features, first, names = len(model.columns), len(model.trees), [f"n{k}" for k in range(rounds)]

    def count(batches):
        for b in batches:
            if b.num_rows:
                x, y, fold, which = _kinds(*_arrays(b, features))
                h = b.column("h").to_numpy()
                times = [np.bincount(which, drawn(h, first + k, model.settings), len(x)).astype(np.int64) for k in range(rounds)]
                yield pa.RecordBatch.from_arrays([pa.array(y, pa.int32()), pa.array(fold, pa.int32()), pa.array([r.tobytes() for r in x], pa.binary()), *map(pa.array, times)], names=["y", "fold", "x", *names])

    def margins(batches):
        for b in batches:
            x, *_ = _arrays(b, features)
            flat = model.margins(x, np.zeros((len(x), model.models * len(model.labels)))).reshape(len(x), -1)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * flat.shape[1], pa.int32()), pa.array(flat.ravel()))
            yield pa.RecordBatch.from_arrays([*b.columns, lists], names=[*b.schema.names, "margins"])

    kind = "y int, fold int, x binary, " + ", ".join(f"{c} long" for c in names)
    kinds = table.mapInArrow(count, kind).groupBy("y", "fold", "x").agg(*[F.sum(c).alias(c) for c in names])
    return written(kinds.mapInArrow(margins, f"{kind}, margins array<double>"), "counted")


def _level(kinds: DataFrame, model: Boosted, growing: list[list[Tree]], level: int) -> tuple[np.ndarray, ...]:
    features, turn = len(model.columns), f"n{len(model.trees) - model.held}"

    def run(batches):
        total = None
        for b in batches:
            if b.num_rows:
                x, y, fold = _arrays(b, features)
                before = b.column("margins").flatten().to_numpy(zero_copy_only=False).reshape(len(x), -1)
                one = model.sums(x, y, fold, b.column(turn).to_numpy(), before, growing, level)
                total = one if total is None else tuple(x + y for x, y in zip(total, one, strict=True))
        if total is not None:
            at = np.flatnonzero(total[0])
            yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), *[pa.array(t.ravel()[at], pa.int64()) for t in total]], names=["at", "n", "g", "s"])

    found = kinds.select("y", "fold", "x", turn, "margins").mapInArrow(run, "at long, n long, g long, s long").groupBy("at").agg(*[F.sum(c).alias(c) for c in "ngs"]).toArrow()
    shape = (model.models, len(model.labels), 1 << level, features, BINS)
    out = tuple(np.zeros(math.prod(shape), np.int64) for _ in range(3))
    for o, c in zip(out, "ngs", strict=True):
        o[found["at"].to_numpy()] = found[c].to_numpy()
    return tuple(o.reshape(shape) for o in out)


def fit(rows: DataFrame, columns: list[str], label: str = "label", id_col: str = "task_id", folds: int = 5, settings: Settings = Settings(), at: list[list[float]] | None = None) -> tuple[Boosted, DataFrame]:
    """The models of all folds and of all rows, and the binned table; ``rows`` have a fold (``dealt``)."""
    names = [f"f{k}" for k in range(len(columns))]
    # what the passes below look at, written once
    flat = written(rows.select(F.col(label).alias("label"), "fold", F.xxhash64(F.coalesce(F.col(id_col).cast("string"), F.lit(""))).alias("h"), *[F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(f) for c, f in zip(columns, names, strict=True)]), "samples")
    labels = sorted(r[0] for r in flat.select("label").where("label is not null").distinct().collect())
    model = Boosted(list(columns), at or cuts(flat, names), labels, folds, settings)
    table, inner = binned(flat, model), (1 << settings.depth) - 1
    for turn in range(settings.rounds):
        if turn % KEPT == 0:
            model.held = 0
            kinds = counted(table, model, min(KEPT, settings.rounds - turn))
            model.held = turn
        growing = [[Tree(np.full(inner, -1), np.zeros(inner, np.int64), np.zeros(1 << settings.depth)) for _ in labels] for _ in range(model.models)]
        for level in range(settings.depth + 1):
            n, g, s = _level(kinds, model, growing, level)
            for m, of_model in enumerate(growing):
                for k, tree in enumerate(of_model):
                    if level < settings.depth:
                        model.grow(tree, level, n[m, k], g[m, k])
                    else:
                        tree.value = model.value(g[m, k, :, 0].sum(axis=1), s[m, k, :, 0].sum(axis=1))
        model.trees.append(growing)
    model.held = 0
    return model, table


def confusion(model: Boosted, table: DataFrame) -> DataFrame:
    """(fold, label, predicted, n): each row by the model that has not seen its fold; fold -1: all rows by the last model."""
    features, labels = len(model.columns), np.array(model.labels, object)

    def run(batches):
        for b in batches:
            x, y, fold, which = _kinds(*_arrays(b, features))
            n, before = np.bincount(which, minlength=len(x)), np.zeros((len(x), model.models * len(labels)))
            for of, name in ((fold, fold), (np.full(len(x), model.folds), np.full(len(x), -1))):
                yield pa.RecordBatch.from_arrays([pa.array(name, pa.int32()), pa.array(labels[y], pa.string()), pa.array(labels[model.predicted(x, before, of)], pa.string()), pa.array(n, pa.int64())], names=["fold", "label", "predicted", "n"])

    rows = table.mapInArrow(run, "fold int, label string, predicted string, n long")
    return rows.groupBy("fold", "label", "predicted").agg(F.sum("n").alias("n"))


def scores(counts: list[tuple[str, str, int]]) -> dict[str, float]:
    """Accuracy, macro and weighted F1 of (label, predicted, n)."""
    total = sum(n for *_, n in counts)
    names = sorted({x for a, b, _ in counts for x in (a, b)})
    f1, true = {}, {}
    for x in names:
        hit, true[x], said = (sum(n for a, b, n in counts if t(a, b)) for t in (lambda a, b: a == b == x, lambda a, b: a == x, lambda a, b: b == x))  # noqa: B023
        f1[x] = 2 * hit / (true[x] + said) if true[x] + said else 0.0
    right = sum(n for a, b, n in counts if a == b)
    return {"accuracy": right / total, "f1_macro": sum(f1.values()) / len(names), "f1_weighted": sum(f1[x] * true[x] for x in names) / total} if total else {"accuracy": 0.0, "f1_macro": 0.0, "f1_weighted": 0.0}


def cross_validated(rows: DataFrame, columns: list[str], label: str = "label", id_col: str = "task_id", folds: int = 5, settings: Settings = Settings()) -> dict:
    """Mean and deviation of the folds' scores, the confusion of the model of all rows, and its importances."""
    model, table = fit(dealt(rows, label, id_col, folds), columns, label, id_col, folds, settings)
    found: dict[int, list[tuple[str, str, int]]] = {}
    for r in confusion(model, table).collect():
        found.setdefault(r["fold"], []).append((r["label"], r["predicted"], r["n"]))
    each = [scores(v) for k, v in sorted(found.items()) if k >= 0]
    mean = {k: sum(e[k] for e in each) / len(each) if each else 0.0 for k in ("accuracy", "f1_macro", "f1_weighted")}
    spread = {f"{k}_std": math.sqrt(sum((e[k] - mean[k]) ** 2 for e in each) / len(each)) if each else 0.0 for k in mean}
    return {"labels": model.labels, "folds": len(each), **mean, **spread, "confusion": sorted(found.get(-1, [])), "importances": model.importances()}
