"""Paired statistics: intervals in closed form, exact tails and seeded resampling in Python integers."""

from __future__ import annotations

import math
import random
from statistics import NormalDist

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from loomtrace.functions.running import at_ranks

#: Words that a resampling takes at once.
DRAWN = 1 << 19


def quantile_of_normal(conf: float) -> float:
    return NormalDist().inv_cdf(1 - (1 - conf) / 2)


def wilson(successes: Column, n: Column, conf: float = 0.95, z: float | None = None) -> Column:
    """struct(lo, hi): the Wilson score interval; (0, 1) for no trials."""
    z = quantile_of_normal(conf) if z is None else z
    p = successes / n
    base = 1 + z * z / n
    middle = (p + z * z / (2 * n)) / base
    half = z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n)) / base
    lo, hi = F.greatest(F.lit(0.0), middle - half), F.least(F.lit(1.0), middle + half)
    return F.struct(F.when(n > 0, lo).otherwise(0.0).alias("lo"), F.when(n > 0, hi).otherwise(1.0).alias("hi"))


def mcnemar_p(b: int, c: int) -> float:
    """Exact two-sided p of discordant counts, in integers."""
    n, low, term, total = b + c, min(b, c), 1, 0
    for k in range(low + 1):
        total += term
        term = term * (n - k) // (k + 1)
    return min(1.0, 2 * (total / (1 << n))) if n else 1.0


@F.pandas_udf(DoubleType())
def mcnemar(b: pd.Series, c: pd.Series) -> pd.Series:
    return pd.Series([mcnemar_p(int(x), int(y)) for x, y in zip(b, c, strict=True)])


def _words(state: bytes) -> np.random.MT19937:
    """A generator of 32-bit words from its 624 numbers and the place in them."""
    words, numbers = np.random.MT19937(), np.frombuffer(state, np.uint32)
    words.state = {"bit_generator": "MT19937", "state": {"key": numbers[:-1], "pos": int(numbers[-1])}}
    return words


def _accepted(words: np.random.MT19937, n: int, many: int) -> np.ndarray:
    """Places below n from the next ``many`` words, as ``random.randrange(n)`` has them: the top bits, values from n on passed over."""
    fresh = (words.random_raw(many) >> np.uint64(32 - n.bit_length())).astype(np.int64)
    return fresh[fresh < n]


def shares(n: int, n_iter: int, seed: int, parts: int) -> list[tuple[bytes, int, int]]:
    """Where each of ``parts`` shares of n_iter resamples of n items begins in the stream of ``random.Random(seed)``.

    (state of the generator, accepted places to pass over from there, resamples of the share). The stream is
    run through once, without looking anything up: how many words a share takes depends on those passed over.
    """
    _, state, _ = random.Random(seed).getstate()
    words = _words(np.array(state, np.uint32).tobytes())
    per = -(-n_iter // parts)
    begins = [k * per for k in range(parts) if k * per < n_iter]
    out: list[tuple[bytes, int, int]] = []
    seen = 0
    while len(out) < len(begins):
        held = words.state["state"]
        before = np.append(held["key"].astype(np.uint32), np.uint32(held["pos"])).tobytes()
        found = len(_accepted(words, n, DRAWN))
        while len(out) < len(begins) and begins[len(out)] * n < seen + found:
            k = begins[len(out)]
            out.append((before, k * n - seen, min(per, n_iter - k)))
        seen += found
    return out


def draws(n: int, share: tuple[bytes, int, int]):
    """The rows of n places of a share, in blocks."""
    state, skip, left = share
    words, rest, rows = _words(state), np.zeros(0, np.int64), max(1, DRAWN // n)
    while left:
        rows = min(rows, left)
        while len(rest) < skip + rows * n:
            rest = np.concatenate([rest, _accepted(words, n, DRAWN)])
        yield rest[skip : skip + rows * n].reshape(rows, n)
        rest, skip, left = rest[skip + rows * n :], 0, left - rows


def resampled(outcomes: np.ndarray, share: tuple[bytes, int, int]) -> np.ndarray:
    """Differences of the two accuracies in the resamples of a share; an outcome is a's bit and twice b's."""
    n = len(outcomes)
    a, b = (outcomes & 1).astype(np.int64), (outcomes >> 1).astype(np.int64)
    return np.concatenate([a[at].sum(axis=1) / n - b[at].sum(axis=1) / n for at in draws(n, share)])


def interval(point: float, drawn: np.ndarray, counts: np.ndarray, conf: float = 0.95) -> dict[str, float]:
    """Percentile interval and two-sided p from distinct differences in order and their counts."""
    upto, n_iter, tail = np.cumsum(counts), int(counts.sum()), (1 - conf) / 2
    at = lambda k: float(drawn[np.searchsorted(upto, k, "right")])
    beyond = int(counts[drawn <= 0].sum()) if point > 0 else int(counts[drawn >= 0].sum()) if point < 0 else 0
    return {"delta_acc": point, "ci_lo": at(max(0, int(tail * n_iter))), "ci_hi": at(min(n_iter - 1, int((1 - tail) * n_iter))), "p_two_sided": min(1.0, 2 * (beyond + 1) / (n_iter + 1))}


def bootstrap(a: list[bool], b: list[bool], n_iter: int = 10_000, conf: float = 0.95, seed: int = 0) -> dict[str, float]:
    """Resampled difference of two paired accuracies: percentile interval and two-sided p."""
    n = len(a)
    if not n:
        return {"delta_acc": 0.0, "ci_lo": 0.0, "ci_hi": 0.0, "p_two_sided": 1.0}
    outcomes = np.array([int(x) | int(y) << 1 for x, y in zip(a, b, strict=True)], np.uint8)
    drawn, counts = np.unique(resampled(outcomes, shares(n, n_iter, seed, 1)[0]), return_counts=True)
    return interval(sum(map(int, a)) / n - sum(map(int, b)) / n, drawn, counts, conf)


#: Places that one task of a resampling draws, and the most tasks of a comparison.
SHARE, TASKS = 1 << 26, 256


def paired_bootstrap(pairs: DataFrame, key: str, order: str, a: str, b: str, n_iter: int = 10_000, seed: int = 0, conf: float = 0.95, share: int = SHARE) -> DataFrame:
    """One row a key: the interval that one generator gives, drawn by as many tasks as there are shares of its stream.

    A comparison's outcomes are packed a byte an item in ``order`` and go to each of its tasks; tasks give
    counts of distinct differences, at most n_iter a key, from which the percentiles are read. Null outcomes
    count as wrong.
    """
    kind = pairs.schema[key].dataType.simpleString()
    bit = lambda c: F.coalesce(F.col(c).cast("boolean"), F.lit(False)).cast("int")

    def pack(g: pa.Table) -> pa.Table:
        g = g.take(pc.sort_indices(g, sort_keys=[("_o", "ascending")], null_placement="at_start"))
        outcomes = g["_x"].to_numpy().astype(np.uint8)
        n = len(outcomes)
        found = shares(n, n_iter, seed, max(1, min(TASKS, -(-n * n_iter // share))))
        at = g["_k"].combine_chunks().take(pa.array([0] * len(found)))
        states, skips, rows = zip(*found, strict=True)
        columns = [at, pa.array([outcomes.tobytes()] * len(found), pa.binary()), pa.array(range(len(found)), pa.int32()), pa.array(states, pa.binary()), pa.array(skips, pa.int64()), pa.array(rows, pa.int64())]
        return pa.Table.from_arrays(columns, names=["_k", "outcomes", "part", "state", "skip", "rows"])

    def draw(batches):
        for batch in batches:
            for k in range(batch.num_rows):
                one = batch.slice(k, 1)
                r = one.drop_columns(["_k"]).to_pylist()[0]
                outcomes = np.frombuffer(r["outcomes"], np.uint8)
                drawn, counts = np.unique(resampled(outcomes, (r["state"], r["skip"], r["rows"])), return_counts=True)
                n, n_a, n_b = len(outcomes), int((outcomes & 1).sum()), int((outcomes >> 1).sum())
                fixed = [pa.array(np.full(len(drawn), x), pa.int64()) for x in (n, n_a, n_b)]
                yield pa.RecordBatch.from_arrays([one.column("_k").take(pa.array([0] * len(drawn))), *fixed, pa.array(drawn, pa.float64()), pa.array(counts, pa.int64())], names=["_k", "n", "n_a", "n_b", "delta", "times"])

    def merge(g: pa.Table) -> pa.Table:
        n, n_a, n_b = (g[c][0].as_py() for c in ("n", "n_a", "n_b"))
        g = g.sort_by("delta")
        found = interval(n_a / n - n_b / n, g["delta"].to_numpy(), g["times"].to_numpy(), conf)
        return pa.Table.from_arrays([g["_k"].combine_chunks().slice(0, 1), pa.array([n], pa.int64()), *[pa.array([v], pa.float64()) for v in found.values()]], names=["_k", "n", *found])

    packed = pairs.select(F.col(key).alias("_k"), F.col(order).alias("_o"), (bit(a) + 2 * bit(b)).alias("_x")).groupBy("_k").applyInArrow(pack, f"_k {kind}, outcomes binary, part int, state binary, skip long, rows long")
    drawn = packed.repartition("_k", "part").mapInArrow(draw, f"_k {kind}, n long, n_a long, n_b long, delta double, times long")
    drawn = drawn.groupBy("_k", "n", "n_a", "n_b", "delta").agg(F.sum("times").alias("times"))
    return drawn.groupBy("_k").applyInArrow(merge, f"_k {kind}, n long, delta_acc double, ci_lo double, ci_hi double, p_two_sided double").withColumnRenamed("_k", key)


def paired_outcomes(n: int, p_a: float, p_b: float, rho: float, seed: int) -> tuple[list[bool], list[bool]]:
    """Two outcomes an item with the given accuracies: one Gaussian in common, one each of their own, cut at their quantiles."""
    rng = np.random.default_rng(seed)
    common, own_a, own_b = (rng.normal(size=n) for _ in range(3))
    w, v = (rho**0.5, (1 - rho) ** 0.5) if rho > 0 else (0.0, 1.0)
    return tuple((w * common + v * own > NormalDist().inv_cdf(1 - p)).tolist() for own, p in ((own_a, p_a), (own_b, p_b)))


def self_test(spark: SparkSession, n: int, p_a: float, p_b: float, rho: float = 0.5, seeds: int = 20, n_iter: int = 2000) -> DataFrame:
    """A row a seed: discordant counts, exact p and the resampled interval of generated outcomes; each seed is a task's row."""

    def run(frames):
        for f in frames:
            rows = []
            for seed in f["seed"]:
                a, b = paired_outcomes(n, p_a, p_b, rho, int(seed))
                only_b, only_a = sum(y and not x for x, y in zip(a, b)), sum(x and not y for x, y in zip(a, b))
                found = bootstrap(a, b, n_iter, seed=int(seed))
                rows.append((int(seed), sum(a), sum(b), only_b, only_a, mcnemar_p(only_b, only_a), found["delta_acc"], found["ci_lo"], found["ci_hi"]))
            yield pd.DataFrame(rows, columns=["seed", "n_a", "n_b", "b", "c", "p", "delta", "ci_lo", "ci_hi"])

    return spark.range(seeds).withColumnRenamed("id", "seed").repartition(max(1, min(seeds, 64))).mapInPandas(run, "seed long, n_a long, n_b long, b long, c long, p double, delta double, ci_lo double, ci_hi double")


def self_test_summary(rows: DataFrame) -> DataFrame:
    return rows.agg(F.count(F.lit(1)).alias("n_seeds"), F.count_if(F.col("p") < 0.05).alias("n_significant"), F.count_if((F.col("ci_lo") > 0) | (F.col("ci_hi") < 0)).alias("n_ci_excludes_zero"), F.median("p").alias("median_p"), F.avg("p").alias("mean_p"))


def n_for_power(delta: float, power: float = 0.8, alpha: float = 0.05) -> int:
    z = NormalDist().inv_cdf(1 - alpha / 2) + NormalDist().inv_cdf(power)
    return math.ceil((z * 0.5 / delta) ** 2)


def conformal(df: DataFrame, key: str, error: str, alpha: float = 0.1) -> DataFrame:
    """Per key: the conformal quantile of absolute errors and the interval's width (0 below two errors)."""
    at = F.least(F.ceil((F.col("n") + 1) * (1 - alpha)) / F.col("n"), F.lit(1.0)) * (F.col("n") - 1)
    found = at_ranks(df, [key], error, {"low": F.floor(at), "high": F.ceil(at)})
    q = F.when(F.col("n") >= 2, F.col("low") + (F.col("high") - F.col("low")) * (at - F.floor(at))).otherwise(0.0)
    return found.select(key, "n", q.alias("quantile"), (2 * q).alias("width"))


def geometric_mean(values: Column) -> Column:
    """Of an array's non-null numbers: 0 if one is not positive, null if there are none."""
    known = F.array_compact(values)
    logs = F.aggregate(known, F.lit(0.0), lambda s, x: s + F.ln(x))
    return F.when(F.size(known) == 0, F.lit(None).cast("double")).when(F.exists(known, lambda x: x <= 0), 0.0).otherwise(F.exp(logs / F.size(known)))
