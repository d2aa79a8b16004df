"""Search for parameters of a forecast on a held-out window, within a budget of time."""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable
from concurrent.futures import Future, ThreadPoolExecutor, wait
from dataclasses import dataclass, field

import numpy as np
from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leadtide.operators.models import PRODUCTION, Spec, gbt_spec

#: Ranges of the boosted trees' parameters; fixed values. A range is (low, high, kind).
TREES = {"step": (0.02, 0.12, "log"), "leaves": (31, 255, "log int"), "least": (10, 80, "int"), "columns": (0.6, 1.0, "float"), "rows": (0.6, 1.0, "float")}
#: Rows with an actual value that a window needs; fixed value.
LEAST = 30


@dataclass(frozen=True)
class Trial:
    """One fit: its number, the rung and budget it ran with, its WAPE or why it has none."""

    trial: int
    rung: int
    budget: int
    params: dict
    wape: float | None
    reason: str | None = None


@dataclass(frozen=True)
class Found:
    """What a search came to: the defaults, unless something beat them. reason: why it ended as it did."""

    params: dict
    wape: float | None
    default_wape: float | None
    improved: bool
    reason: str
    trials: list[Trial] = field(default_factory=list)


def drawn(space: dict[str, tuple[float, float, str]], size: int, seed: int = 42) -> list[dict]:
    """Points of a space; the same for the same seed."""
    rng = np.random.default_rng(seed)
    out = []
    for _ in range(size):
        point = {}
        for name, (low, high, kind) in space.items():
            u = rng.random()
            x = float(np.exp(np.log(low) + u * np.log(high / low))) if "log" in kind else low + u * (high - low)
            point[name] = int(round(x)) if "int" in kind else x
        out.append(point)
    return out


def time_split(frame: DataFrame, day: str, days: int) -> tuple[DataFrame, DataFrame]:
    """Rows before the last ``days`` days of the frame, and rows of those days."""
    last = frame.agg(F.max(day)).first()[0]
    edge = F.date_sub(F.lit(last).cast("date"), days)
    return frame.filter(F.col(day) <= edge), frame.filter(F.col(day) > edge)


def _wape(spec: Spec, lessons: DataFrame, held: DataFrame, keys: list[str], actual: str) -> float | None:
    told = spec(lessons, held.drop(actual)).select(*keys, F.col("prediction").cast("double").alias("_p"))
    rows = held.select(*keys, F.col(actual).cast("double").alias("_a")).filter("_a IS NOT NULL AND NOT isnan(_a)").join(told, keys, "left")
    # A row without a prediction makes the score null: a trial isn't rewarded for leaving rows out.
    off = F.sum(F.when(F.col("_p").isNull(), F.lit(float("nan"))).otherwise(F.abs(F.col("_a") - F.col("_p"))))
    value = rows.agg(F.try_divide(off, F.sum(F.abs("_a")))).first()[0]
    return value if value is not None and np.isfinite(value) else None


def halving(
    make: Callable[[dict, int], Spec], candidates: list[dict], defaults: dict, lessons: DataFrame, held: DataFrame, keys: list[str], actual: str = "actual",
    budgets: tuple[int, ...] = (25, 100, 400), keep: int = 2, minutes: float = 20.0, at_once: int = 3,
) -> Found:
    """Successive halving: all candidates with the least budget, of each rung the best 1/``keep`` with the next.

    make(params, budget): the spec of a trial (a budget may be trees, or folds to learn from). The defaults
    are scored first, with the largest budget. Trials of a rung run ``at_once`` together as concurrent jobs. When the minutes
    are over, jobs that still run are cancelled and the best of the last rung with a result is taken. A
    trial that fails, predicts not every row or nothing finite drops out; ties go to the earlier candidate.
    lessons and held should be written tables: every trial reads them.
    """
    session = held.sparkSession
    context, tag = session.sparkContext, f"search-{uuid.uuid4().hex}"
    end = time.monotonic() + minutes * 60
    if held.filter(F.col(actual).isNotNull()).limit(LEAST).count() < LEAST:
        return Found(defaults, None, None, False, f"fewer than {LEAST} rows to score against")

    def run(number: int, rung: int, params: dict) -> Trial:
        context.addJobTag(tag)
        try:
            value = _wape(make(params, budgets[rung]), lessons, held, keys, actual)
            return Trial(number, rung, budgets[rung], params, value, None if value is not None else "no finite score")
        except Exception as e:  # noqa: BLE001  one bad trial doesn't end the search
            return Trial(number, rung, budgets[rung], params, None, f"{type(e).__name__}: {e}"[:500])
        finally:
            context.removeJobTag(tag)

    trials: list[Trial] = []
    pool = ThreadPoolExecutor(at_once)

    def rung_of(rung: int, points: list[tuple[int, dict]]) -> tuple[list[Trial], bool]:
        """Trials that ended in time, and whether all did."""
        going: list[Future] = [pool.submit(inheritable_thread_target(session)(run), n, rung, p) for n, p in points]
        done, late = wait(going, timeout=max(0.0, end - time.monotonic()))
        found = sorted((f.result() for f in done), key=lambda t: t.trial)
        trials.extend(found)
        return found, not late

    try:
        base, in_time = rung_of(len(budgets) - 1, [(0, defaults)])
        default = base[0].wape if base else None
        if default is None:
            why = "out of time before the defaults were scored" if not in_time else f"the defaults could not be scored: {base[0].reason}"
            return Found(defaults, None, None, False, why, trials)
        points, best = [(i, {**defaults, **c}) for i, c in enumerate(candidates, 1)], None
        for rung in range(len(budgets)):
            found, in_time = rung_of(rung, points)
            good = sorted((t for t in found if t.wape is not None), key=lambda t: (t.wape, t.trial))
            if good and (in_time or best is None):
                best = good[0]
            if not in_time or not good:
                break
            points = [(t.trial, t.params) for t in good[: max(1, len(good) // keep)]]
        late = "" if in_time else f"out of time after {minutes:g} minutes; "
        if best is None:
            return Found(defaults, default, default, False, late + "no trial has a score", trials)
        if best.wape < default:
            return Found(best.params, best.wape, default, True, late + f"trial {best.trial} with budget {best.budget}", trials)
        return Found(defaults, default, default, False, late + "nothing beat the defaults", trials)
    finally:
        context.cancelJobsWithTag(tag)
        pool.shutdown(wait=False, cancel_futures=True)


def tuned_trees(lessons: DataFrame, held: DataFrame, keys: list[str], actual: str = "actual", size: int = 12, seed: int = 42, **options) -> Found:
    """The search over the boosted trees' ranges; the budget is the number of trees."""
    make = lambda params, trees: gbt_spec(**{**params, "trees": trees})
    return halving(make, drawn(TREES, size, seed), PRODUCTION, lessons, held, keys, actual, **options)
