"""Parameter search: density-ratio sampling, with weak trials dropped early.

Finished trials are divided in a good quarter and the rest.  For each parameter the next
value is the one of some draws from the good trials' density that is most likelier there
than among the rest.  A trial is judged at growing cost (``rungs``) and goes on only while it
is in the best third of all that were judged at that rung, so most trials cost the least.
Everything is drawn from the seed: reruns agree.
"""

from __future__ import annotations

import math
import random
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame

from quantloom.operators.boosting import Settings, boost

#: Trials that are drawn at random first, share of the good ones, draws to choose from, share that goes on.
STARTUP, GOOD, DRAWS, KEPT = 8, 0.25, 24, 1 / 3

#: The ranges of the specified search; log ranges are sampled by their logarithm.
SPACE: dict[str, tuple[float, float, str]] = {
    "leaves": (20, 150, "int"),
    "rate": (0.01, 0.3, "log"),
    "feature_share": (0.6, 1.0, "float"),
    "row_share": (0.6, 1.0, "float"),
    "row_every": (1, 10, "int"),
    "l1": (1e-8, 10.0, "log"),
    "l2": (1e-8, 10.0, "log"),
    "least_hessian": (1e-5, 10.0, "log"),
    "least_rows": (5, 100, "int"),
    "depth": (3, 8, "int"),
}


def value_at(unit: float, low: float, high: float, kind: str) -> float | int:
    """The parameter's value at a place between 0 and 1 of its range."""
    if kind == "log":
        return min(max(math.exp(math.log(low) + unit * (math.log(high) - math.log(low))), low), high)
    if kind == "int":
        return min(int(low + unit * (high - low + 1)), int(high))
    return low + unit * (high - low)


def density(x: float, points: list[float]) -> float:
    """A uniform density and one normal kernel a point, in equal parts, each cut to 0..1."""
    width = max(1 / (1 + len(points)), 0.05)
    spread = math.sqrt(2) * width
    total = 1.0
    for p in points:
        inside = (math.erf((1 - p) / spread) - math.erf(-p / spread)) / 2
        total += math.exp(-((x - p) ** 2) / (2 * width**2)) / (width * math.sqrt(2 * math.pi) * inside)
    return total / (1 + len(points))


def draw(points: list[float], rng: random.Random) -> float:
    """A draw from density(): a kernel or the uniform one, again until it lies in 0..1."""
    at = rng.randrange(len(points) + 1)
    if at == len(points):
        return rng.random()
    width = max(1 / (1 + len(points)), 0.05)
    while not 0 <= (x := rng.gauss(points[at], width)) <= 1:
        pass
    return x


@dataclass
class Trial:
    """Places of the parameters, their values, and the results by rung."""

    places: dict[str, float]
    params: dict[str, float | int]
    values: list[float] = field(default_factory=list)


def suggest(history: list[Trial], space: dict, rng: random.Random) -> dict[str, float]:
    """Places of the next trial.  Trials that came further count as better than those dropped before."""
    if len(history) < STARTUP:
        return {name: rng.random() for name in space}
    ordered = sorted(history, key=lambda t: (-len(t.values), -t.values[-1]))
    cut = max(1, math.ceil(GOOD * len(ordered)))
    out = {}
    for name in space:
        good, bad = ([t.places[name] for t in part] for part in (ordered[:cut], ordered[cut:]))
        out[name] = max((draw(good, rng) for _ in range(DRAWS)), key=lambda x: density(x, good) / density(x, bad))  # noqa: B023
    return out


def search(objective: Callable[[dict, int], float], rungs: int, trials: int, space: dict | None = None, seed: int = 42) -> list[Trial]:
    """The trials, the best first; ``objective`` takes parameters and a rung from 0, greater results are better."""
    space, rng, history = space or SPACE, random.Random(seed), []
    for _ in range(trials):
        places = suggest(history, space, rng)
        trial = Trial(places, {name: value_at(places[name], *space[name]) for name in space})
        for rung in range(rungs):
            trial.values.append(objective(trial.params, rung))
            rivals = sorted((t.values[rung] for t in history if len(t.values) > rung), reverse=True)
            place = sum(v >= trial.values[rung] for v in rivals)
            if rivals and place >= max(1, math.ceil(KEPT * (len(rivals) + 1))):
                break
        history.append(trial)
    return sorted(history, key=lambda t: (-len(t.values), -t.values[-1]))


def tune(pairs: list[tuple[DataFrame, DataFrame]], features: list[str], trials: int = 30, rounds: tuple[int, ...] = (5, 50, 500), patience: int = 30, judged_at: int = 5, seed: int = 42) -> list[Trial]:
    """Searches the booster's parameters; a rung has more rounds, and all (train, val) pairs only from the second on."""

    def objective(params: dict, rung: int) -> float:
        folds = pairs[: 1 if rung == 0 else len(pairs)]
        found = [boost(past, coming, features, Settings(rounds=rounds[rung], patience=patience, judged_at=judged_at, seed=seed, **params)) for past, coming in folds]
        return sum(max(x.history, default=0.0) for x in found) / len(found)

    return search(objective, len(rounds), trials, seed=seed)
