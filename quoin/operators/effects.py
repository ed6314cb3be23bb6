"""Effects on page images by description: which effects a page gets, drawn as expressions, and their application.

A description is a set of phases (`pixels.effects_errors` says what may be in one): effects with a name, a chance p and
parameters, or a choice of some. What is drawn depends on the seed, the page's key and the effect's place in the description
alone. Effects themselves are plug-ins, named in a registry.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Callable

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

from quoin.operators.pixels import drawn, effects_errors

#: Phases in the order in which they are carried out. Fixed values.
PHASES = ["ink", "paper", "post"]
STEP = "struct<phase:string,effect:string,params:string>"
#: An effect: (pixels, its parameters, a generator of random numbers of its own) -> pixels.
Registry = dict[str, Callable[[np.ndarray, dict, np.random.Generator], np.ndarray]]


def names(spec: dict) -> set[str]:
    """Names of all effects in a description, or in a part of one."""
    if "name" in spec:
        return {spec["name"]}
    parts = spec["one_of"] if "one_of" in spec else [s for phase in spec.values() for s in phase]
    return set().union(*map(names, parts)) if parts else set()


def problems(effects: dict, registry: Registry) -> list[str]:
    """What is wrong with a description, names that the registry lacks included."""
    return effects_errors(effects) or [f"no effect is called {n}" for n in sorted(names(effects) - set(registry))]


def effect_steps(effects: dict, seed: int, *key: Column) -> Column:
    """array of STEP: what a page with this key gets, in order."""

    def one(spec: dict, phase: str, place: str) -> Column:
        if "name" in spec:
            params = json.dumps(spec.get("params") or {}, sort_keys=True, ensure_ascii=False)
            return F.struct(F.lit(phase).alias("phase"), F.lit(spec["name"]).alias("effect"), F.lit(params).alias("params")).cast(STEP)
        pick = F.pmod(drawn(seed, *key, F.lit(f"{place}/one")), F.lit(len(spec["one_of"])))
        found = F.lit(None).cast(STEP)
        for k, child in enumerate(spec["one_of"]):
            found = F.when(pick == k, one(child, phase, f"{place}/{k}")).otherwise(found)
        return found

    steps = []
    for phase in PHASES:
        for i, spec in enumerate(effects.get(phase, [])):
            place = f"{phase}/{i}"
            met = drawn(seed, *key, F.lit(f"{place}/p")) < F.lit(int(spec.get("p", 1.0) * (1 << 32)))
            steps.append(F.when(met, one(spec, phase, place)))
    return F.filter(F.array(*steps), lambda s: s.isNotNull()) if steps else F.array().cast(f"array<{STEP}>")


def apply_steps(pixels: np.ndarray, steps: list, registry: Registry, seed: int) -> np.ndarray:
    """pixels after all steps (phase, effect, params), each with a generator of its own; in a worker. Pixels without channels
    get them back."""
    for k, step in enumerate(steps):
        rng = np.random.default_rng([seed, k, zlib.crc32(step["effect"].encode())])
        if step["effect"] not in registry:
            raise LookupError(f"no effect is called {step['effect']}")
        out = np.asarray(registry[step["effect"]](pixels, json.loads(step["params"]), rng))
        pixels = np.repeat(out[:, :, None], pixels.shape[2], axis=2) if out.ndim == 2 and pixels.ndim == 3 else out
    return pixels
