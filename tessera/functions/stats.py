"""Columns over an array of logits, probabilities or values (``array<double>``); all stay in the JVM."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

EPSILON = 1e-12
TEMPERATURE = 1.5


def let(value: Column, of: Callable[[Column], Column]) -> Column:
    """``of`` over a value that is computed once: what a lambda has from outside it would be computed anew for each element."""
    return F.get(F.transform(F.array(value), of), F.lit(0))


def total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda acc, x: acc + x)


def mean(values: Column) -> Column:
    return total(values) / F.size(values)


def squares(values: Column, center: Column) -> Column:
    return let(center, lambda c: F.aggregate(values, F.lit(0.0), lambda acc, x: acc + (x - c) * (x - c)))


def std_pop(values: Column) -> Column:
    return F.sqrt(squares(values, mean(values)) / F.size(values))


def var_samp(values: Column) -> Column:
    return F.when(F.size(values) > 1, squares(values, mean(values)) / (F.size(values) - 1))


def std_samp(values: Column) -> Column:
    return F.sqrt(var_samp(values))


def norm2(values: Column) -> Column:
    return F.sqrt(squares(values, F.lit(0.0)))


def exponentials(logits: Column, temperature: float = 1.0) -> Column:
    scaled = F.transform(logits, lambda x: x / F.lit(temperature)) if temperature != 1.0 else logits
    return let(scaled, lambda s: let(F.array_max(s), lambda top: F.transform(s, lambda x: F.exp(x - top))))


def softmax(logits: Column, temperature: float = 1.0) -> Column:
    return let(exponentials(logits, temperature), lambda e: let(total(e), lambda s: F.transform(e, lambda x: x / s)))


def logsumexp(logits: Column) -> Column:
    return let(F.array_max(logits), lambda top: top + F.log(F.aggregate(logits, F.lit(0.0), lambda acc, x: acc + F.exp(x - top))))


def entropy(probs: Column) -> Column:
    """In nats, of the probabilities with EPSILON added and their sum made 1 again."""
    shifted = F.transform(probs, lambda p: p + EPSILON)
    return let(shifted, lambda q: let(total(q), lambda s: -F.aggregate(q, F.lit(0.0), lambda acc, p: acc + p / s * F.log(p / s))))


def normalised_entropy(probs: Column) -> Column:
    return entropy(probs) / F.log(F.size(probs).cast("double"))


def top_mass(probs: Column, k: int = 5) -> Column:
    return total(F.slice(F.sort_array(probs, asc=False), 1, k))


def margin(probs: Column) -> Column:
    return let(F.sort_array(probs, asc=False), lambda best: F.get(best, F.lit(0)) - F.get(best, F.lit(1)))


def surprisal(logits: Column, target: Column) -> Column:
    """Minus the logarithm of the softmax at ``target``, counted from 0."""
    return logsumexp(logits) - F.element_at(logits, target.cast("int") + 1)


#: Ways to measure confidence, each a set of named columns over logits and their softmax.
CONFIDENCE = {
    "max_prob": lambda x, p: {"max_prob": F.array_max(p)},
    "entropy": lambda x, p: {"entropy": entropy(p), "normalised_entropy": normalised_entropy(p)},
    "top_k": lambda x, p: {"top_5_prob_sum": top_mass(p, 5), "top_1_prob": F.array_max(p)},
    "margin": lambda x, p: {"margin": margin(p)},
    "temperature_scaled": lambda x, p: {"temperature_scaled_max": F.array_max(softmax(x, TEMPERATURE))},
    "variance": lambda x, p: {"prob_variance": var_samp(p), "prob_std": std_samp(p)},
}


def confidence(logits: Column, probs: Column, method: str = "all") -> dict[str, Column]:
    """The columns of one method, or of all."""
    if method != "all" and method not in CONFIDENCE:
        raise ValueError(f"method must be one of {['all', *CONFIDENCE]}")
    out: dict[str, Column] = {}
    for name, of in CONFIDENCE.items():
        out |= of(logits, probs) if method in ("all", name) else {}
    return out


def confidence_level(max_prob: Column) -> Column:
    return F.when(max_prob > 0.8, "high").when(max_prob > 0.5, "medium").otherwise("low")


def model_size(parameters: Column) -> Column:
    """B, M or K to one decimal; below a thousand as it is."""
    scaled = lambda unit, name: F.concat(F.format_string("%.1f", parameters / F.lit(unit)), F.lit(name))
    return F.when(parameters >= 1e9, scaled(1e9, "B")).when(parameters >= 1e6, scaled(1e6, "M")).when(parameters >= 1e3, scaled(1e3, "K")).otherwise(parameters.cast("long").cast("string"))


def memory_mb(parameters: Column, batch: Column, sequence: Column, hidden: Column, layers: Column) -> dict[str, Column]:
    """MB of four-byte parameters, and of activations counted twice a layer."""
    params = parameters * 4 / F.lit(1024.0 * 1024)
    activations = batch.cast("double") * sequence * hidden * layers * 4 * 2 / F.lit(1024.0 * 1024)
    return {"params_mb": params, "activations_mb": activations, "total_mb": params + activations}


def parsed_layers(spec: str | Iterable[int], count: int | None = None) -> list[int]:
    """Layer numbers from "0-5,8,-1" or a list: distinct and sorted; with ``count``, negative ones count from the end and others out of range go."""
    parts = [p.strip() for p in spec.split(",")] if isinstance(spec, str) else [str(p) for p in spec]
    found: set[int] = set()
    for part in filter(None, parts):
        low, dash, high = part[1:].partition("-")
        found.update(range(int(part[0] + low), int(high) + 1) if dash else [int(part)])
    if count is not None:
        found = {k + count if k < 0 else k for k in found}
        found = {k for k in found if 0 <= k < count}
    return sorted(found)
