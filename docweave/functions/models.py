"""Token limits: which requests are too large, and which model could take them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schema import DEFAULT_MODEL, MODELS


def over_budget(tokens: Column, model: str = DEFAULT_MODEL) -> Column:
    return tokens > F.lit(dict(MODELS)[model])


def route_model(tokens: Column, models: list[tuple[str, int]] = MODELS) -> Column:
    """The model with the smallest limit that still holds ``tokens``; NULL if none does."""
    chosen = F.lit(None).cast("string")
    for name, limit in sorted(models, key=lambda model: -model[1]):
        chosen = F.when(tokens <= limit, F.lit(name)).otherwise(chosen)
    return chosen
