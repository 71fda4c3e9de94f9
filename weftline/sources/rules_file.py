"""Architecture rules from TOML: [[layer]] name and globs, [[rule]] forbid = [from, to], [thresholds] max_cycles, max_instability."""

from __future__ import annotations

import tomllib
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from weftline.functions.text import glob_regex


@dataclass(frozen=True)
class Rules:
    layers: tuple[tuple[str, str], ...] = ()
    forbidden: tuple[tuple[str, str], ...] = ()
    max_cycles: int = 0
    max_instability: float | None = None

    def forbidden_table(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(list(self.forbidden), "from_layer string, to_layer string")


def parse(text: str) -> Rules:
    """ValueError for text that isn't TOML, a layer without name or globs, or a rule on a layer that isn't there."""
    try:
        data = tomllib.loads(text)
    except tomllib.TOMLDecodeError as e:
        raise ValueError(f"bad rules: {e}") from e
    layers = []
    for layer in data.get("layer", []):
        globs = layer.get("globs", layer.get("paths", layer.get("path")))
        if "name" not in layer or not globs:
            raise ValueError("a layer needs a name and globs")
        for g in [globs] if isinstance(globs, str) else globs:
            glob_regex(g)
            layers.append((layer["name"], g))
    names = {n for n, _ in layers}
    forbidden = []
    for rule in data.get("rule", []):
        pair = rule.get("forbid")
        pair = [pair["from"], pair["to"]] if isinstance(pair, dict) else pair
        if not pair or len(pair) != 2 or not set(pair) <= names:
            raise ValueError("a rule forbids one declared layer to depend on another")
        forbidden.append(tuple(pair))
    limits = data.get("thresholds", {})
    return Rules(tuple(layers), tuple(forbidden), int(limits.get("max_cycles", 0)), limits.get("max_instability"))
