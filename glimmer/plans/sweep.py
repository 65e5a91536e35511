"""Grids of configurations as frames."""

from __future__ import annotations

import hashlib
import itertools
import json
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def flat(config: dict, prefix: str = "") -> dict[str, object]:
    """A nested config with dotted keys."""
    out: dict[str, object] = {}
    for k, v in config.items():
        out |= flat(v, f"{prefix}{k}.") if isinstance(v, dict) else {f"{prefix}{k}": v}
    return out


def nested(config: dict[str, object]) -> dict:
    """A config with dotted keys as nested again."""
    out: dict = {}
    for key, value in config.items():
        *path, last = key.split(".")
        at = out
        for part in path:
            at = at.setdefault(part, {})
        at[last] = value
    return out


def expand(config: dict) -> list[dict]:
    """All combinations of a config whose values may be lists of choices, at any depth; keys in their order."""
    fields = flat(config)
    choices = [v if isinstance(v, list) else [v] for v in fields.values()]
    return [nested(dict(zip(fields, picked, strict=True))) for picked in itertools.product(*choices)]


def merged(default: dict, sweep: dict, command: dict) -> tuple[dict, list[str]]:
    """command over sweep over default, key by key; and the keys that default does not know, as messages."""
    base, over, top = flat(default), flat(sweep), flat(command)
    errors = [f"unknown key {k}" for k in (*over, *top) if k not in base]
    return nested({k: top.get(k, over.get(k, v)) for k, v in base.items()}), errors


def with_seeds(configs: Iterable[dict], key: str = "seed") -> list[dict]:
    """Configs whose seeds count up from their own."""
    return [nested(flat(c) | {key: int(flat(c).get(key, 0)) + i}) for i, c in enumerate(configs)]


def differing(default: dict, config: dict) -> dict[str, object]:
    """The dotted keys of config whose values are not the default's."""
    base = flat(default)
    return {k: v for k, v in flat(config).items() if k not in base or base[k] != v}


def grid(spark: SparkSession, **choices: list) -> DataFrame:
    """A frame of all combinations, by cross joins of the choices."""
    out = None
    for name, values in choices.items():
        side = spark.createDataFrame([(v,) for v in values], [name])
        out = side if out is None else out.crossJoin(side)  # the cross is what is asked for
    return out


def groups(configs: DataFrame, by: list[str], cap: int, order: list[str]) -> DataFrame:
    """configs with group_key (of the columns that must agree) and batch: at most `cap` of a group run together."""
    key = F.substring(F.sha2(F.concat_ws("|", *(F.coalesce(F.col(c).cast("string"), F.lit("null")) for c in sorted(by))), 256), 1, 8)
    w = Window.partitionBy("group_key").orderBy(*order)
    return configs.withColumn("group_key", key).withColumn("batch", F.floor((F.row_number().over(w) - 1) / cap).cast("long"))


def identity(config: dict) -> str:
    """Eight digits that do not depend on the order of keys."""
    return hashlib.sha256(json.dumps(flat(config), sort_keys=True).encode()).hexdigest()[:8]


#: The fields that only a shuffled scan has.
SHUFFLE_ONLY = ("seed", "buffer", "workers")


def ordered(config: dict) -> dict:
    """The configuration of the ordered scan over the same data as a shuffled one."""
    return {k: v for k, v in config.items() if k not in SHUFFLE_ONLY}


def merged_maps(default: Column, over: Column, top: Column) -> tuple[Column, Column]:
    """merged() for maps of dotted keys in columns: top over `over` over default, key by key; and the sorted keys that
    default does not know."""
    config = F.transform_values(default, lambda k, v: F.coalesce(F.try_element_at(top, k), F.try_element_at(over, k), v))
    unknown = F.array_sort(F.array_except(F.array_union(F.map_keys(over), F.map_keys(top)), F.map_keys(default)))
    return config, unknown


def changed_fields(configs: DataFrame, key: str, default: dict[str, object]) -> DataFrame:
    """(key, field, value) of the fields of each row of configs that are not the default's; fields are columns."""
    fields = [F.when(~F.col(f"`{c}`").eqNullSafe(F.lit(v)), F.struct(F.lit(c).alias("field"), F.col(f"`{c}`").cast("string").alias("value"))) for c, v in default.items()]
    return configs.select(key, F.explode(F.filter(F.array(*fields), lambda x: x.isNotNull())).alias("x")).select(key, "x.field", "x.value")


def ordered_map(config: Column) -> Column:
    """ordered() for a map in a column."""
    return F.map_filter(config, lambda k, _: ~k.isin(*SHUFFLE_ONLY))


def grid_of(*sides: DataFrame) -> DataFrame:
    """All combinations of the rows of small frames of choices."""
    out = sides[0]
    for side in sides[1:]:
        out = out.crossJoin(F.broadcast(side))  # the cross is what is asked for; choices are few
    return out
