"""Settings of an archive run: two layers of JSON and the environment."""

from __future__ import annotations

import json
import math
from dataclasses import dataclass, fields
from pathlib import Path

from pyspark.sql import Column
from pyspark.sql import functions as F

MOST_FRAMES, MOST_BYTES = 80, 3_000_000
OFF_WORDS = {"0", "false", "off"}


@dataclass
class Options:
    enabled: bool = True
    shape: str = "auto"
    max_frames: int | None = None
    max_frame_bytes: int | None = None
    include_thinking: bool = True
    dim_results: bool = True


def bounded(value: object, ceiling: int) -> int | None:
    """A positive finite number, rounded down and bounded; None for anything else."""
    if isinstance(value, bool) or not isinstance(value, (int, float)) or not math.isfinite(value) or value <= 0:
        return None
    return min(math.floor(value), ceiling)


def read_layer(path: str | Path) -> dict:
    """A JSON object; an absent or broken file is an empty layer."""
    try:
        found = json.loads(Path(path).read_text())
        return found if isinstance(found, dict) else {}
    except (OSError, ValueError):
        return {}


def resolve(layers: list[dict], environment: dict[str, str], known_shapes: set[str]) -> Options:
    """Options of the layers, nearer ones later; values of a wrong type are ignored, the environment wins."""
    merged: dict[str, object] = {}
    for layer in layers:
        merged |= layer
    out = Options()
    for f in fields(Options):
        value = merged.get(f.name)
        if f.type == "bool" and isinstance(value, bool):
            setattr(out, f.name, value)
    if isinstance(merged.get("shape"), str) and merged["shape"] in known_shapes | {"auto"}:
        out.shape = merged["shape"]
    out.max_frames = bounded(merged.get("max_frames"), MOST_FRAMES)
    out.max_frame_bytes = bounded(merged.get("max_frame_bytes"), MOST_BYTES)
    if environment.get("FOLIANT_ENABLED", "").lower() in OFF_WORDS:
        out.enabled = False
    if environment.get("FOLIANT_SHAPE") in known_shapes:
        out.shape = environment["FOLIANT_SHAPE"]
    digits = environment.get("FOLIANT_MAX_FRAMES", "").strip()
    lead = digits[: len(digits) - len(digits.lstrip("0123456789"))]
    out.max_frames = bounded(int(lead), MOST_FRAMES) or out.max_frames if lead else out.max_frames
    return out


def overlay(layers: list[Column], known_shapes: set[str]) -> Column:
    """The options of each row's layers (JSON texts, nearer ones later) as a struct, by the rules of ``resolve`` without an environment.

    An absent or broken layer, one that is not an object, or one that names a setting twice is empty; a value of a wrong type hides those of
    farther layers and is then ignored.
    """
    parsed = [F.try_parse_json(layer) for layer in reversed(layers)]

    def value(name: str) -> tuple[Column, Column]:
        found = F.coalesce(*[F.try_variant_get(layer, f"$.{name}", "variant") for layer in parsed])
        return found, F.schema_of_variant(found)

    def flag(name: str, default: bool) -> Column:
        found, kind = value(name)
        return F.when(kind == "BOOLEAN", F.try_variant_get(found, "$", "boolean")).otherwise(F.lit(default)).alias(name)

    def count(name: str, ceiling: int) -> Column:
        found, kind = value(name)
        number = F.when(kind.rlike("^(?:BIGINT|DECIMAL|DOUBLE|FLOAT)"), F.try_variant_get(found, "$", "double"))
        return F.when((number > 0) & (number < float("inf")), F.least(F.floor(number), F.lit(ceiling)).cast("long")).alias(name)

    named, kind = value("shape")
    shape = F.when(kind == "STRING", F.try_variant_get(named, "$", "string"))
    flags = [flag(f.name, f.default) for f in fields(Options) if f.type == "bool"]
    chosen = F.when(shape.isin(sorted(known_shapes | {"auto"})), shape).otherwise(F.lit("auto")).alias("shape")
    return F.struct(*flags, chosen, count("max_frames", MOST_FRAMES), count("max_frame_bytes", MOST_BYTES))
