"""Settings of stores from a TOML file: their folders, categories, model and how long the trash is kept."""

from __future__ import annotations

import os
import tomllib
from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from ..schemas import CATEGORIES

#: Environment variable that names another file than the one asked for, and the name of the shared store.
ENVIRONMENT, SHARED = "TESSERA_CONFIG", "share"


class ConfigError(ValueError):
    """Settings that can't be used."""


@dataclass(frozen=True)
class Config:
    """profiles: folders of stores by name."""

    retention_minutes: int
    sweep_minutes: int
    profiles: tuple[tuple[str, str], ...] = ()
    categories: tuple[str, ...] = CATEGORIES
    model: str = ""
    dimension: int = 0
    max_distance: float = 0.55


def parse(text: str) -> Config:
    """From TOML: [cleanup] with both times in minutes is required; [profiles], [search] and [categories] aren't."""
    try:
        given = tomllib.loads(text)
    except tomllib.TOMLDecodeError as e:
        raise ConfigError(str(e)) from e
    cleanup = given.get("cleanup")
    if not isinstance(cleanup, dict):
        raise ConfigError("[cleanup] is missing")
    for key in ("trash_retention_minutes", "sweep_interval_minutes"):
        if not isinstance(cleanup.get(key), int) or cleanup[key] < 0:
            raise ConfigError(f"cleanup.{key} is missing or no number of minutes")
    found = given.get("search", {})
    return Config(
        cleanup["trash_retention_minutes"], cleanup["sweep_interval_minutes"], tuple(given.get("profiles", {}).items()), tuple(given.get("categories", {}).get("names", CATEGORIES)),
        found.get("model", ""), found.get("dimension", 0), found.get("max_distance", 0.55),
    )


def load(path: str, environment: Mapping[str, str] = os.environ) -> Config:
    """The settings in a file on the driver; the environment may name another one."""
    with open(environment.get(ENVIRONMENT) or path, encoding="utf-8") as lines:
        return parse(lines.read())


def projects(spark: SparkSession, config: Config) -> DataFrame:
    """project_id, display_name, scope, is_share, categories: the stores that are configured, as many as the file names."""
    rows = [(name, name, SHARED if name == SHARED else "profile", name == SHARED, [SHARED] if name == SHARED else [c for c in config.categories if c != SHARED]) for name, _ in config.profiles]
    return spark.createDataFrame(rows, "project_id string, display_name string, scope string, is_share boolean, categories array<string>")


def guide(config: Config) -> dict:
    """What clients are told of the rules: categories that records may have, and how long the trash is kept."""
    return {"categories": list(config.categories), "trash_retention_minutes": config.retention_minutes}
