"""Settings, and the difference of two texts."""

import pytest
from pyspark.sql import functions as F

from tessera.functions.text import text_diff
from tessera.sources import config

TEXT = '[cleanup]\ntrash_retention_minutes = 60\nsweep_interval_minutes = 5\n[profiles]\nmine = "/stores/mine"\nshare = "/stores/share"\n'


def test_settings(spark, tmp_path):
    path = tmp_path / "other.toml"
    path.write_text(TEXT)
    read = config.load("/nowhere", {config.ENVIRONMENT: str(path)})
    assert read == config.load(str(path), {}) and (read.retention_minutes, read.sweep_minutes) == (60, 5)
    assert [(r.project_id, r.scope, r.is_share, r.categories) for r in config.projects(spark, read).collect()] == [("mine", "profile", False, ["core", "init"]), ("share", "share", True, ["share"])]
    assert config.guide(read)["categories"] == ["core", "init", "share"]
    for bad in ("", "[cleanup]\ntrash_retention_minutes = 1", "[cleanup", TEXT.replace("60", "'x'")):
        with pytest.raises(config.ConfigError):
            config.parse(bad)


def brute(a, b):
    a, b, start = a or "", b or "", 0
    while start < min(len(a), len(b)) and a[start] == b[start]:
        start += 1
    end = 0
    while end < min(len(a), len(b)) - start and a[-1 - end] == b[-1 - end]:
        end += 1
    return a[:start], a[start : len(a) - end], b[start : len(b) - end], a[len(a) - end :]


def test_text_diff(spark):
    pairs = [("abc", "abc"), ("abc", "axc"), ("abc", "ab"), ("", "x"), ("x", ""), ("", ""), (None, "a"), ("aaa", "aa"), ("é\U0001f600x", "é\U0001f601x"), ("one two", "two one"), ("ab", "abab")]
    got = spark.createDataFrame(pairs, "a string, b string").select("a", "b", text_diff(F.col("a"), F.col("b")).alias("d")).collect()
    assert [tuple(r.d) for r in got] == [brute(r.a, r.b) for r in got]
