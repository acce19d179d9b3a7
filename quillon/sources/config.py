"""Settings from a mapping or a small YAML file, and the configured sites as a table."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession

from quillon.schemas import SearchSettings, Settings, SiteConfig


def from_mapping(conf: Mapping) -> Settings:
    """Settings from nested keys ``sites`` (url, name) and ``search`` (any field of SearchSettings)."""
    sites = tuple(SiteConfig(s["url"], s.get("name", s["url"])) for s in conf.get("sites", ()))
    if len({s.url for s in sites}) < len(sites):
        raise ValueError("a site's url is configured twice")
    return Settings(sites, SearchSettings(**conf.get("search", {})), conf.get("user_agent", "quillon"), conf.get("referrer", ""))


def from_yaml(path: str) -> Settings:
    """Settings from a YAML file; needs PyYAML."""
    try:
        import yaml
    except ImportError as e:
        raise RuntimeError("PyYAML is not installed; use from_mapping") from e
    with open(path, encoding="utf-8") as f:
        return from_mapping(yaml.safe_load(f) or {})


def sites_table(spark: SparkSession, settings: Settings) -> DataFrame:
    """The configured sites (pos, url, name)."""
    return spark.createDataFrame([(i, s.url, s.name) for i, s in enumerate(settings.sites)], "pos int, url string, name string")
