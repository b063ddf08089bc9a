"""Configuration and registry files (TOML). Read on the driver: they are a few kilobytes."""

from __future__ import annotations

import os
import tomllib
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

from rippleline.schema import REGISTRY

CONFIG_NAME, REGISTRY_NAME = "rippleline.toml", "topics.toml"
LISTINGS = ("spark", "pruned")
SOURCE_KINDS = ("sql", "code")


@dataclass(frozen=True)
class Source:
    kind: str
    path: str
    service: str


@dataclass(frozen=True)
class Config:
    store: str
    sources: list[Source] = field(default_factory=list)
    registry: str = ""
    #: How sources are listed: by Spark, or by the data source that prunes the descent.
    listing: str = "spark"


def _anchored(path: str, folder: str) -> str:
    path = os.path.expanduser(path)
    return path if os.path.isabs(path) or "://" in path else os.path.normpath(os.path.join(folder, path))


def load_config(path: str) -> Config:
    """Relative paths are anchored to the file's folder; the registry is beside it by default."""
    path = os.path.abspath(os.path.expanduser(path))
    with open(path, "rb") as f:
        raw = tomllib.load(f)
    folder = os.path.dirname(path)
    sources = [Source(s["kind"], _anchored(s["path"], folder), s["service"]) for s in raw.get("sources", [])]
    if bad := [s.kind for s in sources if s.kind not in SOURCE_KINDS]:
        raise ValueError(f"unknown source kind {bad[0]!r}; one of {', '.join(SOURCE_KINDS)}")
    listing = raw.get("listing", "spark")
    if listing not in LISTINGS:
        raise ValueError(f"unknown listing {listing!r}; one of {', '.join(LISTINGS)}")
    return Config(_anchored(raw["store"]["path"], folder), sources, _anchored(raw.get("topics", REGISTRY_NAME), folder), listing)


def discover(start: str | None = None) -> Config:
    """The nearest configuration from a folder upwards."""
    at = os.path.abspath(start or os.getcwd())
    while True:
        if os.path.isfile(found := os.path.join(at, CONFIG_NAME)):
            return load_config(found)
        if os.path.dirname(at) == at:
            raise FileNotFoundError(f"no {CONFIG_NAME} here or above")
        at = os.path.dirname(at)


def parse_registry(text: str) -> list[tuple[str, list[str], list[str], dict[str, list[str]]]]:
    """Top-level tables are services; anything else at the top and items that aren't strings are left out."""
    strings = lambda x: [i for i in x if isinstance(i, str)] if isinstance(x, list) else []
    out = []
    for service, body in sorted(tomllib.loads(text).items()):
        if isinstance(body, dict):
            known = body.get("provenance", {})
            provenance = {t: strings(v) for t, v in sorted(known.items())} if isinstance(known, dict) else {}
            out.append((service, strings(body.get("publishes")), strings(body.get("consumes")), provenance))
    return out


def read_registry(spark: SparkSession, path: str) -> DataFrame:
    """registry(service, publishes, consumes, provenance); a missing file is an empty registry. The path may be on any store
    that Spark reads."""
    text = ""
    if path:
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        if p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p):
            text = spark.read.text(path, wholetext=True).first().value
    return spark.createDataFrame(parse_registry(text), REGISTRY)
