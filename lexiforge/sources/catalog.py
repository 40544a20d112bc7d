"""A catalog of logical datasets in TOML: tiers with roots, datasets with tier and path."""

from __future__ import annotations

import os
import re
import tomllib
from dataclasses import dataclass, field
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

from .readers import read_any

MANIFEST, LOCAL, VARIABLE = "datasets.toml", "datasets.local.toml", "LEXIFORGE_MANIFEST"
PARENTS = 8


class UnknownDataset(KeyError):
    """No dataset of that name."""


class UnknownTier(KeyError):
    """A dataset names a tier that the catalog lacks."""


class TierUnavailable(OSError):
    """The tier's root isn't mounted."""


def merged(base: dict, override: dict) -> dict:
    """Deep merge; the override wins where both have a value."""
    out = dict(base)
    for key, value in override.items():
        out[key] = merged(out[key], value) if isinstance(value, dict) and isinstance(out.get(key), dict) else value
    return out


def find_manifest(start: Path | None = None) -> Path:
    """The manifest named by the environment, else the nearest one upwards."""
    if named := os.environ.get(VARIABLE):
        return Path(named)
    here = (start or Path.cwd()).resolve()
    for folder in [here, *here.parents][: PARENTS + 1]:
        if (folder / MANIFEST).exists():
            return folder / MANIFEST
    raise FileNotFoundError(MANIFEST)


@dataclass
class Catalog:
    tiers: dict = field(default_factory=dict)
    datasets: dict = field(default_factory=dict)

    @classmethod
    def load(cls, path: Path | None = None) -> Catalog:
        path = Path(path) if path else find_manifest()
        spec = tomllib.loads(path.read_text())
        if (local := path.with_name(LOCAL)).exists():
            spec = merged(spec, tomllib.loads(local.read_text()))
        return cls(spec.get("tiers", {}), spec.get("datasets", {}))

    def resolve(self, name: str) -> str:
        """The path of a dataset; unknown names, unknown tiers and unmounted tiers differ in their error."""
        if name not in self.datasets:
            raise UnknownDataset(name)
        entry = self.datasets[name]
        if entry["tier"] not in self.tiers:
            raise UnknownTier(entry["tier"])
        tier = self.tiers[entry["tier"]]
        root = os.path.expandvars(os.path.expanduser(tier["root"]))
        if "://" not in root and not Path(root, tier.get("mount_check", "")).exists():
            raise TierUnavailable(f"{entry['tier']}: {root}")
        return f"{root.rstrip('/')}/{entry['path']}"

    def read(self, spark: SparkSession, name: str) -> DataFrame:
        return read_any(spark, self.resolve(name))

    def register(self, spark: SparkSession, *names: str) -> None:
        """Datasets as temporary views of their names."""
        for name in names or self.datasets:
            self.read(spark, name).createOrReplaceTempView(name)

    def state(self, name: str) -> str:
        try:
            self.resolve(name)
        except UnknownTier:
            return "unknown tier"
        except TierUnavailable:
            return "tier missing"
        return "ok"

    def check(self, spark: SparkSession) -> DataFrame:
        """One row per dataset: name, tier, phase, parent, state."""
        rows = [(n, d.get("tier"), d.get("phase"), d.get("parent"), self.state(n)) for n, d in sorted(self.datasets.items())]
        return spark.createDataFrame(rows, "name string, tier string, phase string, parent string, state string")


def path_or_name(catalog: Catalog, name: str | None = None, path: str | None = None) -> str:
    """A dataset's path or the path given; refuses what an empty variable leaves of `$ROOT/x`."""
    if (name is None) == (path is None):
        raise ValueError("give a name or a path")
    if name is not None:
        return catalog.resolve(name)
    if re.fullmatch(r"/[^/]+\.\w+", path) and not Path(path).exists():
        raise ValueError(f"{path} looks like an unset variable before a file name")
    return path
