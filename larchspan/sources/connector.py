"""Scene catalogues as Python data sources, and the registry of their kinds.

`spark.read.format("scenes").option("catalogue", name).load(path)` lists the items of a JSON-lines catalogue as typed
scenes.  Filters on date, box and cloud cover that the source understands are pushed into the listing, the others stay
with Spark.  Network catalogues register a reader under their own name in the same way.
"""

from __future__ import annotations

import json
import os
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThanOrEqual, InputPartition, LessThanOrEqual

SCHEMA = "id string, collection string, platform string, tile string, baseline string, ts string, cloud_cover double, scale double, offset double"


@dataclass(frozen=True)
class Catalogue:
    """How a kind of catalogue names things: asset keys by band, and the tile of an item."""

    name: str
    bands: dict[str, str]
    tile: Callable[[dict], str | None]
    sign: Callable[[str], str] = field(default=lambda url: url)


def grid_tile(p: dict) -> str | None:
    """The grid code without its prefix, else the three parts of the reference."""
    if code := p.get("grid:code"):
        return code.removeprefix("MGRS-")
    parts = [p.get(k) for k in ("mgrs:utm_zone", "mgrs:latitude_band", "mgrs:grid_square")]
    return None if None in parts else "".join(map(str, parts))


CATALOGUES: dict[str, Catalogue] = {}


def register(c: Catalogue) -> Catalogue:
    CATALOGUES[c.name] = c
    return c


def catalogue(name: str) -> Catalogue:
    if name not in CATALOGUES:
        raise KeyError(f"unknown catalogue {name!r}; available: {', '.join(sorted(CATALOGUES))}")
    return CATALOGUES[name]


register(Catalogue("named", {"b02": "blue", "b04": "red", "b08": "nir", "b11": "swir16", "b12": "swir22"}, grid_tile))
register(Catalogue("plain", {b: b.upper() for b in ("b02", "b04", "b08", "b11", "b12")}, lambda p: p.get("s2:mgrs_tile")))


@dataclass
class _File(InputPartition):
    path: str

    def __init__(self, path: str) -> None:
        super().__init__(path)
        self.path = path


class SceneReader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.path, self.kind = options["path"], options.get("catalogue", "named")
        self.band = options.get("band", "b04")
        self.tests: list[tuple[str, str, object]] = []

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:  # noqa: N802
        """Takes ranges of date and cloud cover and equal platforms; gives back the rest."""
        for f in filters:
            name = f.attribute[0] if len(getattr(f, "attribute", ())) == 1 else None
            op = {GreaterThanOrEqual: "ge", LessThanOrEqual: "le", EqualTo: "eq"}.get(type(f))
            if op and name in ("ts", "cloud_cover", "platform"):
                self.tests.append((name, op, f.value))
            else:
                yield f

    def partitions(self) -> list[InputPartition]:
        if os.path.isdir(self.path):
            return [_File(os.path.join(self.path, f)) for f in sorted(os.listdir(self.path)) if f.endswith((".json", ".jsonl"))]
        return [_File(self.path)]

    def read(self, partition: _File) -> Iterator[tuple]:
        kind = catalogue(self.kind)
        with open(partition.path, encoding="utf-8") as lines:
            for line in lines:
                if not line.strip():
                    continue
                item = json.loads(line)
                p = item.get("properties", {})
                band = (item.get("assets", {}).get(kind.bands.get(self.band, self.band), {}).get("raster:bands") or [{}])[0]
                row = {
                    "id": item.get("id"), "collection": item.get("collection"), "platform": (p.get("platform") or "").lower() or None, "tile": kind.tile(p), "baseline": p.get("s2:processing_baseline"),
                    "ts": p.get("datetime") or p.get("start_datetime"), "cloud_cover": p.get("eo:cloud_cover"), "scale": band.get("scale"), "offset": band.get("offset"),
                }
                if all(_holds(row[n], op, v) for n, op, v in self.tests):
                    yield tuple(float(v) if k in ("cloud_cover", "scale", "offset") and v is not None else v for k, v in row.items())


def _holds(value: object, op: str, limit: object) -> bool:
    if value is None:
        return False
    return value >= limit if op == "ge" else value <= limit if op == "le" else value == limit


class SceneSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "scenes"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> SceneReader:  # noqa: ANN001
        return SceneReader(self.options)


def enable(spark: SparkSession, pushdown: bool = True) -> None:
    """Registers the source; filters are pushed down only where the session allows it for Python sources."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", str(pushdown).lower())
    spark.dataSource.register(SceneSource)
