"""Named sources, to be merged on one axis."""

from __future__ import annotations

import json
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prismatic.functions import arrays
from prismatic.operators import relational


@dataclass
class Source:
    rows: DataFrame
    axis: list[float]
    name: str
    about: dict = field(default_factory=dict)

    def summary(self) -> dict:
        return {"name": self.name, "n_samples": self.rows.count(), "n_channels": len(self.axis), "range": [self.axis[0], self.axis[-1]], **self.about}


class Registry:
    def __init__(self):
        self.sources: dict[str, Source] = {}
        self.made = 0

    def add(self, rows: DataFrame, axis: list[float], name: str | None = None, **about) -> str:
        key = f"source_{self.made:03d}"
        self.made += 1
        self.sources[key] = Source(rows, list(axis), name or key, about)
        return key

    def remove(self, key: str) -> None:
        del self.sources[key]

    def clear(self) -> None:
        self.sources.clear()

    def merged_summary(self, rows: DataFrame, axis: list[float], how: str) -> dict:
        """What merge() made: rows, channels, range, and rows of each source."""
        counts = {r["datasource"]: r["count"] for r in rows.groupBy("datasource").count().collect()}
        return {"strategy": how, "n_samples": sum(counts.values()), "n_channels": len(axis), "range": [axis[0], axis[-1]] if axis else None, "sources": counts}

    def merge(self, keys: list[str] | None = None, how: str = "intersection", duplicates: str = "error", target: list[float] | None = None) -> tuple[DataFrame, list[float]]:
        """Rows of the sources on one axis: how is intersection, union or interpolation (onto target, or onto all wavelengths). Ids in several sources: error,
        rename (the source's name in front) or keep_first (in order of the sources)."""
        chosen = [self.sources[k] for k in keys or self.sources]
        if how == "interpolation":
            axis = sorted(target or set().union(*(s.axis for s in chosen)))
            out = None
            for s in chosen:
                part = s.rows.withColumn("values", arrays.resampled(F.col("values"), s.axis, axis)).withColumn("datasource", F.lit(s.name))
                out = part if out is None else out.unionByName(part, allowMissingColumns=True)
        else:
            out, axis = relational.merged({s.name: (s.rows, s.axis) for s in chosen}, how)
        if duplicates == "rename":
            return out.withColumn("sample_id", F.concat_ws("_", "datasource", F.col("sample_id").cast("string"))), axis
        if duplicates == "keep_first":
            place = F.array_position(F.array(*[F.lit(s.name) for s in chosen]), F.col("datasource"))
            return relational.first_of_each(out, "sample_id", [place]), axis
        if not out.groupBy("sample_id").count().where("count > 1").isEmpty():
            raise ValueError("some ids occur in several sources; choose rename or keep_first")
        return out, axis

    def to_json(self) -> str:
        return json.dumps({k: s.summary() for k, s in self.sources.items()})


def load_configuration(text: str) -> dict:
    """What to_json() said of each source; rows are not part of it."""
    return json.loads(text)
