"""Source adapters, pricing, and sinks for traces and reports."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Columns that every adapter's units have.
UNIT_COLUMNS = ("unit_id", "source_type", "content", "content_hash", "token_count")
#: Source types by the name under which a request asks for them.
ALIASES: Mapping[str, tuple[str, ...]] = {
    "repository": ("repository_file", "code_symbol"),
    "conversation": ("conversation", "message"),
}

Adapter = Callable[[DataFrame], DataFrame]


class Adapters:
    """Functions from a source's table to units, by name."""

    def __init__(self) -> None:
        self._known: dict[str, Adapter] = {}

    def register(self, name: str, adapter: Adapter) -> None:
        if name in self._known:
            raise ValueError(f"{name} is registered already")
        self._known[name] = adapter

    def units(self, tables: Mapping[str, DataFrame]) -> DataFrame:
        """The units of all tables; an adapter that leaves out a column is refused."""
        found = None
        for name, table in tables.items():
            units = self._known[name](table)
            if missing := [c for c in UNIT_COLUMNS if c not in units.columns]:
                raise ValueError(f"units of {name} lack {', '.join(missing)}")
            found = units if found is None else found.unionByName(units, allowMissingColumns=True)
        if found is None:
            raise ValueError("no tables")
        return found


class Freshness:
    """Functions that bring a source up to date; each runs once for a request, whatever its names."""

    def __init__(self) -> None:
        self._known: dict[str, Callable[[], object]] = {}

    def register(self, source_type: str, refresh: Callable[[], object]) -> None:
        self._known[source_type] = refresh

    def refresh(self, asked: Iterable[str]) -> list[object]:
        types = [t for name in asked for t in ALIASES.get(name, (name,))]
        unique = dict.fromkeys(self._known[t] for t in types if t in self._known)
        return [run() for run in unique]


def of_source_types(units: DataFrame, asked: Iterable[str]) -> DataFrame:
    """Units of the asked source types, aliases resolved; the filter reaches the scan."""
    types = sorted({t for name in asked for t in ALIASES.get(name, (name,))})
    return units.filter(F.col("source_type").isin(*types))


def pricing(models: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(valid, rejected) rows of a pricing table; ``rejected`` has a reason.

    ``models`` has model, input_rate, cached_rate and output_rate. A model needs a name that
    is not blank, and one row; rates are known and not negative.
    """
    repeated = models.groupBy("model").count().filter("count > 1").select("model", F.lit(True).alias("repeated"))
    rates = [F.col(c) for c in ("input_rate", "cached_rate", "output_rate")]
    bad = F.lit(False)
    for rate in rates:
        bad = bad | rate.isNull() | (rate < 0)
    reason = F.when(F.trim(F.coalesce("model", F.lit(""))) == "", "blank_model").when(F.col("repeated"), "repeated_model").when(bad, "rate")
    judged = models.join(repeated, "model", "left").withColumn("reason", reason)
    return judged.filter("reason is null").select(*models.columns), judged.filter("reason is not null").select(*models.columns, "reason")


def append_traces(traces: DataFrame, path: str) -> None:
    """Add a row for each operation, those that failed too, in folders by day; ``traces`` has ts."""
    traces.withColumn("day", F.to_date("ts")).write.mode("append").partitionBy("day").parquet(path)


def write_report(report: DataFrame, path: str) -> None:
    """Write a report as JSON lines; evidence that is there already is never overwritten."""
    report.write.mode("errorifexists").json(path)
