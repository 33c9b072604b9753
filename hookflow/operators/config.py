"""Maintenance of configuration tables, and dispatch of compiled rules over event columns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from hookflow.functions.schema_rules import unsupported


def publish_schema(schemas: DataFrame, new: DataFrame) -> DataFrame:
    """Add schemas as version max+1 of their key and deactivate the versions before them.

    A schema that cannot be compiled is refused here, before it can meet an event.
    """
    key = ["source", "event_type"]
    for row in new.select("schema").distinct().collect():
        if reason := unsupported(row.schema):
            raise ValueError(f"schema is not supported: {reason}")
    latest = schemas.groupBy(*key).agg(F.max("version").alias("_latest"))
    reject = F.coalesce(F.col("reject_on_fail"), F.lit(False)) if "reject_on_fail" in new.columns else F.lit(False)
    added = new.join(latest, key, "left").select(
        *key,
        (F.coalesce(F.col("_latest"), F.lit(0)) + 1).cast("int").alias("version"),
        "schema",
        reject.alias("reject_on_fail"),
        F.lit(True).alias("active"),
    )
    touched = new.select(*key, F.lit(True).alias("_touched")).distinct()
    kept = schemas.join(touched, key, "left").withColumn("active", F.col("active") & F.col("_touched").isNull())
    return kept.drop("_touched").unionByName(added, allowMissingColumns=True).select(*schemas.columns)


def upsert_by_key(base: DataFrame, updates: DataFrame, keys: list[str]) -> DataFrame:
    """Keyed merge: rows of ``updates`` replace rows with the same key, the others stay.

    A column that ``updates`` leaves out becomes null in the replaced row.
    """
    untouched = base.join(updates.select(*keys), keys, "left_anti")
    return untouched.select(*base.columns).unionByName(updates, allowMissingColumns=True).select(*base.columns)


def upsert_transforms(transforms: DataFrame, updates: DataFrame) -> DataFrame:
    """Merge mappings by (source, event_type); a merged mapping is active again."""
    return upsert_by_key(transforms, updates.withColumn("active", F.lit(True)), ["source", "event_type"])


def upsert_sources(sources: DataFrame, updates: DataFrame) -> DataFrame:
    """Merge source settings by name; ``active`` keeps its stored value, or starts true."""
    stored = sources.select("name", F.col("active").alias("_active"))
    merged = (
        updates.drop("active")
        .join(stored, "name", "left")
        .withColumn("active", F.coalesce(F.col("_active"), F.lit(True)))
        .drop("_active")
    )
    return upsert_by_key(sources, merged, ["name"])


# Rules up to this many are all compiled; of more only those that the batch's rows call for.
COMPILED_RULES = 200


def rules_in_use(config: DataFrame, events: DataFrame, kinds: list[str] | None = None) -> list[Row]:
    """Rows of a rule table (source, event_type, ...) that events may need.

    A table of few rules is taken whole. Of a larger one only the rules of the (source, event type) pairs that the batch
    holds come to the driver, with rules whose type is in ``kinds`` for every type of their source. A stream can't be asked before it runs: it
    takes all rules.
    """
    rows = config.limit(COMPILED_RULES + 1).collect()
    if len(rows) <= COMPILED_RULES:
        return rows
    if events.isStreaming:
        return config.collect()
    found = []
    if "event_type" in events.columns:
        exact = config if kinds is None else config.filter(~F.col("event_type").isin(kinds))
        found += exact.join(events.select("source", "event_type").distinct(), ["source", "event_type"], "left_semi").collect()
    if kinds:
        wild = config.filter(F.col("event_type").isin(kinds))
        found += wild.join(events.select("source").distinct(), "source", "left_semi").collect()
    return found


class Dispatch:
    """A map from (source, event type) to the number of a rule. Equal rules have one number and are compiled once."""

    def __init__(self):
        self.numbers: dict[object, int] = {}
        self.exact: dict[tuple[str, str], int] = {}
        self.wild: dict[str, int] = {}

    def add(self, source: str, event_type: str | None, rule: object) -> None:
        """``rule`` is anything that names it, such as its text; no type stands for all other types of the source."""
        number = self.numbers.setdefault(rule, len(self.numbers))
        if event_type is None:
            self.wild[source] = number
        else:
            self.exact[source, event_type] = number

    def number(self, source: Column, event_type: Column) -> Column:
        """The number of a row's rule, NULL without one: look-ups in constant maps, with no join."""

        def found(numbers: dict[str, int], key: Column) -> Column:
            if not numbers:
                return F.lit(None).cast("int")
            names = F.split(F.lit(_SEPARATOR.join(numbers)), _SEPARATOR, -1)
            values = F.from_json(F.lit(str(list(numbers.values()))), "array<int>")
            return F.try_element_at(F.map_from_arrays(names, values), key)

        exact = found({_pair(*key): n for key, n in self.exact.items()}, _pair_column(source, event_type))
        wild = found({_escaped(name): n for name, n in self.wild.items()}, _escaped_column(source))
        return F.coalesce(exact, wild)

    def pick(self, number: Column, compiled: Callable[[object], Column], otherwise: Column) -> Column:
        """The column of the rule with this number."""
        picked = None
        for rule, n in self.numbers.items():
            column = compiled(rule)
            picked = F.when(number == n, column) if picked is None else picked.when(number == n, column)
        return otherwise if picked is None else picked.otherwise(otherwise)


# Parts of a name and names are told apart by control characters, which are escaped in the parts.
_SEPARATOR, _PART, _ESCAPE = "\u001e", "\u001f", "\u001d"


def _escaped(text: str) -> str:
    for mark, letter in ((_ESCAPE, "e"), (_SEPARATOR, "s"), (_PART, "p")):
        text = text.replace(mark, _ESCAPE + letter)
    return text


def _escaped_column(text: Column) -> Column:
    for mark, letter in ((_ESCAPE, "e"), (_SEPARATOR, "s"), (_PART, "p")):
        text = F.replace(text, F.lit(mark), F.lit(_ESCAPE + letter))
    return text


def _pair(source: str, event_type: str) -> str:
    return _escaped(source) + _PART + _escaped(event_type)


def _pair_column(source: Column, event_type: Column) -> Column:
    return F.concat(_escaped_column(source), F.lit(_PART), _escaped_column(event_type))
