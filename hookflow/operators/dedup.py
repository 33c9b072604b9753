"""Duplicate suppression: a time-to-live tier and a permanent tier.

The time-to-live rule is greedy. Per (source, external id) a row is accepted, later
rows are duplicates until the window counted from the *accepted* row is over, then the
next row is accepted. No single window function expresses that, so two exact ways exist:

* keys with few rows fold their sorted rows inside one aggregate;
* keys with many rows (one key may hold a large share of all data) are never gathered.
  Their distinct instants are range-split by time into blocks. One pass over a block tells
  where a chain that enters it leaves it; only these exits are chained from block to block,
  and one more pass over each block marks what its chain accepts. The number of jobs does not
  depend on the chain. A chain can enter a block only within one window of its start, so
  the exits are few unless blocks are shorter than windows. Where they are too many for one place,
  every instant gets a pointer to the first instant after its window and accepted instants
  are found by doubling the pointers, in as many rounds as the logarithm of the longest chain.

A source may deliver one record several times. Of the rows that share (source, id) the earliest
is the one that takes part: exactly one row of an id can be accepted, on either path. Where no id comes twice,
which one narrow aggregate shows, rows are told apart by their ids; else they are numbered when they are written to the
shared folder, and verdicts are carried by that number.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Row, Window
from pyspark.sql import functions as F

from hookflow.functions.scalars import parse_window
from hookflow.session import broadcast_if_small, cut_lineage, stored_once

KEY = ["source", "external_id"]
# Rows of one key that may be folded in a single aggregation buffer.
FOLD_LIMIT = 4096
# Number of a row in its written table.
ROW = "_row"
# Distinct instants of one key that make a block; a task holds one block.
BLOCK_INSTANTS = 1 << 17
# Ways through blocks that are chained in one place, 16 bytes each; beyond, pointers are doubled.
MAX_CHAINED = 1 << 20
_BLOCK = "source string, external_id string, part long, number long, start long, ways long, entries binary, exits binary, instants binary, rows binary, ttl long"
_DUE = "part long, number long, due long, head boolean"


def numbered(events: DataFrame) -> DataFrame:
    """The events, written once, with a row number that survives retries because it is stored."""
    return stored_once(events.withColumn(ROW, F.monotonically_increasing_id()), "rows")


def names_rows(rows: DataFrame) -> bool:
    """Whether (source, id) names each row: neither is null, and none comes twice."""
    odd = F.bool_or(F.col("source").isNull() | F.col("id").isNull())
    counted = rows.groupBy("source", "id").agg(F.count(F.lit(1)).alias("n"), odd.alias("odd"))
    return counted.filter("n > 1 or odd").isEmpty()


def one_per_id(rows: DataFrame) -> DataFrame:
    """The earliest row of each (source, id), and how many share it; a row without one of the two stands for itself."""
    narrow = rows.select("source", "id", "created_at", "external_id", ROW)
    if names_rows(narrow):
        return narrow.withColumn("copies", F.lit(1))
    alone = F.when(F.col("id").isNull() | F.col("source").isNull(), F.col(ROW)).alias("_alone")
    first = F.min(F.struct("created_at", "external_id", ROW)).alias("_first")
    grouped = narrow.groupBy("source", "id", alone).agg(first, F.count(F.lit(1)).alias("copies"))
    return stored_once(grouped.select("source", "id", "_first.*", "copies"), "ids")


def id_repeats(rows: DataFrame, firsts: DataFrame) -> DataFrame:
    """Numbers of the rows that repeat an id, the one that takes part left out."""
    repeated = firsts.filter("copies > 1").select("source", "id", F.col(ROW).alias("_kept"))
    found = rows.select("source", "id", ROW).join(repeated, ["source", "id"])
    return found.filter(F.col(ROW) != F.col("_kept")).select(ROW)


def _keyed(events: DataFrame, sources: DataFrame) -> DataFrame:
    """Rows that take part: the source configures a field and the row has an external id."""
    ttl = parse_window(F.coalesce("dedup_window", F.lit("72h")))
    settings = sources.filter(F.nullif("dedup_field", F.lit("")).isNotNull())
    settings = settings.select(F.col("name").alias("source"), ttl.alias("ttl")).filter("ttl > 0")
    return (
        events.filter(F.col("external_id").isNotNull())
        .select("source", "external_id", "id", ROW, F.col("created_at").alias("at"))
        .join(settings, "source")
    )


def _fold_small(keyed: DataFrame) -> DataFrame:
    """Decisions for keys whose rows fit one aggregation buffer."""
    rows = F.array_sort(F.collect_list(F.struct("at", "id", ROW)))
    grouped = keyed.groupBy(*KEY, "ttl").agg(rows.alias("rows"))
    expiry = F.make_dt_interval(secs=F.col("ttl").cast("decimal(18,6)"))

    def step(state, row):
        accept = state["until"].isNull() | (row["at"] >= state["until"])
        return F.struct(
            F.when(accept, row["at"] + expiry).otherwise(state["until"]).alias("until"),
            F.concat(state["flags"], F.array(accept)).alias("flags"),
        )

    start = F.struct(
        F.lit(None).cast("timestamp").alias("until"), F.array().cast("array<boolean>").alias("flags")
    )
    flags = F.aggregate("rows", start, step, lambda state: state["flags"])
    decided = F.posexplode(F.arrays_zip(F.col("rows"), flags.alias("accepted")))
    return grouped.select(*KEY, decided.alias("pos", "d")).select(
        *KEY, "d.rows.at", "d.rows.id", f"d.rows.{ROW}", "d.accepted", (F.col("pos") == 0).alias("first")
    )


def _next_instants(instants: DataFrame) -> DataFrame:
    """For every (key, at) the first instant of the key at or after ``at + ttl``.

    Events and look-ups meet in one-second cells; a look-up that finds nothing in its
    cell takes the earliest instant of the next non-empty cell. Cells bound the window
    partitions by the clock: a cell holds the distinct instants of one second, and the
    per-key window sees one row per second, however many rows the key has.
    """
    due = F.col("at") + F.make_dt_interval(secs=F.col("ttl").cast("decimal(18,6)"))
    cell = F.unix_seconds("t").alias("cell")
    marks = instants.select(*KEY, F.col("at").alias("t"), F.lit(None).cast("timestamp").alias("origin"))
    marks = marks.unionByName(instants.select(*KEY, due.alias("t"), F.col("at").alias("origin")))
    marks = marks.select(*KEY, "t", "origin", cell)
    is_event = F.col("origin").isNull()
    event_at = F.when(is_event, F.col("t"))

    later_cells = Window.partitionBy(*KEY).orderBy(F.desc("cell")).rowsBetween(Window.unboundedPreceding, -1)
    cells = marks.groupBy(*KEY, "cell").agg(F.min(event_at).alias("first"))
    cells = cells.select(*KEY, "cell", F.min("first").over(later_cells).alias("beyond"))

    inside = (
        Window.partitionBy(*KEY, "cell")
        .orderBy(F.desc("t"), F.desc(is_event))
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    found = marks.withColumn("near", F.min(event_at).over(inside)).filter(F.col("origin").isNotNull())
    return (
        found.join(cells, [*KEY, "cell"], "left")
        .select(*KEY, F.col("origin").alias("at"), F.coalesce("near", "beyond").alias("next_at"))
        .filter(F.col("next_at").isNotNull())
    )


def _reachable(roots: DataFrame, jumps: DataFrame) -> DataFrame:
    """Instants on the chains that start at the roots, found by doubling the pointers.

    Round n knows the first 2^n links of every chain and pointers of that length; the
    links they lead to are all new, so rounds are disjoint and need no comparison.
    """
    reached = cut_lineage(roots.select(*KEY, "at"))
    jumps = cut_lineage(jumps)
    while True:
        onward = cut_lineage(reached.join(jumps, [*KEY, "at"]).select(*KEY, F.col("next_at").alias("at")))
        if onward.isEmpty():
            return reached
        reached = reached.unionByName(onward)
        second = jumps.select(*KEY, F.col("at").alias("next_at"), F.col("next_at").alias("after"))
        jumps = cut_lineage(jumps.join(second, [*KEY, "next_at"]).select(*KEY, "at", F.col("after").alias("next_at")))


def _ways(at: np.ndarray, ttl: int) -> tuple[np.ndarray, np.ndarray]:
    """(entries, exits) of a block: a chain that is due at or before an entry, and after the entry before it, leaves the block due at its exit.

    A chain comes from an instant before the block, so it is due less than a window after the block's start. Entries in a
    row that leave alike are one way.
    """
    last = min(len(at), int(np.searchsorted(at, at[0] + ttl)) + 1)
    onward = np.searchsorted(at, at + ttl)
    # Doubling inside the block: every instant to the last one that its chain accepts here, which points to itself.
    ending = np.where(onward < len(at), onward, np.arange(len(at)))
    while not np.array_equal(further := ending[ending], ending):
        ending = further
    exits = at[ending[:last]] + ttl
    ends = np.append(exits[1:] != exits[:-1], True)
    return at[:last][ends], exits[ends]


def _block_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (source, external_id, ttl, at, row), sorted by key and time, as one row for each block of a key."""
    part, number = TaskContext.get().partitionId(), 0
    key: tuple | None = None
    held: list[tuple[np.ndarray, np.ndarray]] = []
    size = 0

    def block() -> pa.RecordBatch:
        at, rows = (np.concatenate(x) for x in zip(*held, strict=True))
        entries, exits = _ways(at, key[2])
        cells = (*key[:2], part, number, int(at[0]), len(entries), entries.tobytes(), exits.tobytes(), at.tobytes(), rows.tobytes(), key[2])
        names = [c.split() for c in _BLOCK.split(", ")]
        kinds = {"string": pa.string(), "long": pa.int64(), "binary": pa.binary()}
        return pa.RecordBatch.from_arrays([pa.array([c], kinds[kind]) for c, (_, kind) in zip(cells, names, strict=True)], [name for name, _ in names])

    for batch in batches:
        sources, ids, ttls = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(3))
        at, rows = (batch.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in (3, 4))
        changes = (sources[1:] != sources[:-1]) | (ids[1:] != ids[:-1])
        cuts = [0, *(np.flatnonzero(changes) + 1).tolist(), batch.num_rows] if batch.num_rows else []
        for start, end in zip(cuts, cuts[1:]):
            new = (sources[start], ids[start], int(ttls[start]))
            if held and (new != key or size + end - start > BLOCK_INSTANTS):
                yield block()
                held, size, number = [], 0, number + 1
            key = new
            held.append((at[start:end], rows[start:end]))
            size += end - start
    if held:
        yield block()


def _chained(blocks: list[Row]) -> list[tuple[int, int, int, bool]]:
    """(part, number, due, whether it is the key's first) of every block that a chain enters; blocks are sorted by key and start."""
    found, key, due = [], None, 0
    for row in blocks:
        head = (row.source, row.external_id) != key
        if head:
            key, due = (row.source, row.external_id), row.start
        entries = np.frombuffer(row.entries, np.int64)
        way = int(np.searchsorted(entries, due))
        if way < len(entries):
            found.append((row.part, row.number, due, head))
            due = int(np.frombuffer(row.exits, np.int64)[way])
    return found


def _marked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Numbers of the rows that the chains through the blocks accept, and whether each is the first of its key."""
    for batch in batches:
        for instants, rows, ttl, due, head in zip(*(batch.column(i) for i in range(5)), strict=True):
            at, numbers = (np.frombuffer(x.as_buffer(), np.int64) for x in (instants, rows))
            onward = np.searchsorted(at, at + ttl.as_py()).tolist()
            taken, i = [], int(np.searchsorted(at, due.as_py()))
            while i < len(onward):
                taken.append(i)
                i = onward[i]
            first = np.zeros(len(taken), bool)
            first[:1] = head.as_py()
            yield pa.RecordBatch.from_arrays([pa.array(numbers[taken]), pa.array(first)], [ROW, "first"])


def _accepted_large(instants: DataFrame) -> DataFrame:
    """(_row, first) of the accepted rows among the distinct instants of keys with too many rows to gather."""
    micros = F.unix_micros(F.col("at").cast("timestamp"))
    ttl = (F.col("ttl").cast("decimal(18,6)") * 1000000).cast("long")
    ordered = instants.select(*KEY, ttl.alias("ttl"), micros.alias("at"), ROW)
    ordered = ordered.repartitionByRange(*KEY, "at").sortWithinPartitions(*KEY, "at")
    blocks = stored_once(ordered.mapInArrow(_block_rows, _BLOCK), "blocks")
    if (blocks.agg(F.sum("ways")).first()[0] or 0) > MAX_CHAINED:
        return _accepted_by_jumps(instants)
    rows = blocks.select(*KEY, "part", "number", "start", "entries", "exits").orderBy(*KEY, "start").collect()
    dues = instants.sparkSession.createDataFrame(_chained(rows), _DUE)
    entered = blocks.join(broadcast_if_small(dues), ["part", "number"]).select("instants", "rows", "ttl", "due", "head")
    return entered.mapInArrow(_marked, f"{ROW} long, first boolean")


def _accepted_by_jumps(instants: DataFrame) -> DataFrame:
    roots = instants.groupBy(*KEY).agg(F.min("at").alias("at"))
    reached = _reachable(roots, _next_instants(instants))
    kept = instants.join(reached, [*KEY, "at"], "left_semi")
    heads = instants.join(roots, [*KEY, "at"], "left_semi").select(ROW, F.lit(True).alias("first"))
    return kept.select(ROW).join(heads, ROW, "left").select(ROW, F.coalesce("first", F.lit(False)).alias("first"))


def _jump_large(keyed: DataFrame) -> DataFrame:
    """Decisions for keys with too many rows to gather."""
    instants = cut_lineage(keyed.groupBy(*KEY, "ttl", "at").agg(F.min(F.struct("id", ROW))[ROW].alias(ROW)))
    kept = _accepted_large(instants).withColumn("accepted", F.lit(True))
    no = F.lit(False)
    return keyed.join(kept, ROW, "left").select(
        *KEY, "at", "id", ROW, F.coalesce("accepted", no).alias("accepted"), F.coalesce("first", no).alias("first")
    )


def decide_ttl(firsts: DataFrame, sources: DataFrame, fold_limit: int = FOLD_LIMIT) -> DataFrame:
    """(source, external_id, at, id, _row, accepted, first) for every row of ``one_per_id`` that takes part.

    Counting rows per key first costs one narrow, pre-aggregated pass and decides
    which keys may be folded in a buffer at all.
    """
    keyed = _keyed(firsts, sources)
    counts = keyed.groupBy(*KEY).agg(F.count(F.lit(1)).alias("n"))
    crowded = counts.filter(F.col("n") > fold_limit).select(*KEY)
    if crowded.isEmpty():
        return _fold_small(keyed)
    # At most one key per fold_limit rows; broadcast after a count, so that splitting off
    # a key with a large share of all rows does not send those rows to one task.
    crowded = broadcast_if_small(cut_lineage(crowded))
    small = keyed.join(crowded, KEY, "left_anti")
    large = keyed.join(crowded, KEY, "left_semi")
    return _fold_small(small).unionByName(_jump_large(large))


def ttl_repeats(rows: DataFrame, sources: DataFrame, fold_limit: int = FOLD_LIMIT) -> DataFrame:
    """Numbers of the ``numbered`` rows that repeat an id or fall into the window of an accepted row."""
    firsts = one_per_id(rows)
    late = decide_ttl(firsts, sources, fold_limit).filter(~F.col("accepted")).select(ROW)
    return late.unionByName(id_repeats(rows, firsts))


def dedup_ttl(events: DataFrame, sources: DataFrame, fold_limit: int = FOLD_LIMIT) -> DataFrame:
    """Events without the repeats that fall into the window of an accepted row.

    Ties on the clock are settled by id. Of rows that share (source, id) the earliest takes part and
    the others are repeats. Rows without an external id, and rows of sources that configure
    no deduplication, are repeats only by their id.
    """
    narrow = stored_once(
        events.select("source", "id", "external_id", "created_at", F.monotonically_increasing_id().alias(ROW)), "keys"
    )
    if names_rows(narrow):
        late = decide_ttl(narrow, sources, fold_limit).filter(~F.col("accepted")).select("source", "id")
        return events.join(late, ["source", "id"], "left_anti").select(events.columns)
    rows = numbered(events)
    return rows.join(ttl_repeats(rows, sources, fold_limit), ROW, "left_anti").drop(ROW)


def first_rows(events: DataFrame, keys: list[str]) -> DataFrame:
    """Id of the earliest row per key, pre-aggregated before the shuffle (no window per key)."""
    first = F.min(F.struct("created_at", "id")).alias("_f")
    return events.groupBy(*keys).agg(first).select(*keys, "_f.id")


def append_events(new: DataFrame, stored: DataFrame, small_batch: bool = False) -> DataFrame:
    """Rows of ``new`` an append stores: conflicts on (source, external_id) or id are skipped.

    The first row of the batch wins; a null external id never conflicts. Keys are
    settled on narrow rows, payloads are shuffled once, by id; rows that repeat an id
    (a source delivering a record twice) collapse on the same partitioning.

    ``small_batch`` suits a micro-batch against a large table: the batch's keys are
    counted and sent to the stored table's scan, which then need not be shuffled.
    """
    winners = first_rows(new.filter(F.col("external_id").isNotNull()), KEY)
    anonymous = new.filter(F.col("external_id").isNull()).select("id").distinct()
    known_keys = stored.filter(F.col("external_id").isNotNull()).select(*KEY)
    known_ids = stored.select("id")
    if small_batch:
        known_keys = known_keys.join(broadcast_if_small(winners.select(*KEY)), KEY, "left_semi")
        known_ids = known_ids.join(broadcast_if_small(new.select("id").distinct()), "id", "left_semi")
    admitted = winners.join(known_keys, KEY, "left_anti").select("id").unionByName(anonymous)
    admitted = admitted.join(known_ids, "id", "left_anti")
    return new.join(admitted, "id", "left_semi").dropDuplicates(["id"])


def dedup_hot_cold(
    events: DataFrame, stored: DataFrame, sources: DataFrame, fold_limit: int = FOLD_LIMIT
) -> DataFrame:
    """Both tiers: adds ``outcome`` = accepted, duplicate_hot, duplicate_cold or duplicate_id.

    A row past its window is acknowledged but not stored again, because the permanent
    tier still knows its key. Every input row comes back once; of rows that share (source, id)
    all but the earliest are duplicate_id.
    """
    narrow = stored_once(
        events.select("source", "id", "external_id", "created_at", F.monotonically_increasing_id().alias(ROW)), "keys"
    )
    named = names_rows(narrow)
    rows = events if named else numbered(events)
    firsts = narrow if named else one_per_id(rows)
    decided = decide_ttl(firsts, sources, fold_limit)
    known = stored.filter(F.col("external_id").isNotNull()).select(*KEY).distinct()
    judged = decided.join(known.withColumn("_known", F.lit(True)), KEY, "left")
    label = (
        F.when(~F.col("accepted"), F.lit("duplicate_hot"))
        .when(~F.col("first") | F.col("_known"), F.lit("duplicate_cold"))
        .otherwise(F.lit("accepted"))
    )
    by = ["source", "id"] if named else [ROW]
    labels = judged.select(*by, label.alias("outcome")).filter("outcome <> 'accepted'")
    if not named:
        labels = labels.unionByName(id_repeats(rows, firsts).withColumn("outcome", F.lit("duplicate_id")))
    labelled = rows.join(labels, by, "left").select(*events.columns, "outcome")
    return labelled.withColumn("outcome", F.coalesce("outcome", F.lit("accepted")))
