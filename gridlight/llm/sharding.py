"""Sharding by histogram sort (operator 7), in DataFrame operations only.

Rows are ordered by (hash of the text, doc_id, number of the row), so equal texts stand together, a group of
copies too large for one shard is cut between two documents, and no two rows are in the same place. Splitters of
that order are found by counting: each round counts exact rows and bytes below candidate boundaries over all
partitions (one pre-aggregated groupBy of at most 4,096 cells for each open splitter) and opens only those cells
that hold a boundary not yet within tolerance; one row for each splitter comes to the driver. Then every row gets
its part from the splitters and is exchanged once.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gridlight.llm.common import table, written

#: Bits of one histogram level, and of the text hash that rows are ordered by.
DIGIT, KEY_BITS = 12, 60


@dataclass(frozen=True)
class Splitter:
    """A boundary of the order: rows with (key, doc, row) below ``place`` come before; ``rows`` and ``bytes`` count them."""

    place: tuple[int, int, int]
    rows: int
    bytes: int


#: The columns that rows are ordered by, and the names of a cell's columns.
ORDER, CELL, PARENT = ["key", "doc", "row"], ["a", "b", "c"], ["pa", "pb", "pc"]


def _levels(doc_bits: int, row_bits: int) -> list[tuple[int, int]]:
    """(number of the column, shift) of each level: the key's digits from the top, then those of the document offset and of the row's number."""
    down = lambda bits: list(range(-(-bits // DIGIT) * DIGIT - DIGIT, -1, -DIGIT))
    return [(column, s) for column, bits in enumerate((KEY_BITS, max(1, doc_bits), max(1, row_bits))) for s in down(bits)]


def _cell(level: tuple[int, int], names: list[str]) -> list[Column]:
    """The columns that name a row's cell at a level: those before the level's are whole, those after it 0."""
    column, shift = level
    return [(F.col(c) if k < column else F.shiftright(c, shift) if k == column else F.lit(0).cast("long")).alias(n) for k, (c, n) in enumerate(zip(ORDER, names))]


def find_splitters(rows: DataFrame, targets: list[tuple[str, float]], tolerance: dict[str, float], doc_bits: int, row_bits: int) -> list[Splitter]:
    """A splitter for each target (measure, amount): measure 'rows' or 'bytes' below it within tolerance, or as near as rows allow.

    ``rows`` has key, doc, row (all from 0) and size. A round counts the cells below the open ones and finds,
    by sums over each open cell's at most 4,096 counts, the one that holds each target; only these, one
    row for each splitter, come to the driver, whatever the input.
    """
    spark, levels = rows.sparkSession, _levels(doc_bits, row_bits)
    found: dict[int, Splitter] = {}
    open_targets = [(i, (0, 0, 0), 0, 0) for i in range(len(targets))]  # number, cell, rows and bytes before the cell
    within = Window.partitionBy(*PARENT).orderBy(*CELL)
    for depth, (column, shift) in enumerate(levels):
        above = _cell(levels[depth - 1], PARENT) if depth else [F.lit(0).cast("long").alias(n) for n in PARENT]
        named = rows.select(*_cell((column, shift), CELL), "size", *above)
        if depth:
            parents = spark.createDataFrame(sorted({x[1] for x in open_targets}), ", ".join(f"{n} long" for n in PARENT))
            named = named.join(F.broadcast(parents), PARENT)  # no more rows than splitters
        cells = named.groupBy(*PARENT, *CELL).agg(F.count("*").alias("n"), F.sum("size").alias("s"))
        cells = cells.withColumns({"rows": F.sum("n").over(within), "bytes": F.sum("s").over(within), "after": F.lead(F.struct(*CELL)).over(within)})
        wanted = spark.createDataFrame([(i, *cell, targets[i][0], float(targets[i][1] - (n if targets[i][0] == "rows" else s))) for i, cell, n, s in open_targets], "i int, " + ", ".join(f"{n} long" for n in PARENT) + ", measure string, amount double")
        high = F.when(F.col("measure") == "rows", F.col("rows")).otherwise(F.col("bytes"))
        low = high - F.when(F.col("measure") == "rows", F.col("n")).otherwise(F.col("s"))
        holds = ((F.col("amount") <= high) | F.col("after").isNull()) & ((F.col("amount") > low) | (F.col("rows") == F.col("n")))
        picked = cells.join(F.broadcast(wanted), PARENT).where(holds).select("i", *CELL, "n", "s", "rows", "bytes", "after").collect()
        before = {x[0]: x[2:] for x in open_targets}
        at = lambda cell: tuple(v << shift if k == column else v for k, v in enumerate(cell))  # noqa: E731, B023
        open_targets = []
        for r in picked:
            (measure, amount), (n, s), cell = targets[r.i], before[r.i], (r.a, r.b, r.c)
            first, last = (n + r.rows - r.n, s + r.bytes - r.s), (n + r.rows, s + r.bytes)
            low, high = (x[measure == "bytes"] for x in (first, last))
            after = tuple(r.after) if r.after else tuple(v + (k == column) for k, v in enumerate(cell))
            if abs(amount - low) <= tolerance[measure] or depth + 1 == len(levels) and amount - low <= high - amount:
                found[r.i] = Splitter(at(cell), *first)
            elif abs(amount - high) <= tolerance[measure] or depth + 1 == len(levels):
                found[r.i] = Splitter(at(after), *last)
            else:
                open_targets.append((r.i, cell, *first))
        if not open_targets:
            break
    return [found[i] for i in range(len(targets))]


def shard(docs: DataFrame, shards: int = 16, tolerance: float = 0.001, part_rows: int = 4_000_000, least_parts: int = 8, columns: list[str] | None = None) -> DataFrame:
    """``docs`` (doc_id, text and more) with size, text_crc32, law, shard and slot.

    Law ``bytes``: the shards' sums of size (UTF-8 bytes of the text plus 1) are within twice
    ``tolerance`` of a shard's share, or within one row of it. ``slot`` numbers a shard's rows from 0 in the order
    of (text hash, doc_id), rows equal in both as they are numbered. A shard is worked on in parts of at most about
    ``part_rows`` rows, at least ``least_parts``, whose first slots are known from the counts, so no task holds a
    whole shard. A null text has size 1 and the crc of nothing; null doc_ids come first; rows that are equal in all
    columns are rows of their own, in any shard; fewer rows than shards leave shards empty; an empty table gives no
    rows. Columns of ``docs`` named as those added are replaced. ``columns`` are those of ``docs`` that are wanted
    back, by default all: rows are numbered in a table with these, which is written once, so that numbers hold.
    """
    binary = F.coalesce(F.encode(F.col("text").cast("string"), "UTF-8"), F.lit(b""))
    made = ["size", "text_crc32", "law", "shard", "slot", "grown_shard"]
    kept = [c for c in (docs.columns if columns is None else columns) if c.lower() not in made]
    # the columns of the order stand in a struct of their own, which no column of docs can clash with
    plain = docs.select(F.struct(*kept).alias("given"), F.col("doc_id").cast("long").alias("id"), F.octet_length(binary).cast("long").alias("length"), F.crc32(binary).alias("text_crc32"), F.shiftrightunsigned(F.xxhash64(binary), 64 - KEY_BITS).alias("key"))
    numbered = written(plain.withColumn("row", F.monotonically_increasing_id()).withColumn("size", F.col("length") + 1).drop("length"), "numbered")
    lowest, total, count, highest, last = numbered.agg(F.min("id"), F.sum("size"), F.count("*"), F.max("id"), F.max("row")).first()
    out = [*(F.col(f"given.`{c}`").alias(c) for c in kept), "size", "text_crc32"]
    if not count:
        return numbered.select(*out, F.lit("bytes").alias("law"), F.lit(0).alias("shard"), F.lit(0).cast("long").alias("slot"))
    lowest = lowest or 0
    keyed = numbered.withColumn("doc", F.coalesce(F.col("id") - F.lit(lowest) + 1, F.lit(0).cast("long")))
    # the counting rounds read these four columns only
    narrow = keyed.select(*ORDER, "size")
    parts = max(least_parts, -(-count // (part_rows * shards))) * shards
    wanted = [("bytes", total * i / shards) for i in range(1, shards)] + [("rows", count * i / parts) for i in range(1, parts)]
    limits = {"bytes": tolerance * total / shards, "rows": 0.25 * count / parts}
    splitters = find_splitters(narrow, wanted, limits, int((highest or lowest) - lowest + 1).bit_length(), int(last).bit_length())
    bounds = splitters[: shards - 1]
    every = sorted({(s.place, s.rows) for s in splitters})
    firsts = [0, *(rows for _, rows in every)]
    shard_of = [sum(b.place <= (0, 0, 0) for b in bounds), *(sum(b.place <= place for b in bounds) for place, _ in every)]
    first_of_shard = [0, *(b.rows for b in bounds)]
    parts_table = docs.sparkSession.createDataFrame([(p, shard_of[p], firsts[p] - first_of_shard[shard_of[p]]) for p in range(len(firsts))], "part int, shard int, first long")
    # the part of a row: those before its key's leading digit, and the few splitters within that digit
    lead = KEY_BITS - DIGIT
    by_lead: dict[int, list] = {}
    for place, _ in every:
        by_lead.setdefault(place[0] >> lead, []).append(place)
    leads, seen = [], 0
    for a in range(1 << DIGIT):
        leads.append((a, seen, by_lead.get(a, [])))
        seen += len(by_lead.get(a, []))
    lead_table = docs.sparkSession.createDataFrame(leads, "lead long, seen int, within array<struct<key:long,doc:long,row:long>>")
    placed = keyed.withColumn("lead", F.shiftright("key", lead)).join(F.broadcast(lead_table), "lead")
    inside = F.filter("within", lambda s: s <= F.struct(*ORDER))
    placed = placed.withColumn("part", F.col("seen") + F.size(inside)).join(F.broadcast(parts_table), "part")
    slot = F.col("first") + F.row_number().over(Window.partitionBy("part").orderBy(*ORDER)) - 1
    return placed.withColumn("slot", slot).select(*out, F.lit("bytes").alias("law"), "shard", "slot")


def op7_histogram_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The shard and slot of every document, 16 shards of near-equal bytes."""
    placed = shard(table(spark, sf_dir, "documents").select("doc_id", "text"), columns=["doc_id"])
    return placed.select("doc_id", "size", "text_crc32", "law", "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
