"""Reports as text: tables, inline references and model cards, put together by ordered string aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def fixed(value: Column, places: int = 3) -> Column:
    """A double as text with ``places`` decimals, rounded by its exact binary value, ties to even; null for null.

    The fraction is scaled to an integer, exactly, by 2^62 and what that leaves by 2^30, and its decimals
    are taken by integer arithmetic.
    """
    v = value.cast("double")
    size, unit, ten = F.abs(v), 1 << 92, 10**places
    whole = F.floor(size)
    scaled = (size - whole) * float(1 << 62)
    high = F.floor(scaled)
    low = F.floor((scaled - high) * float(1 << 30))
    exact = lambda x: F.lit(str(x)).cast("decimal(29,0)")
    fraction = (high.cast("decimal(19,0)") * F.lit(1 << 30).cast("decimal(10,0)") + low.cast("decimal(10,0)")).cast("decimal(28,0)")
    big = (fraction * F.lit(ten).cast("decimal(6,0)")).cast("decimal(35,0)")
    rest = big % exact(unit)
    digits = F.round((big - rest) / exact(unit)).cast("long")
    up = (rest > exact(unit // 2)) | ((rest == exact(unit // 2)) & (digits % 2 == 1 if places else whole % 2 == 1))
    digits = digits + up.cast("long")
    whole = whole + (digits == ten).cast("long")
    tail = F.concat(F.lit("."), F.lpad((digits % ten).cast("string"), places, "0")) if places else F.lit("")
    made = F.concat(F.when(v < 0, "-").otherwise(""), whole.cast("string"), tail)
    return F.when(size < 1e15, made).otherwise(F.format_string(f"%.{places}f", v))


def number(value: str | Column, places: int = 3) -> Column:
    """A number with fixed places, a dash for null."""
    v = F.col(value) if isinstance(value, str) else value
    return F.when(v.isNull() | F.isnan(v.cast("double")), "—").otherwise(fixed(v, places))


def with_interval(point: str, lo: str, hi: str, places: int = 3) -> Column:
    """'point [lo, hi]', or the bare point if the interval isn't complete."""
    whole = F.concat(number(point, places), F.lit(" ["), number(lo, places), F.lit(", "), number(hi, places), F.lit("]"))
    return F.when(F.col(lo).isNotNull() & F.col(hi).isNotNull(), whole).otherwise(number(point, places))


def joined(rows: DataFrame, order: str, line: Column, keys: list[str] | None = None) -> DataFrame:
    """(keys, text): lines in order, one below the other."""
    made = rows.select(*(keys or []), F.struct(F.col(order).alias("o"), line.alias("l")).alias("s"))
    return made.groupBy(*(keys or [])).agg(F.array_join(F.transform(F.array_sort(F.collect_list("s")), lambda s: s.l), "\n").alias("text"))


def markdown(rows: DataFrame, order: str, cells: list[Column], header: list[str]) -> DataFrame:
    """One row (text): a Markdown table of a report, whose rows are few."""
    line = F.concat(F.lit("| "), F.concat_ws(" | ", *cells), F.lit(" |"))
    head = "| " + " | ".join(header) + " |\n|" + "---|" * len(header)
    return joined(rows, order, line).select(F.concat(F.lit(head + "\n"), "text").alias("text"))


def fill_block(text: Column, key: str, block: Column) -> Column:
    """``text`` with what stands between the key's begin and end marks replaced by the block on lines of its own."""
    safe = F.regexp_replace(block, r"([\\$])", r"\\$1")
    return F.regexp_replace(text, F.lit(f"(?s)(<!-- results:{key} -->).*?(<!-- /results:{key} -->)"), F.concat(F.lit("$1\n"), safe, F.lit("\n$2")))


def inline(texts: DataFrame, refs: DataFrame, key: str = "id", text: str = "text") -> DataFrame:
    """``texts`` with each marked span's content replaced by its reference's number; an unknown reference raises.

    Texts are cut at the marks, references joined to the pieces, and the pieces put together in order.
    """
    cut = F.split(F.col(text), r"(?=<!--r:)|(?<=<!--/r-->)")
    pieces = texts.select(key, F.posexplode(cut).alias("pos", "piece")).withColumn("ref", F.regexp_extract("piece", r"(?s)^<!--r:([\w.]+)-->.*<!--/r-->$", 1))
    both = pieces.join(F.broadcast(refs), "ref", "left")
    value = F.when(F.col("value").isNull(), F.raise_error(F.concat(F.lit("unknown reference "), "ref"))).otherwise(fixed(F.col("value")))
    new = F.when(F.col("ref") == "", F.col("piece")).otherwise(F.concat(F.lit("<!--r:"), "ref", F.lit("-->"), value, F.lit("<!--/r-->")))
    made = both.select(key, F.struct("pos", new.alias("p")).alias("s"))
    return made.groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list("s")), lambda s: s.p), "").alias(text))
