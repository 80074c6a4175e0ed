"""Numbers and times as people read them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Names of byte units, each 1024 of the one before.
BYTE_UNITS = ["B", "KB", "MB", "GB", "TB", "PB", "EB"]


def bytes_text(value: Column) -> Column:
    """A byte count in the largest unit of which there is one: whole, or with one decimal. Negative counts stay numbers."""
    v = value.cast("double")
    unit = F.least(F.lit(len(BYTE_UNITS) - 1), F.when(v >= 1024, F.floor(F.log2(v) / 10).cast("int")).otherwise(0))
    scaled = v / F.pow(F.lit(1024.0), unit)
    number = F.when(scaled == F.floor(scaled), F.format_string("%.0f", scaled)).otherwise(F.format_string("%.1f", F.bround(scaled, 1)))
    return F.when(v < 0, value.cast("string")).otherwise(F.concat(number, F.lit(" "), F.element_at(F.lit(BYTE_UNITS), unit + 1)))


def duration_text(seconds: float) -> str:
    """1h30m0s, 2m5s, 3.75s, 0s."""
    whole, rest = divmod(abs(seconds), 60)
    minutes = int(whole)
    tail = f"{rest:.9f}".rstrip("0").rstrip(".") + "s"
    out = f"{minutes // 60}h{minutes % 60}m{tail}" if minutes >= 60 else f"{minutes}m{tail}" if minutes else tail
    return ("-" if seconds < 0 else "") + out


def rate(amount: Column, seconds: Column) -> Column:
    """Amount a second; 0 where no time has passed."""
    return F.when(seconds > 0, amount / seconds).otherwise(F.lit(0.0))


def percent(done: Column, total: Column) -> Column:
    return F.when(total > 0, done * 100.0 / total).otherwise(F.lit(0.0))


def entries_text(entries: Column, hide_single: bool = True) -> Column:
    """A map string -> count as "a:1,b:2" by key; blank keys and zero counts are left out; one entry is its key."""
    kept = F.array_sort(F.filter(F.map_entries(entries), lambda e: (F.trim(e["key"]) != "") & (e["value"] != 0)))
    pairs = F.array_join(F.transform(kept, lambda e: F.concat(e["key"], F.lit(":"), e["value"].cast("string"))), ",")
    single = F.when(F.size(kept) == 1, F.get(kept, 0)["key"]) if hide_single else F.when(F.lit(False), "")
    return F.coalesce(F.when(entries.isNull(), F.lit("")), single, pairs)


def milliseconds_text(value: Column) -> Column:
    """Milliseconds as 2h0m3.5s, 4m0s, 1.25s, 70ms or 0s: from a second on in hours, minutes and seconds without zeros at the end. Negative ones are 0s, null stays."""
    ms = F.greatest(value.cast("long"), F.lit(0).cast("long"))
    hours, minutes, rest = F.floor(ms / 3_600_000), F.floor(ms / 60_000) % 60, ms % 60_000
    point = F.when(rest % 1000 == 0, "").otherwise(F.rtrim(F.format_string(".%03d", rest % 1000), F.lit("0")))
    seconds = F.concat(F.floor(rest / 1000).cast("string"), point, F.lit("s"))
    long_ = F.concat(F.when(hours > 0, F.concat(hours.cast("string"), F.lit("h"))).otherwise(""), F.when(ms >= 60_000, F.concat(minutes.cast("string"), F.lit("m"))).otherwise(""), seconds)
    return F.when(value.isNull(), F.lit(None)).when(ms == 0, "0s").when(ms < 1000, F.concat(ms.cast("string"), F.lit("ms"))).otherwise(long_)


def durations_text(durations: Column) -> Column:
    """A map stage -> ms as "a=1.5s,b=70ms" by stage."""
    return F.coalesce(F.array_join(F.transform(F.array_sort(F.map_entries(durations)), lambda e: F.concat(e["key"], F.lit("="), milliseconds_text(e["value"]))), ","), F.lit(""))
