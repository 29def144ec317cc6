"""Choosing channels, regions, conditions and epochs."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources import equipment as eq


def is_numbered(channel: Column) -> Column:
    """Channels named E and digits."""
    return channel.rlike("^E[0-9]+$")


def eeg_channels(signals: DataFrame, keys: Sequence[str] = ("element",)) -> DataFrame:
    """If an element has E-numbered channels exactly those, else those of kind eeg, bad ones included."""
    has = signals.where(is_numbered(F.col("channel"))).select(*keys).distinct().withColumn("__numbered", F.lit(True))
    out = signals.join(has, list(keys), "left")
    kind = F.col("kind") == "eeg" if "kind" in signals.columns else F.lit(True)
    return out.where(F.when(F.col("__numbered"), is_numbered(F.col("channel"))).otherwise(kind)).drop("__numbered")


def resolve_rois(rois: Sequence[int | str] | None, channels: Sequence[str], equipment: str | None = None) -> list[int]:
    """Channel indices in first-occurrence order: indices are checked, names are regions first and then channels.

    A region's members beyond the data are left out. Regions of any equipment can be used: members are
    matched by the equipment's channel names, or by index where these are not in the data.
    """
    out: list[int] = []
    for item in rois or []:
        if isinstance(item, bool) or not isinstance(item, (int, str)):
            raise TypeError(f"region {item!r} is neither an index nor a name")
        if isinstance(item, int):
            if not 0 <= item < len(channels):
                raise ValueError(f"channel index {item} is out of range")
            found = [item]
        elif equipment is not None and item in eq.rois(eq.resolve(equipment)):
            names = eq.channel_names(eq.resolve(equipment))
            found = [channels.index(names[i]) if names[i] in channels else i for i in eq.rois(eq.resolve(equipment))[item] if names[i] in channels or (i < len(channels) and names[i] not in channels)]
        elif item in channels:
            found = [list(channels).index(item)]
        else:
            raise ValueError(f"{item!r} is neither a region nor a channel")
        out += [i for i in found if i not in out]
    return out


def select_channels(signals: DataFrame, indices: Sequence[int]) -> DataFrame:
    """Rows of these ch_idx, with their place in the selection as ``pos``; the list is a literal, so nothing is joined."""
    if not indices:
        return signals.withColumn("pos", F.col("ch_idx"))
    place = F.array_position(F.array(*(F.lit(int(i)) for i in indices)), F.col("ch_idx").cast("int"))
    return signals.where(F.col("ch_idx").isin([int(i) for i in indices])).withColumn("pos", (place - 1).cast("int"))


def in_condition(condition: Column, wanted: str | int | Sequence[str | int], codes: Mapping[str, int] | None = None) -> Column:
    """Conditions by name, by any of their /-separated tags, or by event code."""
    names = []
    for w in [wanted] if isinstance(wanted, (str, int)) else wanted:
        by_code = [n for n, c in (codes or {}).items() if c == w and not isinstance(w, str)]
        names += by_code or [str(w)]
    if codes is not None:
        known = {tag for n in codes for tag in (n, *n.split("/"))}
        missing = [n for n in names if n not in known]
        if missing:
            raise ValueError(f"unknown conditions {missing}")
    tags = F.split(condition, "/")
    met = F.lit(False)
    for n in names:
        wanted_tags = F.array(*(F.lit(t) for t in n.split("/")))
        met = met | (condition == n) | (F.size(F.array_except(wanted_tags, tags)) == 0)
    return met


def placed_channels(channels: DataFrame) -> DataFrame:
    """Channels whose position is finite and not the origin."""
    fine = F.lit(True)
    for c in ("x", "y", "z"):
        fine = fine & F.coalesce(F.abs(F.col(c)) < float("inf"), F.lit(False))
    return channels.where(fine & ((F.abs("x") > 1e-12) | (F.abs("y") > 1e-12) | (F.abs("z") > 1e-12)))


def at_least(count: int, total: int, least: int | float, what: str) -> None:
    """Refuse to go on with fewer than ``least`` left: a number, or a share of the total that is cut down to one."""
    need = int(total * least) if isinstance(least, float) else least
    if count < need:
        raise ValueError(f"{count} of {total} {what} are left, {need} are needed")


def enough(left: Column, total: Column, least: int | float, what: str) -> Column:
    """A condition that holds where ``at_least`` would let pass, and that fails the query elsewhere, when it runs."""
    need = F.floor(total * F.lit(least)) if isinstance(least, float) else F.lit(least)
    said = F.concat(left.cast("string"), F.lit(" of "), total.cast("string"), F.lit(f" {what} are left, "), need.cast("string"), F.lit(" are needed"))
    return F.when(left < need, F.raise_error(said).cast("boolean")).otherwise(F.lit(True))
