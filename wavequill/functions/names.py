"""Scalar functions on entity names, paths and labels, as Column builders."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

ENTITIES = ("sub", "ses", "task", "acq", "run")


def strip_prefix(value: Column, entity: str) -> Column:
    """An entity's value without its BIDS prefix; empty is null."""
    return F.nullif(F.regexp_replace(value, f"^{entity}-", ""), F.lit(""))


def entity_from_name(name: Column, entity: str) -> Column:
    """An entity's value found in a file name; null where it has none."""
    return F.nullif(F.regexp_extract(name, f"(?:^|_|/){entity}-([a-zA-Z0-9]+)", 1), F.lit(""))


def normalise_subject(value: Column) -> Column:
    """Subject ids that mean the same: trimmed, without sub-, and without leading zeros if only digits are left."""
    bare = F.regexp_replace(F.trim(value), "(?i)^sub-", "")
    return F.when(bare.rlike("^[0-9]+$"), F.regexp_replace(bare, "^0+(?=[0-9])", "")).otherwise(bare)


def bids_path(subject: Column, session: Column, task: Column, acq: Column, run: Column, base: str | None, suffix: str | None, extension: str) -> Column:
    """sub-X/[ses-Y/]eeg/sub-X[_ses-Y][_task-][_acq-][_run-][_desc-base][_suffix].extension; empty entities are left out."""
    has = lambda c, e: F.concat(F.lit(f"{e}-"), strip_prefix(c, e))
    sub, ses = has(subject, "sub"), has(session, "ses")
    name = F.concat_ws("_", sub, ses, has(task, "task"), has(acq, "acq"), has(run, "run"), F.lit(f"desc-{base}" if base else None).cast("string"), F.lit(suffix).cast("string"))
    return F.concat_ws("/", sub, ses, F.lit("eeg"), F.concat(name, F.lit("." + extension.lstrip("."))))


def pair_name(first: Column, second: Column) -> Column:
    return F.concat_ws("-", first, second)


def frequency_name(freq: Column) -> Column:
    return F.format_string("freq_%.2fHz", freq)


def stage_name(path: str) -> str:
    """The stage that an intermediate file's name tells: its stem without number and _eeg."""
    stem = re.sub(r"\.[^.]*$", "", path.rstrip("/").rpartition("/")[2])
    return re.sub(r"_eeg$", "", re.sub(r"^\d+[_-]", "", stem))


def subject_of(columns: Sequence[str], last: str = "element") -> Column:
    """Whose row it is: the first of subject, subject_id and sub that is there and not null, else the ``last`` column."""
    known = [c for c in ("subject", "subject_id", "sub", last) if c in columns]
    return F.coalesce(*(F.col(c).cast("string") for c in known)) if known else F.lit(None).cast("string")
