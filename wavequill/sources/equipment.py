"""Recording equipment: channel names and regions of interest, and telling which one made a recording."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

REQUIRED = ("Fz", "Cz", "Pz", "p3a", "p3b", "mmn", "cnv", "scalp", "nonscalp")
OPTIONAL = ("Fp1", "Fp2", "F3", "F4", "C3", "C4", "P3", "P4", "T5", "T6", "Oz")
ALIASES = {"egi256": "egi/256", "egi128": "egi/128", "egi64": "egi/64", "standard": "egi/64"}

# Electrode numbers (from 1) of the EGI regions, channel indices (from 0) of the others, and channel names.
_EGI_256 = {
    "Fz": (6, 7, 14, 15, 16, 22, 23), "Cz": (9, 45, 81, 132, 186), "Pz": (100, 101, 110, 119, 128, 129),
    "Fp1": (26, 27, 32, 33, 34, 37, 38), "Fp2": (11, 12, 18, 19, 20, 25, 26), "F3": (30, 36, 40, 41, 42, 49, 50), "F4": (205, 206, 213, 214, 215, 223, 224),
    "C3": (51, 52, 58, 59, 60, 65, 66), "C4": (155, 164, 182, 183, 184, 195, 196), "P3": (76, 77, 85, 86, 87, 97, 98), "P4": (152, 153, 161, 162, 163, 171, 172),
    "T5": (83, 84, 85, 94, 95, 96, 104, 105, 106), "T6": (169, 170, 171, 177, 178, 179, 189, 190, 191), "Oz": (125, 136, 137, 138, 148),
}
_EGI_128 = {"Fz": (4, 5, 11, 12, 16, 19), "Cz": (7, 31, 55, 80, 106), "Pz": (61, 62, 72, 78)}
_EGI_64 = {"Fz": (3, 6, 8, 9), "Cz": (4, 7, 16, 21, 41, 51, 54), "Pz": (34, 33, 36, 38)}
_BV_32 = {"Fz": (3, 4, 7, 8), "Cz": (7, 8, 12, 17, 18), "Pz": (17, 18, 22, 23, 24), "p3a": (3, 4, 7, 8, 12, 17, 18), "p3b": (7, 8, 12, 17, 18, 22, 23, 24)}
_BIOSEMI_128 = {"Fz": (75, 83, 84, 85, 88), "Cz": (0, 1, 32, 64, 96, 110), "Pz": (3, 4, 18, 19, 31), "p3a": (0, 1, 32, 64, 75, 83, 84, 85, 88, 96, 110), "p3b": (0, 1, 3, 4, 18, 19, 31, 32, 64, 96, 110)}
_BV_32_NAMES = "Fp1 Fp2 F7 F3 F4 F8 FC5 FC1 FC2 FC6 T7 C3 Cz C4 T8 TP9 CP5 CP1 CP2 CP6 TP10 P7 P3 Pz P4 P8 PO9 O1 Oz O2 PO10"
_BV_11_NAMES = "Fp1 Fp2 F3 C4 T3 T4 P3 P4 Pz Oz O2"
_BV_128_NAMES = (
    "Fp1 Fz F3 F7 FT9 FC5 FC1 C3 T7 TP9 CP5 CP1 Pz P3 P7 O1 Oz O2 P4 P8 TP10 CP6 CP2 Cz C4 T8 FT10 FC6 FC2 F4 F8 Fp2 "
    "AF7 AF3 AFz F1 F5 FT7 FC3 FCz C1 C5 TP7 CP3 P1 P5 PO7 PO3 POz PO4 PO8 P6 P2 CPz CP4 TP8 C6 C2 FC4 FT8 F6 F2 AF4 AF8 "
    "F9 AFF1h FFC1h FFC5h FTT7h FCC3h CCP1h CCP5h TPP7h P9 PPO9h PO9 I1 OI1h PPO1h CPP3h CPP4h PPO2h OI2h I2 PO10 PPO10h P10 TPP8h CCP6h CCP2h FCC4h FTT8h FFC6h FFC2h AFF2h F10 "
    "AFp1 AFF5h FFT9h FFT7h FFC3h FCC1h FCC5h FTT9h TTP7h CCP3h CPP1h CPP5h TPP9h PPO5h POO1 POO9h POO10h POO2 PPO6h TPP10h CPP6h CPP2h CCP4h TTP8h FTT10h FCC6h FCC2h FFC4h FFT8h FFT10h AFF6h AFp2"
)

_rois: dict[str, dict[str, tuple[int, ...]]] = {}
_names: dict[str, tuple[str, ...]] = {}


def define(equipment: str, regions: dict[str, Sequence[int]], names: Sequence[str]) -> None:
    """Register an equipment; the nine standard regions must be there, empty ones may be."""
    missing = [r for r in REQUIRED if r not in regions]
    if missing:
        raise ValueError(f"{equipment} lacks the regions {missing}")
    _rois[equipment] = {r: tuple(int(i) for i in ix) for r, ix in regions.items()}
    _names[equipment] = tuple(names)


def _full(own: dict, scalp: range, rest: range, shift: int = 0) -> dict[str, list[int]]:
    """Central regions from their parts: the P3a and MMN regions are Fz and Cz, P3b is Cz and Pz, CNV is Fz, unless given."""
    part = {r: [i - shift for i in own.get(r, ())] for r in (*REQUIRED, *OPTIONAL)}
    front, back = part["p3a"] or part["Fz"] + part["Cz"], part["p3b"] or part["Cz"] + part["Pz"]
    same = own.get("p3a") is not None
    return part | {"p3a": front, "mmn": front, "p3b": back, "cnv": front if same else part["Fz"], "scalp": list(scalp), "nonscalp": list(rest)}


def _in_order(regions: dict[str, list[int]]) -> dict[str, list[int]]:
    return regions | {r: sorted(regions[r]) for r in ("p3a", "p3b", "mmn")}


def _register() -> None:
    numbered = lambda n: [f"E{i}" for i in range(1, n + 1)]
    define("egi/256", _in_order(_full(_EGI_256, range(224), range(224, 256), 1)), numbered(256))
    define("egi/257", _in_order(_full(_EGI_256, range(256), range(256, 257), 1)), numbered(257))
    define("egi/128", _full(_EGI_128, range(124), range(124, 127), 1), numbered(128))
    define("egi/64", _full(_EGI_64, range(64), range(0), 1), numbered(64))
    for n in (64, 32, 16, 8, 4, 2):
        define(f"egi/{n}a", _full({}, range(n), range(0)), numbered(n))
    define("brainvision/32", _full(_BV_32, range(31), range(0)), _BV_32_NAMES.split())
    for name, names in (("brainvision/128", _BV_128_NAMES.split()), ("brainvision/11monkey", _BV_11_NAMES.split())):
        every = tuple(range(len(names)))
        define(name, _full({r: every for r in ("Fz", "Cz", "Pz", "p3a", "p3b")}, range(len(names)), range(0)), names)
    define("biosemi/128", _full(_BIOSEMI_128, range(128), range(0)), [f"{c}{i}" for c in "ABCD" for i in range(1, 33)])


def resolve(equipment: str) -> str:
    name = ALIASES.get(equipment, equipment)
    if name not in _rois:
        raise ValueError(f"unknown equipment {equipment!r}; known are {', '.join(sorted(_rois))}")
    return name


def equipments() -> list[str]:
    return sorted(_rois)


def rois(equipment: str) -> dict[str, tuple[int, ...]]:
    return _rois[resolve(equipment)]


def channel_names(equipment: str) -> tuple[str, ...]:
    return _names[resolve(equipment)]


def roi_channel_names(equipment: str, roi: str) -> list[str]:
    """Names of a region's channels; an index beyond the equipment's channels is an error."""
    names = channel_names(equipment)
    if roi not in rois(equipment):
        raise ValueError(f"{equipment} has no region {roi!r}")
    return [names[i] for i in rois(equipment)[roi]]


def roi_table(spark: SparkSession) -> DataFrame:
    """equipment, roi, pos, ch_idx, channel: a dimension table of a few thousand rows."""
    rows = [(e, r, p, i, _names[e][i]) for e, regions in _rois.items() for r, ix in regions.items() for p, i in enumerate(ix)]
    return spark.createDataFrame(rows, "equipment string, roi string, pos int, ch_idx int, channel string")


def detect(channels: DataFrame, keys: Sequence[str] = ("element",)) -> DataFrame:
    """The equipment of each element by its channel names; elements that match none are an error when read."""
    c = F.col("channel")
    numbered = F.count_if(c.rlike("^E[0-9]+$"))
    classic = F.count_if(c.isin("Fp1", "Fp2", "Fz", "Cz", "Pz", "Oz"))
    lettered = F.count_if(c.rlike("^[ABCD][0-9][0-9]$"))
    name: Column = (
        F.when(numbered >= 200, "egi/256").when(numbered >= 100, "egi/128").when(numbered >= 50, "egi/64")
        .when((classic > 0) & (F.count("*") >= 100), "brainvision/128").when(classic > 0, "brainvision/32").when(lettered > 0, "biosemi/128")
    )
    return channels.groupBy(*keys).agg(F.coalesce(name, F.raise_error(F.lit("no known equipment has these channel names"))).alias("equipment"))


_register()
