"""The Camelot wheel: 12 numbers around, A (minor) and B (major) sides."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Pitch names by pitch class.
PITCHES = ["C", "C#", "D", "D#", "E", "F", "F#", "G", "G#", "A", "A#", "B"]


def wheel(spark: SparkSession) -> DataFrame:
    """(pitch_class, mode, code, key_name), 24 rows. A fifth up is one number on: C major is 8B, A minor 8A."""
    rows = []
    for pc in range(12):
        fifths = pc * 7 % 12
        rows.append((pc, "major", f"{(fifths + 7) % 12 + 1}B", PITCHES[pc]))
        rows.append((pc, "minor", f"{(fifths + 4) % 12 + 1}A", PITCHES[pc] + "m"))
    return spark.createDataFrame(rows, "pitch_class int, mode string, code string, key_name string")


def number(code: Column) -> Column:
    n = F.regexp_extract(F.upper(F.trim(code)), r"^(\d{1,2})[AB]$", 1)
    v = F.when(n != "", n.cast("int"))
    return F.when((v >= 1) & (v <= 12), v)


def letter(code: Column) -> Column:
    return F.when(number(code).isNotNull(), F.right(F.upper(F.trim(code)), F.lit(1)))


def _step(a: Column, b: Column) -> Column:
    return F.least(F.pmod(number(a) - number(b), F.lit(12)), F.pmod(number(b) - number(a), F.lit(12)))


def compatible(a: Column, b: Column) -> Column:
    """Same number, or neighbours on one side; null for a code that is none."""
    return (number(a) == number(b)) | ((letter(a) == letter(b)) & (_step(a, b) == 1))


def distance(a: Column, b: Column) -> Column:
    same, step = letter(a) == letter(b), _step(a, b)
    return F.when(same & (step == 5), 2).otherwise(step + F.when(same, 0).otherwise(1))


def energy_boost(a: Column, b: Column) -> Column:
    return (letter(a) == letter(b)) & (_step(a, b) == 5)


def grade(a: Column, b: Column) -> Column:
    """0 for compatible codes, 1 a lift by five or a diagonal, 2 two steps on one side, 3 a clash."""
    same, step = letter(a) == letter(b), _step(a, b)
    tiers = F.when(step == 0, 0).when(same, F.element_at(F.create_map(*(F.lit(x) for x in (1, 0, 5, 1, 2, 2))), step)).when(step == 1, 1)
    return F.when(step.isNotNull(), F.coalesce(tiers, F.lit(3)))
