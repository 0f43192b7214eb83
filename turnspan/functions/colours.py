"""Speaker colours: lightness from shares of time and turns, hues by the golden angle, and Oklab to
sRGB with the lightness corrected for the Helmholtz-Kohlrausch effect. All of it is column
expressions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Fixed values.
GOLDEN_ANGLE = 137.508
LIGHT_MIN, LIGHT_MAX = 0.325, 0.85
CHROMA = 0.15
COUNT_WEIGHT = 0.5
POWER = 0.33
ADAPTING_LUMINANCE = 63.66
SETS = 10
#: Oklab to long-, medium- and short-wave cone responses (cube roots), these to XYZ, XYZ to linear sRGB.
OKLAB_TO_LMS = ((1.0, 0.3963377773761749, 0.2158037573099136), (1.0, -0.1055613458156586, -0.0638541728258133), (1.0, -0.0894841775298119, -1.2914855480194092))
LMS_TO_XYZ = ((1.2268798758459243, -0.5578149944602171, 0.2813910456659647), (-0.0405757452148008, 1.112286803280317, -0.0717110580655164), (-0.0763729366746601, -0.4214933324022432, 1.5869240198367816))
XYZ_TO_RGB = ((3.2406, -1.5372, -0.4986), (-0.9689, 1.8758, 0.0415), (0.0557, -0.2040, 1.0570))
#: The white point (D65).
WHITE = (0.95047, 1.0, 1.08883)


def lightness(segments: DataFrame, order: str = "turn") -> DataFrame:
    """(file_id, speaker, seconds, turns, first, lightness) of segments (file_id, order, speaker, start, end)."""
    t = segments.groupBy("file_id", "speaker").agg(F.sum(F.col("end") - F.col("start")).alias("seconds"), F.count(F.lit(1)).alias("turns"), F.min(order).alias("first"))
    file = Window.partitionBy("file_id")
    share = lambda c: F.when(F.sum(c).over(file) > 0, F.col(c) / F.sum(c).over(file)).otherwise(F.lit(0.0))
    t = t.withColumn("score", COUNT_WEIGHT * share("turns") + (1 - COUNT_WEIGHT) * (1 - share("seconds")))
    low, high = F.min("score").over(file), F.max("score").over(file)
    level = F.when(high == low, F.lit(0.5)).otherwise(F.pow((F.col("score") - low) / (high - low), F.lit(POWER)))
    return t.withColumn("lightness", LIGHT_MIN + level * (LIGHT_MAX - LIGHT_MIN)).drop("score")


def hues(speakers: DataFrame, sets: int = SETS) -> DataFrame:
    """Adds set (0, 1, ...) and hue to (file_id, speaker, seconds, first, ...), a row for each set;
    speakers are numbered by time, the first to speak before others of equal time."""
    rank = F.row_number().over(Window.partitionBy("file_id").orderBy(F.desc("seconds"), "first")) - 1
    rows = speakers.withColumn("rank", rank).withColumn("set", F.explode(F.sequence(F.lit(0), F.lit(sets - 1))))
    return rows.withColumn("hue", ((F.col("rank") + F.col("set")) * GOLDEN_ANGLE) % 360)


def _product(matrix, v: tuple[Column, ...]) -> tuple[Column, ...]:
    return tuple(sum((F.lit(m) * x for m, x in zip(row[1:], v[1:])), F.lit(row[0]) * v[0]) for row in matrix)


def oklch_to_xyz(light: Column, chroma: Column, hue: Column) -> tuple[Column, ...]:
    turn = F.radians(hue)
    lms = _product(OKLAB_TO_LMS, (light, chroma * F.cos(turn), chroma * F.sin(turn)))
    return _product(LMS_TO_XYZ, tuple(x * x * x for x in lms))


def xyz_to_hex(xyz: tuple[Column, ...]) -> Column:
    """#rrggbb, parts outside sRGB clipped."""

    def part(linear: Column) -> Column:
        coded = F.when(linear <= 0.0031308, linear * 12.92).otherwise(1.055 * F.pow(F.greatest(linear, F.lit(0.0)), F.lit(1 / 2.4)) - 0.055)
        return F.lower(F.lpad(F.hex(F.rint(F.greatest(F.lit(0.0), F.least(F.lit(1.0), coded)) * 255).cast("long")), 2, "0"))

    return F.concat(F.lit("#"), *[part(c) for c in _product(XYZ_TO_RGB, xyz)])


def helmholtz_kohlrausch(xyz: tuple[Column, ...]) -> Column:
    """The factor by which a coloured object looks brighter than a grey one of its luminance
    (Nayatani 1997, variable chromatic colours)."""
    x, y, z = xyz
    sum_ = x + 15 * y + 3 * z
    u, v = (F.when(sum_ == 0, F.lit(0.0)).otherwise(k * c / sum_) for k, c in ((4, x), (9, y)))
    white = WHITE[0] + 15 * WHITE[1] + 3 * WHITE[2]
    du, dv = u - 4 * WHITE[0] / white, v - 9 * WHITE[1] / white
    theta = F.atan2(dv, du)
    q = (
        F.lit(-0.01585)
        - 0.03017 * F.cos(theta) - 0.04556 * F.cos(2 * theta) - 0.02667 * F.cos(3 * theta) - 0.00295 * F.cos(4 * theta)
        + 0.14592 * F.sin(theta) + 0.05084 * F.sin(2 * theta) - 0.01900 * F.sin(3 * theta) - 0.00764 * F.sin(4 * theta)
    )
    adaptation = 0.2717 * (6.469 + 6.362 * ADAPTING_LUMINANCE**0.4495) / (6.469 + ADAPTING_LUMINANCE**0.4495)
    saturation = 13 * F.sqrt(du * du + dv * dv)
    return 1 + (F.lit(-0.1340) * q + 0.0872 * adaptation) * saturation


def colour_sets(segments: DataFrame, sets: int = SETS, order: str = "turn") -> DataFrame:
    """(file_id, set, speaker, lightness, hue, hex): a colour for each speaker in each of the sets."""
    rows = hues(lightness(segments, order), sets)
    plain = oklch_to_xyz(F.col("lightness"), F.lit(CHROMA), F.col("hue"))
    rows = rows.withColumn("factor", helmholtz_kohlrausch(plain))
    shown = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("lightness") / F.col("factor")))
    rows = rows.withColumn("shown", shown)
    return rows.select("file_id", "set", "speaker", "lightness", "hue", xyz_to_hex(oklch_to_xyz(F.col("shown"), F.lit(CHROMA), F.col("hue"))).alias("hex"))


def as_maps(colours: DataFrame) -> DataFrame:
    """(file_id, speaker_color_sets): a map from the set's number to a map from speaker to colour."""
    one = colours.groupBy("file_id", "set").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("speaker", "hex")))).alias("m"))
    packed = F.array_sort(F.collect_list(F.struct(F.col("set").cast("string").alias("k"), F.map_entries("m").alias("e"))))
    return one.groupBy("file_id").agg(F.map_from_entries(F.transform(packed, lambda p: F.struct(p["k"], F.map_from_entries(p["e"])))).alias("speaker_color_sets"))


