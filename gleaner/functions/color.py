"""Colour conversions and differences as Column expressions."""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Linear sRGB to XYZ (D65), the white point, and the hue sectors' centres in degrees.
RGB_XYZ = ((0.4124564, 0.3575761, 0.1804375), (0.2126729, 0.7151522, 0.0721750), (0.0193339, 0.1191920, 0.9503041))
WHITE = (0.95047, 1.0, 1.08883)
SECTORS = {"red": 25.0, "orange": 55.0, "yellow": 95.0, "green": 160.0, "cyan": 200.0, "blue": 270.0, "magenta": 330.0}
ADOBE_GAMMA = 563 / 256
ADOBE_XYZ = ((0.5767309, 0.1855540, 0.1881852), (0.2973769, 0.6273491, 0.0752741), (0.0270343, 0.0706872, 0.9911085))
EPS, KAPPA = 216 / 24389, 24389 / 27


def linear(v: Column) -> Column:
    return F.when(v <= 0.04045, v / 12.92).otherwise(F.pow((v + 0.055) / 1.055, F.lit(2.4)))


def encoded(v: Column) -> Column:
    return F.when(v <= 0.0031308, v * 12.92).otherwise(1.055 * F.pow(v, F.lit(1 / 2.4)) - 0.055)


def with_lab(df: DataFrame, rgb: tuple[str, str, str], out: tuple[str, str, str]) -> DataFrame:
    """Adds L*, a*, b* of sRGB columns in [0, 1]; stages are columns of their own, so each expression stays small."""
    names = [f"_{out[0]}{k}" for k in range(3)]
    df = df.withColumns({n: linear(F.col(c)) for n, c in zip(names, rgb)})
    xyz = {f"{n}x": reduce(lambda a, b: a + b, [F.col(m) * w for m, w in zip(names, row)]) / white for n, row, white in zip(names, RGB_XYZ, WHITE)}
    df = df.withColumns(xyz)
    f = {f"{n}f": F.when(F.col(f"{n}x") > EPS, F.cbrt(f"{n}x")).otherwise((KAPPA * F.col(f"{n}x") + 16) / 116) for n in names}
    df = df.withColumns(f)
    fx, fy, fz = (F.col(f"{n}f") for n in names)
    return df.withColumns({out[0]: 116 * fy - 16, out[1]: 500 * (fx - fy), out[2]: 200 * (fy - fz)}).drop(*names, *xyz, *f)


def with_srgb(df: DataFrame, lab: tuple[str, str, str], out: tuple[str, str, str]) -> DataFrame:
    """Adds sRGB of Lab columns, cut to [0, 1] in linear light; the inverse of with_lab inside the gamut."""
    fy = (F.col(lab[0]) + 16) / 116
    df = df.withColumns({"_f0": fy + F.col(lab[1]) / 500, "_f1": fy, "_f2": fy - F.col(lab[2]) / 200})
    back = lambda f: F.when(F.pow(f, F.lit(3.0)) > EPS, F.pow(f, F.lit(3.0))).otherwise((116 * f - 16) / KAPPA)
    df = df.withColumns({f"_x{i}": back(F.col(f"_f{i}")) * WHITE[i] for i in range(3)})
    inverse = np.linalg.inv(np.array(RGB_XYZ))
    light = {f"_l{i}": F.least(F.lit(1.0), F.greatest(F.lit(0.0), reduce(lambda a, b: a + b, [F.col(f"_x{k}") * float(inverse[i, k]) for k in range(3)]))) for i in range(3)}
    df = df.withColumns(light)
    return df.withColumns({c: encoded(F.col(f"_l{i}")) for i, c in enumerate(out)}).drop(*[f"_{p}{i}" for p in "fxl" for i in range(3)])


def adobe_to_srgb(r: Column, g: Column, b: Column) -> tuple[Column, Column, Column]:
    """Encoded AdobeRGB to encoded sRGB, cut to the smaller gamut in linear light."""
    light = [F.pow(F.greatest(v, F.lit(0.0)), F.lit(ADOBE_GAMMA)) for v in (r, g, b)]
    both = np.linalg.inv(np.array(RGB_XYZ)) @ np.array(ADOBE_XYZ)
    return tuple(encoded(F.least(F.lit(1.0), F.greatest(F.lit(0.0), reduce(lambda a, c: a + c, [v * float(w) for v, w in zip(light, row)])))) for row in both)


def hue(a: Column, b: Column) -> Column:
    return F.pmod(F.degrees(F.atan2(b, a)), F.lit(360.0))


def circular(h: Column, centre: Column | float) -> Column:
    """Distance of two angles in degrees."""
    return F.abs(F.pmod(h - centre + 180.0, F.lit(360.0)) - 180.0)


def sector(h: Column) -> Column:
    """The sector of nearest centre."""
    return F.least(*[F.struct(F.round(circular(h, c), 9).alias("d"), F.lit(i).alias("i"), F.lit(name).alias("name")) for i, (name, c) in enumerate(SECTORS.items())])["name"]


def with_ciede2000(df: DataFrame, one: tuple[str, str, str], two: tuple[str, str, str], out: str = "de") -> DataFrame:
    """Adds the CIEDE2000 difference (weights 1) of two Lab triples, in five stages."""
    c = F.col
    df = df.withColumn("_c7", F.pow((F.hypot(one[1], one[2]) + F.hypot(two[1], two[2])) / 2, F.lit(7.0)))
    df = df.withColumn("_g", 0.5 * (1 - F.sqrt(c("_c7") / (c("_c7") + 25.0**7))))
    df = df.withColumns({"_a1": (1 + c("_g")) * c(one[1]), "_a2": (1 + c("_g")) * c(two[1])})
    df = df.withColumns({"_k1": F.hypot("_a1", one[2]), "_k2": F.hypot("_a2", two[2]), "_h1": F.when((c("_a1") == 0) & (c(one[2]) == 0), 0.0).otherwise(hue(c("_a1"), c(one[2]))), "_h2": F.when((c("_a2") == 0) & (c(two[2]) == 0), 0.0).otherwise(hue(c("_a2"), c(two[2])))})
    gap, none = c("_h2") - c("_h1"), c("_k1") * c("_k2") == 0
    df = df.withColumns({
        "_dh": F.when(none, 0.0).when(gap > 180, gap - 360).when(gap < -180, gap + 360).otherwise(gap),
        "_hm": F.when(none, c("_h1") + c("_h2")).when(F.abs(gap) <= 180, (c("_h1") + c("_h2")) / 2).when(c("_h1") + c("_h2") < 360, (c("_h1") + c("_h2") + 360) / 2).otherwise((c("_h1") + c("_h2") - 360) / 2),
        "_lm": (c(one[0]) + c(two[0])) / 2, "_km": (c("_k1") + c("_k2")) / 2,
    })
    df = df.withColumns({
        "_H": 2 * F.sqrt(c("_k1") * c("_k2")) * F.sin(F.radians(c("_dh") / 2)), "_l5": F.pow(c("_lm") - 50, F.lit(2.0)), "_k7": F.pow("_km", F.lit(7.0)),
        "_t": 1 - 0.17 * F.cos(F.radians(c("_hm") - 30)) + 0.24 * F.cos(F.radians(2 * c("_hm"))) + 0.32 * F.cos(F.radians(3 * c("_hm") + 6)) - 0.20 * F.cos(F.radians(4 * c("_hm") - 63)),
    })
    df = df.withColumns({
        "_sl": (c(two[0]) - c(one[0])) / (1 + 0.015 * c("_l5") / F.sqrt(20 + c("_l5"))), "_sc": (c("_k2") - c("_k1")) / (1 + 0.045 * c("_km")), "_sh": c("_H") / (1 + 0.015 * c("_km") * c("_t")),
        "_rt": -2 * F.sqrt(c("_k7") / (c("_k7") + 25.0**7)) * F.sin(F.radians(60 * F.exp(-F.pow((c("_hm") - 275) / 25, F.lit(2.0))))),
    })
    total = c("_sl") * c("_sl") + c("_sc") * c("_sc") + c("_sh") * c("_sh") + c("_rt") * c("_sc") * c("_sh")
    made = ["_c7", "_g", "_a1", "_a2", "_k1", "_k2", "_h1", "_h2", "_dh", "_hm", "_lm", "_km", "_H", "_l5", "_k7", "_t", "_sl", "_sc", "_sh", "_rt"]
    return df.withColumn(out, F.sqrt(F.greatest(F.lit(0.0), total))).drop(*made)


def lab_sql(r: str, g: str, b: str) -> str:
    """DuckDB: (L, a, b) as SELECT items l, a, b from a sub-select with columns r, g, b; see the plans."""
    lin = lambda v: f"(CASE WHEN {v} <= 0.04045 THEN {v} / 12.92 ELSE (({v} + 0.055) / 1.055) ** 2.4 END)"
    f = []
    for row, white in zip(RGB_XYZ, WHITE):
        x = "((" + " + ".join(f"{lin(v)} * {w}" for v, w in zip((r, g, b), row)) + f") / {white})"
        f.append(f"(CASE WHEN {x} > {EPS} THEN cbrt({x}) ELSE ({KAPPA} * {x} + 16) / 116 END)")
    return f"116 * {f[1]} - 16 AS l, 500 * ({f[0]} - {f[1]}) AS a, 200 * ({f[1]} - {f[2]}) AS b"


def numpy_ciede2000(one, two):
    """The same difference in plain Python, for tests."""
    (l1, a1, b1), (l2, a2, b2) = one, two
    c7 = ((math.hypot(a1, b1) + math.hypot(a2, b2)) / 2) ** 7
    g = 0.5 * (1 - math.sqrt(c7 / (c7 + 25.0**7)))
    a1, a2 = (1 + g) * a1, (1 + g) * a2
    k1, k2 = math.hypot(a1, b1), math.hypot(a2, b2)
    h1, h2 = (math.degrees(math.atan2(b, a)) % 360 if (a, b) != (0, 0) else 0.0 for a, b in ((a1, b1), (a2, b2)))
    d, s = h2 - h1, h1 + h2
    if k1 * k2 == 0:
        dh, hm = 0.0, s
    else:
        dh = d - 360 if d > 180 else d + 360 if d < -180 else d
        hm = s / 2 if abs(d) <= 180 else (s + 360) / 2 if s < 360 else (s - 360) / 2
    lm, km = (l1 + l2) / 2, (k1 + k2) / 2
    cos = lambda x: math.cos(math.radians(x))
    t = 1 - 0.17 * cos(hm - 30) + 0.24 * cos(2 * hm) + 0.32 * cos(3 * hm + 6) - 0.2 * cos(4 * hm - 63)
    sl = (l2 - l1) / (1 + 0.015 * (lm - 50) ** 2 / math.sqrt(20 + (lm - 50) ** 2))
    sc = (k2 - k1) / (1 + 0.045 * km)
    sh = 2 * math.sqrt(k1 * k2) * math.sin(math.radians(dh / 2)) / (1 + 0.015 * km * t)
    rt = -2 * math.sqrt(km**7 / (km**7 + 25.0**7)) * math.sin(math.radians(60 * math.exp(-(((hm - 275) / 25) ** 2))))
    return math.sqrt(max(0.0, sl * sl + sc * sc + sh * sh + rt * sc * sh))
