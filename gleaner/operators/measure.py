"""Dense kernels on whole tables and images: one lookup table (n^3 nodes) or image is a bounded group for a task."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.color import EPS, KAPPA, RGB_XYZ, WHITE, with_lab, with_srgb
from . import lut as L
from .batches import by_groups, starts

# Skin anchors (8-bit sRGB), hue sectors, tone bounds, fill weight and sweeps.
SKIN = ((115, 82, 68), (194, 150, 130), (74, 48, 38), (144, 98, 75), (173, 123, 96), (231, 195, 170))
SECTORS = {"red": 25.0, "orange": 55.0, "yellow": 95.0, "green": 160.0, "cyan": 200.0, "blue": 270.0, "magenta": 330.0}
LIGHT, DARK = 66.0, 33.0
FILL_WEIGHT, FILL_SWEEPS = 8.0, 200


def lab(rgb: np.ndarray) -> np.ndarray:
    light = np.where(rgb <= 0.04045, rgb / 12.92, ((rgb + 0.055) / 1.055) ** 2.4)
    xyz = light @ np.array(RGB_XYZ).T / np.array(WHITE)
    f = np.where(xyz > EPS, np.cbrt(xyz), (KAPPA * xyz + 16) / 116)
    return np.stack([116 * f[:, 1] - 16, 500 * (f[:, 0] - f[:, 1]), 200 * (f[:, 1] - f[:, 2])], axis=1)


def _angle(a, b):
    return np.degrees(np.arctan2(b, a)) % 360


def ciede2000(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Difference of Lab rows, all at once (weights 1)."""
    mean7 = ((np.hypot(p[:, 1], p[:, 2]) + np.hypot(q[:, 1], q[:, 2])) / 2) ** 7
    stretch = 1.5 - 0.5 * np.sqrt(mean7 / (mean7 + 25.0**7))
    ap, aq = p[:, 1] * stretch, q[:, 1] * stretch
    cp, cq = np.hypot(ap, p[:, 2]), np.hypot(aq, q[:, 2])
    hp, hq = _angle(ap, p[:, 2]), _angle(aq, q[:, 2])
    grey = cp * cq == 0
    turn = np.where(grey, 0.0, (hq - hp + 180) % 360 - 180)
    turn = np.where((turn == -180) & (hq > hp), 180.0, turn)
    mid = np.where(grey, hp + hq, np.where(np.abs(hp - hq) <= 180, (hp + hq) / 2, np.where(hp + hq < 360, (hp + hq + 360) / 2, (hp + hq - 360) / 2)))
    cm, lm2 = (cp + cq) / 2, ((p[:, 0] + q[:, 0]) / 2 - 50) ** 2
    cos = lambda x: np.cos(np.radians(x))
    t = 1 - 0.17 * cos(mid - 30) + 0.24 * cos(2 * mid) + 0.32 * cos(3 * mid + 6) - 0.2 * cos(4 * mid - 63)
    dl = (q[:, 0] - p[:, 0]) / (1 + 0.015 * lm2 / np.sqrt(20 + lm2))
    dc = (cq - cp) / (1 + 0.045 * cm)
    dh = 2 * np.sqrt(cp * cq) * np.sin(np.radians(turn / 2)) / (1 + 0.015 * cm * t)
    rotate = -2 * np.sqrt(cm**7 / (cm**7 + 25.0**7)) * np.sin(np.radians(60 * np.exp(-(((mid - 275) / 25) ** 2))))
    return np.sqrt(np.maximum(0, dl**2 + dc**2 + dh**2 + rotate * dc * dh))


def looked_up(table: np.ndarray, rgb: np.ndarray) -> np.ndarray:
    """Trilinear interpolation in a table[r, g, b, channel]."""
    n = table.shape[0]
    at = np.clip(rgb, 0, 1) * (n - 1)
    low = np.minimum(at.astype(int), n - 2)
    part = at - low
    out = np.zeros_like(rgb)
    for corner in range(8):
        bit = np.array([corner & 1, corner >> 1 & 1, corner >> 2 & 1])
        where = low + bit
        out += np.prod(np.where(bit == 1, part, 1 - part), axis=1)[:, None] * table[where[:, 0], where[:, 1], where[:, 2]]
    return out


def _cube(axis: np.ndarray) -> np.ndarray:
    return np.stack(np.meshgrid(axis, axis, axis, indexing="ij"), axis=-1).reshape(-1, 3)


@cache
def _probes() -> dict[str, np.ndarray]:
    """Colours that a table is measured on: a grey ramp, a chart of chromatic colours, skin anchors, typical pixels."""
    ramp = np.repeat(np.linspace(0, 1, 33)[:, None], 3, axis=1)
    chart = _cube(np.linspace(0.05, 0.95, 5))
    chart = chart[np.ptp(chart, axis=1) > 0.15]
    skin = np.array(SKIN) / 255
    calm = _cube(np.linspace(0.2, 0.8, 5))
    calm = calm[np.ptp(calm, axis=1) <= 0.4]
    inner = np.repeat(np.linspace(0, 1, 17)[1:-1, None], 3, axis=1)
    return {"ramp": ramp, "chart": chart, "skin": skin, "typical": np.concatenate([inner, calm, skin])}


@cache
def _before() -> dict[str, np.ndarray]:
    return {k: lab(v) for k, v in _probes().items()}


def _mean(x: np.ndarray, keep: np.ndarray):
    return x[keep].mean(axis=0) if keep.any() else np.zeros(x.shape[1:])


def _direction(v: np.ndarray) -> float:
    return 0.0 if np.abs(v).max() < 1e-9 else float(_angle(v[0], v[1]))


def measured(table: np.ndarray) -> dict[str, float]:
    """The behaviour vector of one absolute table."""
    probes, before = _probes(), _before()
    out = {k: looked_up(table, v) for k, v in probes.items()}
    after = {k: lab(v) for k, v in out.items()}
    n = table.shape[0]
    res = table - _cube(np.linspace(0, 1, n)).reshape(n, n, n, 3)

    tone = after["ramp"] - before["ramp"]
    level = probes["ramp"][:, 0]
    dark, light = level <= 0.25, level >= 0.75
    spread = lambda x: np.percentile(x[:, 0], 95) - np.percentile(x[:, 0], 5)
    chroma = {k: np.hypot(v[:, 1], v[:, 2]) for k, v in (("b", before["chart"]), ("a", after["chart"]))}
    gain = chroma["a"] - chroma["b"]
    shift = (after["chart"] - before["chart"])[:, 1:]
    luma = before["chart"][:, 0]
    zones = {"highlight": luma >= LIGHT, "shadow": luma <= DARK}
    zones["midtone"] = ~(zones["highlight"] | zones["shadow"])
    casts = {z: _mean(shift, keep) for z, keep in zones.items()}
    hues = _angle(before["chart"][:, 1], before["chart"][:, 2])
    gaps = np.abs((hues[:, None] - np.array(list(SECTORS.values())) + 180) % 360 - 180)
    sector = gaps.argmin(axis=1)
    slope = np.gradient(after["ramp"][:, 0], before["ramp"][:, 0])
    grey = after["ramp"] * np.array([1.0, 0, 0])
    neutral = ciede2000(after["ramp"], grey)
    skin = ciede2000(before["skin"], after["skin"])
    turned = np.abs((_angle(after["skin"][:, 1], after["skin"][:, 2]) - _angle(before["skin"][:, 1], before["skin"][:, 2]) + 180) % 360 - 180)
    ratio = np.hypot(after["skin"][:, 1], after["skin"][:, 2]) / np.maximum(np.hypot(before["skin"][:, 1], before["skin"][:, 2]), 1e-6)
    order = np.argsort(before["skin"][:, 0])
    bright = table.mean(axis=3)
    steps = [np.diff(bright, axis=k) for k in range(3)]
    bends = np.concatenate([np.abs(np.diff(res, n=2, axis=k)).ravel() for k in range(3)])
    black, contrast, colour = float(_mean(tone[:, 0], dark)), float(spread(after["ramp"]) - spread(before["ramp"])), float(gain.mean())
    cast = tone[:, 1:].mean(axis=0)
    v = {
        "temperature_delta_b": cast[1], "tint_delta_a": cast[0], "mean_l_delta": tone[:, 0].mean(), "contrast_l_spread_delta": contrast, "black_point_l_delta": black,
        "highlight_l_delta": _mean(tone[:, 0], light), "shadow_l_delta": black, "highlight_chroma_delta": _mean(gain, zones["highlight"]), "shadow_chroma_delta": _mean(gain, zones["shadow"]), "chroma_delta": colour,
        "split_tone_shadow_a": casts["shadow"][0], "split_tone_shadow_b": casts["shadow"][1], "split_tone_highlight_a": casts["highlight"][0], "split_tone_highlight_b": casts["highlight"][1],
        "split_tone_strength": np.hypot(*casts["shadow"]) + np.hypot(*casts["highlight"]), "neutral_drift_deltaE": neutral.mean(), "neutral_drift_deltaE_p95": np.percentile(neutral, 95),
        "skin_locus_deltaE00_mean": skin.mean(), "skin_locus_deltaE00_p95": np.percentile(skin, 95), "skin_locus_hue_drift_deg_p95": np.percentile(turned, 95), "skin_chroma_ratio_min": ratio.min(), "skin_chroma_ratio_max": ratio.max(),
        "clip_rate": ((out["typical"] <= 1e-6) | (out["typical"] >= 1 - 1e-6)).mean(), "smoothness": np.percentile(bends, 99) if bends.size else 0.0, "foldover_rate": sum((s < -0.02).sum() for s in steps) / sum(s.size for s in steps), "residual_norm": np.sqrt((res**2).mean()),
        "global_hue_deg": _direction(cast), "global_hue_magnitude": np.hypot(*cast), **{f"{z}_hue_deg": _direction(casts[z]) for z in ("shadow", "midtone", "highlight")}, **{f"sat_{s}": _mean(gain, sector == i) for i, s in enumerate(SECTORS)},
        "contrast_toe_delta": slope[before["ramp"][:, 0] <= DARK].mean() - 1, "contrast_shoulder_delta": slope[before["ramp"][:, 0] >= LIGHT].mean() - 1,
        "matte_strength": max(0.0, black) + max(0.0, -contrast) + 0.5 * max(0.0, -colour), "skin_lightness_inversions": (np.diff(after["skin"][order, 0]) < -1e-6).sum(),
    }
    return {k: float(x) for k, x in v.items()}


FIELDS = tuple(measured(_cube(np.linspace(0, 1, 3)).reshape(3, 3, 3, 3)))


#: What agreement with a spec and the test for collapse read; the other fields' probes are left out.
REDUCED = (
    "temperature_delta_b", "tint_delta_a", "mean_l_delta", "contrast_l_spread_delta", "black_point_l_delta", "highlight_l_delta", "shadow_l_delta",
    "chroma_delta", "split_tone_strength", "matte_strength", "residual_norm", *[f"sat_{s}" for s in SECTORS],
)


def reduced(tables: np.ndarray) -> dict[str, np.ndarray]:
    """The fields REDUCED of many tables [table, r, g, b, channel] at once, equal to those of `measured`."""
    probes, count, n = _probes(), len(tables), tables.shape[1]
    shown = {}
    for name in ("ramp", "chart"):
        at = np.clip(probes[name], 0, 1) * (n - 1)
        low = np.minimum(at.astype(int), n - 2)
        part, out = at - low, np.zeros((count, len(at), 3))
        for corner in range(8):
            bit = np.array([corner & 1, corner >> 1 & 1, corner >> 2 & 1])
            where = low + bit
            out += np.prod(np.where(bit == 1, part, 1 - part), axis=1)[None, :, None] * tables[:, where[:, 0], where[:, 1], where[:, 2]]
        shown[name] = lab(out.reshape(-1, 3)).reshape(out.shape)
    before = {k: lab(probes[k]) for k in shown}
    tone, level = shown["ramp"] - before["ramp"], probes["ramp"][:, 0]
    spread = lambda x: np.percentile(x, 95, axis=-1) - np.percentile(x, 5, axis=-1)
    gain = np.hypot(shown["chart"][..., 1], shown["chart"][..., 2]) - np.hypot(before["chart"][:, 1], before["chart"][:, 2])
    shift, luma = (shown["chart"] - before["chart"])[..., 1:], before["chart"][:, 0]
    casts = [shift[:, keep].mean(axis=1) if keep.any() else np.zeros((count, 2)) for keep in (luma <= DARK, luma >= LIGHT)]
    hues = _angle(before["chart"][:, 1], before["chart"][:, 2])
    sector = np.abs((hues[:, None] - np.array(list(SECTORS.values())) + 180) % 360 - 180).argmin(axis=1)
    black, contrast, colour = tone[:, level <= 0.25, 0].mean(axis=1), spread(shown["ramp"][..., 0]) - spread(before["ramp"][:, 0]), gain.mean(axis=1)
    res = tables - _cube(np.linspace(0, 1, n)).reshape(n, n, n, 3)
    out = {
        "temperature_delta_b": tone[..., 2].mean(axis=1), "tint_delta_a": tone[..., 1].mean(axis=1), "mean_l_delta": tone[..., 0].mean(axis=1), "contrast_l_spread_delta": contrast, "black_point_l_delta": black,
        "highlight_l_delta": tone[:, level >= 0.75, 0].mean(axis=1), "shadow_l_delta": black, "chroma_delta": colour, "split_tone_strength": sum(np.hypot(c[:, 0], c[:, 1]) for c in casts),
        "matte_strength": np.maximum(0, black) + np.maximum(0, -contrast) + 0.5 * np.maximum(0, -colour), "residual_norm": np.sqrt((res**2).mean(axis=(1, 2, 3, 4))),
    }
    return out | {f"sat_{s}": gain[:, sector == i].mean(axis=1) if (sector == i).any() else np.zeros(count) for i, s in enumerate(SECTORS)}


AT_ONCE = 1 << 18  #: numbers of tables that are dense together, at least one table


def reduced_behavior(tables: DataFrame, key: str) -> DataFrame:
    """tables (key, n, values), as arrays -> (key, REDUCED); tables of a batch that have the same n are measured together."""
    kind = tables.schema[key].dataType.simpleString()

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            sizes = part["n"].to_numpy()
            for n in np.unique(sizes):
                every, many = np.flatnonzero(sizes == n), max(1, AT_ONCE // (3 * int(n) ** 3))
                for at in range(0, len(every), many):
                    rows = every[at : at + many]
                    dense = np.stack([np.asarray(part["values"].iloc[k], float) for k in rows]).reshape(len(rows), n, n, n, 3)
                    yield pd.DataFrame({"key": part["key"].iloc[rows].to_numpy(), **reduced(dense)})

    return tables.select(F.col(key).alias("key"), "n", "values").mapInPandas(run, f"key {kind}, " + ", ".join(f"{f} double" for f in REDUCED)).withColumnRenamed("key", key)


def _dense(part: pd.DataFrame, n: int) -> np.ndarray:
    out = np.zeros((n, n, n, 3))
    out[part["r"], part["g"], part["b"]] = part[["x", "y", "z"]].to_numpy()
    return out


def behavior(nodes: DataFrame, n: int, key: str) -> DataFrame:
    """(key, FIELDS): nodes (key, r, g, b, x, y, z) measured; the tables of a batch are one call."""
    kind = nodes.schema[key].dataType.simpleString()

    def run(part: pa.Table) -> pa.Table:
        first = starts(part, [key])
        of = np.repeat(np.arange(len(first)), np.diff(np.append(first, part.num_rows)))
        dense = np.zeros((len(first), n, n, n, 3))
        dense[of, *(part.column(c).to_numpy() for c in "rgb")] = np.stack([part.column(c).to_numpy() for c in "xyz"], axis=1)
        found = [measured(table) for table in dense]
        return pa.table([part.column(key).take(pa.array(first)), *(pa.array([v[f] for v in found]) for f in FIELDS)], [key, *FIELDS])

    return by_groups(nodes.select(key, *"rgbxyz"), [key], run, f"{key} {kind}, " + ", ".join(f"{f} double" for f in FIELDS))


def scattered_fit(pixels: DataFrame, n: int, key: str) -> DataFrame:
    """pixels (key, u, v, w, x, y, z) -> (key, r, g, b, k, x, y, z): mean target of the pixels nearest to each node."""
    near = [F.rint(F.least(F.greatest(F.col(c), F.lit(0.0)), F.lit(1.0)) * (n - 1)).cast("int").alias(p) for c, p in zip("uvw", "rgb")]
    return pixels.select(key, *near, *"xyz").groupBy(key, *"rgb").agg(F.count("*").alias("k"), *[F.avg(c).alias(c) for c in "xyz"])


def smooth_fill(fitted: DataFrame, n: int, key: str, weight: float = FILL_WEIGHT, sweeps: int = FILL_SWEEPS) -> DataFrame:
    """Complete scattered nodes: each relaxes to its six neighbours' mean, held to its own by k / (k + weight)."""
    plain = _cube(np.linspace(0, 1, n)).reshape(n, n, n, 3)
    place = _cube(np.arange(n))

    def run(part: pd.DataFrame) -> pd.DataFrame:
        at = part["r"], part["g"], part["b"]
        seen, trust = np.zeros((n, n, n, 3)), np.zeros((n, n, n, 1))
        seen[at] = part[["x", "y", "z"]].to_numpy() - plain[at]
        trust[at] = (part["k"] / (part["k"] + weight)).to_numpy()[:, None]
        now = seen.copy()
        for _ in range(sweeps):
            around = np.zeros_like(now)
            for axis in range(3):
                first, last = now.take([0], axis), now.take([-1], axis)
                around += np.concatenate([first, now.take(range(n - 1), axis)], axis) + np.concatenate([now.take(range(1, n), axis), last], axis)
            now = trust * seen + (1 - trust) * around / 6
        done = np.clip(plain + now, 0, 1).reshape(-1, 3)
        return pd.DataFrame({key: part[key].iloc[0], "r": place[:, 0], "g": place[:, 1], "b": place[:, 2], "x": done[:, 0], "y": done[:, 1], "z": done[:, 2]})

    kind = fitted.schema[key].dataType.simpleString()
    return fitted.groupBy(key).applyInPandas(run, f"{key} {kind}, r int, g int, b int, x double, y double, z double")


#: attribute -> (L, a, b) after a change of strength s, as expressions over l, a, b
CHANGES = {
    "warmer": ("l", "a", "b + 8.0D * s"), "cooler": ("l", "a", "b - 8.0D * s"), "tint_magenta": ("l", "a + 6.0D * s", "b"), "tint_green": ("l", "a - 6.0D * s", "b"),
    "brighter": ("l + 8.0D * s", "a", "b"), "darker": ("l - 8.0D * s", "a", "b"), "more_contrast": ("50 + (l - 50) * (1 + 0.2D * s)", "a", "b"), "less_contrast": ("50 + (l - 50) * (1 - 0.2D * s)", "a", "b"),
    "more_saturated": ("l", "a * (1 + 0.25D * s)", "b * (1 + 0.25D * s)"), "muted": ("l", "a * (1 - 0.25D * s)", "b * (1 - 0.25D * s)"),
    "lifted_blacks": ("l + 8.0D * s * greatest(0D, (40 - l) / 40)", "a", "b"), "crushed_blacks": ("l - 8.0D * s * greatest(0D, (40 - l) / 40)", "a", "b"),
    "brighter_highlights": ("l + 6.0D * s * greatest(0D, (l - 60) / 40)", "a", "b"), "softer_highlights": ("l - 6.0D * s * greatest(0D, (l - 60) / 40)", "a", "b"),
}
STRENGTHS = (0.6, 1.0, 1.4)


def procedural(spark: SparkSession, n: int) -> DataFrame:
    """(name, r, g, b, x, y, z): each attribute at each strength, made in Lab on the identity grid."""
    grid = L.grid(spark, n).select("r", "g", "b", *[(F.col(p) / (n - 1)).alias(c) for p, c in zip("rgb", "uvw")])
    base = with_lab(grid, ("u", "v", "w"), ("l", "a", "bb")).withColumnRenamed("b", "pb").withColumnRenamed("bb", "b")
    options = F.explode(F.array(*[F.struct(F.lit(f"{name}_m{i}").alias("name"), *[F.expr(_with(e, s)).alias(f"{c}2") for e, c in zip(change, "lab")]) for name, change in CHANGES.items() for i, s in enumerate(STRENGTHS)]))
    made = base.select("r", "g", "pb", options.alias("o")).select("r", "g", F.col("pb").alias("b"), "o.name", F.least(F.lit(100.0), F.greatest(F.lit(0.0), F.col("o.l2"))).alias("l2"), "o.a2", "o.b2")
    return with_srgb(made, ("l2", "a2", "b2"), ("x", "y", "z")).select("name", "r", "g", "b", "x", "y", "z")


def _with(expression: str, s: float) -> str:
    return expression.replace("* s", f"* {s}D")


def read_png(data: bytes) -> np.ndarray:
    """Pixels of an 8-bit, non-interlaced PNG as (height, width, 3)."""
    if data[:8] != b"\x89PNG\r\n\x1a\n":
        raise ValueError("not a PNG")
    at, packed, palette = 8, b"", None
    while at < len(data):
        size, kind = struct.unpack(">I4s", data[at : at + 8])
        body = data[at + 8 : at + 8 + size]
        at += 12 + size
        if kind == b"IHDR":
            width, height, depth, colour, _, _, interlaced = struct.unpack(">IIBBBBB", body)
        elif kind == b"PLTE":
            palette = np.frombuffer(body, np.uint8).reshape(-1, 3)
        elif kind == b"IDAT":
            packed += body
    if depth != 8 or interlaced:
        raise ValueError("only 8-bit, non-interlaced images")
    step = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}[colour]
    raw = np.frombuffer(zlib.decompress(packed), np.uint8).reshape(height, 1 + width * step)
    rows = np.zeros((height, width * step), np.uint8)
    above = np.zeros(width * step, np.int64)
    for y in range(height):
        rule, line = raw[y, 0], raw[y, 1:].astype(np.int64)
        if rule == 1:
            line = np.cumsum(line.reshape(-1, step), axis=0).ravel()
        elif rule == 2:
            line = line + above
        elif rule in (3, 4):
            for x in range(len(line)):
                left = line[x - step] if x >= step else 0
                corner = above[x - step] if x >= step else 0
                if rule == 3:
                    guess = (left + above[x]) // 2
                else:
                    guess = min((left, above[x], corner), key=lambda v, p=left + above[x] - corner: abs(p - v))
                line[x] = (line[x] + guess) & 255
        rows[y] = line & 255
        above = rows[y].astype(np.int64)
    pixels = rows.reshape(height, width, step)
    if colour == 3:
        return palette[pixels[..., 0]]
    return np.repeat(pixels[..., :1], 3, axis=2) if colour in (0, 4) else pixels[..., :3]


def hald_table(pixels: np.ndarray) -> np.ndarray:
    """The table of a Hald image: side level^3, edge level^2, red fastest along the pixels."""
    level = round(len(pixels) ** (1 / 3))
    if level**3 != len(pixels) or pixels.shape[1] != len(pixels):
        raise ValueError("not a Hald image")
    edge = level * level
    return (pixels.reshape(-1, 3)[: edge**3] / 255).reshape(edge, edge, edge, 3).transpose(2, 1, 0, 3)


def phash(grey: np.ndarray, size: int = 8) -> int:
    """64 bits: which low frequencies of the sampled image's cosine transform exceed their median (mean term apart)."""
    grey = grey.astype(np.float64)
    grey = grey / 255 if grey.max(initial=0) > 1 else grey
    m = size * 4
    pick = lambda k: np.linspace(0, k - 1, m).astype(int)
    small = grey[np.ix_(pick(grey.shape[0]), pick(grey.shape[1]))]
    k = np.arange(m)
    basis = np.cos(np.pi * (2 * k[None, :] + 1) * k[:, None] / (2 * m)) * np.sqrt(2 / m)
    basis[0] /= np.sqrt(2)
    low = (basis @ small @ basis.T)[:size, :size].ravel()
    bits = low > np.median(low[1:])
    return int("".join("1" if b else "0" for b in bits), 2)


def image_hashes(files: DataFrame) -> DataFrame:
    """files (path, content) of PNGs -> (path, phash as a signed long, mean and deviation per channel); unreadable ones are null."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            out = []
            for path, content in zip(part["path"], part["content"]):
                try:
                    pixels = read_png(bytes(content))
                except (ValueError, KeyError, struct.error, zlib.error):
                    out.append((path, None, None))
                    continue
                h = phash(pixels.mean(axis=2))
                stats = [*(pixels / 255).mean(axis=(0, 1)), *(pixels / 255).std(axis=(0, 1))]
                out.append((path, h - (1 << 64) if h >> 63 else h, stats))
            yield pd.DataFrame(out, columns=["path", "phash", "stats"])

    return files.select("path", "content").mapInPandas(run, "path string, phash long, stats array<double>")
