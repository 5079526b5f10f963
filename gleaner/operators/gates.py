"""Rule engines: thresholds become reason lists, reason lists become tiers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Safety, smoothness, skin and pair-fit thresholds, and direction floors.
SAFETY = {"clip_rate": 0.005, "out_of_range": 0.03, "foldover_rate": 0.005, "neutral_drift": 3.0}
SMOOTH_CAP, SMOOTH_REJECT = 0.15, 0.30
SKIN = {"hue_drift": 8.0, "delta_e": 12.0, "chroma_low": 0.75, "chroma_high": 1.35}
FIT = {"mean": 3.0, "p95": 7.0, "p99": 10.0, "support": 0.98, "tile": 6.0, "tile_times": 2.5, "component": 0.01, "gold_mean": 2.5}
STRUCTURE = {"xy_r2": (0.05, 0.08), "coord_corr": (0.25, 0.35), "edge_corr": (0.30, 0.40)}
HEADLINE_FIT = 2.5


def reasons(checks: dict[str, Column]) -> Column:
    """Names of the checks that hold, in order."""
    return F.array_compact(F.array(*[F.when(test, F.lit(name)) for name, test in checks.items()]))


def safety_reasons(m: dict[str, Column], tinted: Column) -> Column:
    return reasons({
        "clip_rate_exceeded": m["clip_rate"] > SAFETY["clip_rate"], "pre_clamp_out_of_range": m["out_of_range"] > SAFETY["out_of_range"], "foldover": m["foldover_rate"] > SAFETY["foldover_rate"],
        "smoothness_extreme": m["smoothness"] > SMOOTH_REJECT, "neutral_drift": ~tinted & (m["neutral_drift"] > SAFETY["neutral_drift"]),
    })


def cap_reasons(m: dict[str, Column]) -> Column:
    return reasons({"smoothness": (m["smoothness"] > SMOOTH_CAP) & (m["smoothness"] <= SMOOTH_REJECT)})


def skin_reasons(m: dict[str, Column]) -> Column:
    return reasons({
        "skin_hue_drift": m["hue_drift"] > SKIN["hue_drift"], "skin_deltaE": m["delta_e"] > SKIN["delta_e"], "skin_chroma_low": m["chroma_low"] < SKIN["chroma_low"],
        "skin_chroma_high": m["chroma_high"] > SKIN["chroma_high"], "skin_lightness_order": m["inversions"] > 0,
    })


def direct_tier(safety: Column, skin: Column, cap: Column) -> Column:
    return F.when(F.size(safety) > 0, "rejected").when((F.size(skin) == 0) & (F.size(cap) == 0), "gold").otherwise("diagnostic_only")


def fit_reasons(m: dict[str, Column]) -> Column:
    return reasons({
        "fit_mean_exceeded": m["mean"] > FIT["mean"], "fit_p95_exceeded": m["p95"] > FIT["p95"], "fit_p99_exceeded": m["p99"] > FIT["p99"], "input_support_low": m["support"] < FIT["support"],
        "tile_residual": m["tile"] > F.greatest(F.lit(FIT["tile"]), FIT["tile_times"] * m.get("global_mean", m["mean"])), "high_residual_component": m["component"] > FIT["component"],
    })


def structure_reasons(m: dict[str, Column]) -> Column:
    return reasons({"residual_xy_r2": m["xy_r2"] > STRUCTURE["xy_r2"][0], "coord_correlation": m["coord_corr"] > STRUCTURE["coord_corr"][0], "edge_correlation": m["edge_corr"] > STRUCTURE["edge_corr"][0]})


def fit_tier(hard: Column, structure: Column, m: dict[str, Column], skin: Column, cap: Column) -> Column:
    severe = F.size(structure) >= 2
    for name, (_, ceiling) in STRUCTURE.items():
        severe = severe | (m[name] > ceiling)
    gold = (m["mean"] <= FIT["gold_mean"]) & (m["support"] >= FIT["support"]) & (F.size(skin) == 0) & ~severe & (F.size(cap) == 0)
    return F.when(F.size(hard) > 0, "rejected").when(gold, "gold").otherwise("diagnostic_only")


def eval_slice(split: Column, tier: Column, fit_mean: Column, supported: Column, filler: Column) -> Column:
    """The evaluation slice of a reserved row, or null."""
    headline = ~filler & ((tier == "gold") | ((tier == "diagnostic_only") & F.coalesce(fit_mean <= HEADLINE_FIT, F.lit(False))))
    return (
        F.when(~split.isin("eval", "diagnostic", "qualitative"), F.lit(None)).when(split == "qualitative", "qualitative").when((split == "diagnostic") | ~headline, "diagnostic")
        .when(supported, "usage_weighted_headline_supported").otherwise("usage_weighted_headline_unsupported")
    )
