"""What a training set and a model must meet: twelve acceptance criteria, and a registry of gates on evaluation slices."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import stats as S

PASS, FAIL, PENDING = "pass", "fail", "pending"
# Sizes of the active set, the largest share of a family, codes of a target, what refusals must cover,
# the canonical domain, and the cap of both expert sources together.
ACTIVE = (10_000, 15_000)
DOMINANT, TOKENS, CODEBOOK, CATEGORIES = 0.5, 64, 256, 8
CANONICAL_DOMAIN = "srgb_display_encoded_17_trilinear"  # a name of our own: give `domain` what the rows call it
EXPERTS, EXPERT_CAP = ("ppr10k_derived", "fivek_derived"), 0.50
TOKEN_PENDING = "pending_tokenizer"

#: A training row: what the criteria read of it.
ROW = (
    "id string, family string, supported boolean, measured boolean, domain string, tier string, target_tokens array<int>, tokenizer_version string, "
    "tag_issues array<string>, category string, mixed boolean, image_path string"
)


def acceptance(rows: DataFrame, leaks: bool, models_present: bool, active: tuple[int, int] | None = ACTIVE, waive_experts: bool = False, domain: str = CANONICAL_DOMAIN) -> DataFrame:
    """(place, criterion, status, count) of the twelve criteria and `overall`: any that fails, then any that is pending, else pass.

    rows: as ROW.  active: bounds of the number of rows, or None to leave it open.  count is what the criterion counted against it.
    One pass over the rows; families are counted beside it.
    """
    has = F.col("supported")
    codes = (F.size("target_tokens") == TOKENS) & F.forall("target_tokens", lambda t: t.isNotNull() & t.between(0, CODEBOOK - 1))
    made = F.coalesce(codes & F.col("tokenizer_version").isNotNull() & ~F.col("tokenizer_version").isin("", TOKEN_PENDING), F.lit(False))
    issues = F.coalesce(F.col("tag_issues"), F.array().cast("array<string>"))
    blank = lambda c: F.coalesce(F.col(c), F.lit("")) == ""
    facts = rows.agg(
        F.count("*").alias("n"), F.count_if(has).alias("supported"), F.count_if(has & ~F.coalesce("measured", F.lit(False))).alias("unmeasured"),
        F.count_if(has & ~F.col("domain").eqNullSafe(F.lit(domain))).alias("off_domain"), F.count_if(has & (blank("tier") | ~made)).alias("unmaterialized"),
        F.coalesce(F.sum(F.size(issues)), F.lit(0)).alias("issues"), F.coalesce(F.sum(F.size(F.filter(issues, lambda i: F.contains(i, F.lit("unmentioned_behavior"))))), F.lit(0)).alias("unmentioned"),
        F.count_if(~has).alias("refusals"), F.countDistinct(F.when(~has & ~blank("category"), F.col("category"))).alias("categories"), F.coalesce(F.bool_or(~has & F.coalesce("mixed", F.lit(False))), F.lit(False)).alias("mixed"),
        F.count_if(has & blank("image_path")).alias("no_image"),
    )
    by = rows.groupBy(F.coalesce("family", F.lit("unknown")).alias("family")).agg(F.count("*").alias("k"))
    families = by.agg(F.coalesce(F.max("k"), F.lit(0)).alias("largest"), F.coalesce(F.sum(F.when(F.col("family").isin(*EXPERTS), F.col("k"))), F.lit(0)).alias("experts"))
    c, n = F.col, F.col("n")
    covered = (c("refusals") > 0) & c("mixed") & (c("categories") >= CATEGORIES)
    checks: list[tuple[str, Column, str, Column]] = [  # name, whether it holds, what it is if not, count
        ("scale", F.lit(True) if active is None else n.between(*active), FAIL, n),
        ("no_dominance", c("largest") <= DOMINANT * n, FAIL, c("largest")),
        ("no_leakage", F.lit(not leaks), FAIL, F.lit(int(leaks))),
        ("provenance_and_behavior", c("unmeasured") == 0, FAIL, c("unmeasured")),
        ("canonical_domain", c("off_domain") == 0, FAIL, c("off_domain")),
        ("representability_and_recon", c("unmaterialized") == 0, PENDING, c("unmaterialized")),
        ("tags_backed_by_checks", c("issues") == 0, FAIL, c("issues")),
        ("unmentioned_behavior_handled", c("unmentioned") == 0, FAIL, c("unmentioned")),
        ("unsupported_coverage", covered, PENDING, c("categories")),
        ("manifests_present", F.lit(models_present), PENDING, F.lit(int(not models_present))),
        ("expert_source_capped", F.lit(waive_experts) | (c("experts") <= EXPERT_CAP * n), FAIL, c("experts")),
        ("generic_input_support", c("no_image") == 0, PENDING, c("no_image")),
    ]
    each = F.array(*[F.struct(F.lit(i + 1).alias("place"), F.lit(name).alias("criterion"), F.when(holds, PASS).otherwise(other).alias("status"), count.cast("long").alias("count")) for i, (name, holds, other, count) in enumerate(checks)])
    found = facts.crossJoin(F.broadcast(families)).withColumn("each", each)
    worst = F.when(F.exists("each", lambda e: e["status"] == FAIL), FAIL).when(F.exists("each", lambda e: e["status"] == PENDING), PENDING).otherwise(PASS)
    overall = F.struct(F.lit(0).alias("place"), F.lit("overall").alias("criterion"), worst.alias("status"), F.size(F.filter("each", lambda e: e["status"] != PASS)).cast("long").alias("count"))
    return found.select(F.explode(F.concat(F.array(overall), "each")).alias("e")).select("e.*")


@dataclass(frozen=True)
class Gate:
    """A metric of a slice, the side and bound that its interval must keep to, and the units it needs.

    kind: wilson (of k out of n), interval (a lower bound that is given), any_of (one of the members' lower bounds) or diagnostic.
    """

    split: str
    metric: str
    kind: str
    side: str  #: least or most; over: strictly more
    bound: float | None
    units: int
    family: str = "sft_ship"


_RATE, _PAIR = "supported_prompt_to_lut_pass_rate", "supported_prompt_to_lut_pass_rate_vs_"
_HEAD, _SIGHT, _HARD = "eval_usage_weighted_headline", "eval_image_sensitivity", "sft_ship_renderer_hard_or_group"
# The registry of gates.
GATES = [
    Gate(_HEAD, "free_generation_valid_token_rate", "wilson", "least", 0.85, 350),
    Gate(_HEAD, _RATE, "wilson", "least", 0.60, 350),
    Gate(_HEAD, _PAIR + "best_null", "interval", "least", 0.30, 350),
    Gate(_HEAD, _PAIR + "best_constant", "interval", "least", 0.20, 350),
    Gate(_HEAD, _PAIR + "deterministic_renderer", "interval", "least", 0.10, 350),
    Gate(_HEAD, "unsupported_recall", "wilson", "least", 0.80, 200),
    Gate(_HEAD, "unsupported_precision", "wilson", "least", 0.80, 200),
    Gate(_HEAD, "over_refusal_rate", "wilson", "most", 0.10, 350),
    Gate(_HEAD, "over_refusal_rate_vs_deterministic_renderer", "diagnostic", "most", None, 800, "diagnostic"),
    Gate(_HEAD, "safety_failure_rate_vs_deterministic_renderer", "diagnostic", "most", None, 800, "diagnostic"),
    Gate(_HEAD, "safety_failure_rate", "wilson", "most", 0.05, 350),
    Gate("eval_unsupported_mixed", "mixed_unsupported_recall", "wilson", "least", 0.80, 100),
    Gate("eval_boundary_pairs", "boundary_f1", "interval", "least", 0.80, 100),
    Gate("eval_boundary_pairs", "near_boundary_pair_accuracy", "wilson", "least", 0.85, 100),
    Gate(_SIGHT, _PAIR + "prompt_only_image_blind", "interval", "least", 0.10, 100),
    Gate(_SIGHT, _PAIR + "blank_image", "interval", "over", 0.0, 100),
    Gate(_SIGHT, _PAIR + "shuffled_image", "interval", "over", 0.0, 100),
    Gate("eval_subtle_control", _PAIR + "deterministic_renderer", "interval", "least", 0.0, 150, _HARD),
    Gate("eval_style_discriminability", _PAIR + "deterministic_renderer", "interval", "least", 0.0, 150, _HARD),
    Gate("eval_subtle_control|eval_style_discriminability", "renderer_hard_or_group_delta", "any_of", "least", 0.05, 150, _HARD),
    Gate("eval_real_world_cli_inputs", "product_robustness_report", "diagnostic", "least", None, 100, "diagnostic"),
    Gate("eval_in_distribution_regression", "holdout_token_accuracy", "interval", "least", -0.02, 100),
    Gate("eval_unseen_wording", "unseen_wording_valid_token_rate", "wilson", "least", 0.85, 100, "diagnostic"),
    Gate("eval_named_concept", "named_concept_component_match_rate", "wilson", "least", 0.70, 100, "diagnostic"),
    Gate("eval_nonce_concept", "nonce_concept_component_match_rate", "wilson", "least", 0.70, 100, "diagnostic"),
    Gate("eval_counterfactual_ranking", "counterfactual_ranking_margin", "interval", "over", 0.0, 100, "diagnostic"),
    Gate("eval_paraphrase_consistency", "paraphrase_group_consistency", "wilson", "least", 0.80, 100, "diagnostic"),
    Gate("eval_refuse_out_of_scope", "refuse_out_of_scope_recall", "wilson", "least", 0.80, 200),
    Gate("eval_refuse_out_of_gamut", "refuse_out_of_gamut_recall", "wilson", "least", 0.80, 100),
    Gate("eval_interpreter", "attribute_f1", "interval", "least", 0.70, 150, "diagnostic"),
    Gate("eval_interpreter", "route_accuracy", "wilson", "least", 0.85, 150, "diagnostic"),
    Gate("eval_interpreter", "interpreter_over_refusal_rate", "wilson", "most", 0.10, 150, "diagnostic"),
]


def gate_verdicts(measured: DataFrame, gates: list[Gate] = GATES) -> DataFrame:
    """measured (split, metric, k, n, low) -> (place, split, metric, family, n, bound, value, verdict) for every gate of the registry.

    value: the end of the interval that is held against the bound; for `any_of` the largest of its member splits' lows,
    among those with enough units.  A gate without a measurement is `missing`, one with too few units `not-evaluable-below-min_N`.
    """
    spark = measured.sparkSession
    listed = spark.createDataFrame([(i + 1, g.split, g.metric, g.kind, g.side, g.bound, g.units, g.family) for i, g in enumerate(gates)], "place int, split string, metric string, kind string, side string, bound double, units int, family string")
    members = listed.where("kind = 'any_of'").select("place", "units", F.explode(F.split("split", "\\|")).alias("split"))
    of_member = {(g.split, i + 1): [o.metric for o in gates if o.split in g.split.split("|") and o.kind == "interval"][:1] for i, g in enumerate(gates) if g.kind == "any_of"}
    metric_of = spark.createDataFrame([(place, m) for (_, place), ms in of_member.items() for m in ms], "place int, metric string")
    grouped = members.join(F.broadcast(metric_of), "place").join(measured, ["split", "metric"]).groupBy("place").agg(F.max("n").alias("m_n"), F.max(F.when(F.col("n") >= F.col("units"), F.col("low"))).alias("m_low"))
    rows = listed.join(measured, ["split", "metric"], "left")
    rows = rows.join(grouped, "place", "left").withColumn("n", F.coalesce("n", "m_n"))
    lower, upper = S.wilson(F.col("k"), F.col("n"))
    value = F.when(F.col("kind") == "any_of", F.col("m_low")).when(F.col("kind") == "interval", F.col("low")).when(F.col("side") == "most", upper).otherwise(lower)
    rows = rows.withColumn("value", F.when((F.col("kind") != "diagnostic") & (F.coalesce("n", F.lit(0)) >= F.col("units")), value))
    kept = F.when(F.col("side") == "most", F.col("value") <= F.col("bound")).when(F.col("side") == "over", F.col("value") > F.col("bound")).otherwise(F.col("value") >= F.col("bound"))
    verdict = F.when(F.col("n").isNull(), "missing").when(F.col("kind") == "diagnostic", "diagnostic").when(F.col("value").isNull(), "not-evaluable-below-min_N").when(kept, PASS).otherwise(FAIL)
    return rows.select("place", "split", "metric", "family", F.coalesce("n", F.lit(0)).cast("long").alias("n"), "bound", "value", verdict.alias("verdict"))


def families(verdicts: DataFrame) -> DataFrame:
    """(family, verdict, gates, passed): a family passes when all of its gates do, fails when one does, and is pending else; the
    group of alternatives passes when its `any_of` gate does and no member fails."""
    by = verdicts.groupBy("family").agg(F.count("*").alias("gates"), F.count_if(F.col("verdict") == PASS).alias("passed"), F.count_if(F.col("verdict") == FAIL).alias("failed"))
    told = F.when(F.col("family") == "diagnostic", "diagnostic").when(F.col("failed") > 0, FAIL).when(F.col("passed") == F.col("gates"), PASS).otherwise(PENDING)
    return by.select("family", told.alias("verdict"), "gates", "passed")
