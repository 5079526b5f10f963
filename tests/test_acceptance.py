"""The twelve criteria one by one, and gates at their bounds."""

import pytest

from gleaner.operators import acceptance as A

NAMES = [
    "scale", "no_dominance", "no_leakage", "provenance_and_behavior", "canonical_domain", "representability_and_recon", "tags_backed_by_checks", "unmentioned_behavior_handled", "unsupported_coverage",
    "manifests_present", "expert_source_capped", "generic_input_support",
]


def row(i, **other):
    base = dict(id=str(i), family=f"f{i % 3}", supported=True, measured=True, domain=A.CANONICAL_DOMAIN, tier="gold", target_tokens=[i % 256] * 64, tokenizer_version="v1", tag_issues=[], category=None, mixed=False, image_path="x.png")
    return base | other


def good(n=30):
    refusals = [row(100 + k, supported=False, measured=None, domain=None, tier=None, target_tokens=None, tokenizer_version=None, category=f"c{k}", mixed=k == 3, image_path=None, family=f"f{k % 3}") for k in range(9)]
    return [row(i) for i in range(n)] + refusals


def statuses(spark, rows, leaks=False, models=True, active=None, **more):
    found = A.acceptance(spark.createDataFrame(rows, A.ROW), leaks, models, active, **more).collect()
    assert [r["criterion"] for r in sorted(found, key=lambda r: r["place"])] == ["overall", *NAMES]
    return {r["criterion"]: r["status"] for r in found}


def test_all_pass(spark):
    assert set(statuses(spark, good()).values()) == {"pass"}


@pytest.mark.parametrize("change, criterion, status", [
    (dict(measured=False), "provenance_and_behavior", "fail"), (dict(measured=None), "provenance_and_behavior", "fail"), (dict(domain=None), "canonical_domain", "fail"), (dict(domain="log"), "canonical_domain", "fail"),
    (dict(tier=""), "representability_and_recon", "pending"), (dict(target_tokens=[1] * 63), "representability_and_recon", "pending"), (dict(target_tokens=None), "representability_and_recon", "pending"),
    (dict(target_tokens=[256] * 64), "representability_and_recon", "pending"), (dict(target_tokens=[None] * 64), "representability_and_recon", "pending"), (dict(tokenizer_version=A.TOKEN_PENDING), "representability_and_recon", "pending"),
    (dict(tokenizer_version=None), "representability_and_recon", "pending"), (dict(image_path=None), "generic_input_support", "pending"), (dict(tag_issues=["contradicted:warm"]), "tags_backed_by_checks", "fail"),
])
def test_one_row_is_enough(spark, change, criterion, status):
    got = statuses(spark, [*good(), row(50, **change)])
    assert got.pop(criterion) == status and got.pop("overall") == status and set(got.values()) == {"pass"}


def test_criteria_of_the_whole_set(spark):
    assert statuses(spark, good(), active=(10, 38))["scale"] == "fail" and statuses(spark, good(), active=(39, 39))["scale"] == "pass"
    assert statuses(spark, good() + [row(i, family="f0") for i in range(200, 220)])["no_dominance"] == "fail"
    assert statuses(spark, good(), leaks=True)["overall"] == "fail"
    assert statuses(spark, good(), models=False)["overall"] == "pending"
    both = statuses(spark, [*good(), row(50, tag_issues=["unmentioned_behavior:contrast"])])
    assert both["unmentioned_behavior_handled"] == both["tags_backed_by_checks"] == "fail"
    experts = good() + [row(i, family=A.EXPERTS[i % 2]) for i in range(200, 240)]
    assert statuses(spark, experts)["expert_source_capped"] == "fail" and statuses(spark, experts, waive_experts=True)["expert_source_capped"] == "pass"
    few = [r for r in good() if r["category"] not in ("c7", "c8")]
    assert statuses(spark, few)["unsupported_coverage"] == "pending"
    assert statuses(spark, [r | dict(mixed=False) for r in good()])["unsupported_coverage"] == "pending"
    assert statuses(spark, [r for r in good() if r["supported"]])["unsupported_coverage"] == "pending"
    got = statuses(spark, [])
    assert got["overall"] == "pending" and got["no_dominance"] == "pass" and got["unsupported_coverage"] == "pending"


def verdicts(spark, measured, gates):
    df = spark.createDataFrame(measured, "split string, metric string, k long, n long, low double")
    out = A.gate_verdicts(df, gates)
    return {(r["split"], r["metric"]): r["verdict"] for r in out.collect()}, {r["family"]: r["verdict"] for r in A.families(out).collect()}


def test_gates_at_their_bounds(spark):
    gates = [
        A.Gate("s", "rate", "wilson", "least", 0.8, 100), A.Gate("s", "bad", "wilson", "most", 0.1, 100), A.Gate("s", "delta", "interval", "least", 0.0, 100), A.Gate("s", "sight", "interval", "over", 0.0, 100),
        A.Gate("s", "few", "wilson", "least", 0.1, 100), A.Gate("s", "seen", "diagnostic", "least", None, 10, "diagnostic"), A.Gate("s", "none", "wilson", "least", 0.1, 10, "other"),
    ]
    got, family = verdicts(spark, [("s", "rate", 88, 100, None), ("s", "bad", 3, 100, None), ("s", "delta", 0, 100, 0.0), ("s", "sight", 0, 100, 0.0), ("s", "few", 99, 99, None), ("s", "seen", 1, 5, None)], gates)
    assert got == {("s", "rate"): "pass", ("s", "bad"): "pass", ("s", "delta"): "pass", ("s", "sight"): "fail", ("s", "few"): "not-evaluable-below-min_N", ("s", "seen"): "diagnostic", ("s", "none"): "missing"}
    assert family == {"sft_ship": "fail", "diagnostic": "diagnostic", "other": "pending"}
    got, _ = verdicts(spark, [("s", "rate", 86, 100, None), ("s", "bad", 5, 100, None), ("s", "sight", 0, 100, 1e-9)], gates)
    assert (got["s", "rate"], got["s", "bad"], got["s", "sight"]) == ("fail", "fail", "pass")


def test_a_gate_of_alternatives(spark):
    gates = [A.Gate("x", "d", "interval", "least", 0.0, 50, "or"), A.Gate("y", "d", "interval", "least", 0.0, 50, "or"), A.Gate("x|y", "any", "any_of", "least", 0.05, 50, "or")]
    both = lambda a, b, n=60: verdicts(spark, [("x", "d", 0, 60, a), ("y", "d", 0, n, b)], gates)
    assert both(0.0, 0.06)[0]["x|y", "any"] == "pass" and both(0.0, 0.06)[1] == {"or": "pass"}
    assert both(0.0, 0.04)[0]["x|y", "any"] == "fail"
    assert both(0.0, 0.06, 49)[0]["x|y", "any"] == "fail"  # the better one has too few units
    assert both(-0.1, 0.06)[1] == {"or": "fail"}


def test_the_registry_has_every_gate_once(spark):
    assert len(A.GATES) == 32 and len({(g.split, g.metric) for g in A.GATES}) == 32
    assert {g.kind for g in A.GATES} == {"wilson", "interval", "any_of", "diagnostic"} and all((g.bound is None) == (g.kind == "diagnostic") for g in A.GATES)
    empty, _ = verdicts(spark, [], A.GATES)
    assert set(empty.values()) == {"missing"} and len(empty) == 32
