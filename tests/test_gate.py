"""Decision tables over recorded facts."""

import pytest

from siltstone.rules import gate

D = "a" * 64
CHECK = {"check_run_id": 1, "name": gate.CHECK, "app_id": 7, "head_sha": "h", "conclusion": "failure", "external_id": f"5.1:{D}"}
CONTEXT = {"name": gate.CHECK, "kind": "check_run", "check_run_id": 1, "graphql_app_id": None, "state": "x", "is_required": True}
SPOOF = CONTEXT | {"check_run_id": 2, "graphql_app_id": 9, "state": "SUCCESS", "is_required": False}
RUN = {"run_id": 5, "run_attempt": 1, "run_head_sha": "h", "status": "completed", "verify_step": "failure", "failed_steps": list(gate.FAIL_STEPS), "publish_job": "success", "conditions": dict.fromkeys(gate.CONDITIONS, True)}
STEAL = [{"event": e, "conclusion": "failure", "denied": True, "jobs": [{"steps_run": 0}]} for e in ("push", "pull_request")]
FACTS = {"scenario": "G3", "app_id": 7, "head_sha": "h", "merge_state": "BLOCKED", "mergeable": None, "mergeable_before_ruleset": None, "rules_main": "r", "contexts": [CONTEXT, SPOOF], "rest_checks": [CHECK], "gate_runs": [RUN], "steal_runs": STEAL, "report_digests": {5: D}}


@pytest.fixture(scope="module")
def told(spark):
    variants = {
        "all": FACTS,
        "nothing": dict.fromkeys(FACTS) | {"scenario": "G3"},
        "required": FACTS | {"contexts": [CONTEXT, SPOOF | {"is_required": True}]},
        "open": FACTS | {"merge_state": "CLEAN", "contexts": [SPOOF], "gate_runs": [RUN | {"conditions": RUN["conditions"] | {"event": False, "workflow_path": None}}]},
        "other": FACTS | {"rest_checks": [CHECK | {"external_id": f"6.1:{D}"}], "report_digests": {6: "b"}},
        "stepped": FACTS | {"steal_runs": [STEAL[0] | {"jobs": [{"steps_run": 2}]}], "gate_runs": [RUN | {"status": "queued"}]},
    }
    out = {}
    for name, facts in variants.items():
        row = spark.createDataFrame([facts], gate.FACTS)
        out[name] = {r.rule: (r.status, r.reason) for r in gate.evaluated(row).collect()}
    return out


def test_all_observed(told):
    t = told["all"]
    passing = {k for k, (s, _) in t.items() if s == "PASS"}
    assert passing == set(t) - {"issuer_pinning_independent", "same_app_with_key", "limits_recorded"}
    assert t["issuer_pinning_independent"] == ("NOT_PROVEN", "app_failure_explains_block")


def test_nothing_observed_proves_nothing(told):
    assert {s for s, _ in told["nothing"].values()} == {"NOT_PROVEN"}


def test_failures(told):
    assert told["required"]["impostor_not_required"] == ("FAILED", "impostor_is_required")
    assert told["open"]["spoof_scenario_blocked"] == ("FAILED", "prohibited_change_mergeable")
    assert told["open"]["issuer_pinning_independent"] == ("FAILED", "impostor_satisfied_the_rule")
    assert told["open"]["base_gate_provenance"] == ("FAILED", "gate_condition_false:event")
    assert told["open"]["app_check_required"] == ("NOT_PROVEN", "app_check_absent")
    assert told["other"]["external_id_names_gate_run"] == ("FAILED", "external_id_names_another_run")
    assert told["other"]["report_digest_matches"] == ("FAILED", "report_digest_differs")
    assert told["other"]["environment_refuses_both_events"] == ("FAILED", "app_check_names_a_non_gate_run")
    assert told["stepped"]["no_step_executed"] == ("FAILED", "a_step_executed")
    assert told["stepped"]["verify_step_as_expected"] == ("NOT_PROVEN", "no_completed_gate_run_on_head")
