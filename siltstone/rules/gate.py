"""Evaluation of a merge gate from recorded facts: decision tables in which the first row that holds decides.

A facts row is one scenario. A fact that was not observed is null and never taken for an answer: it gives NOT_PROVEN.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The check's name, the steps of the gate, the expected outcome of each scenario (conclusion, merge state)
# and the impostor of each spoofed one (kind, state).
CHECK = "remediation-gate/verified"
FAIL_STEPS = ("Derive the outputs from the report", "Verify the candidate against the approved contract")
EXPECTED = {
    "G0": ("success", "mergeable"),
    "G1": ("success", "clean"),
    "G2": ("failure", "blocked"),
    "G3": ("failure", "blocked"),
    "G3S": ("failure", "blocked"),
    "G4": ("failure", "blocked"),
    "G5": ("failure", "blocked"),
    "G6": ("failure", "blocked"),
    "G9": ("failure", "mergeable_then_blocked"),
    "G10": ("failure", "blocked"),
    "G11": ("failure", "blocked"),
}
IMPOSTORS = {"G3": ("check_run", "success"), "G3S": ("status", "success"), "G6": ("check_run", "skipped")}
MERGEABLE = ("CLEAN", "UNSTABLE", "HAS_HOOKS")
CONDITIONS = ("event", "workflow_path", "run_head_sha", "subject_is_base", "validator_pinned", "validator_checked_out", "gate_scripts_pinned", "head_env_is_pr_head", "trusted_contract", "no_relaxed_contract", "token_permissions")
_ID = r"^([0-9]+)\.([0-9]+):([0-9a-f]{64})\z"

FACTS = (
    "scenario string, app_id bigint, head_sha string, merge_state string, mergeable string, mergeable_before_ruleset string, rules_main string, "
    "contexts array<struct<name:string,kind:string,check_run_id:bigint,graphql_app_id:bigint,state:string,is_required:boolean>>, "
    "rest_checks array<struct<check_run_id:bigint,name:string,app_id:bigint,head_sha:string,conclusion:string,external_id:string>>, "
    "gate_runs array<struct<run_id:bigint,run_attempt:bigint,run_head_sha:string,status:string,verify_step:string,failed_steps:array<string>,publish_job:string,conditions:map<string,boolean>>>, "
    "steal_runs array<struct<event:string,conclusion:string,denied:boolean,jobs:array<struct<steps_run:int>>>>, report_digests map<bigint,string>"
)


def table(*rows: tuple, otherwise: tuple[str, str]) -> Column:
    """(status, reason) of the first row (condition, status, reason) whose condition is true; null is not."""
    out = None
    for condition, status, reason in rows:
        value = F.struct(F.lit(status).alias("status"), (reason if isinstance(reason, Column) else F.lit(reason)).alias("reason"))
        out = F.when(condition, value) if out is None else out.when(condition, value)
    last = F.struct(F.lit(otherwise[0]).alias("status"), F.lit(otherwise[1]).alias("reason"))
    return last if out is None else out.otherwise(last)


def _by(values: dict[str, str]) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for kv in values.items() for x in kv]), F.col("scenario"))


def _some(array: Column, test) -> Column:  # noqa: ANN001
    return F.coalesce(F.exists(array, lambda x: F.coalesce(test(x), F.lit(False))), F.lit(False))


def prepared(facts: DataFrame) -> DataFrame:
    """Facts with the same-named contexts by origin, the gate run that counts, and the App's check on the head."""
    rest = F.coalesce("rest_checks", F.array().cast("array<struct<check_run_id:bigint,name:string,app_id:bigint,head_sha:string,conclusion:string,external_id:string>>"))

    def origin(c: Column) -> Column:
        own = F.get(F.filter(rest, lambda r: r["check_run_id"] == c["check_run_id"]), F.lit(-1) + F.greatest(F.size(F.filter(rest, lambda r: r["check_run_id"] == c["check_run_id"])), F.lit(1)))
        mine = lambda a: F.when(a.eqNullSafe(F.col("app_id")), "app").otherwise("other_app")
        what = F.when(c["kind"] == "status", "commit_status").when(own.isNotNull(), mine(own["app_id"])).when(c["graphql_app_id"].isNotNull(), mine(c["graphql_app_id"])).otherwise("unknown")
        state = F.when(c["kind"] == "status", c["state"]).otherwise(F.coalesce(own["conclusion"], c["state"]))
        return F.struct(c["kind"].alias("kind"), F.lower(state).alias("state"), c["is_required"].alias("is_required"), what.alias("origin"))

    ctx = F.transform(F.filter("contexts", lambda c: c["name"] == CHECK), origin)
    out = facts.withColumn("ctx", F.when(F.col("contexts").isNotNull() & F.col("rest_checks").isNotNull(), ctx))
    out = out.withColumns({"app": F.filter("ctx", lambda c: c["origin"] == "app"), "impostors": F.filter("ctx", lambda c: c["origin"].isin("other_app", "commit_status")), "unknown": F.size(F.filter("ctx", lambda c: c["origin"] == "unknown")) > 0})
    done = F.filter("gate_runs", lambda r: (r["run_head_sha"] == F.col("head_sha")) & (r["status"] == "completed"))
    apps = F.filter("rest_checks", lambda c: (c["name"] == CHECK) & c["app_id"].eqNullSafe(F.col("app_id")))
    out = out.withColumns({"run": F.get(done, F.size(done) - 1), "apps": apps})
    on_head = F.filter("apps", lambda c: c["head_sha"].eqNullSafe(F.col("head_sha")))
    out = out.withColumn("on_head", on_head).withColumn("check", F.when(F.size("on_head") == 1, F.get("on_head", F.lit(0))))
    part = lambda i: F.regexp_extract(F.coalesce("check.external_id", F.lit("")), _ID, i)
    return out.withColumns({"id_run": part(1).try_cast("bigint"), "id_attempt": part(2).try_cast("bigint"), "id_digest": F.nullif(part(3), F.lit("")), "conclusion": _by({k: v[0] for k, v in EXPECTED.items()}), "want": _by({k: v[1] for k, v in EXPECTED.items()})})


def rules() -> dict[str, Column]:
    """(status, reason) of each rule over prepared() facts."""
    c = F.col
    n, missing, failed, ok = "NOT_PROVEN", lambda reason: ("NOT_PROVEN", reason), lambda reason: ("FAILED", reason), lambda reason: ("PASS", reason)
    unseen = (c("ctx").isNull(), n, "rollup_or_check_source_missing")
    required = _some(c("impostors"), lambda x: x["is_required"])
    untold = _some(c("impostors"), lambda x: x["is_required"].isNull())
    none = F.size("impostors") == 0
    app_required = F.get("app", F.lit(0))["is_required"]
    wanted = F.filter("impostors", lambda x: (x["kind"] == _by({k: v[0] for k, v in IMPOSTORS.items()})) & (x["state"] == _by({k: v[1] for k, v in IMPOSTORS.items()})))
    blocked = [(c("merge_state").isNull(), n, "merge_state_missing"), (c("merge_state") == "BLOCKED", "PASS", "blocked"), (c("merge_state").isin(*MERGEABLE), "FAILED", "prohibited_change_mergeable")]
    passing = _some(c("impostors"), lambda x: x["state"].isin("success", "skipped", "neutral"))
    no_runs, no_run = (c("gate_runs").isNull(), n, "gate_runs_missing"), (c("run").isNull(), n, "no_completed_gate_run_on_head")
    names = F.array(*map(F.lit, CONDITIONS))
    false = F.get(F.filter(names, lambda k: F.coalesce(~F.try_element_at(c("run")["conditions"], k), F.lit(False))), F.lit(0))
    null = F.get(F.filter(names, lambda k: F.try_element_at(c("run")["conditions"], k).isNull()), F.lit(0))
    steps = F.when(c("conclusion") == "success", F.array().cast("array<string>")).otherwise(F.array(*map(F.lit, FAIL_STEPS)))
    ran = _some(c("steal_runs"), lambda r: F.exists(r["jobs"], lambda j: F.coalesce(j["steps_run"], F.lit(0)) > 0))
    open_ = _some(c("steal_runs"), lambda r: r["conclusion"].isNull() | (F.coalesce(F.size(r["jobs"]), F.lit(0)) <= 0))
    ids = F.transform("gate_runs", lambda r: r["run_id"])
    foreign = _some(c("apps"), lambda a: F.coalesce(~F.array_contains(ids, F.regexp_extract(F.coalesce(a["external_id"], F.lit("")), _ID, 1).try_cast("bigint")), F.lit(True)))
    unobserved = c("apps").isNull() | c("gate_runs").isNull()
    events = F.transform("steal_runs", lambda r: r["event"])
    undenied = _some(c("steal_runs"), lambda r: r["event"].isin("pull_request", "push") & ~F.coalesce(r["denied"], F.lit(False)))
    return {
        "impostor_not_required": table(unseen, (required, *failed("impostor_is_required")), (c("unknown"), *missing("context_origin_unknown")), (untold, *missing("impostor_is_required_missing")), (none, *ok("no_impostor_present")), otherwise=ok("impostors_not_required")),
        "app_check_required": table(unseen, (F.size("app") > 1, *missing("app_check_not_unique_in_rollup")), ((F.size("app") == 0) & c("unknown"), *missing("context_origin_unknown")), (F.size("app") == 0, *missing("app_check_absent")), (app_required, *ok("app_check_required")), (~app_required, *failed("app_check_not_required")), otherwise=missing("app_is_required_missing")),
        "same_name_other_source": table(unseen, (required, *failed("impostor_is_required")), (c("unknown"), *missing("context_origin_unknown")), (none, *missing("impostor_not_observed")), ((F.size("app") == 1) & ~app_required, *failed("app_check_not_required")), (untold | (F.size("app") != 1) | app_required.isNull(), *missing("is_required_missing")), otherwise=ok("impostor_present_not_required_app_required")),
        "impostor_required_fails_scenario": table(unseen, (required, *failed("impostor_is_required")), (c("unknown"), *missing("context_origin_unknown")), (none, *missing("impostor_not_observed")), (untold, *missing("impostor_is_required_missing")), otherwise=ok("no_impostor_required")),
        "expected_impostor_not_required": table((~c("scenario").isin(*IMPOSTORS), *missing("not_a_spoof_scenario")), unseen, (_some(wanted, lambda x: x["is_required"]), *failed("impostor_is_required")), ((F.size(wanted) == 0) & c("unknown"), *missing("context_origin_unknown")), (F.size(wanted) == 0, *missing("expected_impostor_not_observed")), (_some(wanted, lambda x: x["is_required"].isNull()), *missing("impostor_is_required_missing")), otherwise=ok("expected_impostor_not_required")),
        "merge_state_as_expected": table(
            (c("want").isNull(), *missing("no_expectation")),
            ((c("want") == "mergeable") & c("mergeable").isNull(), *missing("merge_state_missing")),
            ((c("want") == "mergeable") & (c("mergeable") == "MERGEABLE"), *ok("mergeable")),
            ((c("want") == "mergeable") & ((c("mergeable") == "CONFLICTING") | (c("merge_state") == "BLOCKED")), *failed("not_mergeable_without_ruleset")),
            (c("want") == "mergeable", *missing("mergeability_unsettled")),
            ((c("want") == "mergeable_then_blocked") & c("mergeable_before_ruleset").isNull(), *missing("merge_state_missing")),
            (c("merge_state").isNull(), *missing("merge_state_missing")),
            ((c("want") == "mergeable_then_blocked") & (c("mergeable_before_ruleset") != "MERGEABLE"), *missing("not_mergeable_before_ruleset")),
            ((c("want") == "clean") & (c("merge_state") == "CLEAN"), *ok("clean")),
            ((c("want") == "clean") & (c("merge_state") == "BLOCKED"), *failed("correct_change_blocked")),
            (c("want") == "clean", *missing("merge_state_unsettled")),
            *blocked,
            otherwise=missing("merge_state_unsettled"),
        ),
        "spoof_scenario_blocked": table(*blocked, otherwise=missing("merge_state_unsettled")),
        "issuer_pinning_independent": table(unseen, (c("unknown"), *missing("context_origin_unknown")), (~passing, *missing("no_passing_impostor")), (_some(c("app"), lambda x: x["state"] == "failure"), *missing("app_failure_explains_block")), (c("rules_main").isNull(), *missing("effective_rules_missing")), (c("merge_state").isNull(), *missing("merge_state_missing")), ((c("merge_state") == "BLOCKED") & (F.size("app") == 0), *ok("blocked_with_only_an_impostor")), (c("merge_state").isin(*MERGEABLE) & (F.size("app") == 0), *failed("impostor_satisfied_the_rule")), otherwise=missing("app_check_present_or_state_unsettled")),
        "base_gate_provenance": table(no_runs, no_run, (false.isNotNull(), "FAILED", F.concat(F.lit("gate_condition_false:"), false)), (c("run")["conditions"].isNull() | null.isNotNull(), n, F.concat(F.lit("gate_fact_missing:"), F.coalesce(null, F.lit(CONDITIONS[0])))), otherwise=ok("base_gate")),
        "verify_step_as_expected": table((c("want").isNull(), *missing("no_expectation")), no_runs, no_run, (c("run")["verify_step"].isNull() | c("run")["failed_steps"].isNull(), *missing("verify_step_missing")), ((c("run")["verify_step"] != c("conclusion")) | (F.array_sort(c("run")["failed_steps"]) != steps), *failed("verify_step_not_as_expected")), (c("run")["publish_job"].isNull(), *missing("publish_job_missing")), (c("run")["publish_job"] != "success", *failed("decision_not_published")), otherwise=ok("verify_step_as_expected")),
        "exactly_one_app_check": table((c("apps").isNull(), *missing("check_runs_missing")), (F.size("on_head") == 1, *ok("one_app_check")), (F.size("on_head") > 1, *failed("several_app_checks")), otherwise=missing("app_check_absent")),
        "external_id_names_gate_run": table((unobserved, *missing("check_runs_or_gate_runs_missing")), (c("check").isNull(), *missing("app_check_not_unique")), (c("id_digest").isNull(), *failed("external_id_malformed")), no_run, (~(c("id_run").eqNullSafe(c("run")["run_id"]) & c("id_attempt").eqNullSafe(c("run")["run_attempt"])), *failed("external_id_names_another_run")), otherwise=ok("external_id_names_gate_run")),
        "report_digest_matches": table((c("check").isNull(), *missing("app_check_not_unique")), (c("id_digest").isNull(), *missing("external_id_malformed")), (~F.coalesce(F.map_contains_key("report_digests", c("id_run")), F.lit(False)), *missing("report_artifact_missing")), (F.try_element_at("report_digests", c("id_run")).isNull(), *failed("report_payload_digest_inconsistent")), (F.try_element_at("report_digests", c("id_run")) == c("id_digest"), *ok("report_digest_matches")), otherwise=failed("report_digest_differs")),
        "conclusion_as_expected": table((c("want").isNull(), *missing("no_expectation")), (c("rest_checks").isNull(), *missing("check_runs_missing")), (c("check").isNull(), *missing("app_check_not_unique")), (c("check")["conclusion"].isNull(), *missing("conclusion_missing")), (c("check")["conclusion"] == c("conclusion"), *ok("conclusion_as_expected")), otherwise=failed("conclusion_differs")),
        "no_step_executed": table((c("steal_runs").isNull(), *missing("steal_runs_missing")), (F.size("steal_runs") == 0, *missing("no_steal_run")), (ran, *failed("a_step_executed")), (open_, *missing("run_not_concluded_or_jobs_missing")), otherwise=ok("no_step_executed")),
        "app_checks_name_gate_runs": table((unobserved, *missing("check_runs_or_gate_runs_missing")), (foreign, *failed("app_check_names_a_non_gate_run")), (F.size("apps") == 0, *missing("app_check_absent")), otherwise=ok("all_app_checks_name_gate_runs")),
        "environment_refuses_both_events": table((c("steal_runs").isNull(), *missing("steal_runs_missing")), (ran, *failed("a_step_executed")), (~unobserved & foreign, *failed("app_check_names_a_non_gate_run")), (~(F.array_contains(events, "pull_request") & F.array_contains(events, "push")), *missing("not_both_events_observed")), (undenied, *missing("denial_reason_not_observed")), (open_ | unobserved | (F.size("apps") == 0), *missing("steps_or_app_checks_not_shown")), otherwise=ok("environment_refused_both_events")),
        "same_app_with_key": table(otherwise=missing("limit_same_app_with_key")),
        "limits_recorded": table(*[(c("scenario") == s, n, r) for s, r in {"G8": "needs_a_merge", "AC28": "needs_a_write_only_second_account", "admin_bypass": "needs_a_merge_attempt", "same_app_with_key": "limit_same_app_with_key"}.items()], otherwise=missing("limit")),
    }


def evaluated(facts: DataFrame, keys: tuple[str, ...] = ("scenario",)) -> DataFrame:
    """(keys, rule, status, reason): a row a row of facts and rule."""
    each = F.array(*[F.struct(F.lit(name).alias("rule"), value["status"].alias("status"), value["reason"].alias("reason")) for name, value in rules().items()])
    return prepared(facts).select(*keys, F.inline(each))
