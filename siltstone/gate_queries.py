"""The decision tables of a merge gate over facts made from the customers' keys, with DuckDB SQL that states each table anew."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.rules import gate

_SCENARIOS = ("G0", "G9", "G1", "G2", "G3", "G3S", "G6", "G8", "AC28", "admin_bypass", "same_app_with_key", "GX")
_DIGEST = "a" * 64
#: What is drawn from a key: name, divisor, how many values. A key divided, by the number of values, gives the value's place.
_DRAWN = (
    ("scen", 1, 12), ("ms", 2, 5), ("mg", 3, 3), ("mb", 5, 3), ("cx", 7, 6), ("ir", 11, 3), ("st", 13, 2), ("ik", 17, 2), ("ar", 19, 3), ("rc", 23, 3), ("hd", 29, 2), ("ex", 31, 3),
    ("gr", 37, 4), ("vs", 41, 3), ("fs", 43, 2), ("pj", 47, 3), ("cd", 53, 3), ("sr", 59, 6), ("rd", 61, 4), ("rl", 67, 2), ("na", 71, 3),
)
_STATES, _MERGES, _FLAGS = (None, "BLOCKED", "CLEAN", "UNSTABLE", "DIRTY"), (None, "MERGEABLE", "CONFLICTING"), (None, True, False)


def _of(name: str, values: tuple, kind: str = "string") -> Column:
    return F.get(F.array(*[F.lit(v).cast(kind) for v in values]), F.col(name))


def _struct(**fields: Column) -> Column:
    return F.struct(*[v.alias(k) for k, v in fields.items()])


def facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A facts row a customer: checks, contexts, runs and states in all kinds of combinations, present, absent and null."""
    key = F.col("c_custkey")
    rows = spark.read.parquet(f"{sf_dir}/customer.parquet").select(key, *[(F.floor(key / p) % m).cast("int").alias(n) for n, p, m in _DRAWN])
    long, text, flag = (lambda x: F.lit(x).cast("bigint")), (lambda x: F.lit(x).cast("string")), (lambda x: x.cast("boolean"))
    context = lambda kind, i, app, state, req: _struct(name=text(gate.CHECK), kind=kind, check_run_id=long(i), graphql_app_id=long(app), state=state, is_required=flag(req))
    app = context(text("check_run"), 1, 7, text("x"), _of("ar", _FLAGS, "boolean"))
    impostor = context(_of("ik", ("check_run", "status")), 2, 9, _of("st", ("SUCCESS", "failure")), _of("ir", _FLAGS, "boolean"))
    unknown = context(text("check_run"), 99, None, text("x"), F.lit(True))
    cx = F.col("cx")
    contexts = F.when(cx.isin(1, 2), F.array(app)).when(cx == 3, F.array(app, impostor)).when(cx == 4, F.array(impostor)).when(cx == 5, F.array(app, unknown))
    check = lambda i: _struct(check_run_id=long(i), name=text(gate.CHECK), app_id=long(7), head_sha=_of("hd", ("h", "old")), conclusion=_of("rc", (None, "failure", "success")), external_id=_of("ex", (f"5.1:{_DIGEST}", f"6.1:{_DIGEST}", "bad")))
    rest = F.when(cx != 1, F.slice(F.array(check(1), check(3)), F.lit(1), F.col("na")))
    steps = F.when(F.col("fs") == 0, F.array(*map(F.lit, gate.FAIL_STEPS))).otherwise(F.array().cast("array<string>"))
    holds = {c: F.when(F.col("cd") == 1, F.lit(False)).otherwise(True) if c == "event" else F.when(F.col("cd") != 2, F.lit(True)) if c == "workflow_path" else F.lit(True) for c in gate.CONDITIONS}
    conditions = F.create_map(*[x for k, v in holds.items() for x in (F.lit(k), v)])
    run = _struct(run_id=long(5), run_attempt=long(1), run_head_sha=text("h"), status=F.when(F.col("gr") == 2, "completed").otherwise("queued"), verify_step=_of("vs", (None, "failure", "success")), failed_steps=steps, publish_job=_of("pj", (None, "success", "failure")), conditions=conditions)
    runs = F.when(F.col("gr") == 1, F.slice(F.array(run), 1, 0)).when(F.col("gr") > 1, F.array(run))
    steal = lambda event, n, denied: _struct(event=text(event), conclusion=text("failure"), denied=flag(F.lit(denied)), jobs=F.array(_struct(steps_run=F.lit(n))))
    sr = F.col("sr")
    stolen = F.when(sr == 1, F.slice(F.array(steal("push", 0, True)), 1, 0)).when(sr == 2, F.array(steal("push", 0, True), steal("pull_request", 0, True))).when(sr == 3, F.array(steal("push", 0, True)))
    stolen = stolen.when(sr == 4, F.array(steal("push", 2, True), steal("pull_request", 0, True))).when(sr == 5, F.array(steal("push", 0, False), steal("pull_request", 0, True)))
    digest = lambda v: F.create_map(long(5), text(v))
    digests = F.when(F.col("rd") == 0, F.map_filter(digest("a"), lambda k, v: k < 0)).when(F.col("rd") == 1, digest(None)).when(F.col("rd") == 2, digest(_DIGEST)).otherwise(digest("b"))
    return rows.select(
        key, _of("scen", _SCENARIOS).alias("scenario"), long(7).alias("app_id"), F.lit("h").alias("head_sha"), _of("ms", _STATES).alias("merge_state"), _of("mg", _MERGES).alias("mergeable"), _of("mb", _MERGES).alias("mergeable_before_ruleset"),
        _of("rl", (None, "r")).alias("rules_main"), contexts.alias("contexts"), rest.alias("rest_checks"), runs.alias("gate_runs"), stolen.alias("steal_runs"), digests.alias("report_digests"),
    )


def gate_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Status and reason of every rule for every customer's facts."""
    return gate.evaluated(facts(spark, sf_dir), ("c_custkey",))


def _case(*rows: tuple[str, str], otherwise: str) -> str:
    return "CASE " + " ".join(f"WHEN {cond} THEN '{then}'" for cond, then in rows) + f" ELSE '{otherwise}' END"


_N, _F, _P = "NOT_PROVEN|", "FAILED|", "PASS|"
_UNSEEN = ("NOT seen", _N + "rollup_or_check_source_missing")
_REQUIRED = ("n_imp = 1 AND imp_req", _F + "impostor_is_required")
_UNTOLD = ("n_imp = 1 AND imp_req IS NULL", _N + "impostor_is_required_missing")
_ORIGIN = ("unk", _N + "context_origin_unknown")
_UNOBSERVED = ("n_imp = 0", _N + "impostor_not_observed")
_STATE = ("merge_state IS NULL", _N + "merge_state_missing")
_BLOCKED = (_STATE, ("merge_state = 'BLOCKED'", _P + "blocked"), ("merge_state IN ('CLEAN', 'UNSTABLE')", _F + "prohibited_change_mergeable"))
_RUNS = (("gr = 0", _N + "gate_runs_missing"), ("gr <> 2", _N + "no_completed_gate_run_on_head"))
_NOT_UNIQUE = ("NOT one", _N + "app_check_not_unique")
_EXPECTED = ("want IS NULL", _N + "no_expectation")
_SPOOF = "imp_kind = CASE scenario WHEN 'G3S' THEN 'status' ELSE 'check_run' END AND imp_state = CASE scenario WHEN 'G6' THEN 'skipped' ELSE 'success' END"
_EITHER = "cx = 1 OR gr = 0"
_RULES = {
    "impostor_not_required": _case(_UNSEEN, _REQUIRED, _ORIGIN, _UNTOLD, ("n_imp = 0", _P + "no_impostor_present"), otherwise=_P + "impostors_not_required"),
    "app_check_required": _case(_UNSEEN, ("n_app = 0 AND unk", _N + "context_origin_unknown"), ("n_app = 0", _N + "app_check_absent"), ("app_req", _P + "app_check_required"), ("NOT app_req", _F + "app_check_not_required"), otherwise=_N + "app_is_required_missing"),
    "same_name_other_source": _case(_UNSEEN, _REQUIRED, _ORIGIN, _UNOBSERVED, ("n_app = 1 AND NOT app_req", _F + "app_check_not_required"), ("imp_req IS NULL OR n_app <> 1 OR app_req IS NULL", _N + "is_required_missing"), otherwise=_P + "impostor_present_not_required_app_required"),
    "impostor_required_fails_scenario": _case(_UNSEEN, _REQUIRED, _ORIGIN, _UNOBSERVED, _UNTOLD, otherwise=_P + "no_impostor_required"),
    "expected_impostor_not_required": _case(("scenario NOT IN ('G3', 'G3S', 'G6')", _N + "not_a_spoof_scenario"), _UNSEEN, (f"n_imp = 1 AND {_SPOOF} AND imp_req", _F + "impostor_is_required"), (f"NOT (n_imp = 1 AND {_SPOOF}) AND unk", _N + "context_origin_unknown"), (f"NOT (n_imp = 1 AND {_SPOOF})", _N + "expected_impostor_not_observed"), ("imp_req IS NULL", _N + "impostor_is_required_missing"), otherwise=_P + "expected_impostor_not_required"),
    "merge_state_as_expected": _case(
        _EXPECTED, ("want = 'mergeable' AND mergeable IS NULL", _N + "merge_state_missing"), ("want = 'mergeable' AND mergeable = 'MERGEABLE'", _P + "mergeable"), ("want = 'mergeable' AND (mergeable = 'CONFLICTING' OR merge_state = 'BLOCKED')", _F + "not_mergeable_without_ruleset"),
        ("want = 'mergeable'", _N + "mergeability_unsettled"), ("want = 'mergeable_then_blocked' AND before IS NULL", _N + "merge_state_missing"), _STATE, ("want = 'mergeable_then_blocked' AND before <> 'MERGEABLE'", _N + "not_mergeable_before_ruleset"),
        ("want = 'clean' AND merge_state = 'CLEAN'", _P + "clean"), ("want = 'clean' AND merge_state = 'BLOCKED'", _F + "correct_change_blocked"), ("want = 'clean'", _N + "merge_state_unsettled"), *_BLOCKED, otherwise=_N + "merge_state_unsettled",
    ),
    "spoof_scenario_blocked": _case(*_BLOCKED, otherwise=_N + "merge_state_unsettled"),
    "issuer_pinning_independent": _case(_UNSEEN, _ORIGIN, ("NOT (n_imp = 1 AND imp_state IN ('success', 'skipped', 'neutral'))", _N + "no_passing_impostor"), ("n_app = 1 AND app_state = 'failure'", _N + "app_failure_explains_block"), ("rl = 0", _N + "effective_rules_missing"), _STATE, ("merge_state = 'BLOCKED' AND n_app = 0", _P + "blocked_with_only_an_impostor"), ("merge_state IN ('CLEAN', 'UNSTABLE') AND n_app = 0", _F + "impostor_satisfied_the_rule"), otherwise=_N + "app_check_present_or_state_unsettled"),
    "base_gate_provenance": _case(*_RUNS, ("cd = 1", _F + "gate_condition_false:event"), ("cd = 2", _N + "gate_fact_missing:workflow_path"), otherwise=_P + "base_gate"),
    "verify_step_as_expected": _case(_EXPECTED, *_RUNS, ("vs = 0", _N + "verify_step_missing"), ("verify <> conclusion OR (conclusion = 'success') <> (fs = 1)", _F + "verify_step_not_as_expected"), ("pj = 0", _N + "publish_job_missing"), ("pj = 2", _F + "decision_not_published"), otherwise=_P + "verify_step_as_expected"),
    "exactly_one_app_check": _case(("cx = 1", _N + "check_runs_missing"), ("on_head = 1", _P + "one_app_check"), ("on_head > 1", _F + "several_app_checks"), otherwise=_N + "app_check_absent"),
    "external_id_names_gate_run": _case((_EITHER, _N + "check_runs_or_gate_runs_missing"), _NOT_UNIQUE, ("ex = 2", _F + "external_id_malformed"), ("gr <> 2", _N + "no_completed_gate_run_on_head"), ("ex = 1", _F + "external_id_names_another_run"), otherwise=_P + "external_id_names_gate_run"),
    "report_digest_matches": _case(_NOT_UNIQUE, ("ex = 2", _N + "external_id_malformed"), ("ex = 1 OR rd = 0", _N + "report_artifact_missing"), ("rd = 1", _F + "report_payload_digest_inconsistent"), ("rd = 2", _P + "report_digest_matches"), otherwise=_F + "report_digest_differs"),
    "conclusion_as_expected": _case(_EXPECTED, ("cx = 1", _N + "check_runs_missing"), _NOT_UNIQUE, ("rc = 0", _N + "conclusion_missing"), ("said = conclusion", _P + "conclusion_as_expected"), otherwise=_F + "conclusion_differs"),
    "no_step_executed": _case(("sr = 0", _N + "steal_runs_missing"), ("sr = 1", _N + "no_steal_run"), ("sr = 4", _F + "a_step_executed"), otherwise=_P + "no_step_executed"),
    "app_checks_name_gate_runs": _case((_EITHER, _N + "check_runs_or_gate_runs_missing"), ("foreign_check", _F + "app_check_names_a_non_gate_run"), ("na = 0", _N + "app_check_absent"), otherwise=_P + "all_app_checks_name_gate_runs"),
    "environment_refuses_both_events": _case(("sr = 0", _N + "steal_runs_missing"), ("sr = 4", _F + "a_step_executed"), (f"NOT ({_EITHER}) AND foreign_check", _F + "app_check_names_a_non_gate_run"), ("sr IN (1, 3)", _N + "not_both_events_observed"), ("sr = 5", _N + "denial_reason_not_observed"), (f"{_EITHER} OR na = 0", _N + "steps_or_app_checks_not_shown"), otherwise=_P + "environment_refused_both_events"),
    "same_app_with_key": f"'{_N}limit_same_app_with_key'",
    "limits_recorded": _case(("scenario = 'G8'", _N + "needs_a_merge"), ("scenario = 'AC28'", _N + "needs_a_write_only_second_account"), ("scenario = 'admin_bypass'", _N + "needs_a_merge_attempt"), ("scenario = 'same_app_with_key'", _N + "limit_same_app_with_key"), otherwise=_N + "limit"),
}
_list = lambda values: "[" + ", ".join("NULL" if v is None else str(v).lower() if isinstance(v, bool) else f"'{v}'" for v in values) + "]"
SQL = f"""WITH d AS (SELECT c_custkey, {', '.join(f'(c_custkey // {p}) % {m} AS {n}' for n, p, m in _DRAWN)} FROM customer),
 s AS (SELECT *, {_list(_SCENARIOS)}[scen + 1] AS scenario, {_list(_STATES)}[ms + 1] AS merge_state, {_list(_MERGES)}[mg + 1] AS mergeable, {_list(_MERGES)}[mb + 1] AS before, {_list(_FLAGS)}[ir + 1] AS imp_req, {_list(_FLAGS)}[ar + 1] AS app_req,
   cx NOT IN (0, 1) AS seen, (cx IN (2, 3, 5))::INT AS n_app, (cx IN (3, 4))::INT AS n_imp, cx = 5 AS unk, ['success', 'failure'][st + 1] AS imp_state, ['check_run', 'status'][ik + 1] AS imp_kind, [NULL, 'failure', 'success'][rc + 1] AS said,
   [NULL, 'failure', 'success'][vs + 1] AS verify, CASE WHEN hd = 0 THEN na ELSE 0 END AS on_head, na > 0 AND (ex <> 0 OR gr NOT IN (2, 3)) AS foreign_check FROM d),
 f AS (SELECT *, CASE WHEN na > 0 THEN coalesce(said, 'x') ELSE 'x' END AS app_state, on_head = 1 AND cx <> 1 AS one,
   CASE scenario WHEN 'G0' THEN 'mergeable' WHEN 'G9' THEN 'mergeable_then_blocked' WHEN 'G1' THEN 'clean' WHEN 'G2' THEN 'blocked' WHEN 'G3' THEN 'blocked' WHEN 'G3S' THEN 'blocked' WHEN 'G6' THEN 'blocked' END AS want,
   CASE WHEN scenario IN ('G0', 'G1') THEN 'success' WHEN scenario IN ('G9', 'G2', 'G3', 'G3S', 'G6') THEN 'failure' END AS conclusion FROM s),
 r AS ({' UNION ALL '.join(f"SELECT c_custkey, '{name}' AS rule, {case} AS told FROM f" for name, case in _RULES.items())})
 SELECT c_custkey, rule, split_part(told, '|', 1) AS status, split_part(told, '|', 2) AS reason FROM r"""
QUERIES = {"gate_decisions": gate_decisions}
