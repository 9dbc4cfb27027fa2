"""Chains of revisions against a fold in plain Python."""

import random

import pytest

from siltstone.operators import integrity

SCHEMA = "store string, revision long, revision_id string, sealed boolean, clean boolean, state_sha256 string, manifest_sha256 string, previous_id string, previous_manifest_sha256 string, quarantines boolean, quarantine_state string, strays boolean"


def some_chain(store, n, rng):
    rows, number, before = [], 0, None
    for _ in range(n):
        number += rng.choice([1, 1, 1, 1, 5])
        sealed, clean = rng.random() < 0.95, rng.random() < 0.9
        row = {"store": store, "revision": number, "revision_id": f"r{number}", "sealed": sealed, "clean": clean, "state_sha256": f"s{number}", "manifest_sha256": f"m{number}" if sealed else None, "previous_id": None, "previous_manifest_sha256": None, "quarantines": False, "quarantine_state": None, "strays": rng.random() < 0.03}
        if before:
            row["previous_id"] = before["revision_id"] if rng.random() < 0.97 else "rx"
            row["quarantines"] = rng.random() < 0.4
            row["previous_manifest_sha256"] = before["state_sha256"] if row["quarantines"] and rng.random() < 0.95 else before["manifest_sha256"]
            row["quarantine_state"] = before["state_sha256"] if row["quarantines"] and rng.random() < 0.95 else None
        rows.append(row)
        before = row
    return rows


def folded(rows):
    statuses, before = [], None
    for row in rows:
        good = row["sealed"] and row["clean"] and not row["strays"]
        link = [row["previous_id"], row["previous_manifest_sha256"]]
        if before is None:
            valid = good and link == [None, None] and not row["quarantines"]
        elif row["quarantines"]:
            bound = row["quarantine_state"] == before["state_sha256"] and link == [before["revision_id"], before["state_sha256"]]
            if statuses[-1] != "VALID" and bound:
                statuses[-1] = "QUARANTINED"
                valid = good
            else:
                valid = False
        else:
            valid = good and before["manifest_sha256"] is not None and link == [before["revision_id"], before["manifest_sha256"]] and statuses[-1] == "VALID"
        statuses.append("VALID" if valid else "INVALID" if row["sealed"] else "INCOMPLETE")
        before = row
    return statuses


@pytest.mark.parametrize("block", [3, 1024])
def test_chains_equal_a_fold(spark, monkeypatch, block):
    monkeypatch.setattr(integrity, "BLOCK", block)
    rng = random.Random(block)
    stores = {s: some_chain(s, n, rng) for s, n in (("a", 400), ("b", 1), ("c", 60), ("d", 2), ("e", 7))}
    rows = [tuple(r.values()) for chain in stores.values() for r in chain]
    rng.shuffle(rows)
    got = {(r.store, r.revision): r.status for r in integrity.chained(spark.createDataFrame(rows, SCHEMA)).collect()}
    expected = {(s, r["revision"]): status for s, chain in stores.items() for r, status in zip(chain, folded(chain), strict=True)}
    assert set(expected.values()) == {"VALID", "INVALID", "INCOMPLETE", "QUARANTINED"}
    assert got == expected


def test_blocks_by_shuffle_and_empty_tables(spark, monkeypatch):
    monkeypatch.setattr(integrity, "SENT", 0)
    chain = some_chain("a", 30, random.Random(1))
    got = integrity.chained(spark.createDataFrame([tuple(r.values()) for r in chain], SCHEMA)).orderBy("revision").collect()
    assert [r.status for r in got] == folded(chain)
    empty = spark.createDataFrame([], SCHEMA)
    assert integrity.chained(empty).count() == 0
    requests = spark.createDataFrame([(1, "a", None, "API", None, True)], "request_id int, store string, evidence_id string, source_type string, subject_commit string, require_complete boolean")
    statuses = spark.createDataFrame([], "store string, revision long, status string")
    findings = spark.createDataFrame([], "store string, revision long, check_id string, code string")
    envelopes = spark.createDataFrame([], "store string, revision long, evidence_id string, source_type string, capture_id string, page_index int, has_next boolean, pagination_complete boolean, http_status int, body string, body_recorded boolean, completeness string, subject_commit string, scanned boolean, storable boolean")
    got = {r.check_id: (r.status, r.reasons) for r in integrity.validated(requests, statuses, findings, envelopes).collect()}
    assert got["W1"] == ("NOT_PROVEN", "no_evidence_named")
    assert got["OVERALL"][0] == "NOT_PROVEN"
    assert len(got) == 15


def test_checks_are_not_kept_a_row_each_before_their_verdict(spark, monkeypatch):
    kept = []
    monkeypatch.setattr(integrity, "settled", lambda df: kept.append(set(df.columns)) or df)
    requests = spark.createDataFrame([(1, "a", "e", "API", None, True), (2, "b", None, "API", None, True)], "request_id int, store string, evidence_id string, source_type string, subject_commit string, require_complete boolean")
    statuses = spark.createDataFrame([("a", 1, "VALID")], "store string, revision long, status string")
    findings = spark.createDataFrame([("b", 1, "V2", "x"), ("b", 1, "V2", "a")], "store string, revision long, check_id string, code string")
    columns = "store string, revision long, evidence_id string, source_type string, capture_id string, page_index int, has_next boolean, pagination_complete boolean, http_status int, body string, body_recorded boolean, completeness string, subject_commit string, scanned boolean, storable boolean"
    envelopes = spark.createDataFrame([("a", 1, "e", "API", "c", 1, False, True, 200, "json", True, "COMPLETE", None, True, True)], columns)
    got = {(r.request_id, r.check_id): (r.status, r.reasons) for r in integrity.validated(requests, statuses, findings, envelopes).collect()}
    assert len(got) == 30 and not any({"check_id", "reasons"} <= columns for columns in kept)
    assert got[1, "OVERALL"] == ("PASS", "") and got[1, "V9"] == ("NOT_APPLICABLE", "no_sanitized_evidence_type") and got[1, "V5"] == ("PASS", "")
    assert got[2, "V2"] == ("FAILED", "a,x") and got[2, "OVERALL"][0] == "FAILED" and got[2, "V5"] == ("NOT_PROVEN", "store_integrity_not_verified")
