import re

import pytest

from siltstone import chain_queries
from siltstone.rules import chain

SF = "/root/testdata/sf0.001"
REPORT = "chain_id long, sha256 string, state string, payload_sha256 string, base string, head string, head_kind string, source string, config string, contract_path string, contract_sha256 string, again string"
CHAIN = (
    "chain_id long, repo string, base string, head string, config string, contract_path string, contract_sha256 string, report_sha256 string, payload_sha256 string, has_review boolean, review_sha256 string, "
    "has_evidence boolean, revision string, manifest_sha256 string, repository string, evidence_verdict string, evidence_pages string"
)


def some_sides(spark):
    """Chain 1 holds; 2 and 6 have heads that are not known or come from elsewhere; 3 has doubtful findings, 4 lost evidence, 5 no repository; all
    that may be repeated is."""
    whole = lambda i, **other: tuple(({"chain_id": i, "repo": "r", "base": "b", "head": f"h{i}", "config": "b", "contract_path": "p", "contract_sha256": "k", "report_sha256": "t", "payload_sha256": "y", "has_review": True, "review_sha256": "v", "has_evidence": True, "revision": "s", "manifest_sha256": "m", "repository": "o", "evidence_verdict": "PASS", "evidence_pages": "PASS"} | other).values())
    chains = [whole(1), whole(2, has_review=False), whole(3, has_evidence=False), whole(4, evidence_verdict="FAIL"), whole(5, repo=None, evidence_verdict="FAIL"), whole(6, contract_path=None)]
    reports = [(i, "t", "valid", "y", "b", f"h{i}", "commit", "git_revision", "b", "p", "k", "y") for i in range(1, 7)]
    frame = spark.createDataFrame
    history = chain.history(
        frame(chains, CHAIN),
        frame([("r", x) for x in ("b", "h1", "h1", "h3", "h4", "h5", "h6", "b")], "repo string, commit string"),
        frame([("r", "b", h) for h in ("h1", "h1", "h2", "h3", "h4")] + [("r", "a", "h6")], "repo string, ancestor string, commit string"),
        frame([("r", "b", "p", "100644", "k")], "repo string, commit string, path string, mode string, sha256 string"),
    )
    held = "chain_id long, finding_id string, sha256 string, identity string"
    findings = [(1, "f", "x", "i"), (3, "f", "x", "i"), (3, "g", "x", "i"), (3, "g", "x", "i")]
    references = [(1, "f", "x", "i"), (1, "f", "x", "i"), (3, "f", "x", "i"), (3, "f", "z", "i"), (3, "g", "x", "i"), (2, "none", "x", "i")]
    evidence = [(1, "e", "s", "m", "o"), (1, "e", "s", "m", "o"), (4, "e", None, None, None), (4, "f", "s", "m", "else"), (5, "e", "s0", "m", "else")]
    return (
        frame(chains, CHAIN), history, frame(reports, REPORT), frame([(i, "v", True, False, True) for i in range(1, 7)], "chain_id long, sha256 string, valid boolean, has_errors boolean, tools boolean"),
        frame(findings, held), frame(references, held), frame([(4, "review_conflict"), (4, "of_no_catalogue"), (4, "review_conflict"), (6, "approval_not_shown")], "chain_id long, code string"),
        frame(evidence, "chain_id long, evidence_id string, revision string, manifest_sha256 string, repository string"),
    )


REASONS = {
    (2, "subject"): ("INCOMPLETE", "revision_not_found"), (2, "review"): ("NOT_PRESENT", ""), (3, "review"): ("BROKEN", "finding_digest_mismatch,finding_missing"), (3, "github"): ("NOT_PRESENT", ""),
    (4, "github"): ("BROKEN", "evidence_id_missing,repository_mismatch"), (4, "gate"): ("BROKEN", "of_no_catalogue,review_conflict"), (5, "subject"): ("INCOMPLETE", "link_check_error"), (5, "contract"): ("INCOMPLETE", "link_check_error"),
    (5, "verification"): ("NOT_PROVEN", "recompute_unavailable"), (5, "github"): ("BROKEN", "integrity_not_pass,store_manifest_mismatch"), (6, "subject"): ("BROKEN", "base_not_ancestor_of_head"),
    (6, "contract"): ("INCOMPLETE", "contract_blob_missing"), (6, "gate"): ("NOT_PROVEN", "approval_not_shown"),
}


@pytest.mark.parametrize("sent", [0, 100_000])
def test_links_of_stated_chains(spark, monkeypatch, sent):
    monkeypatch.setattr(chain, "SENT", sent)
    sides = some_sides(spark)
    got = {(r.chain_id, r.link): (r.status, r.codes) for r in chain.judged(*sides).collect()}
    assert {k: v for k, v in got.items() if k[1] != "chain"} == {(i, link): REASONS.get((i, link), ("LINKED", "")) for i in range(1, 7) for link in chain.LINKS}
    assert {i: got[i, "chain"][0] for i in range(1, 7)} == {r.chain_id: r.status for r in chain.composed(chain.links(*sides)).collect()} == {1: "COMPLETE", 2: "INCOMPLETE", 3: "BROKEN", 4: "BROKEN", 5: "BROKEN", 6: "BROKEN"}


def test_chain_links_keeps_no_chains(spark, monkeypatch):
    """What is written to the shared folder are histories that chains share, never a row a chain or a link."""
    kept = []

    def settled(df, own=chain.settled):
        out = own(df)
        kept.append(out.count())
        return out

    for module in (chain, chain_queries):
        monkeypatch.setattr(module, "settled", settled)
    found = chain_queries.QUERIES["chain_links"](spark, SF)
    assert found.count() == 10_500
    assert sum(kept) <= 300  # 100 pairs of base and configuration, three contracts


def test_chain_links_is_compiled(spark, capsys):
    """The JVM compiles no method of 8,000 bytes or more; one that tells all links at once is interpreted."""
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        chain_queries.QUERIES["chain_links"](spark, SF).explain("codegen")
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    sizes = list(map(int, re.findall(r"maxMethodCodeSize:(\d+)", capsys.readouterr().out)))
    assert len(sizes) > 10
    assert max(sizes) < 8000
