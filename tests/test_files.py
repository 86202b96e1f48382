"""Tolerant readers and the store by domain."""

import json

from pyspark.sql import functions as F

from lumenspan.sources import files as S


def put(root, **files):
    for name, value in files.items():
        place = root / name.replace("__", "/")
        place.parent.mkdir(parents=True, exist_ok=True)
        place.with_suffix(".json").write_text(value if isinstance(value, str) else json.dumps(value))


def test_paths_inside_a_root(spark):
    cases = {"a/b.md": True, "./a": True, "a/../b": True, "../a": False, "a/../../b": False, "/a": False, "C:\\a": False, "a\\..\\..\\b": False, "": True, "..": False, "a/b/../../c": True}
    rows = spark.createDataFrame([(p,) for p in cases], "p string").select("p", S.inside(F.col("p")).alias("ok"))
    assert {r["p"]: r["ok"] for r in rows.collect()} == cases


def test_manifests(spark, tmp_path):
    good = {"domain_id": "d", "domain_name": "D", "version": "1", "papers": [{"paper_id": "a", "document_path": "docs/a.md", "other": 1}, {"paper_id": "b", "document_path": "../b.md"}, {"document_path": "c.md"}, {"paper_id": "e", "exclude_from_evidence_graph": True}]}
    put(tmp_path, one__manifest=good, two__manifest="{not json", three__manifest={"domain_id": "x"}, four__manifest={**good, "papers": []}, five__manifest="[1]", six__manifest="null", one__other=good)
    rows = S.manifests(S.whole_files(spark, str(tmp_path), "manifest.json")).collect()
    got = sorted((r["path"].split("/")[-2], r["paper_id"] or "", r["status"]) for r in rows)
    assert got == [("five", "", "broken"), ("four", "", "empty"), ("one", "", "no_id"), ("one", "a", "ok"), ("one", "b", "outside_root"), ("one", "e", "metadata_only"), ("six", "", "broken"), ("three", "", "no_domain"), ("two", "", "broken")]


def test_ledger(spark, tmp_path):
    config = lambda at, **more: {"slug": "s", "title": "T", "generated_at": at, "provenance": {"git": {"head": "abc", "dirty": True}}, **more}
    put(tmp_path, e1__r1__verification={"status": "passed"}, e1__r1__run_config=config("2024-01-02"), e1__r1__summary=[{"a": 1}, {"a": 2}])
    put(tmp_path, e1__r2__verification={}, e1__r2__run_config={"generated_at": "2024-02-02"}, e1__r2__summary=[])
    put(tmp_path, e2__r3__verification="{", e2__r3__run_config=config("2025-01-01"), e2__r3__summary=[])
    put(tmp_path, e2__r4__verification={"status": "passed"}, e2__r4__summary=[])
    put(tmp_path, e2__r5__verification={"status": "passed"}, e2__r5__run_config=config("2025-01-01"), e2__r5__summary={"a": 1})
    read = lambda name: S.whole_files(spark, str(tmp_path), f"{name}.json")
    rows = S.ledger(read("verification"), read("run_config"), read("summary")).collect()
    got = [(r["run"][-5:], r["experiment"], r["status"], r["git_head"], r["git_dirty"], r["n_summary"], r["error"]) for r in rows]
    assert got == [
        ("e1/r2", "e1", "unknown", None, None, 0, None), ("e1/r1", "s", "passed", "abc", True, 2, None),
        ("e2/r3", "e2", "invalid", None, None, None, "receipt"), ("e2/r4", "e2", "invalid", None, None, None, "config"), ("e2/r5", "e2", "invalid", None, None, None, "summary"),
    ]


def test_cases(spark, tmp_path):
    put(tmp_path, a={"claims": [{"claim_id": "c1"}, {"claim_id": "c2", "semantic_strength": "danger"}], "events": [{"event_id": "e1", "claim_id": "c1", "event_type": "add_support", "is_valid": True}, {"event_id": "e2"}]}, b="no json", c={"claims": []})
    claims, events, broken = S.frozen_cases(S.whole_files(spark, str(tmp_path), "*.json"))
    assert sorted((r["claim_id"], r["semantic_strength"]) for r in claims.collect()) == [("c1", "plain"), ("c2", "danger")]
    assert [(r["seq"], r["event_id"], r["is_valid"]) for r in events.orderBy("seq").collect()] == [(0, "e1", True), (1, "e2", None)]
    assert [r["path"][-6:] for r in broken.collect()] == ["b.json"]


def test_one_domain_is_read_from_its_folder_alone(spark, tmp_path):
    rows = spark.createDataFrame([(k, f"t{k}", "ab"[k % 2]) for k in range(10)], "id long, title string, domain string")
    S.write_domains({"papers": rows, "claims": rows.where("domain = 'a'")}, str(tmp_path))
    schema = "id long, title string"
    scan = S.scan_domain(spark, str(tmp_path), "papers", schema, "a")
    plan = scan._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(domain" in plan and "(domain#" in plan.split("PartitionFilters")[1]
    assert sorted(r["id"] for r in scan.collect()) == [0, 2, 4, 6, 8]
    assert S.scan_domain(spark, str(tmp_path), "papers", schema, "zz").count() == 0 and S.scan_domain(spark, str(tmp_path), "none", schema, "a").columns == ["id", "title", "domain"]
    counts = {(r["domain"], r["table"]): r["n_rows"] for r in S.domain_counts(spark, str(tmp_path), {"papers": schema, "claims": schema, "none": schema}).collect()}
    assert counts == {("a", "papers"): 5, ("b", "papers"): 5, ("a", "claims"): 5, ("b", "claims"): 0, ("a", "none"): 0, ("b", "none"): 0}
