"""The nested snapshot and everything derived from it, on invented rows."""

import json

import pytest
from pyspark.sql import functions as F

from riskboard.operators import alerts, board, carriers, entities, evidence, metrics, review, screening, sections
from riskboard.operators.search import search
from riskboard.plans.publish import publish_run, run_tables
from riskboard.session import work_folder
from riskboard.sources import files, publish, snapshot as snap


@pytest.fixture(scope="module")
def doc(spark, board_path):
    return snap.read_snapshot(spark, board_path).cache()


@pytest.fixture(scope="module")
def tables(doc):
    return snap.normalise(doc)


def names(df, tables):
    return df.join(tables["company"].select("company_id", F.substring_index("name", "｜", 1).alias("who")), "company_id")


def test_row_counts(tables):
    got = {k: df.count() for k, df in tables.items()}
    assert got == {
        "company": 5, "source": 4, "carrier": 7, "site_candidate": 5, "seen_url": 6, "domain_activity": 6,
        "account": 4, "keyword_finding": 3, "scenario": 2, "evidence": 6, "inference": 2,
        "inference_basis": 3, "uncertainty": 4, "change_condition": 3, "review": 5}


def test_company_rows(doc, rows):
    df = board.with_dash(board.company_rows(doc), "活跃域名", "风险词")
    assert len(df.columns) == 16
    when = "2025-03-01 08:00:00"
    assert rows(df) == sorted([
        ("Aurum｜maker", "CLOSED", 1, 1, 0, 0, 2, 2, 3, "aurum.example", 2, True, True, "保本,高价,到期兑付", "llm", when),
        ("Borea｜chain", "CLOSED", 1, 1, 1, 0, 1, 2, 1, "borea.example,b2.example", 0, False, False, "-", "llm", when),
        ("Cinna｜refiner", "OPEN", 1, 0, 0, 0, 1, 1, 1, "cinna.example", 1, None, None, "-", "llm", when),
        ("Dolos｜adviser", "CLOSED", 0, 0, 0, 0, 0, 0, 0, "-", 1, None, None, "-", "conservative_local_fallback", when),
        ("Egida｜works", "CLOSED", 1, 0, 0, 0, 1, 1, 1, "egida.example", 0, False, False, "-", "conservative_local_fallback", when),
    ], key=repr)


def test_risk_filter_and_its_compat_form(doc):
    shown = board.company_rows(doc).select(
        F.col("企业").alias("name"), F.col("状态").alias("status"), F.col("有风险").alias("risk"),
        F.col("风险词").alias("risk_words"), F.col("活跃域名").alias("active_domains"))
    assert search(shown, risk_only=True).count() == 1
    dashed = board.with_dash(shown, "risk_words")
    assert search(dashed, risk_only=True).count() == 1
    assert search(dashed, risk_only=True, compat=True).count() == 5
    assert search(shown, "　AURUM.example ").count() == 1
    assert search(shown, "").count() == 5
    assert search(shown, status="OPEN").count() == 1


def test_times(tables, doc, rows):
    assert str(snap.generated_at(doc).first()["generated_at_utc"]) == "2025-03-01 00:00:00"
    seen = tables["source"].select(F.col("source_id"), F.col("observed_at").cast("string"))
    assert rows(seen)[0] == ("S-NEW", None)
    assert ("S-REG", "2025-02-28 23:00:00") in rows(seen)


def test_verdict_rule(tables, rows):
    hits = tables["keyword_finding"].select("company_id", F.explode("keywords").alias("keyword"))
    got = screening.rule_verdict(tables["company"], tables["carrier"], tables["seen_url"], hits)
    assert rows(names(got, tables), "who", "risk", "reason") == sorted([
        ("Aurum", True, "keyword"), ("Borea", False, "no_keyword"), ("Cinna", None, "unfinished"),
        ("Dolos", None, "待核实"), ("Egida", False, "no_keyword")], key=repr)
    stored = tables["company"].select("company_id", F.col("risk").alias("stored"))
    assert got.join(stored, "company_id").filter(~F.col("risk").eqNullSafe(F.col("stored"))).count() == 0


def test_missing_data_is_never_no_risk(spark, rows):
    firm = spark.createDataFrame([(1, "CLOSED", "llm"), (2, "OPEN", "llm"), (3, None, "llm")],
                                 "company_id long, status string, analysis_mode string")
    none = spark.createDataFrame([], "company_id long")
    got = screening.rule_verdict(firm, none, none, none)
    assert {r["risk"] for r in got.collect()} == {None}


def test_account_rule(tables):
    got = entities.decide_accounts(tables["account"].withColumnRenamed("decision", "stored"),
                                   tables["company"], tables["carrier"])
    assert got.filter(F.col("decision") != F.col("stored")).count() == 0
    assert got.count() == 4


def test_evidence_grade(tables):
    got = evidence.grade_evidence(tables["evidence"].withColumnRenamed("excerpt", "content"), tables["source"])
    assert got.filter(F.col("grade") != F.col("status")).count() == 0
    assert got.count() == 6


def test_evidence_source_fallback(tables, rows):
    got = evidence.evidence_with_source(tables["evidence"], tables["source"]).filter("source_id like 'S-L%'")
    assert rows(got, "source_name", "source_url") == [("S-LOST", "")]


def test_basis(tables, rows):
    inf = tables["inference_basis"].groupBy("company_id", "inference_id").agg(
        F.collect_list("evidence_id").alias("basis"))
    graded = tables["evidence"].withColumnRenamed("status", "grade")
    assert rows(evidence.resolve_basis(inf, graded), "inference_id", "evidence_id", "grade") == [
        (0, "E1", "verified"), (1, "E2", "partial")]
    assert rows(evidence.dangling_basis(inf, graded), "inference_id", "evidence_id") == [(0, "E9")]
    support = evidence.basis_support(inf, graded)
    assert rows(evidence.sole_partial(support), "inference_id") == [(1,)]


def test_coverage_gap(tables, rows):
    got = rows(evidence.coverage_gap(tables["company"], tables["source"], tables["evidence"]))
    sources = dict(rows(tables["source"], "source_id", "type"))
    have = {}
    for company, source in rows(tables["evidence"].select("company_id", "source_id").distinct()):
        if source in sources:
            have.setdefault(company, set()).add(source)
    want = []
    for (company,) in rows(tables["company"], "company_id"):
        own = have.get(company, set())
        gap = sorted(set(sources.values()) - {sources[s] for s in own})
        want.append((company, len(own), len(sources) - len(own), ",".join(gap)))
    assert got == sorted(want, key=repr)


def test_basis_of_another_company_is_none(spark, rows):
    inf = spark.createDataFrame([(1, 10, ["E1", "E2"])], "company_id long, inference_id long, basis array<string>")
    graded = spark.createDataFrame([(1, "E1", "partial"), (2, "E2", "verified")],
                                   "company_id long, evidence_id string, grade string")
    assert rows(evidence.resolve_basis(inf, graded), "evidence_id", "grade") == [("E1", "partial")]
    assert rows(evidence.dangling_basis(inf, graded), "evidence_id") == [("E2",)]
    assert rows(evidence.sole_partial(evidence.basis_support(inf, graded))) == [(1, 10, 1)]


def test_partial_and_unavailable_is_sole_partial(spark, rows):
    inf = spark.createDataFrame([(1, 1, ["a", "b"]), (1, 2, ["b"]), (1, 3, ["a", "c"])],
                                "company_id long, inference_id long, basis array<string>")
    graded = spark.createDataFrame([(1, "a", "partial"), (1, "b", "unavailable"), (1, "c", "verified")],
                                   "company_id long, evidence_id string, grade string")
    assert rows(evidence.sole_partial(evidence.basis_support(inf, graded)), "inference_id") == [(1,)]


def test_unscreened_company_is_undecided(spark, rows):
    """A failed or terminal keyword phase must never read as "no risk"."""
    firm = spark.createDataFrame([(i, "CLOSED", "llm", s) for i, s in ((1, True), (2, False), (3, False), (4, None))],
                                 "company_id long, status string, analysis_mode string, live_screened boolean")
    data = firm.select("company_id")
    hits = spark.createDataFrame([(3,)], "company_id long")
    got = screening.rule_verdict(firm, data, data, hits)
    assert rows(got, "company_id", "risk", "reason") == [
        (1, False, "no_keyword"), (2, None, "unscreened"), (3, True, "keyword"), (4, None, "unscreened")]


def test_blank_contents_are_no_copies(spark, rows):
    df = spark.createDataFrame([(1, 1, "s", " "), (2, 1, "s", "--"), (3, 1, "s", None), (4, 1, "s", "x")],
                               "evidence_id long, company_id long, source_id string, content string")
    assert rows(evidence.dedup_evidence(df), "evidence_id", "n_copies") == [(4, 1)]


def test_incomplete_evidence(tables, rows):
    rowset = tables["evidence"].withColumn("scope", F.lit("x"))
    got = evidence.incomplete_evidence(rowset, "2025-02-28 23:15:00")
    assert rows(names(got, tables), "who", "evidence_id", "missing") == [
        ("Aurum", "E3", "observed_at"), ("Egida", "E1", "late")]


def test_listings(tables, rows):
    lines = carriers.carrier_listing(tables["carrier"])
    assert rows(names(lines, tables).filter("who = 'Borea'"), "kind_idx", "pos", "line") == [
        (0, 0, "[web] borea.example"), (1, 0, "[mapp] B mini"), (2, 0, "[app] B app")]
    assert ("[快手] aurun · 非官方 · 未认证",) in rows(entities.account_listing(tables["account"]), "line")
    assert rows(entities.scenario_listing(tables["scenario"], ["pos"]), "pos", "line") == [
        (0, 'pool: {"scenario":"pool","level":"高","note":"n1"}'),
        (1, '—: {"scenario":"","level":"中","note":null}')]
    counted = carriers.carrier_counts(tables["carrier"])
    assert rows(names(counted, tables).filter("who = 'Aurum'"), "n_web", "n_mapp", "n_app", "n_kapp", "n_total") == [
        (1, 1, 0, 0, 2)]


def test_keyword_text(doc):
    c = doc.select(F.explode("companies").alias("c"))
    got = c.select("c.name", screening.nested_keyword_text("c.risk.risk_keyword_findings").alias("t"))
    assert {r["name"][:1]: r["t"] for r in got.collect()} == {
        "A": "保本、高价；到期兑付", "B": "", "C": "", "D": "", "E": ""}


def test_alerts(doc):
    found = run_tables(doc)["alerts"].collect()
    assert {r["time"] for r in found} == {"2025-03-01 08:00:00"}
    got = [(r["level"], r["text"]) for r in found]
    assert sorted(got) == sorted([
        ("info", "加载离线快照，共 5 家企业"),
        ("warning", "Dolos：备案/官网数据缺失，结论已降级为“待核实”"),
        ("warning", "Egida：LLM 不可用，自动降级为本地关键词规则"),
        ("info", "待人工复核 2 家")])


def test_progress(tables, rows):
    got = names(board.progress_rows(tables["company"]), tables)
    assert ("Aurum", "CLOSED", "-") in rows(got, "who", "status", "current_phase")
    assert ("Cinna", "OPEN", "POST_CRAWL") in rows(got, "who", "status", "current_phase")


def test_sections(doc, rows):
    got = sections.company_sections(doc)
    assert got.count() == 25
    icp = json.loads(sections.section(got, "Aurum｜maker", "icp").first()["payload"])
    assert icp == {
        "icp_counts": {"web": 1, "mapp": 1, "app": 0, "kapp": 0},
        "icp_carriers": {"web": [{"domain": "aurum.example", "name": "Aurum web"}],
                         "mapp": [{"name": "Aurum mini"}], "app": [], "kapp": []}, "analysis_mode": "llm"}
    risk = json.loads(sections.section(got, "Cinna｜refiner").first()["payload"])["risk"]
    assert risk["overall_risk_found"] is None and risk["gold_buyback"] == {"present": None}
    ev = json.loads(sections.section(got, "Aurum｜maker", "evidence").first()["payload"])
    assert ev["sources"]["S-WEB"]["name"] == "Company site" and len(ev["evidence"]) == 3
    assert sections.section(got, "nobody").count() == 0
    assert sections.section(got, "Aurum｜maker", "other").count() == 0


def test_review_overlay_in_sections(spark, doc):
    new = spark.createDataFrame(
        [("Cinna｜refiner", "已复核", "me", "采纳", "", "2025-03-02 00:00:00")],
        "company_id string, status string, reviewer string, decision string, note string, reviewed_at string")
    got = sections.company_sections(doc, new)
    for name, path in (("risk", ["risk", "human_review"]), ("evidence", ["human_review"])):
        body = json.loads(sections.section(got, "Cinna｜refiner", name).first()["payload"])
        for step in path:
            body = body[step]
        assert body["decision"] == "采纳" and body["reviewer"] == "me"
    same = json.loads(sections.section(got, "Aurum｜maker", "evidence").first()["payload"])
    assert same["human_review"]["decision"] == "修改"


def test_status_and_review_counts(tables, rows):
    assert rows(metrics.companies_by_status(tables["company"])) == [("CLOSED", 4), ("OPEN", 1)]
    pending = tables["review"].filter("status = '待复核'")
    assert pending.count() == 2
    events = tables["review"].withColumn("event_id", F.lit(1)).filter("status = '已复核'")
    mix = review.review_mix(review.latest_review(events), F.lit(5))
    assert rows(mix) == [("修改", 1, 0.2), ("转人工", 1, 0.2), ("采纳", 1, 0.2)]


def test_publish_twice_replaces_the_run_only(spark, board_path, rows):
    out = work_folder(spark, "publish")
    tasks = spark.createDataFrame(
        [(1, "OCR", 3, "OK", "OCR/task_01"), (1, "KEYWORD", 4, "FAILED", "KEYWORD/task_01")],
        "company_id long, phase string, phase_idx int, status string, task_dir string")
    shots = spark.createDataFrame([(1, "截图", "a.png"), (1, "截图", "b.png"), (2, "过程文本", "c.md")],
                                  "company_id long, kind string, path string")
    for run in ("r1", "r2", "r1"):
        publish_run(spark, board_path, out, run, tasks, shots)
    table = publish.read_published(spark, f"{out}/tables", "company_rows")
    assert rows(table.groupBy("run_id").count()) == [("r1", 5), ("r2", 5)]
    assert publish.read_published(spark, f"{out}/tables", "sections", "r1").count() == 25
    kinds = publish.read_published(spark, f"{out}/tables", "process_files", "r2").filter("company_id is null")
    assert rows(kinds, "kind", "n") == [("截图", 2), ("过程文本", 1), (None, 3)]
    phase = spark.read.text(f"{out}/json/phases").filter("value like '%OCR%'").first()["value"]
    assert json.loads(phase)["payload"] == {"phase_idx": 3, "status": "OK", "task_dir": "OCR/task_01"}
    board_doc = {}
    for r in spark.read.text(f"{out}/json/dashboard").filter("run_id = 'r2'").collect():
        one = json.loads(r["value"])
        board_doc.setdefault(one["part"], []).append(one["payload"])
    assert board_doc["company_status"] == [{"CLOSED": 4, "OPEN": 1}] and len(board_doc["alert"]) == 4
    assert board_doc["task_audit"] == [{"FAILED": 1, "PENDING": 0, "RETRY_WAIT": 0, "RUNNING": 0}]
    assert board_doc["execution_summary"][0]["tasks"] == 2 and board_doc["execution_summary"][0]["success_pct"] == 50
    assert {f["path"] for f in board_doc["process_file"]} == {"a.png", "b.png", "c.md"}
    steps = [json.loads(r["value"]) for r in spark.read.text(f"{out}/json/progress").filter("run_id = 'r2'").collect()]
    assert {s["payload"]["status"] for s in steps} == {"CLOSED", "OPEN"} and len(steps) == 5
    line = spark.read.text(f"{out}/json/sections").filter("value like '%Dolos%' and value like '%\"icp\"%'").first()
    body = json.loads(line["value"])
    assert body["section"] == "icp" and body["payload"]["icp_counts"]["web"] == 0


def test_files(spark, tmp_path, rows):
    (tmp_path / "a.txt").write_text("alpha")
    (tmp_path / "b.txt").write_text("beta")
    (tmp_path / "c.txt").write_text("gamma")
    (tmp_path / "ui").mkdir()
    (tmp_path / "ui" / "a.txt").write_text("other")
    have = files.fingerprint(spark, str(tmp_path), "*.txt")
    sha = {r["path"]: r["sha256"] for r in have.collect()}
    manifest = tmp_path / "files.md"
    manifest.write_text("| file | bytes | sha |\n|---|---:|---|\n"
                        f"| `a.txt` | 5 | `{sha['a.txt']}` |\n| `b.txt` | 4 | `{'0' * 64}` |\n"
                        f"| `z.txt` | 1 | `{'1' * 64}` |\n| `ui/a.txt` | 5 | `{sha['ui/a.txt']}` |\n")
    got = files.check_manifest(have, files.read_manifest(spark, str(manifest)))
    assert rows(got) == [("a.txt", "ok"), ("b.txt", "changed"), ("c.txt", "extra"), ("ui/a.txt", "ok"), ("z.txt", "missing")]


def test_roster_and_replay(spark, tmp_path, rows):
    roster = tmp_path / "roster.txt"
    roster.write_text(" Aurum \n\n　Borea　\nAurum\n")
    got = files.read_roster(spark, str(roster))
    assert rows(got) == [("Aurum",), ("Borea",)]
    files.write_replay(got.filter("name = 'Borea'"), str(tmp_path / "replay"))
    assert rows(files.read_roster(spark, str(tmp_path / "replay"))) == [("Borea",)]


def test_alert_routing(spark, rows):
    df = spark.createDataFrame([("no API key",), ("bad companies file",), ("slow",), ("",), (None,)], "text string")
    assert rows(alerts.route_alerts(df)) == [
        ("bad companies file", "critical"), ("no API key", "critical"), ("slow", "warning")]


def test_published_kpis(spark, rows):
    counts = spark.createDataFrame([(6, 2, 96, 0, 0, 0, 3, 88, 96)],
                                   "closed long, open long, tasks long, failed long, retry long, running long, "
                                   "pending long, reused long, processed long")
    r = metrics.kpi_from_counts(counts).first()
    assert (r["done"], r["companies"], r["terminal"], r["tasks"], r["success_pct"], r["abnormal"], r["reused"],
            r["processed"]) == (6, 8, 93, 96, 97, 0, 88, 96)
    empty = counts.select(*[F.lit(0).cast("long").alias(c) for c in counts.columns])
    assert metrics.kpi_from_counts(empty).first()["success_pct"] is None
