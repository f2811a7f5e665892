"""The reference's own unit cases, re-expressed as tiny DataFrames through the set-based operators."""

import datetime as dt

from pyspark.sql import functions as F

from pacewise.operators import tickets as tk

TICKET_SCHEMA = ("ticket_id string, campaign_id string, request_type string, platform string, stage string, "
                 "assignee string, targeting_geo string, brand string")
CAMPAIGN_SCHEMA = ("campaign_id string, campaign_name string, targeting_geo string, language string, "
                   "brand_code string, title_name string, campaign_objective string, channel_mapped string, "
                   "start_date date, budget_usd double, audience_detailed string, landing_page string")


def _campaign(**kw):
    base = dict(campaign_id="C1", campaign_name="DIS_Test_Campaign", targeting_geo="US", language="ENG",
                brand_code="BRD", title_name="Title", campaign_objective="Acq", channel_mapped="ProgDisplay",
                start_date=dt.date(2026, 3, 1), budget_usd=50000.0, audience_detailed="A18-34",
                landing_page="https://www.example.com/x")
    base.update(kw)
    return base


def _campaign_frame(spark, **campaign):
    return spark.createDataFrame([tuple(_campaign(**campaign).values())], CAMPAIGN_SCHEMA)


def _run(spark, request_type, platform, **campaign):
    t = spark.createDataFrame([("T1", "C1", request_type, platform, "Trafficking", "user_02", "US", "BRD")],
                              TICKET_SCHEMA)
    c = _campaign_frame(spark, **campaign)
    return tk.with_payloads(t, c)


def test_version_routing(spark):
    cases = [("DV360", "ProgDisplay", "V1"), ("Yahoo DSP", "ProgDisplay", "V2"), ("CM360", "YouTube", "V2.1"),
             ("CM360", "ProgAudio", "V2.2"), ("Amazon DSP", "ProgCTV", "V3")]
    df = spark.createDataFrame([(f"C{i}", p, ch) for i, (p, ch, _) in enumerate(cases)],
                               "campaign_id string, platform string, channel_mapped string")
    got = {r.campaign_id: r.version for r in tk.campaign_versions(df).collect()}
    assert [got[f"C{i}"] for i in range(len(cases))] == [v for _, _, v in cases]


def test_placement_taxonomy(spark):
    c = spark.createDataFrame([tuple(_campaign().values())], CAMPAIGN_SCHEMA)
    name = c.select(tk.placement_name().alias("n")).first().n
    assert name == "DIS_Test_Campaign|US|ENG|BRD|Title|Acq|ProgDisplay"
    assert name.count("|") == 6


def test_new_campaign_payloads(spark):
    rows = tk.ticket_payloads(_run(spark, "New Campaign", "DV360")).orderBy("position").collect()
    assert [(r.action, r.platform) for r in rows] == [
        ("CREATE_CAMPAIGN_SHELL", "CM360"), ("CREATE_PLACEMENT", "CM360"), ("CREATE_INSERTION_ORDER", "DV360")]
    assert rows[2].budget == 50000.0


def test_native_channel_uses_native_placement(spark):
    rows = tk.ticket_payloads(_run(spark, "New Placements", "Meta", channel_mapped="ProgNative")).orderBy(
        "position").collect()
    assert rows[1].action == "CREATE_NATIVE_PLACEMENT"


def test_creative_rotation(spark):
    w = _run(spark, "Creative Rotation", "Meta")
    rows = tk.ticket_payloads(w).collect()
    assert [(r.action, r.platform) for r in rows] == [("ROTATE_CREATIVES", "CM360")]
    assets = w.select(F.col("payloads")[0]["new_assets"].alias("a")).first().a
    assert assets == ["asset_1.mp4", "asset_2.jpg"]


def _qa(spark, **campaign):
    return {r.check_name: (r.result, r.details) for r in
            tk.qa_results(_run(spark, "New Campaign", "DV360", **campaign)).collect()}


def test_missing_geo_fails(spark):
    res = _qa(spark, targeting_geo=None)
    assert res["Targeting"][0] == "Fail" and "Missing geo" in res["Targeting"][1]


def test_sponsorship_needs_review(spark):
    assert _qa(spark, campaign_name="Big_Sponsorship_Deal")["Content Exclusions"][0] == "Needs Review"


def test_non_https_landing_page_fails(spark):
    res = _qa(spark, landing_page="http://www.example.com/x")
    assert res["Landing Page"][0] == "Fail" and "Non-HTTPS" in res["Landing Page"][1]


def test_nine_checks_with_valid_results(spark):
    res = _qa(spark)
    assert len(res) == 9
    assert all(r in ("Pass", "Fail", "Needs Review") for r, _ in res.values())


def test_no_payloads_single_fail(spark):
    rows = tk.qa_results(_run(spark, "URL Change", "DV360")).collect()
    assert [(r.check_name, r.result) for r in rows] == [("Spec Compliance", "Fail")]


def test_native_payload_components_and_json(spark):
    w = _run(spark, "New Campaign", "Meta", channel_mapped="ProgNative")
    comp = w.select(F.col("payloads")[1]["native_components"].alias("c")).first().c
    assert comp.headline == "Title" and comp.call_to_action == "Sign Up Now"
    bodies = tk.payload_json(w).orderBy("position").collect()
    assert len(bodies) == 3 and '"action":"CREATE_NATIVE_PLACEMENT"' in bodies[1].payload


def test_a_ticket_without_its_campaign_gets_the_stand_in(spark):
    t = spark.createDataFrame([("T1", "CMP-GONE", "New Placements", "Meta", "New", "u", None, None), ("T2", None, "Budget Change", "Meta", "New", "u", "DE", "b")],
                              "ticket_id string, campaign_id string, request_type string, platform string, stage string, assignee string, "
                              "targeting_geo string, brand string")
    c = _campaign_frame(spark).where("false")
    w = tk.with_payloads(t, c)
    budgets = {(r.ticket_id, r.action): r.budget for r in tk.ticket_payloads(w).collect()}
    assert budgets["T1", "CREATE_INSERTION_ORDER"] == 1000.0 and budgets["T2", "UPDATE_BUDGET"] == 1000.0
    checks = {(r.ticket_id, r.check_name): r for r in tk.qa_results(w).collect()}
    assert checks["T1", "Targeting"].details == "Geo targeting found: US"


def test_native_components_of_the_ticket_win(spark):
    t = spark.createDataFrame([("T1", "C1", "New Campaign", "Meta", "New", "u", "US", "b", "own.jpg", None)],
                              "ticket_id string, campaign_id string, request_type string, platform string, stage string, assignee string, "
                              "targeting_geo string, brand string, main_image string, headline string")
    c = _campaign_frame(spark, channel_mapped="ProgNative", budget_usd=None)
    parts = {p["action"]: p for p in tk.with_payloads(t, c).first()["payloads"]}
    native = parts["CREATE_NATIVE_PLACEMENT"]["native_components"]
    assert native["main_image"] == "own.jpg" and native["headline"] == "Title" and native["call_to_action"] == "Sign Up Now"
    assert parts["CREATE_INSERTION_ORDER"]["budget"] == 0.0
