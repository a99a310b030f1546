"""Declared schemas as DDL: nothing is inferred from data."""

from __future__ import annotations

_REVIEW = "struct<status string, reviewer string, decision string, note string, reviewed_at string>"
_EVIDENCE = ("struct<id string, claim string, source_id string, excerpt string, "
             "observed_at string, origin_url string, status string>")
_RISK = (
    "struct<overall_risk_found boolean, gold_buyback struct<present boolean>, "
    "analysis_mode string, "
    "risk_keyword_findings array<struct<keywords array<string>, `where` string>>, "
    "risk_scenarios array<struct<scenario string, level string, note string>>, "
    f"executive_summary string, evidence array<{_EVIDENCE}>, "
    "inferences array<struct<text string, basis array<string>, confidence string>>, "
    f"uncertainties array<string>, change_conditions array<string>, human_review {_REVIEW}>")
COMPANY = (
    "struct<name string, status string, current_phase string, "
    "icp struct<web array<struct<domain string, name string>>, mapp array<struct<name string>>, "
    "app array<struct<name string>>, kapp array<struct<name string>>>, "
    "website_search struct<candidates array<struct<domain string>>>, "
    "website_crawl struct<seen_urls array<string>>, "
    "domain_activity array<struct<domain string, is_active boolean>>, "
    "social struct<count int, accounts array<struct<platform string, name string, "
    f"decision string, official_status string>>>, risk {_RISK}>")

META = "struct<notice string, run_id string, generated_at string, data_scope string, engine_version string>"
SOURCE = "struct<id string, name string, type string, url string, observed_at string>"
SNAPSHOT = f"meta {META}, sources array<{SOURCE}>, companies array<{COMPANY}>"

EVENTS = (
    "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, "
    "props string")

POSTS = ("conv_id bigint, turn bigint, role string, text string")
