"""Schemas of the catalog's records and their allowed values."""

from __future__ import annotations

DRAFT = (
    "name string, slug_hint string, source_type string, external_id string, source_url string, short_description string, "
    "long_description string, developer_name string, developer_url string, official_page_url string, install_url string, "
    "repo_url string, official_directory_url string, platforms array<string>, listing_types array<string>, "
    "categories array<string>, use_cases array<string>, capabilities map<string,string>, "
    "capability_evidence map<string,string>, supported_plans array<string>, region_availability string, "
    "platform_metadata map<string,string>, raw_payload string"
)
PROBE = "app_id bigint, target string, url string, ok boolean, status_code int, checked_at timestamp"
CLICK = "app_id bigint, link_type string, source_page string, source_position int, session_key string, created_at timestamp"
LLM_CALL = (
    "call_id bigint, task_id bigint, provider string, model string, input_tokens int, cached_tokens int, output_tokens int, "
    "cost_usd decimal(10,6), is_mock boolean, created_at timestamp"
)
PROPOSAL = "app_id bigint, field string, value string, evidence string, confidence double"

#: Allowed values of enumerated columns.
STATUS = ("draft", "published", "hidden")
VERIFICATION = ("official", "not_listed", "unknown")
REVIEW = ("reviewed", "unreviewed")
CLAIM = ("unclaimed", "pending", "claimed")
LAUNCH = ("live", "beta", "waitlist", "deprecated")
PRICING = ("free", "paid", "freemium", "unknown")
TRI_STATE = ("yes", "no", "unknown")
