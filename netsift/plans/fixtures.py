"""A worked watchlist over the flow view: every strength and rule branch occurs."""

from __future__ import annotations

INTERNAL = ["10.60.0.0/16", "203.0.113.0/24"]
HINT = lambda field, operator, value: {"field": field, "operator": operator, "value": value}

WATCHLIST = {
    "watchlist_version": "worked-example",
    "priority_1": [
        {
            "id": "W-META",
            "target_assets": [{"ip": "169.254.169.254", "match": "dst"}],
            "reason": "metadata service access",
            "detection_hints": [
                HINT("dst_ip", "eq", "169.254.169.254"), HINT("dst_port", "eq", 80),
                HINT("src_ip", "in_cidr", ["10.60.0.0/16"]),
            ],
            "alert_when": ["any host reaches the metadata service"],
        },
        {
            "id": "W-DB",
            "target_assets": [{"ip": "10.60.30.25", "role": "billing-db", "match": "dst"}],
            "reason": "database only from app and admin",
            "detection_hints": [
                HINT("dst_port", "eq", 5432), HINT("src_ip", "not_in_cidr", ["10.60.20.0/24", "10.60.50.0/24"]),
            ],
            "routing_policy": {"review_threshold": 0.08, "max_threshold_drop": 0.2, "action": "tier1_llm", "reason": "db rule"},
        },
        {
            "id": "W-LAB",
            "target_assets": [{"ip": "10.60.20.30", "match": "dst"}],
            "reason": "exposed web server",
            "detection_hints": [
                HINT("dst_port", "in", [8080, 8443]), HINT("recent_source_same_dst_port_count", "gte", 2),
            ],
            "likely_benign_when": ["single access"],
        },
        {
            "id": "W-DNS",
            "target_assets": [{"cidr": "10.60.100.0/24", "match": "src"}],
            "reason": "dns tunnelling from workstations",
            "detection_hints": [
                HINT("dst_port", "eq", 53), HINT("protocol", "eq", 17), HINT("dst_ip", "not_in_cidr", INTERNAL),
                HINT("recent_source_same_dst_port_count", "gte", 2), HINT("src_ip", "in_cidr", ["10.60.100.0/24"]),
            ],
            "benign_hints": [HINT("dst_ip", "eq", "10.60.60.5")],
            "trigger_groups": [
                {
                    "name": "external_dns_tunnel",
                    "required": [
                        HINT("dst_port", "eq", 53), HINT("protocol", "eq", 17), HINT("dst_ip", "not_in_cidr", INTERNAL),
                    ],
                    "supporting": [HINT("recent_source_same_dst_port_count", "gte", 2), HINT("query_rate", "gt", 10)],
                    "min_supporting": 0,
                }
            ],
            "routing_policy": {"review_threshold": 0.04, "max_threshold_drop": 0.2, "action": "tier1_llm"},
        },
        {
            "id": "W-VPN",
            "target_assets": [{"ip": "203.0.113.20", "match": "dst"}],
            "reason": "known malicious sources on the gateway",
            "detection_hints": [HINT("dst_port", "eq", 443), HINT("src_ip", "in", ["198.51.100.77", "198.51.100.88"])],
        },
        {
            "id": "W-PORTAL",
            "target_assets": [{"ip": "203.0.113.10", "match": "bogus"}],
            "reason": "public portal",
            "detection_hints": ["dst_port in [80, 443]"],
        },
        {
            "id": "W-BADPOL",
            "target_assets": [{"ip": "10.60.60.5", "match": "dst"}],
            "reason": "resolver",
            "detection_hints": [HINT("dst_port", "eq", 53), HINT("src_ip", "eq", "10.60.100.33"), HINT("unknown_field", "gt", 1)],
            "routing_policy": {"review_threshold": 0.9},
        },
    ],
    "priority_2": [
        {
            "id": "W-NAS",
            "target_assets": [{"ip": "10.60.40.12", "match": "dst"}],
            "reason": "backup share from workstations",
            "detection_hints": [HINT("dst_port", "eq", 445), HINT("src_ip", "in_cidr", ["10.60.100.0/24"])],
            "routing_policy": {"review_threshold": 0.1},
        },
    ],
    "priority_3": [
        {"id": "W-WIDE", "target_assets": [{"cidr": "10.60.0.0/16"}], "reason": "everything inside"},
    ],
}

#: The same with items that look at what earlier runs decided about a source.
FEEDBACK_WATCHLIST = {
    **WATCHLIST,
    "priority_1": [
        *WATCHLIST["priority_1"],
        {
            "id": "W-ALERTED",
            "target_assets": [{"cidr": "198.51.100.0/24", "match": "src"}],
            "reason": "outside source with recent alerts",
            "detection_hints": [HINT("recent_source_alert_count", "gte", 1)],
        },
        {
            "id": "W-AGAIN",
            "target_assets": [{"cidr": "10.60.50.0/24", "match": "src"}],
            "reason": "source with recent watchlist hits",
            "detection_hints": [HINT("watchlist_hit_count", "gt", 3), HINT("dst_port", "in", [443, 8443])],
        },
    ],
}
