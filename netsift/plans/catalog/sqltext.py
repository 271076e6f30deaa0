"""SQL pieces shared by the counterpart texts (generic ANSI with list functions)."""

from __future__ import annotations

import json

from netsift.plans.fixtures import WATCHLIST

IPV4 = (
    r"^(25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])(\.(25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])){3}$"
)


def ip_int(col: str) -> str:
    parts = " + ".join(f"CAST(split_part({col}, '.', {i + 1}) AS BIGINT) * {256 ** (3 - i)}" for i in range(4))
    return f"(CASE WHEN regexp_matches({col}, '{IPV4}') THEN {parts} END)"


def between_cidr(col: str, *cidrs: str) -> str:
    import ipaddress

    tests = []
    for cidr in cidrs:
        net = ipaddress.ip_network(cidr, strict=False)
        tests.append(f"{ip_int(col)} BETWEEN {int(net.network_address)} AND {int(net.broadcast_address)}")
    return f"coalesce({' OR '.join(tests)}, false)"


def quote(value) -> str:
    if value is None:
        return "NULL"
    if isinstance(value, bool):
        return "true" if value else "false"
    if isinstance(value, (int, float)):
        return str(value)
    return "'" + str(value).replace("'", "''") + "'"


def values(name: str, columns: list[str], rows: list[list]) -> dict[str, str]:
    body = ", ".join("(" + ", ".join(quote(v) for v in row) + ")" for row in rows)
    return {name: f"SELECT * FROM (VALUES {body}) AS t({', '.join(columns)})"}


def _printed(value) -> str:
    return str(value)


def _word(op: str) -> str:
    return {"eq": "==", "in": "in", "in_cidr": "in", "not_in": "not in", "nin": "not in", "not_in_cidr": "not in"}.get(op, op)


def worked_watchlist(watchlist: dict = WATCHLIST) -> dict[str, str]:
    """A worked watchlist as relational constants (facts only, no derived strength)."""
    items, targets, hints = [], [], []
    seq = 0
    for rank, priority in enumerate(("priority_1", "priority_2", "priority_3")):
        for item in watchlist[priority]:
            seq += 1
            policy = item.get("routing_policy") or {}
            items.append([
                seq, priority, 3 - rank, item["id"], item["reason"], policy.get("review_threshold"), policy.get("max_threshold_drop"),
                policy.get("reason"), len(item.get("trigger_groups", [])),
            ])
            for n, target in enumerate(item["target_assets"]):
                side = target.get("match", "either")
                side = side if side in ("src", "dst", "either") else "either"
                targets.append([seq, n, target.get("ip"), target.get("cidr"), side])

            def add(kind, listed, seq=seq):
                for n, hint in enumerate(listed):
                    if isinstance(hint, str):
                        hints.append([seq, kind, n, "dst_port", "in", hint.split("[")[1].rstrip("]").replace(" ", "").replace(",", "|"), hint])
                        continue
                    value = hint["value"]
                    text = "|".join(str(v) for v in value) if isinstance(value, list) else str(value)
                    hints.append([seq, kind, n, hint["field"], hint["operator"], text, f"{hint['field']} {_word(hint['operator'])} {_printed(value)}"])

            add("detection", item.get("detection_hints", []))
            add("benign", item.get("benign_hints", []))
            for group in item.get("trigger_groups", []):
                add("required", group["required"])
                add("supporting", group["supporting"])
    ctes = {}
    ctes.update(values("wl_items", ["seq", "priority", "prio", "item_id", "reason", "threshold", "max_drop", "policy_reason", "n_groups"], items))
    ctes.update(values("wl_targets", ["seq", "tseq", "ip", "cidr", "side"], targets))
    ctes.update(values("wl_hints", ["seq", "kind", "hseq", "field", "op", "vals", "cond"], hints))
    return ctes


ACTIVITY = """SELECT a.flow_id, count(b.flow_id) AS flow_count, count(DISTINCT b.dst_ip) AS distinct_dst_count,
  count(b.flow_id) FILTER (WHERE b.dst_ip = a.dst_ip) AS same_dst_count,
  count(b.flow_id) FILTER (WHERE b.dst_ip = a.dst_ip AND b.dst_port = a.dst_port AND b.protocol = a.protocol) AS same_dst_port_count
FROM flows a LEFT JOIN flows b ON b.src_ip = a.src_ip AND b.start_ms < a.start_ms AND b.start_ms >= a.start_ms - {ms}
GROUP BY a.flow_id"""


FEEDBACK = """SELECT c.*, coalesce(h.hits, 0) AS watchlist_hit_count, coalesce(v.alerts, 0) AS recent_alert_count FROM ({counts}) c
  LEFT JOIN (SELECT a.flow_id, count(*) AS hits FROM flows a JOIN flows b ON b.src_ip = a.src_ip AND b.start_ms < a.start_ms AND b.start_ms >= a.start_ms - {ms}
    JOIN verdicts v ON v.flow_id = b.flow_id AND v.watchlist_matched <> '' GROUP BY a.flow_id) h ON h.flow_id = c.flow_id
  LEFT JOIN (SELECT flow_id, count(*) FILTER (WHERE verdict = 'alert') AS alerts FROM (SELECT a.flow_id, v.verdict, row_number() OVER (PARTITION BY a.flow_id ORDER BY b.start_ms DESC, b.flow_id DESC) AS rn
    FROM flows a JOIN flows b ON b.src_ip = a.src_ip AND b.start_ms < a.start_ms AND b.start_ms >= a.start_ms - {ms} JOIN verdicts v ON v.flow_id = b.flow_id AND v.verdict <> '') WHERE rn <= 5 GROUP BY flow_id) v ON v.flow_id = c.flow_id"""


def match_ctes(activity: bool = True, minutes: int = 180, watchlist: dict = WATCHLIST, feedback: bool = False) -> dict[str, str]:
    """From flows to graded (flow, item) rows and the best item, relationally."""
    ctes = worked_watchlist(watchlist)
    if feedback:
        ctes["act"] = FEEDBACK.format(counts=ACTIVITY.format(ms=minutes * 60000), ms=minutes * 60000)
    elif activity:
        ctes["act"] = ACTIVITY.format(ms=minutes * 60000)
    else:
        ctes["act"] = "SELECT flow_id, CAST(NULL AS BIGINT) AS same_dst_port_count FROM flows"
    lo = "list_reduce(list_transform(string_split(split_part(cidr, '/', 1), '.'), lambda x: CAST(x AS BIGINT)), lambda p, q: p * 256 + q)"
    ctes["ranges"] = f"""SELECT seq, tseq, ip, cidr, side, CASE WHEN cidr IS NULL THEN NULL ELSE {lo} END AS lo,
      CASE WHEN cidr IS NULL THEN NULL ELSE CAST(pow(2, 32 - CAST(split_part(cidr, '/', 2) AS INT)) AS BIGINT) END AS size FROM wl_targets"""
    told = "act.watchlist_hit_count, act.recent_alert_count" if feedback else "0 AS watchlist_hit_count, 0 AS recent_alert_count"
    ctes["env"] = f"SELECT f.*, act.same_dst_port_count, {told}, {ip_int('f.src_ip')} AS src_n, {ip_int('f.dst_ip')} AS dst_n FROM flows f JOIN act USING (flow_id)"
    part = (
        "SELECT e.flow_id, r.seq, r.tseq * 10 + {n} AS pos, {text} AS cond, '{kind}' AS kind FROM env e JOIN ranges r ON {test} AND r.side IN ('{side}', 'either')"
    )
    pieces = []
    for n, side in ((0, "dst"), (1, "src")):
        pieces.append(part.format(n=n, text=f"'target_assets.ip == flow.{side}_ip'", kind=f"ip_{side}", test=f"r.ip = e.{side}_ip", side=side))
    for n, side in ((2, "dst"), (3, "src")):
        pieces.append(part.format(
            n=n, text=f"'target_assets.cidr ' || r.cidr || ' contains flow.{side}_ip'", kind=f"cidr_{side}",
            test=f"e.{side}_n BETWEEN r.lo AND r.lo + r.size - 1", side=side,
        ))
    ctes["scope_rows"] = " UNION ALL ".join(pieces)
    ctes["scoped"] = """SELECT flow_id, seq, list(cond ORDER BY pos) AS base, bool_or(kind = 'cidr_src') AS src_range,
      bool_or(kind IN ('ip_src', 'cidr_src')) AS from_src FROM scope_rows GROUP BY flow_id, seq"""
    actual = """CASE h.field WHEN 'src_ip' THEN e.src_ip WHEN 'dst_ip' THEN e.dst_ip WHEN 'dst_port' THEN CAST(e.dst_port AS VARCHAR)
      WHEN 'protocol' THEN e.protocol WHEN 'recent_source_same_dst_port_count' THEN CAST(e.same_dst_port_count AS VARCHAR)
      WHEN 'recent_source_alert_count' THEN CAST(e.recent_alert_count AS VARCHAR) WHEN 'watchlist_hit_count' THEN CAST(e.watchlist_hit_count AS VARCHAR) END"""
    number = "list_reduce(list_transform(string_split(split_part(c, '/', 1), '.'), lambda x: CAST(x AS BIGINT)), lambda p, q: p * 256 + q)"
    ctes["hint_ranges"] = f"""SELECT seq, kind, hseq, list({number}) AS los, list({number} + CAST(pow(2, 32 - CAST(split_part(c, '/', 2) AS INT)) AS BIGINT) - 1) AS his
      FROM (SELECT seq, kind, hseq, unnest(string_split(vals, '|')) AS c FROM wl_hints WHERE op IN ('in_cidr', 'not_in_cidr')) GROUP BY ALL"""
    inside = """list_bool_or(list_transform(list_zip(hr.los, hr.his), lambda z: (CASE h.field WHEN 'src_ip' THEN e.src_n ELSE e.dst_n END) BETWEEN z[1] AND z[2]))"""
    ctes["hint_rows"] = f"""SELECT e.flow_id, h.seq, h.kind, h.hseq, h.field, h.op, h.vals, h.cond, s.base, s.src_range, s.from_src,
      ({actual}) IS NOT NULL AS known,
      CASE h.op WHEN 'eq' THEN ({actual}) = h.vals WHEN 'in' THEN list_contains(string_split(h.vals, '|'), ({actual}))
        WHEN 'gte' THEN TRY_CAST(({actual}) AS DOUBLE) >= TRY_CAST(h.vals AS DOUBLE) WHEN 'gt' THEN TRY_CAST(({actual}) AS DOUBLE) > TRY_CAST(h.vals AS DOUBLE)
        WHEN 'in_cidr' THEN {inside} WHEN 'not_in_cidr' THEN NOT {inside} ELSE false END AS yes,
      CASE WHEN h.field IN ('dst_port', 'protocol') THEN 'asset_service'
        WHEN h.field = 'dst_ip' AND (h.op = 'not_in_cidr' OR h.vals = '169.254.169.254') THEN 'review_candidate' WHEN h.field = 'dst_ip' THEN 'asset_service'
        WHEN h.field = 'src_ip' AND h.op = 'not_in_cidr' THEN 'policy_violation' WHEN h.field = 'src_ip' AND h.op = 'in' THEN 'threat_source'
        WHEN h.field = 'src_ip' THEN 'review_candidate' WHEN h.field LIKE 'recent_source_%' OR h.field = 'watchlist_hit_count' THEN 'behavior' ELSE 'none' END AS strength
      FROM scoped s JOIN env e USING (flow_id) JOIN wl_hints h USING (seq) LEFT JOIN hint_ranges hr ON hr.seq = h.seq AND hr.kind = h.kind AND hr.hseq = h.hseq"""
    ctes["hinted"] = """SELECT *, coalesce(known AND yes, false) AS hit, coalesce(known AND NOT yes, false) AS miss,
      (field = 'src_ip' AND op = 'in_cidr' AND src_range) AS scoped_only FROM hint_rows"""
    fired = "kind = 'detection' AND hit AND NOT scoped_only"
    ctes["graded"] = f"""SELECT flow_id, seq,
      coalesce(bool_or(kind = 'detection' AND known), false) AS recognized, coalesce(bool_or({fired}), false) AS fired_any,
      coalesce(bool_or({fired} AND field = 'dst_ip' AND op = 'eq' AND vals = '169.254.169.254'), false)
        AND coalesce(bool_or({fired} AND field = 'dst_port' AND list_contains(string_split(vals, '|'), '80')), false) AS metadata,
      coalesce(bool_or({fired} AND strength = 'policy_violation'), false) AS f_policy, coalesce(bool_or({fired} AND strength = 'threat_source'), false) AS f_threat,
      coalesce(bool_or({fired} AND strength = 'behavior'), false) AS f_behavior, coalesce(bool_or({fired} AND strength = 'review_candidate'), false) AS f_review,
      coalesce(bool_or({fired} AND strength = 'asset_service'), false) AS f_service,
      coalesce(bool_or({fired} AND field = 'dst_ip' AND op = 'not_in_cidr'), false)
        AND coalesce(bool_or({fired} AND field = 'dst_port' AND list_has_any(string_split(vals, '|'), ['53', '80', '443', '8080', '8443'])), false) AND bool_or(from_src) AS egress,
      coalesce(bool_and(hit) FILTER (WHERE kind = 'required'), false) AS group_done, coalesce(bool_or(hit) FILTER (WHERE kind = 'supporting'), false) AS supported,
      coalesce(bool_or(hit) FILTER (WHERE kind IN ('required', 'supporting')), false) AS group_hit,
      coalesce(list(cond ORDER BY hseq) FILTER (WHERE kind = 'detection' AND hit), []) AS hit_list,
      coalesce(list(cond ORDER BY hseq) FILTER (WHERE kind = 'detection' AND hit AND scoped_only), []) AS scoped_list,
      coalesce(list(cond ORDER BY hseq) FILTER (WHERE {fired}), []) AS fired_list,
      coalesce(list(cond ORDER BY hseq) FILTER (WHERE kind = 'detection' AND miss AND NOT scoped_only), []) AS miss_list,
      coalesce(list(cond ORDER BY hseq) FILTER (WHERE kind = 'benign' AND hit), []) AS benign_list,
      coalesce(list(cond ORDER BY kind, hseq) FILTER (WHERE kind IN ('required', 'supporting') AND hit), []) AS group_hits,
      coalesce(list(CASE WHEN known THEN cond ELSE 'unrecognized trigger hint: ' || field END ORDER BY kind, hseq) FILTER (WHERE kind IN ('required', 'supporting') AND NOT hit), []) AS group_misses,
      coalesce(list(CASE WHEN known THEN cond ELSE 'unrecognized trigger hint: ' || field END ORDER BY kind, hseq) FILTER (WHERE kind = 'supporting' AND NOT hit), []) AS support_misses
      FROM hinted GROUP BY flow_id, seq"""
    ctes["strengths"] = """SELECT s.flow_id, s.seq, s.base, i.n_groups, g.*  EXCLUDE (flow_id, seq),
      CASE WHEN NOT coalesce(g.fired_any, false) THEN 'asset_only' WHEN metadata THEN 'critical_forbidden' WHEN f_policy THEN 'policy_violation'
        WHEN f_threat THEN 'threat_source' WHEN f_behavior THEN 'behavior' WHEN f_review AND f_service AND egress THEN 'behavioral_review'
        WHEN f_review AND f_service THEN 'review_candidate' WHEN f_service THEN 'asset_service' ELSE 'asset_only' END AS combined
      FROM scoped s JOIN wl_items i USING (seq) LEFT JOIN graded g ON g.flow_id = s.flow_id AND g.seq = s.seq"""
    ctes["results"] = """SELECT *, CASE WHEN NOT coalesce(recognized, false) THEN 'asset_only'
        WHEN n_groups > 0 AND NOT group_done THEN CASE WHEN fired_any OR group_hit THEN 'asset_service' ELSE 'asset_only' END ELSE combined END AS strength,
      CASE WHEN NOT coalesce(recognized, false) THEN 'scope_only'
        WHEN n_groups > 0 THEN CASE WHEN group_done AND supported THEN 'strong' WHEN group_done THEN 'required_met'
          WHEN fired_any OR group_hit THEN 'partial' ELSE 'scope_only' END
        WHEN NOT fired_any THEN 'scope_only' WHEN combined IN ('behavior', 'threat_source', 'policy_violation', 'critical_forbidden') THEN 'strong'
        WHEN combined IN ('review_candidate', 'behavioral_review') THEN 'required_met' ELSE 'partial' END AS completeness,
      list_concat(base, coalesce(hit_list, []), CASE WHEN n_groups > 0 THEN list_filter(group_hits, lambda x: NOT list_contains(list_concat(base, hit_list), x)) ELSE [] END) AS matched_list,
      list_concat(base, coalesce(scoped_list, [])) AS scope_list,
      list_concat(coalesce(fired_list, []), CASE WHEN n_groups > 0 THEN list_filter(group_hits, lambda x: NOT list_contains(fired_list, x)) ELSE [] END) AS trigger_list,
      list_concat(coalesce(miss_list, []), CASE WHEN n_groups > 0 THEN list_filter(CASE WHEN group_done THEN support_misses ELSE group_misses END, lambda x: NOT list_contains(miss_list, x)) ELSE [] END) AS unmatched_list
      FROM strengths"""
    rank = """CASE strength WHEN 'critical_forbidden' THEN 8 WHEN 'policy_violation' THEN 7 WHEN 'threat_source' THEN 6 WHEN 'behavior' THEN 5
      WHEN 'behavioral_review' THEN 4 WHEN 'review_candidate' THEN 3 WHEN 'asset_service' THEN 2 WHEN 'asset_only' THEN 1 ELSE 0 END"""
    ctes["best"] = f"""SELECT * FROM (SELECT r.*, i.priority, i.item_id, i.reason, i.threshold, i.max_drop, i.policy_reason,
      row_number() OVER (PARTITION BY r.flow_id ORDER BY {rank} DESC, i.prio DESC, r.seq) AS rn FROM results r JOIN wl_items i USING (seq)) q WHERE rn = 1"""
    # Lint facts of the worked watchlist: the portal has no trigger, one policy is out of bounds, one is not priority 1.
    ctes["matches"] = """SELECT f.*, b.item_id, b.priority, b.reason, coalesce(b.strength, 'none') AS strength, coalesce(b.completeness, 'none') AS completeness,
      b.matched_list, b.scope_list, b.trigger_list, b.unmatched_list, coalesce(b.benign_list, []) AS benign_list, coalesce(b.item_id = 'W-PORTAL', false) AS context_only,
      CASE WHEN b.item_id IN ('W-BADPOL', 'W-NAS') THEN NULL ELSE CAST(b.threshold AS DOUBLE) END AS threshold, CAST(b.max_drop AS DOUBLE) AS max_drop, b.policy_reason,
      coalesce(b.strength IN ('review_candidate', 'behavioral_review', 'behavior', 'threat_source', 'policy_violation', 'critical_forbidden')
        AND b.completeness IN ('required_met', 'strong'), false) AS trigger_matched
      FROM flows f LEFT JOIN best b USING (flow_id)"""
    return ctes


def route_ctes(**settings) -> dict[str, str]:
    ctes = match_ctes(**settings)
    ctes["eff0"] = """SELECT *, mock_prob AS prob, (priority = 'priority_1' AND trigger_matched AND NOT context_only) IS TRUE AS may,
      CASE strength WHEN 'behavioral_review' THEN 0.12e0 WHEN 'behavior' THEN 0.12e0 WHEN 'threat_source' THEN 0.08e0
        WHEN 'policy_violation' THEN 0.08e0 WHEN 'critical_forbidden' THEN 0.04e0 ELSE 0.2e0 END AS base_t FROM matches"""
    ctes["eff1"] = """SELECT *, CASE WHEN threshold IS NULL THEN base_t WHEN threshold NOT BETWEEN 0.04e0 AND 0.3e0 THEN base_t
      WHEN 0.2e0 - threshold > max_drop THEN base_t ELSE threshold END AS cand FROM eff0"""
    ctes["eff2"] = """SELECT *, CASE WHEN may AND cand < 0.2e0 THEN cand ELSE 0.2e0 END AS review_t,
      CASE WHEN may AND cand < 0.2e0 THEN CASE WHEN threshold IS NOT NULL THEN coalesce(policy_reason, 'Tier 2 dynamic review threshold.')
        ELSE 'Default Tier 2 review threshold for ' || strength || ' match.' END END AS t_reason,
      prob > 0.95e0 AS above, (may AND strength = 'critical_forbidden' AND len(benign_list) = 0) AS hard FROM eff1"""
    ctes["eff3"] = "SELECT *, (hard AND NOT above) AS forced, (NOT above AND NOT hard AND may AND prob >= review_t) AS lowered FROM eff2"
    ctes["routed"] = """SELECT *, CASE WHEN above THEN 'auto_alert' WHEN forced OR lowered THEN 'tier1_llm' WHEN prob < 0.3e0 THEN 'auto_dismiss' ELSE 'tier1_llm' END AS route,
      CASE WHEN above THEN format('ML probability {:.2f} is above alert threshold.', prob)
        WHEN forced THEN 'Priority 1 critical-forbidden watchlist trigger bypassed the ML dismiss floor for Tier 1 review.'
        WHEN lowered THEN format('Priority 1 watchlist trigger match met the Tier 1 review threshold {:.2f} (match_strength={}).', review_t, strength)
        WHEN prob < 0.3e0 THEN format('ML probability {:.2f} is below dismiss threshold.', prob) ELSE 'ML probability is in the review band.' END AS route_reason,
      (forced OR lowered) AS adjusted_by_watchlist, CASE WHEN forced THEN 0e0 ELSE review_t END AS effective_review_threshold,
      CASE WHEN forced THEN prob < 0.2e0 ELSE lowered AND t_reason IS NOT NULL AND prob < 0.2e0 END AS dynamic_threshold_applied,
      CASE WHEN forced THEN 'Critical-forbidden Tier 2 trigger is a hard policy/security condition.'
        WHEN lowered AND t_reason IS NOT NULL AND prob < 0.2e0 THEN t_reason END AS dynamic_threshold_reason FROM eff3"""
    ctes["judged"] = """SELECT *, CASE WHEN route = 'auto_dismiss' THEN 'benign' WHEN route = 'auto_alert' OR prob >= 0.95e0
        OR (trigger_matched AND strength IN ('behavior', 'threat_source', 'policy_violation') AND prob >= 0.2e0) THEN 'alert' ELSE 'uncertain' END AS verdict FROM routed"""
    ctes["events_out"] = """SELECT *, CASE verdict WHEN 'benign' THEN 'low' WHEN 'alert' THEN 'high' ELSE 'medium' END AS severity,
      CASE WHEN route = 'auto_dismiss' THEN 'not_evaluated' ELSE 'mock' END AS category_hint,
      CASE WHEN route = 'auto_dismiss' THEN 0e0 ELSE 0.5e0 END AS category_confidence FROM judged"""
    return ctes


def json_text(value) -> str:
    return json.dumps(value, ensure_ascii=False)
