"""Matcher cases: one flow each, by hand; and both matcher forms on the same flows."""

import pytest
from pyspark.sql import functions as F

from netsift import constants as K
from netsift.functions import hints as H
from netsift.operators import curation, match, matching, matching_tables, routing, watchlist

FLOW = "flow_id string, src_ip string, dst_ip string, src_port int, dst_port int, protocol string, ml_prob double, features map<string,string>, same_dst_port_count bigint"


def hint(field, operator, value):
    return {"field": field, "operator": operator, "value": value}


def flow(spark, **kw):
    base = {"flow_id": "f", "src_ip": "198.51.100.9", "dst_ip": "10.0.0.5", "src_port": 1, "dst_port": 443, "protocol": "6", "ml_prob": 0.15, "features": {}, "same_dst_port_count": 0}
    df = spark.createDataFrame([tuple({**base, **kw}.values())], FLOW)
    zero = F.lit(0).cast("bigint")
    return df.withColumns({c: zero for c in ("flow_count", "distinct_dst_count", "same_dst_count", "watchlist_hit_count", "recent_alert_count")})


def both(spark, flows, *items, priority="priority_1", activity=True):
    """The match of the only flow, after checking that the two forms agree."""
    tables = watchlist.load_watchlist(watchlist.document_frame(spark, {priority: list(items)}))
    one = matching.match_watchlist(flows, matching.collect_rules(tables), activity=activity).first()["match"]
    rows = matching_tables.match_watchlist(flows, tables, activity=activity).collect()
    if not rows:
        assert not one["matched"]
    else:
        two = rows[0]["match"]
        for name in two.__fields__:
            assert two[name] == one[name], name
    return one


TARGET = [{"ip": "10.0.0.5"}]


@pytest.mark.parametrize(
    "hints, kw, strength, completeness",
    [
        ([hint("dst_port", "in", [443])], {}, "asset_service", "partial"),
        ([hint("dst_port", "in", [80])], {}, "asset_only", "scope_only"),
        ([hint("src_ip", "in", ["198.51.100.9"])], {}, "threat_source", "strong"),
        ([hint("src_ip", "not_in_cidr", ["10.0.0.0/8"])], {}, "policy_violation", "strong"),
        ([hint("src_ip", "not_in_cidr", ["10.0.0.0/8"])], {"src_ip": "not an ip"}, "policy_violation", "strong"),
        ([hint("src_ip", "in_cidr", ["2001:db8::/32"]), hint("dst_port", "eq", 443)], {"src_ip": "2001:db8::9"}, "review_candidate", "required_met"),
        ([hint("recent_source_same_dst_port_count", "gte", 2)], {"same_dst_port_count": 3}, "behavior", "strong"),
        ([hint("missing_feature", "gt", 1)], {}, "asset_only", "scope_only"),
        ([hint("dst_port", "in", 443)], {}, "asset_only", "scope_only"),
        ([hint("x", "eq", True), hint("dst_port", "eq", "443")], {"features": {"x": "yes"}}, "asset_service", "partial"),
        (["dst_port in [80, 443]"], {}, "asset_service", "partial"),
    ],
)
def test_strengths(spark, hints, kw, strength, completeness):
    found = both(spark, flow(spark, **kw), {"id": "A", "target_assets": TARGET, "detection_hints": hints})
    assert (found["match_strength"], found["trigger_completeness"]) == (strength, completeness)


def test_groups_need_all_required(spark):
    item = {
        "id": "G", "target_assets": [{"cidr": "198.51.100.0/24", "match": "src"}],
        "detection_hints": [hint("dst_port", "eq", 443), hint("src_ip", "in_cidr", ["198.51.100.0/24"])],
        "trigger_groups": [{"name": "a", "required": [hint("dst_port", "eq", 53)], "supporting": [hint("protocol", "eq", 6)], "min_supporting": 1},
                           {"name": "b", "required": [hint("dst_port", "eq", 443), hint("nope", "eq", 1)]}],
    }
    found = both(spark, flow(spark), item)
    assert found["match_strength"] == "asset_service" and found["trigger_completeness"] == "partial"
    assert "unrecognized trigger hint: nope" in found["unmatched_trigger_hints"]
    assert found["scope_conditions"][-1] == "src_ip in ['198.51.100.0/24']"


def test_best_item_prefers_strength_then_priority_then_order(spark):
    weak = {"id": "A", "target_assets": TARGET, "detection_hints": [hint("dst_port", "eq", 443)]}
    same = {"id": "B", "target_assets": TARGET, "detection_hints": [hint("protocol", "eq", 6)]}
    strong = {"id": "C", "target_assets": TARGET, "detection_hints": [hint("src_ip", "in", ["198.51.100.9"])]}
    assert both(spark, flow(spark), weak, same)["item_id"] == "A"
    assert both(spark, flow(spark), weak, strong)["item_id"] == "C"
    assert both(spark, flow(spark), weak, priority="priority_3")["priority"] == "priority_3"


def test_without_activity_recent_hints_are_unrecognised(spark):
    item = {"id": "A", "target_assets": TARGET, "detection_hints": [hint("recent_source_same_dst_port_count", "gte", 2)]}
    assert both(spark, flow(spark, same_dst_port_count=5), item, activity=False)["match_strength"] == "asset_only"


def test_no_scope_no_match(spark):
    assert not both(spark, flow(spark, dst_ip="10.0.0.6"), {"id": "A", "target_assets": TARGET})["matched"]


def many_flows(spark):
    """Flows of both families against a few ports."""
    ips = ["10.0.0.5", "10.0.7.9", "2001:db8::5", "2001:DB8:0:1::9", "198.51.100.9", "fd00::1", "not an ip", "::ffff:10.0.0.5"]
    rows = [(f"f{i}-{j}-{port}", a, b, 1, port, "6", 0.15, {}, 0) for i, a in enumerate(ips) for j, b in enumerate(ips) for port in (80, 443)]
    zero = F.lit(0).cast("bigint")
    return spark.createDataFrame(rows, FLOW).withColumns({c: zero for c in ("flow_count", "distinct_dst_count", "same_dst_count", "watchlist_hit_count", "recent_alert_count")})


def test_both_forms_agree_on_both_families(spark):
    items = [
        {"id": "v6 range", "target_assets": [{"cidr": "2001:db8::/33"}], "detection_hints": [hint("dst_port", "eq", 443)]},
        {"id": "v6 address", "target_assets": [{"ip": "fd00::1", "match": "src"}], "detection_hints": [hint("dst_ip", "in_cidr", ["2001:db8::/47", "10.0.0.0/21"])]},
        {"id": "v4 range", "target_assets": [{"cidr": "10.0.0.0/16"}], "detection_hints": [hint("src_ip", "not_in_cidr", ["10.0.0.0/8", "2001:db8::/32"])]},
        {"id": "everything", "target_assets": [{"cidr": "::/0", "match": "dst"}, {"cidr": "0.0.0.0/0", "match": "dst"}], "detection_hints": []},
    ]
    tables = watchlist.load_watchlist(watchlist.document_frame(spark, {"priority_2": items}))
    flows = many_flows(spark)
    one = {r["flow_id"]: r["match"] for r in match.match_flows(flows, tables).collect()}
    two = {r["flow_id"]: r["match"] for r in match.joined_match(flows, tables).collect()}
    assert one == two and {m["item_id"] for m in one.values()} == {"v6 range", "v6 address", "v4 range", "everything", None}


def test_watchlist_of_any_size(spark):
    """More items than the compiled form takes: the answer is that of the one item in scope."""
    asked = {"id": "asked", "target_assets": TARGET, "detection_hints": [hint("dst_port", "eq", 443)]}
    items = [{"id": f"I{i}", "target_assets": [{"ip": f"10.9.{i // 250}.{i % 250}"}]} for i in range(300)] + [asked]
    large = watchlist.load_watchlist(watchlist.document_frame(spark, {"priority_1": items}))
    with pytest.raises(matching.WatchlistTooLarge):
        matching.collect_rules(large)
    small = watchlist.load_watchlist(watchlist.document_frame(spark, {"priority_1": [asked]}))
    flows = many_flows(spark)
    one, two = ({r["flow_id"]: r["match"] for r in match.match_flows(flows, w).collect()} for w in (small, large))
    assert one == two and any(m["matched"] for m in one.values())


def test_item_numbers_do_not_meet(spark):
    """Numbers of one priority never reach those of the next, however long the list."""
    assert watchlist.ITEM_SPACING > 2**31 and matching.SEQ_SPACE > 3 * watchlist.ITEM_SPACING


@pytest.mark.parametrize(
    "prob, hints, policy, route, threshold",
    [
        (0.96, [], None, "auto_alert", 0.2),
        (0.95, [], None, "tier1_llm", 0.2),
        (0.10, [], None, "auto_dismiss", 0.2),
        (0.10, [hint("src_ip", "not_in_cidr", ["10.0.0.0/8"])], None, "tier1_llm", 0.08),
        (0.07, [hint("src_ip", "not_in_cidr", ["10.0.0.0/8"])], None, "auto_dismiss", 0.08),
        (0.05, [hint("src_ip", "not_in_cidr", ["10.0.0.0/8"])], {"review_threshold": 0.05, "max_threshold_drop": 0.2}, "tier1_llm", 0.05),
        (0.05, [hint("src_ip", "not_in_cidr", ["10.0.0.0/8"])], {"review_threshold": 0.05, "max_threshold_drop": 0.1}, "auto_dismiss", 0.08),
        (0.01, [hint("dst_ip", "eq", "169.254.169.254"), hint("dst_port", "eq", 80)], None, "tier1_llm", 0.0),
    ],
)
def test_routes(spark, prob, hints, policy, route, threshold):
    metadata = any(h["value"] == "169.254.169.254" for h in hints)
    kw = {"dst_ip": "169.254.169.254", "dst_port": 80} if metadata else {}
    item = {"id": "A", "target_assets": [{"ip": kw.get("dst_ip", "10.0.0.5")}], "detection_hints": hints, "routing_policy": policy}
    tables = watchlist.load_watchlist(watchlist.document_frame(spark, {"priority_1": [item]}))
    row = routing.route_flows(matching.match_watchlist(flow(spark, ml_prob=prob, **kw), matching.collect_rules(tables))).first()
    assert row["route"] == route
    assert row["effective_review_threshold"] == pytest.approx(threshold)


def test_broken_document_is_an_empty_watchlist(spark):
    for text in ("not json", '{"priority_1": 5}', "[]"):
        assert watchlist.load_watchlist(watchlist.document_frame(spark, text)).items.count() == 0


def test_join_form_reads_its_flows_once(spark):
    seen = spark.sparkContext.accumulator(0)

    def work(batches):
        for batch in batches:
            seen.add(len(batch))
            yield batch

    flows = flow(spark)
    counted = flows.mapInPandas(work, flows.schema)
    tables = watchlist.load_watchlist(watchlist.document_frame(spark, {"priority_1": [{"id": "A", "target_assets": TARGET, "detection_hints": [hint("dst_port", "in", [443])]}]}))
    assert matching_tables.match_watchlist(counted, tables).count() == 1
    assert seen.value == 1


def test_scopes_are_kept_by_pair_of_addresses(spark):
    """Flows of one pair share its conditions; only ids that several rows have are looked up by flow."""
    rows = [(f"f{i}", "10.0.0.1", "10.0.0.9") for i in range(50)] + [("twice", "10.0.0.1", "10.0.0.9"), ("twice", "10.0.0.1", "10.0.0.8"), (None, None, "10.0.0.9")]
    flows = spark.createDataFrame(rows, "flow_id string, src_ip string, dst_ip string")
    items = [{"id": f"I{i}", "target_assets": [{"ip": "10.0.0.9"}, {"cidr": "10.0.0.0/24"}], "detection_hints": [hint("dst_port", "in", [443])]} for i in range(3)]
    targets = watchlist.load_watchlist(watchlist.document_frame(spark, {"priority_1": items})).targets
    scopes = matching_tables.flow_scopes(flows, targets)
    assert scopes.pairs.count() == 3 * 3 and [r.flow_id for r in scopes.repeated.collect()] == ["twice"]
    found = {(r.flow_id, r.item_seq): len(r.scope_conditions) for r in matching_tables.scope_join(flows, targets).collect()}
    assert len(found) == 3 * 52
    assert {n for (f, _), n in found.items() if f == "f7"} == {3} and {n for (f, _), n in found.items() if f == "twice"} == {5}
    assert {n for (f, _), n in found.items() if f is None} == {2}


def test_parsed_hints_say_what_hints_say(spark):
    """Values parsed once per flow and hints parsed once per item give the status of every hint on every flow."""
    features = [
        {"a": "1e3", "b": " TRUE ", "c": "10.0.0.9", "d": None, "src_ip": "spoofed"}, {"a": "NaN", "b": "0", "c": "2001:DB8::9", "d": "x"},
        {"a": "-0.0", "b": "", "c": "10.0.0.256", "d": "1000"}, {},
    ]
    flows = flow(spark, features=features[0], same_dst_port_count=1000)
    for more in features[1:]:
        flows = flows.unionByName(flow(spark, features=more, src_ip=None, dst_port=None, protocol="x"))
    fields = ["a", "b", "c", "d", "src_ip", "L4_DST_PORT", "protocol", "ml_prob", "recent_source_same_dst_port_count", "nothing"]
    values = [True, "false", 1000, "0", "x", "NaN", 0.15, None, [], [True, "x"], ["1000.0", None, "0"], ["10.0.0.0/24", "no range", "2001:db8::/32"]]
    operators = ["eq", "in", "not_in", "nin", "in_cidr", "not_in_cidr", "gt", "gte", "lt", "lte", "like", ""]
    hints = [hint(f, o, v) for f in fields for o in operators for v in values]
    document = {"priority_1": [{"id": "A", "target_assets": TARGET, "detection_hints": hints}]}
    rows = watchlist.to_tables(watchlist.raw_items(watchlist.document_frame(spark, document))).hints
    slots = H.hint_slots()
    packed = rows.withColumn("hint", matching_tables.packed_hint({name: at for at, name in enumerate(slots)}))
    asked = packed.crossJoin(flows.select(H.hint_env().alias("given"), *H.hint_values(flows, slots)))
    field = F.coalesce(F.try_element_at(matching_tables.literal_map(K.FIELD_ALIASES), "field"), "field")
    said = H.hint_status(F.col("given"), field, F.col("operator"), F.col("is_list"), F.col("vals"), F.col("ranges"))
    names = F.array(F.lit("unrecognized"), F.lit("no_match"), F.lit("match"))
    got = F.get(names, F.get(matching_tables._status(F.array("hint")), 0))
    found = asked.select("field", "operator", "vals", said.alias("said"), got.alias("got")).collect()
    assert [r for r in found if r.said != r.got] == []
    assert {r.said for r in found} == {"unrecognized", "no_match", "match"} and len(found) == 4 * len(hints)


def test_grading_parses_nothing_and_moves_what_is_read(spark):
    item = {
        "id": "A", "target_assets": TARGET, "detection_hints": [hint("dst_port", "in", [443])],
        "trigger_groups": [{"name": "a", "required": [hint("dst_port", "eq", 443), hint("src_ip", "not_in_cidr", ["10.0.0.0/8"])]}],
    }
    rows = matching_tables.item_rows(flow(spark), watchlist.load_watchlist(watchlist.document_frame(spark, {"priority_1": [item]})))
    plan = lambda df: df._jdf.queryExecution().optimizedPlan().toString()
    number = "[eE]"  # of the pattern that numbers are read by
    groups = rows.filter(F.col("g").isNotNull()).select("flow_id", "g.complete", "g.supported")
    assert number not in plan(groups) and [(r.complete, r.supported) for r in groups.collect()] == [(True, False)]
    best = matching_tables.best_match(rows).select("flow_id", "match.item_id", "match.match_strength")
    assert not any(word in plan(best) for word in (number, "unmatched_list", "max_by(reason", "max_by(alert_when"))
    assert [(r.item_id, r.match_strength) for r in best.collect()] == [("A", "asset_service")]


def test_curation_steps_end_their_plans(spark):
    """No table of an enriched draft carries the plans of the steps before it."""
    table = lambda kinds, *rows: spark.createDataFrame(list(rows), kinds)
    context = curation.Context(
        table("seq int, ip string, role string, zone string, services array<string>, criticality string, status string, policy_rule string",
              (1, "10.0.0.5", "billing-database", "db", ["postgres"], "high", "active", "external egress forbidden")),
        table("zone_seq int, cidr string, zone string", (1, "10.1.0.0/16", "clinic-workstations"), (2, "10.2.0.0/16", "internal-app")),
        table("seq int, affects_assets array<string>, affected_ports array<int>, title string, content string, observables array<string>",
              (1, ["10.0.0.5"], [5432], "t", "repeated probing", ["benign once"])),
        table("seq int, name string, condition string, dst_ip string, dst_port int, protocol string", (1, "dns tunnel", "workstation dns", None, 53, "17")),
        table("seq int, ip string, tags string", (1, "198.51.100.9", "database-scanner")),
    )
    done = curation.enhance_watchlist(curation.draft_from_seed(curation.seed_watchlist(context.assets, "2024-01-31")), context)
    assert done.items.count() == 2 and done.hints.count() > 5
    for frame in (done.items, done.hints):
        assert frame._jdf.queryExecution().analyzed().toString().count("Join ") <= 4
