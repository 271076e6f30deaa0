"""Brute-force and example checks of single operators."""

import random

import pytest
from pyspark.sql import functions as F

from netsift import session
from netsift.operators import activity, learning, summary, tables, verdicts
from netsift.operators.ranks import lower_quantiles
from netsift.plans import inputs
from netsift.session import shared_folder
from netsift.sources import context, flows


def brute(rows, window):
    out = {}
    for fid, src, dst, port, proto, t, hit in rows:
        prior = [r for r in rows if r[1] == src and t - window <= r[5] < t]
        out[fid] = (
            len(prior), len({r[2] for r in prior}), sum(r[2] == dst for r in prior),
            sum(r[2:5] == (dst, port, proto) for r in prior), sum(r[6] for r in prior),
        )
    return out


@pytest.mark.parametrize("pane_rows", [5, 100_000])
def test_hot_source_activity_equals_brute_force(spark, pane_rows):
    """One source holds most rows, many share a millisecond; panes far below the window."""
    rng = random.Random(7)
    rows = [
        (f"f{i}", "hot" if rng.random() < 0.7 else f"s{rng.randrange(3)}", f"d{rng.randrange(4)}", rng.choice([53, 80]),
         rng.choice(["6", "17"]), rng.randrange(0, 60_000) // 50 * 50, rng.random() < 0.2)
        for i in range(400)
    ]
    df = spark.createDataFrame(rows, "flow_id string, src_ip string, dst_ip string, dst_port int, protocol string, start_ms bigint, hit boolean")
    got = {r[0]: tuple(r[1:]) for r in activity.trailing_counts(df, 10_000, pane_rows=pane_rows).collect()}
    assert got == brute(rows, 10_000)
    ports = {r[0]: r[1] for r in activity.top_ports(df, 10_000, pane_rows=pane_rows).collect()}
    for fid, src, _, _, _, t, _ in rows:
        prior = [r[3] for r in rows if r[1] == src and t - 10_000 <= r[5] < t]
        assert ports[fid] == sorted(set(prior), key=lambda p: (-prior.count(p), p))[:5]


def test_port_batches_without_flows(spark):
    """Batches of one row: those with a leaving tick or a carry row hold no flow."""
    rows = [(f"f{i}", "hot", 80 if i % 3 else 53, i * 100) for i in range(40)]
    df = spark.createDataFrame(rows, "flow_id string, src_ip string, dst_port int, start_ms bigint")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1")
    try:
        ports = dict(activity.top_ports(df, 1000, pane_rows=5).collect())
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    for fid, _, _, t in rows:
        seen = [p for _, _, p, at in rows if t - 1000 <= at < t]
        assert ports[fid] == sorted(set(seen), key=lambda p: (-seen.count(p), p))


def test_hot_sources_get_panes_of_equal_count(spark):
    df = spark.range(1000).select(F.lit("hot").alias("src_ip"), (F.col("id") * 1000).alias("at"))
    sizes = activity.with_panes(df, pane_rows=10).groupBy("pane").count().collect()
    assert len(sizes) == 100 and {r["count"] for r in sizes} == {10}
    assert activity.with_panes(df).select("pane").distinct().collect() == [(0,)]


def test_a_burst_narrows_its_own_panes_only(spark, monkeypatch):
    """3,000 flows in 30 s, then one a day for years: the quiet stretch keeps wide panes, their number stays bounded."""
    burst = spark.range(3000).select(F.lit("hot").alias("src_ip"), (F.col("id") * 10 + 600_000_000).alias("at"))
    quiet = spark.range(1000).select(F.lit("hot").alias("src_ip"), (F.col("id") * 86_400_000 + 700_000_000).alias("at"))
    rows = burst.union(quiet).union(spark.createDataFrame([("hot", 0), ("calm", 5)], "src_ip string, at bigint"))
    panes = activity.with_panes(rows, pane_rows=100)
    spans = panes.where("src_ip = 'hot'").groupBy("pane").agg(F.count("*").alias("n"), (F.max("at") - F.min("at")).alias("ms")).orderBy("pane").collect()
    assert max(r.n for r in spans) <= 100 and len(spans) <= 42
    assert max(r.ms for r in spans[1:29]) <= 1_000 and min(r.ms for r in spans[31:-1]) > 90 * 86_400_000
    assert panes.filter("src_ip = 'calm'").first()["pane"] == 0
    monkeypatch.setattr(activity, "MOST_PANES", 8)
    assert activity.with_panes(rows, pane_rows=100).select("src_ip", "pane").distinct().count() <= 10


def test_untimed_flows_count_in_triage(spark):
    """A flow without time sees all other rows of its source."""
    rows = [("a", "s", "d", 1, "6", 1000), ("b", "s", "d", 1, "6", None), ("c", "s", "e", 1, "6", 2000), ("d", "t", "d", 1, "6", None)]
    df = spark.createDataFrame(rows, "flow_id string, src_ip string, dst_ip string, dst_port int, protocol string, start_ms bigint")
    got = {r["flow_id"]: (r["flow_count"], r["distinct_dst_count"], r["same_dst_count"]) for r in activity.with_activity(df, 180).collect()}
    assert got == {"a": (0, 0, 0), "b": (2, 2, 1), "c": (1, 1, 0), "d": (0, 0, 0)}


def test_stored_verdicts_of_timed_and_untimed_flows(spark):
    """The newest five verdicts before a flow, or of the whole source without a time; own and empty ones do not count."""
    rng = random.Random(2)
    rows = [(f"f{i:02}", rng.choice("ab"), "d", 80, "6", None if i % 9 == 0 else rng.randrange(40) * 60_000) for i in range(60)]
    stored = [(r[0], rng.choice(["alert", "benign", ""]), rng.choice(["W", "", None])) for r in rows if rng.random() < 0.8]
    flows_ = spark.createDataFrame(rows, "flow_id string, src_ip string, dst_ip string, dst_port int, protocol string, start_ms bigint")
    got = {
        r.flow_id: (r.recent_verdicts, r.recent_alert_count, r.watchlist_hit_count)
        for r in activity.with_feedback(flows_, spark.createDataFrame(stored, "flow_id string, verdict string, watchlist_matched string"), 20).collect()
    }
    known = {f: (v, w) for f, v, w in stored}
    for fid, src, _, _, _, t in rows:
        seen = [r for r in rows if r[1] == src and r[0] != fid and (t is None or (r[5] is not None and t - 20 * 60_000 <= r[5] < t))]
        newest = sorted((r for r in seen if known.get(r[0], ("",))[0]), key=lambda r: (r[5] or 0, r[0]), reverse=True)[:5]
        verdicts_ = [known[r[0]][0] for r in newest]
        assert got[fid] == (verdicts_, verdicts_.count("alert"), sum(bool(known.get(r[0], ("", None))[1]) for r in seen)), fid


def test_lower_quantiles_take_the_lower_index(spark):
    values = [5.0, 1.0, 1.0, 2.0, 9.0, 9.0, 9.0, 3.0]
    df = spark.createDataFrame([(v,) for v in values], "x double")
    row = lower_quantiles(df, "x", [0.25, 0.5, 0.75]).first()
    ordered = sorted(values)
    assert [row["p25"], row["p50"], row["p75"]] == [ordered[int(7 * p)] for p in (0.25, 0.5, 0.75)]


def test_day_boundary_is_local(spark):
    from netsift.functions.timefn import in_local_day

    # 00:05 and 23:55 Seoul time are in, the next day 00:01 is out.
    rows = [(1, 1767193500000 + 0), (2, 1767193500000 + 23 * 3600_000 + 50 * 60_000), (3, 1767193500000 + 23 * 3600_000 + 56 * 60_000)]
    df = spark.createDataFrame(rows, "id int, start_ms bigint").withColumn("created_at", F.lit(None).cast("timestamp_ntz"))
    kept = df.filter(in_local_day(F.col("start_ms"), F.col("created_at"), "2026-01-01"))
    assert [r["id"] for r in kept.orderBy("id").collect()] == [1, 2]


@pytest.mark.parametrize(
    "text, verdict",
    [
        ('{"verdict": "alert", "severity": "high"}', "alert"),
        ('first {"a": 1} then {"verdict": "benign", "severity": "low"} end', "benign"),
        ('{"verdict": "benign", "severity": "low"} no {"verdict": "alert", "severity": "high"}', "alert"),
        ("[1, 2]", None),
        ("no object at all", None),
        ("{broken", None),
    ],
)
def test_salvage(spark, text, verdict):
    df = spark.createDataFrame([(text,)], "content string")
    parsed = verdicts.parse_responses(df).select(verdicts.response_struct(F.col("object_json")).alias("r")).first()["r"]
    assert (parsed["verdict"] if parsed else None) == verdict


def test_judge_retries_only_transient_errors(spark):
    df = spark.createDataFrame([("a", "slow"), ("b", "bad"), ("c", "fine")], "flow_id string, evidence string")

    def judge(text):
        if text == "slow":
            raise TimeoutError("timed out")
        if text == "bad":
            raise ValueError("max_tokens reached")
        return "{}"

    out = {r["flow_id"]: r["error"] for r in verdicts.model_judge(df, judge, retries=1, backoff_seconds=0.0).collect()}
    assert "after 2 attempts" in out["a"] and out["b"].startswith("LLM provider call failed: ") and out["c"] is None


def test_upsert_with_one_key_holding_most_rows(spark):
    old = spark.createDataFrame([("k", "old", 0)], "flow_id string, v string, seq int")
    new = spark.range(500).select(F.when(F.col("id") < 400, "k").otherwise(F.col("id").cast("string")).alias("flow_id"), F.col("id").cast("string").alias("v"), F.col("id").cast("int").alias("seq"))
    out = {r["flow_id"]: r["v"] for r in tables.upsert(old, new, "flow_id", ["seq"]).collect()}
    assert out["k"] == "399" and len(out) == 101


def test_context_errors(spark):
    rows = spark.createDataFrame([("assets", "assets", 0, None, True), ("assets", "assets", 1, None, False)], "source string, list_key string, pos bigint, ip string, valid boolean")
    status = {r["name"]: (r["status"], r["error"]) for r in context.source_status(rows, {"assets": True, "policy": True, "organization": False}).collect()}
    assert status == {"assets": ("error", "assets[1] must be a dictionary."), "policy": ("missing", ""), "organization": ("disabled", "")}
    with pytest.raises(ValueError):
        tables.delete_context(rows, "assets", "assets", 7)
    with pytest.raises(ValueError):
        tables.delete_context(rows, "assets", "trust", 0)


def test_csv_row_without_id_gets_a_stable_one(spark, tmp_path):
    path = tmp_path / "f.csv"
    path.write_text("flow_id,FLOW_START_MILLISECONDS,IPV4_SRC_ADDR,IPV4_DST_ADDR,L4_SRC_PORT,L4_DST_PORT,PROTOCOL,IN_BYTES,Label,Attack\n,1000,1.1.1.1,2.2.2.2,80.0,,6,7,0,\n")
    first, second = flows.read_csv(spark, str(path)).first(), flows.read_csv(spark, str(path)).first()
    assert first["flow_id"] == second["flow_id"] and first["flow_id"].startswith("flow-")
    assert (first["src_port"], first["dst_port"], first["features"], first["raw_attack"]) == (80, 0, {"IN_BYTES": "7"}, None)


def test_unmapped_attack(spark):
    df = spark.createDataFrame([(1, "New-Attack")], "Label int, Attack string")
    with pytest.raises(Exception, match="unmapped attack label"):
        learning.attack_frame(df).collect()


def test_risk_levels(spark):
    level = summary.risk_level(*[F.lit(v) for v in (0, 0, 0, 0)])
    worst = summary.risk_level(*[F.lit(v) for v in (0, 1, 0, 0)])
    assert spark.range(1).select(level.alias("a"), worst.alias("b")).first()[:] == ("quiet", "high_attention")


def test_shared_folder_follows_the_session(spark, monkeypatch):
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        assert shared_folder(spark) == named
    monkeypatch.setattr(session, "CHECKPOINT_KEY", "spark.checkpoint.unset")
    first = shared_folder(spark)
    assert first == shared_folder(spark) and "netsift-" in first


def test_every_customer_is_an_indicator(spark, data):
    assert inputs.view(spark, data, "indicators").count() == inputs.table(spark, data, "customer").count()


def test_seed_falls_back_without_important_assets(spark):
    from netsift import constants as K
    from netsift.operators import curation

    kind = "seq bigint, ip string, role string, criticality string, services array<string>"
    rows = [(1, "10.0.0.1", "laptop", "low", None), (2, "10.0.0.2", None, "high", ["ssh"])]
    seed = lambda part: curation.seed_watchlist(spark.createDataFrame(part, kind), "2024-01-31").collect()
    (only,) = seed(rows[:1])
    assert (only.item_id, only.ip, only.role, only.item_seq) == ("P1-20240131-001", K.SEED_SAMPLE_IP, "web-application-server", 0)
    assert [int(p) for p in only.ports] == [80, 443] and only.reason == K.SEED_FALLBACK["reason"]
    assert [r.ip for r in seed(rows)] == ["10.0.0.2"] and len(seed([])) == 1


def test_quota_of_a_hot_key(spark):
    from netsift.operators import sampling

    rows = [("hot", i * 7919 % 5_000) for i in range(5_000)] + [("cold", i) for i in range(3)] + [("other", 1)]
    frame = spark.createDataFrame(rows, "k string, i int")
    quotas = spark.createDataFrame([("hot", 40), ("cold", 9), ("none", 5)], "k string, quota int")
    got = sampling.quota_sample(frame, quotas, ["k"], "i", cells=16)
    assert sorted((r.k, r.i) for r in got.collect()) == [("cold", i) for i in range(3)] + [("hot", i) for i in range(40)]


def test_enrichment_scores_survivors_once(spark):
    from netsift.operators import routing

    seen = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            seen.add(len(batch))
            yield batch

    routed = spark.range(30).select(
        F.col("id").cast("string").alias("flow_id"), F.lit(0.5).alias("ml_prob"),
        F.element_at(F.array(F.lit("auto_dismiss"), F.lit("auto_alert"), F.lit("tier1_llm")), (F.col("id") % 3 + 1).cast("int")).alias("route"),
    )
    once = routed.mapInPandas(counted, routed.schema)
    out = routing.enrich_after_route(once, hint=lambda rows: routing.mock_hint(rows.mapInPandas(counted, rows.schema)))
    rows = out.collect()
    assert len(rows) == 30 and seen.value == 30 + 20
    assert {(r.route, r.category_hint, len(r.attributions)) for r in rows} == {
        ("auto_dismiss", "not_evaluated", 0), ("auto_alert", "mock", 0), ("tier1_llm", "mock", 1)
    }


def test_payload_lists_every_source_and_shows_used_ones(spark):
    """Rows of a source in error are not shown, missing ones are listed, the cut falls inside a row, equal positions sort by text."""
    from netsift.operators import curation

    status = spark.createDataFrame(
        [("a", "used", 3, ""), ("b", "error", 0, "bad row"), ("c", "missing", 0, ""), ("d", "used", 200, "")],
        "name string, status string, item_count bigint, error string",
    )
    one = spark.createDataFrame([(2, "x"), (1, "z"), (None, "y")], "pos bigint, v string")
    two = spark.createDataFrame([(0, "b"), (0, "a")], "pos bigint, v string")
    many = spark.createDataFrame([(k, f"{k:03}") for k in range(200)], "pos bigint, v string")
    rows = curation.source_table([("a", "pos", one), ("a", "pos", two), ("b", "pos", one), ("d", "pos", many)])
    got = {r["name"]: r for r in curation.curation_payload(rows, status, "day", 100).collect()}
    line = '{{"pos":{0},"v":"{1}"}}'.format
    assert got["a"]["content"] == "\n".join(['{"v":"y"}', line(1, "z"), line(2, "x"), line(0, "a"), line(0, "b")])[:100]
    assert (got["b"]["content"], got["b"]["error"], got["c"]["content"], got["c"]["status"]) == ("", "bad row", "", "missing")
    assert got["d"]["content"] == "\n".join(line(k, f"{k:03}") for k in range(200))[:100] + "\n... [truncated]"


def test_source_patterns_are_chosen_without_their_lists(spark):
    """The earliest pattern of an id counts, repeated or not, and no pattern carries the zone lists before it is chosen."""
    from netsift.operators import curation

    kind = "seq long, name string, condition string, dst_ip string, dst_port int, protocol int"
    rows = [(3, "dns tunnel", "workstation dns", None, 53, 17), (1, "dns tunnel", "dns from a workstation", None, 53, 17), (2, "Metadata", "metadata", "169.254.169.254", 80, 6), (4, "plain", "none", None, 1, 6)]
    zones = spark.createDataFrame([(1, "10.1.0.0/16", "workstations"), (2, "10.2.0.0/16", "internal-app")], "zone_seq long, cidr string, zone string")
    context = curation.Context(None, zones, None, spark.createDataFrame([*rows, rows[1]], kind), None)
    found = curation.source_pattern_rows(context)
    got = {r["seq"]: r for r in found.collect()}
    assert set(got) == {1, 2} and got[1]["condition"] == "dns from a workstation" and got[1]["kind"] == "dns" and got[2]["kind"] == "metadata"
    assert list(got[1]["cidrs"]) == ["10.1.0.0/16"] and got[1]["side"] == "src" and got[2]["cidrs"] == [] and got[2]["side"] == "dst"
    assert got[1]["workstation"] == ["10.1.0.0/16"]
    assert "min_by" not in found._jdf.queryExecution().toString()


def test_feedback_reads_its_flows_once(spark):
    seen = spark.sparkContext.accumulator(0)

    def work(batches):
        for batch in batches:
            seen.add(len(batch))
            yield batch

    flows = spark.createDataFrame([("a", "1.1.1.1", "2.2.2.2", 80, "6", 1000), ("b", "1.1.1.1", "2.2.2.2", 80, "6", 2000)],
                                  "flow_id string, src_ip string, dst_ip string, dst_port int, protocol string, start_ms bigint")
    stored = spark.createDataFrame([("a", "alert", "W-1")], "flow_id string, verdict string, watchlist_matched string")
    rows = {r.flow_id: r for r in activity.with_feedback(flows.mapInPandas(work, flows.schema), stored, 20).collect()}
    assert rows["b"].recent_alert_count == rows["b"].watchlist_hit_count == 1 and rows["a"].recent_alert_count == 0
    assert seen.value == 2
