"""Batches of the stream handler against the batch operator."""

from netsift.operators import activity
from netsift.streaming import ingest

SCHEMA = "flow_id string, src_ip string, dst_ip string, dst_port int, protocol string, start_ms bigint"


def test_untimed_and_resent_flows(spark, tmp_path):
    """The last batch gets what the batch form gives over the last version of every flow; a batch without times is handed on."""
    row = lambda k, dst, at: (f"f{k}", "10.0.0.1", f"10.1.0.{dst}", 443, "6", at)
    batches = [
        [row(1, 1, 1_000), row(2, 1, 2_000), row(2, 1, 2_000), row(3, 2, None)],
        [row(4, 3, None)],
        [row(1, 2, 500_000_000), row(5, 1, 3_000), row(6, 2, None), row(6, 2, None)],
    ]
    seen = {}
    handle = ingest.activity_batches(f"{tmp_path}/flows", 180, lambda df, n: seen.setdefault(n, df.collect()))
    last = {}
    for n, rows in enumerate(batches):
        handle(spark.createDataFrame(rows, SCHEMA), n)
        last.update({r[0]: r for r in rows})
        want = activity.with_activity(spark.createDataFrame(list(last.values()), SCHEMA)).collect()
        ids = {r[0] for r in rows}
        plain = lambda found: sorted((r.asDict() for r in found if r.flow_id in ids), key=lambda r: r["flow_id"])
        assert plain(seen[n]) == plain(want)
        assert len(seen[n]) == len(ids)


def test_flows_without_id_are_kept(spark, tmp_path):
    """Each counts for its source and is handed on under an id of its own."""
    rows = [(None, "10.0.0.1", "10.1.0.1", 443, "6", 1_000), (None, "10.0.0.1", "10.1.0.1", 443, "6", 1_000), ("a", "10.0.0.1", "10.1.0.2", 443, "6", 2_000), (None, "10.0.0.1", "10.1.0.1", 443, "6", None)]
    seen = []
    ingest.activity_batches(f"{tmp_path}/flows", 180, lambda df, n: seen.extend(df.collect()))(spark.createDataFrame(rows, SCHEMA), 0)
    assert sorted((r.start_ms or 0, r.flow_count) for r in seen) == [(0, 3), (1_000, 0), (1_000, 0), (2_000, 2)]
    assert len({r.flow_id for r in seen}) == 4
