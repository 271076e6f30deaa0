import pytest

from netsift.llm import chat_format as C


def brute(chosen, rejected):
    render = lambda turns: "".join(f"<|{r}|>\n{t}<|end|>\n" for r, t in turns)
    n = 0
    while n < min(len(chosen), len(rejected)) and chosen[n] == rejected[n]:
        n += 1

    def mask(turns):
        at, out = 0, []
        for role, text in turns:
            start, at = at + len(f"<|{role}|>\n"), at + len(render([(role, text)]))
            if role == "assistant":
                out.append(f"{start}:{at - 1}")
        return ",".join(out)

    return (n, render(chosen[:n]), render(chosen[n:]), render(rejected[n:]), mask(chosen[n:]), mask(rejected[n:]))


@pytest.mark.parametrize("chosen, rejected", [
    ([("user", "a"), ("assistant", "b")], [("user", "a"), ("assistant", "c")]),
    ([("user", "a")], [("user", "a"), ("assistant", "c"), ("user", "é🙂"), ("assistant", "ö")]),
    ([("user", "a")], [("user", "a")]), ([], [("assistant", "x")]), ([], []),
    ([("user", "a"), ("assistant", "a")], [("assistant", "a"), ("user", "a")]),
])
def test_prefix_and_masks(spark, chosen, rejected):
    shape = "pair_id int, chosen array<struct<role:string,text:string>>, rejected array<struct<role:string,text:string>>"
    row = C.format_preferences(spark.createDataFrame([(1, chosen, rejected)], shape)).first()
    assert tuple(row)[1:] == brute(chosen, rejected)


def test_odd_turns(spark):
    rows = [
        (1, 0, "user", "q"), (1, 1, "assistant", "one"), (1, 2, "user", None), (1, 3, None, "<|end|>"), (1, 4, "assistant", "two"), (1, None, "system", "s"),
        (2, 0, "assistant", "only"), (3, 0, "user", ""), (3, 0, "user", ""), (None, 0, "user", "lost"),
    ]
    turns = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string").selectExpr("*", "1 t", "'x' turns", "2 pair_id")
    got = {r.pair_id: r for r in C.format_preferences(C.stale_reply_pairs(C.conversations(turns))).collect()}
    assert {*got} == {1, 2, 3}
    assert got[1].prompt == "<|system|>\ns<|end|>\n<|user|>\nq<|end|>\n<|assistant|>\none<|end|>\n<|user|>\n<|end|>\n<|unknown|>\n< |end|><|end|>\n"
    assert (got[1].chosen, got[1].rejected, got[1].chosen_mask) == ("<|assistant|>\ntwo<|end|>\n", "<|assistant|>\none<|end|>\n", "14:24")
    assert (got[2].prompt_turns, got[2].rejected) == (0, "<|assistant|>\n<|end|>\n")
    assert (got[3].prompt_turns, got[3].chosen, got[3].rejected) == (2, "", "")
    assert C.conversations(turns.limit(0)).collect() == []


def test_no_python(spark):
    from netsift.llm.registry import table

    frame = C.op9_chat_format(spark, "/root/testdata/sf0.001")
    plan = frame._jdf.queryExecution().executedPlan().toString()
    assert not any(word in plan for word in ("Python", "Arrow", "Pandas", "CartesianProduct"))
    assert frame.count() == table(spark, "/root/testdata/sf0.001", "conversations").select("conv_id").distinct().count()
