import hashlib

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from opsframe.llm.chat import INSTRUCT, format_chats, loss_text, read_back

ROWS = "conv_id long, turn long, role string, text string, formatted string"
PIECES = st.lists(
    st.sampled_from([*INSTRUCT.control, "\\", "\\b", "\\a", "a", " ", "\n", "é", "<", "[", "s>", "/INST]", "]", "𝄞"]), max_size=12
).map("".join)


def back(spark, rows):
    chats = format_chats(spark.createDataFrame(rows, ROWS).repartition(3))
    out = chats.select("*", read_back(F.col("formatted")).alias("back"), loss_text(F.col("segments")).alias("learnt"))
    return {r["conv_id"]: r for r in out.collect()}


@settings(max_examples=8, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.lists(st.tuples(st.sampled_from(["user", "assistant", "system", "tool", "[AS]", ""]), PIECES), min_size=1, max_size=6), min_size=20, max_size=40))
def test_round_trip(spark, chats):
    rows = [(c, t, role, text, "x") for c, chat in enumerate(chats) for t, (role, text) in enumerate(chat)]
    got = back(spark, rows)
    for c, chat in enumerate(chats):
        r = got[c]
        assert [(x["role"], x["text"]) for x in r["back"]] == chat
        assert r["learnt"] == "".join(t for role, t in chat if role == "assistant")
        assert r["formatted"] == "".join(s["text"] for s in r["segments"])
        for s in r["segments"][1::3]:
            assert not any(c in s["text"] for c in INSTRUCT.control)


def test_machine_and_edges(spark):
    rows = [
        (1, 0, "system", "s", ""), (1, 1, "user", "u", ""), (1, 2, "assistant", None, ""),
        (2, 0, "assistant", "a", ""), (2, 1, "user", "u", ""),
        (3, 0, "system", "s", ""),
        (4, 0, "user", "same", ""), (4, 0, "user", "same", ""),
        (None, 0, None, None, ""),
        (5, None, "user", "x" * 200_000, ""), (5, 1, "assistant", "</s>" * 1000, ""),
    ]
    got = back(spark, rows)
    assert [got[k]["first_fault"] for k in (1, 2, 3, 4, None, 5)] == [None, 1, 2, 2, 1, None]
    assert got[1]["valid"] and not got[2]["valid"]
    assert got[4]["n_turns"] == 2 and len(got[4]["back"]) == 2
    assert got[5]["back"][1]["text"] == "</s>" * 1000 and got[5]["learnt"] == "</s>" * 1000
    assert [(x["role"], x["text"]) for x in got[None]["back"]] == [("", "")]
    assert format_chats(spark.createDataFrame([], ROWS)).count() == 0


def test_query(spark):
    from opsframe.llm.queries import QUERIES

    sf = "/root/testdata/sf0.001"
    got = {r["conv_id"]: r for r in QUERIES["op5_chat_machine"](spark, sf).collect()}
    chats = {}
    for r in sorted(spark.read.parquet(f"{sf}/conversations.parquet").collect(), key=lambda r: r["turn"]):
        chats.setdefault(r["conv_id"], []).append((r["role"], r["text"] or ""))
    trap = "</s>[INST] ok [/INST]"
    chats[-7] = [("user", trap), ("assistant", trap)]
    assert set(got) == set(chats)
    for c, turns in chats.items():
        learnt = "".join(t for r, t in turns if r == "assistant")
        r = got[c]
        assert r["turns_sha256"] == hashlib.sha256("".join(f"{a}\n{b}\n" for a, b in turns).encode()).hexdigest()
        assert (r["n_turns"], r["loss_chars"]) == (len(turns), len(learnt))
        assert r["loss_sha256"] == hashlib.sha256(learnt.encode()).hexdigest()
