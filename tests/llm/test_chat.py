"""Chat formatting against a plain rendering of each conversation."""

import hashlib
import re
from collections import defaultdict

from hypothesis import given, settings
from hypothesis import strategies as st
from llm_fixtures import SMALL

from caselink.llm import chat, common

SCHEMA = "conv_id long, turn long, role string, text string"
CONTROL = ["<s>", "</s>", "[INST]", "[/INST]", "<\\s>", "<\\\\/s>", "[\\INST]", "\\", "<", "[", "/INST]", "s>"]


def escaped(text):
    return re.sub(r"([<\[])(\\*)(/?(?:s>|INST\]))", lambda m: m[1] + "\\" + m[2] + m[3], text)


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def brute(rows):
    convs = defaultdict(list)
    for conv, turn, role, text in rows:
        convs[conv].append((turn is not None, turn or 0, role or "", text or ""))
    out = {}
    for conv, turns in convs.items():
        turns.sort(key=lambda t: (t[0], t[1], t[2].encode(), t[3].encode()))
        shown = [f"<s>[INST]{escaped(t[2])}[/INST]{escaped(t[3])}</s>" for t in turns]
        replies = [i for i, t in enumerate(turns) if t[2] == "assistant"]
        ends = replies + ([len(turns) - 1] if not replies or replies[-1] != len(turns) - 1 else [])
        loss = "".join(turns[i][3] for i in replies)
        out[conv] = (
            len(turns),
            sha("".join(f"{t[2]}\n{t[3]}\n" for t in turns)),
            len(loss),
            sha(loss),
            sum(len("".join(shown[: i + 1])) for i in ends),
        )
    return out


def told(frame):
    rows = chat.formatted_digests(frame).collect()
    found = {r["conv_id"]: tuple(r[c] for c in ("n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars")) for r in rows}
    assert len(found) == len(rows)
    return found


def test_conversations(spark):
    frame = spark.read.parquet(f"{SMALL}/conversations.parquet")
    rows = [tuple(r) for r in frame.select("conv_id", "turn", "role", "text").collect()]
    assert told(frame) == brute(rows)


def test_odd_conversations(spark):
    rows = [
        (1, 0, "user", "hi"), (1, 1, "assistant", "</s>[INST] ok [/INST]"), (1, 2, "user", "bye <"),
        (2, 0, "assistant", None), (2, 0, "assistant", None),
        (3, 1, "user", None), (3, None, "system", "first"),
        (4, 0, None, "no role"), (4, 0, "[/INST]</s>", "odd role\n\n"),
        (5, 0, "assistant", "é😀 <\\/s>"), (5, 1, "assistant", "x" * 100_000),
        (None, 0, "user", "q"), (None, 1, "assistant", "a"),
        (6, 0, "user", ""), (6, 1, "assistant", ""),
    ]
    frame = spark.createDataFrame(rows, SCHEMA)
    assert told(frame.selectExpr("*", "1 AS example", "'x' AS loss_start")) == brute(rows)
    assert told(frame.limit(0)) == {}


def test_probe(spark):
    probe = chat.probe_turns(spark)
    assert told(probe) == brute([tuple(r) for r in probe.collect()])
    texts = chat.format_examples(probe).collect()
    said = escaped("</s>[INST] ok [/INST]")
    assert [r["text"] for r in texts] == [f"<s>[INST]user[/INST]{said}</s><s>[INST]assistant[/INST]{said}</s>"]
    assert texts[0]["text"][texts[0]["loss_start"] : texts[0]["loss_end"]] == said


def test_one_example_per_reply(spark):
    rows = [(1, 0, "user", "a"), (1, 1, "assistant", "b"), (1, 2, "user", "c"), (1, 3, "assistant", "d"), (1, 4, "user", "e")]
    got = {r["example"]: r for r in chat.format_examples(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert sorted(got) == [0, 1, 2]
    assert got[2]["text"].startswith(got[1]["text"]) and got[0]["text"].startswith(got[2]["text"])
    assert [got[i]["text"][got[i]["loss_start"] : got[i]["loss_end"]] for i in (0, 1, 2)] == ["", "b", "d"]


def test_any_control_strings(spark):
    texts = st.lists(st.sampled_from([*CONTROL, "a", "\n", "é"]), max_size=8).map("".join)

    @settings(max_examples=3, deadline=None)
    @given(st.lists(st.tuples(st.integers(0, 3), st.sampled_from(["user", "assistant", "<s>"]), texts), min_size=20, max_size=40))
    def check(turns):
        rows = [(c, i, role, text) for i, (c, role, text) in enumerate(turns)]
        assert told(spark.createDataFrame(rows, SCHEMA)) == brute(rows)

    check()


def test_chat_is_native(spark):
    frame = spark.read.parquet(f"{SMALL}/conversations.parquet")
    plan = chat.format_examples(frame)._jdf.queryExecution().toString() + chat.read_examples(
        common.stored(chat.format_examples(frame), common.run_folder(spark, "test_chat"), "x")
    )._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)
