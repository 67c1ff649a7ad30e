import hashlib
import json
import random

import pytest

from factloom.llm import chat


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def test_round_trip(spark):
    rng = random.Random(3)
    parts = ["~", "~0", "~1", "<|", "<", "|", "<|im_end|>", "<|im_start|>assistant\n", "\n", "é", "😀", "text", "~<|~"]
    rows = [(c, t, rng.choice(["user", "assistant", "system", "od\nd<|", None]), None if rng.random() < 0.1 else "".join(rng.choice(parts) for _ in range(rng.randrange(12))), "x", 1)
            for c in range(25) for t in range(rng.randrange(1, 6))]
    rows += [rows[0], (None, 0, "user", "nobody", "x", 1), (99, None, "assistant", "null turn", "x", 1), (98, 0, "user", "long " * 100_000, "x", 1)]
    table = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string, prompt string, segments int").repartition(3)
    got = {r.conv_id: r for r in chat.digests(chat.format_table(table)).collect()}
    assert set(got) == {r[0] for r in rows}
    for conv, r in got.items():
        said = [(role or "", text or "") for _, _, role, text in sorted(
            ((t is not None, t or 0, role or "", text or "") for c, t, role, text, *_ in rows if c == conv))]
        assert r.n_turns == len(said)
        assert r.turns_sha256 == sha("".join(f"{role}\n{text}\n" for role, text in said))
        lost = "".join(text for role, text in said if role == "assistant")
        assert (r.loss_chars, r.loss_sha256) == (len(lost), sha(lost))
    assert chat.digests(chat.format_table(table.limit(0))).collect() == []


RECORDS = [
    ({"messages": [{"role": "user", "content": "q"}, {"content": "a", "role": "assistant", "id": 5}], "meta": 1}, "messages", [("user", "q"), ("assistant", "a")]),
    ({"conversations": [{"from": "human", "value": "q"}, {"from": "gpt", "value": "a"}]}, "conversations", [("user", "q"), ("assistant", "a")]),
    ({"instruction": "do", "output": "done"}, "instruction", [("user", "do"), ("assistant", "done")]),
    ({"output": "done", "input": "it", "instruction": "do"}, "instruction_input", [("user", "do\n\nit"), ("assistant", "done")]),
    ({"instruction": "do", "input": "", "output": "done"}, "instruction_input", [("user", "do"), ("assistant", "done")]),
    ({"system": "s", "prompt": "p", "response": "r"}, "system_prompt_response", [("system", "s"), ("user", "p"), ("assistant", "r")]),
    ({"prompt": "p", "completion": "c", "system": "s"}, "prompt_completion", [("user", "p"), ("assistant", "c")]),
    ({"question": "q", "answer": "a"}, "question_answer", [("user", "q"), ("assistant", "a")]),
    ({"conv_id": 1, "turn": 3, "role": "user", "text": "t"}, "rows", [("user", "t")]),
    ({"other": 1}, None, [(None, None)]),
]


def test_json_records(spark):
    rows = [(i, json.dumps(r)) for i, (r, _, _) in enumerate(RECORDS)] + [(90, "no json"), (91, None), (92, "[1]")]
    got = {}
    for r in chat.record_turns(spark.createDataFrame(rows, "conv_id bigint, record string")).orderBy("conv_id", "turn").collect():
        got.setdefault(r.conv_id, (r.layout, []))[1].append((r.role, r.text))
    for i, (_, layout, turns) in enumerate(RECORDS):
        assert got[i] == (layout, turns)
    assert got[90] == got[91] == got[92] == (None, [(None, None)])


def test_typed_tables(spark):
    table = spark.createDataFrame([(1, [("user", "q"), ("assistant", "a")])], "conv_id bigint, messages array<struct<role:string,content:string>>")
    assert [tuple(r) for r in chat.table_turns(table).orderBy("turn").collect()] == [(1, 0, "user", "q"), (1, 1, "assistant", "a")]
    pairs = spark.createDataFrame([(1, "p", "r", "x")], "conv_id bigint, prompt string, response string, extra string")
    assert [tuple(r) for r in chat.table_turns(pairs).orderBy("turn").collect()] == [(1, 0, "user", "p"), (1, 1, "assistant", "r")]
    with pytest.raises(ValueError, match="no layout"):
        chat.table_turns(spark.createDataFrame([(1, "x")], "a int, b string"))
