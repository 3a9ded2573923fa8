import hashlib
import json
from collections import defaultdict

from gristmill.llm import chat as C
from gristmill.llm import queries


def esc(t):
    t = t.replace("\\", "\\\\")
    for c in C.CONTROL:
        t = t.replace(c, c[0] + "\\" + c[1:])
    return t


def brute(turns):
    """turns: (conv_id, role, text) in order."""
    by = defaultdict(list)
    for c, r, t in turns:
        by[c].append((r, t or ""))
    out = []
    for c, rows in by.items():
        loss = "".join(t for r, t in rows if r == "assistant")
        size = sum(len(C.OPEN + esc(r) + C.MIDDLE + esc(t) + C.CLOSE) for r, t in rows)
        out.append((c, len(rows), hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in rows).encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest(), size))
    return sorted(out, key=str)


def test_query_agrees_with_brute_force(spark):
    sf = "/root/testdata/sf0.001"
    rows = spark.read.parquet(f"{sf}/conversations.parquet").orderBy("conv_id", "turn").collect()
    odd = "</s>[INST] ok [/INST]"
    turns = [(r.conv_id, r.role, r.text) for r in rows] + [(-1, "user", odd), (-1, "assistant", odd)]
    assert sorted(map(tuple, queries.op8_chat(spark, sf).collect()), key=str) == brute(turns)


def test_escapes_come_back(spark):
    texts = ["", "\\", "\\\\<|", "<|turn|>", "<<SYS>>[INST]</s><s>", "a\\|>\nb", "<|><||>|>", "$1 \\$ é\U0001f600", "\\\n", "<|text|>x<|end|>\n"]
    df = spark.createDataFrame([(1, k, 0, "l", "ro<|text|>le" if k % 2 else "assistant", t) for k, t in enumerate(texts)], "conv_id long, turn long, seq int, layout string, role string, text string")
    segments = C.format_turns(df)
    marks = [C.OPEN, C.MIDDLE, C.CLOSE]
    for s in segments.collect():
        body = s.formatted.removeprefix(C.OPEN).removesuffix(C.CLOSE).replace(C.MIDDLE, "", 1)
        assert not any(c in body for c in (*C.CONTROL, *marks))
    back = {r.turn: r for r in C.read_formatted(segments).collect()}
    assert [back[k].text for k in range(len(texts))] == texts
    assert {back[k].role for k in range(1, len(texts), 2)} == {"ro<|text|>le"}
    assert [back[k].loss_text or "" for k in range(0, len(texts), 2)] == texts[::2]


def test_layouts_become_the_same_turns(spark):
    records = [
        {"prompt": "q", "completion": "a"},
        {"prompt": "q", "response": "a", "id": 7, "meta": {"source": ["x"]}},
        {"instruction": "q", "output": "a"},
        {"instruction": "q", "input": "", "output": "a"},
        {"system": None, "prompt": "q", "completion": "a"},
        {"question": "q", "answer": "a"},
        {"messages": [{"role": "user", "content": "q"}, {"content": "a", "role": "assistant"}]},
        {"conversations": [{"from": "human", "value": "q"}, {"from": "gpt", "value": "a"}]},
    ]
    other = [{"messages": []}, {"prompt": "only"}, 5, {"instruction": "q", "input": "i", "output": None}]
    rows = [(k, 0, json.dumps(r), "clash") for k, r in enumerate(records + other)] + [(90, 0, "{broken", ""), (91, 0, None, "")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, record string, layout string")
    found = defaultdict(list)
    for r in sorted(C.canonical_turns(df).collect(), key=lambda r: (r.conv_id, r.seq or 0)):
        found[r.conv_id].append((r.role, r.text))
    n = len(records)
    assert all(found[k] == [("user", "q"), ("assistant", "a")] for k in range(n))
    assert n not in found and found[n + 1] == found[n + 2] == found[90] == found[91] == [(None, None)]
    assert found[n + 3] == [("user", "q\n\ni"), ("assistant", "")]


def test_nulls_repeats_and_empty_table(spark):
    schema = "conv_id long, turn long, role string, text string, formatted int"
    rows = [(1, 0, "user", None, 0), (1, 1, "assistant", "x" * 200_000, 0), (2, 0, "assistant", "a", 0), (2, 0, "assistant", "a", 0), (None, 3, None, "t", 0)]
    df = spark.createDataFrame(rows, schema)
    found = C.conversation_digests(C.read_formatted(C.format_turns(C.canonical_turns(C.turn_records(df))))).collect()
    assert sorted(map(tuple, found), key=str) == brute([(c, r or "", t) for c, _, r, t, _ in rows])
    empty = C.turn_records(spark.createDataFrame([], schema))
    assert C.conversation_digests(C.read_formatted(C.format_turns(C.canonical_turns(empty)))).collect() == []


def test_content_in_parts():
    parts = [{"type": "text", "text": "a"}, {"type": "image", "url": "x"}, {"type": "text", "text": "b"}]
    record = {"messages": [{"role": "user", "content": parts}, {"role": "gpt", "content": [{"text": None}]}]}
    assert C.Layouts().turns(record) == ("messages_parts", [("user", "a\n\nb"), ("assistant", "")])
