import json

from hypothesis import given, settings
from hypothesis import strategies as st

from sedimenta.llm import chat

TEXT = st.lists(st.sampled_from([*"ab\\ \n/<[s]é", "[INST]", "[/INST]", "</s>", "[TEXT]", "[/ROLE]", "[ROLE]"]), max_size=12).map("".join)


@settings(max_examples=400, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["user", "assistant", "system", "", "[TEXT]"]), TEXT), max_size=6))
def test_round_trip(turns):
    text = chat.render(turns)
    again, loss = chat.read_back(text)
    assert again == turns
    assert [chat.unescape(text[a:b]) for a, b in loss] == [t for r, t in turns if r == "assistant"]


def test_layouts(spark):
    records = [
        {"messages": [{"role": "user", "content": "q"}, {"role": "assistant", "content": "a"}]},
        {"conversations": [{"from": "human", "value": "q"}, {"from": "gpt", "value": "a"}], "id": 3},
        {"prompt": "q", "completion": "a"},
        {"instruction": "q", "output": "a"},
        {"question": "q", "answer": "a", "meta": {"k": [1]}},
        {"turns": [{"role": "user", "text": "q"}, {"role": "assistant", "text": "a"}]},
    ]
    rows = [(i, json.dumps(r), "x") for i, r in enumerate(records)] + [(90, None, "x"), (91, "no json", "x"), (92, "[]", "x"), (93, '{"a": 1}', "x"), (94, '{"messages": []}', "x"), (95, '{"prompt": null, "response": "a"}', "x")]
    out = {r.id: r for r in chat.format_records(spark.createDataFrame(rows, "id int, record string, formatted string")).collect()}
    for i in range(len(records)):
        assert [tuple(t) for t in out[i].turns] == [("user", "q"), ("assistant", "a")], records[i]
        assert out[i].loss_text == "a"
    assert [out[i].formatted for i in (90, 91, 92, 93, 94)] == [None] * 4 + [""]
    assert [tuple(t) for t in out[95].turns] == [("user", ""), ("assistant", "a")]


def test_odd_records(spark):
    deep = '{"messages": [{"role": "user", "content": ' + "[" * 100_000 + "]" * 100_000 + "}]}"
    rows = {
        1: '{"messages": [{"role": {"a": 1}, "content": "x"}]}',
        2: '{"turns": [{"role": 7, "text": [1, "é"]}, 5, null, {"role": null, "text": null}]}',
        3: deep,
        4: r'{"prompt": "a\ud800b", "response": "\ud83d\ude00 \udc00"}',
        5: '{"messages": "abc"}',
        6: '{"messages": null}',
        7: '{"conversations": [{"from": "human", "value": "q"}, {"from": "narrator", "value": "n"}], "\\ud800": 1}',
        8: '{"turns": [{"role": "human", "text": "q"}]}',
    }
    out = {r.id: r for r in chat.format_records(spark.createDataFrame(list(rows.items()), "id int, record string")).collect()}
    turns = {i: None if r.turns is None else [tuple(t) for t in r.turns] for i, r in out.items()}
    assert turns == {
        1: [('{"a": 1}', "x")],
        2: [("7", '[1, "é"]'), ("", "")],
        3: None,
        4: [("user", "a\ufffdb"), ("assistant", "\U0001f600 \ufffd")],
        5: None,
        6: [],
        7: [("user", "q"), ("narrator", "n")],
        8: [("human", "q")],
    }
    assert out[6].formatted == "" and out[5].layout is None


def test_query_runs_over_many_layouts(spark):
    rows = spark.read.parquet("/root/testdata/sf0.001/conversations.parquet")
    found = {r.layout for r in chat.format_records(chat.conversation_records(rows)).select("layout").distinct().collect()}
    assert len(found) >= 4 and None not in found


def test_conversations(spark):
    rows = [(1, 1, "assistant", "b"), (1, 0, "user", None), (1, 1, "assistant", "b"), (2, None, None, "x"), (None, 0, "user", "n"), (3, 0, "assistant", "a" * 100_000)]
    df = spark.createDataFrame([(*r, 0) for r in rows], "conv_id long, turn long, role string, text string, record int")
    out = {r.conv_id: [tuple(t) for t in r.turns] for r in chat.format_records(chat.conversation_records(df)).collect()}
    assert out == {1: [("user", ""), ("assistant", "b"), ("assistant", "b")], 2: [("", "x")], None: [("user", "n")], 3: [("assistant", "a" * 100_000)]}
    assert chat.format_records(chat.conversation_records(df.limit(0))).count() == 0


def test_layouts_are_bounded_and_confirmed(monkeypatch):
    table = chat.LayoutTable(chat.LAYOUTS, most=3)
    for i in range(50):
        assert table.turns({f"odd{i}": 1}) is None and len(table.known) <= 3
        assert table.turns({"prompt": "a", "completion": "b"}) == [("user", "a"), ("assistant", "b")]
    monkeypatch.setattr(chat, "fingerprint", lambda found: 1)
    assert table.turns({"question": "a", "answer": "b"}) == [("user", "a"), ("assistant", "b")] and table.turns({"x": 1}) is None
    assert table.turns({"question": "a", "answer": "b"}) is not None and len(table.known) <= 3
