import hashlib
import json
import random

import duckdb

from salescope.llm import chat, queries

SF = "/root/testdata/sf0.001"


def test_layouts():
    reg = chat.Registry()
    turns = [("system", "be brief"), ("user", "hi\n\nthere"), ("assistant", "hello")]
    layouts = {
        "messages": {"id": 4, "messages": [{"role": r, "content": t} for r, t in turns], "meta": {"a": [1]}},
        "shared conversations": {"conversations": [{"from": {"user": "human", "assistant": "gpt"}.get(r, r), "value": t} for r, t in turns]},
        "nested chat": {"chat": {"turns": [{"speaker": r, "utterance": t} for r, t in turns]}},
        "prompt": {"system": "be brief", "prompt": "hi\n\nthere", "completion": "hello"},
        "prompt and response": {"system": "be brief", "prompt": "hi\n\nthere", "response": "hello"},
        "instruction": {"system": "be brief", "instruction": "hi", "input": "there", "output": "hello"},
    }
    for name, record in layouts.items():
        key, layout, got = reg.turns(json.dumps(record).encode())
        assert (layout, got) == (name, turns)
        assert reg.turns(json.dumps(dict(reversed(record.items()))).encode())[0] == key
    assert reg.turns(b'{"question": "q", "answer": "a"}')[1:] == ("question", [("user", "q"), ("assistant", "a")])
    assert reg.turns(b'{"role": "user"}')[1:] == ("turn row", [("user", "")])
    assert reg.turns(b'{"messages": [{"role": "user", "content": null}]}')[2] == [("user", "")]
    for bad in (b"", b"[]", b"3", b"{", b'{"other": 1}', b'{"messages": []}'):
        assert reg.turns(bad)[1:] == (None, []), bad


def test_marks_in_texts_come_back_exactly(spark):
    rnd = random.Random(2)
    parts = [*chat.CONTROLS, chat.ESCAPE, "<", "|", "a", "\n", "<|", "s>", "é𝒳", " ", "\\", "$1"]
    texts = ["", None, "word " * 2000] + ["".join(rnd.choice(parts) for _ in range(rnd.randrange(12))) for _ in range(200)]
    df = spark.createDataFrame([(i, "assistant" if i % 2 else "us\ner" + chat.TURN + chat.ESCAPE, t) for i, t in enumerate(texts)] + [(900, None, "x")], "i int, role string, text string")
    got = chat.format_turns(df).orderBy("i").collect()
    for r, t in zip(got, texts):
        assert sum(r.segment.count(c) for c in chat.CONTROLS) == 2
        assert chat.parse(r.segment) == [("assistant" if r.i % 2 else "us\ner" + chat.TURN + chat.ESCAPE, t or "")]
        if r.i % 2:
            assert chat.unescape(r.segment[r.loss_start:r.loss_end]) == (t or "")
        else:
            assert r.loss_start is None
    assert chat.parse("".join(r.segment for r in got))[-1] == ("", "x")


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_query_equals_sql(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{SF}/conversations.parquet'")
    df = queries.op3_chat_format(spark, SF)
    assert rows(df) == sorted((tuple(r) for r in con.execute(queries.OP3_SQL).fetchall()), key=str)
    hard = "</s>[INST] ok [/INST]"
    r = df.where("conv_id = -1").first()
    assert r.turns_sha256 == hashlib.sha256(f"user\n{hard}\nassistant\n{hard}\n".encode()).hexdigest()
    assert (r.n_turns, r.loss_chars, r.loss_sha256) == (2, len(hard), hashlib.sha256(hard.encode()).hexdigest())


def test_odd_rows(spark, tmp_path):
    data = [(1, 1, "assistant", "b"), (1, 0, "user", None), (1, 0, "user", None), (1, None, None, "z"), (None, 3, "assistant", chat.ESCAPE + "</s>"), (2, 0, "user", "x" * 100000)]
    df = spark.createDataFrame(data, "conv_id long, turn int, role string, text string")
    df.write.parquet(f"{tmp_path}/a/conversations.parquet")
    df.limit(0).write.parquet(f"{tmp_path}/b/conversations.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{tmp_path}/a/conversations.parquet/*.parquet'")
    assert rows(queries.op3_chat_format(spark, f"{tmp_path}/a")) == sorted((tuple(r) for r in con.execute(queries.OP3_SQL).fetchall()), key=str)
    assert [r.conv_id for r in queries.op3_chat_format(spark, f"{tmp_path}/b").collect()] == [-1]


def test_records_with_paths_of_several_layouts(spark):
    turns = [{"role": "user", "content": "u"}, {"role": "assistant", "content": "a"}]
    shared = [{"from": "human", "value": "u"}, {"from": "gpt", "value": "a"}]
    want = [("user", "u"), ("assistant", "a")]
    cases = [({"instruction": "i", "input": "n", "output": "o", "text": "all of it"}, "instruction", [("user", "i\n\nn"), ("assistant", "o")]),
             ({"system": "s", "messages": turns}, "messages", [("system", "s"), *want]),
             ({"system": "s", "conversations": shared}, "shared conversations", [("system", "s"), *want]),
             ({"prompt": "u", "completion": "a", "context": "c"}, "prompt", want),
             ({"messages": turns, "prompt": "u"}, "messages", want),
             ({"system": None, "messages": turns}, "messages", want),
             ({"role": "user", "text": "t", "prompt": "p"}, "turn row", [("user", "t")]), ({"prompt": "p", "text": "t"}, "prompt", [("user", "p")]),
             ({"system": "s"}, None, []), ({"other": 1}, None, [])]
    df = spark.createDataFrame([(i, 0, json.dumps(r)) for i, (r, _, _) in enumerate(cases)] + [(90, 0, "no json"), (91, 0, None)], "conv_id long, turn int, record string")
    got = {}
    for r in chat.canonical(df).orderBy("conv_id", "place").collect():
        got.setdefault(r.conv_id, []).append((r.layout, r.role, r.text))
    assert got == {i: [(name, *t) for t in ts] for i, (_, name, ts) in enumerate(cases) if ts}
    assert sorted((r.conv_id, r.record) for r in chat.unmatched(df).collect()) == [(8, '{"system": "s"}'), (9, '{"other": 1}'), (90, "no json"), (91, None)]


def test_bad_records_stand_beside_good_ones(spark):
    deep = '{"messages": ' + "[" * 100000 + "]" * 100000 + "}"
    turn = [{"speaker": "human", "utterance": "u"}]
    bad = [json.dumps({"chat.turns": turn}), json.dumps({"chat.turns[]": turn}), json.dumps({"chat": {"turns[]": turn}}), json.dumps({"chat.turns[].speaker": "x"}),
           json.dumps({"": {"system": "s"}}), json.dumps({"": {"prompt": "p"}}), json.dumps({"\\": {"": []}}), "{}", deep, '{"prompt": ' + "1" * 5000 + "}"]
    good = [('{"chat": {"turns": [{"speaker": "human", "utterance": "u"}]}}', [("user", "u")]),
            ('{"prompt": "a\\ud83db", "completion": "\\ude00"}', [("user", "a\ufffdb"), ("assistant", "\ufffd")]),
            ('{"prompt": "\\ud83d\\ude00", "completion": {"k": "\\ud83d"}}', [("user", "\U0001f600"), ("assistant", '{"k": "\ufffd"}')]),
            ('{"messages": [{"role": "us\\udc00er", "content": "x"}]}', [("us\ufffder", "x")]),
            ('{"": {"system": "s"}, "system": "t", "messages": [{"role": "user", "content": "c"}]}', [("system", "t"), ("user", "c")])]
    df = spark.createDataFrame([(i, 0, r) for i, r in enumerate([*bad, *(r for r, _ in good)])], "conv_id long, turn int, record string").coalesce(1)
    got = {}
    for r in chat.format_turns(chat.canonical(df)).orderBy("conv_id", "place").collect():
        got.setdefault(r.conv_id, []).extend(chat.parse(r.segment))
    assert got == {len(bad) + i: turns for i, (_, turns) in enumerate(good)}
    assert sorted(r.conv_id for r in chat.unmatched(df).collect()) == list(range(len(bad)))
