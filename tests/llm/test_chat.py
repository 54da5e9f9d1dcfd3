import json
import random

from pyspark.sql import functions as F

from brindle.llm import chat
from tests.llm.sql import same


def test_query_matches_sql(spark):
    same(spark, "/root/testdata/sf0.01", "op1_chat_format")


def test_texts_come_back(spark):
    rng = random.Random(0)
    pieces = ["\\", "#", "###", "</turn>", "</turn>\n", "<\\/turn>", "### user: ", "\n", "😀", ":", "%3A", "%", "a", ""]
    rows = []
    for i in range(200):
        turns = [{"role": rng.choice(["user", "assistant", "a: b", "x%3A:"]), "content": "".join(rng.choices(pieces, k=rng.randrange(8)))} for _ in range(rng.randrange(5))]
        rows.append((i, json.dumps({"messages": turns, "id": i}) if i % 2 else json.dumps({"messages": turns}, ensure_ascii=False), turns))
    df = spark.createDataFrame([r[:2] for r in rows], "i long, record string")
    out = chat.formatted(chat.canonical(df)).withColumn("back", chat.read_back()).withColumn("loss", chat.loss_text()).collect()
    for r, (i, _, turns) in zip(sorted(out, key=lambda r: r.i), rows):
        if not turns:
            assert r.turns is None or r.turns == []
            continue
        assert [(t.role, t.text) for t in r.back] == [(t["role"], t["content"]) for t in turns]
        assert r.loss == "".join(t["content"] for t in turns if t["role"] == "assistant")
        assert r.formatted.count("</turn>") == len(turns)


LAYOUTS = [
    ({"messages": [{"role": "user", "content": "q"}, {"role": "assistant", "content": "a"}]}, "messages"),
    ({"conversations": [{"from": "human", "value": "q"}, {"from": "gpt", "value": "a"}], "extra": {"x": 1}}, "conversations"),
    ({"dialogue": [{"speaker": "human", "text": "q"}, {"speaker": "bot", "text": "a"}]}, "dialogue"),
    ({"prompt": "q", "completion": "a"}, "prompt_completion"),
    ({"response": "a", "prompt": "q"}, "prompt_response"),
    ({"question": "q", "answer": "a"}, "question_answer"),
    ({"instruction": "q", "output": "a"}, "instruction"),
    ({"instruction": "q", "input": "", "output": "a"}, "instruction_input"),
    ({"system": "", "prompt": "q", "response": "a"}, "system_prompt_response"),
]


def test_layouts_become_the_same_turns(spark):
    df = spark.createDataFrame([(json.dumps(x), name) for x, name in LAYOUTS], "record string, want string")
    for r in chat.canonical(df).collect():
        assert r.layout == r.want and [(t.role, t.text) for t in r.turns] == [("user", "q"), ("assistant", "a")]


def test_unknown_broken_and_null_records_keep_their_row(spark):
    df = spark.createDataFrame([('{"x": 1}', 1), ("{broken", 2), (None, 3), ('{"prompt": null, "completion": "a"}', 4)], "record string, schema int")
    got = {r.record: r for r in chat.formatted(chat.canonical(df)).collect()}
    assert len(got) == 4
    assert all(got[k].layout is None and got[k].formatted is None for k in ('{"x": 1}', "{broken", None))
    assert [t.text for t in got['{"prompt": null, "completion": "a"}'].turns] == ["", "a"]


def test_rows_with_nulls_and_ties(spark):
    rows = spark.createDataFrame([(1, 0, "user", None), (1, 1, None, "b"), (1, 1, "assistant", "a"), (1, 1, "assistant", "a")], "conv_id long, turn long, role string, text string")
    out = chat.canonical(chat.records_of(rows)).select(F.explode("turns").alias("t")).select("t.*").collect()
    assert [tuple(r) for r in out] == [("user", ""), ("", "b"), ("assistant", "a"), ("assistant", "a")]
    assert chat.canonical(chat.records_of(rows.limit(0))).count() == 0


def test_very_long_texts(spark):
    """Over the 20 million characters at which the JSON parser stops by default, in rows and in either kind of record."""
    n = 30_000_000
    rows = spark.range(1).select(F.lit(1).cast("long").alias("conv_id"), F.inline(F.array(
        F.struct(F.lit(0).cast("long").alias("turn"), F.lit("user").alias("role"), F.repeat(F.lit("#"), 3).alias("text")),
        F.struct(F.lit(1).cast("long").alias("turn"), F.lit("assistant").alias("role"), F.repeat(F.lit("a"), n).alias("text")),
    )))
    pair = spark.range(1).select(F.lit(2).cast("long").alias("conv_id"), F.to_json(F.struct(F.lit("q").alias("prompt"), F.repeat(F.lit("b"), n).alias("completion"))).alias("record"))
    out = chat.formatted(chat.canonical(chat.records_of(rows).unionByName(pair))).withColumn("back", chat.read_back())
    got = {r.conv_id: r for r in out.select("conv_id", "layout", F.length("formatted").alias("n"), F.transform("back", lambda t: F.length(t["text"])).alias("sizes"), F.length(chat.loss_text()).alias("loss")).collect()}
    assert (got[1].layout, got[1].sizes, got[1].loss) == ("messages", [3, n], n) and got[1].n > n
    assert (got[2].layout, got[2].sizes, got[2].loss) == ("prompt_completion", [1, n], n)


def test_extra_columns(spark):
    df = spark.createDataFrame([('{"prompt": "q", "completion": "a"}', 1, "x")], "record string, formatted int, turns string")
    r = chat.formatted(chat.canonical(df)).first()
    assert r.formatted == "### user: q</turn>\n### assistant: a</turn>\n" and [t.text for t in r.turns] == ["q", "a"]
