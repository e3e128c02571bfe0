"""Templates and tool dialects."""

import json

import pytest
from pyspark.sql import functions as F

from textloom.operators import templates, tools

TURNS = [("user", "How are you"), ("assistant", "I am fine!"), ("user", "你好"), ("assistant", "<think>\nx\n</think>\n\n很高兴")]


def shown(spark, name, turns=TURNS, **options):
    df = spark.createDataFrame([(turns,)], "m array<struct<role:string,content:string>>")
    got = df.select(templates.pairs(templates.TEMPLATES[name], F.col("m"), **options).alias("p")).first().p
    return [tuple(x) for x in got]


def test_templates(spark):
    assert shown(spark, "llama3")[0] == ("<bos><|start_header_id|>user<|end_header_id|>\n\nHow are you<|eot_id|><|start_header_id|>assistant<|end_header_id|>\n\n", "I am fine!<|eot_id|>")
    assert shown(spark, "llama2", system=F.lit("S"))[0][0] == "<bos>[INST] <<SYS>>\nS\n<</SYS>>\n\nHow are you [/INST]"
    assert shown(spark, "chatglm2")[1][0].startswith("[Round 1]")
    on, off, none = (shown(spark, "qwen3", thinking=x) for x in (True, False, None))
    assert on[0][1].startswith("<think>\n\n</think>\n\nI am") and off[1][1] == "很高兴<|im_end|>\n" and off[1][0].endswith("<think>\n\n</think>\n\n")
    assert none[0][0].endswith("<think>\n\n</think>\n\n") and none[1][1].startswith("<think>\nx")
    assert shown(spark, "chatml", [("user", "{{content}} {{idx}}"), ("assistant", "a")])[0][0].count("{{content}} {{idx}}") == 1
    assert shown(spark, "chatml", []) == []
    with pytest.raises(Exception, match="unexpected role"):
        shown(spark, "chatml", [("wizard", "x"), ("assistant", "y")])
    with pytest.raises(ValueError):
        templates.register(templates.Template("chatml"))
    assert "'<|im_start|>user\\n' + content" in templates.to_jinja(templates.TEMPLATES["chatml"], "<s>", "</s>")


@pytest.mark.parametrize("dialect", tools.DIALECTS)
def test_dialects(dialect):
    call = ("tool_name", json.dumps({"foo": "bar", "size": 10}))
    some = [call] if dialect == "glm4" else [call, call]
    assert tools.read_calls(dialect, tools.render_calls(dialect, some)) == some
    assert tools.read_calls(dialect, "plain words") == "plain words"


def test_default_dialect():
    assert tools.render_calls("default", [("tool_name", '{"foo": "bar", "size": 10}')]) == 'Action: tool_name\nAction Input: {"foo": "bar", "size": 10}'
    with pytest.raises(ValueError):
        tools.render_calls("glm4", [("a", "{}"), ("b", "{}")])
    text = tools.list_tools([{"name": "t", "description": "d", "parameters": {"properties": {"a": {"type": "string", "description": "x", "enum": ["1", "2"]}, "b": {"type": "array", "items": {"type": "number"}}}, "required": ["a"]}}])
    assert "  - a (string, required): x, should be one of [1, 2]\n" in text and "where each item should be number" in text


def test_inference():
    def apply(turns, ask, default="Be kind."):
        if turns[0]["role"] != "system":
            turns = [{"role": "system", "content": default}, *turns]
        out = "".join(f"<|im_start|>{t['role']}\n{t['content']}<|im_end|>\n" for t in turns)
        return "<s>" + out + "<|im_start|>assistant\n" * ask

    got = templates.infer_template("mine", apply, "<s>")
    want = templates.TEMPLATES["chatml"]
    assert (got.user, got.assistant.removeprefix("<|im_start|>assistant\n"), got.system, got.prefix, got.default_system) == (want.user, want.assistant, want.system, "<s>", "Be kind.")


def test_modelfile():
    got = templates.to_modelfile(templates.TEMPLATES["qwen"], "", "<|im_end|>", ("<|im_start|>",))
    assert got.startswith('FROM .\n\nTEMPLATE """{{ if .System }}<|im_start|>system\n{{ .System }}<|im_end|>\n{{ end }}')
    assert 'SYSTEM """You are Qwen' in got and got.count("PARAMETER stop") == 2
