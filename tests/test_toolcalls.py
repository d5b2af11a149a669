"""Tool calls and renderings of conversations against plain Python."""

import json
import re

from pyspark.sql import functions as F

from curata.operators import toolcalls

SEARCH = {"function": {"name": "search", "parameters": {"required": ["query"], "properties": {"top": {}, "query": {}}}}}
RUN = {"function": {"name": "run", "parameters": {"properties": {"code": {}}}}}
PING = {"function": {"name": "a.b"}}
TEXTS = [
    "<search>one</search> then <run>x\n= 1</run> and <search>two</search>", "<run><search>in</search></run>", "<search>a<search>b</search>c</search>", "<search>open", "</search><search></search>",
    "<a.b>dots</a.b><aXb>no</aXb>", "no calls", "", None, "<search>same</search><search>same</search> <search>same", "<run>ä \"quoted\" \\ </run>" * 3,
]


def plain_tagged(text):
    found = [(m.start() + 1, n, {p: m[1]}) for n, p in (("search", "query"), ("run", "code"), ("a.b", "text")) for m in re.finditer(rf"<{re.escape(n)}>(.*?)</{re.escape(n)}>", text or "", re.DOTALL)]
    return sorted(found, key=lambda x: x[0])


def test_tagged_calls(spark):
    df = spark.createDataFrame(list(enumerate(TEXTS)), "i long, t string")
    got = toolcalls.call_rows(df, "i", toolcalls.tagged_calls(F.col("t"), [SEARCH, RUN, PING])).collect()
    want = [(i, k, place, name, args) for i, t in enumerate(TEXTS) for k, (place, name, args) in enumerate(plain_tagged(t))]
    assert sorted((r.i, r.number, r.place, r.name, json.loads(r.arguments)) for r in got if r.error is None) == want
    assert len(got) == len(want) > 10


def test_json_calls(spark):
    good = '{"name": "search", "arguments": {"query": "a \\"b\\" <x>", "top": 2}}'
    cases = [
        (good, "search", None), (json.dumps({"name": "search", "arguments": '{"query": "in a string"}'}), "search", None), ('{"name": "run"}', "run", None), ("[1]", None, "no JSON object"),
        ("{broken", None, "no JSON object"), ("", None, "no JSON object"), ('{"arguments": {}}', None, "no name"), ('{"name": "fly"}', "fly", "unknown tool"),
        ('{"name": "search", "arguments": 3}', "search", "arguments are no object"), ('{"name": "search", "arguments": {"top": 1}}', "search", "no argument query"),
    ]
    text = "so " + " and ".join(f"<tool_call>\n{c}\n</tool_call>" for c, _, _ in cases) + "<tool_call>{"
    df = spark.createDataFrame([(1, text), (2, None), (3, "none")], "i long, t string")
    got = toolcalls.call_rows(df, "i", toolcalls.json_calls(F.col("t"), [SEARCH, RUN])).orderBy("number").collect()
    assert [(r.name, r.error) for r in got] == [c[1:] for c in cases]
    assert [r.place for r in got] == [m.start() + 1 for m in re.finditer("<tool_call>\n", text)]
    assert json.loads(got[0].arguments) == {"query": 'a "b" <x>', "top": 2} and json.loads(got[1].arguments) == {"query": "in a string"}


def test_tool_outputs(spark):
    row = spark.range(1).select(toolcalls.tool_outputs(F.array(F.lit("a"), F.lit("b"))).alias("t")).first()
    assert row.t == "<output>\na\n</output>\n\n<output>\nb\n</output>\n"


def test_rendered_spans(spark):
    """Spans are what assistants wrote, in characters and in tokens, however the text is cut."""
    messages = [("system", "Be brief.", None), ("user", "Add 1 and 2", None), ("assistant", "I will.", ['{"name": "run"}', "{}"]), ("tool", "3", None), ("assistant", None, None), ("assistant", "It is 3", [])]
    df = spark.createDataFrame([(messages,), ([],)], "m array<struct<role:string,content:string,calls:array<string>>>")
    words = lambda t: F.regexp_extract_all(t, F.lit(r"\S+"), 0)
    end = " <|im_end|>\n"
    for tools in (None, [SEARCH]):
        made = df.select(toolcalls.rendered(F.col("m"), tools, end).alias("r"))
        text, spans = made.collect()[0].r
        assert ("<tools>" in text) == bool(tools)
        assert [text[a:b] for a, b in spans] == ['I will.\n<tool_call>\n{"name": "run"}\n</tool_call>\n<tool_call>\n{}\n</tool_call> <|im_end|>\n', end, f"It is 3{end}"]
        assert made.collect()[1].r.spans == []
        for most in (1, 12, 20, 1000):
            got = made.select(toolcalls.token_spans(F.col("r.text"), F.col("r.spans"), words, most).alias("s")).first().s
            want = [(len(text[:a].split()), min(most, len(text[:b].split()))) for a, b in spans]
            assert [tuple(s) for s in got] == [w for w in want if w[0] < most]
            assert all(text.split()[a - 1] == "<|im_start|>assistant" for a, _ in got)


def test_rendered_functions(spark):
    """Functions of system and user messages, calls of answers, a default system message and unknown roles."""
    from curata.operators import messages

    schema = "m array<struct<role:string,content:string,functions:string,function_calls:string>>"
    lists = [
        [("user", "hi", None, None), ("assistant", "yes", None, None)],
        [("system", "Be kind.", None, None), ("user", "add", "[add]", None), ("assistant", None, None, "add(1, 2)"), ("environment", "3", None, None), ("critic", "no", None, None), ("assistant", "3", None, None)],
        [("system", "Be kind.", "[f]", None)], [],
    ]
    df = spark.createDataFrame([(m,) for m in lists], schema)
    got = [r.t for r in df.select(messages.render_functions(F.col("m"), "S", "</s>").alias("t")).collect()]
    start = lambda role: f"<|im_start|>{role}\n"
    close = "<|im_end|>\n"
    assert got[0] == f"{start('system')}S{close}{start('user')}hi{close}{start('assistant')}yes</s>"
    assert got[1] == (
        f"{start('system')}Be kind.{messages.NO_FUNCTIONS}{close}{start('user')}add\n<functions>[add]</functions>{close}"
        f"{start('assistant')}<function_calls>add(1, 2)</function_calls>{close}{start('environment')}3{close}{start('assistant')}3</s>"
    )
    assert got[2] == f"{start('system')}Be kind. <functions>[f]</functions>{close}" and got[3] == f"{start('system')}S{close}"
    asked = df.select(messages.render_functions(F.col("m"), generate=True, opened="<think>").alias("t")).collect()
    assert asked[2].t.endswith(f"{close}{start('assistant')}<think>") and asked[3].t == ""


def test_json_calls_are_whole(spark):
    text = '<tool_call>{"name": "run"} and more</tool_call> <tool_call>{"name": "run", "arguments": "{} {}"}</tool_call>'
    got = toolcalls.call_rows(spark.createDataFrame([(1, text)], "i long, t string"), "i", toolcalls.json_calls(F.col("t"), [RUN])).orderBy("number").collect()
    assert [r.error for r in got] == ["no JSON object", "arguments are no object"]
