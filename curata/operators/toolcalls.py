"""Tool calls in answers: calls between tags, JSON calls, checks of both against tool definitions, and rendering of
conversations with calls together with the spans of their answers.

Everything is an expression over one row; a call that cannot be used is a row with its error, never a failure.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from curata.functions.constraints import whole_json
from curata.functions.native import let

_CALL = "struct<place:int,name:string,arguments:string,error:string>"


def parameter_of(definition: dict) -> str:
    """The parameter that the content of a tagged call goes to: the first required one, else the first, else ``text``."""
    parameters = definition["function"].get("parameters", {})
    return next(iter([*parameters.get("required", []), *parameters.get("properties", {}), "text"]))


def _call(place: Column, name: Column, arguments: Column, error: Column) -> Column:
    return F.struct(place.cast("int").alias("place"), name.alias("name"), arguments.alias("arguments"), error.alias("error"))


def _between(text: Column, opening: str, closing: str) -> Column:
    """``place, content`` of what stands between two marks, left to right, each up to the next closing mark; places from 1."""
    found = F.regexp_extract_all(text, F.lit(f"(?s){re.escape(opening)}(.*?){re.escape(closing)}"), 1)
    start = F.struct(F.lit(1).alias("next"), F.array().cast("array<struct<place:int,content:string>>").alias("out"))

    def step(a: Column, content: Column) -> Column:
        # the match is the first place from which opening, content and closing mark stand in a row
        at = F.call_function("locate", F.concat(F.lit(opening), content, F.lit(closing)), text, a["next"])
        after = at + F.length(content) + len(opening) + len(closing)
        return F.struct(after.alias("next"), F.concat(a["out"], F.array(F.struct(at.alias("place"), content.alias("content")))).alias("out"))

    return F.aggregate(found, start, step, lambda a: a["out"])


def tagged_calls(text: Column, tools: list[dict]) -> Column:
    """Calls ``<name>content</name>`` of any of the defined tools, by place: an array of ``place, name, arguments, error``.

    The content is the only argument. Tags of unknown names and tags that are not closed are no calls.
    """

    def of(tool: dict) -> Column:
        name, parameter = tool["function"]["name"], parameter_of(tool)
        argument = lambda x: F.to_json(F.create_map(F.lit(parameter), x["content"]))
        none = F.lit(None).cast("string")
        return F.transform(_between(text, f"<{name}>", f"</{name}>"), lambda x: _call(x["place"], F.lit(name), argument(x), none))

    each = [of(t) for t in tools]
    return F.array_sort(F.concat(F.array().cast(f"array<{_CALL}>"), *each))


def json_calls(text: Column, tools: list[dict], opening: str = "<tool_call>", closing: str = "</tool_call>") -> Column:
    """Calls ``{"name": ..., "arguments": {...}}`` between marks, by place: an array of ``place, name, arguments, error``.

    ``error`` says that a call is no JSON object, has no name, that no tool has the name, that the arguments are no object,
    or which required argument is missing first; else it is null. Arguments that are a string with JSON in it are opened.
    """

    def checked(x: Column) -> Column:
        content = F.regexp_replace(x["content"], r"^\s+|\s+$", "")
        whole = F.coalesce(whole_json(content), F.lit(False)) & F.startswith(content, F.lit("{"))
        name, given = F.get_json_object(content, "$.name"), F.coalesce(F.get_json_object(content, "$.arguments"), F.lit("{}"))
        object_ = F.coalesce(whole_json(given), F.lit(False)) & F.startswith(F.trim(given), F.lit("{"))
        missing = F.lit(None).cast("string")
        for t in tools:
            required = t["function"].get("parameters", {}).get("required", [])
            lacks = F.coalesce(*[F.when(F.get_json_object(given, f"$.{p}").isNull(), F.lit(f"no argument {p}")) for p in required], F.lit(None).cast("string"))
            missing = F.when(name == t["function"]["name"], lacks).otherwise(missing)
        error = (
            F.when(~whole, "no JSON object").when(name.isNull(), "no name").when(~name.isin([t["function"]["name"] for t in tools]), "unknown tool")
            .when(~object_, "arguments are no object").otherwise(missing)
        )
        return _call(x["place"], F.when(whole, name), F.when(whole, given), error)

    return F.transform(_between(text, opening, closing), checked)


def call_rows(rows: DataFrame, key: str, calls: Column) -> DataFrame:
    """``key, number, place, name, arguments, error``: a row for each call, numbered from 0 by place; rows without calls have none."""
    numbered = rows.select(key, F.posexplode(calls).alias("number", "call"))
    return numbered.select(key, "number", "call.place", "call.name", "call.arguments", "call.error")


def tool_outputs(outputs: Column, name: str = "output") -> Column:
    """The results of calls as they go back to the model, each between tags and lines of its own."""
    return F.array_join(F.transform(outputs, lambda o: F.concat(F.lit(f"<{name}>\n"), o, F.lit(f"\n</{name}>\n"))), "\n")


def rendered(messages: Column, tools: list[dict] | None = None, end: str = "<|im_end|>\n") -> Column:
    """``text`` and ``spans`` of a conversation with calls: ``messages`` are structs of ``role, content, calls``.

    Every message is a header line with its role, its content, its calls between marks, and the end mark. Tools are listed
    in JSON in a system message before all others. ``spans`` are ``start, finish`` in characters from 0 of what an assistant
    wrote, its calls and the end mark included and its header not.
    """
    import json

    listed = "".join(json.dumps(t, sort_keys=True) + "\n" for t in tools or [])
    intro = f"<|im_start|>system\n<tools>\n{listed}</tools>{end}" if tools else ""
    call = lambda c: F.concat(F.lit("\n<tool_call>\n"), c, F.lit("\n</tool_call>"))
    calls = lambda m: F.array_join(F.transform(F.coalesce(m["calls"], F.array().cast("array<string>")), call), "")
    pieces = F.transform(
        messages,
        lambda m: F.struct(
            F.concat(F.lit("<|im_start|>"), m["role"], F.lit("\n")).alias("head"), F.concat(F.coalesce(m["content"], F.lit("")), calls(m), F.lit(end)).alias("body"), (m["role"] == "assistant").alias("own")
        ),
    )
    start = F.struct(F.lit(len(intro)).alias("at"), F.array().cast("array<struct<start:int,finish:int>>").alias("spans"))

    def step(a: Column, p: Column) -> Column:
        begin = a["at"] + F.length(p["head"])
        finish = begin + F.length(p["body"])
        span = F.array(F.struct(begin.alias("start"), finish.alias("finish")))
        return F.struct(finish.alias("at"), F.when(p["own"], F.concat(a["spans"], span)).otherwise(a["spans"]).alias("spans"))

    def both(ps: Column) -> Column:
        text = F.concat(F.lit(intro), F.array_join(F.transform(ps, lambda p: F.concat(p["head"], p["body"])), ""))
        return F.struct(text.alias("text"), F.aggregate(ps, start, step, lambda a: a["spans"]).alias("spans"))

    return let(pieces, both)


def token_spans(text: Column, spans: Column, tokens: Callable[[Column], Column], most: int) -> Column:
    """``start, finish`` of spans in tokens, clipped at ``most`` tokens; spans that lie beyond are left out.

    ``tokens`` gives the array of a text's tokens. A token belongs to the side on which it begins, so spans must begin and
    end between tokens, as those of :func:`rendered` do, whose headers and end marks end a token.
    """
    before = lambda at: F.size(tokens(F.substring(text, F.lit(1), at)))
    places = F.transform(spans, lambda s: F.struct(before(s["start"]).alias("start"), F.least(before(s["finish"]), F.lit(most)).alias("finish")))
    return F.filter(places, lambda s: s["start"] < most)
