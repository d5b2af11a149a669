"""Message lists: converters, templates, rewriting and structural tests, as column expressions.

A message list is ``array<struct<role, content>>``. Every function takes and gives columns, so a chain of them stays one
projection.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from curata.functions.native import let
from curata.functions.text import after_last
from curata.runtime import materialize


def message(role: str | Column, content: Column) -> Column:
    return F.struct((F.lit(role) if isinstance(role, str) else role).alias("role"), content.alias("content"))


def exchange(user: Column, assistant: Column, system: Column | None = None) -> Column:
    """A message list of one question and its answer, after a system message if there is one."""
    turns = [message("user", user), message("assistant", assistant)]
    return F.array(*([message("system", system)] if system is not None else []), *turns)


# converters from the columns of known formats

INSTRUCTION = "Below is an instruction that describes a task. Write a response that appropriately completes the request.\n\n"
WITH_INPUT = (
    "Below is an instruction that describes a task, paired with an input that provides further context. "
    "Write a response that appropriately completes the request.\n\n"
)


def from_instruction(instruction: Column, context: Column, output: Column) -> Column:
    """Instruction with an optional input, wrapped in a fixed prompt."""
    blank = F.coalesce(F.trim(context), F.lit("")) == ""
    plain = F.concat(F.lit(INSTRUCTION + "### Instruction:\n"), instruction, F.lit("\n\n### Response:"))
    paired = F.concat(F.lit(WITH_INPUT + "### Instruction:\n"), instruction, F.lit("\n\n### Input:\n"), context, F.lit("\n\n### Response:"))
    return exchange(F.when(blank, plain).otherwise(paired), output)


ROLE_NAMES = {"human": "user", "user": "user", "gpt": "assistant", "chatgpt": "assistant", "assistant": "assistant", "system": "system"}


def from_turns(turns: Column, names: dict[str, str] = ROLE_NAMES) -> Column:
    """``array<struct<from, value>>`` to messages; an unknown speaker raises."""
    known = F.create_map(*[F.lit(x) for kv in names.items() for x in kv])

    def one(t: Column) -> Column:
        role = F.try_element_at(known, t["from"])
        return message(F.coalesce(role, F.raise_error(F.concat(F.lit("unknown speaker "), t["from"])).cast("string")), t["value"])

    return F.transform(turns, one)


#: Converters in the order in which the columns are looked for: needed columns and the expression.
CONVERTERS: list[tuple[tuple[str, ...], Callable[[], Column]]] = [
    (("messages",), lambda: F.col("messages")),
    (("instruction", "input", "output"), lambda: from_instruction(F.col("instruction"), F.col("input"), F.col("output"))),
    (("prompt", "completion"), lambda: exchange(F.col("prompt"), F.col("completion"))),
    (("conversations",), lambda: from_turns(F.col("conversations"))),
    (("query", "answer"), lambda: exchange(F.col("query"), F.col("answer"))),
    (("query", "response"), lambda: exchange(F.col("query"), F.col("response"))),
    (("system_prompt", "question", "response"), lambda: exchange(F.col("question"), F.col("response"), F.col("system_prompt"))),
    (("chosen",), lambda: F.col("chosen")),
]


def to_messages(df: DataFrame) -> DataFrame:
    """Add ``messages`` by whichever converter's columns are all there first."""
    for needed, build in CONVERTERS:
        if set(needed) <= set(df.columns):
            return df.withColumn("messages", build())
    raise ValueError(f"no converter for columns {df.columns}")


def converted(df: DataFrame, convert: Callable[[DataFrame], DataFrame] = to_messages, *, keywords: bool = True, empty: bool = True) -> DataFrame:
    """Convert, then drop rows with filtered keywords and rows with an empty message."""
    from curata.operators.filters import has_empty_message, has_keyword

    out = convert(df)
    if keywords:
        out = out.where(~has_keyword(F.col("messages")))
    return out.where(~has_empty_message(F.col("messages"))) if empty else out


def qa_rows(df: DataFrame, question: str, answer: str, dataset: str) -> DataFrame:
    """Verifiable rows ``messages, ground_truth, dataset`` of questions and answers; lists of answers become JSON."""
    listed = dict(df.dtypes)[answer].startswith("array")
    truth = F.to_json(F.col(answer)) if listed else F.col(answer).cast("string")
    return df.withColumns({"messages": F.array(message("user", F.col(question))), "ground_truth": truth, "dataset": F.lit(dataset)})


def with_endings(trajectory: Column, chosen: Column, rejected: Column) -> tuple[Column, Column]:
    """Whole message lists of a shared trajectory and two last answers."""
    return tuple(F.concat(trajectory, F.array(message("assistant", x))) for x in (chosen, rejected))


def accepted_tests(passed: Column, tests: Column, share: float = 0.8) -> Column:
    """The tests that passed, if at least ``share`` of all did, else null. ``passed`` is ``array<int>`` beside ``tests``."""
    good = F.filter(F.transform(tests, lambda t, i: F.when(F.get(passed, i) == 1, t)), lambda t: t.isNotNull())
    return F.when((F.size(tests) > 0) & (F.size(good) >= share * F.size(tests)), good)


def transcript_messages(text: Column) -> Column:
    r"""Messages of a transcript marked by ``\n\nHuman: `` and ``\n\nAssistant: ``, in turn."""
    parts = F.split(text, "\n\n(?:Human|Assistant): ?")
    turns = F.filter(F.transform(parts, lambda x, i: F.struct(i.alias("i"), F.trim(x).alias("c"))), lambda p: p["i"] > 0)
    role = lambda i: F.when(F.pmod(i, F.lit(2)) == 0, F.lit("user")).otherwise(F.lit("assistant"))
    return F.transform(turns, lambda p, i: message(role(i), p["c"]))


def numbered_quotes(quotes: Column) -> Column:
    """Quotes as ``1. text`` with a blank line between them."""
    return F.array_join(F.transform(quotes, lambda q, i: F.concat((i + 1).cast("string"), F.lit(". "), q)), "\n\n")


def few_shot(instruction: Column, examples: Column, question: Column) -> Column:
    """Instruction, worked examples and the question; ``examples`` is ``array<struct<input, output>>``."""
    shown = F.array_join(
        F.transform(examples, lambda e: F.concat(F.lit("Input: "), e["input"], F.lit("\nOutput: "), e["output"])), "\n\n"
    )
    return F.concat_ws("\n\n", instruction, F.when(F.size(examples) > 0, shown), F.concat(F.lit("Input: "), question, F.lit("\nOutput:")))


def multiple_choice(choices: Column, correct: Column) -> Column:
    """``struct<options, letter>``: choices sorted without regard to case, and the letter of the correct one."""
    order = F.transform(F.array_sort(F.transform(choices, lambda c: F.struct(F.lower(c).alias("k"), c.alias("c")))), lambda s: s["c"])
    return let(order, lambda o: F.struct(
        F.array_join(F.transform(o, lambda c, i: F.concat(F.char(i + 65), F.lit(") "), c)), "\n").alias("options"),
        F.char(F.array_position(o, correct) + 64).alias("letter"),
    ))


def answer_after(text: Column, mark: str) -> Column:
    """Trimmed text after the first ``mark``."""
    return F.trim(F.split_part(text, F.lit(mark), F.lit(2)))


# rendering

def raw_prompt(messages: Column) -> Column:
    """``role: content`` lines."""
    return F.array_join(F.transform(messages, lambda m: F.concat(m["role"], F.lit(": "), m["content"])), "\n")


def _tagged(messages: Column, body: Callable[[Column, Column, Column], Column]) -> Column:
    last = F.size(messages) - 1
    return F.array_join(F.transform(messages, lambda m, i: body(m, i == 0, i == last)), "")


def render(messages: Column, template: str, eos: str = "</s>", generate: bool = False) -> Column:
    """A message list as one string.

    ``space``, ``line`` and ``chat`` put a blank, a line break or an empty line between contents, the last with the
    capitalised role; ``assistant`` keeps answers only; ``tags_eos`` and ``tags`` write ``<|role|>`` lines, with the end
    token after every message or after answers only. ``thinker`` is ``tags`` whose generation prompt opens the thinking,
    ``thinker_answer`` leaves out what stands before the end of the thinking. ``turns`` writes ``<|im_start|>`` lines and
    ends them with ``<|im_end|>``, the last answer with the end token.
    """
    end = lambda last: F.when(last & F.lit(not generate), F.lit(eos)).otherwise(F.lit(""))
    opening = {"thinker": "<|assistant|>\n<think>", "thinker_answer": "<|assistant|>\n<think>", "turns": "<|im_start|>assistant\n"}
    prompt = F.lit(opening.get(template, "<|assistant|>\n") if generate else "")
    if template in ("space", "line", "chat"):
        gap = {"space": " ", "line": "\n", "chat": "\n\n"}[template]
        body = lambda m: F.concat(F.initcap(m["role"]), F.lit(": "), m["content"]) if template == "chat" else m["content"]
        return _tagged(messages, lambda m, first, last: F.concat(F.when(first, F.lit("")).otherwise(F.lit(gap)), body(m), end(last)))
    if template == "assistant":
        return F.array_join(F.transform(F.filter(messages, lambda m: m["role"] == "assistant"), lambda m: m["content"]), "")
    if template == "turns":
        return F.concat(_tagged(messages, lambda m, first, last: _turn(m, last, eos)), prompt)
    known = lambda m: m["role"].isin("system", "user", "assistant")
    head = lambda m, content: F.concat(F.lit("<|"), m["role"], F.lit("|>\n"), content)
    if template == "tags_eos":
        return F.concat(_tagged(messages, lambda m, f, l: F.when(known(m), F.concat(head(m, m["content"]), F.lit(eos + "\n"))).otherwise(F.lit(""))), prompt)
    if template in ("tags", "thinker", "thinker_answer"):
        def body(m: Column, first: Column, last: Column) -> Column:
            tail = F.when(m["role"] != "assistant", F.lit("\n")).when(last, F.lit(eos)).otherwise(F.lit(eos + "\n"))
            said = F.when(m["role"] == "assistant", after_last(m["content"], "</think>")).otherwise(m["content"]) if template == "thinker_answer" else m["content"]
            return F.when(known(m), F.concat(head(m, said), tail)).otherwise(F.lit(""))

        return F.concat(_tagged(messages, body), prompt)
    raise ValueError(f"unknown template {template}")


def _turn(m: Column, last: Column, eos: str) -> Column:
    """One message between turn marks; the end token takes the place of the last mark of an answer."""
    open_, close = (lambda role: F.lit(f"<|im_start|>{role}\n")), F.lit("<|im_end|>\n")
    return (
        F.when(m["role"].isin("system", "user", "environment"), F.concat(F.lit("<|im_start|>"), m["role"], F.lit("\n"), m["content"], close))
        .when(m["role"] == "assistant", F.concat(open_("assistant"), F.coalesce(m["content"], F.lit("")), F.when(last, F.lit(eos)).otherwise(close)))
        .otherwise(F.lit(""))
    )


#: What follows a system message without functions.
NO_FUNCTIONS = " You do not currently have access to any functions. <functions></functions>"


def render_functions(messages: Column, system: str | None = None, eos: str = "</s>", generate: bool = False, opened: str = "", none: str = NO_FUNCTIONS) -> Column:
    """Turns between marks with the functions that they offer and call.

    ``messages`` are structs of ``role, content, functions, function_calls``. A system or user message lists its functions, a
    system message without any says so in ``none``; an answer ends with its calls, and the last message, if it is an answer,
    with the end token instead of the closing mark. ``system`` is put before a list without a system message, as it is.
    ``opened`` follows the generation prompt, such as the start of the thinking. Null contents are empty; other roles than
    system, user, assistant and environment are left out.
    """
    close = "<|im_end|>\n"
    said = lambda m: F.coalesce(m["content"], F.lit(""))
    listed = lambda m: F.concat(F.lit("<functions>"), m["functions"], F.lit("</functions>"))

    def one(m: Column, first: Column, last: Column) -> Column:
        offered = F.when(m["role"] == "system", F.coalesce(F.concat(F.lit(" "), listed(m)), F.lit(none))).otherwise(F.coalesce(F.concat(F.lit("\n"), listed(m)), F.lit("")))
        called = F.coalesce(F.concat(F.lit("<function_calls>"), m["function_calls"], F.lit("</function_calls>")), F.lit(""))
        tail = (
            F.when(m["role"].isin("system", "user"), F.concat(offered, F.lit(close)))
            .when(m["role"] == "assistant", F.concat(called, F.when(last, F.lit(eos)).otherwise(F.lit(close)))).otherwise(F.lit(close))
        )
        turn = F.concat(F.lit("<|im_start|>"), m["role"], F.lit("\n"), said(m), tail)
        return F.when(m["role"].isin("system", "user", "assistant", "environment"), turn).otherwise(F.lit(""))

    lead = F.when(F.exists(messages, lambda m: m["role"] == "system"), F.lit("")).otherwise(F.lit(f"<|im_start|>system\n{system}{close}")) if system else F.lit("")
    prompt = F.when(F.size(messages) > 0, F.lit(f"<|im_start|>assistant\n{opened}")).otherwise(F.lit("")) if generate else F.lit("")
    return F.concat(lead, _tagged(messages, one), prompt)


#: Special tokens and what takes their place.
SPECIAL_TOKENS = {"<think>": "\n", "</think>": "", "<answer>": "\n\n", "</answer>": ""}


def without_special_tokens(text: Column, tokens: dict[str, str] = SPECIAL_TOKENS) -> Column:
    return reduce(lambda t, kv: F.replace(t, F.lit(kv[0]), F.lit(kv[1])), tokens.items(), text)


def messages_text(messages: Column) -> Column:
    """``User: ...`` and ``Assistant: ...`` paragraphs without special tokens; empty messages are left out."""
    spoken = F.filter(messages, lambda m: F.coalesce(m["content"], F.lit("")) != "")

    def one(m: Column) -> Column:
        role = F.lower(m["role"])
        name = F.when(role.isin("user", "human"), "User").when(role.isin("assistant", "ai"), "Assistant").otherwise(F.initcap(role))
        return F.concat(name, F.lit(": "), without_special_tokens(m["content"]))

    return F.array_join(F.transform(spoken, one), "\n\n")


def system_override(messages: Column, prompt: str) -> Column:
    """The list with ``prompt`` as its system message, in place of a leading one if there is one."""
    first = F.array(message("system", F.lit(prompt)))
    rest = F.when(F.get(messages, F.lit(0))["role"] == "system", F.slice(messages, 2, F.greatest(F.size(messages), F.lit(1)))).otherwise(messages)
    return F.concat(first, rest)


def prompt_and_last(messages: Column) -> tuple[Column, Column]:
    """All messages but the last (or the only one), and the last."""
    n = F.size(messages)
    return F.when(n > 1, F.slice(messages, 1, F.greatest(n - 1, F.lit(1)))).otherwise(messages), F.try_element_at(messages, F.lit(-1))


def without_spans(messages: Column, spans: Column) -> Column:
    """The list without the messages in any of ``array<struct<start, stop>>``."""
    return F.filter(messages, lambda m, i: ~F.exists(spans, lambda s: (i >= s["start"]) & (i < s["stop"])))


def add_answer_tags(content: Column) -> Column:
    """Put the part after the thinking into answer tags where they are missing."""
    broken = F.when(F.contains(content, F.lit("</think>\n")), content).otherwise(F.replace(content, F.lit("</think>"), F.lit("</think>\n")))
    opened = F.when(F.contains(broken, F.lit("<answer>")), broken).otherwise(F.replace(broken, F.lit("</think>"), F.lit("</think>\n<answer>")))
    return F.when(F.endswith(opened, F.lit("</answer>")), opened).otherwise(F.concat(opened, F.lit("\n</answer>")))


def remove_answer_tags(content: Column) -> Column:
    return F.replace(F.replace(content, F.lit("<answer>"), F.lit("")), F.lit("</answer>"), F.lit(""))


def thinking_ground_truth(content: Column) -> Column:
    return F.trim(after_last(content, "</think>"))


# structure

def alternates(messages: Column, first: str = "user", second: str = "assistant") -> Column:
    """Whether speakers alternate strictly, the first one first; false for an empty list."""
    role = lambda i: F.when(F.pmod(i, F.lit(2)) == 0, F.lit(first)).otherwise(F.lit(second))
    fits = F.transform(messages, lambda m, i: F.coalesce(m["role"] == role(i), F.lit(False)))
    return (F.size(messages) > 0) & F.forall(fits, lambda x: x)


def chunked(messages: Column, limit: int, tokens: Callable[[Column], Column], overhead: int = 6) -> Column:
    """Chunks of whole question-answer pairs of at most ``limit`` tokens, each turn with some overhead.

    A pair that is too long by itself is left out and ends the chunk before it. A fold over the pairs carries the open
    chunk, its size and the closed ones.
    """
    pairs = F.transform(F.sequence(F.lit(0), F.greatest(F.expr("0"), (F.size(messages) / 2).cast("int") - 1)), lambda i: F.slice(messages, i * 2 + 1, 2))
    pairs = F.when(F.size(messages) >= 2, pairs).otherwise(F.slice(pairs, 1, 0))
    none = F.slice(messages, 1, 0)
    start = F.struct(F.array(none).alias("closed"), none.alias("open"), F.lit(0).alias("size"))
    cost = lambda p: F.aggregate(p, F.lit(0), lambda a, m: a + tokens(m["content"]) + overhead)

    def step(a: Column, p: Column) -> Column:
        def with_cost(c: Column) -> Column:
            shut = F.when(F.size(a["open"]) > 0, F.array_append(a["closed"], a["open"])).otherwise(a["closed"])
            return (
                F.when(c > limit, F.struct(shut.alias("closed"), none.alias("open"), F.lit(0).alias("size")))
                .when(a["size"] + c > limit, F.struct(shut.alias("closed"), p.alias("open"), c.alias("size")))
                .otherwise(F.struct(a["closed"].alias("closed"), F.concat(a["open"], p).alias("open"), (a["size"] + c).alias("size")))
            )

        return let(cost(p), with_cost)

    finish = lambda a: F.filter(F.array_append(a["closed"], a["open"]), lambda x: F.size(x) > 0)
    return F.aggregate(pairs, start, step, finish)


def pairwise(completions: DataFrame, key: str, index: str, value: str) -> DataFrame:
    """Every two completions of a prompt, the lesser index first. Prompts have few completions by their nature."""
    left = completions.select(key, F.col(index).alias("i"), F.col(value).alias("a"))
    right = completions.select(key, F.col(index).alias("j"), F.col(value).alias("b"))
    return left.join(right, key).where("i < j")


def with_reference(completions: DataFrame, references: DataFrame, key: str, index: str, value: str) -> DataFrame:
    """Each group of completions with its reference at position 0."""
    rows = completions.select(key, (F.col(index) + 1).alias("position"), value, F.lit(False).alias("is_reference"))
    first = references.join(completions.select(key).distinct(), key, "left_semi").select(key, F.lit(0).alias("position"), value, F.lit(True).alias("is_reference"))
    return rows.unionByName(first)


def tree_paths(nodes: DataFrame, top: int) -> DataFrame:
    """Paths from roots to leaves of ``id, parent_id, text, quality, deleted``: ``leaf_id, path, texts``.

    Deleted nodes end their branch; of the replies to a message the ``top`` best count. One join for each level until no
    path grows, which tells the leaves too; every level is a written table, so none is computed twice, and the result reads
    these tables without a join: no task holds more than one. Nodes in a cycle hang on no root and are absent.
    """
    rank = F.row_number().over(Window.partitionBy("parent_id").orderBy(F.desc_nulls_last("quality"), "id"))
    live = nodes.where(~F.coalesce("deleted", F.lit(False)))
    kept = live.where("parent_id is null").select("id", "parent_id", "text").unionByName(
        live.where("parent_id is not null").withColumn("r", rank).where(F.col("r") <= top).select("id", "parent_id", "text")
    )
    kept = materialize(kept, "tree-nodes")
    child = kept.where("parent_id is not null").select(F.col("id").alias("child"), F.col("parent_id").alias("id"), F.col("text").alias("next"))
    level = kept.where("parent_id is null").select("id", F.array("id").alias("path"), F.array("text").alias("texts"))
    ends = None
    while True:
        met = materialize(level.join(child, "id", "left"), "tree-level")
        done = met.where("child is null").select(F.col("id").alias("leaf_id"), "path", "texts")
        ends = done if ends is None else ends.unionByName(done)
        level = met.where("child is not null").select(F.col("child").alias("id"), F.array_append("path", F.col("child")).alias("path"), F.array_append("texts", F.col("next")).alias("texts"))
        if level.isEmpty():
            return ends


# tools

def pruned_tools(tools: Column, used: Column) -> Column:
    """Tool definitions that are referenced; ``tools`` is ``array<struct<name, ...>>``."""
    return F.filter(tools, lambda t: F.array_contains(used, t["name"]))


def pruned_to_fit(tools: Column, used: Column, size: Callable[[Column], Column], budget: int) -> Column:
    """Unreferenced definitions are dropped from the end until all fit the budget, or none is left to drop."""
    total = F.aggregate(tools, F.lit(0), lambda a, t: a + size(t))
    start = F.struct(total.alias("left"), F.slice(tools, 1, 0).alias("kept"))

    def step(a: Column, t: Column) -> Column:
        drop = (a["left"] > budget) & ~F.array_contains(used, t["name"])
        return F.when(drop, F.struct((a["left"] - size(t)).alias("left"), a["kept"].alias("kept"))).otherwise(
            F.struct(a["left"].alias("left"), F.array_prepend(a["kept"], t).alias("kept"))
        )

    return F.aggregate(F.reverse(tools), start, step, lambda a: a["kept"])


def referenced_but_undefined(tools: Column, used: Column) -> Column:
    """Names that are used and have no definition."""
    return F.array_except(used, F.transform(tools, lambda t: t["name"]))


def tool_differences(rows: DataFrame, names: DataFrame, key: str, tools: str) -> DataFrame:
    """``tool, side``: tools of rows without a definition (``rows``), and definitions that no row uses (``names``)."""
    used = rows.select(F.explode(tools).alias("tool")).distinct()
    defined = names.select(F.col("name").alias("tool")).distinct()
    return used.join(defined, "tool", "left_anti").withColumn("side", F.lit("rows")).unionByName(defined.join(used, "tool", "left_anti").withColumn("side", F.lit("names")))


def unknown_tools(rows: DataFrame, names: DataFrame, key: str, tools: str) -> DataFrame:
    """``key, tool`` of tools that no definition has."""
    return rows.select(key, F.explode(tools).alias("tool")).join(names.select(F.col("name").alias("tool")), "tool", "left_anti")
