"""Verifiable rewards: scores of answers against labels, as column expressions."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from curata.functions.native import let
from curata.functions.text import after_last, before_first, normalize_answer


def score(condition: Column) -> Column:
    return F.coalesce(condition, F.lit(False)).cast("double")


def without_thinking(text: Column) -> Column:
    """What follows the last end of thinking, without answer tags."""
    text = F.trim(F.replace(text, F.lit("<|assistant|>"), F.lit("")))
    text = after_last(text, "</think>")
    return F.trim(F.replace(F.replace(text, F.lit("<answer>"), F.lit("")), F.lit("</answer>"), F.lit("")))


def last_number(text: Column) -> Column:
    """The last number after one pass of comma removal between digits; the whole text without one."""
    flat = F.regexp_replace(text, r"([0-9]),([0-9])", "$1$2")
    return F.coalesce(F.try_element_at(F.regexp_extract_all(flat, F.lit(r"[-+]?[0-9]*\.[0-9]+|[0-9]+"), 0), F.lit(-1)), flat)


def grade_school(prediction: Column, label: Column) -> Column:
    return score(F.lower(last_number(prediction)) == F.lower(label))


def flan(prediction: Column, label: Column) -> Column:
    return score(normalize_answer(F.trim(after_last(prediction, "The answer is: "))) == normalize_answer(label))


def in_answer_tags(prediction: Column, label: Column) -> Column:
    tagged = F.contains(prediction, F.lit("<answer>")) & F.contains(prediction, F.lit("</answer>"))
    answer = before_first(after_last(prediction, "<answer>"), "</answer>")
    return score(tagged & (normalize_answer(answer) == normalize_answer(label)))


def puzzle(prediction: Column, label: Column) -> Column:
    return score(normalize_answer(without_thinking(prediction)) == normalize_answer(label))


def token_f1(prediction: Column, label: Column) -> Column:
    """``struct<f1, precision, recall>`` of the multisets of normalised tokens."""
    tokens = lambda c: F.filter(F.split(normalize_answer(c), " "), lambda w: w != "")

    def of(p: Column) -> Column:
        def with_label(g: Column) -> Column:
            # Words have no blanks: sorted with their sides, a word's run on one side is followed by that on the other.
            tagged = lambda a, side: F.transform(a, lambda w: F.concat(w, F.lit(f" {side}")))

            def shared(both: Column) -> Column:
                starts = F.transform(both, lambda x, i: F.when(F.get(both, i - 1) == x, None).otherwise(i))
                return let(F.filter(starts, lambda i: i.isNotNull()), lambda runs: summed(both, runs))

            def summed(both: Column, runs: Column) -> Column:
                def of_run(at: Column, k: Column) -> Column:
                    x, other, end = F.get(both, at), F.get(runs, k + 1), F.coalesce(F.get(runs, k + 2), F.size(both))
                    met = F.get(both, other) == F.concat(F.substring(x, F.lit(1), F.length(x) - 1), F.lit("1"))
                    return F.when(met, F.least(other - at, end - other)).otherwise(0)

                return F.aggregate(F.transform(runs, of_run), F.lit(0), lambda n, x: n + x)

            same = let(F.sort_array(F.concat(tagged(p, 0), tagged(g, 1))), shared)

            def rates(s: Column) -> Column:
                precision, recall = s / F.size(p), s / F.size(g)
                f1 = F.when(s > 0, 2 * precision * recall / (precision + recall)).otherwise(0.0)
                zero = lambda c: F.when(s > 0, c).otherwise(0.0)
                return F.struct(f1.alias("f1"), zero(precision).alias("precision"), zero(recall).alias("recall"))

            return let(same, rates)

        return let(tokens(label), with_label)

    return let(tokens(prediction), of)


def best_f1(prediction: Column, labels: Column) -> Column:
    """Greatest F1 over ``array<string>`` labels."""
    clean = without_thinking(prediction)
    return F.array_max(F.transform(labels, lambda g: token_f1(clean, g)["f1"]))


def search_f1(prediction: Column, labels: Column) -> Column:
    """F1 inside finish tags; 0.1 for the form alone, 0 without it."""
    formed = F.contains(prediction, F.lit("<finish>")) | F.contains(prediction, F.lit("</finish>"))
    answer = before_first(after_last(prediction, "<finish>"), "</finish>")
    f1 = F.array_max(F.transform(labels, lambda g: token_f1(answer, g)["f1"]))
    return F.when(~formed | (answer == ""), 0.0).otherwise(let(f1, lambda x: F.when(x == 0, 0.1).otherwise(x)))


def search_match(prediction: Column, labels: Column) -> Column:
    """Whether the first text in finish tags, in any case, equals a label after normalisation."""
    answer = F.trim(F.regexp_extract(prediction, r"(?is)<finish>(.*?)</finish>", 1))
    equal = lambda a: (a != "") & let(normalize_answer(a), lambda n: F.exists(labels, lambda g: normalize_answer(g) == n))
    return score(let(answer, equal))  # the answer is found and normalised once, however many labels there are


def length_closeness(tokens: Column, wanted: Column, longest: float) -> Column:
    """One minus the distance as a share of ``longest``; below 0 for great distances."""
    return 1 - F.abs(tokens - wanted.cast("double")) / longest


def up_to_length(tokens: Column, wanted: Column, longest: float) -> Column:
    over = tokens - wanted.cast("double")
    return F.when(over < 0, 1.0).otherwise(1 - over / longest)


def code_pass_rate(results: Column, runtimes: Column | None = None, threshold: float = 0.0, slow: float | None = None) -> Column:
    """Share of passed tests of given results, 0 under the threshold; passes slower than ``slow`` seconds fade."""
    n = F.size(results)
    good = F.zip_with(results, runtimes if runtimes is not None else results, lambda r, t: F.when(r == 1, F.lit(1.0) if slow is None else F.least(F.lit(1.0), slow / F.greatest(t.cast("double"), F.lit(1e-9)))).otherwise(0.0))
    rate = F.aggregate(good, F.lit(0.0), lambda a, x: a + x) / F.when(n > 0, n)
    return F.coalesce(F.when(rate >= threshold, rate).otherwise(0.0), F.lit(0.0))


def rubric(scores: Column, weights: Column) -> Column:
    """Sum of judge scores (0 to 2, halved) by weight over the sum of absolute weights; 0 without weight."""
    total = F.aggregate(weights, F.lit(0.0), lambda a, w: a + F.abs(w.cast("double")))
    got = F.aggregate(F.zip_with(scores, weights, lambda s, w: s.cast("double") / 2 * w), F.lit(0.0), lambda a, x: a + x)
    return F.when(total > 0, got / total).otherwise(0.0)


def soft_format(text: Column, reward: float = 1.0) -> Column:
    return F.when(text.rlike(r"(?s)\A.*?</think>\s*<answer>.*?</answer>"), F.lit(reward)).otherwise(0.0)


def last_or_sum(rewards: Column, how: str) -> Column:
    """Turn rewards as one: the last, or the sum; 0 for none."""
    if how == "last":
        return F.coalesce(F.try_element_at(rewards, F.lit(-1)), F.lit(0.0))
    return F.aggregate(rewards, F.lit(0.0), lambda a, x: a + x)


def assembled(verifiable: Column, turn_rewards: Column, format_reward: Column | None = None, how: str = "last", additive: bool = False, stopped: Column | None = None, penalty: float = 0.0) -> Column:
    """Reward of a rollout: the verifier's score joins the last turn, turns are combined, format and stop rules applied."""
    n = F.size(turn_rewards)
    turns = F.when(n > 0, F.transform(turn_rewards, lambda x, i: x + F.when(i == n - 1, verifiable).otherwise(0.0))).otherwise(F.array(verifiable))
    raw = last_or_sum(turns, how)
    if format_reward is not None:
        raw = raw + format_reward if additive else F.when(format_reward == 1, raw).otherwise(0.0)
    return raw if stopped is None else F.when(stopped, raw).otherwise(F.lit(penalty))


# judges

def judge_score(text: Column) -> Column:
    """A ratio, else a percentage, else the first number, else a word of assent or dissent, else 0."""
    ratio = F.regexp_extract(text, r"([0-9]+)/([0-9]+)", 1).try_cast("double") / F.nullif(F.regexp_extract(text, r"([0-9]+)/([0-9]+)", 2).try_cast("double"), F.lit(0.0))
    percent = F.regexp_extract(text, r"([0-9]+\.?[0-9]*|\.[0-9]+)%", 1).try_cast("double") / 100
    number = F.regexp_extract(text, r"([0-9]+\.?[0-9]*|\.[0-9]+)", 1).try_cast("double")
    assent = F.when(F.lower(text).rlike("yes|correct|good|true|pass"), 1.0).otherwise(0.0)
    return F.coalesce(ratio, percent, number, assent)


def final_decision(text: Column) -> Column:
    return score(F.contains(F.lower(text), F.lit("final decision: yes")))


def json_judge_score(text: Column, out_of: float = 1.0) -> Column:
    """``SCORE`` of a JSON answer, fenced or not, or of one that only looks like JSON."""
    bare = F.regexp_replace(F.regexp_replace(F.trim(text), r"^```(?:json)?", ""), r"```$", "")
    parsed = F.try_variant_get(F.try_parse_json(bare), "$.SCORE", "string").try_cast("double")
    found = F.regexp_extract(bare, r'"SCORE"\s*:\s*"?([0-9]+(?:\.[0-9]+)?)"?', 1).try_cast("double")
    return F.coalesce(parsed, found, F.lit(0.0)) / out_of


def first_json(text: Column) -> Column:
    """The first JSON object in a text, from the first brace to the last that still parses."""
    tail = F.when(F.instr(text, "{") > 0, F.substring(text, F.instr(text, "{"), F.length(text)))
    parts = F.split(tail, r"\}")
    tries = F.transform(F.sequence(F.lit(1), F.greatest(F.size(parts) - 1, F.lit(1))), lambda i: F.concat(F.array_join(F.slice(parts, 1, i), "}"), F.lit("}")))
    return F.try_element_at(F.filter(tries, lambda t: F.try_parse_json(t).isNotNull()), F.lit(1))


def code_block(text: Column) -> Column:
    """The last fenced block; the whole text without one."""
    return F.coalesce(F.try_element_at(F.regexp_extract_all(text, F.lit(r"(?s)```(?:[a-zA-Z0-9]*\n)?(.*?)```"), 1), F.lit(-1)), text)


def _stripped(text: Column) -> Column:
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def final_answer(text: Column) -> Column:
    """The trimmed text in the first answer tags, which may be empty; else what follows the end of the thinking, trimmed; else
    the text without assistant marks, trimmed if there were any."""
    tagged, thought = text.rlike("(?s)<answer>.*?</answer>"), F.contains(text, F.lit("</think>"))
    spoken = F.replace(text, F.lit("<|assistant|>"), F.lit(""))
    return (
        F.when(tagged, _stripped(F.regexp_extract(text, "(?s)<answer>(.*?)</answer>", 1)))
        .when(thought, _stripped(F.substring(text, F.locate("</think>", text) + 8, F.length(text))))
        .when(spoken != text, _stripped(spoken)).otherwise(text)
    )


#: A user's turn that an assistant's thinking answers: between role lines, or between turn marks, tools left out.
_ASKED = r"(?s)<\|user\|>\n.*?\n<\|assistant\|>\n<think>|<\|im_start\|>user\n.*?<\|im_end\|>\n(?=.*?<\|im_start\|>assistant\n<think>)"


def user_query(conversation: Column) -> Column:
    """What the user said last before an assistant's thinking, trimmed; the whole text without such a turn."""
    turn = F.try_element_at(F.regexp_extract_all(conversation, F.lit(_ASKED), 0), F.lit(-1))
    plain = F.regexp_replace(turn, r"(?s)^<\|user\|>\n|\n<\|assistant\|>\n<think>$", "")
    marked = F.regexp_replace(turn, r"(?s)^<\|im_start\|>user\n|(?:\n<functions>.*?</functions>)?<\|im_end\|>\n$", "")
    return F.when(turn.isNull(), conversation).otherwise(_stripped(F.when(F.startswith(turn, F.lit("<|user|>")), plain).otherwise(marked)))


#: Verifiers by name; labels are ``array<string>`` where several count, else the first counts.
VERIFIERS: dict[str, Callable[[Column, Column], Column]] = {
    "gsm8k": lambda p, g: grade_school(p, F.get(g, F.lit(0))),
    "flan": lambda p, g: flan(p, F.get(g, F.lit(0))),
    "string_matcher": lambda p, g: in_answer_tags(p, F.get(g, F.lit(0))),
    "puzzle": lambda p, g: puzzle(p, F.get(g, F.lit(0))),
    "string_f1": best_f1,
    "re_search_f1": search_f1,
    "re_search": search_match,
    "passthrough": lambda p, g: F.lit(0.0),
}


def registry(remap: str | None = None) -> dict[str, Callable[[Column, Column], Column]]:
    """All verifiers; ``old=new`` lets an old name call a verifier."""
    out = dict(VERIFIERS)
    if remap:
        old, new = remap.split("=")
        out[old.lower()] = out[new.lower()]
    return out


def rewards(df: DataFrame, key: str, prediction: str, pairs: str, verifiers: dict | None = None, scale: float = 1.0) -> DataFrame:
    """Reward of each row over its ``array<struct<dataset, label>>``, in sum and by verifier; unknown names are skipped."""
    known = verifiers or VERIFIERS
    rows = df.select(key, prediction, F.explode(pairs).alias("p")).withColumn("name", F.lower("p.dataset")).where(F.col("name").isin(*known))
    label = F.array(F.col("p.label"))
    value = reduce(lambda acc, kv: F.when(F.col("name") == kv[0], kv[1](F.col(prediction), label)).otherwise(acc), known.items(), F.lit(0.0))
    each = rows.select(key, "name", (scale * value).alias("s")).groupBy(key, "name").agg(F.sum("s").alias("s"))
    return each.groupBy(key).agg(F.sum("s").alias("reward"), F.array_join(F.sort_array(F.collect_list(F.concat_ws("=", "name", F.round("s", 4)))), ",").alias("by_verifier"))
