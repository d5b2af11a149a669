"""Answers in LaTeX: extraction, normal forms and equality."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from curata.functions import algebra
from curata.functions.native import let
from curata.functions.text import after_last
from curata.functions.verifiers import score

# Replacements and removals of the normal form, in order.
REPLACED = [
    ("an ", ""), ("a ", ""), (".$", "$"), ("\\$", ""), ("\\ ", ""), (" ", ""), ("mbox", "text"), (",\\text{and}", ","),
    ("\\text{and}", ","), ("\\text{m}", "\\text{}"),
]
REMOVED = [
    "square", "ways", "integers", "dollars", "mph", "inches", "ft", "hours", "km", "units", "\\ldots", "sue", "points", "feet",
    "minutes", "digits", "cents", "degrees", "cm", "gm", "pounds", "meters", "meals", "edges", "students", "childrentickets",
    "multiples", "\\text{s}", "\\text{.}", "\\text{\ns}", "\\text{}^2", "\\text{}^3", "\\text{\n}", "\\text{}", "\\mathrm{th}",
    "^\\circ", "^{\\circ}", "\\;", ",\\!", "{,}", '"', "\\dots",
]


def _replaced(text: Column, pairs: list[tuple[str, str]]) -> Column:
    return reduce(lambda t, p: F.replace(t, F.lit(p[0]), F.lit(p[1])), pairs, text)


def boxed(text: Column) -> Column:
    r"""The content of the last ``\boxed{...}`` or ``\fbox{...}`` with braces matched; null without one.

    Depth is summed up over the braces that follow the command, and the first that closes it ends the content.
    """
    spaced = F.substring_index(F.substring_index(text, "\\boxed ", -1), "$", 1)
    mark = F.when(F.contains(text, F.lit("\\boxed")), F.lit("\\boxed")).when(F.contains(text, F.lit("\\fbox")), F.lit("\\fbox"))
    tail = F.when(F.contains(text, F.lit("\\boxed")), F.substring_index(text, "\\boxed", -1)).otherwise(F.substring_index(text, "\\fbox", -1))

    def close(t: Column) -> Column:
        parts = F.split(t, r"(?<=[{}])")  # each part ends at a brace
        start = F.struct(F.lit(0).alias("depth"), F.lit(0).alias("at"), F.lit(None).cast("int").alias("end"))

        def step(a: Column, p: Column) -> Column:
            depth = a["depth"] + F.when(F.endswith(p, F.lit("{")), 1).when(F.endswith(p, F.lit("}")), -1).otherwise(0)
            at = a["at"] + F.length(p)
            end = F.when(a["end"].isNull() & (depth == 0) & F.endswith(p, F.lit("}")), at).otherwise(a["end"])
            return F.struct(depth.alias("depth"), at.alias("at"), end.alias("end"))

        end = F.aggregate(parts, start, step, lambda a: a["end"])
        return F.when(F.startswith(t, F.lit("{")), F.substring(t, F.lit(2), end - 2))

    return F.when(F.contains(text, F.lit("\\boxed ")), spaced).when(mark.isNotNull(), let(tail, close))


def stated_answer(text: Column) -> Column:
    """The answer between fixed phrases; null without them."""
    found = F.regexp_extract(F.concat(text, F.lit("I hope it is correct.")), r"Final Answer: The final answer is(.*?). I hope it is correct\.", 1)
    return F.nullif(F.trim(found), F.lit(""))


def normal_answer(answer: Column) -> Column:
    """Normal form of a quantitative answer: words and units out, wrappers opened, shorthands written out."""
    t = _replaced(after_last(answer, "="), REPLACED)
    t = _replaced(t, [(r, "") for r in REMOVED])
    t = F.regexp_replace(t, r"^(.*?)(\$)(.*?)(\$)(.*)$", r"\$$3\$")
    for wrapper in ("text", "textbf", "overline"):
        t = F.regexp_replace(t, rf"\\{wrapper}\{{(.*?)\}}", "$1")
    t = F.regexp_replace(t, r"\\boxed\{(.*)\}", "$1")
    t = F.regexp_replace(t, r"frac([^{])(.)", "frac{$1}{$2}")
    t = F.regexp_replace(t, r"sqrt([^{])", "sqrt{$1}")
    t = F.replace(t, F.lit("$"), F.lit(""))
    return F.when(F.replace(t, F.lit(","), F.lit("")).rlike("^[0-9]+$"), F.replace(t, F.lit(","), F.lit(""))).otherwise(t)


def stripped(text: Column) -> Column:
    """Normal form of a LaTeX string for comparison."""
    t = _replaced(text, [("\n", ""), ("\\!", ""), ("\\\\", "\\"), ("tfrac", "frac"), ("dfrac", "frac"), ("\\left", ""), ("\\right", ""), ("^{\\circ}", ""), ("^\\circ", ""), ("\\$", "")])
    t = F.substring_index(t, "\\text{ ", 1)
    t = _replaced(t, [("\\%", ""), (" .", " 0."), ("{.", "{0.")])
    t = F.when(F.startswith(t, F.lit(".")), F.concat(F.lit("0"), t)).otherwise(t)
    t = F.regexp_replace(t, r"^[^=]{0,2}=([^=]*)$", "$1")
    t = F.regexp_replace(t, r"\\sqrt([^{])", r"\\sqrt{$1}")
    t = F.replace(t, F.lit(" "), F.lit(""))
    t = F.regexp_replace(t, r"\\frac([^{])([^{])", r"\\frac{$1}{$2}")
    t = F.regexp_replace(t, r"\\frac([^{])\{", r"\\frac{$1}{")
    t = F.when(t == "0.5", F.lit("\\frac{1}{2}")).otherwise(t)
    return F.regexp_replace(t, r"^(-?(?:0|[1-9][0-9]*))/(-?(?:0|[1-9][0-9]*))$", r"\\frac{$1}{$2}")


def equal_forms(a: Column, b: Column) -> Column:
    return F.coalesce(stripped(a) == stripped(b), a.isNull() & b.isNull())


def _scored(found: Column, label: Column) -> Column:
    """1 where ``found(plain, answers)`` is plainly equal, or one of its answers is symbolically.

    Only short answers of rows that are not equal yet go to Python.
    """
    short = F.filter(found["answers"], lambda a: F.length(a) <= algebra.LONGEST)
    return score(found["plain"] | algebra.any_equal(F.when(~found["plain"], short), label))


def _found(plain: Column, *answers: Column) -> Column:
    return F.struct(F.coalesce(plain, F.lit(False)).alias("plain"), F.array(*answers).alias("answers"))


def math_score(prediction: Column, label: Column) -> Column:
    """1 if any extracted answer equals the label: boxed, stated, else the last between dollar signs, else all of it.

    Answers are equal if their normal forms are, or if both are expressions that are symbolically equal. A null or empty
    prediction scores 0.
    """
    dollars = F.split(prediction, r"\$")
    last = F.when(F.size(dollars) > 2, F.try_element_at(dollars, F.lit(-2)))
    parts = F.struct(boxed(prediction).alias("box"), normal_answer(stated_answer(prediction)).alias("stated"), normal_answer(F.coalesce(last, prediction)).alias("rest"), last.alias("last"))

    def found(p: Column) -> Column:
        none = p["box"].isNull() & p["stated"].isNull()
        answer = F.when(none, p["rest"])
        whole = F.when(none & p["last"].isNull(), prediction)
        forms = F.array(p["box"], p["stated"], answer, whole)
        plain = F.exists(F.filter(forms, lambda x: x.isNotNull()), lambda x: equal_forms(x, label))
        return _found(plain, p["box"], p["stated"], answer)

    return _scored(let(parts, found), label)


def strict_math_score(prediction: Column, label: Column) -> Column:
    """1 if the stated answer, or without one the whole text, equals the label in normal form or symbolically."""
    answer = normal_answer(F.coalesce(stated_answer(prediction), prediction))
    return _scored(let(answer, lambda a: _found(equal_forms(a, label) & a.isNotNull(), a)), label)


# losses over log-probabilities

def kl_estimates(difference: Column) -> Column:
    """Four estimates of the divergence from log-probability differences."""
    return F.struct(difference.alias("k1"), (difference * difference / 2).alias("k2"), (F.expm1(-difference) + difference).alias("k3"), (F.exp(difference) * difference).alias("k4"))


def dpo_loss(chosen: Column, rejected: Column, chosen_ref: Column, rejected_ref: Column, beta: float = 0.1, smoothing: float = 0.0) -> Column:
    x = beta * ((chosen - rejected) - (chosen_ref - rejected_ref))
    minus_log_sigmoid = lambda z: F.when(z > 0, F.log1p(F.exp(-z))).otherwise(F.log1p(F.exp(z)) - z)
    return (1 - smoothing) * minus_log_sigmoid(x) + smoothing * minus_log_sigmoid(-x)


def wpo_loss(chosen: Column, rejected: Column, chosen_ref: Column, rejected_ref: Column, chosen_mean: Column, rejected_mean: Column, beta: float = 0.1, smoothing: float = 0.0) -> Column:
    """The loss of a pair, weighed by how likely the policy finds its answers: by the mean log-probability of their tokens."""
    return dpo_loss(chosen, rejected, chosen_ref, rejected_ref, beta, smoothing) * F.least(F.exp(chosen_mean + rejected_mean), F.lit(1.0))


def simpo_loss(chosen: Column, rejected: Column, beta: float = 2.0, margin: float = 1.0) -> Column:
    x = beta * (chosen - rejected) - margin
    return F.when(x > 0, F.log1p(F.exp(-x))).otherwise(F.log1p(F.exp(x)) - x)


def sequence_logp(logps: Column, labels: Column, mean: bool = False, masked: int = -100) -> Column:
    total = F.aggregate(F.zip_with(logps, labels, lambda p, y: F.when(y != masked, p).otherwise(0.0)), F.lit(0.0), lambda a, x: a + x)
    n = F.size(F.filter(labels, lambda y: y != masked))
    return total / F.when(n > 0, n) if mean else total
