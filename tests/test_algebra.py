"""Symbolic equality of answers: what is equal, what is not, and what has no form."""

import random
import re
import time
from fractions import Fraction

import pytest

from curata.functions import algebra

EQUAL = [
    (r"\frac{2}{4}", "0.5"), ("(x+1)^2", "x^2+2x+1"), (r"\sqrt{8}", r"2\sqrt{2}"), (r"\frac{1}{\sqrt{2}}", r"\frac{\sqrt{2}}{2}"),
    (r"\dfrac12", "1/2"), (r"2^{x+1}", r"2\cdot 2^x"), (r"4^x", "2^{2x}"), (r"\sqrt{6}", r"\sqrt{2}\sqrt{3}"), (r"\sqrt[3]{54}", r"3\sqrt[3]{2}"),
    (r"\frac{x^2-1}{x-1}", "x+1"), (r"a(b+c)", "ca+ab"), (r"\sin^2 x + \cos^2 x", "1"), (r"\tan x", r"\frac{\sin x}{\cos x}"), (r"\ln 8", r"3\ln 2"),
    (r"\log_2 8", "3"), (r"5!", "120"), (r"\binom{5}{2}", "10"), (r"-\frac{3}{-6}", ".5"), (r"\left(\frac{1}{2}\right)^2", "0.25"), ("x_1 + x_2", "x_{2}+x_1"),
    (r"\frac{1}{x}+\frac{1}{y}", r"\frac{x+y}{xy}"), (r"(\sqrt{x+1})^2", "x+1"), (r"\sqrt{4x+4}", r"2\sqrt{x+1}"), (r"\pi r^2", r"r\cdot r\pi"), ("|-3|", "3"),
    (r"\sqrt{\frac{3}{4}}", r"\frac{\sqrt3}{2}"), (r"e^{2x}", r"(e^x)^2"), ("8^{2/3}", "4"), (r"\cos(-x)", r"\cos x"), (r"(2+\sqrt3)(2-\sqrt3)", "1"), ("1{,}5".replace("{,}", "."), "3/2"),
]
UNEQUAL = [
    ("1", "2"), ("x", "y"), ("(x+1)^2", "x^2+1"), (r"\sqrt{2}", "1.414"), (r"\frac{1}{3}", "0.333"), (r"\sqrt{x^2}", "x"), ("2^x", "x^2"), (r"\sin x", r"\cos x"),
    ("x=1", "1"), ("(1,2)", "(1,2)"), (r"\text{yes}", r"\text{yes}"), ("", ""), ("1/0", "1/0"), ("((", "(("), ("2^{100000000}", "2^{100000000}"), ("(a+b+c+d+e)^{39}", "(a+b+c+d+e)^{39}"), ("1" * 500, "1" * 500),
    ("(" * 300 + "1" + ")" * 300, "1"), ("-" * 390 + "1", "1"), ("2^{2^{2^{2^{9}}}}", "1"), (None, "1"), (r"\frac{1}{2", "0.5"),
]


@pytest.mark.parametrize(("a", "b"), EQUAL)
def test_equal(a, b):
    assert algebra.equal(a, b) and algebra.equal(b, a)


@pytest.mark.parametrize(("a", "b"), UNEQUAL)
def test_unequal(a, b):
    began = time.perf_counter()
    assert not algebra.equal(a, b) and not algebra.equal(b, a)
    assert time.perf_counter() - began < 2


def test_random_expressions_by_value():
    """Equal forms have equal values at a random point, and expressions that differ in value are told apart."""
    rng = random.Random(11)

    def made(depth):
        if depth == 0:
            return rng.choice(["x", "y", "2", "3", "0.5"])
        a, b = made(depth - 1), made(depth - 1)
        return rng.choice([f"({a}+{b})", f"({a}-{b})", f"{a}\\cdot {b}", f"\\frac{{{a}}}{{({b}+7)}}", f"({a})^2"])

    def value(text):
        text = text.replace("\\cdot", "*").replace("^", "**")
        while "\\frac" in text:
            at = text.rindex("\\frac")
            ends, depth, k = [], 0, at + 5
            while len(ends) < 2:
                depth += (text[k] == "{") - (text[k] == "}")
                ends += [k] if depth == 0 else []
                k += 1
            text = f"{text[:at]}(({text[at + 6:ends[0]]})/({text[ends[0] + 2:ends[1]]})){text[k:]}"
        text = re.sub(r"(?<![\w.*])(\d+\.?\d*)", r"Fraction('\1')", text)
        return eval(text, {"Fraction": Fraction, "x": Fraction(5, 3), "y": Fraction(-7, 11)})

    for _ in range(150):
        a, b = made(2), made(2)
        try:
            same = value(a) == value(b)
        except ZeroDivisionError:
            continue
        if algebra.form(a) is None or algebra.form(b) is None:
            continue
        assert same or not algebra.equal(a, b), (a, b)
        assert algebra.equal(a, f"{a}+{b}-({b})"), (a, b)
