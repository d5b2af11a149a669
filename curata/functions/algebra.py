r"""Symbolic equality of LaTeX answers: an expression becomes a quotient of two polynomials with exact coefficients.

A polynomial maps products of powers to fractions. What is raised to a power is a prime, a symbol, a function of a quotient,
a constant base with a variable exponent, or another polynomial under a root; exponents are fractions. Whole parts of the
powers of primes and of roots are multiplied out and ``cos^2`` is written as ``1 - sin^2``, so numbers, roots, powers and
rational functions have one form each. Two expressions are equal if the cross product of their quotients is zero.

Work is bounded: texts, numbers of terms, exponents and nesting beyond the limits below have no form and are equal to
nothing, as is anything that is not one expression, such as an equation, a list or plain words.
"""

from __future__ import annotations

import re
from fractions import Fraction
from functools import lru_cache
from math import comb, factorial

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType

#: Characters of a text, terms of a polynomial, size of an exponent, nested brackets and bits of a number.
LONGEST, TERMS, EXPONENT, DEPTH, BITS = 400, 400, 40, 30, 4000

Monomial = tuple  # sorted (base, exponent) pairs
Poly = dict  # monomial -> fraction

ONE: Poly = {(): Fraction(1)}


class NoForm(Exception):
    """The text is no expression, or too large."""


def _order(x):
    return repr(x)


def add(p: Poly, q: Poly, sign: int = 1) -> Poly:
    out = dict(p)
    for m, c in q.items():
        c = out.get(m, 0) + sign * c
        if c:
            out[m] = c
        else:
            out.pop(m, None)
    if len(out) > TERMS:
        raise NoForm("too many terms")
    return out


def _reduced(powers: dict, c: Fraction) -> Poly:
    """A product of powers as a polynomial: whole parts of primes and roots are multiplied out."""
    kept, extra = {}, [ONE]
    for base, e in powers.items():
        if not e:
            continue
        whole = e.numerator // e.denominator
        if base[0] == "prime" and whole:
            if abs(whole) > BITS:
                raise NoForm("too large")
            c *= Fraction(base[1]) ** whole
            e -= whole
        elif base[0] == "root" and whole > 0:
            extra.append(power(dict(base[1]), whole))
            e -= whole
        elif base[:2] == ("fn", "cos") and e.denominator == 1 and e >= 2:
            sine = {((("fn", "sin", base[2]), Fraction(2)),): Fraction(-1), (): Fraction(1)}
            extra.append(power(sine, int(e) // 2))
            e = Fraction(int(e) % 2)
        if e:
            kept[base] = e
    if max(c.numerator.bit_length(), c.denominator.bit_length()) > BITS:
        raise NoForm("too large")
    out = {tuple(sorted(kept.items(), key=_order)): c} if c else {}
    for p in extra[1:]:
        out = mul(out, p)
    return out


def mul(p: Poly, q: Poly) -> Poly:
    if len(p) * len(q) > TERMS * 8:
        raise NoForm("too many terms")
    out: Poly = {}
    for m, c in p.items():
        for n, d in q.items():
            powers = dict(m)
            for base, e in n:
                powers[base] = powers.get(base, 0) + e
            out = add(out, _reduced(powers, c * d))
    return out


def power(p: Poly, n: int) -> Poly:
    if n > EXPONENT and not (len(p) == 1 and () in p and n * max(p[()].numerator.bit_length(), p[()].denominator.bit_length()) <= BITS):
        raise NoForm("too large an exponent")
    if len(p) == 1:
        (m, c), = p.items()
        return _reduced({b: e * n for b, e in m}, c**n)
    out = ONE
    for _ in range(n):
        out = mul(out, p)
    return out


class Quotient:
    """A polynomial over another that is not zero."""

    def __init__(self, top: Poly, bottom: Poly = ONE):
        if not bottom:
            raise NoForm("division by zero")
        if len(bottom) == 1:  # a monomial moves up
            (m, c), = bottom.items()
            if all(b[0] != "root" and b[:2] != ("fn", "cos") for b, _ in m):
                top, bottom = mul(top, _reduced({b: -e for b, e in m}, 1 / c)), ONE
        self.top, self.bottom = top, bottom

    def key(self) -> tuple:
        """The same for equal quotients with the same bottom; bottoms are scaled so that one coefficient is 1."""
        scale = self.bottom[min(self.bottom, key=_order)]
        return tuple(tuple(sorted(((m, c / scale) for m, c in p.items()), key=_order)) for p in (self.top, self.bottom))

    def __add__(self, other: Quotient) -> Quotient:
        if self.bottom == other.bottom:
            return Quotient(add(self.top, other.top), self.bottom)
        return Quotient(add(mul(self.top, other.bottom), mul(other.top, self.bottom)), mul(self.bottom, other.bottom))

    def __mul__(self, other: Quotient) -> Quotient:
        return Quotient(mul(self.top, other.top), mul(self.bottom, other.bottom))

    def __neg__(self) -> Quotient:
        return Quotient({m: -c for m, c in self.top.items()}, self.bottom)

    def inverse(self) -> Quotient:
        return Quotient(self.bottom, self.top)

    def number(self) -> Fraction | None:
        return (self.top.get((), Fraction(0)) if set(self.top) <= {()} else None) if self.bottom == ONE else None


def _atom(base: tuple, e: Fraction = Fraction(1)) -> Quotient:
    return Quotient(_reduced({base: e}, Fraction(1)))


def _factors(n: int) -> dict[int, int]:
    out: dict[int, int] = {}
    for p in [2, *range(3, 2000, 2)]:
        while n % p == 0:
            out[p], n = out.get(p, 0) + 1, n // p
    if n > 1:
        out[n] = 1  # a prime, or one that is never taken apart
    return out


def _number_power(c: Fraction, e: Fraction) -> Quotient:
    if e.denominator == 1:
        if not c and e <= 0:
            raise NoForm("zero to no power")
        return Quotient(power({(): c} if c else {}, int(e))) if e >= 0 else Quotient(power({(): 1 / c}, int(-e)))
    if not c:
        return Quotient({})
    if c < 0:
        if e.denominator % 2 == 0:
            return _atom(("minus",), e) * _number_power(-c, e)
        return _number_power(-c, e) if e.numerator % 2 == 0 else -_number_power(-c, e)
    powers = {("prime", p): k * e for p, k in _factors(c.numerator).items()}
    for p, k in _factors(c.denominator).items():
        powers[("prime", p)] = powers.get(("prime", p), 0) - k * e
    return Quotient(_reduced(powers, Fraction(1)))


def raised(base: Quotient, exponent: Quotient) -> Quotient:
    e = exponent.number()
    c = base.number()
    if e is None:
        if exponent.bottom != ONE or c is not None and c <= 0:
            return _atom(("fn", "power", (base.key(), exponent.key())))
        out = Quotient(ONE)
        for m, k in exponent.top.items():  # a sum in the exponent is a product of powers
            if m == ():
                out *= raised(base, Quotient({(): k}))
            elif c is None:
                out *= _atom(("to", base.key(), m), k)
            else:
                for number, sign in ((c.numerator, 1), (c.denominator, -1)):
                    for p, times in _factors(number).items() if number > 1 else ():
                        out *= _atom(("to", p, m), sign * times * k)
        return out
    if c is not None:
        return _number_power(c, e)
    if e.denominator == 1:
        n = int(e)
        top, bottom = (base.top, base.bottom) if n >= 0 else (base.bottom, base.top)
        return Quotient(power(top, abs(n)), power(bottom, abs(n)))
    if base.bottom == ONE and len(base.top) == 1:
        (m, k), = base.top.items()
        if k == 1 and len(m) == 1 and m[0][0][0] == "symbol" and m[0][1] == 1:
            return _atom(m[0][0], e)
        if m and k > 0 and k != 1:  # a positive factor comes out of the root
            return _number_power(k, e) * raised(Quotient({m: Fraction(1)}), exponent)
    if base.bottom != ONE:
        return _atom(("fn", "power", (base.key(), exponent.key())))
    lead = base.top[min(base.top, key=_order)]
    if lead > 0 and lead != 1:
        return _number_power(lead, e) * raised(Quotient({m: k / lead for m, k in base.top.items()}), exponent)
    whole = e.numerator // e.denominator
    rest = _atom(("root", tuple(sorted(base.top.items(), key=_order))), e - whole)
    return rest * raised(base, Quotient({(): Fraction(whole)} if whole else {})) if whole else rest


def applied(name: str, x: Quotient) -> Quotient:
    """A named function of a quotient, with the values that have a plain form."""
    c = x.number()
    if name == "tan":
        return applied("sin", x) * applied("cos", x).inverse()
    if name in ("sin", "cos") and c == 0:
        return Quotient({} if name == "sin" else ONE)
    if name in ("ln", "log"):
        if c is not None and c > 0:  # a product of primes
            out = Quotient({})
            for number, sign in ((c.numerator, 1), (c.denominator, -1)):
                for p, k in _factors(number).items() if number > 1 else ():
                    out += Quotient({((("fn", "ln", p), Fraction(1)),): Fraction(sign * k)})
            return out
        return _atom(("fn", "ln", x.key()))
    if name == "exp":
        return raised(_atom(("symbol", "e")), x)
    if name == "abs":
        if c is not None:
            return Quotient({(): abs(c)} if c else {})
    elif name in ("sin", "cos") and x.top and x.top[min(x.top, key=_order)] < 0:
        y = applied(name, -x)  # odd and even
        return -y if name == "sin" else y
    return _atom(("fn", name, x.key()))


_FUNCTIONS = ("arcsin", "arccos", "arctan", "sinh", "cosh", "tanh", "sin", "cos", "tan", "cot", "sec", "csc", "ln", "log", "exp")
_GREEK = set(
    "alpha beta gamma delta epsilon varepsilon zeta eta theta vartheta iota kappa lambda mu nu xi pi rho sigma tau upsilon phi varphi chi psi omega "
    "Gamma Delta Theta Lambda Xi Pi Sigma Upsilon Phi Psi Omega infty ell hbar".split()
)
_SPACE = re.compile(r"(?:\s|\\[,;:! ]|\\quad|\\qquad|~|\\left(?![a-z])|\\right(?![a-z])|\\displaystyle)+")
_NUMBER = re.compile(r"\d+(?:\.\d+)?|\.\d+")
_COMMAND = re.compile(r"\\([A-Za-z]+)")


class _Reader:
    def __init__(self, text: str):
        self.text, self.at, self.depth = text, 0, 0

    def look(self) -> str:
        m = _SPACE.match(self.text, self.at)
        if m:
            self.at = m.end()
        m = _COMMAND.match(self.text, self.at)
        return m[0] if m else self.text[self.at : self.at + 1]

    def take(self, want: str) -> bool:
        if want and self.look() == want:
            self.at += len(want)
            return True
        return False

    def need(self, want: str) -> None:
        if not self.take(want):
            raise NoForm(f"no {want}")

    def sum(self) -> Quotient:
        self.depth += 1
        if self.depth > DEPTH:
            raise NoForm("too deep")
        out = self.product()
        while (sign := self.look()) in ("+", "-"):
            self.take(sign)
            y = self.product()
            out = out + (y if sign == "+" else -y)
        self.depth -= 1
        return out

    def product(self) -> Quotient:
        out = self.signed()
        while True:
            sign = self.look()
            if sign in ("*", "\\cdot", "\\times"):
                self.take(sign)
                out = out * self.signed()
            elif sign in ("/", "\\div"):
                self.take(sign)
                out = out * self.signed().inverse()
            elif sign and (sign.isalnum() or sign in "([{.|" or self.starts(sign)) and not (sign == "|" and self.bars):
                out = out * self.powered()
            else:
                return out

    bars = 0

    def starts(self, sign: str) -> bool:
        name = sign[1:]
        return sign.startswith("\\") and (name in _FUNCTIONS or name in _GREEK or name in ("frac", "dfrac", "tfrac", "sqrt", "binom", "dbinom"))

    def signed(self) -> Quotient:
        if self.take("-"):
            self.depth += 1
            if self.depth > DEPTH:
                raise NoForm("too deep")
            out = -self.signed()
            self.depth -= 1
            return out
        if self.take("+"):
            return self.signed()
        return self.powered()

    def powered(self) -> Quotient:
        out = self.single()
        while True:
            if self.take("^"):
                out = raised(out, self.argument())
            elif self.take("!"):
                n = out.number()
                if n is None or n.denominator != 1 or not 0 <= n <= 170:
                    raise NoForm("no factorial")
                out = Quotient({(): Fraction(factorial(int(n)))})
            else:
                return out

    def argument(self) -> Quotient:
        """What a command or ``^`` applies to: a group in braces, one digit, one letter or one command."""
        sign = self.look()
        if sign == "{":
            return self.group("{", "}")
        if sign.isdigit():
            self.at += 1
            return Quotient({(): Fraction(int(sign))} if int(sign) else {})
        return self.signed() if sign == "-" else self.single()

    def group(self, left: str, right: str) -> Quotient:
        self.need(left)
        bars, self.bars = self.bars, int(left == "|")
        out = self.sum()
        self.bars = bars
        self.need(right)
        return out

    def single(self) -> Quotient:
        sign = self.look()
        for left, right in (("(", ")"), ("[", "]"), ("{", "}")):
            if sign == left:
                return self.group(left, right)
        if sign == "|":
            return applied("abs", self.group("|", "|"))
        m = _NUMBER.match(self.text, self.at)
        if m:
            self.at = m.end()
            c = Fraction(m[0])
            return Quotient({(): c} if c else {})
        if sign.isalpha() and sign.isascii():
            self.at += 1
            return self.symbol(sign)
        name = sign[1:]
        if name in _GREEK:
            self.at += len(sign)
            return self.symbol(name)
        if name in ("frac", "dfrac", "tfrac"):
            self.at += len(sign)
            top = self.argument()
            return top * self.argument().inverse()
        if name in ("binom", "dbinom"):
            self.at += len(sign)
            n, k = self.argument().number(), self.argument().number()
            if n is None or k is None or n.denominator != 1 or k.denominator != 1 or not 0 <= k <= n <= 500:
                raise NoForm("no binomial")
            return Quotient({(): Fraction(comb(int(n), int(k)))})
        if name == "sqrt":
            self.at += len(sign)
            degree = self.group("[", "]").number() if self.look() == "[" else Fraction(2)
            if not degree:
                raise NoForm("no root")
            return raised(self.argument(), Quotient({(): 1 / degree}))
        if name in _FUNCTIONS:
            self.at += len(sign)
            under = self.argument() if name == "log" and self.take("_") else None
            to = self.argument() if self.take("^") else None
            if name in ("cot", "sec", "csc"):
                x = self.powered()
                s, c = applied("sin", x), applied("cos", x)
                out = {"cot": c * s.inverse() if s.top else s, "sec": c.inverse() if c.top else c, "csc": s.inverse() if s.top else s}[name]
            else:
                out = applied(name, self.powered())
            if under is not None:
                out = out * applied("ln", under).inverse()
            return out if to is None else raised(out, to)
        raise NoForm(f"unexpected {sign!r}")

    def symbol(self, name: str) -> Quotient:
        if self.take("_"):
            if self.look() == "{":
                end = self.text.find("}", self.at)
                if end < 0:
                    raise NoForm("open subscript")
                name, self.at = f"{name}_{self.text[self.at + 1 : end].strip()}", end + 1
            else:
                name, self.at = f"{name}_{self.look()}", self.at + len(self.look())
        return _atom(("symbol", name))


@lru_cache(maxsize=10_000)
def form(text: str) -> Quotient | None:
    """The quotient of a LaTeX expression; None if it has none."""
    text = text.strip().strip("$").strip()
    if not text or len(text) > LONGEST:
        return None
    reader = _Reader(text)
    try:
        out = reader.sum()
        return out if not reader.look() else None
    except (NoForm, RecursionError, ZeroDivisionError, OverflowError):
        return None


def equal(a: str | None, b: str | None) -> bool:
    """Whether both texts are expressions, and equal for all values of their symbols."""
    if a is None or b is None:
        return False
    x, y = form(a), form(b)
    if x is None or y is None:
        return False
    try:
        return mul(x.top, y.bottom) == mul(y.top, x.bottom)
    except (NoForm, RecursionError, OverflowError):
        return False


@F.pandas_udf(BooleanType())
def _any_equal(answers: pd.Series, label: pd.Series) -> pd.Series:
    return pd.Series([a is not None and any(equal(x, y) for x in a) for a, y in zip(answers, label, strict=True)], dtype=bool)


def any_equal(answers: Column, label: Column) -> Column:
    """Whether one of an array of answers is symbolically equal to the label; null answers are equal to nothing.

    The only part of a score that runs in Python, on batches of short texts.
    """
    return _any_equal(answers, label)
