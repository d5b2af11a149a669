"""Personal data in DataFrame functions only: patterns propose spans, checksums confirm them, context weighs them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from curata.functions.native import let
from curata.runtime import free_name

#: Kinds in their order. The look-behinds only save retries inside a run of characters; they change no match.
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9](?:[ -]?[0-9])++"
PHONE = r"\+[0-9][ ().0-9-]+[0-9]"
IBAN = r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])"
KINDS = ["email", "ip", "card", "phone", "iban"]
BASE = KINDS[:4]

#: A cheap test that every text with a match passes; the costly patterns run on those texts only.
GATES = {
    "email": lambda t: F.contains(t, F.lit("@")),
    "ip": lambda t: t.rlike(r"[0-9]\.[0-9]"),
    "card": lambda t: t.rlike(r"[0-9](?:[ -]?[0-9]){13}"),
    "phone": lambda t: t.rlike(r"\+[0-9]"),
    "iban": lambda t: t.rlike(r"[A-Z]{2}[0-9]{2} ?[A-Z0-9]{4}"),
}
PATTERNS = {"email": EMAIL, "ip": IP, "card": CARD, "phone": PHONE, "iban": IBAN}

#: Score of a confirmed span without context, and what a context word adds.
PRIOR = {"email": 0.9, "ip": 0.6, "card": 0.8, "phone": 0.7, "iban": 0.8}
CONTEXT_GAIN = 0.1
CONTEXT_CHARS = 40
CONTEXT = {
    "email": r"(?i)\b(?:mail|e-mail|email|contact|write)\b",
    "ip": r"(?i)\b(?:ip|address|host|server)\b",
    "card": r"(?i)\b(?:card|visa|credit|debit|payment)\b",
    "phone": r"(?i)\b(?:phone|tel|call|mobile|fax)\b",
    "iban": r"(?i)\b(?:iban|account|bank)\b",
}


def _digits(value: Column) -> Column:
    return F.split(F.regexp_replace(value, "[^0-9]", ""), "")


def luhn(value: Column) -> Column:
    """Whether the digits of a string pass the Luhn check."""

    def total(d: Column) -> Column:
        def weigh(x: Column, i: Column) -> Column:
            twice = x.cast("int") * F.when(F.pmod(F.size(d) - i, F.lit(2)) == 0, 2).otherwise(1)
            return F.when(twice > 9, twice - 9).otherwise(twice)

        return F.aggregate(F.transform(d, weigh), F.lit(0), lambda a, x: a + x)

    return F.pmod(let(_digits(value), total), F.lit(10)) == 0


def mod97(value: Column) -> Column:
    """Whether a bank account number passes the mod-97 check of its rotated form, letters counting from 10."""
    flat = F.regexp_replace(value, " ", "")
    turned = F.concat(F.expr("''"), F.substring(flat, 5, 64), F.substring(flat, 1, 4))

    def add(a: Column, c: Column) -> Column:
        code = F.ascii(c)
        return F.when(code >= 65, F.pmod(a * 100 + code - 55, F.lit(97))).otherwise(F.pmod(a * 10 + code - 48, F.lit(97)))

    return F.aggregate(F.split(turned, ""), F.lit(0), add) == 1


def _confirmed(kind: str, value: Column) -> Column:
    n = F.length(F.regexp_replace(value, "[^0-9]", ""))
    if kind == "ip":
        part = lambda x: (F.length(F.ltrim(x, F.lit("0"))) <= 3) & (F.coalesce(x.try_cast("int"), F.lit(256)) <= 255)
        return F.forall(F.split(value, r"\."), part)
    if kind == "card":
        return n.between(14, 19) & luhn(value)
    if kind == "phone":
        return n.between(10, 15)
    if kind == "iban":
        return F.length(F.regexp_replace(value, " ", "")).between(15, 34) & mod97(value)
    return F.lit(True)


def running(values: Column, add, zero: str = "0") -> Column:
    """Running sums (or maxima) of an ``array<int>``, itself included: within blocks of 64 values, then over the blocks.

    Every step of a fold copies what it has so far, so one fold over many values would be quadratic.
    """
    none = F.expr("cast(array() as array<int>)")
    grow = lambda a, x: F.array_append(a, add(F.coalesce(F.try_element_at(a, F.lit(-1)), F.expr(zero)), x))

    def of(v: Column) -> Column:
        blocks = F.transform(F.sequence(F.lit(0), F.expr("0") + ((F.size(v) - 1) / 64).cast("int")), lambda k: F.slice(v, k * 64 + 1, 64))
        inside = F.transform(blocks, lambda b: F.aggregate(b, none, grow))

        def whole(p: Column) -> Column:
            ends = F.aggregate(F.transform(p, lambda b: F.try_element_at(b, F.lit(-1))), none, grow)
            shifted = lambda e: F.transform(p, lambda b, k: F.transform(b, lambda x: F.when(k == 0, x).otherwise(add(F.get(e, k - 1), x))))
            return F.flatten(let(ends, shifted))

        return F.when(F.size(v) > 0, let(inside, whole)).otherwise(none)

    return let(values, of)


def spans_of(text: Column, kind: str) -> Column:
    """``array<struct<start, kind_no, end, kind, score>>``: confirmed, leftmost, non-overlapping, in code points.

    The text is split at the pattern, so the lengths of gaps and matches add up to the places. The context of a match is
    the gap before it and the match before that, ``CONTEXT_CHARS`` characters at most.
    """
    none = F.expr("cast(array() as array<struct<start:int,kind_no:int,end:int,kind:string,score:double>>)")
    matches, gaps = F.regexp_extract_all(text, F.lit(PATTERNS[kind]), 0), F.split(text, PATTERNS[kind], -1)

    def placed(g: Column) -> Column:
        def build(ms: Column) -> Column:
            sizes = F.transform(ms, lambda m, i: F.length(F.get(g, i)) + F.length(m))
            ends = running(sizes, lambda a, x: a + x)
            found = F.filter(
                F.zip_with(F.transform(ms, lambda m, i: F.struct(m.alias("value"), i.alias("i"))), ends, lambda x, e: F.struct(x["value"].alias("value"), x["i"].alias("i"), e.alias("end"))),
                lambda x: _confirmed(kind, x["value"]),
            )

            def span(x: Column) -> Column:
                near = F.concat(F.coalesce(F.get(ms, x["i"] - 1), F.lit("")), F.get(g, x["i"]))
                gain = F.when(F.right(near, F.lit(CONTEXT_CHARS)).rlike(CONTEXT[kind]), F.lit(CONTEXT_GAIN)).otherwise(F.lit(0.0))
                return F.struct(
                    (x["end"] - F.length(x["value"])).alias("start"), F.lit(KINDS.index(kind)).alias("kind_no"), x["end"].alias("end"),
                    F.lit(kind).alias("kind"), (F.lit(PRIOR[kind]) + gain).alias("score"),
                )

            return F.transform(found, span)

        return let(matches, build)

    return F.when(GATES[kind](text), let(gaps, placed)).otherwise(none)


def pii_spans(text: Column, kinds: list[str] = KINDS) -> Column:
    """All confirmed spans by start, then kind. A null text has none."""
    text = F.coalesce(text, F.lit(""))
    return F.sort_array(F.concat(*(spans_of(text, k) for k in kinds)))


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def with_pii(docs: DataFrame, text: str = "text", out: str = "pii") -> DataFrame:
    """``docs`` with a column of all spans. Rows, ties and other columns stay as they are."""
    return docs.withColumn(out, pii_spans(F.col(text)))


#: Characters of the chunks that a text is cut into before its parts are taken: a part costs the way from its chunk's start.
CHUNK = 16_384


def redacted(text: Column, spans: Column) -> Column:
    """The text with each span, or run of overlapping spans, replaced by the first one's kind in brackets."""
    chunks = F.transform(F.sequence(F.lit(0), F.expr("0") + (F.length(text) / CHUNK).cast("int")), lambda k: F.substring(text, k * CHUNK + 1, F.lit(CHUNK)))

    def part(c: Column, a: Column, b: Column) -> Column:
        first, last = (a / CHUNK).cast("int"), (b / CHUNK).cast("int")
        piece = lambda k, at, n: F.substring(F.coalesce(F.get(c, k), F.lit("")), at + 1, n)
        far = F.concat(
            piece(first, a % CHUNK, F.lit(CHUNK)), F.array_join(F.slice(c, first + 2, F.greatest(last - first - 1, F.lit(0))), ""), piece(last, F.lit(0), b % CHUNK)
        )
        return F.when(first == last, piece(first, a % CHUNK, b - a)).otherwise(far)

    def build(s: Column) -> Column:
        reach = running(F.transform(s, lambda x: x["end"]), lambda a, x: F.greatest(a, x))

        def with_reach(r: Column) -> Column:
            heads = F.filter(F.sequence(F.lit(0), F.size(s) - 1), lambda i: (i == 0) | (F.get(s, i)["start"] >= F.get(r, i - 1)))

            def marked(c: Column) -> Column:
                before = lambda i: F.when(i == 0, F.lit(0)).otherwise(F.get(r, i - 1))
                run = lambda i: F.concat(part(c, before(i), F.get(s, i)["start"]), F.lit("["), F.upper(F.get(s, i)["kind"]), F.lit("]"))
                return F.concat(F.array_join(F.transform(heads, run), ""), part(c, F.array_max(r), F.length(text)))

            return let(chunks, marked)

        return F.when(F.size(s) > 0, let(reach, with_reach)).otherwise(text)

    return let(spans, build)


def redact(docs: DataFrame) -> DataFrame:
    """``docs`` with every confirmed span of ``text`` replaced by its kind; null texts stay null, all rows stay."""
    mark = free_name(docs, "curata_pii")
    out = with_pii(docs, "text", mark)
    clean = F.when(F.size(mark) > 0, redacted(F.col("text"), F.col(mark))).otherwise(F.col("text"))
    return out.withColumn("text", clean).select(*docs.columns)


def op9_pii(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = with_pii(docs).select("doc_id", F.col("pii"))
    base = F.filter("pii", lambda s: s["kind_no"] < len(BASE))
    count = lambda k: F.size(F.filter("pii", lambda s: s["kind_no"] == KINDS.index(k))).cast("long")
    return found.select(
        "doc_id", *(count(k).alias(f"n_{k}") for k in BASE), F.sha2(_joined(base), 256).alias("base_sha256"),
        _joined(F.col("pii")).alias("spans"), F.coalesce(F.array_max(F.transform("pii", lambda s: s["score"])), F.lit(0.0)).alias("top_score"),
    )
