"""Queries: verifiers, judges, rewards and instruction constraints."""

from __future__ import annotations

from pyspark.sql import functions as F

from curata.functions import constraints as K
from curata.functions import latex as L
from curata.functions import verifiers as V
from curata.functions.text import normalize_answer
from curata.operators import languages as G
from curata.operators import sentences as N
from curata.plans.catalogue import query
from curata.sources.tables import table

# Predictions and labels are made of the documents' whole texts, so that some agree and some do not; null texts are empty.
# Every 17th prediction is made of an empty text, which verifiers must score too.
_S = "CASE WHEN doc_id % 17 = 0 THEN '' ELSE coalesce(text, '') END"
_G = "coalesce(text, '') || CASE doc_id % 3 WHEN 0 THEN '' WHEN 1 THEN ' The ' ELSE ' more' END"
BASE = f"""WITH b AS (SELECT doc_id, {_S} AS s, {_G} AS g, n_chars FROM documents),
"""


def _base(spark, sf_dir, *columns: str):
    docs = table(spark, sf_dir, "documents")
    return docs.select("doc_id", F.expr(_S).alias("s"), F.expr(_G).alias("g"), "n_chars").selectExpr("doc_id", *columns)


def norm(x: str) -> str:
    bare = f"regexp_replace(lower({x}), '[!-/:-@\\[-`{{-~]', '', 'g')"
    return f"array_to_string(list_filter(string_split_regex({bare}, '\\s+'), lambda w: w NOT IN ('', 'a', 'an', 'the')), ' ')"


@query("normalized_answers", BASE + f"x AS (SELECT doc_id, {norm('g')} AS n FROM b) SELECT doc_id, n FROM x")
def normalized_answers(spark, sf_dir):
    return _base(spark, sf_dir, "g").select("doc_id", normalize_answer(F.col("g")).alias("n"))


_NUM = "s || ' costs ' || (n_chars * 7) || ',' || lpad((doc_id % 1000)::VARCHAR, 3, '0') || CASE doc_id % 2 WHEN 0 THEN ' or -1.5' ELSE '' END"


@query("gsm8k_score", BASE + rf"""p AS (SELECT doc_id, {_NUM} AS p, CASE WHEN doc_id % 4 = 0 THEN '-1.5' ELSE (n_chars * 7)::VARCHAR || lpad((doc_id % 1000)::VARCHAR, 3, '0') END AS g FROM b),
e AS (SELECT *, regexp_extract_all(regexp_replace(p, '([0-9]),([0-9])', '\1\2', 'g'), '[-+]?[0-9]*\.[0-9]+|[0-9]+') AS n FROM p)
SELECT doc_id, n[-1] AS extracted, (lower(n[-1]) = lower(g))::INT::DOUBLE AS score FROM e""")
def gsm8k_score(spark, sf_dir):
    p = _base(spark, sf_dir, "concat(s, ' costs ', n_chars * 7, ',', lpad(cast(doc_id % 1000 as string), 3, '0'), case doc_id % 2 when 0 then ' or -1.5' else '' end) as p", "case when doc_id % 4 = 0 then '-1.5' else concat(n_chars * 7, lpad(cast(doc_id % 1000 as string), 3, '0')) end as g")
    return p.select("doc_id", V.last_number(F.col("p")).alias("extracted"), V.grade_school(F.col("p"), F.col("g")).alias("score"))


@query("flan_score", BASE + f"x AS (SELECT doc_id, 'Hm. The answer is: ' || s || '.' AS p, g FROM b) SELECT doc_id, ({norm('trim(string_split(p, $$The answer is: $$)[-1])')} = {norm('g')})::INT::DOUBLE AS score FROM x")
def flan_score(spark, sf_dir):
    rows = _base(spark, sf_dir, "concat('Hm. The answer is: ', s, '.') as p", "g")
    return rows.select("doc_id", V.flan(F.col("p"), F.col("g")).alias("score"))


@query("string_match", BASE + f"x AS (SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN s ELSE 'so <answer>' || s || '</answer> end' END AS p, g FROM b) SELECT doc_id, (contains(p, '<answer>') AND {norm('string_split(string_split(p, $$<answer>$$)[-1], $$</answer>$$)[1]')} = {norm('g')})::INT::DOUBLE AS score FROM x")
def string_match(spark, sf_dir):
    rows = _base(spark, sf_dir, "case when doc_id % 5 = 0 then s else concat('so <answer>', s, '</answer> end') end as p", "g")
    return rows.select("doc_id", V.in_answer_tags(F.col("p"), F.col("g")).alias("score"))


@query("puzzle_match", BASE + f"x AS (SELECT doc_id, '<think>' || g || '</think> <answer>' || s || '</answer>' AS p, g FROM b) SELECT doc_id, ({norm('replace(replace(string_split(p, $$</think>$$)[-1], $$<answer>$$, $$$$), $$</answer>$$, $$$$)')} = {norm('g')})::INT::DOUBLE AS score FROM x")
def puzzle_match(spark, sf_dir):
    rows = _base(spark, sf_dir, "concat('<think>', g, '</think> <answer>', s, '</answer>') as p", "g")
    return rows.select("doc_id", V.puzzle(F.col("p"), F.col("g")).alias("score"))


def f1_sql(pred: str, gold: str) -> str:
    return f"""t AS (SELECT doc_id, list_filter(string_split({norm(pred)}, ' '), lambda w: w <> '') AS p, list_filter(string_split({norm(gold)}, ' '), lambda w: w <> '') AS g FROM b),
pw AS (SELECT doc_id, w, count(*) AS n FROM (SELECT doc_id, unnest(p) AS w FROM t) GROUP BY ALL), gw AS (SELECT doc_id, w, count(*) AS n FROM (SELECT doc_id, unnest(g) AS w FROM t) GROUP BY ALL),
m AS (SELECT doc_id, sum(least(pw.n, gw.n)) AS same FROM pw JOIN gw USING (doc_id, w) GROUP BY doc_id),
u AS (SELECT doc_id, len(p) AS np, len(g) AS ng, coalesce(same, 0) AS same FROM t LEFT JOIN m USING (doc_id))
"""


@query("f1_score", BASE + f1_sql("s", "substr(g, 40)") + "SELECT doc_id, CASE WHEN same > 0 THEN round(2 * (same / np) * (same / ng) / (same / np + same / ng), 6) ELSE 0.0 END AS f1, CASE WHEN same > 0 THEN round(same / np, 6) ELSE 0.0 END AS precision, CASE WHEN same > 0 THEN round(same / ng, 6) ELSE 0.0 END AS recall FROM u")
def f1_score(spark, sf_dir):
    rows = _base(spark, sf_dir, "s", "substr(g, 40) as g").select("doc_id", V.token_f1(F.col("s"), F.col("g")).alias("f"))
    return rows.select("doc_id", *(F.round(f"f.{c}", 6).alias(c) for c in ("f1", "precision", "recall")))


@query("search_f1", BASE + f1_sql("s", "substr(g, 80)") + "SELECT doc_id, CASE WHEN doc_id % 7 = 0 OR doc_id IN (SELECT doc_id FROM b WHERE s = '') THEN 0.0 WHEN same > 0 THEN round(2 * (same / np) * (same / ng) / (same / np + same / ng), 6) ELSE 0.1 END AS score FROM u")
def search_f1(spark, sf_dir):
    rows = _base(spark, sf_dir, "case when doc_id % 7 = 0 then s else concat('x <finish>', s, '</finish>') end as p", "substr(g, 80) as g")
    return rows.select("doc_id", F.round(V.search_f1(F.col("p"), F.array("g")), 6).alias("score"))


@query("search_match", BASE + f"x AS (SELECT *, doc_id % 7 <> 0 AS formed FROM b) SELECT doc_id, (formed AND trim(s) <> '' AND ({norm('s')} = {norm('g')} OR {norm('s')} = 'zzz'))::INT::DOUBLE AS score FROM x")
def search_match(spark, sf_dir):
    rows = _base(spark, sf_dir, "case when doc_id % 7 = 0 then s else concat('x <FINISH>', s, '</finish>') end as p", "g")
    return rows.select("doc_id", V.search_match(F.col("p"), F.array(F.lit("zzz"), F.col("g"))).alias("score"))


@query("max_len_score", "SELECT doc_id, round(1 - abs(n_chars - 2000) / 8192.0, 6) AS close, round(CASE WHEN n_chars < 2000 THEN 1.0 ELSE 1 - (n_chars - 2000) / 8192.0 END, 6) AS up_to FROM documents")
def max_len_score(spark, sf_dir):
    n, w = F.col("n_chars"), F.lit("2000")
    return table(spark, sf_dir, "documents").select("doc_id", F.round(V.length_closeness(n, w, 8192.0), 6).alias("close"), F.round(V.up_to_length(n, w, 8192.0), 6).alias("up_to"))


@query("code_pass_rate", "WITH r AS (SELECT user_id, avg((value > 40)::INT) AS rate FROM events GROUP BY user_id) SELECT user_id, round(CASE WHEN rate >= 0.5 THEN rate ELSE 0.0 END, 6) AS score FROM r")
def code_pass_rate(spark, sf_dir):
    e = table(spark, sf_dir, "events").groupBy("user_id").agg(F.collect_list((F.col("value") > 40).cast("int")).alias("r"))
    return e.select("user_id", F.round(V.code_pass_rate(F.col("r"), threshold=0.5), 6).alias("score"))


@query("rubric_weighted", "SELECT user_id, round(coalesce(sum(s / 2 * w) / nullif(sum(abs(w)), 0), 0), 6) AS score FROM (SELECT user_id, (event_id % 3)::DOUBLE AS s, (event_id % 4 - 1)::DOUBLE AS w FROM events) GROUP BY user_id")
def rubric_weighted(spark, sf_dir):
    e = table(spark, sf_dir, "events").groupBy("user_id").agg(F.collect_list(F.struct((F.col("event_id") % 3).alias("s"), (F.col("event_id") % 4 - 1).alias("w"))).alias("x"))
    return e.select("user_id", F.round(V.rubric(F.col("x.s"), F.col("x.w")), 6).alias("score"))


@query("reward_dispatch", BASE + f"""x AS (SELECT doc_id, s, g, (lower(s) = lower(g))::INT AS same, ({norm('s')} = {norm('g')})::INT AS n FROM b)
SELECT doc_id, (2 * n)::DOUBLE AS reward, 'flan=' || (1.0 * n)::DOUBLE || ',puzzle=' || (1.0 * n)::DOUBLE AS by_verifier FROM x""")
def reward_dispatch(spark, sf_dir):
    rows = _base(spark, sf_dir, "s", "g")
    pairs = F.array(*(F.struct(F.lit(d).alias("dataset"), F.col("g").alias("label")) for d in ("FLAN", "puzzle", "unheard_of")))
    return V.rewards(rows.withColumn("pairs", pairs), "doc_id", "s", "pairs")


@query("reward_assembly", "WITH e AS (SELECT event_id, value, event_type = 'click' AS stopped, event_id % 2 AS v, event_id % 3 AS n FROM events) SELECT event_id, round(CASE WHEN NOT stopped THEN -1.0 ELSE v + CASE WHEN n > 0 THEN 0.25 * n ELSE 0.0 END END, 6)::DOUBLE AS summed, round(CASE WHEN NOT stopped THEN -1.0 ELSE v + CASE WHEN n > 0 THEN 0.25 ELSE 0.0 END END, 6)::DOUBLE AS last FROM e")
def reward_assembly(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_id", (F.col("event_id") % 2).cast("double").alias("v"), F.expr("array_repeat(0.25D, cast(event_id % 3 as int))").alias("t"), (F.col("event_type") == "click").alias("stopped"))
    get = lambda how: F.round(V.assembled(F.col("v"), F.col("t"), how=how, stopped=F.col("stopped"), penalty=-1.0), 6)
    return e.select("event_id", get("sum").alias("summed"), get("last").alias("last"))


@query("soft_format", BASE + r"""x AS (SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN s || '</think> <answer>' || s || '</answer>' WHEN 1 THEN s || '</think>' ELSE s END AS p FROM b) SELECT doc_id, CASE WHEN regexp_matches(p, '(?s)\A.*?</think>\s*<answer>.*?</answer>') THEN 1.0 ELSE 0.0 END::DOUBLE AS score FROM x""")
def soft_format(spark, sf_dir):
    p = _base(spark, sf_dir, "case doc_id % 3 when 0 then concat(s, '</think> <answer>', s, '</answer>') when 1 then concat(s, '</think>') else s end as p")
    return p.select("doc_id", V.soft_format(F.col("p")).alias("score"))


_JUDGE = "CASE event_id % 6 WHEN 0 THEN 'Rating: ' || event_id % 5 || '/5' WHEN 1 THEN event_id % 90 || '.5% sure' WHEN 2 THEN 'score .' || event_id % 10 WHEN 3 THEN 'Yes, correct' WHEN 4 THEN 'bad' ELSE '{\"REASONING\": \"r\", \"SCORE\": ' || event_id % 11 || '}' END"


@query("judge_score_parse", f"""WITH j AS (SELECT event_id, {_JUDGE} AS t FROM events)
SELECT event_id, round(coalesce(try_cast(regexp_extract(t, '([0-9]+)/([0-9]+)', 1) AS DOUBLE) / nullif(try_cast(regexp_extract(t, '([0-9]+)/([0-9]+)', 2) AS DOUBLE), 0), try_cast(regexp_extract(t, '([0-9]+\\.?[0-9]*|\\.[0-9]+)%', 1) AS DOUBLE) / 100, try_cast(regexp_extract(t, '([0-9]+\\.?[0-9]*|\\.[0-9]+)', 1) AS DOUBLE), regexp_matches(lower(t), 'yes|correct|good|true|pass')::INT), 6) AS score FROM j""")
def judge_score_parse(spark, sf_dir):
    e = table(spark, sf_dir, "events").selectExpr("event_id", f"{_JUDGE} as t")
    return e.select("event_id", F.round(V.judge_score(F.col("t")), 6).alias("score"))


@query("judge_json_score", f"SELECT event_id, CASE WHEN event_id % 6 = 5 THEN (event_id % 11) / 10.0 ELSE 0.0 END AS score FROM events")
def judge_json_score(spark, sf_dir):
    e = table(spark, sf_dir, "events").selectExpr("event_id", f"{_JUDGE} as t")
    return e.select("event_id", V.json_judge_score(F.concat(F.lit("```json\n"), "t", F.lit("\n```")), 10.0).alias("score"))


@query("first_json_object", "SELECT event_id, json_extract_string(props, '$.' || json_keys(props)[1]) IS NOT NULL AS found FROM events WHERE props LIKE '{%'")
def first_json_object(spark, sf_dir):
    e = table(spark, sf_dir, "events").where("props like '{%'").select("event_id", V.first_json(F.concat(F.lit("Sure: "), "props", F.lit(" and more"))).alias("j"))
    return e.select("event_id", F.col("j").isNotNull().alias("found"))


@query("code_blocks", BASE + "x AS (SELECT doc_id, s FROM b) SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN s || chr(10) ELSE s END AS code, CASE doc_id % 4 WHEN 3 THEN s ELSE regexp_replace(s, '^\\s+|\\s+$', '', 'g') END AS final FROM x")
def code_blocks(spark, sf_dir):
    rows = _base(spark, sf_dir, "s", "case when doc_id % 2 = 0 then concat('a\n```\nb\n```\n```python\n', s, '\n```') else s end as p", "case doc_id % 4 when 1 then concat('<think>a</think> ', s) when 3 then s else concat('<answer>', s, '</answer>') end as q")
    return rows.select("doc_id", V.code_block(F.col("p")).alias("code"), V.final_answer(F.col("q")).alias("final"))


@query("user_queries", "SELECT doc_id, CASE doc_id % 3 WHEN 2 THEN 'user: ' || n_chars ELSE 'what of ' || n_chars || '?' END AS query FROM documents")
def user_queries(spark, sf_dir):
    """Conversations between role lines and between turn marks, of two questions each, and texts that are neither."""
    asked = F.format_string("what of %d?", F.col("n_chars"))
    lines = F.concat(F.lit("<|user|>\nhi\n<|assistant|>\n<think>a</think>b\n<|user|>\n"), asked, F.lit("\n<|assistant|>\n<think>"))
    marks = F.concat(F.lit("<|im_start|>user\nhi<|im_end|>\n<|im_start|>user\n"), asked, F.lit("\n<functions>[]</functions><|im_end|>\n<|im_start|>assistant\n<think>x"))
    said = F.when(F.col("doc_id") % 3 == 0, lines).when(F.col("doc_id") % 3 == 1, marks).otherwise(F.concat(F.lit("user: "), F.col("n_chars").cast("string")))
    return table(spark, sf_dir, "documents").select("doc_id", V.user_query(said).alias("query"))


ANSWERS = """WITH d AS (SELECT doc_id, n_chars AS n, n_chars % 50 AS k FROM documents)
SELECT doc_id, CASE doc_id % 8 WHEN 1 THEN n % 3 <> 0 WHEN 4 THEN doc_id % 5 <> 0 WHEN 6 THEN false WHEN 7 THEN false ELSE true END::INT::DOUBLE AS score FROM d"""


@query("math_score", ANSWERS)
def math_score(spark, sf_dir):
    """Predictions in eight forms, some right and some not, one of them empty and one null."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.col("n_chars").alias("n"), (F.col("n_chars") % 50).alias("k"))
    case = lambda *forms: F.element_at(F.array(*(F.format_string(f, *c) for f, c in forms)), (F.col("doc_id") % 8 + 1).cast("int"))
    n, k, wrong = F.col("n"), F.col("k"), (F.col("doc_id") % 5 == 0).cast("long")
    nothing = ("", ())
    said = case(
        (r"So \boxed{\frac{%d}{4}} it is", (2 * n,)), ("Final Answer: The final answer is %d. I hope it is correct.", (n,)), ("we get $x=1$ and $%d $", (n,)), ("%d dollars", (n,)),
        (r"\boxed{(x+%d)^2}", (k,)), (r"thus \boxed{\sqrt{%d}}", (2 * k * k,)), nothing, nothing,
    )
    label = case(
        (r"\frac{%d}{2}", (n,)), ("%d", (n + (n % 3 == 0).cast("long"),)), ("%d", (n,)), ("%d", (n,)),
        ("x^2+%dx+%d", (2 * k, k * k + wrong)), (r"%d\sqrt{2}", (k,)), ("1", ()), ("1", ()),
    )
    return d.select("doc_id", L.math_score(F.when(F.col("doc_id") % 8 < 7, said), label).alias("score"))


@query("math_score_strict", "SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN true WHEN 1 THEN n_chars % 2 = 0 ELSE false END::INT::DOUBLE AS score FROM documents")
def math_score_strict(spark, sf_dir):
    """The stated answer counts, not one in a box."""
    n, i = F.col("n_chars"), F.col("doc_id") % 3
    said = F.when(i == 0, F.format_string(r"\boxed{1} Final Answer: The final answer is %d/2. I hope it is correct.", n)).when(i == 1, F.format_string(r"\frac{%d}{3}", n)).otherwise(F.format_string(r"see \boxed{%d}", n))
    label = F.when(i == 0, F.format_string(r"\frac{%d}{4}", 2 * n)).when(i == 1, F.format_string("%d/6", 2 * n + n % 2)).otherwise(F.format_string("%d", n))
    return table(spark, sf_dir, "documents").select("doc_id", L.strict_math_score(said, label).alias("score"))


@query("latex_forms", "SELECT doc_id, '\\frac{' || doc_id || '}{7}' AS slash, '\\sqrt{' || doc_id % 10 || '}+1' AS root, (n_chars * 1000)::VARCHAR AS commas FROM documents")
def latex_forms(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    i = F.col("doc_id").cast("string")
    root = F.concat(F.lit("x=\\sqrt"), (F.col("doc_id") % 10).cast("string"), F.lit(" + 1"))
    return d.select("doc_id", L.stripped(F.concat(i, F.lit("/7"))).alias("slash"), L.stripped(root).alias("root"), L.normal_answer(F.concat(F.lit("about $ "), F.format_number(F.col("n_chars") * 1000, 0), F.lit("$ units"))).alias("c0")).select("doc_id", "slash", "root", F.regexp_replace("c0", "^about", "").alias("commas"))


@query("preference_losses", "WITH e AS (SELECT event_id, -value / 50 AS c, -(100 - value) / 50 AS r FROM events WHERE value IS NOT NULL) SELECT event_id, round(ln(1 + exp(-(0.1 * (c - r)))), 6) AS dpo, round(ln(1 + exp(-(2.0 * (c - r) - 1.0))), 6) AS simpo, round(exp(-(c - r)) - 1 + (c - r), 4) AS k3 FROM e")
def preference_losses(spark, sf_dir):
    e = table(spark, sf_dir, "events").where("value is not null").select("event_id", (-F.col("value") / 50).alias("c"), (-(100 - F.col("value")) / 50).alias("r"))
    c, r = F.col("c"), F.col("r")
    return e.select("event_id", F.round(L.dpo_loss(c, r, F.lit(0.0), F.lit(0.0)), 6).alias("dpo"), F.round(L.simpo_loss(c, r), 6).alias("simpo"), F.round(L.kl_estimates(c - r)["k3"], 4).alias("k3"))


# constraints: one query for each family, a column for each constraint

def constraint_query(name: str, checks: dict[str, tuple[str, dict, str]], registry: dict) -> None:
    """Register a query with a boolean column for each (function, arguments, SQL)."""
    sql = "SELECT doc_id, " + ", ".join(f"coalesce(({x[2]}), false) AS {c}" for c, x in checks.items()) + " FROM documents"

    @query(name, sql)
    def run(spark, sf_dir):
        t = F.col("text")
        return table(spark, sf_dir, "documents").select("doc_id", *(F.coalesce(registry[f](t, **args), F.lit(False)).alias(c) for c, (f, args, _) in checks.items()))


def n_of(pattern: str, text: str = "text") -> str:
    return f"len(regexp_extract_all({text}, '{pattern}'))"


WORDS = r"list_filter(string_split_regex(text, '\s+'), lambda w: w <> '')"
WU = r"[\p{L}\p{N}_]"

def whole(pattern: str) -> str:
    return f"len(list_filter(regexp_extract_all(text, '{WU}+'), lambda w: regexp_full_match(w, '{pattern}')))"


constraint_query("constraints_words", {
    "keywords": ("verify_keywords", {"keyword_list": ["The", "of"]}, "contains(lower(text), 'the') AND contains(lower(text), 'of')"),
    "frequency": ("verify_keyword_frequency", {"word": "the", "N": 3}, f"len(list_filter(regexp_extract_all(lower(text), '{WU}+'), lambda x: x = 'the')) = 3"),
    "forbidden": ("validate_forbidden_words", {"forbidden_words": ["idiot", "scum"]}, "NOT contains(lower(text), 'idiot') AND NOT contains(lower(text), 'scum')"),
    "letters": ("verify_letter_frequency", {"letter": "e", "N": 100}, "length(text) - length(replace(text, 'e', '')) = 100"),
    "at_least": ("validate_word_constraint", {"N": 200, "quantifier": "at least"}, f"len({WORDS}) >= 200"),
    "at_most": ("validate_word_constraint", {"N": 200, "quantifier": "at most"}, f"len({WORDS}) <= 200"),
    "around": ("validate_word_constraint", {"N": 200, "quantifier": "around"}, f"abs(len({WORDS}) - 200) <= 20"),
    "capitals": ("validate_frequency_capital_words", {"N": 2, "quantifier": "at least"}, whole("[A-Z]+") + " >= 2"),
    "upper_case": ("validate_uppercase", {}, "text = upper(text)"),
    "lower_case": ("validate_lowercase", {}, "text = lower(text)"),
    "no_commas": ("validate_no_commas", {}, "NOT contains(text, ',')"),
}, K.FUNCTIONS)

constraint_query("constraints_structure", {
    "paragraphs": ("validate_paragraphs", {"N": 1, "first_word": "The", "i": 1}, "len(string_split(text, chr(10) || chr(10))) = 1 AND starts_with(ltrim(string_split(text, chr(10) || chr(10))[1], ' '), 'The')"),
    "starred": ("verify_paragraph_count", {"N": 1}, "len(string_split(text, '* * *')) = 1 AND trim(replace(text, chr(10), '')) <> ''"),
    "postscript": ("verify_postscript", {"postscript_marker": "License"}, "contains(text, 'License') AND length(trim(substr(text, instr(text, 'License')))) > 7"),
    "placeholders": ("validate_placeholders", {"N": 1}, n_of(r"\[.*?\]") + " >= 1"),
    "bullets": ("verify_bullet_points", {"N": 0}, "len(list_filter(string_split(text, chr(10)), lambda x: regexp_matches(trim(x), '^[*-]'))) = 0"),
    "title": ("validate_title", {}, "regexp_matches(text, '<<.*?>>')"),
    "choice": ("validate_choice", {"options": ["That it.", "Yes."]}, "contains('That it.', text) OR contains('Yes.', text)"),
    "highlights": ("validate_highlighted_sections", {"N": 2}, n_of(r"\*.*?\*") + " >= 2"),
    "sections": ("validate_sections", {"N": 3, "section_splitter": "|"}, "len(string_split(text, '|')) - (string_split(text, '|')[1] = '')::INT = 3"),
    "json": ("validate_json_format", {}, "json_valid(text)"),
    "repeat": ("validate_repeat_prompt", {"original_prompt": "The "}, "starts_with(text, 'The ')"),
    "two": ("validate_two_responses", {}, "len(string_split(text, '******')) = 2 AND trim(string_split(text, '******')[1]) <> trim(string_split(text, '******')[2])"),
    "ending": ("validate_end", {"end_phrase": "."}, "ends_with(text, '.')"),
    "quotation": ("validate_quotation", {}, "starts_with(text, '\"') AND ends_with(text, '\"')"),
}, K.FUNCTIONS)

constraint_query("instructions_keywords", {
    "existence": ("keywords:existence", {"keywords": ["the", "er."]}, "regexp_matches(text, '(?i)the') AND regexp_matches(text, '(?i)er.')"),
    "frequency": ("keywords:frequency", {"keyword": "and", "frequency": 5, "relation": "less than"}, n_of("(?i)and") + " < 5"),
    "forbidden": ("keywords:forbidden_words", {"forbidden_words": ["the"]}, whole("(?i)the") + " = 0"),
    "letter": ("keywords:letter_frequency", {"letter": "z", "let_frequency": 3, "let_relation": "at least"}, "length(text) - length(replace(lower(text), 'z', '')) >= 3"),
    "once": ("keywords:word_once", {"keyword": "with"}, n_of("(?i)with") + " = 1"),
    "harder": ("keywords:exclude_word_harder", {"keyword": "of"}, "NOT contains(text, ' of ')"),
    "palindrome": ("keywords:palindrome", {}, f"len(list_filter({WORDS}, lambda w: w = reverse(w))) > 0"),
    "increment": ("count:count_increment_word", {"keyword1": "from", "keyword2": "this"}, n_of("(?i)from") + " = 1 AND " + n_of("(?i)this") + " = 2"),
    "capital_words": ("change_case:capital_word_frequency", {"capital_frequency": 3, "capital_relation": "at least"}, rf"len(list_filter(regexp_extract_all(text, '{WU}+|[^\p{{L}}\p{{N}}_\s]'), lambda w: w = upper(w) AND w <> lower(w))) >= 3"),
    "unique_tokens": ("count:count_unique", {}, rf"len(regexp_extract_all(text, '{WU}+|[^\p{{L}}\p{{N}}_\s]')) = len(list_distinct(regexp_extract_all(text, '{WU}+|[^\p{{L}}\p{{N}}_\s]')))"),
    "start_end": ("keywords:start_end", {}, rf"len(regexp_extract_all(text, '{WU}+|[^\p{{L}}\p{{N}}_\s]')) > 1 AND lower(regexp_extract_all(text, '{WU}+|[^\p{{L}}\p{{N}}_\s]')[1]) = lower(regexp_extract_all(text, '{WU}+|[^\p{{L}}\p{{N}}_\s]')[-1])"),
    "lowercase_words": ("count:lowercase_counting", {"n": 100}, whole("[a-z]+") + " <= 100"),
    "letters": ("letters:letter_counting", {"n": 500, "relation": "less than"}, n_of("[a-zA-Z]") + " < 500"),
}, K.INSTRUCTIONS)

constraint_query("instructions_format", {
    "words": ("length_constraints:number_words", {"num_words": 300, "relation": "at least"}, n_of(f"{WU}+") + " >= 300"),
    "placeholders": ("detectable_content:number_placeholders", {"num_placeholders": 1}, n_of(r"\[.*?\]") + " >= 1"),
    "postscript": ("detectable_content:postscript", {"postscript_marker": "P.S."}, r"regexp_matches(lower(text), 'p\.\s?s\.')"),
    "bullets": ("detectable_format:number_bullet_lists", {"num_bullets": 0}, n_of(r"(?m)^\s*\*[^*].*$") + " + " + n_of(r"(?m)^\s*-.*$") + " = 0"),
    "constrained": ("detectable_format:constrained_response", {"options": ["My answer", "the"]}, "contains(trim(text), 'My answer') OR contains(trim(text), 'the')"),
    "sections": ("detectable_format:multiple_sections", {"section_spliter": "Part", "num_sections": 0}, r"len(string_split_regex(text, '\s?Part\s?\d+\s?')) - 1 >= 0"),
    "json": ("detectable_format:json_format", {}, "json_valid(text)"),
    "title": ("detectable_format:title", {}, r"len(regexp_extract_all(text, '<<[^\n]+>>')) > 0"),
    "brackets": ("detectable_format:square_brackets", {}, f"len(list_filter({WORDS}, lambda w: NOT (starts_with(w, '[') AND ends_with(w, ']')))) = 0"),
    "repeat_prompt": ("combination:repeat_prompt", {"prompt_to_repeat": "The"}, "starts_with(lower(trim(text)), 'the')"),
    "ending": ("startend:end_checker", {"end_phrase": "ER."}, "ends_with(lower(regexp_replace(trim(text), '^\"+|\"+$', '', 'g')), 'er.')"),
    "quoted": ("startend:quotation", {}, "length(trim(text)) > 1 AND starts_with(trim(text), '\"') AND ends_with(trim(text), '\"')"),
    "no_comma": ("punctuation:no_comma", {}, "NOT contains(text, ',')"),
    "no_dot": ("punctuation:punctuation_dot", {}, "NOT contains(text, '.')"),
    "no_exclamation": ("punctuation:punctuation_exclamation", {}, "NOT contains(text, '!')"),
    "copied": ("copy:copying_simple", {"prompt": "That it. "}, "lower(trim(text)) = 'that it.'"),
    "first_word": ("first_word:first_word_answer", {"first_word": "the"}, f"lower({WORDS}[1]) = 'the'"),
    "last_word": ("last_word:last_word_answer", {"last_word": "the"}, rf"lower(regexp_replace({WORDS}[-1], '[^\p{{L}}\p{{N}}_\s]', '', 'g')) = 'the'"),
    "starter": ("content:constrained_start", {"starter": "Er"}, r"regexp_matches(text, '(?m)^\s*Er.*$')"),
}, K.INSTRUCTIONS)


@query("instruction_scores", "SELECT doc_id, round(((NOT contains(text, ','))::INT + contains(lower(text), 'the')::INT + (len(regexp_extract_all(text, '[\\p{L}\\p{N}_]+')) >= 100)::INT) / 3.0, 6) * (trim(text) <> '')::INT AS score FROM documents")
def instruction_scores(spark, sf_dir):
    checks = [("punctuation:no_comma", {}), ("keywords:existence", {"keywords": ["the"]}), ("length_constraints:number_words", {"num_words": 100, "relation": "at least"})]
    docs = table(spark, sf_dir, "documents")
    return docs.select("doc_id", F.round(K.followed(F.col("text"), checks), 6).alias("score"))


@query("instructions_sentences")
def instructions_sentences(spark, sf_dir):
    """Constraints on sentences; their splitter looks behind, which the SQL side cannot."""
    t = F.col("text")
    checks = {
        "sentences": ("length_constraints:number_sentences", {"num_sentences": 5, "relation": "at least"}),
        "first_words": ("first_word:first_word_sent", {"first_word": "the"}),
        "last_words": ("last_word:last_word_sent", {"last_word": "the"}),
        "composition": ("count:counting_composition", {"n_sent": 2, "n_words": 5}),
        "position": ("keywords:keyword_specific_position", {"keyword": "the", "n": 2, "m": 1}),
        "initials": ("keywords:no_adjacent_consecutive", {}),
    }
    return table(spark, sf_dir, "documents").select(
        "doc_id", F.coalesce(K.verify_sentence_constraint(t, 5, "at least"), F.lit(False)).alias("split_sentences"),
        *(F.coalesce(K.INSTRUCTIONS[f](t, **a), F.lit(False)).alias(c) for c, (f, a) in checks.items()),
    )


# learned models: languages and sentences

LANGUAGES = """WITH c AS (SELECT doc_id, lang, list_transform(string_split(' ' || text || ' ', ''), lambda x: unicode(x)) AS c FROM documents WHERE text <> ''),
g AS (SELECT doc_id, lang, (c[i] * 961 + c[i + 1] * 31 + c[i + 2]) % 65536 AS bucket FROM (SELECT *, unnest(range(1, len(c) - 1)) AS i FROM c)),
p AS (SELECT lang, bucket, count(*) AS n FROM g WHERE doc_id % 4 <> 0 AND lang IS NOT NULL GROUP BY ALL), t AS (SELECT lang, sum(n) AS total FROM p GROUP BY lang),
d AS (SELECT doc_id, bucket, count(*) AS times FROM g GROUP BY ALL),
s AS (SELECT doc_id, t.lang, sum(times * ln((coalesce(n, 0) + 0.5) / (total + 0.5 * 65536))) AS score FROM d CROSS JOIN t LEFT JOIN p ON p.lang = t.lang AND p.bucket = d.bucket GROUP BY ALL),
b AS (SELECT doc_id, arg_max(lang, score) AS detected FROM s GROUP BY doc_id)
"""


def _detector(spark, sf_dir):
    """Learned from three quarters of the documents."""
    return G.detector(spark, G.learn(table(spark, sf_dir, "documents").where("doc_id % 4 <> 0")))


@query("language_detected", LANGUAGES + "SELECT doc_id, doc_id % 4 = 0 AS held_out, detected FROM documents LEFT JOIN b USING (doc_id)")
def language_detected(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return docs.select("doc_id", (F.col("doc_id") % 4 == 0).alias("held_out"), _detector(spark, sf_dir)(F.col("text")).alias("detected"))


@query("instructions_language", LANGUAGES + "SELECT doc_id, coalesce(detected = 'de', false) AS german, coalesce(upper(text) <> lower(text) AND detected = 'en', false) AS capital, coalesce(upper(text) <> lower(text) AND detected = 'de', false) AS lowercase FROM documents LEFT JOIN b USING (doc_id)")
def instructions_language(spark, sf_dir):
    """Upper and lower case texts keep their language's profile where the detector sees the text as it was."""
    detect, t = _detector(spark, sf_dir), F.col("text")
    seen = lambda column: detect(t)
    english, german = K.language_instructions(seen), K.language_instructions(seen, "de")
    no = lambda c: F.coalesce(c, F.lit(False))
    return table(spark, sf_dir, "documents").select(
        "doc_id", no(english["language:response_language"](t, "de")).alias("german"), no(english["change_case:english_capital"](F.upper(t))).alias("capital"),
        no(german["change_case:english_lowercase"](F.lower(t))).alias("lowercase"),
    )


WORDS = r"""WITH p AS (SELECT doc_id, regexp_extract_all(replace(coalesce(text, ''), chr(1), ' '), '[^ 	-
]+[ 	-
]*') AS l FROM documents),
c AS (SELECT doc_id, l, list_transform(l, lambda x: regexp_replace(regexp_replace(x, '[ 	-
]+$', ''), '^["''(\[{“‘«]+|["'')\]}”’»]+$', '', 'g')) AS w FROM p),
u AS (SELECT doc_id, w[i] AS w, w[i - 1] AS before FROM (SELECT *, unnest(range(1, len(w) + 1)) AS i FROM c)),
v AS (SELECT lower(regexp_replace(w, '\.$', '')) AS type, regexp_matches(w, '(^|[^.])\.$') AS stop FROM u WHERE regexp_matches(w, '\p{L}')),
n AS (SELECT type, count(*) FILTER (stop) AS k, count(*) AS n FROM v GROUP BY type), t AS (SELECT sum(k) / sum(n) AS p FROM n),
a AS (SELECT type, k AS stopped, n - k AS plain, round(-2 * (k * ln(p) + (n - k) * ln(greatest(1 - p, 1e-9)) - k * ln(0.99) - (n - k) * ln(1 - 0.99)) * exp(-length(replace(type, '.', ''))) * (1 + length(type) - length(replace(type, '.', ''))) * pow(length(replace(type, '.', ''))::DOUBLE, k - n), 6) AS score FROM n, t WHERE k > 0)
"""


@query("abbreviation_scores", WORDS + "SELECT type, stopped, plain::BIGINT AS plain, score FROM a")
def abbreviation_scores(spark, sf_dir):
    return N.abbreviation_scores(N.type_counts(table(spark, sf_dir, "documents"), "text"))


TITLES = ", ".join(f"('{t}')" for t in N.TITLES)
STARTERS = WORDS + rf""", ab AS (SELECT type FROM a WHERE score >= 0.3 AND stopped >= 5 UNION SELECT * FROM (VALUES {TITLES})),
e AS (SELECT lower(regexp_replace(w, '\.$', '')) AS type, coalesce(regexp_matches(before, '[?!]$') OR (regexp_matches(before, '(^|[^.])\.$') AND NOT regexp_matches(before, '^\p{{L}}\.$') AND lower(regexp_replace(before, '\.$', '')) NOT IN (SELECT type FROM ab)), false) AS start FROM u),
f AS (SELECT type, count(*) FILTER (start) AS k, count(*) AS n FROM e WHERE regexp_matches(type, '\p{{L}}') GROUP BY type), g AS (SELECT sum(k) AS s, sum(n) AS w FROM f),
h AS (SELECT f.*, s, w, n / w AS p0, least(greatest(k / s, 1e-12), 1 - 1e-12) AS p1, least(greatest((n - k) / (w - s), 1e-12), 1 - 1e-12) AS p2 FROM f, g WHERE k > 0 AND k * w > n * s),
st AS (SELECT type, k AS starts, n AS uses, round(-2 * (k * ln(p0) + (s - k) * ln(1 - p0) + (n - k) * ln(p0) + (w - s - n + k) * ln(1 - p0) - k * ln(p1) - (s - k) * ln(1 - p1) - (n - k) * ln(p2) - (w - s - n + k) * ln(1 - p2)), 6) AS score FROM h),
sv AS (SELECT type FROM st WHERE score >= 30 AND starts >= 5)
"""


@query("learned_sentences", STARTERS + r""", x AS (SELECT doc_id, i, l[i] AS piece, w[i] AS w, w[i + 1] AS f FROM (SELECT *, unnest(range(1, len(w) + 1)) AS i FROM c)),
y AS (SELECT doc_id, i, CASE WHEN regexp_matches(w, '[?!]$') THEN true WHEN NOT ends_with(w, '.') THEN false WHEN f IS NULL THEN false WHEN NOT regexp_matches(w, '(^|[^.])\.$') THEN regexp_matches(f, '^\p{Lu}')
 WHEN regexp_matches(w, '^\p{L}\.$') OR lower(regexp_replace(w, '\.$', '')) IN (SELECT type FROM ab) THEN regexp_matches(f, '^\p{Lu}') AND lower(regexp_replace(f, '\.$', '')) IN (SELECT type FROM sv)
 ELSE NOT regexp_matches(f, '^\p{Ll}') END AS ends, length(piece) AS n, i = max(i) OVER (PARTITION BY doc_id) AS last FROM x),
z AS (SELECT doc_id, count(*) FILTER (ends OR last) AS sentences FROM y GROUP BY doc_id)
SELECT doc_id, coalesce(sentences, 0)::INTEGER AS sentences, coalesce(sentences, 0) >= 5 AS five FROM documents LEFT JOIN z USING (doc_id)""")
def learned_sentences(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    abbreviations, starters = N.learn_all(docs)
    docs = N.with_starters(docs, "text", abbreviations, starters, "known")
    split = lambda t: N.split_sentences(t, N.SentenceModel(abbreviations, F.col("known")))
    five = K.with_models(split)["length_constraints:number_sentences"](F.col("text"), 5, "at least")
    return docs.select("doc_id", F.size(split(F.col("text"))).alias("sentences"), F.coalesce(five, F.lit(False)).alias("five"))
