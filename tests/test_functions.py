"""Expression-level cases: verifiers, LaTeX, judges, constraints, messages, filters, packing, repetition."""

import pytest
from pyspark.sql import functions as F

from curata.functions import constraints as K
from curata.functions import latex as L
from curata.functions import verifiers as V
from curata.functions.text import normalize_answer
from curata.operators import filters as X
from curata.operators import messages as M
from curata.operators import mixing, repetition, sequences
from curata.sources import tables


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first()[0]


@pytest.mark.parametrize(
    ("prediction", "label", "score"),
    [("The answer is 10.", "10", 1.0), ("so 1,234 in all", "1234", 1.0), ("1,2,3,4", "34", 1.0), ("none", "3", 0.0), ("it is -1.5", "-1.5", 1.0), ("it is -3", "3", 1.0)],
)
def test_last_number(spark, prediction, label, score):
    assert value(spark, V.grade_school(F.lit(prediction), F.lit(label))) == score


@pytest.mark.parametrize(
    ("text", "normal"), [("The  Cat's, a hat!", "cats hat"), ("An apple", "apple"), ("étan an ané", "étan ané"), ("", "")]
)
def test_normalize_answer(spark, text, normal):
    assert value(spark, normalize_answer(F.lit(text))) == normal


def test_f1(spark):
    f = value(spark, V.token_f1(F.lit("hello world hello"), F.lit("hello there hello")))
    assert round(f.f1, 6) == round(2 / 3, 6)
    assert value(spark, V.token_f1(F.lit(""), F.lit("x"))).f1 == 0.0
    assert value(spark, V.best_f1(F.lit("<think>no</think>hello"), F.array(F.lit("bye"), F.lit("hello")))) == 1.0


def test_search_scores(spark):
    assert value(spark, V.search_f1(F.lit("<finish>x</finish>"), F.array(F.lit("y")))) == 0.1
    assert value(spark, V.search_f1(F.lit("x"), F.array(F.lit("x")))) == 0.0
    assert value(spark, V.search_match(F.lit("a <Finish> The X </finish>"), F.array(F.lit("x")))) == 1.0


def test_lengths(spark):
    assert value(spark, V.length_closeness(F.lit(300), F.lit("100"), 100.0)) == -1.0
    assert value(spark, V.up_to_length(F.lit(50), F.lit("100"), 100.0)) == 1.0


def test_code_and_rubric(spark):
    r = F.array(F.lit(1), F.lit(0), F.lit(1), F.lit(1))
    assert value(spark, V.code_pass_rate(r)) == 0.75
    assert value(spark, V.code_pass_rate(r, threshold=0.8)) == 0.0
    assert value(spark, V.rubric(F.array(F.lit(2), F.lit(2)), F.array(F.lit(1.0), F.lit(-1.0)))) == 0.0
    assert value(spark, V.rubric(F.expr("cast(array() as array<int>)"), F.expr("cast(array() as array<double>)"))) == 0.0


@pytest.mark.parametrize(
    ("text", "score"), [("4/5", 0.8), ("80%", 0.8), ("about .5", 0.5), ("Yes", 1.0), ("nope", 0.0), ("incorrect", 1.0), ("3/0 x", 3.0)]
)
def test_judge_score(spark, text, score):
    assert value(spark, V.judge_score(F.lit(text))) == pytest.approx(score)


def test_json_scores(spark):
    assert value(spark, V.json_judge_score(F.lit('```json\n{"SCORE": "7"}\n```'), 10)) == 0.7
    assert value(spark, V.json_judge_score(F.lit('{"REASONING": "a "b"", "SCORE": 3}'))) == 3.0
    assert value(spark, V.json_judge_score(F.lit("nothing"))) == 0.0
    assert value(spark, V.first_json(F.lit('x {"a": {"b": 1}} y }'))) == '{"a": {"b": 1}}'
    assert value(spark, V.code_block(F.lit("a ```x``` b ```py\ny\n```"))) == "y\n"


@pytest.mark.parametrize(
    ("text", "box"),
    [(r"so \boxed{\frac{1}{2}} and", r"\frac{1}{2}"), (r"\boxed{1} then \boxed{2}", "2"), (r"\fbox{x}", "x"), (r"\boxed 7$ ok", "7"), ("none", None), (r"\boxed{open", None)],
)
def test_boxed(spark, text, box):
    assert value(spark, L.boxed(F.lit(text))) == box


@pytest.mark.parametrize(
    ("answer", "normal"),
    [("x = 10", "10"), ("10 dollars", "10"), ("100,000", "100000"), (r"\frac12", r"\frac{1}{2}"), (r"\sqrt3", r"\sqrt{3}"), (r"$\text{5 units}$", "5")],
)
def test_normal_answer(spark, answer, normal):
    assert value(spark, L.normal_answer(F.lit(answer))) == normal


@pytest.mark.parametrize(
    ("a", "b", "same"),
    [("1/2", r"\frac{1}{2}", True), ("0.5", r"\frac12", True), ("x=3", "3", True), (r"\dfrac{1}{3}", r"\tfrac13", True), (".7", "0.7", True), (r"5\text{ cm}", "5", True), ("2", "3", False)],
)
def test_equal_forms(spark, a, b, same):
    assert value(spark, L.equal_forms(F.lit(a), F.lit(b))) is same


def test_math_score(spark):
    for text in (r"so \boxed{4}", "Final Answer: The final answer is 4. I hope it is correct.", "we get $x$ and $4$", "4"):
        assert value(spark, L.math_score(F.lit(text), F.lit("4"))) == 1.0, text
    assert value(spark, L.math_score(F.lit(r"\boxed{5} or $4$"), F.lit("4"))) == 0.0


CASES = [
    ("verify_keywords", "Hello World", {"keyword_list": ["hello", "WORLD"]}, True),
    ("verify_keyword_frequency", "a b a, A.", {"word": "a", "N": 3}, True),
    ("validate_forbidden_words", "all good", {"forbidden_words": ["bad"]}, True),
    ("verify_letter_frequency", "hello", {"letter": "l", "N": 2}, True),
    ("verify_paragraph_count", "one\n* * *\ntwo", {"N": 2}, True),
    ("verify_paragraph_count", "one\n* * *\n", {"N": 2}, False),
    ("validate_word_constraint", "a b c", {"N": 3, "quantifier": "around"}, True),
    ("verify_sentence_constraint", "One is. Two? Three.", {"N": 3, "quantifier": "at least"}, True),
    ("validate_paragraphs", "One x\n\nTwo y", {"N": 2, "first_word": "Two", "i": 2}, True),
    ("verify_postscript", "x P.S. y", {"postscript_marker": "P.S."}, True),
    ("verify_postscript", "x P.S.", {"postscript_marker": "P.S."}, False),
    ("validate_placeholders", "[a] and [b]", {"N": 2}, True),
    ("verify_bullet_points", "* a\n- b\nc", {"N": 2}, True),
    ("validate_title", "<<t>>", {}, True),
    ("validate_choice", "yes", {"options": ["yes please"]}, True),
    ("validate_highlighted_sections", "*a* *b*", {"N": 2}, True),
    ("validate_sections", "S 1 S 2", {"N": 2, "section_splitter": "S"}, True),
    ("validate_json_format", '{"a": 1}', {}, True),
    ("validate_json_format", "{a", {}, False),
    ("validate_two_responses", "a ****** b", {}, True),
    ("validate_frequency_capital_words", "AB c D", {"N": 2, "quantifier": "at most"}, True),
    ("validate_quotation", '"a"', {}, True),
]


@pytest.mark.parametrize(("name", "text", "args", "ok"), CASES)
def test_constraint(spark, name, text, args, ok):
    assert value(spark, K.FUNCTIONS[name](F.lit(text), **args)) is ok


INSTRUCTIONS = [
    ("keywords:no_adjacent_consecutive", "cat dog", {}, False),
    ("keywords:no_adjacent_consecutive", "cat fog", {}, True),
    ("copy:repeat_phrase", "the big cat then the red cat", {"phrase": "the old cat", "small_n": 2}, True),
    ("copy:repeat_phrase", "the old cat then the old cat", {"phrase": "the old cat", "small_n": 2}, False),
    ("paragraphs:paragraphs", "a *** b", {}, True),
    ("paragraphs:paragraphs", "a *** *** b", {}, False),
    ("paragraphs:paragraphs2", "a\n\nb\n\n", {}, True),
    ("length_constraints:nth_paragraph_first_word", "One.\n\n'Two, x", {"num_paragraphs": 2, "nth_paragraph": 2, "first_word": "two"}, True),
    ("detectable_format:number_highlighted_sections", "*a* **b** **", {"num_highlights": 2}, True),
    ("detectable_format:bigram_wrapping", "<<a b>> <<c d>> e", {}, True),
    ("detectable_format:square_brackets", "[a] [b]", {}, True),
    ("copy:copying_multiple", "a b******A B", {"prompt": "a b", "n": 2}, True),
    ("copy:copy_span_idx", " ell ", {"prompt": "hello", "n_start": 1, "n_end": 4}, True),
    ("first_word:first_word_sent", "The a. the b!", {"first_word": "the"}, True),
    ("last_word:last_word_sent", "a end. b end!", {"last_word": "end"}, True),
    ("count:counting_composition", "A b. C d.***A b. C d.***A b. C d.", {"n_sent": 2, "n_words": 3}, True),
    ("keywords:keyword_specific_position", "A b. C d.", {"keyword": "d", "n": 2, "m": 2}, True),
    ("count:count_unique", "a b c", {}, True),
    ("combination:two_responses", "a******b", {}, True),
    ("detectable_content:postscript", "x\np. s. y", {"postscript_marker": "P.S."}, True),
    ("detectable_format:title", "<< >>", {}, False),
    ("startend:quotation", '"', {}, False),
]


@pytest.mark.parametrize(("name", "text", "args", "ok"), INSTRUCTIONS)
def test_instruction(spark, name, text, args, ok):
    assert value(spark, K.INSTRUCTIONS[name](F.lit(text), **args)) is ok


def messages(*turns):
    return F.array(*(M.message(r, F.lit(c)) for r, c in turns))


def test_keyword_and_provider_filters(spark):
    assert value(spark, X.has_keyword(messages(("user", "OpenAI"), ("assistant", "fine")))) is False
    assert value(spark, X.has_keyword(messages(("assistant", "I am from openai.")))) is True
    yes = ["I'm Claude, an AI assistant made by Anthropic.", "As a language model trained by OpenAI, no.", "I am Gemini today.", "It was developed by the people of Cohere!", "That is against OpenAI's policy here."]
    for text in yes:
        assert value(spark, X.names_provider(messages(("assistant", text)))) is True, text
    assert value(spark, X.names_provider(messages(("assistant", "Claude Monet painted.")))) is False
    assert value(spark, X.names_provider(messages(("user", yes[0])))) is False


def test_cutoff_mentions(spark):
    hits = value(spark, X.cutoff_mentions(F.lit("As of my last update in April 2023 and knowledge cutoff 2021; last updated in May 2020.")))
    assert hits == ["As of my last update in April 2023", "knowledge cutoff 2021", "last updated in May 2020"]


def test_think_formats(spark):
    assert value(spark, X.is_thinking(F.lit("<think>a\nb</think> c"))) is True
    assert value(spark, X.is_thinking(F.lit(" <think>a</think>"))) is False
    assert value(spark, X.is_thinking_answer(F.lit("<think>a</think><answer>b</answer>"))) is True
    assert value(spark, X.is_thinking_answer(F.lit("<think>a</think><answer>b</answer> "))) is False
    assert value(spark, M.add_answer_tags(F.lit("<think>a</think>b"))) == "<think>a</think>\n<answer>\nb\n</answer>"


def test_cjk(spark):
    assert value(spark, X.too_chinese(messages(("assistant", "好" + "a" * 9)))) is True
    assert value(spark, X.too_chinese(messages(("assistant", "好" + "a" * 99)))) is False


def test_unknown_speaker_raises(spark):
    turns = F.array(F.struct(F.lit("robot").alias("from"), F.lit("x").alias("value")))
    with pytest.raises(Exception, match="unknown speaker"):
        value(spark, M.from_turns(turns))


def test_chunks(spark):
    m = messages(*[("user", "a b"), ("assistant", "c")] * 3)
    out = value(spark, M.chunked(m, 30, lambda c: F.size(F.split(c, " "))))
    assert [len(c) for c in out] == [4, 2]
    assert value(spark, M.chunked(m, 10, lambda c: F.size(F.split(c, " ")))) == []


def test_mixer_amounts():
    counts = {"a": 100, "b": 10}
    assert mixing.mixer_amounts(["a", "1", "b", "0.5"], counts) == {"a": 1, "b": 5}
    assert mixing.mixer_amounts(["a", "1", "b", "0.5"], counts, "share") == {"a": 100, "b": 5}
    with pytest.raises(ValueError, match="mixed"):
        mixing.mixer_amounts(["a", "5", "b", "0.5"], counts, "share")
    with pytest.raises(ValueError, match="negative"):
        mixing.mixer_amounts(["a", "-1"], counts)


def test_resample_counts(spark):
    df = spark.range(10).withColumn("s", F.lit("x"))
    targets = spark.createDataFrame([("x", 23)], "s string, target long")
    out = mixing.resampled(df, "s", targets, "id")
    assert out.count() == 23 and sorted(r["count"] for r in out.groupBy("id").count().collect()) == [2] * 7 + [3] * 3


def test_gae_matches_loop(spark):
    values, rewards = [0.5, -0.2, 0.3, 0.9], [0.0, 1.0, 0.0, 2.0]
    last, expect = 0.0, []
    for t in reversed(range(4)):
        delta = rewards[t] + 0.9 * (values[t + 1] if t < 3 else 0.0) - values[t]
        last = delta + 0.9 * 0.8 * last
        expect.insert(0, last)
    got = value(spark, sequences.gae(F.array(*map(F.lit, values)), F.array(*map(F.lit, rewards)), 0.9, 0.8))
    assert got == pytest.approx(expect)
    assert value(spark, sequences.gae(F.expr("cast(array() as array<double>)"), F.expr("cast(array() as array<double>)"), 0.9, 0.8)) == []


def plain_best_fit(lengths, size):
    """Room left in each pack, one document at a time."""
    room = []
    for n in sorted(lengths, reverse=True):
        fits = [k for k, r in enumerate(room) if r >= n]
        if fits:
            room[min(fits, key=lambda k: room[k])] -= n
        else:
            room.append(max(size, n) - n)
    return sorted(room)


def test_best_fit_patterns():
    import random

    from curata.operators import packing

    rng = random.Random(3)
    for _ in range(200):
        size = rng.randint(5, 60)
        lengths = [rng.randint(1, size + 5) for _ in range(rng.randint(1, 80))]
        patterns = packing.best_fit_patterns({n: lengths.count(n) for n in set(lengths)}, size)
        room = sorted(max(size, max(n for n, _ in p)) - sum(n * t for n, t in p) for p, k in patterns for _ in range(k))
        assert room == plain_best_fit(lengths, size)


def test_best_fit_places(spark):
    import random

    from curata.operators import packing

    rng = random.Random(5)
    rows = [("a" if rng.random() < 0.7 else "b", i, rng.choice([0, 3, 5, 8, 13, 30])) for i in range(300)]
    out = packing.best_fit(spark.createDataFrame(rows, "g string, i long, n long"), "g", "i", "n", 20).collect()
    assert sorted((r.g, r.i, r.n) for r in out) == sorted(rows)
    for g in "ab":
        packs = {}
        for r in out:
            if r.g == g and r.n:
                packs.setdefault(r.pack, []).append((r.offset, r.n))
        for parts in packs.values():
            assert all(b[0] == a[0] + a[1] for a, b in zip(sorted(parts), sorted(parts)[1:], strict=False)) and min(parts)[0] == 0
        assert sorted(max(20, max(n for _, n in p)) - sum(n for _, n in p) for p in packs.values()) == plain_best_fit([n for x, _, n in rows if x == g and n], 20)


def test_select_packs(spark):
    from curata.operators import packing

    rows = [(i, 50 + i * 37 % 101) for i in range(400)]
    df = spark.createDataFrame(rows, "i long, n long")
    got = packing.select_packs(df, "i", "n", 40, 5000, 3, sequences.priority(1, F.col("i"))).collect()
    assert len({r.i for r in got}) == len(got) == 40 and abs(sum(r.n for r in got) - 5000) <= 3
    first = {r.i for r in df.orderBy(sequences.priority(1, F.col("i"))).limit(40).collect()}
    assert len(first & {r.i for r in got}) >= 20
    assert {r.i for r in packing.select_packs(df, "i", "n", 40, 0, 10**9, sequences.priority(1, F.col("i"))).collect()} == first


def test_fitted_messages(spark):
    def plain(messages, budget):
        size = lambda t: len(t.split(" "))
        kept = [m for m in messages if m[0] == "system"]
        used = sum(2 * size(c) + 4 for _, c in kept)
        for role, content in messages:
            if role == "system":
                continue
            if used + size(content) + 3 <= budget:
                used += size(content) + 3
                kept.append((role, content))
            else:
                room = budget - used - 3
                return kept + ([(role, " ".join(content.split(" ")[:room]))] if room > 0 else [])
        return kept

    rows = [[("system", "be brief"), ("user", "a b c d e"), ("assistant", "f g h i j k l m"), ("user", "n")], [("user", "a " * 30)], [("user", "x"), ("assistant", "y z")]]
    df = spark.createDataFrame([(i, [{"role": r, "content": c} for r, c in m]) for i, m in enumerate(rows)], "i long, m array<struct<role:string,content:string>>")
    for budget in (5, 16, 22, 100):
        out = df.select("i", sequences.fitted_messages(F.col("m"), lambda c: F.size(F.split(c, " ")), budget).alias("f")).collect()
        assert {r.i: [tuple(m) for m in r.f] for r in out} == {i: plain(m, budget) for i, m in enumerate(rows)}


def test_spans_and_padding(spark):
    mask = F.array(*map(F.lit, [False, True, True, False, True]))
    assert [tuple(s) for s in value(spark, sequences.mask_spans(mask))] == [(1, 3), (4, 5)]
    assert value(spark, sequences.padded(F.array(F.lit(1), F.lit(2)), 4, 0)) == [1, 2, 0, 0]
    assert value(spark, sequences.unpacked(F.array(*map(F.lit, [1, 2, 3])), F.array(F.lit(1), F.lit(2)))) == [[1], [2, 3]]
    assert value(spark, sequences.first_true(F.array(F.lit(False), F.lit(False)))) == 2


def flags(spark, text, **limits):
    df = spark.createDataFrame([(1, text)], "id int, text string")
    return repetition.repetition_flags(df, "id", "text", **limits).first()


def test_repetition_rule(spark):
    limits = {"least": 3, "least_sentences": 6, "least_run": 2}
    assert flags(spark, "a fine long paragraph\n\n" * 3, **limits).reason == "paragraph_repeated_3x"
    assert flags(spark, "a fine long paragraph\n\nanother thing\n\n" * 3, **limits).has_repetition is False
    assert flags(spark, "Blue cats run. " * 2 + "Red dogs swim.", **limits).reason == "line_repeated_2x_consecutive"
    assert flags(spark, "No way at all. " * 4, **limits).reason == "line_repeated_4x_consecutive_short_phrase"
    assert flags(spark, "import numpy as tool\n\n" * 9, **limits).has_repetition is False
    assert flags(spark, None, **limits).has_repetition is False


def test_splitters(spark):
    assert value(spark, repetition.paragraphs(F.lit("a\n\n \n\nb "))) == ["a", "b"]
    assert value(spark, repetition.sentences(F.lit("a. b?! c"))) == ["a", "b", "c"]
    assert value(spark, repetition.is_formula(F.lit("12 + 3"))) is True
    assert value(spark, repetition.is_statement(F.lit("return x"))) is True
    assert value(spark, repetition.is_list(F.lit("1. a\n2. b"))) is True


def test_transform_names(spark):
    from curata.operators import transforms

    df = spark.createDataFrame([(1, [("user", "a b"), ("assistant", "c")], "x")], "i long, messages array<struct<role:string,content:string>>, tools string")
    out = transforms.run_transforms(df, ["sft_tulu_tokenize_and_truncate_v1", "sft_tulu_filter_v1"], [{"max_length": 4}, {}], ["input_ids", "labels"]).first()
    assert list(out.asDict()) == ["input_ids", "labels", "tools"] and len(out.input_ids) == 4
    assert [x != -100 for x in out.labels] == [False, False, False, True]
    with pytest.raises(ValueError, match="no row is left"):
        transforms.run_transforms(df, ["sft_tulu_tokenize_and_truncate_v1", "sft_tulu_filter_v1"], [{"max_length": 2}, {}])
    with pytest.raises(ValueError, match="unknown transforms"):
        transforms.run_transforms(df, ["none"])
    names = ["sft_tokenize_v1", "sft_filter_v1"]
    assert transforms.config_hash(names) != transforms.config_hash(["sft_tokenize_mask_out_prompt_v1", "sft_filter_v1"])


def test_unknown_speaker_and_converter(spark):
    with pytest.raises(ValueError, match="no converter"):
        M.to_messages(spark.range(1))


def test_file_shards(spark, tmp_path):
    import hashlib

    from curata.sources import tables

    data = bytes(range(256)) * 10
    (tmp_path / "x.bin").write_bytes(data)
    rows = tables.split_digests(spark, str(tmp_path), 1000).orderBy("shard").collect()
    assert [r.shard_sha256 for r in rows] == [hashlib.sha256(data[i : i + 1000]).hexdigest() for i in range(0, 2560, 1000)]
    assert {r.file_sha256 for r in rows} == {hashlib.sha256(data).hexdigest()}


def test_ranks_and_sums_keep_nulls(spark):
    """Null groups, ids and orders are ranked and summed like others."""
    rows = [(None, 1, 10), (None, 2, 20), ("a", 3, None), ("a", None, 5), ("a", 9000, 7), ("b", 4, 1)]
    df = spark.createDataFrame(rows, "source string, id long, size long")
    ranked = mixing.ranked_by_hash(df, ["source"], "id").collect()
    assert sorted((str(r.source), r.place) for r in ranked) == [("None", 0), ("None", 1), ("a", 0), ("a", 1), ("a", 2), ("b", 0)]
    first = mixing.first_by_hash(df, ["source"], 1, "id").collect()
    assert {(r.source, r.id) for r in first} == {(r.source, r.id) for r in ranked if r.place == 0}
    got = {(r.source, r.id): r.begin for r in tables.running_total(df, "id", "size", group=["source"]).collect()}
    assert got == {(None, 1): 0, (None, 2): 10, ("a", None): 0, ("a", 3): 5, ("a", 9000): 5, ("b", 4): 0}


def test_mixing_keeps_clashing_columns(spark):
    """Columns named like those inside come out with the values that they went in with."""
    names = ["order_key", "deal", "before", "size", "whole", "rest", "target", "n", "place", "curata_order", "curata_plan", "bucket", "base", "one"]
    rows = [(i, "ab"[i % 2], *(f"{n}{i}" for n in names)) for i in range(60)]
    df = spark.createDataFrame(rows, ["id", "source", *names])
    want = {r.id: [r[n] for n in names] for r in df.collect()}
    targets = spark.createDataFrame([("a", 70), ("b", 11)], "source string, target long")
    out = mixing.resampled(df, "source", targets, "id").collect()
    assert len(out) == 81 and all([r[n] for n in names] == want[r.id] for r in out)
    first = mixing.first_by_hash(df, ["source"], 5, "id").collect()
    assert len(first) == 10 and all([r[n] for n in names if n != "place"] == [v for n, v in zip(names, want[r.id], strict=True) if n != "place"] for r in first)
    numbered = mixing.numbered(df, "id").collect()
    assert [r["index"] for r in sorted(numbered)] == list(range(60)) and all([r[n] for n in names] == want[r.id] for r in numbered)


@pytest.mark.parametrize(
    ("text", "valid"),
    [('{"a": [1, 2]}', True), (" 12 ", True), ('"x"', True), ("4537960215852590 Thinthen oror", False), ("1,2", False), ("1],[2", False), ('1,"x"]', False), ('{"a": 1} {"b": 2}', False), ("12 -", False), ("", False)],
)
def test_json_is_the_whole_text(spark, text, valid):
    assert value(spark, K.FUNCTIONS["validate_json_format"](F.lit(text))) is valid
    assert value(spark, K.INSTRUCTIONS["detectable_format:json_format"](F.lit(text))) is valid


def test_tree_result_joins_nothing(spark):
    """Every level is joined and written once; the result only reads, so no task holds the joins of all levels."""
    rows = [(i, (i - 1) // 2 if i else None, f"t{i}", float(i % 3), i == 5) for i in range(40)]
    paths = M.tree_paths(spark.createDataFrame(rows, "id long, parent_id long, text string, quality double, deleted boolean"), 2)
    assert "Join" not in paths._jdf.queryExecution().executedPlan().toString()
    got = {r.leaf_id: r.path for r in paths.collect()}
    assert got[31] == [0, 1, 3, 7, 15, 31] and got[30] == [0, 2, 6, 14, 30]
    assert not {5, 11, 23, 24} & got.keys() and paths.columns == ["leaf_id", "path", "texts"]


def test_f1_of_many_repeats(spark):
    """Runs of words that begin alike, on one side or both, against multisets."""
    from collections import Counter

    pairs = [("b b ab abc ab 0 1", "b ab ab b b 1 c"), ("", ""), ("x", ""), ("", "x"), ("é é ñ", "ñ é"), ("ab ab ab", "ab"), ("0 0 1", "1 1 0")]
    rows = spark.createDataFrame(pairs, "p string, g string").select("p", "g", V.token_f1(F.col("p"), F.col("g")).alias("f")).collect()
    for r in rows:
        p, g = r.p.split(), r.g.split()
        same = sum((Counter(p) & Counter(g)).values())
        assert (round(r.f.precision, 9), round(r.f.recall, 9)) == ((round(same / len(p), 9), round(same / len(g), 9)) if same else (0.0, 0.0)), r


def test_answer_is_read_once(spark):
    """Search scores name the pattern of the answer once, however many labels use it."""
    plan = lambda c: spark.range(1).select(F.lit("x").alias("p"), F.array(F.lit("a"), F.lit("b")).alias("g")).select(c.alias("v"))._jdf.queryExecution().analyzed().toString()
    assert plan(V.search_match(F.col("p"), F.col("g"))).count("<finish>") == 1
    assert plan(V.search_f1(F.col("p"), F.col("g"))).count("array_max") == 1


WORD_CHECKS = [
    ("length_constraints:number_words", {"num_words": 3, "relation": "at least"}, lambda t, ws, ts: len(ws) >= 3),
    ("letters:letter_counting", {"n": 4, "relation": "less than"}, lambda t, ws, ts: sum(c.isascii() and c.isalpha() for c in t) < 4),
    ("count:lowercase_counting", {"n": 2}, lambda t, ws, ts: sum(w.isascii() and w.isalpha() and w.islower() for w in ws) <= 2),
    ("change_case:capital_word_frequency", {"capital_frequency": 2, "capital_relation": "at least"}, lambda t, ws, ts: sum(w == w.upper() != w.lower() for w in ts) >= 2),
    ("keywords:start_end", {}, lambda t, ws, ts: len(ts) > 1 and ts[0].lower() == ts[-1].lower()),
    ("count:count_unique", {}, lambda t, ws, ts: len(set(ts)) == len(ts)),
    ("keywords:palindrome", {}, lambda t, ws, ts: any(w == w[::-1] for w in t.split())),
]


def test_checks_of_words(spark):
    """Odd and long texts against plain Python; counts make no array of all words or letters of a text."""
    import random
    import unicodedata
    from itertools import groupby

    draw = random.Random(5)
    parts = ["a", "b", "ab", "A", "AB", "The", "aba", " ", " ", "\n", "é", "É", "Ⓐ", "Ⅷ", "²", "中", "𝐀", "𐐀", "😀", "1", "_", ".", "-"]
    texts = ["".join(draw.choice(parts) for _ in range(draw.choice((0, 1, 2, 3, 5, 9, 40)))) for _ in range(400)]
    numbered = " ".join(f"w{i}" for i in range(400))
    texts += [numbered, numbered + " w3", numbered[:512] + "5", "a" * 300_000, "É" * 300_000, "A." * 100_000, " " * 300_000 + "x"]

    def tokens(t):
        kind = lambda c: "W" if c == "_" or unicodedata.category(c)[0] in "LN" else "S" if c in " \n" else "M"
        runs = [(k, "".join(g)) for k, g in groupby(t, kind)]
        return [w for k, r in runs if k == "W" for w in [r]], [w for k, r in runs if k != "S" for w in ([r] if k == "W" else r)]

    t = F.col("t")
    checks = [K.INSTRUCTIONS[name](t, **args) for name, args, _ in WORD_CHECKS]
    rows = spark.createDataFrame([(x,) for x in texts], "t string").select(t, *(c.alias(f"c{i}") for i, c in enumerate(checks))).collect()
    for r in rows:
        ws, ts = tokens(r.t)
        assert list(r)[1:] == [plain(r.t, ws, ts) for *_, plain in WORD_CHECKS], r.t[:80]
    frame = spark.createDataFrame([("",)], "t string")
    for check in [*checks[:3], checks[4], K.FUNCTIONS["validate_frequency_capital_words"](t, N=2, quantifier="at least")]:
        assert "regexp_extract_all" not in frame.select(check)._jdf.queryExecution().analyzed().toString()
