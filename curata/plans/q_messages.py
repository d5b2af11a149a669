"""Queries: message lists, their rendering, rewriting and filters."""

from __future__ import annotations

from pyspark.sql import functions as F

from curata.operators import filters as X
from curata.operators import messages as M
from curata.operators import toolcalls as C
from curata.plans.catalogue import query
from curata.sources.tables import conversation_messages, table


def _messages(spark, sf_dir):
    return conversation_messages(table(spark, sf_dir, "conversations"))


CONV = """
WITH c AS (SELECT conv_id, list({'role': role, 'content': text} ORDER BY turn, role, text) AS m FROM conversations GROUP BY conv_id)
"""
CAP = "upper(x.role[1]) || x.role[2:]"


@query("conversation_messages", CONV + "SELECT conv_id, len(m) AS turns, md5(array_to_string(list_transform(m, lambda x: x.role || chr(1) || x.content), chr(2))) AS digest FROM c")
def messages_digest(spark, sf_dir):
    joined = F.array_join(F.transform("messages", lambda m: F.concat(m["role"], F.lit("\x01"), m["content"])), "\x02")
    return _messages(spark, sf_dir).select("conv_id", F.size("messages").cast("long").alias("turns"), F.md5(joined).alias("digest"))


@query("raw_prompt", CONV + "SELECT conv_id, array_to_string(list_transform(m, lambda x: x.role || ': ' || x.content), chr(10)) AS prompt FROM c")
def raw_prompt(spark, sf_dir):
    return _messages(spark, sf_dir).select("conv_id", M.raw_prompt(F.col("messages")).alias("prompt"))


def _rendered(name: str, template: str, sql: str, generate: bool = False) -> None:
    @query(name, CONV + f"SELECT conv_id, {sql} AS text FROM c")
    def render(spark, sf_dir):
        return _messages(spark, sf_dir).select("conv_id", M.render(F.col("messages"), template, generate=generate).alias("text"))


_rendered("chat_render_space", "space", "array_to_string(list_transform(m, lambda x: x.content), ' ') || '</s>'")
_rendered("chat_render_line", "line", "array_to_string(list_transform(m, lambda x: x.content), chr(10))", True)
_rendered("chat_render_chat", "chat", f"array_to_string(list_transform(m, lambda x: {CAP} || ': ' || x.content), chr(10) || chr(10)) || '</s>'")
_rendered("chat_render_assistant", "assistant", "array_to_string(list_transform(list_filter(m, lambda x: x.role = 'assistant'), lambda x: x.content), '')")
_rendered(
    "chat_render_tags_eos", "tags_eos",
    "array_to_string(list_transform(m, lambda x: '<|' || x.role || '|>' || chr(10) || x.content || '</s>' || chr(10)), '') || '<|assistant|>' || chr(10)",
    True,
)
_rendered(
    "chat_render_tags", "tags",
    "array_to_string(list_transform(m, lambda x, i: '<|' || x.role || '|>' || chr(10) || x.content || CASE WHEN x.role <> 'assistant' THEN chr(10) WHEN i = len(m) THEN '</s>' ELSE '</s>' || chr(10) END), '')",
)


@query("messages_text", CONV + f"SELECT conv_id, array_to_string(list_transform(list_filter(m, lambda x: x.content <> ''), lambda x: {CAP} || ': ' || replace(replace(replace(replace(x.content, '<think>', chr(10)), '</think>', ''), '<answer>', chr(10) || chr(10)), '</answer>', '')), chr(10) || chr(10)) AS text FROM c")
def messages_text(spark, sf_dir):
    return _messages(spark, sf_dir).select("conv_id", M.messages_text(F.col("messages")).alias("text"))


@query("system_prompt_override", CONV + "SELECT conv_id, len(o) AS turns, o[1].role AS first_role, o[1].content AS first, o[2].role AS second_role FROM (SELECT conv_id, list_concat([{'role': 'system', 'content': 'Be brief.'}], CASE WHEN m[1].role = 'system' THEN m[2:] ELSE m END) AS o FROM c)")
def system_prompt_override(spark, sf_dir):
    o = _messages(spark, sf_dir).select("conv_id", M.system_override(F.col("messages"), "Be brief.").alias("o"))
    return o.select("conv_id", F.size("o").cast("long").alias("turns"), F.col("o")[0]["role"].alias("first_role"), F.col("o")[0]["content"].alias("first"), F.try_element_at("o", F.lit(2))["role"].alias("second_role"))


@query("last_turn_split", CONV + "SELECT conv_id, CASE WHEN len(m) > 1 THEN len(m) - 1 ELSE len(m) END AS prompt_turns, m[-1].role AS last_role, m[-1].content AS last FROM c")
def last_turn_split(spark, sf_dir):
    prompt, last = M.prompt_and_last(F.col("messages"))
    return _messages(spark, sf_dir).select("conv_id", F.size(prompt).cast("long").alias("prompt_turns"), last["role"].alias("last_role"), last["content"].alias("last"))


@query("alternating_roles", CONV + "SELECT conv_id, len(m) AS turns FROM c WHERE len(m) > 0 AND len(list_filter(list_transform(m, lambda x, i: x.role = CASE WHEN i % 2 = 1 THEN 'user' ELSE 'assistant' END), lambda b: NOT b)) = 0")
def alternating_roles(spark, sf_dir):
    return _messages(spark, sf_dir).where(M.alternates(F.col("messages"))).select("conv_id", F.size("messages").cast("long").alias("turns"))


@query("empty_message_filter", CONV + r"SELECT conv_id FROM c WHERE len(list_filter(m, lambda x: x.content IS NULL OR regexp_replace(x.content, '\s', '', 'g') = '')) = 0")
def empty_message_filter(spark, sf_dir):
    return _messages(spark, sf_dir).where(~X.has_empty_message(F.col("messages"))).select("conv_id")


@query("keyword_filter", CONV + f"SELECT conv_id FROM c WHERE len(list_filter(m, lambda x: x.role = 'assistant' AND regexp_matches(lower(x.content), '{X.keyword_pattern()}'))) = 0")
def keyword_filter(spark, sf_dir):
    return _messages(spark, sf_dir).where(~X.has_keyword(F.col("messages"))).select("conv_id")


_PROVIDERS = "|".join(f"(?:{p})" for p in X.provider_patterns()).replace("'", "''")


@query("provider_pattern_filter", CONV + f"SELECT conv_id FROM c WHERE len(list_filter(m, lambda x: x.role = 'assistant' AND (x.content IS NULL OR regexp_matches(x.content, '{_PROVIDERS}')))) = 0")
def provider_pattern_filter(spark, sf_dir):
    return _messages(spark, sf_dir).where(~X.names_provider(F.col("messages"))).select("conv_id")


@query("cutoff_date_filter", f"SELECT conv_id, count(*) AS turns FROM conversations WHERE conv_id NOT IN (SELECT conv_id FROM conversations WHERE regexp_matches(text, '{X.CUTOFF}')) GROUP BY conv_id")
def cutoff_date_filter(spark, sf_dir):
    return X.without_cutoff(table(spark, sf_dir, "conversations"), "conv_id", "text").groupBy("conv_id").agg(F.count("*").alias("turns"))


@query("cutoff_mention_counts", f"SELECT source, sum(len(regexp_extract_all(text, '{X.CUTOFF}')))::BIGINT AS mentions FROM documents GROUP BY source")
def cutoff_mention_counts(spark, sf_dir):
    n = F.size(X.cutoff_mentions(F.col("text")))
    return table(spark, sf_dir, "documents").groupBy("source").agg(F.sum(n).alias("mentions"))


@query("cjk_ratio_filter", CONV + r"SELECT conv_id FROM (SELECT conv_id, list_filter(m, lambda x: x.role = 'assistant')[-1].content AS t FROM c) WHERE NOT coalesce(len(regexp_extract_all(t, '[\x{4e00}-\x{9fff}]')) > 0 AND len(regexp_extract_all(t, '[\x{4e00}-\x{9fff}]')) / length(t) >= 0.05, false)")
def cjk_ratio_filter(spark, sf_dir):
    return _messages(spark, sf_dir).where(~X.too_chinese(F.col("messages"))).select("conv_id")


@query("special_character_ratio", "SELECT doc_id, round(len(regexp_extract_all(text, '[éèêçàùñóíáöüäß]')) / length(text), 6) AS ratio FROM documents WHERE length(text) > 0")
def special_character_ratio(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").where(F.length("text") > 0)
    return docs.select("doc_id", F.round(F.regexp_count("text", F.lit("[éèêçàùñóíáöüäß]")) / F.length("text"), 6).alias("ratio"))


_COT = "CASE conv_id % 4 WHEN 0 THEN '<think>' || text || '</think>' || text WHEN 1 THEN '<think>' || text || '</think><answer>' || text || '</answer>' WHEN 2 THEN text || '</think>' ELSE text END"


def _cots(spark, sf_dir):
    """Answers in four shapes: with thinking, with thinking and answer, broken, plain."""
    turns = table(spark, sf_dir, "conversations").where("role = 'assistant'")
    return turns.select("conv_id", "turn", F.expr(_COT).alias("c"))


COTS = f"WITH a AS (SELECT conv_id, turn, {_COT} AS c FROM conversations WHERE role = 'assistant') "


@query("think_format_filter", COTS + r"SELECT conv_id, turn, regexp_matches(c, '(?s)\A<think>.*?</think>.*\z') AS thinks, regexp_matches(c, '(?s)\A<think>.*?</think><answer>.*?</answer>\z') AS answers FROM a")
def think_format_filter(spark, sf_dir):
    c = F.col("c")
    return _cots(spark, sf_dir).select("conv_id", "turn", X.is_thinking(c).alias("thinks"), X.is_thinking_answer(c).alias("answers"))


@query("answer_tags", COTS + """SELECT conv_id, turn, CASE WHEN ends_with(o, '</answer>') THEN o ELSE o || chr(10) || '</answer>' END AS tagged, replace(replace(c, '<answer>', ''), '</answer>', '') AS bare FROM (
SELECT *, CASE WHEN contains(b, '<answer>') THEN b ELSE replace(b, '</think>', '</think>' || chr(10) || '<answer>') END AS o FROM (
SELECT *, CASE WHEN contains(c, '</think>' || chr(10)) THEN c ELSE replace(c, '</think>', '</think>' || chr(10)) END AS b FROM a))""")
def answer_tags(spark, sf_dir):
    c = F.col("c")
    return _cots(spark, sf_dir).select("conv_id", "turn", M.add_answer_tags(c).alias("tagged"), M.remove_answer_tags(c).alias("bare"))


@query("thinking_ground_truth", COTS + "SELECT conv_id, turn, trim(string_split(c, '</think>')[-1]) AS truth, replace(replace(replace(replace(c, '<think>', chr(10)), '</think>', ''), '<answer>', chr(10) || chr(10)), '</answer>', '') AS plain FROM a")
def thinking_ground_truth(spark, sf_dir):
    c = F.col("c")
    return _cots(spark, sf_dir).select("conv_id", "turn", M.thinking_ground_truth(c).alias("truth"), M.without_special_tokens(c).alias("plain"))


@query("toxic_language_filter", "SELECT d.doc_id, d.source FROM documents d WHERE lower(lang) = 'en' AND NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id AND l.toxic = 1)")
def toxic_language_filter(spark, sf_dir):
    docs = X.not_toxic(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return X.in_language(docs, "en").select("doc_id", "source")


@query("kept_percent_by_language", "SELECT lang, count(*) AS rows, sum((coalesce(toxic, 0) = 0)::INT)::BIGINT AS kept, round(100.0 * avg((coalesce(toxic, 0) = 0)::INT), 4) AS kept_percent FROM documents LEFT JOIN labels USING (doc_id) GROUP BY lang")
def kept_percent_by_language(spark, sf_dir):
    ok = (F.coalesce("toxic", F.lit(0)) == 0).cast("int")
    joined = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    return joined.groupBy("lang").agg(F.count("*").alias("rows"), F.sum(ok).alias("kept"), F.round(100.0 * F.avg(ok), 4).alias("kept_percent"))


@query("length_filter", r"SELECT doc_id FROM documents WHERE len(list_filter(string_split_regex(text, '[ \t-\r]+'), lambda w: w <> '')) <= 256")
def length_filter(spark, sf_dir):
    from curata.functions.native import words

    return X.within_length(table(spark, sf_dir, "documents"), F.size(words(F.col("text"))), 256).select("doc_id")


@query("pair_filter", CONV + """, p AS (SELECT conv_id, m, CASE WHEN conv_id % 3 = 0 THEN m[1:-2] ELSE list_append(m[1:-2], {'role': 'assistant', 'content': 'No.'}) END AS r FROM c)
SELECT conv_id, len(r) AS turns FROM p WHERE len(list_filter(m, lambda x: trim(x.content) = '')) = 0 AND m[-1].role = 'assistant' AND r[-1].role = 'assistant'""")
def pair_filter(spark, sf_dir):
    m = F.col("messages")
    head = F.slice(m, 1, F.greatest(F.size(m) - 1, F.lit(0)))
    rejected = F.when(F.col("conv_id") % 3 == 0, head).otherwise(F.array_append(head, M.message("assistant", F.lit("No."))))
    return _messages(spark, sf_dir).where(X.ends_with_answer(m, rejected)).select("conv_id", F.size(rejected).cast("long").alias("turns"))


@query("pass_rate_band", "SELECT user_id, count(*) AS total, sum((value > 50)::INT)::BIGINT AS correct, round(avg((value > 50)::INT), 6) AS pass_rate FROM events GROUP BY user_id HAVING avg((value > 50)::INT) BETWEEN 0.25 AND 0.75")
def pass_rate_band(spark, sf_dir):
    scores = table(spark, sf_dir, "events").withColumn("score", F.coalesce((F.col("value") > 50).cast("int"), F.lit(0)))
    return X.in_pass_band(scores, "user_id", "score", 0.25, 0.75).withColumn("pass_rate", F.round("pass_rate", 6))


@query("pairwise_expansion", "SELECT a.conv_id, a.turn AS i, b.turn AS j, md5(a.text || chr(1) || b.text) AS pair FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND a.turn < b.turn WHERE a.role = 'assistant' AND b.role = 'assistant'")
def pairwise_expansion(spark, sf_dir):
    answers = table(spark, sf_dir, "conversations").where("role = 'assistant'")
    return M.pairwise(answers, "conv_id", "turn", "text").select("conv_id", "i", "j", F.md5(F.concat("a", F.lit("\x01"), "b")).alias("pair"))


@query("reference_interleave", """WITH a AS (SELECT conv_id, turn, text FROM conversations WHERE role = 'assistant'), r AS (SELECT conv_id, arg_min(text, turn) AS text FROM conversations GROUP BY conv_id)
SELECT conv_id, (turn + 1)::INT AS position, md5(text) AS digest, false AS is_reference FROM a UNION ALL SELECT conv_id, 0, md5(text), true FROM r WHERE conv_id IN (SELECT conv_id FROM a)""")
def reference_interleave(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations")
    refs = turns.groupBy("conv_id").agg(F.min_by("text", "turn").alias("text"))
    out = M.with_reference(turns.where("role = 'assistant'").select("conv_id", "turn", "text"), refs, "conv_id", "turn", "text")
    return out.select("conv_id", F.col("position").cast("int").alias("position"), F.md5("text").alias("digest"), "is_reference")


@query("turn_span_deletion", CONV + "SELECT conv_id, len(list_filter(m, lambda x, i: NOT (i - 1 >= 1 AND i - 1 < 3))) AS turns FROM c")
def turn_span_deletion(spark, sf_dir):
    spans = F.array(F.struct(F.lit(1).alias("start"), F.lit(3).alias("stop")))
    return _messages(spark, sf_dir).select("conv_id", F.size(M.without_spans(F.col("messages"), spans)).cast("long").alias("turns"))


@query("instruction_converter", f"""SELECT conv_id, turn, CASE WHEN turn % 2 = 0 THEN '{M.INSTRUCTION}### Instruction:' || chr(10) || text || chr(10) || chr(10) || '### Response:'
ELSE '{M.WITH_INPUT}### Instruction:' || chr(10) || text || chr(10) || chr(10) || '### Input:' || chr(10) || role || chr(10) || chr(10) || '### Response:' END AS prompt FROM conversations""")
def instruction_converter(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.col("text").alias("instruction"), F.when(F.col("turn") % 2 == 1, F.col("role")).alias("input"), F.lit("").alias("output"))
    return M.to_messages(rows).select("conv_id", "turn", F.col("messages")[0]["content"].alias("prompt"))


@query("speaker_converter", CONV + "SELECT conv_id, array_to_string(list_transform(m, lambda x: x.role), ',') AS roles FROM c")
def speaker_converter(spark, sf_dir):
    back = F.create_map(F.lit("user"), F.lit("human"), F.lit("assistant"), F.lit("gpt"), F.lit("system"), F.lit("system"))
    named = F.transform("messages", lambda m: F.struct(F.element_at(back, m["role"]).alias("from"), m["content"].alias("value")))
    rows = _messages(spark, sf_dir).select("conv_id", named.alias("conversations"))
    return M.to_messages(rows).select("conv_id", F.array_join(F.transform("messages", lambda m: m["role"]), ",").alias("roles"))


@query("transcript_parser", CONV + "SELECT conv_id, len(m) AS turns, md5(array_to_string(list_transform(m, lambda x: trim(x.content, ' ')), chr(2))) AS digest FROM c WHERE m[1].role = 'user'")
def transcript_parser(spark, sf_dir):
    rows = _messages(spark, sf_dir).where(F.col("messages")[0]["role"] == "user")
    name = F.transform("messages", lambda m, i: F.concat(F.when(F.pmod(i, F.lit(2)) == 0, "\n\nHuman: ").otherwise("\n\nAssistant: "), m["content"]))
    parsed = M.transcript_messages(F.array_join(name, ""))
    return rows.select("conv_id", parsed.alias("p")).select("conv_id", F.size("p").cast("long").alias("turns"), F.md5(F.array_join(F.transform("p", lambda m: m["content"]), "\x02")).alias("digest"))


@query("conversation_chunks", """WITH RECURSIVE p AS (
  SELECT conv_id, (turn - s) // 2 AS k, sum(len(list_filter(string_split(text, ' '), lambda w: w <> '')) + 6)::BIGINT AS cost, count(*) AS n
  FROM (SELECT *, min(turn) OVER (PARTITION BY conv_id) AS s FROM conversations) GROUP BY ALL),
q AS (SELECT * FROM p WHERE n = 2),
f AS (SELECT conv_id, k, cost, CASE WHEN cost > 160 THEN NULL ELSE 0 END AS chunk, CASE WHEN cost > 160 THEN 0 ELSE cost END AS size, 0 AS top FROM q WHERE k = 0
  UNION ALL SELECT q.conv_id, q.k, q.cost,
    CASE WHEN q.cost > 160 THEN NULL WHEN f.size + q.cost > 160 OR f.chunk IS NULL THEN f.top + 1 ELSE f.chunk END,
    CASE WHEN q.cost > 160 THEN 0 WHEN f.size + q.cost > 160 THEN q.cost ELSE f.size + q.cost END,
    CASE WHEN q.cost > 160 THEN f.top WHEN f.size + q.cost > 160 OR f.chunk IS NULL THEN f.top + 1 ELSE f.top END
  FROM f JOIN q ON q.conv_id = f.conv_id AND q.k = f.k + 1)
SELECT conv_id, count(DISTINCT chunk) AS chunks, count(chunk) AS pairs FROM f GROUP BY conv_id""")
def conversation_chunks(spark, sf_dir):
    tokens = lambda c: F.size(F.filter(F.split(c, " "), lambda w: w != ""))
    rows = _messages(spark, sf_dir).where(F.size("messages") >= 2)
    out = rows.select("conv_id", M.chunked(F.col("messages"), 160, tokens).alias("c"))
    pairs = F.aggregate("c", F.lit(0), lambda a, x: a + (F.size(x) / 2).cast("int"))
    return out.select("conv_id", F.size("c").cast("long").alias("chunks"), pairs.cast("long").alias("pairs"))


NODES = """WITH RECURSIVE n AS (SELECT e.event_id AS id, CASE WHEN e.event_id >= 40 THEN (e.event_id - 40) // 3 END AS parent_id,
  coalesce(value, 0) AS quality, event_id % 11 = 5 AS deleted FROM events e),
k AS (SELECT id, parent_id FROM (SELECT *, row_number() OVER (PARTITION BY parent_id ORDER BY quality DESC, id) AS r FROM n WHERE NOT deleted) WHERE parent_id IS NULL OR r <= 2),
p AS (SELECT id, [id] AS path FROM k WHERE parent_id IS NULL UNION ALL SELECT k.id, list_append(p.path, k.id) FROM p JOIN k ON k.parent_id = p.id)
SELECT id AS leaf_id, len(path) AS depth, array_to_string(path, '>') AS path FROM p WHERE id NOT IN (SELECT parent_id FROM k WHERE parent_id IS NOT NULL)"""


@query("tree_paths", NODES)
def tree_paths(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    nodes = e.select(F.col("event_id").alias("id"), F.expr("case when event_id >= 40 then (event_id - 40) div 3 end").alias("parent_id"), F.lit("").alias("text"), F.coalesce("value", F.lit(0)).alias("quality"), (F.col("event_id") % 11 == 5).alias("deleted"))
    return M.tree_paths(nodes, 2).select("leaf_id", F.size("path").cast("long").alias("depth"), F.array_join(F.transform("path", lambda x: x.cast("string")), ">").alias("path"))


@query("multiple_choice", """WITH q AS (SELECT p_partkey, [p_brand, p_type, p_name] AS c FROM part), o AS (SELECT p_partkey, c[2] AS correct, list_transform(list_sort(list_transform(c, lambda x: {'k': lower(x), 'c': x})), lambda s: s.c) AS o FROM q)
SELECT p_partkey, array_to_string(list_transform(o, lambda c, i: chr((64 + i)::INT) || ') ' || c), chr(10)) AS options, chr((64 + list_position(o, correct))::INT) AS letter FROM o""")
def multiple_choice(spark, sf_dir):
    rows = table(spark, sf_dir, "part").select("p_partkey", M.multiple_choice(F.array("p_brand", "p_type", "p_name"), F.col("p_type")).alias("q"))
    return rows.select("p_partkey", "q.options", "q.letter")


@query("numbered_quotes", "SELECT n_regionkey, array_to_string(list_transform(list(n_name ORDER BY n_name), lambda q, i: i || '. ' || q), chr(10) || chr(10)) AS quotes FROM nation GROUP BY n_regionkey")
def numbered_quotes(spark, sf_dir):
    rows = table(spark, sf_dir, "nation").groupBy("n_regionkey").agg(F.sort_array(F.collect_list("n_name")).alias("q"))
    return rows.select("n_regionkey", M.numbered_quotes(F.col("q")).alias("quotes"))


@query("few_shot_prompt", "SELECT r_regionkey, 'Name it.' || chr(10) || chr(10) || 'Input: 0' || chr(10) || 'Output: AFRICA' || chr(10) || chr(10) || 'Input: ' || r_regionkey || chr(10) || 'Output:' AS prompt FROM region")
def few_shot_prompt(spark, sf_dir):
    shot = F.array(F.struct(F.lit("0").alias("input"), F.lit("AFRICA").alias("output")))
    return table(spark, sf_dir, "region").select("r_regionkey", M.few_shot(F.lit("Name it."), shot, F.col("r_regionkey").cast("string")).alias("prompt"))


@query("hash_mark_answer", "SELECT doc_id, trim(string_split(text || '#### ' || n_chars, '####')[2]) AS truth FROM documents")
def hash_mark_answer(spark, sf_dir):
    text = F.concat("text", F.lit("#### "), F.col("n_chars").cast("string"))
    return table(spark, sf_dir, "documents").select("doc_id", M.answer_after(text, "####").alias("truth"))


@query("unknown_tools", "SELECT event_id, event_type AS tool FROM events WHERE event_type NOT IN (SELECT event_type FROM events GROUP BY event_type ORDER BY event_type LIMIT 3)")
def unknown_tools(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    names = events.select(F.col("event_type").alias("name")).distinct().orderBy("name").limit(3)
    return M.unknown_tools(events.select("event_id", F.array("event_type").alias("tools")), names, "event_id", "tools")


@query("pruned_tools", """WITH t AS (SELECT n_regionkey, list({'name': n_name, 'size': length(n_name)} ORDER BY n_name) AS t, list(n_name ORDER BY n_name)[1:2] AS used FROM nation GROUP BY n_regionkey)
SELECT n_regionkey, array_to_string(list_transform(list_filter(t, lambda x: list_contains(used, x.name)), lambda x: x.name), ',') AS kept FROM t""")
def pruned_tools(spark, sf_dir):
    rows = table(spark, sf_dir, "nation").groupBy("n_regionkey").agg(F.sort_array(F.collect_list("n_name")).alias("names"))
    tools = F.transform("names", lambda n: F.struct(n.alias("name"), F.length(n).alias("size")))
    kept = M.pruned_tools(tools, F.slice("names", 1, 2))
    return rows.select("n_regionkey", F.array_join(F.transform(kept, lambda t: t["name"]), ",").alias("kept"))


_FUNCTION_TURNS = r"""WITH m AS (SELECT conv_id, turn, role, coalesce(text, '') AS text, max(turn) OVER (PARTITION BY conv_id) AS last, bool_or(role = 'system') OVER (PARTITION BY conv_id) AS led FROM conversations WHERE turn > 0 OR conv_id % 2 = 0),
t AS (SELECT *, '<|im_start|>' || role || chr(10) || text || CASE role
 WHEN 'system' THEN CASE WHEN turn % 2 = 0 THEN ' <functions>f' || turn || '</functions>' ELSE ' You do not currently have access to any functions. <functions></functions>' END || '<|im_end|>' || chr(10)
 WHEN 'user' THEN CASE WHEN turn % 2 = 0 THEN chr(10) || '<functions>f' || turn || '</functions>' ELSE '' END || '<|im_end|>' || chr(10)
 WHEN 'assistant' THEN CASE WHEN turn % 3 = 0 THEN '<function_calls>g' || turn || '</function_calls>' ELSE '' END || CASE WHEN turn = last THEN '</s>' ELSE '<|im_end|>' || chr(10) END END AS s FROM m)
SELECT conv_id, CASE WHEN bool_or(led) THEN '' ELSE '<|im_start|>system' || chr(10) || 'Help.<|im_end|>' || chr(10) END || string_agg(s, '' ORDER BY turn) || '<|im_start|>assistant' || chr(10) || '<think>' AS chat FROM t GROUP BY conv_id"""


@query("chat_render_functions", _FUNCTION_TURNS)
def chat_render_functions(spark, sf_dir):
    """Turns that offer functions and answers that call them; every second conversation without its first turn."""
    turns = table(spark, sf_dir, "conversations").where("turn > 0 or conv_id % 2 = 0")
    offered = F.when(F.col("turn") % 2 == 0, F.concat(F.lit("f"), F.col("turn").cast("string")))
    called = F.when(F.col("turn") % 3 == 0, F.concat(F.lit("g"), F.col("turn").cast("string")))
    one = F.struct("role", F.col("text").alias("content"), offered.alias("functions"), called.alias("function_calls"))
    lists = turns.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", one.alias("m")))).alias("t"))
    return lists.select("conv_id", M.render_functions(F.transform("t", lambda x: x["m"]), "Help.", generate=True, opened="<think>").alias("chat"))


# tool calls

SEARCH = {"function": {"name": "search", "parameters": {"required": ["query"], "properties": {"query": {}, "top": {}}}}}
RUN = {"function": {"name": "run", "parameters": {"properties": {"code": {}}}}}
_SAID = "'<think>' || text || '</think>' || CASE conv_id % 3 WHEN 0 THEN '<search>' || turn || ' ' || text || '</search> and <run>x = ' || turn || '</run>' WHEN 1 THEN '<run>' || text || '</run><search>' || conv_id || '</search>' ELSE '<search>open' END"
_ROWS = "SELECT conv_id * 1000 + turn AS k, conv_id, turn, replace(replace(text, '<', ' '), chr(92), ' ') AS text FROM conversations WHERE text IS NOT NULL"


def _turns(spark, sf_dir):
    said = F.replace(F.replace("text", F.lit("<"), F.lit(" ")), F.lit("\\"), F.lit(" "))
    return table(spark, sf_dir, "conversations").where("text is not null").select((F.col("conv_id") * 1000 + F.col("turn")).alias("k"), "conv_id", "turn", said.alias("text"))


@query("tagged_tool_calls", f"""WITH r AS ({_ROWS}), c AS (
SELECT k, 0 AS number, 'search' AS name, 'query' AS parameter, turn || ' ' || text AS argument FROM r WHERE conv_id % 3 = 0 UNION ALL SELECT k, 1, 'run', 'code', 'x = ' || turn FROM r WHERE conv_id % 3 = 0
UNION ALL SELECT k, 0, 'run', 'code', text FROM r WHERE conv_id % 3 = 1 UNION ALL SELECT k, 1, 'search', 'query', conv_id::VARCHAR FROM r WHERE conv_id % 3 = 1)
SELECT k, number, name, parameter, argument FROM c""")
def tagged_tool_calls(spark, sf_dir):
    """Two calls of two tools in an answer, in either order, or one that is not closed."""
    said = _turns(spark, sf_dir).withColumn("said", F.expr(_SAID))
    rows = C.call_rows(said, "k", C.tagged_calls(F.col("said"), [SEARCH, RUN]))
    one = F.from_json("arguments", "map<string,string>")
    return rows.select("k", "number", "name", F.map_keys(one)[0].alias("parameter"), F.map_values(one)[0].alias("argument"))


@query("json_tool_calls", f"""WITH r AS ({_ROWS}) SELECT k, CASE k % 6 WHEN 1 THEN NULL WHEN 2 THEN NULL WHEN 3 THEN 'fly' ELSE 'search' END AS name,
CASE k % 6 WHEN 0 THEN NULL WHEN 1 THEN 'no JSON object' WHEN 2 THEN 'no name' WHEN 3 THEN 'unknown tool' WHEN 4 THEN 'arguments are no object' ELSE 'no argument query' END AS error,
CASE WHEN k % 6 = 0 THEN turn::VARCHAR END AS query FROM r""")
def json_tool_calls(spark, sf_dir):
    """One call in each answer, good or bad in one of five ways."""
    forms = ["{'name': 'search', 'arguments': {'query': '#'}}", "{'name': 'search', 'arg", "{'arguments': {'query': '#'}}", "{'name': 'fly', 'arguments': {}}", "{'name': 'search', 'arguments': [1]}", "{'name': 'search', 'arguments': {'top': 3}}"]
    chosen = F.element_at(F.array(*(F.lit(f.replace("'", '"')) for f in forms)), (F.col("k") % 6 + 1).cast("int"))
    said = _turns(spark, sf_dir).withColumn("said", F.concat(F.col("text"), F.lit("<tool_call>\n"), F.replace(chosen, F.lit("#"), F.col("turn").cast("string")), F.lit("\n</tool_call> done")))
    rows = C.call_rows(said, "k", C.json_calls(F.col("said"), [SEARCH, RUN]))
    return rows.select("k", "name", "error", F.when(F.col("error").isNull(), F.get_json_object("arguments", "$.query")).alias("query"))


@query("rendered_call_spans", r"""WITH t AS (SELECT conv_id, turn, role, coalesce(text, '') AS text, role = 'assistant' AND turn % 2 = 1 AS calls FROM conversations),
w AS (SELECT conv_id, turn, role, len(regexp_extract_all('<|im_start|>' || role || chr(10), '\S+')) AS head, len(regexp_extract_all(text || CASE WHEN calls THEN chr(10) || '<tool_call>' || chr(10) || turn || chr(10) || '</tool_call>' ELSE '' END || ' <|im_end|>', '\S+')) AS body FROM t),
s AS (SELECT conv_id, role, sum(head + body) OVER (PARTITION BY conv_id ORDER BY turn) - body AS start, sum(head + body) OVER (PARTITION BY conv_id ORDER BY turn) AS finish FROM w)
SELECT conv_id, least(max(finish), 120)::BIGINT AS tokens, (max(finish) > 120) AS cut, coalesce(sum(least(finish, 120) - start) FILTER (role = 'assistant' AND start < 120), 0)::BIGINT AS trainable, count(*) FILTER (role = 'assistant' AND start < 120) AS spans FROM s GROUP BY conv_id""")
def rendered_call_spans(spark, sf_dir):
    """Words as tokens, 120 of them at most; odd answers call a tool. What counts for training is what assistants wrote."""
    one = F.struct("role", F.col("text").alias("content"), F.when((F.col("role") == "assistant") & (F.col("turn") % 2 == 1), F.array(F.col("turn").cast("string"))).alias("calls"))
    turns = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", one.alias("m")))).alias("t"))
    words = lambda t: F.regexp_extract_all(t, F.lit(r"[^ \t-\r]+"), 0)
    made = turns.select("conv_id", C.rendered(F.transform("t", lambda x: x["m"]), end=" <|im_end|>\n").alias("r"))
    made = made.select("conv_id", F.size(words(F.col("r.text"))).alias("n"), C.token_spans(F.col("r.text"), F.col("r.spans"), words, 120).alias("s"))
    total = F.aggregate("s", F.lit(0).cast("long"), lambda a, x: a + x["finish"] - x["start"])
    return made.select("conv_id", F.least("n", F.lit(120)).cast("long").alias("tokens"), (F.col("n") > 120).alias("cut"), total.alias("trainable"), F.size("s").cast("long").alias("spans"))
