"""Queries: tokenising transforms, templates, converters, sources and sinks, tools, groups and metrics."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from curata.functions import latex as L
from curata.functions import verifiers as V
from curata.operators import filters as X
from curata.operators import messages as M
from curata.operators import pairs as P
from curata.operators import stats as S
from curata.operators import transforms as T
from curata.operators.sequences import MASKED
from curata.plans.catalogue import query
from curata.plans.q_messages import CONV
from curata.runtime import checkpoint_root
from curata.sources import tables as B
from curata.sources.tables import conversation_messages, table

#: Ids of a text as the default tokenizer gives them: a checksum of each word. DuckDB has no crc32, so queries compare
#: the words themselves through another tokenizer.
WORDS = r"list_filter(string_split_regex({0}, '[ \t-\r]+'), lambda w: w <> '')"


def as_words(text):
    """A tokenizer that keeps the words as they are."""
    from curata.functions.native import words

    return words(text)


def _messages(spark, sf_dir):
    return conversation_messages(table(spark, sf_dir, "conversations"))


def _tags(m: str) -> str:
    return f"array_to_string(list_transform({m}, lambda x, i: CASE WHEN x.role IN ('system', 'user', 'assistant') THEN '<|' || x.role || '|>' || chr(10) || x.content || CASE WHEN x.role <> 'assistant' THEN chr(10) WHEN i = len({m}) THEN '</s>' ELSE '</s>' || chr(10) END ELSE '' END), '')"


PROMPT = "CASE WHEN len(m) > 1 THEN m[1:-2] ELSE m END"
ENCODED = CONV + f""", e AS (SELECT conv_id, m, {WORDS.format(_tags('m'))} AS ids, {WORDS.format(f"p_text || '<|assistant|>' || chr(10)")} AS prompt
FROM (SELECT conv_id, m, {_tags('p')} AS p_text FROM (SELECT conv_id, m, {PROMPT} AS p FROM c)))
"""
JOINED = "md5(array_to_string({0}, chr(1)))"


def digest(c):
    return F.md5(F.array_join(F.transform(c, lambda x: x.cast("string")), "\x01"))


@query("sft_tokenized", ENCODED + f"SELECT conv_id, {JOINED.format('ids')} AS ids, {JOINED.format('prompt')} AS prompt, len(ids) AS ones FROM e")
def sft_tokenized(spark, sf_dir):
    rows = T.sft_tokenize(_messages(spark, sf_dir), tokenize=as_words)
    return rows.select("conv_id", digest(F.col("input_ids")).alias("ids"), digest(F.col("input_ids_prompt")).alias("prompt"), F.size("attention_mask").cast("long").alias("ones"))


@query("rlvr_tokenized", ENCODED + f"""SELECT conv_id, {JOINED.format("list_filter(prompt, lambda w: w <> 'the')")} AS prompt, 1 AS truths, array_to_string(list_transform({PROMPT}, lambda x: x.role || ': ' || x.content), chr(10)) AS raw FROM e WHERE len(list_filter(prompt, lambda w: w <> 'the')) <= 200""")
def rlvr_tokenized(spark, sf_dir):
    rows = _messages(spark, sf_dir).withColumns({"ground_truth": F.lit("42"), "dataset": F.lit("gsm8k")})
    tokenize = lambda t: F.filter(as_words(t), lambda w: w != "the")
    out = T.rlvr_max_prompt(T.rlvr_tokenize(rows, tokenize=tokenize), 200)
    return out.select("conv_id", digest(F.col("input_ids_prompt")).alias("prompt"), F.size("ground_truth").alias("truths"), F.col("prompt").alias("raw"))


PAIRS = CONV + f""", q AS (SELECT conv_id, m AS chosen, list_append(m[1:-2], {{'role': 'assistant', 'content': 'No.'}}) AS rejected FROM c WHERE m[-1].role = 'assistant'),
t AS (SELECT conv_id, {WORDS.format(_tags('chosen'))} AS c, {WORDS.format(_tags('rejected'))} AS r, {WORDS.format(_tags('chosen[1:-2]') + " || '<|assistant|>' || chr(10)")} AS p FROM q)
"""


def _pairs(spark, sf_dir):
    m = F.col("messages")
    rows = _messages(spark, sf_dir).where(F.try_element_at(m, F.lit(-1))["role"] == "assistant")
    rejected = F.array_append(F.slice(m, 1, F.greatest(F.size(m) - 1, F.lit(0))), M.message("assistant", F.lit("No.")))
    return rows.select("conv_id", m.alias("chosen"), rejected.alias("rejected"))


@query("preference_tokenized", PAIRS + f"SELECT conv_id, {JOINED.format('p')} AS prompt, {JOINED.format('c')} AS chosen, {JOINED.format('r')} AS rejected FROM t WHERE len(p) <= 150 AND len(c) <= 250 AND len(r) <= 250")
def preference_tokenized(spark, sf_dir):
    rows = T.preference_filter(T.preference_tokenize(_pairs(spark, sf_dir), as_words), 150, 250)
    return rows.select("conv_id", digest(F.col("input_ids_prompt")).alias("prompt"), digest(F.col("chosen_input_ids")).alias("chosen"), digest(F.col("rejected_input_ids")).alias("rejected"))


TURN_IDS = r"""list_transform({0}, lambda x: list_filter(string_split_regex('<|' || x.role || '|>' || chr(10) || x.content, '[ \t-\r]+'), lambda w: w <> ''))"""


@query("preference_truncated", CONV + f""", q AS (SELECT conv_id, m AS chosen, list_append(m[1:-2], {{'role': 'assistant', 'content': 'No.'}}) AS rejected FROM c WHERE m[-1].role = 'assistant'),
t AS (SELECT conv_id, {TURN_IDS.format('chosen')} AS c, {TURN_IDS.format('rejected')} AS r FROM q),
l AS (SELECT conv_id, flatten(c)[1:120] AS ci, flatten(list_transform(c, lambda w, i: list_transform(w, lambda x: i = len(c))))[1:120] AS cl, flatten(r)[1:120] AS ri, flatten(list_transform(r, lambda w, i: list_transform(w, lambda x: i = len(r))))[1:120] AS rl FROM t)
SELECT conv_id, {JOINED.format('ci')} AS chosen, {JOINED.format("list_transform(cl, lambda b: b::INT)")} AS chosen_labels, {JOINED.format('ri')} AS rejected, {JOINED.format("list_transform(rl, lambda b: b::INT)")} AS rejected_labels FROM l WHERE list_contains(cl, true) AND list_contains(rl, true)""")
def preference_truncated(spark, sf_dir):
    """Words instead of ids; their labels are compared as masked or not."""
    import functools

    from curata.operators.sequences import turn_labels

    ids = functools.partial(turn_labels, longest=120, last_only=True)
    words_of = _pairs(spark, sf_dir)
    cut = T.preference_has_labels(T.preference_truncate(words_of, 120))
    texts = lambda side: F.slice(F.flatten(F.transform(side, lambda m: as_words(F.concat(F.lit("<|"), m["role"], F.lit("|>\n"), m["content"])))), 1, 120)
    flags = lambda c: digest(F.transform(c, lambda x: (x != MASKED).cast("int")))
    same = F.size(ids(F.col("chosen"))["input_ids"]) == F.size("chosen_input_ids")
    return cut.where(same).select(
        "conv_id", digest(texts("chosen")).alias("chosen"), flags("chosen_labels").alias("chosen_labels"), digest(texts("rejected")).alias("rejected"), flags("rejected_labels").alias("rejected_labels")
    )


@query("transform_pipeline", ENCODED + "SELECT conv_id, row_number() OVER (ORDER BY conv_id) - 1 AS index, len(ids) AS tokens, 'conversations' AS dataset_source FROM e WHERE len(ids) <= 300 AND len(prompt) < len(ids)")
def transform_pipeline(spark, sf_dir):
    """Tokenise, mask the prompt, filter, keep the target columns and number the rows, in one call."""
    rows = _messages(spark, sf_dir).withColumn("dataset_source", F.lit("conversations"))
    names = ["sft_tokenize_mask_out_prompt_v1", "sft_filter_v1"]
    out = T.run_transforms(rows, names, [{}, {"max_length": 300}], ["input_ids", "labels", "attention_mask"], "conv_id")
    return out.select("conv_id", "index", F.size("input_ids").cast("long").alias("tokens"), "dataset_source")


@query("chat_render_thinker", CONV + f"SELECT conv_id, {_tags('m')} || '<|assistant|>' || chr(10) || '<think>' AS text FROM c")
def chat_render_thinker(spark, sf_dir):
    return _messages(spark, sf_dir).select("conv_id", M.render(F.col("messages"), "thinker", generate=True).alias("text"))


THOUGHT = "list_transform(m, lambda x: {'role': x.role, 'content': CASE WHEN x.role = 'assistant' THEN '<think>hm</think>' || x.content ELSE x.content END})"


@query("chat_render_thinker_answer", CONV + f"SELECT conv_id, {_tags('m')} AS text FROM c")
def chat_render_thinker_answer(spark, sf_dir):
    said = F.transform("messages", lambda m: M.message(m["role"], F.when(m["role"] == "assistant", F.concat(F.lit("<think>hm</think>"), m["content"])).otherwise(m["content"])))
    return _messages(spark, sf_dir).select("conv_id", M.render(said, "thinker_answer").alias("text"))


@query("chat_render_turns", CONV + """SELECT conv_id, array_to_string(list_transform(m, lambda x, i: '<|im_start|>' || x.role || chr(10) || x.content || CASE WHEN x.role = 'assistant' AND i = len(m) THEN '</s>' ELSE '<|im_end|>' || chr(10) END), '') || '<|im_start|>assistant' || chr(10) AS text FROM c""")
def chat_render_turns(spark, sf_dir):
    return _messages(spark, sf_dir).select("conv_id", M.render(F.col("messages"), "turns", generate=True).alias("text"))


# converters

def _converter(name: str, columns: dict[str, str]) -> None:
    """A converter's columns, made of turns; the first non-assistant content and the last content of the result."""
    system = "'Be kind.'" if "system_prompt" in columns else "NULL"
    sql = f"SELECT conv_id, turn, {3 if 'system_prompt' in columns else 2} AS turns, {system} AS system, text AS question, role AS answer FROM conversations"

    @query(name, sql)
    def run(spark, sf_dir):
        rows = table(spark, sf_dir, "conversations").selectExpr("conv_id", "turn", *(f"{e} as {c}" for c, e in columns.items()))
        m = M.to_messages(rows).select("conv_id", "turn", F.col("messages").alias("m"))
        first = F.filter("m", lambda x: x["role"] == "system")
        return m.select(
            "conv_id", "turn", F.size("m").alias("turns"), F.get(first, F.lit(0))["content"].alias("system"),
            F.element_at("m", -2)["content"].alias("question"), F.element_at("m", -1)["content"].alias("answer"),
        )


_converter("query_answer_converter", {"query": "text", "answer": "role"})
_converter("query_response_converter", {"query": "text", "response": "role"})
_converter("prompt_completion_converter", {"prompt": "text", "completion": "role"})
_converter("system_question_converter", {"system_prompt": "'Be kind.'", "question": "text", "response": "role"})


@query("chosen_converter", CONV + "SELECT conv_id, array_to_string(list_transform(m, lambda x: x.role || chr(1) || x.content), chr(2)) AS said FROM c WHERE NOT (len(list_filter(m, lambda x: x.role = 'assistant' AND regexp_matches(lower(x.content), '" + X.keyword_pattern() + "'))) > 0)")
def chosen_converter(spark, sf_dir):
    rows = _messages(spark, sf_dir).withColumnRenamed("messages", "chosen")
    return M.converted(rows).select("conv_id", F.array_join(F.transform("messages", lambda m: F.concat(m["role"], F.lit("\x01"), m["content"])), "\x02").alias("said"))


@query("trajectory_pairs", CONV + "SELECT conv_id, len(m) + 1 AS turns, 'yes ' || conv_id AS chosen, 'no ' || conv_id AS rejected FROM c")
def trajectory_pairs(spark, sf_dir):
    i = F.col("conv_id").cast("string")
    good, bad = M.with_endings(F.col("messages"), F.concat(F.lit("yes "), i), F.concat(F.lit("no "), i))
    return _messages(spark, sf_dir).select("conv_id", F.size(good).cast("long").alias("turns"), F.element_at(good, -1)["content"].alias("chosen"), F.element_at(bad, -1)["content"].alias("rejected"))


@query("qa_verifiable_rows", "SELECT p_partkey, 'user' AS role, p_name AS question, '[\"' || p_brand || '\",\"' || p_type || '\"]' AS ground_truth, 're_search' AS dataset FROM part")
def qa_verifiable_rows(spark, sf_dir):
    rows = table(spark, sf_dir, "part").select("p_partkey", "p_name", F.array("p_brand", "p_type").alias("answers"))
    out = M.qa_rows(rows, "p_name", "answers", "re_search")
    return out.select("p_partkey", F.col("messages")[0]["role"].alias("role"), F.col("messages")[0]["content"].alias("question"), "ground_truth", "dataset")


@query("accepted_tests", "WITH g AS (SELECT user_id, list((value > 20)::INT ORDER BY event_id) AS r, list(event_id ORDER BY event_id) AS t FROM events GROUP BY user_id) SELECT user_id, list_sum(list_transform(t, lambda x, i: CASE WHEN r[i] = 1 THEN x ELSE 0 END))::BIGINT AS kept, coalesce(list_sum(r), 0)::BIGINT AS n FROM g WHERE coalesce(list_sum(r), 0) >= 0.8 * len(t)")
def accepted_tests(spark, sf_dir):
    rows = table(spark, sf_dir, "events").groupBy("user_id").agg(F.sort_array(F.collect_list(F.struct("event_id", (F.col("value") > 20).cast("int").alias("r")))).alias("x"))
    kept = rows.select("user_id", M.accepted_tests(F.col("x.r"), F.col("x.event_id")).alias("t")).where("t is not null")
    return kept.select("user_id", F.aggregate("t", F.lit(0).cast("long"), lambda a, x: a + x).alias("kept"), F.size("t").cast("long").alias("n"))


@query("all_tests_pass", "SELECT user_id FROM events GROUP BY user_id HAVING min(coalesce((value > 2)::INT, 0)) = 1")
def all_tests_pass(spark, sf_dir):
    rows = table(spark, sf_dir, "events").groupBy("user_id").agg(F.collect_list(F.coalesce((F.col("value") > 2).cast("int"), F.lit(0))).alias("r"))
    return rows.where(X.all_pass(F.col("r"))).select("user_id")


@query("runnable_code", "SELECT event_id FROM events WHERE event_type NOT IN ('click', 'view')")
def runnable_code(spark, sf_dir):
    code = F.when(F.col("event_type") == "click", "import subprocess").when(F.col("event_type") == "view", "eval(x)").otherwise("print(1)")
    return table(spark, sf_dir, "events").where(X.may_run(code)).select("event_id")


@query("tool_differences", "SELECT 'purchase' AS tool, 'rows' AS side FROM events WHERE event_type = 'purchase' GROUP BY 1 UNION ALL SELECT 'lonely', 'names'")
def tool_differences(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select("event_id", F.array("event_type").alias("tools"))
    names = rows.select(F.explode("tools").alias("name")).distinct().where("name <> 'purchase'").unionByName(spark.range(1).select(F.lit("lonely").alias("name")))
    return M.tool_differences(rows, names, "event_id", "tools")


@query("tools_to_fit", """WITH t AS (SELECT n_regionkey, list({'name': n_name, 'size': length(n_name)} ORDER BY n_name) AS t FROM nation GROUP BY n_regionkey)
SELECT n_regionkey, len(t) AS defined, (SELECT count(*) FROM range(len(t) + 1) k(d) WHERE list_sum(list_transform(t, lambda x, i: CASE WHEN i <= len(t) - d THEN x.size ELSE 0 END)) > 20)::BIGINT AS least_dropped FROM t""")
def tools_to_fit(spark, sf_dir):
    rows = table(spark, sf_dir, "nation").groupBy("n_regionkey").agg(F.sort_array(F.collect_list("n_name")).alias("names"))
    tools = F.transform("names", lambda n: F.struct(n.alias("name"), F.length(n).alias("size")))
    kept = M.pruned_to_fit(tools, F.expr("cast(array() as array<string>)"), lambda t: t["size"], 20)
    return rows.select("n_regionkey", F.size("names").cast("long").alias("defined"), (F.size("names") - F.size(kept)).cast("long").alias("least_dropped"))


# groups and metrics

@query("grouped_completions", "SELECT l_partkey AS k, list(l_linenumber ORDER BY l_orderkey * 10 + l_linenumber) AS l, list_sort((list(i ORDER BY md5('42:' || i)))[1:4]) AS s FROM (SELECT *, l_orderkey * 10 + l_linenumber AS i FROM lineitem) GROUP BY l_partkey".join(["SELECT k, array_to_string(l, ',') AS lines, array_to_string(s, ',') AS sampled FROM (", ")"]))
def grouped_completions(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("k"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("i"), "l_linenumber")
    joined = lambda c: F.array_join(F.transform(c, lambda x: x.cast("string")), ",")
    return P.grouped_completions(rows, "k", "i", ["l_linenumber"]).select("k", joined("l_linenumber").alias("lines"), joined("sampled").alias("sampled"))


@query("annotated_scores", "SELECT user_id, count(DISTINCT event_type) AS models, max(value) FILTER (event_type = 'click') AS reference_score FROM events GROUP BY user_id")
def annotated_scores(spark, sf_dir):
    best = table(spark, sf_dir, "events").groupBy("user_id", "event_type").agg(F.max("value").alias("v"))
    return P.annotated_scores(best, "user_id", "event_type", "v", "click").select("user_id", F.size("scores").cast("long").alias("models"), "reference_score")


@query("model_lists", "SELECT event_id, event_type FROM events WHERE event_type IN ('click', 'view', 'purchase') AND event_type <> 'view'")
def model_lists(spark, sf_dir):
    return P.of_models(table(spark, sf_dir, "events"), "event_type", ["click", "view", "purchase"], ["view"]).select("event_id", "event_type")


@query("valid_responses", "SELECT conv_id, turn FROM conversations WHERE trim(text) <> '' AND NOT contains(lower(text), 'the and')")
def valid_responses(spark, sf_dir):
    return table(spark, sf_dir, "conversations").where(P.is_valid_response(F.col("text"), ["The and"])).select("conv_id", "turn")


@query("merged_metrics", "SELECT event_type, round(avg(value), 6) AS mean, sum(user_id)::BIGINT AS joined, arg_max(props, event_id) FILTER (props IS NOT NULL) AS last FROM events GROUP BY event_type")
def merged_metrics(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select("event_type", "event_id", "value", F.array("user_id").alias("users"), "props")
    out = S.merged_metrics(rows, "event_type", "event_id", "value", "users", "props")
    return out.select("event_type", "mean", F.aggregate("joined", F.lit(0).cast("long"), lambda a, x: a + x).alias("joined"), "last")


@query("benchmark_averages", "SELECT metric, round(avg(x), 4) AS mean, round(sum(x * w) / sum(w), 4) AS weighted, count(x) AS runs FROM (SELECT l_linenumber AS w, unnest(['l_quantity', 'l_extendedprice']) AS metric, unnest([l_quantity::DOUBLE, l_extendedprice::DOUBLE]) AS x FROM lineitem) GROUP BY metric")
def benchmark_averages(spark, sf_dir):
    return S.benchmark_averages(table(spark, sf_dir, "lineitem"), ["l_quantity", "l_extendedprice"], "l_linenumber")


@query("sequence_logp", "SELECT vec_id, round(list_sum(list_transform(embedding, lambda x, i: CASE WHEN i % 4 <> 1 THEN x::DOUBLE ELSE 0.0 END)), 4) AS total, round(list_sum(list_transform(embedding, lambda x, i: CASE WHEN i % 4 <> 1 THEN x::DOUBLE ELSE 0.0 END)) / 48, 4) AS mean FROM embeddings")
def sequence_logp(spark, sf_dir):
    logps = F.transform("embedding", lambda x: x.cast("double"))
    labels = F.transform("embedding", lambda x, i: F.when(i % 4 == 0, F.lit(MASKED)).otherwise(i))
    e = table(spark, sf_dir, "embeddings")
    return e.select("vec_id", F.round(L.sequence_logp(logps, labels), 4).alias("total"), F.round(L.sequence_logp(logps, labels, True), 4).alias("mean"))


@query("kl_estimates", "SELECT event_id, round(d, 3) AS k1, round(d * d / 2, 3) AS k2, round(exp(-d) - 1 + d, 3) AS k3, round(exp(d) * d, 3) AS k4 FROM (SELECT event_id, value / 50 AS d FROM events WHERE value IS NOT NULL)")
def kl_estimates(spark, sf_dir):
    e = table(spark, sf_dir, "events").where("value is not null").select("event_id", L.kl_estimates(F.col("value") / 50).alias("k"))
    return e.select("event_id", *(F.round(f"k.{n}", 3).alias(n) for n in ("k1", "k2", "k3", "k4")))


@query("passthrough_score", "SELECT doc_id, 0.0::DOUBLE AS score FROM documents")
def passthrough_score(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", V.VERIFIERS["passthrough"](F.col("text"), F.array("text")).alias("score"))


@query("judge_decisions", "SELECT event_id, (event_id % 3 = 0)::INT::DOUBLE AS score FROM events")
def judge_decisions(spark, sf_dir):
    said = F.when(F.col("event_id") % 3 == 0, "So. FINAL decision: Yes").otherwise("Final decision: no")
    return table(spark, sf_dir, "events").select("event_id", V.final_decision(said).alias("score"))


# sources and sinks: written into the shared folder, read back and compared with what went in

def _folder(spark, name: str) -> str:
    return f"{checkpoint_root(spark)}/{name}-{uuid.uuid4().hex}"


TURNS = "SELECT conv_id, turn, role, text FROM conversations"


@query("jsonl_round_trip", TURNS)
def jsonl_round_trip(spark, sf_dir):
    """Compressed JSON lines, scanned by extension."""
    path = f"{_folder(spark, 'turns')}.jsonl"
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    rows.write.option("compression", "gzip").json(path)
    return B.scan(spark, path, schema="conv_id long, turn long, role string, text string").select("conv_id", F.col("turn").cast(rows.schema["turn"].dataType).alias("turn"), "role", "text")


@query("revision_scan", "SELECT conv_id, count(*) AS turns, 'abc123' AS revision FROM conversations GROUP BY conv_id")
def revision_scan(spark, sf_dir):
    path = _folder(spark, "revisions")
    for name in ("abc123", "other"):
        table(spark, sf_dir, "conversations").write.parquet(f"{path}/revision={name}")
    return B.scan(spark, path, revision="abc123").groupBy("conv_id", "revision").agg(F.count("*").alias("turns"))


@query("split_range_scan", "SELECT doc_id FROM documents ORDER BY doc_id LIMIT 100")
def split_range_scan(spark, sf_dir):
    """The first hundred rows along the id."""
    return B.scan(spark, f"{sf_dir}/documents.parquet", "train[:100]", order="doc_id").select("doc_id")


@query("several_files_scan", "SELECT count(*) AS rows, sum(doc_id)::BIGINT AS ids FROM documents")
def several_files_scan(spark, sf_dir):
    docs, path = table(spark, sf_dir, "documents").select("doc_id", "n_chars"), _folder(spark, "several")
    for k in range(2):
        docs.where(F.col("doc_id") % 2 == k).write.parquet(f"{path}/{k}")
    return B.scan(spark, [f"{path}/0", f"{path}/1"]).agg(F.count("*").alias("rows"), F.sum("doc_id").alias("ids"))


@query("stem_scan", "SELECT 'role_' || role AS file_stem, count(*) AS rows FROM conversations GROUP BY role")
def stem_scan(spark, sf_dir):
    rows, path = table(spark, sf_dir, "conversations"), _folder(spark, "stems")
    for role in ("system", "user", "assistant"):  # a file each, in as many parts as tasks wrote
        rows.where(F.col("role") == role).select("conv_id", "turn").write.json(f"{path}/role_{role}.jsonl")
    return B.scan_with_stem(spark, f"{path}/*.jsonl", "conv_id long, turn long").groupBy("file_stem").agg(F.count("*").alias("rows"))


@query("sharded_sink", "SELECT index // 300 AS shard, count(*) AS rows, sum(doc_id)::BIGINT AS ids FROM (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS index FROM documents) GROUP BY 1")
def sharded_sink(spark, sf_dir):
    from curata.operators.mixing import numbered

    path = _folder(spark, "shards")
    B.write_sharded(numbered(table(spark, sf_dir, "documents").select("doc_id"), "doc_id"), path, "index", 300)
    return spark.read.schema("doc_id long, index long, shard long").json(path).groupBy("shard").agg(F.count("*").alias("rows"), F.sum("doc_id").alias("ids"))


@query("keyed_sink", "SELECT source, count(*) AS rows, true AS within FROM documents GROUP BY source")
def keyed_sink(spark, sf_dir):
    path = _folder(spark, "keyed")
    B.write_by_key(table(spark, sf_dir, "documents").select("doc_id", "source"), path, "source", 25)
    rows = spark.read.schema("doc_id long, source string").json(path).withColumn("file", F.input_file_name())
    files = rows.groupBy("source", "file").agg(F.count("*").alias("n"))
    return files.groupBy("source").agg(F.sum("n").alias("rows"), (F.max("n") <= 25).alias("within"))


@query("report_sink", "SELECT source, count(*)::VARCHAR AS rows FROM documents GROUP BY source")
def report_sink(spark, sf_dir):
    path = f"{_folder(spark, 'report')}.tsv"
    B.write_report(table(spark, sf_dir, "documents").groupBy("source").agg(F.count("*").alias("rows")), path)
    return B.scan(spark, path).select("source", "rows")


@query("clean_sink", "SELECT doc_id, source FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1)")
def clean_sink(spark, sf_dir):
    """A decontaminated table as Parquet, read back."""
    path, bad = _folder(spark, "clean"), table(spark, sf_dir, "labels").where("toxic = 1")
    table(spark, sf_dir, "documents").join(bad.select("doc_id"), "doc_id", "left_anti").write.parquet(path)
    return B.scan(spark, path).select("doc_id", "source")


@query("split_sink", "SELECT lang AS subset, count(*) AS rows FROM documents GROUP BY lang")
def split_sink(spark, sf_dir):
    """One split for each subset."""
    path = _folder(spark, "splits")
    table(spark, sf_dir, "documents").select("doc_id", F.col("lang").alias("subset")).write.partitionBy("subset").parquet(path)
    return spark.read.parquet(path).groupBy("subset").agg(F.count("*").alias("rows"))


@query("file_shards")
def file_shards(spark, sf_dir):
    """Shards and digests of files: binary content is beyond the SQL side; a test puts the shards together again."""
    return B.split_digests(spark, f"{sf_dir}/region.parquet", 1000).select("length", "file_sha256", "shard", "shard_sha256")
