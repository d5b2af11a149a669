"""Queries: token sequences, advantages, packing, repetition, rubrics and rollout steps."""

from __future__ import annotations

import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from curata.operators import messages as M
from curata.operators import packing as P
from curata.operators import repetition as R
from curata.operators import rubrics as B
from curata.operators import sequences as S
from curata.plans.catalogue import query
from curata.runtime import checkpoint_root
from curata.sources.tables import conversation_messages, table
from curata.streaming import loader as L
from curata.streaming import steps as T

NW = r"len(list_filter(string_split_regex({0}, '[ \t-\r]+'), lambda w: w <> ''))"
LABELS = f"""WITH c AS (SELECT conv_id, list({{'role': role, 'n': {NW.format("'<|' || role || '|>' || chr(10) || text")}}} ORDER BY turn) AS m FROM conversations GROUP BY conv_id),
f AS (SELECT conv_id, m, flatten(list_transform(m, lambda x: list_transform(range(x.n), lambda k: x.role = 'assistant'))) AS l FROM c)
"""


def _messages(spark, sf_dir):
    return conversation_messages(table(spark, sf_dir, "conversations"))


@query("label_masking", LABELS + "SELECT conv_id, len(l) AS tokens, len(list_filter(l, lambda x: x)) AS trainable, len(list_filter(l[1:128], lambda x: x)) AS kept_trainable FROM f")
def label_masking(spark, sf_dir):
    whole, cut = S.turn_labels(F.col("messages")), S.turn_labels(F.col("messages"), longest=128)
    n = lambda p: F.size(F.filter(p["labels"], lambda x: x != S.MASKED)).cast("long")
    return _messages(spark, sf_dir).select("conv_id", F.size(whole["input_ids"]).cast("long").alias("tokens"), n(whole).alias("trainable"), n(cut).alias("kept_trainable"))


@query("token_features", LABELS + "SELECT conv_id, len(l) AS tokens, least(len(l), 100) AS kept, coalesce(list_position(l[1:100], true) - 1, -1) AS first, len(l) > 100 AS truncated FROM f")
def token_features(spark, sf_dir):
    rows = _messages(spark, sf_dir).select("conv_id", S.token_features(S.turn_labels(F.col("messages")), 100).alias("f"))
    return rows.select("conv_id", *(F.col(f"f.{c}").cast("long").alias(c) for c in ("tokens", "kept", "first")), "f.truncated")


@query("last_turn_labels", LABELS + "SELECT conv_id, CASE WHEN m[-1].role = 'assistant' THEN m[-1].n ELSE 0 END AS trainable FROM f")
def last_turn_labels(spark, sf_dir):
    pair = S.turn_labels(F.col("messages"), last_only=True)
    return _messages(spark, sf_dir).select("conv_id", F.size(F.filter(pair["labels"], lambda x: x != S.MASKED)).cast("long").alias("trainable"))


@query("prompt_masking", f"WITH t AS (SELECT doc_id, {NW.format('text')} AS n FROM documents) SELECT doc_id, n + 3 AS tokens, n AS trainable FROM t")
def prompt_masking(spark, sf_dir):
    pair = S.prompt_masked(S.hashed_ids(F.lit("Go on please")), S.hashed_ids(F.col("text")))
    rows = table(spark, sf_dir, "documents").select("doc_id", pair.alias("p"))
    return rows.select("doc_id", F.size("p.input_ids").cast("long").alias("tokens"), F.size(F.filter("p.labels", lambda x: x != S.MASKED)).cast("long").alias("trainable"))


@query("trainable_filter", LABELS + "SELECT conv_id FROM f WHERE len(l) <= 400 AND list_contains(l, true)")
def trainable_filter(spark, sf_dir):
    from curata.operators.filters import any_label

    rows = _messages(spark, sf_dir).select("conv_id", S.turn_labels(F.col("messages")).alias("p"))
    return rows.where((F.size("p.input_ids") <= 400) & any_label(F.col("p.labels"))).select("conv_id")


@query("mask_spans", LABELS + "SELECT conv_id, len(list_filter(m, lambda x, i: x.role = 'assistant' AND (i = 1 OR m[i - 1].role <> 'assistant'))) AS spans FROM f")
def mask_spans(spark, sf_dir):
    rows = _messages(spark, sf_dir).select("conv_id", S.turn_labels(F.col("messages")).alias("p"))
    return rows.select("conv_id", F.size(S.mask_spans(F.transform("p.labels", lambda x: x != S.MASKED))).cast("long").alias("spans"))


@query("context_fit")
def context_fit(spark, sf_dir):
    """Messages cut to a context of 120 tokens; a fold with cut messages, a test holds it against plain Python."""
    tokens = lambda c: F.size(F.split(c, " "))
    rows = _messages(spark, sf_dir).select("conv_id", S.fitted_messages(F.col("messages"), tokens, 120).alias("m"))
    return rows.select("conv_id", F.size("m").alias("turns"), F.md5(M.raw_prompt(F.col("m"))).alias("digest"))


@query("group_advantages", "SELECT event_id, round((value - avg(value) OVER w) / (stddev_pop(value) OVER w + 1e-8), 3) AS advantage, round(value - avg(value) OVER w, 3) AS centered FROM events WINDOW w AS (PARTITION BY user_id)")
def group_advantages(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_id", "user_id", "value")
    return S.group_advantages(e, "user_id", "value").select("event_id", F.round("advantage", 3).alias("advantage"), F.round(F.col("value") - F.col("mean"), 3).alias("centered"))


@query("zero_std_drop", "SELECT event_id FROM events WHERE user_id IN (SELECT user_id FROM (SELECT user_id, (value > 99)::INT AS r FROM events) GROUP BY user_id HAVING min(r) < max(r))")
def zero_std_drop(spark, sf_dir):
    e = table(spark, sf_dir, "events").withColumn("r", (F.col("value") > 99).cast("int"))
    return S.varied_groups(e, "user_id", "r").select("event_id")


@query("gae", """WITH RECURSIVE s AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings),
r AS (SELECT vec_id, v, len(v) AS t, 0.0::DOUBLE AS a FROM s UNION ALL
SELECT vec_id, v, t - 1, (v[t] * 0.5) + 0.99 * coalesce(v[t + 1], 0) - v[t] + 0.99 * 0.95 * a FROM r WHERE t >= 1)
SELECT vec_id, round(a, 5) AS first_advantage FROM r WHERE t = 0""")
def gae(spark, sf_dir):
    v = F.transform("embedding", lambda x: x.cast("double"))
    out = S.gae(v, F.transform(v, lambda x: x * 0.5), 0.99, 0.95)
    return table(spark, sf_dir, "embeddings").select("vec_id", F.round(F.get(out, F.lit(0)), 5).alias("first_advantage"))


@query("gae_packed", """WITH RECURSIVE s AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings),
r AS (SELECT vec_id, v, len(v) AS t, 0.0::DOUBLE AS a, 0.0::DOUBLE AS total FROM s UNION ALL
SELECT vec_id, v, t - 1, b, total + b FROM (SELECT vec_id, v, t, total, (v[t] * 0.5) + g * 0.99 * coalesce(v[t + 1], 0) - v[t] + 0.99 * 0.95 * a * g AS b
FROM (SELECT *, CASE WHEN t % 16 = 0 OR t % 16 < 5 THEN 0 ELSE 1 END AS g FROM r WHERE t >= 1)))
SELECT vec_id, round(total, 4) AS total FROM r WHERE t = 0""")
def gae_packed(spark, sf_dir):
    v = F.transform("embedding", lambda x: x.cast("double"))
    dones = F.transform("embedding", lambda x, i: F.when((i + 1) % 16 == 0, 1).otherwise(0))
    mask = F.transform("embedding", lambda x, i: F.when((i + 1) % 16 < 5, 0).otherwise(1))
    out = S.gae(v, F.transform(v, lambda x: x * 0.5), 0.99, 0.95, dones, mask)
    return table(spark, sf_dir, "embeddings").select("vec_id", F.round(F.aggregate(out, F.lit(0.0), lambda a, x: a + x), 4).alias("total"))


@query("cu_seqlens", "SELECT doc_id, source, (sum(n_chars) OVER w - n_chars)::BIGINT AS start, (sum(n_chars) OVER w)::BIGINT AS stop FROM documents WINDOW w AS (PARTITION BY source ORDER BY doc_id)")
def cu_seqlens(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "n_chars")
    return S.cumulative_lengths(docs, "source", "doc_id", "n_chars").select("doc_id", "source", "start", "stop")


@query("token_budget_prefix", "SELECT doc_id, source FROM (SELECT *, sum(n_chars) OVER (PARTITION BY source ORDER BY doc_id) AS s FROM documents) WHERE s <= 20000 OR s = n_chars")
def token_budget_prefix(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "n_chars")
    return S.budget_prefix(docs, "source", "doc_id", "n_chars", 20_000).select("doc_id", "source")


@query("position_ids", "SELECT n_regionkey, list_sum(flatten(list_transform(l, lambda n: range(n))))::BIGINT AS total, list_sum(l)::BIGINT AS tokens FROM (SELECT n_regionkey, list(length(n_name) ORDER BY n_name) AS l FROM nation GROUP BY n_regionkey)")
def position_ids(spark, sf_dir):
    rows = table(spark, sf_dir, "nation").groupBy("n_regionkey").agg(F.sort_array(F.collect_list(F.struct("n_name", F.length("n_name").alias("n")))).alias("r"))
    ids = S.position_ids(F.col("r.n"))
    return rows.select("n_regionkey", F.aggregate(ids, F.lit(0).cast("long"), lambda a, x: a + x).alias("total"), F.size(ids).cast("long").alias("tokens"))


@query("first_true_index", "SELECT vec_id, coalesce(nullif(list_position(list_transform(embedding, lambda x: x > 0.2), true), 0) - 1, len(embedding))::INT AS first FROM embeddings")
def first_true_index(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select("vec_id", S.first_true(F.transform("embedding", lambda x: x > 0.2)).alias("first"))


#: Values of the order column in a run of next-fit.
RUN = 256
NEXT_FIT = """WITH RECURSIVE {cap}d AS (SELECT source, doc_id, coalesce(n_chars, 0) AS n, {size} AS size, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS i FROM documents{join}),
w AS (
  SELECT source, doc_id, n, i, n AS fill, 0::BIGINT AS pack FROM d WHERE i = 1
  UNION ALL
  SELECT d.source, d.doc_id, d.n, d.i, CASE WHEN fill > 0 AND fill + d.n > size THEN d.n ELSE fill + d.n END, pack + (fill > 0 AND fill + d.n > size)::INT
  FROM w JOIN d ON d.source IS NOT DISTINCT FROM w.source AND d.i = w.i + 1
), f AS (SELECT source, doc_id, n AS n_chars, pack FROM w)
"""
PLAIN = NEXT_FIT.format(cap="", size="8192", join="")
SHARED = NEXT_FIT.format(cap="t AS (SELECT source AS s, least(8192, sum(n_chars)::BIGINT // 40) AS cap FROM documents GROUP BY source), ", size="cap", join=" JOIN t ON source IS NOT DISTINCT FROM s")


def _lengths(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("source", "doc_id", "n_chars")


@query("pack_next_fit", PLAIN + "SELECT source, doc_id, pack FROM f")
def pack_next_fit(spark, sf_dir):
    """Packs go over the ends of runs; the SQL folds each source from end to end."""
    return P.next_fit(_lengths(spark, sf_dir), "source", "doc_id", "n_chars", 8192, RUN).select("source", "doc_id", "pack")


@query("pack_next_fit_shared", SHARED + "SELECT source, doc_id, pack FROM f")
def pack_next_fit_shared(spark, sf_dir):
    """Forty packs for each source at least, as so many workers need one each."""
    return P.next_fit(_lengths(spark, sf_dir), "source", "doc_id", "n_chars", 8192, RUN, least_packs=40).select("source", "doc_id", "pack")


@query("pack_accounting", PLAIN + "SELECT source, pack, count(*) AS docs, sum(n_chars)::BIGINT AS tokens, (8192 - sum(n_chars))::BIGINT AS padding, sum(n_chars - 1)::BIGINT AS targets, sum(n_chars * n_chars)::BIGINT AS squares, sha256(string_agg(doc_id, ',' ORDER BY doc_id)) AS uid FROM f GROUP BY ALL")
def pack_accounting(spark, sf_dir):
    packs = P.next_fit(_lengths(spark, sf_dir), "source", "doc_id", "n_chars", 8192, RUN)
    return S.pack_accounting(packs, ["source"], "doc_id", "n_chars", 8192)


@query("pack_best_fit")
def pack_best_fit(spark, sf_dir):
    """Best-fit decreasing has no SQL; a test holds its patterns against a plain version."""
    return P.best_fit(_lengths(spark, sf_dir), "source", "doc_id", "n_chars", 8192)


@query("pack_best_fit_counts", "SELECT source, n_chars AS n_chars, count(*) AS docs FROM documents GROUP BY source, n_chars")
def pack_best_fit_counts(spark, sf_dir):
    """What best-fit must keep: every document once, in packs that hold (a longer document alone)."""
    packed = pack_best_fit(spark, sf_dir)
    fits = packed.groupBy("source", "pack").agg(F.sum("n_chars").alias("t"), F.max("n_chars").alias("m")).where("t <= greatest(8192, m)").select("source", "pack")
    return packed.join(fits, ["source", "pack"], "left_semi").groupBy("source", "n_chars").agg(F.count("*").alias("docs"))


@query("pack_best_fit_full", "SELECT source, true AS full, true AS in_order FROM documents GROUP BY source")
def pack_best_fit_full(spark, sf_dir):
    """Packs of 400 characters that are full to the last, in the order of their first documents."""
    packed = P.best_fit(_lengths(spark, sf_dir), "source", "doc_id", "n_chars", 400)
    kept = P.in_order_of_first(packed, "source", "doc_id", 400, "n_chars")
    packs = kept.groupBy("source", "pack").agg(F.sum("n_chars").alias("t"), F.min("doc_id").alias("first"))
    before = F.lag("first").over(Window.partitionBy("source").orderBy("pack"))
    told = packs.withColumn("rises", F.coalesce(before < F.col("first"), F.lit(True)))
    every = table(spark, sf_dir, "documents").select("source").distinct()
    out = every.join(told, every.source.eqNullSafe(told.source), "left").drop(told.source)
    return out.groupBy("source").agg(F.bool_and(F.coalesce(F.col("t") == 400, F.lit(True))).alias("full"), F.bool_and(F.coalesce("rises", F.lit(True))).alias("in_order"))


@query("pack_priority", "SELECT doc_id, sha256('42:' || doc_id) AS priority FROM documents")
def pack_priority(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", S.priority(42, F.col("doc_id")).alias("priority"))


@query("pack_selection")
def pack_selection(spark, sf_dir):
    """Greedy swaps towards a token mass; a test holds it against a plain version."""
    return P.select_packs(_lengths(spark, sf_dir), "doc_id", "n_chars", 100, 200_000, 500, S.priority(42, F.col("doc_id")))


@query("pack_schedule", "WITH p AS (SELECT doc_id AS uid, row_number() OVER (ORDER BY md5('42:' || doc_id), doc_id) - 1 AS place FROM documents), n AS (SELECT count(*) AS n FROM p), a AS (SELECT * FROM p UNION ALL SELECT NULL, n + range FROM n, range(64) WHERE range < (64 - n % 64) % 64) SELECT uid, place // 64 AS step, place % 64 AS slot FROM a")
def pack_schedule(spark, sf_dir):
    return S.schedule(table(spark, sf_dir, "documents").select("doc_id"), "doc_id", 64)


@query("collated_batch", f"""WITH t AS (SELECT conv_id, list({NW.format('text')} ORDER BY turn) AS l FROM conversations GROUP BY conv_id)
SELECT conv_id, list_sum(l)::BIGINT AS tokens, len(list_filter(l, lambda n: n > 0)) AS masked, coalesce(list_sum(list_transform(l, lambda n: n * (n - 1) // 2)), 0)::BIGINT AS positions FROM t""")
def collated_batch(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", S.hashed_ids(F.col("text")).alias("ids"))
    out = S.collated(turns.withColumn("labels", F.col("ids")), "conv_id", "turn", "ids", "labels")
    total = F.aggregate("position_ids", F.lit(0).cast("long"), lambda a, x: a + x)
    return out.select("conv_id", F.size("input_ids").cast("long").alias("tokens"), F.size(F.filter("labels", lambda x: x == S.MASKED)).cast("long").alias("masked"), total.alias("positions"))


@query("padded_arrays", "SELECT vec_id, len(embedding) AS n, round(list_sum(embedding[1:10])::DOUBLE, 4) AS head FROM embeddings")
def padded_arrays(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings").withColumn("p", S.padded(F.slice("embedding", 1, 10), 20, 0))
    return e.select("vec_id", F.size("embedding").cast("long").alias("n"), F.round(F.aggregate("p", F.lit(0.0), lambda a, x: a + x.cast("double")), 4).alias("head"))


@query("unpacked_sequences", "SELECT vec_id, 3 AS parts, round(list_sum(embedding[11:30])::DOUBLE, 4) AS middle FROM embeddings")
def unpacked_sequences(spark, sf_dir):
    parts = S.unpacked(F.col("embedding"), F.array(F.lit(10), F.lit(20), F.lit(34)))
    rows = table(spark, sf_dir, "embeddings").select("vec_id", parts.alias("p"))
    return rows.select("vec_id", F.size("p").alias("parts"), F.round(F.aggregate(F.get("p", F.lit(1)), F.lit(0.0), lambda a, x: a + x.cast("double")), 4).alias("middle"))


@query("worker_shares", "SELECT doc_id, place // 125 AS worker FROM (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS place, count(*) OVER () AS n FROM documents) WHERE n = 1000 UNION ALL SELECT doc_id, place // (n // 8) FROM (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS place, count(*) OVER () AS n FROM documents) WHERE n <> 1000 AND place < n // 8 * 8")
def worker_shares(spark, sf_dir):
    return S.worker_shares(table(spark, sf_dir, "documents").select("doc_id"), "doc_id", 8).select("doc_id", "worker")


# repetition

@query("ngram_repetition", r"WITH w AS (SELECT doc_id, list_filter(string_split_regex(lower(text), '[ \t-\r]+'), lambda w: w <> '') AS w FROM documents), g AS (SELECT doc_id, p, array_to_string(w[p:p + 2], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS p FROM w)), r AS (SELECT doc_id, g, count(*) AS n, sum(p - 1)::BIGINT AS places, min(p - 1) AS first FROM g GROUP BY ALL HAVING count(*) >= 2) SELECT doc_id, count(*) AS grams, max(n) AS most, sum(places)::BIGINT AS places, min(g) AS least_gram FROM r GROUP BY doc_id")
def ngram_repetition(spark, sf_dir):
    rows = R.repeated_grams(table(spark, sf_dir, "documents"), "doc_id", "text")
    places = F.sum(F.aggregate("positions", F.lit(0).cast("long"), lambda a, x: a + x))
    return rows.groupBy("doc_id").agg(F.count("*").alias("grams"), F.max("times").alias("most"), places.alias("places"), F.min("gram").alias("least_gram"))


BLOCKS = r"""WITH b AS (SELECT doc_id, list_filter(list_transform(string_split_regex(text, '[.!?]+'), lambda s: regexp_replace(s, '^\s+|\s+$', '', 'g')), lambda s: s <> '') AS l FROM documents),
x AS (SELECT doc_id, l[p] AS block, p - 1 AS pos FROM (SELECT doc_id, l, unnest(range(1, len(l) + 1)) AS p FROM b) WHERE length(l[p]) >= 5),
i AS (SELECT doc_id, block, pos, pos - row_number() OVER (PARTITION BY doc_id, block ORDER BY pos) AS island FROM x),
r AS (SELECT doc_id, block, island, count(*) AS n, min(pos) AS p FROM i GROUP BY ALL),
t AS (SELECT doc_id, block, sum(n)::BIGINT AS total, max(n) AS run, min(p)::INT AS first FROM r GROUP BY ALL HAVING sum(n) > 1)
"""


@query("block_repetition", BLOCKS + "SELECT doc_id, block, total, run, first FROM t")
def block_repetition(spark, sf_dir):
    return R.repeated_blocks(table(spark, sf_dir, "documents"), "doc_id", R.sentences(F.col("text")), 5)


@query("consecutive_repetition", BLOCKS + ", c AS (SELECT doc_id, block, arg_min(n, p) AS run, min(p)::INT AS first FROM r WHERE n > 1 GROUP BY ALL) SELECT doc_id, block, total, c.run, c.first FROM c JOIN t USING (doc_id, block) WHERE length(block) >= 10")
def consecutive_repetition(spark, sf_dir):
    return R.consecutive_blocks(table(spark, sf_dir, "documents"), "doc_id", R.sentences(F.col("text")), 10)


@query("repetition_flags")
def repetition_flags(spark, sf_dir):
    """The full rule uses look-around free patterns but many of them; tests hold it against plain cases."""
    return R.repetition_flags(table(spark, sf_dir, "documents"), "doc_id", "text", 2, 4, 2)


@query("repetition_reasons")
def repetition_reasons(spark, sf_dir):
    return repetition_flags(spark, sf_dir).where("has_repetition").groupBy("reason").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "reason")


# rubrics and rollout steps

@query("rubric_prune", "SELECT user_id, event_type, std, std > 0 AND row_number() OVER (PARTITION BY user_id ORDER BY std DESC, event_type) <= 2 AS active FROM (SELECT user_id, event_type, round(stddev_pop(value), 6) AS std FROM events GROUP BY ALL)")
def rubric_prune(spark, sf_dir):
    return B.pruned(table(spark, sf_dir, "events"), "user_id", "event_type", "value", 2)


@query("rubric_buffer", "WITH f AS (SELECT user_id, arg_min(event_type, event_id) AS t FROM events GROUP BY user_id), n AS (SELECT user_id, user_id % 2 = 0 AS fresh FROM f) SELECT f.user_id, 1 AS persistent, CASE WHEN fresh THEN 1 + (t <> 'view')::INT ELSE 0 END AS active FROM f JOIN n USING (user_id)")
def rubric_buffer(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("user_id", "event_id", F.array(F.struct(F.col("event_type").alias("text"), F.lit(1.0).alias("weight"))).alias("rubrics"))
    buffer = B.initial_buffer(e, "user_id", "event_id", "rubrics")
    new = e.select("user_id").distinct().where("user_id % 2 = 0").select("user_id", F.array(F.lit("view")).alias("positive"), F.array(F.lit("is vague")).alias("negative"))
    out = B.merged(buffer, new, "user_id")
    return out.select("user_id", F.size("persistent").alias("persistent"), F.size("active").alias("active"))


STEPS = """WITH g AS (SELECT user_id, min(event_id) AS first, round(avg(value), 6) AS mean, max(value) > min(value) AS varied, avg(value) >= 55 AS solved FROM events GROUP BY user_id)
"""


@query("stream_step_groups", STEPS + "SELECT user_id, mean, solved, (row_number() OVER (ORDER BY first) - 1) // 16 AS step FROM g WHERE varied")
def stream_step_groups(spark, sf_dir):
    groups = T.complete_groups(table(spark, sf_dir, "events"), "user_id", "value", 55)
    return T.steps_of(groups, 16).select("user_id", "mean", "solved", "step")


@query("truncated_mask", "SELECT event_id, round(value - avg(value) OVER (PARTITION BY user_id), 3) AS advantage FROM events QUALIFY event_type = 'click'")
def truncated_mask(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_id", "user_id", "value", F.when(F.col("event_type") == "click", "stop").otherwise("length").alias("finish"))
    rows = S.group_advantages(e, "user_id", "value", centered=True)
    return T.without_truncated(rows, "finish").select("event_id", F.round("advantage", 3).alias("advantage"))


BATCHES = """WITH r AS (SELECT user_id, event_id, value, (row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1) // 8 AS number FROM events),
g AS (SELECT user_id, number, min(event_id) AS first, count(*) AS rows, round(avg(value), 6) AS mean, coalesce(max(value) > min(value), false) AS varied, coalesce(avg(value) >= 60, false) AS solved FROM r GROUP BY ALL HAVING count(*) = 8),
s AS (SELECT user_id, min(number) AS till FROM g WHERE solved GROUP BY user_id)
"""


def _as_stream(spark, rows):
    """A stream over a table's rows, and a folder for its output and state."""
    root = f"{checkpoint_root(spark)}/stream-{uuid.uuid4().hex}"
    rows.write.parquet(f"{root}/in")
    return spark.readStream.schema(rows.schema).parquet(f"{root}/in"), root


@query("stream_step_batches", BATCHES + "SELECT user_id, number, first, rows, mean, varied, solved FROM g LEFT JOIN s USING (user_id) WHERE till IS NULL OR number <= till")
def stream_step_batches(spark, sf_dir):
    """A stream over the events: each user's rollouts in groups of eight, until the mean of one reaches 60."""
    stream, root = _as_stream(spark, table(spark, sf_dir, "events").select("event_id", "user_id", "value"))
    out = T.running_groups(stream, "user_id", "value", 8, 60, "event_id")
    T.run_available(out, f"{root}/out", f"{root}/state")
    return spark.read.schema(out.schema).parquet(f"{root}/out")


@query("stream_unsolved", BATCHES + "SELECT DISTINCT user_id FROM events WHERE user_id NOT IN (SELECT user_id FROM s)")
def stream_unsolved(spark, sf_dir):
    """The users that are left to sample from, by the stream's own record of what was solved."""
    return T.unsolved(table(spark, sf_dir, "events").select("user_id").distinct(), stream_step_batches(spark, sf_dir), "user_id")


BUDGETED = """WITH RECURSIVE d AS (SELECT doc_id % 4 AS rank, doc_id, coalesce(n_chars, 0) AS n, row_number() OVER (PARTITION BY doc_id % 4 ORDER BY doc_id) - 1 AS seen FROM documents),
f AS (
  SELECT rank, doc_id, n, seen, 0::BIGINT AS batch, 0::BIGINT AS place, n AS tokens FROM d WHERE seen = 0
  UNION ALL
  SELECT rank, doc_id, n, seen, CASE WHEN cut THEN batch + 1 ELSE batch END, CASE WHEN cut THEN 0 ELSE place + 1 END, CASE WHEN cut THEN n ELSE tokens + n END
  FROM (SELECT d.*, batch, place, tokens, tokens + d.n > 6000 OR d.seen >= (batch + 1) * 4 AS cut FROM f JOIN d ON f.rank = d.rank AND d.seen = f.seen + 1)
)
SELECT rank, doc_id, n AS n_chars, batch, place FROM f"""


@query("stream_budgeted_batches", BUDGETED)
def stream_budgeted_batches(spark, sf_dir):
    """Four new documents a batch and rank, 6,000 characters at most; what does not fit goes to the next batch."""
    stream, root = _as_stream(spark, table(spark, sf_dir, "documents").select((F.col("doc_id") % 4).alias("rank"), "doc_id", "n_chars"))
    out = T.budgeted_batches(stream, "rank", "doc_id", "n_chars", 4, 6000)
    T.run_available(out, f"{root}/out", f"{root}/state")
    return spark.read.schema(out.schema).parquet(f"{root}/out")


LOADER = """WITH e AS (SELECT unnest([0, 1]) AS epoch),
x AS (SELECT epoch, doc_id, (row_number() OVER (PARTITION BY epoch ORDER BY md5('7:' || epoch || ':' || doc_id), doc_id) - 1) AS i, count(*) OVER (PARTITION BY epoch) // 16 AS whole
      FROM e, documents WHERE epoch = 0 OR doc_id NOT IN (SELECT doc_id FROM labels WHERE quality = 1))
SELECT epoch::BIGINT AS epoch, i // 16 AS batch, i % 16 AS place, doc_id FROM x WHERE i // 16 < whole"""


@query("loader_resumed", LOADER)
def loader_resumed(spark, sf_dir):
    """Two epochs of a loader that stops in the first and again between them; good documents are solved in the first."""
    path, docs = f"{checkpoint_root(spark)}/loader-{uuid.uuid4().hex}", table(spark, sf_dir, "documents").select("doc_id")
    solved = table(spark, sf_dir, "labels").where("quality = 1").select("doc_id")
    stop = L.batches(docs, "doc_id", 0, 16, 7).agg(F.max("batch")).first()[0] // 2
    given = L.batches(docs, "doc_id", 0, 16, 7).where(F.col("batch") < stop)
    L.save(spark, path, L.State(0, 0, stop), solved.where("doc_id % 2 = 0"))
    at, excluded = L.load(spark, path, "doc_id")
    given = given.unionByName(L.batches(docs, "doc_id", at.epoch, 16, 7, excluded, at.batch))
    L.save(spark, path, L.State(1, 0, 0), solved.where("doc_id % 2 <> 0"))
    L.save(spark, path, L.State(2, 1, 0))
    L.clean_up(spark, path, "doc_id", keep=1)
    at, excluded = L.load(spark, path, "doc_id")
    return given.unionByName(L.batches(docs, "doc_id", at.epoch, 16, 7, excluded, at.batch)).select("epoch", "batch", "place", "doc_id")
