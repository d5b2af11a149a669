"""Queries: contamination by phrases, n-grams and vectors."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from curata.functions.text import analyzed
from curata.operators import cells as Y
from curata.operators import contamination as C
from curata.operators import postings as X
from curata.plans.catalogue import query
from curata.runtime import checkpoint_root
from curata.sources.tables import table

TOKENS = r"""list_filter(string_split_regex(lower({0}), '[ ,.?!:;()"\n\\-]+'), lambda w: w <> '')"""


def with_grams(n: int = C.GRAM) -> str:
    """Common tables: tokens and n-grams of documents and items, and matches."""
    return f"""
WITH d AS (SELECT doc_id, {TOKENS.format('text')} AS t FROM documents),
i AS (SELECT item_id, {TOKENS.format('text')} AS t FROM benchmark),
dg AS (SELECT DISTINCT doc_id, array_to_string(t[p:p + {n - 1}], ' ') AS g FROM (SELECT doc_id, t, unnest(range(1, len(t) - {n} + 2)) AS p FROM d)),
ig AS (SELECT item_id, g, max(p) AS p FROM (SELECT item_id, p, array_to_string(t[p:p + {n - 1}], ' ') AS g
       FROM (SELECT item_id, t, unnest(range(1, len(t) - {n} + 2)) AS p FROM i)) GROUP BY ALL),
c AS (SELECT item_id, doc_id, count(DISTINCT q) AS covered FROM (SELECT item_id, doc_id, unnest(range(p, p + {n})) AS q FROM ig JOIN dg USING (g)) GROUP BY ALL),
m AS (SELECT item_id, doc_id, round(covered / len(t), 6) AS score FROM c JOIN i USING (item_id)),
b AS (SELECT item_id, coalesce(max(score), 0.0) AS score, min(doc_id) FILTER (score = s) AS best_doc
      FROM (SELECT i.item_id, m.doc_id, m.score, max(m.score) OVER (PARTITION BY i.item_id) AS s FROM i LEFT JOIN m USING (item_id)) GROUP BY item_id)
"""


@query("ngram_contamination", with_grams() + "SELECT item_id, score, best_doc FROM b")
def ngram_contamination(spark, sf_dir):
    items = table(spark, sf_dir, "benchmark")
    return C.item_scores(C.ngram_matches(table(spark, sf_dir, "documents"), items), items)


@query(
    "contamination_report",
    with_grams()
    + """SELECT count(*) AS items, sum((score > 0.5)::INT)::BIGINT AS contaminated,
round(avg((score > 0.5)::INT), 6) AS dataset_score, round(avg(score), 6) AS mean_score FROM b""",
)
def contamination_report(spark, sf_dir):
    flag = (F.col("score") > 0.5).cast("int")
    return ngram_contamination(spark, sf_dir).agg(
        F.count("*").alias("items"), F.sum(flag).alias("contaminated"), F.round(F.avg(flag), 6).alias("dataset_score"),
        F.round(F.avg("score"), 6).alias("mean_score"),
    )


@query("train_contamination_scores", with_grams() + "SELECT doc_id, max(score) AS score, count(*) AS items FROM m GROUP BY doc_id")
def train_contamination_scores(spark, sf_dir):
    matches = C.ngram_matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return matches.groupBy("doc_id").agg(F.max("score").alias("score"), F.count("*").alias("items"))


PHRASES = f"""
WITH d AS (SELECT doc_id, ' ' || array_to_string({TOKENS.format('text')}, ' ') || ' ' AS t FROM documents),
i AS (SELECT item_id, ' ' || array_to_string({TOKENS.format('text')}, ' ') || ' ' AS t FROM benchmark),
m AS (SELECT DISTINCT item_id, doc_id FROM d JOIN i ON contains(d.t, i.t) WHERE trim(i.t) <> '')
"""


@query("exact_phrase_match", PHRASES + "SELECT item_id, count(*) AS docs, min(doc_id) AS first_doc FROM m GROUP BY item_id")
def exact_phrase_match(spark, sf_dir):
    found = C.phrase_matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.groupBy("item_id").agg(F.count("*").alias("docs"), F.min("doc_id").alias("first_doc"))


@query("decontaminate_docs", PHRASES + "SELECT doc_id, source FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM m)")
def decontaminate_docs(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return C.decontaminated(docs, C.phrase_matches(docs, table(spark, sf_dir, "benchmark"))).select("doc_id", "source")


@query(
    "decontamination_kept",
    PHRASES + """SELECT source, count(*) AS rows, sum(kept)::BIGINT AS kept, round(100.0 * sum(kept) / count(*), 4) AS kept_percent
FROM (SELECT source, (doc_id NOT IN (SELECT doc_id FROM m))::INT AS kept FROM documents) GROUP BY source""",
)
def decontamination_kept(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    bad = C.phrase_matches(docs, table(spark, sf_dir, "benchmark")).select("doc_id").distinct().withColumn("bad", F.lit(1))
    kept = F.sum(1 - F.coalesce("bad", F.lit(0)))
    return docs.join(bad, "doc_id", "left").groupBy("source").agg(
        F.count("*").alias("rows"), kept.alias("kept"), F.round(100.0 * kept / F.count("*"), 4).alias("kept_percent")
    )


VECTORS = """
WITH v AS (SELECT vec_id::BIGINT AS vec_id, embedding::DOUBLE[] AS e, label FROM embeddings),
u AS (SELECT vec_id, label, list_transform(e, lambda x: x / sqrt(list_dot_product(e, e))) AS e FROM v),
s AS (SELECT q.vec_id AS query_id, u.vec_id, round(list_dot_product(q.e, u.e), 6) AS score, u.label, q.label AS query_label
      FROM u q JOIN u ON q.vec_id <> u.vec_id WHERE q.vec_id % 20 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
"""


def _topk(spark, sf_dir):
    vectors = table(spark, sf_dir, "embeddings")
    return vectors, C.vector_topk(vectors, vectors.where("vec_id % 20 = 0"))


@query("vector_topk", VECTORS + "SELECT query_id, vec_id, rank::INT AS rank, round(score, 4) AS score FROM r WHERE rank <= 5")
def vector_topk(spark, sf_dir):
    return _topk(spark, sf_dir)[1].withColumn("score", F.round("score", 4))


@query("vector_contamination", VECTORS + "SELECT vec_id, round(max(score), 4) AS score FROM r WHERE rank <= 5 GROUP BY vec_id")
def vector_contamination(spark, sf_dir):
    return _topk(spark, sf_dir)[1].groupBy("vec_id").agg(F.round(F.max("score"), 4).alias("score"))


@query(
    "vector_label_votes",
    VECTORS.replace(" WHERE q.vec_id % 20 = 0", "")
    + "SELECT query_id, count(*) AS hits, sum((label = query_label)::INT)::BIGINT AS agree FROM r WHERE rank <= 5 GROUP BY query_id",
)
def vector_label_votes(spark, sf_dir):
    """Every vector is asked for, not only those of the searches above."""
    near = C.vector_neighbours(table(spark, sf_dir, "embeddings"))
    return near.groupBy("query_id").agg(F.count("*").alias("hits"), F.sum((F.col("label") == F.col("query_label")).cast("int")).alias("agree"))


@query("role_index_docs", "SELECT conv_id AS original_id, turn, text FROM conversations WHERE role = 'user'")
def role_index_docs(spark, sf_dir):
    return C.index_docs(table(spark, sf_dir, "conversations"))


FIELDS = f"""
WITH d AS (SELECT doc_id, ' ' || array_to_string({TOKENS.format('text')}, ' ') || ' ' AS t FROM documents),
w AS (SELECT item_id, {TOKENS.format('text')} AS t FROM benchmark),
i AS (SELECT item_id, ' ' || array_to_string(t[:len(t) // 2], ' ') || ' ' AS a, ' ' || array_to_string(t[len(t) // 2 + 1:], ' ') || ' ' AS b FROM w WHERE len(t) >= 2)
SELECT item_id, doc_id FROM i JOIN d ON contains(d.t, a) AND contains(d.t, b)"""


def _fields(spark, sf_dir):
    """The items of the benchmark as two texts each: the first half of the tokens, and the second."""
    items = table(spark, sf_dir, "benchmark").select("item_id", analyzed(F.col("text")).alias("t")).where(F.size("t") >= 2)
    half = F.expr("size(t) div 2")
    texts = F.array(F.array_join(F.slice("t", F.lit(1), half), " "), F.array_join(F.slice("t", half + 1, F.size("t")), " "))
    return items.select("item_id", F.posexplode(texts).alias("field", "text"))


@query("fields_phrase_match", FIELDS)
def fields_phrase_match(spark, sf_dir):
    """Both halves of an item must stand in the same document."""
    return C.phrase_matches(table(spark, sf_dir, "documents"), _fields(spark, sf_dir))


@query("index_phrase_match", FIELDS)
def index_phrase_match(spark, sf_dir):
    """The same by a positional index that was built in two steps."""
    docs, path = table(spark, sf_dir, "documents"), f"{checkpoint_root(spark)}/index-{uuid.uuid4().hex}"
    middle = docs.agg(F.expr("max(doc_id) div 2")).first()[0]
    X.extend(docs.where(F.col("doc_id") <= middle), path)
    X.extend(docs, path)
    return X.phrase_matches(path, _fields(spark, sf_dir))


@query("index_dictionary", f"SELECT token, count(DISTINCT doc_id) AS docs FROM (SELECT doc_id, unnest({TOKENS.format('text')}) AS token FROM documents) GROUP BY token")
def index_dictionary(spark, sf_dir):
    path = f"{checkpoint_root(spark)}/index-{uuid.uuid4().hex}"
    X.extend(table(spark, sf_dir, "documents"), path)
    return X.dictionary(spark, path)


@query("suite_report", with_grams() + """, k AS (SELECT item_id, CASE item_id % 3 WHEN 0 THEN 'facts' WHEN 1 THEN 'maths' ELSE 'code' END AS suite FROM i),
l AS (SELECT item_id, suite FROM k QUALIFY suite <> 'code' OR row_number() OVER (PARTITION BY suite ORDER BY item_id) <= 5),
x AS (SELECT DISTINCT doc_id, suite FROM m JOIN l USING (item_id) WHERE score > 0.3)
SELECT source, count(*) AS rows, round(avg((doc_id IN (SELECT doc_id FROM x WHERE suite = 'facts'))::INT), 6) AS facts,
 round(avg((doc_id IN (SELECT doc_id FROM x WHERE suite = 'maths'))::INT), 6) AS maths, round(avg((doc_id IN (SELECT doc_id FROM x WHERE suite = 'code'))::INT), 6) AS code FROM documents GROUP BY source""")
def suite_report(spark, sf_dir):
    """Three evaluation sets, one of them with a limit, and a column for each."""
    docs, items = table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")
    suite = F.element_at(F.array(F.lit("facts"), F.lit("maths"), F.lit("code")), (F.col("item_id") % 3 + 1).cast("int"))
    sets = items.select(suite.alias("suite"), "item_id", F.lit("text").alias("field"), "text")
    return C.suite_report(docs, C.suite_matches(docs, sets, {"code": 5}), ["facts", "maths", "code"], "source", 0.3)


def _cells(spark, sf_dir, target: float | None):
    vectors = Y.unit_vectors(table(spark, sf_dir, "embeddings"))
    centroids = Y.learn_centroids(vectors, 24)
    index = Y.index_cells(vectors, centroids)
    return Y.cell_topk(index, vectors.where("vec_id % 20 = 0"), centroids, 5, Y.probes_for(vectors, centroids, target) if target else len(centroids))


@query("vector_cells_exact", VECTORS + "SELECT query_id, vec_id, rank::INT AS rank, round(score, 4) AS score FROM r WHERE rank <= 5")
def vector_cells_exact(spark, sf_dir):
    """Inverted cells, all of which are searched."""
    return _cells(spark, sf_dir, None).withColumn("score", F.round("score", 4))


@query("vector_cells_recall", VECTORS + "SELECT count(DISTINCT query_id) AS queries, count(*) AS neighbours, true AS reached FROM r WHERE rank <= 5")
def vector_cells_recall(spark, sf_dir):
    """As many cells as a sample needs: whether nine in ten of the true neighbours are found."""
    found, (_, exact) = _cells(spark, sf_dir, 0.95), _topk(spark, sf_dir)
    hit = exact.join(found.select("query_id", "vec_id", F.lit(1).alias("hit")), ["query_id", "vec_id"], "left")
    return hit.agg(F.count_distinct("query_id").alias("queries"), F.count("*").alias("neighbours"), (F.count("hit") >= 0.9 * F.count("*")).alias("reached"))
