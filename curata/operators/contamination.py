"""Contamination of training rows by evaluation items: phrases, n-grams and vectors."""

from __future__ import annotations

import math
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from curata.functions.text import analyzed
from curata.runtime import arrow_rows, materialize, share

GRAM = 8
#: Bytes of the phrases that are broadcast as an automaton at most; more phrases are joined.
PHRASE_BYTES = 16_000_000
#: Query vectors that are broadcast at once; more are taken in blocks.
QUERY_BLOCK = 4096
#: Queries and vectors whose scores a task holds at once.
TILE = 256, 4096
#: Rows of a group of vectors, where all groups meet all; fewer if tasks would be too few, but not under the second number for that.
GROUP_ROWS = 65_536, 1_024


def index_docs(turns: DataFrame, role: str = "user") -> DataFrame:
    """One document for each turn of a role, with the number of its conversation."""
    return turns.where(F.col("role") == role).select(F.col("conv_id").alias("original_id"), "turn", "text")


def framed(text: Column) -> Column:
    """The tokens of a text with one blank between them and around them, so that a run of tokens is a piece of it."""
    return F.concat(F.lit(" "), F.array_join(analyzed(text), " "), F.lit(" "))


def _finder(get):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = get()
        for batch in batches:
            docs, found = [], []
            for k, body in enumerate(batch.column("body").to_pylist()):
                own = {number for _, number in automaton.iter(body)} if body else ()
                docs += [k] * len(own)
                found += own
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(pa.array(docs, pa.int64())), pa.array(found, pa.int64())], ["doc_id", "number"])

    return run


def run_hits(docs: DataFrame, phrases: DataFrame) -> DataFrame:
    """``doc_id, number`` once for each document and phrase of ``phrases(number, phrase)`` whose tokens stand there as a run.

    ``phrase`` is framed text. While the phrases have ``PHRASE_BYTES`` together, an automaton of them is broadcast and finds
    all of them, of any length, in one pass over the documents. More of them are joined on their first tokens, a pass for
    each length below ``GRAM``, and whole runs are then compared. Null texts have no runs; empty phrases are nowhere.
    """
    phrases = phrases.where(F.length("phrase") > 2)
    if phrases.agg(F.coalesce(F.sum(F.octet_length("phrase")), F.lit(0))).first()[0] > PHRASE_BYTES:
        return _joined_hits(docs, phrases)
    automaton = ahocorasick.Automaton()
    for r in phrases.collect():  # no more than the bytes that were counted
        automaton.add_word(r.phrase, r.number)
    if not len(automaton):
        return docs.sparkSession.createDataFrame([], f"doc_id {dict(docs.dtypes)['doc_id']}, number long")
    automaton.make_automaton()
    arrow_rows(docs.sparkSession)
    rows = docs.select("doc_id", framed(F.col("text")).alias("body"))
    return rows.mapInArrow(_finder(share(docs.sparkSession, automaton)), f"doc_id {dict(docs.dtypes)['doc_id']}, number long")


def _joined_hits(docs: DataFrame, phrases: DataFrame, n: int = GRAM) -> DataFrame:
    tokens = F.split(F.trim("phrase"), " ")
    keyed = materialize(phrases.withColumn("k", F.least(F.size(tokens), F.lit(n))).withColumn("gram", F.xxhash64(F.array_join(F.slice(tokens, 1, n), " "))), "phrases")
    lengths = sorted(r.k for r in keyed.select("k").distinct().collect())  # at most n
    mine = docs.select("doc_id", "text", F.monotonically_increasing_id().alias("row"))
    mine = materialize(mine.withColumn("body", framed(F.col("text"))).drop("text"), "bodies")
    words = F.split(F.trim("body"), " ")
    grams = lambda k: F.transform(F.sequence(F.lit(1), F.size(words) - (k - 1)), lambda i: F.struct(F.lit(k).alias("k"), F.xxhash64(F.array_join(F.slice(words, i, k), " ")).alias("gram")))
    each = F.flatten(F.array(*[F.when(F.size(words) >= k, grams(k)).otherwise(F.array().cast("array<struct<k:int,gram:bigint>>")) for k in lengths]))
    pairs = mine.select("row", F.explode(F.array_distinct(each)).alias("g")).select("row", "g.k", "g.gram")
    pairs = pairs.join(keyed.hint("merge"), ["k", "gram"]).select("row", "number", "phrase")
    return pairs.join(mine, "row").where(F.contains("body", "phrase")).select("doc_id", "number").distinct()


def ngram_matches(docs: DataFrame, items: DataFrame, n: int = GRAM) -> DataFrame:
    """``item_id, doc_id, score``: the share of an item's tokens that lie in n-grams which the document has too.

    With a column ``field`` an item has several texts, and its score is the mean over them. Without a cap on hits: all
    documents that share an n-gram are there. Of a repeated n-gram of a text only the last place counts.
    """
    fields = items.select("item_id", (F.col("field") if "field" in items.columns else F.lit(0)).alias("field"), analyzed(F.col("text")).alias("t"))
    windows = F.transform(F.sequence(F.lit(1), F.size("t") - (n - 1)), lambda i: F.concat(F.lit(" "), F.array_join(F.slice("t", i, n), " "), F.lit(" ")))
    grams = fields.where(F.size("t") >= n).select("item_id", "field", F.size("t").alias("tokens"), F.posexplode(windows).alias("pos", "phrase"))
    grams = grams.groupBy("item_id", "field", "tokens", "phrase").agg(F.max("pos").alias("pos"))
    grams = materialize(grams.withColumn("number", F.xxhash64("phrase")), "item-grams")
    hits = run_hits(docs, grams.groupBy("phrase").agg(F.first("number").alias("number")))
    held = hits.join(grams.select("number", "item_id", "field", "tokens", "pos"), "number")
    covered = held.select("item_id", "field", "doc_id", "tokens", F.explode(F.sequence(F.col("pos"), F.col("pos") + (n - 1))).alias("t"))
    counts = covered.groupBy("item_id", "field", "doc_id", "tokens").agg(F.count_distinct("t").alias("covered"))
    each = counts.groupBy("item_id", "doc_id").agg(F.sum(F.col("covered") / F.col("tokens")).alias("total"))
    texts = fields.groupBy("item_id").agg(F.count_distinct("field").alias("fields"))
    return each.join(texts, "item_id").select("item_id", "doc_id", F.round(F.col("total") / F.col("fields"), 6).alias("score"))


def item_scores(matches: DataFrame, items: DataFrame) -> DataFrame:
    """Best score and first best document of every item; 0 and null without a match."""
    best = matches.groupBy("item_id").agg(F.max("score").alias("score"), F.max(F.struct("score", (-F.col("doc_id")).alias("d"))).alias("b"))
    return items.select("item_id").join(best, "item_id", "left").select(
        "item_id", F.coalesce("score", F.lit(0.0)).alias("score"), (-F.col("b.d")).alias("best_doc")
    )


def phrase_matches(docs: DataFrame, items: DataFrame) -> DataFrame:
    """``item_id, doc_id`` where the item's tokens stand in the document as one run.

    With a column ``field`` an item has several texts, and all of them must stand in the same document. An item with a text
    without tokens is nowhere.
    """
    fields = items.select("item_id", (F.col("field") if "field" in items.columns else F.lit(0)).alias("field"), F.coalesce(framed(F.col("text")), F.lit("  ")).alias("phrase"))
    fields = materialize(fields.distinct().withColumn("number", F.xxhash64("phrase")), "item-phrases")
    hits = run_hits(docs, fields.groupBy("phrase").agg(F.first("number").alias("number"))).distinct()
    found = hits.join(fields.select("number", "item_id", "field"), "number").groupBy("item_id", "doc_id").agg(F.count("*").alias("found"))
    wanted = fields.groupBy("item_id").agg(F.count("*").alias("wanted"))
    return found.join(wanted, "item_id").where("found = wanted").select("item_id", "doc_id")


def suite_matches(docs: DataFrame, sets: DataFrame, limits: dict[str, int] | None = None, n: int = GRAM) -> DataFrame:
    """``suite, item_id, doc_id, score`` of the items of many evaluation sets, ``sets(suite, item_id, field, text)``.

    All sets are searched in one pass over the documents. A limit takes the items of a set with the least ids.
    """
    if limits:
        rank = F.dense_rank().over(Window.partitionBy("suite").orderBy("item_id"))
        most = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in limits.items() for x in kv]), F.col("suite")), F.lit((1 << 31) - 1))
        capped = sets.where(F.col("suite").isin(list(limits))).withColumn("r", rank).where(F.col("r") <= most).drop("r")
        sets = sets.where(~F.col("suite").isin(list(limits))).unionByName(capped)
    keyed = sets.select(F.struct("suite", "item_id").alias("item_id"), "field", "text")
    return ngram_matches(docs, keyed, n).select("item_id.suite", "item_id.item_id", "doc_id", "score")


def suite_report(docs: DataFrame, matches: DataFrame, suites: list[str], by: str, threshold: float) -> DataFrame:
    """A row for each value of ``by``: its documents, and for each suite the share that an item of it covers above ``threshold``."""
    bad = matches.where(F.col("score") > threshold).groupBy("doc_id").agg(F.collect_set("suite").alias("suites"))
    rows = docs.select("doc_id", by).join(bad, "doc_id", "left")
    share = lambda s: F.round(F.avg(F.coalesce(F.array_contains("suites", s), F.lit(False)).cast("int")), 6).alias(s)
    return rows.groupBy(by).agg(F.count("*").alias("rows"), *(share(s) for s in suites))


def decontaminated(docs: DataFrame, bad_ids: DataFrame) -> DataFrame:
    """``docs`` without the rows whose id is among ``bad_ids(doc_id)``."""
    return docs.join(bad_ids.select("doc_id").distinct(), "doc_id", "left_anti")


def normalized(vector: Column) -> Column:
    """A vector divided by its length; zero vectors stay."""
    norm = F.sqrt(F.aggregate(vector, F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))
    return F.transform(vector, lambda x: x.cast("double") / F.when(norm > 0, norm).otherwise(1.0))


def matrix(column: pa.Array) -> np.ndarray:
    """An array column of vectors of one length as rows."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def unit_rows(column: pa.Array) -> np.ndarray:
    """The same, divided by their lengths; zero vectors stay, and one with a null or infinite component has NaN."""
    x = matrix(column).astype(np.float64)
    with np.errstate(invalid="ignore"):
        norm = np.sqrt((x * x).sum(axis=1))[:, None]
        return x / np.where(norm > 0, norm, 1.0)


def take_best(ids: np.ndarray, queries: np.ndarray, score: np.ndarray, name: np.ndarray, own: np.ndarray, x: np.ndarray, place: np.ndarray | None = None, base: int = 0) -> None:
    """Bring ``score`` and ``name``, the best of each query so far, up to date with the vectors ``x`` of ids ``own``.

    In tiles of ``TILE`` queries and vectors, so memory does not grow with either. Only scores that reach a query's last
    one are rounded and sorted. Ties go to the lesser id, and a query is not its own neighbour. ``place`` is kept with
    them: the row of each, the first of ``x`` being row ``base``.
    """
    k = score.shape[1]
    for at in range(0, len(x), TILE[1]):
        there, vectors = own[at : at + TILE[1]], x[at : at + TILE[1]].T
        for lo in range(0, len(ids), TILE[0]):
            part = slice(lo, lo + TILE[0])
            best, held, mine = score[part], name[part], ids[part]  # views
            s = queries[part] @ vectors
            floor = best[:, -1]
            if np.isneginf(floor).any():
                s[(mine[:, None] == there) | np.isnan(s)] = -np.inf
                if s.shape[1] > k:
                    floor = np.maximum(floor, np.round(np.partition(s, -k, axis=1)[:, -k], 6))
            q, j = np.divmod(np.flatnonzero(s >= (floor - 1e-6)[:, None]), s.shape[1])  # what may round to the last one, too
            value = np.round(s[q, j], 6)
            better = (value > best[q, -1]) | (there[j] < held[q, -1])
            fine = (value >= floor[q]) & (value > -np.inf) & (mine[q] != there[j]) & better
            if fine.any():
                q, j, value = q[fine], j[fine], value[fine]
                row, value, who = np.r_[q, np.repeat(np.arange(len(best)), k)], np.r_[value, best.ravel()], np.r_[there[j], held.ravel()]
                order = np.lexsort((who, -value, row))
                row = row[order]
                top = order[np.arange(len(row)) - np.searchsorted(row, np.arange(len(best)))[row] < k]
                if place is not None:
                    place[part] = np.r_[base + at + j, place[part].ravel()][top].reshape(-1, k)
                best[:], held[:] = value[top].reshape(-1, k), who[top].reshape(-1, k)


def no_best(queries: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Scores and names of queries that have met no vector."""
    return np.full((queries, k), -np.inf), np.full((queries, k), np.iinfo(np.int64).max)


def best_rows(ids: np.ndarray, score: np.ndarray, name: np.ndarray) -> pa.RecordBatch:
    """``query_id, vec_id, score`` of what queries found."""
    q, place = np.nonzero(score > -np.inf)
    return pa.RecordBatch.from_arrays([pa.array(ids[q]), pa.array(name[q, place]), pa.array(score[q, place])], ["query_id", "vec_id", "score"])


def _nearest(get, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, queries = get()
        score, name = no_best(len(ids), k)
        for batch in batches:
            if batch.num_rows:
                take_best(ids, queries, score, name, batch.column("vec_id").to_numpy(zero_copy_only=False), matrix(batch.column("vector")))
        yield best_rows(ids, score, name)

    return run


def vector_topk(vectors: DataFrame, queries: DataFrame, k: int = 5) -> DataFrame:
    """The ``k`` nearest vectors by cosine of each query other than itself: ``query_id, vec_id, score, rank``.

    Exact: blocks of queries are broadcast, each task multiplies its vectors with a block and keeps its ``k`` best, and
    those are merged. Ties go to the lesser id. Null vectors take no part. The memory of a task is bounded by a block of
    queries and a tile of scores, however many rows there are.
    """
    spark = vectors.sparkSession
    vectors, queries = (df.where(F.col("embedding").isNotNull()) for df in (vectors, queries))
    unit = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), normalized(F.col("embedding")).alias("vector"))
    wanted = materialize(queries.select(F.col("vec_id").cast("long").alias("vec_id"), normalized(F.col("embedding")).alias("vector")), "queries")
    blocks = max(1, -(-wanted.count() // QUERY_BLOCK))
    found = None
    for b in range(blocks):
        rows = wanted.where(F.pmod(F.xxhash64("vec_id"), F.lit(blocks)) == b).orderBy("vec_id").collect()
        get = share(spark, (np.array([r.vec_id for r in rows], dtype=np.int64), np.array([r.vector for r in rows], dtype=np.float64).reshape(len(rows), -1)))
        part = unit.mapInArrow(_nearest(get, k), "query_id long, vec_id long, score double")
        found = part if found is None else found.unionByName(part)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k)


def _meeting(k: int):
    """The task: the queries of one group, and then the vectors of another by their ids; the ``k`` best of each query."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked, labels, best, base = [], [], None, 0
        for batch in batches:
            cut = int(np.count_nonzero(batch.column("role").to_numpy(zero_copy_only=False) == 0))
            if cut:
                asked.append(batch.slice(0, cut))
            batch = batch.slice(cut)
            if not (asked and batch.num_rows):
                continue
            if best is None:
                queries = pa.Table.from_batches(asked).combine_chunks()
                ids, x = queries.column("vec_id").to_numpy(), np.concatenate([unit_rows(b.column("vector")) for b in asked])
                best, place = no_best(len(ids), k), np.zeros((len(ids), k), dtype=np.int64)
            take_best(ids, x, *best, batch.column("vec_id").to_numpy(zero_copy_only=False), unit_rows(batch.column("vector")), place, base)
            labels.append(batch.column("label"))
            base += batch.num_rows
        if best is not None:
            score, name = best
            q, at = np.nonzero(score > -np.inf)
            found = [pa.array(ids[q]), queries.column("label").take(pa.array(q)), pa.array(name[q, at]), pa.chunked_array(labels).take(pa.array(place[q, at])), pa.array(score[q, at])]
            yield from pa.table(found, names=["query_id", "query_label", "vec_id", "label", "score"]).combine_chunks().to_batches()

    return run


def vector_neighbours(vectors: DataFrame, k: int = 5) -> DataFrame:
    """The ``k`` nearest vectors by cosine of every vector, with the labels of both: ``query_id, query_label, vec_id, label, score, rank``.

    The same rows as those of :func:`vector_topk` with all vectors as queries, but nothing passes through the driver: rows
    are dealt into groups by a hash of the id, and each two groups meet in a task of their own, so work grows with the
    square of the rows and a task's memory with a group. Rows with a null id or vector take no part. Labels come along, for
    a join by ids would bring all copies of a vector to the few that are nearest to them.
    """
    rows = vectors.where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull())
    rows = rows.select(F.col("vec_id").cast("long").alias("vec_id"), "label", F.col("embedding").alias("vector"))
    most, least = GROUP_ROWS
    count, tasks = rows.count(), 2 * vectors.sparkSession.sparkContext.defaultParallelism
    groups = max(1, -(-count // most), min(math.ceil(math.sqrt(tasks)), count // least))
    mine, each = F.pmod(F.xxhash64("vec_id"), F.lit(groups)).cast("int"), F.explode(F.sequence(F.lit(0), F.lit(groups - 1)))
    asked = rows.select(F.lit(0).alias("role"), mine.alias("asks"), each.alias("answers"), "*")
    there = rows.select(F.lit(1).alias("role"), each.alias("asks"), mine.alias("answers"), "*")
    met = asked.unionByName(there).repartitionById(groups * groups, F.col("asks") * groups + F.col("answers"))
    met = met.sortWithinPartitions("role", "vec_id").drop("asks", "answers")
    label = dict(rows.dtypes)["label"]
    found = met.mapInArrow(_meeting(k), f"query_id long, query_label {label}, vec_id long, label {label}, score double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k)
