"""BM25, vector similarity, score fusion, top-k, recall, prompt assembly."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestone.functions import text as X
from lodestone.session import broadcast_if_small, stored

K1, B, EPSILON = 1.5, 0.75, 0.25


def chunks(parts: DataFrame, key: str, order: list[str], text: str = "text") -> DataFrame:
    """One text per key from its parts in order, fragments that were already said left out; (key, text, char_len)."""
    g = parts.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct(*order, F.coalesce(text, F.lit("")).alias("_t")))), lambda s: X.strip(s["_t"])).alias("p"))
    whole = F.array_join(X.dedup_parts(F.col("p")), "\n")
    return g.select(key, whole.alias("text"), F.length(whole).alias("char_len"))


def bm25_index(docs: DataFrame, doc_id: str = "doc_id", tokens: Column | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(postings(term, doc_id, tf), lengths(doc_id, dl), idf(term, idf)); negative idf becomes EPSILON times the mean idf.

    Texts are read and cut into tokens once: the posting table is written, and all figures come from it.
    """
    tokens = X.tokens(F.coalesce(F.col("text"), F.lit(""))) if tokens is None else tokens
    listed = docs.select(F.col(doc_id).alias("doc_id"), tokens.alias("t"))
    # a document without tokens keeps one row, with no term, so that it counts in the lengths
    postings = stored(listed.select("doc_id", F.explode_outer("t").alias("term")).groupBy("term", "doc_id").agg(F.count("term").alias("tf")), "postings")
    lengths = stored(postings.groupBy("doc_id").agg(F.sum("tf").alias("dl")), "lengths")
    n = lengths.agg(F.count("*").alias("n")).first()["n"]
    raw = postings.where("term is not null").groupBy("term").agg(F.count("*").alias("df"))
    raw = stored(raw.select("term", F.log((n - F.col("df") + 0.5) / (F.col("df") + 0.5)).alias("raw")), "idf")
    mean = raw.agg(F.avg("raw").alias("mean")).first()["mean"] or 0.0
    return postings.where("term is not null"), lengths, raw.select("term", F.when(F.col("raw") < 0, F.lit(EPSILON * mean)).otherwise(F.col("raw")).alias("idf"))


def index_is_sound(postings: DataFrame, lengths: DataFrame, idf: DataFrame) -> DataFrame:
    """One row of counts that are 0 in a sound index: postings without a length, without an idf, repeated ones, and lengths that differ from their sum."""
    by_doc = postings.groupBy("doc_id").agg(F.count("*").alias("n"), F.sum("tf").alias("s"))  # sums travel, not the postings
    met = by_doc.join(lengths.select("doc_id", "dl", F.lit(True).alias("has")), "doc_id", "full")
    lengths_met = met.agg(F.coalesce(F.sum(F.when(F.col("has").isNull(), F.col("n"))), F.lit(0)).alias("no_length"), F.count(F.when(F.col("has") & (F.col("dl") != F.coalesce("s", F.lit(0))), 1)).alias("wrong_length"))
    by_term = postings.groupBy("term").agg(F.count("*").alias("n"))
    no_idf = by_term.join(idf, "term", "left_anti").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("no_idf"))
    repeated = postings.groupBy("term", "doc_id").count().where("count > 1").agg(F.count("*").alias("repeated"))
    one = lambda df: F.broadcast(df.withColumn("_k", F.lit(1)))  # noqa: E731  a single row each
    found = lengths_met.withColumn("_k", F.lit(1)).join(one(no_idf), "_k").join(one(repeated), "_k")
    return found.select("no_length", "no_idf", "repeated", "wrong_length")


def save_index(index: tuple[DataFrame, DataFrame, DataFrame], path: str) -> None:
    """Write an index's three tables under a path."""
    for name, df in zip(("postings", "lengths", "idf"), index, strict=True):
        df.write.mode("overwrite").parquet(f"{path}/{name}")


def load_index(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """An index's tables; raises if one is missing or they do not fit together."""
    index = tuple(spark.read.parquet(f"{path}/{name}") for name in ("postings", "lengths", "idf"))
    faults = {k: v for k, v in index_is_sound(*index).first().asDict().items() if v}
    if faults:
        raise ValueError(f"broken index: {faults}")
    return index


def bm25_scores(queries: DataFrame, docs: DataFrame, qid: str = "item_id", doc_id: str = "doc_id", index: tuple[DataFrame, DataFrame, DataFrame] | None = None) -> DataFrame:
    """(qid, doc_id, bm25) for documents with a query term; a repeated query term counts again.

    Statistics come from the whole corpus; the queries' terms get their idf first and travel to the postings, which
    stay where they are as long as the terms are few, and only what they hit goes on.
    """
    postings, lengths, idf = index or bm25_index(docs, doc_id)
    terms = queries.select(F.col(qid).alias("qid"), F.explode(X.tokens(F.coalesce(F.col("text"), F.lit("")))).alias("term")).groupBy("qid", "term").agg(F.count("*").alias("qtf"))
    terms = stored(terms.join(idf, "term").select("qid", "term", (F.col("qtf") * F.col("idf")).alias("qw")), "terms")
    mean = lengths.agg(F.avg("dl").alias("avgdl")).first()["avgdl"] or 1.0
    norm = lengths.select("doc_id", (K1 * (1 - B + B * F.col("dl") / F.lit(float(mean) or 1.0))).alias("norm"))
    hits = postings.join(broadcast_if_small(terms, 64), "term").join(broadcast_if_small(norm, 32), "doc_id")
    weight = F.col("qw") * F.col("tf") * (K1 + 1) / (F.col("tf") + F.col("norm"))
    return hits.groupBy("qid", "doc_id").agg(F.sum(weight).alias("bm25"))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, v: s + v)


def unit_vector(v: Column) -> Column:
    """Scaled to length one; null for a zero vector."""
    norm = F.sqrt(dot(v, v))
    return F.when(norm > 0, F.transform(v, lambda x: x.cast("double") / norm))


def cosine_scores(queries: DataFrame, vectors: DataFrame, limit_bytes: int = 32 << 20) -> DataFrame:
    """(qid, vec_id, cos) of a stated query set against all vectors, neither being the other's row.

    Queries are a table (qid, v), cut into blocks of at most ``limit_bytes``; each block alone travels to the vectors,
    in a pass of its own, and a candidate row is compared with it inside one expression.
    """
    size = queries.agg(F.coalesce(F.sum(8 * F.size("v") + 16), F.lit(0))).first()[0]
    blocks = max(1, -(-size // limit_bytes))
    unit = queries.select("qid", unit_vector(F.col("v")).alias("q"), F.pmod(F.xxhash64("qid"), F.lit(blocks)).cast("int").alias("block"))
    unit = stored(unit, "queries") if blocks > 1 else unit
    rows = vectors.select("vec_id", unit_vector(F.col("v")).alias("u"), F.lit(1).alias("_k"))
    out = None
    for block in range(blocks):
        packed = unit.where(F.col("block") == block).groupBy().agg(F.collect_list(F.struct("qid", "q")).alias("qs")).withColumn("_k", F.lit(1))
        met = rows.join(F.broadcast(packed), "_k").select("vec_id", F.explode(F.transform("qs", lambda s: F.struct(s["qid"].alias("qid"), dot(s["q"], F.col("u")).alias("cos")))).alias("s"))
        one = met.select("s.qid", "vec_id", "s.cos").where("qid <> vec_id and cos is not null")
        out = one if out is None else out.unionAll(one)
    return out


def fused(scores: DataFrame, alpha: float = 0.5, mode: str = "hybrid") -> DataFrame:
    """Adds score to (qid, doc_id, vec, bm25): each signal scaled to [0, 1] within the query's live documents, then mixed.

    mode 'vector' or 'bm25' uses that signal as it is; a signal that the table lacks raises.  Least and greatest values
    are an aggregate that combines before its shuffle, one row a query, joined back: no task holds a query's documents.
    """
    if missing := {"vector": {"vec"}, "bm25": {"bm25"}}.get(mode, {"vec", "bm25"}) - set(scores.columns):
        raise ValueError(f"no signal {', '.join(sorted(missing))}: choose another mode")
    if mode != "hybrid":
        return scores.withColumn("score", F.col("vec" if mode == "vector" else "bm25"))
    scores = stored(scores, "scores")
    ends = stored(scores.groupBy("qid").agg(*(f(c).alias(f"_{f.__name__}_{c}") for c in ("vec", "bm25") for f in (F.min, F.max))), "ends")
    scaled = lambda c: F.when(F.col(f"_max_{c}") - F.col(f"_min_{c}") < 1e-9, 0.0).otherwise((F.col(c) - F.col(f"_min_{c}")) / (F.col(f"_max_{c}") - F.col(f"_min_{c}")))
    out = scores.join(broadcast_if_small(ends, 64), "qid")
    return out.withColumn("score", alpha * scaled("vec") + (1 - alpha) * scaled("bm25")).select(*scores.columns, "score")


def alive(scores: DataFrame, live: DataFrame, item: str = "doc_id") -> DataFrame:
    """Scores of live documents only: what a condition removed takes no part, in scaling neither."""
    return scores.join(live.select(item).distinct(), item, "left_semi")


def top_k(scores: DataFrame, k: int = 5, by: str = "score", item: str = "doc_id") -> DataFrame:
    """Best k per query, ties to the smaller id; adds rank from 1."""
    w = Window.partitionBy("qid").orderBy(F.desc(by), item)
    return scores.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def recall(retrieved: DataFrame, gold: DataFrame, live: DataFrame) -> DataFrame:
    """(qid, n_gold, n_alive, n_hit, recall, any_hit): of a question's gold that is alive, how much was retrieved.

    ``live`` is (doc_id); questions none of whose gold is alive are left out.
    """
    hit = retrieved.select("qid", "doc_id", F.lit(1).alias("hit")).distinct()
    rows = gold.select("qid", "doc_id").distinct().join(live.select("doc_id", F.lit(1).alias("alive")).distinct(), "doc_id", "left").join(hit, ["qid", "doc_id"], "left")
    g = rows.groupBy("qid").agg(F.count("*").alias("n_gold"), F.count("alive").alias("n_alive"), F.count(F.when(F.col("alive") == 1, F.col("hit"))).alias("n_hit")).where("n_alive > 0")
    return g.withColumn("recall", F.round(F.col("n_hit") / F.col("n_alive"), 6)).withColumn("any_hit", F.col("n_hit") > 0)


def auto_status(n_gold: Column, n_live: Column, answerable: Column) -> Column:
    return F.when(~answerable, "oos").when(n_live == 0, "none").when(n_live == n_gold, "full").otherwise("partial")


def prompts(questions: DataFrame, retrieved: DataFrame, template: str = "[근거]\n{context}\n\n[질문]\n{question}", cap: int = 1200) -> DataFrame:
    """(qid, prompt, prompt_chars): retrieved texts in rank order, each cut to ``cap`` characters, put into a template."""
    context = retrieved.groupBy("qid").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "text"))), lambda s: F.concat(F.lit("["), s["rank"].cast("string"), F.lit("] "), F.substring(s["text"], 1, cap))), "\n\n").alias("context"))
    whole = questions.join(context, "qid", "left").withColumn("context", F.coalesce("context", F.lit("")))
    made = F.replace(F.replace(F.lit(template), F.lit("{context}"), F.col("context")), F.lit("{question}"), F.col("question"))
    return whole.select("qid", made.alias("prompt"), F.length(made).alias("prompt_chars"))
