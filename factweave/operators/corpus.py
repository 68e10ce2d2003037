"""From texts to sections, token windows and term weights."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factweave.operators.ranking import top
from factweave.session import cut

TOKEN = r"[\p{L}\p{N}_]+|[^\p{L}\p{N}_\s]"
TERMS = 10_000
TERM = r"[\p{L}\p{N}_]+"


def sections(docs: DataFrame, key: str, text: str) -> DataFrame:
    """key, section_no, title, text: the parts under each heading line; blank parts are left out.

    Lines before the first heading have the title ``Document``, an empty heading is ``Untitled``.
    """
    d = docs.where(F.col(key).isNotNull() & F.col(text).isNotNull())
    d = d.select(key, F.posexplode(F.split(F.concat(F.lit("\n"), text), r"\n(?=[ \t]*#)")).alias("section_no", "part"))
    line, body = F.substring_index("part", "\n", 1), F.when(F.contains(F.col("part"), F.lit("\n")), F.expr("substring(part, instr(part, '\n') + 1)")).otherwise("")
    name = F.regexp_replace(line, r"^[ \t]*[# ]+|[# ]+$", "")
    title = F.when(F.col("section_no") == 0, "Document").when(name == "", "Untitled").otherwise(name)
    body = F.when(F.col("section_no") == 0, F.expr("substring(part, 2)")).otherwise(body)
    return d.select(key, "section_no", title.alias("title"), body.alias("text")).where(F.col("text").rlike(r"\S"))


def windows(docs: DataFrame, key: str, text: str, size: int = 512, overlap: int = 96) -> DataFrame:
    """key, chunk_no, tokens: sliding windows of tokens; the last one reaches the end of the text."""
    if not 0 <= overlap < size:
        raise ValueError("overlap must be at least 0 and below size")
    step = size - overlap
    d = docs.select(key, F.regexp_extract_all(text, F.lit(TOKEN), 0).alias("t")).where(F.size("t") > 0)
    last = F.greatest(F.lit(0), F.ceil((F.size("t") - size) / step)).cast("int")
    d = d.select(key, "t", F.explode(F.sequence(F.lit(0), last)).alias("chunk_no"))
    return d.select(key, "chunk_no", F.slice("t", F.col("chunk_no") * step + 1, size).alias("tokens"))


def placed_windows(docs: DataFrame, key: str, text: str, size: int = 512, overlap: int = 96) -> DataFrame:
    """key, chunk_no, start_char, end_char: where the windows lie in the tokens joined by one blank each."""
    step = size - overlap
    d = docs.select(key, F.transform(F.regexp_extract_all(text, F.lit(TOKEN), 0), F.length).alias("n")).where(F.size("n") > 0)
    last = F.greatest(F.lit(0), F.ceil((F.size("n") - size) / step)).cast("int")
    d = d.select(key, "n", F.explode(F.sequence(F.lit(0), last)).alias("chunk_no"))
    length = lambda a: F.aggregate(a, F.lit(0), lambda s, x: s + x + 1)
    start = length(F.slice("n", 1, F.col("chunk_no") * step))
    return d.select(key, "chunk_no", start.alias("start_char"), (start + length(F.slice("n", F.col("chunk_no") * step + 1, size)) - 1).alias("end_char"))


def bm25(docs: DataFrame, queries: DataFrame, k: int = 10, k1: float = 1.5, b: float = 0.75) -> DataFrame:
    """query_id, doc_id, score, rank: the k best documents of each query.

    docs: doc_id, text. queries: query_id, text. Only the postings of query terms are shuffled: texts are read once, and what
    is written of them is how long they are and how often they hold the terms that are asked for (an asked term
    is looked up in the tasks while there are at most TERMS, and joined beyond). Documents without terms score nothing; ties go to the smaller doc_id.
    """
    low = lambda c: F.regexp_extract_all(F.lower(F.coalesce(c, F.lit(""))), F.lit(TERM), 0)
    asked = queries.select("query_id", F.explode(F.array_distinct(low(F.col("text")))).alias("term"))
    names = asked.select("term").distinct()
    d = docs.select("doc_id", low(F.col("text")).alias("terms"))
    known = [r.term for r in names.limit(TERMS + 1).collect()]
    if len(known) <= TERMS:
        d = d.select("doc_id", F.size("terms").alias("dl"), F.array_intersect("terms", F.lit(known) if known else F.array().cast("array<string>")).alias("held"), "terms")
        d = d.select("doc_id", "dl", F.transform("held", lambda t: F.struct(t.alias("term"), F.size(F.filter("terms", lambda x: x == t)).alias("tf"))).alias("held"))
    else:
        each = d.select("doc_id", F.size("terms").alias("dl"), F.explode_outer("terms").alias("term"))
        each = each.join(names.withColumn("asked", F.lit(1)), "term", "left").groupBy("doc_id", "dl", "term").agg(F.count("asked").alias("tf"))
        d = each.groupBy("doc_id", "dl").agg(F.collect_list(F.when(F.col("tf") > 0, F.struct("term", F.col("tf").cast("int").alias("tf")))).alias("held"))
    d = cut(d)
    stats = d.agg(F.count(F.lit(1)).alias("n"), F.avg("dl").alias("avgdl")).first()
    post = d.select("doc_id", "dl", F.explode("held").alias("h")).select("doc_id", "dl", "h.term", "h.tf")
    df = post.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    idf = F.log(1 + (stats.n - F.col("df") + 0.5) / (F.col("df") + 0.5))
    weights = asked.join(df.hint("merge"), "term").withColumn("idf", idf).select("query_id", "term", "idf")
    weights = F.broadcast(weights) if asked.count() <= 10 * TERMS else weights.hint("merge")
    part = F.col("idf") * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("dl") / F.lit(stats.avgdl or 1.0)))
    scores = post.join(weights, "term").groupBy("query_id", "doc_id").agg(F.round(F.sum(part), 6).alias("score"))
    return top(scores, ["query_id"], [F.col("score").desc(), F.col("doc_id")], k)
