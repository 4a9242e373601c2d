"""Near-duplicate removal, sentence frequencies, query extraction and removal over document tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seriatim.functions import text as tx
from seriatim.sources.tables import require



def norm_key(c: Column | str) -> Column:
    """Lower case, digits gone, everything but a-z a blank, blanks single: the key of near-equal texts."""
    plain = F.regexp_replace(F.lower(c), r"\p{Nd}", "")
    return F.trim(F.regexp_replace(F.regexp_replace(plain, "[^a-z ]", " "), " +", " "))


def sentence_key(c: Column | str) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(c), "[^a-z ]", " "), " +", " "))


def words(c: Column | str, pattern: str = "[a-z0-9]+") -> Column:
    """Tokens of the lower-cased text."""
    return F.regexp_extract_all(F.lower(c), F.lit(pattern), F.lit(0))


def leaks(query: Column, target: Column, chars: int = 60) -> Column:
    head = F.substring(norm_key(query), 1, chars)
    return (head != "") & F.contains(norm_key(target), head)


def deduplicated(df: DataFrame, id_column: str, text: str, least: int = 0) -> DataFrame:
    """Of each normalised text the row with the smallest id; shorter and null texts are left out first.

    The survivor of a key is a grouped minimum, so a text that a third of all rows share costs one row per map task.
    """
    require(df, [id_column, text])
    long = df.where(F.col(text).isNotNull() & (F.length(text) >= least))
    keep = long.groupBy(F.md5(norm_key(text)).alias("_key")).agg(F.min(id_column).alias(id_column)).select(id_column)
    return long.join(keep, id_column, "left_semi")


def sentence_table(df: DataFrame, id_column: str, text: str) -> DataFrame:
    """Sentences in order: id, pos, sentence, key. Three projections, so that each step's array is built once."""
    own = df.select(F.col(id_column).alias("id"), tx.lines(F.col(text)).alias("own"))
    whole = own.select("id", tx.unwrapped(F.col("own")).alias("whole"))
    s = whole.select("id", F.posexplode(tx.sentences(F.col("whole"))).alias("pos", "sentence"))
    return s.withColumn("key", sentence_key("sentence"))


def frequent_keys(table: DataFrame, more_than: int = tx.MAX_DOCUMENTS, least_words: int = 6) -> DataFrame:
    """Keys of sentences of six words or more that stand in more documents than that: key, documents."""
    long = table.where(F.size(F.split(F.trim("sentence"), r"\s+")) >= least_words)
    return long.select("id", "key").distinct().groupBy("key").agg(F.count("*").alias("documents")).where(F.col("documents") > more_than)


def prose(table: DataFrame) -> DataFrame:
    """The sentences that are prose and rare: no key of theirs stands in more than MAX_DOCUMENTS documents."""
    return table.where(tx.is_prose_form(F.col("sentence"))).join(frequent_keys(table).select("key"), "key", "left_anti")


def prose_runs(p: DataFrame) -> DataFrame:
    """Prose sentences with their run of neighbours: id, pos, sentence, run, place (from 0), length."""
    by = Window.partitionBy("id").orderBy("pos")
    r = p.withColumn("run", F.col("pos") - F.row_number().over(by))
    of = Window.partitionBy("id", "run")
    return r.withColumn("place", F.row_number().over(of.orderBy("pos")) - 1).withColumn("length", F.count("*").over(of))


def narrative_queries(df: DataFrame, id_column: str, text: str, take: int = 2) -> DataFrame:
    """A document's query: the first sentences of its first longest run of rare prose: id, query; others are absent."""
    r = prose_runs(prose(sentence_table(df, id_column, text)))
    first = F.row_number().over(Window.partitionBy("id").orderBy(F.col("length").desc(), "run", "pos"))
    best = r.withColumn("_n", first).where((F.col("_n") <= take) & (F.col("place") < take))
    joined = best.groupBy("id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "sentence"))), lambda x: x["sentence"]), " ").alias("query"))  # `take` sentences each
    return joined.withColumnRenamed("id", id_column)


def windows(df: DataFrame, id_column: str, text: str, size: int = 2) -> DataFrame:
    """All non-overlapping windows of neighbouring rare prose sentences: id, window, query.

    A prose sentence has ten words, so in a run every window of the size qualifies.
    """
    r = prose_runs(prose(sentence_table(df, id_column, text)))
    w = r.withColumn("k", F.floor(F.col("place") / size)).where((F.col("k") + 1) * size <= F.col("length"))
    q = w.groupBy("id", "run", "k").agg(F.min("pos").alias("pos"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "sentence"))), lambda x: x["sentence"]), " ").alias("query"))
    n = F.row_number().over(Window.partitionBy("id").orderBy("pos")) - 1
    return q.withColumn("window", n).select(F.col("id").alias(id_column), "window", "query")


def drawn_windows(w: DataFrame, id_column: str, k: int, seed: str = "s") -> DataFrame:
    """k windows of every document that has as many, drawn by hash: id, window, query."""
    by = Window.partitionBy(id_column)
    order = F.md5(F.concat(F.lit(f"{seed}:"), F.col(id_column).cast("string"), F.lit(":"), F.col("window")))
    return w.withColumn("_n", F.count("*").over(by)).withColumn("_k", F.row_number().over(by.orderBy(order))).where((F.col("_n") >= k) & (F.col("_k") <= k)).drop("_n", "_k")


def removed(df: DataFrame, text: str, queries: Sequence[str], name: str = "target") -> DataFrame:
    """Rows with `name`: the text without the stretch that each query was taken from, in turn, blanks single.

    Texts are compared by letters alone. Of the first start with a qualifying stretch the best is
    cut out (the shortest on ties). Failing that, the longest beginning of the query that stands in
    the text goes with twice as many words; else nothing goes. A null query takes nothing.
    """
    df = df.withColumn("_w", tx.tokens(F.col(text)))
    for query in queries:
        df = df.withColumn("_q", tx.content(F.coalesce(query, F.lit("")))).withColumn("_c", F.transform("_w", tx.letters))
        df = df.withColumn("_s", tx.stretches(F.col("_c"), F.col("_q"))).withColumn("_b", F.when(F.col("_s").isNull(), tx.longest_beginning(F.col("_c"), F.col("_q"))))
        df = df.withColumn("_s", F.array_max("_s"))
        start = F.coalesce(F.col("_s.start"), -F.col("_b.minus"))
        stop = F.coalesce(F.col("_s.stop"), -F.col("_b.minus") + 2 * F.col("_b.n"))
        left = F.concat(F.slice("_w", 1, start), F.slice("_w", stop + 1, F.greatest(F.size("_w"), F.lit(1))))
        df = df.withColumn("_w", F.when(start.isNull(), F.col("_w")).otherwise(left))
    return df.withColumn(name, F.array_join("_w", " ")).drop("_w", "_q", "_c", "_s", "_b")


def located(df: DataFrame, text: str, query: str, name: str = "at") -> DataFrame:
    """Rows with `name`: the character at which the first qualifying stretch begins, or -1."""
    df = df.withColumn("_q", tx.content(F.coalesce(query, F.lit("")))).withColumn("_p", F.regexp_extract_all(text, F.lit(r"\s*\S+"), F.lit(0)))
    df = df.withColumn("_c", F.transform("_p", tx.letters)).withColumn("_s", F.try_element_at(tx.stretches(F.col("_c"), F.col("_q")), F.lit(1))["start"])
    before = F.length(F.array_join(F.slice("_p", 1, F.col("_s")), ""))
    own = F.try_element_at("_p", F.col("_s") + 1)
    at = before + F.length(own) - F.length(F.regexp_replace(own, r"^\s+", ""))
    return df.withColumn(name, F.coalesce(at, F.lit(-1))).drop("_q", "_p", "_c", "_s")


def chunk_at(text: str, offset: Column, size: int = 510, stride: int = 384) -> tuple[Column, Column]:
    """The chunk of words that first holds a character, and the number of chunks; -1 and 0 without words."""
    n = F.size(tx.tokens(F.col(text)))
    word = F.size(F.regexp_extract_all(F.substring(text, F.lit(1), offset + 1), F.lit(r"\S+"), F.lit(0))) - 1
    chunks = F.when(n == 0, 0).otherwise(1 + F.ceil(F.greatest(F.lit(0), n - size) / stride)).cast("int")
    holds = F.when(word < size, 0).otherwise(F.least(F.floor((word - size + stride) / stride), chunks - 1))
    return F.when(n == 0, -1).otherwise(holds).cast("int"), chunks


def pairs(df: DataFrame, id_column: str, text: str, queries: DataFrame, least: int = 100) -> DataFrame:
    """Queries with the target they are removed from, and why a pair is not usable: id, query, target, reason.

    reason: ok, no_query, gutted (target too short), leak (the target still holds the query's beginning).
    """
    t = removed(df.select(id_column, text).where(F.col(text).isNotNull()).join(queries, id_column, "left"), text, ["query"])
    reason = F.when(F.col("query").isNull(), "no_query").when(F.length("target") < least, "gutted").when(leaks(F.col("query"), F.col("target")), "leak").otherwise("ok")
    return t.select(id_column, "query", "target", reason.alias("reason"))


def several_removed(df: DataFrame, id_column: str, text: str, queries: DataFrame, k: int, least: int = 100) -> DataFrame:
    """Documents with k queries (id, window, query), all taken out in the order of their windows: id, target, reason.

    reason: gutted (target too short), leak (it still holds the beginning of any of them), ok.
    """
    n = F.row_number().over(Window.partitionBy(id_column).orderBy("window"))
    wide = queries.withColumn("_n", n).where(F.col("_n") <= k).groupBy(id_column).agg(*[F.max(F.when(F.col("_n") == i, F.col("query"))).alias(f"_q{i}") for i in range(1, k + 1)])
    names = [f"_q{i}" for i in range(1, k + 1)]
    t = removed(df.select(id_column, text).where(F.col(text).isNotNull()).join(wide, id_column), text, names)
    leak = F.lit(False)
    for q in names:
        leak = leak | F.coalesce(leaks(F.col(q), F.col("target")), F.lit(False))
    return t.select(id_column, "target", F.when(F.length("target") < least, "gutted").when(leak, "leak").otherwise("ok").alias("reason"))


def word_frequency(df: DataFrame, id_column: str, text: str, pattern: str = "[a-z]{3,}") -> DataFrame:
    """Documents that hold each word: word, documents."""
    return df.select(F.explode(F.array_distinct(words(text, pattern))).alias("word")).groupBy("word").agg(F.count("*").alias("documents"))


def mean_idf(queries: DataFrame, id_column: str, query: str, frequency: DataFrame, total: int, pattern: str = "[a-z]{3,}") -> DataFrame:
    """Mean log(total / (1 + documents)) of a query's words, and the share of words that no document holds."""
    q = queries.select(id_column, F.explode(words(query, pattern)).alias("word")).join(frequency, "word", "left")
    idf = F.log(F.lit(float(total)) / (1 + F.coalesce("documents", F.lit(0))))
    return q.groupBy(id_column).agg(F.avg(idf).alias("mean_idf"), F.avg(F.col("documents").isNull().cast("double")).alias("missing"))
