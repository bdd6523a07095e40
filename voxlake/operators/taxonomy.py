"""Taxonomy discovery and upkeep: topics by clustering, their keywords and labels, merging, and the category dimension."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as X
from ..sources.scratch import stored
from ..functions.tokenizers import tokenised
from .features import folded, terms
from .vectors import centroids, dot, norm, normalised, top_k

MAX_TOPICS = 2000


def least_topic_size(n) -> Column:
    """0.15 % of the documents, from 30 to 300."""
    n = F.col(n) if isinstance(n, str) else n
    return F.greatest(F.lit(30), F.least(F.lit(300), F.floor(n * 0.0015))).cast("long")


def clustered(vectors: DataFrame, k: int, seed: int = 42) -> DataFrame:
    """doc_id, vector in; with topic (a k-means cluster by cosine), its members and the cosine to its centre, as a table. A
    vector without a direction (null, zero or not finite, as of a text without words) is in no cluster: topic -1, no members."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    given = stored(vectors.withColumn("_length", norm("vector")))
    some = F.coalesce((F.col("_length") > 0) & (F.col("_length") < float("inf")), F.lit(False))
    none = given.where(~some).drop("_length").withColumns({"topic": F.lit(-1), "members": F.lit(0).cast("long"), "cosine": F.lit(0.0)})
    rows = given.where(some).drop("_length")
    if rows.isEmpty():
        return stored(none)
    rows = rows.withColumn("features", array_to_vector(F.transform("vector", lambda x: x.cast("double"))))
    rows = stored(KMeans(k=k, seed=seed, distanceMeasure="cosine", featuresCol="features", predictionCol="topic").fit(rows).transform(rows).drop("features"))
    c = centroids(rows, "topic", "vector").join(rows.groupBy("topic").agg(F.count("*").alias("members")), "topic")
    near = dot("vector", "centroid") / (norm("vector") * norm("centroid"))
    return stored(rows.join(c, "topic").withColumn("cosine", near).drop("centroid").unionByName(none))


def topics_of(found: DataFrame, least_size: int, least_cosine: float = 0.0) -> DataFrame:
    """``clustered`` rows with topic -1 in small clusters and for members far from the centre."""
    keep = (F.col("members") >= least_size) & (F.col("cosine") >= least_cosine)
    return found.withColumn("topic", F.when(keep, F.col("topic")).otherwise(-1)).drop("members", "cosine")


def cluster(vectors: DataFrame, k: int, least_size: int, least_cosine: float = 0.0, seed: int = 42) -> DataFrame:
    return topics_of(clustered(vectors, k, seed), least_size, least_cosine)


def discover(vectors: DataFrame, k: int, least_size: int, wanted: int = 5, floor: int = 15, least_cosine: float = 0.0, seed: int = 42) -> DataFrame:
    """``cluster`` with half the least size again and again until there are enough topics or the floor is met. The clusters
    are the same at every size, so they are fitted once."""
    found = clustered(vectors, k, seed)
    sizes = found.where("topic >= 0").groupBy("topic").agg(F.count_if(F.col("cosine") >= least_cosine).alias("near"), F.max("members").alias("members")).where("near > 0")
    while least_size > floor and sizes.where(F.col("members") >= least_size).count() < wanted:
        least_size = max(floor, least_size // 2)
    return topics_of(found, least_size, least_cosine)


def discover_by_platform(vectors: DataFrame, k: int, platform: str = "platform", **options) -> DataFrame:
    """``discover`` for the documents of each platform on their own, with the least size of its number of documents. The loop
    is over platforms, up to 1000 of them."""
    sizes = vectors.groupBy(platform).agg(F.count("*").alias("n")).select(platform, least_topic_size("n")).orderBy(platform).limit(1001).collect()
    if len(sizes) > 1000:
        raise ValueError("topics are found by platform for up to 1000 platforms")
    parts = [discover(vectors.where(F.col(platform).eqNullSafe(F.lit(name))), k, least, **options) for name, least in sizes]
    return reduce(DataFrame.union, parts) if parts else vectors.withColumn("topic", F.lit(None).cast("int"))


def _components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """id and label (the smallest id that undirected edges (a, b) reach): the least label around, then the label's label,
    until nothing changes. A round is a stored table."""
    both = stored(edges.select("a", "b").union(edges.select("b", "a")).distinct())
    labels = stored(nodes.select("id", F.col("id").alias("label")))
    while True:
        around = both.join(labels, F.col("a") == F.col("id")).groupBy("b").agg(F.min("label").alias("near"))
        step = stored(labels.join(around, F.col("id") == F.col("b"), "left").select("id", "label", F.least("label", F.coalesce("near", "label")).alias("low")))
        jump = step.select(F.col("id").alias("at"), F.col("low").alias("next"))
        after = stored(step.join(jump, F.col("low") == F.col("at")).select("id", F.least("low", "next").alias("label"), (F.least("low", "next") != F.col("label")).alias("changed")))
        labels = after.select("id", "label")
        if after.where("changed").isEmpty():
            return labels


def density_topics(vectors: DataFrame, k: int = 8, least_cosine: float = 0.5, least_size: int = 5) -> DataFrame:
    """doc_id, core and topic (the smallest doc_id of its dense part, or -1) of each of the vectors (doc_id, vector).

    A document is dense where its k-th nearest neighbour (exact, by cosine, ids breaking ties) has at least ``least_cosine``.
    Dense neighbours that near belong together; another document goes to the nearest dense one among its neighbours, if it
    is that near. Parts of fewer than ``least_size`` documents, and what is near none, are noise. Sizes and number of the
    topics follow from the data."""
    unit = stored(normalised(vectors.select("doc_id", "vector").where(norm("vector") > 0), "vector"))
    found = top_k(unit.withColumnRenamed("doc_id", "query_id"), unit, k + 1).where("query_id <> doc_id")
    by = Window.partitionBy("query_id").orderBy(F.desc("score"), "doc_id")
    near = stored(found.select("query_id", "doc_id", "score").withColumn("nth", F.row_number().over(by)).where(F.col("nth") <= k))
    core = stored(near.groupBy("query_id").agg(F.count("*").alias("n"), F.min("score").alias("least")).where((F.col("n") == k) & (F.col("least") >= least_cosine)).select(F.col("query_id").alias("id")))
    close = near.where(F.col("score") >= least_cosine).join(core, F.col("doc_id") == F.col("id"), "left_semi")
    links = close.join(core, F.col("query_id") == F.col("id"), "left_semi").select(F.col("query_id").alias("a"), F.col("doc_id").alias("b"))
    parts = stored(_components(core, links))
    edge = close.join(core, F.col("query_id") == F.col("id"), "left_anti").groupBy("query_id").agg(F.min_by("doc_id", "nth").alias("to"))
    edge = edge.join(parts, F.col("to") == F.col("id")).select(F.col("query_id").alias("id"), "label", F.lit(False).alias("core"))
    placed = stored(parts.withColumn("core", F.lit(True)).unionByName(edge))
    large = placed.groupBy("label").agg(F.count("*").alias("size")).where(F.col("size") >= least_size).select(F.col("label").alias("topic"))
    kept = placed.join(large, F.col("label") == F.col("topic"))
    rows = vectors.select("doc_id").join(placed.select("id", "core"), F.col("doc_id") == F.col("id"), "left").drop("id").join(kept.select("id", "topic"), F.col("doc_id") == F.col("id"), "left")
    return rows.select("doc_id", F.coalesce("core", F.lit(False)).alias("core"), F.coalesce("topic", F.lit(-1)).alias("topic"))


def write_taxonomy(clusters: DataFrame, members: DataFrame, path: str) -> None:
    """The discovered taxonomy and which topics it was merged from, as JSON lines in two folders."""
    clusters.write.mode("overwrite").json(f"{path}/taxonomy")
    members.write.mode("overwrite").json(f"{path}/merged")


def read_taxonomy(spark: SparkSession, path: str, clusters, members) -> tuple[DataFrame, DataFrame]:
    """What ``write_taxonomy`` wrote, under the given schemas."""
    return spark.read.schema(clusters).json(f"{path}/taxonomy"), spark.read.schema(members).json(f"{path}/merged")


def topic_keywords(docs: DataFrame, topic: str = "topic", text: str = "text", n: int = 10, stop_words: list[str] | None = None, least: int = 2, tokenizer=None) -> DataFrame:
    """Class-based TF-IDF: tf in the topic times ln(1 + mean words a topic / frequency): topic, rank, term, weight.

    ``tokenizer``: a table function that gives a text's terms instead of the built-in words and pairs."""
    if tokenizer is None:
        parts = folded(docs, terms(text, False), topic, without=stop_words)
    else:
        parts = tokenised(docs, tokenizer, text, topic).groupBy(topic, F.col("token").alias("term")).agg(F.count("*").alias("n"))
        if stop_words:
            parts = parts.where(~F.exists(F.split("term", " "), lambda w: w.isin(stop_words)))
    # dealt by term once: a topic's count and the sum over the topics need no other shuffle
    tf = parts.repartition("term").groupBy(topic, "term").agg(F.sum("n").alias("tf")).withColumn("f", F.sum("tf").over(Window.partitionBy("term")))
    tf = stored(tf)
    mean = tf.agg((F.sum("tf") / F.countDistinct(topic)).alias("mean"))
    w = F.round(F.col("tf") * F.log(1 + F.col("mean") / F.col("f")), 6)
    scored = tf.where(F.col("f") >= least).join(F.broadcast(mean)).select(topic, "term", w.alias("weight"))
    order = Window.partitionBy(topic).orderBy(F.desc("weight"), "term")
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n)


def drop_noise(topics: DataFrame, nouns: DataFrame | None = None) -> DataFrame:
    """Topics (topic, keywords) without those whose keywords say nothing of their own.

    A keyword that half of the topics have is noise. A topic goes when 60 % of its keywords hold a noise word, when one noise
    word is in 70 % of them, or (given ``nouns``: word) when its first five keywords have no noun. Under three topics all stay."""
    n = topics.count()
    if n < 3:
        return topics
    words = topics.select("topic", F.explode("keywords").alias("kw")).select("topic", F.lower("kw").alias("kw"))
    noise = words.groupBy("kw").agg(F.count("*").alias("c")).where(F.col("c") >= n * 0.5).agg(F.collect_list("kw").alias("noise"))
    rows = topics.join(F.broadcast(noise)).withColumn("kws", F.transform("keywords", lambda k: F.lower(k)))
    held = F.size(F.filter("kws", lambda k: F.exists("noise", lambda w: F.contains(k, w))))
    rows = rows.where(held < 0.6 * F.greatest(F.size("kws"), F.lit(1)))
    parts = F.filter(F.flatten(F.transform("kws", lambda k: F.split(k, " "))), lambda w: F.length(w) > 2)
    top = F.array_max(F.transform(F.array_distinct(parts), lambda w: F.struct(F.size(F.filter(parts, lambda x: x == w)).alias("n"), w.alias("w"))))
    rows = rows.withColumn("top", top).where(F.coalesce((F.col("top.n") < 0.7 * F.size("kws")) | ~F.array_contains("noise", F.col("top.w")), F.lit(True)))
    if nouns is not None:
        first = rows.select("topic", F.explode(F.split(F.array_join(F.slice("kws", 1, 5), " "), " ")).alias("word")).join(nouns, "word", "left_semi").select("topic").distinct()
        rows = rows.join(first, "topic", "left_semi")
    return rows.drop("noise", "kws", "top")


def clean_label(keywords: str, stop_words: list[str]) -> Column:
    """A readable label: no stop words, short words or doubled words; one of each root or containment; four, in title case."""
    low = lambda w: F.lower(w)
    parts = lambda w: F.split(F.trim(low(w)), " ")
    good = F.filter(F.col(keywords), lambda w: ~((F.size(parts(w)) == 2) & (F.element_at(parts(w), 1) == F.element_at(parts(w), -1))) & ~low(w).isin(stop_words) & (F.length(w) > 2))
    base = F.when(F.size(good) > 0, good).otherwise(F.slice(F.col(keywords), 1, 4))
    covered = lambda seen, w: F.exists(seen, lambda e: (X.word_root(e) == X.word_root(w)) | F.contains(low(e), low(w)) | F.contains(low(w), low(e)))
    kept = F.aggregate(base, F.array().cast("array<string>"), lambda seen, w: F.when(covered(seen, w), seen).otherwise(F.concat(seen, F.array(w))))
    return F.initcap(F.array_join(F.slice(kept, 1, 4), ", "))


def merge_topics(topics: DataFrame, target: int) -> DataFrame:
    """topic, cluster: average-linkage merging of the topics' centroids by cosine distance down to ``target`` clusters.

    One group holds the centroids of all topics: a few hundred rows whatever the corpus, refused above 2000."""
    n = topics.count()
    if n > MAX_TOPICS:
        raise ValueError(f"{n} topics; merging takes up to {MAX_TOPICS}")

    def link(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("topic").reset_index(drop=True)
        v = np.stack(pdf["centroid"].to_numpy()).astype(float)
        v /= np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12)
        dist = 1 - v @ v.T
        np.fill_diagonal(dist, np.inf)
        size, of, alive = np.ones(len(v)), np.arange(len(v)), np.ones(len(v), bool)
        while alive.sum() > target:
            d = np.where(alive[:, None] & alive[None], dist, np.inf)
            i, j = sorted(np.unravel_index(d.argmin(), d.shape))
            mix = (size[i] * dist[i] + size[j] * dist[j]) / (size[i] + size[j])
            dist[i], dist[:, i] = mix, mix
            dist[i, i] = np.inf
            size[i] += size[j]
            alive[j] = False
            of[of == j] = i
        return pd.DataFrame({"topic": pdf["topic"], "cluster": of})

    return topics.select("topic", F.transform("centroid", lambda x: x.cast("double")).alias("centroid"), F.lit(1).alias("_all")).groupBy("_all").applyInPandas(link, "topic long, cluster long")


def merged_clusters(topics: DataFrame, members: DataFrame, n_keywords: int = 12, n_docs: int = 6) -> DataFrame:
    """One row for each cluster: keywords by (length - rank) * count, documents of the largest topics, platforms, sources, count.

    ``topics``: topic, platform, keywords, count, example_docs, centroid. ``members``: topic, cluster."""
    rows = topics.join(members, "topic")
    words = rows.select("cluster", "count", F.size("keywords").alias("len"), F.posexplode("keywords").alias("pos", "kw")).groupBy("cluster", F.lower("kw").alias("kw")).agg(F.sum((F.col("len") - F.col("pos")) * F.col("count")).alias("w"))
    top = words.withColumn("r", F.row_number().over(Window.partitionBy("cluster").orderBy(F.desc("w"), "kw"))).where(F.col("r") <= n_keywords)
    keywords = top.groupBy("cluster").agg(F.transform(F.array_sort(F.collect_list(F.struct("r", "kw"))), lambda s: s["kw"]).alias("keywords"))
    docs = rows.groupBy("cluster").agg(F.slice(F.array_distinct(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("count")).alias("c"), "topic", "example_docs"))), lambda s: s["example_docs"]))), 1, n_docs).alias("example_docs"))
    sums = rows.groupBy("cluster").agg(F.sum("count").alias("count"), F.array_sort(F.collect_set("platform")).alias("platforms"), F.array_sort(F.collect_list("topic")).alias("source_topics"))
    return sums.join(keywords, "cluster").join(docs, "cluster").join(centroids(rows, "cluster", "centroid"), "cluster").orderBy(F.desc("count"), "cluster")


def merge_same_names(clusters: DataFrame, n_keywords: int = 10, n_exemplars: int = 5) -> DataFrame:
    """One row for each name, whatever its case: counts added, lists joined in order, distinct and capped."""
    parts = F.array_sort(F.collect_list(F.struct((-F.col("count")).alias("c"), "name", "keywords", "exemplars", "platforms")))
    rows = clusters.groupBy(F.lower(F.trim("name")).alias("_n")).agg(parts.alias("p"), F.sum("count").alias("count"))
    union = lambda f, n: F.slice(F.array_distinct(F.flatten(F.transform("p", lambda s: s[f]))), 1, n)
    return rows.select(F.element_at("p", 1)["name"].alias("name"), "count", union("keywords", n_keywords).alias("keywords"), union("exemplars", n_exemplars).alias("exemplars"), F.array_sort(F.array_distinct(F.flatten(F.transform("p", lambda s: s["platforms"])))).alias("platforms"))


def discovery_stats(topics: DataFrame, merged: DataFrame) -> DataFrame:
    by = topics.groupBy("platform").agg(F.count("*").alias("topics"), F.sum("count").alias("docs"), F.min("count").alias("smallest"))
    return by.unionByName(merged.agg(F.lit("merged").alias("platform"), F.count("*").alias("topics"), F.sum("count").alias("docs"), F.min("count").alias("smallest")))


def category_key(name: str) -> Column:
    return F.btrim(F.regexp_replace(F.lower(F.col(name)), "[^a-z0-9]+", "_"), F.lit("_"))


def upsert(categories: DataFrame, incoming: DataFrame) -> DataFrame:
    """The dimension after incoming (key, name, description): new keys added, known ones renamed in place, none deleted."""
    new = incoming.select(F.coalesce("key", category_key("name")).alias("key"), F.col("name").alias("n"), F.col("description").alias("d"))
    out = categories.join(new, "key", "full_outer")
    return out.select("key", F.coalesce("n", "name").alias("name"), F.coalesce("d", "description").alias("description"), F.coalesce("is_active", F.lit(True)).alias("is_active"))


def violations(categories: DataFrame) -> DataFrame:
    """Blank keys or names, and keys that stand more than once."""
    n = categories.groupBy("key").agg(F.count("*").alias("n"), F.count_if(F.trim(F.coalesce("name", F.lit(""))) == "").alias("blank"))
    return n.where((F.col("n") > 1) | (F.col("blank") > 0) | (F.trim(F.coalesce("key", F.lit(""))) == ""))


def retire(categories: DataFrame, keys: DataFrame) -> DataFrame:
    """The keys become inactive and stay, so that history keeps its names."""
    return categories.join(keys.select("key", F.lit(True).alias("_gone")).distinct(), "key", "left").withColumn("is_active", F.col("is_active") & F.col("_gone").isNull()).drop("_gone")


def target_text(description: str, exemplars: str) -> Column:
    return F.when(F.size(exemplars) > 0, F.concat(F.col(description), F.lit(" "), F.array_join(F.slice(exemplars, 1, 3), "; "))).otherwise(F.col(description))
