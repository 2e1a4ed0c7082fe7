"""Search over documents and company names."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.operators import search
from tessera.queries.resolution import ENTITIES, entities
from tessera.registry import query, table
from tessera.scratch import Scratch

WORDS = "list_filter(regexp_split_to_array(lower(coalesce({0}, '')), '[^\\p{{L}}\\p{{N}}]+'), lambda w: w <> '')"
GRAMS = "list_distinct(flatten(list_transform(list_distinct({0}), lambda w: list_transform(range(1, length(w) + 2), lambda i: substr('  ' || w || ' ', i, 3)))))"
BM25 = f"""
d AS (SELECT doc_id AS id, {WORDS.format("text")} AS ws FROM documents),
q AS (SELECT item_id AS query_id, unnest(list_distinct({WORDS.format("text")})) AS token FROM benchmark),
p AS (SELECT id, len(ws) AS length, token, count(*) AS times FROM (SELECT id, ws, unnest(ws) AS token FROM d) GROUP BY ALL),
h AS (SELECT token, count(*) AS holding FROM p GROUP BY token),
z AS (SELECT count(*) AS n, sum(len(ws)) / count(*)::DOUBLE AS mean FROM d),
s AS (SELECT query_id, id, round(sum(ln(1 + (n - holding + 0.5::DOUBLE) / (holding + 0.5::DOUBLE)) * times * 2.2::DOUBLE / (times + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * length / mean))), 9) AS score, count(*) AS met
      FROM q JOIN p USING (token) JOIN h USING (token), z GROUP BY query_id, id)"""
NAMES = f"""
v AS (SELECT id, name_key, {GRAMS.format("string_split(name_key, ' ')")} AS g FROM e),
m AS (SELECT r.id AS query_id, l.id, len(list_intersect(l.g, r.g)) / len(list_distinct(list_concat(l.g, r.g)))::DOUBLE AS similarity FROM v l, v r WHERE l.id % 4 < 2 AND r.id % 4 = 2)"""


def _index(spark, sf_dir):
    return search.build(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text"), Scratch(spark, "search").path())


@query("srch_bm25", f"WITH {BM25} SELECT query_id, id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM s QUALIFY rank <= 5")
def srch_bm25(spark, sf_dir):
    """The five best documents of every benchmark item."""
    items = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), "text")
    return search.search(_index(spark, sf_dir), items, k=5)


@query("srch_every_word", f"WITH {BM25}, n AS (SELECT query_id, count(*) AS needed FROM q GROUP BY query_id) SELECT query_id, id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM s JOIN n USING (query_id) WHERE met = needed QUALIFY rank <= 20")
def srch_every_word(spark, sf_dir):
    """Documents that hold every word of a benchmark item."""
    items = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), "text")
    return search.search(_index(spark, sf_dir), items, k=20, every=True)


def _companies(spark, sf_dir):
    """Customers' records as names, suppliers' mistyped names as queries."""
    rows = entities(spark, sf_dir).select("id", F.regexp_replace("name", r"(?i) pvt\.? ltd\.?$", "").alias("name"))
    return rows.where("id % 4 < 2"), rows.where("id % 4 = 2").select(F.col("id").alias("query_id"), "name")


@query("srch_similar_names", f"WITH {ENTITIES}, {NAMES} SELECT query_id, id, round(similarity, 9) AS similarity FROM m WHERE similarity >= 0.45")
def srch_similar_names(spark, sf_dir):
    names, asked = _companies(spark, sf_dir)
    return search.similar_names(names, asked, 0.45).withColumn("similarity", F.round("similarity", 9))


@query("srch_leads", f"""WITH {ENTITIES}, {NAMES},
t AS (SELECT id, string_split(name_key, ' ') AS ws FROM e), u AS (SELECT l.id, r.id AS query_id FROM t l, t r WHERE l.id % 4 < 2 AND r.id % 4 = 2 AND len(list_intersect(l.ws, r.ws)) = len(list_distinct(r.ws))),
a AS (SELECT query_id, id, round(similarity, 9) AS similarity, u.id IS NOT NULL AS held FROM m LEFT JOIN u USING (query_id, id) WHERE similarity >= 0.3 OR u.id IS NOT NULL)
SELECT query_id, id, similarity, held, row_number() OVER (PARTITION BY query_id ORDER BY held DESC, similarity DESC, id) AS rank FROM a QUALIFY rank <= 3""")
def srch_leads(spark, sf_dir):
    """The three best companies of each mistyped name: all words first, then alike ones."""
    names, asked = _companies(spark, sf_dir)
    index = search.build(names, Scratch(spark, "search").path(), text="name")
    found = search.find_leads(index, names, asked.select("query_id", F.col("name").alias("text")), k=3)
    return found.select("query_id", "id", "similarity", (F.col("score") > 0).alias("held"), "rank")
