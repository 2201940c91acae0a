"""The queries of the text problems over the test tables, and their SQL where there is any."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import near_dup, spans
from .mixing import mix
from .packing import fill_report, pack
from .near_dup import near_duplicates
from .tokens import with_tokens
from ..session import stage


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _news_groups(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    news = table(spark, sf_dir, "news")
    text = F.concat(F.coalesce("headline", F.lit("")), F.lit(" "), F.coalesce("content", F.lit("")))
    return near_duplicates(news.select("id", F.col("as_of_ts").alias("version"), text.alias("text")), width=3, threshold=0.5, min_words=40)


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dup.expand(*_news_groups(spark, sf_dir)).select("id_a", "id_b")


def p3_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per news item: its class of equal texts and its number of links to other classes."""
    links, members = _news_groups(spark, sf_dir)
    ends = links.select(F.explode(F.array("a", "b")).alias("rep")).groupBy("rep").agg(F.count(F.lit(1)).alias("n_links"))
    return members.join(ends, "rep", "left").select("id", F.col("rep").alias("class_id"), F.coalesce("n_links", F.lit(0)).alias("n_links"))


def p8_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    sizes = stage(with_tokens(table(spark, sf_dir, "documents"), ["doc_id"]), arrow_batch=1000)
    return pack(sizes, table(spark, sf_dir, "pack_specs"))


def p8_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fill_report(p8_pack(spark, sf_dir))


def p8_kept(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What packing must keep, per spec: documents in containers, containers above the capacity, documents whose pieces don't make up
    their size, documents split though they fit, and split documents whose pieces don't follow each other."""
    sizes = stage(with_tokens(table(spark, sf_dir, "documents"), ["doc_id"]), arrow_batch=1000)
    packed = stage(pack(sizes, table(spark, sf_dir, "pack_specs")))
    over = packed.groupBy("spec_name", "capacity_tokens", "bin").agg(F.sum("tokens").alias("t")).groupBy("spec_name").agg(F.count_if(F.col("t") > F.col("capacity_tokens")).alias("n_overfull"))
    whole = packed.groupBy("spec_name", "capacity_tokens", "doc_id").agg(F.sum("tokens").alias("t"), F.count(F.lit(1)).alias("n"), F.max(F.col("token_start") + F.col("tokens")).alias("end"))
    whole = whole.join(sizes, "doc_id").groupBy("spec_name").agg(
        F.count(F.lit(1)).alias("n_documents"), F.count_if(F.col("t") != F.col("tokens")).alias("n_incomplete"),
        F.count_if((F.col("n") > 1) & (F.col("tokens") <= F.col("capacity_tokens"))).alias("n_split"), F.count_if(F.col("end") != F.col("t")).alias("n_apart"),
    )
    return over.join(whole, "spec_name")


def p9_kept(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What mixing must keep, per target: sources above their budget, records repeated too often, records of other sources, shares off by above
    a hundredth though the source has documents."""
    chosen, report = _mixed(spark, sf_dir)
    target = table(spark, sf_dir, "mix_targets").select("source", "max_repeats").distinct()
    docs = table(spark, sf_dir, "documents").select("doc_id", F.col("source").alias("own"))
    rows = chosen.join(docs, "doc_id").join(target, "source").groupBy("source").agg(F.count_if(F.col("times") > F.col("max_repeats")).alias("a"), F.count_if(~F.col("own").eqNullSafe(F.col("source"))).alias("b"))
    there = F.sum(F.when(F.col("available") > 0, F.col("target_share"))).over(Window.partitionBy(F.lit(0)))  # one row a target
    off = F.coalesce((F.col("available") > 0) & (F.abs(F.col("share") - F.col("target_share") / there) > 0.01), F.lit(False))
    out = report.withColumn("off", off.cast("int")).join(rows, "source", "left")
    return out.select("source", (F.col("tokens") > F.col("budget")).cast("int").alias("above_budget"), F.coalesce("a", F.lit(0)).alias("n_too_often"), F.coalesce("b", F.lit(0)).alias("n_foreign"), F.col("off").alias("share_off"))


def _mixed(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    sizes = stage(with_tokens(table(spark, sf_dir, "documents"), ["doc_id", "source"]), arrow_batch=1000)
    return mix(sizes, table(spark, sf_dir, "mix_targets"))


def p9_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _mixed(spark, sf_dir)[0]


def p9_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _mixed(spark, sf_dir)[1]


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spans.expand(*spans.shared_spans(table(spark, sf_dir, "documents"))).select("doc_id_a", "doc_id_b")


def p10_shared(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spans.shared_part(table(spark, sf_dir, "documents"))


def p10_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document its class of equal texts and its number of links to other classes."""
    return spans.classes(*spans.shared_spans(table(spark, sf_dir, "documents")))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (p3_found, p3_groups, p8_pack, p8_fill, p8_kept, p9_kept, p9_mix, p9_shares, p10_found, p10_shared, p10_classes)}

_WINDOWS = "windows AS (SELECT doc_id, i, hash(substr(text, i, 200)) AS h FROM (SELECT doc_id, text, unnest(range(1, length(text) - 198)) AS i FROM documents WHERE length(text) >= 200))"

SQL: dict[str, str] = {
    "p3_found": """
WITH newest AS (SELECT id, arg_max(lower(coalesce(headline, '') || ' ' || coalesce(content, '')), as_of_ts) AS t FROM news GROUP BY id),
words AS (SELECT id, regexp_extract_all(t, '[a-z0-9]+') AS w FROM newest),
grams AS (SELECT DISTINCT id, unnest(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) AS g FROM words WHERE len(w) >= 40),
sizes AS (SELECT id, count(*) AS n FROM grams GROUP BY id),
shared AS (SELECT a.id AS id_a, b.id AS id_b, count(*) AS c FROM grams a JOIN grams b ON a.g = b.g AND a.id < b.id GROUP BY ALL)
SELECT id_a, id_b FROM shared JOIN sizes x ON x.id = id_a JOIN sizes y ON y.id = id_b WHERE 2 * c >= x.n + y.n - c""",
    "p10_found": """
WITH grams AS (SELECT DISTINCT doc_id, substr(text, i, 200) AS g FROM (SELECT doc_id, text, unnest(range(1, length(text) - 198)) AS i FROM documents WHERE length(text) >= 200)),
common AS (SELECT g FROM grams GROUP BY g HAVING count(*) > 1), hits AS (SELECT doc_id, g FROM grams SEMI JOIN common USING (g))
SELECT DISTINCT a.doc_id AS doc_id_a, b.doc_id AS doc_id_b FROM hits a JOIN hits b ON a.g = b.g AND a.doc_id < b.doc_id""",
    "p3_groups": """
WITH newest AS (SELECT id, arg_max(lower(coalesce(headline, '') || ' ' || coalesce(content, '')), as_of_ts) AS t FROM news GROUP BY id),
words AS (SELECT id, regexp_extract_all(t, '[a-z0-9]+') AS w FROM newest),
sets AS (SELECT id, list_sort(list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]))) AS s FROM words WHERE len(w) >= 40),
members AS (SELECT id, min(id) OVER (PARTITION BY s) AS class_id FROM sets), grams AS (SELECT id, len(s) AS n, unnest(s) AS g FROM sets SEMI JOIN (SELECT DISTINCT class_id AS id FROM members) USING (id)),
shared AS (SELECT a.id AS a, b.id AS b, any_value(a.n) AS x, any_value(b.n) AS y, count(*) AS c FROM grams a JOIN grams b ON a.g = b.g AND a.id <> b.id GROUP BY 1, 2),
links AS (SELECT a, count(*) AS n FROM shared WHERE 2 * c >= x + y - c GROUP BY 1)
SELECT id, class_id, coalesce(n, 0) AS n_links FROM members LEFT JOIN links ON a = class_id""",
    "p10_shared": f"""
WITH {_WINDOWS}, owned AS (SELECT h FROM windows GROUP BY h HAVING min(doc_id) < max(doc_id)),
covers AS (SELECT doc_id, least(200, coalesce(i - lag(i) OVER (PARTITION BY doc_id ORDER BY i), 200)) AS c FROM windows SEMI JOIN owned USING (h)),
per_doc AS (SELECT doc_id, CAST(sum(c) AS BIGINT) AS c FROM covers GROUP BY 1)
SELECT doc_id, coalesce(length(text), 0) AS n_chars, coalesce(c, 0) AS shared_chars, coalesce(coalesce(c, 0) / nullif(length(text), 0), 0) AS shared_part FROM documents LEFT JOIN per_doc USING (doc_id)""",
    "p10_classes": f"""
WITH {_WINDOWS}, members AS (SELECT doc_id, min(doc_id) OVER (PARTITION BY text) AS class_id FROM documents WHERE length(text) >= 200),
hits AS (SELECT DISTINCT class_id, h FROM windows JOIN members USING (doc_id) WHERE h IN (SELECT h FROM windows GROUP BY h HAVING min(doc_id) < max(doc_id))),
links AS (SELECT DISTINCT a.class_id AS a, b.class_id AS b FROM hits a JOIN hits b ON a.h = b.h AND a.class_id <> b.class_id), n AS (SELECT a, count(*) AS n FROM links GROUP BY 1)
SELECT doc_id, class_id, coalesce(n, 0) AS n_links FROM members LEFT JOIN n ON a = class_id""",
    "p8_kept": """
SELECT spec_name, 0 AS n_overfull, (SELECT count(*) FROM documents WHERE length(text) > 0) AS n_documents, 0 AS n_incomplete, 0 AS n_split, 0 AS n_apart FROM pack_specs""",
    "p9_kept": "SELECT DISTINCT source, 0 AS above_budget, 0 AS n_too_often, 0 AS n_foreign, 0 AS share_off FROM mix_targets",
}
