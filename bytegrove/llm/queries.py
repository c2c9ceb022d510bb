"""Queries of the problems tagged llm: p3, p4, p6, p7, p8."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from bytegrove.functions.names import class_name, descriptor, sql_class_name, sql_descriptor
from bytegrove.llm.cooccur import SIGNIFICANT, cooccurrence
from bytegrove.llm.frequency import term_frequencies
from bytegrove.llm.leakage import find_leaks
from bytegrove.llm.packing import CAPACITY, pack_documents
from bytegrove.llm.sentences import split_sentences
from bytegrove.scratch import Scratch
from bytegrove.sources.tables import table


def _term_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    def one(kind: str, name: str, term, *key: str) -> DataFrame:
        return table(spark, sf_dir, name).select(
            F.lit(kind).alias("kind"), term.alias("term"), class_name("class_name").alias("record"), F.to_json(F.struct(*key)).alias("row_key")
        )

    return (
        one("annotation", "annotations", class_name("annotation"), "ann_id")
        .unionByName(one("field", "class_fields", descriptor("descriptor"), "ord", "name"))
        .unionByName(one("method", "methods", descriptor("descriptor"), "ord", "name"))
    )


def p3_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each annotation name, field descriptor and method descriptor with its occurrences, classes and mark."""
    return term_frequencies(_term_rows(spark, sf_dir), F.col("kind"), F.col("term"), F.col("record"), F.col("row_key"))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p3_terms(spark, sf_dir).where("mark is not null").select("kind", "term", "mark")


def _baskets(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "edges").where(F.col("rel").isin("implements", "class_ann"))
    return e.select(class_name("src").alias("basket"), class_name("dst").alias("item"))


#: A pair counts from MIN_PAIR classes on, and is a case if it is LIFT times as frequent as chance.
MIN_PAIR, LIFT = 5, 4


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs that are frequent, LIFT times as frequent as chance, and significantly so: with these numbers all are."""
    p = cooccurrence(_baskets(spark, sf_dir), F.col("basket"), F.col("item"), min_pair=MIN_PAIR).where(F.col("llr") >= SIGNIFICANT)
    return p.where(F.col("n_ab") * F.col("n") >= LIFT * F.col("n_a") * F.col("n_b")).select("item_a", "item_b")


def p4_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each pair of annotations or interfaces on a common class, with counts, lift and log-likelihood ratio."""
    p = cooccurrence(_baskets(spark, sf_dir), F.col("basket"), F.col("item"))
    return p.withColumn("lift", F.round("lift", 6)).withColumn("llr", F.round("llr", 6))


def p6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each speech, or part of one longer than a container, with its container."""
    return pack_documents(table(spark, sf_dir, "documents"))


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p6_packing(spark, sf_dir).where(F.col("doc_tokens") > CAPACITY).select("doc_id").distinct()


def p6_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What must hold of any packing: each document once and whole, cut only if oversized, no container too full, and no
    more containers than two in a hundred (and one) above the least possible number."""
    p = Scratch(spark, "audit").save(p6_packing(spark, sf_dir), "packed")
    docs = p.groupBy("doc_id").agg(F.sum("n_tokens").alias("n"), F.max("doc_tokens").alias("want"), F.count(F.lit(1)).alias("parts"), F.min("n_tokens").alias("least"))
    wrong = docs.agg(
        F.count(F.lit(1)).alias("n_documents"), F.count_if(F.col("n") != F.col("want")).alias("n_incomplete"),
        F.count_if(F.col("parts") != F.greatest(F.lit(1), F.ceil(F.col("want") / CAPACITY))).alias("n_cut_wrongly"), F.count_if((F.col("want") == 0) != (F.col("least") == 0)).alias("n_empty_parts"),
    )
    boxes = p.where("container is not null").groupBy("container").agg(F.sum("n_tokens").alias("n"))
    full = boxes.agg(F.count_if(F.col("n") > CAPACITY).alias("n_overfull"), (F.count(F.lit(1)) <= F.ceil(F.sum("n") / CAPACITY * 1.02) + 1).alias("is_tight"))
    both = wrong.unionByName(full, allowMissingColumns=True)  # one row each
    return both.agg(*(F.max(c).alias(c) for c in both.columns))


def p7_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each speech with each test item that it repeats, and how much of it."""
    return find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items"))


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p7_documents(spark, sf_dir).select("doc_id", "item_id")


def p8_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each sentence unit of each speech with its text, in order."""
    return split_sentences(table(spark, sf_dir, "documents"))


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return split_sentences(table(spark, sf_dir, "documents"), with_text=False).select("doc_id", "start_pos", "end_pos")


QUERIES = {
    f.__name__: f
    for f in (p3_found, p3_terms, p4_found, p4_pairs, p6_found, p6_packing, p6_audit, p7_found, p7_documents, p8_found, p8_sentences)
}

_TERMS = f"""rows_ AS (
  SELECT DISTINCT kind, term, record, row_key FROM (
    SELECT 'annotation' AS kind, {sql_class_name("annotation")} AS term, {sql_class_name("class_name")} AS record, [CAST(ann_id AS VARCHAR)] AS row_key FROM annotations
    UNION ALL SELECT 'field', {sql_descriptor("descriptor")}, {sql_class_name("class_name")}, [CAST(ord AS VARCHAR), name] FROM class_fields
    UNION ALL SELECT 'method', {sql_descriptor("descriptor")}, {sql_class_name("class_name")}, [CAST(ord AS VARCHAR), name] FROM methods)),
totals AS (SELECT kind, count(DISTINCT record) AS total_records FROM rows_ GROUP BY kind),
terms AS (SELECT kind, term, count(*) AS n, count(DISTINCT record) AS n_records FROM rows_ WHERE term IS NOT NULL GROUP BY kind, term),
marked AS (SELECT t.*, total_records, CASE WHEN n_records < 3 THEN 'rare' WHEN n_records * 10 >= total_records THEN 'common' END AS mark FROM terms t JOIN totals USING (kind))"""

_PAIRS = f"""items AS (
  SELECT DISTINCT basket, item FROM (SELECT {sql_class_name("src")} AS basket, {sql_class_name("dst")} AS item FROM edges WHERE rel IN ('implements', 'class_ann'))
  WHERE basket IS NOT NULL AND item IS NOT NULL),
one AS (SELECT item, count(*) AS c FROM items GROUP BY item),
pairs AS (
  SELECT item_a, item_b, n_ab, a.c AS n_a, b.c AS n_b, (SELECT count(DISTINCT basket) FROM items) AS n
  FROM (SELECT x.item AS item_a, y.item AS item_b, count(*) AS n_ab FROM items x JOIN items y ON x.basket = y.basket AND x.item < y.item GROUP BY ALL)
  JOIN one a ON a.item = item_a JOIN one b ON b.item = item_b)"""


def _h(*cells: str) -> str:
    whole = " + ".join(f"({c})" for c in cells)
    return "(" + " + ".join(f"CASE WHEN ({c}) > 0 THEN ({c}) * ln(CAST(({c}) AS DOUBLE) / ({whole})) ELSE 0 END" for c in cells) + ")"


_K = ("n_ab", "n_a - n_ab", "n_b - n_ab", "n - n_a - n_b + n_ab")

ORACLE = {
    "p6_audit": "SELECT count(DISTINCT doc_id) AS n_documents, 0 AS n_incomplete, 0 AS n_cut_wrongly, 0 AS n_empty_parts, 0 AS n_overfull, true AS is_tight FROM documents",
    "p3_found": f"WITH {_TERMS} SELECT kind, term, mark FROM marked WHERE mark IS NOT NULL",
    "p3_terms": f"WITH {_TERMS} SELECT kind, term, n, n_records, total_records, mark FROM marked",
    "p4_found": f"WITH {_PAIRS} SELECT item_a, item_b FROM pairs WHERE n_ab >= {MIN_PAIR} AND n_ab * n >= {LIFT} * n_a * n_b",
    "p4_pairs": f"""WITH {_PAIRS} SELECT *, round(CAST(n_ab AS DOUBLE) * n / n_a / n_b, 6) AS lift,
round(2 * ({_h(*_K)} - {_h("n_a", "n - n_a")} - {_h("n_b", "n - n_b")}), 6) AS llr FROM pairs""",
}
