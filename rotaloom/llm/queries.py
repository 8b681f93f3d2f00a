"""Queries of the training-data problems over the test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rotaloom.functions.timeofday import squeeze
from rotaloom.llm.labels import map_labels
from rotaloom.llm.leakage import leaked_items, retold_items
from rotaloom.llm.names import name_links
from rotaloom.llm.packing import example_sizes, pack, token_counts
from rotaloom.llm.personal import find_personal
from rotaloom.llm.places import place_classes, place_links
from rotaloom.llm.survivors import consensus_values, survivors
from rotaloom.sources.tables import table

_FIELDS = ["customer_name", "street", "street_number", "postal_code", "city", "raw_type_label"]


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spellings of one customer within a user's shifts."""
    names = table(spark, sf_dir, "canonical_shift").select(F.col("user_id").alias("scope"), F.col("customer_name").alias("name"))
    return name_links(names).withColumnRenamed("scope", "user_id")


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The record that gives each field of a duplicate group."""
    records = table(spark, sf_dir, "aggregated_shift").select(F.col("dup_group").alias("group_id"), F.col("agg_id").alias("record_id"), F.col("source_count").alias("trust"), F.col("aggregated_at").alias("at"), *_FIELDS, "notes")
    return survivors(records, _FIELDS, ["notes"]).select(F.col("group_id").alias("dup_group"), "field_name", F.col("record_id").alias("agg_id"))


def p3_consensus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The existing value of each field that is closest to its group's weighted token consensus."""
    records = table(spark, sf_dir, "aggregated_shift").select(F.col("dup_group").alias("group_id"), F.col("agg_id").alias("record_id"), F.col("source_count").alias("trust"), F.col("aggregated_at").alias("at"), *_FIELDS, "notes")
    return consensus_values(records, _FIELDS, ["notes"]).select(F.col("group_id").alias("dup_group"), "field_name", "value", F.col("record_id").alias("agg_id"))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The label-list entry of each shift's raw label."""
    shifts = table(spark, sf_dir, "canonical_shift").select("shift_id", F.col("raw_type_label").alias("value")).where(squeeze(F.col("value")) != "")
    entries = table(spark, sf_dir, "job_label").select(F.col("label_id").alias("entry_id"), F.col("label").alias("entry"))
    mapped = map_labels(shifts, entries).select("value", F.col("entry_id").alias("label_id"))
    return shifts.distinct().join(mapped, "value").select("shift_id", "label_id").distinct()


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of entries at one place, judged by the entry and the shift read from it."""
    return place_links(_read_entries(spark, sf_dir))


def p6_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The place of each entry, told by the least entry there, and the number of entries."""
    placed = place_classes(_read_entries(spark, sf_dir))
    told = placed.groupBy("place").agg(F.min("entry_id").alias("place_entry"), F.count("*").alias("entries"))
    return placed.join(told, "place").select("entry_id", "place_entry", "entries")


def _read_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    entries = table(spark, sf_dir, "entry").select("entry_id", "address", "location")
    shifts = table(spark, sf_dir, "canonical_shift").where("entry_id is not null").select("entry_id", "street", "street_number", "postal_code", "postal_area", "city")
    return entries.join(shifts, "entry_id", "left")


def p7_containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents in containers of 2,048 tokens; container numbers are one of many good solutions."""
    items = token_counts(table(spark, sf_dir, "documents").select("doc_id", "text")).withColumnRenamed("doc_id", "item_id")
    return pack(items).withColumnRenamed("item_id", "doc_id")


def p7_examples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as training examples in containers under limits on tokens, paragraphs and tokens outside comments."""
    items = example_sizes(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return pack(items, tokens=2048, segments=24, loss=1920).withColumnRenamed("item_id", "doc_id")


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Evaluation items that stand, whole or in part, in documents."""
    return leaked_items(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "eval_item").select("item_id", "text"))


def p8_retold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Evaluation questions that stand in documents with other numbers, names or units."""
    return retold_items(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "eval_item").select("item_id", "text"), each=True)


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal information in documents."""
    return find_personal(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "kind", "value").distinct()


QUERIES = {"p2_found": p2_found, "p3_found": p3_found, "p3_consensus": p3_consensus, "p5_found": p5_found, "p6_found": p6_found, "p6_places": p6_places, "p7_containers": p7_containers, "p7_examples": p7_examples, "p8_found": p8_found, "p8_retold": p8_retold, "p9_found": p9_found}
_STAND_INS = "'ingen uppgift', 'ej angivet', 'ej angiven', 'ej känd', 'ej känt', 'saknas', 'okänd', 'okänt', 'unknown', 'null', 'none', 'nil', 'nan', 'tbd', 'tba', 'todo', 'n/a', 'n.a.', 'na', 'xxx', 'xx', 'x', 'missing', 'empty', 'test', 'ingen', 'inget', 'uppgift saknas', 'not available'"


def _real(value: str) -> str:
    text = f"lower(trim(regexp_replace({value}, '\\s+', ' ', 'g')))"
    bare = f"regexp_replace({text}, '[^\\p{{L}}\\p{{N}}]', '', 'g')"
    same = f"(length({bare}) > 2 AND regexp_matches({bare}, '^[0-9]+$') OR length({bare}) > 1 AND regexp_matches({bare}, '^\\p{{L}}+$')) AND replace({bare}, {bare}[1], '') = ''"
    return f"coalesce({bare} <> '' AND {text} NOT IN ({_STAND_INS}) AND NOT regexp_matches({text}, '(\\.\\.\\.|…)$') AND NOT regexp_matches({bare}, '^0+$') AND NOT regexp_matches({bare}, '^1234[0-9]*$') AND NOT ({same}), false)"


_EACH = " UNION ALL ".join([f"SELECT dup_group, agg_id, source_count, aggregated_at, '{f}' AS field_name FROM g WHERE {_real(f)}" for f in _FIELDS] + [f"SELECT dup_group, agg_id, source_count, aggregated_at, 'notes' FROM g WHERE len(list_filter(notes, lambda n: {_real('n')})) > 0"])
ORACLE: dict[str, str] = {
    "p3_found": f"""
        WITH g AS (SELECT DISTINCT ON (agg_id) * FROM aggregated_shift WHERE dup_group IN (SELECT dup_group FROM aggregated_shift GROUP BY 1 HAVING count(DISTINCT agg_id) > 1)), e AS ({_EACH})
        SELECT dup_group, field_name, agg_id FROM e QUALIFY row_number() OVER (PARTITION BY dup_group, field_name ORDER BY source_count DESC NULLS LAST, aggregated_at DESC, agg_id) = 1""",
}
