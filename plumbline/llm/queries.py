"""Queries of this subpackage's operators, and the SQL that checks those SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm import canonical, mixing, neardup, pii, tokenizer
from plumbline.session import cut
from plumbline.sources.tables import table

RUN_WORDS, DEFINITION_SHARE, NAME_EDITS = 3, 0.5, 3
#: The agreeing sketch bytes (of 64) asked of a candidate are four deviations below the mean at the least similarity.
DEFINITIONS = neardup.Layout(bands=64, rows=4, least=16)
NAMES = neardup.NameLayout(bands=54, rows=7, edits=NAME_EDITS)


def _modules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "live_modules", "module_id", "object_name", "definition")


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each module that is a copy of another but for formatting, with the least module_id of its group."""
    c = canonical.copies(_modules(spark, sf_dir), "module_id", "object_name", "definition")
    return c.where(F.col("id") > F.col("keep_id")).select("keep_id", F.col("id").alias("module_id"))


def p1_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One record for each canonical form, with the number of modules it stands for; a module without a definition is one of its own."""
    c = canonical.copies(_modules(spark, sf_dir), "module_id", "object_name", "definition")
    unknown = table(spark, sf_dir, "live_modules", "module_id", "definition").where(F.col("definition").isNull())
    return c.where(F.col("id") == F.col("keep_id")).select("keep_id", "n_copies").unionByName(unknown.select(F.col("module_id").alias("keep_id"), F.lit(1).cast("long").alias("n_copies")))


def p1_collisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """128-bit hashes that stand for more than one canonical form, told by the independent check value; none are expected."""
    return canonical.collisions(canonical.record_keys(_modules(spark, sf_dir), "module_id", "object_name", "definition"))


def _definitions(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    signed = neardup.signed_texts(_modules(spark, sf_dir), "module_id", "definition", RUN_WORDS, DEFINITIONS, name="object_name", extra=canonical.record_key)
    return signed, neardup.similar_sets(signed, DEFINITION_SHARE)


def _names(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = table(spark, sf_dir, "duplication_findings", "module_qualified_name").select(F.col("module_qualified_name").alias("name"))
    return neardup.near_names(names, NAME_EDITS, NAMES)


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of modules with similar definitions that are not copies, and pairs of similar module names."""
    signed, pairs = _definitions(spark, sf_dir)
    links = cut(neardup.linked_classes(signed, cut(pairs))[1])  # small; every later plan starts from it
    rows = neardup.expand(signed, links).select(F.lit("definition").alias("record_kind"), F.least("p", "q").cast("string").alias("key_a"), F.greatest("p", "q").cast("string").alias("key_b"))
    names = cut(_names(spark, sf_dir)).select(F.lit("module_name").alias("record_kind"), F.col("a").alias("key_a"), F.col("b").alias("key_b"))
    return rows.unionByName(names)


def p3_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each module with the least module_id of its group of similar ones; one without a run of words is a group of its own."""
    signed, pairs = _definitions(spark, sf_dir)
    classes, links = neardup.linked_classes(signed, cut(pairs), same_key=True)
    comp = neardup.components(links)
    member = classes.join(comp.withColumnRenamed("node", "cid"), "cid", "left").select("s1", "c1", "c2", "c3", F.coalesce("root", "cid").alias("root"))
    grouped = signed.select("id", "s1", "c1", "c2", "c3").join(member, ["s1", "c1", "c2", "c3"]).select(F.col("id").alias("module_id"), F.col("root").alias("group_id"))
    alone = table(spark, sf_dir, "live_modules", "module_id").join(signed.select(F.col("id").alias("module_id")), "module_id", "left_anti")
    return grouped.unionByName(alone.select("module_id", F.col("module_id").alias("group_id")))


def p3_name_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each module name of duplication_findings with the least name, in code point order, of its group of similar ones."""
    comp = neardup.components(_names(spark, sf_dir).select(F.col("a").alias("x"), F.col("b").alias("y")))
    names = table(spark, sf_dir, "duplication_findings", "module_qualified_name").where(F.col("module_qualified_name").isNotNull()).distinct()
    return names.join(comp.withColumnRenamed("node", "module_qualified_name"), "module_qualified_name", "left").select("module_qualified_name", F.coalesce("root", "module_qualified_name").alias("group_name"))


def p6_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ids of every document."""
    e = tokenizer.encode(table(spark, sf_dir, "documents", "doc_id", "text"), "doc_id", "text")
    return e.select(F.col("id").alias("doc_id"), "ids")


def _sized(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id", "source", "text")
    return cut(tokenizer.count_tokens(docs, "text", "doc_id", "source").withColumnRenamed("ids", "n_tokens"))


def p7_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mix of documents to the target shares of their sources."""
    return mixing.mix(_sized(spark, sf_dir), table(spark, sf_dir, "mix_targets"))


def p7_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Target and actual share of each listed source in the mix."""
    sized, targets = _sized(spark, sf_dir), table(spark, sf_dir, "mix_targets")
    return mixing.shares(cut(mixing.mix(sized, targets)), sized, targets)


def _found(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    return docs, pii.find(docs, "doc_id", "text", table(spark, sf_dir, "name_list"))


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every occurrence of personal information in the documents."""
    return _found(spark, sf_dir)[1].withColumnRenamed("id", "doc_id")


def p8_redacted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with personal information replaced by placeholders."""
    docs, found = _found(spark, sf_dir)
    return pii.redact(docs, "doc_id", "text", cut(found)).withColumnRenamed("id", "doc_id")


QUERIES = {"p1_found": p1_found, "p1_records": p1_records, "p1_collisions": p1_collisions, "p3_found": p3_found, "p3_groups": p3_groups, "p3_name_groups": p3_name_groups, "p6_ids": p6_ids, "p7_mix": p7_mix, "p7_shares": p7_shares, "p8_found": p8_found, "p8_redacted": p8_redacted}
ORACLE: dict[str, str] = {}
