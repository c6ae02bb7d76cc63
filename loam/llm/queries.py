"""Queries of the training-data operators that read texts, by name; ``SQL`` has the twins that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loam.llm.boilerplate import furniture_lines, main_bodies
from loam.llm.neardup import near_groups, near_pairs
from loam.llm.oracle import SQL as SQL
from loam.llm.pack import CAPACITY, packed_texts
from loam.llm.pairs import broken_pairs
from loam.llm.split import pieces_of, split_oversized
from loam.llm.subjects import composition, document_subjects
from loam.llm.tokens import decoded, encoded
from loam.session import staged
from loam.sources.tables import table

Query = Callable[[SparkSession, str], DataFrame]


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    """Each line of a chunk that is not main body."""
    return furniture_lines(table(spark, folder, "retrieved_chunk"))


def p1_bodies(spark: SparkSession, folder: str) -> DataFrame:
    """The main body of each chunk."""
    chunks = table(spark, folder, "retrieved_chunk")
    return main_bodies(chunks, furniture_lines(chunks))


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    """Each oversized chunk and whether one of its blocks had to be cut."""
    return split_oversized(table(spark, folder, "retrieved_chunk")).select("id", "cut")


def p2_pieces(spark: SparkSession, folder: str) -> DataFrame:
    """The pieces of all oversized chunks, with their headings."""
    keep = ("chunk_index", "headings")
    return pieces_of(split_oversized(table(spark, folder, "retrieved_chunk"), keep=keep, latest="ingested_at"), keep=keep)


def p2_cover(spark: SparkSession, folder: str) -> DataFrame:
    """Of each oversized chunk: its pieces' bodies put together again without white space, and whether limit and overlap hold."""
    pieces = pieces_of(split_oversized(table(spark, folder, "retrieved_chunk")))
    body = F.expr("substring(piece, overlap + 1)")
    rows = pieces.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("piece_no", "piece", "overlap", body.alias("body")))).alias("p"))  # the pieces of one text
    blank = r"[\s\p{Z}\x0B\x85\x1c-\x1f]+"
    lead = F.transform("p", lambda x, k: F.when(k == 0, x["overlap"] == 0).otherwise(F.endswith(F.regexp_replace(F.get("p", k - 1)["piece"], blank, ""), F.regexp_replace(F.left(x["piece"], x["overlap"]), blank, ""))))
    return rows.select(
        "id", F.md5(F.regexp_replace(F.array_join(F.transform("p", lambda x: x["body"]), ""), blank, "")).alias("body_md5"),
        F.forall("p", lambda x: F.length(x["piece"]) <= 2000).alias("within_limit"), F.forall(lead, lambda x: x).alias("overlap_repeats"),
    )


#: TESTDATA.md fixes these for problem 4.
P4 = {"t": 0.6, "n": 3, "least_words": 30}


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    """Each pair of distinct chunk ids whose texts are alike."""
    return near_pairs(table(spark, folder, "retrieved_chunk"), **P4)


def p4_groups(spark: SparkSession, folder: str) -> DataFrame:
    """Each chunk id with its class of equal texts and its group of near-duplicates, both by their least id, and its number of links."""
    rows = staged(near_groups(table(spark, folder, "retrieved_chunk"), **P4), "groups")
    least = lambda c: rows.groupBy(c).agg(F.min("id").alias(f"{c}_id"))
    named = rows.join(least("cls"), "cls").join(least("grp"), "grp")
    return named.select("id", F.col("cls_id").alias("cls"), F.col("grp_id").alias("grp"), "links")


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    """Each broken pair with its main defect."""
    found = broken_pairs(table(spark, folder, "eval_row"))
    return found.select("pos", F.col("defects")[0].alias("defect"))


def p5_defects(spark: SparkSession, folder: str) -> DataFrame:
    """Each broken pair with every defect that shows, in rule order."""
    found = broken_pairs(table(spark, folder, "eval_row"))
    return found.select("pos", F.posexplode("defects").alias("rule", "defect"))


def p5_empty(spark: SparkSession, folder: str) -> DataFrame:
    """Each reply that says nothing."""
    return broken_pairs(table(spark, folder, "eval_row")).where(F.col("defects")[0] == "empty").select("pos")


def p6_ids(spark: SparkSession, folder: str) -> DataFrame:
    """The ids of every document."""
    return encoded(table(spark, folder, "documents"))


def p6_round_trip(spark: SparkSession, folder: str) -> DataFrame:
    """Every document's ids put back into text."""
    return decoded(encoded(table(spark, folder, "documents"))).select("doc_id", F.md5("text").alias("text_md5"))


def p7_containers(spark: SparkSession, folder: str) -> DataFrame:
    """The container of every document, or of each piece of one that exceeds a container."""
    return packed_texts(table(spark, folder, "documents"))


def p7_checks(spark: SparkSession, folder: str) -> DataFrame:
    """What must hold of the containers: all documents are there, none is overfull, nothing is cut without need or left out."""
    rows = staged(p7_containers(spark, folder), "containers")
    over = rows.where(F.col("container_id").isNotNull()).groupBy("container_id").agg(F.sum("tokens").alias("t")).where(F.col("t") > CAPACITY)
    per = rows.groupBy("doc_id").agg(F.sum("tokens").alias("t"), F.count(F.lit(1)).alias("n"))
    docs = per.agg(
        F.count(F.lit(1)).alias("documents"), F.count_if((F.col("t") <= CAPACITY) & (F.col("n") > 1)).alias("cut_without_need"), F.count_if(F.col("n") > F.greatest(F.lit(1), F.ceil(F.col("t") / CAPACITY))).alias("pieces_too_many")
    )
    none = rows.agg(F.count_if((F.col("tokens") > 0) & F.col("container_id").isNull()).alias("without_place"))
    one = docs.crossJoin(F.broadcast(none)).crossJoin(F.broadcast(over.agg(F.count(F.lit(1)).alias("overfull"))))  # one row each
    return one.select("documents", "overfull", "cut_without_need", "without_place", "pieces_too_many")


def _subjects(spark: SparkSession, folder: str) -> DataFrame:
    return document_subjects(table(spark, folder, "documents"), table(spark, folder, "subject_example"), table(spark, folder, "subject_area"))


def p8_found(spark: SparkSession, folder: str) -> DataFrame:
    """Each document's subjects."""
    return _subjects(spark, folder).select("doc_id", "subject")


def p8_composition(spark: SparkSession, folder: str) -> DataFrame:
    """The corpus by subject."""
    return composition(_subjects(spark, folder))


QUERIES: dict[str, Query] = {
    f.__name__: f
    for f in (p1_found, p1_bodies, p2_found, p2_pieces, p2_cover, p4_found, p4_groups, p5_found, p5_defects, p5_empty, p6_ids, p6_round_trip, p7_containers, p7_checks, p8_found, p8_composition)
}
