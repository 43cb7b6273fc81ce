"""A corpus pipeline of five stages, each an operator's decisions taken on what the one before it kept.

run() applies STAGES to the documents of a folder; every stage's result is written as Parquet in the
shared folder and read again as the next one's documents. All stages but the last return the columns
of documents. A stage's own intermediate tables are removed when the next one starts on the same folder,
the last one's when its result is written. SQL cannot express the pipeline; tests/llm hold the stages against brute force.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shapeloom.llm import _store, binary_tokens, decontaminate, mixing, near_dups, quality

_LAST = 2**63 - 1


_made: dict[str, list[str]] = {}  # by folder: intermediate tables of the stage before


def _stage(f):
    """Runs a stage and, first, removes what the stage before it left: its result has been written by then."""

    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        _store.remove(spark, _made.pop(sf_dir, []))
        with _store.scope() as made:
            out = f(spark, docs, sf_dir)
        _made[sf_dir] = made
        return out

    run.__name__, run.__doc__ = f.__name__, f.__doc__
    return run


def _key(docs: DataFrame, *also: str) -> list[Column]:
    """A document's key, null as the last one, and a hash of its text and of the columns in `also`."""
    return [F.coalesce(F.col("doc_id").cast("long"), F.lit(_LAST)), F.xxhash64("text", *also)]


def _where(docs: DataFrame, found: DataFrame, how: str, *also: str) -> DataFrame:
    """The rows of `docs` whose key and hash are (left_semi) or are not (left_anti) in `found` (doc_id, x)."""
    names = [_free(docs, c) for c in ("k", "x")]
    rows = docs.withColumns(dict(zip(names, _key(docs, *also), strict=True)))
    bad = found.select(F.coalesce("doc_id", F.lit(_LAST)).alias(names[0] + "_"), F.col("x").alias(names[1] + "_")).distinct()
    return rows.join(bad, (F.col(names[0]) == F.col(names[0] + "_")) & (F.col(names[1]) == F.col(names[1] + "_")), how)


def _free(docs: DataFrame, name: str) -> str:
    """A column name that `docs` doesn't have, nor with one more sign."""
    while name in docs.columns or name + "_" in docs.columns:
        name = "_" + name
    return name


@_stage
def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier keeps.

    Every row is judged by its own text and language, whatever key it has; rows without words (null and
    empty texts) go; rows that repeat are judged alike; null keys are not labelled; columns of any name pass through; an empty
    table gives an empty result.
    """
    given = docs.select("doc_id", "lang", "text", _key(docs, "lang")[1].alias("x"))
    out = quality.classify(given, _store.read(spark, sf_dir, "labels"), carry="x")
    return _where(docs, out.filter(~F.col("kept")), "left_anti", "lang").select(*docs.columns)


@_stage
def near_dups_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, the one with the smallest key.

    Shingles are of five words, as is usual for stages (the query op6 takes four by its contract). Groups are of
    texts, whatever keys the rows have: null keys come last, of rows with equal key and text one stays, any
    one if other columns differ, and rows that share a key but not a text are separate. Rows without words all stay; columns of any
    name pass through; an empty table gives an empty result.
    """
    words = F.coalesce("text", F.lit("")).rlike(r"[^\x20\x09-\x0D]")
    some = docs.filter(words)
    k, x = _key(docs)
    links = near_dups.link(some.select(x.alias("doc_id"), "text")).groupBy(F.col("doc_id").alias("x")).agg(F.min("component_id").alias("c"))
    least = some.select(k.alias("k"), x.alias("_x")).groupBy("_x").agg(F.min("k").alias("doc_id"))
    best = least.join(links, F.col("x") == F.col("_x")).groupBy("c").agg(F.min(F.struct("doc_id", "x")).alias("best")).select("best.*")
    kept = _where(some, best, "left_semi").dropDuplicates([_free(docs, "k"), _free(docs, "x")])
    return kept.select(*docs.columns).unionByName(docs.filter(~words))


@_stage
def decontaminate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item.

    Every row is judged by its own text, whatever key it has; null and empty texts stay; rows that repeat
    are judged alike; columns of any name pass through; an empty table gives an empty result.
    """
    out = decontaminate.contaminated(docs.select("doc_id", "text", _key(docs)[1].alias("x")), _store.read(spark, sf_dir, "benchmark"), carry="x")
    return _where(docs, out, "left_anti").select(*docs.columns)


@_stage
def mix_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """As many copies of each document as the mix takes, at most three.

    Documents without words (null and empty texts) have no tokens and are taken no time; null keys,
    null sources and rows that repeat are documents and a source like others; columns of any name pass
    through; an empty table gives an empty result.
    """
    out = mixing.mix(docs.select("doc_id", "source", "text", F.struct(*docs.columns).alias("_all")))
    return out.filter("copies > 0").select(F.explode(F.sequence(F.lit(1).cast("long"), "copies")).alias("_n"), "_all").select("_all.*")


@_stage
def token_ids_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The token files' rows, as read back: every row of the mix, copies included.

    Null and empty texts are the end id alone; null keys come first; rows that repeat follow each other;
    other columns are left out; an empty table gives no row.
    """
    return binary_tokens.encode_documents(docs)


STAGES = [
    ("quality", quality_stage),
    ("near_dups", near_dups_stage),
    ("decontaminate", decontaminate_stage),
    ("mix", mix_stage),
    ("token_ids", token_ids_stage),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _store.read(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = _store.table(stage(spark, docs, sf_dir), name)
    _store.remove(spark, _made.pop(sf_dir, []))
    return docs
