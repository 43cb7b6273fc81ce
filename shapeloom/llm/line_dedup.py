"""Line deduplication over levelled sorted runs of line hashes, with DataFrame operations only.

All lines' hashes are written once, dealt into batches of ascending document key. A batch's distinct
hashes are merge-anti-joined with the runs of the batches before it; those that are new become a sorted
run of level 0. When a level holds `fanout` runs they are merged into one sorted run of the next level,
so that a batch meets only a logarithmic number of runs. A run is a table of one sorted file for each of
a fixed number of buckets of hashes. A batch is exchanged once, into these buckets, and sorted there;
joins with runs, merges of runs and the join at the end move no run's rows. What a batch finds repeated is kept as a table (hash, batch, owner): the
owner is the smallest key in the batch, or none where an earlier batch holds the line. At the end
every line of a repeated hash goes, but for its owner's.

A line's key is the line without [\\x20\\x09-\\x0D] at its ends and A-Z lower-cased; keys under
`least` code points always stay. Hashes are 128 bits. A line that very many documents hold is reduced
to one row a task before the exchange, and where lines meet the repeated hashes Spark splits it.

Cases: a null or empty text is one empty line; rows that share a document key are one document, each
returned; a null document key counts as larger than any other; an empty table gives an empty result;
other columns are ignored. Rows with equal key and text are equal in the result.
"""

from __future__ import annotations

import contextlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._store import query, read, shared

LEAST = 10
BATCHES = 4
FANOUT = 2
LAST = 2**63 - 1
SPACE = " \t\n\x0b\x0c\r"


def line_key(line: Column) -> Column:
    """A value equal for two lines just if they are equal but for the case of A-Z.

    UTF-8 bytes are taken as characters U+0000-U+00FF before lower(): besides A-Z that moves only lead
    bytes of two-byte characters onto those of longer ones, and the number of continuation bytes, which
    lower() leaves, still tells these apart. translate() would do, at several times the cost.
    """
    return F.lower(F.decode(F.encode(line, "UTF-8"), "ISO-8859-1"))


class Runs:
    """Levels of sorted runs of (h1, h2); every run is a table of sorted buckets in the shared folder."""

    def __init__(self, spark: SparkSession, fanout: int = FANOUT):
        self.spark, self.fanout, self.levels = spark, fanout, [[]]
        self.buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.paths: dict[str, str] = {}

    def all(self) -> list[DataFrame]:
        return [self.spark.table(r) for level in self.levels for r in level]

    def table(self, rows: DataFrame, name: str) -> str:
        """A table of rows, whose tasks hold a bucket each, as sorted buckets; returns its name."""
        path = shared(self.spark, name)
        name = f"shapeloom_{path.rsplit('/', 1)[1].replace('-', '_')}"
        rows.write.format("parquet").option("path", path).bucketBy(self.buckets, "h1", "h2").sortBy("h1", "h2").saveAsTable(name)
        self.paths[name] = path
        return name

    def add(self, new: DataFrame) -> None:
        self._put(0, new)

    def _put(self, level: int, rows: DataFrame) -> None:
        if level == len(self.levels):
            self.levels.append([])
        self.levels[level].append(self.table(rows, f"run-{level}"))
        if len(self.levels[level]) >= self.fanout:
            runs, self.levels[level] = self.levels[level], []
            merged = self.spark.table(runs[0])
            for r in runs[1:]:  # no hash is in two runs
                merged = merged.join(self.spark.table(r).hint("merge"), ["h1", "h2"], "full")
            self._put(level + 1, merged)
            self.drop(runs)

    def drop(self, names: list[str]) -> None:
        """Take tables out of the catalogue; their files stay as long as the shared folder's others."""
        for n in names:
            self.spark.sql(f"DROP TABLE {n}")
            del self.paths[n]

    @contextlib.contextmanager
    def ordered(self):
        """Lets Spark know the order of buckets that are one file each, so that merges don't sort them again."""
        name = "spark.sql.legacy.bucketedTableScan.outputOrdering"
        before = self.spark.conf.get(name, "false")
        self.spark.conf.set(name, "true")
        try:
            yield
        finally:
            self.spark.conf.set(name, before)


def _lines(docs: DataFrame, least: int) -> DataFrame:
    """(_doc, _text_hash, _batch, pos, h1, h2) of the lines that may be dropped."""
    lines = docs.select("_doc", "_text_hash", "_batch", F.posexplode(F.split("text", "\n", -1)).alias("pos", "line"))
    bare = lines.withColumn("line", F.btrim("line", F.lit(SPACE))).filter(F.char_length("line") >= least)
    keyed = bare.withColumn("key", line_key(F.col("line")))
    return keyed.select("_doc", "_text_hash", "_batch", "pos", F.xxhash64("key").alias("h1"), F.xxhash64(F.lit("second"), "key").alias("h2"))


def repeated(lines: DataFrame, n_batches: int, runs: Runs) -> DataFrame:
    """(h1, h2, _batch, owner) of the hashes that a batch must drop; owner null: from all its documents."""
    found = None
    for b in range(n_batches):
        mine = lines.filter(F.col("_batch") == b).groupBy("h1", "h2").agg(F.min("_doc").alias("owner"), F.max("_doc").alias("other"))
        old = F.lit(False)
        for i, run in enumerate(runs.all()):
            mine = mine.join(run.withColumn(f"_r{i}", F.lit(True)).hint("merge"), ["h1", "h2"], "left")
            old |= F.coalesce(f"_r{i}", F.lit(False))
        mine = mine.select("h1", "h2", "owner", "other", old.alias("old"))
        with runs.ordered():
            name = runs.table(mine, "batch")
            runs.add(runs.spark.table(name).filter("not old").select("h1", "h2"))
        mine = runs.spark.read.schema(mine.schema).parquet(runs.paths[name])
        runs.drop([name])
        bad = mine.filter("old or owner <> other").select("h1", "h2", F.lit(b).alias("_batch"), F.when(~F.col("old"), F.col("owner")).alias("owner"))
        found = bad if found is None else found.unionByName(bad)
    return found


def dedup_lines(docs: DataFrame, key: str = "doc_id", text: str = "text", least: int = LEAST, n_batches: int = BATCHES, fanout: int = FANOUT) -> DataFrame:
    """doc_id, n_lines, n_dropped and the kept text of every row."""
    base = docs.select(F.col(key).alias("doc_id"), F.coalesce(F.col(key).cast("long"), F.lit(LAST)).alias("_doc"), F.coalesce(text, F.lit("")).alias("text"))
    cuts = base.agg(F.percentile_approx("_doc", [i / n_batches for i in range(1, n_batches)], 1000)).first()[0] if n_batches > 1 else []
    batch = F.lit(0)
    for c in cuts or []:
        batch = batch + F.when(F.col("_doc") > c, 1).otherwise(0)
    base = base.withColumn("_batch", batch).withColumn("_text_hash", F.xxhash64("text"))
    path = shared(docs.sparkSession, "lines")
    _lines(base, least).write.partitionBy("_batch").parquet(path)
    lines = docs.sparkSession.read.schema("_doc long, _text_hash long, pos int, h1 long, h2 long, _batch int").parquet(path)
    runs = Runs(docs.sparkSession, fanout)
    bad = repeated(lines, n_batches, runs)
    runs.drop(list(runs.paths))
    hit = lines.join(bad, ["h1", "h2", "_batch"]).filter("owner is null or owner <> _doc")
    drops = hit.groupBy("_doc", "_text_hash").agg(F.collect_set("pos").alias("_drop"))
    out = base.join(drops, ["_doc", "_text_hash"], "left")
    all_lines = F.split("text", "\n", -1)
    out = out.withColumn("_lines", all_lines).withColumn("n_lines", F.size("_lines").cast("long"))
    stay = F.array_except(F.sequence(F.lit(0), F.size("_lines") - 1), "_drop")
    kept = F.when(F.col("_drop").isNull(), F.col("text")).otherwise(F.array_join(F.transform(stay, lambda i: F.element_at("_lines", i + 1)), "\n"))
    return out.select("doc_id", "n_lines", F.coalesce(F.size("_drop"), F.lit(0)).cast("long").alias("n_dropped"), kept.alias("text"))


@query
def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = dedup_lines(read(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


SQL = r"""
WITH d AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
l AS (SELECT doc_id, unnest(range(len(ls))) AS pos, unnest(ls) AS line FROM d),
k AS (SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
  'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
o AS (SELECT key, min(doc_id) AS owner FROM k WHERE length(key) >= 10 GROUP BY key HAVING min(doc_id) <> max(doc_id)),
m AS (SELECT k.doc_id, pos, line, o.owner IS NOT NULL AND o.owner <> k.doc_id AS bad FROM k LEFT JOIN o USING (key))
SELECT doc_id, CAST(count(*) AS BIGINT) AS n_lines, CAST(count(*) FILTER (bad) AS BIGINT) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT bad), '')) AS kept_sha256
FROM m GROUP BY doc_id
"""
