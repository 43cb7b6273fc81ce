"""Direct mapping of tables to triples, predicate by predicate, so that a plan scans only what it uses.

A row of table t with key k is <urn:t/t/k>, of class <urn:c/t>; a column is <urn:p/column>, with a typed
literal as its object or, for a foreign key, the parent row. Keyless tables are not mapped. Where all keys
are unique the triples are a set without an exchange; whether they are is looked up once for each table (`unique=None`), and
duplicates are removed where they are not. `unique` tells it instead: True for declared keys, False for none.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import shared
from .terms import IRI, LITERAL, STRING, TRIPLE, TYPE, XSD, Node, iri, node

KEYS = {"region": ["r_regionkey"], "nation": ["n_nationkey"], "customer": ["c_custkey"], "supplier": ["s_suppkey"], "part": ["p_partkey"], "orders": ["o_orderkey"], "events": ["event_id"], "documents": ["doc_id"], "pages": ["page_id"], "benchmark": ["item_id"], "labels": ["doc_id"], "conversations": ["conv_id", "turn"]}
PARENTS = {("nation", "n_regionkey"): "region", ("customer", "c_nationkey"): "nation", ("supplier", "s_nationkey"): "nation", ("orders", "o_custkey"): "customer", ("lineitem", "l_partkey"): "part", ("lineitem", "l_suppkey"): "supplier", ("lineitem", "l_orderkey"): "orders", ("labels", "doc_id"): "documents"}
_unique: dict[str, dict[tuple, bool]] = {}
_TYPES = {"int": "integer", "bigint": "integer", "smallint": "integer", "tinyint": "integer", "double": "double", "float": "double", "boolean": "boolean", "timestamp": "dateTime", "timestamp_ntz": "dateTime", "date": "date", "string": "string"}


def row(table: str, *keys: Column) -> Column:
    return node(IRI, F.concat_ws("/", F.lit(f"urn:t/{table}"), *(k.cast("string") for k in keys)))


def cls(table: str) -> Node:
    return iri(f"urn:c/{table}")


def prop(column: str) -> str:
    return f"urn:p/{column}"


def typed(c: Column, dtype: str) -> Column:
    """A column's values as literals; timestamps in the session's zone, with as many digits of a second as they have."""
    t = _TYPES.get(dtype, "decimal" if dtype.startswith("decimal") else None)
    if t is None:
        raise ValueError(f"columns of type {dtype} have no literal form")
    lex = instant(c) if t == "dateTime" else c.cast("string")
    return node(LITERAL, lex, STRING if t == "string" else XSD + t)


def instant(c: Column) -> Column:
    """A timestamp as an xsd:dateTime: no fraction of a second where it is 0, else without zeros at its end."""
    return F.rtrim(F.rtrim(F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), F.lit("0")), F.lit("."))


class Tables:
    """The graph of a folder of Parquet tables."""

    def __init__(self, spark: SparkSession, folder: str, keys: dict | None = None, parents: dict | None = None, unique: bool | None = None):
        self.spark, self.folder = shared.fine(spark), folder
        self.keys, self.parents, self.unique = keys or KEYS, parents or PARENTS, unique

    def _unique(self, name: str) -> bool:
        """Whether no two rows of a table share their key; one pass over its key columns, once a session and path."""
        if self.unique is not None:
            return self.unique
        known = _unique.setdefault(self.spark.sparkContext.applicationId, {})
        at = (self.folder, name, *self.keys[name])
        if at not in known:
            known[at] = self.table(name).groupBy(*self.keys[name]).count().filter("count > 1").isEmpty()
        return known[at]

    def _set(self, triples: DataFrame, name: str) -> DataFrame:
        return triples if self._unique(name) else triples.distinct()

    def table(self, name: str) -> DataFrame:
        t = self.spark.read.parquet(f"{self.folder}/{name}.parquet")
        shared.fit(self.spark, t)
        return t

    def types(self, name: str) -> DataFrame:
        """rdf:type triples of a table's rows."""
        from .terms import constant

        t = self.table(name)
        return self._set(t.select(row(name, *(F.col(k) for k in self.keys[name])).alias("s"), F.lit(TYPE).alias("p"), constant(cls(name)).alias("o")), name)

    def column(self, name: str, column: str) -> DataFrame:
        """Triples of one column; nulls have none."""
        t = self.table(name)
        c = F.col(column)
        parent = self.parents.get((name, column))
        o = row(parent, c) if parent else typed(c, dict(t.dtypes)[column])
        return self._set(t.filter(c.isNotNull()).select(row(name, *(F.col(k) for k in self.keys[name])).alias("s"), F.lit(prop(column)).alias("p"), o.alias("o")), name)

    def links(self, name: str, a: str, b: str, predicate: str) -> DataFrame:
        """Arcs between the parents that two foreign keys of a (keyless) table name."""
        return self._arcs(name, a, F.col(b), predicate, lambda x: row(self.parents[name, b], x))

    def arcs(self, name: str, key: str, terms: dict[str, tuple[Column, Callable[[Column], Column]]]) -> DataFrame:
        """Arcs from the parents that a foreign key of a (keyless) table names; by column, the value and the term made of it, which must differ where values do."""
        return reduce(lambda a, b: a.unionByName(b), (self._arcs(name, key, value, prop(c), term) for c, (value, term) in terms.items()))

    def _arcs(self, name: str, key: str, value: Column, predicate: str, term: Callable[[Column], Column]) -> DataFrame:
        """A set of arcs; repeated ones are removed by their values, which take a fraction of their terms' memory."""
        t = self.table(name).select(F.col(key).alias("_k"), value.alias("_v")).filter("_k IS NOT NULL AND _v IS NOT NULL").distinct()
        return t.select(row(self.parents[name, key], F.col("_k")).alias("s"), F.lit(predicate).alias("p"), term(F.col("_v")).alias("o"))

    def graph(self, *wanted) -> DataFrame:
        """The union of parts: "table" for its types, "table.column", or a table of triples."""
        parts = [w if isinstance(w, DataFrame) else self.column(*w.split(".")) if "." in w else self.types(w) for w in wanted]
        return reduce(lambda a, b: a.unionByName(b), parts) if parts else self.spark.createDataFrame([], TRIPLE)
