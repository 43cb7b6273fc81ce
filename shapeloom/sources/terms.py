"""Graph terms: the node struct of the tables and its Python form."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

IRI, BNODE, LITERAL = 0, 1, 2
# fixed values: the standards' vocabularies
RDF = "http://www.w3.org/1999/02/22-rdf-syntax-ns#"
RDFS = "http://www.w3.org/2000/01/rdf-schema#"
XSD = "http://www.w3.org/2001/XMLSchema#"
OWL = "http://www.w3.org/2002/07/owl#"
SH = "http://www.w3.org/ns/shacl#"
SX = "http://www.w3.org/ns/shex#"
TYPE, SUBCLASS = RDF + "type", RDFS + "subClassOf"
STRING, LANGSTRING = XSD + "string", RDF + "langString"

#: No field of a node is ever null: an absent datatype or language is the empty string.
NODE = T.StructType([T.StructField("kind", T.ByteType(), False), T.StructField("lex", T.StringType(), False), T.StructField("dt", T.StringType(), False), T.StructField("lang", T.StringType(), False)])
TRIPLE = T.StructType([T.StructField("s", NODE, False), T.StructField("p", T.StringType(), False), T.StructField("o", NODE, False)])


class Node(NamedTuple):
    kind: int
    lex: str
    dt: str = ""
    lang: str = ""

    def nt(self) -> str:
        """The term in N-Triples."""
        if self.kind == IRI:
            return f"<{self.lex}>"
        if self.kind == BNODE:
            return f"_:{self.lex}"
        text = self.lex.replace("\\", "\\\\").replace('"', '\\"').replace("\n", "\\n").replace("\r", "\\r")
        return f'"{text}"' + (f"@{self.lang}" if self.lang else "" if self.dt == STRING else f"^^<{self.dt}>")


def iri(x: str) -> Node:
    return Node(IRI, x)


def literal(lex: str, dt: str = STRING, lang: str = "") -> Node:
    return Node(LITERAL, lex, LANGSTRING if lang else dt, lang.lower())


def node(kind: int, lex: Column, dt: str | Column = "", lang: str | Column = "") -> Column:
    """A node column; `lex` must not be null."""
    c = lambda x: x if isinstance(x, Column) else F.lit(x)
    return F.struct(F.lit(kind).cast("byte").alias("kind"), lex.alias("lex"), c(dt).alias("dt"), c(lang).alias("lang"))


def constant(n: Node) -> Column:
    return node(n.kind, F.lit(n.lex), n.dt, n.lang)


def same(col: Column, n: Node) -> Column:
    """Term equality with a constant."""
    return (col["kind"] == n.kind) & (col["lex"] == n.lex) & (col["dt"] == n.dt) & (col["lang"] == n.lang)


def text(col: Column) -> Column:
    """The N-Triples form of a node column."""
    esc = col["lex"]
    for a, b in (("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n"), ("\r", "\\r")):
        esc = F.replace(esc, F.lit(a), F.lit(b))
    tail = F.when(col["lang"] != "", F.concat(F.lit("@"), col["lang"])).when(col["dt"] == STRING, F.lit("")).otherwise(F.concat(F.lit("^^<"), col["dt"], F.lit(">")))
    return F.when(col["kind"] == IRI, F.concat(F.lit("<"), col["lex"], F.lit(">"))).when(col["kind"] == BNODE, F.concat(F.lit("_:"), col["lex"])).otherwise(F.concat(F.lit('"'), esc, F.lit('"'), tail))
