"""The registered queries of this subpackage and their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import lattice, line_dedup, near_dups, warc
from .binary_tokens import op3_binary_tokens
from .decontaminate import op7_decontaminate
from .lattice import op10_lattice
from .line_dedup import op5_line_dedup
from .maxent import op2_maxent
from .mixing import op4_mixing
from .near_dups import op6_near_dups
from .quality import op1_quality
from .secrets import op9_secrets
from .warc import op8_warc

QUERIES = (op1_quality, op2_maxent, op3_binary_tokens, op4_mixing, op5_line_dedup, op6_near_dups, op7_decontaminate, op8_warc, op9_secrets, op10_lattice)
SQL: dict[str, str] = {"op5_line_dedup": line_dedup.SQL, "op6_near_dups": near_dups.SQL, "op8_warc": warc.SQL, "op10_lattice": lattice.SQL}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    import corpus_pipeline

    return {f.__name__: f for f in QUERIES} | {"pipeline": corpus_pipeline.run}


def oracle_sql() -> dict[str, str]:
    import corpus_pipeline

    return SQL | ({"pipeline": corpus_pipeline.ORACLE_SQL} if corpus_pipeline.ORACLE_SQL else {})
