"""The registered queries for the reference's operators, and the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tunemill.plans import q_extra, q_messages, q_metrics, q_more, q_selection, q_sequence, q_streams, q_training

FLAGSHIP = "prepare_flagship"
_MODULES = (q_selection, q_messages, q_training, q_metrics, q_extra, q_more, q_sequence, q_streams)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {k: q for m in _MODULES for k, q in m.QUERIES.items()}
ORACLE_SQL: dict[str, str] = {k: q for m in _MODULES for k, q in m.ORACLE_SQL.items()}
