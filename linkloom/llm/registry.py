"""Queries of this subpackage and, where SQL can express them, their SQL for DuckDB."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from linkloom.llm.conversation_repair import op11_conversations
from linkloom.llm.importance import OP12_SQL, op12_importance
from linkloom.llm.interpolation import op13_interpolation
from linkloom.llm.lines import OP2_SQL, op2_lines
from linkloom.llm.minhash import OP5_SQL, op5_minhash
from linkloom.llm.mixing import op7_mixing
from linkloom.llm.neighbours import OP4_SQL, op4_neighbours
from linkloom.llm.packing import op6_packing
from linkloom.llm.quality import op10_quality
from linkloom.llm.secrets import op1_secrets
from linkloom.llm.substrings import op3_substrings
from linkloom.llm.token_counts import op9_token_counts
from linkloom.llm.toxicity import op8_toxicity


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    import corpus_pipeline

    found = {f.__name__: f for f in (op1_secrets, op2_lines, op3_substrings, op4_neighbours, op5_minhash, op6_packing, op7_mixing, op8_toxicity, op9_token_counts, op10_quality, op11_conversations, op12_importance, op13_interpolation)}
    return found | {"pipeline": corpus_pipeline.run}


def oracle_sql() -> dict[str, str]:
    return {"op2_lines": OP2_SQL, "op4_neighbours": OP4_SQL, "op5_minhash": OP5_SQL, "op12_importance": OP12_SQL}
