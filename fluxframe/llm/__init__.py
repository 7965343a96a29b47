"""Operations of a training-data pipeline: the operators, and their queries and SQL for the driver.

Nothing else in this library imports this subpackage.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from fluxframe.llm import bpe, bytecnn, divergence, lines, minhash, mixing, ogg, repair, sharding, spans, tokenfiles, toolcalls, vafile


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_mixing": mixing.op1_mixing,
        "op2_minhash": minhash.op2_minhash,
        "op3_sharding": sharding.op3_sharding,
        "op4_spans": spans.op4_spans,
        "op5_toolcalls": toolcalls.op5_toolcalls,
        "op6_bytecnn": bytecnn.op6_bytecnn,
        "op7_bpe": bpe.op7_bpe,
        "op8_tokenfiles": tokenfiles.op8_tokenfiles,
        "op9_vafile": vafile.op9_vafile,
        "op10_ogg": ogg.op10_ogg,
        "op11_repair": repair.op11_repair,
        "op12_lines": lines.op12_lines,
        "op13_divergence": divergence.op13_divergence,
    }


def oracle_sql() -> dict[str, str]:
    return {"op2_minhash": minhash.SQL, "op5_toolcalls": toolcalls.SQL, "op9_vafile": vafile.SQL, "op11_repair": repair.SQL, "op12_lines": lines.SQL, "op13_divergence": divergence.SQL}
