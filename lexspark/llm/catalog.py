"""The registered queries of the training-data operators, and SQL where SQL can state their rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lexspark.llm import bpe, gif, gru, jaccard, langid, lines, packing, repeats, vectors, warc


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_language_id": langid.op1_language_id,
        "op2_ngram_jaccard": jaccard.op2_ngram_jaccard,
        "op3_suffix_dedup": repeats.op3_suffix_dedup,
        "op4_warc_revisits": warc.op4_warc_revisits,
        "op5_vector_packing": packing.op5_vector_packing,
        "op6_bpe_codec": bpe.op6_bpe_codec,
        "op7_line_dedup": lines.op7_line_dedup,
        "op8_itq_neardup": vectors.op8_itq_neardup,
        "op9_gif_media": gif.op9_gif_media,
        "op10_gru_score": gru.op10_gru_score,
    }


def oracle_sql() -> dict[str, str]:
    return {"op4_warc_revisits": warc.OP4_SQL, "op7_line_dedup": lines.OP7_SQL}
