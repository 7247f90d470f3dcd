"""The training-data operators' queries and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import exact_dedup, fill_middle, hard_negatives, substring_dedup
from .byte_bpe import op3_byte_bpe
from .class_lm import op4_class_lm
from .curve_search import op7_curve_search
from .exact_dedup import op9_exact_dedup
from .fill_middle import op13_fill_middle
from .hard_negatives import op12_hard_negatives
from .lexicon_bpe import op11_lexicon_bpe
from .ngram_join import op10_ngram_join
from .packing import op5_packing
from .quality import op6_quality
from .sharding import op8_sharding
from .substring_dedup import op1_substring_dedup
from .toxicity import op2_toxicity


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {
    "op1_substring_dedup": op1_substring_dedup, "op2_toxicity": op2_toxicity, "op3_byte_bpe": op3_byte_bpe, "op4_class_lm": op4_class_lm,
    "op5_packing": op5_packing, "op6_quality": op6_quality, "op7_curve_search": op7_curve_search, "op8_sharding": op8_sharding,
    "op9_exact_dedup": op9_exact_dedup, "op10_ngram_join": op10_ngram_join, "op11_lexicon_bpe": op11_lexicon_bpe, "op12_hard_negatives": op12_hard_negatives,
    "op13_fill_middle": op13_fill_middle, "pipeline": pipeline,
}
SQL = {"op1_substring_dedup": substring_dedup.ORACLE, "op9_exact_dedup": exact_dedup.ORACLE, "op12_hard_negatives": hard_negatives.ORACLE, "op13_fill_middle": fill_middle.ORACLE}
