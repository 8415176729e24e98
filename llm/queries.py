"""The queries of this subpackage and their SQL, by name."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

import corpus_pipeline
from llm.op1_decontaminate import ORACLE_SQL as op1_decontaminate_sql
from llm.op1_decontaminate import op1_decontaminate
from llm.op2_packing import op2_packing
from llm.op3_suffixes import op3_suffixes
from llm.op4_chat import ORACLE_SQL as op4_chat_sql
from llm.op4_chat import op4_chat
from llm.op5_quality import op5_quality
from llm.op6_permutation import op6_permutation
from llm.op7_sharding import op7_sharding
from llm.op8_secrets import op8_secrets
from llm.op9_suffix_tree import op9_suffix_tree
from llm.op10_minhash import ORACLE_SQL as op10_minhash_sql
from llm.op10_minhash import op10_minhash
from llm.op11_divergence import ORACLE_SQL as op11_divergence_sql
from llm.op11_divergence import op11_divergence
from llm.op12_sentencepiece import op12_sentencepiece
from llm.op13_prefix_trie import ORACLE_SQL as op13_prefix_trie_sql
from llm.op13_prefix_trie import op13_prefix_trie


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages of corpus_pipeline.py on `documents`."""
    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {
    "pipeline": pipeline,
    "op1_decontaminate": op1_decontaminate,
    "op2_packing": op2_packing,
    "op3_suffixes": op3_suffixes,
    "op4_chat": op4_chat,
    "op5_quality": op5_quality,
    "op6_permutation": op6_permutation,
    "op7_sharding": op7_sharding,
    "op8_secrets": op8_secrets,
    "op9_suffix_tree": op9_suffix_tree,
    "op10_minhash": op10_minhash,
    "op11_divergence": op11_divergence,
    "op12_sentencepiece": op12_sentencepiece,
    "op13_prefix_trie": op13_prefix_trie,
}

ORACLES: dict[str, str] = {
    "op1_decontaminate": op1_decontaminate_sql,
    "op4_chat": op4_chat_sql,
    "op10_minhash": op10_minhash_sql,
    "op11_divergence": op11_divergence_sql,
    "op13_prefix_trie": op13_prefix_trie_sql,
}
if corpus_pipeline.ORACLE_SQL is not None:
    ORACLES["pipeline"] = corpus_pipeline.ORACLE_SQL
