"""The queries of this subpackage by name, and their SQL where SQL can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from loomspan.llm.decontaminate import OP3_SQL, op3_spaced_seed_leaks
from loomspan.llm.langid import op2_language_mixture
from loomspan.llm.media import op10_media_archive
from loomspan.llm.mixing import OP8_SQL, op8_systematic_mix
from loomspan.llm.ngram_lm import op4_elias_fano_trie
from loomspan.llm.pii import op1_bilstm_crf_pii
from loomspan.llm.sharding import op7_interleaved_shards
from loomspan.llm.simhash import op9_simhash_pigeonring
from loomspan.llm.spelling import OP11_SQL, op11_anagram_variants
from loomspan.llm.substring import OP5_SQL, op5_log_structured_substrings
from loomspan.llm.token_counts import op12_digest_cache
from loomspan.llm.token_store import op6_token_store
from loomspan.llm.turns import op13_turn_layers


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    import corpus_pipeline

    return {"pipeline": corpus_pipeline.run} | {
        f.__name__: f
        for f in (op1_bilstm_crf_pii, op2_language_mixture, op3_spaced_seed_leaks, op4_elias_fano_trie, op5_log_structured_substrings, op6_token_store, op7_interleaved_shards, op8_systematic_mix, op9_simhash_pigeonring, op10_media_archive,
            op11_anagram_variants, op12_digest_cache, op13_turn_layers)
    }


def oracles() -> dict[str, str]:
    return {"op3_spaced_seed_leaks": OP3_SQL, "op5_log_structured_substrings": OP5_SQL, "op8_systematic_mix": OP8_SQL, "op11_anagram_variants": OP11_SQL}
