"""The registered queries of this subpackage and their DuckDB twins."""

from __future__ import annotations

from . import chat, mixing, prefix_trie, quality, url_filter
from .alignment import op13_token_alignment
from .byte_bpe import op1_byte_bpe
from .chat import op8_chat_format
from .decontaminate import op7_decontamination
from .mixing import op12_source_mix
from .ngram_join import op10_ngram_jaccard_join
from .prefix_trie import op11_prefix_trie
from .quality import op4_quality_rules
from .sharding import op3_sharding
from .token_counts import op2_token_counts
from .toxicity import op5_toxicity
from .url_filter import op6_url_filters
from .wavelet import op9_wavelet_shards

QUERIES = {f.__name__: f for f in (
    op1_byte_bpe, op2_token_counts, op3_sharding, op4_quality_rules, op5_toxicity, op6_url_filters, op7_decontamination,
    op8_chat_format, op9_wavelet_shards, op10_ngram_jaccard_join, op11_prefix_trie, op12_source_mix, op13_token_alignment)}

#: The others can't be stated in SQL (merges, samples, fits, files, components): tests/llm holds
#: them against brute force, the tokenizer libraries or held-out labels.
ORACLE_SQL = {"op4_quality_rules": quality.oracle_sql(), "op6_url_filters": url_filter.oracle_sql(),
              "op8_chat_format": chat.oracle_sql(), "op11_prefix_trie": prefix_trie.oracle_sql(), "op12_source_mix": mixing.oracle_sql()}
