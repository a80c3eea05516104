"""The operators' queries and their SQL, for __spark_entry__.py."""

from __future__ import annotations

from . import chat, exact, jaccard, runs, trie
from .chat import op4_chat_format
from .decontaminate import op6_decontaminate
from .exact import op9_exact_dedup
from .jaccard import op13_ngram_jaccard
from .language import op7_language_id
from .pieces import op10_sentencepiece
from .runs import op11_periodic_runs
from .simhash import op1_simhash_dedup
from .token_files import op5_token_files
from .tokens import op2_token_counts
from .toxicity import op8_toxicity
from .trie import op12_prefix_trie
from .urls import op3_url_filter

QUERIES = {
    f.__name__: f
    for f in (op1_simhash_dedup, op2_token_counts, op3_url_filter, op4_chat_format, op5_token_files, op6_decontaminate, op7_language_id, op8_toxicity, op9_exact_dedup, op10_sentencepiece, op11_periodic_runs, op12_prefix_trie, op13_ngram_jaccard)
}
SQL = exact.SQL | chat.SQL | runs.SQL | trie.SQL | jaccard.SQL
