"""The queries of the operators of this subpackage, and their SQL where SQL can say it."""

from .ann import op1_ivf_pq
from .byte_bpe import op4_byte_bpe
from .class_lm import op6_class_lm
from .decontamination import op5_decontamination
from .licenses import op9_licenses
from .licenses import oracle_sql as licenses_sql
from .ngram_join import op3_ngram_join
from .passages import op7_repeated_passages
from .sharding import op12_byte_shards
from .sharding import oracle_sql as shards_sql
from .token_files import op2_token_files
from .toxicity import op10_toxicity
from .trie_counts import op8_trie_counts
from .vector_codes import op11_vector_codes
from .vector_codes import oracle_sql as codes_sql
from .whitening import op13_whitening

QUERIES = {"op1_ivf_pq": op1_ivf_pq, "op2_token_files": op2_token_files, "op3_ngram_join": op3_ngram_join, "op4_byte_bpe": op4_byte_bpe, "op5_decontamination": op5_decontamination, "op6_class_lm": op6_class_lm, "op7_repeated_passages": op7_repeated_passages, "op8_trie_counts": op8_trie_counts, "op9_licenses": op9_licenses, "op10_toxicity": op10_toxicity, "op11_vector_codes": op11_vector_codes, "op12_byte_shards": op12_byte_shards, "op13_whitening": op13_whitening}
ORACLE_SQL: dict[str, str] = {"op9_licenses": licenses_sql(), "op11_vector_codes": codes_sql(), "op12_byte_shards": shards_sql()}
