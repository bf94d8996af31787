"""The subpackage's queries and, where SQL can say the same, their DuckDB oracles."""

from .embeddings import op6_embedding_links
from .language_id import op1_language_id
from .media import op10_media_columns
from .mixing import op2_mix_sources
from .secrets import op5_secret_scan
from .sentencepieces import op8_sentencepiece
from .simhash import op7_simhash
from .token_counts import op4_token_counts
from .toxicity import op9_toxicity
from .warc import OP3_SQL, op3_warc

QUERIES = {
    "op1_language_id": op1_language_id,
    "op2_mix_sources": op2_mix_sources,
    "op3_warc": op3_warc,
    "op4_token_counts": op4_token_counts,
    "op5_secret_scan": op5_secret_scan,
    "op6_embedding_links": op6_embedding_links,
    "op7_simhash": op7_simhash,
    "op8_sentencepiece": op8_sentencepiece,
    "op9_toxicity": op9_toxicity,
    "op10_media_columns": op10_media_columns,
}

ORACLE = {"op3_warc": OP3_SQL}
