"""The queries of this subpackage by name, and SQL for those that SQL can express."""

from __future__ import annotations

from .hamming_search import OP7_SQL, op7_hamming_search
from .hilbert_shards import OP10_SQL, op10_hilbert_shards
from .jaccard_join import OP4_SQL, op4_jaccard_join
from .mixing import op5_mixing
from .packing import op8_packing
from .quality import op1_quality
from .token_attribution import op6_token_counts
from .transcripts import op9_transcripts
from .vector_dedup import OP3_SQL, op3_vector_dedup
from .warc import OP2_SQL, op2_warc

QUERIES = {
    "op1_quality": op1_quality,
    "op2_warc": op2_warc,
    "op3_vector_dedup": op3_vector_dedup,
    "op4_jaccard_join": op4_jaccard_join,
    "op5_mixing": op5_mixing,
    "op6_token_counts": op6_token_counts,
    "op7_hamming_search": op7_hamming_search,
    "op8_packing": op8_packing,
    "op9_transcripts": op9_transcripts,
    "op10_hilbert_shards": op10_hilbert_shards,
}

ORACLES: dict[str, str] = {
    "op2_warc": OP2_SQL,
    "op3_vector_dedup": OP3_SQL,
    "op4_jaccard_join": OP4_SQL,
    "op7_hamming_search": OP7_SQL,
    "op10_hilbert_shards": OP10_SQL,
}
