"""The queries of this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

from .ann import op5_multi_index_neighbours
from .bpe import op4_bpe_ids
from .fingerprints import OP2_SQL, op2_paragraph_sketches
from .langid import op8_language_spans
from .linededup import op7_fuzzy_lines
from .mixing import op3_source_mixture
from .quality import op10_co_trained_quality
from .records import op6_record_files
from .sharding import op1_karmarkar_karp_shards
from .simhash import op9_simhash_pigeonring

QUERIES = {f.__name__: f for f in (op1_karmarkar_karp_shards, op2_paragraph_sketches, op3_source_mixture, op4_bpe_ids, op5_multi_index_neighbours, op6_record_files, op7_fuzzy_lines, op8_language_spans, op9_simhash_pigeonring, op10_co_trained_quality)}

ORACLE_SQL = {"op2_paragraph_sketches": OP2_SQL}
