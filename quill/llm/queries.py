"""The queries of this subpackage, for __spark_entry__.py."""

from __future__ import annotations

from .alignment import op13_alignment
from .byte_bpe import op7_byte_bpe
from .decontamination import OP1_SQL, op1_decontamination
from .embeddings import OP9_SQL, op9_embeddings
from .html_text import OP2_SQL, op2_html
from .lattice_lm import op4_lattice_lm
from .packing import op11_packing
from .quality import op3_quality
from .sharding import op10_sharding
from .simhash import op8_simhash
from .spelling import OP12_SQL, op12_spelling
from .substrings import OP6_SQL, op6_substrings
from .token_files import op5_token_files

QUERIES = {
    "op1_decontamination": op1_decontamination,
    "op2_html": op2_html,
    "op3_quality": op3_quality,
    "op4_lattice_lm": op4_lattice_lm,
    "op5_token_files": op5_token_files,
    "op6_substrings": op6_substrings,
    "op7_byte_bpe": op7_byte_bpe,
    "op8_simhash": op8_simhash,
    "op9_embeddings": op9_embeddings,
    "op10_sharding": op10_sharding,
    "op11_packing": op11_packing,
    "op12_spelling": op12_spelling,
    "op13_alignment": op13_alignment,
}
#: The others hash, fit or encode in ways that SQL has no functions for; tests/llm holds them against brute force.
ORACLE_SQL = {"op1_decontamination": OP1_SQL, "op2_html": OP2_SQL, "op6_substrings": OP6_SQL, "op9_embeddings": OP9_SQL, "op12_spelling": OP12_SQL}
