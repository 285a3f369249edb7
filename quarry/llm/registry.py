"""The queries of this subpackage, and their SQL where it can express them."""

from __future__ import annotations

from quarry.llm.chat import OP6_SQL, op6_chat
from quarry.llm.decontam import OP4_SQL, op4_decontaminate
from quarry.llm.divergence import OP12_SQL, op12_divergence
from quarry.llm.exact_dedup import OP9_SQL, op9_exact_dedup
from quarry.llm.minhash import OP7_SQL, op7_minhash
from quarry.llm.packing import op11_packing
from quarry.llm.pieces import op2_pieces
from quarry.llm.secrets import op10_secrets
from quarry.llm.suffix_dedup import op8_repeats
from quarry.llm.token_counts import op5_token_counts
from quarry.llm.toxicity import op3_toxicity
from quarry.llm.valid_time import OP13_SQL, op13_valid_time
from quarry.llm.warc import OP1_SQL, op1_warc

QUERIES = {
    "op1_warc": op1_warc,
    "op2_pieces": op2_pieces,
    "op3_toxicity": op3_toxicity,
    "op4_decontaminate": op4_decontaminate,
    "op5_token_counts": op5_token_counts,
    "op6_chat": op6_chat,
    "op7_minhash": op7_minhash,
    "op8_repeats": op8_repeats,
    "op9_exact_dedup": op9_exact_dedup,
    "op10_secrets": op10_secrets,
    "op11_packing": op11_packing,
    "op12_divergence": op12_divergence,
    "op13_valid_time": op13_valid_time,
}

SQL = {
    "op1_warc": OP1_SQL,
    "op4_decontaminate": OP4_SQL,
    "op6_chat": OP6_SQL,
    "op7_minhash": OP7_SQL,
    "op9_exact_dedup": OP9_SQL,
    "op12_divergence": OP12_SQL,
    "op13_valid_time": OP13_SQL,
}
