"""The registered queries of this subpackage, and the SQL of those that SQL can express."""

from __future__ import annotations

from snapgrid.llm.chat import OP9_SQL, op9_chat
from snapgrid.llm.exact_dedup import OP5_SQL, op5_exact_dedup
from snapgrid.llm.fingerprints import op7_fingerprints
from snapgrid.llm.lexical import OP12_SQL, op12_lexical_search
from snapgrid.llm.line_dedup import OP4_SQL, op4_line_dedup
from snapgrid.llm.merkle import OP13_SQL, op13_merkle
from snapgrid.llm.minhash import OP11_SQL, op11_minhash
from snapgrid.llm.mixing import op2_mixing
from snapgrid.llm.ngram_join import OP1_SQL, op1_ngram_join
from snapgrid.llm.pieces import op10_sentencepiece
from snapgrid.llm.sharding import OP3_SQL, op3_sharding
from snapgrid.llm.token_store import op8_token_store
from snapgrid.llm.toxicity import op6_toxicity


QUERIES = {
    "op1_ngram_join": op1_ngram_join,
    "op2_mixing": op2_mixing,
    "op3_sharding": op3_sharding,
    "op4_line_dedup": op4_line_dedup,
    "op5_exact_dedup": op5_exact_dedup,
    "op6_toxicity": op6_toxicity,
    "op7_fingerprints": op7_fingerprints,
    "op8_token_store": op8_token_store,
    "op9_chat": op9_chat,
    "op10_sentencepiece": op10_sentencepiece,
    "op11_minhash": op11_minhash,
    "op12_lexical_search": op12_lexical_search,
    "op13_merkle": op13_merkle,
}

ORACLE = {
    "op1_ngram_join": OP1_SQL,
    "op3_sharding": OP3_SQL,
    "op4_line_dedup": OP4_SQL,
    "op5_exact_dedup": OP5_SQL,
    "op9_chat": OP9_SQL,
    "op11_minhash": OP11_SQL,
    "op12_lexical_search": OP12_SQL,
    "op13_merkle": OP13_SQL,
}
