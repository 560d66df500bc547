"""Queries of the corpus operators, and their SQL where SQL can express them."""

from .bpe import op5_byte_bpe
from .exact_dedup import ORACLE_OP1, op1_exact_dedup
from .licenses import op9_licenses, oracle_op9
from .packing import op8_packing
from .quality import op10_quality
from .repeats import op3_repeats
from .secrets import op2_secrets
from .sharding import op7_sharding
from .simhash import op4_simhash
from .warc import ORACLE_OP6, op6_warc


def queries() -> dict:
    every = (op1_exact_dedup, op2_secrets, op3_repeats, op4_simhash, op5_byte_bpe, op6_warc, op7_sharding, op8_packing, op9_licenses, op10_quality)
    return {f.__name__: f for f in every}


def oracle_sql() -> dict[str, str]:
    return {"op1_exact_dedup": ORACLE_OP1, "op6_warc": ORACLE_OP6, "op9_licenses": oracle_op9()}
