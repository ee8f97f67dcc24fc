"""The queries op1 to op10 by name, and their SQL."""

from __future__ import annotations

from . import op1_decontamination as op1
from . import op2_minhash_dedup as op2
from . import op3_mixing as op3
from . import op4_quality_crf as op4
from . import op5_syncmers as op5
from . import op6_repeated_bytes as op6
from . import op7_substring_dedup as op7
from . import op8_chat_format as op8
from . import op9_licences as op9
from . import op10_toxicity as op10

QUERIES = {
    f.__name__: f
    for f in (
        op1.op1_decontamination, op2.op2_minhash_dedup, op3.op3_mixing, op4.op4_quality_crf, op5.op5_syncmers,
        op6.op6_repeated_bytes, op7.op7_substring_dedup, op8.op8_chat_format, op9.op9_licences, op10.op10_toxicity,
    )
}
ORACLES = {"op1_decontamination": op1.SQL, "op2_minhash_dedup": op2.SQL, "op7_substring_dedup": op7.SQL, "op8_chat_format": op8.SQL}
