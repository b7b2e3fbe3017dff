"""The queries of the training-data operators, and SQL where it gives the same rows."""

from __future__ import annotations

from .bpe import op4_bpe
from .chat import OP6_SQL, op6_chat
from .langid import op2_langid
from .lexical import OP13_SQL, op13_lexical
from .line_dedup import OP8_SQL, op8_line_dedup
from .packing import op7_packing
from .pii import OP1_SQL, op1_pii
from .runs import op11_runs
from .secrets import op3_secrets
from .sharding import OP12_SQL, op12_sharding
from .simhash import op5_simhash
from .spotsigs import op10_spotsigs, spotsigs_classes
from .topk import OP9_SQL, op9_topk

QUERIES = {
    "op1_pii": op1_pii,
    "op2_langid": op2_langid,
    "op3_secrets": op3_secrets,
    "op4_bpe": op4_bpe,
    "op5_simhash": op5_simhash,
    "op6_chat": op6_chat,
    "op7_packing": op7_packing,
    "op8_line_dedup": op8_line_dedup,
    "op9_topk": op9_topk,
    "op10_spotsigs": op10_spotsigs,
    "op11_runs": op11_runs,
    "op12_sharding": op12_sharding,
    "op13_lexical": op13_lexical,
    "spotsigs_classes": spotsigs_classes,
}

ORACLES: dict[str, str] = {
    "op1_pii": OP1_SQL, "op6_chat": OP6_SQL, "op8_line_dedup": OP8_SQL, "op9_topk": OP9_SQL, "op12_sharding": OP12_SQL,
    "op13_lexical": OP13_SQL,
}
