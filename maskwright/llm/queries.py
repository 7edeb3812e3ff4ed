"""The registered queries of this subpackage and, where SQL can express them, their SQL."""

from __future__ import annotations

from .audit import OP12_SQL, op12_audit
from .dedup import OP8_SQL, op8_minhash
from .fingerprint import op2_fingerprint
from .html import op9_html
from .idplanes import op11_idplanes
from .impact import OP13_SQL, op13_impact
from .langid import op10_langid
from .mixing import op5_mixing
from .pieces import op4_sentencepiece
from .pii import op3_pii
from .topk import OP7_SQL, op7_topk
from .toxicity import op1_toxicity
from .warc import OP6_SQL, op6_warc

_ALL = (op1_toxicity, op2_fingerprint, op3_pii, op4_sentencepiece, op5_mixing, op6_warc, op7_topk, op8_minhash, op9_html, op10_langid, op11_idplanes, op12_audit, op13_impact)
QUERIES = {f.__name__: f for f in _ALL}

ORACLE_SQL: dict[str, str] = {"op6_warc": OP6_SQL, "op7_topk": OP7_SQL, "op8_minhash": OP8_SQL, "op12_audit": OP12_SQL, "op13_impact": OP13_SQL}
