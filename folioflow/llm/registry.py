"""Queries of the training-data operators and, where SQL can express them, their SQL."""

from folioflow.llm.decontaminate import OP2_SQL, op2_decontaminate
from folioflow.llm.langid import op1_langid
from folioflow.llm.mixing import OP4_SQL, op4_mix
from folioflow.llm.near_dedup import OP7_SQL, op7_near_dedup
from folioflow.llm.packing import op13_pack
from folioflow.llm.periodic import OP12_SQL, op12_periodic_runs
from folioflow.llm.pii import op9_pii
from folioflow.llm.quality import op10_quality
from folioflow.llm.resampling import OP11_SQL, op11_resample
from folioflow.llm.substring import OP3_SQL, op3_substring_dedup
from folioflow.llm.topk import OP5_SQL, op5_exact_topk
from folioflow.llm.urls import OP6_SQL, op6_url_filter
from folioflow.llm.warc import OP8_SQL, op8_warc

QUERIES = {
    f.__name__: f
    for f in (op1_langid, op2_decontaminate, op3_substring_dedup, op4_mix, op5_exact_topk, op6_url_filter, op7_near_dedup, op8_warc, op9_pii, op10_quality, op11_resample, op12_periodic_runs, op13_pack)
}
SQL = {
    "op2_decontaminate": OP2_SQL, "op3_substring_dedup": OP3_SQL, "op4_mix": OP4_SQL, "op5_exact_topk": OP5_SQL,
    "op6_url_filter": OP6_SQL, "op7_near_dedup": OP7_SQL, "op8_warc": OP8_SQL, "op11_resample": OP11_SQL,
    "op12_periodic_runs": OP12_SQL,
}
