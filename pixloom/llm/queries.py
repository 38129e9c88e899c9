"""The queries of this subpackage, and DuckDB SQL for those that SQL can express."""

from __future__ import annotations

from .bpe import op7_bpe
from .html_text import op10_html
from .langid import op2_langid
from .license_scan import op9_license
from .media import op3_media
from .mixing import op6_mixing
from .periodic_runs import OP11_SQL, op11_runs
from .quality import op4_quality, op4_sql
from .simhash import op1_simhash
from .sort_means import op13_centroids, op13_sql
from .suffix_dedup import OP5_SQL, op5_suffix
from .toxicity import op12_toxicity
from .warc import OP8_SQL, op8_warc


def queries() -> dict:
    return {"op1_simhash": op1_simhash, "op2_langid": op2_langid, "op3_media": op3_media, "op4_quality": op4_quality, "op5_suffix": op5_suffix, "op6_mixing": op6_mixing, "op7_bpe": op7_bpe, "op8_warc": op8_warc, "op9_license": op9_license, "op10_html": op10_html, "op11_runs": op11_runs, "op12_toxicity": op12_toxicity, "op13_centroids": op13_centroids}


def oracle_sql() -> dict[str, str]:
    return {"op4_quality": op4_sql(), "op5_suffix": OP5_SQL, "op8_warc": OP8_SQL, "op11_runs": OP11_SQL, "op13_centroids": op13_sql()}
