"""The queries of this subpackage and, where SQL can express them on whole tables, their oracles."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

#: Query: (module of this package, function, name of its oracle in the module).
_WHERE = {
    "op1_mixing": ("mixing", "op1_mixing", "ORACLE"),
    "op2_media_gif": ("media_gif", "op2_media_gif", None),
    "op3_language_id": ("language_id", "op3_language_id", None),
    "op4_license_scan": ("license_scan", "op4_license_scan", None),
    "op5_embedding_dedup": ("embedding_dedup", "op5_embedding_dedup", "ORACLE"),
    "op6_jaccard_join": ("jaccard_join", "op6_jaccard_join", "ORACLE"),
    "op7_warc": ("warc", "op7_warc", "ORACLE"),
    "op8_packing": ("packing", "op8_packing", None),
    "op9_url_filter": ("url_filter", "op9_url_filter", "ORACLE"),
    "op10_html_extract": ("html_extract", "op10_html_extract", None),
    "op11_vector_codes": ("vector_codes", "op11_vector_codes", "ORACLE"),
    "op12_quality_classifier": ("quality_classifier", "op12_quality_classifier", None),
    "op13_fill_middle": ("fill_middle", "op13_fill_middle", "ORACLE"),
}


def queries() -> dict[str, Callable]:
    return {name: getattr(import_module(f"{__package__}.{module}"), function) for name, (module, function, _) in _WHERE.items()}


def oracle_sql() -> dict[str, str]:
    return {name: getattr(import_module(f"{__package__}.{module}"), oracle) for name, (module, _, oracle) in _WHERE.items() if oracle}
