"""Queries of this subpackage, and SQL where it can express them."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

from . import extract, infilling, mixing, neardup, secrets, spelling, urlfilter, warc

#: Query name, module, function.
QUERIES = {
    "op1_transport_streams": ("transport", "op1"),
    "op2_rendezvous_shards": ("sharding", "op2"),
    "op3_tag_path_ratios": ("extract", "op3"),
    "op4_dictionary_warc": ("warc", "op4"),
    "op6_path_templates": ("urlfilter", "op6"),
    "op7_boosted_tree_quality": ("quality", "op7"),
    "op8_tensored_near_duplicates": ("neardup", "op8"),
    "op9_simhash_decontamination": ("decontaminate", "op9"),
    "op10_secret_scan": ("secrets", "op10"),
    "op5_best_fit_packing": ("packing", "op5"),
    "op11_source_mixing": ("mixing", "op11"),
    "op12_spelling_variants": ("spelling", "op12"),
    "op13_fill_in_middle": ("infilling", "op13"),
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: getattr(import_module(f"{__package__}.{module}"), function) for name, (module, function) in QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {"op3_tag_path_ratios": extract.SQL, "op4_dictionary_warc": warc.SQL, "op6_path_templates": urlfilter.oracle(), "op8_tensored_near_duplicates": neardup.SQL, "op10_secret_scan": secrets.oracle(), "op11_source_mixing": mixing.SQL, "op12_spelling_variants": spelling.SQL, "op13_fill_in_middle": infilling.SQL}
