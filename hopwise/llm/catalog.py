"""Queries of the training-data operators and the SQL they are checked against."""

from __future__ import annotations

from hopwise.llm.decontaminate import OP3_SQL, op3_decontaminate
from hopwise.llm.hilbert_shards import op7_hilbert_shards
from hopwise.llm.language_id import op6_language_id
from hopwise.llm.license_scan import op2_license_scan
from hopwise.llm.line_quality import OP8_SQL, op8_line_quality
from hopwise.llm.prefix_trie import OP13_SQL, op13_prefix_trie
from hopwise.llm.secret_scan import op1_secret_scan
from hopwise.llm.simhash_dedup import op10_simhash_dedup
from hopwise.llm.source_mixing import OP5_SQL, op5_source_mixing
from hopwise.llm.structure_repair import op12_structure_repair
from hopwise.llm.suffix_dedup import op4_suffix_dedup
from hopwise.llm.token_counts import op11_token_counts
from hopwise.llm.warc import OP9_SQL, op9_warc


def _pipeline(spark, sf_dir: str):
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict:
    found = [
        op1_secret_scan, op2_license_scan, op3_decontaminate, op4_suffix_dedup, op5_source_mixing, op6_language_id, op7_hilbert_shards,
        op8_line_quality, op9_warc, op10_simhash_dedup, op11_token_counts, op12_structure_repair, op13_prefix_trie,
    ]
    return {f.__name__: f for f in found} | {"pipeline": _pipeline}


def oracle_sql() -> dict[str, str]:
    return {"op3_decontaminate": OP3_SQL, "op5_source_mixing": OP5_SQL, "op8_line_quality": OP8_SQL, "op9_warc": OP9_SQL, "op13_prefix_trie": OP13_SQL}
