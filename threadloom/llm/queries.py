"""The subpackage's queries: one for each operator, over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from threadloom.llm import oracles, secret_scan
from threadloom.llm.alignment import op12_token_alignment
from threadloom.llm.ann import op10_kmeans_tree
from threadloom.llm.html_blocks import op4_main_text
from threadloom.llm.licenses import op5_license_index
from threadloom.llm.mixing import op7_source_mix
from threadloom.llm.near_dedup import op6_bottom_k_dedup
from threadloom.llm.orc_ids import op9_orc_ids
from threadloom.llm.packing import op3_concat_cut
from threadloom.llm.phrases import op11_phrase_runs
from threadloom.llm.quality import op2_cotrained_quality
from threadloom.llm.secret_scan import op13_secret_ownership
from threadloom.llm.sharding import op1_feistel_shards
from threadloom.llm.transport import op8_transport_streams

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (op1_feistel_shards, op2_cotrained_quality, op3_concat_cut, op4_main_text, op5_license_index, op6_bottom_k_dedup, op7_source_mix, op8_transport_streams, op9_orc_ids, op10_kmeans_tree, op11_phrase_runs, op12_token_alignment, op13_secret_ownership)
}

#: Results that SQL can express in full. Permutations, tokenizers, trained models and media streams are
#: tested against brute force, round trips or held-out accuracy in tests/llm instead.
ORACLES: dict[str, str] = {"op6_bottom_k_dedup": oracles.NEAR_DUPLICATES, "op7_source_mix": oracles.SOURCE_MIX, "op11_phrase_runs": oracles.PHRASES}
ORACLES["op13_secret_ownership"] = oracles.secret_ownership(secret_scan.ASSIGN, secret_scan.ACCESS, secret_scan.HEX, secret_scan.TOKEN, secret_scan.TOKEN_DIFFERENT, secret_scan.ASSIGNED, secret_scan.OWNERS, secret_scan.REPOS)
