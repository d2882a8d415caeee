"""The queries of the training-data operators, and their SQL where SQL can express them."""

from . import (
    op01_token_files,
    op02_repetition,
    op03_chat,
    op04_audio,
    op05_token_counts,
    op06_mixing,
    op07_bpe,
    op08_url_rules,
    op09_licenses,
    op10_min_max,
)

QUERIES = {
    "op1_token_files": op01_token_files.query,
    "op2_repetition": op02_repetition.query,
    "op3_chat_format": op03_chat.query,
    "op4_audio_fingerprints": op04_audio.query,
    "op5_token_counts": op05_token_counts.query,
    "op6_mixing": op06_mixing.query,
    "op7_byte_bpe": op07_bpe.query,
    "op8_url_rules": op08_url_rules.query,
    "op9_license_scan": op09_licenses.query,
    "op10_min_max_dedup": op10_min_max.query,
}
ORACLES = {"op2_repetition": op02_repetition.ORACLE, "op3_chat_format": op03_chat.ORACLE, "op6_mixing": op06_mixing.oracle(), "op10_min_max_dedup": op10_min_max.ORACLE}
