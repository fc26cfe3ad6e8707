from agrolith.functions.hashing import hash_bucket, hash_order, hash_u32
from agrolith.functions.numeric import argmax, clip_low, percent, round_half_even, softmax
from agrolith.functions.text import (
    NULL_TOKENS, file_extension, file_name, normalise_name, null_tokens_to_null,
    parent_name, parent_path, relative_path, strip_all, title_case,
)
from agrolith.functions.topics import insight_topic

__all__ = [
    "NULL_TOKENS", "argmax", "clip_low", "file_extension", "file_name", "hash_bucket",
    "hash_order", "hash_u32", "insight_topic", "normalise_name", "null_tokens_to_null",
    "parent_name", "parent_path", "percent", "relative_path", "round_half_even",
    "softmax", "strip_all", "title_case",
]
