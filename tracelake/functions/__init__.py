from tracelake.functions.values import (
    decode_bits,
    hex_with_x,
    is_unknown,
    parse_target,
    parse_target_column,
    sanitize_scope_line,
    sized,
    truth,
    values_match,
)

__all__ = [
    "decode_bits",
    "hex_with_x",
    "is_unknown",
    "parse_target",
    "parse_target_column",
    "sanitize_scope_line",
    "sized",
    "truth",
    "values_match",
]
