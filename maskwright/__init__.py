"""Find personal data in document tables, replace it consistently, restore it."""

from maskwright.functions.detectors import DETECTORS, custom
from maskwright.functions.strategies import STRATEGIES, Strategy, get_strategy
from maskwright.operators.decode import decode, find_placeholders, validate
from maskwright.operators.detect import PROFILES, detect, detect_all, detect_raw
from maskwright.operators.mapping import build_mapping, extend_mapping
from maskwright.operators.reports import analyse, legend, statistics, with_legend
from maskwright.operators.rewrite import Encoded, encode, encode_each, sanitise

__all__ = [
    "DETECTORS", "PROFILES", "STRATEGIES", "Encoded", "Strategy", "analyse", "build_mapping", "custom",
    "decode", "detect", "detect_all", "detect_raw", "encode", "encode_each", "extend_mapping",
    "find_placeholders", "get_strategy", "legend", "sanitise", "statistics", "validate", "with_legend",
]
