"""A PySpark-native engine for inverse rule lookup: which stored rules does each row satisfy?"""

from .functions.getters import Operator, truncated, version
from .operators.index import Local, RuleIndex
from .operators.ranked import RankedIndex
from .operators.schema import RuleSchema
from .plans.rules import All, AnyOf, Between, CompareBy, Exclude, Exists, Greater, GreaterOrEqual, In, Include, Less, LessOrEqual, Missing, NotIn, Overlaps
from .sources.tables import load_index, numbered, save_index, zip_rules
from .streaming.matching import match_batches, match_stream

__all__ = [
    "All", "AnyOf", "Between", "CompareBy", "Exclude", "Exists", "Greater", "GreaterOrEqual", "In", "Include", "Less", "LessOrEqual", "Local", "Missing",
    "NotIn", "Operator", "Overlaps", "RankedIndex", "RuleIndex", "RuleSchema", "load_index", "match_batches", "match_stream", "numbered", "save_index",
    "truncated", "version", "zip_rules",
]
