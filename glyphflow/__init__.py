"""A PySpark-native engine for dictionary-driven text conversion.

The names below are the public ones; dictionary jobs are in ``operators.dict_etl`` and ``sources.dictionaries``.
"""

from .functions.chars import fold_compat, strip_pua
from .functions.matcher import Matcher, longest_match
from .operators.chain import Chain, Converter, Protected, SlotError, chain, custom_converter, protected, segment
from .operators.dict_etl import DictionaryError, MissingDictionary, reverse_dict
from .operators.html import html_convert, html_restore
from .plans.converter import DictionaryStore, LocalePreset, cn2t, converter_from_preset, create_converter, full, locale_preset, t2cn
from .plans.presets import FROM_STANDARD, LOCALES, TO_STANDARD, all_dictionaries, dictionary_steps, segmentation_dictionaries
from .sources.dictionaries import parse_custom_dict, parse_dict
from .streaming.convert import convert_stream

__all__ = [
    "Chain", "Converter", "DictionaryError", "DictionaryStore", "FROM_STANDARD", "LOCALES", "LocalePreset", "Matcher", "MissingDictionary", "Protected", "SlotError", "TO_STANDARD",
    "all_dictionaries", "chain", "cn2t", "convert_stream", "converter_from_preset", "create_converter", "custom_converter", "dictionary_steps", "fold_compat", "full", "html_convert",
    "html_restore", "locale_preset", "longest_match", "parse_custom_dict", "parse_dict", "protected", "reverse_dict", "segment", "segmentation_dictionaries", "strip_pua", "t2cn",
]
