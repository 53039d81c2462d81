"""Which dictionaries a conversion uses.  In a list the last one has the highest priority."""

from __future__ import annotations

from typing import Literal

# The dictionaries of each locale, to the neutral traditional form and from it.
TO_STANDARD = {
    "cn": ["STCharacters", "STPhrases_GeneratedFromRegionalPhrases", "STPhrases"],
    "hk": ["HKVariantsRev", "HKVariantsRevPhrases"],
    "hkp": ["HKVariantsRev", "HKVariantsRevPhrases", "HKPhrasesRev"],
    "tw": ["TWVariantsRev", "TWVariantsRevPhrases"],
    "twp": ["TWVariantsRev", "TWVariantsRevPhrases", "TWPhrasesRev"],
    "jp": ["JPShinjitaiCharacters", "JPShinjitaiPhrases"],
}
FROM_STANDARD = {
    "cn": ["TSCharacters", "TSPhrases"],
    "hk": ["HKVariants", "HKVariantsPhrases"],
    "hkp": ["HKVariants", "HKVariantsPhrases", "HKPhrases"],
    "tw": ["TWVariants", "TWVariantsPhrases"],
    "twp": ["TWVariants", "TWVariantsPhrases", "TWPhrases"],
    "jp": ["JPShinjitaiCharactersRev"],
}
LOCALES = (*TO_STANDARD, "t")
#: Dictionaries that are made by turning another around.
REVERSED = {"HKVariantsRev": "HKVariants", "TWVariantsRev": "TWVariants", "JPShinjitaiCharactersRev": "JPShinjitaiCharacters"}
GENERATED = "STPhrases_GeneratedFromRegionalPhrases"
CUSTOM = "CNTWPhrases"
_SEGMENTED = ("tw", "twp", "hk", "hkp")


def all_dictionaries() -> list[str]:
    return list(dict.fromkeys(n for table in (TO_STANDARD, FROM_STANDARD) for names in table.values() for n in names))


def dictionary_steps(source: str, target: str) -> list[list[str]]:
    """Dictionary names of each step; an unknown locale is an error."""
    for side, locale in (("from", source), ("to", target)):
        if locale not in LOCALES:
            raise ValueError(f"Unknown '{side}' locale: {locale}")
    steps = []
    if source != "t":
        steps.append(list(TO_STANDARD[source]))
    if target != "t":
        steps.append(list(FROM_STANDARD[target]))
    return steps


def segmentation_dictionaries(source: str, target: str) -> list[str]:
    """Dictionaries whose keys a text is cut on before any step."""
    if source == "cn" and target in _SEGMENTED:
        return ["STPhrases", GENERATED]
    if source in _SEGMENTED and target == "cn":
        return ["TSPhrases"]
    return []


def is_taiwan(locale: str) -> bool:
    return locale in ("tw", "twp")


def phrase_direction(source: str, target: str, wanted: bool | None = None) -> Literal["forward", "reverse"] | None:
    """How the custom phrases apply: by default only if an end is twp; never against their two languages."""
    on = (source == "twp" or target == "twp") if wanted is None else wanted
    if not on:
        return None
    if is_taiwan(target) and not is_taiwan(source):
        return "forward"
    if is_taiwan(source) and target == "cn":
        return "reverse"
    return None
