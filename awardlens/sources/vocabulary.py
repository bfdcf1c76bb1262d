"""Spellings of true and false, from fixed words and a data dictionary."""

import json
import logging
from pathlib import Path
from typing import NamedTuple

log = logging.getLogger(__name__)

# Words that always count, and the key pairs that mark a yes/no field.
TRUE_WORDS = ["true", "yes", "t", "y", "on"]
FALSE_WORDS = ["false", "no", "f", "n", "off"]
YES_NO_KEYS = [("T", "F"), ("Y", "N")]


class Vocabulary(NamedTuple):
    true_words: list[str]
    false_words: list[str]


def case_variations(word: str) -> set[str]:
    """The word in lower case, upper case and capitalised."""
    return {word.lower(), word.upper(), word.capitalize()}


def _spellings(words) -> list[str]:
    return sorted(set().union(*map(case_variations, words)))


def bool_vocabulary(data_dict: str | Path | dict | None = None) -> Vocabulary:
    """Base words plus the labels of every dictionary field whose keys are T/F or Y/N.

    A dictionary (a file, or its content) that cannot be read is logged, and the base words are used alone.
    """
    yes, no = list(TRUE_WORDS), list(FALSE_WORDS)
    for labels in _fields(data_dict).values():
        for true_key, false_key in YES_NO_KEYS:
            if isinstance(labels, dict) and set(labels) == {true_key, false_key}:
                yes.append(str(labels[true_key]).strip())
                no.append(str(labels[false_key]).strip())
    return Vocabulary(_spellings(yes), _spellings(no))


def _fields(data_dict: str | Path | dict | None) -> dict:
    if data_dict is None or isinstance(data_dict, dict):
        return data_dict or {}
    try:
        found = json.loads(Path(data_dict).read_text(encoding="utf-8"))
        if not isinstance(found, dict):
            raise ValueError("not a JSON object")
        return found
    except (OSError, ValueError):  # also text that is not UTF-8 or not JSON
        log.exception("cannot read data dictionary %s; using the base words only", data_dict)
        return {}
