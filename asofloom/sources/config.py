"""Configurations from YAML files, text or dictionaries."""

import os
from collections.abc import Mapping

from ..plans.validation import check


def load(config, validate=True) -> dict:
    """The configuration as a dictionary: from a path, YAML text with line breaks, or a mapping. Raises ValueError if it isn't valid."""
    if isinstance(config, Mapping):
        found = dict(config)
    else:
        import yaml

        text = os.fspath(config)
        if "\n" not in text:
            with open(text, encoding="utf-8") as f:
                text = f.read()
        found = yaml.safe_load(text)
    if not isinstance(found, dict):
        raise ValueError("a configuration must be a mapping")
    if validate:
        check(found)
    found.setdefault("relationships", [])
    return found
