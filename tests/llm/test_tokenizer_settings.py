"""Tokenizer files whose settings the packing encoder doesn't follow are errors."""

import copy
import json

import public_tokenizers
import pytest

from spanloom.llm import packing


def test_other_settings_are_errors():
    with open(public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8") as f:
        whole = json.load(f)
    whole["model"]["vocab"], whole["model"]["merges"] = {}, []
    packing.require_settings(whole)
    for path, value in (
        ("normalizer", {"type": "NFC"}),
        ("pre_tokenizer", None),
        ("pre_tokenizer", {"type": "Sequence", "pretokenizers": []}),
        ("pre_tokenizer.add_prefix_space", True),
        ("pre_tokenizer.use_regex", False),
        ("model.type", "Unigram"),
        ("model.ignore_merges", True),
        ("model.end_of_word_suffix", "</w>"),
    ):
        other = copy.deepcopy(whole)
        *parents, last = path.split(".")
        at = other
        for name in parents:
            at = at[name]
        at[last] = value
        with pytest.raises(ValueError, match="tokenizer file"):
            packing.require_settings(other)
    whole["added_tokens"][0]["lstrip"] = True
    with pytest.raises(ValueError, match="added token"):
        packing.require_settings(whole)
