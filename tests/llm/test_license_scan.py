"""Notices whose best span ends inside a word."""

import pytest

from strandframe.llm import license_scan


@pytest.mark.parametrize(("text", "label"), [("gnu lesser general public licenses", "lgpl"), ("released under the mit licenses", "mit"), ("relicensed under the apache license version 2 0", "apache"), ("all rights reservedc", "all-rights-reserved")])
def test_aligned_matches_within_the_errors(text, label):
    _, hits = license_scan.scan(f"here {text} there".encode())
    assert [(h["label"], h["edits"] > 0) for h in hits if not h["exact"] and h["label"] == label] == [(label, True)]
