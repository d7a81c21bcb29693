"""Corpus operators do the whole job."""

import textwrap

import pytest

from foliomill.llm import license_scan


@pytest.mark.parametrize("mark", ["", "# ", " * ", "// "])
@pytest.mark.parametrize("family", sorted(license_scan.TEMPLATES))
def test_wrapped_notices(family, mark):
    model = license_scan.trained()
    notice = max(license_scan.TEMPLATES[family], key=len)
    for width in (30, 45):
        text = "\n".join(["first", "", *(mark + x for x in textwrap.wrap(notice, width)), mark.rstrip(), "last"])
        assert family in {f for _, f, _ in license_scan.scan(text, model)[1]}


def test_usual_gpl_header():
    text = """
# This program is free software; you can redistribute it and/or modify
# it under the terms of the GNU General Public License as published by
# the Free Software Foundation; either version 2 of the License, or
# (at your option) any later version."""
    assert {f for _, f, _ in license_scan.scan(text, license_scan.trained())[1]} == {"gpl"}
