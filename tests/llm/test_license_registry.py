"""Long licences, known by the digests of their published texts, and their standard headers."""

import os

import pytest

from .test_license_scan import _scan

FOLDER = "/usr/share/common-licenses"
FILES = {"Apache-2.0": "Apache-2.0", "CC0-1.0": "CC0-1.0", "GPL-2": "GPL-2.0", "GPL-3": "GPL-3.0",
         "LGPL-3": "LGPL-3.0", "MPL-2.0": "MPL-2.0"}


@pytest.mark.skipif(not all(os.path.exists(f"{FOLDER}/{f}") for f in FILES), reason="no published texts here")
def test_long_licences_in_full(make):
    end, texts, names = "END OF TERMS AND CONDITIONS", [], []
    for file, name in FILES.items():
        with open(f"{FOLDER}/{file}", encoding="utf-8") as f:
            text = f.read()
        terms = [text.split(end)[0], text.split(end)[0] + end] if end in text else []
        for t in (text, text.upper().replace("\n", "\n * "), *terms):
            texts.append(t)
            names.append(name)
        texts.append(text + "\none more clause")
        names.append(None)
    assert [a for a, _ in _scan(make, texts)] == names


def test_header_lines(make):
    texts = ['# Copyright 2020 A. B.\n#\n# Licensed under the Apache License, Version 2.0 (the "License");\n# you may not use',
             "This Source Code Form is subject to the terms of the Mozilla Public\nLicense, v. 2.0. "
             "If a copy of the MPL was not distributed with this\nfile, You can obtain one",
             "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General "
             "Public License as published by the Free Software Foundation, either version 3 of the License, or (at your "
             "option) any later version.\nmore"]
    assert [n for _, n in _scan(make, texts)] == [["Apache-2.0"], ["MPL-2.0"], ["GPL-3.0"]]
