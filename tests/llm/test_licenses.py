"""License texts that stand in no driver table: titles, headers, whole files."""

import pytest

from quire.llm.license_scan import BSD_BODY, BSD_CLAUSES, BSD_REST, BSD_THIRD, MIT_BODY, MIT_REST, scan_licenses

FSF = """# This {0} is free software: you can redistribute it and/or modify
# it under the terms of the GNU {1}General Public License as published by
# the Free Software Foundation, either version {2} of the License, or
# (at your option) any later version.
#
# You should have received a copy of the license.
import os
"""
MIT = f"Copyright (c) 2024 Jane Doe\n\n{MIT_BODY}\n\n{MIT_REST}\n"
BSD = "Copyright (c) 2024, Jane Doe\nAll rights reserved.\n\n{}\n\n{}\n"
CASES = [
    ("a/LICENSE", MIT, "mit"),
    ("b/x.py", "# SPDX-License-Identifier: Apache-2.0\nimport os", "apache-2.0"),
    ("c/x.py", "// SPDX-License-Identifier: GPL-2.0-only\nint x;", "gpl-2.0"),
    ("d/LICENSE", "MIT License", "mit"),
    ("e/x.py", FSF.format("program", "", "3"), "gpl-3.0"),
    ("f/x.py", FSF.format("program", "", "2"), "gpl-2.0"),
    ("g/x.py", FSF.format("work", "Affero ", "3"), "agpl-3.0"),
    ("h/x.py", FSF.format("library", "Lesser ", "3"), "lgpl-3.0"),
    ("i/COPYING", "                    GNU GENERAL PUBLIC LICENSE\n                       Version 3, 29 June 2007\n\n Everyone is permitted to copy.", "gpl-3.0"),
    ("j/LICENSE", "                                 Apache License\n                           Version 2.0, January 2004\n"
     "                        http://www.apache.org/licenses/\n\n   TERMS AND CONDITIONS FOR USE", "apache-2.0"),
    ("k/LICENSE.txt", BSD.format(BSD_BODY + BSD_CLAUSES, BSD_REST), "bsd-2-clause"),
    ("l/LICENSE.txt", BSD.format(BSD_BODY + BSD_CLAUSES + BSD_THIRD, BSD_REST), "bsd-3-clause"),
    ("m/x.py", "This program is licensed under the GNU General Public License, version 3.", "gpl-3.0"),
    ("n/x.py", "This work is licensed under the GNU General Public License, version 2.", "gpl-2.0"),
    ("o/LICENSE", "Creative Commons Attribution-ShareAlike 4.0 International\n\nText", "cc-by-sa-4.0"),
    ("p/x.js", "/* This Source Code Form is subject to the terms of the Mozilla Public\n * License, v. 2.0. If a copy of the MPL was not "
     "distributed with this\n * file, You can obtain one at https://mozilla.org/MPL/2.0/. */", "mpl-2.0"),
    ("q/x.py", "The garden was green and permission was never asked.", None),
    ("r/x.py", "// SPDX-License-Identifier: CC-BY-NC-SA-4.0", None),
]


@pytest.fixture(scope="module")
def scanned(spark):
    rows = [(i, p, t) for i, (p, t, _) in enumerate(CASES)] + [(100, "a/src/main.py", "print(1)")]
    rows += [(1000 + k, f"z/{k}", f"Plain words of a story, number {k}, about the sea and the software of boats.") for k in range(200)]
    return {r.id: r for r in scan_licenses(spark.createDataFrame(rows, "doc_id long, path string, text string")).collect()}


@pytest.mark.parametrize("i", range(len(CASES)))
def test_license_text_is_found(scanned, i):
    assert scanned[i].license == CASES[i][2]


def test_license_file_hands_down(scanned):
    r = scanned[100]
    assert (r.license, r.how, r.licence_file) == ("mit", "inherited", "a/LICENSE")
