"""Notices as they stand in real files, wrapped and commented, and tag expressions."""

import pytest

from lumenrisk.llm import licenses

LGPL = """ * This library is free software; you can redistribute it and/or
 * modify it under the terms of the GNU Lesser General Public
 * License as published by the Free Software Foundation; either
 * version {} of the License, or (at your option) any later version.
 *
 * This library is distributed in the hope that it will be useful,
 * but WITHOUT ANY WARRANTY; without even the implied warranty of
 * MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the GNU
 * Lesser General Public License for more details.
"""
CASES = [
    ("/* This Source Code Form is subject to the terms of the Mozilla Public\n * License, v. 2.0. If a copy of the MPL was not distributed with this\n * file, You can obtain one at https://mozilla.org/MPL/2.0/. */", ["MPL-2.0"], ["mpl-ref", "mpl-copy"]),
    ("// This Source Code Form is subject to the terms of the Mozilla Public License, v.\n// 2.0. If a copy of the MPL was not distributed with this file,\n// You can obtain one at http://mozilla.org/MPL/2.0/.", ["MPL-2.0"], ["mpl-ref", "mpl-copy"]),
    (LGPL.format("2.1"), ["LGPL-2.1"], ["lgpl21-grant", "lgpl-warranty"]),
    (LGPL.format("3"), ["LGPL-3.0"], ["lgpl3-grant", "lgpl-warranty"]),
    ("SPDX-License-Identifier: MIT OR Apache-2.0", ["Apache-2.0", "MIT"], ["spdx-MIT", "spdx-Apache-2.0"]),
    ("# SPDX-License-Identifier: (MIT OR GPL-2.0-or-later) AND BSD-3-Clause\nimport os", ["BSD-3-Clause", "GPL-2.0-or-later", "MIT"], ["spdx-MIT", "spdx-GPL-2.0-or-later", "spdx-BSD-3-Clause"]),
    ("/* SPDX-License-Identifier: GPL-2.0-only WITH Classpath-exception-2.0 */", ["GPL-2.0-only"], ["spdx-GPL-2.0-only"]),
    ("// SPDX-License-Identifier: GPL-2.0\nint x;", ["GPL-2.0"], ["spdx-GPL-2.0"]),
    ("SPDX-License-Identifier: GPL-3.0+", ["GPL-3.0-or-later"], ["spdx-GPL-3.0-or-later"]),
    ("SPDX-License-Identifier: Nothing-1.0", [], []),
    ("Licensed under the MIT license, see LICENSE.", ["MIT"], ["mit-ref"]),
    ("This project is licensed under the MIT License - see the LICENSE file for details", ["MIT"], ["mit-ref"]),
    ("Boost Software License - Version 1.0 - August 17th, 2003\n\nPermission", ["BSL-1.0"], ["boost-title"]),
    ("                    GNU GENERAL PUBLIC LICENSE\n                       Version 3, 29 June 2007\n\n Copyright (C) 2007", ["GPL-3.0"], ["gpl3-title"]),
    ("                  GNU LESSER GENERAL PUBLIC LICENSE\n                       Version 2.1, February 1999\n\n", ["LGPL-2.1"], ["lgpl21-title"]),
    ("C++ and c+ are no licences. Version no. 3 of the licence.", [], []),
]


@pytest.fixture(scope="module")
def found(spark):
    docs = spark.createDataFrame([(i, t) for i, (t, *_) in enumerate(CASES)], "doc_id long, text string")
    return {r.doc_id: (r.licenses, r.sentence_ids) for r in licenses.licenses(docs).collect()}


@pytest.mark.parametrize("i", range(len(CASES)))
def test_notice(found, i):
    assert found[i] == CASES[i][1:]


def test_every_sentence_can_be_reached(spark):
    """Each listed sentence stands in its normal form, survives the cutter as one piece and is part of a rule or a tag."""
    docs = spark.createDataFrame([(i, f"{s.capitalize()}.") for i, s in enumerate(licenses.SENTENCES)], "doc_id long, text string")
    got = {r.doc_id: r.sentence_ids for r in licenses.licenses(docs).collect()}
    assert got == {i: [name] for i, name in enumerate(licenses.SENTENCES.values())}
