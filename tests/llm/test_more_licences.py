"""Holders' names, SPDX expressions, and texts that a known licence must not be told of."""

import pytest

from portlight.llm import licenses

BSD = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:

 * Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
 * Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in
   the documentation and/or other materials provided with the distribution.
"""
GNU = """This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of
MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the GNU General Public License for more details."""
TEXTS = {
    BSD: "BSD-2-Clause",
    BSD + " * Neither the name of Acme Inc. nor the names of its contributors may be used to endorse or promote\n   products derived from this software without specific prior written permission.\n": "BSD-3-Clause",
    BSD + " * Neither the name of the University of the Far North, Ltd nor the names of any contributors may be used to endorse or promote products derived from this software without specific prior written permission.": "BSD-3-Clause",
    BSD + "3. The name of the author may not be used to endorse or promote products derived from this software without specific prior written permission.": "BSD-3-Clause",
    BSD + "Nobody shall use our name to endorse or promote anything made of this.": "",
    BSD + " 3. All advertising materials mentioning features or use of this software must display the following acknowledgement:\n\n 4. Neither the name of X nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.": "BSD-4-Clause",
    "Licensed under the MIT License (see LICENSE).": "MIT",
    "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License version 2 as published by the Free Software Foundation.\n\n" + GNU: "GPL-2.0-only",
    "This program is free software; you can redistribute it and/or modify\nit under the terms of the GNU General Public License as published by\nthe Free Software Foundation; version 2 of the License.\n\n" + GNU: "GPL-2.0-only",
    "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, version 3 of the License.\n" + GNU: "GPL-3.0-only",
    "Licensed under the GNU Lesser General Public License v3.0": "LGPL-3.0-only",
    "Distributed under the Boost Software License, Version 1.0.\n(See accompanying file LICENSE_1_0.txt)": "BSL-1.0",
    "This software is provided 'as-is', without any express or implied\nwarranty.\n\nPermission is granted to anyone to use this software for any purpose,\nincluding commercial applications, and to alter it and redistribute it\nfreely, subject to the following restrictions:\n": "Zlib",
    "# SPDX-License-Identifier: GPL-2.0-or-later": "GPL-2.0-or-later",
    "// SPDX-License-Identifier: (BSD-2-Clause)": "BSD-2-Clause",
    "/* SPDX-License-Identifier: Apache-2.0 OR MIT */": "Apache-2.0,MIT",
    "SPDX-License-Identifier: (MIT AND (GPL-2.0-only WITH Classpath-exception-2.0 or isc))\nx": "MIT,GPL-2.0-only,ISC",
    "SPDX-License-Identifier: LicenseRef-own": "",
    "SPDX-License-Identifier: MITish": "",
    "SPDX-License-Identifier:": "",
    "spdx-license-identifier: mit\n\nSPDX-License-Identifier: Zlib": "MIT,Zlib",
}


def test_licences_are_the_right_ones(spark):
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)], "doc_id long, text string")
    got = {r.doc_id: r.licences for r in licenses.scan(rows).collect()}
    assert [got[i] for i in range(len(TEXTS))] == list(TEXTS.values())


@pytest.mark.parametrize("text", ["neither the name of " + "a " * 200_000 + "endorse", "endorse or promote " * 50_000, "SPDX-License-Identifier: " + "MIT OR " * 20_000 + "MIT", "neither the name of x " * 30_000 + "endorse"])
def test_long_texts(spark, text):
    assert licenses.scan(spark.createDataFrame([(1, text)], "doc_id long, text string")).count() == 1
    assert licenses.scan(spark.createDataFrame([(1, text)], "doc_id long, text string")).collect()[0].licences in ("", "MIT")
