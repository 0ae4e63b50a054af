"""Licences as they are written: holders' names in clauses, optional words, one-line notices, conjunctions of short names."""

import pytest

from termloom.llm import licenses

S = licenses.SENTENCES
BSD = " ".join((S["bsd.grant"], "1.", S["bsd.source"], "2.", S["bsd.binary"]))
CASES = [
    (f"{BSD} 3. Neither the name of Google Inc. nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.", ["BSD-3-Clause"]),
    (f"{BSD} 3. Neither the names of the Regents, of Müller & Söhne GmbH\n * nor the names of their contributors may be used to endorse or promote products derived\n * from this software without specific prior written permission.", ["BSD-3-Clause"]),
    (f"{BSD} 3. The name of the author may not be used to endorse or promote products derived from this software without specific prior written permission.", ["BSD-3-Clause"]),
    (BSD, ["BSD-2-Clause"]),
    ("Permission to use, copy, modify, and distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.", ["ISC"]),
    ("This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License version 2 as published by the Free Software Foundation.", ["GPL-2.0-only"]),
    ("This program is free software; you can redistribute it and/or modify\nit under the terms of version 2 of the GNU General Public License as\npublished by the Free Software Foundation.", ["GPL-2.0-only"]),
    ("This project is licensed under the MIT License - see the LICENSE file for details.", ["MIT"]),
    ("The code is licensed under the MIT license - see", ["MIT"]),
    ("Licensed under the Apache License 2.0", ["Apache-2.0"]),
    ("released under the Apache 2.0 license, enjoy", ["Apache-2.0"]),
    ("This library is distributed under the BSD 3-Clause license (see below)", ["BSD-3-Clause"]),
    ("licensed under GPLv3, sorry", ["GPL-3.0"]),
    ("Licensed under the MPL 2.0", ["MPL-2.0"]),
    ("# SPDX-License-Identifier: MIT OR Apache-2.0", ["MIT", "Apache-2.0"]),
    ("// SPDX-License-Identifier: (GPL-2.0-only OR BSD-2-Clause) AND MIT", ["GPL-2.0-only", "BSD-2-Clause", "MIT"]),
    ("license = MIT OR Apache-2.0", ["MIT", "Apache-2.0"]),
    ("SPDX-License-Identifier: GPL-2.0", ["GPL-2.0"]),
    ("/* SPDX-License-Identifier: MIT */ int x;", ["MIT"]),
    ('Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at\n\n    http://x', ["Apache-2.0"]),
    ("They must agree on the license OR leave AND go.", []),
    ("a permit of limited use was licensed under duress", []),
    (None, []), ("", []),
]


def frame(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")


def test_wordings(spark):
    got = {r.doc_id: r for r in licenses.scan(frame(spark, [t for t, _ in CASES])).collect()}
    for i, (text, want) in enumerate(CASES):
        assert sorted(got[i].licenses) == sorted(want), (text, got[i])


def test_wordings_against_sql(spark):
    import duckdb
    import pandas as pd

    texts = [t for t, _ in CASES] + [" ".join(t or "" for t, _ in CASES), "\n".join(t or "" for t, _ in CASES)]
    documents = pd.DataFrame({"doc_id": range(len(texts)), "text": texts})  # noqa: F841
    con = duckdb.connect()
    con.register("documents", documents)
    want = sorted(tuple(r) for r in con.execute(licenses.oracle()).fetchall())
    assert sorted(tuple(r) for r in licenses.digest(licenses.scan(frame(spark, texts))).collect()) == want


@pytest.mark.parametrize("text", ["neither the name of " + "x " * 100_000, "MIT OR " * 5_000, "licensed under the " * 20_000, "SPDX-License-Identifier: " * 10_000])
def test_long_texts_take_linear_time(spark, text):
    import time

    licenses.scan(frame(spark, ["warm up"])).collect()
    began = time.time()
    licenses.scan(frame(spark, [text])).collect()
    assert time.time() - began < 40
