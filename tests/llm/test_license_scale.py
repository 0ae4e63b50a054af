"""License scans of long lists, beside a plain walk over the same identifiers, and the statement's own cut."""

import os

import duckdb
import pandas as pd

from termloom.llm import licenses

from .fixtures import TEXTS, frame
from .test_license_wraps import APACHE, MPL


def plain_rules(ids):
    held = []
    for name, _, want in licenses.RULES:
        rest = iter(ids)
        if all(w in rest for w in want):
            held.append(name)
    over = licenses.stronger()
    return [name for name in held if not any(o in held for o in over[name])]


def test_repeated_sentences_cost_no_square(spark):
    s = licenses.SENTENCES
    first = "\n\n".join(s[k] for k in ("bsd.grant", "bsd.source", "bsd.binary"))
    rows = [(1, "\n\n".join([first] * 2_000)), (2, "\n\n".join([first] * 700 + [s["bsd.endorse"]])), (3, first + "\n\n" + s["bsd.endorse"] + "\n\n" + s["mit.title"])]
    got = {r.doc_id: r for r in licenses.scan(frame(spark, rows)).collect()}
    assert got[1].sentence_ids == ["bsd.grant", "bsd.source", "bsd.binary"] * 2_000 and got[1].rules == ["bsd2-text"]
    assert len(got[2].sentence_ids) == 2_101 and got[2].rules == ["bsd3-text"]
    assert got[3].rules == ["bsd3-text", "mit-title"] and got[3].licenses == ["BSD-3-Clause", "MIT"]


def test_rules_follow_the_order_of_sentences(spark):
    s = licenses.SENTENCES
    orders = [("bsd.binary", "bsd.grant", "bsd.source"), ("bsd.grant", "bsd.source", "mit.title", "bsd.binary"), ("gpl.nowarranty", "gpl.copy"), ("gpl3.notice", "gpl.nowarranty", "gpl.copy"), ("spdx.mit", "spdx.gpl-2.0-only")]
    rows = [(n, "\n\n".join(s[k] for k in ids)) for n, ids in enumerate(orders)]
    got = {r.doc_id: r for r in licenses.scan(frame(spark, rows)).collect()}
    for n, ids in enumerate(orders):
        assert got[n].sentence_ids == list(ids) and got[n].rules == plain_rules(ids), (n, got[n])


def test_statement_sees_wrapped_texts_too(spark, tmp_path):
    rows = [r for r in TEXTS if r[0] is not None and r[0] != 12]
    rows += [(30, APACHE), (31, MPL), (32, "# SPDX-License-Identifier: MIT\n# Released\n# under the MIT License.\n\nx"), (33, "Released under the MIT License.\nReleased under the MIT License.\nReleased\nunder the MIT License."), (34, "\n\n".join(licenses.SENTENCES.values()))]
    pd.DataFrame(rows, columns=["doc_id", "text"]).to_parquet(os.path.join(tmp_path, "d.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/d.parquet'")
    want = {r[0]: r for r in con.execute(licenses.oracle()).fetchall()}
    got = {r.doc_id: tuple(r) for r in licenses.digest(licenses.scan(frame(spark, rows))).collect()}
    assert got == want
    assert got[32][3] == "mit-line,spdx-mit" and got[33][1] == 3
