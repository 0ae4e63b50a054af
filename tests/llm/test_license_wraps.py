"""License texts as files have them: wrapped at some width, behind comment signs."""

import textwrap

from termloom.llm import licenses

from .fixtures import frame

APACHE = """ * Licensed under the Apache License, Version 2.0 (the "License");
 * you may not use this file except in compliance with the License.
 * You may obtain a copy of the License at
 *
 *     http://www.apache.org/licenses/LICENSE-2.0
 *
 * Unless required by applicable law or agreed to in writing, software
 * distributed under the License is distributed on an "AS IS" BASIS,
 * WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.
 * See the License for the specific language governing permissions and
 * limitations under the License.
"""
MPL = """// This Source Code Form is subject to the terms of the Mozilla Public
// License, v. 2.0. If a copy of the MPL was not distributed with this
// file, You can obtain one at https://mozilla.org/MPL/2.0/.
"""


def test_wrapped_licenses(spark):
    rows, expect = [(1, APACHE), (2, MPL), (3, MPL.replace("\n", "\r\n"))], {1: ["apache2-header"], 2: ["mpl2-header"], 3: ["mpl2-header"]}
    at = 10
    for name, _, ids in licenses.RULES:
        for width, sign in ((70, ""), (40, "# "), (25, " * ")):
            text = f"\n{sign}\n".join(textwrap.fill(licenses.SENTENCES[i], width, initial_indent=sign, subsequent_indent=sign, break_on_hyphens=False, break_long_words=False) for i in ids)
            rows.append((at, text))
            expect[at] = [name]
            at += 1
    got = {r.doc_id: r.rules for r in licenses.scan(frame(spark, rows)).collect()}
    for i, rules in expect.items():
        assert set(rules) <= set(got[i]), (i, dict(rows)[i], got[i])


def test_blank_lines_and_marks_part_sentences(spark):
    rows = [(1, "Released under the\n\nMIT License."), (2, "Released under. the MIT License."), (3, "Released\nunder the MIT\nLicense."), (4, 'Licensed under the Apache License, Version 2.0\n(the "License")')]
    got = {r.doc_id: r.sentence_ids for r in licenses.scan(frame(spark, rows)).collect()}
    assert got == {1: [], 2: [], 3: ["mit.notice"], 4: ["apache2.notice.you"]}
