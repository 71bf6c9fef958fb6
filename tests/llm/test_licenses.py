from quadrille.llm import license_scan as s

MIT = """Copyright (c) 2020 Some One

Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR
IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,
FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE
AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER
LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM,
OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE
SOFTWARE."""


def test_rules(spark):
    texts = [
        (MIT, ["MIT"], 4, 0),
        ("Words here\nReleased under the MIT License.\nmore words", ["MIT"], 1, 0),
        ("Licensed under the Apache License, Version 2.0. All rights reserved.", ["Apache-2.0", "All-Rights-Reserved"], 2, 0),
        ("see the license for the specific language governing permissions and limitations under the license", [], 1, 1),
        ("Licensed under CC BY-NC 4.0.\n\nLicensed under CC BY-NC 4.0.", ["CC-BY-NC-4.0"], 2, 0),
        ("This work is licensed under the GNU General Public License, version 3.", ["GPL-3.0"], 1, 0),
        ("license " * 30_000, [], 0, 0),
        ("", [], 0, 0),
        (None, [], 0, 0),
    ]
    rows = s.scan(spark.createDataFrame([(i, t[0], "x") for i, t in enumerate(texts)], "doc_id long, text string, known string")).orderBy("doc_id").collect()
    assert [(r.licenses, r.sentences, r.unmatched) for r in rows] == [t[1:] for t in texts]
    assert rows[0].sequence == "<mit-grant><mit-notice><mit-warranty><mit-liability>"
    assert s.scan(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_tables():
    import re

    assert all(i in s.SENTENCES for _, rule in s.RULES for i in rule)
    assert all(re.search(s.HINT, x) and len(x) >= 11 for x in s.SENTENCES.values())
