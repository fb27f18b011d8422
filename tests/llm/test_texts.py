import html
import re
import time

import pytest

from scriptorium.llm import decontaminate, html_text, licenses, queries

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans(decontaminate.UPPER, decontaminate.LOWER)


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_same_rows_as_sql(name, same):
    same(queries.queries()[name], queries.oracle_sql()[name])


def brute_hits(docs, tests, size):
    windows = {}
    for item, text in tests:
        w = tuple(WORD.findall((text or "").translate(LOWER)))
        for k in range(max(0, len(w) - size) + 1):
            if w:
                windows.setdefault(w[k : k + size], set()).add("" if item is None else str(item))
    lengths, out = {len(w) for w in windows}, []
    for _, text in docs:
        w, hit, items = tuple(WORD.findall((text or "").translate(LOWER))), set(), set()
        for n in lengths:
            for i in range(len(w) - n + 1):
                if w[i : i + n] in windows:
                    hit |= set(range(i, i + n))
                    items |= windows[w[i : i + n]]
        out.append((len(w), len(hit), sorted(items)))
    return out


def test_hits_against_brute_force(spark):
    docs = [(None, "a B c"), (3, None), (3, ""), (5, "x A b c y a b c a-b"), (4, "é b"), (4, "é b"), (6, "r s t u v " * 30), (7, "a " * 5000)]
    tests = [(None, "a B"), (1, "é"), (2, None), (3, "b c"), (3, "q q q"), (8, "s t u v r s t u v r s t"), (9, "a a a a"), (9, "")]
    d = spark.createDataFrame([(*r, 1, "w") for r in docs], "doc_id long, text string, row int, ws string")
    t = spark.createDataFrame([(*r, 2, "i") for r in tests], "item_id long, text string, n int, item string")
    got = sorted((r["n_words"], r["n_hit"], r["items"]) for r in decontaminate.contamination(d, t, window=10).collect())
    assert got == sorted(brute_hits(docs, tests, 10))


def test_awkward_documents_and_no_tests(awkward, read):
    none = read("benchmark").limit(0)
    assert decontaminate.contamination_table(awkward, none).where("contaminated").count() == 0
    assert decontaminate.contamination_table(awkward, read("benchmark")).count() == awkward.count()
    assert decontaminate.contamination_table(awkward.limit(0), read("benchmark")).count() == 0
    kept = decontaminate.clean(awkward, read("benchmark"))
    assert kept.columns == awkward.columns and kept.count() == awkward.count()


def test_proximity(spark):
    docs = spark.createDataFrame([(1, "red x x blue"), (2, "blue red"), (3, "red x x x x blue"), (4, "red")], "doc_id long, text string")
    tested = decontaminate.items(spark.createDataFrame([(1, "red blue")], "item_id long, text string"))
    index = decontaminate.build(docs, tested)
    phrases = spark.createDataFrame([(1, ["red", "blue"])], "phrase int, ws array<string>")
    keys = {r["row"]: r["key"] for r in index.postings.where("term = 0").collect()}
    assert {keys[r["row"]] for r in decontaminate.proximity_matches(index, phrases, 3).collect()} == {1, 2}
    assert decontaminate.phrase_matches(index, phrases).count() == 0


def said(*names):
    return ". ".join(licenses.KNOWN[n].capitalize() for n in names) + "."


def test_every_known_sentence_can_be_found():
    assert all(any(w in s for w in licenses.WORDS) for s in licenses.KNOWN.values())
    assert len(set(licenses.KNOWN.values())) == len(licenses.KNOWN)


def test_rules_are_ordered(spark):
    full = licenses.RULES["MIT/named"]
    texts = [
        said(*full),
        said(*full[::-1]),
        "x\n# Licensed under CC BY-NC 4.0.\ny. Licensed under the Apache License, Version 2.0. z",
        "// SPDX-License-Identifier: MIT\nAll rights reserved.",
        "Licensed under the moon",
        None,
        "",
        "Released under the MIT License. " * 3000,
    ]
    df = spark.createDataFrame([(i, t, "x", 0) for i, t in enumerate(texts)], "doc_id long, text string, sentence_ids string, licences int")
    got = [r["licences"] for r in licenses.scan(df).orderBy("doc_id").collect()]
    assert got[0] == ["MIT"]
    assert got[1] == ["MIT"]  # the name alone
    assert got[2] == ["Apache-2.0", "CC-BY-NC-4.0"]
    assert got[3] == ["Proprietary", "SPDX:mit"]
    assert got[4:] == [[], [], [], ["MIT"]]
    assert licenses.scan(df.limit(0)).count() == 0


APACHE = """Licensed under the Apache License, Version 2.0 (the "License");
you may not use this file except in compliance with the License.
You may obtain a copy of the License at

    http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software
distributed under the License is distributed on an "AS IS" BASIS,
WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.
See the License for the specific language governing permissions and
limitations under the License."""
GPL = """This {work} is free software{a} you can redistribute it and/or modify
it under the terms of the GNU {kind}General Public License as published by
the Free Software Foundation{b} {version}.

This {work} is distributed in the hope that it will be useful,
but WITHOUT ANY WARRANTY; without even the implied warranty of
MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the
GNU {kind}General Public License for more details.

You should have received a copy of the GNU {kind}General Public License
along with this {work}.  If not, see <https://www.gnu.org/licenses/>."""
LATER = "either version {} of the License, or\n(at your option) any later version"
MPL = """This Source Code Form is subject to the terms of the Mozilla Public
License, v. 2.0. If a copy of the MPL was not distributed with this
file, You can obtain one at https://mozilla.org/MPL/2.0/."""
BSD = """Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this
   list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice,
   this list of conditions and the following disclaimer in the documentation
   and/or other materials provided with the distribution.
{third}
THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS"
AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE
IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE
DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER BE LIABLE."""
EPL = """This program and the accompanying materials are made available under the
terms of the Eclipse Public License 2.0 which is available at
https://www.eclipse.org/legal/epl-2.0/."""
THIRD = """
3. Neither the name of {} nor the names of its
   contributors may be used to endorse or promote products derived from
   this software without specific prior written permission.
"""


def test_standard_notices(spark):
    gpl2 = GPL.format(work="program", kind="", a=";", b=";", version=LATER.format(2))
    cases = [
        (APACHE, ["Apache-2.0"]),
        (gpl2, ["GPL-2-or-later"]),
        (GPL.format(work="program", kind="", a=":", b=",", version=LATER.format(3)), ["GPL-3-or-later"]),
        (GPL.format(work="library", kind="Lesser ", a=";", b=";", version=LATER.format("2.1")), ["LGPL-2.1-or-later"]),
        (GPL.format(work="program", kind="Affero ", a=":", b=",", version=LATER.format(3)), ["AGPL-3-or-later"]),
        (GPL.format(work="program", kind="", a=";", b=";", version="version 2 of the License"), ["GPL-2"]),
        (MPL, ["MPL-2.0"]),
        (BSD.format(third=""), ["BSD-2-Clause"]),
        (BSD.format(third=THIRD.format("the copyright holder")), ["BSD-3-Clause"]),
        (BSD.format(third=THIRD.format("Example Inc.")), ["BSD-3-Clause"]),
        (BSD.format(third=THIRD.format("the Regents of Some University, its chair and 3 others")), ["BSD-3-Clause"]),
        (EPL, ["EPL-2.0"]),
        ("All rights\nreserved.", ["Proprietary"]),
        ("This work is dedicated to the\npublic  domain.", ["CC0-1.0"]),
    ]
    commented = [("/*\n" + "\n".join(f" * {x}".rstrip() for x in text.split("\n")) + "\n */\nint main;", want) for text, want in (cases[0], cases[6])]
    commented.append(("\n".join(f"# {x}" for x in "redistribution and use in source and binary forms with or without modification are permitted provided\nthat the following conditions are met".split("\n")) + ":\n", []))
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(cases + commented)], "doc_id long, text string")
    got = licenses.scan(df).orderBy("doc_id").collect()
    assert [r["licences"] for r in got] == [want for _, want in cases + commented]
    assert len(got[-1]["sentence_ids"]) == 1


def test_query_and_sql_agree_on_wrapped_texts(spark, tmp_path):
    duckdb = pytest.importorskip("duckdb")
    whole = [APACHE, MPL, EPL, BSD.format(third=THIRD.format("Some Holder")), GPL.format(work="program", kind="", a=";", b=";", version=LATER.format(2))]
    texts = whole + [t.replace(" ", "  ") for t in whole] + [t.replace("\n", " ") for t in whole] + ["# " + t.replace("\n", "\n# ") for t in whole]
    texts += ["All rights\nreserved.", "dedicated to the\npublic  domain.", "This work is dedicated to the\npublic  domain.", "", None]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    docs.write.parquet(str(tmp_path / "documents"))
    db = duckdb.connect()
    db.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents/*.parquet'")
    want = sorted(map(str, db.execute(f"SELECT doc_id, n_sentences, sentence_ids, licences FROM ({licenses.oracle()})").fetchall()))
    got = sorted(str(tuple(r)) for r in licenses.license_table(docs).select("doc_id", "n_sentences", "sentence_ids", "licences").collect())
    assert got == want


def test_template_counts_against_brute_force(spark, read):
    """Every row of ``pages``: the article as its element has it, and subtrees counted page by page."""
    pages = read("pages")
    found = {r["page_id"]: r for r in html_text.main_text(pages).collect()}
    host = lambda u: re.match(r"\w+://([^/]*)", u)[1]
    seen, articles, own = {}, {}, {}
    for r in pages.collect():
        inner = re.search(r"<article>(.*?)(</article>|\Z)", r["html"], re.S)[1]
        parts = [re.sub("<br>", " ", re.sub(r"</?b>", "", x)) for x in re.split(r"</?(?:p|h1|ul|li|div)\b[^>]*>", inner)]
        parts = [" ".join(html.unescape(x).split()) for x in parts]
        assert found[r["page_id"]]["text"] == "\n".join(x for x in parts if x)
        _, nodes, article = own[r["page_id"]] = html_text.read_page(r["html"])
        articles.setdefault(host(r["url"]), set()).add(article)
        for subtree, *_ in nodes:
            seen.setdefault((host(r["url"]), subtree), set()).add(article)
    for r in pages.collect():
        at, gone = host(r["url"]), set()
        for subtree, start, end, easy in own[r["page_id"]][1]:
            n, of = len(seen[at, subtree]), len(articles[at])
            if n >= 3 and n >= 0.2 * of or easy and n >= 2 and n >= 0.01 * of:
                gone.update(range(start, end))
        assert found[r["page_id"]]["n_template"] == len(gone)
    assert sum(r["n_template"] for r in found.values()) > 0


def test_hostile_pages():
    for page in ("<a " * 160_000 + "'", "<div>x" * 80_000, "<div>" * 50_000 + "</span>" * 30_000, "<a b='" * 60_000, "<script>" * 60_000, "<!--" * 100_000):
        began = time.process_time()
        html_text.read_page(page)
        assert time.process_time() - began < 30
    assert html_text.extract("<p title='x>Hello world") == ["Hello world"]
    assert html_text.extract('<body><form id="aspnetForm"><article><p>a</p></article></form>') == ["a"]
    for kept in ('id="discussion"', 'class="share-price"', 'class="social-history"', 'class="ad-hoc"'):
        assert html_text.extract(f"<article><section {kept}><p>t</p></section></article>") == ["t"]


def test_licences_of_awkward_rows(awkward):
    assert licenses.license_table(awkward).where("n_sentences = 0").count() == awkward.count()


def blocks(page):
    return html_text.extract(page)


def test_broken_markup():
    page = """<html><head><title>T</title></head><body><header>Site</header><div id="cookie-notice">We use cookies</div><nav><ul><li>a<li>b</ul></nav>
    <div class="content"><div class=side-bar>x</div><h2>Title &amp; more</h2><p>One <b>two</i> three<p>Four<br>five<ul><li>l1<li>l2</ul>
    <table><tr><td>c1<td>c2</table><section id=comments><article class="comment">bad!</article></section></div><footer>f</footer>"""
    assert blocks(page) == ["Title & more", "One two three", "Four five", "l1", "l2", "c1", "c2"]
    assert blocks("a < b & c &lt;d&gt;&nbsp; e<div") == ["a < b & c <d> e"]
    assert blocks('<article><p>t</p><div class="ad">q</div><script>"</p>"</script><p>u') == ["t", "u"]
    assert blocks(None) == blocks("") == blocks("<p> </p>") == []
    assert blocks("<!-- <p>x</p> --><p>y<!-- z") == ["y"]
    assert blocks('<p title="a>b">x</p><P>y</P >') == ["x", "y"]


def test_furniture_by_name():
    page = '''<body class="page has-sidebar"><header class="site-header">S</header><article class="post no-comments"><header class="entry-header"><h1>H</h1></header>
    <div class="side-by-side"><p>a</p></div><form>f</form><div class="ad-slot">x</div><div id="cookie_banner">c</div><aside>y</aside><div class="shadow">s</div>
    <footer>z</footer><ol class="commentlist"><li>n</ol></article><div class="newsletter-signup">m</div></body>'''
    assert blocks(page) == ["H", "a", "s"]


def test_furniture_only_by_whole_attributes():
    for attribute in ('style="overflow-x:hidden"', "style='a; class: hidden'", 'data-class="ad"', 'data-id="sidebar"', 'data-role="menu"', 'title="hidden id=nav class=ad"', "data-hidden", 'href=/hidden-gems', 'class="post" data-class="ad"', 'class=post class=ad'):
        assert blocks(f"<body {attribute}><div {attribute}><p>a</p></div><p>b</p></body>") == ["a", "b"], attribute
    assert blocks('<p>x <a href="/hidden-gems">gems</a></p>') == ["x gems"]
    for attribute in ("hidden", 'HIDDEN=""', "x=1 hidden", 'title="a"class="ad"', "role = menu", 'data-class="post" class="ad"', "aria-hidden=true"):
        assert blocks(f"<div {attribute}><p>a</p></div><p>b</p>") == ["b"], attribute


def test_template_is_a_share_of_a_hosts_articles(spark):
    page = "<body><div>Join our club</div>{1}<div><p>Story {0}</p></div></body>"
    sizes = {"large": 400, "middle": 40, "small": 5, "two": 2}
    rows = [(k * 1000 + i, f"https://{h}.example/", page.format(i, "<div>Rare box</div>" if i < n // 10 and i < 12 else "")) for k, (h, n) in enumerate(sizes.items()) for i in range(n)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r["page_id"]: r["text"] for r in html_text.main_text(df).collect()}
    assert got[0] == got[1000] == "Rare box\nStory 0"
    assert got[300] == "Story 300" and got[1030] == "Story 30" and got[2004] == "Story 4"
    assert got[3000] == "Join our club\nStory 0"


def test_templates_go_and_articles_stay(spark):
    page = "<body><div class=box>Join our club</div><div><p>Story {0}</p><div>Filed under news</div><p>Shared line</p></div>"
    rows = [(i, "https://a.example/x", page.format(i)) for i in range(10)] + [(99, "https://b.example/x", page.format(0))]
    rows += [(100 + i, "https://c.example/x", page.format("same")) for i in range(20)]  # copies of one article are no template
    rows += [(200, None, page.format(1)), (None, "x", None), (201, "https://a.example", ""), (201, "https://a.example", "")]
    df = spark.createDataFrame([(*r, "k", 1) for r in rows], "page_id long, url string, html string, host string, row int")
    got = {r["page_id"]: r["text"] for r in html_text.main_text(df).collect()}
    assert got[3] == "Story 3"
    assert got[99] == "Join our club\nStory 0\nFiled under news\nShared line"
    assert got[105].count("\n") == 3 and got[None] == "" and got[201] == ""
    assert html_text.main_text(df).count() == len(rows)
    assert html_text.main_text(df.limit(0)).count() == 0


def test_paragraphs_of_an_article_are_never_template(spark):
    page = "<body><nav>n</nav><article><p>Story {0}</p><p>Shared line</p><div class=x><p>Read also</p></div></article>"
    df = spark.createDataFrame([(i, "https://a.example/x", page.format(i)) for i in range(10)], "page_id long, url string, html string")
    assert {r["text"] for r in html_text.main_text(df).collect()} == {f"Story {i}\nShared line" for i in range(10)}


def test_long_page(spark):
    df = spark.createDataFrame([(1, "u", "<p>" + "word " * 100_000 + "</p>" + "<div>" * 3000)], "page_id long, url string, html string")
    assert html_text.main_text(df).first()["n_chars"] == 499_999
