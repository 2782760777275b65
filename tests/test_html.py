"""HTML reading, from the rules in its module."""

import time

import pytest

from normata.functions import html as H
from normata.sources import tables as S


@pytest.mark.parametrize(
    ("page", "lines"),
    [
        ("<p>a &amp; b&nbsp;c</p><!-- hidden > text -->", ["a & b\xa0c"]),
        ("&lt;b&gt; &#233;&#xE9;&eacute; &amp;lt; &unknown; &copy 5", ["<b> ééé &lt; &unknown; © 5"]),
        ("<p title='a > b' data-x=\"c>d\" e=f>g<br/>h", ["g", "h"]),
        ("<p title=don't>x</p> y's", ["x", "y's"]),
        ("a < b <3 <1>", ["a < b <3 <1>"]),
        ("x<!-- never closed <p>y", ["x"]),
        ("<!DOCTYPE html><?xml a?></ bogus>t<![CDATA[c]]>u", ["t", "u"]),
        ("<script>if (a<b) '</p>'; </scripty </SCRIPT >s<style>p{}</style>t<template><p>u</p></template>", ["s", "t"]),
        ("<script>no end", []),
        ("a<nav>b<ul><li>c</nav>d<footer>e<nav>f</nav>g</footer>h", ["a", "d", "h"]),
        ("<div>a<header>b</div>c", ["a", "c"]),
        ("a<header/>b<nav>c", ["a", "b"]),
        ("one\n  two \r\n\n<b>three</b>four</i> five", ["one", "two", "three", "four", "five"]),
        ("<p>cut <a href='x", ["cut <a href='x"]),
        ("a <p x='1>b</p> <i>c</i>", ["a", "b", "c"]),
        ("", []),
    ],
)
def test_visible_lines(page, lines):
    assert H.visible_lines(page) == lines


def test_attributes():
    assert H.attributes(" id=A CLASS='b &amp; c' x y = \"z\" id=last") == {"id": "last", "class": "b & c", "x": "", "y": "z"}


def test_nested_rows():
    page = """<table><tr id=o onclick="go('u')"><td>1<td> <b>Ley</b> &amp; <i>B</i> </td></td><td><table><tr id='i'><td>in<a name=n></a><a href='/d.pdf?a=1&amp;b=2'>
      </a></td></tr></table></td></tr><tr><th>h</th></tr><tr><td>open"""
    outer, inner, head, last = H.table_rows(page)
    assert [c["text"] for c in outer["cells"]] == ["1Ley&B", "Ley&B", "in", "in"]
    assert outer["cells"][2]["href"] == "/d.pdf?a=1&b=2" and inner["cells"] == [outer["cells"][3]] and outer["onclick"] == "go('u')"
    assert inner["id"] == "i" and head["cells"] == [] and [c["text"] for c in last["cells"]] == ["open"]


def test_catalogues(spark):
    page = """<table><!-- <tr onclick="x('no.pdf')"><td>1</td><td>No</td></tr> --><tr onclick='abrir("x", &#39;https://h.example/a.PDF?v=1&amp;w=2&#39;)'><td>1</td><td>Ley &amp; B</td></tr>
      <tr onclick="abrir('b.doc')"><td>1</td><td>Doc</td></tr><tr onclick="abrir('c.pdf')"><td>solo</td></tr>
      <TR ID=fila><td>1<td>Decreto <!-- x --> Uno</td></td><td><a><a href=d.pdf></a></td></tr><tr id="filas"><td>1</td><td>No</td><td><a href="e.pdf"></td></tr></table>"""
    pages = spark.createDataFrame([(1, page), (2, None), (3, "")], "page_id int, html string")
    assert [tuple(r) for r in S.catalog_by_onclick(pages).collect()] == [(1, "Ley & B", "https://h.example/a.PDF?v=1&w=2")]
    # the second cell is inside the first, which is not closed before it
    assert [tuple(r) for r in S.catalog_by_row(pages, "fila").collect()] == [(1, "DecretoUno", "d.pdf")]
    out = {r.page_id: r.t for r in pages.select("page_id", H.html_text(pages.html).alias("t")).collect()}
    assert out[2] is None and out[3] == "" and out[1].startswith("1\nLey & B")


def test_hostile_pages_take_linear_time():
    began = time.perf_counter()
    for page in ("<a " + "x=\"" * 50_000, "<" * 200_000, "<a b='" * 50_000, "<div>" * 50_000 + "</x>" * 50_000, "&" * 200_000, "<a b='" * 50_000 + ">'"):
        H.visible_lines(page)
        H.table_rows(page)
    assert time.perf_counter() - began < 20
