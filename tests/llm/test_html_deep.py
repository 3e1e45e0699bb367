"""Deeply nested pages, and text that only looks hidden."""

import time

import pytest

from chronicle.llm.html_text import blocks


@pytest.mark.parametrize("inner", ["<ul><li>x ", "<div><span class=ad>y", "<div>", "<tr>", "</div>", "<dl><dt>a<dd>b"])
def test_time_is_linear_in_nesting(inner):
    def seconds(n):
        begin = time.process_time()
        blocks("<div>" * n + inner * n)
        return time.process_time() - begin

    seconds(1000)
    assert seconds(32_000) < 20 * max(0.05, seconds(4000))  # quadratic time would be 64 times as long


def test_formulas_and_icons_are_text():
    found = blocks('<p>so <math><mi>x</mi><annotation>tex</annotation></math> and <span aria-hidden="true">seen</span> <i hidden>not</i></p>')
    assert [f[0] for f in found] == ["so x and seen"]


def test_starts_that_close():
    page = "<div>a<ul><li>b<li>c<ul><li>d</ul>e</ul><p>f<p>g<table><tr><td>h<td>i<tr><td>j</table>k<dl><dt>l<dd>m</dl></div>"
    assert [f[0] for f in blocks(page)] == list("abcdefghijklm")
