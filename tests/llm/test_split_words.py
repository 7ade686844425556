"""Long words aren't cut while the span has a boundary."""

from __future__ import annotations

import pytest

from memloom.llm import split


@pytest.mark.parametrize(("lo", "hi"), [(600, 1800), (100, 1700), (700, 2300)])
def test_long_word_is_kept_whole(lo, hi):
    words = lambda n: ("ab " * n)[: n - 1] + " "
    text = words(lo) + "x" * (hi - lo) + " " + words(2400 - hi - 1)
    pieces = split.spans(text, 2000, 0)
    assert pieces[0][0] == 0 and pieces[-1][1] == len(text) and all(b == c for (_, b), (c, _) in zip(pieces, pieces[1:], strict=False))
    assert all(text[b - 1] == " " for _, b in pieces[:-1])


def test_hard_cut_only_without_any_boundary():
    assert split.cut_at("x" * 100, 0, 100) == 50
    assert split.cut_at("a " + "x" * 98, 0, 100) == 2
    assert split.cut_at("x" * 99 + " ", 0, 100) == 50  # a cut at the very end would leave nothing
    text = "y " * 3 + "x" * 5000 + " z"
    assert max(b - a for a, b in split.spans(text)) <= split.LIMIT
