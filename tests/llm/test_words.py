from __future__ import annotations

import re

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from corpusloom.llm import words

TEXTS = st.lists(st.one_of(st.none(), st.text(alphabet="ab A\t\r\n\x0b\x1cé漢,", max_size=40)), max_size=6)


@settings(max_examples=60, deadline=None)
@given(TEXTS)
def test_words_are_runs_between_blanks(texts):
    data = [None if t is None else t.encode() for t in texts]
    found = words.hash_words(data, lanes=2)
    want = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for t in texts]
    assert np.diff(found.offsets).tolist() == [len(w) for w in want]
    joined = [w for own in want for w in own]
    assert [found.data[a:b].decode() for a, b in zip(found.starts, found.ends)] == joined
    for lane in range(2):
        assert len(set(found.hashes[lane].tolist())) == len(set(joined))


def test_hashes_depend_on_the_word_alone(monkeypatch):
    text = b"kan lor " * 50 + b"z" * 300 + b" KAN"
    whole = words.hash_words([text], fold=True)
    monkeypatch.setattr(words, "SEGMENT", 64)
    cut = words.hash_words([b"x", text], fold=True)
    assert (whole.hashes[0] == cut.of(1)).all()
    assert whole.hashes[0][0] == whole.hashes[0][-1]


def test_range_hashes_do_not_depend_on_the_place():
    h = words.hash_words([b"a b c d a b c e"]).of(0)
    r = words.range_hashes(h, np.array([0, 4, 0, 1]), np.array([3, 7, 4, 4]))
    assert r[0] == r[1] and len(set(r.tolist())) == 3


def test_short_texts_have_one_shingle():
    h = words.hash_words([b"a b c"]).of(0)
    assert words.shingles(h, 5).size == 1 and words.shingles(h[:0], 5).size == 0
    assert words.shingles(h, 2).size == 2
