"""Words, lines and grams of groups of texts against plain splits."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from cubespark.llm import text_batch
from cubespark.llm.common import word_hashes
from cubespark.llm.text_batch import groups

TEXT = st.none() | st.text(alphabet=st.sampled_from("ab é\n\tß\x0b Ab"), max_size=40)


def words_of(text: str) -> list[str]:
    return [w for w in text.translate({c: " " for c in (9, 10, 11, 12, 13)}).split(" ") if w]


@settings(max_examples=200, deadline=None)
@given(st.lists(TEXT, max_size=8), st.integers(0, 2), st.sampled_from([1, 20, 1 << 19]))
def test_groups_equal_plain_splits(texts, skip, size):
    text_batch.GROUP_BYTES, before = size, text_batch.GROUP_BYTES
    try:
        found = list(groups(pa.array([None] * skip + texts, pa.string())[skip:]))
    finally:
        text_batch.GROUP_BYTES = before
    assert sum(g.docs for g in found) == len(texts)
    for group in found:
        own = [(t or "") for t in texts[group.at : group.at + group.docs]]
        first, count = group.spans_of_texts()
        for k, text in enumerate(own):
            h = word_hashes(text.encode().lower())[0]
            assert count[k] == len(words_of(text)) == len(h) and (group.word[first[k] : first[k] + count[k]] == h).all()
            starts = group.points(group.start[first[k] : first[k] + count[k]], np.full(count[k], k))
            ends = group.points(group.end[first[k] : first[k] + count[k]], np.full(count[k], k))
            assert [text[a:b] for a, b in zip(starts, ends, strict=True)] == words_of(text)
            lines = np.flatnonzero(group.line_doc == k)
            at = np.full(len(lines), k)
            spans = zip(group.points(group.line_start[lines], at), group.points(group.line_end[lines], at), strict=True)
            assert [text[a:b] for a, b in spans] == text.split("\n")
            numbers = group.line[first[k] : first[k] + count[k]] - group.first_line[k]
            assert numbers.tolist() == [n for n, line in enumerate(text.split("\n")) for _ in words_of(line)]
        for wide in (False, True):
            lines = group.paragraphs(1)
            h, begin = group.shingles(*group.spans_of_lines(lines), 3, wide)
            sizes = np.diff(np.append(begin, len(h)))
            for line, n in zip(lines, sizes, strict=True):
                w = words_of(own[group.line_doc[line]].lower().split("\n")[line - group.first_line[group.line_doc[line]]])
                assert n == len({tuple(w[i : i + 3]) for i in range(max(1, len(w) - 2))})
        gram, at = group.grams(3)
        want = [(k, i) for k, text in enumerate(own) for i in range(len(words_of(text)) - 2)]
        assert [(int(group.doc[i]), int(i - first[group.doc[i]])) for i in at] == want
        chosen = set(group.seeds(gram, at, 4).tolist())
        for k in range(group.docs):
            own_grams = [i for i in range(len(at)) if group.doc[at[i]] == k]
            windows = [own_grams[i : i + 4] for i in range(len(own_grams) - 3)] or ([own_grams] if own_grams else [])
            assert {i for i in own_grams if i in chosen} == {i for w in windows for i in w if gram[i] == min(gram[w])}
