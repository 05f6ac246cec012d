"""Common subsequences of many pairs at once against one pair at a time."""

import random

import pytest
from millrace.functions import similarity as S


def one_pair(a, b):
    where = {c: sum(1 << i for i, x in enumerate(a) if x == c) for c in set(a)}
    full = state = (1 << len(a)) - 1
    for c in b:
        met = state & where.get(c, 0)
        state = (state + met | state - met) & full
    return len(a) - state.bit_count()


def text(rng, n, letters):
    return "".join(rng.choice(letters) for _ in range(n))


@pytest.mark.parametrize("words,cells,long", [(4096, 1 << 22, 64), (4096, 1 << 22, 1), (1, 8, 64), (2, 40, 64), (5, 100, 1)])
def test_lengths_equal_those_of_single_pairs(monkeypatch, words, cells, long):
    """Side by side, as whole numbers, and in bands of one word and more."""
    monkeypatch.setattr(S, "WORDS_AT_ONCE", words)
    monkeypatch.setattr(S, "TABLE_CELLS", cells)
    monkeypatch.setattr(S, "LONG_WORDS", long)
    rng = random.Random(words + cells + long)
    sizes = [0, 1, 5, 63, 64, 65, 128, 200, 500]
    for _ in range(30):
        pairs = [(text(rng, rng.choice(sizes), "abcdefgh é漢\U0001f600\n"), text(rng, rng.choice(sizes), rng.choice(["ab", "abcdefgh é漢\U0001f600\n", "xyz"]))) for _ in range(rng.randrange(1, 20))]
        pairs += [(a, a) for a, _ in pairs[:2]] + [(b[:9] + a, b[:9] + a + b) for a, b in pairs[:2]]
        assert S.common_lengths(pairs) == [one_pair(a, b) for a, b in pairs]
    assert S.common_lengths([]) == []


def test_a_batch_is_held_in_rounds(monkeypatch):
    """All texts of a batch were numbers at once before, so memory grew with the batch."""
    rng = random.Random(5)
    pairs = [(text(rng, rng.randrange(90), "abc"), text(rng, rng.randrange(900), "abcd")) for _ in range(60)] + [("", ""), ("", "a")]
    want = [round(200 * one_pair(a, b) / (len(a) + len(b))) if a or b else 100 for a, b in pairs]
    monkeypatch.setattr(S, "CHARS_AT_ONCE", 700)
    seen, whole = [], S.common_lengths
    monkeypatch.setattr(S, "common_lengths", lambda some: seen.append(some) or whole(some))
    assert S.indel_ratios(pairs) == want and [p for some in seen for p in some] == pairs
    assert len(seen) > 20 and all(len(some) == 1 or sum(len(a) + len(b) for a, b in some) <= 700 for some in seen)
    assert S.indel_ratios([]) == []


def test_long_texts_of_many_characters():
    """More table cells than a band may have: 40,000 characters, most of them different."""
    rng = random.Random(3)
    a = "".join(chr(rng.randrange(0x4E00, 0x9FFF)) for _ in range(40_000))
    b = "".join(c for c in a if rng.random() < 0.9)
    assert S.common_lengths([(a, b), (b, a), ("ab", "b")]) == [len(b), len(b), 1]
    assert S.indel_ratio(a, b) == round(200 * len(b) / (len(a) + len(b)))
