import random
import re

import numpy as np
import pyarrow as pa
from hypothesis import given, settings, strategies as st

from lossweave.llm import textkernels as K
from lossweave.llm.best_fit_pack import best_fit_decreasing
from lossweave.llm.decontaminate import WINDOW
from lossweave.llm.graph import forest
from lossweave.llm.langid import viterbi
from lossweave.llm.length_buckets import boundaries

WORD = re.compile(r"[^\x20\x09-\x0D]+")
texts = st.lists(st.one_of(st.none(), st.text(alphabet="ab é\n\t ü日", max_size=40)), max_size=12)


@given(texts)
@settings(max_examples=150, deadline=None)
def test_words_equal_the_pattern(rows):
    data, off = K.utf8(pa.array(rows, pa.string()))
    starts, ends, first = K.words(data, off)
    got = [[data[starts[w] : ends[w]].tobytes().decode() for w in range(first[i], first[i + 1])] for i in range(len(rows))]
    assert got == [WORD.findall(t or "") for t in rows]
    h = K.slice_hashes(data, starts, ends)
    flat = [w for r in got for w in r]
    assert all((flat[i] == flat[j]) == (h[i] == h[j]) for i in range(len(flat)) for j in range(i))


@given(texts, st.integers(1, 4))
@settings(max_examples=100, deadline=None)
def test_shingle_sets_have_the_right_sizes(rows, k):
    data, off = K.utf8(pa.array(rows, pa.string()))
    _, first = K.shingle_sets(data, off, k)
    for i, t in enumerate(rows):
        w = WORD.findall(t or "")
        want = {tuple(w[j : j + k]) for j in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())
        assert first[i + 1] - first[i] == len(want)


def test_equal_slices_compares_bytes():
    data = np.frombuffer(b"abcabdabc", np.uint8)
    s1, s2 = np.array([0, 0, 3]), np.array([6, 3, 3])
    assert K.equal_slices(data, s1, s1 + 3, s2, s2 + 3).tolist() == [True, False, True]


def test_forest_joins_what_is_connected():
    rng = random.Random(3)
    for _ in range(50):
        n = rng.randint(2, 30)
        edges = [(rng.randrange(n), rng.randrange(n)) for _ in range(rng.randint(1, 40))]
        root = list(range(n))
        for _ in range(n):
            for a, b in edges:
                root[a] = root[b] = min(root[a], root[b])
        hi, lo = forest(np.array([a for a, _ in edges]), np.array([b for _, b in edges]))
        got = dict(zip(hi.tolist(), lo.tolist()))
        for x in {y for e in edges for y in e}:
            assert got.get(x, x) == root[x]


def test_viterbi_equals_dynamic_programming():
    rng = np.random.default_rng(5)
    counts = rng.integers(0, 9, 12)
    score = rng.normal(size=(counts.sum(), 3)).astype(np.float32) * 3
    got, at = viterbi(score, counts, 4.0), 0
    for n in counts:
        e = score[at : at + n]
        if n:
            best = -1e9
            import itertools

            if n <= 7:
                for path in itertools.product(range(3), repeat=int(n)):
                    v = sum(e[i, p] for i, p in enumerate(path)) - 4.0 * sum(a != b for a, b in zip(path, path[1:]))
                    best = max(best, v)
                mine = got[at : at + n]
                assert abs(sum(e[i, p] for i, p in enumerate(mine)) - 4.0 * sum(a != b for a, b in zip(mine, mine[1:])) - best) < 1e-3
        at += n


def test_boundaries_pad_least():
    import itertools

    rng = random.Random(7)
    for _ in range(60):
        lengths = sorted(rng.sample(range(40), rng.randint(1, 8)))
        counts = [rng.randint(1, 9) for _ in lengths]
        k = rng.randint(1, 5)
        cost = lambda b: sum(c * min(x for x in b if x >= n) for n, c in zip(lengths, counts))
        want = min(cost([*s, lengths[-1]]) for r in range(k) for s in itertools.combinations(lengths[:-1], min(r, len(lengths) - 1)))
        got = boundaries(lengths, counts, k)
        assert len(got) <= k and cost(got) == want
    assert boundaries([], [], 4) == []


def plain_best_fit(sizes, capacity):
    """Rooms left by best fit decreasing, piece by piece."""
    room = []
    for n in sorted(sizes, reverse=True):
        fit = [r for r in room if r >= n]
        room.remove(min(fit)) if fit else None
        room.append((min(fit) if fit else capacity) - n)
    return sorted(room)


def test_best_fit_decreasing_takes_the_fullest_row():
    rng = np.random.default_rng(1)
    for _ in range(200):
        c = int(rng.integers(1, 50))
        s = rng.integers(1, c + 1, int(rng.integers(0, 120)))
        counts = np.bincount(s, minlength=c + 1)
        moves, rows = best_fit_decreasing(counts, c)
        used = [[] for _ in range(rows)]
        for n, first, count, each, row, offset in moves.tolist():
            for i in range(count):
                used[row + i // each].append((offset + i % each * n, n))
        assert sorted(n for r in used for _, n in r) == sorted(s.tolist())
        for n in set(s.tolist()):  # every rank once
            assert sorted(first + i for m, first, count, *_ in moves.tolist() if m == n for i in range(count)) == list(range(counts[n]))
        for r in used:  # side by side, without gaps
            assert [a for a, _ in sorted(r)] == np.cumsum([0, *(n for _, n in sorted(r))])[:-1].tolist()
        assert sorted(c - sum(n for _, n in r) for r in used) == plain_best_fit(s.tolist(), c)


def test_moves_do_not_follow_the_number_of_pieces():
    rng = np.random.default_rng(2)
    counts = rng.integers(1, 100, 4097)
    counts[0] = 0
    few, many = (len(best_fit_decreasing(counts * k, 4096)[0]) for k in (1, 1_000_000))
    assert many < 4 * few and many < 60_000


def test_window_is_thirteen():
    assert WINDOW == 13
