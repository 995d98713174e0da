import random

import pytest

from orbweave.llm import suffix_dedup
from orbweave.llm.induced import Queue, matcher, suffix_array


def brute(text, cap):
    order = sorted(range(len(text)), key=lambda i: text[i:])
    lcp = [0]
    for a, b in zip(order, order[1:], strict=False):
        k = 0
        while a + k < len(text) and b + k < len(text) and text[a + k] == text[b + k]:
            k += 1
        lcp.append(min(k, cap))
    return order, lcp if text else []


def texts():
    rng = random.Random(2)
    out = [[], [1], [1, 1], [2, 1], [1, 2], [1] * 30, list(range(1, 20)), list(range(20, 0, -1)), [1, 2] * 20, [2, 1, 1] * 15, [ord(c) for c in "mississippi" * 4]]
    for _ in range(150):
        base = [rng.randrange(1, 1 + rng.choice([1, 2, 3, 40])) for _ in range(rng.randrange(1, 30))]
        out.append([x for _ in range(rng.randrange(1, 5)) for x in base[: rng.randrange(len(base) + 1)]])
    return out


@pytest.mark.parametrize("cap", [3, 1000])
@pytest.mark.parametrize("keep", [2, 1 << 18])
def test_against_brute_force(tmp_path, cap, keep):
    for text in texts():
        for folder in (str(tmp_path), None):
            got = suffix_array(text, cap, folder, keep)
            assert ([int(x) for x in got[0]], [int(x) for x in got[1]]) == brute(text, cap), text
    assert not list(tmp_path.iterdir())


def test_queue_with_runs_on_disk(tmp_path):
    rng, queue, out, want = random.Random(1), Queue(str(tmp_path), 10), [], []
    for _ in range(3):
        for _ in range(100):
            want.append((rng.randrange(50), rng.random()))
            queue.push(want[-1])
        want.sort()
        for x in want[:60]:
            assert queue.first() == x
            out.append(queue.pop())
        want = want[60:]
    while queue.first() is not None:
        assert queue.pop() == want.pop(0)
    assert not want


def test_matcher_agrees_with_the_hashed_one():
    rng = random.Random(3)
    shared = bytes(rng.randrange(4) for _ in range(90))
    parts = [bytes(rng.randrange(256) for _ in range(20)) + shared[a : a + 50] + bytes(rng.randrange(3) for _ in range(30)) for a in range(0, 40, 3)]
    for mine, theirs in zip(matcher(parts, 40), suffix_dedup.hashed_matcher(parts, 40), strict=True):
        assert (mine == theirs).all()


def test_queues_merge_their_runs(tmp_path):
    from orbweave.llm import induced

    rng, queue = random.Random(4), Queue(str(tmp_path), 3)
    want = [(rng.randrange(10_000), k) for k in range(2000)]
    for x in want:
        queue.push(x)
        assert len(queue.heads) <= induced.FAN + 1
    for x in sorted(want):
        assert queue.pop() == x
