import hashlib
import random

import numpy as np
import pytest

from terralex.llm import suffix


def brute(rows):
    """rows in order: (n_bytes, n_removed, n_spans, digest) of each."""
    seen, out = set(), []
    for text in rows:
        raw = (text or "").encode()
        gone = bytearray(len(raw))
        for k in range(len(raw) - 99):
            w = raw[k : k + 100]
            if w in seen:
                gone[k : k + 100] = b"\1" * 100
            seen.add(w)
        kept = bytes(b for b, g in zip(raw, gone) if not g)
        out.append((len(raw), len(raw) - len(kept), sum(1 for k in range(len(raw)) if gone[k] and not (k and gone[k - 1])), hashlib.sha256(kept).hexdigest()))
    return out


@pytest.mark.parametrize("length", [16, 24, 33, 100])
def test_order_and_classes(length):
    rng = random.Random(length)
    for kind in range(30):
        raw = bytes(rng.choices(b"ab" if kind % 2 else b"a", k=500)) if kind % 3 else bytes(rng.randrange(256) for _ in range(60)) * 8
        starts = np.array(rng.sample(range(len(raw) - length + 1), rng.randint(1, 300)))
        order, classes = suffix.deep_shallow(raw, starts, length)
        strings = [raw[s : s + length] for s in starts]
        assert [strings[k] for k in order] == sorted(strings)
        assert len({(c, s) for c, s in zip(classes, strings)}) == len(set(strings)) == len(set(classes))
    assert len(suffix.deep_shallow(b"", np.zeros(0, np.int64), length)[0]) == 0


def corpus(seed):
    rng = random.Random(seed)
    text = lambda n: "".join(rng.choices("abcdefg é", k=n))
    shared = [text(rng.choice([60, 99, 100, 101, 180, 400])) for _ in range(8)]
    rows = []
    for _ in range(60):
        parts = [text(rng.randint(0, 150)) if rng.random() < 0.5 else rng.choice(shared) for _ in range(rng.randint(0, 5))]
        rows.append("".join(parts))
    return rows + rows[:5] + ["a" * 500, "ab" * 300, "x" * 99, shared[4] + shared[4], None, "", "line of text here\n" * 30]


@pytest.mark.parametrize("seed,combine", [(1, 8), (2, 1), (3, 3)])
def test_equals_brute_force(spark, monkeypatch, seed, combine):
    monkeypatch.setattr(suffix, "COMBINE", combine)
    rows = list(enumerate(corpus(seed)))
    random.Random(seed).shuffle(rows)
    got = suffix.without_repeats(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)).orderBy("doc_id").collect()
    want = brute([t for _, t in sorted(rows, key=lambda r: r[0])])
    assert [(r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got] == want
    for r, (_, t) in zip(got, sorted(rows, key=lambda r: r[0])):
        raw = (t or "").encode()
        for s in reversed(r.spans):
            raw = raw[: s.start] + raw[s.end :]
        assert bytes(r.kept) == raw


def test_odd_texts(spark, odd_docs, no_docs):
    got = suffix.without_repeats(odd_docs, text=False).collect()
    assert len(got) == odd_docs.count() and sum(r.n_removed for r in got) > 0
    assert suffix.without_repeats(no_docs).count() == 0
