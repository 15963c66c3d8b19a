"""MinHash components against all pairs of sets."""

import random

import pytest

from nnfield.llm import minhash


def plain_set(text):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = [w for w in "".join(" " if c in "\t\n\v\f\r" else c for c in lower).split(" ") if w]
    return frozenset(" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))) if words else frozenset()


def brute(rows):
    sets = [plain_set(t) for _, t in rows]
    distinct = sorted(set(sets), key=sorted)
    label = {s: i for i, s in enumerate(distinct)}
    changed = True
    pairs = [(a, b) for i, a in enumerate(distinct) for b in distinct[:i] if a and b and 100 * len(a & b) >= 80 * len(a | b)]
    while changed:
        changed = False
        for a, b in pairs:
            low = min(label[a], label[b])
            changed |= label[a] != label[b]
            label[a] = label[b] = low
    least = {}
    for (doc, _), s in zip(rows, sets):
        if doc is not None and s:
            least[label[s]] = min(least.get(label[s], doc), doc)
    out = []
    for (doc, _), s in zip(rows, sets):
        smallest = least.get(label[s]) if s else doc
        out.append((doc, len(s), smallest, doc is not None and doc == smallest))
    return out, len(pairs)


def versions(rnd, base, count, most):
    for _ in range(count):
        copy = list(base)
        for _ in range(rnd.randint(0, most)):
            at = rnd.randrange(len(copy))
            copy[at : at + rnd.randint(0, 1)] = [f"n{rnd.randrange(10**6)}"]
        yield " ".join(copy)


def corpus():
    rnd = random.Random(8)
    vocabulary = [f"w{i}" for i in range(3000)]
    passage = [rnd.choice(vocabulary) for _ in range(60)]
    texts = []
    for _ in range(25):
        base = [rnd.choice(vocabulary) for _ in range(rnd.choice((5, 30, 70, 90, 150, 400)))]
        base += passage if rnd.random() < 0.5 else []
        texts += versions(rnd, base, rnd.randint(1, 6), max(1, len(base) // 25))
    group = [rnd.choice(vocabulary) for _ in range(140)]
    texts += versions(rnd, group, 90, 6)
    texts += ["a b c d e", "a b c d e f", "A B", "a b", "a b", "word " * 50, "word " * 9, "É b c d", "é b c d"]
    rows = [(i + 5, t) for i, t in enumerate(rnd.sample(texts, len(texts)))]
    return rows + [(1, None), (2, ""), (3, " \n\x0b"), (None, rows[0][1]), (9000, rows[0][1].upper()), rows[0], (None, "nobody else here at all"), (rows[1][0], rows[2][1])]


def answer(frame):
    return sorted(map(tuple, frame.collect()), key=str)


def test_equals_all_pairs(docs_of):
    rows = corpus()
    want, pairs = brute(rows)
    assert pairs > 200
    found = minhash.near_duplicates(docs_of(rows))
    assert found.columns == ["doc_id", "n_shingles", "component_id", "kept"]
    assert answer(found) == sorted(want, key=str)


@pytest.mark.parametrize("block,long", [(7, 20), (16, 1000)])
def test_long_lists_are_cut(docs_of, block, long):
    rows = corpus()
    assert answer(minhash.near_duplicates(docs_of(rows), block=block, long=long)) == sorted(brute(rows)[0], key=str)


def test_small_sketches_lose_little_and_large_ones_nothing(docs_of):
    rows = corpus()
    assert answer(minhash.near_duplicates(docs_of(rows), k=1000)) == sorted(brute(rows)[0], key=str)


def test_needed_is_the_tail_of_the_draw():
    assert [minhash.needed(n) for n in (1, 5, 10, 51)] == [1, 4, 8, 41]
    rnd = random.Random(1)
    k = minhash.K
    for n in (147, 2000):
        union = n * 100 // 80
        draws = sorted(sum(x < -(-80 * union // 100) for x in rnd.sample(range(union), k)) for _ in range(3000))
        assert minhash.needed(n) <= draws[0]
        assert minhash.needed(n, loss=0.05) >= draws[60]


@pytest.mark.parametrize("k", [16, 64])
def test_sketches_of_similar_sets_share_what_is_needed(k):
    rnd = random.Random(2)
    for n in [*range(1, 110), 200, 700]:
        for union in sorted({n, n + 1, *rnd.sample(range(n, n * 100 // 80 + 1), min(5, n * 100 // 80 + 1 - n)), n * 100 // 80}):
            common = -(-80 * union // 100)
            if not common <= n <= union or union > n * 100 // 80:
                continue
            hashes = rnd.sample(range(10**9), union)
            one, other = hashes[:n], hashes[:common] + hashes[n:]
            hits = len(set(sorted(one)[:k]) & set(sorted(other)[:k]))
            assert hits >= max(minhash.needed(len(one), k), minhash.needed(len(other), k)), (n, union)


@pytest.mark.parametrize("count", [5, 40])
def test_a_cell_gives_fewer_links_than_nodes(count):
    words = [f"w{i}" for i in range(60)]
    rows = []
    for i in range(count):
        text = " ".join(words + [f"x{i}_{j}" for j in range(i % 20)]).encode()
        sketch = sorted(hash(x) & 0xFFFFFFFF for x in set(minhash.shingles(text)))
        rows.append(minhash._Node(i % 2 == 1, i, i, len(sketch), minhash.needed(len(sketch)), [7], sketch[: minhash.K], text))
    for diagonal in (True, False):
        found = minhash._tied(rows, minhash._cell_pairs(7, diagonal, rows, minhash.K, 80), 80, 4)
        assert 0 < len(found) < count
        assert minhash._cell_pairs(8, diagonal, rows, minhash.K, 80) == [] or count > minhash.FEW


def test_pairs_of_large_cells_are_counted_as_one_by_one(monkeypatch):
    rnd = random.Random(4)
    base = [f"w{i}" for i in range(70)]
    rows = []
    for i, words in enumerate(versions(rnd, base, 140, 6)):
        text = words.encode()
        sketch = sorted({hash(x) & 0xFFFFFFFF for x in set(minhash.shingles(text))})[: minhash.K]
        size = len(set(minhash.shingles(text)))
        rows.append(minhash._Node(i % 2 == 1, i, i // 3, size, minhash.needed(size), [7, *rnd.sample(range(8), 1)], sketch, text))
    for diagonal in (True, False):
        many = minhash._cell_pairs(7, diagonal, rows, minhash.K, 80)
        assert len(many) > minhash.FEW_PAIRS
        tied = minhash._tied(rows, many, 80, 4)
        with monkeypatch.context() as plain:
            plain.setattr(minhash, "FEW", 1000)
            plain.setattr(minhash, "FEW_PAIRS", 10**6)
            # (i, j) of either order
            few = minhash._cell_pairs(7, diagonal, rows, minhash.K, 80)
            assert sorted((h, *sorted(p)) for h, *p in few) == sorted((h, *sorted(p)) for h, *p in many)
            # no pair of many rows is looked at one by one
            assert minhash._tied(rows, many, 80, 4) == tied
        with monkeypatch.context() as slow:
            slow.setattr(minhash._Node, "hits", None)
            assert minhash._cell_pairs(7, diagonal, rows, minhash.K, 80) == many


def test_empty_table(docs_of):
    assert minhash.near_duplicates(docs_of([])).collect() == []
    assert answer(minhash.near_duplicates(docs_of([(4, None)]))) == [(4, 0, 4, True)]
