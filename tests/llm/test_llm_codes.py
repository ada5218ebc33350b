"""Product codes against a plain loop over all entries, and the cases the docstring defines."""

import hashlib
import math

import numpy as np
import pytest

from storyloom.llm import vector_codes

KIND = "vec_id long, embedding array<float>, label int, code string, error int"


def plainly(rows, parts=4, entries=256, rounds=4):
    """rows: (id, vector, label) that take part."""
    whole = [[math.floor(1024 * x) for x in v] for _, v, _ in rows]
    width = len(whole[0]) // parts
    cut = [[v[p * width : (p + 1) * width] for p in range(parts)] for v in whole]
    first = {}
    for (i, v, _), c in zip(rows, cut, strict=True):
        if i is not None and (i not in first or v < first[i][0]):
            first[i] = (v, c)
    books = [[list(first[i][1][p]) for i in sorted(first)[:entries]] for p in range(parts)]

    def near(x, book):
        return min((sum((a - b) ** 2 for a, b in zip(x, y, strict=True)), e) for e, y in enumerate(book))

    for _ in range(rounds):
        for p in range(parts):
            held = {}
            for c in cut:
                held.setdefault(near(c[p], books[p])[1], []).append(c[p])
            for e, own in held.items():
                books[p][e] = [sum(x) // len(own) for x in zip(*own, strict=True)]
    found = [[near(c[p], books[p]) for p in range(parts)] for c in cut]
    errors = [sum(d for d, _ in f) for f in found]
    labels = {}
    for (_, _, label), e in zip(rows, errors, strict=True):
        labels[label] = labels.get(label, 0) + e
    digest = hashlib.sha256(",".join(str(x) for b in books for y in b for x in y).encode()).hexdigest()
    return [(i, "".join(f"{e:02x}" for _, e in f), d, labels[label]) for (i, _, label), f, d in zip(rows, found, errors, strict=True)], digest


def run(spark, rows):
    df = spark.createDataFrame([(i, v, label, "x", 1) for i, v, label in rows], KIND).repartition(3)
    coded, books = vector_codes.compress(df)
    return sorted(((r.id, r.code, r.error, r.label_error) for r in vector_codes.label_errors(coded).collect()), key=repr), vector_codes.digest(books)


@pytest.mark.parametrize("n,dims,ids", [(700, 16, 700), (90, 8, 90), (400, 4, 40)])
def test_codes_equal_a_plain_loop(spark, n, dims, ids):
    rng = np.random.default_rng(n)
    vectors = np.round(rng.normal(size=(n, dims)), 2).astype(np.float32)
    vectors[n // 3 : n // 2] = vectors[0]  # repeated vectors: equally near entries
    rows = [(int(i % ids) * 3, [float(x) for x in v], None if i % 11 == 0 else int(i % 4)) for i, v in enumerate(vectors)]
    rows += [(None, rows[5][1], 2), rows[7], rows[7]]
    extra = [(1, None, 1), (1, [], 1), (4, [1.0] * (dims + 4), 1), (5, [1.0] * (dims - 1), 1), (6, [math.nan] * dims, 1), (7, [1.0] * (dims - 1) + [None], 1), (8, [math.inf] + [0.0] * (dims - 1), 2)]
    expected, digest = plainly(rows)
    got, got_digest = run(spark, rows + extra)
    assert got == sorted(expected, key=repr)
    assert got_digest == digest


def test_odd_tables(spark):
    assert run(spark, [])[0] == []
    assert run(spark, [(1, None, 1), (2, [], 1), (3, [1.0, 2.0, 3.0], 1)])[0] == []
    assert run(spark, [(7, [0.5, -0.5, 0.0, 2.0], None)])[0] == [(7, "00000000", 0, 0)]
    assert [r[0] for r in run(spark, [(None, [0.5, -0.5, 0.0, 2.0], 1)])[0]] == [None]
    with pytest.raises(Exception, match="too large"):
        run(spark, [(1, [1e30] * 4, 1)])


def test_slices_are_exact():
    """Far points, equal entries, wide books: the nearest entry of lowest index, whatever the radius begins with."""
    rng = np.random.default_rng(3)
    for n, dims in ((1, 3), (2, 1), (65, 5), (256, 16), (256, 2)):
        book = rng.integers(-40, 40, (n, dims))
        book[n // 2 :] = book[: n - n // 2]
        points = np.vstack([rng.integers(-60, 60, (300, dims)), rng.integers(-5000, 5000, (40, dims)), book])
        distance = ((points[:, None, :] - book[None]) ** 2).sum(axis=2)
        entry, best = vector_codes.Slices(book).nearest(points)
        assert (entry == distance.argmin(axis=1)).all()
        assert (best == distance.min(axis=1)).all()


def test_bounded_candidates_hold_every_entry_in_the_cube():
    rng = np.random.default_rng(4)
    book, points = rng.integers(-9, 9, (100, 3)), rng.integers(-9, 9, (50, 3))
    index = vector_codes.Slices(book)
    masks = index.inside(points, np.full(50, 4))
    bits = np.unpackbits(masks.view(np.uint8), axis=1, bitorder="little")[:, :100].astype(bool)
    assert (bits == (np.abs(points[:, None] - book[None]).max(axis=2) <= 4)).all()
