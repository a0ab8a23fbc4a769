import hashlib
import math

import numpy as np
import pytest

from siftwell.llm import vector_codes as V


def plain(rows, parts=V.PARTS, entries=V.ENTRIES, rounds=V.ROUNDS):
    """[(vec_id, label, code, error)] and the codebooks' digest, entry by entry in Python's integers."""
    own = [(i, v, l) for i, v, l in rows if v and all(x is not None and math.isfinite(x) for x in v)]
    q = [[math.floor(256 * x) for x in v] for _, v, _ in own]
    w = len(q[0]) // parts
    cut = [[x[p * w : (p + 1) * w] for p in range(parts)] for x in q]
    first = sorted(range(len(own)), key=lambda j: (own[j][0] is None, own[j][0] or 0, own[j][1]))[:entries]
    books = [[cut[j][p] for j in first] for p in range(parts)]

    def nearest():
        out = []
        for x in cut:
            out.append([min((sum((a - b) ** 2 for a, b in zip(x[p], c)), e) for e, c in enumerate(books[p])) for p in range(parts)])
        return out

    for _ in range(rounds):
        at = nearest()
        for p in range(parts):
            for e in range(len(books[p])):
                mine = [cut[j][p] for j in range(len(own)) if at[j][p][1] == e]
                if mine:
                    books[p][e] = [sum(z) // len(mine) for z in zip(*mine)]
    at = nearest()
    digest = hashlib.sha256(",".join(str(x) for b in books for c in b for x in c).encode()).hexdigest()
    return [(own[j][0], own[j][2], "".join(f"{e:02x}" for _, e in at[j]), sum(d for d, _ in at[j])) for j in range(len(own))], digest


def compressed(spark, rows, **how):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    codes, books = V.compress(df.repartition(3), **how)
    return sorted(((r.vec_id, r.label, r.code.hex(), r.error) for r in codes.collect()), key=repr), books


@pytest.mark.parametrize("seed", range(3))
def test_against_plain_python(spark, seed):
    rng = np.random.default_rng(seed)
    middles = rng.normal(0, 0.4, (12, 32))
    rows = [(int(i), [float(np.float32(x)) for x in middles[i % 12] + rng.normal(0, 0.05 * (seed + 1), 32)], int(i % 3) if i % 5 else None) for i in rng.permutation(220)]
    rows += [(1, rows[0][1], 1), (None, rows[3][1], None), (500, None, 1), (501, [float("nan")] * 32, 1), (502, [0.0] * 31 + [None], 1), (503, [float("inf")] * 32, 2), (504, [], 2)]
    got, books = compressed(spark, rows)
    want, digest = plain(rows)
    assert got == sorted(want, key=repr) and books.digest == digest


def test_fewer_rows_than_entries_and_equal_rows(spark):
    rows = [(7, [0.5] * 16, None)] * 3 + [(2, [-0.001] * 16, 1)]
    got, books = compressed(spark, rows)
    want, digest = plain(rows)
    assert got == sorted(want, key=repr) and books.digest == digest and books.entries.shape == (16, 4, 1)
    assert books.entries.min() == -1, "floors go down"


def test_search_looks_at_few_entries_and_keeps_ties():
    rng = np.random.default_rng(5)
    books = V.Codebooks(rng.integers(-300, 300, (2, 64, 4)))
    books = V.Codebooks(np.concatenate([books.entries[:, :63], books.entries[:, :1]], axis=1))  # the last entry equals the first
    x = (books.entries[:, rng.integers(0, 64, 4000)].transpose(1, 0, 2) + rng.integers(-9, 10, (4000, 2, 4))).reshape(4000, 8)
    want = np.stack([((x[:, None, p * 4 : p * 4 + 4] - books.entries[None, p]) ** 2).sum(axis=2) for p in range(2)], axis=1)
    code, error, full = V.assign(x, books, np.full((4000, 2), 63, np.uint8))
    assert (code == want.argmin(axis=2)).all() and (error == want.min(axis=2).sum(axis=1)).all()
    again, _, looked = V.assign(x, books, code)
    assert (again == code).all() and looked < full and looked < 4000 * 2 * 64 / 4
    wide = V.assign(x << 19, V.Codebooks(books.entries << 19), code)  # beyond what floating point holds
    assert (wide[0] == code).all() and (wide[1] == error << 38).all()


def test_bounds(spark):
    assert compressed(spark, [(1, None, 1)]) == ([], None)
    with pytest.raises(ValueError):
        compressed(spark, [(1, [0.5] * 15, 1)])
    with pytest.raises(Exception, match="16 components"):
        compressed(spark, [(1, [0.5] * 16, 1), (2, [0.5] * 32, 1)])
    with pytest.raises(OverflowError):
        compressed(spark, [(1, [1e30] * 16, 1)])
    books = V.Codebooks(np.arange(16).reshape(16, 1, 1))
    assert np.allclose(books.decode(np.zeros((1, 16), int)), np.arange(16) / 256)


def test_label_errors_with_clashing_names(spark):
    rows = [(1, [0.1] * 16, None), (2, [0.2] * 16, None), (3, [0.9] * 16, 5)]
    df = spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, embedding array<float>, label int, code string")
    codes, _ = V.compress(df, entries=1)
    out = {r.vec_id: r for r in V.with_label_error(codes).collect()}
    assert out[1].label_error == out[2].label_error == out[1].error + out[2].error and out[3].label_error == out[3].error
