"""The sums that the language model learns from, and its token numbers, against plain restatements."""

from collections import Counter

import numpy as np
import pyarrow as pa

from loculus.llm import lm


def tables(batches, shapes):
    found = {k: np.zeros(shape) for k, shape in shapes.items()}
    for b in batches:
        for name, at, sums in zip(*(b.column(c).to_pylist() for c in ("name", "at", "sums")), strict=True):
            block = np.frombuffer(sums).reshape(-1, shapes[name][1])
            found[name][at : at + len(block)] = block
    return found


def sample():
    r = np.random.default_rng(3)
    texts = [np.append(r.zipf(1.3, n).clip(1, lm.RARE), lm.END).astype(np.uint16) for n in (0, 1, 3, 50, 4_000, 9_000)]
    counts = np.bincount(np.concatenate(texts), minlength=lm.RARE + 1).astype(float)
    counts[lm.RARE] = 0
    return texts, counts, pa.RecordBatch.from_pydict({"ids": pa.array([t.tobytes() for t in texts], pa.binary())})


def test_sums():
    texts, counts, batch = sample()
    near = np.zeros((lm.RARE + 1, lm.SIGNS))
    stretches = list(lm._stretches(iter([batch])))
    for line, _ in stretches:
        for i, word in enumerate(line.tolist()):
            for j in (*range(max(0, i - lm.NEAR), i), *range(i + 1, min(len(line), i + lm.NEAR + 1))):
                if lm.END < line[j] <= lm.SIGNS:
                    near[word, line[j] - 1] += 1
    assert (tables(lm._near(iter([batch])), {"near": near.shape})["near"] == near).all() and near.any()

    model = lm.Model(counts, 5.0, near)
    model.weights += np.random.default_rng(4).normal(0, 0.3, model.weights.shape).astype(np.float32)
    shapes = {"shown": model.weights.shape, "expected": model.weights.shape, "head_shown": model.head_weights.shape, "head_expected": model.head_weights.shape}
    want = {k: np.zeros(s) for k, s in shapes.items()}
    for line, places in stretches:
        _, (rows, kind, classes), (head_rows, head, heads) = model.outcomes(line, places)
        assert np.allclose(classes.sum(axis=1), 1, atol=1e-5) and np.allclose(heads.sum(axis=1), 1, atol=1e-5)
        for k, features, outcome, chance in (("", rows, kind, classes), ("head_", head_rows, head, heads)):
            for r in features:
                np.add.at(want[k + "shown"], (r, outcome), 1)
                np.add.at(want[k + "expected"], r, chance)
    got = tables(model.statistics(iter([batch])), shapes)
    assert all(np.allclose(got[k], want[k], rtol=1e-3, atol=1e-4) for k in want)


def test_feature_rows_stay_in_their_tables():
    line = np.random.default_rng(5).integers(0, lm.RARE + 1, 5_000)
    places = np.arange(3, len(line))
    one, two, three, pair = lm.Model.features(line, places)
    for k, rows in enumerate((one, two, three)):
        assert k * lm.WORD_ROWS <= rows.min() and rows.max() < (k + 1) * lm.WORD_ROWS
    hashed = ((line[places - 1] * 1_000_003 + line[places - 2] * 7919) * 2_654_435_761 >> 9) % lm.PAIR_ROWS
    assert (pair == 3 * lm.WORD_ROWS + hashed).all()


def test_token_numbers():
    texts = [b"the cat the dog", None, b"", b"Dog x y x"]
    batch = pa.RecordBatch.from_pydict({"row": [0, 1, 2, 3], "doc_id": [5, 6, None, 7], "held_out": [True] * 4, "part": pa.array([-1] * 4, pa.int32()), "text": pa.array(texts, pa.binary())})
    (got,) = lm._encoder([b"the", b"dog"])(iter([batch]))
    rows = got.to_pylist()
    assert [np.frombuffer(r["ids"], np.uint16).tolist() for r in rows] == [[1, lm.RARE, 1, 2, 0], [0], [0], [2, lm.RARE, lm.RARE, lm.RARE, 0]]
    assert [Counter(dict(zip(r["rare"], r["times"], strict=True))) for r in rows] == [Counter([b"cat"]), Counter(), Counter(), Counter([b"x", b"x", b"y"])]
