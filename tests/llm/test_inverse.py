import numpy as np

from kinweave.llm import lm


def test_inverse_equals_unique():
    r = np.random.default_rng(3)
    near = (np.uint64(1) << np.uint64(63)) + r.integers(0, 40, 5000).astype(np.uint64)  # differ in the bits that don't fit
    for x in (np.empty(0, np.uint64), np.array([7]), np.zeros(9, np.int64), r.integers(0, 50, 5000), r.integers(0, 2**62, 5000), r.integers(0, 2**64, 5000, np.uint64), near):
        distinct, back = lm.inverse(x)
        want, places = np.unique(x, return_inverse=True)
        assert distinct.dtype == want.dtype and (distinct == want).all() and (back == places).all()
