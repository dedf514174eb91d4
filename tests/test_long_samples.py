"""Fits of long samples: what is held beside the sample doesn't grow with it."""

import tracemalloc

import numpy as np

from marigrid.functions import distributions as dist


def test_distribution_functions_hold_little_beside_the_sample():
    x = np.random.default_rng(1).normal(size=200_000)
    for f in (dist.cdf, dist.logpdf):
        tracemalloc.start()
        got = f("skewnorm", x, 2.0, 0.1, 1.3)
        peak = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        # the result, and the 32 nodes of a block or so
        assert peak < 2 * x.nbytes + 30 * 32 * 8 * 1024
        assert (got[::20_000] == f("skewnorm", x[::20_000], 2.0, 0.1, 1.3)).all()


def test_far_tail_of_the_statistic():
    assert all(dist.cvm_p(s) < 1e-6 for s in (5.0, 12.0, 13.0, 60.0, 250.0, 4000.0))
