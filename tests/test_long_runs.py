"""Run lengths of a series that stays stable for long."""

import numpy as np

from pitloom.functions.stats import run_length_posterior


def test_runs_above_400_are_kept():
    x = np.random.default_rng(1).normal(0, 1, 900)
    run = run_length_posterior(x, 0.01)
    assert run[-1] > 800 and run.max() > 800
