"""Keys of any length on one line."""

import string

import numpy as np
import pytest

from treedex.llm import secrets


@pytest.mark.parametrize("n", [20, 400, 512, 513, 600, 1600, 50_000])
def test_random_runs_of_any_length(n):
    key = "".join(np.random.default_rng(4).choice(list(string.ascii_letters + string.digits + "+/"), n))
    assert secrets.scan(f"é {key} y") == [(2, 2 + n, "random")]
    assert secrets.scan(key) == [(0, n, "random")]
    assert secrets.redact(f"é {key} y", secrets.scan(f"é {key} y")) == "é [SECRET] y"


def test_long_runs_that_are_not_random():
    assert secrets.scan("internationalization-and-localization-1-" * 40) == []
