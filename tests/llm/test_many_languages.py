"""Documents of more than four languages."""

import numpy as np
import pytest

from foliotab.llm import langid


def test_all_languages_of_a_document():
    own = np.repeat(np.arange(7), 200)
    like = np.where(np.arange(9) == own[:, None], -2.0, -9.0).astype(np.float32)
    share, chosen = langid.mixtures(np.concatenate([like, like[own == 1]]), np.array([0, len(own)]))
    assert chosen.tolist() == [7, 1]
    assert share[0] == pytest.approx([1 / 7] * 7 + [0, 0], abs=0.01)
