"""A threshold that the trees cannot serve is refused, not served with a lower recall."""

import pytest

from tidecast.llm import forest


def test_threshold_below_the_recall_is_refused():
    assert forest.prefix_depth(0.8) == 3
    assert forest.prefix_depth(0.45) == 1
    with pytest.raises(ValueError, match="recall"):
        forest.prefix_depth(0.4)
