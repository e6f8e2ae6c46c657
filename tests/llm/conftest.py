import random

import pytest

WORDS = "the of and river stone Étoile größe canción light walks under over 日本 x1 don't".split()


@pytest.fixture
def rng():
    return random.Random(7)


@pytest.fixture
def prose(rng):
    """n words of made-up text."""

    def make(n: int) -> str:
        return " ".join(rng.choice(WORDS) + rng.choice(["", "", "", str(rng.randint(0, 999)), ","]) for _ in range(n))

    return make
