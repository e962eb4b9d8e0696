"""A task of the language model lets go of one block of chunks before it puts the next one together."""

import weakref

import numpy as np

from maskwright.llm.gated_model import BANDS, HEAD, NONE, Model, Settings, train


def test_training_lets_go_of_a_block():
    settings = Settings(lanes=4)
    alive = []

    def chunks():
        seen = []
        for k in range(3):
            alive.append(sum(ref() is not None for ref in seen))
            symbols = np.arange(60, dtype=np.int32) % HEAD
            block = symbols, np.full(60, NONE, np.uint32), np.array([20, 20, 20]), np.arange(3)
            seen += [weakref.ref(a) for a in block]
            del symbols
            yield block
            del block

    model = Model(settings)
    model.start_at(np.ones(HEAD, np.int64), np.zeros(BANDS, np.int64))
    assert train(Model(settings, model.flat, np.zeros(BANDS, np.int64)), settings, chunks()) == 180
    assert alive == [0, 0, 0]
