"""The sampler's noise and lattices."""

import numpy as np
import pyarrow as pa

from maskwright.llm import pieces
from maskwright.llm.queries import tokenizer_file
from maskwright.llm.texts import U64, byte_hashes, mix


def _lattice(*words: str) -> tuple[pieces.Vocabulary, pieces.Lattice]:
    vocabulary = pieces.vocabulary_of(tokenizer_file("piece_bpe_32k.model"), 1.0)
    data = np.frombuffer("".join(words).encode(), np.uint8)
    stop = np.cumsum([len(w.encode()) for w in words])
    return vocabulary, pieces.Lattice(vocabulary, data, np.r_[0, stop[:-1]], stop)


def test_noise_is_drawn_only_where_there_is_a_choice(monkeypatch):
    """Edges that leave their node alone get no noise, and each other edge of a walk one number."""
    _, lattice = _lattice(" banana", " zq一Ж", " a")
    drawn = []
    monkeypatch.setattr(pieces, "mix", lambda x: drawn.append(len(x)) or mix(x))
    walk = pieces._walk(lattice, np.arange(3), lattice.start.copy(), mix(np.arange(1, 4).astype(U64)))
    edge = walk.edges
    node = np.searchsorted(lattice.first, edge, "right") - 1
    many = lattice.first[node + 1] - lattice.first[node]
    assert (many == 1).any() and (many > 1).any()
    assert sum(drawn) == int(many[many > 1].sum())
    assert len(walk.sibling_edge) == int((many[many > 1] - 1).sum()) and (walk.behind >= 0).all()


def test_truncated_values_are_those_of_the_plain_formula():
    random = np.random.default_rng(1)
    target, best, value = random.normal(0, 5, 999), random.gumbel(size=999), random.gumbel(size=999)
    value = np.minimum(value, best)
    v = target - value + np.log1p(-np.exp(np.minimum(value - best, 0.0)) * (value < best))
    plain = np.where(value < best, target - np.maximum(v, 0.0) - np.log1p(np.exp(-np.abs(v))), target)
    assert np.allclose(pieces._truncated(target, np.exp(-value) - np.exp(-best)), plain, atol=1e-9)
    # far from the target nothing overflows, and no value lies above it
    far = pieces._truncated(np.array([2000.0, -2000.0]), np.array([0.0, 1.0]))
    assert far[0] == 2000.0 and far[1] == -2000.0


def test_a_row_does_not_depend_on_its_slice():
    texts = ["Twee rivieren lopen én", None, "", "a\nb  c", "banana " * 50]
    vocabulary = pieces.vocabulary_of(tokenizer_file("piece_bpe_32k.model"), 1.0)
    keys = byte_hashes(np.frombuffer(b"abcde", np.uint8), np.arange(5), np.arange(1, 6))
    together = pieces.sample(vocabulary, pa.array(texts), keys, 3)
    for i, text in enumerate(texts):
        alone = pieces.sample(vocabulary, pa.array([text], pa.string()), keys[i:i + 1], 3)[0]
        assert [a[0].tolist() for a in alone] == [a[0].tolist() for a in together[i]]
        assert all(vocabulary.decode(a[0].tolist()) == (text or "") for a in alone)
        assert np.allclose([a[1:] for a in alone], [a[1:] for a in together[i]])
