"""op10: the table of lattices that a worker keeps, and draws that are frozen."""

import zlib

import numpy as np
import pytest

from larkspire.llm import fasttok, subword

SOME = ["the theon of the sea and the oner", "  a  b\tc\n漢字 𝟘 ", "word " * 40 + "end", "x" * 500, "a▁b \ud800", ""]


@pytest.fixture(scope="module")
def path():
    return fasttok.vocabulary("piece_bpe_32k.model")


def test_words_used_again_stay_in_a_full_table(path):
    m = subword.Model(path, 2000)
    asked, fresh = "theon oner", subword.Model(path)
    for n in range(40):
        text = f"{asked} {' '.join(f'rare{n}x{i}' for i in range(10))}"
        got, alone = m.sampled(text, n), fresh.sampled(text, n)
        assert [(x[0].tobytes(), *x[1:]) for x in got] == [(x[0].tobytes(), *x[1:]) for x in alone]
    assert m.used <= m.arcs == 2000 and len(m.units) < 402
    # A batch that doesn't need them drops what it doesn't know, and keeps these.
    while "rare39x0" in m.units:
        m.sampled(" ".join(f"new{n}y{i}" for i in range(10)), 1)
        n += 1
    assert "theon" in m.units and "oner" in m.units


def test_a_batch_larger_than_the_table_is_drawn_whole(path):
    small, large = subword.Model(path, 100), subword.Model(path)
    for some in (SOME, SOME[2:], SOME[:2]):
        got, other = (list(m.batch(some, list(range(len(some))), 3)) for m in (small, large))
        assert [[(x[0].tobytes(), *x[1:]) for x in f] for f in got] == [[(x[0].tobytes(), *x[1:]) for x in f] for f in other]


def test_one_node_is_drawn_like_many(path):
    m = subword.Model(path)
    m.places(["theoning", "théon"])
    nodes = np.arange(m.nodes)
    seeds = nodes.astype(np.uint64) * np.uint64(0xDEADBEEFCAFEF00D)
    for s in range(3):
        assert m._draw(seeds, s, nodes).tolist() == [m._draw_one(int(z), s, int(n)) for z, n in zip(seeds, nodes, strict=True)]


def test_samples_are_those_of_earlier_versions(path):
    found = subword.Model(path).batch(SOME, list(range(len(SOME))), 2)
    assert [[(len(ids), zlib.crc32(ids.tobytes())) for ids, *_ in f] for f in found] == [
        [(12, 1431320492), (12, 3053501928)],
        [(17, 1262451715), (17, 1509944933)],
        [(51, 4046829060), (48, 1619033236)],
        [(171, 2631118641), (174, 1128164747)],
        [(4, 1912111338), (5, 2591634360)],
        [(0, 0)],
    ]


def test_a_units_lattice_does_not_depend_on_the_others(path):
    m, word = subword.Model(path), subword.MARK + "theonerstöschäder"
    alone = m.lattices([word])
    others = [f"{subword.MARK}{a}ing{i}" for i in range(3000) for a in ("the", "ön", "x")]
    count, *together = m.lattices([*others, word])
    assert count[-1] == alone[0][0]
    for a, b in zip(alone[1:], together, strict=True):
        assert a.tolist() == b[-len(a) :].tolist()
