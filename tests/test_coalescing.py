"""Coalescing in slices against the sequential rule, told over plain lists."""

import random

import pytest

from larkspire.operators import chunking

SCHEMA = "doc string, block_index int, text string, kind string, page int, section string"


def sequential(blocks, target, respect_page, respect_section, gap="\n\n"):
    groups, size = [], 0
    for b in sorted(blocks, key=lambda b: b[1]):
        n, last = len(b[2] or ""), groups[-1][-1] if groups else None
        alone = [x is not None and x[3] in ("table", "code_block") for x in (last, b)]
        fits = last and not any(alone) and size + len(gap) + n <= target
        if fits and respect_page:
            fits = last[4] == b[4]
        if fits and respect_section:
            fits = None in (last[5], b[5]) or last[5] == b[5]
        if fits:
            groups[-1].append(b)
            size += len(gap) + n
        else:
            groups.append([b])
            size = n
    out = []
    for g in groups:
        if len(g) == 1:
            out.append((g[0][0], g[0][1], g[0][2] or "", *g[0][3:], [g[0][1]]))
            continue
        pages, named = {b[4] for b in g} - {None}, {b[5] for b in g} - {None, ""}
        text = gap.join(b[2].strip() for b in g if (b[2] or "").strip())
        out.append((g[0][0], g[0][1], text, "coalesced_text", pages.pop() if len(pages) == 1 else None, named.pop() if len(named) == 1 else g[0][5], [b[1] for b in g]))
    return out


def made(doc, n, seed, plain=False):
    r, out = random.Random(seed), []
    for i in range(n):
        text = r.choice(["", None, " ", "x" * r.randrange(1, 9), " héé\n", "y" * 40])
        out.append((doc, i, text, "text" if plain or r.random() < 0.93 else r.choice(["table", "code_block", None]), None if plain or r.random() < 0.1 else i // 30, None if plain or r.random() < 0.3 else r.choice(["", "a", "a", "a", "b"])))
    return out


@pytest.mark.parametrize(("slice_blocks", "respect"), [(1, True), (3, True), (7, False), (4096, True)])
def test_slices_give_what_the_sequential_rule_gives(spark, slice_blocks, respect):
    docs = {d: made(d, n, s, plain) for s, (d, n, plain) in enumerate([("a", 90, True), ("b", 120, False), (None, 50, False), ("c", 1, False), ("d", 80, False)])}
    # Gaps in the places, some as wide as a slice.
    docs["d"] = [(b[0], b[1] * 5, *b[2:]) for b in docs["d"]]
    rows = [b for d in docs.values() for b in d]
    random.Random(1).shuffle(rows)
    got = chunking.coalesced(spark.createDataFrame(rows, SCHEMA), "doc", 30, respect, respect, slice_blocks=slice_blocks).collect()
    want = [g for d in docs.values() for g in sequential(d, 30, respect, respect)]
    order = lambda g: (g[0] or "", g[1])
    assert sorted((tuple(r) for r in got), key=order) == sorted(want, key=order)


def test_no_blocks(spark):
    assert chunking.coalesced(spark.createDataFrame([], SCHEMA), "doc", 30).collect() == []
