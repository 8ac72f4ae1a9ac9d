"""The vectorised bidirectional LSTM against plain loops over one block and one number at a time."""

import math
from zlib import crc32

import numpy as np

from tessera.llm import blocklstm
from tessera.llm.blocklstm import HIDDEN, NAMES, WORDS, BlockLabeller, Pages
from tessera.llm.htmlblocks import blocks

PAGES = [
    "<html><body><nav class=menu><a href=x>One</a> two</nav><article><h1>Title of it</h1><p>Some text, and more. Yes!</p><p>Again</p></article><footer>end</footer></body></html>",
    "<p>alone",
    "",
    "".join(f'<div class="a{chr(97 + k % 26)}b">' for k in range(60)) + "deep text here" + "<p>and <a href=y>linked</a> words</p>",
]


def plain_probabilities(w, page):
    sigmoid = lambda x: 1 / (1 + math.exp(-x))
    inputs = []
    for at, block in enumerate(page):
        names = block.path if block.counts else [crc32(n.encode()) % NAMES for n in block.path]
        vector = [sum(w["names"][n][k] * c for n, c in zip(names, block.counts or [1] * len(names))) for k in range(blocklstm.NAME_SIZE)]
        split = block.text.split()
        vector += [sum(w["words"][crc32(x.encode()) % WORDS][k] for x in split) / max(1, len(split)) for k in range(blocklstm.WORD_SIZE)]
        marks = sum(c in ".,;:!?" for c in block.text)
        n = len(block.text)
        inputs.append(vector + [math.log(1 + n) / 5, math.log(1 + len(split)) / 4, min(1, block.linked / n), min(1, 10 * marks / n), at / len(page), float(block.text[-1] in ".!?")])
    sides = {}
    for side, order in (("f", range(len(page))), ("b", range(len(page) - 1, -1, -1))):
        h, c, states = [0.0] * HIDDEN, [0.0] * HIDDEN, {}
        for at in order:
            gate = [w[f"b{side}"][k] + sum(x * w[f"x{side}"][j][k] for j, x in enumerate(inputs[at])) + sum(x * w[f"h{side}"][j][k] for j, x in enumerate(h)) for k in range(4 * HIDDEN)]
            c = [sigmoid(gate[HIDDEN + k]) * c[k] + sigmoid(gate[k]) * math.tanh(gate[3 * HIDDEN + k]) for k in range(HIDDEN)]
            h = [sigmoid(gate[2 * HIDDEN + k]) * math.tanh(c[k]) for k in range(HIDDEN)]
            states[at] = h
        sides[side] = states
    return [sigmoid(w["out_b"][0] + sum(x * y for x, y in zip(sides["f"][at] + sides["b"][at], w["out"]))) for at in range(len(page))]


def test_forward_pass_equals_plain_loops():
    labeller = BlockLabeller(3)
    pages = [blocks(p) for p in PAGES]
    expected = [p for page in pages for p in plain_probabilities(labeller.w, page)]
    assert len(expected) == 8 and np.allclose(labeller.probabilities(Pages(pages)), expected, atol=1e-10)
