"""Small fixtures for the tests of the training-data operators."""

import random
import re

LETTERS = "abcdefghijklmnopqrstuvwxyz"


def word(draw, n=(3, 9)):
    return "".join(draw.choice(LETTERS) for _ in range(draw.randint(*n)))


def prose(draw, words=80, vocabulary=None):
    out = []
    while len(out) < words:
        n = draw.randint(4, 14)
        s = [draw.choice(vocabulary) if vocabulary else word(draw) for _ in range(n)]
        s[0] = s[0].capitalize()
        s[-1] += "."
        out += s
    text = " ".join(out)
    return re.sub(r"\. ", lambda m: draw.choice([". ", ".\n"]), text)


def components(nodes, links):
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}
