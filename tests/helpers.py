"""Plain-Python reading of small results, for brute-force comparison."""

from collections import Counter

from whence.operators.semirings import expand


def hows(frame, *columns):
    """{column values: how text} of a small result."""
    out = {}
    for row in frame.how().collect():
        key = tuple(row[c] for c in columns)
        out[key if len(columns) > 1 else key[0]] = row["how"]
    return out


def polynomials(frame, *columns):
    """{column values: Counter of sorted monomials}, expanded to base tokens."""
    terms = {}
    for row in expand(frame).terms.collect():
        terms.setdefault(row["out"], Counter())[tuple(row["m"])] += row["c"]
    return {key: terms[how] for key, how in hows(frame, *columns).items()}


def poly(*monomials):
    return Counter(tuple(sorted(m.split())) for m in monomials)
