"""Benchmark inputs with known events."""

from __future__ import annotations

from textmesh.sources.files import escape


def spaced(tokens: list[str], size: int, filler: str = ".") -> tuple[str, list[tuple[int, int, int]]]:
    """A text of `size` characters with the tokens at even distances, and the
    events of the literal patterns 1..n of these tokens."""
    step = size // max(1, len(tokens))
    out, events = [], []
    for k, t in enumerate(tokens):
        if len(t) > step:
            raise ValueError("the text is too short")
        events.append((k + 1, k * step, k * step + len(t)))
        out.append(t.ljust(step, filler))
    return "".join(out).ljust(size, filler), events


def literal_sparse(n: int, size: int):
    tokens = [f"token{k:06d}" for k in range(n)]
    text, events = spaced(tokens, size)
    return list(enumerate(map(escape, tokens), 1)), text, events


def literal_dense(n: int, size: int):
    tokens = [f"k{k:05d};" for k in range(n)]
    unit = "".join(tokens)
    text = (unit * (size // len(unit) + 1))[: size // 7 * 7]
    events = sorted((p // 7 % n + 1, p, p + 7) for p in range(0, len(text), 7))
    return list(enumerate(map(escape, tokens), 1)), text, events


def mixed_sparse(n: int, size: int):
    """Four shapes: alternation, counted class, plus, optional group."""
    patterns, tokens = [], []
    for k in range(n):
        p, t = [(f"alt{k:05d}(x|y)", f"alt{k:05d}y"), (f"cnt{k:05d}[a-c]{{3}}", f"cnt{k:05d}abc"), (f"plus{k:05d}z+", f"plus{k:05d}z"), (f"opt{k:05d}(end)?!", f"opt{k:05d}end!")][k % 4]
        patterns.append((k + 1, p))
        tokens.append(t)
    text, events = spaced(tokens, size)
    return patterns, text, events


def word_assertions(n: int, size: int):
    tokens = [f"word{k:04d}" for k in range(n)]
    text, events = spaced(tokens, size, " ")
    return [(k, rf"\b{t}\b") for k, t in enumerate(tokens, 1)], text, events


def mixed_unfilterable(n: int, size: int):
    tokens = [f"token{k:06d}" for k in range(n)]
    text, events = spaced(tokens, size)
    return [(k, ("(?i)" if k % 2 else "") + t) for k, t in enumerate(tokens, 1)], text, events
