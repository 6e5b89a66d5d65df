"""A linear-chain conditional random field of two states, vectorised over sequences of a batch."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import xxhash


@dataclass
class Chain:
    """Log-odds weights of hashed token features, and log potentials of neighbours' states.

    A token's features are its word, its prefixes, and the words before and behind it. ``a``, ``b`` and ``c`` are for
    clean before tagged, tagged before clean, and two tagged neighbours, against two clean ones.
    """

    weight: np.ndarray
    a: float
    b: float
    c: float
    bits: int


PREFIXES = (4, 5, 6, 7, 8)
_PUNCTUATION = b".,;:!?\"'()[]{}*$%&#|<>=+-_/\\"


def plain(word: bytes) -> bytes:
    """The word in lower case, without punctuation around it."""
    if word.isascii():
        return word.lower().strip(_PUNCTUATION)
    return word.decode(errors="replace").lower().encode().strip(_PUNCTUATION)


def word_features(word: bytes, bits: int) -> tuple[list[int], int, int]:
    """Places of a (plain) word's own features, and of its feature as the word before, and behind, another."""
    mask, digest = (1 << bits) - 1, xxhash.xxh64_intdigest
    text = word if word.isascii() else word.decode(errors="replace")
    prefixes = [text[:k] for k in PREFIXES if len(text) > k]
    if text is not word:
        prefixes = [p.encode() for p in prefixes]
    own = [digest(b"w" + word, 10)] + [digest(b"p" + p, 10) for p in prefixes]
    return [h & mask for h in own], digest(b"b" + word, 10) & mask, digest(b"n" + word, 10) & mask


def _pad(sequences: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    lengths = np.array([len(s) for s in sequences])
    out = np.zeros((int(lengths.max(initial=0)), len(sequences)))
    for i, s in enumerate(sequences):
        out[: len(s), i] = s
    return out, lengths


def forward_backward(emission: np.ndarray, lengths: np.ndarray, chain: Chain) -> tuple[np.ndarray, np.ndarray]:
    """Forward and backward log-odds; their sum is the log-odds of a token's marginal. Time runs down the rows."""
    forward, backward = np.empty_like(emission), np.zeros_like(emission)
    a, b, c = chain.a, chain.b, chain.c
    if len(emission):
        forward[0] = emission[0] + a
    for t in range(1, len(emission)):
        f = forward[t - 1]
        forward[t] = emission[t] + np.logaddexp(f + c, a) - np.logaddexp(f + b, 0)
    for t in range(len(emission) - 2, -1, -1):
        e = emission[t + 1] + backward[t + 1]
        backward[t] = np.where(t + 1 < lengths, np.logaddexp(e + c, b) - np.logaddexp(e + a, 0), 0)
    return forward, backward


def marginals(sequences: list[np.ndarray], chain: Chain, together: int = 256, most_cells: int = 1 << 19) -> list[np.ndarray]:
    """Log-odds of each token's marginal, for emissions of several sequences.

    Like lengths are run together, so many that they have ``most_cells`` places at most when padded; a longer one runs alone.
    """
    out: list[np.ndarray] = [np.zeros(0)] * len(sequences)
    order = sorted(range(len(sequences)), key=lambda i: len(sequences[i]))
    at = 0
    while at < len(order):
        last = at + 1
        while last < min(len(order), at + together) and (last + 1 - at) * len(sequences[order[last]]) <= most_cells:
            last += 1
        ids, at = order[at:last], last
        emission, lengths = _pad([sequences[i] for i in ids])
        forward, backward = forward_backward(emission, lengths, chain)
        both = forward + backward
        for k, i in enumerate(ids):
            out[i] = both[: lengths[k], k]
    return out


def fit_chain(windows: list[tuple[list[bytes], list[int]]], bits: int, *, epochs: int = 6, batch: int = 256, rate: float = 0.5, l2: float = 1e-5) -> Chain:
    """Chain fitted to tagged token sequences by AdaGrad on the conditional log-likelihood.

    The gradient of a feature is its observed less its expected count, the latter from forward-backward marginals of
    tokens and of neighbours.
    """
    chain = Chain(np.zeros(1 << bits), -1.0, 0.0, 0.0, bits)
    squares, edge_squares = np.full(1 << bits, 1e-2), np.full(3, 1e-2)
    known: dict[bytes, tuple[list[int], int, int]] = {}
    made = []
    for words, tags in windows:
        of = [known.get(w) or known.setdefault(w, word_features(w, bits)) for w in words]
        places = [[*o[0], *([of[i - 1][1]] if i else []), *([of[i + 1][2]] if i + 1 < len(of) else [])] for i, o in enumerate(of)]
        flat = np.array([x for p in places for x in p], np.int64)
        made.append((flat, np.repeat(np.arange(len(places)), [len(p) for p in places]), np.array(tags, float)))
    rng = np.random.default_rng(10)
    for _ in range(epochs):
        order = rng.permutation(len(made))
        for at in range(0, len(order), batch):
            part = [made[i] for i in order[at : at + batch]]
            emission, lengths = _pad([np.bincount(of, chain.weight[flat], len(tags)) for flat, of, tags in part])
            tags, _ = _pad([t for _, _, t in part])
            forward, backward = forward_backward(emission, lengths, chain)
            p = 1 / (1 + np.exp(-np.clip(forward + backward, -40, 40)))
            flats = np.concatenate([flat for flat, _, _ in part])
            errors = np.concatenate([(own - p[: len(own), k])[of] for k, (_, of, own) in enumerate(part)])
            gradient = np.bincount(flats, errors, len(chain.weight)) / len(part) - l2 * chain.weight
            edges = _edge_gradient(emission, forward, backward, lengths, tags, p, chain) / len(part)
            squares += gradient**2
            edge_squares += edges**2
            chain.weight += rate * gradient / np.sqrt(squares)
            step = rate * edges / np.sqrt(edge_squares)
            chain.a, chain.b, chain.c = chain.a + step[0], chain.b + step[1], chain.c + step[2]
    return chain


def _edge_gradient(emission, forward, backward, lengths, tags, p, chain) -> np.ndarray:
    """Observed less expected counts of (clean, tagged), (tagged, clean) and (tagged, tagged) neighbours.

    A chain begins as if behind a clean token.
    """
    inside = np.arange(1, len(emission))[:, None] < lengths
    before, behind = tags[:-1], tags[1:]
    e = emission[1:] + backward[1:]
    f = forward[:-1]
    scores = np.stack([np.zeros_like(f), e + chain.a, f + chain.b, f + e + chain.c])
    scores -= scores.max(axis=0)
    shares = np.exp(scores)
    shares /= shares.sum(axis=0)
    seen = np.stack([(1 - before) * behind, before * (1 - behind), before * behind])
    edges = ((seen - shares[1:]) * inside).sum(axis=(1, 2))
    edges[0] += (tags[0] - p[0])[lengths > 0].sum()
    return edges
