"""Unigram lattices over a trie of words.

Words in sorted order are a depth-first walk of their trie: the nodes of the
common prefix with the previous word are still on the stack, so each trie node
(= distinct prefix) is scored once however many words share it.
"""

from __future__ import annotations

import math

SPACE = "▁"  # marks a word's start in the vocabulary
BYTES = 256


def load_pieces(path: str) -> list[str]:
    """Pieces of a sentencepiece vocabulary in rank order (control, unknown and
    byte pieces left out: bytes are one class, see ``Lattice``)."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    out = []
    for i in range(sp.vocab_size()):
        p = sp.id_to_piece(i)
        if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i) or SPACE in p[1:] or p == ""):
            out.append(p)
    ranked = sorted(range(len(out)), key=lambda k: (-sp.get_score(sp.piece_to_id(out[k])), k))
    return [out[k] for k in ranked]


def zipf_scores(n: int) -> list[float]:
    """Natural-log scores by rank: the vocabulary's order is its only statement
    about frequency, so p(rank) is proportional to 1 / (rank + 1)."""
    norm = math.log(math.fsum(1 / (r + 1) for r in range(n)))
    return [-math.log(r + 1) - norm for r in range(n)]


class Lattice:
    """Piece scores; a character that is no piece itself is spelled in UTF-8
    bytes, each with the score ``byte_score``."""

    def __init__(self, pieces: list[str], scores: list[float], byte_score: float):
        self.ids = {p: (i, s) for i, (p, s) in enumerate(zip(pieces, scores))}
        self.byte_id, self.byte_score = len(pieces), byte_score
        self.longest = max(map(len, pieces), default=1)

    def arcs(self, x: str, j: int) -> list[tuple[int, int, float, int]]:
        """(start, piece id, score, tokens) of the pieces of ``x`` that end at ``j``."""
        get, out = self.ids.get, []
        for i in range(max(0, j - self.longest), j):
            if hit := get(x[i:j]):
                out.append((i, hit[0], hit[1], 1))
        if x[j - 1] not in self.ids:
            n = len(x[j - 1].encode("utf-8", "replace"))
            out.append((j - 1, self.byte_id, n * self.byte_score, n))
        return out


def shared_prefix(a: str, b: str) -> int:
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    k = 0
    while a[k] == b[k]:
        k += 1
    return k


def forward_sums(words, lattice: Lattice, weights=None, expected=None) -> list[float]:
    """Log of the summed probability of all segmentations of each word, by a
    log-space forward recursion.  ``words`` sorted.  With ``weights`` (one per
    word) and ``expected`` (a list, one entry per piece and one for bytes) the
    expected piece counts are added to it: leaving a node hands its weight on
    to the nodes its arcs start from, in proportion to their share."""
    exp, log = math.exp, math.log
    alpha, arcs, mass = [0.0], [()], [0.0]
    prev, out = "", []

    def leave(depth):
        while len(alpha) > depth + 1:
            a, into, g = alpha.pop(), arcs.pop(), mass.pop()
            if g:
                for i, p, s, n in into:
                    share = g * exp(alpha[i] + s - a)
                    expected[p] += share * n if p == lattice.byte_id else share
                    mass[i] += share

    for w, word in enumerate(words):
        x = SPACE + word
        keep = shared_prefix(prev, x)
        if expected is None:
            del alpha[keep + 1:]
        else:
            leave(keep)
        for j in range(keep + 1, len(x) + 1):
            into = lattice.arcs(x, j)
            if len(into) == 1:
                alpha.append(alpha[into[0][0]] + into[0][2])
            else:
                terms = [alpha[i] + s for i, _, s, _ in into]
                top = max(terms)
                alpha.append(top + log(sum([exp(t - top) for t in terms])))
            if expected is not None:
                arcs.append(into)
                mass.append(0.0)
        prev = x
        out.append(alpha[-1])
        if expected is not None:
            mass[-1] += weights[w]
    if expected is not None:
        leave(0)
    return out


def best_counts(words, lattice: Lattice) -> list[tuple[float, int]]:
    """(score, tokens) of the best segmentation of each word; of equal scores
    the one with fewer tokens.  ``words`` sorted."""
    best, prev, out = [(0.0, 0)], "", []
    for word in words:
        x = SPACE + word
        keep = shared_prefix(prev, x)
        del best[keep + 1:]
        for j in range(keep + 1, len(x) + 1):
            top, fewest = -math.inf, 0
            for i, _, s, n in lattice.arcs(x, j):
                b, k = best[i]
                b, k = b + s, k + n
                if b > top or (b == top and k < fewest):
                    top, fewest = b, k
            best.append((top, fewest))
        prev = x
        out.append(best[-1])
    return out
