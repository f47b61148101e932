"""Main text of HTML pages, by a linear-chain conditional random field over leaf blocks.

A page is a sequence of blocks of text between block-level tags; each is main text or not. Features are the
tags and the class, id and role words of all ancestors, and properties of the text. Weights are
trained on labelled pages by maximum likelihood (forward-backward); a page is decoded by Viterbi.

Character references are decoded, white space inside a block becomes one space, blocks are joined
by one space. Null, empty and textless pages give an empty text; broken markup is read leniently.
Repeated rows are treated one by one; an empty table gives an empty result.
"""

from __future__ import annotations

import functools
from collections.abc import Iterable
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import map_text
from .labelled_pages import TRAIN_PAGES, labelled_pages
from .pages import Block, Context, block_features, leaf_blocks, text_features


@dataclass
class Field:
    """Weights of a chain with the labels 0 (other) and 1 (main)."""

    names: dict[str, int]
    emission: np.ndarray  # feature by label
    transition: np.ndarray  # label by following label

    def own_score(self, features: Iterable[str]) -> np.ndarray:
        known = self.names
        return self.emission[[known[f] for f in features if f in known]].sum(axis=0)

    def context_score(self, context: Context) -> tuple[float, float]:
        """The sum over all open elements, each looked at once for all blocks inside it."""
        waiting: list[Context] = []
        at: Context | None = context
        while at is not None and at.score is None:
            waiting.append(at)
            at = at.outer
        total = at.score if at is not None else (0.0, 0.0)
        for inside in reversed(waiting):
            if inside.added:
                zero, one = self.own_score(inside.added).tolist()
                total = (total[0] + zero, total[1] + one)
            inside.score = total
        return total

    def decode(self, blocks: list[Block]) -> list[int]:
        """The most likely labels."""
        if not blocks:
            return []
        scores = [
            (own + self.context_score(block.context)).tolist()
            for block in blocks
            for own in (self.own_score(text_features(block)),)
        ]
        (t00, t01), (t10, t11) = self.transition.tolist()
        zero, one = scores[0]
        came: list[tuple[bool, bool]] = []
        for e0, e1 in scores[1:]:
            from_one = (one + t10 > zero + t00, one + t11 > zero + t01)
            came.append(from_one)
            zero, one = (
                e0 + (one + t10 if from_one[0] else zero + t00),
                e1 + (one + t11 if from_one[1] else zero + t01),
            )
        labels = [int(one > zero)]
        for from_one in reversed(came):
            labels.append(int(from_one[labels[-1]]))
        return labels[::-1]


def _marginals(scores: np.ndarray, transition: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Probabilities of each block's label, and of each pair of neighbouring labels summed."""
    n = len(scores)
    forward, backward = np.zeros((n, 2)), np.zeros((n, 2))
    forward[0] = scores[0]
    for i in range(1, n):
        forward[i] = scores[i] + np.logaddexp(*(forward[i - 1][:, None] + transition))
    for i in range(n - 2, -1, -1):
        backward[i] = np.logaddexp(*(transition + scores[i + 1] + backward[i + 1]).T)
    whole = np.logaddexp(*forward[-1])
    pairs = np.exp(
        forward[:-1, :, None] + transition[None] + (scores[1:] + backward[1:])[:, None, :] - whole
    ).sum(axis=0)
    return np.exp(forward + backward - whole), pairs


def train(pages: list[str], passes: int = 12, rate: float = 0.4, penalty: float = 1e-5) -> Field:
    """Weights from pages in which main text is marked, by stochastic gradients with per-weight rates."""
    sequences = [blocks for page in pages if (blocks := leaf_blocks(page))]
    names: dict[str, int] = {}
    data = []
    for blocks in sequences:
        own = [[names.setdefault(f, len(names)) for f in block_features(blocks, i)] for i in range(len(blocks))]
        flat = np.array([f for one in own for f in one])
        owner = np.repeat(np.arange(len(own)), [len(one) for one in own])
        data.append((flat, owner, np.array([int(block.main) for block in blocks])))
    emission, transition = np.zeros((len(names), 2)), np.zeros((2, 2))
    seen, seen_pairs = np.full_like(emission, 1e-3), np.full_like(transition, 1e-3)
    order = np.random.default_rng(5)
    for _ in range(passes):
        for i in order.permutation(len(data)):
            flat, owner, labels = data[i]
            scores = np.zeros((len(labels), 2))
            np.add.at(scores, owner, emission[flat])
            chances, pairs = _marginals(scores, transition)
            chances[np.arange(len(labels)), labels] -= 1
            np.subtract.at(pairs, (labels[:-1], labels[1:]), 1)
            touched, where = np.unique(flat, return_inverse=True)
            slope = penalty * emission[touched]
            np.add.at(slope, where, chances[owner])
            seen[touched] += slope**2
            emission[touched] -= rate * slope / np.sqrt(seen[touched])
            seen_pairs += pairs**2
            transition -= rate * pairs / np.sqrt(seen_pairs)
    return Field(names, emission, transition)


@functools.cache
def default_field(count: int = TRAIN_PAGES) -> Field:
    """Trained once in a driver's life, on the same pages each time."""
    return train(labelled_pages(count))


def main_text(html: str, field: Field) -> str:
    blocks = leaf_blocks(html)
    return " ".join(block.text for block, label in zip(blocks, field.decode(blocks)) if label)


def extract(
    rows: DataFrame, field: Field | None = None, html: str = "html", passed: dict[str, Column] | None = None
) -> DataFrame:
    """The passed columns (page_id and url unless given) and `text`, the main text of each page."""
    shared = rows.sparkSession.sparkContext.broadcast(field or default_field())

    def factory():
        trained = shared.value
        return lambda pages: [(main_text(page, trained),) for page in pages]

    passed = passed or {"page_id": F.col("page_id"), "url": F.col("url")}
    return map_text(rows, html, passed, "text string", factory)
